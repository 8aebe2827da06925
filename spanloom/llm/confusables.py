"""Problem 1: visually identical text with different characters.

Method: confusables skeleton. Each text is decomposed, every character replaced by the prototype of a look-alike table
and decomposed again (``functions.lookalike``); originals with equal skeletons look the same.
"""

from __future__ import annotations

from hashlib import blake2b
from unicodedata import normalize

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.lookalike import skeleton
from ..session import cut

#: Parts that the rows of one class are split into before they meet others, as one spelling may be on a third of all rows.
SALTS = 8


def _digest(text: str) -> bytes:
    return blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


@F.pandas_udf(T.StringType())
def consistent_form(text: pd.Series) -> pd.Series:
    """The one form of a text: the composed skeleton. Null stays null, an empty text stays empty."""
    return text.map(lambda t: None if t is None else t if t.isascii() else normalize("NFC", skeleton(t)))


@F.pandas_udf(T.StructType([T.StructField("look", T.BinaryType()), T.StructField("exact", T.BinaryType())]))
def look_keys(text: pd.Series) -> pd.DataFrame:
    """128-bit keys of a text's skeleton and of the text itself, so that no text has to be shuffled."""
    look, exact = [], []
    for t in text:
        if t is None:
            look.append(None)
            exact.append(None)
            continue
        own = _digest(t)
        exact.append(own)
        look.append(own if t.isascii() else _digest(skeleton(t)))
    return pd.DataFrame({"look": look, "exact": exact})


def _salted(rows: DataFrame) -> DataFrame:
    return rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))


def _on_every_salt(rows: DataFrame) -> DataFrame:
    return rows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def lookalike_rows(df: DataFrame, id_col: str, text_col: str, within: list[str] | None = None) -> DataFrame:
    """One row per row of ``df`` whose text looks like a different text: (look, the columns of ``within``, exact, id).

    Rows are compared only if the columns of ``within`` are equal; a null in one of them, in the id or in the text takes
    the row out. Identical strings alone make no class. Repeated rows are kept. An empty table gives an empty result; an
    empty text is a text like any other. Extra columns are ignored.

    Only ids and keys are shuffled. The classes with several spellings are found by min and max, which combine before the
    exchange, and come back to the rows on a salted key, so a text that makes up a third of all rows is no hot key.
    """
    within = within or []
    key = [F.col(c).alias(f"_w{i}") for i, c in enumerate(within)]
    rows = df.select(F.col(id_col).alias("id"), *key, look_keys(F.col(text_col)).alias("k"))
    by = ["look", *[f"_w{i}" for i in range(len(within))]]
    rows = rows.select("id", *by[1:], "k.look", "k.exact").dropna()
    mixed = rows.groupBy(*by).agg(F.min("exact").alias("lo"), F.max("exact").alias("hi")).filter("lo <> hi").select(*by)
    return _salted(rows).join(_on_every_salt(mixed), [*by, "salt"], "left_semi").select(*by, "exact", "id")


def lookalike_classes(df: DataFrame, id_col: str, text_col: str, within: list[str] | None = None) -> DataFrame:
    """(id, class_id, n_links): every row whose text looks like a different text, the class of its look (named by its
    least id), and how many rows have another spelling of it; see ``lookalike_rows``. In proportion to the rows, however large a class is."""
    rows = cut(lookalike_rows(df, id_col, text_col, within))
    by = [c for c in rows.columns if c not in ("id", "exact")]
    own = rows.groupBy(*by, "exact").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    links = own.groupBy(*by).agg(F.sum("n").alias("total"), F.min("least").alias("class_id")).join(own, by).withColumn("n_links", F.col("total") - F.col("n")).drop("n", "least", "total")
    out = _salted(rows).join(_on_every_salt(links), [*by, "exact", "salt"])
    return out.select("id", "class_id", "n_links")


def lookalike_pairs(df: DataFrame, id_col: str, text_col: str, within: list[str] | None = None) -> DataFrame:
    """Pairs (id_a, id_b), id_a < id_b, of rows with different strings that look the same; see ``lookalike_rows``.

    The pairs are formed between the distinct spellings of a class and only then joined to the rows that have them, so
    that copies of one spelling never meet each other: the work is that of the rows returned.
    """
    rows = cut(lookalike_rows(df, id_col, text_col, within))
    by = [c for c in rows.columns if c not in ("id", "exact")]
    spellings = rows.select(*by, "exact").distinct()
    a, b = spellings.withColumnRenamed("exact", "exact_a"), spellings.withColumnRenamed("exact", "exact_b")
    kinds = a.join(b, by).filter("exact_a < exact_b")
    left = _salted(rows).select(*by, F.col("exact").alias("exact_a"), F.col("id").alias("a"), "salt")
    right = _on_every_salt(rows).select(*by, F.col("exact").alias("exact_b"), F.col("id").alias("b"), "salt")
    pairs = left.join(_on_every_salt(kinds), [*by, "exact_a", "salt"]).join(right, [*by, "exact_b", "salt"])
    return pairs.filter("a <> b").select(F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b")).distinct()


def found(annotated_docs: DataFrame, extractions: DataFrame) -> DataFrame:
    """(record_type, id_a, id_b) over both tables."""
    docs = lookalike_pairs(annotated_docs, "document_key", "text")
    mentions = lookalike_pairs(extractions, "extraction_id", "extraction_text", ["document_key", "extraction_class"])
    kind = lambda name: F.lit(name).alias("record_type")
    return docs.select(kind("annotated_docs"), "id_a", "id_b").unionByName(mentions.select(kind("extractions"), "id_a", "id_b"))


def classes(annotated_docs: DataFrame, extractions: DataFrame) -> DataFrame:
    """(record_type, id, class_id, n_links) over both tables: the form for classes too large to list their pairs."""
    docs = lookalike_classes(annotated_docs, "document_key", "text")
    mentions = lookalike_classes(extractions, "extraction_id", "extraction_text", ["document_key", "extraction_class"])
    return docs.select(F.lit("annotated_docs").alias("record_type"), "*").unionByName(mentions.select(F.lit("extractions").alias("record_type"), "*"))


def with_consistent_text(df: DataFrame, text_col: str = "text", out: str = "consistent_text") -> DataFrame:
    """``df`` with the consistent form of a text column beside it (a column of that name is replaced)."""
    return df.withColumn(out, consistent_form(F.col(text_col)))
