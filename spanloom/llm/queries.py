"""The registered queries of the operators for training text and their SQL."""

from __future__ import annotations

from unicodedata import normalize

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.lookalike import skeleton
from ..session import table
from . import confusables, leakage, names, packing, personal, pieces, sentences, stuffing

QUERIES: dict = {}
ORACLE: dict = {}


def _prototypes() -> str:
    """The look-alike table as rows of SQL, one for each character whose consistent form is another text."""
    rows = []
    for code in (*range(0x80, 0x3400), *range(0xA000, 0xAC00), *range(0xF900, 0xFFFE)):
        c = chr(code)
        if (form := normalize("NFC", skeleton(c))) != c:
            rows.append(f"({code}, '{form.replace(chr(39), chr(39) * 2)}')")
    return ", ".join(rows)


#: Strings of both tables with their consistent forms: character by character, then composed.
LOOKS = f"""WITH proto(code, form) AS (VALUES {_prototypes()}),
r AS (SELECT 'annotated_docs' AS record_type, document_key AS id, 0 AS d, '' AS c, text AS t FROM annotated_docs WHERE text IS NOT NULL AND document_key IS NOT NULL
UNION ALL SELECT 'extractions', extraction_id, document_key, extraction_class, extraction_text FROM extractions WHERE extraction_text IS NOT NULL AND extraction_id IS NOT NULL AND document_key IS NOT NULL AND extraction_class IS NOT NULL),
s AS (SELECT DISTINCT t, nfc_normalize(t) AS n FROM r), u AS (SELECT t, unnest(string_split(n, '')) AS ch, unnest(range(length(n))) AS i FROM s WHERE n <> ''),
l AS (SELECT t, nfc_normalize(string_agg(coalesce(form, ch), '' ORDER BY i)) AS look FROM u LEFT JOIN proto ON code = unicode(ch) GROUP BY t),
x AS (SELECT record_type, id, d, c, r.t, coalesce(look, '') AS look FROM r LEFT JOIN l ON l.t = r.t)"""

ORACLE["p1_found"] = LOOKS + """ SELECT DISTINCT a.record_type, least(a.id, b.id) AS id_a, greatest(a.id, b.id) AS id_b FROM x a JOIN x b ON a.record_type = b.record_type AND a.look = b.look AND a.d = b.d AND a.c = b.c AND a.t <> b.t AND a.id < b.id"""
ORACLE["p1_classes"] = LOOKS + """, m AS (SELECT record_type, d, c, look, min(id) AS class_id, count(*) AS total, count(DISTINCT t) AS spellings FROM x GROUP BY ALL),
o AS (SELECT record_type, d, c, look, t, count(*) AS n FROM x GROUP BY ALL)
SELECT record_type, id, class_id, total - n AS n_links FROM x JOIN m USING (record_type, d, c, look) JOIN o USING (record_type, d, c, look, t) WHERE spellings > 1"""
ORACLE["p1_consistent_text"] = LOOKS + """ SELECT document_key, look AS consistent_text FROM annotated_docs LEFT JOIN x ON record_type = 'annotated_docs' AND id = document_key"""


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of different strings that look the same, in both tables."""
    return confusables.found(table(spark, sf_dir, "annotated_docs"), table(spark, sf_dir, "extractions"))


@query
def p1_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every string that looks like a different one, with the class of its look and how many it is like."""
    return confusables.classes(table(spark, sf_dir, "annotated_docs"), table(spark, sf_dir, "extractions"))


@query
def p1_consistent_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text in the consistent form."""
    docs = confusables.with_consistent_text(table(spark, sf_dir, "annotated_docs"))
    return docs.select("document_key", "consistent_text")


@query
def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a test item or a passage of it, with the item."""
    return leakage.found(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


@query
def p8_leaked_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each leaked passage stands and how much of it is equal."""
    return leakage.leaked_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


@query
def p8_without_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its leaked passages."""
    return leakage.without_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


@query
def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that are mostly stuffed keywords, links, menus or tags."""
    return stuffing.found(table(spark, sf_dir, "documents"))


@query
def p9_page_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's own score, its host's rate and the smoothed score."""
    return stuffing.page_scores(table(spark, sf_dir, "documents"))


@query
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The party that each variant spelling in the extractions means."""
    return names.found(*(table(spark, sf_dir, t) for t in ("extractions", "parties", "schema_classes")))


@query
def p5_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct spelling that means a party, with the party and the cost of reading it so."""
    mentions = names.name_mentions(table(spark, sf_dir, "extractions"), table(spark, sf_dir, "schema_classes"))
    return names.link_spellings(mentions, table(spark, sf_dir, "parties"))


@query
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The span of every sentence or other unit of every text."""
    return sentences.found(table(spark, sf_dir, "annotated_docs"))


@query
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that exceed the limit of their project."""
    return pieces.found(table(spark, sf_dir, "annotated_docs"), table(spark, sf_dir, "projects"))


@query
def p6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document, with its text."""
    docs = pieces.with_limits(table(spark, sf_dir, "annotated_docs"), table(spark, sf_dir, "projects"))
    return pieces.piece_spans(docs, lang_col="lang", with_text=True)


@query
def p6_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What has to hold for the pieces of every document: within the limit, in order, no character lost."""
    docs = pieces.with_limits(table(spark, sf_dir, "annotated_docs"), table(spark, sf_dir, "projects"))
    order = Window.partitionBy("document_key").orderBy("piece")
    rows = pieces.piece_spans(docs, lang_col="lang").join(docs.select("document_key", "chunk_chars"), "document_key")
    rows = rows.withColumn("before", F.lag("end_pos", 1, 0).over(order)).withColumn("last", F.lag("start_pos", 1, -1).over(order))
    whole = F.min((F.col("start_pos") <= F.col("before")) & (F.col("start_pos") > F.col("last")) & (F.col("end_pos") >= F.col("before")))
    fits = F.min((F.col("end_pos") - F.col("start_pos") <= F.col("chunk_chars")) | F.col("chunk_chars").isNull())
    return rows.groupBy("document_key").agg(F.max("end_pos").alias("chars"), whole.alias("whole"), fits.alias("fits"), (F.max("piece") > 0).alias("cut"))


ORACLE["p6_cover"] = "SELECT document_key, length(text) AS chars, true AS whole, true AS fits, coalesce(length(text) > chunk_chars, false) AS cut FROM annotated_docs LEFT JOIN projects USING (project_id) WHERE text IS NOT NULL"
ORACLE["p6_found"] = """SELECT document_key FROM annotated_docs JOIN projects USING (project_id) WHERE length(text) > chunk_chars"""


@query
def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Container and position of every text for every container size."""
    return packing.containers(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pack_specs"))


@query
def p7_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What has to hold for the containers of each size: every text is there, no place is taken twice, none is too full, and
    only texts over the capacity are split."""
    specs = table(spark, sf_dir, "pack_specs")
    rows = packing.containers(table(spark, sf_dir, "documents"), specs).join(F.broadcast(specs.select("spec_id", "capacity_tokens")), "spec_id")  # one row for each stated size
    full = rows.groupBy("spec_id", "container").agg(F.sum("n_tokens").alias("tokens"), F.max("capacity_tokens").alias("capacity"), F.count("*").alias("n"), F.max("position").alias("last"), F.count_distinct("position").alias("places"))
    kept = full.groupBy("spec_id").agg(F.min((F.col("tokens") <= F.col("capacity")) & (F.col("n") == F.col("places")) & (F.col("n") == F.col("last") + 1)).alias("fits"))
    texts = rows.groupBy("spec_id", "doc_id").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("tokens"), F.max("capacity_tokens").alias("capacity"))
    split = texts.groupBy("spec_id").agg(F.count("*").alias("documents"), F.min(F.col("n") == F.greatest(F.lit(1), F.ceil(F.col("tokens") / F.col("capacity")))).alias("split_only_if_over"))
    return split.join(kept, "spec_id")


ORACLE["p7_places"] = "SELECT spec_id, (SELECT count(*) FROM documents) AS documents, true AS split_only_if_over, true AS fits FROM pack_specs"


@query
def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers of each size are."""
    specs = table(spark, sf_dir, "pack_specs")
    return packing.fill(packing.containers(table(spark, sf_dir, "documents"), specs), specs)


@query
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The span and kind of all personal information."""
    return personal.found(table(spark, sf_dir, "annotated_docs"), table(spark, sf_dir, "parties"))


@query
def p2_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text with placeholders in place of personal information."""
    return personal.redacted(table(spark, sf_dir, "annotated_docs"), table(spark, sf_dir, "parties"))
