"""Documents from text files and JSON lines, annotated documents from JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.text import documents


def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text): one file is one document, its name the id."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("document_id"), F.col("value").alias("text"))
    return documents(rows)


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text) of lines {"text", "document_id"?}: the id defaults to file:line; blank lines are counted but give no
    document; a line that is no JSON or has no text is an error, raised when it is read.

    Files are split: a line's number is its place in its block of the file plus the lines of the blocks before, of which
    there is one row for each block.
    """
    block = {"file": "_metadata.file_name", "path": "_metadata.file_path", "block": "_metadata.file_block_start"}
    lines = spark.read.text(path).select("value", *[F.col(c).alias(n) for n, c in block.items()], F.monotonically_increasing_id().alias("n"))
    sizes = lines.groupBy("path", "block").agg(F.min("n").alias("first"), F.count("*").alias("lines"))
    before = F.coalesce(F.sum("lines").over(Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = lines.join(sizes.withColumn("before", before), ["path", "block"]).filter(F.col("value").rlike(r"\S"))
    rows = rows.withColumn("line", F.concat_ws(":", "file", (F.col("n") - F.col("first") + F.col("before") + 1).cast("string"))).withColumn("j", F.from_json("value", "text string, document_id string"))
    text = F.coalesce("j.text", F.raise_error(F.concat(F.col("line"), F.lit(": no JSON object with a text"))).cast("string"))
    return documents(rows.select(F.coalesce("j.document_id", "line").alias("document_id"), text.alias("text")))


def read_annotated(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Annotated documents as ``write_jsonl`` left them; keys that ``schema`` doesn't know are ignored."""
    return spark.read.schema(schema).json(path)
