"""Session settings and the few places where an operator cuts lineage or checks a size."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import ConfigurationError

#: A side is broadcast only if it has at most this many rows; beyond it the plain join is used.
MAX_BROADCAST_ROWS = 200_000


def get_spark(name: str = "spanloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings that the operators expect (UTC, AQE, Arrow)."""
    b = SparkSession.builder.appName(name)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    for k, v in {**base, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session. Only where that is unset and everything
    runs in one process is it a local one; a cluster must name its own."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not re.fullmatch(r"local(?:\[.*\])?", spark.conf.get("spark.master", "")):
            raise ConfigurationError("spark.checkpoint.dir must name a folder that all executors share")
        d = "file://" + os.path.join(tempfile.gettempdir(), "spanloom-checkpoints")
    return d


_WRITTEN: list[str] = []


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: lineage ends here and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def clean_up(spark: SparkSession, since: int = 0) -> int:
    """Delete what ``cut`` wrote in this process (after the first ``since`` of them); results that still depend on it can't
    be read afterwards."""
    n = 0
    while len(_WRITTEN) > since:
        path = spark._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        n += path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n


@contextmanager
def cleaning(spark: SparkSession) -> Iterator[None]:
    """Deletes on leaving what ``cut`` wrote inside."""
    since = len(_WRITTEN)
    try:
        yield
    finally:
        clean_up(spark, since)


def numbered(df: DataFrame, name: str = "number") -> DataFrame:
    """``df`` with the numbers 1, 2, 3, .. of its rows as they come; written first, so that they come the same way twice.

    Each partition counts from where those before it end; only one count a partition is read to the driver.
    """
    rows = cut(df)
    sizes = {r.p: r["count"] for r in rows.groupBy(F.spark_partition_id().alias("p")).count().collect()}
    before = dict(zip(sorted(sizes), accumulate((sizes[p] for p in sorted(sizes)), initial=1)))
    first = F.create_map(*[F.lit(x) for kv in before.items() for x in kv])[F.spark_partition_id()] if before else F.lit(1)
    return rows.withColumn(name, first + F.monotonically_increasing_id() % (1 << 33))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def is_small(df: DataFrame, most: int = MAX_BROADCAST_ROWS) -> bool:
    """True if ``df`` has at most ``most`` rows; reads no more than that."""
    return df.limit(most + 1).count() <= most
