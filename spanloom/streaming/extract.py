"""The pipeline over a stream of documents: each micro-batch is one run, so any decider and any stage works as in batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..config import Options, Schema
from ..operators import text as T
from ..operators.decisions import Decider
from ..plans.pipeline import Result, extract
from ..session import cleaning


def extract_stream(documents: DataFrame, schema: Schema, decider: Decider, sink: Callable[[Result, int], None], checkpoint: str, options: Options = Options(), once: bool = True) -> StreamingQuery:
    """Start a query that hands every micro-batch's Result to ``sink(result, batch_id)``; the checkpoint makes each
    document be processed once. ``maxFilesPerTrigger`` on the source bounds how many are in flight."""

    def run(batch: DataFrame, number: int) -> None:
        with cleaning(batch.sparkSession):  # what the batch wrote is not needed once the sink has taken its result
            sink(extract(batch, schema, decider, options), number)

    writer = documents.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def scan_stream(documents: DataFrame, schema: Schema, options: Options = Options()) -> DataFrame:
    """Sentences, tokens and candidates of a stream: one stateless pass, append mode."""
    return T.scan(T.not_blank(documents), schema, options)
