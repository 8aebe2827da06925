"""A façade over the pipeline for plain Python values: texts in, nested results out."""

from __future__ import annotations

import asyncio
from collections.abc import Iterable, Iterator
from itertools import batched

from pyspark.sql import DataFrame, SparkSession

from .config import Options, as_schema
from .data import AnnotatedDocument
from .operators.decisions import AnswerCache, CachedDecider, Decider
from .operators.text import documents
from .plans.pipeline import Result
from .plans.pipeline import extract as run
from .session import clean_up, cleaning, get_spark

DOCUMENT = "document_id string, text string, ordinal long"


def _as_row(item: object, ordinal: int) -> tuple:
    """A text, a mapping with text and document_id, or an object with these; the ordinal stands in for an absent id."""
    if isinstance(item, str):
        return (str(ordinal), item, ordinal)
    if isinstance(item, dict) and isinstance(item.get("text"), str):
        return (item["document_id"] if "document_id" in item else str(ordinal), item["text"], ordinal)
    text = getattr(item, "text", None)
    if not isinstance(text, str):
        raise TypeError(f"no document: {item!r}")
    key = getattr(item, "document_id", None)
    return (str(ordinal) if key is None else key, text, ordinal)


class Extractor:
    """A schema, a decider and options, ready for documents; answers are cached at ``cache`` if that is given."""

    def __init__(self, schema: object, decider: Decider, options: Options = Options(), cache: str | AnswerCache | None = None, spark: SparkSession | None = None):
        self.schema, self.options = as_schema(schema), options
        self.decider = CachedDecider(decider, cache, options.model) if cache else decider
        self.spark = spark or get_spark()

    def __enter__(self) -> Extractor:
        return self

    def __exit__(self, *_: object) -> None:
        clean_up(self.spark)

    def run(self, docs: DataFrame) -> Result:
        """Over a table with a text and perhaps a document_id or doc_id."""
        key = next((c for c in ("doc_id", "document_id") if c in docs.columns), None)
        return run(documents(docs, key), self.schema, self.decider, self.options)

    def extract(self, text: str) -> dict:
        return next(self.extract_many([text]))

    def extract_many(self, items: Iterable, at_once: int = 1000) -> Iterator[dict]:
        """Nested results in the order of the items. So many items are in flight at once: only their texts and results are
        held, and what a batch wrote is deleted after it."""
        for batch in batched(enumerate(items), at_once):
            rows = [_as_row(x, n) for n, x in batch]
            with cleaning(self.spark):
                own = self.spark.createDataFrame([(str(n), t) for _, t, n in rows], "doc_id string, text string")
                found = {r.document_id: r.asDict(recursive=True) for r in self.run(own).annotated().toLocalIterator()}
            for key, _, n in rows:
                yield found[str(n)] | {"document_id": key}

    def documents(self, items: Iterable, at_once: int = 1000) -> Iterator[AnnotatedDocument]:
        """The results as plain values."""
        return map(AnnotatedDocument.from_row, self.extract_many(items, at_once))

    async def aextract(self, text: str) -> dict:
        """``extract`` without blocking the event loop."""
        return await asyncio.to_thread(self.extract, text)


def extract(items: object, schema: object, decider: Decider, options: Options = Options()) -> object:
    """One text to one result, several items to a list."""
    engine = Extractor(schema, decider, options)
    return engine.extract(items) if isinstance(items, str) else list(engine.extract_many(items))
