"""Problem 6: splitting oversized items at natural boundaries.

Method: recursive bisection. A text over the limit is cut at the strongest boundary near its middle, and halves that
still exceed the limit minus the overlap are cut again; then each piece but the first is extended to the left.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import is_small
from .sentences import thai_starts, units

BLOCK = re.compile(r"\n[^\S\n]*\n\s*")
CLAUSE = re.compile(r"[,;:，；、：]\s*")
BLANK = re.compile(r"\s+")


def _near(places: list[int], low: int, high: int, middle: float) -> int | None:
    """The place in (low, high) that is nearest to the middle."""
    i, j = bisect_right(places, low), bisect_left(places, high)
    if i >= j:
        return None
    k = bisect_left(places, middle, i, j)
    return min(places[max(i, k - 1) : min(j, k + 1)], key=lambda p: (abs(p - middle), p))


def cut_places(text: str, lang: str | None, thai: frozenset[str] | None = None) -> tuple[list[int], list[int], list[int], list[int]]:
    """Where the next piece may begin: after blocks, after sentences, after clauses, after blanks."""
    blocks = [m.end() for m in BLOCK.finditer(text)]
    spans = units(text, lang, thai)
    sentences = [s for s, _ in spans[1:]]
    return blocks, sentences, [m.end() for m in CLAUSE.finditer(text)], [m.end() for m in BLANK.finditer(text)]


def _without_tiny(cores: list[tuple[int, int]], most: int, least: int) -> list[tuple[int, int]]:
    """Cores under ``least`` characters put together with the shorter neighbour, where the two fit into one."""
    out: list[tuple[int, int]] = []
    for n, (a, b) in enumerate(cores):
        after = cores[n + 1][1] - b if n + 1 < len(cores) else most
        tiny = b - a < least or out and out[-1][1] - out[-1][0] < least
        if out and tiny and b - out[-1][0] <= most and (out[-1][1] - out[-1][0] <= after or b + after - a > most):
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def pieces(text: str, limit: int, overlap: int = 0, lang: str | None = None, thai: frozenset[str] | None = None) -> list[tuple[int, int]]:
    """[(start, end)] of the pieces, none longer than ``limit``; each begins up to about ``overlap`` before the last end, and
    behind the last beginning. Borders near the edge of a part are taken only where its middle half has none; what is tiny
    then joins a neighbour."""
    if len(text) <= limit:
        return [(0, len(text))]
    overlap = max(0, min(overlap, limit // 2))
    most = limit - overlap
    ranked = cut_places(text, lang, thai)
    blocks, sentences, clauses, blanks = ranked
    cores: list[tuple[int, int]] = []
    todo = [(0, len(text))]
    while todo:
        a, b = todo.pop()
        if b - a <= most:
            cores.append((a, b))
            continue
        middle, quarter = (a + b) / 2, (b - a) // 4
        at = _near(blocks, a + quarter, b - quarter, middle)
        at = at or _near(sentences, a + quarter, b - quarter, middle)
        at = at or _near(blocks, a, b, middle) or _near(sentences, a, b, middle)
        at = at or _near(clauses, a + quarter, b - quarter, middle) or _near(blanks, a + quarter, b - quarter, middle)
        at = at or _near(blanks, a, b, middle) or (a + b) // 2
        todo += [(at, b), (a, at)]
    out: list[tuple[int, int]] = []
    for n, (a, b) in enumerate(_without_tiny(cores, most, max(overlap, most // 4))):
        if n and overlap:
            # a piece never reaches back to where the one before begins
            room = min(limit - (b - a), a - out[-1][0] - 1)
            low, high = max(0, a - min(room, overlap + overlap // 4)), a - overlap + overlap // 4 + 1
            wanted = a - min(overlap, room)
            at = None
            for places in (sentences, blanks):
                at = _near(places, low - 1, high, wanted)
                if at is not None:
                    break
            a = wanted if at is None else at
        out.append((a, b))
    return out


def piece_spans(docs: DataFrame, id_col: str = "document_key", text_col: str = "text", limit_col: str = "chunk_chars", overlap_col: str = "overlap_chars", lang_col: str | None = None, with_text: bool = False) -> DataFrame:
    """(document_key, piece, n_pieces, start_pos, end_pos[, text]) of every text.

    A text within its limit is one piece; so is one whose limit is null or below one. A null overlap counts as none; one
    over half the limit is cut to that. Together the pieces cover every character. Cuts are at block or sentence ends
    where the part to be cut has any, else at clauses, blanks, or in the middle. Null ids and texts give no rows, an
    empty text one empty piece; repeated rows give their pieces again; other columns are ignored. One pass, no shuffle.
    """
    schema = "document_key long, piece int, n_pieces int, start_pos int, end_pos int" + ", text string" * with_text
    names = [x.split()[0] for x in schema.split(", ")]

    thai = thai_starts(docs, text_col)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for key, text, limit, overlap, lang in zip(b.id, b.text, b.limit, b.overlap, b.lang):
                spans = pieces(text, int(limit), int(overlap), lang, thai) if limit == limit and limit >= 1 else [(0, len(text))]
                for n, (s, e) in enumerate(spans):
                    rows.append((key, n, len(spans), s, e, text[s:e])[: len(names)])
            yield pd.DataFrame(rows, columns=names)

    lang = F.col(lang_col).cast("string") if lang_col else F.lit(None).cast("string")
    cols = [F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.col(limit_col).cast("double").alias("limit"), F.coalesce(F.col(overlap_col).cast("double"), F.lit(0.0)).alias("overlap"), lang.alias("lang")]
    return docs.select(*cols).filter("id is not null and text is not null").mapInPandas(scan, schema)


def with_limits(annotated_docs: DataFrame, projects: DataFrame) -> DataFrame:
    """Documents with the limits of their projects; those of unknown projects keep null limits."""
    limits = projects.select("project_id", "chunk_chars", "overlap_chars").filter("project_id is not null").groupBy("project_id").agg(F.min("chunk_chars").alias("chunk_chars"), F.min("overlap_chars").alias("overlap_chars"))
    if is_small(limits):
        limits = F.broadcast(limits)
    return annotated_docs.select("document_key", "text", "lang", "project_id").join(limits, "project_id", "left")


def found(annotated_docs: DataFrame, projects: DataFrame) -> DataFrame:
    """(document_key) of the documents that had to be cut."""
    spans = piece_spans(with_limits(annotated_docs, projects), lang_col="lang")
    return spans.filter("piece = 1").select("document_key").distinct()
