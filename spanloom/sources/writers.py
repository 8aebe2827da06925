"""JSON lines and HTML."""

from __future__ import annotations

import html
import os
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import numbered

# Colours of classes, in turn.
PALETTE = ("#ffd54f", "#80deea", "#a5d6a7", "#ef9a9a", "#ce93d8", "#ffcc80", "#90caf9", "#e6ee9c", "#f48fb1", "#bcaaa4")


def write_jsonl(annotated: DataFrame, path: str) -> None:
    """One JSON document per line; nulls are written, so that a reader sees every key."""
    annotated.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def to_html(text: str, spans: list[tuple[int, int, str, str]], title: str = "") -> str:
    """A page of the text with its innermost spans marked; a span is (start, end, class, tooltip).

    Each stretch between two span boundaries shows the shortest span over it.
    """
    inside = sorted({(max(0, s), min(len(text), e), c, t) for s, e, c, t in spans if 0 <= s < e and s < len(text)}, key=lambda x: (x[1] - x[0], -x[0], x[2]))
    edges = sorted({0, len(text), *(x[0] for x in inside), *(x[1] for x in inside)})
    place = {p: k for k, p in enumerate(edges)}
    owner: list = [None] * len(edges)
    free = list(range(1, len(edges) + 1))  # free[k]: the next stretch from k on that has no owner yet

    def next_free(k: int) -> int:
        root = k
        while root < len(owner) and owner[root] is not None:
            root = free[root]
        while k < root:
            free[k], k = root, free[k]
        return root

    for x in inside:
        k = next_free(place[x[0]])
        while k < place[x[1]]:
            owner[k] = x
            k = next_free(k + 1)
    colours = {c: PALETTE[n % len(PALETTE)] for n, c in enumerate(sorted({x[2] for x in inside}))}
    out = []
    for k, (a, b) in enumerate(zip(edges, edges[1:])):
        body = html.escape(text[a:b])
        x = owner[k]
        out.append(body if x is None else f'<mark style="background:{colours[x[2]]}" title="{html.escape(x[3])}">{body}</mark>')
    legend = " ".join(f'<span style="background:{v}">{html.escape(c)}</span>' for c, v in colours.items())
    return f'<!doctype html><meta charset="utf-8"><title>{html.escape(title)}</title><p>{legend}</p><pre style="white-space:pre-wrap">{"".join(out)}</pre>'


def tooltip(x: dict) -> str:
    """Class, confidence, attributes, scores, normalised value and the need of a review, at most 120 characters."""
    parts = [x["c"]] + ([f"{x['p']:.2f}"] if x["p"] is not None else [])
    parts += [f"{k}: {v}" for k, v in (x["a"] or {}).items() if v is not None]
    parts += [f"{k} {v:.2f}" for k, v in (x["v"] or {}).items() if v is not None]
    parts += ([f"= {x['n']}"] if x["n"] is not None else []) + (["review"] if x["r"] else [])
    told = " · ".join(parts)
    return told if len(told) <= 120 else told[:117] + "…"


def html_pages(annotated: DataFrame) -> DataFrame:
    """(document_id, html) of each document; sentence labels aren't marked, field values are."""

    def render(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            pages = []
            for key, text, found in zip(b.document_id, b.text, b.x):
                spans = [(x["s"], x["e"], x["c"], tooltip(x)) for x in (found if found is not None else ()) if x["s"] is not None]
                pages.append(to_html(text or "", spans, key or ""))
            yield pd.DataFrame({"document_id": b.document_id, "html": pages})

    row = F.transform(F.filter("extractions", lambda x: x["kind"] != "sentence"), lambda x: F.struct(x["char_interval"]["start_pos"].alias("s"), x["char_interval"]["end_pos"].alias("e"), x["extraction_class"].alias("c"), x["confidence"].alias("p"), x["attributes"].alias("a"), x["scores"].alias("v"), x["normalized"].alias("n"), x["needs_review"].alias("r")))
    return annotated.select("document_id", "text", row.alias("x")).mapInPandas(render, "document_id string, html string")


def page_name(number: int, document_id: str | None) -> str:
    """NNNN_id.html with what file names don't like replaced, at most 80 characters of the id."""
    return f"{number:04d}_{re.sub(r'[^A-Za-z0-9._-]+', '_', document_id or 'document')[:80]}.html"


def write_html(annotated: DataFrame, path: str) -> None:
    """The pages as JSON lines of (document_id, html) in a folder that all executors can write."""
    html_pages(annotated).write.mode("overwrite").json(path)


def write_html_files(annotated: DataFrame, folder: str) -> None:
    """One file per document, numbered from 1 as the rows come, in a folder that is mounted on every executor."""

    def save(rows) -> None:
        os.makedirs(folder, exist_ok=True)
        for r in rows:
            with open(os.path.join(folder, page_name(r.number, r.document_id)), "w", encoding="utf-8") as f:
                f.write(r.html)

    numbered(html_pages(annotated)).foreachPartition(save)
