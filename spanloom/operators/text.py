"""Documents, lines, sentences, windows, contexts, chunks."""

from __future__ import annotations

import json
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from ..config import Options, Schema
from ..functions import segment, spans
from ..schemas import CANDIDATES, SCAN

LINE_FEED = segment.regex.compile("\n")
#: A regular expression class for every character that counts as a blank.
BLANK = r"[\s\x1c-\x1f\x85\p{Z}]"


def documents(df: DataFrame, id_col: str | None = "document_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text): the id as text, or the row's ordinal where there is none; invalid characters become U+FFFD."""
    ordinal = F.monotonically_increasing_id().cast("string")
    key = F.coalesce(F.col(id_col).cast("string"), ordinal) if id_col and id_col in df.columns else ordinal
    return df.select(key.alias("doc_id"), F.make_valid_utf8(F.col(text_col)).alias("text"))


def not_blank(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows whose text has a character other than blanks."""
    return df.filter(F.col(text_col).rlike(r"[^\s\x1c-\x1f\x85\p{Z}]"))


def stripped(s: Column) -> Column:
    """Without outer blanks of any kind."""
    return F.regexp_replace(s, rf"^{BLANK}+|{BLANK}+\z", "")


def piece(text: Column, s: Column, e: Column) -> Column:
    """text[s:e] by code points, from 0, half-open."""
    return F.substring(text, s + 1, e - s)


def lines_with_offsets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, line, start_pos, end_pos, text) of every line, split on the line feed only; one pass, linear in the text."""

    def lines(key, text: str) -> Iterator[tuple]:
        at = 0
        for n, line in enumerate(text.split("\n")):
            yield key, n, at, at + len(line), line
            at += len(line) + 1

    return _each(df, id_col, text_col, lines, "line int, start_pos int, end_pos int, text string")


def _each(df: DataFrame, id_col: str, text_col: str, rows_of, columns: str) -> DataFrame:
    """(doc_id, columns..): the rows that a function of (id, text) gives for each text that is not null, in one pass."""
    names = ["doc_id", *(c.split()[0] for c in columns.split(", "))]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([r for key, text in zip(b.doc_id, b.text) for r in rows_of(key, text)], columns=names)

    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).filter("text is not null")
    return rows.mapInPandas(scan, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {columns}")


#: What a pass over the texts gives on at once: the rows of about so many characters of text, or so many small rows. A
#: text has hundreds of candidates, so the rows of all texts that Spark sends at once (10,000) don't fit a worker's memory.
PORTION_CHARS, PORTION_ROWS = 1 << 16, 1 << 14


def _portions(rows: Iterable[tuple[int, dict]], most: int) -> Iterator[list[dict]]:
    """Rows, each with its size, in lists of ``most`` in all, or of one row that is larger."""
    out, size = [], 0
    for n, row in rows:
        if out and size + n > most:
            yield out
            out, size = [], 0
        out.append(row)
        size += n
    if out:
        yield out


def _in_portions(docs: DataFrame, rows_of: Callable[[str, str], Iterable[tuple[int, dict]]], most: int, columns: str) -> DataFrame:
    """The rows that a function of (id, text) gives, each with its size, for each text that is not null. One Arrow pass; no
    more than a portion of the rows is in memory at once."""
    kind = to_arrow_schema(StructType.fromDDL(columns))

    def portions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sized = (row for b in batches for key, text in zip(*b.columns) for row in rows_of(key.as_py(), text.as_py()))
        for rows in _portions(sized, most):
            yield pa.RecordBatch.from_pylist(rows, schema=kind)

    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").filter("text is not null").mapInArrow(portions, columns)


def _candidates_of(schema: Schema, options: Options) -> Callable[[str, list, list], tuple[dict[int, list[tuple]], list[tuple[str, str]]]]:
    """A function of a text, its sentences and their tokens: ({sentence: its candidates}, [(generator, error)]). There are
    none where nothing in the schema takes them."""
    stop = spans.STOPWORDS[options.stopwords] if isinstance(options.stopwords, str) else frozenset(w.lower() for w in options.stopwords)
    classes = [(e.id, list(e.patterns), [*e.terms, *e.examples]) for e in schema.entities]
    wanted = bool(schema.entities) or any("any" in f.source for f in schema.fields)

    def candidates_of(text: str, sents: list, toks: list) -> tuple[dict[int, list[tuple]], list[tuple[str, str]]]:
        if not wanted:
            return {}, []
        got, errors = spans.candidates(text, sents, toks, classes, stop, options.max_ngram, options.span_source != "tags", options.ngrams, options.candidate_generators)
        merged: dict[tuple[int, int, int], list] = {}
        for n, s, e, source, p in got:
            row = merged.setdefault((n, s, e), [set(), p])
            row[0].add(source)
            row[1] = min(row[1], p)
        by: dict[int, list[tuple]] = {}
        for (n, s, e), (sources, p) in merged.items():
            by.setdefault(n, []).append((p, s, e, sorted(sources)))
        for n, rows in by.items():
            most = options.max_candidates_per_sentence * (3 if any(spans.is_cjk(text[a:b]) for a, b in toks[n]) else 1)
            by[n] = sorted((s, e, sources, p) for p, s, e, sources in sorted(rows)[:most])
        return by, errors

    return candidates_of


def _refs(first: int, last: int) -> dict[int, str]:
    """How the sentences of a window are called in its state."""
    return {n: "`text`" if first == last else f"`text.S{n - first + 1}`" for n in range(first, last + 1)}


def scan(docs: DataFrame, schema: Schema, options: Options = Options()) -> DataFrame:
    """One Arrow pass over (doc_id, text): sentences, windows with their state, their sentences and ranked candidates.

    Candidates with the same span are one, with all their sources and the best priority; each sentence keeps the best
    by (priority, start, end), three times as many where it holds CJK characters. A failing custom generator is an
    error row, not a failed document.
    """
    candidates_of = _candidates_of(schema, options)
    about: dict[str, object] = {}
    if schema.description:
        about["document_type"] = schema.description
    if schema.instructions:
        about["guidelines"] = schema.instructions
    if schema.entities:
        about["entity_types"] = {e.id: e.definition() for e in schema.entities}
    tagging = options.span_source in ("tags", "hybrid")

    def page(key: str, text: str) -> Iterator[tuple[int, dict]]:
        sents = segment.sentences(text, options.max_sentence_chars)
        toks = segment.tokens_of(segment.tokens(text), sents)
        cands, errors = candidates_of(text, sents, toks)
        wins = []
        for w, (first, last) in enumerate(segment.windows(sents, options.window_chars, options.window_sentences)):
            s, e = sents[first][0], sents[last][1]
            own = {f"S{k - first + 1}": text[a:b] for k, (a, b) in enumerate(sents[first : last + 1], first)}
            before, after = segment.context_before(text, s, options.context_chars), segment.context_after(text, e, options.context_chars)
            state = about | ({"preceding_text": before} if before else {}) | {"text": text[s:e] if first == last else own} | ({"following_text": after} if after else {})
            refs = _refs(first, last)
            wins.append({
                "window": w, "first": first, "last": last, "s": s, "e": e, "state": json.dumps(state, ensure_ascii=False),
                "sentences": [{"sentence": n, "s": sents[n][0], "e": sents[n][1], "text": text[sents[n][0] : sents[n][1]], "ref": refs[n], "tokens": [{"s": a, "e": b} for a, b in toks[n]] if tagging else []} for n in refs],
                "candidates": [candidate(text, n, refs[n], sents[n], *c) for n in refs for c in cands.get(n, ())],
            })
        found = {"sentences": [{"s": a, "e": b} for a, b in sents], "windows": wins, "errors": [{"stage": "candidates", "where": f"generator:{g}", "error": e} for g, e in errors]}
        yield len(text), {"doc_id": key, "text": text} | found

    return _in_portions(docs, page, PORTION_CHARS, SCAN)


def candidate_spans(docs: DataFrame, schema: Schema, options: Options = Options()) -> DataFrame:
    """(doc_id, window and a candidate's columns) of (doc_id, text): the candidates of ``scan``, a row each, in one pass
    that makes no states and puts no document's candidates together."""
    candidates_of = _candidates_of(schema, options)

    def rows(key: str, text: str) -> Iterator[tuple[int, dict]]:
        sents = segment.sentences(text, options.max_sentence_chars)
        cands, _ = candidates_of(text, sents, segment.tokens_of(segment.tokens(text), sents))
        for w, (first, last) in enumerate(segment.windows(sents, options.window_chars, options.window_sentences)):
            for n, ref in _refs(first, last).items():
                for c in cands.get(n, ()):
                    yield 1, {"doc_id": key, "window": w} | candidate(text, n, ref, sents[n], *c)

    return _in_portions(docs, rows, PORTION_ROWS, CANDIDATES)


ORDINALS = "first second third fourth fifth sixth seventh eighth ninth tenth".split()


def candidate(text: str, sentence: int, ref: str, span: tuple[int, int], s: int, e: int, sources: list[str], priority: int) -> dict:
    """A candidate row; where its words stand several times in the sentence, which of them it is and what surrounds it."""
    part = text[s:e]
    occurrence = context = None
    if text.count(part, *span) > 1 and len(places := sorted({s, *spans.occurrences(text, part, *span)})) > 1:
        k = places.index(s)
        occurrence = f"the {ORDINALS[k] if k < len(ORDINALS) else f'#{k + 1}'} of {len(places)} occurrences in {ref}"
        context = segment.snippet(text, s, e, 25)
    return {"sentence": sentence, "s": s, "e": e, "text": part, "sources": sources, "priority": priority, "ref": ref, "occurrence": occurrence, "context": context}


def window_rows(scanned: DataFrame) -> DataFrame:
    """(doc_id, window, first, last, s, e, state, sentences, candidates) of every window."""
    return scanned.select("doc_id", F.explode("windows").alias("w")).select("doc_id", "w.*")


def candidate_rows(scanned: DataFrame) -> DataFrame:
    """(doc_id, window, state and a candidate's columns): the state comes along from the window, without a join."""
    return window_rows(scanned).select("doc_id", "window", "state", F.explode("candidates").alias("c")).select("doc_id", "window", "state", "c.*")


def windows_with_context(df: DataFrame, chars: int = 250, most_chars: int = 800, most_sentences: int = 8, most_sentence_chars: int = 600, lines: bool = False) -> DataFrame:
    """(doc_id, window, first, last, s, e, before, after): sentences (or lines that are not blank) packed into windows, with
    the text around them; one pass over (doc_id, text), linear in it."""

    def rows(key, text: str) -> Iterator[tuple]:
        if lines:
            at, units = 0, []
            for line in text.split("\n"):
                if line.strip():
                    units.append((at, at + len(line)))
                at += len(line) + 1
        else:
            units = segment.sentences(text, most_sentence_chars)
        for w, (first, last) in enumerate(segment.windows(units, most_chars, most_sentences)):
            s, e = units[first][0], units[last][1]
            yield key, w, first, last, s, e, segment.context_before(text, s, chars), segment.context_after(text, e, chars)

    return _each(df, "doc_id", "text", rows, "window int, first int, last int, s int, e int, before string, after string")


def windows(sentences: Column, most_chars: int = 800, most_sentences: int = 8) -> Column:
    """array<struct<first,last,s,e>>: sentences packed in order while the window stays within both limits.

    The first sentence of a window always fits; linear in the sentences.
    """
    kind = ArrayType(StructType([StructField(c, IntegerType()) for c in ("first", "last", "s", "e")]))

    @F.pandas_udf(kind)
    def pack(rows: pd.Series) -> pd.Series:
        out = []
        for x in rows:
            sents = [(y["s"], y["e"]) for y in x] if x is not None else []
            out.append([{"first": a, "last": b, "s": sents[a][0], "e": sents[b][1]} for a, b in segment.windows(sents, most_chars, most_sentences)])
        return pd.Series(out)

    return pack(sentences)


def context_before(text: Column, start: Column, chars: int) -> Column:
    """Up to so many characters before a place, whole words only, without outer blanks."""
    if chars <= 0:
        return F.lit("")
    low = F.greatest(start - chars, F.lit(0))
    raw = piece(text, low, start)
    cut_word = (low > 0) & ~F.substring(text, low, F.lit(1)).rlike(BLANK)
    return stripped(F.when(cut_word, F.regexp_replace(raw, rf"^[^\s\x1c-\x1f\x85\p{{Z}}]*(?:{BLANK}|\z)", "")).otherwise(raw))


def context_after(text: Column, end: Column, chars: int) -> Column:
    """Up to so many characters after a place, whole words only, without outer blanks."""
    if chars <= 0:
        return F.lit("")
    high = F.least(end + chars, F.length(text))
    raw = piece(text, end, high)
    cut_word = (high < F.length(text)) & ~F.substring(text, high + 1, F.lit(1)).rlike(BLANK)
    return stripped(F.when(cut_word, F.regexp_replace(raw, rf"(?:^|{BLANK})[^\s\x1c-\x1f\x85\p{{Z}}]*\z", "")).otherwise(raw))


def snippet(text: Column, s: Column, e: Column, width: int = 40) -> Column:
    """A span with its surroundings, blanks in one form, an ellipsis where text was left out."""
    low, high = F.greatest(s - width, F.lit(0)), F.least(e + width, F.length(text))
    body = stripped(F.regexp_replace(piece(text, low, high), rf"{BLANK}+", " "))
    return F.concat(F.when(low > 0, "…").otherwise(""), body, F.when(high < F.length(text), "…").otherwise(""))


def ordinal_word(k: Column) -> Column:
    """first to tenth, then #11 and so on."""
    words = F.array(*map(F.lit, "first second third fourth fifth sixth seventh eighth ninth tenth".split()))
    return F.coalesce(F.try_element_at(words, k.cast("int")), F.concat(F.lit("#"), k.cast("string")))


def token_estimate(s: Column) -> Column:
    """About three bytes of UTF-8 to a token, and one."""
    return F.floor(F.octet_length(s) / 3) + 1


def sentence_spans(df: DataFrame, most_chars: int = 600) -> DataFrame:
    """(doc_id, sentence, s, e) of the sentences of every text; one pass."""
    return _each(df, "doc_id", "text", lambda key, text: ((key, n, s, e) for n, (s, e) in enumerate(segment.sentences(text, most_chars))), "sentence int, s int, e int")


def pattern_spans(df: DataFrame, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start_pos, end_pos, value) of every match of one pattern; one pass, linear in the text."""
    find = segment.regex.compile(pattern).finditer
    return _each(df, id_col, text_col, lambda key, text: ((key, *m.span(), m.group()) for m in find(text)), "start_pos int, end_pos int, value string")


def uncovered_spans(df: DataFrame, weak: str, strong: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start_pos, end_pos, value) of the matches of a weak pattern that don't lie inside the union of the matches of
    stronger ones, or are exactly one of them. Both are sorted within the text's own row, so nothing is shuffled."""
    find, over = segment.regex.compile(weak).finditer, [segment.regex.compile(p).finditer for p in strong]

    def rows(key, text: str) -> Iterator[tuple]:
        own = [m.span() for m in find(text)]
        hidden = spans.inside(set(own), [m.span() for f in over for m in f(text)])
        yield from ((key, a, b, text[a:b]) for a, b in own if (a, b) not in hidden)

    return _each(df, id_col, text_col, rows, "start_pos int, end_pos int, value string")


def spans_in_lines(df: DataFrame, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start_pos, end_pos, value, sentence) of every match with the line that holds it; a match over a line end is
    left out. Lines are disjoint and in order, so each match finds its own by bisection in the same pass."""
    find = segment.regex.compile(pattern).finditer

    def rows(key, text: str) -> Iterator[tuple]:
        starts = [0, *(m.end() for m in LINE_FEED.finditer(text))]
        for m in find(text):
            n = bisect_right(starts, m.start()) - 1
            if n + 1 == len(starts) or m.end() < starts[n + 1]:
                yield key, *m.span(), m.group(), n

    return _each(df, id_col, text_col, rows, "start_pos int, end_pos int, value string, sentence int")


def typed_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", kinds: list[str] | None = None) -> DataFrame:
    """(doc_id, kind, start_pos, end_pos, value) of the typed values of every text, weak ones inside stronger dropped."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(key, k, s, e, text[s:e]) for key, text in zip(b.doc_id, b.text) for s, e, k in spans.typed_spans(text, kinds)]
            yield pd.DataFrame(rows, columns=["doc_id", "kind", "start_pos", "end_pos", "value"])

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).filter("text is not null")
    return rows.mapInPandas(find, "doc_id long, kind string, start_pos int, end_pos int, value string")


def regex_spans(df: DataFrame, patterns: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, s, e, text) of the distinct matches of Python patterns: group 1 where it took part, else the match."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for key, text in zip(b.doc_id, b.text):
                found = {x for p in patterns for x in spans.matches(spans.compiled(p), text)}
                rows += [(key, s, e, text[s:e]) for s, e in sorted(found)]
            yield pd.DataFrame(rows, columns=["doc_id", "s", "e", "text"])

    rows = df.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text")).filter("text is not null")
    return rows.mapInPandas(find, "doc_id string, s int, e int, text string")
