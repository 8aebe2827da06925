"""Problem 8: evaluation texts leaking into training text.

Method: a generalised suffix automaton over the words of the normalised test items. Every training text is streamed
through it; the automaton tracks the longest match that ends at each word. Long matches become anchors on diagonals
(item, place in the text minus place in the item); along each diagonal with enough matched words the passages are taken
with mismatches allowed, so that replaced words don't hide them, and passages on neighbouring diagonals are put together
where words were left out or put in. Every passage of every item counts, so removal leaves no second copy behind.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lookalike import fold

# Scripts without blanks between words, and signs that belong to the letter before them.
BLANKLESS = r"぀-ヿ㐀-鿿豈-﫿\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff"
SIGNS = r"\u0300-\u036f\u064b-\u0652\u0900-\u0963"
HAS_BLANKLESS = re.compile(f"[{BLANKLESS}]")
WORD, MIXED = re.compile(rf"[\w{SIGNS}]+"), re.compile(rf"[{BLANKLESS}]|(?:(?![{BLANKLESS}])[\w{SIGNS}])+")
#: So much of a word is a character of a script without blanks.
CHARACTER = 0.5
#: Words of a match that make an anchor, matched words on a diagonal and those beside it that make a candidate.
SEED, MASS = 4, 9
#: A passage: at least so many words long, so many of them equal; what a replaced word costs while extending.
MIN_WORDS, MIN_MATCHED, MISMATCH = 17, 13, 2
#: A run with so many equal words goes on outwards over single replaced words; it then needs so many words, as chance
#: joins of stock phrases reach 17.
CORE, MIN_EXTENDED = 10, 19
#: Runs of so many words whose diagonals and borders are at most so many words apart are one passage with words left out
#: or put in; it then needs so many words and so many equal ones.
LINK, SHIFT, MIN_LINKED, MIN_LINKED_EQUAL = 8, 2, 22, 19
#: Words of test items that one automaton may hold; beyond it the items are taken in blocks, each over all documents.
BLOCK_WORDS = 500_000
RUN = re.compile(r"[^ ]{%d,}" % SEED)
SCHEMA = "doc_id long, item_id long, start_pos int, end_pos int, words int, matched int"


def _lower(text: str) -> str:
    """Lower case of the same length."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def words_of(text: str) -> tuple[list[str], list[int] | None]:
    """Normalised words (look-alikes folded, marks composed, lower case), and where the folded text's characters stood.

    A character of a script without blanks is a word of its own.
    """
    plain, at = fold(text)
    low = _lower(plain)
    return (MIXED if HAS_BLANKLESS.search(low) else WORD).findall(low), at


def word_spans(text: str) -> list[tuple[int, int]]:
    """Positions in the original text of the words of ``words_of``."""
    plain, at = fold(text)
    low = _lower(plain)
    spans = [m.span() for m in (MIXED if HAS_BLANKLESS.search(low) else WORD).finditer(low)]
    return spans if at is None else [(at[a], at[b - 1] + 1) for a, b in spans]


class Automaton:
    """Generalised suffix automaton over words, each word written as one character, with the places where each state's longest match ends."""

    def __init__(self, items: list[tuple[int, list[str]]]):
        same: dict[tuple[str, ...], list[int]] = {}
        for i, w in items:
            if w:
                same.setdefault(tuple(w), []).append(i)
        #: (ids, words) of each distinct item, and what share of a word its tokens are on average.
        self.items = [(ids, list(w)) for w, ids in same.items()]
        self.units = [1 - (1 - CHARACTER) * sum(len(x) == 1 and HAS_BLANKLESS.match(x) is not None for x in w) / len(w) for _, w in self.items]
        self.ids: dict[str, str] = {}
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[list[tuple[int, int]]] = [[]]
        for n, (_, words) in enumerate(self.items):
            last = 0
            for k, w in enumerate(words):
                last = self._extend(last, self.ids.setdefault(w, chr(0x20000 + len(self.ids))), ends)
                ends[last].append((n, k))
        # a state's ends are those of its subtree in the tree of suffix links
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            if self.link[s] > 0 and self.length[self.link[s]] >= SEED:
                ends[self.link[s]].extend(ends[s])
        self.ends = [tuple(dict.fromkeys(e)) for e in ends]

    def _extend(self, last: int, c: str, ends: list) -> int:
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:
            q = nxt[last][c]
            if length[q] == length[last] + 1:
                return q
            return self._clone(last, q, c, ends)
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        ends.append([])
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, q, c, ends)
        return cur

    def _clone(self, p: int, q: int, c: str, ends: list) -> int:
        nxt, link, length = self.next, self.link, self.length
        new = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        ends.append([])
        link[q] = new
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = new
            p = link[p]
        return new

    def anchors(self, chars: str) -> Iterator[tuple[int, int, int]]:
        """(last place, length, state) of the maximal matches of at least SEED words.

        A word of no test item is a blank in ``chars``; only runs of known words are walked.
        """
        nxt, link, length = self.next, self.link, self.length
        root = nxt[0]
        for run in RUN.finditer(chars):
            s = n = 0
            for k, c in enumerate(run.group(), run.start()):
                here = nxt[s]
                if c in here:
                    s = here[c]
                    n += 1
                    continue
                if n >= SEED:
                    yield k - 1, n, s
                while s and c not in nxt[s]:
                    s = link[s]
                if s:
                    n = length[s] + 1
                    s = nxt[s][c]
                else:
                    s, n = root[c], 1
            if n >= SEED:
                yield run.end() - 1, n, s

    def passages(self, words: list[str]) -> list[tuple[int, int, int, int, int]]:
        """(item_id, first word, end word, words, matched words) of every passage that is long enough; a token counts as
        the share of a word that the item's tokens are on average. Overlapping passages of an item are one, with the
        matched words of the best of them."""
        chars = "".join(map(self.ids.get, words, repeat(" ")))
        mass: dict[tuple[int, int], int] = defaultdict(int)
        for last, n, s in self.anchors(chars):
            # shorter suffixes of the match occur in more places; they count as well
            seen: set[tuple[int, int]] = set()
            m = n
            while s > 0 and m >= SEED:
                for item, k in self.ends[s]:
                    d = (item, last - k)
                    if d not in seen:
                        seen.add(d)
                        mass[d] += m
                s = self.link[s]
                m = min(m, self.length[s])
        runs: dict[int, list[tuple[int, int, int, int, int]]] = defaultdict(list)
        for (item, d), n in mass.items():
            if n + max(mass.get((item, d - 1), 0), mass.get((item, d + 1), 0), mass.get((item, d - 2), 0), mass.get((item, d + 2), 0)) >= MASS / self.units[item]:
                runs[item] += _runs(self.items[item][1], words, d)
        out = []
        for item, found in runs.items():
            for a, b, m in _passages(found, self.units[item], len(self.items[item][1])):
                n = round((b - a) * self.units[item])
                out += [(i, a, b, n, round(m * self.units[item])) for i in self.items[item][0]]
        return out


def _runs(item: list[str], words: list[str], d: int) -> list[tuple[int, int, int, int, int]]:
    """(start, end, matched, least, d) of the runs on one diagonal: equal words score 1, others -MISMATCH, a run ends at
    its best score and the next begins behind it; long ones go on outwards over single other words and then need more."""
    lo, hi = max(0, d), min(len(words), len(item) + d)
    out = []
    k = start = end = lo
    score = matched = best = at_best = 0
    while True:
        if k < hi:
            if words[k] == item[k - d]:
                score += 1
                matched += 1
                k += 1
                if score > best:
                    best, end, at_best = score, k, matched
                continue
            score -= MISMATCH
            k += 1
        if score > 0 and k < hi:
            continue
        if best:
            a, b, m, least = start, end, at_best, MIN_WORDS
            if m >= CORE:
                while a - 2 >= lo and words[a - 2] == item[a - 2 - d]:
                    a, m, least = a - 2, m + 1, MIN_EXTENDED
                    while a > lo and words[a - 1] == item[a - 1 - d]:
                        a, m = a - 1, m + 1
                while b + 1 < hi and words[b + 1] == item[b + 1 - d]:
                    b, m, least = b + 2, m + 1, MIN_EXTENDED
                    while b < hi and words[b] == item[b - d]:
                        b, m = b + 1, m + 1
            if m >= SEED:
                out.append((a, b, m, least, d))
            k = max(end, b)
        if k >= hi:
            return out
        start = end = k
        score = matched = best = at_best = 0


def _passages(runs: list[tuple[int, int, int, int, int]], unit: float, size: int) -> list[tuple[int, int, int]]:
    """(start, end, matched): runs that are long enough, alone or with those they continue, or hold the whole of a shorter
    item word for word; overlapping ones are one."""
    good = [(a, b, m) for a, b, m, least, _ in runs if (b - a) * unit >= least and m * unit >= MIN_MATCHED or m == size and size * unit >= MIN_MATCHED]
    chain: tuple[int, int, int, int] | None = None  # start, end, matched, diagonal
    for a, b, m, _, d in sorted(x for x in runs if x[2] * unit >= LINK):
        if chain and d != chain[3] and abs(d - chain[3]) <= SHIFT / unit and -SHIFT / unit <= a - chain[1] <= SHIFT / unit and b > chain[1]:
            chain = (chain[0], b, chain[2] + m - max(0, chain[1] - a), d)
            if (b - chain[0]) * unit >= MIN_LINKED and chain[2] * unit >= MIN_LINKED_EQUAL:
                good.append(chain[:3])
        elif not chain or b > chain[1]:
            chain = (a, b, m, d)
    out: list[tuple[int, int, int]] = []
    for a, b, m in sorted(good):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]), max(m, out[-1][2]))
        else:
            out.append((a, b, m))
    return out


def _blocks(items: DataFrame, item_id: str, item_text: str) -> list[list[tuple[int, list[str]]]]:
    """The normalised items in blocks of about BLOCK_WORDS words: the stated query set, which the driver reads."""
    blocks: list[list[tuple[int, list[str]]]] = [[]]
    held = 0
    for r in items.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).alias("t")).dropna().dropDuplicates().orderBy("i", "t").toLocalIterator():
        words, _ = words_of(r.t)
        if held and held + len(words) > BLOCK_WORDS:
            blocks.append([])
            held = 0
        blocks[-1].append((r.i, words))
        held += len(words)
    return blocks


def _hits(automaton: Automaton, text: str) -> list[tuple[int, int, int, int, int]]:
    """(item_id, start_pos, end_pos, words, matched) of one text."""
    words, _ = words_of(text)
    if len(words) < MIN_MATCHED or not (found := automaton.passages(words)):
        return []
    spans = word_spans(text)
    return sorted((i, spans[a][0], spans[b - 1][1], n, m) for i, a, b, n, m in found)


def leaked_spans(documents: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, start_pos, end_pos, words, matched): every passage of every item in every document.

    A passage has at least 17 words and 13 equal words, 19 words if it is only reached beyond a replaced word near its
    border, 22 and 19 if words were left out or put in; an item of 13 to 16 words counts whole. Two characters of a script without blanks count as a word. Case,
    punctuation, blanks and look-alike characters don't count. Null ids or texts, empty texts and empty tables give no
    rows; a repeated row gives its rows again; other columns are ignored.

    The items are the stated query set. They are read to the driver in blocks of BLOCK_WORDS words, which bounds what is
    broadcast; documents are scanned once per block, with no shuffle. A text is one row, streamed in linear time.
    """
    sc = documents.sparkSession.sparkContext
    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).dropna()
    out = None
    for block in _blocks(items, item_id, item_text):
        shared = sc.broadcast(Automaton(block))

        def scan(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for b in batches:
                got = [(doc, *hit) for doc, text in zip(b.doc_id, b.text) for hit in _hits(shared.value, text)]
                yield pd.DataFrame(got, columns=["doc_id", "item_id", "start_pos", "end_pos", "words", "matched"])

        part = rows.mapInPandas(scan, SCHEMA)
        out = part if out is None else out.unionByName(part)
    return out


def found(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id) of the leaks; of a repeated document each pair once."""
    return leaked_spans(documents, items).select("doc_id", "item_id").distinct()


def cut_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without what the spans cover."""
    out, at = [], 0
    for a, b in sorted(spans):
        out.append(text[at : max(a, at)])
        at = max(at, b)
    return "".join([*out, text[at:]])


def without_leaks(documents: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_share: float = 0.5) -> DataFrame:
    """(doc_id, text, removed_chars, dropped): every document without its leaked passages, whichever item they are from.

    Where they cover more than ``max_share`` of a text, it comes out null and ``dropped`` true. A document without leaks
    keeps its text, a null text stays null; rows with a null id are left out, repeated rows come out again. The passages
    are cut where they are found, in the same pass: no text is shuffled. Several blocks of items pass the spans on.
    """
    sc = documents.sparkSession.sparkContext
    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.array().cast("array<int>").alias("spans")).filter("doc_id is not null")
    for block in _blocks(items, "item_id", "text"):
        shared = sc.broadcast(Automaton(block))

        def scan(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for b in batches:
                spans = [[*had, *(x for hit in (_hits(shared.value, text) if text else ()) for x in hit[1:3])] for text, had in zip(b.text, b.spans)]
                yield pd.DataFrame({"doc_id": b.doc_id, "text": b.text, "spans": spans})

        rows = rows.mapInPandas(scan, "doc_id long, text string, spans array<int>")

    def clean(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for doc, text, flat in zip(b.doc_id, b.text, b.spans):
                rest = cut_spans(text, list(zip(flat[::2], flat[1::2]))) if text and len(flat) else text
                gone = len(text) - len(rest) if text else 0
                dropped = bool(text) and gone > max_share * len(text)
                out.append((doc, None if dropped else rest, gone, dropped))
            yield pd.DataFrame(out, columns=["doc_id", "text", "removed_chars", "dropped"])

    return rows.mapInPandas(clean, "doc_id long, text string, removed_chars int, dropped boolean")
