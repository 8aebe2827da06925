"""Problem 9: keyword-stuffed and link-list pages.

Method: bagged decision trees on content and link features of the page, trained on weak labels, and page predictions
smoothed by the spam rate of the page's host (``source``).

The weak labels come from rules that read the page line by line (``spam_share``: what share of it are links, tags, soup,
stuffed sentences). The trees never see that share nor its parts: their features are counts over the whole page
(repetition near and far, variety of words, marks, separators, links, tags, lists). So the forest is free to disagree
with the rules, and settles the pages on which they are unsure.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut

FEATURES = (
    "log_words diversity top_word top_words link_lines links hashes closed ends separators prices words_per_line distinct_lines short_words link_hosts "
    "near far markers hash_chars url_chars cells"
).split()
#: Pages that the rules label and the trees learn from, about; taken by a hash of the id. Twice as many at most.
SAMPLE_ROWS = 30_000
#: Weak labels: pages with more (less) than this share of spam units; pages in between stay unlabelled.
SURE_SPAM, SURE_HAM = 0.6, 0.4
TREES, DEPTH, LEAF = 40, 10, 2
#: Each tree sees as many spam pages as there are and so many times as many others, both drawn with replacement.
OTHERS = 8
#: Which weights the host's log odds may get; the one that fits the pages kept back from training best is taken.
HOST_WEIGHTS = (0.25, 0.5, 1.0)
#: Every so many-th labelled page is kept back for that choice.
HELD_OUT = 4
#: A host counts as if it had so many more pages of the average rate.
PRIOR_PAGES = 5.0

LINK = re.compile(r"https?://|www\.\w|\]\(")
MARKER = re.compile(r"\s*(?:[-•*–]|\(?\w{1,3}[.)])\s")
SENTENCE_END = re.compile(r"(?<=[.!?…])[\"'”’»)\]]*\s+|(?<=[。！？؟।])[」』”’]*")
CLOSED = re.compile(r"[.!?…。！？؟।:;；][\"'”’»)\]」』]*$")
PRICE = re.compile(r"[$€£¥]\s?\d+\b(?![,.]?\d{3})|\bSKU\W?\d")
LETTERS = re.compile(r"[^\W\d_]+")
SEPARATORS = re.compile(r"\s*(?:[,|;·•>/\n、，]|\s[-–+&]\s)\s*")
CJK = re.compile(r"[぀-ヿ㐀-鿿]{4,}")


def _few_words(words: list[str]) -> bool:
    """So few distinct words as only keyword soup has: it draws from a bounded list, so the bound levels off."""
    n = len(words)
    return n >= 10 and len(set(words)) < 0.42 * n / (1 + n / 300)


def _stuffed(unit: str, words: list[str]) -> bool:
    """A closed sentence that holds a keyword (a long word or a pair of words) three times."""
    if len(words) >= 6:
        low = [w for w in words if len(w) >= 3]
        if len(low) - len(set(low)) >= 2:
            pairs = Counter(zip(low, low[1:]))
            if any(n >= 3 and len(a) + len(b) >= 8 for (a, b), n in pairs.items()):
                return True
            if any(n >= 3 and len(w) >= 5 and n * 8 >= len(words) for w, n in Counter(low).items()):
                return True
    if not unit.isascii():
        for run in CJK.findall(unit):
            if len(run) >= 12:
                grams = Counter(run[i : i + 4] for i in range(len(run) - 3))
                if max(grams.values()) >= 3:
                    return True
    return False


def _block_is_spam(block: list[str]) -> bool:
    """Lines that no full stop closes: keyword soup, or many short parts that come again and again."""
    joined = "\n".join(block).lower()
    words = LETTERS.findall(joined)
    if _few_words(words):
        return True
    parts = [x for x in SEPARATORS.split(joined) if x and not x.isdigit()]
    if len(parts) >= 6 and len(words) <= 4.5 * len(parts) and "@" not in joined:
        repeated = 1 - len(set(parts)) / len(parts)
        if repeated >= 0.3 or len(set(words)) < 0.55 * len(words):
            return True
    if not joined.isascii() and (runs := CJK.findall(joined)):
        grams = Counter(r[i : i + 4] for r in runs for i in range(len(r) - 3))
        return sum(grams.values()) >= 30 and len(grams) / sum(grams.values()) < 0.5
    return False


def spam_share(text: str) -> float:
    """The share of one text, blanks aside, that the rules take for links, tags, soup or stuffed sentences."""
    size: Counter = Counter()
    block: list[str] = []
    weight_of = lambda t: len(t) - t.count(" ")

    def close_block() -> None:
        if block:
            size["block" if _block_is_spam(block) else "clean"] += sum(map(weight_of, block))
            block.clear()

    listing = False
    for line in text.split("\n"):
        line = line.strip()
        if not line:
            close_block()
            listing = False
            continue
        if LINK.search(line):
            close_block()
            size["list" if listing and line.startswith("http") else "link"] += weight_of(line)
            continue
        words = LETTERS.findall(line.lower())
        if line.count("#") >= 3 and line.count("#") * 2 >= len(line.split()):
            close_block()
            size["tag"] += weight_of(line)
            continue
        listing = line.endswith(":")
        if len(words) <= 14 and MARKER.match(line) or ("\t" in line or " | " in line) and line.count("|") <= 3 and any(map(str.isdigit, line)):
            close_block()
            size["list"] += weight_of(line)
            continue
        units = SENTENCE_END.split(line)
        if len(words) >= 20 and (len(PRICE.findall(line)) >= 5 or _few_words(words) and (len(units) < 3 or _few_words(LETTERS.findall(" ".join(dict.fromkeys(units)).lower())))):
            close_block()
            size["stuffed"] += weight_of(line)
            continue
        # a stuffed sentence holds a word of four letters three times, and so does its line
        hot = max((n for w, n in Counter(words).items() if len(w) >= 4), default=0) >= 3
        for k, unit in enumerate(units):
            if not unit:
                continue
            if k == len(units) - 1 and not CLOSED.search(unit):
                block.append(unit)
                continue
            close_block()
            stuffed = (hot or not unit.isascii()) and _stuffed(unit, LETTERS.findall(unit.lower()) if hot else [])
            size["stuffed" if stuffed else "clean"] += weight_of(unit)
    close_block()
    total = sum(size.values()) or 1
    return (size["link"] + size["tag"] + size["block"] + size["stuffed"]) / total


HAN = re.compile(r"[぀-ヿ㐀-鿿]")
SIGNS = r"\u0300-\u036f\u064b-\u0652\u0900-\u0963\u0e31-\u0e4e"
WORD, WORD_OR_HAN = re.compile(rf"[\w{SIGNS}]+"), re.compile(rf"[぀-ヿ㐀-鿿]|(?:(?![぀-ヿ㐀-鿿])[\w{SIGNS}])+")
HOST = re.compile(r"(?:https?://|www\.)([\w.-]+)")
URL = re.compile(r"(?:https?://|www\.)\S+")
HASHTAG = re.compile(r"#\w+")
LISTED = re.compile(r"(?m)^[ \t]*(?:[-•*–]|\(?\w{1,3}[.)])\s.*$")
MARKS = re.compile(r"[.!?…。！？؟।]")
DIVIDERS = re.compile(r"[,|;·•>/、，&+*]")
MONEY = re.compile(r"[$€£¥]\s?[0-9]")


def _returns(items: list, near: int, far: int) -> tuple[float, float]:
    """The shares of the items that stood there already at most ``near`` and at most ``far`` places before."""
    last: dict = {}
    a = b = 0
    for i, x in enumerate(items):
        back = i - last.get(x, -far - 1)
        if back <= far:
            b += 1
            if back <= near:
                a += 1
        last[x] = i
    n = max(1, len(items))
    return a / n, b / n


def page_features(text: str) -> list[float]:
    """The FEATURES of one text, counted over the whole page."""
    words = (WORD_OR_HAN if HAN.search(text) else WORD).findall(text.lower())
    n, m = len(words), max(1, len(words))
    counts = Counter(words)
    lines = [x for x in map(str.strip, text.split("\n")) if x]
    chars = sum(map(len, lines)) or 1
    linked = "http" in text or "www." in text
    hosts, urls = (HOST.findall(text), URL.findall(text)) if linked else ([], [])
    top = counts.most_common(8)
    return [
        math.log1p(n), math.log(len(counts)) / math.log(n) if n > 1 else 1.0, max((k for w, k in top if len(w) >= 4), default=0) / m, sum(k for _, k in top) / m,
        sum(len(x) for x in lines if "http" in x or "www." in x) / chars if linked else 0.0, len(hosts) / m, text.count("#") / m, sum(len(x) for x in lines if CLOSED.search(x)) / chars, len(MARKS.findall(text)) / m, len(DIVIDERS.findall(text)) / m, len(MONEY.findall(text)) / m,
        m / max(1, len(lines)), len(set(lines)) / max(1, len(lines)), sum(k for w, k in counts.items() if len(w) <= 3) / m, len(set(hosts)) / max(1, len(hosts)),
        *_returns([w for w in words if len(w) >= 4], 8, 30),
        sum(map(len, LISTED.findall(text))) / chars, sum(map(len, HASHTAG.findall(text))) / chars, sum(map(len, urls)) / chars, (text.count("|") + text.count("\t")) / m,
    ]


def features(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", label_share: float = 1.0) -> DataFrame:
    """(doc_id, host, x array<double>, sample, label) for every row with an id; a null text counts as empty, a null host as ''.

    The rules label the pages whose id's hash falls in ``label_share`` of its range: 1 spam, 0 none; the label is null for
    other pages and where the rules are unsure.
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            share = [spam_share(t) if on else math.nan for t, on in zip(b.text, b["sample"])]
            label = [1.0 if x > SURE_SPAM else 0.0 if x < SURE_HAM else None for x in share]
            yield pd.DataFrame({"doc_id": b.doc_id, "host": b.host, "x": [page_features(t) for t in b.text], "sample": b["sample"], "label": label})

    key, host = F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host")
    rows = documents.select(key, host, F.coalesce(F.col(text_col), F.lit("")).alias("text")).filter("doc_id is not null")
    rows = rows.withColumn("sample", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(min(1.0, label_share) * (1 << 30)))
    return rows.mapInPandas(scan, "doc_id long, host string, x array<double>, sample boolean, label double")


class Trees:
    """Bagged decision trees on numpy arrays; each bag holds the spam pages drawn again and OTHERS times as many others."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = TREES, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.trees: list = []
        self.mean = float(y.mean()) if len(y) else 0.0
        spam, others = np.flatnonzero(y > 0.5), np.flatnonzero(y <= 0.5)
        if not len(spam) or not len(others):
            return
        for _ in range(trees):
            pick = np.concatenate([rng.choice(spam, len(spam)), rng.choice(others, min(len(others), OTHERS * len(spam)))])
            self.trees.append(self._grow(x[pick], y[pick], DEPTH, rng))

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int, rng: np.random.Generator):
        mean = float(y.mean())
        if depth == 0 or mean in (0.0, 1.0) or len(y) < 2 * LEAF:
            return mean
        best = None
        for f in rng.choice(x.shape[1], max(1, x.shape[1] * 2 // 3), replace=False):
            order = np.argsort(x[:, f], kind="stable")
            v, t = x[order, f], np.cumsum(y[order])
            k = np.arange(1, len(y))
            left, right = t[:-1] / k, (t[-1] - t[:-1]) / (len(y) - k)
            gini = k * left * (1 - left) + (len(y) - k) * right * (1 - right)
            gini[(v[1:] == v[:-1]) | (k < LEAF) | (len(y) - k < LEAF)] = np.inf
            i = int(np.argmin(gini))
            if np.isfinite(gini[i]) and (best is None or gini[i] < best[0]):
                best = (gini[i], int(f), float((v[i] + v[i + 1]) / 2))
        if best is None:
            return mean
        _, f, at = best
        low = x[:, f] <= at
        return (f, at, self._grow(x[low], y[low], depth - 1, rng), self._grow(x[~low], y[~low], depth - 1, rng))

    def predict(self, x: np.ndarray) -> np.ndarray:
        if not self.trees:
            return np.full(len(x), self.mean)
        out = np.zeros(len(x))
        for tree in self.trees:
            out += self._walk(tree, x)
        return out / len(self.trees)

    def _walk(self, node, x: np.ndarray) -> np.ndarray:
        if not isinstance(node, tuple):
            return np.full(len(x), node)
        f, at, low, high = node
        side = x[:, f] <= at
        out = np.empty(len(x))
        out[side] = self._walk(low, x[side])
        out[~side] = self._walk(high, x[~side])
        return out


def _log_odds(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 0.01, 0.99)
    return np.log(p / (1 - p))


def host_weight(vote: np.ndarray, host: np.ndarray, label: np.ndarray) -> float:
    """The weight of HOST_WEIGHTS that gives the labels the greatest likelihood; the first of equal ones."""
    if not len(label):
        return HOST_WEIGHTS[0]
    frame = pd.DataFrame({"host": host, "vote": vote})
    of = frame.groupby("host").vote.agg(["sum", "size"])
    rate = ((of["sum"] + PRIOR_PAGES * vote.mean()) / (of["size"] + PRIOR_PAGES))[frame.host].to_numpy()
    shift = _log_odds(rate) - _log_odds(np.array([vote.mean()]))[0]

    def loss(weight: float) -> float:
        p = np.clip(1 / (1 + np.exp(-(_log_odds(vote) + weight * shift))), 1e-6, 1 - 1e-6)
        return float(-(label * np.log(p) + (1 - label) * np.log(1 - p)).mean())

    return min(HOST_WEIGHTS, key=loss)


def smoothed(vote: Column, host_rate: Column, mean_rate: Column, weight: float) -> Column:
    """The page's log odds moved by the weighted log odds of its host against the average, as a probability."""
    odds = lambda p: F.log(F.least(F.greatest(p, F.lit(0.01)), F.lit(0.99)) / (1 - F.least(F.greatest(p, F.lit(0.01)), F.lit(0.99))))
    return 1 / (1 + F.exp(-(odds(vote) + F.lit(weight) * (odds(host_rate) - odds(mean_rate)))))


def page_scores(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """(doc_id, host, page_score, host_rate, score, is_spam), one row per row of ``documents`` with an id.

    ``page_score`` is the share of trees that vote spam, ``host_rate`` the mean vote of the host's pages (with PRIOR_PAGES
    average ones), ``score`` the vote moved by the host's odds; a page is spam if its score exceeds one half. The rules
    label about SAMPLE_ROWS pages; features, votes and host rates cover every page. Where all labels are the same, every
    page gets that vote, and without any label none is spam. Null and empty texts are pages without words; a null host is
    a host of its own; repeated rows are scored each; an empty table gives an empty result.

    Host rates are sums that combine before their exchange, and the join back is with one row per host.
    """
    share = SAMPLE_ROWS / max(1, documents.count())
    rows = cut(features(documents, id_col, text_col, host_col, share))
    sample = rows.filter("sample and label is not null").select("doc_id", "host", "x", "label").limit(2 * SAMPLE_ROWS).toPandas().sort_values("doc_id", kind="stable")
    x = np.array(sample.x.tolist(), dtype=float).reshape(-1, len(FEATURES))
    y, back = sample.label.to_numpy(dtype=float), np.arange(len(sample)) % HELD_OUT == 0
    weight = host_weight(Trees(x[~back], y[~back]).predict(x[back]), sample.host.to_numpy()[back], y[back])
    forest = Trees(x, y)

    @F.pandas_udf(T.DoubleType())
    def vote(x: pd.Series) -> pd.Series:
        return pd.Series(forest.predict(np.array(x.tolist(), dtype=float).reshape(-1, len(FEATURES))))

    voted = cut(rows.select("doc_id", "host", vote("x").alias("page_score")))
    of = voted.groupBy("host").agg(F.sum("page_score").alias("spam"), F.count("*").alias("pages"))
    mean = of.agg((F.sum("spam") / F.sum("pages")).alias("m")).first()["m"] or 0.0
    rates = of.select("host", ((F.col("spam") + PRIOR_PAGES * mean) / (F.col("pages") + PRIOR_PAGES)).alias("host_rate"))
    out = voted.join(rates, "host").withColumn("score", smoothed(F.col("page_score"), F.col("host_rate"), F.lit(mean), weight))
    return out.withColumn("is_spam", F.col("score") > 0.5)


def found(documents: DataFrame) -> DataFrame:
    """(doc_id) of the spam pages."""
    return page_scores(documents).filter("is_spam").select("doc_id").distinct()
