"""Problem 7: filling fixed-capacity containers with items.

Method: optimal length buckets. Dynamic programming over the global histogram of token counts chooses the bucket
boundaries that waste least padding; batches under the token budget then form inside each bucket, of as many items as its
boundary lets into a container. Since all items of a bucket count as long as its boundary, the plan needs only the
buckets' counts, whatever the number of items. A rest step fills the room that a batch leaves with items of shorter
buckets, before these form batches of their own; without it (``rest=False``) that room stays unused.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut

#: Where the public tokenizer's ranks are, and (fixed value) how it splits a text before merging.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Buckets per container size, at most.
BUCKETS = 192
#: Rows that one window of the ranking sorts, about.
ROWS_PER_SALT = 100_000

_encoders: dict = {}


def encoder(path: str = TOKENIZER):
    """The tokenizer of a rank file, one for each worker."""
    if path not in _encoders:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[path] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def token_counts(df: DataFrame, id_col: str, text_col: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, n_tokens): null texts have no tokens."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(tokenizer).encode_ordinary
        for b in batches:
            yield pd.DataFrame({"doc_id": b.doc_id, "n_tokens": [len(encode(t)) if t else 0 for t in b.text]})

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).filter("doc_id is not null")
    return rows.mapInPandas(scan, "doc_id long, n_tokens long")


def boundaries(sizes: list[int], counts: list[int], most: int = BUCKETS) -> list[int]:
    """The upper bounds of at most ``most`` buckets over ascending sizes that minimise the sum of bound minus size.

    cost(i, j) = bound_j (N_j - N_i) - (S_j - S_i): for each layer the best i for a bound is the lowest of lines in it,
    and as bounds grow the lines are met in order, so a layer takes linear time.
    """
    d = len(sizes)
    if d <= most:
        return list(sizes)
    n = [0, *np.cumsum(counts).tolist()]
    s = [0, *np.cumsum(np.multiply(sizes, counts)).tolist()]
    best = [0.0] + [float("inf")] * d
    choice: list[list[int]] = []
    for _ in range(most):
        lines: list[tuple[float, float, int]] = []
        head = 0
        new, pick = [float("inf")] * (d + 1), [0] * (d + 1)
        new[0] = 0.0
        for j in range(1, d + 1):
            i = j - 1
            if best[i] < float("inf"):
                m, c = -float(n[i]), best[i] + s[i]
                while len(lines) - head >= 2 and (c - lines[-2][1]) * (lines[-2][0] - lines[-1][0]) <= (lines[-1][1] - lines[-2][1]) * (lines[-2][0] - m):
                    lines.pop()
                lines.append((m, c, i))
            x = sizes[j - 1]
            while len(lines) - head >= 2 and lines[head + 1][0] * x + lines[head + 1][1] <= lines[head][0] * x + lines[head][1]:
                head += 1
            if len(lines) > head:
                m, c, i = lines[head]
                new[j], pick[j] = m * x + c + x * n[j] - s[j], i
        best = new
        choice.append(pick)
    out, j = [], d
    for pick in reversed(choice):
        if j == 0:
            break
        out.append(sizes[j - 1])
        j = pick[j]
    return out[::-1]


def plan(bounds: list[int], counts: list[int], capacity: int, rest: bool = True) -> list[tuple[int, int, int, int, int]]:
    """[(bucket, first rank, per container, first container, first place)]: which ranks of a bucket go where.

    Buckets are taken from the largest; each first fills the open containers that leave least room (the rest step), then
    forms batches in new ones.
    Containers alike are kept as one group, so the plan's size depends on the buckets and not on the items.
    """
    runs: list[tuple[int, int, int, int, int]] = []
    groups: dict[int, list[tuple[int, int, int]]] = {}
    opened = 0
    for bucket in range(len(bounds) - 1, -1, -1):
        size, left, rank = bounds[bucket], counts[bucket], 0
        for room in sorted(r for r in groups if r >= size and rest):
            if not left:
                break
            keep = []
            for first, n, place in groups.pop(room):
                per = room // size
                full = min(n, left // per)
                if full:
                    runs.append((bucket, rank, per, first, place))
                    rank += full * per
                    left -= full * per
                    groups.setdefault(room - per * size, []).append((first, full, place + per))
                if full < n and left:
                    runs.append((bucket, rank, left, first + full, place))
                    groups.setdefault(room - left * size, []).append((first + full, 1, place + left))
                    rank += left
                    left = 0
                    full += 1
                if full < n:
                    keep.append((first + full, n - full, place))
            if keep:
                groups.setdefault(room, []).extend(keep)
        if left:
            per = capacity // size
            full = left // per
            if full:
                runs.append((bucket, rank, per, opened, 0))
                groups.setdefault(capacity - per * size, []).append((opened, full, per))
                opened += full
                rank += full * per
                left -= full * per
            if left:
                runs.append((bucket, rank, left, opened, 0))
                groups.setdefault(capacity - left * size, []).append((opened, 1, left))
                opened += 1
    return runs


def containers(documents: DataFrame, specs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, rest: bool = True) -> DataFrame:
    """(spec_id, doc_id, piece, start_token, n_tokens, container, position) of every text for every container size.

    A text is split only if it exceeds the capacity: into full pieces and a rest. ``specs`` is the stated list of
    container sizes (spec_id, capacity_tokens); null or non-positive capacities are left out, repeated ones count once.
    Null and empty texts have no tokens, take a place of one token's size and keep n_tokens 0. Rows with a null id are
    left out; repeated rows are packed each; other columns are ignored; an empty table gives an empty result.

    The driver sees one count per token length up to the capacity (bounded by the capacities), never an item. Items find
    their rank inside a bucket by salted windows of about ROWS_PER_SALT rows plus the offsets of their salts, so a bucket
    that holds a third of all rows is ranked by many tasks; ranks meet the plan by binary search.
    """
    sizes = cut(token_counts(documents, id_col, text_col, tokenizer))
    wanted = specs.select(F.col("spec_id").cast("int").alias("spec_id"), F.col("capacity_tokens").cast("long").alias("capacity")).dropna().filter("capacity > 0").groupBy("spec_id").agg(F.min("capacity").alias("capacity"))
    capacity = {r.spec_id: r.capacity for r in wanted.collect()}
    each = [F.struct(F.lit(s).alias("spec_id"), F.lit(c).cast("long").alias("capacity")) for s, c in sorted(capacity.items())]
    rows = sizes.withColumn("spec", F.explode(F.array(*each) if each else F.array().cast("array<struct<spec_id:int,capacity:bigint>>"))).select("doc_id", "n_tokens", "spec.*")
    rows = rows.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("n_tokens") / F.col("capacity")) - 1, F.lit(0)))))
    rows = rows.withColumn("start_token", F.col("piece") * F.col("capacity")).withColumn("n_tokens", F.least(F.col("capacity"), F.col("n_tokens") - F.col("start_token")))
    rows = rows.withColumn("size", F.greatest(F.col("n_tokens"), F.lit(1)))
    histogram: dict[int, dict[int, int]] = {s: {} for s in capacity}
    for r in rows.groupBy("spec_id", "size").count().collect():
        histogram[r.spec_id][r["size"]] = r["count"]
    plans: dict[int, tuple[np.ndarray, dict[int, np.ndarray], np.ndarray]] = {}
    for s, h in histogram.items():
        ordered = sorted(h)
        bounds = boundaries(ordered, [h[x] for x in ordered])
        index = np.searchsorted(bounds, ordered)
        counts = np.bincount(index, weights=[h[x] for x in ordered], minlength=len(bounds)).astype(np.int64).tolist() if ordered else []
        by: dict[int, list] = {}
        for bucket, *run in plan(bounds, counts, capacity[s], rest):
            by.setdefault(bucket, []).append(run)
        plans[s] = (np.array(bounds, dtype=np.int64), {b: np.array(x, dtype=np.int64) for b, x in by.items()}, np.array(counts, dtype=np.int64) // ROWS_PER_SALT + 1)

    @F.pandas_udf(T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("salts", T.LongType())]))
    def bucket_of(spec: pd.Series, size: pd.Series) -> pd.DataFrame:
        bucket, salts = np.zeros(len(size), dtype=np.int32), np.ones(len(size), dtype=np.int64)
        for s in spec.unique():
            here = (spec == s).to_numpy()
            bucket[here] = np.searchsorted(plans[s][0], size.to_numpy()[here])
            salts[here] = plans[s][2][bucket[here]]
        return pd.DataFrame({"bucket": bucket, "salts": salts})

    @F.pandas_udf(T.StructType([T.StructField("container", T.LongType()), T.StructField("position", T.LongType())]))
    def place(spec: pd.Series, bucket: pd.Series, rank: pd.Series) -> pd.DataFrame:
        out = np.zeros((len(rank), 2), dtype=np.int64)
        frame = pd.DataFrame({"s": spec, "b": bucket, "r": rank}).reset_index(drop=True)
        for (s, b), g in frame.groupby(["s", "b"], sort=False):
            runs, r, at = plans[s][1][b], g.r.to_numpy(), g.index.to_numpy()
            first, per, container, slot = runs[np.searchsorted(runs[:, 0], r, side="right") - 1].T
            out[at, 0] = container + (r - first) // per
            out[at, 1] = slot + (r - first) % per
        return pd.DataFrame(out, columns=["container", "position"])

    rows = rows.withColumn("b", bucket_of("spec_id", "size")).withColumn("bucket", F.col("b.bucket")).withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.col("b.salts")).cast("int"))
    rows = rows.select("spec_id", "doc_id", "piece", "start_token", "n_tokens", "bucket", "salt")
    before = Window.partitionBy("spec_id", "bucket").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("spec_id", "bucket", "salt").agg(F.count("*").alias("n")).withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    inside = Window.partitionBy("spec_id", "bucket", "salt").orderBy("doc_id", "piece", "n_tokens")
    ranked = rows.withColumn("rn", F.row_number().over(inside) - 1).join(offsets, ["spec_id", "bucket", "salt"])
    out = ranked.withColumn("p", place("spec_id", "bucket", F.col("offset") + F.col("rn")))
    return out.select("spec_id", "doc_id", F.col("piece").cast("int").alias("piece"), "start_token", "n_tokens", "p.container", F.col("p.position").cast("int").alias("position"))


def fill(placed: DataFrame, specs: DataFrame) -> DataFrame:
    """(spec_id, containers, items, tokens, fill): how full the containers of each size are."""
    of = placed.groupBy("spec_id").agg((F.max("container") + 1).alias("containers"), F.count("*").alias("items"), F.sum("n_tokens").alias("tokens"))
    caps = specs.select(F.col("spec_id").cast("int").alias("spec_id"), "capacity_tokens").groupBy("spec_id").agg(F.min("capacity_tokens").alias("capacity_tokens"))
    return of.join(caps, "spec_id").withColumn("fill", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 4)).drop("capacity_tokens")
