import random

import pytest
from pyspark.sql import functions as F

from spanloom.functions import segment
from spanloom.operators import decisions, intervals
from spanloom.operators import text as T


def test_lines_patterns_contexts(spark):
    df = spark.createDataFrame([(1, "a😀 12\n\n34 b", "clash"), (2, "", ""), (3, None, None), (4, "x 5,5", "y")], "doc_id int, text string, value string")
    lines = {(r.doc_id, r.line): (r.start_pos, r.end_pos, r.text) for r in T.lines_with_offsets(df).collect()}
    assert lines[1, 0] == (0, 5, "a😀 12") and lines[1, 1] == (6, 6, "") and lines[1, 2] == (7, 11, "34 b") and lines[2, 0] == (0, 0, "")
    got = {(r.doc_id, r.start_pos, r.end_pos, r.value) for r in T.pattern_spans(df, r"\d+").collect()}
    assert got == {(1, 3, 5, "12"), (1, 7, 9, "34"), (4, 2, 3, "5"), (4, 4, 5, "5")}
    assert {r.doc_id for r in T.not_blank(df.union(spark.createDataFrame([(9, " \n", "")], df.schema))).collect()} == {1, 4}
    one = spark.createDataFrame([("alpha beta gamma delta",)], "t string")
    row = one.select(T.context_before(F.col("t"), F.lit(11), 8).alias("b"), T.context_after(F.col("t"), F.lit(10), 8).alias("a"), T.snippet(F.col("t"), F.lit(6), F.lit(10), 3).alias("s"), T.ordinal_word(F.lit(11)).alias("o"), T.ordinal_word(F.lit(3)).alias("o3")).first()
    assert (row.b, row.a, row.s, row.o, row.o3) == ("beta", "gamma", "…ha beta ga…", "#11", "third")


def test_windows_equal_a_loop(spark):
    rng = random.Random(2)
    rows = []
    for k in range(40):
        at, sents = 0, []
        for _ in range(rng.randint(0, 30)):
            n = rng.randint(1, 400)
            sents.append({"s": at, "e": at + n})
            at += n + 1
        rows.append((k, sents))
    got = {r.k: [(w["first"], w["last"], w["s"], w["e"]) for w in r.w] for r in spark.createDataFrame(rows, "k int, x array<struct<s:int,e:int>>").select("k", T.windows(F.col("x"), 800, 8).alias("w")).collect()}
    for k, sents in rows:
        want = []
        for i, x in enumerate(sents):
            if want and x["e"] - want[-1][2] <= 800 and i - want[-1][0] < 8:
                want[-1] = (want[-1][0], i, want[-1][2], x["e"])
            else:
                want.append((i, i, x["s"], x["e"]))
        assert got[k] == want


def test_overlaps_equal_a_loop(spark):
    rng = random.Random(3)
    rows = [(k, [{"s": (s := rng.randint(0, 15)), "e": s + rng.randint(1, 6), "confidence": rng.choice([0.89, 0.9, 0.5]), "extraction_class": rng.choice("ab")} for _ in range(rng.randint(0, 7))]) for k in range(60)]
    df = spark.createDataFrame(rows, "k int, x array<struct<s:int,e:int,confidence:double,extraction_class:string>>")
    for mode in ("none", "nested", "all"):
        got = {r.k: sorted((y["s"], y["e"], y["confidence"], y["extraction_class"]) for y in r.y) for r in df.select("k", intervals.resolve_overlaps(F.col("x"), mode).alias("y")).collect()}
        for k, spans in rows:
            kept = []
            for x in sorted(spans, key=lambda x: (-int(x["confidence"] / 0.1 + 1e-9), x["s"] - x["e"], x["s"], x["extraction_class"])):
                def clash(y):
                    if not (x["s"] < y["e"] and y["s"] < x["e"]):
                        return False
                    nested = x["s"] <= y["s"] and y["e"] <= x["e"] or y["s"] <= x["s"] and x["e"] <= y["e"]
                    return mode == "none" or not (nested and x["extraction_class"] != y["extraction_class"])
                if mode == "all" or not any(map(clash, kept)):
                    kept.append(x)
            assert got[k] == sorted((y["s"], y["e"], y["confidence"], y["extraction_class"]) for y in kept), mode


def test_interval_joins(spark):
    weak = spark.createDataFrame([(1, 0, 2), (1, 5, 9), (1, 5, 8), (2, 0, 1)], "doc_id int, s int, e int")
    strong = spark.createDataFrame([(1, 4, 7), (1, 7, 9), (1, 5, 9)], "doc_id int, s int, e int")
    assert {tuple(r) for r in intervals.without_covered(weak, strong, ["doc_id"]).collect()} == {(1, 0, 2), (1, 5, 9), (2, 0, 1)}
    sents = spark.createDataFrame([(1, 0, 0, 6), (1, 1, 6, 20)], "doc_id int, sentence int, s int, e int")
    assert {(r.s, r.e, r.sentence) for r in intervals.assign_to_sentences(weak, sents).collect()} == {(0, 2, 0)}
    c = spark.createDataFrame([(1, 0, 0, 2, "b", 3), (1, 0, 0, 2, "a", 1), (1, 0, 3, 4, "a", 2), (1, 0, 5, 6, "a", 2)], "doc_id int, sentence int, s int, e int, source string, priority int")
    merged = intervals.merge_candidates(c)
    assert {(r.s, tuple(r.sources), r.priority) for r in merged.collect()} == {(0, ("a", "b"), 1), (3, ("a",), 2), (5, ("a",), 2)}
    assert {r.s for r in intervals.best_candidates(merged, 2).collect()} == {0, 3}
    seg = spark.createDataFrame([(1, 0, 10, "outer"), (1, 3, 5, "inner")], "doc_id int, s int, e int, extraction_class string")
    assert sorted((r.s, r.e, r.extraction_class) for r in intervals.marked_segments(seg).collect()) == [(0, 3, "outer"), (3, 5, "inner"), (5, 10, "outer")]


def q(spark, rows):
    return spark.createDataFrame(rows, "key string, type string, criteria array<struct<key:string,value:string>>")


AB = [{"key": "a", "value": "A"}, {"key": "b", "value": "B"}]


def test_validation(spark):
    questions = q(spark, [(k, "choice", AB) for k in ("ok", "part", "zero", "nan", "unknown", "missing", "tie")] + [("n", "noul", []), ("n2", "noul", []), ("s", "score", AB), ("s2", "score", AB)])
    p = lambda **x: [{"k": k, "p": v} for k, v in x.items()]
    answers = spark.createDataFrame([
        ("ok", p(b=0.2, a=0.6), None, None, "a", None), ("part", p(a=0.3, z=9.0), None, None, None, None), ("zero", p(a=0.0), None, None, None, None), ("nan", p(a=float("nan"), b=1.0), None, None, None, None), ("unknown", p(a=1.0), None, None, "z", None),
        ("tie", p(a=0.5, b=0.5), None, None, None, None), ("n", None, 1.3, None, None, None), ("n2", None, None, None, None, None), ("s", p(**{"0": 0.25, "1": 0.75}), None, None, None, None), ("s2", p(**{"0": 1.0}), None, 4.0, None, None),
    ], decisions.ANSWER)
    got = {r.key: r for r in decisions.validated(questions, answers).withColumn("t", decisions.top(F.col("probs"))).collect()}
    assert [x["p"] for x in got["ok"].probs] == pytest.approx([0.75, 0.25]) and got["ok"].error is None and got["ok"].t.margin == pytest.approx(0.5)
    assert [x["p"] for x in got["part"].probs] == [1.0, 0.0]
    assert {k for k, r in got.items() if r.error} == {"zero", "nan", "unknown", "missing", "n2"}
    assert got["tie"].t.choice == "a" and got["n"].noul == 1.0 and got["s"].score == pytest.approx(0.75) and got["s2"].score == 4.0


class Biggest:
    """Prefers the option with the largest number in its name; escapes where the task says so."""

    def decide(self, questions):
        opts = F.transform("criteria", lambda c: F.struct(c["key"].alias("k"), F.when(c["key"] == "none", F.when(F.col("subject") == "never", 1e9).otherwise(0.0)).otherwise(F.regexp_extract(c["key"], r"\d+", 0).cast("double")).alias("p")))
        n = F.lit(None)
        total = F.aggregate(opts, F.lit(0.0), lambda a, x: a + x["p"])
        return questions.select("key", F.transform(opts, lambda x: F.struct(x["k"].alias("k"), (x["p"] / total).alias("p"))).alias("probs"), n.cast("double").alias("noul"), n.cast("double").alias("score"), n.cast("string").alias("choice"), n.cast("double").alias("confidence"))


def test_tournament(spark):
    many = [{"key": f"o{k}", "value": "x"} for k in range(1, 41)]
    tasks = spark.createDataFrame([("t", "", "", "x", "", many), ("few", "", "", "x", "", many[:3]), ("nobody", "", "", "never", "", many)], "task string, state string, instructions string, subject string, name string, criteria array<struct<key:string,value:string>>")
    got = {r.task: r for r in decisions.tournament(Biggest(), tasks, 5).collect()}
    assert got["t"].choice == "o40" and got["few"].choice == "o3" and got["nobody"].choice is None and got["nobody"].margin == got["nobody"].p
    with pytest.raises(ValueError):
        decisions.tournament(Biggest(), tasks, 2)


def test_cache_asks_once(spark, tmp_path):
    class Counting(decisions.HashDecider):
        asked = 0

        def decide(self, questions):
            Counting.asked += questions.count()
            return super().decide(questions)

    rows = q(spark, [("1", "choice", AB), ("2", "choice", AB)]).withColumns({"state": F.lit("s"), "instructions": F.lit("i"), "role": F.lit("r"), "subject": F.lit("x"), "name": F.lit("")})
    d = decisions.CachedDecider(Counting(), str(tmp_path / "cache"))
    first = sorted(map(str, d.decide(rows).select("probs").collect()))
    assert Counting.asked == 1 and len(first) == 2
    assert sorted(map(str, d.decide(rows).select("probs").collect())) == first and Counting.asked == 1


def test_memory_cache_forgets_the_longest_unused(spark):
    rows = q(spark, [("1", "choice", AB)]).withColumns({"state": F.lit("s"), "instructions": F.lit("i"), "role": F.lit("r"), "subject": F.lit("x"), "name": F.lit("")})
    cache = decisions.MemoryCache(2)
    for state in ("s", "t", "s", "u"):
        decisions.CachedDecider(decisions.HashDecider(), cache).decide(rows.withColumn("state", F.lit(state))).collect()
    again = lambda state: decisions.CachedDecider(decisions.FailingDecider(decisions.HashDecider(), "true"), cache).decide(rows.withColumn("state", F.lit(state))).count()
    assert len(cache.answers) == 2 and again("s") == again("u") == 1 and again("t") == 0


def test_unfit_kept_answers_are_asked_again_and_old_ones_dropped(spark, tmp_path):
    rows = q(spark, [("1", "choice", AB)]).withColumns({"state": F.lit("s"), "instructions": F.lit("i"), "role": F.lit("r"), "subject": F.lit("x"), "name": F.lit("")})
    cache = decisions.TableCache(str(tmp_path / "cache"))
    bad = rows.select(decisions.cache_key("lookup").alias("cache_key"), F.lit(None).cast("array<struct<k:string,p:double>>").alias("probs"), *[F.lit(None).cast(t).alias(c) for c, t in (("noul", "double"), ("score", "double"), ("choice", "string"), ("confidence", "double"))])
    cache.store(bad)
    assert decisions.CachedDecider(decisions.HashDecider(), cache).decide(rows).filter("probs is not null").count() == 1
    assert decisions.CachedDecider(decisions.FailingDecider(decisions.HashDecider(), "true"), cache).decide(rows).filter("probs is not null").count() == 1
    cache.retain(spark, "2999-01-01")
    assert cache.lookup(rows.select(decisions.cache_key("lookup").alias("cache_key"))).count() == 0


def test_failures_can_be_made_to_raise(spark):
    rows = q(spark, [("1", "choice", AB)]).withColumns({"role": F.lit("r"), "subject": F.lit("x"), "name": F.lit("")})
    with pytest.raises(RuntimeError):
        decisions.FailingDecider(decisions.HashDecider(), "key = '1'", RuntimeError()).decide(rows)


def test_overlaps_of_long_groups(spark):
    rows = [(1, 3 * k + d, 3 * k + d + 2, 0.5 + 0.1 * (d == 1), "a") for k in range(30_000) for d in (0, 1)]
    df = spark.createDataFrame(rows, "doc_id int, s int, e int, confidence double, extraction_class string")
    kept = intervals.without_overlaps(df, ["doc_id"])
    assert kept.count() == 30_000 and kept.filter("s % 3 <> 1").count() == 0 and intervals.without_overlaps(df, ["doc_id"], "all").count() == 60_000


def test_long_texts_take_time_in_proportion(spark):
    import time

    took = {}
    for n in (20_000, 160_000):
        df = spark.createDataFrame([(1, "Line 12 ends here.\n" * n)], "doc_id int, text string")
        began = time.perf_counter()
        assert T.lines_with_offsets(df).count() == n + 1 and T.spans_in_lines(df, r"[0-9]+").count() == n and T.windows_with_context(df, lines=True).count() == -(-n // 8)
        took[n] = time.perf_counter() - began
    assert took[160_000] < 8 * 4 * took[20_000]


def test_suppression_in_a_row(spark):
    df = spark.createDataFrame([(1, "a1@b2.ex 33 a@44.xx 5"), (2, None)], "doc_id int, text string")
    assert [r.value for r in T.uncovered_spans(df, "[0-9]+", [r"\w+@[\w.]+"]).collect()] == ["33", "5"]


def test_shared_folder(spark):
    from spanloom import session
    from spanloom.errors import ConfigurationError

    class Conf:
        def __init__(self, **kv):
            self.kv = kv

        def get(self, k, default=None):
            return self.kv.get(k.replace(".", "_"), default)

    fake = lambda **kv: type("S", (), {"conf": Conf(**kv)})()
    assert session.shared_dir(fake(spark_checkpoint_dir="hdfs://x/y")) == "hdfs://x/y" and session.shared_dir(fake(spark_master="local[4]")).startswith("file:")
    for master in ("yarn", "spark://h:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ConfigurationError):
            session.shared_dir(fake(spark_master=master))


def test_packing_and_cost(spark):
    rows = spark.createDataFrame([("s", k, 10) for k in range(35)] + [("t", 0, 500)], "state string, k int, tokens int")
    got = decisions.packed(rows, ["state"], "tokens", 1000, 10, "k").groupBy("state", "request").count().collect()
    assert sorted((r.state, r["count"]) for r in got) == [("s", 5), ("s", 10), ("s", 10), ("s", 10), ("t", 1)]
    spent = decisions.running_cost(rows.filter("state = 's'"), "tokens", ["state"], ["k"], 1e6, 30.0)
    assert spent.filter("allowed").count() == 3


def test_scan_handles_odd_rows(spark):
    from spanloom.config import Schema

    schema = Schema.from_dict({"entities": {"x": {"description": "x", "terms": ["Acme"]}}})
    df = spark.createDataFrame([("1", "Acme pays. " * 3000), ("2", ""), ("3", None), ("4", "Acme."), ("4", "Acme.")], "doc_id string, text string")
    rows = {r.doc_id: r for r in T.scan(df, schema).collect()}
    assert len(rows["1"].sentences) == 3000 and rows["2"].sentences == [] and "3" not in rows
    assert all(segment.sentences("Acme.") == [(0, 5)] for _ in range(1)) and any("gazetteer:x" in c.sources for w in rows["4"].windows for c in w.candidates)
    assert T.scan(df.limit(0), schema).count() == 0


def test_scan_gives_its_rows_on_in_portions(spark):
    import pyarrow as pa

    from spanloom.config import Schema

    class Docs:
        """Runs a map over one batch of all texts, as a worker does."""

        sizes: list

        def select(self, *_):
            return self

        filter = select

        def mapInArrow(self, f, _):  # noqa: N802
            self.sizes = [len(x) for x in f(iter([batch]))]

        def mapInPandas(self, f, _):  # noqa: N802
            self.sizes = [len(x) for x in f(iter([batch.to_pandas()]))]

    schema = Schema.from_dict({"entities": {"x": {"description": "x", "terms": ["Acme"]}}})
    text = "Acme Holdings of Kestrel Bay pays 40 dollars on May 3, 2024. " * 20
    batch = pa.RecordBatch.from_pylist([{"doc_id": str(k), "text": text} for k in range(300)])
    docs = Docs()
    T.scan(docs, schema)
    assert sum(docs.sizes) == 300 and max(docs.sizes) <= T.PORTION_CHARS // len(text)
    T.candidate_spans(docs, schema)
    assert len(docs.sizes) > 1 and max(docs.sizes) <= T.PORTION_ROWS


def test_candidate_spans_are_those_of_the_scan(spark):
    from spanloom.config import Schema

    schema = Schema.from_dict({"entities": {"x": {"description": "x", "terms": ["Acme"]}}})
    df = spark.createDataFrame([("1", "Acme pays Acme. " * 300), ("2", ""), ("3", None), (None, "Acme, Inc. of Rio pays $5 million."), ("4", "会社は東京にある。"), ("4", "Acme.")], "doc_id string, text string")
    nested, flat = T.candidate_rows(T.scan(df, schema)).drop("state"), T.candidate_spans(df, schema)
    assert flat.schema == nested.schema and flat.count() > 300
    assert flat.exceptAll(nested).isEmpty() and nested.exceptAll(flat).isEmpty()
    fields = Schema.from_dict({"fields": {"total": {"description": "the total", "source": ["money"]}}})
    assert T.candidate_spans(df, fields).isEmpty() and T.candidate_rows(T.scan(df, fields)).isEmpty()


def test_cut_and_clean_up(spark):
    from spanloom import session

    df = session.cut(spark.range(5))
    assert df.count() == 5 and session.shared_dir(spark).startswith("file:") and session.is_small(df, 5) and not session.is_small(df, 4)
    assert session.clean_up(spark) >= 1


def test_islands(spark):
    df = spark.createDataFrame([(1, k, k in (0, 1, 4, 6, 7, 8)) for k in range(9)], "d int, k int, f boolean")
    assert sorted((r.first, r.last, r.n) for r in intervals.islands(df, ["d"], "k", "f").collect()) == [(0, 1, 2), (4, 4, 1), (6, 8, 3)]
