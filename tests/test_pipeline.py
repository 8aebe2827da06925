import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from spanloom.cli import main
from spanloom.config import Limits, Options, Schema
from spanloom.errors import AuthenticationError, BudgetExceededError, ConfigurationError, ExtractionError, RateLimitError, RequestTooLargeError
from spanloom.operators import decisions
from spanloom.operators.decisions import FailingDecider, HashDecider, LookupDecider
from spanloom.plans.pipeline import extract
from spanloom.sources.readers import read_jsonl, read_text_files
from spanloom.sources.service import Client, HttpDecider, Service, failure, retry_after
from spanloom.sources.writers import html_pages, page_name, to_html, write_jsonl
from spanloom.streaming.extract import extract_stream

SCHEMA = Schema.from_dict({
    "entities": {"person": {"description": "a person", "attributes": {"role": ["buyer", "seller"], "senior": "bool"}, "normalize": F.upper}, "org": "an organisation"},
    "sentence_labels": {"end": "can be ended"}, "fields": {"total": {"description": "the total", "source": "money"}, "who": {"description": "the buyer", "source": "person"}, "share": {"description": "x", "source": "percent"}},
})
TEXT = "Dr. Maria Silva of Acme, Inc. paid $1.2 million on March 3, 2021. The deal may be cancelled by Acme at any time."


def decider(spark, **more):
    return LookupDecider(spark, entities={"Maria Silva": "person", "Acme, Inc.": "org", "Bob": "person"}, attributes={("Maria Silva", "role"): "buyer", ("Maria Silva", "senior"): True}, labels={"end": "cancelled"}, fields={"total": "$1.2 million", "who": "Maria Silva"}, reject={"Bob"}, **more)


def docs(spark):
    return spark.createDataFrame([("a", TEXT), ("b", "  "), ("c", "Paris is lovely, said Bob."), ("d", None)], "doc_id string, text string")


def test_end_to_end(spark):
    r = extract(docs(spark), SCHEMA, decider(spark))
    got = {(x.kind, x.extraction_class, x.extraction_text) for x in r.extractions.collect()}
    assert got == {("entity", "person", "Maria Silva"), ("entity", "org", "Acme, Inc."), ("sentence", "end", "The deal may be cancelled by Acme at any time."), ("field", "total", "$1.2 million"), ("field", "who", "Maria Silva")}
    person = r.by_class("person").first()
    assert person.attributes == {"role": "buyer", "senior": "true"} and person.normalized == "MARIA SILVA" and not person.needs_review and person.verify == pytest.approx(0.9)
    assert [(x.extraction_text, x.reason) for x in r.rejected.collect()] == [("Bob", "verification")]
    assert r.ungrounded().count() == 0 and r.errors.count() == 0
    assert {x.doc_id: x.windows for x in r.metrics.collect()} == {"a": 1, "b": 0, "c": 1, "d": 0}
    page = {x.document_id: x for x in r.annotated().collect()}
    assert [x.extraction_text for x in page["a"].extractions][:1] == ["Maria Silva"] and page["b"].extractions == [] and page["c"].rejected[0].reason == "verification"
    assert {x.document_id for x in html_pages(r.annotated()).collect()} == {"a", "b", "c", "d"}


def test_failures_are_isolated_or_raised(spark):
    small = Schema.from_dict({"entities": {"person": "a person"}})
    silent = FailingDecider(HashDecider(), "key rlike '^c/[0-9]+:c/'")
    r = extract(docs(spark), small, silent, Options(on_error="skip", ngrams=False))
    assert {(x.doc_id, x.stage) for x in r.errors.collect()} == {("c", "window")}
    assert r.extractions.filter("doc_id = 'c'").count() == 0
    with pytest.raises(ExtractionError) as e:
        extract(docs(spark), small, silent, Options(ngrams=False))
    assert e.value.result.extractions.count() == r.extractions.count() > 0 and e.value.errors[0]["doc_id"] == "c"


def test_null_and_reused_ids(spark):
    rows = [("a", "Bob left."), ("a", "Bob stayed."), (None, "Bob slept."), ("b", "Bob ran."), ("", "Bob sat."), ("a:b", None)]
    r = extract(spark.createDataFrame(rows, "doc_id string, text string"), Schema.from_dict({"entities": {"person": "a person"}, "sentence_labels": {"all": "x"}}), LookupDecider(spark, entities={"Bob": "person"}, labels={"all": "Bob"}))
    got = sorted(((x.doc_id, x.kind) for x in r.extractions.collect()), key=str)
    assert got == sorted([(k, kind) for k, t in rows if t for kind in ("entity", "sentence")], key=str)
    pages = r.annotated().collect()
    assert sorted((str(x.document_id), x.text, len(x.extractions)) for x in pages) == sorted((str(k), t, 2 if t else 0) for k, t in rows)
    assert sorted(str(x.doc_id) for x in r.metrics.collect()) == sorted(str(k) for k, _ in rows) and r.ungrounded().count() == 0


class Noting:
    """Keeps the questions that reach it."""

    def __init__(self, inner):
        self.inner, self.seen = inner, []

    def decide(self, questions):
        self.seen += questions.select("role", "state", "instructions", "subject", "key").collect()
        return self.inner.decide(questions)


def test_questions_say_what_they_are_about(spark):
    schema = Schema.from_dict({"description": "a contract", "instructions": "be strict", "entities": {"person": {"description": "a person", "attributes": {"role": ["buyer", "seller"]}}}, "sentence_labels": {"end": "can be ended"}, "fields": {"who": {"description": "the buyer", "source": "person"}}})
    noting = Noting(LookupDecider(spark, entities={"Bob": "person"}, fields={"who": "Bob"}))
    text = "Bob saw Bob. Then he left."
    r = extract(spark.createDataFrame([("a", text)], "doc_id string, text string"), schema, noting)
    asked = {}
    for q in noting.seen:
        asked.setdefault(q.role, []).append((json.loads(q.state), json.loads(q.instructions), q))
    state = asked["classify"][0][0]
    assert state == {"document_type": "a contract", "guidelines": "be strict", "entity_types": {"person": state["entity_types"]["person"]}, "text": {"S1": "Bob saw Bob.", "S2": "Then he left."}}
    bobs = sorted((told["occurrence"], told["context"]) for _, told, q in asked["classify"] if q.subject == "Bob")
    assert bobs == [("the first of 2 occurrences in `text.S1`", "Bob saw Bob. Then he left."), ("the second of 2 occurrences in `text.S1`", "Bob saw Bob. Then he left.")]
    assert all("`text.S1`" in told["question"] and told["span"] == "Bob" for _, told, _ in asked["attribute"]) and all("occurrence" in told and told["entity_type"] == "person" for _, told, _ in asked["verify"])
    assert {told["question"][-11:-1] for _, told, _ in asked["label"]} == {"`text.S1`"[-10:], "`text.S2`"[-10:]} or all("`text.S" in told["question"] for _, told, _ in asked["label"])
    assert asked["field"][0][0] == {"document_type": "a contract", "guidelines": "be strict", "text": text} and asked["field"][0][1]["definition"] == "the buyer"
    m = r.metrics.first()
    assert m.questions == len({q.key for q in noting.seen}) and m.input_tokens > 0 and m.candidates == sum(len(w.candidates) for w in r.scan.first().windows)
    one = extract(spark.createDataFrame([("a", "Bob left.")], "doc_id string, text string"), schema, noting).scan.first().windows[0]
    assert json.loads(one.state)["text"] == "Bob left." and one.candidates[0].ref == "`text`" and one.candidates[0].occurrence is None


def test_a_failing_normaliser_gives_null(spark):
    def number(text):
        return {"length": len(text)} if text == "Bob" else 1 / 0

    schema = Schema.from_dict({"entities": {"person": {"description": "a person", "normalize": number}, "org": {"description": "an org", "normalize": str.upper}}})
    r = extract(spark.createDataFrame([("a", "Bob met Ann at Acme.")], "doc_id string, text string"), schema, LookupDecider(spark, entities={"Bob": "person", "Ann": "person", "Acme": "org"}))
    assert {x.extraction_text: x.normalized for x in r.extractions.collect()} == {"Bob": '{"length": 3}', "Ann": None, "Acme": "ACME"}


def test_tagged_words_become_candidates(spark):
    schema = Schema.from_dict({"entities": {"thing": "a thing"}})
    decider_ = LookupDecider(spark, entities={"red door": "thing"})
    for mode in ("tags", "hybrid"):
        r = extract(spark.createDataFrame([("a", "He saw a red door. The door was shut, the wall red.")], "doc_id string, text string"), schema, decider_, Options(span_source=mode))
        assert [(x.extraction_text, "tagger" in x.sources) for x in r.extractions.collect()] == [("red door", True)] and r.metrics.first().questions > 7 and r.rejected.count() == 0 and r.scan.selectExpr("size(filter(flatten(windows.candidates), c -> array_contains(c.sources, 'tagger'))) as n").first().n == 3


def test_values_and_batches(spark):
    import asyncio

    from spanloom import AnnotatedDocument, CharInterval, ExampleData, Extraction, Extractor, session

    example = ExampleData("Bob left.", [Extraction("person", "Bob", CharInterval(0, 3), {"role": "buyer"})])
    assert example.extractions[0].start == 0 and Extraction("x", "y").end == -1
    e = Extractor([example], LookupDecider(spark, entities={"Bob": "person"}), spark=spark)
    written = len(session._WRITTEN)
    got = list(e.documents(["Bob left.", "Nobody.", {"text": "Bob, Bob.", "document_id": "k"}], at_once=2))
    assert [len(d.by_class("person")) for d in got] == [1, 0, 2] and got[2].document_id == "k" and not got[2].ungrounded() and isinstance(got[0], AnnotatedDocument)
    assert len(session._WRITTEN) == written  # what a batch wrote is gone
    assert asyncio.run(e.aextract("Bob."))["extractions"][0]["extraction_text"] == "Bob"


def test_lines_that_are_no_documents(spark, tmp_path):
    (tmp_path / "bad.jsonl").write_text('{"text": "ok"}\n{"txt": 1}\n', encoding="utf-8")
    with pytest.raises(Exception, match="bad.jsonl:2"):
        read_jsonl(spark, str(tmp_path / "bad.jsonl")).collect()
    schema = tmp_path / "s.json"
    schema.write_text(json.dumps({"sentence_labels": {"x": "x"}}))
    assert main(["extract", str(tmp_path / "bad.jsonl"), "--schema", str(schema), "--output", str(tmp_path / "o")]) == 2
    assert main(["extract", str(tmp_path / "none.jsonl"), "--schema", str(schema), "--output", str(tmp_path / "o")]) == 2


def test_lines_are_numbered_over_splits(spark, tmp_path):
    (tmp_path / "d").mkdir()
    for f in "ab":
        (tmp_path / "d" / f"{f}.jsonl").write_text("".join(json.dumps({"text": f"{f}{k}"}) + "\n" + "\n" * (k % 3 == 0) for k in range(300)), encoding="utf-8")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        rows = {r.doc_id: r.text for r in read_jsonl(spark, str(tmp_path / "d")).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    want = {f"{f}.jsonl:{n}": json.loads(line)["text"] for f in "ab" for n, line in enumerate((tmp_path / "d" / f"{f}.jsonl").read_text().split("\n"), 1) if line}
    assert rows == want


def test_tooltips():
    from spanloom.sources.writers import tooltip

    x = {"c": "person", "p": 0.5, "a": {"role": "buyer", "x": None}, "v": {"verify": 0.9}, "n": "BOB", "r": True}
    assert tooltip(x) == "person · 0.50 · role: buyer · verify 0.90 · = BOB · review"
    assert len(tooltip(x | {"n": "y" * 500})) == 118 and tooltip({"c": "p", "p": None, "a": None, "v": None, "n": None, "r": False}) == "p"


def test_jsonl_files_and_cli(spark, tmp_path):
    (tmp_path / "in.jsonl").write_text(json.dumps({"text": "Ann paid $5."}) + "\n\n" + json.dumps({"text": "x y", "document_id": "own"}) + "\n", encoding="utf-8")
    (tmp_path / "one.txt").write_text("Bob.\nYes.", encoding="utf-8")
    assert {(x.doc_id, x.text) for x in read_jsonl(spark, str(tmp_path / "in.jsonl")).collect()} == {("in.jsonl:1", "Ann paid $5."), ("own", "x y")}
    assert [(x.doc_id, x.text) for x in read_text_files(spark, str(tmp_path / "one.txt")).collect()] == [("one.txt", "Bob.\nYes.")]
    write_jsonl(spark.createDataFrame([("a", None)], "document_id string, model string"), str(tmp_path / "out"))
    assert [x.value for x in spark.read.text(str(tmp_path / "out")).collect()] == ['{"document_id":"a","model":null}']
    schema = tmp_path / "s.json"
    schema.write_text(json.dumps({"sentence_labels": {"x": "x"}}))
    assert main(["extract", str(tmp_path / "in.jsonl"), "--schema", str(schema), "--output", str(tmp_path / "o"), "--html", str(tmp_path / "h")]) == 0
    assert spark.read.json(str(tmp_path / "o")).count() == 2
    assert main(["check", "--schema", str(schema)]) == 0 and main(["check", "--schema", str(tmp_path / "missing.json")]) == 2


def test_html():
    page = to_html("a <b> c", [(0, 7, "x", "X"), (2, 5, "y", "Y")], "t")
    assert page.count("<mark") == 3 and "&lt;b&gt;" in page
    assert page_name(3, "a/b c") == "0003_a_b_c.html"
    many = [(k, k + 3, "x", "x") for k in range(4000)]
    assert to_html("z" * 5000, many).count("<mark") > 3000


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    spark.createDataFrame([("a", "The deal may be cancelled.")], "doc_id string, text string").write.mode("overwrite").parquet(str(tmp_path / "in"))
    seen = []
    stream = spark.readStream.schema("doc_id string, text string").parquet(str(tmp_path / "in"))
    q = extract_stream(stream, Schema.from_dict({"sentence_labels": {"end": "x"}}), LookupDecider(spark, labels={"end": "cancelled"}), lambda r, n: seen.extend(x.extraction_text for x in r.extractions.collect()), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert seen == ["The deal may be cancelled."]


class Handler(BaseHTTPRequestHandler):
    calls: list = []

    def log_message(self, *a):
        pass

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["content-length"])))
        Handler.calls.append(len(body["questions"]))
        n = len(Handler.calls)
        status, out, extra = 200, None, {}
        if self.headers["authorization"] != "Bearer k":
            status, out = 401, {"error": "no"}
        elif n == 1:
            status, out, extra = 429, {"error": "slow down"}, {"retry-after-ms": "10"}
        elif len(body["questions"]) > 2:
            status, out = 400, {"error": "too many: at most 2 questions"}
        else:
            out = {"model": "m", "answers": {k: {"noul": 0.75} if q["type"] == "noul" else {"probabilities": {next(iter(q["criteria"])): 1.0}} for k, q in body["questions"].items()}, "usage": {"input_tokens": 5}}
        data = json.dumps(out).encode()
        self.send_response(status)
        for k, v in extra.items():
            self.send_header(k, v)
        self.end_headers()
        self.wfile.write(data)


@pytest.fixture
def server(monkeypatch):
    Handler.calls = []
    s = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    monkeypatch.setenv("SPANLOOM_API_KEY", "k")
    yield f"http://127.0.0.1:{s.server_port}"
    s.shutdown()


def test_client(server, monkeypatch):
    c = Client(Service(server, "m", backoff=0.01))
    got = c.ask("state", {str(k): {"type": "noul", "instructions": "i"} for k in range(5)})
    assert len(got) == 5 and c.splits == 1 and c.retried == 1 and c.most_questions == 2 and c.input_tokens == 15
    with pytest.raises(BudgetExceededError):
        Client(Service(server, "m", max_cost_usd=0.0)).ask("s", {"a": {"type": "noul", "instructions": "i"}})
    with pytest.raises(RequestTooLargeError):
        Client(Service(server, "m", limits=Limits(state_question_tokens=3))).ask("long state " * 9, {"a": {"type": "noul"}})
    monkeypatch.setenv("SPANLOOM_API_KEY", "wrong")
    with pytest.raises(AuthenticationError):
        Client(Service(server, "m")).ask("s", {"a": {"type": "noul", "instructions": "i"}})
    monkeypatch.delenv("SPANLOOM_API_KEY")
    with pytest.raises(ConfigurationError):
        Client(Service(server, "m"))


def test_http_decider(spark, server):
    r = extract(docs(spark), Schema.from_dict({"sentence_labels": {"end": "x"}}), HttpDecider(Service(server, "m", backoff=0.01), workers=1))
    assert r.extractions.count() == 3 and r.extractions.first().confidence == 0.75


def test_failures_by_status():
    assert isinstance(failure(429, "", {"retry-after": "2"}), RateLimitError) and retry_after({"retry-after": "999"}) == 120
    e = failure(400, "maximum of 1,000 tokens exceeded", {})
    assert isinstance(e, RequestTooLargeError) and (e.limit_kind, e.limit) == ("tokens", 1000)
    assert failure(503, "", {}).retryable and not failure(404, "", {}).retryable and failure(409, "", {}).retryable and not failure(402, "", {}).retryable and not failure(405, "", {}).retryable


def test_requests_are_packed_in_order_and_limits_learned(server, monkeypatch):
    c = Client(Service(server, "m", limits=Limits(max_questions=10)))
    q = {str(k): {"type": "noul", "instructions": "i" * (k % 5)} for k in range(35)}
    parts = c.pack(10, q)
    assert [len(p) for p in parts] == [10, 10, 10, 5] and [k for p in parts for k in p] == list(q) and c.pack(10, {}) == []
    c.most_tokens = 40
    assert all(10 + sum(len(json.dumps(x)) // 3 for x in p.values()) <= 60 for p in c.pack(10, q)) and len(c.pack(10, q)) > 10
    e = RequestTooLargeError("x")
    c.most_tokens, c.most_questions = 1000, 10
    c.learn(e, 900, 8, 100)
    assert (c.most_questions, c.most_tokens) == (5, 720)
    e.limit_kind, e.limit = "tokens", 200
    c.learn(e, 700, 5, 100)
    assert (c.most_questions, c.most_tokens) == (5, 170)
    e.limit_kind, e.limit = "questions", 3
    c.learn(e, 700, 5, 100)
    assert (c.most_questions, c.most_tokens) == (3, 170)


def test_facade_budget_and_field_groups(spark, tmp_path):
    from spanloom.api import Extractor
    from spanloom.sources.writers import write_html_files

    schema = Schema.from_dict({"fields": {"no": {"description": "x", "patterns": [r"order (\d+)"]}}})
    e = Extractor(schema, LookupDecider(spark, fields={"no": "77"}), cache=str(tmp_path / "cache"), spark=spark)
    got = list(e.extract_many(["the order 77 came", {"text": "none", "document_id": None}, {"text": "order 5", "document_id": "z"}]))
    assert [g["document_id"] for g in got] == ["0", None, "z"] and [[x["extraction_text"] for x in g["extractions"]] for g in got] == [["77"], [], []]
    assert got[0]["extractions"][0]["char_interval"] == {"start_pos": 10, "end_pos": 12} and got[2]["rejected"] == []
    with pytest.raises(TypeError):
        list(e.extract_many([3]))
    with pytest.raises(BudgetExceededError):
        extract(docs(spark), schema.__class__.from_dict({"sentence_labels": {"end": "x"}}), LookupDecider(spark), Options(max_cost_usd=0.0))
    write_html_files(extract(docs(spark), Schema.from_dict({"sentence_labels": {"end": "x"}}), LookupDecider(spark)).annotated(), str(tmp_path / "pages"))
    assert sorted(f.name[:4] for f in (tmp_path / "pages").iterdir()) == ["0001", "0002", "0003", "0004"]


def test_answers_in_the_own_row_are_those_of_a_join(spark):
    class Joined(HashDecider):
        """The same answers as a table of their own."""

        def decide(self, questions):
            return super().decide(questions)

    schema = Schema.from_dict({
        "entities": {"party": "a person or organisation", "amount": {"description": "money", "attributes": {"due": "bool", "role": ["price", "fee"]}}},
        "sentence_labels": {"duty": "somebody must do something"}, "fields": {"total": {"description": "the total", "source": ["money"]}}, "min_confidence": 0.3,
    })
    text = "Acme, Inc. of Rio pays Borealis $5 million. Borealis owes Acme 40 dollars on May 3, 2024. Acme pays Acme. "
    df = spark.createDataFrame([("1", text * 3), ("2", ""), ("3", None), (None, text), ("1", "Zenith pays €9 on May 4.")], "doc_id string, text string")
    for options in (Options(), Options(field_state_chars=100, limits=Limits(max_options=3))):
        got, want = (extract(df, schema, d, options) for d in (HashDecider(), Joined()))
        for name in ("extractions", "rejected", "errors", "metrics"):
            a, b = ([sorted(map(str, getattr(x, name).select(F.to_json(F.struct(*[c for c in getattr(x, name).columns if c != "row_key"]))).collect()))] for x in (got, want))
            assert a == b, name
        assert not got.extractions.isEmpty()
    q = spark.createDataFrame([("k", "s", "choice", "i", [("a", "b")], "classify", "x", "")], "key string, state string, type string, instructions string, criteria array<struct<key:string,value:string>>, role string, subject string, name string")
    plans = [decisions._answered(d, q)._jdf.queryExecution().executedPlan().toString() for d in (HashDecider(), Joined())]
    assert ["Join" in p for p in plans] == [False, True]
