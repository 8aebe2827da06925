import json

import pytest

from spanloom.config import Attribute, Entity, Field, Limits, Options, Schema, SentenceLabel, as_schema
from spanloom.errors import ConfigurationError, SchemaError


@pytest.mark.parametrize("make", [
    lambda: Entity("", "x"), lambda: Entity("none", "x"), lambda: Entity("a" * 65, "x"), lambda: Entity("a", " "), lambda: Entity("a", "x", patterns=["("]), lambda: Entity("a", "x", min_confidence=2),
    lambda: Attribute("r"), lambda: Attribute("r", ("a", "a")), lambda: Attribute("r", ("unknown",)), lambda: Attribute("r", ("a",), "bool"), lambda: Attribute("r", ("a",), "score"), lambda: Attribute("r", ("a",), "other"),
    lambda: Entity("a", "x", attributes=(Attribute("r", ("a",)), Attribute("r", ("b",)))), lambda: Field("f", "x"), lambda: Schema(), lambda: Schema((Entity("a", "x"), Entity("a", "y"))),
    lambda: Schema(fields=(Field("f", "x", source="nothing"),)), lambda: Schema.from_dict({"entity": {}}), lambda: Schema.from_dict({"entities": {"a": {"descr": "x"}}}), lambda: as_schema(3),
])
def test_bad_schemas_are_told(make):
    with pytest.raises(SchemaError):
        make()


def test_shorthands_and_thresholds(tmp_path):
    data = {"entities": {"org": "a company", "person": {"description": "a person", "attributes": {"role": ["a", "b"], "old": "bool"}, "min_confidence": 0.8}}, "sentence_labels": {"t": "x"}, "fields": {"f": {"description": "x", "source": "money"}}, "min_confidence": 0.6}
    path = tmp_path / "s.json"
    path.write_text(json.dumps(data))
    s = as_schema(str(path))
    assert [e.id for e in s.entities] == ["org", "person"]
    assert [(a.name, a.kind) for a in s.entity("person").attributes] == [("role", "choice"), ("old", "bool")]
    assert s.threshold(s.entity("org")) == 0.6 and s.threshold(s.entity("person")) == 0.8
    assert s.fields[0].source == ("money",)
    # an entity and a label may share an id
    Schema((Entity("x", "a"),), (SentenceLabel("x", "b"),))


def test_from_examples():
    s = Schema.from_examples([{"text": "t", "extractions": [{"extraction_class": "b", "extraction_text": "X", "attributes": {"r": ["p", "q"], "ok": True, "n": None}}, {"extraction_class": "a", "extraction_text": "Y"}]}])
    assert [e.id for e in s.entities] == ["b", "a"] and s.entities[0].examples == ("X",)
    assert [(a.name, a.kind) for a in s.entities[0].attributes] == [("r", "choice"), ("ok", "bool")]
    assert s.entities[0].definition()["examples"] == ["X"]


def test_options():
    for bad in (dict(overlap="x"), dict(span_source="x"), dict(on_error="x"), dict(window_chars=0), dict(verify_threshold=True), dict(stopwords="xx")):
        with pytest.raises(ConfigurationError):
            Options(**bad)
    with pytest.raises(ConfigurationError):
        Limits(max_options=2)
