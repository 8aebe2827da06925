"""The registered queries do the whole job, whatever the size of the input."""

import pytest
from pyspark.sql import functions as F

from spanloom import queries

COLUMNS = "document_key long, text string, lang string, project_id long"


def tables(spark, folder, rows):
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{folder}/annotated_docs.parquet")
    return str(folder)


def test_pipeline_proposes_every_kind_of_span(spark, tmp_path):
    names = [a + b for a in "BDFGKLMN" for b in ("arlo", "ento", "isca", "olm", "uri")]
    rows = [
        (1, "we waited several hours for a few litres of the cleaning agent and some bread", "en", 1),
        (2, "王小明代表甲方签字，李建国在上海住了三年。", "zh", 1),
        (3, "; ".join(names), "en", 1),
    ]
    got = [r for r in queries.QUERIES["pipeline_extractions"](spark, tables(spark, tmp_path, rows)).collect() if r.kind == "entity"]
    assert any(r.extraction_text.islower() for r in got if r.doc_id == "1")
    assert any(r.extraction_text.isalpha() for r in got if r.doc_id == "2")
    assert any(r.s >= rows[2][1].index(names[20]) for r in got if r.doc_id == "3"), "nothing beyond the twentieth name"


@pytest.mark.parametrize("length", [30, 5000])
def test_packing_takes_each_project_whole(spark, tmp_path, length):
    rows = [(k, "x" * (length + k % 7), "en", 1 + k % 2 if k % 50 else None) for k in range(900, 3100)]
    got = queries.QUERIES["request_packing"](spark, tables(spark, tmp_path, rows)).select("project_id", F.col("document_key").cast("long").alias("k"), "request").collect()
    want, last = {}, {}
    for k, text, _, project in rows:
        request, n, used = last.get(project, (0, 0, 0))
        tokens = len(text) // 3 + 1
        if n and (n >= 200 or used + tokens > 54_400):
            request, n, used = request + 1, 0, 0
        last[project] = request, n + 1, used + tokens
        want[project, k] = request
    assert len(got) == len(rows) and {(r.project_id, r.k): r.request for r in got} == want
