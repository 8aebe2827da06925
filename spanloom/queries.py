"""The registered queries of the core operators and their SQL, each over whole tables and whole texts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .config import Options, Schema
from .operators import decisions, intervals, quantities
from .operators import text as T
from .operators.decisions import HashDecider, LookupDecider
from .plans.pipeline import extract, needs_review
from .session import cut, numbered, shared_dir, table
from .sources.readers import read_jsonl
from .sources.writers import write_jsonl

QUERIES: dict = {}
ORACLE: dict = {}


def query(f=None, *, sql: str | None = None):
    def add(g):
        QUERIES[g.__name__] = g
        if sql:
            ORACLE[g.__name__] = sql
        return g

    return add(f) if f else add


def docs_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "annotated_docs").select(F.col("document_key").alias("doc_id"), "text", "lang", "project_id")


# ---- scans, lines, patterns


@query
def typed_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed values of every document, weak ones inside stronger dropped."""
    return T.typed_spans(docs_of(spark, sf_dir))


STRONG = r"""WITH u AS (SELECT document_key AS doc_id, regexp_extract_all(text, '(?:^|[^\p{L}\p{N}_])(?:https?://|www\.)[^\s\x1c-\x1f\x{85}\p{Z}<>"''()]*[^\s\x1c-\x1f\x{85}\p{Z}<>"''().,;:!?]') AS m,
string_split_regex(text, '(?:^|[^\p{L}\p{N}_])(?:https?://|www\.)[^\s\x1c-\x1f\x{85}\p{Z}<>"''()]*[^\s\x1c-\x1f\x{85}\p{Z}<>"''().,;:!?]') AS g FROM annotated_docs WHERE text IS NOT NULL),
q AS (SELECT document_key AS doc_id, regexp_extract_all(text, '["“«][^"”»\n]{2,80}["”»]') AS m, string_split_regex(text, '["“«][^"”»\n]{2,80}["”»]') AS g FROM annotated_docs WHERE text IS NOT NULL),
a AS (SELECT 'url' AS kind, * FROM u UNION ALL SELECT 'quoted', * FROM q),
e AS (SELECT kind, doc_id, m, g, unnest(range(1, len(m) + 1)) AS i FROM a),
p AS (SELECT kind, doc_id, m[i] AS v, CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS INT) AS s FROM e),
t AS (SELECT kind, doc_id, s + CASE WHEN kind = 'quoted' OR NOT regexp_matches(v, '^(?:https?://|www\.)') THEN 1 ELSE 0 END AS s, CASE WHEN kind = 'quoted' THEN substr(v, 2, length(v) - 2) WHEN regexp_matches(v, '^(?:https?://|www\.)') THEN v ELSE substr(v, 2) END AS v FROM p),
z AS (SELECT kind, doc_id, s + length(v) - length(regexp_replace(v, '^[\s\x1c-\x1f\x{85}\p{Z}]+', '')) AS s, regexp_replace(v, '^[\s\x1c-\x1f\x{85}\p{Z}]+|[\s\x1c-\x1f\x{85}\p{Z}]+$', '', 'g') AS v FROM t)
SELECT DISTINCT doc_id, kind, CAST(s AS INT) AS start_pos, CAST(s + length(v) AS INT) AS end_pos, v AS value FROM z WHERE v <> ''"""


@query(sql=STRONG)
def typed_strong_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The typed values that nothing suppresses and whose pattern SQL can say: links and quotations."""
    return T.typed_spans(docs_of(spark, sf_dir), kinds=["url", "quoted"])


@query(sql=r"SELECT document_key AS doc_id, length(text) AS n FROM annotated_docs WHERE regexp_matches(text, '[^\s\x1c-\x1f\x{85}\p{Z}]')")
def documents_nonblank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with anything but blanks."""
    return T.not_blank(docs_of(spark, sf_dir)).select("doc_id", F.length("text").alias("n"))


LINES = """WITH l AS (SELECT document_key AS doc_id, string_split(text, chr(10)) AS p FROM annotated_docs WHERE text IS NOT NULL),
u AS (SELECT doc_id, unnest(p) AS t, unnest(range(len(p))) AS line FROM l),
o AS (SELECT doc_id, line, t, coalesce(sum(length(t) + 1) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_pos FROM u)"""


@query(sql=LINES + " SELECT doc_id, CAST(line AS INT) AS line, CAST(start_pos AS INT) AS start_pos, CAST(start_pos + length(t) AS INT) AS end_pos, t AS text FROM o")
def lines_with_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line with its place."""
    return T.lines_with_offsets(docs_of(spark, sf_dir))


EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
#: The same matches, but tried only where a run of such characters begins (or the last match ended), so that a long
#: unbroken code costs linear time.
EMAIL_FAST = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
NUMBER = r"[0-9]+(?:[.,][0-9]+)*"


def _spans_sql(pattern: str, table_name: str = "annotated_docs", key: str = "document_key") -> str:
    return f"""SELECT doc_id, CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS INT) AS start_pos,
CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + list_sum(list_transform(m[1:i], lambda x: length(x))) AS INT) AS end_pos, m[i] AS value
FROM (SELECT doc_id, g, m, unnest(range(1, len(m) + 1)) AS i FROM (SELECT {key} AS doc_id, string_split_regex(text, '{pattern}') AS g, regexp_extract_all(text, '{pattern}') AS m FROM {table_name} WHERE text IS NOT NULL))"""


@query(sql=_spans_sql(EMAIL))
def email_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Email addresses with their places, without leaving the JVM."""
    return T.pattern_spans(docs_of(spark, sf_dir), EMAIL_FAST)


@query(sql=_spans_sql(NUMBER))
def number_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers with their places."""
    return T.pattern_spans(docs_of(spark, sf_dir), NUMBER)


WORD = r"[\p{L}\p{N}_]+"


@query(sql=rf"SELECT doc_id, len(regexp_extract_all(text, '{WORD}')) AS n_tokens, CAST(floor(strlen(text) / 3) AS BIGINT) + 1 AS estimate FROM documents WHERE text IS NOT NULL")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each text and the token estimate that requests are packed by."""
    docs = table(spark, sf_dir, "documents").filter("text is not null")
    return docs.select("doc_id", F.size(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).cast("long").alias("n_tokens"), T.token_estimate(F.col("text")).alias("estimate"))


@query(sql=rf"""WITH w AS (SELECT document_key, regexp_extract_all(lower(text), '{WORD}') AS m FROM annotated_docs WHERE text IS NOT NULL),
g AS (SELECT unnest(list_transform(range(1, len(m)), lambda i: m[i] || ' ' || m[i + 1])) AS gram FROM w)
SELECT gram, count(*) AS n FROM g GROUP BY gram""")
def token_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each pair of neighbouring words occurs; pairs are counted before the shuffle."""
    words = docs_of(spark, sf_dir).select(F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0)).alias("m")).filter(F.size("m") > 1)
    pairs = F.transform(F.sequence(F.lit(1), F.size("m") - 1), lambda i: F.concat(F.element_at("m", i), F.lit(" "), F.element_at("m", i + 1)))
    return words.select(F.explode(pairs).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))


@query(sql=rf"""WITH t AS (SELECT DISTINCT lower(list_last(string_split(legal_name, ' '))) AS term FROM parties WHERE party_class = 'person'),
w AS (SELECT document_key AS doc_id, unnest(regexp_extract_all(lower(text), '{WORD}')) AS term FROM annotated_docs WHERE text IS NOT NULL)
SELECT doc_id, term, count(*) AS n FROM w JOIN t USING (term) GROUP BY doc_id, term""")
def gazetteer_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of a term list in each document: an equi join on the lower-case word."""
    terms = table(spark, sf_dir, "parties").filter("party_class = 'person'").select(F.lower(F.element_at(F.split("legal_name", " "), -1)).alias("term")).distinct()
    words = docs_of(spark, sf_dir).select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0))).alias("term"))
    counts = words.groupBy("doc_id", "term").agg(F.count("*").alias("n"))
    return counts.join(terms, "term").select("doc_id", "term", "n")


# ---- intervals

COVERED = f"""WITH e AS ({_spans_sql(EMAIL)}), n AS ({_spans_sql(NUMBER)})"""


@query(sql=COVERED + " SELECT n.* FROM n WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.doc_id = n.doc_id AND e.start_pos <= n.start_pos AND n.end_pos <= e.end_pos)")
def weak_span_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers that are no part of an email address."""
    return T.uncovered_spans(docs_of(spark, sf_dir), NUMBER, [EMAIL_FAST])


@query(sql=LINES + f", n AS ({_spans_sql(NUMBER)}) SELECT n.doc_id, n.start_pos, n.end_pos, n.value, CAST(line AS INT) AS sentence FROM n JOIN o ON o.doc_id = n.doc_id AND o.start_pos <= n.start_pos AND n.end_pos <= o.start_pos + length(t)")
def candidate_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each number with the line that holds it."""
    return T.spans_in_lines(docs_of(spark, sf_dir), NUMBER)


def placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "extractions").filter("start_pos is not null and end_pos is not null and document_key is not null")
    return rows.withColumnRenamed("start_pos", "s").withColumnRenamed("end_pos", "e").withColumnRenamed("document_key", "doc_id")


@query(sql="""SELECT document_key AS doc_id, start_pos AS s, end_pos AS e, array_to_string(list_sort(list_distinct(list(source))), ',') AS sources, min(priority) AS priority
FROM (SELECT document_key, start_pos, end_pos, unnest(sources) AS source, CASE kind WHEN 'entity' THEN 1 WHEN 'field' THEN 2 ELSE 3 END AS priority FROM extractions WHERE start_pos IS NOT NULL AND end_pos IS NOT NULL AND document_key IS NOT NULL) GROUP BY ALL""")
def candidate_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per span with all its sources and the best priority."""
    rank = F.when(F.col("kind") == "entity", 1).when(F.col("kind") == "field", 2).otherwise(3)
    rows = placed(spark, sf_dir).select("doc_id", "s", "e", F.explode("sources").alias("source"), rank.alias("priority"))
    return intervals.merge_candidates(rows, ["doc_id"]).withColumn("sources", F.array_join("sources", ","))


@query(sql="""SELECT extraction_id, doc_id, s, e FROM (SELECT extraction_id, document_key AS doc_id, start_pos AS s, end_pos AS e, row_number() OVER (PARTITION BY document_key ORDER BY priority, start_pos, end_pos, extraction_id) AS rank
FROM (SELECT *, CASE kind WHEN 'entity' THEN 1 ELSE 2 END AS priority FROM extractions WHERE start_pos IS NOT NULL AND end_pos IS NOT NULL AND document_key IS NOT NULL)) WHERE rank <= 5""")
def candidate_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's five best spans; the cap is the feature."""
    rows = placed(spark, sf_dir).withColumn("priority", F.when(F.col("kind") == "entity", 1).otherwise(2))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("priority", "s", "e", "extraction_id"))
    return rows.withColumn("rank", rank).filter("rank <= 5").select("extraction_id", "doc_id", "s", "e")


@query(sql="""WITH x AS (SELECT DISTINCT document_key AS doc_id, start_pos AS s, end_pos AS e FROM extractions WHERE start_pos IS NOT NULL AND end_pos IS NOT NULL AND document_key IS NOT NULL),
m AS (SELECT *, max(e) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM x),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s, e) AS island FROM m)
SELECT doc_id, min(s) AS s, max(e) AS e FROM i GROUP BY doc_id, island""")
def interval_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stretches of each document that extractions cover."""
    return intervals.merged_intervals(placed(spark, sf_dir), ["doc_id"])


@query(sql="""WITH x AS (SELECT DISTINCT document_key AS doc_id, extraction_text AS text, start_pos AS s FROM extractions WHERE start_pos IS NOT NULL AND document_key IS NOT NULL AND end_pos IS NOT NULL AND extraction_text IS NOT NULL)
SELECT doc_id, text, s, row_number() OVER (PARTITION BY doc_id, text ORDER BY s) AS k, count(*) OVER (PARTITION BY doc_id, text) AS n FROM x""")
def occurrence_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which occurrence of its text in the document each extraction is."""
    rows = placed(spark, sf_dir).select("doc_id", F.col("extraction_text").alias("text"), "s").dropna().distinct()
    return intervals.occurrence_ordinals(rows, ["doc_id", "text"])


@query(sql="""WITH x AS (SELECT document_key AS doc_id, start_pos AS s, end_pos AS e, extraction_class AS c, max(confidence) AS p FROM extractions
WHERE kind = 'entity' AND confidence IS NOT NULL AND start_pos IS NOT NULL AND end_pos IS NOT NULL AND document_key IS NOT NULL GROUP BY ALL),
o AS (SELECT doc_id, list([{'s': s, 'e': e, 'c': c, 'p': p}] ORDER BY floor(p / 0.1 + 1e-9) DESC, e - s DESC, s, c) AS l FROM x GROUP BY doc_id),
k AS (SELECT doc_id, unnest(list_reduce(l, lambda a, y: CASE WHEN len(list_filter(a, lambda k: k.s < y[1].e AND y[1].s < k.e)) > 0 THEN a ELSE list_concat(a, y) END)) AS k FROM o)
SELECT doc_id, k.s AS s, k.e AS e, k.c AS extraction_class, k.p AS confidence FROM k""")
def overlap_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entities of each document that stay when overlapping ones compete; repeated rows count once."""
    rows = placed(spark, sf_dir).filter("kind = 'entity' and confidence is not null")
    rows = rows.groupBy("doc_id", "s", "e", "extraction_class").agg(F.max("confidence").alias("confidence"))
    return intervals.without_overlaps(rows, ["doc_id"]).select("doc_id", "s", "e", "extraction_class", "confidence")


@query(sql="""WITH x AS (SELECT DISTINCT document_key AS doc_id, start_pos AS s, end_pos AS e, extraction_class FROM extractions WHERE kind <> 'sentence' AND start_pos IS NOT NULL AND end_pos IS NOT NULL AND document_key IS NOT NULL),
b AS (SELECT DISTINCT doc_id, unnest([s, e]) AS p FROM x), g AS (SELECT doc_id, p AS ps, lead(p) OVER (PARTITION BY doc_id ORDER BY p) AS pe FROM b),
o AS (SELECT g.doc_id, ps, pe, extraction_class, row_number() OVER (PARTITION BY g.doc_id, ps ORDER BY e - s, -s, extraction_class) AS r FROM g JOIN x ON x.doc_id = g.doc_id AND x.s <= ps AND pe <= x.e WHERE pe IS NOT NULL)
SELECT doc_id, ps AS s, pe AS e, extraction_class FROM o WHERE r = 1""")
def html_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The marked stretches of each document's page."""
    rows = placed(spark, sf_dir).filter("kind <> 'sentence'").select("doc_id", "s", "e", "extraction_class").distinct()
    return intervals.marked_segments(rows)


@query(sql="""SELECT extraction_class, count(*) AS n, sum(CASE WHEN substring(text, start_pos + 1, end_pos - start_pos) <> extraction_text THEN 1 ELSE 0 END) AS bad
FROM extractions JOIN annotated_docs USING (document_key) WHERE start_pos IS NOT NULL AND end_pos IS NOT NULL GROUP BY extraction_class""")
def groundedness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extractions of each class, and how many are not what stands at their place."""
    rows = placed(spark, sf_dir).join(docs_of(spark, sf_dir).select("doc_id", "text"), "doc_id")
    bad = F.expr("substring(text, s + 1, e - s) <> extraction_text").cast("int")
    return rows.groupBy("extraction_class").agg(F.count("*").alias("n"), F.coalesce(F.sum(bad), F.lit(0)).alias("bad"))


# ---- segmentation (sequential rules; brute-force tests instead of SQL)


@query
def sentences_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences by the engine's own splitter, none over 600 characters."""
    return T.sentence_spans(T.documents(docs_of(spark, sf_dir), "doc_id"))


@query
def windows_with_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of up to 800 characters and 8 sentences with the text around them."""
    return T.windows_with_context(T.documents(docs_of(spark, sf_dir), "doc_id"))


BLANK = r"[\s\x1c-\x1f\x{85}\p{Z}]"
NOT_BLANK = r"[^\s\x1c-\x1f\x{85}\p{Z}]"


@query(sql=LINES + f""", nb AS (SELECT doc_id, line, CAST(start_pos AS BIGINT) AS s, CAST(start_pos + length(t) AS BIGINT) AS e FROM o WHERE regexp_matches(t, '{NOT_BLANK}')),
g AS (SELECT doc_id, list([{{'f': k, 'l': k, 's': s, 'e': e}}] ORDER BY k) AS l FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line) - 1 AS k FROM nb) GROUP BY doc_id),
w AS (SELECT doc_id, list_reduce(l, lambda a, y: CASE WHEN y[1].f - a[-1].f < 8 AND y[1].e - a[-1].s <= 800 THEN list_concat(a[:-2], [{{'f': a[-1].f, 'l': y[1].f, 's': a[-1].s, 'e': y[1].e}}]) ELSE list_concat(a, y) END) AS w FROM g),
x AS (SELECT doc_id, unnest(w) AS w, unnest(range(len(w))) AS n FROM w), y AS (SELECT x.doc_id, n, w.f AS f, w.l AS l, w.s AS s, w.e AS e, greatest(w.s - 250, 0) AS lo, least(w.e + 250, length(text)) AS hi, text FROM x JOIN annotated_docs ON document_key = x.doc_id),
c AS (SELECT *, substr(text, lo + 1, s - lo) AS b, substr(text, e + 1, hi - e) AS a FROM y)
SELECT doc_id, CAST(n AS INT) AS "window", CAST(f AS INT) AS "first", CAST(l AS INT) AS "last", CAST(s AS INT) AS s, CAST(e AS INT) AS e,
regexp_replace(CASE WHEN lo > 0 AND regexp_matches(substr(text, lo, 1), '{NOT_BLANK}') THEN regexp_replace(b, '^{NOT_BLANK}*', '') ELSE b END, '^{BLANK}+|{BLANK}+$', '', 'g') AS "before",
regexp_replace(CASE WHEN hi < length(text) AND regexp_matches(substr(text, hi + 1, 1), '{NOT_BLANK}') THEN regexp_replace(a, '{NOT_BLANK}*$', '') ELSE a END, '^{BLANK}+|{BLANK}+$', '', 'g') AS "after" FROM c""")
def windows_of_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of up to 800 characters and 8 lines that are not blank, with the text around them."""
    return T.windows_with_context(docs_of(spark, sf_dir), lines=True)


@query
def candidate_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All candidate spans of every sentence, merged, ranked and capped."""
    schema = Schema.from_dict({"entities": {"town": {"description": "a town", "terms": ["Fairholt", "Kestrel Bay", "Novaluz"]}, "permit": {"description": "a permit", "patterns": [r"AGR-\d{4}-\d+"]}}})
    return T.candidate_spans(T.documents(docs_of(spark, sf_dir), "doc_id"), schema)


PERMIT = r"AGR-\d{4}-\d+"


@query(sql=f"SELECT CAST(doc_id AS VARCHAR) AS doc_id, start_pos AS s, end_pos AS e, value AS text FROM ({_spans_sql(PERMIT.replace(chr(92) + 'd', '[0-9]'))})")
def class_pattern_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a class's own pattern finds."""
    return T.regex_spans(docs_of(spark, sf_dir), [PERMIT])


@query(sql=f"""WITH x AS (SELECT extraction_id, start_pos AS s, end_pos AS e, text, greatest(start_pos - 25, 0) AS lo, least(end_pos + 25, length(text)) AS hi FROM extractions JOIN annotated_docs USING (document_key) WHERE start_pos IS NOT NULL AND end_pos IS NOT NULL AND text IS NOT NULL)
SELECT extraction_id, concat(CASE WHEN lo > 0 THEN '…' ELSE '' END, trim(regexp_replace(substr(text, lo + 1, hi - lo), '{BLANK}+', ' ', 'g')), CASE WHEN hi < length(text) THEN '…' ELSE '' END) AS snippet,
coalesce((['first', 'second', 'third', 'fourth', 'fifth', 'sixth', 'seventh', 'eighth', 'ninth', 'tenth'])[extraction_id % 12 + 1], '#' || CAST(extraction_id % 12 + 1 AS VARCHAR)) AS ordinal FROM x""")
def context_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each extraction with what stands around it."""
    rows = placed(spark, sf_dir).join(docs_of(spark, sf_dir).select("doc_id", "text"), "doc_id")
    return rows.select("extraction_id", T.snippet(F.col("text"), F.col("s"), F.col("e"), 25).alias("snippet"), T.ordinal_word(F.pmod("extraction_id", F.lit(12)) + 1).alias("ordinal"))


# ---- decisions

WEIGHT = "(('0x' || substr(md5(concat_ws('|', '', {parts})), 1, 8))::BIGINT % 1000 + 1) / 1000.0"
CLASSES = ["party", "person", "place", "date", "none"]


@query(sql=f"""WITH q AS (SELECT doc_id, unnest(range({len(CLASSES)})) AS o, unnest({CLASSES!r}) AS k FROM documents),
w AS (SELECT *, {WEIGHT.format(parts="'classify', CAST(doc_id AS VARCHAR), '', k")} AS w FROM q), n AS (SELECT *, w / sum(w) OVER (PARTITION BY doc_id) AS p FROM w),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY p DESC, o) AS r FROM n)
SELECT doc_id, max(CASE WHEN r = 1 THEN k END) AS choice, round(max(CASE WHEN r = 1 THEN p END), 6) AS p, round(max(CASE WHEN r = 1 THEN p END) - max(CASE WHEN r = 2 THEN p END), 6) AS margin,
CASE WHEN max(CASE WHEN r = 1 THEN p END) < 0.35 OR max(CASE WHEN r = 1 THEN p END) - max(CASE WHEN r = 2 THEN p END) < 0.05 THEN true ELSE false END AS needs_review FROM r GROUP BY doc_id""")
def top2_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised probabilities, the most probable class, its margin and whether it needs review."""
    criteria = F.array(*[F.struct(F.lit(c).alias("key"), F.lit(c).alias("value")) for c in CLASSES])
    q = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("key"), F.lit("choice").alias("type"), criteria.alias("criteria"), F.lit("classify").alias("role"), F.col("doc_id").cast("string").alias("subject"), F.lit("").alias("name"))
    got = decisions.validated(q, HashDecider().decide(q)).withColumn("t", decisions.top(F.col("probs")))
    review = needs_review(F.col("t.p"), F.col("t.margin"), Options(review_threshold=0.35, review_margin=0.05))
    return got.select("doc_id", F.col("t.choice").alias("choice"), F.round("t.p", 6).alias("p"), F.round("t.margin", 6).alias("margin"), review.alias("needs_review"))


def _tournament_sql() -> str:
    w = WEIGHT.format(parts="'classify', task, '', k")
    return f"""WITH t AS (SELECT CAST(project_id AS VARCHAR) AS task FROM projects), o AS (SELECT legal_name AS k, row_number() OVER (ORDER BY party_id) - 1 AS i FROM parties),
a AS (SELECT task, k, i // 254 AS g, i FROM t, o UNION ALL SELECT task, 'none', g, 1000000 FROM t, (SELECT DISTINCT i // 254 AS g FROM o)),
aw AS (SELECT *, {w} AS w FROM a), ap AS (SELECT *, w / sum(w) OVER (PARTITION BY task, g) AS p FROM aw),
ar AS (SELECT *, row_number() OVER (PARTITION BY task, g ORDER BY p DESC, i) AS r FROM ap),
won AS (SELECT task, k, row_number() OVER (PARTITION BY task ORDER BY p DESC, k DESC) AS i FROM ar WHERE r = 1 AND k <> 'none'),
b AS (SELECT task, k, i FROM won UNION ALL SELECT DISTINCT task, 'none', 1000000 FROM won), bw AS (SELECT *, {w} AS w FROM b), bp AS (SELECT *, w / sum(w) OVER (PARTITION BY task) AS p FROM bw),
br AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY p DESC, i) AS r FROM bp)
SELECT task, CASE WHEN k = 'none' THEN NULL ELSE k END AS choice, round(p, 6) AS p FROM br WHERE r = 1"""


@query(sql=_tournament_sql())
def tournament_winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One of all registered parties for each project, in rounds of at most 255 options."""
    # the options of one task are one array; parties is a fixed list of about 1,150
    options = table(spark, sf_dir, "parties").agg(F.transform(F.array_sort(F.collect_list(F.struct("party_id", "legal_name"))), lambda x: F.struct(x["legal_name"].alias("key"), x["legal_name"].alias("value"))).alias("criteria"))
    tasks = table(spark, sf_dir, "projects").select(F.col("project_id").cast("string").alias("task"), F.lit("").alias("state"), F.lit("which").alias("instructions"), F.col("project_id").cast("string").alias("subject"), F.lit("").alias("name"))
    tasks = tasks.withColumn("criteria", options.scalar())
    won = decisions.tournament(HashDecider(), tasks)
    return won.select("task", "choice", F.round("p", 6).alias("p"))


@query(sql="""SELECT e.extraction_id, CASE WHEN e.confidence >= coalesce(s.min_confidence, p.min_confidence) THEN 'accepted' ELSE 'low_confidence' END AS outcome
FROM extractions e JOIN projects p USING (project_id) LEFT JOIN schema_classes s ON s.project_id = e.project_id AND s.class_id = e.extraction_class WHERE e.confidence IS NOT NULL""")
def class_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Acceptance by the class's threshold, else the schema's."""
    rows = table(spark, sf_dir, "extractions").filter("confidence is not null").select("extraction_id", "project_id", F.col("extraction_class").alias("class_id"), "confidence")
    classes = table(spark, sf_dir, "schema_classes").select("project_id", "class_id", F.col("min_confidence").alias("own"))
    schemas = table(spark, sf_dir, "projects").select("project_id", "min_confidence")
    out = rows.join(schemas, "project_id").join(classes, ["project_id", "class_id"], "left")
    limit = F.coalesce(F.nanvl("own", F.lit(None).cast("double")), F.col("min_confidence"))
    return out.select("extraction_id", F.when(F.col("confidence") >= limit, "accepted").otherwise("low_confidence").alias("outcome"))


@query(sql=f"""WITH q AS (SELECT doc_id, unnest(range(5)) AS i FROM documents), w AS (SELECT *, {WEIGHT.format(parts="'attribute', CAST(doc_id AS VARCHAR), 'level', CAST(i AS VARCHAR)")} AS w FROM q)
SELECT doc_id, round(sum(i * w) / sum(w), 6) AS score FROM w GROUP BY doc_id""")
def score_expectation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of each document: the expectation over its levels, where no number is given."""
    criteria = F.array(*[F.struct(F.lit(str(k)).alias("key"), F.lit(f"level {k}").alias("value")) for k in range(5)])
    q = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("key"), F.lit("score").alias("type"), criteria.alias("criteria"), F.lit("attribute").alias("role"), F.col("doc_id").cast("string").alias("subject"), F.lit("level").alias("name"))
    return decisions.validated(q, HashDecider().decide(q)).select("doc_id", F.round("score", 6).alias("score"))


KNOWN = {"Fairholt": "town", "Kestrel Bay": "town", "Novaluz": "town"}


@query(sql="SELECT DISTINCT extraction_text AS subject, CASE WHEN extraction_text IN ('Fairholt', 'Kestrel Bay', 'Novaluz') THEN 'town' ELSE 'none' END AS choice, 0.9 AS p FROM extractions WHERE extraction_text IS NOT NULL")
def lookup_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each distinct mention's class by a list of known ones."""
    criteria = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(k).alias("value")) for k in ("town", "person", "none")])
    rows = table(spark, sf_dir, "extractions").select(F.col("extraction_text").alias("subject")).dropna().distinct()
    q = rows.select("subject", F.md5("subject").alias("key"), F.lit("").alias("state"), F.lit("choice").alias("type"), F.lit("which").alias("instructions"), criteria.alias("criteria"), F.lit("classify").alias("role"), F.lit("").alias("name"))
    got = decisions.validated(q, LookupDecider(spark, entities=KNOWN).decide(q)).withColumn("t", decisions.top(F.col("probs")))
    return got.select("subject", F.col("t.choice").alias("choice"), F.round("t.p", 6).alias("p"))


@query(sql=f"""WITH q AS (SELECT DISTINCT extraction_class AS c FROM extractions), o AS (SELECT c, unnest(range(3)) AS o, unnest(['a', 'b', 'none']) AS k FROM q),
w AS (SELECT *, {WEIGHT.format(parts="'classify', c, '', k")} AS w FROM o), r AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY w DESC, o) AS r FROM w)
SELECT c AS extraction_class, k AS choice, 0 AS asked_again FROM r WHERE r = 1""")
def cached_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions asked twice through the answer cache: the second time nothing reaches the decider."""
    criteria = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(k).alias("value")) for k in ("a", "b", "none")])
    rows = table(spark, sf_dir, "extractions").select("extraction_class").distinct()
    q = rows.select("extraction_class", F.col("extraction_class").alias("key"), F.col("extraction_class").alias("state"), F.lit("choice").alias("type"), F.lit("which").alias("instructions"), criteria.alias("criteria"), F.lit("classify").alias("role"), F.col("extraction_class").alias("subject"), F.lit("").alias("name"))
    cache = decisions.TableCache(f"{shared_dir(spark).rstrip('/')}/cache-{uuid.uuid4().hex}")
    decisions.CachedDecider(HashDecider(), cache).decide(q).count()
    again = decisions.CachedDecider(decisions.FailingDecider(HashDecider(), "true"), cache).decide(q)
    got = decisions.validated(q, again).withColumn("t", decisions.top(F.col("probs")))
    return got.select("extraction_class", F.col("t.choice").alias("choice"), F.col("error").isNotNull().cast("int").alias("asked_again"))


@query(sql="SELECT extraction_id, coalesce(start_pos, -1) AS start, coalesce(end_pos, -1) AS \"end\" FROM extractions")
def interval_accessors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each extraction begins and ends, -1 without an interval."""
    rows = table(spark, sf_dir, "extractions").select("extraction_id", F.when(F.col("start_pos").isNotNull() | F.col("end_pos").isNotNull(), F.struct("start_pos", "end_pos")).alias("char_interval"))
    return intervals.with_positions(rows).select("extraction_id", "start", "end")


@query(sql="SELECT count(*) AS rows, 1 AS first, count(*) AS last, count(*) AS numbers FROM documents")
def numbered_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbers that pages of documents get: from 1 without a gap."""
    rows = numbered(table(spark, sf_dir, "documents").select("doc_id"))
    return rows.agg(F.count("*").alias("rows"), F.min("number").cast("int").alias("first"), F.max("number").alias("last"), F.count_distinct("number").alias("numbers"))


@query(sql="SELECT CAST(document_key AS VARCHAR) AS doc_id, text FROM annotated_docs WHERE text IS NOT NULL")
def jsonl_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as JSON lines and read again."""
    path = f"{shared_dir(spark).rstrip('/')}/jsonl-{uuid.uuid4().hex}"
    docs = docs_of(spark, sf_dir).filter("text is not null")
    write_jsonl(docs.select(F.col("doc_id").cast("string").alias("document_id"), "text"), path)
    return read_jsonl(spark, path)


@query(sql="SELECT count(*) AS rows, count(document_id) AS given, count(DISTINCT document_id) AS ids, 0 AS without FROM annotated_docs")
def document_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row is a document: ids may be missing, and then are the row's number, or be used again."""
    docs = table(spark, sf_dir, "annotated_docs")
    ids = T.documents(docs, "document_id").select("doc_id", F.lit(1).alias("one"))
    known = docs.select(F.col("document_id").alias("doc_id")).dropna().distinct().withColumn("known", F.lit(1))
    return ids.join(known, "doc_id", "left").agg(F.count("*").alias("rows"), F.count("known").alias("given"), F.count_distinct(F.when(F.col("known") == 1, F.col("doc_id"))).alias("ids"), F.sum(F.col("doc_id").isNull().cast("int")).alias("without"))


@query(sql="SELECT document_key, sha256(concat(coalesce(model, ''), chr(0), text)) AS cache_key FROM annotated_docs WHERE text IS NOT NULL")
def answer_cache_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content keys of the cache."""
    docs = table(spark, sf_dir, "annotated_docs").filter("text is not null")
    return docs.select("document_key", F.sha2(F.concat_ws("\x00", F.coalesce("model", F.lit("")), "text"), 256).alias("cache_key"))


@query(sql="""WITH d AS (SELECT project_id, document_key AS k, CAST(floor(strlen(text) / 3) AS BIGINT) + 1 AS t FROM annotated_docs WHERE text IS NOT NULL),
l AS (SELECT project_id, list([{'k': k, 'r': 0::BIGINT, 'n': 1::BIGINT, 'u': t}] ORDER BY k, t) AS l FROM d GROUP BY project_id),
p AS (SELECT project_id, unnest(list_reduce(l, lambda a, y: list_concat(a, CASE WHEN a[-1].u + y[1].u <= 54400 AND a[-1].n < 200 THEN [{'k': y[1].k, 'r': a[-1].r, 'n': a[-1].n + 1, 'u': a[-1].u + y[1].u}] ELSE [{'k': y[1].k, 'r': a[-1].r + 1, 'n': 1::BIGINT, 'u': y[1].u}] END))) AS x FROM l)
SELECT project_id, CAST(x.k AS VARCHAR) AS document_key, CAST(x.r AS INT) AS request FROM p""")
def request_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each project's documents packed in order into requests under both limits."""
    docs = table(spark, sf_dir, "annotated_docs").filter("text is not null").select("project_id", "document_key", T.token_estimate(F.col("text")).alias("tokens"))
    return decisions.packed(docs, ["project_id"], "tokens", 54_400, 200, "document_key").withColumnRenamed("o", "document_key")


@query(sql="""SELECT document_key, round(sum(coalesce(input_tokens, 0) * 0.042 / 1e6) OVER (PARTITION BY project_id ORDER BY received_at, document_key ROWS UNBOUNDED PRECEDING), 9) AS spent_usd FROM annotated_docs""")
def running_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each project had spent when a document came in."""
    docs = table(spark, sf_dir, "annotated_docs").withColumn("tokens", F.coalesce("input_tokens", F.lit(0)))
    out = decisions.running_cost(docs.select("document_key", "project_id", "received_at", "tokens"), "tokens", ["project_id"], ["received_at", "document_key"])
    return out.select("document_key", F.round("spent_usd", 9).alias("spent_usd"))


@query(sql="""SELECT project_id, count(*) AS documents, sum(windows) AS windows, sum(candidates) AS candidates, coalesce(sum(input_tokens), 0) AS input_tokens, round(sum(cost_usd), 6) AS cost_usd FROM annotated_docs GROUP BY project_id""")
def metrics_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counters of each project's documents added up."""
    docs = table(spark, sf_dir, "annotated_docs")
    return docs.groupBy("project_id").agg(F.count("*").alias("documents"), F.sum("windows").alias("windows"), F.sum("candidates").alias("candidates"), F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"), F.round(F.sum("cost_usd"), 6).alias("cost_usd"))


@query(sql="SELECT stage, location, count(*) AS n, count(DISTINCT document_key) AS documents FROM (SELECT DISTINCT * FROM doc_errors) GROUP BY stage, location")
def errors_by_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct errors of each stage and place."""
    return table(spark, sf_dir, "doc_errors").distinct().groupBy("stage", "location").agg(F.count("*").alias("n"), F.countDistinct("document_key").alias("documents"))


@query(sql="""SELECT project_id, extraction_class, kind, count(*) AS n, sum(CASE WHEN reason IS NOT NULL THEN 1 ELSE 0 END) AS rejected, sum(CASE WHEN needs_review THEN 1 ELSE 0 END) AS review FROM extractions GROUP BY ALL""")
def rejected_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted, rejected and doubtful extractions of each class."""
    rows = table(spark, sf_dir, "extractions")
    return rows.groupBy("project_id", "extraction_class", "kind").agg(F.count("*").alias("n"), F.sum(F.col("reason").isNotNull().cast("int")).alias("rejected"), F.sum(F.coalesce(F.col("needs_review").cast("int"), F.lit(0))).alias("review"))


@query
def pipeline_extractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole pipeline with its default options over every document, with pseudo-probabilities for answers."""
    schema = Schema.from_dict({
        "entities": {"party": "a person or organisation", "amount": {"description": "money", "attributes": {"due": "bool", "role": ["price", "fee"]}}},
        "sentence_labels": {"obligation": "somebody must do something"}, "fields": {"total": {"description": "the total", "source": ["money"]}}, "min_confidence": 0.3,
    })
    result = extract(T.documents(docs_of(spark, sf_dir), "doc_id"), schema, HashDecider())
    return result.extractions.select("doc_id", "kind", "extraction_class", "extraction_text", "s", "e", F.round("confidence", 6).alias("confidence"), "needs_review")


# ---- decisions over spans


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.lines_with_offsets(docs_of(spark, sf_dir)).filter(F.length("text") > 0)


LABELS = ["obligation", "risk", "termination"]


@query(sql=LINES + f""", q AS (SELECT doc_id, line, t, unnest({LABELS!r}) AS k FROM o WHERE length(t) > 0), w AS (SELECT *, {WEIGHT.format(parts="'label', t, k, 'yes'")} AS p FROM q)
SELECT doc_id, CAST(line AS INT) AS line, k AS label, round(p, 6) AS p, p < 0.95 AS needs_review FROM w WHERE p >= 0.9""")
def sentence_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels that hold for a line, each asked as a yes-or-no question."""
    q = _lines(spark, sf_dir).withColumn("name", F.explode(F.array(*map(F.lit, LABELS))))
    q = q.select("doc_id", "line", F.col("text").alias("subject"), "name", F.concat_ws("/", "doc_id", "line", "name").alias("key"), F.lit("noul").alias("type"), F.array().cast("array<struct<key:string,value:string>>").alias("criteria"), F.lit("label").alias("role"))
    got = decisions.validated(q, HashDecider().decide(q)).filter("error is null and noul >= 0.9")
    return got.select("doc_id", "line", F.col("name").alias("label"), F.round("noul", 6).alias("p"), (F.col("noul") < 0.95).alias("needs_review"))


@query(sql=f"""WITH x AS (SELECT extraction_id, extraction_class AS c, extraction_text AS t FROM extractions WHERE kind = 'entity' AND extraction_text IS NOT NULL),
v AS (SELECT *, {WEIGHT.format(parts="'verify', t, c, 'yes'")} AS verify, {WEIGHT.format(parts="'attribute', t, 'role', 'provider'")} AS a, {WEIGHT.format(parts="'attribute', t, 'role', 'client'")} AS b, {WEIGHT.format(parts="'attribute', t, 'role', 'unknown'")} AS u FROM x)
SELECT extraction_id, round(verify, 6) AS verify, CASE WHEN a >= b AND a >= u THEN 'provider' WHEN b >= u THEN 'client' END AS role, round(greatest(a, b, u) / (a + b + u), 6) AS p FROM v WHERE verify >= 0.5""")
def verify_and_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities that pass the verification, with a closed attribute; an unknown value is null."""
    rows = table(spark, sf_dir, "extractions").filter("kind = 'entity' and extraction_text is not null").select("extraction_id", F.col("extraction_class").alias("name"), F.col("extraction_text").alias("subject"))
    none = F.array().cast("array<struct<key:string,value:string>>")
    v = rows.select("*", F.concat(F.lit("v"), "extraction_id").alias("key"), F.lit("noul").alias("type"), none.alias("criteria"), F.lit("verify").alias("role"))
    crit = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(k).alias("value")) for k in ("provider", "client", "unknown")])
    a = rows.select("extraction_id", F.lit("role").alias("name"), "subject", F.concat(F.lit("a"), "extraction_id").alias("key"), F.lit("choice").alias("type"), crit.alias("criteria"), F.lit("attribute").alias("role"))
    verified = decisions.validated(v, HashDecider().decide(v)).filter("noul >= 0.5").select("extraction_id", F.round("noul", 6).alias("verify"))
    decoded = decisions.validated(a, HashDecider().decide(a)).withColumn("t", decisions.top(F.col("probs")))
    decoded = decoded.select("extraction_id", F.when(F.col("t.choice") != "unknown", F.col("t.choice")).alias("role"), F.round("t.p", 6).alias("p"))
    return verified.join(decoded, "extraction_id")


@query(sql=f"""WITH x AS (SELECT DISTINCT document_key AS doc_id, extraction_text AS k FROM extractions WHERE kind = 'entity' AND normalized IS NOT NULL AND document_key IS NOT NULL AND extraction_text IS NOT NULL AND extraction_text <> 'none'),
a AS (SELECT doc_id, k, 0 AS esc FROM x UNION ALL SELECT DISTINCT doc_id, 'none', 1 FROM x), w AS (SELECT *, {WEIGHT.format(parts="'field', CAST(doc_id AS VARCHAR), 'value', k")} AS w FROM a),
p AS (SELECT *, w / sum(w) OVER (PARTITION BY doc_id) AS p FROM w), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY p DESC, esc, k) AS r FROM p)
SELECT doc_id, CASE WHEN esc = 1 THEN NULL ELSE k END AS choice, round(p, 6) AS p FROM r WHERE r = 1""")
def field_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One value of each document among its normalised mentions, or none; the SQL holds while no document has over 254."""
    rows = table(spark, sf_dir, "extractions").filter("kind = 'entity' and normalized is not null and document_key is not null and extraction_text is not null and extraction_text <> 'none'")
    options = rows.groupBy(F.col("document_key").alias("doc_id")).agg(F.array_sort(F.collect_set("extraction_text")).alias("o"))
    task = F.col("doc_id").cast("string")
    tasks = options.select(task.alias("task"), F.lit("").alias("state"), F.lit("which").alias("instructions"), task.alias("subject"), F.lit("value").alias("name"), F.transform("o", lambda x: F.struct(x.alias("key"), x.alias("value"))).alias("criteria"))
    won = decisions.tournament(HashDecider(), tasks, role="field")
    return won.select(F.col("task").cast("long").alias("doc_id"), "choice", F.round("p", 6).alias("p"))


@query(sql=rf"""WITH m AS (SELECT document_key AS doc_id, regexp_extract_all(text, '{WORD}') AS m FROM annotated_docs WHERE text IS NOT NULL), t AS (SELECT doc_id, unnest(range(len(m))) AS token, unnest(m) AS t FROM m),
w AS (SELECT doc_id, token FROM t WHERE {WEIGHT.format(parts="'tag', t, '', 'yes'")} >= 0.7), i AS (SELECT *, token - row_number() OVER (PARTITION BY doc_id ORDER BY token) AS g FROM w)
SELECT doc_id, CAST(min(token) AS INT) AS first, CAST(max(token) AS INT) AS last, count(*) AS n FROM i GROUP BY doc_id, g""")
def tag_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of words that a tagger marks."""
    words = docs_of(spark, sf_dir).filter("text is not null").select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("token", "subject"))
    q = words.select("doc_id", "token", "subject", F.concat_ws("/", "doc_id", "token").alias("key"), F.lit("noul").alias("type"), F.array().cast("array<struct<key:string,value:string>>").alias("criteria"), F.lit("tag").alias("role"), F.lit("").alias("name"))
    # yes-or-no weights need no distribution: the answer column is taken as it is, and no join back is needed
    marked = q.withColumn("p", (HashDecider().weight(F.col("role"), F.col("subject"), F.col("name"), F.lit("yes")) + 1) / F.lit(1000.0))
    return intervals.islands(marked, ["doc_id"], "token", "p >= 0.7")


@query(sql="SELECT document_key AS doc_id, len(string_split_regex(text, '[.!?]+[ \n]+')) AS pieces FROM annotated_docs WHERE text IS NOT NULL")
def sentence_simple_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many pieces the crudest splitting rule gives, to compare the splitters with."""
    docs = docs_of(spark, sf_dir).filter("text is not null")
    return docs.select("doc_id", F.size(F.split("text", r"[.!?]+[ \n]+", -1)).cast("long").alias("pieces"))


# ---- quantities


@query
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dimension and amount in common units of every measured value."""
    return quantities.found(table(spark, sf_dir, "extractions"), table(spark, sf_dir, "annotated_docs"))


@query
def p4_dimension_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each project's measured values by dimension, in common units."""
    found = quantities.found(table(spark, sf_dir, "extractions"), table(spark, sf_dir, "annotated_docs"))
    projects = table(spark, sf_dir, "extractions").select("extraction_id", "project_id")
    return cut(found).join(projects, "extraction_id").groupBy("project_id", "dimension").agg(F.count("*").alias("n"), F.min("amount").alias("least"), F.max("amount").alias("most"), F.round(F.avg("amount"), 3).alias("mean"))


# ---- the plain relational surface


@query(sql="""SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus""")
def star_pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A partial aggregation before one small shuffle."""
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))


@query(sql="""SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""")
def star_nation_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A join of four tables; the engine picks the join strategies by size."""
    t = lambda name: table(spark, sf_dir, name)
    rows = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))
