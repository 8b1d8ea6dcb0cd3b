"""Field rules, question routing and answer parsing over text columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schemas
from ..functions import normalize as N
from ..functions import parse as P
from ..plans.graph_text import cleaned
from ..plans.planner import decomposition, routes
from .base import CTE, reviews, table

ESCAPED = lambda words: ", ".join(f"'{w}'" for w in words)


def parse_age_range(spark, d):
    return reviews(spark, d).select("row_idx", N.age_range(F.col("age")).alias("a")).select("row_idx", F.col("a.lo").cast("long").alias("age_lower"), F.col("a.hi").cast("long").alias("age_upper"))


AGE_SQL = f"""{CTE}, a AS (SELECT row_idx, lower(trim(age)) AS t FROM reviews),
b AS (SELECT row_idx, t, TRY_CAST(nullif(regexp_extract(t, '(\\d+)', 1), '') AS BIGINT) AS f,
  TRY_CAST(nullif(regexp_extract(t, '^(\\d+)\\s*-\\s*(\\d+)', 1), '') AS BIGINT) AS lo, TRY_CAST(nullif(regexp_extract(t, '^(\\d+)\\s*-\\s*(\\d+)', 2), '') AS BIGINT) AS hi FROM a)
SELECT row_idx, CASE WHEN contains(t, 'or over') OR contains(t, '+') THEN f WHEN lo IS NOT NULL THEN lo WHEN contains(t, '<') THEN CASE WHEN f IS NOT NULL THEN 0 END ELSE TRY_CAST(nullif(regexp_extract(t, '^([0-9]+)$', 1), '') AS BIGINT) END AS age_lower,
  CASE WHEN contains(t, 'or over') OR contains(t, '+') THEN CASE WHEN f IS NOT NULL THEN 999 END WHEN lo IS NOT NULL THEN hi WHEN contains(t, '<') THEN f - 1 ELSE TRY_CAST(nullif(regexp_extract(t, '^([0-9]+)$', 1), '') AS BIGINT) END AS age_upper FROM b"""


def severity_normalize(spark, d):
    return reviews(spark, d).select("row_idx", N.severity(F.col("severity_text")).alias("severity"))


def category_map(spark, d):
    brands = list(schemas.BRANDS)
    named = F.element_at(F.array(*map(F.lit, [*brands, "Unknown"])), (F.col("c_custkey") % 8 + 1).cast("int"))
    return table(spark, d, "customer").select("c_custkey", named.alias("brand")).select("c_custkey", "brand", N.dosage_form(F.col("brand")).alias("dosage_form"))


CATEGORY_SQL = f"""WITH b AS (SELECT c_custkey, list_extract([{ESCAPED([*schemas.BRANDS, 'Unknown'])}], c_custkey % 8 + 1) AS brand FROM customer)
SELECT c_custkey, brand, CASE {' '.join(f"WHEN lower(brand) IN ({ESCAPED(v)}) THEN '{k}'" for k, v in schemas.DOSAGE_FORMS.items())} END AS dosage_form FROM b"""


def approval_flag(spark, d):
    named = F.element_at(F.array(*map(F.lit, schemas.BRANDS)), (F.col("row_idx") % 7 + 1).cast("int"))
    return reviews(spark, d).withColumn("brand", named).select("row_idx", N.approval(F.col("brand"), F.col("condition")).alias("status"))


APPROVAL_SQL = f"""{CTE}, b AS (SELECT row_idx, condition, list_extract([{ESCAPED(schemas.BRANDS)}], row_idx % 7 + 1) AS brand FROM reviews)
SELECT row_idx, CASE WHEN {' OR '.join(f"(lower(brand) IN ({ESCAPED(v)}) AND contains(lower(condition), '{k}'))" for k, v in schemas.INDICATIONS.items())} THEN 'approval' ELSE 'off_label' END AS status FROM b"""


def condition_override(spark, d):
    return reviews(spark, d).select("row_idx", N.condition_name(F.col("condition")).alias("condition"))


def duration_override(spark, d):
    return reviews(spark, d).select("row_idx", N.duration(F.col("medication_duration")).alias("duration"))


def date_normalize(spark, d):
    told = F.when(F.col("o_orderkey") % 9 == 0, "no date").otherwise(F.date_format("o_orderdate", "M/d/yyyy"))
    return table(spark, d, "orders").select("o_orderkey", N.iso_date(told).alias("day"))


def normalize_term(spark, d):
    padded = F.concat(F.lit(" \t"), "p_name", F.lit("\n "))
    return table(spark, d, "part").select("p_partkey", F.lower(N.strip(padded)).alias("term"))


def keywords_non_numeric(spark, d):
    words = F.split(F.concat_ws(" ", "p_brand", F.col("p_size").cast("string"), F.lit("1e3 nan abc"), "p_type"), " ")
    return table(spark, d, "part").select("p_partkey", F.array_join(F.filter(words, lambda w: ~N.is_numeric(w)), " ").alias("words"))


def url_paging(spark, d):
    url = N.paged_url(F.col("url"))
    return table(spark, d, "pages").select("page_id", url.alias("first_url"), N.page_url(url, 3).alias("third_url"))


def pipe_split_fields(spark, d):
    text = F.concat(F.lit(" "), "c_name", F.lit(" | "), F.when(F.col("c_custkey") % 3 > 0, "25-34").otherwise(""), F.lit(" | Female | "), F.when(F.col("c_custkey") % 2 > 0, "On medication for 1 year").otherwise("no duration"), F.lit(" | Patient"))
    return table(spark, d, "customer").select("c_custkey", N.pipe_fields(text).alias("f")).select("c_custkey", "f.*")


PIPE_SQL = """WITH t AS (SELECT c_custkey, list_filter(list_transform(string_split(concat(' ', c_name, ' | ', CASE WHEN c_custkey % 3 > 0 THEN '25-34' ELSE '' END, ' | Female | ', CASE WHEN c_custkey % 2 > 0 THEN 'On medication for 1 year' ELSE 'no duration' END, ' | Patient'), '|'), lambda x: trim(x)), lambda x: x <> '') AS p FROM customer)
SELECT c_custkey, p[1] AS "user", p[2] AS age, p[3] AS gender, CASE WHEN contains(p[4], 'On medication for') THEN trim(replace(p[4], 'On medication for', '')) END AS duration, p[5] AS patient_type FROM t"""

QUESTION = "concat(['What is the average rating of ', 'Tell me about ', 'Which side effect does this cause: ', 'Do users say they like '][CAST(conv_id % 4 AS INT) + 1], ['Wegovy', 'saxenda or OZEMPIC', 'no product', 'Zepbound'][CAST(turn % 4 AS INT) + 1], '? ', text)"


def _questions(spark, d):
    first = F.element_at(F.array(*map(F.lit, ["What is the average rating of ", "Tell me about ", "Which side effect does this cause: ", "Do users say they like "])), (F.col("conv_id") % 4 + 1).cast("int"))
    second = F.element_at(F.array(*map(F.lit, ["Wegovy", "saxenda or OZEMPIC", "no product", "Zepbound"])), (F.col("turn") % 4 + 1).cast("int"))
    return table(spark, d, "conversations").withColumn("q", F.concat(first, second, F.lit("? "), "text"))


def route_keywords(spark, d):
    return _questions(spark, d).select("conv_id", "turn", *routes(F.col("q"))[:3])


def entity_extract(spark, d):
    return _questions(spark, d).select("conv_id", "turn", routes(F.col("q"))[3])


_ANY = lambda words: "(" + " OR ".join(f"contains(lower(q), '{w}')" for w in words) + ")"
_ENTITY = "coalesce(" + ", ".join(f"CASE WHEN contains(lower(q), '{b.lower()}') THEN '{b}' END" for b in schemas.BRANDS) + ")"
ROUTE_SQL = f"""WITH q AS (SELECT conv_id, turn, {QUESTION} AS q FROM conversations)
SELECT conv_id, turn, {_ANY(schemas.GRAPH_KEYWORDS)} AS to_graph, {_ANY(schemas.TABLE_KEYWORDS)} AS to_table, {_ANY(schemas.SUMMARY_KEYWORDS)} AND {_ENTITY} IS NOT NULL AS is_summary FROM q"""
ENTITY_SQL = f"WITH q AS (SELECT conv_id, turn, {QUESTION} AS q FROM conversations) SELECT conv_id, turn, {_ENTITY} AS entity FROM q"


def truncate_text(spark, d):
    return table(spark, d, "documents").select("doc_id", F.length(N.truncated(F.col("text"), 1000, "... (truncated)")).cast("long").alias("n"), F.md5(N.truncated(F.col("text"), 1000, "... (truncated)")).alias("digest"))


def token_budget(spark, d):
    own = N.token_estimate(F.col("text"))
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.sum(own).alias("tokens"), F.greatest(F.lit(1000), F.lit(128_000 - 1024) - F.sum(own)).alias("left"))


FENCED = "concat('Thought: look\n```json\n', props, '\n```\nThought: done', CASE WHEN event_id % 3 = 0 THEN concat('\nFinal Answer: ', event_type) ELSE '' END)"


def _fenced(spark, d):
    tail = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("\nFinal Answer: "), "event_type")).otherwise("")
    return table(spark, d, "events").withColumn("a", F.concat(F.lit("Thought: look\n```json\n"), "props", F.lit("\n```\nThought: done"), tail))


#: Model texts of several shapes, malformed ones too, and what is found in each, as SQL: {p} is props, {t} the event's type.
FENCED_JSON = (
    ("Thought: look\n```json\n{p}\n```\nThought: done", "props"),
    ("```JSON {p}``` and ```json [1]```", "props"),
    ("no block, but {p}", "NULL"),
    ("```json\n{p} without an end", "NULL"),
    ("```python\n{t}\n```", "NULL"),
    ("```json```", "NULL"),
)
FENCED_CODE = (
    ("run `df.{t}` now", "'df.' || event_type"),
    (" {t} ", "event_type"),
    ("```python\ndf.{t}\n```", "'df.' || event_type"),
    ("first ```\n{t}\n``` then ```\nother\n```", "event_type"),
    ("``` {t}", "'``` ' || event_type"),
    ("`` {t}", "'`` ' || event_type"),
)
BALANCED = (
    ('so it is {"a": {p}} and }', "'{\"a\": ' || props || '}'"),
    ("[1, {p}] then {2}", "'[1, ' || props || ']'"),
    ("open {p", "NULL"),
    ("none of {t}", "CASE WHEN contains(event_type, '{') THEN '' END"),
    ("{[}] {p}", "'{[}'"),
    ("[ ```json\n{p}\n``` ]", "props"),
)
LITERALS = (
    ("{'k': None, 'name': '{t}', 'on': True}", "'{\"k\": null, \"name\": \"' || event_type || '\", \"on\": true}'"),
    ("['{t}', (1, 2), -3.5]", "'[\"' || event_type || '\", [1, 2], -3.5]'"),
    ("open('{t}')", "NULL"),
    ("{'a': [", "NULL"),
    ("  ", "NULL"),
    ("{'q': \"it's {t}\"}", "'{\"q\": \"it''s ' || event_type || '\"}'"),
)


def _shaped(shapes):
    """The shape of the event's number, filled in."""
    texts = (F.replace(F.replace(F.lit(x), F.lit("{p}"), F.col("props")), F.lit("{t}"), F.col("event_type")) for x, _ in shapes)
    return F.get(F.array(*texts), (F.col("event_id") % len(shapes)).cast("int"))


def _shaped_sql(shapes, name):
    cases = " ".join(f"WHEN {i} THEN {found}" for i, (_, found) in enumerate(shapes))
    return f"SELECT event_id, CASE event_id % {len(shapes)} {cases} END AS {name} FROM events"


def extract_fenced_json(spark, d):
    return table(spark, d, "events").select("event_id", P.fenced_json(_shaped(FENCED_JSON)).alias("found"))


def extract_fenced_code(spark, d):
    return table(spark, d, "events").select("event_id", P.fenced_code(_shaped(FENCED_CODE)).alias("found"))


def extract_final_answer(spark, d):
    return _fenced(spark, d).select("event_id", P.final_answer(F.col("a")).alias("answer"), P.is_final(F.col("a")).alias("is_final"))


def balanced_json(spark, d):
    return table(spark, d, "events").select("event_id", P.balanced_json(_shaped(BALANCED)).alias("found"))


def python_literals(spark, d):
    return table(spark, d, "events").select("event_id", P.literal_to_json(_shaped(LITERALS)).alias("json"))


#: Decompositions of a question, {x} being the turn's text as JSON: whether each is a comparison, and its number of parts.
DECOMPOSED = (
    ('{"is_comparison": true, "results": [{"entity": "Wegovy", "sub_questions": [{x}, "b?"]}, {"entity": "Ozempic", "sub_questions": ["a?"]}]}', True, 2),
    ('{"is_comparison": true, "results": [{"entity": " ", "sub_questions": [{x}]}]}', False, 0),
    ('{"is_comparison": true, "results": [{"entity": "Ozempic", "sub_questions": []}]}', False, 0),
    ('{"is_comparison": true, "results": []}', False, 0),
    ('{"is_comparison": false, "results": [{"entity": "x", "sub_questions": [{x}]}]}', False, 0),
    ("[{x}]", False, 0),
    ('{"is_comparison": true, "results": [{"entity": "x", "sub_questions": [{x}, ""]}]}', False, 0),
    ('{"is_comparison": true, "results": [{"sub_questions": [{x}]}', False, 0),
)


GENERATED = (
    ("MATCH (d) RETURN d // {t}", "'MATCH (d) RETURN d // ' || event_type"),
    (" match (d) RETURN d\n```", "'match (d) RETURN d'"),
    ("```cypher\nMATCH (d:{t}) RETURN d\n```", "NULL"),
    ("Error: {t}", "NULL"),
    ("MATCH ```cypher (d:{t})``` RETURN d", "'MATCHcypher (d:' || event_type || ') RETURN d'"),
)


def graph_text_cleanup(spark, d):
    return table(spark, d, "events").select("event_id", cleaned(_shaped(GENERATED)).alias("query"))


def decompose_validate(spark, d):
    """Every turn inside a decomposition of some shape, validated by rule."""
    quoted = F.regexp_extract(F.to_json(F.array(F.concat(F.lit("q "), "text"))), r"(?s)^\[(.*)\]$", 1)
    told = F.get(F.array(*(F.replace(F.lit(x), F.lit("{x}"), quoted) for x, _, _ in DECOMPOSED)), ((F.col("conv_id") + F.col("turn")) % len(DECOMPOSED)).cast("int"))
    found = table(spark, d, "conversations").select("conv_id", "turn", decomposition(told).alias("a"))
    return found.select("conv_id", "turn", "a.is_comparison", F.size("a.results").cast("long").alias("n"))


DECOMPOSED_SQL = f"""SELECT conv_id, turn, {' OR '.join(f'(conv_id + turn) % {len(DECOMPOSED)} = {i}' for i, x in enumerate(DECOMPOSED) if x[1])} AS is_comparison,
CAST(CASE (conv_id + turn) % {len(DECOMPOSED)} {' '.join(f'WHEN {i} THEN {x[2]}' for i, x in enumerate(DECOMPOSED))} END AS BIGINT) AS n FROM conversations"""


QUERIES = {
    "parse_age_range": (parse_age_range, AGE_SQL),
    "severity_normalize": (severity_normalize, f"{CTE}, t AS (SELECT row_idx, lower(trim(severity_text)) AS s FROM reviews) SELECT row_idx, CASE WHEN s IN ('mild', 'moderate', 'severe') THEN upper(s[1]) || s[2:] END AS severity FROM t"),
    "category_map": (category_map, CATEGORY_SQL),
    "approval_flag": (approval_flag, APPROVAL_SQL),
    "condition_override": (condition_override, f"{CTE} SELECT row_idx, CASE WHEN condition IS NOT NULL AND condition <> '' AND lower(trim(condition)) <> 'other' THEN condition ELSE 'Other' END AS condition FROM reviews"),
    "duration_override": (duration_override, f"{CTE} SELECT row_idx, CASE WHEN trim(medication_duration) <> '' AND lower(trim(medication_duration)) <> 'nan' THEN trim(medication_duration) END AS duration FROM reviews"),
    "date_normalize": (date_normalize, "SELECT o_orderkey, CASE WHEN o_orderkey % 9 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders"),
    "normalize_term": (normalize_term, "SELECT p_partkey, lower(trim(p_name)) AS term FROM part"),
    "keywords_non_numeric": (keywords_non_numeric, "SELECT p_partkey, array_to_string(list_filter(string_split(concat_ws(' ', p_brand, CAST(p_size AS VARCHAR), '1e3 nan abc', p_type), ' '), lambda w: TRY_CAST(w AS DOUBLE) IS NULL), ' ') AS words FROM part"),
    "url_paging": (url_paging, "WITH u AS (SELECT page_id, CASE WHEN contains(url, 'page=') THEN url WHEN contains(url, '?') THEN url || '&page=1&next_page=true' ELSE url || '?page=1&next_page=true' END AS first_url FROM pages) SELECT page_id, first_url, replace(first_url, 'page=1', 'page=3') AS third_url FROM u"),
    "pipe_split_fields": (pipe_split_fields, PIPE_SQL),
    "route_keywords": (route_keywords, ROUTE_SQL),
    "entity_extract": (entity_extract, ENTITY_SQL),
    "truncate_text": (truncate_text, "WITH t AS (SELECT doc_id, CASE WHEN length(text) > 1000 THEN substr(text, 1, 1000) || '... (truncated)' ELSE text END AS s FROM documents) SELECT doc_id, length(s) AS n, md5(s) AS digest FROM t"),
    "token_budget": (token_budget, "SELECT conv_id, CAST(sum(ceil(length(text) / 3.5)) AS BIGINT) AS tokens, CAST(greatest(1000, 128000 - 1024 - sum(ceil(length(text) / 3.5))) AS BIGINT) AS \"left\" FROM conversations GROUP BY 1"),
    "extract_fenced_json": (extract_fenced_json, _shaped_sql(FENCED_JSON, "found")),
    "extract_fenced_code": (extract_fenced_code, _shaped_sql(FENCED_CODE, "found")),
    "extract_final_answer": (extract_final_answer, f"WITH a AS (SELECT event_id, {FENCED} AS a FROM events) SELECT event_id, trim(CASE WHEN contains(a, 'Final Answer:') THEN split_part(a, 'Final Answer:', 2) ELSE string_split(a, 'Thought:')[-1] END) AS answer, contains(lower(a), 'final answer:') AS is_final FROM a"),
    "balanced_json": (balanced_json, _shaped_sql(BALANCED, "found")),
    "python_literals": (python_literals, _shaped_sql(LITERALS, "json")),
    "graph_text_cleanup": (graph_text_cleanup, _shaped_sql(GENERATED, "query")),
    "decompose_validate": (decompose_validate, DECOMPOSED_SQL),
}
