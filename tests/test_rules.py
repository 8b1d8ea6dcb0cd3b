"""Field rules, documents, graph order, profiles, HTML and plans on invented rows."""

import json
import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestrata import schemas
from lodestrata.functions import nested, normalize, parse
from lodestrata.operators import graph, profile, standardize, vector
from lodestrata.plans import answer, planner
from lodestrata.plans.ir import GraphQuery, Hop, TableQuery
from lodestrata.sources import html, paged, tables
from lodestrata.streaming import graph_upsert


def one(spark, column, values, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in rows.select("i", column(F.col("v")).alias("x")).orderBy("i").collect()]


def test_age_ranges(spark):
    found = one(spark, normalize.age_range, ["65-74", "75 or over", "80+", "< 18", "42", "n/a", None, " 25 - 34 ", "about 30-40", "Female", "<", "+"])
    assert [tuple(x) for x in found] == [(65, 74), (75, 999), (80, 999), (0, 17), (42, 42), (None, None), (None, None), (25, 34), (None, None), (None, None), (None, None), (None, None)]


def test_severity_duration_condition_and_dates(spark):
    assert one(spark, normalize.severity, ["severe", " MODERATE ", "very bad", None, "", "Mild\n"]) == ["Severe", "Moderate", None, None, None, "Mild"]
    assert one(spark, normalize.duration, [" 1 year ", "nan", "NaN ", "", None]) == ["1 year", None, None, None, None]
    assert one(spark, normalize.condition_name, [" other ", None, "", "Obesity", "OTHER"]) == ["Other", "Other", "Other", "Obesity", "Other"]
    assert one(spark, normalize.iso_date, ["1/2/2024", "12/31/2023", "soon", None]) == ["2024-01-02", "2023-12-31", None, None]
    assert one(spark, normalize.dosage_form, ["WEGOVY", "Rybelsus", "x", None]) == ["subcutaneous injection", "oral", None, None]


def test_substring_rules(spark):
    assert one(spark, lambda c: normalize.first_of(c, list(schemas.BRANDS)), ["saxenda before Wegovy", "none", None]) == ["Wegovy", None, None]
    assert one(spark, lambda c: normalize.contains_any(c, ["pros"]), ["prostate", "PROS?", "x"]) == [True, True, False]
    assert one(spark, lambda c: normalize.page_url(c, 4), ["u?page=1", "u?page=10"]) == ["u?page=4", "u?page=40"]
    assert [x.duration for x in one(spark, normalize.pipe_fields, ["A | 1 | F | On medication for 2 years | Patient", "A | 1"])] == ["2 years", None]


def test_answers_out_of_model_text(spark):
    text = "Thought: a\n```JSON\n{\"a\": 1}\n```\nThought: b"
    assert one(spark, parse.fenced_json, [text, "x"]) == ['{"a": 1}', None]
    assert one(spark, parse.fenced_code, ["```python\ndf.x\n```", "use `df.y` now", " plain "]) == ["df.x", "df.y", "plain"]
    assert one(spark, parse.final_answer, ["Final Answer: 3\nfinal answer: 4", text, "last"]) == ["3\nfinal answer: 4", "b", "last"]
    assert one(spark, parse.balanced_json, ["a {\"b\": [1, {}]} c}", "[1] {2}", "none", None, "{open"]) == ['{"b": [1, {}]}', "[1]", None, None, None]
    assert one(spark, parse.literal_to_json, ["{'a': None}", "import os", None]) == ['{"a": null}', None, None]


INFO = {"drug": {"name": "model says", "dosage": "5 mg"}, "condition": {"name": "y", "severity": "Mild"}, "side_effects": [{"name": ["a", " b "], "severity": "SEVERE", "associated_drug": ""}, {"name": "c", "severity": "bad", "associated_drug": "Z"}]}


def test_documents_parse_process_and_relate(spark):
    rows = [(1, json.dumps(INFO), "Wegovy", "Obesity", " 2 years "), (2, "{oops", "Wegovy", None, None), (3, '{"drug": {}}', "W", None, None), (4, " ", "W", None, None), (5, json.dumps(INFO | {"condition": None}).replace("5 mg", "NaN"), "W", None, "nan")]
    df = spark.createDataFrame(rows, "i int, t string, brand_name string, condition string, medication_duration string").withColumn("info", nested.parsed_info(F.col("t")))
    out = {r.i: r for r in standardize.post_processed(df).collect()}
    assert [out[i].info is None for i in (1, 2, 3, 4, 5)] == [False, True, True, True, False]
    info = out[1].info
    assert (info.drug.name, info.drug.duration, info.condition.name, info.condition.severity) == ("Wegovy", "2 years", "Obesity", "Mild")
    assert [(e.name, e.severity, e.associated_drug) for e in info.side_effects] == [(["a", " b "], "Severe", "Wegovy"), (["c"], None, "Z")]
    assert [(r.relation, r.end.properties.name, r.properties.severity) for r in out[1].relations] == [("treats", "Obesity", None), ("causes", "a", "Severe"), ("causes", " b ", "Severe"), ("causes", "c", None)]
    assert (out[5].info.condition.name, out[5].info.condition.severity) == ("Other", None)


def test_standardised_names_and_approval(spark):
    df = spark.createDataFrame([(1, json.dumps(INFO), "Wegovy", "weight loss", None), (2, json.dumps(INFO), "Ozempic", "weight loss", None)], "i int, t string, brand_name string, condition string, medication_duration string")
    rows = standardize.post_processed(df.withColumn("info", nested.parsed_info(F.col("t"))))
    assert sorted(r.term for r in standardize.distinct_terms(rows).collect()) == ["a", "b", "c"]
    matches = spark.createDataFrame([("b", "Better"), ("c", None)], "term string, standard string")
    out = {r.i: r for r in standardize.standardized(rows, matches, "i").collect()}
    assert [e.name for e in out[1].info.side_effects] == [["a", "better"], ["c"]]
    assert [(r.properties.approval, r.properties.off_label) for r in (out[1].relations[0], out[2].relations[0])] == [("yes", "no"), ("no", "yes")]
    assert standardize.standardized(rows, matches.limit(0), "i").count() == 2


def test_graph_order_last_writer_and_lost_edges(spark):
    nodes = spark.createDataFrame([(1, "Drug", "d", "5"), (3, "Drug", "d", None), (2, "SideEffect", "e", "x"), (4, "SideEffect", "", "x")], "row_idx int, label string, name string, p string")
    table = graph.nodes(nodes, ["p"], ["row_idx"])
    assert {(r.label, r.name): (r.p, r.first_seen) for r in table.collect()} == {("Drug", "d"): (None, 1), ("SideEffect", "e"): ("x", 2)}
    edge = "row_idx int, src_label string, src string, rel string, dst_label string, dst string, s string"
    rows = spark.createDataFrame([(1, "Medication", "d", "causes", "SideEffect", "e", "early"), (2, "Medication", "d", "causes", "SideEffect", "e", "a"), (5, "Drug", "d", "causes", "SideEffect", "e", None), (5, "Drug", "other", "causes", "SideEffect", "e", "b"), (5, "Thing", "d", "causes", "SideEffect", "e", "b")], edge)
    out = graph.edges(rows, table, ["s"], ["row_idx"]).collect()
    assert [(r.src_label, r.rel, r.s, r.report_count) for r in out] == [("Drug", "CAUSES", None, 2)]
    assert graph.edges(rows, table, ["s"], ["row_idx"], order_sensitive=False).first().report_count == 3
    assert graph.duplicate_names(table).count() == 0


def test_graph_rows_equal_in_order_have_one_winner(spark):
    nodes = [(1, "Drug", "d", "9"), (2, "Drug", "d", "11"), (2, "Drug", "d", "2"), (2, "Drug", "d", None)]
    edges = [(i, "Drug", "d", "CAUSES", "SideEffect", "e", p) for i, _, _, p in nodes]
    seen = spark.createDataFrame([("Drug", "d", 1), ("SideEffect", "e", 1)], "label string, name string, first_seen int")
    for way in (1, -1):
        rows = spark.createDataFrame(nodes[::way], "row_idx int, label string, name string, p string").coalesce(1)
        assert [r.p for r in graph.nodes(rows, ["p"], ["row_idx"]).collect()] == ["2"]
        rows = spark.createDataFrame(edges[::way], "row_idx int, src_label string, src string, rel string, dst_label string, dst string, p string").coalesce(1)
        assert [(r.p, r.report_count) for r in graph.edges(rows, seen, ["p"], ["row_idx"]).collect()] == [("2", 4)]


def test_profiles(spark):
    df = spark.createDataFrame([("1", "yes", "x", None), ("2.5", None, "1", None), (None, "No", "x", None)], "a string, b string, c string, d string")
    kinds = {r["col"]: (r["kind"], r["n_null"], r["n_distinct"]) for r in profile.dtype_profile(df).collect()}
    assert kinds == {"a": ("numeric", 1, 2), "b": ("boolean", 1, 2), "c": ("text", 0, 2), "d": ("text", 3, 0)}
    typed = profile.retyped(df)
    assert dict(typed.dtypes) == {"a": "double", "b": "boolean", "c": "string", "d": "string"}
    assert [tuple(r) for r in profile.top_values(df, ["c"], 1).collect()] == [("c", "x", 2, 1)]


def test_nearest_ties_threshold_and_bad_vectors(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0])], "id long, v array<double>")
    v = spark.createDataFrame([(9, [1.0, 0.0]), (3, [1.0, 5.0]), (4, [-1.0, 0.0]), (5, None), (6, [None, 1.0])], "id long, v array<double>")
    assert [tuple(r) for r in vector.nearest(q, v, 2).orderBy("rank").collect()] == [(1, 3, 1, 1.0), (1, 9, 2, 1.0)]
    assert [r.id for r in vector.nearest(q, v, 9, threshold=0.0).collect()] == [3, 9]
    assert [r.id for r in vector.nearest(q, v, 1, "l2").collect()] == [9]
    first = vector.keep_first(spark.createDataFrame([("a", 2, "x"), ("a", 1, None)], "k string, o int, p string"), ["k"], "o")
    assert [tuple(r) for r in first.collect()] == [("a", 1, None)]


def test_nearest_meets_every_block(spark):
    q, v = (spark.range(n).select("id", F.array(F.col("id").cast("double")).alias("v")) for n in (3, 40))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few rows meet in one task whatever their keys
    try:
        assert vector.nearest(q, v, 40, query_block=1, vector_block=5).count() == 120
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_nearest_scores_close_vectors_exactly(spark):
    q = spark.createDataFrame([(0, [1000.0, 1.0])], "id long, v array<double>")
    v = spark.createDataFrame([(i, [1000 + x, 1.0]) for i, x in enumerate((3e-7, 1e-7, 2e-7, 1e-7))], "id long, v array<double>")
    assert [r.id for r in vector.nearest(q, v, 3, "l2").orderBy("rank").collect()] == [1, 3, 2]


@pytest.mark.parametrize("metric", ["dot", "l2"])
def test_best_of_a_block_are_those_of_sums_in_order(metric):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(40, 33)).astype(np.float32).astype(float)
    v = np.concatenate([base[rng.integers(0, 40, 500)], np.zeros((3, 33)), base + 1e-12])
    ids = rng.permutation(len(v))
    q = np.concatenate([base[:7], np.zeros((1, 33))])
    sides = [pa.table({"id": pa.array(i), "v": pa.array(list(x), pa.list_(pa.float64()))}) for i, x in ((np.arange(len(q)), q), (ids, v))]
    for k in (1, 10, 1000):
        want = []
        for i, a in enumerate(q.tolist()):
            scores = []
            for n, b in zip(ids.tolist(), v.tolist(), strict=True):
                total = 0.0
                for x, y in zip(a, b, strict=True):
                    total += (x - y) * (x - y) if metric == "l2" else x * y
                scores.append((-(math.sqrt(total) * math.sqrt(total)) if metric == "l2" else total, n))
            want += [(i, n, s) for s, n in sorted(scores, key=lambda x: (-x[0], x[1]))[:k]]
        found = vector._best(k, metric)(*sides)
        assert list(zip(*(found.column(c).to_pylist() for c in ("query_id", "id", "score")), strict=True)) == want


BLOCK = """<html><body><div class="a review-details-holder"><div class="date"> 1/2/2024 </div>
<div class="details"><span>Ann |</span><span>Female |</span> | On medication for 1 to 6 months | <span>Patient</span></div><strong class="condition">Condition: Obesity</strong>
<div class="overall-rating"><div class="webmd-rate" aria-valuenow="3.5"></div></div><div class="categories"><section><div class="webmd-rate x" aria-valuenow="4"></div></section><section></section></div>
<div class="description"><p class="description-text">"short <br> text"</div></div><div class="review-details-holder"></div></body>"""


def test_review_blocks(spark):
    out = html.review_blocks(spark.createDataFrame([(1, BLOCK), (2, None), (3, "<p>none")], "page_id int, html string")).orderBy("block").collect()
    assert [r.page_id for r in out] == [1, 1]
    a, b = out
    assert (a.date, a.user, a.age, a.medication_duration, a.patient_type, a.condition) == ("1/2/2024", "Ann", "Female", "1 to 6 months", "Patient", "Obesity")
    assert (a.overall_rating, a.effectiveness, a.ease_of_use, a.satisfaction, a.likes, a.dislikes, a.textual_review) == ("3.5", "4", None, None, None, "0", "short text")
    assert (b.user, b.dislikes, b.textual_review) == (None, "0", "")


def test_paged_source_ends_where_pages_repeat(spark):
    source = paged.paged_source("reviews_pages", {"a": "u", "b": "v?x=1"}, lambda url: {"u?page=1&next_page=true": "p1", "u?page=2&next_page=true": "p2", "u?page=3&next_page=true": "p2"}.get(url))
    spark.dataSource.register(source)
    assert sorted(tuple(r) for r in spark.read.format("reviews_pages").load().collect()) == [("a", 1, "u?page=1&next_page=true", "p1"), ("a", 2, "u?page=2&next_page=true", "p2")]


def test_csv_dialect_and_missing_files(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('Drug,Text\nx,"two\nlines and ""quotes"""\ny,\n')
    kind = schemas._struct(drug=schemas.S, text=schemas.S)
    assert [tuple(r) for r in tables.read_csv(spark, str(path), kind).collect()] == [("x", 'two\nlines and "quotes"'), ("y", None)]
    assert tables.read_csv(spark, str(tmp_path / "none.csv"), kind).count() == 0
    tables.write_csv(spark.createDataFrame([(1, ("a", None))], "i int, s struct<p string, q string>"), str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), header=True, escape='"').first().s == '{"p":"a","q":null}'
    assert [r.row_idx for r in tables.with_row_order(spark.range(50).repartition(4), "id").orderBy("id").collect()] == list(range(50))


def test_row_order_of_a_table_of_several_columns(spark):
    df = spark.range(0, 100_000, 1, 2).select("id", F.xxhash64("id").alias("h"), F.md5(F.col("id").cast("string")).alias("note"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few rows are one range
    try:
        found = tables.with_row_order(df, "h").agg(F.count("*"), F.countDistinct("row_idx"), F.max("row_idx"), F.countDistinct("note")).first()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert tuple(found) == (100_000, 100_000, 99_999, 100_000)
    rows = [(None, 2.0, b"b"), (None, 1.0, b"a"), ("a", float("nan"), None), ("a", 3.0, b"c"), ("a", None, b""), ("b", -0.5, b"z")]
    mixed = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "s string, x double, y binary, i int")
    assert [r.i for r in tables.with_row_order(mixed, "s", "x", "y").orderBy("row_idx").collect()] == [1, 0, 4, 3, 2, 5]
    assert tables.with_row_order(mixed.limit(0), "s").count() == 0


def test_table_and_graph_plans(spark):
    df = spark.createDataFrame([("A", 1, None), ("A", 2, 3), ("B", 2, 4), ("B", 2, 1)], "b string, x int, likes int")
    assert TableQuery((("b", "==", "none"),), aggs=(("sum", "likes", "n"),)).run(df).first().n == 0
    assert sorted(r.x for r in TableQuery((("b", "==", "A"),), aggs=(("mode", "x", "x"),)).run(df).collect()) == [1, 2]
    assert [tuple(r) for r in TableQuery((), ("x",), (("count", "*", "n"),), (("x", False),), share_of_total=True).run(df).collect()] == [(1, 1, 25.0), (2, 3, 75.0)]
    nodes = spark.createDataFrame([("Drug", "A"), ("Drug", "B")], "label string, name string")
    edges = spark.createDataFrame([("A", "CAUSES", "e2", "x"), ("A", "CAUSES", "e1", None), ("A", "TREATS", "c", None)], "src string, rel string, dst string, severity string")
    assert [r.name for r in GraphQuery("Drug", "A", (Hop("CAUSES"),), ("name",), (("name", False),)).run(nodes, edges).collect()] == ["e1", "e2"]
    out = GraphQuery("Drug", None, (Hop("TREATS", optional=True, column="c"), Hop("CAUSES", optional=True, column="e", most=1)), ("name", "c", "e")).run(nodes, edges)
    assert sorted(tuple(r) for r in out.collect()) == [("A", ["c"], ["e1"]), ("B", [], [])]


def test_planner_and_answers(spark):
    assert planner.plan("Tell me about Wegovy").kind == "summary"
    assert planner.plan("Compare the rating of saxenda and Ozempic").entities == ("Ozempic", "Saxenda")
    assert planner.plan("How many reviews has Zepbound?").kind == "single"
    assert not planner.valid_decomposition({"is_comparison": True, "results": [{"entity": "x", "sub_questions": [""]}]})["is_comparison"]
    reviews = spark.createDataFrame([("Wegovy", 4.0, 5, 3, 2)], "brand_name string, overall_rating double, effectiveness int, satisfaction int, likes int")
    assert "avg_rating: 4.0" in answer.answer("Tell me about Wegovy", reviews, None, None)
    assert answer.answer("Tell me about nothing", reviews, None, None) == answer.NO_CONTEXT
    assert answer.records_report(None, "down") == "Graph error: down"
    assert answer.context_budget(10**9) == answer.LEAST


def test_stream_of_nodes_equals_the_batch(spark, tmp_path):
    rows = [(i, "Drug", f"d{i % 3}", str(i)) for i in range(12)]
    kind = "row_idx int, label string, name string, p string"
    for k in range(3):
        spark.createDataFrame(rows[k::3], kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = graph_upsert.upsert_nodes(stream, f"{tmp_path}/out", f"{tmp_path}/ck", ["p"], ["row_idx"])
    query.processAllAvailable()
    query.stop()
    batch = graph_upsert.batch_nodes(spark.createDataFrame(rows, kind), ["p"], ["row_idx"])
    assert sorted(map(tuple, graph_upsert.current_nodes(spark, f"{tmp_path}/out").collect())) == sorted(map(tuple, batch.collect()))


@pytest.mark.parametrize("text, limit, want", [("abc", 3, "abc"), ("abcd", 3, "abc... (truncated)")])
def test_truncation(spark, text, limit, want):
    assert answer.truncated(text, limit) == want
    assert one(spark, lambda c: normalize.truncated(c, limit, "... (truncated)"), [text]) == [want]
