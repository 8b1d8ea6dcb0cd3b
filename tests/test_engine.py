"""Models, prompts, generated graph queries, the question loop, the console, workbooks and the edge stream."""

import io
import json
import zipfile

import pytest

from lodestrata import __main__, schemas
from lodestrata.engine import Engine
from lodestrata.operators import retrieval
from lodestrata.plans import agent, graph_text, models, templates
from lodestrata.plans.answer import NO_CONTEXT
from lodestrata.sources import excel
from lodestrata.streaming import graph_upsert

EDGES = "src_label string, src string, rel string, dst_label string, dst string, severity string, report_count long"


@pytest.fixture(scope="module")
def graph(spark):
    nodes = spark.createDataFrame([("Drug", "Wegovy", 1), ("Drug", "Ozempic", 2), ("SideEffect", "nausea", 1), ("SideEffect", "fatigue", 2)], "label string, name string, first_seen int")
    edges = spark.createDataFrame([("Drug", "Wegovy", "CAUSES", "SideEffect", "nausea", "Mild", 2), ("Drug", "Wegovy", "CAUSES", "SideEffect", "fatigue", None, 1), ("Drug", "Ozempic", "CAUSES", "SideEffect", "nausea", "Severe", 1)], EDGES)
    return nodes, edges


def test_models_never_raise_and_count_tokens():
    def broken(_):
        raise RuntimeError("down")

    own = models.Tracked(models.RuleModel((("weather", "sunny STOP rest"), ("fail", broken))))
    assert own.ask("the weather?", stop=("STOP",)) == "sunny "
    assert own.ask("fail").startswith(models.ERROR) and own.ask("x").startswith(models.ERROR)
    assert own.calls[0] == (models.tokens("the weather?"), models.tokens("sunny ")) and own.spent == sum(map(sum, own.calls))
    assert [models.context_limit(x) for x in ("gpt-4.1-nano", "gpt-4o", "gpt-3.5-turbo-0125", "rules")] == [128000, 128000, 16385, 8192]
    with pytest.raises(ValueError):
        templates.prompt("other")
    with pytest.raises(ValueError):
        templates.prompt("columns", table="t")


def test_generated_graph_queries(graph):
    nodes, edges = graph
    run = lambda text: [tuple(r) for r in graph_text.parsed(text).run(nodes, edges).collect()]
    assert run("MATCH (d:Drug {name: 'Wegovy'})-[r:CAUSES]->(s:SideEffect) RETURN s.name, r.severity ORDER BY s.name") == [("fatigue", None), ("nausea", "Mild")]
    assert run('MATCH (d:Drug)-[:causes]->(s:SideEffect {name: "nausea"}) RETURN d.name ORDER BY d.name DESC LIMIT 1;') == [("Wegovy",)]
    assert run("MATCH (s:SideEffect {name:'nausea'})<-[r:CAUSES]-(d:Drug) RETURN d.name AS drug ORDER BY d.name") == [("Ozempic",), ("Wegovy",)]
    assert sorted(run("MATCH (d:Drug) RETURN d.name")) == [("Ozempic",), ("Wegovy",)]
    for bad in ("DROP ALL", "MATCH (a:B)-[r:C]-(d:E) RETURN a", "MATCH (a:B) RETURN z.name"):
        with pytest.raises(ValueError):
            graph_text.parsed(bad)
    assert "(:Drug)-[:CAUSES {severity, report_count}]->(:SideEffect)" in graph_text.schema_text(nodes, edges)


def test_graph_answers_retry_once_and_tell_of_nothing(graph):
    good = "MATCH (d:Drug {name: 'Wegovy'})-[r:CAUSES]->(s:SideEffect) RETURN s.name, r.severity ORDER BY s.name"
    mending = models.RuleModel((("This query failed", good), ("Question", "MATCH (d:Drug)-[r:CAUSES]->(s:SideEffect) RETURN r.no_such")))
    assert json.loads(graph_text.graph_answer("q", mending, *graph)) == [{"dst": "fatigue", "severity": None}, {"dst": "nausea", "severity": "Mild"}]
    assert graph_text.graph_answer("q", models.RuleModel((("Question", good.replace("Wegovy", "None")),)), *graph) == "No specific results found."
    assert graph_text.graph_answer("q", models.RuleModel((("Question", "MATCH x"),)), *graph).startswith("Graph error")
    assert graph_text.graph_answer("q", models.RuleModel(()), *graph).startswith("Graph error")
    assert graph_text.graph_answer("q", mending, None, None).startswith("Graph error")


def test_question_loop_is_bounded_and_typed(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0)], "brand string, rating double")
    step = '```json\n{"filters": [["brand", "==", "a"]], "aggs": [["avg", "rating", "x"]]}\n```'
    model = models.RuleModel((("Name the columns", '```json\n["ratings"]\n```'), ("Name the words", '["brand a", "12"]'), (r'Observation: \[\{"x": 2.0\}\]', "Thought\nFinal Answer: 2"), ("next step", step)))
    built = retrieval.build_database(spark, str(tmp_path), "t", df)
    told, account = agent.answer("mean?", model, df, "t", built["schema"], built["cell"])
    assert told == "2" and len(account.calls) == 4
    endless = models.Tracked(models.RuleModel((("next step", step),)))
    assert agent.solve("q", endless, df, "t", [], []) == '[{"x": 2.0}]' and len(endless.calls) == agent.ROUNDS
    assert agent.solve("q" * 200_000, endless, df, "t", [], []) == NO_CONTEXT
    for bad in ('{"aggs": [["eval", "x", "y"]]}', '{"code": "x"}', "[1]", "{", '{"group_by": ["none"]}', '{"limit": "a"}'):
        assert agent.observation(bad, df).startswith(models.ERROR)
    assert agent.observation('{"filters": [["brand", "==", "z"]]}', df) == "no rows"
    assert agent.names("no list") == [] and agent.names('{"a": 1}') == []


def test_index_follows_the_content(spark, tmp_path):
    df = spark.createDataFrame([(1, "x", "{}")], "k int, t string, relations string")
    first = retrieval.build_database(spark, str(tmp_path), "t", df)
    again = retrieval.build_database(spark, str(tmp_path), "t", spark.createDataFrame([(1, "y", "{}")], df.schema))
    assert {r.page_content for r in first["schema"].collect()} == {"k", "t"}
    assert [any('"x"' in r.page_content for r in made["cell"].collect()) for made in (first, again)] == [True, False]
    assert retrieval.version(df) == retrieval.version(df.repartition(3)) != retrieval.version(df.select("k"))


def test_console_and_wiring(graph, spark):
    reviews = spark.createDataFrame([("Wegovy", 4.0, 5, 5, 1)], "brand_name string, overall_rating double, effectiveness int, satisfaction int, likes int")
    out = io.StringIO()
    assert __main__.chat(Engine(reviews, *graph), ["\n", "What is the average rating of Wegovy?\n", "who?", "EXIT", "more"], out) == 2
    assert "4.0" in out.getvalue() and NO_CONTEXT in out.getvalue()
    assert Engine().ask("average rating of Wegovy") == NO_CONTEXT
    model = models.RuleModel((("Graph:", "MATCH (d:Drug) RETURN d.name"),))
    assert "Ozempic" in Engine(None, *graph, model=model).ask("which drugs are there?")
    assert Engine(reviews, model=models.RuleModel()).ask("what?") == NO_CONTEXT


def workbook(rows):
    shared = sorted({c for r in rows for c in r if isinstance(c, str)})
    cell = lambda i, j, c: "" if c is None else f'<c r="{chr(65 + j)}{i}" t="s"><v>{shared.index(c)}</v></c>' if isinstance(c, str) else f'<c r="{chr(65 + j)}{i}"><v>{c}</v></c>'
    data = "".join(f'<row r="{i}">{"".join(cell(i, j, c) for j, c in enumerate(r))}</row>' for i, r in enumerate(rows, 1))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="x">{"".join(f"<si><t>{s}</t></si>" for s in shared)}</sst>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="x"><sheetData>{data}</sheetData></worksheet>')
    return out.getvalue()


def test_workbooks_become_one_vocabulary(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(workbook([["Term", "n", "Group"], ["Nausea ", 3, "gut"], ["Rash", None, None], [None, 1, "x"]]))
    (tmp_path / "b.xlsx").write_bytes(workbook([["Group", "Term"], ["a", "Nausea"]]))
    rows = excel.read_excel(spark, f"{tmp_path}/*.xlsx", ["Term", "Group", "n"])
    assert sorted((r.Term or "", r.Group or "", r.n or "") for r in rows.collect()) == [("", "x", "1"), ("Nausea", "a", ""), ("Nausea ", "gut", "3"), ("Rash", "", "")]
    assert {tuple(r) for r in excel.merged_vocabulary(rows, "Term", "Group").collect()} == {("Nausea", "a"), ("Rash", None)}


def test_edges_of_a_stream_are_merged_and_errors_counted(spark, tmp_path):
    kind = ", ".join(f"{c} string" for c in schemas.EDGE_COLUMNS) + ", severity string, ord long"
    rows = [("Drug", "d", "causes", "SideEffect", "e", "Mild", 1), ("Drug", "d", "CAUSES", "SideEffect", "e", "Severe", 2), ("Drug", None, "CAUSES", "SideEffect", "e", "x", 3), ("Drug", "d", "", "SideEffect", "f", "x", 4)]
    for k, part in enumerate((rows[:2], rows[2:], rows[:1])):
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(kind).parquet(f"{tmp_path}/in")
        graph_upsert.upsert_edges(stream, f"{tmp_path}/g", f"{tmp_path}/c", ["severity"], ["ord"]).processAllAvailable()
        for q in spark.streams.active:
            q.stop()
    found = [tuple(r) for r in graph_upsert.current_edges(spark, f"{tmp_path}/g").collect()]
    assert found == [("Drug", "d", "CAUSES", "SideEffect", "e", "Severe", 3)]
    assert graph_upsert.row_errors(spark, f"{tmp_path}/g") == 2
