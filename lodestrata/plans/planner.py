"""Rules from a question to a plan."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schemas
from ..functions.nested import bound
from ..functions.normalize import contains_any, first_of
from .ir import GraphQuery, Hop, QueryPlan, TableQuery

METRICS = {"satisfaction": "satisfaction", "effectiv": "effectiveness", "ease of use": "ease_of_use", "rating": "overall_rating"}


def routes(question: Column) -> list[Column]:
    """to_graph, to_table, is_summary and entity of a question column."""
    entity = first_of(question, list(schemas.BRANDS))
    return [
        contains_any(question, schemas.GRAPH_KEYWORDS).alias("to_graph"),
        contains_any(question, schemas.TABLE_KEYWORDS).alias("to_table"),
        (contains_any(question, schemas.SUMMARY_KEYWORDS) & entity.isNotNull()).alias("is_summary"),
        entity.alias("entity"),
    ]


def entities(question: str) -> tuple[str, ...]:
    """Brands that a question mentions, in catalog order."""
    return tuple(b for b in schemas.BRANDS if b.lower() in question.lower())


def is_summary(question: str) -> bool:
    low = question.lower()
    return any(k in low for k in schemas.SUMMARY_KEYWORDS) and bool(entities(question))


def _parts(question: str, brand: str) -> tuple[tuple[TableQuery, ...], tuple[GraphQuery, ...]]:
    low, own = question.lower(), (("brand_name", "==", brand),)
    tables = [TableQuery(own, aggs=(("avg", column, f"avg_{column}"),), digits=2) for word, column in METRICS.items() if word in low]
    if "how many" in low:
        tables.append(TableQuery(own, aggs=(("count", "*", "n"),)))
    graphs = [GraphQuery("Drug", brand, (Hop("CAUSES"),), ("name", "severity"), (("name", False),), 15)] if "side effect" in low else []
    if any(w in low for w in ("treat", "approved", "condition")):
        graphs.append(GraphQuery("Drug", brand, (Hop("TREATS"),), ("name", "approval"), (("name", False),)))
    return tuple(tables), tuple(graphs)


def card(brand: str) -> TableQuery:
    """The four figures of a product."""
    return TableQuery((("brand_name", "==", brand),), aggs=(("avg", "overall_rating", "avg_rating"), ("avg", "effectiveness", "avg_effectiveness"), ("avg", "satisfaction", "avg_satisfaction"), ("sum", "likes", "total_likes")), digits=2)


def plan(question: str) -> QueryPlan:
    """Summary, comparison (two brands or more) or single question."""
    named = entities(question)
    if is_summary(question) and len(named) == 1:
        graphs = (GraphQuery("Drug", named[0], (Hop("TREATS", optional=True, column="conditions"), Hop("CAUSES", optional=True, column="effects", most=5))),)
        return QueryPlan("summary", named, (card(named[0]),), graphs)
    parts = [_parts(question, b) for b in named]
    tables, graphs = (tuple(x for p in parts for x in p[k]) for k in (0, 1))
    return QueryPlan("comparison" if len(named) > 1 else "single", named, tables, graphs)


def decomposition(answer: Column) -> Column:
    """`valid_decomposition` of a column of JSON texts: struct(is_comparison, results)."""
    kind = "array<struct<entity:string,sub_questions:array<string>>>"
    empty = F.struct(F.lit(False).alias("is_comparison"), F.array().cast(kind).alias("results"))

    def checked(doc: Column) -> Column:
        filled = lambda x: F.trim(F.coalesce(x, F.lit(""))) != ""
        whole = F.forall(doc["results"], lambda r: filled(r["entity"]) & (F.size(r["sub_questions"]) > 0) & F.forall(r["sub_questions"], filled))
        ok = F.coalesce(doc["is_comparison"] & (F.size(doc["results"]) > 0) & whole, F.lit(False))
        return F.when(ok, F.struct(F.lit(True).alias("is_comparison"), doc["results"].alias("results"))).otherwise(empty)

    return bound(F.from_json(answer, f"is_comparison boolean, results {kind}"), checked)


def valid_decomposition(answer: object) -> dict[str, object]:
    """A model's decomposition if it is well formed, else a single question."""
    single: dict[str, object] = {"is_comparison": False, "results": []}
    if not isinstance(answer, dict) or not isinstance(answer.get("results"), list) or not answer.get("is_comparison") or not answer["results"]:
        return single
    text = lambda x: isinstance(x, str) and bool(x.strip())
    for item in answer["results"]:
        if not isinstance(item, dict) or not text(item.get("entity")):
            return single
        questions = item.get("sub_questions")
        if not isinstance(questions, list) or not questions or not all(map(text, questions)):
            return single
    return {"is_comparison": True, "results": answer["results"]}
