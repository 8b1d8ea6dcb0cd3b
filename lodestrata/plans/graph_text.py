"""Graph queries as text: the schema that a model is told, the cleaning of its answer, and the patterns that are understood."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .answer import records_report
from .ir import GraphQuery, Hop
from .models import Model
from .templates import prompt

# Fixed value: what is taken off a generated query.
_FENCE = r"(?i)```(?:cypher\s*)?|\s*```"
_NODE = r"\(\s*(\w*)\s*:\s*(\w+)\s*(?:\{\s*name\s*:\s*['\"]([^'\"]*)['\"]\s*\})?\s*\)"
_PATTERN = re.compile(rf"MATCH\s*{_NODE}\s*(?:(<?)-\s*\[\s*(\w*)\s*:\s*(\w+)\s*\]\s*-(>?)\s*{_NODE})?\s*RETURN\s+(?:DISTINCT\s+)?(.+?)(?:\s+ORDER\s+BY\s+(.+?))?(?:\s+LIMIT\s+(\d+))?\s*;?\s*", re.I | re.S)


def schema_text(nodes: DataFrame, edges: DataFrame) -> str:
    """Labels, relations between labels, and the properties of both. One row per label and kind of relation is read."""
    labels = sorted(r[0] for r in nodes.select("label").distinct().collect())
    kinds = sorted(tuple(r) for r in edges.select("src_label", "rel", "dst_label").distinct().collect())
    own = ", ".join(c for c in nodes.columns if c not in ("label", "first_seen"))
    told = ", ".join(c for c in edges.columns if c not in ("src_label", "src", "rel", "dst_label", "dst"))
    return "\n".join([*(f"(:{x} {{{own}}})" for x in labels), *(f"(:{a})-[:{r} {{{told}}}]->(:{b})" for a, r, b in kinds)])


def cleaned(text: Column) -> Column:
    """A generated query without fences and its language's name; null unless the answer begins with MATCH (before they are taken off)."""
    bare = F.trim(F.regexp_replace(text, _FENCE, ""))
    bare = F.when(F.lower(F.substring(bare, 1, 7)) == "cypher:", F.trim(F.substring(bare, 8, 2**31 - 1))).otherwise(bare)
    return F.when(F.upper(F.ltrim(text)).startswith("MATCH"), bare)


def cleaned_text(text: str) -> str | None:
    """`cleaned` for one answer."""
    if not text.strip().upper().startswith("MATCH"):
        return None
    bare = re.sub(_FENCE, "", text).strip()
    return bare[7:].strip() if bare.lower().startswith("cypher:") else bare


def parsed(text: str) -> GraphQuery:
    """A pattern of one node, or of two and a relation; anything else is a ValueError. Names go back by the alias of their node."""
    m = _PATTERN.fullmatch(text.strip())
    if not m:
        raise ValueError("only MATCH (a:Label {name: '...'})-[r:REL]->(b:Label) RETURN ... ORDER BY ... LIMIT ... is understood")
    one, label, name, back, rel_alias, rel, ahead, two, other_label, other_name, returns, order, limit = m.groups()
    if rel and bool(back) == bool(ahead):
        raise ValueError("a relation needs a direction")
    columns = {one: "src" if ahead else "dst", two: "dst" if ahead else "src"} if rel else {one: "name"}
    forward, anchor = bool(ahead), (label, name)
    if rel and name is None and other_name is not None:  # the named node is the anchor
        forward, anchor = not forward, (other_label, other_name)

    def column(x: str) -> str:
        alias, _, prop = x.strip().partition(".")
        if alias not in columns and alias != rel_alias:
            raise ValueError(f"unknown alias: {alias}")
        return columns[alias] if prop in ("", "name") and alias in columns else prop

    picked = tuple(dict.fromkeys(column(re.split(r"(?i)\s+as\s+", x)[0]) for x in returns.split(",")))
    ordered = tuple((column(re.sub(r"(?i)\s+(asc|desc)$", "", x.strip())), x.strip().lower().endswith(" desc")) for x in order.split(",")) if order else ()
    hops = (Hop(rel.upper(), forward),) if rel else ()
    return GraphQuery(*anchor, hops, picked, ordered, int(limit) if limit else None)


def graph_answer(question: str, model: Model, nodes: DataFrame | None, edges: DataFrame | None, retries: int = 1) -> str:
    """Records for a question by a model's query. A query that fails is asked for again with its error; no rows are told as such."""
    if nodes is None or edges is None:
        return records_report(None)
    told, failure, error = schema_text(nodes, edges), "", "no query was given"
    for _ in range(retries + 1):
        text = cleaned_text(model.ask(prompt("graph", schema=told, question=question, failure=failure), temperature=0.05, max_tokens=400))
        if text is None:
            return records_report(None, error)
        try:
            return records_report(parsed(text).run(nodes, edges))
        except Exception as wrong:  # a generated query may name what isn't there
            error = str(wrong).split("\n")[0]
            failure = f"This query failed: {text}\nError: {error}"
    return records_report(None, error)
