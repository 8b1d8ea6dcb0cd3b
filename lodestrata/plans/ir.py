"""Typed query plans: what generated table expressions and graph patterns mean, as DataFrame plans."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import graph

_OPS = {
    "==": lambda c, v: c == v,
    "!=": lambda c, v: c != v,
    ">=": lambda c, v: c >= v,
    ">": lambda c, v: c > v,
    "<=": lambda c, v: c <= v,
    "<": lambda c, v: c < v,
    "in": lambda c, v: c.isin(v),
    "contains": lambda c, v: F.contains(F.lower(c), F.lit(v.lower())),
    "not_blank": lambda c, v: F.trim(F.coalesce(c.cast("string"), F.lit(""))) != "",
    "not_null": lambda c, v: c.isNotNull(),
}
_AGGS = {
    "avg": F.avg,
    "sum": lambda c: F.coalesce(F.sum(c), F.lit(0)),
    "count": F.count,
    "count_distinct": F.count_distinct,
    "min": F.min,
    "max": F.max,
}
#: What a filter and an aggregate may say.
OPERATORS, AGGREGATES = frozenset(_OPS), frozenset({*_AGGS, "mode", "unique"})


@dataclass(frozen=True)
class TableQuery:
    """Filter, group, aggregate, order, limit.

    aggs: (function, column or *, alias), function among avg, sum, count, count_distinct, min, max; or the single shapes `mode`
    (every most frequent value) and `unique` (distinct values). share_of_total adds pct, the share of the first count.
    """

    filters: tuple[tuple[str, str, object], ...] = ()
    group_by: tuple[str, ...] = ()
    aggs: tuple[tuple[str, str, str], ...] = ()
    order_by: tuple[tuple[str, bool], ...] = ()
    limit: int | None = None
    share_of_total: bool = False
    digits: int | None = None

    def run(self, df: DataFrame) -> DataFrame:
        for name, op, value in self.filters:
            df = df.where(_OPS[op](F.col(name), value))
        if self.aggs and self.aggs[0][0] in ("mode", "unique"):
            kind, name, alias = self.aggs[0]
            counts = df.groupBy(F.col(name).alias(alias)).agg(F.count("*").alias("n"))
            if kind == "mode":
                top = counts.where(F.col(alias).isNotNull()).withColumn("_k", F.lit(1)).groupBy("_k").agg(F.max("n").alias("n"))
                counts = counts.where(F.col(alias).isNotNull()).join(F.broadcast(top.select("n")), "n")
            df = counts.select(alias)
        elif self.aggs:
            made = [(_AGGS[fn](F.lit(1) if name == "*" else F.col(name)), alias) for fn, name, alias in self.aggs]
            if self.digits is not None:
                made = [(F.round(c, self.digits) if fn == "avg" else c, alias) for (c, alias), (fn, _, _) in zip(made, self.aggs, strict=True)]
            df = df.groupBy(*self.group_by).agg(*(c.alias(alias) for c, alias in made))
            if self.share_of_total:
                alias = next(a for fn, _, a in self.aggs if fn == "count")
                total = df.agg(F.sum(alias).alias("_total"))  # one row; a window over all groups would be one task
                df = df.join(F.broadcast(total)).withColumn("pct", F.round(100.0 * F.col(alias) / F.col("_total"), 1)).drop("_total")
        elif self.group_by:
            df = df.select(*self.group_by).distinct()
        if self.order_by:
            df = df.orderBy(*(F.desc(c) if down else F.asc(c) for c, down in self.order_by))
        return df if self.limit is None else df.limit(self.limit)


@dataclass(frozen=True)
class Hop:
    rel: str
    forward: bool = True
    optional: bool = False
    column: str = "name"
    most: int | None = None
    where: tuple[tuple[str, str, object], ...] = ()


@dataclass(frozen=True)
class GraphQuery:
    """An anchor node and its hops: one required hop gives rows, optional ones a sorted array each."""

    label: str
    name: str | None = None
    hops: tuple[Hop, ...] = ()
    returns: tuple[str, ...] = ()
    order_by: tuple[tuple[str, bool], ...] = ()
    limit: int | None = None

    def run(self, nodes: DataFrame, edges: DataFrame) -> DataFrame:
        anchors = nodes.where(F.col("label") == self.label)
        anchors = anchors if self.name is None else anchors.where(F.col("name") == self.name)
        optional = {h.column: (h.rel, h.most) for h in self.hops if h.optional}
        required = [h for h in self.hops if not h.optional]
        if optional:
            out = graph.optional_match(anchors, edges, optional)
        elif required:
            hop = required[0]
            out = graph.one_hop(edges, hop.rel, **({"src" if hop.forward else "dst": self.name} if self.name is not None else {}))
            condition: Column | None = None
            for c, op, v in hop.where:
                one = _OPS[op](F.col(c), v)
                condition = one if condition is None else condition | one
            out = out if condition is None else out.where(condition)
            out = out.withColumn(hop.column, F.col("dst" if hop.forward else "src"))
        else:
            out = anchors
        if self.returns:
            out = out.select(*self.returns)
        if self.order_by:
            out = out.orderBy(*(F.desc(c) if down else F.asc(c) for c, down in self.order_by))
        return out if self.limit is None else out.limit(self.limit)


@dataclass(frozen=True)
class QueryPlan:
    kind: str  # summary, comparison or single
    entities: tuple[str, ...] = ()
    tables: tuple[TableQuery, ...] = ()
    graphs: tuple[GraphQuery, ...] = field(default=())
