"""The property graph of products, conditions and effects: building it, and its patterns as joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas


def last(props: list[str], order: list[str]) -> Column:
    """The properties of the last row by order; of rows equal in it the greatest properties, so that they don't hang on how rows are dealt out."""
    return F.max_by(F.struct(*props), F.struct(*order, *props))


def nodes(rows: DataFrame, props: list[str], order: list[str]) -> DataFrame:
    """Merge by (label, name): the last row's properties win whole, nulls included; nameless rows are skipped. first_seen: least order."""
    named = rows.where("name is not null and name != ''")
    return named.groupBy("label", "name").agg(last(props, order).alias("p"), F.min(order[0]).alias("first_seen")).select("label", "name", "p.*", "first_seen")


def edges(rows: DataFrame, node_table: DataFrame, props: list[str], order: list[str], order_sensitive: bool = True) -> DataFrame:
    """Merge relations between nodes that exist.

    rows: src_label, src, rel, dst_label, dst, props, order. Labels are mapped and unknown ones dropped, relation types go to
    upper case. With order_sensitive an occurrence counts only once both ends have been seen. The last occurrence's properties
    win; report_count is the number of occurrences.
    """
    mapped = lambda c: F.coalesce(*(F.when(F.col(c) == k, v) for k, v in schemas.LABELS.items()), F.col(c))
    told = rows.withColumns({"src_label": mapped("src_label"), "dst_label": mapped("dst_label"), "rel": F.upper("rel")})
    told = told.where(F.col("src_label").isin(schemas.NODE_LABELS) & F.col("dst_label").isin(schemas.NODE_LABELS))
    end = lambda side: node_table.select(F.col("label").alias(f"{side}_label"), F.col("name").alias(side), F.col("first_seen").alias(f"{side}_seen"))
    told = told.join(end("src"), ["src_label", "src"]).join(end("dst"), ["dst_label", "dst"])
    if order_sensitive:
        told = told.where((F.col(order[0]) >= F.col("src_seen")) & (F.col(order[0]) >= F.col("dst_seen")))
    return told.groupBy(*schemas.EDGE_COLUMNS).agg(last(props, order).alias("p"), F.count("*").alias("report_count")).select(*schemas.EDGE_COLUMNS, "p.*", "report_count")


def duplicate_names(node_table: DataFrame) -> DataFrame:
    """Names that break uniqueness within their label; empty for a merged table."""
    return node_table.groupBy("label", "name").agg(F.count("*").alias("n")).where("n > 1")


def stats(node_table: DataFrame, edge_table: DataFrame) -> DataFrame:
    """kind, name, n: nodes per label and edges per type, and their totals."""
    count = lambda df, kind, by: df.groupBy(F.col(by).alias("name")).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "name", "n")
    total = lambda df, kind: df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), F.lit("total").alias("name"), "n")
    return count(node_table, "node", "label").unionByName(count(edge_table, "edge", "rel")).unionByName(total(node_table, "node")).unionByName(total(edge_table, "edge"))


def one_hop(edge_table: DataFrame, rel: str, src: str | None = None, dst: str | None = None, where: Column | None = None) -> DataFrame:
    """Edges of a type from or to a named node; the merged edge carries both names, so no node join is needed."""
    out = edge_table.where(F.col("rel") == rel)
    out = out.where(F.col("src") == src) if src is not None else out
    out = out.where(F.col("dst") == dst) if dst is not None else out
    return out.where(where) if where is not None else out


def with_node(edge_rows: DataFrame, node_table: DataFrame, label: str, side: str, props: list[str]) -> DataFrame:
    """edge_rows with properties of the node at one side."""
    named = node_table.where(F.col("label") == label).select(F.col("name").alias(side), *(F.col(p).alias(f"{side}_{p}") for p in props))
    return edge_rows.join(named, side)


def severe(edge_rows: DataFrame) -> DataFrame:
    """Edges whose own or whose node's severity is severe, in any case."""
    return edge_rows.where((F.lower("severity") == "severe") | (F.lower("dst_severity") == "severe"))


def report_counts(edge_table: DataFrame, rel: str, k: int | None = None) -> DataFrame:
    """dst, edge_count, report_count and the severities met, most reported first."""
    out = edge_table.where(F.col("rel") == rel).groupBy("dst").agg(F.count("*").alias("edge_count"), F.sum("report_count").alias("report_count"), F.array_join(F.array_sort(F.collect_set("severity")), ",").alias("severities"))
    return out if k is None else out.orderBy(F.desc("report_count"), "dst").limit(k)


def optional_match(anchors: DataFrame, edge_table: DataFrame, branches: dict[str, tuple[str, int | None]]) -> DataFrame:
    """anchors (name) with a sorted array per branch {column: (relation, most)}; each branch is aggregated before it is joined, so
    that two optional branches never multiply."""
    out = anchors
    for column, (rel, most) in branches.items():
        found = F.array_sort(F.collect_set("dst"))
        side = edge_table.where(F.col("rel") == rel).groupBy(F.col("src").alias("name")).agg((F.slice(found, 1, most) if most else found).alias(column))
        out = out.join(side, "name", "left").withColumn(column, F.coalesce(column, F.array().cast("array<string>")))
    return out
