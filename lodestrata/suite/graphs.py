"""The property graph over order lines: brands cause types, and treat the regions of their suppliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph
from ..plans.ir import GraphQuery, Hop
from .base import table

BRAND, TYPE = "Brand#11", "PROMO"


def _lines(spark, d):
    lines, part = table(spark, d, "lineitem"), table(spark, d, "part")
    supplier, nation, region = (table(spark, d, n) for n in ("supplier", "nation", "region"))
    places = F.broadcast(nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name"))  # 25 rows at any scale
    rows = lines.join(part, F.col("l_partkey") == F.col("p_partkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(places, F.col("s_nationkey") == F.col("n_nationkey"))
    severity = F.when(F.col("l_orderkey") % 4 == 0, "severe").when(F.col("l_orderkey") % 4 == 1, "Mild")
    return rows.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_idx"), "p_brand", "p_type", "r_name", severity.alias("severity"), F.col("l_quantity").cast("long").cast("string").alias("dosage"))


PROPS = ["severity", "dosage"]


def node_rows(spark, d):
    lines = _lines(spark, d)
    null = F.lit(None).cast("string")
    drug = lines.select("row_idx", F.lit(0).alias("pos"), F.lit("Drug").alias("label"), F.col("p_brand").alias("name"), null.alias("severity"), "dosage")
    condition = lines.select("row_idx", F.lit(1).alias("pos"), F.lit("Condition").alias("label"), F.col("r_name").alias("name"), "severity", null.alias("dosage"))
    effect = lines.select("row_idx", F.lit(2).alias("pos"), F.lit("SideEffect").alias("label"), F.col("p_type").alias("name"), "severity", null.alias("dosage"))
    return drug.unionByName(condition).unionByName(effect)


def node_table(spark, d):
    return graph.nodes(node_rows(spark, d), PROPS, ["row_idx", "pos"])


def edge_rows(spark, d):
    lines = _lines(spark, d)
    null = F.lit(None).cast("string")
    approval = F.when(F.col("row_idx") % 2 == 0, "yes").otherwise("no")
    causes = lines.select("row_idx", F.lit("Medication").alias("src_label"), F.col("p_brand").alias("src"), F.lit("causes").alias("rel"), F.lit("SideEffect").alias("dst_label"), F.col("p_type").alias("dst"), null.alias("approval"), "severity", "dosage")
    treats = lines.select("row_idx", F.lit("Medication").alias("src_label"), F.col("p_brand").alias("src"), F.lit("treats").alias("rel"), F.lit("Disease").alias("dst_label"), F.col("r_name").alias("dst"), approval.alias("approval"), null.alias("severity"), null.alias("dosage"))
    unknown = lines.where("row_idx % 97 = 0").select("row_idx", F.lit("Thing").alias("src_label"), F.col("p_brand").alias("src"), F.lit("causes").alias("rel"), F.lit("SideEffect").alias("dst_label"), F.col("p_type").alias("dst"), null.alias("approval"), "severity", "dosage")
    return causes.unionByName(treats).unionByName(unknown)


EDGE_PROPS = ["approval", "severity", "dosage"]


def edge_table(spark, d):
    return graph.edges(edge_rows(spark, d), node_table(spark, d), EDGE_PROPS, ["row_idx"])


def graph_nodes(spark, d):
    return node_table(spark, d)


def graph_edges(spark, d):
    return edge_table(spark, d)


def graph_unique_check(spark, d):
    return graph.duplicate_names(node_table(spark, d))


def graph_stats(spark, d):
    return graph.stats(node_table(spark, d), edge_table(spark, d))


def graph_one_hop(spark, d):
    return GraphQuery("Drug", BRAND, (Hop("CAUSES"),), ("name", "severity"), (("name", False),), 10).run(node_table(spark, d), edge_table(spark, d))


def graph_reverse_hop(spark, d):
    return GraphQuery("Condition", "ASIA", (Hop("TREATS", forward=False),), ("name",), (("name", False),)).run(node_table(spark, d), edge_table(spark, d))


def graph_where_or(spark, d):
    rows = graph.with_node(graph.one_hop(edge_table(spark, d), "CAUSES"), node_table(spark, d), "SideEffect", "dst", ["severity"])
    return graph.severe(rows).select("src", "dst")


def graph_edge_props(spark, d):
    return graph.one_hop(edge_table(spark, d), "TREATS", src=BRAND, dst="ASIA").select("approval", "report_count")


def graph_node_lookup(spark, d):
    return GraphQuery("Drug", BRAND, returns=("name", "dosage")).run(node_table(spark, d), edge_table(spark, d))


def graph_report_count(spark, d):
    return graph.report_counts(edge_table(spark, d), "CAUSES", 5)


def graph_optional_match(spark, d):
    q = GraphQuery("Drug", None, (Hop("TREATS", optional=True, column="conditions"), Hop("CAUSES", optional=True, column="effects", most=3)), ("name", "conditions", "effects"))
    out = q.run(node_table(spark, d), edge_table(spark, d))
    return out.select("name", F.array_join("conditions", ",").alias("conditions"), F.array_join("effects", ",").alias("effects"))


def graph_query_report(spark, d):
    """JSON text of each product's effects, cut at 2500 characters."""
    own = F.to_json(F.array_sort(F.collect_list(F.struct("dst", "report_count"))))
    return graph.one_hop(edge_table(spark, d), "CAUSES").groupBy("src").agg(F.substring(own, 1, 2500).alias("report"))


CTE = """WITH l AS (SELECT l_orderkey * 10 + l_linenumber AS row_idx, p_brand, p_type, r_name, CASE l_orderkey % 4 WHEN 0 THEN 'severe' WHEN 1 THEN 'Mild' END AS severity, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS dosage
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
n0 AS (SELECT row_idx, 'Drug' AS label, p_brand AS name, NULL AS severity, dosage FROM l UNION ALL SELECT row_idx, 'Condition', r_name, severity, NULL FROM l UNION ALL SELECT row_idx, 'SideEffect', p_type, severity, NULL FROM l),
nodes AS (SELECT label, name, max_by({'s': severity}, row_idx).s AS severity, max_by({'d': dosage}, row_idx).d AS dosage, min(row_idx) AS first_seen FROM n0 GROUP BY 1, 2),
e0 AS (SELECT row_idx, p_brand AS src, 'CAUSES' AS rel, 'SideEffect' AS dst_label, p_type AS dst, NULL AS approval, severity, dosage FROM l UNION ALL SELECT row_idx, p_brand, 'TREATS', 'Condition', r_name, CASE WHEN row_idx % 2 = 0 THEN 'yes' ELSE 'no' END, NULL, NULL FROM l),
edges AS (SELECT 'Drug' AS src_label, src, rel, dst_label, dst, max_by({'a': approval}, row_idx).a AS approval, max_by({'s': severity}, row_idx).s AS severity, max_by({'d': dosage}, row_idx).d AS dosage, count(*) AS report_count FROM e0 GROUP BY 1, 2, 3, 4, 5)"""
QUERIES = {
    "graph_nodes": (graph_nodes, f"{CTE} SELECT label, name, severity, dosage, first_seen FROM nodes"),
    "graph_edges": (graph_edges, f"{CTE} SELECT src_label, src, rel, dst_label, dst, approval, severity, dosage, report_count FROM edges"),
    "graph_unique_check": (graph_unique_check, f"{CTE} SELECT label, name, count(*) AS n FROM nodes GROUP BY 1, 2 HAVING count(*) > 1"),
    "graph_stats": (graph_stats, f"{CTE} SELECT 'node' AS kind, label AS name, count(*) AS n FROM nodes GROUP BY 1, 2 UNION ALL SELECT 'edge', rel, count(*) FROM edges GROUP BY 1, 2 UNION ALL SELECT 'node', 'total', count(*) FROM nodes UNION ALL SELECT 'edge', 'total', count(*) FROM edges"),
    "graph_one_hop": (graph_one_hop, f"{CTE} SELECT dst AS name, severity FROM edges WHERE src = '{BRAND}' AND rel = 'CAUSES' ORDER BY 1 LIMIT 10"),
    "graph_reverse_hop": (graph_reverse_hop, f"{CTE} SELECT src AS name FROM edges WHERE rel = 'TREATS' AND dst = 'ASIA'"),
    "graph_where_or": (graph_where_or, f"{CTE} SELECT e.src, e.dst FROM edges e JOIN nodes n ON n.label = 'SideEffect' AND n.name = e.dst WHERE e.rel = 'CAUSES' AND (lower(e.severity) = 'severe' OR lower(n.severity) = 'severe')"),
    "graph_edge_props": (graph_edge_props, f"{CTE} SELECT approval, report_count FROM edges WHERE src = '{BRAND}' AND dst = 'ASIA' AND rel = 'TREATS'"),
    "graph_node_lookup": (graph_node_lookup, f"{CTE} SELECT name, dosage FROM nodes WHERE label = 'Drug' AND name = '{BRAND}'"),
    "graph_report_count": (graph_report_count, f"{CTE} SELECT dst, count(*) AS edge_count, CAST(sum(report_count) AS BIGINT) AS report_count, coalesce(string_agg(DISTINCT severity, ',' ORDER BY severity), '') AS severities FROM edges WHERE rel = 'CAUSES' GROUP BY 1 ORDER BY 3 DESC, 1 LIMIT 5"),
    "graph_optional_match": (graph_optional_match, f"{CTE} SELECT name, (SELECT string_agg(dst, ',' ORDER BY dst) FROM edges WHERE rel = 'TREATS' AND src = name) AS conditions, (SELECT array_to_string(list_sort(list(dst))[1:3], ',') FROM edges WHERE rel = 'CAUSES' AND src = name) AS effects FROM nodes WHERE label = 'Drug'"),
    "graph_query_report": (graph_query_report, f"{CTE} SELECT src, substr('[' || string_agg('{{\"dst\":\"' || dst || '\",\"report_count\":' || CAST(report_count AS VARCHAR) || '}}', ',' ORDER BY dst) || ']', 1, 2500) AS report FROM edges WHERE rel = 'CAUSES' GROUP BY 1"),
}
