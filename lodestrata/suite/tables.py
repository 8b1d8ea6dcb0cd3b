"""Filters, aggregates, distributions and relational reshaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import profile, vector
from ..plans.ir import TableQuery
from ..plans.planner import card
from ..sources.tables import union_sources, with_row_order
from .base import BRAND, CTE, reviews, table


def _on_reviews(query: TableQuery):
    return lambda spark, d: query.run(reviews(spark, d))


ONE = (("brand_name", "==", BRAND),)


def scan_project(spark, d):
    return table(spark, d, "lineitem").where("l_quantity >= 25").select("l_orderkey", "l_linenumber", "l_quantity")


def drop_structured(spark, d):
    df = table(spark, d, "events").withColumn("Unnamed: 0", F.lit(0))
    return df.select([c for c in df.columns if not c.startswith("Unnamed")]).drop("props", "not_there")


def catalog_join(spark, d):
    catalog = table(spark, d, "region").select("r_regionkey", "r_name")  # five rows, whatever the scale
    return table(spark, d, "nation").join(F.broadcast(catalog), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")


def product_card(spark, d):
    """All products' cards in one pass."""
    q = TableQuery(group_by=("brand_name",), aggs=card(BRAND).aggs, digits=4)
    return q.run(reviews(spark, d))


def compare_entities(spark, d):
    q = TableQuery(filters=(("brand_name", "in", ["Brand#11", BRAND]),), group_by=("brand_name",), aggs=(("count", "*", "n"), ("avg", "satisfaction", "avg_satisfaction"), ("avg", "effectiveness", "avg_effectiveness")), digits=4)
    return q.run(reviews(spark, d))


def filter_nonblank(spark, d):
    return TableQuery(filters=(("note", "not_blank", None),), group_by=("brand_name",), aggs=(("count", "*", "n"),)).run(reviews(spark, d))


def dropna_col(spark, d):
    return reviews(spark, d).dropna(subset=["likes"]).groupBy("brand_name").agg(F.count("*").alias("n"), F.sum("likes").alias("likes"))


def head_n(spark, d):
    return table(spark, d, "orders").where(F.col("o_orderkey") < 100).select("o_orderkey", "o_custkey")


def row_order(spark, d):
    return with_row_order(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_custkey").select("c_custkey", F.col("row_idx").cast("long").alias("row_idx"))


def sample_rows_budget(spark, d):
    df = table(spark, d, "orders")
    return profile.sample_rows(df, "o_orderkey", 10_000, len(df.columns)).select("o_orderkey")


def dedup_keep_first(spark, d):
    return vector.keep_first(table(spark, d, "lineitem").select("l_partkey", "l_returnflag", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord")), ["l_partkey", "l_returnflag"], "ord")


def distinct_terms(spark, d):
    return table(spark, d, "part").select("p_type", "p_brand").distinct()


def _lists(spark, d):
    part = table(spark, d, "part")
    return union_sources([part.where(F.col("p_size") % 3 == k).select("p_type", "p_brand", "p_partkey") for k in range(3)])


def union_all_sources(spark, d):
    return _lists(spark, d).groupBy("source", "p_brand").agg(F.count("*").alias("n"))


def union_dedup(spark, d):
    ordered = _lists(spark, d).select("p_type", "p_brand", F.struct("source", "p_partkey").alias("ord"))
    return vector.keep_first(ordered, ["p_type", "p_brand"], "ord").select("p_type", "p_brand", F.col("ord.source").cast("long").alias("source"), "ord.p_partkey")


def lookup_left_default(spark, d):
    told = table(spark, d, "region").where("r_regionkey < 3").select(F.col("r_regionkey").alias("k"), F.concat(F.lit("known "), "r_name").alias("text"))
    return table(spark, d, "nation").join(F.broadcast(told), F.col("n_regionkey") == F.col("k"), "left").select("n_name", F.coalesce("text", F.lit("no text")).alias("text"))


def zip_positional(spark, d):
    left = table(spark, d, "customer").select(F.col("c_custkey").alias("pos"), "c_mktsegment")
    return left.join(table(spark, d, "orders").select(F.col("o_orderkey").alias("pos"), "o_orderpriority"), "pos")


def cube_rollup(spark, d):
    return reviews(spark, d).cube("brand_name", "gender").agg(F.grouping_id().cast("long").alias("level"), F.count("*").alias("n"), F.round(F.avg("satisfaction"), 4).alias("avg_satisfaction"))


HISTOGRAM = TableQuery(ONE, ("satisfaction",), (("count", "*", "n"),), (("satisfaction", False),))
QUERIES = {
    "scan_project": (scan_project, "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 25"),
    "drop_structured": (drop_structured, "SELECT event_id, ts, user_id, event_type, value FROM events"),
    "catalog_join": (catalog_join, "SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "filter_eq_agg": (_on_reviews(TableQuery(ONE, aggs=(("avg", "effectiveness", "avg_effectiveness"),), digits=4)), f"{CTE} SELECT round(avg(effectiveness), 4) AS avg_effectiveness FROM reviews WHERE brand_name = '{BRAND}'"),
    "filter_eq_sum": (_on_reviews(TableQuery(ONE, aggs=(("sum", "likes", "total_likes"),))), f"{CTE} SELECT CAST(coalesce(sum(likes), 0) AS BIGINT) AS total_likes FROM reviews WHERE brand_name = '{BRAND}'"),
    "filter_range_avg": (_on_reviews(TableQuery((("overall_rating", ">=", 10), ("overall_rating", "<", 30)), aggs=(("avg", "satisfaction", "avg_satisfaction"), ("count", "*", "n")), digits=4)), f"{CTE} SELECT round(avg(satisfaction), 4) AS avg_satisfaction, count(*) AS n FROM reviews WHERE overall_rating >= 10 AND overall_rating < 30"),
    "filter_conj_count": (_on_reviews(TableQuery((("gender", "==", "Female"), ("effectiveness", ">=", 4), *ONE), aggs=(("count", "*", "n"),))), f"{CTE} SELECT count(*) AS n FROM reviews WHERE gender = 'Female' AND effectiveness >= 4 AND brand_name = '{BRAND}'"),
    "filter_nonblank": (filter_nonblank, f"{CTE} SELECT brand_name, count(*) AS n FROM reviews WHERE trim(coalesce(note, '')) <> '' GROUP BY 1"),
    "dropna_col": (dropna_col, f"{CTE} SELECT brand_name, count(*) AS n, CAST(sum(likes) AS BIGINT) AS likes FROM reviews WHERE likes IS NOT NULL GROUP BY 1"),
    "head_n": (head_n, "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey < 100"),
    "row_order": (row_order, "SELECT c_custkey, CAST(row_number() OVER (ORDER BY c_custkey) - 1 AS BIGINT) AS row_idx FROM customer"),
    "sample_rows_budget": (sample_rows_budget, "SELECT o_orderkey FROM orders WHERE o_orderkey < greatest(1, 10000 // 2 // 6)"),
    "histogram": (_on_reviews(HISTOGRAM), f"{CTE} SELECT satisfaction, count(*) AS n FROM reviews WHERE brand_name = '{BRAND}' GROUP BY 1"),
    "histogram_pct": (_on_reviews(TableQuery(ONE, ("satisfaction",), (("count", "*", "n"),), share_of_total=True)), f"{CTE} SELECT satisfaction, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 1) AS pct FROM reviews WHERE brand_name = '{BRAND}' GROUP BY 1"),
    "distinct_values": (_on_reviews(TableQuery(aggs=(("unique", "brand_name", "brand_name"),))), f"{CTE} SELECT DISTINCT brand_name FROM reviews"),
    "mode_all": (_on_reviews(TableQuery(ONE, aggs=(("mode", "effectiveness", "effectiveness"),))), f"{CTE}, c AS (SELECT effectiveness, count(*) AS n FROM reviews WHERE brand_name = '{BRAND}' GROUP BY 1) SELECT effectiveness FROM c WHERE n = (SELECT max(n) FROM c)"),
    "product_card": (product_card, f"{CTE} SELECT brand_name, round(avg(overall_rating), 4) AS avg_rating, round(avg(effectiveness), 4) AS avg_effectiveness, round(avg(satisfaction), 4) AS avg_satisfaction, CAST(coalesce(sum(likes), 0) AS BIGINT) AS total_likes FROM reviews GROUP BY 1"),
    "compare_entities": (compare_entities, f"{CTE} SELECT brand_name, count(*) AS n, round(avg(satisfaction), 4) AS avg_satisfaction, round(avg(effectiveness), 4) AS avg_effectiveness FROM reviews WHERE brand_name IN ('Brand#11', '{BRAND}') GROUP BY 1"),
    "dedup_keep_first": (dedup_keep_first, "SELECT l_partkey, l_returnflag, min(l_orderkey * 10 + l_linenumber) AS ord FROM lineitem GROUP BY 1, 2"),
    "distinct_terms": (distinct_terms, "SELECT DISTINCT p_type, p_brand FROM part"),
    "union_all_sources": (union_all_sources, "SELECT p_size % 3 AS source, p_brand, count(*) AS n FROM part GROUP BY 1, 2"),
    "union_dedup": (union_dedup, "WITH r AS (SELECT *, row_number() OVER (PARTITION BY p_type, p_brand ORDER BY p_size % 3, p_partkey) AS k FROM part) SELECT p_type, p_brand, CAST(p_size % 3 AS BIGINT) AS source, p_partkey FROM r WHERE k = 1"),
    "lookup_left_default": (lookup_left_default, "SELECT n_name, coalesce('known ' || r_name, 'no text') AS text FROM nation LEFT JOIN (SELECT * FROM region WHERE r_regionkey < 3) ON n_regionkey = r_regionkey"),
    "zip_positional": (zip_positional, "SELECT c_custkey AS pos, c_mktsegment, o_orderpriority FROM customer JOIN orders ON c_custkey = o_orderkey"),
    "cube_rollup": (cube_rollup, f"{CTE} SELECT brand_name, gender, CAST(grouping(brand_name, gender) AS BIGINT) AS level, count(*) AS n, round(avg(satisfaction), 4) AS avg_satisfaction FROM reviews GROUP BY CUBE (brand_name, gender)"),
}
