"""Column profiles and retrieval corpora."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schemas
from ..functions import normalize
from ..operators import profile, retrieval
from .base import CTE, reviews, table

ORDERS = ["o_orderstatus", "o_totalprice", "o_orderpriority"]


def infer_dtype_profile(spark, d):
    flags = F.when(F.col("row_idx") % 3 == 0, "Yes").when(F.col("row_idx") % 3 == 1, "no")
    rows = reviews(spark, d).select(F.col("effectiveness").cast("string").alias("effectiveness"), "gender", flags.alias("flag"), "age")
    return profile.dtype_profile(rows).select("col", "n_rows", "n_null", "n_distinct", "kind")


def profile_columns(spark, d):
    rows = table(spark, d, "orders").select(*ORDERS)
    return profile.column_profile(rows).select("col", "n", "kind", F.round("lo", 4).alias("lo"), F.round("hi", 4).alias("hi"))


def top3_values(spark, d):
    return profile.top_values(table(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"]).select("col", "value", "n", F.col("rank").cast("long").alias("rank"))


def cell_corpus(spark, d):
    return profile.cell_corpus(table(spark, d, "orders").select("o_orderstatus", "o_custkey", "o_orderpriority")).select("col", "value", "n", "page_content")


def row_corpus(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", F.when(F.col("c_custkey") % 2 == 0, "x").alias("note"))
    return profile.row_corpus(rows, "c_custkey")


def column_corpus(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", "c_name", F.when(F.col("c_nationkey") > 4, F.col("c_nationkey")).alias("c_nationkey"))
    return profile.column_corpus(rows, "c_custkey").select("col_name", "part", F.md5("page_content").alias("digest"))


def retrieval_corpus(spark, d):
    """Documents of the schema and of the cells, as they are indexed; a kind that isn't known has none."""
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    kinds = [retrieval.corpus(kind, rows, "o_orderkey").withColumn("kind", F.lit(kind)) for kind in ("schema", "cell", "other")]
    return kinds[0].unionByName(kinds[1]).unionByName(kinds[2]).where("page_content not like '%orderkey%'").select("kind", "page_content")


def retrieval_exact(spark, d):
    """Every part's type asked of the index of types: its own document is the nearest."""
    types = table(spark, d, "part").select("p_partkey", "p_type")
    made = retrieval.embedded(retrieval.corpus("cell", types, "p_partkey"), "page_content")
    asked = types.select(F.col("p_partkey").alias("id"), F.to_json(F.struct(F.lit("p_type").alias("column_name"), F.col("p_type").alias("cell_value"))).alias("text"))
    return retrieval.hits(made, asked, 1).select(F.col("query_id").alias("p_partkey"), "page_content")


def safe_ids(spark, d):
    return table(spark, d, "pages").select("page_id", normalize.safe_id(F.concat("url", F.lit(" é_-ß²."))).alias("safe"))


_CELLS = {"effectiveness": "CAST(effectiveness AS VARCHAR)", "gender": "gender", "flag": "CASE WHEN row_idx % 3 = 0 THEN 'Yes' WHEN row_idx % 3 = 1 THEN 'no' END", "age": "age"}
_WORDS = ", ".join(f"'{w}'" for w in schemas.BOOLEAN_WORDS)
DTYPE_SQL = f"""{CTE}, c AS ({" UNION ALL ".join(f"SELECT '{name}' AS col, {cell} AS v FROM reviews" for name, cell in _CELLS.items())})
SELECT col, count(*) AS n_rows, count(*) - count(v) AS n_null, count(DISTINCT v) AS n_distinct, CASE WHEN bool_and(TRY_CAST(v AS DOUBLE) IS NOT NULL) FILTER (v IS NOT NULL) THEN 'numeric'
WHEN count(DISTINCT v) <= 2 AND bool_and(lower(v) IN ({_WORDS})) FILTER (v IS NOT NULL) THEN 'boolean' ELSE 'text' END AS kind FROM c GROUP BY 1"""

QUERIES = {
    "infer_dtype_profile": (infer_dtype_profile, DTYPE_SQL),
    "retrieval_corpus": (retrieval_corpus, "SELECT 'schema' AS kind, unnest(['o_orderstatus', 'o_orderpriority']) AS page_content UNION ALL SELECT DISTINCT 'cell', concat('{\"column_name\":\"o_orderstatus\",\"cell_value\":\"', o_orderstatus, '\"}') FROM orders UNION ALL SELECT DISTINCT 'cell', concat('{\"column_name\":\"o_orderpriority\",\"cell_value\":\"', o_orderpriority, '\"}') FROM orders"),
    "retrieval_exact": (retrieval_exact, "SELECT p_partkey, concat('{\"column_name\":\"p_type\",\"cell_value\":\"', p_type, '\"}') AS page_content FROM part"),
    "safe_ids": (safe_ids, "SELECT page_id, regexp_replace(url || ' é_-ß².', '[^\\p{L}\\p{N}_-]', '', 'g') AS safe FROM pages"),
    "profile_columns": (profile_columns, "SELECT 'o_orderstatus' AS col, count(o_orderstatus) AS n, 'categorical' AS kind, CAST(NULL AS DOUBLE) AS lo, CAST(NULL AS DOUBLE) AS hi FROM orders UNION ALL SELECT 'o_orderpriority', count(o_orderpriority), 'categorical', NULL, NULL FROM orders UNION ALL SELECT 'o_totalprice', count(o_totalprice), 'numeric', round(min(o_totalprice), 4), round(max(o_totalprice), 4) FROM orders"),
    "top3_values": (top3_values, "WITH c AS (SELECT 'o_orderstatus' AS col, o_orderstatus AS value, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY 2), r AS (SELECT *, row_number() OVER (PARTITION BY col ORDER BY n DESC, value) AS rank FROM c) SELECT * FROM r WHERE rank <= 3"),
    "cell_corpus": (cell_corpus, "WITH c AS (SELECT 'o_orderstatus' AS col, o_orderstatus AS value, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY 2) SELECT col, value, n, concat('{\"column_name\":\"', col, '\",\"cell_value\":\"', value, '\"}') AS page_content FROM c UNION ALL SELECT 'o_custkey', NULL, NULL, concat('{\"column_name\":\"o_custkey\",\"min\":', CAST(min(o_custkey)::DOUBLE AS VARCHAR), ',\"max\":', CAST(max(o_custkey)::DOUBLE AS VARCHAR), '}') FROM orders"),
    "row_corpus": (row_corpus, "SELECT c_custkey AS row_id, concat_ws('|', c_custkey, c_name, c_nationkey, CASE WHEN c_custkey % 2 = 0 THEN 'x' ELSE 'nan' END) AS page_content FROM customer"),
    "column_corpus": (column_corpus, "WITH c AS (SELECT *, CAST((row_number() OVER (ORDER BY c_custkey) - 1) // 1000 AS BIGINT) AS part FROM customer) SELECT 'c_name' AS col_name, part, md5(string_agg(c_name, '|' ORDER BY c_custkey)) AS digest FROM c GROUP BY 2 UNION ALL SELECT 'c_nationkey', part, md5(string_agg(CASE WHEN c_nationkey > 4 THEN CAST(c_nationkey AS VARCHAR) ELSE 'nan' END, '|' ORDER BY c_custkey)) FROM c GROUP BY 2"),
}
