"""Review-shaped views of the driver's tables, for both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BRAND = "Brand#23"
AGE = "CASE WHEN {k} % 13 = 0 THEN NULL WHEN {k} % 7 = 0 THEN '75 or over' WHEN {k} % 11 = 0 THEN '< 18' WHEN {k} % 17 = 0 THEN concat(CAST({k} % 90 AS {s}), '') WHEN {k} % 19 = 0 THEN 'n/a' ELSE concat(CAST(18 + {k} % 50 AS {s}), ' - ', CAST(27 + {k} % 50 AS {s})) END"


def _reviews(s: str) -> str:
    """The view's expressions; s: the engine's string type."""
    return f"""
SELECT CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS row_idx, p_type AS generic_name, p_brand AS brand_name, l_shipdate AS shipped,
  {AGE.format(k='l_orderkey', s=s)} AS age,
  CASE WHEN l_suppkey % 3 = 0 THEN 'Female' WHEN l_suppkey % 3 = 1 THEN 'Male' END AS gender,
  CASE WHEN l_partkey % 5 = 0 THEN ' other ' WHEN l_partkey % 5 = 1 THEN NULL WHEN l_partkey % 5 = 2 THEN 'Type 2 Diabetes' ELSE concat('Condition ', CAST(l_partkey % 9 AS {s})) END AS condition,
  CASE WHEN l_orderkey % 4 = 0 THEN NULL WHEN l_orderkey % 4 = 1 THEN ' 1 to 6 months ' WHEN l_orderkey % 4 = 2 THEN 'nan' ELSE '' END AS medication_duration,
  1 + CAST(floor(l_quantity) AS BIGINT) % 5 AS effectiveness, 1 + CAST(l_suppkey AS BIGINT) % 5 AS ease_of_use, 1 + CAST(l_orderkey AS BIGINT) % 5 AS satisfaction,
  CASE WHEN l_orderkey % 11 <> 0 THEN CAST(l_orderkey AS BIGINT) % 7 END AS likes, l_quantity AS overall_rating,
  CASE WHEN l_linenumber % 4 = 0 THEN '  ' WHEN l_linenumber % 4 = 1 THEN NULL ELSE l_linestatus END AS note,
  CASE CAST(l_linenumber AS INT) % 6 WHEN 0 THEN 'severe' WHEN 1 THEN ' MODERATE ' WHEN 2 THEN 'very bad' WHEN 3 THEN 'Mild' WHEN 4 THEN '' END AS severity_text
FROM lineitem JOIN part ON l_partkey = p_partkey"""


#: A CTE of the view for DuckDB.
CTE = f"WITH reviews AS ({_reviews('VARCHAR')}\n)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review rows: an order line is a review, a part's brand its product."""
    return spark.sql(_reviews("STRING").replace("FROM lineitem JOIN part", "FROM {lineitem} JOIN {part}"), lineitem=table(spark, sf_dir, "lineitem"), part=table(spark, sf_dir, "part"))
