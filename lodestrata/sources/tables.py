"""CSV and Parquet tables; a missing file is an empty table of the known schema."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Random keys per range that with_row_order cuts its ranges by; every row has its rank all the same.
KEYS = 20


def _missing(error: AnalysisException) -> bool:
    return error.getCondition() == "PATH_NOT_FOUND"


def read_csv(spark: SparkSession, path: str | list[str], schema: T.StructType) -> DataFrame:
    """RFC 4180 text with a header: quoted line breaks and doubled quotes. A missing path is an empty table; other errors are errors."""
    try:
        return spark.read.schema(schema).options(header=True, multiLine=True, quote='"', escape='"', mode="PERMISSIVE").csv(path)
    except AnalysisException as error:
        if not _missing(error):
            raise
        return spark.createDataFrame([], schema)


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Parquet; with a schema, a missing path is an empty table."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if schema is None or not _missing(error):
            raise
        return spark.createDataFrame([], schema)


def write_csv(df: DataFrame, path: str) -> None:
    """Nested columns become JSON text, with nulls kept."""
    flat = [F.to_json(c, {"ignoreNullFields": "false"}).alias(c) if isinstance(df.schema[c].dataType, (T.StructType, T.ArrayType, T.MapType)) else F.col(c) for c in df.columns]
    df.select(flat).write.mode("overwrite").options(header=True, quote='"', escape='"').csv(path)


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def union_sources(parts: list[DataFrame]) -> DataFrame:
    """All rows with source, the ordinal of their table; columns that a table lacks are null."""
    out = None
    for k, part in enumerate(parts):
        part = part.withColumn("source", F.lit(k))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def _range_of(order: tuple[str, ...], schema: T.StructType, cuts: list[Row]) -> Column:
    """The number of a row's range among those that ascending keys cut: a tree of comparisons, nulls first. Any keys give ranges in order."""
    key = F.struct(*order)

    def below(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        at = (lo + hi) // 2
        cut = F.struct(*(F.lit(cuts[at][c]).cast(schema[c].dataType).alias(c) for c in order))
        return F.when(key < cut, below(lo, at)).otherwise(below(at + 1, hi))

    return below(0, len(cuts))


def with_row_order(df: DataFrame, *order: str) -> DataFrame:
    """df with row_idx, from 0 in the given order: global ranks from ranges of the order and their sizes, not one sorted task.

    The ranges are cut once, at quantiles of some random keys, and written into the plan: Spark's own are drawn anew (and merged as
    their sizes suggest) each time a plan is run, so that the sizes would be those of other ranges than the rows'.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = df.select(*order)
    some = keys.orderBy(F.rand(0)).limit(KEYS * n).orderBy(*order).collect()
    cuts = list(dict.fromkeys(some[len(some) * i // n] for i in range(1, n))) if some else []
    parts = df.withColumn("_part", _range_of(order, keys.schema, cuts))
    sizes = parts.groupBy("_part").count()
    offsets = sizes.withColumn("_offset", F.sum("count").over(Window.orderBy("_part")) - F.col("count")).drop("count")
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return parts.withColumn("_own", own).join(F.broadcast(offsets), "_part").withColumn("row_idx", F.col("_own") + F.col("_offset")).drop("_part", "_own", "_offset")
