"""Table profiles and the retrieval corpora made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..functions.normalize import number
from ..sources.tables import with_row_order

NUMERIC_SHARE = 0.8
#: Rows of a document of a column's cells.
COLUMN_ROWS = 1000


def _text(c: str) -> Column:
    return F.col(c).cast("string")


def melted(df: DataFrame, columns: list[str]) -> DataFrame:
    """col_id, col, value of every cell, nulls included; one pass over the table."""
    cells = F.array(*(F.struct(F.lit(i).alias("col_id"), F.lit(c).alias("col"), _text(c).alias("value")) for i, c in enumerate(columns)))
    return df.select(F.explode(cells).alias("x")).select("x.*")


def dtype_profile(df: DataFrame) -> DataFrame:
    """Per column: rows, nulls, distinct values, and the type that its values admit (numeric, boolean, or as it is)."""
    cells = melted(df, df.columns)
    per_value = cells.groupBy("col_id", "col", "value").agg(F.count("*").alias("n"))
    known = F.col("value").isNotNull()
    stats = per_value.groupBy("col_id", "col").agg(
        F.sum("n").alias("n_rows"),
        F.sum(F.when(known, 0).otherwise(F.col("n"))).alias("n_null"),
        F.count(F.when(known, 1)).alias("n_distinct"),
        F.coalesce(F.bool_and(F.when(known, F.col("value").try_cast("double").isNotNull())), F.lit(False)).alias("all_numeric"),
        F.coalesce(F.bool_and(F.when(known, F.lower("value").isin(schemas.BOOLEAN_WORDS))), F.lit(False)).alias("all_boolean"),
    )
    kind = F.when(F.col("all_numeric"), "numeric").when((F.col("n_distinct") <= 2) & F.col("all_boolean"), "boolean").otherwise("text")
    return stats.select("col_id", "col", "n_rows", "n_null", "n_distinct", kind.alias("kind"))


def retyped(df: DataFrame) -> DataFrame:
    """df with its text columns cast to what their values admit; the profile is one row per column."""
    kinds = {r["col"]: r["kind"] for r in dtype_profile(df).collect()}
    word = lambda c: F.lower(F.col(c))
    cast = {"numeric": lambda c: F.col(c).try_cast("double"), "boolean": lambda c: F.when(word(c).isin(schemas.TRUE_WORDS), True).when(word(c).isin(schemas.FALSE_WORDS), False)}
    return df.select(*(cast[kinds[f.name]](f.name).alias(f.name) if isinstance(f.dataType, T.StringType) and kinds.get(f.name) in cast else F.col(f.name) for f in df.schema.fields))


def top_values(df: DataFrame, columns: list[str], k: int = 3) -> DataFrame:
    """col, value, n, rank of the k most frequent values of each column; ties by value."""
    counts = melted(df, columns).where("value is not null").groupBy("col_id", "col", "value").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("col_id", "col").orderBy(F.desc("n"), "value"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= k).select("col", "value", "n", "rank")


def column_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Per column: numeric or categorical (numeric: more than NUMERIC_SHARE of the values are numbers), least and greatest number."""
    cells = melted(df, columns or df.columns).where("value is not null")
    value = number(F.col("value"))
    stats = cells.groupBy("col_id", "col").agg(F.count("*").alias("n"), F.count(value).alias("numbers"), F.min(value).alias("lo"), F.max(value).alias("hi"))
    numeric = F.col("numbers") / F.col("n") > NUMERIC_SHARE
    return stats.select("col_id", "col", "n", F.when(numeric, "numeric").otherwise("categorical").alias("kind"), F.when(numeric, F.col("lo")).alias("lo"), F.when(numeric, F.col("hi")).alias("hi"))


def cell_corpus(df: DataFrame, columns: list[str] | None = None, limit: int = 10_000) -> DataFrame:
    """A document per numeric column with its range, then the most frequent (column, value) cells up to the limit."""
    columns = columns or df.columns
    profile = column_profile(df, columns)
    found = profile.collect()  # one row per column
    profile = df.sparkSession.createDataFrame(found, profile.schema)
    ranges = profile.where("kind = 'numeric'").select(F.col("col"), F.lit(None).cast("string").alias("value"), F.lit(None).cast("long").alias("n"), F.to_json(F.struct(F.col("col").alias("column_name"), F.col("lo").alias("min"), F.col("hi").alias("max"))).alias("page_content"))
    kinds = {r["col"]: r["kind"] for r in found}
    texts = [c for c in columns if kinds.get(c) == "categorical"]
    if not texts:
        return ranges
    room = max(0, limit - (len(kinds) - len(texts)))
    counts = melted(df, texts).where("value is not null").groupBy("col", "value").agg(F.count("*").alias("n"))
    cells = counts.orderBy(F.desc("n"), "col", "value").limit(room)
    return ranges.unionByName(cells.withColumn("page_content", F.to_json(F.struct(F.col("col").alias("column_name"), F.col("value").alias("cell_value")))))


def row_corpus(df: DataFrame, order: str) -> DataFrame:
    """A document per row: its cells joined by bars, nulls as nan."""
    return df.select(F.col(order).alias("row_id"), F.concat_ws("|", *(F.coalesce(_text(c), F.lit("nan")) for c in df.columns)).alias("page_content"))


def column_corpus(df: DataFrame, order: str, rows: int = COLUMN_ROWS) -> DataFrame:
    """Documents of a column (col_name, part): the cells of `rows` rows at a time in row order, joined by bars; nulls as nan.

    A table of at most that many rows has one document per column; longer columns go on in further parts, so that no value grows
    with the table.
    """
    names = [c for c in df.columns if c != order]
    cells = F.array(*(F.struct(F.lit(i).alias("col_id"), F.lit(c).alias("col_name"), F.coalesce(_text(c), F.lit("nan")).alias("v")) for i, c in enumerate(names)))
    placed = with_row_order(df, order)
    flat = placed.select(F.col("row_idx").alias("ord"), F.floor(F.col("row_idx") / rows).cast("long").alias("part"), F.explode(cells).alias("x")).select("ord", "part", "x.*")
    own = F.array_sort(F.collect_list(F.struct("ord", "v")))
    return flat.groupBy("col_id", "col_name", "part").agg(F.array_join(F.transform(own, lambda x: x["v"]), "|").alias("page_content"))


def sample_rows(df: DataFrame, order: str, limit: int, columns: int) -> DataFrame:
    """The first rows that a budget of cells allows: half of the limit, spread over the columns."""
    return df.where(F.col(order) < max(1, limit // 2 // columns))
