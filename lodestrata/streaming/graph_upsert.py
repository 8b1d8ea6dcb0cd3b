"""The graph kept up to date from a stream of rows: every micro-batch becomes one versioned delta, written once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..operators import graph


def _delta(path: str, batch_id: int) -> str:
    return f"{path}/batch={batch_id}"


def upsert_nodes(rows: DataFrame, path: str, checkpoint: str, props: list[str], order: list[str]):
    """A streaming query that merges each micro-batch's node rows; a replayed batch overwrites its own delta."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        named = batch.where("name is not null and name != ''")
        last = named.groupBy("label", "name").agg(F.max(F.struct(*order)).alias("seen"), graph.last(props, order).alias("p"), F.min(order[0]).alias("first_seen"))
        last.write.mode("overwrite").parquet(_delta(path, batch_id))

    return rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).start()


def current_nodes(spark, path: str) -> DataFrame:
    """The merged nodes of all deltas: the last row by order wins."""
    deltas = spark.read.parquet(path)
    return deltas.groupBy("label", "name").agg(graph.last(["p"], ["seen"])["p"].alias("p"), F.min("first_seen").alias("first_seen")).select("label", "name", "p.*", "first_seen")


def batch_nodes(rows: DataFrame, props: list[str], order: list[str]) -> DataFrame:
    """The same from a batch table."""
    return graph.nodes(rows, props, order)


def upsert_edges(rows: DataFrame, path: str, checkpoint: str, props: list[str], order: list[str]):
    """A streaming query that merges each micro-batch's relations (EDGE_COLUMNS, props, order) and counts the rows that can't be one.

    A replayed batch overwrites its own deltas: path/edges has the merged relations, path/errors a row per batch with the count.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        told = batch.withColumn("rel", F.upper("rel"))
        complete = F.lit(True)
        for c in schemas.EDGE_COLUMNS:
            complete = complete & (F.coalesce(F.col(c), F.lit("")) != "")
        last = told.where(complete).groupBy(*schemas.EDGE_COLUMNS).agg(F.max(F.struct(*order)).alias("seen"), graph.last(props, order).alias("p"), F.count("*").alias("n"))
        last.write.mode("overwrite").parquet(_delta(f"{path}/edges", batch_id))
        told.agg(F.count(F.when(~complete, 1)).alias("errors"), F.count("*").alias("rows")).write.mode("overwrite").parquet(_delta(f"{path}/errors", batch_id))

    return rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).start()


def current_edges(spark, path: str) -> DataFrame:
    """The merged relations of all deltas: the last row's properties win, and report_count is the number of rows."""
    deltas = spark.read.parquet(f"{path}/edges")
    return deltas.groupBy(*schemas.EDGE_COLUMNS).agg(graph.last(["p"], ["seen"])["p"].alias("p"), F.sum("n").alias("report_count")).select(*schemas.EDGE_COLUMNS, "p.*", "report_count")


def row_errors(spark, path: str) -> int:
    """Rows of all batches that were no relation."""
    return spark.read.parquet(f"{path}/errors").agg(F.sum("errors")).first()[0] or 0
