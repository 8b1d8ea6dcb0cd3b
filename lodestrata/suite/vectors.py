"""Vectors: packing, nearest neighbours and what follows from them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import vector
from .base import table

EACH = 100  # the query terms are all vectors whose id this divides, the vocabulary is all vectors


def _sides(spark, d):
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")
    return rows.where(F.col("id") % EACH == 0), rows


def _nearest(metric="dot", k=10, threshold=None):
    def run(spark, d):
        q, v = _sides(spark, d)
        out = vector.nearest(q, v, k, metric, threshold)
        return out.select("query_id", "id", F.col("rank").cast("long").alias("rank"), (F.round("score", 5) + F.lit(0.0)).alias("score"))

    return run


def vec_topk(spark, d):
    return _nearest(threshold=0.0)(spark, d).select("query_id", "id", "rank")


def vec_pack(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", *vector.unpacked("embedding", 64))
    names = [c for c in rows.columns if c != "vec_id"]
    return rows.select("vec_id", vector.packed(names).alias("v")).select("vec_id", F.size("v").cast("long").alias("width"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")), 4).alias("mass"))


def vec_dropna(spark, d):
    holed = F.when(F.col("vec_id") % 5 == 0, F.concat(F.array(F.lit(None).cast("float")), "embedding")).when(F.col("vec_id") % 5 == 1, None).otherwise(F.col("embedding"))
    return table(spark, d, "embeddings").select("vec_id", holed.alias("v")).where(vector.whole("v")).select("vec_id")


def resolve_validate(spark, d):
    """Candidates by label, but for the term itself: an equal label wins, else the best one of a fair score."""
    q, v = _sides(spark, d)
    found = vector.nearest(q, v, 11).where("id != query_id")
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))  # of 11 rows at most
    name = lambda df, key, alias: df.select(F.col("id").alias(key), F.concat(F.lit("L"), F.col("label").cast("string")).alias(alias))
    rows = found.join(name(v, "id", "candidate"), "id").join(name(q, "query_id", "term"), "query_id")
    return vector.resolved(rows.select("query_id", "term", "candidate", "rank", "score"), 0.35)


def retrieve_multi(spark, d):
    """Hits of several queries as one set."""
    q, v = _sides(spark, d)
    return vector.nearest(q, v, 5).select("id").distinct()


_S = """WITH s AS (SELECT q.vec_id AS query_id, v.vec_id AS id, q.label AS ql, v.label AS vl, list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS dot, list_distance(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS dist
FROM embeddings q JOIN embeddings v ON q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dot DESC, id) AS rank, row_number() OVER (PARTITION BY query_id ORDER BY dist, id) AS near FROM s)"""
QUERIES = {
    "vec_topk": (vec_topk, f"{_S} SELECT query_id, id, rank FROM r WHERE rank <= 10 AND dot >= 0"),
    "vec_topk_scored": (_nearest(), f"{_S} SELECT query_id, id, rank, round(dot, 5) + 0.0 AS score FROM r WHERE rank <= 10"),
    "knn_l2": (_nearest("l2", 5), f"{_S} SELECT query_id, id, near AS rank, round(-dist * dist, 5) + 0.0 AS score FROM r WHERE near <= 5"),
    "vec_pack": (vec_pack, "SELECT vec_id, CAST(len(embedding) AS BIGINT) AS width, round(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]), 4) AS mass FROM embeddings"),
    "vec_dropna": (vec_dropna, "SELECT vec_id FROM embeddings WHERE vec_id % 5 > 1"),
    "resolve_validate": (resolve_validate, f"{_S}, o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place FROM r WHERE rank <= 11 AND id <> query_id) SELECT query_id, CASE WHEN bool_or(ql = vl) THEN 'L' || CAST(max(ql) AS VARCHAR) WHEN max(CASE WHEN place = 1 THEN dot END) >= 0.35 THEN 'L' || CAST(max(CASE WHEN place = 1 THEN vl END) AS VARCHAR) END AS resolved FROM o GROUP BY 1"),
    "retrieve_multi": (retrieve_multi, f"{_S} SELECT DISTINCT id FROM r WHERE rank <= 5"),
}
