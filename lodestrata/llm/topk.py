"""Exact top-k inner products by columnar branch-and-bound.

Method: queries and candidates are dealt into blocks of bounded size; in each pair of blocks the candidates lie in vertical
layout (a row per dimension). Scores are accumulated one block of dimensions after another. After each block the remaining
mass of both sides (the norms of the dimensions not yet read) bounds every score from both sides; candidates whose upper
bound is under the k-th best lower bound are compacted away. What is left is exact, so the partial top-k lists of the blocks
merge into the exact answer.

Defined cases: vectors that are null, empty, or hold null or non-finite components, and rows without an id, take no part; a
shorter vector counts as padded with zeros; rows that repeat an id count once, by their best score, and never answer their own
id; a score outside of the range of long is an error of the query (none is rounded);
an empty table, or one without queries, gives no row; columns besides the id and the vector are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, small, stored, table, workspace

DIMENSION_BLOCK = 16
QUERY_BLOCK = 1024
CANDIDATE_BLOCK = 16_384
LEAST_BLOCKS = 32
SCORES = "query_id long, vec_id long, score long"


def quantised(column: pa.ChunkedArray, scale: int, width: int | None = None) -> np.ndarray:
    """floor(scale * x) as whole doubles, one row per vector, padded with zeros."""
    lists = column.combine_chunks()
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = np.floor(scale * lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    width = max(width or 0, int(lengths.max(initial=0)))
    out = np.zeros((len(lengths), width))
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def _whole(x: np.ndarray, kind: type) -> np.ndarray:
    """x as whole numbers of a type; object: Python's unbounded integers."""
    if kind is not object:
        return x.astype(kind)
    out = np.empty(x.shape, object)
    out.ravel()[:] = [int(y) for y in x.ravel().tolist()]
    return out


def _longs(scores: np.ndarray) -> np.ndarray:
    """Scores as 64-bit integers; one that doesn't fit is an error, not another number."""
    if scores.dtype == object and any(not -(2**63) <= x < 2**63 for x in scores):
        raise OverflowError("a score is outside of the range of long")
    return scores.astype(np.int64)


def exact_type(*sides: np.ndarray) -> type:
    """Doubles while every partial sum is under 2^53, else 64-bit or unbounded integers."""
    bound = float(sides[0].shape[1]) * np.prod([max(1.0, float(np.abs(x).max(initial=0))) for x in sides])
    return np.float64 if bound < 2**53 else np.int64 if bound < 2**62 else object


def block_topk(queries: np.ndarray, candidates: np.ndarray, query_ids: np.ndarray, ids: np.ndarray, k: int, step: int = DIMENSION_BLOCK, floors: np.ndarray | None = None):
    """Yields (query position, candidate positions, scores): all that can be among the k best of this block, ties included.

    floors: scores that the k-th best of each query has at least, as other blocks have told.
    """
    floors = np.full(len(queries), -np.inf) if floors is None else floors
    kind, width = exact_type(queries, candidates), candidates.shape[1]
    columns = _whole(np.ascontiguousarray(candidates.T), kind)
    rest = lambda x, at: np.sqrt((x[:, at:].astype(np.float64) ** 2).sum(axis=1)) * (1 + 1e-9)
    cuts = list(range(0, width, step)) or [0]
    left = {at: rest(candidates, at) for at in cuts[1:]}
    whole = _whole(queries, kind)
    first = whole[:, :step] @ columns[:step]
    for i, q in enumerate(whole):
        alive = np.flatnonzero(ids != query_ids[i])
        score = first[i, alive]
        for at in cuts[1:]:
            if len(alive) > k:
                told = score.astype(np.float64)
                slack = left[at][alive] * (float(rest(queries[i : i + 1], at)[0])) + 1e-3 + 1e-9 * np.abs(told)
                low = told - slack
                keep = np.flatnonzero(told + slack >= max(floors[i], np.partition(low, len(low) - k)[len(low) - k]))
                alive, score = alive[keep], score[keep]
            score = score + q[at : at + step] @ columns[at : at + step, alive]
        if len(alive) > k:
            keep = np.flatnonzero(score >= np.sort(score)[len(score) - k])
            alive, score = alive[keep], score[keep]
        if floors[i] > -np.inf:
            keep = np.flatnonzero(score >= floors[i])
            alive, score = alive[keep], score[keep]
        yield i, alive, score


def _pairs(k: int, scale: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if left.num_rows and right.num_rows:
            width = max(int(x.column("vector").combine_chunks().value_lengths().to_numpy(zero_copy_only=False).max()) for x in (left, right))
            queries, candidates = (quantised(x.column("vector"), scale, width) for x in (left, right))
            query_ids, ids = (x.column("id").to_numpy() for x in (left, right))
            told = left.column("floor").to_numpy(zero_copy_only=False).astype(np.float64)  # nulls are nan
            for i, at, score in block_topk(queries, candidates, query_ids, ids, k, floors=np.where(np.isnan(told), -np.inf, told)):
                order = np.argsort(ids[at], kind="stable")  # ties go to smaller ids, so k rows (of k ids) are enough
                order = order[np.argsort(-score[order], kind="stable")]
                at, score = at[order], score[order]
                _, once = np.unique(ids[at], return_index=True)
                once = np.sort(once)[:k]
                out[0].append(np.full(len(once), query_ids[i]))
                out[1].append(ids[at[once]])
                out[2].append(_longs(score[once]))
        columns = [np.concatenate(x).astype(np.int64) if x else np.empty(0, np.int64) for x in out]
        return pa.table(dict(zip(("query_id", "vec_id", "score"), columns, strict=True)))

    return run


def topk(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding", query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK) -> DataFrame:
    """The k vectors of the highest floor-quantised inner product for each query: query_id, rank, vec_id, score.

    Both sides are dealt into blocks by a hash of the id. Each pair of blocks is one group of bounded size. The first block of candidates
    is scored before the others: the k-th best score that a query has there is a floor for all its blocks. Pairs of blocks whose norms
    can't reach a floor are left out, and within the others the floor prunes from the first dimensions on.
    """
    spark = vectors.sparkSession
    finite = F.expr("forall(vector, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")
    valid = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).where("id is not null and size(vector) > 0").where(finite)
    folder = workspace(spark, "topk")
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + F.pow(F.floor(x * scale).cast("double"), F.lit(2.0)))) * (1 + 1e-9)
    left, right = valid(queries), valid(vectors)
    n, m = left.count(), right.count()
    qs, cs = max(1, -(-n // query_block)), max(LEAST_BLOCKS, -(-m // candidate_block))
    block = lambda df, own, blocks: df.withColumn(own, F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    left, right = block(left, "qb", qs), block(right, "cb", cs)
    spread = lambda df, own, others: df.withColumn(own, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))
    unknown = left.withColumn("floor", F.lit(None).cast("double"))
    seed = unknown.groupBy("qb").cogroup(spread(right.where("cb = 0"), "qb", qs).groupBy("qb")).applyInArrow(_pairs(k, scale), SCORES)
    seed = seed.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    floors = seed.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").cast("double").alias("floor")).where(F.col("n") == k)  # a repeated query id may have more; it goes without
    floors = stored(floors.select(F.col("query_id").alias("id"), "floor"), f"{folder}/floors")
    known = left.join(small(floors, floors.count()), "id", "left")
    sides = known.groupBy("qb").agg(F.max(norm).alias("q"), F.min(F.coalesce("floor", F.lit(float("-inf")))).alias("least"))
    pairs = spread(sides, "cb", cs).join(F.broadcast(right.groupBy("cb").agg(F.max(norm).alias("c"))) if cs <= BROADCAST_ROWS else right.groupBy("cb").agg(F.max(norm).alias("c")), "cb")
    pairs = stored(pairs.where(F.col("q") * F.col("c") + 1 >= F.col("least")).select("qb", "cb"), f"{folder}/pairs")
    count = pairs.count()
    left, right = known.join(small(pairs, count), "qb"), right.join(small(pairs, count), "cb")
    partial = left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInArrow(_pairs(k, scale), SCORES)
    best = partial.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries: rows whose vec_id is divisible by 100; candidates: all rows but the query's own."""
    vectors = table(spark, sf_dir, "embeddings")
    return topk(vectors, vectors.where(F.col("vec_id") % 100 == 0))


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM r WHERE rank <= 10
"""
