"""Vector columns and exact nearest neighbours.

Queries and vocabulary are dealt into blocks of bounded size by a hash of their ids; a pair of blocks is one group, scored
by a matrix product; what may be among the k best per query is scored again exactly, and the k best leave the group. Neither side is broadcast or collected.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUERY_BLOCK, VECTOR_BLOCK = 2048, 16_384
#: Pairs that are scored at once, and those of them whose vectors are put side by side.
PAIRS, GATHER = 4_000_000, 65_536


def packed(columns: list[str]) -> Column:
    """Scalar columns as one vector."""
    return F.array(*(F.col(c).cast("float") for c in columns))


def unpacked(vector: str, width: int, prefix: str = "emb_") -> list[Column]:
    return [F.get(F.col(vector), F.lit(i)).alias(f"{prefix}{i}") for i in range(width)]


def whole(vector: str) -> Column:
    """Whether a vector is there and none of its components is missing."""
    return F.col(vector).isNotNull() & F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x))


def _matrices(*sides: pa.Table) -> list[np.ndarray]:
    """Vectors as rows; shorter ones count as padded with zeros up to the longest of all sides."""
    lists = [t.column("v").combine_chunks() for t in sides]
    lengths = [x.value_lengths().to_numpy(zero_copy_only=False) for x in lists]
    width = max(int(n.max()) for n in lengths)
    out = [np.zeros((len(n), width)) for n in lengths]
    for rows, x, n in zip(out, lists, lengths, strict=True):
        rows[np.arange(width) < n[:, None]] = x.flatten().to_numpy(zero_copy_only=False)
    return out


def _exact(q: np.ndarray, v: np.ndarray, metric: str) -> np.ndarray:
    """Scores of pairs of columns, summed component by component in doubles: equal vectors have equal scores, wherever they stand."""
    out = np.zeros(q.shape[1])
    for a, b in zip(q, v, strict=True):
        out += (a - b) ** 2 if metric == "l2" else a * b
    return -np.sqrt(out) ** 2 if metric == "l2" else out


def _best(k: int, metric: str):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]]
        if left.num_rows and right.num_rows:
            qs, v = _matrices(left, right)
            qid, vid = (t.column("id").to_numpy() for t in (left, right))
            by_id = np.argsort(vid, kind="stable")  # ties to smaller ids
            v, vid, m = v[by_id], vid[by_id], len(v)
            square = (v**2).sum(axis=1)
            step = max(1, PAIRS // m)
            for at in range(0, len(qs), step):
                q, own = qs[at : at + step], qid[at : at + step]
                near, norm = q @ v.T, (q**2).sum(axis=1)
                if metric == "l2":
                    near = 2 * near - norm[:, None] - square
                # the product's rounding hangs on places: whatever it leaves in doubt is scored again
                doubt = 8 * (q.shape[1] + 8) * np.finfo(float).eps * (norm + square.max() if metric == "l2" else np.sqrt(norm * square.max()))
                floor = np.partition(near, m - k, axis=1)[:, m - k] - doubt if m > k else np.full(len(q), -np.inf)
                row, col = np.nonzero(~(near < floor[:, None]))
                score = np.concatenate([_exact(q[row[i : i + GATHER]].T, v[col[i : i + GATHER]].T, metric) for i in range(0, len(row), GATHER)])
                order = np.lexsort((col, -score, ~np.isnan(score), row))
                counts = np.bincount(row, minlength=len(q))
                order = order[np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts) < k]
                for x, part in zip(out, (own[row[order]], vid[col[order]], score[order]), strict=True):
                    x.append(part)
        return pa.table(dict(zip(("query_id", "id", "score"), map(np.concatenate, out), strict=True)))

    return run


def nearest(queries: DataFrame, vocabulary: DataFrame, k: int = 10, metric: str = "dot", threshold: float | None = None, query_block: int = QUERY_BLOCK, vector_block: int = VECTOR_BLOCK) -> DataFrame:
    """query_id, id, rank, score: the k best of vocabulary (id, v) for each of queries (id, v).

    metric: dot, or l2 (score is minus the square of the distance). Shorter vectors count as padded with zeros. Ties go to the smaller id; scores under threshold go last of all,
    after ranking.
    """
    sides = [df.select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v")).where(whole("v")) for df in (queries, vocabulary)]
    n, m = (df.count() for df in sides)
    qs = max(1, -(-n // query_block))
    vs = max(1, -(-8 // qs), -(-m // vector_block))  # eight groups at least; many queries are enough of them by themselves
    # a block's number has one type on both sides: a group is dealt out by the hash of its keys, and that of a long isn't that of an int
    deal = lambda df, own, blocks, other, others: df.withColumn(own, F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))
    left, right = deal(sides[0], "qb", qs, "vb", vs), deal(sides[1], "vb", vs, "qb", qs)
    found = left.groupBy("qb", "vb").cogroup(right.groupBy("qb", "vb")).applyInArrow(_best(k, metric), "query_id long, id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    out = found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "id", "rank", "score")
    return out if threshold is None else out.where(F.col("score") >= threshold)


def resolved(candidates: DataFrame, least: float) -> DataFrame:
    """candidates (query_id, term, candidate, rank, score) -> query_id, resolved: an equal candidate in any case, else the first if
    its score is at least `least`, else null. What is resolved is always one of the candidates."""
    equal = F.min(F.when(F.lower("term") == F.lower("candidate"), F.struct("rank", "candidate")))["candidate"]
    top = F.min(F.when(F.col("rank") == 1, F.when(F.col("score") >= least, F.col("candidate"))))
    return candidates.groupBy("query_id").agg(F.coalesce(equal, top).alias("resolved"))


def keep_first(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key by order: one aggregate with partial sums."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*").select(*df.columns)
