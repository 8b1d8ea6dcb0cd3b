"""Best-fit packing of documents into sequences by hierarchical residual packing.

Method: documents are tokenised and cut into pieces; full pieces are sequences at once. The others are stored, numbered, and dealt by a hash of the number into
groups of bounded size, and each group is packed by best fit, longest first. Nearly full bins are emitted. The underfull bins
become items themselves and are merged, group by group up a tree, by repeated best fit, until one group is left or merging
no longer shrinks what remains.

Defined cases: null and empty texts are the one id 0; texts of any length are cut into pieces of the sequence length, of which the
first may be shorter; rows that repeat are packed once each (a repeated or null doc_id too, however often); ties go to the row that was stored first; an empty table
gives no row; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import rank_tables, vocabulary
from .common import stored, table, tidy, workspace

SEQUENCE = 2048
#: Pieces of a group of the first round, bins merged into a group later, and the residual under which a bin is emitted.
GROUP_ITEMS, FAN_IN, NEARLY_FULL = 32_768, 4, 8
END_ID = b"\0\0\0\0"
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = f"{PIECES}, sequence_id long, offset long, done boolean"


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each item, in the given order: into the fullest bin that it fits."""
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, n = 0, 0  # bit r: there is a bin with r free
    for i, size in enumerate(lengths.tolist()):
        fits = mask >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            own = room[free].pop()
            if not room[free]:
                mask ^= 1 << free
        else:
            free, own, n = capacity, n, n + 1
        bins[i], offsets[i] = own, capacity - free
        if free > size:
            room[free - size].append(own)
            mask |= 1 << free - size
    return bins, offsets


def cut(total: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document: all full but the first."""
    first = total % capacity or min(total, capacity)
    return [(0, first), *((at, capacity) for at in range(first, total, capacity))]


def pieces(docs: DataFrame, vocab: str, capacity: int = SEQUENCE) -> DataFrame:
    """Every document as pieces: doc_id, piece, start, length, ids_crc32."""
    kept = docs.sparkSession.sparkContext.broadcast(vocab)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = rank_tables(kept.value)
        for batch in batches:
            rows: tuple[list, ...] = ([], [], [], [], [])
            found = ranks.encode_texts([x.as_py() or "" for x in batch.column("text")])
            for doc_id, own in zip(batch.column("doc_id").to_pylist(), found, strict=True):
                ids = memoryview(own + END_ID)
                for k, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    for column, x in zip(rows, (doc_id, k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])), strict=True):
                        column.append(x)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PIECES)


def _round(number: int, capacity: int, nearly_full: int, last: bool):
    def run(rows: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return rows.drop_columns(["grp"])
        rows = rows.sort_by([(c, "ascending") for c in ("sequence_id", "offset", "doc_id", "piece")])
        group = rows.column("grp")[0].as_py()
        length, at, old = (rows.column(c).to_numpy() for c in ("length", "offset", "sequence_id"))
        _, item = np.unique(old, return_inverse=True)
        sizes = np.bincount(item, weights=length).astype(np.int64)
        order = np.argsort(-sizes, kind="stable")
        bins, starts = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
        bins[order], starts[order] = best_fit(sizes[order], capacity)
        free = capacity - np.bincount(bins, weights=sizes).astype(np.int64)
        done = (free[bins] <= nearly_full) | last
        own = (number << 56) | (group << 24)
        for name, values in (("sequence_id", own | bins[item]), ("offset", starts[item] + at), ("done", done[item])):
            rows = rows.set_column(rows.schema.get_field_index(name), name, pa.array(values))
        return rows.drop_columns(["grp"])

    return run


def packed(items: DataFrame, folder: str, capacity: int = SEQUENCE, group_items: int = GROUP_ITEMS, nearly_full: int = NEARLY_FULL) -> DataFrame:
    """items (doc_id, piece, start, length, ids_crc32) with sequence_id and offset."""
    named = items.withColumns({"sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long"), "done": F.col("length") >= capacity})
    named = stored(named.select(*(x.split()[0] for x in PACKED.split(", "))), f"{folder}/items")
    finished, left, number = [named.where("done")], named.where("not done"), 1
    n = left.count()
    groups = max(1, -(-n // group_items))
    while n:
        after = max(-(-groups // FAN_IN), 1)
        dealt = left.withColumn("grp", F.pmod(F.xxhash64("sequence_id"), F.lit(groups)))  # unique to an item, as doc_id needn't be
        rows = stored(dealt.groupBy("grp").applyInArrow(_round(number, capacity, nearly_full, groups == 1), PACKED), f"{folder}/round{number}")
        finished.append(rows.where("done"))
        left, number = rows.where("not done"), number + 1
        n = left.count()
        least = -(-n // (2 * group_items))  # rows of a group stay bounded
        if n and groups > 1 and max(after, least) >= groups:  # merging no longer shrinks what is left
            finished.append(left)
            break
        groups = max(after, least)
    return reduce(DataFrame.unionByName, finished).drop("done")


def pack_documents(docs: DataFrame, vocab: str, folder: str, capacity: int = SEQUENCE) -> DataFrame:
    return packed(pieces(docs, vocab, capacity), folder, capacity)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    return pack_documents(table(spark, sf_dir, "documents"), vocabulary(), workspace(spark, "packing"))
