"""N-gram Jaccard join: a blocked sparse matrix product of documents by word n-grams, with size-derived bounds.

A document's row of the incidence matrix is the set of its distinct 5-word shingles (64-bit hashes). Two documents link when
100 * |A and B| >= 75 * |A or B|; then each shares all but a quarter of its shingles with the other.

1. Columns by blocks: the rows are cut into blocks of documents and of hash ranges. Over a fixed share of the hash space, the
   columns that a second document has are found block by block; their numbers per document add up over the blocks. A block sends one
   entry for a column, however many of its documents have it, so a hot column is as many entries as there are blocks. A document
   with more unshared shingles than a quarter of its set can't link and is discarded. That leaves the rows of real groups.
2. Those rows are built whole; rows with equal sets are one class, kept by its least doc_id.
3. The product of the classes' rows is again blocked: column counts by hash range give every row its shared columns and their
   frequency, and the bound is applied again, now over whole rows. In the order from rare to frequent the first quarter (plus
   one) of a set must hold a column of every partner; rows that meet in such a column, within sizes that can link, form
   clusters.
4. Inside a cluster the product is accumulated: overlap counts of row pairs, pairs under the size bound discarded. Large
   clusters are first dealt at random into blocks, several times; that finds nearly all their components. The rows outside a
   cluster's main component are then multiplied with all of its rows, block by block, so that no link is lost.

Only ids, hashes and counts are shuffled. Links are never emitted as pairs of a group: a block yields its components.

Defined cases: null and empty texts, and texts without words, have the empty set and link with nothing; fewer than five words are
one shingle; texts of any length are read whole; doc_id identifies a document: rows that repeat it are
returned each, with their own size and the one component that any of them links to; a null doc_id links with nothing; an empty
table gives no row; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import logging
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import input_splits, remove, small, stored, table, tidy, workspace
from .components import components

WORDS, PERCENT = 5, 75
#: Share of the hash space that the first bound looks at; more than a quarter is needed for any bound.
SHARE = 0.4
#: Documents and hashes of a row block, bytes of text that are hashed at once, rows of a cluster block, random dealings of a large cluster.
BLOCK_DOCS, BLOCK_HASHES, TEXT_BYTES, CLUSTER_BLOCK, DEALINGS = 16_384, 1_000_000, 500_000, 512, 3
#: Products of outsiders with the rows of their clusters from which the log has a warning.
LARGE_PRODUCT = 10**10
# Odd multipliers of the rolling combination of word hashes (any would do; fixed so that hashes are the same everywhere).
MIX = tuple(np.uint64(x | 1) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63))

BLOCKS = "bucket int, batch long, docs binary, sizes binary, local binary, hashes binary"
COUNTS = "batch long, docs binary, sizes binary, local binary, df binary"
WHOLE = "bucket int, batch long, docs binary, sizes binary, local binary, hashes binary, df binary"
#: In place of a document's number: the column is shared within its row block already, and its documents know that.
SHARED = 0xFFFF
SIZES = "doc_id long, n long, may_link boolean"
SETS = "doc_id long, n long, class binary, shingles binary"
ACTIVE = "doc_id long, n long, shared binary, prefix array<long>"


#: By byte: white space; and the lower case of A-Z.
_WHITE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_LOWER = np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256)).astype(np.uint64) + np.uint64(1)
_PLACES = np.random.default_rng(5).integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, one after another, and the number of each text's words."""
    blobs = [x.encode("utf-8", "surrogatepass") for x in texts]
    data = np.frombuffer(b"\n".join(blobs) + b"\n", np.uint8)
    white = _WHITE[data]
    starts = np.flatnonzero(~white & np.r_[True, white[:-1]])
    inside = np.flatnonzero(~white)
    first = np.cumsum([0] + [len(x) + 1 for x in blobs[:-1]])
    counts = np.diff(np.searchsorted(starts, np.r_[first, len(data)]))
    if not len(starts):
        return np.empty(0, np.uint64), counts
    heads = np.searchsorted(inside, starts)
    place = np.arange(len(inside)) - np.repeat(heads, np.diff(np.r_[heads, len(inside)]))
    values = _LOWER[data[inside]] * _PLACES[place & 63]
    if place.max() >= 64:  # of longer words, 64 bytes at a time
        far = np.flatnonzero(place >= 64)
        values[far] *= np.cumprod(np.full(int(place.max() >> 6), MIX[0]))[(place[far] >> 6) - 1]
    h = np.add.reduceat(values, heads)
    h = (h ^ (h >> np.uint64(32))) * MIX[1]
    h = (h ^ (h >> np.uint64(29))) * MIX[2]
    return h ^ (h >> np.uint64(32)), counts


def _shingled(h: np.ndarray, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text's word hashes."""
    if not len(h):
        return h
    k = min(words, len(h))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        out = (out ^ (out >> np.uint64(31))) * MIX[i % len(MIX)] + h[i : len(h) - k + 1 + i]
    out ^= out >> np.uint64(33)
    out *= MIX[1]
    out ^= out >> np.uint64(29)
    return np.unique(out)


def shingle_sets(batch: pa.RecordBatch, column: str = "text", words: int = WORDS) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text of a batch; some TEXT_BYTES of text are hashed at once."""
    at = 0
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 16
    for n in np.unique((np.cumsum(size) - size) // TEXT_BYTES, return_counts=True)[1].tolist():
        h, counts = word_hashes([x or "" for x in batch.column(column).slice(at, n).to_pylist()])
        ends = np.cumsum(counts)
        for low, high in zip(ends - counts, ends, strict=True):
            yield _shingled(h[low:high], words)
        at += n


def _ints(blob: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(blob, kind)


def _batch(schema: str, columns: dict[str, list]) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64())}
    fields = [x.split(" ") for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(columns[n], kinds[k]) for n, k in fields], names=[n for n, _ in fields])


def _row_blocks(rows: Iterator[tuple[int | None, np.ndarray]], share: float, most: int = BLOCK_HASHES) -> Iterator[tuple[int, list[int], list[np.ndarray], list[int]]]:
    """Blocks of rows: number, ids, hashes within the share, sizes of the whole sets."""
    top, number = np.uint64(min(int(share * 2**64), 2**64 - 1)), TaskContext.get().partitionId() << 32
    ids, sampled, sizes, held = [], [], [], 0
    for doc_id, own in rows:
        ids.append(-(2**63) if doc_id is None else doc_id)
        sampled.append(own if share >= 1 else own[: np.searchsorted(own, top)].copy())
        sizes.append(len(own))
        held += len(sampled[-1])
        if len(ids) >= BLOCK_DOCS or held >= most:
            yield number, ids, sampled, sizes
            ids, sampled, sizes, held, number = [], [], [], 0, number + 1
    if ids:
        yield number, ids, sampled, sizes


def _postings(sampled: list[np.ndarray], width: np.uint64) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A block's distinct hashes in order, the documents of each and their number, and where a new hash range begins."""
    local = np.repeat(np.arange(len(sampled), dtype=np.uint16), [len(x) for x in sampled])
    h = np.concatenate(sampled)
    order = np.argsort(h, kind="stable")
    h, local = h[order], local[order]
    first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.empty(0, np.int64)
    h, counts = h[first], np.diff(np.r_[first, len(h)])
    return h, local, counts, np.flatnonzero(np.diff((h // width).astype(np.int64))) + 1


def _text_blocks(share: float, buckets: int):
    """Row blocks cut by hash range: of every column one entry, and only the low half of its hash, which within a range tells nearly all apart.

    A column that two documents of the block have is shared: they are told so here, and its entry only tells other blocks.
    """
    width = np.uint64(-(-int(share * 2**64) // buckets))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((d, own) for b in batches for d, own in zip(b.column("doc_id").to_pylist(), shingle_sets(b), strict=True))
        for batch, ids, sampled, sizes in _row_blocks(rows, share):
            h, local, counts, cuts = _postings(sampled, width)
            known = np.bincount(local[np.repeat(counts > 1, counts)], minlength=len(ids))
            both = np.array(sizes, np.int64) | (np.array([len(x) for x in sampled]) - known) << 32  # whole size, and columns not yet known to be shared
            first = np.cumsum(counts) - counts
            one = np.where(counts > 1, SHARED, local[first]).astype(np.uint16) if len(h) else local
            columns: dict[str, list] = {"bucket": [-1 - batch % buckets], "batch": [batch], "docs": [np.array(ids, np.int64).tobytes()], "sizes": [both.tobytes()], "local": [None], "hashes": [None]}
            for hs, ls in zip(np.split(h, cuts), np.split(one, cuts), strict=True):
                if len(hs):
                    for name, x in (("bucket", int(hs[0] // width)), ("batch", batch), ("docs", None), ("sizes", None), ("local", ls.tobytes()), ("hashes", hs.astype(np.uint32).tobytes())):
                        columns[name].append(x)
            yield _batch(BLOCKS, columns)

    return run


def _columns(rows: pa.Table) -> pa.Table:
    """Of a hash range: per row block, the documents whose column another block has too, and how many such columns. Other rows pass."""
    out: dict[str, list] = {x.split(" ")[0]: [] for x in COUNTS.split(", ")}

    def put(*values):
        for name, x in zip(out, values, strict=True):
            out[name].append(x)

    batches = rows.column("batch").to_pylist()
    if rows.column("bucket")[0].as_py() < 0:
        for b, d, n in zip(batches, rows.column("docs").to_pylist(), rows.column("sizes").to_pylist(), strict=True):
            put(b, d, n, None, None)
        return pa.Table.from_batches([_batch(COUNTS, out)])
    hashes, local = [_ints(x.as_py(), "<u4") for x in rows.column("hashes")], [_ints(x.as_py(), "<u2") for x in rows.column("local")]
    which = np.repeat(np.arange(len(batches)), [len(x) for x in hashes])
    h, at = np.concatenate(hashes), np.concatenate(local)
    order = np.argsort(h, kind="stable")
    h, at, which = h[order], at[order], which[order]
    same = h[1:] == h[:-1]
    keep = (np.r_[False, same] | np.r_[same, False]) & (at != SHARED)
    at, which = at[keep], which[keep]
    order = np.argsort(which, kind="stable")
    at, which = at[order], which[order]
    for k, own in enumerate(np.split(at, np.searchsorted(which, np.arange(1, len(batches))))):
        if len(own):
            docs, counts = np.unique(own, return_counts=True)
            put(batches[k], None, None, docs.tobytes(), counts.astype("<u4").tobytes())
    return pa.Table.from_batches([_batch(COUNTS, out)])


def _set_blocks(buckets: int):
    """Row blocks of whole sets: a row (bucket -1) with all postings, and one for each hash range with its columns and their counts."""
    width = np.uint64(-(-(2**64) // buckets))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((d, _ints(s.as_py(), "<u8")) for b in batches for d, s in zip(b.column("doc_id").to_pylist(), b.column("shingles"), strict=True))
        for batch, ids, sampled, sizes in _row_blocks(rows, 1.0, 150_000):
            h, local, counts, cuts = _postings(sampled, width)
            counts = counts.astype("<u4")
            columns = {"bucket": [-1], "batch": [batch], "docs": [np.array(ids, np.int64).tobytes()], "sizes": [np.array(sizes, np.int64).tobytes()], "local": [local.tobytes()], "hashes": [h.tobytes()], "df": [counts.tobytes()]}
            for hs, cs in zip(np.split(h, cuts), np.split(counts, cuts), strict=True):
                if len(hs):
                    for name, x in (("bucket", int(hs[0] // width)), ("batch", batch), ("docs", None), ("sizes", None), ("local", None), ("hashes", hs.tobytes()), ("df", cs.tobytes())):
                        columns[name].append(x)
            yield _batch(WHOLE, columns)

    return run


def _frequencies(rows: pa.Table) -> pa.Table:
    """Of a hash range: the frequency over all blocks of each block's columns, in the block's order. A block has one entry for a column."""
    hashes, counts = [_ints(x.as_py(), "<u8") for x in rows.column("hashes")], [_ints(x.as_py(), "<u4") for x in rows.column("df")]
    _, at = np.unique(np.concatenate(hashes), return_inverse=True)
    df = np.minimum(np.bincount(at, weights=np.concatenate(counts)), 2**31 - 1).astype("<u4")[at]
    ends = np.cumsum([len(x) for x in hashes])
    told = [df[end - len(x) : end].tobytes() for x, end in zip(hashes, ends, strict=True)]
    none = [None] * rows.num_rows
    return pa.Table.from_batches([_batch(WHOLE, {"bucket": rows.column("bucket").to_pylist(), "batch": rows.column("batch").to_pylist(), "docs": none, "sizes": none, "local": none, "hashes": none, "df": told})])


def spare(n, percent: int = PERCENT):
    """The most shingles of a set of n that a linked partner may lack."""
    return n - (n * percent + 99) // 100


def _sizes(percent: int):
    def run(rows: pa.Table) -> pa.Table:
        ids = both = None
        parts = []
        for x in rows.select(["docs", "sizes", "local", "df"]).to_pylist():
            if x["docs"] is not None:
                ids, both = _ints(x["docs"], "<i8"), _ints(x["sizes"], "<i8")
            else:
                parts.append(x)
        n, unshared = both & 0xFFFFFFFF, both >> 32
        shared = np.zeros(len(ids), np.int64)
        for x in parts:
            shared[_ints(x["local"], "<u2")] += _ints(x["df"], "<u4")
        known = ids != -(2**63)
        may = known & (n > 0) & (unshared - shared <= spare(n, percent))
        return pa.Table.from_batches([pa.RecordBatch.from_arrays([pa.array(ids, mask=~known), pa.array(n), pa.array(may)], names=["doc_id", "n", "may_link"])])

    return run


def _prefixes(percent: int):
    def run(rows: pa.Table) -> pa.Table:
        told = sorted(rows.select(["bucket", "docs", "sizes", "local", "hashes", "df"]).to_pylist(), key=lambda x: x["bucket"])
        head, parts = told[0], told[1:]
        ids, n = _ints(head["docs"], "<i8"), _ints(head["sizes"], "<i8")
        out: dict[str, list] = {"doc_id": [], "n": [], "shared": [], "prefix": []}
        if parts:
            df = np.concatenate([_ints(x["df"], "<u4") for x in parts])  # ranges are in the order of hashes
            counts = np.where(df > 1, _ints(head["df"], "<u4"), 0)
            at = _ints(head["local"], "<u2")[np.repeat(df > 1, _ints(head["df"], "<u4"))]
            h, df = np.repeat(_ints(head["hashes"], "<u8"), counts), np.repeat(df, counts)
            order = np.lexsort((h, df, at))
            at, h = at[order], h[order]
            starts = np.searchsorted(at, np.arange(len(ids) + 1))
            for k in range(len(ids)):
                own = h[starts[k] : starts[k + 1]]
                left = int(spare(n[k], percent)) + 1 - (int(n[k]) - len(own))  # unshared columns come first in the order
                if len(own) and left > 0:
                    for name, x in zip(out, (int(ids[k]), int(n[k]), np.sort(own).tobytes(), own[:left].astype(np.int64)), strict=True):
                        out[name].append(x)
        return pa.Table.from_batches([_batch(ACTIVE, out)])

    return run


@tidy
def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: dict[str, list] = {"doc_id": [], "n": [], "class": [], "shingles": []}
        for doc_id, own in zip(batch.column("doc_id").to_pylist(), shingle_sets(batch), strict=True):
            blob = own.tobytes()
            for name, x in zip(out, (doc_id, len(own), hashlib.blake2b(blob, digest_size=16).digest(), blob), strict=True):
                out[name].append(x)
        yield _batch(SETS, out)


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> Iterator[np.ndarray]:
    """Rows of the product of two blocks: for each set on the left, its overlap with every set on the right."""
    which = np.repeat(np.arange(len(right)), [len(x) for x in right])
    h = np.concatenate(right) if right else np.empty(0, np.uint64)
    order = np.argsort(h, kind="stable")
    h, which = h[order], which[order]
    for own in left:
        low, high = np.searchsorted(h, own), np.searchsorted(h, own, side="right")
        runs = high - low
        ends = np.cumsum(runs)
        total = int(ends[-1]) if len(ends) else 0
        yield np.bincount(which[np.repeat(low - ends + runs, runs) + np.arange(total)], minlength=len(right))


def linked(n: int, sizes: np.ndarray, overlap: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    return 100 * overlap >= percent * (n + sizes - overlap)


def _forest(sets: list[np.ndarray], sizes: np.ndarray, percent: int) -> np.ndarray:
    """Least position of each position's component."""
    parent = np.arange(len(sets))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return int(i)

    for i, row in enumerate(overlaps(sets, sets)):
        for j in np.flatnonzero(linked(int(sizes[i]), sizes, row, percent)):
            a, b = root(i), root(int(j))
            if a != b:
                parent[max(a, b)] = min(a, b)
    return np.array([root(i) for i in range(len(sets))])


def _within(percent: int):
    """Of a group of whole blocks (column block): doc_id and the least doc_id that the block's links reach from it."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("block", "ascending"), ("doc_id", "ascending")])
        block, ids, n = (rows.column(c).to_numpy() for c in ("block", "doc_id", "n"))
        blobs = rows.column("shared").combine_chunks()
        out = ids.copy()
        cuts = np.flatnonzero(np.r_[True, block[1:] != block[:-1], True])
        for low, high in zip(cuts[:-1], cuts[1:], strict=True):
            if high - low > 1:
                sets = [_ints(blobs[int(i)].as_py(), "<u8") for i in range(low, high)]
                out[low:high] = ids[low + _forest(sets, n[low:high], percent)]
        return pa.table({"a": ids, "b": out})

    return run


def _between(percent: int):
    """Outsiders of a block against its other rows: a link (a, b) for each pair of components that the block ties."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        a, b = [], []
        if left.num_rows and right.num_rows:
            sides = [([_ints(x.as_py(), "<u8") for x in t.column("shared")], *(t.column(c).to_numpy() for c in ("n", "label"))) for t in (left, right)]
            (sets, n, own), (others, sizes, labels) = sides
            for i, row in enumerate(overlaps(sets, others)):
                hit = np.unique(labels[linked(int(n[i]), sizes, row, percent)])
                hit = hit[hit != own[i]]
                a += [own[i]] * len(hit)
                b += hit.tolist()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _clusters(active: DataFrame, percent: int, folder: str) -> DataFrame:
    """active with cluster: rows that a chain of shared prefix columns, within sizes that can link, connects."""
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent)))
    posts = active.select("doc_id", F.explode("prefix").alias("h"), band.alias("band"))
    posts = posts.select("doc_id", "h", F.explode(F.array("band", F.col("band") + 1)).alias("band"))  # linked sizes share a band
    least = stored(posts.groupBy("h", "band").agg(F.min("doc_id").alias("b"), F.count("*").alias("m")).where("m > 1").drop("m"), f"{folder}/least")
    edges = posts.join(least, ["h", "band"]).where("doc_id != b").select(F.col("doc_id").alias("a"), "b").distinct()
    found = components(edges, f"{folder}/clusters").withColumnRenamed("node", "doc_id").withColumnRenamed("component", "cluster")
    return active.join(small(found, found.count()), "doc_id")


def _links(active: DataFrame, percent: int, folder: str, cluster_block: int) -> DataFrame:
    """node, component of the classes that link with another class."""
    rows = stored(_clusters(active, percent, folder).select("cluster", "doc_id", "n", "shared"), f"{folder}/rows")
    sizes = rows.groupBy("cluster").agg(F.count("*").alias("m"))
    large = stored(sizes.where(F.col("m") > cluster_block), f"{folder}/large")
    count, total = large.count(), rows.count()
    groups = max(32, -(-total // 1024))
    flat = rows.join(small(large, count), "cluster", "left_anti") if count else rows
    dealt = flat.withColumn("block", F.col("cluster")).withColumn("grp", F.pmod(F.xxhash64("cluster"), F.lit(groups)))
    edges = dealt.groupBy("grp").applyInArrow(_within(percent), "a long, b long")
    own = stored(edges.where("a != b"), f"{folder}/flat")
    if not count:
        return own.select(F.col("a").alias("node"), F.col("b").alias("component"))
    big = stored(rows.join(small(large, count), "cluster"), f"{folder}/big")
    blocks = F.ceil(F.col("m") / cluster_block).cast("long")
    tries = big.withColumn("dealing", F.explode(F.sequence(F.lit(0), F.lit(DEALINGS - 1))))
    tries = tries.withColumn("block", F.pmod(F.xxhash64("doc_id", "dealing"), blocks)).groupBy("cluster", "dealing", "block").applyInArrow(_within(percent), "a long, b long")
    first = stored(tries.where("a != b"), f"{folder}/tries")
    label = components(first, f"{folder}/labels")
    label = stored(big.join(label.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("label", F.coalesce("component", "doc_id")).drop("component"), f"{folder}/labelled")
    main = label.groupBy("cluster", "label").count().groupBy("cluster").agg(F.max_by("label", F.struct("count", "label")).alias("main"))
    label = label.join(F.broadcast(main) if count <= 100_000 else main, "cluster")
    outside = label.where("label != main")
    number = F.row_number().over(Window.partitionBy("cluster", "part").orderBy("doc_id")) - 1
    outside = outside.withColumn("part", F.pmod(F.xxhash64("doc_id"), blocks)).withColumn("chunk", F.floor(number / cluster_block)).withColumn("chunk", F.xxhash64("part", "chunk"))
    outside = stored(outside.select("cluster", "m", "chunk", "n", "shared", "label"), f"{folder}/outside")
    chunks = stored(outside.select("cluster", "chunk").distinct(), f"{folder}/chunks")
    product = outside.agg(F.sum("m")).first()[0] or 0
    if product > LARGE_PRODUCT:
        logging.getLogger(__name__).warning("%d pairs of outsiders and rows of their clusters are multiplied: the clusters hold few links for their size", product)
    left = outside.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    right = label.select("cluster", F.pmod(F.xxhash64("doc_id"), blocks).alias("block"), "n", "shared", "label").join(chunks, "cluster")
    keys = ("cluster", "chunk", "block")
    late = stored(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_between(percent), "a long, b long"), f"{folder}/late")
    tied = components(first.unionByName(late), f"{folder}/tied").where("node != component")
    return own.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(tied)


def jaccard_components(docs: DataFrame, folder: str, percent: int = PERCENT, share: float = SHARE, cluster_block: int = CLUSTER_BLOCK) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of docs."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    buckets = max(32, 2 * input_splits(docs))
    blocks = docs.mapInArrow(_text_blocks(share, buckets), BLOCKS)
    counts = blocks.groupBy("bucket").applyInArrow(_columns, COUNTS)
    sizes = stored(counts.groupBy("batch").applyInArrow(_sizes(percent), SIZES), f"{folder}/sizes")
    may = sizes.where("may_link").select("doc_id").distinct()
    sets = stored(docs.join(small(may, may.count()), "doc_id").mapInArrow(_sets, SETS).withColumn("uid", F.monotonically_increasing_id()), f"{folder}/sets")
    classes = sets.groupBy("class").agg(F.min(F.struct("doc_id", "uid")).alias("first")).select("class", F.col("first.doc_id").alias("rep"), F.col("first.uid").alias("uid"))
    classes = stored(classes, f"{folder}/classes")
    whole = sets.join(small(classes.select("uid"), classes.count()), "uid", "left_semi").select("doc_id", "shingles")
    blocks = stored(whole.mapInArrow(_set_blocks(buckets), WHOLE), f"{folder}/blocks", large_cells=True)
    counts = blocks.where("bucket >= 0").select("bucket", "batch", "hashes", "df").groupBy("bucket").applyInArrow(_frequencies, WHOLE)
    active = stored(blocks.where("bucket < 0").unionByName(counts).groupBy("batch").applyInArrow(_prefixes(percent), ACTIVE), f"{folder}/active")
    remove(docs.sparkSession, f"{folder}/blocks")
    found = _links(active, percent, folder, cluster_block)
    ties = sets.select("doc_id", "class").distinct().join(classes.drop("uid"), "class").join(found.withColumnRenamed("node", "rep"), "rep", "left")
    ties = ties.select("doc_id", F.coalesce("component", "rep").alias("component")).groupBy("doc_id").agg(F.min("component").alias("component")).where("doc_id != component")
    return sizes.join(ties, "doc_id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents under links of 5-word shingle Jaccard similarity of 0.75 or more."""
    return jaccard_components(table(spark, sf_dir, "documents"), workspace(spark, "ngrams"))


#: The same rows by plain joins; for small tables.
SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS l FROM documents),
g AS (
  SELECT DISTINCT doc_id, CASE WHEN len(l) < 5 THEN l ELSE l[i:i + 4] END AS s FROM w, unnest(range(1, greatest(len(l) - 4, 1) + 1)) t(i) WHERE len(l) > 0),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 75 * (a.n + b.n - k)),
links AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r AS (SELECT doc_id AS d, doc_id AS c FROM documents UNION SELECT y, c FROM r JOIN links ON x = d),
m AS (SELECT d, min(c) AS c FROM r GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_shingles, c AS component_id FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN m ON d = doc_id
"""
