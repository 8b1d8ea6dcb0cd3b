"""Substring dedup by hashing lines and winnowed word windows.

Method: every text is cut into lines; a line is normalised (lower case, runs of white space as one blank, ends stripped) and
digested. Digests are grouped globally; the occurrence that is first by (doc_id, line number) stays, the others are
repeats. Repeats are removed where they form a passage: a run of repeated lines, blank lines aside, of at least `min_words`
words, or all lines of a document. So short lines that many documents happen to share stay where they are. min_words is a parameter
(MIN_WORDS by default); with 0 every repeated line goes, whatever its length. Removed spans keep their original offsets.

Passages inside lines, or across lines that differ elsewhere, are found by windows of WINDOW words: of every PICKED neighbouring
windows the least by hash is a unit of the same grouping (winnowing), so two texts that share WINDOW + PICKED - 1 words share a
unit whatever is around them. Repeated windows are cut from the lines that stay, where they leave min_words words or more to cut; a
passage's first and last PICKED - 1 words may stay. Every removed word has an earlier copy, so by induction its first one stays. A word is a run without white space, at most
16 characters at once, or one character of a script written without spaces.

Digests are pre-aggregated before the shuffle, so that a line that a third of all rows hold is one partial row per task. In the join
back to the units, the digests of at least a HOT_SHARE of all units, of which there are at most 1 / HOT_SHARE, are broadcast; all others go by
shuffle, so no key brings more than that share of the rows to one task.

Defined cases: null text is returned as null, without spans; an empty text as it is; a null doc_id ranks first; rows that repeat a
doc_id are one document, and the lines at one place don't count as repeats of each other; ties can't occur beyond that; texts of
any length are read whole; an empty table gives no row; other columns (whatever their names) pass through. The result's _removed
replaces a column of that name in `deduplicated`, not in `replaced`.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import remove, stored, table, tidy, workspace

#: Words of the shortest run of repeated lines that is removed.
MIN_WORDS = 20
SPANS = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "end", "kept_doc_id")]))
#: Words of a window, and neighbouring windows of which one is picked: each shared run of 40 words holds a unit.
WINDOW, PICKED, STEP = 25, 16, 12
#: Windows are numbered behind all lines.
FIRST_WINDOW = 1 << 40
#: Characters of the longest word, bytes of text that are digested at once, and the share of all units from which a digest is hot.
LONGEST, BATCH_BYTES, HOT_SHARE = 16, 500_000, 1 / 4096
UNIT = "doc_id long, line long, digest binary"
# White space, and the blocks of scripts that are written without spaces.
_WHITE = " \t\n\x0b\f\r"
_BLOCKS = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF))
_ALONE = "".join(f"{chr(a)}-{chr(b)}" for a, b in _BLOCKS)
_WORDS = re.compile(f"[{_ALONE}]|[^{_WHITE}{_ALONE}]{{1,{LONGEST}}}")
_ODD = np.random.default_rng(25).integers(0, 2**63, LONGEST, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_NONE = np.uint64(2**64 - 1)


@functools.cache
def _characters() -> tuple[np.ndarray, np.ndarray]:
    """By code point: 0 for a word's characters, 1 for white space, 2 for those that are words; and the lower case, where it is one character."""
    kinds = np.zeros(0x110000, np.uint8)
    kinds[[ord(c) for c in _WHITE]] = 1
    for a, b in _BLOCKS:
        kinds[a : b + 1] = 2
    lower = np.fromiter((ord(x) if len(x := chr(i).lower()) == 1 else i for i in range(0x110000)), np.uint32, 0x110000)
    return kinds, lower


def _mixed(h: np.ndarray, times: np.uint64 = _M2) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * times
    return (h ^ (h >> np.uint64(29))) * _M3


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text, line within the text, and whether no white space stands before it, of every word of the texts."""
    kinds, lower = _characters()
    chars = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = kinds[chars]
    before = np.r_[np.uint8(1), kind[:-1]]
    at = np.arange(len(chars), dtype=np.int32)
    place = at - np.maximum.accumulate(np.where((kind == 0) & (before != 0), at, 0))
    place = np.where(kind == 0, place % LONGEST, 0)
    starts = np.flatnonzero((kind == 2) | ((kind == 0) & (place == 0)))
    inside = np.flatnonzero(kind != 1)
    values = (lower[chars[inside]] + np.uint32(1)).astype(np.uint64) * _ODD[place[inside]]
    hashes = _mixed(np.add.reduceat(values, np.searchsorted(inside, starts))) if len(starts) else np.empty(0, np.uint64)
    first = np.cumsum([0] + [len(x) + 1 for x in texts[:-1]])
    text = np.searchsorted(first, starts, side="right") - 1
    breaks = np.cumsum(chars == 10, dtype=np.int32)
    return hashes, text, breaks[starts] - np.r_[0, breaks][first][text], before[starts] != 1


def line_digests(hashes: np.ndarray, text: np.ndarray, line: np.ndarray, glued: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, line and digest (two numbers of 64 bits) of every line that isn't blank; glued words are others than spaced ones."""
    if not len(hashes):
        return text, line, np.empty((0, 2), np.uint64)
    first = np.flatnonzero(np.r_[True, (np.diff(text) != 0) | (np.diff(line) != 0)])
    count = np.diff(np.r_[first, len(hashes)])
    place = np.arange(len(hashes)) - np.repeat(first, count)
    glued = glued & (place > 0)
    out = np.empty((len(first), 2), np.uint64)
    for k, times in enumerate((_M1, _M2)):
        own = _mixed(hashes + glued.astype(np.uint64) * _M3, times)
        powers = np.cumprod(np.full(count.max(), times))
        out[:, k] = _mixed(np.add.reduceat(own * powers[place], first) + count.astype(np.uint64), times)
    return text[first], line[first], out


def _least(h: np.ndarray) -> np.ndarray:
    """Least of every PICKED (a power of two) neighbours."""
    k = 1
    while k < PICKED:
        h = np.minimum(h[:-k], h[k:])
        k *= 2
    return h


def picked(hashes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions and digests (64 and 32 bits) of the picked windows over the word hashes of several texts; no window crosses from one text to the next."""
    n = len(hashes) - WINDOW + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint32)
    h = np.zeros(n, np.uint64)
    for j in range(WINDOW):
        h = h * _M1 + hashes[j : j + n]
    h = np.minimum(_mixed(h), _NONE - np.uint64(1))
    ends = np.repeat(np.cumsum(lengths), lengths)[:n]
    h[np.arange(n) + WINDOW > ends] = _NONE
    pad = np.full(PICKED - 1, _NONE)
    least = _least(np.r_[pad, h, pad])
    most = ~_least(~np.where(least == _NONE, np.uint64(0), least))
    at = np.flatnonzero((h == most) & (h != _NONE))
    if len(at):
        key = np.lexsort((at, h[at], ends[at]))  # one window over and over, as in periodic text: of those within STEP words one, and the last
        place, same = at[key], np.r_[False, (np.diff(at[key]) < STEP) & (np.diff(ends[at[key]]) == 0) & (h[at[key]][1:] == h[at[key]][:-1])]
        step = (place - place[np.maximum.accumulate(np.where(same, 0, np.arange(len(at))))]) // STEP
        at = np.sort(place[~same | (np.diff(step, prepend=-1) != 0) | ~np.r_[same[1:], False]])
    other = np.zeros(len(at), np.uint64)
    for j in range(WINDOW):
        other = other * _M2 + hashes[at + j]
    return at, h[at], (_mixed(other, _M1) >> np.uint64(32)).astype(np.uint32)


def _sized(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about BATCH_BYTES of text each, a row at least."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 16
    at = 0
    for n in np.unique((np.cumsum(size) - size) // BATCH_BYTES, return_counts=True)[1].tolist():
        yield batch.slice(at, n)
        at += n


@tidy
def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in _sized(whole, 1):
            hashes, text, line, glued = words([x or "" for x in batch.column(1).to_pylist()])
            lengths = np.bincount(text, minlength=batch.num_rows)
            own, number, digest = line_digests(hashes, text, line, glued)
            at, high, low = picked(hashes, lengths)
            packed = np.empty(len(at), np.dtype([("high", "<u8"), ("low", "<u4")]))
            packed["high"], packed["low"] = high, low
            binary = lambda x, width: pa.Array.from_buffers(pa.binary(width), len(x), [None, pa.py_buffer(x.tobytes())]).cast(pa.binary())
            rows, first = np.r_[own, text[at]], np.cumsum(lengths) - lengths
            lines = np.r_[number.astype(np.int64), FIRST_WINDOW + at - first[text[at]]]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(lines), pa.concat_arrays([binary(digest, 16), binary(packed, 12)])], names=["doc_id", "line", "digest"])


def units(docs: DataFrame) -> DataFrame:
    """doc_id, line and digest of every line that isn't blank; the same of every picked window, line being FIRST_WINDOW and its first word."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_units, UNIT)


def repeats(docs: DataFrame, folder: str) -> DataFrame:
    """doc_id and its repeated lines and windows, with the document that keeps each: array of (line, kept)."""
    found = stored(units(docs), f"{folder}/units")
    first = found.groupBy("digest").agg(F.min(F.struct("doc_id", "line")).alias("first"), F.count("*").alias("n")).where("n > 1")
    first = stored(first, f"{folder}/first")
    least = max(2, int(found.count() * HOT_SHARE) + 1)
    hot, rest = F.broadcast(first.where(F.col("n") >= least)), first.where(F.col("n") < least)
    later = found.join(hot, "digest").unionByName(found.join(hot, "digest", "left_anti").join(rest, "digest"))
    later = later.where(~F.struct("doc_id", "line").eqNullSafe(F.col("first")))
    one = later.select("doc_id", F.struct("line", F.col("first.doc_id").alias("kept")).alias("hit")).groupBy("doc_id", "hit").agg(F.lit(1).alias("once"))
    return one.groupBy("doc_id").agg(F.collect_list("hit").alias("hits"))


def _window_spans(text: str, windows: dict[int, int | None], starts: list[int], gone: set[int], min_words: int) -> dict[int, list[tuple[int, int, int | None]]]:
    """Line -> start, end and keeping document of its words in windows (first word -> document), where min_words or more of them follow each other outside gone lines."""
    places = [m.span() for m in _WORDS.finditer(text)]
    lines = (np.searchsorted(starts, [a for a, _ in places], side="right") - 1).tolist()
    words: list[tuple[int, int | None]] = []
    done = 0
    for at in sorted(windows):
        words += [(w, windows[at]) for w in range(max(at, done), min(at + WINDOW, len(lines))) if lines[w] not in gone]
        done = at + WINDOW
    out: dict[int, list[tuple[int, int, int | None]]] = {}
    i = 0
    while i < len(words):
        j = i + 1
        while j < len(words) and words[j][0] == words[j - 1][0] + 1:
            j += 1
        for k in range(i, j if j - i >= min_words else i):
            w, own = words[k]
            parts = out.setdefault(lines[w], [])
            if k > i and parts and words[k - 1][1] == own:
                parts[-1] = (parts[-1][0], places[w][1], own)
            else:
                parts.append((*places[w], own))
        i = j
    return out


def cut(text: str, kept: dict[int, int | None], min_words: int = MIN_WORDS) -> tuple[str, list[dict[str, int | None]]]:
    """The text without its repeated runs and windows, and their spans; kept: repeated line or window -> the document that keeps it."""
    lines, out, spans, at = text.split("\n"), [], [], 0
    starts = []
    for x in lines:
        starts.append(at)
        at += len(x) + 1
    least = 0 if all(i in kept or not _WORDS.search(x) for i, x in enumerate(lines)) else min_words
    gone: set[int] = set()  # removed lines, and the blank ones between them
    i = 0
    while i < len(lines):
        if i not in kept:
            i += 1
            continue
        j, end, words = i, i, 0
        while j < len(lines) and (j in kept or not _WORDS.search(lines[j])):
            if j in kept:
                words += len(_WORDS.findall(lines[j]))
                end = j + 1
            j += 1
        if words >= least:
            gone |= set(range(i, end))
        i = end
    windows = {k - FIRST_WINDOW: v for k, v in kept.items() if k >= FIRST_WINDOW}
    parts = _window_spans(text, windows, starts, gone, min_words) if windows else {}
    for i, x in enumerate(lines):
        end = starts[i] + len(x)
        if i in gone:
            if i in kept:
                spans.append({"start": starts[i], "end": end, "kept_doc_id": kept[i]})
        elif i in parts:
            left, at = "", starts[i]
            for a, b, own in parts[i]:
                spans.append({"start": a, "end": b, "kept_doc_id": own})
                left, at = left + text[at:a], b
            left += text[at:end]
            if _WORDS.search(left):
                out.append(left)
        else:
            out.append(x)
    return "\n".join(out), spans


def _apply(names: list[str], at: int, min_words: int):
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kept_doc_id", pa.int64())]))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans = [], []
            for text, hits in zip(batch.column(at), batch.column("hits"), strict=True):
                text, hits = text.as_py(), hits.as_py()
                new, gone = (text, []) if text is None or not hits else cut(text, {h["line"]: h["kept"] for h in hits}, min_words)
                texts.append(new)
                spans.append(gone)
            columns = [pa.array(texts, pa.string()) if i == at else batch.column(c) for i, c in enumerate(names)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(spans, kind)], names=[*names, "removed"])

    return run


def _cut(docs: DataFrame, folder: str, min_words: int) -> DataFrame:
    """docs under the names _0, _1, ..., without repeated passages, and removed: names of docs can't clash."""
    hits = stored(repeats(docs, folder), f"{folder}/repeats").withColumnRenamed("doc_id", "id")
    for name in ("units", "first"):  # nothing reads them any more
        remove(docs.sparkSession, f"{folder}/{name}")
    at, key = docs.columns.index("text"), docs.columns.index("doc_id")
    inner = docs.toDF(*(f"_{i}" for i in range(len(docs.columns)))).withColumn(f"_{at}", F.col(f"_{at}").cast("string"))
    joined = inner.join(hits, F.col(f"_{key}").cast("long").eqNullSafe(F.col("id")), "left").drop("id")
    return joined.mapInArrow(_apply(inner.columns, at, min_words), T.StructType([*inner.schema.fields, T.StructField("removed", SPANS)]))


def replaced(docs: DataFrame, folder: str, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with repeated passages cut out of text; all rows and columns stay."""
    return _cut(docs, folder, min_words).select(*(F.col(f"_{i}").alias(c) for i, c in enumerate(docs.columns)))


def deduplicated(docs: DataFrame, folder: str, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with repeated passages cut out of text, and _removed, the spans in the original text (code points)."""
    own = [F.col(f"_{i}").alias(c) for i, c in enumerate(docs.columns) if c.lower() != "_removed"]
    return _cut(docs, folder, min_words).select(*own, F.col("removed").alias("_removed"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the passages that an earlier one holds: doc_id, text, n_removed, removed (original spans)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return deduplicated(docs, workspace(spark, "dedup")).select("doc_id", "text", F.size("_removed").cast("long").alias("n_removed"), F.col("_removed").alias("removed"))
