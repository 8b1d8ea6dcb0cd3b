"""Toxicity: a linear-chain conditional random field tags toxic tokens; its marginals give document scores and offsets.

Method. Labels are given per document. Token labels for training come from them: character n-gram features that several
toxic documents have and few clean ones (near copies count once) are seeds; tokens of toxic documents that hold a seed are
labelled toxic, all others clean. On these token labels the field is trained by gradient ascent on its log-likelihood
(forward-backward over all training tokens at once; all toxic rows and twice as many clean ones). A document's score is a
logistic function, fitted on the same rows, of the greatest marginal's log-odds and of the expected number and share of toxic tokens.
The fit reads a bounded sample: at most SAMPLE labelled rows, the first by a hash of the id, while their whole texts sum to at most
SAMPLE_CHARS characters (a text that would exceed the rest is passed over). It runs in one executor task; only the parameters reach the
driver. Scoring reads every whole text and only the text. A token is a run without white space; one of over LONGEST characters, as in scripts
written without spaces, is cut into pieces of PIECE that overlap by OVERLAP, each a token.

Forward and backward messages of a two-state field are ratios, and a step maps them by a Moebius transform. So a batch of
documents is one long chain with resets, cut into equal runs: the maps of each run are composed, the runs' first messages follow,
and then all runs advance together. This is exact and takes the same time for one long text as for many short ones.

Defined cases: null and empty texts have no token and the score of that; rows that repeat get equal scores; a null doc_id is
scored, held_out null-safe false; rows of labels that repeat count once, by the greater label; without labels of both kinds every
score is 0; of rows that share a labelled doc_id the least text is learnt from; an empty table gives no row; other columns are ignored
(op2) or pass through whatever their names (filtered; in the result of scored, _score and _spans replace columns of that name).
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table, tidy

#: Bounds of the fit, and the hashed features (a table of 4 MB, which is broadcast).
SAMPLE, SAMPLE_CHARS, FEATURES = 6_000, 32_000_000, 1 << 20
LEAST_DOCS, LEAST_SHARE, LEAST_ODDS = 6, 0.01, 3.0
CLEAN_SHARE, STEPS, RATE, DECAY = 2, 30, 0.5, 1e-6
#: Characters of the longest token that is left whole and of the pieces of longer ones; pieces share as many as the longest substring
#: feature has but one.
LONGEST, PIECE, OVERLAP = 64, 16, 5
THRESHOLD, SPAN_MARGINAL = 0.3, 0.5
#: Bytes of text that are scored at once, tokens of a step of the fit, and words whose features are made at once: they bound a worker's memory.
BATCH_BYTES, FIT_TOKENS, FIT_WORDS = 1_000_000, 200_000, 50_000
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("marginal", T.DoubleType())]))
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("marginal", pa.float64())]))
_TOKEN = re.compile(r"\S+")
_EDGES = r"^[^\pL\pM\pN]+|[^\pL\pM\pN]+$"
_MULTIPLY, _POWERS = np.uint32(0x9E3779B1), np.cumprod(np.full(LONGEST + 1, 0x85EBCA6B, np.uint32), dtype=np.uint32)


def _parts(a: int, b: int) -> list[tuple[int, int]]:
    """A token's span, cut into pieces that overlap where it is longer than LONGEST, so no substring feature is lost."""
    return [(a, b)] if b - a <= LONGEST else [(i, min(i + PIECE, b)) for i in range(a, b - OVERLAP, PIECE - OVERLAP)]


def tokens(text: str) -> list[tuple[int, int]]:
    """Spans of the tokens: runs without white space, long ones in pieces."""
    return [part for m in _TOKEN.finditer(text) for part in _parts(*m.span())]


def split(text: str) -> list[str]:
    """The tokens of a text."""
    return [text[a:b] for a, b in tokens(text)]


def coded(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct tokens of texts, every token's position among them, and the tokens of each text."""
    lists = pc.utf8_split_whitespace(texts.cast(pa.string()).fill_null(""))
    told = lists.flatten().dictionary_encode()
    words, codes = told.dictionary, told.indices.to_numpy(zero_copy_only=False)
    size = pc.utf8_length(words).to_numpy(zero_copy_only=False)
    first, count, more = np.arange(len(words)), (size > 0).astype(np.int64), []
    for k in np.flatnonzero(size > LONGEST):
        word = words[k].as_py()
        first[k], count[k] = len(words) + len(more), len(_parts(0, len(word)))
        more += [word[a:b] for a, b in _parts(0, len(word))]
    at = lists.offsets.to_numpy(zero_copy_only=False)
    if not more:  # but for empty ones, tokens are what they are
        some = size[codes] > 0
        ends = np.r_[0, np.cumsum(some)]
        return words, codes[some], ends[at[1:] - at[0]] - ends[at[:-1] - at[0]]
    words = pa.concat_arrays([words, pa.array(more, pa.string())])
    counts = count[codes]
    ends = np.r_[0, np.cumsum(counts)]
    out = np.repeat(first[codes] - ends[:-1], counts) + np.arange(ends[-1])
    return words, out.astype(np.int32), ends[at[1:] - at[0]] - ends[at[:-1] - at[0]]


def _hashed(h: np.ndarray, kind: int) -> np.ndarray:
    h = (h ^ np.uint32(kind * 0x27D4EB2F & 0xFFFFFFFF)) * _MULTIPLY
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return ((h ^ (h >> np.uint32(13))) * _MULTIPLY >> np.uint32(12)).astype(np.int32)


def features(words: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashed features and the words that have them: each word, its prefixes of 3 to 6 and its substrings of 4 to 6 characters.

    Case and the punctuation at both ends don't count; a word of punctuation only has one feature.
    """
    if not len(words):
        return
    plain = pc.replace_substring_regex(pc.utf8_lower(words), _EDGES, "")
    size = pc.utf8_length(plain).to_numpy(zero_copy_only=False).astype(np.int64)
    chars = np.frombuffer("".join(plain.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32)
    first = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(size), dtype=np.int32), size)
    place = np.arange(len(chars)) - first[owner]
    left = (size[owner] - place).astype(np.int32)
    whole = np.zeros(len(size), np.uint32)
    if len(chars):
        whole[size > 0] = np.add.reduceat((chars + np.uint32(1)) * _POWERS[np.minimum(place, LONGEST)], first[size > 0])
    yield _hashed(whole, 1), np.arange(len(size), dtype=np.int32)
    h = chars * _MULTIPLY
    for k in range(2, 7):
        if len(chars) < k:
            return
        h = (h[:-1] + chars[k - 1 :]) * _MULTIPLY
        fits = left[: len(h)] >= k
        if k >= 4:
            yield _hashed(h[fits], 2), owner[: len(h)][fits]
        if k >= 3:
            fits &= place[: len(h)] == 0
            yield _hashed(h[fits], 3), owner[: len(h)][fits]


def scan(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """v[t] = (a[t] v[t-1] + b[t]) / (c[t] v[t-1] + d[t]) from v[-1] = 1, for all t."""
    n = len(a)
    if not n:
        return np.empty(0)
    steps = max(1, int(np.sqrt(n)))
    runs = -(-n // steps)
    grid = [np.concatenate([x, np.full(runs * steps - n, pad)]).reshape(runs, steps).T.copy() for x, pad in ((a, 1.0), (b, 0.0), (c, 0.0), (d, 1.0))]
    p, q, r, s = np.ones(runs), np.zeros(runs), np.zeros(runs), np.ones(runs)
    for a_, b_, c_, d_ in zip(*grid, strict=True):
        p, q, r, s = a_ * p + b_ * r, a_ * q + b_ * s, c_ * p + d_ * r, c_ * q + d_ * s
        top = np.maximum(np.maximum(p, q), np.maximum(r, s))
        p, q, r, s = p / top, q / top, r / top, s / top
    first, v = np.empty(runs), 1.0
    for k in range(runs):
        first[k] = v
        v = (p[k] * v + q[k]) / (r[k] * v + s[k])
    out = np.empty((steps, runs))
    v = first
    for t, (a_, b_, c_, d_) in enumerate(zip(*grid, strict=True)):
        v = out[t] = (a_ * v + b_) / (c_ * v + d_)
    return out.T.reshape(-1)[:n]


def messages(x: np.ndarray, starts: np.ndarray, trans: np.ndarray, initial: float) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward ratios (toxic to clean) of tokens with emissions x; starts marks the first tokens of documents."""
    if not len(x):
        return x, x
    one = np.ones_like(x)
    forward = scan(np.where(starts, 0, x * trans[1, 1]), np.where(starts, x * initial, x * trans[0, 1]), np.where(starts, 0, trans[1, 0]), np.where(starts, 1, trans[0, 0]))
    last, ahead = np.r_[starts[1:], True], np.r_[x[1:], 1.0]
    parts = (np.where(last, 0, trans[1, 1] * ahead), np.where(last, one, trans[1, 0]), np.where(last, 0, trans[0, 1] * ahead), np.where(last, one, trans[0, 0]))
    return forward, scan(*(y[::-1] for y in parts))[::-1]


@dataclass
class Model:
    theta: np.ndarray  # emission weights of hashed features
    trans: np.ndarray  # exponentiated transition weights
    initial: float
    bias: float
    weights: np.ndarray  # of the document score

    def marginals(self, emission: np.ndarray, starts: np.ndarray) -> np.ndarray:
        r, b = messages(np.exp(np.clip(emission + self.bias, -30, 30)), starts, self.trans, self.initial)
        return r * b / (1 + r * b)


def document_inputs(p: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Per document: 1, log-odds of the greatest marginal, expected toxic tokens, their share."""
    out = np.zeros((len(lengths), 4))
    out[:, 0], out[:, 1] = 1, -8.0
    some = lengths > 0
    if len(p):
        starts = (np.cumsum(lengths) - lengths)[some]
        top = np.clip(np.maximum.reduceat(p, starts), 1e-9, 1 - 1e-9)
        total = np.add.reduceat(p, starts)
        out[some, 1] = np.clip(np.log(top / (1 - top)), -8, 8)
        out[some, 2] = np.log1p(total)
        out[some, 3] = np.log1p(100 * total / lengths[some])
    return out


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w)), x.T @ (y - p) - 1e-2 * w)
    return w


def _apart(word: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions of documents (word hashes, words of each) that share neither of two least hashes of three words with an earlier one: copies would count as evidence."""
    seen: set[tuple[int, int]] = set()
    out = []
    for k, (end, n) in enumerate(zip(np.cumsum(lengths), lengths, strict=True)):
        own = np.r_[word[end - n : end].astype(np.uint64), np.zeros(max(0, 3 - n), np.uint64)]
        h = ((own[:-2] * np.uint64(0x9E3779B97F4A7C15) + own[1:-1]) * np.uint64(0xBF58476D1CE4E5B9) + own[2:]) * np.uint64(0x94D049BB133111EB)
        keys = {(0, int(h.min())), (1, int(((h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)).min()))}
        if not keys & seen:
            out.append(k)
        seen |= keys
    return np.array(out, np.int64)


def _seeds(docs: Iterator[np.ndarray], toxic: np.ndarray) -> np.ndarray:
    """Features of several toxic documents that few clean ones have. docs: distinct features, one document at a time."""
    hits, n = np.zeros((2, FEATURES), np.int32), np.bincount(toxic.astype(int), minlength=2)
    for own, y in zip(docs, toxic.astype(int), strict=True):
        hits[y, own] += 1
    odds = np.log((hits[1] + 0.5) / (n[1] + 1)) - np.log((hits[0] + 0.5) / (n[0] + 1))
    return np.flatnonzero((hits[1] >= max(LEAST_DOCS, LEAST_SHARE * n[1])) & (odds >= LEAST_ODDS))


class _Features:
    """The features of words, word after word."""

    def __init__(self, flat: np.ndarray, count: np.ndarray):
        self.flat, self.count, self.starts = flat, count, np.cumsum(count) - count

    @classmethod
    def of(cls, words: pa.Array) -> _Features:
        flats, counts = [], []
        for k in range(0, len(words), FIT_WORDS):
            part = words.slice(k, FIT_WORDS)
            found = list(features(part))
            owner = np.concatenate([y for _, y in found])
            flats.append(np.concatenate([x for x, _ in found])[np.argsort(owner, kind="stable")])
            counts.append(np.bincount(owner, minlength=len(part)))
        return cls(np.concatenate(flats), np.concatenate(counts))

    def some(self, which: np.ndarray) -> _Features:
        count = self.count[which]
        at = np.repeat((self.starts[which] - (np.cumsum(count) - count)).astype(np.int32), count)
        at += np.arange(len(at), dtype=np.int32)
        return _Features(self.flat[at], count)

    def sums(self, theta: np.ndarray) -> np.ndarray:
        """Of theta over the features of each word."""
        return np.add.reduceat(theta[self.flat], self.starts).astype(np.float64)

    def spread(self, values: np.ndarray) -> np.ndarray:
        """Sum over the words of their values, by feature."""
        out, step = np.zeros(FEATURES), FIT_WORDS
        for k in range(0, len(self.count), step):
            low, high = self.starts[k], self.starts[k + step] if k + step < len(self.count) else len(self.flat)
            out += np.bincount(self.flat[low:high], weights=np.repeat(values[k : k + step], self.count[k : k + step]), minlength=FEATURES)
        return out


def _marks(lengths: np.ndarray) -> np.ndarray:
    """First tokens of documents of these lengths."""
    starts = np.zeros(lengths.sum(), bool)
    starts[(np.cumsum(lengths) - lengths)[lengths > 0]] = True
    return starts


def _runs(lengths: np.ndarray, size: int) -> Iterator[slice]:
    """Neighbouring documents of about size tokens."""
    bucket, at = (np.cumsum(lengths) - lengths) // size, 0
    for n in np.unique(bucket, return_counts=True)[1]:
        yield slice(at, at + n)
        at += n


def fit(rows: list[tuple[str, int]]) -> Model | None:
    """The field and the score from labelled texts; None without both kinds."""
    return fitted(pa.array([text for text, _ in rows], pa.string()), np.array([bool(y) for _, y in rows], bool))


def fitted(texts: pa.Array, toxic: np.ndarray) -> Model | None:
    """`fit` of texts and whether each is toxic."""
    if not len(texts) or toxic.all() or not toxic.any():
        return None
    words, codes, lengths = coded(texts)
    if not len(codes):
        return None
    known = _Features.of(words)
    ends = np.cumsum(lengths)
    document = lambda k: codes[ends[k] - lengths[k] : ends[k]]
    apart = _apart(known.flat[known.starts][codes], lengths)
    docs = (np.unique(known.some(np.unique(document(k))).flat) for k in apart)
    seeds = np.zeros(FEATURES, bool)
    seeds[_seeds(docs, toxic[apart])] = True
    seeded = np.logical_or.reduceat(seeds[known.flat], known.starts)

    used = np.sort(np.r_[np.flatnonzero(toxic), np.flatnonzero(~toxic)[: max(50, CLEAN_SHARE * int(toxic.sum()))]])
    index, token = np.unique(np.concatenate([document(k) for k in used]), return_inverse=True)
    own, sizes = known.some(index), lengths[used]
    gold = seeded[index[token]] & np.repeat(toxic[used], sizes)
    starts = _marks(sizes)
    inner = ~starts[1:]
    at = np.r_[0, np.cumsum(sizes)]
    chains = [slice(at[run.start], at[run.stop]) for run in _runs(sizes, FIT_TOKENS) if at[run.stop] > at[run.start]]
    theta, rates = np.zeros(FEATURES, np.float32), np.full(FEATURES, 1e-8, np.float32)
    bias, shape = np.log((gold.sum() + 1) / (len(gold) + 2)), np.zeros(5)  # log transitions, log initial ratio
    rate2 = np.full(6, 1e-8)
    pair = np.array([[np.sum(inner & (gold[:-1] == i) & (gold[1:] == j)) for j in (0, 1)] for i in (0, 1)], float)
    seen = np.bincount(token, weights=gold, minlength=len(index))
    for _ in range(STEPS):
        emission = np.exp(np.clip(own.sums(theta) + bias, -30, 30))
        trans, initial = np.exp(shape[:4]).reshape(2, 2), float(np.exp(shape[4]))
        pairs, first, total, off = np.zeros(4), 0.0, 0.0, seen.copy()
        for chain in chains:
            x, begins = emission[token[chain]], starts[chain]
            r, b = messages(x, begins, trans, initial)
            p = r * b / (1 + r * b)
            w = np.stack([np.full(len(x) - 1, trans[0, 0]), trans[0, 1] * x[1:] * b[1:], r[:-1] * trans[1, 0], r[:-1] * trans[1, 1] * x[1:] * b[1:]])
            pairs += (w / w.sum(axis=0))[:, ~begins[1:]].sum(axis=1)
            first, total = first + p[begins].sum(), total + p.sum()
            off -= np.bincount(token[chain], weights=p, minlength=len(index))
        g = own.spread(off) - DECAY * len(token) * theta
        rates += (g * g).astype(np.float32)
        theta += (RATE * g / np.sqrt(rates)).astype(np.float32)
        g2 = np.r_[pair.reshape(-1) - pairs, gold[starts].sum() - first, gold.sum() - total]
        rate2 += g2 * g2
        step = 0.2 * g2 / np.sqrt(rate2)
        shape, bias = np.clip(shape + step[:5], -8, 8), bias + step[5]
    model = Model(theta, np.exp(shape[:4]).reshape(2, 2), float(np.exp(shape[4])), float(bias), np.zeros(4))
    emission, inputs = known.sums(model.theta), []
    for run in _runs(lengths, FIT_TOKENS):
        own_codes = codes[ends[run.start] - lengths[run.start] : ends[run.stop - 1]]
        inputs.append(document_inputs(model.marginals(emission[own_codes], _marks(lengths[run])), lengths[run]))
    model.weights = _logistic(np.concatenate(inputs), toxic.astype(float))
    return model


def score_texts(model: Model, texts: pa.Array) -> tuple[np.ndarray, list[list[dict]]]:
    """(scores, spans) of texts; spans are tokens whose marginal is at least SPAN_MARGINAL."""
    words, codes, lengths = coded(texts)
    weight = np.zeros(len(words))
    for flat, owner in features(words):
        weight += np.bincount(owner, weights=model.theta[flat], minlength=len(words))
    first = np.cumsum(lengths) - lengths
    p = model.marginals(weight[codes], _marks(lengths))
    scores = 1 / (1 + np.exp(-np.clip(document_inputs(p, lengths) @ model.weights, -30, 30)))
    found: list[list[dict]] = [[] for _ in range(len(texts))]
    hits = np.flatnonzero(p >= SPAN_MARGINAL)
    owner = np.searchsorted(first, hits, side="right") - 1  # the last document that starts there: empty ones stand before it
    for k in np.unique(owner):
        places = tokens(texts[k].as_py())
        found[k] = [{"start": places[i - first[k]][0], "end": places[i - first[k]][1], "marginal": float(p[i])} for i in hits[owner == k]]
    return scores, found


def _sized(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about BATCH_BYTES of text each, a row at least."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    for run in _runs(size + 16, BATCH_BYTES):
        yield batch.slice(run.start, run.stop - run.start)


@tidy
def _fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row, the model's parameters, out of the rows of the sample in their order."""
    texts, toxic, left = [], [], SAMPLE_CHARS
    for batch in batches:
        for text, y in zip(batch.column("text"), batch.column("toxic").to_pylist(), strict=True):
            n = pc.utf8_length(text).as_py()
            if n <= left:
                texts.append(text)
                toxic.append(y)
                left -= n
    texts = pa.array([x.as_py() for x in texts], pa.string())
    model = fitted(texts, np.array(toxic, bool))
    if model:
        some = np.flatnonzero(model.theta).astype(np.int32)
        told = pickle.dumps((some, model.theta[some], model.trans, model.initial, model.bias, model.weights))
        yield pa.RecordBatch.from_arrays([pa.array([told], pa.binary())], names=["model"])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Fit on at most `sample` labelled rows whose remainder isn't the held-out one, in one task; the driver gets some MB of parameters."""
    ids = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null and crc32(cast(doc_id as string)) % 4 != 2")
    ids = ids.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where(F.length("text") <= SAMPLE_CHARS)
    rows = texts.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    found = rows.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id").mapInArrow(_fitted, "model binary").collect()
    if not found:
        return None
    some, values, *rest = pickle.loads(found[0]["model"])
    theta = np.zeros(FEATURES, np.float32)
    theta[some] = values
    return Model(theta, *rest)


def _scored(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs under the names _0, _1, ..., with score and spans: names of docs can't clash."""
    kept, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")
    inner = docs.toDF(*(f"_{i}" for i in range(len(docs.columns)))).withColumn(f"_{at}", F.col(f"_{at}").cast("string"))
    names = [*inner.columns, "score", "spans"]

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = kept.value
        for whole in batches:
            for batch in _sized(whole, at):
                n = batch.num_rows
                scores, spans = score_texts(model, batch.column(at)) if model else (np.zeros(n), [[]] * n)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64()), pa.array(spans, _SPANS)], names=names)

    return inner.mapInArrow(run, T.StructType([*inner.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("spans", SPANS)]))


def scored(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs with _score and _spans, the offending tokens' offsets and marginals."""
    own = [F.col(f"_{i}").alias(c) for i, c in enumerate(docs.columns) if c.lower() not in ("_score", "_spans")]
    return _scored(docs, model).select(*own, F.col("score").alias("_score"), F.col("spans").alias("_spans"))


def filtered(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without those that score at least threshold."""
    rows = _scored(docs, train(docs, labels)).where(F.col("score") < threshold)
    return rows.select(*(F.col(f"_{i}").alias(c) for i, c in enumerate(docs.columns)))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document: doc_id, held_out, score, predicted, spans."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = scored(docs, train(docs, table(spark, sf_dir, "labels")))
    held = F.coalesce(F.expr("crc32(cast(doc_id as string)) % 4 = 2"), F.lit(False))
    return rows.select("doc_id", held.alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= THRESHOLD).cast("int").alias("predicted"), F.col("_spans").alias("spans"))
