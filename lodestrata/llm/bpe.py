"""Byte-level BPE by a tokenization automaton, and a chunk memo shared by all users of the vocabulary.

Method. The automaton reads tokens and accepts exactly the sequences that the merges produce. It is compiled by successive
merge gadgets: at first one state loops on all bytes. The gadget of merge r, u + v -> w, (1) adds an arc w to every state from
which u and then v can be read, (2) gives u a state of its own, a copy of the old one without the arc v, and (3) lets w lead to
where v led before. So every token leads to one state, and a state is a version of another, less one arc. The automaton is
kept in that form: `rank` (the gadget that made a token), `left` and `right` (what it merged) and `cut` (the gadget that
removed arc t from u's state). Whether state u has arc t is found by walking back through the gadgets (see `arc`), and kept in
a transition table. As the automaton is deterministic, every prefix of a word has one path, hence one state, and any accepted path is
the word's: encoding follows the longest arc first (a byte trie of the labels, and for each label its longest proper prefix, are flat
tables), steps to shorter ones where the state lacks it, and back where it has none; a place that was left so is never tried again.
All new words of a batch are encoded at once: they
take their steps side by side, as lookups in hash tables of the trie, the cuts and the transitions. Decoding emits the labels of the arcs.

Words: the text is cut at single spaces that a visible character follows; the pre-tokenizer always starts a new piece there, so
such chunks encode on their own, the distinct ones of a batch once. Texts with other white space behind a space are encoded whole.

Defined cases: null is the empty text, no ids; the special token's string is one id, as by the library's default; texts of any
length are encoded whole; rows that repeat give equal rows; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

#: Chunks that a generation of the memo holds, and the longest chunk that it keeps: some 60 MB for a Python worker.
MEMO, MEMO_LENGTH = 100_000, 64
#: Slots of the transition table (half of them are filled), bytes from which words are dealt by length, words that are too few to go side by
#: side, words and bytes of text of a step.
ARC_SLOTS, LONG_WORD, FEW, LONG_STEP, STEP_BYTES = 1 << 20, 64, 48, 4096, 1_000_000
# Fixed values of the byte-level scheme: white space as the pre-tokenizer sees it, and its pattern.
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
SPACES = frozenset(SPACE)
PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
ENCODED = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """The file's text, read by the driver; its size is that of a vocabulary, some MB, and so fit to be broadcast."""
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return f.read()


def byte_letters() -> dict[str, int]:
    """Letter of the vocabulary file -> byte: printable bytes stand for themselves, the others follow from 256."""
    shown = [b for a, z in (("!", "~"), ("¡", "¬"), ("®", "ÿ")) for b in range(ord(a), ord(z) + 1)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Table:
    """Whole numbers by keys of 0 or more, in open addressing; all operations take arrays."""

    def __init__(self, slots: int):
        self.bits = max(4, (slots - 1).bit_length())
        self.clear()

    def clear(self) -> None:
        self.keys, self.values, self.held = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32), 0

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Distinct keys that the table lacks."""
        self.held += len(keys)
        at, last = self._slots(keys), (1 << self.bits) - 1
        while len(keys):
            free = np.flatnonzero(self.keys[at] < 0)
            slots, first = np.unique(at[free], return_index=True)
            own = free[first]
            self.keys[slots], self.values[slots] = keys[own], values[own]
            rest = np.ones(len(keys), bool)
            rest[own] = False
            keys, values, at = keys[rest], values[rest], at[rest] + 1 & last

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values of keys; -1 for those that the table lacks."""
        out, last = np.full(len(keys), -1, np.int32), (1 << self.bits) - 1
        rest, at = np.arange(len(keys)), self._slots(keys)
        while len(rest):
            told = self.keys[at]
            hit = told == keys[rest]
            out[rest[hit]] = self.values[at[hit]]
            more = ~hit & (told >= 0)
            rest, at = rest[more], at[more] + 1 & last
        return out


class Automaton:
    """The compiled merges of a byte-level BPE vocabulary."""

    def __init__(self, text: str):
        model, letters = (told := json.loads(text))["model"], byte_letters()
        self.special = {x["content"]: x["id"] for x in told.get("added_tokens", [])}
        label = {t: bytes(letters[c] for c in t) for t in model["vocab"] if t not in self.special}
        size = max([*model["vocab"].values(), *self.special.values()]) + 1
        self.labels = [b""] * size
        for t, i in model["vocab"].items():
            self.labels[i] = label.get(t, t.encode())
        for t, i in self.special.items():
            self.labels[i] = t.encode()
        self.size, self.rank, self.left, self.right, self.cut = size, [-1] * size, [-1] * size, [-1] * size, {}
        for r, merge in enumerate(model["merges"]):
            u, v = merge if isinstance(merge, list) else merge.split(" ")
            self.gadget(r, model["vocab"][u], model["vocab"][v], model["vocab"][u + v])
        self.child: dict[int, int] = {}
        self.token = array("i", [-1])
        self.whole = {label[t]: i for t, i in model["vocab"].items() if t not in self.special}
        for own, i in self.whole.items():
            node = 0
            for b in own:
                key = node << 8 | b
                if (node := self.child.get(key, 0)) == 0:
                    node = self.child[key] = len(self.token)
                    self.token.append(-1)
            self.token[node] = i
        self.size_of = array("i", map(len, self.labels))
        self.shorter = array("i", [-1] * size)  # the longest label that a label goes on from
        for own, i in self.whole.items():
            self.shorter[i] = next((self.whole[own[:k]] for k in range(len(own) - 1, 0, -1) if own[:k] in self.whole), -1)
        self._compile()
        self.flat = np.frombuffer(b"".join(self.labels), np.uint8)
        self.lengths = np.array([len(x) for x in self.labels], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.pieces = regex.compile(PIECES).findall
        self.parts = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split if self.special else None

    def gadget(self, r: int, u: int, v: int, w: int) -> None:
        """Merge r: w from u and v; arc v leaves the state of u."""
        self.cut[u * self.size + v] = r
        if self.rank[w] < 0:
            self.rank[w], self.left[w], self.right[w] = r, u, v

    def arc(self, u: int, t: int) -> bool:
        """Whether the state behind token u has the arc t.

        Only gadgets under `before` count. Where u is the younger token, its state was v's state just before u's gadget; where
        t is, its arc was added to the states that had its left part's arc after t's gadget took effect.
        """
        rank, cut, size, before = self.rank, self.cut, self.size, 1 << 62
        while True:
            r = cut.get(u * size + t)
            if r is not None and r < before:
                return False
            if rank[u] > rank[t]:
                before, u = rank[u], self.right[u]
            elif rank[t] < 0:
                return True
            else:
                before, t = rank[t] + 1, self.left[t]

    def _compile(self) -> None:
        """The trie, the cuts and what the gadgets recorded as flat tables."""
        array_of = lambda x: np.array(x, np.int64)
        self.ranks, self.lefts, self.rights = array_of(self.rank), array_of(self.left), array_of(self.right)
        self.sizes, self.shorts, self.tokens = array_of(self.size_of), array_of(self.shorter), array_of(self.token)
        self.trie, self.cuts, self.arcs = Table(4 * len(self.child)), Table(4 * len(self.cut)), Table(ARC_SLOTS)
        for table, told in ((self.trie, self.child), (self.cuts, self.cut)):
            table.add(np.fromiter(told, np.int64, len(told)), np.fromiter(told.values(), np.int32, len(told)))

    def arcs_of(self, u: np.ndarray, t: np.ndarray) -> np.ndarray:
        """`arc` of many states and labels at once; what was found out is kept in the transition table."""
        keys = u * self.size + t
        found = self.arcs.get(keys)
        new = np.unique(keys[found < 0])
        if not len(new):
            return found > 0
        u, t = np.divmod(new, self.size)
        out, which, before = np.zeros(len(new), np.int32), np.arange(len(new)), np.full(len(new), 1 << 62)
        while len(which):
            r = self.cuts.get(u * self.size + t)
            open_ = (r < 0) | (r >= before)
            whole = open_ & (self.ranks[u] <= self.ranks[t]) & (self.ranks[t] < 0)
            out[which[whole]] = 1
            go = open_ & ~whole
            u, t, which = u[go], t[go], which[go]
            younger = self.ranks[u] > self.ranks[t]
            before = np.where(younger, self.ranks[u], self.ranks[t] + 1)
            u, t = np.where(younger, self.rights[u], u), np.where(younger, t, self.lefts[t])
        if self.arcs.held + len(new) > ARC_SLOTS // 2:
            self.arcs.clear()
        if len(new) <= ARC_SLOTS // 2:
            self.arcs.add(new, out)
        found[found < 0] = out[np.searchsorted(new, keys[found < 0])]
        return found > 0

    def longest_of(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The longest label that goes on from every byte within its word; ends: of each byte's word."""
        found, node, at, deep = np.full(len(data), -1, np.int64), np.zeros(len(data), np.int64), np.arange(len(data)), 0
        while len(at):
            node = self.trie.get(node << 8 | data[at + deep]).astype(np.int64)
            some = node > 0
            at, node, deep = at[some], node[some], deep + 1
            token = self.tokens[node]
            found[at[token >= 0]] = token[token >= 0]
            more = at + deep < ends[at]
            at, node = at[more], node[more]
        return found

    def encode_words(self, data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words that aren't empty (their bytes one after another, and their lengths), and the number of each word's ids."""
        n, ends = len(lengths), np.cumsum(lengths)
        at = ends - lengths
        longest = self.longest_of(data, np.repeat(ends, lengths))
        path, deep, left = np.full((n, int(lengths.max(initial=0))), -1, np.int32), np.zeros(n, np.int64), np.zeros(len(data) + 1, bool)
        t, now = longest[at], np.arange(n)
        while len(now):
            out = now[t[now] < 0]  # no arc is left here: one step back
            left[at[out]] = True
            deep[out] -= 1
            last = path[out, deep[out]].astype(np.int64)
            at[out] -= self.sizes[last]
            t[out] = self.shorts[last]
            own = now[t[now] >= 0]
            label = t[own]
            end = at[own] + self.sizes[label]
            fits = ~(left[end] & (end < ends[own]))
            ask = np.flatnonzero(fits & (deep[own] > 0))
            fits[ask] = self.arcs_of(path[own[ask], deep[own[ask]] - 1].astype(np.int64), label[ask])
            miss, hit = own[~fits], own[fits]
            t[miss] = self.shorts[label[~fits]]
            path[hit, deep[hit]] = label[fits]
            deep[hit] += 1
            at[hit] = end[fits]
            more = hit[at[hit] < ends[hit]]
            t[more] = longest[at[more]]
            now = now[at[now] < ends[now]]
        return path[np.arange(path.shape[1]) < deep[:, None]], deep

    def longest(self, word: bytes, at: int) -> int:
        """The longest label that the word goes on with."""
        child, token, node, found = self.child, self.token, 0, -1
        for b in word[at:]:
            node = child.get(node << 8 | b)
            if node is None:
                break
            if token[node] >= 0:
                found = token[node]
        return found

    def encode_word(self, word: bytes) -> list[int]:
        """The only accepted path over one word's bytes: `encode_words` for a word that has no others beside it."""
        path, left, at, n = [], set(), 0, len(word)
        t = self.longest(word, 0)
        while at < n:
            while t >= 0 and (at + self.size_of[t] in left or path and not self.arc(path[-1], t)):
                t = self.shorter[t]
            if t >= 0:
                path.append(t)
                at += self.size_of[t]
                t = self.longest(word, at)
            else:
                left.add(at)
                t = path.pop()
                at -= self.size_of[t]
                t = self.shorter[t]
        return path

    def encode_all(self, data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """`encode_words` for words of any lengths: those of a like length go side by side where that pays."""
        kind = np.where(lengths <= LONG_WORD, 0, np.frexp(lengths.astype(np.float64))[1])
        ends, counts = np.cumsum(lengths), np.zeros(len(lengths), np.int64)
        parts = []
        for bits, n in zip(*np.unique(kind, return_counts=True), strict=True):
            own = np.flatnonzero(kind == bits)
            if n < FEW or bits > 12:
                paths = [self.encode_word(data[ends[k] - lengths[k] : ends[k]].tobytes()) for k in own]
                parts.append((own, np.array([t for p in paths for t in p], np.int32), np.array([len(p) for p in paths])))
            else:
                parts.append((own, *self.encode_words(data if n == len(kind) else data[np.repeat(kind == bits, lengths)], lengths[own])))
        for own, _, count in parts:
            counts[own] = count
        if len(parts) == 1:
            return parts[0][1], counts
        out, first = np.empty(counts.sum(), np.int32), np.cumsum(counts) - counts
        for own, ids, count in parts:
            out[np.repeat(first[own] - (np.cumsum(count) - count), count) + np.arange(len(ids))] = ids
        return out, counts

    def chunk_ids(self, joined: str, firsts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks behind a single space each and of texts' first chunks, and where in them each begins."""
        pieces = self.pieces(joined)
        starts = np.flatnonzero(np.fromiter((p[0] == " " for p in pieces), bool, len(pieces)))
        own = list(map(self.pieces, firsts))
        begin = np.r_[starts, len(pieces) + np.cumsum([0] + [len(x) for x in own])]
        pieces += [p for x in own for p in x]
        if not pieces:
            return np.empty(0, np.int32), begin
        data = np.frombuffer((joined + "".join(firsts)).encode("utf-8", "surrogatepass"), np.uint8)
        ids, counts = self.encode_all(data, pc.binary_length(pa.array(pieces, pa.string())).to_numpy().astype(np.int64))
        return ids, np.r_[0, np.cumsum(counts)][begin]

    def encode_texts(self, texts: list[str]) -> Iterator[bytes]:
        """`encode_text` of many texts."""
        return in_steps(texts, self.chunk_ids, self.encode_text, self.special)

    def encode_text(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        out = []
        for k, part in enumerate(self.parts(text) if self.parts else [text]):
            if k % 2:
                out.append(np.array([self.special[part]], "<u4").tobytes())
            elif part:
                pieces = self.pieces(part)
                for at in range(0, len(pieces), LONG_STEP):
                    words = [p.encode("utf-8", "surrogatepass") for p in pieces[at : at + LONG_STEP]]
                    out.append(self.encode_all(np.frombuffer(b"".join(words), np.uint8), np.array([len(w) for w in words]))[0].astype("<u4").tobytes())
        return b"".join(out)

    def decode(self, ids: np.ndarray) -> bytes:
        """The labels of the ids, one after another."""
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        if not len(ids):
            return b""
        return self.flat[np.repeat(self.starts[ids] - ends + lengths, lengths) + np.arange(ends[-1])].tobytes()


def in_steps(texts: list[str], chunk_ids: Callable[[str, list[str]], tuple[np.ndarray, np.ndarray]], encode: Callable[[str], bytes], special: dict[str, int]) -> Iterator[bytes]:
    """Ids of each text as little-endian unsigned 32-bit integers; some STEP_BYTES of text are encoded at once."""
    low = held = 0
    for k, text in enumerate(texts):
        held += len(text)
        if held >= STEP_BYTES or k == len(texts) - 1:
            yield from _step(texts[low : k + 1], chunk_ids, encode, special)
            low, held = k + 1, 0


def _step(texts: list[str], chunk_ids, encode, special: dict[str, int]) -> Iterator[bytes]:
    """Ids of texts by their distinct chunks; texts with chunks that don't stand on their own are encoded whole."""
    lists = pc.split_pattern(pa.array(texts, pa.string()), " ")
    told, at = lists.flatten().dictionary_encode(), lists.offsets.to_numpy()
    codes, chunks = told.indices.to_numpy(zero_copy_only=False), told.dictionary.to_pylist()
    leads = at[:-1]
    rest = np.ones(len(codes), bool)
    rest[leads] = False
    alone = np.fromiter((bool(w) and w[0] not in SPACES for w in chunks), bool, len(chunks))
    odd = np.r_[0, np.cumsum(rest & ~alone[codes])]
    whole = odd[at[1:]] > odd[at[:-1]]
    whole |= np.fromiter((any(x in t for x in special) for t in texts), bool, len(texts))
    used = np.flatnonzero(np.bincount(codes[rest], minlength=len(chunks)).astype(bool) & alone)
    ids, place = chunk_ids("".join(f" {chunks[k]}" for k in used.tolist()), [chunks[k] for k in codes[leads].tolist()])
    number = np.full(len(chunks), -1)
    number[used] = np.arange(len(used))
    own = number[codes]
    own[leads] = len(used) + np.arange(len(texts))
    own = np.where(own < 0, len(place) - 1, own)  # of texts that are encoded whole
    size = np.diff(place, append=place[-1])[own]
    ends = np.r_[0, np.cumsum(size)]
    blob = ids[np.repeat(place[own] - ends[:-1], size) + np.arange(ends[-1])].astype("<u4").tobytes()
    for k, text in enumerate(texts):
        yield encode(text) if whole[k] else blob[4 * ends[at[k]] : 4 * ends[at[k + 1]]]


class _Whole(Exception):
    """A chunk that can't be encoded on its own."""


class Memo(dict):
    """Ids of chunks in two generations: when the young one is full it becomes the old one, whose used chunks move on."""

    def __init__(self, encode: Callable[[str], bytes], lead: str):
        self.encode, self.lead, self.old = encode, lead, {}

    def __missing__(self, word: str) -> bytes:
        if self.lead and (not word or word[0] in SPACES):
            raise _Whole
        ids = self.old.get(word)
        if ids is None:
            ids = self.encode(self.lead + word)
        if len(word) <= MEMO_LENGTH:
            if len(self) >= MEMO:
                self.old = dict(self)
                self.clear()
            self[word] = ids
        return ids


class ChunkEncoder:
    """Encodes texts by memoised chunks; encode(str) -> ids must not depend on what precedes a single space."""

    def __init__(self, encode: Callable[[str], bytes]):
        self.encode, self.first, self.rest = encode, Memo(encode, ""), Memo(encode, " ")

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        words = text.split(" ")
        try:
            if words[0] == "" or len(words) == 1:
                if len(words) > 1:
                    return b"".join(map(self.rest.__getitem__, words[1:]))
                return self.first[text] if len(text) <= MEMO_LENGTH else self.encode(text)
            head = self.first[words[0]]
            return head + b"".join(map(self.rest.__getitem__, words[1:]))
        except _Whole:
            return self.encode(text)


_ENCODERS: dict[tuple[str, str], object] = {}


def automaton_encoder(text: str) -> tuple[Automaton, ChunkEncoder]:
    """This process's automaton and memo of a vocabulary; they live as long as the Python worker."""
    key = ("automaton", hashlib.md5(text.encode()).hexdigest())
    if key not in _ENCODERS:
        machine = Automaton(text)
        _ENCODERS[key] = (machine, ChunkEncoder(machine.encode_text))
    return _ENCODERS[key]


class Ranks:
    """The vocabulary as ranks in the tiktoken library; its ids are those of the tokenizers library."""

    def __init__(self, text: str):
        import tiktoken

        told, letters = json.loads(text), byte_letters()
        self.special = {x["content"]: x["id"] for x in told.get("added_tokens", [])}
        ranks = {bytes(letters[c] for c in t): i for t, i in told["model"]["vocab"].items() if t not in self.special}
        self.own, self.names = tiktoken.Encoding("own", pat_str=PIECES, mergeable_ranks=ranks, special_tokens=self.special), frozenset(self.special)
        self.blank = np.zeros(max([*ranks.values(), *self.special.values()]) + 1, bool)
        self.blank[[i for t, i in ranks.items() if t[:1] == b" "]] = True

    def encode_text(self, text: str) -> bytes:
        return array("I", self.own.encode(text, allowed_special=self.names) if any(n in text for n in self.names) else self.own.encode_ordinary(text)).tobytes()

    def chunk_ids(self, joined: str, firsts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As the automaton's: only a chunk's first id begins with a blank."""
        ids, own = np.array(self.own.encode_ordinary(joined), np.int32), [self.own.encode_ordinary(x) for x in firsts]
        begin = np.r_[np.flatnonzero(self.blank[ids]), len(ids) + np.cumsum([0] + [len(x) for x in own])]
        return np.r_[ids, np.array([i for x in own for i in x], np.int32)], begin

    def encode_texts(self, texts: list[str]) -> Iterator[bytes]:
        return in_steps(texts, self.chunk_ids, self.encode_text, self.special)


def rank_tables(text: str) -> Ranks:
    """This process's ranks of a vocabulary; they live as long as the Python worker."""
    key = ("ranks", hashlib.md5(text.encode()).hexdigest())
    if key not in _ENCODERS:
        _ENCODERS[key] = Ranks(text)
    return _ENCODERS[key]


def rank_encoder(text: str) -> ChunkEncoder:
    """The ranks behind a memo, for texts that come one by one."""
    key = ("ranks memo", hashlib.md5(text.encode()).hexdigest())
    if key not in _ENCODERS:
        _ENCODERS[key] = ChunkEncoder(rank_tables(text).encode_text)
    return _ENCODERS[key]


def encoded(docs: DataFrame, vocab: str, text_col: str = "text") -> DataFrame:
    """docs with a column ids, array<int>."""
    kept = docs.sparkSession.sparkContext.broadcast(vocab)
    rest = [c for c in docs.columns if c != "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, _ = automaton_encoder(kept.value)
        for batch in batches:
            ids = pa.array([np.frombuffer(x, "<i4") for x in machine.encode_texts([x.as_py() or "" for x in batch.column(text_col)])], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), ids], names=[*rest, "ids"])

    return docs.select(rest).mapInArrow(run, T.StructType([*docs.select(rest).schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def decoded(rows: DataFrame, vocab: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """rows with the text of their ids; bytes that aren't UTF-8 become the replacement character."""
    kept = rows.sparkSession.sparkContext.broadcast(vocab)
    rest = [c for c in rows.columns if c != out_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, _ = automaton_encoder(kept.value)
        for batch in batches:
            texts = [machine.decode(np.asarray(x.as_py() or [], np.int64)).decode(errors="replace") for x in batch.column(ids_col)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(texts, pa.string())], names=[*rest, out_col])

    return rows.select(rest).mapInArrow(run, T.StructType([*rows.select(rest).schema.fields, T.StructField(out_col, T.StringType())]))


def round_trip(docs: DataFrame, vocab: str) -> DataFrame:
    """Per document: doc_id, number of ids, digest of the ids, digest of the text that the ids decode to."""
    kept = docs.sparkSession.sparkContext.broadcast(vocab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, _ = automaton_encoder(kept.value)
        for batch in batches:
            counts, sums, back = [], [], []
            for ids in machine.encode_texts([x.as_py() or "" for x in batch.column("text")]):
                counts.append(len(ids) // 4)
                sums.append(hashlib.sha256(ids).hexdigest())
                text = machine.decode(np.frombuffer(ids, "<u4")).decode(errors="replace")
                back.append(hashlib.sha256(text.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(sums, pa.string()), pa.array(back, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, ENCODED)


def op6_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded with the byte-level vocabulary and decoded again."""
    return round_trip(table(spark, sf_dir, "documents"), vocabulary())
