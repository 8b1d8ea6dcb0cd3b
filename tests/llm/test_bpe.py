import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from lodestrata.llm import bpe

POOL = [" ", "  ", "\n", " \n", "\t", "'s", "'ll", "a", "e", "the", "The", " the", "12", "3", "é", "中", "\U0001f642", "​", "\xa0", "\x1c", "\x85", "²", "Ⅷ", "_", "***", "<|endoftext|>", "<|endof", "aaaa", "  x", "\r\n", "　", "ﬁ", "́", "AKIA"]


@pytest.fixture(scope="module")
def own():
    text = bpe.vocabulary()
    return Tokenizer.from_str(text), *bpe.automaton_encoder(text), bpe.rank_encoder(text)


def test_ids_equal_the_library_and_decode_to_the_text(own):
    library, machine, encode, ranks = own
    rng = random.Random(1)
    texts = ["".join(rng.choice(POOL) for _ in range(rng.randint(0, 14))) for _ in range(4000)] + ["", " ", "x" * 5000, "ab " * 3000, " lead", "trail "]
    for text in texts:
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(encode(text), "<u4").tolist() == want, text
        assert np.frombuffer(ranks(text), "<u4").tolist() == want, text
        assert machine.decode(np.array(want, np.int64)).decode() == text


def test_every_letter_is_split_as_the_library_splits(own):
    library, _, encode, ranks = own
    for c in [*range(0, 0x3100), *range(0xA000, 0xA100), 0x1D7D8, 0x1F600]:
        if not 0xD800 <= c < 0xE000:
            text = f"a{chr(c)} {chr(c)}b {chr(c)}{chr(c)}1"
            want = np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
            assert encode(text) == want and ranks(text) == want, hex(c)


def test_automaton_accepts_exactly_the_merges(own):
    """Of all splits of a word into tokens only the library's is a path."""
    library, machine, _, _ = own
    ids = {machine.labels[i]: i for i in range(machine.size) if i not in machine.special.values()}

    def splits(word):
        if not word:
            yield []
        for k in range(1, len(word) + 1):
            if word[:k] in ids:
                yield from ([ids[word[:k]], *rest] for rest in splits(word[k:]))

    for word in (b"thering", b"aaaaaa", b"reading", b"ststst"):
        accepted = [p for p in splits(word) if all(machine.arc(a, b) for a, b in zip(p, p[1:], strict=False))]
        assert accepted == [library.encode(word.decode()).ids]


def test_round_trip_of_nulls_and_empty_tables(spark):
    rows = [(1, None, "x"), (2, "", "x"), (None, "a b", "x"), (3, "é <|endoftext|>\n", "x"), (3, "é <|endoftext|>\n", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    found = sorted(map(tuple, bpe.round_trip(docs, bpe.vocabulary()).collect()), key=repr)
    library = Tokenizer.from_str(bpe.vocabulary())
    want = []
    for doc_id, text, _ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want.append((doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert found == sorted(want, key=repr)
    assert bpe.round_trip(docs.where("doc_id > 9"), bpe.vocabulary()).count() == 0
    both = bpe.decoded(bpe.encoded(docs, bpe.vocabulary()), bpe.vocabulary())
    assert {(r.text or "") == r.decoded for r in both.collect()} == {True}


def test_batches_equal_the_library(own):
    """Words side by side, long ones, odd bytes; a memo that overflows within a step."""
    library, machine, _, _ = own
    rng = random.Random(3)
    texts = [" ".join("".join(rng.choice("aeioustrnlé中\U0001f642_1") for _ in range(rng.choice([1, 3, 6, 12, 70, 300]))) + rng.choice(["", ",", "\n", "<|endoftext|>"]) for _ in range(rng.randint(0, 40))) for _ in range(300)]
    texts += ["", " ", "x" * 5000, "y" * 4097 + " " + "z" * 65, "\x00\x01 \x7f"]
    texts += [" a", "b ", "\n\nc d", "e\n f", "\u3000 g", " \u3000", "<|endoftext|>"]
    for text, ids in zip(texts, machine.encode_texts(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text
    assert list(bpe.rank_tables(bpe.vocabulary()).encode_texts(texts)) == list(machine.encode_texts(texts))
    words = [w.encode() for w in {w for t in texts for w in t.split()}]
    ids, counts = machine.encode_all(np.frombuffer(b"".join(words), np.uint8), np.array([len(w) for w in words]))
    paths = [machine.encode_word(w) for w in words]
    assert counts.tolist() == [len(p) for p in paths] and ids.tolist() == [t for p in paths for t in p]
    assert list(machine.encode_texts([])) == []
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 40, 3000))
    table = bpe.Table(2 * len(keys))
    table.add(keys[::2], np.arange(len(keys[::2]), dtype=np.int32))
    assert table.get(keys).tolist() == [k // 2 if k % 2 == 0 else -1 for k in range(len(keys))]
