import random
import re
from collections import Counter

import pytest

from lodestrata.llm import ngram_join
from lodestrata.llm.common import workspace


def brute(rows):
    def grams(text):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x20\x09-\x0D]+", low)
        return ({tuple(words)} if len(words) < 5 else {tuple(words[i : i + 5]) for i in range(len(words) - 4)}) if words else set()

    sets, parent, where = {k: grams(t) for k, t in rows}, {k: k for k, _ in rows}, {}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, own in sets.items():
        for other, n in Counter(o for g in own for o in where.get(g, ())).items():
            if 100 * n >= 75 * (len(own) + len(sets[other]) - n):
                a, b = root(k), root(other)
                parent[max(a, b)] = min(a, b)
        for g in own:
            where.setdefault(g, []).append(k)
    return {k: (len(sets[k]), root(k)) for k in sets}


def family(rng, first, n, words, edits, vocabulary=400):
    base = [f"w{rng.randrange(vocabulary)}" for _ in range(words)]
    out = [(first, " ".join(base))]
    for k in range(1, n):
        text = list(base)
        for _ in range(rng.randint(0, edits)):
            text[rng.randrange(words)] = f"x{rng.randrange(vocabulary)}"
        out.append((first + k, " ".join(text)))
    return out


@pytest.mark.parametrize("block", [4, 512])
def test_components_equal_brute_force(spark, block):
    rng = random.Random(5)
    rows = family(rng, 0, 60, 120, 6) + family(rng, 100, 12, 40, 3) + family(rng, 200, 5, 8, 1) + family(rng, 300, 40, 90, 9)
    passage = " ".join(f"p{i}" for i in range(30))
    rows += [(400 + k, f"{passage} " + " ".join(f"u{rng.randrange(9999)}" for _ in range(60))) for k in range(30)]
    rows += [(500 + k, f"w{rng.randrange(9999)} " * 30) for k in range(20)]
    rows += [(600, None), (601, ""), (602, " \t\n"), (603, "one Two"), (604, "ONE two"), (605, "one"), (606, "É a b c d e"), (607, "é a b c d e"), (608, "x " * 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = ngram_join.jaccard_components(docs, workspace(spark, "t"), cluster_block=block).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute(rows)


def test_repeated_rows_null_ids_clashing_columns_and_empty_table(spark):
    rows = [(1, "a b c d e f", "x"), (1, "a b c d e f", "y"), (2, "a b c d e f", "z"), (None, "a b c d e f", "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    found = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in ngram_join.jaccard_components(docs, workspace(spark, "t")).collect())
    assert found == [(0, 2, 0), (1, 2, 1), (1, 2, 1), (2, 2, 1)]
    assert ngram_join.jaccard_components(docs.where("doc_id > 9"), workspace(spark, "t")).count() == 0


def test_a_hot_column_is_one_entry_of_a_row_block(spark):
    """A passage that a third of all rows hold: no hash range gets more entries of a column than there are blocks."""
    rng = random.Random(7)
    passage = " ".join(f"p{i}" for i in range(12))
    rows = [(k, (f"{passage} " if k % 3 == 0 else "") + " ".join(f"u{rng.randrange(10**6)}" for _ in range(20))) for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    blocks = docs.mapInArrow(ngram_join._text_blocks(1.0, 4), ngram_join.BLOCKS).collect()
    assert sum(r.docs is not None for r in blocks) == 3
    entries = Counter((r.bucket, h) for r in blocks if r.bucket >= 0 for h in memoryview(r.hashes).cast("I"))
    assert max(entries.values()) <= 3
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(docs, workspace(spark, "t")).collect()}
    assert found == brute(rows)


def test_long_words_and_case():
    texts = ["x" * 200 + " y", "X" * 200 + "  Y\n", "x" * 199 + "z y", "É é", "", " \t", "a b"]
    h, counts = ngram_join.word_hashes(texts)
    assert counts.tolist() == [2, 2, 2, 2, 0, 0, 1]
    assert h[0] == h[2] and h[1] == h[3] == h[5] and len(set(h.tolist())) == 6
