import random
from collections import Counter
import zlib
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

from lodestrata.llm import bpe, packing
from lodestrata.llm.common import workspace

ITEM = "doc_id long, piece int, start long, length long, ids_crc32 long"


def check(rows, capacity):
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_best_fit_takes_the_fullest_bin():
    bins, offsets = packing.best_fit(np.array([6, 5, 4, 3, 2]), 10)
    assert bins.tolist() == [0, 1, 0, 1, 1] and offsets.tolist() == [0, 0, 6, 5, 8]


def test_pieces_of_a_document():
    assert packing.cut(1, 8) == [(0, 1)] and packing.cut(8, 8) == [(0, 8)] and packing.cut(19, 8) == [(0, 3), (3, 8), (11, 8)]


def test_tree_of_groups_keeps_every_item_and_packs_tightly(spark):
    rng = random.Random(3)
    items = [(k, 0, 0, rng.choice([1, 3, 9, 17, 40, 64]) if k % 3 else rng.randint(1, 64), k) for k in range(3000)]
    found = packing.packed(spark.createDataFrame(items, ITEM), workspace(spark, "t"), capacity=64, group_items=200, nearly_full=1).collect()
    assert sorted((r.doc_id, r.length) for r in found) == sorted((i[0], i[3]) for i in items)
    whole = packing.best_fit(np.array(sorted((i[3] for i in items), reverse=True)), 64)[0].max() + 1  # one group of all items
    assert check(found, 64) <= 1.02 * whole


def test_items_that_never_fit_together_end(spark):
    items = [(k, 0, 0, 40, k) for k in range(900)]
    found = packing.packed(spark.createDataFrame(items, ITEM), workspace(spark, "t"), capacity=64, group_items=50).collect()
    assert len({r.sequence_id for r in found}) == len(found) == 900


def test_documents_with_nulls_long_texts_and_repeats(spark):
    rows = [(1, None), (2, ""), (3, "word " * 5000), (3, "word " * 5000), (None, "a b c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = packing.pack_documents(docs, bpe.vocabulary(), workspace(spark, "t")).collect()
    check(found, 2048)
    library = Tokenizer.from_str(bpe.vocabulary())
    want = []
    for doc_id, text in rows:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(doc_id, k, s, n, zlib.crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(packing.cut(len(ids), 2048))]
    assert sorted((tuple(r)[:5] for r in found), key=repr) == sorted(want, key=repr)
    assert packing.pack_documents(docs.where("doc_id > 9"), bpe.vocabulary(), workspace(spark, "t")).count() == 0


def test_one_id_in_all_rows_is_dealt_evenly(spark):
    rows = [(None if k % 3 else 7, 0, 0, 1 + k * 37 % 900, k) for k in range(6000)]
    items = spark.createDataFrame(rows, packing.PIECES).repartition(5)
    out = packing.packed(items, workspace(spark, "t"), 2048, group_items=500).collect()
    assert sorted((r.doc_id or 0, r.length, r.ids_crc32) for r in out) == sorted((r[0] or 0, r[3], r[4]) for r in rows)
    first = Counter(r.sequence_id >> 24 & 0xFFFFFFFF for r in out if r.sequence_id >> 56 == 1)
    assert len(first) == 12 and max(first.values()) < 700
    assert len({r.sequence_id for r in out}) <= -(-sum(r[3] for r in rows) // 2048) + 3
