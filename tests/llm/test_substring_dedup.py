"""Substring dedup against a brute-force version written apart from it, and planted passages."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lodestrata.llm import substring_dedup
from lodestrata.llm.common import workspace


def brute_lines(rows, min_words):
    """Texts after line-wise removal: word lists are compared as they are, runs are sets of line numbers."""
    seen, out = {}, {}
    for doc_id, text in sorted(rows):
        lines = text.split("\n")
        unit = [" ".join(x.split()).lower() for x in lines]
        repeated = {i for i, u in enumerate(unit) if u and u in seen}
        for u in unit:
            seen.setdefault(u, doc_id)
        for i, u in enumerate(unit):  # a line said twice in one document is a repeat of its own first
            if u and u in unit[:i]:
                repeated.add(i)
        filled = [i for i, u in enumerate(unit) if u]
        groups, run = [], []
        for i in filled:
            if i in repeated:
                run.append(i)
            else:
                groups, run = [*groups, run], []
        groups.append(run)
        whole = len(repeated) == len(filled)
        gone = set()
        for g in groups:
            if g and (whole or sum(len(unit[i].split()) for i in g) >= min_words):
                gone |= set(range(g[0], g[-1] + 1))
        out[doc_id] = "\n".join(x for i, x in enumerate(lines) if i not in gone)
    return out


def line_rows(seed=3):
    rng = random.Random(seed)
    pool = [" ".join(f"w{rng.randrange(900)}" for _ in range(rng.randint(1, 14))) for _ in range(60)]
    rows = []
    for k in range(120):
        lines = [rng.choice(pool) if rng.random() < 0.5 else f"own{k} " + " ".join(f"u{rng.randrange(10**9)}" for _ in range(5)) for _ in range(rng.randint(1, 12))]
        rows.append((k, "\n".join(x.upper() if rng.random() < 0.2 else f" {x}\t" if rng.random() < 0.2 else x for x in lines)))
    return rows


@pytest.mark.parametrize("min_words", [0, 20])
@pytest.mark.parametrize("share", [substring_dedup.HOT_SHARE, 1e-9, 0.9])
def test_lines_equal_brute_force(spark, monkeypatch, min_words, share):
    monkeypatch.setattr(substring_dedup, "HOT_SHARE", share)
    monkeypatch.setattr(substring_dedup, "WINDOW", 10**6)  # lines only; windows have tests of their own
    rows = line_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    units = substring_dedup.units(docs).where(F.col("line") < substring_dedup.FIRST_WINDOW)
    monkeypatch.setattr(substring_dedup, "units", lambda _: units)
    found = {r.doc_id: r.text for r in substring_dedup.deduplicated(docs, workspace(spark, "t"), min_words).collect()}
    assert found == brute_lines(rows, min_words)


def planted(seed=5, docs=240):
    """Documents of invented prose; passages of 51 to 80 words stand in several of them, inside lines or as paragraphs."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9)))
    common = [word() for _ in range(300)]
    prose = lambda n: [rng.choice(common) if rng.random() < 0.5 else word() for _ in range(n)]
    texts = [prose(rng.randint(20, 400)) for _ in range(docs)]
    later, passages = {}, {}
    for p in range(25):
        passage, where = prose(rng.randint(51, 80)), rng.sample(range(docs // 2), rng.randint(2, 6))
        for rank, k in enumerate(sorted(where)):
            spot = rng.randint(0, len(texts[k]))
            texts[k] = texts[k][:spot] + (["\n"] if p % 3 == 0 else []) + passage + (["\n"] if p % 3 == 0 else []) + texts[k][spot:]
            if rank:
                later.setdefault(k, []).append(passage)
        passages[min(where)] = passage
    rows = [(k, re.sub(r" ?\n ?", "\n", " ".join(t)) + "\nShared footer line of all") for k, t in enumerate(texts)]
    return rows, later


def test_planted_passages_are_caught_and_clean_documents_left_alone(spark):
    rows, later = planted()
    found = {r.doc_id: r for r in substring_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string"), workspace(spark, "t")).collect()}
    clean = range(120, 240)
    assert sum(not found[k]["_removed"] for k in clean) >= 0.98 * len(clean)
    whole = sum(bool(found[k]["_removed"]) for k in later)
    assert whole >= 0.9 * len(later)
    words = {k: [x for s in found[k]["_removed"] for x in rows[k][1][s.start : s.end].split()] for k in later}
    assert sum(len(set(p) & set(words[k])) >= 0.5 * len(set(p)) for k, ps in later.items() for p in ps) >= 0.9 * sum(map(len, later.values()))
    before = []  # every removed span of 25 words or more stands in an earlier document
    for k, text in rows:
        for s in found[k]["_removed"]:
            span = " ".join(text[s.start : s.end].split()).lower()
            assert s.kept_doc_id < k and any(span in b for b in before)
        before.append(" ".join(text.split()).lower())
        gone = {i for s in found[k]["_removed"] for i in range(s.start, s.end)}
        assert "".join(c for i, c in enumerate(text) if i not in gone).split() == found[k].text.split()


def test_words_equal_the_pattern():
    texts = ["", "a", "  ab\tcd \n\n e" + "f" * 40, "x一二y three", "一", "\n", "İstanbul ÉCOLE école", "z" * 33 + "一" * 3]
    hashes, text, line, glued = substring_dedup.words(texts)
    want = [(k, m[0].lower(), t[: m.start()].count("\n"), m.start() > 0 and not re.match(rf"[{substring_dedup._WHITE}]", t[m.start() - 1])) for k, t in enumerate(texts) for m in substring_dedup._WORDS.finditer(t)]
    assert [(k, i, g) for k, _, i, g in want] == list(zip(text.tolist(), line.tolist(), glued.tolist(), strict=True))
    by_word = {}
    for (_, w, _, _), h in zip(want, hashes.tolist(), strict=True):
        assert by_word.setdefault(w, h) == h
    assert len(set(by_word.values())) == len(by_word)


def test_columns_of_any_name_and_repeated_ids(spark):
    passage = " ".join(f"p{i}" for i in range(70))
    rows = [(1, f"a {passage}", [1], "h", 5), (2, f"b c {passage}", [2], "h", 6), (2, f"b c {passage}", [2], "h", 6), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _removed array<int>, hits string, _id int")
    out = substring_dedup.replaced(docs, workspace(spark, "t"))
    assert out.columns == docs.columns and out.select("_removed", "hits", "_id").subtract(docs.select("_removed", "hits", "_id")).count() == 0
    texts = sorted((r.text or "" for r in out.collect()), key=len)
    assert texts[0] == "" and len(texts[3].split()) == 71 and texts[1] == texts[2] and len(texts[1].split()) <= 2 + 2 * (substring_dedup.PICKED - 1)
    spans = substring_dedup.deduplicated(docs, workspace(spark, "t"))
    assert spans.columns.count("_removed") == 1 and {c.lower() for c in spans.columns} == {"doc_id", "text", "hits", "_id", "_removed"}
    assert substring_dedup.replaced(docs.where("doc_id > 9"), workspace(spark, "t")).count() == 0
