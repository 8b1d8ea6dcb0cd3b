"""Toxicity, secrets, substring dedup, and the pipeline that joins them."""

import base64
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestrata.llm import ngram_join, secret_scan, substring_dedup, toxicity
from lodestrata.llm.common import stored, workspace

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(seed=1, n=700):
    """Clean prose of invented words; toxic documents hold two words of a lexicon or of a stem with endings."""
    rng = random.Random(seed)
    syllables = [a + b for a in "bdfgklmnprst" for b in "aeiou"]
    bad = ["grubash", "vlorpix", "zantrog"]
    rows = []
    for k in range(n):
        words = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(15, 60))]
        if toxic := k % 7 == 0:
            for _ in range(2):
                words.insert(rng.randrange(len(words)), rng.choice(bad) + "," if k % 2 else "Xyqua" + rng.choice(syllables))
        rows.append((k, " ".join(words), int(toxic)))
    return rows


# toxicity


def test_scan_and_messages_equal_plain_loops():
    rng = np.random.default_rng(0)
    m = rng.uniform(0.1, 2, (4, 1003))
    want, v = [], 1.0
    for t in range(1003):
        v = (m[0, t] * v + m[1, t]) / (m[2, t] * v + m[3, t])
        want.append(v)
    assert np.allclose(toxicity.scan(*m), want)
    trans, initial, x = np.array([[1.5, 0.6], [0.7, 1.2]]), 0.4, rng.uniform(0.2, 3, 5)
    starts = np.array([True, False, False, True, False])
    r, b = toxicity.messages(x, starts, trans, initial)
    for low, high in ((0, 3), (3, 5)):  # marginals by enumeration
        mass = np.zeros((high - low, 2))
        for code in range(2 ** (high - low)):
            y = [code >> i & 1 for i in range(high - low)]
            w = initial ** y[0] * np.prod([x[low + i] ** y[i] for i in range(high - low)]) * np.prod([trans[a, c] for a, c in zip(y, y[1:], strict=False)])
            for i, s in enumerate(y):
                mass[i, s] += w
        p = (r * b / (1 + r * b))[low:high]
        assert np.allclose(p, mass[:, 1] / mass.sum(axis=1))


def test_scores_of_held_out_documents_and_offsets(spark):
    rows = corpus()
    docs = spark.createDataFrame([(k, t, "x") for k, t, _ in rows], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(k, y) for k, _, y in rows] + [(3, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    found = {r.doc_id: r for r in toxicity.scored(docs, model).collect()}
    held = spark.range(len(rows)).where("crc32(cast(id as string)) % 4 = 2").toPandas()["id"]
    right = [(found[k]["_score"] >= 0.3) == bool(rows[k][2]) for k in held]
    assert np.mean(right) > 0.97
    span = next(s for k in held if rows[k][2] for s in found[k]["_spans"])
    assert span.marginal >= 0.5 and all(0 <= s.start < s.end <= len(rows[k][1]) for k in held for s in found[k]["_spans"])


def test_scores_of_odd_texts(spark):
    rows = corpus()
    model = toxicity.fit([(t, y) for _, t, y in rows])
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "  \n"), (4, "ba " * 50_000), (5, rows[7][1]), (5, rows[7][1]), (None, rows[7][1])], "doc_id long, text string")
    found = toxicity.scored(docs, model).collect()
    assert all(0 <= r["_score"] <= 1 for r in found) and found[0]["_score"] == found[1]["_score"] == found[2]["_score"]
    assert len({r["_score"] for r in found[4:]}) == 1
    assert toxicity.scored(docs.where("doc_id > 9"), model).count() == 0
    assert {r["_score"] for r in toxicity.scored(docs, toxicity.fit([("a", 1)])).collect()} == {0.0}


def test_long_tokens_are_scored_whole(spark):
    model = toxicity.fit([(t, y) for _, t, y in corpus()])
    digits = "0123456789" * 20
    texts = [digits, f"{digits}grubash{digits}", f"{digits}vlorpix"] + ["".join(t.split()) for _, t, _ in corpus(seed=5)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r["_score"] for r in toxicity.scored(docs, model).collect()}
    assert min(found[1], found[2]) > 10 * found[0]
    hits = [y for k, _, y in corpus(seed=5) if found[k + 3] >= toxicity.THRESHOLD]
    assert sum(hits) >= 15 and len(hits) == sum(hits)
    for n in (1, 63, 64, 65, 69, 123, 124, 400):
        spans = toxicity.tokens("z" * n)
        assert spans[0][0] == 0 and spans[-1][1] == n and all(b - a <= 64 for a, b in spans)
        assert set(range(n - 5)) == {i for a, b in spans for i in range(a, b - 5)}
        assert [("z" * n)[a:b] for a, b in spans] == toxicity.split("z" * n)


# secrets

ASSIGN = re.compile(secret_scan.ASSIGN, re.ASCII)


def brute_spans(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer(secret_scan.ACCESS, text) if len(m[0]) >= 18]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer(secret_scan.HEX, text) if len(m[0]) >= 16])


def texts(seed=4, n=300):
    rng = random.Random(seed)
    pool = ["password", "PassWD", "secret", "api_key", "apikey", "token", "=", ":", " ", '"', "'", "AKIA", "ABCDEF0123", "0123456789abcdef", "deadbeef", "é", "\U0001f642", "\n", "x", "some_long.value/with+chars=", "ſecret"]
    return [None, "", "\n"] + ["".join(rng.choice(pool) for _ in range(rng.randint(1, 25))) for _ in range(n)] + ["token=" + "a1" * 50_000, "f" * 40 + " "]


def test_spans_equal_the_patterns(spark, tmp_path):
    rows = [(k, t, "x") for k, t in enumerate(texts())] + [(None, "secret: abcdefghijklmnop", "x")]
    spark.createDataFrame(rows, "doc_id long, text string, spans string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: r for r in secret_scan.op7_secret_scan(spark, str(tmp_path)).collect()}
    assert len(found) == len(rows)
    for doc_id, text, _ in rows:
        spans = brute_spans(text or "")
        told = ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        assert found[doc_id].base_sha256 == hashlib.sha256(told.encode()).hexdigest(), text
        assert [found[doc_id][f"n_{k}"] for k in ("assign", "access", "hex")] == [sum(s[1] == i for s in spans) for i in range(3)]


def test_battery_finds_random_strings_and_leaves_words(spark):
    rng = random.Random(9)
    token = lambda n: base64.b64encode(rng.randbytes(n)).decode().rstrip("=")
    plain = ["TheReportOfTheCommittee2OverTime", "aaaaaaaaaaaaAAAAAAAAAAAA11", "abcdefghijklmnopqrstuvwxyz0123456789", "content-management-system-v2-final", "thisisaverylongidentifierName2024", "ABABABABABABABABABABAB12121212"]
    rows = [(k, f"some text {token(30)} and more") for k in range(200)] + [(1000 + k, f"some text {w} and more") for k, w in enumerate(plain * 5)]
    found = {r.doc_id: len(r.found) for r in secret_scan.scanned(spark.createDataFrame(rows, "doc_id long, text string"), workspace(spark, "t"), ["doc_id"]).collect()}
    assert sum(found[k] for k in range(200)) >= 185
    assert sum(found[1000 + k] for k in range(len(plain) * 5)) <= 2


def test_redaction_keeps_rows_and_columns(spark):
    rows = [(1, "a password=abcdefghijklmnop b", "v"), (2, "clean", "v"), (3, None, "v")]
    out = secret_scan.redacted(spark.createDataFrame(rows, "doc_id long, text string, found string"), workspace(spark, "t"))
    assert sorted(map(tuple, out.collect())) == [(1, "a [SECRET] b", "v"), (2, "clean", "v"), (3, None, "v")]
    assert secret_scan.redacted(out.where("doc_id > 9"), workspace(spark, "t")).count() == 0


# substring dedup


def brute_dedup(rows):
    first, out = {}, {}
    for doc_id, text in sorted(rows, key=lambda r: -1 if r[0] is None else r[0]):
        kept = {}
        for i, line in enumerate((text or "").split("\n")):
            unit = re.sub("[ \t\x0b\x0c\r]+", " ", line).strip(" ").lower()
            if unit:
                if unit in first:
                    kept[i] = first[unit]
                else:
                    first[unit] = doc_id
        out[doc_id] = (None, []) if text is None else substring_dedup.cut(text, kept)
    return out


def test_repeated_passages_go_and_short_lines_stay(spark):
    rng = random.Random(8)
    passage = "\n".join(" ".join(f"p{i}{j}" for j in range(9)) for i in range(7))
    rows = [(k, f"own line {k} is here\n{passage.upper() if k % 2 else passage}\n\nend {k}\nLicensed to all.") for k in range(40)]
    rows += [(100, None), (101, ""), (102, "same line of text\n" * 30), (None, passage), (103, "\n".join(f"l{rng.randrange(50)} a b c d e f" for _ in range(3000)))]
    docs = spark.createDataFrame([(k, t, "v") for k, t in rows], "doc_id long, text string, hits string").repartition(3)
    found = {r.doc_id: r for r in substring_dedup.deduplicated(docs, workspace(spark, "t")).collect()}
    want = brute_dedup(rows)
    assert {k: (r.text, [s.asDict() for s in r["_removed"]]) for k, r in found.items()} == want
    assert "p00" in found[None].text and all("p00" not in found[k].text.lower() and "Licensed" in found[k].text for k in range(40))
    text = dict(rows)[5]
    assert all(text[s.start : s.end].lower() in passage for s in found[5]["_removed"])
    twice = docs.where("doc_id = 0").unionByName(docs.where("doc_id = 0"))
    assert {r.text for r in substring_dedup.deduplicated(twice, workspace(spark, "t")).collect()} == {rows[0][1]}
    assert substring_dedup.deduplicated(docs.where("doc_id > 999"), workspace(spark, "t")).count() == 0


def test_short_copies_and_scripts_without_spaces_go(spark):
    japanese = "".join(chr(0x4E00 + 7 * i) for i in range(70))
    rows = [(3, japanese), (4, f"own\n{japanese}"), (6, "a copy"), (7, "a copy"), (8, "a copy\nand more"), (9, None), (11, "z" * 400), (12, "own line\n" + "z" * 400)]
    found = {r.doc_id: r.text for r in substring_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string"), workspace(spark, "t")).collect()}
    assert found == {3: japanese, 4: "own", 6: "a copy", 7: "", 8: "a copy\nand more", 9: None, 11: "z" * 400, 12: "own line"}


def test_passages_inside_lines_go(spark):
    own = lambda k, n: " ".join(f"o{k}x{i}" for i in range(n))
    words = [f"w{i}" for i in range(120)]
    edited = " ".join([*words[:60], "other", *words[61:]])
    japanese = "".join(chr(0x4E00 + 7 * i) for i in range(70))
    rows = [(1, f"{own(1, 30)} {' '.join(words)} {own(2, 9)}"), (2, f"{own(3, 5)} {edited.upper()} {own(4, 30)}\nshort"), (3, japanese), (4, f"own\n{japanese}"), (5, f"x{japanese[:60]}y"), (6, "a copy"), (7, "a copy"), (8, "a copy\nand more"), (9, None), (10, "ba " * 9000)]
    found = {r.doc_id: r for r in substring_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string"), workspace(spark, "t")).collect()}
    assert [found[k].text for k in (1, 3, 4, 6, 7, 8, 9)] == [rows[0][1], japanese, "own", "a copy", "", "a copy\nand more", None]
    left = found[2].text.split("\n")[0].split()
    kept = [w for w in left if w.startswith("W")]
    assert len(left) - len(kept) == 36 and set(own(3, 5).split() + own(4, 30).split() + ["OTHER"]) == set(left) - set(kept)
    assert len(kept) <= 4 * (substring_dedup.PICKED - 1) and found[2].text.endswith("short") and len(found[5].text) <= 32 and found[5].text[0] == "x"
    assert 1 <= len(found[10].text.split()) <= substring_dedup.PICKED
    for k, text in rows:
        gone = set()
        for s in found[k]["_removed"]:
            assert text[s.start : s.end].strip() and not gone & set(range(s.start, s.end)) and s.kept_doc_id <= k
            gone |= set(range(s.start, s.end))
        assert "".join(c for i, c in enumerate(text or "") if i not in gone).split() == (found[k].text or "").split()


# pipeline


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    rows = [(k, t, "en", "s", len(t)) for k, t, _ in corpus(n=280)]
    long = "\n".join(" ".join(f"q{i}{j}" for j in range(12)) for i in range(5))
    rows += [(1000 + k, rows[1][1] + (f" tail{k}" if k else ""), "en", "s", 0) for k in range(5)]
    rows += [(1100 + k, f"{rows[8 + k][1]}\n{long}", "en", "s", 0) for k in range(3) if (8 + k) % 7]
    rows += [(1200, "the key: token = abcdefghijklmnop1234 and so on", "en", "s", 0), (1201, None, "en", "s", 0), (1202, "", "en", "s", 0)]
    spark.createDataFrame(rows, DOC).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(k, y) for k, _, y in corpus(n=280)], "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages_keep_what_they_should(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, before = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stored(stage(spark, docs, folder), workspace(spark, "t"))
        after = {r.doc_id: r["text"] if "text" in out.columns else None for r in out.collect()}
        if name == "toxicity":
            assert {1000, 1200, 1201, 1202} <= set(after) and sum(k in after for k in range(0, 280, 7)) <= 4 and len(after) > 0.8 * len(before)
        elif name == "ngram_jaccard_join":
            groups = ngram_join.jaccard_components(docs, workspace(spark, "t")).where("doc_id = component_id")
            assert set(after) == {r.doc_id for r in groups.collect()} and not {1000, 1001, 1004} & set(after)
        elif name == "substring_dedup":
            assert after == {k: v[0] for k, v in brute_dedup(list(before.items())).items()}
            assert sum("q00" in (t or "") for t in after.values()) == 1
        elif name == "secret_scan":
            assert set(after) == set(before) and after[1200] == "the key: [SECRET] and so on"
        else:
            assert set(after) == set(before) and out.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0
            break
        assert out.columns == columns
        if name in ("substring_dedup", "secret_scan"):
            assert out.where("n_chars != length(text)").count() == 0
        docs, before = out, after
