"""The field against plain loops, and the query's contract on odd tables."""

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lodestrata.llm import toxicity

from test_text_filters import corpus

MASK = 0xFFFFFFFF


def hashed(h, kind):
    """The table position of a feature's 32-bit sum, by plain integers."""
    h = (h ^ (kind * 0x27D4EB2F & MASK)) * 0x9E3779B1 & MASK
    h = (h ^ h >> 15) * 0x2C1B3C6D & MASK
    return ((h ^ h >> 13) * 0x9E3779B1 & MASK) >> 12


def rolled(part):
    h = ord(part[0]) * 0x9E3779B1 & MASK
    for c in part[1:]:
        h = (h + ord(c)) * 0x9E3779B1 & MASK
    return h


def loop_features(token):
    word = token.strip(".,;!?'\"()").lower()
    out = [hashed(sum((ord(c) + 1) * pow(0x85EBCA6B, i + 1, 1 << 32) for i, c in enumerate(word)) & MASK, 1)]
    out += [hashed(rolled(word[:k]), 3) for k in range(3, 7) if len(word) >= k]
    return out + [hashed(rolled(word[i : i + k]), 2) for k in (4, 5, 6) for i in range(len(word) - k + 1)]


def loop_score(model, text):
    """A document's score and marginals by the textbook's alphas and betas."""
    words = text.split()
    x = [math.exp(sum(float(model.theta[f]) for f in loop_features(w)) + model.bias) for w in words]
    n, alpha, beta = len(x), [], [[1.0, 1.0]]
    for i in range(n):
        own = [1.0, model.initial * x[0]] if i == 0 else [sum(alpha[-1][a] * model.trans[a, b] for a in (0, 1)) * (x[i] if b else 1.0) for b in (0, 1)]
        alpha.append([v / sum(own) for v in own])
    for i in range(n - 1, 0, -1):
        own = [sum(model.trans[a, b] * (x[i] if b else 1.0) * beta[0][b] for b in (0, 1)) for a in (0, 1)]
        beta.insert(0, [v / sum(own) for v in own])
    p = [a[1] * b[1] / (a[0] * b[0] + a[1] * b[1]) for a, b in zip(alpha, beta, strict=False)]
    told = [1.0, -8.0, 0.0, 0.0]
    if p:
        told = [1.0, max(-8, min(8, math.log(max(p) / (1 - max(p))))), math.log1p(sum(p)), math.log1p(100 * sum(p) / n)]
    return 1 / (1 + math.exp(-sum(a * b for a, b in zip(told, model.weights, strict=True)))), p


def test_scores_and_spans_equal_plain_loops():
    rows = corpus()
    model = toxicity.fit([(t, y) for _, t, y in rows])
    texts = [t for _, t, _ in rows[:60]] + ["", " ", "?! -- grubash", "Xyquaba, x"]
    scores, spans = toxicity.score_texts(model, pa.array(texts))
    for text, score, found in zip(texts, scores, spans, strict=True):
        want, p = loop_score(model, text)
        assert abs(score - want) < 1e-6
        assert [text[s["start"] : s["end"]] for s in found] == [w for w, q in zip(text.split(), p, strict=True) if q >= toxicity.SPAN_MARGINAL]
        assert np.allclose([s["marginal"] for s in found], [q for q in p if q >= toxicity.SPAN_MARGINAL], atol=1e-6)
    alone = [toxicity.score_texts(model, pa.array([t]))[0][0] for t in texts]
    assert np.allclose(alone, scores, atol=1e-12)


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 == 2


def write(spark, folder, documents, labels):
    spark.createDataFrame(documents, "doc_id long, text string, score string, _spans int").write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string").write.mode("overwrite").parquet(f"{folder}/labels.parquet")
    return {(r.doc_id, r.n): r for r in toxicity.op2_toxicity(spark, str(folder)).withColumn("n", F.round("score", 9)).collect()}


def test_query_on_odd_rows(spark, tmp_path):
    rows = corpus()
    documents = [(k, t, "x", 1) for k, t, _ in rows] + [(None, rows[7][1], "x", 1), (5000, None, "x", 1), (5001, "", "x", 1), (7, rows[7][1], "x", 1), (7, "another text of that id", "x", 1)]
    labels = [(k, 1, y, "t") for k, _, y in rows] + [(k, 0, 0, "t") for k, _, _ in rows[::3]] + [(None, 1, 1, "t"), (3, 1, None, "t")]
    found = write(spark, tmp_path, documents, labels)
    one = {k: r for (k, _), r in found.items() if k != 7}
    assert len(one) == len(rows) + 2 and sum(k == 7 for k, _ in found) == 2
    assert all(r.held_out == held(k) and r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for (k, _), r in found.items())
    assert one[5000].score == one[5001].score < 0.3
    assert (7, round(one[None].score, 9)) in found
    assert np.mean([one[k].predicted == y for k, _, y in rows if held(k) and k != 7]) > 0.97
    flipped = [(k, q, 1 - y if held(k) and y is not None else y, t) for k, q, y, t in labels]
    again = write(spark, tmp_path, documents, flipped)
    assert set(again) == set(found)
    assert not write(spark, tmp_path, [], labels)
    assert {r.score for r in write(spark, tmp_path, documents[:20], []).values()} == {0.0}


def test_filter_passes_columns_of_any_name(spark):
    rows = corpus(n=210)
    docs = spark.createDataFrame([(k, t, 1.0, [2], "s", "m") for k, t, _ in rows], "doc_id long, text string, _score double, _spans array<int>, _0 string, score string")
    labels = spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id long, toxic int")
    out = toxicity.filtered(docs, labels)
    assert out.columns == docs.columns and out.schema == docs.schema
    kept = {r.doc_id for r in out.collect()}
    assert sum(y for k, _, y in rows if k in kept) <= 2 and len(kept) >= 175
    assert toxicity.scored(docs, None).select("_0", "_score").distinct().collect() == [("s", 0.0)]
    assert toxicity.filtered(docs.where("doc_id < 0"), labels).count() == 0


def test_repeated_ids_of_the_sample_are_learnt_once(spark):
    rows = corpus(n=140)
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows] + [(1, "zz")] * 50, "doc_id long, text string").repartition(7)
    labels = spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id long, toxic int")
    models = [toxicity.train(x, labels) for x in (docs, docs.repartition(3))]
    assert np.array_equal(models[0].theta, models[1].theta) and np.array_equal(models[0].weights, models[1].weights)
