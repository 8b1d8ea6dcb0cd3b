"""The whole pipeline through run(), on odd tables."""

import os

import pytest
from pyspark.sql import functions as F
from test_text_filters import corpus

import corpus_pipeline
from lodestrata.llm import common

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, gone int, _removed string, score double, hits int, _0 string, component_id long, found string"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("odd")
    rest = (1, "r", 0.5, 2, "z", 3, "f")
    rows = [(k, t, "en", "s", len(t), *rest) for k, t, _ in corpus(n=210)]
    passage = " ".join(f"pass{i}" for i in range(70))
    rows += [(1000 + k, f"{rows[2 + k][1]} {passage} {rows[9 + k][1]}", None, None, None, *rest) for k in range(3)]
    rows += [(1100, rows[1][1], "en", "s", 0, *rest), (1101, None, "en", "s", 0, *rest), (1102, "", "en", "s", 0, *rest), (None, "a text without an id", "en", "s", 0, *rest)]
    rows += [(1103, "my password = Abcdefgh12345678", "en", "s", 0, *rest)] * 2 + [(1104, "word " * 6000, "en", "s", 0, *rest)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(k, y) for k, _, y in corpus(n=210)] * 2, "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_run_packs_what_the_stages_keep(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    rows = out.collect()
    toxic = {k for k, _, y in corpus(n=210) if y}
    kept = {r.doc_id for r in rows}
    assert len(kept & toxic) <= 3 and len(kept - toxic) >= 180
    assert {1101, 1102, 1103, 1104, None} <= kept and len(kept & {1, 1100}) == 1
    assert sum(r.doc_id == 1103 for r in rows) == 2
    for _, group in __import__("itertools").groupby(sorted(rows, key=lambda r: (r.sequence_id, r.offset)), key=lambda r: r.sequence_id):
        at = 0
        for r in group:
            assert r.offset == at and r.length >= 1
            at += r.length
        assert at <= 2048
    long = sorted((r.piece, r.start, r.length) for r in rows if r.doc_id == 1104)
    assert [p for p, _, _ in long] == list(range(len(long))) and all(a[1] + a[2] == b[1] for a, b in zip(long, long[1:], strict=False))


def test_stages_keep_columns_of_any_name(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = common.stored(stage(spark, docs, folder), common.workspace(spark, "t"))
        assert out.schema == docs.schema, name
        other = [c for c in docs.columns if c not in ("text", "n_chars")]
        assert out.select(other).exceptAll(docs.select(other)).count() == 0, name
        assert (name in ("toxicity", "ngram_jaccard_join")) == (out.count() < docs.count()), name
        if name == "substring_dedup":
            assert out.where(F.col("doc_id").between(1000, 1002)).where(F.contains("text", F.lit("pass30"))).count() == 1
        if name == "secret_scan":
            assert {r.text for r in out.where("doc_id = 1103").collect()} == {"my [SECRET]"}
        docs = out


def test_empty_table(spark, folder, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and "sequence_id" in out.columns


def test_run_removes_what_stages_wrote_for_themselves(spark, folder):
    root = f"{common.shared_root(spark)}/lodestrata"
    before = set(os.listdir(root)) if os.path.isdir(root) else set()
    corpus_pipeline.run(spark, folder)
    left = set(os.listdir(root)) - before
    assert len(left) == 1 and left.pop().startswith("pipeline-")
