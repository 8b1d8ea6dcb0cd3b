from collections import defaultdict

from lodestrata.llm import bpe, token_counts
from lodestrata.llm.common import workspace

EVENT = "op string, source string, lang string, tokenizer string, tokens long, old_source string, old_lang string, old_tokenizer string, old_tokens long"


def totals(rollup):
    return {(r.source, r.lang, r.tokenizer): (r.docs, r.tokens) for r in rollup.totals().collect()}


def test_signed_events_and_idempotent_commits(spark):
    rollup = token_counts.Rollup(spark, workspace(spark, "t"))
    none = (None,) * 4
    first = [("insert", "a", "en", "v1", 5, *none), ("insert", "a", "en", "v1", 7, *none), ("insert", None, "en", "v1", None, *none)]
    second = [("revise", "a", "en", "v2", 6, "a", "en", "v1", 5), ("delete", "a", "en", "v1", 7, *none)]
    assert totals(rollup) == {}
    assert rollup.apply("1", spark.createDataFrame(first, EVENT))
    assert not rollup.apply("1", spark.createDataFrame(first, EVENT))
    assert totals(rollup) == {("a", "en", "v1"): (2, 12), (None, "en", "v1"): (1, 0)}
    assert rollup.apply("2", spark.createDataFrame(second, EVENT))
    assert rollup.apply("3", spark.createDataFrame([], EVENT))
    assert totals(rollup) == {("a", "en", "v1"): (0, 0), ("a", "en", "v2"): (1, 6), (None, "en", "v1"): (1, 0)}
    assert rollup.totals(keep_empty=False).count() == 2


def test_unknown_operation_leaves_the_batch_uncommitted(spark):
    rollup = token_counts.Rollup(spark, workspace(spark, "t"))
    row = ("upsert", "a", "en", "v1", 1, None, None, None, None)
    try:
        rollup.apply("1", spark.createDataFrame([row], EVENT))
        raise AssertionError
    except Exception as error:
        assert "unknown operation" in str(error)
    assert not rollup.committed("1")


def test_query_equals_brute_force(spark, tmp_path):
    rows = [(1, "ab cd", "en", "s", 5), (2, None, "en", "s", 0), (3, "", "de", "s", 0), (4, "x " * 3000, None, "t", 6000), (4, "x " * 3000, None, "t", 6000)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    want = defaultdict(lambda: [0, 0])
    encode = bpe.rank_encoder(bpe.vocabulary())
    for _, text, lang, source, _ in rows:
        if n := len(encode(text or "")) // 4:
            want[source, lang, "byte_bpe_50k-1"][0] += 1
            want[source, lang, "byte_bpe_50k-1"][1] += n
    found = {(r.source, r.lang, r.tokenizer): [r.docs, r.tokens] for r in token_counts.op1_token_counts(spark, str(tmp_path)).collect()}
    assert found == dict(want)


def test_compaction_survives_a_crash_anywhere(spark, monkeypatch):
    rollup = token_counts.Rollup(spark, workspace(spark, "t"))
    row = lambda op, n: (op, "a", "en", "v1", n, None, None, None, None)
    assert not rollup.compact()
    for k, n in enumerate((5, 7, 9)):
        rollup.apply(str(k), spark.createDataFrame([row("insert", n)], EVENT))
    want = {("a", "en", "v1"): (3, 21)}
    steps = []
    real, removing = token_counts._marked, token_counts.remove
    for crash in ("totals", "names", "remove"):

        class Writer:
            def __init__(self, df):
                self.own = real(df)

            def parquet(self, path):
                steps.append(path)
                if path.endswith(crash):
                    raise RuntimeError("lost")
                self.own.parquet(path)

        def lost(*_):
            raise RuntimeError("lost")

        monkeypatch.setattr(token_counts, "_marked", Writer)
        monkeypatch.setattr(token_counts, "remove", lost if crash == "remove" else removing)
        try:
            rollup.compact()
        except RuntimeError:
            pass
        assert totals(rollup) == want and rollup.batches() == ["0", "1", "2"]
        monkeypatch.setattr(token_counts, "_marked", real)
        assert not rollup.apply("1", spark.createDataFrame([row("insert", 100)], EVENT))
    monkeypatch.setattr(token_counts, "remove", removing)
    assert not rollup.compact() and rollup._names("deltas") == [] and totals(rollup) == want
    assert rollup.apply("3", spark.createDataFrame([row("delete", 5)], EVENT)) and rollup.compact()
    assert totals(rollup) == {("a", "en", "v1"): (2, 16)} and rollup.batches() == ["0", "1", "2", "3"] and len(rollup._names("compacted")) == 1


def test_query_equals_counts_by_the_library(spark, tmp_path):
    """Counted row by row with the tokenizers library."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_str(bpe.vocabulary())
    rows = [(k, f"Some words {k}, é\n\n  and 12{'x' * (k % 7)} <|endoftext|>" * (k % 5), None if k % 4 == 0 else f"l{k % 3}", "hot" if k % 3 else None) for k in range(90)] + [(None, None, "en", "s"), (1, "repeated", "en", "hot")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    want = defaultdict(lambda: [0, 0])
    for _, text, lang, source in rows:
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        if n:
            want[source, lang][0] += 1
            want[source, lang][1] += n
    found = token_counts.op1_token_counts(spark, str(tmp_path)).collect()
    assert {(r.source, r.lang): [r.docs, r.tokens] for r in found} == dict(want) and {r.tokenizer for r in found} == {"byte_bpe_50k-1"}
