"""Token counts as delta-maintained rollups.

Method: a batch of events (insert, delete, revise) carries token counts of documents by source, language and tokenizer version.
An insert adds its count, a delete takes it away, a revision takes the old count from where it stood and adds the new one.
Since the totals are additive, a batch is reduced to one signed row per group (partial sums before the shuffle, so a source that
holds a third of all rows costs one row per task) and only these deltas are kept. A batch is committed by the writer's own
commit: its folder is written whole or not at all, and a batch id that is committed is never applied again. Totals are the sums of
the committed deltas. Compaction folds them into one folder of totals that names its batches: the totals are written first, the names
last, and only then are the folded folders removed, so a compaction that fails anywhere changes no total, and a folded batch still counts
as committed. One writer at a time is assumed, as for the batches.

Defined cases: null texts count 0 tokens; null source or language is a group of its own; rows that repeat are events each; an event
whose operation is unknown is an error of the batch; an empty batch commits without rows; groups whose documents are all deleted
stay, with zeros, unless asked otherwise; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import rank_tables, vocabulary
from .common import remove, stored, table, workspace

KEYS = ("source", "lang", "tokenizer")
DELTA = "source string, lang string, tokenizer string, docs long, tokens long"
OPERATIONS = ("insert", "delete", "revise")


class Rollup:
    """Totals by KEYS in a shared folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _exists(self, name: str) -> bool:
        where = self._path(name)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where)

    def _names(self, folder: str) -> list[str]:
        where = self._path(folder)
        fs = where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return sorted(x.getPath().getName() for x in fs.listStatus(where)) if fs.exists(where) else []

    def _compacted(self) -> tuple[str | None, set[str]]:
        """The newest whole compaction and the batches folded into it."""
        for number in reversed(self._names("compacted")):
            if self._exists(f"compacted/{number}/names/_SUCCESS"):
                rows = self.spark.read.schema("batch string").parquet(f"{self.folder}/compacted/{number}/names").collect()
                return number, {r["batch"] for r in rows}
        return None, set()

    def committed(self, batch: str) -> bool:
        """Whether the batch's folder has the writer's mark of success, or a compaction names it."""
        return self._exists(f"deltas/batch={batch}/_SUCCESS") or batch in self._compacted()[1]

    def apply(self, batch: str, events: DataFrame) -> bool:
        """Commit a batch once; False where it already is. A batch that failed midway is written anew."""
        if self.committed(batch):
            return False
        _marked(deltas(events)).parquet(f"{self.folder}/deltas/batch={batch}")
        return True

    def _open(self, folded: set[str]) -> list[str]:
        """Committed batches that aren't folded."""
        names = (x.removeprefix("batch=") for x in self._names("deltas"))
        return [b for b in names if b not in folded and self._exists(f"deltas/batch={b}/_SUCCESS")]

    def batches(self) -> list[str]:
        folded = self._compacted()[1]
        return sorted([*folded, *self._open(folded)])

    def totals(self, keep_empty: bool = True) -> DataFrame:
        """docs and tokens of every group, over all committed batches."""
        number, folded = self._compacted()
        paths = [f"{self.folder}/deltas/batch={b}" for b in self._open(folded)] + ([f"{self.folder}/compacted/{number}/totals"] if number else [])
        rows = self.spark.read.schema(DELTA).parquet(*paths) if paths else self.spark.createDataFrame([], DELTA)
        out = rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return out if keep_empty else out.where("docs != 0 or tokens != 0")

    def compact(self) -> bool:
        """Fold all committed batches into one folder; False where there is nothing to fold."""
        number, folded = self._compacted()
        new = self._open(folded)
        if new:
            told = f"compacted/{int(number or 0) + 1:08d}"
            _marked(self.totals()).parquet(f"{self.folder}/{told}/totals")
            _marked(self.spark.createDataFrame([(b,) for b in sorted([*folded, *new])], "batch string").coalesce(1)).parquet(f"{self.folder}/{told}/names")
            number, folded = self._compacted()
        for name in self._names("deltas"):
            if name.removeprefix("batch=") in folded:
                remove(self.spark, f"{self.folder}/deltas/{name}")
        for other in self._names("compacted"):
            if number and other < number:
                remove(self.spark, f"{self.folder}/compacted/{other}")
        return bool(new)


def _marked(df: DataFrame):
    """A writer that leaves a mark of success, whatever the session says."""
    return df.write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true")


def deltas(events: DataFrame) -> DataFrame:
    """One signed row per group of a batch.

    events: op, source, lang, tokenizer, tokens, and for revisions old_source, old_lang, old_tokenizer, old_tokens.
    """
    known = F.when(F.col("op").isin(*OPERATIONS), F.col("op")).otherwise(F.raise_error(F.concat(F.lit("unknown operation: "), F.coalesce("op", F.lit("null")))))
    sign = F.when(known == "delete", -1).otherwise(1)
    now = F.struct(*(F.col(k).alias(k) for k in KEYS), sign.cast("long").alias("docs"), (sign * F.coalesce("tokens", F.lit(0))).cast("long").alias("tokens"))
    old = F.struct(*(F.col(f"old_{k}").alias(k) for k in KEYS), F.lit(-1).cast("long").alias("docs"), (-F.coalesce("old_tokens", F.lit(0))).cast("long").alias("tokens"))
    parts = F.when(F.col("op") == "revise", F.array(now, old)).otherwise(F.array(now))
    return events.select(F.explode(parts).alias("x")).select("x.*").groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))


def counted(docs: DataFrame, vocab: str, columns: tuple[str, ...] = ("doc_id", "source", "lang")) -> DataFrame:
    """columns of docs, words (white-space tokens) and pieces (ids of the vocabulary) of every whole text."""
    kept = docs.sparkSession.sparkContext.broadcast(vocab)
    own = docs.select(*columns, F.col("text").cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = rank_tables(kept.value)
        for batch in batches:
            texts = [x.as_py() or "" for x in batch.column("_text")]
            words, pieces = pa.array([len(x.split()) for x in texts], pa.int64()), pa.array([len(x) // 4 for x in ranks.encode_texts(texts)], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), words, pieces], names=[*columns, "words", "pieces"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in own.schema.fields if f.name in columns)
    return own.mapInArrow(run, f"{kinds}, words long, pieces long")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents through three batches: inserted with word counts, revised to the vocabulary's counts (and delivered twice), and
    those without a token deleted. The totals are those of the vocabulary."""
    folder = workspace(spark, "tokens")
    rows = stored(counted(table(spark, sf_dir, "documents"), vocabulary()), f"{folder}/counted")
    null = {f"old_{k}": F.lit(None).cast("string") for k in KEYS} | {"old_tokens": F.lit(None).cast("long")}
    tokenizers = {"words": "whitespace-1", "pieces": "byte_bpe_50k-1"}
    event = lambda op, by: rows.select(F.lit(op).alias("op"), "source", "lang", F.lit(tokenizers[by]).alias("tokenizer"), F.col(by).alias("tokens"), "words", "pieces")
    old = {"old_source": F.col("source"), "old_lang": F.col("lang"), "old_tokenizer": F.lit(tokenizers["words"]), "old_tokens": F.col("words")}
    rollup = Rollup(spark, folder)
    rollup.apply("0001", event("insert", "words").withColumns(null))
    for _ in range(2):
        rollup.apply("0002", event("revise", "pieces").withColumns(old))
    rollup.apply("0003", event("delete", "pieces").where("pieces = 0").withColumns(null))
    rollup.compact()
    return rollup.totals(keep_empty=False)
