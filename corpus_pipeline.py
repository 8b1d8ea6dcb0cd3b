"""The corpus pipeline: documents without toxic ones, one of each group of near copies, without repeated passages and
secrets, packed into sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next one's docs. All but
the last return the columns of documents, whatever their names; n_chars follows the text where a stage changes it.

Defined cases, for every stage: an empty table gives an empty one of the same columns. Null and empty texts are kept as they are by the
filters, link with nothing, hold no passage and no secret, and are packed as the one id 0. A null doc_id is kept, ranks first, and is no
copy of another. Rows that repeat a doc_id stay or go together; whole repeated rows are kept, as ids tell documents apart. Without
labels of both kinds no document is toxic. Texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm import ngram_join, packing, secret_scan, substring_dedup, toxicity
from lodestrata.llm.bpe import vocabulary
from lodestrata.llm.common import remove, small, stored, table, tracked, workspace


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars of the text as it is now, where the table has that column."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the field scores under the threshold; it learns from the labelled rows of docs outside the held-out fold."""
    return toxicity.filtered(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least doc_id of each component of near copies, and all others."""
    groups = ngram_join.jaccard_components(docs, workspace(spark, "pipeline-ngrams"))
    later = groups.where("doc_id != component_id").select(F.col("doc_id").alias("gone")).distinct()
    later = stored(later, workspace(spark, "pipeline-near"))
    inner = docs.toDF(*(f"_{i}" for i in range(len(docs.columns))))
    kept = inner.join(small(later, later.count()), F.col(f"_{docs.columns.index('doc_id')}").cast("long") == F.col("gone"), "left_anti")
    return kept.select(*(F.col(f"_{i}").alias(c) for i, c in enumerate(docs.columns)))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier one holds."""
    return _counted(substring_dedup.replaced(docs, workspace(spark, "pipeline-repeats")))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets replaced."""
    return _counted(secret_scan.redacted(docs, workspace(spark, "pipeline-secrets")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in sequences."""
    return packing.pack_documents(docs, vocabulary(), workspace(spark, "pipeline-packing"))


STAGES = [("toxicity", drop_toxic), ("ngram_jaccard_join", drop_near_copies), ("substring_dedup", cut_repeats), ("secret_scan", redact_secrets), ("best_fit_packing", pack)]
#: SQL can't express the field's scores, so the pipeline is tested stage by stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the table of documents; what a stage wrote for itself is removed once its result is stored."""
    docs, folder = table(spark, sf_dir, "documents"), workspace(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        with tracked() as made:
            docs = stored(stage(spark, docs, sf_dir), f"{folder}/{k}-{name}")
        for path in made:
            remove(spark, path)
    return docs
