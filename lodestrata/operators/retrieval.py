"""Retrieval over a table's corpora: a deterministic embedder, an index that is built once and then loaded, and k-NN hits."""

from __future__ import annotations

import hashlib

from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import profile, vector

WIDTH, GRAM, K, CELL_LIMIT = 256, 3, 5, 10_000
DOCUMENTS = ("schema", "cell", "row", "column")


def embedded(df: DataFrame, text_col: str, out_col: str = "v", width: int = WIDTH) -> DataFrame:
    """df with a unit vector of hashed character n-grams; any other embedder only has to give such a column."""
    text = F.concat(F.lit("^"), F.lower(F.coalesce(text_col, F.lit(""))), F.lit("$"))
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - GRAM + 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(GRAM)))
    counts = HashingTF(inputCol="_grams", outputCol="_tf", numFeatures=width).transform(df.withColumn("_grams", grams))
    return Normalizer(inputCol="_tf", outputCol="_unit").transform(counts).withColumn(out_col, vector_to_array("_unit")).drop("_grams", "_tf", "_unit")


def corpus(kind: str, df: DataFrame, order: str, limit: int = CELL_LIMIT) -> DataFrame:
    """id and page_content of the documents of a kind; an unknown kind has none."""
    if kind == "schema":
        stats = profile.column_profile(df)
        out = stats.select(F.col("col").alias("page_content"), F.to_json(F.struct("*")).alias("result_text"))
    elif kind == "cell":
        out = profile.cell_corpus(df.drop(order), limit=limit).select("page_content", F.col("page_content").alias("result_text"))
    elif kind == "row":
        out = profile.row_corpus(df, order).select("page_content", F.col("row_id").cast("string").alias("result_text"))
    elif kind == "column":
        out = profile.column_corpus(df, order).select("page_content", F.col("col_name").alias("result_text"))
    else:
        return df.sparkSession.createDataFrame([], "id long, page_content string, result_text string")
    return out.withColumn("id", F.xxhash64("page_content", "result_text")).dropDuplicates(["id"]).select("id", "page_content", "result_text")


def safe_id(table_id: str) -> str:
    """Letters and digits of any script, underscores and hyphens: `normalize.safe_id` for one text."""
    return "".join(c for c in table_id if c.isalnum() or c in "_-")


def version(df: DataFrame) -> str:
    """A digest of a table's schema and rows, whatever their order: one pass."""
    row = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("s")).first()
    return hashlib.md5(f"{df.schema.json()}|{row['n']}|{row['s']}".encode()).hexdigest()[:16]


def index(spark: SparkSession, folder: str, table_id: str, kind: str, df: DataFrame, order: str, version: str = "") -> DataFrame:
    """The embedded corpus, read from the folder if it is whole there, else built and saved. Another version is another index."""
    path = "_".join(filter(None, (f"{folder}/{safe_id(table_id)}_{kind}", version)))
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark):
        embedded(corpus(kind, df, order), "page_content").write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def build_database(spark: SparkSession, folder: str, table_id: str, df: DataFrame, order: str | None = None, structured: tuple[str, ...] = ("structured_info", "relations")) -> dict[str, DataFrame]:
    """The schema and cell indexes of a table without its structured columns, keyed by its content: built where it is new, else loaded."""
    plain = df.drop(*structured)
    order, own = order or plain.columns[0], version(plain)
    return {kind: index(spark, folder, table_id, kind, plain, order, own) for kind in ("schema", "cell")}


def hits(index_table: DataFrame, questions: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, page_content and result_text of the k nearest documents (by squared distance) of questions (id, text)."""
    asked = embedded(questions, "text").select("id", "v")
    found = vector.nearest(asked, index_table.select("id", "v"), k, "l2")
    return found.join(index_table.select("id", "page_content", "result_text"), "id").select("query_id", "rank", "page_content", "result_text")
