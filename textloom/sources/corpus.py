"""Corpus loaders and the vector store as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import text as X


def prepared(posts: DataFrame, text: str = "text", category: str = "category", label: str = "label_id", position: str | None = None) -> DataFrame:
    """(id, raw_idx, category, label_id, text): raw posts cleaned, those with too few tokens left out."""
    where = F.col(position).cast("int") if position else F.lit(None).cast("int")
    made = posts.where(F.col(text).isNotNull()).select(
        X.content_id(F.col(text)).alias("id"), where.alias("raw_idx"), F.col(category).alias("category"), F.coalesce(F.col(label), F.lit(-1)).cast("int").alias("label_id"),
        X.clean_post(F.col(text)).alias("text"),
    )
    return made.where(X.is_meaningful(F.col("text")))


def read_directory(spark: SparkSession, root: str) -> DataFrame:
    """Posts from ``<root>/<category>/<file>``: undecodable bytes replaced, unreadable files skipped, no labels."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true").load(root)
    parts = F.split("path", "/")
    files = files.select("path", F.element_at(parts, -2).alias("category"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
    return prepared(files.withColumn("label_id", F.lit(-1)))


def write_store(docs: DataFrame, vecs: DataFrame, path: str, position: str = "raw_idx") -> None:
    """Replace the vector store: one row per id (the first by position), with empty cluster metadata."""
    one = docs.withColumn("_r", F.expr(f"row_number() over (partition by id order by {position} nulls last, category)")).where("_r = 1").drop("_r")
    rows = one.join(vecs, "id").select("id", "vec", "text", "category", "label_id", F.lit("").alias("cluster_ids"), F.lit("").alias("cluster_probs"), F.lit(-1).alias("dominant_cluster"))
    rows.write.mode("overwrite").parquet(path)


def write_back(store: DataFrame, metadata: DataFrame, path: str) -> None:
    """A store with the cluster metadata of (id, cluster_ids, cluster_probs, dominant_cluster) merged in, laid out by cluster."""
    new = metadata.select("id", *[F.col(c).alias(f"_{c}") for c in ("cluster_ids", "cluster_probs", "dominant_cluster")])
    merged = store.join(new, "id", "left")
    for c in ("cluster_ids", "cluster_probs", "dominant_cluster"):
        merged = merged.withColumn(c, F.coalesce(f"_{c}", c)).drop(f"_{c}")
    merged.write.mode("overwrite").partitionBy("dominant_cluster").parquet(path)


def open_store(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
