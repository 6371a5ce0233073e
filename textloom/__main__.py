"""Entry points: ``python -m textloom prepare|cluster|evaluate`` (or through spark-submit)."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from textloom.operators import fuzzy as Z
from textloom.operators.encode import HashEncoder
from textloom.operators.rag import RagPipeline
from textloom.operators.similarity import near_duplicates_removed
from textloom.plans.api import evaluate
from textloom.plans.storage import stored
from textloom.sources import corpus as S

SAME = 0.98


def prepare(spark: SparkSession, data_dir: str, store: str, skip_dedup: bool = False, dim: int = 384) -> None:
    """Posts of a directory, cleaned, encoded and without near-duplicates, as a vector store."""
    docs = stored(S.read_directory(spark, data_dir))
    numbered = docs.select("id", F.xxhash64("id").alias("n"), "text").dropDuplicates(["n"])
    vecs = stored(HashEncoder(dim).encode(numbered, "n", "text").withColumnRenamed("id", "n"))
    if not skip_dedup:
        kept = near_duplicates_removed(vecs.select(F.col("n").alias("id"), "vec"), SAME, dim)
        vecs = vecs.join(kept.withColumnRenamed("id", "n"), "n", "left_semi")
    S.write_store(docs, vecs.join(numbered.select("id", "n"), "n").select("id", "vec"), store)


def cluster(spark: SparkSession, store: str, out: str, k: int = 15, m: float = 2.0, pca_dim: int = 50, sweep_k: bool = False, sweep_m: bool = False) -> None:
    """Model, memberships, sweeps, analysis and a store with cluster metadata, each a table below ``out``."""
    rows = S.open_store(spark, store).withColumn("n", F.xxhash64("id"))
    dim = len(rows.select("vec").first().vec)
    vecs = stored(rows.select(F.col("n").alias("id"), "vec"))
    flat, components, mean = Z.projected(vecs, dim, min(pca_dim, dim))
    flat = stored(flat)
    if sweep_k:
        spark.createDataFrame(Z.sweep_k(flat, list(range(8, 26)), m), "k int, fpc double, silhouette double, n_iter int").write.mode("overwrite").parquet(f"{out}/sweep_k")
    if sweep_m:
        spark.createDataFrame(Z.sweep_m(flat, [1.2, 1.5, 2.0, 2.5, 3.0], k), "m double, fpc double, entropy_mean double, entropy_std double, n_iter int").write.mode("overwrite").parquet(f"{out}/sweep_m")
    fitted = Z.fit(flat, k, m)
    model = Z.FuzzyModel(fitted.model.centers, m, components, mean)
    model.save(spark, f"{out}/model")
    assigned = stored(Z.assign(vecs, model, dim))
    assigned.write.mode("overwrite").parquet(f"{out}/memberships")
    texts = rows.select(F.col("n").alias("id"), F.substring("text", 1, 150).alias("text"), "category")
    for name, found in (("core", Z.core_members(assigned)), ("boundary", Z.boundary_members(assigned)), ("uncertain", Z.most_uncertain(assigned))):
        Z.listed(found, assigned).join(texts, "id").write.mode("overwrite").parquet(f"{out}/{name}")
    Z.cluster_sizes(assigned, k).write.mode("overwrite").parquet(f"{out}/sizes")
    mixed = Z.hard(assigned).join(texts, "id")
    Z.category_mix(mixed, "cluster", "category", "id").write.mode("overwrite").parquet(f"{out}/categories")
    found = Z.metadata(assigned).join(rows.select(F.col("n").alias("id"), F.col("id").alias("doc")), "id").drop("id").withColumnRenamed("doc", "id")
    S.write_back(rows.drop("n"), found, f"{out}/store")


def ask(spark: SparkSession, docs: str, queries: list[str]) -> None:
    table = spark.read.parquet(docs)
    asked = spark.createDataFrame(list(enumerate(queries)), "query_id bigint, query string")
    for df in evaluate(RagPipeline(table), asked):
        df.show(truncate=False)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="textloom", description=__doc__)
    sub = parser.add_subparsers(dest="what", required=True)
    p = sub.add_parser("prepare", help=prepare.__doc__)
    p.add_argument("--data-dir", required=True)
    p.add_argument("--store", required=True)
    p.add_argument("--skip-dedup", action="store_true")
    p.add_argument("--dim", type=int, default=384)
    p = sub.add_parser("cluster", help=cluster.__doc__)
    p.add_argument("--store", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--k", type=int, default=15)
    p.add_argument("--m", type=float, default=2.0)
    p.add_argument("--pca-dim", type=int, default=50)
    p.add_argument("--sweep-k", action="store_true")
    p.add_argument("--sweep-m", action="store_true")
    p = sub.add_parser("evaluate", help="Scores of 1 to 10 questions answered from a table of documents.")
    p.add_argument("--docs", required=True)
    p.add_argument("--queries", nargs="+", required=True)
    args = vars(parser.parse_args(argv))
    spark = SparkSession.builder.appName("textloom").getOrCreate()
    what = args.pop("what")
    {"prepare": prepare, "cluster": cluster, "evaluate": ask}[what](spark, **args)


if __name__ == "__main__":
    main()
