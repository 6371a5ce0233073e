"""What a user calls: search behind a cache, question answering, evaluation, health."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import vectors as V
from textloom.functions.vectors import retrieval_score
from textloom.operators import cache as C
from textloom.operators import evaluate as E
from textloom.operators.encode import HashEncoder
from textloom.operators.fuzzy import FuzzyModel, assign
from textloom.operators.rag import RagPipeline
from textloom.operators.similarity import _matrix, knn
from textloom.plans.storage import stored

RESULTS = 5


class SemanticSearch:
    """Answers query tables from the corpus, remembering earlier queries until :meth:`flush`.

    corpus: (id, vec, text, category, dominant_cluster). Without a model the cache is one flat bucket.
    """

    def __init__(self, corpus: DataFrame, encoder: HashEncoder | None = None, model: FuzzyModel | None = None, theta: float = C.THETA):
        self.corpus, self.encoder, self.model, self.theta = corpus, encoder or HashEncoder(), model, theta
        self.flush()

    def flush(self) -> None:
        self.cache: DataFrame | None = None  # (entry_id, query, vec, u, cluster, results)
        self.log: DataFrame | None = None
        self.entries = 0

    def search(self, vecs: DataFrame, n: int = RESULTS) -> DataFrame:
        """(query_id, rank, id, similarity, text, category, cluster): absent metadata has defaults."""
        near = knn(self.corpus.select("id", "vec"), vecs, n, self.encoder.dim, other_only=False)
        rows = near.join(self.corpus.drop("vec"), "id")
        return rows.select(
            "query_id", "rank", "id", F.round(retrieval_score(F.col("cosine")), 4).alias("similarity"), "text",
            F.coalesce("category", F.lit("unknown")).alias("category"), F.coalesce("dominant_cluster", F.lit(-1)).alias("cluster"),
        )

    def _with_memberships(self, vecs: DataFrame) -> DataFrame:
        if self.model is None:
            return vecs.select("id", "vec", F.array(F.lit(1.0)).alias("u"))
        return vecs.join(assign(vecs, self.model, self.encoder.dim), "id").select("id", "vec", "u")

    def query(self, queries: DataFrame) -> DataFrame:
        """(query_id, query, hit, matched_query, similarity, cluster, results) for (query_id, query), in order of query_id.

        Blank queries are refused, as are ids that repeat within one table; later tables may use them again. Entries have
        ids of their own. Stored entries are searched in place; only the new queries pass through the ordered step. A hit
        returns what is stored with the entry, its query and its cluster; a miss its own cluster, -1 without a model.
        """
        asked = stored(queries.select(F.col("query_id").cast("bigint").alias("query_id"), F.trim("query").alias("query")))
        if not asked.where("query is null or query = '' or query_id is null").isEmpty():
            raise ValueError("a query must not be blank")
        n = asked.count()
        if asked.select("query_id").distinct().count() < n:
            raise ValueError("a query_id must not repeat")
        numbered = asked.withColumn("entry_id", F.expr("row_number() over (order by query_id)").cast("bigint") + F.lit(self.entries - 1))
        numbered = stored(numbered)
        spark, dim, model, theta = self.corpus.sparkSession, self.encoder.dim, self.model, self.theta
        vecs = stored(self._with_memberships(self.encoder.encode(numbered, "entry_id", "query")))
        known = vecs.select("id", "vec", F.lit(None).cast("bigint").alias("key"), F.lit(None).cast("double").alias("sim"), F.lit(False).alias("routed"))
        if self.cache is not None:
            near = C.routed_nearest(vecs, self.cache.select(F.col("entry_id").alias("id"), "vec", "u"), dim, other_only=False)
            near = near.select(F.col("query_id").alias("id"), F.col("id").alias("key"), F.col("cosine").alias("sim"), "routed")
            known = vecs.select("id", "vec").join(near, "id", "left").select("id", "vec", "key", "sim", F.coalesce("routed", F.lit(False)).alias("routed"))
        shared = spark.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = C.Held(dim)
            for batch in batches:
                keys = batch.column(0).to_numpy()
                unit, routes = C.placed(_matrix(batch.column(1), dim), shared.value)
                key = batch.column(2).fill_null(-1).to_numpy()
                sim, routed = batch.column(3).fill_null(float("-inf")).to_numpy(), batch.column(4).to_numpy(zero_copy_only=False)
                matched, sims = C.decide(held, keys, unit, routes, theta, (np.where(routed, key, -1), sim), (key, sim))
                hit = matched >= 0
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(matched, mask=~hit), pa.array(np.round(sims, 4), mask=~hit)], ["id", "matched", "similarity"])

        told = stored(known.repartition(1).sortWithinPartitions("id").mapInArrow(run, "id bigint, matched bigint, similarity double"))
        decided = numbered.join(told.withColumnRenamed("id", "entry_id"), "entry_id", "left")  # a query without words hits nothing
        missed = decided.where("matched is null").select("entry_id", "query")
        fresh = self.search(vecs.join(missed.select(F.col("entry_id").alias("id")), "id", "left_semi").select("id", "vec"))
        fresh = fresh.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "similarity", "text", "category", "cluster"))).alias("results"))
        cluster = F.lit(-1) if model is None else V.argmax(F.col("u"))
        added = missed.join(vecs.select(F.col("id").alias("entry_id"), "vec", "u"), "entry_id").join(fresh.withColumnRenamed("query_id", "entry_id"), "entry_id", "left")
        added = stored(added.select("entry_id", "query", "vec", "u", cluster.cast("int").alias("cluster"), "results"))
        self.cache = added if self.cache is None else self.cache.unionByName(added)
        new_log = stored(decided.select("query_id", F.col("matched").isNotNull().alias("hit")))
        self.log = new_log if self.log is None else self.log.unionByName(new_log)
        self.entries += n
        answered = decided.select("query_id", "query", F.col("matched").isNotNull().alias("hit"), "similarity", F.coalesce("matched", "entry_id").alias("entry_id"))
        held = self.cache.select("entry_id", F.col("query").alias("matched_query"), "cluster", "results")
        return answered.join(held, "entry_id", "left").select(
            "query_id", "query", "hit", F.when(F.col("hit"), F.col("matched_query")).alias("matched_query"), "similarity", F.coalesce("cluster", F.lit(-1)).alias("cluster"), "results"
        )

    def stats(self) -> DataFrame:
        """(requests, hits, misses, hit_rate, total_entries, threshold) since the last flush."""
        spark = self.corpus.sparkSession
        log = spark.createDataFrame([], "query_id bigint, hit boolean") if self.log is None else self.log
        n = 0 if self.cache is None else self.cache.count()
        return C.stats(log, hit="hit").withColumns({"total_entries": F.lit(n), "threshold": F.lit(self.theta)})


def evaluate(pipeline: RagPipeline, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Scores of each of 1 to 10 questions run through the pipeline, against the snippets of their sources, and their means."""
    runs = pipeline.run(E.checked(queries))
    items = runs.select(F.col("query_id").alias("item_id"), F.col("query").alias("question"), "answer", F.transform("sources", lambda x: x.snippet).alias("contexts"))
    scored = stored(E.scores(items))
    return scored, E.aggregate(scored)


def health(spark: SparkSession, search: SemanticSearch | None = None, pipeline: RagPipeline | None = None) -> DataFrame:
    """One row: what is loaded, and the number of cached entries."""
    n = 0 if search is None or search.cache is None else search.cache.count()
    return spark.createDataFrame([("ok", search is not None, search is not None and search.model is not None, pipeline is not None, n)], "status string, search boolean, model boolean, pipeline boolean, entries bigint")
