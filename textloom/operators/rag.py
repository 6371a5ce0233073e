"""Bounded rewrite, retrieve, grade and generate over query tables, with pluggable models."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.text import prefix
from textloom.functions.vectors import retrieval_score
from textloom.operators.encode import HashEncoder
from textloom.operators.similarity import knn
from textloom.plans.storage import stored

# fixed values: bounds of the pipeline
TOP_K, LEAST_SCORE, MOST_RELEVANT, MOST_SCANNED, MOST_ATTEMPTS = 8, 0.3, 5, 10, 2
GRADE_CHARS, SNIPPET_CHARS = 600, 200
NO_DOCUMENTS = "No indexed document answers this question."
NO_ANSWER = "The model returned no text."


# how the three models are asked
REWRITE = "Turn the question below into a better search query for a collection of discussion posts. Name the topic in plain words, without operators. Reply with the query only."
GRADE = "Decide whether a post helps to answer a question. Reply with YES or NO and nothing else."
GENERATE = "Answer the question from the numbered posts given. Use nothing else, and name the category of the posts you rely on."
ASK_REWRITE, ASK_GRADE, ASK_GENERATE = "Question: {query}", "Question: {query}\nPost:\n{document}", "Posts:\n{context}\nQuestion: {query}"


class ChatModel(Protocol):
    def chat(self, system: str, user: str, max_tokens: int) -> str | Reply: ...


@dataclass(frozen=True)
class Reply:
    """A model's text with the tokens it read and wrote."""

    text: str
    input_tokens: int
    output_tokens: int


class OfflineModel:
    """Deterministic stand-in: rewrites to the longer words, grades by shared words, answers with the first words of its context."""

    def chat(self, system: str, user: str, max_tokens: int) -> Reply:
        if system == REWRITE:
            query = user.removeprefix("Question: ")
            text = " ".join([w for w in query.split() if len(w) > 3][:max_tokens]) or query
        elif system == GRADE:
            query, _, document = user.removeprefix("Question: ").partition("\nPost:\n")
            asked = {w for w in query.lower().split() if len(w) > 3}
            text = "YES" if asked & set(document.lower().split()) else "NO"
        else:
            text = " ".join(user.removeprefix("Posts:\n").split()[: min(64, max_tokens)])
        return Reply(text, len(system.split()) + len(user.split()), len(text.split()))


@dataclass(frozen=True)
class RagConfig:
    """Limits of the pipeline; ``model_factory`` makes a client on each worker from this configuration."""

    model_factory: Callable[[RagConfig], ChatModel] = field(default=lambda config: OfflineModel())
    model: str = field(default_factory=lambda: os.environ.get("RAG_LLM_MODEL", "offline"))
    api_key: str = field(default_factory=lambda: os.environ.get("RAG_API_KEY", ""), repr=False)
    max_tokens: int = field(default_factory=lambda: int(os.environ.get("RAG_MAX_TOKENS", "4096")))
    rewrite_tokens: int = 128
    grade_tokens: int = 4
    top_k: int = TOP_K
    least_score: float = LEAST_SCORE
    most_relevant: int = MOST_RELEVANT
    most_scanned: int = MOST_SCANNED


def passes(reply, failed) -> F.Column:
    """A grade passes if the trimmed reply starts with YES, or if grading failed."""
    return F.coalesce(failed, F.lit(False)) | F.coalesce(F.upper(F.trim(reply)).startswith("YES"), F.lit(False))


def relevant(sources: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """Sources whose score reaches ``least``; a missing score counts as 0."""
    return sources.where(F.coalesce("score", F.lit(0.0)) >= least)


def first_passing(sources: DataFrame, key: str, rank: str, n: int = MOST_RELEVANT, scanned: int = MOST_SCANNED) -> DataFrame:
    """The first ``n`` sources of each run in order of rank among those that reach the score; ``scanned`` of these are looked at."""
    ranked = relevant(sources).withColumn("source_index", F.expr(f"row_number() over (partition by {key} order by {rank}, source_id)"))
    return ranked.where(F.col("source_index") <= min(n, scanned))


def source_view(sources: DataFrame) -> DataFrame:
    """What a caller sees of a source; absent category and cluster have defaults."""
    return sources.select(
        "run_id", "source_index", F.coalesce("category", F.lit("unknown")).alias("category"), F.round("score", 4).alias("score"),
        F.coalesce("cluster_id", F.lit(-1)).alias("cluster"), prefix(F.col("snippet"), SNIPPET_CHARS).alias("snippet"),
    )


def context(sources: DataFrame, key: str = "run_id") -> DataFrame:
    """One block of text per run: its sources in order, each under a headline, between rules."""
    block = F.concat(F.format_string("[%d] Category: %s | Score: %.3f", "source_index", "category", F.round("score", 3)), F.lit("\n"), F.coalesce("snippet", F.lit("")))
    ordered = F.sort_array(F.collect_list(F.struct("source_index", block.alias("b"))))
    return sources.groupBy(key).agg(F.array_join(F.transform(ordered, lambda x: x.b), "\n---\n").alias("context"))


def route(attempts, has_relevant) -> F.Column:
    """Where a run goes after grading: generate with documents or after the last attempt, else retry."""
    return F.when(F.coalesce(has_relevant, F.lit(False)) | (F.coalesce(attempts, F.lit(0)) >= MOST_ATTEMPTS), "generate").otherwise("retry")


class RagPipeline:
    """Answers a table of queries from a table of documents in two unrolled rounds."""

    def __init__(self, docs: DataFrame, encoder: HashEncoder | None = None, config: RagConfig | None = None):
        self.encoder, self.config = encoder or HashEncoder(), config or RagConfig()
        cluster = F.col("dominant_cluster") if "dominant_cluster" in docs.columns else F.lit(None)
        self.docs = docs.select(F.col("doc_id").cast("bigint").alias("id"), "text", "category", cluster.cast("int").alias("cluster_id")).dropDuplicates(["id"])
        self.corpus = stored(self.encoder.encode(self.docs, "id", "text"))

    def _chat(self, df: DataFrame, system: str, user: str, max_tokens: int) -> DataFrame:
        """df with the model's (reply, failed, input_tokens, output_tokens) for the text in column ``user``."""
        config = self.config

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            model = config.model_factory(config)
            for f in frames:
                told = []
                for u in f[user]:
                    try:
                        reply = model.chat(system, u, max_tokens)
                        told.append((reply.text, False, reply.input_tokens, reply.output_tokens) if isinstance(reply, Reply) else (reply, False, 0, 0))
                    except Exception:  # a failed call must not end the job
                        told.append((None, True, 0, 0))
                text, failed, read, wrote = zip(*told) if told else ([], [], [], [])
                yield f.assign(reply=list(text), failed=list(failed), input_tokens=list(read), output_tokens=list(wrote))

        kinds = ", ".join(f"`{n}` {t}" for n, t in df.dtypes)
        return df.mapInPandas(run, f"{kinds}, reply string, failed boolean, input_tokens int, output_tokens int")

    def retrieve(self, queries: DataFrame) -> DataFrame:
        """(query_id, rank, id, score, text, category) for (query_id, query)."""
        vecs = self.encoder.encode(queries, "query_id", "query")
        near = knn(self.corpus, vecs, self.config.top_k, self.encoder.dim, other_only=False)
        return near.withColumn("score", F.round(retrieval_score(F.col("cosine")), 4)).join(self.docs, "id").select("query_id", "rank", "id", "score", "text", "category", "cluster_id")

    def grade(self, retrieved: DataFrame, queries: DataFrame) -> DataFrame:
        """The first passing documents of each query, by (query_id, source_index): filtered by score, then the first few graded."""
        asked = retrieved.where(F.col("score") >= self.config.least_score)
        asked = asked.withColumn("seen", F.expr("row_number() over (partition by query_id order by rank)")).where(F.col("seen") <= self.config.most_scanned).drop("seen")
        asked = asked.join(queries.select("query_id", "query"), "query_id")
        asked = asked.withColumn("user", _filled(ASK_GRADE, query=F.col("query"), document=F.coalesce(prefix(F.col("text"), GRADE_CHARS), F.lit(""))))
        graded = self._chat(asked, GRADE, "user", self.config.grade_tokens).where(passes(F.col("reply"), F.col("failed")))
        ranked = graded.withColumn("source_index", F.expr("row_number() over (partition by query_id order by rank)"))
        return ranked.where(F.col("source_index") <= self.config.most_relevant).drop("user", "reply", "failed", "query", "input_tokens", "output_tokens")

    def run(self, queries: DataFrame) -> DataFrame:
        """(query_id, query, rewritten_query, rewrite_attempts, answer, sources, n_sources, has_relevant_docs, context, input_tokens, output_tokens) for (query_id, query).

        Blank queries are left out. The second round rewrites the original query of those that the first left without
        documents. Token counts are those of the answer; without documents no model is asked and they are 0.
        """
        asked = stored(queries.select(F.col("query_id").cast("bigint").alias("query_id"), F.trim("query").alias("query")).where("query <> ''").dropDuplicates(["query_id"]))
        first = stored(self.grade(self.retrieve(asked), asked))
        open_ = asked.join(first.select("query_id").distinct(), "query_id", "left_anti").withColumn("user", _filled(ASK_REWRITE, query=F.col("query")))
        rewritten = self._chat(open_, REWRITE, "user", self.config.rewrite_tokens)
        rewritten = stored(rewritten.select("query_id", F.coalesce(F.nullif(F.trim("reply"), F.lit("")), "query").alias("query")))
        second = stored(self.grade(self.retrieve(rewritten), rewritten))
        found = first.unionByName(second).withColumn("category", F.coalesce("category", F.lit("unknown")))
        blocks = context(found.withColumn("snippet", F.trim("text")), "query_id")
        source = F.struct(F.col("source_index").cast("int").alias("index"), "category", "score", F.coalesce("cluster_id", F.lit(-1)).alias("cluster"), prefix(F.col("text"), SNIPPET_CHARS).alias("snippet"))
        lists = found.groupBy("query_id").agg(F.sort_array(F.collect_list(source)).alias("sources"))
        again = rewritten.select("query_id", F.col("query").alias("rewritten"))
        rows = asked.join(again, "query_id", "left").join(lists, "query_id", "left").join(blocks, "query_id", "left")
        rows = stored(rows.withColumn("user", _filled(ASK_GENERATE, context=F.coalesce("context", F.lit("")), query=F.col("query"))))
        told = self._chat(rows.where("sources is not null").select("query_id", "user"), GENERATE, "user", self.config.max_tokens)
        answer = F.when(F.trim(F.coalesce("reply", F.lit(""))) == "", NO_ANSWER).otherwise(F.col("reply"))
        said = told.select("query_id", answer.alias("answer"), "input_tokens", "output_tokens")
        n = F.coalesce(F.size("sources"), F.lit(0))
        return rows.join(said, "query_id", "left").select(
            "query_id", "query", F.coalesce("rewritten", "query").alias("rewritten_query"), F.when(F.col("rewritten").isNull(), 1).otherwise(2).alias("rewrite_attempts"),
            F.coalesce("answer", F.lit(NO_DOCUMENTS)).alias("answer"), "sources", F.greatest(n, F.lit(0)).alias("n_sources"), (n > 0).alias("has_relevant_docs"), "context",
            F.coalesce("input_tokens", F.lit(0)).alias("input_tokens"), F.coalesce("output_tokens", F.lit(0)).alias("output_tokens"),
        )


def _filled(template: str, **values: Column) -> Column:
    """The template with columns in its places."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[values[p] if i % 2 else F.lit(p) for i, p in enumerate(parts) if i % 2 or p])
