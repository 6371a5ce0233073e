"""Reference-free evaluation by named deterministic surrogates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.operators.encode import TOKEN_SPLIT

MOST_QUERIES = 10


def token_set(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), TOKEN_SPLIT), lambda t: t != ""))


def scores(items: DataFrame) -> DataFrame:
    """(item_id, support, relevancy, context_precision), null where undefined.

    support: share of the answer's distinct tokens found in the contexts; relevancy: Jaccard of question and
    answer tokens; context_precision: mean precision at the ranks of contexts that share at least a
    quarter of the question's tokens.
    """
    q, a = token_set(F.col("question")), token_set(F.col("answer"))
    c = F.transform(F.coalesce("contexts", F.expr("cast(array() as array<string>)")), token_set)
    union = F.array_distinct(F.flatten(c))
    support = F.when(F.size(a) > 0, F.size(F.array_intersect(a, union)) / F.size(a))
    either = F.size(F.array_union(q, a))
    relevancy = F.when(either > 0, F.size(F.array_intersect(q, a)) / either)
    hits = F.transform(c, lambda x: F.when(F.size(F.array_intersect(q, x)) * 4 >= F.size(q), 1).otherwise(0))
    seen = F.transform(hits, lambda h, i: F.when(h == 1, F.aggregate(F.slice(hits, F.lit(1), i + 1), F.lit(0), lambda s, x: s + x) / (i + 1)))
    good = F.filter(seen, lambda x: x.isNotNull())
    precision = F.when(F.size(good) > 0, F.aggregate(good, F.lit(0.0), lambda s, x: s + x) / F.size(good)).when(F.size(c) > 0, F.lit(0.0))
    return items.select("item_id", F.round(support, 4).alias("support"), F.round(relevancy, 4).alias("relevancy"), F.round(precision, 4).alias("context_precision"))


def aggregate(scored: DataFrame) -> DataFrame:
    """Mean of each metric over the rows that have it; NaN counts as missing."""
    names = ["support", "relevancy", "context_precision"]
    return scored.agg(*[F.round(F.avg(F.nanvl(F.col(n).cast("double"), F.lit(None).cast("double"))), 4).alias(n) for n in names], F.count("*").alias("n"))


def checked(queries: DataFrame, most: int = MOST_QUERIES) -> DataFrame:
    """Non-blank queries; none, or more than ``most``, is an error."""
    kept = queries.where(F.trim("query") != "")
    n = kept.limit(most + 1).count()
    if not 1 <= n <= most:
        raise ValueError(f"an evaluation takes 1 to {most} queries")
    return kept
