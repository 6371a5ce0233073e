"""Registered queries of the core operators and the SQL they are checked against.

Every query runs over its whole tables. Repeated rows count once unless a query says otherwise.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import text as X
from textloom.functions import vectors as V
from textloom.operators import cache as C
from textloom.operators import evaluate as E
from textloom.operators import fuzzy as Z
from textloom.operators import rag as R
from textloom.operators.encode import hash_terms
from textloom.operators.similarity import knn, near_pairs, near_duplicates_removed, vectors
from textloom.sources.corpus import prepared

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

EVERY = 50  # searches ask with the rows whose id it divides, against all rows
ENTRY_DIM, VECTOR_DIM = 128, 64
PCA_DIM, FIT_K, FIT_M = 16, 15, 1.2  # at m = 2 all memberships of these entries come out as 1 / K
THETAS = [0.70, 0.75, 0.80, 0.82, 0.85, 0.88, 0.90, 0.95]


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ------------------------------------------------------------------ cleaning

_B = r"[\s\x1c-\x1f\x85\xa0\p{Z}]"
_CLEAN = rf"""
l0 AS (SELECT post_id, text, string_split_regex(text, '\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{{85}}\x{{2028}}\x{{2029}}]') AS a FROM (SELECT DISTINCT post_id, text FROM raw_posts WHERE text IS NOT NULL)),
l1 AS (SELECT post_id, text, CASE WHEN a[len(a)] = '' THEN a[1:len(a)-1] ELSE a END AS l FROM l0),
l2 AS (SELECT *, list_filter(l, lambda x: regexp_matches(x, '(?i)^Subject:{_B}*.+'))[1] AS sl, list_position(list_transform(l, lambda x: regexp_matches(x, '^{_B}*$')), true) AS b FROM l1),
l3 AS (SELECT *, CASE WHEN b IS NULL OR b = 0 THEN [] ELSE l[b+1:] END AS r FROM l2),
l4 AS (SELECT *, list_position(list_transform(r, lambda x: regexp_matches(x, '^--{_B}*$|^-----BEGIN PGP')), true) AS s FROM l3),
l5 AS (SELECT *, list_filter(CASE WHEN s IS NULL OR s = 0 THEN r ELSE r[1:s-1] END, lambda x: NOT regexp_matches(x, '^{_B}*>')) AS k FROM l4),
l6 AS (SELECT post_id, text, regexp_replace(regexp_extract(coalesce(sl, ''), '(?i)^Subject:{_B}*(.+)', 1), '^{_B}+|{_B}+$', '', 'g') AS s0,
  regexp_replace(regexp_replace(array_to_string(k, ' '), '{_B}+', ' ', 'g'), '^ +| +$', '', 'g') AS body FROM l5),
l7 AS (SELECT post_id, text, regexp_replace(regexp_replace(s0, '(?i)^(Re|Fwd|Fw):{_B}*', ''), '^{_B}+|{_B}+$', '', 'g') AS subject,
  array_to_string(list_filter(string_split(body, ' '), lambda x: x <> '')[1:300], ' ') AS body FROM l6),
clean AS (SELECT post_id, text AS raw, subject, CASE WHEN subject <> '' THEN regexp_replace(subject || '. ' || body, '^{_B}+|{_B}+$', '', 'g') ELSE body END AS clean FROM l7),
counted AS (SELECT *, len(list_filter(regexp_split_to_array(clean, '{_B}+'), lambda x: x <> '')) AS n_tokens FROM clean)
"""


@query(f"WITH {_CLEAN} SELECT post_id, substring(md5(raw), 1, 12) AS id, subject, clean, CAST(n_tokens AS INTEGER) AS n_tokens, n_tokens >= 20 AS kept FROM counted")
def clean_posts(spark, sf_dir):
    posts = table(spark, sf_dir, "raw_posts").where("text is not null").select("post_id", "text").distinct()
    clean = X.clean_post(F.col("text"))
    return posts.select("post_id", X.content_id(F.col("text")).alias("id"), X.subject(F.col("text")).alias("subject"), clean.alias("clean")).select(
        "*", F.size(X.tokens(F.col("clean"))).alias("n_tokens"), X.is_meaningful(F.col("clean")).alias("kept")
    )


@query(
    f"""WITH {_CLEAN} SELECT category, count(*) AS retained FROM counted JOIN (SELECT DISTINCT post_id, text, category FROM raw_posts WHERE text IS NOT NULL) p
    ON counted.post_id = p.post_id AND counted.raw = p.text WHERE n_tokens >= 20 GROUP BY category"""
)
def retained_posts(spark, sf_dir):
    posts = table(spark, sf_dir, "raw_posts").where("text is not null").select("post_id", "text", "category", "label_id").distinct()
    return prepared(posts).groupBy("category").agg(F.count("*").alias("retained"))


@query("SELECT doc_id, id, substring(md5(text), 1, 12) AS content_id, count(*) OVER (PARTITION BY substring(md5(text), 1, 12)) AS copies FROM documents WHERE text IS NOT NULL")
def document_ids(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "id", X.content_id(F.col("text")).alias("content_id"))
    return docs.withColumn("copies", F.expr("count(*) over (partition by content_id)"))


@query(
    """WITH t AS (SELECT doc_id AS id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) AS t FROM documents),
    h AS (SELECT id, CAST(('0x' || substring(md5(t), 1, 8))::BIGINT % 64 AS INTEGER) AS bucket, CASE WHEN ('0x' || substring(md5(t), 9, 1))::BIGINT % 2 = 0 THEN 1 ELSE -1 END AS sign FROM t),
    s AS (SELECT id, bucket, CAST(sum(sign) AS DOUBLE) AS s FROM h GROUP BY id, bucket),
    n AS (SELECT id, sqrt(sum(s * s)) AS n FROM s GROUP BY id)
    SELECT id, bucket, round(CASE WHEN n > 0 THEN s / n ELSE 0.0 END, 5) AS value FROM s JOIN n USING (id)"""
)
def hash_embed(spark, sf_dir):
    return hash_terms(table(spark, sf_dir, "documents"), "doc_id", "text").select("id", "bucket", F.round("value", 5).alias("value"))


# ------------------------------------------------------------------ vectors

_USABLE = """v AS (SELECT DISTINCT ON (entry_id) entry_id AS id, embedding::DOUBLE[] AS e FROM cache_entries WHERE entry_id IS NOT NULL AND len(embedding) = 128
  AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
u AS (SELECT id, e, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS w FROM v)"""
_MODEL = "m AS (SELECT centers, m, components, mean_vec FROM fcm_model)"
_ASSIGNED = f"""{_USABLE}, {_MODEL},
z AS (SELECT id, m.m AS fm, m.centers AS cs, list_transform(m.components, lambda c: list_dot_product(list_transform(list_zip(e, m.mean_vec), lambda p: p[1] - p[2]), c)) AS z FROM v, m),
d AS (SELECT id, fm, list_transform(cs, lambda c: sqrt(list_sum(list_transform(list_zip(z, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))))) AS d FROM z),
q AS (SELECT id, list_transform(d, lambda x: power(x, -2.0 / (fm - 1.0))) AS q FROM d),
a AS (SELECT id, list_transform(q, lambda x: x / list_sum(q)) AS u FROM q),
g AS (SELECT id, u, unnest(u) AS x, generate_subscripts(u, 1) - 1 AS k FROM a)"""


def _entries(spark, sf_dir) -> DataFrame:
    return vectors(table(spark, sf_dir, "cache_entries"), "entry_id", "embedding", ENTRY_DIM)


def _assigned(spark, sf_dir) -> DataFrame:
    return Z.assign(_entries(spark, sf_dir), Z.FuzzyModel.load(table(spark, sf_dir, "fcm_model")), ENTRY_DIM)


def _rows(spark, sf_dir) -> DataFrame:
    return vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", VECTOR_DIM)


@query("SELECT vec_id AS id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 5) AS norm FROM embeddings")
def l2_norms(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.round(V.norm(F.col("embedding")), 5).alias("norm"))


def _knn_sql(source: str, k: int) -> str:
    return f"""WITH {source}, p AS (SELECT x.id AS query_id, y.id, round(list_dot_product(x.w, y.w), 6) AS cosine FROM u x JOIN u y ON x.id <> y.id WHERE x.id % {EVERY} = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, id) AS rank FROM p)
    SELECT query_id, CAST(rank AS INTEGER) AS rank, id, round((1 + cosine) / 2, 4) AS score FROM r WHERE rank <= {k}"""


_VEC = """v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings), u AS (SELECT id, e, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS w FROM v)"""


def _search(vecs: DataFrame, k: int, dim: int) -> DataFrame:
    near = knn(vecs, vecs.where(F.col("id") % EVERY == 0), k, dim)
    return near.select("query_id", F.col("rank").cast("int").alias("rank"), "id", F.round(V.retrieval_score(F.col("cosine")), 4).alias("score"))


@query(_knn_sql(_VEC, 8))
def knn_top8(spark, sf_dir):
    return _search(_rows(spark, sf_dir), 8, VECTOR_DIM)


@query(_knn_sql(_USABLE, 5))
def knn_top5_entries(spark, sf_dir):
    return _search(_entries(spark, sf_dir), 5, ENTRY_DIM)


@query(f"WITH {_USABLE} SELECT x.id AS a, y.id AS b, round(list_dot_product(x.w, y.w), 6) AS cosine FROM u x JOIN u y ON x.id < y.id AND round(list_dot_product(x.w, y.w), 6) >= 0.98")
def near_dup_pairs(spark, sf_dir):
    return near_pairs(_entries(spark, sf_dir), 0.98, ENTRY_DIM)


def _walk_sql(least: float, last: str) -> str:
    """First-come removal as a recursion over rounds."""
    return f"""WITH RECURSIVE {_USABLE}, p AS MATERIALIZED (SELECT x.id AS a, y.id AS b FROM u x JOIN u y ON x.id < y.id AND round(list_dot_product(x.w, y.w), 6) >= {least}),
    walk(step, kept, dropped) AS (
      SELECT 0, CAST([] AS BIGINT[]), CAST([] AS BIGINT[])
      UNION ALL
      SELECT step + 1, list_concat(kept, n), list_concat(dropped, coalesce((SELECT list(DISTINCT b) FROM p WHERE list_contains(n, a)), []))
      FROM (SELECT step, kept, dropped, (SELECT list(DISTINCT a) FROM p WHERE NOT list_contains(kept, a) AND NOT list_contains(dropped, a)
        AND NOT EXISTS (SELECT 1 FROM p q WHERE q.b = p.a AND NOT list_contains(dropped, q.a) AND NOT list_contains(kept, q.a))) AS n FROM walk) WHERE len(n) > 0),
    last AS (SELECT kept, dropped FROM walk ORDER BY step DESC LIMIT 1)
    {last}"""


@query(_walk_sql(0.98, "SELECT id FROM u, last WHERE NOT list_contains(dropped, id)"))
def greedy_dedup(spark, sf_dir):
    return near_duplicates_removed(_entries(spark, sf_dir), 0.98, ENTRY_DIM)


@query("SELECT CAST(i AS INTEGER) AS i, round(avg(x), 5) AS mean FROM (SELECT unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) GROUP BY i")
def mean_vector(spark, sf_dir):
    long = table(spark, sf_dir, "embeddings").select(F.posexplode("embedding").alias("i", "x"))
    return long.groupBy("i").agg(F.round(F.avg(F.col("x").cast("double")), 5).alias("mean"))


@query()
def pca_explained(spark, sf_dir):
    """Share of variance along the leading 16 directions of the usable entries."""
    _, _, shares = Z.pca(_entries(spark, sf_dir), ENTRY_DIM, 16)
    return spark.createDataFrame([(i, round(float(s), 4)) for i, s in enumerate(shares)], "component int, share double")


# ------------------------------------------------------------------ fuzzy clusters


@query(f"WITH {_ASSIGNED} SELECT id, CAST(k AS INTEGER) AS k, round(x, 4) AS u FROM g")
def fcm_memberships(spark, sf_dir):
    return _assigned(spark, sf_dir).select("id", F.posexplode("u").alias("k", "u")).select("id", "k", F.round("u", 4).alias("u"))


@query(f"WITH {_ASSIGNED} SELECT id, round(-list_sum(list_transform(u, lambda x: x * ln(x + 1e-12))), 4) AS entropy, round(list_max(u), 4) AS max_u FROM a")
def membership_entropy(spark, sf_dir):
    return _assigned(spark, sf_dir).select("id", F.round(V.entropy(F.col("u")), 4).alias("entropy"), F.round(F.array_max("u"), 4).alias("max_u"))


@query(
    f"""WITH {_ASSIGNED}, r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY x DESC, k) AS r FROM g)
    SELECT id, string_agg(CAST(k AS VARCHAR), ',' ORDER BY r) AS cluster_ids, string_agg(printf('%.4f', x), ',' ORDER BY r) AS cluster_probs,
    CAST(min(k) FILTER (WHERE r = 1) AS INTEGER) AS dominant_cluster FROM r WHERE r <= 3 GROUP BY id"""
)
def top3_clusters(spark, sf_dir):
    return Z.metadata(_assigned(spark, sf_dir))


@query(
    f"""WITH {_ASSIGNED}, h AS (SELECT id, arg_max(k, x) AS c FROM g GROUP BY id)
    SELECT e.entry_id, CAST(h.c AS INTEGER) AS dominant_cluster, e.dominant_cluster AS stored FROM h JOIN (SELECT DISTINCT entry_id, dominant_cluster FROM cache_entries) e ON e.entry_id = h.id
    WHERE e.dominant_cluster IS DISTINCT FROM h.c"""
)
def stale_clusters(spark, sf_dir):
    """Entries whose stored dominant cluster is missing or not the model's."""
    found = _assigned(spark, sf_dir).select(F.col("id").alias("entry_id"), V.argmax(F.col("u")).alias("dominant_cluster"))
    held = table(spark, sf_dir, "cache_entries").select("entry_id", F.col("dominant_cluster").alias("stored")).distinct()
    return found.join(held, "entry_id").where(~F.col("stored").eqNullSafe(F.col("dominant_cluster")))


@query(f"WITH {_ASSIGNED} SELECT round(sum(x * x) / count(DISTINCT id), 4) AS fpc, count(DISTINCT id) AS n FROM g")
def fpc(spark, sf_dir):
    squared = F.aggregate("u", F.lit(0.0), lambda s, x: s + x * x)
    return _assigned(spark, sf_dir).agg(F.round(F.sum(squared) / F.count("*"), 4).alias("fpc"), F.count("*").alias("n"))


_HARD = f"{_ASSIGNED}, h AS (SELECT id, arg_max(k, x) AS c, max(x) AS mx FROM g GROUP BY id)"


@query(f"WITH {_HARD} SELECT CAST(r.k AS INTEGER) AS cluster, count(h.id) AS size FROM range(15) r(k) LEFT JOIN h ON h.c = r.k GROUP BY r.k")
def cluster_sizes(spark, sf_dir):
    return Z.cluster_sizes(_assigned(spark, sf_dir), 15)


@query(
    f"""WITH {_ASSIGNED}, r AS (SELECT k, id, round(x, 6) AS x6, row_number() OVER (PARTITION BY k ORDER BY round(x, 6) DESC, id) AS r FROM g)
    SELECT CAST(k AS INTEGER) AS cluster, CAST(r AS INTEGER) AS rank, id, x6 AS u FROM r WHERE r <= 10"""
)
def core_docs(spark, sf_dir):
    return Z.core_members(_assigned(spark, sf_dir))


@query(
    f"""WITH {_HARD}, r AS (SELECT c, id, mx, row_number() OVER (PARTITION BY c ORDER BY id) AS r FROM h WHERE mx < 0.5)
    SELECT CAST(c AS INTEGER) AS cluster, CAST(r AS INTEGER) AS rank, id, round(mx, 6) AS max_u FROM r WHERE r <= 5"""
)
def boundary_docs(spark, sf_dir):
    return Z.boundary_members(_assigned(spark, sf_dir))


@query(f"WITH {_HARD} SELECT id, round(mx, 6) AS max_u, CAST(c AS INTEGER) AS cluster FROM h ORDER BY round(mx, 6), id LIMIT 10")
def most_uncertain(spark, sf_dir):
    return Z.most_uncertain(_assigned(spark, sf_dir))


@query(
    """WITH s AS (SELECT DISTINCT * FROM rag_sources), n AS (SELECT cluster_id, category, count(*) AS n, min(source_id) AS f FROM s GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, f, category) AS rank FROM n) SELECT cluster_id AS cluster, CAST(rank AS INTEGER) AS rank, category, n FROM r WHERE rank <= 5"""
)
def category_mix(spark, sf_dir):
    return Z.category_mix(table(spark, sf_dir, "rag_sources").distinct(), "cluster_id", "category", "source_id")


def _fit_vectors(spark, sf_dir) -> DataFrame:
    """Whole entries along their leading directions."""
    return Z.projected(_entries(spark, sf_dir), ENTRY_DIM, PCA_DIM)[0]


@query()
def fcm_centers(spark, sf_dir):
    """Centres of a training run to convergence, in long form."""
    made = Z.fit(_fit_vectors(spark, sf_dir), FIT_K, FIT_M, dim=PCA_DIM)
    rows = [(k, i, round(float(x), 4), made.n_iter) for k, row in enumerate(made.model.centers) for i, x in enumerate(row)]
    return spark.createDataFrame(rows, "k int, i int, center double, n_iter int")


@query()
def sweep_k(spark, sf_dir):
    rows = [(k, round(fpc, 4), s, n) for k, fpc, s, n in Z.sweep_k(_fit_vectors(spark, sf_dir), list(range(8, 26)), FIT_M, dim=PCA_DIM)]
    return spark.createDataFrame(rows, "k int, fpc double, silhouette double, n_iter int")


@query()
def sweep_m(spark, sf_dir):
    rows = [(m, round(fpc, 4), round(h, 4), round(d, 4), n) for m, fpc, h, d, n in Z.sweep_m(_fit_vectors(spark, sf_dir), [1.2, 1.5, 2.0, 2.5, 3.0], FIT_K, dim=PCA_DIM)]
    return spark.createDataFrame(rows, "m double, fpc double, entropy_mean double, entropy_std double, n_iter int")


@query(
    f"""WITH s AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS e FROM embeddings ORDER BY md5(CAST(vec_id AS VARCHAR)), vec_id LIMIT 3000),
    p AS (SELECT x.id, x.label AS own, y.label AS other, sum(list_distance(x.e, y.e)) AS d, count(*) AS n FROM s x JOIN s y ON x.id <> y.id GROUP BY ALL),
    t AS (SELECT id, max(CASE WHEN own = other THEN d / n END) AS a, min(CASE WHEN own <> other THEN d / n END) AS b FROM p GROUP BY id)
    SELECT round(avg(CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 4) AS silhouette, count(*) AS n FROM t"""
)
def silhouette(spark, sf_dir):
    labelled = _rows(spark, sf_dir).join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label"), "id")
    return Z.silhouette(labelled, VECTOR_DIM)


# ------------------------------------------------------------------ cache


@query(
    f"""WITH {_ASSIGNED}, r AS (SELECT id, k, row_number() OVER (PARTITION BY id ORDER BY x DESC, k) AS r FROM g)
    SELECT id, CAST(max(CASE WHEN r = 1 THEN k END) AS INTEGER) AS first, CAST(max(CASE WHEN r = 2 THEN k END) AS INTEGER) AS second FROM r WHERE r <= 2 GROUP BY id"""
)
def route_top2(spark, sf_dir):
    best = V.top_n(F.col("u"), 2)
    return _assigned(spark, sf_dir).select("id", F.get(best, F.lit(0)).k.alias("first"), F.get(best, F.lit(1)).k.alias("second"))


_ROUTED = f"""{_ASSIGNED}, r AS (SELECT id, k, row_number() OVER (PARTITION BY id ORDER BY x DESC, k) AS r FROM g),
pair AS (SELECT x.id AS query_id, y.id, round(list_dot_product(x.w, y.w), 6) AS cosine FROM u x JOIN u y ON x.id <> y.id WHERE x.id % {EVERY} = 0),
c AS (SELECT p.query_id, q.r, p.id, p.cosine FROM pair p JOIN r e ON e.id = p.id AND e.r = 1 LEFT JOIN r q ON q.id = p.query_id AND q.k = e.k AND q.r <= 2),
n AS (SELECT query_id, id, cosine, r IS NOT NULL AS routed, row_number() OVER (PARTITION BY query_id ORDER BY r IS NOT NULL DESC, cosine DESC, r, id) AS rank FROM c),
one AS (SELECT query_id, id, cosine, routed FROM n WHERE rank = 1)"""


def _routed(spark, sf_dir) -> DataFrame:
    both = _entries(spark, sf_dir).join(_assigned(spark, sf_dir), "id")
    return C.routed_nearest(both.where(F.col("id") % EVERY == 0), both, ENTRY_DIM)


@query(f"WITH {_ROUTED} SELECT query_id, id, round(cosine, 4) AS cosine, routed FROM one")
def cluster_routed_1nn(spark, sf_dir):
    return _routed(spark, sf_dir).withColumn("cosine", F.round("cosine", 4))


@query(
    f"""WITH {_ROUTED}, e AS (SELECT x.id AS query_id, max(round(list_dot_product(x.w, y.w), 6)) AS best FROM u x JOIN u y ON x.id <> y.id WHERE x.id % {EVERY} = 0 GROUP BY x.id)
    SELECT count(*) AS n, round(avg(CASE WHEN coalesce(one.cosine, -2) >= e.best - 1e-6 THEN 1.0 ELSE 0.0 END), 4) AS recall FROM e LEFT JOIN one USING (query_id)"""
)
def routing_recall(spark, sf_dir):
    vecs = _entries(spark, sf_dir)
    best = knn(vecs, vecs.where(F.col("id") % EVERY == 0), 1, ENTRY_DIM).select("query_id", F.col("cosine").alias("best"))
    both = best.join(_routed(spark, sf_dir), "query_id", "left")
    hit = F.when(F.coalesce("cosine", F.lit(-2.0)) >= F.col("best") - 1e-6, 1.0).otherwise(0.0)
    return both.agg(F.count("*").alias("n"), F.round(F.avg(hit), 4).alias("recall"))


@query()
def cache_replay_routed(spark, sf_dir):
    """The cached questions asked again in order of time, through one cache that is never flushed."""
    entries = table(spark, sf_dir, "cache_entries").where("cached_at is not null")
    when = entries.groupBy(F.col("entry_id").alias("id")).agg(F.min("cached_at").alias("seq"))
    log = _entries(spark, sf_dir).join(when, "id").withColumn("epoch", F.lit("all"))
    return C.replay(log, Z.FuzzyModel.load(table(spark, sf_dir, "fcm_model")), ENTRY_DIM)


@query(_walk_sql(C.THETA, "SELECT id, list_contains(dropped, id) AS hit FROM u, last"))
def cache_replay_flat(spark, sf_dir):
    return C.replay_flat(_entries(spark, sf_dir), C.THETA, ENTRY_DIM)


_LOG = "l AS (SELECT DISTINCT * FROM search_log)"
_STATS = """count(cache_hit) AS requests, count_if(cache_hit) AS hits, count(cache_hit) - count_if(cache_hit) AS misses,
CASE WHEN count(cache_hit) > 0 THEN round(count_if(cache_hit) / count(cache_hit), 4) ELSE 0.0 END AS hit_rate"""


@query(f"WITH {_LOG} SELECT {_STATS} FROM l")
def cache_stats(spark, sf_dir):
    return C.stats(table(spark, sf_dir, "search_log").distinct())


@query(f"WITH {_LOG} SELECT client_id, {_STATS} FROM l GROUP BY client_id")
def cache_stats_by_client(spark, sf_dir):
    return C.stats(table(spark, sf_dir, "search_log").distinct(), "client_id")


@query(
    f"""WITH {_LOG}, t AS (SELECT unnest({THETAS}) AS theta), h AS (SELECT theta, count(*) AS requests, count_if(coalesce(similarity >= theta, false)) AS hits FROM l, t GROUP BY theta)
    SELECT CAST(theta AS DOUBLE) AS theta, requests, hits, requests - hits AS misses, round(hits / requests, 4) AS hit_rate FROM h"""
)
def theta_sweep(spark, sf_dir):
    return C.theta_sweep(table(spark, sf_dir, "search_log").distinct(), THETAS)


@query(f"WITH {_LOG} SELECT matched_entry AS entry_id, count(*) AS hits FROM l WHERE cache_hit AND matched_entry IS NOT NULL GROUP BY matched_entry")
def entry_hits(spark, sf_dir):
    log = table(spark, sf_dir, "search_log").distinct().where("cache_hit and matched_entry is not null")
    return log.groupBy(F.col("matched_entry").alias("entry_id")).agg(F.count("*").alias("hits"))


# ------------------------------------------------------------------ retrieval and evaluation

_SRC = "s AS (SELECT DISTINCT * FROM rag_sources)"


@query(f"WITH {_SRC} SELECT run_id, count(*) AS n, count_if(coalesce(score, 0) >= 0.3) AS relevant FROM s GROUP BY run_id")
def relevance_filter(spark, sf_dir):
    ok = F.coalesce("score", F.lit(0.0)) >= R.LEAST_SCORE
    return table(spark, sf_dir, "rag_sources").distinct().groupBy("run_id").agg(F.count("*").alias("n"), F.count_if(ok).alias("relevant"))


_TOP = f"""{_SRC}, p AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY rank_pos, source_id) AS i FROM s WHERE coalesce(score, 0) >= 0.3), g AS (SELECT * FROM p WHERE i <= 5)"""


def _top(spark, sf_dir) -> DataFrame:
    return R.first_passing(table(spark, sf_dir, "rag_sources").distinct(), "run_id", "rank_pos")


@query(
    f"""WITH {_TOP} SELECT run_id, CAST(i AS INTEGER) AS source_index, coalesce(category, 'unknown') AS category, round(score, 4) AS score, coalesce(cluster_id, -1) AS cluster,
    substring(snippet, 1, 200) AS snippet FROM g"""
)
def graded_sources(spark, sf_dir):
    return R.source_view(_top(spark, sf_dir))


@query(
    f"""WITH {_TOP} SELECT run_id, md5(string_agg(printf('[%d] Category: %s | Score: %.3f', i, coalesce(category, 'unknown'), round(score, 3)) || chr(10) || coalesce(substring(snippet, 1, 200), ''), chr(10) || '---' || chr(10) ORDER BY i)) AS context_md5
    FROM g GROUP BY run_id"""
)
def rag_context(spark, sf_dir):
    return R.context(R.source_view(_top(spark, sf_dir))).select("run_id", F.md5("context").alias("context_md5"))


@query(
    """WITH r AS (SELECT DISTINCT run_id, rewrite_attempts, has_relevant_docs FROM rag_runs)
    SELECT run_id, CASE WHEN coalesce(has_relevant_docs, false) OR coalesce(rewrite_attempts, 0) >= 2 THEN 'generate' ELSE 'retry' END AS route FROM r"""
)
def rag_routing(spark, sf_dir):
    runs = table(spark, sf_dir, "rag_runs").select("run_id", "rewrite_attempts", "has_relevant_docs").distinct()
    return runs.select("run_id", R.route(F.col("rewrite_attempts"), F.col("has_relevant_docs")).alias("route"))


@query()
def rag_answers(spark, sf_dir):
    """The evaluation questions answered from the documents by the offline models."""
    items = table(spark, sf_dir, "eval_items").select(F.col("item_id").alias("query_id"), F.col("question").alias("query"))
    return R.RagPipeline(table(spark, sf_dir, "documents")).run(items).drop("sources")


_TOK = "list_distinct(list_filter(regexp_split_to_array(lower(coalesce({}, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> ''))"
_SCORED = f"""e AS (SELECT item_id, {_TOK.format('question')} AS q, {_TOK.format('answer')} AS a, list_transform(coalesce(contexts, []), lambda c: {_TOK.format('c')}) AS c FROM eval_items),
f AS (SELECT item_id, q, a, c, list_distinct(flatten(c)) AS un, list_transform(c, lambda x: CASE WHEN len(list_intersect(q, x)) * 4 >= len(q) THEN 1 ELSE 0 END) AS h FROM e),
pr AS (SELECT *, list_filter(list_transform(h, lambda y, i: CASE WHEN y = 1 THEN list_sum(h[1:i]) / i END), lambda z: z IS NOT NULL) AS pk FROM f),
sc AS (SELECT item_id, round(CASE WHEN len(a) > 0 THEN len(list_intersect(a, un)) / len(a) END, 4) AS support,
  round(CASE WHEN len(list_distinct(list_concat(q, a))) > 0 THEN len(list_intersect(q, a)) / len(list_distinct(list_concat(q, a))) END, 4) AS relevancy,
  round(CASE WHEN len(pk) > 0 THEN list_sum(pk) / len(pk) WHEN len(c) > 0 THEN 0.0 END, 4) AS context_precision FROM pr)"""


@query(f"WITH {_SCORED} SELECT item_id, support, relevancy, context_precision FROM sc")
def eval_scores(spark, sf_dir):
    return E.scores(table(spark, sf_dir, "eval_items"))


@query(f"WITH {_SCORED} SELECT round(avg(support), 4) AS support, round(avg(relevancy), 4) AS relevancy, round(avg(context_precision), 4) AS context_precision, count(*) AS n FROM sc")
def eval_aggregate(spark, sf_dir):
    return E.aggregate(E.scores(table(spark, sf_dir, "eval_items")))
