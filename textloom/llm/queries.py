"""Registered queries of the training-data operators, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.plans.storage import stored


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.llm.vectors import similarity_clusters

    return similarity_clusters(_table(spark, sf_dir, "cache_entries"), "entry_id", "embedding").select("cluster_key", "entry_id")


def p3_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and three most typical members of every cluster."""
    from textloom.llm.vectors import similarity_clusters

    members = similarity_clusters(_table(spark, sf_dir, "cache_entries"), "entry_id", "embedding", split=True)
    return members.where("typical_rank <= 3").groupBy("cluster_key", "size").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("typical_rank", "entry_id"))), lambda x: x.entry_id).alias("typical")
    )


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.llm.vectors import most_similar

    near = most_similar(_table(spark, sf_dir, "cache_entries"), "entry_id", "embedding")
    return near.select(F.least("id", "other").alias("entry_a"), F.greatest("id", "other").alias("entry_b")).distinct()


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.llm.leaks import leaks

    return leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "eval_items")).select("doc_id", "item_id").distinct()


def p9_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.llm.leaks import leaks, without_leaks

    docs = _table(spark, sf_dir, "documents")
    return without_leaks(docs, leaks(docs, _table(spark, sf_dir, "eval_items")))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.llm.language import languages, train, wrong_labels

    docs = _table(spark, sf_dir, "documents")
    return wrong_labels(languages(docs, train(docs)))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.llm.subjects import featured, subjects, train

    read = featured(_table(spark, sf_dir, "documents"))
    return subjects(read, train(read, _table(spark, sf_dir, "subject_labels"))).select("doc_id", "subject").distinct()


def p1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Composition of the corpus: documents of each filed category by found subject."""
    from textloom.llm.subjects import featured, subjects, train

    docs = _table(spark, sf_dir, "documents")
    read = featured(docs)
    found = subjects(read, train(read, _table(spark, sf_dir, "subject_labels")))
    both = docs.select("doc_id", F.lower("category").alias("category")).join(found, "doc_id", "left")
    return both.groupBy("category", F.coalesce("subject", F.lit("none")).alias("subject")).agg(F.countDistinct("doc_id").alias("n"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.llm.neardup import near_duplicates, pairs

    return pairs(*near_duplicates(_table(spark, sf_dir, "documents")))


def p2_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of every document, on runs of five words at 0.8."""
    from textloom.llm.neardup import classes, near_duplicates

    return classes(*near_duplicates(_table(spark, sf_dir, "documents"), gram=5, similarity=0.8))


def _personal(spark: SparkSession, sf_dir: str, masked: bool) -> DataFrame:
    from textloom.llm.pii import found, train_on

    tagger = train_on(_table(spark, sf_dir, "raw_posts"))
    parts = [("documents", "doc_id", "text"), ("raw_posts", "post_id", "text"), ("rag_sources", "source_id", "snippet")]
    made = [found(_table(spark, sf_dir, t), tagger, t, i, c, masked) for t, i, c in parts]
    return made[0].unionByName(made[1]).unionByName(made[2])


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _personal(spark, sf_dir, False).select("table_name", "row_id", "pii_type", "start_pos").distinct()


def p7_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _personal(spark, sf_dir, True)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.llm.mail import authored, train

    return authored(_table(spark, sf_dir, "raw_posts"), train()).select("post_id", "line_no").distinct()


def p6_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.llm.mail import new_text, train

    return new_text(_table(spark, sf_dir, "raw_posts"), train())


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.llm.responses import defects, tongues_for

    runs = _table(spark, sf_dir, "rag_runs")
    return defects(runs, tongues_for(runs, _table(spark, sf_dir, "documents")))


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.llm.packing import pack, token_counts

    return pack(stored(token_counts(_table(spark, sf_dir, "documents"))))


QUERIES = {f.__name__: f for f in (p3_found, p3_clusters, p4_found, p9_found, p9_clean, p10_found, p1_found, p1_mix, p2_found, p2_classes, p7_found, p7_masked, p6_found, p6_text, p5_found, p8_containers)}
SQL: dict[str, str] = {
    "p2_found": """WITH t AS (SELECT doc_id, regexp_extract_all(lower(nfc_normalize(text)), '[\\p{L}\\p{N}]+') AS w FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
    g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM t),
    n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL)
    SELECT a AS doc_a, b AS doc_b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 2 * c >= x.n + y.n - c""",
    "p3_found": """WITH RECURSIVE v AS (SELECT DISTINCT ON (entry_id) entry_id AS id, embedding::DOUBLE[] AS e FROM cache_entries WHERE entry_id IS NOT NULL AND len(embedding) = 128
      AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    u AS (SELECT id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS w FROM v),
    l AS MATERIALIZED (SELECT x.id AS a, y.id AS b FROM u x JOIN u y ON x.id <> y.id AND round(list_dot_product(x.w, y.w), 6) >= 0.75),
    r(id, k) AS (SELECT DISTINCT a, a FROM l UNION SELECT l.b, r.k FROM r JOIN l ON l.a = r.id WHERE l.b > r.k)
    SELECT min(k) AS cluster_key, id AS entry_id FROM r GROUP BY id""",
}
