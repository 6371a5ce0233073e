import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.functions import vectors as V
from textloom.operators import cache as C
from textloom.operators import evaluate as E
from textloom.operators import fuzzy as Z
from textloom.operators import rag as R
from textloom.operators.encode import HashEncoder
from textloom.operators.similarity import greedy_keep, knn, near_duplicates_removed, near_pairs, vectors
from textloom.plans.api import SemanticSearch, evaluate, health
from textloom.sources import corpus as S

DIM = 6


def random_vectors(n=120, seed=1, spread=0.1):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(n // 8, DIM))
    return (centers[np.arange(n) % len(centers)] + rng.normal(size=(n, DIM)) * spread).round(4)


def frame(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id bigint, vec array<double>")


def cosines(x):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    return np.round(u @ u.T, 6)


def test_usable_vectors(spark):
    rows = [(1, [1.0] * DIM), (2, None), (3, [0.0] * DIM), (4, [1.0]), (5, [float("nan")] * DIM), (6, [1.0] * (DIM - 1) + [None]), (None, [1.0] * DIM), (1, [1.0] * DIM), (7, [float("-inf")] + [1.0] * (DIM - 1))]
    assert [r.id for r in vectors(spark.createDataFrame(rows, "k bigint, v array<float>"), "k", "v", DIM).collect()] == [1]


def test_knn_is_exact(spark):
    x = random_vectors()
    df = frame(spark, x)
    got = {}
    for r in knn(df, df.where("id % 10 = 0"), 4, DIM).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.id))
    c = cosines(x)
    for q, rows in got.items():
        true = [b for b in np.lexsort((np.arange(len(x)), -c[q])) if b != q][:4]
        assert [b for _, b in sorted(rows)] == true
    assert knn(df.limit(0), df, 3, DIM).count() == 0 and knn(df, df.limit(0), 3, DIM).count() == 0


@pytest.mark.parametrize("least", [0.9, 0.98, 0.995])
def test_near_pairs_and_greedy_removal(spark, least):
    x = random_vectors(spread=0.12)
    c = cosines(x)
    df = frame(spark, x)
    assert {(r.a, r.b) for r in near_pairs(df, least, DIM).collect()} == {(a, b) for a, b in itertools.combinations(range(len(x)), 2) if c[a, b] >= least}
    kept = []
    for i in range(len(x)):
        if all(c[i, j] < least for j in kept):
            kept.append(i)
    assert sorted(r.id for r in near_duplicates_removed(df, least, DIM).collect()) == kept
    flat = {r.id: r.hit for r in C.replay_flat(df, least, DIM).collect()}
    assert flat == {i: i not in kept for i in range(len(x))}


def test_long_chains_and_hot_cells(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(39)], "a bigint, b bigint")
    assert sorted(r.id for r in greedy_keep(spark.range(40), chain).collect()) == list(range(0, 40, 2))
    x = np.vstack([random_vectors(80, spread=0.12), np.tile(random_vectors(8)[:1], (60, 1)) + np.random.default_rng(3).normal(size=(60, DIM)) * 0.003, np.tile(random_vectors(8)[1:2], (20, 1))])
    c = cosines(x)
    want = {(a, b) for a, b in itertools.combinations(range(len(x)), 2) if c[a, b] >= 0.98}
    for blocks in (2048, 7):
        assert {(r.a, r.b) for r in near_pairs(frame(spark, x), 0.98, DIM, per_cell=10, block_rows=blocks).collect()} == want


def test_greedy_of_nothing(spark):
    empty = spark.createDataFrame([], "id bigint")
    assert greedy_keep(empty, spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_vector_expressions(spark):
    df = spark.createDataFrame([([0.2, 0.5, 0.3, 0.5],)], "u array<double>")
    r = df.select(V.argmax(F.col("u")).alias("a"), V.top_n(F.col("u"), 3).alias("t"), V.entropy(F.col("u")).alias("h"), V.unit(F.col("u")).alias("n")).first()
    assert r.a == 1 and [(p.k, p.u) for p in r.t] == [(1, 0.5), (3, 0.5), (2, 0.3)]
    assert math.isclose(r.h, -sum(v * math.log(v + 1e-12) for v in (0.2, 0.5, 0.3, 0.5))) and math.isclose(sum(v * v for v in r.n), 1, abs_tol=1e-9)


def test_memberships_on_centres(spark):
    model = Z.FuzzyModel(np.array([[0.0, 0.0], [0.0, 0.0], [3.0, 4.0]]), 2.0)
    assert model.memberships(np.array([[0.0, 0.0]])).tolist() == [[0.5, 0.5, 0.0]]
    assert model.memberships(np.array([[0.0, 0.0]]), shared=False).tolist() == [[1.0, 1.0, 0.0]]
    for shared in (True, False):
        df = spark.createDataFrame([([0.0, 0.0, 5.0],), ([1.0, 2.0, 4.0],)], "d array<double>")
        got = [r.u for r in df.select(V.memberships(F.col("d"), 2.0, shared).alias("u")).collect()]
        assert got[0] == ([0.5, 0.5, 0.0] if shared else [1.0, 1.0, 0.0])
        assert math.isclose(sum(got[1]), 1) and math.isclose(got[1][0] / got[1][1], 4)


def test_fit_matches_numpy(spark):
    x = random_vectors(60, spread=0.4)
    result = Z.fit(frame(spark, x), 3, 1.7, 8, 0.0, DIM)
    u = Z.initial(list(range(60)), 3)
    for _ in range(8):
        w = u**1.7
        centers = (w.T @ x) / w.sum(0)[:, None]
        d = np.sqrt(((x[:, None] - centers[None]) ** 2).sum(2))
        q = d ** (-2 / 0.7)
        u = q / q.sum(1, keepdims=True)
    assert np.allclose(result.model.centers, centers, atol=1e-8)
    assert math.isclose(result.fpc, (u * u).sum() / 60, abs_tol=1e-8) and result.n_iter == 8 and 1 / 3 <= result.fpc <= 1
    assert Z.fit(frame(spark, x), 3, 1.7, 150, 1e-3, DIM).n_iter < 150
    both = Z.fit_many(frame(spark, x), [(3, 1.7), (2, 2.0)], 8, 0.0, DIM)
    assert np.allclose(both[0].model.centers, centers, atol=1e-8) and len(both[1].model.centers) == 2
    swept = Z.sweep_k(frame(spark, x), [2, 3], 1.7, 20)
    assert [k for k, *_ in swept] == [2, 3] and all(-1 <= s <= 1 and 1 / k <= fpc <= 1 for k, fpc, s, _ in swept)
    assert [m for m, *_ in Z.sweep_m(frame(spark, x), [1.5, 2.0], 3, 5)] == [1.5, 2.0]


def test_pca_matches_numpy(spark):
    x = random_vectors(80)
    mean, components, shares = Z.pca(frame(spark, x), DIM, 3)
    w, v = np.linalg.eigh(np.cov(x.T, bias=True))
    assert np.allclose(mean, x.mean(0)) and np.allclose(shares, w[::-1][:3] / w.sum())
    assert np.allclose(np.abs(components @ v[:, ::-1][:, :3]), np.eye(3), atol=1e-6)


def test_model_round_trip(spark, tmp_path):
    model = Z.FuzzyModel(np.eye(2), 2.0, np.ones((2, DIM)), np.zeros(DIM))
    model.save(spark, str(tmp_path / "m"))
    again = Z.FuzzyModel.load(spark.read.parquet(str(tmp_path / "m")))
    assert np.array_equal(again.centers, model.centers) and np.array_equal(again.components, model.components) and again.m == 2.0


def test_decisions_in_order():
    held = C.Held(2)
    unit, routes = C.placed(np.array([[2.0, 0.0], [1.0, 0.01], [0.0, 3.0], [1.0, 0.0]]), None)
    matched, sims = C.decide(held, np.array([7, 8, 9, 10]), unit, routes, 0.85)
    assert matched.tolist() == [-1, 7, -1, 7] and held.n == 2 and held.key[:2].tolist() == [7, 9] and math.isclose(sims[3], 1, abs_tol=1e-9)
    matched, _ = C.decide(held, np.array([11]), unit[2:3], routes[2:3], 0.85)
    assert matched.tolist() == [9]


def sequential(x, model, theta):
    """The cache as a plain loop: (matched or -1) of every request."""
    u, routes = C.placed(x, model)
    entries, out = [], []
    for i in range(len(x)):
        near = [(way, e) for way in range(routes.shape[1]) for e in entries if routes[e][0] == routes[i][way]] or [(0, e) for e in entries]
        best = max(near, key=lambda t: (float(u[t[1]] @ u[i]), -t[0], -t[1]), default=None)
        if best is not None and round(float(u[best[1]] @ u[i]), 6) >= theta:
            out.append(best[1])
        else:
            entries.append(i)
            out.append(-1)
    return out


def test_replay_matches_a_plain_loop(spark, monkeypatch):
    x = random_vectors(160, seed=5, spread=0.3)
    model = Z.FuzzyModel(random_vectors(40, seed=6)[:5], 2.0)
    monkeypatch.setattr(C, "BLOCK", 16)
    log = spark.createDataFrame([("a", i, i, [float(v) for v in row]) for i, row in enumerate(x)], "epoch string, seq int, id bigint, vec array<double>")
    for m in (model, None):
        got = {r.id: -1 if r.matched is None else r.matched for r in C.replay(log, m, DIM, 0.9).collect()}
        assert [got[i] for i in range(len(x))] == sequential(x, m, 0.9) and -1 in got.values() and len(set(got.values())) > 5


def test_routing_falls_back_to_all(spark):
    model = Z.FuzzyModel(np.array([[1.0, 0.0], [0.0, 1.0], [-1.0, 0.0], [0.0, -1.0]]), 2.0)
    unit, routes = C.placed(np.array([[-1.0, 0.0], [0.8, 0.6]]), model)
    assert routes[1].tolist() == [0, 1] and C.decide(C.Held(2), np.array([1, 2]), unit, routes, -1.0)[0].tolist() == [-1, 1]
    log = spark.createDataFrame([("a", 2, 2, [1.0, 0.05]), ("a", 1, 1, [1.0, 0.0]), ("b", 3, 3, [1.0, 0.0])], "epoch string, seq int, id bigint, vec array<double>")
    got = {r.id: (r.hit, r.matched) for r in C.replay(log, model, 2).collect()}
    assert got == {1: (False, None), 2: (True, 1), 3: (False, None)}
    u = lambda *k: [0.9 if i == k[0] else 0.08 if i == k[1] else 0.01 for i in range(4)]
    schema = "id bigint, vec array<double>, u array<double>"
    entries = spark.createDataFrame([(1, [1.0, 0.0], u(2, 3)), (2, [0.0, 1.0], u(2, 3)), (3, [0.9, 0.1], u(3, 2))], schema)
    queries = spark.createDataFrame([(10, [1.0, 0.1], u(0, 1)), (11, [1.0, 0.0], u(3, 0)), (12, [0.5, 0.5], u(2, 0))], schema)
    got = {r.query_id: (r.id, r.routed) for r in C.routed_nearest(queries, entries, 2).collect()}
    assert got == {10: (3, False), 11: (3, True), 12: (1, True)}


def test_thresholds_are_inclusive(spark):
    log = spark.createDataFrame([(0.85,), (0.8499,), (None,)], "similarity double")
    assert [(r.hits, r.misses) for r in C.theta_sweep(log, [0.85]).collect()] == [(1, 2)]
    src = spark.createDataFrame([(1, i, i, s) for i, s in enumerate([0.3, 0.29, None, 0.9, 0.8, 0.7, 0.6, 0.5])], "run_id bigint, source_id bigint, rank_pos int, score double")
    top = R.first_passing(src, "run_id", "rank_pos").orderBy("source_index").collect()
    assert [(r.source_index, r.source_id) for r in top] == [(1, 0), (2, 3), (3, 4), (4, 5), (5, 6)]


def test_grades(spark):
    df = spark.createDataFrame([(" yes, it is", False), ("NO", False), (None, True), (None, None), ("maybe YES", False)], "r string, f boolean")
    assert [x.p for x in df.select(R.passes(F.col("r"), F.col("f")).alias("p")).collect()] == [True, False, True, False, False]


DOCS = [(1, "the comet crossed the orbit of the crater today", "sci"), (2, "the altar and the sermon were older than the temple", None), (3, None, "x"), (4, "", "x")]


def test_pipeline_and_evaluation(spark):
    docs = spark.createDataFrame(DOCS, "doc_id bigint, text string, category string")
    pipe = R.RagPipeline(docs)
    queries = spark.createDataFrame([(1, "which comet crossed"), (2, "zzz qqqq"), (3, "  "), (4, None)], "query_id bigint, query string")
    got = {r.query_id: r for r in pipe.run(queries).collect()}
    assert set(got) == {1, 2} and got[1].has_relevant_docs and got[1].rewrite_attempts == 1
    assert got[2].answer == R.NO_DOCUMENTS and got[2].n_sources == 0 and got[2].rewrite_attempts == 2 and (got[2].input_tokens, got[2].output_tokens) == (0, 0)
    assert got[1].output_tokens > 0 and [(x["index"], x.category, x.cluster, x.snippet) for x in got[1].sources] == [(1, "sci", -1, DOCS[0][1])]
    scored, mean = evaluate(pipe, queries.where("query_id < 3"))
    assert scored.count() == 2 and mean.first().n == 2
    for n in (0, 11):
        with pytest.raises(ValueError):
            E.checked(spark.range(n).select(F.lit("q").alias("query")))


def test_means_skip_missing(spark):
    df = spark.createDataFrame([(1.0, None, float("nan")), (0.0, 0.5, 1.0)], "support double, relevancy double, context_precision double")
    assert tuple(E.aggregate(df).first()) == (0.5, 0.5, 1.0, 2)


def test_search_with_cache(spark):
    encoder = HashEncoder(16)
    docs = spark.createDataFrame(DOCS, "id bigint, text string, category string").withColumn("dominant_cluster", F.lit(None).cast("int"))
    store = docs.join(encoder.encode(docs, "id", "text"), "id")
    search = SemanticSearch(store, encoder)
    first = search.query(spark.createDataFrame([(1, "comet orbit"), (2, "orbit comet")], "query_id bigint, query string")).collect()
    assert {r.query_id: (r.hit, r.matched_query, r.cluster) for r in first} == {1: (False, None, -1), 2: (True, "comet orbit", -1)} and all(len(r.results) == 2 for r in first)
    second = search.query(spark.createDataFrame([(1, "Comet, ORBIT")], "query_id bigint, query string")).collect()  # an id used before
    assert [(r.query_id, r.hit, r.matched_query) for r in second] == [(1, True, "comet orbit")]
    s = search.stats().first()
    assert (s.requests, s.hits, s.total_entries) == (3, 2, 1) and health(spark, search).first().entries == 1
    with pytest.raises(ValueError):
        search.query(spark.createDataFrame([(4, " ")], "query_id bigint, query string"))
    with pytest.raises(ValueError):
        search.query(spark.createDataFrame([(4, "a"), (4, "b")], "query_id bigint, query string"))
    search.flush()
    assert search.stats().first().requests == 0


def test_directory_and_store(spark, tmp_path):
    body = "word " * 25
    for name, data in {"a/1": f"Subject: one\n\n{body}".encode(), "b/2": b"Subject: two\n\n" + body.encode() + b"\xff", "b/3": b"too short"}.items():
        p = tmp_path / "posts" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)
    docs = S.read_directory(spark, str(tmp_path / "posts"))
    rows = sorted((r.category, r.label_id, r.text[:5]) for r in docs.collect())
    assert rows == [("a", -1, "one. "), ("b", -1, "two. ")]
    path = str(tmp_path / "store")
    S.write_store(docs.union(docs), docs.select("id").distinct().withColumn("vec", F.array(F.lit(1.0))), path)
    store = S.open_store(spark, path)
    assert store.count() == 2 and {r.dominant_cluster for r in store.collect()} == {-1}
    one = store.orderBy("id").first().id
    S.write_back(store, spark.createDataFrame([(one, "3,1,2", "0.5,0.3,0.2", 3)], "id string, cluster_ids string, cluster_probs string, dominant_cluster int"), path + "2")
    assert sorted(r.dominant_cluster for r in S.open_store(spark, path + "2").collect()) == [-1, 3]


def test_entry_points(spark, tmp_path):
    from textloom.__main__ import cluster, prepare

    words = "comet orbit altar sermon engine brake ballot judge lens crater stadium coach".split()
    for i in range(24):
        p = tmp_path / "posts" / "ab"[i % 2] / str(i)
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(f"Subject: post {i}\n\n" + " ".join(words[(i + k * (i % 5 + 1)) % 12] for k in range(25)))
    prepare(spark, str(tmp_path / "posts"), str(tmp_path / "store"), dim=16)
    cluster(spark, str(tmp_path / "store"), str(tmp_path / "out"), k=3, pca_dim=4)
    n = spark.read.parquet(str(tmp_path / "store")).count()
    assert 1 < n <= 24 and spark.read.parquet(str(tmp_path / "out" / "store")).where("dominant_cluster >= 0").count() == n
    assert spark.read.parquet(str(tmp_path / "out" / "memberships")).count() == n
    top = spark.read.parquet(str(tmp_path / "out" / "uncertain")).first()
    assert len(top.strongest) == 3 and top.strongest[0].u >= top.strongest[1].u


def test_sweep_measures_all_rows(spark, monkeypatch):
    monkeypatch.setattr(Z, "SAMPLE", 10)
    monkeypatch.setattr(Z, "ROWS", 16)
    monkeypatch.setattr(Z, "TILE", 24)
    x = random_vectors(90, spread=0.5)
    df = frame(spark, x)
    ks = [2, 3, 5]
    models = [r.model for r in Z.fit_many(df, [(k, 1.3) for k in ks], 20, 1e-4, DIM)]
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    want = []
    for model in models:
        y = model.memberships(x).argmax(1)
        s = []
        for i in range(len(x)):
            means = {c: d[i, y == c].sum() / max(1, (y == c).sum() - (c == y[i])) for c in set(y.tolist())}
            a, b = means.pop(y[i]), min(means.values())
            s.append((b - a) / max(a, b) if (y == y[i]).sum() > 1 else 0.0)
        want.append(np.mean(s))
    for part_rows in (262_144, 40):
        assert np.allclose(Z.silhouettes(df, models, DIM, part_rows), want, atol=6e-5)
    assert np.allclose([s for _, _, s, _ in Z.sweep_k(df, ks, 1.3, 20)], want, atol=6e-5)
    assert Z.silhouettes(df, [Z.FuzzyModel(models[0].centers[:1], 1.3)], DIM) == [None]


def test_pairs_and_removal_in_rounds(spark, monkeypatch):
    from textloom.operators import similarity as N

    monkeypatch.setattr(N, "PREFIX", 6)
    x = np.vstack([random_vectors(96, spread=0.1), random_vectors(8)[:2].repeat(20, 0), np.random.default_rng(5).normal(size=(30, DIM))])
    x = x[np.random.default_rng(6).permutation(len(x))]
    c, df = cosines(x), frame(spark, x)
    for least in (0.8, 0.97):
        want = {(a, b): c[a, b] for a, b in itertools.combinations(range(len(x)), 2) if c[a, b] >= least}
        for per_cell, blocks in ((40, 20), (1, 5)):
            got = [(r.a, r.b, r.cosine) for r in near_pairs(df, least, DIM, per_cell, blocks).collect()]
            assert len(got) == len(want) and all(math.isclose(want[a, b], s, abs_tol=1.1e-6) for a, b, s in got)
        kept = []
        for i in range(len(x)):
            if all(c[i, j] < least for j in kept):
                kept.append(i)
        assert sorted(r.id for r in near_duplicates_removed(df, least, DIM).collect()) == kept


def test_flat_replay_lists_no_pairs_of_large_groups(spark, monkeypatch):
    from textloom.operators import similarity as N

    asked, pairs = [], N._pairs
    monkeypatch.setattr(N, "PREFIX", 5)
    monkeypatch.setattr(N, "_pairs", lambda rows, *a: asked.append(rows.count()) or pairs(rows, *a))
    x = np.vstack([np.ones((60, DIM)) + np.random.default_rng(7).normal(size=(60, DIM)) * 0.01, np.random.default_rng(8).normal(size=(12, DIM))])
    c, kept = cosines(x), []
    for i in range(len(x)):
        if all(c[i, j] < C.THETA for j in kept):
            kept.append(i)
    assert {r.id: r.hit for r in C.replay_flat(frame(spark, x), C.THETA, DIM).collect()} == {i: i not in kept for i in range(len(x))}
    assert sum(asked) <= 12
