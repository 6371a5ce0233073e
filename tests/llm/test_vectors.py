import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm.vectors import _around_medoids, most_similar, similarity_clusters

SCHEMA = "entry_id bigint, embedding array<float>, id string"


def families(seed=0, groups=12, size=8, dim=128):
    rng = np.random.default_rng(seed)
    rows, x = [], []
    for g in range(groups):
        center = rng.normal(size=dim)
        center /= np.linalg.norm(center)
        for _ in range(size):
            v = center + rng.normal(size=dim) * 0.02
            rows.append((len(rows), v.astype(np.float32).tolist(), "clash"))
            x.append(np.array(rows[-1][1], np.float32).astype(np.float64))
    return rows, np.array(x)


BAD = [
    (900, None, None), (901, [0.0] * 128, "z"), (902, [1.0] * 64, "short"), (903, [float("nan")] + [1.0] * 127, None), (None, [1.0] * 128, None), (904, [float("inf")] + [1.0] * 127, ""),
]


def brute(x, k=5, least=0.75):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(u @ u.T, 6)
    np.fill_diagonal(s, -2)
    out = set()
    for a in range(len(x)):
        for b in np.lexsort((np.arange(len(x)), -s[a]))[:k]:
            if s[a, b] >= least:
                out.add((a, int(b)))
    return out


def test_most_similar_reaches_brute_force(spark):
    rows, x = families()
    df = spark.createDataFrame(rows + BAD + rows[:3], SCHEMA)
    got = {(r.id, r.other) for r in most_similar(df, "entry_id", "embedding").collect()}
    true = brute(x)
    assert len(got & true) >= 0.9 * len(true)
    assert all(a < 900 and b < 900 for a, b in got)


def test_many_copies_of_one_vector(spark):
    rows, _ = families(groups=2, size=6)
    copies = [(1000 + i, rows[0][1], None) for i in range(40)]
    df = spark.createDataFrame(rows + copies, SCHEMA)
    near = most_similar(df, "entry_id", "embedding")
    got = {}
    for r in near.collect():
        got.setdefault(r.id, []).append((-r.cosine, r.other))
    for i in range(1000, 1040):
        assert sorted(got[i])[:5] == [(-1.0, b) for b in [0, 1000, 1001, 1002, 1003, 1004] if b != i][:5]


def test_clusters(spark):
    rows, x = families(groups=6)
    df = spark.createDataFrame(rows + BAD, SCHEMA)
    got = {(r.cluster_key, r.entry_id) for r in similarity_clusters(df, "entry_id", "embedding").collect()}
    assert got == {((i // 8) * 8, i) for i in range(48)}
    ranks = similarity_clusters(df, "entry_id", "embedding").groupBy("cluster_key").agg(F.count("*").alias("n"), F.max("typical_rank").alias("m"), F.max("size").alias("s")).collect()
    assert all(r.n == r.m == r.s == 8 for r in ranks)


def test_clusters_beyond_a_block(spark):
    rows, _ = families(groups=3)
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.cluster_key, r.entry_id) for r in similarity_clusters(df, "entry_id", "embedding", block_rows=5).collect()}
    assert {b for _, b in got} <= set(range(24))


def test_loose_clusters_are_split_around_medoids(spark):
    # a chain: neighbours are 30 degrees apart (0.87), the next ones 60 (0.5); 1 and 2 have two neighbours each
    angles = np.deg2rad([0, 30, 60, 90])
    rows = [(i, [float(np.cos(a)), float(np.sin(a))] + [0.0] * 126, None) for i, a in enumerate(angles)]
    label = _around_medoids(np.array([v for _, v, _ in rows]), np.zeros(4, int), 0.75)
    assert label.tolist() == [0, 0, 0, 1]


@pytest.mark.parametrize("rows", [[], [(1, None, None)], [(1, [1.0] * 128, "a")]])
def test_nothing_to_compare(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    assert most_similar(df, "entry_id", "embedding").count() == 0
    assert similarity_clusters(df, "entry_id", "embedding").count() == 0


def test_a_cluster_beyond_a_block_has_one_key(spark):
    rows, _ = families(groups=3)
    df = spark.createDataFrame(rows, SCHEMA)
    for split in (False, True):
        got = {(r.cluster_key, r.entry_id, r.size) for r in similarity_clusters(df, "entry_id", "embedding", block_rows=5, split=split).collect()}
        assert got == {(i // 8 * 8, i, 8) for i in range(24)}


def test_exact_links_join_the_blocks_of_a_chain(spark):
    from textloom.llm.components import components
    from textloom.llm.vectors import _exact_links, usable

    # neighbours only are 0.75 or more alike
    angles = np.deg2rad(np.arange(9) * 30)
    chain = [(100 + i, [float(np.cos(a)), float(np.sin(a))] + [0.0] * 126, None) for i, a in enumerate(angles)]
    vecs = usable(spark.createDataFrame(chain, SCHEMA), "entry_id", "embedding").withColumn("key", F.lit(0).cast("bigint"))
    made = {(r.id, r.component) for r in components(_exact_links(vecs, 0.75, 128, 4)).collect()}
    assert made == {(100 + i, 100) for i in range(9)}


def test_long_band_buckets_are_linked_whole(spark):
    from textloom.llm.components import components
    from textloom.llm.vectors import candidate_links, usable

    rows, _ = families(groups=1, size=1)
    vecs = usable(spark.createDataFrame([(i, rows[0][1], None) for i in range(21)], SCHEMA), "entry_id", "embedding")
    made = {(r.id, r.component) for r in components(candidate_links(vecs, 21, block_rows=2)).collect()}
    assert made == {(i, 0) for i in range(21)}


def test_neighbours_in_a_bucket_of_many_near_copies(spark):
    rows, x = families(groups=12, size=4)
    rng = np.random.default_rng(4)
    more = (x[0] + rng.normal(size=(150, 128)) * 0.002).astype(np.float32)
    rows = rows + [(48 + i, v.tolist(), None) for i, v in enumerate(more)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.id, r.other) for r in most_similar(df, "entry_id", "embedding", block_rows=20).collect()}
    true = brute(np.vstack([x, more.astype(np.float64)]))
    assert len(got & true) >= 0.98 * len(true)


def test_long_codes_lose_no_more_neighbours(spark, monkeypatch):
    from textloom.llm import vectors

    rng = np.random.default_rng(3)
    center = rng.normal(size=(80, 128))
    center /= np.linalg.norm(center, axis=1, keepdims=True)
    x = (np.repeat(center, 5, axis=0) + rng.normal(size=(400, 128)) * 0.04).astype(np.float32)
    rows = [(i, v.tolist(), "z") for i, v in enumerate(x)]
    true = brute(x.astype(np.float64))
    df = spark.createDataFrame(rows, SCHEMA)
    monkeypatch.setattr(vectors, "substring_bits", lambda rows: 12)  # as for some millions of rows
    shares = []
    for substrings in (3, None):
        got = {(r.id, r.other) for r in most_similar(df, "entry_id", "embedding", substrings=substrings).collect()}
        shares.append(len(got & true) / len(true))
    assert 1 - shares[1] <= (1 - shares[0]) / 2


@pytest.mark.parametrize("substrings,rounds", [(6, [1] * 6), (9, [2, 2, 2, 2, 1])])
def test_substrings_are_not_all_shuffled_at_once(spark, monkeypatch, substrings, rounds):
    from textloom.llm import vectors

    rows, x = families(groups=6)
    df = spark.createDataFrame(rows + BAD, SCHEMA)
    met, sent = vectors.in_whole_groups, []

    def counted(entries, *args):
        sent.append(entries.count())
        return met(entries, *args)

    monkeypatch.setattr(vectors, "in_whole_groups", counted)
    got = {(r.id, r.other) for r in most_similar(df, "entry_id", "embedding", substrings=substrings).collect()}
    assert sent == [48 * n for n in rounds]
    assert got == brute(x)


def test_bands_are_worked_a_quarter_at_a_time(spark, monkeypatch):
    from textloom.llm import vectors

    rows, _ = families(groups=6)
    df = spark.createDataFrame(rows + BAD, SCHEMA)
    met, sent = vectors.in_whole_groups, []

    def counted(entries, *args):
        sent.append(entries.count())
        return met(entries, *args)

    monkeypatch.setattr(vectors, "in_whole_groups", counted)
    monkeypatch.setattr(vectors, "band_shape", lambda rows: (8, 18))
    got = {(r.cluster_key, r.entry_id) for r in similarity_clusters(df, "entry_id", "embedding").collect()}
    assert len(sent) == 4 and max(sent) <= 5 * 48
    assert got == {(i // 8 * 8, i) for i in range(48)}


def test_bands_keep_their_keys_in_any_round():
    from textloom.llm.vectors import _bands

    bits = np.random.default_rng(0).integers(0, 2, (50, 128)).astype(np.uint8)
    assert (_bands(bits, 5, 0, 9) == np.hstack([_bands(bits, 5, 0, 4), _bands(bits, 5, 4, 9)])).all()


def test_a_forest_links_parts_as_all_pairs_do():
    from textloom.llm.components import _labels
    from textloom.llm.vectors import _forest

    rng = np.random.default_rng(1)
    code = rng.integers(0, 2, (300, 12)).astype(np.uint8)
    far = (code[:, None] != code[None]).sum(2)
    packed = np.frombuffer(np.packbits(np.hstack([code, np.zeros((300, 52), np.uint8)]), axis=1).tobytes(), np.uint64).reshape(-1, 1)
    part = np.sort(rng.integers(0, 80, 300))
    part = np.unique(part, return_inverse=True)[1]
    for most in (0, 1):
        i, j = np.nonzero((far <= most) & (part[:, None] > part[None]))
        true = _labels(300, part[i], part[j])
        a, b = _forest(packed, part, most)
        assert (a > b).all() and (_labels(300, a, b) == true).all()


def test_clusters_are_described_a_slice_at_a_time(spark, monkeypatch):
    from textloom.llm import vectors

    rows, _ = families(groups=40, size=4)
    df = spark.createDataFrame(rows + BAD + rows[:3], SCHEMA)
    made, sent = vectors.in_groups, []

    def counted(entries, *args, **kwargs):
        sent.append(entries.count())
        return made(entries, *args, **kwargs)

    monkeypatch.setattr(vectors, "in_groups", counted)
    got = [(r.cluster_key, r.entry_id) for r in similarity_clusters(df, "entry_id", "embedding").collect()]
    assert len(sent) == 4 and sum(sent) == 160 and max(sent) <= 80
    assert sorted(got) == [(i // 4 * 4, i) for i in range(160)]
