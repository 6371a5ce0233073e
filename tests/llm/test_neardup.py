import random

from textloom.llm.neardup import classes, near_duplicates, pairs, shingles, signatures

SCHEMA = "doc_id bigint, text string, id string, size int"


def corpus(seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for base in range(25):
        text = [rng.choice(words) for _ in range(rng.choice([8, 40, 90, 400]))]
        for edits in (0, 0, 1, 3, 8):
            t = list(text)
            for _ in range(edits):
                t[rng.randrange(len(t))] = rng.choice(words)
            rows.append((len(rows), " ".join(t), "x", 1))
    return rows


def brute(rows, gram=3, least=0.5):
    sets = {i: set(shingles(t, gram).tolist()) for i, t, *_ in rows if t and shingles(t, gram).size}
    return {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])}


def test_pairs_match_brute_force(spark):
    rows = corpus()
    extra = [(900, None, None, None), (901, "", "x", 0), (902, "...", None, 1), (903, "two words", "x", 1), (904, "Two, WORDS!", "x", 1), (None, "w1 w2 w3", None, None)]
    df = spark.createDataFrame(rows + extra + rows[:4], SCHEMA)
    got = {(r.doc_a, r.doc_b) for r in pairs(*near_duplicates(df)).collect()}
    assert got == brute(rows) | {(903, 904)}


def test_classes(spark):
    rows = [(i, "a b c d e f g h i j", "x", 1) for i in range(30)] + [(40, "a b c d e f g h i k", "x", 1), (50, "q r s t u v w", "x", 1)]
    got = {r.doc_id: (r.class_id, r.n_links) for r in classes(*near_duplicates(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert got == {**{i: (0, 1) for i in range(30)}, 40: (0, 1), 50: (50, 0)}


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert pairs(*near_duplicates(df)).count() == 0
    assert classes(*near_duplicates(df)).count() == 0


def test_alike_sets_share_a_signature():
    rng = random.Random(5)
    for size in (20, 100, 300, 2000):
        for _ in range(20):
            text = [f"v{rng.randrange(10**6)}" for _ in range(size)]
            other = [w if rng.random() > 0.05 else f"u{rng.randrange(10**6)}" for w in text]
            a, b = shingles(" ".join(text)), shingles(" ".join(other))
            both = len(set(a.tolist()) & set(b.tolist()))
            if both >= 0.5 * (len(a) + len(b) - both):
                assert set(signatures(a).tolist()) & set(signatures(b).tolist())


def test_very_long_text(spark):
    long = " ".join(f"z{i % 5003}" for i in range(60_000))
    df = spark.createDataFrame([(1, long, "x", 1), (2, long + " tail", "x", 1)], SCHEMA)
    assert [tuple(r) for r in pairs(*near_duplicates(df)).collect()] == [(1, 2)]


def test_a_signature_of_many_sets_is_compared_whole(spark):
    from textloom.llm.neardup import alike

    rng = random.Random(3)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows = []
    for i in range(40):
        text = list(base)
        for _ in range(5):
            text[rng.randrange(120)] = f"u{rng.randrange(10**6)}"
        rows.append((i, " ".join(text), "x", 1))
    sets = spark.createDataFrame([(i, bytearray(shingles(t).tobytes())) for i, t, *_ in rows], "id bigint, features binary")
    assert {(r.a, r.b) for r in alike(sets, 40, block_rows=4).collect()} == brute(rows)


def test_short_sets_near_the_threshold_share_a_signature():
    import numpy as np

    rng = np.random.default_rng(2)
    for size in (12, 20, 36, 45, 60, 80, 99):
        for _ in range(150):
            pool = rng.integers(1, 1 << 63, 2 * size, dtype=np.uint64)
            both = -(-2 * size // 3)  # the least that two sets of this size share at 0.5
            a, b = np.unique(pool[:size]), np.unique(np.r_[pool[:both], pool[size : 2 * size - both]])
            assert set(signatures(a).tolist()) & set(signatures(b).tolist())


def test_pairs_are_the_same_in_small_blocks(spark):
    rows = corpus(4)
    df = spark.createDataFrame([(i, bytearray(shingles(t).tobytes())) for i, t, *_ in rows if i % 5], "id bigint, features binary")
    from textloom.llm.neardup import alike

    made = [{(r.a, r.b) for r in alike(df, 100, block_rows=b).collect()} for b in (2048, 3)]
    assert made[0] == made[1]


def test_all_pairs_that_reach_the_threshold_share_a_signature():
    import numpy as np

    from textloom.llm.neardup import Counts

    rng = np.random.default_rng(3)
    for similarity in (0.5, 0.8):
        for size in (1, 2, 5, 16, 40, 63, 100, 127, 128, 200, 300, 700):
            for other in sorted({size, int(size / similarity), int(size * (1 + similarity) / (2 * similarity))}):
                for _ in range(40):
                    pool = np.unique(rng.integers(1, 1 << 63, 4 * size + 8, dtype=np.uint64))
                    rng.shuffle(pool)
                    both = max(1, -(-round(similarity * (size + other) * 1000) // round(1000 * (1 + similarity))))
                    if both > size:
                        continue
                    a, b = np.sort(pool[:size]), np.sort(np.r_[pool[:both], pool[size : size + other - both]])
                    counts = Counts(pool, rng.choice([1, 2, 40, 500], len(pool)), rng.choice([0.01, 1.0]))
                    assert set(signatures(a, similarity, counts).tolist()) & set(signatures(b, similarity, counts).tolist())


def test_large_sets_that_agree_thinly_share_a_signature():
    import numpy as np

    from textloom.llm.neardup import _mix

    # two agreeing features in each of 43 partitions of five parts, none that agrees beside them: 86 of 170 are shared
    rng = np.random.default_rng(4)
    pool = np.unique(rng.integers(1, 1 << 63, 20_000, dtype=np.uint64))
    place = (_mix(pool + np.uint64(7)) % np.uint64(215)).astype(int)
    at = {p: pool[place == p] for p in range(215)}
    both, used = [], np.zeros(86, int)  # and no more than two in each of the 86 partitions of the next band
    for p in (5 * q + k for q in range(43) for k in (0, 1)):
        larger = (_mix(at[p] + np.uint64(8)) % np.uint64(430)).astype(int) // 5
        both.append(at[p][used[larger].argmin()])
        used[larger[used[larger].argmin()]] += 1
    assert used.max() <= 2
    a = np.unique(np.array(both + [at[5 * q + 2][0] for q in range(42)], np.uint64))
    b = np.unique(np.array(both + [at[5 * q + 3][0] for q in range(42)], np.uint64))
    assert set(signatures(a).tolist()) & set(signatures(b).tolist())


def test_no_pair_that_reaches_the_threshold_fails_a_sketch():
    import numpy as np

    from textloom.llm.neardup import _bits_apart, sketch

    rng = np.random.default_rng(6)
    for size, other in ((3, 6), (100, 200), (300, 300), (900, 1700)):
        pool = np.unique(rng.integers(1, 1 << 63, 2 * other, dtype=np.uint64))
        a, b = pool[:size], pool[size // 4 : size // 4 + other]
        for width in (512, 4096):
            assert _bits_apart(sketch(a, width), sketch(b)) <= len(np.setxor1d(a, b))
