"""Vector operators: learned binary codes, similarity clusters, most similar vectors."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.arrow import in_groups, in_whole_groups, range_tasks
from textloom.llm.components import components, thinned
from textloom.plans.storage import discard, stored

DIM = 128
SAMPLE_ROWS = 10_000  # rows that the rotation is fitted on; every row is coded
ITQ_ROUNDS = 25
COSINE = 0.75


def _floats(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Matrix of the usable rows and their positions.

    Unusable: null, of another length, with null or non-finite parts, all zero.
    """
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(column.offsets.to_numpy())
    valid = np.asarray(column.is_valid()) & (lengths == dim)
    starts = column.offsets.to_numpy()[:-1][valid]
    flat = column.values.to_numpy(zero_copy_only=False).astype(np.float32, copy=False)
    where = np.flatnonzero(valid)
    x = flat[starts[:, None] + np.arange(dim)] if len(where) else np.zeros((0, dim), np.float32)
    good = np.isfinite(x).all(1) & (x != 0).any(1)
    return x[good], where[good]


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def usable(df: DataFrame, id_col: str, vec_col: str, dim: int = DIM) -> DataFrame:
    """(id, vec): rows whose vector can be compared, the stored floats as bytes.

    Repeated rows count once only where the caller makes ids distinct; null ids are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, where = _floats(batch.column(1), dim)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(where)), pa.array([r.tobytes() for r in x], pa.binary())], ["id", "vec"]
            )

    source = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<float>").alias("v"))
    return source.where("id is not null and v is not null").mapInArrow(run, "id bigint, vec binary")


def matrix(column: pa.ChunkedArray | pa.Array, dim: int = DIM) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.zeros((0, dim), np.float32)
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, dim)


class Rotation:
    """PCA to ``bits`` directions, then the rotation that moves projections towards sign corners."""

    def __init__(self, mean: np.ndarray, axes: np.ndarray):
        self.mean, self.axes = mean, axes

    @classmethod
    def fit(cls, sample: np.ndarray, bits: int, rounds: int = ITQ_ROUNDS, seed: int = 7) -> Rotation:
        dim = sample.shape[1] if len(sample) else DIM
        if len(sample) < 2:
            return cls(np.zeros(dim), np.random.default_rng(seed).normal(size=(dim, bits)))
        mean = sample.mean(0)
        _, vectors = np.linalg.eigh(np.cov((sample - mean).T))
        vectors = vectors[:, ::-1][:, :bits]
        if vectors.shape[1] < bits:
            extra = np.random.default_rng(seed).normal(size=(dim, bits - vectors.shape[1])) / math.sqrt(dim)
            return cls(mean, np.hstack([vectors, extra]))
        z = (sample - mean) @ vectors
        turn = np.linalg.qr(np.random.default_rng(seed).normal(size=(bits, bits)))[0]
        for _ in range(rounds):
            u, _, vt = np.linalg.svd(np.where(z @ turn > 0, 1.0, -1.0).T @ z)
            turn = (u @ vt).T
        return cls(mean, vectors @ turn)

    def part(self, start: int, end: int) -> Rotation:
        """The directions from ``start`` to before ``end`` alone."""
        return Rotation(self.mean, self.axes[:, start:end])

    def project(self, x: np.ndarray) -> np.ndarray:
        return (unit(x) - self.mean) @ self.axes if len(x) else np.zeros((0, self.axes.shape[1]))


def fitted(df: DataFrame, bits: int, rows: int, sample_rows: int = SAMPLE_ROWS) -> Rotation:
    """Fit on a bounded sample of rows chosen by the hash of their ids."""
    share = min(1.0, sample_rows / max(1, rows))
    picked = df.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(share * 1_000_000))
    x = matrix(picked.orderBy("id").select("vec").limit(2 * sample_rows).toArrow().column(0))
    return Rotation.fit(unit(x) if len(x) else x.astype(np.float64), bits)


# ------------------------------------------------------------------ problem 4


def substring_bits(rows: int, per_bucket: int = 2000) -> int:
    """Length of a code substring: buckets keep their size as the collection grows."""
    return max(3, min(40, round(math.log2(max(2, rows / per_bucket)))))


def substring_count(bits: int, missed: float = 0.02) -> int:
    """Substrings of ``bits`` bits, so many that near rows agree on none of them at a rate of ``missed`` only, however long
    they are; each bit of a near row is taken to agree at a rate of 0.925, as measured with 9 to 14 bits."""
    return max(3, math.ceil(math.log(missed) / math.log(1 - 0.925**bits)))


def _best(x: np.ndarray, ids: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Exact (a, b, cosine) of the k best others of each row within one block."""
    if len(ids) < 2:
        return ids[:0], ids[:0], np.zeros(0)
    u = unit(x)
    low = u.astype(np.float32)
    out_a, out_b, out_c = [], [], []
    for s in range(0, len(ids), 512):
        sims = low[s : s + 512] @ low.T
        sims[np.arange(len(sims)), np.arange(s, s + len(sims))] = -2
        near = sims >= least - 1e-4
        if near.sum() > 64 * len(sims):
            # among many near ones the k best are picked by the exact values, ties by the order of ids
            c = np.round(u[s : s + 512] @ u.T, 6)
            c[np.arange(len(c)), np.arange(s, s + len(c))] = -2
            kth = np.partition(c, max(0, len(ids) - k), axis=1)[:, max(0, len(ids) - k), None]
            more, tie = c > kth, c == kth
            keep = (more | (tie & (tie.cumsum(1, dtype=np.int32) <= k - more.sum(1, keepdims=True)))) & (c >= least)
            i, j = np.nonzero(keep)
            out_a.append(ids[i + s])
            out_b.append(ids[j])
            out_c.append(c[i, j])
            continue
        i, j = np.nonzero(near)
        if not len(i):
            continue
        order = np.lexsort((-sims[i, j], i))
        i, j = i[order], j[order]
        first = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
        rank = np.arange(len(i)) - np.repeat(first, np.diff(np.r_[first, len(i)]))
        # rounding to 6 places can tie values that differ in single precision: keep all near the k-th
        sim = sims[i, j]
        kth = np.repeat(sim[np.minimum(first + k - 1, np.r_[first[1:], len(i)] - 1)], np.diff(np.r_[first, len(i)]))
        keep = (rank < k) | (sim >= kth - 4e-6)
        i, j = i[keep], j[keep]
        c = np.round((u[i + s] * u[j]).sum(1), 6)
        a, b = ids[i + s], ids[j]
        order = np.lexsort((b, -c, a))
        a, b, c = a[order], b[order], c[order]
        first = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
        rank = np.arange(len(a)) - np.repeat(first, np.diff(np.r_[first, len(a)]))
        keep = (rank < k) & (c >= least)
        out_a.append(a[keep])
        out_b.append(b[keep])
        out_c.append(c[keep])
    if not out_a:
        return ids[:0], ids[:0], np.zeros(0)
    return np.concatenate(out_a), np.concatenate(out_b), np.concatenate(out_c)


def most_similar(
    df: DataFrame,
    id_col: str,
    vec_col: str,
    k: int = 5,
    least: float = COSINE,
    substrings: int | None = None,
    dim: int = DIM,
    block_rows: int = 12_288,
) -> DataFrame:
    """(id, other, cosine): the ``k`` most similar others of every usable vector, by multi-index hashing.

    A PCA rotation refined towards sign corners gives each vector a code of ``substrings``
    substrings; each substring is an index. Rows that agree on a substring meet, so every code
    within a Hamming radius of ``substrings - 1`` is retrieved (pigeonhole), and the floats
    of all that meet are compared in double precision, those of a bucket longer than ``block_rows``
    in blocks of which every two meet. The longer the substrings of a large table, the more there are, so the share of
    neighbours that agree on none does not grow. Substrings are worked a quarter at a time (at least one) and the best
    rows so far are kept, so the vectors of all are never on disk at once. Copies of one vector beyond the k + 1 smallest
    ids are answered from those, so a vector held by a third of the rows costs no more than one.

    Nulls, wrong lengths, zero or non-finite vectors: no row. Ties: the smaller id. Repeated
    rows of an id: counted once. Empty table: no rows.
    """
    rows = df.count()
    bits = substring_bits(rows)
    substrings = substrings or substring_count(bits)
    vecs = usable(df, id_col, vec_col, dim)
    rotation = fitted(vecs, bits * substrings, rows)
    m, weights = substrings, 1 << np.arange(bits, dtype=np.int64)

    # copies beyond the k + 1 smallest ids of one vector
    heavy = vecs.select(F.xxhash64("vec").alias("h")).groupBy("h").count().where(F.col("count") > k + 1).select("h")
    vh = vecs.withColumn("h", F.xxhash64("vec"))
    ranked = (
        vh.select("id", "h")
        .join(heavy, "h")
        .dropDuplicates(["h", "id"])
        .withColumn("r", F.expr("row_number() over (partition by h order by id)"))
    )
    spare = stored(ranked.where(F.col("r") > k + 1).select("id", "h"))
    has_spare = not spare.isEmpty()
    live = vecs.join(spare.select("id"), "id", "left_anti") if has_spare else vecs

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bit = (rotation.project(matrix(batch.column(1), dim)) > 0).astype(np.int64)
            code = bit.reshape(len(bit), m, bits) @ weights
            yield pa.RecordBatch.from_arrays([pa.array((code * m + np.arange(m)).ravel())], ["key"])

    def emitted(start: int, end: int) -> DataFrame:
        part = rotation.part(start * bits, end * bits)

        def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bit = (part.project(matrix(batch.column(1), dim)) > 0).astype(np.int64)
                code = bit.reshape(len(bit), end - start, bits) @ weights
                for j in range(start, end):
                    yield pa.RecordBatch.from_arrays([pa.array(code[:, j - start] * m + j), batch.column(0), batch.column(1)], ["key", "id", "vec"])

        return live.mapInArrow(emit, "key bigint, id bigint, vec binary")

    out = pa.schema([("id", pa.int64()), ("other", pa.int64()), ("cosine", pa.float64())])

    def best(t: pa.Table) -> pa.RecordBatch | None:
        ids = t.column("id").to_numpy()
        if len(ids) < 2:
            return None
        ids, first = np.unique(ids, return_index=True)
        a, b, c = _best(matrix(t.column("vec"), dim)[first], ids, k + has_spare, least)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(c)], schema=out)

    counts = stored(live.mapInArrow(keys, "key bigint").groupBy("key").count())
    lists, together = None, max(1, m // 4)
    for start in range(0, m, together):
        end = min(m, start + together)
        own = counts.where(F.pmod("key", F.lit(m)).between(start, end - 1))
        tasks = range_tasks(df, rows * (end - start), 5_000)
        met = in_whole_groups(emitted(start, end), own, "key", "id", tasks, "id bigint, other bigint, cosine double", best, block_rows)
        pairs = met.select("id", (-F.col("cosine")).alias("d"), "other")
        if lists is not None:
            pairs = pairs.union(lists.select("id", F.explode("o").alias("p")).select("id", "p.d", "p.other"))
        top = pairs.groupBy("id").agg(F.array_sort(F.collect_set(F.struct("d", "other"))).alias("o"))
        so_far, lists = lists, stored(top.select("id", F.slice("o", 1, k + int(has_spare)).alias("o")))
        if so_far is not None:
            discard(so_far)
    top = lists
    if has_spare:
        # a spare copy takes over the list of a smaller copy, which itself then counts with cosine 1
        owner = stored(ranked.where("r = 1").select(F.col("id").alias("owner"), "h"))
        copied = (
            spare.join(owner, "h")
            .join(lists.withColumnRenamed("id", "owner"), "owner", "left")
            .select(
                "id",
                F.array_sort(
                    F.array_union(
                        F.coalesce("o", F.expr("array()").cast("array<struct<d:double,other:bigint>>")),
                        F.array(F.struct(F.lit(-1.0).alias("d"), F.col("owner").alias("other"))),
                    )
                ).alias("o"),
            )
        )
        top = lists.unionByName(copied).withColumn("o", F.slice("o", 1, k))
    return top.select("id", F.explode("o").alias("p")).select("id", F.col("p.other").alias("other"), (-F.col("p.d")).alias("cosine"))


# ------------------------------------------------------------------ problem 3

CODE_BITS = 128
SLICES = 4  # of the vectors, by id and then by component, of which one is shuffled at a time
JACCARD = 0.62  # of the sets {(i, bit i)}: at most 30 of 128 bits differ


def band_shape(rows: int) -> tuple[int, int]:
    """Rows of a band and number of bands: longer bands as the collection grows, bands enough
    that a pair of Jaccard 0.75 meets with probability 0.98."""
    r = max(4, round(math.log(max(2, rows / 400)) / math.log(2.7)))
    return r, math.ceil(math.log(0.02) / math.log(1 - 0.75**r))


def _bands(bits: np.ndarray, r: int, start: int, end: int, seed: int = 11) -> np.ndarray:
    """MinHash keys of the bands from ``start`` to before ``end`` of the sets {(i, bit i)}."""
    rng = np.random.default_rng(seed)
    width = bits.shape[1]
    keys = np.zeros((len(bits), end - start), np.uint64)
    for _ in range(start * r):
        rng.permutation(2 * width)  # those of the bands before
    for band in range(start, end):
        key = np.full(len(bits), band + 1, np.uint64)
        for _ in range(r):
            # hash values as a permutation of the 2 * width elements; the least present one counts
            order = rng.permutation(2 * width)
            index, value = order // 2, order % 2
            present = bits[:, index[:24]] == value[:24]
            first = present.argmax(1)
            for i in np.flatnonzero(~present.any(1)):
                first[i] = (bits[i, index] == value).argmax()
            key = (key * np.uint64(0x9E3779B97F4A7C15)) ^ order[first].astype(np.uint64)
            key ^= key >> np.uint64(29)
        keys[:, band - start] = key
    return keys


def _forest(code: np.ndarray, part: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of parts of a block that connect whatever all its verified pairs connect; ``part`` has the part of each row, ascending from 0."""
    n = len(code)
    i, j = [], []
    for s in range(0, n, 256):
        far = np.zeros((min(256, n - s), n), np.uint8)
        for w in range(code.shape[1]):
            far += np.bitwise_count(code[s : s + 256, w, None] ^ code[None, :, w])
        p, q = np.nonzero(far <= most)
        keep = part[p + s] > part[q]
        i.append(part[p[keep] + s])
        j.append(part[q[keep]])
    return thinned(n, np.concatenate(i), np.concatenate(j))


def candidate_links(vecs: DataFrame, rows: int, jaccard: float = JACCARD, dim: int = DIM, block_rows: int = 4096) -> DataFrame:
    """(a, b) links that connect what the pairs of a band bucket connect whose bit sets reach ``jaccard``.

    Vectors of one code, such as copies, hang on the smallest id of them, which alone is banded. Bands are worked a quarter
    at a time; what is connected by then counts as one part, of which no pair is looked for or linked again.
    """
    rotation = fitted(vecs, CODE_BITS, rows)
    r, n = band_shape(rows)
    # |A| = |B| = bits, h bits differ: J = (bits - h) / (bits + h)
    most = int(CODE_BITS * (1 - jaccard) / (1 + jaccard))

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = (rotation.project(matrix(batch.column(1), dim)) > 0).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([row.tobytes() for row in np.packbits(bits, axis=1)], pa.binary())], ["id", "code"])

    codes = stored(vecs.mapInArrow(coded, "id bigint, code binary"))
    one = stored(codes.groupBy("code").agg(F.min("id").alias("id"), F.max("id").alias("last")))
    shared = one.where("id < last").select("code", F.col("id").alias("b"))
    same = codes.join(shared, "code").where("id <> b").select(F.col("id").alias("a"), "b").distinct()

    def emitted(start: int, end: int) -> DataFrame:
        def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                packed = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
                keys = _bands(np.unpackbits(packed, axis=1), r, start, end).view(np.int64)
                for band in range(end - start):
                    yield pa.RecordBatch.from_arrays([pa.array(keys[:, band]), batch.column(1), batch.column(0)], ["key", "code", "part"])

        return placed.select("part", "code").mapInArrow(emit, "key bigint, code binary, part bigint")

    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def link(t: pa.Table) -> pa.RecordBatch | None:
        parts, part = np.unique(t.column("part").to_numpy(), return_inverse=True)
        if len(parts) < 2:
            return None
        code = np.frombuffer(b"".join(t.column("code").to_pylist()), np.uint64).reshape(len(part), -1)
        order = np.argsort(part, kind="stable")
        i, j = _forest(code[order], part[order], most)
        return pa.RecordBatch.from_arrays([pa.array(parts[i]), pa.array(parts[j])], schema=out)

    placed, together = stored(one.select("code", "id", F.col("id").alias("part"))), -(-n // 4)
    for start in range(0, n, together):
        entries = emitted(start, min(n, start + together))
        counts = entries.groupBy("key").count()
        tasks = range_tasks(vecs, rows * together, 100_000)
        links = stored(in_whole_groups(entries, counts, "key", "code", tasks, "a bigint, b bigint", link, block_rows).distinct())
        joined = components(links)
        hung = placed.join(joined.withColumnRenamed("id", "part"), "part", "left")
        before, placed = placed, stored(hung.select("code", "id", F.coalesce("component", "part").alias("part")))
        for done in (before, links, joined):
            discard(done)
    return placed.where("id <> part").select(F.col("id").alias("a"), F.col("part").alias("b")).union(same)


def _exact_parts(x: np.ndarray, least: float, block: int = 512) -> np.ndarray:
    """Single-linkage labels at ``least`` cosine, by blocks of rows that are still apart."""
    n = len(x)
    u = unit(x)
    low = u.astype(np.float32)
    label = np.full(n, -1)
    part = 0
    while (left := np.flatnonzero(label < 0)).size:
        label[left[0]] = part
        front = left[:1]
        left = left[1:]
        while front.size and left.size:
            near = np.zeros(len(left), bool)
            for s in range(0, len(front), block):
                sims = low[front[s : s + block]] @ low[left].T
                best = sims.max(0)
                near |= best >= least + 1e-5
                for j in np.flatnonzero((best < least + 1e-5) & (best >= least - 1e-5) & ~near):
                    near[j] = np.round(u[front[s : s + block]] @ u[left[j]], 6).max() >= least
            front = left[near]
            label[front] = part
            left = left[~near]
        part += 1
    return label


def _within(x: np.ndarray, y: np.ndarray, least: float) -> np.ndarray:
    """How many rows of ``y`` each row of ``x`` reaches."""
    out = np.zeros(len(x), int)
    for s in range(0, len(x), 512):
        out[s : s + 512] = (x[s : s + 512] @ y.T >= least).sum(1)
    return out


def _around_medoids(u: np.ndarray, label: np.ndarray, least: float) -> np.ndarray:
    """Labels after each part is split around its members of highest degree."""
    out, made = np.empty(len(u), int), 0
    low = u.astype(np.float32)
    order = np.argsort(label, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(label[order])) + 1):
        left = rows
        degree = _within(low[left], low[left], least)
        while left.size:
            top = left[degree.argmax()]
            near = np.round(u[left] @ u[top], 6) >= least
            near[left == top] = True
            out[left[near]] = made
            made += 1
            degree = degree[~near] - _within(low[left[~near]], low[left[near]], least)
            left = left[~near]
    return out


def _exact_links(members: DataFrame, least: float, dim: int, block_rows: int) -> DataFrame:
    """(a, b) links that connect, within each key of ``members`` (id, vec, key), what cosines of ``least`` connect."""
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def link(t: pa.Table) -> pa.RecordBatch | None:
        ids = t.column("id").to_numpy()
        if len(ids) < 2:
            return None
        _, first, label = np.unique(_exact_parts(matrix(t.column("vec"), dim), least), return_index=True, return_inverse=True)
        a, b = ids, ids[first][label]
        return pa.RecordBatch.from_arrays([pa.array(a[a != b]), pa.array(b[a != b])], schema=out)

    counts = members.groupBy("key").count()
    return in_whole_groups(members, counts, "key", "id", range_tasks(members, 12), "a bigint, b bigint", link, block_rows)


def similarity_clusters(
    df: DataFrame, id_col: str, vec_col: str, least: float = COSINE, dim: int = DIM, block_rows: int = 16_384, split: bool = False
) -> DataFrame:
    """(cluster_key, entry_id, size, typical_rank, closeness): groups of vectors connected at ``least``.

    Bit sets of learned codes are banded by MinHash, candidates are verified by exact Jaccard and
    joined into loose components; each loose component is then parted by single linkage at the exact
    cosine. With ``split`` a part whose members are not all within ``least`` of its medoid is split
    further: the member with most others within ``least`` (ties: smaller id) takes these as its
    cluster, then the next among the rest. cluster_key is the smallest id.
    ``closeness`` is the mean cosine to the cluster's centre, by which the most typical members
    are ranked (ties: smaller id).

    Unusable vectors and entries alone: no row. A loose component beyond ``block_rows`` is parted by single
    linkage within every two of its blocks, and the parts are joined; a cluster that large is described in one
    call, whose memory grows by about 2 KB a member.
    """
    rows = df.count()
    vecs = usable(df, id_col, vec_col, dim)
    loose = components(stored(candidate_links(vecs, rows, dim=dim)))
    giant = stored(loose.groupBy("component").count().where(F.col("count") > block_rows).select("component"))
    loose = loose.select("id", "component", F.lit(False).alias("linked"))
    if not giant.isEmpty():
        loose = stored(loose)
        inside = vecs.join(loose.join(giant, "component", "left_semi").select("id", F.col("component").alias("key")), "id")
        exact = components(stored(_exact_links(inside.select("id", "vec", "key"), least, dim, block_rows)))
        loose = stored(loose.join(giant, "component", "left_anti").select("id", "component", "linked").union(exact.select("id", "component", F.lit(True))))
    loose = stored(loose)

    def in_slice(s: int, column: Column) -> Column:
        return F.pmod(F.xxhash64(column, F.lit(3)), F.lit(SLICES)) == s

    held = []
    for s in range(SLICES):
        some = usable(df.where(in_slice(s, F.col(id_col).cast("bigint"))), id_col, vec_col, dim)
        joined = some.join(loose.where(in_slice(s, F.col("id"))), "id").withColumnRenamed("component", "key")
        held.append(stored(joined.dropDuplicates(["id"])))
    placed = reduce(DataFrame.union, held)
    out = pa.schema(
        [("cluster_key", pa.int64()), ("entry_id", pa.int64()), ("size", pa.int64()), ("typical_rank", pa.int64()), ("closeness", pa.float64())]
    )

    def part(t: pa.Table) -> pa.RecordBatch | None:
        ids = t.column("id").to_numpy()
        if len(ids) < 2:
            return None
        order = np.argsort(ids)
        ids, x = ids[order], matrix(t.column("vec"), dim)[order]
        label = np.zeros(len(ids), int) if t.column("linked")[0].as_py() else _exact_parts(x, least)
        u = unit(x)
        if split:
            label = _around_medoids(u, label, least)
        made: dict[str, list] = {f.name: [] for f in out}
        order = np.argsort(label, kind="stable")
        for rows_ in np.split(order, np.flatnonzero(np.diff(label[order])) + 1):
            if len(rows_) < 2:
                continue
            mean = u[rows_].mean(0)
            close = np.round(u[rows_] @ (mean / max(np.linalg.norm(mean), 1e-12)), 6)
            rank = np.empty(len(rows_), int)
            rank[np.lexsort((ids[rows_], -close))] = np.arange(1, len(rows_) + 1)
            made["cluster_key"].append(np.full(len(rows_), ids[rows_].min()))
            made["entry_id"].append(ids[rows_])
            made["size"].append(np.full(len(rows_), len(rows_)))
            made["typical_rank"].append(rank)
            made["closeness"].append(close)
        if not made["size"]:
            return None
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(made[f.name]), f.type) for f in out], schema=out)

    made = [
        stored(in_groups(
            placed.where(in_slice(s, F.col("key"))), "key", ["id"], range_tasks(df, rows // SLICES, 15_000),
            "cluster_key bigint, entry_id bigint, size bigint, typical_rank bigint, closeness double", part, 1 << 40, whole=True,
        ))
        for s in range(SLICES)
    ]
    for done in held:
        discard(done)
    return reduce(DataFrame.union, made)
