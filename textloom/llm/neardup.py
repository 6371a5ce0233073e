"""Near-duplicate documents by signatures of the rarest features of their sets of consecutive words."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.arrow import in_whole_groups, range_tasks
from textloom.llm.components import components
from textloom.llm.text import words
from textloom.plans.storage import stored

GRAM = 3
SIMILARITY = 0.5
SAMPLE_SETS, SAMPLE_FEATURES = 20_000, 1_000_000  # sets that frequencies are counted on, and features whose counts are kept, at most about
RARE = 30  # sets that a feature may be in, as far as the sample tells, to be a signature by itself
SKETCH = 512  # bits carried with a signature
CHUNK = 300_000  # features whose signatures are made at once
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str, gram: int = GRAM) -> np.ndarray:
    """Sorted 64-bit hashes of the text's runs of ``gram`` words; a shorter text is one run."""
    tokens = words(text)
    if not tokens:
        return np.zeros(0, np.uint64)
    coded = np.fromiter((hash_word(w) for w in tokens), np.uint64, len(tokens))
    n = max(1, len(coded) - gram + 1)
    h = np.zeros(n, np.uint64)
    for k in range(min(gram, len(coded))):
        h = _mix(h * _MIX + coded[k : k + n])
    return np.unique(h)


@lru_cache(maxsize=200_000)
def hash_word(word: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(word)


def band(size: int, similarity: float = SIMILARITY) -> int:
    """Number of the size band: bands [l, r] with r = l / similarity, so that sets alike enough
    lie in one band or in neighbouring ones."""
    return int(np.floor(np.log(max(1, size)) / np.log(1 / similarity) + 1e-12))


def start(b: int, similarity: float = SIMILARITY) -> int:
    """The least size in band ``b``."""
    return int(np.ceil((1 / similarity) ** b - 1e-9))


class Counts:
    """Counts of features in a sample of ``share`` of the sets; a feature that is not listed has the count 1."""

    def __init__(self, features: np.ndarray, counts: np.ndarray, share: float = 1.0):
        order = np.argsort(features)
        self.features, self.counts, self.share = features[order], counts[order], share

    def of(self, features: np.ndarray) -> np.ndarray:
        if not len(self.features):
            return np.ones(len(features), np.int64)
        at = np.minimum(np.searchsorted(self.features, features), len(self.features) - 1)
        return np.where(self.features[at] == features, self.counts[at], 1)


NO_COUNTS = Counts(np.zeros(0, np.uint64), np.zeros(0, np.int64))


def least_shared(a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
    """Features that sets of ``a`` and ``b`` features share at least at ``similarity``."""
    return np.maximum(1, np.ceil(similarity / (1 + similarity) * (a + b) - 1e-9)).astype(np.int64)


def signatures_of(sets: list[np.ndarray], similarity: float = SIMILARITY, counts: Counts = NO_COUNTS) -> tuple[np.ndarray, np.ndarray]:
    """(keys, position of the set): signatures of sets of distinct features for their own size bands and the next larger ones.

    Any two sets of Jaccard >= s share a signature, whatever ``counts`` says. The larger one be in band b. All features are in
    one order, rarest first. A set of n features that shares at least o of them with any partner in question has n - o
    others at most. A feature counted rare is a signature; the others fall into g classes by hash, and two of a class are a
    signature. If two sets share none, then of a prefix of the order they share at most one feature in each class, so
    of the prefix of the set whose prefix ends first all rare features and all but one of each class are unshared. A prefix
    ends as soon as these are n - o + 1, more than can be. g < o depends on b only, so every set has such a prefix.
    """
    sizes = np.array([len(f) for f in sets], np.int64)
    if not sizes.sum():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    features, of = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    count = counts.of(features)
    order = np.lexsort((features, count, of))
    features, count = features[order], count[order]
    first = np.repeat(np.cumsum(sizes) - sizes, sizes)
    common, hashed = count > RARE * counts.share, _mix(features)
    own = np.array([band(n, similarity) for n in sizes.tolist()])
    begin = np.array([start(b, similarity) for b in range(own.max() + 2)])
    keys, where = [], []
    for larger in (0, 1):
        b = own + larger
        partner = begin[b] if larger else np.ceil(similarity * sizes - 1e-9).astype(np.int64)
        need = np.where(sizes / similarity + 1e-9 >= partner, sizes - least_shared(sizes, partner, similarity) + 1, 0)[of]
        classes = np.maximum(0, np.ceil(similarity * begin[b] - 1e-9).astype(np.int64) - 1)[of]
        paired = np.flatnonzero(common & (classes > 0))
        group = of[paired] * (classes.max() + 1) + (hashed[paired] % classes[paired].astype(np.uint64)).astype(np.int64)
        by_group = np.argsort(group, kind="stable")
        paired, group = paired[by_group], group[by_group]
        told = np.ones(len(features), np.int64)
        told[paired[np.r_[True, group[1:] != group[:-1]][: len(group)]]] = 0
        before = np.cumsum(told) - told
        inside = before - before[first] < need
        salt = ((b + 1).astype(np.uint64) << np.uint64(56))[of]
        single = inside.copy()
        single[paired] = False
        keys.append(_mix(hashed[single] ^ salt[single]))
        where.append(of[single])
        kept = inside[paired]
        paired, group, apart = paired[kept], group[kept], 1
        while (same := np.flatnonzero(group[apart:] == group[:-apart])).size:
            i, j = paired[same], paired[same + apart]
            keys.append(_mix((hashed[i] + hashed[j]) * _MIX ^ salt[i]))
            where.append(of[i])
            apart += 1
    return np.concatenate(keys), np.concatenate(where)


def signatures(features: np.ndarray, similarity: float = SIMILARITY, counts: Counts = NO_COUNTS) -> np.ndarray:
    """Signatures of one set."""
    return np.unique(signatures_of([features], similarity, counts)[0])


def sketch(features: np.ndarray, width: int = SKETCH) -> bytes:
    """Parities of the features in ``width`` classes: two sketches differ in no more bits than the sets do in features."""
    odd = np.bincount((_mix(features ^ _MIX) % np.uint64(width)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _bits_apart(x: bytes, y: bytes) -> int:
    """Bits that two sketches differ in, the wider one folded to the other's width, a power of two."""
    if len(x) < len(y):
        x, y = y, x
    wide, narrow, width = int.from_bytes(x, "little"), int.from_bytes(y, "little"), 8 * len(x)
    while width > 8 * len(y):
        width //= 2
        wide = (wide >> width) ^ (wide & ((1 << width) - 1))
    return (wide ^ narrow).bit_count()


def counted(sets: DataFrame, rows: int) -> Counts:
    """Counts of the features of a bounded sample of ``sets`` (id, features)."""
    share = min(1.0, SAMPLE_SETS / max(1, rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f, n = np.unique(np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(f.view(np.int64)), pa.array(n.astype(np.int64))], ["f", "n"])

    some = sets.where(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1_000_000)) < int(1_000_000 * share)).select("features")
    total = some.mapInArrow(run, "f bigint, n bigint").groupBy("f").agg(F.sum("n").alias("n")).where("n > 1")
    made = total.orderBy(F.desc("n"), "f").limit(SAMPLE_FEATURES).toArrow()
    return Counts(made.column("f").to_numpy().view(np.uint64), made.column("n").to_numpy(), share)


def texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", gram: int = GRAM) -> DataFrame:
    """(id, set_id, size, features): set_id is the same exactly for documents with the same set."""
    schema = "id bigint, h1 bigint, h2 bigint, size int, features binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            for i, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                f = shingles(body, gram)
                if len(f):
                    rows[0].append(i)
                    rows[1].append(int(_mix(f).sum(dtype=np.uint64).view(np.int64)))
                    rows[2].append(int(np.bitwise_xor.reduce(_mix(f * _MIX)).view(np.int64)))
                    rows[3].append(len(f))
                    rows[4].append(f.tobytes())
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds)], ["id", "h1", "h2", "size", "features"])

    source = docs.select(F.col(doc_id).cast("bigint").alias("id"), F.col(text).alias("text"))
    return source.where("id is not null and text is not null").mapInArrow(run, schema)


def alike(sets: DataFrame, rows: int, similarity: float = SIMILARITY, block_rows: int = 2048) -> DataFrame:
    """(a, b, similarity), a < b: pairs of different sets that reach ``similarity``.

    sets: (id, features), ids unique. Sets that share a signature are compared by their sizes and
    sketches where they meet, which no pair alike enough fails; the pairs left are verified on the whole sets. All sets of
    a signature meet, those of one that more than ``block_rows`` share in blocks.
    """
    shared = sets.sparkSession.sparkContext.broadcast(counted(sets, rows))

    def signed(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]:
        """(signatures, rows in ``column``, sets) of some rows after the others."""
        held, size, done = [], 0, 0
        for k, raw in enumerate(column.to_pylist()):
            held.append(np.frombuffer(raw, np.uint64))
            size += len(held[-1])
            if size >= CHUNK or k == len(column) - 1:
                keys, at = signatures_of(held, similarity, shared.value)
                yield keys.view(np.int64), at + done, held
                held, size, done = [], 0, k + 1

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for keys, at, some in signed(batch.column(1)):
                sizes, sketches = np.array([len(f) for f in some], np.int32), pa.array([sketch(f) for f in some], pa.binary())
                for s in range(0, len(keys), 50_000):
                    part = at[s : s + 50_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys[s : s + 50_000]), batch.column(0).take(pa.array(part)), pa.array(sizes[part - done]), sketches.take(pa.array(part - done))],
                        ["key", "id", "size", "sketch"],
                    )
                done += len(some)

    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def columns(t: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        words_ = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint64)
        return t.column("id").to_numpy(), t.column("size").to_numpy(), words_.reshape(t.num_rows, SKETCH // 64)

    def pairs_of(ids: np.ndarray, size: np.ndarray, sk: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        fit = (ids[i] != ids[j]) & (np.minimum(size[i], size[j]) >= similarity * np.maximum(size[i], size[j]) - 1e-9)
        i, j = i[fit], j[fit]
        differ = size[i] + size[j] - 2 * least_shared(size[i], size[j], similarity)
        near = np.bitwise_count(sk[i] ^ sk[j]).sum(-1, dtype=np.int32) <= differ
        return np.minimum(ids[i[near]], ids[j[near]]), np.maximum(ids[i[near]], ids[j[near]])

    def meet(t: pa.Table) -> pa.RecordBatch | None:
        n = t.num_rows
        if n < 2:
            return None
        ids, size, sk = columns(t)
        order = np.argsort(size, kind="stable")
        ids, size, sk = ids[order], size[order], sk[order]
        found = []
        for s in range(0, n, 128):
            # rows in order of size: whoever is too large for the largest of the block is left out
            stop = np.searchsorted(size, size[min(n, s + 128) - 1] / similarity + 1e-9, "right")
            i, j = np.nonzero(np.arange(s, min(n, s + 128))[:, None] < np.arange(s, stop)[None])
            found.append(pairs_of(ids, size, sk, i + s, j + s))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[k] for f in found])) for k in (0, 1)], schema=out)

    def meet_few(batch: pa.RecordBatch, starts: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch:
        ids, size, sk = columns(batch)
        found = []
        for k in np.unique(sizes):
            i, j = np.triu_indices(k, 1)
            first = starts[sizes == k][:, None]
            found.append(pairs_of(ids, size, sk, (first + i).ravel(), (first + j).ravel()))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[k] for f in found])) for k in (0, 1)], schema=out)

    entries = sets.select("id", "features").mapInArrow(emit, "key bigint, id bigint, size int, sketch binary")

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, _, _ in signed(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(keys)], ["key"])

    counts = sets.select("features").mapInArrow(name, "key bigint").groupBy("key").count()
    met = in_whole_groups(entries, counts, "key", "id", range_tasks(sets, rows * 130, 1_500_000), "a bigint, b bigint", meet, block_rows, meet_few)

    # a sketch carried with signatures says little of large sets: these are then compared by one as wide as they need
    def widen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.frombuffer(raw, np.uint64) for raw in batch.column(1).to_pylist()]
            wide = [sketch(f, 1 << max(9, int(2 * len(f) / similarity).bit_length())) for f in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(f) for f in found], pa.int32()), pa.array(wide, pa.binary())], ["id", "n", "wide"])

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = [batch.column(k).to_numpy() for k in (2, 4)]
            differ = size[0] + size[1] - 2 * least_shared(size[0], size[1], similarity)
            apart = [_bits_apart(x, y) for x, y in zip(batch.column(3).to_pylist(), batch.column(5).to_pylist())]
            keep = pa.array(np.array(apart, np.int64) <= differ)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    wide = stored(sets.select("id", "features").mapInArrow(widen, "id bigint, n int, wide binary"))
    left = met.distinct().join(wide.toDF("a", "n_a", "wide_a"), "a").join(wide.toDF("b", "n_b", "wide_b"), "b")
    pairs = left.select("a", "b", "n_a", "wide_a", "n_b", "wide_b").mapInArrow(screen, "a bigint, b bigint")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                f, g = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(f, g, assume_unique=True))
                value.append(both / (len(f) + len(g) - both))
            keep = pa.array([v >= similarity for v in value], pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).filter(keep), batch.column(1).filter(keep), pa.array(np.round(value, 6), pa.float64()).filter(keep)], ["a", "b", "similarity"]
            )

    left = pairs.join(sets.select(F.col("id").alias("a"), F.col("features").alias("fa")), "a")
    both = left.join(sets.select(F.col("id").alias("b"), F.col("features").alias("fb")), "b")
    return both.select("a", "b", "fa", "fb").mapInArrow(verify, "a bigint, b bigint, similarity double")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", gram: int = GRAM, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(members, links): (id, representative) for every document, and (a, b, similarity) between representatives.

    Documents with the same set, such as copies, share the smallest id as representative and are
    compared once, so copies held by a third of the rows cost no more than one. Null texts and texts
    without words belong to no class. Repeated rows of an id count once; an id with several texts
    is in the class of each. Texts are read whole.
    """
    sets = stored(texts(docs, doc_id, text, gram))
    first = sets.groupBy("h1", "h2", "size").agg(F.min("id").alias("representative"))
    members = sets.select("id", "h1", "h2", "size").join(first, ["h1", "h2", "size"]).select("id", "representative").distinct()
    chosen = sets.join(first.select("h1", "h2", "size", F.col("representative").alias("id")), ["h1", "h2", "size", "id"], "left_semi")
    chosen = stored(chosen.select("id", "features").dropDuplicates(["id"]))
    members = stored(members)
    return members, stored(alike(chosen, docs.count(), similarity))


def pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """(doc_a, doc_b), doc_a < doc_b: all pairs of documents, copies included."""
    m = members.select("id", "representative")
    within = m.alias("x").join(m.alias("y"), F.col("x.representative") == F.col("y.representative")).where("x.id < y.id")
    left = links.join(m.select(F.col("id").alias("x"), F.col("representative").alias("a")), "a")
    across = left.join(m.select(F.col("id").alias("y"), F.col("representative").alias("b")), "b")
    across = across.select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b")).where("doc_a <> doc_b")
    return within.select(F.col("x.id").alias("doc_a"), F.col("y.id").alias("doc_b")).union(across).distinct()


def classes(members: DataFrame, links: DataFrame) -> DataFrame:
    """(doc_id, class_id, n_links): one row per document; links count other texts alike to its own."""
    grouped = components(links.select("a", "b"))
    degree = links.select(F.explode(F.array("a", "b")).alias("r")).groupBy("r").agg(F.count("*").alias("n"))
    own = members.groupBy("id").agg(F.min("representative").alias("r"))
    joined = own.join(grouped.withColumnRenamed("id", "r"), "r", "left").join(degree, "r", "left")
    return joined.select(F.col("id").alias("doc_id"), F.coalesce("component", "r").alias("class_id"), F.coalesce("n", F.lit(0)).cast("bigint").alias("n_links"))
