"""Subject areas: complement naive Bayes, refined by expectation-maximization over the corpus."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.text import plain, sentences
from textloom.plans.storage import stored

SUBJECTS = ["science", "medicine", "law", "sport", "software", "hardware", "vehicles", "religion", "politics", "commerce"]
BUCKETS = 1 << 16
ALPHA = 0.5
SHARPEN = 2.0  # scale of scores in the expectation step
NONE_SCORE = 4.5  # evidence that a sentence of no subject counts with, above that of ten silent subjects
NONE_WEIGHT = 0.1
CONTEXT = 7.0
CLEAR = 1.5
HELD_OUT = 4  # one labelled document in so many is kept for calibration
SHARE = 0.25
LABEL_ROWS = 20_000  # label rows that training reads at most
ROUNDS = 4
_TOKEN = re.compile(r"[^\W\d_]{2,}")
_NOISE = re.compile(r"\S*[\d@!/<>\[\]_\\]\S*")


def _features(sentence: str, cache: dict[str, int]) -> list[int]:
    out = set()
    for w in _TOKEN.findall(_NOISE.sub(" ", sentence)):
        if (f := cache.get(w)) is None:
            f = cache[w] = zlib.crc32(w.encode()) % BUCKETS
        out.add(f)
    return list(out)


def _vectors(texts: list[str], cache: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, first feature of each sentence, text of each sentence); sentences without words are left out."""
    features, starts, owner = [], [], []
    for t, body in enumerate(texts):
        for a, b in sentences(body):
            if f := _features(plain(body[a:b]), cache):
                starts.append(len(features))
                features += f
                owner.append(t)
    return np.array(features, np.int64), np.array(starts, np.int64), np.array(owner, np.int64)


def weights(counts: np.ndarray, margin: float = np.log(2)) -> np.ndarray:
    """Complement weights (subjects x features): how much rarer a feature is outside a subject than overall.

    counts: (subjects + none, features).
    """
    # sentences without a subject count little: they would otherwise wear down the words of all subjects
    total = counts[:-1].sum(0) + NONE_WEIGHT * counts[-1]
    overall = (total + ALPHA) / (total.sum() + ALPHA * counts.shape[1])
    outside = total - counts[:-1]
    outside = (outside + ALPHA) / (outside.sum(1, keepdims=True) + ALPHA * counts.shape[1])
    # a feature that is found in the subject less than half of the time is no evidence for it, so
    # the ordinary words of a language do not vote for the subject most common in that language
    return np.maximum(0, np.log(overall / outside) - margin)


def _scores(w: np.ndarray, features: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(w.T[features], starts, axis=0) if len(starts) else np.zeros((0, len(w)))


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def _responsibilities(z: np.ndarray, owner: np.ndarray, allowed: np.ndarray | None = None) -> np.ndarray:
    """Class shares of each sentence; the other sentences of its document speak for their subjects too."""
    z = np.hstack([SHARPEN * z, np.full((len(z), 1), NONE_SCORE)])
    if not len(z):
        return z
    if allowed is not None:
        z = np.where(allowed, z, -1e9)
    r = _softmax(z)
    size = np.bincount(owner)
    mean = np.stack([np.bincount(owner, r[:, k]) for k in range(r.shape[1] - 1)], 1) / np.maximum(1, size)[:, None]
    z[:, :-1] += CONTEXT * mean[owner]
    return _softmax(z)


def _counted(r: np.ndarray, features: np.ndarray, starts: np.ndarray) -> np.ndarray:
    out = np.zeros((BUCKETS, r.shape[1]))
    np.add.at(out, features, np.repeat(r, np.diff(np.r_[starts, len(features)]), axis=0))
    return out.T


class Subjects:
    def __init__(self, w: np.ndarray, slope: np.ndarray, shift: np.ndarray):
        self.w, self.slope, self.shift = w.astype(np.float32), slope, shift

    def posteriors(self, z: np.ndarray) -> np.ndarray:
        """Independent calibrated probability of every subject for each sentence."""
        return 1 / (1 + np.exp(-np.clip(self.slope * against(z) + self.shift, -50, 50)))


def against(z: np.ndarray) -> np.ndarray:
    """Evidence for each subject against the strongest other one, or against none of them.

    Beyond ``CLEAR`` more evidence says no more: what labels deny there is the labels' own error.
    """
    if not len(z):
        return z
    top = np.sort(z, 1)[:, -2:]
    other = np.where(z == top[:, 1:], top[:, :1], top[:, 1:])
    return np.clip(z - np.maximum(other, 0), -CLEAR, CLEAR)


def featured(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, features, starts) of each document: hashed words of its sentences, and where each sentence begins.

    Texts are read whole, once; documents without words have no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, int] = {}
        for batch in batches:
            out: list[list] = [[], [], []]
            for i, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                features, starts, _ = _vectors([body], cache)
                if len(starts):
                    out[0].append(i)
                    out[1].append(features.astype(np.int32).tobytes())
                    out[2].append(starts.astype(np.int32).tobytes())
            if len(cache) > 500_000:
                cache.clear()
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.binary())], ["doc_id", "features", "starts"])

    source = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).where("text is not null")
    return stored(source.mapInArrow(run, "doc_id bigint, features binary, starts binary"))


def _joined(features: list[bytes], starts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, first feature of each sentence and owner of each sentence of several documents."""
    f, s = [np.frombuffer(x, np.int32) for x in features], [np.frombuffer(x, np.int32) for x in starts]
    if not f:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.cumsum([0, *map(len, f)])
    return np.concatenate(f).astype(np.int64), np.concatenate([x + a for x, a in zip(s, at)]).astype(np.int64), np.repeat(np.arange(len(s)), [len(x) for x in s])


def _calibrated(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic fit of one subject's labels to its scores, by damped Newton steps; the slope stays positive."""
    a, b = 1.0, -4.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -40, 40)))
        v = p * (1 - p) + 1e-9
        g = np.array([((p - y) * z).sum() + 0.01 * (a - 1), (p - y).sum() + 0.01 * (b + 4)])
        h = np.array([[(v * z * z).sum() + 0.01, (v * z).sum()], [(v * z).sum(), v.sum() + 0.01]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
        a, b = max(0.05, a - step[0]), b - step[1]
        if np.abs(step).max() < 1e-5:
            break
    return a, b


def train(read: DataFrame, labels: DataFrame, rounds: int = ROUNDS) -> Subjects:
    """Labelled sentences start the model, ``rounds`` passes over all documents refine it; read: of :func:`featured`.

    One labelled document in ``HELD_OUT`` (by the hash of its id) teaches no words: on these, scores are calibrated.
    """
    told = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.lower(F.trim("subject")).alias("subject"))
    told = told.where(F.col("subject").isin([*SUBJECTS, "none"]) & F.col("doc_id").isNotNull()).distinct()
    told = told.orderBy(F.xxhash64("doc_id"), "doc_id", "subject").limit(LABEL_ROWS)
    told = told.groupBy("doc_id").agg(F.sort_array(F.collect_set("subject")).alias("subjects"))
    rows = read.join(told, "doc_id").orderBy("doc_id", "features").collect()
    n = len(SUBJECTS)
    features, starts, owner = _joined([r.features for r in rows], [r.starts for r in rows])
    held = np.array([zlib.crc32(str(r.doc_id).encode()) % HELD_OUT == 0 for r in rows], bool)
    held = held[owner] if len(owner) and not held.all() else np.zeros(len(owner), bool)
    allowed = np.zeros((len(rows), n + 1), bool)
    for i, r in enumerate(rows):
        for s in r.subjects:
            allowed[i, SUBJECTS.index(s) if s != "none" else n] = True
    told_rows = allowed[owner] if len(owner) else np.zeros((0, n + 1), bool)
    open_rows = told_rows.copy()
    open_rows[:, n] = True
    teach = (~held)[:, None]
    r = told_rows / np.maximum(1, told_rows.sum(1, keepdims=True)) * teach
    for step in range(10):
        w = weights(_counted(r, features, starts), 0.0 if step < 6 else np.log(2))
        # small talk leaves the labelled subjects only once their words have separated
        r = _responsibilities(_scores(w, features, starts), owner, told_rows if step < 6 else open_rows) * teach
    base = _counted(r, features, starts)
    for _ in range(rounds):
        base = _counted(r, features, starts) + _expected(read, weights(base))
        r = _responsibilities(_scores(weights(base), features, starts), owner, open_rows) * teach
    w = weights(base)
    z = _scores(w, features, starts)
    slope, shift = np.ones(n), np.full(n, -NONE_SCORE)
    # a sentence's own subject: of those its document is labelled with the one that scores highest, if any scores
    among = np.where(told_rows[:, :n], z, 0.0)
    own = (among > 0) & (among == among.max(1, keepdims=True)) if len(z) else np.zeros((0, n), bool)
    for s in range(n):
        use = held if own[held, s].any() else np.ones(len(z), bool)
        if own[use, s].any():
            slope[s], shift[s] = _calibrated(against(z)[use, s], own[use, s].astype(float))
    return Subjects(w, slope, shift)


def _expected(read: DataFrame, w: np.ndarray) -> np.ndarray:
    """Expected feature counts of every class over all documents, combined map-side."""
    shared = read.sparkSession.sparkContext.broadcast(w.astype(np.float32))
    classes = len(w) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((classes, BUCKETS))
        for batch in batches:
            features, starts, owner = _joined(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            if len(starts):
                total += _counted(_responsibilities(_scores(shared.value, features, starts), owner), features, starts)
        seen = np.flatnonzero(total.any(0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(seen.astype(np.int32)), *[pa.array(total[c, seen]) for c in range(classes)]], ["f", *[f"c{c}" for c in range(classes)]]
        )

    made = read.select("features", "starts").mapInArrow(run, "f int, " + ", ".join(f"c{c} double" for c in range(classes)))
    summed = made.groupBy("f").agg(*[F.sum(f"c{c}").alias(f"c{c}") for c in range(classes)]).toArrow()
    out = np.zeros((classes, BUCKETS))
    at = summed.column(0).to_numpy()
    for c in range(classes):
        out[c, at] = summed.column(c + 1).to_numpy()
    return out


def subjects(read: DataFrame, model: Subjects, share: float = SHARE) -> DataFrame:
    """(doc_id, subject, share, confidence): subjects that at least ``share`` of the sentences deal with.

    read: of :func:`featured`. A sentence deals with every subject whose calibrated posterior exceeds one half: none, one or
    several, each judged by itself. Null, empty and wordless texts: no row. Repeated rows repeat.
    """
    shared = read.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            features, starts, owner = _joined(batch.column(1).to_pylist(), batch.column(2).to_pylist())
            p = model.posteriors(_scores(model.w, features, starts))
            hit = p > 0.5
            number, belief = np.zeros((len(ids), len(SUBJECTS))), np.zeros((len(ids), len(SUBJECTS)))
            np.add.at(number, owner, hit)
            np.add.at(belief, owner, p * hit)
            size = np.bincount(owner, minlength=len(ids))
            d, s = np.nonzero(number >= np.maximum(share * size[:, None], 1e-9))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[d], pa.int64()), pa.array([SUBJECTS[k] for k in s], pa.string()), pa.array(np.round(number[d, s] / size[d], 4)), pa.array(np.round(belief[d, s] / number[d, s], 4))],
                ["doc_id", "subject", "share", "confidence"],
            )

    return read.where("doc_id is not null").mapInArrow(run, "doc_id bigint, subject string, share double, confidence double")
