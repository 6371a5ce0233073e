"""Document and segment languages by a byte convolutional network trained in numpy."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.text import repaired, sentences

LANGUAGES = ["en", "de", "fr", "es", "pt"]
# fixed values: three-letter codes, English names and own names of the languages
NAMES = {
    "en": ["eng", "english"],
    "de": ["deu", "ger", "german", "deutsch"],
    "fr": ["fra", "fre", "french", "francais", "français"],
    "es": ["spa", "spanish", "espanol", "español"],
    "pt": ["por", "portuguese", "portugues", "português"],
}
WINDOW = 96  # bytes
EMBED, FILTERS, WIDTHS = 8, 24, (3, 4, 5)
SAMPLE_DOCS = 500  # labelled documents of each language that the network is trained on, at most twice as many
SHORT = 24  # bytes; what a shorter window tells counts less
SWITCH = 3.5  # cost of a change of language between sentences
FLOOR = -8.0
_NAMES = {n: k for k, ns in NAMES.items() for n in [k, *ns]}
_NOISE = re.compile(r"\S*[\d@!/<>\[\]_\\]\S*")


def canonical(label: str | None) -> str | None:
    """The language that a label names, None where it names none."""
    if label is None:
        return None
    return _NAMES.get(re.split(r"[-_\s(]", label.strip().lower())[0])


def _clean(text: str) -> bytes:
    text = " ".join(_NOISE.sub(" ", unicodedata.normalize("NFC", repaired(text))).split()).lower()
    return text.encode()


def windows(text: str) -> list[bytes]:
    """All of the text in windows; a short rest is read with the bytes before it."""
    body = _clean(text)
    whole = [body[i : i + WINDOW] for i in range(0, len(body), WINDOW)]
    if len(whole) > 1 and len(whole[-1]) < SHORT:
        whole[-1] = body[-WINDOW:]
    return whole


def _matrix(parts: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(p[:WINDOW].ljust(WINDOW, b"\0") for p in parts), np.uint8).reshape(-1, WINDOW)


class ByteNetwork:
    """Byte embeddings, filters of several widths, max pooling over the window, softmax."""

    def __init__(self, classes: int, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.p = {"e": rng.normal(0, 0.5, (256, EMBED)).astype(np.float32)}
        self.p["e"][0] = 0
        for w in WIDTHS:
            self.p[f"k{w}"] = rng.normal(0, (2 / (w * EMBED)) ** 0.5, (w * EMBED, FILTERS)).astype(np.float32)
            self.p[f"b{w}"] = np.zeros(FILTERS, np.float32)
        self.p["o"] = rng.normal(0, 0.1, (FILTERS * len(WIDTHS), classes)).astype(np.float32)
        self.p["c"] = np.zeros(classes, np.float32)

    def _pooled(self, x: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
        embedded = self.p["e"][x]
        flat = embedded.reshape(len(x), -1)
        parts, kept = [], []
        for w in WIDTHS:
            n = WINDOW - w + 1
            view = np.lib.stride_tricks.as_strided(
                flat, (len(x), n, w * EMBED), (flat.strides[0], flat.strides[1] * EMBED, flat.strides[1]), writeable=False
            )
            h = view.reshape(-1, w * EMBED) @ self.p[f"k{w}"]
            h = h.reshape(len(x), n, FILTERS)
            if keep:
                at = h.argmax(1)
                top = np.take_along_axis(h, at[:, None], 1)[:, 0] + self.p[f"b{w}"]
                kept.append((view, at, top))
            else:
                top = h.max(1) + self.p[f"b{w}"]
            parts.append(np.maximum(top, 0))
        return np.concatenate(parts, 1), kept

    def log_probabilities(self, x: np.ndarray, batch: int = 512) -> np.ndarray:
        out = np.zeros((len(x), len(self.p["c"])), np.float32)
        for s in range(0, len(x), batch):
            z = self._pooled(x[s : s + batch], False)[0] @ self.p["o"] + self.p["c"]
            z -= z.max(1, keepdims=True)
            out[s : s + batch] = z - np.log(np.exp(z).sum(1, keepdims=True))
        return out

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 4, batch: int = 128, rate: float = 4e-3, seed: int = 5) -> ByteNetwork:
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        step, total = 0, epochs * -(-len(x) // batch)
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for lo in range(0, len(x), batch):
                pick = order[lo : lo + batch]
                g = self._gradient(x[pick], y[pick])
                step += 1
                pace = rate * (1 - step / (total + 1))
                for k, v in g.items():
                    m[k] = 0.9 * m[k] + 0.1 * v
                    s[k] = 0.99 * s[k] + 0.01 * v * v
                    self.p[k] -= pace * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-7)
                self.p["e"][0] = 0
        return self

    def _gradient(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        pooled, kept = self._pooled(x, True)
        z = pooled @ self.p["o"] + self.p["c"]
        z = np.exp(z - z.max(1, keepdims=True))
        z /= z.sum(1, keepdims=True)
        z[np.arange(len(y)), y] -= 1
        z /= len(y)
        g = {"o": pooled.T @ z, "c": z.sum(0), "e": np.zeros_like(self.p["e"])}
        back = z @ self.p["o"].T
        rows = np.arange(len(x))[:, None]
        for n, (w, (view, at, top)) in enumerate(zip(WIDTHS, kept)):
            d = back[:, n * FILTERS : (n + 1) * FILTERS] * (top > 0)
            seen = view[rows, at]  # (batch, filters, w * EMBED)
            g[f"k{w}"] = np.einsum("bfe,bf->ef", seen, d)
            g[f"b{w}"] = d.sum(0)
            spread = (d[:, :, None] * self.p[f"k{w}"].T[None]).reshape(len(x), FILTERS, w, EMBED)
            where = x[rows[:, :, None], at[:, :, None] + np.arange(w)]
            np.add.at(g["e"], where.ravel(), spread.reshape(-1, EMBED))
        return g


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = SAMPLE_DOCS, extra: list[tuple[str, str]] = ()) -> ByteNetwork:
    """Train on a bounded sample of labelled rows, some of whose windows lose accents or are cut short.

    extra: further (text, language), such as short prompts.
    """
    head = F.lower(F.regexp_extract(F.trim(lang), r"^[^-_\s(]+", 0))
    of = F.create_map(*[F.lit(x) for pair in _NAMES.items() for x in pair])
    labelled = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), of[head].alias("lang")).where("lang is not null and text is not null")
    counts = {r[0]: r[1] for r in labelled.groupBy("lang").count().collect()}
    million = 1_000_000
    limit = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(million, million * per_language // n))]) if counts else None
    if limit is None:
        return ByteNetwork(len(LANGUAGES))
    picked = labelled.where(F.pmod(F.xxhash64("id"), F.lit(million)) < limit[F.col("lang")])
    rows = picked.select("id", "lang", "text").orderBy("id").limit(2 * per_language * len(LANGUAGES)).collect()
    rng = np.random.default_rng(9)
    x, y = [], []
    for r in rows:
        spans = sentences(r.text)
        spans = [spans[i] for i in sorted(rng.choice(len(spans), min(8, len(spans)), replace=False))] if spans else []
        for a, b in spans:
            body = r.text[a:b]
            if rng.random() < 0.4:
                body = "".join(c for c in unicodedata.normalize("NFD", repaired(body)) if not unicodedata.combining(c))
            for part in windows(body):
                if rng.random() < 0.3:
                    part = part[: rng.integers(20, WINDOW)]
                x.append(part)
                y.append(LANGUAGES.index(r.lang))
    for body, of in extra:
        for part in windows(body):
            x.append(part)
            y.append(LANGUAGES.index(of))
    if not x:
        return ByteNetwork(len(LANGUAGES))
    x, y = _matrix(x), np.array(y)
    size = np.bincount(y, minlength=len(LANGUAGES))
    most = int(np.median(size[size > 0]) * 1.5)
    keep = np.concatenate([rng.permutation(np.flatnonzero(y == k))[:most] for k in range(len(LANGUAGES))])
    x, y = x[keep], y[keep]
    network = ByteNetwork(len(LANGUAGES)).fit(x, y, 3)
    # some labels are wrong and some texts mixed: what the network does not believe is left out of the last epochs
    sure = network.log_probabilities(x).argmax(1) == y
    return network.fit(x[sure], y[sure], 3, rate=2e-3, seed=6) if sure.any() else network


def segments(network: ByteNetwork, texts: list[str]) -> list[list[tuple[int, str, float]]]:
    """For each text its stretches as (first character, language, confidence); none without words."""
    owner, parts, spans = [], [], []
    for t, body in enumerate(texts):
        spans.append(sentences(body))
        for k, (a, b) in enumerate(spans[-1]):
            for part in windows(body[a:b]):
                owner.append((t, k))
                parts.append(part)
    scores = network.log_probabilities(_matrix(parts)) if parts else np.zeros((0, len(LANGUAGES)), np.float32)
    first = np.cumsum([0, *map(len, spans)])
    every = np.zeros((first[-1], len(LANGUAGES)))
    if owner:
        told = np.minimum(1.0, np.array([len(p) for p in parts]) / SHORT)[:, None]
        np.add.at(every, [first[t] + k for t, k in owner], np.maximum(scores, FLOOR) * told)
    known = every.any(1)
    every = np.maximum(every - every.max(1, keepdims=True), FLOOR) if len(every) else every
    share = np.exp(every)
    share /= share.sum(1, keepdims=True)
    leader = np.where(known, every.argmax(1), -1) if len(every) else np.zeros(0, int)
    out = []
    for t, s in enumerate(spans):
        lo, hi = first[t], first[t + 1]
        told = known[lo:hi]
        if not told.any():
            out.append([])
            continue
        said = set(leader[lo:hi][told].tolist())
        # one language leads everywhere: no path can be better
        path = [said.pop()] * (hi - lo) if len(said) == 1 else _path(every[lo:hi])
        out.append(_runs(path, s, told, share[lo:hi]))
    return out


def _path(e: np.ndarray) -> list[int]:
    """Best languages of the sentences where each change costs SWITCH."""
    best, back = e[0].copy(), []
    for row in e[1:]:
        moved = int(best.argmax())
        stay = best >= best[moved] - SWITCH
        back.append(np.where(stay, np.arange(len(best)), moved))
        best = np.where(stay, best, best[moved] - SWITCH) + row
    path = [int(best.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def _runs(path: list[int], spans: list[tuple[int, int]], told: np.ndarray, share: np.ndarray) -> list[tuple[int, str, float]]:
    runs, lo = [], 0
    for i in range(1, len(path) + 1):
        if i == len(path) or path[i] != path[lo]:
            known = [j for j in range(lo, i) if told[j]]
            start = spans[known[0] if known else lo][0] if lo else 0
            runs.append((start, LANGUAGES[path[lo]], round(float(share[known, path[lo]].mean()), 4) if known else 0.0))
            lo = i
    return runs


def languages(docs: DataFrame, network: ByteNetwork, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(doc_id, seg_start, lang, confidence, n_segments, given) for every stretch of every document.

    Null, empty or wordless texts: no row. Texts of any length are read whole; equal scores go to
    the language listed first. The network is of fixed size. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            ids, texts, given = (batch.column(i).to_pylist() for i in range(3))
            for lo in range(0, len(ids), 256):
                for i, g, runs in zip(ids[lo : lo + 256], given[lo : lo + 256], segments(network, texts[lo : lo + 256])):
                    rows += [(i, *r, len(runs), canonical(g)) for r in runs]
            columns = list(zip(*rows)) or [[]] * 6
            kinds = (pa.int64(), pa.int32(), pa.string(), pa.float64(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(columns, kinds)], ["doc_id", "seg_start", "lang", "confidence", "n_segments", "given"]
            )

    source = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("given"))
    return source.where("doc_id is not null and text is not null").mapInArrow(
        run, "doc_id bigint, seg_start int, lang string, confidence double, n_segments int, given string"
    )


def wrong_labels(found: DataFrame) -> DataFrame:
    """Stretches of mixed documents, and single languages that the label misses or contradicts."""
    return found.where("n_segments > 1 or given is null or given <> lang").select("doc_id", "seg_start", "lang").distinct()
