"""Personal data in free text: a linear-chain conditional random field over word-shape features."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.practice import FRAMES, Writer, unmarked

KINDS = ["person_name", "email", "phone", "id_number", "street_address"]
LABELS = ["O", *[f"{p}-{k}" for k in KINDS for p in "BI"]]
REACH = 3  # neighbours on either side whose features count
POSTS, SENTENCES, PLACES = 500, 3000, 4000  # size of the practice table
SAMPLE_POSTS = 1500  # posts whose senders teach names, at most twice as many
AROUND = 5
_FROM = re.compile(r"^(?:From|Reply-To|Von|De|Da) ?: *(.+)$", re.I | re.M)
_SENDER = re.compile(r"^(?P<a>[^<>()@]+?) *<[^<>]*@[^<>]*>|^\S+@\S+ *\((?P<b>[^()]+)\)")
_TOKEN = re.compile(r"\s*(?:[^\W\d_]+|\d+|[^\w\s]|_+)")
_N = len(LABELS)


def _shape(word: str) -> str:
    if word[0].isdigit():
        return "d" * min(len(word), 12)
    if not word[0].isalpha():
        return word[0]
    if len(word) == 1:
        return "X1" if word.isupper() else "x1"
    return "X" if word.isupper() else "Xx" if word[0].isupper() else "x"


def _features(raw: str) -> list[str]:
    word = raw.strip()
    gap = "n" if "\n" in raw or "\r" in raw else "s" if len(raw) > len(word) else "-"
    low, shape = word.lower(), _shape(word)
    return [f"w{low}", f"s{shape}", f"g{gap}{shape}", f"p{low[:3]}", f"e{low[-3:]}"] if shape[0] in "Xx" else [f"s{shape}", f"g{gap}{shape}"]


def _coded(text: str, places: list[tuple[int, int, str]]) -> tuple[list[str], list[int]]:
    raw = _TOKEN.findall(text)
    ends = np.cumsum([len(r) for r in raw])
    labels = [0] * len(raw)
    for a, b, kind in places:
        inside = [i for i, (e, r) in enumerate(zip(ends, raw)) if e - len(r.lstrip()) >= a and e <= b]
        for k, i in enumerate(inside):
            labels[i] = 1 + 2 * KINDS.index(kind) + (k > 0)
    return raw, labels


def labelled_table(seed: int = 17) -> list[tuple[list[str], list[int]]]:
    """Practice sequences of tokens with labels: mails in pieces of a few lines, and prose."""
    writer, out = Writer(seed), []
    for _ in range(POSTS):
        text, places, used = "", [], 0
        for line, _ in writer.post():
            shown, found = unmarked(line)
            places += [(a + len(text), b + len(text), k) for a, b, k in found]
            text += shown + "\n"
            used += 1
            if used >= 5:
                out.append(_coded(text, places))
                text, places, used = "", [], 0
        if text.strip():
            out.append(_coded(text, places))
    for _ in range(SENTENCES):
        lang = writer.pick(list(FRAMES))
        text, places = "", []
        for _ in range(3):
            shown, found = unmarked(writer.sentence(lang))
            places += [(a + len(text), b + len(text), k) for a, b, k in found]
            text += shown + writer.pick([" ", " ", "\n", "  ", " ! "])
        out.append(_coded(text, places))
    for _ in range(PLACES):  # places among words that tell nothing: what they look like must do
        shown, found = unmarked(writer.stray())
        out.append(_coded(shown, found))
    return [x for x in out if x[0]]


def senders(texts: list[str]) -> tuple[set[str], set[str]]:
    """Given names and surnames, in lower case, that the address headers of mails show."""
    given, last = set(), set()
    for text in texts:
        for m in _FROM.finditer(re.split(r"\r?\n\s*\r?\n", text, maxsplit=1)[0]):
            if (found := _SENDER.match(m[1].strip())) is None:
                continue
            name = (found["a"] or found["b"]).strip(' "')
            parts = name.split(", ")[::-1] if ", " in name else name.split()
            parts = [p for p in parts if re.fullmatch(r"[^\W\d_]+(?:-[^\W\d_]+)*", p)]
            if len(parts) >= 2 and all(p[0].isupper() for p in parts):
                given.add(parts[0].lower())
                last.add(parts[-1].lower())
    return given, last - given


def taught(texts: list[str], tagger: Tagger) -> list[tuple[list[str], list[int]]]:
    """Mails as labelled sequences: names by what their senders are called, the other kinds as ``tagger`` finds them.

    A name is a sender's given name with what belongs to it, a surname after a title or an initial, or both parts in reverse.
    Lines with long numbers of which nothing is known are left out with their neighbours.
    """
    given, last = senders(texts)
    often: dict[str, int] = {}
    for text in texts:
        for w in re.findall(r"(?<![^\W_])[^\W\d_A-Z]\w+", text):
            often[w] = often.get(w, 0) + 1
    word, initial = r"[^\W\d_]+(?:-[^\W\d_]+)*", r"(?:\s[A-Z]\.)?"
    one = re.compile(
        rf"(?P<rev>{word}),\s(?P<revg>{word})\b|(?<!\w)(?:Dr|Prof|Mrs?|Ms|Herr|Frau)\.?\s(?P<title>[A-ZÀ-Ý]{word})|(?<![\w.])[A-ZÀ-Ý]\.\s(?P<only>[A-ZÀ-Ý]{word})|(?P<g>{word})(?P<i>{initial})(?:\s(?P<s>{word}))?"
    )
    out = []
    for text, places in zip(texts, Finder(tagger).find(texts)):
        # a user part without a letter makes an identifier, not an address
        kept = [p for p in places if p[2] != "person_name" and (p[2] != "email" or re.search(r"[^\W\d_]", re.split(r"@|\W+at\W", text[p[0] : p[1]], maxsplit=1, flags=re.I)[0]))]
        kept += [p for p in places if p[2] == "person_name" and _evident(text, p, given, last)]
        taken = [(a, b) for a, b, _ in kept]
        at = 0
        while (m := one.search(text, at)) is not None:
            at = m.end()
            if m["rev"]:
                span = m.span() if m["rev"].lower() in last and m["revg"].lower() in given else None
                at = m.end() if span else m.end("rev")
                if span is None and m["rev"].lower() in given:
                    span = m.span("rev")
            elif m["g"]:
                low, after = m["g"].lower(), m["s"]
                span, at = None, m.end("g")
                if low in given and (m["g"][0].isupper() or after and (after.lower() in last or often.get(after, 0) < 3)):
                    same = after is not None and after[0].isupper() == m["g"][0].isupper()
                    follows = same and (after.lower() in last or m["i"] or after.lower() not in given and (after[0].isupper() or often.get(after, 0) < 3))
                    span = (m.start(), m.end("s")) if follows else m.span("g")
                    at = span[1]
            else:
                span = m.span("title") if m["title"] else m.span()
            if span and not any(a < span[1] and span[0] < b for a, b in taken):
                kept.append((*span, "person_name"))
                taken.append(span)
        kept.sort()
        lo = 0
        lines = [m.end() for m in re.finditer("\n", text)]
        for hi in [*lines[4::5], len(text)]:
            part = [(a - lo, b - lo, k) for a, b, k in kept if a >= lo and b <= hi]
            long = [m.span() for m in re.finditer(r"\+?\(?\d[\d ()./-]{5,}\d", text[lo:hi])]
            if all(any(a < y and x < b for a, b, _ in part) or re.match(r"[^\s<>]*@", text[lo + y :]) for x, y in long):
                out.append(_coded(text[lo:hi], part))
                # some writers do without capitals, or without small letters
                if names := [(a, b) for a, b, k in part if k == "person_name"]:
                    turn = len(out) % 9
                    if turn < 2:
                        body = text[lo:hi]
                        for a, b in names:
                            said = body[a:b].lower() if turn == 0 else body[a:b].upper()
                            body = body[:a] + said + body[b:] if len(said) == b - a else body
                        out.append(_coded(body, part))
            lo = hi
    return [x for x in out if x[0]]


def _evident(text: str, place: tuple[int, int, str], given: set[str], last: set[str]) -> bool:
    """A found name with a part that senders have, or after a title or an initial."""
    said = text[place[0] : place[1]]
    if any(w.lower() in given or w.lower() in last for w in re.findall(r"[^\W\d_]+(?:-[^\W\d_]+)*", said)):
        return True
    return bool(re.match(r"[A-Z]\. ", said) or re.search(r"\b(?:Dr|Prof|Mrs?|Ms|Herr|Frau)\.? $", text[max(0, place[0] - 6) : place[0]]))


class Tagger:
    def __init__(self, vocabulary: dict[str, int], weights: np.ndarray, moves: np.ndarray, start: np.ndarray):
        self.vocabulary, self.weights, self.moves, self.start = vocabulary, weights, moves, start

    def ids(self, raw: str) -> list[int]:
        return [self.vocabulary[f] for f in _features(raw) if f in self.vocabulary]

    def table(self, raws: list[str]) -> np.ndarray:
        """(tokens, offsets, labels) scores of token types at each offset from the labelled token."""
        out = np.zeros((len(raws), 2 * REACH + 1, _N), np.float32)
        for i, raw in enumerate(raws):
            if ids := self.ids(raw):
                out[i] = self.weights[:, ids].sum(1)
        return out

    def viterbi(self, scores: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Best labels of padded sequences (batch, time, labels)."""
        b, t, _ = scores.shape
        scores = np.ascontiguousarray(scores.transpose(1, 2, 0))
        best = scores[0] + self.start[:, None]
        back = np.zeros((t, _N, b), np.int8)
        still = np.arange(_N, dtype=np.int8)[:, None]
        for k in range(1, t):
            new = np.empty_like(best)
            for j in range(_N):
                if j and not j % 2:  # an inner label has two predecessors
                    x, y = best[j - 1] + self.moves[j - 1, j], best[j] + self.moves[j, j]
                    new[j] = np.maximum(x, y)
                    back[k, j] = j - (x >= y)
                else:
                    every = best + self.moves[:, j, None]
                    back[k, j] = every.argmax(0)
                    new[j] = every.max(0)
            new += scores[k]
            on = k < lengths
            if on.all():
                best = new
            else:
                best = np.where(on, new, best)
                back[k] = np.where(on, back[k], still)
        out = np.zeros((b, t), np.int8)
        out[:, -1] = best.argmax(0)
        for k in range(t - 1, 0, -1):
            out[:, k - 1] = back[k, out[:, k], np.arange(b)]
        return out


def train(table: list[tuple[list[str], list[int]]] | None = None, epochs: int = 4, batch: int = 64, rate: float = 0.25, decay: float = 1e-6, seed: int = 4) -> Tagger:
    """Maximum likelihood by adaptive gradient steps over batches of sequences."""
    table = labelled_table() if table is None else table
    counts: dict[str, int] = {}
    for raw, _ in table:
        for r in raw:
            for f in _features(r):
                counts[f] = counts.get(f, 0) + 1
    vocabulary = {f: i + 1 for i, f in enumerate(f for f, n in counts.items() if n > 1)}
    types: dict[str, int] = {"": 0}
    feats: list[list[int]] = [[0] * 5]
    coded = []
    for raw, labels in table:
        seq = []
        for r in raw:
            if r not in types:
                types[r] = len(types)
                ids = [vocabulary[f] for f in _features(r) if f in vocabulary]
                feats.append((ids + [0] * 5)[:5])
            seq.append(types[r])
        coded.append((np.array(seq), np.array(labels)))
    feats_ = np.array(feats)
    w = np.zeros((2 * REACH + 1, len(vocabulary) + 1, _N), np.float32)
    moves, start = np.zeros((_N, _N), np.float32), np.zeros(_N, np.float32)
    for k in range(1, _N):
        if not k % 2:  # an inner label follows its own kind only
            moves[[j for j in range(_N) if j not in (k, k - 1)], k] = -30
            start[k] = -30
    free_m, free_s = moves > -30, start > -30
    gw, gm, gs = np.full_like(w, 1e-2), np.full_like(moves, 1e-2), np.full_like(start, 1e-2)
    rng = np.random.default_rng(seed)
    coded.sort(key=lambda x: len(x[0]))
    groups = [coded[i : i + batch] for i in range(0, len(coded), batch)]
    for _ in range(epochs):
        for g in rng.permutation(len(groups)):
            group = groups[g]
            n, t = len(group), max(len(s) for s, _ in group)
            x, y = np.zeros((n, t + 2 * REACH), int), np.zeros((n, t), int)
            lengths = np.array([len(s) for s, _ in group])
            for i, (s, l) in enumerate(group):
                x[i, REACH : REACH + len(s)] = s
                y[i, : len(l)] = l
            seen, inverse = np.unique(x, return_inverse=True)
            inverse = inverse.reshape(x.shape)
            f = feats_[seen]
            lookup = w[:, f].sum(2)  # offsets, types, labels
            e = sum(lookup[o][inverse[:, o : o + t]] for o in range(2 * REACH + 1))
            on = np.arange(t)[None] < lengths[:, None]
            d, dm, ds = _gradient(e, y, on, lengths, moves, start)
            for o in range(2 * REACH + 1):
                per = np.zeros((len(seen), _N), np.float32)
                np.add.at(per, inverse[:, o : o + t][on], d[on])
                touched = np.unique(f)
                full = np.zeros((w.shape[1], _N), np.float32)
                np.add.at(full, f.ravel(), np.repeat(per, f.shape[1], axis=0))
                step = full[touched] / n + decay * w[o, touched]
                gw[o, touched] += step * step
                w[o, touched] -= rate * step / np.sqrt(gw[o, touched])
                w[o, 0] = 0
            dm, ds = dm / n * free_m, ds / n * free_s
            gm += dm * dm
            gs += ds * ds
            moves -= rate * dm / np.sqrt(gm)
            start -= rate * ds / np.sqrt(gs)
    return Tagger(vocabulary, w, moves, start)


def _gradient(e, y, on, lengths, moves, start):
    """Expected minus true counts of emissions, moves and starts."""
    n, t, _ = e.shape
    ahead = np.zeros_like(e)
    ahead[:, 0] = e[:, 0] + start
    expm = np.exp(moves)
    for k in range(1, t):
        top = ahead[:, k - 1].max(1, keepdims=True)
        new = np.log(np.exp(ahead[:, k - 1] - top) @ expm + 1e-30) + top + e[:, k]
        ahead[:, k] = np.where(on[:, k, None], new, ahead[:, k - 1])
    behind = np.zeros_like(e)
    for k in range(t - 2, -1, -1):
        z = behind[:, k + 1] + e[:, k + 1]
        top = z.max(1, keepdims=True)
        new = np.log(np.exp(z - top) @ expm.T + 1e-30) + top
        behind[:, k] = np.where(on[:, k + 1, None], new, behind[:, k + 1])
    last = ahead[np.arange(n), lengths - 1]
    top = last.max(1, keepdims=True)
    whole = np.log(np.exp(last - top).sum(1, keepdims=True)) + top
    p = np.exp(ahead + behind - whole[:, None])
    d = p.copy()
    i, k = np.nonzero(on)
    d[i, k, y[on]] -= 1
    d *= on[..., None]
    pair = on[:, 1:]
    joint = np.exp(np.clip(ahead[:, :-1, :, None] + moves + (e[:, 1:] + behind[:, 1:])[:, :, None] - whole[:, :, None, None], -50, 0))
    dm = (joint * pair[..., None, None]).sum((0, 1))
    np.subtract.at(dm, (y[:, :-1][pair], y[:, 1:][pair]), 1)
    ds = p[:, 0].sum(0)
    np.subtract.at(ds, y[:, 0], 1)
    return d, dm.astype(np.float32), ds.astype(np.float32)


def train_on(posts: DataFrame, post_id: str = "post_id", text: str = "text", sample_posts: int = SAMPLE_POSTS) -> Tagger:
    """The tagger of the practice table, trained further on a bounded sample of mails whose senders teach names.

    Mails are chosen by the hash of their text; without any the practice table is all there is.
    """
    first = train()
    rows = posts.where(F.col(text).isNotNull()).select(F.col(text).alias("text")).distinct()
    share = int(1_000_000 * min(1.0, sample_posts / max(1, rows.count())))
    picked = rows.where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < share).orderBy("text").limit(2 * sample_posts).collect()
    more = taught([r.text for r in picked], first)
    return train(labelled_table()[::2] + more) if more else first


class Finder:
    """Tags texts in batches; scores of token types are kept between batches."""

    def __init__(self, tagger: Tagger, most_types: int = 120_000):
        self.tagger, self.most = tagger, most_types
        self.clear()
        m = tagger.moves
        # what a label can gain over O at one token: its score, the best move into it and, once, the best way back
        self.into = (m.max(0) - m[0, 0]).astype(np.float32)
        self.slack = float(max(0.0, (m[1:, 0] - m[0, 0]).max()))

    def clear(self) -> None:
        self.types: dict[str, int] = {"": 0}
        self.scores = np.zeros((1024, 2 * REACH + 1, _N), np.float32)
        self.bound = np.zeros((2 * REACH + 1, 1024), np.float32)

    def _known(self, raws: set[str]) -> None:
        new = [r for r in raws if r not in self.types]
        if not new:
            return
        if len(self.types) + len(new) > self.most and len(self.types) > 1:
            self.clear()
            new = list(raws)
        at = len(self.types)
        if at + len(new) > len(self.scores):
            size = 2 * (at + len(new))
            self.scores = np.concatenate([self.scores, np.zeros((size - len(self.scores), *self.scores.shape[1:]), np.float32)])
            self.bound = np.concatenate([self.bound, np.zeros((len(self.bound), size - self.bound.shape[1]), np.float32)], 1)
        made = self.tagger.table(new)
        self.scores[at : at + len(new)] = made
        gain = made - made[..., :1]
        gain[:, REACH] += self.into
        self.bound[:, at : at + len(new)] = gain[..., 1:].max(-1).T
        self.types.update(zip(new, range(at, at + len(new))))

    def find(self, texts: list[str]) -> list[list[tuple[int, int, str]]]:
        """(start, end, kind) of the places of each text."""
        raws = [_TOKEN.findall(t) for t in texts]
        distinct: set[str] = set()
        for r in raws:
            distinct.update(r)
        self._known(distinct)
        get = self.types.__getitem__
        pad = [0] * REACH
        flat: list[int] = [*pad]
        first = []
        for r in raws:
            first.append(len(flat))
            flat.extend(map(get, r))
            flat.extend(pad)
        x = np.array(flat)
        core = slice(REACH, len(x) - REACH) if len(x) > 2 * REACH else slice(0, 0)
        m = len(x) - 2 * REACH
        out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
        if m <= 0:
            return out
        hope = np.zeros(m, np.float32)
        for o in range(2 * REACH + 1):
            hope += self.bound[o][x[o : o + m]]
        active = np.flatnonzero((hope + self.slack > 0) & (x[core] > 0))
        if not len(active):
            return out
        # exact scores where a label other than O could win
        e = np.zeros((len(active), _N), np.float32)
        for o in range(2 * REACH + 1):
            e += self.scores[x[active + o], o]
        e += self.into
        active = active[(e[:, 1:].max(1) - e[:, 0] + self.into[0]) + self.slack > 0] + REACH
        if not len(active):
            return out
        lo, hi = active - AROUND, active + AROUND + 1
        cut = np.flatnonzero(lo[1:] > hi[:-1])
        begins, ends = np.maximum(REACH, lo[np.r_[0, cut + 1]]), np.minimum(len(x) - REACH, hi[np.r_[cut, len(lo) - 1]])
        first_ = np.array(first)
        size = ends - begins
        for pick in _by_size(size):
            t = int(size[pick].max())
            at = np.minimum(begins[pick][:, None] + np.arange(t)[None], len(x) - REACH - 1)
            e = np.zeros((*at.shape, _N), np.float32)
            for o in range(2 * REACH + 1):
                e += self.scores[x[at + o - REACH], o]
            e[x[at] == 0] = np.r_[np.float32(0), np.full(_N - 1, -30, np.float32)]
            labels = self.tagger.viterbi(e, size[pick])
            labels[np.arange(t)[None] >= size[pick][:, None]] = 0
            i, k = np.nonzero(labels)
            if not len(i):
                continue
            position, label = at[i, k], labels[i, k]
            order = np.argsort(position, kind="stable")
            position, label = position[order], label[order]
            run = np.flatnonzero(np.r_[True, (np.diff(position) > 1) | (label[1:] % 2 == 1)])
            stops = np.r_[run[1:], len(position)]
            owner = np.searchsorted(first_, position[run], "right") - 1
            for o, a, b in zip(owner.tolist(), run.tolist(), stops.tolist()):
                out[o].append((int(position[a] - first[o]), int(position[b - 1] - first[o]), KINDS[(label[a] - 1) // 2]))
        for o, found in enumerate(out):
            if found:
                ends_ = np.cumsum([len(r) for r in raws[o]]).tolist()
                text, kept = texts[o], []
                for a, b, kind in sorted(found):
                    raw = raws[o][a]
                    span = (ends_[a] - len(raw.lstrip()), ends_[b])
                    if _plausible(text[span[0] : span[1]], kind):
                        kept.append((*span, kind))
                out[o] = kept
        return out


def _by_size(size: np.ndarray, most: int = 60_000) -> Iterator[np.ndarray]:
    order = np.argsort(size, kind="stable")
    lo = 0
    while lo < len(order):
        hi = lo + 1
        while hi < len(order) and (hi - lo + 1) * size[order[hi]] <= most and size[order[hi]] <= 2 * size[order[lo]] + 16:
            hi += 1
        yield order[lo:hi]
        lo = hi


def _plausible(place: str, kind: str) -> bool:
    """Exact check after decoding: what each kind must contain."""
    digits = sum(c.isdigit() for c in place)
    if kind == "email":
        return bool(re.search(r"@|\bat\b|\(at\)|\[at\]", place, re.I)) and bool(re.search(r"[^\W\d_]", place))
    if kind == "phone":
        return digits >= 7
    if kind == "id_number":
        return digits >= 6
    if kind == "street_address":
        return digits >= 1 and any(c.isalpha() for c in place)
    return digits == 0 and any(c.isalpha() for c in place)


def found(df: DataFrame, tagger: Tagger, table_name: str, row_id: str, text: str = "text", masked: bool = False) -> DataFrame:
    """(table_name, row_id, pii_type, start_pos, end_pos), or with ``masked`` (table_name, row_id, masked, n_places).

    ``masked`` is the text with ``[KIND]`` in each place. Null texts and ids: no row; empty texts: no
    place. Texts are read whole, repeated rows repeat their places. The model is of fixed size; no shuffle.
    """
    shared = df.sparkSession.sparkContext.broadcast(tagger)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(shared.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                ids, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
                places = finder.find(texts)
                if masked:
                    bodies = []
                    for body, p in zip(texts, places):
                        for a, b, kind in reversed(p):
                            body = f"{body[:a]}[{kind.upper()}]{body[b:]}"
                        bodies.append(body)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([table_name] * len(ids)), pa.array(ids, pa.int64()), pa.array(bodies, pa.string()), pa.array([len(p) for p in places], pa.int32())],
                        ["table_name", "row_id", "masked", "n_places"],
                    )
                else:
                    rows = [(i, k, a, b) for i, p in zip(ids, places) for a, b, k in p]
                    i, k, a, b = list(zip(*rows)) or [[]] * 4
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([table_name] * len(i), pa.string()), pa.array(list(i), pa.int64()), pa.array(list(k), pa.string()), pa.array(list(a), pa.int32()), pa.array(list(b), pa.int32())],
                        ["table_name", "row_id", "pii_type", "start_pos", "end_pos"],
                    )

    source = df.select(F.col(row_id).cast("bigint").alias("row_id"), F.col(text).alias("text")).where("row_id is not null and text is not null")
    schema = "table_name string, row_id bigint, masked string, n_places int" if masked else "table_name string, row_id bigint, pii_type string, start_pos int, end_pos int"
    return source.mapInArrow(run, schema)
