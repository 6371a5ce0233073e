"""Evaluation texts inside training texts: a generalised suffix automaton over the items."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.text import WORD, repaired

LEAST_WORDS = 12  # length of a passage
ONE_IN = 8  # at most one word in so many is altered
SEED = 5  # a passage within the limits has an exact run of at least so many words
BLOCK_WORDS = 400_000  # item words of one automaton, so what is broadcast is bounded

_TAG = re.compile(r"<[^<>\n]{0,80}>")


def tokens(text: str) -> list[tuple[str, int, int]]:
    """Normalised words with their character span in ``text``; mark-up tags count as blanks."""
    masked = _TAG.sub(lambda m: " " * len(m.group()) if not any(ch.isdigit() or ch == "@" for ch in m.group()) else m.group(), text)
    if "Ã" in masked or "Â" in masked:
        return [(unicodedata.normalize("NFC", repaired(x)).lower(), s, e) for x, s, e in _pieces(masked)]
    if masked.isascii() or unicodedata.is_normalized("NFC", masked):
        return [(m.group().lower(), m.start(), m.end()) for m in WORD.finditer(masked)]
    return [(unicodedata.normalize("NFC", x).lower(), s, e) for x, s, e in _pieces(masked)]


_PIECE = re.compile("(?:[^\\W_]|[̀-ͯ\u0080-¿€‘-„†-•‰‹›™ŠšŒœŽžŸƒˆ˜](?<=[ÂÃ].)|[̀-ͯ])+")


def _pieces(text: str) -> list[tuple[str, int, int]]:
    out = []
    for m in _PIECE.finditer(text):
        fixed = repaired(m.group())
        if WORD.fullmatch(unicodedata.normalize("NFC", fixed)):
            out.append((m.group(), m.start(), m.end()))
        else:
            out += [(w.group(), m.start() + w.start(), m.start() + w.end()) for w in WORD.finditer(m.group())]
    return out


class Automaton:
    """Suffix automaton of several word sequences, each ended by its own separator."""

    def __init__(self, fields: list[tuple[int, list[str]]]):
        self.fields = fields
        self.vocabulary: dict[str, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.end = [-1], [0], [-1]
        self.where: list[tuple[int, int]] = []
        last = 0
        for number, (_, sequence) in enumerate(fields):
            for offset, word in enumerate([*sequence, None]):
                symbol = -1 - number if word is None else self.vocabulary.setdefault(word, len(self.vocabulary))
                self.where.append((number, offset))
                last = self._extend(symbol, last, len(self.where) - 1)
        children: list[list[int]] = [[] for _ in self.next]
        for state, parent in enumerate(self.link):
            if parent >= 0:
                children[parent].append(state)
        self.children = children

    def _extend(self, symbol: int, last: int, position: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        state = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        self.end.append(position)
        p = last
        while p >= 0 and symbol not in nxt[p]:
            nxt[p][symbol] = state
            p = link[p]
        if p >= 0:
            q = nxt[p][symbol]
            if length[p] + 1 == length[q]:
                link[state] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                self.end.append(-1)
                while p >= 0 and nxt[p].get(symbol) == q:
                    nxt[p][symbol] = clone
                    p = link[p]
                link[q] = link[state] = clone
        return state

    def ends(self, state: int) -> Iterator[int]:
        stack = [state]
        while stack:
            s = stack.pop()
            if self.end[s] >= 0:
                yield self.end[s]
            stack.extend(self.children[s])

    def matches(self, sequence: list[str], least: int) -> list[tuple[int, int, int]]:
        """(end, length, state) of every longest match of at least ``least`` words that goes no further right."""
        nxt, link, length, ids = self.next, self.link, self.length, self.vocabulary
        out = []
        state = matched = 0
        for i, word in enumerate(sequence):
            symbol = ids.get(word)
            if symbol is None:
                if matched >= least:
                    out.append((i, matched, state))
                state = matched = 0
                continue
            if symbol in nxt[state]:
                state = nxt[state][symbol]
                matched += 1
                continue
            if matched >= least:
                out.append((i, matched, state))
            while state and symbol not in nxt[state]:
                state = link[state]
            matched = length[state]
            if symbol in nxt[state]:
                state = nxt[state][symbol]
                matched += 1
            else:
                state = matched = 0
        if matched >= least:
            out.append((len(sequence), matched, state))
        return out


def _aligned(item: list[str], doc: list[str]) -> list[tuple[int, int, int]]:
    """Cheapest alignment of the item with part of the document, as (item words, altered, document position)."""
    n, m = len(item), len(doc)
    cost = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(1, n + 1):
        row, above, word = cost[i], cost[i - 1], item[i - 1]
        row[0] = i
        for j in range(1, m + 1):
            best = above[j - 1] + (word != doc[j - 1])
            if above[j] + 1 < best:
                best = above[j] + 1
            if row[j - 1] + 1 < best:
                best = row[j - 1] + 1
            row[j] = best
    j = min(range(m + 1), key=lambda x: cost[n][x])
    i, steps = n, []
    while i:
        if j and cost[i][j] == cost[i - 1][j - 1] + (item[i - 1] != doc[j - 1]):
            steps.append((1, int(item[i - 1] != doc[j - 1]), j - 1))
            i, j = i - 1, j - 1
        elif cost[i][j] == cost[i - 1][j] + 1:
            steps.append((1, 1, j - 1 if j else 0))
            i -= 1
        else:
            steps.append((0, 1, j - 1))
            j -= 1
    return steps[::-1]


def _passages(steps: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(first position, last position, words) of passages within the limits that do not overlap, longest first."""
    found, parts = [], [steps]
    while parts:
        part = parts.pop()
        if (best := _passage(part)) is not None:
            lo, hi, length = best
            found.append((part[lo][2], part[hi - 1][2], length))
            parts += [part[:lo], part[hi:]]
    return found


def _passage(steps: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """(first step, step after the last, words) of the longest passage within the limits."""
    size, score = [0], [0]
    for covered, altered, _ in steps:
        size.append(size[-1] + covered)
        score.append(score[-1] + covered - ONE_IN * altered)
    best = None
    for lo in range(len(steps)):
        if steps[lo][1]:
            continue
        for hi in range(len(steps), lo, -1):
            length = size[hi] - size[lo]
            if length < LEAST_WORDS or best and length <= best[2]:
                break
            if not steps[hi - 1][1] and score[hi] >= score[lo]:
                best = (lo, hi, length)
                break
    return best


def passages(automaton: Automaton, sequence: list[str]) -> list[tuple[int, int, int, int]]:
    """(item, first word, last word, item words) of the item passages in ``sequence``, the longest per place."""
    seeds: dict[tuple[int, int], list[int]] = {}
    found: dict[tuple[int, int], tuple[int, int, int, int]] = {}
    for end, length, state in automaton.matches(sequence, SEED):
        for position in automaton.ends(state):
            field, offset = automaton.where[position]
            seeds.setdefault((field, (end - 1 - offset) // 64), []).append(end - 1 - offset)
    for (field, _), starts in seeds.items():
        item, content = automaton.fields[field]
        if len(content) < LEAST_WORDS:
            continue
        lo = max(0, min(starts) - 8)
        region = sequence[lo : max(starts) + len(content) + 8]
        for first, last, length in _passages(_aligned(content, region)):
            key = (item, lo + first)
            row = (item, lo + first, lo + last, length)
            if key not in found or found[key][2] < row[2]:
                found[key] = row
    return sorted(found.values())


def leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, item_id, start_pos, end_pos, n_words, coverage) for every leaked passage.

    The items' questions, answers and contexts form suffix automata of bounded size; the corpus is
    streamed through them once, without a shuffle. coverage is the part of the document's words
    that lies in the passage. Null or empty texts, items and ids: no row. Repeated rows repeat
    their passages. Texts of any length are read whole.
    """
    fields = items.select(
        F.col("item_id").cast("bigint").alias("item_id"),
        F.explode(F.array_compact(F.concat(F.array("question", "answer"), F.coalesce("contexts", F.expr("cast(array() as array<string>)"))))).alias("f"),
    ).where("item_id is not null")
    fields = fields.distinct().withColumn("n", F.size(F.split("f", r"\s+")))
    total = fields.agg(F.sum("n")).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_WORDS))
    source = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null and text is not null")
    schema = "doc_id bigint, item_id bigint, start_pos int, end_pos int, n_words int, coverage double"
    out = None
    for block in range(blocks):
        part = fields.where(F.pmod(F.xxhash64("f"), F.lit(blocks)) == block).orderBy("item_id", "f").select("item_id", "f").collect()
        automaton = Automaton([(r.item_id, [w for w, _, _ in tokens(r.f)]) for r in part])
        shared = docs.sparkSession.sparkContext.broadcast(automaton)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            automaton = shared.value
            for batch in batches:
                rows: list[tuple] = []
                for i, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    spans = tokens(body)
                    for item, first, last, n in passages(automaton, [w for w, _, _ in spans]):
                        rows.append((i, item, spans[first][1], spans[last][2], n, round((last - first + 1) / len(spans), 6)))
                columns = list(zip(*rows)) or [[]] * 6
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c), t) for c, t in zip(columns, kinds)], ["doc_id", "item_id", "start_pos", "end_pos", "n_words", "coverage"]
                )

        made = source.mapInArrow(run, schema)
        out = made if out is None else out.unionByName(made)
    return out


def without_leaks(docs: DataFrame, found: DataFrame, longest: int = LEAST_WORDS, most_coverage: float = 0.5) -> DataFrame:
    """Documents with leaked spans cut out; a document whose covered part exceeds ``most_coverage`` loses its text.

    (doc_id, text, removed): text is null where the document goes as a whole. Spans that several items or repeated rows
    give count once: what is covered is the share of the text's characters in the union of its spans. Spans beyond a text's
    end, as of another text under the same id, are cut there.
    """
    spans = found.where(F.col("n_words") >= longest).groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct("start_pos", "end_pos"))).alias("spans"))
    joined = docs.select("doc_id", "text").distinct().join(spans, "doc_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, removed = [], [], []
            for r in batch.to_pylist():
                body, cut = r["text"], 0
                if body is not None and r["spans"]:
                    keep, at = [], 0
                    for s in r["spans"]:
                        lo, hi = max(at, s["start_pos"]), min(len(body), s["end_pos"])
                        if hi > lo:
                            keep.append(body[at:lo])
                            cut += hi - lo
                            at = hi
                    if cut > most_coverage * len(body):
                        body, cut = None, len(body)
                    else:
                        body = "".join(keep) + body[at:]
                ids.append(r["doc_id"])
                texts.append(body)
                removed.append(cut)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.string()), pa.array(removed, pa.int32())], ["doc_id", "text", "removed"])

    return joined.mapInArrow(run, "doc_id bigint, text string, removed int")
