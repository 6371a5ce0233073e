"""Filling fixed-capacity containers with items: bounded-space online best fit."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.plans.storage import stored

CAPACITY = 2048
OPEN = 64  # open containers of one task
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # fixed value: how byte-level vocabularies split text


def token_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, n_tokens) of each document's whole text; null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        with open(tokenizer, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        coder = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            sizes = [len(coder.encode_ordinary(t)) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], ["doc_id", "n_tokens"])

    source = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null").dropDuplicates(["doc_id"])
    return source.mapInArrow(run, "doc_id bigint, n_tokens bigint")


class BestFit:
    """A fixed number of open containers, kept by free space in a bitset.

    Bit f of ``free`` is set where some open container has f units left, so the smallest space that
    holds an item is one mask and one lowest-bit search. Where none holds it and all places are
    taken, the fullest container is closed.
    """

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most = capacity, most
        self.free = 0
        self.at: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.open = self.made = 0
        self.closed: list[int] = []

    def _put(self, container: int, left: int) -> None:
        if left == 0:
            self.open -= 1
            self.closed.append(container)
            return
        self.at[left].append(container)
        self.free |= 1 << left

    def _take(self, space: int) -> int:
        container = self.at[space].pop()
        if not self.at[space]:
            self.free &= ~(1 << space)
        return container

    def add(self, size: int) -> int:
        fitting = self.free >> size
        if fitting:
            space = size + (fitting & -fitting).bit_length() - 1
            container = self._take(space)
            self._put(container, space - size)
            return container
        if self.open == self.most:
            fullest = (self.free & -self.free).bit_length() - 1
            self.closed.append(self._take(fullest))
            self.open -= 1
        container = self.made
        self.made += 1
        self.open += 1
        self._put(container, self.capacity - size)
        return container

    def left(self) -> dict[int, int]:
        return {c: space for space, cs in enumerate(self.at) for c in cs}


def pack(sizes: DataFrame, capacity: int = CAPACITY, most_open: int = OPEN, per_task: int = 25_000, seed: int = 0) -> DataFrame:
    """(doc_id, piece, start_token, n_tokens, container): each item's container, none over capacity.

    Items longer than ``capacity`` are cut into full pieces and a rest. Tasks pack hash-chosen
    shares of the items side by side; what the last open containers of the tasks hold is
    packed again as blocks until few are left, so open ends do not add up with the number of tasks. Items
    of no tokens go to container -1. Ties: the container opened last. Null sizes count as 0.
    """
    n = sizes.count()
    pieces = sizes.select(
        "doc_id", F.explode(F.expr(f"sequence(0L, greatest(0L, (coalesce(n_tokens, 0L) - 1L) div {capacity}L))")).alias("piece"), F.coalesce("n_tokens", F.lit(0)).alias("all")
    ).select("doc_id", "piece", (F.col("piece") * capacity).alias("start_token"), F.least(F.lit(capacity), F.col("all") - F.col("piece") * capacity).cast("bigint").alias("n_tokens"))
    tasks = max(1, n // per_task)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        bins = BestFit(capacity, most_open)
        # rows leave at once; the state kept is the open containers
        for batch in batches:
            numbers = [bins.add(s) if s else -1 for s in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), batch.column(3), pa.array([f"{task}-{c}" if c >= 0 else "-1" for c in numbers], pa.string())],
                ["doc_id", "piece", "start_token", "n_tokens", "container"],
            )

    spread = pieces.repartition(tasks, F.xxhash64("doc_id", "piece")).sortWithinPartitions(F.xxhash64("doc_id", "piece", F.lit(seed)))
    packed = stored(spread.mapInArrow(run, "doc_id bigint, piece bigint, start_token bigint, n_tokens bigint, container string"))
    # containers at most half full can be merged whole: one block each
    loads = packed.where("container <> '-1'").groupBy("container").agg(F.sum("n_tokens").alias("load"))
    half = loads.where(F.col("load") <= capacity // 2)
    if tasks == 1:
        merged_tasks = 1
    else:
        merged_tasks = max(1, (tasks * most_open) // per_task)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        bins = BestFit(capacity, 4 * most_open)
        for batch in batches:
            numbers = [f"m{task}-{bins.add(s)}" for s in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(numbers, pa.string())], ["container", "joined"])

    joined = half.repartition(merged_tasks, F.xxhash64("container")).sortWithinPartitions(F.desc("load"), "container").mapInArrow(again, "container string, joined string")
    return packed.join(joined, "container", "left").select(
        "doc_id", "piece", "start_token", "n_tokens", F.coalesce("joined", "container").alias("container")
    )
