"""Helpers for Arrow-batched operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.plans.storage import stored


SMALL = 64  # rows of a key that goes the bulk way


def range_tasks(df: DataFrame, rows: int, per_task: int = 40_000, least: int = 1) -> int:
    """Tasks for about ``rows`` rows, a number that follows the data."""
    return max(least, min(100_000, -(-rows // per_task)))


def in_groups(
    df: DataFrame,
    key: str,
    order: list[str],
    tasks: int,
    schema: str,
    fn: Callable[[pa.Table], pa.RecordBatch | None],
    most: int,
    whole: bool = False,
    least: int = 1,
    bulk: Callable[[pa.RecordBatch, np.ndarray, np.ndarray], pa.RecordBatch | None] | None = None,
) -> DataFrame:
    """Apply ``fn`` to the rows of each ``key``, at most ``most`` rows at a time.

    Rows are range-partitioned by (key, *order), so one hot key is spread over as many
    tasks as it needs; within a task a longer group is cut into runs of neighbours in
    ``order``, which acts as a longer key. Memory per call is bounded by ``most``.
    With ``whole`` a key stays in one task: for keys whose size the caller has checked.
    Keys of fewer than ``least`` rows may be passed over. ``bulk``, if given, takes the first rows and the sizes of the keys
    of up to ``SMALL`` rows of a batch at once, in place of one call for each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        held_rows = 0

        def flush(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if parts and (made := fn(pa.Table.from_batches(parts))) is not None and made.num_rows:
                yield made

        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
            edges = np.r_[0, np.flatnonzero(keys[1:] != keys[:-1]) + 1, len(keys)]
            long = np.diff(edges) >= least
            long[[0, -1]] = True  # may go on in the neighbouring batches
            if bulk is not None:
                few = long & (np.diff(edges) <= SMALL)
                few[[0, -1]] = False
                if few.any():
                    if (made := bulk(batch, edges[:-1][few], np.diff(edges)[few])) is not None and made.num_rows:
                        yield made
                    long &= ~few
            for lo, hi in zip(edges[:-1][long].tolist(), edges[1:][long].tolist()):
                if held and (keys[lo] != last):
                    yield from flush(held)
                    held, held_rows = [], 0
                while lo < hi:
                    take = min(hi - lo, most - held_rows)
                    held.append(batch.slice(lo, take))
                    held_rows += take
                    lo += take
                    if held_rows >= most:
                        yield from flush(held)
                        held, held_rows = [], 0
                last = keys[hi - 1]
        yield from flush(held)

    parted = df.repartition(tasks, key) if whole else df.repartitionByRange(tasks, key, *order)
    parted = parted.sortWithinPartitions(key, *order)
    return parted.mapInArrow(run, schema)


def in_whole_groups(
    df: DataFrame,
    counts: DataFrame,
    key: str,
    id_col: str,
    tasks: int,
    schema: str,
    fn: Callable[[pa.Table], pa.RecordBatch | None],
    most: int,
    bulk: Callable[[pa.RecordBatch, np.ndarray, np.ndarray], pa.RecordBatch | None] | None = None,
) -> DataFrame:
    """Apply ``fn`` so that any two rows of a ``key`` meet in some call; keys of one row are passed over.

    counts: (key, count) of every key. A key of at most ``most`` rows is one call. The rows of a longer one are
    dealt by the hash of ``id_col`` into blocks of somewhat less than half of ``most``, and every two blocks
    make one call, so a hot key spreads over tasks and memory per call stays near that of ``most`` rows.
    Repeated rows of an id in a longer key count once.
    """
    long = stored(counts.where(F.col("count") > most).select(key, F.ceil(F.col("count") * 2.2 / most).cast("int").alias("blocks")))
    if long.isEmpty():
        return in_groups(df, key, [id_col], tasks, schema, fn, most, whole=True, least=2, bulk=bulk)
    short = df.join(long, key, "left_anti")
    dealt = df.join(long, key).dropDuplicates([key, id_col]).withColumn("block", F.expr(f"cast(pmod(xxhash64({id_col}, 5), blocks) as int)"))
    dealt = dealt.withColumn("with", F.explode(F.expr("filter(sequence(0, blocks - 1), b -> b <> block)")))
    cell = F.xxhash64(key, F.least("block", "with"), F.greatest("block", "with"))
    dealt = dealt.withColumn(key, cell).select(*df.columns)
    cells = long.agg(F.sum(F.expr("blocks * (blocks - 1) / 2"))).first()[0]
    met = in_groups(dealt, key, [id_col], range_tasks(df, int(cells), 8, 12), schema, fn, 1 << 40, whole=True, least=2, bulk=bulk)
    return in_groups(short, key, [id_col], tasks, schema, fn, most, whole=True, least=2, bulk=bulk).union(met)
