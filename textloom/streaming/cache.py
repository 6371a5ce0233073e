"""The semantic cache as a stream: stateful lookup and store, and windowed statistics with late data."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.operators.cache import THETA, Held, decide, placed
from textloom.operators.fuzzy import FuzzyModel

OUT = "epoch string, id bigint, hit boolean, matched bigint, similarity double"


def serve(requests: DataFrame, model: FuzzyModel | None = None, theta: float = THETA) -> DataFrame:
    """Decisions for a stream of (epoch, seq, id, vec).

    One cache per ``epoch``; a new epoch is a flushed cache, so state is bounded by one cache's entries, kept as plain
    arrays. Within a micro-batch requests are taken in order of seq. A null or unusable vector must be left out before.
    """
    shared = requests.sparkSession.sparkContext.broadcast(model)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(frames)).sort_values(["seq", "id"])
        vecs, keys = np.stack(batch.vec.to_numpy()).astype(np.float64), batch.id.to_numpy(np.int64)
        dim = vecs.shape[1]
        held = Held(dim)
        if state.exists:
            unit, own, home = state.get
            held.take(np.frombuffer(unit).reshape(-1, dim), np.frombuffer(own, np.int64), np.frombuffer(home, np.int32))
        unit, routes = placed(vecs, shared.value)
        matched, sims = decide(held, keys, unit, routes, theta)
        state.update((held.unit[: held.n].tobytes(), held.key[: held.n].tobytes(), held.home[: held.n].tobytes()))
        hit = matched >= 0
        rows = {"epoch": key[0], "id": keys, "hit": hit, "matched": pd.array(np.where(hit, matched, 0), "Int64"), "similarity": np.where(hit, np.round(sims, 4), np.nan)}
        yield pd.DataFrame(rows).assign(matched=lambda d: d.matched.where(d.hit))

    return requests.groupBy("epoch").applyInPandasWithState(run, OUT, "unit binary, key binary, home binary", "append", "NoTimeout")


def windowed_stats(log: DataFrame, time: str = "asked_at", width: str = "1 hour", late: str = "3 days") -> DataFrame:
    """(start, requests, hits) per window; requests later than ``late`` are left out, repeated ones within it count once."""
    marked = log.withWatermark(time, late)
    if log.isStreaming:
        marked = marked.dropDuplicatesWithinWatermark(["request_id"])
    else:
        marked = marked.dropDuplicates(["request_id"])
    counted = marked.groupBy(F.window(time, width)).agg(F.count("*").alias("requests"), F.count_if("cache_hit").alias("hits"))
    return counted.select(F.col("window.start").alias("start"), "requests", "hits")
