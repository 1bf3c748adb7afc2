"""Sequences in streams: adjacent events, sessions and late data with watermarks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def sessions(events: DataFrame, key: str, moment: str, gap: str = "15 seconds", late: str = "10 minutes") -> DataFrame:
    """(key, start, end, n_events): runs of a key's events with less than `gap` between them; events later than `late` are dropped, as watermarks do."""
    watched = events.withWatermark(moment, late)
    return watched.groupBy(key, F.session_window(moment, gap).alias("w")).agg(F.count("*").alias("n_events")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n_events")


def windows(events: DataFrame, key: str, moment: str, value: str, size: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    watched = events.withWatermark(moment, late)
    return watched.groupBy(F.window(moment, size).alias("w"), key).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), key, "n", "total")


def first_seen(events: DataFrame, keys: list[str], moment: str, late: str = "10 minutes") -> DataFrame:
    """Each key once, as long as its repeats come within the watermark."""
    return events.withWatermark(moment, late).dropDuplicatesWithinWatermark(keys)


def adjacent(events: DataFrame, key: str, item: str, moment: str, gap_seconds: float, late: str = "10 minutes") -> DataFrame:
    """(key, item_a, item_b, delta): a key's events that follow each other within the gap, in the order of moments.

    The state of a key is its last event; within a micro-batch events are put in order, and
    an event from before the last one seen is left out (it came too late to be adjacent).
    """
    kind = dict(events.dtypes)

    def step(keys: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get if state.exists else None
        rows = []
        every = pd.concat(list(parts)).sort_values(["_t", item])
        for t, i in every[["_t", item]].itertuples(index=False):
            if last is not None and 0 < t - last[0] <= gap_seconds:
                rows.append((keys[0], last[1], i, t - last[0]))
            if last is None or t >= last[0]:
                last = (t, i)
        state.update(last)
        yield pd.DataFrame(rows, columns=[key, "item_a", "item_b", "delta"])

    watched = events.withWatermark(moment, late).withColumn("_t", F.unix_micros(F.col(moment)) / 1e6)
    return watched.groupBy(key).applyInPandasWithState(step, f"{key} {kind[key]}, item_a {kind[item]}, item_b {kind[item]}, delta double", f"t double, i {kind[item]}", "append", GroupStateTimeout.NoTimeout)
