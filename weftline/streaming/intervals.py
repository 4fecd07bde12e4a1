"""Periods of intervals that arrive as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from weftline.operators.intervals import DisjointIntervals

STATE = "starts array<long>, ends array<long>"


def streamed_periods(stream: DataFrame, keys: list[str], start: str, end: str, zone_width: int = 1 << 22) -> DataFrame:
    """Update stream of ``keys``, ``zone``, ``starts``, ``ends``, ``gap_starts``, ``gap_ends``: what is covered in each zone that new intervals touched, and the gaps between.

    Intervals may come in any order and repeatedly; nothing is late, as every
    arrival only adds cover. Rows with a null bound or ``start >= end`` don't
    count. The state of a key is an ordered disjoint-interval map per zone of
    ``zone_width``, at whose borders intervals are cut, so that a hot entity
    spreads over its zones and no state grows beyond half a zone's positions.
    Readers join periods that touch at a border with ``periods_and_gaps``.
    """
    s, e = F.col(start).cast("long"), F.col(end).cast("long")
    valid = stream.select(*(F.col(k).cast("string").alias(k) for k in keys), s.alias("s"), e.alias("e")).where("s < e")
    zones = F.sequence(F.floor(F.col("s") / zone_width), F.floor((F.col("e") - 1) / zone_width))
    cut = valid.withColumn("zone", F.explode(zones)).select(
        *keys, "zone", F.greatest("s", F.col("zone") * zone_width).alias("s"), F.least("e", (F.col("zone") + 1) * zone_width).alias("e"))

    def insert(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        intervals = DisjointIntervals(*(map(int, x) for x in state.get)) if state.exists else DisjointIntervals()
        for pdf in batches:
            for a, b in zip(pdf["s"].tolist(), pdf["e"].tolist(), strict=True):
                intervals.insert(a, b)
        state.update((intervals.starts, intervals.ends))
        yield pd.DataFrame([(*key, intervals.starts, intervals.ends, *([g[i] for g in intervals.gaps] for i in (0, 1)))], columns=[*keys, "zone", "starts", "ends", "gap_starts", "gap_ends"])

    typed = ", ".join(f"{k} string" for k in keys)
    return cut.groupBy(*keys, "zone").applyInPandasWithState(insert, f"{typed}, zone long, starts array<long>, ends array<long>, gap_starts array<long>, gap_ends array<long>", STATE, "update", GroupStateTimeout.NoTimeout)
