"""Continuous periods and gaps of intervals that overlap, nest or leave holes, per entity."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.session import written

#: Intervals that a map-side pass keeps before it hands them on.
FLUSH = 500_000
#: Before any position.
FIRST = -(2**63)


class DisjointIntervals:
    """Ordered half-open intervals that neither overlap nor touch, and the gaps between them."""

    __slots__ = ("ends", "gaps", "starts")

    def __init__(self, starts: list[int] | None = None, ends: list[int] | None = None) -> None:
        self.starts: list[int] = list(starts or ())
        self.ends: list[int] = list(ends or ())
        #: Of each interval but the last, the gap behind it.
        self.gaps: list[tuple[int, int]] = list(zip(self.ends, self.starts[1:], strict=False))

    def insert(self, start: int, end: int) -> int:
        """Add an interval, merging what it overlaps or touches and updating the gaps at both sides; how many more intervals there are."""
        starts, ends, gaps = self.starts, self.ends, self.gaps
        if not ends or start > ends[-1]:
            if ends:
                gaps.append((ends[-1], start))
            starts.append(start)
            ends.append(end)
            return 1
        low = bisect_left(ends, start)  # the first one that reaches start
        high = bisect_right(starts, end)  # behind the last one that begins by end
        if low + 1 == high and starts[low] <= start and end <= ends[low]:
            return 0
        if low < high:
            start, end = min(start, starts[low]), max(end, ends[high - 1])
        new = [(ends[low - 1], start)] if low else []
        if high < len(starts):
            new.append((end, starts[high]))
        gaps[max(low - 1, 0) : high] = new
        starts[low:high] = [start]
        ends[low:high] = [end]
        return 1 - (high - low)


def _collapse(keys: list[str]):
    """Merge what lies in one split, entity by entity, so that dense entities shrink before the shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state: dict[tuple, DisjointIntervals] = {}
        held = 0

        def flush() -> pd.DataFrame:
            sizes = [len(m.starts) for m in state.values()]
            out = pd.DataFrame({k: np.repeat(np.array([e[i] for e in state], dtype=object), sizes) for i, k in enumerate(keys)})
            out["s"] = np.fromiter((x for m in state.values() for x in m.starts), np.int64, sum(sizes))
            out["e"] = np.fromiter((x for m in state.values() for x in m.ends), np.int64, sum(sizes))
            return out

        for pdf in batches:
            columns = [pdf[k].to_numpy(dtype=object) for k in keys]
            for *entity, s, e in zip(*columns, pdf["s"].tolist(), pdf["e"].tolist(), strict=True):
                entity = tuple(entity)
                intervals = state.get(entity)
                if intervals is None:
                    intervals = state[entity] = DisjointIntervals()
                held += intervals.insert(s, e)
            if held > FLUSH:
                yield flush()
                state, held = {}, 0
        if state:
            yield flush()

    return run


def _zone_periods(keys: list[str]):
    """Keyed state over rows by entity and zone: the periods that begin in each zone, and the gaps before them.

    The first row of a zone (``kind`` 0) brings in ``e`` how far earlier zones
    reach (null: there are none) and in ``s`` where the entity ends; what they
    cover up to there is the first interval of the zone's map. Rows of
    ``kind`` 1 come in any order.
    """
    names = [*keys, "what", "s", "e", "edge", "entity_end"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        zone, state, reach, entity_end = None, None, None, 0

        def close() -> list[tuple]:
            entity, out = zone[:-1], [(*zone[:-1], "gap", s, e, False, 0) for s, e in state.gaps]
            begun = list(zip(state.starts, state.ends, strict=True))[reach is not None :]
            # The last one may go on in a later zone.
            out += [(*entity, "period", s, e, False, 0) for s, e in begun[:-1]]
            if begun:
                out.append((*entity, "period", *begun[-1], True, entity_end))
            if reach is not None and begun:
                out.append((*entity, "reach", state.ends[0], state.ends[0], True, entity_end))
            return out

        rows: list[tuple] = []
        for pdf in batches:
            columns = [pdf[k].to_numpy(dtype=object) for k in keys]
            for *at, kind, s, e, none in zip(*columns, pdf["zone"].tolist(), pdf["kind"].tolist(), pdf["s"].tolist(), pdf["e"].tolist(), pdf["none"].tolist(), strict=True):
                if kind == 0:
                    if zone is not None:
                        rows += close()
                    zone, state, reach, entity_end = tuple(at), DisjointIntervals(), None if none else e, s
                    if reach is not None:
                        state.insert(min(reach - 1, FIRST), reach)
                else:
                    state.insert(s, e)
            if len(rows) > 100_000:
                yield pd.DataFrame(rows, columns=names)
                rows = []
        if zone is not None:
            rows += close()
        yield pd.DataFrame(rows, columns=names)

    return run


def periods_and_gaps(df: DataFrame, keys: list[str], start: str, end: str, zone_width: int = 1 << 18) -> DataFrame:
    """``keys``, ``kind`` (``period`` or ``gap``), ``pos_start``, ``pos_end`` of half-open integer intervals.

    Touching intervals make no break; gaps lie between successive periods of
    one entity. Rows with a null bound or ``start >= end`` don't count; a null
    key is an entity of its own; repeated rows change nothing; an empty table
    gives no rows; other columns are ignored, whatever their names.

    An ordered disjoint-interval map per entity first collapses each split. An
    entity is then cut into zones of ``zone_width`` by where intervals begin, so
    a hot entity spreads over many tasks; each zone knows from a small table of
    zones how far the earlier ones reach, and keeps its own map of periods and
    gaps in keyed state. Only the last period to begin in each zone, whose end
    a later zone may hold, is put in order over the whole entity.
    """
    columns = [F.col(k).cast("string").alias(f"k{i}") for i, k in enumerate(keys)]
    ks = [f"k{i}" for i in range(len(keys))]
    valid = df.select(*columns, F.col(start).cast("long").alias("s"), F.col(end).cast("long").alias("e")).where("s < e")
    typed = ", ".join(f"{k} string" for k in ks)
    runs = written(valid.mapInPandas(_collapse(ks), f"{typed}, s long, e long").withColumn("zone", F.floor(F.col("s") / F.lit(zone_width)).cast("long")))

    by_zone = Window.partitionBy(*ks).orderBy("zone")
    reach = (
        runs.groupBy(*ks, "zone").agg(F.max("e").alias("zone_end"))
        .select(
            *ks, "zone",
            F.max("zone_end").over(by_zone.rowsBetween(Window.unboundedPreceding, -1)).alias("reach"),
            F.max("zone_end").over(Window.partitionBy(*ks)).alias("entity_end"),
        )
        .select(*ks, "zone", F.lit(0).alias("kind"), F.col("entity_end").alias("s"), F.coalesce("reach", F.lit(0)).alias("e"), F.col("reach").isNull().alias("none"))
    )
    rows = runs.select(*ks, "zone", F.lit(1).alias("kind"), "s", "e", F.lit(False).alias("none")).unionByName(reach)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartition(parts, *ks, "zone").sortWithinPartitions(*ks, "zone", "kind")
    found = written(ordered.mapInPandas(_zone_periods(ks), f"{typed}, what string, s long, e long, edge boolean, entity_end long"))

    # A period that is the last to begin in its zone ends where earlier zones reach when the next one begins.
    # (Each such row is followed by that of the next such zone's reach.)
    next_reach = F.lead("s").over(Window.partitionBy(*ks).orderBy("s"))
    ends = found.where("edge").withColumn("e", F.when(F.col("what") == "period", F.coalesce(next_reach, F.col("entity_end"))).otherwise(F.col("e")))
    both = found.where("not edge").unionByName(ends.where("what = 'period'")).select(*ks, F.struct(F.col("what").alias("kind"), F.col("s").alias("pos_start"), F.col("e").alias("pos_end")).alias("x"))
    types = dict(df.select(*keys).dtypes)
    return both.select(*(F.col(k).cast(types[name]).alias(name) for k, name in zip(ks, keys, strict=True)), "x.kind", "x.pos_start", "x.pos_end")
