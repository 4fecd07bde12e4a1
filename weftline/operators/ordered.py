"""Running totals over an entity's ordered rows without putting an entity in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_totals(df: DataFrame, keys: list[str], position: str, order: list[str | Column], totals: dict[str, str], following: str | None = None, width: float = 1 << 18, wholes: dict[str, str] | None = None) -> DataFrame:
    """``df`` with sums over all earlier rows of the same ``keys``, and the next row's ``position``.

    ``order`` begins with ``position``, a number that isn't null; ``totals`` maps
    a new column to the column summed in it (earlier rows only, 0 at first), and
    ``wholes`` likewise to that summed over the whole entity.
    Entities are cut into zones of ``width``; sums and first positions of
    zones are put in order first, then only the rows within each zone.
    """
    zoned = df.withColumn("_zone", F.floor(F.col(position) / F.lit(width)).cast("long"))
    by_zone = Window.partitionBy(*keys).orderBy("_zone")
    earlier = by_zone.rowsBetween(Window.unboundedPreceding, -1)
    every, wholes = Window.partitionBy(*keys), wholes or {}
    sums = [F.sum(c).alias(f"_sum_{name}") for name, c in (totals | wholes).items()]
    zones = zoned.groupBy(*keys, "_zone").agg(F.min(position).alias("_first"), *sums).select(
        *(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_zone").alias("_z"), F.lead("_first").over(by_zone).alias("_next_first"),
        *(F.coalesce(F.sum(f"_sum_{name}").over(earlier), F.lit(0)).alias(f"_before_{name}") for name in totals), *(F.sum(f"_sum_{name}").over(every).alias(f"_whole_{name}") for name in wholes))
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)] + [F.col("_zone") == F.col("_z")]
    joined = zoned.join(zones, on)
    within = Window.partitionBy(*keys, "_zone").orderBy(*order)
    out = [F.col(c) for c in df.columns]
    out += [(F.col(f"_before_{name}") + F.coalesce(F.sum(c).over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias(name) for name, c in totals.items()]
    out += [F.col(f"_whole_{name}").alias(name) for name in wholes]
    if following:
        out.append(F.coalesce(F.lead(position).over(within), F.col("_next_first")).alias(following))
    return joined.select(*out)
