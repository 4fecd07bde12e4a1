"""Joins that survive a key holding a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is hot from this share of the rows on, so there are at most 1 / HOT_SHARE of them.
HOT_SHARE = 0.01


def hot_keys(df: DataFrame, key: str, share: float = HOT_SHARE, total: int | None = None) -> DataFrame:
    """The keys (not null) that at least ``share`` of the rows hold: at most ``1 / share`` rows.

    Counting aggregates before the shuffle, so a hot key costs one row per
    split. ``total`` is the number of rows where it is known already.
    """
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col(key).isNotNull())
    if total is not None:
        return counts.where(F.col("_n") >= total * share).select(key)
    whole = df.agg(F.count(F.lit(1)).alias("_total"))
    return counts.crossJoin(F.broadcast(whole)).where(F.col("_n") >= F.col("_total") * share).select(key)  # whole is one row


def lookup(left: DataFrame, key: str, right: DataFrame, value: str, spread: Column, hot: DataFrame | None = None) -> DataFrame:
    """``left`` with ``right.value`` under the name ``value``, null where nothing matches.

    ``right`` holds one row per key. The values of hot keys (``hot``, or else
    what ``hot_keys`` finds) are broadcast, at most ``1 / HOT_SHARE`` rows; rows with such a key, or with a null key, take part
    in the shuffle under their ``spread`` hash, where they match nothing, so no
    task gets more than its part of them.
    """
    if hot is None:
        hot = hot_keys(left, key)
    hot_values = (
        right.join(F.broadcast(hot), key, "left_semi")
        .select(F.col(key).alias("_hot"), F.struct(F.col(value)).alias("_hot_value"))
    )
    marked = left.join(F.broadcast(hot_values), F.col(key) == F.col("_hot"), "left")
    settled = F.col("_hot").isNotNull() | F.col(key).isNull()
    marked = (
        marked.withColumn("_probe", F.when(~settled, F.col(key)))
        .withColumn("_salt", F.when(settled, F.xxhash64(spread)).otherwise(F.lit(0).cast("long")))
    )
    values = right.select(F.col(key).alias("_rkey"), F.col(value).alias("_value"), F.lit(0).cast("long").alias("_rsalt"))
    joined = marked.join(values, (F.col("_probe") == F.col("_rkey")) & (F.col("_salt") == F.col("_rsalt")), "left")
    found = F.when(F.col("_hot").isNotNull(), F.col("_hot_value").getField(value)).otherwise(F.col("_value"))
    keep = [F.col(c) for c in left.columns if c != value]
    return joined.select(*keep, found.alias(value))
