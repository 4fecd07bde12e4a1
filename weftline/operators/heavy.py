"""Per-key results where a few keys hold most rows: dense accumulator arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.session import written

#: Keys per block of the accumulator, and keys a split encodes before it hands its arrays on.
BLOCK = 4096
FLUSH = 500_000


def _accumulate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Dictionary-encode the keys of an input split and scatter its rows into dense arrays."""
    codes: dict = {}
    counts, sums = np.zeros(BLOCK, np.int64), np.zeros(BLOCK, np.int64)

    def flush() -> pd.DataFrame:
        n = len(codes)
        return pd.DataFrame({"key": pd.Series(list(codes), dtype=object), "n": counts[:n], "total": sums[:n]})

    for pdf in batches:
        # A dictionary, as pandas' factorize takes strings to end at a NUL.
        local = np.fromiter((codes.setdefault(k, len(codes)) for k in pdf["key"]), np.int64, len(pdf))
        if len(codes) > len(counts):
            grow = max(2 * len(counts), len(codes)) - len(counts)
            counts, sums = np.pad(counts, (0, grow)), np.pad(sums, (0, grow))
        counts += np.bincount(local, minlength=len(counts))
        np.add.at(sums, local, pdf["value"].to_numpy(np.int64))
        if len(codes) > FLUSH:
            yield flush()
            codes, counts, sums = {}, np.zeros(BLOCK, np.int64), np.zeros(BLOCK, np.int64)
    if codes:
        yield flush()


def _reduce_block(pdf: pd.DataFrame) -> pd.DataFrame:
    """Sum the pieces of one block of the accumulator."""
    counts, sums = np.zeros(BLOCK, np.int64), np.zeros(BLOCK, np.int64)
    slots = pdf["slot"].to_numpy()
    np.add.at(counts, slots, pdf["n"].to_numpy())
    np.add.at(sums, slots, pdf["total"].to_numpy())
    used = np.unique(slots)
    return pd.DataFrame({"code": pdf["block"].iloc[0] * BLOCK + used, "n": counts[used], "total": sums[used]})


def per_key_totals(df: DataFrame, key: str, value: str) -> DataFrame:
    """``key_name``, ``n_rows``, ``total`` for every key of ``df``, however uneven.

    ``total`` is the sum of ``value`` as integers, null counting 0; the null key
    is a key like any other, and so is an empty string. An empty table gives no
    rows; other columns are ignored, whatever their names.

    Each input split encodes its keys and runs bincount and scatter-add over
    them, so a hot key leaves a split as one row, whatever its share. Distinct
    keys get dense numbers (an offset per range of the sorted keys), the
    splits' arrays are cut into blocks of those numbers, and blocks are summed
    by a distributed reduction.
    """
    split = df.select(F.col(key).cast("string").alias("key"), F.coalesce(F.col(value).cast("long"), F.lit(0)).alias("value"))
    partial = written(split.mapInPandas(_accumulate, "key string, n long, total long"))
    # Null sorts first and is told apart by the flag, so joins below need no null-safe comparison.
    partial = partial.select(F.col("key").isNull().alias("none"), F.coalesce("key", F.lit("")).alias("key"), "n", "total")
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    distinct = written(partial.select("none", "key").distinct().repartitionByRange(parts, "none", "key").sortWithinPartitions("none", "key").select("none", "key", F.spark_partition_id().alias("range"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("place")))
    offsets = distinct.groupBy("range").agg(F.count(F.lit(1)).alias("size"))
    offsets = offsets.select("range", F.coalesce(F.sum("size").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))  # one row per range
    coded = distinct.join(F.broadcast(offsets), "range").select("none", "key", (F.col("offset") + F.col("place")).alias("code"))
    pieces = partial.join(coded, ["none", "key"]).select((F.col("code") / BLOCK).cast("long").alias("block"), F.pmod("code", F.lit(BLOCK)).alias("slot"), "n", "total")
    sums = pieces.groupBy("block").applyInPandas(_reduce_block, "code long, n long, total long")
    return coded.join(sums, "code").select(F.when(~F.col("none"), F.col("key")).alias("key_name"), F.col("n").alias("n_rows"), "total")


def heavy_keys(totals: DataFrame, share: float = 0.01) -> DataFrame:
    """The keys (not null) of ``per_key_totals`` that hold at least ``share`` of all rows, nulls among them."""
    whole = totals.agg(F.sum("n_rows").alias("_whole"))
    return totals.crossJoin(F.broadcast(whole)).where(F.col("key_name").isNotNull() & (F.col("n_rows") >= F.col("_whole") * share)).drop("_whole")
