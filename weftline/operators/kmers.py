"""k-mers of segments, and the depth that reads give them."""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions.sequences import canonical_kmer, kmers, reverse_complement
from weftline.operators.ordered import running_totals
from weftline.session import written

#: The longest k-mer whose number fits 62 bits; windows of a piece, and of a run, at most.
PACKED, PIECE, LONGEST = 31, 4096, 64
#: Spreads numbers over 64 bits, so that the least is no favourite of poor sequences.
MIX = np.uint64(0x9E3779B97F4A7C15)
#: The digit of each byte, -1 for what isn't a base.
DIGITS = np.full(256, -1, np.int64)
DIGITS[list(b"ACGTacgt")] = [0, 1, 2, 3] * 2
COMPLEMENT = str.maketrans("ACGT", "TGCA")


def segment_records(segments: DataFrame, k: int) -> DataFrame:
    """Declarations that keep a sequence of ``k`` bases or more: ``seg_id``, ``name``, ``seq``, ``n_kmers``."""
    return segments.where((F.col("seq") != "*") & (F.length("seq") >= k)).select("seg_id", "name", "seq", (F.length("seq") - (k - 1)).alias("n_kmers"))


def canonical_kmers(df: DataFrame, seq: str, k: int, *keep: str) -> DataFrame:
    """A row per position: ``keep`` and the canonical ``kmer`` there."""
    return df.where(F.col(seq) != "*").select(*keep, F.explode(kmers(seq, k)).alias("kmer")).withColumn("kmer", canonical_kmer("kmer"))


def kmer_counts(df: DataFrame, seq: str, k: int) -> DataFrame:
    """``kmer`` and its ``n`` positions."""
    return canonical_kmers(df, seq, k).groupBy("kmer").agg(F.count(F.lit(1)).alias("n"))


def _packed(digits: np.ndarray, k: int) -> np.ndarray:
    """The smaller of the numbers, base 4, of every window of ``k`` digits and of its reverse complement."""
    forward, back, n = digits, 3 - digits, 1
    for bit in f"{k:b}"[1:]:
        m = len(forward) - n
        forward, back, n = (forward[:m] << 2 * n) | forward[n:], back[:m] | (back[n:] << 2 * n), 2 * n
        if bit == "1":
            m = len(forward) - 1
            forward, back, n = (forward[:m] << 2) | digits[n : n + m], back[:m] | ((3 - digits[n : n + m]) << 2 * n), n + 1
    return np.minimum(forward, back)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` values in a row."""
    n = 1
    while 2 * n <= width:
        values, n = np.minimum(values[: len(values) - n], values[n:]), 2 * n
    return np.minimum(values[: len(values) - (width - n)], values[width - n :])


def _runs(batch: pa.RecordBatch, k: int) -> pa.RecordBatch:
    """A row per run of neighbouring windows of ``piece`` that share ``meet``, the least mixed number of the shorter k-mers within, either strand; the other columns are repeated.

    ``bases`` has the run's ``windows``. A window with other letters than ACGT has a row to itself, with ``windows`` 0 and its canonical
    text as ``bases``. All windows of one canonical k-mer share ``meet``. Pieces have ``k`` characters or more.
    """
    pieces = batch.column("piece").to_pylist()
    bases = "".join(pieces)
    counts = np.fromiter(map(len, pieces), np.int64, len(pieces)) - (k - 1)
    of = np.repeat(np.arange(len(pieces)), counts)
    at = np.arange(len(of)) + of * (k - 1)  # every piece before has k - 1 more characters than windows
    digits, part = DIGITS[np.frombuffer(bases.encode("ascii", "replace"), np.uint8)], min((k + 1) // 2, PACKED)
    others = np.concatenate(([0], np.cumsum(digits < 0)))
    odd = others[at + k] > others[at]
    mixed = _packed(np.maximum(digits, 0), part).astype(np.uint64) * MIX
    meet = _least(((mixed ^ (mixed >> np.uint64(29))) >> np.uint64(1)).astype(np.int64), k - part + 1)[at]
    new = odd | ((np.arange(len(of)) - (np.cumsum(counts) - counts)[of]) % LONGEST == 0)
    new[1:] |= odd[:-1] | (meet[1:] != meet[:-1])
    first = np.flatnonzero(new)
    windows = np.diff(np.append(first, len(at)))
    strings = [bases[i:j].upper() for i, j in zip(at[first].tolist(), (at[first] + windows + (k - 1)).tolist(), strict=True)]
    for i in np.flatnonzero(odd[first]).tolist():
        strings[i], windows[i] = min(strings[i], strings[i][::-1].translate(COMPLEMENT)), 0
        meet[first[i]] = crc32(strings[i].encode())
    kept = batch.drop_columns(["piece"])
    columns = [*(c.take(pa.array(of[first])) for c in kept.columns), pa.array(meet[first], pa.int64()), pa.array(windows, pa.int32()), pa.array(strings, pa.string())]
    return pa.RecordBatch.from_arrays(columns, [*kept.schema.names, "meet", "windows", "bases"])


def met_kmers(df: DataFrame, seq: str, k: int, totals: list[str]) -> DataFrame:
    """A row per position of every distinct sequence: the other columns, the canonical ``kmer``, and what all rows of it ``meet`` on.

    Sequences are cut into pieces that share ``k - 1`` characters. Equal pieces
    with equal columns become one, with the sums of ``totals``. Runs of neighbouring k-mers are
    shuffled by ``meet``, a few bytes a k-mer, and k-mers are made of them behind
    the shuffle; what is grouped by ``meet`` and ``kmer`` needs no other.
    """
    keep = [c for c in df.columns if c != seq and c not in totals]
    starts = F.sequence(F.lit(1), F.greatest(F.length(seq) - (k - 1), F.lit(1)), F.lit(PIECE))
    cut = F.transform(starts, lambda i: F.substring(F.col(seq), i, F.lit(PIECE + k - 1)))
    pieces = df.where((F.col(seq) != "*") & (F.length(seq) >= k)).select(*keep, *totals, F.explode(cut).alias("piece"))
    distinct = pieces.groupBy(*keep, "piece").agg(*(F.sum(c).alias(c) for c in totals))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # About as many characters at a time as make a megabyte of codes, one piece at least.
            ends = np.cumsum(np.fromiter((len(x.as_py()) for x in batch.column("piece")), np.int64, len(batch)))
            first = 0
            while first < len(batch):
                last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + (1 << 17))))
                yield _runs(batch.slice(first, last - first), k)
                first = last

    fields = [T.StructField("meet", T.LongType()), T.StructField("windows", T.IntegerType()), T.StructField("bases", T.StringType())]
    runs = distinct.mapInArrow(run, T.StructType([*(f for f in distinct.schema if f.name != "piece"), *fields])).repartition("meet")
    every = runs.withColumn("back", reverse_complement("bases")).withColumn("i", F.explode(F.sequence(F.lit(1), F.greatest("windows", F.lit(1)))))
    either = F.least(F.substring("bases", F.col("i"), F.lit(k)), F.substring("back", F.col("windows") + 1 - F.col("i"), F.lit(k)))
    return every.select(*keep, *totals, "meet", F.when(F.col("windows") == 0, F.col("bases")).otherwise(either).alias("kmer"))


def node_depths(segments: DataFrame, reads: DataFrame, k: int) -> DataFrame:
    """Per segment name: total, median and mean of the depths given to its k-mer positions, and how many there are.

    ``reads`` has sequences ``seq`` and how often each was read, ``n`` (a table of k-mer
    counts is one). The count of a k-mer (0 if it wasn't read) is shared equally by all
    its positions, those of nameless segments too. Positions and reads go through one shuffle,
    as runs, and are counted where they meet; equal sequences of a name are one
    before that, so a hot name isn't spread over rows. Nothing joins on k-mers, so no plan can broadcast them.
    The total is rounded half to even; names without positions have zeros.
    """
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    both = segments.select("name", "seq", one.alias("times"), zero.alias("reads")).unionByName(reads.select(F.lit(None).cast("string").alias("name"), "seq", zero.alias("times"), F.col("n").cast("long").alias("reads")))
    kmer = Window.partitionBy("meet", "kmer")
    met = met_kmers(both, "seq", k, ["times", "reads"]).select("name", "times", F.sum("reads").over(kmer).alias("read"), F.sum("times").over(kmer).alias("positions"))
    shares = met.where("name is not null").select("name", "times", (F.col("read") / F.col("positions")).alias("share"))
    given = written(shares.groupBy("name", "share").agg(F.sum("times").alias("times")))
    # The middle position, or both middle ones, by running totals over the distinct shares of a name.
    ordered = running_totals(given.hint("merge"), ["name"], "share", ["share"], {"before": "times"}, width=1 / 64, wholes={"kn": "times"})
    middle = (2 * F.col("before") <= F.col("kn")) & (2 * (F.col("before") + F.col("times")) >= F.col("kn"))
    pooled = ordered.groupBy("name").agg(
        F.sum(F.col("share") * F.col("times")).alias("total"), ((F.min(F.when(middle, F.col("share"))) + F.max(F.when(middle, F.col("share")))) / 2).alias("median"), F.max("kn").alias("kn"))
    names = segments.where("name is not null").select("name").distinct()
    every = names.join(pooled.hint("merge"), "name", "left")
    filled = lambda c: F.coalesce(c, F.lit(0.0))
    return every.select(
        "name", F.rint(F.round(filled(F.col("total")), 6)).cast("long").alias("kc"), F.round(filled(F.col("median")), 4).alias("dp"),
        F.round(filled(F.col("total") / F.col("kn")), 4).alias("ad"), F.coalesce("kn", zero).alias("kn"))
