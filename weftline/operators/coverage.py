"""What alignments cover of their targets, how deep, and what they leave out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators.intervals import periods_and_gaps
from weftline.operators.ordered import running_totals


def on_targets(alignments: DataFrame, targets: DataFrame) -> DataFrame:
    """``tname``, ``tstart``, ``tend`` of the alignments that lie on a known target, cut to its length."""
    lengths = targets.select(F.col("tname").alias("_t"), F.col("tlen").alias("_len"))
    cut = alignments.where("tstart >= 0 and tstart < tend").join(lengths, F.col("tname") == F.col("_t"))
    return cut.select("tname", "tstart", F.least("tend", "_len").alias("tend")).where("tstart < tend")


def covered(placed: DataFrame) -> DataFrame:
    """Overlapping and touching intervals merged, per target."""
    return periods_and_gaps(placed, ["tname"], "tstart", "tend").where("kind = 'period'").drop("kind")


def uncovered(placed: DataFrame, targets: DataFrame) -> DataFrame:
    """What no interval covers between 0 and the end of each target; all of a target without intervals."""
    parts = periods_and_gaps(placed, ["tname"], "tstart", "tend")
    ends = parts.where("kind = 'period'").groupBy("tname").agg(F.min("pos_start").alias("first"), F.max("pos_end").alias("last"))
    rims = targets.select("tname", "tlen").join(ends, "tname", "left").select("tname", F.explode(F.array(
        F.struct(F.lit(0).cast("long").alias("pos_start"), F.coalesce("first", "tlen").alias("pos_end")),
        F.struct(F.col("last").alias("pos_start"), F.col("tlen").alias("pos_end")),
    )).alias("x")).select("tname", "x.*").where("pos_start < pos_end")
    return parts.where("kind = 'gap'").drop("kind").unionByName(rims)


def depth_profile(placed: DataFrame, targets: DataFrame) -> DataFrame:
    """``tname``, ``pos_start``, ``pos_end``, ``depth``: how many intervals lie on each stretch, 0 included.

    Stretches are as long as their depth allows. Starts and ends become events
    that are summed per position before anything is put in order, so a deep
    target costs no more than its positions.
    """
    rims = targets.where("tlen > 0").select("tname", F.explode(F.array(F.lit(0).cast("long"), F.col("tlen"))).alias("pos"), F.lit(0).cast("long").alias("delta"), F.lit(1).alias("rim"))
    events = placed.select("tname", F.explode(F.array(F.struct(F.col("tstart").alias("pos"), F.lit(1).cast("long").alias("delta")), F.struct(F.col("tend").alias("pos"), F.lit(-1).cast("long").alias("delta")))).alias("e"))
    events = events.select("tname", "e.pos", "e.delta", F.lit(0).alias("rim")).unionByName(rims)
    changes = events.groupBy("tname", "pos").agg(F.sum("delta").alias("delta"), F.max("rim").alias("rim")).where("delta <> 0 or rim = 1")
    profile = running_totals(changes, ["tname"], "pos", ["pos"], {"earlier": "delta"}, "pos_end")
    return profile.where("pos_end is not null").select("tname", F.col("pos").alias("pos_start"), "pos_end", (F.col("earlier") + F.col("delta")).alias("depth"))


def coverage_summary(placed: DataFrame, targets: DataFrame, min_gap: int = 1000) -> DataFrame:
    """Per target: covered and uncovered bases, gaps of ``min_gap`` on, and depth; targets without intervals too."""
    bases = covered(placed).groupBy("tname").agg(F.sum(F.col("pos_end") - F.col("pos_start")).alias("covered_bp"))
    gaps = uncovered(placed, targets).where(F.col("pos_end") - F.col("pos_start") >= min_gap).groupBy("tname").agg(
        F.count(F.lit(1)).alias("n_gaps_filt"), F.max(F.col("pos_end") - F.col("pos_start")).alias("largest_gap"))
    span = F.col("pos_end") - F.col("pos_start")
    deep = depth_profile(placed, targets).groupBy("tname").agg(
        F.sum(F.col("depth") * span).alias("depth_bp"), F.max("depth").alias("max_depth"), F.sum(F.when(F.col("depth") >= 2, span).otherwise(0)).alias("bp_depth_ge2"))
    joined = targets.select("tname", "tlen").join(bases, "tname", "left").join(gaps, "tname", "left").join(deep, "tname", "left").na.fill(0)
    per_length = lambda c: F.when(F.col("tlen") > 0, F.col(c) / F.col("tlen")).otherwise(0.0)
    return joined.select(
        F.col("tname").alias("chrom"), F.col("tlen").alias("chrom_len"), "covered_bp", (F.col("tlen") - F.col("covered_bp")).alias("uncovered_bp"),
        F.round(100 * per_length("covered_bp"), 6).alias("pct_covered"), "n_gaps_filt", "largest_gap", F.round(per_length("depth_bp"), 6).alias("mean_depth"),
        "max_depth", "bp_depth_ge2", F.round(100 * per_length("bp_depth_ge2"), 6).alias("pct_depth_ge2"))


def coverage_totals(summary: DataFrame) -> DataFrame:
    """One row over all targets of a ``coverage_summary``."""
    return summary.agg(
        F.sum("chrom_len").alias("ref_bp"), F.sum("covered_bp").alias("covered_bp"), F.sum("uncovered_bp").alias("uncovered_bp"),
        F.sum("n_gaps_filt").alias("n_gaps"), F.sum("bp_depth_ge2").alias("bp_depth_ge2"), F.max("max_depth").alias("max_depth"))
