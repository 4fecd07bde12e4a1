"""References to records that don't exist, with the reason."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.intervals import periods_and_gaps
from weftline.operators.skew import hot_keys, lookup
from weftline.session import written

FOREVER = 2**62
#: Copies of what lived in a zone of a hot key, and so parts of its references there.
SALTS = 32
WEEK = 7 * 24 * 3600 * 1_000_000
MATCHES = ("simple", "full", "partial")


def _masks(n_keys: int, match: str) -> list[tuple[bool, ...]]:
    """The null masks whose references are looked for: others are no references, or orphans whatever there is."""
    every = list(product((False, True), repeat=n_keys))
    return [m for m in every if not all(m) and (match == "partial" or not any(m))]


def _of_masks(df: DataFrame, keys: list[str], match: str) -> DataFrame:
    """``df`` once for each mask that its keys can answer, with the struct ``_key`` of the mask and the columns it compares."""
    masked = [
        F.struct(F.lit("".join("1" if null else "0" for null in mask)).alias("mask"), *((F.lit(None).cast("string") if null else F.col(k).cast("string")).alias(f"k{i}") for i, (k, null) in enumerate(zip(keys, mask, strict=True))))
        for mask in _masks(len(keys), match)
    ]
    there = lambda key: ~F.exists(F.array(*(key.getField(f"k{i}").isNull() & (F.substring(key.mask, i + 1, 1) == "0") for i in range(len(keys)))), lambda x: x)
    return df.withColumn("_key", F.explode(F.filter(F.array(*masked), there)))


def _alive_at(refs: DataFrame, alive: DataFrame, hot: DataFrame) -> DataFrame:
    """``refs`` (``_key``, ``_at``) with ``_there``: whether a period of ``alive`` (``_key``, ``pos_start``, ``pos_end``, disjoint) holds the time.

    The last period begun decides. Keys are cut into zones of a week; each zone
    knows from a small table of zones what was last begun before it, and only
    rows of a zone are put in order. Zones of hot keys are spread over SALTS,
    with a copy of what begins in them each.
    """
    zone = lambda c: F.floor(F.col(c) / F.lit(WEEK)).cast("long").alias("_zone")
    is_hot = F.broadcast(hot.select("_key", F.lit(True).alias("_is_hot")))
    every = F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))
    none = F.array(F.lit(0).cast("long"))
    begun = alive.select("_key", zone("pos_start"), "pos_start", "pos_end")
    asked = refs.withColumn("_zone", zone("_at"))
    by_zone = Window.partitionBy("_key").orderBy("_zone").rowsBetween(Window.unboundedPreceding, -1)
    zones = begun.groupBy("_key", "_zone").agg(F.max("pos_end").alias("_last"))  # disjoint: the last begun ends last
    zones = zones.unionByName(asked.select("_key", "_zone", F.lit(None).cast("long").alias("_last"))).groupBy("_key", "_zone").agg(F.max("_last").alias("_last"))
    carried = zones.select("_key", "_zone", F.max("_last").over(by_zone).alias("pos_end")).where("pos_end is not null")
    # What is carried into a zone was begun at its start, before anything in it.
    starts = begun.select("_key", "_zone", F.col("pos_start").alias("_when"), F.lit(1).alias("_kind"), "pos_end").unionByName(
        carried.select("_key", "_zone", (F.col("_zone") * WEEK).alias("_when"), F.lit(0).alias("_kind"), "pos_end"))
    starts = starts.join(is_hot, "_key", "left").select("_key", "_zone", F.explode(F.when(F.col("_is_hot"), every).otherwise(none)).alias("_salt"), "_when", "_kind", "pos_end")
    asked = asked.join(is_hot, "_key", "left").withColumn("_salt", F.when(F.col("_is_hot"), F.pmod(F.xxhash64("_row"), F.lit(SALTS))).otherwise(F.lit(0).cast("long"))).drop("_is_hot")
    rows = asked.withColumn("_when", F.col("_at")).withColumn("_kind", F.lit(2)).unionByName(starts, allowMissingColumns=True)
    upto = Window.partitionBy("_key", "_zone", "_salt").orderBy("_when", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    seen = rows.withColumn("_until", F.last("pos_end", ignorenulls=True).over(upto)).where("_kind = 2")
    return seen.withColumn("_there", F.coalesce(F.col("_until") > F.col("_at"), F.lit(False))).drop("_zone", "_salt", "_when", "_kind", "pos_end", "_until")


def orphan_references(refs: DataFrame, ref_keys: list[str], parents: DataFrame, parent_keys: list[str], match: str = "simple", at: str | None = None, life: tuple[str, str] | None = None) -> DataFrame:
    """The rows of ``refs`` whose composite key names no row of ``parents``, or none alive at the time.

    References are grouped by which key columns are null, and each group is
    anti-joined on the others. ``match`` says what nulls mean, as in the SQL
    standard: ``simple`` (any null: no reference), ``full`` (all null: no
    reference; some null: an orphan) or ``partial`` (all null: no reference;
    otherwise the columns that aren't null must match some parent). With ``at``
    (a column of ``refs``) and ``life`` (two of ``parents``, all three integers that aren't null) only
    parents with begin <= at < end count. Keys are compared as text. An empty table gives no rows, repeated rows all come out.
    Other columns of ``refs`` are kept and those of ``parents`` ignored, whatever their names.

    The mask is part of the key, so one join serves all masks and references
    are read once; parents are reduced to distinct keys of each mask first, or
    to disjoint lives. Hot keys of any mask, 100 at most, don't meet in a task.
    """
    if match not in MATCHES:
        raise ValueError(f"unknown match semantics: {match}")
    named = lambda c: F.col(f"`{c}`")
    null = [named(k).isNull() for k in ref_keys]
    some, whole = F.exists(F.array(*null), lambda x: x), F.forall(F.array(*null), lambda x: x)
    mask = F.concat(*(n.cast("int").cast("string") for n in null))
    fields, held = [f"k{i}" for i in range(len(ref_keys))], [f"c{i}" for i in range(len(refs.columns))]
    key = F.struct(mask.alias("mask"), *(named(k).cast("string").alias(f) for f, k in zip(fields, ref_keys, strict=True)))
    # Under names of our own, as the columns of the tables may have any.
    asked = refs.where(~(some if match == "simple" else whole)).select(
        *(named(c).alias(h) for h, c in zip(held, refs.columns, strict=True)), key.alias("_key"), F.monotonically_increasing_id().alias("_row"), (named(at).cast("long") if at else F.lit(None)).alias("_at"))
    having = [named(k).alias(f) for f, k in zip(fields, parent_keys, strict=True)]
    hopeless = (F.col("_key.mask") != "0" * len(ref_keys)) if match == "full" else F.lit(False)
    if at is None or life is None:
        known = _of_masks(parents.select(*having), fields, match).select("_key").distinct().withColumn("_there", F.lit(True))
        told = lookup(asked, "_key", known, "_there", F.col("_row"))
    else:
        begin, end = life
        lives = _of_masks(parents.select(*having, named(begin).alias("_begin"), named(end).alias("_end")), fields, match)
        merged = periods_and_gaps(lives.select("_key.*", "_begin", "_end"), ["mask", *fields], "_begin", "_end", WEEK).where("kind = 'period'")
        alive = merged.select(F.struct("mask", *fields).alias("_key"), "pos_start", "pos_end")
        told = _alive_at(asked, alive, hot_keys(asked, "_key"))
    return told.where(hopeless | F.col("_there").isNull() | ~F.col("_there")).select(*(F.col(h).alias(c) for h, c in zip(held, refs.columns, strict=True)))


def dangling_ends(links: DataFrame, segments: DataFrame, ends: tuple[str, ...] = ("from_seg", "to_seg")) -> DataFrame:
    """``link_id``, ``ref_field``, ``reason``, ``period`` of each end that had no valid segment when its link arrived.

    Match semantics are simple, by name and time: a null end is no reference. ``missing``: no
    segment ever has the name; ``late``: all that have it arrived after the
    link; ``deleted``: all that had arrived were deleted by then. ``period`` is
    the month in which the link arrived, as 2024-01 (null if unknown). A
    segment of unknown arrival counts as always there, a link of unknown
    arrival as arriving last of all; repeated segments add nothing.
    """
    refs = links.select(
        "link_id",
        F.coalesce(F.unix_micros(F.col("loaded_at").cast("timestamp")), F.lit(FOREVER - 1)).alias("at"),
        F.date_format("loaded_at", "yyyy-MM").alias("period"),
        F.explode(F.array(*(F.struct(F.lit(e).alias("ref_field"), F.col(e).alias("name")) for e in ends))).alias("end"),
    ).select("link_id", "at", "period", "end.ref_field", "end.name")
    lives = segments.where("name is not null").select(
        "name",
        F.coalesce(F.unix_micros(F.col("loaded_at").cast("timestamp")), F.lit(-FOREVER)).alias("born"),
        F.coalesce(F.unix_micros(F.col("deleted_at").cast("timestamp")), F.lit(FOREVER)).alias("died"),
    )
    orphans = written(orphan_references(refs, ["name"], lives, ["name"], "simple", "at", ("born", "died")))  # read for its hot keys too
    first = lives.groupBy("name").agg(F.min("born").alias("first_born"))
    told = lookup(orphans, "name", first, "first_born", F.col("link_id"))
    reason = F.when(F.col("first_born").isNull(), "missing").when(F.col("first_born") > F.col("at"), "late").otherwise("deleted")
    return told.select("link_id", "ref_field", reason.alias("reason"), "period")
