"""Sequences that begin in one segment and go on in the next."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.sequences import oriented, overlap_length
from weftline.operators.skew import lookup
from weftline.session import written


def kept_sequences(segments: DataFrame) -> DataFrame:
    """``name`` and upper-case ``seq`` of the first declaration (by ``seg_id``) that keeps one."""
    kept = segments.where("name is not null and seq <> '*' and seq <> ''")
    return kept.groupBy("name").agg(F.upper(F.min_by("seq", "seg_id")).alias("seq"))


def forward_extensions(steps: DataFrame, sequences: DataFrame, length: int) -> DataFrame:
    """``node``, ``orient``, ``ext``: the distinct strings of ``length`` bases that follow each oriented segment.

    ``steps`` are oriented (``node``, ``orient``, ``to_node``, ``to_orient``).
    Dead ends give shorter strings, none give no row; segments without
    sequence aren't entered. Strings are grown breadth first, one join a
    round, and equal strings in equal states are merged each round, so there
    are never more than 4 ** ``length`` of them per state for plain bases. Sequences
    go to the steps before anything else, cut to what may be needed.
    """
    short = sequences.select(F.col("name").alias("to_node"), F.col("seq"))
    entered = lookup(steps, "to_node", short, "seq", F.xxhash64("node", "orient")).where("seq is not null")
    bases = F.substring(oriented("seq", "to_orient"), 1, length)
    # Steps that add the same bases and can't go on are one; others stay apart by the state they enter.
    arcs = entered.select("node", "orient", F.when(F.length("seq") < length, F.col("to_node")).alias("at"), F.when(F.length("seq") < length, F.col("to_orient")).alias("at_orient"), bases.alias("bases"))
    arcs = written(arcs.distinct())
    onward = arcs.select(F.col("node").alias("at"), F.col("orient").alias("at_orient"), F.col("at").alias("next"), F.col("at_orient").alias("next_orient"), F.col("bases").alias("more"))
    done, open_ = None, arcs.withColumnRenamed("bases", "ext")
    while True:
        full = open_.where((F.length("ext") >= length) | F.col("at").isNull()).select("node", "orient", F.substring("ext", 1, length).alias("ext"))
        rest = open_.where((F.length("ext") < length) & F.col("at").isNotNull())
        grown = rest.join(onward, ["at", "at_orient"], "left")
        ended = grown.where("more is null").select("node", "orient", "ext")
        done = full.unionByName(ended) if done is None else done.unionByName(full).unionByName(ended)
        longer = grown.where("more is not null").select(
            "node", "orient", F.substring(F.concat("ext", "more"), 1, length).alias("ext"), F.col("next").alias("at"), F.col("next_orient").alias("at_orient"))
        cut = F.length("ext") >= length
        open_ = written(longer.select("node", "orient", "ext", F.when(~cut, F.col("at")).alias("at"), F.when(~cut, F.col("at_orient")).alias("at_orient")).distinct())
        if open_.isEmpty():
            return done.distinct()


def crossing_records(steps: DataFrame, sequences: DataFrame, k: int) -> DataFrame:
    """``node``, ``orient``, ``record``: the end of each oriented segment with what may follow, where that holds a k-mer."""
    following = forward_extensions(steps, sequences, k - 1)
    anchored = lookup(following, "node", sequences.select(F.col("name").alias("node"), "seq"), "seq", F.xxhash64("ext")).where("seq is not null")
    anchor = F.right(oriented("seq", "orient"), F.lit(k - 1))
    return anchored.select("node", "orient", F.concat(anchor, "ext").alias("record")).where(F.length("record") >= k)


def link_sequences(links: DataFrame, sequences: DataFrame) -> DataFrame:
    """``link_id`` and the ``sequence`` of its two steps, the overlap given once.

    A second step no longer than the overlap adds nothing; links to segments without sequence give no row.
    """
    whole = links.where("from_seg is not null and to_seg is not null")
    first = lookup(whole, "from_seg", sequences.select(F.col("name").alias("from_seg"), F.col("seq").alias("first_seq")), "first_seq", F.col("link_id"))
    both = lookup(first, "to_seg", sequences.select(F.col("name").alias("to_seg"), F.col("seq").alias("second_seq")), "second_seq", F.col("link_id"))
    both = both.where("first_seq is not null and second_seq is not null")
    second = oriented("second_seq", "to_orient")
    overlap = overlap_length("overlap")
    added = F.when(overlap < F.length(second), F.right(second, (F.length(second) - overlap).cast("int"))).otherwise("")
    return both.select("link_id", F.concat(oriented("first_seq", "from_orient"), added).alias("sequence"))
