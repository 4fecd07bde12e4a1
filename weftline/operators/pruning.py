"""Graphs less what is pruned or cut: rounds of spines, short dead ends, and lines that are left."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.sequences import canonical_link
from weftline.operators.components import connected_groups, groups_within
from weftline.operators.graph import half_edges, segment_lengths, tips
from weftline.operators.spines import bubble_regions, spine_ends
from weftline.session import written, written_counted


def between(links: DataFrame, names: DataFrame) -> DataFrame:
    """The links of which both ends are in ``names`` (``name``)."""
    for end in ("from_seg", "to_seg"):
        links = links.join(names.select(F.col("name").alias(end)), end, "left_semi")
    return links


def spine_rounds(links: DataFrame, segments: DataFrame, min_size: int = 1, tolerance: int = 10_000, rescue_bp: int = 100_000, rounds: int = 10) -> tuple[DataFrame, DataFrame]:
    """The decision on every component of every round, and the names kept with their ``comp_id``.

    A round takes the declared segments not yet kept and the links between
    them. Components of fewer than ``min_size`` segments (``too_small``) or two tips
    (``too_few_tips``) stay whole in the first round and are dropped later;
    later rounds drop those with a spine below ``rescue_bp``
    (``below_rescue_threshold``). Of others (``ok``) the bubble region of the spine
    stays. It ends after a round that keeps nothing, or after ``rounds``
    more than the first. A component is named by its round and its least name.
    Only the first round's components are found by contraction; later ones lie within them.
    """
    names = written(segments.where("name is not null").select("name").distinct())
    lengths = written(segment_lengths(segments))
    whole = links.where("from_seg is not null and to_seg is not null")
    decisions, kept = [], []
    for round_no in range(rounds + 1):
        left = reduce(lambda df, done: df.join(done, "name", "left_anti"), kept, names)
        left = written(left)
        inner = written(between(whole, left))
        if round_no:
            groups = written(groups_within(inner, "from_seg", "to_seg", left, "name", whole_groups, "name", "component"))
        else:
            groups = whole_groups = written(connected_groups(inner, "from_seg", "to_seg", left, "name", "name", "component"))
        edges = written(half_edges(inner))
        ends = written(spine_ends(edges, left, groups, lengths, tolerance))
        n_tips = tips(edges, left).select(F.col("node").alias("name"), F.lit(1).alias("tip"))
        sizes = groups.join(n_tips, "name", "left").groupBy("component").agg(F.count(F.lit(1)).alias("size"), F.count("tip").alias("n_tips"))
        facts = sizes.join(ends.drop("n_tips"), "component", "left")
        spine = F.coalesce("spine_bp", F.lit(0).cast("long"))
        status = F.when(F.col("size") < min_size, "too_small").when(F.col("n_tips") < 2, "too_few_tips")
        if round_no:
            status = status.when(spine < rescue_bp, "below_rescue_threshold")
        facts = written(facts.withColumn("status", status.otherwise("ok")))
        shown = F.col("status").isin("ok", "below_rescue_threshold")
        decisions.append(facts.select(
            F.concat(F.lit(f"{round_no}."), "component").alias("comp_id"), F.lit(round_no).alias("round"), "status", "size", "n_tips",
            F.when(shown, F.col("tip_a")).alias("tip1"), F.when(shown, F.col("tip_b")).alias("tip2"), F.when(shown, spine).otherwise(0).alias("spine_len_bp"),
            F.coalesce(shown & F.col("ambiguous"), F.lit(False)).alias("ambiguous"), F.when(shown, F.coalesce("second_bp", F.lit(0))).otherwise(0).alias("second_best_bp")))
        regions = bubble_regions(inner, edges, left, ends.join(facts.where("status = 'ok'").select("component"), "component", "left_semi"), whole_groups)
        if not round_no:
            passed = groups.join(facts.where("status in ('too_small', 'too_few_tips')").select("component"), "component", "left_semi")
            regions = regions.unionByName(passed.select("name", "component"))
        here, n = written_counted(regions.select("name", F.concat(F.lit(f"{round_no}."), "component").alias("comp_id")))
        if not n:
            break
        kept.append(here.select("name"))
        groups_kept = here if round_no == 0 else groups_kept.unionByName(here)
    return reduce(DataFrame.unionByName, decisions), groups_kept if kept else here


def short_dead_ends(edges: DataFrame, lengths: DataFrame) -> DataFrame:
    """``node``, ``exit_side``, ``to_node``, ``to_side`` of half-edges to a neighbour that leads no further, where the same side has a longer neighbour.

    Ties stay.
    """
    sides = edges.select("node", "exit_side", "to_node", "to_side").distinct().where("node <> to_node")
    onward = edges.select(F.col("node").alias("to_node"), (1 - F.col("exit_side")).alias("to_side")).distinct().withColumn("onward", F.lit(True))
    sized = sides.join(onward, ["to_node", "to_side"], "left").join(lengths.select(F.col("name").alias("to_node"), "length"), "to_node", "left").na.fill(0, ["length"])
    longest = sized.groupBy("node", "exit_side").agg(F.max("length").alias("longest"))
    return sized.join(longest, ["node", "exit_side"]).where("onward is null and length < longest").select("node", "exit_side", "to_node", "to_side")


def without_links(links: DataFrame, cut: DataFrame) -> DataFrame:
    """``links`` less those that ``cut`` (half-edges) states from either side."""
    orient = lambda side, plus: F.when(F.col(side) == plus, "+").otherwise("-")
    keys = cut.select(canonical_link("node", orient("exit_side", 1), "to_node", orient("to_side", 0)).alias("_key")).distinct()
    return links.withColumn("_key", canonical_link("from_seg", "from_orient", "to_seg", "to_orient")).join(keys, "_key", "left_anti").drop("_key")
