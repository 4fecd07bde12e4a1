"""Assembly graphs as tables of links: sides, degrees, tips, bubbles, layers, components."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.sequences import canonical_link, entry_side, exit_side, orient_of_exit, overlap_length
from weftline.operators.components import connected_groups
from weftline.operators.skew import hot_keys, lookup
from weftline.session import written, written_counted


def whole_links(links: DataFrame) -> DataFrame:
    """Links with both ends."""
    return links.where("from_seg is not null and to_seg is not null")


def segment_lengths(segments: DataFrame) -> DataFrame:
    """``name`` and ``length``: the longest of its declarations, null lengths counting 0."""
    return segments.where("name is not null").groupBy("name").agg(F.max(F.coalesce("seg_len", F.lit(0).cast("long"))).alias("length"))


def canonical_links(links: DataFrame) -> DataFrame:
    """One row per link whichever side states it: ``a``, ``oa``, ``b``, ``ob``, how often it was sent, and its first id."""
    key = canonical_link("from_seg", "from_orient", "to_seg", "to_orient")
    return whole_links(links).withColumn("_k", key).groupBy("_k").agg(F.count(F.lit(1)).alias("n_sent"), F.min("link_id").alias("first_link")).select("_k.*", "n_sent", "first_link")


def half_edges(links: DataFrame) -> DataFrame:
    """Two rows per link: ``node``, ``exit_side``, ``to_node``, ``to_side``, ``overlap_bp``, ``link_id``."""
    bp = overlap_length("overlap")
    forward = F.struct(F.col("from_seg").alias("node"), exit_side("from_orient").alias("exit_side"), F.col("to_seg").alias("to_node"), entry_side("to_orient").alias("to_side"))
    back = F.struct(F.col("to_seg").alias("node"), entry_side("to_orient").alias("exit_side"), F.col("from_seg").alias("to_node"), exit_side("from_orient").alias("to_side"))
    return whole_links(links).select("link_id", bp.alias("overlap_bp"), F.explode(F.array(forward, back)).alias("h")).select("h.*", "overlap_bp", "link_id")


def side_degrees(edges: DataFrame) -> DataFrame:
    """Half-edges of each side of every node that has any, and distinct neighbours other than itself."""
    counts = edges.groupBy("node").agg(F.sum((F.col("exit_side") == 0).cast("long")).alias("left_degree"), F.sum((F.col("exit_side") == 1).cast("long")).alias("right_degree"))
    return counts.join(neighbour_counts(edges), "node", "left").na.fill(0, ["n_neighbours"])


def neighbour_counts(edges: DataFrame) -> DataFrame:
    """Distinct neighbours of each node other than itself, and the least and greatest of them."""
    pairs = edges.where("node <> to_node").select("node", "to_node").distinct()
    return pairs.groupBy("node").agg(F.count(F.lit(1)).alias("n_neighbours"), F.min("to_node").alias("least"), F.max("to_node").alias("greatest")).select("node", "n_neighbours", "least", "greatest")


def tips(edges: DataFrame, segments: DataFrame) -> DataFrame:
    """Declared segments with half-edges on exactly one side: ``node`` and the ``open_side``.

    Only links between declared segments count; isolated segments are no tips.
    """
    names = segments.where("name is not null").select(F.col("name").alias("node")).distinct()
    inner = edges.join(names, "node", "left_semi").join(names.withColumnRenamed("node", "to_node"), "to_node", "left_semi")
    sides = inner.groupBy("node").agg(F.min("exit_side").alias("low"), F.max("exit_side").alias("high"))
    return sides.where("low = high").select("node", (1 - F.col("low")).alias("open_side"))


def bubble_members(edges: DataFrame, segments: DataFrame) -> DataFrame:
    """Declared segments with exactly two neighbours that share both with another one: ``node``, ``end_a``, ``end_b``, ``n_arms``.

    A pair of neighbours is known by its smaller and its greater name, so no neighbour lists are built.
    """
    names = segments.where("name is not null").select(F.col("name").alias("node")).distinct()
    two = neighbour_counts(edges).where("n_neighbours = 2").join(names, "node", "left_semi").select("node", F.col("least").alias("end_a"), F.col("greatest").alias("end_b"))
    arms = two.groupBy("end_a", "end_b").agg(F.count(F.lit(1)).alias("n_arms")).where("n_arms >= 2")
    return two.join(arms, ["end_a", "end_b"]).select("node", "end_a", "end_b", "n_arms")


def visit_budgets(edges: DataFrame, segments: DataFrame, aligned: DataFrame, default: int = 2) -> DataFrame:
    """How often a walk may visit each declared segment: 1 in bubbles, up to 4 for repeats, else ``default``; at least that without alignment."""
    names = segments.where("name is not null").select(F.col("name").alias("node")).distinct()
    there = aligned.select(F.col("qname").alias("node")).distinct().withColumn("aligned", F.lit(True))
    bubbles = bubble_members(edges, segments).select("node").withColumn("in_bubble", F.lit(True))
    all_ = names.join(neighbour_counts(edges).select("node", "n_neighbours"), "node", "left").join(bubbles, "node", "left").join(there, "node", "left")
    all_ = all_.na.fill(0, ["n_neighbours"]).na.fill(False, ["aligned", "in_bubble"])
    budget = F.when(F.col("in_bubble"), 1).when(F.col("n_neighbours") > 4, F.least("n_neighbours", F.lit(4))).otherwise(default).cast("int")
    return all_.select("node", F.col("n_neighbours").alias("degree"), "in_bubble", "aligned", F.when(~F.col("aligned"), F.greatest(budget, F.lit(default))).otherwise(budget).alias("budget"))


def component_summary(links: DataFrame, segments: DataFrame, min_len: int = 1000, groups: DataFrame | None = None) -> DataFrame:
    """Per connected component: segments, their bases, overlapped bases, unique bases, and its rank among those of ``min_len`` on.

    Components are named by their smallest name. Unique bases are segment
    bases less overlaps, 0 at least; the rank goes by unique bases and then
    the name, and is null for small components.
    """
    if groups is None:
        groups = written(connected_groups(links, "from_seg", "to_seg", segments, "name", "name", "component"))
    lengths = segment_lengths(segments)
    per_group = groups.join(lengths, "name", "left").groupBy("component").agg(F.count(F.lit(1)).alias("n_segments"), F.coalesce(F.sum("length"), F.lit(0)).alias("seg_bp"))
    # Every link lies in the component of its first end; sums per name come first, so a hot name is joined once.
    per_name = whole_links(links).groupBy(F.col("from_seg").alias("name")).agg(F.count(F.lit(1)).alias("n_links"), F.sum(overlap_length("overlap")).alias("overlap_bp"))
    overlaps = per_name.join(groups, "name").groupBy("component").agg(F.sum("n_links").alias("n_links"), F.sum("overlap_bp").alias("overlap_bp"))
    out = per_group.join(overlaps, "component", "left").na.fill(0, ["n_links", "overlap_bp"])
    out = out.withColumn("unique_bp", F.greatest(F.col("seg_bp") - F.col("overlap_bp"), F.lit(0)))
    large = written(out.where(F.col("unique_bp") >= min_len).select("component", "unique_bp"))
    return out.join(ranked(large, "unique_bp", "component"), "component", "left")


def ranked(df: DataFrame, size: str, name: str) -> DataFrame:
    """``name`` and ``rank`` by descending size and then name, by ranges of the order rather than in one task."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = df.select(name, size).repartitionByRange(parts, F.col(size).desc(), F.col(name)).sortWithinPartitions(F.col(size).desc(), F.col(name))
    placed = written(ordered.select(name, F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_place")))
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # one row per range
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return placed.join(F.broadcast(before), "_part").select(name, (F.col("_before") + F.col("_place") + 1).alias("rank"))


def route_links(links: DataFrame, groups: DataFrame) -> DataFrame:
    """Each link with the component of its first end; links without one are dropped."""
    of_name = groups.select(F.col("name").alias("from_seg"), "component")
    return lookup(whole_links(links), "from_seg", of_name, "component", F.col("link_id")).where("component is not null")


def missing_reverse(edges: DataFrame) -> DataFrame:
    """Distinct dumped half-edges whose opposite direction isn't in the dump."""
    cols = ["node", "exit_side", "to_node", "to_side"]
    there = edges.where("node is not null and to_node is not null").select(*cols).distinct()
    back = there.select(F.col("to_node").alias("node"), F.col("to_side").alias("exit_side"), F.col("node").alias("to_node"), F.col("exit_side").alias("to_side"))
    return there.join(back, cols, "left_anti")


def outgoing_steps(edges: DataFrame) -> DataFrame:
    """Distinct oriented steps from every state: leaving ``node`` by ``exit_side`` enters ``to_node`` and may leave it on the other side."""
    steps = edges.select("node", "exit_side", "to_node", (1 - F.col("to_side")).alias("to_exit")).distinct()
    return steps.select("node", orient_of_exit("exit_side").alias("orient"), "to_node", orient_of_exit("to_exit").alias("to_orient"))


def layers(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """``node`` and ``depth``: steps from the nearest of ``starts`` along links in either direction.

    Level by level: the frontier joins the distinct neighbour pairs, and what
    it reaches is new unless it lies in the frontier or the one before, as no
    link leads further back; so no round reads more than that. A hot node is in the frontier once, and
    its pairs are spread by salting. As many rounds as the greatest depth.
    """
    pairs = edges.where("node <> to_node").select("node", "to_node").distinct()
    hot = F.broadcast(hot_keys(pairs, "node").select(F.col("node").alias("_hot")))
    salted = pairs.join(hot, F.col("node") == F.col("_hot"), "left")
    salted = written(salted.select("node", "to_node", F.when(F.col("_hot").isNotNull(), F.pmod(F.xxhash64("to_node"), F.lit(32))).otherwise(F.lit(0).cast("long")).alias("salt"), F.col("_hot").isNotNull().alias("hot")))
    hot_nodes = F.broadcast(written(salted.where("hot").select("node").distinct().withColumn("is_hot", F.lit(True))))  # 100 at most
    levels, n, depth = [], 1, 0
    frontier = written(starts.select("node").where("node is not null").distinct().withColumn("depth", F.lit(0)))
    while n:
        levels.append(frontier)
        depth += 1
        salts = F.when(F.col("is_hot"), F.sequence(F.lit(0).cast("long"), F.lit(31).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
        spread = frontier.join(hot_nodes, "node", "left").select("node", F.explode(salts).alias("salt"))
        reached = spread.join(salted, ["node", "salt"]).select(F.col("to_node").alias("node")).distinct()
        for level in levels[-2:]:
            reached = reached.join(level.select("node"), "node", "left_anti")
        frontier, n = written_counted(reached.withColumn("depth", F.lit(depth)))
    return reduce(DataFrame.unionByName, levels)
