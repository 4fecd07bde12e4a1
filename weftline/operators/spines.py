"""Long paths between the tips of components, and what lies on them."""

from __future__ import annotations

import heapq
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.components import connected_groups, groups_within
from weftline.operators.graph import neighbour_counts, tips
from weftline.operators.skew import hot_keys, lookup
from weftline.session import discard, written

SALTS = 32
#: Tips of a component that are swept first; each batch after it is four times as large.
FIRST_BATCH = 4
#: Components of up to so many pairs of neighbours are searched in one task each, larger ones by joins; the spines are the same.
SMALL = 500_000
SPINE = "component string, tip_a string, tip_b string, spine_bp long, second_bp long"


def distances(edges: DataFrame, lengths: DataFrame, starts: DataFrame) -> DataFrame:
    """``source``, ``node``, ``bp``: the least number of bases of a path from each ``source`` of ``starts`` to each node it reaches, both included.

    Links count in either direction, whatever the orientations. All sources
    spread together: each round the nodes whose distance fell pass it to their
    neighbours, by one join and one aggregation, until none falls. Pairs of hot
    nodes are salted, so a hub's neighbours are spread over tasks.
    """
    sized = lengths.select(F.col("name").alias("to_node"), F.col("length").alias("step"))
    pairs = edges.where("node <> to_node").select("node", "to_node").distinct().join(sized, "to_node", "left").na.fill(0, ["step"])
    hot = F.broadcast(written(hot_keys(pairs, "node").select("node").withColumn("hot", F.lit(True))))  # 100 at most
    pairs = pairs.join(hot, "node", "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("to_node"), F.lit(SALTS))).otherwise(F.lit(0).cast("long")))
    pairs = written(pairs.select("node", "salt", "to_node", "step"))
    own = lengths.select(F.col("name").alias("node"), F.col("length").alias("bp"))
    seen = written(starts.select("source", F.col("source").alias("node")).distinct().join(own, "node", "left").na.fill(0, ["bp"]).select("source", "node", "bp"))
    fell = seen
    every = F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))
    while not fell.isEmpty():
        spread = fell.join(hot, "node", "left").select("source", "node", "bp", F.explode(F.when(F.col("hot"), every).otherwise(F.array(F.lit(0).cast("long")))).alias("salt"))
        offers = spread.join(pairs, ["node", "salt"]).groupBy("source", F.col("to_node").alias("node")).agg(F.min(F.col("bp") + F.col("step")).alias("offer"))
        better = offers.join(seen, ["source", "node"], "left").where("bp is null or offer < bp").select("source", "node", F.col("offer").alias("bp"))
        fell = written(better)
        updated = written(seen.unionByName(fell).groupBy("source", "node").agg(F.min("bp").alias("bp")))
        discard(seen)
        seen = updated
    return seen


def _spine(rows: pd.DataFrame) -> pd.DataFrame:
    """The farthest two tips of one small component and the runner-up: rows without ``to_node`` are its tips, others its neighbour pairs.

    Tips are swept in order of how far they may be from any other tip not yet
    swept, which the distances from nodes already swept bound.
    """
    component, is_tip = rows["component"].iloc[0], rows["to_node"].isna().to_numpy()
    names = sorted(set(rows["node"]) | set(rows["to_node"].dropna()))
    number = {x: i for i, x in enumerate(names)}
    own, near = np.zeros(len(names), np.int64), defaultdict(list)
    own[[number[x] for x in rows["node"]]] = rows["own"]
    for a, b, step in zip(rows["node"][~is_tip], rows["to_node"][~is_tip], rows["step"][~is_tip], strict=True):
        near[number[a]].append((number[b], int(step)))
    tips = np.array(sorted(number[x] for x in set(rows["node"][is_tip])))

    def sweep(start: int) -> np.ndarray:
        far = np.iinfo(np.int64).max
        dist, heap = [far] * len(names), [(int(own[start]), start)]
        dist[start] = int(own[start])
        while heap:
            d, at = heapq.heappop(heap)
            if d == dist[at]:
                for to, step in near[at]:
                    if d + step < dist[to]:
                        dist[to] = d + step
                        heapq.heappush(heap, (d + step, to))
        return np.array(dist)[tips]

    left, bound = np.ones(len(tips), bool), np.full(len(tips), np.iinfo(np.int64).max)
    best: list[tuple[int, int, int]] = []  # first and second: bases downwards, then names
    start, at_tip = max(near, key=lambda x: (len(near[x]), x)), -1
    while True:
        reached = sweep(start)
        if at_tip >= 0:
            left[at_tip] = False
            for bp in np.unique(reached[left])[::-1][:2].tolist():
                found = sorted((-bp, *sorted((start, int(t)))) for t in tips[left & (reached == bp)])
                best = sorted(best + found[:2])[:2]
        if left.sum() < 2:
            break
        there = np.sort(reached[left])
        onward = np.where(reached == there[-1], there[-2], there[-1])
        bound = np.minimum(bound, reached + onward - own[start])
        open_ = left & ((bound > -best[1][0]) | (bound >= -best[0][0])) if len(best) == 2 else left
        if not open_.any():
            break
        at_tip = int(np.flatnonzero(open_)[np.argmax(bound[open_])])
        start = int(tips[at_tip])
    (less, a, b), second = best[0], -best[1][0] if len(best) > 1 else None
    out = pd.DataFrame([(component, names[a], names[b], -less, second)], columns=["component", "tip_a", "tip_b", "spine_bp", "second_bp"])
    return out.astype({"second_bp": "Int64"})


def spine_ends(edges: DataFrame, segments: DataFrame, groups: DataFrame, lengths: DataFrame, tolerance: int = 100, small: int = SMALL) -> DataFrame:
    """Per component with two tips or more: the two tips farthest apart, the bases between them, and the runner-up's of all other pairs.

    Ties go to the smaller names; ``ambiguous`` is a runner-up within
    ``tolerance``. All pairs of tips are ranked, with cycles too, though not
    every tip is swept: two tips are never farther apart than by way of a third
    node whose distances are known, so once that bound shows that no pair of
    tips not yet swept can come first or second, a component is done.
    Components of up to ``small`` neighbour pairs, as counted, are searched in
    tasks of their own, larger ones together, by joins.
    """
    ends = tips(edges, segments).select("node").join(groups.select(F.col("name").alias("node"), "component"), "node")
    n_tips = written(ends.groupBy("component").agg(F.count(F.lit(1)).alias("n_tips")).where("n_tips > 1"))
    ends = written(ends.join(n_tips.select("component"), "component"))
    sized = lengths.select(F.col("name").alias("node"), F.col("length").alias("own"))
    pairs = edges.where("node <> to_node").select("node", "to_node").distinct()
    placed = pairs.join(groups.select(F.col("name").alias("node"), "component"), "node").join(n_tips.select("component"), "component", "left_semi")
    placed = placed.unionByName(ends, allowMissingColumns=True).join(sized, "node", "left").join(sized.select(F.col("node").alias("to_node"), F.col("own").alias("step")), "to_node", "left").na.fill(0, ["own", "step"])
    placed = written(placed.select("component", "node", "to_node", "own", "step"))
    large = written(placed.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > small).select("component"))
    best = placed.join(large, "component", "left_anti").groupBy("component").applyInPandas(_spine, SPINE)
    if not large.isEmpty():
        best = best.unionByName(_spines_by_joins(edges, groups, lengths, ends.join(large, "component", "left_semi"), n_tips.join(large, "component", "left_semi")))
    return written(best).join(n_tips, "component").select(
        "component", "n_tips", "tip_a", "tip_b", "spine_bp", "second_bp",
        F.coalesce((F.col("second_bp") > 0) & (F.col("spine_bp") - F.col("second_bp") < tolerance), F.lit(False)).alias("ambiguous"))


def _spines_by_joins(edges: DataFrame, groups: DataFrame, lengths: DataFrame, ends: DataFrame, n_tips: DataFrame) -> DataFrame:
    """The spines of large components: the node of most neighbours is swept first, then ever larger batches of the tips of greatest bound."""
    own = lengths.select(F.col("name").alias("source"), F.col("length").alias("own"))
    degrees = neighbour_counts(edges).join(groups.select(F.col("name").alias("node"), "component"), "node").join(n_tips.select("component"), "component", "left_semi")
    batch = written(degrees.groupBy("component").agg(F.max_by("node", F.struct("n_neighbours", "node")).alias("source")).withColumn("is_end", F.lit(False)))
    known, size = None, FIRST_BATCH
    none = lambda kind, c: F.lit(None).cast(kind).alias(c)
    best = n_tips.limit(0).select("component", none("string", "tip_a"), none("string", "tip_b"), none("long", "spine_bp"), none("long", "second_bp"))
    while not batch.isEmpty():
        reached = distances(edges, lengths, batch).join(batch, "source").join(ends, ["component", "node"]).join(own, "source", "left").na.fill(0, ["own"])
        new = reached.select("component", "source", "node", "bp", "own", "is_end")
        grown = written(new if known is None else known.unionByName(new))
        if known is not None:
            discard(known)
        known = grown
        swept = known.where("is_end").select("component", F.col("source").alias("node")).distinct()
        pairs = known.where("is_end and node <> source").select("component", F.least("source", "node").alias("tip_a"), F.greatest("source", "node").alias("tip_b"), "bp").distinct()
        first = pairs.groupBy("component").agg(F.min(F.struct((-F.col("bp")).alias("less"), "tip_a", "tip_b")).alias("first"))
        others = pairs.join(first, "component").where("tip_a <> first.tip_a or tip_b <> first.tip_b").groupBy("component").agg(F.max("bp").alias("second_bp"))
        best = written(first.join(others, "component", "left").select("component", "first.tip_a", "first.tip_b", (-F.col("first.less")).alias("spine_bp"), "second_bp"))
        open_ = written(known.join(swept, ["component", "node"], "left_anti"))
        far = open_.groupBy("component", "source").agg(F.max(F.struct("bp", "node")).alias("far"))
        next_ = open_.join(far, ["component", "source"]).where("node <> far.node").groupBy("component", "source").agg(F.max("bp").alias("next_bp"))
        onward = F.when(F.col("node") == F.col("far.node"), F.col("next_bp")).otherwise(F.col("far.bp"))
        bounds = open_.join(far, ["component", "source"]).join(next_, ["component", "source"]).groupBy("component", "node").agg(F.min(F.col("bp") + onward - F.col("own")).alias("bound"))
        todo = bounds.join(best, "component", "left").where("second_bp is null or bound > second_bp or bound >= spine_bp")
        order = Window.partitionBy("component").orderBy(F.col("bound").desc(), "node")
        batch = written(todo.withColumn("_at", F.row_number().over(order)).where(F.col("_at") <= size).select("component", F.col("node").alias("source"), F.lit(True).alias("is_end")))
        size *= 4
    return best


def bubble_regions(links: DataFrame, edges: DataFrame, segments: DataFrame, ends: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``name``, ``component``: what stays connected with both ends of a component's spine once its other tips are taken away.

    With groups that no link leaves (``known``), those are searched in tasks.
    """
    kept_tips = ends.select(F.explode(F.array("tip_a", "tip_b")).alias("node"))
    others = written(tips(edges, segments).select("node").join(kept_tips, "node", "left_anti"))
    cut = links
    for end in ("from_seg", "to_seg"):
        cut = cut.join(others.select(F.col("node").alias(end)), end, "left_anti")
    if known is None:
        groups = written(connected_groups(cut, "from_seg", "to_seg", kept_tips, "node", "name", "part"))
    else:
        groups = written(groups_within(cut, "from_seg", "to_seg", kept_tips, "node", known, "name", "part"))
    side = lambda tip: ends.select("component", F.col(tip).alias("name")).join(groups, "name").select("component", "part")
    whole = side("tip_a").join(side("tip_b"), ["component", "part"])
    return lookup(groups, "part", whole, "component", F.col("name")).where("component is not null").select("name", "component")


def layered_edges(edges: DataFrame, depths: DataFrame) -> DataFrame:
    """Distinct ``node``, ``to_node``, ``depth`` of the neighbour pairs that lead from one layer to the next; pairs within a layer are left out."""
    pairs = edges.where("node <> to_node").select("node", "to_node").distinct()
    deep = pairs.join(depths, "node").join(depths.select(F.col("node").alias("to_node"), F.col("depth").alias("to_depth")), "to_node")
    return deep.where("depth < to_depth").select("node", "to_node", "depth")
