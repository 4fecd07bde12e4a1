"""Candidate walks through components, and the pair that covers most and differs most."""

from __future__ import annotations

import hashlib
from collections import defaultdict
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.sequences import oriented, overlap_length
from weftline.operators.skew import hot_keys, lookup
from weftline.session import discard, written

#: Tables of visited nodes that are merged into one.
ROUNDS_PER_TABLE = 6
SALTS = 16
#: Components of up to so many steps are walked in one task each, larger ones by joins; the walks are the same.
SMALL = 200_000
#: How many nodes a walk may enter again, by trial.
REVISITS = (0, 1, 3, 8)
WALK = "component string, trial int, step int, node string, orient string, overlap string, overlap_bp long, length_bp long"


def walk_starts(edges: DataFrame, segments: DataFrame, groups: DataFrame, per_group: int | None = None) -> DataFrame:
    """``component``, ``place``, ``node``, ``orient``: the starts of each component by name, all or the first ``per_group``.

    A start leaves a tip by its only side; isolated segments leave to the
    right. Components without either start anywhere, on both sides. Places are
    counted by ranges of the order rather than by a window over a component.
    """
    sides = edges.groupBy("node").agg(F.min("exit_side").alias("low"), F.max("exit_side").alias("high"))
    named = groups.select(F.col("name").alias("node"), "component").join(sides, "node", "left")
    tip = named.where("low is null or low = high").select("component", "node", F.coalesce("low", F.lit(1)).alias("side"), F.lit(0).alias("kind"))
    inner = named.where("low < high").select("component", "node", F.explode(F.array(F.lit(0), F.lit(1))).alias("side"), F.lit(1).alias("kind"))
    every = written(tip.unionByName(inner))
    best = every.groupBy("component").agg(F.min("kind").alias("kind"))
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["component", "node", "side"]
    ordered = every.join(best, ["component", "kind"]).select(*keys).repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    placed = written(ordered.select(*keys, F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_at")))
    sizes = placed.groupBy("component", "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))  # a component has one row per range
    order = Window.partitionBy("component").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("component", "_part", (F.coalesce(F.sum("_n").over(order), F.lit(0)) - F.col("_first")).alias("_before"))
    orient = F.when(F.col("side") == 1, "+").otherwise("-")
    out = placed.join(before, ["component", "_part"]).select("component", (F.col("_at") + F.col("_before")).cast("int").alias("place"), "node", orient.alias("orient"))
    return out if per_group is None else out.where(F.col("place") < per_group)


def walk_steps(links: DataFrame) -> DataFrame:
    """The distinct oriented steps over whole links in both directions, each with the ``overlap`` of the link of least ``link_id``."""
    def step(node: str, orient: Column, to_node: str, to_orient: Column) -> Column:
        return F.struct(F.col(node).alias("node"), orient.alias("orient"), F.col(to_node).alias("to_node"), to_orient.alias("to_orient"))

    plain = lambda c: F.when(F.col(c) == "-", "-").otherwise("+")
    other = lambda c: F.when(F.col(c) == "-", "+").otherwise("-")
    both = F.array(step("from_seg", plain("from_orient"), "to_seg", plain("to_orient")), step("to_seg", other("to_orient"), "from_seg", other("from_orient")))
    rows = links.where("from_seg is not null and to_seg is not null").select("link_id", "overlap", F.explode(both).alias("s")).select("s.*", "link_id", "overlap")
    first = rows.groupBy("node", "orient", "to_node", "to_orient").agg(F.min_by(F.struct("overlap"), "link_id").alias("l"))
    return first.select("node", "orient", "to_node", "to_orient", "l.overlap", overlap_length("l.overlap").alias("overlap_bp"))


def _walk(seed: int):
    """All walks of one small component: ``rows`` holds its begun walks (no ``to_node``) and its steps."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        component, is_step = rows["component"].iloc[0], rows["to_node"].notna()
        ways = defaultdict(list)
        columns = ("node", "orient", "to_node", "to_orient", "length", "overlap_bp", "overlap")
        for node, orient, *way in zip(*(rows.loc[is_step, c].tolist() for c in columns), strict=True):
            ways[node, orient].append(way)
        out = []
        begun = rows[~is_step]
        for trial, node, orient, length in zip(*(begun[c].tolist() for c in ("trial", "node", "orient", "length")), strict=True):
            trial, step, again, seen, total = int(trial), 0, REVISITS[int(trial) % len(REVISITS)], {node}, int(length)
            out.append((component, trial, 0, node, orient, None, 0, total))
            while there := ways.get((node, orient)):
                fresh = [w for w in there if w[0] not in seen]
                if not fresh and not again:
                    break
                again -= not fresh
                step += 1
                draw = lambda w: (hashlib.md5(f"{seed}|{trial}|{step}|{w[0]}|{w[1]}".encode()).hexdigest(), w[0], w[1])  # noqa: B023, E731
                node, orient, length, bp, overlap = min(fresh or there, key=draw)
                seen.add(node)
                total = max(0, total + int(length) - int(bp))
                out.append((component, trial, step, node, orient, overlap, int(bp), total))
        return pd.DataFrame(out, columns=["component", "trial", "step", "node", "orient", "overlap", "overlap_bp", "length_bp"])

    return run


def _walk_by_joins(steps: DataFrame, begun: DataFrame, seed: int) -> DataFrame:
    """The walks of large components: all take each step together, by one join and one aggregation, until none goes on.

    The steps from hot states are salted, and partial minima reach the shuffle.
    What a walk has visited is kept in written tables of a row per node, which
    are merged now and then.
    """
    state = F.concat("node", "orient")
    hot = F.broadcast(written(hot_keys(steps.withColumn("_state", state), "_state").withColumnRenamed("_state", "_hot")))  # 100 at most
    salted = steps.join(hot, F.concat("node", "orient") == F.col("_hot"), "left").withColumn("salt", F.when(F.col("_hot").isNotNull(), F.pmod(F.xxhash64("to_node"), F.lit(SALTS))).otherwise(F.lit(0).cast("long"))).drop("_hot")
    salted = written(salted.select(state.alias("state"), "salt", "to_node", "to_orient", "length", "overlap", "overlap_bp"))
    salts = F.when(F.col("_hot").isNotNull(), F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    budget = F.element_at(F.array(*map(F.lit, REVISITS)), (F.col("trial") % len(REVISITS) + 1).cast("int"))
    walk = ["component", "trial"]
    ends = written(begun.select(*walk, F.lit(0).alias("step"), "node", "orient", F.lit(None).cast("string").alias("overlap"), F.lit(0).cast("long").alias("overlap_bp"), F.col("length").alias("length_bp"), budget.alias("again"), F.lit(False).alias("seen")))
    merged, recent, every, step = None, [ends], [ends], 0
    while not ends.isEmpty():
        step += 1
        spread = ends.withColumn("state", state).join(hot, F.col("state") == F.col("_hot"), "left").select(*walk, "state", "again", F.col("length_bp").alias("so_far"), F.explode(salts).alias("salt"))
        ways = spread.join(salted, ["state", "salt"]).select(*walk, "again", "so_far", F.col("to_node").alias("node"), F.col("to_orient").alias("orient"), "length", "overlap", "overlap_bp").withColumn("seen", F.lit(False))
        for visited in [merged, *recent] if merged is not None else recent:
            known = visited.where("not seen").select(*walk, "node", F.lit(True).alias("_there"))
            ways = ways.join(known, [*walk, "node"], "left").withColumn("seen", F.col("seen") | F.coalesce("_there", F.lit(False))).drop("_there")
        draw = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("trial").cast("string"), F.lit(str(step)), "node", "orient"))
        one = F.struct("node", "orient", "overlap", "overlap_bp", F.greatest(F.col("so_far") + F.col("length") - F.col("overlap_bp"), F.lit(0)).alias("length_bp"), (F.col("again") - F.col("seen").cast("int")).alias("again"), "seen")
        taken = ways.where("not seen or again > 0").groupBy(*walk).agg(F.min_by(one, F.struct("seen", draw.alias("draw"), "node", "orient")).alias("next"))
        ends = written(taken.select(*walk, F.lit(step).alias("step"), "next.*"))
        recent.append(ends)
        every.append(ends)
        if len(recent) > ROUNDS_PER_TABLE:
            old = [merged, *recent[:-1]] if merged is not None else recent[:-1]
            merged, recent = written(reduce(DataFrame.unionByName, old)), [ends]
            for done in old:
                discard(done)
    return reduce(DataFrame.unionByName, [merged, *recent] if merged is not None else recent).select(*walk, "step", "node", "orient", "overlap", "overlap_bp", "length_bp")


def candidate_walks(steps: DataFrame, starts: DataFrame, groups: DataFrame, lengths: DataFrame, trials: int, seed: int, small: int = SMALL) -> DataFrame:
    """A row per step of seeded walks: ``component``, ``trial``, ``step``, ``node``, ``orient``, ``overlap`` (as the link states it), ``overlap_bp``, ``length_bp`` (of the walk so far).

    ``steps`` are oriented (``node``, ``orient``, ``to_node``, ``to_orient``,
    ``overlap``, ``overlap_bp``), as ``walk_steps`` gives them. Trials take turns at a component's starts. Each step goes
    where the md5 of seed, trial, step and place is least among nodes not yet
    visited; where there are none, to any, as often as REVISITS allows the
    trial; and so each walk ends at a dead end, after no more steps than the
    component has nodes and REVISITS together. A length is that of the segments less the
    overlaps, never below 0 on the way. A component of up to ``small`` steps,
    as counted, is walked by a task of its own, larger ones by joins.
    """
    sized = steps.join(lengths.select(F.col("name").alias("to_node"), "length"), "to_node", "left").na.fill(0, ["length"])
    placed = written(lookup(sized, "node", groups.select(F.col("name").alias("node"), "component"), "component", F.xxhash64("to_node")))
    counts = starts.groupBy("component").agg(F.count(F.lit(1)).alias("n_starts"))
    turns = counts.select("component", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))).alias("trial"), "n_starts").withColumn("place", (F.col("trial") % F.col("n_starts")).cast("int"))
    begun = turns.join(starts, ["component", "place"]).join(lengths.select(F.col("name").alias("node"), "length"), "node", "left").na.fill(0, ["length"])
    begun = written(begun.select("component", "trial", "node", "orient", "length"))
    large = written(placed.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > small).select("component"))
    few = begun.join(large, "component", "left_anti").unionByName(placed.join(large, "component", "left_anti"), allowMissingColumns=True)
    out = few.groupBy("component").applyInPandas(_walk(seed), WALK)
    if not large.isEmpty():
        out = out.unionByName(_walk_by_joins(placed.join(large, "component", "left_semi"), begun.join(large, "component", "left_semi"), seed))
    return written(out)


def distinct_walks(walks: DataFrame) -> DataFrame:
    """``component``, ``trial``, ``length_bp``, ``revisits``: of the walks of a component over the same nodes, as often, the one of least trial.

    The multiset of nodes is known by its size and the sums of two hashes.
    """
    prints = [F.sum(F.xxhash64(F.lit(seed), "node").cast("decimal(38,0)")).alias(f"_f{seed}") for seed in (3, 29)]
    whole = walks.groupBy("component", "trial").agg(F.count(F.lit(1)).alias("_n"), F.max_by("length_bp", "step").alias("length_bp"), (F.count(F.lit(1)) - F.countDistinct("node")).alias("revisits"), *prints)
    first = whole.groupBy("component", "_n", "_f3", "_f29").agg(F.min_by(F.struct("trial", "length_bp", "revisits"), "trial").alias("w"))
    return first.select("component", "w.*")


def best_pairs(walks: DataFrame, lengths: DataFrame, tolerance: float = 0.1) -> DataFrame:
    """Per component the longest walk and the one that, with it, covers most, then differs most, then revisits least.

    Only walks whose length is within ``tolerance`` of the leader's compete, or
    all if none is; ties go to the longer walk and then the lesser trial, the
    leader being the longest walk of least trial. Each walk is compared
    with its leader alone. A component with one walk has no second.
    """
    distinct = written(distinct_walks(walks))
    leader = distinct.groupBy("component").agg(F.min_by(F.struct("trial", "length_bp", "revisits"), F.struct((-F.col("length_bp")).alias("less"), "trial")).alias("lead"))
    leader = written(leader.select("component", F.col("lead.trial").alias("first_trial"), F.col("lead.length_bp").alias("first_bp"), F.col("lead.revisits").alias("first_revisits")))
    nodes = walks.join(distinct.select("component", "trial"), ["component", "trial"]).select("component", "trial", "node").distinct()
    nodes = written(nodes.join(lengths.select(F.col("name").alias("node"), "length"), "node", "left").na.fill(0, ["length"]))
    led = nodes.join(leader.select("component", F.col("first_trial").alias("trial")), ["component", "trial"])
    lead_bp = led.groupBy("component").agg(F.sum("length").alias("lead_bp"), F.count(F.lit(1)).alias("lead_nodes"))
    shared = F.col("in_lead").isNotNull()
    own = nodes.join(led.select("component", "node", F.lit(1).alias("in_lead")), ["component", "node"], "left").groupBy("component", "trial").agg(
        F.sum("length").alias("own_bp"), F.sum(F.when(shared, F.col("length")).otherwise(0)).alias("shared_bp"), F.sum((~shared).cast("long")).alias("new_nodes"))
    scores = distinct.join(own, ["component", "trial"]).join(leader, "component").join(lead_bp, "component").where("trial <> first_trial")
    near = (F.col("length_bp") >= F.round(F.col("first_bp") * (1 - tolerance))) & (F.col("length_bp") <= F.round(F.col("first_bp") * (1 + tolerance)))
    union_bp = F.col("lead_bp") + F.col("own_bp") - F.col("shared_bp")
    scored = scores.select("component", "trial", "length_bp", "revisits", near.alias("near"), union_bp.alias("union_bp"), (union_bp - F.col("shared_bp")).alias("symdiff_bp"), "new_nodes")
    order = F.struct("near", "union_bp", "symdiff_bp", (-F.col("revisits")).alias("fewer"), "length_bp", (-F.col("trial")).alias("first"))
    second = scored.groupBy("component").agg(F.max_by(F.struct("trial", "length_bp", "union_bp", "symdiff_bp", "revisits", "new_nodes"), order).alias("s"))
    return leader.join(lead_bp, "component").join(second, "component", "left").select(
        "component", "first_trial", "first_bp", F.col("s.trial").alias("second_trial"), F.col("s.length_bp").alias("second_bp"),
        F.coalesce("s.union_bp", "lead_bp").alias("union_bp"), F.coalesce("s.symdiff_bp", F.lit(0)).alias("symdiff_bp"),
        (F.col("first_revisits") + F.coalesce("s.revisits", "first_revisits")).alias("revisits"), (F.col("lead_nodes") + F.coalesce("s.new_nodes", F.lit(0))).alias("nodes_covered"))


def walk_summary(pairs: DataFrame, groups: DataFrame, lengths: DataFrame) -> DataFrame:
    """Per component: its bases, both walks' lengths, what they cover and where they differ, revisits, and nodes in all and covered.

    A component with one walk has it twice.
    """
    sizes = groups.join(lengths, "name", "left").na.fill(0, ["length"]).groupBy("component").agg(F.sum("length").alias("size_bp"), F.count(F.lit(1)).alias("nodes_total"))
    return sizes.join(pairs, "component").select(
        "component", "size_bp", F.col("first_bp").alias("hap1_len"), F.coalesce("second_bp", "first_bp").alias("hap2_len"), "union_bp", "symdiff_bp", "revisits", "nodes_total", "nodes_covered")


def walk_lines(walks: DataFrame) -> DataFrame:
    """``component``, ``trial``, ``names`` (``a+,b-``), ``walk`` (``>a<b``), ``overlaps`` (one per step after the first, ``*`` for none or one step).

    A walk is one line of text, and so one row.
    """
    text = F.when(F.coalesce("overlap", F.lit("")) != "", F.col("overlap")).otherwise("*")
    ordered = walks.groupBy("component", "trial").agg(F.sort_array(F.collect_list(F.struct("step", "node", "orient", text.alias("overlap")))).alias("s"))
    names = F.array_join(F.transform("s", lambda x: F.concat(x.node, x.orient)), ",")
    signs = F.array_join(F.transform("s", lambda x: F.concat(F.when(x.orient == "-", "<").otherwise(">"), x.node)), "")
    rest = F.array_join(F.transform(F.slice("s", 2, F.greatest(F.size("s"), F.lit(1))), lambda x: x.overlap), ",")
    return ordered.select("component", "trial", names.alias("names"), signs.alias("walk"), F.when(F.size("s") < 2, "*").otherwise(rest).alias("overlaps"))


def walk_sequences(walks: DataFrame, sequences: DataFrame) -> DataFrame:
    """``component``, ``trial``, ``sequence`` of each walk, every overlap given once; none if a segment keeps no sequence.

    A step no longer than its overlap adds nothing. ``sequences`` has ``name`` and ``seq``.
    """
    known = lookup(walks, "node", sequences.select(F.col("name").alias("node"), "seq"), "seq", F.xxhash64("component", "trial", "step"))
    bases, overlap = oriented("seq", "orient"), F.when(F.col("step") == 0, F.lit(0)).otherwise(F.col("overlap_bp"))
    added = F.when(F.col("seq").isNotNull(), F.when(overlap < F.length(bases), F.right(bases, (F.length(bases) - overlap).cast("int"))).otherwise(""))
    parts = known.select("component", "trial", "step", added.alias("added"))
    whole = parts.groupBy("component", "trial").agg(F.count(F.lit(1)).alias("n"), F.count("added").alias("kept"), F.sort_array(F.collect_list(F.struct("step", "added"))).alias("s")).where("n = kept")
    return whole.select("component", "trial", F.array_join(F.transform("s", lambda x: x.added), "").alias("sequence"))
