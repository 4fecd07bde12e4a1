"""Consolidating pairwise matches into groups by randomised graph contraction."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators.skew import HOT_SHARE, lookup
from weftline.session import discard, written, written_counted

LOW = (1 << 32) - 1
#: Groups of up to so many pairs and names are cut up in tasks, larger ones by contraction; and the rows of a task that holds many groups.
SMALL, ROWS = 500_000, 200_000


def _half(word: Column, key: int) -> Column:
    # As text, the key is a parameter of one compiled expression for all rounds.
    return F.xxhash64(F.lit(str(key)), word).bitwiseAND(F.lit(LOW))


def _mixed(vertex: str, round_no: int) -> Column:
    """A vertex's place in the hash order of a round: a one-to-one map of 64-bit numbers, by two exchanges of halves."""
    high, low = F.shiftrightunsigned(F.col(vertex), 32), F.col(vertex).bitwiseAND(F.lit(LOW))
    middle = high.bitwiseXOR(_half(low, 2 * round_no))
    return F.shiftleft(middle, 32).bitwiseOR(low.bitwiseXOR(_half(middle, 2 * round_no + 1)))


def _vertex_at(place: Column, round_no: int) -> Column:
    """The vertex at a place of the hash order."""
    middle, last = F.shiftrightunsigned(place, 32), place.bitwiseAND(F.lit(LOW))
    low = last.bitwiseXOR(_half(middle, 2 * round_no + 1))
    return F.shiftleft(middle.bitwiseXOR(_half(low, 2 * round_no)), 32).bitwiseOR(low)


def _representatives(edges: DataFrame, round_no: int) -> DataFrame:
    """Each vertex hooks to the first of itself and its neighbours in the round's hash order."""
    best = edges.groupBy("src").agg(F.min(_mixed("dst", round_no)).alias("best"), F.count(F.lit(1)).alias("degree"))
    first = best.select("src", "degree", F.least("best", _mixed("src", round_no)).alias("first"))
    return first.select(F.col("src").alias("vertex"), _vertex_at(F.col("first"), round_no).alias("rep"), "degree")


def _with_value(df: DataFrame, key: str, values: DataFrame, value: str, spread: Column, hot: list[int]) -> DataFrame:
    """``df`` with the one ``value`` of its ``key``; ``hot`` are the keys, 100 at most, of which too many rows have one."""
    if not hot:
        return df.join(values, key, "left")
    return lookup(df, key, values, value, spread, df.sparkSession.createDataFrame([(k,) for k in hot], f"{key} long"))


def connected_groups(pairs: DataFrame, left: str, right: str, vertices: DataFrame | None = None, vertex: str | None = None,
                     out_vertex: str = "vertex", out_group: str = "group_name") -> DataFrame:
    """One row per distinct name with the smallest name of its connected group.

    Names come from ``pairs`` with both ends present and from ``vertices``
    (nulls don't count); pairs are undirected, repeated and self pairs add
    nothing, an empty string is a name like any other. Empty tables give no
    rows. Other columns of either table are ignored.

    Names are numbered once, and edges are pairs of numbers. Each round every
    vertex hooks to a neighbour (or itself) by a hash order that is new in that
    round, edges are relabelled and deduplicated, and the mapping is kept; the
    expected number of vertices with edges falls by a constant factor. In the
    end the mappings are expanded backwards, and names come back. Keys that at
    least HOT_SHARE of the rows have, at most 100 as counted, are looked up in a
    broadcast of their values and their rows spread; grouping aggregates before
    the shuffle, and each round's edges and mapping are written to the shared folder.
    """
    ends = pairs.select(F.col(left).alias("a"), F.col(right).alias("b")).where("a is not null and b is not null")
    names = ends.select(F.explode(F.array("a", "b")).alias("name"))
    if vertices is not None:
        names = names.unionByName(vertices.select(F.col(vertex).alias("name")).where("name is not null"))
    numbered = written(names.distinct().withColumn("id", F.monotonically_increasing_id()))

    unequal = ends.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    by_a = lookup(unequal, "a", numbered.withColumnRenamed("name", "a").withColumnRenamed("id", "src"), "src", F.col("b")).select("src", "b")
    by_b = lookup(by_a, "b", numbered.withColumnRenamed("name", "b").withColumnRenamed("id", "dst"), "dst", F.col("src")).select("src", "dst")
    both = F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))))
    edges, total = written_counted(by_b.select(both.alias("e")).select("e.src", "e.dst"))
    mappings: list[tuple[DataFrame, int]] = []
    while total:
        reps, n_vertices = written_counted(_representatives(edges, len(mappings)))
        # Edges stand in both directions, so a vertex is as hot among the targets as among the sources.
        hot = [r.vertex for r in reps.where(F.col("degree") >= total * HOT_SHARE).select("vertex").collect()] if total >= 1 / HOT_SHARE**2 else []
        mapping = reps.select("vertex", "rep")
        mappings.append((mapping, n_vertices))
        by_src = _with_value(edges, "src", mapping.select(F.col("vertex").alias("src"), F.col("rep").alias("a")), "a", F.col("dst"), hot).select("a", "dst")
        by_dst = _with_value(by_src, "dst", mapping.select(F.col("vertex").alias("dst"), F.col("rep").alias("b")), "b", F.col("a"), hot)
        contracted, total = written_counted(by_dst.where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct())
        discard(edges)
        edges = contracted
    discard(edges)

    if not mappings:
        return numbered.select(F.col("name").alias(out_vertex), F.col("name").alias(out_group))
    # Backwards: the label of a vertex is the label of its representative, or the representative itself.
    labels, passed = mappings[-1][0].withColumnRenamed("rep", "label"), []
    for at, (mapping, n_vertices) in reversed(list(enumerate(mappings[:-1]))):
        counts = mapping.groupBy("rep").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= n_vertices * HOT_SHARE)
        hot = [r.rep for r in counts.collect()] if n_vertices >= 1 / HOT_SHARE**2 else []
        hooked = _with_value(mapping, "rep", labels.withColumnRenamed("vertex", "rep"), "label", F.col("vertex"), hot)
        labels = hooked.select("vertex", F.coalesce("label", "rep").alias("label"))
        passed.append(mapping)
        if at % 2 == 0:  # two rounds are expanded together
            labels = written(labels)
            passed = [discard(done) for done in passed][:0]
    # Names are compared by their UTF-8 bytes, which is code point order.
    named = written(numbered.join(labels.withColumnRenamed("vertex", "id"), "id", "left").select("name", "label"))
    discard(labels)
    least = named.where("label is not null").groupBy("label").agg(F.min("name").alias("least"))
    grouped = lookup(named, "label", least, "least", F.col("name"))
    return grouped.select(F.col("name").alias(out_vertex), F.coalesce("least", "name").alias(out_group))


def _labels(out_vertex: str, out_group: str):
    """The least name of each connected group of the pairs ``a``, ``b`` of whole known groups, names alone having no ``b``."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        names = sorted(set(rows["a"]) | set(rows["b"].dropna()))
        number = {x: i for i, x in enumerate(names)}
        root = list(range(len(names)))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        both = rows[rows["b"].notna()]
        for a, b in zip(both["a"], both["b"], strict=True):
            x, y = find(number[a]), find(number[b])
            root[max(x, y)] = min(x, y)
        return pd.DataFrame({out_vertex: names, out_group: [names[find(i)] for i in range(len(names))]}, dtype=object)

    return run


def groups_within(pairs: DataFrame, left: str, right: str, vertices: DataFrame, vertex: str, known: DataFrame,
                  out_vertex: str = "vertex", out_group: str = "group_name", small: int = SMALL) -> DataFrame:
    """``connected_groups`` of pairs that never leave a known group (``name``, ``component``) of their names.

    Known groups of up to ``small`` pairs and names are cut up in tasks, many to a task; larger ones by ``connected_groups``.
    """
    ends = pairs.select(F.col(left).alias("a"), F.col(right).alias("b")).where("a is not null and b is not null")
    ends = ends.unionByName(vertices.select(F.col(vertex).alias("a")).where("a is not null"), allowMissingColumns=True)
    placed, n = written_counted(lookup(ends, "a", known.select(F.col("name").alias("a"), "component"), "component", F.xxhash64("b")))
    large = written(placed.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > small).select("component"))
    share = F.pmod(F.xxhash64("component"), F.lit(max(n // ROWS + 1, int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")))))
    found = placed.join(large, "component", "left_anti").groupBy(share.alias("share")).applyInPandas(_labels(out_vertex, out_group), f"{out_vertex} string, {out_group} string")
    if large.isEmpty():
        return found
    rest = written(placed.join(large, "component", "left_semi"))
    return found.unionByName(connected_groups(rest.where("b is not null"), "a", "b", rest, "a", out_vertex, out_group))
