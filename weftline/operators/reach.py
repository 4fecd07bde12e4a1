"""What can be reached from many sources at once: component by component in tasks, or by one frontier join a level."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from weftline.operators.components import connected_groups
from weftline.operators.skew import lookup
from weftline.session import written, written_counted

#: Levels of a search that are merged into one table.
LEVELS = 8
#: Components of up to so many steps are searched in tasks, larger ones by joins; the rows are the same.
SMALL = 1_000_000
#: Sources times steps of a component that one task searches, and sources times states that it holds at once.
SEARCHED, HELD = 4_000_000, 4_000_000
#: Rows that a task returns at a time.
ROWS = 100_000
STEP, SOURCE, BARRIER = range(3)


def reached(steps: DataFrame, sources: DataFrame, state: list[str], barrier: DataFrame | None = None, groups: DataFrame | None = None, small: int = SMALL) -> DataFrame:
    """``source``, the columns of ``state``, ``depth`` and ``parent`` of all states reached from each source, itself at depth 0.

    ``sources`` holds ``source`` and ``state`` (strings); ``steps`` holds ``state`` and,
    under ``to_`` names, where each step leads. The parent is the least state of the level
    before that leads there, as text. States of ``barrier`` (``source`` and
    ``state``) are reached but not left. Null states lead nowhere.

    No step leaves its component (``groups``, ``name`` and ``component`` of the
    first column of ``state``; found here if not given). So the steps of a component of up to ``small``
    go to as many tasks as its sources need, and are searched there; larger
    components are searched together, level by level, by joins.
    """
    first, key = state[0], ["source", *state]
    to = [f"to_{c}" for c in state]
    known = reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in (*state, *to)))
    steps = written(steps.select(*state, *to).where(known).distinct())
    sources = written(sources.select(*key).distinct())
    barrier = sources.select(*key).limit(0) if barrier is None else barrier.select(*key).distinct()
    if groups is None:
        groups = written(connected_groups(steps, first, f"to_{first}", sources, first, "name", "component"))
    named = groups.select(F.col("name").alias(first), "component")
    parts = [lookup(df, first, named, "component", F.xxhash64(*spread)).withColumn("kind", F.lit(kind)) for kind, df, spread in ((STEP, steps, to), (SOURCE, sources, key), (BARRIER, barrier, key))]
    placed = written(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts))
    counts = placed.groupBy("component").agg(F.sum((F.col("kind") == STEP).cast("long")).alias("n_steps"), F.sum((F.col("kind") == SOURCE).cast("long")).alias("n_sources"))
    counts = written(counts.where("n_sources > 0 and component is not null"))
    large = counts.where(F.col("n_steps") > small).select("component")
    shares = counts.select("component", F.ceil(F.col("n_sources") * (F.col("n_steps") + 1) / SEARCHED).alias("n_shares"))

    here = placed.join(large, "component", "left_anti").join(shares, "component", "left").where(f"component is not null or kind = {SOURCE}")
    # A source's share is that of its hash; steps go to all shares.
    n_shares, source_share = F.coalesce("n_shares", F.lit(1)), F.pmod(F.xxhash64("source"), F.coalesce("n_shares", F.lit(1)))
    every = F.when(F.col("kind") == STEP, F.sequence(F.lit(0).cast("long"), n_shares - 1)).otherwise(F.array(source_share))
    shared = here.where(f"n_shares is not null or kind = {SOURCE}").select("component", "kind", *key, *to, F.explode(every).alias("share"))
    n = 4 * int(steps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = StructType([sources.schema["source"], *(StructField(c, StringType()) for c in state), StructField("depth", IntegerType()), StructField("parent", StringType())])
    found = shared.repartition(n, "component", "share").groupBy("component", "share").applyInArrow(_search(state), schema)
    if large.isEmpty():
        return found
    part = lambda kind, *columns: placed.where(F.col("kind") == kind).join(large, "component", "left_semi").select(*columns)
    return found.unionByName(_reached_by_joins(part(STEP, *state, *to), part(SOURCE, *key), state, part(BARRIER, *key)))


def _search(state: list[str]):
    """All searches of some sources of one component: steps, sources and barriers told apart by ``kind``.

    States are numbered in the order of their text, and all sources take each
    level together, a source and a state being one number.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches)).combine_chunks()
        whole = lambda c: rows[c].chunk(0)
        kind = whole("kind").to_numpy(zero_copy_only=False)
        is_step, is_source = pa.array(kind == STEP), pa.array(kind == SOURCE)
        if not (kind == SOURCE).any():
            return
        code, columns = np.zeros(len(kind) + int((kind == STEP).sum()), np.int64), []
        for c in state:
            both = pa.concat_arrays([whole(c), whole(f"to_{c}").filter(is_step)]).dictionary_encode(null_encoding="encode")
            code = code * len(both.dictionary) + both.indices.to_numpy(zero_copy_only=False)
            columns.append(both.dictionary)
        values, number = np.unique(code, return_inverse=True)
        texts = []
        for dictionary in reversed(columns):
            texts.append(dictionary.take(pa.array(values % len(dictionary))))
            values = values // len(dictionary)
        text = pc.binary_join_element_wise(*reversed(texts), "")
        order = pc.sort_indices(text)
        columns, text, n = [t.take(order) for t in reversed(texts)], text.take(order), len(text)
        place = np.empty(n, np.int64)
        place[order.to_numpy()] = np.arange(n)
        number = place[number]
        at, to = number[: len(kind)], number[len(kind) :]
        leaving = at[kind == STEP]
        to = to[np.argsort(leaving, kind="stable")]
        ends = np.concatenate([[0], np.cumsum(np.bincount(leaving, minlength=n))])

        names = whole("source").filter(is_source).dictionary_encode(null_encoding="encode")
        names, source = names.dictionary, names.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        begin = np.unique(source * n + at[kind == SOURCE])
        barred = pc.index_in(whole("source").filter(pa.array(kind == BARRIER)), value_set=names).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        barred = np.unique((barred * n + at[kind == BARRIER])[barred >= 0])

        def rows_of(keys: np.ndarray, depths: np.ndarray, parents: np.ndarray) -> Iterator[pa.RecordBatch]:
            for i in range(0, len(keys), ROWS):
                some, parent = keys[i : i + ROWS], parents[i : i + ROWS]
                states = pa.array(some % n)
                yield pa.RecordBatch.from_arrays(
                    [names.take(pa.array(some // n)), *(c.take(states) for c in columns), pa.array(depths[i : i + ROWS]), text.take(pa.array(parent, mask=parent < 0))], ["source", *state, "depth", "parent"])

        width = max(1, HELD // n)
        for low in range(0, len(names), width):
            high = min(low + width, len(names))
            some = lambda x: x[np.searchsorted(x, low * n) : np.searchsorted(x, high * n)]  # noqa: B023, E731
            seen, stop = np.zeros((high - low) * n, bool), np.zeros((high - low) * n if len(barred) else 0, bool)
            if len(barred):
                stop[some(barred) - low * n] = True
            keys = some(begin) - low * n
            parents, depth, waiting, n_waiting = np.full(len(keys), -1), 0, [], 0
            while len(keys):
                seen[keys] = True
                waiting.append((keys + low * n, np.full(len(keys), depth, np.int32), parents))
                n_waiting += len(keys)
                if n_waiting >= ROWS:
                    yield from rows_of(*map(np.concatenate, zip(*waiting, strict=True)))
                    waiting, n_waiting = [], 0
                if len(stop):
                    keys = keys[~stop[keys]]
                own = keys % n
                degree = ends[own + 1] - ends[own]
                by = np.repeat(np.arange(len(keys)), degree)
                way = np.arange(len(by)) + np.repeat(ends[own] - (np.cumsum(degree) - degree), degree)
                next_ = (keys - own)[by] + to[way]
                fresh = ~seen[next_]
                both = np.sort(next_[fresh] * n + own[by[fresh]])  # the least parent comes first
                next_ = both // n
                is_first = np.ones(len(next_), bool)
                is_first[1:] = next_[1:] != next_[:-1]
                keys = next_[is_first]
                parents, depth = both[is_first] - keys * n, depth + 1
            if waiting:
                yield from rows_of(*map(np.concatenate, zip(*waiting, strict=True)))

    return run


def _reached_by_joins(steps: DataFrame, sources: DataFrame, state: list[str], barrier: DataFrame) -> DataFrame:
    """The searches of large components: those of all sources take each level together, and end when none finds a state it hasn't seen."""
    key = ["source", *state]
    text = F.concat(*state)
    steps, barrier = written(steps), written(barrier)
    frontier, n = written_counted(sources.select(*key).withColumn("depth", F.lit(0)).withColumn("parent", F.lit(None).cast("string")))
    tables, depth = [], 0
    while n:
        tables.append(frontier)
        if len(tables) > LEVELS:
            tables = [written(reduce(DataFrame.unionByName, tables))]
        depth += 1
        leaving = frontier.select(*key).join(barrier, key, "left_anti")
        found = leaving.withColumn("parent", text).join(steps, state).select("source", *(F.col(f"to_{c}").alias(c) for c in state), "parent")
        found = found.groupBy(*key).agg(F.min("parent").alias("parent"))
        for seen in tables:
            found = found.join(seen.select(*key), key, "left_anti")
        frontier, n = written_counted(found.select(*key, F.lit(depth).alias("depth"), "parent"))
    return reduce(DataFrame.unionByName, [*tables, frontier])
