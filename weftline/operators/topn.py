"""The N best rows of every group, by merging sorted runs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a split that are sorted into one run.
RUN_ROWS = 200_000
#: Runs of a group that are merged at a time.
FAN = 256
RUN = "run long, grp string, score long, tie string, id long, f1 long, f2 long"


class LoserTree:
    """Tournament over the heads of sorted runs; ``None`` is the head of a run at its end."""

    def __init__(self, heads: list) -> None:
        self.k = len(heads)
        self.heads = heads
        self.losers = [-1] * self.k
        for i in range(self.k):
            self._settle(i, building=True)

    def _less(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return x is not None and (y is None or x < y)

    def _settle(self, winner: int, building: bool = False) -> None:
        at = (winner + self.k) // 2
        while at > 0:
            other = self.losers[at]
            if other < 0 and building:
                self.losers[at] = winner
                return
            if other >= 0 and self._less(other, winner):
                self.losers[at], winner = winner, other
            at //= 2
        self.losers[0] = winner

    def replace(self, head) -> None:
        """Put the next head of the winning run in place."""
        winner = self.losers[0]
        self.heads[winner] = head
        self._settle(winner)


def _best(pdf: pd.DataFrame, n: int) -> pd.DataFrame:
    """Sorted, without copies, and no more than ``n`` rows of a group."""
    pdf = pdf.assign(low=-pdf["score"]).sort_values(["grp", "low", "tie", "id"], kind="stable", ignore_index=True)
    changed = (pdf["grp"] != pdf["grp"].shift()).to_numpy()
    same = np.cumsum(changed | (pdf["score"] != pdf["score"].shift()).to_numpy() | (pdf["tie"] != pdf["tie"].shift()).to_numpy())
    # By number: pandas takes strings to end at a NUL when it looks for repeats.
    pdf = pdf.assign(no=np.cumsum(changed), same=same).drop_duplicates(["same", "f1", "f2"])
    return pdf[pdf.groupby("no").cumcount() < n].drop(columns=["low", "no", "same"])


def _make_runs(n: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        base, made, held, rows = TaskContext.get().partitionId() << 32, 0, [], 0
        for pdf in batches:
            held.append(pdf)
            rows += len(pdf)
            if rows >= RUN_ROWS:
                yield _best(pd.concat(held), n).assign(run=base + made)
                made, held, rows = made + 1, [], 0
        if held:
            yield _best(pd.concat(held), n).assign(run=base + made)

    return run


def _merged(runs: list[list[tuple]], n: int) -> list[tuple]:
    """The ``n`` best items of one group from sorted runs of (score downwards, tie, id, print, print); copies count once."""
    tree, cursor = LoserTree([run[0] for run in runs]), [0] * len(runs)
    out, seen = [], set()
    while len(out) < n and (item := tree.heads[winner := tree.losers[0]]) is not None:
        copy = (item[0], item[1], item[3], item[4])
        if copy not in seen:
            seen.add(copy)
            out.append(item)
        at = cursor[winner] = cursor[winner] + 1
        tree.replace(runs[winner][at] if at < len(runs[winner]) else None)
    return out


def _merge_runs(n: int):
    """Over a bucket's runs in order of group and run: a group's runs are merged as they come, FAN at a time, and what follows its ``n`` best is passed over."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, last, runs = None, None, []
        for pdf in batches:
            groups, numbers = pdf["grp"].to_numpy(), pdf["run"].to_numpy()
            items = list(zip((-pdf["score"]).tolist(), pdf["tie"].tolist(), pdf["id"].tolist(), pdf["f1"].tolist(), pdf["f2"].tolist(), strict=True))
            cuts = [0, *(np.flatnonzero((groups[1:] != groups[:-1]) | (numbers[1:] != numbers[:-1])) + 1).tolist(), len(items)]
            out = []
            for start, end in zip(cuts, cuts[1:], strict=False):
                if start == end:
                    continue
                if groups[start] != group:
                    if runs:
                        out += [(group, item[2], place + 1) for place, item in enumerate(_merged(runs, n))]
                    group, last, runs = groups[start], None, []
                if numbers[start] == last:  # a run that goes on from the batch before
                    runs[-1] += items[start:end]
                else:
                    if len(runs) == FAN:
                        runs = [_merged(runs, n)]
                    runs.append(items[start:end])
                    last = numbers[start]
            yield pd.DataFrame(out, columns=["grp", "id", "place"])
        if runs:
            yield pd.DataFrame([(group, item[2], place + 1) for place, item in enumerate(_merged(runs, n))], columns=["grp", "id", "place"])

    return run


def top_n_per_group(df: DataFrame, group: str, score: str, tie: str, row_id: str, n: int = 3, ignored: tuple[str, ...] = ()) -> DataFrame:
    """``group``, ``row_id``, ``place`` of the ``n`` best rows of each group.

    Order: ``score`` descending, then ``tie`` and ``row_id`` ascending (strings
    by code point). Rows with a null group, score, tie or id don't take part;
    groups of fewer rows give all they have; an empty table gives none. Rows
    that agree in every column but ``row_id`` and ``ignored`` (null equals null)
    are one item, for which the smallest id stands; they are recognised by 128
    bits of hash beside group, score and tie.

    Each input split makes runs ordered by group and score, of which no group
    keeps more than ``n`` items, so a hot group shrinks before the shuffle.
    Runs are stored by bucket of the group, within a bucket by group and then
    run; each bucket is read as a stream, the runs of a group are merged
    with a loser tree, and after ``n`` outputs the rest of the group is passed over. A
    task holds a batch and FAN runs of one group, whatever the size of a bucket.
    """
    rest = [F.col(f"`{c}`") for c in sorted(df.columns) if c not in (row_id, *ignored)]
    # A null is skipped by the hash, so which columns are null is hashed as well.
    rest.append(F.concat(*(c.isNull().cast("int").cast("string") for c in rest)) if rest else F.lit(""))
    prints = [F.xxhash64(F.lit(seed), *rest) for seed in (11, 47)]
    rows = df.select(
        F.col(group).alias("grp"), F.col(score).cast("long").alias("score"), F.col(tie).cast("string").alias("tie"),
        F.col(row_id).cast("long").alias("id"), prints[0].alias("f1"), prints[1].alias("f2"),
    ).where("grp is not null and score is not null and tie is not null and id is not null")
    kind = dict(rows.dtypes)["grp"]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = rows.withColumn("grp", F.col("grp").cast("string")).mapInPandas(_make_runs(n), RUN)
    order = ["grp", "run", F.col("score").desc(), "tie", "id"]
    merged = runs.repartition(parts, "grp").sortWithinPartitions(*order).mapInPandas(_merge_runs(n), "grp string, id long, place int")
    return merged.select(F.col("grp").cast(kind).alias(group), F.col("id").alias(row_id), "place")
