import random
import tracemalloc
from collections import Counter, defaultdict

import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st

from weftline.operators.heavy import heavy_keys, per_key_totals
from weftline.operators.intervals import DisjointIntervals, periods_and_gaps
from weftline.operators.topn import LoserTree, _merge_runs, top_n_per_group


def test_totals_of_uneven_keys(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["hot"] * 60 + [None, "", "a\x00b", "a\x00c"] + [f"k{i}" for i in range(40)]), rng.choice([None, 1, 2**60])) for _ in range(3000)]
    df = spark.createDataFrame([(k, v, "x", 1) for k, v in rows if v != 2**60 or k == "hot" and rng.random() < 0.002], "key string, value long, n string, code int")
    rows = [(r.key, r.value) for r in df.collect()]
    n, total = Counter(k for k, _ in rows), defaultdict(int)
    for k, v in rows:
        total[k] += v or 0
    got = per_key_totals(df, "key", "value")
    assert {(r.key_name, r.n_rows, r.total) for r in got.collect()} == {(k, n[k], total[k]) for k in n}
    assert {r.key_name for r in heavy_keys(got, 0.02).collect()} == {k for k in n if k is not None and n[k] >= 0.02 * len(rows)}
    assert per_key_totals(df.limit(0), "key", "value").count() == 0


def test_loser_tree_merges():
    rng = random.Random(2)
    for k in (1, 2, 3, 7, 16):
        runs = [sorted(rng.randrange(50) for _ in range(rng.randrange(1, 9))) for _ in range(k)]
        at, tree, out = [0] * k, LoserTree([r[0] for r in runs]), []
        while tree.heads[w := tree.losers[0]] is not None:
            out.append(tree.heads[w])
            at[w] += 1
            tree.replace(runs[w][at[w]] if at[w] < len(runs[w]) else None)
        assert out == sorted(x for r in runs for x in r)


def test_top_n_with_copies_ties_and_nulls(spark):
    rng = random.Random(4)
    rows = []
    for i in range(1500):
        rows.append((i, rng.choice(["hot"] * 20 + ["a", "b", "c\x00", "c\x01", None]), rng.choice([None, 5, 6, 7]), rng.choice(["t", "u", "é", None]), rng.choice([None, "", "x"]), i))
    df = spark.createDataFrame(rows, "id long, q string, len long, t string, grp string, sent long").repartition(7)
    best = {}
    for i, q, n, t, g, _ in rows:
        if q is not None and n is not None and t is not None:
            best.setdefault(q, {}).setdefault((-n, t, g), i)
    want = {(q, i, p + 1) for q, items in best.items() for p, (_, _, i) in enumerate(sorted((n, t, i) for (n, t, _), i in items.items())[:3])}
    assert {tuple(r) for r in top_n_per_group(df, "q", "len", "t", "id", 3, ("sent",)).collect()} == want
    assert top_n_per_group(df.limit(0), "q", "len", "t", "id", 3, ("sent",)).count() == 0


def merged(intervals):
    out = []
    for s, e in sorted(intervals):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


def test_disjoint_map():
    rng = random.Random(5)
    for _ in range(200):
        intervals = [(s, s + rng.randrange(1, 6)) for s in (rng.randrange(30) for _ in range(rng.randrange(1, 12)))]
        kept, held = DisjointIntervals(), 0
        for s, e in intervals:
            held += kept.insert(s, e)
        assert list(zip(kept.starts, kept.ends, strict=True)) == merged(intervals) and held == len(kept.starts)


def test_periods_across_zones(spark):
    rng = random.Random(6)
    rows = [(rng.choice(["e", "f", None]), rng.choice(["t", "u"]), s, s + rng.choice([1, 2, 9, 40])) for s in (rng.randrange(300) for _ in range(150))]
    rows += [("e", "t", 5, 5), ("e", "t", 9, 3), ("e", "t", None, 4), ("g", "t", 0, 1000), ("g", "t", 10, 20), ("g", "t", 990, 2000), ("g", "u", -20, -3)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "a string, t string, s long, e long, zone int, kind string").repartition(5)
    by = defaultdict(list)
    for a, t, s, e in rows:
        if s is not None and s < e:
            by[a, t].append((s, e))
    want = set()
    for (a, t), intervals in by.items():
        periods = merged(intervals)
        want |= {(a, t, "period", s, e) for s, e in periods} | {(a, t, "gap", x[1], y[0]) for x, y in zip(periods, periods[1:], strict=False)}
    for width in (7, 64, 1 << 18):
        assert {tuple(r) for r in periods_and_gaps(df, ["a", "t"], "s", "e", width).collect()} == want
    assert periods_and_gaps(df.limit(0), ["a", "t"], "s", "e").count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(1, 9)), max_size=30))
def test_gaps_follow_every_insertion(spans):
    held, covered = DisjointIntervals(), set()
    for start, size in spans:
        held.insert(start, start + size)
        covered |= set(range(start, start + size))
        assert {x for s, e in zip(held.starts, held.ends, strict=True) for x in range(s, e)} == covered
        assert held.gaps == list(zip(held.ends, held.starts[1:], strict=False))


def test_a_bucket_is_merged_as_a_stream():
    """A task's memory doesn't grow with its bucket, nor with the runs of one group."""

    def batches(n_groups, n_runs):
        rows = ((f"g{g:06}", r, 100 - p, "t", (g * n_runs + r) * 3 + p, r, p) for g in range(n_groups) for r in range(n_runs) for p in range(3))
        while held := [row for row, _ in zip(rows, range(1_000), strict=False)]:
            yield pd.DataFrame(held, columns=["grp", "run", "score", "tie", "id", "f1", "f2"])

    def peak(n_groups, n_runs):
        tracemalloc.start()
        found = sum(len(out) for out in _merge_runs(3)(batches(n_groups, n_runs)))
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert found == 3 * n_groups
        return most

    small = peak(200, 5)
    assert peak(4_000, 5) < 2 * small
    assert peak(1, 20_000) < 3 * small
