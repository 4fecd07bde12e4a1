"""Spine ends against a ranking of all pairs of tips."""

import heapq
import itertools
import random

from weftline.operators import graph, spines
from weftline.operators.components import connected_groups


def ranked(pairs, lengths, tips):
    near, out = {}, {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    for t in tips:
        done, heap = {}, [(lengths[t], t)]
        while heap:
            bp, n = heapq.heappop(heap)
            if n not in done:
                done[n] = bp
                for m in near[n] - done.keys():
                    heapq.heappush(heap, (bp + lengths[m], m))
        for u in tips:
            if u != t and u in done:
                out[min(t, u), max(t, u)] = done[u]
    return sorted(out.items(), key=lambda x: (-x[1], x[0]))


def test_all_pairs_of_tips_are_ranked(spark):
    rng = random.Random(5)
    # A tree whose runner-up doesn't hold the tip of least name, and components with cycles.
    rows = [("aB", "+", "ax", "+"), ("ax", "+", "aP", "+"), ("ax", "+", "aQ", "+")]
    lengths = {"aB": 970, "ax": 10, "aP": 20, "aQ": 10}
    for c in "bcde":
        core = [f"{c}k{i}" for i in range(9)]
        rows += [(core[i], "+", core[(i + 1) % 9], "+") for i in range(9)] + [(rng.choice(core), rng.choice("+-"), rng.choice(core), rng.choice("+-")) for _ in range(3)]
        rows += [(f"{c}t{i:02}", "+", rng.choice(core), rng.choice("+-")) for i in range(14)]
    rows += [(f"f{i:02}", "+", "fhub", "+") for i in range(25)]
    for n in sorted({n for r in rows for n in (r[0], r[2])}):
        lengths.setdefault(n, rng.randrange(1, 400) if n[0] != "e" else 100)
    links = spark.createDataFrame([(i, *r, "0M", None) for i, r in enumerate(rows)], "link_id long, from_seg string, from_orient string, to_seg string, to_orient string, overlap string, tags string")
    segments = spark.createDataFrame([(i, n, "*", v) for i, (n, v) in enumerate(lengths.items())], "seg_id long, name string, seq string, seg_len long")
    edges = graph.half_edges(links)
    groups = connected_groups(links, "from_seg", "to_seg", segments, "name", "name", "component")
    tips = [r.node for r in graph.tips(edges, segments).collect()]
    lengths_ = graph.segment_lengths(segments)
    got = {r.component[0]: r for r in spines.spine_ends(edges, segments, groups, lengths_).collect()}
    assert {r.component[0]: r for r in spines.spine_ends(edges, segments, groups, lengths_, small=0).collect()} == got
    assert set(got) == set("abcdef")
    for c, r in got.items():
        order = ranked([(x[0], x[2]) for x in rows if x[0][0] == c], lengths, [t for t in tips if t[0] == c])
        assert (r.tip_a, r.tip_b, r.spine_bp, r.second_bp, r.ambiguous) == (*order[0][0], order[0][1], order[1][1], order[0][1] - order[1][1] < 100)
    assert (got["a"].spine_bp, got["a"].second_bp) == (1000, 990)
    assert spines.spine_ends(edges.limit(0), segments, groups, graph.segment_lengths(segments)).count() == 0


def test_a_hub_of_ten_thousand_neighbours_is_searched_in_a_task(spark, monkeypatch):
    """Such components went by joins, a round a level, and took minutes (F3, F5)."""
    n = 11_000
    links = spark.createDataFrame([(i, f"t{i:05}", "+", "hub", "+", "0M") for i in range(n)], "link_id long, from_seg string, from_orient string, to_seg string, to_orient string, overlap string")
    segments = spark.createDataFrame([(i, f"t{i:05}", i % 1000) for i in range(n)] + [(n, "hub", 7)], "seg_id long, name string, seg_len long")
    groups = segments.selectExpr("name", "'hub' as component")
    monkeypatch.setattr(spines, "_spines_by_joins", None)
    rows = spines.spine_ends(graph.half_edges(links), segments, groups, graph.segment_lengths(segments)).collect()
    assert [tuple(r) for r in rows] == [("hub", n + 1, "t00999", "t01999", 2005, 2005, True)]
