"""Registered walks, followed to their dead ends, against a search by hand."""

import hashlib
import random

import pytest

from weftline.operators import graph, walks
from weftline.plans import graph as plans

FLIP = {"+": "-", "-": "+"}


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    """A chain of 30, a star of 9 tips, a random component, and a segment alone."""
    rng = random.Random(3)
    rows = [(f"c{i:02}", "+", f"c{i + 1:02}", "+") for i in range(29)] + [("hub", rng.choice("+-"), f"t{i}", rng.choice("+-")) for i in range(9)]
    rows += [(f"r{rng.randrange(40):02}", rng.choice("+-"), f"r{rng.randrange(40):02}", rng.choice("+-")) for _ in range(60)]
    d = str(tmp_path_factory.mktemp("graph"))
    spark.createDataFrame([(i, *r, "3M", None) for i, r in enumerate(rows)], "link_id long, from_seg string, from_orient string, to_seg string, to_orient string, overlap string, tags string").write.parquet(f"{d}/links.parquet")
    names = sorted({n for r in rows for n in (r[0], r[2])} | {"lone"})
    lengths = {n: rng.randrange(1, 500) for n in names}
    spark.createDataFrame([(i, n, "*", lengths[n]) for i, n in enumerate(names)], "seg_id long, name string, seq string, seg_len long").write.parquet(f"{d}/segments.parquet")
    steps = {}
    for a, x, b, y in rows:
        steps.setdefault((a, x), set()).add((b, y))
        steps.setdefault((b, FLIP[y]), set()).add((a, FLIP[x]))
    return d, steps, lengths


def by_walk(rows):
    walks = {}
    for r in sorted(rows, key=lambda r: r.step):
        walks.setdefault((r.component, r.trial), []).append(r)
    return walks


def test_walks_end_at_dead_ends_only(spark, data):
    d, steps, lengths = data
    walks = by_walk(plans.h04_candidate_walks(spark, d).collect())
    for (_, trial), rows in walks.items():
        found = [(r.node, r.orient) for r in rows]
        walk, again = found[:1], (0, 1, 3, 8)[trial % 4]
        while ways := steps.get(walk[-1]):
            fresh = [w for w in ways if w[0] not in {n for n, _ in walk}]
            if not fresh and not again:
                break
            again -= not fresh
            walk.append(min(fresh or ways, key=lambda w: (hashlib.md5(f"{plans.SEED}|{trial}|{len(walk)}|{w[0]}|{w[1]}".encode()).hexdigest(), w)))
        total = 0
        for i, (n, _) in enumerate(walk):
            total = max(0, total + lengths[n] - (3 if i else 0))
        assert walk == found and rows[-1].length_bp == total
    trials = {}
    for component, _ in walks:
        trials[component] = trials.get(component, 0) + 1
    assert set(trials.values()) == {64}
    assert max(len(set(rows)) - len({r.node for r in rows}) for rows in walks.values()) > 0  # some do enter a node again


def test_small_and_large_components_walk_alike(spark, data):
    d, _, _ = data
    segments, links = (spark.read.parquet(f"{d}/{n}.parquet") for n in ("segments", "links"))
    groups = plans._groups(spark, d)
    starts, lengths = walks.walk_starts(graph.half_edges(links), segments, groups), graph.segment_lengths(segments)
    made = [walks.candidate_walks(walks.walk_steps(links), starts, groups, lengths, 3, 9, small) for small in (walks.SMALL, 40)]
    rows = [sorted(map(tuple, m.collect()), key=str) for m in made]
    assert rows[0] == rows[1] and len(rows[0]) > 100


def test_every_start_is_listed_and_used(spark, data):
    d, steps, _ = data
    names = {n for n, _ in steps}
    tips = {n: [o for o in "+-" if (n, o) in steps] for n in names}
    found = {}
    for r in plans.h02_walk_starts(spark, d).collect():
        found.setdefault(r.component, []).append((r.place, r.node, r.orient))
    star = sorted(n for n in names if n[0] in "th" and len(tips[n]) == 1)
    assert [(n, o) for _, n, o in sorted(found["hub"])] == [(n, tips[n][0]) for n in star] and len(star) >= 9
    assert all([p for p, *_ in sorted(v)] == list(range(len(v))) for v in found.values())
    assert {n for v in found.values() for _, n, _ in v} >= {n for n in names if len(tips[n]) == 1}
    used = {r.node for r in plans.h04_candidate_walks(spark, d).collect() if r.component == "hub" and r.step == 0}
    assert used == set(star)
