"""Routing, pruning, cutting and searching on small graphs by hand."""

import random

from weftline.operators import graph, pruning, reach
from weftline.operators.components import connected_groups
from weftline.sources import text_formats as t

LINKS = "link_id long, from_seg string, from_orient string, to_seg string, to_orient string, overlap string, tags string, comp_id string"
SEGMENTS = "seg_id long, name string, seq string, seg_len long, component string"


def links(spark, pairs):
    return spark.createDataFrame([(i, a, "+", b, "+", "0M", None, "x") for i, (a, b) in enumerate(pairs)], LINKS)


def segments(spark, lengths):
    return spark.createDataFrame([(i, n, "*", v, "x") for i, (n, v) in enumerate(lengths.items())], SEGMENTS)


def test_spine_rounds(spark):
    """A spine a-b-c with a dead end e and a tail of its own behind it, a pair, a lone segment."""
    pairs = [("a", "b"), ("b", "c"), ("b", "e"), ("p", "q"), (None, "a")]
    decisions, kept = pruning.spine_rounds(links(spark, pairs), segments(spark, {"a": 10, "b": 20, "c": 5, "e": 3, "p": 1, "q": 1, "lone": 9, None: 4}), 1, 10, 2)
    rows = {r.comp_id: tuple(r)[1:] for r in decisions.collect()}
    assert rows == {
        "0.a": (0, "ok", 4, 3, "a", "c", 35, True, 33), "0.p": (0, "ok", 2, 2, "p", "q", 2, False, 0), "0.lone": (0, "too_few_tips", 1, 0, None, None, 0, False, 0),
        "1.e": (1, "too_few_tips", 1, 0, None, None, 0, False, 0),
    }
    assert {tuple(r) for r in kept.collect()} == {("a", "0.a"), ("b", "0.a"), ("c", "0.a"), ("p", "0.p"), ("q", "0.p"), ("lone", "0.lone")}
    none = pruning.spine_rounds(links(spark, []), segments(spark, {}))
    assert none[0].count() == 0 and none[1].count() == 0


def test_short_dead_ends_are_cut_from_either_side(spark):
    made = links(spark, [("a", "b"), ("a", "c"), ("x", "y")])
    back = spark.createDataFrame([(7, "b", "-", "a", "-", "0M", None, "x"), (8, "c", "-", "a", "-", None, None, "x")], LINKS)
    both = made.unionByName(back)
    cut = pruning.short_dead_ends(graph.half_edges(both), graph.segment_lengths(segments(spark, {"a": 1, "b": 5, "c": 9})))
    assert {tuple(r) for r in cut.collect()} == {("a", 1, "b", 0)}
    assert {r.link_id for r in pruning.without_links(both, cut).collect()} == {1, 2, 8}
    assert pruning.without_links(both, cut.limit(0)).count() == 5


def test_searches_of_many_sources(spark):
    steps = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("b", "d"), ("c", "d"), ("d", "e"), ("a", "b")], "node string, to_node string")
    sources = spark.createDataFrame([(1, "a"), (2, "d"), (3, "nowhere")], "source long, node string")
    found = {tuple(r) for r in reach.reached(steps, sources, ["node"]).collect()}
    assert found == {(1, "a", 0, None), (1, "b", 1, "a"), (1, "c", 2, "b"), (1, "d", 2, "b"), (1, "e", 3, "d"), (2, "d", 0, None), (2, "e", 1, "d"), (3, "nowhere", 0, None)}
    barrier = spark.createDataFrame([(1, "b")], "source long, node string")
    assert {(r.source, r.node) for r in reach.reached(steps, sources, ["node"], barrier).collect()} == {(1, "a"), (1, "b"), (2, "d"), (2, "e"), (3, "nowhere")}
    chain = spark.createDataFrame([(f"{i:03}", f"{i + 1:03}") for i in range(24)], "node string, to_node string")
    far = reach.reached(chain, spark.createDataFrame([(0, "000")], "source long, node string"), ["node"])
    assert {(r.node, r.depth) for r in far.collect()} == {(f"{i:03}", i) for i in range(25)}
    assert reach.reached(steps, sources.limit(0), ["node"]).count() == 0


def test_searches_in_tasks_and_by_joins_agree(spark, monkeypatch):
    """Components searched in tasks, in many shares and a source at a time, and by joins (F1); against a search by hand."""
    rng = random.Random(3)
    pairs = {(f"{c}{rng.randrange(n)}", rng.choice("+-"), f"{c}{rng.randrange(n)}", rng.choice("+-")) for c, n in (("a", 40), ("b", 12), ("c", 3)) for _ in range(4 * n)}
    steps = spark.createDataFrame(sorted(pairs), "node string, orient string, to_node string, to_orient string")
    begin = [(i, rng.choice("ab") + str(rng.randrange(12)), rng.choice("+-")) for i in range(60)] + [(3, "c1", "+"), (60, "nowhere", "+"), (61, None, "+")]
    stops = {(i, f"a{rng.randrange(40)}", rng.choice("+-")) for i in range(60) for _ in range(2)}
    sources = spark.createDataFrame(begin, "source long, node string, orient string")
    barrier = spark.createDataFrame(sorted(stops), "source long, node string, orient string")
    expected = set()
    for source in {b[0] for b in begin}:
        level, depth, seen = {b[1:]: None for b in begin if b[0] == source}, 0, set()
        while level:
            seen |= set(level)
            expected |= {(source, *s, depth, p) for s, p in level.items()}
            onward = {}
            for a, b, c, d in sorted(pairs, key=lambda p: p[0] + p[1]):
                if (a, b) in level and (source, a, b) not in stops and (c, d) not in seen:
                    onward.setdefault((c, d), a + b)
            level, depth = onward, depth + 1
    assert len(expected) > 500
    monkeypatch.setattr(reach, "_reached_by_joins", None)
    for most in (reach.SEARCHED, 300):
        monkeypatch.setattr(reach, "SEARCHED", most)
        monkeypatch.setattr(reach, "HELD", most)
        monkeypatch.setattr(reach, "ROWS", most)
        found = reach.reached(steps, sources, ["node", "orient"], barrier).collect()
        assert len(found) == len(expected) and set(map(tuple, found)) == expected
    monkeypatch.undo()
    found = reach.reached(steps, sources, ["node", "orient"], barrier, small=30).collect()
    assert len(found) == len(expected) and set(map(tuple, found)) == expected


def test_records_go_to_their_component(spark, tmp_path):
    (tmp_path / "g.gfa").write_text("H\tv\nS\ta\t*\nS\tb\t*\nS\tz\t*\nS\tstray\t*\nL\ta\t+\tb\t+\t*\nP\tp\tb-,a+\t*\nW\ts\t1\tx\t0\t1\t<z\nW\ts\t1\tx\t0\t1\t\nA\tj\nX\tu\n")
    groups = connected_groups(links(spark, [("a", "b"), ("z", "z")]), "from_seg", "to_seg", None, None, "name", "component")
    targets = spark.createDataFrame([("a", "component_01"), ("z", "small_components")], "component string, target string")
    found = sorted((r.target, "\t".join(r.fields)) for r in t.routed(t.routes_of(t.read_records(spark, str(tmp_path / "g.gfa"))), groups, targets).collect())
    assert found == [
        ("component_01", "H\tv"), ("component_01", "L\ta\t+\tb\t+\t*"), ("component_01", "P\tp\tb-,a+\t*"), ("component_01", "S\ta\t*"), ("component_01", "S\tb\t*"), ("component_01", "X\tu"),
        ("small_components", "H\tv"), ("small_components", "S\tz\t*"), ("small_components", "W\ts\t1\tx\t0\t1\t<z"), ("small_components", "X\tu"),
    ]


def test_tip_tables_and_kmer_lines(spark, tmp_path):
    (tmp_path / "tips.tsv").write_text('comp_id\tstatus\ttip1\tsize\ttip2\n0.a\tok\ta"\t3\tc\n0.b\tok\t.\t1\t.\n')
    assert {(r.comp_id, tuple(r.tips)) for r in t.read_tips(spark, str(tmp_path / "tips.tsv")).collect()} == {("0.a", ('a"', "c")), ("0.b", ())}
    (tmp_path / "k.tsv").write_text("ACG\tx\ty\nACGT\tx\nACG\n\nTTT\tz\n")
    rows = [(r.kmer, r.node, r.good) for r in t.read_kmers(spark, str(tmp_path / "k.tsv"), 3).collect()]
    assert sorted(rows, key=str) == sorted([("ACG", "x\ty", True), (None, None, False), (None, None, False), (None, None, False), ("TTT", "z", True)], key=str)
    line = "q\t100\t1\t50\t+\t{}\t200\t5\t60\t40\t50\t60\n"
    (tmp_path / "a.paf").write_text(line.format("t") + line.format("u") + line.format("t").replace("q", "r", 1))
    asked = spark.createDataFrame([("q",), (None,)], "qname string")
    assert [r.tname for r in t.read_paf(spark, str(tmp_path / "a.paf"), 0, "t", asked).collect()] == ["t"]
