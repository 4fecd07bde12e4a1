from weftline.operators import extensions, graph, walks
from weftline.operators.alignments import place_contigs, scaffold, weighted_median
from weftline.operators.chimeras import absorb_islands, breakpoints
from weftline.operators.components import connected_groups

LINKS = "link_id long, from_seg string, from_orient string, to_seg string, to_orient string, overlap string, tags string"


def bubble(spark):
    """Two arms between a and d, a tail behind d, and a segment alone."""
    rows = [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "e"), (None, "a"), ("e", None)]
    links = spark.createDataFrame([(i, a, "+", b, "+", "2M", None) for i, (a, b) in enumerate(rows)], LINKS)
    segments = spark.createDataFrame([(1, "a", "ACGTA", 5), (2, "b", "TTT", 3), (3, "c", "GGGG", 4), (4, "d", "*", 7), (5, "e", "CCACC", 5), (6, "lone", None, None), (7, None, "A", 1)], "seg_id long, name string, seq string, seg_len long")
    return links, segments


def test_tips_bubbles_layers(spark):
    links, segments = bubble(spark)
    edges = graph.half_edges(links)
    assert {tuple(r) for r in graph.tips(edges, segments).collect()} == {("a", 0), ("e", 1)}
    assert {tuple(r) for r in graph.bubble_members(edges, segments).collect()} == {("b", "a", "d", 2), ("c", "a", "d", 2)}
    assert {tuple(r) for r in graph.layers(edges, graph.tips(edges, segments)).collect()} == {("a", 0), ("e", 0), ("b", 1), ("c", 1), ("d", 1)}
    assert graph.layers(edges.limit(0), graph.tips(edges, segments).limit(0)).count() == 0
    budgets = graph.visit_budgets(edges, segments, spark.createDataFrame([("b",), ("d",)], "qname string"))
    assert {r.node: r.budget for r in budgets.collect()} == {"a": 2, "b": 1, "c": 2, "d": 2, "e": 2, "lone": 2}


def test_component_summary(spark):
    links, segments = bubble(spark)
    got = {r.component: (r.n_segments, r.seg_bp, r.n_links, r.overlap_bp, r.unique_bp, r.rank) for r in graph.component_summary(links, segments, 10).collect()}
    assert got == {"a": (5, 24, 5, 10, 14, 1), "lone": (1, 0, 0, 0, 0, None)}


def test_walks_are_valid_and_repeatable(spark):
    links, segments = bubble(spark)
    edges = graph.half_edges(links)
    groups = connected_groups(links, "from_seg", "to_seg", segments, "name", "name", "component")
    lengths = graph.segment_lengths(segments)
    starts = walks.walk_starts(edges, segments, groups, 3)
    assert {tuple(r) for r in starts.collect()} == {("a", 0, "a", "+"), ("a", 1, "e", "-"), ("lone", 0, "lone", "+")}
    steps = walks.walk_steps(links)
    made = walks.candidate_walks(steps, starts, groups, lengths, 6, 7)
    found = made.collect()
    real = {tuple(r)[:4] for r in steps.collect()}
    per = {}
    for r in sorted(found, key=lambda r: r.step):
        per.setdefault((r.component, r.trial), []).append(r)
    assert len(per) == 12
    for (component, _), rows in per.items():
        states = [(r.node, r.orient) for r in rows]
        assert len({r.node for r in rows}) == len(rows) == (1 if component == "lone" else 4)
        assert all((*x, *y) in real for x, y in zip(states, states[1:], strict=False))
        assert rows[-1].length_bp == (0 if component == "lone" else 5 + 7 + 5 + (3 if "b" in [r.node for r in rows] else 4) - 6)
    again = walks.candidate_walks(steps.repartition(3), starts, groups, lengths, 6, 7).collect()
    assert sorted(map(tuple, found), key=str) == sorted(map(tuple, again), key=str)
    more = walks.candidate_walks(steps, starts, groups, lengths, 12, 7)
    pairs = walks.best_pairs(more, lengths)
    got = {r.component: r for r in pairs.collect()}
    assert (got["a"].first_bp, got["a"].second_bp, got["a"].union_bp, got["a"].symdiff_bp, got["a"].revisits, got["a"].nodes_covered) == (15, 14, 24, 7, 0, 5)
    assert got["lone"].second_trial is None
    summary = {r.component: tuple(r)[1:] for r in walks.walk_summary(pairs, groups, lengths).collect()}
    assert summary == {"a": (24, 15, 14, 24, 7, 0, 5, 5), "lone": (0, 0, 0, 0, 0, 0, 1, 1)}
    lines = {tuple(r)[2:] for r in walks.walk_lines(made).where("component = 'a'").collect()}
    assert lines <= {("a+,b+,d+,e+", ">a>b>d>e", "2M,2M,2M"), ("a+,c+,d+,e+", ">a>c>d>e", "2M,2M,2M"), ("e-,d-,b-,a-", "<e<d<b<a", "2M,2M,2M"), ("e-,d-,c-,a-", "<e<d<c<a", "2M,2M,2M")}
    assert [tuple(r)[2:] for r in walks.walk_lines(made).where("component = 'lone' and trial = 0").collect()] == [("lone+", ">lone", "*")]
    kept = spark.createDataFrame([("a", "ACGTA"), ("b", "TTT"), ("c", "GGGG"), ("d", "CACACAC"), ("e", "CCACC")], "name string, seq string")
    sequences = {r.sequence for r in walks.walk_sequences(made, kept).collect()}
    assert sequences and sequences <= {"ACGTATCACACACC", "ACGTAGGCACACACC", "GGTGGGTGTGACGT", "GGTGGGTGTGCCCGT"}
    assert walks.walk_sequences(made, extensions.kept_sequences(segments)).count() == 0  # d keeps no sequence
    assert walks.candidate_walks(steps.limit(0), starts.limit(0), groups, lengths, 6, 7).count() == 0


def test_sequences_over_links(spark):
    links, segments = bubble(spark)
    kept = extensions.kept_sequences(segments)
    got = {r.link_id: r.sequence for r in extensions.link_sequences(links, kept).collect()}
    assert got == {0: "ACGTAT", 1: "ACGTAGG"}
    ext = {tuple(r) for r in extensions.forward_extensions(graph.outgoing_steps(graph.half_edges(links)), kept, 4).collect()}
    assert {("a", "+", "TTT"), ("a", "+", "GGGG"), ("d", "+", "CCAC"), ("b", "-", "TACG"), ("c", "-", "TACG"), ("d", "-", "AAAT"), ("d", "-", "CCCC")} == ext


def test_islands_and_breakpoints(spark):
    absorbed = lambda rows: [tuple(r)[1:] for r in absorb_islands(spark.createDataFrame([("q", *r) for r in rows], "qname string, q_start long, q_end long, tname string")).orderBy("q_start").collect()]
    assert absorbed([(0, 30, "x"), (30, 40, "y"), (40, 80, "x"), (80, 90, "z")]) == [(0, 80, "x"), (80, 90, "z")]
    assert absorbed([(0, 10, "x"), (10, 40, "y"), (40, 50, "x")]) == [(0, 10, "x"), (10, 40, "y"), (40, 50, "x")]
    # An island that only its neighbours' growth makes small enough.
    assert absorbed([(0, 30, "x"), (30, 40, "y"), (40, 60, "x"), (60, 85, "y"), (85, 125, "x")]) == [(0, 125, "x")]
    assert absorbed([]) == []
    rows = [("q", 0, 9_000, 20_000, "x"), ("q", 11_000, 20_000, 20_000, "y"), ("p", 0, 20_000, 20_000, "x"), (None, 0, 9, 20, "x"), ("r", 5, 5, 9, "x")]
    paf = spark.createDataFrame(rows, "qname string, qstart long, qend long, qlen long, tname string")
    assert {tuple(r) for r in breakpoints(paf, 5_000, 5_000).collect()} == {("q", 0, 0, 10_000, "x"), ("q", 1, 10_000, 20_000, "y")}


def test_placement_and_scaffolds(spark):
    rows = [("k1", 1000, "+", "chrA", 0, 1000, 6000), ("k2", 500, "-", "chrA", 5000, 5500, 6000), ("k3", 80, "+", "chrA", 0, 10, 10), ("k4", 70, "+", "chrM", 0, 10, 9000), (None, 1, "+", "chrA", 0, 9, 9000)]
    paf = spark.createDataFrame(rows, "qname string, qlen long, strand string, tname string, tstart long, tend long, alnlen long")
    lines = scaffold(place_contigs(paf)).orderBy("object", "obj_start").collect()
    assert [tuple(r) for r in lines] == [
        ("chrA", 1, 1000, 1, "W", "k1", "+"), ("chrA", 1001, 1100, 2, "N", None, None), ("chrA", 1101, 1600, 3, "W", "k2", "-"), ("k3", 1, 80, 1, "W", "k3", "+")]
    values = spark.createDataFrame([("a", 10, 1), ("a", 20, 1), ("a", 30, 2), ("b", 5, None), ("b", None, 3)], "k string, v long, w long")
    assert [tuple(r) for r in weighted_median(values, ["k"], "v", "w", "m", 3).collect()] == [("a", 20)]
