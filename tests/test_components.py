import random

from weftline.operators import components
from weftline.operators.components import connected_groups


def brute(pairs, names):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for n in names:
        if n is not None:
            find(n)
    for a, b in pairs:
        if a is not None and b is not None:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in list(parent)}


def run(spark, pairs, names):
    links = spark.createDataFrame([(a, b, "x", "y") for a, b in pairs], "f string, t string, vertex string, rep string")
    segments = spark.createDataFrame([(n, 1) for n in names], "name string, label int")
    rows = connected_groups(links, "f", "t", segments, "name").collect()
    assert len(rows) == len({r.vertex for r in rows})
    return {r.vertex: r.group_name for r in rows}


def test_chains_hubs_and_dirt(spark):
    rng = random.Random(3)
    pairs = [(f"c{i}", f"c{i + 1}") for i in range(60)]  # a chain
    pairs += [("hub", f"h{i}") for i in range(200)]  # a hub with most edges
    pairs += [(f"r{rng.randrange(80)}", f"r{rng.randrange(80)}") for _ in range(60)]
    pairs += [("a", "a"), ("a", None), (None, "b"), (None, None), ("hub", "h1"), ("h1", "hub"), ("", "empty"), ("é", "z"), ("\U0001f600", "￮")]
    names = ["lone", None, "a", "hub", "hub", "c3"]
    assert run(spark, pairs, names) == brute(pairs, names)


def test_empty_tables(spark):
    assert run(spark, [], []) == {}
    assert run(spark, [], ["x", "x"]) == {"x": "x"}
    assert run(spark, [("b", "a")], []) == {"a": "a", "b": "a"}


def test_groups_within_known_groups_are_found_in_tasks(spark, monkeypatch):
    """Each round of spines contracted the graph twice, in hundreds of queries (F5)."""
    rng = random.Random(8)
    pairs = [(f"{c}{rng.randrange(40)}", f"{c}{rng.randrange(40)}") for c in "abc" for _ in range(24)] + [(None, "a1"), ("é", "a41")]
    names = [(f"{c}{i}",) for c in "abc" for i in range(42)] + [("é",)]
    links, vertices = spark.createDataFrame(pairs, "l string, r string"), spark.createDataFrame(names, "name string")
    known = spark.createDataFrame([(n, "a" if n == "é" else n[0]) for (n,) in names], "name string, component string")
    expected = {tuple(r) for r in components.connected_groups(links, "l", "r", vertices, "name").collect()}
    assert {tuple(r) for r in components.groups_within(links, "l", "r", vertices, "name", known, small=65).collect()} == expected
    monkeypatch.setattr(components, "connected_groups", None)
    assert {tuple(r) for r in components.groups_within(links, "l", "r", vertices, "name", known).collect()} == expected
