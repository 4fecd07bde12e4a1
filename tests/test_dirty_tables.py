"""The numbered operators of the core on columns whose names clash with their own, on nulls, repeated rows and empty tables."""

from functools import reduce

from pyspark.sql import functions as F

from weftline.operators.components import connected_groups
from weftline.operators.faulty import faulty_lines, loaded, parse_lines
from weftline.operators.heavy import heavy_keys, per_key_totals
from weftline.operators.intervals import periods_and_gaps
from weftline.operators.orphans import dangling_ends, orphan_references
from weftline.operators.topn import top_n_per_group

CLASHING = (
    "_key", "_row", "_at", "_there", "_n", "_hot", "_hot_value", "_salt", "_value", "_zone", "_when", "_kind", "_begin", "_end", "_whole", "a.b",
    "id", "name", "label", "src", "dst", "vertex", "rep", "key", "value", "code", "n", "total", "grp", "score", "tie", "run", "zone", "kind", "reach", "s", "e", "k0", "c0", "mask", "edge",
)


def _with_clashes(df):
    """``df`` and columns of all the names it doesn't have itself; every other row has nulls in them."""
    odd = F.pmod(F.xxhash64(*(f"`{c}`" for c in df.columns)), F.lit(2)) == 0
    return reduce(lambda d, c: d.withColumn(c, F.when(odd, "x")), (c for c in CLASHING if c not in df.columns), df)


def _rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def _alike(operator, *tables):
    """The rows of ``operator``, which are the same beside clashing columns; none from empty tables."""
    plain = _rows(operator(*tables))
    assert _rows(operator(*map(_with_clashes, tables))) == plain
    assert _rows(operator(*(t.limit(0) for t in tables))) == []
    return plain


def test_groups(spark):
    pairs = spark.createDataFrame([("b", "a"), ("b", "a"), ("a", "b"), ("c", None), (None, None), ("", "b"), ("z", "z"), ("x" * 100_000, "z")], "p string, q string")
    names = spark.createDataFrame([(None,), ("c",), ("c",)], "v string")
    found = _alike(lambda p, n: connected_groups(p, "p", "q", n, "v"), pairs, names)
    assert found == sorted([("", ""), ("a", ""), ("b", ""), ("c", "c"), ("z", "x" * 100_000), ("x" * 100_000, "x" * 100_000)], key=repr)


def test_lines(spark):
    long = "ACGT" * 300_000
    lines = [(1, "S", "S\ts1\tACGT"), (1, "S", "S\ts1\tACGT"), (2, None, "S\ts1\tA"), (3, "L", None), (4, "L", ""), (None, "S", "S\ts2\tXX"), (5, "S", f"S\ts3\t{long}"), (6, "S", f"S\ts4\t{long}!")]
    table = spark.createDataFrame(lines, "line_id long, rec string, raw string")
    assert _alike(lambda t: faulty_lines(parse_lines(t)), table) == [(2, "bad_value", "rec"), (6, "bad_value", "seq"), (None, "bad_value", "seq")]
    good = _alike(lambda t: loaded(parse_lines(t), "S").select("line_id", F.col("name"), F.length("seq")), table)
    assert good == [(1, "s1", 4), (1, "s1", 4), (5, "s3", len(long))]


def test_references(spark):
    refs = spark.createDataFrame([("r1", "x", 5), ("r1", "x", 5), ("r2", "x", 15), ("r3", None, 5), ("r4", "", 5)], "ref string, to string, time long")
    parents = spark.createDataFrame([("x", 0, 10), ("x", 0, 10), ("", 0, 2), ("y", 7, 3)], "held string, born long, died long")
    no_parents = parents.limit(0)
    plain = ["ref", "to", "time"]
    assert _alike(lambda r, p: orphan_references(r, ["to"], p, ["held"]).select(plain), refs.where("ref <> 'r9'"), parents) == []
    timed = lambda r, p: orphan_references(r, ["to"], p, ["held"], "simple", "time", ("born", "died")).select(plain)
    assert _alike(timed, refs, parents) == [("r2", "x", 15), ("r4", "", 5)]
    assert len(_rows(timed(refs, no_parents))) == 4
    kept = orphan_references(_with_clashes(refs), ["to"], _with_clashes(no_parents), ["held"])
    assert kept.columns == _with_clashes(refs).columns
    assert set(map(tuple, kept.select("_key", "_there", "c0", "`a.b`").collect())) <= {("x",) * 4, (None,) * 4}
    clashing = refs.withColumnsRenamed({"to": "_key", "time": "_at"}), parents.withColumnsRenamed({"held": "_there", "born": "_end", "died": "_begin"})
    assert _rows(orphan_references(clashing[0], ["_key"], clashing[1], ["_there"], "simple", "_at", ("_end", "_begin"))) == [("r2", "x", 15), ("r4", "", 5)]


def test_link_ends(spark):
    links = spark.sql("select * from values (1L, 'a', 'b', timestamp'2024-01-02'), (1L, 'a', 'b', timestamp'2024-01-02'), (null, 'c', null, null) as t(link_id, from_seg, to_seg, loaded_at)")
    segments = spark.sql("select * from values ('a', timestamp'2024-01-01', null), ('a', timestamp'2024-01-01', null), ('b', timestamp'2024-01-03', null), (null, null, null) as t(name, loaded_at, deleted_at)")
    found = _alike(dangling_ends, links, segments)
    assert found == [(1, "to_seg", "late", "2024-01"), (1, "to_seg", "late", "2024-01"), (None, "from_seg", "missing", None)]


def test_totals(spark):
    rows = [("a", 1), ("a", 1), ("a", None), (None, 5), ("", 7), ("x" * 100_000, 2)]
    totals = _alike(lambda t: per_key_totals(t, "word", "size"), spark.createDataFrame(rows, "word string, size long"))
    assert totals == sorted([("a", 3, 2), (None, 1, 5), ("", 1, 7), ("x" * 100_000, 1, 2)], key=repr)
    heavy = _alike(lambda t: heavy_keys(per_key_totals(t, "word", "size"), 0.5), spark.createDataFrame(rows, "word string, size long"))
    assert heavy == [("a", 3, 2)]


def test_best(spark):
    rows = [("a", 5, "t", 1), ("a", 5, "t", 2), ("a", 5, "s", 3), ("a", 4, None, 4), ("a", None, "t", 5), (None, 9, "t", 6), ("", 1, "", 7), ("a", 1, "t", None)]
    table = spark.createDataFrame(rows, "who string, points long, what string, row long")
    assert _rows(top_n_per_group(table, "who", "points", "what", "row", 2)) == [("", 7, 1), ("a", 1, 2), ("a", 3, 1)]
    assert _rows(top_n_per_group(table, "who", "points", "what", "row", 2).limit(0)) == []
    # A further column tells copies apart unless it is ignored.
    found = _alike(lambda t: top_n_per_group(t, "who", "points", "what", "row", 2, tuple(c for c in t.columns if c in CLASHING)), table)
    assert found == [("", 7, 1), ("a", 1, 2), ("a", 3, 1)]


def test_periods(spark):
    rows = [("a", 0, 5), ("a", 0, 5), ("a", 5, 8), ("a", 10, 12), ("a", None, 3), ("a", 4, None), ("a", 7, 7), ("a", 9, 1), (None, 1, 2), ("", 3, 4)]
    found = _alike(lambda t: periods_and_gaps(t, ["where"], "begun", "done"), spark.createDataFrame(rows, "where string, begun long, done long"))
    assert found == sorted([("a", "period", 0, 8), ("a", "gap", 8, 10), ("a", "period", 10, 12), (None, "period", 1, 2), ("", "period", 3, 4)], key=repr)
