from datetime import datetime, timedelta

from weftline.operators.orphans import dangling_ends, orphan_references

DAY = lambda n: datetime(2024, 1, 1) + timedelta(days=n)
SEGMENTS = "name string, loaded_at timestamp, deleted_at timestamp, seg_id long, at string, _hot string"
LINKS = "link_id long, from_seg string, to_seg string, loaded_at timestamp, reason string, name string"


def test_reasons(spark):
    segments = spark.createDataFrame([
        ("a", DAY(0), None, 1, "", ""), ("a", DAY(0), DAY(1), 2, "", ""), ("b", DAY(9), None, 3, "", ""), ("c", DAY(0), DAY(5), 4, "", ""), ("c", DAY(20), None, 5, "", ""),
        (None, DAY(0), None, 6, "", ""), ("d", None, None, 7, "", ""), ("e", DAY(3), DAY(2), 8, "", ""),
    ], SEGMENTS)
    links = spark.createDataFrame([
        (1, "a", "x", DAY(3), "", ""), (2, "b", None, DAY(3), "", ""), (3, "c", "c", DAY(5), "", ""), (4, "c", "d", DAY(4), "", ""), (5, None, None, DAY(4), "", ""),
        (6, "b", "e", None, "", ""), (7, "c", "", DAY(30), "", ""), (8, "b", "a", DAY(9), "", ""),
    ], LINKS)
    found = {tuple(r) for r in dangling_ends(links, segments).collect()}
    assert found == {
        (1, "to_seg", "missing", "2024-01"), (2, "from_seg", "late", "2024-01"), (3, "from_seg", "deleted", "2024-01"), (3, "to_seg", "deleted", "2024-01"),
        (6, "to_seg", "deleted", None), (7, "to_seg", "missing", "2024-01"),
    }
    assert dangling_ends(links.limit(0), segments).count() == 0
    assert dangling_ends(links, segments.limit(0)).where("reason <> 'missing'").count() == 0


def test_hot_name(spark):
    links = spark.createDataFrame([(i, "hot" if i % 3 else f"n{i}", None, DAY(i % 40), "", "") for i in range(300)], LINKS)
    segments = spark.createDataFrame([("hot", DAY(10), DAY(20), 1, "", ""), ("hot", DAY(15), DAY(25), 2, "", "")], SEGMENTS)
    found = {r.link_id: r.reason for r in dangling_ends(links, segments).collect()}
    for i in range(300):
        day = i % 40
        want = "missing" if i % 3 == 0 else None if 10 <= day < 25 else "late" if day < 10 else "deleted"
        assert found.get(i) == want


def test_composite_keys_with_nulls(spark):
    parents = spark.createDataFrame([("x", 1), ("y", 2), ("x", 1)], "a string, b int")
    refs = spark.createDataFrame([(1, "x", 1), (2, "x", 2), (3, "x", None), (4, "z", None), (5, None, 2), (6, None, 9), (7, None, None)], "id int, r string, s int")
    ids = lambda match: {r.id for r in orphan_references(refs, ["r", "s"], parents, ["a", "b"], match).collect()}
    assert ids("simple") == {2}
    assert ids("partial") == {2, 4, 6}
    assert ids("full") == {2, 3, 4, 5, 6}
    assert orphan_references(refs.limit(0), ["r", "s"], parents, ["a", "b"], "full").count() == 0


def test_one_name_of_many_lives(spark):
    """A name with a life every other hour, and links all through and before and after them."""
    hour = lambda n: datetime(2024, 1, 1) + timedelta(hours=n)
    segments = spark.createDataFrame([("hot", hour(2 * i), hour(2 * i + 1), i, "", "") for i in range(600)], SEGMENTS)
    links = spark.createDataFrame([(i, "hot", "other" if i % 50 == 0 else None, hour(i / 2), "", "") for i in range(-20, 2500)], LINKS)
    found = {(r.link_id, r.ref_field): r.reason for r in dangling_ends(links, segments).collect()}
    for i in range(-20, 2500):
        alive = 0 <= i / 2 < 1199 and (i // 2) % 2 == 0
        assert found.get((i, "from_seg")) == (None if alive else "late" if i < 0 else "deleted")
        assert found.get((i, "to_seg")) == ("missing" if i % 50 == 0 else None)
