import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm.encoding import with_token_counts
from weftline.llm.mixing import _least_cost, mix, mix_report, route


def one_by_one(own, tokens, room, quota, repeats):
    """Most tokens and least cost, by sending one token at a time over a cheapest path."""
    n, m = room.shape
    arcs = {}
    for i in range(n):
        for k in range(1, repeats[i] + 1):
            arcs["s", ("c", i), k] = [tokens[i], 2 * k * k]
        for j in range(m):
            arcs[("c", i), ("t", j), 0] = [room[i, j], int(j != own[i])]
    for j in range(m):
        arcs[("t", j), "e", 0] = [quota[j], 0]
    back = {key: 0 for key in arcs}
    sent = cost = 0
    while True:
        dist, via, changed = {"s": 0}, {}, True
        while changed:
            changed = False
            for key, (left, price) in arcs.items():
                a, b, _ = key
                for x, y, there, p, sign in ((a, b, left, price, 1), (b, a, back[key], -price, -1)):
                    if there > 0 and x in dist and dist[x] + p < dist.get(y, 1 << 40):
                        dist[y], via[y], changed = dist[x] + p, (key, sign, x), True
        if "e" not in dist:
            return sent, cost
        sent, cost, at = sent + 1, cost + dist["e"], "e"
        while at != "s":
            key, sign, at = via[at]
            arcs[key][0] -= sign
            back[key] += sign


def test_flow_costs_least():
    rng = random.Random(4)
    for _ in range(60):
        n, m = rng.randrange(1, 6), rng.randrange(1, 4)
        own = np.array([rng.randrange(m) for _ in range(n)])
        tokens = np.array([rng.randrange(1, 5) for _ in range(n)])
        most = np.array([rng.randrange(4) for _ in range(m)])
        repeats = most[own]
        room = np.array([[tokens[i] * min(repeats[i], most[j]) if j == own[i] or rng.random() < 0.5 else 0 for j in range(m)] for i in range(n)])
        quota = np.array([rng.randrange(12) for _ in range(m)])
        flow = _least_cost(own, tokens, room, quota, repeats)
        assert (flow >= 0).all() and (flow <= room).all() and (flow.sum(axis=0) <= quota).all() and (flow.sum(axis=1) <= tokens * repeats).all()
        cost = sum(2 * (x // tokens[i] + 1) ** 2 for i in range(n) for x in range(flow[i].sum())) + sum(flow[i, j] for i in range(n) for j in range(m) if j != own[i])
        assert (flow.sum(), cost) == one_by_one(own.tolist(), tokens.tolist(), room, quota.tolist(), repeats.tolist())


def test_one_mix_whatever_the_layout(spark):
    """The same rows in other partitions and another order give the same mix, repeated rows too; texts are counted once."""
    rows = [(i % 350, f"t{i % 330}", ("a", "b", "c")[i % 3], 1) for i in range(900)] + [(5, "t5", "a", 1)] * 4
    random.Random(2).shuffle(rows)
    targets = spark.createDataFrame([("a", 0.2, 1), ("b", 0.5, 2), ("c", 0.3, 1)], "source string, weight double, max_repeats int")
    base = documents(spark, rows)
    layouts = [base, base.repartition(7, "doc_id"), base.coalesce(1).orderBy(F.col("text").desc()), base.repartitionByRange(3, "source")]
    mixes = [sorted(map(tuple, mix(with_token_counts(x, out="tokens"), targets, "tokens").collect())) for x in layouts]
    assert mixes[0] and all(m == mixes[0] for m in mixes)
    plan = with_token_counts(base, out="tokens").where("tokens > 0").select("tokens")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_quotas_fill_or_pass_on():
    targets = {"a": (1.0, 1), "b": (1.0, 3), "none": (2.0, 5)}
    flow, quota = route([(0, "a", ["a"], 100), (1, "b", ["b"], 100)], targets, 200)
    assert flow == {(0, "a"): 100, (1, "b"): 100} and quota["none"] == 0
    flow, _ = route([(0, "a", ["a"], 50), (1, "b", ["b"], 50), (2, "a", ["a", "b"], 100)], {"a": (1.0, 1), "b": (3.0, 1)}, 200)
    assert flow[0, "a"] == 50 and flow[2, "b"] == 100 and flow[1, "b"] == 50


DOCUMENTS = "doc_id long, text string, source string, n long, own_source string, copies string, class int, digest string"


def documents(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 1, "z") for r in rows], DOCUMENTS)


def test_shares_and_repeats(spark):
    rows = [(i, f"t{i}", "big", 10 + i % 7) for i in range(400)] + [(1000 + i, f"s{i}", "small", 11) for i in range(30)] + [(2000 + i, f"u{i}", "other", 5) for i in range(9)]
    rows += [(3000, None, "big", 0), (3001, "", "small", 0), (3002, "x", None, 5), (7, "t7", "big", 10)]
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.5, 4), ("absent", 0.0, 2), (None, 1.0, 1)], "source string, weight double, max_repeats int")
    mixed = mix(documents(spark, rows), targets, "n").cache()
    size = sum(r[3] for r in rows if r[2] in ("big", "small"))
    taken = mixed.collect()
    assert max(r.copies for r in taken if r.own_source == "small") <= 4 and all(r.copies == 1 for r in taken if r.own_source == "big")
    assert {r.own_source for r in taken} == {"big", "small"}
    report = {r.source: r for r in mix_report(mixed, targets).collect()}
    assert report["small"].tokens == 30 * 11 * 4  # all it may give; the rest of its share goes to big
    assert abs(report["big"].tokens + report["small"].tokens - size) <= 20
    assert report["absent"].tokens == 0 and report["big"].target_share == 0.5
    again = mix(documents(spark, rows), targets, "n").select("doc_id", "copies").collect()
    assert sorted(map(tuple, again)) == sorted((r.doc_id, r.copies) for r in taken)


def test_overlapping_sources(spark):
    rows = [(i, f"same{i}", s, 10) for i in range(40) for s in ("a", "b")] + [(100 + i, f"only{i}", "a", 10) for i in range(20)]
    rows = [(k, *r[1:]) for k, r in enumerate(rows)]
    targets = spark.createDataFrame([("a", 0.2, 1), ("b", 0.8, 2)], "source string, weight double, max_repeats int")
    mixed = mix(documents(spark, rows), targets, "n").collect()
    to = {s: sum(r.copies * r.n_tokens for r in mixed if r.for_source == s) for s in "ab"}
    assert to == {"a": 200, "b": 800}
    assert any(r.own_source != r.for_source for r in mixed) or max(r.copies for r in mixed) == 2
    per_document = {}
    for r in mixed:
        per_document[r.doc_id, r.own_source] = per_document.get((r.doc_id, r.own_source), 0) + r.copies
    assert all(n <= (1 if s == "a" else 2) for (_, s), n in per_document.items())


@pytest.mark.parametrize("rows", [[], [(1, None, "a", 0)]])
def test_nothing_to_mix(spark, rows):
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, weight double, max_repeats int")
    mixed = mix(documents(spark, rows), targets, "n")
    assert mixed.count() == 0
    assert [(r.tokens, r.actual_share) for r in mix_report(mixed, targets).collect()] == [(0, 0.0)]
