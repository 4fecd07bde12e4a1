"""Registered k-mer queries at the reference's k, against strings cut by hand."""

import random
import re
import statistics

from weftline.operators import kmers
from weftline.plans import kmers as plans

LINKS = "link_id long, from_seg string, from_orient string, to_seg string, to_orient string, overlap string, tags string"


def test_kmers_of_29_across_segments(spark, tmp_path):
    rng = random.Random(2)
    draw = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    seqs = {"a": draw(60), "b": draw(10), "c": draw(9), "d": draw(40), "e": draw(5)}
    spark.createDataFrame([(i, n, s, len(s), None) for i, (n, s) in enumerate(seqs.items())], "seg_id long, name string, seq string, seg_len long, tags string").write.parquet(f"{tmp_path}/segments.parquet")
    spark.createDataFrame([(i, x, "+", y, "+", "0M", None) for i, (x, y) in enumerate(["ab", "bc", "cd", "ae"])], LINKS).write.parquet(f"{tmp_path}/links.parquet")
    back = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    cut = [min(w, back(w)) for s in seqs.values() for w in (s[i : i + 29] for i in range(len(s) - 28))]
    got = {r.kmer: r.n for r in plans.k04_canonical_kmers(spark, str(tmp_path)).collect()}
    assert got == {w: cut.count(w) for w in cut} and len(cut) == 44
    ext = {r.ext for r in plans.k02_forward_extensions(spark, str(tmp_path)).where("node = 'a' and orient = '+'").collect()}
    assert ext == {(seqs["b"] + seqs["c"] + seqs["d"])[:28], seqs["e"]}
    records = {r.record for r in plans.k03_crossing_records(spark, str(tmp_path)).where("node = 'a' and orient = '+'").collect()}
    assert records == {seqs["a"][-28:] + x for x in ext}


def broadcast_keys(df):
    return re.findall(r"BroadcastHashJoin \[(\w+)", df._jdf.queryExecution().executedPlan().toString())


def test_kmers_are_never_broadcast(spark, tmp_path, monkeypatch):
    """A plan takes exploded k-mers to be as small as their file, and sent them all to the driver (F2, F4)."""
    rng = random.Random(4)
    rows = [(i, f"n{i % 70}", "".join(rng.choice("ACGT") for _ in range(40)), "") for i in range(90)]
    segments = spark.createDataFrame(rows, "seg_id long, name string, seq string, tags string")
    segments.write.parquet(f"{tmp_path}/segments.parquet")
    spark.createDataFrame([("S", f"S\tr{i}\t{s}") for i, _, s, _ in rows[:50]], "rec string, raw string").selectExpr("rec", "raw", "0L as line_id", "'f' as file_name", "0L as line_no").write.parquet(f"{tmp_path}/raw_lines.parquet")
    tables = []
    keep = lambda df: tables.append(df) or df
    monkeypatch.setattr(kmers, "written", keep)
    monkeypatch.setattr(plans, "written", keep)
    for query in (plans.a13_node_depths, plans.k05_annotated_tags):
        assert not set(broadcast_keys(query(spark, str(tmp_path)))) & {"kmer", "coalesce", "_probe"}
    assert tables
    depths = {r.name: r.kn for r in plans.a13_node_depths(spark, str(tmp_path)).collect()}
    assert depths == {f"n{i}": 12 * (1 + (i < 20)) for i in range(70)}


def test_depths_against_all_windows(spark, monkeypatch):
    """Nameless segments' positions take their share too; other letters, cases, repeats and sequences in many pieces (F4)."""
    monkeypatch.setattr(kmers, "PIECE", 7)
    rng = random.Random(9)
    draw = lambda n, letters="ACGT": "".join(rng.choice(letters) for _ in range(n))
    seqs = [(rng.choice("abcdef"), draw(rng.randrange(40))) for _ in range(40)] + [("n", draw(30, "ACGNacgté")) for _ in range(9)]
    seqs += [(None, s) for _, s in seqs[:20]] + [("t", "TTTTTTTTTTTTTTTTTTTTTTTTTTTTTTTT" * 9), ("star", "*"), ("none", None), ("hot", draw(50))] + seqs[:8] * 2
    reads = [(s, n) for n, (_, s) in enumerate(seqs[10:60], 1) if s]
    for k in (1, 5, 8, 29, 33):
        back = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
        cut = lambda s: [min(w, back(w)) for w in (s[i : i + k].upper() for i in range(len(s or "") - k + 1)) if s != "*"]
        read, positions, of = {}, {}, {n: [] for n, _ in seqs if n}
        for s, n in reads:
            for w in cut(s):
                read[w] = read.get(w, 0) + n
        for _, s in seqs:
            for w in cut(s):
                positions[w] = positions.get(w, 0) + 1
        for n, s in seqs:
            if n:
                of[n] += [read.get(w, 0) / positions[w] for w in cut(s)]
        got = {r.name: r for r in kmers.node_depths(spark.createDataFrame(seqs, "name string, seq string"), spark.createDataFrame(reads, "seq string, n long"), k).collect()}
        assert got.keys() == of.keys()
        for n, shares in of.items():
            r = got[n]
            assert r.kn == len(shares) and abs(r.kc - sum(shares)) <= 0.501
            assert abs(r.dp - (statistics.median(shares) if shares else 0)) < 1e-4 and abs(r.ad - sum(shares) / max(1, len(shares))) < 1e-4


def test_kmers_are_counted_where_they_meet(spark, tmp_path, monkeypatch):
    """Nothing joins on k-mers: positions and reads are shuffled once, and equal sequences of a name before k-mers are made of them (F4)."""
    segments = spark.createDataFrame([("rep", "ACGTTGCATTACGGATCCATTGACCGATTACA")] * 500 + [("b", "ACGTTGCATTACGGATCCATTGACCGATTAGG")], "name string, seq string")
    reads = spark.createDataFrame([("ACGTTGCATTACGGATCCATTGACCGATTACA", 501)], "seq string, n int")
    tables = []
    monkeypatch.setattr(kmers, "written", lambda df: tables.append(df) or df)
    got = {r.name: (r.kc, r.kn) for r in kmers.node_depths(segments, reads, 29).collect()}
    assert got == {"rep": (2002, 2000), "b": (2, 4)}  # two of four k-mers are in both
    plan = tables[0]._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 3
    made = kmers.met_kmers(segments.selectExpr("name", "seq", "1L as times", "0L as reads"), "seq", 29, ["times", "reads"])
    assert made.count() == 8
