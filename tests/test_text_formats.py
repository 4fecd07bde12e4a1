import pytest

from weftline.sources import text_formats as t

GRAPH = "H\tVN:Z:1.0\nS\ta\tACGTACGTAC\nS\tb\t*\tKC:i:3\tLN:i:20\nS\tc\tacgt\r\nS\te\t*\nL\ta\t+\tb\t+\t3M\nL\tb\t+\td\t-\nP\tp\ta+,b+\t3M\nW\ts\t0\tx\t0\t9\t<c>a\nA\tjunk\n\nX\ty\n"


def test_graph_dialects(spark, tmp_path):
    (tmp_path / "g.gfa").write_bytes(GRAPH.encode())
    records = t.read_records(spark, str(tmp_path / "g.gfa"))
    rows = lambda df: {r.name: (r.seq, r.length) for r in df.collect()}
    assert rows(t.segments_of(records)) == {"a": ("ACGTACGTAC", 10), "b": (None, 20), "c": ("acgt", 4), "e": (None, 0)}
    assert rows(t.segments_of(records, "one"))["b"] == (None, 1)
    assert rows(t.segments_of(records, "drop", upper=True)) == {"a": ("ACGTACGTAC", 10), "c": ("ACGT", 4)}
    with pytest.raises(Exception, match="no LN tag for e"):
        t.segments_of(records, "strict").collect()
    assert [tuple(r)[:5] for r in t.links_of(records, "0M").orderBy("line_no").collect()] == [("a", "+", "b", "+", "3M"), ("b", "+", "d", "-", "0M")]
    assert {(r.rec, r.name) for r in t.routes_of(records).collect()} == {
        ("H", None), ("S", "a"), ("S", "b"), ("S", "c"), ("S", "e"), ("L", "a"), ("L", "b"), ("P", "a"), ("W", "c"), ("X", None)}


def test_alignments_sizes_and_assignments(spark, tmp_path):
    line = "q\t100\t1\t50\t+\tt\t200\t5\t60\t40\t50\t60"
    (tmp_path / "a.paf").write_text(f"# note\n{line}\ttp:A:P\n{line.replace('50', '7')}\nshort\t1\n")
    paf = t.read_paf(spark, str(tmp_path / "a.paf"), 10)
    assert [tuple(r)[:12] for r in paf.collect()] == [("q", 100, 1, 50, "+", "t", 200, 5, 60, 40, 50, 60)]
    (tmp_path / "s.fai").write_text("t\t200\t3\nu\tx\n")
    assert {tuple(r) for r in t.read_sizes(spark, str(tmp_path / "s.fai")).collect()} == {("t", 200), ("u", None)}
    (tmp_path / "as.tsv").write_text("contig\tcontig_len\tbest_chrom\nq\t5\tt1\nq\t5\tt2\n")
    assert [tuple(r) for r in t.read_assignments(spark, str(tmp_path / "as.tsv")).collect()] == [("q", "t2")]


def test_writing(spark, tmp_path):
    df = spark.createDataFrame([("a", "A" * 160), ("b", "ACG"), ("c", None)], "name string, seq string")
    got = {r.value for r in t.fasta_records(df, "name", "seq").collect()}
    assert got == {">a len=160\n" + "A" * 80 + "\n" + "A" * 80, ">b len=3\nACG"}
    lines = spark.createDataFrame([(f"l{i:03}", i, i % 2) for i in range(200)], "value string, no int, part int")
    t.write_lines(lines, str(tmp_path / "out"), ["no"])
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    assert text.split() == [f"l{i:03}" for i in range(200)]
    t.write_lines(lines, str(tmp_path / "by"), by="part")
    assert sum(len(p.read_text().split()) for p in (tmp_path / "by/part=1").glob("part-*")) == 100
