from pyspark.sql import functions as F

from weftline.functions import sequences as s


def test_expressions(spark):
    cigars = {"*": 0, "": 0, None: 0, "55M": 55, "10M2I3D4S5=": 20, "7X": 7, "12": 0, "M": 0, "1" * 19 + "M3M": 3}
    df = spark.createDataFrame([(c,) for c in cigars], "c string")
    assert {r.c: r.n for r in df.select("c", s.overlap_length("c").alias("n")).collect()} == cigars
    one = spark.range(1)
    value = lambda c: one.select(c.alias("x")).first().x
    text = lambda x: F.lit(x).cast("string")
    assert value(s.canonical_kmer(F.lit("ttg"))) == "CAA" and value(s.canonical_kmer(F.lit("ACGT"))) == "ACGT"
    assert value(s.reverse_complement(F.lit("ACgRN"))) == "NRcGT" and value(s.reverse_complement(F.lit("ACgRN"), True)) == "NNcGT"
    assert value(s.oriented(F.lit("TTGCA"), F.lit("-"))) == "TGCAA"
    assert value(s.kmers(F.lit("ACGT"), 3)) == ["ACG", "CGT"] and value(s.kmers(F.lit("AC"), 3)) == [] and value(s.kmers(text(None), 3)) == []
    assert value(s.canonical_link(F.lit("b"), F.lit("+"), F.lit("a"), F.lit("-"))) == ("a", "+", "b", "-")
    assert value(s.names_of_walk(F.lit(">a<b>c"))) == ["a", "b", "c"]
    assert value(s.percent_identity(F.lit(5), F.lit(0))) == 0.0 and value(s.percent_identity(text(None).cast("int"), F.lit(9))) == 0.0
    assert [value(s.organelle_name(text(n))) for n in ("chrMT", "Pt_1", "A01", "MTX", None)] == [True, True, False, False, False]
    assert value(s.without_depth_tags(F.lit("KC:i:1\tLN:i:5\tdp:f:2"))) == "LN:i:5" and value(s.without_depth_tags(text(None))) == ""
