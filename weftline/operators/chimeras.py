"""Cutting contigs whose parts lie on different targets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.alignments import dominant_runs, mapped
from weftline.session import discard, written


def chunks(paf: DataFrame, window: int = 5000, min_chunk: int = 5000, min_frac: float = 0.5) -> DataFrame:
    """``qname``, ``chunk_no``, ``q_start``, ``q_end``, ``tname``: long stretches of a contig that mostly lie on one target.

    A run of windows with one dominant target counts if it spans
    ``min_chunk`` bases and ``min_frac`` of the aligned bases in it are on that
    target; neighbours on one target become one. Alignments with impossible
    query positions don't count. Windows are ordered per contig, which its
    length bounds.
    """
    good = mapped(paf).where("qstart >= 0 and qstart < qend and qend <= qlen")
    ends = good.groupBy("qname").agg(F.max("qend").alias("end"))
    parts = good.select("qname", "tname", "qstart", "qend", F.explode(F.sequence(F.floor(F.col("qstart") / window), F.floor((F.col("qend") - 1) / window))).alias("window_no"))
    bases = F.least("qend", (F.col("window_no") + 1) * window) - F.greatest("qstart", F.col("window_no") * window)
    votes = parts.groupBy("qname", "window_no", "tname").agg(F.sum(bases).alias("votes"))
    best = votes.groupBy("qname", "window_no").agg(
        F.min_by(F.struct("tname", "votes"), F.struct((-F.col("votes")).alias("less"), "tname")).alias("b"), F.sum("votes").alias("all_votes")).select("qname", "window_no", "b.*", "all_votes")
    runs = dominant_runs(best)
    numbered = _numbered(best, "window_no", "run_no")
    purity = numbered.groupBy("qname", "run_no").agg(F.sum("all_votes").alias("bases"), F.sum("votes").alias("to_target"))
    joined = runs.join(purity, ["qname", "run_no"]).join(ends, "qname").select(
        "qname", "run_no", "tname", "bases", "to_target", (F.col("first_window") * window).alias("q_start"), F.least("end", (F.col("last_window") + 1) * window).alias("q_end"))
    kept = joined.where((F.col("q_end") - F.col("q_start") >= min_chunk) & (F.col("to_target") >= min_frac * F.col("bases")))
    return _joined_neighbours(kept, "run_no", "chunk_no")


def _numbered(df: DataFrame, order: str, number: str) -> DataFrame:
    """``df`` with a number that grows wherever a contig's target changes."""
    by_query = Window.partitionBy("qname").orderBy(order)
    changed = F.coalesce((F.lag("tname").over(by_query) != F.col("tname")).cast("int"), F.lit(1))
    return df.withColumn("_new", changed).withColumn(number, F.sum("_new").over(by_query.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def _joined_neighbours(df: DataFrame, order: str, number: str) -> DataFrame:
    """Stretches of a contig that follow each other on one target, as one."""
    return _numbered(df, order, number).groupBy("qname", number, "tname").agg(F.min("q_start").alias("q_start"), F.max("q_end").alias("q_end")).select("qname", number, "q_start", "q_end", "tname")


def absorb_islands(found: DataFrame) -> DataFrame:
    """``qname``, ``q_start``, ``q_end``, ``tname`` of chunks in which no island is left.

    An island lies between two chunks of one target and is smaller than either;
    it goes, and its flanks become one. Two islands can't be neighbours, as
    each would have to be the smaller one, and flanks only grow, so all islands
    of all contigs go at once, again and again until there is none, with the
    same result in any order.
    """
    by_query = Window.partitionBy("qname").orderBy("q_start")
    size = F.col("q_end") - F.col("q_start")
    current = found.select("qname", "q_start", "q_end", "tname")
    while True:
        sides = [f("tname", 1).over(by_query) for f in (F.lag, F.lead)]
        smaller = [size < f(size, 1).over(by_query) for f in (F.lag, F.lead)]
        island = (sides[0] == sides[1]) & (sides[0] != F.col("tname")) & smaller[0] & smaller[1]
        marked = written(current.withColumn("island", F.coalesce(island, F.lit(False))))
        if marked.where("island").isEmpty():
            return marked.drop("island")
        current = written(_joined_neighbours(marked.where("not island"), "q_start", "chunk_no").drop("chunk_no"))
        discard(marked)


def breakpoints(paf: DataFrame, window: int = 5000, min_chunk: int = 5000, min_frac: float = 0.5) -> DataFrame:
    """``qname``, ``slice_no``, ``slice_start``, ``slice_end``, ``tname``: contigs of several chunks, cut midway between them.

    Islands are absorbed first. A contig has no more chunks than its length over ``min_chunk``.
    """
    ends = mapped(paf).where("qstart >= 0 and qstart < qend and qend <= qlen").groupBy("qname").agg(F.max("qend").alias("end"))
    whole = absorb_islands(chunks(paf, window, min_chunk, min_frac))
    by_query = Window.partitionBy("qname").orderBy("q_start")
    midway = lambda left, right: F.floor((left + right) / 2)
    cut = whole.select(
        "qname", "tname", (F.row_number().over(by_query) - 1).alias("slice_no"), F.count(F.lit(1)).over(Window.partitionBy("qname")).alias("of"),
        F.coalesce(midway(F.lag("q_end").over(by_query), F.col("q_start")), F.lit(0)).alias("slice_start"), midway(F.col("q_end"), F.lead("q_start").over(by_query)).alias("cut")).where("of > 1")
    return cut.join(ends, "qname").select("qname", "slice_no", F.col("slice_start").cast("long").alias("slice_start"), F.coalesce("cut", "end").cast("long").alias("slice_end"), "tname")
