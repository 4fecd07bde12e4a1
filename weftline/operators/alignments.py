"""Assigning, joining and placing contigs by their alignments to targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.sequences import organelle_name, percent_identity
from weftline.operators.ordered import running_totals
from weftline.operators.skew import lookup


def mapped(paf: DataFrame) -> DataFrame:
    """Alignments with a query and a target name."""
    return paf.where("qname is not null and tname <> '*'")


def aligned_per_target(paf: DataFrame) -> DataFrame:
    """``qname``, ``tname``, ``aligned_bp`` (query bases of all alignments, null positions counting 0) and ``n_alns``."""
    return mapped(paf).groupBy("qname", "tname").agg(F.coalesce(F.sum(F.col("qend") - F.col("qstart")), F.lit(0)).alias("aligned_bp"), F.count(F.lit(1)).alias("n_alns"))


def assign_contigs(paf: DataFrame, chimera_ratio: float = 0.2, min_frac: float = 0.3) -> DataFrame:
    """Each contig's best and second target by aligned bases, and flags.

    Ties go to the smaller name. With one target the second is ``unplaced``
    with 0 bases; without any that has positive bases the best is
    ``unplaced`` and the second ``.``. The length is the largest ``qlen``.
    """
    sums = aligned_per_target(paf)
    # The best target by aggregation, and then the best of the others, as a contig may have any number of targets.
    rank = F.min(F.struct((-F.col("aligned_bp")).alias("less"), F.col("tname").alias("tname")))
    some = sums.where("aligned_bp > 0")
    first = some.groupBy("qname").agg(rank.alias("first"))
    second = some.join(first, "qname").where("tname <> first.tname").groupBy("qname").agg(rank.alias("second"))
    best = first.join(second, "qname", "left").select("qname", F.array("first", "second").alias("top"))
    lengths = mapped(paf).groupBy("qname").agg(F.max("qlen").alias("contig_len"))
    at = lambda i: F.try_element_at("top", F.lit(i))
    bases = lambda i: F.coalesce(-at(i).getField("less"), F.lit(0).cast("long"))
    out = lengths.join(best, "qname", "left").select(
        F.col("qname").alias("contig"), F.coalesce("contig_len", F.lit(0).cast("long")).alias("contig_len"),
        F.coalesce(at(1).getField("tname"), F.lit("unplaced")).alias("best_chrom"), bases(1).alias("best_aln_bp"),
        F.when(at(1).isNull(), ".").otherwise(F.coalesce(at(2).getField("tname"), F.lit("unplaced"))).alias("second_chrom"), bases(2).alias("second_aln_bp"))
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    out = out.withColumn("best_frac", ratio("best_aln_bp", "contig_len")).withColumn("second_ratio", ratio("second_aln_bp", "best_aln_bp"))
    chimera = (F.col("second_aln_bp") > 0) & (F.col("second_ratio") >= chimera_ratio)
    low = F.col("best_frac") < min_frac
    flag = F.when(chimera & low, "CHIMERA,LOW_COVERAGE").when(chimera, "CHIMERA").when(low, "LOW_COVERAGE").otherwise("OK")
    return out.withColumn("flag", flag)


def on_assigned_target(paf: DataFrame, assignment: DataFrame) -> DataFrame:
    """The alignments of each contig to the target it was assigned to."""
    best = assignment.select(F.col("contig").alias("qname"), "best_chrom")
    return lookup(mapped(paf), "qname", best, "best_chrom", F.col("aln_id")).where("tname = best_chrom").drop("best_chrom")


def dovetails(paf: DataFrame, min_identity: float = 95.0, min_overlap: int = 1000, slack: int = 500, dedup: bool = True) -> DataFrame:
    """Alignments that join an end of one sequence to an end of another.

    An alignment joins by the one end of each sequence that lies within
    ``slack`` of it; one that comes near both ends contains the sequence, and joins nothing. With ``dedup``, of each
    unordered pair of names the alignment of least ``aln_id`` stays.
    """
    rows = mapped(paf).where("qname <> tname").withColumn("pct_identity", percent_identity("nmatch", "alnlen")).withColumn(
        "overlap_len", (F.col("qend") - F.col("qstart") + F.col("tend") - F.col("tstart")) / 2)
    rows = rows.where((F.col("pct_identity") >= min_identity) & (F.col("overlap_len") >= min_overlap))
    for side in "qt":
        start, end, length = (F.col(side + x) for x in ("start", "end", "len"))
        near = F.filter(F.array(*(F.struct(F.lit(name).alias("name"), beyond.alias("beyond")) for name, beyond in (("5p", start), ("3p", length - end)))), lambda x: x.beyond <= slack)
        rows = rows.withColumn("_near", near).where("size(_near) = 1").withColumn(f"{side}_end_used", F.col("_near")[0]["name"]).withColumn(f"{side}_trim", F.col("_near")[0]["beyond"])
    out = rows.select(
        "aln_id", F.col("qname").alias("q_contig"), "q_end_used", F.col("tname").alias("t_contig"), "t_end_used", "strand",
        F.floor("overlap_len").alias("overlap_len"), F.round("pct_identity", 6).alias("pct_identity"), "q_trim", "t_trim",
        F.concat_ws("-", "q_end_used", "t_end_used").alias("join_type"))
    if not dedup:
        return out
    first = out.groupBy(F.least("q_contig", "t_contig").alias("_a"), F.greatest("q_contig", "t_contig").alias("_b")).agg(F.min_by(F.struct(*out.columns), "aln_id").alias("first"))
    return first.select("first.*")


def query_positions(paf: DataFrame) -> DataFrame:
    """Where each query lies on each target: least start, greatest end, matches, and matches per spanned base (1 for no span)."""
    out = mapped(paf).where("tstart is not null and tend is not null").groupBy("qname", "tname").agg(
        F.min("tstart").alias("min_start"), F.max("tend").alias("max_end"), F.coalesce(F.sum("nmatch"), F.lit(0)).alias("matches"))
    span = F.col("max_end") - F.col("min_start")
    return out.withColumn("quality", F.when(span > 0, F.round(F.col("matches") / span, 6)).otherwise(1.0))


def weighted_median(df: DataFrame, keys: list[str], value: str, weight: str, out: str, width: int = 1 << 18) -> DataFrame:
    """Per ``keys``, the least value whose cumulative weight reaches half of the total; values and weights are integers.

    Weights are summed per value first, and running sums go by zones of the
    values, so one hot entity is spread over its zones. Entities with no
    positive weight give no row.
    """
    sums = df.where(f"{weight} > 0 and {value} is not null").groupBy(*keys, value).agg(F.sum(weight).alias("_w"))
    ordered = running_totals(sums, keys, value, [value], {"_earlier": "_w"}, width=width, wholes={"_total": "_w"})
    reached = ordered.where(2 * (F.col("_earlier") + F.col("_w")) >= F.col("_total"))
    return reached.groupBy(*keys).agg(F.min(value).alias(out))


def place_contigs(paf: DataFrame, min_aln: int = 5000, min_frac: float = 0.7) -> DataFrame:
    """Each contig on the target with most aligned bases: strand, position, span, share of all its bases, status.

    The position is the weighted median of the midpoints (in half bases,
    ``pos2`` is twice the position); ties of targets go to the smaller name, of
    strands to ``+``. ``ambiguous`` is what has under ``min_frac`` of its bases
    there, or under ``min_aln`` in all.
    """
    rows = mapped(paf).where("alnlen > 0 and tstart is not null and tend is not null").select(
        "qname", "tname", "alnlen", "tstart", "tend", "qlen", (F.col("tstart") + F.col("tend")).alias("mid2"), F.when(F.col("strand") == "+", F.col("alnlen")).otherwise(-F.col("alnlen")).alias("turn"))
    per_target = rows.groupBy("qname", "tname").agg(F.sum("alnlen").alias("bases"), F.sum("turn").alias("turn"), F.min("tstart").alias("tstart"), F.max("tend").alias("tend"), F.max("qlen").alias("qlen"))
    best = per_target.groupBy("qname").agg(
        F.min_by(F.struct("tname", "bases", "turn", "tstart", "tend"), F.struct((-F.col("bases")).alias("less"), "tname")).alias("b"),
        F.sum("bases").alias("total_aln"), F.max("qlen").alias("contig_len"))
    middle = weighted_median(rows, ["qname", "tname"], "mid2", "alnlen", "pos2")
    placed = best.select("qname", "b.*", "total_aln", "contig_len").join(middle, ["qname", "tname"])
    frac = F.col("bases") / F.col("total_aln")
    return placed.select(
        F.col("qname").alias("unit"), F.col("tname").alias("chrom"), F.when(F.col("turn") >= 0, "+").otherwise("-").alias("strand"), "pos2", "tstart", "tend",
        F.round(frac, 6).alias("frac"), "total_aln", F.coalesce("contig_len", F.lit(0).cast("long")).alias("contig_len"),
        F.when((frac < min_frac) | (F.col("total_aln") < min_aln), "ambiguous").otherwise("placed").alias("status"))


def scaffold(placements: DataFrame, gap: int = 100) -> DataFrame:
    """AGP rows: placed contigs of each target in order of position with gaps between them; others are scaffolds of their own.

    Organelles, by name of contig or target, are left out. Coordinates are 1-based and inclusive.
    """
    kept = placements.where(~organelle_name("unit") & (F.col("contig_len") > 0))
    placed = kept.where((F.col("status") == "placed") & ~organelle_name("chrom")).withColumn("_step", F.col("contig_len") + gap).withColumn("_one", F.lit(1).cast("long"))
    lined = running_totals(placed, ["chrom"], "pos2", ["pos2", "unit"], {"_offset": "_step", "_number": "_one"})
    count = placed.groupBy("chrom").agg(F.count(F.lit(1)).alias("_of"))
    lined = lined.join(count, "chrom")

    def row(object_: str | Column, start: Column, end: Column, part: Column, kind: str, component: Column, strand: Column) -> Column:
        return F.struct(
            (F.col(object_) if isinstance(object_, str) else object_).alias("object"), start.cast("long").alias("obj_start"), end.cast("long").alias("obj_end"), part.cast("long").alias("part"), F.lit(kind).alias("type"),
            component.alias("component"), strand.alias("orient"))

    end = F.col("_offset") + F.col("contig_len")
    whole = row("chrom", F.col("_offset") + 1, end, 2 * F.col("_number") + 1, "W", F.col("unit"), F.col("strand"))
    between = row("chrom", end + 1, end + gap, 2 * F.col("_number") + 2, "N", F.lit(None).cast("string"), F.lit(None).cast("string"))
    lined = lined.select(F.explode(F.filter(F.array(whole, F.when(F.col("_number") + 1 < F.col("_of"), between)), lambda x: x.isNotNull())).alias("x")).select("x.*")
    alone = kept.where("status <> 'placed'").select(row("unit", F.lit(1), F.col("contig_len"), F.lit(1), "W", F.col("unit"), F.lit("+")).alias("x")).select("x.*")
    return lined.unionByName(alone)


def walked_per_target(placements: DataFrame, targets: DataFrame) -> DataFrame:
    """Bases of each target within placed spans, first and last of them, and a ``TOTAL`` row."""
    from weftline.operators.intervals import periods_and_gaps

    placed = placements.where((F.col("status") == "placed") & ~organelle_name("chrom"))
    merged = periods_and_gaps(placed, ["chrom"], "tstart", "tend").where("kind = 'period'").groupBy("chrom").agg(
        F.sum(F.col("pos_end") - F.col("pos_start")).alias("walked_bp"), F.min("pos_start").alias("first"), F.max("pos_end").alias("last_bp"))
    counts = placed.groupBy("chrom").agg(F.count(F.lit(1)).alias("placed"))
    per = merged.join(counts, "chrom").join(targets.select(F.col("tname").alias("chrom"), F.col("tlen").alias("ref_len")), "chrom", "left").na.fill(0, ["ref_len"])
    rolled = per.rollup("chrom").agg(
        F.sum("placed").alias("placed"), F.min("first").alias("first"), F.max("last_bp").alias("last_bp"), F.sum("walked_bp").alias("walked_bp"), F.sum("ref_len").alias("ref_len"))
    one = F.col("chrom").isNotNull()
    return rolled.select(
        F.coalesce("chrom", F.lit("TOTAL")).alias("chrom"), F.when(one, F.col("placed")).alias("placed"), F.when(one, F.col("first") + 1).alias("first_bp"), F.when(one, F.col("last_bp")).alias("last_bp"),
        "walked_bp", "ref_len", F.when(F.col("ref_len") > 0, F.round(100 * F.col("walked_bp") / F.col("ref_len"), 6)).otherwise(0.0).alias("pct"))


def overlap_counts(placements: DataFrame) -> DataFrame:
    """How many other placed spans of its target each placed span overlaps, without forming the pairs.

    As many as begin before its end, less those that end by its start: two
    look-ups in running counts of starts and ends.
    """
    placed = placements.where("status = 'placed' and tstart < tend")
    points = placed.select("chrom", "unit", F.explode(F.array(
        F.struct(F.col("tend").alias("at"), F.lit(0).alias("rank"), F.lit("end").alias("what")),
        F.struct(F.col("tstart").alias("at"), F.lit(1).alias("rank"), F.lit("start").alias("what")),
    )).alias("p")).select("chrom", "unit", "p.*")
    # Per position first all ends, then all starts; counts of equal positions are joined back, so ties need no order.
    per = points.groupBy("chrom", "at").agg(F.sum((F.col("what") == "start").cast("long")).alias("starts"), F.sum((F.col("what") == "end").cast("long")).alias("ends"))
    ordered = running_totals(per, ["chrom"], "at", ["at"], {"starts_before": "starts", "ends_before": "ends"})
    upto = ordered.select("chrom", "at", "starts_before", (F.col("ends_before") + F.col("ends")).alias("ends_upto"))
    seen = points.join(upto, ["chrom", "at"])
    return seen.groupBy("chrom", "unit").agg(
        (F.max(F.when(F.col("what") == "end", F.col("starts_before"))) - F.max(F.when(F.col("what") == "start", F.col("ends_upto"))) - 1).alias("n_overlaps"))


def window_votes(paf: DataFrame, window: int = 5000) -> DataFrame:
    """The target with most aligned bases in each window of each query; ties go to the smaller name.

    Alignments with impossible query positions don't vote.
    """
    good = mapped(paf).where("qstart >= 0 and qstart < qend and qend <= qlen")
    parts = good.select("qname", "tname", "qstart", "qend", F.explode(F.sequence(F.floor(F.col("qstart") / window), F.floor((F.col("qend") - 1) / window))).alias("window_no"))
    bases = F.least("qend", (F.col("window_no") + 1) * window) - F.greatest("qstart", F.col("window_no") * window)
    votes = parts.groupBy("qname", "window_no", "tname").agg(F.sum(bases).alias("votes"))
    best = votes.groupBy("qname", "window_no").agg(F.min_by(F.struct("tname", "votes"), F.struct((-F.col("votes")).alias("less"), "tname")).alias("b"))
    return best.select("qname", "window_no", "b.tname", "b.votes")


def dominant_runs(votes: DataFrame) -> DataFrame:
    """Runs of successive windows of a query with one dominant target; windows without votes carry on.

    Only windows' winners are put in order, which a query's length bounds.
    """
    by_query = Window.partitionBy("qname").orderBy("window_no")
    changed = F.coalesce((F.lag("tname").over(by_query) != F.col("tname")).cast("int"), F.lit(1))
    numbered = votes.withColumn("_new", changed).withColumn("run_no", F.sum("_new").over(by_query.rowsBetween(Window.unboundedPreceding, 0)))
    runs = numbered.groupBy("qname", "run_no", "tname").agg(F.min("window_no").alias("first_window"), F.max("window_no").alias("last_vote"), F.sum("votes").alias("votes"))
    until = F.lead("first_window").over(Window.partitionBy("qname").orderBy("run_no"))
    return runs.select("qname", "run_no", "tname", "first_window", F.coalesce(until - 1, F.col("last_vote")).alias("last_window"), "votes")


def walk_starts_on_targets(positions: DataFrame, lengths: DataFrame, leaving: DataFrame, min_quality: float = 0.3, max_stretch: float = 2.0) -> DataFrame:
    """Per target the query from which a walk along it begins: the earliest one, ties going to the smaller name.

    ``positions`` are ``query_positions``; queries must be in ``leaving``
    (``node``), match at ``min_quality`` and span no more than ``max_stretch``
    of their length (``name``, ``length``). Where none does, the earliest of
    ``leaving`` stands, and ``strict`` is false.
    """
    out = positions.join(leaving.select(F.col("node").alias("qname")).distinct(), "qname", "left_semi")
    out = out.join(lengths.select(F.col("name").alias("qname"), "length"), "qname", "left")
    strict = (F.col("quality") >= min_quality) & (F.col("max_end") - F.col("min_start") <= max_stretch * F.coalesce("length", F.lit(0)))
    place = F.struct((~strict).cast("int").alias("loose"), "min_start", "qname")
    best = out.groupBy("tname").agg(F.min(place).alias("b"))
    return best.select("tname", F.col("b.qname").alias("qname"), F.col("b.min_start").alias("min_start"), (F.col("b.loose") == 0).alias("strict"))
