"""Graph, alignment and interval text files as tables, and tables as such files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.sequences import names_of_walk
from weftline.operators.skew import lookup

PAF_COLUMNS = ("qname", "qlen", "qstart", "qend", "strand", "tname", "tlen", "tstart", "tend", "nmatch", "alnlen", "mapq")
PAF_TEXT = ("qname", "strand", "tname")

#: What a length is where ``*`` stands for the sequence: the LN tag or 0, one base, an error without LN, or no segment.
LENGTHS = ("tag", "one", "strict", "drop")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """``file``, ``line_no`` (an increasing number, not dense), ``rec`` and ``fields`` of the tab-separated lines under ``path``.

    Lines keep their order within a file; empty lines are left out.
    """
    lines = spark.read.text(path).withColumn("file", F.input_file_name()).withColumn("line_no", F.monotonically_increasing_id())
    fields = F.split(F.regexp_replace("value", "\r$", ""), "\t")
    return lines.where("value <> ''").select("file", "line_no", fields[0].alias("rec"), fields.alias("fields"))


def _field(i: int) -> Column:
    return F.try_element_at("fields", F.lit(i))


def tag(fields: Column, name: str, first: int) -> Column:
    """The value of the first tag of this name behind the fixed fields, null without one."""
    tags = F.slice(fields, first, F.greatest(F.size(fields) - (first - 1), F.lit(0)))
    hit = F.try_element_at(F.filter(tags, lambda t: t.startswith(f"{name}:")), F.lit(1))
    return F.regexp_extract(hit, "^[^:]*:[^:]*:(.*)$", 1)


def segments_of(records: DataFrame, lengths: str = "tag", upper: bool = False) -> DataFrame:
    """``name``, ``seq`` (null where it isn't kept), ``length``, ``line_no`` of S records, by one of LENGTHS."""
    if lengths not in LENGTHS:
        raise ValueError(f"unknown lengths: {lengths}")
    seq, ln = _field(3), F.expr("try_cast(ln as bigint)")
    rows = records.where("rec = 'S' and size(fields) >= 3").withColumn("ln", tag(F.col("fields"), "LN", 4))
    kept = F.when((seq != "*") & (seq != ""), F.upper(seq) if upper else seq)
    missing = {"tag": F.coalesce(ln, F.lit(0)), "one": F.length(seq).cast("long"), "drop": F.lit(None).cast("long"), "strict": F.coalesce(ln, F.raise_error(F.concat(F.lit("no LN tag for "), _field(2))).cast("long"))}[lengths]
    out = rows.select(_field(2).alias("name"), kept.alias("seq"), F.when(kept.isNotNull(), F.length(kept).cast("long")).otherwise(missing).alias("length"), "line_no")
    return out.where("seq is not null") if lengths == "drop" else out


def links_of(records: DataFrame, missing_overlap: str = "*") -> DataFrame:
    """``from_seg``, ``from_orient``, ``to_seg``, ``to_orient``, ``overlap``, ``line_no`` of L records."""
    rows = records.where("rec = 'L' and size(fields) >= 5")
    names = ("from_seg", "from_orient", "to_seg", "to_orient")
    return rows.select(*(_field(i + 2).alias(n) for i, n in enumerate(names)), F.coalesce(_field(6), F.lit(missing_overlap)).alias("overlap"), "line_no")


def routes_of(records: DataFrame) -> DataFrame:
    """``line_no``, ``rec``, ``fields`` and the segment ``name`` by which a record is sent to a component.

    S by its name, L and C by their first segment, P and W by the first of
    their steps; H and unknown records have a null name and belong everywhere;
    A records are dropped.
    """
    first_step = F.regexp_replace(F.split(_field(3), ",")[0], "[+-]$", "")
    name = (
        F.when(F.col("rec").isin("S", "L", "C"), _field(2)).when(F.col("rec") == "P", first_step)
        .when(F.col("rec") == "W", F.try_element_at(names_of_walk(_field(7)), F.lit(1)))
    )
    return records.where("rec <> 'A'").select("line_no", "rec", name.alias("name"), "fields")


def read_paf(spark: SparkSession, path: str, min_aln: int = 0, target: str | None = None, include: DataFrame | None = None) -> DataFrame:
    """The twelve columns of alignment lines with at least so many fields; comments and shorter alignments are left out.

    With ``target`` only its alignments count, and with ``include`` only those of its ``qname``.
    """
    records = read_records(spark, path).where("rec not like '#%' and size(fields) >= 12")
    typed = [(_field(i + 1) if n in PAF_TEXT else F.expr(f"try_cast(element_at(fields, {i + 1}) as bigint)")).alias(n) for i, n in enumerate(PAF_COLUMNS)]
    rows = records.select(*typed, "line_no").where(F.col("alnlen") >= min_aln)
    rows = rows if target is None else rows.where(F.col("tname") == target)
    return rows if include is None else rows.join(include.select("qname"), "qname", "left_semi")


def read_tips(spark: SparkSession, path: str) -> DataFrame:
    """``comp_id`` and the array ``tips`` of a tip table: all columns that the header calls ``tip`` and something, without ``.``."""
    rows = spark.read.csv(path, sep="\t", header=True, quote="")
    named = [F.col(c) for c in rows.columns if c.startswith("tip")]
    return rows.select("comp_id", F.filter(F.array(*named), lambda t: t.isNotNull() & (t != ".")).alias("tips"))


def read_kmers(spark: SparkSession, path: str, k: int) -> DataFrame:
    """``kmer`` and ``node`` of tab-separated lines, and whether the line is ``good``: two fields, the first of ``k`` letters."""
    parts = F.split("value", "\t", 2)
    good = (F.size(parts) == 2) & (F.length(parts[0]) == k)
    return spark.read.text(path).select(F.when(good, parts[0]).alias("kmer"), F.when(good, F.try_element_at(parts, F.lit(2))).alias("node"), good.alias("good"))


def routed(lines: DataFrame, groups: DataFrame, targets: DataFrame) -> DataFrame:
    """``target``, ``rec``, ``fields`` of each record: where its segment's component goes, or to every target where it has no segment.

    ``lines`` are records with their route ``name``; ``groups`` give the
    component of a name and ``targets`` the ``target`` of a component. Records of
    unknown segments are dropped. Headers and unknown records belong in every
    target; there they are as many times as there are targets.
    """
    of_name = groups.join(targets, "component").select("name", "target")
    own = lookup(lines.where("name is not null"), "name", of_name, "target", F.col("line_no")).where("target is not null")
    everywhere = lines.where("name is null and rec not in ('S', 'L', 'C', 'P', 'W')").withColumn("_all", F.lit(1))
    every = everywhere.join(targets.select("target").distinct().withColumn("_all", F.lit(1)), "_all")
    return own.select("target", "rec", "fields").unionByName(every.select("target", "rec", "fields"))


def read_sizes(spark: SparkSession, path: str) -> DataFrame:
    """``tname`` and ``tlen`` from the first two columns of an index or sizes file."""
    return read_records(spark, path).where("size(fields) >= 2").select(F.col("rec").alias("tname"), F.expr("try_cast(element_at(fields, 2) as bigint)").alias("tlen"))


def read_assignments(spark: SparkSession, path: str) -> DataFrame:
    """``contig`` and ``best_chrom`` of assignment lines; the header has no number in its second column; the last line of a contig holds."""
    rows = read_records(spark, path).where("size(fields) >= 3 and element_at(fields, 2) rlike '^[0-9]+$'")
    return rows.groupBy(F.col("rec").alias("contig")).agg(F.max_by(_field(3), F.struct("file", "line_no")).alias("best_chrom"))


def segment_lines(segments: DataFrame, keep_sequence: bool = True) -> Column:
    """S lines of ``name``, ``seq``, ``seg_len`` and ``tags``; without sequence ``*`` with the length as LN, unless there is one."""
    seq = F.coalesce("seq", F.lit("*")) if keep_sequence else F.lit("*")
    tags = F.when(F.coalesce("tags", F.lit("")) != "", F.col("tags"))
    if not keep_sequence:
        length = F.concat(F.lit("LN:i:"), F.coalesce("seg_len", F.lit(0)).cast("string"))
        tags = F.when(F.coalesce(tags, F.lit("")).rlike("(^|\t)LN:"), tags).otherwise(F.concat_ws("\t", tags, length))
    return F.concat_ws("\t", F.lit("S"), F.coalesce("name", F.lit("*")), seq, tags)


def link_lines(links: DataFrame) -> Column:
    """L lines of the columns of ``links``; a missing overlap is ``*``."""
    return F.concat_ws("\t", F.lit("L"), "from_seg", "from_orient", "to_seg", "to_orient", F.coalesce("overlap", F.lit("*")), F.when(F.coalesce("tags", F.lit("")) != "", F.col("tags")))


def wrapped(seq: Column, width: int = 80) -> Column:
    """A sequence in lines of ``width``, without a line end behind the last."""
    return F.regexp_replace(F.regexp_replace(seq, f"(.{{{width}}})", "$1\n"), "\n$", "")


def fasta_records(df: DataFrame, name: str, seq: str, width: int = 80) -> DataFrame:
    """One text per record: a header with the length, and the wrapped sequence; null sequences give none."""
    header = F.concat(F.lit(">"), F.col(name), F.lit(" len="), F.length(seq).cast("string"))
    return df.where(F.col(seq).isNotNull()).select(F.concat(header, F.lit("\n"), wrapped(F.col(seq), width)).alias("value"))


def write_lines(df: DataFrame, path: str, order: list[str] | None = None, by: str | None = None) -> None:
    """Write the text column ``value``; in ``order`` if given, and a folder per value of ``by``.

    Ordered output is range-partitioned, so files follow each other in the
    order of their names.
    """
    if order:
        df = df.repartitionByRange(*order).sortWithinPartitions(*order)
    columns = ["value", by] if by else ["value"]
    writer = df.select(*columns).write.mode("errorifexists")
    (writer.partitionBy(by) if by else writer).text(path)
