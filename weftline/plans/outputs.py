"""Queries over text files that are written first, routing of their records, graphs less what is pruned, and searches."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions import sequences as s
from weftline.operators import alignments as a
from weftline.operators import chimeras, pruning
from weftline.operators import extensions as x
from weftline.operators import graph as g
from weftline.operators import kmers as k
from weftline.operators import reach as r
from weftline.plans import graph as pg
from weftline.plans.alignments import _ASSIGNED
from weftline.plans.alignments import SQL as ALIGNMENT_SQL
from weftline.plans.graph import _GROUPS, _HALF, _OVERLAP, _PAIRS, _SPINES
from weftline.plans.kmers import _EXTENSIONS, _REVERSED, K
from weftline.session import shared_dir, written
from weftline.sources import text_formats as t
from weftline.sources.tables import table


def _text(df: DataFrame) -> str:
    """The path of the text lines ``line`` of ``df``, written to the shared folder."""
    path = f"{shared_dir(df.sparkSession)}/weftline-{uuid.uuid4().hex}"
    df.select("line").write.text(path)
    return path


def _records(spark: SparkSession, d: str) -> DataFrame:
    """The records of a graph file of all tables: declarations, whole links, and a path and a walk of each link."""
    segments, links = table(spark, d, "segments"), g.whole_links(table(spark, d, "links"))
    step = lambda n, o: F.struct(F.col(n).alias("name"), F.col(o).alias("orient"))
    steps, no = F.array(step("from_seg", "from_orient"), step("to_seg", "to_orient")), F.col("link_id").cast("string")
    lines = spark.range(1).select(F.explode(F.array(F.lit("H\tVN:Z:1.0"), F.lit("A\tdropped"), F.lit("X\tnote"))).alias("line"))
    for more in (
        segments.select(t.segment_lines(segments).alias("line")), links.select(t.link_lines(links).alias("line")),
        links.select(F.concat_ws("\t", F.lit("P"), F.concat(F.lit("p"), no), s.path_string(steps), F.lit("*")).alias("line")),
        links.select(F.concat_ws("\t", *map(F.lit, ("W", "s", "1")), F.concat(F.lit("w"), no), F.lit("0"), F.lit("1"), s.walk_string(steps)).alias("line")),
    ):
        lines = lines.unionByName(more)
    return t.read_records(spark, _text(lines))


def src01_segments(spark: SparkSession, d: str) -> DataFrame:
    return t.segments_of(_records(spark, d)).drop("line_no")


def src03_one_base_segments(spark: SparkSession, d: str) -> DataFrame:
    return t.segments_of(_records(spark, d), "one").select("name", "length")


def src05_upper_segments(spark: SparkSession, d: str) -> DataFrame:
    return t.segments_of(_records(spark, d), "drop", upper=True).drop("line_no")


def src02_links(spark: SparkSession, d: str) -> DataFrame:
    return t.links_of(_records(spark, d)).drop("line_no")


def _paf_path(spark: SparkSession, d: str) -> str:
    paf = table(spark, d, "paf")
    fields = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in t.PAF_COLUMNS]
    return _text(paf.select(F.concat_ws("\t", *fields).alias("line")))


def src07_alignments(spark: SparkSession, d: str) -> DataFrame:
    return t.read_paf(spark, _paf_path(spark, d), 500).drop("line_no")


def src08_alignments_to_one_target(spark: SparkSession, d: str) -> DataFrame:
    """Alignments of declared segments to the first target by name."""
    first = table(spark, d, "targets").agg(F.min("tname")).first()[0]
    named = table(spark, d, "segments").select(F.col("name").alias("qname"))
    return t.read_paf(spark, _paf_path(spark, d), 0, first, named).groupBy("qname").agg(F.count(F.lit(1)).alias("n"), F.sum("nmatch").alias("nmatch"))


def src09_tips(spark: SparkSession, d: str) -> DataFrame:
    ends = pg.g07_spine_ends(spark, d).select("component", F.col("tip_a"), F.col("tip_b"))
    path = f"{shared_dir(spark)}/weftline-{uuid.uuid4().hex}"
    ends.select(F.col("component").alias("comp_id"), F.lit("ok").alias("status"), F.col("tip_a").alias("tip1"), F.col("tip_b").alias("tip2"), F.lit(".").alias("tip3")).write.csv(path, sep="\t", header=True, quote="")
    return t.read_tips(spark, path).select("comp_id", F.array_join("tips", ",").alias("tips"))


def src10_kmer_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of each k-mer of the right length, and under a null k-mer the bad lines."""
    segments = table(spark, d, "segments").where("name is not null")
    good = k.canonical_kmers(segments, "seq", K, "name").select(F.concat_ws("\t", "kmer", "name").alias("line"))
    bad = segments.where(F.length("seq") < K).select(F.when(F.col("seg_id") % 2 == 0, F.concat_ws("\t", "seq", "name")).otherwise(F.col("name")).alias("line"))
    rows = t.read_kmers(spark, _text(good.unionByName(bad)), K)
    return rows.groupBy("kmer").agg(F.count(F.lit(1)).alias("n_lines"), F.countDistinct("node").alias("n_nodes"))


def src12_sizes(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "targets").select(F.concat_ws("\t", "tname", F.col("tlen").cast("string"), F.lit("0")).alias("line"))
    return t.read_sizes(spark, _text(lines))


def src13_assignments(spark: SparkSession, d: str) -> DataFrame:
    rows = a.assign_contigs(table(spark, d, "paf")).select(F.concat_ws("\t", "contig", F.col("contig_len").cast("string"), "best_chrom").alias("line"))
    head = spark.range(1).select(F.lit("contig\tcontig_len\tbest_chrom").alias("line"))
    return t.read_assignments(spark, _text(head.unionByName(rows)))


def g03_routed_records(spark: SparkSession, d: str) -> DataFrame:
    """Every record with the file it goes to: that of its component, by rank, or that of small components."""
    groups = pg._groups(spark, d)
    ranks = written(g.component_summary(table(spark, d, "links"), table(spark, d, "segments"), 1000, groups).select("component", "rank"))
    width = ranks.agg(F.greatest(F.lit(2), F.length(F.max("rank").cast("string"))).alias("width"))  # one row
    label = F.when(F.col("rank").isNull(), "small_components").otherwise(F.concat(F.lit("component_"), F.lpad(F.col("rank").cast("string"), F.greatest("width", F.length(F.col("rank").cast("string"))), F.lit("0"))))
    targets = written(ranks.crossJoin(F.broadcast(width)).select("component", label.alias("target")))
    return t.routed(t.routes_of(_records(spark, d)), groups, targets).select("target", "rec", F.array_join("fields", "\t").alias("line"))


#: Bases that tell spines apart, and that make a left-over spine worth keeping; the segments here are short.
SPINE_TOLERANCE, RESCUE = 100, 200


def _rounds(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return pruning.spine_rounds(table(spark, d, "links"), table(spark, d, "segments"), 1, SPINE_TOLERANCE, RESCUE)


def snk11_tip_table(spark: SparkSession, d: str) -> DataFrame:
    return _rounds(spark, d)[0]


def snk07_kept_lines(spark: SparkSession, d: str) -> DataFrame:
    """The lines of segments that some round kept, and of links within one round's component."""
    kept = written(_rounds(spark, d)[1])
    segments, links = table(spark, d, "segments"), g.whole_links(table(spark, d, "links"))
    nodes = segments.join(kept.select("name"), "name", "left_semi")
    for end, name in (("from_seg", "_a"), ("to_seg", "_b")):
        links = links.join(kept.select(F.col("name").alias(end), F.col("comp_id").alias(name)), end)
    links = links.where("_a = _b")
    lines = nodes.select(F.lit("S").alias("rec"), F.col("seg_id").alias("id"), t.segment_lines(nodes).alias("line"))
    return lines.unionByName(links.select(F.lit("L").alias("rec"), F.col("link_id").alias("id"), t.link_lines(links).alias("line")))


def j05_links_not_cut(spark: SparkSession, d: str) -> DataFrame:
    """Links less those to short dead ends beside a longer neighbour, whichever side states them."""
    links = g.whole_links(table(spark, d, "links"))
    return pruning.without_links(links, pruning.short_dead_ends(g.half_edges(links), g.segment_lengths(table(spark, d, "segments")))).select("link_id")


def snk08_lines_not_cut(spark: SparkSession, d: str) -> DataFrame:
    links = g.whole_links(table(spark, d, "links"))
    left = pruning.without_links(links, pruning.short_dead_ends(g.half_edges(links), g.segment_lengths(table(spark, d, "segments"))))
    segments = table(spark, d, "segments")
    lines = segments.select(F.lit("S").alias("rec"), F.col("seg_id").alias("id"), t.segment_lines(segments).alias("line"))
    return lines.unionByName(left.select(F.lit("L").alias("rec"), F.col("link_id").alias("id"), t.link_lines(left).alias("line")))


def snk09_unpruned_lines(spark: SparkSession, d: str) -> DataFrame:
    """The records of a graph file that touch no deleted segment (one all whose declarations are deleted): ``part`` 0 others, 1 segments, 2 links."""
    gone = table(spark, d, "segments").where("name is not null").groupBy("name").agg(F.count("deleted_at").alias("n"), F.count(F.lit(1)).alias("of")).where("n = of").select("name")
    records = written(_records(spark, d).where("rec <> 'A'"))
    field = lambda i: F.try_element_at("fields", F.lit(i))
    path = F.transform(F.split(field(3), ","), lambda y: F.regexp_replace(y, "[+-]$", ""))
    names = F.when(F.col("rec") == "S", F.array(field(2))).when(F.col("rec") == "L", F.array(field(2), field(4))).when(F.col("rec") == "P", path).when(F.col("rec") == "W", s.names_of_walk(field(7)))
    touched = records.select("line_no", F.explode(names).alias("name")).join(gone, "name", "left_semi").select("line_no").distinct()
    part = F.when(F.col("rec") == "S", 1).when(F.col("rec") == "L", 2).otherwise(0)
    return records.join(touched, "line_no", "left_anti").select(part.alias("part"), F.array_join("fields", "\t").alias("line"))


def snk16_unitig_stats(spark: SparkSession, d: str) -> DataFrame:
    """Of each declared segment: length, degree, bubble, budget, how often the two walks of its component use it, and where it lies on the target it matches most."""
    segments, links, paf = table(spark, d, "segments"), table(spark, d, "links"), table(spark, d, "paf")
    edges = written(g.half_edges(links))
    budgets = g.visit_budgets(edges, segments, paf.where("qname is not null and tname <> '*'"))
    walks = pg._walks(spark, d, pg._groups(spark, d))
    used = pg._paired_walks(walks, pg._pairs(spark, d, walks)).groupBy("node").agg(F.count(F.lit(1)).alias("used"))
    best = a.query_positions(paf).groupBy("qname").agg(F.min_by(F.struct("tname", "min_start", "max_end"), F.struct((-F.col("matches")).alias("less"), "tname")).alias("b"))
    out = budgets.join(g.segment_lengths(segments).withColumnRenamed("name", "node"), "node").join(used, "node", "left").join(best.withColumnRenamed("qname", "node"), "node", "left")
    return out.select(
        F.col("node").alias("unitig"), "length", "degree", F.when(F.col("in_bubble"), "Y").otherwise("N").alias("bubble_alt"), "budget", F.coalesce("used", F.lit(0)).alias("used"),
        F.coalesce("b.tname", F.lit("NA")).alias("aligned_chr"), F.col("b.min_start").alias("ref_start"), F.col("b.max_end").alias("ref_end"))


def snk17_kmer_records(spark: SparkSession, d: str) -> DataFrame:
    """Records to count k-mers in: segments of K bases or more, and numbered records across links."""
    kept = written(x.kept_sequences(table(spark, d, "segments")))
    whole = kept.where(F.length("seq") >= K).select(F.concat(F.lit(">S_"), "name").alias("header"), "seq")
    crossing = x.crossing_records(g.outgoing_steps(g.half_edges(table(spark, d, "links"))), kept, K)
    no = F.row_number().over(Window.partitionBy("node", "orient").orderBy("record")) - 1
    walks = crossing.select("node", "orient", no.alias("no"), F.col("record").alias("seq"))
    return whole.unionByName(walks.select(F.concat(F.lit(">W_"), "node", "orient", F.lit("_"), F.col("no").cast("string")).alias("header"), "seq"))


def p10_chromosome_contigs(spark: SparkSession, d: str) -> DataFrame:
    """The contigs of each chromosome under its name: those that links join within it, and the others of its assigned contigs."""
    chosen = written(a.assign_contigs(table(spark, d, "paf")).where("best_chrom <> 'unplaced'").select(F.col("contig").alias("name"), F.col("best_chrom").alias("chrom")))
    links = g.whole_links(table(spark, d, "links"))
    for end, chrom in (("from_seg", "_a"), ("to_seg", "_b")):
        links = links.join(chosen.select(F.col("name").alias(end), F.col("chrom").alias(chrom)), end)
    joined = links.where("_a = _b").select(F.explode(F.array("from_seg", "to_seg")).alias("name")).distinct()
    kept = chosen.join(x.kept_sequences(table(spark, d, "segments")), "name")
    both = kept.join(joined, "name", "left_semi").withColumn("part", F.lit("joined")).unionByName(kept.join(joined, "name", "left_anti").withColumn("part", F.lit("unused")))
    return both.select("chrom", "part", F.concat(F.lit(">"), "chrom", F.lit(".h1."), "name", F.lit("\n"), t.wrapped(F.col("seq"), 60)).alias("record"))


def j09_slice_alignments(spark: SparkSession, d: str) -> DataFrame:
    """Per slice of a cut contig: the alignments that overlap it, and their bases. Both are cut into windows, and a pair counts in the first window they share."""
    paf, width = table(spark, d, "paf"), 5000
    slices = written(chimeras.breakpoints(paf)).where("slice_start < slice_end")
    windows = lambda start, end: F.explode(F.sequence(F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width)))
    left = slices.select("qname", "slice_no", "slice_start", "slice_end", windows("slice_start", "slice_end").alias("w"))
    right = a.mapped(paf).where("qstart >= 0 and qstart < qend and qend <= qlen").select("qname", "aln_id", "qstart", "qend", windows("qstart", "qend").alias("w"))
    first = F.col("w") == F.greatest(F.floor(F.col("slice_start") / width), F.floor(F.col("qstart") / width))
    pairs = left.join(right, ["qname", "w"]).where(first & (F.col("qstart") < F.col("slice_end")) & (F.col("qend") > F.col("slice_start")))
    bases = F.least("qend", "slice_end") - F.greatest("qstart", "slice_start")
    return pairs.groupBy("qname", "slice_no").agg(F.count(F.lit(1)).alias("n_alns"), F.sum(bases).alias("bases"))


def g13_reachable_states(spark: SparkSession, d: str) -> DataFrame:
    """What can be reached along oriented steps from the first end of every link whose id 50 divides, with depths and parents."""
    links = g.whole_links(table(spark, d, "links"))
    plain = F.when(F.col("from_orient") == "-", "-").otherwise("+")
    sources = links.where("link_id % 50 = 0").select(F.col("link_id").alias("source"), F.col("from_seg").alias("node"), plain.alias("orient"))
    return r.reached(g.outgoing_steps(g.half_edges(links)), sources, ["node", "orient"])


def u02_between_tips(spark: SparkSession, d: str) -> DataFrame:
    """Of each component, the nodes that both ends of its spine reach without passing through the other."""
    groups = pg._groups(spark, d)
    edges, ends = pg._spines(spark, d, groups)
    tip = lambda start, stop: F.struct(F.concat("component", F.lit("|"), F.lit(start)).alias("source"), F.col(start).alias("node"), F.col(stop).alias("stop"))
    both = written(ends.select("component", F.explode(F.array(tip("tip_a", "tip_b"), tip("tip_b", "tip_a"))).alias("x")).select("component", "x.*"))
    steps = edges.where("node <> to_node").select("node", "to_node")
    found = r.reached(steps, both.select("source", "node"), ["node"], both.select("source", F.col("stop").alias("node")), groups)
    per = found.join(both.select("source", "component"), "source").groupBy("component", "node").agg(F.count(F.lit(1)).alias("n"))
    return per.where("n = 2").select("component", "node")


QUERIES = {f.__name__: f for f in (
    src01_segments, src02_links, src03_one_base_segments, src05_upper_segments, src07_alignments, src08_alignments_to_one_target, src09_tips, src10_kmer_lines, src12_sizes, src13_assignments,
    g03_routed_records, snk11_tip_table, snk07_kept_lines, j05_links_not_cut, snk08_lines_not_cut, snk09_unpruned_lines, snk16_unitig_stats, snk17_kmer_records, p10_chromosome_contigs,
    j09_slice_alignments, g13_reachable_states, u02_between_tips,
)}

_TEXT = """
text_lines(part, rec, key, line) as (
  select 0, 'H', null, 'H' || chr(9) || 'VN:Z:1.0'
  union all select 0, 'X', null, 'X' || chr(9) || 'note'
  union all select 1, 'S', coalesce(name, '*'), concat_ws(chr(9), 'S', coalesce(name, '*'), coalesce(seq, '*'), nullif(tags, '')) from segments
  union all select 2, 'L', from_seg, concat_ws(chr(9), 'L', from_seg, from_orient, to_seg, to_orient, coalesce(overlap, '*'), nullif(tags, '')) from links where from_seg is not null and to_seg is not null
  union all select 0, 'P', from_seg, concat_ws(chr(9), 'P', 'p' || link_id, from_seg || from_orient || ',' || to_seg || to_orient, '*') from links where from_seg is not null and to_seg is not null
  union all select 0, 'W', from_seg, concat_ws(chr(9), 'W', 's', '1', 'w' || link_id, '0', '1', case when from_orient = '-' then '<' else '>' end || from_seg || case when to_orient = '-' then '<' else '>' end || to_seg) from links where from_seg is not null and to_seg is not null
)"""
_LN = "try_cast(nullif(regexp_extract(chr(9) || coalesce(tags, ''), chr(9) || 'LN:[^:\\t]*:([^\\t]*)', 1), '') as bigint)"
_CUT = _HALF + """, sides as (
  select distinct node, exit_side, to_node, to_side from half where node <> to_node
), lens as (
  select name, max(coalesce(seg_len, 0)) as length from segments where name is not null group by 1
), sized as (
  select s.*, coalesce(length, 0) as length, exists (select 1 from half h where h.node = s.to_node and h.exit_side = 1 - s.to_side) as onward from sides s left join lens on name = to_node
), short as (
  select * from sized s where not onward and length < (select max(length) from sized t where t.node = s.node and t.exit_side = s.exit_side)
), cut as (
  select node as a, exit_side as a_side, to_node as b, to_side as b_side from short union select to_node, to_side, node, exit_side from short
), left_ as (
  select l.* from links l where from_seg is not null and to_seg is not null and not exists (
    select 1 from cut c where c.a = l.from_seg and c.a_side = case when from_orient = '-' then 0 else 1 end and c.b = l.to_seg and c.b_side = case when to_orient = '-' then 1 else 0 end)
)"""


def _round_sql(no: int) -> str:
    """One round of spines, numbered; a round after one that kept nothing has no names."""
    start = "select distinct name from segments where name is not null" if not no else f"select name from names{no - 1} where name not in (select name from kept{no - 1}) and exists (select 1 from kept{no - 1})"
    low = "" if not no else f"when coalesce(spine_bp, 0) < {RESCUE} then 'below_rescue_threshold' "
    passed = "" if no else " union select v, '0.' || g from grp0 join facts0 on component = g where status in ('too_small', 'too_few_tips')"
    return f"""names{no} as materialized (
  {start}
), links{no} as materialized (
  select from_seg, from_orient, to_seg, to_orient from links where from_seg in (from names{no}) and to_seg in (from names{no})
), way{no} as (
  select from_seg as a, to_seg as b from links{no} union select to_seg, from_seg from links{no}
), grp{no}(v, g) using key (v) as (
  select name, name from names{no}
  union select e.b, min(x.g) from grp{no} x join way{no} e on e.a = x.v join recurring.grp{no} y on y.v = e.b where x.g < y.g group by e.b
), half{no} as (
  select from_seg as node, case when from_orient = '-' then 0 else 1 end as exit_side from links{no} union all select to_seg, case when to_orient = '-' then 1 else 0 end from links{no}
), tip{no} as materialized (
  select node, any_value(g) as component from half{no} join grp{no} on v = node group by 1 having min(exit_side) = max(exit_side)
), step{no} as (
  select a as node, b as to_node, length as step from way{no} join lens on name = b where a <> b
), sweep{no}(source, node, bp) using key (source, node) as (
  select node, node, length from tip{no} join lens on name = node
  union select x.source, p.to_node, min(x.bp + p.step) from sweep{no} x join step{no} p on p.node = x.node left join recurring.sweep{no} y on y.source = x.source and y.node = p.to_node
  where y.bp is null or x.bp + p.step < y.bp group by 1, 2
), ranked{no} as materialized (
  select t.component, s.source, s.node, bp, row_number() over (partition by t.component order by bp desc, s.source, s.node) as rn from sweep{no} s join tip{no} t on t.node = s.node where s.source < s.node
), facts{no} as materialized (
  select c.component, c.size, c.n_tips, x.source as tip_a, x.node as tip_b, x.bp as spine_bp, y.bp as second_bp, case when n_tips < 2 then 'too_few_tips' {low}else 'ok' end as status
  from (select g as component, count(*) as size, count(t.node) as n_tips from grp{no} left join tip{no} t on t.node = v group by 1) c
    left join ranked{no} x on x.component = c.component and x.rn = 1 left join ranked{no} y on y.component = c.component and y.rn = 2
), other{no} as (
  select node from tip{no} where node not in (select tip_a from facts{no} where status = 'ok') and node not in (select tip_b from facts{no} where status = 'ok')
), inner{no} as (
  select a, b from way{no} where a not in (from other{no}) and b not in (from other{no})
), region{no}(v, part) using key (v) as (
  select v, v from (select a as v from inner{no} union select tip_a from facts{no} where status = 'ok' union select tip_b from facts{no} where status = 'ok')
  union select e.b, min(x.part) from region{no} x join inner{no} e on e.a = x.v join recurring.region{no} y on y.v = e.b where x.part < y.part group by e.b
), kept{no} as materialized (
  select r.v as name, '{no}.' || f.component as comp_id from facts{no} f join region{no} x on x.v = f.tip_a join region{no} y on y.v = f.tip_b and y.part = x.part join region{no} r on r.part = x.part where f.status = 'ok'{passed}
)"""


_ROUNDS = "with recursive lens as (select name, max(coalesce(seg_len, 0)) as length from segments where name is not null group by 1), " + ", ".join(map(_round_sql, range(4)))
SQL = {
    "src01_segments": f"select coalesce(name, '*') as name, nullif(nullif(seq, '*'), '') as seq, cast(case when seq <> '*' and seq <> '' then length(seq) else coalesce({_LN}, 0) end as bigint) as length from segments",
    "src03_one_base_segments": "select coalesce(name, '*') as name, cast(length(coalesce(seq, '*')) as bigint) as length from segments",
    "src05_upper_segments": "select coalesce(name, '*') as name, upper(seq) as seq, cast(length(seq) as bigint) as length from segments where seq <> '*' and seq <> ''",
    "src02_links": "select from_seg, from_orient, to_seg, to_orient, coalesce(overlap, '*') as overlap from links where from_seg is not null and to_seg is not null",
    "src07_alignments": "select coalesce(qname, '') as qname, qlen, qstart, qend, coalesce(strand, '') as strand, coalesce(tname, '') as tname, tlen, tstart, tend, nmatch, alnlen, cast(mapq as bigint) as mapq from paf where alnlen >= 500 and (qname is null or not starts_with(qname, '#'))",
    "src08_alignments_to_one_target": """select qname, count(*) as n, cast(sum(nmatch) as bigint) as nmatch from paf where tname = (select min(tname) from targets) and qname in (select name from segments where name is not null) and alnlen >= 0 and not starts_with(qname, '#') group by 1""",
    "src09_tips": _SPINES + " select component as comp_id, tip_a || ',' || tip_b as tips from spines",
    "src10_kmer_lines": f"""
with pos as (
  select name, upper(substr(seq, i, {K})) as u from (select name, seq, unnest(range(1, length(seq) - {K} + 2)) as i from segments where name is not null and seq <> '*' and length(seq) >= {K})
), lines_ as (
  select least(u, {_REVERSED.format('u')}) as kmer, name as node from pos union all select null, null from segments where name is not null and length(seq) < {K}
)
select kmer, count(*) as n_lines, count(distinct node) as n_nodes from lines_ group by 1""",
    "src12_sizes": "select tname, tlen from targets",
    "src13_assignments": _ASSIGNED + " select contig, best_chrom from assigned",
    "g03_routed_records": _GROUPS + f""", {_TEXT.strip()}, per_name as (
  select name, max(coalesce(seg_len, 0)) as length from segments where name is not null group by 1
), per_group as (
  select g, coalesce(sum(length), 0) as seg_bp from grouped left join per_name on name = v group by 1
), spans as (
  select g, sum({_OVERLAP}) as overlap_bp from links join grouped on v = from_seg where to_seg is not null group by 1
), uniq as (
  select g, greatest(seg_bp - coalesce(overlap_bp, 0), 0) as bp from per_group left join spans using (g)
), ranks as (
  select g, case when bp >= 1000 then row_number() over (order by case when bp >= 1000 then 0 else 1 end, bp desc, g) end as rank from uniq
), targets_ as (
  select g, case when rank is null then 'small_components' else 'component_' || lpad(cast(rank as varchar), cast(greatest(2, length(cast((select max(rank) from ranks) as varchar))) as int), '0') end as target from ranks
)
select target, rec, line from text_lines join grouped on v = key join targets_ using (g)
union all select target, rec, line from text_lines, (select distinct target from targets_) where rec in ('H', 'X')""",
    "snk11_tip_table": _ROUNDS + " " + " union all ".join(f"""select '{n}.' || component as comp_id, {n} as round, status, size, n_tips, case when status <> 'too_few_tips' then tip_a end as tip1, case when status <> 'too_few_tips' then tip_b end as tip2,
  cast(case when status <> 'too_few_tips' then coalesce(spine_bp, 0) else 0 end as bigint) as spine_len_bp, status <> 'too_few_tips' and coalesce(second_bp > 0 and spine_bp - second_bp < {SPINE_TOLERANCE}, false) as ambiguous,
  cast(case when status <> 'too_few_tips' then coalesce(second_bp, 0) else 0 end as bigint) as second_best_bp from facts{n}""" for n in range(4)),
    "snk07_kept_lines": _ROUNDS + ", kept_ as (" + " union all ".join(f"from kept{n}" for n in range(4)) + """)
select 'S' as rec, seg_id as id, concat_ws(chr(9), 'S', coalesce(name, '*'), coalesce(seq, '*'), nullif(tags, '')) as line from segments where name in (select name from kept_)
union all
select 'L', link_id, concat_ws(chr(9), 'L', from_seg, from_orient, to_seg, to_orient, coalesce(overlap, '*'), nullif(tags, '')) from links join kept_ a on a.name = from_seg join kept_ b on b.name = to_seg and b.comp_id = a.comp_id""",
    "j05_links_not_cut": _CUT + " select link_id from left_",
    "snk08_lines_not_cut": _CUT + """
select 'S' as rec, seg_id as id, concat_ws(chr(9), 'S', coalesce(name, '*'), coalesce(seq, '*'), nullif(tags, '')) as line from segments
union all select 'L', link_id, concat_ws(chr(9), 'L', from_seg, from_orient, to_seg, to_orient, coalesce(overlap, '*'), nullif(tags, '')) from left_""",
    "snk09_unpruned_lines": f"""
with {_TEXT.strip()}, gone as (
  select name from segments where name is not null group by 1 having count(deleted_at) = count(*)
), both_ends as (
  select part, rec, line, case rec when 'S' then [key] when 'L' then [key, split_part(line, chr(9), 4)]
    when 'P' then list_transform(string_split(split_part(line, chr(9), 3), ','), lambda x: x[:-2]) when 'W' then list_filter(regexp_split_to_array(split_part(line, chr(9), 7), '[<>]'), lambda x: x <> '') else [] end as names_ from text_lines
)
select part, line from both_ends where not list_has_any(names_, (select list(name) from gone))""",
    "snk16_unitig_stats": _PAIRS + """, nbr as (
  select node, count(distinct to_node) as n, min(to_node) as low, max(to_node) as high from half where node <> to_node group by 1
), declared as (
  select distinct name as node from segments where name is not null
), bub as (
  select node from (select node, count(*) over (partition by low, high) as arms from nbr where n = 2 and node in (from declared)) where arms >= 2
), pos as (
  select qname, tname, min(tstart) as s, max(tend) as e, coalesce(sum(nmatch), 0) as m from paf where qname is not null and tname <> '*' and tstart is not null and tend is not null group by 1, 2
), best_pos as (
  select * from pos qualify row_number() over (partition by qname order by m desc, tname) = 1
), uses as (
  select node, count(*) as used from paired group by 1
), marked as (
  select d.node, coalesce(n, 0) as degree, d.node in (from bub) as in_bubble, d.node in (select qname from paf where qname is not null and tname <> '*') as aligned from declared d left join nbr using (node)
)
select m.node as unitig, cast(l.length as bigint) as length, degree, case when in_bubble then 'Y' else 'N' end as bubble_alt,
  cast(case when not aligned then greatest(case when in_bubble then 1 when degree > 4 then 4 else 2 end, 2) when in_bubble then 1 when degree > 4 then 4 else 2 end as int) as budget,
  coalesce(used, 0) as used, coalesce(p.tname, 'NA') as aligned_chr, p.s as ref_start, p.e as ref_end
from marked m join lens l on l.name = m.node left join uses u on u.node = m.node left join best_pos p on p.qname = m.node""",
    "snk17_kmer_records": _EXTENSIONS + f""", records as (
  select distinct node, orient, right(case when orient = '-' then {_REVERSED.format('seq')} else seq end, {K - 1}) || ext as record from extensions join seqs on name = node where length(right(seq, {K - 1})) + length(ext) >= {K}
)
select '>S_' || name as header, seq from seqs where length(seq) >= {K}
union all select '>W_' || node || orient || '_' || (row_number() over (partition by node, orient order by record) - 1), record from records""",
    "p10_chromosome_contigs": _ASSIGNED + """, chosen as (
  select contig as name, best_chrom as chrom from assigned where best_chrom <> 'unplaced'
), joined as (
  select unnest([from_seg, to_seg]) as name from links join chosen a on a.name = from_seg join chosen b on b.name = to_seg and b.chrom = a.chrom
), seqs as (
  select name, upper(arg_min(seq, seg_id)) as seq from segments where name is not null and seq <> '*' and seq <> '' group by 1
)
select chrom, case when name in (select name from joined) then 'joined' else 'unused' end as part,
  '>' || chrom || '.h1.' || name || chr(10) || regexp_replace(regexp_replace(seq, '(.{60})', '\\1' || chr(10), 'g'), '\\n$', '') as record from chosen join seqs using (name)""",
    "j09_slice_alignments": f"""
with recursive slices as ({ALIGNMENT_SQL['w09_breakpoints'].strip().replace('with recursive ', 'with recursive ', 1)})
select s.qname, s.slice_no, count(*) as n_alns, cast(sum(least(qend, slice_end) - greatest(qstart, slice_start)) as bigint) as bases
from slices s join paf p on p.qname = s.qname and p.tname <> '*' and qstart >= 0 and qstart < qend and qend <= qlen and qstart < slice_end and qend > slice_start where slice_start < slice_end group by 1, 2""",
    "g13_reachable_states": _HALF.replace("with half", "with recursive half") + """, steps as (
  select distinct node, case when exit_side = 1 then '+' else '-' end as orient, to_node, case when to_side = 0 then '+' else '-' end as to_orient from half
), reach(source, node, orient, depth, parent) using key (source, node, orient) as (
  select link_id, from_seg, case when from_orient = '-' then '-' else '+' end, 0, cast(null as varchar) from links where link_id % 50 = 0 and from_seg is not null and to_seg is not null
  union
  select r.source, s.to_node, s.to_orient, min(r.depth) + 1, min(r.node || r.orient) from reach r join steps s on s.node = r.node and s.orient = r.orient
  where not exists (select 1 from recurring.reach y where y.source = r.source and y.node = s.to_node and y.orient = s.to_orient) group by 1, 2, 3
)
select source, node, orient, depth, parent from reach""",
    "u02_between_tips": _SPINES + """, starts_ as (
  select component, tip_a as a, tip_b as b from spines union all select component, tip_b, tip_a from spines
), walked(component, a, b, node) as (
  select component, a, b, a from starts_
  union
  select w.component, w.a, w.b, p.to_node from walked w join pairs p on p.node = w.node where w.node <> w.b
)
select component, node from walked group by 1, 2 having count(*) = 2""",
}
