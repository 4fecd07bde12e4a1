"""Alignment queries: assignment, filtering, dovetails, placement and scaffolds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.sequences import ORGANELLE_PREFIXES, ORGANELLES, organelle_name, percent_identity
from weftline.operators import alignments as a
from weftline.operators import chimeras
from weftline.operators import graph as g
from weftline.sources.tables import table


def _paf(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "paf")


def a03_aligned_bp(spark: SparkSession, d: str) -> DataFrame:
    return a.aligned_per_target(_paf(spark, d))


def a04_assign_contigs(spark: SparkSession, d: str) -> DataFrame:
    out = a.assign_contigs(_paf(spark, d))
    return out.withColumn("best_frac", F.round("best_frac", 6)).withColumn("second_ratio", F.round("second_ratio", 6))


def j02_on_assigned_target(spark: SparkSession, d: str) -> DataFrame:
    paf = _paf(spark, d)
    return a.on_assigned_target(paf, a.assign_contigs(paf)).select("aln_id", "qname", "tname")


def j04_queries_without_segment(spark: SparkSession, d: str) -> DataFrame:
    names = _paf(spark, d).where("qname is not null").select("qname").distinct()
    segments = table(spark, d, "segments").select(F.col("name").alias("qname")).distinct()
    return names.join(segments, "qname", "left_anti")


def p03_dovetails(spark: SparkSession, d: str) -> DataFrame:
    # Targets are far longer than alignments, so the ends of targets are taken generously.
    return a.dovetails(_paf(spark, d), 80.0, 300, 20_000)


def sc15_identity(spark: SparkSession, d: str) -> DataFrame:
    span = (F.col("qend") - F.col("qstart") + F.col("tend") - F.col("tstart")) / 2
    return _paf(spark, d).select("aln_id", F.round(percent_identity("nmatch", "alnlen"), 6).alias("pct_identity"), span.alias("mean_span"))


def sc14_organelles(spark: SparkSession, d: str) -> DataFrame:
    names = _paf(spark, d).where("tname is not null").select("tname").distinct()
    return names.select("tname", organelle_name("tname").alias("is_organelle"))


def a07_query_positions(spark: SparkSession, d: str) -> DataFrame:
    return a.query_positions(_paf(spark, d))


def a06_weighted_median(spark: SparkSession, d: str) -> DataFrame:
    rows = a.mapped(_paf(spark, d)).where("alnlen > 0").withColumn("mid2", F.col("tstart") + F.col("tend"))
    return a.weighted_median(rows, ["qname", "tname"], "mid2", "alnlen", "pos2")


def a05_place_contigs(spark: SparkSession, d: str) -> DataFrame:
    return a.place_contigs(_paf(spark, d))


def a17_status_counts(spark: SparkSession, d: str) -> DataFrame:
    return a.place_contigs(_paf(spark, d)).groupBy("status").agg(F.count(F.lit(1)).alias("n_units"), F.sum("total_aln").alias("aligned_bp"))


def agp1_scaffolds(spark: SparkSession, d: str) -> DataFrame:
    return a.scaffold(a.place_contigs(_paf(spark, d)))


def a16_walked_bp(spark: SparkSession, d: str) -> DataFrame:
    return a.walked_per_target(a.place_contigs(_paf(spark, d)), table(spark, d, "targets"))


def j07_overlap_counts(spark: SparkSession, d: str) -> DataFrame:
    return a.overlap_counts(a.place_contigs(_paf(spark, d)))


def j08_window_votes(spark: SparkSession, d: str) -> DataFrame:
    return a.window_votes(_paf(spark, d))


def w06_dominant_runs(spark: SparkSession, d: str) -> DataFrame:
    return a.dominant_runs(a.window_votes(_paf(spark, d)))


def w14_first_per_pair(spark: SparkSession, d: str) -> DataFrame:
    """The first alignment of each unordered pair of names."""
    pairs = a.mapped(_paf(spark, d)).groupBy(F.least("qname", "tname").alias("name_a"), F.greatest("qname", "tname").alias("name_b"))
    return pairs.agg(F.min("aln_id").alias("aln_id"))


def w07_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chimeras.chunks(_paf(spark, d))


def w08_absorbed(spark: SparkSession, d: str) -> DataFrame:
    return chimeras.absorb_islands(chimeras.chunks(_paf(spark, d)))


def w09_breakpoints(spark: SparkSession, d: str) -> DataFrame:
    return chimeras.breakpoints(_paf(spark, d))


def h19_walk_starts(spark: SparkSession, d: str) -> DataFrame:
    lengths = _paf(spark, d).where("qname is not null").groupBy(F.col("qname").alias("name")).agg(F.max("qlen").alias("length"))
    leaving = g.half_edges(table(spark, d, "links"))
    return a.walk_starts_on_targets(a.query_positions(_paf(spark, d)), lengths, leaving)


QUERIES = {f.__name__: f for f in (
    h19_walk_starts, w07_chunks, w08_absorbed, w09_breakpoints, a03_aligned_bp, a04_assign_contigs, j02_on_assigned_target, j04_queries_without_segment, p03_dovetails, sc15_identity, sc14_organelles, a07_query_positions,
    a06_weighted_median, a05_place_contigs, a17_status_counts, agp1_scaffolds, a16_walked_bp, j07_overlap_counts, j08_window_votes, w06_dominant_runs, w14_first_per_pair,
)}

_ASSIGNED = """
with mapped as (
  select * from paf where qname is not null and tname <> '*'
), sums as (
  select qname, tname, coalesce(sum(qend - qstart), 0) as bp from mapped group by 1, 2
), ranked as (
  select qname, tname, bp, row_number() over (partition by qname order by bp desc, tname) as rn from sums where bp > 0
), tops as (
  select m.qname as contig, coalesce(max(m.qlen), 0) as contig_len from mapped m group by 1
), assigned as (
  select t.contig, t.contig_len, coalesce(a.tname, 'unplaced') as best_chrom, cast(coalesce(a.bp, 0) as bigint) as best_aln_bp,
    case when a.tname is null then '.' else coalesce(b.tname, 'unplaced') end as second_chrom, cast(coalesce(b.bp, 0) as bigint) as second_aln_bp
  from tops t left join ranked a on a.qname = t.contig and a.rn = 1 left join ranked b on b.qname = t.contig and b.rn = 2
), ratios as (
  select *, case when contig_len > 0 then best_aln_bp / contig_len else 0 end as best_frac, case when best_aln_bp > 0 then second_aln_bp / best_aln_bp else 0 end as second_ratio from assigned
)"""
_PLACEMENTS = """
with rows_ as (
  select *, tstart + tend as mid2 from paf where qname is not null and tname <> '*' and alnlen > 0 and tstart is not null and tend is not null
), per as (
  select qname, tname, sum(alnlen) as bases, sum(case when strand = '+' then alnlen else -alnlen end) as turn, min(tstart) as tstart, max(tend) as tend, max(qlen) as qlen from rows_ group by 1, 2
), best as (
  select *, sum(bases) over (partition by qname) as total, max(qlen) over (partition by qname) as clen, row_number() over (partition by qname order by bases desc, tname) as rn from per
), cum as (
  select qname, tname, mid2, sum(alnlen) over (partition by qname, tname order by mid2) as upto, sum(alnlen) over (partition by qname, tname) as whole from rows_
), med as (
  select qname, tname, min(mid2) as pos2 from cum where 2 * upto >= whole group by 1, 2
), placements as (
  select b.qname as unit, b.tname as chrom, case when turn >= 0 then '+' else '-' end as strand, m.pos2, b.tstart, b.tend, round(bases / total, 6) as frac, cast(total as bigint) as total_aln,
    coalesce(clen, 0) as contig_len, case when bases / total < 0.7 or total < 5000 then 'ambiguous' else 'placed' end as status
  from best b join med m using (qname, tname) where rn = 1
)"""
_ORGANELLE = f"(upper({{0}}) in {ORGANELLES} or {' or '.join(f"starts_with(upper({{0}}), '{p}')" for p in ORGANELLE_PREFIXES)})"
_VOTES = """
with recursive parts as (
  select qname, tname, qstart, qend, unnest(range(qstart // 5000, (qend - 1) // 5000 + 1)) as window_no from paf
  where qname is not null and tname <> '*' and qstart >= 0 and qstart < qend and qend <= qlen
), sums as (
  select qname, window_no, tname, cast(sum(least(qend, (window_no + 1) * 5000) - greatest(qstart, window_no * 5000)) as bigint) as votes from parts group by all
), votes_ as (
  select * from sums qualify row_number() over (partition by qname, window_no order by votes desc, tname) = 1
)"""
_CHUNKS = _VOTES + """, changed as (
  select *, case when lag(tname) over (partition by qname order by window_no) = tname then 0 else 1 end as new_ from votes_
), numbered as (
  select *, cast(sum(new_) over (partition by qname order by window_no rows unbounded preceding) as bigint) as run_no from changed
), wholes as (
  select qname, window_no, sum(votes) as whole from sums group by 1, 2
), runs as (
  select n.qname, run_no, n.tname, min(window_no) as first_window, max(window_no) as last_vote, sum(votes) as own, sum(whole) as whole from numbered n join wholes using (qname, window_no) group by 1, 2, 3
), spans as (
  select r.*, first_window * 5000 as cs, least(e.qe, (coalesce(lead(first_window) over (partition by r.qname order by run_no) - 1, last_vote) + 1) * 5000) as ce
  from runs r join (select qname, max(qend) as qe from parts group by 1) e on e.qname = r.qname
), kept as (
  select *, case when lag(tname) over (partition by qname order by run_no) = tname then 0 else 1 end as new_ from spans where ce - cs >= 5000 and own >= 0.5 * whole
), islands as (
  select *, cast(sum(new_) over (partition by qname order by run_no rows unbounded preceding) as bigint) as chunk_no from kept
), chunks_ as (
  select qname, chunk_no, min(cs) as q_start, max(ce) as q_end, tname from islands group by qname, chunk_no, tname
)"""
_ABSORBED = """, rounds(round_, qname, q_start, q_end, tname, going) as (
  select 0, qname, q_start, q_end, tname, true from chunks_
  union all
  select round_ + 1, qname, min(q_start), max(q_end), tname, bool_or(any_left) from (
    select *, sum(new_) over (partition by qname order by q_start rows unbounded preceding) as no from (
      select *, case when lag(tname) over (partition by qname order by q_start) = tname then 0 else 1 end as new_ from (
        select *, bool_or(island) over (partition by qname) as any_left from (
          select *, coalesce(lag(tname) over w = lead(tname) over w and lag(tname) over w <> tname and q_end - q_start < least(lag(q_end - q_start) over w, lead(q_end - q_start) over w), false) as island
          from rounds where going window w as (partition by qname order by q_start)
        )
      ) where not island
    )
  ) group by round_, qname, no, tname
), absorbed as (
  select qname, q_start, q_end, tname from rounds where not going
)"""
SQL = {
    "a03_aligned_bp": "select qname, tname, cast(coalesce(sum(qend - qstart), 0) as bigint) as aligned_bp, count(*) as n_alns from paf where qname is not null and tname <> '*' group by 1, 2",
    "a04_assign_contigs": _ASSIGNED + """
select contig, contig_len, best_chrom, best_aln_bp, round(best_frac, 6) as best_frac, second_chrom, second_aln_bp, round(second_ratio, 6) as second_ratio,
  case when second_aln_bp > 0 and second_ratio >= 0.2 and best_frac < 0.3 then 'CHIMERA,LOW_COVERAGE' when second_aln_bp > 0 and second_ratio >= 0.2 then 'CHIMERA'
    when best_frac < 0.3 then 'LOW_COVERAGE' else 'OK' end as flag from ratios""",
    "j02_on_assigned_target": _ASSIGNED + " select m.aln_id, m.qname, m.tname from mapped m join assigned a on a.contig = m.qname and a.best_chrom = m.tname",
    "j04_queries_without_segment": "select distinct qname from paf where qname is not null and qname not in (select name from segments where name is not null)",
    "p03_dovetails": """
with rows_ as (
  select *, case when alnlen > 0 then coalesce(100.0 * nmatch / alnlen, 0) else 0 end as pct, (qend - qstart + tend - tstart) / 2 as span,
    qstart <= 20000 as ql, qlen - qend <= 20000 as qr, tstart <= 20000 as tl, tlen - tend <= 20000 as tr
  from paf where qname is not null and tname <> '*' and qname <> tname
), kept as (
  select *, case when ql then '5p' else '3p' end as q_end_used, case when tl then '5p' else '3p' end as t_end_used
  from rows_ where pct >= 80 and span >= 300 and ql <> qr and tl <> tr
)
select aln_id, qname as q_contig, q_end_used, tname as t_contig, t_end_used, strand, cast(floor(span) as bigint) as overlap_len, round(pct, 6) as pct_identity,
  case when q_end_used = '5p' then qstart else qlen - qend end as q_trim, case when t_end_used = '5p' then tstart else tlen - tend end as t_trim, q_end_used || '-' || t_end_used as join_type
from kept qualify row_number() over (partition by least(qname, tname), greatest(qname, tname) order by aln_id) = 1""",
    "sc15_identity": "select aln_id, round(case when alnlen > 0 then coalesce(100.0 * nmatch / alnlen, 0) else 0 end, 6) as pct_identity, (qend - qstart + tend - tstart) / 2 as mean_span from paf",
    "sc14_organelles": f"select distinct tname, {_ORGANELLE.format('tname')} as is_organelle from paf where tname is not null",
    "a07_query_positions": """
select qname, tname, min(tstart) as min_start, max(tend) as max_end, cast(coalesce(sum(nmatch), 0) as bigint) as matches,
  case when max(tend) > min(tstart) then round(coalesce(sum(nmatch), 0) / (max(tend) - min(tstart)), 6) else 1.0 end as quality
from paf where qname is not null and tname <> '*' and tstart is not null and tend is not null group by 1, 2""",
    "a06_weighted_median": _PLACEMENTS + " select qname, tname, pos2 from med",
    "a05_place_contigs": _PLACEMENTS + " select * from placements",
    "a17_status_counts": _PLACEMENTS + " select status, count(*) as n_units, cast(sum(total_aln) as bigint) as aligned_bp from placements group by 1",
    "agp1_scaffolds": _PLACEMENTS + f""", kept as (
  select * from placements where not {_ORGANELLE.format('unit')} and contig_len > 0
), lined as (
  select *, row_number() over w - 1 as no, count(*) over (partition by chrom) as of_, coalesce(sum(contig_len + 100) over (partition by chrom order by pos2, unit rows between unbounded preceding and 1 preceding), 0) as off
  from kept where status = 'placed' and not {_ORGANELLE.format('chrom')} window w as (partition by chrom order by pos2, unit)
)
select chrom as object, cast(off + 1 as bigint) as obj_start, cast(off + contig_len as bigint) as obj_end, 2 * no + 1 as part, 'W' as type, unit as component, strand as orient from lined
union all select chrom, cast(off + contig_len + 1 as bigint), cast(off + contig_len + 100 as bigint), 2 * no + 2, 'N', null, null from lined where no + 1 < of_
union all select unit, 1, contig_len, 1, 'W', unit, '+' from kept where status <> 'placed'""",
    "a16_walked_bp": _PLACEMENTS + f""", placed as (
  select * from placements where status = 'placed' and not {_ORGANELLE.format('chrom')}
), flagged as (
  select *, max(tend) over (partition by chrom order by tstart, tend rows between unbounded preceding and 1 preceding) as before from placed where tstart < tend
), numbered as (
  select *, sum(case when before is null or tstart > before then 1 else 0 end) over (partition by chrom order by tstart, tend rows unbounded preceding) as island from flagged
), merged as (
  select chrom, min(tstart) as s, max(tend) as e from numbered group by chrom, island
), per_chrom as (
  select m.chrom, p.n, min(s) as first_, max(e) as last_, sum(e - s) as walked, coalesce(max(t.tlen), 0) as ref_len
  from merged m join (select chrom, count(*) as n from placed group by 1) p using (chrom) left join targets t on t.tname = m.chrom group by m.chrom, p.n
)
select chrom, cast(n as bigint) as placed, first_ + 1 as first_bp, last_ as last_bp, cast(walked as bigint) as walked_bp, cast(ref_len as bigint) as ref_len, case when ref_len > 0 then round(100 * walked / ref_len, 6) else 0 end as pct from per_chrom
union all select 'TOTAL', null, null, null, cast(sum(walked) as bigint), cast(sum(ref_len) as bigint), case when sum(ref_len) > 0 then round(100 * sum(walked) / sum(ref_len), 6) else 0 end from per_chrom""",
    "j07_overlap_counts": _PLACEMENTS + """, placed as (
  select chrom, unit, tstart, tend from placements where status = 'placed' and tstart < tend
)
select a.chrom, a.unit, count(b.unit) as n_overlaps from placed a left join placed b on b.chrom = a.chrom and b.unit <> a.unit and b.tstart < a.tend and b.tend > a.tstart group by 1, 2""",
    "j08_window_votes": _VOTES + " select qname, window_no, tname, votes from votes_",
    "w06_dominant_runs": _VOTES + """, changed as (
  select *, case when lag(tname) over (partition by qname order by window_no) = tname then 0 else 1 end as new_ from votes_
), numbered as (
  select *, sum(new_) over (partition by qname order by window_no rows unbounded preceding) as run_no from changed
), runs as (
  select qname, cast(run_no as bigint) as run_no, tname, min(window_no) as first_window, max(window_no) as last_vote, cast(sum(votes) as bigint) as votes from numbered group by 1, 2, 3
)
select qname, run_no, tname, first_window, coalesce(lead(first_window) over (partition by qname order by run_no) - 1, last_vote) as last_window, votes from runs""",
    "w07_chunks": _CHUNKS + " select qname, chunk_no, q_start, q_end, tname from chunks_",
    "w08_absorbed": _CHUNKS + _ABSORBED + " select qname, q_start, q_end, tname from absorbed",
    "w09_breakpoints": _CHUNKS + _ABSORBED + """, cut as (
  select qname, tname, row_number() over w - 1 as slice_no, count(*) over (partition by qname) as of_,
    coalesce((lag(q_end) over w + q_start) // 2, 0) as slice_start, (q_end + lead(q_start) over w) // 2 as cut_at from absorbed window w as (partition by qname order by q_start)
)
select qname, cast(slice_no as int) as slice_no, cast(slice_start as bigint) as slice_start, cast(coalesce(cut_at, qe) as bigint) as slice_end, tname
from cut join (select qname, max(qend) as qe from parts group by 1) using (qname) where of_ > 1""",
    "h19_walk_starts": """
with pos as (
  select qname, tname, min(tstart) as s, max(tend) as e, case when max(tend) > min(tstart) then round(coalesce(sum(nmatch), 0) / (max(tend) - min(tstart)), 6) else 1.0 end as quality
  from paf where qname is not null and tname <> '*' and tstart is not null and tend is not null group by 1, 2
), lens as (
  select qname, max(qlen) as length from paf where qname is not null group by 1
), ends_ as (
  select from_seg as qname from links where from_seg is not null and to_seg is not null union select to_seg from links where from_seg is not null and to_seg is not null
), marked as (
  select p.*, quality >= 0.3 and e - s <= 2 * coalesce(length, 0) as strict from pos p left join lens using (qname) where p.qname in (from ends_)
)
select tname, qname, s as min_start, strict from marked qualify row_number() over (partition by tname order by case when strict then 0 else 1 end, s, qname) = 1""",
    "w14_first_per_pair": "select least(qname, tname) as name_a, greatest(qname, tname) as name_b, min(aln_id) as aln_id from paf where qname is not null and tname <> '*' group by 1, 2",
}
