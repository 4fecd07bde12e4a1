"""Queries over whole tables for the general data problems, with the SQL they must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators.components import connected_groups
from weftline.operators.faulty import faulty_lines, loaded, parse_lines
from weftline.operators.heavy import heavy_keys, per_key_totals
from weftline.operators.intervals import periods_and_gaps
from weftline.operators.orphans import dangling_ends, orphan_references
from weftline.operators.topn import top_n_per_group
from weftline.sources.tables import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return faulty_lines(parse_lines(table(spark, d, "raw_lines")))


def _loaded(spark: SparkSession, d: str, rec: str) -> DataFrame:
    lines = table(spark, d, "raw_lines").where(F.col("rec") == rec)
    return loaded(parse_lines(lines), rec).withColumn("tags", F.array_join("tags", "\t")).drop("rec")


def p2_loaded_segments(spark: SparkSession, d: str) -> DataFrame:
    return _loaded(spark, d, "S")


def p2_loaded_links(spark: SparkSession, d: str) -> DataFrame:
    return _loaded(spark, d, "L")


def p2_loaded_alignments(spark: SparkSession, d: str) -> DataFrame:
    return _loaded(spark, d, "PAF")


def p2_repairs(spark: SparkSession, d: str) -> DataFrame:
    """The least-cost edits of each line that doesn't load."""
    bad = parse_lines(table(spark, d, "raw_lines")).where("parsed.reason is not null")
    return bad.select("line_id", "parsed.cost", F.array_join("parsed.edits", "; ").alias("edits"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return dangling_ends(table(spark, d, "links"), table(spark, d, "segments")).drop("period")


def p3_by_month(spark: SparkSession, d: str) -> DataFrame:
    ends = dangling_ends(table(spark, d, "links"), table(spark, d, "segments"))
    return ends.groupBy("ref_field", "reason", F.col("period").alias("month")).agg(F.count(F.lit(1)).alias("n_ends"))


def p3_alignment_orphans(spark: SparkSession, d: str) -> DataFrame:
    """Alignments whose assembly and query name (both, or the one that is there) no segment has."""
    refs = table(spark, d, "paf").select("aln_id", "asm_name", "qname")
    return orphan_references(refs, ["asm_name", "qname"], table(spark, d, "segments"), ["asm_name", "name"], "partial").select("aln_id")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    found = None
    for name, key, value in (("segments", "name", "seg_len"), ("edges", "to_node", "overlap_bp")):
        totals = per_key_totals(table(spark, d, name), key, value)
        heavy = heavy_keys(totals).select(F.lit(f"{name}.{key}").alias("field_name"), "key_name")
        found = heavy if found is None else found.unionByName(heavy)
    return found


def p4_segment_totals(spark: SparkSession, d: str) -> DataFrame:
    return per_key_totals(table(spark, d, "segments"), "name", "seg_len")


def p4_edge_totals(spark: SparkSession, d: str) -> DataFrame:
    return per_key_totals(table(spark, d, "edges"), "to_node", "overlap_bp")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "paf").where("tname <> '*' and alnlen >= 1")
    return top_n_per_group(rows, "qname", "alnlen", "tname", "aln_id", 3, ("loaded_at",)).drop("place")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "paf").where("tname <> '*' and tstart >= 0 and tend <= tlen")
    return periods_and_gaps(rows, ["asm_name", "tname"], "tstart", "tend")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return connected_groups(table(spark, d, "links"), "from_seg", "to_seg", table(spark, d, "segments"), "name", "seg_name", "group_name")


QUERIES = {f.__name__: f for f in (
    p1_found, p2_found, p2_loaded_segments, p2_loaded_links, p2_loaded_alignments, p2_repairs, p3_found, p3_by_month, p3_alignment_orphans,
    p4_found, p4_segment_totals, p4_edge_totals, p5_found, p6_found,
)}

# Lines with their fields, where the quoting is sound; every field is followed by a tab here.
_LINES = r"""
with cut as (
  select line_id, rec, case when raw like '%' || chr(13) then left(raw, length(raw) - 1) else raw end as line from raw_lines
), kept as (
  select line_id, rec, line, regexp_full_match(line || chr(9), '(?s)(("([^"]|"")*"|[^"\t]+|)\t)+') as sound
  from cut where line <> '' and not starts_with(line, '#')
), fielded as (
  select *, case rec when 'S' then 3 when 'L' then 6 else 12 end as wanted,
    list_transform(regexp_extract_all(line || chr(9), '(?s)("(?:[^"]|"")*"|[^"\t]+|)\t', 1),
      lambda x: case when starts_with(x, '"') then replace(substr(x, 2, length(x) - 2), '""', '"') else x end) as f
  from kept
), checked as (
  select *,
    len(f) < wanted or len(list_filter(f[wanted + 1:], lambda x: not regexp_full_match(x, '(?s)[A-Za-z][A-Za-z0-9]:[AifZJHB]:.+'))) > 0 as miscounted,
    list_transform(f, lambda x: try_cast(case when regexp_full_match(x, '[0-9]{1,18}') then x end as bigint)) as n
  from fielded
), valued as (
  select *, case
    when rec in ('S', 'L') and f[1] <> rec then 'rec'
    when rec = 'S' then case when not regexp_full_match(f[2], '[!-)+-<>-~][!-~]*') then 'name' when not regexp_full_match(f[3], '\*|[ACGTNacgtn]+') then 'seq' end
    when rec = 'L' then case
      when not regexp_full_match(f[2], '[!-)+-<>-~][!-~]*') then 'from_seg' when f[3] not in ('+', '-') then 'from_orient'
      when not regexp_full_match(f[4], '[!-)+-<>-~][!-~]*') then 'to_seg' when f[5] not in ('+', '-') then 'to_orient'
      when not regexp_full_match(f[6], '\*|([0-9]+[MIDNSHP=X])+') then 'overlap' end
    else case
      when not regexp_full_match(f[1], '[!-)+-<>-~][!-~]*') then 'qname' when n[2] is null then 'qlen' when n[3] is null then 'qstart'
      when n[4] is null or n[3] >= n[4] or n[4] > n[2] then 'qend' when f[5] not in ('+', '-') then 'strand'
      when not regexp_full_match(f[6], '[!-)+-<>-~][!-~]*') then 'tname' when n[7] is null then 'tlen' when n[8] is null then 'tstart'
      when n[9] is null or n[8] >= n[9] or n[9] > n[7] then 'tend' when n[10] is null then 'nmatch'
      when n[11] is null or n[10] > n[11] then 'alnlen' when n[12] is null or n[12] > 255 then 'mapq' end
    end as bad
  from checked
)"""

_ORPHANS = """
with ends as (
  select link_id, loaded_at, 'from_seg' as ref_field, from_seg as name from links where from_seg is not null
  union all select link_id, loaded_at, 'to_seg', to_seg from links where to_seg is not null
), facts as (
  select e.link_id, e.ref_field, e.loaded_at, count(s.seg_id) as n, count(s.seg_id) filter (s.loaded_at <= e.loaded_at) as arrived,
    count(s.seg_id) filter (s.loaded_at <= e.loaded_at and (s.deleted_at is null or s.deleted_at > e.loaded_at)) as valid
  from ends e left join segments s on s.name = e.name group by all
), orphans as (
  select link_id, ref_field, loaded_at, case when n = 0 then 'missing' when arrived = 0 then 'late' else 'deleted' end as reason from facts where valid = 0
)"""

SQL = {
    "p1_found": """
with recursive names as (
  select name as v from segments where name is not null
  union select from_seg from links where from_seg is not null and to_seg is not null
  union select to_seg from links where from_seg is not null and to_seg is not null
), both_ways as (
  select from_seg as a, to_seg as b from links where from_seg is not null and to_seg is not null
  union select to_seg, from_seg from links where from_seg is not null and to_seg is not null
), grouped(v, g) using key (v) as (
  select v, v from names
  union
  select e.b, min(x.g) from grouped x join both_ways e on e.a = x.v join recurring.grouped y on y.v = e.b where x.g < y.g group by e.b
)
select v as seg_name, g as group_name from grouped""",
    "p2_found": _LINES + """
select line_id, case when not sound then 'quoting' when miscounted then 'column_count' else 'bad_value' end as reason,
  case when sound and not miscounted then bad else '' end as bad_field
from valued where not sound or miscounted or bad is not null""",
    "p2_loaded_segments": _LINES + """
select line_id, f[2] as name, f[3] as seq, array_to_string(f[4:], chr(9)) as tags from valued where rec = 'S' and sound and not miscounted and bad is null""",
    "p2_loaded_links": _LINES + """
select line_id, f[2] as from_seg, f[3] as from_orient, f[4] as to_seg, f[5] as to_orient, f[6] as overlap, array_to_string(f[7:], chr(9)) as tags
from valued where rec = 'L' and sound and not miscounted and bad is null""",
    "p2_loaded_alignments": _LINES + """
select line_id, f[1] as qname, n[2] as qlen, n[3] as qstart, n[4] as qend, f[5] as strand, f[6] as tname, n[7] as tlen, n[8] as tstart, n[9] as tend,
  n[10] as nmatch, n[11] as alnlen, n[12] as mapq, array_to_string(f[13:], chr(9)) as tags
from valued where rec = 'PAF' and sound and not miscounted and bad is null""",
    "p3_found": _ORPHANS + " select link_id, ref_field, reason from orphans",
    "p3_by_month": _ORPHANS + " select ref_field, reason, strftime(loaded_at, '%Y-%m') as month, count(*) as n_ends from orphans group by all",
    "p3_alignment_orphans": """
select aln_id from paf p where not (asm_name is null and qname is null) and not exists (
  select 1 from segments s where (p.asm_name is null or s.asm_name = p.asm_name) and (p.qname is null or s.name = p.qname))""",
    "p4_found": """
select 'segments.name' as field_name, name as key_name from segments group by name having name is not null and count(*) >= 0.01 * (select count(*) from segments)
union all
select 'edges.to_node', to_node from edges group by to_node having to_node is not null and count(*) >= 0.01 * (select count(*) from edges)""",
    "p4_segment_totals": "select name as key_name, count(*) as n_rows, cast(coalesce(sum(seg_len), 0) as bigint) as total from segments group by name",
    "p4_edge_totals": "select to_node as key_name, count(*) as n_rows, cast(coalesce(sum(overlap_bp), 0) as bigint) as total from edges group by to_node",
    "p5_found": """
with distinct_rows as (
  select min(aln_id) as aln_id, qname, tname, alnlen from paf
  where qname is not null and tname <> '*' and alnlen >= 1
  group by asm_name, qname, qlen, qstart, qend, strand, tname, tlen, tstart, tend, nmatch, alnlen, mapq, aligned_at
)
select qname, aln_id from distinct_rows qualify row_number() over (partition by qname order by alnlen desc, tname, aln_id) <= 3""",
    "p6_found": """
with valid as (
  select asm_name, tname, tstart as s, tend as e from paf where tname <> '*' and tstart >= 0 and tstart < tend and tend <= tlen
), flagged as (
  select *, max(e) over (partition by asm_name, tname order by s, e rows between unbounded preceding and 1 preceding) as before from valid
), numbered as (
  select *, sum(case when before is null or s > before then 1 else 0 end) over (partition by asm_name, tname order by s, e rows unbounded preceding) as island from flagged
), periods as (
  select asm_name, tname, min(s) as s, max(e) as e from numbered group by asm_name, tname, island
), following as (
  select asm_name, tname, e as gap_start, lead(s) over (partition by asm_name, tname order by s) as gap_end from periods
)
select asm_name, tname, 'period' as kind, s as pos_start, e as pos_end from periods
union all
select asm_name, tname, 'gap', gap_start, gap_end from following where gap_end is not null""",
}
