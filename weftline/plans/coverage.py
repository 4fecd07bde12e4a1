"""Coverage queries: intervals merged, left out, stacked and summarised per target."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import coverage as c
from weftline.sources.tables import table


def _placed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    targets = table(spark, d, "targets")
    return c.on_targets(table(spark, d, "paf"), targets), targets


def w01_interval_merge(spark: SparkSession, d: str) -> DataFrame:
    return c.covered(_placed(spark, d)[0])


def w02_complement(spark: SparkSession, d: str) -> DataFrame:
    return c.uncovered(*_placed(spark, d))


def w03_long_gaps(spark: SparkSession, d: str) -> DataFrame:
    gaps = c.uncovered(*_placed(spark, d))
    return gaps.withColumn("gap_bp", F.col("pos_end") - F.col("pos_start")).where("gap_bp >= 1000")


def w04_depth_profile(spark: SparkSession, d: str) -> DataFrame:
    return c.depth_profile(*_placed(spark, d))


def w05_deep_stretches(spark: SparkSession, d: str) -> DataFrame:
    return c.depth_profile(*_placed(spark, d)).where("depth >= 2 and pos_end - pos_start >= 100")


def a14_coverage_summary(spark: SparkSession, d: str) -> DataFrame:
    return c.coverage_summary(*_placed(spark, d))


def a15_coverage_totals(spark: SparkSession, d: str) -> DataFrame:
    return c.coverage_totals(c.coverage_summary(*_placed(spark, d)))


QUERIES = {f.__name__: f for f in (w01_interval_merge, w02_complement, w03_long_gaps, w04_depth_profile, w05_deep_stretches, a14_coverage_summary, a15_coverage_totals)}

_PLACED = """
with placed as (
  select p.tname, p.tstart as s, least(p.tend, t.tlen) as e from paf p join targets t using (tname)
  where p.tstart >= 0 and p.tstart < p.tend and p.tstart < t.tlen
), flagged as (
  select *, max(e) over (partition by tname order by s, e rows between unbounded preceding and 1 preceding) as before from placed
), numbered as (
  select *, sum(case when before is null or s > before then 1 else 0 end) over (partition by tname order by s, e rows unbounded preceding) as island from flagged
), merged as (
  select tname, min(s) as s, max(e) as e from numbered group by tname, island
), bounds as (
  select tname, e as gs, lead(s) over (partition by tname order by s) as ge from merged
  union all select tname, 0, min(s) from merged group by tname
  union all select tname, max(e), null from merged group by tname
  union all select tname, 0, tlen from targets where tname not in (select tname from merged)
), gaps as (
  select distinct b.tname, b.gs, coalesce(b.ge, t.tlen) as ge from bounds b join targets t using (tname) where b.gs < coalesce(b.ge, t.tlen)
), changes as (
  select tname, pos, sum(d) as d, max(rim) as rim from (
    select tname, s as pos, 1 as d, 0 as rim from placed union all select tname, e, -1, 0 from placed
    union all select tname, 0, 0, 1 from targets union all select tname, tlen, 0, 1 from targets)
  group by tname, pos having sum(d) <> 0 or max(rim) = 1
), profile as (
  select tname, pos, lead(pos) over (partition by tname order by pos) as next_pos, sum(d) over (partition by tname order by pos rows unbounded preceding) as depth from changes
), depths as (
  select tname, pos, next_pos, cast(depth as bigint) as depth from profile where next_pos is not null
)"""
_SUMMARY = _PLACED + """, summary as (
  select t.tname as chrom, t.tlen as chrom_len, cast(coalesce(m.bp, 0) as bigint) as covered_bp, cast(t.tlen - coalesce(m.bp, 0) as bigint) as uncovered_bp,
    round(100.0 * coalesce(m.bp, 0) / t.tlen, 6) as pct_covered, coalesce(g.n, 0) as n_gaps_filt, coalesce(g.top, 0) as largest_gap,
    round(coalesce(d.total, 0) / t.tlen, 6) as mean_depth, coalesce(d.top, 0) as max_depth, cast(coalesce(d.deep, 0) as bigint) as bp_depth_ge2,
    round(100.0 * coalesce(d.deep, 0) / t.tlen, 6) as pct_depth_ge2
  from targets t
  left join (select tname, sum(e - s) as bp from merged group by 1) m using (tname)
  left join (select tname, count(*) as n, max(ge - gs) as top from gaps where ge - gs >= 1000 group by 1) g using (tname)
  left join (select tname, sum(depth * (next_pos - pos)) as total, max(depth) as top, sum(case when depth >= 2 then next_pos - pos else 0 end) as deep from depths group by 1) d using (tname)
)"""
SQL = {
    "w01_interval_merge": _PLACED + " select tname, s as pos_start, e as pos_end from merged",
    "w02_complement": _PLACED + " select tname, gs as pos_start, ge as pos_end from gaps",
    "w03_long_gaps": _PLACED + " select tname, gs as pos_start, ge as pos_end, ge - gs as gap_bp from gaps where ge - gs >= 1000",
    "w04_depth_profile": _PLACED + " select tname, pos as pos_start, next_pos as pos_end, depth from depths",
    "w05_deep_stretches": _PLACED + " select tname, pos as pos_start, next_pos as pos_end, depth from depths where depth >= 2 and next_pos - pos >= 100",
    "a14_coverage_summary": _SUMMARY + " select * from summary",
    "a15_coverage_totals": _SUMMARY + """ select cast(sum(chrom_len) as bigint) as ref_bp, cast(sum(covered_bp) as bigint) as covered_bp,
      cast(sum(uncovered_bp) as bigint) as uncovered_bp, cast(sum(n_gaps_filt) as bigint) as n_gaps, cast(sum(bp_depth_ge2) as bigint) as bp_depth_ge2, max(max_depth) as max_depth from summary""",
}
