"""k-mer queries over segments; sequences of lines not yet loaded stand for the reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.sequences import without_depth_tags
from weftline.operators import extensions as x
from weftline.operators import graph as g
from weftline.operators import kmers as k
from weftline.operators.faulty import loaded, parse_lines
from weftline.operators.skew import lookup
from weftline.session import written
from weftline.sources.tables import table

#: The reference recommends 29.
K = 29


def k01_segment_records(spark: SparkSession, d: str) -> DataFrame:
    return k.segment_records(table(spark, d, "segments"), 21)


def k04_canonical_kmers(spark: SparkSession, d: str) -> DataFrame:
    return k.kmer_counts(table(spark, d, "segments"), "seq", K)


def _reads(spark: SparkSession, d: str) -> DataFrame:
    return loaded(parse_lines(table(spark, d, "raw_lines").where("rec = 'S'")), "S").select("seq", F.lit(1).alias("n"))


def j06_kmers_with_reads(spark: SparkSession, d: str) -> DataFrame:
    positions = k.kmer_counts(table(spark, d, "segments"), "seq", K)
    reads = k.kmer_counts(_reads(spark, d), "seq", K).withColumnRenamed("n", "reads")
    return positions.join(reads, "kmer", "left").na.fill(0, ["reads"]).select("kmer", F.col("n").alias("positions"), "reads")


def a13_node_depths(spark: SparkSession, d: str) -> DataFrame:
    return k.node_depths(table(spark, d, "segments"), _reads(spark, d), K)


def k05_annotated_tags(spark: SparkSession, d: str) -> DataFrame:
    """Every declaration's tags with those of an earlier annotation replaced."""
    depths = written(k.node_depths(table(spark, d, "segments"), _reads(spark, d), K)).hint("merge")
    new = F.format_string("KC:i:%d\tDP:f:%.4f\tad:f:%.4f\tkn:i:%d", "kc", "dp", "ad", "kn")
    segments = table(spark, d, "segments").where("name is not null").select("seg_id", "name", "tags")
    tagged = lookup(segments, "name", depths.select("name", new.alias("depth_tags")), "depth_tags", F.col("seg_id"))
    kept = without_depth_tags("tags")
    return tagged.select("seg_id", F.concat(F.when(kept != "", F.concat(kept, F.lit("\t"))).otherwise(""), "depth_tags").alias("tags"))


def _steps(spark: SparkSession, d: str) -> DataFrame:
    return g.outgoing_steps(g.half_edges(table(spark, d, "links")))


def k02_forward_extensions(spark: SparkSession, d: str) -> DataFrame:
    return x.forward_extensions(_steps(spark, d), x.kept_sequences(table(spark, d, "segments")), K - 1)


def k03_crossing_records(spark: SparkSession, d: str) -> DataFrame:
    return x.crossing_records(_steps(spark, d), x.kept_sequences(table(spark, d, "segments")), K)


def h17_link_sequences(spark: SparkSession, d: str) -> DataFrame:
    return x.link_sequences(table(spark, d, "links"), x.kept_sequences(table(spark, d, "segments")))


QUERIES = {f.__name__: f for f in (k02_forward_extensions, k03_crossing_records, h17_link_sequences, k01_segment_records, k04_canonical_kmers, j06_kmers_with_reads, a13_node_depths, k05_annotated_tags)}

_KMERS = """
with pos as (
  select name, upper(substr(seq, i, {K})) as u from (select name, seq, unnest(range(1, length(seq) - {K} + 2)) as i from segments where seq <> '*' and length(seq) >= {K})
), canon as (
  select name, least(u, reverse(translate(u, 'ACGT', 'TGCA'))) as kmer from pos
), read_lines as (
  select regexp_extract_all(line || chr(9), '(?s)("(?:[^"]|"")*"|[^"\\t]+|)\\t', 1) as f
  from (select case when raw like '%' || chr(13) then left(raw, length(raw) - 1) else raw end as line from raw_lines where rec = 'S')
  where line <> '' and not starts_with(line, '#') and regexp_full_match(line || chr(9), '(?s)(("([^"]|"")*"|[^"\\t]+|)\\t)+')
), read_fields as (
  select list_transform(f, lambda x: case when starts_with(x, '"') then replace(substr(x, 2, length(x) - 2), '""', '"') else x end) as f from read_lines
), read_seqs as (
  select f[3] as seq from read_fields where f[1] = 'S' and regexp_full_match(f[2], '[!-)+-<>-~][!-~]*') and regexp_full_match(f[3], '[ACGTNacgtn]+')
    and len(list_filter(f[4:], lambda x: not regexp_full_match(x, '(?s)[A-Za-z][A-Za-z0-9]:[AifZJHB]:.+'))) = 0
), read_pos as (
  select upper(substr(seq, i, {K})) as u from (select seq, unnest(range(1, length(seq) - {K} + 2)) as i from read_seqs where length(seq) >= {K})
), reads as (
  select least(u, reverse(translate(u, 'ACGT', 'TGCA'))) as kmer, count(*) as n from read_pos group by 1
), per_kmer as (
  select kmer, count(*) as n from canon group by 1
), given as (
  select c.name, coalesce(r.n, 0) / p.n as share from canon c join per_kmer p using (kmer) left join reads r using (kmer)
), depths as (
  select s.name, cast(round_even(round(coalesce(sum(share), 0), 6), 0) as bigint) as kc, round(coalesce(median(share), 0), 4) as dp, round(coalesce(avg(share), 0), 4) as ad, count(share) as kn
  from (select distinct name from segments where name is not null) s left join given g on g.name = s.name group by 1
)""".replace("{K}", str(K))
_REVERSED = "reverse(translate({0}, 'ACGT', 'TGCA'))"
_EXTENSIONS = f"""
with recursive seqs as (
  select name, upper(arg_min(seq, seg_id)) as seq from segments where name is not null and seq <> '*' and seq <> '' group by 1
), steps as (
  select distinct from_seg as node, case when from_orient = '-' then '-' else '+' end as orient, to_seg as to_node, case when to_orient = '-' then '-' else '+' end as to_orient from links where from_seg is not null and to_seg is not null
  union
  select to_seg, case when to_orient = '-' then '+' else '-' end, from_seg, case when from_orient = '-' then '+' else '-' end from links where from_seg is not null and to_seg is not null
), arcs as (
  select node, orient, to_node, to_orient, case when to_orient = '-' then {_REVERSED.format('seq')} else seq end as bases from steps join seqs on name = to_node
), grown(node, orient, here, here_orient, ext) as (
  select node, orient, to_node, to_orient, left(bases, {K - 1}) from arcs
  union
  select g.node, g.orient, a.to_node, a.to_orient, left(g.ext || a.bases, {K - 1}) from grown g join arcs a on a.node = g.here and a.orient = g.here_orient where length(ext) < {K - 1}
), extensions as (
  select distinct node, orient, ext from grown g where length(ext) = {K - 1} or not exists (select 1 from arcs a where a.node = g.here and a.orient = g.here_orient)
)"""
SQL = {
    "k02_forward_extensions": _EXTENSIONS + " select node, orient, ext from extensions",
    "k03_crossing_records": _EXTENSIONS + f"""
select node, orient, right(case when orient = '-' then {_REVERSED.format('seq')} else seq end, {K - 1}) || ext as record from extensions join seqs on name = node
where length(right(seq, {K - 1})) + length(ext) >= {K}""",
    "h17_link_sequences": f"""
with seqs as (
  select name, upper(arg_min(seq, seg_id)) as seq from segments where name is not null and seq <> '*' and seq <> '' group by 1
), pairs as (
  select link_id, coalesce(list_sum(list_transform(regexp_extract_all(coalesce(overlap, ''), '([0-9]+)[M=XID]', 1), lambda x: cast(x as bigint))), 0) as ov,
    case when from_orient = '-' then {_REVERSED.format('a.seq')} else a.seq end as s, case when to_orient = '-' then {_REVERSED.format('b.seq')} else b.seq end as t
  from links join seqs a on a.name = from_seg join seqs b on b.name = to_seg
)
select link_id, s || case when ov < length(t) then substr(t, cast(ov as bigint) + 1) else '' end as sequence from pairs""",
    "k01_segment_records": "select seg_id, name, seq, length(seq) - 20 as n_kmers from segments where seq <> '*' and length(seq) >= 21",
    "k04_canonical_kmers": _KMERS + " select kmer, n from per_kmer",
    "j06_kmers_with_reads": _KMERS + " select p.kmer, p.n as positions, coalesce(r.n, 0) as reads from per_kmer p left join reads r using (kmer)",
    "a13_node_depths": _KMERS + " select * from depths",
    "k05_annotated_tags": _KMERS + """, kept as (
  select seg_id, name, array_to_string(list_filter(string_split(coalesce(tags, ''), chr(9)), lambda t: t <> '' and split_part(t, ':', 1) not in ('KC', 'DP', 'dp', 'ad', 'kn')), chr(9)) as k
  from segments where name is not null
)
select seg_id, case when k <> '' then k || chr(9) else '' end || printf('KC:i:%d	DP:f:%.4f	ad:f:%.4f	kn:i:%d', kc, dp, ad, kn) as tags from kept join depths using (name)""",
}
