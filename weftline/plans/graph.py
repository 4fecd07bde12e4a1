"""Graph queries over segments, links and dumped half-edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import sequences as s
from weftline.operators import extensions as x
from weftline.operators import graph as g
from weftline.operators import spines as sp
from weftline.operators import walks as w
from weftline.operators.components import connected_groups
from weftline.session import written
from weftline.sources import text_formats as t
from weftline.sources.tables import table


def sc01_overlap_length(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "links").select("link_id", s.overlap_length("overlap").alias("overlap_bp"))


def sc02_link_sides(spark: SparkSession, d: str) -> DataFrame:
    links = table(spark, d, "links")
    out, in_ = s.exit_side("from_orient"), s.entry_side("to_orient")
    return links.select("link_id", out.alias("exit_side"), in_.alias("entry_side"), s.orient_of_exit(out).alias("orient"), s.flip("to_orient").alias("flipped"))


def sc05_reverse_complement(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "segments").where("seq <> '*'").select("seg_id", s.reverse_complement("seq").alias("kept"), s.reverse_complement("seq", True).alias("masked"))


def sc10_canonical_links(spark: SparkSession, d: str) -> DataFrame:
    return g.canonical_links(table(spark, d, "links"))


def sc12_walks(spark: SparkSession, d: str) -> DataFrame:
    step = lambda n, o: F.struct(F.col(n).alias("name"), F.col(o).alias("orient"))
    steps = F.array(step("from_seg", "from_orient"), step("to_seg", "to_orient"))
    return g.whole_links(table(spark, d, "links")).select("link_id", s.walk_string(steps).alias("walk"), s.path_string(steps).alias("path"))


def sc13_walk_names(spark: SparkSession, d: str) -> DataFrame:
    names = sc12_walks(spark, d).select("link_id", F.posexplode(s.names_of_walk("walk")).alias("step_no", "name"))
    return names


def sc16_kept_tags(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "segments").select("seg_id", s.without_depth_tags("tags").alias("kept_tags"))


def sc19_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return g.half_edges(table(spark, d, "links")).select("node", "to_node").distinct()


def g12_half_edges(spark: SparkSession, d: str) -> DataFrame:
    return g.half_edges(table(spark, d, "links"))


def a08_side_degrees(spark: SparkSession, d: str) -> DataFrame:
    return g.side_degrees(g.half_edges(table(spark, d, "links"))).drop("least", "greatest")


def a09_neighbour_counts(spark: SparkSession, d: str) -> DataFrame:
    return g.neighbour_counts(table(spark, d, "edges").where("node is not null and to_node is not null"))


def g04_tips(spark: SparkSession, d: str) -> DataFrame:
    return g.tips(g.half_edges(table(spark, d, "links")), table(spark, d, "segments"))


def a10_bubble_members(spark: SparkSession, d: str) -> DataFrame:
    return g.bubble_members(g.half_edges(table(spark, d, "links")), table(spark, d, "segments"))


def a11_visit_budgets(spark: SparkSession, d: str) -> DataFrame:
    aligned = table(spark, d, "paf").where("qname is not null and tname <> '*'")
    return g.visit_budgets(g.half_edges(table(spark, d, "links")), table(spark, d, "segments"), aligned)


def a01_component_summary(spark: SparkSession, d: str) -> DataFrame:
    return g.component_summary(table(spark, d, "links"), table(spark, d, "segments"))


def g03_routed_links(spark: SparkSession, d: str) -> DataFrame:
    links = table(spark, d, "links")
    groups = connected_groups(links, "from_seg", "to_seg", table(spark, d, "segments"), "name", "name", "component")
    return g.route_links(links, groups).select("link_id", "component")


def u03_missing_reverse(spark: SparkSession, d: str) -> DataFrame:
    return g.missing_reverse(table(spark, d, "edges"))


def u01_names_on_one_side(spark: SparkSession, d: str) -> DataFrame:
    """Symmetric difference of the names that segments declare and that links use."""
    declared = table(spark, d, "segments").where("name is not null").select("name").distinct().withColumn("declared", F.lit(1))
    used = g.whole_links(table(spark, d, "links")).select(F.explode(F.array("from_seg", "to_seg")).alias("name")).distinct().withColumn("used", F.lit(1))
    both = declared.join(used, "name", "full").where("declared is null or used is null")
    return both.select("name", F.when(F.col("used").isNull(), "segments").otherwise("links").alias("only_in"))


def g22_dumped_without_link(spark: SparkSession, d: str) -> DataFrame:
    """Dumped half-edges that no link states: steps over them are invalid."""
    cols = ["node", "exit_side", "to_node", "to_side"]
    dumped = table(spark, d, "edges").where("node is not null and to_node is not null").select(*cols).distinct()
    return dumped.join(g.half_edges(table(spark, d, "links")).select(*cols).distinct(), cols, "left_anti")


def g20_steps(spark: SparkSession, d: str) -> DataFrame:
    return g.outgoing_steps(g.half_edges(table(spark, d, "links")))


def g17_layers_from_tips(spark: SparkSession, d: str) -> DataFrame:
    edges = g.half_edges(table(spark, d, "links"))
    return g.layers(edges, g.tips(edges, table(spark, d, "segments")))


def j03_links_between_segments(spark: SparkSession, d: str) -> DataFrame:
    """Links of which both ends are declared."""
    names = table(spark, d, "segments").where("name is not null").select("name").distinct()
    links = g.whole_links(table(spark, d, "links"))
    for end in ("from_seg", "to_seg"):
        links = links.join(names.withColumnRenamed("name", end), end, "left_semi")
    return links.select("link_id")


#: Walks per component. None is cut; each goes to its dead end.
TRIALS, SEED = 64, 0xC0FFEE


def _groups(spark: SparkSession, d: str) -> DataFrame:
    return written(connected_groups(table(spark, d, "links"), "from_seg", "to_seg", table(spark, d, "segments"), "name", "name", "component"))


def _walks(spark: SparkSession, d: str, groups: DataFrame) -> DataFrame:
    links, segments = table(spark, d, "links"), table(spark, d, "segments")
    starts = w.walk_starts(g.half_edges(links), segments, groups)
    return w.candidate_walks(w.walk_steps(links), starts, groups, g.segment_lengths(segments), TRIALS, SEED)


def _pairs(spark: SparkSession, d: str, walks: DataFrame) -> DataFrame:
    return w.best_pairs(walks, g.segment_lengths(table(spark, d, "segments")))


def _paired_walks(walks: DataFrame, pairs: DataFrame) -> DataFrame:
    """The steps of both walks of each pair under ``trial`` 1 and 2."""
    both = written(pairs).select("component", F.explode(F.array(F.struct(F.lit(1).alias("hap"), F.col("first_trial").alias("trial")), F.struct(F.lit(2).alias("hap"), F.coalesce("second_trial", "first_trial").alias("trial")))).alias("x"))
    return walks.join(both.select("component", "x.*"), ["component", "trial"]).drop("trial").withColumnRenamed("hap", "trial")


def h02_walk_starts(spark: SparkSession, d: str) -> DataFrame:
    return w.walk_starts(g.half_edges(table(spark, d, "links")), table(spark, d, "segments"), _groups(spark, d))


def h04_candidate_walks(spark: SparkSession, d: str) -> DataFrame:
    return _walks(spark, d, _groups(spark, d)).select("component", "trial", "step", "node", "orient", "length_bp")


def sc18_walk_facts(spark: SparkSession, d: str) -> DataFrame:
    """Of each walk: its length less overlaps, its steps, distinct nodes and revisits."""
    walks = _walks(spark, d, _groups(spark, d)).groupBy("component", "trial").agg(F.max_by("length_bp", "step").alias("length_bp"), F.count(F.lit(1)).alias("n_steps"), F.countDistinct("node").alias("n_nodes"))
    return walks.withColumn("revisits", F.col("n_steps") - F.col("n_nodes"))


def h06_best_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d, _walks(spark, d, _groups(spark, d)))


def snk06_walk_summary(spark: SparkSession, d: str) -> DataFrame:
    groups = _groups(spark, d)
    return w.walk_summary(_pairs(spark, d, _walks(spark, d, groups)), groups, g.segment_lengths(table(spark, d, "segments")))


def snk03_path_lines(spark: SparkSession, d: str) -> DataFrame:
    """The P lines of the two walks of each component."""
    walks = _walks(spark, d, _groups(spark, d))
    lines = w.walk_lines(_paired_walks(walks, _pairs(spark, d, walks)))
    name = F.concat("component", F.lit("_hap"), F.col("trial").cast("string"))
    return lines.select("component", F.col("trial").alias("hap"), F.concat_ws("\t", F.lit("P"), name, "names", "overlaps").alias("line"), "walk")


def h17_walk_sequences(spark: SparkSession, d: str) -> DataFrame:
    walks = _walks(spark, d, _groups(spark, d))
    kept = x.kept_sequences(table(spark, d, "segments"))
    return w.walk_sequences(_paired_walks(walks, _pairs(spark, d, walks)), kept).withColumnRenamed("trial", "hap")


#: Bases above which a path is kept; the segments here are short.
LONG_PATH = 500


def w19_long_paths(spark: SparkSession, d: str) -> DataFrame:
    """Paths of more than LONG_PATH bases."""
    walks = _walks(spark, d, _groups(spark, d))
    whole = _paired_walks(walks, _pairs(spark, d, walks)).groupBy("component", F.col("trial").alias("hap")).agg(F.max_by("length_bp", "step").alias("length_bp"))
    return whole.where(F.col("length_bp") > LONG_PATH)


def snk03_graph_lines(spark: SparkSession, d: str) -> DataFrame:
    """The lines of a graph file of all declarations and whole links."""
    segments, links = table(spark, d, "segments"), g.whole_links(table(spark, d, "links"))
    lines = segments.select(F.lit("S").alias("rec"), F.col("seg_id").alias("id"), t.segment_lines(segments).alias("line"))
    return lines.unionByName(links.select(F.lit("L").alias("rec"), F.col("link_id").alias("id"), t.link_lines(links).alias("line")))


def snk04_stripped_segments(spark: SparkSession, d: str) -> DataFrame:
    segments = table(spark, d, "segments")
    return segments.select("seg_id", t.segment_lines(segments, False).alias("line"))


def snk05_fasta(spark: SparkSession, d: str) -> DataFrame:
    kept = table(spark, d, "segments").where("name is not null and seq <> '*'")
    return t.fasta_records(kept, "name", "seq", 60).withColumnRenamed("value", "record")


def _spines(spark: SparkSession, d: str, groups: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    links, segments = table(spark, d, "links"), table(spark, d, "segments")
    edges = written(g.half_edges(links))
    return edges, written(sp.spine_ends(edges, segments, _groups(spark, d) if groups is None else groups, g.segment_lengths(segments)))


def g07_spine_ends(spark: SparkSession, d: str) -> DataFrame:
    return _spines(spark, d)[1]


def g16_bubble_regions(spark: SparkSession, d: str) -> DataFrame:
    edges, ends = _spines(spark, d)
    return sp.bubble_regions(table(spark, d, "links"), edges, table(spark, d, "segments"), ends)


def g18_layered_edges(spark: SparkSession, d: str) -> DataFrame:
    edges = written(g.half_edges(table(spark, d, "links")))
    return sp.layered_edges(edges, g.layers(edges, g.tips(edges, table(spark, d, "segments"))))


def a20_component_tips(spark: SparkSession, d: str) -> DataFrame:
    """Components by how many tips they have, with their segments and tips in all."""
    links, segments = table(spark, d, "links"), table(spark, d, "segments")
    groups = connected_groups(links, "from_seg", "to_seg", segments, "name", "node", "component")
    tips = g.tips(g.half_edges(links), segments).select("node", F.lit(1).alias("tip"))
    per = groups.join(tips, "node", "left").groupBy("component").agg(F.count(F.lit(1)).alias("n_segments"), F.count("tip").alias("n_tips"))
    return per.groupBy("n_tips").agg(F.count(F.lit(1)).alias("n_components"), F.sum("n_segments").alias("n_segments"))


QUERIES = {f.__name__: f for f in (
    g07_spine_ends, g16_bubble_regions, g18_layered_edges, a20_component_tips, snk03_graph_lines, snk04_stripped_segments, snk05_fasta, h02_walk_starts, h04_candidate_walks, h06_best_pairs, sc18_walk_facts, snk06_walk_summary, snk03_path_lines, h17_walk_sequences, w19_long_paths, sc01_overlap_length, sc02_link_sides, sc05_reverse_complement, sc10_canonical_links, sc12_walks, sc13_walk_names, sc16_kept_tags, sc19_neighbours, g12_half_edges,
    a08_side_degrees, a09_neighbour_counts, g04_tips, a10_bubble_members, a11_visit_budgets, a01_component_summary, g03_routed_links, u03_missing_reverse, u01_names_on_one_side,
    g22_dumped_without_link, g20_steps, g17_layers_from_tips, j03_links_between_segments,
)}

_OVERLAP = "coalesce(list_sum(list_transform(regexp_extract_all(coalesce(overlap, ''), '([0-9]+)[M=XID]', 1), lambda x: cast(x as bigint))), 0)"
_HALF = f"""
with half as (
  select from_seg as node, case when from_orient = '-' then 0 else 1 end as exit_side, to_seg as to_node, case when to_orient = '-' then 1 else 0 end as to_side, cast({_OVERLAP} as bigint) as overlap_bp, link_id
  from links where from_seg is not null and to_seg is not null
  union all
  select to_seg, case when to_orient = '-' then 1 else 0 end, from_seg, case when from_orient = '-' then 0 else 1 end, cast({_OVERLAP} as bigint), link_id
  from links where from_seg is not null and to_seg is not null
), names as (
  select distinct name as node from segments where name is not null
), nbr as (
  select node, count(distinct to_node) as n_neighbours, min(to_node) as least_, max(to_node) as greatest_ from half where node <> to_node group by 1
), tip as (
  select node, 1 - min(exit_side) as open_side from half where node in (from names) and to_node in (from names) group by 1 having min(exit_side) = max(exit_side)
), two as (
  select * from nbr where n_neighbours = 2 and node in (from names)
), bub as (
  select node, least_ as end_a, greatest_ as end_b, count(*) over (partition by least_, greatest_) as n_arms from two
)"""
_GROUPS = """
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
)"""
_STARTS = _GROUPS + """, half as (
  select from_seg as node, case when from_orient = '-' then 0 else 1 end as exit_side, to_seg as to_node, case when to_orient = '-' then 1 else 0 end as to_side from links where from_seg is not null and to_seg is not null
  union
  select to_seg, case when to_orient = '-' then 1 else 0 end, from_seg, case when from_orient = '-' then 0 else 1 end from links where from_seg is not null and to_seg is not null
), sides as (
  select v as node, g as component, min(exit_side) as low, max(exit_side) as high from grouped left join half on node = v group by 1, 2
), any_start as (
  select component, node, coalesce(low, 1) as side, 0 as kind from sides where low is null or low = high
  union all select component, node, unnest([0, 1]), 1 from sides where low < high
), placed as (
  select *, row_number() over (partition by component order by kind, node, side) as place, min(kind) over (partition by component) as first_kind from any_start
), starts as (
  select component, cast(place - 1 as int) as place, node, case when side = 1 then '+' else '-' end as orient from placed where kind = first_kind
)"""
_WALKS = _STARTS + f""", lens as (
  select name, max(coalesce(seg_len, 0)) as length from segments where name is not null group by 1
), stated as (
  select link_id, from_seg as node, case when from_orient = '-' then '-' else '+' end as orient, to_seg as to_node, case when to_orient = '-' then '-' else '+' end as to_orient, overlap
  from links where from_seg is not null and to_seg is not null
  union all select link_id, to_seg, case when to_orient = '-' then '+' else '-' end, from_seg, case when from_orient = '-' then '+' else '-' end, overlap
  from links where from_seg is not null and to_seg is not null
), steps as (
  select f.*, cast({_OVERLAP} as bigint) as overlap_bp, coalesce(length, 0) as length
  from (select * from stated qualify row_number() over (partition by node, orient, to_node, to_orient order by link_id) = 1) f left join lens on name = to_node
), turns as (
  select component, t as trial, t % n as place from (select component, count(*) as n from starts group by 1), (select unnest(range(0, {TRIALS})) as t)
), going(component, trial, step, node, orient, overlap, length_bp, nodes, again) as (
  select component, cast(trial as int), 0, node, orient, cast(null as varchar), cast(coalesce(length, 0) as bigint), [node], [0, 1, 3, 8][trial % 4 + 1] from turns join starts using (component, place) left join lens on name = node
  union all
  (select w.component, w.trial, w.step + 1, s.to_node, s.to_orient, s.overlap, cast(greatest(w.length_bp + s.length - s.overlap_bp, 0) as bigint), list_append(w.nodes, s.to_node), w.again - cast(list_contains(w.nodes, s.to_node) as int)
  from going w join steps s on s.node = w.node and s.orient = w.orient where not list_contains(w.nodes, s.to_node) or w.again > 0
  qualify row_number() over (partition by w.component, w.trial order by list_contains(w.nodes, s.to_node), md5(concat_ws('|', '{SEED}', w.trial, w.step + 1, s.to_node, s.to_orient)), s.to_node, s.to_orient) = 1)
), walks as (
  select *, len(nodes) as n_steps, len(list_distinct(nodes)) as n_nodes from going qualify row_number() over (partition by component, trial order by step desc) = 1
)"""
_PAIRS = _WALKS + """, uniq as (
  select * from walks qualify row_number() over (partition by component, list_sort(nodes) order by trial) = 1
), lead_ as (
  select * from uniq qualify row_number() over (partition by component order by length_bp desc, trial) = 1
), other as (
  select u.component, u.trial, u.length_bp, u.n_steps - u.n_nodes as revisits, u.length_bp between round(0.9 * l.length_bp) and round(1.1 * l.length_bp) as near, u.nodes as own, l.nodes as lead_nodes from uniq u join lead_ l using (component) where u.trial <> l.trial
), parts as (
  select component, trial, length_bp, revisits, near, unnest(list_distinct(list_concat(own, lead_nodes))) as name, own, lead_nodes from other
), scores as (
  select component, trial, length_bp, revisits, near, sum(coalesce(length, 0)) as u, sum(case when list_contains(own, name) and list_contains(lead_nodes, name) then 0 else coalesce(length, 0) end) as sd, count(*) as covered
  from parts left join lens using (name) group by 1, 2, 3, 4, 5
), best as (
  select * from scores qualify row_number() over (partition by component order by near desc, u desc, sd desc, revisits, length_bp desc, trial) = 1
), lead_bp as (
  select component, sum(coalesce(length, 0)) as bp from (select component, unnest(list_distinct(nodes)) as name from lead_) left join lens using (name) group by 1
), pairs_ as (
  select l.component, l.trial as first_trial, l.length_bp as first_bp, b.trial as second_trial, b.length_bp as second_bp, cast(coalesce(b.u, p.bp) as bigint) as union_bp, cast(coalesce(b.sd, 0) as bigint) as symdiff_bp,
    l.n_steps - l.n_nodes + coalesce(b.revisits, l.n_steps - l.n_nodes) as revisits, coalesce(b.covered, l.n_nodes) as nodes_covered
  from lead_ l join lead_bp p using (component) left join best b using (component)
), paired as (
  select p.component, 1 as hap, step, node, orient, overlap, length_bp from pairs_ p join going g on g.component = p.component and g.trial = p.first_trial
  union all select p.component, 2, step, node, orient, overlap, length_bp from pairs_ p join going g on g.component = p.component and g.trial = coalesce(p.second_trial, p.first_trial)
)"""
_SPINES = _GROUPS + """, names_ as (
  select distinct name as node from segments where name is not null
), half as (
  select from_seg as node, case when from_orient = '-' then 0 else 1 end as exit_side, to_seg as to_node from links where from_seg is not null and to_seg is not null
  union all select to_seg, case when to_orient = '-' then 1 else 0 end, from_seg from links where from_seg is not null and to_seg is not null
), tip as (
  select h.node, g as component from half h join grouped on v = h.node where h.node in (from names_) and to_node in (from names_) group by 1, 2 having min(exit_side) = max(exit_side)
), lens as (
  select name, max(coalesce(seg_len, 0)) as length from segments where name is not null group by 1
), pairs as (
  select distinct node, to_node, coalesce(length, 0) as step from half left join lens on name = to_node where node <> to_node
), first_ as (
  select component, count(*) as n_tips from tip group by 1 having count(*) > 1
), sweep(source, node, bp) using key (source, node) as (
  select t.node, t.node, coalesce(length, 0) from tip t join first_ using (component) left join lens on name = t.node
  union
  select x.source, p.to_node, min(x.bp + p.step) from sweep x join pairs p on p.node = x.node left join recurring.sweep y on y.source = x.source and y.node = p.to_node
  where y.bp is null or x.bp + p.step < y.bp group by 1, 2
), ranked as (
  select t.component, s.source, s.node, bp, row_number() over (partition by t.component order by bp desc, s.source, s.node) as rn from sweep s join tip t on t.node = s.node where s.source < s.node
), spines as (
  select a.component, f.n_tips, a.source as tip_a, a.node as tip_b, cast(a.bp as bigint) as spine_bp, cast(b.bp as bigint) as second_bp, coalesce(b.bp > 0 and a.bp - b.bp < 100, false) as ambiguous
  from ranked a left join ranked b on b.component = a.component and b.rn = 2 join first_ f on f.component = a.component where a.rn = 1
)"""
SQL = {
    "sc01_overlap_length": f"select link_id, cast({_OVERLAP} as bigint) as overlap_bp from links",
    "sc02_link_sides": """select link_id, case when from_orient = '-' then 0 else 1 end as exit_side, case when to_orient = '-' then 1 else 0 end as entry_side,
      case when from_orient = '-' then '-' else '+' end as orient, translate(to_orient, '+-', '-+') as flipped from links""",
    "sc05_reverse_complement": """select seg_id, reverse(translate(seq, 'ACGTacgt', 'TGCAtgca')) as kept, reverse(translate(regexp_replace(seq, '[^ACGTNacgtn]', 'N', 'g'), 'ACGTacgt', 'TGCAtgca')) as masked
      from segments where seq <> '*'""",
    "sc10_canonical_links": """
with keyed as (
  select link_id, least({'a': from_seg, 'oa': from_orient, 'b': to_seg, 'ob': to_orient}, {'a': to_seg, 'oa': translate(to_orient, '+-', '-+'), 'b': from_seg, 'ob': translate(from_orient, '+-', '-+')}) as k
  from links where from_seg is not null and to_seg is not null
)
select k.a as a, k.oa as oa, k.b as b, k.ob as ob, count(*) as n_sent, min(link_id) as first_link from keyed group by k""",
    "sc12_walks": """select link_id, case when from_orient = '-' then '<' else '>' end || from_seg || case when to_orient = '-' then '<' else '>' end || to_seg as walk,
      from_seg || from_orient || ',' || to_seg || to_orient as path from links where from_seg is not null and to_seg is not null""",
    "sc13_walk_names": "select link_id, 0 as step_no, from_seg as name from links where from_seg is not null and to_seg is not null union all select link_id, 1, to_seg from links where from_seg is not null and to_seg is not null",
    "sc16_kept_tags": """select seg_id, array_to_string(list_filter(string_split(coalesce(tags, ''), chr(9)), lambda t: t <> '' and split_part(t, ':', 1) not in ('KC', 'DP', 'dp', 'ad', 'kn')), chr(9)) as kept_tags from segments""",
    "sc19_neighbours": _HALF + " select distinct node, to_node from half",
    "g12_half_edges": _HALF + " select * from half",
    "a08_side_degrees": _HALF + """ select h.node, count(*) filter (exit_side = 0) as left_degree, count(*) filter (exit_side = 1) as right_degree, coalesce(max(n.n_neighbours), 0) as n_neighbours
      from half h left join nbr n on n.node = h.node group by h.node""",
    "a09_neighbour_counts": "select node, count(distinct to_node) as n_neighbours, min(to_node) as least, max(to_node) as greatest from edges where node <> to_node group by 1",
    "g04_tips": _HALF + " select node, open_side from tip",
    "a10_bubble_members": _HALF + " select node, end_a, end_b, n_arms from bub where n_arms >= 2",
    "a11_visit_budgets": _HALF + """, facts as (
  select a.node, coalesce(n.n_neighbours, 0) as degree, a.node in (select node from bub where n_arms >= 2) as in_bubble,
    a.node in (select qname from paf where qname is not null and tname <> '*') as aligned
  from names a left join nbr n using (node)
), budgeted as (
  select *, case when in_bubble then 1 when degree > 4 then 4 else 2 end as b from facts
)
select node, degree, in_bubble, aligned, cast(case when not aligned then greatest(b, 2) else b end as int) as budget from budgeted""",
    "a01_component_summary": _GROUPS + f""", per_name as (
  select name, max(coalesce(seg_len, 0)) as length from segments where name is not null group by 1
), per_group as (
  select g, count(*) as n_segments, coalesce(sum(length), 0) as seg_bp from grouped left join per_name on name = v group by 1
), spans as (
  select g, count(*) as n_links, sum({_OVERLAP}) as overlap_bp from links join grouped on v = from_seg where to_seg is not null group by 1
), summed as (
  select g as component, n_segments, cast(seg_bp as bigint) as seg_bp, coalesce(n_links, 0) as n_links, cast(coalesce(overlap_bp, 0) as bigint) as overlap_bp,
    cast(greatest(seg_bp - coalesce(overlap_bp, 0), 0) as bigint) as unique_bp from per_group left join spans using (g)
)
select *, case when unique_bp >= 1000 then row_number() over (order by case when unique_bp >= 1000 then 0 else 1 end, unique_bp desc, component) end as rank from summed""",
    "g03_routed_links": _GROUPS + " select link_id, g as component from links join grouped on v = from_seg where to_seg is not null",
    "u03_missing_reverse": """
with there as (select distinct node, exit_side, to_node, to_side from edges where node is not null and to_node is not null)
select * from there a where not exists (select 1 from there b where b.node = a.to_node and b.exit_side = a.to_side and b.to_node = a.node and b.to_side = a.exit_side)""",
    "u01_names_on_one_side": """
with declared as (select distinct name from segments where name is not null), used as (
  select from_seg as name from links where from_seg is not null and to_seg is not null union select to_seg from links where from_seg is not null and to_seg is not null)
select name, 'segments' as only_in from declared where name not in (from used) union all select name, 'links' from used where name not in (from declared)""",
    "g22_dumped_without_link": _HALF + """ select distinct node, exit_side, to_node, to_side from edges where node is not null and to_node is not null
      except select node, exit_side, to_node, to_side from half""",
    "g20_steps": _HALF + " select distinct node, case when exit_side = 1 then '+' else '-' end as orient, to_node, case when to_side = 0 then '+' else '-' end as to_orient from half",
    "j03_links_between_segments": "select link_id from links where from_seg in (select name from segments) and to_seg in (select name from segments)",
    "a20_component_tips": _SPINES + """ select n_tips, count(*) as n_components, cast(sum(n) as bigint) as n_segments
      from (select g, count(*) as n, count(t.node) as n_tips from grouped left join tip t on t.node = v group by g) group by 1""",
    "g07_spine_ends": _SPINES + " select * from spines",
    "g16_bubble_regions": _SPINES + """, other as (
  select node from tip where node not in (select tip_a from spines) and node not in (select tip_b from spines)
), inner_ as (
  select from_seg as a, to_seg as b from links where from_seg is not null and to_seg is not null and from_seg not in (from other) and to_seg not in (from other)
  union select to_seg, from_seg from links where from_seg is not null and to_seg is not null and from_seg not in (from other) and to_seg not in (from other)
), region(v, part) using key (v) as (
  select v, v from (select a as v from inner_ union select tip_a from spines union select tip_b from spines)
  union
  select e.b, min(x.part) from region x join inner_ e on e.a = x.v join recurring.region y on y.v = e.b where x.part < y.part group by e.b
)
select r.v as name, s.component from spines s join region a on a.v = s.tip_a join region b on b.v = s.tip_b and b.part = a.part join region r on r.part = a.part""",
    "snk03_graph_lines": """
select 'S' as rec, seg_id as id, concat_ws(chr(9), 'S', coalesce(name, '*'), coalesce(seq, '*'), nullif(tags, '')) as line from segments
union all select 'L', link_id, concat_ws(chr(9), 'L', from_seg, from_orient, to_seg, to_orient, coalesce(overlap, '*'), nullif(tags, '')) from links where from_seg is not null and to_seg is not null""",
    "snk04_stripped_segments": """
select seg_id, concat_ws(chr(9), 'S', coalesce(name, '*'), '*', case when regexp_matches(coalesce(tags, ''), '(^|\\t)LN:') then tags else concat_ws(chr(9), nullif(tags, ''), 'LN:i:' || coalesce(seg_len, 0)) end) as line from segments""",
    "snk05_fasta": "select '>' || name || ' len=' || length(seq) || chr(10) || regexp_replace(regexp_replace(seq, '(.{60})', '\\1' || chr(10), 'g'), '\\n$', '') as record from segments where name is not null and seq <> '*'",
    "h02_walk_starts": _STARTS + " select component, place, node, orient from starts",
    "h04_candidate_walks": _WALKS + " select component, trial, step, node, orient, length_bp from going",
    "sc18_walk_facts": _WALKS + " select component, trial, length_bp, n_steps, n_nodes, n_steps - n_nodes as revisits from walks",
    "h06_best_pairs": _PAIRS + " select * from pairs_",
    "snk06_walk_summary": _PAIRS + """, sizes as (
  select g as component, cast(sum(coalesce(length, 0)) as bigint) as size_bp, count(*) as nodes_total from grouped left join lens on name = v group by 1
)
select component, size_bp, first_bp as hap1_len, coalesce(second_bp, first_bp) as hap2_len, union_bp, symdiff_bp, revisits, nodes_total, nodes_covered from sizes join pairs_ using (component)""",
    "snk03_path_lines": _PAIRS + """
select component, hap, 'P' || chr(9) || component || '_hap' || hap || chr(9) || string_agg(node || orient, ',' order by step) || chr(9)
    || case when count(*) < 2 then '*' else string_agg(case when step > 0 then coalesce(nullif(overlap, ''), '*') end, ',' order by step) end as line,
  string_agg(case when orient = '-' then '<' else '>' end || node, '' order by step) as walk
from paired group by 1, 2""",
    "h17_walk_sequences": _PAIRS + f""", seqs as (
  select name, upper(arg_min(seq, seg_id)) as seq from segments where name is not null and seq <> '*' and seq <> '' group by 1
), cut as (
  select component, hap, step, case when orient = '-' then reverse(translate(seq, 'ACGT', 'TGCA')) else seq end as s, case when step = 0 then 0 else cast({_OVERLAP} as bigint) end as ov from paired left join seqs on name = node
)
select component, hap, string_agg(case when ov < length(s) then substr(s, ov + 1) else '' end, '' order by step) as sequence from cut group by 1, 2 having count(s) = count(*)""",
    "w19_long_paths": _PAIRS + " select component, hap, arg_max(length_bp, step) as length_bp from paired group by 1, 2 having arg_max(length_bp, step) > 500",
    "g17_layers_from_tips": _HALF.replace("with half", "with recursive half") + """, pairs as (
  select distinct node, to_node from half where node <> to_node
), reach(node, depth) using key (node) as (
  select node, 0 from tip
  union
  select p.to_node, min(r.depth + 1) from reach r join pairs p on p.node = r.node where p.to_node not in (select node from recurring.reach) group by p.to_node
)
select node, depth from reach""",
    "g18_layered_edges": _HALF.replace("with half", "with recursive half") + """, pairs as (
  select distinct node, to_node from half where node <> to_node
), reach(node, depth) using key (node) as (
  select node, 0 from tip
  union
  select p.to_node, min(r.depth + 1) from reach r join pairs p on p.node = r.node where p.to_node not in (select node from recurring.reach) group by p.to_node
)
select distinct p.node, p.to_node, a.depth from pairs p join reach a on a.node = p.node join reach b on b.node = p.to_node where a.depth < b.depth""",
}
