"""A query for each operator, over whole tables, and the same in SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from annulus.config import BND, DEL, DUP, FAR_END, FRAGMENT, INV, REWIRE, SPATIAL, Config
from annulus.functions import genomics, paths
from annulus.operators import alignment, annotate, breakpoints, circuits, fragments, graph, quantify, search, sequences, similarity, validate
from annulus.operators.intervals import overlap_join, stab_join
from annulus.operators.lineage import durable
from annulus.plans.views import duck, spark_view
from annulus.sources import tables, vcf

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

inf = float("inf")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _array(df: DataFrame, key: str, order: str, *cols: str) -> DataFrame:
    s = F.sort_array(F.collect_list(F.struct(order, *cols)))  # array_sort would ask a function for each two
    held = F.transform(s, lambda x: x[cols[0]] if len(cols) == 1 else F.struct(*[x[c].alias(c) for c in cols]))
    return df.groupBy(key).agg(held.alias("a"))


# calls --------------------------------------------------------------------------------------------

GOOD = """good as (select * from sv where not secondary and svtype in ('DEL','DUP','INV','BND','TRA') and dv + dr >= 8 and dv / (dv + dr + 1) >= 0.01 and dv >= 6
  and (svtype in ('BND','TRA') or abs(svlen) >= 500) and pow(3, -(dv + dr) * (dv / (dv + dr + 1)) / ln(dv + dr + 0.001)) < 0.1)"""


@query(duck("sv", more=GOOD) + "select ord, chr1, pos1, chr2, pos2, svtype, strand, dv, dr from good")
def sv_quality_filter(spark, d):
    return vcf.sv_filter(spark_view(spark, d, "sv")).select("ord", "chr1", "pos1", "chr2", "pos2", "svtype", "strand", "dv", "dr")


@query(duck("sv") + "select ord, dv / (dv + dr + 1) as vaf, pow(3, -(dv + dr) * (dv / (dv + dr + 1)) / ln(dv + dr + 0.001)) as explog, dv / (dv + dr) > 0.7 as homozygous, case when dv / (dv + dr + 1) <= 0.3 then '0/0' when dv / (dv + dr + 1) <= 0.7 then '0/1' else '1/1' end as gt from sv")
def sv_scores(spark, d):
    v = genomics.vaf(F.col("dv"), F.col("dr"))
    return spark_view(spark, d, "sv").select("ord", v.alias("vaf"), genomics.explog((F.col("dv") + F.col("dr")).cast("double"), v).alias("explog"), genomics.is_homozygous(F.col("dv"), F.col("dr")).alias("homozygous"), genomics.genotype(v).alias("gt"))


@query(duck("sv") + "select ord, cast(round_even(dv / 4.0, 0) as bigint) as dv, cast(round_even(dr / 4.0, 0) as bigint) as dr from sv")
def downsample(spark, d):
    return spark_view(spark, d, "sv").select("ord", genomics.downsampled(F.col("dv"), 4).alias("dv"), genomics.downsampled(F.col("dr"), 4).alias("dr"))


ALT = """alt as (select ord, case ord % 4 when 0 then concat('[', chr2, ':', pos2, '[N') when 1 then concat(']', chr2, ':', pos2, ']N') when 2 then concat('N[', chr2, ':', pos2, '[') else concat('N]', chr2, ':', pos2, ']') end as alt, chr2, pos2 from sv)"""


@query(duck("sv", more=ALT) + "select ord, chr2 as mate_chr, pos2 as mate_pos, case ord % 4 when 0 then '++' when 1 then '+-' when 2 then '-+' else '--' end as strand from alt")
def bnd_strand(spark, d):
    alt = F.expr("case ord % 4 when 0 then concat('[', chr2, ':', pos2, '[N') when 1 then concat(']', chr2, ':', pos2, ']N') when 2 then concat('N[', chr2, ':', pos2, '[') else concat('N]', chr2, ':', pos2, ']') end")
    return spark_view(spark, d, "sv").select("ord", genomics.mate_chromosome(alt).alias("mate_chr"), genomics.mate_position(alt).alias("mate_pos"), genomics.bnd_strand(alt).alias("strand"))


@query(duck("sv") + """select ord, greatest(dv, dr, dv - dr) as best_dv, case when dv >= dr and dv >= dv - dr then dr when dr >= dv - dr then 3 else 5 end as best_dr,
  case when dv >= dr and dv >= dv - dr then '0/1' when dr >= dv - dr then '1/1' else './.' end as best_gt from sv""")
def multi_sample_pick(spark, d):
    sample = lambda ref, alt, gt: F.create_map(F.lit("DR"), F.concat_ws(",", ref.cast("string"), alt.cast("string")), F.lit("GT"), F.lit(gt))
    dv, dr = F.col("dv"), F.col("dr")
    x = spark_view(spark, d, "sv").select("ord", vcf.multi_sample_pick(F.array(sample(dr, dv, "0/1"), sample(F.lit(3), dr, "1/1"), sample(F.lit(5), dv - dr, "./."))).alias("b"))
    return x.select("ord", F.col("b.dv").alias("best_dv"), F.col("b.dr").alias("best_dr"), F.col("b.gt").alias("best_gt"))


LINES = """line as (select c_custkey as ord, case when c_custkey % 7 = 0 then concat('#', c_name) when c_custkey % 5 = 0 then concat('chr1 ', c_custkey, ' . N <DEL> . PASS') else
  concat('chr', 1 + c_nationkey % 22, '\t', 100 + c_custkey, ' id', c_custkey, '\tN <DEL>\t. PASS\tPRECISE;SVTYPE=DEL;END=', 5000 + c_custkey, ';SVLEN=-', 900 + c_custkey % 77, ';STRANDS=+-,10 GT:DR:DV 0/1:', c_custkey % 9, ':', c_custkey % 31) end as value from customer)"""


def _customers(spark, d):
    """Customers dealt to all cores: as lines they are long to parse, and a file of them may come as a single row group. They are kept so, as
    conditions on lines would else be asked before they are dealt."""
    c = spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", "c_name", "c_nationkey")
    return durable(c.repartition(2 * spark.sparkContext.defaultParallelism, "c_custkey"))


def _lines(spark, d):
    text = LINES.split(" as (", 1)[1].rsplit(")", 1)[0].replace("from customer", "from {customer}")
    return spark.sql(text, customer=_customers(spark, d))


@query("with " + LINES + r" select ord, case when value like '#%' then value else regexp_replace(trim(value), '\s+', chr(9), 'g') end as value from line where value like '#%' or len(regexp_split_to_array(trim(value), '\s+')) = 10")
def vcf_clean(spark, d):
    return vcf.clean_lines(_lines(spark, d))


@query("with " + LINES + r" select ord, value from line where not (value like '#%' or len(regexp_split_to_array(trim(value), '\s+')) = 10)")
def vcf_dropped_lines(spark, d):
    return vcf.dropped_lines(_lines(spark, d))


@query("with " + LINES + r""" select c_custkey as ord, concat('id', c_custkey) as sv_id, concat('chr', 1 + c_nationkey % 22) as chr1, 100 + c_custkey as pos1, 5000 + c_custkey as pos2, 'DEL' as svtype,
  -(900 + c_custkey % 77) as svlen, '+-' as strand, c_custkey % 31 as dv, c_custkey % 9 as dr, '0/1' as gt from customer where c_custkey % 7 <> 0 and c_custkey % 5 <> 0""")
def vcf_parse(spark, d):
    sv = vcf.normalise(vcf.parse(vcf.clean_lines(_lines(spark, d))))
    return sv.select("ord", "sv_id", "chr1", "pos1", "pos2", "svtype", "svlen", "strand", "dv", "dr", "gt")


# breakpoints and fragments -----------------------------------------------------------------------------

POINTS = GOOD + """, point as (select chr1 as chr, pos1 as pos from good union select chr2, pos2 from good),
 ranked as (select chr, pos, row_number() over (partition by chr order by pos) as n, lag(pos) over (partition by chr order by pos) as before from point),
 walk(chr, n, pos, anchor) as (select chr, n, pos, pos from ranked where n = 1
   union all select r.chr, r.n, r.pos, case when r.pos - w.anchor <= 50 then w.anchor else r.pos end from walk w join ranked r on r.chr = w.chr and r.n = w.n + 1)"""


def _merged(spark, d):
    sv = durable(vcf.sv_filter(spark_view(spark, d, "sv")))  # read by points, rewriting and edges
    points = breakpoints.breakpoints(sv)
    return sv, points, durable(breakpoints.merge(points))  # read by three branches below


@query(duck("sv", more=POINTS) + "select chr, pos, anchor from walk")
def breakpoint_merge(spark, d):
    return _merged(spark, d)[2]


@query(duck("sv", more=POINTS) + "select ord, chr1, a.anchor as pos1, chr2, b.anchor as pos2 from good join walk a on a.chr = chr1 and a.pos = pos1 join walk b on b.chr = chr2 and b.pos = pos2")
def mate_rewrite(spark, d):
    sv, _, merged = _merged(spark, d)
    return breakpoints.rewrite(sv, merged).select("ord", "chr1", "pos1", "chr2", "pos2")


FRAGS = POINTS + f""", first as (select chr, row_number() over (order by min(ord * 2 + side)) as o from (select chr1 as chr, ord, 0 as side from good union all select chr2, ord, 1 from good) group by chr),
 stop as (select distinct chr, anchor as pos from walk union select chr, {FAR_END} from first),
 frag as (select 4 * (row_number() over (order by o, pos) - 1) + 1 as fid, chr, coalesce(lag(pos) over (partition by chr order by pos), 0) as start, pos as "end" from stop join first using (chr))"""


@query(duck("sv", more=FRAGS) + 'select fid, chr, start, "end", fid + 1 as tail, fid + 2 as head, fid + 3 as edge_id from frag')
def fragment_genome(spark, d):
    _, points, merged = _merged(spark, d)
    return fragments.fragment(breakpoints.kept_anchors(points, merged))


EDGES = FRAGS + f""", moved as (select g.ord, svtype, strand, dv, chr1, a.anchor as pos1, chr2, b.anchor as pos2 from good g join walk a on a.chr = chr1 and a.pos = pos1 join walk b on b.chr = chr2 and b.pos = pos2),
 tie as (select *, 1 as p1, 0 as p2, {DEL} as code from moved where svtype = 'DEL' union all select *, 0, 1, {DUP} from moved where svtype = 'DUP'
   union all select *, 1, 1, {INV} from moved where svtype = 'INV' union all select *, 0, 0, {INV} from moved where svtype = 'INV'
   union all select *, case when strand in ('+-', '++') then 1 else 0 end, case when strand in ('-+', '++') then 1 else 0 end, {BND} from moved where svtype in ('BND', 'TRA')),
 placed as (select t.*, pos1 + case when p1 = 0 then 100 else -100 end as q1, pos2 + case when p2 = 0 then 100 else -100 end as q2 from tie t),
 e1 as (select p.*, f.fid + 1 + p1 as u from placed p asof join frag f on p.chr1 = f.chr and p.q1 >= f.start where p.q1 < f."end"),
 edge as (select e.*, f.fid + 1 + p2 as v from e1 e asof join frag f on e.chr2 = f.chr and e.q2 >= f.start where e.q2 < f."end")"""


def _edges(spark, d):
    """Calls are read from the tables where they are asked for, not kept. A line that repeats another changes no position; such lines go where calls come to
    the positions of their first end, so that takes no move of its own. These columns tell all the others of a call that passed."""
    lines = vcf.sv_filter(spark_view(spark, d, "sv", repeats=True))
    points = breakpoints.breakpoints(lines)
    merged = durable(breakpoints.merge(points))
    frags = durable(fragments.fragment(breakpoints.kept_anchors(points, merged)))
    calls = lines.select("ord", "sv_id", "chr1", "pos1", "chr2", "pos2", "svtype", "strand", "dv").repartition("chr1", "pos1").distinct()
    return frags, graph.sv_edges(calls, merged, frags)


@query(duck("sv", more=EDGES) + "select ord, u, v, code as svtype, cast(dv as double) as weight from edge")
def sv_edges(spark, d):
    return _edges(spark, d)[1].select("ord", "u", "v", "svtype", "weight")


@query(duck("sv", more=EDGES) + "select node, count(*) as degree from (select u as node from edge union all select v from edge) group by 1")
def node_degree(spark, d):
    return graph.degrees(_edges(spark, d)[1].withColumn("edge_id", F.lit(0).cast("bigint")))


@query(duck("sv", more=EDGES + ", tied as (select u as node from edge union select v from edge)") + "select fid, chr from frag where not exists (select 1 from tied where node = fid + 1) and not exists (select 1 from tied where node = fid + 2)")
def standalone(spark, d):
    return graph.standalone(*_edges(spark, d)).select("fid", "chr")


@query(duck("sv", more=EDGES) + "select chr, count(*) as n_edges, sum(weight) as weight, count(distinct node) as n_nodes from (select chr1 as chr, u as node, cast(dv as double) as weight from edge) group by 1")
def junctions_by_chromosome(spark, d):
    """Which fragments do the calls of each chromosome tie, and how strongly."""
    return _edges(spark, d)[1].groupBy("chr").agg(F.count("*").alias("n_edges"), F.sum("weight").alias("weight"), F.countDistinct("u").alias("n_nodes"))


CUTS = f"""kept as (select distinct chr, pos from cut), stops as (select chr, pos from kept union select distinct chr, {FAR_END} from kept),
 named as (select chr, row_number() over (order by min(ord)) as o from cut group by chr),
 frag as (select 4 * (row_number() over (order by o, pos) - 1) + 1 as fid, chr, coalesce(lag(pos) over (partition by chr order by pos), 0) as start, pos as "end" from stops join named using (chr)),
 clipped as (select fid, chr, "end" as far, greatest(start, "end") - start as w, least(case when least(start, length) = least("end", length) then least(start, length) - 1 else least(start, length) end, least("end", length)) as s, least("end", length) as e, start as start0 from frag join chrom using (chr)),
 over_run as (select fid, value, least(e, c."end") - greatest(s, c.start) as n from clipped k join coverage c on c.chr = k.chr and c.start < k.e and k.s < c."end"),
 med as (select fid, quantile_cont(value, 0.5) as m from (select fid, value, unnest(range(cast(n as bigint))) from over_run) group by fid),
 covered as (select f.fid, f.chr, f.start, f."end", coalesce(m, cast('inf' as double)) as coverage from frag f left join med using (fid))"""


def _covered(spark, d):
    anchors = spark_view(spark, d, "cut")
    merged = anchors.select("chr", "pos", F.col("pos").alias("anchor")).distinct()
    frags = fragments.fragment(breakpoints.kept_anchors(anchors, merged))
    return fragments.median_coverage(frags, spark_view(spark, d, "coverage"), spark_view(spark, d, "chrom"), bin_size=5000)


@query(duck("coverage", "chrom", "cut", more=CUTS) + 'select fid, chr, start, "end", coverage from covered')
def fragment_coverage(spark, d):
    return _covered(spark, d).select("fid", "chr", "start", "end", "coverage")


@query(duck("coverage", "chrom", "cut", more=CUTS) + 'select fid, coverage from covered where coverage >= 20 and coverage <= 30')
def clean_coverage(spark, d):
    return graph.cover_filter(_covered(spark, d), 20, 30).select("fid", "coverage")


@query(duck("coverage", "chrom") + 'select round(coalesce(sum(m * length) / sum(length), 0), 6) as wgs_mean from (select chr, sum(value * ("end" - start)) / sum("end" - start) as m from coverage group by chr) join chrom using (chr)')
def wgs_mean(spark, d):
    return fragments.genome_mean(spark_view(spark, d, "coverage"), spark_view(spark, d, "chrom"), Config().allowed).select(F.round("wgs_mean", 6).alias("wgs_mean"))


@query(duck("coverage", "chrom", "cut", more=CUTS) + "select fid, coverage / cast(25 as double) * (cast(1000000 as double) / (\"end\" - start)) as norm_cov, max(coverage) over () as max_cov from covered where coverage < cast('inf' as double)")
def coverage_metrics(spark, d):
    good = _covered(spark, d).where(F.col("coverage") < inf)
    most = good.agg(F.max("coverage").alias("max_cov"))  # one row
    return good.select("fid", genomics.normalised_coverage(F.col("coverage"), F.lit(24.0), F.col("len")).alias("norm_cov")).join(F.broadcast(most))


@query(duck("coverage", "chrom", "cut", more=CUTS) + "select fid, chr, start, case when \"end\" = 100000000000 then start + 2000 else \"end\" end as stop, cast(floor(coverage) as bigint) as coverage from covered where coverage < cast('inf' as double)")
def fragments_bed(spark, d):
    return annotate.fragments_bed(_covered(spark, d).where(F.col("coverage") < inf)).select("fid", "chr", "start", "stop", "coverage")


CROSSING = """crossing as (select b.chr, b.bp, count(*) as n from (select distinct chr, bp from {bp} where bp is not null) b join {read} r on r.chr = b.chr and is_mapped and not is_secondary and query_length >= 1000
   and ref_start < b.bp - 100 and ref_end > b.bp + 100 and ref_start < b.bp + 500 and ref_end > greatest(0, b.bp - 500) group by 1, 2)"""
BPS = "bp as (select distinct concat('chr', 1 + c_custkey % 22) as chr, (c_custkey * 104729) % 1000000 as bp from customer), " + CROSSING.format(bp="bp", read="read")


def _spanning(spark, d):
    bp = spark.sql("select concat('chr', 1 + c_custkey % 22) as chr, (c_custkey * 104729) % 1000000 as bp from {customer}", customer=spark.read.parquet(f"{d}/customer.parquet"))
    return fragments.spanning_reads(bp, spark_view(spark, d, "read"))


@query(duck("read", more=BPS) + "select b.chr, b.bp, coalesce(n, 0) as n from bp b left join crossing using (chr, bp)")
def spanning_reads(spark, d):
    return _spanning(spark, d)


@query(duck("read", more=BPS) + "select chr, bp, n from crossing where n > 4 and n > 4.5")
def spanning_gate(spark, d):
    return _spanning(spark, d).where((F.col("n") > 4) & (F.col("n") > 4.5))


NEAR = """near as (select fid as fid1, lead(fid) over w as fid2, chr, "end" as e, lead(start) over w as s2, start as s1, lead("end") over w as e2 from frag window w as (partition by chr order by fid)),
 adj as (select fid1, fid2, chr, case when abs(s2 - e) < 50 then s2 when abs(s1 - e2) < 50 then s1 end as bp from near where fid2 is not null)"""


@query(duck("coverage", "chrom", "cut", more=CUTS + ", " + NEAR) + "select fid1, fid2, chr, bp from adj where bp is not null")
def adjacent_fragments(spark, d):
    return fragments.adjacent(_covered(spark, d))


@query(duck("coverage", "chrom", "cut", "near_read", more=CUTS + ", " + NEAR + ", " + CROSSING.format(bp="adj", read="near_read")) + f"select fid1 + 2 as u, fid2 + 1 as v, {SPATIAL} as svtype, cast(n as double) as weight from adj join crossing using (chr, bp) where n > 4 and n > 5.5")
def spatial_edges(spark, d):
    near = durable(fragments.adjacent(_covered(spark, d)))
    return graph.spatial_edges(near, fragments.spanning_reads(near, spark_view(spark, d, "near_read")), wgs_mean=5.5).select("u", "v", "svtype", "weight")


OEDGE = f"""oedge as (select a.head as u, b.tail as v, cast(a.coverage as double) as weight, {SPATIAL} as svtype, a.fid * 10 as edge_id, a.grp from order_fragment a join order_fragment b on a.grp = b.grp and b.n = a.n + 1
 union all select a.tail, b.head, b.coverage, {DUP}, a.fid * 10 + 1, a.grp from order_fragment a join order_fragment b on a.grp = b.grp and b.n = a.n + 2
 union all select a.head, b.tail, a.coverage + 1, {DEL}, a.fid * 10 + 2, a.grp from order_fragment a join order_fragment b on a.grp = b.grp and b.n = a.n + 1 where a.fid % 3 = 0
 union all select a.head, a.tail, a.coverage, {DUP}, a.fid * 10 + 3, a.grp from order_fragment a where a.fid % 5 = 1)"""


def _order_graph(spark, d):
    f = spark_view(spark, d, "order_fragment")
    order = Window.partitionBy("grp").orderBy("n")
    edge = lambda i, u, v, kind, w: F.struct((F.col("fid") * 10 + i).alias("edge_id"), F.col(u).alias("u"), F.col(v).alias("v"), F.lit(kind).alias("svtype"), w.cast("double").alias("weight"))
    own = F.col("coverage")
    ties = F.array(
        F.when(F.col("nxt").isNotNull(), edge(0, "head", "nxt", SPATIAL, own)), F.when(F.col("two").isNotNull(), edge(1, "tail", "two", DUP, F.col("two_coverage"))),
        F.when(F.col("nxt").isNotNull() & (F.col("fid") % 3 == 0), edge(2, "head", "nxt", DEL, own + 1)), F.when(F.col("fid") % 5 == 1, edge(3, "head", "tail", DUP, own)),
    )
    near = f.select("fid", "tail", "head", "coverage", F.lead("tail").over(order).alias("nxt"), F.lead("head", 2).over(order).alias("two"), F.lead("coverage", 2).over(order).alias("two_coverage"))
    e = near.select(F.explode(ties).alias("e")).where("e is not null").select("e.*")  # array_compact would ask a function for each
    return f.drop("grp", "n", "m", "minus"), e


@query(duck("order_fragment", more=OEDGE) + """select edge_id, u, v, svtype, weight from (select e.*, row_number() over (partition by least(e.u, e.v), greatest(e.u, e.v) order by e.weight desc, e.edge_id) as k from oedge e)
 where k = 1 or (u + 1) // 4 = (v + 1) // 4""".replace("(u + 1) // 4 = (v + 1) // 4", "(u - 2) // 4 = (v - 2) // 4"))
def dup_edge_prune(spark, d):
    f, e = _order_graph(spark, d)
    return graph.strongest(e, f)


@query(duck("order_fragment", more=OEDGE) + "select distinct node, other, 1 as linked from (select u as node, v as other from oedge union all select v, u from oedge)")
def adjacency(spark, d):
    return graph.adjacency(_order_graph(spark, d)[1])


@query(duck("order_fragment", more=OEDGE) + """, live as (select * from order_fragment where coverage >= 10 and coverage <= 45)
 select edge_id, u, v, svtype, weight from oedge where (u in (select tail from live union select head from live)) and (v in (select tail from live union select head from live))""")
def edge_cascade(spark, d):
    f, e = _order_graph(spark, d)
    return graph.surviving(e, graph.cover_filter(f, 10, 45))


@query(duck("order_fragment", more=OEDGE) + """select f.fid, min(g.fid) as part from order_fragment f join order_fragment g on g.grp = f.grp group by 1""")
def connected_parts(spark, d):
    f, e = _order_graph(spark, d)
    return search.parts(f, e)


CHAIN = """chain as (select fid, chr, n, m, head, tail, grp, coverage, cast((n - n % 2) / 2 - case when n % 2 = 0 then 1 else 0 end as bigint) * 5000 + case when n % 2 = 0 then 4600 + grp % 4 * 100 else 0 end as start,
   400 - grp % 4 * 100 as short from order_fragment)"""


@query(duck("order_fragment", more=CHAIN) + """select fid, start - case when n > 1 then short / 2 else 0 end as start, start + 5000 - short + case when n < m then short / 2 else 0 end as "end",
  cast(5000 - short + case when n < m then short / 2 else 0 end - case when n > 1 then short / 2 else 0 end as double) as len, case when n + 2 <= m then 1 else 0 end as out from chain where n % 2 = 1""".replace("short / 2", "short // 2"))
def short_fragment_rewire(spark, d):
    """Every order is a chain of fragments of which each second one is short; the others grow into its place and are tied."""
    f = spark_view(spark, d, "order_fragment")
    short, even = F.lit(400) - F.col("grp") % 4 * 100, F.col("n") % 2 == 0
    slot = F.floor((F.col("n") - 1) / 2) * 5000
    c = f.withColumn("start", F.when(even, slot + 5000 - short).otherwise(slot)).withColumn("end", F.when(even, slot + 5000).otherwise(slot + 5000 - short)).withColumn("len", (F.col("end") - F.col("start")).cast("double"))
    e = c.where("n < m").select((F.col("fid") * 10).alias("edge_id"), F.col("head").alias("u"), (F.col("tail") + 4).alias("v"), F.lit(SPATIAL).alias("svtype"), F.col("coverage").alias("weight"))
    left, ties = search.remove_short(c, e, 500)
    out = ties.where((F.col("svtype") == REWIRE) & (F.col("v") == F.col("u") + 7) & (F.col("weight") == inf)).groupBy(F.col("u").alias("head")).agg(F.count("*").alias("out"))
    return left.select("fid", "start", "end", "len", "head").join(out, "head", "left").select("fid", "start", "end", "len", F.coalesce("out", F.lit(0)).alias("out"))


def _rings(spark, d):
    """Every order is a ring of its fragments, some of them inverted."""
    f = spark_view(spark, d, "order_fragment")
    leave, enter = F.when(F.col("minus"), F.col("tail")).otherwise(F.col("head")), F.when(F.col("minus"), F.col("head")).otherwise(F.col("tail"))
    order = Window.partitionBy("grp").orderBy("n")
    nxt = F.coalesce(F.lead(enter).over(order), F.first(enter).over(order))  # the first one is in every frame
    e = f.select("fid", "coverage", leave.alias("u"), nxt.alias("v"))
    return f, e.select((F.col("fid") * 10).alias("edge_id"), "u", "v", F.lit(BND).alias("svtype"), F.col("coverage").alias("weight"))


RING = "ring as (select grp, min(fid) as part, '[' || string_agg(case when minus then -fid else fid end, ', ' order by n) || ']' as path, avg(coverage) as score from order_fragment group by grp)"


@query(duck("order_fragment", more=RING) + "select part, 0 as seq, path from ring")
def cycle_search(spark, d):
    return search.circles(*_rings(spark, d)).where("phase = 0").select("part", "seq", F.col("path").cast("string").alias("path"))


@query(duck("order_fragment", more=RING) + "select row_number() over (order by part) - 1 as circ_id, round(score, 6) as score, part as cluster from ring")
def lone_abundance(spark, d):
    """Circles that share no fragment score the mean coverage of their own."""
    f, e = _rings(spark, d)
    return quantify.abundance(search.distinct_circles(search.circles(f, e)), f, 4.0).select("circ_id", F.round("score", 6).alias("score"), "cluster")


def _petals(spark, d):
    """Every order is a fragment with one or two rings through it, of different weights."""
    f = spark_view(spark, d, "order_fragment").where("n <= 3")
    p = f.where("n > 1").withColumn("w", 2 * F.col("coverage") + F.col("n") % 2)
    root = F.col("fid") - 4 * (F.col("n") - 1)
    e = lambda u, v, i: p.select((F.col("fid") * 10 + i).alias("edge_id"), u.alias("u"), v.alias("v"), F.lit(BND).alias("svtype"), F.col("w").alias("weight"))
    return f, e(root + 2, F.col("tail"), 0).unionByName(e(F.col("head"), root + 1, 1))


PETALS = """petal as (select grp, 4 * (64 * grp + 1) + 1 as root, fid, row_number() over (partition by grp order by 2 * coverage + n % 2 desc) as k from order_fragment where n in (2, 3))"""


@query(duck("order_fragment", more=PETALS) + "select root as part, k - 1 as seq, 0 as phase, concat('[', root, ', ', fid, ']') as path from petal union all select a.root, 0, 1, concat('[', a.root, ', ', a.fid, ', ', a.root, ', ', b.fid, ']') from petal a join petal b on a.grp = b.grp and a.k = 1 and b.k = 2")
def combine_cycles(spark, d):
    return search.circles(*_petals(spark, d)).select("part", "seq", "phase", F.col("path").cast("string").alias("path"))


@query()
def lasso_abundance(spark, d):
    """Clusters of circles that share fragments, solved by regression."""
    f, e = _order_graph(spark, d)
    found = search.distinct_circles(search.circles(f, graph.strongest(e, f)))
    return quantify.abundance(found, f, 4.0).select("circ_id", F.round("score", 6).alias("score"), "cluster")


SPEC = """spec as (select tail as node1, head as node2, fid as f1, fid as f2, 0 as part1, 1 as part2, edge_id as edgeid, 0 as svtype, coverage as cov from order_fragment
  union all select u, v, u - (u - 1) % 4, v - (v - 1) % 4, (u - 2) % 4, (v - 2) % 4, edge_id, svtype, weight from oedge)"""


@query(duck("order_fragment", more=OEDGE + ", " + SPEC) + "select 'fragment' as kind, edgeid as edge_id, node1 as a, node2 as b, cov as weight from spec where svtype = 0 union all select 'edge', edgeid, node1, node2, cov from spec where svtype <> 0")
def graph_spec(spark, d):
    f, e = _order_graph(spark, d)
    of = lambda c: F.concat(F.lit("f"), (F.col(c) - (F.col(c) - 1) % 4).cast("string"))
    row = lambda df, u, v, i, kind, w: df.select(F.col(u).alias("node1"), F.col(v).alias("node2"), of(u).alias("frag1"), of(v).alias("frag2"), ((F.col(u) - 2) % 4).cast("int").alias("part1"), ((F.col(v) - 2) % 4).cast("int").alias("part2"), F.col(i).alias("edgeid"), kind.alias("svtype"), F.col(w).alias("cov"))
    frags, ties = graph.from_spec(row(f, "tail", "head", "edge_id", F.lit(0), "coverage").unionByName(row(e, "u", "v", "edge_id", F.col("svtype"), "weight")))
    return frags.select(F.lit("fragment").alias("kind"), "edge_id", F.col("tail").alias("a"), F.col("head").alias("b"), F.col("coverage").alias("weight")).unionByName(ties.select(F.lit("edge").alias("kind"), "edge_id", F.col("u").alias("a"), F.col("v").alias("b"), "weight"))


# paths --------------------------------------------------------------------------------------------------

PATHS = "path as (select circ_id, list(cast(x as bigint) order by i) as p from path_step group by 1)"
FLIP = "flip as (select circ_id, case when 2 * len(list_filter(p, lambda x: x < 0)) > len(p) then list_reverse(list_transform(p, lambda x: -x)) else p end as p from path)"
TURN = "turned as (select circ_id, p, list_position(list_transform(p, lambda x: abs(x)), list_min(list_transform(p, lambda x: abs(x)))) as k from flip)"


def _paths(spark, d):
    return _array(spark_view(spark, d, "path_step"), "circ_id", "i", "x").select("circ_id", F.col("a").alias("path"))


def _text(path):
    return F.array_join(path.cast("array<string>"), ",")


@query(duck("path_step", more=f"{PATHS}, {FLIP}, {TURN}") + "select circ_id, array_to_string(list_concat(p[k:], p[:k-1]), ',') as canonical from turned")
def canonical_path(spark, d):
    return _paths(spark, d).select("circ_id", _text(paths.canonical(F.col("path"))).alias("canonical"))


def _first(spark, d, **form):
    found = _paths(spark, d).select(F.lit(0).alias("part"), F.lit(0).alias("phase"), F.col("circ_id").alias("seq"), "path")
    return search.first_seen(found, **form).select(_text(F.col("path")).alias("path"), F.col("first.seq").alias("circ_id"), "copies")


@query(duck("path_step", more=f"{PATHS}, {FLIP}, {TURN}") + ", form as (select circ_id, array_to_string(list_concat(p[k:], p[:k-1]), ',') as path from turned) select path, min(circ_id) as circ_id, count(*) as copies from form group by 1")
def canonical_dedupe(spark, d):
    return _first(spark, d)


@query(duck("path_step", more=PATHS) + "select array_to_string(p, ',') as path, min(circ_id) as circ_id, count(*) as copies from path group by 1")
def raw_dedupe(spark, d):
    return _first(spark, d, canonical_form=False)


@query(duck("path_step", more=f"{PATHS}, {FLIP}, {TURN}") + ", form as (select circ_id, array_to_string(list_concat(p[k:], p[:k-1]), ',') as path from turned) select path, row_number() over (order by min(circ_id)) - 1 as circ_id from form group by path")
def distinct_circles(spark, d):
    found = _paths(spark, d).select(F.lit(0).alias("part"), F.lit(0).alias("phase"), F.col("circ_id").alias("seq"), "path")
    return search.distinct_circles(found).select(_text(F.col("path")).alias("path"), "circ_id")


@query(duck("path_step", more=PATHS) + "select circ_id, array_to_string([p[i] for i in range(1, len(p) + 1) if i = 1 or p[i] <> p[i - 1]], ',') as path from (select circ_id, list_transform(p, lambda x: x % 3) as p from path)")
def simplify_path(spark, d):
    return _paths(spark, d).select("circ_id", _text(paths.simplify_consecutive(F.transform("path", lambda x: x % 3))).alias("path"))


@query(duck("path_step") + "select circ_id, abs(x) as fid, count(*) as mult from path_step group by 1, 2")
def fragment_multiplicity(spark, d):
    return quantify.multiplicity(_paths(spark, d))


JACC = """pair as (select a.circ_id as a, b.circ_id as b, sum(least(a.w, b.w)) as shared from {w} a join {w} b on a.fid = b.fid and a.circ_id < b.circ_id group by 1, 2),
 tot as (select circ_id, sum(w) as s from {w} group by 1),
 jac as (select a, b, x.s as sa, y.s as sb, shared, x.s + y.s - shared as un, shared / (x.s + y.s - shared) as jaccard from pair join tot x on x.circ_id = a join tot y on y.circ_id = b)"""
MULTI = "wm as (select circ_id, fid, mult * len as w from circle_fragment), " + JACC.format(w="wm")
SET = "ws as (select circ_id, fid, len as w from circle_fragment), " + JACC.format(w="ws")


@query(duck("circle_fragment", more=MULTI) + "select a, b, sa as s1, sb as s2, jaccard from jac where jaccard > 0.5")
def jaccard_multiset(spark, d):
    return similarity.jaccard(spark_view(spark, d, "circle_fragment"), multiset=True, above=0.5).select("a", "b", "s1", "s2", "jaccard")


@query(duck("circle_fragment", more=SET) + "select a, b, un as s1, un as s2, jaccard from jac where jaccard > 0.5")
def jaccard_set(spark, d):
    return similarity.jaccard(spark_view(spark, d, "circle_fragment"), multiset=False, above=0.5).select("a", "b", "s1", "s2", "jaccard")


@query(duck("circle_fragment", more=SET) + "select c.circ_id from (select distinct circ_id from circle_fragment) c where not exists (select 1 from jac where a = c.circ_id and jaccard > 0.4)")
def prune_similar(spark, d):
    w = spark_view(spark, d, "circle_fragment")
    circles = w.select("circ_id", F.lit(0).alias("first")).distinct()
    return similarity.prune_near_identical(circles, similarity.jaccard(w, multiset=False, above=0.4), threshold=0.4).select("circ_id")


@query(duck("circle_fragment", more=MULTI + ", sc as (select circ_id, cast(circ_id % 97 as double) as score from circle_fragment group by 1)") + """select c.circ_id from sc c where
 not exists (select 1 from jac join sc o on o.circ_id = b where a = c.circ_id and jaccard > 0.3 and o.score > c.score)
 and not exists (select 1 from jac join sc o on o.circ_id = a where b = c.circ_id and jaccard > 0.3 and o.score >= c.score)""")
def prune_score(spark, d):
    w = spark_view(spark, d, "circle_fragment")
    circles = w.select("circ_id", (F.col("circ_id") % 97).cast("double").alias("score"), F.col("circ_id").alias("ord")).distinct()
    return similarity.prune_by_score(circles, similarity.jaccard(w, multiset=True, above=0.3), threshold=0.3).select("circ_id")


@query("""with recursive cf as (select distinct l_orderkey as circ_id, l_orderkey // 4 * 8 + l_partkey % 3 * 2 + l_orderkey % 2 as fid from lineitem),
 tie as (select distinct x.circ_id as a, y.circ_id as b from cf x join cf y using (fid)),
 reach(a, b) as (select circ_id, circ_id from cf union select r.a, t.b from reach r join tie t on t.a = r.b),
 least_circle as (select a as circ_id, min(b) as m from reach group by 1)
 select circ_id, (select min(fid) from cf join least_circle z on z.circ_id = cf.circ_id where z.m = l.m) as cluster from least_circle l""")
def clusters(spark, d):
    cf = spark.sql("select distinct l_orderkey as circ_id, l_orderkey div 4 * 8 + l_partkey % 3 * 2 + l_orderkey % 2 as fid from {lineitem}", lineitem=spark.read.parquet(f"{d}/lineitem.parquet"))
    return quantify.clusters(cf.where("true").withColumn("fid", F.col("fid") + 1)).select("circ_id", (F.col("cluster") - 1).alias("cluster"))


@query(duck("circle_fragment") + "select circ_id, sum(mult * len) / sum(len) as weighted, avg(mult) as plain, count(*) as n from circle_fragment group by 1")
def circle_means(spark, d):
    return quantify.mean_coverage(spark_view(spark, d, "circle_fragment").withColumn("coverage", F.col("mult").cast("double")))


@query(duck("circle_fragment") + "select fid, sum(mult * cast(circ_id % 83 as double)) as coverage from circle_fragment group by 1")
def expected_coverage(spark, d):
    w = spark_view(spark, d, "circle_fragment")
    return quantify.expected_coverage(w, w.select("circ_id", (F.col("circ_id") % 83).cast("double").alias("score")).distinct())


@query(duck("order_fragment", more="x as (select log10(floor(len) + 0.01) as x from order_fragment), e as (select min(x) as lo, (max(x) - min(x)) / 50 as step from x), b as (select cast(least(49, floor((x - lo) / step)) as int) as bucket from x, e)") + "select bucket, round(pow(10, lo + bucket * step), 6) as low, count(*) as n from b, e group by bucket, lo, step")
def length_distribution(spark, d):
    return quantify.distribution(spark_view(spark, d, "order_fragment"), "len").select("bucket", F.round("low", 6).alias("low"), "n")


@query("select round(sum(x * y) / (sqrt(sum(x * x)) * sqrt(sum(y * y))), 9) as cosine, round(sqrt(sum((x - y) * (x - y))) / sqrt(sum(x * x)), 9) as relative_l2, round(avg((x - y) * (x - y)), 6) as mse, round(abs(sum(x) - sum(y)), 3) as absolute from (select cast(l_quantity as double) as x, cast(l_partkey % 50 as double) as y from lineitem)")
def vector_likeness(spark, d):
    x = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_quantity").cast("double").alias("x"), (F.col("l_partkey") % 50).cast("double").alias("y"))
    v = similarity.vector_likeness(x)
    return v.select(F.round("cosine", 9).alias("cosine"), F.round("relative_l2", 9).alias("relative_l2"), F.round("mse", 6).alias("mse"), F.round("absolute", 3).alias("absolute"))


# circles on the genome ---------------------------------------------------------------------------------------

PAIRS = """nx as (select *, lag(chr) over w as pc, lag(least(start, "end")) over w as ps, lag(greatest(start, "end")) over w as pe, lag(strand) over w as pst, lag(i) over w as pi from piece window w as (partition by circ_id order by i)),
 th as (select *, least(start, "end") as cs, greatest(start, "end") as ce, least(5000, floor(0.1 * (pe - ps) + 0.1 * abs("end" - start))) as thr from nx),
 fl as (select *, pc = chr and abs(cs - ps) <= 50 and abs(ce - pe) <= 50 as dup, pc = chr and ((cs - pe > 10 and cs - pe < thr) or (ps - ce > 10 and ps - ce < thr)) as small,
   pc = chr and (cs - pe >= thr or ps - ce >= thr) as far, pc = chr and strand <> pst as inv, pc <> chr as inter,
   pc = chr and ((ps < start and start < pe) or ((ps < "end" and "end" < pe) and not abs(cs - ps) <= 50)) as fold from th),
 flags as (select circ_id, count(*) as n, coalesce(bool_or(dup), false) or count(distinct frag) < count(*) as dup, coalesce(bool_or(small and not dup), false) as small_del, coalesce(bool_or(far and not dup and not small), false) as multi,
   coalesce(bool_or(inv), false) as inv, coalesce(bool_or(inter), false) as interchr, coalesce(bool_or(fold), false) as foldback, sum(abs(start - "end")) / 1000000.0 as size_mb,
   array_to_string(list_sort(list_distinct(list(chr))), ',') as chr_origin from fl group by 1),
 idx as (select *, case when n = 1 then 0 when foldback then 6 when dup then 5 when interchr then 4 when multi then 3 when small_del and inv then 2 when inv or small_del then 1 else 0 end as topology_idx from flags)"""


def _conf(spark, d):
    return _array(spark_view(spark, d, "piece"), "circ_id", "i", "chr", "start", "end", "strand", "frag", "cov").select("circ_id", F.col("a").alias("conf"))


@query(duck("piece", more=PAIRS) + "select circ_id, n, small_del, dup, inv, interchr, multi, foldback, topology_idx from idx")
def topology(spark, d):
    t = _conf(spark, d).select("circ_id", paths.topology_flags(F.col("conf")).alias("t")).select("circ_id", "t.*")
    return t.withColumn("topology_idx", genomics.topology_index(*[F.col(c) for c in ("n", "small_del", "dup", "inv", "interchr", "multi", "foldback")]))


NAMES = "['simple_circle', 'simple_sv', 'mixed_sv', 'multi_region_intra_chr', 'multi_region_inter_chr', 'simple_duplications', 'foldbacks']"


def _fold(gap: int) -> str:
    """The collapse of neighbours as SQL: pieces are taken one after another; the last one may meet the first."""
    meet = "{a}.chr = {b}.chr and {a}.strand = {b}.strand and case when {a}.strand = '+' then abs({a}.\"end\" - {b}.start) else abs({a}.start - {b}.\"end\") end < " + str(gap)
    join = "{{'chr': {a}.chr, 'start': case when {a}.strand = '+' then {a}.start else {b}.start end, 'end': case when {a}.strand = '+' then {b}.\"end\" else {a}.\"end\" end, 'strand': {a}.strand, 'frag': {a}.frag || '.' || {b}.frag}}"
    here = "{'chr': x.chr, 'start': x.start, 'end': x.\"end\", 'strand': x.strand, 'frag': x.frag}"
    on = dict(a="cur", b="x")
    return f"""sized as (select *, count(*) over (partition by circ_id) as m from piece),
 fold(circ_id, i, m, done, cur) as (select circ_id, i, m, {here}[1:0] , {here} from sized x where i = 0
   union all select f.circ_id, x.i, f.m, case when {meet.format(**on)} then done else list_append(done, cur) end, case when {meet.format(**on)} then {join.format(**on)} else {here} end from fold f join sized x on x.circ_id = f.circ_id and x.i = f.i + 1),
 closed as (select f.circ_id, f.m, case when f.m > 1 and {meet.format(a="cur", b="x")} then list_append(done[2:], {join.format(**on)}) else list_append(done, cur) end as conf from fold f join sized x on x.circ_id = f.circ_id and x.i = 0 where f.i = f.m - 1)""".replace("{'chr': x.chr, 'start': x.start, 'end': x.\"end\", 'strand': x.strand, 'frag': x.frag}[1:0]", "[{'chr': x.chr, 'start': x.start, 'end': x.\"end\", 'strand': x.strand, 'frag': x.frag}][2:]")


FOLDED = _fold(10) + """, flat as (select circ_id, unnest(conf) as c, unnest(range(len(conf))) as i from closed), coll as (select circ_id, i, c.chr as chr, c.start as start, c."end" as "end", c.strand as strand, c.frag as frag from flat), """ + PAIRS.replace("from piece", "from coll")


@query(duck("piece", more=FOLDED) + f"select circ_id, size_mb, chr_origin, case when size_mb > 0.01 then 'ecDNA' else '' end as label, topology_idx, ({NAMES})[topology_idx + 1] as topology_name from idx")
def annotate_circles(spark, d):
    x = annotate.annotated(_conf(spark, d).withColumn("score", F.lit(1.0)), Config(ecdna_min_mb=0.01))
    return x.select("circ_id", "size_mb", "chr_origin", "label", "topology_idx", "topology_name")


@query(duck("piece", more=FOLDED) + f"select circ_id, chr_origin, size_mb as \"size(MB)\", case when size_mb > 0.01 then 'ecDNA' else '' end as label, topology_idx, ({NAMES})[topology_idx + 1] as topology_name, circ_id % 83 as estimated_proportions from idx")
def summary_table(spark, d):
    c = _conf(spark, d).withColumns({"score": F.col("circ_id") % 83 + F.lit(0.5), "ord": F.col("circ_id")})
    return annotate.summary(annotate.annotated(c, Config(ecdna_min_mb=0.01)))


@query(duck("piece", more=PAIRS) + "select cast(circ_id as varchar) as circ_id, size_mb as length_mb, topology_idx from idx")
def bed_circles(spark, d):
    rows = spark_view(spark, d, "piece").select("circ_id", F.col("i").alias("row"), "chr", "start", "end", "strand", F.col("frag").alias("fragment_id"), F.col("cov").alias("coverage"))
    return validate.circles_of_bed(rows).select("circ_id", "length_mb", "topology_idx")


@query(duck("piece", more=_fold(400)) + """select circ_id, m as n_before, len(conf) as n_after, array_to_string(list_transform(conf, lambda x: x.chr || ':' || x.start || ':' || x."end" || ':' || x.strand || ':' || x.frag), ';') as conf from closed""")
def path_collapse(spark, d):
    c = _conf(spark, d).select("circ_id", F.size("conf").alias("n_before"), paths.collapse(F.col("conf"), 400).alias("conf"))
    return c.select("circ_id", "n_before", F.size("conf").alias("n_after"), F.array_join(F.transform("conf", lambda x: F.concat_ws(":", x["chr"], x["start"], x["end"], x["strand"], x["frag"])), ";").alias("conf"))


BED = """scored as (select circ_id, (circ_id * 7) % 83 + 0.5 as score from piece group by 1),
 kept as (select circ_id, cast(floor(score) as bigint) as s from scored where floor(score) >= 20),
 bed as (select row_number() over (order by s desc, circ_id, i) as "row", chr, start, "end", circ_id, frag as fragment_id, strand, cast(floor(cov) as bigint) as coverage, s as estimated_proportions from piece join kept using (circ_id))"""


def _bed(spark, d):
    c = _conf(spark, d).withColumns({"score": (F.col("circ_id") * 7) % 83 + F.lit(0.5), "ord": F.col("circ_id"), "label": F.lit("")})
    return annotate.bed(c, least_score=20)


@query(duck("piece", more=BED) + "select * from bed")
def circle_bed(spark, d):
    return _bed(spark, d)


@query(duck("piece", more=BED) + """, nxt as (select "row" as n1, coalesce(lead("row") over w, first_value("row") over w) as n2, strand, coalesce(lead(strand) over w, first_value(strand) over w) as s2, circ_id from bed
   window w as (partition by circ_id order by "row" rows between unbounded preceding and unbounded following))
 select n1, n2, case when strand = '+' then 1 else 0 end as n1_side, case when s2 = '+' then 0 else 1 end as n2_side, circ_id from nxt""")
def circle_links(spark, d):
    return annotate.links(_bed(spark, d))


@query(duck("path_step", "part_fragment") + """, step as (select circ_id, i, x, f.chr, f.start, f."end", f.coverage from path_step join part_fragment f on f.fid = 4 * (abs(x) - 1) + 1)
 select circ_id, count(*) as n, string_agg(concat(chr, ':', start, '-', "end", case when x < 0 then '-' else '+' end), ';' order by i) as conf from step group by 1""")
def circle_positions(spark, d):
    f = spark_view(spark, d, "part_fragment")
    c = _paths(spark, d).select("circ_id", F.transform("path", lambda x: F.signum(x).cast("bigint") * (4 * (F.abs(x) - 1) + 1)).alias("path"))
    x = annotate.located(c, f)
    return x.select("circ_id", F.size("conf").alias("n"), F.array_join(F.transform("conf", lambda p: F.concat(genomics.coordinates(p["chr"], p["start"], p["end"]), p["strand"])), ";").alias("conf"))


@query("""with g as (select concat('chr', n_nationkey) as chr, repeat(concat(upper(translate(n_name, 'bdefhijklmopqrsuvwxyzBDEFHIJKLMOPQRSUVWXYZ ', 'acgtacgtacgtacgtacgtacgtacgtacgtacgtacgta')), 'ACGTTGCA'), 20) as seq from nation),
 p as (select l_orderkey as circ_id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) as r, concat('chr', l_partkey % 25) as chr, l_suppkey % 60 as s, l_suppkey % 60 + 4 + l_partkey % 11 as e, l_returnflag = 'R' as minus from lineitem)
 select circ_id, string_agg(case when minus then reverse(translate(substring(seq, s + 1, e - s), 'ACGT', 'TGCA')) else substring(seq, s + 1, e - s) end, '' order by r) as seq from p join g using (chr) group by 1""")
def circle_sequence(spark, d):
    read = lambda t: spark.read.parquet(f"{d}/{t}.parquet")
    g = spark.sql("select concat('chr', n_nationkey) as chr, repeat(concat(upper(translate(n_name, 'bdefhijklmopqrsuvwxyzBDEFHIJKLMOPQRSUVWXYZ ', 'acgtacgtacgtacgtacgtacgtacgtacgtacgtacgta')), 'ACGTTGCA'), 20) as seq from {nation}", nation=read("nation"))
    p = spark.sql("select l_orderkey as circ_id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) as row, concat('chr', l_partkey % 25) as chr, l_suppkey % 60 as start, l_suppkey % 60 + 4 + l_partkey % 11 as `end`, case when l_returnflag = 'R' then '-' else '+' end as strand from {lineitem}", lineitem=read("lineitem"))
    return sequences.whole(sequences.circle_blocks(p, sequences.of_whole(g, "chr", 64), 64), "circ_id")


# a genome of which every part gives 32 bases, and a circle of three of its stretches for each supplier
GENOME = """genome as (select concat('chr', (p_partkey - 1) % 25) as chr, string_agg(translate(md5(cast(p_partkey as varchar)), '0123456789abcdef', 'ACGTACGTACGTACGT'), '' order by p_partkey) as seq from part group by 1),
 stretch as (select s_suppkey, i, concat('chr', (s_suppkey * 7 + i * s_nationkey) % 25) as chr, (s_suppkey * 13 + i * 101) % 1500 as start, (s_suppkey * 13 + i * 101) % 1500 + 40 + (s_suppkey + i * 17) % 120 as "end", (s_suppkey + i) % 3 = 0 as minus
  from supplier cross join (values (0), (1), (2)) v(i))"""


def _genome(spark, d, size):
    text = "select concat('chr', (p_partkey - 1) % 25) as chr, ((p_partkey - 1) div 25) * 32 as at, translate(md5(cast(p_partkey as string)), '0123456789abcdef', 'ACGTACGTACGTACGT') as s from {part}"
    return sequences.to_blocks(spark.sql(text, part=spark.read.parquet(f"{d}/part.parquet")), "chr", size)


def _stretches(spark, d):
    text = """select s_suppkey as circ_id, i as row, concat('chr', (s_suppkey * 7 + i * s_nationkey) % 25) as chr, (s_suppkey * 13 + i * 101) % 1500 as start, (s_suppkey * 13 + i * 101) % 1500 + 40 + (s_suppkey + i * 17) % 120 as `end`,
      case when (s_suppkey + i) % 3 = 0 then '-' else '+' end as strand from {supplier} lateral view explode(array(0, 1, 2)) v as i"""
    return spark.sql(text, supplier=spark.read.parquet(f"{d}/supplier.parquet"))


CIRCLES = GENOME + """, cut as (select s_suppkey, i, minus, substring(seq, start + 1, "end" - start) as s from stretch join genome using (chr)),
 circle as (select s_suppkey as circ_id, string_agg(case when minus then reverse(translate(s, 'ACGT', 'TGCA')) else s end, '' order by i) as seq from cut group by 1)"""


@query("with " + CIRCLES + " select circ_id, j as block, substring(seq, 64 * j + 1, 64) as seq from (select circ_id, seq, unnest(range(0, cast(ceil(length(seq) / 64.0) as bigint))) as j from circle) t where length(seq) > 0")
def circle_blocks(spark, d):
    """Each circle's sequence in blocks of 64 bases, from a genome in such blocks."""
    return sequences.circle_blocks(_stretches(spark, d), _genome(spark, d, 64), 64)


@query("with " + CIRCLES + """, turned as (select circ_id, '+' as strand, seq, 0 as shift from circle union all select circ_id, '-', reverse(translate(seq, 'ACGT', 'TGCA')), length(seq) from circle),
 qw as (select circ_id, strand, shift, j, substring(seq, j + 1, 16) as w from (select *, unnest(range(0, length(seq) - 15)) as j from turned) t),
 sw as (select chr, j, substring(seq, j + 1, 16) as w from (select *, unnest(range(0, length(seq) - 15)) as j from genome) t),
 met as (select circ_id, chr, strand, s.j - q.j + shift as diagonal, q.j - shift as q from qw q join sw s using (w)),
 island as (select *, q - row_number() over (partition by circ_id, chr, strand, diagonal order by q) as g from met)
 select cast(circ_id as varchar) as qseqid, chr as sseqid, strand, diagonal, min(q) as q_start, max(q) + 16 as q_end from island group by circ_id, chr, strand, diagonal, g""")
def sequence_matches(spark, d):
    """The longest exact matches of all circles with the whole genome, on both strands."""
    genome = durable(_genome(spark, d, 256))
    return alignment.matches(sequences.circle_blocks(_stretches(spark, d), genome, 256), genome, k=16, size=256, subject_key="chr")


# validation ----------------------------------------------------------------------------------------------------

HITS = """hit as (select concat('q', l_orderkey) as qseqid, concat('s', l_suppkey % 3) as sseqid, 85.0 + l_partkey % 15 as pident, 800.0 + l_partkey % 900 as bitscore, l_partkey % 900 as query_start, l_partkey % 900 + 20 + l_suppkey % 80 as query_end,
  l_linenumber as subject_start, l_linenumber + case when l_suppkey % 9 = 0 then -1 else 5 end as subject_end from lineitem),
 good as (select qseqid, sseqid, greatest(1, query_start) as s, least(700, query_end) as e from hit where pident >= 90 and bitscore >= 1000 and subject_start < subject_end),
 isl as (select *, max(e) over (partition by qseqid, sseqid order by s, e rows between unbounded preceding and 1 preceding) as reach from good)"""


def _identity(spark, d):
    text = HITS.split(" as (", 1)[1].split("),\n good", 1)[0].replace("from lineitem", "from {lineitem}")
    h = spark.sql(text, lineitem=spark.read.parquet(f"{d}/lineitem.parquet"))
    return validate.identity(validate.good_hits(h), h.select("qseqid").distinct().withColumn("length", F.lit(700)))


@query("with " + HITS + " select qseqid, sseqid, sum(greatest(0, e - greatest(s, coalesce(reach, s)))) / cast(699 as double) as identity from isl group by 1, 2")
def interval_identity(spark, d):
    return _identity(spark, d)


@query("""with iv as (select concat('chr', 1 + p_partkey % 22) as chr, (p_partkey * 7919) % 100000 as start, (p_partkey * 7919) % 100000 + 10 + p_size * 7 as "end", p_partkey from part),
 sv as (select concat('chr', 1 + s_suppkey % 22) as chr, (s_suppkey * 104729) % 100000 as r_start, (s_suppkey * 104729) % 100000 + 900 as r_end, s_suppkey from supplier)
 select p_partkey, s_suppkey, least("end", r_end) - greatest(start, r_start) as bases from iv join sv using (chr) where start < r_end and r_start < "end\"""")
def interval_overlap(spark, d):
    read = lambda t: spark.read.parquet(f"{d}/{t}.parquet")
    a = spark.sql("select concat('chr', 1 + p_partkey % 22) as chr, (p_partkey * 7919) % 100000 as start, (p_partkey * 7919) % 100000 + 10 + p_size * 7 as `end`, p_partkey from {part}", part=read("part"))
    b = spark.sql("select concat('chr', 1 + s_suppkey % 22) as chr, (s_suppkey * 104729) % 100000 as r_start, (s_suppkey * 104729) % 100000 + 900 as r_end, s_suppkey from {supplier}", supplier=read("supplier"))
    return overlap_join(a, b, bin_size=1000).select("p_partkey", "s_suppkey", (F.least("end", "r_end") - F.greatest("start", "r_start")).alias("bases"))


@query(duck("cut", "sv", "coverage", "chrom", more=CUTS) + """, pt as (select ord, chr1 as chr, (pos1 * 3) % 120000 as pos from sv)
 select ord, f.fid from pt p asof left join frag f on p.chr = f.chr and p.pos >= f.start""")
def point_stab(spark, d):
    anchors = spark_view(spark, d, "cut")
    frags = fragments.fragment(breakpoints.kept_anchors(anchors, anchors.select("chr", "pos", F.col("pos").alias("anchor")).distinct()))
    pts = spark_view(spark, d, "sv").select("ord", F.col("chr1").alias("chr"), ((F.col("pos1") * 3) % 120000).alias("pos"))
    return stab_join(pts, frags, F.col("pos"), "f", ["fid"]).select("ord", F.col("f.fid").alias("fid"))


@query(duck("coverage", "chrom", "cut", more=CUTS) + """, t as (select sum("end" - start) as tl, sum(coverage) as tc from covered where "end" < 100000000000 and coverage < cast('inf' as double))
 select fid, (1 - ("end" - start) / tl) * (coverage / tc) as weight from covered, t where "end" < 100000000000 and coverage < cast('inf' as double)""")
def fragment_weights(spark, d):
    return quantify.fragment_weights(_covered(spark, d).where((F.col("coverage") < inf) & (F.col("end") < FAR_END)))


BOTH_HITS = """th as (select concat('t', l_partkey % 25) as q, concat('r', l_suppkey) as s, greatest(1, l_partkey % 900) as a, least(700, l_partkey % 900 + 20 + l_suppkey % 80) as e from lineitem),
 rh as (select concat('r', l_suppkey) as q, concat('t', l_partkey % 25) as s, greatest(1, l_orderkey % 900) as a, least(500, l_orderkey % 900 + 30) as e from lineitem),
 ti as (select *, max(e) over (partition by q, s order by a, e rows between unbounded preceding and 1 preceding) as reach from th),
 ri as (select *, max(e) over (partition by q, s order by a, e rows between unbounded preceding and 1 preceding) as reach from rh),
 tp as (select q, s, sum(greatest(0, e - greatest(a, coalesce(reach, a)))) / cast(699 as double) as p from ti group by 1, 2),
 rp as (select q, s, sum(greatest(0, e - greatest(a, coalesce(reach, a)))) / cast(499 as double) as p from ri group by 1, 2)"""


@query("with " + BOTH_HITS + """ select concat('t', n_nationkey) as true_id, cast(n_nationkey / 100.0 as double) as true_len, n_nationkey % 7 as true_topology, concat('r', s_suppkey) as reconstruct_id, cast(s_suppkey / 50.0 as double) as reconstruct_len, s_suppkey % 7 as reconstruct_topology,
  coalesce(tp.p, 0) as pident_true, coalesce(rp.p, 0) as pident_reconstruct from nation cross join supplier left join tp on tp.q = concat('t', n_nationkey) and tp.s = concat('r', s_suppkey) left join rp on rp.s = concat('t', n_nationkey) and rp.q = concat('r', s_suppkey)""")
def validation_table(spark, d):
    """Nations as true circles, suppliers as reconstructed ones, lines as hits of either on the other."""
    read = lambda t: spark.read.parquet(f"{d}/{t}.parquet")
    circle = lambda df, key, letter, per: df.select(F.concat(F.lit(letter), F.col(key)).alias("circ_id"), (F.col(key) / per).cast("double").alias("length_mb"), (F.col(key) % 7).alias("topology_idx"))
    hit = lambda q, s, at, width: read("lineitem").select(q.alias("qseqid"), s.alias("sseqid"), at.alias("query_start"), (at + width).alias("query_end"))
    t, r = F.concat(F.lit("t"), F.col("l_partkey") % 25), F.concat(F.lit("r"), F.col("l_suppkey"))
    size = lambda df, n: df.select(F.col("circ_id").alias("qseqid"), F.lit(n).alias("length"))
    true, found = circle(read("nation"), "n_nationkey", "t", 100.0), circle(read("supplier"), "s_suppkey", "r", 50.0)
    one = validate.identity(hit(t, r, F.col("l_partkey") % 900, 20 + F.col("l_suppkey") % 80), size(true, 700))
    two = validate.identity(hit(r, t, F.col("l_orderkey") % 900, F.lit(30)), size(found, 500))
    return validate.compare(true, found, one, two)


# dialects of calls --------------------------------------------------------------------------------------------------

MATES = """case k % 4 when 0 then concat('[', m, ':', p, '[N') when 1 then concat(']', m, ':', p, ']N') when 2 then concat('N[', m, ':', p, '[') else concat('N]', m, ':', p, ']') end"""
KEYS = "(select c_custkey as k, concat('chr', 1 + c_custkey % 22) as c, concat('chr', 1 + c_custkey % 19) as m, 5000 + 3 * c_custkey as p, case when c_custkey % 2 = 0 then '+-' else '-+' end as st, c_custkey % 3 = 0 as broken from {customer}) q"
BROKEN = "case k % 4 when 0 then '++' when 1 then '+-' when 2 then '-+' else '--' end"
GT = "case when {x} <= 0.3 then '0/0' when {x} <= 0.7 then '0/1' else '1/1' end"


def _lines_of(info: str, sample: str) -> str:
    """A VCF line for each customer: one in three a break end, the others duplications."""
    return f"select k as ord, concat(c, '\t', 100 + k, '\t', 'id', k, '\tN\t', case when broken then {MATES} else '<DUP>' end, '\t.\tPASS\t', 'SVTYPE=', case when broken then 'BND' else 'DUP' end, ';END=', 9000 + k, ';SVLEN=', k % 777, {info}, '\t', {sample}) as value from {KEYS}"


def _calls_of(caller: str, info: str, sample: str, **want: str):
    """Registers the query of a caller's dialect: its lines, and what becomes of them."""
    lines = _lines_of(info, sample)
    held = dict(chr2="case when broken then m else c end", pos2="case when broken then p else 9000 + k end", strand=f"case when broken then {BROKEN} else st end", gt="'0/1'") | want

    def run(spark, d):
        config = Config(sv_caller="sniffles1" if caller == "multivcf" else caller, multi=caller == "multivcf")
        df = spark.sql(lines, customer=_customers(spark, d))
        sv = vcf.normalise(vcf.parse(vcf.clean_lines(df, config.multi)), config)
        return sv.select("ord", "chr1", "pos1", "chr2", "pos2", "svtype", "svlen", "strand", "dv", "dr", "gt", "error")

    run.__name__ = f"vcf_{caller}"
    query(f"select k as ord, c as chr1, 100 + k as pos1, {held['chr2']} as chr2, {held['pos2']} as pos2, case when broken then 'BND' else 'DUP' end as svtype, k % 777 as svlen, {held['strand']} as strand, {held['dv']} as dv, {held['dr']} as dr, {held['gt']} as gt, {held.get('error', 'cast(null as varchar)')} as error from {KEYS.replace('{customer}', 'customer')}")(run)


_calls_of("sniffles2", "';SUPPORT=', k % 31, ';COVERAGE=', k % 17, ',9,8;STRAND=', st", "concat('GT:GQ:DR:DV\t', case when k % 5 = 0 then './.' else '0/1' end, ':60:', k % 13, ':', k % 29)",
          dv="case when k % 5 = 0 then k % 31 else k % 29 end", dr="case when k % 5 = 0 then k % 17 else k % 13 end", gt="case when k % 5 = 0 then " + GT.format(x="(k % 31) / (k % 31 + k % 17 + 1)") + " else '0/1' end")
_calls_of("cutesv", "case when broken then '' else concat(';STRAND=', st) end", "concat('GT:DR:DV:PL:GQ\t0/1:', k % 13, ':', k % 29, ':1,2,3:9')", dv="k % 29", dr="k % 13")
_calls_of("nanomonsv", "''", "concat('TR:VR\t', k % 29 + k % 13, ':', k % 29)", dv="k % 29", dr="k % 13", strand=f"case when broken then {BROKEN} else '.' end", gt="cast(null as varchar)")
_calls_of("lumpy", "';STRANDS=', st, ':12'", "concat('GT:QA:QR:DP\t', case when k % 5 = 0 then './.' else '0/1' end, ':', k % 29, ':', k % 13, ':', k % 41)", dv="k % 29", dr="k % 13", gt="case when k % 5 = 0 then " + GT.format(x="(k % 29) / (k % 41 + 1)") + " else '0/1' end")
_calls_of("delly", "';CHR2=', m, ';STRAND=', st", "concat('GT:DR:DV\t0/1:', k % 13, ':', k % 29)", dv="k % 29", dr="k % 13", chr2="m", pos2="9000 + k", strand="st")
_calls_of("multivcf", "';CHR2=', m, ';STRANDS=', st", "concat('GT:DR\t./.:', k % 13, ',', k % 29, '\t1/1:3,', k % 23)", dv="greatest(k % 29, k % 23)", dr="case when k % 29 >= k % 23 then k % 13 else 3 end", gt="case when k % 29 >= k % 23 then './.' else '1/1' end", chr2="m", pos2="9000 + k", strand="st")

FAULTY = _lines_of("case when k % 5 = 0 then '' else ';STRANDS=+-' end, ';CHR2=', c", "concat('GT:DR:DV\t0/1:', k % 13, ':', case when k % 7 = 0 then '.' else cast(k % 97 as {string}) end)")


def _faulty(spark, d):
    return spark.sql(FAULTY.replace("{string}", "string"), customer=_customers(spark, d))


@query(f"select k as ord, concat('id', k) as sv_id, case when k % 5 = 0 then 'sniffles1: a record has no STRANDS' else '{vcf.NO_GENOTYPE}' end as error from {KEYS.replace('{customer}', 'customer')} where k % 5 = 0 or k % 7 = 0")
def vcf_bad_records(spark, d):
    return vcf.bad_records(vcf.clean_lines(_faulty(spark, d)))


@query("with line as (" + FAULTY.replace("{string}", "varchar").replace("{customer}", "customer") + """) select line.ord, value from line join (select c_custkey as ord, c_custkey % 97 as dv, c_custkey % 13 as dr, c_custkey % 777 as svlen, c_custkey % 3 = 0 as broken from customer where c_custkey % 5 <> 0 and c_custkey % 7 <> 0) x using (ord)
  where dv + dr >= 8 and dv >= 6 and dv / (dv + dr + 1) >= 0.01 and (broken or svlen >= 500) and pow(3, -(dv + dr) * (dv / (dv + dr + 1)) / ln(dv + dr + 0.001)) < 0.1""")
def vcf_filter(spark, d):
    """Records that lack something are left out, the others pass by the quality rules."""
    return vcf.filter_lines(vcf.clean_lines(_faulty(spark, d)), skip_bad=True)


@query("select concat('n', n_nationkey) as chr, repeat('ACGTTGCA', 1 + n_nationkey) || 'N' as seq from nation")
def fasta_records(spark, d):
    text = "select concat('n', n_nationkey, ' ', n_name, '\n', repeat('ACGT\nTGCA\n', int(1 + n_nationkey)), 'N\n') as value from {nation}"
    return tables.fasta_records(spark.sql(text, nation=spark.read.parquet(f"{d}/nation.parquet")))


@query("""with line as (select c_nationkey % 3 as file, c_custkey % 100 as n, case when c_custkey % 13 = 1 then concat('>c', c_custkey, ' x') else translate(md5(cast(c_custkey as varchar)), '0123456789abcdef', 'ACGTACGTACGTACGT') end as value, c_custkey // 100 as split from customer),
 named as (select *, last_value(case when value like '>%' then regexp_extract(value, '^>(\\S+)', 1) end ignore nulls) over (partition by file order by split, n rows between unbounded preceding and current row) as chr from line),
 record as (select chr, string_agg(value, '' order by split, n) as seq from named where value not like '>%' and chr is not null group by chr)
 select chr, j as block, substring(seq, 100 * j + 1, 100) as seq from (select chr, seq, unnest(range(0, cast(ceil(length(seq) / 100.0) as bigint))) as j from record) t""")
def fasta_blocks(spark, d):
    """Customers as lines of three FASTA files, a hundred of each in a split; records in blocks of 100 bases."""
    text = "select c_nationkey % 3 as file, c_custkey % 100 as n, case when c_custkey % 13 = 1 then concat('>c', c_custkey, ' x') else translate(md5(cast(c_custkey as string)), '0123456789abcdef', 'ACGTACGTACGTACGT') end as value, c_custkey div 100 as split from {customer}"
    return sequences.fasta_blocks(spark.sql(text, customer=spark.read.parquet(f"{d}/customer.parquet")), 100)


@query(duck("sv") + "select ord, abs(pos1 - pos2) <= 60000 as near from sv")
def proximity(spark, d):
    return spark_view(spark, d, "sv").select("ord", genomics.within(F.col("pos1"), F.col("pos2"), 60_000).alias("near"))


# regressions, densities, circuits, alignments of circles ------------------------------------------------------

PAIRED = """owned as (select *, (m - 1 + (m - 1) % 2) / 2 as p from order_fragment),
 total as (select grp, m, m + 1.0 as n, sum(coverage) + 4.0312953 as y, min(coverage) as least_y, max(p) + 1.0 as a, m - max(p) + 0.0 as b, sum(case when n <= p or n = m then coverage else 0 end) as sa, sum(case when n > p then coverage else 0 end) as sb from owned group by grp, m),
 system as (select *, a - a * a / n as ga, b - b * b / n as gb, 1 - a * b / n as g, sa - a * y / n - 0.1 * n as ba, sb - b * y / n - 0.1 * n as bb from total),
 free as (select *, case when m > 1 then (ba * gb - bb * g) / (ga * gb - g * g) else 100 end as fa, case when m > 1 then (bb * ga - ba * g) / (ga * gb - g * g) else 100 end as fb from system),
 one as (select *, fa >= 0 and fb >= 0 as inner_point, greatest(0, ba / ga) as only_a, greatest(0, bb / gb) as only_b from free where m > 1),
 weight as (select grp, least_y, case when inner_point then fa when bb - g * only_a <= 1e-9 then only_a else 0 end as wa, case when inner_point then fb when bb - g * only_a <= 1e-9 then 0 else only_b end as wb from one),
 kept as (select grp, wa, wb, greatest(least_y / 5, 10) as cutoff from weight)"""


@query(duck("order_fragment", more=PAIRED.replace("(m - 1 + (m - 1) % 2) / 2 as p", "(m - 1 + (m - 1) % 2) // 2 as p")) + """select 2 * grp as circ_id, round(wa, 3) as score from kept where wa >= cutoff or wb < cutoff
 union all select 2 * grp + 1, round(wb, 3) from kept where wb >= cutoff or wa < cutoff
 union all select 2 * grp + i, 100 from total cross join (values (0), (1)) v(i) where m = 1""")
def shared_abundance(spark, d):
    """Every order is two circles: one passes the first half of its fragments, one the others, and both the last one. With two columns the
    regression has a closed solution; the descent is run until nothing moves. The genome's mean is no whole number, so that no
    weight falls just on the cutoff."""
    f = spark_view(spark, d, "order_fragment")
    p = F.floor((F.col("m") - 1 + (F.col("m") - 1) % 2) / 2)
    side = lambda k, own: f.where(own | (F.col("n") == F.col("m"))).groupBy((2 * F.col("grp") + k).alias("circ_id")).agg(F.array_sort(F.collect_list("fid")).alias("path"))
    circles = side(0, F.col("n") <= p).unionByName(side(1, F.col("n") > p))
    return quantify.abundance(circles, f, 4.0312953, Config(lasso_steps=80, lasso_tolerance=0.0)).select("circ_id", F.round("score", 3).alias("score"))


MODELS = """x as (select l_suppkey as k, cast(l_quantity as double) as a, cast(l_linenumber as double) as b, cast(l_partkey % 40 as double) as c, 3 * cast(l_quantity as double) + l_linenumber * (l_suppkey % 5) + l_orderkey % 11 as y from lineitem),
 g as (select k, sum(a * a) - sum(a) * sum(a) / count(*) as aa, sum(a * b) - sum(a) * sum(b) / count(*) as ab, sum(a * c) - sum(a) * sum(c) / count(*) as ac, sum(b * b) - sum(b) * sum(b) / count(*) as bb, sum(b * c) - sum(b) * sum(c) / count(*) as bc,
   sum(c * c) - sum(c) * sum(c) / count(*) as cc, sum(a * y) - sum(a) * sum(y) / count(*) as ay, sum(b * y) - sum(b) * sum(y) / count(*) as bby, sum(c * y) - sum(c) * sum(y) / count(*) as cy from x group by 1),
 m as (select k, model, aa + r as aa, ab, ac, bb + r as bb, bc, cc + r as cc, ay, bby as yb, cy from g cross join (values ('linear', 0.0), ('ridge', 1.0)) v(model, r)),
 det as (select *, aa * (bb * cc - bc * bc) - ab * (ab * cc - bc * ac) + ac * (ab * bc - bb * ac) as d from m)"""


@query("with " + MODELS + """ select k, model, round((ay * (bb * cc - bc * bc) - ab * (yb * cc - bc * cy) + ac * (yb * bc - bb * cy)) / d, 5) as w1,
  round((aa * (yb * cc - bc * cy) - ay * (ab * cc - bc * ac) + ac * (ab * cy - yb * ac)) / d, 5) as w2, round((aa * (bb * cy - yb * bc) - ab * (ab * cy - yb * ac) + ay * (ab * bc - bb * ac)) / d, 5) as w3 from det""")
def linear_models(spark, d):
    """Least squares and ridge fits of three features for each supplier's lines."""
    x = spark.sql("select l_suppkey as k, l_quantity as a, l_linenumber as b, l_partkey % 40 as c, 3 * cast(l_quantity as double) + l_linenumber * (l_suppkey % 5) + l_orderkey % 11 as y from {lineitem}", lineitem=spark.read.parquet(f"{d}/lineitem.parquet"))
    f = quantify.linear_models(x, "k", ["a", "b", "c"], "y").where("model <> 'lasso'")
    return f.select("k", "model", *[F.round(F.get("coefficients", F.lit(i)), 5).alias(f"w{i + 1}") for i in range(3)])


@query("""with v as (select l_partkey * cast(floor(l_quantity) as bigint) as v from lineitem),
 x as (select v - v % cast(pow(10, greatest(0, len(cast(v as varchar)) - 3)) as bigint) as cell, log10(v + 0.01) as x from v where v >= 0),
 c as (select count(*) as c, avg(x) as x, sum(x * x) as xx, min(x) as lo, max(x) as hi from x group by cell),
 w as (select sum(c) as n, sum(c * x) / sum(c) as mean, sum(xx) as xx, min(lo) as lo, max(hi) as hi from c),
 h as (select *, sqrt((xx - n * mean * mean) / (n - 1)) * pow(n, -0.2) as h from w),
 grid as (select k as point, n, h, lo + (hi - lo) * k / 199 as g from h, (select unnest(range(0, 200)) as k) r)
 select point, round(first(pow(10, g)), 4) as at, round(sum(c * exp(-pow((g - x) / h, 2) / 2)) / first(n * h * sqrt(2 * pi())), 6) as density from c, grid group by point""")
def value_density(spark, d):
    v = spark.read.parquet(f"{d}/lineitem.parquet").select((F.col("l_partkey") * F.floor("l_quantity")).cast("double").alias("v"))
    return quantify.density(v, "v").select("point", F.round("at", 4).alias("at"), F.round("density", 6).alias("density"))


OUT = "case when {0} % 4 = 3 then {0} - 2 else 1 - {0} end"
WALK = f""", mv as (select {OUT.format("u")} as a, -({OUT.format("v")}) as b from oedge union select {OUT.format("v")}, -({OUT.format("u")}) from oedge),
 walk(root, tip, path, done) as (select distinct a, a, [a], false from mv where a > 0 union all
   select root, b, case when b = root then path else list_append(path, b) end, b = root from walk join mv on tip = a where not done and (b = root or (abs(b) > root and not list_contains(path, b) and not list_contains(path, -b))))"""


@query(duck("order_fragment", more=OEDGE) + WALK + " select distinct array_to_string(path, ',') as path from walk where done")
def elementary_circuits(spark, d):
    """All ways round the graph of the orders that pass no fragment twice."""
    return circuits.circuits(*_order_graph(spark, d)).select(_text(F.col("path")).alias("path"))


@query(duck("order_fragment", more="""near as (select a.fid, avg(b.coverage) as around from order_fragment a join order_fragment b on a.grp = b.grp and abs(a.n - b.n) in (1, 2) group by 1)""") + """select f.fid, case when f.fid % 5 = 1 then 'tandem duplication' end as loop,
  case when f.fid % 5 = 1 then greatest(2, cast(round(coverage / coalesce(around, 24.0)) as int)) else 1 end as copies from order_fragment f left join near using (fid)""")
def loop_copies(spark, d):
    """Fragments that follow themselves, with the number of copies that their coverage tells; neighbours by edges are one or two lines away."""
    f, e = _order_graph(spark, d)
    return circuits.loops(f, e, 24.0)[0].select("fid", "loop", "copies")


ALIGN = """st as (select circ_id, list(abs(x) % 50 order by i) as p from path_step group by 1),
 fr as (select f, f % 3 as chr, (f % 7) * 1000 as s, (f % 7) * 1000 + 600 + (f % 5) * 400 as e, 600 + (f % 5) * 400 as w from (select unnest(range(0, 50)) as f) r),
 sm as (select x.f as f1, y.f as f2, case when x.f = y.f then 1.0 when x.chr <> y.chr then -2.0 when y.s <= x.s and x.s <= y.e then greatest(x.w, abs(x.s - y.e)) / cast(x.w as double)
   when x.s <= y.s and y.s <= x.e then greatest(y.w, abs(y.s - x.e)) / cast(x.w as double) else -2.0 end as sim from fr x cross join fr y),
 pr as (select a.circ_id as a, b.circ_id as b, a.p as x, b.p as y, len(a.p) as nx, len(b.p) as ny, list_transform(a.p, lambda f: 600.0 + (f % 5) * 400) as wx, list_transform(b.p, lambda f: 600.0 + (f % 5) * 400) as wy from st a join st b on b.circ_id = a.circ_id + 1),
 cell(a, x, y, nx, ny, k, t) as (select a, x, y, nx, ny, 0, [cast(-1 as double)] from pr union all
   select a, x, y, nx, ny, k + 1, list_append(t, cast(case when (k + 1) // (ny + 1) = 0 then t[k + 1] - 1 when (k + 1) % (ny + 1) = 0 then t[((k + 1) // (ny + 1) - 1) * (ny + 1) + 1] - 1
     else greatest(t[((k + 1) // (ny + 1) - 1) * (ny + 1) + (k + 1) % (ny + 1) + 1] - 1, t[k + 1] - 1, t[((k + 1) // (ny + 1) - 1) * (ny + 1) + (k + 1) % (ny + 1)] + sim) end as double))
   from cell left join sm on f1 = x[(k + 1) // (ny + 1)] and f2 = y[(k + 1) % (ny + 1)] where k + 1 < (nx + 1) * (ny + 1)),
 done as (select c.a, pr.nx, pr.ny, wx, wy, t from cell c join pr using (a) where k + 1 = (c.nx + 1) * (c.ny + 1)),
 back(a, ny, wx, wy, t, i, j, s) as (select a, ny, wx, wy, t, nx, ny, cast(0 as double) from done union all
   select a, ny, wx, wy, t, case when i = 0 then i when j = 0 then i - 1 when di >= up and di >= le then i - 1 when up > di and up > le then i - 1 else i end,
     case when i = 0 then j - 1 when j = 0 then j when di >= up and di >= le then j - 1 when up > di and up > le then j else j - 1 end,
     s + case when i > 0 and j > 0 and di >= up and di >= le and t[i * (ny + 1) + j + 1] >= 0 then least(wx[i] / list_sum(wx), wy[j] / list_sum(wy)) else 0 end
   from (select *, t[(i - 1) * (ny + 1) + j] as di, t[(i - 1) * (ny + 1) + j + 1] as up, t[i * (ny + 1) + j] as le from back where i > 0 or j > 0) q)"""


@query(duck("path_step", more=ALIGN) + """select a, b, round(case when (nx = 1 or ny = 1) and not (nx = 1 and ny = 1 and x[1] = y[1]) then 0 else s end, 6) as score from pr join (select a, s from back where i = 0 and j = 0) z using (a)""")
def circle_alignment(spark, d):
    """Each circle aligned with the next one, over fifty fragments of which many overlap."""
    f = F.abs("x") % 50
    start = f % 7 * 1000
    step = spark_view(spark, d, "path_step").select("circ_id", "i", F.struct(f.alias("fid"), (f % 3).alias("chr"), start.alias("start"), (start + 600 + f % 5 * 400).alias("end")).alias("f"))
    c = step.groupBy("circ_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "f"))), lambda p: p["f"]).alias("p"))
    pairs = c.select(F.col("circ_id").alias("a"), F.col("p").alias("x")).join(c.select(F.col("circ_id").alias("b"), F.col("p").alias("y")), F.col("b") == F.col("a") + 1)
    return pairs.select("a", "b", F.round(similarity.aligned(F.col("x"), F.col("y")), 6).alias("score"))


ROUND = """turn as (select circ_id, unnest(list_concat(list_transform(range(1, len(p) + 1), lambda i: array_to_string(list_concat(p[i:], p[:i-1]), ',')), list_transform(range(1, len(p) + 1), lambda i: array_to_string(list_concat(q[i:], q[:i-1]), ',')))) as t
  from (select circ_id, p, list_reverse(list_transform(p, lambda x: -x)) as q from path) z), least_turn as (select circ_id, min(t) as t from turn group by 1)"""


@query(duck("path_step", more=f"{PATHS}, {ROUND}") + "select circ_id, min(circ_id) over (partition by t) as first, count(*) over (partition by t) as copies from least_turn")
def same_circle(spark, d):
    """Circles that are one another's rotations or opposite strands, told by a hash of all of these."""
    p = _paths(spark, d).select("circ_id", paths.meta_hash(F.col("path")).alias("h"))
    return p.join(p.groupBy("h").agg(F.min("circ_id").alias("first"), F.count("*").alias("copies")), "h").select("circ_id", "first", "copies")


@query(duck("order_fragment", more=OEDGE) + f"select edge_id, tail as u, head as v, {FRAGMENT} as svtype, cast('inf' as double) as weight from order_fragment union all select edge_id, u, v, svtype, weight from oedge")
def all_edges(spark, d):
    """Edges of fragments and of calls as one table."""
    f, e = _order_graph(spark, d)
    return graph.fragment_edges(f).unionByName(e.select("edge_id", "u", "v", "svtype", "weight"))


@query(duck("coverage", "chrom", "cut", more=CUTS) + """select fid, cast(floor(coverage * 2.5) as bigint) as coverage from covered where coverage < cast('inf' as double)""")
def upsampled(spark, d):
    """Coverage of fragments brought back to what it was before downsampling."""
    return annotate.fragments_bed(_covered(spark, d).where(F.col("coverage") < inf), ratio=2.5).select("fid", "coverage")
