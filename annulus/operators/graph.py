"""The fragment multigraph as relations: node = tail or head of a fragment, edge (edge_id, u, v, svtype, weight)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annulus.config import BND, DEL, DUP, FRAGMENT, HEAD, INS, INV, SPATIAL, TAIL
from annulus.operators.breakpoints import making
from annulus.operators.intervals import stab_join
from annulus.operators.lineage import durable
from annulus.operators.ordering import numbered


def joins_of(svtype: Column, strand: Column) -> Column:
    """array<struct(part1, part2, code)>: which ends a call ties together, and the edge's type.

    A break end is wired by its strands; INV ties heads and tails; INVDUP ties nothing.
    """
    tie = lambda a, b, code: F.struct(F.lit(a).alias("part1"), F.lit(b).alias("part2"), F.lit(code).alias("code"))
    broken = F.when(strand == "-+", F.array(tie(TAIL, HEAD, BND))).when(strand == "+-", F.array(tie(HEAD, TAIL, BND))).when(strand == "++", F.array(tie(HEAD, HEAD, BND))).otherwise(F.array(tie(TAIL, TAIL, BND)))
    return (
        F.when(svtype.isin("BND", "TRA"), broken)
        .when(svtype == "DEL", F.array(tie(HEAD, TAIL, DEL)))
        .when(svtype == "INS", F.array(tie(HEAD, TAIL, INS)))
        .when(svtype == "DUP", F.array(tie(TAIL, HEAD, DUP)))
        .when(svtype == "INV", F.array(tie(HEAD, HEAD, INV), tie(TAIL, TAIL, INV)))
    )


def nodes_at(merged: DataFrame, fragments: DataFrame, *, distance: int = 50) -> DataFrame:
    """``merged`` (chr, pos, anchor) with tail and head: the ends of fragments that a call at this position ties, null where no fragment holds them.

    A tail is that of the fragment holding the position 2 distance behind the anchor; a head that of the fragment holding the one as much before.
    """
    side = lambda part, at: F.struct(F.lit(part).alias("part"), (F.col("anchor") + at).cast("bigint").alias("at"))
    asked = merged.select("chr", "anchor").distinct().select("chr", "anchor", F.explode(F.array(side(TAIL, 2 * distance), side(HEAD, -2 * distance))).alias("e")).select("chr", "anchor", "e.*")
    found = stab_join(asked, fragments, F.col("at"), "f", ["tail", "head"])
    node = lambda part, c: F.max(F.when(F.col("part") == part, F.col(f"f.{c}"))).alias(c)
    return merged.select("chr", "pos", "anchor").join(found.groupBy("chr", "anchor").agg(node(TAIL, "tail"), node(HEAD, "head")), ["chr", "anchor"])


def sv_edges(sv: DataFrame, merged: DataFrame, fragments: DataFrame, *, distance: int = 50) -> DataFrame:
    """u, v, svtype, weight, chr (of u), and the order of making (key_ord, moved, ord, i): an edge for each tie of each call.

    Fragments are looked up for positions, of which there are no more than ends of calls; a call moves to those of its first end and then to those of its
    second. An end that no fragment holds makes no edge. What an edge's order is told by takes a further move, which isn't made where nobody asks for it.
    """
    nodes = durable(nodes_at(merged, fragments, distance=distance))  # read for both ends
    at = lambda k: nodes.select(*[F.col(c).alias(f"{c}{k}") for c in ("chr", "pos", "anchor", "tail", "head")])
    both = sv.select("ord", "chr1", "pos1", "chr2", "pos2", "svtype", "strand", "dv").join(at(1), ["chr1", "pos1"]).join(at(2), ["chr2", "pos2"])
    node = lambda k: F.when(F.col(f"t.part{k}") == TAIL, F.col(f"tail{k}")).otherwise(F.col(f"head{k}"))
    tied = making(both, "anchor1").select("*", F.posexplode(joins_of(F.col("svtype"), F.col("strand"))).alias("i", "t"))
    return tied.select(node(1).alias("u"), node(2).alias("v"), F.col("t.code").alias("svtype"), F.col("dv").cast("double").alias("weight"), F.col("chr1").alias("chr"), "key_ord", "moved", "ord", "i").where("u is not null and v is not null")


def spatial_edges(adjacent: DataFrame, spanning: DataFrame, *, wgs_mean: float, least: int = 4) -> DataFrame:
    """u, v, svtype, weight: head to tail of neighbours whose meeting point enough reads cross."""
    good = spanning.where((F.col("n") > least) & (F.col("n") > wgs_mean))
    x = adjacent.join(good, ["chr", "bp"])
    return x.select("fid1", (F.col("fid1") + 2).alias("u"), (F.col("fid2") + 1).alias("v"), F.lit(SPATIAL).alias("svtype"), F.col("n").cast("double").alias("weight"))


def fragment_edges(fragments: DataFrame) -> DataFrame:
    return fragments.select("edge_id", F.col("tail").alias("u"), F.col("head").alias("v"), F.lit(FRAGMENT).alias("svtype"), F.lit(float("inf")).alias("weight"))


def number(edges: DataFrame, order: list[str], first: int) -> DataFrame:
    """Edges with ids from ``first`` on in the given order."""
    return numbered(edges, order, "edge_id", first).select("edge_id", "u", "v", "svtype", "weight")


def both_ways(edges: DataFrame) -> DataFrame:
    """node, other, ...: each edge from both of its ends; a loop counts twice."""
    a = edges.select("edge_id", F.col("u").alias("node"), F.col("v").alias("other"), "svtype", "weight")
    return a.unionByName(edges.select("edge_id", F.col("v").alias("node"), F.col("u").alias("other"), "svtype", "weight"))


def degrees(edges: DataFrame) -> DataFrame:
    """node, degree: edges at each node but those of fragments."""
    return both_ways(edges.where(F.col("svtype") != FRAGMENT)).groupBy("node").agg(F.count("*").alias("degree"))


def standalone(fragments: DataFrame, edges: DataFrame) -> DataFrame:
    """Fragments neither of whose ends has an edge."""
    tied = edges.where(F.col("svtype") != FRAGMENT).select(F.explode(F.array("u", "v")).alias("node")).distinct()  # many edges share a node
    ends = fragments.select("fid", F.explode(F.array("tail", "head")).alias("node"))
    return without(fragments, ends.join(tied, "node", "left_semi"))


def without(fragments: DataFrame, gone: DataFrame) -> DataFrame:
    return fragments.join(gone.select("fid"), "fid", "left_anti")


def cover_filter(fragments: DataFrame, least: float, most: float) -> DataFrame:
    return fragments.where((F.col("coverage") >= least) & (F.col("coverage") <= most))


def surviving(edges: DataFrame, fragments: DataFrame) -> DataFrame:
    """Edges both of whose ends belong to the fragments."""
    nodes = fragments.select(F.explode(F.array("tail", "head")).alias("__node"))
    return edges.join(nodes, F.col("u") == F.col("__node"), "left_semi").join(nodes, F.col("v") == F.col("__node"), "left_semi")


def pairs(edges: DataFrame) -> DataFrame:
    """Edges with lo and hi, the smaller and the larger of their ends; an end that is null stays one of the two."""
    up = F.col("u") <= F.col("v")
    return edges.withColumns({"lo": F.when(up, F.col("u")).otherwise(F.col("v")), "hi": F.when(up, F.col("v")).otherwise(F.col("u"))})


def ends_of(fragments: DataFrame, *more: str) -> DataFrame:
    """node, mate (the other end of its fragment) and more, for each end of a fragment."""
    end = lambda a, b: F.struct(F.col(a).alias("node"), F.col(b).alias("mate"))
    return fragments.select(F.explode(F.array(end("tail", "head"), end("head", "tail"))).alias("e"), *more).select("e.node", "e.mate", *more)


def strongest(edges: DataFrame, fragments: DataFrame) -> DataFrame:
    """Of parallel edges between ends of different fragments the heaviest, the first of equals; all other edges stay.

    An edge's smaller end tells by its mate whether both are of one fragment, and parallel edges lie where it does; so edges move once to
    be ranked, and only what is left once more, as the larger end must be a fragment's too.
    """
    ends = ends_of(fragments)
    x = pairs(edges).join(ends.withColumnRenamed("node", "lo"), "lo")
    ranked = x.withColumn("__n", F.row_number().over(Window.partitionBy("lo", "hi").orderBy(F.desc("weight"), "edge_id")))
    kept = ranked.where((F.col("hi") == F.col("lo")) | (F.col("hi") == F.col("mate")) | (F.col("svtype") == FRAGMENT) | (F.col("__n") == 1)).drop("lo", "mate", "__n")
    return kept.join(ends.select(F.col("node").alias("hi")), "hi", "left_semi").select("edge_id", "u", "v", "svtype", "weight")


def adjacency(edges: DataFrame) -> DataFrame:
    """node, other, linked: 1 for each pair of neighbours, however many edges tie them. Pairs are made distinct before they are taken both ways."""
    both = F.when(F.col("lo").eqNullSafe(F.col("hi")), F.array(F.struct(F.col("lo").alias("node"), F.col("hi").alias("other")))).otherwise(F.array(F.struct(F.col("lo").alias("node"), F.col("hi").alias("other")), F.struct(F.col("hi").alias("node"), F.col("lo").alias("other"))))
    return pairs(edges).select("lo", "hi").distinct().select(F.explode(both).alias("e")).select("e.node", "e.other", F.lit(1).alias("linked"))


def from_spec(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(fragments, edges) of a graph given as rows of schema.GRAPH_SPEC: the first row of a fragment with itself makes
    the fragment, every other row an edge."""
    first = F.row_number().over(Window.partitionBy("frag1").orderBy("edgeid")) == 1
    own = rows.where(F.col("frag1") == F.col("frag2")).withColumn("__first", first)  # only these have to meet
    frags = own.where("__first").select(F.col("edgeid").alias("edge_id"), F.col("frag1").alias("name"), F.when(F.col("part1") == TAIL, F.col("node1")).otherwise(F.col("node2")).alias("tail"), F.when(F.col("part1") == TAIL, F.col("node2")).otherwise(F.col("node1")).alias("head"), F.col("cov").alias("coverage"))
    other = rows.where(F.col("frag1") != F.col("frag2")).unionByName(own.where("not __first").drop("__first"))
    return frags, other.select(F.col("edgeid").alias("edge_id"), F.col("node1").alias("u"), F.col("node2").alias("v"), "svtype", F.col("cov").alias("weight"))
