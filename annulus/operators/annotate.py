"""Circles on the genome: positions, collapsed neighbours, topology, links, tables to be written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annulus.config import FAR_END, Config
from annulus.functions.genomics import label, reverse_complement, topology_index, topology_name
from annulus.functions.paths import chromosomes, collapse, size_mb, topology_flags
from annulus.operators.lineage import durable
from annulus.operators.ordering import numbered


def located(circles: DataFrame, fragments: DataFrame) -> DataFrame:
    """``circles`` with conf: array of (chr, start, end, strand, frag, cov) in the circle's order. circles: circ_id, path and more."""
    steps = circles.select("circ_id", F.posexplode("path").alias("i", "x")).withColumn("fid", F.abs("x"))
    at = steps.join(fragments.select("fid", "chr", "start", "end", "coverage"), "fid")
    piece = F.struct("i", "chr", "start", "end", F.when(F.col("x") < 0, "-").otherwise("+").alias("strand"), F.col("fid").cast("string").alias("frag"), F.col("coverage").alias("cov"))
    conf = at.groupBy("circ_id").agg(F.transform(F.sort_array(F.collect_list(piece)), lambda p: F.struct(*[p[c].alias(c) for c in ("chr", "start", "end", "strand", "frag", "cov")])).alias("conf"))
    return circles.join(conf, "circ_id")


def annotated(circles: DataFrame, config: Config = Config()) -> DataFrame:
    """Circles with conf collapsed, size_mb, chr_origin, label, topology, topology_idx and topology_name."""
    x = circles.withColumn("conf", collapse(F.col("conf"), config.collapse_gap)).withColumn("t", topology_flags(F.col("conf")))
    idx = topology_index(*[F.col(f"t.{c}") for c in ("n", "small_del", "dup", "inv", "interchr", "multi", "foldback")])
    y = x.withColumns({"size_mb": size_mb(F.col("conf")), "chr_origin": chromosomes(F.col("conf")), "topology_idx": idx})
    score = F.col("score") * config.downsampling_ratio if config.downsampling_ratio > 0 else F.col("score")
    return y.withColumns({"label": label(F.col("size_mb"), config), "topology_name": topology_name(F.col("topology_idx")), "score": score})


def summary(circles: DataFrame) -> DataFrame:
    """Rows of the circles' summary in order. They are kept before they are sorted, as a sort reads its rows twice, to choose its ranges and to deal them."""
    rows = circles.select("ord", "circ_id", "chr_origin", F.col("size_mb").alias("size(MB)"), "label", "topology_idx", "topology_name", F.col("score").cast("bigint").alias("estimated_proportions"))
    return durable(rows).orderBy("ord").drop("ord")


def bed(circles: DataFrame, *, only_ecdna: bool = False, least_score: int = 0) -> DataFrame:
    """Rows of the circles' BED table with their place ``row``: circles by whole score, highest first, then in their order."""
    whole = F.col("score").cast("bigint")
    kept = circles.where(whole >= least_score)
    if only_ecdna:
        kept = kept.where("label = 'ecDNA'")
    x = kept.select("circ_id", "ord", whole.alias("s"), F.posexplode("conf").alias("i", "p"))
    return numbered(x, [F.desc("s"), "ord", "i"], "row", 1).select("row", F.col("p.chr").alias("chr"), F.col("p.start").alias("start"), F.col("p.end").alias("end"), "circ_id", F.col("p.frag").alias("fragment_id"), F.col("p.strand").alias("strand"), F.col("p.cov").cast("bigint").alias("coverage"), F.col("s").alias("estimated_proportions"))


def side(strand: Column, nxt: Column) -> tuple[Column, Column]:
    """Sides by which two fragments touch: the first leaves by its end (1) if it is on +, the second is entered by its start (0) if on +."""
    return F.when(strand == "+", 1).otherwise(0), F.when(nxt == "+", 0).otherwise(1)


def links(rows: DataFrame) -> DataFrame:
    """n1, n2, n1_side, n2_side, circ_id: each row of a BED table tied to the next of its circle, the last to the first."""
    w = Window.partitionBy("circ_id").orderBy("row")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nxt = F.coalesce(F.lead(F.struct("row", "strand")).over(w), F.first(F.struct("row", "strand")).over(whole))
    x = rows.select("row", "strand", "circ_id", nxt.alias("n"))
    one, two = side(F.col("strand"), F.col("n.strand"))
    return x.select(F.col("row").alias("n1"), F.col("n.row").alias("n2"), one.alias("n1_side"), two.alias("n2_side"), "circ_id")


def fragments_bed(fragments: DataFrame, *, ratio: float = -1) -> DataFrame:
    """chr, start, stop, fid, coverage: open ends shown as 2000 bases (5 on the mitochondrion)."""
    near = F.when(F.col("chr").isin("chrM", "M"), 5).otherwise(2000)
    scale = ratio if ratio > 0 else 1
    return fragments.select("chr", "start", F.when(F.col("end") == FAR_END, F.col("start") + near).otherwise(F.col("end")).alias("stop"), "fid", (F.col("coverage") * scale).cast("bigint").alias("coverage"))


def sequences(rows: DataFrame, genome: DataFrame) -> DataFrame:
    """circ_id, seq: the circles' sequences. rows: circ_id, row, chr, start, end, strand; genome: chr, seq."""
    part = F.col("seq").substr((F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int"))
    cut = rows.join(genome, "chr").select("circ_id", F.struct("row", F.when(F.col("strand") == "-", reverse_complement(part)).otherwise(part).alias("s")).alias("x"))
    return cut.groupBy("circ_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["s"]), "").alias("seq"))
