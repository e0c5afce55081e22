"""The genome cut at anchors, and what covers the pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from annulus.config import FAR_END
from annulus.operators.intervals import overlap_join
from annulus.operators.ordering import BIN, last_known


def fragment(anchors: DataFrame, *, bin_size: int = BIN) -> DataFrame:
    """fid, chr, start, end, tail, head, edge_id: [0, p1), [p1, p2), ... and the rest of each chromosome.

    anchors: chr, pos, chr_ord. Each fragment takes four ids in order: its own, its tail's, its head's
    and its edge's, so fids are 1, 5, 9, ... by chromosome and position. Ranks and starts are found within bins;
    a bin's first rank and first start come from a table of one row for each bin of the genome.
    """
    far = anchors.select("chr", "chr_ord").distinct().withColumn("pos", F.lit(FAR_END).cast("bigint"))
    every = anchors.select("chr", "chr_ord", "pos").unionByName(far).withColumn("bin", F.floor(F.col("pos") / bin_size))
    order = Window.partitionBy("chr", "bin").orderBy("pos")
    cut = every.select("chr", "bin", F.lag("pos").over(order).alias("start"), F.col("pos").alias("end"), F.row_number().over(order).alias("n"))
    bins = every.groupBy("chr", "bin").agg(F.first("chr_ord").alias("o"), F.max("pos").alias("last"), F.count("*").alias("size"))
    whole = Window.orderBy("o", "bin")
    before = bins.select("chr", "bin", (F.sum("size").over(whole) - F.col("size")).alias("before"), F.coalesce(F.lag("last").over(Window.partitionBy("o").orderBy("bin")), F.lit(0)).alias("first"))
    fid = 4 * (F.col("before") + F.col("n") - 1) + 1
    out = cut.join(before, ["chr", "bin"]).select(fid.cast("bigint").alias("fid"), "chr", F.coalesce("start", "first").alias("start"), "end")
    return out.select("fid", "chr", "start", "end", (F.col("fid") + 1).alias("tail"), (F.col("fid") + 2).alias("head"), (F.col("fid") + 3).alias("edge_id"))


def median_coverage(fragments: DataFrame, coverage: DataFrame, chromosomes: DataFrame, *, ratio: float = -1, bin_size: int = 100_000) -> DataFrame:
    """``fragments`` with coverage: the median over the bases that the track covers, infinity where it covers none.

    Ends are clipped to the chromosome; an empty fragment counts its last base. The track is runs of
    equal value, so the median is an exact percentile weighted by overlap. A chromosome that the track
    doesn't know is an error.
    """
    known = fragments.join(chromosomes.select("chr", F.col("length").alias("__size")), "chr", "left")
    known = known.withColumn("__size", F.when(F.col("__size").isNull(), F.raise_error(F.concat(F.lit("no coverage for chromosome "), F.col("chr")))).otherwise(F.col("__size")))
    lo, hi = F.least("start", "__size"), F.least("end", "__size")
    clipped = known.select("fid", "chr", F.least(F.when(lo == hi, lo - 1).otherwise(lo), hi).alias("start"), F.greatest(lo, hi).alias("end"))
    runs = coverage.select("chr", F.col("start").alias("r_start"), F.col("end").alias("r_end"), "value").where(~F.isnan("value"))
    median = overlap_join(clipped, runs, bin_size=bin_size).groupBy("fid").agg(F.expr("percentile(value, 0.5, cast(least(end, r_end) - greatest(start, r_start) as bigint))").alias("__median"))
    scale = F.lit(float(ratio)) if ratio > 0 else F.lit(1.0)
    both = fragments.join(median, "fid", "left").withColumn("coverage", F.coalesce(F.when(F.col("__median") > -1, F.col("__median") / scale), F.lit(float("inf"))))
    return both.withColumn("len", (F.col("end") - F.col("start")).cast("double")).drop("__median")


def genome_mean(coverage: DataFrame, chromosomes: DataFrame, allowed: tuple[str, ...]) -> DataFrame:
    """wgs_mean: chromosomes' means over covered bases, weighted by their lengths; 0 without any."""
    bases = F.col("end") - F.col("start")
    mean = coverage.where(F.col("chr").isin(*allowed)).groupBy("chr").agg((F.sum(F.col("value") * bases) / F.sum(bases)).alias("mean"))
    each = mean.join(chromosomes, "chr")
    return each.agg(F.coalesce(F.sum(F.col("mean") * F.col("length")) / F.sum("length"), F.lit(0.0)).alias("wgs_mean"))


def adjacent(fragments: DataFrame, distance: int = 50) -> DataFrame:
    """fid1, fid2, chr, bp: fragments that follow each other by fid and meet within ``distance``; bp is where they meet."""
    ids = fragments.select("fid", "chr", "start", "end")
    # ids follow chromosomes, so neighbours by id on one chromosome are neighbours of all
    x = last_known(ids, "chr", "fid", F.lit(True), "p", take=["fid", "start", "end"], strictly=True).where("p is not null")
    bp = F.when(F.abs(F.col("start") - F.col("p.end")) < distance, F.col("start")).when(F.abs(F.col("p.start") - F.col("end")) < distance, F.col("p.start"))
    return x.select(F.col("p.fid").alias("fid1"), F.col("fid").alias("fid2"), "chr", bp.alias("bp")).where("bp is not null")


def spanning_reads(points: DataFrame, reads: DataFrame, *, window: int = 500, pad: int = 100, bin_size: int = 10_000) -> DataFrame:
    """chr, bp, n: reads that cross each breakpoint, of at least two windows' length and not secondary; 0 where none does."""
    p = points.select("chr", "bp").distinct()
    near = p.withColumns({"start": F.greatest(F.lit(0), F.col("bp") - window), "end": F.col("bp") + window})
    good = reads.where(F.col("is_mapped") & ~F.col("is_secondary") & (F.col("query_length") >= 2 * window)).select("chr", F.col("ref_start").alias("r_start"), F.col("ref_end").alias("r_end"))
    crossing = overlap_join(near, good, bin_size=bin_size).where((F.col("r_start") < F.col("bp") - pad) & (F.col("r_end") > F.col("bp") + pad))
    counted = crossing.groupBy("chr", "bp").agg(F.count("*").alias("n"))
    return p.join(counted, ["chr", "bp"], "left").select("chr", "bp", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))
