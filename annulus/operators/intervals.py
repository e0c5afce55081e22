"""Joins on the genome: intervals with intervals, points with the interval that holds them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annulus.operators.ordering import BIN, last_known


def overlap_join(left: DataFrame, right: DataFrame, *, bin_size: int, key: str = "chr", how: str = "inner") -> DataFrame:
    """Pairs of half-open intervals (key, start, end) of both sides that overlap; right's columns must have other names but key.

    left: key, start, end and more; right: key, r_start, r_end and more. Both are put in bins of
    ``bin_size``; a pair is reported in the bin where its overlap begins, so it is reported once and
    nothing is removed after the join. An interval of length 0 overlaps nothing. Bins spread a chromosome over many tasks.
    """
    at = lambda c: F.floor(c / F.lit(bin_size)).cast("long")
    spread = lambda a, b: F.explode(F.sequence(at(a), at(b - 1)))
    a = left.where(F.col("end") > F.col("start")).withColumn("__bin", spread(F.col("start"), F.col("end")))
    b = right.where(F.col("r_end") > F.col("r_start")).withColumnRenamed(key, "__key").withColumn("__rbin", spread(F.col("r_start"), F.col("r_end")))
    meet = (F.col(key) == F.col("__key")) & (F.col("__bin") == F.col("__rbin")) & (F.col("start") < F.col("r_end")) & (F.col("r_start") < F.col("end"))
    once = F.col("__bin") == at(F.greatest("start", "r_start"))
    return a.join(b, meet & once, how).drop("__bin", "__rbin", "__key")


def stab_join(points: DataFrame, fragments: DataFrame, at: Column, name: str, take: list[str], *, bin_size: int = BIN) -> DataFrame:
    """``points`` with a column ``name``: struct of ``take`` of the fragment (chr, start, end) that holds position ``at``; null if none.

    Fragments of a chromosome must not overlap, so the only one that can hold a position is the last
    that starts at or before it. Both sides are put in order of position together, in bins; a bin
    that begins inside a fragment is told so by a table of one row for each bin. points must have a column chr.
    """
    inner = {"__end": F.col("end"), **{f"__take_{c}": F.col(c) for c in take}}
    none = fragments.select(*[c.alias(n) for n, c in inner.items()]).schema
    p = points.select(F.col("chr").alias("__chr"), at.cast("bigint").alias("__at"), F.lit(1).alias("__point"), F.struct(*points.columns).alias("__row"), *[F.lit(None).cast(none[n].dataType).alias(n) for n in inner])
    f = fragments.select(F.col("chr").alias("__chr"), F.col("start").alias("__at"), F.lit(0).alias("__point"), F.lit(None).alias("__row"), *[c.alias(n) for n, c in inner.items()])
    found = last_known(p.unionByName(f), "__chr", "__at", F.col("__point") == 0, "__last", take=list(inner), then="__point", bin_size=bin_size).where("__point = 1")
    held = F.when(F.col("__at") < F.col("__last.__end"), F.struct(*[F.col(f"__last.__take_{c}").alias(c) for c in take]))
    return found.select("__row.*", held.alias(name))


def covered(intervals: DataFrame, by: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """by, covered: length of the union of each group's intervals (islands by the running maximum of ends)."""
    before = Window.partitionBy(*by).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max(end).over(before)
    new = F.greatest(F.lit(0), F.col(end) - F.greatest(F.col(start), F.coalesce(reach, F.col(start))))
    return intervals.withColumn("__new", new).groupBy(*by).agg(F.sum("__new").alias("covered"))
