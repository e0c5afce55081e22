"""Breakpoints of calls, and the anchors that near ones are merged into."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annulus.operators.lineage import durable

MERGE_BIN = 25_000  # bases: what one task holds of a chromosome's positions


def breakpoints(sv: DataFrame) -> DataFrame:
    """chr, pos of both ends of each call; ord, side: where it first appears (first ends before second ones). Calls are read once for both."""
    end = lambda k: F.struct(F.col(f"chr{k}").alias("chr"), F.col(f"pos{k}").alias("pos"), F.lit(k - 1).alias("side"))
    return sv.select("ord", F.explode(F.array(end(1), end(2))).alias("e")).select("e.chr", "e.pos", "ord", "e.side")


def anchors_from(positions: np.ndarray, first: int, distance: int) -> np.ndarray:
    """Greedy anchors of ascending positions from the ``first``-th on: each takes all up to ``distance`` behind it; the next one begins anew."""
    after = np.searchsorted(positions, positions + distance, side="right").tolist()
    at, out = first, []
    while at < len(after):
        out.append(at)
        at = after[at]
    return positions[out]


def last_anchors(positions: Column, distance: int) -> Column:
    """For a bin's ascending positions: its last anchor if no anchor reaches into it, and then if one does from 1, 2, ... ``distance`` before
    its first position; an anchor that takes all of the bin stays the last one."""

    @F.pandas_udf("array<bigint>")
    def each(bins: pd.Series) -> pd.Series:
        out = []
        for ps in bins:
            after = np.searchsorted(ps, ps + distance, side="right").tolist()
            last = list(range(len(ps)))  # the last anchor of the walk that begins at a position
            for i in range(len(ps) - 1, -1, -1):
                if after[i] < len(ps):
                    last[i] = last[after[i]]
            reached = np.searchsorted(ps, ps[0] - np.arange(1, distance + 1) + distance, side="right")
            out.append([int(ps[last[0]]), *(int(ps[last[i]]) if i < len(ps) else int(ps[0]) - 1 - k for k, i in enumerate(reached.tolist()))])
        return pd.Series(out)

    return each(positions)


def anchors_of(positions: Column, entry: Column, distance: int) -> Column:
    """For a bin's ascending positions, the anchor of each; entry: the last anchor before the bin, or null."""

    @F.pandas_udf("array<bigint>")
    def each(bins: pd.Series, entries: pd.Series) -> pd.Series:
        out = []
        for ps, e in zip(bins, entries):
            taken = 0 if pd.isna(e) else int(np.searchsorted(ps, int(e) + distance, side="right"))
            anchors = anchors_from(ps, taken, distance)
            rest = ps[taken:]
            out.append(np.concatenate([np.full(taken, 0 if pd.isna(e) else int(e), np.int64), anchors[np.searchsorted(anchors, rest, side="right") - 1] if len(rest) else rest]))
        return pd.Series(out)

    return each(positions, entry.cast("bigint"))


def merge(points: DataFrame, distance: int = 50, *, bin_size: int = MERGE_BIN) -> DataFrame:
    """chr, pos, anchor: for each distinct position the anchor it is merged into.

    Chromosomes are cut into bins of ``bin_size`` bases. All that a bin needs from those before it is their last anchor, if it is within
    ``distance`` of its first position; so each bin first tells its own last anchor for each of these cases, a table of
    ``distance`` + 1 numbers a bin. Following it along a chromosome gives each bin's entry, and then bins are merged by themselves. The work
    grows with the number of positions, however near they are to each other. Positions without a chromosome or place are left out.
    """
    known = points.where("chr is not null and pos is not null").select("chr", F.col("pos").cast("bigint").alias("pos")).distinct()  # before they are gathered: a task's lists then hold each once
    bins = known.groupBy("chr", F.floor(F.col("pos") / F.lit(bin_size)).cast("bigint").alias("bin")).agg(F.sort_array(F.collect_list("pos")).alias("ps"))
    bins = durable(bins)  # read twice below; else positions would be gathered twice
    cases = bins.select("chr", "bin", F.get("ps", F.lit(0)).alias("first"), last_anchors(F.col("ps"), distance).alias("last"))
    # distance + 1 numbers for each bin of a chromosome, in which at most distance + 1 of a bin's positions count
    entries = cases.repartition("chr").sortWithinPartitions("chr", "bin").mapInPandas(lambda batches: _entries(batches, distance), "chr string, bin bigint, entry bigint")
    done = bins.join(entries, ["chr", "bin"]).select("chr", "ps", anchors_of(F.col("ps"), F.col("entry"), distance).alias("anchors"))
    return done.select("chr", F.explode(F.arrays_zip("ps", "anchors")).alias("x")).select("chr", F.col("x.ps").alias("pos"), F.col("x.anchors").alias("anchor"))


def _entries(batches: Iterator[pd.DataFrame], distance: int) -> Iterator[pd.DataFrame]:
    """The last anchor before each bin, null where it is too far to matter; bins come by chromosome and place."""
    chrom, anchor = None, None
    for pdf in batches:
        rows = []
        for c, b, first, last in zip(pdf["chr"], pdf["bin"], pdf["first"], pdf["last"]):
            if c != chrom:
                chrom, anchor = c, None
            near = anchor is not None and first - anchor <= distance
            rows.append((c, b, anchor if near else None))
            anchor = int(last[first - anchor if near else 0])
        out = pd.DataFrame(rows, columns=["chr", "bin", "entry"])
        yield out.astype({"entry": "Int64"})


def making(sv: DataFrame, anchor: str) -> DataFrame:
    """``sv`` with ``key_ord``, ``moved``: the order in which edges are made; ``anchor`` is that of the first end.

    Calls of one anchor follow each other: those that began there, then those moved there, by position
    and order of input. Anchors follow the order of input of their own first call.
    """
    key = Window.partitionBy("chr1", anchor)
    own = F.when(F.col("pos1") == F.col(anchor), F.col("ord"))
    first = F.min(own).over(key)
    last = F.struct(first.isNull().alias("late"), F.coalesce(first, F.min("ord").over(key)).alias("at"))
    return sv.withColumn("key_ord", last).withColumn("moved", F.when(F.col("pos1") == F.col(anchor), F.lit(-1).cast("bigint")).otherwise(F.col("pos1")))


def rewrite(sv: DataFrame, merged: DataFrame) -> DataFrame:
    """``sv`` with both ends on anchors, and the order in which edges are made."""
    a = merged.select(F.col("chr").alias("chr1"), F.col("pos").alias("pos1"), F.col("anchor").alias("a1"))
    b = merged.select(F.col("chr").alias("chr2"), F.col("pos").alias("pos2"), F.col("anchor").alias("a2"))
    both = sv.join(a, ["chr1", "pos1"]).join(b, ["chr2", "pos2"])
    return making(both, "a1").withColumns({"pos1": F.col("a1"), "pos2": F.col("a2")}).drop("a1", "a2")


def kept_anchors(points: DataFrame, merged: DataFrame) -> DataFrame:
    """chr, pos, chr_ord: the distinct anchors; chr_ord is a chromosome's rank by first appearance."""
    sides = points.groupBy("chr", "side").agg(F.min("ord").alias("ord"))  # a least struct would be found by sorting
    first = sides.groupBy("chr").agg(F.min(F.struct("ord", "side")).alias("first"))
    ranked = durable(first).select("chr", (F.row_number().over(Window.orderBy("first")) - 1).alias("chr_ord"))
    return merged.select("chr", F.col("anchor").alias("pos")).distinct().join(ranked, "chr")  # a row for each chromosome
