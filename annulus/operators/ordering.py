"""Order without a single task: what came before a row, and a row's rank in the whole.

Rows are ordered inside bins (of a position) or ranges (of any order); what a bin needs from those before it comes
from a table of one row for each bin.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annulus.operators.lineage import durable

BIN = 20_000  # bases; a window over a bin holds the rows of so many bases


def last_known(rows: DataFrame, key: str, at: str, known: Column, name: str, *, take: list[str] | None = None, then: str | None = None, strictly: bool = False, bin_size: int = BIN) -> DataFrame:
    """``rows`` with ``name``: of the rows of the same key, in order of ``at`` and ``then``, the last one that is ``known``, up to
    this row (strictly: before it); null if there is none. It is given by its ``at``, or a struct of ``take``.

    Known rows of one key must differ in ``at`` if ``take`` is given.
    """
    x = rows.withColumns({"__bin": F.floor(F.col(at) / bin_size).cast("long"), "__known": known})
    value = F.struct(*take) if take else F.col(at)
    within = Window.partitionBy(key, "__bin").orderBy(at, *([then] if then else [])).rowsBetween(Window.unboundedPreceding, -1 if strictly else 0)
    # the last of a bin by its place, and what is taken of it
    tops = x.groupBy(key, "__bin").agg(F.max(F.when(F.col("__known"), F.struct(F.col(at).alias("__at"), value.alias("__value")))).alias("__top"))
    before = Window.partitionBy(key).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    far = tops.select(key, "__bin", F.last("__top", ignorenulls=True).over(before).getField("__value").alias("__far")).where("__far is not null")
    near = x.withColumn("__near", F.last(F.when(F.col("__known"), value), ignorenulls=True).over(within))
    return near.join(far, [key, "__bin"], "left").select(*[F.col(f"`{c}`") for c in rows.columns], F.coalesce("__near", "__far").alias(name))


def numbered(rows: DataFrame, order: list[str | Column], name: str, first: int = 0) -> DataFrame:
    """``rows`` with ``name``: their rank in ``order``, from ``first`` on. The order must be total.

    Rows are dealt by ranges and kept, so a range is the same whenever it is read; each range is ranked by itself and
    shifted by the sizes of those before it, of which there is one number for each range.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = durable(rows.repartitionByRange(n, *order).withColumn("__range", F.spark_partition_id()))
    sizes = placed.groupBy("__range").agg(F.count("*").alias("__n"))
    before = sizes.select("__range", (F.sum("__n").over(Window.orderBy("__range")) - F.col("__n")).alias("__before"))
    rank = F.row_number().over(Window.partitionBy("__range").orderBy(*order)) - 1 + F.lit(first)
    # as many rows as there are ranges
    return placed.withColumn("__rank", rank).join(F.broadcast(before), "__range").select(*[F.col(f"`{c}`") for c in rows.columns], (F.col("__rank") + F.col("__before")).cast("bigint").alias(name))
