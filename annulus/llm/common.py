"""What the text operators share: durable lineage cuts, held-out folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from annulus.operators.lineage import components, durable, ensure_checkpoint_dir

__all__ = ["components", "durable", "ensure_checkpoint_dir", "held_out", "read_table", "training_rows"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str = "doc_id") -> Column:
    """True for rows whose labels no model may see: crc32 of the id as text leaves 1 by 3. A null id counts as held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(True))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, limit: int) -> DataFrame:
    """(doc_id, text, y) of about ``limit`` labelled rows that aren't held out, or all if there are fewer.

    The rows are those whose hash of the id falls into the share that ``limit`` is of all, so the sample
    is the same on every run and spread over the whole table, and nothing is sorted to find it. A
    limit a quarter higher bounds what a model is fitted on in any case: an id that occurs on several rows gives one
    row, with the least of its texts. Ids that occur twice among the labels take the larger label; null ids
    or labels are left out.
    """
    fit = labels.select(F.col("doc_id").alias("k"), F.col(label).cast("int").alias("y")).where(F.col("k").isNotNull() & F.col("y").isNotNull() & ~held_out("k"))
    share = int(min(1.0, limit / max(fit.count(), 1)) * (1 << 20))
    chosen = fit.where(F.pmod(F.xxhash64("k"), F.lit(1 << 20)) < share).limit(limit + limit // 4 + 64).groupBy("k").agg(F.max("y").alias("y"))
    # the limit, of a long and an int each, makes the broadcast safe
    found = docs.select(F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("k"))
    return found.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y"))
