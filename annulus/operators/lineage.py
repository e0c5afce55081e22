"""Durable lineage cuts and connected components, shared by all operators."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder that the cluster names in spark.checkpoint.dir.

    Where none is set, a local master gets a folder of this machine, which goes with the process. On a cluster that
    would lose what other machines wrote, so it is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="annulus-checkpoints-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    context.setCheckpointDir(folder)


def durable(df: DataFrame) -> DataFrame:
    """Rows kept in the shared checkpoint folder: a lost executor loses none, and what made them doesn't run again."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for each node of ``edges`` (a, b): root is the smallest node reachable.

    Every round replaces each edge by one to the smallest neighbour (large star, then small star),
    so a path of n nodes becomes a star in about log n rounds. Minima are aggregated before the
    shuffle and joins may be split by AQE, so a hub of any degree stays out of a single task.
    Nothing is collected but one count per round.
    """
    both = lambda e: e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    e = durable(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(max_rounds):
        # large star: each larger neighbour of a node is tied to the node's smallest neighbour (itself counted)
        around = both(e)
        least = around.groupBy("a").agg(F.min("b").alias("m0")).select("a", F.least("a", "m0").alias("m"))
        e = around.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: the node and its smaller neighbours are tied to the smallest
        least = e.groupBy("a").agg(F.min("b").alias("m"))
        tied = e.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        after = durable(tied.where("a <> b").distinct())
        # done when it is a forest of stars: no node is both a leaf and a centre, and no leaf has two centres
        bad = after.join(after.select(F.col("b").alias("a")).distinct(), "a", "left_semi").limit(1).count()
        many = after.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").limit(1).count() if not bad else 1
        e = after
        if not bad and not many:
            break
    else:
        raise RuntimeError("components: not settled; raise max_rounds")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
