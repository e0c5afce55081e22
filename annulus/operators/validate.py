"""Reconstructed circles against true ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annulus.functions.genomics import topology_index
from annulus.functions.paths import size_mb, topology_flags
from annulus.operators import alignment
from annulus.operators.intervals import covered
from annulus.operators.lineage import durable
from annulus.operators.sequences import BLOCK, circle_blocks


def good_hits(hits: DataFrame, *, pident: float = 90, bitscore: float = 1000) -> DataFrame:
    return hits.where((F.col("pident") >= pident) & (F.col("bitscore") >= bitscore) & (F.col("subject_start") < F.col("subject_end")))


def hits_from_genome(true: DataFrame, found: DataFrame, genome: DataFrame, *, size: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Hits of true circles on reconstructed ones, and the other way round, from rows (circ_id, row, chr, start, end, strand) and a genome in blocks.

    Only strand '+' is looked at, as good_hits keeps no other. Without gaps an alignment is the same from both sides, so it is made once.
    """
    a, b = (durable(circle_blocks(rows, genome, size)) for rows in (true, found))
    hits = durable(alignment.hits(a, b, size=size, both=False))
    return hits, alignment.turned_round(hits)


def identity(hits: DataFrame, lengths: DataFrame) -> DataFrame:
    """qseqid, sseqid, identity: share of a query's bases 1 to length that its hits on a subject cover. lengths: qseqid, length."""
    x = hits.join(lengths, "qseqid").select("qseqid", "sseqid", "length", F.greatest(F.lit(1), F.least("query_start", "query_end")).alias("start"), F.least("length", F.greatest("query_start", "query_end")).alias("end"))
    part = covered(x, ["qseqid", "sseqid", "length"])
    return part.select("qseqid", "sseqid", (F.col("covered") / F.greatest(F.col("length") - 1, F.lit(1))).alias("identity"))


def circles_of_bed(rows: DataFrame, key: str = "circ_id") -> DataFrame:
    """circ_id, conf, length_mb, topology_idx from rows (row, chr, start, end, strand, fragment_id, coverage) of a BED table."""
    piece = F.struct("row", "chr", "start", "end", "strand", F.col("fragment_id").alias("frag"), F.col("coverage").cast("double").alias("cov"))
    c = rows.groupBy(F.col(key).cast("string").alias("circ_id")).agg(F.transform(F.sort_array(F.collect_list(piece)), lambda p: F.struct(*[p[x].alias(x) for x in ("chr", "start", "end", "strand", "frag", "cov")])).alias("conf"))
    t = c.withColumn("t", topology_flags(F.col("conf")))
    return t.select("circ_id", "conf", size_mb(F.col("conf")).alias("length_mb"), topology_index(*[F.col(f"t.{x}") for x in ("n", "small_del", "dup", "inv", "interchr", "multi", "foldback")]).alias("topology_idx"))


def compare(true: DataFrame, found: DataFrame, true_hits: DataFrame, found_hits: DataFrame, *, every: bool = True, few: int = 100_000) -> DataFrame:
    """Each true circle with each reconstructed one: lengths, topologies, and both identities (0 without hits).

    true_hits: identities of true circles on reconstructed ones; found_hits: the other way round. Every
    pair is reported, as a validation table of simulated circles is; pairs that share nothing are zeros.
    every=False: only pairs with hits. The table of all pairs is their product by definition; reconstructed
    circles are sent to the true ones where they are up to ``few``, else blocks of both sides meet.
    """
    a = true.select(F.col("circ_id").alias("true_id"), F.col("length_mb").alias("true_len"), F.col("topology_idx").alias("true_topology"))
    b = found.select(F.col("circ_id").alias("reconstruct_id"), F.col("length_mb").alias("reconstruct_len"), F.col("topology_idx").alias("reconstruct_topology"))
    p = true_hits.select(F.col("qseqid").alias("true_id"), F.col("sseqid").alias("reconstruct_id"), F.col("identity").alias("pident_true"))
    q = found_hits.select(F.col("sseqid").alias("true_id"), F.col("qseqid").alias("reconstruct_id"), F.col("identity").alias("pident_reconstruct"))
    keys = ["true_id", "reconstruct_id"]
    hits = p.join(q, keys, "full")
    if every:
        out = a.crossJoin(F.broadcast(b) if b.limit(few + 1).count() <= few else b).join(hits, keys, "left")
    else:
        out = hits.join(a, "true_id").join(b, "reconstruct_id")
    return out.select("true_id", "true_len", "true_topology", "reconstruct_id", "reconstruct_len", "reconstruct_topology", F.coalesce("pident_true", F.lit(0.0)).alias("pident_true"), F.coalesce("pident_reconstruct", F.lit(0.0)).alias("pident_reconstruct"))
