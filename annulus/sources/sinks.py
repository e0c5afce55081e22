"""Writers of the tables that a reconstruction leaves: tab-separated text with a header, FASTA, JSON, Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annulus.operators.sequences import fasta_lines


def write_tsv(df: DataFrame, path: str, *, header: bool = True, one_file: bool = True) -> None:
    """Results are a few rows for each circle, so one file is the default; order is kept."""
    # the writer quotes values that begin with its comment sign; headers begin with '#', so another sign is named
    (df.coalesce(1) if one_file else df).write.mode("overwrite").option("comment", "\u0001").csv(path, sep="\t", header=header)


def write_lines(df: DataFrame, path: str, order: str = "ord") -> None:
    """Column value as lines in order, over as many files as there are ranges: a filtered VCF. The files' names follow the order."""
    df.orderBy(order).select("value").write.mode("overwrite").text(path)


def write_fasta(seqs: DataFrame, path: str, *, width: int = 60) -> None:
    """circ_id, seq as FASTA with lines of ``width`` letters."""
    body = F.regexp_replace("seq", f"(.{{{width}}})(?=.)", "$1\n")
    seqs.select(F.concat(F.lit(">"), F.col("circ_id").cast("string"), F.lit("\n"), body).alias("value")).write.mode("overwrite").text(path)


def write_fasta_blocks(blocks: DataFrame, path: str, *, width: int = 60) -> None:
    """circ_id, block, seq as FASTA: records in order, over as many files as there are ranges of blocks."""
    fasta_lines(blocks, width=width).write.mode("overwrite").text(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def bed_table(rows: DataFrame) -> DataFrame:
    return rows.orderBy("row").select(F.col("chr").alias("#chr"), "start", "end", "circ_id", "fragment_id", "strand", "coverage", "estimated_proportions")


def links_table(links: DataFrame) -> DataFrame:
    return links.orderBy("n1").select("n1", "n2", F.col("n1_side").alias("n1.side"), F.col("n2_side").alias("n2.side"), "circ_id")


def fragments_table(rows: DataFrame) -> DataFrame:
    return rows.orderBy("fid").select(F.col("chr").alias("#chr"), "start", "stop", "fid", "coverage")


def save_graph(fragments: DataFrame, edges: DataFrame, path: str) -> None:
    fragments.write.mode("overwrite").parquet(f"{path}/fragments")
    edges.write.mode("overwrite").parquet(f"{path}/edges")
