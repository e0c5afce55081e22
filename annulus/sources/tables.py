"""Readers of text tables: coverage runs, chromosome sizes, aligned reads, sequences, graphs, circles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource

from annulus import schema
from annulus.operators import sequences
from annulus.sources import binary


def _tsv(spark: SparkSession, path: str, columns: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema=columns, comment="#", ignoreTrailingWhiteSpace=True, ignoreLeadingWhiteSpace=True)


def read_bedgraph(spark: SparkSession, path: str) -> DataFrame:
    """Runs of equal coverage: chr, start, end, value."""
    return _tsv(spark, path, schema.COVERAGE)


def read_sizes(spark: SparkSession, path: str) -> DataFrame:
    """chr, length."""
    return _tsv(spark, path, schema.CHROM)


def read_reads(spark: SparkSession, path: str) -> DataFrame:
    return _tsv(spark, path, schema.READ)


def read_graph(spark: SparkSession, path: str) -> DataFrame:
    return _tsv(spark, path, schema.GRAPH_SPEC)


def read_hits(spark: SparkSession, path: str) -> DataFrame:
    """Rows of an aligner's tabular output."""
    return _tsv(spark, path, schema.HITS)


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """row, chr, start, end, strand, fragment_id, coverage, circ_id of simulated circles."""
    t = _tsv(spark, path, schema.TRUTH_BED).withColumn("row", F.monotonically_increasing_id())
    return t.select("row", "chr", "start", F.col("stop").alias("end"), F.col("direction").alias("strand"), F.col("fragment").alias("fragment_id"), "coverage", F.col("structure").alias("circ_id"))


def read_circles(spark: SparkSession, path: str) -> DataFrame:
    """row and the columns of a circles BED file, in its order."""
    return _tsv(spark, path, schema.CIRCLE_BED).withColumn("row", F.monotonically_increasing_id())


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """chr, seq: records of FASTA files, split at '>' by Spark's own text reader; a name ends at white space."""
    return fasta_records(spark.read.text(path, lineSep=">"))


def read_fasta_blocks(spark: SparkSession, path: str, size: int = sequences.BLOCK) -> DataFrame:
    """(chr, block, seq) of FASTA files: no row is longer than ``size`` bases, or than a line of the file while it is read."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("n"))
    return sequences.fasta_blocks(lines, size)


def fasta_records(records: DataFrame) -> DataFrame:
    """chr, seq of (value): a record's text after its '>'."""
    name = F.regexp_extract("value", r"^\s*(\S+)", 1)
    body = F.regexp_replace(F.regexp_extract("value", r"^[^\n]*\n([\s\S]*)$", 1), r"\s", "")
    return records.where("value <> ''").select(name.alias("chr"), body.alias("seq")).where("chr <> ''")


def _ranged(spark: SparkSession, source: type[DataSource], path: str, regions: str, split: int | None) -> DataFrame:
    spark.dataSource.register(source)
    push = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")  # a reader that takes filters is an error without it
    r = spark.read.format(source.name()).option("push", push.lower())
    if regions:
        r = r.option("regions", regions)
    return (r.option("split", str(split)) if split else r).load(path)


def read_bigwig(spark: SparkSession, path: str, regions: str = "", *, split: int | None = None) -> DataFrame:
    """Runs of bigWig files (a file or a folder): chr, start, end, value. regions: 'chr1:100-200,chr2', or all of the file.

    The file's own tree of places leads to the blocks that are read, ``split`` compressed bytes of them in a task; a region reads
    no others. Filters on chr, start and end do the same where spark.sql.python.filterPushdown.enabled is on.
    """
    return _ranged(spark, binary.BigWigSource, path, regions, split)


def read_bigwig_sizes(spark: SparkSession, path: str) -> DataFrame:
    return _ranged(spark, binary.SizesSource, path, "", None)


def read_bam(spark: SparkSession, path: str, regions: str = "", *, split: int | None = None) -> DataFrame:
    """Alignments of BAM files as rows of schema.READ; columns as a read region needs, without sequences.

    With a .bai index beside it a file is read by many tasks, and a region reads only what the index names for it; without one, where
    records begin isn't known, and a file is one task. regions and split as in read_bigwig.
    """
    return _ranged(spark, binary.BamSource, path, regions, split)
