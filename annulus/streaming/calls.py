"""Calls as a stream: new VCF files of a folder, filtered as they come, and breakpoints counted in windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annulus.config import Config
from annulus.sources import vcf


def stream_calls(spark: SparkSession, folder: str, config: Config = Config(), *, files_per_trigger: int = 16) -> DataFrame:
    """The calls that pass, of every file that is put into ``folder``; sample is the file's name.

    Each line is judged by itself, so nothing is kept between batches: any number of files can be
    worked off. config.drop_all_mates must be on, as pairing mates would need both records.
    """
    if not config.drop_all_mates:
        raise ValueError("a stream can't pair mates: set drop_all_mates")
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(folder).select(F.lit(0).cast("long").alias("ord"), "value", F.col("_metadata.file_name").alias("sample"))
    # ord has no meaning in a stream; the file's name rides along in its place
    tagged = lines.withColumn("value", F.col("value")).select("ord", "value", "sample")
    kept = tagged.where(F.col("value").startswith("#") | (F.size(F.split(F.regexp_replace(F.trim("value"), r"\s+", "\t"), "\t")) == 10) | F.lit(config.multi))
    clean = kept.withColumn("value", F.when(F.col("value").startswith("#") | F.lit(config.multi), F.col("value")).otherwise(F.regexp_replace(F.trim("value"), r"\s+", "\t")))
    packed = clean.select(F.struct("ord", "sample").alias("ord"), "value")
    sv = vcf.sv_filter(vcf.normalise(vcf.parse(packed), config), config)
    return sv.withColumn("sample", F.col("ord.sample")).drop("ord")


def breakpoint_counts(calls: DataFrame, *, bin_size: int = 1_000_000) -> DataFrame:
    """chr, bin, n, support: breakpoints of a stream (or a table) of calls by place. State is one row for each bin of the genome."""
    ends = calls.select(F.explode(F.array(F.struct(F.col("chr1").alias("chr"), F.col("pos1").alias("pos")), F.struct(F.col("chr2").alias("chr"), F.col("pos2").alias("pos")))).alias("e"), "dv")
    return ends.groupBy(F.col("e.chr").alias("chr"), F.floor(F.col("e.pos") / bin_size).alias("bin")).agg(F.count("*").alias("n"), F.sum("dv").alias("support"))
