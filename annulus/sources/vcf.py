"""Structural-variant calls: text VCF to rows, and each caller's dialect to one schema.

Everything is a projection over ``spark.read.text``; files of any size are split by Spark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from annulus.config import SV_CALLERS, Config
from annulus.functions.genomics import bnd_strand, downsampled, genotype, mate_chromosome, mate_position

# fixed value: the message that users know
NO_GENOTYPE = "##Exception: DR/DV has no value. Your VCF might not be genotyped. Rerun SV calling using --genotype"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(ord, value): ord follows the order of lines within each file."""
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("ord"), "value")


def clean_lines(lines: DataFrame, multi: bool = False) -> DataFrame:
    """Header lines, and data lines with white space made tabs; with one sample only lines of exactly ten fields."""
    tabbed = F.regexp_replace(F.trim("value"), r"\s+", "\t")
    if multi:
        return lines
    kept = F.col("value").startswith("#") | (F.size(F.split(tabbed, "\t")) == 10)
    return lines.where(kept).select("ord", F.when(F.col("value").startswith("#"), F.col("value")).otherwise(tabbed).alias("value"))


def dropped_lines(lines: DataFrame, multi: bool = False) -> DataFrame:
    """Data lines that clean_lines leaves out."""
    return lines.join(clean_lines(lines, multi), "ord", "left_anti").where("trim(value) <> ''")


def parse(lines: DataFrame) -> DataFrame:
    """Records as in schema.RAW: INFO as a map (flags have an empty value), each sample as a map by FORMAT.

    A filter on pos may be tried before headers are left out, so these have none.
    """
    f = F.split("value", "\t")
    info = F.map_from_entries(
        F.transform(
            F.filter(F.split(F.get(f, F.lit(7)), ";"), lambda x: (x != "") & (x != ".")),
            lambda x: F.struct(F.substring_index(x, "=", 1).alias("k"), F.when(x.contains("="), F.substring(x, F.instr(x, F.lit("=")) + 1, F.length(x))).otherwise("").alias("v")),
        )
    )
    keys = F.split(F.get(f, F.lit(8)), ":")

    def sample(text: Column) -> Column:
        values = F.split(text, ":")
        n = F.least(F.size(keys), F.size(values))
        return F.map_from_arrays(F.slice(keys, F.lit(1), n), F.slice(values, F.lit(1), n))

    samples = F.when(F.size(f) > 9, F.transform(F.slice(f, F.lit(10), F.greatest(F.size(f) - 9, F.lit(0))), sample))
    at = lambda i: F.get(f, F.lit(i))
    return lines.where("value not like '#%' and trim(value) <> ''").select("ord", at(0).alias("chrom"), F.when(~F.col("value").startswith("#"), at(1)).cast("bigint").alias("pos"), at(2).alias("id"), at(3).alias("ref"), F.split(at(4), ",").alias("alt"), at(5).alias("qual"), at(6).alias("filter"), info.alias("info"), samples.alias("samples"))


def read_vcf(spark: SparkSession, path: str, multi: bool = False) -> DataFrame:
    return parse(clean_lines(read_lines(spark, path), multi))


def normalise(raw: DataFrame, config: Config = Config()) -> DataFrame:
    """schema.SV from one caller's dialect.

    An unknown caller is an error. ``error`` says what a dialect must have but a record hasn't; it is
    null for good records, and sv_filter stops at any other.
    """
    caller = "multivcf" if config.multi else config.sv_caller
    if caller not in SV_CALLERS:
        raise ValueError(f"unknown SV caller: {caller}")
    info = lambda k: F.nullif(F.col("info")[k], F.lit("."))
    first = lambda c: F.substring_index(c, ",", 1)
    one = F.get("samples", F.lit(0))
    whole = lambda c: c.try_cast("bigint")
    svtype, alt = info("SVTYPE"), F.get("alt", F.lit(0))
    broken = svtype.isin("BND", "TRA")
    chr2, pos2 = info("CHR2"), whole(info("END"))
    strand, svlen = info("STRAND"), F.coalesce(F.nullif(first(info("SVLEN")), F.lit("-")), F.lit("-1"))
    dv, dr, gt = whole(first(one["DV"])), whole(first(one["DR"])), one["GT"]
    if caller in ("sniffles2", "cutesv", "nanomonsv", "lumpy"):
        chr2 = F.when(broken, mate_chromosome(alt)).otherwise(F.col("chrom"))
        pos2 = F.when(broken, mate_position(alt)).otherwise(pos2)
    unknown = gt == "./."
    lacks = lambda c, what: F.when(c.isNull(), F.lit(f"{caller}: a record has no {what}"))
    error = F.lit(None).cast("string")
    if caller == "sniffles1":
        error = lacks(info("STRANDS"), "STRANDS")
        strand = first(info("STRANDS"))
    elif caller == "sniffles2":
        support, before = whole(info("SUPPORT")), F.coalesce(whole(first(info("COVERAGE"))), F.lit(0).cast("bigint"))
        error = F.coalesce(lacks(info("SUPPORT"), "SUPPORT"), lacks(info("COVERAGE"), "COVERAGE"))
        strand = F.when(broken, bnd_strand(alt)).otherwise(strand)
        dv, dr = F.when(unknown, support).otherwise(dv), F.when(unknown, before).otherwise(dr)
        gt = F.when(unknown, genotype(dv / (dv + dr + 1))).otherwise(gt)
    elif caller in ("cutesv", "nanomonsv"):
        if caller == "nanomonsv":  # files of that caller name reads TR and VR: all reads, and those for the variant
            dv, dr = F.coalesce(dv, whole(one["VR"])), F.coalesce(dr, whole(one["TR"]) - whole(one["VR"]))
            strand = F.coalesce(strand, F.lit("."))
        error = F.when(~broken, lacks(strand, "STRAND"))
        strand = F.when(broken, bnd_strand(alt)).otherwise(first(strand))
    elif caller == "lumpy":
        error = F.when(~broken, lacks(info("STRANDS"), "STRANDS"))
        strand = F.when(broken, bnd_strand(alt)).otherwise(F.substring_index(first(info("STRANDS")), ":", 1))
        dv, dr = whole(first(one["QA"])), whole(first(one["QR"]))
        gt = F.when(unknown, genotype(dv / (whole(one["DP"]) + 1))).otherwise(gt)
    elif caller == "multivcf":
        best = multi_sample_pick(F.col("samples"))
        dv, dr, gt = best["dv"], best["dr"], best["gt"]
        strand = F.coalesce(strand, first(info("STRANDS")))
    if config.downsampling_ratio > 0:
        dv, dr = downsampled(dv, config.downsampling_ratio), downsampled(dr, config.downsampling_ratio)
    return raw.select(
        "ord", F.col("id").alias("sv_id"), F.col("chrom").alias("chr1"), F.col("pos").alias("pos1"), chr2.alias("chr2"), pos2.alias("pos2"), svtype.alias("svtype"), whole(svlen).alias("svlen"),
        strand.alias("strand"), dv.alias("dv"), dr.alias("dr"), gt.alias("gt"), F.map_contains_key("info", F.lit("SECONDARY")).alias("secondary"), info("MATEID").alias("mate"),
        F.coalesce(error, F.when(dv.isNull() | dr.isNull(), F.lit(NO_GENOTYPE))).alias("error"),
    )


def multi_sample_pick(samples: Column) -> Column:
    """struct(dv, i, dr, gt) of the sample with most variant reads, the first of equals. A sample's DR is 'reference,variant'."""
    number = lambda s, i: F.get(F.split(s["DR"], ","), F.lit(i)).try_cast("bigint")
    return F.array_max(F.transform(samples, lambda s, i: F.struct(F.coalesce(number(s, 1), F.lit(-1).cast("bigint")).alias("dv"), (-i).alias("i"), number(s, 0).alias("dr"), s["GT"].alias("gt"))))


def sv_filter(sv: DataFrame, config: Config = Config(), *, skip_bad: bool = False) -> DataFrame:
    """Calls that pass all quality rules. A record with an error stops the query with its message, or is left out (skip_bad)."""
    if skip_bad:
        counted = sv.where(F.col("error").isNull()).drop("error")
    else:  # asked once, as one condition of its own: an expression that several conditions share may be computed before all of them
        counted = sv.where(F.when(F.col("error").isNull(), True).otherwise(F.raise_error(F.col("error")).isNull())).drop("error")
    if config.drop_all_mates:
        single = counted.where(F.col("mate").isNull())
    else:  # of two records that name each other, the first stays
        mates = Window.partitionBy(F.when(F.col("mate").isNotNull(), F.array_sort(F.array("sv_id", "mate"))).otherwise(F.array("sv_id", F.col("ord").cast("string"))))
        single = counted.withColumn("__n", F.row_number().over(mates.orderBy("ord"))).where("__n = 1").drop("__n")
    return single.where(quality_rule(config))


def quality_rule(config: Config = Config()) -> Column:
    """The rules on type, depth, allele share, support, chromosomes, length, and the combined score."""
    from annulus.config import SV_TYPES
    from annulus.functions.genomics import explog, vaf

    dv, dr = F.col("dv"), F.col("dr")
    share, depth = vaf(dv, dr), dv + dr
    long = F.col("svtype").isin("BND", "TRA") | (F.abs(F.col("svlen")) >= config.min_sv_len)
    return (
        ~F.coalesce(F.col("secondary"), F.lit(False))
        & F.col("svtype").isin(*SV_TYPES)
        & (depth >= config.min_cov)
        & (share >= config.min_vaf)
        & (dv >= config.min_cov_alt)
        & F.col("chr1").isin(*config.allowed)
        & F.col("chr2").isin(*config.allowed)
        & long
        & (explog(depth.cast("double"), share) < config.explog)
    )


def filter_lines(lines: DataFrame, config: Config = Config(), *, skip_bad: bool = False) -> DataFrame:
    """(ord, value) of clean lines: the header, and the lines of the calls that pass."""
    kept = sv_filter(normalise(parse(lines), config), config, skip_bad=skip_bad)
    return lines.where("value like '#%'").unionByName(lines.join(kept.select("ord"), "ord", "left_semi"))


def bad_records(lines: DataFrame, config: Config = Config()) -> DataFrame:
    """(ord, sv_id, error) of the records that lack what their caller's dialect must have."""
    return normalise(parse(lines), config).where(F.col("error").isNotNull()).select("ord", "sv_id", "error")


def filter_vcf(spark: SparkSession, path: str, config: Config = Config(), *, skip_bad: bool = False) -> DataFrame:
    """(ord, value): the file's header and the lines of the calls that pass, ready to be written as text."""
    return filter_lines(clean_lines(read_lines(spark, path), config.multi), config, skip_bad=skip_bad)


def read_calls(spark: SparkSession, path: str, config: Config = Config()) -> DataFrame:
    """A VCF file's calls that pass, in one schema."""
    return sv_filter(normalise(read_vcf(spark, path, config.multi), config), config)
