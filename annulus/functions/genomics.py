"""Scalar column functions over variants and fragments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from annulus.config import TOPOLOGIES, Config

MATE = r"^.*[\[\]]([^:]+):(\d+)[\[\]].*$"


def vaf(dv: Column, dr: Column) -> Column:
    """Share of reads for the variant, with one read added."""
    return dv / (dv + dr + F.lit(1))


def explog(coverage: Column, share: Column) -> Column:
    """Falls from 1 towards 0 as coverage and allele share grow."""
    return F.pow(F.lit(3.0), -coverage * share / F.log(coverage + F.lit(0.001)))


def mate_chromosome(alt: Column) -> Column:
    return F.nullif(F.regexp_extract(alt, MATE, 1), F.lit(""))


def mate_position(alt: Column) -> Column:
    return F.nullif(F.regexp_extract(alt, MATE, 2), F.lit("")).cast("bigint")


def bnd_strand(alt: Column) -> Column:
    """Orientations of a break end and its mate: the first by where the bracket stands, the second by which bracket it is."""
    own = F.when(alt.startswith("[") | alt.startswith("]"), "+").otherwise("-")
    return F.concat(own, F.when(alt.contains("["), "+").otherwise("-"))


def genotype(share: Column) -> Column:
    return F.when(share <= 0.3, "0/0").when(share <= 0.7, "0/1").otherwise("1/1")


def is_homozygous(dv: Column, dr: Column) -> Column:
    return dv / (dv + dr) > 0.7


def normalised_coverage(coverage: Column, wgs: Column, length: Column) -> Column:
    return coverage / (wgs + 1) * (F.lit(1e6) / length)


def within(a: Column, b: Column, distance: int) -> Column:
    return F.abs(a - b) <= distance


def coordinates(chrom: Column, start: Column, end: Column) -> Column:
    return F.concat(chrom, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"))


def reverse_complement(seq: Column) -> Column:
    """IUPAC letters of either case; others stay."""
    letters, partners = "ACGTUMRWSYKVHDBN", "TGCAAKYWSRMBDHVN"
    return F.reverse(F.translate(seq, letters + letters.lower(), partners + partners.lower()))


def label(size_mb: Column, config: Config = Config()) -> Column:
    return F.when(size_mb > config.ecdna_min_mb, "ecDNA").otherwise("")


def topology_index(n: Column, small_del: Column, dup: Column, inv: Column, interchr: Column, multi: Column, foldback: Column) -> Column:
    """The last rule that holds decides, so the rules are asked from last to first. Flags are booleans."""
    rule = F.when(foldback, 6).when(dup, 5).when(interchr, 4).when(multi, 3).when(small_del & inv, 2).when(inv | small_del, 1).otherwise(0)
    return F.when(n == 1, 0).otherwise(rule).cast("int")


def topology_name(index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, TOPOLOGIES)), index + 1)


def downsampled(x: Column, ratio: float) -> Column:
    """Half to even, as counts are rounded."""
    return F.bround(x / F.lit(float(ratio)), 0).cast("bigint")
