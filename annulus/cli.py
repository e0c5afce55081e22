"""Command line: reconstruct, filter, validate."""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from annulus.config import SV_CALLERS, Config
from annulus.operators import annotate, validate
from annulus.operators.lineage import durable
from annulus.operators.sequences import circle_blocks
from annulus.plans import reconstruct
from annulus.sources import sinks, tables, vcf


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="annulus")
    sub = p.add_subparsers(dest="command", required=True)
    r = sub.add_parser("reconstruct", help="circles from calls, coverage and reads")
    r.add_argument("-i", "--vcf", required=True)
    r.add_argument("-c", "--coverage", required=True, help="bigWig, or bedGraph with --sizes")
    r.add_argument("--sizes", help="chromosome lengths, for a bedGraph")
    r.add_argument("-b", "--bam", help="reads, as BAM or as a table")
    r.add_argument("-r", "--reference-genome", help="FASTA, for sequences of the circles")
    r.add_argument("-o", "--outputdir", required=True)
    d = Config()
    for name, kind in (("min-sv-len", int), ("fragment-min-cov", float), ("fragment-max-cov", float), ("fragment-min-size", int), ("min-vaf", float), ("min-cov-alt", int), ("min-cov", int), ("filter-score", int)):
        r.add_argument(f"--{name}", type=kind, default=getattr(d, name.replace("-", "_")))
    r.add_argument("--max-explog-threshold", type=float, default=d.explog)
    r.add_argument("--sv-caller", choices=SV_CALLERS, default=d.sv_caller)
    r.add_argument("--extend-allowed-chr", default="", help="comma-separated")
    r.add_argument("--downsampling", type=float, default=0, help="coverage to bring the genome's mean down to; 0: off")
    for flag in ("fast", "multi", "skip"):
        r.add_argument(f"--{flag}", action="store_true")
    f = sub.add_parser("filter", help="a VCF file's calls that pass")
    f.add_argument("-i", "--vcf", required=True)
    f.add_argument("-o", "--output", required=True)
    f.add_argument("--sv-caller", choices=SV_CALLERS, default=d.sv_caller)
    f.add_argument("--multi", action="store_true", help="several samples in one file")
    v = sub.add_parser("validate", help="reconstructed circles against true ones")
    v.add_argument("-a", "--true", required=True)
    v.add_argument("-b", "--reconstructed", required=True)
    v.add_argument("-r", "--reference-genome", help="FASTA: circles are aligned by their sequences")
    v.add_argument("--true-hits", help="without a genome: hits of true circles on reconstructed ones, as an aligner's table")
    v.add_argument("--reconstructed-hits", help="without a genome: the other way round")
    v.add_argument("-o", "--output", required=True)
    return p


def run_reconstruct(spark: SparkSession, a: argparse.Namespace) -> None:
    config = Config(min_sv_len=a.min_sv_len, fragment_min_cov=a.fragment_min_cov, fragment_max_cov=a.fragment_max_cov, fragment_min_size=a.fragment_min_size, min_vaf=a.min_vaf, min_cov_alt=a.min_cov_alt, min_cov=a.min_cov, filter_score=a.filter_score, explog=a.max_explog_threshold, sv_caller=a.sv_caller, fast=a.fast, multi=a.multi, extra_chromosomes=tuple(a.extend_allowed_chr.split(",")))
    if a.sizes:
        coverage, sizes = tables.read_bedgraph(spark, a.coverage), tables.read_sizes(spark, a.sizes)
    else:
        coverage, sizes = tables.read_bigwig(spark, a.coverage), tables.read_bigwig_sizes(spark, a.coverage)
    if a.downsampling:
        from annulus.operators.fragments import genome_mean

        config = config.with_(downsampling_ratio=float(genome_mean(coverage, sizes, config.allowed).first()["wgs_mean"]) / a.downsampling)
    reads = None if not a.bam else tables.read_bam(spark, a.bam) if a.bam.endswith(".bam") else tables.read_reads(spark, a.bam)
    clean = vcf.clean_lines(vcf.read_lines(spark, a.vcf), config.multi)
    sinks.write_lines(clean, f"{a.outputdir}/clean.vcf")
    sinks.write_lines(vcf.filter_lines(clean, config), f"{a.outputdir}/clean_filtered.vcf")
    res = reconstruct.reconstruct(vcf.read_calls(spark, a.vcf, config), coverage, sizes, reads, config)
    out, ratio = a.outputdir, config.downsampling_ratio
    covered = res.initial.where(F.col("coverage") < float("inf"))
    sinks.write_tsv(sinks.fragments_table(annotate.fragments_bed(covered, ratio=ratio)), f"{out}/fragments_initial.bed")
    sinks.write_tsv(sinks.fragments_table(annotate.fragments_bed(res.graph.fragments, ratio=ratio)), f"{out}/fragments_clean.bed")
    for i, step in enumerate(res.steps, 1):
        covered = step.where(F.col("coverage") < float("inf"))
        sinks.write_tsv(sinks.fragments_table(annotate.fragments_bed(covered, ratio=ratio)), f"{out}/fragments_clean_{i}.bed")
    sinks.save_graph(res.graph.fragments, res.graph.edges, f"{out}/graph")
    sinks.write_json(res.circles, f"{out}/reconstruct.json")
    sinks.write_tsv(annotate.summary(res.circles), f"{out}/summary.txt")
    every = res.uncombined.withColumns({"score": F.lit(0.0), "ord": F.col("circ_id"), "label": F.lit("")})
    genome = durable(tables.read_fasta_blocks(spark, a.reference_genome)) if a.reference_genome and not a.skip else None
    versions = {"": {}, ".ecDNA": {"only_ecdna": True}, ".ecDNA.filtered": {"only_ecdna": True, "least_score": config.filter_score}}
    for name, keep in versions.items():
        rows = annotate.bed(res.circles, **keep)
        sinks.write_tsv(sinks.bed_table(rows), f"{out}/reconstruct{name}.bed")
        sinks.write_tsv(sinks.links_table(annotate.links(rows)), f"{out}/reconstruct.links{name}.txt")
        if genome is not None:
            sinks.write_fasta_blocks(circle_blocks(rows, genome), f"{out}/reconstruct{name}.fasta")
    rows = annotate.bed(every)
    sinks.write_tsv(sinks.bed_table(rows), f"{out}/reconstruct.bed_debug")
    sinks.write_tsv(sinks.links_table(annotate.links(rows)), f"{out}/reconstruct.links.txt_debug")


def main(argv: list[str] | None = None) -> int:
    p = parser()
    a = p.parse_args(argv)
    if a.command == "validate" and not a.reference_genome and not (a.true_hits and a.reconstructed_hits):
        p.error("validate needs a genome, or hits in both directions")
    spark = SparkSession.builder.appName("annulus").getOrCreate()
    began = time.time()
    if a.command == "reconstruct":
        run_reconstruct(spark, a)
    elif a.command == "filter":
        config = Config(sv_caller=a.sv_caller, multi=a.multi)
        for r in vcf.bad_records(vcf.clean_lines(vcf.read_lines(spark, a.vcf), a.multi), config).orderBy("ord").limit(20).collect():  # a report
            print(f"##WARNING: record {r.sv_id} left out: {r.error}")
        sinks.write_lines(vcf.filter_vcf(spark, a.vcf, config, skip_bad=True), a.output)
    else:
        size = lambda rows, key: rows.groupBy(F.col(key).cast("string").alias("qseqid")).agg(F.sum(F.abs(F.col("end") - F.col("start"))).alias("length"))
        true, found = tables.read_truth(spark, a.true), tables.read_circles(spark, a.reconstructed)
        if a.reference_genome:
            true_hits, found_hits = validate.hits_from_genome(true, found, tables.read_fasta_blocks(spark, a.reference_genome))
        else:
            true_hits, found_hits = tables.read_hits(spark, a.true_hits), tables.read_hits(spark, a.reconstructed_hits)
        one = validate.identity(validate.good_hits(true_hits), size(true, "circ_id"))
        two = validate.identity(validate.good_hits(found_hits), size(found, "circ_id"))
        sinks.write_tsv(validate.compare(validate.circles_of_bed(true), validate.circles_of_bed(found), one, two), a.output)
    print(f"User time (seconds): {time.time() - began:.1f}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
