"""The command line on a small sample, and calls as a stream."""

import pytest

from annulus import cli
from annulus.config import Config
from annulus.operators import fragments
from annulus.plans import reconstruct
from annulus.sources import tables, vcf
from annulus.streaming.calls import breakpoint_counts, stream_calls
from tests.test_engine import CALLS, HEAD, line


@pytest.fixture(scope="module")
def sample(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("sample")
    (d / "calls.vcf").write_text(HEAD + "\n".join(line(i, c) for i, c in enumerate(CALLS)) + "\n")
    frags, _ = reconstruct.encode(vcf.read_calls(spark, str(d / "calls.vcf")))
    cover = {5: 149, 13: 37, 25: 31, 33: 117, 41: 103, 53: 252}
    (d / "c.bg").write_text("".join(f"{r.chr}\t{r.start}\t{min(r.end, 2 * 10**8)}\t{cover.get(r.fid, 0)}\n" for r in frags.collect()))
    (d / "sizes").write_text("".join(f"{c}\t200000000\n" for c in ("chr2", "chr3", "chr12")))
    return d


def test_reconstruct_and_filter(spark, sample):
    out = sample / "out"
    assert cli.main(["reconstruct", "-i", f"{sample}/calls.vcf", "-c", f"{sample}/c.bg", "--sizes", f"{sample}/sizes", "-o", str(out), "--fast"]) == 0
    rows = spark.read.csv(f"{out}/summary.txt", sep="\t", header=True).collect()
    assert {(r.circ_id, r["topology_name"]) for r in rows} == {("0", "multi_region_inter_chr"), ("2", "simple_circle"), ("3", "simple_duplications")}
    bed = spark.read.csv(f"{out}/reconstruct.ecDNA.bed", sep="\t", header=True)
    assert bed.columns == ["#chr", "start", "end", "circ_id", "fragment_id", "strand", "coverage", "estimated_proportions"]
    assert {r.circ_id for r in bed.collect()} == {"2", "3"}
    assert spark.read.text(f"{out}/clean.vcf").count() == spark.read.text(f"{out}/clean_filtered.vcf").count() == 10
    assert cli.main(["filter", "-i", f"{sample}/calls.vcf", "-o", f"{sample}/f"]) == 0
    assert spark.read.text(f"{sample}/f").count() == 10


def test_dumps(spark, sample):
    """The dumps of each cleaning step and the debug tables of circles before combining."""
    out = sample / "dumps"
    assert cli.main(["reconstruct", "-i", f"{sample}/calls.vcf", "-c", f"{sample}/c.bg", "--sizes", f"{sample}/sizes", "-o", str(out), "--fast"]) == 0
    read = lambda name: spark.read.csv(f"{out}/{name}", sep="\t", header=True).collect()
    steps = [{r.fid for r in read(f"fragments_clean_{i}.bed")} for i in (1, 2, 3, 4)]
    assert steps[0] >= steps[1] > steps[2] >= steps[3] and steps[3] == {r.fid for r in read("fragments_clean.bed")}
    bed, links = read("reconstruct.bed_debug"), read("reconstruct.links.txt_debug")
    assert len(links) == len(bed) and {r.circ_id for r in links} == {r.circ_id for r in bed}
    res = reconstruct.reconstruct(vcf.read_calls(spark, f"{sample}/calls.vcf"), *(f(spark, f"{sample}/{n}") for f, n in ((tables.read_bedgraph, "c.bg"), (tables.read_sizes, "sizes"))), None, Config(fast=True))
    one = {r.circ_id: r.path for r in res.uncombined.collect()}
    every = {r.circ_id: r.path for r in res.simple.collect()}
    assert {r.circ_id for r in bed} == {str(i) for i in one} and all(every[i] == p for i, p in one.items()) and len(one) < len(every)


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.vcf").write_text(HEAD + "\n".join(line(i, c) for i, c in enumerate(CALLS[:4])) + "\nbroken line\n")
    (tmp_path / "in/b.vcf").write_text(HEAD + "\n".join(line(i, c) for i, c in enumerate(CALLS[4:])) + "\n")
    calls = stream_calls(spark, str(tmp_path / "in"), files_per_trigger=1)
    q = calls.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start(str(tmp_path / "out"))
    q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert {(r.sample, r.chr1, r.pos1) for r in got.collect()} == {("a.vcf" if i < 4 else "b.vcf", c[0], c[1]) for i, c in enumerate(CALLS)}
    q = breakpoint_counts(calls).writeStream.format("memory").queryName("bins").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {tuple(r) for r in spark.table("bins").collect()} == {tuple(r) for r in breakpoint_counts(got).collect()}
    with pytest.raises(ValueError):
        stream_calls(spark, str(tmp_path), Config(drop_all_mates=False))


def test_spatial_plan(spark):
    f = spark.createDataFrame([(1, "c", 0, 1000), (5, "c", 1000, 2000), (9, "c", 2100, 3000)], "fid long, chr string, start long, end long")
    assert [tuple(r) for r in fragments.adjacent(f).collect()] == [(1, 5, "c", 1000)]
