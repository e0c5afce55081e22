"""Sequences in blocks and alignments, against plain models."""

import random

import pytest
from pyspark.sql import functions as F

from annulus import cli
from annulus.operators import alignment, annotate, sequences
from annulus.sources import tables

COMPLEMENT = str.maketrans("ACGTN", "TGCAN")


def flip(s):
    return s.translate(COMPLEMENT)[::-1]


def blocks(spark, seqs, size, key="circ_id"):
    return sequences.of_whole(spark.createDataFrame(list(seqs.items()), f"{key} string, seq string"), key, size)


def bases(rng, n):
    return "".join(rng.choice("ACGT") for _ in range(n))


def test_fasta_blocks(spark, tmp_path):
    """Records over many splits, a line longer than blocks, names with remarks, an empty record, white space and a header without a name."""
    rng = random.Random(1)
    seqs = {"a": bases(rng, 5000), "b": "", "c": bases(rng, 17), "d": bases(rng, 3000), "e": bases(rng, 60)}
    with open(tmp_path / "g.fa", "w") as f:
        f.write("junk\n")
        for name, s in seqs.items():
            f.write(f">{name} remark\n")
            width = 3000 if name == "d" else 31
            for i in range(0, len(s), width):
                f.write(s[i : i + width] + (" \n" if i % 2 else "\n"))
    with open(tmp_path / "h.fa", "w") as f:
        f.write(">z\nACGT\n>\nTTTT\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "10")
    try:
        got = tables.read_fasta_blocks(spark, str(tmp_path), 128)
        rows = got.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert max(len(r.seq) for r in rows) == 128
    want = {n: s for n, s in seqs.items() if s} | {"z": "ACGT"}
    held = {}
    for r in rows:
        assert len(r.seq) == min(128, len(want[r.chr]) - 128 * r.block)
        held.setdefault(r.chr, {})[r.block] = r.seq
    assert {n: "".join(x[b] for b in sorted(x)) for n, x in held.items()} == want


@pytest.mark.parametrize("size", [16, 100])
def test_circle_over_many_blocks(spark, size):
    rng = random.Random(2)
    genome = {f"chr{i}": bases(rng, rng.randint(1, 900)) for i in range(4)}
    rows = [(f"c{c}", i, f"chr{rng.randint(0, 4)}", a := rng.randint(0, 900), a + rng.randint(0, 700), rng.choice("+-")) for c in range(12) for i in range(rng.randint(1, 6))]
    table = spark.createDataFrame(rows, "circ_id string, row long, chr string, start long, end long, strand string")
    got = sequences.circle_blocks(table, blocks(spark, genome, size, "chr"), size)
    assert max(len(r.seq) for r in got.collect()) <= size
    want = {}
    for c, i, name, a, b, strand in rows:
        part = genome.get(name, "")[a:b]
        want[c] = want.get(c, "") + (flip(part) if strand == "-" else part)
    want = {c: s for c, s in want.items() if s}
    assert {r.circ_id: r.seq for r in sequences.whole(got, "circ_id").collect()} == want
    plain = {r.circ_id: r.seq for r in annotate.sequences(table, spark.createDataFrame(list(genome.items()), "chr string, seq string")).collect()}
    assert {c: s for c, s in plain.items() if s} == want
    assert {(r.circ_id, r.length) for r in sequences.lengths(got, "circ_id", size).collect()} == {(c, len(s)) for c, s in want.items()}


def test_fasta_lines(spark, tmp_path):
    rng = random.Random(3)
    seqs = {"a": bases(rng, 250), "b": bases(rng, 60), "c": bases(rng, 7)}
    sequences.fasta_lines(blocks(spark, seqs, 120)).write.text(str(tmp_path / "o"))
    assert {r.chr: r.seq for r in tables.read_fasta(spark, str(tmp_path / "o")).collect()} == seqs
    assert max(len(r.value) for r in spark.read.text(str(tmp_path / "o")).collect()) == 60


def exact_matches(queries, subjects, k):
    """All longest runs of equal bases, from the table of all pairs of places."""
    out = set()
    for q, x in queries.items():
        for strand, y in (("+", x), ("-", flip(x.upper()))):
            shift = 0 if strand == "+" else len(x)
            for s, z in subjects.items():
                y, z = y.upper(), z.upper()
                for d in range(-len(y) + 1, len(z)):
                    start = None
                    for i in range(max(0, -d), min(len(y), len(z) - d) + 1):
                        same = i < len(y) and i + d < len(z) and y[i] == z[i + d] and y[i] in "ACGT"
                        if same and start is None:
                            start = i
                        if not same and start is not None:
                            if i - start >= k:
                                out.add((q, s, strand, d + shift, start - shift, i - shift))
                            start = None
    return out


def test_matches(spark):
    """Shared parts on both strands, long repeats, other letters, lower case, matches at the ends of sequences, words over blocks."""
    rng = random.Random(4)
    core = bases(rng, 90)
    queries = {"q1": bases(rng, 40) + core + bases(rng, 20), "q2": flip(core) + "N" + core[:50], "q3": "A" * 60 + "CA" * 20, "q4": core.lower(), "q5": "ACG", "q6": core[:30] + "N" + core[31:]}
    subjects = {"s1": core + "AC" * 30, "s2": "TT" + "A" * 45 + core[10:80], "s3": flip(core), "s4": core[:30] + "N" + core[31:60] + "n" * 20}
    got = alignment.matches(blocks(spark, queries, 32), blocks(spark, subjects, 32), k=8, size=32)
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == exact_matches(queries, subjects, 8)
    plus = alignment.matches(blocks(spark, queries, 32), blocks(spark, subjects, 32), k=8, size=32, both=False)
    assert {tuple(r) for r in plus.collect()} == {r for r in rows if r[2] == "+"}
    assert alignment.matches(blocks(spark, {}, 32), blocks(spark, subjects, 32), k=8, size=32).count() == 0


def walk(equal, x_drop):
    """Bases and differing ones of the best stretch from the start, whether the end was reached alive."""
    score = best = n = diff = bad = 0
    for i, e in enumerate(equal):
        score += 1 if e else -2
        bad += not e
        if score > best:
            best, n, diff = score, i + 1, bad
        if best - score > x_drop:
            return n, diff, False
    return n, diff, True


def model_hits(queries, subjects, k, x_drop):
    """Diagonal by diagonal: from each match to the right for as long as the score doesn't fall too far, and to the left from the first."""
    out = set()
    for q, s, strand, d, *_ in {r[:4] for r in exact_matches(queries, subjects, k)}:
        x = queries[q] if strand == "+" else flip(queries[q])
        shift = 0 if strand == "+" else len(x)
        z, d0 = subjects[s], d - shift
        lo, hi = max(0, -d0), min(len(x), len(z) - d0)
        eq = [x[i] == z[i + d0] and x[i] in "ACGT" for i in range(lo, hi)]
        runs = sorted((r[4] + shift - lo, r[5] + shift - lo) for r in exact_matches({q: queries[q]}, {s: z}, k) if r[2] == strand and r[3] == d)
        i = 0
        while i < len(runs):
            first, end, diff, reached = runs[i][0], runs[i][1], 0, i
            while reached + 1 < len(runs):
                a, b, alive = walk(eq[end : runs[reached + 1][0]], x_drop)
                if not alive:
                    break
                diff += sum(not e for e in eq[end : runs[reached + 1][0]])
                reached += 1
                end = runs[reached][1]
            more, more_diff, _ = walk(eq[end:], x_drop)
            less, less_diff, _ = walk(eq[:first][::-1], x_drop)
            a, b, n = first - less + lo, end + more + lo, diff + more_diff + less_diff
            at = (a + 1, b, a + d0 + 1, b + d0) if strand == "+" else (len(x) - b + 1, len(x) - a, b + d0, a + d0 + 1)
            out.add((q, s, b - a, n, *at))
            i = reached + 1
    return out


def test_hits(spark):
    """Differing bases alone, in pairs and in stretches that a walk doesn't survive; ends of sequences; both strands."""
    rng = random.Random(5)

    def worn(s, every):
        return "".join(rng.choice("ACGT") if rng.random() < 1 / every else c for c in s)

    core = bases(rng, 300)
    queries = {"q1": bases(rng, 30) + worn(core, 15) + bases(rng, 30), "q2": flip(worn(core, 12)), "q3": core[:100] + bases(rng, 12) + core[112:180] + bases(rng, 60) + core[240:], "q4": core}
    subjects = {"s1": bases(rng, 50) + core + bases(rng, 10), "s2": worn(core, 20), "s3": bases(rng, 120)}
    a, b = blocks(spark, queries, 64), blocks(spark, subjects, 64)
    found = alignment.hits(a, b, k=12, x_drop=10, size=64)
    rows = found.collect()
    got = [(r.qseqid, r.sseqid, r.alignment_length, r.number_mismatches, r.query_start, r.query_end, r.subject_start, r.subject_end) for r in rows]
    assert len(got) == len(set(got)) and set(got) == model_hits(queries, subjects, 12, 10)
    for r in rows:
        x = queries[r.qseqid][r.query_start - 1 : r.query_end]
        y = subjects[r.sseqid][min(r.subject_start, r.subject_end) - 1 : max(r.subject_start, r.subject_end)]
        x = flip(x) if r.subject_start > r.subject_end else x
        assert sum(c != d for c, d in zip(x, y)) == r.number_mismatches and abs(r.pident - 100 * (1 - r.number_mismatches / len(x))) < 1e-9
    whole = [r for r in rows if (r.qseqid, r.sseqid) == ("q4", "s1") and r.subject_start < r.subject_end and r.alignment_length > 250]
    assert len(whole) == 1 and whole[0].number_mismatches == 0 and (whole[0].subject_start, whole[0].query_start) <= (51, 1)
    back = {tuple(r) for r in alignment.turned_round(found).select("qseqid", "sseqid", "query_start", "subject_start").collect()}
    assert back == {(r.sseqid, r.qseqid, r.subject_start, r.query_start) for r in rows if r.subject_start < r.subject_end}
    assert alignment.hits(a.where(F.lit(False)), b, k=12, x_drop=10, size=64).count() == 0


def test_validate_from_genome(spark, tmp_path):
    """A true circle that is found whole, one of which half is found, one on the other strand, and one that isn't found."""
    rng = random.Random(6)
    genome = {"chr1": bases(rng, 9000), "chr2": bases(rng, 5000)}
    (tmp_path / "g.fa").write_text("".join(f">{n}\n" + "\n".join(s[i : i + 60] for i in range(0, len(s), 60)) + "\n" for n, s in genome.items()))
    true = [("chr1", 0, 2000, "+", "t", 5, "whole", "f1"), ("chr1", 3000, 4500, "+", "t", 5, "half", "f2"), ("chr2", 0, 1500, "+", "t", 5, "half", "f3"), ("chr1", 6000, 7500, "+", "t", 5, "turned", "f4"), ("chr2", 3000, 4800, "+", "t", 5, "lost", "f5")]
    (tmp_path / "true.bed").write_text("#chr\tstart\tstop\tdirection\ttarget\tcoverage\tstructure\tfragment\n" + "".join("\t".join(map(str, r)) + "\n" for r in true))
    found = [("chr1", 0, 2000, "1", "f1", "+", 9, 9), ("chr1", 3000, 4500, "2", "f2", "+", 9, 9), ("chr1", 6000, 7500, "3", "f3", "-", 9, 9)]
    (tmp_path / "found.bed").write_text("#chr\tstart\tend\tcirc_id\tfragment_id\tstrand\tcoverage\testimated_proportions\n" + "".join("\t".join(map(str, r)) + "\n" for r in found))
    assert cli.main(["validate", "-a", f"{tmp_path}/true.bed", "-b", f"{tmp_path}/found.bed", "-r", f"{tmp_path}/g.fa", "-o", f"{tmp_path}/out"]) == 0
    rows = {(r.true_id, r.reconstruct_id): (float(r.pident_true), float(r.pident_reconstruct)) for r in spark.read.csv(f"{tmp_path}/out", sep="\t", header=True).collect()}
    assert len(rows) == 12
    assert rows["whole", "1"] == (1.0, 1.0) and rows["turned", "3"] == (0.0, 0.0)
    assert abs(rows["half", "2"][0] - 1500 / 3000) < 0.01 and rows["half", "2"][1] == 1.0
    assert all(v == (0.0, 0.0) for k, v in rows.items() if k not in {("whole", "1"), ("half", "2")})
    with pytest.raises(SystemExit):
        cli.main(["validate", "-a", "a", "-b", "b", "-o", "o"])
