"""Sources, operators and the whole reconstruction on small inputs with known results."""

import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from annulus.config import CHROMOSOMES, Config
from annulus.operators import annotate, breakpoints, graph, quantify, search, similarity
from annulus.operators.lineage import components
from annulus.operators.solver import Frag, Part, combined, likeness, rewire_short
from annulus.plans import reconstruct
from annulus.sources import binary, sinks, tables, vcf

HEAD = "##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS\n"
CALLS = [
    ("chr2", 15633375, "DEL", "chr2", 16521051, 887676, "+-", 42), ("chr3", 11049997, "INV", "chr3", 11150002, 100005, "--", 12), ("chr3", 11049996, "INV", "chr3", 11149999, 100003, "--", 82), ("chr12", 68807721, "DUP", "chr12", 68970909, 163188, "-+", 245),
    ("chr2", 15585355, "TRA", "chr3", 10981201, 0, "--", 24), ("chr2", 15585355, "TRA", "chr3", 11060000, 0, "-+", 123), ("chr2", 15633377, "TRA", "chr3", 11160000, 0, "++", 96), ("chr2", 16628304, "TRA", "chr3", 11028469, 0, "++", 35),
]


def line(i, call, genotype=None):
    c, p, t, c2, p2, n, s, dv = call
    return f"{c}\t{p}\t{i}\tN\t<{t}>\t.\tPASS\tPRECISE;CHR2={c2};END={p2};SVTYPE={t};SVLEN={n};STRANDS={s}\tGT:DR:DV\t{genotype or f'1/1:0:{dv}'}"


@pytest.fixture(scope="module")
def call_file(tmp_path_factory):
    p = tmp_path_factory.mktemp("vcf") / "calls.vcf"
    p.write_text(HEAD + "\n".join(line(i, c) for i, c in enumerate(CALLS)) + "\nchr1 broken line\n")
    return str(p)


def write(path, *lines):
    path.write_text(HEAD + "\n".join(lines) + "\n")
    return str(path)


def test_allowed():
    """Every family whole: 25 plain names, the same with chr, and five assemblies, each accession once with its one version."""
    a = list(CHROMOSOMES)
    plain = [*map(str, range(1, 23)), "X", "Y", "M"]
    assert a[:50] == plain + [f"chr{x}" for x in plain]
    of = lambda lo, hi, form: [x for x in a for n in range(lo, hi) if x.startswith(form.format(n) + ".")]
    t2t, ref = of(255, 278, "CP068{}"), of(925, 949, "NC_060{}")
    human, mouse = of(1, 25, "NC_{:06d}"), of(67, 88, "NC_{:06d}")
    assert [len(x) for x in (t2t, ref, human, mouse)] == [23, 24, 24, 21]
    rest = set(a[50:]) - {*t2t, *ref, *human, *mouse}
    assert rest == {"CP086569.2", "CP068254.1", "NC_012920.1", "NC_005089.1"} and len(a) == len(set(a)) == 146
    assert {x[-2:] for x in t2t} == {".2"} and {x[-2:] for x in ref} == {".1"}
    assert [x for x in mouse if not x.endswith(".7")] == ["NC_000068.8", "NC_000086.8", "NC_000087.8"]
    assert [int(x.split(".")[1]) for x in human] == [11, 12, 12, 12, 10, 12, 14, 11, 12, 11, 10, 12, 11, 9, 10, 10, 11, 10, 10, 11, 9, 11, 11, 10]


def test_checkpoints_need_a_shared_folder():
    """Without spark.checkpoint.dir a local master gets its own folder; a cluster is told to name one."""
    from types import SimpleNamespace

    from annulus.operators.lineage import ensure_checkpoint_dir

    def session(master, folder=None, seen=None):
        context = SimpleNamespace(master=master, getCheckpointDir=lambda: None, setCheckpointDir=(seen if seen is not None else []).append)
        return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda k, d: folder))

    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError, match="checkpoint"):
            ensure_checkpoint_dir(session(master))
    for master, folder in (("local", None), ("local[4]", None), ("yarn", "hdfs:///x")):
        seen: list = []
        ensure_checkpoint_dir(session(master, folder, seen))
        assert len(seen) == 1 and (folder is None or seen == [folder])


def test_calls_pass_and_anchors(spark, call_file):
    assert vcf.dropped_lines(vcf.read_lines(spark, call_file)).count() == 1
    sv = vcf.read_calls(spark, call_file)
    assert sv.count() == 8
    got = {r.chr: sorted(r.a) for r in breakpoints.merge(breakpoints.breakpoints(sv)).groupBy("chr").agg(F.collect_set("anchor").alias("a")).collect()}
    assert got == {"chr2": [15585355, 15633375, 16521051, 16628304], "chr3": [10981201, 11028469, 11049996, 11060000, 11149999, 11160000], "chr12": [68807721, 68970909]}


def test_whole_reconstruction(spark, call_file):
    sv = vcf.read_calls(spark, call_file)
    frags, _ = reconstruct.encode(sv)
    rows = frags.collect()
    assert sorted(r.fid for r in rows) == list(range(1, 58, 4))
    cover = {5: 149, 13: 37, 25: 31, 33: 117, 41: 103, 53: 252}
    runs = [(r.chr, r.start, min(r.end, 2 * 10**8), float(cover.get(r.fid, 0))) for r in rows]
    coverage = spark.createDataFrame(runs, "chr string, start long, end long, value double")
    sizes = spark.createDataFrame([(c, 2 * 10**8) for c in ("chr2", "chr3", "chr12")], "chr string, length long")
    res = reconstruct.reconstruct(sv, coverage, sizes, None, Config(), wgs_mean=0.05)
    found = {tuple(r.path): r.circ_id for r in res.simple.collect()}
    assert found == {(5, -41, 33): 0, (5, 13, -25): 1, (53,): 2, (5, -41, 33, 5, 13, -25): 3}
    got = [tuple(r) for r in annotate.summary(res.circles).collect()]
    assert [(r[0], r[1], round(r[2], 6), r[3], r[4], r[6]) for r in got] == [(0, "chr2,chr3", 0.068025, "", 4, 75), (3, "chr2,chr3", 0.270566, "ecDNA", 5, 36), (2, "chr12", 0.163188, "ecDNA", 0, 252)]
    bed = annotate.bed(res.circles)
    assert [r.circ_id for r in bed.orderBy("row").collect()] == [2] + [0] * 3 + [3] * 6
    links = {r.n1: (r.n2, r.n1_side, r.n2_side) for r in annotate.links(bed).collect()}
    assert links[1] == (1, 1, 0) and links[2] == (3, 1, 1) and links[4] == (2, 1, 0) and links[10] == (5, 0, 0)
    only = annotate.bed(res.circles, only_ecdna=True, least_score=100)
    assert {r.circ_id for r in only.collect()} == {2}


def test_missing_genotype_stops(spark, tmp_path):
    p = write(tmp_path / "a.vcf", line(0, CALLS[0], "./.:.:.".replace(".:.", ".")))
    with pytest.raises(Exception, match="DR/DV has no value"):
        vcf.read_calls(spark, p).collect()


def test_unknown_caller(spark, call_file):
    with pytest.raises(ValueError, match="unknown SV caller"):
        vcf.read_calls(spark, call_file, Config(sv_caller="nobody"))


def test_wrong_caller_stops(spark, call_file):
    with pytest.raises(Exception, match="SUPPORT"):
        vcf.read_calls(spark, call_file, Config(sv_caller="sniffles2")).collect()


def test_callers(spark, tmp_path):
    s2 = write(tmp_path / "s2.vcf", "chr2\t15585355\ta\tN\t[chr3:11049996[N\t56\tPASS\tSVTYPE=BND;SUPPORT=47;COVERAGE=0,0,136;STRAND=+-\tGT:GQ:DR:DV\t0/1:60:88:47", "chr12\t68807720\tb\tN\t<DUP>\t55\tPASS\tSVTYPE=DUP;SVLEN=163189;END=68970909;SUPPORT=242;COVERAGE=None,0,223;STRAND=+-\tGT:GQ:DR:DV\t./.:0:0:0")
    r = vcf.read_calls(spark, s2, Config(sv_caller="sniffles2")).orderBy("ord").collect()
    assert [(x.chr2, x.pos2, x.strand, x.dv, x.dr, x.gt) for x in r] == [("chr3", 11049996, "++", 47, 88, "0/1"), ("chr12", 68970909, "+-", 242, 0, "1/1")]
    lumpy = write(tmp_path / "l.vcf", "chr1\t1000\ta\tN\t<DEL>\t.\tPASS\tSVTYPE=DEL;SVLEN=-5000;END=6000;STRANDS=+-:20\tGT:QA:QR:DP\t./.:20:10:30")
    x = vcf.read_calls(spark, lumpy, Config(sv_caller="lumpy")).first()
    assert (x.chr2, x.pos2, x.strand, x.dv, x.dr, x.gt) == ("chr1", 6000, "+-", 20, 10, "0/1")
    nano = write(tmp_path / "n.vcf", "chr1\t1000\ta\tN\t<DEL>\t.\tPASS\tSVTYPE=DEL;SVLEN=-5000;END=6000\tTR:VR\t30:20")
    x = vcf.read_calls(spark, nano, Config(sv_caller="nanomonsv")).first()
    assert (x.dv, x.dr) == (20, 10)
    multi = write(tmp_path / "m.vcf", "chr5\t148175216\tm\tN\t<INV>\t.\tPASS\tSVTYPE=INV;SVLEN=539;CHR2=chr5;END=148174677;STRANDS=--\tGT:DR\t./.:0,0\t./.:1,29\t0/1:3,29")
    x = vcf.read_calls(spark, multi, Config(multi=True)).first()
    assert (x.dv, x.dr, x.gt, x.strand) == (29, 1, "./.", "--")


def test_mates(spark, tmp_path):
    rec = lambda i, m: f"chr2\t15585355\t{i}\tN\t[chr3:11049996[N\t.\tPASS\tSVTYPE=BND;MATEID={m}\tGT:DR:DV\t0/1:0:47"
    p = write(tmp_path / "m.vcf", rec("a", "b"), rec("b", "a"))
    assert vcf.read_calls(spark, p, Config(sv_caller="cutesv")).count() == 0
    assert [r.sv_id for r in vcf.read_calls(spark, p, Config(sv_caller="cutesv", drop_all_mates=False)).collect()] == ["a"]


def test_filtered_file(spark, call_file, tmp_path):
    out = vcf.filter_vcf(spark, call_file, Config(min_cov_alt=40))
    sinks.write_lines(out, str(tmp_path / "out"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert len([x for x in lines if x.startswith("#")]) == 2 and len(lines) == 2 + 5


SPEC = [(1, 2, "A", "A", 0, 1, 0, 0, 28), (3, 4, "B", "B", 0, 1, 2, 0, 5), (5, 6, "C", "C", 0, 1, 4, 0, 30), (7, 8, "D", "D", 0, 1, 6, 0, 30), (2, 3, "A", "B", 1, 0, 1, 6, 3), (4, 5, "B", "C", 1, 0, 3, 6, 5), (6, 7, "C", "D", 1, 0, 5, 6, 30), (2, 5, "A", "C", 1, 0, 7, 2, 25), (3, 8, "B", "D", 0, 1, 8, 1, 2), (1, 8, "A", "D", 0, 1, 9, 1, 28)]


def spec_graph(spark, tmp_path):
    p = tmp_path / "g.tsv"
    p.write_text("# graph\n" + "\n".join("\t".join(map(str, r)) for r in SPEC) + "\n")
    return graph.from_spec(tables.read_graph(spark, str(p)))


def pairs(df):
    return {tuple(sorted((r.u, r.v))) for r in df.collect()}


def test_graph_file_and_cleaning(spark, tmp_path):
    frags, ties = spec_graph(spark, tmp_path)
    own = frags.select(F.col("tail").alias("u"), F.col("head").alias("v"))
    assert pairs(own) | pairs(ties) == {(1, 2), (1, 8), (2, 3), (2, 5), (3, 4), (3, 8), (4, 5), (5, 6), (6, 7), (7, 8)}
    kept = graph.cover_filter(frags, 6, 80_000)
    assert pairs(kept.select(F.col("tail").alias("u"), F.col("head").alias("v"))) | pairs(graph.surviving(ties, kept)) == {(1, 2), (1, 8), (2, 5), (5, 6), (6, 7), (7, 8)}
    size = {"A": 1000.0, "B": 100.0, "C": 20000.0, "D": 1500.0}
    f = frags.select(F.ascii("name").cast("long").alias("fid"), F.lit("c").alias("chr"), (F.ascii("name") * 100000).cast("long").alias("start"), (F.ascii("name") * 100000 + F.create_map(*[F.lit(x) for kv in size.items() for x in kv])[F.col("name")]).cast("long").alias("end"), "tail", "head", "edge_id", "coverage", F.create_map(*[F.lit(x) for kv in size.items() for x in kv])[F.col("name")].alias("len"))
    left, edges = search.remove_short(f, ties, 500)
    assert {chr(r.fid) for r in left.collect()} == {"A", "C", "D"}
    new = pairs(edges)
    assert {(1, 8), (2, 5), (6, 7), (5, 8)} <= new and not any(3 in x or 4 in x for x in new)
    deg = {r.node: r.degree for r in graph.degrees(ties).collect()}
    assert deg[3] == 2 and deg[8] == 2 and deg[2] == 2


def test_rewiring_moves_neighbours():
    part = Part({1: Frag(1, "c", 0, 1000, 2, 3, 4, 9, 1000), 5: Frag(5, "c", 1000, 1100, 6, 7, 8, 9, 100), 9: Frag(9, "c", 1100, 2000, 10, 11, 12, 9, 900)}, {1: (3, 6, 6, 5.0), 2: (7, 10, 6, 5.0)})
    rewire_short(part, 500)
    assert set(part.frags) == {1, 9}
    assert (part.frags[1].end, part.frags[1].length) == (1050, 1050) and (part.frags[9].start, part.frags[9].length) == (1050, 850)
    assert [(u, v, k) for u, v, k, _ in part.ties.values()] == [(3, 10, 7)]


def test_components_equal_model(spark):
    rng = random.Random(2)
    edges = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1200)] + [(5000, i) for i in range(4000, 4300)]
    up = {}
    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x
    for a, b in edges:
        p, q = root(a), root(b)
        up[max(p, q)] = min(p, q)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for a, b in edges if a != b for x in (a, b)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_prunes_equal_models(spark):
    rng = random.Random(4)
    length = {i: float(rng.randint(1, 9)) for i in range(12)}
    circles = {c: tuple(rng.sample(range(12), rng.randint(1, 5))) for c in range(40)}
    score = {c: float(rng.randint(1, 5)) for c in circles}
    w = spark.createDataFrame([(c, f, 1, length[f]) for c, p in circles.items() for f in p], "circ_id long, fid long, mult long, len double")
    j = similarity.jaccard(w, multiset=False, above=0.4)
    alike = lambda a, b: likeness(circles[a], circles[b], length)
    kept = {c for c in circles if not any(d > c and alike(c, d) > 0.5 for d in circles)}
    df = spark.createDataFrame([(c, score[c], c) for c in circles], "circ_id long, score double, ord long").withColumn("first", F.lit(1))
    assert {r.circ_id for r in similarity.prune_near_identical(df, j, threshold=0.5).collect()} == kept
    best = {c for c in circles if not any(alike(c, d) > 0.4 and (score[d], -d) > (score[c], -c) for d in circles if d != c)}
    assert {r.circ_id for r in similarity.prune_by_score(df, j, threshold=0.4).collect()} == best


def test_lasso_is_optimal():
    rng = np.random.default_rng(0)
    for _ in range(20):
        x, y = rng.normal(size=(12, 4)), rng.normal(size=12) * 5
        w = quantify.positive_lasso(x, y, alpha=0.1, steps=5000, tolerance=1e-10)
        cost = lambda v: ((y - y.mean() - (x - x.mean(0)) @ v) ** 2).sum() / 24 + 0.1 * v.sum()
        assert (w >= 0).all()
        for _ in range(200):
            assert cost(w) <= cost(np.maximum(0, w + rng.normal(size=4) * 0.05)) + 1e-6


def test_combining_is_bounded():
    raw = [(1, 2), (1, 3), (1, 4)]
    length = {i: 10.0 for i in range(5)}
    assert (1, 2, 1, 3) in combined(raw, length)
    with pytest.raises(ValueError):
        combined(raw, length, most=2)


def test_text_tables(spark, tmp_path):
    (tmp_path / "g.fa").write_text(">chr1 first\nACGT\nAC\n>chr2\nTTT\n")
    assert {(r.chr, r.seq) for r in tables.read_fasta(spark, str(tmp_path / "g.fa")).collect()} == {("chr1", "ACGTAC"), ("chr2", "TTT")}
    (tmp_path / "c.bg").write_text("chr1\t0\t50\t3.5\n")
    assert tuple(tables.read_bedgraph(spark, str(tmp_path / "c.bg")).first()) == ("chr1", 0, 50, 3.5)
    rows = spark.createDataFrame([(0, 1, "chr1", 1, 3, "+"), (0, 2, "chr1", 0, 3, "-")], "circ_id long, row long, chr string, start long, end long, strand string")
    seq = annotate.sequences(rows, tables.read_fasta(spark, str(tmp_path / "g.fa")))
    assert seq.first().seq == "CG" + "CGT"
    sinks.write_fasta(seq, str(tmp_path / "o"))
    assert [r.value for r in spark.read.text(str(tmp_path / "o")).collect()] == [">0", "CGCGT"]


def bam(records):
    raw = b"BAM\1" + struct.pack("<I", 0) + struct.pack("<I", 1) + struct.pack("<I", 5) + b"chr1\0" + struct.pack("<I", 10**6)
    for name, pos, flag, cigar, n in records:
        body = struct.pack("<iiBBHHHiiii", 0, pos, len(name) + 1, 60, 0, len(cigar), flag, n, -1, -1, 0) + name.encode() + b"\0" + b"".join(struct.pack("<I", size << 4 | op) for size, op in cigar) + bytes((n + 1) // 2) + bytes(n)
        raw += struct.pack("<I", len(body)) + body
    out = b""
    for i in range(0, len(raw), 60):  # records cross blocks
        z = zlib.compressobj(6, zlib.DEFLATED, -15)
        data = z.compress(raw[i : i + 60]) + z.flush()
        out += struct.pack("<4BI2BH2BHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(data) + 25) + data + struct.pack("<II", zlib.crc32(raw[i : i + 60]), len(raw[i : i + 60]))
    return out


def test_bam(spark, tmp_path):
    (tmp_path / "a.bam").write_bytes(bam([("r1", 100, 0, [(50, 0), (10, 2), (5, 1)], 55), ("r2", 200, 256, [(20, 0)], 20), ("r3", 300, 4, [], 7)]))
    got = [tuple(r) for r in tables.read_bam(spark, str(tmp_path / "a.bam")).orderBy("name").collect()]
    assert got == [("r1", "chr1", 100, 160, 55, True, False), ("r2", "chr1", 200, 220, 20, True, True), ("r3", "chr1", 300, 300, 7, False, False)]


def bigwig():
    """Header, a one-leaf name tree, one block of each kind, a one-leaf index."""
    blocks = [struct.pack("<5IBBH", 0, 0, 60, 0, 0, 1, 0, 2) + struct.pack("<IIfIIf", 0, 10, 1.5, 20, 60, 2.0), struct.pack("<5IBBH", 0, 100, 140, 0, 20, 2, 0, 2) + struct.pack("<IfIf", 100, 3.0, 120, 4.0), struct.pack("<5IBBH", 0, 200, 250, 25, 25, 3, 0, 2) + struct.pack("<ff", 5.0, 6.0)]
    tree = struct.pack("<4IQQ", 0x78CA8C91, 1, 4, 8, 1, 0) + struct.pack("<BBH", 1, 0, 1) + b"chr1" + struct.pack("<II", 0, 1000)
    at = 64 + len(tree)
    packed, places = b"", []
    for b in blocks:
        z = zlib.compress(b)
        places.append((at + len(packed), len(z)))
        packed += z
    index = struct.pack("<4I", 0x2468ACE0, 256, 3, 0) + bytes(32) + struct.pack("<BBH", 1, 0, 3) + b"".join(struct.pack("<4IQQ", 0, 0, 0, 0, p, n) for p, n in places)
    head = struct.pack("<IHHQQQHHQQIQ", 0x888FFC26, 4, 0, 64, at, at + len(packed), 0, 0, 0, 0, 1 << 15, 0)
    return head + tree + packed + index


def test_bigwig(spark, tmp_path):
    (tmp_path / "c.bw").write_bytes(bigwig())
    got = [tuple(r) for r in tables.read_bigwig(spark, str(tmp_path / "c.bw")).orderBy("start").collect()]
    assert got == [("chr1", 0, 10, 1.5), ("chr1", 20, 60, 2.0), ("chr1", 100, 120, 3.0), ("chr1", 120, 140, 4.0), ("chr1", 200, 225, 5.0), ("chr1", 225, 250, 6.0)]
    assert tuple(tables.read_bigwig_sizes(spark, str(tmp_path / "c.bw")).first()) == ("chr1", 1000)
    assert binary.BIGWIG


def test_entry_without_corpus_parts(tmp_path):
    """The entry imports and keeps its other queries when the corpus subpackage and the pipeline are gone."""
    import pathlib
    import shutil
    import subprocess
    import sys

    root = pathlib.Path(__file__).resolve().parents[1]
    shutil.copytree(root / "annulus", tmp_path / "annulus", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); assert 'sv_edges' in q and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"], cwd=tmp_path, capture_output=True, text=True)
    assert said.returncode == 0, said.stderr
