"""BAM and bigWig files: rows by ranges and by regions equal those of the whole file, and only the ranges named are read."""

import random
import struct
import zlib

import pytest

from annulus.sources import binary, tables

CHROMS = [("chr1", 2_000_000), ("chr2", 900_000), ("chr3", 5000)]


def block(data):
    z = zlib.compressobj(6, zlib.DEFLATED, -15)
    d = z.compress(data) + z.flush()
    return struct.pack("<4BI2BH2BHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(d) + 25) + d + struct.pack("<II", zlib.crc32(data), len(data))


def bin_of(a, b):
    """The smallest bin that holds bases a to b, level by level from the finest."""
    for level in range(5, 0, -1):
        if a >> (29 - 3 * level) == (b - 1) >> (29 - 3 * level):
            return ((1 << 3 * level) - 1) // 7 + (a >> (29 - 3 * level))
    return 0


def write_bam(path, records, block_size):
    """records: (ref, pos, name, cigar, flag) by ref and pos, unplaced ones last. A .bai of its bins, linear index and count bins beside it."""
    raw = b"BAM\1" + struct.pack("<I", 3) + b"@HD" + struct.pack("<I", len(CHROMS))
    for n, size in CHROMS:
        raw += struct.pack("<I", len(n) + 1) + n.encode() + b"\0" + struct.pack("<I", size)
    at = []
    for ref, pos, name, cigar, flag in records:
        body = struct.pack("<iiBBHHHiiii", ref, pos, len(name) + 1, 60, 0, len(cigar), flag, 10, -1, -1, 0) + name.encode() + b"\0" + b"".join(struct.pack("<I", n << 4 | op) for n, op in cigar) + bytes(15)
        at.append(len(raw))
        raw += struct.pack("<I", len(body)) + body
    at.append(len(raw))
    places, out = [], b""
    for i in range(0, len(raw), block_size):
        places.append(len(out))
        out += block(raw[i : i + block_size])
    end = len(out)
    path.write_bytes(out + block(b""))
    virtual = [(places[x // block_size] << 16 | x % block_size) if x < len(raw) else end << 16 for x in at]
    index = b"BAI\1" + struct.pack("<I", len(CHROMS))
    for ref in range(len(CHROMS)):
        bins, line = {}, {}
        for i, (r, pos, _, cigar, _) in enumerate(records):
            if r == ref:
                b = pos + max(1, sum(n for n, op in cigar if op in (0, 2)))
                chunks = bins.setdefault(bin_of(pos, b), [])
                if chunks and chunks[-1][1] == virtual[i]:
                    chunks[-1][1] = virtual[i + 1]
                else:
                    chunks.append([virtual[i], virtual[i + 1]])
                for w in range(pos >> 14, (b - 1 >> 14) + 1):
                    line.setdefault(w, virtual[i])
        if bins:
            bins[37450] = [[0, 0], [1, 1]]
        index += struct.pack("<I", len(bins))
        for number, chunks in bins.items():
            index += struct.pack("<II", number, len(chunks)) + b"".join(struct.pack("<QQ", *c) for c in chunks)
        n = max(line, default=-1) + 1
        index += struct.pack("<I", n) + b"".join(struct.pack("<Q", line.get(w, 0)) for w in range(n))
    (path.parent / (path.name + ".bai")).write_bytes(index)


@pytest.fixture(scope="module")
def bam(tmp_path_factory):
    d = tmp_path_factory.mktemp("bam")
    rng = random.Random(1)
    records = sorted((ref := rng.choice([0, 0, 1]), rng.randrange(CHROMS[ref][1] - 60_000), f"r{i}", [(rng.choice([50, 500, 40_000]), 0), (rng.randint(1, 9), 2), (20, 0)], rng.choice([0, 16, 256])) for i in range(3000))
    records += [(-1, -1, f"u{i}", [], 4) for i in range(20)]
    write_bam(d / "a.bam", records, 1500)
    (d / "bare").mkdir()
    (d / "bare" / "b.bam").write_bytes((d / "a.bam").read_bytes())
    rows = {(n, CHROMS[ref][0] if ref >= 0 else None, pos, pos + sum(x for x, _ in cigar), 10, not flag & 4, bool(flag & 256)) for ref, pos, n, cigar, flag in records}
    return d, rows


def test_whole_file_by_many_tasks(spark, bam):
    d, rows = bam
    for path, parts in ((d / "a.bam", None), (d / "bare" / "b.bam", 1), (d / "bare", 1)):
        df = tables.read_bam(spark, str(path), split=2000)
        got = [tuple(r) for r in df.collect()]
        assert len(got) == len(rows) and set(got) == rows
        n = df.rdd.getNumPartitions()
        assert n == parts if parts else n > 10
    assert {tuple(r) for r in tables.read_bam(spark, f"file://{d}/a.bam").collect()} == rows


REGIONS = ["chr1:0-100", "chr1:500000-520000", "chr2", "chr3", "chr1:16384-16385,chr2:0-400000,chr1:1900000-2000000", "chr9:1-2"]


@pytest.mark.parametrize("text", REGIONS)
def test_bam_regions(spark, bam, text):
    d, rows = bam
    regions = binary.regions_of(text)
    want = {r for r in rows if any(r[1] == n and r[2] < b and r[3] > a for n, a, b in regions)}
    got = [tuple(r) for r in tables.read_bam(spark, f"{d}/a.bam", text, split=2000).collect()]
    assert len(got) == len(want) and set(got) == want
    assert {tuple(r) for r in tables.read_bam(spark, f"{d}/bare/b.bam", text).collect()} == want


def touched(reader_class, path, monkeypatch, **options):
    """Bytes that a reader asks for while it reads its partitions (not its index)."""
    read = []
    reader = reader_class({"path": str(path), **options})
    parts = reader.partitions()
    call = binary.File.__call__
    monkeypatch.setattr(binary.File, "__call__", lambda self, n, at: read.append(n) or call(self, n, at))
    monkeypatch.setattr(binary.Inflated, "WINDOW", 1 << 10)
    n = sum(b.num_rows for p in parts for b in reader.read(p))
    monkeypatch.undo()
    return n, sum(read)


def test_only_ranges_are_read(bam, monkeypatch):
    d, rows = bam
    n, every = touched(binary.BamReader, d / "a.bam", monkeypatch, split=2000)
    assert n == len(rows)
    n, some = touched(binary.BamReader, d / "a.bam", monkeypatch, regions="chr2:300000-310000", split=2000)
    assert 0 < n < 300 and some < every / 2


def test_filters_name_regions(bam):
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, LessThan

    d, rows = bam
    reader = binary.BamReader({"path": f"{d}/a.bam"})
    filters = [EqualTo(("chr",), "chr1"), LessThan(("ref_start",), 520_000), GreaterThan(("ref_end",), 500_000)]
    assert list(reader.narrowed(filters)) == filters
    assert reader.regions == [("chr1", 499_999, 520_001)]
    got = [r for p in reader.partitions() for b in reader.read(p) for r in zip(*(c.to_pylist() for c in b.columns))]
    assert {r for r in got if r[2] < 520_000 and r[3] > 500_000} == {r for r in rows if r[1] == "chr1" and r[2] < 520_000 and r[3] > 500_000}
    reader = binary.BigWigReader({"path": "x"})
    reader.narrowed([In(("chr",), ("chr2", "chr1")), LessThan(("value",), 3)])
    assert reader.regions == [("chr1", 0, binary.FAR), ("chr2", 0, binary.FAR)]


def test_pushdown(spark, bam):
    d, rows = bam
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        got = tables.read_bam(spark, f"{d}/a.bam").where("chr = 'chr2' and ref_start < 10000 and ref_end > 5000").collect()
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    assert {tuple(r) for r in got} == {r for r in rows if r[1] == "chr2" and r[2] < 10_000 and r[3] > 5000}


def write_bigwig(path, runs, order, per_block=8, fan=3):
    """runs: (chromosome, start, end, value) in order. Blocks with both ends, an index of ``fan`` items a node."""
    key = 8
    tree = struct.pack(order + "4IQQ", 0x78CA8C91, 2, key, 8, len(CHROMS), 0) + struct.pack(order + "BBH", 1, 0, len(CHROMS))
    for i, (n, size) in enumerate(CHROMS):
        tree += n.encode().ljust(key, b"\0") + struct.pack(order + "II", i, size)
    at = 64 + len(tree)
    packed, level = b"", []
    for c in range(len(CHROMS)):
        mine = [r for r in runs if r[0] == c]
        for i in range(0, len(mine), per_block):
            part = mine[i : i + per_block]
            z = zlib.compress(struct.pack(order + "5IBBH", c, part[0][1], part[-1][2], 0, 0, 1, 0, len(part)) + b"".join(struct.pack(order + "IIf", *r[1:]) for r in part))
            level.append((c, part[0][1], c, part[-1][2], at + len(packed), len(z)))
            packed += z
    top = at + len(packed)
    head = struct.pack(order + "IHHQQQHHQQIQ", binary.BIGWIG, 4, 0, 64, at, top, 0, 0, 0, 0, 1 << 15, 0)
    index, place = struct.pack(order + "4I", 0x2468ACE0, fan, len(level), 0) + bytes(32), top + 48
    levels = [[level[i : i + fan] for i in range(0, len(level), fan)]]
    while len(levels[-1]) > 1:
        levels.append([levels[-1][i : i + fan] for i in range(0, len(levels[-1]), fan)])
    where, nodes = {}, []  # the root comes first
    for depth in range(len(levels) - 1, -1, -1):
        for k, node in enumerate(levels[depth]):
            where[depth, k] = place
            place += 4 + len(node) * (24 if depth else 32)
            nodes.append((depth, k))

    def span(depth, k):
        node = levels[depth][k]
        if depth:
            ends = [span(depth - 1, k * fan + i) for i in range(len(node))]
            return ends[0][:2] + ends[-1][2:]
        return node[0][:2] + node[-1][2:4]

    for depth, k in nodes:
        node = levels[depth][k]
        index += struct.pack(order + "BBH", not depth, 0, len(node))
        for i, item in enumerate(node):
            index += struct.pack(order + "4IQ", *span(depth - 1, k * fan + i), where[depth - 1, k * fan + i]) if depth else struct.pack(order + "4IQQ", *item)
    path.write_bytes(head + tree + packed + index)


@pytest.mark.parametrize("order", "<>")
def test_bigwig_regions(spark, tmp_path, monkeypatch, order):
    rng = random.Random(2)
    runs = []
    for c, step in ((0, 4000), (1, 3000)):
        at = 0
        for _ in range(300):
            at += rng.randint(0, step)
            runs.append((c, at, at + rng.randint(1, 900), float(rng.randint(0, 50))))
            at = runs[-1][2]
    write_bigwig(tmp_path / "c.bw", runs, order)
    rows = {(CHROMS[c][0], a, b, v) for c, a, b, v in runs}
    df = tables.read_bigwig(spark, f"{tmp_path}/c.bw", split=500)
    assert {tuple(r) for r in df.collect()} == rows and df.count() == len(rows) and df.rdd.getNumPartitions() > 10
    assert {tuple(r) for r in tables.read_bigwig_sizes(spark, f"{tmp_path}/c.bw").collect()} == set(CHROMS)
    for text in REGIONS:
        want = {r for r in rows if any(r[0] == n and r[1] < b and r[2] > a for n, a, b in binary.regions_of(text))}
        assert {tuple(r) for r in tables.read_bigwig(spark, f"{tmp_path}/c.bw", text).collect()} == want
    n, every = touched(binary.BigWigReader, tmp_path / "c.bw", monkeypatch)
    assert n == len(rows)
    n, some = touched(binary.BigWigReader, tmp_path / "c.bw", monkeypatch, regions="chr2:300000-310000")
    assert 0 < n < 30 and some < every / 5


def test_torn_files(spark, tmp_path, bam):
    d, _ = bam
    (tmp_path / "x.bam").write_bytes((d / "a.bam").read_bytes()[:-2000])
    (tmp_path / "y.bw").write_bytes(bytes(100))
    for f in (lambda: tables.read_bam(spark, f"{tmp_path}/x.bam").count(), lambda: tables.read_bigwig(spark, f"{tmp_path}/y.bw").count()):
        with pytest.raises(Exception, match="torn|not a bigWig"):
            f()
