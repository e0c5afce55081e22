"""BAM and bigWig files as data sources: many tasks read one file, and only the bytes that a region needs are read.

Both formats carry an index of where in the file a stretch of a chromosome is. It is read when the scan is planned; each of its
pieces, or several small ones in a row, is a partition. Regions come as an option, or from the filters that a query puts on the
rows (spark.sql.python.filterPushdown.enabled); filters are applied to the rows by Spark in any case.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from annulus.schema import CHROM, COVERAGE, READ

BIGWIG = 0x888FFC26
FAR = 1 << 40
SPLIT = 32 << 20  # compressed bytes of a partition


class File:
    """Bytes of a file at any place; paths may be local ones or addresses of a file system that Arrow knows."""

    def __init__(self, path: str):
        from pyarrow import fs

        system, place = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
        self.file = system.open_input_file(place)
        self.size = self.file.size()

    def __call__(self, n: int, at: int) -> bytes:
        return self.file.read_at(max(0, min(n, self.size - at)), at) if at < self.size else b""


def files_of(path: str) -> list[str]:
    """The file, or the files of a folder; names that end in .bai are indexes."""
    from pyarrow import fs

    uri = "://" in path or path.startswith("file:")
    system, place = fs.FileSystem.from_uri(path) if uri else (fs.LocalFileSystem(), path)
    if system.get_file_info(place).type != fs.FileType.Directory:
        return [path]
    head = path[: len(path) - len(place)] if uri and path.endswith(place) else "file://" if uri else ""
    return sorted(head + f.path for f in system.get_file_info(fs.FileSelector(place)) if f.type == fs.FileType.File and not f.path.endswith(".bai") and not f.base_name.startswith((".", "_")))


def exists(path: str) -> bool:
    from pyarrow import fs

    system, place = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return system.get_file_info(place).type == fs.FileType.File


Region = tuple[str, int, int]  # chr, start, end


def regions_of(text: str) -> list[Region]:
    """'chr1:100-200,chr2': places from 0 on, ends excluded; a name alone is the whole chromosome."""
    out = []
    for part in filter(None, text.split(",")):
        name, _, span = part.strip().rpartition(":")
        if name and span.replace("-", "", 1).isdigit() and "-" in span:
            a, b = span.split("-")
            out.append((name, int(a), int(b)))
        else:
            out.append((part.strip(), 0, FAR))
    return out


class Ranged(DataSourceReader):
    """What both readers share: files, regions from an option and from filters on ``starts`` and ``ends``."""

    starts, ends = "start", "end"

    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.split = int(options.get("split", SPLIT))
        self.regions = regions_of(options["regions"]) if options.get("regions") else None

    def narrowed(self, filters: list[Filter]) -> list[Filter]:
        """Takes regions from filters; all of them are left to Spark, too."""
        names, lo, hi = None, 0, FAR
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column == "chr" and isinstance(f, EqualTo):
                names = {f.value} if names is None else names & {f.value}
            elif column == "chr" and isinstance(f, In):
                names = set(f.value) if names is None else names & set(f.value)
            elif column == self.starts and isinstance(f, LessThan | LessThanOrEqual):
                hi = min(hi, int(f.value) + 1)
            elif column == self.ends and isinstance(f, GreaterThan | GreaterThanOrEqual):
                lo = max(lo, int(f.value) - 1)
        if names is not None and self.regions is None:
            self.regions = [(str(n), lo, hi) for n in sorted(names)]
        return filters

    def wanted(self, name: str | None) -> list[tuple[int, int]]:
        return [(0, FAR)] if self.regions is None else [(a, b) for n, a, b in self.regions if n == name]


# bigWig -------------------------------------------------------------------------------------------------


class BigWig:
    def __init__(self, file: File):
        self.file = file
        self.order = "<" if struct.unpack("<I", file(4, 0))[0] == BIGWIG else ">"
        if self.at("I", 0)[0] != BIGWIG:
            raise ValueError("not a bigWig file")
        self.tree, _, self.index = self.at("3Q", 8)
        self.packed = self.at("I", 52)[0]

    def at(self, kind: str, place: int) -> tuple:
        kind = self.order + kind
        return struct.unpack(kind, self.file(struct.calcsize(kind), place))

    def chromosomes(self) -> dict[int, tuple[str, int]]:
        """id -> (name, length), from the tree of names."""
        _, _, key, _, _ = self.at("4IQ", self.tree)
        out, todo = {}, [self.tree + 32]
        while todo:
            leaf, _, n = self.at("BBH", p := todo.pop())
            for item in self.items(p, n, key + 8):
                if leaf:
                    number, size = struct.unpack_from(self.order + "II", item, key)
                    out[number] = (item[:key].rstrip(b"\0").decode(), size)
                else:
                    todo.append(struct.unpack_from(self.order + "Q", item, key)[0])
        return out

    def items(self, node: int, n: int, size: int) -> list[bytes]:
        raw = self.file(n * size, node + 4)
        return [raw[i * size : (i + 1) * size] for i in range(n)]

    def leaves(self, spans: list[tuple[tuple[int, int], tuple[int, int]]] | None) -> Iterator[tuple[int, int]]:
        """(place, size) of the data blocks in the order of the index, those that overlap one of ``spans``: pairs of (chromosome, base). Nodes that
        overlap none aren't read."""
        todo = [self.index + 48]
        while todo:
            leaf, _, n = self.at("BBH", p := todo.pop())
            inner = []
            for item in self.items(p, n, 32 if leaf else 24):
                c1, a, c2, b, place = struct.unpack_from(self.order + "4IQ", item)
                if spans is None or any((c1, a) < end and begin < (c2, b) for begin, end in spans):
                    if leaf:
                        yield place, struct.unpack_from(self.order + "Q", item, 24)[0]
                    else:
                        inner.append(place)
            todo += reversed(inner)

    def runs(self, raw: bytes) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
        """(chromosome, starts, ends, values) of a data block."""
        chrom, start, _, step, span, kind, _, n = struct.unpack_from(self.order + "5IBBH", raw)
        o = self.order
        if kind == 1:  # runs with both ends
            x = np.frombuffer(raw, np.dtype([("s", o + "u4"), ("e", o + "u4"), ("v", o + "f4")]), n, 24)
            s, e = x["s"].astype(np.int64), x["e"].astype(np.int64)
        elif kind == 2:  # starts, of one width
            x = np.frombuffer(raw, np.dtype([("s", o + "u4"), ("v", o + "f4")]), n, 24)
            s = x["s"].astype(np.int64)
            e = s + span
        else:  # values at equal steps
            x = np.frombuffer(raw, np.dtype([("v", o + "f4")]), n, 24)
            s = start + np.arange(n, dtype=np.int64) * step
            e = s + span
        return chrom, s, e, x["v"].astype(float)


@dataclass
class Blocks(InputPartition):
    path: str
    places: list[tuple[int, int]]


class BigWigReader(Ranged):
    def partitions(self) -> list[Blocks]:
        out = []
        for path in files_of(self.path):
            wig = BigWig(File(path))
            spans = None if self.regions is None else [((c, a), (c, b)) for c, (name, _) in wig.chromosomes().items() for a, b in self.wanted(name)]
            held, size = [], 0
            for place, n in wig.leaves(spans):
                if held and size + n > self.split:
                    out.append(Blocks(path, held))
                    held, size = [], 0
                held.append((place, n))
                size += n
            if held:
                out.append(Blocks(path, held))
        return out or [Blocks("", [])]

    def read(self, partition: Blocks) -> Iterator[pa.RecordBatch]:
        if not partition.places:
            return
        file = File(partition.path)
        wig = BigWig(file)
        names = wig.chromosomes()
        for place, n in partition.places:
            raw = file(n, place)
            chrom, s, e, v = wig.runs(zlib.decompress(raw) if wig.packed else raw)
            name = names[chrom][0]
            keep = np.zeros(len(s), bool)
            for a, b in self.wanted(name):
                keep |= (s < b) & (e > a)
            yield pa.RecordBatch.from_arrays([pa.array([name] * int(keep.sum()), pa.string()), pa.array(s[keep]), pa.array(e[keep]), pa.array(v[keep])], names=["chr", "start", "end", "value"])


class BigWigFiltered(BigWigReader):
    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        return self.narrowed(filters)


class BigWigSource(DataSource):
    """Options: path (a file or a folder), regions, split (compressed bytes of a partition), push (filters become regions; Spark must allow it)."""

    @classmethod
    def name(cls) -> str:
        return "annulus_bigwig"

    def schema(self) -> str:
        return COVERAGE

    def reader(self, schema: StructType) -> DataSourceReader:
        return (BigWigFiltered if self.options.get("push") == "true" else BigWigReader)(dict(self.options))


class SizesReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Blocks]:
        return [Blocks(p, []) for p in files_of(self.path)]

    def read(self, partition: Blocks) -> Iterator[tuple[str, int]]:
        yield from BigWig(File(partition.path)).chromosomes().values()


class SizesSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "annulus_bigwig_sizes"

    def schema(self) -> str:
        return CHROM

    def reader(self, schema: StructType) -> DataSourceReader:
        return SizesReader(self.options["path"])


# BAM ----------------------------------------------------------------------------------------------------


class Inflated:
    """A blocked gzip file from a virtual place on: (place of a block << 16) + place inside the block."""

    WINDOW = 4 << 20

    def __init__(self, file: File, place: int = 0):
        self.file, self.next = file, place >> 16
        self.window, self.base = b"", self.next
        self.block, self.at, self.begin = b"", 0, self.next
        if place & 0xFFFF:
            self.advance()
            self.at = place & 0xFFFF

    def advance(self) -> bool:
        """To the next block that holds something; false at the end."""
        while True:
            at = self.next - self.base
            if len(self.window) - at < 1 << 17 and self.base + len(self.window) < self.file.size:
                self.window, self.base, at = self.file(self.WINDOW, self.next), self.next, 0
            if at >= len(self.window):
                return False
            unzip = zlib.decompressobj(31)
            view = memoryview(self.window)[at : at + (1 << 17)]
            data = unzip.decompress(view)
            if not unzip.eof:
                raise ValueError("a block is torn")
            self.begin, self.next = self.next, self.next + len(view) - len(unzip.unused_data)
            if data:
                self.block, self.at = data, 0
                return True

    def place(self) -> int | None:
        """Where the next byte is; None at the end."""
        if self.at >= len(self.block) and not self.advance():
            return None
        return self.begin << 16 | self.at

    def take(self, n: int) -> bytes:
        part = self.block[self.at : self.at + n]
        self.at += len(part)
        if len(part) == n:
            return part
        parts, left = [part], n - len(part)
        while left:
            if not self.advance():
                raise ValueError("the file is torn")
            parts.append(self.block[:left])
            self.at = len(parts[-1])
            left -= self.at
        return b"".join(parts)


def bam_header(file: File) -> tuple[list[str], int | None]:
    """Names of the sequences, and where the first record is."""
    x = Inflated(file)
    magic, text = struct.unpack("<4sI", x.take(8))
    if magic != b"BAM\1":
        raise ValueError("not a BAM file")
    x.take(text)
    names = []
    for _ in range(struct.unpack("<I", x.take(4))[0]):
        (n,) = struct.unpack("<I", x.take(4))
        names.append(x.take(n + 4)[:n].rstrip(b"\0").decode())
    return names, x.place()


class Index:
    """A BAI file: for each sequence its bins' chunks and the first record of each 16384 bases, all as virtual places."""

    META = 37450  # fixed value: a bin that holds counts

    def __init__(self, data: bytes):
        if data[:4] != b"BAI\1":
            raise ValueError("not a BAI file")
        (n,) = struct.unpack_from("<I", data, 4)
        at = 8
        self.bins: list[dict[int, np.ndarray]] = []
        self.linear: list[np.ndarray] = []
        for _ in range(n):
            (n_bins,) = struct.unpack_from("<I", data, at)
            at += 4
            bins = {}
            for _ in range(n_bins):
                number, chunks = struct.unpack_from("<II", data, at)
                bins[number] = np.frombuffer(data, "<u8", 2 * chunks, at + 8).reshape(-1, 2)
                at += 8 + 16 * chunks
            bins.pop(self.META, None)
            (intervals,) = struct.unpack_from("<I", data, at)
            self.linear.append(np.frombuffer(data, "<u8", intervals, at + 4))
            at += 4 + 8 * intervals
            self.bins.append(bins)

    def starts(self) -> list[int]:
        """Places at which a record is known to begin."""
        return sorted({int(x) for bins in self.bins for chunks in bins.values() for x in chunks[:, 0]} | {int(x) for line in self.linear for x in line if x})

    def chunks(self, ref: int, a: int, b: int) -> list[tuple[int, int]]:
        """Ranges that may hold records of bases a to b: those of all bins that overlap them and that end behind the window's first record."""
        line = self.linear[ref]
        first = int(line[min(a >> 14, len(line) - 1)]) if len(line) else 0
        b = min(b, 1 << 29)
        out = []
        for number, chunks in self.bins[ref].items():
            # bins of six levels; the first of a level with 8^k bins is (8^k - 1) / 7, and each spans 2^(29 - 3k) bases
            level = next(k for k in range(5, -1, -1) if number >= ((1 << 3 * k) - 1) // 7)
            shift = 29 - 3 * level
            at = number - ((1 << 3 * level) - 1) // 7
            if at << shift < b and (at + 1) << shift > a:
                out += [(int(x), int(y)) for x, y in chunks if y > first]
        return out


@dataclass
class Records(InputPartition):
    path: str
    names: list[str]
    places: list[tuple[int, int | None]]  # None: to the end of the file


def cut(ranges: list[tuple[int, int | None]], starts: list[int], split: int) -> list[list[tuple[int, int | None]]]:
    """Ranges of virtual places, joined where little lies between them, and cut where records begin, in groups of ``split`` compressed bytes."""
    near = min(1 << 14, split // 4)
    joined: list[list] = []
    for a, b in sorted(ranges, key=lambda r: r[0]):
        if joined and (joined[-1][1] is None or a >> 16 <= (joined[-1][1] >> 16) + near):
            joined[-1][1] = None if b is None or joined[-1][1] is None else max(b, joined[-1][1])
        else:
            joined.append([a, b])
    out, known = [], np.array(starts, np.int64)
    for a, b in joined:
        inside = known[np.searchsorted(known, a, side="right") :]
        for s in (inside if b is None else inside[: np.searchsorted(inside, b)]).tolist():
            if (s >> 16) - (a >> 16) >= split:
                out.append((a, s))
                a = s
        out.append((a, b))
    groups: list[list[tuple[int, int | None]]] = []
    held = split
    for a, b in out:
        if held >= split:
            groups.append([])
            held = 0
        groups[-1].append((a, b))
        held += split if b is None else (b >> 16) - (a >> 16)
    return groups


class BamReader(Ranged):
    starts, ends = "ref_start", "ref_end"

    def partitions(self) -> list[Records]:
        out = []
        for path in files_of(self.path):
            names, first = bam_header(File(path))
            if first is None:
                continue
            near = next((p for p in (path + ".bai", path.removesuffix(".bam") + ".bai") if exists(p)), None)
            if near is None:  # where records begin is not known
                out.append(Records(path, names, [(first, None)]))
                continue
            file = File(near)
            index = Index(file(file.size, 0))
            ranges: list[tuple[int, int | None]] = [(first, None)]
            if self.regions is not None:
                ranges = [r for ref, name in enumerate(names) for a, b in self.wanted(name) for r in index.chunks(ref, a, b)]
            out += [Records(path, names, group) for group in cut(ranges, index.starts(), self.split)]
        return out or [Records("", [], [])]

    def read(self, partition: Records) -> Iterator[pa.RecordBatch]:
        names, rows = partition.names, []
        wanted = [self.wanted(n) for n in names]
        kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_()]
        columns = ["name", "chr", "ref_start", "ref_end", "query_length", "is_mapped", "is_secondary"]
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=columns)
        for record in self.records(partition):
            ref, pos, l_name, _, _, n_ops, flag, l_seq = struct.unpack_from("<iiBBHHHi", record)
            ops = struct.unpack_from(f"<{n_ops}I", record, 32 + l_name)
            end = pos + sum(o >> 4 for o in ops if o & 15 in (0, 2, 3, 7, 8))  # what the alignment takes of the reference
            if self.regions is not None and not (ref >= 0 and any(pos < b and max(end, pos + 1) > a for a, b in wanted[ref])):
                continue
            rows.append((record[32 : 31 + l_name].decode(), names[ref] if ref >= 0 else None, pos, end, l_seq, not flag & 4, bool(flag & 256)))
            if len(rows) >= 20_000:
                yield batch()
                rows = []
        if rows:
            yield batch()


    def records(self, partition: Records) -> Iterator[bytes]:
        for begin, end in partition.places:
            x = Inflated(File(partition.path), begin)
            while (at := x.place()) is not None and (end is None or at < end):
                yield x.take(struct.unpack("<I", x.take(4))[0])


class BamFiltered(BamReader):
    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        return self.narrowed(filters)


class BamSource(DataSource):
    """Options as of BigWigSource. A file without a .bai index beside it is one partition."""

    @classmethod
    def name(cls) -> str:
        return "annulus_bam"

    def schema(self) -> str:
        return READ

    def reader(self, schema: StructType) -> DataSourceReader:
        return (BamFiltered if self.options.get("push") == "true" else BamReader)(dict(self.options))
