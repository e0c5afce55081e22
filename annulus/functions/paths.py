"""Column functions over circular paths: array<long> of signed fragment ids (negative: inverted)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rotate_to_minimal(path: Column) -> Column:
    """The first occurrence of the smallest fragment leads."""
    size = F.transform(path, lambda x: F.abs(x))
    at = F.array_position(size, F.array_min(size)).cast("int")
    turned = F.concat(F.slice(path, at, F.size(path) - at + 1), F.slice(path, F.lit(1), at - 1))
    return F.when(F.size(path) <= 1, path).otherwise(turned)


def flip_strand(path: Column) -> Column:
    """Reversed and negated if more fragments are inverted than not."""
    inverted = F.size(F.filter(path, lambda x: x < 0))
    return F.when(2 * inverted > F.size(path), F.reverse(F.transform(path, lambda x: -x))).otherwise(path)


def canonical(path: Column) -> Column:
    return rotate_to_minimal(flip_strand(path))


def opposite(path: Column) -> Column:
    """The same circle read from the other strand."""
    return F.reverse(F.transform(path, lambda x: -x))


def simplify_consecutive(path: Column) -> Column:
    """Without repeats of the element before."""
    return F.filter(path, lambda x, i: (i == 0) | (x != F.get(path, i - 1)))


def meta_hash(path: Column) -> Column:
    """Equal for all rotations of both strands: the exclusive or of the hashes of the different ones among them."""
    n = F.size(path)
    turns = lambda p: F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.xxhash64(F.concat(F.slice(p, i + 1, n - i), F.slice(p, F.lit(1), i))))
    both = F.array_distinct(F.concat(turns(path), turns(opposite(path))))
    return F.aggregate(both, F.lit(0).cast("bigint"), lambda a, x: a.bitwiseXOR(x))


def follows(a: Column, b: Column, gap: int = 10) -> Column:
    """Neighbours on the genome: fragments (chr, start, end, strand, ...) of one strand that meet within ``gap``."""
    meet = F.when(a["strand"] == "+", F.abs(a["end"] - b["start"]) < gap).otherwise(F.abs(a["start"] - b["end"]) < gap)
    return (a["chr"] == b["chr"]) & (a["strand"] == b["strand"]) & meet


def merged(a: Column, b: Column) -> Column:
    """Two neighbours as one fragment; the coverage is the mean of the two."""
    plus = a["strand"] == "+"
    return F.struct(
        a["chr"].alias("chr"), F.when(plus, a["start"]).otherwise(b["start"]).alias("start"), F.when(plus, b["end"]).otherwise(a["end"]).alias("end"), a["strand"].alias("strand"),
        F.concat(a["frag"], F.lit("."), b["frag"]).alias("frag"), ((a["cov"] + b["cov"]) / 2).alias("cov"),
    )


PIECE = "struct<chr:string,start:bigint,end:bigint,strand:string,frag:string,cov:double>"


def collapse(conf: Column, gap: int = 10) -> Column:
    """Neighbouring fragments of a circle merged from left to right; then the last with the first, if they meet.

    conf: array of PIECE. One fragment stays as it is.
    """
    empty = F.array().cast(f"array<{PIECE}>")

    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        joined = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(merged(last, x)))
        return F.when(F.size(acc) == 0, F.array(x)).when(follows(last, x, gap), joined).otherwise(F.concat(acc, F.array(x)))

    folded = F.aggregate(conf, empty, step)
    return F.transform(F.array(folded), lambda f: _closed(f, conf, gap))[0]


def _closed(folded: Column, conf: Column, gap: int) -> Column:
    """The circle's seam: the last piece meets the original first fragment."""
    first, last = F.get(conf, F.lit(0)), F.element_at(folded, -1)
    n = F.size(folded)
    seam = F.concat(F.slice(folded, F.lit(2), F.greatest(n - 2, F.lit(0))), F.array(merged(last, first)))
    return F.when((F.size(conf) > 1) & follows(last, first, gap), seam).otherwise(folded)


FLAGS = ("small_del", "dup", "inv", "interchr", "multi", "foldback")


def _pair_flags(p: Column, c: Column) -> Column:
    """What a piece is to the one before it, a bit for each of FLAGS; a flag that isn't known isn't set."""
    lo = lambda x: F.least(x["start"], x["end"])
    hi = lambda x: F.greatest(x["start"], x["end"])
    ps, pe, cs, ce = lo(p), hi(p), lo(c), hi(c)
    most = F.least(F.lit(5000), F.floor(0.1 * (pe - ps) + 0.1 * (ce - cs)))
    dup = (F.abs(cs - ps) <= 50) & (F.abs(ce - pe) <= 50)
    small = ((cs - pe > 10) & (cs - pe < most)) | ((ps - ce > 10) & (ps - ce < most))
    far = (cs - pe >= most) | (ps - ce >= most)
    inside = lambda y: (ps < y) & (y < pe)
    fold = inside(c["start"]) | (inside(c["end"]) & ~(F.abs(cs - ps) <= 50))
    bit = lambda name, holds: F.when(holds, 1 << FLAGS.index(name)).otherwise(0)
    near = F.when(dup, 1 << FLAGS.index("dup")).otherwise(bit("small_del", ~dup & small) + bit("multi", ~dup & ~small & far))
    same = near + bit("inv", p["strand"] != c["strand"]) + bit("foldback", fold)
    return F.when(p["chr"] == c["chr"], same).when(p["chr"] != c["chr"], 1 << FLAGS.index("interchr")).otherwise(0)


def topology_flags(conf: Column) -> Column:
    """struct(n, small_del, dup, inv, interchr, multi, foldback) from neighbouring pieces, without the pair at the seam.

    Each pair is looked at once and leaves one number, which is bound before the flags are taken of it: an array
    function named in several fields would run for each of them.
    """
    pairs = F.greatest(F.size(conf) - 1, F.lit(0))
    found = F.zip_with(F.slice(conf, F.lit(1), pairs), F.slice(conf, F.lit(2), pairs), _pair_flags)
    repeated = F.when(F.size(F.array_distinct(F.transform(conf, lambda x: x["frag"]))) < F.size(conf), 1 << FLAGS.index("dup")).otherwise(0)
    held = F.struct(F.size(conf).alias("n"), F.coalesce(F.aggregate(found, repeated, lambda a, x: a.bitwiseOR(x)), F.lit(0)).alias("bits"))
    flag = lambda h, name: (h["bits"].bitwiseAND(F.lit(1 << FLAGS.index(name))) != 0).alias(name)
    return F.transform(F.array(held), lambda h: F.struct(h["n"].alias("n"), *[flag(h, name) for name in FLAGS]))[0]


def size_mb(conf: Column) -> Column:
    return F.aggregate(conf, F.lit(0.0), lambda a, x: a + F.abs(x["start"] - x["end"])) / 1e6


def chromosomes(conf: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.transform(conf, lambda x: x["chr"]))), ",")
