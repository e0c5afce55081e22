"""Sequences in blocks: no row holds more than a block of a chromosome or of a circle, however long these are.

A block is (key, block, seq): bases ``block * size`` to ``(block + 1) * size`` of what ``key`` names; the last one may be shorter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annulus.functions.genomics import reverse_complement

BLOCK = 61_440  # bases; a multiple of the width of a FASTA line, so that no line crosses blocks


def _number(at: Column, size: int) -> Column:
    return F.floor(at / F.lit(size)).cast("bigint")


def to_blocks(pieces: DataFrame, key: str, size: int = BLOCK) -> DataFrame:
    """(key, block, seq) of pieces (key, at, s) that lie side by side: a piece begins at base ``at``, from 0 on.

    Pieces are cut where blocks meet and put together by block, so a task holds as many bases as a block has. Empty
    and null pieces leave nothing.
    """
    x = pieces.where(F.length("s") > 0).select(key, F.col("at").cast("bigint").alias("at"), "s", (F.col("at") + F.length("s")).cast("bigint").alias("__end"))
    cut = x.withColumn("block", F.explode(F.sequence(_number(F.col("at"), size), _number(F.col("__end") - 1, size))))
    lo, hi = F.greatest("at", F.col("block") * size), F.least("__end", (F.col("block") + 1) * size)
    part = cut.select(key, "block", lo.alias("lo"), F.col("s").substr((lo - F.col("at") + 1).cast("int"), (hi - lo).cast("int")).alias("s"))
    return part.groupBy(key, "block").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("lo", "s"))), lambda p: p["s"]), "").alias("seq"))


def of_whole(sequences: DataFrame, key: str, size: int = BLOCK) -> DataFrame:
    """Blocks of sequences (key, seq) that come as one row each."""
    return to_blocks(sequences.select(key, F.lit(0).alias("at"), F.col("seq").alias("s")), key, size)


def whole(blocks: DataFrame, key: str) -> DataFrame:
    """(key, seq): blocks put together again, for sequences that are known to be short."""
    return blocks.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "seq"))), lambda b: b["seq"]), "").alias("seq"))


def lengths(blocks: DataFrame, key: str, size: int = BLOCK) -> DataFrame:
    """(key, length): where the last block ends."""
    return blocks.groupBy(key).agg(F.max(F.col("block") * size + F.length("seq")).cast("bigint").alias("length"))


def fasta_blocks(lines: DataFrame, size: int = BLOCK) -> DataFrame:
    """(chr, block, seq) of FASTA lines (value, file, split, n): n orders the lines of a split, split those of a file.

    Bases are counted inside each split; the record that a split begins in, and how many of its bases came before, are told by a table
    of one row for each split. A name ends at white space. Lines before a file's first header belong to nothing.
    """
    head = F.col("value").startswith(">")
    text = F.when(head, "").otherwise(F.regexp_replace("value", r"\s", ""))
    x = lines.withColumns({"head": head, "name": F.when(head, F.regexp_extract("value", r"^>\s*(\S*)", 1)), "s": text})
    order = Window.partitionBy("file", "split").orderBy("n")
    x = x.withColumn("run", F.sum(F.length("s")).over(order))
    x = x.withColumns({"record": F.last("name", ignorenulls=True).over(order), "since": F.last(F.when(F.col("head"), F.col("run")), ignorenulls=True).over(order)})
    ends = x.groupBy("file", "split").agg(F.max_by(F.struct("record", "since", "run"), "n").alias("z")).select("file", "split", "z.*")
    prior = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("before", F.coalesce(F.sum("run").over(prior), F.lit(0)))
    carried = ends.select("file", "split", "before", F.last("record", ignorenulls=True).over(prior).alias("from"), F.last(F.when(F.col("since").isNotNull(), F.col("before") + F.col("since")), ignorenulls=True).over(prior).alias("began"))
    y = x.where(~F.col("head")).join(carried, ["file", "split"])
    own = F.col("since").isNotNull()
    at = F.col("run") - F.length("s") - F.when(own, F.col("since")).otherwise(F.col("began") - F.col("before"))
    return to_blocks(y.select(F.when(own, F.col("record")).otherwise(F.col("from")).alias("chr"), at.alias("at"), "s").where("chr <> ''"), "chr", size)


def circle_blocks(rows: DataFrame, genome: DataFrame, size: int = BLOCK) -> DataFrame:
    """(circ_id, block, seq): the circles' sequences. rows: circ_id, row, chr, start, end, strand; genome: blocks (chr, block, seq) of ``size``.

    Rows are cut at the end of their chromosome; one on a chromosome that the genome lacks has no bases. Each row meets
    the genome's blocks that it overlaps by their number, and leaves its part of each at its place in the circle.
    """
    known = rows.select("circ_id", "row", "chr", "start", "end", "strand").join(lengths(genome, "chr", size), "chr")
    clipped = known.withColumns({"start": F.least("start", "length"), "end": F.least("end", "length")}).where(F.col("end") > F.col("start"))
    order = Window.partitionBy("circ_id").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    placed = clipped.withColumn("offset", F.coalesce(F.sum(F.col("end") - F.col("start")).over(order), F.lit(0)))
    spread = placed.withColumn("block", F.explode(F.sequence(_number(F.col("start"), size), _number(F.col("end") - 1, size))))
    lo, hi = F.greatest("start", F.col("block") * size), F.least("end", (F.col("block") + 1) * size)
    part = F.col("seq").substr((lo - F.col("block") * size + 1).cast("int"), (hi - lo).cast("int"))
    minus = F.col("strand") == "-"
    at = F.col("offset") + F.when(minus, F.col("end") - hi).otherwise(lo - F.col("start"))
    pieces = spread.join(genome, ["chr", "block"]).select("circ_id", at.alias("at"), F.when(minus, reverse_complement(part)).otherwise(part).alias("s"))
    return to_blocks(pieces, "circ_id", size)


def fasta_lines(blocks: DataFrame, key: str = "circ_id", width: int = 60) -> DataFrame:
    """(value): text of FASTA records in order, a header before each first block; the blocks' size is a multiple of ``width``."""
    body = F.regexp_replace("seq", f"(.{{{width}}})(?=.)", "$1\n")
    header = F.concat(F.lit(">"), F.col(key).cast("string"), F.lit("\n"))
    return blocks.orderBy(key, "block").select(F.when(F.col("block") == 0, F.concat(header, body)).otherwise(body).alias("value"))
