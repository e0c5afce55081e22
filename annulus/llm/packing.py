"""Best-fit packing of token pieces into sequences of a fixed size, by exact complements.

Only lengths matter for the plan, and there are at most ``size`` of them: the corpus is reduced to a
histogram, planned on the driver, and the plan is applied to the pieces where they are.

The plan takes lengths from the largest down. For the gap that a length leaves, it looks up one
length, then a pair, then a triple whose sum is exactly the gap (largest first), and consumes as many
of these combinations as the counts allow. What finds no exact complement is packed best-fit in
decreasing order, again by counts. Each step uses up a length or a group of equal bins, so the plan's
size doesn't depend on the number of documents.

A piece's place in the plan is its rank among the pieces of its length. Ranks are counted inside each
task and shifted by the totals of the tasks before it, so no length is sorted or gathered in one place.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from annulus.llm.common import durable

# the characters for which both tokenizer libraries split alike; others, and special strings, go to the reference library
NOT_PLAIN = regex.compile("[^\t\n\r -~¡-ɏ]")


class Encoder:
    """Ids of whole texts as the tokenizers library gives them for a byte-level BPE file, without added special tokens.

    Plain texts take a faster route: the same vocabulary and pattern in the tiktoken library.
    """

    # fixed value: the published pre-token pattern of byte-level BPE
    PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        self.slow.no_truncation()
        self.slow.no_padding()
        self.special = [t.content for t in self.slow.get_added_tokens_decoder().values()]
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in own]
        letters = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}
        ranks = {bytes(letters[c] for c in t): i for t, i in self.slow.get_vocab(with_added_tokens=False).items() if t not in self.special}
        self.fast = tiktoken.Encoding("same", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> list[int]:
        if NOT_PLAIN.search(text) or any(s in text for s in self.special):
            return self.slow.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


def cuts(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: one if it fits, else whole sequences after a first piece of the rest."""
    if n <= size:
        return [(0, n)]
    first = n % size or size
    return [(0, first), *((i, size) for i in range(first, n, size))]


def complement(gap: int, free: np.ndarray, most: int) -> tuple[int, ...] | None:
    """One, two or three lengths of at most ``most`` that are free and sum to ``gap``; the largest first."""
    if gap <= most and free[gap]:
        return (gap,)
    for a in (0, *range(min(most, gap - 2), 0, -1)):  # 0: a pair
        if a and (not free[a] or 3 * a < gap):
            continue
        rest = gap - a
        high = np.arange(min(a or most, rest - 1), (rest - 1) // 2, -1)
        if not len(high):
            continue
        low = rest - high
        good = (free[high] > 0) & (free[low] > 0)
        good &= (high != low) | (free[high] > 1)
        if a:
            good &= (free[high] > (high == a).astype(int) + (high == low)) & (free[low] > (low == a).astype(int))
        at = np.flatnonzero(good)
        if len(at):
            pair = (int(high[at[0]]), int(low[at[0]]))
            return (a, *pair) if a else pair
    return None


def plan(counts: dict[int, int], size: int) -> list[tuple[int, tuple[int, ...]]]:
    """(how many sequences, lengths in each) so that every piece of every length is used once."""
    free = np.zeros(size + 1, np.int64)
    for length, n in counts.items():
        free[length] = n
    out: list[tuple[int, tuple[int, ...]]] = []
    left: dict[int, int] = {}
    for length in range(size, 0, -1):
        while free[length]:
            if length == size:
                combo: tuple[int, ...] | None = ()
            else:
                free[length] -= 1
                combo = complement(size - length, free, length)
                free[length] += 1
            if combo is None:
                left[length] = int(free[length])
                free[length] = 0
                break
            need = Counter((length, *combo))
            n = int(min(free[x] // k for x, k in need.items()))
            for x, k in need.items():
                free[x] -= n * k
            out.append((n, (length, *combo)))
    return out + best_fit(left, size)


def best_fit(counts: dict[int, int], size: int) -> list[tuple[int, tuple[int, ...]]]:
    """Best-fit decreasing, by counts: each length goes to the bins with the smallest gap that holds it."""
    bins: dict[int, dict[tuple[int, ...], int]] = {}  # gap -> lengths -> bins
    for length in sorted(counts, reverse=True):
        n = counts[length]
        for gap in sorted(g for g in bins if g >= length):
            for combo in list(bins[gap]):
                if not n:
                    break
                each = gap // length  # after the first, the same bin fits best
                have = bins[gap].pop(combo)
                used = min(have, n // each)
                if used:
                    _put(bins, gap - each * length, combo + (length,) * each, used)
                n -= used * each
                have -= used
                if n and have:
                    _put(bins, gap - n * length, combo + (length,) * n, 1)
                    n, have = 0, have - 1
                if have:
                    _put(bins, gap, combo, have)
        each = size // length
        if n // each:
            _put(bins, size - each * length, (length,) * each, n // each)
        if n % each:
            _put(bins, size - (n % each) * length, (length,) * (n % each), 1)
    return [(n, combo) for held in bins.values() for combo, n in held.items()]


def _put(bins: dict, gap: int, combo: tuple[int, ...], n: int) -> None:
    held = bins.setdefault(gap, {})
    held[combo] = held.get(combo, 0) + n


def places(patterns: list[tuple[int, tuple[int, ...]]]) -> pd.DataFrame:
    """For each slot of each pattern: length, ranks lo to hi - 1, the sequence of rank lo, and the offset."""
    rows, taken, base = [], Counter(), 0
    for n, combo in patterns:
        offset = 0
        for length in combo:
            rows.append((length, taken[length], taken[length] + n, base, offset))
            taken[length] += n
            offset += length
        base += n
    return pd.DataFrame(rows, columns=["length", "lo", "hi", "base", "offset"]).astype("int64")


def pieces(docs: DataFrame, path: str, size: int, end: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, part, rank: the last two number the pieces of a length inside a task."""

    def cut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        encoder, seen, part = Encoder(path), Counter(), TaskContext.get().partitionId()
        for pdf in parts:
            doc, rows = [], []
            for i, text in zip(pdf["doc_id"], pdf["text"]):
                ids = encoder.ids(text)
                ids.append(end)
                raw = memoryview(array("I", ids).tobytes())  # four bytes each, little-endian on all platforms Spark runs on
                for k, (a, n) in enumerate(cuts(len(ids), size)):
                    doc.append(i)
                    rows.append((k, a, n, zlib.crc32(raw[4 * a : 4 * (a + n)]), part, seen[n]))
                    seen[n] += 1
            out = pd.DataFrame(rows, columns=["piece", "start", "length", "ids_crc32", "part", "rank"])
            out.insert(0, "doc_id", pd.Series(doc, dtype="Int64" if whole else object))
            yield out

    kind = docs.schema["doc_id"].dataType
    whole = isinstance(kind, T.IntegralType)
    texts = docs.select(F.col("doc_id").cast("long" if whole else kind).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInPandas(cut, f"doc_id {'long' if whole else kind.simpleString()}, piece int, start long, length long, ids_crc32 long, part long, rank long")


def pack(docs: DataFrame, path: str, *, size: int = 1024, end: int = 2) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row for each piece of each row of ``docs``.

    A document is its ids and then ``end``; null or empty text is ``end`` alone. Ids may be numbers or texts, null or
    repeated: each row is packed. An empty table gives no piece. Extra columns are ignored. The pieces
    are written once before they are counted, so ranks stay what they were if an executor is lost.
    """
    spark: SparkSession = docs.sparkSession
    cut = durable(pieces(docs, path, size, end))
    by_part = cut.groupBy("part", "length").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `size` rows
    slots = places(plan(counts, size))
    table = spark.createDataFrame(slots, "length long, lo long, hi long, base long, offset long")
    before = by_part.select(F.col("part").alias("p"), F.col("length").alias("l"), F.expr("sum(n) over (partition by length order by part rows between unbounded preceding and current row) - n").alias("before"))
    ranked = cut.join(before, (F.col("part") == F.col("p")) & (F.col("length") == F.col("l"))).withColumn("r", F.col("rank") + F.col("before")).drop("p", "l")
    t = F.broadcast(table.withColumnRenamed("length", "l"))  # bounded by the plan: a few slots for each length
    placed = ranked.join(t, (F.col("length") == F.col("l")) & (F.col("r") >= F.col("lo")) & (F.col("r") < F.col("hi")))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("r") - F.col("lo")).alias("sequence_id"), "offset")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, used, spans: what each sequence holds, by offset. A sequence has at most ``size`` pieces."""
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("used"), F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "start", "length"))).alias("spans"))
