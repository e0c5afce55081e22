"""A filter of 64-bit hashes that travels to the rows: it lets through all hashes that were put in, and few others.

It is a table of words of 64 bits, one for about two hashes and at most 2^``most`` words (2^21, 16 MB), whatever is put in: a hash has one word
and four bits in it. Within that size about one in a thousand other hashes is let through; beyond it more and more, which costs rows
in what follows, never a result. What passes is looked up exactly afterwards, so rows that can't match stay where they are
without a shuffle, at every size alike. Rows meet the table in a broadcast join, hashes inside a task in an array.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PROBES = 4


class Sieve:
    """hashes: a column h, a long; nulls count as nothing."""

    def __init__(self, hashes: DataFrame, most: int = 21):
        n = hashes.count()
        self.bits = min(most, max(6, (n // 2).bit_length()))
        h = F.col("h")
        self.table = hashes.where("h is not null").select(self._word(h).alias("__word"), self._mask(h).alias("__mask")).groupBy("__word").agg(F.bit_or("__mask").alias("__bits"))

    def _word(self, h: Column) -> Column:
        return h.bitwiseAND(F.lit((1 << self.bits) - 1))

    @staticmethod
    def _mask(h: Column) -> Column:
        """Four bits, each named by six higher bits of the hash."""
        mask = F.lit(0).cast("long")
        for k in range(PROBES):
            mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 40 + 6 * k).bitwiseAND(F.lit(63)).cast("int")))
        return mask

    def marked(self, rows: DataFrame, h: Column, name: str = "may") -> DataFrame:
        """``rows`` with a truth value: whether h may be one of those put in."""
        mask = self._mask(h)
        both = rows.join(F.broadcast(self.table), self._word(h) == F.col("__word"), "left")
        return both.withColumn(name, F.coalesce(F.col("__bits").bitwiseAND(mask) == mask, F.lit(False))).drop("__word", "__bits")

    def inside(self) -> Words:
        """The same for hashes that are made inside a task."""
        words = np.zeros(1 << self.bits, np.uint64)
        got = self.table.toArrow()  # at most 2^most pairs of numbers
        words[np.asarray(got["__word"], np.int64)] = np.asarray(got["__bits"], np.int64).view(np.uint64)
        return Words(words)


class Words:
    def __init__(self, words: np.ndarray):
        self.words = words

    def lets(self, h: np.ndarray) -> np.ndarray:
        """A truth value for each of some hashes (longs)."""
        u = h.view(np.uint64)
        mask = np.zeros(len(u), np.uint64)
        for k in range(PROBES):
            mask |= np.uint64(1) << ((u >> np.uint64(40 + 6 * k)) & np.uint64(63))
        return (self.words[(u & np.uint64(len(self.words) - 1)).astype(np.int64)] & mask) == mask
