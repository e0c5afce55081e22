"""Benchmark decontamination: short test items inside long documents, by size-partitioned MinHash containment.

Items and documents are compared by five-word shingles. What is searched is containment, the share of
an item's distinct shingles that a document holds, not resemblance, which long documents dilute.
Items are partitioned by their number of shingles; all items of a partition are sketched with the
same number of smallest hashes, enough for the partition's largest item: if a document holds the share
``threshold`` of an item, at most (1 - threshold) of its shingles are missing, so of one more than
that many smallest hashes the document must hold one. Candidate search therefore loses nothing.
Candidates are verified by exact containment over the item's shingles.

Items become tables of hashes: of their sketches, and of all their shingles. Documents are read once; of their shingles only those
leave a task that a filter of bounded size says may be an item's. These meet the sketches, which gives candidates, and then
all shingles of the candidate items, which are counted. The plan is the same for a benchmark of any size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annulus.llm.common import durable
from annulus.llm.sieve import Sieve

WIDTH = 5
WORD = re.compile(r"\w+")


def shingles(text: str) -> list[tuple[str, ...]]:
    """Tuples of five words (letters, digits, underscore; lower case); a shorter text that has words is one shingle."""
    w = WORD.findall(text.lower())
    if len(w) < WIDTH:
        return [tuple(w)] if w else []
    return list(zip(w, w[1:], w[2:], w[3:], w[4:]))


def sketch_size(largest: int, threshold: float) -> int:
    """Smallest hashes that an item of a partition needs: one more than the shingles that may be missing."""
    return int((1 - threshold) * largest + 1e-9) + 1


def hashes(text: str, widths: tuple[int, ...] = ()) -> np.ndarray:
    """Hashes (longs) of a text's shingles as they come, repeats included; widths: runs of fewer words that count, too.

    A run's hash is mixed from those of its words and from its width.
    """
    import xxhash

    words = WORD.findall(text.lower())
    h = xxhash.xxh64_intdigest
    x = np.fromiter((h(w) for w in words), np.uint64, len(words))
    out = []
    for n in {WIDTH, *widths}:
        if len(x) >= n > 0:
            s = np.full(len(x) - n + 1, n, np.uint64)
            for k in range(n):
                s = (s ^ x[k : k + len(s)]) * np.uint64(0x9E3779B97F4A7C15)
                s ^= s >> np.uint64(29)
            out.append(s)
    return np.concatenate(out).view(np.int64) if out else np.zeros(0, np.int64)


def items_of(benchmark: DataFrame) -> DataFrame:
    """item (hash of id and text), item_id, text of each different item; a repeated one counts once, null ids are left out."""
    t = benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text")).where(F.col("item_id").isNotNull()).distinct()
    return t.select(F.xxhash64(F.col("item_id").cast("string"), "text").alias("item"), "item_id", "text")


def item_shingles(items: DataFrame, threshold: float) -> DataFrame:
    """item, size, width, h, probe: each distinct shingle of each item, and whether the item's sketch has it."""

    def made(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for item, t in zip(pdf["item"], pdf["text"]):
                n = min(WIDTH, len(WORD.findall(t.lower())))  # a shorter item is one shingle of its own width
                s = np.unique(hashes(t, (n,) if n else ()).view(np.uint64))
                keep = sketch_size((1 << len(s).bit_length()) - 1, threshold) if len(s) else 0
                rows += [(item, len(s), n, h, k < keep) for k, h in enumerate(s.view(np.int64).tolist())]
            yield pd.DataFrame(rows, columns=["item", "size", "width", "h", "probe"]).astype({"item": "int64", "size": "int64", "width": "int32", "h": "int64", "probe": bool})

    return items.select("item", "text").mapInPandas(made, "item long, size long, width int, h long, probe boolean")


def search(docs: DataFrame, benchmark: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """((doc_id, th) of each row that may hold an item, (th, item_id, n_shared, n_item) of those that do). th: the hash of a text."""
    items = durable(items_of(benchmark))
    held = durable(item_shingles(items, threshold))
    widths = tuple(sorted(r["width"] for r in held.select("width").distinct().collect()))  # at most five numbers
    sieve = Sieve(held.select("h").distinct()).inside()

    @F.pandas_udf("array<long>")
    def found(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            out = []
            for t in texts:
                x = hashes(t, widths)
                out.append(np.unique(x[sieve.lets(x)]))
            yield pd.Series(out, dtype=object)

    text = F.coalesce("text", F.lit(""))
    rows = durable(docs.select("doc_id", F.xxhash64(text).alias("th"), found.asNondeterministic()(text).alias("hs")).where(F.size("hs") > 0))
    hits = durable(rows.select("th", F.explode("hs").alias("h")).distinct())
    pairs = hits.join(held.where("probe").select("h", "item"), "h").select("th", "item").distinct()
    asked = pairs.join(held.select("item", "size", "h"), "item")
    counted = asked.join(hits, ["th", "h"]).groupBy("th", "item", "size").agg(F.count("*").alias("shared"))
    good = counted.where(F.col("shared") >= threshold * F.col("size") - 1e-9).join(items.select("item", "item_id"), "item")
    return rows.select("doc_id", "th"), good.select("th", "item_id", F.col("shared").alias("n_shared"), F.col("size").alias("n_item"))


def contaminated(docs: DataFrame, benchmark: DataFrame, *, threshold: float = 0.8) -> DataFrame:
    """doc_id, item_id, n_shared, n_item, containment: one row for each row of ``docs`` and item it holds.

    Only pairs with containment >= threshold. Null or empty texts and items without words hold and
    match nothing; items with null ids are left out; repeated rows are reported each; an id with
    several texts is one set for each text. Ids of both sides may be of any type. Extra columns are ignored, whatever their names.
    """
    rows, good = search(docs, benchmark, threshold)
    return rows.join(good, "th").select("doc_id", "item_id", "n_shared", "n_item", (F.col("n_shared") / F.col("n_item")).alias("containment"))


def clean(docs: DataFrame, benchmark: DataFrame, *, threshold: float = 0.8) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with their columns as they were, whatever their names.

    Rows that a filter of the bad texts' hashes lets through are looked up; all others stay where they are.
    """
    _, good = search(docs, benchmark, threshold)
    bad = durable(good.select("th").distinct())
    keyed = docs.select(F.struct("*").alias("row"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"))
    keyed = Sieve(bad.select(F.col("th").alias("h"))).marked(keyed, F.col("th"))
    return keyed.where("not may").select("row.*").unionByName(keyed.where("may").join(bad, "th", "left_anti").select("row.*"))
