"""Compression of vectors by product codes with integer codebooks.

A vector's components become integers, and the vector is cut into parts. Each part position has a codebook of a few
entries, which are improved in rounds: every part goes to its nearest entry, and an entry becomes the mean of its parts. In each round one
kd-tree for each codebook is broadcast (a few entries by a part's width, whatever the input's size); tasks search the trees for
their vectors and keep integer sums for each entry; the sums of all tasks are added by Spark, and what returns to the driver is one row for each
entry's component.

The search visits a node whenever its bound is not above the best distance so far, equal bounds included, so an entry of
a lower index that is as near as the best is always seen.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from annulus.llm.common import durable

LIMIT = 2**50  # of a component times the scale; integers beyond 2^53 aren't exact as doubles
SAFE = 2**27  # up to here squared distances and sums of a batch fit into 64 bits; beyond, Python's integers are used
LARGEST = 2**63 - 1


@dataclass(frozen=True)
class Node:
    """A leaf has entries; an inner node cuts ``axis``: entries up to ``low`` are left, from ``high`` on right."""

    entries: tuple[int, ...] = ()
    axis: int = -1
    low: int = 0
    high: int = 0
    left: Node | None = None
    right: Node | None = None


def build(entries: np.ndarray, leaf: int = 2) -> Node:
    """A kd-tree over the rows of ``entries``: halved by the widest component until ``leaf`` of them are left."""

    def grow(rows: np.ndarray) -> Node:
        points = entries[rows]
        spread = points.max(axis=0) - points.min(axis=0) if len(rows) and points.shape[1] else np.zeros(0)
        if len(rows) <= leaf or not len(spread) or not max(spread):
            return Node(tuple(int(r) for r in rows))
        axis = int(np.argmax(spread))
        order = rows[np.argsort(points[:, axis], kind="stable")]
        half = len(order) // 2
        return Node((), axis, int(entries[order[half - 1], axis]), int(entries[order[half], axis]), grow(order[:half]), grow(order[half:]))

    return grow(np.arange(len(entries)))


def nearest(tree: Node, entries: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the nearest entry of each row of ``points``; among equally near ones the lowest index."""
    index = np.full(len(points), len(entries), np.int64)
    best = np.full(len(points), -1, points.dtype)  # -1: none yet

    def visit(node: Node, rows: np.ndarray, bound: np.ndarray, off: dict[int, np.ndarray]) -> None:
        """bound: the least squared distance of the node's region; off: by axis what it owes to it."""
        if not len(rows):
            return
        if node.left is None or node.right is None:
            for e in node.entries:
                d = ((points[rows] - entries[e]) ** 2).sum(axis=1)
                better = (best[rows] < 0) | (d < best[rows]) | ((d == best[rows]) & (e < index[rows]))
                at = rows[better]
                best[at], index[at] = d[better], e
            return
        x = points[rows, node.axis]
        to_left = np.maximum(x - node.low, 0) ** 2  # what a point beyond the left part's last entry has to go
        to_right = np.maximum(node.high - x, 0) ** 2
        before = off.get(node.axis, np.zeros(len(rows), points.dtype))
        near_left = (to_left <= to_right).astype(bool)
        for first in (True, False):
            for child, cost, near in ((node.left, to_left, near_left), (node.right, to_right, ~near_left)):
                owed = np.maximum(before, cost)
                reach = bound - before + owed
                go = near if first else ~near & ((best[rows] < 0) | (reach <= best[rows])).astype(bool)
                visit(child, rows[go], reach[go], {k: v[go] for k, v in off.items()} | {node.axis: owed[go]})

    visit(tree, np.arange(len(points)), np.zeros(len(points), points.dtype), {})
    return index, best


Codebook = list[list[int]]


def cuts(width: int, parts: int) -> list[tuple[int, int]]:
    """Ends of consecutive parts; where the width isn't a multiple of them, the first ones are longer by one."""
    ends = [(width // parts) * k + min(k, width % parts) for k in range(parts + 1)]
    return list(zip(ends, ends[1:]))


class Search:
    """Trees of all codebooks, and their search for batches of vectors."""

    def __init__(self, codebooks: list[Codebook], width: int):
        self.places = cuts(width, len(codebooks))
        largest = max((abs(x) for book in codebooks for entry in book for x in entry), default=0)
        self.small = largest < SAFE
        self.books = [np.array(book, np.int64 if self.small else object).reshape(len(book), b - a) for book, (a, b) in zip(codebooks, self.places)]
        self.trees = [build(book) for book in self.books]

    def __call__(self, vectors: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each part: the parts' components, indexes and distances."""
        exact = vectors if self.small and (not vectors.size or max(vectors.max(), -vectors.min()) < SAFE) else vectors.astype(object)
        for tree, book, (a, b) in zip(self.trees, self.books, self.places):
            points = np.ascontiguousarray(exact[:, a:b])
            yield points, *nearest(tree, book.astype(exact.dtype), points)


def usable(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows whose vector is there and has finite components only."""
    bad = F.exists(F.col(vector), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where(F.col(vector).isNotNull() & ~bad)


def whole(vector: Column, scale: int) -> Column:
    """Components times ``scale``, rounded down."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("bigint"))


def compress(vectors: DataFrame, *, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, vector: str = "embedding") -> tuple[DataFrame, list[Codebook]]:
    """((vec_id, codes, error, label), codebooks): for each usable row of ``vectors`` the entry of each part, and the squared distance in all.

    codebooks[part][entry] are the components. Rows whose vector is null or holds a null or a non-finite component are left out, and
    so are rows of another width than the first's, and components of 2^50 and more after scaling, which no long error could hold.
    The first ``entries`` distinct ids in ascending order give the first codebooks (of a repeated id the least vector; null ids
    give none); with fewer of them codebooks are smaller, and without any all rows are left out. Repeated rows count as often as
    they occur. An empty table gives no row and no codebook. Extra columns are ignored. Each round reads the vectors from where they are.
    """
    if not 0 < entries <= 256:
        raise ValueError("an entry's index takes one byte")
    spark: SparkSession = vectors.sparkSession
    known = usable(vectors.select("vec_id", F.col(vector).alias("__v"), "label"), "__v").withColumn("__v", whole(F.col("__v"), scale))
    known = known.where(~F.exists("__v", lambda x: (x >= LIMIT) | (x <= -LIMIT)))
    first = known.where("vec_id is not null").select("vec_id").distinct().orderBy("vec_id").limit(entries)
    ids = [r["vec_id"] for r in first.collect()]  # `entries` at most
    seeds = known.where(F.col("vec_id").isin(ids)).groupBy("vec_id").agg(F.min("__v").alias("v")).orderBy("vec_id").collect() if ids else []
    width = len(seeds[0]["v"]) if seeds else 0
    kept = known.where((F.size("__v") == width) & F.lit(bool(seeds)))
    books: list[Codebook] = [[list(s["v"][a:b]) for s in seeds if len(s["v"]) == width] for a, b in cuts(width, parts)]
    for _ in range(rounds if seeds else 0):
        books = improved(kept.select("__v"), books, width)
    sent = spark.sparkContext.broadcast(books)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(sent.value, width)
        for batch in batches:
            codes, errors = np.zeros((batch.num_rows, parts), np.uint8), np.zeros(batch.num_rows, object)
            for k, (_, index, distance) in enumerate(search(_matrix(batch.column("__v"), width))):
                codes[:, k] = index
                errors += distance.astype(object)
            out = [batch.column("vec_id"), pa.array([bytes(c) for c in codes], pa.binary()), pa.array([min(int(e), LARGEST) for e in errors], pa.int64()), batch.column("label")]
            yield pa.RecordBatch.from_arrays(out, names=["vec_id", "codes", "error", "label"])

    schema = T.StructType([kept.schema["vec_id"], T.StructField("codes", T.BinaryType()), T.StructField("error", T.LongType()), kept.schema["label"]])
    return kept.mapInArrow(assign, schema), books


def _matrix(vectors: pa.Array, width: int) -> np.ndarray:
    return np.asarray(vectors.flatten()).reshape(len(vectors), width)


def improved(vectors: DataFrame, books: list[Codebook], width: int) -> list[Codebook]:
    """The codebooks after one round: each entry the mean of its parts, rounded down; entries without parts stay."""
    sent = vectors.sparkSession.sparkContext.broadcast(books)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each component of each entry that a task has used: its parts' number, and their sum as text, of any size."""
        books = sent.value
        search = Search(books, width)
        count = [np.zeros(len(b), np.int64) for b in books]
        total = [np.zeros((len(b), y - x), object) for b, (x, y) in zip(books, search.places)]
        for batch in batches:
            for k, (points, index, _) in enumerate(search(_matrix(batch.column("__v"), width))):
                for e in np.unique(index):
                    at = index == e
                    count[k][e] += int(at.sum())
                    total[k][e] += points[at].sum(axis=0).astype(object)
        rows = [(k, e, i, int(count[k][e]), str(int(x))) for k in range(len(books)) for e in range(len(books[k])) if count[k][e] for i, x in enumerate(total[k][e])]
        yield pa.RecordBatch.from_pylist([dict(zip(sums.names, r)) for r in rows], schema=sums)

    sums = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("place", pa.int32()), ("n", pa.int64()), ("sum", pa.string())])
    each = vectors.mapInArrow(summed, "part int, entry int, place int, n bigint, sum string")
    added = each.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum(F.col("sum").cast("decimal(38,0)")).alias("sum"))
    new = [[list(entry) for entry in book] for book in books]
    for r in added.collect():  # a row for each component of each entry
        new[r["part"]][r["entry"]][r["place"]] = int(r["sum"]) // r["n"]
    sent.unpersist()
    return new


def decompressed(codes: DataFrame, codebooks: list[Codebook], *, scale: int = 4096) -> DataFrame:
    """``codes`` with a column vector: the entries that the codes name, scaled back."""
    books = F.array(*[F.array(*[F.array(*[F.lit(x / scale) for x in entry]) for entry in book]) for book in codebooks])
    at = lambda k: F.conv(F.hex(F.substring("codes", k + 1, 1)), 16, 10).cast("int")
    return codes.withColumn("vector", F.concat(*[F.element_at(F.element_at(books, k + 1), at(k) + 1) for k in range(len(codebooks))]))


def digest(codebooks: list[Codebook]) -> str:
    """SHA-256 of all entries' components by part, entry and place, as comma-separated decimal numbers."""
    return hashlib.sha256(",".join(str(x) for book in codebooks for entry in book for x in entry).encode()).hexdigest()


def by_label(coded: DataFrame) -> DataFrame:
    """``coded`` with label_error: the errors' sum over equal labels, nulls together. Rows are read twice, so they are kept."""
    rows = durable(coded)
    sums = rows.groupBy(F.col("label").alias("__l")).agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("__sum"))
    total = F.when(F.col("__sum") > LARGEST, F.lit(LARGEST)).otherwise(F.col("__sum")).cast("bigint")
    return rows.join(sums, F.col("label").eqNullSafe(F.col("__l"))).select(*[F.col(f"`{c}`") for c in rows.columns], total.alias("label_error"))
