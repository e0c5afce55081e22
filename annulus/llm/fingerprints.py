"""Bottom-k sketches of shingle hashes: resemblance, containment and distinct counts from k numbers.

DataFrame functions only. A text's sketch is the k smallest distinct XXH64 hashes (as unsigned
numbers) of its five-word shingles. Sketches of parts merge into the sketch of the whole, so they can be
built where the parts are.
"""

from __future__ import annotations

import os
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

K = 64
WIDTH = 5
FLIP = -(1 << 63)  # turns the order of signed longs into that of unsigned ones


def shingle_hashes(text: Column, width: int = WIDTH) -> Column:
    """array<long>: a hash for each run of ``width`` words (runs of letters and digits, lower case); for fewer words one of all; none for no word."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.transform(F.array(words), lambda w: F.when(F.size(w) >= width, F.transform(F.sequence(F.lit(1), F.size(w) - width + 1), lambda i: F.xxhash64(*[F.get(w, i + k - 1) for k in range(width)]))).when(F.size(w) > 0, F.array(F.xxhash64(F.array_join(w, " ")))).otherwise(F.array().cast("array<bigint>")))[0]


def sketch(text: Column, k: int = K) -> Column:
    """array<long>: the k smallest distinct hashes, flipped to signed order, ascending."""
    return F.slice(F.array_sort(F.array_distinct(F.transform(shingle_hashes(F.coalesce(text, F.lit(""))), lambda h: h.bitwiseXOR(F.lit(FLIP))))), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two parts together."""
    return F.slice(F.array_sort(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Share of the union's sketch that both hold: estimates |A and B| / |A or B|. Two empty sketches are alike."""
    both = merge(a, b, k)
    return F.when(F.size(both) == 0, 1.0).otherwise(F.size(F.array_intersect(F.array_intersect(both, a), b)) / F.size(both))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: exact below k, else (k - 1) over the k-th smallest hash as a fraction."""
    top = (F.element_at(a, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / top)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of A's shingles that B holds: resemblance times the size of the union, over that of A."""
    n = distinct_shingles(a, k)
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), resemblance(a, b, k) * distinct_shingles(merge(a, b, k), k) / n))


def written(a: Column) -> Column:
    """The sketch as text: 16 hex digits for each hash, in order."""
    return F.array_join(F.transform(a, lambda h: F.lower(F.lpad(F.hex(h.bitwiseXOR(F.lit(FLIP))), 16, "0"))), "")


def sketches(docs: DataFrame, k: int = K) -> DataFrame:
    """doc_id, fingerprint, n_shingles (estimated): one row for each row of ``docs``; null text counts as empty."""
    s = docs.select("doc_id", sketch(F.col("text"), k).alias("s"))
    return s.select("doc_id", written(F.col("s")).alias("fingerprint"), distinct_shingles(F.col("s"), k).alias("n_shingles"))


def sketch_by(docs: DataFrame, key: str, k: int = K) -> DataFrame:
    """key, fingerprint, n_shingles: one sketch for each value of ``key``, of all its texts together.

    Each text is sketched on its own and at most k hashes of it are sent on; equal hashes of a key are
    counted once before the shuffle, and a key is cut into salts before its hashes are ranked, so a
    key with a third of all texts is no single task.
    """
    h = docs.select(F.col(key).alias("key"), F.explode(sketch(F.col("text"), k)).alias("h")).distinct()
    few = Window.partitionBy("key", "salt").orderBy("h")
    part = h.withColumn("salt", F.pmod(F.xxhash64("h"), F.lit(64))).withColumn("n", F.row_number().over(few)).where(F.col("n") <= k)
    s = part.groupBy("key").agg(F.slice(F.array_sort(F.collect_list("h")), 1, k).alias("s"))  # at most 64 k hashes
    return s.select(F.col("key").alias(key), written(F.col("s")).alias("fingerprint"), distinct_shingles(F.col("s"), k).alias("n_shingles"))


def place_of(docs: DataFrame) -> Column:
    """A long that never falls as doc_id rises, null for null: a whole number itself, a number's whole part, and of a text seven bytes behind what all
    of them begin with. Ids of other types have one place."""
    kind = docs.schema["doc_id"].dataType
    if isinstance(kind, T.IntegralType):
        return F.col("doc_id").cast("long")
    if isinstance(kind, T.NumericType):
        return F.floor(F.col("doc_id").cast("double")).cast("long")
    if not isinstance(kind, T.StringType):
        return F.when(F.col("doc_id").isNotNull(), F.lit(0).cast("long"))
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    same = len(os.path.commonprefix([(low or "").encode(), (high or "").encode()]))
    return F.conv(F.rpad(F.hex(F.substring(F.col("doc_id").cast("binary"), same + 1, 7)), 14, "0"), 16, 10).cast("long")


def with_next(docs: DataFrame, made: Column | None = None, *, rows: int = 500, most: int = 262_144) -> DataFrame:
    """doc_id, text, made, next: each row, and as next the struct (text, made) of the row after it by (doc_id, hash of the text); after the last, the first.

    made: what is made of each text before rows are put in order, so that a row's neighbour needn't make it again.
    Ids are cut into ranges of about ``rows`` rows along approximate quantiles of their places (place_of), and each range is
    shuffled to one task by itself; no task sees the whole order. A whole number (or null) that holds many rows is cut by the hash
    of the text, so only rows equal in both stay together; ids of other types that share a place stay together, sorted with spills. ``most`` bounds the table of ranges that is broadcast,
    not the rows: beyond it ranges hold more rows and are sorted with spills. A range's last row needs the next range's
    first row, so that row is sent to both. Null ids come first.
    """
    kind = docs.schema["doc_id"].dataType
    exact = isinstance(kind, T.IntegralType)
    d = docs.select((F.col("doc_id").cast("long") if exact else F.col("doc_id")).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), place_of(docs).alias("place"))
    n, none, low, high, marks = d.agg(F.count("*"), F.count(F.when(F.col("place").isNull(), 1)), F.min("place"), F.max("place"), F.percentile_approx("place", [i / 64 for i in range(1, 64)], 2000)).first()
    ranges = max(1, min(most, n // rows))
    marks = Counter(marks or [])
    hot = {i: ranges * c // 64 for i, c in marks.items() if exact and c > 1 and ranges * c // 64 > 1}  # how many parts an id is cut into
    hot_null = max(1, ranges * none // n) if none else 0
    starts = sorted({low, *marks, *(i + 1 for i in hot if i < high)}) if low is not None else []
    # between two quantiles ids are cut evenly: this follows clustered ids as well as dense ones
    each = max(1, ranges // max(1, len(starts)))
    by_hash = lambda parts: F.shiftright((F.shiftright(F.xxhash64("text"), 40) + F.lit(1 << 23)) * F.lit(parts).cast("long"), 24)
    bucket, base = by_hash(hot_null) if hot_null > 1 else F.lit(0).cast("long"), hot_null
    for a, b in zip(starts, [*starts[1:], (high or 0) + 1]):
        parts = hot.get(a, each)
        # halves, so that no difference of two longs runs over
        within = by_hash(parts) if a in hot else F.floor((F.shiftright("place", 1) - F.lit(a >> 1)) / F.lit(-(-((b >> 1) - (a >> 1) + 1) // each))).cast("long")
        bucket, base = F.when(F.col("place") >= a, F.lit(base).cast("long") + within).otherwise(bucket), base + parts
    cut = F.when(F.col("place").isNull(), F.lit(hot_null > 1)).otherwise(F.col("place").isin(*hot) if hot else F.lit(False))
    # texts are read for this only where an id is cut
    d = d.withColumns({"bucket": bucket, "h": F.when(cut, F.xxhash64("text")) if hot or hot_null > 1 else F.lit(None).cast("long")})
    # at most `most` and some hundred rows, one for each range: the bound of the driver's list and of the broadcast
    firsts = [(r["bucket"], r["first"]) for r in d.groupBy("bucket").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("some"), F.col("doc_id").alias("id"), "h")).alias("first")).orderBy("bucket").collect()]
    sent = [(f["id"] if f["some"] else None, f["h"], b, firsts[i - 1][0]) for i, (b, f) in enumerate(firsts)]
    table = d.sparkSession.createDataFrame(sent, f"id {'long' if exact else kind.simpleString()}, its long, of long, to long")
    ghosts = d.join(F.broadcast(table), d["doc_id"].eqNullSafe(table["id"]) & d["h"].eqNullSafe(table["its"]) & (d["bucket"] == table["of"])).select("doc_id", "text", F.col("to").alias("bucket"), F.lit(True).alias("ghost"))
    every = d.select("doc_id", "text", "bucket", F.lit(False).alias("ghost")).unionByName(ghosts).withColumn("made", F.lit(None).cast("long") if made is None else made)
    order = Window.partitionBy("bucket").orderBy("ghost", F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    return every.withColumn("next", F.lead(F.struct("text", "made")).over(order)).where("not ghost").select("doc_id", "text", "made", "next")


def edited_halves(docs: DataFrame, k: int = K) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next: one row for each row of ``docs``.

    A text's edited form ends with the beginning of the next document instead of its own last half.
    Null or empty texts have no shingle, an empty fingerprint, and are wholly like each other. Null
    ids come first; rows of one id follow each other by the hash of their text; a single row is its own
    next. Extra columns are ignored, whatever their names.
    """
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    w = with_next(docs, sketch(F.col("text"), k)).withColumn("edited", F.concat(F.col("text").substr(F.lit(1), n - half), F.col("next.text").substr(F.lit(1), half)))
    s = w.select("doc_id", n.cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), F.col("made").alias("s"), sketch(F.col("edited"), k).alias("e"), F.col("next.made").alias("x"))
    return s.select("doc_id", "n_chars", "edited_sha256", written(F.col("s")).alias("fingerprint"), written(F.col("e")).alias("edited_fingerprint"), resemblance(F.col("s"), F.col("e"), k).alias("near_edited"), resemblance(F.col("s"), F.col("x"), k).alias("near_next"))
