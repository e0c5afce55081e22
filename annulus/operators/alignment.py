"""Local alignments without gaps between two sets of sequences.

Both sides come as blocks (id, block, seq). Each place of each sequence becomes a row with its word of ``k`` bases, the base before
it and the base behind it. Where two places share a word and differ in the base before, a longest exact match begins;
where they differ in the base behind, one ends. So a match of any length takes two rows, not one for each of its places: the join asks
for a differing neighbour by equality (a place is entered under each letter that its own neighbour is not), and the inside of
repeats, where words are alike by the thousand, joins with nothing. Starts and ends of one diagonal alternate.

Matches are then extended along their diagonals and tied to the next one where the way is good enough: a walk from a match's
end, one up for an equal base and two down for another, is given up when it falls by more than ``x_drop`` below its best. A match is longer
than that, so whoever reaches the next match alive is at a new best when it ends, and each gap can be judged by itself.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annulus.functions.genomics import reverse_complement
from annulus.operators.lineage import durable
from annulus.operators.sequences import BLOCK, lengths

# fixed values of the scoring system (one up, two down): lambda solves e^x / 4 + 3 e^(-2x) / 4 = 1, K is the published value
LAMBDA, K = 1.3327, 0.621
WORD, X_DROP, REACH = 28, 10, 1000
DIAGONAL = ["qseqid", "sseqid", "strand", "diagonal"]


def places(blocks: DataFrame, key: str, k: int, edge: str) -> DataFrame:
    """id, at, code, prev, next: a row for each word of ``k`` letters ACGT; code: the word as a number; neighbours that are no such letter are ``edge``.

    A block borrows its first neighbours' bases, so its size must be at least ``k``.
    """
    if not 2 <= k <= 31:
        raise ValueError("a word must fit into a long")
    b = blocks.select(F.col(key).cast("string").alias("id"), "block", F.upper("seq").alias("seq"))
    around = b.select("id", "block", F.lit(1).alias("kind"), "seq").unionByName(b.select("id", (F.col("block") - 1).alias("block"), F.lit(2).alias("kind"), F.left("seq", F.lit(k)).alias("seq")))
    around = around.unionByName(b.select("id", (F.col("block") + 1).alias("block"), F.lit(0).alias("kind"), F.right("seq", F.lit(1)).alias("seq")))
    one = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("seq")))
    # blocks are few bytes and many words, so they are dealt to a number of tasks that isn't made smaller by their size
    around = around.repartition(int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id", "block")
    x = around.groupBy("id", "block").agg(one(1).alias("seq"), F.coalesce(one(0), F.lit("")).alias("before"), F.coalesce(one(2), F.lit("")).alias("after")).where("length(seq) > 0")
    # binary slices take constant time, wherever they are
    x = x.select("id", "block", F.length("seq").alias("n"), F.length("before").alias("p"), F.concat("before", "seq", "after").cast("binary").alias("b"))
    cut = f"transform(sequence(0, n - 1), i -> named_struct('i', i, 'w', cast(substring(b, p + i + 1, {k}) as string), 'prev', case when p + i > 0 then cast(substring(b, p + i, 1) as string) else '' end, 'next', cast(substring(b, p + i + {k} + 1, 1) as string)))"
    w = x.select("id", "block", F.explode(F.expr(cut)).alias("x")).select("id", "block", "x.*").where(F.col("w").rlike(f"^[ACGT]{{{k}}}$"))
    plain = lambda c: F.when(F.col(c).isin("A", "C", "G", "T"), F.col(c)).otherwise(edge)
    return w.select("id", "block", "i", F.conv(F.translate("w", "ACGT", "0123"), 4, 10).cast("bigint").alias("code"), F.conv(F.translate(F.reverse("w"), "ACGT", "3210"), 4, 10).cast("bigint").alias("reverse"), plain("prev").alias("prev"), plain("next").alias("next"))


def matches(queries: DataFrame, subjects: DataFrame, *, k: int = WORD, size: int = BLOCK, both: bool = True, query_key: str = "circ_id", subject_key: str = "circ_id") -> DataFrame:
    """qseqid, sseqid, strand, diagonal, q_start, q_end: all longest exact matches of ``k`` bases and more.

    queries, subjects: blocks of ``size``. On strand '-' the query is reversed, and its places are counted from -length to 0; diagonal is
    subject's place less query's. both=False: only strand '+'. Upper and lower case are alike; a letter other than ACGT ends a match.
    """
    at = (F.col("block") * size + F.col("i")).cast("bigint")
    q = places(queries, query_key, k, "^")
    plus = q.select(F.col("id").alias("qseqid"), F.lit("+").alias("strand"), at.alias("q"), F.col("code").alias("q_code"), F.col("prev").alias("q_prev"), F.col("next").alias("q_next"))
    turned = q.select(F.col("id").alias("qseqid"), F.lit("-").alias("strand"), (-at - k).alias("q"), F.col("reverse").alias("q_code"), reverse_complement(F.col("next")).alias("q_prev"), reverse_complement(F.col("prev")).alias("q_next"))
    a = plus.unionByName(turned) if both else plus
    s = places(subjects, subject_key, k, "$").select(F.col("id").alias("sseqid"), at.alias("s"), "code", "prev", "next")
    letters = F.array(*map(F.lit, "ACGT^"))

    def met(side: str, ahead: int, kind: int) -> DataFrame:
        other = s.withColumn("other", F.explode(F.array_except(letters, F.array(side))))
        # places come out of few blocks, so their size is judged far too small: they must not be broadcast
        j = a.join(other.hint("merge"), (F.col("q_code") == F.col("code")) & (F.col(f"q_{side}") == F.col("other")))
        return j.select("qseqid", "sseqid", "strand", (F.col("s") - F.col("q")).alias("diagonal"), (F.col("q") + ahead).alias("at"), F.lit(kind).alias("kind"))

    order = Window.partitionBy(*DIAGONAL).orderBy("at")
    events = met("prev", 0, 0).unionByName(met("next", k, 1)).withColumn("q_end", F.lead("at").over(order))
    return events.where("kind = 0").select(*DIAGONAL, F.col("at").alias("q_start"), "q_end")


def _texts(gaps: DataFrame, queries: DataFrame, subjects: DataFrame, size: int, query_key: str, subject_key: str) -> DataFrame:
    """``gaps`` (DIAGONAL, q_start, side, lo, hi in the query's places) with q_text, s_text: the bases there, '' where there are none."""
    key = [*DIAGONAL, "q_start", "side"]
    minus = F.col("strand") == "-"
    ask = F.array(
        F.struct(F.lit("q").alias("which"), F.col("qseqid").alias("id"), F.greatest(F.lit(0), F.when(minus, -F.col("hi")).otherwise(F.col("lo"))).alias("from"), F.when(minus, -F.col("lo")).otherwise(F.col("hi")).alias("to")),
        F.struct(F.lit("s").alias("which"), F.col("sseqid").alias("id"), F.greatest(F.lit(0), F.col("lo") + F.col("diagonal")).alias("from"), (F.col("hi") + F.col("diagonal")).alias("to")),
    )
    number = lambda c: F.floor(c / F.lit(size)).cast("bigint")
    each = gaps.select(*key, F.explode(ask).alias("x")).select(*key, "x.*").where("to > from")
    each = each.withColumn("block", F.explode(F.sequence(number(F.col("from")), number(F.col("to") - 1))))
    held = queries.select(F.lit("q").alias("which"), F.col(query_key).cast("string").alias("id"), "block", "seq").unionByName(subjects.select(F.lit("s").alias("which"), F.col(subject_key).cast("string").alias("id"), "block", "seq"))
    lo, hi = F.greatest("from", F.col("block") * size), F.least("to", (F.col("block") + 1) * size)
    part = F.upper(F.col("seq").substr((lo - F.col("block") * size + 1).cast("int"), (hi - lo).cast("int")))
    got = each.join(held, ["which", "id", "block"]).select(*key, "which", F.struct("block", part.alias("s")).alias("p"))
    text = lambda which: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("which") == which, F.col("p")))), lambda p: p["s"]), "")
    both = got.groupBy(*key).agg(text("q").alias("q_text"), text("s").alias("s_text"))
    return gaps.join(both, key, "left").withColumns({"q_text": F.coalesce(F.when(minus, reverse_complement(F.col("q_text"))).otherwise(F.col("q_text")), F.lit("")), "s_text": F.coalesce("s_text", F.lit(""))})


def best_way(equal: np.ndarray, x_drop: int) -> tuple[int, int, bool]:
    """(bases, differing ones, alive): how far a walk over ``equal`` is at its best, and whether it gets to the end."""
    score = np.cumsum(np.where(equal, 1, -2))
    fallen = np.flatnonzero(np.maximum.accumulate(np.maximum(score, 0)) - score > x_drop)
    end = int(fallen[0]) if len(fallen) else len(equal)
    if not end or score[:end].max() <= 0:
        return 0, 0, not len(fallen)
    n = int(np.argmax(score[:end])) + 1
    return n, int((~equal[:n]).sum()), not len(fallen)


def walked(side: Column, q_text: Column, s_text: Column, x_drop: int) -> Column:
    """bridged, gap, right, right_diff, left, left_diff: a walk from the left end, and if it doesn't arrive one from the right end too.

    side: 'inner' lies between two matches; 'right' and 'left' are walked from the match's end alone. gap: differing bases of all.
    """

    @F.pandas_udf("bridged boolean, gap long, right long, right_diff long, left long, left_diff long")
    def walk(sides: pd.Series, a: pd.Series, b: pd.Series) -> pd.DataFrame:
        rows = []
        for where, x, y in zip(sides, a, b):
            x, y = (np.frombuffer(t.encode(), np.uint8) for t in (x, y))
            n = min(len(x), len(y))
            if where == "left":  # both texts end at the match
                rows.append((False, 0, 0, 0, *best_way((x[len(x) - n :] == y[len(y) - n :])[::-1], x_drop)[:2]))
                continue
            equal = x[:n] == y[:n]
            right = best_way(equal, x_drop)
            if where == "right":
                rows.append((False, 0, *right[:2], 0, 0))
            elif right[2]:
                rows.append((True, int((~equal).sum()), 0, 0, 0, 0))
            else:
                rows.append((False, 0, *right[:2], *best_way(equal[::-1], x_drop)[:2]))
        return pd.DataFrame(rows, columns=["bridged", "gap", "right", "right_diff", "left", "left_diff"])

    return walk(side, q_text, s_text)


def hits(queries: DataFrame, subjects: DataFrame, *, k: int = WORD, x_drop: int = X_DROP, reach: int = REACH, size: int = BLOCK, both: bool = True, query_key: str = "circ_id", subject_key: str = "circ_id") -> DataFrame:
    """Rows of schema.HITS: local alignments without gaps of each query on each subject, from seeds of ``k`` equal bases.

    Matches of one diagonal that lie further apart than ``reach`` are not tied, and no end is walked further. Places are
    counted from 1; on the other strand subject_start is above subject_end. pident is of the alignment's length; bitscore and evalue are
    those of one up, two down, without correction of lengths. Ids are texts. Empty tables give no hit.
    """
    if k < x_drop:
        raise ValueError("a match must make up for what a walk may lose")
    m = durable(matches(queries, subjects, k=k, size=size, both=both, query_key=query_key, subject_key=subject_key))
    order = Window.partitionBy(*DIAGONAL).orderBy("q_start")
    m = m.withColumns({"next": F.lead("q_start").over(order) - F.col("q_end"), "before": F.col("q_start") - F.lag("q_end").over(order)})
    inner = F.coalesce(F.col("next") <= reach, F.lit(False))
    ahead = F.struct(F.when(inner, "inner").otherwise("right").alias("side"), F.col("q_end").alias("lo"), (F.col("q_end") + F.least(F.coalesce("next", F.lit(reach)), F.lit(reach))).alias("hi"))
    back = F.struct(F.lit("left").alias("side"), (F.col("q_start") - F.least(F.coalesce("before", F.lit(reach)), F.lit(reach))).alias("lo"), F.col("q_start").alias("hi"))
    alone = F.coalesce(F.col("before") > reach, F.lit(True))
    gaps = m.select(*DIAGONAL, "q_start", F.explode(F.when(alone, F.array(ahead, back)).otherwise(F.array(ahead))).alias("x")).select(*DIAGONAL, "q_start", "x.*")
    done = _texts(gaps, queries, subjects, size, query_key, subject_key).withColumn("w", walked(F.col("side"), F.col("q_text"), F.col("s_text"), x_drop))
    ways = done.groupBy(*DIAGONAL, "q_start").agg(F.max(F.when(F.col("side") != "left", F.col("w"))).alias("r"), F.max(F.when(F.col("side") == "left", F.col("w"))).alias("l"))
    t = m.join(ways, [*DIAGONAL, "q_start"]).withColumn("p", F.lag("r").over(order))
    t = t.withColumn("part", F.sum(F.when(F.coalesce(F.col("p.bridged"), F.lit(False)), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    left = lambda c: F.coalesce(F.col(f"l.{c}"), F.col(f"p.{c}"), F.lit(0))
    h = t.groupBy(*DIAGONAL, "part").agg(
        F.min("q_start").alias("a"), F.max("q_end").alias("b"), F.min_by(F.struct(left("left").alias("n"), left("left_diff").alias("d")), "q_start").alias("lw"),
        F.max_by(F.struct("r.right", "r.right_diff"), "q_start").alias("rw"), F.sum(F.when(F.col("r.bridged"), F.col("r.gap")).otherwise(0)).alias("gap"),
    )
    h = h.select("qseqid", "sseqid", "strand", "diagonal", (F.col("a") - F.col("lw.n")).alias("a"), (F.col("b") + F.col("rw.right")).alias("b"), (F.col("gap") + F.col("lw.d") + F.col("rw.right_diff")).alias("diff"))
    length = F.col("b") - F.col("a")
    score = length - 3 * F.col("diff")
    sizes = lambda blocks, key, name, n: lengths(blocks, key, size).select(F.col(key).cast("string").alias(name), F.col("length").alias(n))
    h = h.join(sizes(queries, query_key, "qseqid", "m"), "qseqid").join(sizes(subjects, subject_key, "sseqid", "n"), "sseqid")
    minus = F.col("strand") == "-"
    s_first, s_last = F.col("a") + F.col("diagonal") + 1, F.col("b") + F.col("diagonal")
    return h.select(
        "qseqid", "sseqid", (100.0 * (length - F.col("diff")) / length).alias("pident"), length.alias("alignment_length"), F.col("diff").alias("number_mismatches"), F.lit(0).cast("bigint").alias("number_gap_openings"),
        F.when(minus, 1 - F.col("b")).otherwise(F.col("a") + 1).alias("query_start"), F.when(minus, -F.col("a")).otherwise(F.col("b")).alias("query_end"),
        F.when(minus, s_last).otherwise(s_first).alias("subject_start"), F.when(minus, s_first).otherwise(s_last).alias("subject_end"),
        (K * F.col("m") * F.col("n") * F.exp(-LAMBDA * score)).alias("evalue"), ((LAMBDA * score - math.log(K)) / math.log(2)).alias("bitscore"),
    )


def turned_round(found: DataFrame) -> DataFrame:
    """Hits of strand '+' seen from their subjects: queries and subjects change places."""
    names = {"qseqid": "sseqid", "sseqid": "qseqid", "query_start": "subject_start", "query_end": "subject_end", "subject_start": "query_start", "subject_end": "query_end"}
    return found.where("subject_start < subject_end").select(*[F.col(names.get(c, c)).alias(c) for c in found.columns])
