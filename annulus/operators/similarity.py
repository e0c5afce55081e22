"""How alike circles are, by the length of the fragments they share; and which of alike ones stay.

Pairs are looked for above a threshold, which every use has. Fragments are put in one order, rare ones first: two
circles above the threshold share a fragment among the first of both (prefix filter) and differ little in size, so a
fragment that very many circles pass seldom pairs them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annulus.operators.lineage import durable

SHORT = 64  # fragments of a circle that a row may carry


def jaccard(weights: DataFrame, *, multiset: bool, above: float) -> DataFrame:
    """a, b (a < b), s1, s2, shared, jaccard of circles more alike than ``above``. weights: circ_id, fid, mult, len.

    multiset: fragments count as often as they are passed. Otherwise once, and s1 and s2 are both the
    length of the union, as reported by the set form.

    What two circles share lies, in the order of fragments, from the first shared one on; it is more than ``above`` of
    each one's size, so at most the rest of each size comes before that fragment. Both
    rests must also reach ``above`` by 1 + ``above`` of the two sizes together. A circle of up to
    SHORT fragments carries those from the shared one on, and what a pair shares is counted where it meets; pairs with a longer circle are joined
    with all of both circles' fragments. A circle's fragments are different ones.
    """
    m = F.col("mult") if multiset else F.lit(1)
    w = weights.select("circ_id", "fid", (m * F.col("len")).cast("double").alias("w"))
    held = w.join(w.groupBy("fid").agg(F.count("*").alias("n")), "fid")
    own = Window.partitionBy("circ_id")
    order = own.orderBy("n", "fid")
    x = held.withColumns({"s": F.sum("w").over(own), "before": F.sum("w").over(order) - F.col("w"), "k": F.count("*").over(own), "at": F.row_number().over(order)})
    item = F.when(F.col("at") <= SHORT, F.struct("fid", "w"))
    x = x.withColumn("items", F.collect_list(item).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    slack = 1e-9 * F.col("s")  # sums are rounded; a pair too many is dropped below
    rest = F.when(F.col("k") <= SHORT, F.slice("items", F.col("at"), F.col("k").cast("int")))
    first = x.where(F.col("before") <= (1 - above) * F.col("s") + slack).select("fid", "circ_id", "s", (F.col("s") - F.col("before")).alias("left"), rest.alias("items"))
    side = lambda k: first.select("fid", *[F.col(c).alias(n) for c, n in (("circ_id", k), ("s", f"s{k}"), ("left", f"left_{k}"), ("items", f"items_{k}"))])
    sizes = F.least("sa", "sb") >= (above - 1e-9) * F.greatest("sa", "sb")
    enough = F.least("left_a", "left_b") >= (above / (1 + above) - 1e-9) * (F.col("sa") + F.col("sb"))
    met = side("a").join(side("b"), "fid").where((F.col("a") < F.col("b")) & sizes & enough)
    same = lambda p: F.coalesce(F.get(F.filter("items_b", lambda q: q["fid"] == p["fid"]), F.lit(0))["w"], F.lit(0.0))
    # whole where it is counted from the first shared fragment; null where a circle is long
    counted = F.aggregate("items_a", F.when(F.col("items_b").isNotNull(), F.lit(0.0)), lambda t, p: t + F.least(p["w"], same(p)))
    share = lambda c: c / (F.col("sa") + F.col("sb") - c)
    # the only element of an array, so that it is counted once and not for each place where it is named
    each = met.select("a", "b", "sa", "sb", F.explode(F.filter(F.array(counted), lambda c: c.isNull() | (share(c) > above))).alias("shared"))
    # few rows: the pairs found, and those with a long circle
    pairs = durable(each.groupBy("a", "b", "sa", "sb").agg(F.max("shared").alias("shared")))
    shared, open_ = pairs.where("shared is not null"), pairs.where("shared is null").drop("shared")
    if open_.limit(1).count():
        both = open_.join(w.select(F.col("circ_id").alias("a"), "fid", F.col("w").alias("wa")), "a").join(w.select(F.col("circ_id").alias("b"), "fid", F.col("w").alias("wb")), ["b", "fid"])
        shared = shared.unionByName(both.groupBy("a", "b", "sa", "sb").agg(F.sum(F.least("wa", "wb")).alias("shared")))
    union = F.col("sa") + F.col("sb") - F.col("shared")
    sides = (F.col("sa"), F.col("sb")) if multiset else (union, union)
    return shared.select("a", "b", sides[0].alias("s1"), sides[1].alias("s2"), "shared", (F.col("shared") / union).alias("jaccard")).where(F.col("jaccard") > above)


def prune_near_identical(circles: DataFrame, pairs: DataFrame, *, group: str = "first", threshold: float = 0.9) -> DataFrame:
    """Circles of which no later one of the same group is nearly identical. circles: circ_id, group."""
    g = circles.select("circ_id", group)
    alike = pairs.where(F.col("jaccard") > threshold).join(g.select(F.col("circ_id").alias("a"), F.col(group).alias("ga")), "a").join(g.select(F.col("circ_id").alias("b"), F.col(group).alias("gb")), "b")
    return circles.join(alike.where("ga = gb").select(F.col("a").alias("circ_id")).distinct(), "circ_id", "left_anti")


def prune_by_score(circles: DataFrame, pairs: DataFrame, *, threshold: float = 0.7) -> DataFrame:
    """Circles to which no better one is alike: a higher score, or the same and found earlier. circles: circ_id, score, ord."""
    c = lambda side: circles.select(F.col("circ_id").alias(side), F.col("score").alias(f"score_{side}"), F.col("ord").alias(f"ord_{side}"))
    alike = pairs.where(F.col("jaccard") > threshold).join(c("a"), "a").join(c("b"), "b")
    better: Column = (F.col("score_a") > F.col("score_b")) | ((F.col("score_a") == F.col("score_b")) & (F.col("ord_a") < F.col("ord_b")))
    losers = alike.select(F.when(better, F.col("b")).otherwise(F.col("a")).alias("circ_id")).distinct()
    return circles.join(losers, "circ_id", "left_anti")


def overlap_score(a: Column, b: Column) -> Column:
    """How well two fragments (fid, chr, start, end) match: 1 for the same, less by their overlap, -2 without any."""
    size = F.abs(a["start"] - a["end"]).cast("double")
    begins = (b["start"] <= a["start"]) & (a["start"] <= b["end"])
    holds = (a["start"] <= b["start"]) & (b["start"] <= a["end"])
    from_a = F.greatest(size, F.abs(a["start"] - b["end"]).cast("double")) / size
    from_b = F.greatest(F.abs(b["start"] - b["end"]), F.abs(b["start"] - a["end"])).cast("double") / size
    return F.when(a["fid"] == b["fid"], 1.0).when((a["chr"] == b["chr"]) & begins, from_a).when((a["chr"] == b["chr"]) & holds, from_b).otherwise(-2.0)


def aligned(x: Column, y: Column, match: Callable[[Column, Column], Column] = overlap_score) -> Column:
    """How alike two circles are as sequences of fragments (arrays of (fid, chr, start, end)): the share of length in which a global alignment matches them.

    The table of the alignment grows row by row as a fold over x, each row as a fold over y; a gap costs 1. Then its best way
    is walked back from the end: a step in both circles counts the smaller share of the two fragments if the table isn't negative
    there. Of a circle of one fragment and a longer one, or of two different single fragments, nothing is alike. Circles are short:
    a row holds its table.
    """
    nx, ny = F.size(x), F.size(y)
    first = F.transform(F.sequence(F.lit(0), ny), lambda j: (-1 - j).cast("double"))

    def row(above: Column, f: Column) -> Column:
        def cell(held: Column, j: Column) -> Column:
            return F.concat(held, F.array(F.greatest(F.get(above, j) - 1, F.get(held, j - 1) - 1, F.get(above, j - 1) + match(f, F.get(y, j - 1)))))

        return F.aggregate(F.sequence(F.lit(1), ny), F.array(F.get(above, F.lit(0)) - 1), cell)

    table = F.aggregate(x, F.array(first), lambda rows, f: F.concat(rows, F.array(row(F.element_at(rows, -1), f))))
    shares = lambda p: F.transform(p, lambda f: F.abs(f["start"] - f["end"]) / F.aggregate(p, F.lit(0.0), lambda s, g: s + F.abs(g["start"] - g["end"])))
    held = F.struct(table.alias("m"), shares(x).alias("px"), shares(y).alias("py"))
    state = lambda i, j, s: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), s.cast("double").alias("s"))

    def way(t: Column) -> Column:
        at = lambda i, j: F.get(F.get(t["m"], i), j)

        def back(p: Column, _: Column) -> Column:
            i, j, s = p["i"], p["j"], p["s"]
            both, up, left = at(i - 1, j - 1), at(i - 1, j), at(i, j - 1)
            more = F.when(at(i, j) >= 0, F.least(F.get(t["px"], i - 1), F.get(t["py"], j - 1))).otherwise(0.0)
            return (
                F.when((i == 0) & (j == 0), p).when(i == 0, state(i, j - 1, s)).when(j == 0, state(i - 1, j, s))
                .when((both >= up) & (both >= left), state(i - 1, j - 1, s + more)).when((up > both) & (up > left), state(i - 1, j, s)).otherwise(state(i, j - 1, s))
            )

        return F.aggregate(F.sequence(F.lit(1), nx + ny), state(nx, ny, F.lit(0)), back)["s"]

    # the table is made once and looked at many times: it is bound to a name as the only element of an array
    score = F.get(F.transform(F.array(held), way), F.lit(0))
    alone = (nx == 1) | (ny == 1)
    same = (nx == 1) & (ny == 1) & (F.get(x, F.lit(0))["fid"] == F.get(y, F.lit(0))["fid"])
    return F.when((nx == 0) | (ny == 0) | (alone & ~same), 0.0).otherwise(score)


def vector_likeness(pairs: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """cosine, relative_l2, mse, absolute of paired values: how close estimates are to what was measured."""
    a, b = F.col(x), F.col(y)
    return pairs.agg(
        (F.sum(a * b) / (F.sqrt(F.sum(a * a)) * F.sqrt(F.sum(b * b)))).alias("cosine"), (F.sqrt(F.sum((a - b) * (a - b))) / F.sqrt(F.sum(a * a))).alias("relative_l2"),
        F.avg((a - b) * (a - b)).alias("mse"), F.abs(F.sum(a) - F.sum(b)).alias("absolute"),
    )
