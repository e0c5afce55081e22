"""Abundance of circles: multiplicities, clusters that share fragments, and a positive sparse regression for each."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from annulus.config import Config
from annulus.operators.lineage import components, durable
from annulus.operators.ordering import numbered
from annulus.operators.search import MOST_ROWS, block_of, by_key, in_blocks


def multiplicity(circles: DataFrame) -> DataFrame:
    """circ_id, fid, mult: how often each circle passes each fragment."""
    return circles.select("circ_id", F.explode(F.transform("path", lambda x: F.abs(x))).alias("fid")).groupBy("circ_id", "fid").agg(F.count("*").alias("mult"))


def clusters(mult: DataFrame) -> DataFrame:
    """circ_id, cluster: circles tied by shared fragments; a cluster is named by its smallest fragment.

    Circles and fragments are the two kinds of node of one graph: a circle is the negative of its id, less one.
    """
    ties = mult.select(F.col("fid").alias("a"), (-F.col("circ_id") - 1).alias("b"))
    tied = components(ties)
    named = tied.where("node > 0").groupBy("root").agg(F.min("node").alias("cluster"))
    return tied.where("node < 0").join(named, "root").select((-F.col("node") - 1).alias("circ_id"), "cluster")


Columns = list[tuple[np.ndarray, np.ndarray]]  # for each column the rows where it isn't zero, and its values there


def columns_of(x: np.ndarray) -> Columns:
    return [(at := np.flatnonzero(c), c[at]) for c in x.T]


def positive_lasso(x: np.ndarray | Columns, y: np.ndarray, *, alpha: float = 0.1, steps: int = 1000, tolerance: float = 1e-4) -> np.ndarray:
    """Weights >= 0 with least |y - x w - b|^2 / 2n + alpha sum w, by cyclic coordinate descent until the duality gap is small.

    Columns stay sparse: centring them only shifts what is left of y by one number, which is kept apart. A column that
    the gap proves to have no weight at the optimum is left out from then on. Constant columns have none either.
    """
    columns = columns_of(x) if isinstance(x, np.ndarray) else x
    n, y = len(y), y - y.mean()
    total, square = np.array([v.sum() for _, v in columns]), np.array([v @ v for _, v in columns])
    norm = square - total**2 / n
    w, rest, shift = np.zeros(len(columns)), y.copy(), 0.0
    enough = tolerance * (y @ y)
    live = np.flatnonzero(norm > 1e-12 * square)
    for step in range(steps):
        biggest = moved = 0.0
        for j in live.tolist():
            rows, values = columns[j]
            old = w[j]
            new = max(0.0, values @ rest[rows] + shift * total[j] + norm[j] * old - alpha * n) / norm[j]
            if new != old:
                rest[rows] -= (new - old) * values
                shift += (new - old) * total[j] / n
                w[j] = new
            moved, biggest = max(moved, abs(new - old)), max(biggest, new)
        if biggest == 0 or moved / biggest < tolerance or step % 10 == 9 or step == steps - 1:
            left = rest + shift
            fit = np.array([columns[j][1] @ left[columns[j][0]] for j in live.tolist()])
            high = max(0.0, fit.max(initial=0.0))
            scale = alpha * n / high if high > alpha * n else 1.0
            gap = 0.5 * (left @ left) * (1 + scale**2) + alpha * n * w.sum() - scale * (left @ y)
            if gap < enough:
                break
            live = live[(w[live] > 0) | (scale * fit + np.sqrt(norm[live] * 2 * max(gap, 0.0)) >= alpha * n)]
    return w


def solve_cluster(mult: Columns, coverage: np.ndarray, wgs_mean: float, config: Config = Config()) -> np.ndarray:
    """Scores of a cluster's circles (columns) over its fragments (rows); NaN where a circle is dropped.

    The genome's mean coverage is one more row, which no circle passes. The circle that passes every row once, and a number added
    to all of the matrix, are constant and go into the intercept. Weights below the cutoff are dropped, unless all are.
    """
    w = positive_lasso(mult, np.append(coverage, wgs_mean), alpha=config.alpha, steps=config.lasso_steps, tolerance=config.lasso_tolerance)
    cutoff = max(coverage.min() / 5, 10)
    return np.where(w >= cutoff, w, np.nan) if (w >= cutoff).any() else w


def positive_lassos(x: np.ndarray, y: np.ndarray, n: np.ndarray, *, alpha: float = 0.1, steps: int = 1000, tolerance: float = 1e-4) -> np.ndarray:
    """``positive_lasso`` of many small systems at once, by the same steps, a coordinate of all systems at a time.

    x: systems, lines, columns; y: systems, lines; n: how many lines each system has, beyond which both are zero, as are columns that it hasn't.
    Descent and gap need no more than the columns' products. A system that is settled stays as it is.
    """
    lines = np.arange(y.shape[1]) < n[:, None]
    y = np.where(lines, y - (y.sum(1) / n)[:, None], 0.0)
    total, square = x.sum(1), (x * x).sum(1)
    turned = x.transpose(0, 2, 1)
    by_column = lambda a: np.ascontiguousarray(np.moveaxis(a, 0, -1))
    gram = by_column(turned @ x - total[:, :, None] * total[:, None, :] / n[:, None, None])
    fit = by_column((turned @ y[:, :, None])[:, :, 0])
    norm, square = by_column(square - total**2 / n[:, None]), by_column(square)
    live, penalty, size = norm > 1e-12 * square, alpha * n, (y * y).sum(1)
    under, left, w = np.where(live, norm, 1.0), fit.copy(), np.zeros_like(fit)  # left: each column times what is left of y
    out, at, open_ = np.zeros(fit.T.shape), np.arange(len(n)), np.ones(len(n), bool)
    for step in range(steps):
        biggest, moved = np.zeros(len(at)), np.zeros(len(at))
        for j in range(len(w)):
            new = np.where(live[j], np.fmax(0.0, left[j] + norm[j] * w[j] - penalty) / under[j], w[j])
            change = new - w[j]
            if change.any():
                left -= gram[j] * change
                w[j] = new
                np.fmax(moved, np.abs(change), out=moved)
            np.fmax(biggest, new, out=biggest)
        due = open_ & ((biggest == 0) | (moved < tolerance * biggest) | (step % 10 == 9) | (step == steps - 1))
        if not due.any():
            continue
        c = np.flatnonzero(due)
        v, r, known, p = w[:, c], left[:, c], live[:, c], penalty[c]
        explained = (v * fit[:, c]).sum(0)
        high = np.fmax.reduce(np.where(known, r, 0.0), axis=0, initial=0.0)
        scale = np.where(high > p, p / np.where(high > p, high, 1.0), 1.0)
        gap = 0.5 * (size[c] - explained - (v * r).sum(0)) * (1 + scale**2) + p * v.sum(0) - scale * (size[c] - explained)
        live[:, c] = known & ((v > 0) | (scale * r + np.sqrt(np.fmax(norm[:, c], 0.0) * 2 * np.fmax(gap, 0.0)) >= p))
        done = (gap < tolerance * size[c]) | ~live[:, c].any(0) | (step == steps - 1)
        out[at[c[done]]] = v[:, done].T
        open_[c[done]] = False
        if not open_.any():
            break
        if 4 * open_.sum() < 3 * len(open_):  # else settled ones go on unread
            gram, fit, norm, under, left, w, live = (a[..., open_] for a in (gram, fit, norm, under, left, w, live))
            penalty, size, at = penalty[open_], size[open_], at[open_]
            open_ = open_[open_]
    return out


def tied(circle: np.ndarray, fragment: np.ndarray) -> np.ndarray:
    """For each circle the smallest fragment of its cluster. Both are numbered from 0 without gaps; pairs come by circle."""
    by_fragment = np.argsort(fragment, kind="stable")
    first = lambda a: np.flatnonzero(np.append(True, a[1:] != a[:-1]))
    circles, fragments = first(circle), first(fragment[by_fragment])
    least = np.arange(len(fragments))
    while True:
        own = np.minimum.reduceat(least[fragment], circles)
        new = np.minimum.reduceat(own[circle[by_fragment]], fragments)
        new = new[new]
        if (new == least).all():
            return own
        least = new


WIDTHS = np.array([2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64])  # systems are filled up to so many columns, to be solved together; wider ones are solved by themselves
CELLS = 1 << 21  # of the matrices that are held together
AT_ONCE = 1 << 20  # rows of clusters that are solved together


def solve_clusters(cluster: np.ndarray, circle: np.ndarray, fragment: np.ndarray, mult: np.ndarray, cover: np.ndarray, wgs_mean: float, config: Config = Config()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(circle, score, cluster) of many clusters. cluster, circle, fragment, mult: the passes, by cluster, circle and fragment; cover: coverage by fragment."""
    first = lambda *a: np.append(True, np.logical_or.reduce([x[1:] != x[:-1] for x in a]))
    head = first(cluster)
    s = np.cumsum(head) - 1  # clusters, circles and lines from 0 on, each in order
    name = cluster[head]
    own = first(cluster, circle)
    c = np.cumsum(own) - 1
    ids, of = circle[own], s[own]
    width = np.bincount(of)
    lines, line = np.unique(s * np.int64(len(cover)) + fragment, return_inverse=True)
    y, height = cover[lines % len(cover)], np.bincount(lines // len(cover))
    from_c, from_l = np.append(0, np.cumsum(width)), np.append(0, np.cumsum(height))
    from_p = np.append(np.flatnonzero(head), len(s))
    score = np.where(width == 1, np.add.reduceat(y, from_l[:-1]) / height, 100.0)[of]
    cutoff = np.fmax(np.minimum.reduceat(y, from_l[:-1]) / 5, 10)
    todo = np.flatnonzero((width > 1) & (height > 1))
    kind = np.searchsorted(WIDTHS, width)
    wide = (kind == len(WIDTHS)) | ((height + 1) * width * 2 > CELLS)
    for k in np.unique(kind[todo]).tolist():
        some = todo[(kind[todo] == k) & ~wide[todo]]
        some = some[np.argsort(height[some], kind="stable")]
        while len(some):
            columns = int(WIDTHS[k])
            fits = np.arange(1, len(some) + 1) * columns * np.maximum(columns, height[some] + 1) <= CELLS
            now, some = some[: max(1, fits.sum())], some[max(1, fits.sum()) :]
            place = np.full(len(width), -1)
            place[now] = np.arange(len(now))
            n = height[now] + 1
            pairs, rows = place[s] >= 0, place[lines // len(cover)] >= 0
            x, values = np.zeros((len(now), n.max(), columns)), np.zeros((len(now), n.max()))
            x[place[s[pairs]], line[pairs] - from_l[s[pairs]], c[pairs] - from_c[s[pairs]]] = mult[pairs]
            at = np.flatnonzero(rows)
            values[place[lines[at] // len(cover)], at - from_l[lines[at] // len(cover)]] = y[at]
            values[np.arange(len(now)), n - 1] = wgs_mean
            w = positive_lassos(x, values, n, alpha=config.alpha, steps=config.lasso_steps, tolerance=config.lasso_tolerance)
            here = np.flatnonzero(place[of] >= 0)
            score[here] = w[place[of[here]], here - from_c[of[here]]]
    for i in todo[wide[todo]].tolist():
        lo, hi = from_p[i], from_p[i + 1]
        cuts = lo + np.searchsorted(c[lo:hi], np.arange(from_c[i], from_c[i + 1] + 1))
        columns = [(line[a:b] - from_l[i], mult[a:b].astype(float)) for a, b in zip(cuts, cuts[1:])]
        score[from_c[i] : from_c[i + 1]] = positive_lasso(columns, np.append(y[from_l[i] : from_l[i + 1]], wgs_mean), alpha=config.alpha, steps=config.lasso_steps, tolerance=config.lasso_tolerance)
    solved = np.zeros(len(width), bool)
    solved[todo] = True
    enough = score >= cutoff[of]
    any_ = np.logical_or.reduceat(enough, from_c[:-1])
    kept = ~np.isnan(score) & (~solved[of] | enough | ~any_[of])
    return ids[kept], score[kept], name[of[kept]]


def mean_coverage(passes: DataFrame) -> DataFrame:
    """circ_id, weighted, plain, n: the mean coverage of each circle's fragments by length, and as such. passes: circ_id, fid, coverage, len."""
    by_length = F.sum(F.col("coverage") * F.col("len")) / F.sum("len")
    return passes.groupBy("circ_id").agg(by_length.alias("weighted"), F.avg("coverage").alias("plain"), F.count("*").alias("n"))


def expected_coverage(mult: DataFrame, scored: DataFrame) -> DataFrame:
    """fid, coverage: what the circles' scores come to on each fragment they pass. mult: circ_id, fid, mult; scored: circ_id, score."""
    return mult.join(scored.select("circ_id", "score"), "circ_id").groupBy("fid").agg(F.sum(F.col("mult") * F.col("score")).alias("coverage"))


def fragment_weights(fragments: DataFrame) -> DataFrame:
    """fid, weight: short and well covered fragments weigh most: (1 - share of the length) times the share of the coverage."""
    total = fragments.agg(F.sum("len").alias("all_len"), F.sum("coverage").alias("all_cov"))  # one row
    share = F.col("coverage") / F.col("all_cov")
    return fragments.crossJoin(F.broadcast(total)).select("fid", ((1 - F.col("len") / F.col("all_len")) * share).alias("weight"))


def distribution(rows: DataFrame, column: str, *, bins: int = 50, pseudocount: float = 0.01) -> DataFrame:
    """bucket (from 0), low, n: a histogram of whole values on a logarithmic scale, in bins of equal width; empty ones are left out.

    Values get ``pseudocount`` added; infinite and null ones aren't counted. If all are equal they are in bucket 0.
    """
    x = rows.select(F.col(column).cast("double").alias("v")).where("v < double('inf')").select(F.log10(F.floor("v") + pseudocount).alias("x"))
    ends = x.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))  # one row
    step = (F.col("hi") - F.col("lo")) / bins
    y = x.crossJoin(F.broadcast(ends)).select("lo", step.alias("step"), F.when(step > 0, F.least(F.lit(bins - 1), F.floor((F.col("x") - F.col("lo")) / step))).otherwise(0).cast("int").alias("bucket"))
    return y.groupBy("bucket").agg(F.first(F.pow(F.lit(10.0), F.col("lo") + F.col("bucket") * F.col("step"))).alias("low"), F.count("*").alias("n"))


def density(rows: DataFrame, column: str, *, points: int = 200, pseudocount: float = 0.01) -> DataFrame:
    """point (from 0), at, density: a Gaussian kernel density of whole values on a logarithmic scale, at ``points`` from the least value to the largest.

    The bandwidth is the values' deviation by n^(1/5) (Scott's rule). Values are counted by their three leading digits, so there are under a
    thousand cells for each power of ten, however many rows; a cell's values lie at their mean. Infinite, negative and null ones aren't
    counted; fewer than two different values have no curve.
    """
    v = rows.select(F.floor(F.col(column).cast("double")).alias("v")).where("v >= 0 and v < 1e18").select(F.col("v").cast("bigint").alias("v"))
    tail = F.pow(F.lit(10.0), F.greatest(F.lit(0), F.length(F.col("v").cast("string")) - 3)).cast("bigint")
    x = v.select((F.col("v") - F.col("v") % tail).alias("cell"), F.log10(F.col("v") + pseudocount).alias("x"))
    cells = x.groupBy("cell").agg(F.count("*").alias("c"), F.avg("x").alias("x"), F.sum(F.col("x") * F.col("x")).alias("xx"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    mean = F.sum(F.col("c") * F.col("x")) / F.sum("c")
    whole = cells.agg(F.sum("c").alias("n"), mean.alias("mean"), F.sum("xx").alias("xx"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("hi > lo")  # one row
    whole = whole.withColumn("h", F.sqrt((F.col("xx") - F.col("n") * F.col("mean") * F.col("mean")) / (F.col("n") - 1)) * F.pow("n", F.lit(-0.2)))
    grid = whole.select("n", "h", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda k: F.col("lo") + (F.col("hi") - F.col("lo")) * k / (points - 1))).alias("point", "g"))
    z = (F.col("g") - F.col("x")) / F.col("h")
    near = cells.select("c", "x").crossJoin(F.broadcast(grid))  # as many rows as there are points
    return near.groupBy("point").agg(F.first(F.pow(F.lit(10.0), F.col("g"))).alias("at"), (F.sum(F.col("c") * F.exp(-z * z / 2)) / F.first(F.col("n") * F.col("h") * (2 * math.pi) ** 0.5)).alias("density"))


def linear_models(rows: DataFrame, key: str, features: list[str], target: str, *, ridge: float = 1.0, alpha: float = 0.1) -> DataFrame:
    """key, model, coefficients: for each key least squares ('linear'), 'ridge' and 'lasso' fits of ``target`` on ``features``, with an intercept.

    One aggregation makes each key's sums of products, of the features' number squared; the fits use nothing else. Rows with a
    null feature or target are left out. Least squares of features that depend on each other is that of least length.
    """
    c = len(features)
    names = [*features, target]
    value = lambda name: F.col(name).cast("double")
    good = rows.dropna(subset=names)
    sums = F.array(*[F.sum(value(a)) for a in names])
    products = F.array(*[F.sum(value(a) * value(b)) for i, a in enumerate(names) for b in names[i:]])
    gram = good.groupBy(key).agg(F.count("*").alias("n"), sums.alias("sums"), products.alias("products"))

    @F.pandas_udf("array<struct<model:string,coefficients:array<double>>>")
    def fits(n: pd.Series, s: pd.Series, p: pd.Series) -> pd.Series:
        out = []
        for rows_, one, two in zip(n, s, p):
            m = np.zeros((c + 1, c + 1))
            m[np.triu_indices(c + 1)] = two
            m = m + np.triu(m, 1).T - np.outer(one, one) / rows_  # centred
            g, b = m[:c, :c], m[:c, c]
            w = {"linear": np.linalg.lstsq(g, b, rcond=1e-12)[0], "ridge": np.linalg.solve(g + ridge * np.eye(c), b), "lasso": _gram_lasso(g, b, alpha * rows_)}
            out.append([{"model": k, "coefficients": x.tolist()} for k, x in w.items()])
        return pd.Series(out)

    return gram.select(key, F.explode(fits("n", "sums", "products")).alias("f")).select(key, "f.model", "f.coefficients")


def _gram_lasso(g: np.ndarray, b: np.ndarray, penalty: float, steps: int = 10_000) -> np.ndarray:
    """Least w g w / 2 - b w + penalty sum |w|, by coordinate descent."""
    w = np.zeros(len(b))
    for _ in range(steps):
        before = w.copy()
        for j in range(len(b)):
            if g[j, j] > 0:
                r = b[j] - g[j] @ w + g[j, j] * w[j]
                w[j] = np.sign(r) * max(abs(r) - penalty, 0.0) / g[j, j]
        if np.abs(w - before).max(initial=0.0) <= 1e-14 * np.abs(w).max(initial=1.0):
            break
    return w


def total_errors(fits: DataFrame, key: str, truth: DataFrame) -> DataFrame:
    """key, model, error: the sum of absolute differences between a fit's coefficients and the true proportions. truth: key, proportions (array)."""
    off = F.aggregate(F.zip_with("coefficients", "proportions", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, x: s + x)
    return fits.join(truth, key).select(key, "model", off.alias("error"))


def abundance(circles: DataFrame, fragments: DataFrame, wgs_mean: float, config: Config = Config()) -> DataFrame:
    """circ_id, score, cluster: likely circles. A lone circle scores the mean coverage of its fragments.

    circles: circ_id, path, each circle once. A cluster is solved over its circles' passes, so a task's memory follows these; clusters that lie
    inside one block of ids take one shuffle, all others are put together by ``clusters``. If several circles share a single
    fragment, regression has nothing to tell them apart and each scores 100.
    """
    def scores(key: int, cover: dict[int, float], passes: dict[int, dict[int, int]]) -> list[tuple]:
        """cover: fid to coverage; passes: circ_id to fid to mult."""
        line = {f: i for i, f in enumerate(sorted(cover))}
        ids, y = sorted(passes), np.array([cover[f] for f in line])
        if len(ids) == 1:
            score = np.array([y.mean()])
        elif len(y) == 1:
            score = np.full(len(ids), 100.0)
        else:
            columns = [tuple(np.array(sorted((line[f], m) for f, m in passes[c].items())).T) for c in ids]
            score = solve_cluster([(at, v.astype(float)) for at, v in columns], y, wgs_mean, config)
        return [(c, float(s), key) for c, s in zip(ids, score) if not np.isnan(s)]

    def solve(key: int, rows: list) -> list[tuple]:
        passes: dict[int, dict[int, int]] = {}
        for r in rows:
            passes.setdefault(int(r.circ_id), {})[int(r.fid)] = r.mult
        return scores(key, {int(r.fid): float(r.coverage) for r in rows}, passes)

    def local(columns: list[np.ndarray]) -> tuple[list, list]:
        kind, circ, fid, value = columns
        cover, away = kind == 0, kind == 2  # away: circles that pass fragments of other blocks
        order = np.argsort(fid[cover], kind="stable")
        known, coverage = fid[cover][order], value[cover][order]
        empty = np.zeros(0, np.int64)
        ids, c = np.unique(circ[~cover], return_inverse=True)
        fids, f = np.unique(fid[~cover], return_inverse=True)
        if not len(ids):
            return [empty, empty.astype(float), empty], [empty, empty, empty, empty.astype(float)]
        gone = np.zeros(len(fids), bool)
        far = np.unique(c[away[~cover]])
        passes, mult = np.unique(c * np.int64(len(fids)) + f, return_counts=True)
        c, f = np.divmod(passes, len(fids))
        cluster = tied(c, f)
        gone[cluster[far]] = True
        leave = gone[cluster[c]]
        left = [np.ones(leave.sum(), np.int32), ids[c[leave]], fids[f[leave]], mult[leave].astype(float)]
        at = np.searchsorted(known, fids, side="right") - 1
        found = at >= 0
        found[found] = known[at[found]] == fids[found]
        keep = np.flatnonzero(~leave & found[f])
        if not len(keep):
            return [empty, empty.astype(float), empty], left
        keep = keep[np.argsort(cluster[c[keep]], kind="stable")]
        on = np.zeros(len(fids))
        on[found] = coverage[at[found]]
        circles_, score, name = solve_clusters(cluster[c[keep]], c[keep], f[keep], mult[keep], on, wgs_mean, config)
        return [ids[circles_], score, fids[name]], left

    known = fragments.select("fid", "coverage")
    ids = F.transform("path", lambda x: F.abs(x).cast("bigint"))
    steps = circles.select(F.col("circ_id").cast("bigint").alias("circ_id"), F.explode(ids).alias("fid"), F.when(block_of(F.array_min(ids)) == block_of(F.array_max(ids)), 1).otherwise(2).alias("kind")).where("fid is not null")
    steps = steps.select(block_of(F.col("fid")).alias("block"), "kind", "circ_id", "fid", F.lit(1.0).alias("value"))
    cover = known.select(block_of(F.col("fid")).alias("block"), F.lit(0).alias("kind"), F.lit(0).cast("bigint").alias("circ_id"), F.col("fid").cast("bigint").alias("fid"), F.col("coverage").cast("double").alias("value"))
    schema = "circ_id long, score double, cluster long"
    found, left = in_blocks(steps.unionByName(cover), local, "kind int, circ_id long, fid long, value double", schema, MOST_ROWS, at_once=AT_ONCE)
    if left is None:
        return found
    mult = durable(left.where("kind > 0").groupBy("circ_id", "fid").agg(F.sum("value").cast("bigint").alias("mult")))
    both = mult.join(clusters(mult), "circ_id").join(known, "fid")
    return found.unionByName(by_key(both, "cluster", solve, schema))


def cluster_order(scored: DataFrame) -> DataFrame:
    """``scored`` with ord: clusters by their first circle, circles within them by id, as they are reported."""
    x = scored.withColumn("__first", F.min("circ_id").over(Window.partitionBy("cluster")))
    return numbered(x, ["__first", "circ_id"], "ord", 1).drop("__first")
