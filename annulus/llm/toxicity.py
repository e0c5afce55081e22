"""Toxic passages by maximum-scoring segments over token log-odds, judged by extreme-value statistics.

1. Token log-odds between toxic and clean labelled texts, smoothed by a Dirichlet prior: a flat part
   and an informative one (the pooled counts). A token's units are the word and its prefixes of four
   to six letters, so inflected and compounded forms share evidence. A text counts once for each of
   its units and equal texts count once, so repetition proves nothing. Units with a z-score over
   ``min_z`` score positively; any other token costs ``drift``.
2. One linear scan finds all maximal scoring segments of a text (Ruzzo and Tompa's method): the
   toxic passages, however many. Only positive tokens are pushed; the drift between them is exact. Each
   segment keeps a link to the nearest one before it that begins lower, so no segment is passed twice.
3. A segment's score S is turned into an expected number of chance segments, E = K n exp(-lambda S) in a text of n
   tokens (Karlin and Altschul). lambda and K are fitted to the best segments of clean texts, beyond their
   ``tail`` quantile; texts below it count as censored. Segments with E under ``max_e`` are significant.
4. A document's score is a logistic function of its best segment's evidence and the sum of the
   significant segments' evidence. Its weights aren't negative, so more evidence never lowers a score, and a
   text without a segment has no evidence, however long it is.

What judges a text is never fitted on the same text: the sample is cut into three folds, and the texts of a fold are
measured with units from the other two. All of it gives lambda, K and the weights; the units used later come from all folds
and are those that pass without any one of two folds, too.
"""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from annulus.llm.common import durable, held_out, training_rows

WORD = re.compile(r"\w+")
FOLDS = 3


@dataclass(frozen=True)
class ToxicityModel:
    units: dict  # unit -> positive score
    drift: float
    lam: float
    k: float
    max_e: float
    weights: tuple  # of 1, best evidence, significant evidence, significant evidence by length


def units_of(word: str) -> list[str]:
    """The word, and its prefixes of 4 to 6 letters (marked, so a prefix isn't mixed up with a whole word)."""
    return [word, *(f"{word[:n]}^" for n in (4, 5, 6) if len(word) >= n)]


def segments(words: list[str], known: dict, drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments as (first word, end, score), in linear time. known: score of words that score positively."""
    held: list[tuple[int, int, float, float, int]] = []  # first, end, sum before, sum after, nearest segment that begins lower
    total, done = 0.0, 0
    for i, w in enumerate(words):
        s = known.get(w)
        if s is None:
            continue
        total -= drift * (i - done)
        first, left = i, total
        total += s
        done = i + 1
        j = len(held) - 1
        while True:
            while j >= 0 and held[j][2] >= left:
                j = held[j][4]
            if j < 0 or held[j][3] >= total:
                break
            first, _, left, _, lower = held[j]  # it begins lower and ends lower: the two are one
            del held[j:]
            j = lower
        held.append((first, done, left, total, j))
    return [(a, b, after - before) for a, b, before, after, _ in held]


def word_score(word: str, units: dict) -> float | None:
    found = [units[u] for u in units_of(word) if u in units]
    return max(found) if found else None


class Scorer:
    """Scores texts one after another; remembers words, of which it keeps a bounded number."""

    KEEP = 400_000

    def __init__(self, model: ToxicityModel):
        self.m, self.positive, self.seen = model, {}, set()

    def words(self, text: str) -> list[str]:
        words = WORD.findall((text or "").lower())
        new = set(words) - self.seen
        if new:
            if len(self.seen) > self.KEEP:
                self.positive, self.seen, new = {}, set(), set(words)
            for w in new:
                if (s := word_score(w, self.m.units)) is not None:
                    self.positive[w] = s
            self.seen |= new
        return words

    def passages(self, text: str) -> tuple[int, list[tuple[int, int, float]]]:
        words = self.words(text)
        if self.positive.keys().isdisjoint(words):
            return len(words), []
        return len(words), segments(words, self.positive, self.m.drift)

    def best(self, text: str) -> tuple[float, int]:
        """(score of the best segment, 0 if there is none; words)."""
        n, found = self.passages(text)
        return max((s for *_, s in found), default=0.0), n

    def significant(self, text: str) -> tuple[tuple[float, float, int], list[tuple[int, int]]]:
        """(best evidence, evidence of the significant segments together, words), and these segments. Evidence is -log E."""
        n, found = self.passages(text)
        chance = math.log(self.m.k * max(n, 1))
        proof = [(self.m.lam * s - chance, a, b) for a, b, s in found]
        good = [x for x in proof if x[0] > -math.log(self.m.max_e)]
        return (max((x[0] for x in proof), default=-math.inf), sum(x[0] for x in good), n), [(a, b) for _, a, b in good]


def inputs(best, much, n) -> np.ndarray:
    """The inputs of the logistic function, from 0 on: none of them falls as evidence grows. A text counts as 20 words at least where length divides."""
    best = np.asarray(best, float)
    return np.column_stack([np.log1p(np.where(best > 30, best, np.log1p(np.exp(np.minimum(best, 30))))), np.log1p(much), np.log1p(100 * np.asarray(much, float) / np.maximum(n, 20))])


def logistic(w: tuple, best: float, much: float, n: int) -> float:
    z = w[0] + float(inputs([best], [much], [n])[0] @ np.asarray(w[1:]))
    return float(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))


def karlin_altschul(probs: dict[float, float]) -> float:
    """lambda > 0 with sum p exp(lambda s) = 1, by bisection; the mean score must be negative."""
    f = lambda lam: sum(p * math.exp(min(lam * s, 500)) for s, p in probs.items()) - 1
    low, high = 0.0, 1.0
    while f(high) < 0 and high < 64:
        low, high = high, high * 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    return high


def extreme_value(best: np.ndarray, n: np.ndarray, tail: float = 0.9) -> tuple[float, float]:
    """(lambda, K) by maximum likelihood, where the best segment M of n tokens has P(M <= x) = exp(-K n exp(-lambda x)).

    Only what exceeds the ``tail`` quantile is taken as measured, the rest as being below it: significance is asked of the
    tail. Too few texts with a segment say nothing; then lambda is 1 and K lets one segment be expected in all of them.
    """
    n = np.maximum(n.astype(float), 1)
    least = best[best > 0].min() if (best > 0).any() else 1.0
    u = max(float(np.quantile(best, tail)) if len(best) else 0.0, least)
    over = best >= u
    d = int(over.sum())
    if d < 5 or np.ptp(best[over]) == 0:
        return 1.0, math.exp(u) * max(d, 1) / max(n.sum(), 1.0)
    x = np.where(over, best, u)
    shift = lambda lam: float((n * np.exp(-lam * (x - u))).sum())
    value = lambda lam: d * math.log(lam) - d * math.log(shift(lam)) - lam * float((best[over] - u).sum())
    grid = np.exp(np.linspace(math.log(1e-3), math.log(50), 200))
    i = int(np.argmax([value(v) for v in grid]))
    low, high = grid[max(i - 1, 0)], grid[min(i + 1, len(grid) - 1)]
    for _ in range(60):
        a, b = low + (high - low) / 3, high - (high - low) / 3
        low, high = (a, high) if value(a) < value(b) else (low, b)
    lam = float((low + high) / 2)
    return lam, d / shift(lam) * math.exp(lam * u)


def fit(docs: DataFrame, labels: DataFrame, *, max_rows: int = 20_000, min_count: int = 4, min_z: float = 3.5, prior: float = 10.0, drift: float = 0.25, max_e: float = 0.01, tail: float = 0.9) -> ToxicityModel:
    """The model from about ``max_rows`` labelled rows that aren't held out (see common.training_rows).

    That bounds what the driver receives: the units that pass in a fold, and three numbers for each sampled text.
    Without toxic or without clean rows no token scores and each document gets the same score.
    """
    fold = F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int")
    texts = durable(training_rows(docs, labels, "toxic", max_rows).groupBy("text").agg(F.max("y").alias("y")).select("text", "y", fold.alias("fold")))

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            got: dict[tuple[int, int], Counter] = {}
            for text, y, k in zip(pdf["text"], pdf["y"], pdf["fold"]):
                got.setdefault((int(y), int(k)), Counter()).update({u for w in set(WORD.findall(text.lower())) for u in units_of(w)} | {""})
            for (y, k), c in got.items():
                yield pd.DataFrame({"unit": list(c), "y": y, "fold": k, "n": list(c.values())})

    kinds = [(y, k) for y in (0, 1) for k in range(FOLDS)]
    each = [F.sum(F.when((F.col("y") == y) & (F.col("fold") == k), F.col("n")).otherwise(0)).alias(f"n{y}{k}") for y, k in kinds]
    counts = durable(texts.mapInPandas(count, "unit string, y int, fold int, n long").groupBy("unit").agg(*each))
    whole = counts.where("unit = ''").first()
    of_fold = {(y, k): int(whole[f"n{y}{k}"]) if whole else 0 for y, k in kinds}
    ways = [None, *range(FOLDS)]  # the fold that is left out
    total = {(y, left): sum(of_fold[y, k] for k in range(FOLDS) if k != left) for y in (0, 1) for left in ways}

    def odds(left: int | None) -> tuple[Column, Column, Column]:
        """(texts with the unit, log-odds, z): the prior of a unit is half a text, and its share of all texts, worth ``prior`` texts."""
        t, c = (sum(F.col(f"n{y}{k}") for k in range(FOLDS) if k != left) for y in (1, 0))
        a = 0.5 + prior * (t + c) / F.lit(float(total[0, left] + total[1, left]))
        log = lambda n, of: F.log((n + a) / (F.lit(of + 0.5 + prior + 0.5) - n - (a - 0.5)))
        o = log(t, total[1, left]) - log(c, total[0, left])
        return t + c, o, o / F.sqrt(1 / (t + a) + 1 / (c + a))

    sets: dict = {left: {} for left in ways}
    for left in ways:
        if total[1, left] and total[0, left]:
            n, o, z = odds(left)
            for r in counts.where(F.col("unit") != "").select("unit", n.alias("n"), o.alias("o"), z.alias("z")).where((F.col("n") >= min_count) & (F.col("z") >= min_z) & (F.col("o") > 1)).collect():
                sets[left][r["unit"]] = float(r["o"])

    # units that one fold alone carries are chance; with few labels they'd be most
    sets[None] = {u: o for u, o in sets[None].items() if sum(u in sets[left] for left in range(FOLDS)) >= FOLDS - 1}

    def blank(units: dict, lam: float = 1.0, k: float = 1.0) -> ToxicityModel:
        return ToxicityModel(units, drift, lam, k, max_e, (0.0, 0.0, 0.0, 0.0))

    def measured(lam: float | None, k: float) -> pd.DataFrame:
        """Of each text, by the units of the other folds: its best score, or with a lambda its evidence."""
        models = {left: blank(sets[left], lam or 1.0, k) for left in range(FOLDS)}

        def measure(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            scorers = {left: Scorer(m) for left, m in models.items()}
            for pdf in parts:
                if lam is None:
                    rows = [(s, 0.0, n) for s, n in (scorers[f].best(t) for t, f in zip(pdf["text"], pdf["fold"]))]
                else:
                    rows = [scorers[f].significant(t)[0] for t, f in zip(pdf["text"], pdf["fold"])]
                yield pd.DataFrame(rows, columns=["best", "much", "n"]).assign(y=pdf["y"].to_numpy())

        return texts.mapInPandas(measure, "best double, much double, n long, y int").toPandas()

    scores = measured(None, 1.0)
    clean = scores[scores["y"] == 0]
    lam, k = extreme_value(clean["best"].to_numpy(), clean["n"].to_numpy(), tail)
    model = blank(sets[None], lam, k)
    return ToxicityModel(model.units, drift, lam, k, max_e, fit_logistic(measured(lam, k)))


def fit_logistic(x: pd.DataFrame, ridge: float = 1e-3, steps: int = 50) -> tuple:
    """Weights of 1 and the three inputs; those of the inputs aren't negative.

    For each choice of inputs Newton's method with a small ridge gives the best weights; of the choices whose weights
    are all positive the one with the least loss is taken.
    """
    if x.empty:
        return (0.0, 0.0, 0.0, 0.0)
    X = np.column_stack([np.ones(len(x)), inputs(x["best"].to_numpy(), x["much"].to_numpy(), x["n"].to_numpy())])
    y = x["y"].to_numpy(float)
    best = (math.inf, np.zeros(4))
    for size in range(4):
        for some in itertools.combinations((1, 2, 3), size):
            at = [0, *some]
            w = np.zeros(len(at))
            for _ in range(steps):
                p = 1 / (1 + np.exp(-np.clip(X[:, at] @ w, -30, 30)))
                g = X[:, at].T @ (p - y) / len(y) + ridge * w
                h = (X[:, at] * (p * (1 - p))[:, None]).T @ X[:, at] / len(y) + ridge * np.eye(len(at))
                step = np.linalg.solve(h, g)
                w -= np.clip(step, -5, 5)
                if np.abs(step).max() < 1e-8:
                    break
            z = np.clip(X[:, at] @ w, -30, 30)
            loss = float(np.mean(np.logaddexp(0, z) - y * z) + ridge / 2 * w @ w)
            if (w[1:] >= 0).all() and loss < best[0]:
                full = np.zeros(4)
                full[at] = w
                best = (loss, full)
    return tuple(float(v) for v in best[1])


def score_column(text: Column, model: ToxicityModel) -> Column:
    """struct(score, n_segments, spans): spans are the significant passages as 'first:end' in words, by place."""

    kind = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("n_segments", T.LongType()), T.StructField("spans", T.StringType())])

    @F.pandas_udf(kind)
    def scored(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(model)
        for texts in parts:
            found = [scorer.significant(t) for t in texts]
            rows = [(logistic(model.weights, *x), len(good), ",".join(f"{a}:{b}" for a, b in good)) for x, good in found]
            yield pd.DataFrame(rows, columns=["score", "n_segments", "spans"])

    return scored(text)


def toxicity(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.7, **fitting) -> DataFrame:
    """doc_id, held_out, score, predicted, n_segments, spans: one row for each row of ``docs``.

    Null or empty text: no token, scored like any text without a passage, which is the least score there is. Repeated rows
    are scored alike. A null doc_id counts as held out. Without labels each score is 0.5 and predicted 0.
    Extra columns are ignored, whatever their names.
    """
    model = fit(docs, labels, **fitting)
    scored = docs.select("doc_id", "text").select("doc_id", held_out().alias("held_out"), score_column(F.coalesce("text", F.lit("")), model).alias("x"))
    return scored.select("doc_id", "held_out", F.col("x.score").alias("score"), (F.col("x.score") >= threshold).cast("int").alias("predicted"), F.col("x.n_segments").alias("n_segments"), F.col("x.spans").alias("spans"))
