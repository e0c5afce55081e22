"""Document quality from a linear-chain conditional random field over lines.

Each line is labelled good or bad. Its features describe the line and, as neighbouring-line
features, the lines before and after it. Forward-backward gives each line's marginal probability of
being good; their mean, weighted by length, is the document's quality. In training, a line carries its
document's label; the fit maximises the penalised conditional likelihood of whole label sequences.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annulus.llm.common import durable, held_out, training_rows

OWN = 10  # features of a line itself
FEATURES = 3 * OWN + 1  # with those of the lines before and after, and a constant
CHUNK = 1 << 20  # characters of text taken together

# classes of characters, for the table below
SPACE, LOWER, UPPER, DIGIT, STOP, BAR, SHOUT, SYMBOL, NEWLINE = range(9)


def _classes() -> np.ndarray:
    table = np.full(0x10000, SYMBOL, np.uint8)
    for i in range(0x10000):
        c = chr(i)
        if c == "\n":
            table[i] = NEWLINE
        elif c.isspace():
            table[i] = SPACE
        elif c.isdigit():
            table[i] = DIGIT
        elif c.isupper():
            table[i] = UPPER
        elif c.isalpha() or 0xD800 <= i < 0xE000:
            table[i] = LOWER
        elif c in ".,;:'\"-()?":
            table[i] = STOP
        elif c == "|":
            table[i] = BAR
        elif c == "!":
            table[i] = SHOUT
    return table


_TABLE: list[np.ndarray] = []


def table() -> np.ndarray:
    if not _TABLE:
        _TABLE.append(_classes())
    return _TABLE[0]


@dataclass(frozen=True)
class QualityModel:
    weights: np.ndarray  # of FEATURES, for the label good
    moves: np.ndarray  # 2 x 2, from label to label; 1 is good
    mean: np.ndarray
    scale: np.ndarray


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For all lines of the texts one after another: features (lines x OWN), lengths, and lines of each text.

    Lines end at a newline; an empty text is one empty line.
    """
    codes = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.concatenate([codes, np.array([10], np.uint32)])
    kind = table()[np.minimum(codes, 0xFFFF)]
    ends = np.flatnonzero(kind == NEWLINE)
    starts = np.concatenate([[0], ends[:-1] + 1])
    length = (ends - starts).astype(float)
    per_line = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)[ends]]))  # noqa: E731  (an end is never in the mask)
    count = {k: per_line(kind == k).astype(float) for k in (LOWER, UPPER, DIGIT, STOP, BAR, SHOUT, SYMBOL)}
    inside = (kind != SPACE) & (kind != NEWLINE)
    first = inside & ~np.concatenate([[False], inside[:-1]])
    at = np.flatnonzero(first)
    words = per_line(first).astype(float)
    again = np.zeros(len(ends))
    if len(at):
        # a word's hash is the sum of its characters' mixed codes: equal words have equal sums
        mixed = np.where(inside, (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) ^ ((codes.astype(np.uint64) + np.uint64(7)) * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(17)), np.uint64(0))
        sums = np.add.reduceat(mixed, at)
        line = np.searchsorted(ends, at)
        same = (sums[1:] == sums[:-1]) & (line[1:] == line[:-1])
        again = np.bincount(line[1:][same], minlength=len(ends)).astype(float)
    n, w = np.maximum(length, 1), np.maximum(words, 1)
    x = np.column_stack([np.log1p(length), count[UPPER] / n, count[DIGIT] / n, np.sqrt(count[SYMBOL] / n), np.sqrt(count[BAR] / w), np.sqrt(count[SHOUT] / w), np.sqrt(again / w), np.minimum((length - words) / w, 40) / 10, count[STOP] / w, np.log1p(words)])
    lines = np.array([t.count("\n") + 1 for t in texts])
    return x, length, lines


def chunks(text: str, size: int) -> Iterator[str]:
    """The text in parts of about ``size`` characters, cut at ends of lines; the line ends between parts are left out. A longer line is a part."""
    at = 0
    while len(text) - at > size:
        cut = text.find("\n", at + size)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut + 1
    yield text[at:]


def all_features(texts: list[str], size: int = CHUNK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """line_features of the texts, a chunk of characters at a time, so that what is kept is a few numbers for each line."""
    x, length, lines = [], [], np.zeros(len(texts), np.int64)
    some: list[tuple[int, str]] = []

    def flush() -> None:
        if some:
            a, b, n = line_features([t for _, t in some])
            x.append(a)
            length.append(b)
            np.add.at(lines, [i for i, _ in some], n)
            some.clear()

    held = 0
    for i, t in enumerate(texts):
        for part in chunks(t, size):
            some.append((i, part))
            held += len(part)
            if held >= size:
                flush()
                held = 0
    flush()
    return (np.concatenate(x), np.concatenate(length), lines) if x else (np.zeros((0, OWN)), np.zeros(0), lines)


def with_neighbours(x: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Adds the features of the line before and after in the same text (zeros at its ends) and a constant."""
    n = len(x)
    ends = np.cumsum(lines)
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    before[ends - lines] = 0
    after[ends - 1] = 0
    return np.column_stack([x, before, after, np.ones(n)])


def potentials(x: np.ndarray, lines: np.ndarray, w: np.ndarray) -> np.ndarray:
    """with_neighbours(x, lines) @ w without the wide matrix: each line's share of its own score, and of its neighbours'."""
    ends = np.cumsum(lines)
    own, to_next, to_previous = x @ w[:OWN], x @ w[OWN : 2 * OWN], x @ w[2 * OWN : 3 * OWN]
    score = own + w[-1]
    to_next[ends - 1], to_previous[ends - lines] = 0, 0  # not into another text
    score[1:] += to_next[:-1]
    score[:-1] += to_previous[1:]
    return score


def blocks_of(lines: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first line, lines, place in its text) of the blocks of up to ``most`` lines that the texts are cut into."""
    count = -(-lines // most)
    text = np.repeat(np.arange(len(lines)), count)
    place = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    first = (np.cumsum(lines) - lines)[text] + place * most
    return first, np.minimum(most, lines[text] - place * most), place


def forward_backward(score: np.ndarray, lines: np.ndarray, moves: np.ndarray, label: np.ndarray | None = None, most: int = 512):
    """Marginal P(good) of each line. score: log potential of good against bad.

    With label (a line's, as 0 or 1) also the expected and the observed moves, summed (2 x 2 each).

    Texts are cut into blocks of up to ``most`` lines. All blocks are passed at once, line by line, for each label that a
    block's message may start from; the blocks of a text then hand their messages on, all texts at once. So the number of
    steps is that of a block's lines and of a text's blocks, not that of a text's lines.
    """
    first, size, place = blocks_of(lines, most)
    n, nb = len(score), len(first)
    order = np.argsort(-size, kind="stable")
    first, size, place = first[order], size[order], place[order]
    steps = int(size[0]) if nb else 0
    active = np.searchsorted(-size, -np.arange(steps), side="left")  # blocks with more than t lines
    begins = place == 0
    last = first + size - 1
    goes_on = np.zeros(nb, bool)
    ends = np.zeros(n + 1, bool)
    ends[np.cumsum(lines) - 1] = True
    goes_on = ~ends[last]

    def step(message: np.ndarray, s: np.ndarray) -> np.ndarray:
        """Over a line with potential s: log-sum over the label before; message: ... x 2."""
        out = np.logaddexp(message[..., 0, None] + moves[0], message[..., 1, None] + moves[1])
        out[..., 1] += s[..., None] if out.ndim == 3 else s
        return out

    def back(message: np.ndarray, s: np.ndarray) -> np.ndarray:
        """The message into the line before one with potential s, whose own message from behind is given."""
        m = message.copy()
        m[..., 1] += s[..., None] if m.ndim == 3 else s
        return np.stack([np.logaddexp(moves[i, 0] + m[..., 0], moves[i, 1] + m[..., 1]) for i in (0, 1)], axis=-1)

    # fwd[line, label before the block or its own start, label]; a text's first line has no line before
    unit = np.array([[0.0, -np.inf], [-np.inf, 0.0]])
    fwd = np.zeros((n, 2, 2))
    for t in range(steps):
        at = first[: active[t]] + t
        if t == 0:
            with np.errstate(invalid="ignore"):
                now = step(np.broadcast_to(unit, (len(at), 2, 2)), score[at])
            fresh = np.stack([np.zeros(len(at)), score[at]], axis=-1)
            now[begins[: active[t]]] = fresh[begins[: active[t]], None, :]
        else:
            now = step(fwd[at - 1], score[at])
        fwd[at] = now
    # what each block begins with: the message of the line before it
    by_place = np.argsort(place, kind="stable")
    many = int(place.max()) + 1 if nb else 0
    bounds = np.searchsorted(place[by_place], np.arange(many + 1))
    f = np.zeros((n, 2))
    for k in range(many):
        b = by_place[bounds[k] : bounds[k + 1]]
        start = np.zeros((len(b), 2)) if k == 0 else f[first[b] - 1]
        if k == 0:
            start[:, 1] = -np.inf  # any one label: a first block's messages don't depend on it
        spread = np.repeat(np.arange(len(b)), size[b])
        at = np.repeat(first[b], size[b]) + np.arange(len(spread)) - np.repeat(np.cumsum(size[b]) - size[b], size[b])
        m = np.logaddexp(start[spread, 0, None] + fwd[at, 0], start[spread, 1, None] + fwd[at, 1])
        f[at] = m - m.max(axis=1, keepdims=True)
    del fwd
    bwd = np.zeros((n, 2, 2))  # bwd[line, label, label after the block]
    for t in range(steps - 1, -1, -1):
        at = first[: active[t]] + t
        inner = size[: active[t]] > t + 1
        edge = at[~inner]
        bwd[edge] = unit
        if inner.any():
            nxt = at[inner] + 1
            bwd[at[inner]] = np.swapaxes(back(np.swapaxes(bwd[nxt], 1, 2), score[nxt]), 1, 2)
    g = np.zeros((n, 2))  # message from behind into each line
    for k in range(many - 1, -1, -1):
        b = by_place[bounds[k] : bounds[k + 1]]
        more = goes_on[b]
        after = np.zeros((len(b), 2))
        if more.any():
            nxt = last[b[more]] + 1
            after[more] = back(g[nxt], score[nxt])
        spread = np.repeat(np.arange(len(b)), size[b])
        at = np.repeat(first[b], size[b]) + np.arange(len(spread)) - np.repeat(np.cumsum(size[b]) - size[b], size[b])
        m = np.logaddexp(bwd[at, :, 0] + after[spread, 0, None], bwd[at, :, 1] + after[spread, 1, None])
        g[at] = m - m.max(axis=1, keepdims=True)
    del bwd
    m = f + g
    p = 1 / (1 + np.exp(np.clip(m[:, 0] - m[:, 1], -50, 50)))
    if label is None:
        return p
    at = np.flatnonzero(~ends[:n])  # lines that another line of their text follows
    out = g[at + 1].copy()
    out[:, 1] += score[at + 1]
    joint = f[at][:, :, None] + moves[None] + out[:, None, :]
    e = np.exp(joint - joint.max(axis=(1, 2), keepdims=True))
    expected = (e / e.sum(axis=(1, 2), keepdims=True)).sum(axis=0) if len(at) else np.zeros((2, 2))
    observed = np.zeros((2, 2))
    np.add.at(observed, (label[at], label[at + 1]), 1)
    return p, expected, observed


def train(texts: list[str], y: list[int], *, steps: int = 150, ridge: float = 1e-3, rate: float = 0.1) -> QualityModel:
    """Weights by Adam on the mean negative conditional log-likelihood."""
    if not texts:
        return QualityModel(np.zeros(FEATURES), np.zeros((2, 2)), np.zeros(OWN), np.ones(OWN))
    x, _, lines = all_features(texts)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    X = with_neighbours((x - mean) / scale, lines)
    label = np.repeat(np.asarray(y, int), lines)
    w, moves = np.zeros(FEATURES), np.zeros((2, 2))
    state = [np.zeros(FEATURES + 4), np.zeros(FEATURES + 4)]
    for i in range(1, steps + 1):
        p, expected, observed = forward_backward(X @ w, lines, moves, label)
        g = np.concatenate([X.T @ (p - label), (expected - observed).ravel()]) / len(label) + ridge * np.concatenate([w, moves.ravel()])
        state[0] = 0.9 * state[0] + 0.1 * g
        state[1] = 0.99 * state[1] + 0.01 * g * g
        step = rate * (state[0] / (1 - 0.9**i)) / (np.sqrt(state[1] / (1 - 0.99**i)) + 1e-8)
        w, moves = w - step[:FEATURES], moves - step[FEATURES:].reshape(2, 2)
    return QualityModel(w, moves, mean, scale)


def qualities(texts: list[str], model: QualityModel) -> np.ndarray:
    """Length-weighted mean of the lines' marginals, for each text."""
    if not texts:
        return np.zeros(0)
    x, length, lines = all_features(texts)
    p = forward_backward(potentials((x - model.mean) / model.scale, lines, model.weights), lines, model.moves)
    text = np.repeat(np.arange(len(lines)), lines)
    weight = length + 1
    return np.bincount(text, p * weight, len(lines)) / np.bincount(text, weight, len(lines))


def fit(docs: DataFrame, labels: DataFrame, *, max_rows: int = 4_000, **training) -> QualityModel:
    """The model from about ``max_rows`` labelled rows that aren't held out.

    Training runs in one task on the executors, on line features only, and sends back a few weights.
    """
    sample = durable(training_rows(docs, labels, "quality", max_rows))

    def learn(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        texts, y = [], []
        for pdf in parts:
            texts += list(pdf["text"])
            y += [int(v) for v in pdf["y"]]
        m = train(texts, y, **training)
        yield pd.DataFrame({"weights": [m.weights], "moves": [m.moves.ravel()], "mean": [m.mean], "scale": [m.scale]})

    row = sample.coalesce(1).mapInPandas(learn, "weights array<double>, moves array<double>, mean array<double>, scale array<double>").first()
    return QualityModel(np.array(row["weights"]), np.array(row["moves"]).reshape(2, 2), np.array(row["mean"]), np.array(row["scale"]))


def score_column(text: Column, model: QualityModel) -> Column:
    @F.pandas_udf("double")
    def scored(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            out, some, size = [], [], 0
            for t in texts:
                some.append(t or "")
                size += len(some[-1])
                if size >= CHUNK:
                    out.append(qualities(some, model))
                    some, size = [], 0
            out.append(qualities(some, model))
            yield pd.Series(np.concatenate(out))

    return scored(text)


def quality(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.5, **fitting) -> DataFrame:
    """doc_id, held_out, score, predicted: one row for each row of ``docs``.

    Null text counts as empty, and an empty text as one empty line. Repeated rows are scored alike.
    A null doc_id counts as held out. Without labels every score is 0.5. Extra columns are ignored.
    """
    model = fit(docs, labels, **fitting)
    scored = docs.select("doc_id", "text").select("doc_id", held_out().alias("held_out"), score_column(F.coalesce("text", F.lit("")), model).alias("score"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.5, fit_on: DataFrame | None = None, **fitting) -> DataFrame:
    """The rows of ``docs`` that the classifier doesn't reject, with their columns as they were, whatever their names.

    fit_on: rows to fit on, docs if none. Null text counts as empty; repeated rows stay or go together; an empty table stays empty.
    """
    model = fit(docs if fit_on is None else fit_on, labels, **fitting)
    # the whole row as one column: its names can't meet that of the score
    scored = docs.select(F.struct("*").alias("row"), score_column(F.coalesce("text", F.lit("")), model).alias("score"))
    return scored.where(F.col("score") >= threshold).select("row.*")
