"""Quality classifier: a sparse ensemble of rules over text statistics.

Boosted trees of small depth are grown on a bounded sample of labelled rows; the paths to their nodes
become conjunctive rules; a logistic regression with an L1 penalty keeps few of them; and these are
compiled into one Spark column expression over statistics that are Spark columns themselves, so that
scoring a corpus is one scan without Python.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: At most about so many labelled rows are fitted on, picked by a hash of their key.
SAMPLE_ROWS = 20_000
TREES, DEPTH, BINS, RATE = 48, 3, 64, 0.3
#: Weight of the L1 penalty and steps of the proximal gradient descent.
PENALTY, STEPS = 1e-3, 800
Condition = tuple[str, bool, float]


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a text by name, as doubles; a null text counts as empty, and ratios of nothing are
    0. What stands before white space at the start, or behind it at the end, counts as a word."""
    body = F.coalesce(text, F.lit(""))
    chars = F.length(body).cast("double")
    words, lines = F.split(body, r"[\x20\x09-\x0D]+"), F.split(body, "\n+")
    without = lambda pattern: chars - F.length(F.regexp_replace(body, pattern, ""))
    of = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    n_words, n_lines = F.size(words).cast("double"), F.size(lines).cast("double")
    count = lambda pattern: F.regexp_count(body, F.lit(pattern)).cast("double")
    return {
        "chars": chars,
        "word_length": of(chars, n_words),
        "line_words": of(n_words, n_lines),
        "distinct_words": of(F.size(F.array_distinct(words)).cast("double"), n_words),
        "distinct_lines": of(F.size(F.array_distinct(lines)).cast("double"), n_lines),
        "upper": of(count(r"\p{Lu}"), chars),
        "letters": of(without(r"\p{L}+"), chars),
        "stops": of(count("[.,;:?]"), chars),
        "marks": of(count("!"), chars),
        "bars": of(count(r"[|<>{}\[\]/\\_=~^]"), chars),
        "signs": of(count("[#$%&*@+]"), chars),
        "digits": of(count("[0-9]"), chars),
    }


@dataclass(frozen=True)
class Rules:
    """Conjunctions of (statistic, above, threshold) with their weights."""

    bias: float
    rules: tuple[tuple[tuple[Condition, ...], float], ...]

    def column(self, stats: dict[str, Column]) -> Column:
        total = F.lit(self.bias)
        for conditions, weight in self.rules:
            met = F.lit(True)
            for name, above, threshold in conditions:
                met = met & ((stats[name] > threshold) if above else (stats[name] <= threshold))
            total = total + F.when(met, F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def score(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        total = np.full(len(x), self.bias)
        for conditions, weight in self.rules:
            total += weight * met(x, names, conditions)
        return 1 / (1 + np.exp(-total))


def met(x: np.ndarray, names: list[str], conditions: tuple[Condition, ...]) -> np.ndarray:
    out = np.ones(len(x), bool)
    for name, above, threshold in conditions:
        v = x[:, names.index(name)]
        out &= (v > threshold) if above else (v <= threshold)
    return out


def grow(x: np.ndarray, edges: list[np.ndarray], codes: np.ndarray, gradient: np.ndarray, curve: np.ndarray, names: list[str], path: tuple[Condition, ...], rows: np.ndarray, out: list[tuple[Condition, ...]], values: np.ndarray) -> None:
    """Grow one tree from ``rows``; adds the paths of its nodes to ``out`` and its leaves' steps to ``values``."""
    g, h = gradient[rows], curve[rows]
    best, found = 1e-6, None
    if len(path) < DEPTH and len(rows) >= 20:
        whole = g.sum() ** 2 / (h.sum() + 1)
        for f in range(x.shape[1]):
            gs, hs, ns = (np.bincount(codes[rows, f], weights=w, minlength=BINS + 1).cumsum()[:-1] for w in (g, h, np.ones(len(rows))))
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = gs**2 / (hs + 1) + (g.sum() - gs) ** 2 / (h.sum() - hs + 1) - whole
            gain[(ns < 5) | (ns > len(rows) - 5)] = 0
            gain = gain[: len(edges[f])]
            if len(gain) and gain.max() > best:
                best, found = gain.max(), (f, int(gain.argmax()))
    if found is None:
        values[rows] = -g.sum() / (h.sum() + 1)
        return
    f, i = found
    for above in (False, True):
        side = rows[(codes[rows, f] > i) == above]
        here = (*path, (names[f], above, float(edges[f][i])))
        out.append(here)
        grow(x, edges, codes, gradient, curve, names, here, side, out, values)


def fit_rules(x: np.ndarray, y: np.ndarray, names: list[str]) -> Rules:
    """Rules from trees, weighted by lasso logistic regression. With one label only, its share is the score."""
    share = (y.sum() + 1) / (len(y) + 2)
    bias = float(np.log(share / (1 - share)))
    if len(np.unique(y)) < 2:
        return Rules(bias, ())
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    codes = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    margin, paths = np.full(len(y), bias), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        values = np.zeros(len(y))
        grow(x, edges, codes, p - y, p * (1 - p), names, (), np.arange(len(y)), paths, values)
        margin += RATE * values
    unique = list(dict.fromkeys(tuple(sorted(set(p))) for p in paths))
    z = np.stack([met(x, names, p) for p in unique], axis=1).astype(np.float32)
    _, kept = np.unique(z, axis=1, return_index=True)
    kept = np.sort(kept)
    z, unique = z[:, kept], [unique[i] for i in kept]
    weights, b = lasso(z, y.astype(np.float32), bias)
    return Rules(b, tuple((p, round(float(w), 6)) for p, w in zip(unique, weights, strict=True) if w))


def lasso(z: np.ndarray, y: np.ndarray, bias: float) -> tuple[np.ndarray, float]:
    """L1-penalised logistic regression by accelerated proximal gradient descent."""
    # rows that meet the same rules count together
    _, first, pattern = np.unique(np.packbits(z.astype(bool), axis=1), axis=0, return_index=True, return_inverse=True)
    n, z = len(y), z[first]
    rows = np.bincount(pattern.ravel(), minlength=len(first)).astype(np.float32)
    positive = np.bincount(pattern.ravel(), weights=y, minlength=len(first)).astype(np.float32)
    step = 4 * n / (np.linalg.norm((z * rows[:, None]).T @ z, 2) + n)
    w = momentum = np.zeros(z.shape[1], dtype=np.float32)
    b = slow = np.float32(bias)
    t = 1.0
    for _ in range(STEPS):
        r = rows / (1 + np.exp(-(z @ momentum + slow))) - positive
        moved = momentum - step * (z.T @ r) / n
        new = np.sign(moved) * np.maximum(np.abs(moved) - step * PENALTY, 0)
        new_b = slow - step * r.sum() / n
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        momentum, slow = new + (t - 1) / t_new * (new - w), new_b + (t - 1) / t_new * (new_b - b)
        still = float(np.abs(new - w).max(initial=0)) < 1e-6 and abs(float(new_b - b)) < 1e-6
        w, b, t = new, new_b, t_new
        if still:
            break
    return w, float(b)


def sampled(labels: DataFrame, key: str, label: str, held: Column, most: int = SAMPLE_ROWS) -> DataFrame:
    """At most about ``most`` labelled rows that aren't held out, by a hash of their key: all of them if they are fewer."""
    seen = labels.filter(~held & labels[key].isNotNull() & labels[label].isNotNull()).groupBy(labels[key].alias("k")).agg(F.max(label).alias("y"))
    n = seen.count()
    return seen.filter(F.pmod(F.xxhash64("k", F.lit(7)), F.lit(1 << 30)) < F.lit(min(1 << 30, (most << 30) // max(1, n))))


def fit_quality(docs: DataFrame, labels: DataFrame, held: Column, *, key: str = "doc_id", text: str = "text", label: str = "quality") -> Rules:
    """Fit on labelled rows for which ``held`` (over ``labels``) is false. The sample has a bound, so it is broadcast."""
    sample = sampled(labels, key, label, held)
    rows = docs.select(docs[key].alias("k"), docs[text].alias("t")).join(F.broadcast(sample), "k")
    stats = statistics(F.col("t"))
    got = rows.select(F.col("k"), F.col("y").cast("double").alias("y"), *[v.alias(n) for n, v in stats.items()]).toPandas()
    got = got.sort_values(list(got.columns), ignore_index=True)
    return fit_rules(got[list(stats)].to_numpy(dtype=float).reshape(len(got), len(stats)), got["y"].to_numpy(dtype=float), list(stats))


def score_quality(docs: DataFrame, rules: Rules, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns ``key`` and ``score`` (0 to 1) for each row; a null text is scored as the empty one, equal
    rows score equally, and other columns take no part."""
    stats = statistics(docs[text])
    named = docs.select(docs[key].alias("k"), *[v.alias(n) for n, v in stats.items()])
    return named.select(F.col("k").alias(key), rules.column({n: F.col(n) for n in stats}).alias("score"))
