"""Toxicity with noisy-channel deobfuscation.

A character trigram model is counted over the whole corpus. What looks disguised becomes a lattice:
each character may stand for itself, for the letters that it imitates, or for nothing; a letter that
repeats may be drawn out or doubled; and between the pieces of spaced words there may be a break or
none. Viterbi decoding under the model restores the likeliest words. Restored words, and beginnings of
words that come twice in a text, are scored by odds learnt from labelled rows, and a logistic
regression over a text's worst ones gives its score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonelake.llm.common import kept, slices, small_batches
from tonelake.llm.quality import sampled

#: At most about so many labelled rows are fitted on.
SAMPLE_ROWS = 20_000
#: Toxic texts that a feature must stand in (a number, and a part of them, as copies of one text share
#: all their words), the least log odds it must have for sure, and the part of them that may be clean
#: texts beyond one, as some labels are wrong.
MIN_TEXTS, MIN_PART, MIN_ODDS, MAX_CLEAN = 4, 0.004, 1.8, 0.05
#: Words whose scores one worker keeps before it starts anew, and the longest of them.
CACHE_WORDS, CACHE_LENGTH = 400_000, 64
#: Characters of text that a worker counts at once, and distinct trigrams that it holds before it sends them.
SLICE, HELD_TRIGRAMS = 1 << 20, 1 << 20

# Letters that signs and digits imitate.
IMITATES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¥": "y", "*": "aeiou", "#": "h", "<": "c", "¡": "i",
}
#: Natural logarithms of the channel: a sign imitates a letter, a sign stands for nothing, a letter is
#: drawn out or doubled, a gap between pieces of a word is no break.
IMITATED, IGNORED, REPEATED, DOUBLED, SPACED = -1.0, -2.5, -0.5, -2.0, -0.7
EDGE = re.compile(r"^[^\w$@]+|[^\w$@]+$|^_+|_+$")
RUN = re.compile(r"(.)\1\1+")
TWICE = re.compile(r"([^\W\d_])\1+")
#: Rows of three or more single letters, and rows of pieces of one or two letters.
SINGLES, PIECES = re.compile("1{3,}"), re.compile("[12]{3,}")
PLAIN = str.maketrans({k: v[0] for k, v in IMITATES.items() if k != "*"})


def letters(text: str) -> np.ndarray:
    """The text's code points in lower case, with every other character than a letter as 0."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    small = np.minimum(codes, len(LETTER) - 1)
    return np.where((codes >= len(LETTER)) | LETTER[small], codes, 0)


LETTER = np.array([chr(c).isalpha() for c in range(0x600)])


def packed(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """A trigram of code points as one number; trigrams of a pair stand together in their order."""
    return a.astype(np.int64) << 42 | b.astype(np.int64) << 21 | c.astype(np.int64)


def trigrams(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct trigrams of some code points, and how often each stands there."""
    present = np.flatnonzero(np.bincount(codes))
    n = len(present)
    place = np.zeros(int(codes.max(initial=0)) + 1, dtype=np.int64)
    place[present] = np.arange(n)
    at = place[codes]
    a, b, c = at[:-2], at[1:-1], at[2:]
    a = np.where(codes[1:-1] == 0, place[0], a)  # a word's start has no past
    if n**3 > 1 << 22:
        return np.unique(packed(present[a], present[b], present[c]), return_counts=True)
    counts = np.bincount((a * n + b) * n + c, minlength=1)
    at = np.flatnonzero(counts)
    return packed(present[at // (n * n)], present[at // n % n], present[at % n]), counts[at]


class CharModel:
    """Trigram counts: ``keys`` in order and ``counts``. It holds every trigram of the corpus, 16 bytes each,
    so it grows with the corpus' letters and not with its texts."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, alphabet: int = 64):
        self.keys, self.counts, self.alphabet = keys, counts, alphabet
        self.known: dict[tuple[int, int, int], float] = {}

    def log_p(self, a: int, b: int, c: int) -> float:
        key = (a, b, c)
        got = self.known.get(key)
        if got is None:
            pair = a << 42 | b << 21
            low, at, high = np.searchsorted(self.keys, [pair, pair | c, pair + (1 << 21)])
            n = self.counts[at] if at < len(self.keys) and self.keys[at] == pair | c else 0
            got = math.log(n + 0.05) - math.log(float(self.counts[low:high].sum()) + 0.05 * self.alphabet)
            if len(self.known) > 500_000:
                self.known.clear()
            self.known[key] = got
        return got

    def restore(self, word: str, *, doubled: bool = False) -> str:
        """The likeliest letters behind a disguised word, by Viterbi over its lattice. Spaces in it are gaps,
        which may be breaks or not. With ``doubled``, each but the first of equal letters may be dropped."""
        states: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
        # of three or more equal letters each but the first may be drawn out
        drawn = {i: REPEATED for m in RUN.finditer(word) for i in range(m.start() + 1, m.end())}
        if doubled:
            drawn = {i: DOUBLED for m in TWICE.finditer(word) for i in range(m.start() + 1, m.end())} | drawn
        for i, ch in enumerate(word):
            if ch == " ":
                options = [(" ", 0.0), ("", SPACED)]
            elif ch.isalpha():
                options = [(ch, 0.0)]
            else:
                options = [(x, IMITATED) for x in IMITATES.get(ch, "")] + [("", IGNORED)]
            if i in drawn:
                options.append(("", drawn[i]))
            new: dict[tuple[int, int], tuple[float, tuple]] = {}
            for (a, b), (score, path) in states.items():
                for out, cost in options:
                    if out == " ":
                        to, at, way = (0, 0), score + cost + self.log_p(a, b, 0), (path, out)
                    elif out:
                        c = ord(out)
                        to, at, way = (b, c), score + cost + self.log_p(a, b, c), (path, out)
                    else:
                        to, at, way = (a, b), score + cost, path
                    if to not in new or at > new[to][0]:
                        new[to] = (at, way)
            states = new
        best = max(((score + self.log_p(a, b, 0), path) for (a, b), (score, path) in states.items()), key=lambda x: x[0])[1]
        out = []
        while best:
            best, ch = best
            out.append(ch)
        return "".join(reversed(out))

    def forms(self, word: str) -> tuple[str, ...]:
        """What a word of lower case may say: its letters as they stand, and as restored if it looks disguised."""
        if " " in word:
            return tuple(dict.fromkeys(self.restore(word).split()))
        core = EDGE.sub("", word)
        if core.isalpha():
            return (core, self.restore(core)) if RUN.search(core) else (core,)
        plain = core.strip("0123456789$@_")
        found = []
        if plain.isalpha():
            found.append(plain)
        else:
            found += [x for x in re.findall(r"[^\W\d_]{3,}", core)]
        if any(c.isalpha() for c in core):
            found.append(self.restore(core))
        return tuple(dict.fromkeys(found))


def piece(w: str) -> str:
    """How many letters a short word has, 3 standing for more; a sign behind them does not count."""
    return str(len(w) - (1 < len(w) and not w[-1].isalnum()))


def texts_words(text: str) -> tuple[list[str], list[str]]:
    """The words of a text in lower case, and its rows of three or more pieces of one letter (joined by
    spaces) behind them; and its rows that hold pieces of two letters as well."""
    words = text.lower().split()
    rows: list[str] = []
    sizes = "".join(["3" if len(w) > 3 else piece(w) for w in words])
    if PIECES.search(sizes):
        pieces = [words[m.start() : m.end()] for m in SINGLES.finditer(sizes)]
        rows = [" ".join(words[m.start() : m.end()]) for m in PIECES.finditer(sizes) if "2" in m[0]]
        words += [" ".join(p) for p in pieces]
    return words, rows


def features(form: str) -> list[str]:
    """The word itself and its beginnings."""
    return [f"={form}", *[form[:n] for n in range(4, min(8, len(form)) + 1)]] if len(form) >= 3 else []


def text_features(text: str, model: CharModel) -> set[str]:
    """The features of a text's words, and behind a ``#`` those of two words or more."""
    found: Counter[str] = Counter()
    for word, n in Counter(texts_words(text)[0]).items():
        for f in {f for form in model.forms(word) for f in features(form)}:
            found[f] += n
    return {*found, *[f"#{f}" for f, n in found.items() if n > 1 and f[0] != "="]}


@dataclass
class Toxic:
    """What scoring needs: the odds of features, weights of the regression, and the character model."""

    odds: dict[str, float]
    weights: tuple[float, ...]
    model: CharModel

    def __post_init__(self) -> None:
        self.cache: dict[str, tuple[float, str, tuple[str, ...]]] = {}
        whole = [f[1:] for f in self.odds if f[0] == "="]
        self.single = {TWICE.sub(r"\1", w) for w in whole}
        self.inside = re.compile("|".join(sorted(map(re.escape, {TWICE.sub(r"\1", w) for w in whole if len(w) > 3}))) or r"(?!)")

    def word(self, word: str) -> tuple[float, str, tuple[str, ...]]:
        """The highest odds among what a word may say, that form, and its beginnings that count if they come twice."""
        got = self.cache.get(word)
        if got is None:
            got = self._best(self.model.forms(word))
            core = EDGE.sub("", word)
            if not got[0] and TWICE.search(core) and TWICE.sub(r"\1", core.translate(PLAIN)) in self.single:
                got = self._best((self.model.restore(core, doubled=True),))
            if len(word) <= CACHE_LENGTH:
                if len(self.cache) > CACHE_WORDS:
                    self.cache.clear()
                self.cache[word] = got
        return got

    def _best(self, forms: tuple[str, ...]) -> tuple[float, str, tuple[str, ...]]:
        top, best, twice = 0.0, "", []
        for form in forms:
            for f in features(form):
                if self.odds.get(f, 0.0) > top:
                    top, best = self.odds[f], form
                if f"#{f}" in self.odds:
                    twice.append(f"#{f}")
        return top, best, tuple(dict.fromkeys(twice))

    def text(self, text: str | None) -> tuple[list[float], list[str]]:
        """The regression's inputs, and the restored words that speak against the text."""
        bad: dict[str, float] = {}
        stems: Counter[str] = Counter()
        n = 0
        words, rows = texts_words(text) if text else ((), ())
        # spaced words are decoded where their letters could hold a word of those that are known
        for row in rows:
            if self.inside.search(TWICE.sub(r"\1", re.sub(r"[^\w$@!|+*]", "", row).translate(PLAIN))):
                words.append(row)
        for w in words:
            top, form, twice = self.cache.get(w) or self.word(w)
            if top:
                n += 1
                bad[form] = top
            if twice:
                stems.update(twice)
        for f, count in stems.items():
            if count > 1:
                bad[f] = self.odds[f]
        top = sorted(bad.values(), reverse=True)[:2] + [0.0, 0.0]
        return [1.0, min(top[0], 8.0), min(top[1], 8.0), math.log1p(n + sum(c > 1 for c in stems.values()))], sorted(w for w in bad if w[0] != "#")

    def score(self, x: list[float]) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(w * v for w, v in zip(self.weights, x, strict=True))))))


def fit_characters(docs: DataFrame, text: str = "text") -> CharModel:
    """Count the trigrams of all texts: each task adds up its own, Spark sums them by trigram."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def summed() -> tuple[np.ndarray, np.ndarray]:
            keys, at = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            return keys, np.bincount(at, weights=np.concatenate([n for _, n in held]).astype(float), minlength=len(keys)).astype(np.int64)

        for b in batches:
            texts = [t for t in b.column(0).to_pylist() if t]
            for i, j in slices([len(t) for t in texts], SLICE):
                codes = letters("  " + "  ".join(texts[i:j]) + "  ")
                # what stands between words counts once
                codes = np.concatenate([np.zeros(2, np.uint32), codes[(codes != 0) | (np.r_[1, codes[:-1]] != 0)], np.zeros(2, np.uint32)])
                held.append(trigrams(codes))
            if len(held) > 64 or sum(len(k) for k, _ in held) > HELD_TRIGRAMS:
                held = [summed()]
                if len(held[0][0]) > HELD_TRIGRAMS:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in held.pop()], names=["key", "n"])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in summed()], names=["key", "n"])

    got = docs.select(docs[text]).mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toPandas().sort_values("key")
    return CharModel(got["key"].to_numpy(dtype=np.int64), got["n"].to_numpy(dtype=np.int64))


def fit_toxicity(docs: DataFrame, labels: DataFrame, held: Column, *, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Toxic:
    """Fit on labelled rows for which ``held`` (over ``labels``) is false, a sample with a bound; the
    character model is counted over all of ``docs``. Without toxic rows every score is low."""
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    model = fit_characters(docs, text)
    sample = sampled(labels, key, label, held, SAMPLE_ROWS)
    rows = docs.select(docs[key].alias("k"), docs[text].alias("t")).join(F.broadcast(sample), "k").select(F.coalesce("t", F.lit("")).alias("t"), F.col("y").cast("int").alias("y"))
    rows = kept(rows)  # the sample is read four times, the corpus for it once
    shared = spark.sparkContext.broadcast(model)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, Counter[str]] = {0: Counter(), 1: Counter()}
        for b in batches:
            for t, y in zip(*[c.to_pylist() for c in b.columns], strict=True):
                found[int(y > 0)].update(text_features(t, shared.value))
        for y, counts in found.items():
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64()), pa.array([y] * len(counts), pa.int32())], names=["f", "n", "y"])

    n = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    toxic, clean = n.get(1, 0), n.get(0, 0)
    of = lambda y: F.sum(F.when(F.col("y") == y, F.col("n")).otherwise(0))
    counted = rows.mapInArrow(tally, "f string, n long, y int").groupBy("f").agg(of(1).alias("pos"), of(0).alias("neg"))
    pos, neg = F.col("pos"), F.col("neg")
    sure = F.log((pos + 0.5) / (toxic + 1)) - F.log((neg + 1) / (clean + 2)) - 2 * F.sqrt(1 / (pos + 0.5) + 1 / (neg + 1))
    # a feature that stands in clean texts as well is common speech
    often = counted.filter((pos >= max(MIN_TEXTS, math.ceil(MIN_PART * toxic))) & (neg <= MAX_CLEAN * pos + 1)).withColumn("sure", sure)
    odds = {r["f"]: round(r["sure"], 4) for r in often.filter(F.col("sure") > MIN_ODDS).orderBy("f").collect()}
    fitted = Toxic(odds, (0.0,) * 4, model)
    sent = spark.sparkContext.broadcast(fitted)

    def inputs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [sent.value.text(t)[0] for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([v[i] for v in x], pa.float64()) for i in range(4)] + [b.column(1)], names=["a", "b", "c", "d", "y"])

    got = rows.mapInArrow(inputs, "a double, b double, c double, d double, y int").toPandas()
    got = got.sort_values(list(got.columns), ignore_index=True)
    rows.unpersist()
    fitted.weights = logistic(got[["a", "b", "c", "d"]].to_numpy(dtype=float), got["y"].to_numpy(dtype=float))
    return fitted


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[float, ...]:
    """Ridge logistic regression by Newton's method, drawn to a low constant score where there are few rows."""
    prior = np.zeros(x.shape[1])
    prior[0] = -2.0
    w = prior
    if len(y):
        for _ in range(40):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(x.shape[1])
            w = w - np.clip(np.linalg.solve(h, x.T @ (p - y) + ridge * (w - prior)), -4, 4)
    return tuple(float(v) for v in w)


def score_toxicity(docs: DataFrame, fitted: Toxic, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns ``key``, ``score`` (0 to 1) and ``words``, the restored words that speak against the text.

    Null and empty texts have no words and score as texts without bad ones; equal texts score equally.
    """
    small_batches(docs.sparkSession)
    kind = next(f.dataType.simpleString() for f in docs.schema if f.name == key)
    shared = docs.sparkSession.sparkContext.broadcast(fitted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic = shared.value
        for b in batches:
            got = [toxic.text(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([toxic.score(x) for x, _ in got], pa.float64()), pa.array([w for _, w in got], pa.list_(pa.string()))], names=[key, "score", "words"]
            )

    return docs.select(docs[key], docs[text]).mapInArrow(run, f"`{key}` {kind}, score double, words array<string>")


def drop_toxic(docs: DataFrame, fitted: Toxic, threshold: float = 0.3, *, text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores below ``threshold``."""
    small_batches(docs.sparkSession)
    at = docs.columns.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(fitted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic = shared.value
        for b in batches:
            yield b.filter(pa.array([toxic.score(toxic.text(t)[0]) < threshold for t in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
