"""Vectorised hashing of the words of many texts.

Words are maximal runs of bytes outside 0x09-0x0D and 0x20. A word's hash is the sum of random
numbers, one for each pair of a byte and its place in the word, and the hash of ``n`` consecutive
words mixes those of its halves. Neither is a polynomial modulo 2**64, for which regular texts are
known that always collide.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
STEP = U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the splitmix64 finaliser)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * STEP)
LEFT = U(0xD6E8FEB86659FD93)


def joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix(left * LEFT + right)


def of_runs(items: np.ndarray, n: int) -> np.ndarray:
    """Hashes of each ``n`` consecutive items, by doubling."""
    out, done, power, width = None, 0, items, 1
    while True:
        if n & width:
            out = power if out is None else joined(out[: max(0, len(power) - done)], power[done:])
            done += width
        if done == n:
            return out[: max(0, len(items) - n + 1)]
        power = joined(power[: max(0, len(power) - width)], power[width:])
        width *= 2


class Words:
    """The words of a list of texts: ``doc`` (index of the text), ``hash``; ``first`` and ``count`` by text."""

    def __init__(self, raw: list[bytes], *, lower: bool = False):
        buf = np.frombuffer(b" " + b" ".join(raw) + b" ", dtype=np.uint8)
        space = SPACE[buf]
        edge = space[1:] != space[:-1]
        at = np.flatnonzero(edge) + 1
        starts, ends = at[::2], at[1::2]
        letters = buf[~space]
        if lower:
            letters = LOWER[letters]
        size = ends - starts
        begin = np.cumsum(size) - size
        place = (np.arange(len(letters)) - np.repeat(begin, size)).astype(np.uint64)
        values = mix(BYTE_VALUES[letters] + place * STEP)
        self.hash = mix(np.add.reduceat(values, begin) + size.astype(np.uint64)) if len(starts) else np.zeros(0, dtype=np.uint64)
        begins = 1 + np.cumsum([0, *[len(r) + 1 for r in raw]])
        self.first = np.searchsorted(starts, begins[:-1])
        self.count = np.searchsorted(starts, begins[1:]) - self.first
        self.doc = np.repeat(np.arange(len(raw)), self.count)

    def __len__(self) -> int:
        return len(self.hash)


def word_ids(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The words of all texts as numbers, the same only for equal words, and each text's count of words."""
    known: dict[bytes, int] = {}
    ids: list[int] = []
    count = np.zeros(len(raw), dtype=np.int64)
    for i, r in enumerate(raw):
        words = r.split()
        count[i] = len(words)
        ids += [known.setdefault(w, len(known)) for w in words]
    return np.array(ids, dtype=np.int64), count


def numbered(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Numbers from 0 that order the pairs, the same only for equal ones. The parts are below 2**31."""
    return np.unique(left * (int(right.max(initial=0)) + 1) + right, return_inverse=True)[1]


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values."""
    out, done = values, 1
    while done * 2 <= width:
        out = np.minimum(out[:-done], out[done:]) if len(out) > done else out[:0]
        done *= 2
    step = width - done
    return np.minimum(out[:-step], out[step:]) if step and len(out) > step else (out[:0] if step else out)


def utf8(texts: list[str | None]) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in texts]
