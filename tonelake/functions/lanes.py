"""The codec's range coder and pulse vectors over whole columns: every packet of an Arrow batch is a lane, and all lanes take
each step together (RFC 6716, sections 4.1, 5.1 and 4.3.4.2). ``coder`` has the same for one packet."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tonelake.functions.coder import BOTTOM, CODE_BITS, SYMBOL_BITS, TOP

#: Error code of symbols that don't fit in the asked size, and of values outside the coder's range.
TOO_SMALL, BAD = -2, -1
SHIFT = CODE_BITS - SYMBOL_BITS - 1


class Decoders:
    """Range decoders, one for each payload; zeros stand behind a payload's end."""

    def __init__(self, payloads: list[bytes]):
        n = len(payloads)
        self.size = np.array([len(p) for p in payloads], np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(payloads) + b"\0", np.uint8).astype(np.int64)
        self.at = np.zeros(n, np.int64)
        self.rest = self._bytes(np.arange(n))
        self.value, self.range = 127 - (self.rest >> 1), np.full(n, 128, np.int64)
        self._fill()

    def _bytes(self, lanes: np.ndarray) -> np.ndarray:
        inside = self.at[lanes] < self.size[lanes]
        out = np.where(inside, self.data[np.where(inside, self.begin[lanes] + self.at[lanes], -1)], 0)
        self.at[lanes] += 1
        return out

    def _fill(self) -> None:
        while len(lanes := np.flatnonzero(self.range <= BOTTOM)):
            last, now = self.rest[lanes], self._bytes(lanes)
            self.rest[lanes] = now
            self.value[lanes] = ((self.value[lanes] << SYMBOL_BITS) + (255 & ~((last << SYMBOL_BITS | now) >> 1))) & (TOP - 1)
            self.range[lanes] <<= SYMBOL_BITS

    def symbols(self, cumulative: np.ndarray) -> np.ndarray:
        """The next symbol of each lane, by cumulative counts that begin with 0."""
        total = int(cumulative[-1])
        part = self.range // total
        k = np.searchsorted(cumulative, total - np.minimum(self.value // part + 1, total), side="right") - 1
        low, high = cumulative[k], cumulative[k + 1]
        above = part * (total - high)
        self.value -= above
        self.range = np.where(low > 0, part * (high - low), self.range - above)
        self._fill()
        return k


class Encoders:
    """The counterpart. Bytes leave as nine bits; the carries pass through them at the end."""

    def __init__(self, lanes: int, size: int):
        self.out, self.count = np.zeros((lanes, size + 8), np.int64), np.zeros(lanes, np.int64)
        self.value, self.range = np.zeros(lanes, np.int64), np.full(lanes, TOP, np.int64)

    def _put(self, lanes: np.ndarray, digit: np.ndarray) -> None:
        self.out[lanes, np.minimum(self.count[lanes], self.out.shape[1] - 1)] = digit
        self.count[lanes] += 1

    def symbols(self, k: np.ndarray, cumulative: np.ndarray, live: np.ndarray) -> None:
        """The next symbol of each lane that is ``live``."""
        total = int(cumulative[-1])
        part, low, high = self.range // total, cumulative[k], cumulative[k + 1]
        self.value += np.where(live & (low > 0), self.range - part * (total - low), 0)
        self.range = np.where(live, np.where(low > 0, part * (high - low), self.range - part * (total - high)), self.range)
        while len(lanes := np.flatnonzero(self.range <= BOTTOM)):
            self._put(lanes, self.value[lanes] >> SHIFT)
            self.value[lanes] = self.value[lanes] << SYMBOL_BITS & (TOP - 1)
            self.range[lanes] <<= SYMBOL_BITS

    def finish(self, size: int) -> list[bytes | None]:
        """Frames of ``size`` bytes, None where it is too small."""
        left = CODE_BITS - (np.floor(np.log2(self.range)).astype(np.int64) + 1)
        mask = (TOP - 1) >> left
        end = (self.value + mask) & ~mask
        more = (end | mask) >= self.value + self.range
        left, mask = left + more, mask >> more
        end = (self.value + mask) & ~mask
        while len(lanes := np.flatnonzero(left > 0)):
            self._put(lanes, end[lanes] >> SHIFT)
            end[lanes] = end[lanes] << SYMBOL_BITS & (TOP - 1)
            left[lanes] -= SYMBOL_BITS
        for i in range(self.out.shape[1] - 1, 0, -1):
            self.out[:, i - 1] += self.out[:, i] >> 8
            self.out[:, i] &= 255
        whole = self.out[:, :size].astype(np.uint8)
        return [row.tobytes() if n <= size else None for row, n in zip(whole, self.count.tolist(), strict=True)]


def decode_symbols(payload: Column | str, cumulative: list[int], count: int) -> Column:
    """struct(symbols, range): ``count`` symbols from the front of each payload and the decoder's final range; null payloads give null."""
    counts = np.array(cumulative, np.int64)

    def run(values: pd.Series) -> pd.DataFrame:
        there = values.notna()
        lanes = Decoders([bytes(v) for v in values[there]])
        got = np.stack([lanes.symbols(counts) for _ in range(count)], axis=1) if count and len(lanes.size) else np.zeros((len(lanes.size), 0), np.int64)
        out = pd.DataFrame({"symbols": pd.Series([None] * len(values), dtype=object), "range": pd.Series([None] * len(values), dtype="Int64")})
        at = np.flatnonzero(there)
        for i, row in zip(at, got.tolist(), strict=True):
            out.at[i, "symbols"] = row
        out.loc[at, "range"] = lanes.range
        return out

    run.__annotations__ = {"values": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(run, "struct<symbols: array<int>, range: bigint>")(payload)


def encode_symbols(symbols: Column | str, cumulative: list[int], size: int) -> Column:
    """struct(data, range, error_code): each array of symbols as a frame of ``size`` bytes and the encoder's final range. Null arrays are
    empty; a null or unknown symbol, or a size that is too small, gives an error code."""
    counts = np.array(cumulative, np.int64)

    def run(values: pd.Series) -> pd.DataFrame:
        rows = [np.array([-1 if x is None or x != x else x for x in (v if v is not None else [])], np.int64) for v in values]
        known = [bool(((r >= 0) & (r < len(counts) - 1)).all()) for r in rows]
        rows = [r if ok else r[:0] for r, ok in zip(rows, known, strict=True)]
        length = np.array([len(r) for r in rows], np.int64)
        lanes = Encoders(len(rows), size)
        for i in range(int(length.max(initial=0))):
            lanes.symbols(np.array([r[i] if i < len(r) else 0 for r in rows]), counts, length > i)
        final = lanes.range.copy()
        data = lanes.finish(size)
        return pd.DataFrame({
            "data": pd.Series([d if ok else None for d, ok in zip(data, known, strict=True)], dtype=object),
            "range": pd.Series([int(x) if ok and d is not None else None for x, d, ok in zip(final, data, known, strict=True)], dtype="Int64"),
            "error_code": [BAD if not ok else TOO_SMALL if d is None else 0 for d, ok in zip(data, known, strict=True)],
        })

    run.__annotations__ = {"values": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(run, "struct<data: binary, range: bigint, error_code: int>")(symbols)


@lru_cache
def vectors_of(n: int, k: int) -> np.ndarray:
    """How many vectors of 0 to ``n`` whole numbers have magnitudes that sum to 0 to ``k``; exact below 2**63."""
    out = np.zeros((n + 1, k + 1), np.int64)
    out[:, 0] = 1
    for i in range(1, n + 1):
        # one more number of magnitude 0, or of each magnitude and both signs
        out[i] = out[i - 1] + 2 * np.r_[0, np.cumsum(out[i - 1])[:-1]]
    return out


def pulse_index(vector: Column | str, n: int, k: int) -> Column:
    """The place of each vector of ``n`` whole numbers, whose magnitudes sum to ``k``, among all such; null if it is none."""

    def run(values: pd.Series) -> pd.Series:
        good = np.array([v is not None and len(v) == n and all(x is not None and x == x for x in v) and int(np.abs(v).sum()) == k for v in values], dtype=bool)
        y = np.array([list(v) for v in values[good]], np.int64).reshape(-1, n)
        count, left, index = vectors_of(n, k), np.full(len(y), k), np.zeros(len(y), np.int64)
        sums = np.concatenate([np.zeros((n + 1, 1), np.int64), np.cumsum(count, axis=1)], axis=1)
        for i in range(n):
            m, rest = np.abs(y[:, i]), count[n - i - 1]
            # first those with 0 here, then for each magnitude the positive and the negative ones
            lower = np.where(m > 0, rest[left] + 2 * (sums[n - i - 1][left] - sums[n - i - 1][np.minimum(left, left - m + 1)]), 0)
            index += np.where(m > 0, lower + np.where(y[:, i] < 0, rest[left - m], 0), 0)
            left = left - m
        out = np.full(len(values), -1, np.int64)
        out[good] = index
        return pd.Series(out).where(pd.Series(good), None).astype("Int64")

    run.__annotations__ = {"values": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "bigint")(vector)


def pulse_vector(index: Column | str, n: int, k: int) -> Column:
    """The inverse of ``pulse_index``; null outside its range."""

    def run(values: pd.Series) -> pd.Series:
        count = vectors_of(n, k)
        good = (values.notna() & (values >= 0) & (values < int(count[n, k]))).to_numpy(dtype=bool)
        index, left = values[good].to_numpy(np.int64), np.full(int(good.sum()), k)
        out = np.zeros((len(index), n), np.int64)
        for i in range(n):
            rest = count[n - i - 1]
            # where each magnitude begins, a row a lane
            each = np.where(np.arange(k + 1) <= left[:, None], rest[np.maximum(left[:, None] - np.arange(k + 1), 0)] * np.r_[1, np.full(k, 2)], 0)
            ends = np.cumsum(each, axis=1)
            m = (index[:, None] >= ends).sum(axis=1)
            index = index - np.where(m > 0, np.take_along_axis(ends, np.maximum(m - 1, 0)[:, None], axis=1)[:, 0], 0)
            half = rest[left - m]
            negative = (m > 0) & (index >= half)
            index = index - np.where(negative, half, 0)
            out[:, i], left = np.where(negative, -m, m), left - m
        full = pd.Series([None] * len(values), dtype=object)
        for i, row in zip(np.flatnonzero(good), out.tolist(), strict=True):
            full.iloc[i] = row
        return full

    run.__annotations__ = {"values": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "array<int>")(index)
