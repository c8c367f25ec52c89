"""Pitch of whole columns of signals: coarse to fine search, and a test whether a part of the lag would do as well.

All rows of an Arrow batch are searched together, as rows of one array.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A neighbour counts as well if it gains this part of what the peak gains over the other one.
NEAR = 0.7
# For each divisor of the lag the multiple at which the shorter one is confirmed.
CONFIRMED_AT = [0, 0, 3, 2, 3, 2, 5, 2, 3, 2, 3, 2, 5, 2, 3, 2]


def _lean(left: np.ndarray, peak: np.ndarray, right: np.ndarray) -> np.ndarray:
    """-1 or 1 where a neighbour of a peak is nearly as high, by a half step."""
    return np.where(right - left > NEAR * (peak - left), 1, np.where(left - right > NEAR * (peak - right), -1, 0))


def _energies(y: np.ndarray, size: int, lags: int) -> np.ndarray:
    sums = np.concatenate([np.zeros((len(y), 1)), np.cumsum(y * y, axis=1)], axis=1)
    return sums[:, size : size + lags] - sums[:, :lags]


def _two_best(found: np.ndarray, energy: np.ndarray) -> np.ndarray:
    """The two lags of highest squared correlation by one plus energy, among positive ones, the lesser of equal ones; 0 stands in for
    a second, 0 and 1 for both."""
    score = np.where(found > 0, found**2 / (1 + energy), -1.0)
    best = np.argmax(score, axis=1)
    rows = np.arange(len(score))
    rest = score.copy()
    rest[rows, best] = -2.0
    second = np.argmax(rest, axis=1) if score.shape[1] > 1 else best
    second = np.where(rest[rows, second] > 0, second, np.where(score[rows, best] > 0, 0, min(1, score.shape[1] - 1)))
    return np.stack([np.where(score[rows, best] > 0, best, 0), second], axis=1)


def search(x: np.ndarray, y: np.ndarray, size: int, lags: int) -> np.ndarray:
    """The lag of each row at which ``y`` is most like ``x``, at twice the resolution of these, which are signals at half rate. ``size`` and
    ``lags`` count at full rate."""
    n = size >> 2
    slow, fast = x[:, : 2 * n : 2], y[:, ::2]
    found = np.stack([(slow * fast[:, k : k + n]).sum(axis=1) for k in range(lags >> 2)], axis=1)
    near = 2 * _two_best(found, _energies(fast, n, lags >> 2))
    n, lags = size >> 1, lags >> 1
    at = np.arange(lags)
    close = (np.abs(at - near[:, :1]) <= 2) | (np.abs(at - near[:, 1:]) <= 2)
    found = np.zeros((len(x), lags))
    for k in range(lags):  # only where the coarse search points
        rows = np.flatnonzero(close[:, k])
        found[rows, k] = np.maximum((x[rows, :n] * y[rows, k : k + n]).sum(axis=1), -1)
    best = _two_best(found, _energies(y, n, lags))[:, 0]
    inner = (best > 0) & (best < lags - 1)
    a, b, c = (found[np.arange(len(x)), np.clip(best + d, 0, lags - 1)] for d in (-1, 0, 1))
    return 2 * best - np.where(inner, _lean(a, b, c), 0)


def undoubled(x: np.ndarray, lag: np.ndarray, before: np.ndarray, gain: np.ndarray, size: int, most: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(lag, gain): the greatest divisor of each lag, of 1 to 15, at which the signal still repeats well enough, confirmed at a multiple.
    ``x`` is at half rate, ``most // 2`` samples of past and ``size // 2`` of now; lags, ``most`` and ``least`` count at full rate. A
    frame near the last one's lag (``before``) is trusted by its ``gain``."""
    floor, n, most, least = least, size >> 1, most >> 1, least >> 1
    rows, steps = np.arange(len(x)), np.arange(n)
    now = x[:, most : most + n]
    past = lambda t: x[rows[:, None], np.clip(most - t, 0, most)[:, None] + steps]
    with_now = lambda t: (now * past(t)).sum(axis=1)
    energy = _energies(x, n, most + 1)[:, ::-1].copy()  # by lag
    energy[:, 0] = (now * now).sum(axis=1)  # the very number that it is compared with
    at = lambda t: energy[rows, np.clip(t, 0, most)]
    xx = energy[:, 0]
    full = np.clip(lag >> 1, 0, most - 1)
    last = before >> 1
    xy, yy = with_now(full), at(full)
    whole = xy / np.sqrt(1 + xx * yy)
    best, best_xy, best_yy, best_gain = np.clip(full, 1, most - 1), xy, yy, whole
    for k in range(2, 16):
        part = (2 * full + k) // (2 * k)
        twice = np.where(part + full > most, full, full + part) if k == 2 else (2 * CONFIRMED_AT[k] * full + k) // (2 * k)
        xy = (with_now(part) + with_now(twice)) / 2
        yy = (at(part) + at(twice)) / 2
        reached = xy / np.sqrt(1 + xx * yy)
        apart = np.abs(part - last)
        trust = np.where(apart <= 1, gain, np.where((apart <= 2) & (5 * k * k < full), gain / 2, 0))
        wanted = np.where(part < 3 * least, np.maximum(0.85 * whole - trust, 0.4), np.maximum(0.7 * whole - trust, 0.3))
        takes = (part >= least) & (part <= most) & (twice <= most) & (reached > wanted)
        best, best_xy, best_yy, best_gain = (np.where(takes, new, old) for new, old in ((np.clip(part, 1, most - 1), best), (xy, best_xy), (yy, best_yy), (reached, best_gain)))
    best_xy = np.maximum(best_xy, 0)
    out = np.minimum(np.where(best_yy <= best_xy, 1.0, best_xy / (best_yy + 1)), best_gain)
    return np.maximum(2 * best + _lean(with_now(best - 1), with_now(best), with_now(best + 1)), floor), out


def _rows(values: pd.Series, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows have ``width`` finite samples, and these."""
    there = np.array([v is not None and len(v) >= width and bool(np.isfinite(np.asarray(v[:width], float)).all()) for v in values], dtype=bool)
    return there, np.array([v[:width] for v in values[there]], float).reshape(-1, width)


def pitch_lag(signal: Column | str, size: int, lags: int) -> Column:
    """The lag, at full rate, of the last half of each signal at half rate against all of it: ``lags // 2`` samples of past and ``size // 2`` of
    now. Lag 0 is the oldest place. Null for signals that are null, shorter, or not finite."""

    def run(values: pd.Series) -> pd.Series:
        there, x = _rows(values, (size + lags) // 2)
        out = np.zeros(len(values), np.int64)
        if len(x):
            out[there] = search(x[:, lags >> 1 :], x, size, lags)
        return pd.Series(out).where(pd.Series(there), None).astype("Int64")

    run.__annotations__ = {"values": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "int")(signal)


def pitch_undoubled(signal: Column | str, lag: Column | str, before: Column | str, gain: Column | str, size: int, most: int, least: int) -> Column:
    """struct(lag, gain) by ``undoubled``, where a lag counts back from now; null where the signal or a number is."""

    def run(values: pd.Series, lag: pd.Series, before: pd.Series, gain: pd.Series) -> pd.DataFrame:
        there, x = _rows(values, (size + most) // 2)
        numbers = (lag.notna() & before.notna() & gain.notna()).to_numpy(dtype=bool)
        x, there = x[numbers[there]], there & numbers
        out = pd.DataFrame({"lag": pd.Series([None] * len(values), dtype="Int64"), "gain": pd.Series([None] * len(values), dtype="Float64")})
        if len(x):
            at, g = undoubled(x, lag[there].to_numpy(np.int64), before[there].to_numpy(np.int64), gain[there].to_numpy(float), size, most, least)
            out.loc[there, "lag"], out.loc[there, "gain"] = at, g
        return out

    run.__annotations__ = {"values": pd.Series, "lag": pd.Series, "before": pd.Series, "gain": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(run, "struct<lag: int, gain: double>")(signal, lag, before, gain)
