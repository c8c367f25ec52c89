"""Numeric kernels over one frame: prediction, filters, transforms, pitch, gains and bit fields.

They are textbook algorithms in numpy; ``array_udf`` makes an Arrow UDF of any that maps an array to
an array.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

MAX_LOG_Q7 = 3967


def array_udf(kernel: Callable[[np.ndarray], Iterable[float]]):
    """A UDF array<double> -> array<double>; a null array gives null."""

    def run(values: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else np.asarray(kernel(np.asarray(v, dtype=float)), dtype=float).tolist() for v in values], dtype=object)

    run.__annotations__ = {"values": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "array<double>")


def autocorrelation(x: np.ndarray, lags: int, taper: np.ndarray | None = None) -> np.ndarray:
    """r[k] = sum of x[i] * x[i + k] for k up to ``lags``; ``taper`` weighs both ends first."""
    if taper is not None and len(taper):
        x = x.copy()
        x[: len(taper)] *= taper
        x[-len(taper) :] *= taper[::-1]
    return np.array([x[: len(x) - k] @ x[k:] if k < len(x) else 0.0 for k in range(lags + 1)])


def levinson(r: np.ndarray, order: int) -> np.ndarray:
    """Prediction coefficients a with x[n] + sum of a[i] * x[n - 1 - i] small. Zeros without energy;
    stops when a thousandth of it is left."""
    a = np.zeros(order)
    error = r[0]
    for i in range(order if error > 1e-10 else 0):
        k = -(r[i + 1] + a[:i] @ r[i:0:-1]) / error
        a[:i] += k * a[:i][::-1]
        a[i] = k
        error *= 1 - k * k
        if error <= 0.001 * r[0]:
            break
    return a


def schur(r: np.ndarray, order: int) -> tuple[np.ndarray, float]:
    """Reflection coefficients and the residual energy, by the Schur recursion."""
    forward, backward = r[1 : order + 1].astype(float), r[:order].astype(float)
    out, left = np.zeros(order), float(r[0])
    for k in range(order):
        out[k] = c = -forward[0] / max(backward[0], 1e-9)
        forward, backward = forward + c * backward, backward + c * forward
        left = backward[0]
        forward, backward = forward[1:], backward[:-1]
    return out, left


def step_up(reflection: np.ndarray) -> np.ndarray:
    """Prediction coefficients, x[n] ~ sum of a[i] * x[n - 1 - i], from reflection coefficients."""
    a = np.zeros(0)
    for k in reflection:
        a = np.r_[a + k * a[::-1], -k]
    return a


def bandwidth_expand(a: np.ndarray, c: float) -> np.ndarray:
    return a * c ** np.arange(1, len(a) + 1)


def iir(x: np.ndarray, a: np.ndarray, memory: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """y[i] = x[i] - sum of a[j] * y[i - 1 - j], with the last outputs (newest first) as memory."""
    past = np.zeros(len(a)) if memory is None else memory.astype(float)
    y = np.empty(len(x))
    for i, v in enumerate(x):
        y[i] = v - a @ past
        past = np.r_[y[i], past[:-1]] if len(a) else past
    return y, past


def biquad(x: np.ndarray, b: tuple[float, float, float], a: tuple[float, float], memory: tuple[float, float] = (0.0, 0.0)) -> tuple[np.ndarray, tuple[float, float]]:
    """Second-order filter in transposed direct form II."""
    s, t = memory
    y = np.empty(len(x))
    for i, v in enumerate(x):
        y[i] = b[0] * v + s
        s, t = b[1] * v - a[0] * y[i] + t, b[2] * v - a[1] * y[i]
    return y, (s, t)


def mdct(x: np.ndarray) -> np.ndarray:
    """MDCT of 2n windowed samples to n coefficients, scaled so that ``imdct`` and overlap restore the signal."""
    n = len(x) // 2
    i, k = np.arange(2 * n), np.arange(n)[:, None]
    return np.sqrt(2 / n) * np.cos(np.pi / n * (i + 0.5 + n / 2) * (k + 0.5)) @ x


def imdct(c: np.ndarray) -> np.ndarray:
    n = len(c)
    i, k = np.arange(2 * n)[:, None], np.arange(n)
    return np.sqrt(2 / n) * np.cos(np.pi / n * (i + 0.5 + n / 2) * (k + 0.5)) @ c


def power_window(n: int) -> np.ndarray:
    """The codec's overlap window: sin(pi/2 * sin(pi/2 * (i + 0.5) / n) ** 2)."""
    return np.sin(np.pi / 2 * np.sin(np.pi / 2 * (np.arange(n) + 0.5) / n) ** 2)


def best_pitches(x: np.ndarray, y: np.ndarray, lags: int) -> tuple[int, int]:
    """The two lags of the largest squared correlation over energy, among positive correlations; energy is 1 at least."""
    n = len(x)
    windows = np.lib.stride_tricks.sliding_window_view(y, n)[:lags]
    r = windows @ x
    energy = np.maximum(1 + (windows * windows).sum(axis=1), 1)
    score = np.where(r > 0, r * r / energy, -1.0)
    order = [int(i) for i in np.argsort(-score, kind="stable")[:2] if score[i] > 0]
    return (order + [0, min(1, lags - 1)][len(order) :])[0], (order + [0, min(1, lags - 1)][len(order) :])[1]


def energy_shift(x: np.ndarray) -> tuple[int, int]:
    """Energy of 16-bit samples shifted right so that it has two bits of headroom in an int, and the shift."""
    if not len(x):
        return 0, 0
    v = x.astype(np.int64) ** 2
    pairs = np.add.reduceat(v, np.arange(0, len(v), 2))
    first = len(x).bit_length() - 1
    rough = len(x) + int((pairs >> first).sum())
    shift = max(0, first + 3 - (32 - rough.bit_length()))
    return int((pairs >> shift).sum()), shift


def lin2log(x: int) -> int:
    top = x.bit_length() - 1
    f = (x << 7 >> top) & 127 if x else 0
    return top * 128 + f + (f * (128 - f) * 179 >> 16)


def log2lin(x: int) -> int:
    if x < 0 or x >= MAX_LOG_Q7:
        return 0 if x < 0 else 2**31 - 1
    whole, f = 1 << (x >> 7), x & 127
    c = f + (f * (128 - f) * -174 >> 16)
    return whole + (whole * c >> 7) if x < 2048 else whole + (whole >> 7) * c


def masking_offset(masks: list[float], bands: int, channels: int, rate: int) -> int:
    """Bits a second that masking saves or costs: the mean of clamped masks of 21 bands a channel, positive ones halved, plus 0.2, times the rate."""
    m = np.clip(np.array(masks, dtype=np.float32).reshape(channels, -1)[:, :bands], -2, 0.5)
    m = np.where(m > 0, m / 2, m)
    return int(rate * (float(m.sum(dtype=np.float32)) / (bands * channels) + 0.2))


def gain_fade(x: np.ndarray, g1: float, g2: float, window: np.ndarray, channels: int = 1) -> np.ndarray:
    """From gain ``g1`` to ``g2`` by squared window weights, and ``g2`` behind the window."""
    w = np.ones(len(x) // channels)
    w[: len(window)] = window[: len(w)] ** 2
    return x * np.repeat(w * g2 + (1 - w) * g1, channels)


def pack_bits(fields: list[tuple[int, int]], msb_first: bool) -> bytes:
    """(value, bits) fields one behind the other, from the lowest or the highest bit of each byte."""
    bits: list[int] = []
    for value, n in fields:
        row = [value >> i & 1 for i in range(n)]
        bits += row[::-1] if msb_first else row
    return np.packbits(np.array(bits, dtype=np.uint8), bitorder="big" if msb_first else "little").tobytes()


def unpack_bits(data: bytes, widths: list[int], msb_first: bool) -> list[int | None]:
    """The fields of the given widths; None behind the end."""
    bits = np.unpackbits(np.frombuffer(data, dtype=np.uint8), bitorder="big" if msb_first else "little").tolist()
    out, at = [], 0
    for n in widths:
        row = bits[at : at + n]
        at += n
        out.append(sum(b << i for i, b in enumerate(row[::-1] if msb_first else row)) if len(row) == n else None)
    return out
