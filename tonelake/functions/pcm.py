"""Sample arrays: conversion, mixing and measures, as array expressions without Python.

Arithmetic is in doubles; interleaved arrays hold channel ``c`` of sample ``i`` at ``i * channels + c``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SQRT_HALF = 0.7071067811865476
# Weights of channels for left and right, by channel count.
DOWNMIX = {
    1: ([1.0], [1.0]),
    2: ([1.0, 0.0], [0.0, 1.0]),
    3: ([1.0, SQRT_HALF, 0.0], [0.0, SQRT_HALF, 1.0]),
    4: ([1.0, 0.0, SQRT_HALF, 0.0], [0.0, 1.0, 0.0, SQRT_HALF]),
    5: ([1.0, SQRT_HALF, 0.0, SQRT_HALF, 0.0], [0.0, SQRT_HALF, 1.0, 0.0, SQRT_HALF]),
    6: ([1.0, SQRT_HALF, 0.0, SQRT_HALF, 0.0, 0.5], [0.0, SQRT_HALF, 1.0, 0.0, SQRT_HALF, 0.5]),
}


def wrap16(x: Column) -> Column:
    """A whole number narrowed to 16 bits, wrapping."""
    return F.pmod(x + 32768, F.lit(65536)) - 32768


def doubles(samples: Column) -> Column:
    return samples.cast("array<double>")


def to_i16_floor(samples: Column) -> Column:
    """Rule A: floor of x * 32767, wrapping."""
    return F.transform(doubles(samples), lambda x: wrap16(F.floor(x * 32767)).cast("int"))


def to_i16_even(samples: Column) -> Column:
    """Rule B: clamp x * 32768, then round half to even."""
    return F.transform(doubles(samples), lambda x: F.rint(F.greatest(F.least(x * 32768, F.lit(32767.0)), F.lit(-32768.0))).cast("int"))


def to_i16_away(samples: Column) -> Column:
    """Rule C: round x * 32768 half away from zero, then clamp."""
    return F.transform(doubles(samples), lambda x: F.greatest(F.least(F.signum(x) * F.floor(F.abs(x * 32768) + 0.5), F.lit(32767.0)), F.lit(-32768.0)).cast("int"))


def to_i24(samples: Column) -> Column:
    """Round x * 2**23 half to even, held to the range of an int."""
    return F.transform(doubles(samples), lambda x: F.greatest(F.least(F.rint(x * 8388608), F.lit(2147483647.0)), F.lit(-2147483648.0)).cast("int"))


def repeat_each(samples: Column, k: int) -> Column:
    """Each sample ``k`` times."""
    return F.flatten(F.transform(samples, lambda x: F.array_repeat(x, k)))


def channel(samples: Column, channels: Column | int, c: Column | int) -> Column:
    """One channel of an interleaved array."""
    lit = lambda v: F.lit(v) if isinstance(v, int) else v
    frames = F.floor(F.size(samples) / lit(channels)).cast("int")
    return F.when(frames > 0, F.transform(F.sequence(F.lit(0), frames - 1), lambda i: F.get(samples, i * lit(channels) + lit(c)))).otherwise(F.slice(samples, 1, 0))


def weighted(samples: Column, channels: int, weights: list[float]) -> Column:
    """The weighted sum of the channels, sample by sample, added in order of the channels."""
    frames = F.floor(F.size(samples) / channels).cast("int")

    def mixed(i: Column) -> Column:
        total = F.lit(0.0)
        for c, w in enumerate(weights):
            if w:
                total = total + F.get(samples, i * channels + c) * F.lit(w)
        return total

    return F.when(frames > 0, F.transform(F.sequence(F.lit(0), frames - 1), mixed)).otherwise(F.array().cast("array<double>"))


def interleave(left: Column, right: Column) -> Column:
    return F.flatten(F.transform(F.arrays_zip(left.alias("l"), right.alias("r")), lambda z: F.array(z["l"], z["r"])))


def downmix(samples: Column, channels: int) -> Column:
    """Interleaved stereo from an interleaved array: by table for up to six channels, else alternate sums."""
    s = doubles(samples)
    left, right = DOWNMIX.get(channels, ([1.0 - c % 2 for c in range(channels)], [float(c % 2) for c in range(channels)]))
    return interleave(weighted(s, channels, left), weighted(s, channels, right))


def matrix_mix(samples: Column, rows: int, cols: int, cells: list[int]) -> Column:
    """Product with a matrix of Q15 cells in column order: ``cols`` channels in, ``rows`` out."""
    s = doubles(samples)
    outs = [weighted(s, cols, [cells[rows * c + r] / 32768.0 for c in range(cols)]) for r in range(rows)]
    return F.flatten(F.transform(F.arrays_zip(*[o.alias(f"o{r}") for r, o in enumerate(outs)]), lambda z: F.array(*[z[f"o{r}"] for r in range(rows)])))


def _mixed(samples: Column, rows: int, cols: int, cells: list[int]) -> Column:
    """Products with Q15 cells in column order, each rounded by itself and added up, as bigint."""
    frames = F.sequence(F.lit(0), F.floor(F.size(samples) / cols).cast("int") - 1)
    frames = F.when(F.size(samples) >= cols, frames).otherwise(F.array().cast("array<int>"))
    sample = lambda f, c: F.element_at(samples, f * cols + c + 1).cast("bigint")
    part = lambda f, r, c: F.shiftright(sample(f, c) * cells[rows * c + r] + 16384, 15)
    row = lambda f, r: sum((part(f, r, c) for c in range(1, cols)), part(f, r, 0))
    return F.flatten(F.transform(frames, lambda f: F.array(*[row(f, r) for r in range(rows)])))


def matrix_mix_i16(samples: Column, rows: int, cols: int, cells: list[int]) -> Column:
    """16-bit channels through a Q15 matrix, wrapping at 16 bits."""
    return F.transform(_mixed(samples, rows, cols, cells), wrap16)


def matrix_mix_i24(samples: Column, rows: int, cols: int, cells: list[int]) -> Column:
    """24-bit channels through a Q15 matrix, wrapping at 32 bits."""
    return F.transform(_mixed(samples, rows, cols, cells), lambda x: (F.pmod(x + 2**31, F.lit(2**32)) - 2**31).cast("int"))


def matrix_mix_in(samples: Column, rows: int, cols: int, cells: list[int], bits: int = 16) -> Column:
    """16 or 24-bit channels through a Q15 matrix as doubles of full scale 1."""
    return F.transform(matrix_mix(samples, rows, cols, cells), lambda x: x / 2.0 ** (bits - 1))


def is_silent(samples: Column, depth: int) -> Column:
    """Digital silence: no magnitude beyond 2**-depth."""
    return F.coalesce(F.array_max(F.transform(doubles(samples), F.abs)), F.lit(0.0)) <= F.lit(2.0**-depth)


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, b: a + b)


def energy(samples: Column) -> Column:
    return total(F.transform(doubles(samples), lambda x: x * x))


def inner_product(a: Column, b: Column) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def autocorrelation(samples: Column, lag: Column | int) -> Column:
    """Sum of x[i] * x[i + lag]."""
    s = doubles(samples)
    k = F.lit(lag) if isinstance(lag, int) else lag
    n = F.greatest(F.size(s) - k, F.lit(0))
    return total(F.zip_with(F.slice(s, F.lit(1), n), F.slice(s, k + 1, n), lambda x, y: x * y))


def best_lag(samples: Column, low: int, high: int) -> Column:
    """The lag of the largest autocorrelation; of equal ones the smallest."""
    lags = F.array(*[F.struct(F.round(autocorrelation(samples, k), 9).alias("r"), F.lit(-k).alias("k")) for k in range(low, high + 1)])
    return -F.array_max(lags)["k"]


def fir(samples: Column, taps: list[float]) -> Column:
    """y[i] = x[order + i] + sum of taps[t] * x[order + i - 1 - t]."""
    s, order = doubles(samples), len(taps)
    n = F.size(s) - order

    def at(i: Column) -> Column:
        y = F.get(s, i + order)
        for t, w in enumerate(taps):
            y = y + F.get(s, i + (order - 1 - t)) * F.lit(w)
        return y

    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), at)).otherwise(F.array().cast("array<double>"))


def pre_emphasis(samples: Column, coefficient: float) -> Column:
    """y[i] = x[i] - c * x[i - 1], with nothing before the first sample."""
    s = doubles(samples)
    return F.transform(s, lambda x, i: x - F.lit(coefficient) * F.when(i > 0, F.get(s, i - 1)).otherwise(0.0))


def chirp(samples: Column, c: float) -> Column:
    """a[i] * c**(i + 1)."""
    return F.transform(doubles(samples), lambda x, i: x * F.pow(F.lit(c), i + 1))


def interpolate(a: Column, b: Column, quarter: int) -> Column:
    """Whole numbers a quarter-step between two arrays, differences and results narrowed to 16 bits."""
    return F.zip_with(a, b, lambda x, y: wrap16(x + F.shiftright((wrap16(y - x) * quarter).cast("int"), 2)).cast("int"))


def band_energy(samples: Column, edges: list[int]) -> Column:
    """Root of the energy in each band between consecutive edges, with a floor of 1e-27 under the root."""
    s = doubles(samples)
    return F.array(*[F.sqrt(F.lit(1e-27) + energy(F.slice(s, a + 1, b - a))) for a, b in zip(edges, edges[1:], strict=False)])


def prefers_mid_side(left: Column, right: Column, edges: list[int], shift: int) -> Column:
    """Whether mid and side have the smaller weighted absolute sum over the first 13 bands."""
    n = edges[13] << shift
    cut = lambda x: F.slice(doubles(x), 1, n)
    lr = F.lit(1e-15) + total(F.zip_with(cut(left), cut(right), lambda a, b: F.abs(a) + F.abs(b)))
    ms = F.lit(1e-15) + total(F.zip_with(cut(left), cut(right), lambda a, b: F.abs(a + b) + F.abs(a - b)))
    base = edges[13] << (shift + 1)
    return F.lit(float(base + 13 - (8 if shift <= 1 else 0))) * ms * SQRT_HALF > F.lit(float(base)) * lr


def smooth_fade(a: Column, b: Column, window: list[float]) -> Column:
    """Crossfade of two arrays by squared window weights."""
    w = F.transform(F.array(*map(F.lit, window)), lambda x: x * x)
    return F.transform(F.arrays_zip(doubles(a).alias("a"), doubles(b).alias("b"), w.alias("w")), lambda z: z["w"] * z["b"] + (F.lit(1.0) - z["w"]) * z["a"])


def apply_gain(samples: Column, q8_db: Column) -> Column:
    """Samples times a gain in 1/256 dB; a gain of 0 leaves them as they are."""
    return F.transform(doubles(samples), lambda x: x * F.pow(F.lit(10.0), q8_db / F.lit(5120.0)))


def stereo_fade(samples: Column, g1: float, g2: float, window: list[float]) -> Column:
    """Interleaved stereo of which the side is scaled by a gain that fades from ``g1`` to ``g2`` by squared
    window weights, and is ``g2`` behind the window; 1 keeps the width, 0 gives mono."""
    s = doubles(samples)
    w = F.array(*[F.lit(x * x) for x in window])

    def at(x: Column, i: Column) -> Column:
        k = F.floor(i / 2).cast("int")
        weight = F.coalesce(F.get(w, k), F.lit(1.0))
        other = F.get(s, F.when(i % 2 == 0, i + 1).otherwise(i - 1))
        return x - (F.lit(1.0) - (weight * g2 + (F.lit(1.0) - weight) * g1)) * (x - other) * 0.5

    return F.transform(s, at)


def is_silent_i16(samples: Column, depth: int) -> Column:
    """Digital silence of 16-bit samples: no magnitude beyond 2**(15 - depth), none at all from depth 15 on."""
    return F.coalesce(F.array_max(F.transform(samples, lambda x: F.abs(x.cast("int")))), F.lit(0)) <= F.lit(0 if depth >= 15 else 1 << (15 - depth))


def trim(samples: Column, start: Column, first: Column, end: Column) -> Column:
    """What a frame that begins at sample ``start`` gives of the positions from ``first`` up to ``end``: the
    declared start and length of a stream cut its first and last frames."""
    skip = F.greatest(first - start, F.lit(0)).cast("int")
    stop = F.least(end - start, F.size(samples).cast("bigint")).cast("int")
    return F.slice(samples, skip + 1, F.greatest(stop - skip, F.lit(0)))
