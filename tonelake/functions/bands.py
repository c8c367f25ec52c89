"""Spectra by band, pitch and masking rules, as array expressions without Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tonelake.functions.pcm import autocorrelation, doubles, energy, inner_product, total

# Edges of the bands in the codec's shortest frame, the bands' mean energies as binary logarithms,
# and the weights of the comb filter's middle, near and far taps.
EDGES = [0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 14, 16, 20, 24, 28, 34, 40, 48, 60, 78, 100]
MEAN_ENERGIES = [
    6.4375, 6.25, 5.75, 5.3125, 5.0625, 4.8125, 4.5, 4.375, 4.875, 4.6875, 4.5625, 4.4375,
    4.875, 4.625, 4.3125, 4.5, 4.375, 4.625, 4.75, 4.4375, 3.75, 3.75, 3.75, 3.75, 3.75,
]
COMB_TAPS = [[0.30664062, 0.21704102, 0.12963867], [0.4638672, 0.2680664, 0.0], [0.7998047, 0.100097656, 0.0]]
COMB_LEAST_PERIOD = 15
MASKED_BANDS = {1101: (13, 8000), 1102: (15, 12000)}

FLOOR = 1e-27


def bound(value: Column, then) -> Column:
    """``then(value)`` with the value computed once, as lambdas would compute it anew for each element."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _by_band(samples: Column, edges: list[int], scale: int, gains: Column) -> Column:
    """Each band of a spectrum times its entry of ``gains``."""
    s = doubles(samples)
    scaled = lambda g, i: bound(F.get(g, F.lit(i)), lambda gain: F.transform(F.slice(s, edges[i] * scale + 1, (edges[i + 1] - edges[i]) * scale), lambda x: x * gain))
    return bound(gains, lambda g: F.concat(*[scaled(g, i) for i in range(len(edges) - 1)]))


def normalised(samples: Column, amplitudes: Column, edges: list[int], scale: int = 1) -> Column:
    """The bands between ``edges`` times ``scale``, each divided by its amplitude, of which 1e-27 is the floor."""
    return _by_band(samples, edges, scale, F.transform(amplitudes, lambda e: F.lit(1.0) / (F.lit(FLOOR) + e)))


def denormalised(samples: Column, levels: Column, edges: list[int], scale: int = 1, *, start: int = 0, length: int, downsample: int = 1) -> Column:
    """A spectrum of ``length`` from bands of unit energy and their levels (binary logarithms less the
    bands' means, at most 32 with them). Bands before ``start`` are zero, and so is what lies behind the
    last band or the share of the spectrum that a lower rate keeps."""
    means = F.array(*map(F.lit, MEAN_ENERGIES))
    gains = F.transform(levels, lambda v, i: F.when(i >= start, F.pow(F.lit(2.0), F.least(v + F.get(means, i), F.lit(32.0)))).otherwise(0.0))
    end = min(edges[-1] * scale, length // downsample if downsample != 1 else length)
    return F.concat(F.slice(_by_band(samples, edges, scale, gains), 1, end), F.array_repeat(F.lit(0.0), length - end))


def comb_filter(samples: Column, start: int, periods: tuple[int, int], gains: tuple[float, float], taps: tuple[int, int], window: list[float]) -> Column:
    """The samples from ``start`` on, each plus five samples of one period before, weighted. What comes
    before ``start`` is history. Both filters are blended by squared window weights: the first fades
    out over the window's length, and the second alone follows."""
    s = doubles(samples)
    w = F.array(*[F.lit(x * x) for x in window]) if window else F.array().cast("array<double>")

    def echo(i: Column, which: int) -> Column:
        at = lambda k: F.get(s, i - max(periods[which], COMB_LEAST_PERIOD) + k)
        middle, near, far = (gains[which] * t for t in COMB_TAPS[taps[which]])
        return at(0) * middle + (at(1) + at(-1)) * near + (at(2) + at(-2)) * far

    def out(x: Column, k: Column) -> Column:
        share = F.coalesce(F.get(w, k), F.lit(1.0))
        return x + (F.lit(1.0) - share) * echo(k + start, 0) + share * echo(k + start, 1)

    return F.transform(F.slice(s, F.lit(start + 1), F.greatest(F.size(s) - start, F.lit(0))), out)


def tapered(samples: Column, window: list[float]) -> Column:
    """Both ends weighted by a window, the last sample by its first weight."""
    s, w = doubles(samples), F.array(*map(F.lit, window))
    weight = lambda i: F.coalesce(F.get(w, i), F.lit(1.0))
    return F.transform(s, lambda x, i: x * weight(i) * weight(F.size(s) - 1 - i))


def tapered_autocorrelation(samples: Column, lags: int, window: list[float]) -> Column:
    """Autocorrelation at lags from 0 to ``lags`` of samples with tapered ends."""
    return F.array(*[autocorrelation(tapered(samples, window), k) for k in range(lags + 1)])


def energy_shift(samples: Column) -> Column:
    """struct(energy, shift) of 16-bit samples: squares added in pairs and shifted right by so much that
    the sum keeps two bits of headroom in an int, as a first, rough sum of as many samples tells."""
    return bound(samples, lambda v: bound(_pairs(v), lambda pairs: _shifted(pairs, F.size(v))))


def _pairs(samples: Column) -> Column:
    n = F.size(samples)
    square = lambda i: F.coalesce(F.pow(F.get(samples, i), F.lit(2)), F.lit(0.0))
    half = F.floor((n + 1) / 2).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), half - 1), lambda i: (square(i * 2) + square(i * 2 + 1)).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))


def _shifted(pairs: Column, n: Column) -> Column:
    shifted = lambda by: F.aggregate(F.transform(pairs, lambda v: F.call_function("shiftright", v, by)), F.lit(0).cast("bigint"), lambda a, v: a + v)
    bits = lambda v: F.length(F.bin(v.cast("bigint")))
    first = bits(n) - 1
    shift = bound(first, lambda f: F.greatest(f + 3 - (32 - bits(shifted(f) + n)), F.lit(0)))
    made = bound(shift, lambda h: F.struct(shifted(h).alias("energy"), h.alias("shift")))
    return F.when(n > 0, made).otherwise(F.struct(F.lit(0).cast("bigint").alias("energy"), F.lit(0).alias("shift")))


def best_pitches(x: Column, y: Column, size: int, lags: int) -> Column:
    """The two lags at which ``y`` resembles the ``size`` samples of ``x`` most: by squared correlation over
    one plus energy, among positive correlations, the smaller lag first of equal ones. Lags 0 and 1 stand in
    for those that are missing."""
    part = lambda k: F.slice(y, k + 1, F.lit(size))
    each = F.transform(F.sequence(F.lit(0), F.lit(lags - 1)), lambda k: F.struct(inner_product(x, part(k)).alias("r"), (F.lit(1.0) + energy(part(k))).alias("e"), k.alias("lag")))
    found = F.transform(F.filter(each, lambda z: z["r"] > 0), lambda z: F.struct(F.round(-z["r"] * z["r"] / z["e"], 9).alias("score"), z["lag"].alias("lag")))
    best = F.transform(F.array_sort(found), lambda z: z["lag"])
    second = F.lit(min(1, lags - 1))
    # a single find pushes the first stand-in to the second place
    return F.when(F.size(best) > 1, F.slice(best, 1, 2)).when(F.size(best) == 1, F.array(F.get(best, F.lit(0)), F.lit(0))).otherwise(F.array(F.lit(0), second))


def masking_offset(masks: Column, channels: int, bandwidth_id: Column) -> Column:
    """Bits a second that masking saves or costs: the mean mask of the bands in use, 21 masks a channel,
    held to -2 and 0.5 and halved if positive, plus 0.2, times the bandwidth's rate."""

    def of(bands: int, rate: int) -> Column:
        used = F.concat(*[F.slice(doubles(masks), 21 * c + 1, bands) for c in range(channels)])
        held = F.transform(used, lambda m: F.greatest(F.least(m, F.lit(0.5)), F.lit(-2.0)))
        mean = total(F.transform(held, lambda m: F.when(m > 0, m / 2).otherwise(m))) / (bands * channels)
        return ((mean + 0.2) * rate).cast("int")

    out = of(17, 16000)
    for bandwidth, (bands, rate) in MASKED_BANDS.items():
        out = F.when(bandwidth_id == bandwidth, of(bands, rate)).otherwise(out)
    return out
