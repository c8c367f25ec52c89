"""Operators with state that runs along a stream, in batch and in Structured Streaming.

Each is a class with a ``step`` on one frame and a small list of numbers as state. ``apply`` runs it
over a batch, one group for each stream in order; ``stream`` runs the same class in a streaming query,
where the state lives in Spark's state store between micro-batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tonelake.functions.signal import biquad, lin2log, log2lin
from tonelake.shipping import ship


ARROW = {"array<double>": pa.list_(pa.float64()), "double": pa.float64(), "boolean": pa.bool_(), "int": pa.int32(), "array<int>": pa.list_(pa.int32())}


class Operator(Protocol):
    #: Name and Spark type of the value that a frame gives.
    output: str

    def start(self) -> list[float]: ...

    def step(self, state: list[float], frame: np.ndarray) -> tuple[list[float], object]: ...


class SoftClip:
    """Bends samples beyond 1 back below it by x + a*x*x between zero crossings, and carries the bend of
    an unfinished swing into the next frame."""

    output = "samples array<double>"

    def __init__(self, channels: int = 1):
        self.channels = channels

    def start(self) -> list[float]:
        return [0.0] * self.channels

    def step(self, state: list[float], frame: np.ndarray) -> tuple[list[float], list[float]]:
        x = np.clip(np.asarray(frame, dtype=float), -2.0, 2.0)
        n = len(x) // self.channels
        carried = list(state)
        for c in range(self.channels if n else 0):
            x[c : n * self.channels : self.channels], carried[c] = self._bend(x[c : n * self.channels : self.channels].copy(), state[c])
        return carried, x.tolist()

    @staticmethod
    def _bend(y: np.ndarray, carried: float) -> tuple[np.ndarray, float]:
        # the swing that the last frame left unfinished is bent as it was, up to its zero crossing
        y = np.where(np.logical_and.accumulate(y * carried < 0), y + carried * y**2, y)
        entry, bend = y[0], 0.0
        # swings: runs between zero crossings, where zeros go with the samples before them
        sign = np.sign(y)
        known = np.maximum.accumulate(np.where(sign != 0, np.arange(len(y)), -1))
        side = np.where(known >= 0, sign[known], 0)
        side[side == 0] = side[side != 0][0] if (side != 0).any() else 1
        cuts = np.r_[0, np.flatnonzero(np.diff(side)) + 1, len(y)]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            swing = y[lo:hi]
            peak = int(np.abs(swing).argmax())
            top = abs(swing[peak])
            bend = 0.0
            if top > 1:
                # so that top + bend * top * top, with the swing's sign, is just below 1
                bend = -side[lo] * (top - 1) / top**2 * (1 + 2.4e-7)
                swing = swing + bend * swing**2
                if lo == 0 and peak >= 2:
                    # a swing cut by the frame's start is led over from where it began
                    swing[:peak] = np.clip(swing[:peak] + (entry - swing[0]) * (1 - np.arange(1, peak + 1) / peak), -1, 1)
                y[lo:hi] = swing
        return y, bend


class DcReject:
    """One-pole high-pass filter for each channel."""

    output = "samples array<double>"

    def __init__(self, channels: int = 1, cutoff: float = 3.0, rate: int = 48000):
        self.channels, self.k = channels, 6.3 * cutoff / rate

    def start(self) -> list[float]:
        return [0.0] * self.channels

    def step(self, state: list[float], frame: np.ndarray) -> tuple[list[float], list[float]]:
        y, state = np.asarray(frame, dtype=float).copy(), list(state)
        for c in range(self.channels):
            y[c :: self.channels], state[c] = self._channel(y[c :: self.channels], state[c])
        return state, y.tolist()

    def _channel(self, x: np.ndarray, mean: float) -> tuple[np.ndarray, float]:
        """The samples less the running mean before each: mean[i] = d**i * (mean[0] + k * sum of x[j] / d**(j + 1)), d = 1 - k."""
        out, piece = np.empty(len(x)), max(1, int(20 / self.k))  # so that the powers stay in range
        for i in range(0, len(x), piece):
            part = x[i : i + piece]
            powers = (1 - self.k) ** np.arange(len(part) + 1)
            means = powers * (mean + self.k * np.r_[0.0, np.cumsum(part / powers[1:])])
            out[i : i + piece], mean = part - means[:-1], float(means[-1])
        return out, mean


class StereoWidth:
    """How wide an interleaved stereo signal is, 0 to 1, from smoothed energies and their correlation. Pairs are taken by fours; a frame
    of fewer is silence, and one of none leaves everything as it was."""

    output = "width double"

    def __init__(self, rate: int = 48000):
        self.rate = rate

    def start(self) -> list[float]:
        return [0.0] * 5

    def step(self, state: list[float], frame: np.ndarray) -> tuple[list[float], float]:
        pairs = np.asarray(frame, dtype=float)[: len(frame) // 8 * 8].reshape(-1, 2)
        if len(frame) < 2:
            return state, min(1.0, 20 * state[4])
        per_second = max(1, self.rate // (len(frame) // 2))
        alpha = 1 - 25 / max(50, per_second)
        left, right = pairs.T
        now = np.array([left @ left, left @ right, right @ right]) / 4
        if not np.all(np.isfinite(now)) or max(now[0], now[2]) >= 1e9:
            now[:] = 0
        xx, xy, yy = np.maximum(np.array(state[:3]) + alpha * (now - state[:3]), 0)
        width, peak = state[3], state[4]
        if max(xx, yy) > 8e-4:
            a, b = np.sqrt(xx), np.sqrt(yy)
            xy = min(xy, a * b)
            correlation = xy / (1e-15 + a * b)
            balance = abs(np.sqrt(a) - np.sqrt(b)) / (1e-15 + np.sqrt(a) + np.sqrt(b))
            width += (np.sqrt(max(0.0, 1 - correlation**2)) * balance - width) / per_second
            peak = max(peak - 0.02 / per_second, width)
        return [float(xx), float(xy), float(yy), float(width), float(peak)], float(min(1.0, 20 * peak))


class Spreading:
    """How far a frame's pulses are spread (0 none, 1 light, 2 normal, 3 aggressive), from how many coefficients
    of normalised bands are small, averaged over frames and held back near the last decision."""

    output = "spread int"
    #: Squares of a band's coefficients times its width below which they count as small.
    SMALL = np.array([0.25, 0.0625, 0.015625])

    def __init__(self, edges: list[int], weights: list[int], scale: int = 1):
        self.bands = [(a * scale, b * scale, w) for a, b, w in zip(edges, edges[1:], weights, strict=False)]

    def start(self) -> list[float]:
        return [256.0, 2.0]

    def step(self, state: list[float], frame: np.ndarray) -> tuple[list[float], int]:
        wide = [(frame[a:b], b - a, w) for a, b, w in self.bands if b - a > 8 and b <= len(frame)]
        if not wide or self.bands[-1][1] - self.bands[-1][0] <= 8:
            return state, 0
        small = [((x * x * n)[:, None] < self.SMALL).sum(axis=0) for x, n, _ in wide]
        score = sum(w * int((2 * count >= n).sum()) for count, (_, n, w) in zip(small, wide, strict=True))
        average = (256 * score // sum(w for *_, w in wide) + int(state[0])) // 2
        held = (3 * average + (3 - int(state[1])) * 128 + 66) // 4
        spread = 3 - int(np.searchsorted([80, 256, 384], held, side="right"))
        return [float(average), float(spread)], spread


class Discontinuous:
    """Whether a frame needs no packet: after 200 ms without activity, for 400 ms at most at a time."""

    output = "skip boolean"

    def __init__(self, frame_ms: float = 20.0, threshold: float = 0.0, before: int = 10, most: int = 20):
        self.frame_ms, self.threshold, self.before, self.most = frame_ms, threshold, before * 20, (before + most) * 20

    def start(self) -> list[float]:
        return [0.0]

    def step(self, state: list[float], frame: np.ndarray) -> tuple[list[float], bool]:
        x = np.asarray(frame, dtype=float)
        if len(x) and np.abs(x).max() > self.threshold:
            return [0.0], False
        quiet = state[0] + self.frame_ms
        if quiet <= self.before:
            return [quiet], False
        return ([quiet], True) if quiet <= self.most else ([float(self.before)], False)


class PreEmphasis:
    """y[i] = x[i] - c * x[i - 1], across frames."""

    output = "samples array<double>"

    def __init__(self, coefficient: float = 0.85):
        self.c = coefficient

    def start(self) -> list[float]:
        return [0.0]

    def step(self, state: list[float], frame: np.ndarray) -> tuple[list[float], list[float]]:
        x = np.asarray(frame, dtype=float)
        return ([float(x[-1])] if len(x) else state), (x - self.c * np.r_[state, x[:-1]]).tolist() if len(x) else []


class Smooth:
    """Exponential average of the frames' means."""

    output = "smooth double"

    def __init__(self, weight: float = 0.5):
        self.weight = weight

    def start(self) -> list[float]:
        return [0.0, 0.0]

    def step(self, state: list[float], frame: np.ndarray) -> tuple[list[float], float]:
        x = float(np.mean(frame)) if len(frame) else 0.0
        now = state[0] + self.weight * (x - state[0]) if state[1] else x
        return [now, 1.0], now


class StereoPredictor:
    """How the second of two interleaved channels follows from the first: the factor, held to -2 and 2, in 1/8192, and what is left over by
    what there is, in 1/16384, both from amplitudes smoothed along the stream. The stronger the factor the
    faster they follow, but by ``smooth`` at least."""

    output = "predictor array<int>"

    def __init__(self, smooth: float = 0.01):
        self.smooth = smooth

    def start(self) -> list[float]:
        return [0.0, 0.0]

    def step(self, state: list[float], frame: np.ndarray) -> tuple[list[float], list[int]]:
        pairs = np.nan_to_num(np.asarray(frame, dtype=float)[: len(frame) // 2 * 2]).reshape(-1, 2)
        if not len(pairs):
            return state, [0, 0]
        x, y = pairs.T
        xx, yy, xy = max(float(x @ x), 1.0), float(y @ y), float(x @ y)
        factor = min(max(np.floor(xy / xx * 8192) / 8192, -2.0), 2.0)
        pace = max(self.smooth, factor**2 / 64)
        rest = max(yy - 2 * factor * xy + factor**2 * xx, 0.0)
        now = [a + (np.sqrt(e) - a) * pace for a, e in zip(state, (xx, rest), strict=True)]
        return [float(a) for a in now], [int(factor * 8192), int(min(np.floor(now[1] / max(now[0], 1.0) * 16384), 32767))]


class EnergyCode:
    """Band energies (logarithms to base 2) as whole steps and a fine rest. Each is predicted from the same band of the frame before,
    by ``alpha``, and from what the lower bands of the frame turned out to be, by ``beta``; the stream's first
    frame has the prediction over bands alone, by ``first_beta``. ``fine`` gives the bits of each band's rest. The state holds what a
    decoder knows: the energies as coded."""

    output = "codes array<int>"
    #: Least energies, of the frame before and of a coded one.
    FLOOR, LEAST = -9.0, -28.0

    def __init__(self, alpha: float, beta: float, fine: list[int], first_beta: float = 0.15):
        self.alpha, self.beta, self.first_beta, self.fine = alpha, beta, first_beta, fine

    def start(self) -> list[float]:
        return [0.0, *[0.0] * len(self.fine)]

    def step(self, state: list[float], frame: np.ndarray) -> tuple[list[float], list[int]]:
        """The whole steps of all bands, then their rests. Bands that a frame lacks, or without a number, are silent."""
        begun, old = state[0], state[1:]
        alpha, beta = (self.alpha, self.beta) if begun else (0.0, self.first_beta)
        energy = np.full(len(self.fine), self.LEAST)
        energy[: len(frame)] = np.where(np.isfinite(frame), frame, self.LEAST)[: len(energy)]
        coarse, rests, coded, lower = [], [], [], 0.0
        for e, before, bits in zip(energy.tolist(), old, self.fine, strict=True):
            guess = alpha * max(before, self.FLOOR) + lower
            q = int(np.floor(e - guess + 0.5))
            lower += q * (1 - beta)
            reached = max(guess + q, self.LEAST)
            rest = int(min(max(np.floor((e - reached + 0.5) * 2**bits), 0), 2**bits - 1))
            coarse.append(q)
            rests.append(rest)
            coded.append(reached + (rest + 0.5) / 2**bits - 0.5)
        return [1.0, *coded], coarse + rests


def _run(operator: Operator, state: list[float], pdf: pd.DataFrame, stream: str, order: str) -> tuple[list[float], pd.DataFrame]:
    name, out = operator.output.split(" ")[0], []
    pdf = pdf.sort_values(order, kind="stable")
    for frame in pdf["samples"]:
        state, value = operator.step(state, np.asarray(frame if frame is not None else [], dtype=float))
        out.append(value)
    return state, pd.DataFrame({stream: pdf[stream].to_numpy(), order: pdf[order].to_numpy(), name: pd.Series(out, dtype=object).to_numpy()})


def _schema(frames: DataFrame, operator: Operator, stream: str, order: str) -> str:
    types = {f.name: f.dataType.simpleString() for f in frames.schema}
    return f"{stream} {types[stream]}, {order} {types[order]}, {operator.output}"


def apply(frames: DataFrame, operator: Operator, *, stream: str = "stream_id", order: str = "frame_no", samples: str = "samples") -> DataFrame:
    """(stream, order, value) for each frame of a batch, each stream in order. A null frame is empty.

    Streams are sorted within partitions and walked batch by batch with the state carried along, so none
    is held in memory; rows without a stream form one.
    """
    ship(frames.sparkSession)
    rows = frames.select(stream, order, frames[samples].cast("array<double>").alias("samples"))
    name, kind = operator.output.split(" ")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, current, state = False, None, []
        for b in batches:
            out = []
            for key, frame in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                if not begun or key != current:
                    begun, current, state = True, key, operator.start()
                state, value = operator.step(state, np.asarray(frame or [], dtype=float))
                out.append(value)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, ARROW[kind])], names=[stream, order, name])

    return rows.repartition(stream).sortWithinPartitions(stream, order).mapInArrow(walk, _schema(rows, operator, stream, order))


def stream(frames: DataFrame, operator: Operator, *, stream: str = "stream_id", order: str = "frame_no", samples: str = "samples") -> DataFrame:
    """The same in a streaming query (append mode): state is carried between micro-batches. Frames must
    arrive in order between micro-batches; within one they are sorted."""
    ship(frames.sparkSession)
    rows = frames.select(stream, order, frames[samples].alias("samples"))

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        state = list(group.get[0]) if group.exists else operator.start()
        pdf = pd.concat(list(pdfs))
        state, out = _run(operator, state, pdf, stream, order)
        group.update(([float(v) for v in state],))
        yield out

    return rows.groupBy(stream).applyInPandasWithState(step, _schema(rows, operator, stream, order), "state array<double>", "append", GroupStateTimeout.NoTimeout)


class Resample:
    """Rational resampling by a windowed sinc, a piece of signal at a time; the state holds the tail of
    the input that later outputs still need."""

    output = "samples array<double>"

    def __init__(self, rate_in: int, rate_out: int, taps: int = 32, beta: float = 8.0):
        common = int(np.gcd(rate_in, rate_out))
        self.up, self.down = rate_out // common, rate_in // common
        self.cut = min(1.0, self.up / self.down) * 0.97
        self.half, self.beta = int(np.ceil(taps / 2 / min(1.0, self.up / self.down))), beta

    def start(self) -> list[float]:
        # the next output's number, the input's number that the tail begins at, and the tail
        return [0.0, -float(self.half), *[0.0] * self.half]

    def step(self, state: list[float], frame: np.ndarray) -> tuple[list[float], list[float]]:
        number, begin = int(state[0]), int(state[1])
        x = np.r_[state[2:], np.asarray(frame, dtype=float)]
        have = begin + len(x)
        count = max(0, -((have - self.half) * self.up // -self.down) - number)
        n = number + np.arange(count)
        whole, part = np.divmod(n * self.down, self.up)
        keep = whole + self.half < have
        whole, part, n = whole[keep], part[keep], n[keep]
        offsets = np.arange(-self.half + 1, self.half + 1)
        at = offsets[None, :] - (part / self.up)[:, None]
        kernel = self.cut * np.sinc(self.cut * at) * np.i0(self.beta * np.sqrt(np.maximum(0, 1 - (at / self.half) ** 2))) / np.i0(self.beta)
        y = (kernel * x[(whole - begin)[:, None] + offsets[None, :]]).sum(axis=1) if len(n) else np.zeros(0)
        number += len(n)
        first = number * self.down // self.up - self.half + 1
        drop = max(0, min(first - begin, len(x)))
        return [float(number), float(begin + drop), *x[drop:].tolist()], y.tolist()


class HighPass:
    """Second-order high-pass for each channel, with a double zero at 0 Hz and poles of radius 1 - 0.92 * f, where f is 1.5 pi times the
    cutoff by the rate. The cutoff moves from ``start`` Hz towards ``cutoff`` from frame to frame, on a scale
    of logarithms, and is at ``cutoff`` from the first frame on if they are the same."""

    output = "samples array<double>"
    # 1.5 pi / 1000 in Q19, 0.92 in Q9, and the part of the way that the cutoff goes in a frame in Q16.
    FREQUENCY_Q19, RADIUS_Q9, PART_Q16 = 2471, 471, 983

    def __init__(self, channels: int = 1, cutoff: int = 60, rate: int = 48000, start: int = 60):
        self.channels, self.rate, self.begin, self.aim = channels, rate, lin2log(start) << 8, lin2log(cutoff) << 8

    def start(self) -> list[float]:
        return [float(self.begin), *[0.0, 0.0] * self.channels]

    def coefficients(self, hertz: int) -> tuple[tuple[float, float, float], tuple[float, float]]:
        """Of the zeros and of the poles, from whole numbers."""
        f = self.FREQUENCY_Q19 * hertz // (self.rate // 1000)
        r = (1 << 28) - self.RADIUS_Q9 * f
        part = r >> 6
        poles = part * ((f * f >> 16) - (2 << 22)) >> 16, part * part >> 16
        return (r / 2**28, -2 * r / 2**28, r / 2**28), (poles[0] / 2**28, poles[1] / 2**28)

    def step(self, state: list[float], frame: np.ndarray) -> tuple[list[float], list[float]]:
        now = int(state[0])
        now += (self.aim - now) * self.PART_Q16 >> 16
        b, a = self.coefficients(log2lin(now >> 8))
        y, out = np.asarray(frame, dtype=float).copy(), [float(now)]
        for c in range(self.channels):
            y[c :: self.channels], memory = biquad(y[c :: self.channels], b, a, (state[1 + 2 * c], state[2 + 2 * c]))
            out += memory
        return out, y.tolist()
