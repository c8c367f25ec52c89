"""Pitch search and removal of doubling, against plain Python and signals of a known period."""

import math
import random

import numpy as np
import pytest

from tonelake.functions import pitch as P


def plain_two(found, energy):
    order = sorted((k for k in range(len(found)) if found[k] > 0), key=lambda k: (-found[k] ** 2 / (1 + energy[k]), k))
    return (order + [0])[:2] if order else [0, min(1, len(found) - 1)]


def plain_search(x, y, size, lags):
    n, few = size // 4, lags // 4
    slow, fast = x[0 : 2 * n : 2], y[::2]
    found = [sum(a * b for a, b in zip(slow, fast[k : k + n])) for k in range(few)]
    near = plain_two(found, [sum(v * v for v in fast[k : k + n]) for k in range(few)])
    n, few = size // 2, lags // 2
    found = [max(sum(a * b for a, b in zip(x[:n], y[k : k + n])), -1) if min(abs(k - 2 * b) for b in near) <= 2 else 0.0 for k in range(few)]
    best = plain_two(found, [sum(v * v for v in y[k : k + n]) for k in range(few)])[0]
    lean = 0
    if 0 < best < few - 1:
        a, b, c = found[best - 1 : best + 2]
        lean = 1 if c - a > 0.7 * (b - a) else -1 if a - c > 0.7 * (b - c) else 0
    return 2 * best - lean


def test_search_is_the_plain_rule():
    r = np.random.default_rng(1)
    x = r.normal(0, 1, (200, 64))
    x[:100] += np.sin(np.arange(64) * r.uniform(0.2, 2, (100, 1))) * 2
    got = P.search(x[:, 32:], x, 64, 64)
    assert got.tolist() == [plain_search(row[32:].tolist(), row.tolist(), 64, 64) for row in x]


def plain_undoubled(x, lag, before, gain, size, most, least):
    n, most_, least_ = size // 2, most // 2, least // 2
    win = lambda t: x[most_ - t : most_ - t + n]
    dot = lambda a, b: sum(u * v for u, v in zip(a, b))
    now, t0 = win(0), min(max(lag // 2, 0), most_ - 1)
    of = lambda xy, yy: xy / math.sqrt(1 + dot(now, now) * yy)
    best = (t0, dot(now, win(t0)), dot(win(t0), win(t0)))
    g0 = g = of(best[1], best[2])
    for k in range(2, 16):
        t1 = (2 * t0 + k) // (2 * k)
        if t1 < least_:
            break
        t2 = (t0 if t1 + t0 > most_ else t0 + t1) if k == 2 else (2 * P.CONFIRMED_AT[k] * t0 + k) // (2 * k)
        if t1 > most_ or t2 > most_:
            continue
        xy, yy = (dot(now, win(t1)) + dot(now, win(t2))) / 2, (dot(win(t1), win(t1)) + dot(win(t2), win(t2))) / 2
        apart = abs(t1 - before // 2)
        trust = gain if apart <= 1 else gain / 2 if apart <= 2 and 5 * k * k < t0 else 0
        wanted = max(0.4, 0.85 * g0 - trust) if t1 < 3 * least_ else max(0.3, 0.7 * g0 - trust)
        if of(xy, yy) > wanted:
            best, g = (t1, xy, yy), of(xy, yy)
    t, xy, yy = min(max(best[0], 1), most_ - 1), max(best[1], 0), best[2]
    a, b, c = (dot(now, win(t + d)) for d in (-1, 0, 1))
    lean = 1 if c - a > 0.7 * (b - a) else -1 if a - c > 0.7 * (b - c) else 0
    return max(2 * t + lean, least), min(1.0 if yy <= xy else xy / (yy + 1), g)


def test_undoubled_is_the_plain_rule():
    r = random.Random(2)
    x, lag, before, gain = [], [], [], []
    for _ in range(300):
        w = r.uniform(0.15, 1.2)
        x.append([math.sin(w * i) + 0.3 * math.sin(2 * w * i) + r.gauss(0, 0.2) for i in range(120)])
        lag.append(r.randrange(0, 160))
        before.append(r.randrange(0, 160))
        gain.append(r.random())
    got = P.undoubled(np.array(x), np.array(lag), np.array(before), np.array(gain), 80, 160, 10)
    want = [plain_undoubled(*row, 80, 160, 10) for row in zip(x, lag, before, gain)]
    assert got[0].tolist() == [w[0] for w in want] and got[1].tolist() == pytest.approx([w[1] for w in want])


def test_a_doubled_lag_is_halved(spark):
    r = np.random.default_rng(3)
    rows = []
    for period in (12, 15, 20):  # samples at half rate
        base = r.normal(0, 1, period)
        rows.append((period, np.tile(base, 20)[:120].tolist(), 4 * period, 0, 0.0))
    df = spark.createDataFrame([*rows, (0, None, 10, 0, 0.0), (0, [1.0], 10, 0, 0.0), (0, [float("nan")] * 120, 10, 0, 0.0), (0, [1.0] * 120, None, 0, 0.0)], "period int, x array<double>, lag int, before int, gain double")
    got = df.select("period", P.pitch_undoubled("x", "lag", "before", "gain", 80, 160, 8).alias("p"), P.pitch_lag("x", 80, 160).alias("l")).collect()
    for g in got:
        if g.period:
            assert abs(g.p.lag - 2 * g.period) <= 1 and g.p.gain > 0.8 and (160 - g.l) % (2 * g.period) == 0
    assert [g.p.lag for g in got[3:]] == [None] * 4 and [g.l for g in got[3:6]] == [None] * 3
