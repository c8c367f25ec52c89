"""Queries that SQL does not express, against plain loops over the same rows."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tonelake.functions import editing, gains, kernels
from tonelake.operators import streams
from tonelake.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def result(spark):
    return lambda name: registry.QUERIES[name](spark, SF).collect()


@pytest.fixture(scope="module")
def frames():
    """The frames that the stateful queries run over: {stream: [(frame_no, samples)]}."""
    e = pd.read_parquet(f"{SF}/embeddings.parquet").sort_values("vec_id")
    out = {}
    for i, x in zip(e["vec_id"], e["embedding"]):
        out.setdefault(i % 16, []).append((i, (np.asarray(x, dtype=np.float32) * np.float32(6)).astype(float)))
    return out


def lengths(data):
    """(sizes, offset of the first frame, bytes of padding) of a packet by RFC 6716, section 3.2, or None."""
    toc, at = data[0], 1
    code, pad = toc & 3, 0

    def size():
        nonlocal at
        if at >= len(data) or (data[at] >= 252 and at + 1 >= len(data)):
            return None
        n, at = (data[at], at + 1) if data[at] < 252 else (data[at] + 4 * data[at + 1], at + 2)
        return n

    if code == 0:
        sizes = [len(data) - 1]
    elif code == 1:
        if len(data) % 2 == 0:
            return None
        sizes = [(len(data) - 1) // 2] * 2
    elif code == 2:
        first = size()
        if first is None or first > len(data) - at:
            return None
        sizes = [first, len(data) - at - first]
    else:
        n, vbr, padded = data[1] & 63, data[1] & 128, data[1] & 64
        ms = [10, 20, 40, 60][toc >> 3 & 3] if toc < 96 else [10, 20][toc >> 3 & 1] if toc < 128 else [2.5, 5, 10, 20][toc >> 3 & 3]
        at = 2
        if not n or n * ms > 120:
            return None
        while padded:
            if at >= len(data):
                return None
            pad, at, more = pad + min(data[at], 254), at + 1, data[at] == 255
            if not more:
                break
        end = len(data) - pad
        if end < at:
            return None
        if vbr:
            sizes = []
            for _ in range(n - 1):
                got = size()
                if got is None or at > end:
                    return None
                sizes.append(got)
            sizes.append(end - at - sum(sizes))
            if sizes[-1] < 0:
                return None
        elif (end - at) % n:
            return None
        else:
            sizes = [(end - at) // n] * n
    return None if max(sizes) > 1275 else (sizes, at, pad)


def test_packet_parse(spark, result):
    payload = {r.event_id: bytes(r.payload) for r in __import__("tonelake.plans.views", fromlist=["packets"]).packets(spark, SF).collect()}
    good = 0
    for r in result("packet_parse"):
        want = lengths(payload[r.event_id])
        good += want is not None
        assert (r.error_code == 0) == (want is not None)
        assert want is None or (r.sizes, r.payload_offset, r.padding, r.toc) == (*want, payload[r.event_id][0])
    assert good > 100


def test_dc_reject(result, frames):
    want = {}
    for s, rows in frames.items():
        mean = 0.0
        for n, x in rows:
            total = 0.0
            for v in x:
                total += v - mean
                mean += 6.3 * 3.0 / 48000 * (v - mean)
            want[s, n] = total
    assert {(r.stream_id, r.frame_no): r["sum"] for r in result("dc_reject")} == pytest.approx(want, abs=2e-6)


def test_high_pass(result, frames):
    """At 60 Hz the codec's fixed-point rule gives these coefficients in Q28."""
    f = 2471 * 60 // 48  # 1.5 pi * 60 / 48000 in Q19
    assert f == 3088 and abs(f / 2**19 - 1.5 * math.pi * 60 / 48000) < 2e-6
    r = 2**28 - 471 * f
    b, a = [r / 2**28, -2 * r / 2**28, r / 2**28], [(r // 64 * (f * f // 65536 - 2**23) // 65536) / 2**28, ((r // 64) ** 2 // 65536) / 2**28]
    assert b[0] == pytest.approx(0.99458, abs=1e-5) and a[1] == pytest.approx(b[0] ** 2, abs=1e-6)
    want = {}
    for s, rows in frames.items():
        xs, ys = [0.0, 0.0], [0.0, 0.0]
        for n, x in rows:
            energy = 0.0
            for v in x:
                y = b[0] * v + b[1] * xs[-1] + b[2] * xs[-2] - a[0] * ys[-1] - a[1] * ys[-2]
                xs, ys, energy = [xs[-1], v], [ys[-1], y], energy + y * y
            want[s, n] = energy
    assert {(r.stream_id, r.frame_no): r.energy for r in result("high_pass")} == pytest.approx(want, abs=1e-5, rel=1e-6)


def test_soft_clip(result, frames):
    got = {(r.stream_id, r.frame_no): (r.top, r.bottom) for r in result("soft_clip")}
    bent = 0
    for s, rows in frames.items():
        before = False
        for n, x in rows:
            top, bottom = got[s, n]
            assert -1 <= bottom <= top <= 1
            if np.abs(x).max() <= 1 and not before:
                assert (top, bottom) == pytest.approx((x.max(), x.min()), abs=1e-6)
            bent += np.abs(x).max() > 1
            before = np.abs(x).max() > 1
    assert bent > 10


def test_stereo_width(result, frames):
    want = {}
    for s, rows in frames.items():
        xx = xy = yy = width = peak = 0.0
        for n, x in rows:
            per_second = 48000 // (len(x) // 2)
            k = 1 - 25 / max(50, per_second)
            left, right = x[: len(x) // 8 * 8 : 2], x[1 : len(x) // 8 * 8 : 2]
            xx, xy, yy = (max(0.0, o + k * (sum(p * r for p, r in zip(u, v)) / 4 - o)) for o, u, v in ((xx, left, left), (xy, left, right), (yy, right, right)))
            if max(xx, yy) > 8e-4:
                xy = min(xy, math.sqrt(xx * yy))
                corr = xy / (1e-15 + math.sqrt(xx * yy))
                ldiff = abs(xx**0.25 - yy**0.25) / (1e-15 + xx**0.25 + yy**0.25)
                width += (math.sqrt(max(0, 1 - corr**2)) * ldiff - width) / per_second
                peak = max(peak - 0.02 / per_second, width)
            want[s, n] = min(1.0, 20 * peak)
    assert {(r.stream_id, r.frame_no): r.width for r in result("stereo_width")} == pytest.approx(want, abs=2e-6)


def test_resampled_streams_are_whole(result, frames):
    got = {}
    for r in result("resample_48k"):
        got.setdefault(r.stream_id, []).append(r.n)
    for s, rows in frames.items():
        n_in = sum(len(x) for _, x in rows)
        assert 0 <= n_in * 48000 / 44100 - sum(got[s]) < 40


def test_lpc(result):
    e = pd.read_parquet(f"{SF}/embeddings.parquet").set_index("vec_id")["embedding"]
    for r in result("lpc")[:100]:
        x = np.asarray(e[r.frame_id], dtype=float)
        corr = np.array([x[: len(x) - k] @ x[k:] for k in range(9)])
        a = np.linalg.solve(corr[np.abs(np.subtract.outer(range(8), range(8)))], corr[1:])
        assert np.abs(np.array(r.a)) == pytest.approx(np.abs(a), abs=2e-3)


def test_mdct_energy(result):
    e = pd.read_parquet(f"{SF}/embeddings.parquet").set_index("vec_id")["embedding"]
    got = {}
    for r in result("mdct_energy"):
        got.setdefault(r.frame_id, {})[r.quarter] = r.energy
    for i in list(got)[:60]:
        x = np.asarray(e[i], dtype=float)
        n = len(x) // 2
        half = [math.sin(math.pi / 2 * math.sin(math.pi * (k + 0.5) / (2 * n)) ** 2) for k in range(n)]
        w = x * np.array(half + half[::-1])
        c = [sum(w[t] * math.cos(math.pi / n * (t + 0.5 + n / 2) * (k + 0.5)) for t in range(2 * n)) for k in range(n)]
        energy = [sum(v * v for v in c[8 * q : 8 * q + 8]) for q in range(4)]
        scale = energy[0] / got[i][0]
        assert [got[i][q] * scale for q in range(4)] == pytest.approx(energy, rel=1e-4, abs=1e-5)


def test_gain_codes(spark):
    # every level and code, read by the rule of RFC 6716, section 4.2.7.4
    rows = [(p, c) for p in range(64) for c in range(41)]
    got = spark.createDataFrame(rows, "p int, c int").select("p", "c", gains.dequantise(F.array("c"), F.col("p"), True)["level"].alias("v")).collect()
    assert {(r.p, r.c): r.v for r in got} == {(p, c): min(max(0, 2 * c - 16, p + c - 4), 63) for p, c in rows}
    # what is coded reads back as the level that was meant, and as far as codes reach the gain is near
    r = np.random.default_rng(1)
    rows = [([int(v) for v in np.exp(r.uniform(np.log(90_000), np.log(1.5e9), 4))], int(r.integers(0, 64))) for _ in range(300)]
    df = spark.createDataFrame(rows, "g array<bigint>, p int").select("g", "p", gains.quantise(F.col("g"), F.col("p")).alias("q"))
    for x in df.select("*", F.transform("q.levels", gains.gain_of).alias("gain")).collect():
        level = x.p
        for i, (g, code, coded) in enumerate(zip(x.g, x.q.codes, x.gain)):
            level = code if i == 0 else min(max(0, 2 * code - 16, level + code - 4), 63)
            assert level == x.q.levels[i]
            if i and 1 < code < 39:
                assert abs(math.log2(coded / g)) < 0.5


def test_editing_errors_and_long_lists(spark):
    p = bytes.fromhex("08AABB")
    df = spark.createDataFrame([(1, [p, p, p], 1, 2), (2, [p, bytes.fromhex("28AA")], 0, 2), (3, [p], 1, 1), (4, [], 0, 1), (5, None, 0, 1), (6, [p] * 7, 0, 7), (7, [b""], 0, 1)], "i int, p array<binary>, b int, e int")
    got = {r.i: (None if r.x.data is None else bytes(r.x.data), r.x.error_code) for r in df.select("i", editing.frame_range(F.col("p"), F.col("b"), F.col("e")).alias("x")).collect()}
    assert got[1] == (p, 0) and all(got[i][0] is None and got[i][1] < 0 for i in range(2, 8))


def test_positions_among_many_links(spark):
    r = np.random.default_rng(5)
    size = r.integers(0, 3000, 400)
    stop = np.cumsum(size)
    links = spark.createDataFrame([(i, int(e - n), int(e)) for i, (n, e) in enumerate(zip(size, stop))], "link int, start long, stop long")
    at = sorted({int(x) for x in r.integers(0, stop[-1] + 500, 600)} | {0, int(stop[-1]), int(stop[-1]) - 1})
    got = {x.at: x.link for x in streams.links_of_positions(links, spark.createDataFrame([(a,) for a in at], "at long"), at="at", width=512).collect()}
    last = max(i for i in range(400) if stop[i] == stop[-1])
    assert got == {a: int(np.searchsorted(stop, a, side="right")) if a < stop[-1] else last for a in at}


def test_intervals_of_sparse_streams(spark):
    ids = [0, 1, 65535, 65536, 10**6, 2**33, 2**33 + 1, 2**50]
    got = {r.serial: (r.start, r.stop) for r in streams.link_intervals(spark.createDataFrame([(i, 10 + k) for k, i in enumerate(ids)], "serial long, granule long")).collect()}
    ends = np.cumsum([10 + k for k in range(len(ids))]).tolist()
    assert got == {i: (e - 10 - k, e) for k, (i, e) in enumerate(zip(ids, ends))}


def test_checksum_of_any_length(spark):
    r = np.random.default_rng(6)
    data = [r.bytes(n) for n in (0, 1, 2, 255, 3000)] + [None]
    df = spark.createDataFrame([(i, d) for i, d in enumerate(data)], "i int, d binary")
    assert {x.i: x.c for x in df.select("i", kernels.crc_column(F.col("d")).alias("c")).collect()} == {i: None if d is None else kernels.page_crc(d) for i, d in enumerate(data)}
