"""The range coder and pulse vectors over columns, against those for one packet."""

import itertools
import random

import numpy as np
import pytest

from tonelake.functions import lanes
from tonelake.functions.coder import RangeDecoder, RangeEncoder, pulses, vector_at, vector_index

COUNTS = [0, 1, 5, 6, 20, 64]


def test_decode(spark):
    r = random.Random(1)
    payloads = [r.randbytes(r.choice([0, 1, 3, 16, 40])) for _ in range(300)] + [b"\0" * 9, b"\xff" * 9, None]
    got = spark.createDataFrame([(i, p) for i, p in enumerate(payloads)], "i int, p binary").select("i", lanes.decode_symbols("p", COUNTS, 25).alias("x")).orderBy("i").collect()
    for p, row in zip(payloads, got):
        if p is None:
            assert row.x.symbols is None and row.x.range is None
            continue
        d = RangeDecoder(p)
        assert row.x.symbols == [d.symbol(COUNTS) for _ in range(25)] and row.x.range == d.final_range


def test_encode(spark):
    r = random.Random(2)
    rows = [[r.choice([0, 1, 2, 3, 4]) for _ in range(r.randrange(0, 40))] for _ in range(300)] + [[0] * 60, [1] * 30, [2] * 60, [4] * 60, None, [7], [None, 1], [-1]]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, x array<int>").select("i", lanes.encode_symbols("x", COUNTS, 20).alias("x")).orderBy("i").collect()
    small = 0
    for x, row in zip(rows, got):
        if x is not None and any(k is None or not 0 <= k < 5 for k in x):
            assert row.x.data is None and row.x.error_code == lanes.BAD
            continue
        e = RangeEncoder()
        for k in x or []:
            e.symbol(k, COUNTS)
        final = e.final_range if hasattr(e, "final_range") else e.range
        try:
            assert bytes(row.x.data or b"") == e.finish(20) and row.x.error_code == 0 and row.x.range == final
        except ValueError:
            small += 1
            assert row.x.data is None and row.x.error_code == lanes.TOO_SMALL
    assert small


@pytest.mark.parametrize(("n", "k"), [(1, 3), (4, 1), (4, 5), (9, 4), (3, 0)])
def test_pulses(spark, n, k):
    every = [v for v in itertools.product(range(-k, k + 1), repeat=n) if sum(map(abs, v)) == k] if n < 5 else [tuple(vector_at(i, n, k)) for i in range(0, pulses(n, k), 7)]
    assert lanes.vectors_of(n, k)[n, k] == pulses(n, k)
    df = spark.createDataFrame([(i, list(v)) for i, v in enumerate(every)], "i long, v array<int>")
    got = df.select("v", lanes.pulse_index("v", n, k).alias("at")).select("v", "at", lanes.pulse_vector("at", n, k).alias("back")).collect()
    assert all(r.at == vector_index(r.v) and r.back == r.v for r in got)
    odd = spark.createDataFrame([([1] * (n + 1),), (None,), ([None] * n,), ([k + 1] + [0] * (n - 1),)], "v array<int>")
    assert all(r.at is None for r in odd.select(lanes.pulse_index("v", n, k).alias("at")).collect())
    outside = spark.createDataFrame([(-1,), (pulses(n, k),), (None,)], "i long").select(lanes.pulse_vector("i", n, k).alias("v")).collect()
    assert all(r.v is None for r in outside)


def test_empty_batches(spark):
    df = spark.createDataFrame([], "p binary, x array<int>")
    assert df.select(lanes.decode_symbols("p", COUNTS, 3), lanes.encode_symbols("x", COUNTS, 3)).collect() == []
    assert len(lanes.Decoders([]).symbols(np.array(COUNTS))) == 0
