"""Range coder and pulse vectors: round trips, equal check values, exhaustive small sizes."""

import itertools
import random

import pytest

from tonelake.functions.coder import RangeDecoder, RangeEncoder, pulses, search, vector_at, vector_index


def code(ops, size):
    e = RangeEncoder()
    for kind, value, arg in ops:
        getattr(e, kind)(value, arg)
    return e, e.finish(size)


def test_round_trips():
    r = random.Random(1)
    for _ in range(400):
        ops = []
        for _ in range(r.randrange(1, 80)):
            kind = r.choice(["symbol", "bit", "bits", "uint"])
            if kind == "symbol":
                c = [0, *itertools.accumulate(r.randrange(1, 50) for _ in range(r.randrange(2, 12)))]
                ops.append((kind, r.randrange(len(c) - 1), c))
            elif kind == "bit":
                ops.append((kind, int(r.random() < 0.3), r.randrange(1, 15)))
            elif kind == "bits":
                n = r.randrange(1, 17)
                ops.append((kind, r.randrange(1 << n), n))
            else:
                n = r.randrange(2, 1 << r.randrange(2, 31))
                ops.append((kind, r.randrange(n), n))
        e, data = code(ops, 700)
        d = RangeDecoder(data)
        for kind, value, arg in ops:
            assert getattr(d, kind)(arg) == value
        assert d.final_range == e.final_range and d.used() == e.used()


def test_too_small_a_frame():
    with pytest.raises(ValueError):
        code([("uint", 5, 1000)] * 40, 10)


def test_frames_are_tight():
    e, data = code([("bit", 1, 1)] * 80, 700)
    assert len(data.rstrip(b"\0")) <= 11 and e.used() == 81


def test_behind_the_data_are_zeros():
    d = RangeDecoder(b"")
    assert [d.bits(8), d.uint(300) >= 0] == [0, True]


def test_pulse_vectors():
    for n in range(1, 6):
        for k in range(0, 6):
            all_ = [v for v in itertools.product(range(-k, k + 1), repeat=n) if sum(map(abs, v)) == k]
            assert pulses(n, k) == len(all_)
            assert sorted(vector_index(list(v)) for v in all_) == list(range(len(all_)))
            assert all(tuple(vector_at(vector_index(list(v)), n, k)) == v for v in all_)
    r = random.Random(2)
    for _ in range(100):
        x = [r.gauss(0, 1) for _ in range(r.randrange(1, 20))]
        y = search(x, 9)
        assert sum(map(abs, y)) == 9 and all(a * b >= 0 for a, b in zip(x, y))
    assert search([3.0, -1.0], 4) == [3, -1]
