"""Numeric kernels against plain formulas and round trips."""

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from tonelake.functions import signal as G
from tonelake.streaming import state as S

R = np.random.default_rng(1)


def test_levinson_schur_and_step_up_agree():
    for n in (2, 8, 16):
        x = np.convolve(R.normal(size=800), [1, 0.6, -0.2])
        r = G.autocorrelation(x, n)
        assert r[3 if n > 2 else 1] == pytest.approx(sum(x[i] * x[i + (3 if n > 2 else 1)] for i in range(len(x) - (3 if n > 2 else 1))))
        a = np.linalg.solve(np.array([[r[abs(i - j)] for j in range(n)] for i in range(n)]), -r[1 : n + 1])
        assert G.levinson(r, n) == pytest.approx(a, abs=1e-8)
        k, left = G.schur(r, n)
        assert G.step_up(k) == pytest.approx(-a, abs=1e-8) and left == pytest.approx(r[0] * np.prod(1 - k**2))
    assert not G.levinson(np.zeros(5), 4).any()


def test_filters():
    x, a = R.normal(size=100), np.array([0.5, -0.2])
    y, _ = G.iir(x, a)
    assert y[2:] + 0.5 * y[1:-1] - 0.2 * y[:-2] == pytest.approx(x[2:])
    half, memory = G.iir(x[:50], a)
    assert np.r_[half, G.iir(x[50:], a, memory)[0]] == pytest.approx(y)
    z, _ = G.biquad(x, (1.0, 0.0, 0.0), (0.5, -0.2))
    assert z == pytest.approx(y)


def test_mdct_restores_the_signal():
    n, x = 32, R.normal(size=32 * 6)
    w = np.r_[G.power_window(n), G.power_window(n)[::-1]]
    assert G.power_window(n) ** 2 + G.power_window(n)[::-1] ** 2 == pytest.approx(np.ones(n))
    out = np.zeros(len(x))
    for i in range(0, len(x) - n, n):
        out[i : i + 2 * n] += w * G.imdct(G.mdct(w * x[i : i + 2 * n]))
    assert out[n:-n] == pytest.approx(x[n:-n])


def test_pitch():
    y = np.sin(2 * np.pi * np.arange(400) / 40)
    first, second = G.best_pitches(y[80:200], y[:380], 90)
    assert {first % 40, second % 40} == {0} and first != second
    assert G.best_pitches(np.zeros(5), np.zeros(20), 4) == (0, 1)


@given(st.lists(st.integers(-32768, 32767), max_size=300))
def test_energy_shift(x):
    e, s = G.energy_shift(np.array(x))
    assert 0 <= e < 2**30 and abs((e << s) - sum(v * v for v in x)) <= (len(x) + 1) << s
    assert s == 0 or e >= 2**26


def test_logarithms():
    for x in (1, 2, 100, 65535, 65536, 10**9, 2**31 - 1):
        assert abs(G.lin2log(x) / 128 - np.log2(x)) < 0.01
        assert G.log2lin(G.lin2log(x)) == pytest.approx(x, rel=0.02)


@given(st.lists(st.integers(0, 32).flatmap(lambda n: st.tuples(st.integers(0, 2**n - 1), st.just(n))), max_size=30), st.booleans())
def test_bits(fields, msb):
    data = G.pack_bits(fields, msb)
    assert len(data) == (sum(n for _, n in fields) + 7) // 8
    assert G.unpack_bits(data, [n for _, n in fields], msb) == [v for v, _ in fields]
    assert G.unpack_bits(b"", [1], msb) == [None]


def test_masking_and_fade():
    assert G.masking_offset([0.0] * 21, 13, 1, 8000) == 1600 and G.masking_offset([-9.0] * 42, 17, 2, 16000) == int(16000 * -1.8)
    x = np.ones(10)
    assert G.gain_fade(x, 0.5, 2.0, np.array([0.0, 1.0]))[[0, 1, 9]] == pytest.approx([0.5, 2.0, 2.0])


@pytest.mark.parametrize(("a", "b"), [(44100, 48000), (48000, 16000), (8000, 48000), (48000, 48000)])
def test_resampling(a, b):
    x = np.sin(2 * np.pi * 440 * np.arange(4410) / a)
    op = S.Resample(a, b)
    s, out = op.start(), []
    for piece in np.array_split(x, 13):
        s, y = op.step(s, piece)
        out += y
    whole = op.step(op.start(), x)[1]
    assert out == pytest.approx(whole)
    assert abs(len(out) - len(x) * b / a) < 80 * max(1, b / a)
    expected = np.sin(2 * np.pi * 440 * np.arange(len(out)) / b)
    assert np.abs(np.array(out) - expected)[100:].max() < 0.02


def test_high_pass():
    op = S.HighPass(2)
    s = op.start()
    for _ in range(60):
        s, y = op.step(s, np.ones(960))
    assert np.abs(y).max() < 1e-3
