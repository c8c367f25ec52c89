"""Edges of the band, ambisonic and layout rules that the queries' tables do not reach."""

import numpy as np
from pyspark.sql import functions as F

from tonelake.functions import ambisonics, bands
from tonelake.operators import streams
from tonelake.streaming import state


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def array(*values):
    return F.array(*map(F.lit, values)).cast("array<double>")


def test_bands_come_back(spark):
    x = [3.0, -4.0, 1.0, 2.0, 2.0, 0.0]
    edges = [0, 2, 3]
    amplitudes = array(5.0, 3.0)
    levels = F.transform(amplitudes, lambda e, i: F.log2(e) - F.get(array(*bands.MEAN_ENERGIES), i))
    unit = bands.normalised(array(*x[:3]), amplitudes, edges)
    row = one(spark, unit=unit, back=bands.denormalised(unit, levels, edges, length=6), half=bands.denormalised(unit, levels, edges, length=6, downsample=3))
    assert np.allclose(row["unit"], [0.6, -0.8, 1 / 3])
    assert np.allclose(row["back"], [3, -4, 1, 0, 0, 0])
    assert np.allclose(row["half"], [3, -4, 0, 0, 0, 0])


def test_no_samples(spark):
    none = F.array().cast("array<double>")
    row = one(spark, e=bands.energy_shift(F.array().cast("array<int>")), c=bands.comb_filter(none, 4, (15, 15), (0.5, 0.5), (0, 0), []), t=bands.tapered_autocorrelation(none, 1, [0.5]))
    assert (row["e"]["energy"], row["e"]["shift"], row["c"], row["t"]) == (0, 0, [], [0.0, 0.0])


def test_a_filter_without_gain_leaves_samples(spark):
    x = [float(i % 7) for i in range(30)]
    assert one(spark, y=bands.comb_filter(array(*x), 20, (15, 16), (0.0, 0.0), (0, 2), [0.3]))["y"] == x[20:]


def test_pitches_that_stand_in(spark):
    row = one(spark, none=bands.best_pitches(array(1.0, 1.0), array(-1.0, -1.0, -1.0, -1.0), 2, 3), one=bands.best_pitches(array(1.0, 0.0), array(-1.0, -1.0, 1.0, -1.0), 2, 3))
    assert (row["none"], row["one"]) == ([0, 1], [2, 0])


def test_matrices_undo_each_other():
    for order in (1, 2):
        n = (order + 1) ** 2 + 2
        mix, unmix = (np.array(t[order]).reshape(n, n).T / 32768 for t in (ambisonics.MIXING, ambisonics.DEMIXING))
        product = unmix @ mix * 10 ** (ambisonics.DEMIXING_GAIN[order] / 5120)
        assert np.allclose(product / product[0, 0], np.eye(n), atol=2e-3)
    assert ambisonics.exported(4, 1)[:5] == [16384, 16384, 16384, 16384, 0]


def test_spreading_by_hand():
    # one band of 16: all coefficients small three times over, then none
    operator, held = state.Spreading([0, 16], [1]), state.Spreading([0, 16], [1]).start()
    held, quiet = operator.step(held, np.full(16, 0.01))
    assert (held, quiet) == ([512.0, 0.0], 0)
    held, loud = operator.step(held, np.full(16, 0.25))
    assert (held, loud) == ([256.0, 1.0], 1)
    assert state.Spreading([0, 8], [1]).step([256.0, 2.0], np.zeros(8)) == ([256.0, 2.0], 0)


def test_suffixes(spark):
    row = one(spark, none=streams.binary_suffix(F.lit(b"")), odd=streams.binary_suffix(F.lit(b"\x01x")), even=streams.binary_suffix(F.lit(b"\x02x")))
    assert [(r["suffix"], r["error_code"]) for r in row] == [(None, 0), (bytearray(b"\x01x"), 0), (None, -131)]
