"""Stateful operators: reference behaviour, frame independence, and batch equal to stream."""

import numpy as np
import pytest

from tonelake.streaming import state as S


def run(op, frames):
    s, out = op.start(), []
    for f in frames:
        s, v = op.step(s, np.asarray(f, dtype=float))
        out.append(v)
    return out


def test_soft_clip_leaves_small_samples_and_bounds_large_ones():
    r = np.random.default_rng(1)
    small = r.uniform(-1, 1, 500)
    assert run(S.SoftClip(), [small])[0] == pytest.approx(small)
    for channels in (1, 2):
        for out in run(S.SoftClip(channels), r.normal(0, 1, (20, 240))):
            assert np.abs(out).max() <= 1 + 1e-9
    peak = np.array([0.0, 0.5, 1.5, 0.5, -0.1])
    a = -(1.5 - 1) / 2.25 * (1 + 2.4e-7)
    assert run(S.SoftClip(), [peak])[0][1:4] == pytest.approx([x + a * x * x for x in peak[1:4]])


def test_soft_clip_carries_an_unfinished_swing():
    first, second = run(S.SoftClip(), [[-0.1, 0.5, 1.6], [0.9, 0.4, -0.3]])
    assert second[0] < 0.9 and second[2] == -0.3


@pytest.mark.parametrize("op", [S.DcReject(), S.DcReject(2), S.PreEmphasis()])
def test_cutting_frames_elsewhere_changes_nothing(op):
    x = np.random.default_rng(2).normal(size=240)
    assert np.concatenate(run(op, [x])) == pytest.approx(np.concatenate(run(op, x.reshape(6, 40))))


def test_dc_is_rejected():
    assert abs(run(S.DcReject(), [np.ones(480)] * 100)[-1][-1]) < 1e-6


def test_width():
    r = np.random.default_rng(3)
    mono = np.repeat(r.normal(0, 0.3, 480), 2)
    assert run(S.StereoWidth(), [mono] * 20)[-1] == pytest.approx(0, abs=1e-6)
    wide = np.stack([r.normal(0, 0.5, 480), r.normal(0, 0.1, 480)], axis=1).ravel()
    assert run(S.StereoWidth(), [wide] * 100)[-1] > 0.5


def test_discontinuous_runs():
    out = run(S.Discontinuous(), [np.zeros(10)] * 40)
    assert out[:10] == [False] * 10 and out[10:30] == [True] * 20 and out[30] is False and out[31] is True
    assert run(S.Discontinuous(), [np.zeros(4)] * 11 + [np.ones(4)] + [np.zeros(4)])[-2:] == [False, False]


def test_streams_over_many_batches(spark):
    # a stream longer than an Arrow batch, one without a key, and null frames
    r = np.random.default_rng(5)
    long = [(1, n, r.normal(0, 1, 4).tolist() if n % 7 else None) for n in range(900)]
    rows = long + [(None, n, [1.0, 2.0]) for n in range(5)] + [(2**60 + 1, 0, [0.5])]
    df = spark.createDataFrame(rows, "stream_id long, frame_no long, samples array<double>").repartition(7)
    got = {(x.stream_id, x.frame_no): x.samples for x in S.apply(df, S.DcReject()).collect()}
    for key in (1, None, 2**60 + 1):
        mine = [x for x in rows if x[0] == key]
        for (_, n, _), want in zip(mine, run(S.DcReject(), [x[2] or [] for x in mine])):
            assert got[key, n] == pytest.approx(want)
    assert len(got) == len(rows) and S.apply(df.limit(0), S.DcReject()).count() == 0


def test_batch_equals_stream(spark, tmp_path):
    r = np.random.default_rng(4)
    rows = [(s, n, r.normal(0, 1, 32).tolist()) for n in range(12) for s in range(5)]
    schema = "stream_id long, frame_no long, samples array<double>"
    for part in range(3):
        spark.createDataFrame([x for x in rows if x[1] // 4 == part], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for op in (S.SoftClip(), S.Smooth()):
        name = op.output.split(" ")[0]
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = S.stream(source, op).writeStream.format("memory").queryName(f"out_{name}").outputMode("append").option("checkpointLocation", str(tmp_path / f"c_{name}")).start()
        q.processAllAvailable()
        q.stop()
        got = {(x.stream_id, x.frame_no): x[name] for x in spark.sql(f"SELECT * FROM out_{name}").collect()}
        expected = {(x.stream_id, x.frame_no): x[name] for x in S.apply(spark.createDataFrame(rows, schema), op).collect()}
        assert got == pytest.approx(expected) if name == "smooth" else all(got[k] == pytest.approx(v) for k, v in expected.items())
        assert len(got) == len(rows)


def test_energies_are_near_and_a_decoder_keeps_up():
    r = np.random.default_rng(8)
    op = S.EnergyCode(0.8, 0.2, [0, 1, 2, 3, 0])
    frames = np.cumsum(r.normal(0, 2, (60, 5)), axis=0)
    state, old = op.start(), np.zeros(5)
    for n, frame in enumerate(frames):
        state, code = op.step(state, frame)
        # a decoder has the codes alone
        alpha, beta = (0.8, 0.2) if n else (0.0, 0.15)
        lower = 0.0
        for b in range(5):
            guess = alpha * max(old[b], -9) + lower
            lower += code[b] * (1 - beta)
            old[b] = max(guess + code[b], -28) + (code[5 + b] + 0.5) / 2 ** op.fine[b] - 0.5
            assert abs(old[b] - max(frame[b], -28.5)) <= 0.5 / 2 ** op.fine[b] + 1e-9
        assert state[1:] == pytest.approx(old.tolist())
    assert len(op.step(state, np.array([np.nan, 1.0]))[1]) == 10


def test_high_pass_cutoff_moves():
    op = S.HighPass(1, cutoff=200, start=60)
    state, seen = op.start(), []
    for _ in range(400):
        state, _ = op.step(state, np.zeros(4))
        seen.append(S.log2lin(int(state[0]) >> 8))
    assert seen[0] < 65 and seen == sorted(seen) and 190 <= seen[-1] <= 200
    still = S.HighPass(1)
    assert still.step(still.start(), np.zeros(4))[0][0] == still.start()[0]


def test_width_decays_in_silence_and_short_frames():
    op = S.StereoWidth()
    r = np.random.default_rng(3)
    state = op.start()
    for _ in range(60):
        state, width = op.step(state, r.normal(0, 0.4, 1920))
    assert width > 0.04
    short, _ = op.step(state, np.ones(6))
    assert short[0] < state[0] and short[2] < state[2]
    assert op.step(state, np.zeros(0))[0] == state
