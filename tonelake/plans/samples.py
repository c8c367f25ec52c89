"""Queries over sample arrays and ordered signals, with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tonelake.functions import pcm
from tonelake.operators import streams
from tonelake.plans import views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

S = "s AS (SELECT vec_id AS frame_id, CAST(embedding AS DOUBLE[]) AS s FROM embeddings)"
#: Edges of eight equal bands.
BANDS = list(range(0, 65, 8))
#: Edges of the codec's bands at its smallest frame, enough for 13 bands.
EDGES = [0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 14, 16, 20]
MATRIX = [16384, 9459, -5461, 12000, 32767, -16384, 4096, 8192]
WINDOW = [round((i + 0.5) / 64, 6) for i in range(64)]


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def whole(arr: Column) -> list[Column]:
    """Size, sum and position-weighted sum of an array of whole numbers."""
    z = F.lit(0).cast("bigint")
    return [F.size(arr).alias("n"), F.aggregate(arr, z, lambda a, x: a + x).alias("sum"), F.aggregate(F.transform(arr, lambda x, i: x.cast("bigint") * (i + 1)), z, lambda a, x: a + x).alias("weighted")]


def real(arr: Column) -> list[Column]:
    return [F.size(arr).alias("n"), F.round(pcm.total(arr), 6).alias("sum"), F.round(pcm.total(F.transform(arr, lambda x, i: x * (i + 1))), 6).alias("weighted")]


def whole_sql(arr: str, more: str = "") -> str:
    return f"""WITH {S}{more}, a AS (SELECT frame_id, {arr} AS a FROM s)
SELECT frame_id, CAST(len(a) AS INTEGER) AS n, CAST(list_sum(a) AS BIGINT) AS sum, CAST(list_sum(list_transform(a, lambda x, i: x * i)) AS BIGINT) AS weighted FROM a"""


def real_sql(arr: str) -> str:
    return f"""WITH {S}, a AS (SELECT frame_id, {arr} AS a FROM s)
SELECT frame_id, CAST(len(a) AS INTEGER) AS n, round(list_sum(a), 6) AS sum, round(list_sum(list_transform(a, lambda x, i: x * i)), 6) AS weighted FROM a"""


def frames(spark: SparkSession, sf_dir: str, arr: Callable[[Column], Column], digest: Callable[[Column], list[Column]]) -> DataFrame:
    a = views.pcm(spark, sf_dir).select("frame_id", arr(F.col("samples")).alias("a"))
    return a.select("frame_id", *digest(F.col("a")))


@query(whole_sql("list_transform(s, lambda x: CAST((floor(x * 32767)::BIGINT + 32768) & 65535 AS BIGINT) - 32768)"))
def pcm_i16_rule_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    """16-bit samples by floor, wrapping."""
    return frames(spark, sf_dir, pcm.to_i16_floor, whole)


@query(whole_sql("list_transform(s, lambda x: CAST(round_even(greatest(least(x * 32768, 32767), -32768), 0) AS BIGINT))"))
def pcm_i16_rule_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """16-bit samples, half to even."""
    return frames(spark, sf_dir, pcm.to_i16_even, whole)


@query(whole_sql("list_transform(s, lambda x: CAST(greatest(least(round(x * 32768), 32767), -32768) AS BIGINT))"))
def pcm_i16_rule_c(spark: SparkSession, sf_dir: str) -> DataFrame:
    """16-bit samples, half away from zero."""
    return frames(spark, sf_dir, pcm.to_i16_away, whole)


@query(whole_sql("list_transform(s, lambda x: CAST(greatest(least(round_even(x * 8388608, 0), 2147483647), -2147483648) AS BIGINT))"))
def pcm_i24(spark: SparkSession, sf_dir: str) -> DataFrame:
    """24-bit samples."""
    return frames(spark, sf_dir, pcm.to_i24, whole)


@query(real_sql("flatten(list_transform(s, lambda x: [x, x, x]))"))
def pcm_upsample_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each sample three times."""
    return frames(spark, sf_dir, lambda s: pcm.repeat_each(pcm.doubles(s), 3), real)


def _mix_sql(n: int) -> str:
    left, right = pcm.DOWNMIX.get(n, ([1.0 - c % 2 for c in range(n)], [float(c % 2) for c in range(n)]))
    side = lambda w: " + ".join(f"s[f * {n} + {c + 1}] * {v!r}" for c, v in enumerate(w) if v)
    return f"SELECT frame_id, {n} AS channels, flatten(list_transform(range(0, len(s) // {n}), lambda f: [{side(left)}, {side(right)}])) AS a FROM s"


MIXED = (1, 2, 3, 4, 5, 6, 8)


@query(f"""WITH {S}, m AS ({" UNION ALL ".join(map(_mix_sql, MIXED))})
SELECT frame_id, channels, CAST(len(a) AS INTEGER) AS n, round(list_sum(a), 6) AS sum, round(list_sum(list_transform(a, lambda x, i: x * i)), 6) AS weighted FROM m""")
def pcm_downmix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stereo from one to six channels by table, and from eight by alternate sums."""
    a = views.pcm(spark, sf_dir).select("frame_id", F.explode(F.array(*[F.struct(F.lit(n).alias("channels"), pcm.downmix(F.col("samples"), n).alias("a")) for n in MIXED])).alias("m"))
    return a.select("frame_id", "m.channels", *real(F.col("m.a")))


@query(real_sql("flatten(list_transform(range(0, len(s) // 4), lambda f: [" + ", ".join(" + ".join(f"s[f * 4 + {c + 1}] * {MATRIX[2 * c + r] / 32768!r}" for c in range(4)) for r in range(2)) + "]))"))
def pcm_mix_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two channels from four by a Q15 matrix."""
    return frames(spark, sf_dir, lambda s: pcm.matrix_mix(s, 2, 4, MATRIX), real)


@query(f"""WITH {S}, d AS (SELECT unnest([1, 2, 8, 16]) AS depth) SELECT frame_id, depth, list_max(list_transform(s, lambda x: abs(x))) <= pow(2, -depth) AS silent FROM s, d""")
def pcm_silence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digital silence at four depths."""
    a = views.pcm(spark, sf_dir)
    return a.select("frame_id", F.explode(F.array(*[F.struct(F.lit(d).alias("depth"), pcm.is_silent(F.col("samples"), d).alias("silent")) for d in (1, 2, 8, 16)])).alias("x")).select("frame_id", "x.*")


@query(f"WITH {S} SELECT frame_id, round(list_sum(list_transform(s, lambda x: x * x)), 6) AS energy, round(list_sum(list_transform(s, lambda x, i: x * s[65 - i])), 6) AS reversed FROM s")
def pcm_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Energy, and the inner product with the reversed frame."""
    s = F.col("samples")
    return views.pcm(spark, sf_dir).select("frame_id", F.round(pcm.energy(s), 6).alias("energy"), F.round(pcm.inner_product(s, F.reverse(s)), 6).alias("reversed"))


AUTO = "list_sum(list_transform(range(1, 65 - {k}), lambda i: s[i] * s[i + {k}]))"


@query(f"""WITH {S} SELECT frame_id, lag, round(CASE lag {" ".join(f"WHEN {k} THEN {AUTO.format(k=k)}" for k in range(5))} END, 6) AS r FROM s, (SELECT unnest([0, 1, 2, 3, 4]) AS lag)""")
def pcm_autocorr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Autocorrelation at five lags."""
    a = views.pcm(spark, sf_dir)
    return a.select("frame_id", F.posexplode(F.array(*[F.round(pcm.autocorrelation(F.col("samples"), k), 6) for k in range(5)])).alias("lag", "r"))


@query(f"""WITH {S}, r AS (SELECT frame_id, unnest([{", ".join(f"{{'k': {k}, 'r': round({AUTO.format(k=k)}, 9)}}" for k in range(2, 17))}]) AS x FROM s),
n AS (SELECT frame_id, x.k AS k, row_number() OVER (PARTITION BY frame_id ORDER BY x.r DESC, x.k) AS i FROM r) SELECT frame_id, CAST(k AS INTEGER) AS lag FROM n WHERE i = 1""")
def pcm_best_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lag of the largest autocorrelation between 2 and 16."""
    return views.pcm(spark, sf_dir).select("frame_id", pcm.best_lag(F.col("samples"), 2, 16).alias("lag"))


@query(real_sql("list_transform(range(1, len(s) - 2), lambda i: s[i + 3] + s[i + 2] * 0.5 + s[i + 1] * -0.25 + s[i] * 0.125)"))
def pcm_fir(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filter of three taps."""
    return frames(spark, sf_dir, lambda s: pcm.fir(s, [0.5, -0.25, 0.125]), real)


@query(real_sql("list_transform(s, lambda x, i: x - 0.85 * CASE WHEN i > 1 THEN s[i - 1] ELSE 0 END)"))
def pcm_preemph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pre-emphasis within the frame."""
    return frames(spark, sf_dir, lambda s: pcm.pre_emphasis(s, 0.85), real)


@query(real_sql("list_transform(s, lambda x, i: x * pow(0.98, i))"))
def pcm_chirp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Geometric weights, as of bandwidth expansion."""
    return frames(spark, sf_dir, lambda s: pcm.chirp(s, 0.98), real)


@query(whole_sql("list_transform(q, lambda x, i: CAST(((x + ((CAST(((q[65 - i] - x) + 32768) & 65535 AS BIGINT) - 32768) * 3 >> 2)) + 32768) & 65535 AS BIGINT) - 32768)", ", t AS (SELECT 1)").replace(
    "FROM s)", "FROM (SELECT frame_id, list_transform(s, lambda x: CAST(round_even(greatest(least(x * 32768, 32767), -32768), 0) AS BIGINT)) AS q FROM s))"))
def pcm_interp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three quarters of the way from a 16-bit frame to its reverse."""
    q = views.pcm(spark, sf_dir).select("frame_id", pcm.to_i16_even(F.col("samples")).alias("q"))
    a = q.select("frame_id", pcm.interpolate(F.col("q"), F.reverse("q"), 3).alias("a"))
    return a.select("frame_id", *whole(F.col("a")))


@query(real_sql("list_transform(s, lambda x, i: w[i] * w[i] * s[65 - i] + (1 - w[i] * w[i]) * x)").replace("FROM s)", f"FROM s, (SELECT {WINDOW} AS w))"))
def pcm_fade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crossfade of a frame into its reverse."""
    return frames(spark, sf_dir, lambda s: pcm.smooth_fade(s, F.reverse(s), WINDOW), real)


@query(f"""WITH {S} SELECT frame_id, band, round(sqrt(1e-27 + list_sum(list_transform(list_slice(s, band * 8 + 1, band * 8 + 8), lambda x: x * x))), 6) AS energy FROM s, (SELECT CAST(b AS INTEGER) AS band FROM range(8) AS t(b))""")
def band_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amplitudes of eight bands."""
    a = views.pcm(spark, sf_dir).select("frame_id", F.posexplode(pcm.band_energy(F.col("samples"), BANDS)).alias("band", "energy"))
    return a.withColumn("energy", F.round("energy", 6))


@query(f"""WITH {S}, x AS (SELECT frame_id, list_sum(list_transform(range(1, 21), lambda i: abs(s[i]) + abs(s[32 + i]))) + 1e-15 AS lr,
  list_sum(list_transform(range(1, 21), lambda i: abs(s[i] + s[32 + i]) + abs(s[i] - s[32 + i]))) + 1e-15 AS ms FROM s)
SELECT frame_id, 45.0::DOUBLE * ms * 0.7071067811865476::DOUBLE > 40.0::DOUBLE * lr AS mid_side FROM x""")
def stereo_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether mid and side would code the two halves of a frame better than left and right."""
    s = F.col("samples")
    return views.pcm(spark, sf_dir).select("frame_id", pcm.prefers_mid_side(F.slice(s, 1, 32), F.slice(s, 33, 32), EDGES, 0).alias("mid_side"))


@query("""WITH o AS (SELECT user_id AS stream_id, value, row_number() OVER w AS pos, lag(value) OVER w AS v1, lag(value, 2) OVER w AS v2, lag(value, 3) OVER w AS v3
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT stream_id, pos, round(0.5 * value + 0.25 * coalesce(v1, value) + 0.125 * coalesce(v2, value) + 0.125 * coalesce(v3, value), 6) AS smooth FROM o""")
def ema_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A truncated exponential average over each stream's order."""
    w = Window.partitionBy("stream_id").orderBy("ts", "event_id")
    v = F.col("value")
    lag = lambda k: F.coalesce(F.lag(v, k).over(w), v)
    return views.signal(spark, sf_dir).select("stream_id", F.row_number().over(w).cast("bigint").alias("pos"), F.round(0.5 * v + 0.25 * lag(1) + 0.125 * lag(2) + 0.125 * lag(3), 6).alias("smooth"))


@query("""WITH o AS (SELECT user_id AS stream_id, value < 20 AS idle, row_number() OVER w AS pos, lag(value < 20) OVER w AS was FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT *, sum(CASE WHEN idle <> was THEN 1 ELSE 0 END) OVER (PARTITION BY stream_id ORDER BY pos) AS run FROM o)
SELECT stream_id, CAST(run AS BIGINT) AS run, idle, CAST(min(pos) AS BIGINT) AS first, CAST(max(pos) AS BIGINT) AS last, count(*) AS rows FROM r GROUP BY stream_id, run, idle""")
def dtx_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of quiet and of active rows of each stream."""
    s = views.signal(spark, sf_dir).withColumn("idle", F.col("value") < 20)
    r = streams.runs(s, stream="stream_id", order=("ts", "event_id"), flag="idle")
    return r.select("stream_id", F.col("run").cast("bigint").alias("run"), "idle", F.col("first").cast("bigint").alias("first"), F.col("last").cast("bigint").alias("last"), "rows")


@query(real_sql("list_transform(s, lambda x: x * pow(10, (frame_id % 2000 - 1000) / 5120.0))"))
def pcm_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames times gains in 1/256 dB."""
    a = views.pcm(spark, sf_dir).select("frame_id", pcm.apply_gain(F.col("samples"), F.pmod("frame_id", F.lit(2000)) - 1000).alias("a"))
    return a.select("frame_id", *real(F.col("a")))


FADE = [round((i + 0.5) / 16, 6) for i in range(16)]


@query(real_sql("list_transform(s, lambda x, i: x - (1 - (coalesce(w[(i + 1) // 2] * w[(i + 1) // 2], 1) * 0.25 + (1 - coalesce(w[(i + 1) // 2] * w[(i + 1) // 2], 1)) * 0.875)) * (x - s[CASE WHEN i % 2 = 1 THEN i + 1 ELSE i - 1 END]) * 0.5)").replace("FROM s)", f"FROM s, (SELECT {FADE} AS w))"))
def pcm_stereo_fade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The width of stereo frames faded from 7/8 to 1/4."""
    return frames(spark, sf_dir, lambda s: pcm.stereo_fade(s, 0.875, 0.25, FADE), real)


@query(f"""WITH {S}, q AS (SELECT frame_id, list_transform(s, lambda x: CAST(round_even(greatest(least(x * 32768, 32767), -32768), 0) AS INTEGER)) AS q FROM s), d AS (SELECT unnest([1, 8, 14, 15]) AS depth)
SELECT frame_id, depth, list_max(list_transform(q, lambda x: abs(x))) <= CASE WHEN depth >= 15 THEN 0 ELSE 1 << (15 - depth) END AS silent FROM q, d""")
def pcm_silence_i16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digital silence of 16-bit frames at four depths."""
    q = views.pcm(spark, sf_dir).select("frame_id", pcm.to_i16_even(F.col("samples")).alias("q"))
    return q.select("frame_id", F.explode(F.array(*[F.struct(F.lit(d).alias("depth"), pcm.is_silent_i16(F.col("q"), d).alias("silent")) for d in (1, 8, 14, 15)])).alias("x")).select("frame_id", "x.*")


@query(real_sql("list_slice(s, greatest(312 - frame_id * 64, 0) + 1, greatest(least(30001 - frame_id * 64, 64), 0))").replace("CAST(len(a) AS INTEGER) AS n, round(list_sum(a), 6)", "CAST(len(a) AS INTEGER) AS n, round(coalesce(list_sum(a), 0), 6)").replace("round(list_sum(list_transform", "round(coalesce(list_sum(list_transform").replace("lambda x, i: x * i)), 6)", "lambda x, i: x * i)), 0), 6)"))
def pcm_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of one stream without the first 312 samples and those from 30,001 on."""
    start = F.col("frame_id") * 64
    a = views.pcm(spark, sf_dir).select("frame_id", pcm.trim(pcm.doubles(F.col("samples")), start, F.lit(312).cast("bigint"), F.lit(30001).cast("bigint")).alias("a"))
    return a.select("frame_id", *real(F.col("a")))
