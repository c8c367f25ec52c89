"""Queries over what an encoder chooses for a frame, with SQL that tries every choice."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonelake.functions import allocation, gains, lanes, pitch
from tonelake.plans import views
from tonelake.streaming import state

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


EDGES = [0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 14, 16, 20, 24, 28, 34, 40, 48, 60, 78, 100]
WIDTHS = [b - a for a, b in zip(EDGES, EDGES[1:])]
#: Curves of eleven qualities by a rule, and caps by width.
CURVES = [[max(0, 24 * k - 4 * j) for j in range(21)] for k in range(11)]
CAPS = [300 * w for w in WIDTHS]
NEED = [max(8, (3 * w) << 6 >> 4) for w in WIDTHS]
TABLE = [[(w * v) << 3 >> 2 for w, v in zip(WIDTHS, c)] for c in CURVES]


def _spent(bits: str, last: str) -> str:
    return f"list_transform({bits}, lambda x, i: CASE WHEN i <= {last} THEN least(x, {CAPS}[i]) WHEN x >= 8 THEN 8 ELSE 0 END)"


LAST = f"list_max(list_transform(b, lambda x, i: CASE WHEN x >= {NEED}[i] THEN i ELSE 0 END))"
TILTED = "list_transform({0}, lambda x, j: CASE WHEN x > 0 THEN greatest(x + tilt[j], 0) ELSE 0 END)"


@query(f"""WITH RECURSIVE v AS (SELECT vec_id, greatest(8 * (vec_id * 37 % 1500) - 8, 0) AS total, CASE WHEN vec_id * 37 % 1500 > 0 THEN 8 ELSE 0 END AS reserve, vec_id % 21 AS bw,
  list_transform(range(1, 22), lambda j: 8 * greatest(CAST(floor(3 * CAST(embedding[j] AS DOUBLE)) AS BIGINT) - j % 3, 0)) AS boosts,
  list_transform(range(1, 22), lambda j: (({WIDTHS}[j] * (21 - j) << 6) * (vec_id % 11 - 8)) >> 6) AS tilt FROM embeddings),
c AS (SELECT *, {LAST} AS last FROM (SELECT *, list_transform({TILTED.format(f"{TABLE}[k + 1]")}, lambda x, j: x + boosts[j]) AS b FROM v, (SELECT unnest(range(0, 11)) AS k))),
best AS (SELECT vec_id, coalesce(max(k) FILTER (k > 0 AND list_sum({_spent('b', 'last')}) <= total), 0) AS curve FROM c GROUP BY vec_id),
h AS (SELECT *, list_transform({TILTED.format(f"{TABLE}[curve + 1]")}, lambda x, j: x + CASE WHEN curve > 0 THEN boosts[j] ELSE 0 END) AS low,
  list_transform(list_transform(CASE WHEN curve = 10 THEN {CAPS} ELSE {TABLE}[least(curve + 2, 11)] END, lambda x, j: CASE WHEN x > 0 THEN greatest(x + tilt[j], 0) ELSE 0 END), lambda x, j: x + boosts[j]) AS high FROM v JOIN best USING (vec_id)),
s AS (SELECT *, {LAST} AS last FROM (SELECT *, list_transform(low, lambda x, j: x + ((greatest(high[j] - x, 0) * step) >> 6)) AS b FROM h, (SELECT unnest(range(0, 64)) AS step))),
found AS (SELECT vec_id, coalesce(max(step) FILTER (step > 0 AND list_sum({_spent('b', 'last')}) <= total), 0) AS step FROM s GROUP BY vec_id),
bits AS (SELECT vec_id, curve, step, total, reserve, bw, coalesce(list_max(list_transform(boosts, lambda x, j: CASE WHEN x > 0 THEN j - 1 ELSE 0 END)), 0) AS boosted, {_spent('b', 'last')} AS bits FROM s JOIN found USING (vec_id, step)),
skip AS (SELECT vec_id, 21 AS coded, CAST(list_sum(bits) AS BIGINT) AS used, total, false AS done, CAST([] AS BIGINT[]) AS top FROM bits
  UNION ALL SELECT vec_id, CASE WHEN stop THEN coded ELSE coded - 1 END, CASE WHEN stop THEN used ELSE used + flag - x + kept END, total + CASE WHEN stop AND j <= boosted THEN reserve ELSE 0 END, stop, CASE WHEN stop THEN top ELSE list_prepend(kept, top) END
  FROM (SELECT *, CASE WHEN mine - flag >= 8 THEN 8 ELSE 0 END AS kept, j <= boosted OR flag > 0 AND (coded <= 2 OR mine > ((CASE WHEN coded > 17 THEN 9 ELSE 0 END * w) << 6 >> 4) AND j <= bw) AS stop
    FROM (SELECT *, CASE WHEN mine >= greatest({NEED}[j + 1], 16) THEN 8 ELSE 0 END AS flag
      FROM (SELECT k.*, boosted, reserve, bw, k.coded - 1 AS j, bits[k.coded] AS x, {WIDTHS}[k.coded] AS w, bits[k.coded] + greatest(k.total - used, 0) // {EDGES}[k.coded + 1] * {WIDTHS}[k.coded]
          + greatest((k.total - used) - greatest(k.total - used, 0) // {EDGES}[k.coded + 1] * {EDGES}[k.coded + 1] - {EDGES}[k.coded], 0) AS mine
        FROM skip AS k JOIN bits USING (vec_id) WHERE NOT done AND k.coded > 0)))),
ended AS (SELECT vec_id, bits.curve, bits.step, skip.coded, bits.bits, skip.top, greatest(skip.total - used, 0) AS remaining FROM skip JOIN bits USING (vec_id) WHERE done)
SELECT vec_id, CAST(curve AS INTEGER) AS curve, CAST(step AS INTEGER) AS step, CAST(coded AS INTEGER) AS coded,
  list_concat(list_transform(list_slice(bits, 1, coded), lambda x, j: CAST(x + remaining // {EDGES}[coded + 1] * {WIDTHS}[j] + greatest(least({WIDTHS}[j], remaining % {EDGES}[coded + 1] - {EDGES}[j]), 0) AS BIGINT)), top) AS bits FROM ended""")
def bits_by_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bits of the bands of frames whose boosts, tilts and totals are drawn from vectors."""
    v = views.table(spark, sf_dir, "embeddings")
    boosts = F.transform(F.sequence(F.lit(1), F.lit(21)), lambda j: F.greatest(F.floor(F.element_at("embedding", j).cast("double") * 3) - j % 3, F.lit(0)) * 8)
    i = F.col("vec_id")
    found = v.select("vec_id", allocation.share_out(CURVES, EDGES, CAPS, boosts, i % 11, 8 * (i * 37 % 1500), i % 21).alias("x"))
    return found.select("vec_id", "x.curve", "x.step", "x.coded", "x.bits")


BANDS = 8
_cost = "list_sum(list_transform(range(1, 9), lambda j: w[j] * abs(m[j] - 2 * t[((p >> (j - 1)) & 1) + 1]) + CASE WHEN j > 1 AND ((p >> (j - 1)) & 1) <> ((p >> (j - 2)) & 1) THEN lam ELSE 0 END)) + CASE WHEN odd = 0 AND p & 1 = 1 THEN lam ELSE 0 END"


@query(f"""WITH v AS (SELECT vec_id, vec_id % 2 AS odd, vec_id % 6 AS lam, list_transform(range(1, 9), lambda j: greatest(least(CAST(floor(8 * CAST(embedding[j] AS DOUBLE)) AS BIGINT), 8), -8)) AS m, list_transform(range(1, 9), lambda j: 1 + vec_id * j % 13) AS w FROM embeddings),
t AS (SELECT * FROM (VALUES (0, 0, [0, -2]), (1, 0, [3, 0]), (1, 1, [1, -1])) AS t(odd, sel, t)),
c AS (SELECT vec_id, sel, p, {_cost} AS cost FROM v JOIN t USING (odd), (SELECT unnest(range(0, 256)) AS p)),
b AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY cost, sel, p DESC) AS o FROM c)
SELECT vec_id, CAST(sel AS INTEGER) AS sel, list_transform(range(0, 8), lambda j: CAST((p >> j) & 1 AS INTEGER)) AS path FROM b WHERE o = 1""")
def tf_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resolutions of eight bands, of steady and transient frames of 20 ms, with metrics drawn from vectors."""
    i = F.col("vec_id")
    metric = F.transform(F.sequence(F.lit(1), F.lit(BANDS)), lambda j: F.greatest(F.least(F.floor(F.element_at("embedding", j).cast("double") * 8), F.lit(8)), F.lit(-8)))
    weight = F.transform(F.sequence(F.lit(1), F.lit(BANDS)), lambda j: i * j % 13 + 1)
    v = views.table(spark, sf_dir, "embeddings").select("vec_id", metric.alias("m"), weight.alias("w"), (i % 6).alias("s"))
    one = lambda transient: allocation.time_frequency(F.col("m"), F.col("w"), F.col("s"), 3, transient)
    v = v.select("vec_id", F.when(F.col("vec_id") % 2 == 1, one(True)).otherwise(one(False)).alias("x"))
    return v.select("vec_id", F.col("x.select").alias("sel"), "x.path")


#: Cumulative counts of the symbols that packets are read as, and how many are read.
COUNTS, SYMBOLS = [0, 1, 3, 8, 16], 12


@query(f"""WITH RECURSIVE p AS (SELECT event_id, list_transform(range(0, 16), lambda k: CAST('0x' || substr(md5(CAST(event_id AS VARCHAR)), 2 * k + 1, 2) AS BIGINT)) AS b FROM events),
d AS (SELECT event_id, b, 0 AS n, CAST(4 AS BIGINT) AS pos, CAST(2147483648 AS BIGINT) AS rng,
    list_reduce(list_prepend(127 - (b[1] >> 1), list_transform(range(1, 4), lambda k: 255 - (((b[k] << 8 | b[k + 1]) >> 1) & 255))), lambda v, x: ((v << 8) + x) & 2147483647) AS val, CAST([] AS INTEGER[]) AS got FROM p
  UNION ALL SELECT event_id, b, n + 1, pos + few, CASE WHEN few = 1 THEN r << 8 ELSE r END,
    CASE WHEN few = 1 THEN ((v << 8) + 255 - (((b[pos] << 8 | coalesce(b[pos + 1], 0)) >> 1) & 255)) & 2147483647 ELSE v END, list_append(got, CAST(k - 1 AS INTEGER))
  FROM (SELECT *, CASE WHEN r <= 8388608 THEN 1 ELSE 0 END AS few FROM (
    SELECT *, val - part * (16 - {COUNTS}[k + 1]) AS v, CASE WHEN k > 1 THEN part * ({COUNTS}[k + 1] - {COUNTS}[k]) ELSE rng - part * (16 - {COUNTS}[k + 1]) END AS r FROM (
      SELECT *, len(list_filter({COUNTS}, lambda c: c <= 16 - least(val // part + 1, 16))) AS k FROM (SELECT *, rng // 16 AS part FROM d WHERE n < {SYMBOLS})))))
SELECT event_id, got AS symbols, rng AS final_range FROM d WHERE n = {SYMBOLS}""")
def range_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packets' bytes as range-coded symbols, and the decoder's last range."""
    p = views.packets(spark, sf_dir).select("event_id", lanes.decode_symbols(F.col("payload"), COUNTS, SYMBOLS).alias("x"))
    return p.select("event_id", "x.symbols", F.col("x.range").alias("final_range"))


@query("""SELECT event_id, list_transform(range(0, event_id % 20), lambda i: CAST((event_id + 3 * i * i) % 4 AS INTEGER)) AS symbols, true AS same_range, true AS exact_size FROM events""")
def range_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols range-coded into 24 bytes and read again, up to twenty of them behind a count of their own."""
    i = F.col("event_id")
    n = F.pmod(i, F.lit(20)).cast("int")
    made = F.transform(F.filter(F.sequence(F.lit(0), F.lit(19)), lambda k: k < n), lambda k: ((i + k * k * 3) % 4).cast("int"))
    # all lanes read twenty symbols, so that the shorter ones are filled up with the last one
    filled = F.concat(made, F.array_repeat(F.lit(3), 20 - n))
    e = views.table(spark, sf_dir, "events").select("event_id", n.alias("n"), lanes.encode_symbols(filled, COUNTS, 24).alias("e"))
    d = e.select("event_id", "n", F.col("e.range").alias("was"), F.octet_length("e.data").alias("size"), lanes.decode_symbols(F.col("e.data"), COUNTS, 20).alias("d"))
    return d.select("event_id", F.slice("d.symbols", F.lit(1), F.col("n")).alias("symbols"), (F.col("was") == F.col("d.range")).alias("same_range"), (F.col("size") == 24).alias("exact_size"))


@query("""WITH e AS (SELECT event_id, [event_id % 12 - 5, event_id % 7 - 3, event_id % 5 - 2, event_id % 3 - 1] AS y FROM events),
k AS (SELECT *, CAST(list_sum(list_transform(y, lambda x: abs(x))) AS BIGINT) AS k FROM e)
SELECT event_id, k = 6 AS fits, CASE WHEN k = 6 THEN list_transform(y, lambda x: CAST(x AS INTEGER)) END AS vector,
  CASE WHEN k = 6 THEN (SELECT count(*) FROM (SELECT unnest(range(-6, 7)) AS a), (SELECT unnest(range(-6, 7)) AS b), (SELECT unnest(range(-6, 7)) AS c), (SELECT unnest(range(-6, 7)) AS d)
    WHERE abs(a) + abs(b) + abs(c) + abs(d) = 6 AND [abs(a) * 2 + (a < 0)::INT, abs(b) * 2 + (b < 0)::INT, abs(c) * 2 + (c < 0)::INT, abs(d) * 2 + (d < 0)::INT]
      < list_transform(y, lambda x: abs(x) * 2 + (x < 0)::INT)) END AS place FROM k""")
def pulse_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of six pulses, their places among all of them, and back."""
    i = F.col("event_id")
    y = F.array(*[(F.pmod(i, F.lit(m)) - low).cast("int") for m, low in ((12, 5), (7, 3), (5, 2), (3, 1))])
    p = views.table(spark, sf_dir, "events").select("event_id", lanes.pulse_index(y, 4, 6).alias("place"))
    return p.select("event_id", F.col("place").isNotNull().alias("fits"), lanes.pulse_vector(F.col("place"), 4, 6).alias("vector"), "place")


ENERGY_BANDS, FINE = 6, [0, 1, 2, 3, 1, 0]


@query(f"""WITH RECURSIVE f AS (SELECT vec_id % 16 AS s, row_number() OVER (PARTITION BY vec_id % 16 ORDER BY vec_id) - 1 AS n, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
x AS (SELECT s, n * {ENERGY_BANDS} + b AS i, n, vec_id, b, e[b + 1] * 12 AS e FROM f, (SELECT unnest(range(0, {ENERGY_BANDS})) AS b)),
r AS (SELECT s, CAST(-1 AS BIGINT) AS i, list_transform(range(0, {ENERGY_BANDS}), lambda b: 0.0::DOUBLE) AS old, 0.0::DOUBLE AS lower, CAST(0 AS BIGINT) AS q, CAST(0 AS BIGINT) AS rest FROM (SELECT DISTINCT s FROM f)
  UNION ALL SELECT s, i, list_concat(list_concat(list_slice(old, 1, b), [reached + (rest + 0.5) / (1 << fine) - 0.5]), list_slice(old, b + 2, {ENERGY_BANDS})), low + q * (1 - CASE WHEN n = 0 THEN 0.15 ELSE 0.25 END), q, rest
  FROM (SELECT *, CAST(least(greatest(floor((e - reached + 0.5) * (1 << fine)), 0), (1 << fine) - 1) AS BIGINT) AS rest FROM (
    SELECT *, greatest(guess + q, -28.0) AS reached FROM (
      SELECT *, CAST(floor(e - guess + 0.5) AS BIGINT) AS q FROM (
        SELECT x.s, x.i, x.n, x.b, x.e, r.old, CASE WHEN x.b = 0 THEN 0.0::DOUBLE ELSE r.lower END AS low, {FINE}[x.b + 1] AS fine, CASE WHEN x.n = 0 THEN 0.0::DOUBLE ELSE 0.75::DOUBLE END * greatest(r.old[x.b + 1], -9.0) + CASE WHEN x.b = 0 THEN 0.0::DOUBLE ELSE r.lower END AS guess
        FROM r JOIN x ON x.s = r.s AND x.i = r.i + 1)))))
SELECT s AS stream_id, vec_id AS frame_no, list_concat(list(CAST(q AS INTEGER) ORDER BY b), list(CAST(rest AS INTEGER) ORDER BY b)) AS codes FROM r JOIN x USING (s, i) GROUP BY s, vec_id""")
def energy_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six band energies of each frame, coded along sixteen streams."""
    v = views.pcm(spark, sf_dir)
    frames = v.select(F.pmod("frame_id", F.lit(16)).alias("stream_id"), F.col("frame_id").alias("frame_no"), F.transform(F.slice("samples", 1, ENERGY_BANDS), lambda x: x.cast("double") * 12).alias("samples"))
    return state.apply(frames, state.EnergyCode(0.75, 0.25, FINE))


def _dot(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1] * z[2]))"


def _best(score: str, n: int) -> str:
    """The two best of scores (null for none) by SQL, the lesser of equal ones first."""
    order = f"list_transform(list_sort(list_filter(list_transform({score}, lambda v, i: {{'v': -v, 'i': i - 1}}), lambda z: z.v IS NOT NULL)), lambda z: z.i)"
    return f"list_slice(list_concat({order}, CASE WHEN len({order}) = 0 THEN [0, {min(1, n - 1)}] ELSE [0] END), 1, 2)"


@query(f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS y FROM embeddings),
a AS (SELECT *, list_transform(range(16), lambda j: y[33 + 2 * j]) AS x4, list_transform(range(32), lambda j: y[1 + 2 * j]) AS y4 FROM v),
c AS (SELECT *, list_transform(range(16), lambda k: {_dot("x4", "list_slice(y4, k + 1, k + 16)")}) AS r4, list_transform(range(16), lambda k: 1 + {_dot("list_slice(y4, k + 1, k + 16)", "list_slice(y4, k + 1, k + 16)")}) AS e4 FROM a),
n AS (SELECT vec_id, y, {_best("list_transform(range(16), lambda k: CASE WHEN r4[k + 1] > 0 THEN r4[k + 1] * r4[k + 1] / e4[k + 1] END)", 16)} AS near FROM c),
f AS (SELECT *, list_transform(range(32), lambda k: CASE WHEN abs(k - 2 * near[1]) <= 2 OR abs(k - 2 * near[2]) <= 2 THEN greatest({_dot("list_slice(y, 33, 64)", "list_slice(y, k + 1, k + 32)")}, -1) ELSE 0 END) AS r,
  list_transform(range(32), lambda k: 1 + {_dot("list_slice(y, k + 1, k + 32)", "list_slice(y, k + 1, k + 32)")}) AS e FROM n),
b AS (SELECT vec_id, r, ({_best("list_transform(range(32), lambda k: CASE WHEN r[k + 1] > 0 THEN r[k + 1] * r[k + 1] / e[k + 1] END)", 32)})[1] AS best FROM f)
SELECT vec_id, CAST(2 * best - CASE WHEN best NOT BETWEEN 1 AND 30 THEN 0 WHEN r[best + 2] - r[best] > 0.7 * (r[best + 1] - r[best]) THEN 1 WHEN r[best] - r[best + 2] > 0.7 * (r[best + 1] - r[best + 2]) THEN -1 ELSE 0 END AS INTEGER) AS lag FROM b""")
def pitch_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lag at which the last half of each vector is most like an earlier part."""
    return views.table(spark, sf_dir, "embeddings").select("vec_id", pitch.pitch_lag(F.col("embedding").cast("array<double>"), 64, 64).alias("lag"))


@query("""WITH RECURSIVE f AS (SELECT vec_id % 16 AS s, row_number() OVER (PARTITION BY vec_id % 16 ORDER BY vec_id) AS n, vec_id,
  list_transform(range(0, 32), lambda k: 6 * CAST(embedding[2 * k + 1] AS DOUBLE)) AS x, list_transform(range(0, 32), lambda k: 6 * CAST(embedding[2 * k + 2] AS DOUBLE)) AS y FROM embeddings),
e AS (SELECT s, n, vec_id, greatest(list_sum(list_transform(x, lambda v: v * v)), 1) AS xx, list_sum(list_transform(y, lambda v: v * v)) AS yy, list_sum(list_transform(list_zip(x, y), lambda z: z[1] * z[2])) AS xy FROM f),
p AS (SELECT *, least(greatest(floor(xy / xx * 8192) / 8192, -2), 2) AS k FROM e),
q AS (SELECT *, greatest(0.01::DOUBLE, k * k / 64) AS pace, sqrt(xx) AS mid, sqrt(greatest(yy - 2 * k * xy + k * k * xx, 0)) AS rest FROM p),
r AS (SELECT s, CAST(0 AS BIGINT) AS n, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b FROM (SELECT DISTINCT s FROM f)
  UNION ALL SELECT q.s, q.n, a + (mid - a) * pace, b + (rest - b) * pace FROM r JOIN q ON q.s = r.s AND q.n = r.n + 1)
SELECT s AS stream_id, vec_id AS frame_no, [CAST(k * 8192 AS INTEGER), CAST(least(floor(b / greatest(a, 1) * 16384), 32767) AS INTEGER)] AS predictor FROM r JOIN q USING (s, n)""")
def stereo_predictor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames taken as interleaved stereo: the second channel from the first, along sixteen streams."""
    v = views.pcm(spark, sf_dir)
    frames = v.select(F.pmod("frame_id", F.lit(16)).alias("stream_id"), F.col("frame_id").alias("frame_no"), F.transform("samples", lambda x: x.cast("double") * 6).alias("samples"))
    return state.apply(frames, state.StereoPredictor())


@query("""WITH f AS (SELECT vec_id % 16 AS stream_id, vec_id AS frame_no, (vec_id // 16) % 33 AS quiet FROM embeddings)
SELECT stream_id, frame_no, quiet > 10 AND (quiet - 11) % 21 < 20 AS skip FROM f""")
def dtx_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which frames of sixteen streams need no packet, where every 33rd is not silent."""
    v = views.pcm(spark, sf_dir)
    silent = F.pmod(F.floor(F.col("frame_id") / 16), F.lit(33)) > 0
    loud = F.transform("samples", lambda x: F.when(silent, 0.0).otherwise(x.cast("double")))
    return state.apply(v.select(F.pmod("frame_id", F.lit(16)).alias("stream_id"), F.col("frame_id").alias("frame_no"), loud.alias("samples")), state.Discontinuous())


_LEVEL = "greatest(least(greatest(2 * c{0} - 16, v{1} + c{0} - 4), 63), 0)"


@query(f"""WITH c AS (SELECT event_id, event_id % 64 AS v, event_id * 7 % 64 AS c0, event_id * 3 % 41 AS c1, event_id * 11 % 41 AS c2, event_id * 17 % 41 AS c3 FROM events),
a AS (SELECT *, greatest(c0, v - 16) AS v0 FROM c), b AS (SELECT *, {_LEVEL.format(1, 0)} AS v1 FROM a), d AS (SELECT *, {_LEVEL.format(2, 1)} AS v2 FROM b)
SELECT event_id, list_transform([v0, v1, v2, {_LEVEL.format(3, 2)}], lambda x: CAST(x AS INTEGER)) AS levels FROM d""")
def gain_dequantise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels of four gain codes a frame, and the one before, drawn from event numbers."""
    i = F.col("event_id")
    codes = F.array(*[F.pmod(i * m, F.lit(n)).cast("int") for m, n in ((7, 64), (3, 41), (11, 41), (17, 41))])
    return views.table(spark, sf_dir, "events").select("event_id", gains.dequantise(codes, F.pmod(i, F.lit(64)).cast("int"))["levels"].alias("levels"))


@query("""WITH RECURSIVE f AS (SELECT vec_id % 16 AS s, row_number() OVER (PARTITION BY vec_id % 16 ORDER BY vec_id) AS n, vec_id, list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) / len(embedding) AS m FROM embeddings),
r AS (SELECT s, n, m AS a FROM f WHERE n = 1 UNION ALL SELECT f.s, f.n, a + 0.5 * (m - a) FROM r JOIN f ON f.s = r.s AND f.n = r.n + 1)
SELECT s AS stream_id, vec_id AS frame_no, round(a, 6) AS smooth FROM r JOIN f USING (s, n)""")
def smooth_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smoothed means of the frames of sixteen streams."""
    v = views.pcm(spark, sf_dir)
    out = state.apply(v.select(F.pmod("frame_id", F.lit(16)).alias("stream_id"), F.col("frame_id").alias("frame_no"), "samples"), state.Smooth())
    return out.select("stream_id", "frame_no", F.round("smooth", 6).alias("smooth"))
