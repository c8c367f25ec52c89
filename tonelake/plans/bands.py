"""Queries over spectra, ambisonics and layouts, with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonelake.functions import ambisonics, bands, editing, layouts, pcm, signal, toc
from tonelake.operators import streams
from tonelake.plans import views
from tonelake.plans.samples import S, real
from tonelake.streaming import state

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The codec's bands that a frame of 64 holds.
EDGES = bands.EDGES[:20]
#: Wide bands, for rules that pass over narrow ones.
WIDE, WEIGHTS = [0, 12, 28, 46, 64], [3, 2, 2, 1]
WINDOW = [round((i + 0.5) / 16, 6) for i in range(16)]
DIGEST = "CAST(len(a) AS INTEGER) AS n, round(list_sum(a), 6) AS sum, round(list_sum(list_transform(a, lambda x, i: x * i)), 6) AS weighted"
AMPLITUDES = f"""t AS (SELECT frame_id, s, {EDGES} AS e FROM s),
amp AS (SELECT *, list_transform(range(1, 20), lambda b: sqrt(1e-27 + list_sum(list_transform(list_slice(s, e[b] + 1, e[b + 1]), lambda x: x * x)))) AS amp FROM t)"""


def query(sql: str):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


@query(f"""WITH {S}, {AMPLITUDES}, a AS (SELECT frame_id, flatten(list_transform(range(1, 20), lambda b: list_transform(list_slice(s, e[b] + 1, e[b + 1]), lambda x: x / (1e-27 + amp[b])))) AS a FROM amp)
SELECT frame_id, {DIGEST} FROM a""")
def band_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames as spectra of 19 bands of unit energy."""
    s = F.col("samples")
    a = views.pcm(spark, sf_dir).select("frame_id", bands.normalised(s, pcm.band_energy(s, EDGES), EDGES).alias("a"))
    return a.select("frame_id", *real(F.col("a")))


@query(f"""WITH {S}, {AMPLITUDES}, a AS (SELECT frame_id, list_concat(flatten(list_transform(range(1, 20), lambda b: list_transform(list_slice(s, e[b] + 1, e[b + 1]),
  lambda x: CASE WHEN b > 2 THEN x / (1e-27 + amp[b]) * pow(2, floor(log2(amp[b]) * 2 + 0.5) / 2) ELSE 0 END))), [0.0, 0, 0, 0]) AS a FROM amp) SELECT frame_id, {DIGEST} FROM a""")
def band_denormalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spectra from normalised bands and levels in half steps, without the lowest two bands."""
    s, amp = F.col("samples"), F.col("amp")
    means = F.array(*map(F.lit, bands.MEAN_ENERGIES))
    levels = F.transform(amp, lambda e, i: F.floor(F.log2(e) * 2 + 0.5) / 2 - F.get(means, i))
    a = views.pcm(spark, sf_dir).withColumn("amp", pcm.band_energy(s, EDGES)).select("frame_id", bands.denormalised(bands.normalised(s, amp, EDGES), levels, EDGES, start=2, length=64).alias("a"))
    return a.select("frame_id", *real(F.col("a")))


def _echo(period: int, gain: float, taps: int) -> str:
    middle, near, far = (gain * t for t in bands.COMB_TAPS[taps])
    return f"(s[p - {period}] * {middle!r}::DOUBLE + (s[p - {period - 1}] + s[p - {period + 1}]) * {near!r}::DOUBLE + (s[p - {period - 2}] + s[p - {period + 2}]) * {far!r}::DOUBLE)"


@query(f"""WITH {S}, a AS (SELECT frame_id, list_transform(range(25, 65), lambda p: s[p] + (1 - coalesce(w[p - 24] * w[p - 24], 1)) * {_echo(15, 0.5, 0)} + coalesce(w[p - 24] * w[p - 24], 1) * {_echo(20, 0.25, 1)}) AS a FROM s, (SELECT {WINDOW} AS w))
SELECT frame_id, {DIGEST} FROM a""")
def comb_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty samples with echoes of a period that turns from 12 (held to 15) to 20."""
    a = views.pcm(spark, sf_dir).select("frame_id", bands.comb_filter(F.col("samples"), 24, (12, 20), (0.5, 0.25), (0, 1), WINDOW).alias("a"))
    return a.select("frame_id", *real(F.col("a")))


@query(f"""WITH {S}, t AS (SELECT frame_id, list_transform(s, lambda x, i: x * coalesce(w[i], 1) * coalesce(w[65 - i], 1)) AS s FROM s, (SELECT {WINDOW} AS w))
SELECT frame_id, CAST(lag AS INTEGER) AS lag, round(list_sum(list_transform(range(1, 65 - lag), lambda i: s[i] * s[i + lag])), 6) AS r FROM t, range(0, 6) AS l(lag)""")
def tapered_autocorr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Autocorrelation of frames with tapered ends at six lags."""
    a = views.pcm(spark, sf_dir).select("frame_id", F.posexplode(bands.tapered_autocorrelation(F.col("samples"), 5, WINDOW)).alias("lag", "r"))
    return a.withColumn("r", F.round("r", 6))


@query(f"""WITH {S}, n AS (SELECT unnest([1, 2, 15, 64]) AS n), q AS (SELECT frame_id, n, list_transform(list_slice(s, 1, n), lambda x: CAST(round_even(greatest(least(x * 1048576, 32767), -32768), 0) AS BIGINT)) AS q FROM s, n),
p AS (SELECT *, list_transform(range(1, n + 1, 2), lambda i: q[i] * q[i] + coalesce(q[i + 1] * q[i + 1], 0)) AS p, CAST(floor(log2(n)) AS BIGINT) AS f FROM q),
r AS (SELECT *, length(ltrim(bin(CAST(n + list_sum(list_transform(p, lambda v: v >> f)) AS BIGINT)), '0')) AS b FROM p), h AS (SELECT *, greatest(f + 3 - 32 + b, 0) AS h FROM r)
SELECT frame_id, n, CAST(list_sum(list_transform(p, lambda v: v >> h)) AS BIGINT) AS energy, CAST(h AS INTEGER) AS shift FROM h""")
def energy_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Energies with headroom of loud 16-bit frames and of their beginnings."""
    q = pcm.to_i16_even(F.transform("samples", lambda x: x.cast("double") * 32))
    a = views.pcm(spark, sf_dir).select("frame_id", q.alias("q"))
    a = a.select("frame_id", F.explode(F.array(*[F.struct(F.lit(n).alias("n"), bands.energy_shift(F.slice("q", 1, n)).alias("e")) for n in (1, 2, 15, 64)])).alias("x"))
    return a.select("frame_id", "x.n", "x.e.energy", F.col("x.e.shift").alias("shift"))


@query(f"""WITH {S}, c AS (SELECT frame_id, k, list_sum(list_transform(range(1, 33), lambda i: s[i] * s[32 - k + i])) AS r, 1 + list_sum(list_transform(range(1, 33), lambda i: s[k + i] * s[k + i])) AS e0,
  list_sum(list_transform(range(1, 33), lambda i: s[32 + i] * s[k + i])) AS x FROM s, range(0, 32) AS l(k)),
o AS (SELECT frame_id, k, row_number() OVER (PARTITION BY frame_id ORDER BY round(-x * x / e0, 9), k) AS i FROM c WHERE x > 0), b AS (SELECT frame_id, max(CASE WHEN i = 1 THEN k END) AS f, max(CASE WHEN i = 2 THEN k END) AS g FROM o GROUP BY 1)
SELECT s.frame_id, CAST(coalesce(f, 0) AS INTEGER) AS first, CAST(coalesce(g, CASE WHEN f IS NULL THEN 1 ELSE 0 END) AS INTEGER) AS second FROM s LEFT JOIN b USING (frame_id)""")
def best_pitches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two lags at which a frame resembles its second half most."""
    s = F.col("samples")
    a = views.pcm(spark, sf_dir).select("frame_id", bands.best_pitches(F.slice(s, 33, 32), s, 32, 32).alias("p"))
    return a.select("frame_id", F.get("p", F.lit(0)).alias("first"), F.get("p", F.lit(1)).alias("second"))


@query(f"""WITH {S}, b AS (SELECT frame_id, s, unnest([1101, 1102, 1103]) AS bandwidth FROM s), g AS (SELECT *, CASE bandwidth WHEN 1101 THEN 13 WHEN 1102 THEN 15 ELSE 17 END AS n, CASE bandwidth WHEN 1101 THEN 8000 WHEN 1102 THEN 12000 ELSE 16000 END AS rate FROM b),
m AS (SELECT frame_id, bandwidth, n, rate, list_transform(list_concat(list_slice(s, 1, n), list_slice(s, 22, 21 + n)), lambda x: greatest(least(x * 4, 0.5), -2)) AS m FROM g)
SELECT frame_id, bandwidth, CAST(trunc((list_sum(list_transform(m, lambda x: CASE WHEN x > 0 THEN x / 2 ELSE x END)) / (2 * n) + 0.2) * rate) AS INTEGER) AS bits FROM m""")
def masking_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What masking adds to the rate of two channels, with frames as masks."""
    m = F.transform("samples", lambda x: x.cast("double") * 4)
    a = views.pcm(spark, sf_dir).select("frame_id", m.alias("m"))
    a = a.select("frame_id", F.explode(F.array(F.lit(1101), F.lit(1102), F.lit(1103))).alias("bandwidth"), "m")
    return a.select("frame_id", "bandwidth", bands.masking_offset(F.col("m"), 2, F.col("bandwidth")).alias("bits"))


R = "list_sum(list_transform(range(1, 65 - {k}), lambda i: s[i] * s[i + {k}]))"


@query(f"""WITH {S}, r AS (SELECT frame_id, {R.format(k=0)} AS r0, {R.format(k=1)} AS r1, {R.format(k=2)} AS r2 FROM s),
c AS (SELECT *, -r1 / greatest(r0, 1e-9) AS c0 FROM r), d AS (SELECT *, -(r2 + c0 * r1) / greatest(r0 + c0 * r1, 1e-9) AS c1 FROM c)
SELECT frame_id, round(c0, 6) AS c0, round(c1, 6) AS c1, round(r0 + c0 * r1 + c1 * (r2 + c0 * r1), 6) AS residual, round(-c0 - c1 * c0, 6) AS a0, round(-c1, 6) AS a1 FROM d""")
def reflection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two reflection coefficients, what they leave of the energy, and the prediction they stand for."""

    def fit(x):
        k, left = signal.schur(signal.autocorrelation(x, 2), 2)
        return [*k, left, *signal.step_up(k)]

    a = views.pcm(spark, sf_dir).select("frame_id", signal.array_udf(fit)(F.col("samples").cast("array<double>")).alias("a"))
    return a.select("frame_id", *[F.round(F.get("a", F.lit(i)), 6).alias(n) for i, n in enumerate(("c0", "c1", "residual", "a0", "a1"))])


def _small(cut: str) -> str:
    return f"CASE WHEN 2 * len(list_filter(list_slice(x, e[b] + 1, e[b + 1]), lambda v: v * v * (e[b + 1] - e[b]) < {cut})) >= e[b + 1] - e[b] THEN 1 ELSE 0 END"


@query(f"""WITH RECURSIVE {S}, t AS (SELECT frame_id, s AS x, {WIDE} AS e, {WEIGHTS} AS w FROM s),
p AS (SELECT frame_id, 256 * CAST(list_sum(list_transform(range(1, 5), lambda b: w[b] * ({_small("0.25")} + {_small("0.0625")} + {_small("0.015625")}))) AS BIGINT) // {sum(WEIGHTS)} AS score FROM t),
o AS (SELECT frame_id % 16 AS stream_id, frame_id AS frame_no, score, row_number() OVER (PARTITION BY frame_id % 16 ORDER BY frame_id) AS i FROM p),
z AS (SELECT stream_id, CAST(NULL AS BIGINT) AS frame_no, CAST(0 AS BIGINT) AS i, CAST(256 AS BIGINT) AS average, 2 AS spread FROM o WHERE i = 1
  UNION ALL SELECT n.stream_id, n.frame_no, n.i, n.average, CASE WHEN n.held < 80 THEN 3 WHEN n.held < 256 THEN 2 WHEN n.held < 384 THEN 1 ELSE 0 END
  FROM (SELECT o.stream_id, o.frame_no, o.i, (o.score + z.average) // 2 AS average, (3 * ((o.score + z.average) // 2) + (3 - z.spread) * 128 + 66) // 4 AS held FROM z JOIN o ON o.stream_id = z.stream_id AND o.i = z.i + 1) AS n)
SELECT stream_id, frame_no, spread FROM z WHERE i > 0""")
def spreading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the pulses of frames are spread, 16 streams of them, each frame taken as a spectrum."""
    rows = views.pcm(spark, sf_dir).select(F.pmod("frame_id", F.lit(16)).alias("stream_id"), F.col("frame_id").alias("frame_no"), "samples")
    return state.apply(rows, state.Spreading(WIDE, WEIGHTS))


def _product(order: int, cells: list[int]) -> str:
    n = (order + 1) ** 2 + 2
    row = lambda r: " + ".join(f"s[f * {n} + {c + 1}] * {cells[n * c + r]}" for c in range(n) if cells[n * c + r]) or "0"
    return f"flatten(list_transform(range(0, len(s) // {n}), lambda f: [{', '.join('(' + row(r) + ') / 32768.0::DOUBLE' for r in range(n))}]))"


KINDS = [("mix", ambisonics.MIXING), ("unmix", ambisonics.DEMIXING)]


@query(f"""WITH {S}, a AS ({" UNION ALL ".join(f"SELECT frame_id, {o} AS ambisonic_order, '{k}' AS kind, {_product(o, t[o])} AS a FROM s" for o in (1, 2) for k, t in KINDS)})
SELECT frame_id, ambisonic_order, kind, {DIGEST} FROM a""")
def ambisonic_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames as interleaved spheres of the first and second order through the mixing and demixing matrices."""
    s = F.col("samples")
    made = [F.struct(F.lit(o).alias("ambisonic_order"), F.lit(k).alias("kind"), pcm.matrix_mix(s, (o + 1) ** 2 + 2, (o + 1) ** 2 + 2, t[o]).alias("a")) for o in (1, 2) for k, t in KINDS]
    a = views.pcm(spark, sf_dir).select("frame_id", F.explode(F.array(*made)).alias("x"))
    return a.select("frame_id", "x.ambisonic_order", "x.kind", *real(F.col("x.a")))


CHANNELS = views.Drawn(channels=range(261))


@query(f"""WITH c AS (SELECT *, CAST(floor(sqrt(channels)) AS INTEGER) AS q FROM ({CHANNELS.sql})), k AS (SELECT *, q BETWEEN 2 AND 6 AND channels - q * q IN (0, 2) AS ok, 2 * (q * q + 2) * (q * q + 2) AS cells FROM c)
SELECT event_id, channels, CASE WHEN ok THEN q - 1 END AS ambisonic_order, CASE WHEN ok THEN (channels + 1) // 2 END AS streams, CASE WHEN ok THEN channels // 2 END AS coupled, CASE WHEN ok THEN 16 + (cells + 7) // 8 * 8 END AS matrix_bytes,
  CASE WHEN channels <= 255 AND channels * 127 * 2 <= 65004 THEN 16 + (channels * 254 + 7) // 8 * 8 END AS by_127 FROM k""")
def projection_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projection layouts of channel counts drawn from event numbers, and sizes of matrices of 127 columns."""
    c = CHANNELS.frame(spark, sf_dir).withColumn("p", ambisonics.projection_layout(F.col("channels")))
    return c.select("event_id", "channels", F.col("p.order").alias("ambisonic_order"), F.col("p.streams").alias("streams"), F.col("p.coupled").alias("coupled"), F.col("p.matrix_bytes").alias("matrix_bytes"), ambisonics.matrix_bytes(F.col("channels"), F.lit(127)).alias("by_127"))


SURROUND = " ".join(f"WHEN {n} THEN {{'streams': {s}, 'coupled': {c}, 'mapping': CAST({m} AS INTEGER[])}}" for n, (s, c, m) in layouts.SURROUND.items())


FAMILIES = views.Drawn(channels=range(261), family=[0, 1, 2, 3, 255])


#: The layout of each family and channel count in SQL.
LAYOUTS = f"""g AS (SELECT *, CAST(pow(floor(sqrt(channels)), 2) AS INTEGER) AS q FROM ({FAMILIES.sql})),
k AS (SELECT *, CASE WHEN channels > q THEN 1 ELSE 0 END AS c FROM g),
l AS (SELECT event_id, channels, family, CASE
  WHEN family = 0 AND channels IN (1, 2) THEN {{'streams': 1, 'coupled': channels - 1, 'mapping': CAST(range(0, channels) AS INTEGER[])}}
  WHEN family = 1 THEN CASE channels {SURROUND} END
  WHEN family = 2 AND channels BETWEEN 1 AND 227 AND channels - q IN (0, 2) THEN {{'streams': q + c, 'coupled': c, 'mapping': CAST(list_concat(range(2 * c, q + 2 * c), range(0, 2 * c)) AS INTEGER[])}}
  WHEN family = 255 AND channels BETWEEN 1 AND 255 THEN {{'streams': channels, 'coupled': 0, 'mapping': CAST(range(0, channels) AS INTEGER[])}} END AS l FROM k)"""


@query(f"""WITH {LAYOUTS}
SELECT event_id, channels, family, l.streams AS streams, l.coupled AS coupled, l.mapping AS mapping FROM l""")
def family_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layouts of families and channel counts drawn from event numbers."""
    c = FAMILIES.frame(spark, sf_dir)
    return c.withColumn("l", ambisonics.layout_of(F.col("channels"), F.col("family"))).select("event_id", "channels", "family", "l.streams", "l.coupled", "l.mapping")


@query(f"""WITH {LAYOUTS}
SELECT event_id, channels < 256 AND (family = 0 OR family IN (1, 2, 255) AND l IS NOT NULL) AS made,
  CASE WHEN channels < 256 AND family = 0 OR family IN (1, 2, 255) AND l IS NOT NULL THEN '4F7075734865616401' || printf('%02X', channels) || '380180BB000000FF' || printf('%02X', family)
    || CASE WHEN family = 0 THEN '' ELSE printf('%02X', l.streams) || printf('%02X', l.coupled) || array_to_string(list_transform(l.mapping, lambda m: printf('%02X', m)), '') END END AS head FROM l""")
def head_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identification headers of families and channel counts drawn from event numbers, with a gain of -1 dB; null where there is no layout."""
    c = FAMILIES.frame(spark, sf_dir).withColumn("l", ambisonics.layout_of(F.col("channels"), F.col("family")))
    head = F.when((F.col("family") != 3) & (F.col("channels") < 256), editing.identification_header(F.col("channels"), F.lit(312), F.lit(48000), F.lit(-256), F.col("family"), F.col("l")))
    return c.select("event_id", head.isNotNull().alias("made"), F.hex(head).alias("head"))


FRAME_BYTES = views.Drawn(size=range(1276))


@query(f"""SELECT event_id, size, CASE WHEN size < 252 THEN printf('%02X', size) ELSE printf('%02X', 252 + size % 4) || printf('%02X', (size - 252 - size % 4) // 4) END AS field FROM ({FRAME_BYTES.sql})""")
def length_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length fields of frame sizes drawn from event numbers."""
    return FRAME_BYTES.frame(spark, sf_dir).withColumn("field", toc.write_length(F.col("size")))


@query("""WITH e AS (SELECT event_id, CAST('0x' || substr(md5(CAST(event_id AS VARCHAR)), 1, 2) AS INTEGER) AS t, CAST('0x' || substr(md5(CAST(event_id AS VARCHAR)), 3, 2) AS INTEGER) AS b FROM events),
m AS (SELECT event_id, t, b, CASE WHEN t >= 128 THEN 'CELT' WHEN t >= 96 THEN 'HYBRID' ELSE 'SILK' END AS mode FROM e)
SELECT event_id, mode, CAST(CASE mode WHEN 'CELT' THEN list_extract([1101, 1103, 1104, 1105], (t >> 5) % 4 + 1) WHEN 'HYBRID' THEN 1104 + (t >> 4) % 2 ELSE 1101 + (t >> 5) END AS INTEGER) AS bandwidth_id,
  CAST(CASE mode WHEN 'CELT' THEN 120 << ((t >> 3) % 4) WHEN 'HYBRID' THEN 480 << ((t >> 3) % 2) ELSE list_extract([480, 960, 1920, 2880], (t >> 3) % 4 + 1) END AS INTEGER) AS frame_samples,
  CAST(1 + (t >> 2) % 2 AS INTEGER) AS channels, CAST(list_extract([1, 2, 2, b % 64], t % 4 + 1) AS INTEGER) AS frames FROM m""")
def packet_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a decoder's front end tells of a packet before it decodes."""
    return views.packets(spark, sf_dir).select("event_id", toc.metadata(F.col("payload")).alias("m")).select("event_id", "m.*")


@query("""WITH f AS (SELECT vec_id % 16 AS stream_id, vec_id AS frame_no, CAST(embedding AS DOUBLE[]) AS s, CAST(lag(embedding) OVER (PARTITION BY vec_id % 16 ORDER BY vec_id) AS DOUBLE[]) AS p FROM embeddings),
a AS (SELECT stream_id, frame_no, list_concat(coalesce(list_slice(p, 53, 64), list_transform(range(0, 12), lambda i: 0.0::DOUBLE)), list_slice(s, 1, 52)) AS a FROM f)
SELECT stream_id, frame_no, CAST(len(a) AS INTEGER) AS n, round(list_sum(a), 6) AS sum, round(list_sum(list_transform(a, lambda x, i: x * i)), 6) AS weighted FROM a""")
def delay_buffer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams delayed by 12 samples, frame by frame."""
    rows = views.pcm(spark, sf_dir).select(F.pmod("frame_id", F.lit(16)).alias("stream_id"), F.col("frame_id").alias("frame_no"), "samples")
    return streams.delayed(rows, 12, order="frame_no").select("stream_id", "frame_no", *real(F.col("samples")))


@query("""SELECT doc_id, ['TITLE=' || lang, 'Source=' || source] AS comments, CASE WHEN doc_id % 2 = 1 THEN printf('%02X', doc_id % 256) END AS suffix, CASE WHEN doc_id % 2 = 1 THEN 0 ELSE -131 END AS error_code FROM documents""")
def tags_added(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments added to a list, and suffixes, of which those that begin with an even byte are refused."""
    docs = views.table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    some = streams.with_comment(F.array(F.concat(F.lit("TITLE="), "lang")), F.lit("Source"), F.col("source"))
    suffix = streams.binary_suffix(F.unhex(F.lpad(F.hex(F.pmod("doc_id", F.lit(256))), 2, "0")))
    return docs.select("doc_id", some.alias("comments"), suffix.alias("x")).select("doc_id", "comments", F.hex("x.suffix").alias("suffix"), "x.error_code")


ORACLES_FOR_KERNELS = {
    "mdct_energy": f"""WITH {S}, w AS (SELECT frame_id, list_transform(s, lambda x, i: x * sin(pi() / 2 * pow(sin(pi() / 2 * (least(i, 65 - i) - 0.5) / 32), 2))) AS s FROM s),
c AS (SELECT frame_id, k, sqrt(2 / 32.0::DOUBLE) * list_sum(list_transform(s, lambda x, i: x * cos(pi() / 32 * (i - 0.5 + 16) * (k + 0.5)))) AS c FROM w, range(0, 32) AS r(k))
SELECT frame_id, CAST(k // 8 AS INTEGER) AS quarter, round(sum(c * c), 6) AS energy FROM c GROUP BY 1, 2""",
    "dc_reject": f"""WITH {S}, x AS (SELECT frame_id % 16 AS stream_id, frame_id AS frame_no, unnest(s) * 6 AS x, unnest(range(1, 65)) AS i FROM s),
o AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY frame_no, i) AS n FROM x), k AS (SELECT 6.3::DOUBLE * 3 / 48000 AS k),
m AS (SELECT stream_id, frame_no, x - coalesce(k * pow(1 - k, n - 1) * sum(x / pow(1 - k, n)) OVER (PARTITION BY stream_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS y FROM o, k)
SELECT stream_id, frame_no, round(sum(y), 6) AS sum FROM m GROUP BY 1, 2""",
}
ORACLES |= ORACLES_FOR_KERNELS
