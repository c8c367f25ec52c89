"""Queries over packet editing, headers, chained links and integer mixes, with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tonelake.functions import editing, gains, kernels, pcm, rules
from tonelake.operators import streams
from tonelake.plans import views
from tonelake.plans.samples import MATRIX

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "events").select("event_id", F.md5(F.col("event_id").cast("string")).alias("h"))


def many_frames(n: Column, h: Column) -> Column:
    """A packet of ``n`` frames of two bytes (20 ms, narrowband), as bytes."""
    return F.unhex(F.concat(F.lit("0B"), F.lpad(F.hex(n), 2, "0"), F.upper(F.substring(h, F.lit(1), n * 4))))


N = "event_id % 4 + 3"


@query(f"""WITH e AS (SELECT event_id, CAST({N} AS INTEGER) AS n, upper(md5(CAST(event_id AS VARCHAR))) AS h, CAST(event_id % 3 AS INTEGER) AS b FROM events),
k AS (SELECT *, n - b AS k, substr(h, b * 4 + 1, (n - b) * 4) AS body FROM e)
SELECT event_id, CASE k WHEN 1 THEN '08' WHEN 2 THEN '09' ELSE '0B0' || k END || body AS packet, 0 AS error_code FROM k""")
def packet_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frames from the first, second or third on of packets of three to six frames."""
    n = (F.pmod("event_id", F.lit(4)) + 3).cast("int")
    e = events(spark, sf_dir).select("event_id", editing.frame_range(F.array(many_frames(n, F.col("h"))), F.pmod("event_id", F.lit(3)), n).alias("p"))
    return e.select("event_id", F.hex("p.data").alias("packet"), F.col("p.error_code").alias("error_code"))


@query("""WITH e AS (SELECT event_id, upper(md5(CAST(event_id AS VARCHAR))) AS h, event_id % 5 AS m FROM events)
SELECT event_id, CASE WHEN m = 4 THEN NULL ELSE '09' || substr(h, 1, 8) || substr(h, 9, 8) END AS packet, CAST(CASE WHEN m = 4 THEN -4 ELSE 0 END AS INTEGER) AS error_code FROM e""")
def packet_cat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two packets of one frame made one of two; every fifth pair disagrees in bandwidth."""
    one = lambda toc, at: F.unhex(F.concat(toc, F.upper(F.substring("h", at, 8))))
    second = F.when(F.pmod("event_id", F.lit(5)) == 4, "28").otherwise("08")
    e = events(spark, sf_dir).select("event_id", editing.frame_range(F.array(one(F.lit("08"), 1), one(second, 9)), F.lit(0), F.lit(2)).alias("p"))
    return e.select("event_id", F.hex("p.data").alias("packet"), F.col("p.error_code").alias("error_code"))


@query("""SELECT event_id, CAST(17 + event_id % 300 AS INTEGER) AS padded, upper('08' || md5(CAST(event_id AS VARCHAR))) AS packet, -1 AS shorter FROM events""")
def packet_pad_unpad(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets of one frame padded to lengths drawn from event numbers, and unpadded again."""
    e = events(spark, sf_dir).select("event_id", F.unhex(F.concat(F.lit("08"), "h")).alias("x"))
    p = e.select("event_id", editing.pad(F.col("x"), F.pmod("event_id", F.lit(300)) + 17).alias("p"), editing.pad(F.col("x"), F.lit(3)).alias("s"))
    return p.select("event_id", F.octet_length("p.data").alias("padded"), F.hex(editing.unpad(F.col("p.data"))["data"]).alias("packet"), F.col("s.error_code").alias("shorter"))


@query("""WITH e AS (SELECT event_id, upper(md5(CAST(event_id AS VARCHAR))) AS h FROM events)
SELECT event_id, CAST(60 + event_id % 40 AS INTEGER) AS padded, '0808' || substr(h, 1, 16) || '08' || substr(h, 17, 16) AS packet FROM e""")
def multistream_pad_unpad(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets of two streams, the first self-delimited, padded and unpadded again."""
    h = lambda at: F.upper(F.substring("h", at, 16))
    two = F.unhex(F.concat(F.lit("0808"), h(1), F.lit("08"), h(17)))
    p = events(spark, sf_dir).select("event_id", editing.pad(two, F.pmod("event_id", F.lit(40)) + 60, 2)["data"].alias("p"))
    return p.select("event_id", F.octet_length("p").alias("padded"), F.hex(editing.unpad(F.col("p"), 2)["data"]).alias("packet"))


@query("""WITH e AS (SELECT event_id, upper(md5(CAST(event_id AS VARCHAR))) AS h, CAST(event_id % 4 AS INTEGER) AS f FROM events)
SELECT event_id, 3 AS n, [f, f + 1, f + 3] AS frames, [3, 32, 40] AS ids, [substr(h, 1, 2), substr(h, 3, 8), substr(h, 11, 4)] AS data FROM e""")
def extensions_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three extensions of later and earlier frames written, counted, read and put in the order of frames."""
    f = F.pmod("event_id", F.lit(4)).cast("int")
    item = lambda i, frame, at, n: F.struct(F.lit(i).alias("id"), frame.alias("frame"), F.unhex(F.substring("h", at, n)).alias("data"))
    items = F.array(item(40, f + 3, 11, 4), item(3, f, 1, 2), item(32, f + 1, 3, 8))
    x = events(spark, sf_dir).select("event_id", editing.extension_bytes(items, F.lit(7), F.lit(24))["data"].alias("x"))
    x = x.select("event_id", editing.extension_count(F.col("x"), F.lit(7)).alias("n"), editing.by_frame(kernels.extensions_udf()(F.col("x"), F.lit(7))).alias("e"))
    return x.select("event_id", "n", F.transform("e", lambda e: e["frame"]).alias("frames"), F.transform("e", lambda e: e["id"]).alias("ids"), F.transform("e", lambda e: F.hex(e["data"])).alias("data"))


@query("""WITH e AS (SELECT event_id, upper(md5(CAST(event_id AS VARCHAR))) AS h, CAST(event_id % 3 + 1 AS INTEGER) AS n FROM events),
x AS (SELECT *, f, k FROM e, (SELECT unnest(range(0, 3)) AS f), (SELECT unnest(range(0, 2)) AS k) WHERE f < n OR event_id % 2 = 0)
SELECT event_id, CAST(CASE k WHEN 0 THEN 5 ELSE 60 END AS INTEGER) AS id, CAST(f AS INTEGER) AS frame, CASE k WHEN 0 THEN substr(h, 2 * f + 1, 2) ELSE substr(h, 8 + 4 * f, 2 * (f + 1)) END AS data, 0 AS error_code FROM x""")
def extension_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A short and a long extension of one to three frames, written with repeats where all frames have them, and joined row by row in SQL."""
    kernels.extension_table(spark)
    n = F.when(F.pmod("event_id", F.lit(2)) == 0, 3).otherwise(F.pmod("event_id", F.lit(3)) + 1)
    # each hex text is cut to whole bytes
    item = lambda f: F.array(F.struct(F.lit(5).alias("id"), f.alias("frame"), F.unhex(F.substring("h", f * 2 + 1, F.lit(2))).alias("data")), F.struct(F.lit(60).alias("id"), f.alias("frame"), F.unhex(F.substring("h", f * 4 + 8, (f + 1) * 2)).alias("data")))
    items = F.flatten(F.transform(F.sequence(F.lit(0), n.cast("int") - 1), item))
    events(spark, sf_dir).select("event_id", editing.extension_bytes(items, F.lit(3), F.lit(0))["data"].alias("padding")).createOrReplaceTempView("tonelake_padding")
    return spark.sql("SELECT event_id, x.id, x.frame, hex(x.data) AS data, x.error_code FROM tonelake_padding, LATERAL packet_extensions(padding, 3) AS x")


@query("""SELECT event_id, CAST(event_id % 4 + 1 AS INTEGER) AS frames, CASE WHEN event_id % 3 > 0 THEN upper(substr(md5(CAST(event_id AS VARCHAR)), 1, 2 + 2 * CAST(event_id % 7 AS INTEGER))) END AS payload,
  CAST(CASE WHEN event_id % 3 > 0 THEN 8 * (event_id // 4 % (event_id % 4 + 1)) END AS INTEGER) AS frame_offset, 0 AS error_code FROM events""")
def redundancy_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Redundancy in the padding of packets of one to four frames, behind extensions of the same id without its mark; every third has none."""
    i = F.col("event_id")
    n = (F.pmod(i, F.lit(4)) + 1).cast("int")
    frame = F.pmod(F.floor(i / 4), n).cast("int")
    payload = F.unhex(F.concat(F.lit("440A"), F.substring("h", F.lit(1), (F.pmod(i, F.lit(7)) * 2 + 2).cast("int"))))
    other = F.struct(F.lit(126).alias("id"), F.lit(0).alias("frame"), F.unhex(F.lit("4409AA")).alias("data"))
    real = F.struct(F.lit(126).alias("id"), frame.alias("frame"), payload.alias("data"))
    items = F.when(F.pmod(i, F.lit(3)) > 0, F.array(other, real)).otherwise(F.array(other))
    e = events(spark, sf_dir).select("event_id", n.alias("n"), "h", editing.extension_bytes(items, n, F.lit(0))["data"].alias("padding"))
    # a packet of n frames of two bytes with the padding behind them
    packet = F.concat(F.unhex(F.concat(F.lit("0B"), F.lpad(F.hex(F.col("n") + 64), 2, "0"), F.lpad(F.hex(F.octet_length("padding")), 2, "0"), F.substring("h", F.lit(1), F.col("n") * 4))), F.col("padding"))
    return e.select("event_id", F.col("n").alias("frames"), kernels.redundancy_udf()(packet).alias("r")).select("event_id", "frames", F.hex("r.payload").alias("payload"), "r.frame_offset", "r.error_code")


@query("""SELECT event_id, CAST(event_id % 2 + 1 AS INTEGER) AS channels, CAST(event_id % 4000 AS INTEGER) AS pre_skip, CAST(8000 * (event_id % 6 + 1) AS BIGINT) AS rate,
  CAST(event_id % 65536 - 32768 AS INTEGER) AS gain, 0 AS error_code FROM events""")
def head_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identification headers written and parsed."""
    i = F.col("event_id")
    head = editing.identification_header(F.pmod(i, F.lit(2)) + 1, F.pmod(i, F.lit(4000)), (F.pmod(i, F.lit(6)) + 1) * 8000, F.pmod(i, F.lit(65536)) - 32768)
    h = views.table(spark, sf_dir, "events").select("event_id", kernels.head_udf()(head).alias("h"))
    return h.select("event_id", "h.channels", "h.pre_skip", "h.rate", "h.gain", "h.error_code")


@query("""SELECT doc_id, 'tool ' || lang AS vendor, CAST(1 + doc_id % 3 AS INTEGER) AS n, CASE doc_id % 3 WHEN 0 THEN 'TITLE=' || source WHEN 1 THEN 'ARTIST=' || lang ELSE 'COMMENT=' || left(text, 300) END AS last FROM documents""")
def tags_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comment headers of one to three comments, the longest a text's beginning, written and parsed."""
    docs = views.table(spark, sf_dir, "documents")
    every = F.array(F.concat(F.lit("TITLE="), "source"), F.concat(F.lit("ARTIST="), "lang"), F.concat(F.lit("COMMENT="), F.substring("text", 1, 300)))
    n = (F.pmod("doc_id", F.lit(3)) + 1).cast("int")
    t = docs.select("doc_id", kernels.tags_udf()(editing.comment_header(F.concat(F.lit("tool "), "lang"), F.slice(every, F.lit(1), n))).alias("t"))
    return t.select("doc_id", F.col("t.vendor").cast("string").alias("vendor"), F.size("t.comments").alias("n"), F.element_at("t.comments", -1).cast("string").alias("last"))


LINKS = """l AS (SELECT l_orderkey AS link, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS n FROM lineitem GROUP BY 1),
i AS (SELECT link, CAST(sum(n) OVER (ORDER BY link) - n AS BIGINT) AS start, CAST(sum(n) OVER (ORDER BY link) AS BIGINT) AS stop FROM l)"""


@query(f"""WITH {LINKS}, q AS (SELECT DISTINCT event_id * 173 AS at FROM events), e AS (SELECT max(stop) AS e FROM i)
SELECT x.at AS at, CASE WHEN x.at <= e THEN link END AS link, CASE WHEN x.at <= e THEN x.at - start END AS local, CAST(CASE WHEN x.at <= e THEN 0 ELSE -131 END AS INTEGER) AS error_code
FROM (SELECT q.at AS at, i.link, i.start FROM q ASOF LEFT JOIN i ON i.start <= q.at) AS x, e""")
def pcm_seek(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The link and the sample in it at each position of a chain."""
    links = streams.link_intervals(views.pages(spark, sf_dir)).withColumnRenamed("serial", "link")
    at = views.table(spark, sf_dir, "events").select((F.col("event_id") * 173).alias("at")).distinct()
    return streams.pcm_seek(links, at, at="at", width=1 << 12)


@query("""SELECT l_orderkey AS serial, l_linenumber AS seq, l_partkey, l_suppkey, CASE WHEN l_quantity = 7 THEN NULL ELSE CAST(l_quantity AS BIGINT) - 3 END AS sample FROM lineitem""")
def granule_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples at granule positions; pages with 7 stand for those on which no packet ends."""
    p = views.pages(spark, sf_dir)
    granule = F.when(F.col("granule") == 7, -1).otherwise(F.col("granule"))
    return p.select("serial", "seq", "l_partkey", "l_suppkey", streams.granule_sample(granule, F.lit(3)).alias("sample"))


S = "s AS (SELECT vec_id AS frame_id, CAST(embedding AS DOUBLE[]) AS s FROM embeddings)"


@query(f"""WITH {S}, c AS (SELECT frame_id, s, CAST(frame_id % 40 AS INTEGER) AS c FROM s), r AS (SELECT frame_id, list_slice(s, 2 * c + 1, 2 * least(32, c + 10)) AS r FROM c)
SELECT frame_id, CAST(len(r) AS INTEGER) AS n, round(coalesce(list_sum(r), 0), 6) AS sum FROM r""")
def link_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads of 21 values from frames as stereo links, at cursors up to and behind their end."""
    a = views.pcm(spark, sf_dir).select("frame_id", streams.read_samples(pcm.doubles(F.col("samples")), 2, F.pmod("frame_id", F.lit(40)), F.lit(21)).alias("r"))
    return a.select("frame_id", F.size("r").alias("n"), F.round(pcm.total(F.col("r")), 6).alias("sum"))


def _mix_sql(scale: int, wrap: int, out: str) -> str:
    part = lambda r: " + ".join(f"((x[f * 4 + {c + 1}] * {MATRIX[2 * c + r]} + 16384) >> 15)" for c in range(4))
    held = lambda r: f"((({part(r)}) + {wrap}) & {2 * wrap - 1}) - {wrap}"
    return f"""WITH {S}, x AS (SELECT frame_id, list_transform(s, lambda v: CAST(floor(v * {scale}) AS BIGINT)) AS x FROM s),
a AS (SELECT frame_id, flatten(list_transform(range(0, len(x) // 4), lambda f: [{held(0)}, {held(1)}])) AS a FROM x)
SELECT frame_id, CAST(len(a) AS INTEGER) AS n, CAST(list_sum(a) AS BIGINT) AS sum, CAST(a[{out}] AS BIGINT) AS one FROM a"""


def _mixed(spark: SparkSession, sf_dir: str, scale: int, mix: Callable[..., Column], out: int) -> DataFrame:
    x = F.transform(pcm.doubles(F.col("samples")), lambda v: F.floor(v * scale).cast("bigint"))
    a = views.pcm(spark, sf_dir).select("frame_id", mix(x, 2, 4, MATRIX).alias("a"))
    return a.select("frame_id", F.size("a").alias("n"), F.aggregate("a", F.lit(0).cast("bigint"), lambda s, v: s + v).alias("sum"), F.element_at("a", out).cast("bigint").alias("one"))


@query(_mix_sql(30000, 1 << 15, "5"))
def mix_i16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two 16-bit channels from four by a Q15 matrix, wrapping."""
    return _mixed(spark, sf_dir, 30000, pcm.matrix_mix_i16, 5)


@query(_mix_sql(8_000_000, 1 << 31, "6"))
def mix_i24(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two 24-bit channels from four by a Q15 matrix."""
    return _mixed(spark, sf_dir, 8_000_000, pcm.matrix_mix_i24, 6)


LOG2LIN = "CASE WHEN x < 0 THEN 0 WHEN x >= 3967 THEN 2147483647 WHEN x < 2048 THEN (1 << (x >> 7)) + (((1 << (x >> 7)) * ((x & 127) + (((x & 127) * (128 - (x & 127)) * -174) >> 16))) >> 7) ELSE (1 << (x >> 7)) + ((1 << (x >> 7)) >> 7) * ((x & 127) + (((x & 127) * (128 - (x & 127)) * -174) >> 16)) END"


LTP_SETTINGS = views.Drawn(loss=range(0, 101, 10), frames=range(1, 4), lbrr=[True, False], gain=range(-3, 40, 6), snr=range(0, 3600, 300), ind=[True, False])


@query(f"""WITH g AS (SELECT * REPLACE (CAST(loss AS BIGINT) AS loss, CAST(frames AS BIGINT) AS frames, CAST(gain AS BIGINT) AS gain, CAST(snr AS BIGINT) AS snr) FROM ({LTP_SETTINGS.sql})),
w AS (SELECT *, gain * CASE WHEN lbrr THEN 2 + (loss * frames * loss * frames) // 100 ELSE loss * frames END AS w FROM g),
k AS (SELECT *, (SELECT {LOG2LIN} FROM (SELECT 2900 - snr AS x)) AS a, (SELECT {LOG2LIN} FROM (SELECT 3900 - snr AS x)) AS b FROM w)
SELECT event_id, CAST(loss AS INTEGER) AS loss, CAST(frames AS INTEGER) AS frames, lbrr, CAST(gain AS INTEGER) AS gain, CAST(snr AS INTEGER) AS snr, ind, CAST(CASE WHEN ind THEN (w > a)::INT + (w > b)::INT ELSE 0 END AS INTEGER) AS index FROM k""")
def ltp_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The long-term predictor's scale for losses, frames, gains and ratios drawn from event numbers."""
    g = LTP_SETTINGS.frame(spark, sf_dir)
    return g.withColumn("index", rules.ltp_scale_index(*[F.col(c) for c in ("loss", "frames", "lbrr", "gain", "snr", "ind")]).cast("int"))


LOG = "(t * 128 + f + ((f * (128 - f) * 179) >> 16))"


def _gain_sql() -> str:
    wanted = lambda k: f"greatest(least(((2251 * (g{k} - 2090)) >> 16) + CASE WHEN ((2251 * (g{k} - 2090)) >> 16) < v{k} THEN 1 ELSE 0 END, 63), 0)"
    aims = lambda k, c: f"least(greatest(2 * {c} - 16, v{k} + {c} - 4), 63)"
    steps = [f"w0 AS (SELECT *, greatest({wanted(0)}, v0 - 4) AS c0 FROM l), x0 AS (SELECT *, c0 AS v1 FROM w0)"]
    for k in range(1, 4):
        steps.append(f"w{k} AS (SELECT *, list_filter(range(0, 41), lambda c: {aims(k, 'c')} >= {wanted(k)} OR c = 40)[1] AS c{k} FROM x{k - 1}), x{k} AS (SELECT *, greatest({aims(k, f'c{k}')}, 0) AS v{k + 1} FROM w{k})")
    log = lambda k: f"(SELECT {LOG} FROM (SELECT t, CASE WHEN t >= 7 THEN n >> (t - 7) ELSE n << (7 - t) END & 127 AS f FROM (SELECT n, CAST(length(bin(n)) - 1 AS INTEGER) AS t FROM (SELECT (event_id * 7919 + {k} * 104729) % 20000000 + 1 AS n)))) AS g{k}"
    return f"WITH l AS (SELECT event_id, CAST(10 AS BIGINT) AS v0, {', '.join(map(log, range(4)))} FROM events), {', '.join(steps)} SELECT event_id, [CAST(c0 AS INTEGER), CAST(c1 AS INTEGER), CAST(c2 AS INTEGER), CAST(c3 AS INTEGER)] AS steps, CAST(v4 AS INTEGER) AS level FROM x3"


@query(_gain_sql())
def gain_quantise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gain codes of four parts a frame, gains drawn from event numbers."""
    x = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.pmod(F.col("event_id") * 7919 + i * 104729, F.lit(20_000_000)) + 1)
    q = views.table(spark, sf_dir, "events").select("event_id", gains.quantise(x, F.lit(10)).alias("q"))
    return q.select("event_id", F.col("q.codes").alias("steps"), F.col("q.level").alias("level"))


@query("""WITH e AS (SELECT event_id, event_id % 5 AS m, event_id % 300 + 1 AS w, event_id % 200 + 1 AS h FROM events)
SELECT event_id, CASE WHEN m < 3 THEN w WHEN m = 3 THEN 0 END AS width, CASE WHEN m = 0 THEN w WHEN m < 3 THEN h WHEN m = 3 THEN 0 END AS height, CAST(CASE WHEN m < 3 THEN 24 WHEN m = 3 THEN 0 END AS BIGINT) AS depth,
  CAST(CASE WHEN m = 0 THEN 4 WHEN m < 4 THEN 0 END AS BIGINT) AS colours, CASE m WHEN 0 THEN 'gif' WHEN 1 THEN 'png' WHEN 2 THEN 'jpeg' WHEN 3 THEN 'url' END AS format, CAST(CASE WHEN m = 4 THEN -132 ELSE 0 END AS INTEGER) AS error_code FROM e""")
def picture_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Picture comments around headers of three image formats, around links, and cut off."""
    i = F.col("event_id")
    w, h = F.pmod(i, F.lit(300)) + 1, F.pmod(i, F.lit(200)) + 1
    big = lambda n, size: F.lpad(F.hex(n.cast("bigint")), 2 * size, "0")
    low = F.concat(F.substring(big(w, 2), 3, 2), F.substring(big(w, 2), 1, 2))
    images = {
        b"image/gif": F.concat(F.hex(F.lit(b"GIF89a")), low, low, F.lit("91000000")),
        b"image/png": F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), big(w, 4), big(h, 4), F.lit("080200000000000000")),
        b"image/jpeg": F.concat(F.lit("FFD8FFE00002FFC0001108"), big(h, 2), big(w, 2), F.lit("03")),
        b"-->": F.hex(F.lit(b"https://example.org/cover")),
    }
    part = lambda x: F.concat(big(F.length(x) / 2, 4), x)
    blocks = [F.concat(F.lit("00000003"), part(F.hex(F.lit(mime))), F.lit("00000000"), F.lit("0" * 32), part(data)) for mime, data in images.items()]
    base64 = lambda b: F.replace(F.base64(F.unhex(b)), F.lit("\r\n"), F.lit(""))
    coded = F.element_at(F.array(*map(base64, blocks), F.substring(base64(blocks[0]), 1, 61)), (F.pmod(i, F.lit(5)) + 1).cast("int"))
    p = views.table(spark, sf_dir, "events").select("event_id", kernels.picture_udf()(coded.cast("binary")).alias("p"))
    return p.select("event_id", "p.width", "p.height", "p.depth", "p.colours", "p.format", "p.error_code")


@query("""WITH e AS (SELECT event_id, event_id * 7919 % 80000 - 40000 AS v, event_id % 3 AS m FROM events)
SELECT event_id, CAST(CASE WHEN v BETWEEN -32768 AND 32767 THEN v WHEN m = 0 THEN event_id % 100 END AS INTEGER) AS track, CAST(CASE WHEN m = 1 THEN event_id % 50 END AS INTEGER) AS album,
  CAST(CASE WHEN m = 1 THEN event_id % 50 ELSE 0 END + greatest(least(v, 32767), -32768) AS INTEGER) AS shifted FROM e""")
def tag_gains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gains in comments: the first that is a number of 16 bits counts; and a user's offset to the album's."""
    i = F.col("event_id")
    v, m = F.pmod(i * 7919, F.lit(80000)) - 40000, F.pmod(i, F.lit(3))
    more = F.when(m == 0, F.concat(F.lit("R128_TRACK_GAIN="), F.pmod(i, F.lit(100)).cast("string"))).when(m == 1, F.concat(F.lit("r128_Album_gain=+"), F.pmod(i, F.lit(50)).cast("string"))).otherwise(F.lit("R128_ALBUM_GAIN=loud"))
    comments = F.array(F.concat(F.lit("r128_track_gain="), v.cast("string")), F.lit("R128_TRACK_GAIN=1.5"), more)
    e = views.table(spark, sf_dir, "events").select("event_id", v.alias("v"), comments.alias("c"))
    track, album = streams.tag_gain(F.col("c"), "R128_TRACK_GAIN"), streams.tag_gain(F.col("c"), "R128_ALBUM_GAIN")
    return e.select("event_id", track.alias("track"), album.alias("album"), streams.gain_offset(F.coalesce(album, F.lit(0)), F.col("v")).cast("int").alias("shifted"))
