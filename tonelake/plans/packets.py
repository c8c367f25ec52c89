"""Queries over packets, pages, tags and rules, with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tonelake.functions import layouts, rules, toc
from tonelake.operators import streams
from tonelake.plans import views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Bytes of the synthetic packets in SQL: b0 and b1 are the first two, h all of them as hex text.
PACKETS = """p AS (SELECT user_id AS stream_id, event_id, ts, md5(CAST(event_id AS VARCHAR)) AS h FROM events),
b AS (SELECT *, CAST('0x' || substr(h, 1, 2) AS INTEGER) AS b0, CAST('0x' || substr(h, 3, 2) AS INTEGER) AS b1 FROM p)"""
MODE = "CASE WHEN b0 & 128 <> 0 THEN 'CELT' WHEN b0 & 96 = 96 THEN 'HYBRID' ELSE 'SILK' END"
BAND = """CASE WHEN b0 & 128 <> 0 THEN list_extract(['NB', 'WB', 'SWB', 'FB'], ((b0 >> 5) & 3) + 1)
WHEN b0 & 96 = 96 THEN CASE WHEN b0 & 16 <> 0 THEN 'FB' ELSE 'SWB' END ELSE list_extract(['NB', 'MB', 'WB'], least((b0 >> 5) & 3, 2) + 1) END"""
SPF = """CASE WHEN b0 & 128 <> 0 THEN (fs << ((b0 >> 3) & 3)) // 400 WHEN b0 & 96 = 96 THEN CASE WHEN b0 & 8 <> 0 THEN fs // 50 ELSE fs // 100 END
WHEN (b0 >> 3) & 3 = 3 THEN fs * 60 // 1000 ELSE (fs << ((b0 >> 3) & 3)) // 100 END"""
COUNT = "CASE WHEN b0 & 3 = 0 THEN 1 WHEN b0 & 3 < 3 THEN 2 ELSE b1 & 63 END"


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(f"""WITH {PACKETS}, x AS (SELECT {MODE} AS mode, {BAND} AS bandwidth, CASE WHEN b0 & 4 <> 0 THEN 2 ELSE 1 END AS channels,
  ({COUNT}) * ({SPF}) AS n FROM b, (SELECT 48000 AS fs))
SELECT mode, bandwidth, channels, count(*) AS packets, CAST(coalesce(sum(n) FILTER (n * 25 <= 144000), 0) AS BIGINT) AS samples FROM x GROUP BY ALL""")
def toc_mode_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets and valid samples by mode, bandwidth and channels."""
    p = views.packets(spark, sf_dir)
    first = toc.byte_at(F.col("payload"), 0)
    x = p.select(toc.mode(first).alias("mode"), toc.bandwidth(first).alias("bandwidth"), toc.channels(first).alias("channels"), toc.total_samples(F.col("payload"))["value"].alias("n"))
    return x.groupBy("mode", "bandwidth", "channels").agg(F.count("*").alias("packets"), F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("samples"))


RATES = (8000, 12000, 16000, 24000, 48000)


TOCS = views.Drawn(b0=range(256), fs=list(RATES))


@query(f"""WITH b AS ({TOCS.sql})
SELECT event_id, b0 AS toc, fs, {MODE} AS mode, {BAND} AS bandwidth, list_position(['NB', 'MB', 'WB', 'SWB', 'FB'], {BAND}) + 1100 AS bandwidth_id,
  list_extract([4000, 6000, 8000, 12000, 20000], list_position(['NB', 'MB', 'WB', 'SWB', 'FB'], {BAND})) AS bandwidth_hz,
  CASE WHEN b0 & 4 <> 0 THEN 2 ELSE 1 END AS channels, CAST({SPF} AS INTEGER) AS samples FROM b""")
def toc_table_256(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every inspector over first bytes and rates drawn from event numbers."""
    b, t = TOCS.frame(spark, sf_dir).withColumnRenamed("b0", "toc"), F.col("toc")
    return b.select("event_id", "toc", "fs", toc.mode(t).alias("mode"), toc.bandwidth(t).alias("bandwidth"), toc.bandwidth_id(t).alias("bandwidth_id"), toc.bandwidth_hz(t).alias("bandwidth_hz"), toc.channels(t).alias("channels"), toc.samples_per_frame(t, F.col("fs")).alias("samples"))


@query(f"""WITH {PACKETS}, x AS (SELECT fs, ({COUNT}) * ({SPF}) AS n FROM b, (SELECT unnest([8000, 12000, 16000, 24000, 48000]) AS fs))
SELECT fs, count(*) AS packets, count(*) FILTER (n * 25 > fs * 3) AS invalid, CAST(sum(n) FILTER (n * 25 <= fs * 3) AS BIGINT) AS samples FROM x GROUP BY fs""")
def toc_samples_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid samples and invalid packets at five rates."""
    # equal first bytes and counts are counted before they meet the rates
    p = views.packets(spark, sf_dir).select(toc.byte_at(F.col("payload"), 0).alias("b"), toc.frame_count(F.col("payload")).alias("n"))
    p = p.groupBy("b", "n").agg(F.count("*").alias("packets")).select("*", F.explode(F.array(*map(F.lit, RATES))).alias("fs"))
    x = p.select("fs", "packets", toc.samples_of(F.col("b"), F.col("n"), F.col("fs")).alias("t"))
    invalid = F.coalesce(F.sum(F.when(F.col("t.error_code") != 0, F.col("packets"))), F.lit(0))
    return x.groupBy("fs").agg(F.sum("packets").alias("packets"), invalid.alias("invalid"), F.sum(F.col("t.value") * F.col("packets")).cast("bigint").alias("samples"))


@query(f"""WITH {PACKETS} SELECT b1 & 63 AS frames, b1 & 128 <> 0 AS vbr, b1 & 64 <> 0 AS padded, count(*) AS packets FROM b WHERE b0 & 3 = 3 GROUP BY ALL""")
def frame_count_code3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frame counts and flags of the packets with a count byte."""
    p, x = views.packets(spark, sf_dir), F.col("payload")
    p = p.filter(toc.byte_at(x, 0).bitwiseAND(3) == 3)
    return p.groupBy(toc.frame_count(x).alias("frames"), toc.is_vbr(x).alias("vbr"), toc.is_padded(x).alias("padded")).agg(F.count("*").alias("packets"))


@query(f"""WITH {PACKETS}, x AS (SELECT CASE WHEN b1 < 252 THEN 1 ELSE 2 END AS bytes, CASE WHEN b1 < 252 THEN b1 ELSE 4 * CAST('0x' || substr(h, 5, 2) AS INTEGER) + b1 END AS size FROM b)
SELECT bytes, count(*) AS packets, CAST(sum(size) AS BIGINT) AS total, max(size) AS largest FROM x GROUP BY bytes""")
def length_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length fields behind the first byte."""
    x = views.packets(spark, sf_dir).select(toc.length_field(F.col("payload"), 1).alias("f"))
    return x.groupBy(F.col("f.bytes").alias("bytes")).agg(F.count("*").alias("packets"), F.sum("f.size").alias("total"), F.max("f.size").alias("largest"))


@query(f"""WITH {PACKETS}, x AS (SELECT event_id % 3 + 1 AS frames, b1 FROM b)
SELECT CAST(frames AS INTEGER) AS frames, b1 & 128 <> 0 AS vad0, frames > 1 AND b1 & 64 <> 0 AS vad1, frames > 2 AND b1 & 32 <> 0 AS vad2,
  (b1 >> CAST(7 - frames AS INTEGER)) & 1 = 1 AS fec, count(*) AS packets FROM x GROUP BY ALL""")
def silk_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voice activity and redundancy flags of payloads of one to three frames."""
    p = views.packets(spark, sf_dir).select((F.pmod("event_id", F.lit(3)) + 1).cast("int").alias("frames"), toc.byte_at(F.col("payload"), 1).alias("b"))
    x = p.select("frames", toc.silk_flags(F.col("b"), F.col("frames")).alias("f")).select("frames", "f.*")
    return x.groupBy("frames", "vad0", "vad1", "vad2", "fec").agg(F.count("*").alias("packets"))


SIZES = views.Drawn(duration=range(5000, 5011), fs=list(RATES), size=range(30, 6000, 30))


@query(f"""WITH g AS ({SIZES.sql}),
n AS (SELECT *, CASE WHEN duration = 5000 THEN size WHEN duration BETWEEN 5001 AND 5005 THEN (fs // 400) << (duration - 5001)
  WHEN duration BETWEEN 5006 AND 5009 THEN (duration - 5003) * fs // 50 END AS w FROM g)
SELECT event_id, size, duration, fs, CAST(CASE WHEN size >= fs // 400 AND w <= size AND (400 * w = fs OR 200 * w = fs OR 100 * w = fs OR 50 * w = fs OR 25 * w = fs
  OR 50 * w = 3 * fs OR 50 * w = 4 * fs OR 50 * w = 5 * fs OR 50 * w = 6 * fs) THEN w END AS INTEGER) AS chosen FROM n""")
def frame_size_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frame size for duration codes, rates and input sizes drawn from event numbers."""
    return SIZES.frame(spark, sf_dir).select("event_id", "size", "duration", "fs", toc.frame_size(F.col("size"), F.col("duration"), F.col("fs")).alias("chosen"))


TOC_SETTINGS = views.Drawn(mode=list(toc.MODES), frame_rate=[400, 200, 100, 50, 25], bandwidth_id=range(1101, 1106), channels=range(1, 3))


@query(f"""WITH g AS ({TOC_SETTINGS.sql}),
k AS (SELECT *, CASE frame_rate WHEN 400 THEN 0 WHEN 200 THEN 1 WHEN 100 THEN 2 WHEN 50 THEN 3 ELSE 4 END AS period FROM g)
SELECT event_id, mode, frame_rate, bandwidth_id, channels, CAST(CASE mode WHEN 'SILK' THEN least(bandwidth_id - 1101, 3) * 32 + least(greatest(period - 2, 0), 3) * 8
  WHEN 'CELT' THEN 128 + greatest(bandwidth_id - 1102, 0) * 32 + least(period, 3) * 8
  ELSE 96 + CASE WHEN bandwidth_id = 1105 THEN 16 ELSE 0 END + least(greatest(period - 2, 0), 3) * 8 END + CASE WHEN channels = 2 THEN 4 ELSE 0 END AS INTEGER) AS toc FROM k""")
def toc_generate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first byte for modes, frame rates, bandwidths and channel counts drawn from event numbers."""
    return TOC_SETTINGS.frame(spark, sf_dir).withColumn("toc", toc.make_toc(*[F.col(c) for c in ("mode", "frame_rate", "bandwidth_id", "channels")]).cast("int"))


@query("""SELECT l_orderkey AS serial, l_linenumber AS seq, l_partkey, l_suppkey, CAST(coalesce(greatest(l_linenumber
  - lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1, 0), 0) AS INTEGER) AS missing FROM lineitem""")
def page_holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages lost before each page."""
    return streams.page_holes(views.pages(spark, sf_dir), order=("seq", "l_partkey", "l_suppkey")).drop("granule")


@query("SELECT doc_id, CAST(strlen(text) // 255 + 1 AS INTEGER) AS segments, CAST(strlen(text) % 255 AS INTEGER) AS last_segment FROM documents")
def page_lacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments that texts would take as packets."""
    docs = views.table(spark, sf_dir, "documents").select("doc_id", streams.lacing(F.octet_length("text")).alias("l"))
    return docs.select("doc_id", F.size("l").alias("segments"), F.element_at("l", -1).alias("last_segment"))


@query("""WITH l AS (SELECT l_orderkey AS serial, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS n FROM lineitem GROUP BY 1)
SELECT serial, CAST(sum(n) OVER (ORDER BY serial) - n AS BIGINT) AS start, CAST(sum(n) OVER (ORDER BY serial) AS BIGINT) AS stop FROM l""")
def link_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sample interval of each link of a chain."""
    return streams.link_intervals(views.pages(spark, sf_dir))


@query(f"""WITH {PACKETS}, x AS (SELECT stream_id, event_id, (row_number() OVER (PARTITION BY stream_id ORDER BY ts, event_id)) AS packet_no FROM p)
SELECT q.stream_id, q.at, max(i.packet_no) AS packet_no FROM (SELECT DISTINCT stream_id, event_id % 97 * 10 AS at FROM p) AS q
LEFT JOIN x AS i ON i.stream_id = q.stream_id AND i.packet_no * 16 <= q.at GROUP BY ALL""")
def raw_seek_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last packet at or before a byte offset of its stream."""
    p = views.packets(spark, sf_dir, numbered=True)
    queries = p.select("stream_id", (F.pmod("event_id", F.lit(97)) * 10).alias("at")).distinct()
    return streams.seek(p.select("stream_id", (F.col("packet_no") * 16).alias("at"), "packet_no"), queries, stream="stream_id", at="at", value="packet_no")


@query(f"""WITH {PACKETS}, x AS (SELECT stream_id, ({COUNT}) * ({SPF}) AS n FROM b, (SELECT 48000 AS fs)),
s AS (SELECT stream_id, count(*) * 16 AS bytes, CAST(coalesce(sum(n) FILTER (n * 25 <= 144000), 0) AS BIGINT) AS samples FROM x GROUP BY 1)
SELECT stream_id, bytes, samples, CASE WHEN samples = 0 THEN 2147483647 ELSE least((bytes * 384000 + samples // 2) // samples, 2147483647) END AS bitrate FROM s""")
def bitrate_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average bitrate of each stream."""
    p = views.packets(spark, sf_dir).select("stream_id", toc.total_samples(F.col("payload"))["value"].alias("n"))
    s = p.groupBy("stream_id").agg((F.count("*") * 16).alias("bytes"), F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("samples"))
    return s.withColumn("bitrate", streams.bitrate(F.col("bytes"), F.col("samples")))


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN source END AS second_lang, CAST(CASE WHEN doc_id % 3 = 2 THEN 2 ELSE 1 END AS INTEGER) AS lang_tags,
  CAST(CASE WHEN doc_id % 3 > 0 THEN 1 ELSE 0 END AS INTEGER) AS source_tags FROM documents""")
def tag_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of tags by key, and the second value of a key, whatever its case."""
    t = views.tags(spark, sf_dir).withColumn("comments", F.slice("comments", F.lit(1), (F.pmod("doc_id", F.lit(3)) + 1).cast("int")))
    values = streams.tag_values(F.col("comments"), "Lang")
    return t.select("doc_id", F.get(values, F.lit(1)).alias("second_lang"), F.size(values).alias("lang_tags"), F.size(streams.tag_values(F.col("comments"), "SOURCE")).alias("source_tags"))


@query("SELECT event_id, round(pow(10, (event_id % 8192 - 4096) / 5120.0), 9) AS factor FROM events")
def gain_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gains in 1/256 dB as factors."""
    e = views.table(spark, sf_dir, "events")
    return e.select("event_id", F.round(rules.gain_linear(F.pmod("event_id", F.lit(8192)) - 4096), 9).alias("factor"))


def cols(*names: str) -> list[Column]:
    return [F.col(n) for n in names]


@query("""WITH e AS (SELECT event_id, CAST(6000 + event_id * 37 % 90000 AS BIGINT) AS rate, CAST(1 + event_id % 2 AS INTEGER) AS ch, CAST(list_extract([25, 50, 100, 200], event_id % 4 + 1) AS INTEGER) AS fr,
  event_id % 3 <> 0 AS vbr, list_extract(['SILK', 'HYBRID', 'CELT', 'NONE'], event_id // 4 % 4 + 1) AS mode, CAST(event_id % 11 AS INTEGER) AS cx, CAST(event_id * 7 % 31 AS INTEGER) AS loss FROM events),
a AS (SELECT *, rate - CASE WHEN fr > 50 THEN (40 * ch + 20) * (fr - 50) ELSE 0 END AS r1 FROM e),
b AS (SELECT *, (r1 - CASE WHEN vbr THEN 0 ELSE r1 // 12 END) * (90 + cx) // 100 AS r FROM a),
c AS (SELECT *, CASE WHEN cx < 2 THEN r * 4 // 5 ELSE r END AS low FROM b)
SELECT event_id, CAST(CASE WHEN mode IN ('SILK', 'HYBRID') THEN low - low * loss // (6 * loss + 10) WHEN mode = 'CELT' THEN CASE WHEN cx < 5 THEN r * 9 // 10 ELSE r END
  ELSE r - r * loss // (12 * loss + 20) END AS BIGINT) AS equivalent FROM c""")
def equiv_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equivalent bitrates of settings drawn from event numbers."""
    i = F.col("event_id")
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (n + 1).cast("int"))
    e = views.table(spark, sf_dir, "events").select(i, (F.pmod(i * 37, F.lit(90000)) + 6000).alias("rate"), (F.pmod(i, F.lit(2)) + 1).alias("ch"), pick((25, 50, 100, 200), F.pmod(i, F.lit(4))).alias("fr"), (F.pmod(i, F.lit(3)) != 0).alias("vbr"), pick(("SILK", "HYBRID", "CELT", "NONE"), F.pmod(F.floor(i / 4), F.lit(4))).alias("mode"), F.pmod(i, F.lit(11)).alias("cx"), F.pmod(i * 7, F.lit(31)).alias("loss"))
    return e.select("event_id", rules.equivalent_rate(*cols("rate", "ch", "fr", "vbr", "mode", "cx", "loss")).alias("equivalent"))


FEC_SETTINGS = views.Drawn(loss=[0, 3, 5, 6, 10, 25, 40], last=[True, False], bw=range(1101, 1106), rate=range(5000, 30000, 500))


@query(f"""WITH g AS ({FEC_SETTINGS.sql}),
t AS (SELECT g.*, s.bw AS tried, ((list_extract([12000, 14000, 16000, 20000, 22000], s.bw - 1100) + CASE WHEN last THEN -1000 ELSE 1000 END) * (125 - least(loss, 25)) * 655) >> 16 AS lim
  FROM g JOIN (SELECT CAST(x AS INTEGER) AS bw FROM range(1101, 1106) AS y(x)) AS s ON s.bw <= g.bw AND (s.bw = g.bw OR g.loss > 5)),
c AS (SELECT event_id, loss, last, bw, rate, max(tried) FILTER (rate > lim) AS got FROM t GROUP BY ALL)
SELECT event_id, loss, last AS last_fec, bw AS bandwidth_id, rate, loss <> 0 AND got IS NOT NULL AS fec, CAST(CASE WHEN loss <> 0 THEN coalesce(got, bw) ELSE bw END AS INTEGER) AS chosen FROM c""")
def fec_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether redundancy pays, for settings drawn from event numbers."""
    g = FEC_SETTINGS.frame(spark, sf_dir).withColumnsRenamed({"last": "last_fec", "bw": "bandwidth_id"})
    d = rules.fec_decision(F.lit(True), F.col("loss"), F.col("last_fec"), F.lit("SILK"), F.col("bandwidth_id"), F.col("rate"))
    return g.withColumn("d", d).select("event_id", "loss", "last_fec", "bandwidth_id", "rate", "d.fec", F.col("d.bandwidth_id").alias("chosen"))


HYBRID_SETTINGS = views.Drawn(bw=range(1104, 1106), long=[True, False], vbr=[True, False], fec=[True, False], ch=range(1, 3), rate=range(1000, 150000, 1000))


@query(f"""WITH g AS ({HYBRID_SETTINGS.sql}),
t AS (SELECT * FROM (VALUES (0, 0, [0, 0, 0, 0]), (1, 12000, [10000, 10000, 11000, 11000]), (2, 16000, [13500, 13500, 15000, 15000]), (3, 20000, [16000, 16000, 18000, 18000]),
  (4, 24000, [18000, 18000, 21000, 21000]), (5, 32000, [22000, 22000, 28000, 28000]), (6, 64000, [38000, 38000, 50000, 50000])) AS t(i, x, v)),
e AS (SELECT g.*, rate // ch AS each, 1 + long::INT + 2 * fec::INT AS c FROM g),
k AS (SELECT e.*, CAST(CASE WHEN each >= 64000 THEN list_extract(a.v, c) + (each - a.x) // 2 ELSE (list_extract(a.v, c) * (b.x - each) + list_extract(b.v, c) * (each - a.x)) // (b.x - a.x) END AS BIGINT) AS s
  FROM e JOIN t AS a ON a.x <= each LEFT JOIN t AS b ON b.i = a.i + 1 WHERE each >= 64000 AND a.i = 6 OR each < b.x)
SELECT event_id, rate, bw AS bandwidth_id, long AS frame_20ms, vbr, fec, ch AS channels, CAST((s + CASE WHEN vbr THEN 0 ELSE 100 END + CASE WHEN bw = 1104 THEN 300 ELSE 0 END) * ch
  - CASE WHEN ch = 2 AND each >= 12000 THEN 1000 ELSE 0 END AS BIGINT) AS silk_rate FROM k""")
def hybrid_silk_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SILK's part of hybrid bitrates, for settings drawn from event numbers."""
    g = HYBRID_SETTINGS.frame(spark, sf_dir).withColumnsRenamed({"bw": "bandwidth_id", "long": "frame_20ms", "ch": "channels"})
    return g.withColumn("silk_rate", rules.hybrid_silk_rate(*cols("rate", "bandwidth_id", "frame_20ms", "vbr", "fec", "channels")))


REDUNDANCY_SETTINGS = views.Drawn(fr=[25, 50, 100, 200], ch=range(1, 3), max_bytes=range(20, 1300, 20), rate=range(4000, 160000, 4000))


@query(f"""WITH g AS ({REDUNDANCY_SETTINGS.sql}),
n AS (SELECT *, least((3 * (rate + (40 * ch + 20) * (200 - fr)) // 2) // 1600, ((max_bytes * 8 - 2 * (40 * ch + 20)) * 240 // (240 + 48000 // fr) + 40 * ch + 20) // 8) AS n FROM g)
SELECT event_id, max_bytes, rate, CAST(fr AS INTEGER) AS frame_rate, CAST(ch AS INTEGER) AS channels, CAST(CASE WHEN n > 4 + 8 * ch THEN least(n, 257) ELSE 0 END AS BIGINT) AS bytes FROM n""")
def redundancy_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes for a redundant frame, for settings drawn from event numbers."""
    g = REDUNDANCY_SETTINGS.frame(spark, sf_dir).withColumnsRenamed({"fr": "frame_rate", "ch": "channels"})
    return g.withColumn("bytes", rules.redundancy_bytes(*cols("max_bytes", "rate", "frame_rate", "channels")))


SNR_SETTINGS = views.Drawn(half=[True, False], khz=[8, 12, 16], rate=range(0, 95900, 137))


@query(f"""WITH g AS (SELECT *, CASE khz WHEN 8 THEN {rules.SNR_NB} WHEN 12 THEN {rules.SNR_MB} ELSE {rules.SNR_WB} END AS t FROM ({SNR_SETTINGS.sql})),
i AS (SELECT *, least((rate - CASE WHEN half THEN 2000 + khz // 16 ELSE 0 END + 200) // 400 - 10, len(t) - 1) AS i FROM g)
SELECT event_id, rate, half, khz, CAST(CASE WHEN i <= 0 THEN 0 ELSE list_extract(t, i + 1) * 21 END AS INTEGER) AS snr_q7 FROM i""")
def target_snr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target signal-to-noise ratios of the three sampling rates, for bitrates drawn from event numbers."""
    g = SNR_SETTINGS.frame(spark, sf_dir)
    return g.withColumn("snr_q7", rules.target_snr(F.col("rate"), F.col("khz"), F.col("half")))


STEPS = views.Drawn(x=range(-300, 301))


@query(f"""WITH x AS ({STEPS.sql}), a AS (SELECT event_id, x, abs(x) AS m, least(abs(x) >> 5, 5) AS i FROM x)
SELECT event_id, x, CAST(CASE WHEN x < 0 THEN CASE WHEN m >= 192 THEN 0 ELSE list_extract([16384, 8812, 3906, 1554, 589, 219], i + 1) - list_extract([237, 153, 73, 30, 12, 7], i + 1) * (m & 31) END
  WHEN m >= 192 THEN 32767 ELSE list_extract([16384, 23955, 28861, 31213, 32178, 32548], i + 1) + list_extract([237, 153, 73, 30, 12, 7], i + 1) * (m & 31) END AS INTEGER) AS y FROM a""")
def sigmoid_lut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The integer sigmoid of steps drawn from event numbers."""
    return STEPS.frame(spark, sf_dir).withColumn("y", rules.sigmoid_q15(F.col("x")).cast("int"))


@query("""WITH x AS (SELECT event_id, event_id * 7919 % 2147483647 AS x FROM events), t AS (SELECT *, CASE WHEN x = 0 THEN 0 ELSE CAST(length(ltrim(bin(x), '0')) - 1 AS BIGINT) END AS t FROM x),
f AS (SELECT *, CASE WHEN t >= 7 THEN x >> CAST(t - 7 AS INTEGER) ELSE x << CAST(7 - t AS INTEGER) END & 127 AS f FROM t)
SELECT event_id, CAST(CASE WHEN x = 0 THEN -128 ELSE t * 128 + f + ((f * (128 - f) * 179) >> 16) END AS INTEGER) AS y FROM f""")
def lin2log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Integer logarithms of numbers up to 31 bits."""
    x = views.table(spark, sf_dir, "events").select("event_id", F.pmod(F.col("event_id") * 7919, F.lit(2147483647)).alias("x"))
    return x.select("event_id", rules.lin2log(F.col("x")).alias("y"))


LOGS = views.Drawn(x=range(-10, 4000))


@query(f"""WITH x AS (SELECT event_id, CAST(x AS BIGINT) AS x FROM ({LOGS.sql})), k AS (SELECT event_id, x, least(greatest(x, 0), 3966) AS i FROM x),
o AS (SELECT event_id, x, CAST(1 AS BIGINT) << CAST(i >> 7 AS INTEGER) AS o, i & 127 AS f FROM k), c AS (SELECT *, f + ((f * (128 - f) * -174) >> 16) AS c FROM o)
SELECT event_id, CAST(x AS INTEGER) AS x, CAST(CASE WHEN x < 0 THEN 0 WHEN x >= 3967 THEN 2147483647 WHEN x < 2048 THEN o + ((o * c) >> 7) ELSE o + (o >> 7) * c END AS INTEGER) AS y FROM c""")
def log2lin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Integer powers of two of logarithms drawn from event numbers."""
    return LOGS.frame(spark, sf_dir).withColumn("y", rules.log2lin(F.col("x")))


@query("""WITH e AS (SELECT event_id, list_transform(range(0, 6), lambda i: CASE WHEN (event_id + i * 3) % 7 = 0 THEN 255 ELSE (event_id + i) % 6 END) AS m FROM events)
SELECT event_id, CAST(len(list_filter(m, lambda x: x = 255)) AS INTEGER) AS muted, CAST(coalesce(list_position(m, 2), 0) - 1 AS INTEGER) AS left1,
  CAST(coalesce(list_position(m, 3), 0) - 1 AS INTEGER) AS right1, CAST(coalesce(list_position(m, 4), 0) - 1 AS INTEGER) AS mono2, len(list_filter(m, lambda x: x >= 5 AND x <> 255)) = 0 AS valid FROM e""")
def layout_muted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks and lookups of six-channel mappings with three streams, two of them coupled."""
    i = F.col("event_id")
    m = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda k: F.when(F.pmod(i + k * 3, F.lit(7)) == 0, 255).otherwise(F.pmod(i + k, F.lit(6))).cast("int"))
    e = views.table(spark, sf_dir, "events").select("event_id", m.alias("m"))
    m, lit = F.col("m"), F.lit
    return e.select("event_id", F.size(layouts.muted_channels(m)).alias("muted"), layouts.left_channel(m, lit(1)).alias("left1"), layouts.right_channel(m, lit(1)).alias("right1"), layouts.mono_channel(m, lit(2), lit(2)).alias("mono2"), layouts.is_valid(m, lit(3), lit(2)).alias("valid"))


CHANNELS = views.Drawn(channels=range(261))


@query(f"""WITH c AS (SELECT *, CAST(pow(floor(sqrt(channels)), 2) AS INTEGER) AS acn FROM ({CHANNELS.sql}))
SELECT event_id, channels, CASE WHEN channels BETWEEN 1 AND 227 AND channels - acn IN (0, 2) THEN acn + CASE WHEN channels > acn THEN 1 ELSE 0 END END AS streams,
  CASE WHEN channels BETWEEN 1 AND 227 AND channels - acn IN (0, 2) THEN CASE WHEN channels > acn THEN 1 ELSE 0 END END AS coupled FROM c""")
def ambisonic_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams of ambisonic channel counts drawn from event numbers."""
    c = CHANNELS.frame(spark, sf_dir)
    return c.withColumn("a", layouts.ambisonic(F.col("channels"))).select("event_id", "channels", "a.streams", "a.coupled")


SURROUND_SETTINGS = views.Drawn(ch=range(3, 9), fr=[25, 50, 100], rate=range(16000, 800000, 8000))


@query(f"""WITH l AS (SELECT * FROM (VALUES (3, 2, 1, 0), (4, 2, 2, 0), (5, 3, 2, 0), (6, 4, 2, 1), (7, 4, 3, 1), (8, 5, 3, 1)) AS l(ch, s, c, lfe)),
g AS (SELECT l.*, event_id, rate, CAST(fr AS BIGINT) AS fr FROM ({SURROUND_SETTINGS.sql}) JOIN l USING (ch)),
a AS (SELECT *, s + c - lfe AS n, s - c - lfe AS u, 40 * greatest(fr, 50) AS o, least(rate // 20, 3000) + 15 * greatest(fr, 50) AS lo FROM g),
b AS (SELECT *, least(greatest((rate - o * n - lo * lfe) // n // 2, 0), 20000) AS so FROM a),
d AS (SELECT *, 256 * (rate - lo * lfe - so * (c + u) - o * n) // (u * 256 + c * 512 + lfe * 32) AS cr FROM b),
r AS (SELECT unnest(range(0, s)) AS i, * FROM d)
SELECT event_id, CAST(ch AS INTEGER) AS channels, rate, CAST(fr AS INTEGER) AS frame_rate, CAST(i AS INTEGER) AS stream, CAST(greatest(CASE WHEN i < c THEN 2 * o + greatest(so + ((cr * 512) >> 8), 0)
  WHEN lfe = 1 AND i = s - 1 THEN greatest(lo + ((cr * 32) >> 8), 0) ELSE o + greatest(so + cr, 0) END, 500) AS BIGINT) AS stream_rate FROM r""")
def surround_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stream bitrates of surround layouts, for bitrates drawn from event numbers."""
    g = SURROUND_SETTINGS.frame(spark, sf_dir).withColumnsRenamed({"ch": "channels", "fr": "frame_rate"})
    g = g.withColumn("l", layouts.surround_layout(F.col("channels")))
    rates = layouts.surround_rates(F.col("rate"), F.col("l.streams"), F.col("l.coupled"), (F.col("channels") >= 6).cast("int"), F.col("frame_rate"))
    return g.select("event_id", "channels", "rate", "frame_rate", F.posexplode(rates).alias("stream", "stream_rate"))


@query(f"""WITH {PACKETS}, x AS (SELECT stream_id, row_number() OVER (PARTITION BY stream_id ORDER BY ts, event_id) AS no, ({COUNT}) * ({SPF}) AS n FROM b, (SELECT 48000 AS fs)),
s AS (SELECT stream_id, (no - 1) // 10 AS part, count(*) * 16 AS bytes, CAST(coalesce(sum(n) FILTER (n * 25 <= 144000), 0) AS BIGINT) AS samples FROM x GROUP BY ALL)
SELECT stream_id, part, bytes, samples, CASE WHEN samples = 0 THEN 2147483647 ELSE least((bytes * 384000 + samples // 2) // samples, 2147483647) END AS bitrate FROM s""")
def bitrate_instant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bitrate of every ten packets."""
    p = views.packets(spark, sf_dir, numbered=True).withColumn("samples", F.coalesce(toc.total_samples(F.col("payload"))["value"], F.lit(0)))
    return streams.instant_bitrates(p, 10)


@query(f"""WITH {PACKETS}, x AS (SELECT stream_id, ({COUNT}) * ({SPF}) AS n FROM b, (SELECT 48000 AS fs))
SELECT stream_id, count(*) AS packets, count(*) * 16 AS bytes, CAST(coalesce(sum(n) FILTER (n * 25 <= 144000), 0) AS BIGINT) AS samples FROM x GROUP BY 1""")
def link_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets, bytes and samples of each stream."""
    p = views.packets(spark, sf_dir).withColumn("samples", F.coalesce(toc.total_samples(F.col("payload"))["value"], F.lit(0)))
    return streams.link_totals(p)


@query("""WITH l AS (SELECT l_orderkey AS link, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS n FROM lineitem GROUP BY 1),
i AS (SELECT link, CAST(sum(n) OVER (ORDER BY link) - n AS BIGINT) AS start FROM l)
SELECT q.at, i.link FROM (SELECT DISTINCT event_id * 131 AS at FROM events) AS q ASOF LEFT JOIN i ON i.start <= q.at""")
def link_of_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The link of a chain in which each position lies."""
    links = streams.link_intervals(views.pages(spark, sf_dir)).withColumnRenamed("serial", "link")
    at = views.table(spark, sf_dir, "events").select((F.col("event_id") * 131).alias("at")).distinct()
    return streams.links_of_positions(links, at, at="at", width=1 << 12)


EVERY_RATE = views.Drawn(rate=range(0, 50000, 1000))


@query(f"SELECT event_id, rate, CAST(CASE WHEN rate IN (48000, 24000, 16000, 12000, 8000) THEN 48000 // rate ELSE 0 END AS INTEGER) AS factor FROM ({EVERY_RATE.sql})")
def rate_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decimation factors of rates drawn from event numbers."""
    return EVERY_RATE.frame(spark, sf_dir).withColumn("factor", rules.rate_factor(F.col("rate")))
