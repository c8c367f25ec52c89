"""Queries over byte kernels and stateful operators. SQL expresses few of them; tests hold the others against plain Python."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonelake.functions import kernels, signal
from tonelake.plans import views
from tonelake.sources import containers
from tonelake.streaming import state

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: For those that SQL can express over these inputs.
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]):
    QUERIES[f.__name__] = f
    return f


ORACLES["crc_ogg"] = """WITH t AS (SELECT list_transform(range(0, 256), lambda i: list_reduce(range(0, 8), lambda r, k: xor((r << 1) & 4294967295, CASE WHEN r >= 2147483648 THEN 79764919 ELSE 0 END), i << 24)) AS t),
p AS (SELECT event_id, md5(CAST(event_id AS VARCHAR)) AS h FROM events),
b AS (SELECT event_id, list_transform(range(0, 16), lambda k: CAST('0x' || substr(h, 2 * k + 1, 2) AS BIGINT)) AS b FROM p)
SELECT event_id, CAST(list_reduce(b, lambda r, x: xor((r << 8) & 4294967295, t[xor(r >> 24, x) + 1]), CAST(0 AS BIGINT)) AS BIGINT) AS crc FROM b, t"""
ORACLES["head_parse"] = """WITH h AS (SELECT event_id, event_id % 4 IN (1, 2) AS ok, CAST(event_id % 4 AS INTEGER) AS c FROM events)
SELECT event_id, CASE WHEN ok THEN 1 END AS version, CASE WHEN ok THEN c END AS channels, CASE WHEN ok THEN 312 END AS pre_skip, CASE WHEN ok THEN CAST(48000 AS BIGINT) END AS rate, CASE WHEN ok THEN 0 END AS gain,
  CASE WHEN ok THEN 0 END AS family, CASE WHEN ok THEN 1 END AS streams, CASE WHEN ok THEN c - 1 END AS coupled, CASE WHEN ok THEN CASE WHEN c = 1 THEN [0] ELSE [0, 1] END END AS mapping, CASE WHEN ok THEN 0 ELSE -133 END AS error_code FROM h"""
ORACLES["tags_parse"] = "SELECT doc_id, 2 AS comments, 'Source=' || source AS second, 0 AS error_code FROM documents"
ORACLES["picture_parse"] = "SELECT event_id, event_id % 200 + 1 AS width, event_id % 200 + 1 AS height, CAST(24 AS BIGINT) AS depth, CAST(4 AS BIGINT) AS colours, 'gif' AS format, 0 AS error_code FROM events"
ORACLES["container_round_trip"] = """SELECT user_id AS stream_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS packet_no, md5(unhex(md5(CAST(event_id AS VARCHAR)))) AS digest, false AS hole_before FROM events"""


@query
def crc_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page checksums of the packets' bytes."""
    return views.packets(spark, sf_dir).select("event_id", kernels.crc_column(F.col("payload")).alias("crc"))


@query
def packet_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of every packet, or why it has none."""
    p = views.packets(spark, sf_dir).select("event_id", kernels.packet_udf()(F.col("payload")).alias("p"))
    return p.select("event_id", F.col("p.toc").alias("toc"), F.col("p.sizes").alias("sizes"), F.col("p.payload_offset").alias("payload_offset"), F.octet_length("p.padding").alias("padding"), F.col("p.error_code").alias("error_code"))


@query
def extensions_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extensions in the packets' bytes taken as padding of a packet of four frames."""
    p = views.packets(spark, sf_dir).select("event_id", F.posexplode(kernels.extensions_udf()(F.col("payload"), F.lit(4))).alias("place", "e"))
    return p.select("event_id", "place", "e.*")


@query
def head_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identification headers with settings drawn from event numbers, most of them valid."""
    i = F.col("event_id")
    byte = lambda n: F.lpad(F.hex(n.cast("bigint")), 2, "0")
    head = F.unhex(F.concat(F.hex(F.lit(b"OpusHead")), F.lit("01"), byte(F.pmod(i, F.lit(4))), F.lit("3801"), F.lit("80BB0000"), F.lit("0000"), byte(F.pmod(F.floor(i / 7), F.lit(2)) * 0)))
    h = views.table(spark, sf_dir, "events").select("event_id", kernels.head_udf()(head).alias("h"))
    return h.select("event_id", "h.*")


@query
def tags_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comment headers of the documents' languages and sources."""
    le = lambda x: F.concat(F.lpad(F.hex(F.octet_length(x).cast("bigint")), 2, "0"), F.lit("000000"), F.hex(x))
    docs = views.table(spark, sf_dir, "documents")
    data = F.unhex(F.concat(F.hex(F.lit(b"OpusTags")), le(F.lit("tonelake")), F.lit("02000000"), le(F.concat(F.lit("LANG="), docs["lang"])), le(F.concat(F.lit("Source="), docs["source"]))))
    t = docs.select("doc_id", kernels.tags_udf()(data).alias("t"))
    return t.select("doc_id", F.size("t.comments").alias("comments"), F.element_at("t.comments", 2).cast("string").alias("second"), F.col("t.error_code").alias("error_code"))


@query
def picture_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Picture comments around small GIF headers of sizes drawn from event numbers."""
    i = F.col("event_id")
    size = F.lpad(F.hex(F.pmod(i, F.lit(200)) + 1), 2, "0")
    gif = F.concat(F.hex(F.lit(b"GIF89a")), size, F.lit("00"), size, F.lit("00"), F.lit("91000000"))
    block = F.concat(F.lit("00000003"), F.lit("00000009"), F.hex(F.lit(b"image/gif")), F.lit("00000000"), F.lit("0" * 32), F.lit("0000000E"), gif)
    p = views.table(spark, sf_dir, "events").select("event_id", kernels.picture_udf()(F.base64(F.unhex(block)).cast("binary")).alias("p"))
    return p.select("event_id", F.col("p.width").alias("width"), F.col("p.height").alias("height"), F.col("p.depth").alias("depth"), F.col("p.colours").alias("colours"), F.col("p.format").alias("format"), F.col("p.error_code").alias("error_code"))


@query
def container_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stream's packets written as container pages and read again."""
    p = views.packets(spark, sf_dir, numbered=True).withColumn("granule", F.col("packet_no") * 960)
    written = containers.write_streams(p).select(F.col("stream_id").cast("string").alias("path"), "content")
    return containers.read_packets(written).select(F.col("serial").alias("stream_id"), (F.col("packet_no") + 1).alias("packet_no"), F.md5("payload").alias("digest"), "hole_before")


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.pcm(spark, sf_dir).select(F.pmod("frame_id", F.lit(16)).alias("stream_id"), F.col("frame_id").alias("frame_no"), F.transform("samples", lambda x: x * 6).alias("samples"))


@query
def soft_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames bent back below full scale, 16 streams of them."""
    out = state.apply(_frames(spark, sf_dir), state.SoftClip())
    return out.select("stream_id", "frame_no", F.round(F.array_max("samples"), 6).alias("top"), F.round(F.array_min("samples"), 6).alias("bottom"))


@query
def dc_reject(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames without their mean's drift."""
    out = state.apply(_frames(spark, sf_dir), state.DcReject())
    return out.select("stream_id", "frame_no", F.round(F.aggregate("samples", F.lit(0.0), lambda a, x: a + x), 6).alias("sum"))


@query
def stereo_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The width of frames taken as interleaved stereo."""
    out = state.apply(_frames(spark, sf_dir), state.StereoWidth())
    return out.select("stream_id", "frame_no", F.round("width", 6).alias("width"))


@query
def resample_48k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames at 44.1 kHz taken to 48 kHz, stream by stream."""
    out = state.apply(_frames(spark, sf_dir), state.Resample(44100, 48000))
    return out.select("stream_id", "frame_no", F.size("samples").alias("n"), F.round(F.aggregate("samples", F.lit(0.0), lambda a, x: a + x), 6).alias("sum"))


@query
def high_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames through a second-order high-pass."""
    out = state.apply(_frames(spark, sf_dir), state.HighPass())
    return out.select("stream_id", "frame_no", F.round(F.aggregate("samples", F.lit(0.0), lambda a, x: a + x * x), 6).alias("energy"))


@query
def lpc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prediction coefficients of order 8."""
    fit = signal.array_udf(lambda x: signal.levinson(signal.autocorrelation(x, 8), 8))
    return views.pcm(spark, sf_dir).select("frame_id", F.transform(fit(F.col("samples").cast("array<double>")), lambda x: F.round(x, 6)).alias("a"))


@query
def mdct_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Energy of the MDCT of windowed frames, by quarter of the spectrum."""
    spectrum = signal.array_udf(lambda x: signal.mdct(x * np.r_[w := signal.power_window(len(x) // 2), w[::-1]]))
    a = views.pcm(spark, sf_dir).select("frame_id", spectrum(F.col("samples").cast("array<double>")).alias("c"))
    part = lambda i: F.aggregate(F.slice("c", F.lit(8 * i + 1), F.lit(8)), F.lit(0.0), lambda s, x: s + x * x)
    return a.select("frame_id", F.posexplode(F.array(*[F.round(part(i), 6) for i in range(4)])).alias("quarter", "energy"))
