"""Queries over container files that Spark writes from the packets and reads back, by ranges and in a stream."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tonelake.operators import streams
from tonelake.plans import views
from tonelake.sources import containers, ogg
from tonelake.streaming import sync

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


def scratch(spark: SparkSession, what: str) -> str:
    """A folder for files of one run, in the one that the session names for checkpoints; on a single machine that names none, a
    temporary one. It goes when the driver's JVM ends."""
    context = spark.sparkContext
    shared = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not context._jsc.sc().isLocal():
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        shared = tempfile.mkdtemp(prefix="tonelake-")
    path = f"{shared}/tonelake-{what}-{uuid.uuid4().hex}"
    where = context._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


#: Muxing delay of the queries, in samples, and bytes of a piece in the stream.
DELAY, PIECE = 4800, 997


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets of 1 to 600 bytes and 2.5 to 40 ms."""
    return chained(spark, sf_dir, F.lit(0))


def chained(spark: SparkSession, sf_dir: str, link: Column) -> DataFrame:
    """The packets, with their granules in the link that they belong to. They are numbered and summed before they get their bytes, so
    that what is sorted is narrow."""
    long = F.element_at(F.array(*map(F.lit, (120, 240, 480, 960, 1920))), (F.pmod("event_id", F.lit(5)) + 1).cast("int"))
    e = views.packets(spark, sf_dir, numbered=True).select("stream_id", "event_id", link.alias("link"), "packet_no", long.alias("n"))
    e = e.withColumn("granule", F.expr("sum(n) OVER (PARTITION BY stream_id, link ORDER BY packet_no)"))
    size = (F.pmod("event_id", F.lit(600)) + 1).cast("int")
    payload = F.substring(F.repeat(F.md5(F.col("event_id").cast("string")), 19), F.lit(1), size).cast("binary")
    return e.withColumn("payload", payload)


#: The packets in SQL, and the page of each: a packet closes the page before it that would outlast the delay or 255 segments, and
#: its own once the delay is reached.
PAGES = f"""e AS (SELECT user_id AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, substr(repeat(md5(CAST(event_id AS VARCHAR)), 19), 1, event_id % 600 + 1) AS p,
  list_extract([120, 240, 480, 960, 1920], event_id % 5 + 1) AS n FROM events),
g AS (SELECT *, CAST(sum(n) OVER (PARTITION BY s ORDER BY i) AS BIGINT) AS g, length(p) // 255 + 1 AS need FROM e),
f AS (SELECT s, 1 AS i, 0 AS page, g, CASE WHEN g >= {DELAY} THEN 0 ELSE need END AS held, CASE WHEN g >= {DELAY} THEN g ELSE 0 END AS since, g >= {DELAY} AS full_ FROM g WHERE i = 1
  UNION ALL SELECT s, i, page + after, g, CASE WHEN done THEN 0 ELSE held + need END, CASE WHEN done THEN g ELSE since END, done FROM (
    SELECT *, g - since >= {DELAY} AS done FROM (
      SELECT g.s, g.i, g.g, g.need, f.page, CASE WHEN c.cut OR f.full_ THEN 1 ELSE 0 END AS after, CASE WHEN c.cut THEN 0 ELSE f.held END AS held, CASE WHEN c.cut THEN f.g ELSE f.since END AS since
      FROM f JOIN g ON g.s = f.s AND g.i = f.i + 1, LATERAL (SELECT f.held > 0 AND (g.g - f.since > {DELAY} OR f.held + g.need > 255) AS cut) AS c))),
pages AS (SELECT s, page + 2 AS seq, max(g) AS granule, count(*) AS packets, CAST(sum(need) AS BIGINT) AS segments, md5(string_agg(p, '' ORDER BY i)) AS digest, CAST(sum(length(p)) AS BIGINT) AS bytes,
  max(i) = max(max(i)) OVER (PARTITION BY s) AS eos FROM f JOIN g USING (s, i, g) GROUP BY s, page)"""
COLUMNS = "SELECT s AS stream_id, CAST(seq AS BIGINT) AS seq, granule, packets, segments, bytes, digest, eos FROM pages"


def described(pages: DataFrame) -> DataFrame:
    """The pages behind the two headers."""
    ended = F.size(F.filter("lacing", lambda x: x < 255)).cast("bigint")
    return pages.filter("seq >= 2").select(F.col("serial").alias("stream_id"), "seq", "granule", ended.alias("packets"), F.size("lacing").cast("bigint").alias("segments"), F.octet_length("body").cast("bigint").alias("bytes"), F.md5("body").alias("digest"), "eos")


@query(f"WITH RECURSIVE {PAGES} {COLUMNS}")
def pages_by_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams muxed to files with a delay of 100 ms, and read by five ranges of each file."""
    path = scratch(spark, "muxed")
    ogg.save_streams(packets(spark, sf_dir), path, delay=DELAY)
    return described(ogg.load_pages(spark, path, ranges=5))


@query(f"WITH RECURSIVE {PAGES} {COLUMNS}")
def pages_from_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same files as a stream of pieces of 997 bytes, which come in any order."""
    path = scratch(spark, "pieces")
    ogg.save_streams(packets(spark, sf_dir), f"{path}/files", delay=DELAY)
    whole = containers.files(spark, f"{path}/files")
    count = F.ceil(F.octet_length("content") / PIECE).cast("int")
    pieces = whole.select("path", "content", F.explode(F.sequence(F.lit(0), count - 1)).alias("piece"), count.alias("count"))
    pieces = pieces.select("path", F.col("piece").cast("bigint").alias("piece"), F.substring("content", F.col("piece") * PIECE + 1, F.lit(PIECE)).alias("data"), (F.col("piece") == F.col("count") - 1).alias("last"))
    parts = max(3, int(spark.conf.get("spark.sql.shuffle.partitions")))
    pieces.repartition(parts, F.xxhash64("path", "piece")).write.parquet(f"{path}/in")
    stream = spark.readStream.schema(pieces.schema).option("maxFilesPerTrigger", -(-2 * parts // 3)).parquet(f"{path}/in")
    run = sync.sync_pages(stream).writeStream.format("parquet").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start(f"{path}/out")
    run.awaitTermination()
    return described(spark.read.parquet(f"{path}/out"))


@query("""WITH e AS (SELECT user_id AS s, event_id % 2 AS k, event_id, ts, list_extract([120, 240, 480, 960, 1920], event_id % 5 + 1) AS n FROM events),
l AS (SELECT s, k, count(*) AS packets, CAST(sum(n) AS BIGINT) AS last_granule FROM e GROUP BY s, k)
SELECT s AS stream_id, CAST(row_number() OVER (PARTITION BY s ORDER BY k) - 1 AS INTEGER) AS link, (s + k * 2654435761) & 4294967295 AS serial, 1 AS channels, 312 AS pre_skip, CAST(44100 AS BIGINT) AS rate, 'tonelake query' AS vendor,
  packets, last_granule, 0 AS error_code FROM l""")
def links_of_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two links chained in each file, read by ranges, joined to packets and described by their own headers."""
    path = scratch(spark, "chained")
    ogg.save_streams(chained(spark, sf_dir, F.pmod("event_id", F.lit(2)).cast("int")), path, delay=DELAY, channels=1, rate=44100, vendor="tonelake query")
    found = streams.link_headers(containers.packets_of_pages(ogg.load_pages(spark, path, ranges=3)))
    name = F.regexp_extract("path", r"([0-9]+)\.opus$", 1).cast("bigint")
    return found.select(name.alias("stream_id"), "link", "serial", "channels", "pre_skip", "rate", "vendor", "packets", "last_granule", "error_code")


@query("""WITH e AS (SELECT event_id, md5(CAST(event_id AS VARCHAR)) AS h, f FROM events, (SELECT unnest([0, 1]) AS f)),
v AS (SELECT event_id, f, list_transform(range(0, 4), lambda i: CAST('0x' || substr(h, 16 * f + 4 * i + 3, 2) || substr(h, 16 * f + 4 * i + 1, 2) AS INTEGER)) AS v FROM e)
SELECT event_id, CAST(f AS INTEGER) AS frame_no, list_transform(v, lambda x: CAST(x - CASE WHEN x >= 32768 THEN 65536 ELSE 0 END AS INTEGER)) AS samples FROM v""")
def raw_pcm_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packets' bytes as 16-bit samples, two frames of four each."""
    content = views.packets(spark, sf_dir).select(F.col("event_id").cast("string").alias("path"), F.col("payload").alias("content"))
    found = containers.read_raw_pcm(content, 1, 4)
    return found.select(F.col("path").cast("bigint").alias("event_id"), F.col("frame_no").cast("int").alias("frame_no"), F.transform("samples", lambda x: x.cast("int")).alias("samples"))


@query("""SELECT user_id AS stream_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS packet_no, CAST(48000 AS BIGINT) AS rate, 2 AS channels, 960 AS frame_size,
  md5(unhex(md5(CAST(event_id AS VARCHAR)))) AS digest FROM events""")
def corpus_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stream's packets as a corpus of settings and records, read again."""
    p = views.packets(spark, sf_dir, numbered=True)
    records = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("packet_no", F.hex("payload").alias("h")))), lambda x: F.concat(F.lit("1000"), x["h"])), "")
    head = F.lit(b"OPUSPKT1".hex() + "80bb0000" + "0200" + "c003")
    files = p.groupBy("stream_id").agg(F.unhex(F.concat(head, records)).alias("content")).select(F.col("stream_id").cast("string").alias("path"), "content")
    return containers.read_corpus(files).select(F.col("path").cast("bigint").alias("stream_id"), "packet_no", "rate", "channels", "frame_size", F.md5("payload").alias("digest"))
