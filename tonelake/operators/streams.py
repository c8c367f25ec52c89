"""Relational operators over pages, packets and tags: gaps, links, seeks, rates and lookups.

Each partitions by stream and never gathers one in memory; a seek is one window over the union of
index and queries, so it needs no range join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonelake.functions import kernels


def page_holes(pages: DataFrame, *, stream: str = "serial", order: tuple[str, ...] = ("page_off",), seq: str = "seq") -> DataFrame:
    """``pages`` with ``missing``: pages lost between the page before of the stream and this one (0 at the start)."""
    w = Window.partitionBy(stream).orderBy(*order)
    gap = F.col(seq) - F.lag(seq).over(w) - 1
    return pages.withColumn("missing", F.coalesce(F.greatest(gap, F.lit(0)), F.lit(0)))


def lacing(length: Column) -> Column:
    """Segments of a packet of ``length`` bytes on its pages: full ones of 255 and one of the rest."""
    segments = F.floor(length / 255).cast("int")
    return F.concat(F.array_repeat(F.lit(255), segments), F.array(F.pmod(length, F.lit(255)).cast("int")))


def link_intervals(pages: DataFrame, *, stream: str = "serial", granule: str = "granule") -> DataFrame:
    """Per stream (a whole number from 0) the half-open sample interval [start, stop) that it covers when
    streams are chained by ``stream``.

    Sums run over ranges of 65,536 streams, of as many such ranges, and so on, so that no task holds more
    than 65,536 rows.
    """
    links = pages.groupBy(stream).agg(F.sum(granule).alias("samples"))
    level = links.select(F.col(stream).cast("bigint").alias("at"), "samples")
    before = []
    for _ in range(4):
        level = level.withColumn("above", F.shiftright("at", 16))
        run = F.sum("samples").over(Window.partitionBy("above").orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
        before.append(level.select("at", F.coalesce(run, F.lit(0)).alias("before")))
        level = level.groupBy(F.col("above").alias("at")).agg(F.sum("samples").alias("samples"))
    start = F.lit(0).cast("bigint")
    for i, sums in enumerate(before):
        links = links.withColumn("at", F.shiftright(F.col(stream).cast("bigint"), 16 * i)).join(sums.withColumnRenamed("before", f"before{i}"), "at").drop("at")
        start = start + F.col(f"before{i}")
    return links.select(stream, start.alias("start"), (start + F.col("samples")).alias("stop"))


def seek(index: DataFrame, queries: DataFrame, *, stream: str, at: str, value: str) -> DataFrame:
    """``queries`` (stream, at) with ``value`` of the last index row at or before the position, or null.

    Of index rows at one position the largest value wins.
    """
    rows = index.select(stream, at, F.col(value).alias("v"), F.lit(0).alias("is_query")).unionByName(queries.select(stream, at, F.lit(None).cast(index.schema[value].dataType).alias("v"), F.lit(1).alias("is_query")))
    w = Window.partitionBy(stream).orderBy(at, "is_query", F.col("v").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(value, F.last("v", ignorenulls=True).over(w)).filter("is_query = 1").select(stream, at, value)


def bitrate(payload_bytes: Column, samples: Column) -> Column:
    """Rounded bits a second at 48 kHz; the largest int without samples or beyond it."""
    cap = F.lit(2147483647).cast("bigint")
    exact = F.floor((payload_bytes * 8 * 48000 + F.floor(samples / 2)) / samples).cast("bigint")
    return F.when(samples <= 0, cap).otherwise(F.least(exact, cap))


def fold_ascii(text: Column) -> Column:
    """Lower case of A to Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tag_values(comments: Column, key: str) -> Column:
    """Values of an array of KEY=value comments with the key, in order, whatever its ASCII case."""
    head = key.lower() + "="
    found = F.filter(comments, lambda c: F.startswith(fold_ascii(F.substring(c, 1, len(head))), F.lit(head)))
    return F.transform(found, lambda c: F.substring(c, len(head) + 1, F.length(c)))


def tag_gain(comments: Column, key: str) -> Column:
    """The first value of the key that is a signed whole number of 16 bits, in 1/256 dB."""
    numbers = F.filter(tag_values(comments, key), lambda v: v.rlike(r"^[+-]?[0-9]+$"))
    parsed = F.transform(numbers, lambda v: v.try_cast("decimal(38,0)"))
    return F.get(F.filter(parsed, lambda v: v.between(-32768, 32767)), F.lit(0)).cast("int")


def runs(rows: DataFrame, *, stream: str, order: tuple[str, ...], flag: str) -> DataFrame:
    """Per stream the runs of equal ``flag``: first, last and rows, by the changes before each row."""
    w = Window.partitionBy(stream).orderBy(*order)
    changed = F.when(F.col(flag) != F.lag(flag).over(w), 1).otherwise(0)
    numbered = rows.withColumn("pos", F.row_number().over(w)).withColumn("changed", changed)
    numbered = numbered.withColumn("run", F.sum("changed").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(stream, "run", flag).agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.count("*").alias("rows"))


def link_totals(packets: DataFrame, *, stream: str = "stream_id", payload: str = "payload", samples: str = "samples") -> DataFrame:
    """Packets, bytes and samples of each link."""
    return packets.groupBy(stream).agg(F.count("*").alias("packets"), F.sum(F.octet_length(payload)).cast("bigint").alias("bytes"), F.sum(samples).cast("bigint").alias("samples"))


def instant_bitrates(packets: DataFrame, every: int, *, stream: str = "stream_id", order: str = "packet_no", payload: str = "payload", samples: str = "samples") -> DataFrame:
    """Bitrate of every ``every`` packets of a stream: what asking after each of them would give."""
    part = F.floor((F.col(order) - 1) / every).alias("part")
    sums = packets.groupBy(stream, part).agg(F.sum(F.octet_length(payload)).cast("bigint").alias("bytes"), F.sum(samples).cast("bigint").alias("samples"))
    return sums.withColumn("bitrate", bitrate(F.col("bytes"), F.col("samples")))


def links_of_positions(links: DataFrame, positions: DataFrame, *, at: str, start: str = "start", stop: str = "stop", link: str = "link", width: int = 1 << 20) -> DataFrame:
    """``positions`` with the link [start, stop) that each lies in, and the last link for those behind all.

    Links and positions are cut into cells of ``width`` samples, each link standing in all cells that it
    covers, so the join is one on equal cells; rows grow with the links and what they last.
    """
    cell = lambda c: F.floor(c / F.lit(width)).cast("bigint")
    spans = links.filter(F.col(start) < F.col(stop)).select(F.col(start).alias("b"), F.col(stop).alias("e"), F.col(link).alias("l"))
    spans = spans.select("*", F.explode(F.sequence(cell(F.col("b")), cell(F.col("e") - 1))).alias("cell"))
    asked = positions.select(F.col(at).alias("p")).withColumn("cell", cell(F.col("p")))
    inside = (asked["cell"] == spans["cell"]) & (asked["p"] >= spans["b"]) & (asked["p"] < spans["e"])
    # one row: where all links end, and the last of them
    end = links.agg(F.max(stop).alias("end"), F.max_by(link, F.struct(F.col(stop), F.col(link))).alias("last"))
    found = asked.join(spans, inside, "left").select("p", "l").join(F.broadcast(end))
    return found.select(F.col("p").alias(at), F.when(F.col("p") >= F.col("end"), F.col("last")).otherwise(F.col("l")).alias(link))


def granule_sample(granule: Column, pre_skip: Column) -> Column:
    """The sample at a page's granule position behind the encoder's delay; null for -1, a page on which no packet ends."""
    return F.when(granule != -1, granule - pre_skip)


def pcm_seek(links: DataFrame, positions: DataFrame, *, at: str, width: int = 1 << 20) -> DataFrame:
    """(at, link, local, error_code): where each sample position lies; beyond the end it is a bad argument (-131)."""
    found = links_of_positions(links, positions, at=at, width=width).join(links.select("link", "start", "stop"), "link", "left")
    end = links.agg(F.max("stop").alias("end"))
    found = found.join(F.broadcast(end))
    ok = F.col(at).between(0, F.col("end"))
    return found.select(at, F.when(ok, F.col("link")).alias("link"), F.when(ok, F.col(at) - F.col("start")).alias("local"), F.when(ok, 0).otherwise(-131).alias("error_code"))


def read_samples(samples: Column, channels: int, cursor: Column, room: Column) -> Column:
    """What a read of ``room`` values gives from a link's interleaved samples at a cursor: whole frames, up to the link's end."""
    frames = F.greatest(F.least(F.floor(F.size(samples) / channels) - cursor, F.floor(room / channels)), F.lit(0)).cast("int")
    return F.when(frames > 0, F.slice(samples, cursor.cast("int") * channels + 1, frames * channels)).otherwise(F.slice(samples, 1, 0))


def gain_offset(tag_gain_q8: Column, offset_q8: Column) -> Column:
    """A gain in 1/256 dB with an offset of the user's, which is held to 16 bits."""
    return tag_gain_q8 + F.greatest(F.least(offset_q8, F.lit(32767)), F.lit(-32768))


def delayed(frames: DataFrame, by: int, *, stream: str = "stream_id", order: str = "packet_no", samples: str = "samples") -> DataFrame:
    """(stream, order, samples): each stream ``by`` samples later, frame by frame, with zeros at its start. Frames
    are no shorter than the delay; one task needs only a frame and the one before."""
    s = F.col(samples).cast("array<double>")
    tail = F.lag(F.slice(s, F.size(s) - by + 1, F.lit(by))).over(Window.partitionBy(stream).orderBy(order))
    return frames.select(stream, order, F.concat(F.coalesce(tail, F.array_repeat(F.lit(0.0), by)), F.slice(s, F.lit(1), F.size(s) - by)).alias(samples))


def with_comment(comments: Column, key: Column, value: Column) -> Column:
    """A list of comments and one more."""
    return F.array_append(comments, F.concat(key, F.lit("="), value))


def binary_suffix(data: Column) -> Column:
    """struct(suffix, error_code): bytes to follow the comments. Their first bit must be set, or they are
    refused; no bytes remove the suffix."""
    kept = (F.octet_length(data) == 0) | (F.pmod(F.conv(F.hex(F.substring(data, 1, 1)), 16, 10).cast("int"), F.lit(2)) == 1)
    return F.struct(F.when(kept & (F.octet_length(data) > 0), data).alias("suffix"), F.when(kept, 0).otherwise(-131).alias("error_code"))


def link_headers(packets: DataFrame) -> DataFrame:
    """One row for each link of files' packets (as ``packets_of_pages`` gives them): path, link (from 0 in the order of the file), serial, what its
    identification and comment headers say, its audio packets and its last granule. A link without good headers has nulls and an
    ``error_code``."""
    by = ["path", "serial", "link_off"]
    at = lambda n: F.first(F.when(F.col("packet_no") == n, F.col("said")), ignorenulls=True)
    # first() of bytes sorts its rows: those of audio go without their bytes
    narrow = packets.select(*by, "packet_no", "granule", F.when(F.col("packet_no") <= 1, F.col("payload")).alias("said"))
    links = narrow.groupBy(*by).agg(at(0).alias("head"), at(1).alias("tags"), F.count(F.when(F.col("packet_no") > 1, 1)).alias("packets"), F.max("granule").alias("last_granule"))
    links = links.withColumn("link", F.row_number().over(Window.partitionBy("path").orderBy("link_off")) - 1)
    links = links.withColumn("h", kernels.head_udf()(F.coalesce("head", F.lit(b"")))).withColumn("t", kernels.tags_udf()(F.coalesce("tags", F.lit(b""))))
    code = F.when(F.col("h.error_code") != 0, F.col("h.error_code")).otherwise(F.col("t.error_code"))
    return links.select("path", "link", "serial", "h.channels", "h.pre_skip", "h.rate", "h.gain", "h.family", F.col("t.vendor").cast("string").alias("vendor"), F.transform("t.comments", lambda x: x.cast("string")).alias("comments"), "packets", "last_granule", code.alias("error_code"))
