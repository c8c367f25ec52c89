"""Reading and writing coded-audio files: container pages, their packets, packet corpora and raw samples.

Files come through Spark's ``binaryFile`` reader, so any store that Spark reads will do, and each
file is one task's work: pages and packets of different files are read in parallel.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby, islice

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonelake.functions.kernels import page_crc, parse_head
from tonelake.shipping import ship

CONTINUED, FIRST, LAST = 1, 2, 4
PAGE = "path string, page_off bigint, end_off bigint, version int, continued boolean, bos boolean, eos boolean, granule bigint, serial bigint, seq bigint, lacing array<int>, body binary, crc_ok boolean, skipped bigint"
PACKET = "path string, serial bigint, link int, packet_no bigint, granule bigint, page_off bigint, bos boolean, eos boolean, hole_before boolean, payload binary"
CORPUS = "path string, rate bigint, channels int, frame_size int, packet_no bigint, payload binary"


@dataclass
class Page:
    offset: int
    end: int
    version: int
    flags: int
    granule: int
    serial: int
    seq: int
    lacing: bytes
    body: bytes
    crc_ok: bool
    skipped: int = 0


def page_at(data: bytes, at: int) -> Page | None:
    """The whole page at an offset, or None if none stands there or it is cut off."""
    if data[at : at + 4] != b"OggS" or len(data) < at + 27:
        return None
    version, flags, granule, serial, seq, crc, n = struct.unpack_from("<BBqIIIB", data, at + 4)
    lacing = data[at + 27 : at + 27 + n]
    start = at + 27 + n
    end = start + sum(lacing)
    if len(lacing) < n or end > len(data):
        return None
    ok = page_crc(data[at : at + 22] + bytes(4) + data[at + 26 : end]) == crc
    return Page(at, end, version, flags, granule, serial, seq, lacing, data[start:end], ok)


def scan_pages(data: bytes) -> Iterator[Page]:
    """All pages with a right checksum; ``skipped`` counts the bytes passed over before one."""
    at = good = 0
    while (at := data.find(b"OggS", at)) >= 0:
        page = page_at(data, at)
        if page and page.crc_ok:
            page.skipped = at - good
            yield page
            at = good = page.end
        else:
            at += 1


def build_page(serial: int, seq: int, granule: int, flags: int, lacing: bytes, body: bytes) -> bytes:
    head = b"OggS" + struct.pack("<BBqIII", 0, flags, granule, serial, seq, 0) + bytes([len(lacing)]) + lacing
    whole = head + body
    return whole[:22] + struct.pack("<I", page_crc(whole)) + whole[26:]


@dataclass
class _Stream:
    """What is carried from page to page of one stream."""

    link: int
    expected: int | None = None
    number: int = 0
    hole: bool = False
    part: bytearray = field(default_factory=bytearray)
    open: bool = False


def scan_packets(pages: Iterator[Page]) -> Iterator[dict]:
    """The packets of all streams. Lost pages leave a mark on the next packet and drop what they cut
    off; a page's granule goes to the last packet that ends on it, others have -1."""
    streams: dict[int, _Stream] = {}
    links = 0
    for page in pages:
        if page.flags & FIRST or page.serial not in streams:
            streams[page.serial] = _Stream(links)
            links += 1
        s = streams[page.serial]
        if s.expected is not None and page.seq != s.expected:
            s.hole, s.open = True, False
            s.part.clear()
        s.expected = (page.seq + 1) & 0xFFFFFFFF
        cut = bool(page.flags & CONTINUED) and not s.open
        if not page.flags & CONTINUED and s.open:
            s.part.clear()
            s.hole = True
        out, at = [], 0
        for n in page.lacing:
            s.part += page.body[at : at + n]
            at += n
            s.open = n == 255
            if not s.open:
                if not cut:
                    out.append(bytes(s.part))
                cut = False
                s.part.clear()
        if cut:
            s.part.clear()
            s.open = False
        for i, payload in enumerate(out):
            last = i == len(out) - 1
            yield {
                "serial": page.serial, "link": s.link, "packet_no": s.number, "granule": page.granule if last else -1, "page_off": page.offset,
                "bos": s.number == 0, "eos": bool(page.flags & LAST) and last, "hole_before": s.hole, "payload": payload,
            }
            s.number, s.hole = s.number + 1, False


def pack_stream(serial: int, packets: list[tuple[bytes, int]], fill: int = 4096) -> bytes:
    """A stream of (payload, granule) as pages: the first packet alone, others until ``fill`` bytes or 255 segments."""
    out = bytearray()
    lacing, body, granule, continued, seq = bytearray(), bytearray(), -1, False, 0

    def flush(last: bool, carries: bool) -> None:
        nonlocal lacing, body, granule, continued, seq
        flags = (CONTINUED if continued else 0) | (FIRST if seq == 0 else 0) | (LAST if last else 0)
        out.extend(build_page(serial, seq, granule, flags, bytes(lacing), bytes(body)))
        lacing, body, granule, continued, seq = bytearray(), bytearray(), -1, carries, seq + 1

    for i, (payload, position) in enumerate(packets):
        final = i == len(packets) - 1
        segments = [255] * (len(payload) // 255) + [len(payload) % 255]
        at = 0
        for k, n in enumerate(segments):
            lacing.append(n)
            body += payload[at : at + n]
            at += n
            ends = k == len(segments) - 1
            granule = position if ends else granule
            if len(lacing) == 255 and not (ends and final):
                flush(False, not ends)
        if lacing and (final or i == 0 or len(body) >= fill):
            flush(final, False)
    return bytes(out)


def files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def arrow_schema(schema: str) -> pa.Schema:
    types = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32())}
    return pa.schema([(c.split(" ", 1)[0], types[c.split(" ", 1)[1]]) for c in schema.split(", ")])


def _scan(contents: DataFrame, schema: str, rows) -> DataFrame:
    """``rows(path, content)`` for each file, in batches of a bounded number of rows."""
    ship(contents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                block = []
                for row in rows(path, content or b""):
                    block.append(row)
                    if len(block) == 1000:
                        yield pa.RecordBatch.from_pylist(block, schema=kinds)
                        block = []
                if block:
                    yield pa.RecordBatch.from_pylist(block, schema=kinds)

    kinds = arrow_schema(schema)
    return contents.select("path", "content").mapInArrow(run, schema)


def read_pages(contents: DataFrame) -> DataFrame:
    """One row for each good page of files given as (path, content)."""
    return _scan(contents, PAGE, lambda path, content: (page_row(path, p) for p in scan_pages(content)))


def page_row(path: str, p: Page) -> dict:
    return {
        "path": path, "page_off": p.offset, "end_off": p.end, "version": p.version, "continued": bool(p.flags & CONTINUED), "bos": bool(p.flags & FIRST), "eos": bool(p.flags & LAST),
        "granule": p.granule, "serial": p.serial, "seq": p.seq, "lacing": list(p.lacing), "body": p.body, "crc_ok": p.crc_ok, "skipped": p.skipped,
    }


def read_packets(contents: DataFrame) -> DataFrame:
    """One row for each packet of files given as (path, content)."""
    return _scan(contents, PACKET, lambda path, content: ({"path": path} | p for p in scan_packets(scan_pages(content))))


def packets_of_pages(pages: DataFrame) -> DataFrame:
    """One row for each packet of pages that came by any reader, as ``read_packets`` with ``link_off`` in place of ``link``: where the first page of
    the packet's link stands. Pages are sorted within partitions by file, serial number and place, and walked one by one,
    so that no stream is held."""
    ship(pages.sparkSession)
    names = ["path", "serial", "page_off", "end_off", "continued", "bos", "eos", "granule", "seq", "lacing", "body"]
    schema = PACKET.replace("link int", "link_off bigint")
    kinds = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts: list[int] = []

        def walk() -> Iterator[tuple]:
            for b in batches:
                yield from zip(*[c.to_pylist() for c in b.columns], strict=True)

        def of_stream(rows: Iterator[tuple]) -> Iterator[Page]:
            starts.clear()
            for _, serial, at, end, continued, bos, eos, granule, seq, lacing, body in rows:
                if bos or not starts:
                    starts.append(at)
                yield Page(at, end, 0, CONTINUED * continued | FIRST * bos | LAST * eos, granule, serial, seq, bytes(lacing), body, True)

        def packets() -> Iterator[dict]:
            for (path, _), rows in groupby(walk(), key=lambda r: r[:2]):
                for p in scan_packets(of_stream(rows)):
                    yield {"path": path, "link_off": starts[p.pop("link")]} | p

        found = packets()
        while some := list(islice(found, 1000)):
            yield pa.RecordBatch.from_pylist(some, schema=kinds)

    return pages.select(*names).repartition("path", "serial").sortWithinPartitions("path", "serial", "page_off").mapInArrow(run, schema)


def write_streams(packets: DataFrame, *, stream: str = "stream_id", order: str = "packet_no", granule: str = "granule", payload: str = "payload") -> DataFrame:
    """One row (stream, content) with each stream's pages; streams are packed in parallel."""
    ship(packets.sparkSession)
    rows = packets.select(F.col(stream).cast("bigint").alias("s"), F.col(order).alias("o"), F.col(granule).cast("bigint").alias("g"), F.col(payload).alias("p"))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("o", kind="stable")
        s = int(pdf["s"].iloc[0])
        return pd.DataFrame({"s": [s], "content": [pack_stream(s & 0xFFFFFFFF, [(bytes(p), int(g)) for p, g in zip(pdf["p"], pdf["g"], strict=True)])]})

    return rows.groupBy("s").applyInPandas(pack, "s bigint, content binary").withColumnRenamed("s", stream)


CORPORA = {b"OPUSPKT1": "<IHH", b"OPUSBEN1": "<IHHIiBBH"}


def scan_corpus(content: bytes) -> Iterator[dict]:
    """Packets of a corpus: a magic, settings, then records of a 16-bit length and bytes; a cut-off record is left out."""
    form = CORPORA.get(content[:8])
    if form is None or len(content) < 8 + struct.calcsize(form):
        return
    rate, channels, frame = struct.unpack_from(form, content, 8)[:3]
    at, number = 8 + struct.calcsize(form), 0
    while at + 2 <= len(content):
        (n,) = struct.unpack_from("<H", content, at)
        if at + 2 + n > len(content):
            return
        yield {"rate": rate, "channels": channels, "frame_size": frame, "packet_no": number, "payload": content[at + 2 : at + 2 + n]}
        at, number = at + 2 + n, number + 1


def read_corpus(contents: DataFrame) -> DataFrame:
    return _scan(contents, CORPUS, lambda path, content: ({"path": path} | p for p in scan_corpus(content)))


def write_corpus(payloads: list[bytes], rate: int = 48000, channels: int = 2, frame_size: int = 960) -> bytes:
    return b"OPUSPKT1" + struct.pack("<IHH", rate, channels, frame_size) + b"".join(struct.pack("<H", len(p)) + p for p in payloads)


def read_raw_pcm(contents: DataFrame, channels: int, frame: int) -> DataFrame:
    """Frames of 16-bit little-endian samples, without Python: path, frame_no, samples; a cut-off tail is left out."""
    size = 2 * channels * frame
    count = F.floor(F.octet_length("content") / size).cast("int")
    frames = contents.filter(count > 0).select("path", F.explode(F.sequence(F.lit(0), count - 1)).alias("frame_no"), "content")
    frames = frames.select("path", "frame_no", F.hex(F.substring("content", F.col("frame_no") * size + 1, F.lit(size))).alias("h"))

    def sample(i):
        low, high = (F.conv(F.substring("h", i * 4 + k, F.lit(2)), 16, 10).cast("int") for k in (1, 3))
        x = low + high * 256
        return x - F.when(x >= 32768, 65536).otherwise(0)

    return frames.select("path", "frame_no", F.transform(F.sequence(F.lit(0), F.lit(channels * frame - 1)), sample).alias("samples"))


class PageSync:
    """Pages from bytes that arrive in pieces, the first of which stands at ``base``; a page is given once it is whole, damage
    is skipped."""

    def __init__(self, base: int = 0) -> None:
        self.held, self.base, self.good = b"", base, base

    def feed(self, data: bytes, last: bool = False) -> list[Page]:
        """The pages that ``data`` completes. With ``last`` nothing more will come."""
        self.held += data
        out, at = [], 0
        while (at := self.held.find(b"OggS", at)) >= 0:
            page = page_at(self.held, at)
            if page is None and not last and self._may_grow(at):
                break
            if page is None or not page.crc_ok:
                at += 1
                continue
            page.offset, page.end = self.base + at, self.base + page.end
            page.skipped, self.good = page.offset - self.good, page.end
            out.append(page)
            at = page.end - self.base
        # without a capture pattern only the last three bytes can begin one
        keep = at if at >= 0 else max(self.good - self.base, len(self.held) - 3)
        self.held, self.base = self.held[keep:], self.base + keep
        return out

    def _may_grow(self, at: int) -> bool:
        if len(self.held) < at + 27:
            return True
        n = self.held[at + 26]
        lacing = self.held[at + 27 : at + 27 + n]
        return len(lacing) < n or len(self.held) < at + 27 + n + sum(lacing)


def probe(content: bytes) -> dict | None:
    """The identification header of a file's first stream, or None if there is none (yet)."""
    for page in scan_pages(content):
        if page.flags & FIRST and page.body[:8] == b"OpusHead":
            return parse_head(page.body)
    return None
