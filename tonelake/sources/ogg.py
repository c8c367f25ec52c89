"""Spark data sources for container files: pages by byte ranges, and a sink that muxes streams.

``ogg_pages`` reads files in ranges of bytes, so that one large file is many tasks. A page belongs to the range in
which its first byte lies. A task begins far enough before its range to have found a page that ends there,
goes from page to page into the range, and follows the last one beyond its end; so all ranges together
give what a reader of the whole file gives. ``ogg_streams`` writes each stream of packets as a file of
pages. Files are reached through Arrow's file systems, by path or URI.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from tonelake.functions.kernels import write_head, write_tags
from tonelake.shipping import ship
from tonelake.sources.containers import CONTINUED, FIRST, LAST, PAGE, PageSync, arrow_schema, build_page, page_row

#: Bytes of a page at most: its header, 255 segment lengths and as many segments of 255 bytes.
LARGEST_PAGE = 27 + 255 + 255 * 255
#: Bytes read at a time, and bytes of a range unless the reader is told otherwise.
PIECE, RANGE = 1 << 20, 64 << 20
#: Small ranges go to one task until it has so many bytes, or more if there would be more tasks than so many.
LEAST_TASK, MOST_TASKS = 1 << 20, 256
#: Files that the driver renames at a time.
CALLS = 16
#: Pages of one Arrow batch.
BATCH = 256
#: Samples of a page, at 48 kHz, unless the writer is told otherwise.
DELAY = 48000


def at_path(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def pages_from(file, start: int, stop: int, size: int) -> Iterator:
    """The good pages of a file that begin in [start, stop).

    The walk begins before ``start`` so that its first page begins a whole page's length before it: what stands
    inside a page may look like one, and a walk that began there is back on the file's own pages by then. If
    damage leaves no such page it begins further back.
    """
    back = 2 * LARGEST_PAGE
    while True:
        begin = max(0, start - back)
        trusted = begin == 0
        sync, at = PageSync(begin), begin
        file.seek(begin)
        while True:
            data = file.read(PIECE)
            at += len(data)
            for page in sync.feed(data, last=at >= size):
                trusted |= page.offset <= start - LARGEST_PAGE
                if not trusted or page.offset >= stop:
                    break
                if page.offset >= start:
                    yield page
            else:
                if at < size and sync.base < stop:
                    continue
                trusted |= at >= size and begin == 0
            break
        if trusted:
            return
        back *= 2


@dataclass
class ByteRanges(InputPartition):
    """What one task reads: (path, start, stop, size of the file) of one large range or of many small ones."""

    parts: list[tuple[str, int, int, int]]


class PageReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.ranges = int(options.get("ranges", 0))
        self.bytes = int(options.get("rangebytes", options.get("rangeBytes", RANGE)))

    def partitions(self) -> list[ByteRanges]:
        system, path = at_path(self.path)
        info = system.get_file_info(path)
        found = system.get_file_info(fs.FileSelector(path, recursive=True)) if info.type == fs.FileType.Directory else [info]
        files = sorted((f for f in found if f.is_file and not f.base_name.startswith(("_", "."))), key=lambda f: f.path)
        room = min(self.bytes, max(LEAST_TASK, sum(f.size for f in files) // MOST_TASKS))
        out, held = [ByteRanges([])], 0
        for f in files:
            step = -(-f.size // self.ranges) if self.ranges else self.bytes
            for at in range(0, f.size, max(1, step)):
                n = min(step, f.size - at)
                if held and held + n > room:
                    out.append(ByteRanges([]))
                    held = 0
                parts = out[-1].parts
                if at and parts:  # neighbours in one task are one walk, not each with a start of its own
                    parts[-1] = (f.path, parts[-1][1], at + n, f.size)
                else:
                    parts.append((f.path, at, at + n, f.size))
                held += n
        return out

    def read(self, partition: ByteRanges) -> Iterator[pa.RecordBatch]:
        schema, rows = arrow_schema(PAGE), []
        for path, start, stop, size in partition.parts:
            with at_path(self.path)[0].open_input_file(path) as file:
                for page in pages_from(file, start, stop, size):
                    rows.append(page_row(path, page))
                    if len(rows) == BATCH:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)


class OggPages(DataSource):
    """``spark.read.format("ogg_pages").load(path)``: a row for each good page, columns as ``read_pages``. Options: ``rangeBytes``
    of one task, or ``ranges`` for each file."""

    @classmethod
    def name(cls) -> str:
        return "ogg_pages"

    def schema(self) -> str:
        return PAGE

    def reader(self, schema) -> PageReader:
        return PageReader(dict(self.options))


class Packer:
    """Packets of one logical stream to pages. A page is closed before a packet that would take it beyond the muxing delay or
    255 segments, and after one that fills the delay; a packet of more segments goes on in the next pages."""

    def __init__(self, serial: int, delay: int = DELAY):
        self.serial, self.delay = serial & 0xFFFFFFFF, delay
        self.seq = self.granule = self.flushed_at = 0
        self.lacing, self.body, self.ends = bytearray(), bytearray(), []

    def add(self, payload: bytes, granule: int, last: bool = False) -> Iterator[bytes]:
        """The pages that a packet closes, all of them if it is the stream's ``last``."""
        segments = len(payload) // 255 + 1
        if self.delay and granule - self.flushed_at > self.delay or len(self.lacing) + segments > 255:
            yield from self.flush()
        self.lacing += b"\xff" * (segments - 1) + bytes([len(payload) % 255])
        self.body += payload
        self.ends.append((len(self.lacing), granule))
        self.granule = granule
        if last or self.delay and granule - self.flushed_at >= self.delay:
            yield from self.flush(last)

    def flush(self, last: bool = False) -> Iterator[bytes]:
        """What is held as pages, of 255 segments each; a page's granule is that of the last packet that ends on it."""
        at = start = 0
        carried = False
        while at < len(self.lacing):
            lacing = bytes(self.lacing[at : at + 255])
            stop = start + sum(lacing)
            ended = [g for n, g in self.ends if at < n <= at + len(lacing)]
            final = last and at + len(lacing) == len(self.lacing)
            flags = CONTINUED * carried | FIRST * (self.seq == 0) | LAST * final
            yield build_page(self.serial, self.seq, ended[-1] if ended else -1, flags, lacing, bytes(self.body[start:stop]))
            carried = lacing[-1] == 255
            at, start, self.seq = at + len(lacing), stop, self.seq + 1
        if self.lacing:
            self.flushed_at = self.granule
        self.lacing, self.body, self.ends = bytearray(), bytearray(), []


@dataclass
class Wrote(WriterCommitMessage):
    """The streams of a task, and the mark that its files bear until all tasks are done."""

    root: str
    mark: str
    streams: list[int]

    def names(self) -> Iterator[tuple[str, str]]:
        """Each file's name for now, and its own."""
        for s in self.streams:
            yield posixpath.join(self.root, f".{s}-{self.mark}"), posixpath.join(self.root, f"{s}.opus")


class StreamWriter(DataSourceArrowWriter):
    """Each task writes the streams of its rows, which come ordered by stream, link and packet, page by page. Files have names of
    their own until all tasks are done."""

    def __init__(self, options: dict):
        self.path, self.delay = options["path"], int(options.get("delay", DELAY))
        self.channels, self.pre_skip, self.rate = (int(options.get(k, d)) for k, d in (("channels", 2), ("pre_skip", 312), ("rate", 48000)))
        self.vendor = options.get("vendor", "tonelake").encode()

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Wrote:
        system, root = at_path(self.path)
        system.create_dir(root, recursive=True)
        done = Wrote(root, uuid.uuid4().hex, [])
        current = file = packer = held = link = None

        def close() -> None:
            if packer is not None:
                for page in packer.add(*held, last=True):
                    file.write(page)

        for b in iterator:
            for stream, at, payload, granule in zip(*[b.column(c).to_pylist() for c in ("stream_id", "link", "payload", "granule")], strict=True):
                if file is None or stream != current:
                    close()
                    if file is not None:
                        file.close()
                    current, packer = stream, None
                    done.streams.append(stream)
                    file = system.open_output_stream(posixpath.join(root, f".{stream}-{done.mark}"))
                if packer is None or at != link:  # a chained stream begins with headers of its own
                    close()
                    link, packer = at, Packer(serial_of(stream, at), self.delay)
                    for header in (write_head(self.channels, self.pre_skip, self.rate), write_tags(self.vendor, [])):
                        for page in (*packer.add(header, 0), *packer.flush()):
                            file.write(page)
                else:
                    for page in packer.add(*held):
                        file.write(page)
                held = (payload or b"", granule or 0)
        close()
        if file is not None:
            file.close()
        return done

    def commit(self, messages: list[Wrote | None]) -> None:
        system = at_path(self.path)[0]
        with ThreadPoolExecutor(CALLS) as pool:
            for m in messages:
                for _ in pool.map(lambda pair: system.move(*pair), m.names() if m else ()):
                    pass

    def abort(self, messages: list[Wrote | None]) -> None:
        system = at_path(self.path)[0]
        for m in messages:
            for held, _ in m.names() if m else ():
                system.delete_file(held)


def serial_of(stream: int, link: int) -> int:
    """A serial number for each link of a stream, the stream's own for the first."""
    return (stream + link * 0x9E3779B1) & 0xFFFFFFFF


class OggStreams(DataSource):
    """``df.write.format("ogg_streams").mode("append").save(path)``, by ``save_streams``. Options: ``delay`` (samples at 48 kHz, 0:
    none), ``channels``, ``pre_skip``, ``rate``, ``vendor``."""

    @classmethod
    def name(cls) -> str:
        return "ogg_streams"

    def writer(self, schema, overwrite: bool) -> StreamWriter:
        return StreamWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(OggPages)
    spark.dataSource.register(OggStreams)


def load_pages(spark: SparkSession, path: str, **options: object) -> DataFrame:
    register(spark)
    return spark.read.format("ogg_pages").options(**{k: str(v) for k, v in options.items()}).load(path)


def save_streams(packets: DataFrame, path: str, *, order: str = "packet_no", **options: object) -> None:
    """Write (stream_id, link, ``order``, payload, granule) as one file ``<stream_id>.opus`` for each stream, whose links are
    chained. A stream goes through a task packet by packet; none is held whole. Null payloads are
    empty, null granules 0."""
    register(packets.sparkSession)
    rows = packets.select("stream_id", "link", order, "payload", "granule").filter("stream_id IS NOT NULL")
    rows = rows.repartition("stream_id").sortWithinPartitions("stream_id", "link", order).drop(order)
    rows.write.format("ogg_streams").options(**{k: str(v) for k, v in options.items()}).mode("append").save(path)
