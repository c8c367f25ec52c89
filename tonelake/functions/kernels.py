"""Byte-level kernels: packets, padding extensions, headers, comments, pictures and page checksums.

Each works on one value in plain Python and has an Arrow UDF beside it that returns a struct with an
``error_code`` (0 is none), so that one bad row does not fail a job.
"""

from __future__ import annotations

import base64
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import functions as F

from tonelake.shipping import ship

INVALID, NOT_FORMAT, BAD_HEADER, BAD_VERSION, UNSUPPORTED = -4, -132, -133, -134, -130
TOO_SMALL = -2
MAX_FRAMES, MAX_FRAME_BYTES, MAX_SAMPLES = 48, 1275, 5760


class BadBytes(ValueError):
    """Bytes that do not follow their format; ``code`` is the error code."""

    def __init__(self, code: int):
        super().__init__(f"error {code}")
        self.code = code


class Cursor:
    """Reads forward over bytes and raises ``BadBytes`` behind the end."""

    def __init__(self, data: bytes, at: int = 0, end: int | None = None, code: int = INVALID):
        self.data, self.at, self.end, self.code = data, at, len(data) if end is None else end, code

    @property
    def left(self) -> int:
        return self.end - self.at

    def take(self, n: int) -> bytes:
        if n < 0 or n > self.left:
            raise BadBytes(self.code)
        self.at += n
        return self.data[self.at - n : self.at]

    def byte(self) -> int:
        return self.take(1)[0]

    def number(self, form: str) -> int:
        return struct.unpack(form, self.take(struct.calcsize(form)))[0]

    def size(self) -> int:
        """A frame's coded length: one byte, or two from 252 on."""
        a = self.byte()
        return a if a < 252 else 4 * self.byte() + a


def frame_samples(toc: int, rate: int = 48000) -> int:
    if toc & 0x80:
        return (rate << (toc >> 3 & 3)) // 400
    if toc & 0x60 == 0x60:
        return rate // 50 if toc & 8 else rate // 100
    return rate * 60 // 1000 if toc >> 3 & 3 == 3 else (rate << (toc >> 3 & 3)) // 100


@dataclass
class Packet:
    toc: int
    frames: list[bytes]
    offset: int
    used: int
    padding: bytes


def parse_packet(data: bytes, self_delimited: bool = False) -> Packet:
    """Split a packet into its frames and padding (RFC 6716, section 3.2 and appendix B)."""
    c = Cursor(data)
    toc = c.byte()
    code, sizes, pad, even = toc & 3, [], 0, True
    if code == 3:
        head = c.byte()
        count, even = head & 63, not head & 128
        if not 0 < count <= MAX_FRAMES or count * frame_samples(toc) > MAX_SAMPLES:
            raise BadBytes(INVALID)
        more = 255 if head & 64 else 0
        while more == 255:
            more = c.byte()
            pad += min(more, 254)
        c.end -= pad
        if c.left < 0:
            raise BadBytes(INVALID)
    else:
        count, even = (1 if code == 0 else 2), code != 2
    if not even:
        sizes = [0] * (count - 1)
        for i in range(count - 1):
            sizes[i] = c.size()
            if sizes[i] > c.left:
                raise BadBytes(INVALID)
    if self_delimited:
        last = c.size()
        if even:
            sizes = [last] * (count - 1)
        if sum(sizes) + last > c.left:
            raise BadBytes(INVALID)
    elif even:
        last, odd = divmod(c.left, count)
        if odd:
            raise BadBytes(INVALID)
        sizes = [last] * (count - 1)
    else:
        last = c.left - sum(sizes)
    if last < 0 or (not self_delimited and last > MAX_FRAME_BYTES):
        raise BadBytes(INVALID)
    offset = c.at
    frames = [c.take(n) for n in [*sizes, last]]
    at = c.at
    return Packet(toc, frames, offset, at + pad, data[at : at + pad])


def build_packet(toc: int, frames: list[bytes], pad_to: int = 0, carried: list[Extension] | None = None) -> bytes:
    """A packet of frames with the shortest fitting code, ``pad_to`` bytes long if that is more. Extensions that it carries stand at the
    padding's end, and make it as long as they need if it isn't given."""
    lengths = [len(f) for f in frames]
    if not 0 < len(frames) <= MAX_FRAMES or max(lengths) > MAX_FRAME_BYTES or len(frames) * frame_samples(toc) > MAX_SAMPLES:
        raise BadBytes(-1)
    same, base, body = len(set(lengths)) == 1, toc & 0xFC, b"".join(frames)
    coded = lambda n: bytes([n]) if n < 252 else bytes([252 + (n & 3), (n - 252 - (n & 3)) // 4])
    short = {1: bytes([base]) + body, 2: bytes([base | 1]) + body if same else bytes([base | 2]) + coded(lengths[0]) + body}.get(len(frames))
    extra = write_extensions(carried, len(frames)) if carried else b""
    if short is not None and len(short) >= pad_to and not extra:
        return short
    sizes = b"" if same else b"".join(map(coded, lengths[:-1]))
    plain = len(sizes) + len(body) + 2
    if plain >= pad_to and not extra:
        return bytes([base | 3, len(frames) | (0 if same else 128)]) + sizes + body
    # counts the padding's length bytes too: each of 255 stands for itself and 254
    need = pad_to - plain if pad_to else len(extra) + len(extra) // 254 + 1
    full, rest = divmod(need - 1, 255)
    room = full * 254 + rest
    if need < 1 or room < len(extra):
        raise BadBytes(TOO_SMALL)
    filled = b"\x01" * (room - len(extra)) + extra if extra else bytes(room)
    return bytes([base | 3, len(frames) | (0 if same else 128) | 64]) + b"\xff" * full + bytes([rest]) + sizes + body + filled


def unpad_packet(data: bytes) -> bytes:
    p = parse_packet(data)
    return build_packet(p.toc, p.frames)


def merge_packets(packets: list[bytes]) -> bytes:
    """One packet of all packets' frames; they must agree in all but the frame code, and last 120 ms at most."""
    parsed = [parse_packet(p) for p in packets]
    if not parsed or any((p.toc ^ parsed[0].toc) & 0xFC for p in parsed):
        raise BadBytes(INVALID)
    return build_packet(parsed[0].toc, [f for p in parsed for f in p.frames])


def split_streams(data: bytes, streams: int) -> list[Packet]:
    """The packets of a multistream packet: all but the last are self-delimited, and all last equally long."""
    out, at = [], 0
    for i in range(streams):
        p = parse_packet(data[at:], i < streams - 1)
        out.append(p)
        at += p.used
    if not out or len({len(p.frames) * frame_samples(p.toc) for p in out}) > 1:
        raise BadBytes(INVALID)
    return out


def join_streams(packets: list[bytes], pad_to: int = 0, carried: list[Extension] | None = None) -> bytes:
    """A multistream packet of plain packets; padding goes to the last one, and so do the extensions that it carries."""
    out = b""
    for i, data in enumerate(packets):
        p = parse_packet(data)
        if i == len(packets) - 1:
            return out + build_packet(p.toc, p.frames, pad_to - len(out), carried)
        plain = build_packet(p.toc, p.frames)
        last = len(p.frames[-1])
        coded = bytes([last]) if last < 252 else bytes([252 + (last & 3), (last - 252 - (last & 3)) // 4])
        # the last frame's length stands before the frames
        body = sum(map(len, p.frames))
        out += plain[: len(plain) - body] + coded + plain[len(plain) - body :]
    return out


def unpad_streams(data: bytes, streams: int) -> bytes:
    return join_streams([build_packet(p.toc, p.frames) for p in split_streams(data, streams)])


@dataclass
class Extension:
    id: int
    frame: int
    data: bytes


@dataclass
class _Scan:
    """Where the payload of each extension since the last frame separator began, for repeats."""

    headers: list[tuple[int, int]] = field(default_factory=list)


def _payload(c: Cursor, id_: int, flag: int, reserve: int = 0) -> bytes:
    """An extension's payload: short ones have 0 or 1 byte; long ones a coded length, or all but ``reserve`` bytes."""
    if id_ < 32:
        return c.take(flag)
    if not flag:
        return c.take(c.left - reserve)
    n = 0
    while (b := c.byte()) == 255:
        n += 255
    return c.take(n + b)


def extensions(padding: bytes, frames: int) -> Iterator[Extension]:
    """The padding's extensions in coded order: id 1 moves to a later frame, id 2 repeats the frame's
    extensions for all later frames, other ids carry data. Raises ``BadBytes`` where they break off."""
    c, frame, since = Cursor(padding), 0, _Scan()
    while c.left > 0 and frame < frames:
        head = c.byte()
        id_, flag = head >> 1, head & 1
        if id_ == 0:  # padding: a byte, or with a clear flag all the rest
            if not flag:
                return
        elif id_ == 1:
            step = c.byte() if flag else 1
            if step:
                frame, since = frame + step, _Scan()
                if frame >= frames:
                    raise BadBytes(INVALID)
        elif id_ == 2:
            listed = since.headers
            longs = [i for i, (x, _) in enumerate(listed) if x >= 32]
            for later in range(frame + 1, frames):
                for i, (x, f) in enumerate(listed):
                    last = not flag and later == frames - 1 and longs and i == longs[-1]
                    reserve = sum(g for y, g in listed[i + 1 :] if y < 32) if last else 0
                    yield Extension(x, later, _payload(c, x, 0 if last else f, reserve))
            since = _Scan()
            if not flag:
                frame += 1
                if frame >= frames:
                    return
        else:
            data = _payload(c, id_, flag)
            since.headers.append((id_, flag))
            yield Extension(id_, frame, data)


def count_extensions(padding: bytes, frames: int) -> int:
    """How many extensions come before the end or the first error."""
    n = 0
    try:
        for _ in extensions(padding, frames):
            n += 1
    except BadBytes:
        pass
    return n


def _coded(e: Extension, bare: bool) -> tuple[int, bytes]:
    """An extension's flag and payload; a long one that is ``bare`` takes all that is left and has no length."""
    if e.id < 32:
        return len(e.data), e.data
    return (0, e.data) if bare else (1, b"\xff" * (len(e.data) // 255) + bytes([len(e.data) % 255]) + e.data)


def write_extensions(items: list[Extension], frames: int, pad_to: int = 0) -> bytes:
    """Padding bytes for extensions, by frame and within a frame as they come; behind padding if ``pad_to`` is more bytes.

    What a frame begins with, and all later frames begin with too, apart from the data, is said once: a repeat with
    the later frames' data follows. The last extension, if long, goes without a length, and so does the last
    long one of a repeat that is the last.
    """
    if any(not 2 < e.id < 128 or not 0 <= e.frame < frames or (e.id < 32 and len(e.data) > 1) for e in items):
        raise BadBytes(-1)
    left = [[e for e in items if e.frame == f] for f in range(frames)]
    out, now, missing = bytearray(), 0, len(items)
    for f, mine in enumerate(left):
        later = left[f + 1 :]
        alike = lambda a, b: a.id == b.id and (a.id >= 32 or len(a.data) == len(b.data))
        most = min(map(len, (mine, *later))) if later else 0
        same = next((k for k in range(most) if not all(alike(mine[k], other[k]) for other in later)), most)
        for k, e in enumerate(mine):
            if f != now:
                out += b"\x02" if f == now + 1 else bytes([3, f - now])
                now = f
            missing -= 1
            flag, data = _coded(e, not missing)
            out += bytes([e.id << 1 | flag]) + data
            if k + 1 != same:
                continue
            longs = [i for i, x in enumerate(mine[:same]) if x.id >= 32]
            missing -= same * len(later)
            ends = not missing or (not longs and same == len(mine))
            out.append(4 if ends else 5)
            for g, other in enumerate(later, f + 1):
                for i, x in enumerate(other[:same]):
                    out += _coded(x, ends and g == frames - 1 and i == max(longs, default=-1))[1]
                del other[:same]
            now += ends
    return b"\x01" * (pad_to - len(out)) + bytes(out)


# The extension that carries redundancy, what its payload begins with, and samples of a unit of its offset.
REDUNDANCY, REDUNDANCY_MARK, REDUNDANCY_UNIT = 126, b"D\x0a", 120


def redundancy(data: bytes) -> dict:
    """The first redundancy payload of a packet: its bytes behind the mark, and how far into the packet its frame lies, in units of 2.5 ms.
    Extensions of the same id that lack the mark are passed over. Raises ``BadBytes`` where packet or padding break off
    before it."""
    p = parse_packet(data)
    for e in extensions(p.padding, len(p.frames)):
        if e.id == REDUNDANCY and len(e.data) > len(REDUNDANCY_MARK) and e.data.startswith(REDUNDANCY_MARK):
            return {"payload": e.data[len(REDUNDANCY_MARK) :], "frame_offset": e.frame * frame_samples(p.toc) // REDUNDANCY_UNIT}
    return {"payload": None, "frame_offset": None}


def parse_head(data: bytes) -> dict:
    """The identification header (RFC 7845, section 5.1)."""
    if data[:8] != b"OpusHead":
        raise BadBytes(NOT_FORMAT)
    c = Cursor(data, 8, code=BAD_HEADER)
    version = c.byte()
    if version > 15:
        raise BadBytes(BAD_VERSION)
    channels, pre_skip, rate, gain, family = struct.unpack("<BHIhB", c.take(10))
    out = {"version": version, "channels": channels, "pre_skip": pre_skip, "rate": rate, "gain": gain, "family": family}
    if family == 0:
        if channels not in (1, 2):
            raise BadBytes(BAD_HEADER)
        out |= {"streams": 1, "coupled": channels - 1, "mapping": list(range(channels))}
    elif family == 1:
        if not 1 <= channels <= 8:
            raise BadBytes(BAD_HEADER)
        streams, coupled = c.byte(), c.byte()
        mapping = list(c.take(channels))
        if streams < 1 or coupled > streams or any(m != 255 and m >= streams + coupled for m in mapping):
            raise BadBytes(BAD_HEADER)
        out |= {"streams": streams, "coupled": coupled, "mapping": mapping}
    else:
        raise BadBytes(UNSUPPORTED if family == 255 else BAD_HEADER)
    if version <= 1 and c.left:
        raise BadBytes(BAD_HEADER)
    return out


def write_head(channels: int, pre_skip: int, rate: int, gain: int = 0, streams: int = 1, coupled: int | None = None, mapping: list[int] | None = None) -> bytes:
    head = b"OpusHead" + struct.pack("<BBHIhB", 1, channels, pre_skip, rate, gain, 0 if mapping is None else 1)
    return head if mapping is None else head + bytes([streams, coupled or 0, *mapping])


def parse_tags(data: bytes) -> dict:
    """The comment header (RFC 7845, section 5.2): vendor, comments and a binary suffix if its first bit is set."""
    if data[:8] != b"OpusTags":
        raise BadBytes(NOT_FORMAT)
    c = Cursor(data, 8, code=BAD_HEADER)
    vendor = c.take(c.number("<I"))
    count = c.number("<I")
    if count > c.left // 4:
        raise BadBytes(BAD_HEADER)
    comments = [c.take(c.number("<I")) for _ in range(count)]
    rest = c.take(c.left)
    return {"vendor": vendor, "comments": comments, "suffix": rest if rest and rest[0] & 1 else b""}


def write_tags(vendor: bytes, comments: list[bytes], pad: int = 0) -> bytes:
    """The comment header, with zeros up to one byte below a multiple of 255 if at least ``pad`` bytes are asked for."""
    out = b"OpusTags" + b"".join(struct.pack("<I", len(x)) + x if i != 1 else struct.pack("<I", len(comments)) for i, x in enumerate([vendor, b"", *comments]))
    return out + bytes(-(len(out) + pad + 1) % 255 + pad) if pad else out


JPEG, PNG, GIF = b"\xff\xd8\xff", b"\x89PNG\r\n\x1a\n", (b"GIF87a", b"GIF89a")


def picture_format(data: bytes) -> str:
    return "jpeg" if data.startswith(JPEG) else "png" if data.startswith(PNG) else "gif" if data.startswith(GIF) else "unknown"


def _jpeg_size(data: bytes) -> tuple[int, int, int, int] | None:
    for m in re.finditer(rb"\xff+([\xc0-\xfe])", data[2:]):  # start-of-frame segments but DHT, JPG and DAC
        at = m.end() + 2
        if m[1][0] in (0xD8, 0xD9, 0xDA):
            return None
        if m[1][0] < 0xD0 and (m[1][0] == 0xC0 or m[1][0] & 3) and len(data) >= at + 8:
            _, bits, height, width, parts = struct.unpack(">HBHHB", data[at : at + 8])
            return width, height, bits * parts, 0
    return None


def _png_size(data: bytes) -> tuple[int, int, int, int] | None:
    c, found = Cursor(data, 8), None
    try:
        while c.left >= 12:
            n, kind = c.number(">I"), c.take(4)
            body = c.take(n)
            c.take(4)
            if kind == b"IHDR" and n == 13:
                width, height, bits, colour = struct.unpack(">IIBB", body[:10])
                depth = 24 if colour == 3 else bits * {0: 1, 2: 3, 4: 2, 6: 4}.get(colour, 0)
                found = (width, height, depth, 0)
                if colour != 3:
                    break
            elif kind == b"PLTE" and found:
                found = (*found[:3], n // 3)
                break
    except BadBytes:
        pass
    return found if found and all(found[:3]) else None


def picture_size(data: bytes) -> tuple[int, int, int, int] | None:
    """(width, height, depth, colours) from an image's own header."""
    kind = picture_format(data)
    if kind == "gif" and len(data) >= 14:
        width, height, flags = struct.unpack("<HHB", data[6:11])
        return width, height, 24, 2 << (flags & 7)
    return {"jpeg": _jpeg_size, "png": _png_size}.get(kind, lambda _: None)(data)


def parse_picture(tag: bytes) -> dict:
    """A picture comment: base64 of a block of big-endian lengths and texts; the key is optional."""
    if tag[:23].upper() == b"METADATA_BLOCK_PICTURE=":
        tag = tag[23:]
    if len(tag) % 4 or not re.fullmatch(rb"[A-Za-z0-9+/]*={0,2}", tag):
        raise BadBytes(NOT_FORMAT)
    c = Cursor(base64.b64decode(tag), code=NOT_FORMAT)
    if c.left < 32:
        raise BadBytes(NOT_FORMAT)
    kind = c.number(">I")
    mime = c.take(c.number(">I"))
    text = c.take(c.number(">I"))
    given = struct.unpack(">4I", c.take(16))
    data = c.take(c.number(">I"))
    if any(given) and not all(given[:3]):
        raise BadBytes(NOT_FORMAT)
    link = mime == b"-->"
    named = {b"image/jpeg": "jpeg", b"image/png": "png", b"image/gif": "gif"}.get(mime)
    form = picture_format(data) if named or mime in (b"", b"image/") else "unknown"
    form = "url" if link else form if named in (None, form) else "unknown"
    size = (None if form in ("url", "unknown") else picture_size(data)) or given
    icon = size[:2] == (32, 32)
    if kind == 1 and not ((link and (icon or not any(size[:2]))) or (form == "png" and icon)):
        raise BadBytes(NOT_FORMAT)
    return {"type": kind, "mime": mime, "description": text, "width": size[0], "height": size[1], "depth": size[2], "colours": size[3], "format": form, "data": data}


def build_picture(kind: int, mime: bytes, description: bytes, data: bytes) -> bytes:
    size = picture_size(data) or (0, 0, 0, 0)
    part = lambda x: struct.pack(">I", len(x)) + x
    return b"METADATA_BLOCK_PICTURE=" + base64.b64encode(struct.pack(">I", kind) + part(mime) + part(description) + struct.pack(">4I", *size) + part(data))


POLYNOMIAL = 0x04C11DB7


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        r = i << 24
        for _ in range(8):
            r = (r << 1 ^ (POLYNOMIAL if r >> 31 else 0)) & 0xFFFFFFFF
        out.append(r)
    return out


CRC = _crc_table()
#: Each byte with its bits the other way round.
MIRRORED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def page_crc(data: bytes) -> int:
    """The container's checksum: this polynomial without reflection, from 0, without a final change. That of zlib is the
    same with all bits the other way round."""
    r = zlib.crc32(data.translate(MIRRORED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(r.to_bytes(4, "little").translate(MIRRORED), "big")


def _udf(schema: str, parse: Callable):
    def run(values: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = [c.split(" ")[0] for c in schema.split(", ")]
        for batch in values:
            rows = []
            for v in batch:
                try:
                    rows.append(({}, 0) if v is None else (parse(bytes(v)), 0))
                except BadBytes as e:
                    rows.append(({}, e.code))
            yield pd.DataFrame({n: [code if n == "error_code" else row.get(n) for row, code in rows] for n in names}, dtype=object)

    return F.pandas_udf(run, "struct<" + ", ".join(f"{n}: {t}" for n, t in (c.split(" ", 1) for c in schema.split(", "))) + ">")


def _packet_row(data: bytes) -> dict:
    p = parse_packet(data)
    return {"toc": p.toc, "sizes": [len(f) for f in p.frames], "frames": p.frames, "payload_offset": p.offset, "packet_offset": p.used, "padding": p.padding}


def packet_udf():
    return _udf("toc int, sizes array<int>, frames array<binary>, payload_offset int, packet_offset int, padding binary, error_code int", _packet_row)


def head_udf():
    return _udf("version int, channels int, pre_skip int, rate bigint, gain int, family int, streams int, coupled int, mapping array<int>, error_code int", parse_head)


def redundancy_udf():
    return _udf("payload binary, frame_offset int, error_code int", redundancy)


class ExtensionRows:
    """The table function of ``extension_table``."""

    def eval(self, padding: bytes, frames: int) -> Iterator[tuple]:
        place = 0
        try:
            for place, e in enumerate(extensions(bytes(padding or b""), int(frames or 0)), 1):
                yield place - 1, e.id, e.frame, e.data, 0
        except BadBytes as e:
            yield place, None, None, None, e.code


def extension_table(spark) -> None:
    """Registers ``packet_extensions(padding, frames)`` for SQL: a row (place, id, frame, data, error_code) for each extension in coded order, to
    be joined by LATERAL; a last row with a code tells where they break off."""
    ship(spark)
    spark.udtf.register("packet_extensions", F.udtf(ExtensionRows, returnType="place int, id int, frame int, data binary, error_code int"))


def tags_udf():
    return _udf("vendor binary, comments array<binary>, suffix binary, error_code int", parse_tags)


def picture_udf():
    return _udf("type bigint, mime binary, description binary, width bigint, height bigint, depth bigint, colours bigint, format string, data binary, error_code int", parse_picture)


def crc_column(payload):
    """The checksum of binary values as bigint, by built-in functions alone."""
    codes = F.transform(F.regexp_extract_all(F.hex(payload), F.lit("(..)"), F.lit(1)), lambda x: F.conv(x, 16, 10).cast("bigint"))
    table = F.array(*[F.lit(v).cast("bigint") for v in CRC])
    step = lambda r, b: F.shiftleft(r, 8).bitwiseAND(0xFFFFFFFF).bitwiseXOR(F.element_at(table, (F.shiftright(r, 24).bitwiseXOR(b) + 1).cast("int")))
    return F.when(F.octet_length(payload) == 0, F.lit(0).cast("bigint")).otherwise(F.aggregate(codes, F.lit(0).cast("bigint"), step))


def extensions_udf():
    """Extensions of (padding, frames) as an array; those before an error are kept, and the last struct tells its code."""

    def run(padding: pd.Series, frames: pd.Series) -> pd.Series:
        out = []
        for p, n in zip(padding, frames, strict=True):
            rows = []
            try:
                for e in extensions(bytes(p or b""), int(n or 0)):
                    rows.append({"id": e.id, "frame": e.frame, "data": e.data, "error_code": 0})
            except BadBytes as e:
                rows.append({"id": None, "frame": None, "data": None, "error_code": e.code})
            out.append(rows)
        return pd.Series(out)

    run.__annotations__ = {"padding": pd.Series, "frames": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "array<struct<id: int, frame: int, data: binary, error_code: int>>")
