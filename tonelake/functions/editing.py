"""Packet, extension and header editing as functions of Columns: each is one Arrow kernel over a batch.

Every function gives a struct with the bytes and an ``error_code``, 0 or that of the inspectors.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tonelake.functions import kernels
from tonelake.functions.kernels import BadBytes, Extension

BYTES = "struct<data: binary, error_code: int>"
BAD_ARGUMENT = -1


def _kernel(make: Callable[..., bytes], count: int):
    """A UDF of ``count`` columns that calls ``make`` row by row; a null argument is a bad one."""

    def one(*args: object) -> tuple[bytes | None, int]:
        if any(a is None for a in args):
            return None, BAD_ARGUMENT
        try:
            return make(*args), 0
        except BadBytes as e:
            return None, e.code

    def frame(*columns: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(*row) for row in zip(*columns, strict=True)], columns=["data", "error_code"], dtype=object)

    # the number of arguments must stand in the signature
    one_, two, three = (lambda a: frame(a)), (lambda a, b: frame(a, b)), (lambda a, b, c: frame(a, b, c))
    run = {1: one_, 2: two, 3: three}[count]
    run.__annotations__ = dict.fromkeys("abc"[:count], pd.Series) | {"return": pd.DataFrame}
    return F.pandas_udf(run, BYTES)


def frame_range(packets: Column, begin: Column, end: Column) -> Column:
    """One packet of the frames ``begin`` to ``end`` (without) of an array of packets, taken one behind the
    other. The packets must agree in all but the frame code and last 120 ms together at most. Extensions in their padding
    go with their frames."""

    def make(packets, begin, end) -> bytes:
        parsed = [kernels.parse_packet(bytes(p)) for p in packets]
        frames = [f for p in parsed for f in p.frames]
        if any((p.toc ^ parsed[0].toc) & 0xFC for p in parsed) or len(frames) * kernels.frame_samples(parsed[0].toc if parsed else 0) > kernels.MAX_SAMPLES:
            raise BadBytes(kernels.INVALID)
        if not 0 <= begin < end <= len(frames):
            raise BadBytes(BAD_ARGUMENT)
        first, carried = 0, []
        for p in parsed:
            carried += [Extension(e.id, e.frame + first - begin, e.data) for e in kernels.extensions(p.padding, len(p.frames)) if begin <= e.frame + first < end]
            first += len(p.frames)
        return kernels.build_packet(parsed[0].toc, frames[begin:end], carried=carried)

    return _kernel(make, 3)(packets, begin.cast("int"), end.cast("int"))


def pad(packet: Column, length: Column, streams: int = 1) -> Column:
    """A packet of ``streams`` streams padded to a length; a shorter length than it has is a bad argument. Extensions in
    the padding of the last stream's packet stay."""

    def make(data, length) -> bytes:
        data = bytes(data)
        if not data or length < len(data):
            raise BadBytes(BAD_ARGUMENT)
        if length == len(data):
            return data
        parts = kernels.split_streams(data, streams)
        carried = list(kernels.extensions(parts[-1].padding, len(parts[-1].frames)))
        return kernels.join_streams([kernels.build_packet(p.toc, p.frames) for p in parts], length, carried)

    return _kernel(make, 2)(packet, length.cast("int"))


def unpad(packet: Column, streams: int = 1) -> Column:
    """A packet of ``streams`` streams without padding, each in its shortest form."""
    return _kernel(lambda data: kernels.unpad_streams(bytes(data), streams), 1)(packet)


def extension_bytes(items: Column, frames: Column, length: Column) -> Column:
    """Padding bytes for an array of struct(id, frame, data), by frame, of ``length`` bytes at least."""
    make = lambda items, frames, length: kernels.write_extensions([Extension(int(x["id"]), int(x["frame"]), bytes(x["data"] or b"")) for x in items], int(frames), int(length))
    return _kernel(make, 3)(items, frames.cast("int"), length.cast("int"))


def extension_count(padding: Column, frames: Column) -> Column:
    """How many extensions come before the end or the first error."""

    def run(padding: pd.Series, frames: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or n is None else kernels.count_extensions(bytes(p), int(n)) for p, n in zip(padding, frames, strict=True)], dtype="Int32")

    run.__annotations__ = {"padding": pd.Series, "frames": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "int")(padding, frames.cast("int"))


def by_frame(extensions: Column) -> Column:
    """An array of extensions in the order of their frames, those of a frame as they were coded."""
    placed = F.transform(extensions, lambda e, i: F.struct(e["frame"].alias("frame"), i.alias("i"), e.alias("e")))
    return F.transform(F.array_sort(placed), lambda x: x["e"])


def comment_header(vendor: Column, comments: Column, padding: int = 0) -> Column:
    """A comment header, as bytes, by built-in functions alone."""
    little = lambda n: F.concat(*[F.substring(F.lpad(F.hex(n.cast("bigint")), 8, "0"), i, 2) for i in (7, 5, 3, 1)])
    field = lambda x: F.concat(little(F.octet_length(x)), F.hex(x))
    body = F.array_join(F.transform(comments, field), "")
    return F.unhex(F.concat(F.hex(F.lit(b"OpusTags")), field(vendor), little(F.size(comments)), body, F.lit("00" * padding)))


def identification_header(channels: Column, pre_skip: Column, rate: Column, gain: Column, family: Column | None = None, layout: Column | None = None, matrix: Column | None = None) -> Column:
    """An identification header, as bytes, by built-in functions alone: of mapping family 0, or of ``family`` with the
    struct(streams, coupled, mapping) of ``layout``; family 3 has the bytes of its demixing ``matrix`` in place of the mapping. Null
    where a family needs a layout and has none."""
    part = lambda n, size: F.concat(*[F.substring(F.lpad(F.hex(F.pmod(n.cast("bigint"), F.lit(1 << 8 * size))), 2 * size, "0"), i, 2) for i in range(2 * size - 1, 0, -2)])
    family = F.lit(0) if family is None else family
    head = F.concat(F.hex(F.lit(b"OpusHead")), F.lit("01"), part(channels, 1), part(pre_skip, 2), part(rate, 4), part(gain, 2), part(family, 1))
    if layout is None:
        return F.unhex(F.when(family == 0, head))
    mapping = F.array_join(F.transform(layout["mapping"], lambda m: part(m, 1)), "")
    last = mapping if matrix is None else F.when(family == 3, F.hex(matrix)).otherwise(mapping)
    return F.unhex(F.when(family == 0, head).otherwise(F.concat(head, part(layout["streams"], 1), part(layout["coupled"], 1), last)))
