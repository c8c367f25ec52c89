"""Inspectors of a coded packet's first bytes, as Column expressions (RFC 6716, section 3).

All take the first byte as an int (0 to 255) or the payload as binary and are null where the payload is
null or too short. Errors are given as codes: -1 bad argument, -4 invalid packet.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MODES = ("SILK", "HYBRID", "CELT")
BAD_ARGUMENT, INVALID_PACKET = -1, -4
MAX_FRAMES, MAX_FRAME_BYTES = 48, 1275


def byte_at(payload: Column, i: int | Column) -> Column:
    """The byte at offset ``i`` from 0 as int, or null behind the end."""
    at = F.lit(i) if isinstance(i, int) else i
    return F.when(F.octet_length(payload) > at, F.conv(F.hex(F.substring(payload, at + 1, F.lit(1))), 16, 10).cast("int"))


def mode(toc: Column) -> Column:
    return F.when(toc.bitwiseAND(128) != 0, "CELT").when(toc.bitwiseAND(96) == 96, "HYBRID").when(toc.isNotNull(), "SILK")


def bandwidth(toc: Column) -> Column:
    """NB, MB, WB, SWB or FB."""
    which = F.shiftright(toc, 5).bitwiseAND(3)
    celt = F.element_at(F.array(*map(F.lit, ("NB", "WB", "SWB", "FB"))), which + 1)
    hybrid = F.when(toc.bitwiseAND(16) != 0, "FB").otherwise("SWB")
    silk = F.element_at(F.array(*map(F.lit, ("NB", "MB", "WB"))), F.least(which, F.lit(2)) + 1)
    return F.when(toc.bitwiseAND(128) != 0, celt).when(toc.bitwiseAND(96) == 96, hybrid).otherwise(silk)


def bandwidth_id(toc: Column) -> Column:
    """The codec's number of the bandwidth, 1101 to 1105."""
    return F.array_position(F.array(*map(F.lit, ("NB", "MB", "WB", "SWB", "FB"))), bandwidth(toc)).cast("int") + 1100


def bandwidth_hz(toc: Column) -> Column:
    """Audio bandwidth in Hz."""
    return F.element_at(F.array(*map(F.lit, (4000, 6000, 8000, 12000, 20000))), bandwidth_id(toc) - 1100)


def bandwidth_rate(toc: Column) -> Column:
    """Effective sample rate of the bandwidth."""
    return F.element_at(F.array(*map(F.lit, (8000, 12000, 16000, 24000, 48000))), bandwidth_id(toc) - 1100)


def channels(toc: Column) -> Column:
    return F.when(toc.bitwiseAND(4) != 0, 2).when(toc.isNotNull(), 1)


def samples_per_frame(toc: Column, rate: int | Column = 48000) -> Column:
    """Samples of one frame at the given rate, in integer arithmetic."""
    fs = F.lit(rate) if isinstance(rate, int) else rate
    code = F.shiftright(toc, 3).bitwiseAND(3)
    div = lambda a, n: F.floor(a / F.lit(n)).cast("int")
    celt = div(fs * F.pow(F.lit(2), code).cast("int"), 400)
    hybrid = F.when(toc.bitwiseAND(8) != 0, div(fs, 50)).otherwise(div(fs, 100))
    silk = F.when(code == 3, div(fs * 60, 1000)).otherwise(div(fs * F.pow(F.lit(2), code).cast("int"), 100))
    return F.when(toc.bitwiseAND(128) != 0, celt).when(toc.bitwiseAND(96) == 96, hybrid).otherwise(silk)


def frame_count(payload: Column) -> Column:
    """Frames of a packet by its first two bytes, without a range check; null if a second byte is missing."""
    code = byte_at(payload, 0).bitwiseAND(3)
    return F.when(code == 0, 1).when(code < 3, 2).when(code == 3, byte_at(payload, 1).bitwiseAND(63))


def total_samples(payload: Column, rate: int | Column = 48000) -> Column:
    """struct(value, error_code): samples of a packet; -4 beyond 120 ms or without a count byte, -1 without bytes."""
    return samples_of(byte_at(payload, 0), frame_count(payload), rate)


def samples_of(first: Column, frames: Column, rate: int | Column = 48000) -> Column:
    """The same from a packet's first byte and its count of frames, which queries over several rates read once."""
    fs = F.lit(rate) if isinstance(rate, int) else rate
    n = frames * samples_per_frame(first, rate)
    error = F.when(first.isNull(), BAD_ARGUMENT).when(n.isNull() | (n * 25 > fs * 3), INVALID_PACKET).otherwise(0)
    return F.struct(F.when(error == 0, n).alias("value"), error.alias("error_code"))


def is_vbr(payload: Column) -> Column:
    """Whether a packet of code 3 codes its frames' sizes."""
    return F.when(byte_at(payload, 0).bitwiseAND(3) == 3, byte_at(payload, 1).bitwiseAND(128) != 0)


def is_padded(payload: Column) -> Column:
    return F.when(byte_at(payload, 0).bitwiseAND(3) == 3, byte_at(payload, 1).bitwiseAND(64) != 0)


def length_field(payload: Column, at: int) -> Column:
    """struct(bytes, size) of the length field at an offset: one byte below 252, else two. Nulls behind the end."""
    a, b = byte_at(payload, at), byte_at(payload, at + 1)
    return F.struct(F.when(a < 252, 1).when(b.isNotNull(), 2).alias("bytes"), F.when(a < 252, a).otherwise(4 * b + a).alias("size"))


def write_length(size: Column) -> Column:
    """The bytes of a length field for 0 to 1275, as hex text."""
    low = F.lit(252) + size.bitwiseAND(3)
    two = F.concat(F.lpad(F.hex(low), 2, "0"), F.lpad(F.hex(F.shiftright(size - low, 2)), 2, "0"))
    return F.when(size < 252, F.lpad(F.hex(size), 2, "0")).otherwise(two)


def silk_flags(first: Column, frames: Column) -> Column:
    """struct(vad0, vad1, vad2, fec) from the first byte of a SILK payload of 1 to 3 frames."""
    bit = lambda i: (F.shiftright(first, 7 - i).bitwiseAND(1) == 1) if isinstance(i, int) else None
    vad = [F.when(frames > i, bit(i)).otherwise(False).alias(f"vad{i}") for i in range(3)]
    fec = F.when(frames == 1, bit(1)).when(frames == 2, bit(2)).otherwise(bit(3))
    return F.struct(*vad, fec.alias("fec"))


def make_toc(mode_: Column, frame_rate: Column, bandwidth_id_: Column, channels_: Column) -> Column:
    """The first byte for a mode, frames a second, bandwidth (1101 to 1105) and channels."""
    # halvings of 400 Hz down to the frame rate
    period = F.greatest(F.ceil(F.log2(F.lit(400.0) / frame_rate)), F.lit(0)).cast("int")
    clamp = lambda x: F.least(F.greatest(x, F.lit(0)), F.lit(3))
    silk = clamp(bandwidth_id_ - 1101) * 32 + clamp(period - 2) * 8
    celt = F.lit(128) + F.greatest(bandwidth_id_ - 1102, F.lit(0)) * 32 + clamp(period) * 8
    hybrid = F.lit(96) + F.when(bandwidth_id_ == 1105, 16).otherwise(0) + clamp(period - 2) * 8
    return F.when(mode_ == "SILK", silk).when(mode_ == "CELT", celt).otherwise(hybrid) + F.when(channels_ == 2, 4).otherwise(0)


def frame_size(size: Column, duration: Column, rate: Column) -> Column:
    """The frame size for a duration code (5000: as given; 5001 to 5009: 2.5 to 120 ms), or null if it is
    longer than the input or no allowed duration."""
    div = lambda a, n: F.floor(a / F.lit(n)).cast("int")
    short = div(rate, 400) * F.pow(F.lit(2), duration - 5001).cast("int")
    long = div((duration - 5003) * rate, 50)
    new = F.when(duration == 5000, size).when(duration.between(5001, 5005), short).when(duration.between(5006, 5009), long)
    valid = (new * 400 == rate) | (new * 200 == rate) | (new * 100 == rate) | (new * 50 == rate) | (new * 25 == rate)
    for k in (3, 4, 5, 6):
        valid = valid | (new * 50 == rate * k)
    return F.when((size >= div(rate, 400)) & (new <= size) & valid, new)


def metadata(payload: Column) -> Column:
    """struct(mode, bandwidth_id, frame_samples at 48 kHz, channels, frames) of a packet."""
    first = byte_at(payload, 0)
    return F.struct(
        mode(first).alias("mode"), bandwidth_id(first).alias("bandwidth_id"), samples_per_frame(first).cast("int").alias("frame_samples"), channels(first).alias("channels"), frame_count(payload).alias("frames")
    )
