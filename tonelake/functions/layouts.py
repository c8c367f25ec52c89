"""Channel layouts of multichannel streams: checks, lookups and rate allocation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tonelake.functions.rules import div

MUTED = 255
# Streams, coupled streams and channel mapping of 1 to 8 channels (RFC 7845, family 1).
SURROUND = {
    1: (1, 0, [0]),
    2: (1, 1, [0, 1]),
    3: (2, 1, [0, 2, 1]),
    4: (2, 2, [0, 1, 2, 3]),
    5: (3, 2, [0, 4, 1, 2, 3]),
    6: (4, 2, [0, 4, 1, 2, 3, 5]),
    7: (4, 3, [0, 4, 1, 2, 3, 5, 6]),
    8: (5, 3, [0, 6, 1, 2, 3, 4, 5, 7]),
}


def is_valid(mapping: Column, streams: Column, coupled: Column) -> Column:
    """Whether every entry names a decoded channel or is muted, and the counts fit."""
    return (streams >= 1) & (coupled <= streams) & (streams + coupled <= 255) & F.forall(mapping, lambda m: (m < streams + coupled) | (m == MUTED))


def muted_channels(mapping: Column) -> Column:
    """Offsets of the muted channels."""
    return F.filter(F.transform(mapping, lambda m, i: F.when(m == MUTED, i)), lambda i: i.isNotNull())


def _first(mapping: Column, wanted: Column) -> Column:
    return F.array_position(mapping, wanted).cast("int") - 1


def left_channel(mapping: Column, stream: Column) -> Column:
    """The first output channel of a coupled stream's left side, or -1."""
    return _first(mapping, stream * 2)


def right_channel(mapping: Column, stream: Column) -> Column:
    return _first(mapping, stream * 2 + 1)


def mono_channel(mapping: Column, stream: Column, coupled: Column) -> Column:
    return _first(mapping, stream + coupled)


def ambisonic(channels: Column) -> Column:
    """struct(streams, coupled) if the channels are n*n or n*n + 2 and at most 227, else null."""
    acn = F.pow(F.floor(F.sqrt(channels.cast("double"))), F.lit(2)).cast("int")
    rest = channels - acn
    both = F.struct((acn + F.when(rest != 0, 1).otherwise(0)).alias("streams"), F.when(rest != 0, 1).otherwise(0).alias("coupled"))
    return F.when(channels.between(1, 227) & rest.isin(0, 2), both)


def surround_layout(channels: Column) -> Column:
    """struct(streams, coupled, mapping) of family 1, or null beyond 1 to 8 channels."""
    out = F.lit(None).cast("struct<streams: int, coupled: int, mapping: array<int>>")
    for n, (streams, coupled, mapping) in SURROUND.items():
        out = F.when(channels == n, F.struct(F.lit(streams).alias("streams"), F.lit(coupled).alias("coupled"), F.array(*map(F.lit, mapping)).alias("mapping"))).otherwise(out)
    return out


def surround_rates(rate: Column, streams: Column, coupled: Column, lfe: Column, frame_rate: Column) -> Column:
    """Bitrates of the streams, coupled ones first and the LFE stream (0 or 1) last, at least 500 each."""
    normal = streams + coupled - lfe
    uncoupled = streams - coupled - lfe
    offset = F.greatest(frame_rate, F.lit(50)) * 40
    lfe_offset = F.least(div(rate, 20), F.lit(3000)) + F.greatest(frame_rate, F.lit(50)) * 15
    stream_offset = F.greatest(F.least(div(div(rate - offset * normal - lfe_offset * lfe, normal), 2), F.lit(20000)), F.lit(0))
    total = uncoupled * 256 + coupled * 512 + lfe * 32
    each = div((rate - lfe_offset * lfe - stream_offset * (coupled + uncoupled) - offset * normal) * 256, total)
    zero = F.lit(0)

    def stream(i: Column) -> Column:
        pair = offset * 2 + F.greatest(stream_offset + F.shiftright(each * 512, 8), zero)
        low = F.greatest(lfe_offset + F.shiftright(each * 32, 8), zero)
        one = offset + F.greatest(stream_offset + each, zero)
        return F.greatest(F.when(i < coupled, pair).when((lfe == 1) & (i == streams - 1), low).otherwise(one), F.lit(500)).cast("bigint")

    return F.transform(F.sequence(F.lit(0), streams - 1), stream)


def ambisonic_rate(rate: Column, streams: Column) -> Column:
    """Every stream's even share, at least 500."""
    return F.greatest(div(rate, streams), F.lit(500))
