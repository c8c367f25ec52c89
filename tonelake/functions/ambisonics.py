"""Ambisonic mixing matrices, the layouts that use them, and layouts of every mapping family."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tonelake.functions import layouts

MOST_CHANNELS, MOST_BYTES, HEADER_BYTES = 255, 65004, 16

# Square Q15 matrices in column order of the first and second order, each with two channels
# beside the sphere, and the gain of the second in 1/256 dB.
MIXING = {
    1: [
        16384, 0, -16384, 23170, 0, 0, 16384, 23170,
        16384, 0, 0, 0, 16384, 0, -16384, -23170,
        0, 0, 16384, -23170, 16384, 0, 0, 0,
        0, 0, 0, 0, 32767, 0, 0, 0,
        0, 0, 0, 32767,
    ],
    2: [
        10923, 7723, 13377, -13377, 11585, 9459, 7723, -16384,
        -6689, 0, 0, 10923, 7723, 13377, 13377, -11585,
        9459, 7723, 16384, -6689, 0, 0, 10923, -15447,
        13377, 0, 0, -18919, 7723, 0, 13377, 0,
        0, 10923, 7723, -13377, -13377, 11585, -9459, 7723,
        16384, -6689, 0, 0, 10923, -7723, 0, 13377,
        -16384, 0, -15447, 0, 9459, 0, 0, 10923,
        -7723, 0, -13377, 16384, 0, -15447, 0, 9459,
        0, 0, 10923, 15447, 0, 0, 0, 0,
        -15447, 0, -18919, 0, 0, 10923, 7723, -13377,
        13377, -11585, -9459, 7723, -16384, -6689, 0, 0,
        10923, -15447, -13377, 0, 0, 18919, 7723, 0,
        13377, 0, 0, 0, 0, 0, 0, 0,
        0, 0, 0, 0, 32767, 0, 0, 0,
        0, 0, 0, 0, 0, 0, 0, 0,
        32767,
    ],
}
DEMIXING = {
    1: [
        16384, 16384, 16384, 16384, 0, 0, 0, 23170,
        0, -23170, 0, 0, -16384, 16384, -16384, 16384,
        0, 0, 23170, 0, -23170, 0, 0, 0,
        0, 0, 0, 0, 32767, 0, 0, 0,
        0, 0, 0, 32767,
    ],
    2: [
        2771, 2771, 2771, 2771, 2771, 2771, 2771, 2771,
        2771, 0, 0, 10033, 10033, -20066, 10033, 14189,
        14189, -28378, 10033, -20066, 0, 0, 3393, 3393,
        3393, -3393, 0, 0, 0, -3393, -3393, 0,
        0, -17378, 17378, 0, -17378, -24576, 24576, 0,
        17378, 0, 0, 0, -14189, 14189, 0, -14189,
        -28378, 28378, 0, 14189, 0, 0, 0, 2399,
        2399, -4799, -2399, 0, 0, 0, -2399, 4799,
        0, 0, 1959, 1959, 1959, 1959, -3918, -3918,
        -3918, 1959, 1959, 0, 0, -4156, 4156, 0,
        4156, 0, 0, 0, -4156, 0, 0, 0,
        8192, 8192, -16384, 8192, 16384, 16384, -32768, 8192,
        -16384, 0, 0, 0, 0, 0, 0, 0,
        0, 0, 0, 0, 8312, 0, 0, 0,
        0, 0, 0, 0, 0, 0, 0, 0,
        8312,
    ],
}
DEMIXING_GAIN = {1: 0, 2: 3050}


def matrix_bytes(rows: Column, cols: Column) -> Column:
    """Bytes of a matrix of 16-bit cells behind its header, both in steps of 8; null beyond 255 channels or 65,004 bytes."""
    cells = rows * cols * 2
    held = (rows <= MOST_CHANNELS) & (cols <= MOST_CHANNELS) & (cells <= MOST_BYTES)
    return F.when(held, (F.ceil(cells / 8) * 8 + HEADER_BYTES).cast("int"))


def projection_layout(channels: Column) -> Column:
    """struct(order, streams, coupled, matrix_bytes) of a projection of order 1 to 5, with or without two
    channels beside the sphere; null for other channel counts."""
    side = F.floor(F.sqrt(channels.cast("double"))).cast("int")
    whole = side * side + 2
    out = F.struct((side - 1).alias("order"), F.ceil(channels / 2).cast("int").alias("streams"), F.floor(channels / 2).cast("int").alias("coupled"), matrix_bytes(whole, whole).alias("matrix_bytes"))
    return F.when(side.between(2, 6) & (channels - side * side).isin(0, 2), out)


def exported(channels: int, order: int) -> list[int]:
    """The demixing cells that a projection header carries: of each stream channel, its weights in the outputs."""
    rows = (order + 1) ** 2 + 2
    return [DEMIXING[order][rows * c + r] for c in range(channels) for r in range(channels)]


def matrix_column(channels: int, order: int) -> Column:
    """The same cells as bytes, 16 bits each, the lower byte first."""
    return F.lit(b"".join((v & 0xFFFF).to_bytes(2, "little") for v in exported(channels, order)))


def layout_of(channels: Column, family: Column) -> Column:
    """struct(streams, coupled, mapping) of a mapping family: 0 (mono and stereo), 1 (surround), 2 (ambisonics,
    with the coupled channels last) and 255 (a stream for each channel); null where there is none."""
    n = channels.cast("int")
    made = lambda streams, coupled, mapping: F.struct(streams.cast("int").alias("streams"), coupled.cast("int").alias("coupled"), mapping.cast("array<int>").alias("mapping"))
    each = F.sequence(F.lit(0), n - 1)
    sphere = layouts.ambisonic(n)
    pairs = sphere["coupled"] * 2
    shifted = F.transform(each, lambda i: F.when(i < n - pairs, i + pairs).otherwise(i - (n - pairs)))
    single = F.when(n <= 2, made(F.lit(1), n - 1, each))
    out = F.when(family == 0, single).when(family == 1, layouts.surround_layout(n)).when((family == 2) & sphere.isNotNull(), made(sphere["streams"], sphere["coupled"], shifted))
    return F.when(n.between(1, 255), out.when(family == 255, made(n, F.lit(0), each)))
