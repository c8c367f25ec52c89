"""Exact rules of the codec's rate and mode decisions, as Column expressions over integers.

Division truncates toward zero and shifts are arithmetic.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tables of the codec's specification.
SIGMOID_SLOPE_Q10 = [237, 153, 73, 30, 12, 7]
SIGMOID_UPPER_Q15 = [16384, 23955, 28861, 31213, 32178, 32548]
SIGMOID_LOWER_Q15 = [16384, 8812, 3906, 1554, 589, 219]
FEC_THRESHOLD = [12000, 14000, 16000, 20000, 22000]
FEC_HYSTERESIS = 1000
HYBRID_RATES = [
    [0, 0, 0, 0, 0],
    [12000, 10000, 10000, 11000, 11000],
    [16000, 13500, 13500, 15000, 15000],
    [20000, 16000, 16000, 18000, 18000],
    [24000, 18000, 18000, 21000, 21000],
    [32000, 22000, 22000, 28000, 28000],
    [64000, 38000, 38000, 50000, 50000],
]
SNR_NB = [
    0, 15, 39, 52, 61, 68, 74, 79, 84, 88, 92, 95, 99, 102, 105, 108, 111, 114, 117, 119, 122, 124, 126, 129, 131, 133, 135, 137, 139, 142, 143, 145, 147, 149, 151, 153,
    155, 157, 158, 160, 162, 163, 165, 167, 168, 170, 171, 173, 174, 176, 177, 179, 180, 182, 183, 185, 186, 187, 189, 190, 192, 193, 194, 196, 197, 199, 200, 201, 203,
    204, 205, 207, 208, 209, 211, 212, 213, 215, 216, 217, 219, 220, 221, 223, 224, 225, 227, 228, 230, 231, 232, 234, 235, 236, 238, 239, 241, 242, 243, 245, 246, 248,
    249, 250, 252, 253, 255,
]
SNR_MB = [
    0, 0, 28, 43, 52, 59, 65, 70, 74, 78, 81, 85, 87, 90, 93, 95, 98, 100, 102, 105, 107, 109, 111,
    113, 115, 116, 118, 120, 122, 123, 125, 127, 128, 130, 131, 133, 134, 136, 137, 138, 140, 141,
    143, 144, 145, 147, 148, 149, 151, 152, 153, 154, 156, 157, 158, 159, 160, 162, 163, 164, 165,
    166, 167, 168, 169, 171, 172, 173, 174, 175, 176, 177, 178, 179, 180, 181, 182, 183, 184, 185,
    186, 187, 188, 188, 189, 190, 191, 192, 193, 194, 195, 196, 197, 198, 199, 200, 201, 202, 203,
    203, 204, 205, 206, 207, 208, 209, 210, 211, 212, 213, 214, 214, 215, 216, 217, 218, 219, 220,
    221, 222, 223, 224, 224, 225, 226, 227, 228, 229, 230, 231, 232, 233, 234, 235, 236, 236, 237,
    238, 239, 240, 241, 242, 243, 244, 245, 246, 247, 248, 249, 250, 251, 252, 253, 254, 255,
]
SNR_WB = [
    0, 0, 0, 8, 29, 41, 49, 56, 62, 66, 70, 74, 77, 80, 83, 86, 88, 91, 93, 95, 97, 99, 101, 103,
    105, 107, 108, 110, 112, 113, 115, 116, 118, 119, 121, 122, 123, 125, 126, 127, 129, 130, 131,
    132, 134, 135, 136, 137, 138, 140, 141, 142, 143, 144, 145, 146, 147, 148, 149, 150, 151, 152,
    153, 154, 156, 157, 158, 159, 159, 160, 161, 162, 163, 164, 165, 166, 167, 168, 169, 170, 171,
    171, 172, 173, 174, 175, 176, 177, 177, 178, 179, 180, 181, 181, 182, 183, 184, 185, 185, 186,
    187, 188, 189, 189, 190, 191, 192, 192, 193, 194, 195, 195, 196, 197, 198, 198, 199, 200, 200,
    201, 202, 203, 203, 204, 205, 206, 206, 207, 208, 209, 209, 210, 211, 211, 212, 213, 214, 214,
    215, 216, 216, 217, 218, 219, 219, 220, 221, 221, 222, 223, 224, 224, 225, 226, 226, 227, 228,
    229, 229, 230, 231, 232, 232, 233, 234, 234, 235, 236, 237, 237, 238, 239, 240, 240, 241, 242,
    243, 243, 244, 245, 246, 246, 247, 248, 249, 249, 250, 251, 252, 253, 255,
]


def table(values: list[int], index: Column) -> Column:
    """An entry of a table, by an index from 0."""
    return F.element_at(F.array(*map(F.lit, values)), index.cast("int") + 1)


def div(a: Column, b: Column | int) -> Column:
    """Integer division toward zero, as bigint."""
    q = a.cast("bigint") / (F.lit(b) if isinstance(b, int) else b)
    return F.when(q < 0, F.ceil(q)).otherwise(F.floor(q)).cast("bigint")


def sigmoid_q15(x: Column) -> Column:
    """Sigmoid of a Q5 number as Q15, piecewise linear, saturated at 192."""
    a = F.abs(x)
    i, f = F.least(F.shiftright(a, 5), F.lit(5)), a.bitwiseAND(31)
    upper = F.when(a >= 192, 32767).otherwise(table(SIGMOID_UPPER_Q15, i) + table(SIGMOID_SLOPE_Q10, i) * f)
    lower = F.when(a >= 192, 0).otherwise(table(SIGMOID_LOWER_Q15, i) - table(SIGMOID_SLOPE_Q10, i) * f)
    return F.when(x < 0, lower).otherwise(upper)


def lin2log(x: Column) -> Column:
    """128 times the binary logarithm of a positive int, approximately; zero gives -128."""
    top = F.length(F.bin(x.cast("bigint"))) - 1  # the leading one's place
    up = F.floor(x / F.pow(F.lit(2), F.greatest(top - 7, F.lit(0)))).cast("bigint")
    scaled = F.when(top >= 7, up).otherwise(x.cast("bigint") * F.pow(F.lit(2), F.greatest(7 - top, F.lit(0))).cast("bigint"))
    f = scaled.bitwiseAND(127)
    return F.when(x == 0, -128).otherwise(top * 128 + f + F.shiftright(f * (128 - f) * 179, 16)).cast("int")


def log2lin(x: Column) -> Column:
    """The inverse: 2 to the power of x/128; below 0 it is 0, from 3967 on the largest int."""
    inside = F.least(F.greatest(x, F.lit(0)), F.lit(3966)).cast("bigint")
    whole, f = F.pow(F.lit(2), F.shiftright(inside, 7)).cast("bigint"), inside.bitwiseAND(127)
    c = f + F.shiftright(f * (128 - f) * -174, 16)
    out = F.when(x < 2048, whole + F.shiftright(whole * c, 7)).otherwise(whole + F.shiftright(whole, 7) * c)
    return F.when(x < 0, 0).when(x >= 3967, 2147483647).otherwise(out).cast("int")


def equivalent_rate(rate: Column, channels: Column, frame_rate: Column, vbr: Column, mode: Column, complexity: Column, loss: Column) -> Column:
    """The bitrate at which a 20 ms VBR stream of full complexity without loss would do as well."""
    r = rate.cast("bigint")
    r = r - F.when(frame_rate > 50, (40 * channels + 20) * (frame_rate - 50)).otherwise(0)
    r = r - F.when(vbr, 0).otherwise(div(r, 12))
    r = div(r * (90 + complexity), 100)
    low = F.when(complexity < 2, div(r * 4, 5)).otherwise(r)
    silk = low - div(low * loss, 6 * loss + 10)
    celt = F.when(complexity < 5, div(r * 9, 10)).otherwise(r)
    other = r - div(r * loss, 12 * loss + 20)
    return F.when(mode.isin("SILK", "HYBRID"), silk).when(mode == "CELT", celt).otherwise(other)


def fec_decision(enabled: Column, loss: Column, last: Column, mode: Column, bandwidth_id: Column, rate: Column) -> Column:
    """struct(fec, bandwidth_id): whether in-band FEC pays, and down to which bandwidth, tried from the
    given one downward while more than 5 percent are lost."""
    chosen = F.lit(None).cast("int")
    for step in range(4, -1, -1):  # the least reduction is tried first, so it is applied last
        b = bandwidth_id - step
        limit = table(FEC_THRESHOLD, F.greatest(b - 1101, F.lit(0))) + F.when(last, -FEC_HYSTERESIS).otherwise(FEC_HYSTERESIS)
        scaled = F.shiftright(limit.cast("bigint") * (125 - F.least(loss, F.lit(25))) * 655, 16)
        tried = (b >= 1101) & ((loss > 5) if step else F.lit(True))
        chosen = F.when(tried & (rate > scaled), b).otherwise(chosen)
    on = enabled & (loss != 0) & (mode != "CELT") & chosen.isNotNull()
    return F.struct(on.alias("fec"), F.when(on, chosen).otherwise(bandwidth_id).alias("bandwidth_id"))


def hybrid_silk_rate(rate: Column, bandwidth_id: Column, frame_20ms: Column, vbr: Column, fec: Column, channels: Column) -> Column:
    """The part of a hybrid stream's bitrate that goes to SILK, by linear interpolation in a table."""
    each = div(rate, channels)
    out = F.lit(None).cast("bigint")
    for long in (False, True):
        for coded in (False, True):
            col = 1 + long + 2 * coded
            last = HYBRID_RATES[-1]
            value = F.lit(last[col]) + div(each - last[0], 2)
            for lo, hi in reversed(list(zip(HYBRID_RATES, HYBRID_RATES[1:], strict=False))):
                value = F.when(each < hi[0], div(lo[col] * (hi[0] - each) + hi[col] * (each - lo[0]), hi[0] - lo[0])).otherwise(value)
            out = F.when((frame_20ms == long) & (fec == coded), value).otherwise(out)
    out = (out + F.when(vbr, 0).otherwise(100) + F.when(bandwidth_id == 1104, 300).otherwise(0)) * channels
    return out - F.when((channels == 2) & (each >= 12000), 1000).otherwise(0)


def redundancy_bytes(max_bytes: Column, rate: Column, frame_rate: Column, channels: Column) -> Column:
    """Bytes for a redundant frame at a mode switch; 0 if there is too little room."""
    base = 40 * channels + 20
    n = div(div(3 * (rate + base * (200 - frame_rate)), 2), 1600)
    room = div(max_bytes * 8 - 2 * base, 1) * 240
    cap = div(div(room, 240 + div(F.lit(48000), frame_rate)) + base, 8)
    n = F.least(n, cap)
    return F.when((frame_rate > 0) & (n > 4 + 8 * channels), F.least(n, F.lit(257))).otherwise(0).cast("bigint")


def target_snr(rate: Column, khz: Column, half: Column) -> Column:
    """Target signal-to-noise ratio (Q7 dB) of a SILK channel for its bitrate, by its sampling rate (8, 12, or wider);
    ``half`` marks 10 ms frames."""
    step = div(rate - F.when(half, 2000 + div(khz, 16)).otherwise(0) + 200, 400) - 10
    of = lambda t: table(t, F.greatest(F.least(step, F.lit(len(t) - 1)), F.lit(0))) * 21
    return F.when(step <= 0, 0).when(khz == 8, of(SNR_NB)).when(khz == 12, of(SNR_MB)).otherwise(of(SNR_WB)).cast("int")


def gain_linear(q8_db: Column) -> Column:
    """A gain in 1/256 dB as a factor."""
    return F.pow(F.lit(10.0), q8_db / F.lit(5120.0))


def rate_factor(rate: Column) -> Column:
    """How many times 48 kHz holds the rate; 0 for rates that the codec does not know."""
    return F.when(rate.isin(48000, 24000, 16000, 12000, 8000), div(F.lit(48000), rate)).otherwise(0).cast("int")


# Weights of the long-term predictor in Q14, and the signal-to-noise bounds in Q7 of the second and third.
LTP_SCALES_Q14 = [15565, 12288, 8192]
LTP_SNR_Q7 = (2900, 3900)


def ltp_scale_index(loss: Column, frames: Column, redundancy: Column, gain: Column, snr_q7: Column, independent: Column) -> Column:
    """How far the long-term predictor is weakened against loss: 0 to 2, above 0 only in frames coded by
    themselves. ``loss`` is in percent; redundancy about squares it."""
    lost = loss.cast("bigint") * frames
    lost = F.when(redundancy, F.floor(lost * lost / 100) + 2).otherwise(lost)
    weight = F.when(gain < 0, F.ceil(gain)).otherwise(F.floor(gain)).cast("bigint") * lost
    return F.when(independent, sum(((weight > log2lin(F.lit(bound) - snr_q7)).cast("int") for bound in LTP_SNR_Q7), F.lit(0))).otherwise(0)


def ltp_scale_q14(index: Column) -> Column:
    return table(LTP_SCALES_Q14, index)
