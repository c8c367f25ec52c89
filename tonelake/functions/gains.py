"""The scale of subframe gains and its coded differences (RFC 6716, section 4.2.7.4), as Column expressions.

A gain is coded as one of 64 levels. The first of a frame may be coded by itself, the others by one of
41 codes, each of which leads from the level before to the higher of two: one that counts from that
level, and one that counts double from the lowest on. The code for a level is the first that gets there
by either.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tonelake.functions.rules import lin2log, log2lin, table

# Levels, codes, the base-2 logarithm in Q7 of level 0, of a level's width in Q16 (decoder)
# and of its inverse in Q16 (encoder), and the most that a level coded by itself may fall when coded and when read.
LEVELS, CODES = 64, 41
BASE_Q7, WIDTH_Q16, INVERSE_Q16 = 2090, 0x1D1C71, 2251
CODED_FALL, READ_FALL = 4, 16


def gain_of(level: Column) -> Column:
    """The gain of a level in Q16."""
    return log2lin(table([(WIDTH_Q16 * i >> 16) + BASE_Q7 for i in range(LEVELS)], level))


def leads_to(level: Column, code: Column) -> Column:
    """The level that a code leads to."""
    return F.greatest(F.least(F.greatest(2 * code - 16, level + code - 4), F.lit(LEVELS - 1)), F.lit(0))


def code_for(level: Column, wanted: Column) -> Column:
    """The first code that leads to a level or beyond it, or the last."""
    first = F.least(wanted - level + 4, F.ceil((wanted + 16) / 2))
    return F.greatest(F.least(first, F.lit(CODES - 1)), F.lit(0)).cast("int")


def _walk(values: Column, previous: Column, conditional: bool, first, later) -> Column:
    """struct(codes, levels, level): from the level before to the next, value by value."""
    none = F.array().cast("array<int>")
    start = F.struct(none.alias("codes"), none.alias("levels"), previous.cast("int").alias("level"))

    def step(acc: Column, value: Column) -> Column:
        code, level = later(acc["level"], value)
        if not conditional:
            alone_code, alone = first(acc["level"], value)
            begins = F.size(acc["codes"]) == 0
            code, level = F.when(begins, alone_code).otherwise(code), F.when(begins, alone).otherwise(level)
        code, level = code.cast("int"), level.cast("int")
        return F.struct(F.concat(acc["codes"], F.array(code)).alias("codes"), F.concat(acc["levels"], F.array(level)).alias("levels"), level.alias("level"))

    return F.aggregate(values, start, step)


def quantise(gains: Column, previous: Column, conditional: bool = False) -> Column:
    """struct(codes, levels, level) for an array of gains in Q16: the codes, the levels they stand for
    and the last of them. ``conditional``: the first is coded by its difference too."""
    nearest = F.transform(gains, lambda g: F.shiftright((lin2log(g) - BASE_Q7) * INVERSE_Q16, 16))
    # a gain that falls is coded by the level above it
    wanted = lambda level, at: F.greatest(F.least(F.when(at < level, at + 1).otherwise(at), F.lit(LEVELS - 1)), F.lit(0))

    def first(level: Column, at: Column) -> tuple[Column, Column]:
        alone = F.greatest(wanted(level, at), level - CODED_FALL)
        return alone, alone

    def later(level: Column, at: Column) -> tuple[Column, Column]:
        code = code_for(level, wanted(level, at))
        return code, leads_to(level, code)

    return _walk(nearest, previous, conditional, first, later)


def dequantise(codes: Column, previous: Column, conditional: bool = False) -> Column:
    """struct(codes, levels, level) for an array of codes; the gains are ``gain_of`` the levels."""
    return _walk(codes, previous, conditional, lambda level, code: (code, F.greatest(code, level - READ_FALL)), lambda level, code: (code, leads_to(level, code)))
