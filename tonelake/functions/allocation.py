"""How a frame's bits and resolutions are chosen over its bands, as Column expressions.

Bits are counted in eighths. Bands are given by the edges of the shortest frame; ``lm`` is the logarithm of a frame's length
in these. What the bands share out is an array column with an element for each.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

EIGHTHS = 3
#: Steps between two curves, as a power of two.
STEPS = 6
# Changes of resolution by frame length, of steady frames and the two choices of transients.
STEADY = [(0, -1), (0, -1), (0, -2), (0, -2)]
TRANSIENT = [[(0, -1), (0, -1)], [(1, 0), (1, -1)], [(2, 0), (1, -1)], [(3, 0), (1, -1)]]


def _array(values: list[int]) -> Column:
    return F.array(*[F.lit(v).cast("bigint") for v in values])


def at(values: Column, i: Column) -> Column:
    return F.element_at(values, (i + 1).cast("int"))


def spent(bits: Column, thresholds: Column, caps: Column, floor: int) -> Column:
    """What each band takes of its share: all of it, up to its cap, from the last band that reaches its threshold downward;
    above that one only the floor, if the share holds it."""
    last = F.array_max(F.transform(bits, lambda x, i: F.when(x >= at(thresholds, i), i).otherwise(-1)))
    return F.transform(bits, lambda x, i: F.when(i <= last, F.least(x, at(caps, i))).when(x >= floor, floor).otherwise(0).cast("bigint"))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("bigint"), lambda a, x: a + x)


def _highest(fits, most: int) -> Column:
    """The greatest number of 0 to ``most`` that fits, by bisection; 0 is not asked."""
    halves = [1 << k for k in range(most.bit_length() - 1, -1, -1)]
    return F.aggregate(F.array(*map(F.lit, halves)), F.lit(0), lambda low, half: F.when((low + half <= most) & fits(F.least(low + half, F.lit(most))), low + half).otherwise(low))


def share_out(curves: list[list[int]], edges: list[int], caps: list[int], boosts: Column, trim: Column, total: Column, bandwidth: Column, *, channels: int = 1, lm: int = 3, previous: int = 0) -> Column:
    """struct(curve, step, coded, bits): eighths of a bit for each band's shape, that together take ``total`` at most.

    ``curves`` give 1/32 bits for each coefficient by quality, rising; the highest that fits is found by bisection, then the
    highest step towards the next one. From the top down bands are skipped whose bits don't pay, each skip or stay taking
    a bit, but never below the last band with a boost; what is left is spread by width. ``trim`` (5: neutral) tilts
    the curve, ``bandwidth`` is the last band with signal, ``previous`` the bands coded in the frame before. Stereo parameters
    are not reserved here. Null inputs give null.
    """
    n = len(edges) - 1
    width = [b - a for a, b in zip(edges, edges[1:], strict=False)]
    floor, shift = channels << EIGHTHS, lm + EIGHTHS
    need = [max(floor, (3 * w) << shift >> 4) for w in width]
    thresholds, limits, widths, places = _array(need), _array(caps), _array(width), _array(edges)
    table = F.array(*[_array([(channels * w * v) << lm >> 2 for w, v in zip(width, c, strict=True)]) for c in curves])
    top = len(curves) - 1

    def plus(a: Column, b: Column) -> Column:
        return F.zip_with(a, b, lambda x, y: x + y)

    def tilted(curve: Column, tilt: Column) -> Column:
        return F.zip_with(curve, tilt, lambda x, t: F.when(x > 0, F.greatest(x + t, F.lit(0))).otherwise(0))

    # what a row gives, computed once; each stage then names what it found for the next
    whole_total = F.greatest(total.cast("bigint"), F.lit(0))
    reserve = F.when(whole_total >= 1 << EIGHTHS, 1 << EIGHTHS).otherwise(0)
    slopes = _array([channels * w * (n - j - 1) << shift for j, w in enumerate(width)])
    ones = _array([floor if w << lm == 1 else 0 for w in width])
    given = F.struct(
        boosts.alias("boosts"), (whole_total - reserve).alias("total"), reserve.alias("reserve"), bandwidth.alias("bandwidth"),
        F.zip_with(F.transform(slopes, lambda x: F.shiftright(x * (trim - 5 - lm), 6)), ones, lambda x, y: x - y).alias("tilt"),
        F.array_max(F.transform(boosts, lambda x, j: F.when(x > 0, j).otherwise(0))).alias("boosted"),
    )

    def fits(g: Column, bits: Column) -> Column:
        return _let(bits, lambda b: _sum(spent(b, thresholds, limits, floor)) <= g["total"])

    def between(g: Column) -> Column:
        """The curve, and the bits of its bands with what the next one has more."""

        def of(curve: Column) -> Column:
            low = F.zip_with(tilted(at(table, curve), g["tilt"]), g["boosts"], lambda x, y: x + F.when(curve > 0, y).otherwise(0))
            high = plus(tilted(F.when(curve >= top, limits).otherwise(at(table, F.least(curve + 1, F.lit(top)))), g["tilt"]), g["boosts"])
            return _let(low, lambda x: F.struct(curve.alias("curve"), x.alias("low"), F.zip_with(high, x, lambda h, v: F.greatest(h - v, F.lit(0))).alias("span")))

        return _let(_highest(lambda i: fits(g, plus(tilted(at(table, i), g["tilt"]), g["boosts"])), top), of)

    def stepped(g: Column, s: Column) -> Column:
        share = lambda step: F.zip_with(s["low"], s["span"], lambda x, d: x + F.shiftright(d * step, STEPS))
        step = _highest(lambda k: fits(g, share(k)), (1 << STEPS) - 1)
        return _let(step, lambda k: _let(share(k), lambda b: F.struct(s["curve"].alias("curve"), k.alias("step"), spent(b, thresholds, limits, floor).alias("bits"))))

    def skipped(g: Column, s: Column) -> Column:
        start = F.struct(F.lit(n).alias("coded"), _sum(s["bits"]).alias("sum"), g["total"].alias("total"), F.lit(False).alias("done"), F.array().cast("array<bigint>").alias("top"))

        def band(acc: Column, j: Column) -> Column:
            left = acc["total"] - acc["sum"]
            span = at(places, j + 1) - edges[0]
            each = F.floor(F.greatest(left, F.lit(0)) / span)
            mine = at(s["bits"], j) + each * at(widths, j) + F.greatest(left - span * each - (at(places, j) - edges[0]), F.lit(0))
            return _let(mine, lambda m: decided(acc, j, m))

        def decided(acc: Column, j: Column, mine: Column) -> Column:
            depth = F.when(acc["coded"] > 17, F.when(j < previous, 7).otherwise(9)).otherwise(0)
            pays = (acc["coded"] <= 2) | ((mine > F.shiftright(F.shiftleft((depth * at(widths, j)).cast("bigint"), shift), 4)) & (j <= g["bandwidth"]))
            asked = mine >= F.greatest(at(thresholds, j), F.lit(floor + (1 << EIGHTHS)))
            last = j <= g["boosted"]
            flag = F.when(asked, 1 << EIGHTHS).otherwise(0)
            kept = F.when(mine - flag >= floor, floor).otherwise(0).cast("bigint")
            go_on = F.struct((acc["coded"] - 1).alias("coded"), (acc["sum"] + flag - at(s["bits"], j) + kept).alias("sum"), acc["total"].alias("total"), F.lit(False).alias("done"), F.concat(F.array(kept), acc["top"]).alias("top"))
            ends = F.struct(acc["coded"].alias("coded"), acc["sum"].alias("sum"), (acc["total"] + F.when(last, g["reserve"]).otherwise(0)).alias("total"), F.lit(True).alias("done"), acc["top"].alias("top"))
            return F.when(last | (asked & pays), ends).otherwise(go_on)

        return F.aggregate(F.array(*map(F.lit, range(n - 1, -1, -1))), start, lambda acc, j: F.when(acc["done"], acc).otherwise(band(acc, j)))

    def spread(s: Column, k: Column) -> Column:
        def more(left: Column) -> Column:
            span = F.greatest(at(places, k["coded"]) - edges[0], F.lit(1))
            each = F.floor(left / span)
            rest = left - span * each
            share = lambda x, j: x + each * at(widths, j) + F.greatest(F.least(at(widths, j), rest - (at(places, j) - edges[0])), F.lit(0))
            return F.struct(s["curve"].alias("curve"), s["step"].alias("step"), k["coded"].alias("coded"), F.concat(F.transform(F.slice(s["bits"], F.lit(1), k["coded"]), share), k["top"]).alias("bits"))

        return _let(F.greatest(k["total"] - k["sum"], F.lit(0)), more)

    found = _let(given, lambda g: _let(between(g), lambda b: _let(stepped(g, b), lambda s: _let(skipped(g, s), lambda k: spread(s, k)))))
    there = reduce(lambda a, b: a & b.isNotNull(), (trim, total, bandwidth), boosts.isNotNull())
    return F.when(there, found)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def best_path(metric: Column, importance: Column, targets: tuple[int, int], switch: Column, steady: bool) -> Column:
    """struct(cost, path): of all ways to give each band the first or second of two changes of resolution, the cheapest. A band costs its
    importance for each half step from its metric, a change from band to band costs ``switch``, and in steady frames so does
    beginning with the second. Of ways that cost the same the one goes whose last bands have the second."""
    cost = lambda i, k: at(importance, i).cast("bigint") * F.abs(at(metric, i) - 2 * targets[k])
    switch = switch.cast("bigint")
    zero = F.lit(0)
    start = F.struct(cost(zero, 0).alias("c0"), (cost(zero, 1) + (switch if steady else 0)).alias("c1"), F.array(F.lit(0)).alias("p0"), F.array(F.lit(1)).alias("p1"))

    def band(acc: Column, i: Column) -> Column:
        stay0, stay1 = acc["c0"] < acc["c1"] + switch, acc["c0"] + switch >= acc["c1"]
        return F.struct(
            (F.least(acc["c0"], acc["c1"] + switch) + cost(i, 0)).alias("c0"), (F.least(acc["c0"] + switch, acc["c1"]) + cost(i, 1)).alias("c1"),
            F.concat(F.when(stay0, acc["p0"]).otherwise(acc["p1"]), F.array(F.lit(0))).alias("p0"), F.concat(F.when(stay1, acc["p1"]).otherwise(acc["p0"]), F.array(F.lit(1))).alias("p1"),
        )

    rest = F.filter(F.sequence(zero, F.size(metric) - 1), lambda i: i > 0)
    end = lambda a: F.struct(F.least(a["c0"], a["c1"]).alias("cost"), F.when(a["c0"] < a["c1"], a["p0"]).otherwise(a["p1"]).alias("path"))
    return F.when(F.size(metric) > 0, F.aggregate(rest, start, band, end))


def time_frequency(metric: Column, importance: Column, switch: Column, lm: int, transient: bool) -> Column:
    """struct(select, path): the changes of resolution of a frame's bands. A transient may choose between two pairs of changes;
    the second must be cheaper."""
    if not transient:
        return _let(best_path(metric, importance, STEADY[lm], switch, True), lambda x: F.struct(F.lit(0).alias("select"), x["path"].alias("path")))
    both = F.struct(*[best_path(metric, importance, t, switch, False).alias(f"s{i}") for i, t in enumerate(TRANSIENT[lm])])
    return _let(both, lambda x: F.when(x["s1"]["cost"] < x["s0"]["cost"], F.struct(F.lit(1).alias("select"), x["s1"]["path"].alias("path"))).otherwise(F.struct(F.lit(0).alias("select"), x["s0"]["path"].alias("path"))))
