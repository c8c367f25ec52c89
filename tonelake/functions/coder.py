"""The codec's range coder and pulse vector code (RFC 6716, sections 4.1, 5.1 and 4.3.4.2).

Both work within one frame; ``final_range`` is the coder's check value: encoder and decoder agree on
it if they agree on every symbol.
"""

from __future__ import annotations

from functools import lru_cache

TOP, BOTTOM, SYMBOL_BITS, CODE_BITS, EXTRA = 1 << 31, 1 << 23, 8, 32, 7
MASK = (1 << 32) - 1


def ilog(x: int) -> int:
    return x.bit_length()


class RangeDecoder:
    """Symbols from the front of a frame, raw bits from its end; zeros stand behind the data."""

    def __init__(self, data: bytes):
        self.data, self.at, self.back = data, 0, len(data)
        self.raw = self.raw_bits = 0
        self.range, self.total = 128, CODE_BITS + 1 - (CODE_BITS - EXTRA) // SYMBOL_BITS * SYMBOL_BITS
        self.rest = self._byte()
        self.value = 127 - (self.rest >> 1)
        self._fill()

    def _byte(self) -> int:
        self.at += 1
        return self.data[self.at - 1] if self.at <= len(self.data) else 0

    def _fill(self) -> None:
        while self.range <= BOTTOM:
            self.total += SYMBOL_BITS
            self.range <<= SYMBOL_BITS
            last, self.rest = self.rest, self._byte()
            # the lowest bit of one byte and the upper seven of the next
            new = (last << SYMBOL_BITS | self.rest) >> 1 & 255
            self.value = (self.value << SYMBOL_BITS) + (255 & ~new) & (TOP - 1)

    def peek(self, total: int) -> int:
        """Where in ``total`` the next symbol lies."""
        self.part = self.range // total
        return total - min(self.value // self.part + 1, total)

    def take(self, low: int, high: int, total: int) -> None:
        """Consume the symbol that has [low, high) of ``total``."""
        above = self.part * (total - high)
        self.value -= above
        self.range = self.part * (high - low) if low > 0 else self.range - above
        self._fill()

    def symbol(self, cumulative: list[int]) -> int:
        """A symbol by its cumulative counts, the first of which is 0."""
        at = self.peek(cumulative[-1])
        k = next(i for i, c in enumerate(cumulative[1:]) if at < c)
        self.take(cumulative[k], cumulative[k + 1], cumulative[-1])
        return k

    def bit(self, log: int) -> int:
        """A bit that is 1 once in 2**log."""
        part = self.range >> log
        one = self.value < part
        if not one:
            self.value -= part
        self.range = part if one else self.range - part
        self._fill()
        return int(one)

    def bits(self, n: int) -> int:
        """Raw bits from the frame's end."""
        while self.raw_bits < n:
            self.back -= 1
            self.raw |= (self.data[self.back] if self.back >= 0 else 0) << self.raw_bits
            self.raw_bits += 8
        out = self.raw & ((1 << n) - 1)
        self.raw >>= n
        self.raw_bits -= n
        self.total += n
        return out

    def uint(self, total: int) -> int:
        """A number below ``total``, its upper eight bits coded and the others raw."""
        extra = max(0, ilog(total - 1) - 8)
        top = (total - 1 >> extra) + 1
        k = self.peek(top)
        self.take(k, k + 1, top)
        return min(k << extra | self.bits(extra), total - 1) if extra else k

    def used(self) -> int:
        """Whole bits used so far, rounded up."""
        return self.total - ilog(self.range)

    @property
    def final_range(self) -> int:
        return self.range


class RangeEncoder:
    """The counterpart; ``finish`` gives a frame of the asked size."""

    def __init__(self) -> None:
        self.front, self.tail = bytearray(), bytearray()
        self.range, self.value, self.held, self.run, self.total = TOP, 0, -1, 0, CODE_BITS + 1
        self.raw = self.raw_bits = 0

    def _out(self, c: int) -> None:
        # a byte of ones waits, as a carry may still pass through it
        if c == 255:
            self.run += 1
            return
        carry = c >> SYMBOL_BITS
        if self.held >= 0:
            self.front.append(self.held + carry)
        self.front += bytes([(255 + carry) & 255]) * self.run
        self.run, self.held = 0, c & 255

    def _spill(self) -> None:
        while self.range <= BOTTOM:
            self._out(self.value >> CODE_BITS - SYMBOL_BITS - 1)
            self.value = self.value << SYMBOL_BITS & (TOP - 1)
            self.range <<= SYMBOL_BITS
            self.total += SYMBOL_BITS

    def put(self, low: int, high: int, total: int) -> None:
        part = self.range // total
        if low > 0:
            self.value += self.range - part * (total - low)
            self.range = part * (high - low)
        else:
            self.range -= part * (total - high)
        self._spill()

    def symbol(self, k: int, cumulative: list[int]) -> None:
        self.put(cumulative[k], cumulative[k + 1], cumulative[-1])

    def bit(self, value: int, log: int) -> None:
        part = self.range >> log
        if value:
            self.value += self.range - part
        self.range = part if value else self.range - part
        self._spill()

    def bits(self, value: int, n: int) -> None:
        self.raw |= value << self.raw_bits
        self.raw_bits += n
        self.total += n
        while self.raw_bits >= 8:
            self.tail.append(self.raw & 255)
            self.raw >>= 8
            self.raw_bits -= 8

    def uint(self, value: int, total: int) -> None:
        extra = max(0, ilog(total - 1) - 8)
        self.put(value >> extra, (value >> extra) + 1, (total - 1 >> extra) + 1)
        if extra:
            self.bits(value & (1 << extra) - 1, extra)

    def used(self) -> int:
        return self.total - ilog(self.range)

    def finish(self, size: int) -> bytes:
        """The frame: the front, zeros, and the raw bits from the end. Raises ValueError if it does not fit."""
        range_, final = self.range, self.range
        # as few bits as put the decoder inside the last range whatever follows
        left = CODE_BITS - ilog(self.range)
        mask = TOP - 1 >> left
        end = self.value + mask & ~mask
        if end | mask >= self.value + self.range:
            left += 1
            mask >>= 1
            end = self.value + mask & ~mask
        while left > 0:
            self._out(end >> CODE_BITS - SYMBOL_BITS - 1)
            end = end << SYMBOL_BITS & (TOP - 1)
            left -= SYMBOL_BITS
        if self.held >= 0 or self.run:
            self._out(0)
        front, spare = bytes(self.front), -left
        tail = bytes(self.tail)
        if len(front) + len(tail) + (self.raw_bits > max(spare, 0)) > size:
            raise ValueError("the frame does not fit")
        out = bytearray(front + bytes(size - len(front) - len(tail)) + tail[::-1])
        if self.raw_bits:
            out[size - len(tail) - 1] |= self.raw & 255
        self.range, self.final_range = range_, final
        return bytes(out)


@lru_cache(maxsize=None)
def pulses(n: int, k: int) -> int:
    """Vectors of ``n`` whole numbers whose magnitudes sum to ``k``."""
    if k == 0:
        return 1
    if n == 0:
        return 0
    return pulses(n - 1, k) + pulses(n, k - 1) + pulses(n - 1, k - 1)


def vector_index(y: list[int]) -> int:
    """The place of a pulse vector among all of its size and sum."""
    index, k = 0, sum(map(abs, y))
    for i, v in enumerate(y):
        n = len(y) - i
        if k == 0:
            break
        # first the vectors with 0 here, then for each magnitude the positive and the negative ones
        if v:
            index += pulses(n - 1, k) + sum(2 * pulses(n - 1, k - m) for m in range(1, abs(v))) + (pulses(n - 1, k - abs(v)) if v < 0 else 0)
        k -= abs(v)
    return index


def vector_at(index: int, n: int, k: int) -> list[int]:
    """The inverse of ``vector_index``."""
    out = []
    for left in range(n - 1, -1, -1):
        m = 0
        while index >= (count := pulses(left, k - m) * (2 if m else 1)):
            index -= count
            m += 1
        part = pulses(left, k - m)
        out.append(-m if m and index >= part else m)
        index -= part if m and index >= part else 0
        k -= m
    return out


def search(x: list[float], k: int) -> list[int]:
    """The pulse vector of ``k`` pulses nearest to a direction, one pulse at a time where it gains most."""
    y, xy, yy = [0] * len(x), 0.0, 0.0
    for _ in range(k):
        best = max(range(len(x)), key=lambda i: ((xy + abs(x[i])) ** 2 / (yy + 2 * y[i] + 1), -i))
        xy, yy = xy + abs(x[best]), yy + 2 * y[best] + 1
        y[best] += 1
    return [v if s >= 0 else -v for v, s in zip(y, x, strict=True)]
