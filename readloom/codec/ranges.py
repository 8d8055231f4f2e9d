"""A range coder over bytes, and the counts of symbols that it codes by."""

from __future__ import annotations

from readloom.errors import FormatError

#: The widths of the coder's numbers, the range below which a byte is due, what a symbol's count grows by.
WIDE, NARROW, LEAST_RANGE, GROWTH, MOST = (1 << 64) - 1, (1 << 32) - 1, (1 << 24) - 1, 2, 1 << 16


class Interval:
    """Where the coded number lies: from `low`, over `width`. Coder and decoder narrow it alike."""

    def __init__(self):
        self.low, self.width = 0, NARROW

    def narrowed(self, below: int, size: int) -> None:
        """To `size` of the equal parts of which `share` has made the width, after the first `below`."""
        self.low = (self.low + self.width * below) & WIDE
        self.width = self.width * size & NARROW

    def share(self, total: int) -> int:
        self.width //= total
        return self.width

    def due(self) -> int | None:
        """The next byte that is settled, or has to be, by cutting the interval short; None if the interval is wide enough."""
        if self.width > LEAST_RANGE:
            return None
        if (self.low ^ (self.low + self.width)) >> 56 & 0xFF:
            start = self.low & NARROW
            self.width = (start | LEAST_RANGE) - start
        byte = self.low >> 56
        self.low, self.width = self.low << 8 & WIDE, self.width << 8 & NARROW
        return byte


class RangeWriter:
    def __init__(self):
        self.interval, self.out = Interval(), bytearray()

    def put(self, below: int, size: int, total: int) -> None:
        self.interval.share(total)
        self.interval.narrowed(below, size)
        while (byte := self.interval.due()) is not None:
            self.out.append(byte)

    def bytes(self) -> bytes:
        return bytes(self.out) + self.interval.low.to_bytes(8, "big")


class RangeReader:
    """`offset`: how far the coded number lies above the interval's low end."""

    def __init__(self, data: bytes, at: int):
        if at + 8 > len(data):
            raise FormatError("a block ends in the middle of a stream")
        self.data, self.at, self.interval = data, at + 8, Interval()
        self.offset = int.from_bytes(data[at : at + 8], "big")

    def part(self, total: int) -> int:
        width = self.interval.share(total)
        return self.offset // width if width else total

    def took(self, below: int, size: int) -> None:
        self.offset = (self.offset - self.interval.width * below) & WIDE
        self.interval.narrowed(below, size)
        while self.interval.due() is not None:
            if self.at >= len(self.data):
                raise FormatError("a block ends in the middle of a stream")
            self.offset = (self.offset << 8 & WIDE) + self.data[self.at]
            self.at += 1


class Counts:
    """How often each of n symbols was seen, one more than that at first; halved before the sum is too large for the coder."""

    __slots__ = ("counts", "total")

    def __init__(self, n: int):
        self.counts, self.total = [1] * n, n

    def settle(self) -> int:
        if self.total >= MOST - GROWTH * len(self.counts):
            self.counts = [c - (c >> 1) for c in self.counts]
            self.total = sum(self.counts)
        return self.total

    def grow(self, symbol: int) -> None:
        self.counts[symbol] += GROWTH
        self.total += GROWTH

    def write(self, out: RangeWriter, symbol: int) -> None:
        total = self.settle()
        out.put(sum(self.counts[:symbol]), self.counts[symbol], total)
        self.grow(symbol)

    def read(self, source: RangeReader) -> int:
        part, below = source.part(self.settle()), 0
        for symbol, size in enumerate(self.counts):
            if below + size > part:
                break
            below += size
        else:
            raise FormatError("a range-coded stream that no symbol fits")
        source.took(below, size)
        self.grow(symbol)
        return symbol
