"""Contexts of range-coded streams: the last bases, and the last qualities with the part of the read."""

from __future__ import annotations

from collections import defaultdict

from readloom.codec.bits import BitReader, BitWriter
from readloom.codec.ranges import Counts, RangeReader, RangeWriter
from readloom.codec.trees import load_presence, store_presence
from readloom.errors import FormatError

#: Symbols and longest context of the two schemes of bases.
DNA_SCHEMES = ((4, 9), (8, 7))
#: Symbols and contexts of the lossless schemes of qualities, at order 1 and above it.
QUALITY_SCHEMES = {1: ((16, 3), (32, 2), (64, 1), (128, 1)), 2: ((16, 4), (32, 3), (64, 2), (128, 1))}
#: Parts of a read in the first schemes; the others have as many as symbols. Bins of the lossy qualities.
PARTS, LOSSY_SYMBOLS, QUALITY_SET = 8, 8, 256
#: When reads of one length have enough runs for the schemes of many parts.
MANY_PARTS_RATIO = 1.175


class BaseContext:
    """The last k bases of a block, over the ends of reads."""

    def __init__(self, symbols: int, k: int):
        self.bits, self.mask, self.now = (symbols - 1).bit_length(), (1 << (symbols - 1).bit_length() * k) - 1, 0
        self.counts: dict[int, Counts] = defaultdict(lambda: Counts(symbols))

    def model(self) -> Counts:
        return self.counts[self.now]

    def saw(self, symbol: int) -> None:
        self.now = (self.now << self.bits | symbol) & self.mask


class QualityContext:
    """The last k qualities of a block, of which the middle one is its mean with the one before, and the part of the read."""

    def __init__(self, symbols: int, k: int):
        self.bits, self.k, self.now, self.before = (symbols - 1).bit_length(), k, 0, 0
        self.one, self.middle = (1 << self.bits) - 1, k // 2 * self.bits
        self.mask = (1 << self.bits * (k + 1)) - 1
        self.counts: dict[int, Counts] = defaultdict(lambda: Counts(symbols))

    def model(self, part: int) -> Counts:
        return self.counts[(self.now & (1 << self.bits * self.k) - 1) << self.bits | part]

    def saw(self, symbol: int) -> None:
        self.now <<= self.bits
        middle = self.now >> self.middle & self.one
        self.now += ((middle + self.before) // 2 - middle) << self.middle
        self.now = (self.now | symbol) & self.mask
        self.before = middle


def base_scheme(present: list[int]) -> int:
    for scheme, (symbols, _) in enumerate(DNA_SCHEMES):
        if max(present) < symbols:
            return scheme
    raise FormatError("bases beyond the first eight symbols can't be stored at an order above 0")


def _base_context(scheme: int, order: int) -> BaseContext:
    if scheme >= len(DNA_SCHEMES):
        raise FormatError(f"no DNA scheme {scheme}")
    symbols, longest = DNA_SCHEMES[scheme]
    return BaseContext(symbols, min(order, longest))


def store_bases(out: BitWriter, rows: list[list[int]], scheme: int, order: int) -> None:
    context, coder = _base_context(scheme, order), RangeWriter()
    for row in rows:
        for i in row:
            context.model().write(coder, i)
            context.saw(i)
    out.raw(coder.bytes())


def load_bases(source: BitReader, lengths: list[int], scheme: int, order: int) -> list[list[int]]:
    context, coder, out = _base_context(scheme, order), RangeReader(*source.rest()), []
    for n in lengths:
        row = []
        for _ in range(n):
            i = context.model().read(coder)
            context.saw(i)
            row.append(i)
        out.append(row)
    source.skip_to(coder.at)
    return out


def quality_scheme(present: list[int], order: int, lengths: list[int], changes: int) -> int:
    """Symbols by the number of distinct qualities; at order 2 many parts for reads of one length with long runs."""
    sizes = [symbols for symbols, _ in QUALITY_SCHEMES[1]]
    fits = [i for i, n in enumerate(sizes) if n >= len(present)]
    if not fits:
        raise FormatError("a block has more than 128 distinct qualities, which no scheme at an order above 0 holds")
    many = order == 2 and min(lengths) == max(lengths) and changes > 0 and sum(lengths) / changes > MANY_PARTS_RATIO
    return fits[0] + len(sizes) * many


def _quality_context(scheme: int, order: int) -> tuple[QualityContext, int]:
    table = QUALITY_SCHEMES[1 if order == 1 else 2]
    if scheme >= 2 * len(table):
        raise FormatError(f"no quality scheme {scheme}")
    symbols, k = table[scheme % len(table)]
    return QualityContext(symbols, k), PARTS if scheme < len(table) else symbols


def _write(out: BitWriter, rows: list[list[int]], context: QualityContext, parts: int) -> None:
    coder = RangeWriter()
    for row in rows:
        for j, s in enumerate(row):
            context.model(j * parts // len(row)).write(coder, s)
            context.saw(s)
    out.raw(coder.bytes())


def _read(source: BitReader, lengths: list[int], context: QualityContext, parts: int) -> list[list[int]]:
    coder, out = RangeReader(*source.rest()), []
    for n in lengths:
        row = []
        for j in range(n):
            s = context.model(j * parts // n).read(coder)
            context.saw(s)
            row.append(s)
        out.append(row)
    source.skip_to(coder.at)
    return out


def store_qualities(out: BitWriter, rows: list[list[int]], scheme: int, order: int) -> None:
    """After the scheme: which symbols there are, then their numbers in order."""
    present = sorted({s for row in rows for s in row})
    number = {s: i for i, s in enumerate(present)}
    store_presence(out, present, QUALITY_SET)
    out.align()
    _write(out, [[number[s] for s in row] for row in rows], *_quality_context(scheme, order))


def load_qualities(source: BitReader, lengths: list[int], scheme: int, order: int) -> list[list[int]]:
    present = load_presence(source, QUALITY_SET)
    source.align()
    try:
        return [[present[s] for s in row] for row in _read(source, lengths, *_quality_context(scheme, order))]
    except IndexError:
        raise FormatError("a quality that isn't among the block's symbols") from None


def store_bins(out: BitWriter, rows: list[list[int]], order: int) -> None:
    _write(out, rows, QualityContext(LOSSY_SYMBOLS, order), LOSSY_SYMBOLS)


def load_bins(source: BitReader, lengths: list[int], order: int) -> list[list[int]]:
    return _read(source, lengths, QualityContext(LOSSY_SYMBOLS, order), LOSSY_SYMBOLS)
