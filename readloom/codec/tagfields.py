"""Tags as fields between separators: constant, numeric in five ways, or text with a code for each place that differs."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np

from readloom.codec.bits import BitReader, BitWriter
from readloom.codec.trees import Tree
from readloom.errors import FormatError
from readloom.functions.tags import SEPARATORS
from readloom.operators.tagstats import MOST_POSITIONS, MOST_VALUES, RUN_RATIO

#: Numbers of the numeric schemes, letters of a text's codes, the longest run, the longest field.
VALUE, VALUE_RUNS, DELTA, DELTA_RUNS, DELTA_CONSTANT = 1, 2, 3, 4, 5
LETTERS, LONGEST_RUN, LONGEST_FIELD = 256, 256, 1023
#: What stands where the last field's separator would.
NO_SEPARATOR = 10

_CUT = re.compile(b"([" + re.escape(SEPARATORS.encode()) + b"])")
_NUMBER = re.compile(rb"0|[1-9][0-9]{0,8}")


def split(tags: list[bytes]) -> list[list[bytes]] | None:
    """The tokens of each tag and, in between, its separators; None unless all tags have the same ones."""
    parts = [_CUT.split(t) for t in tags]
    first = parts[0][1::2]
    if len(first) > 254 or any(p[1::2] != first for p in parts) or any(len(x) > LONGEST_FIELD for p in parts for x in p):
        return None
    return parts


@dataclass
class Numbers:
    """A numeric field. Values or deltas are stored less their least one."""

    scheme: int
    values: tuple[int, int]
    deltas: tuple[int, int] = (0, 0)
    tree: Tree | None = None
    run: list = field(default_factory=lambda: [0, 0])  # what is left of the run, and its number

    @property
    def by_delta(self) -> bool:
        return self.scheme >= DELTA

    @property
    def first_bits(self) -> int:
        return (self.values[1] - self.values[0]).bit_length()

    @property
    def bits(self) -> int:
        low, high = self.deltas if self.by_delta else self.values
        return (high - low).bit_length()


def _runs(numbers: list[int]) -> list[tuple[int, int]]:
    """(first place, length) of each run of equal numbers, in parts of LONGEST_RUN."""
    out: list[list[int]] = []
    for i, x in enumerate(numbers):
        if out and numbers[out[-1][0]] == x and out[-1][1] < LONGEST_RUN:
            out[-1][1] += 1
        else:
            out.append([i, 1])
    return [(i, n) for i, n in out]


def choose(values: list[int]) -> Numbers:
    """As operators.tagstats.numeric_scheme() does for a block."""
    deltas = [b - a for a, b in zip(values, values[1:])]
    value, delta = (min(values), max(values)), (min(deltas), max(deltas))
    by_delta = value[1] - value[0] >= delta[1] - delta[0]
    pays = lambda runs: np.float32(len(values)) / np.float32(len(runs)) > np.float32(RUN_RATIO)
    if by_delta and delta[0] == delta[1]:
        scheme = DELTA_CONSTANT
    elif by_delta and pays(_runs(deltas)):
        scheme = DELTA_RUNS
    elif pays(_runs(values)):
        scheme = VALUE_RUNS
    else:
        scheme = DELTA if by_delta else VALUE
    out = Numbers(scheme, value, delta)
    if scheme in (VALUE, DELTA):
        low, high = delta if by_delta else value
        if high - low < MOST_VALUES:
            counts = Counter(deltas if by_delta else values)
            out.tree = Tree.of([counts[x] for x in range(low, high + 1)])
    return out


class Field:
    def __init__(self, tokens: list[bytes]):
        self.first, self.constant = tokens[0], all(t == tokens[0] for t in tokens)
        self.numbers: Numbers | None = None
        if self.constant:
            return
        if all(_NUMBER.fullmatch(t) for t in tokens):
            self.values = [int(t) for t in tokens]
            self.numbers = choose(self.values)
            if self.numbers.scheme in (VALUE_RUNS, DELTA_RUNS):
                shift = self.numbers.by_delta
                numbers = [b - a for a, b in zip(self.values, self.values[1:])] if shift else self.values
                self.run_at = {i + shift: n for i, n in _runs(numbers)}
            return
        self.shortest, self.longest = min(map(len, tokens)), max(map(len, tokens))
        self.same = [all(len(t) <= j or t[j] == c for t in tokens) for j, c in enumerate(self.first)]
        counts = [[0] * LETTERS for _ in range(min(self.longest, MOST_POSITIONS + 1))]
        for t in tokens:
            for j, c in enumerate(t):
                counts[min(j, MOST_POSITIONS)][c] += 1
        # A tree that no letter needs is stored all the same where positions share one.
        coded = [j for j in range(min(self.longest, MOST_POSITIONS)) if j >= len(self.first) or not self.same[j]]
        shared = [MOST_POSITIONS] if self.longest >= MOST_POSITIONS else []
        self.trees = {j: Tree.of(counts[j] if j < len(counts) else [0] * LETTERS) for j in coded + shared}

    def store(self, out: BitWriter, separator: int) -> None:
        out.number(separator, 1)
        out.number(self.constant, 1)
        if self.constant:
            out.number(len(self.first))
            out.raw(self.first)
            return
        out.number(self.numbers is not None, 1)
        n = self.numbers
        if n is not None:
            out.number(n.scheme, 1)
            for x in n.values + (n.deltas if n.by_delta else ()):
                out.number(x & 0xFFFFFFFF)
            if n.scheme in (VALUE, DELTA):
                out.number(n.tree is not None, 1)
                if n.tree is not None:
                    n.tree.store(out)
            return
        out.number(self.shortest == self.longest, 1)
        for x in (len(self.first), self.longest, self.shortest):
            out.number(x)
        out.raw(self.first)
        for x in self.same:
            out.bits(x, 1)
        out.align()
        for j in sorted(self.trees):
            self.trees[j].store(out)

    def store_token(self, out: BitWriter, token: bytes, i: int) -> None:
        if self.constant:
            return
        n = self.numbers
        if n is None:
            if self.shortest != self.longest:
                out.bits(len(token) - self.shortest, (self.longest - self.shortest).bit_length())
            for j, c in enumerate(token):
                if j >= len(self.first) or not self.same[j]:
                    out.code(self.trees[min(j, MOST_POSITIONS)].codes[c])
            return
        if i == 0:
            out.bits(self.values[0] - n.values[0], n.first_bits)
        elif n.scheme != DELTA_CONSTANT:
            number = self.values[i] - self.values[i - 1] - n.deltas[0] if n.by_delta else self.values[i] - n.values[0]
            if n.tree is not None:
                out.code(n.tree.codes[number])
            elif n.scheme in (VALUE, DELTA) or i in self.run_at:
                out.bits(number, n.bits)
        if n.scheme in (VALUE_RUNS, DELTA_RUNS) and i in self.run_at:
            out.bits(self.run_at[i] - 1, 8)


class StoredField:
    def __init__(self, source: BitReader):
        self.separator, self.constant = source.number(1), bool(source.number(1))
        self.numbers, self.last = None, 0
        if self.constant:
            self.first = source.raw(self._length(source))
            return
        if source.number(1):
            scheme = source.number(1)
            if not VALUE <= scheme <= DELTA_CONSTANT:
                raise FormatError(f"no numeric scheme {scheme}")
            n = self.numbers = Numbers(scheme, (source.number(), source.number()))
            if n.by_delta:
                n.deltas = tuple((x ^ 1 << 31) - (1 << 31) for x in (source.number(), source.number()))
            if n.values[0] > n.values[1] or n.deltas[0] > n.deltas[1]:
                raise FormatError("a numeric field of which the least number is above the largest")
            if scheme in (VALUE, DELTA) and source.number(1):
                n.tree = Tree.load(source)
            return
        source.number(1)  # whether all tokens are of one length, which the lengths say, too
        length, self.longest, self.shortest = (self._length(source) for _ in range(3))
        if self.shortest > self.longest:
            raise FormatError("a tag field of which the shortest token is longer than the longest")
        self.first = source.raw(length)
        self.same = [bool(source.bits(1)) for _ in range(length)]
        source.align()
        coded = [j for j in range(min(self.longest, MOST_POSITIONS)) if j >= length or not self.same[j]]
        self.trees = {j: Tree.load(source) for j in coded + ([MOST_POSITIONS] if self.longest >= MOST_POSITIONS else [])}

    @staticmethod
    def _length(source: BitReader) -> int:
        n = source.number()
        if n > LONGEST_FIELD:
            raise FormatError("a tag field of an impossible length")
        return n

    def token(self, source: BitReader, i: int) -> bytes:
        if self.constant:
            return self.first
        n = self.numbers
        if n is None:
            size = self.shortest + source.bits((self.longest - self.shortest).bit_length())
            out = bytearray()
            for j in range(size):
                if j < len(self.first) and self.same[j]:
                    out.append(self.first[j])
                else:
                    tree = self.trees[min(j, MOST_POSITIONS)]
                    out.append(source.symbol(tree.symbols, tree.shortest))
            return bytes(out)
        runs = n.scheme in (VALUE_RUNS, DELTA_RUNS)
        if i == 0:
            number = source.bits(n.first_bits)
            self.last = n.values[0] + number
            if n.scheme == VALUE_RUNS:
                n.run = [source.bits(8), number]
            return str(self.last).encode()
        if n.scheme == DELTA_CONSTANT:
            number = 0
        elif n.tree is not None:
            number = source.symbol(n.tree.symbols, n.tree.shortest)
        elif runs and n.run[0] and (i > 1 or n.scheme == VALUE_RUNS):
            n.run[0] -= 1
            number = n.run[1]
        else:
            number = source.bits(n.bits)
            if runs:
                n.run = [source.bits(8), number]
        self.last = self.last + n.deltas[0] + number if n.by_delta else n.values[0] + number
        return str(self.last).encode()
