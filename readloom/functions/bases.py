"""Bases: the symbol table, ambiguity codes inside qualities, and colour space."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The base symbols by index.
ALPHABET = "AGCTNRWSKMDVHBYXU.-"
#: The bases of two bits in colour space; a colour is the XOR of two neighbours' bits.
TWO_BITS = "ACGT"
#: A base that isn't A, G, C or T with a quality below 7 moves into the quality as 128 + 8 * (index - 4) + quality.
TRANSFER_BASE, TRANSFER_STEP, TRANSFER_BELOW = 128, 8, 7


def chars(text: Column) -> Column:
    """An array of one-character strings; empty for an empty text."""
    return F.filter(F.split(text, ""), lambda c: c != "")


def symbol_index(base: Column) -> Column:
    """The index of a base symbol; null for anything else, lower case included."""
    at = F.instr(F.lit(ALPHABET), base)
    return F.when((F.length(base) == 1) & (at > 0), at - 1)


def index_bases(sequence: Column) -> Column:
    return F.transform(chars(sequence), symbol_index)


def unindex_bases(indexes: Column) -> Column:
    letters = F.array(*[F.lit(c) for c in ALPHABET])
    return F.array_join(F.transform(indexes, lambda i: F.element_at(letters, (i + 1).cast("int"))), "")


def is_transferred(index: Column, q: Column) -> Column:
    return (index > 3) & (q < TRANSFER_BELOW)


def to_transferred(index: Column, q: Column) -> Column:
    """The quality symbol of a base and its quality: with the base inside it where the base is dropped."""
    return F.when(is_transferred(index, q), TRANSFER_BASE + TRANSFER_STEP * (index - 4) + q).otherwise(q)


def from_transferred(symbol: Column) -> Column:
    """(index, q) of a quality symbol that holds a base; a null index for any other."""
    inside = symbol >= TRANSFER_BASE
    index = F.when(inside, F.floor((symbol - TRANSFER_BASE) / TRANSFER_STEP).cast("int") + 4)
    return F.struct(index.alias("index"), F.when(inside, symbol.bitwiseAND(TRANSFER_STEP - 1)).otherwise(symbol).alias("q"))


def is_color_space(sequence: Column) -> Column:
    """Whether the second symbol is a colour."""
    return F.substring(sequence, 2, 1).rlike("^[0-3.]$")


def _bits(base: Column) -> Column:
    return F.instr(F.lit(TWO_BITS), base) - 1


def _scan(sequence: Column, step: Callable[[Column, Column], Column]) -> Column:
    """The first symbol and, for each further one, what step(state, symbol) gives: a struct of a letter and the next state.

    The text grows in pieces of 256 symbols, so its length is paid for about once and not once for each symbol.
    """
    first = F.substring(sequence, 1, 1)
    start = F.struct(first.alias("text"), F.greatest(_bits(first), F.lit(0)).cast("int").alias("state"))
    pieces = F.regexp_extract_all(F.substring(sequence, 2, 2147483647), F.lit("(?s).{1,256}"), 0)

    def one(acc: Column, symbol: Column) -> Column:
        nxt = step(acc["state"], symbol)
        return F.struct(F.concat(acc["text"], nxt["letter"]).alias("text"), nxt["state"].alias("state"))

    def piece(acc: Column, text: Column) -> Column:
        inner = F.aggregate(chars(text), F.struct(F.lit("").alias("text"), acc["state"].alias("state")), one)
        return F.element_at(F.transform(F.array(inner), lambda x: F.struct(F.concat(acc["text"], x["text"]).alias("text"), x["state"].alias("state"))), 1)

    return F.when(F.length(sequence) == 0, sequence).otherwise(F.aggregate(pieces, start, piece, lambda acc: acc["text"]))


def colors_to_bases(sequence: Column) -> Column:
    """A first base and colours as bases. A '.' gives N, after which the colours go on from the last base that is none."""
    letters = F.array(*[F.lit(c) for c in TWO_BITS])

    def step(state: Column, color: Column) -> Column:
        after = F.when(color == ".", state).otherwise(state.bitwiseXOR(color.cast("int")))
        return F.struct(F.when(color == ".", F.lit("N")).otherwise(F.element_at(letters, after + 1)).alias("letter"), after.alias("state"))

    return _scan(sequence, step)


def bases_to_colors(sequence: Column) -> Column:
    """The inverse: the first base stays, each further one is its colour against the last base that isn't N."""

    def step(state: Column, base: Column) -> Column:
        known = _bits(base) >= 0
        after = F.when(known, _bits(base)).otherwise(state).cast("int")
        return F.struct(F.when(known, state.bitwiseXOR(after).cast("string")).otherwise(F.lit(".")).alias("letter"), after.alias("state"))

    return _scan(sequence, step)


def kmers_with_next(text: Column, k: int) -> Column:
    """Every k + 1 symbols in a row: a context of k and the symbol that follows. One pass: a match takes no symbols."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{k + 1}}}))"), 1)
