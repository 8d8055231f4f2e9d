"""Phred qualities as strings of one character each."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from readloom.functions.bases import chars

#: The lower edges of the quality bins and the quality that stands for each.
BIN_EDGES = (0, 2, 10, 20, 25, 30, 35, 40)
BIN_VALUES = (0, 6, 15, 22, 27, 33, 37, 40)
#: The largest Phred value with a bin of its own; those above fall in the last bin.
LARGEST_PHRED = 63
#: The symbol of the qualities at a read's end that truncation leaves out.
LOW_SYMBOL = "#"


def phred(quality: Column, offset: int) -> Column:
    return F.transform(chars(quality), lambda c: F.ascii(c) - offset)


def bin_of(q: int) -> int:
    return sum(q >= edge for edge in BIN_EDGES) - 1


def bin_quality(q: Column) -> Column:
    """The value that stands for a Phred number's bin."""
    out = F.lit(BIN_VALUES[0])
    for edge, value in zip(BIN_EDGES[1:], BIN_VALUES[1:]):
        out = F.when(q >= edge, value).otherwise(out)
    return out


def _tables(offset: int) -> tuple[str, str]:
    """All quality characters and, for each, the one that stands for its bin."""
    source = [chr(c) for c in range(offset, 127)]
    return "".join(source), "".join(chr(offset + BIN_VALUES[bin_of(min(ord(c) - offset, LARGEST_PHRED))]) for c in source)


def lossy_sequence(sequence: Column) -> Column:
    """Every symbol but A, C, G and T as N."""
    return F.regexp_replace(sequence, "[^ACGT]", "N")


def lossy_quality(sequence: Column, quality: Column, offset: int = 33) -> Column:
    """Binned qualities. A base that isn't A, C, G or T gets quality 0; the others get the second bin at least.

    A read with more or fewer qualities than bases has them binned only.
    """
    source, target = _tables(offset)
    binned = F.translate(quality, source, target)
    lifted = F.translate(binned, chr(offset), chr(offset + BIN_VALUES[1]))

    @F.arrow_udf("string")
    def coupled(bases: pa.Array, lifted: pa.Array) -> pa.Array:
        known = np.isin(np.arange(256), list(b"ACGT"))
        out = []
        for s, q in zip(bases.cast(pa.binary()).to_pylist(), lifted.cast(pa.binary()).to_pylist()):
            if s is not None and q is not None and len(s) == len(q):
                q = np.where(known[np.frombuffer(s, np.uint8)], np.frombuffer(q, np.uint8), np.uint8(offset)).tobytes()
            out.append(q)
        return pa.array(out, pa.binary()).cast(pa.string())

    return coupled(sequence, lifted)


def truncated_length(quality: Column, low: str = LOW_SYMBOL) -> Column:
    """The length without the low symbols at the end, but 1 at least for a read that isn't empty."""
    return F.when(F.length(quality) == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.length(F.rtrim(quality, F.lit(low)))))


def quality_changes(quality: Column) -> Column:
    """How often the symbol differs from the one before, the first symbol included: what is left if each run is one symbol."""
    return F.length(F.regexp_replace(quality, r"(?s)(.)\1+", "$1"))
