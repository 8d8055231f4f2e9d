"""Best-fit-decreasing packing of token sequences, planned over the histogram of piece lengths.

A document is its tokens and a final separator; only one longer than the capacity is cut, into full pieces, the first of which
takes the rest. Best-fit decreasing looks at nothing but lengths, and there are at most `capacity` of them, so the plan is made
for runs of equal pieces and runs of equal bins: a segment tree over the remaining capacities gives the tightest open bin in
logarithmic time, and a whole run is placed at once. The plan's size depends on the capacity, not on the corpus; pieces find
their place by their rank among the pieces of their length.

Ids are those of the tokenizers library for the tokenizer's file. The library is asked for each distinct word once, as it splits
a text before the last white space of a run in any case, and no token crosses such a place. A text with the literal of a special
token is given to the library whole, so the literal is that token's id.

Defined cases: a null or empty text is the separator alone; rows are packed each for itself, so equal rows and equal or null
doc_ids are allowed; an empty table gives an empty table; other columns play no part.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from readloom.llm.common import col_of, give_back, slices, staged

CAPACITY, SEPARATOR = 1024, 2
PIECES = "doc_id long, row_hash long, piece int, start long, length long, ids_le binary"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class TightestBin:
    """A segment tree over remaining capacities 0..capacity: how many runs of open bins have each, and the least one >= x."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, remaining: int, by: int) -> None:
        i = remaining + self.leaves
        while i:
            self.count[i] += by
            i >>= 1

    def tightest(self, size: int) -> int | None:
        """The least remaining capacity of at least `size` that an open bin has."""
        i = size + self.leaves
        if self.count[i]:
            return size
        while i > 1 and not (i % 2 == 0 and self.count[i + 1]):
            i >>= 1
        if i <= 1:
            return None
        i += 1
        while i < self.leaves:
            i = 2 * i if self.count[2 * i] else 2 * i + 1
        return i - self.leaves


@dataclass(frozen=True)
class Placement:
    """Pieces of this length with ranks first..first + n - 1 go, per_bin to a bin, into bins from `bin` on, from `offset` on."""

    length: int
    first: int
    n: int
    per_bin: int
    bin: int
    offset: int


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Placement]:
    """Best-fit decreasing for histogram[length] pieces of each length, by runs of bins with the same content."""
    if any(not 0 < length <= capacity for length in histogram):
        raise ValueError("every piece must have 1 to capacity tokens")
    tree, bins = TightestBin(capacity), 0
    open_bins: dict[int, list[tuple[int, int]]] = {}  # remaining -> runs (first bin, bins)
    out: list[Placement] = []

    def put(remaining: int, run: tuple[int, int]) -> None:
        if remaining:
            open_bins.setdefault(remaining, []).append(run)
            tree.add(remaining, 1)

    for length in sorted((k for k, n in histogram.items() if n), reverse=True):
        first, left = 0, histogram[length]
        while left:
            remaining = tree.tightest(length)
            if remaining is None:  # as many new bins as the rest needs
                remaining, run = capacity, (bins, math.ceil(left / (capacity // length)))
                bins += run[1]
            else:
                run = open_bins[remaining].pop()
                tree.add(remaining, -1)
            # A bin stays the tightest one while the piece still fits, so a run takes whole bins and at most one in part.
            fits, offset = remaining // length, capacity - remaining
            full = min(run[1], left // fits)
            if full:
                out.append(Placement(length, first, full * fits, fits, run[0], offset))
                first, left = first + full * fits, left - full * fits
                put(remaining - fits * length, (run[0], full))
            if full < run[1]:
                if left:  # fewer than `fits`
                    out.append(Placement(length, first, left, left, run[0] + full, offset))
                    put(remaining - left * length, (run[0] + full, 1))
                    full, left = full + 1, 0
                if full < run[1]:
                    put(remaining, (run[0] + full, run[1] - full))
    return out


#: White space as the tokenizer's pattern has it, which is less than that of Python's own.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: All white space of a run but its last character; a word with the space before it; that last character where it is no space.
UNITS = re.compile(f"[{SPACE}]+(?![^{SPACE}])| ?[^{SPACE}]+|[{SPACE}]")
BESIDE_SPACE = re.compile(f" [{SPACE}]|[{SPACE}] ")
#: Up to here all versions of Unicode agree on what a letter is.
SETTLED = "\u0250"


def byte_letters() -> dict[int, int]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it prints, else one of those from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in prints]
    return {b: b for b in prints} | {b: 256 + i for i, b in enumerate(rest)}


class WordCache(dict):
    """The ids, as bytes, of the units into which a byte-level tokenizer's pattern cuts every text.

    A new unit of settled letters is cut by the pattern here, and the library's model gives the ids of each part; any other unit
    goes through the whole of the library.
    """

    LIMIT, LONGEST = 200_000, 64

    def __init__(self, path: str):
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        pattern = public_tokenizers.PATTERN.replace("[^\\s", f"[^{SPACE}").replace("\\s", f"[{SPACE}]").replace("\\S", f"[^{SPACE}]")
        self.cut, self.letters, self.model = regex.compile(pattern).findall, byte_letters(), self.tokenizer.model

    def ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def whole(self, part: str) -> bytes:
        """The ids of what the pattern leaves whole."""
        letters = part.replace(" ", "\u0120") if part.isascii() and part.isprintable() else part.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()

    def __missing__(self, unit: str) -> bytes:
        if not (unit.isascii() or max(unit) < SETTLED):
            out = self.ids(unit)
        elif unit[1:].isalpha() and (unit[0] == " " or unit[0].isalpha()):
            out = self.whole(unit)
        else:
            parts = self.cut(unit)
            out = self.whole(unit) if len(parts) == 1 else b"".join([self[p] for p in parts])
        if len(self) >= self.LIMIT:
            self.clear()
        if len(unit) <= self.LONGEST:
            self[unit] = out
        return out

    def encode(self, text: str) -> bytes:
        if any(s in text for s in self.specials):
            return self.ids(text)
        if text[:1] == " " or text[-1:] == " " or BESIDE_SPACE.search(text):
            return b"".join(map(self.__getitem__, UNITS.findall(text)))
        first, *rest = text.split(" ")  # the quicker way where every space has a word on either side
        return self[first] + b"".join([self[" " + word] for word in rest])


def _pieces(batches: Iterator[pa.RecordBatch], path: str, capacity: int, separator: int) -> Iterator[pa.RecordBatch]:
    cache = WordCache(path)
    end = np.array([separator], "<u4").tobytes()
    names = ["doc_id", "row_hash", "piece", "start", "length", "ids_le"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
    for batch in slices(batches):
        out: list = []
        for doc, row, text in zip(col_of(batch, "doc_id").to_pylist(), col_of(batch, "row_hash").to_pylist(), col_of(batch, "text").to_pylist()):
            ids = cache.encode(text or "") + end
            n = len(ids) // 4
            cuts = [0, *range((n - 1) % capacity + 1, n + 1, capacity)]
            out += [(doc, row, i, a, b - a, ids[4 * a : 4 * b]) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)
    cache.clear()
    del cache
    give_back()  # slices() has done so, too, but with the cache still there


def token_pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, separator: int = SEPARATOR) -> DataFrame:
    """Per piece: doc_id, row_hash (of the text), piece, start, length, ids_le (its ids as unsigned little-endian 32-bit numbers).

    path: the tokenizer's file, the same on every machine.
    """
    path = path or tokenizer_path()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row_hash"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lambda it: _pieces(it, path, capacity, separator), PIECES)


def pack(pieces: DataFrame, capacity: int = CAPACITY, length: str = "length", rows_per_bucket: int = 200_000) -> DataFrame:
    """pieces, with sequence_id and offset. It is staged first, as its lengths are counted before they are placed.

    Ranks are made inside buckets of about rows_per_bucket rows and moved on by the counts before them, so that a length that
    most pieces have doesn't meet in one task.
    """
    spark, columns = pieces.sparkSession, pieces.columns
    body = F.struct(*[F.col(f"`{c}`") for c in columns])
    table = staged(pieces.select(F.col(f"`{length}`").cast("int").alias("n"), F.xxhash64(*[F.col(f"`{c}`") for c in columns]).alias("h"), body.alias("body")), "pieces")
    histogram = {r["n"]: r["rows"] for r in table.groupBy("n").agg(F.count("*").alias("rows")).collect()}  # at most `capacity` rows
    buckets = max(64, math.ceil(sum(histogram.values()) / rows_per_bucket))
    placed = [(p.length, p.first, p.first + p.n, p.per_bin, p.bin, p.offset) for p in plan(histogram, capacity)]
    table = table.withColumn("bucket", F.pmod("h", F.lit(buckets)).cast("int"))
    before = W.Window.partitionBy("n").orderBy("bucket").rowsBetween(W.Window.unboundedPreceding, -1)
    # One row for each length and bucket, so `buckets` rows at most meet in a task.
    counts = table.groupBy("n", "bucket").agg(F.count("*").alias("rows")).withColumn("base", F.coalesce(F.sum("rows").over(before), F.lit(0)))
    ranked = table.withColumn("local", F.row_number().over(W.Window.partitionBy("n", "bucket").orderBy("h")) - 1)
    ranked = ranked.join(counts.select("n", "bucket", "base"), ["n", "bucket"]).withColumn("rank", F.col("base") + F.col("local"))
    # The plan has a few rows for each length: its size is bounded by the capacity.
    where = spark.createDataFrame(placed, "n int, low long, high long, per_bin long, bin long, offset0 long")
    joined = ranked.join(F.broadcast(where), "n").where("rank >= low and rank < high")
    return joined.select(
        "body.*",
        (F.col("bin") + F.floor((F.col("rank") - F.col("low")) / F.col("per_bin"))).cast("long").alias("sequence_id"),
        (F.col("offset0") + (F.col("rank") - F.col("low")) % F.col("per_bin") * F.col("n")).cast("long").alias("offset"),
    )


def sequences(packed: DataFrame) -> DataFrame:
    """The token sequences themselves, from pack() of rows with ids_le: sequence_id, ids_le. A sequence has `capacity` tokens at most."""
    parts = F.array_sort(F.collect_list(F.struct("offset", F.hex("ids_le").alias("ids"))))
    return packed.groupBy("sequence_id").agg(F.unhex(F.array_join(F.transform(parts, lambda x: x["ids"]), "")).alias("ids_le"))


def pack_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Where each piece of each document goes: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    rows = token_pieces(docs, path).select("doc_id", "row_hash", "piece", "start", "length", F.crc32("ids_le").alias("ids_crc32"))
    return pack(rows).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
