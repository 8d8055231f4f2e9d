"""Counts over the bytes of reads as NumPy arrays: a task turns its reads into partial counts, which are then added up.

A row for each base would be many times the input; these give a row for each distinct key of a slice of reads. Sequences and
qualities are ASCII; reads have as many qualities as bases where both are used.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.errors import FormatError
from readloom.functions.bases import ALPHABET, TRANSFER_BASE, TRANSFER_BELOW, TRANSFER_STEP
from readloom.functions.qualities import LOW_SYMBOL

#: Reads are taken in slices of about this many bytes.
SLICE_BYTES = 1 << 20
#: The index of each byte that is a base symbol, else 255.
INDEX = np.array([ALPHABET.find(chr(c)) if chr(c) in ALPHABET else 255 for c in range(256)], np.uint8)


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of texts and its n + 1 offsets. A null has none."""
    column = (column.fill_null("") if column.null_count else column).cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, 8 * column.offset) if len(column) else np.zeros(1, np.int64)
    body = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return body, at - at[0]


def slices(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        _, at = raw(batch.column(column))
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(at, at[i] + SLICE_BYTES, side="right")) - 1)
            yield batch.slice(i, min(j, batch.num_rows) - i)
            i = j


def places(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(read, place in the read) of each byte."""
    n = np.diff(at)
    return np.repeat(np.arange(len(n)), n), np.arange(at[-1]) - np.repeat(at[:-1], n)


def both(batch: pa.RecordBatch, offset: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(base indexes, qualities, offsets)."""
    s, at = raw(batch.column("sequence"))
    q, other = raw(batch.column("quality"))
    if not np.array_equal(at, other):
        raise FormatError("a read has more or fewer qualities than bases")
    return INDEX[s], q.astype(np.int64) - offset, at


def blocks(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(distinct blocks, the number of each read's among them)."""
    return np.unique(batch.column("block_id").to_numpy(), return_inverse=True)


def counted(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys, counts) of numbers from 0; by counting where they are small."""
    if len(key) and key.max() < 1 << 22:
        counts = np.bincount(key)
        found = np.flatnonzero(counts)
        return found, counts[found]
    return np.unique(key, return_counts=True)


def by_block(reads: DataFrame, *columns: str) -> DataFrame:
    """The reads of a block in one task, in the order of read_id."""
    return reads.select("block_id", "read_id", *columns).repartition("block_id").sortWithinPartitions("block_id", "read_id")


def tally(reads: DataFrame, columns: list[str], keys: str, one: Callable[[pa.RecordBatch], list]) -> DataFrame:
    """The rows (keys, n): of each slice `one` gives the columns of its partial counts, keys first and their numbers last."""
    schema = f"{keys}, n bigint"
    names = [x.split()[0] for x in schema.split(", ")]

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, columns[-1]):
            got = [pa.array(c) for c in one(batch)]
            if len(got[0]):
                got[-1] = got[-1].cast(pa.int64())
                yield pa.RecordBatch.from_arrays(got, names=names)

    parts = reads.select(*columns).mapInArrow(part, schema)
    return parts.groupBy(*names[:-1]).agg(F.sum("n").alias("n"))


def quality_counts(reads: DataFrame, offset: int) -> DataFrame:
    """block_id, q, n."""

    def one(batch):
        q, at = raw(batch.column("quality"))
        distinct, number = blocks(batch)
        key, n = counted(number[places(at)[0]] * 256 + q)
        return [distinct[key >> 8], ((key & 255) - offset).astype(np.int32), n]

    return tally(reads, ["block_id", "quality"], "block_id bigint, q int", one)


def kept_base_counts(reads: DataFrame, offset: int) -> DataFrame:
    """block_id, base, n: of the bases that stay in the sequence once ambiguity codes have moved into the qualities."""
    letters = np.array([*ALPHABET])

    def one(batch):
        index, q, at = both(batch, offset)
        distinct, number = blocks(batch)
        stays = (index < 255) & ~((index > 3) & (q < TRANSFER_BELOW))
        key, n = counted((number[places(at)[0]] * 256 + index)[stays])
        return [distinct[key >> 8], letters[key & 255], n]

    return tally(reads, ["block_id", "sequence", "quality"], "block_id bigint, base string", one)


def transfer_counts(reads: DataFrame, offset: int) -> DataFrame:
    """block_id, symbol, moved, n: quality symbols with the ambiguity codes that move into them."""

    def one(batch):
        index, q, at = both(batch, offset)
        distinct, number = blocks(batch)
        moved = (index > 3) & (index < 255) & (q < TRANSFER_BELOW)
        symbol = np.where(moved, TRANSFER_BASE + TRANSFER_STEP * (index.astype(np.int64) - 4) + q, q)
        key, n = counted((number[places(at)[0]] * 256 + symbol) * 2 + moved)
        return [distinct[key >> 9], (key >> 1 & 255).astype(np.int32), (key & 1).astype(bool), n]

    return tally(reads, ["block_id", "sequence", "quality"], "block_id bigint, symbol int, moved boolean", one)


def position_counts(reads: DataFrame, offset: int, truncated: bool = False) -> DataFrame:
    """pos, q, n. truncated: only the symbols before the low ones at each read's end, the first in any case."""

    def one(batch):
        q, at = raw(batch.column("quality"))
        read, pos = places(at)
        if truncated:
            last = np.zeros(len(at) - 1, np.int64)
            high = q != ord(LOW_SYMBOL)
            np.maximum.at(last, read[high], pos[high])
            kept = pos <= last[read]
            q, pos = q[kept], pos[kept]
        key, n = counted(pos * 256 + q)
        return [(key >> 8).astype(np.int32), ((key & 255) - offset).astype(np.int32), n]

    return tally(reads, ["quality"], "pos int, q int", one)


def context_counts(reads: DataFrame, column: str, k: int, buckets: int = 1) -> DataFrame:
    """gram, bucket, n: every k + 1 symbols in a row within a read, by the part of the read that the last stands in."""
    if not 1 <= k <= 6:
        raise ValueError("a context has 1 to 6 symbols")

    def one(batch):
        s, at = raw(batch.column(column))
        read, pos = places(at)
        size = np.diff(at)[read]
        whole = np.flatnonzero(pos < size - k)
        gram = np.zeros(len(whole), np.int64)
        for j in range(k + 1):
            gram = gram << 8 | s[whole + j]
        bucket = ((pos[whole] + k) * buckets // size[whole]).astype(np.int64)
        key, n = counted(gram | bucket << 8 * (k + 1))
        text = np.stack([(key >> 8 * (k - j) & 255).astype(np.uint8) for j in range(k + 1)], axis=1)
        return [pa.array([x.tobytes().decode("ascii") for x in text], pa.string()), (key >> 8 * (k + 1)).astype(np.int32), n]

    return tally(reads, [column], "gram string, bucket int", one)


def byte_range(reads: DataFrame) -> DataFrame:
    """block_id, low, high: the least and largest quality byte; of a block without qualities both are null."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "quality"):
            q, at = raw(batch.column("quality"))
            some = np.flatnonzero(np.diff(at))
            low, high = (np.full(batch.num_rows, -1, np.int32) for _ in range(2))
            if len(some):
                low[some], high[some] = np.minimum.reduceat(q, at[some]), np.maximum.reduceat(q, at[some])
            empty = np.diff(at) == 0
            yield pa.RecordBatch.from_arrays([batch.column("block_id"), pa.array(low, mask=empty), pa.array(high, mask=empty)], names=["block_id", "low", "high"])

    ends = reads.select("block_id", "quality").mapInArrow(part, "block_id bigint, low int, high int")
    return ends.groupBy("block_id").agg(F.min("low").alias("low"), F.max("high").alias("high"))


def quality_runs(reads: DataFrame, offset: int, longest: int) -> DataFrame:
    """block_id, run, part, q, length: runs of equal qualities over a block's reads in the order of read_id, cut after `longest`.

    The reads of a block meet in one task and pass through it in order; only the run that is open is held.
    """
    schema = pa.schema([("block_id", pa.int64()), ("run", pa.int64()), ("part", pa.int64()), ("q", pa.int32()), ("length", pa.int64())])

    def rows(block: np.ndarray, run: np.ndarray, q: np.ndarray, length: np.ndarray) -> pa.RecordBatch:
        parts = -(-length // longest)
        at = np.repeat(np.arange(len(length)), parts)
        part = np.arange(len(at)) - np.repeat(np.cumsum(parts) - parts, parts)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (block[at], run[at], part, (q[at] - offset).astype(np.int32), np.minimum(longest, length[at] - part * longest))], schema=schema)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # block, run, quality, length
        for batch in slices(batches, "quality"):
            q, at = raw(batch.column("quality"))
            if not len(q):
                continue
            block = np.repeat(batch.column("block_id").to_numpy(), np.diff(at))
            first = np.flatnonzero(np.concatenate([[True], (q[1:] != q[:-1]) | (block[1:] != block[:-1])]))
            length, b, s = np.diff(np.append(first, len(q))), block[first], q[first].astype(np.int64)
            run = np.arange(len(first)) - np.searchsorted(b, b)  # blocks ascend inside a slice
            if held is not None and held[0] == b[0]:
                same = held[2] == s[0]
                run[b == b[0]] += held[1] + (not same)
                if same:
                    length[0] += held[3]
            if held is not None and not (held[0] == b[0] and held[2] == s[0]):
                yield rows(*(np.array([x]) for x in held))
            held = (b[-1], run[-1], s[-1], length[-1])
            if len(first) > 1:
                yield rows(b[:-1], run[:-1], s[:-1], length[:-1])
        if held is not None:
            yield rows(*(np.array([x]) for x in held))

    return by_block(reads, "quality").mapInArrow(scan, "block_id bigint, run bigint, part bigint, q int, length bigint")


def crc32_combined(first: int, second: int, length: int) -> int:
    """The CRC-32 of two texts put together, from theirs and the length of the second: first * x ** (8 * length) + second."""

    def product(a: int, b: int) -> int:  # modulo the polynomial, with x ** 0 as the highest bit
        out = 0
        for i in range(32):
            if a >> (31 - i) & 1:
                out ^= b
            b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
        return out

    power, square, n = 1 << 31, 1 << 30, 8 * length
    while n:
        if n & 1:
            power = product(power, square)
        square, n = product(square, square), n >> 1
    return product(first, power) ^ second


def stretches(rows: DataFrame, columns: list[str], place: str) -> DataFrame:
    """block_id, place, first_read, records, and for each column bytes_ and crc32_: of rows that follow each other in a task and
    have the same block_id and place. rows: block_id, read_id, place and the columns, in the order of read_id in each such group.
    Nothing is gathered: a checksum goes on from row to row."""
    fields = [("block_id", pa.int64()), ("place", pa.string()), ("first_read", pa.int64()), ("records", pa.int64())]
    schema = pa.schema(fields + [(f"{kind}_{c}", pa.int64()) for c in columns for kind in ("bytes", "crc32")])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out = None, []
        for batch in batches:
            texts = [batch.column(c).fill_null("").cast(pa.binary()).to_pylist() for c in columns]
            for block, at, read, *body in zip(*(batch.column(c).to_pylist() for c in ("block_id", "place", "read_id")), *texts):
                if now is None or now[:2] != [block, at]:
                    now = [block, at, read, 0] + [0, 0] * len(columns)
                    out.append(now)
                now[3] += 1
                for i, text in enumerate(body):
                    now[4 + 2 * i] += len(text)
                    now[5 + 2 * i] = zlib.crc32(text, now[5 + 2 * i])
            if len(out) > 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out[:-1]), schema)], schema=schema)
                out = out[-1:]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    ddl = "block_id bigint, place string, first_read bigint, records bigint, " + ", ".join(f"bytes_{c} bigint, crc32_{c} bigint" for c in columns)
    return rows.select("block_id", "read_id", F.col(place).alias("place"), *columns).mapInArrow(scan, ddl)


def put_together(stretches: DataFrame, columns: list[str]) -> DataFrame:
    """block_id, first_read, records and for each column bytes_ and crc32_, of the stretches of each block in the order of their reads."""

    @F.arrow_udf("bigint")
    def fold(parts: pa.Array) -> pa.Array:
        out = []
        for part in parts.to_pylist():
            crc = 0
            for x in part:
                crc = crc32_combined(crc, x["crc"], x["bytes"])
            out.append(crc)
        return pa.array(out, pa.int64())

    parts = [F.array_sort(F.collect_list(F.struct("first_read", F.col(f"bytes_{c}").alias("bytes"), F.col(f"crc32_{c}").alias("crc")))).alias(f"parts_{c}") for c in columns]
    sums = [F.sum(f"bytes_{c}").alias(f"bytes_{c}") for c in columns]
    one = stretches.groupBy("block_id").agg(F.min("first_read").alias("first_read"), F.sum("records").alias("records"), *sums, *parts)
    return one.select("block_id", "first_read", "records", *[f"bytes_{c}" for c in columns], *[fold(f"parts_{c}").alias(f"crc32_{c}") for c in columns])


def profile(raw_reads: DataFrame) -> DataFrame:
    """Rows to be added up: records, low and high quality byte, how many reads are in colour space, begin with a colour, repeat the tag."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "quality"):
            q, _ = raw(batch.column("quality"))
            s, at = raw(batch.column("sequence"))
            p, plus = raw(batch.column("plus"))
            long = np.flatnonzero(np.diff(at) > 1)
            color = np.isin(s[at[long] + 1], list(b"0123."))
            digit = color & np.isin(s[at[long]], list(b"0123"))
            row = [batch.num_rows, int(q.min()) if len(q) else None, int(q.max()) if len(q) else None, int(color.sum()), int(digit.sum()), int((np.diff(plus) > 1).sum())]
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in row], names=["records", "low", "high", "color", "digit", "repeated"])

    return raw_reads.select("sequence", "plus", "quality").mapInArrow(part, "records bigint, low bigint, high bigint, color bigint, digit bigint, repeated bigint")


def model_counts(reads: DataFrame, column: str, offset: int, k: int, buckets: int, mean: bool) -> DataFrame:
    """context, bucket, symbol, n: what follows the last k symbols of a block, whatever read they are in, by the part of the read.

    Symbols are bytes less the offset, and 0 before a block's first. With mean, a symbol from the middle of the context on is the
    mean of itself and the one before it, rounded down. context: the symbols from the last one back, joined by commas.
    """
    middle = k // 2 if mean and k > 1 else k

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block_before, tail = None, np.zeros(k + 1, np.int64)
        for batch in slices(batches, column):
            s, at = raw(batch.column(column))
            if not len(s):
                continue
            read, pos = places(at)
            block = batch.column("block_id").to_numpy()[read]
            whole = np.concatenate([tail, s.astype(np.int64) - offset])
            owner = np.concatenate([np.full(k + 1, block[0] if block_before is None else block_before), block])
            started = block_before is not None
            block_before, tail = block[-1], whole[-k - 1 :]
            now = np.arange(k + 1, len(whole))

            def back(i: int, whole=whole, owner=owner, now=now, started=started) -> np.ndarray:
                same = (owner[now - i] == owner[now]) & (started | (now - i > k))
                return np.where(same, whole[now - i], 0)

            digits = [back(i + 1) if i < middle else (back(i + 1) + back(i + 2)) // 2 for i in range(k)]
            key = np.zeros(len(now), np.int64)
            for d in [*digits, whole[k + 1 :], pos * buckets // np.diff(at)[read]]:
                key = key << 8 | d
            found, n = counted(key)
            places_of = [found >> 8 * (k + 1 - i) & 255 for i in range(k)]
            context = [",".join(map(str, c)) for c in zip(*(p.tolist() for p in places_of))]
            yield pa.RecordBatch.from_arrays([pa.array(context), pa.array((found & 255).astype(np.int32)), pa.array((found >> 8 & 255).astype(np.int32)), pa.array(n, pa.int64())], names=["context", "bucket", "symbol", "n"])

    if not 1 <= k <= 5 or not 1 <= buckets <= 256:
        raise ValueError("a context has 1 to 5 symbols, a read 1 to 256 parts")
    parts = by_block(reads, column).mapInArrow(scan, "context string, bucket int, symbol int, n bigint")
    return parts.groupBy("context", "bucket", "symbol").agg(F.sum("n").alias("n"))
