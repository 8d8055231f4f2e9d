"""FASTQ and FASTA text as a Python data source, split by byte ranges; FASTQ as a sink of Spark's text writer.

Options of the format `fastq`: path (a file or folder, any URI that pyarrow opens), mode (PERMISSIVE, DROPMALFORMED or
FAILFAST), splitBytes. Gzip is told by its first two bytes, whatever the name, and can't be split. A file is FASTA if its first
byte that ends no line is '>', else FASTQ. Lines end in LF, CR or CRLF, and the last needs no end. A record that isn't valid is,
by mode, a row with its text in `corrupt`, dropped, or an error; corrupt text comes in rows of about `CORRUPT_BYTES` at most.

A FASTQ record is four lines: '@' and more, the bases, '+' or '+' and more, as many qualities as bases. A split has the records
from the first valid one that begins in it to the first that begins in a later split; text between records that is none belongs
to the split before. So each byte is read as part of one row, as long as no line of bases begins with '@' or '+'.

block_id numbers the splits in file order and local_id, gapless from 0, the rows in one, so (block_id, local_id) is the order of
the input; with_read_ids() makes one number of them.
"""

from __future__ import annotations

import gzip
import io
import math
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from readloom.errors import FormatError, OptionError
from readloom.functions.tags import join_tag, plus_line
from readloom.plans.names import free_name

SCHEMA = "block_id bigint, local_id bigint, name string, comment string, sequence string, quality string, plus string, corrupt string"
MODES = ("PERMISSIVE", "DROPMALFORMED", "FAILFAST")
SPLIT_BYTES, BATCH_ROWS, READ_BYTES, CHUNK_BYTES, CORRUPT_BYTES = 64 << 20, 8192, 1 << 20, 4 << 20, 1 << 16
#: Splits up to this number have their places in the whole sent to all executors.
MOST_SENT = 1 << 20
#: A partition of an ordered sink has about so many reads at most.
READS_PER_PART = 1 << 20


def _open(uri: str):
    from pyarrow import fs

    where, path = fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)
    return where, path


def _files(uri: str) -> list[tuple[str, int]]:
    from pyarrow import fs

    where, path = _open(uri)
    info = where.get_file_info(path)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(uri)
    found = [info] if info.type == fs.FileType.File else where.get_file_info(fs.FileSelector(path, recursive=True))
    return sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", ".")))


class Split(InputPartition):
    def __init__(self, block_id: int, path: str, start: int, end: int, packed: bool, fasta: bool):
        super().__init__(block_id)
        self.block_id, self.path, self.start, self.end, self.packed, self.fasta = block_id, path, start, end, packed, fasta


class Tape:
    """A stream of which the last bytes read can be given back."""

    def __init__(self, stream):
        self.stream, self.held = stream, b""

    def read(self, n: int) -> bytes:
        out, self.held = self.held[:n], self.held[n:]
        return out + self.stream.read(n - len(out)) if len(out) < n else out

    def unread(self, data: bytes) -> None:
        self.held = data + self.held


def lines(stream, at: int) -> Iterator[tuple[int, bytes]]:
    """(offset, line without its end) from the offset on."""
    held, pending_cr = b"", False
    while chunk := stream.read(READ_BYTES):
        if pending_cr and chunk.startswith(b"\n"):
            chunk, at = chunk[1:], at + 1
            if not chunk:
                pending_cr = False
                continue
        pending_cr = chunk.endswith(b"\r")
        whole = (held + chunk).splitlines(keepends=True)
        held = b"" if whole[-1].endswith((b"\n", b"\r")) else whole.pop()
        for line in whole:
            yield at, line.rstrip(b"\r\n")
            at += len(line)
    if held:
        yield at, held


class Ahead:
    """Lines with a look ahead."""

    def __init__(self, stream, at: int, fasta: bool):
        self.source, self.ahead, self.fasta = lines(stream, at), [], fasta

    def peek(self, i: int = 0) -> tuple[int, bytes] | None:
        while len(self.ahead) <= i:
            found = next(self.source, None)
            if found is None:
                return None
            self.ahead.append(found)
        return self.ahead[i]

    def take(self, n: int = 1) -> list[bytes]:
        out = [line for _, line in self.ahead[:n]]
        del self.ahead[:n]
        return out

    def begins(self) -> bool:
        """Whether a valid record begins here."""
        first = self.peek()
        if first is None or self.fasta:
            return first is not None and first[1][:1] == b">"
        if len(first[1]) < 2 or first[1][:1] != b"@" or self.peek(3) is None:
            return False
        (_, bases), (_, plus), (_, quality) = self.ahead[1:4]
        return plus[:1] == b"+" and len(bases) == len(quality)


def first_record(stream, start: int, end: int, fasta: bool = False) -> int | None:
    """Where the first valid record of the split start:end begins. stream stands on the byte before the split, so that a line
    which begins with the split is told from one that goes on into it."""
    ahead = Ahead(stream, start - 1, fasta)
    if ahead.peek() is not None:
        ahead.take()
    while (now := ahead.peek()) and now[0] < end:
        if ahead.begins():
            return now[0]
        ahead.take()
    return None


def records(stream, start: int, end: int, fasta: bool = False) -> Iterator[tuple[list[bytes], bool]]:
    """(lines, valid) from start, where the file or a record begins, to the first record at end or after it."""
    ahead = Ahead(stream, start, fasta)
    bad, size = [], 0
    while now := ahead.peek():
        good = ahead.begins()
        if good and now[0] >= end:
            break
        if bad and (good or size >= CORRUPT_BYTES):
            yield bad, False
            bad, size = [], 0
        if good and fasta:
            name, body = ahead.take()[0], []
            while (more := ahead.peek()) and more[1][:1] != b">":
                body += ahead.take()
            yield [name, b"".join(body)], True
        elif good:
            yield ahead.take(4), True
        else:
            for line in ahead.take():  # one longer line is cut
                bad += [line[i : i + CORRUPT_BYTES] for i in range(0, len(line), CORRUPT_BYTES)][:1] if line else []
                if len(line) > CORRUPT_BYTES:
                    yield bad, False
                    yield from (([line[i : i + CORRUPT_BYTES]], False) for i in range(CORRUPT_BYTES, len(line), CORRUPT_BYTES))
                    bad, size = [], -len(line) - 1
                size += len(line) + 1
    if bad:
        yield bad, False


def plain_records(chunk: bytes) -> tuple[int, list[pa.Array]] | None:
    """(bytes used, columns from name to plus) of the whole records in a chunk; None unless it is plain valid FASTQ in ASCII."""
    if b"\r" in chunk or not chunk.isascii():
        return None
    flat = pc.list_flatten(pc.split_pattern(pa.array([chunk.decode("ascii")], pa.large_string()), "\n"))
    n = (len(flat) - 1) // 4  # what follows the last line end is no whole line
    if not n:
        return None
    head, bases, plus, quality = (flat.take(pa.array(range(i, 4 * n, 4))) for i in range(4))
    good = pc.and_(pc.and_(pc.starts_with(head, "@"), pc.greater(pc.binary_length(head), 1)), pc.and_(pc.starts_with(plus, "+"), pc.equal(pc.binary_length(bases), pc.binary_length(quality))))
    if not pc.all(good).as_py():
        return None
    tag = pc.extract_regex(head, "^@(?P<name>[^ ]*) ?(?P<comment>.*)$")
    used = pc.sum(pc.binary_length(flat.slice(0, 4 * n))).as_py() + 4 * n
    return used, [x.cast(pa.string()) for x in (tag.field("name"), tag.field("comment"), bases, quality, plus)]


class FastqReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.mode = options.get("path"), options.get("mode", "PERMISSIVE").upper()
        self.split_bytes = int(options.get("splitbytes", options.get("splitBytes", SPLIT_BYTES)))
        if not self.path:
            raise OptionError("a path is needed")
        if self.mode not in MODES:
            raise OptionError(f"mode must be one of {MODES}, not {self.mode}")
        if self.split_bytes < 1:
            raise OptionError("splitBytes must be positive")

    def partitions(self) -> list[Split]:
        out: list[Split] = []
        where, _ = _open(self.path)
        for path, size in _files(self.path):
            with where.open_input_file(path) as f:
                packed = f.read(2) == b"\x1f\x8b"
                f.seek(0)
                stream = gzip.open(io.BufferedReader(f)) if packed else f
                first = b"\n"
                while first and first in b"\r\n":
                    first = stream.read(1)
            n = 1 if packed or not size else math.ceil(size / self.split_bytes)
            out += [Split(len(out) + i, path, i * self.split_bytes, size if packed else min(size, (i + 1) * self.split_bytes), packed, first == b">") for i in range(n)]
        return out or [Split(0, "", 0, 0, False, False)]

    def read(self, part: Split) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        where, _ = _open(self.path)
        with where.open_input_file(part.path) as f:
            if part.packed:
                yield from self._batches(part, gzip.open(io.BufferedReader(f)), 0, 1 << 62)
                return
            at = 0
            if part.start:
                f.seek(part.start - 1)
                at = first_record(f, part.start, part.end, part.fasta)
            if at is not None:
                f.seek(at)
                yield from self._batches(part, f, at, part.end)

    def _batches(self, part: Split, stream, at: int, end: int) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        kinds = [pa.int64(), pa.int64()] + [pa.string()] * 6
        done, tape = 0, Tape(stream)

        def numbers(n: int) -> list[pa.Array]:
            return [pa.array([part.block_id] * n, pa.int64()), pa.array(range(done, done + n), pa.int64())]

        while not part.fasta:  # whole chunks at once as long as they are plain
            chunk = tape.read(min(CHUNK_BYTES, end - at))
            found = plain_records(chunk)
            if found is None:
                tape.unread(chunk)
                break
            used, columns = found
            n = len(columns[0])
            yield pa.RecordBatch.from_arrays([*numbers(n), *columns, pa.nulls(n, pa.string())], names=names)
            tape.unread(chunk[used:])
            at, done = at + used, done + n
        for body, valid in records(tape, at, end, part.fasta):
            text = [x.decode("latin-1") for x in body]
            if valid:
                name, _, comment = text[0][1:].partition(" ")
                plus, quality = (text[2], text[3]) if len(text) == 4 else ("", "")
                rows.append((name, comment, text[1], quality, plus, None))
            elif self.mode == "FAILFAST":
                raise FormatError(f"{part.path}: after record {done + len(rows)} of split {part.block_id} text isn't valid: {text[0][:80]!r}")
            elif self.mode == "PERMISSIVE":
                rows.append((None, None, None, None, None, "\n".join(text)))
            if len(rows) >= BATCH_ROWS:
                yield pa.RecordBatch.from_arrays(numbers(len(rows)) + [pa.array(c, k) for c, k in zip(zip(*rows), kinds[2:])], names=names)
                done, rows = done + len(rows), []
        if rows:
            yield pa.RecordBatch.from_arrays(numbers(len(rows)) + [pa.array(c, k) for c, k in zip(zip(*rows), kinds[2:])], names=names)


class FastqSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fastq"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FastqReader:
        return FastqReader(dict(self.options))


def read_fastq(spark: SparkSession, path: str, mode: str = "PERMISSIVE", split_bytes: int = SPLIT_BYTES) -> DataFrame:
    spark.dataSource.register(FastqSource)
    return spark.read.format("fastq").option("mode", mode).option("splitBytes", split_bytes).load(path)


def with_read_ids(rows: DataFrame) -> DataFrame:
    """rows with read_id: the 0-based place of each in the order of (block_id, local_id); rows that were left out keep theirs.

    One pass finds the last place in each block; what comes before each block is then sent to all executors.
    """
    count, base = free_name(rows, "count"), free_name(rows, "base")
    counts = rows.groupBy("block_id").agg((F.max("local_id") + 1).alias(count))
    found = counts.limit(MOST_SENT + 1).collect()
    if len(found) <= MOST_SENT:  # a row for each split
        before, places = 0, []
        for block, n in sorted((r["block_id"], r[count]) for r in found):
            places.append((block, before))
            before += n
        bases = F.broadcast(rows.sparkSession.createDataFrame(places, f"block_id bigint, {base} bigint"))
    else:
        so_far = W.Window.orderBy("block_id").rowsBetween(W.Window.unboundedPreceding, -1)
        bases = counts.select("block_id", F.coalesce(F.sum(count).over(so_far), F.lit(0)).alias(base))
    return rows.join(bases, "block_id").withColumn("read_id", (F.col(base) + F.col("local_id")).cast("bigint")).drop(base)


def in_order(rows: DataFrame, key: str = "read_id") -> DataFrame:
    """rows in ascending order of key inside and across partitions.

    Where the keys are close to gapless, ranges of equal width are as even as any, and no sample of the rows has to be made.
    """
    low, high, n = rows.agg(F.min(key), F.max(key), F.count("*")).first()
    if not n or high - low >= 2 * n:
        return rows.repartitionByRange(key).sortWithinPartitions(key)
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(n / READS_PER_PART))
    width = math.ceil((high - low + 1) / parts)
    return rows.repartitionById(parts, F.expr(f"int((`{key}` - {low}L) div {width}L)")).sortWithinPartitions(key)


def fastq_text(reads: DataFrame, plus_repetition: bool = False) -> DataFrame:
    """One column `value`: the four lines of each read, in the order of read_id inside and across partitions."""
    tag = join_tag(F.col("name"), F.coalesce("comment", F.lit("")))
    four = F.concat_ws("\n", tag, F.col("sequence"), plus_line(tag, plus_repetition), F.col("quality"))
    return in_order(reads).select(four.alias("value"))


def write_fastq(reads: DataFrame, path: str, mode: str = "errorifexists", plus_repetition: bool = False, compression: str = "none") -> None:
    """A folder of FASTQ text files whose names sort in the order of the reads."""
    fastq_text(reads, plus_repetition).write.mode(mode).option("compression", compression).text(path)
