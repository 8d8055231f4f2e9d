"""The binary block archive: header, blocks, footer. A block is a partition of the reader.

The format `fqblocks` reads an archive or a folder of archives, in the order of their names, and writes a folder: each task
writes an archive of its own rows, and the commit lists the files, so no byte of a read goes through the driver and what a lost
task has left is never read. Options of the writer: offset, lossy, crc32, dnaOrder, qualityOrder, mask, colorSpace,
plusRepetition, blockBytes. write_blocks() makes one archive of such a folder.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from readloom.codec.block import Shape, decode_block, encode_streams
from readloom.errors import FormatError, OptionError
from readloom.functions.tags import join_tag
from readloom.options import DatasetType, Settings
from readloom.sources.fastq import _open, in_order

#: The container's marks, version and sizes.
HEADER_MARK, FOOTER_MARK, VERSION, HEADER_BYTES = 0xAA, 0xCC, (2, 0, 2), 40
HEADER, SETTINGS = ">BBBBIQQQ8s", ">BBBBBQ"
PLUS_REPETITION, COLOR_SPACE, LOSSY, CRC32 = 1, 2, 1, 2
SCHEMA = "block_id bigint, local_id bigint, name string, comment string, sequence string, quality string"
BLOCK_BYTES, BATCH_ROWS, LISTED = 8 << 20, 8192, "_parts.json"
WRITTEN = "name string, comment string, sequence string, quality string"


def footer(sizes: list[int], shape: Shape) -> bytes:
    dataset = PLUS_REPETITION * shape.plus_repetition | COLOR_SPACE * shape.color_space
    stored = LOSSY * shape.lossy | CRC32 * shape.crc32
    # The sizes are in the byte order of the machine that wrote them; all else has the highest byte first.
    return bytes([FOOTER_MARK]) + struct.pack(f"<{len(sizes)}I", *sizes) + struct.pack(SETTINGS, dataset, shape.offset, stored, shape.dna_order, shape.quality_order, shape.mask)


def header(footer_size: int, footer_at: int, blocks: int) -> bytes:
    return struct.pack(HEADER, HEADER_MARK, *VERSION, footer_size, footer_at, 0, blocks, bytes([HEADER_MARK]) * 8)


def read_frame(f, size: int) -> tuple[list[tuple[int, int]], Shape]:
    """((offset, size) of each block, shape) of an open archive of this many bytes."""
    if not size:
        raise FormatError("the archive is empty")
    if size < HEADER_BYTES:
        raise FormatError("the archive is shorter than its header")
    f.seek(0)
    mark, major, minor, _, footer_size, footer_at, _, blocks, _ = struct.unpack(HEADER, f.read(HEADER_BYTES))
    if mark != HEADER_MARK or (major, minor) != VERSION[:2]:
        raise FormatError(f"not an archive of version {VERSION[0]}.{VERSION[1]}")
    if footer_at + footer_size > size or footer_size != 1 + 4 * blocks + struct.calcsize(SETTINGS):
        raise FormatError("the footer isn't where the header says")
    f.seek(footer_at)
    data = f.read(footer_size)
    if data[0] != FOOTER_MARK:
        raise FormatError("the footer doesn't begin with its mark")
    sizes = struct.unpack(f"<{blocks}I", data[1 : 1 + 4 * blocks])
    dataset, offset, stored, dna, quality, mask = struct.unpack(SETTINGS, data[1 + 4 * blocks :])
    if HEADER_BYTES + sum(sizes) > footer_at:
        raise FormatError("the blocks reach into the footer")
    at, places = HEADER_BYTES, []
    for n in sizes:
        places.append((at, n))
        at += n
    return places, Shape(offset, bool(stored & LOSSY), bool(stored & CRC32), dna, quality, mask, bool(dataset & COLOR_SPACE), bool(dataset & PLUS_REPETITION))


def shape_of(dataset: DatasetType, settings: Settings) -> Shape:
    return Shape(dataset.quality_offset, settings.lossy, settings.crc32, settings.dna_order, settings.quality_order, settings.mask.bits(), dataset.color_space, dataset.plus_repetition)


def _archives(path: str) -> list[str]:
    """The archives at a path that is one, or a folder that lists them."""
    from pyarrow import fs

    where, root = _open(path)
    kind = where.get_file_info(root).type
    if kind == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if kind == fs.FileType.File:
        return [root]
    with where.open_input_stream(f"{root}/{LISTED}") as f:
        return [f"{root}/{x['file']}" for x in json.loads(f.read())]


class Block(InputPartition):
    def __init__(self, block_id: int, path: str, at: int, size: int, shape: Shape):
        super().__init__(block_id)
        self.block_id, self.path, self.at, self.size, self.shape = block_id, path, at, size, shape


class BlockReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options.get("path")
        if not self.path:
            raise OptionError("a path is needed")

    def partitions(self) -> list[Block]:
        where, _ = _open(self.path)
        out: list[Block] = []
        for path in _archives(self.path):
            with where.open_input_file(path) as f:
                places, shape = read_frame(f, f.size())
            out += [Block(len(out) + i, path, at, n, shape) for i, (at, n) in enumerate(places)]
        return out or [Block(0, "", 0, 0, Shape())]

    def read(self, part: Block) -> Iterator[pa.RecordBatch]:
        if not part.size:
            return
        where, _ = _open(self.path)
        with where.open_input_file(part.path) as f:
            f.seek(part.at)
            records = decode_block(f.read(part.size), part.shape)
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        kinds = [pa.int64(), pa.int64()] + [pa.string()] * 4
        for i in range(0, len(records), BATCH_ROWS):
            rows = []
            for j, (tag, sequence, quality) in enumerate(records[i : i + BATCH_ROWS], i):
                name, _, comment = tag.decode("latin-1").removeprefix("@").partition(" ")
                rows.append((part.block_id, j, name, comment, sequence, quality))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


@dataclass
class Written(WriterCommitMessage):
    part: int
    file: str
    blocks: int
    streams: dict[str, int]


def _flag(options: dict, name: str) -> bool:
    return str(options.get(name, options.get(name.lower(), "false"))).lower() == "true"


class BlockWriter(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool):
        number = lambda name, default: int(options.get(name, options.get(name.lower(), default)))
        self.path, self.overwrite = options.get("path"), overwrite
        if not self.path:
            raise OptionError("a path is needed")
        dataset = DatasetType(number("offset", 33), _flag(options, "plusRepetition"), _flag(options, "colorSpace"))
        self.block_bytes = number("blockBytes", BLOCK_BYTES)
        self.shape = replace(shape_of(dataset, Settings(lossy=_flag(options, "lossy"), crc32=_flag(options, "crc32"))), dna_order=number("dnaOrder", 0), quality_order=number("qualityOrder", 0), mask=number("mask", 0))
        if not 0 <= self.shape.dna_order <= 9 or not 0 <= self.shape.quality_order <= 9:
            raise OptionError("orders are 0 to 9")

    def write(self, rows) -> Written:
        where, root = _open(self.path)
        where.create_dir(root, recursive=True)
        part = TaskContext.get().partitionId()
        name, sizes, streams = f"part-{part:06d}-{uuid.uuid4().hex}.blocks", [], {}
        with where.open_output_stream(f"{root}/{name}.body") as body:
            for block in self._blocks(rows):
                data, own = encode_streams(block, self.shape)
                body.write(data)
                sizes.append(len(data))
                streams = {k: n + streams.get(k, 0) for k, n in own.items()}
        end = footer(sizes, self.shape)
        with where.open_output_stream(f"{root}/{name}") as out, where.open_input_stream(f"{root}/{name}.body") as body:
            out.write(header(len(end), HEADER_BYTES + sum(sizes), len(sizes)))
            while chunk := body.read(1 << 20):
                out.write(chunk)
            out.write(end)
        where.delete_file(f"{root}/{name}.body")
        return Written(part, name, len(sizes), streams)

    def _blocks(self, rows) -> Iterator[list[tuple[bytes, str, str]]]:
        held, size = [], 0
        for r in rows:
            tag = ("@" + r["name"] + (" " + r["comment"] if r["comment"] else "")).encode("latin-1")
            held.append((tag, r["sequence"], r["quality"]))
            size += len(tag) + len(r["sequence"]) + len(r["quality"]) + 5
            if size > self.block_bytes:
                yield held
                held, size = [], 0
        if held:
            yield held

    def commit(self, messages) -> None:
        from pyarrow import fs

        where, root = _open(self.path)
        where.create_dir(root, recursive=True)
        listed = []
        if not self.overwrite and where.get_file_info(f"{root}/{LISTED}").type == fs.FileType.File:
            with where.open_input_stream(f"{root}/{LISTED}") as f:
                listed = json.loads(f.read())
        listed += [{"file": m.file, "blocks": m.blocks, **m.streams} for m in sorted((m for m in messages if m and m.blocks), key=lambda m: m.part)]
        with where.open_output_stream(f"{root}/{LISTED}") as f:
            f.write(json.dumps(listed).encode())

    def abort(self, messages) -> None:
        """Files that no commit lists are never read."""


class BlockSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fqblocks"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BlockReader:
        return BlockReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> BlockWriter:
        return BlockWriter(dict(self.options), overwrite)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(BlockSource)
    return spark.read.format("fqblocks").load(path)


def write_block_folder(reads: DataFrame, path: str, shape: Shape = Shape(), block_bytes: int = BLOCK_BYTES) -> None:
    """A folder of archives with reads (read_id, name, comment, sequence, quality) in the order of read_id."""
    reads.sparkSession.dataSource.register(BlockSource)
    rows = in_order(reads).select("name", F.coalesce("comment", F.lit("")).alias("comment"), "sequence", "quality")
    options = {"offset": shape.offset, "lossy": shape.lossy, "crc32": shape.crc32, "dnaOrder": shape.dna_order, "qualityOrder": shape.quality_order, "mask": shape.mask, "colorSpace": shape.color_space, "plusRepetition": shape.plus_repetition, "blockBytes": block_bytes}
    rows.write.format("fqblocks").mode("overwrite").options(**{k: str(v).lower() if isinstance(v, bool) else v for k, v in options.items()}).save(path)


def stream_bytes(path: str) -> dict[str, int]:
    """The compressed bytes of each stream of a folder of archives, all blocks together."""
    where, root = _open(path)
    with where.open_input_stream(f"{root}/{LISTED}") as f:
        listed = json.loads(f.read())
    return {k: sum(x[k] for x in listed) for k in ("meta", "tag", "quality", "dna")}


def write_blocks(reads: DataFrame, path: str, shape: Shape = Shape(), block_bytes: int = BLOCK_BYTES) -> int:
    """One archive of reads in the order of read_id; how many blocks. Tasks encode it as a folder, of which the driver copies the blocks."""
    where, target = _open(path)
    folder = f"{path}.parts"
    write_block_folder(reads, folder, shape, block_bytes)
    frames = []
    for part in _archives(folder):
        with where.open_input_file(part) as f:
            frames.append((part, [n for _, n in read_frame(f, f.size())[0]]))
    sizes = [n for _, own in frames for n in own]
    end = footer(sizes, shape)
    with where.open_output_stream(target) as out:
        out.write(header(len(end), HEADER_BYTES + sum(sizes), len(sizes)))
        for part, own in frames:
            with where.open_input_file(part) as f:
                f.seek(HEADER_BYTES)
                left = sum(own)
                while left:
                    chunk = f.read(min(left, 1 << 20))
                    out.write(chunk)
                    left -= len(chunk)
        out.write(end)
    where.delete_dir(_open(folder)[1])
    return len(sizes)
