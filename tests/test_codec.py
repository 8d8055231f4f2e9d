"""The binary block archive: streams of a block and the container."""

import io
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from readloom.codec.bits import BitReader, BitWriter
from readloom.codec.block import PLAIN, RUNS, TRUNCATED, Shape, decode_block, encode_block
from readloom.codec.ranges import Counts, RangeReader, RangeWriter
from readloom.codec.tagfields import Field
from readloom.codec.trees import Tree
from readloom.errors import FormatError
from readloom.sources.blockfile import footer, header, read_blocks, read_frame, stream_bytes, write_block_folder, write_blocks
from tests.test_functions import R1, SCHEMA

SHAPE = Shape(33)
READS = st.lists(st.tuples(st.text("abc:/ 1", max_size=8), st.text("ACGTNR-", min_size=1, max_size=20), st.integers(0, 2**32)), min_size=1, max_size=12)


def records(reads):
    out = []
    for tag, sequence, seed in reads:
        rng = random.Random(seed)
        out.append((b"@" + tag.encode(), sequence, "".join(rng.choice("#$I5!") for _ in sequence)))
    return out


@given(READS, st.sampled_from([None, PLAIN, TRUNCATED, RUNS]))
@settings(max_examples=120, deadline=None)
def test_block_round_trip(reads, scheme):
    rows = records(reads)
    assert decode_block(encode_block(rows, SHAPE, scheme), SHAPE) == rows


@pytest.mark.parametrize("quality", ["I" * 700, "#" * 40, "I" * 255, "I" * 256])
@pytest.mark.parametrize("scheme", [PLAIN, TRUNCATED, RUNS])
def test_one_symbol(quality, scheme):
    rows = [(b"@x", "A" * len(quality), quality)]
    assert decode_block(encode_block(rows, SHAPE, scheme), SHAPE) == rows


SHAPES = [Shape(33, crc32=True), Shape(33, dna_order=3), Shape(33, dna_order=9, quality_order=1, crc32=True), Shape(33, quality_order=2), Shape(33, quality_order=6)]


@given(READS, st.sampled_from(SHAPES))
@settings(max_examples=120, deadline=None)
def test_round_trip_of_orders(reads, shape):
    rows = [(t, s.replace("-", "N"), q) for t, s, q in records(reads)]
    assert decode_block(encode_block(rows, shape), shape) == rows


@given(READS, st.sampled_from([0, 1, 3, 6]))
@settings(max_examples=80, deadline=None)
def test_round_trip_with_loss(reads, order):
    shape = Shape(33, lossy=True, quality_order=order, crc32=True)
    rows = records(reads)
    got = decode_block(encode_block(rows, shape), shape)
    assert decode_block(encode_block(got, shape), shape) == got  # nothing more is lost
    for (t, s, q), (t2, s2, q2) in zip(rows, got):
        assert t == t2 and s2 == "".join(c if c in "ACGT" else "N" for c in s) and len(q) == len(q2)
        assert all((b == "N") == (c == "!") for b, c in zip(s2, q2))


COLORED = st.lists(st.tuples(st.text("ACGT", min_size=1, max_size=1), st.text("0123.", max_size=9), st.integers(0, 99)), min_size=1, max_size=6)


@given(COLORED, st.booleans())
@settings(max_examples=100, deadline=None)
def test_round_trip_of_colors(reads, one_primer):
    shape = Shape(33, color_space=True, crc32=True)
    rows = []
    for i, (first, rest, seed) in enumerate(reads):
        s = ("T" if one_primer else first) + rest
        rows.append((b"@r%d" % i, s, "I" + "".join(random.Random(seed).choice("!#5I") for _ in rest)))
    data = encode_block(rows, shape)
    assert decode_block(data, shape) == rows
    if one_primer and all(len(s) > 1 for _, s, _ in rows):
        assert int.from_bytes(data[8:12], "big") & 1


NUMBERS = st.one_of(st.lists(st.integers(0, 700), min_size=2, max_size=40), st.integers(1, 300).map(lambda k: list(range(5, 5 + k * 3, k))), st.integers(2, 700).map(lambda n: [7] * n + [9]), st.integers(3, 600).map(lambda n: [*range(n), n + 5]), st.lists(st.integers(0, 999_999_999), min_size=2, max_size=20))


@given(NUMBERS, st.integers(0, 99))
@settings(max_examples=150, deadline=None)
def test_tag_fields(numbers, seed):
    rng = random.Random(seed)
    rows = [(f"@S.{n}:{rng.choice(['ab', 'abc', 'x', '', '07'])}/1-{'y' * rng.choice([3, 3, 140])}".encode(), "ACGT", "IIII") for n in numbers]
    data = encode_block(rows, SHAPE)
    assert decode_block(data, SHAPE) == rows and not int.from_bytes(data[8:12], "big") & 4
    by_field = Field([b"%d" % n for n in numbers]).numbers
    assert by_field is None or by_field.scheme in range(1, 6)


@pytest.mark.parametrize(("numbers", "scheme"), [(range(100), 5), (([0] * 40 + [9] * 40) * 3, 2), ([(i * 7919) % 1009 for i in range(300)], 1), ([i * i for i in range(300)], 3), ([i // 30 * 10 + i % 30 for i in range(300)], 4)])
def test_numeric_schemes(numbers, scheme):
    assert Field([b"%d" % n for n in numbers]).numbers.scheme == scheme


def test_damage_is_found():
    rows = [(b"@a.%d" % i, "ACGTACGT", "IIIIIIII") for i in range(20)]
    data = bytearray(encode_block(rows, Shape(33, crc32=True)))
    data[-1] ^= 0xFF
    with pytest.raises(FormatError, match="checksums"):
        decode_block(bytes(data), Shape(33, crc32=True))


@given(st.lists(st.integers(0, 7), max_size=3000), st.integers(2, 8))
@settings(max_examples=40, deadline=None)
def test_range_coder(symbols, n):
    out, model = RangeWriter(), Counts(n)
    for s in symbols:
        model.write(out, s % n)
    data, model = out.bytes(), Counts(n)
    source = RangeReader(data, 0)
    assert [model.read(source) for _ in symbols] == [s % n for s in symbols] and source.at == len(data)


def test_counts_are_halved():
    out, model = RangeWriter(), Counts(4)
    symbols = [0] * 40_000 + [3] * 10
    for s in symbols:
        model.write(out, s)
    source, model = RangeReader(out.bytes(), 0), Counts(4)
    assert [model.read(source) for _ in symbols] == symbols and len(out.bytes()) < 300


@given(st.lists(st.integers(0, 500), min_size=1, max_size=40))
@settings(max_examples=80, deadline=None)
def test_trees(counts):
    tree, out = Tree.of(counts), BitWriter()
    tree.store(out)
    back = Tree.load(BitReader(out.bytes()))
    assert back.codes == tree.codes and back.root_id == tree.root_id
    assert abs(sum(2.0 ** -len(c) for c in tree.codes.values()) - 1) < 1e-9


def test_bits():
    out = BitWriter()
    out.bits(5, 3)
    out.number(0x01020304)
    out.bits(1, 1)
    data = out.bytes()
    assert data == bytes([0b10100000, 1, 2, 3, 4, 0b10000000])
    source = BitReader(data)
    assert (source.bits(3), source.number(), source.bits(1)) == (5, 0x01020304, 1)
    with pytest.raises(FormatError):
        source.bits(8)


def test_container_errors():
    end = footer([10], SHAPE)
    good = header(len(end), 50, 1) + b"x" * 10 + end
    assert read_frame(io.BytesIO(good), len(good))[0] == [(40, 10)]
    bad = {
        "empty": b"",
        "version": good[:1] + b"\x01" + good[2:],
        "past the end": header(len(end), 500, 1) + good[40:],
        "mark": good[:50] + b"\x00" + good[51:],
        "count": header(len(end), 50, 0) + good[40:],
    }
    for data in bad.values():
        with pytest.raises(FormatError):
            read_frame(io.BytesIO(data), len(data))


def test_file_round_trip(spark, tmp_path):
    path = str(tmp_path / "reads.blocks")
    assert write_blocks(spark.createDataFrame(R1, SCHEMA), path, block_bytes=100) >= 1
    rows = read_blocks(spark, path).orderBy("block_id", "local_id").collect()
    assert [(r["name"], r["comment"], r["sequence"], r["quality"]) for r in rows] == [r[2:] for r in R1]
    assert spark.read.format("fqblocks").load(path).count() == 4


def test_folder_of_archives(spark, tmp_path):
    path = str(tmp_path / "reads.folder")
    reads = spark.createDataFrame(R1, SCHEMA)
    write_block_folder(reads, path, Shape(33, crc32=True, dna_order=3, quality_order=1))
    rows = read_blocks(spark, path).orderBy("block_id", "local_id").collect()
    assert [(r["name"], r["comment"], r["sequence"], r["quality"]) for r in rows] == [r[2:] for r in R1]
    assert all(stream_bytes(path).values())
    spark.createDataFrame(R1, SCHEMA).drop("read_id", "block_id").write.format("fqblocks").mode("append").option("crc32", "true").save(path)
    assert read_blocks(spark, path).count() == 8
    write_block_folder(reads.where("false"), path)
    assert read_blocks(spark, path).count() == 0
    with pytest.raises(Exception, match="orders are"):
        spark.createDataFrame(R1, SCHEMA).write.format("fqblocks").mode("append").option("dnaOrder", "10").save(path)
