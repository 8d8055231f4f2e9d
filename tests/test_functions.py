"""Column functions on hand-worked cases."""

import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from readloom import functions as X
from readloom.errors import OptionError
from readloom.operators import bytescan as B
from readloom.operators import runs as R
from readloom.operators import streams as S
from readloom.operators import tagstats as T
from readloom.options import DatasetType, FieldMask, Settings
from readloom.plans.huffman import lengths

R1 = [
    (0, 0, "SEQ1", "first test sequence", "ACGT" * 7, "I" * 28),
    (1, 0, "SEQ2", "second test sequence with longer comment", "GGCCTTAA" * 3, "H" * 24),
    (2, 0, "SEQ3", "", "AT" * 8, "D" * 16),
    (3, 0, "SEQ4", "quality varies", "AC" * 6, "ABCDEFGHIJKL"),
]
SCHEMA = "read_id long, block_id long, name string, comment string, sequence string, quality string"


@pytest.fixture(scope="module")
def r1(spark):
    return spark.createDataFrame(R1, SCHEMA).cache()


def one(spark, rows, schema, *cols):
    return [tuple(r) if len(cols) > 1 else r[0] for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


def test_offsets(spark):
    cases = [(33, 74, 33), (35, 73, 33), (64, 104, 64), (66, 105, 64), (59, 104, 59), (58, 104, 33), (40, 126, None), (32, 70, None), (32, 110, None)]
    assert one(spark, cases, "low int, high int, want int", S.infer_offset(F.col("low"), F.col("high"))) == [c[2] for c in cases]


def test_first_fixture(spark, r1):
    sizes = [r for r in S.stream_sizes(r1).collect() if r["block_id"] is None][0]
    assert (sizes["tag"], sizes["dna"], sizes["quality"]) == (96, 80, 80)
    assert {r["base"]: r["n"] for r in S.dna_histogram(r1).collect()} == {"A": 27, "T": 21, "C": 19, "G": 13}
    assert [r["quality_offset"] for r in S.phred_offset(r1).collect()] == [64]
    stats = S.length_stats(r1)
    s = stats.first()
    assert (s["records"], s["min_length"], s["max_length"], s["raw_length"], s["truncated_length"], s["rle_length"]) == (4, 12, 28, 80, 76, 15)
    assert S.quality_scheme(stats).first()["quality_scheme"] == "rle"
    assert S.dna_scheme(S.dna_histogram(r1)).first()["dna_scheme"] == "two_bits"
    found = [(r["q"] + 33, r["length"]) for r in R.quality_runs(r1).orderBy("run", "part").collect()]
    assert found == [(ord("I"), 28), (ord("H"), 24), (ord("D"), 16)] + [(c, 1) for c in b"ABCDEFGHIJKL"]
    tags = r1.select("read_id", "block_id", X.join_tag(F.col("name"), F.col("comment")).alias("tag"), "sequence", "quality")
    assert T.tag_format(tags).first()["tag_format"] == "raw"
    crc = S.stream_crc32(tags, ["tag", "sequence", "quality"]).first()
    assert [format(crc[f"crc32_{c}"], "x") for c in ("tag", "sequence", "quality")] == ["9f16f1b1", "14ff8abe", "e961b416"]
    lossy = [r[0] for r in r1.orderBy("read_id").select(X.lossy_quality(F.col("sequence"), F.col("quality"), 33)).collect()]
    assert lossy == ["I" * 28, "F" * 24, "F" * 16, "BBBFFFFFIIII"]
    lossy = [r[0] for r in r1.orderBy("read_id").select(X.lossy_quality(F.col("sequence"), F.col("quality"), 64)).collect()]
    assert lossy == ["F" * 28, "F" * 24, "F" * 16, "FFFFFFFFFOOO"]


def test_lossy_ambiguity(spark):
    s, q = F.col("s"), F.col("q")
    assert one(spark, [("ACGTNRAC", "!\"#$%+5I")], "s string, q string", X.lossy_sequence(s), X.lossy_quality(s, q)) == [("ACGTNNAC", "''''!!7I")]


def test_transfer(spark):
    cases = [("N", 0, 128), ("N", 6, 134), ("R", 2, 138), ("-", 6, 246), ("N", 7, 7), ("A", 0, 0)]
    i = X.symbol_index(F.col("b"))
    got = one(spark, cases, "b string, q int, want int", X.to_transferred(i, F.col("q")), X.from_transferred(X.to_transferred(i, F.col("q"))))
    assert [g[0] for g in got] == [c[2] for c in cases]
    for (b, q, symbol), (_, back) in zip(cases, got):
        assert back["q"] == q and (back["index"] is None or X.ALPHABET[back["index"]] == b)


def test_color_space(spark):
    assert one(spark, [("T0120.31",)], "s string", X.colors_to_bases(F.col("s")), X.is_color_space(F.col("s"))) == [("TTGAANTG", True)]
    assert one(spark, [("TTGAANTG",), ("",)], "s string", X.bases_to_colors(F.col("s"))) == ["T0120.31", ""]
    long = "ACGTN" * 400
    assert one(spark, [(long,)], "s string", X.colors_to_bases(X.bases_to_colors(F.col("s")))) == [long]


def test_tags(spark):
    tag = "@SRR1.17 HWI:3:1205/1"
    t = F.col("t")
    fields, seps = one(spark, [(tag,)], "t string", X.tag_fields(t), X.tag_separators(t))[0]
    assert fields == ["@SRR1", "17", "HWI", "3", "1205", "1"] and seps == [".", " ", ":", ":", "/"]
    masked = [X.mask_tag(t, FieldMask.of(*m)) for m in ([1, 2], [1, 4, 5], [1, 2, 3, 4, 5, 6], [2], [])]
    assert one(spark, [(tag,)], "t string", *masked)[0] == ("@SRR1.17 ", "@SRR1.3:1205/", tag, "@17 ", tag)
    rows = [("@r1",), ("@r1 a b",), ("r1 x",), ("@r1\tx",)]
    assert one(spark, rows, "t string", X.split_name(t), X.split_comment(t)) == [("r1", ""), ("r1", "a b"), ("r1", "x"), ("r1\tx", "")]
    assert one(spark, [("@a b",)], "t string", X.plus_line(t, True), X.plus_line(t, False)) == [("+a b", "+")]


def test_numbers(spark):
    rows = [("0",), ("12",), ("00",), ("007",), ("1a",), ("",)]
    assert one(spark, rows, "t string", X.is_number(F.col("t"))) == [True, True, False, False, False, False]
    xs = [(0,), (1,), (2,), (255,), (256,), (999,), (1000,)]
    assert one(spark, xs, "x long", X.bit_length(F.col("x"))) == [0, 1, 2, 8, 9, 10, 10]
    assert one(spark, xs[1:], "x long", X.int_log(F.col("x"), 10)) == [0, 0, 2, 2, 2, 3]
    assert one(spark, xs[:1], "x long", X.int_log(F.col("x"), 0), X.int_log(F.col("x"), 1)) == [(1, 2)]


def test_truncation(spark):
    rows = [("####",), ("II##",), ("",), ("#I",)]
    assert one(spark, rows, "q string", X.truncated_length(F.col("q"))) == [1, 2, 0, 2]


@pytest.mark.parametrize(("n", "stored"), [(255, [254]), (256, [254, 0]), (511, [254, 254, 0])])
def test_long_runs(spark, n, stored):
    rows = spark.createDataFrame([(0, i, "(" * k) for i, k in enumerate((100, 0, n - 100))], "block_id long, read_id long, quality string")
    found = R.quality_runs(rows)
    assert [r["length"] - 1 for r in found.orderBy("part").collect()] == stored
    back = R.expand_runs(found, "q", ["block_id"]).orderBy("at").collect()
    assert [r["at"] for r in back] == list(range(n))


@given(st.lists(st.tuples(st.integers(0, 2), st.text("#$I", max_size=5)), min_size=1, max_size=20), st.integers(1, 12))
@settings(max_examples=150, deadline=None)
def test_runs_over_slices(reads, size):
    """Runs go on over reads and over slices of any size, and stop at a block's end."""
    import itertools
    from unittest import mock

    import pyarrow as pa

    class Rows:  # what quality_runs() needs of a frame
        def select(self, *_):
            return self

        repartition = sortWithinPartitions = select

        def mapInArrow(self, scan, _):  # noqa: N802
            return scan

    reads = sorted(reads, key=lambda r: r[0])
    batch = pa.RecordBatch.from_arrays([pa.array([b for b, _ in reads], pa.int64()), pa.array([q for _, q in reads])], names=["block_id", "quality"])
    with mock.patch.object(B, "SLICE_BYTES", size):
        got = [tuple(r.values()) for out in B.quality_runs(Rows(), 33, 4)(iter([batch])) for r in out.to_pylist()]
    want = []
    for b, mine in itertools.groupby(reads, lambda r: r[0]):
        for i, (c, run) in enumerate(itertools.groupby("".join(q for _, q in mine))):
            n = len(list(run))
            want += [(b, i, p, ord(c) - 33, min(4, n - 4 * p)) for p in range(-(-n // 4))]
    assert got == want


@pytest.mark.parametrize("size", [1, 2, 7, 1000])
def test_runs_by_chunk(spark, size):
    rng = __import__("random").Random(size)
    rows = spark.createDataFrame([(i % 3 if i % 5 else 0, i, rng.choice(["a", "a", "b", None])) for i in range(200)], "u int, i long, v string")
    got = R.runs_by_chunk(rows, "v", ["u"], ["i"], F.floor(F.col("i") / size))
    assert sorted(map(str, got.select("u", "run", "part", "v", "length").collect())) == sorted(map(str, R.runs(rows, "v", ["u"], ["i"]).select("u", "run", "part", "v", "length").collect()))


def test_contexts_are_those_of_the_coder(spark):
    """The counts by context equal those that the codec's own contexts see."""
    from collections import Counter

    from readloom.codec.models import QualityContext

    rng = __import__("random").Random(1)
    rows = [(b, i, "".join(chr(33 + rng.randrange(16)) for _ in range(rng.choice([0, 1, 5, 30])))) for b in range(3) for i in range(8)]
    for k in (1, 2, 3, 4):
        got = B.model_counts(spark.createDataFrame(rows, "block_id long, read_id long, quality string"), "quality", 33, k, 8, True).collect()
        want = Counter()
        for b in range(3):
            context = QualityContext(16, k)
            for _, _, q in (r for r in rows if r[0] == b):
                for j, c in enumerate(q):
                    digits = ",".join(str(context.now >> 4 * i & 15) for i in range(k))
                    want[digits, j * 8 // len(q), ord(c) - 33] += 1
                    context.saw(ord(c) - 33)
        assert {(r["context"], r["bucket"], r["symbol"]): r["n"] for r in got} == want


def test_numeric_schemes(spark):
    def scheme(values):
        rows = spark.createDataFrame([(i, 0, 1, v) for i, v in enumerate(values)], "read_id long, block_id long, field_no int, value long")
        return tuple(T.numeric_scheme(rows).select("scheme", "huffman").first())

    assert scheme(range(100)) == ("delta_constant", False)
    assert scheme([0] * 40 + [5] * 40 + [9] * 40)[0] in ("value_runs", "delta_runs")
    assert scheme([(i * 7919) % 1009 for i in range(300)])[0] in ("value", "delta")


def test_validation(spark):
    rows = [("@a", "AC", "+", "II"), ("a", "AC", "+", "II"), ("@a", "AC", "+", "I"), ("@a", "AC", "", "II"), (None, "AC", "+", "II")]
    ok = X.valid_record(*[F.col(c) for c in ("t", "s", "p", "q")])
    assert one(spark, rows, "t string, s string, p string, q string", ok) == [True, False, False, False, False]


def test_dataset_type(spark):
    rows = [("@a", "ACGT", "+a", "IIII"), ("@b", "GGTA", "+b", "5555")]
    got = S.dataset_type(spark.createDataFrame(rows, "tag string, sequence string, plus string, quality string")).first()
    assert (got["records"], got["quality_offset"], got["plus_repetition"], got["color_space"], got["consistent"]) == (2, 33, True, False, True)


@pytest.mark.parametrize("bad", [{"dna_level": 4}, {"quality_level": 3}, {"buffer_mb": 0}, {"buffer_mb": 1025}, {"threads": 0}])
def test_option_bounds(bad):
    with pytest.raises(OptionError):
        Settings(**bad)


def test_more_options():
    with pytest.raises(OptionError):
        DatasetType(quality_offset=50)
    assert FieldMask.from_bits(FieldMask.of(1, 4).bits()) == FieldMask.of(1, 4)
    assert Settings(lossy=True, quality_level=2).quality_order == 6 and Settings(quality_level=2).quality_order == 2
    with pytest.raises(OptionError):
        FieldMask.of(63)
    assert FieldMask.of(62).bits() < 2**63
    assert Settings(lossy=True, mask=FieldMask.of(1)).checked_streams == ("sequence",)


@given(st.dictionaries(st.integers(0, 60), st.integers(1, 1000), min_size=2, max_size=30))
@settings(max_examples=50, deadline=None)
def test_huffman(counts):
    got = lengths(counts)
    assert sum(2.0**-n for n in got.values()) == 1
    # The least possible cost: the sum of all merges.
    import heapq

    heap, cost = list(counts.values()), 0
    heapq.heapify(heap)
    while len(heap) > 1:
        m = heapq.heappop(heap) + heapq.heappop(heap)
        cost += m
        heapq.heappush(heap, m)
    assert sum(counts[s] * n for s, n in got.items()) == cost


@given(st.binary(max_size=40), st.binary(max_size=70))
def test_crc_of_two_parts(a, b):
    assert B.crc32_combined(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_datasets_that_disagree(spark):
    def found(*rows):
        return tuple(S.dataset_type(spark.createDataFrame(rows, "sequence string, plus string, quality string")).first())

    assert found(("T01.", "+", "IIII"), ("T1", "+", "II")) == (2, 33, False, True, True)
    assert found(("T01.", "+", "IIII"), ("TA", "+", "II"))[4] is False and found(("0123", "+", "IIII"))[4] is False
    assert found(("AC", "+x", "II"), ("AC", "+", "II"))[4] is False and found(("AC", "+", "h~"))[1] is None
    assert found(("A", "+", "a"), ("AC", "+", "fg")) == (2, 64, False, False, True)


def test_crc_matches_zlib(spark):
    rows = spark.createDataFrame([(2, 0, "cc"), (1, 0, "b"), (5, 1, "x")], "read_id long, block_id long, s string")
    got = {r["block_id"]: r["crc32_s"] for r in S.stream_crc32(rows, ["s"]).collect()}
    assert got == {0: zlib.crc32(b"bcc"), 1: zlib.crc32(b"x")}
