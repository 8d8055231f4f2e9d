"""FASTQ text and archives."""

import gzip
import io

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from readloom.cli import to_archive, to_fastq
from readloom.errors import FormatError, OptionError
from readloom.options import DatasetType, FieldMask, Settings
from readloom.sources import archive_to_fastq, fastq_to_archive, read_archive, read_fastq, verify_archive, with_read_ids, write_archive, write_fastq
from readloom.sources.fastq import first_record, records
from tests.test_functions import R1, SCHEMA

TEXT = "".join(f"@{n}{' ' + c if c else ''}\n{s}\n+\n{q}\n" for _, _, n, c, s, q in R1)
FIELDS = ("name", "comment", "sequence", "quality")


def rows_of(df):
    return [tuple(r[c] for c in FIELDS) for r in with_read_ids(df).orderBy("read_id").collect()]


WANT = [r[2:] for r in R1]


@pytest.mark.parametrize("kind", ["plain", "crlf", "cr", "no_end", "gzip"])
def test_input_kinds(spark, tmp_path, kind):
    body = {"crlf": TEXT.replace("\n", "\r\n"), "cr": TEXT.replace("\n", "\r"), "no_end": TEXT[:-1]}.get(kind, TEXT).encode()
    path = tmp_path / "reads.txt"
    path.write_bytes(gzip.compress(body) if kind == "gzip" else body)
    assert rows_of(read_fastq(spark, str(path))) == WANT


@pytest.mark.parametrize("size", [1, 7, 50, 100])
def test_splits(spark, tmp_path, size):
    path = tmp_path / "reads.fastq"
    path.write_text(TEXT)
    assert rows_of(read_fastq(spark, str(path), split_bytes=size)) == WANT


SYMBOLS = st.characters(min_codepoint=33, max_codepoint=126)


def of_splits(body: bytes, size: int) -> list:
    out = []
    for a in range(0, len(body), size):
        stream, at = io.BytesIO(body), 0
        if a:
            stream.seek(a - 1)
            at = first_record(stream, a, min(len(body), a + size))
        if at is not None:
            stream.seek(at)
            out += list(records(stream, at, min(len(body), a + size)))
    return out


@given(st.lists(st.tuples(st.text("ACGTN", max_size=6), st.text(SYMBOLS, min_size=6, max_size=6), st.sampled_from("@>+I")), min_size=1, max_size=8), st.sampled_from(["\n", "\r\n"]), st.booleans())
@settings(max_examples=60, deadline=None)
def test_any_split_gives_each_record_once(reads, end, last_end):
    """Whatever symbol a quality begins with, and for every split size."""
    want = [[f"@r{i}".encode(), s.encode(), b"+", (first + q)[: len(s)].encode()] for i, (s, q, first) in enumerate(reads)]
    body = b"".join(line + end.encode() for record in want for line in record)
    body = body if last_end or not want[-1][3] else body[: -len(end)]
    for size in range(1, len(body) + 1):
        assert of_splits(body, size) == [(r, True) for r in want], size


@given(st.lists(st.sampled_from(["@a\nAC\n+\nII\n", "@b\nACG\n+\n@II\n", "noise\n", "@x\nAC\n", "-\n", "@c\nA\n+\nII\n"]), max_size=9), st.integers(1, 40))
@settings(max_examples=150, deadline=None)
def test_splits_of_damaged_text_lose_nothing(parts, size):
    """Valid records are the same for every split size, and all other lines are in corrupt rows, once."""
    body = "".join(parts).encode()

    def flat(rows):
        return [r for r, ok in rows if ok], [line for r, ok in rows if not ok for line in r]

    whole = list(records(io.BytesIO(body), 0, len(body)))
    assert sum(len(x) + 1 for r, _ in whole for x in r) == len(body)
    assert flat(of_splits(body, size)) == flat(whole)


def test_every_first_symbol(spark, tmp_path):
    """Through Spark, with chunks read at once and line by line."""
    rows = [(f"r{c}", "x y" if c % 2 else "", "ACGTA", chr(c) + "".join(chr(33 + (c * k) % 94) for k in range(1, 5))) for c in range(33, 127)]
    path = tmp_path / "all.fastq"
    path.write_text("".join(f"@{n}{' ' + c if c else ''}\n{s}\n+\n{q}\n" for n, c, s, q in rows))
    for size in (7, 33, 64, 1000, 1 << 20):
        assert rows_of(read_fastq(spark, str(path), "FAILFAST", size)) == rows, size


def test_text_that_is_no_fastq_comes_in_bounded_rows(spark, tmp_path):
    (tmp_path / "x.fastq").write_text("z" * 200_000 + "\n" + "noise\n" * 50_000)
    rows = read_fastq(spark, str(tmp_path / "x.fastq"), split_bytes=100_000).collect()
    assert sum(len(r["corrupt"].replace("\n", "")) for r in rows) == 450_000 and max(len(r["corrupt"]) for r in rows) < 200_000
    assert sorted(r["local_id"] for r in rows if r["block_id"] == 0) == list(range(sum(r["block_id"] == 0 for r in rows)))


def test_names_of_the_input_stay(spark, tmp_path):
    (tmp_path / "x.fastq").write_text(TEXT)
    rows = read_fastq(spark, str(tmp_path / "x.fastq"), split_bytes=50).selectExpr("*", "1 as base", "2 as count", "3 as _n")
    got = with_read_ids(rows)
    assert got.columns[-4:] == ["base", "count", "_n", "read_id"] and [r["read_id"] for r in got.orderBy("read_id").collect()] == [0, 1, 2, 3]


def test_modes(spark, tmp_path):
    path = tmp_path / "bad.fastq"
    path.write_text("@a\nAC\n+\nII\nnoise\n@b\nAC\n+\nI\n@c\nGT\n+\nII\n@d\nGT\n\nII\n")
    kept = read_fastq(spark, str(path), "DROPMALFORMED").collect()
    assert [r["name"] for r in kept] == ["a", "c"]
    rows = read_fastq(spark, str(path)).collect()
    assert [r["name"] for r in rows if r["corrupt"] is None] == ["a", "c"] and any("@b" in (r["corrupt"] or "") for r in rows)
    with pytest.raises(Exception, match="isn't valid"):
        read_fastq(spark, str(path), "FAILFAST").collect()
    with pytest.raises((OptionError, Exception)):
        read_fastq(spark, str(path), "SOMETIMES").collect()


def test_fasta_and_empty(spark, tmp_path):
    path = tmp_path / "x.fasta"
    path.write_text(">s1 one\nACGT\nAC\n>s2\nGG\n")
    assert rows_of(read_fastq(spark, str(path))) == [("s1", "one", "ACGTAC", ""), ("s2", "", "GG", "")]
    (tmp_path / "empty.fastq").write_text("")
    assert rows_of(read_fastq(spark, str(tmp_path / "empty.fastq"))) == []


def test_round_trips(spark, tmp_path):
    reads = spark.createDataFrame(R1, SCHEMA)
    write_fastq(reads, str(tmp_path / "f"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "f").glob("part-*")))
    assert text == TEXT and len(text.splitlines()) == 16
    fastq_to_archive(spark, str(tmp_path / "f"), str(tmp_path / "a"), Settings(crc32=True))
    verify_archive(spark, str(tmp_path / "a"))
    assert rows_of(read_archive(spark, str(tmp_path / "a")).withColumnRenamed("read_id", "local_id")) == WANT
    archive_to_fastq(spark, str(tmp_path / "a"), str(tmp_path / "g"))
    assert rows_of(read_fastq(spark, str(tmp_path / "g"))) == WANT
    with pytest.raises(Exception, match="(?i)exist"):
        write_fastq(reads, str(tmp_path / "f"))


def test_damage_is_found(spark, tmp_path):
    a = str(tmp_path / "a")
    write_archive(spark.createDataFrame(R1, SCHEMA), a, settings=Settings(crc32=True), reads_per_block=2)
    changed = [(*r[:5], r[5][::-1]) for r in R1]
    spark.createDataFrame(changed, SCHEMA).selectExpr("read_id", "bigint(floor(read_id / 2)) as block_id", "name", "comment", "sequence", "quality").write.mode("overwrite").parquet(f"{a}/reads")
    with pytest.raises(FormatError, match=r"\[1\]"):
        verify_archive(spark, a)


def test_lossy_mask_and_bad_reads(spark, tmp_path):
    reads = spark.createDataFrame(R1, SCHEMA)
    write_archive(reads, str(tmp_path / "a"), DatasetType(64), Settings(lossy=True, mask=FieldMask.of(1), crc32=True))
    verify_archive(spark, str(tmp_path / "a"))
    got = read_archive(spark, str(tmp_path / "a")).orderBy("read_id").collect()
    assert [r["name"] for r in got] == ["SEQ1", "SEQ2", "SEQ3", "SEQ4"] and got[3]["quality"] == "FFFFFFFFFOOO"
    bad = spark.createDataFrame([(0, 0, "x", "", "ACGT", "II")], SCHEMA)
    with pytest.raises(Exception, match="as many qualities"):
        write_archive(bad, str(tmp_path / "b"))
    write_archive(reads.where("false"), str(tmp_path / "none"))
    assert read_archive(spark, str(tmp_path / "none")).count() == 0


def test_ingest_finds_the_dataset(spark, tmp_path):
    from readloom.sources.archive import archive_info

    repeated = TEXT.replace("\n+\n", "\n+x\n")
    body = "".join(f"@{n} {c}\n{s}\n+{n} {c}\n{q}\n" for _, _, n, c, s, q in R1 if c)
    (tmp_path / "in.fastq").write_text(body)
    fastq_to_archive(spark, str(tmp_path / "in.fastq"), str(tmp_path / "a"), Settings(lossy=True))
    row = archive_info(spark, str(tmp_path / "a"))[0].first()
    assert (row["quality_offset"], row["plus_repetition"], row["color_space"]) == (64, True, False)
    assert read_archive(spark, str(tmp_path / "a")).orderBy("read_id").first()["quality"] == "F" * 28  # as at offset 64
    fastq_to_archive(spark, str(tmp_path / "in.fastq"), str(tmp_path / "b"))
    archive_to_fastq(spark, str(tmp_path / "b"), str(tmp_path / "out"))
    assert "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*"))) == body
    (tmp_path / "bad.fastq").write_text(repeated + TEXT)
    with pytest.raises(FormatError, match="disagree"):
        fastq_to_archive(spark, str(tmp_path / "bad.fastq"), str(tmp_path / "c"))


def test_commands(spark, tmp_path):
    source = tmp_path / "in.fastq"
    source.write_text(TEXT)
    to_archive(spark, str(source), str(tmp_path / "arc"))
    to_fastq(spark, str(tmp_path / "arc"), str(tmp_path / "out.fastq"))
    assert (tmp_path / "out.fastq").read_text() == TEXT
    with pytest.raises(FileExistsError):
        to_archive(spark, str(source), str(tmp_path / "arc"))
    with pytest.raises(FileNotFoundError):
        to_archive(spark, str(tmp_path / "missing"), str(tmp_path / "arc2"))


def test_stream(spark, tmp_path):
    from readloom.streaming import landed_reads, to_archive_stream

    (tmp_path / "land").mkdir()
    (tmp_path / "land" / "a.fastq").write_text(TEXT)
    q = to_archive_stream(landed_reads(spark, str(tmp_path / "land")), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("local_id").collect()
    assert [tuple(r[c] for c in FIELDS) for r in got] == WANT
