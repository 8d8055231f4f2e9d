"""Line dedup: keys sorted by range over hash, document and position; one pass finds what repeats; bitmaps say what stays.

A line's key is the line without `[\\x20\\x09-\\x0D]` at both ends and with A-Z lowered. A key of at least `min_chars` code
points that at least `min_docs` documents hold keeps its lines in the largest doc_id that holds it and loses all others.

Defined cases: a null or empty text is one empty line; a null doc_id counts as one document before all others; rows with one
doc_id are one document for the counts, and each row keeps its own bitmap; equal rows get equal bitmaps; an empty table gives
an empty table; other columns, whatever their names, are carried along untouched.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from readloom.llm.common import NULL_ID, col_of, id_key, slices, staged

MIN_CHARS, MIN_DOCS = 40, 5
BLANK = b" \t\n\v\f\r"
#: So many undecided rows of a key are held before they are put aside.
MOST_HELD = 10_000
KEYS = "h1 long, h2 long, doc long, row long, at array<int>"
FOUND = f"kind int, {KEYS}, docs int, largest long, smallest long"


def line_key(line: bytes) -> bytes:
    return line.strip(BLANK).lower()


def _keys(batches: Iterator[pa.RecordBatch], min_chars: int) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("doc", pa.int64()), ("row", pa.int64()), ("at", pa.list_(pa.int32()))])
    for batch in slices(batches):
        out: list = []
        for doc, row, text in zip(col_of(batch, "doc").to_pylist(), col_of(batch, "row").to_pylist(), col_of(batch, "text").cast(pa.binary()).to_pylist()):
            own: dict[bytes, list[int]] = {}
            for i, line in enumerate((text or b"").split(b"\n")):
                if len(line) >= min_chars and len(key := line_key(line)) >= min_chars and (key.isascii() or len(key.decode()) >= min_chars):
                    own.setdefault(xxhash.xxh3_128_digest(key), []).append(i)
            out += [(*struct.unpack("<qq", h), doc, row, at) for h, at in own.items()]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)


def _repeats(batches: Iterator[pa.RecordBatch], min_docs: int) -> Iterator[pa.RecordBatch]:
    """One range of the sorted keys, largest document first. kind 0: these lines go. A key at an end of the range may go on in
    the next one, so its undecided rows (kind 1: of its first document here, or of all if they are fewer than min_docs) wait
    for the sum of its parts (kind 2). So do those of a key of which more than MOST_HELD rows, of few documents, are undecided."""
    schema = pa.schema([("kind", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("doc", pa.int64()), ("row", pa.int64()), ("at", pa.list_(pa.int32())), ("docs", pa.int32()), ("largest", pa.int64()), ("smallest", pa.int64())])
    out: list = []
    key, waits, docs, last, largest, held = None, True, 0, None, None, []

    def close(edge: bool) -> None:
        if key is not None and edge:
            out.extend((1, *r, None, None, None) for r in held)
            out.append((2, *key, None, None, None, docs, largest, last))

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:2] != key:
                close(waits)
                waits = key is None
                key, docs, last, largest, held = row[:2], 0, None, row[2], []
            if docs == 0 or row[2] != last:
                docs, last = docs + 1, row[2]
                if docs == min_docs:  # from here on the key is known to be frequent
                    out.extend((0, *r, None, None, None) for r in held if r[2] != largest)
                    held = [r for r in held if r[2] == largest]
            if docs >= min_docs and row[2] != largest:
                out.append((0, *row, None, None, None))
            else:
                held.append(row)
                if len(held) > MOST_HELD:
                    out.extend((1, *r, None, None, None) for r in held)
                    waits, held = True, []
        if len(out) >= MOST_HELD:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
            out = []
    close(True)
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)


def _bitmaps(batches: Iterator[pa.RecordBatch], cut: bool) -> Iterator[pa.RecordBatch]:
    """With cut, the texts lose the lines in the same pass: a second one would need Python workers of its own."""
    for batch in slices(batches):
        n_lines, n_dropped, maps, texts = [], [], [], []
        for text, drops in zip(col_of(batch, "text").cast(pa.binary()).to_pylist(), col_of(batch, "drops").to_pylist()):
            n = (text or b"").count(b"\n") + 1
            gone = {i for part in drops or () for i in part}
            bits = bytearray(b"\xff" * (n // 8 + 1))
            for i in gone:
                bits[i >> 3] &= ~(1 << (i & 7)) & 255
            n_lines.append(n)
            n_dropped.append(len(gone))
            maps.append(zlib.compress(bytes(bits), 6))
            if cut:
                texts.append(kept_lines(text, maps[-1]))
        text = pa.array(texts, pa.binary()).cast(pa.string()) if cut else col_of(batch, "text")
        yield pa.RecordBatch.from_arrays([text, col_of(batch, "other"), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(maps, pa.binary())], names=["text", "other", "n_lines", "n_dropped", "keep_bitmap"])


def kept_lines(text: bytes | None, bitmap: bytes) -> bytes:
    """The lines whose bit is set."""
    bits = zlib.decompress(bitmap)
    return b"\n".join(line for i, line in enumerate((text or b"").split(b"\n")) if bits[i >> 3] >> (i & 7) & 1)


def frequent_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc, row, at): the line numbers `at` of the row `row` of document `doc` that go. doc: the id, row: a hash of the text."""
    rows = docs.select(id_key().alias("doc"), F.xxhash64("text").alias("row"), F.col("text").cast("string").alias("text"))
    keys = staged(rows.mapInArrow(lambda it: _keys(it, min_chars), KEYS), "line-keys")
    # The range covers the document as well, so one key of a third of all rows is spread over many tasks.
    dealt = keys.repartitionByRange("h1", "h2", F.desc("doc"), "row").sortWithinPartitions("h1", "h2", F.desc("doc"), "row")
    found = staged(dealt.mapInArrow(lambda it: _repeats(it, min_docs), FOUND), "line-runs")
    # At most two keys for each range, and those of more than MOST_HELD undecided rows.
    parts = found.where("kind = 2")
    # A document of several rows may be the last of one range and the first of the next.
    again = F.lag("smallest").over(W.Window.partitionBy("h1", "h2").orderBy(F.desc("largest"), F.desc("smallest"))).eqNullSafe(F.col("largest"))
    ends = parts.withColumn("docs", F.col("docs") - again.cast("int")).groupBy("h1", "h2").agg(F.sum("docs").alias("n"), F.max("largest").alias("top")).where(F.col("n") >= min_docs)
    undecided = found.where("kind = 1").join(staged(ends, "line-ends"), ["h1", "h2"]).where("doc < top")
    return found.where("kind = 0").select("doc", "row", "at").unionByName(undecided.select("doc", "row", "at"))


def _marked(docs: DataFrame, other: Column, min_chars: int, min_docs: int, cut: bool) -> DataFrame:
    gone = frequent_lines(docs, min_chars, min_docs).groupBy("doc", "row").agg(F.collect_list("at").alias("drops"))
    rows = docs.select(F.col("text").cast("string").alias("text"), other.alias("other"), id_key().alias("doc"), F.xxhash64("text").alias("row"))
    marked = rows.join(gone, ["doc", "row"], "left").select("text", "other", "drops")
    kind = marked.schema["other"].dataType.simpleString()
    return marked.mapInArrow(lambda it: _bitmaps(it, cut), f"text string, other {kind}, n_lines long, n_dropped long, keep_bitmap binary")


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """One row for each row of docs: doc_id, n_lines, n_dropped, keep_bitmap (zlib over little-endian bits, 1: the line stays)."""
    return _marked(docs, F.struct("doc_id"), min_chars, min_docs, False).select("other.doc_id", "n_lines", "n_dropped", "keep_bitmap")


def kept_texts(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """text (with the lines that stay), other (a struct of the other columns of docs), n_lines, n_dropped, keep_bitmap."""
    other = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"])
    return _marked(docs, other, min_chars, min_docs, True)


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """docs, with its columns, without the repeated lines; n_chars, if there is such a column, follows the text."""
    done = kept_texts(docs, min_chars, min_docs)
    length = {"n_chars": F.length("text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {}
    cols = [F.col("text").cast(docs.schema["text"].dataType).alias("text") if c == "text" else length[c].alias(c) if c in length else F.col(f"other.`{c}`").alias(c) for c in docs.columns]
    return done.select(*cols)
