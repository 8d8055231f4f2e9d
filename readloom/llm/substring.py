"""Substring dedup: recurring passages are confirmed, compiled into sharded Aho-Corasick automata, and located in every document.

Words are runs of characters other than `[\\x20\\x09-\\x0D]`. A window is `window` consecutive words of one document; a word goes if a
window that covers it also starts, as a word sequence, in a document with a smaller doc_id.

1. Each window names an anchor, the least hash of its phrases of `phrase` words, so equal windows name equal anchors. A run is
   the consecutive windows with one anchor; runs are few (about one for 20 words), and their hashes tell which recur.
2. A run seen with the same words in a smaller document is confirmed whole. Where an anchor has several contexts, the first run
   of each context is compared window by window. Both give passages: (document, place, words) found at a place of a smaller one.
3. The text of each passage is taken from the smaller document and sent to the shards of documents in which it was found. Each
   shard compiles its passages into automata over word numbers and streams its documents through them; what an automaton
   locates is removed. So nothing is removed on the strength of a hash alone. An automaton has a character for each word of its
   passages, so there are several where the passages have more words than that. Long passages go in as parts that overlap by a
   window less one word.

Every group that is gathered belongs to one document, or to a bounded part of one; equal windows are only ever counted.

Defined cases: a null or empty text has no words; a null doc_id counts as one document before all others; rows with one doc_id
are one document, none of which removes words of another; an empty table gives an empty table; other columns are carried along.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.llm import wordscan as ws
from readloom.llm.common import col_of, id_key, slices, staged, text_bytes

WINDOW, PHRASE = 50, 8
#: As many passages at most are cut out of one document at a time.
REQUESTS = 500
RUNS = "anchor long, ctx long, doc long, s int, n int"
PASSAGE = "doc long, s int, n int, rep long, rs int"
#: Word numbers become characters; the code points of surrogates are left out, and the first stands for words of no passage.
FIRST_CHAR, MOST_WORDS = 0xE000, 1_000_000
#: The library goes down an automaton by recursion, so what is added to it is no longer than this.
LONGEST = 2_000


def window_anchors(w: ws.Words, window: int, phrase: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, anchor) of every window that stays in one text."""
    width = window - phrase + 1
    g = ws.grams(w.hash, phrase)
    m = len(g) - width + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    least, span = g, 1
    while span * 2 <= width:
        least, span = np.minimum(least[:-span], least[span:]), span * 2
    least = np.minimum(least[:m], least[width - span :][:m])
    start = np.flatnonzero(w.doc[:m] == w.doc[window - 1 :][:m])
    return start, least[start]


class Spans:
    """Hashes of any stretch of consecutive words, from sums over all words before."""

    def __init__(self, h: np.ndarray):
        mult = ws.mix(np.uint64(11)) | np.uint64(1)
        with np.errstate(over="ignore"):
            powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(h), mult)]))
            self.downs = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(h), np.uint64(ws.inverse(mult)))]))
            self.total = np.concatenate([[np.uint64(0)], np.cumsum(h * powers[:-1])])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ws.mix((self.total[end] - self.total[start]) * self.downs[start] + (end - start).astype(np.uint64))


def _runs(batches: Iterator[pa.RecordBatch], window: int, phrase: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        w = ws.words(*text_bytes(col_of(batch, "text")))
        start, anchor = window_anchors(w, window, phrase)
        if not len(start):
            continue
        doc = w.doc[start]
        at = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])]))
        n = np.diff(np.append(at, len(start)))
        first = start[at]
        ctx = Spans(w.hash).hash(first, first + n + window - 1)
        ids = col_of(batch, "doc").to_numpy()
        yield pa.RecordBatch.from_arrays(
            [pa.array(anchor[at].view(np.int64)), pa.array(ctx.view(np.int64)), pa.array(ids[doc[at]]), pa.array((first - w.first[doc[at]]).astype(np.int32)), pa.array(n.astype(np.int32))],
            names=["anchor", "ctx", "doc", "s", "n"],
        )


def _windows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """The windows of the given runs, one by one."""
    for batch in slices(batches):
        w = ws.words(*text_bytes(col_of(batch, "text")))
        spans, ids = Spans(w.hash), col_of(batch, "doc").to_numpy()
        runs = col_of(batch, "runs")
        row = np.repeat(np.arange(batch.num_rows), runs.value_lengths().to_numpy())
        flat = runs.flatten()
        anchor, s, n = (flat.field(k).to_numpy() for k in ("anchor", "s", "n"))
        # Another row with this doc_id may be shorter than the one that the run is from.
        n = np.clip(np.minimum(n, np.diff(w.first)[row] - window + 1 - s), 0, None)
        at = np.repeat(np.arange(len(n)), n)
        start = (s[at] + np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)).astype(np.int64)
        absolute = w.first[row[at]] + start
        yield pa.RecordBatch.from_arrays(
            [pa.array(anchor[at]), pa.array(spans.hash(absolute, absolute + window).view(np.int64)), pa.array(ids[row[at]]), pa.array(start.astype(np.int32))],
            names=["anchor", "h", "doc", "s"],
        )


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Passages of one document that go on in each other, at the same distance in the same other document, put together."""
    for batch in batches:
        parts = col_of(batch, "parts")
        row = np.repeat(np.arange(batch.num_rows), parts.value_lengths().to_numpy())
        flat = parts.flatten()
        s, n, rep, rs = (flat.field(k).to_numpy().astype(np.int64) for k in ("s", "n", "rep", "rs"))
        order = np.lexsort((s, s - rs, rep, row))
        row, s, n, rep, rs = row[order], s[order], n[order], rep[order], rs[order]
        if not len(s):
            continue
        same = (row[1:] == row[:-1]) & (rep[1:] == rep[:-1]) & ((s - rs)[1:] == (s - rs)[:-1])
        # Within a diagonal the ends so far: kept apart by an offset that grows with each diagonal.
        diagonal = np.concatenate([[0], np.cumsum(~same)])
        reach = np.maximum.accumulate(s + n + diagonal * (1 << 40)) - diagonal * (1 << 40)
        new = np.concatenate([[True], ~same | (s[1:] > reach[:-1])])
        at = np.flatnonzero(new)
        end = reach[np.append(at[1:], len(s)) - 1]
        ids = col_of(batch, "doc").to_numpy()
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids[row[at]]), pa.array(s[at].astype(np.int32)), pa.array((end - s[at]).astype(np.int32)), pa.array(rep[at]), pa.array(rs[at].astype(np.int32))],
            names=["doc", "s", "n", "rep", "rs"],
        )


def _texts(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """The words of the asked passages, joined by a space."""
    for batch in slices(batches):
        out: list = []
        for doc, text, asked in zip(col_of(batch, "doc").to_pylist(), col_of(batch, "text").cast(pa.binary()).to_pylist(), col_of(batch, "asked").to_pylist()):
            words = (text or b"").split()
            out += [(doc, x["rs"], x["n"], b" ".join(words[x["rs"] : x["rs"] + x["n"] + window - 1])) for x in asked if x["rs"] + x["n"] + window - 1 <= len(words)]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.int32(), pa.int32(), pa.binary()))], names=["rep", "rs", "n", "passage"])


def _batches_of(lengths: np.ndarray, window: int, most: int) -> list[list[tuple[int, int, int]]]:
    """Stretches (passage, first word, end) that cover every window of the passages, in lists of at most `most` words."""
    out: list[list[tuple[int, int, int]]] = []
    room, longest = 0, min(most, max(LONGEST, 2 * window))
    for i, n in enumerate(lengths.tolist()):
        for a in range(0, max(1, n - window + 1), longest - window + 1):
            b = min(n, a + longest)
            if b - a > room:
                out.append([])
                room = most
            out[-1].append((i, a, b))
            room -= b - a
            if b == n:
                break
    return out


def _spell(codes: np.ndarray) -> str:
    return (codes + FIRST_CHAR).astype("<u4").tobytes().decode("utf-32-le")


def _covered(w: ws.Words, p: ws.Words, reps: list[int], ids: list[int], wanted: list[int], window: int, most: int) -> np.ndarray:
    """For each word of w whether a passage that a smaller document has covers it. p: the passages, wanted: the texts to stream."""
    import ahocorasick

    gone = np.zeros(len(w.hash) + 1, np.int64)
    for stretches in _batches_of(np.diff(p.first), window, most):
        own = [p.hash[p.first[i] + a : p.first[i] + b] for i, a, b in stretches]
        known = np.unique(np.concatenate(own))
        automaton = ahocorasick.Automaton()
        for (i, _, _), h in zip(stretches, own):
            word = _spell(np.searchsorted(known, h) + 1)
            automaton.add_word(word, (min(reps[i], automaton.get(word, (reps[i],))[0]), len(word)))
        automaton.make_automaton()
        for t in wanted:
            a, h = int(w.first[t]), w.hash[w.first[t] : w.first[t + 1]]
            at = np.minimum(np.searchsorted(known, h), len(known) - 1)
            for end, (rep, n) in automaton.iter(_spell(np.where(known[at] == h, at + 1, 0))):
                if rep < ids[t]:
                    gone[a + end + 1 - n] += 1
                    gone[a + end + 1] -= 1
    return np.cumsum(gone)[: len(w.hash)] > 0


def _located(batches: Iterator[pa.RecordBatch], window: int, cut: bool, most: int) -> Iterator[pa.RecordBatch]:
    """Each slice is a shard: its passages make the automata, and its documents are streamed through them."""
    for batch in slices(batches):
        w = ws.words(*text_bytes(col_of(batch, "text")))
        ids, patterns = col_of(batch, "doc").to_pylist(), col_of(batch, "passages").to_pylist()
        least: dict[bytes, int] = {}  # of each passage the smallest document that has it
        for own in patterns:
            for x in own or ():
                least[x["passage"]] = min(x["rep"], least.get(x["passage"], x["rep"]))
        covered = np.zeros(len(w.hash), bool)
        if least:
            p = ws.words(*text_bytes(pa.array(list(least), pa.binary())))
            covered = _covered(w, p, list(least.values()), ids, [i for i, own in enumerate(patterns) if own], window, most)
        edges = np.flatnonzero(np.diff(np.concatenate([[0], covered.astype(np.int8), [0]])) != 0)
        # A stretch that goes on into the next text is cut there.
        cuts = w.first[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(covered))]
        cuts = cuts[covered[cuts] & covered[cuts - 1]]
        edges = np.sort(np.concatenate([edges, cuts, cuts]))
        begin, end = edges[0::2], edges[1::2]
        owner = w.doc[begin] if len(begin) else begin
        lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(batch.num_rows + 1)).astype(np.int32)), pa.StructArray.from_arrays([pa.array((x - w.first[owner]).astype(np.int32)) for x in (begin, end)], ["first", "end"]))
        text = col_of(batch, "text")
        if cut:
            text = pa.array([kept_words(t, x) for t, x in zip(text.cast(pa.binary()).to_pylist(), lists.to_pylist())], pa.binary()).cast(pa.string())
        yield pa.RecordBatch.from_arrays([col_of(batch, "other"), text, pa.array(np.diff(w.first)), lists], names=["other", "text", "n_words", "removed"])


def passages(rows: DataFrame, window: int = WINDOW, phrase: int = PHRASE) -> DataFrame:
    """doc, s, n, rep, rs: the n windows of doc from word s on are those of the smaller document rep from word rs on.

    rows: doc, text and anything else. Staged, as several plans read it.
    """
    runs = staged(rows.select("doc", "text").mapInArrow(lambda it: _runs(it, window, phrase), RUNS), "runs")
    recurring = runs.groupBy("anchor").agg(F.min("doc").alias("d0"), F.max("doc").alias("d1"), F.min("ctx").alias("c0"), F.max("ctx").alias("c1"))
    recurring = recurring.where("d0 < d1").select("anchor", (F.col("c0") != F.col("c1")).alias("mixed"))
    again = staged(runs.join(recurring, "anchor"), "recurring")
    # The first document of each context stands for it. What is joined with all runs or windows is staged, as a join whose other
    # side is an aggregate of the same stage can't be split where one key has a large share of the rows.
    first = staged(again.groupBy("anchor", "ctx").agg(F.min(F.struct("doc", "s")).alias("rep")), "contexts")
    known = again.join(first, ["anchor", "ctx"])
    whole = known.where("doc > rep.doc").select("doc", "s", "n", F.col("rep.doc").alias("rep"), F.col("rep.s").alias("rs"))
    single = known.where("mixed and doc = rep.doc and s = rep.s").groupBy("doc").agg(F.collect_list(F.struct("anchor", "s", "n")).alias("runs"))
    windows = rows.select("doc", "text").join(single, "doc").mapInArrow(lambda it: _windows(it, window), "anchor long, h long, doc long, s int")
    windows = staged(windows, "windows")
    least = windows.groupBy("anchor", "h").agg(F.min(F.struct("doc", "s")).alias("rep"), F.max("doc").alias("last")).where("rep.doc < last")
    least = staged(least.select("anchor", "h", "rep"), "first-windows")
    one = windows.join(least, ["anchor", "h"]).where("doc > rep.doc").select("doc", "s", F.lit(1).alias("n"), F.col("rep.doc").alias("rep"), F.col("rep.s").alias("rs"))
    parts = whole.union(one).groupBy("doc").agg(F.collect_list(F.struct("s", "n", "rep", "rs")).alias("parts"))
    return staged(parts.mapInArrow(_joined, PASSAGE), "passages")


def kept_words(text: bytes | None, removed: list[dict]) -> bytes:
    """The words outside the stretches, joined by one space."""
    words = (text or b"").split()
    for x in reversed(removed):
        del words[x["first"] : x["end"]]
    return b" ".join(words)


def mark_repeats(docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE, cut: bool = False, most: int = MOST_WORDS) -> DataFrame:
    """text (with cut: the words that stay), other (a struct of the other columns of docs), n_words, removed: stretches first..end (exclusive) of words that go.

    most: words of the passages of one automaton, over `window` and at most MOST_WORDS.
    """
    if not window <= most <= MOST_WORDS:
        raise ValueError(f"an automaton has {window} to {MOST_WORDS} words")
    other = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"])
    rows = docs.select(id_key().alias("doc"), F.col("text").cast("string").alias("text"), other.alias("other"))
    found = passages(rows, window, phrase)
    asked = found.select(F.col("rep").alias("doc"), "rs", "n").distinct()
    # A document that many others repeat is asked for many different passages: some hundred at a time.
    many = asked.groupBy("doc").agg(F.count("*").alias("m"))
    parts = asked.join(many, "doc").withColumn("part", F.pmod(F.xxhash64("rs", "n"), F.ceil(F.col("m") / REQUESTS)))
    parts = parts.groupBy("doc", "part").agg(F.collect_list(F.struct("rs", "n")).alias("asked"))
    texts = rows.select("doc", "text").join(parts, "doc").select("doc", "text", "asked").mapInArrow(lambda it: _texts(it, window), "rep long, rs int, n int, passage binary")
    routed = found.join(texts, ["rep", "rs", "n"]).groupBy("doc").agg(F.collect_list(F.struct("rep", "passage")).alias("passages"))
    shards = rows.join(routed, "doc", "left")
    kind = rows.schema["other"].dataType.simpleString()
    return shards.select("doc", "text", "other", "passages").mapInArrow(lambda it: _located(it, window, cut, most), f"other {kind}, text string, n_words long, removed array<struct<first int, end int>>")


def kept_texts(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """mark_repeats() with the words that stay, joined by one space, as text: in the same pass over the documents."""
    return mark_repeats(docs, window, cut=True)


def dedup_substrings(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs, with its columns, without the repeated words."""
    done = kept_texts(docs, window)
    return done.select(*[F.col("text") if c == "text" else F.col(f"other.`{c}`").alias(c) for c in docs.columns])
