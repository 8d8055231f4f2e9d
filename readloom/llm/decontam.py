"""Benchmark decontamination: CGK random walks embed word windows, bit sampling finds near ones, edit distance decides.

Words are runs of ASCII letters and digits and of bytes beyond ASCII, lower-cased. An item of n words is leaked by a document
if some window of it is within ceil(tolerance * n) word edits of the item. The CGK walk reads a window word by word and moves
on, or stays, by a random bit of the step and the word, so windows at a small edit distance give strings at a small Hamming
distance; a repetition hashes a few sampled steps of one walk. Each length class repeats until its own repetitions have found
the target share of simulated leaks with the most edits allowed, each leak counted once, with half of the allowed losses to
spare as the leaks are a sample. Only windows that could be leaks are embedded: those in which at most the allowed number of
words are missing from the vocabulary of the class's items, which no leak fails.

An item of more than `LONG` words is searched for by parts of half as many to as many words: one of them has at most its share
of the edits, so no leak lacks a part within the part's own tolerance, and repetitions stay few however long the item is. Where
a part is found, the whole item is aligned with the text around it. Items shorter than `min_words` words are searched for as
they are: all of their words, in order, without an edit. There may be any number of items: they are indexed `items_per_pass` or
`bytes_per_pass` at a time, so an index has a proven bound (or holds one item), and each pass reads the documents once.

Defined cases: null and empty texts and items hold nothing; null or repeated ids are carried along as they are, each row for
itself; an empty table on either side gives no rows; other columns play no part.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.llm import wordscan as ws
from readloom.llm.common import broadcast, col_of, free_name, slices, text_bytes

TOLERANCE, TARGET, SAMPLED, MIN_WORDS, ITEMS_PER_PASS = 0.1, 0.99, 3, 8, 20_000
BYTES_PER_PASS, TRIALS, LONG = 32 << 20, 1000, 64
LEAKS = "doc_id long, item_id long, first_word long, last_word long, edits int"


@dataclass
class LengthClass:
    low: int  # words of the shortest item
    edits: int  # allowed for the longest
    vocabulary: np.ndarray
    steps: list[np.ndarray]  # of each repetition, ascending
    keys: list[np.ndarray]  # of each repetition, sorted
    owners: list[np.ndarray]  # the parts of these keys


@dataclass
class Index:
    classes: list[LengthClass]
    parts: list[tuple[int, int, np.ndarray]]  # item, first word there, word hashes


def lowered_words(column: pa.Array) -> ws.Words:
    raw, at = text_bytes(pc.utf8_lower(column.cast(pa.large_string())))
    return ws.words(raw, at, normal=True)


def allowed_edits(n: int, tolerance: float) -> int:
    return max(1, math.ceil(tolerance * n - 1e-9))


def walk_keys(h: np.ndarray, start: np.ndarray, steps: np.ndarray, seed: int) -> np.ndarray:
    """The hash of the sampled steps of the walk with this seed from each start; past the end of h there are zeros."""
    h = np.append(h, np.uint64(0))
    at, key, last = start.copy(), np.full(len(start), seed, np.uint64), len(h) - 1
    sampled, bits = set(steps.tolist()), None
    with np.errstate(over="ignore"):
        for j in range(int(steps[-1]) + 1):
            if j % 64 == 0:
                bits = ws.mix(h ^ ws.mix(np.uint64(seed * 1000 + j // 64 + 1)))
            if j in sampled:
                key = ws.mix(key * ws.MULT + h[at])
            at = np.minimum(at + ((bits[at] >> np.uint64(j % 64)) & np.uint64(1)).astype(np.int64), last)
    return key


def edit_distance(a: list, b: list, most: int) -> tuple[int, int]:
    """(d, j): the least number of word edits from a to a prefix b[:j], if at most `most`; else (most + 1, 0)."""
    far = most + 1
    row = [j if j <= most else far for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        new = [far] * (len(b) + 1)
        if i <= most:
            new[0] = i
        for j in range(max(1, i - most), min(len(b), i + most) + 1):
            new[j] = min(row[j - 1] + (x != b[j - 1]), row[j] + 1, new[j - 1] + 1, far)
        row = new
        if min(row) > most:
            return far, 0
    d = min(row)
    return (d, row.index(d)) if d <= most else (far, 0)


def closest(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """(d, first, length): the stretch of b with the fewest word edits to a, the earliest and then the shortest of equals."""

    def distances(x: np.ndarray, y: np.ndarray, free: bool) -> np.ndarray:
        """The edits from x to each prefix of y; with free, to the best stretch that ends there."""
        at = np.arange(len(y) + 1)
        row = np.zeros(len(y) + 1, np.int64) if free else at.copy()
        for word in x:
            new = np.append(row[0] + 1, np.minimum(row[:-1] + (y != word), row[1:] + 1))
            row = np.minimum.accumulate(new - at) + at  # an insertion after the best one so far
        return row

    from_start = distances(a[::-1], b[::-1], True)[::-1]
    first = int(np.argmin(from_start))
    prefix = distances(a, b[first : first + 2 * len(a)], False)
    return int(from_start[first]), first, int(np.argmin(prefix))


def parts_of(items: list[np.ndarray]) -> list[tuple[int, int, np.ndarray]]:
    out = []
    for i, h in enumerate(items):
        cuts = np.linspace(0, len(h), math.ceil(len(h) / LONG) + 1).astype(int).tolist()
        out += [(i, a, h[a:b]) for a, b in zip(cuts, cuts[1:])]
    return out


def build_index(items: list[np.ndarray], tolerance: float, target: float, seed: int = 7) -> Index:
    """The parts of items (their word hashes) by length, each class at most a quarter longer than its shortest part."""
    rng, out = np.random.default_rng(seed), Index([], parts_of(items))
    parts = [h for _, _, h in out.parts]
    order = sorted(range(len(parts)), key=lambda i: len(parts[i]))
    while order:
        low = len(parts[order[0]])
        mine = [i for i in order if len(parts[i]) <= 1.25 * low]
        order = order[len(mine) :]
        edits = allowed_edits(len(parts[mine[-1]]), tolerance)
        flat = np.concatenate([parts[i] for i in mine])
        starts = np.concatenate([[0], np.cumsum([len(parts[i]) + 1 for i in mine])])[:-1]
        padded = np.concatenate([np.append(parts[i], np.uint64(0)) for i in mine])
        reach = max(SAMPLED, int(1.5 * low))  # walks that long seldom leave the shortest part
        # Simulated leaks with the most edits: which of them has no repetition found so far?
        trials = [(parts[i], _edited(parts[i], edits, flat, rng)) for i in rng.choice(mine, TRIALS)]
        both = [np.concatenate([np.append(p[side], np.uint64(0)) for p in trials]) for side in (0, 1)]
        at = [np.concatenate([[0], np.cumsum([len(p[side]) + 1 for p in trials])])[:-1] for side in (0, 1)]
        lost = np.ones(TRIALS, bool)
        c = LengthClass(low, edits, np.unique(flat), [], [], [])
        for r in itertools.count():
            steps = np.sort(rng.choice(reach, SAMPLED, replace=False))
            keys = walk_keys(padded, starts, steps, r)
            by = np.argsort(keys, kind="stable")
            c.steps.append(steps)
            c.keys.append(keys[by])
            c.owners.append(np.array(mine)[by])
            lost &= walk_keys(both[0], at[0], steps, r) != walk_keys(both[1], at[1], steps, r)
            if r + 1 >= 8 and lost.sum() <= (1 - target) * TRIALS / 2:
                break
        out.classes.append(c)
    return out


def _edited(item: np.ndarray, edits: int, pool: np.ndarray, rng) -> np.ndarray:
    out = item.tolist()
    for _ in range(edits):
        i, kind = int(rng.integers(len(out))), rng.integers(3)
        out[i : i + (kind != 1)] = [] if kind == 0 and len(out) > 1 else [int(rng.choice(pool))]
    return np.array(out, np.uint64)


def known_in(h: np.ndarray, index: list[LengthClass]) -> np.ndarray:
    """For each word hash a bit for each class whose vocabulary has it."""
    vocabulary = np.unique(np.concatenate([c.vocabulary for c in index]))
    bits = np.zeros(len(vocabulary), np.uint64)
    for number, c in enumerate(index):
        bits[np.searchsorted(vocabulary, c.vocabulary)] |= np.uint64(1 << number)
    maybe = np.zeros(1 << 18, bool)
    maybe[vocabulary & np.uint64((1 << 18) - 1)] = True
    out = np.zeros(len(h), np.uint64)
    some = np.flatnonzero(maybe[h & np.uint64((1 << 18) - 1)])
    at = np.minimum(np.searchsorted(vocabulary, h[some]), len(vocabulary) - 1)
    out[some] = np.where(vocabulary[at] == h[some], bits[at], np.uint64(0))
    return out


def _with_cut(start: np.ndarray, w: ws.Words, foreign: np.ndarray, c: LengthClass) -> np.ndarray:
    """start, with the starts close to the end of a text of which the words up to there are few foreign ones."""
    last = w.first[1:]
    more = (last[:, None] - np.arange(c.low - c.edits, c.low)[None, :]).ravel()
    begin = np.repeat(w.first[:-1], c.edits)
    end = np.repeat(last, c.edits)
    ok = more >= begin
    more, end = more[ok], end[ok]
    more = more[foreign[end] - foreign[more] + (more + c.low - end) <= c.edits]
    return np.union1d(start, more)


def find_leaks(w: ws.Words, n: int, items: list[np.ndarray], index: Index, tolerance: float) -> list[tuple[int, int, int, int, int]]:
    """(text, item, first word, last word, edits): for each text and item the closest window, the earliest of equals."""
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    aligned: set[tuple[int, int, int]] = set()  # text, item and where it would begin, by steps of the allowed edits
    if not index.classes or not len(w.hash):
        return []
    classes = known_in(w.hash, index.classes)
    for number, c in enumerate(index.classes):
        foreign = np.zeros(len(w.hash) + c.low + 1, np.int32)  # past the end all words are foreign
        foreign[1 : len(w.hash) + 1] = (classes >> np.uint64(number)) & np.uint64(1) ^ np.uint64(1)
        foreign[len(w.hash) + 1 :] = 1
        foreign = np.cumsum(foreign, dtype=np.int32)
        # Windows that reach into the next text may pass, too; the walk and the edit distance stop at the text's end.
        start = np.flatnonzero(foreign[c.low :][: len(w.hash)] - foreign[: len(w.hash)] <= c.edits)
        # One that is cut by the end of its text has what is missing as edits.
        start = _with_cut(start, w, foreign, c)
        if not len(start):
            continue
        tried: set[tuple[int, int]] = set()
        for r, (steps, keys, owners) in enumerate(zip(c.steps, c.keys, c.owners)):
            key = walk_keys(w.hash, start, steps, r)
            low, high = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
            for s, i, j in zip(start[high > low].tolist(), low[high > low].tolist(), high[high > low].tolist()):
                tried.update((s, int(o)) for o in owners[i:j])
        for s, part in tried:
            item, offset, a = index.parts[part]
            doc, k = int(w.doc[s]), allowed_edits(len(a), tolerance)
            begin, end = int(w.first[doc]), int(w.first[doc + 1])
            b = w.hash[s : min(s + len(a) + k, end)]
            d, length = (0, len(a)) if len(b) >= len(a) and (b[: len(a)] == a).all() else edit_distance(a.tolist(), b.tolist(), k)
            if d > k or not length:
                continue
            first, whole = s - begin, items[item]
            if len(whole) > len(a):  # a part of an item: the whole of it may stand around it
                k = allowed_edits(len(whole), tolerance)
                cell = (first - offset) // (k + 1)
                if (doc, item, cell) in aligned:
                    continue
                aligned.add((doc, item, cell))
                low = max(0, cell * (k + 1) - k)
                d, first, length = closest(whole, w.hash[begin + low : min(end, begin + (cell + 1) * (k + 1) + len(whole) + k)])
                first += low
            if d <= k and length:
                best[doc, item] = min(best.get((doc, item), (d, first, length)), (d, first, length))
    return [(doc, item, first, first + length - 1, d) for (doc, item), (d, first, length) in sorted(best.items())]


def find_short(w: ws.Words, items: list[np.ndarray]) -> list[tuple[int, int, int, int, int]]:
    """As find_leaks, for copies without an edit of items of few words."""
    out = []
    for n in sorted({len(a) for a in items}):
        mine = np.array([i for i, a in enumerate(items) if len(a) == n])
        text = np.concatenate([items[i] for i in mine])
        keys = ws.grams(text, n)[::n]
        by = np.argsort(keys, kind="stable")
        mine, text, keys = mine[by], text.reshape(-1, n)[by], keys[by]
        start = np.flatnonzero(ws.gram_starts(w, n))
        here = ws.grams(w.hash, n)[start]
        low = np.searchsorted(keys, here, "left")
        times = np.searchsorted(keys, here, "right") - low
        row = np.repeat(low - np.cumsum(times) + times, times) + np.arange(times.sum())  # equal items have equal keys
        start = np.repeat(start, times)
        same = (w.hash[start[:, None] + np.arange(n)] == text[row]).all(1)
        start, item = start[same], mine[row[same]]
        pairs, at = np.unique(np.stack([w.doc[start], item]), axis=1, return_index=True)
        first = start[at] - w.first[pairs[0]]
        out += [(doc, i, a, a + n - 1, 0) for doc, i, a in zip(*pairs.tolist(), first.tolist())]
    return out


def leaks(docs: DataFrame, benchmark: DataFrame, tolerance: float = TOLERANCE, target: float = TARGET, min_words: int = MIN_WORDS, items_per_pass: int = ITEMS_PER_PASS, bytes_per_pass: int = BYTES_PER_PASS) -> DataFrame:
    """One row for each row of docs and item that it leaks: doc_id, item_id, first_word, last_word (from 0, inclusive), edits."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    passes = max(1, math.ceil(size["n"] / (0.9 * items_per_pass)), math.ceil(size["bytes"] / (0.9 * bytes_per_pass)))
    out = None
    for i in range(passes):
        mine = items if passes == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == i)
        got = mine.toArrow().to_pydict()  # items_per_pass rows and bytes_per_pass bytes or so
        w = lowered_words(pa.array(got["text"], pa.string()))
        all_items = [(k, w.hash[w.first[j] : w.first[j + 1]]) for j, k in enumerate(got["item_id"])]
        kept = [(k, h) for k, h in all_items if len(h) >= min_words]
        ids, hashes = [k for k, _ in kept], [h for _, h in kept]
        short = [(k, h) for k, h in all_items if 0 < len(h) < min_words]
        shared = broadcast(spark, (ids, hashes, build_index(hashes, tolerance, target), [k for k, _ in short], [h for _, h in short]))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, hashes, index, short_ids, short_hashes = shared()
            kinds = [pa.int64()] * 4 + [pa.int32()]
            for batch in slices(batches):
                doc_ids = col_of(batch, "doc_id").to_pylist()
                w = lowered_words(col_of(batch, "text"))
                found = [(doc_ids[d], ids[i], a, b, e) for d, i, a, b, e in find_leaks(w, batch.num_rows, hashes, index, tolerance)]
                found += [(doc_ids[d], short_ids[i], a, b, e) for d, i, a, b, e in find_short(w, short_hashes)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], names=["doc_id", "item_id", "first_word", "last_word", "edits"])

        part = rows.mapInArrow(search, LEAKS)
        out = part if out is None else out.union(part)
    return out


def drop_leaked(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs without the documents that leak an item. Rows with a null doc_id are told apart by their text."""
    marked = docs.select(F.xxhash64("doc_id", "text").alias("doc_id"), "text")
    name = free_name(docs, "gone")
    gone = leaks(marked, benchmark, **options).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, F.xxhash64("doc_id", "text") == F.col(name), "left_anti")
