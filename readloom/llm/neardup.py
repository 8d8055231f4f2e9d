"""Near-duplicate classes by DartMinHash signatures over weighted five-word shingles, banded, with exact verification.

A text's weighted set has its shingles of five consecutive words with their counts (a text of one to four words is one shingle).
Weight is cut into regions, 0..1, 1..2, 2..4 and so on; each region of a shingle is hit by darts of a Poisson process in weight
and time that depends on nothing but shingle, region and dart number, and a dart counts if it falls below the shingle's weight.
A dart also names a signature coordinate, which keeps its earliest dart, so two texts agree on a coordinate with the probability
of their weighted Jaccard similarity. A text throws about k ln k darts however long it is and however large its weights are.

Texts that agree on a band are compared with the smallest text of that bucket and, in buckets of more than two, with the smallest
of the finer bucket that also shares the next band. A pair counts as a link only if its exact weighted Jaccard similarity is at
least `threshold`. Where a bucket then still holds several connected components, all its pairs across components are compared,
too, block of texts against block: first by their signatures, which leave out pairs that agree on so few coordinates that fewer
than `MISSED` of similar pairs would, then exactly. So every two texts that share a band are compared or already in one class.
No bucket is gathered anywhere and there are no lists of pairs, but the work on texts that share bands and are not similar grows
with their square.

The nodes of the graph are texts: (doc, h1), the smallest id that has the text and a hash of the text. Classes are the connected
components; a class is named by its smallest doc_id.

Defined cases: a text without words (null included) is a class of its own; a null doc_id has a null class; rows with the same
doc_id share a class, as one document; equal rows are equal texts; an empty table gives an empty one; other columns play no part.
keep_one() goes by texts alone, so different texts that share a doc_id are judged each for itself and none is lost for its id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.llm import wordscan as ws
from readloom.llm.common import col_of, free_name, slices, staged, text_bytes

SHINGLE, THRESHOLD = 5, 0.8
#: 1 - (1 - 0.8 ** 4) ** 16 = 0.9998: the chance that two texts of similarity 0.8 share a band.
BANDS, ROWS = 16, 4
#: The share of similar pairs that the signatures may leave out.
MISSED = 1e-6
#: A block of texts of a bucket is about so many texts and bytes at most.
BLOCK_TEXTS, BLOCK_BYTES, COLUMNS = 64, 1 << 20, 4096
HAS_WORD = r"[^\x20\x09-\x0D]"
NODE = "struct<doc:long,h1:long>"


def elements(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, weight) of each distinct shingle of each text, by text: its weight is how often it is there."""
    w = ws.words(raw, at)
    whole = ws.gram_starts(w, SHINGLE)
    doc, gram = w.doc[: len(whole)][whole], ws.grams(w.hash, SHINGLE)[whole]
    count = np.diff(w.first)
    short = np.flatnonzero((count > 0) & (count < SHINGLE))
    if len(short):
        total = np.zeros(len(short), np.uint64)
        with np.errstate(over="ignore"):
            for j in range(SHINGLE):
                has = count[short] > j
                total[has] = ws.mix(total[has] * ws.MULT + w.hash[w.first[short[has]] + j])
        doc, gram = np.concatenate([doc, short]), np.concatenate([gram, total])
    order = np.lexsort((gram, doc))
    doc, gram = doc[order], gram[order]
    first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (gram[1:] != gram[:-1])])) if len(doc) else order
    return doc[first], gram[first], np.diff(np.append(first, len(doc))).astype(np.float64)


def _uniform(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53


def regions(weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(element, region) for each region that a positive weight reaches into: 0 is 0..1, r is 2**(r - 1)..2**r."""
    reach = np.maximum(np.ceil(np.log2(weight)), 0).astype(np.int64) + 1
    owner = np.repeat(np.arange(len(weight)), reach)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(reach) - reach, reach)


def signatures(doc: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n: int, k: int) -> np.ndarray:
    """n x k: the earliest dart of each coordinate; zeros for texts without weight. Horizons double until every coordinate is hit."""
    out = np.zeros((n, k), np.uint64)
    total = np.bincount(doc, weight, minlength=n)
    horizon = k * (np.log(k) + 5) / np.where(total > 0, total, 1)
    owner, region = regions(weight)
    low = np.where(region > 0, 2.0 ** (region - 1), 0.0)
    width = np.maximum(low, 1.0)
    with np.errstate(over="ignore"):
        seed = ws.mix(shingle[owner] + region.astype(np.uint64) * ws.MIX1)
    todo = total > 0
    while todo.any():
        some = np.flatnonzero(todo[doc[owner]])
        at, s, t = owner[some], seed[some], np.zeros(len(some))
        low_here, width_here, end = low[some], width[some], horizon[doc[at]]
        parts, number = [], 0
        while len(at):  # the next dart of a region comes an exponential gap later
            with np.errstate(over="ignore"):
                dart = ws.mix(s + np.uint64(number + 1) * ws.MIX2)
                t = t - np.log(_uniform(ws.mix(dart ^ ws.MULT))) / width_here
                place = low_here + width_here * _uniform(ws.mix(dart ^ ws.MIX2))
            here = t < end
            hit = here & (place < weight[at])
            parts.append((doc[at[hit]], dart[hit], t[hit]))
            at, s, t, low_here, width_here, end = (x[here] for x in (at, s, t, low_here, width_here, end))
            number += 1
        d, dart, t = (np.concatenate(x) for x in zip(*parts))
        late = np.argsort(-t, kind="stable")
        cell = (d * k + (ws.mix(dart + ws.MIX1) % np.uint64(k)).astype(np.int64))[late]
        hit = np.zeros(n * k, bool)
        hit[cell] = True
        flat = np.zeros(n * k, np.uint64)
        flat[cell] = dart[late]  # of several darts in a cell the last written, so the earliest, stays
        full = hit.reshape(n, k).all(1) & todo
        out[full] = flat.reshape(n, k)[full]
        todo &= ~full
        horizon *= 2
    return out


def fewest_agreements(k: int, threshold: float, missed: float = MISSED) -> int:
    """The most coordinates of which pairs of this similarity agree on fewer with a chance of at most `missed`."""
    below, m = (1 - threshold) ** k, 0
    while below <= missed and m < k:
        m += 1
        below += math.comb(k, m) * threshold**m * (1 - threshold) ** (k - m)
    return m


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    key = np.zeros((len(signature), bands), np.uint64)
    parts = signature.reshape(len(signature), bands, rows)
    with np.errstate(over="ignore"):
        for j in range(rows):
            key = ws.mix(key * ws.MULT + parts[:, :, j] + np.uint64(1))
        return ws.mix(key + np.arange(bands, dtype=np.uint64))


def _signed(batches: Iterator[pa.RecordBatch], bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    """keys: a hash of each band. marks: 16 bits of each coordinate."""
    for batch in slices(batches):
        n = batch.num_rows
        s = signatures(*elements(*text_bytes(col_of(batch, "text"))), n, bands * rows)
        keys = band_keys(s, bands, rows).view(np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * bands), pa.array(keys.ravel()))
        marks = pa.array([x.tobytes() for x in s.astype("<u2")], pa.binary())
        same = ["node", "h2", "size"]
        yield pa.RecordBatch.from_arrays([col_of(batch, c) for c in same] + [lists, marks], names=[*same, "keys", "marks"])


def _similar(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in slices(slices(batches, "text_a"), "text_b"):
        n = batch.num_rows
        (da, ga, wa), (db, gb, wb) = (elements(*text_bytes(col_of(batch, c))) for c in ("text_a", "text_b"))
        doc, gram, weight = np.concatenate([da, db]), np.concatenate([ga, gb]), np.concatenate([wa, wb])
        order = np.lexsort((gram, doc))
        doc, gram, weight = doc[order], gram[order], weight[order]
        same = np.flatnonzero((doc[1:] == doc[:-1]) & (gram[1:] == gram[:-1]))
        common = np.bincount(doc[same], np.minimum(weight[same], weight[same + 1]), minlength=n)
        union = np.bincount(doc, weight, minlength=n) - common
        good = (common >= threshold * union) & (union > 0)
        yield pa.RecordBatch.from_arrays([col_of(batch, c).filter(pa.array(good)) for c in ("a", "b")], names=["a", "b"])


def _open_pairs(batch: pa.RecordBatch, threshold: float, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of rows whose texts have to be compared: of different roots and sides, with no earlier band in common, as there
    they are compared, and with marks that agree often enough."""
    n, root = batch.num_rows, col_of(batch, "root")
    doc, h1 = (root.field(c).to_numpy() for c in ("doc", "h1"))
    side, band = col_of(batch, "side").to_numpy(), int(col_of(batch, "band")[0].as_py())
    marks = np.frombuffer(b"".join(col_of(batch, "marks").to_pylist()), "<u2").reshape(n, -1)
    pairs = np.triu((doc[:, None] != doc[None, :]) | (h1[:, None] != h1[None, :]))
    if side.any():
        pairs &= side[:, None] != side[None, :]
    a, b = np.nonzero(pairs)
    agree = marks[a] == marks[b]
    before = agree[:, : band * rows].reshape(len(a), band, rows).all(2).any(1)
    good = ~before & (agree.sum(1) >= fewest_agreements(marks.shape[1], threshold))
    return a[good], b[good]


def _maybe(table: pa.Table, threshold: float, rows: int) -> pa.Table:
    """Those of the rows of two blocks that are in a pair to be compared."""
    batch = table.combine_chunks().to_batches()[0]
    a, b = _open_pairs(batch, threshold, rows)
    return pa.table({c: col_of(batch, c) for c in ("pair", "side", "band", "root", "node", "marks")}).take(np.unique(np.concatenate([a, b])))


def _across(table: pa.Table, threshold: float, rows: int) -> pa.Table:
    """The pairs of roots that two texts of these rows link."""
    batch = table.combine_chunks().to_batches()[0]
    n, root = batch.num_rows, col_of(batch, "root")
    a, b = _open_pairs(batch, threshold, rows)
    if len(a):
        doc, gram, weight = elements(*text_bytes(col_of(batch, "text")))
        total = np.bincount(doc, weight, minlength=n)
        # Each unit of weight is a column: of two texts, those in common are the units that both have.
        at = np.repeat(np.arange(len(doc)), weight.astype(np.int64))
        unit = np.arange(len(at)) - np.repeat(np.cumsum(weight.astype(np.int64)) - weight.astype(np.int64), weight.astype(np.int64))
        order = np.lexsort((unit, gram[at]))
        doc, gram, unit = doc[at][order], gram[at][order], unit[order]
        number = np.cumsum(np.concatenate([[False], (gram[1:] != gram[:-1]) | (unit[1:] != unit[:-1])]))
        twice = np.bincount(number) > 1  # a unit of one text only is common to no two
        doc, column = doc[twice[number]], (np.cumsum(twice) - 1)[number[twice[number]]]
        common = np.zeros((n, n))
        for c in range(0, int(twice.sum()), COLUMNS):
            i, j = np.searchsorted(column, [c, c + COLUMNS])
            has = np.zeros((n, COLUMNS), np.float32)
            has[doc[i:j], column[i:j] - c] = 1
            common += has @ has.T
        good = common[a, b] >= threshold * (total[a] + total[b] - common[a, b])
        a, b = a[good], b[good]
    return pa.table({"a": root.take(pa.array(a)), "b": root.take(pa.array(b))})


def buckets(nodes: DataFrame) -> DataFrame:
    """node, key, band, fine, lead and n (the size) of each bucket of more than one, of nodes (node, keys)."""
    n = F.size("keys")
    finer = F.transform("keys", lambda x, i: F.struct(x.alias("key"), i.alias("band"), F.xxhash64(x, F.get("keys", (i + 1) % n)).alias("fine")))
    rows = nodes.select("node", F.explode(finer).alias("x")).select("node", "x.key", "x.band", "x.fine")
    # Staged, as a join with an aggregate of the same stage can't be split where a bucket has a large share of the rows.
    lead = staged(rows.groupBy("key").agg(F.min("node").alias("lead"), F.count("*").alias("n")).where("n > 1"), "leads")
    return staged(rows.join(lead, "key"), "buckets")


def candidates(in_buckets: DataFrame) -> DataFrame:
    """Distinct pairs a > b to compare first, of buckets."""
    fine = in_buckets.where("n > 2").groupBy("fine").agg(F.min("node").alias("lead2"), F.count("*").alias("m")).where("m > 1").select("fine", "lead2")
    fine = staged(fine, "fine-leads")
    first = in_buckets.select(F.col("node").alias("a"), F.col("lead").alias("b"))
    second = in_buckets.where("n > 2").join(fine, "fine").select(F.col("node").alias("a"), F.col("lead2").alias("b"))
    return first.union(second).where("a > b").distinct()


def _texts(docs: DataFrame) -> DataFrame:
    """node (the row's own id and a hash of its text) and text of each row that has both."""
    text = F.col("text").cast("string")
    rows = docs.where("doc_id is not null").where(text.rlike(HAS_WORD))
    return rows.select(F.struct(F.col("doc_id").cast("long").alias("doc"), F.xxhash64("text").alias("h1")).alias("node"), text.alias("text"))


def _one_each(texts: DataFrame, repeated: DataFrame) -> DataFrame:
    """texts with one row for each node. repeated: the nodes of several rows, a staged table, so only their texts are grouped."""
    one = texts.join(repeated, "node", "left_semi").groupBy("node").agg(F.min("text").alias("text"))
    return texts.join(repeated, "node", "left_anti").unionByName(one)


def links(texts: DataFrame, pairs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The pairs (a, b) of nodes whose texts have at least this weighted Jaccard similarity. texts: one row for each node."""
    one = pairs.join(texts.withColumnsRenamed({"node": "a", "text": "text_a"}), "a")
    two = one.join(texts.withColumnsRenamed({"node": "b", "text": "text_b"}), "b")
    return two.select("a", "b", "text_a", "text_b").mapInArrow(lambda it: _similar(it, threshold), f"a {NODE}, b {NODE}")


def links_across(texts: DataFrame, nodes: DataFrame, in_buckets: DataFrame, roots: DataFrame, threshold: float = THRESHOLD, rows: int = ROWS) -> DataFrame:
    """The pairs (a, b) of roots linked by texts that share a band, of nodes (node, size, marks) and roots (node, root) so far.

    A class with many texts in a bucket has blocks of its own; smaller ones share blocks. Two blocks of one class aren't compared.
    """
    members = in_buckets.where("n > 2").select("key", "band", "node").join(roots, "node", "left").select("key", "band", "node", F.coalesce("root", "node").alias("root"))
    several = members.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
    members = staged(members.join(staged(several, "several-roots"), "key").join(nodes.select("node", "size"), "node"), "mixed")

    def parts() -> Column:
        return F.greatest(F.ceil(F.sum("n") / BLOCK_TEXTS), F.ceil(F.sum("size") / BLOCK_BYTES), F.lit(1)).alias("parts")

    sums = members.groupBy("key", "root").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    sums = sums.withColumn("own", (F.col("n") >= BLOCK_TEXTS) | (F.col("size") >= BLOCK_BYTES))
    nobody = F.lit(0).cast("long")
    sums = sums.withColumn("class", F.when(F.col("own"), F.col("root")).otherwise(F.struct(nobody.alias("doc"), nobody.alias("h1"))))
    counts = staged(sums.groupBy("key", "own", "class").agg(parts()), "blocks")
    which = staged(sums.select("key", "root", "own", "class").join(counts, ["key", "own", "class"]), "which")
    part = F.pmod(F.xxhash64("node"), F.col("parts"))
    placed = members.join(which, ["key", "root"]).select("key", "band", "root", "node", F.struct("own", "class", part.alias("part")).alias("block"))
    blocks = counts.select("key", "own", "class", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    blocks = blocks.select("key", F.struct("own", "class", "part").alias("x"))
    pairs = blocks.join(blocks.withColumnRenamed("x", "y"), "key").where("x <= y").where("NOT (x.own AND y.own AND x.class = y.class)")
    sides = F.when(F.col("x") < F.col("y"), F.array("x", "y")).otherwise(F.array("x"))
    ends = pairs.select("key", F.xxhash64("key", "x", "y").alias("pair"), F.posexplode(sides).alias("side", "block"))
    marked = placed.join(nodes.select("node", "marks"), "node")
    both = ends.join(marked, ["key", "block"]).select("pair", "side", "band", "root", "node", "marks")
    kept = f"pair long, side int, band int, root {NODE}, node {NODE}, marks binary"
    maybe = staged(both.groupBy("pair").applyInArrow(lambda t: _maybe(t, threshold, rows), kept), "maybe")
    wanted = staged(maybe.select("node").distinct(), "wanted")
    found = maybe.join(texts.join(wanted, "node", "left_semi"), "node").groupBy("pair").applyInArrow(lambda t: _across(t, threshold, rows), f"a {NODE}, b {NODE}")
    return found.distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b): root is the least node connected with it. Large and small stars in turn."""
    now = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    last = None
    while True:
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if state == last:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v").distinct())
        last = state
        # Large star: the larger neighbours of each node go to the least of its neighbourhood.
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: a node and its smaller neighbours go to the least of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        now = staged(small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(least.select("u", "m")).distinct(), "edges")


def _classes(docs: DataFrame, threshold: float, bands: int, rows: int, tied: bool) -> DataFrame:
    """doc, h1, root for each distinct (doc_id, text) that has words. tied: all texts of a doc_id are linked."""
    texts = _texts(docs)
    hashed = texts.select("node", F.xxhash64(F.lit("2"), "text").alias("h2"), F.octet_length("text").cast("long").alias("size"), "text")
    signed = staged(hashed.mapInArrow(lambda it: _signed(it, bands, rows), f"node {NODE}, h2 long, size long, keys array<long>, marks binary"), "signatures")
    repeated = staged(signed.groupBy("node").agg(F.count("*").alias("n")).where("n > 1").select("node"), "repeated")
    texts = _one_each(texts, repeated)
    # Equal texts go on as that of the smallest id.
    same = [F.col("node.h1").alias("h1"), "h2"]
    nodes = signed.groupBy(*same).agg(F.min("node").alias("node"), F.first("size").alias("size"), F.min_by("keys", "node").alias("keys"), F.min_by("marks", "node").alias("marks"))
    nodes = staged(nodes, "nodes")
    in_buckets = buckets(nodes.select("node", "keys"))
    linked = links(texts, candidates(in_buckets), threshold)
    members = signed.select(F.col("node.doc").alias("doc"), *same).distinct().join(nodes.select("h1", "h2", "node"), ["h1", "h2"])
    members = staged(members.select("doc", "h1", "node"), "members")
    if tied:
        low = members.groupBy("doc").agg(F.min("node").alias("b"), F.max("node").alias("high")).where("b < high")
        linked = linked.union(members.join(staged(low, "several-texts"), "doc").select(F.col("node").alias("a"), "b"))
    roots = components(linked)
    joined = components(links_across(texts, nodes, in_buckets, roots, threshold, rows)).select(F.col("node").alias("root"), F.col("root").alias("last"))
    first = members.join(roots, "node", "left").select("doc", "h1", F.coalesce("root", "node").alias("root"))
    return first.join(joined, "root", "left").select("doc", "h1", F.coalesce("last", "root").alias("root"))


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row for each row of docs: doc_id, class_id."""
    classes = _classes(docs, threshold, bands, rows, True).groupBy("doc").agg(F.min("root.doc").alias("class_id"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id")).join(classes, F.col("doc_id") == F.col("doc"), "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))


def keep_one(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """docs with one row of each class of near-duplicate texts: one that has the class's text of the smallest id.

    Of rows with that id and text, the one of the least hash of all columns stays. Rows with a null id or without words stay.
    """
    classes = staged(_classes(docs.select("doc_id", "text"), threshold, bands, rows, False), "classes")
    gone = classes.where((F.col("root.doc") != F.col("doc")) | (F.col("root.h1") != F.col("h1"))).select("doc", "h1")
    key = [free_name(docs, c) for c in ("key_doc", "key_h1")]
    has_words = F.col("text").cast("string").rlike(HAS_WORD) & F.col("doc_id").isNotNull()
    own = [F.col("doc_id").cast("long"), F.xxhash64("text")]

    def on(keys: DataFrame) -> tuple[DataFrame, Column]:
        return keys.select(F.col("doc").alias(key[0]), F.col("h1").alias(key[1])), (own[0] == F.col(key[0])) & (own[1] == F.col(key[1]))

    # Rows that repeat id and text are few as a rule: their keys are staged, so the plan knows.
    again = docs.where(has_words).groupBy(own[0].alias("doc"), own[1].alias("h1")).agg(F.count("*").alias("n")).where("n > 1")
    again = staged(again.select("doc", "h1"), "repeated-rows")
    every = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    named, same = on(again.join(gone, ["doc", "h1"], "left_anti"))
    one = docs.where(has_words).join(named, same).groupBy(*key).agg(F.min_by(every, F.xxhash64(every)).alias("row")).select("row.*")
    return docs.join(*on(again), "left_anti").join(*on(gone), "left_anti").unionByName(one)
