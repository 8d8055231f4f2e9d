"""Toxicity: a factorization machine over hashed terms, fitted on labelled rows, scores whole texts.

Terms are lower-cased words (runs of ASCII letters and digits and of bytes beyond ASCII) and their first 4, 5 and 6 bytes, which
stand for a stem whatever its ending, all hashed to `BUCKETS` numbers. A number is a binary feature if at least `LEAST_ROWS`
training rows have it and it goes with the label more than chance allows, or if at least a tenth of the rows have it, as such
may matter in a pair alone; there is no limit to their number. The machine adds a weight for each and a product of learned
vectors for each pair, so a pair such as an insult and a group can count for more than both alone.

At most `max_rows` labelled documents are fitted on, the first by a hash of their id, and of these as many as have `max_bytes`
of text together. Defined cases: a doc_id of several rows is fitted on once, with the least of its texts; a null or empty text has the
score of the bias alone; null ids are never in the training rows; a row of docs is scored for itself, repeated or not; a doc_id
with several labels is toxic if one says so; without labels of both classes the score is the share of toxic rows, or 0; an
empty table gives an empty table; other columns play no part. Labels, lang, source and doc_id are no inputs of a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from readloom.llm import wordscan as ws
from readloom.llm.common import broadcast, col_of, slices, text_bytes

BUCKETS, FACTORS, FOLDS = 1 << 20, 8, 5
#: Bounds of the training sample; the rows that a feature needs; chi-square that chance is over once in twenty times.
MAX_ROWS, MAX_BYTES, LEAST_ROWS, CHANCE = 12_000, 128 << 20, 5, 3.84
STEMS = (4, 5, 6)
STEPS, BATCH, RATE = 160, 1_000, 0.02


@dataclass
class Machine:
    feature: np.ndarray  # of each bucket, or -1
    bias: float
    weight: np.ndarray
    vectors: np.ndarray

    def logits(self, doc: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
        """doc, term: the distinct features of n rows."""
        out = self.bias + np.bincount(doc, self.weight[term], n)
        for f in range(self.vectors.shape[1]):
            v = self.vectors[term, f]
            out += 0.5 * (np.bincount(doc, v, n) ** 2 - np.bincount(doc, v * v, n))
        return out


def distinct_terms(column: pa.Array, feature: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(row, term) of each distinct term of each text: its bucket, or its feature if there is one."""
    raw, at = text_bytes(pc.utf8_lower(column.cast(pa.large_string())))
    w = ws.words(raw, at, normal=True)
    hashes, docs = [w.hash], [w.doc]
    for n in STEMS:
        longer = w.end - w.start > n
        start = w.start[longer]
        hashes.append(ws.mix(ws.hashes(raw, start, start + n) ^ np.uint64(n)))
        docs.append(w.doc[longer])
    term, doc = (np.concatenate(hashes) % np.uint64(BUCKETS)).astype(np.int64), np.concatenate(docs)
    if feature is not None:
        term = feature[term]
        doc, term = doc[term >= 0], term[term >= 0]
    both = np.unique(doc * BUCKETS + term)
    return both // BUCKETS, both % BUCKETS


def chosen_buckets(doc: np.ndarray, bucket: np.ndarray, label: np.ndarray) -> np.ndarray:
    n, positive = len(label), label.sum()
    df = np.bincount(bucket, minlength=BUCKETS).astype(float)
    expected = df * positive / n
    with np.errstate(divide="ignore", invalid="ignore"):
        chi = (np.bincount(bucket, label[doc], minlength=BUCKETS) - expected) ** 2 / (expected * (1 - positive / n) * (1 - df / n) + 1e-9)
    return np.flatnonzero((df >= LEAST_ROWS) & ((chi > CHANCE) | (df >= 0.1 * n)))


def fit(doc: np.ndarray, bucket: np.ndarray, label: np.ndarray, factors: int = FACTORS, steps: int = STEPS) -> Machine:
    """From the distinct buckets of each row: Adam, one batch of rows a step, in turn."""
    n, positive = len(label), label.sum()
    none = Machine(np.full(BUCKETS, -1, np.int32), float(np.log((positive + 1e-9) / (n - positive + 1e-9))), np.zeros(1), np.zeros((1, 1)))
    if not 0 < positive < n:
        none.bias = 40.0 if n and positive == n else -40.0
        return none
    used = chosen_buckets(doc, bucket, label)
    if not len(used):
        return none
    feature = np.full(BUCKETS, -1, np.int32)
    feature[used] = np.arange(len(used))
    term = feature[bucket]
    rng = np.random.default_rng(1)
    place = rng.permutation(n)  # rows in a random order, of which batches are stretches
    doc, term, shuffled = place[doc[term >= 0]], term[term >= 0], np.empty(n)
    shuffled[place] = label
    order = np.argsort(doc, kind="stable")
    doc, term = doc[order], term[order]
    m = Machine(feature, none.bias, np.zeros(len(used)), rng.normal(0, 0.02, (len(used), factors)))
    moments: dict[str, tuple] = {}
    batches = [(a, min(n, a + BATCH), *np.searchsorted(doc, [a, min(n, a + BATCH)])) for a in range(0, n, BATCH)]
    for t in range(1, steps + 1):
        low, high, i, j = batches[t % len(batches)]
        d, x, share = doc[i:j] - low, term[i:j], (high - low) / n
        error = 1 / (1 + np.exp(-np.clip(m.logits(d, x, high - low), -700, 700))) - shuffled[low:high]
        grads = {"bias": error.sum(), "weight": np.bincount(x, error[d], len(used)) + 0.5 * share * m.weight, "vectors": np.zeros_like(m.vectors)}
        for f in range(m.vectors.shape[1]):
            v = m.vectors[x, f]
            total = np.bincount(d, v, high - low)
            grads["vectors"][:, f] = np.bincount(x, error[d] * (total[d] - v), len(used)) + share * m.vectors[:, f]
        for name, g in grads.items():
            a, b = moments.get(name, (0.0, 0.0))
            a, b = 0.9 * a + 0.1 * g, 0.999 * b + 0.001 * g * g
            moments[name] = a, b
            setattr(m, name, getattr(m, name) - RATE * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8))
    return m


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES, factors: int = FACTORS) -> Machine:
    """Fitted on labelled rows whose id is not held out: at most max_rows documents, the first by a hash of the id, of max_bytes."""
    one = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("double").alias("label"))
    chosen = one.where(~held_out()).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    known = {r["doc_id"]: r["label"] for r in chosen.collect()}  # max_rows at most
    chosen = docs.sparkSession.createDataFrame(list(known.items()), "id long, label double")
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    texts = texts.join(F.broadcast(chosen), "id").groupBy("id").agg(F.min("text").alias("text"), F.first("label").alias("label")) if known else texts.where("false").withColumn("label", F.lit(0.0))
    # The sample has max_rows rows at most, so their sizes are added up in one task.
    so_far = W.Window.orderBy(F.xxhash64("id"), "id").rowsBetween(W.Window.unboundedPreceding, 0)
    sized = texts.select("id", F.octet_length("text").alias("size")).withColumn("bytes", F.sum("size").over(so_far))
    texts = texts.join(F.broadcast(sized.where(F.col("bytes") <= max_bytes).select("id")), "id")

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            doc, bucket = distinct_terms(col_of(batch, "text"), None)
            at = np.searchsorted(doc, np.arange(batch.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([col_of(batch, "id"), col_of(batch, "label"), pa.ListArray.from_arrays(pa.array(at), pa.array(bucket.astype(np.int32)))], names=["id", "label", "terms"])

    got = texts.mapInArrow(terms, "id long, label double, terms array<int>").toArrow().sort_by("id")
    lists = got["terms"].combine_chunks()
    lists = lists if isinstance(lists, pa.ListArray) else pa.concat_arrays(lists.chunks) if lists.num_chunks else pa.array([], pa.list_(pa.int32()))
    sizes = np.array([len(x) for x in lists], np.int64)
    return fit(np.repeat(np.arange(len(sizes)), sizes), lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), got["label"].to_numpy(), factors)


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """row (a struct of the columns of docs) and score."""
    shared = broadcast(docs.sparkSession, machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared()
        for batch in slices(batches, "text"):
            doc, term = distinct_terms(col_of(batch, "text"), m.feature)
            p = 1 / (1 + np.exp(-np.clip(m.logits(doc, term, batch.num_rows), -700, 700)))
            yield pa.RecordBatch.from_arrays([col_of(batch, "row"), pa.array(p)], names=["row", "score"])

    body = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").cast("string").alias("text"))
    kind = body.schema["row"].dataType.simpleString()
    return body.mapInArrow(run, f"row {kind}, score double")


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs."""
    machine = learn(docs, labels)
    scored = score(docs.select("doc_id", "text"), machine).select(F.col("row.doc_id").alias("doc_id"), "score")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows of a score of 0.5 or more."""
    scored = score(docs, learn(docs, labels)).where("score < 0.5")
    return scored.select("row.*")
