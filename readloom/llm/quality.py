"""Quality rules whose cutoffs are controlled for risk: no stratum loses more than a small share of its good documents.

Each rule compares one statistic of a text with a cutoff. The rules are tightened together in a fixed order of steps, from the
laxest to the strictest, so a text has a first step that rejects it by some rule. The step is chosen on labelled documents
(quality 1: good): for each stratum (the language) and step, the hypothesis that the step rejects more than `max_loss` of the
stratum's good documents is tested by the exact binomial tail, and the strictest step up to which every test rejects its
hypothesis is taken. Testing in a fixed order needs no correction along the steps; over strata the level is divided in
proportion to their good labels (weighted Bonferroni). So with probability 1 - `error` no stratum loses more than `max_loss` of
its good documents to all rules together. A stratum with too few labels gets no step: about 220 are needed at a level of 0.0125.

Defined cases: a null or empty text has no words and fails the base rule; a null lang is a stratum of its own; a null or
unlabelled doc_id takes no part in choosing steps; of several labels the lowest counts; repeated rows are judged each for itself,
and a doc_id of several rows counts once, as the row that the earliest step rejects; an empty table gives an empty table; other
columns play no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from readloom.llm import wordscan as ws
from readloom.llm.common import col_of, slices, staged, text_bytes

MAX_LOSS, ERROR = 0.02, 0.05
GRAM = 5
SYMBOLS = b"#*$%&|<>"
STATS = "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long, n_digits long"
#: Statistic and its cutoffs, one for each step. All reject what is above the cutoff.
RULES = {
    "symbols_per_word": ("n_symbols / greatest(n_words, 1)", [2.0, 1.5, 1.0, 0.75, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.05]),
    "chars_per_word": ("word_chars / greatest(n_words, 1)", [30.0, 25.0, 20.0, 17.0, 15.0, 13.0, 12.0, 11.0, 10.5, 10.0, 9.5, 9.0]),
    "repeated_words": ("n_repeat_words / greatest(n_words, 1)", [0.9, 0.8, 0.7, 0.6, 0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.22, 0.2]),
    "repeated_lines": ("n_dup_lines / greatest(n_lines, 1)", [0.9, 0.85, 0.8, 0.75, 0.7, 0.65, 0.6, 0.55, 0.5, 0.45, 0.4, 0.35]),
    "upper_case": ("n_upper / greatest(word_chars, 1)", [0.9, 0.85, 0.8, 0.7, 0.6, 0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2]),
    "digits": ("n_digits / greatest(word_chars, 1)", [0.9, 0.85, 0.8, 0.75, 0.7, 0.65, 0.6, 0.55, 0.5, 0.45, 0.4, 0.35]),
}
STEPS = len(RULES["digits"][1])
#: Strata with a step up to this number are sent to all executors; more are joined.
FEW_STRATA = 10_000


def _sums(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[at])


def repeated_words(w: ws.Words, n: int) -> np.ndarray:
    """For each text how many words stand in a window of five that the text has twice or more."""
    whole = np.flatnonzero(ws.gram_starts(w, GRAM))
    with np.errstate(over="ignore"):
        g = ws.mix(ws.grams(w.hash, GRAM)[whole] + w.doc[whole].astype(np.uint64) * ws.MULT)
    order = np.argsort(g, kind="stable")
    same = g[order][1:] == g[order][:-1]
    twice = np.concatenate([[False], same]) | np.concatenate([same, [False]]) if len(order) else same
    marks = np.zeros(len(w.hash) + 1, np.int32)
    start = whole[order[twice]]
    np.add.at(marks, start, 1)
    np.add.at(marks, start + GRAM, -1)
    return _sums(np.cumsum(marks)[:-1] > 0, w.first)


def repeated_lines(text: bytes | None) -> tuple[int, int]:
    lines = (text or b"").split(b"\n")
    if len(set(lines)) == len(lines):
        return 0, len(lines)
    seen, n = set(), 0
    for line in lines:
        if line in seen:
            n += bool(line.strip(b" \t\n\v\f\r"))
        else:
            seen.add(line)
    return n, len(lines)


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    symbol, upper, digit = (np.isin(np.arange(256), list(x)) for x in (SYMBOLS, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789"))
    letters = ws.byte_classes(False) & ~((np.arange(256) & 0xC0) == 0x80)  # the first byte of each character of a word
    for batch in slices(batches):
        raw, at = text_bytes(col_of(batch, "text"))
        w = ws.words(raw, at)
        lines = [repeated_lines(t) for t in col_of(batch, "text").cast(pa.binary()).to_pylist()]
        numbers = [np.diff(w.first), _sums(letters[raw], at), _sums(symbol[raw], at), np.array([x[0] for x in lines]), repeated_words(w, batch.num_rows), np.array([x[1] for x in lines]), _sums(upper[raw], at), _sums(digit[raw], at)]
        yield pa.RecordBatch.from_arrays([col_of(batch, "doc_id"), col_of(batch, "lang")] + [pa.array(x.astype(np.int64)) for x in numbers], names=[x.split()[0] for x in STATS.split(", ")])


def text_stats(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_stats, STATS)


def tail(n: int, k: int, p: float) -> float:
    """P(X <= k) for X binomial with n trials of probability p: the regularized incomplete beta function I(1 - p; n - k, k + 1)."""
    if k >= n:
        return 1.0
    a, b = n - k, k + 1
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log1p(-p) + b * math.log(p))
    if 1 - p < (a + 1) / (a + b + 2):
        return min(1.0, front / (a * _fraction(a, b, 1 - p)))
    return max(0.0, 1 - front / (b * _fraction(b, a, p)))


def _fraction(a: int, b: int, x: float) -> float:
    """The continued fraction 1 + d1 / (1 + d2 / (1 + ...)) of the incomplete beta function, by its convergents from the front."""
    value, c, d = 1.0, 1.0, 0.0
    for i in range(1, 1_000_000):
        m = i // 2
        term = m * (b - m) * x / ((a + i - 1) * (a + i)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + i - 1) * (a + i))
        d = 1 / (1 + term * d or 1e-300)
        c = 1 + term / c or 1e-300
        value *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return value


def strictest(n: int, rejected: list[int], level: float, max_loss: float) -> int:
    """The last step before the first that isn't shown to reject at most max_loss; -1 if that is the first.

    rejected: of n good documents how many each step rejects.
    """
    for step, k in enumerate(rejected):
        if k > max_loss * n or tail(n, k, max_loss) > level:
            return step - 1
    return len(rejected) - 1


def rule_steps(rule: str) -> Column:
    """The first step whose cutoff the statistic is above; STEPS if there is none."""
    value, grid = RULES[rule]
    return sum((F.expr(value) <= F.lit(c)).cast("int") for c in grid)


def steps(stats: DataFrame, labels: DataFrame, max_loss: float = MAX_LOSS, error: float = ERROR) -> DataFrame:
    """lang, step: the step of each stratum that has a safe one. stats has the column step: the first that rejects the row."""
    good = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1").select("doc_id")
    held = stats.where("not base_failed").groupBy("doc_id").agg(F.min(F.struct("step", "lang")).alias("x")).join(good, "doc_id").select("x.*")
    counts = F.array(*[F.count_if(F.col("step") <= i) for i in range(STEPS)])
    per = staged(held.groupBy("lang").agg(F.count("*").alias("n"), counts.alias("rejected")), "label-counts")
    total = per.agg(F.sum("n")).first()[0] or 1

    @F.pandas_udf(T.IntegerType())
    def choose(n: pd.Series, rejected: pd.Series) -> pd.Series:
        return pd.Series([strictest(int(m), [int(k) for k in ks], error * int(m) / total, max_loss) for m, ks in zip(n, rejected)], dtype="int32")

    return per.select("lang", choose("n", "rejected").alias("step")).where("step >= 0")


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The statistics of each row of docs, base_failed, failed_rules (names) and kept."""
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    stats = text_stats(docs).withColumn("base_failed", base).withColumn("step", F.least(*[rule_steps(r) for r in RULES]))
    stats = staged(stats, "quality")
    chosen = staged(steps(stats, labels), "steps").select(F.col("lang").alias("stratum"), F.col("step").alias("last"))
    chosen = F.broadcast(chosen) if chosen.count() <= FEW_STRATA else chosen
    joined = stats.join(chosen, F.col("lang").eqNullSafe(F.col("stratum")), "left")
    broken = [F.when(rule_steps(r) <= F.col("last"), F.lit(r)) for r in RULES]
    out = joined.withColumn("failed_rules", F.array_compact(F.array(*broken)))
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0)).drop("stratum", "last", "step")
