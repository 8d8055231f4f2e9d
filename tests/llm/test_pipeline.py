"""The pipeline: its stages over the smallest tables, and over planted ones against brute force."""

import random
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest

import corpus_pipeline
from readloom.llm import decontam, packing, toxicity
from readloom.llm.queries import QUERIES
from tests.llm.conftest import SCHEMA, words
from tests.llm.test_decision_ops import edited
from tests.llm.test_text_ops import best_fit, line_key, shingles

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(SF).exists(), reason="no tables here")
def test_stages_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, docs.count()
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / f"{i}-{name}"))
        before, docs = docs, spark.read.parquet(str(tmp_path / f"{i}-{name}"))
        if i + 1 < len(corpus_pipeline.STAGES):
            assert docs.columns == columns
            assert docs.select("doc_id").exceptAll(before.select("doc_id")).count() == 0
            seen, last = docs.count(), docs
    assert {r["doc_id"] for r in docs.select("doc_id").distinct().collect()} == {r["doc_id"] for r in last.select("doc_id").collect()}
    assert 0 < seen


def test_every_number_has_its_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """(folder, rows, labels, items): toxic documents, shared lines, near copies, leaks, null and repeated ids."""
    rng = random.Random(41)
    line = words(rng, 14)
    rows = [(i, words(rng, rng.randint(30, 90)) + ("\n" + line if i % 9 == 0 else "")) for i in range(120)]
    for i in range(0, 120, 4):
        w = rows[i][1].split(" ")
        rows[i] = (i, " ".join([*w[:3], "blockhead", *w[3:]]))
    labels = [(i, 1, int(i % 4 == 0)) for i in range(120)]
    base = words(rng, 150)
    rows += [(200 + i, base if i < 3 else edited(rng, base, 2)) for i in range(8)]
    items = [(i, words(rng, rng.randint(15, 40))) for i in range(6)]
    rows += [(300 + i, words(rng, 40) + " " + (t if i % 2 else edited(rng, t, 1)) + " " + words(rng, 20)) for i, t in items]
    rows += [(None, words(rng, 50)), (None, words(rng, 40) + " blockhead"), (None, items[1][1]), (400, words(rng, 60)), (400, words(rng, 60)), (400, items[3][1] + " x"), (401, ""), (402, None)]
    path = str(tmp_path_factory.mktemp("planted"))
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], ", ".join(SCHEMA.split(", ")[:5])).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows, labels, items


def without_toxic(rows, machine):
    def score(t):
        terms = {int(x) for x in toxicity.distinct_terms(decontam.pa.array([t or ""]), machine.feature)[1]}
        pairs = sum(machine.vectors[a] @ machine.vectors[b] for a in terms for b in terms if a < b)
        return machine.bias + sum(machine.weight[x] for x in terms) + pairs

    return [r for r in rows if score(r[1]) < 0]


def without_lines(rows):
    key = lambda d: -(2**63) if d is None else d
    holders = defaultdict(set)
    for d, t in rows:
        for x in (t or "").split("\n"):
            if len(line_key(x)) >= 40:
                holders[line_key(x)].add(key(d))
    top = {k: max(v) for k, v in holders.items() if len(v) >= 5}
    return [(d, "\n".join(x for x in (t or "").split("\n") if top.get(line_key(x), key(d)) == key(d))) for d, t in rows]


def one_of_each(rows):
    """Of texts that are linked, the one of the smallest id; rows without an id or a word stay."""
    texts = sorted({(d, t) for d, t in rows if d is not None and shingles(t)})
    root = {x: x for x in texts}
    own = {x: shingles(x[1]) for x in texts}
    for i, x in enumerate(texts):
        for y in texts[:i]:
            both = sum((own[x] & own[y]).values())
            if both >= 0.8 * sum((own[x] | own[y]).values()):
                a, b = sorted((root[x], root[y]))
                root = {k: a if v == b else v for k, v in root.items()}
    return [r for r in rows if r[0] is None or not shingles(r[1])] + sorted(set(root.values()))


def without_leaks(rows, items):
    w = decontam.lowered_words(decontam.pa.array([t for _, t in items]))
    own = [w.hash[w.first[i] : w.first[i + 1]] for i in range(len(items))]
    out = []
    for d, t in rows:
        h = decontam.lowered_words(decontam.pa.array([t or ""])).hash
        if not any(len(h) and decontam.closest(a, h)[0] <= decontam.allowed_edits(len(a), 0.1) for a in own):
            out.append((d, t))
    return out


def test_stages_against_brute_force(spark, planted):
    path, rows, labels, items = planted
    docs = spark.read.parquet(f"{path}/documents.parquet")
    machine = toxicity.learn(docs, spark.read.parquet(f"{path}/labels.parquet"))
    want = without_toxic(rows, machine)
    assert 10 < len(rows) - len(want) < 60 and all(d in {i for i, _, x in labels if x} or "blockhead" in (t or "") for d, t in set(rows) - set(want))
    found = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        docs = stage(spark, docs, path).cache()
        if i == 1:
            want = without_lines(want)
        elif i == 2:
            before, want = len(want), one_of_each(want)
            assert before - len(want) >= 6
        elif i == 3:
            before, want = len(want), without_leaks(want, items)
            assert before - len(want) >= 7
        # Line dedup makes null texts empty.
        assert Counter((r["doc_id"], r["text"] or "") for r in docs.collect()) == Counter((d, t or "") for d, t in want), i
        found.append(len(want))
    packed = corpus_pipeline.STAGES[4][1](spark, docs, path).collect()
    cache = packing.WordCache(packing.tokenizer_path())
    assert sum(r["length"] for r in packed) == sum(len(cache.encode(t or "")) // 4 + 1 for _, t in want)
    assert len({r["sequence_id"] for r in packed}) == best_fit([r["length"] for r in packed], 1024)
    assert np.all(np.diff(found) <= 0)
    whole = corpus_pipeline.run(spark, path)
    assert Counter(r["doc_id"] for r in whole.collect()) == Counter(r["doc_id"] for r in packed)
