"""Decontamination, toxicity, quality rules, sharding, personal data and licenses."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from readloom.llm import decontam, licenses, pii, quality, sharding, toxicity
from tests.llm.conftest import frame, words


@pytest.fixture(scope="module")
def docs(spark, odd_texts):
    return frame(spark, odd_texts).cache()


def edited(rng, text, n):
    w = text.split()
    for _ in range(n):
        i, kind = rng.randrange(len(w)), rng.randrange(3)
        w[i : i + (kind != 1)] = [] if kind == 0 else ["zzz"]
    return " ".join(w)


def test_decontamination(spark, odd_texts, docs):
    rng = random.Random(9)
    items = [(i, words(rng, rng.randint(15, 50))) for i in range(40)] + [(100, None), (101, ""), (102, "too short")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    leaked = []
    for i in range(40):
        n = len(items[i][1].split())
        text = items[i][1] if i % 4 == 0 else items[i][1].upper().replace(" ", "!! ") if i % 4 == 1 else edited(rng, items[i][1], rng.randint(1, decontam.allowed_edits(n, 0.1)))
        leaked.append((1000 + i, words(rng, 60) + "\n" + text + " " + words(rng, 40 if i % 3 else 0)))
    got = decontam.leaks(frame(spark, odd_texts + leaked), bench).collect()
    found = {(r["doc_id"], r["item_id"]) for r in got}
    want = {(1000 + i, i) for i in range(40)}
    assert found <= want and len(found) >= 0.97 * len(want) and {x for x in want if x[1] % 4 < 2} <= found
    for r in got:
        assert r["edits"] <= decontam.allowed_edits(len(items[r["item_id"]][1].split()), 0.1) and r["first_word"] >= 58
    left = decontam.drop_leaked(frame(spark, odd_texts + leaked), bench)
    assert left.columns == docs.columns and left.count() == len(odd_texts) + 40 - len(found)
    assert decontam.leaks(docs.where("false"), bench).count() == 0 and decontam.leaks(docs, bench.where("false")).count() == 0
    passes = decontam.leaks(frame(spark, leaked), bench, items_per_pass=10).collect()
    assert len({(r["doc_id"], r["item_id"]) for r in passes}) >= 0.95 * len(want)


def test_short_items_are_found_as_exact_copies(spark):
    bench = spark.createDataFrame([(1, "Who wrote the Divine Comedy?"), (2, "seven words make this a short one"), (3, "yes"), (4, "")], "item_id long, text string")
    texts = [(10, "a b who wrote the divine comedy c who wrote the divine comedy"), (11, "who wrote divine comedy"), (12, "so: seven words, make this a short one"), (13, "who wrote the"), (14, "divine comedy. Yes"), (15, None)]
    got = {tuple(r) for r in decontam.leaks(frame(spark, texts), bench).collect()}
    assert got == {(10, 1, 2, 6, 0), (12, 2, 1, 7, 0), (14, 3, 2, 2, 0)}


def test_each_length_class_finds_its_target_of_leaks():
    rng = random.Random(17)
    texts = [words(rng, rng.randint(24, 30)) for _ in range(50)] + [words(rng, rng.randint(42, 50)) for _ in range(50)]
    w = decontam.lowered_words(decontam.pa.array(texts))
    items = [w.hash[w.first[i] : w.first[i + 1]] for i in range(100)]
    index = decontam.build_index(items, 0.1, 0.99)
    leaked = [edited(rng, texts[i % 100], decontam.allowed_edits(len(items[i % 100]), 0.1)) for i in range(3000)]
    found = {(d, i) for d, i, *_ in decontam.find_leaks(decontam.lowered_words(decontam.pa.array(leaked)), 3000, items, index, 0.1)}
    for side in (0, 1):
        mine = [d for d in range(3000) if d % 100 // 50 == side]
        assert sum((d, d % 100) in found for d in mine) >= 0.99 * len(mine)


def test_long_items_are_found_by_their_parts():
    rng = random.Random(18)
    texts = [words(rng, n) for n in (65, 128, 129, 300, 1000, 2000)]
    w = decontam.lowered_words(decontam.pa.array(texts))
    items = [w.hash[w.first[i] : w.first[i + 1]] for i in range(len(texts))]
    index = decontam.build_index(items, 0.1, 0.99)
    assert all(32 <= len(h) <= 64 for _, _, h in index.parts) and max(len(c.steps) for c in index.classes) < 40
    near = [words(rng, 30) + " " + edited(rng, t, decontam.allowed_edits(len(t.split()), 0.1)) + " " + words(rng, 30) for t in texts for _ in range(5)]
    far = [words(rng, 30) + " " + edited(rng, t, int(0.25 * len(t.split()))) + " " + words(rng, 30) for t in texts]
    found = decontam.find_leaks(decontam.lowered_words(decontam.pa.array(near + far)), len(near + far), items, index, 0.1)
    assert {(d, i) for d, i, *_ in found} == {(d, d // 5) for d in range(len(near))}
    assert all(25 <= a <= 35 and e <= decontam.allowed_edits(len(items[i]), 0.1) for _, i, a, _, e in found)


def test_leaks_against_brute_force():
    """Every window of every text against every item: nothing else is found, and nearly all of it, with the same edits."""
    rng = random.Random(19)
    items_text = [words(rng, n) for n in (9, 15, 22, 40)]
    texts = [words(rng, rng.randint(0, 20)) + " " + edited(rng, rng.choice(items_text), rng.randint(0, 5)) + " " + words(rng, rng.randint(0, 20)) for _ in range(60)]
    w, v = decontam.lowered_words(decontam.pa.array(items_text)), decontam.lowered_words(decontam.pa.array(texts))
    items = [w.hash[w.first[i] : w.first[i + 1]] for i in range(4)]
    want = {}
    for d in range(60):
        h = v.hash[v.first[d] : v.first[d + 1]]
        for i, a in enumerate(items):
            edits = decontam.closest(a, h)[0]
            assert edits == min((decontam.edit_distance(a.tolist(), h[s:].tolist(), len(a))[0] for s in range(len(h))), default=len(a))
            if edits <= decontam.allowed_edits(len(a), 0.1):
                want[d, i] = edits
    found = {(d, i): e for d, i, _, _, e in decontam.find_leaks(v, 60, items, decontam.build_index(items, 0.1, 0.99), 0.1)}
    assert set(found) <= set(want) and len(found) >= len(want) - 1 and len(want) > 20
    assert all(e >= want[k] for k, e in found.items())


@given(st.lists(st.integers(0, 3), max_size=9), st.lists(st.integers(0, 3), max_size=9), st.integers(1, 4))
@settings(max_examples=200, deadline=None)
def test_edit_distance(a, b, most):
    def full(x, y):
        row = list(range(len(y) + 1))
        for i, p in enumerate(x, 1):
            new = [i]
            for j, q in enumerate(y, 1):
                new.append(min(row[j - 1] + (p != q), row[j] + 1, new[-1] + 1))
            row = new
        return row

    least = min(full(a, b))
    d, j = decontam.edit_distance(a, b, most)
    assert d == min(least, most + 1) and (d > most or full(a, b)[j] == d)


def test_toxicity(spark, odd_texts, docs):
    rng = random.Random(3)
    texts, labels = [], []
    for i in range(1200):
        insult, group, n = rng.random() < 0.5, rng.random() < 0.5, rng.choice([20, 60, 400])
        w = words(rng, n).split()
        w[5:5] = ["Blockhead"] * insult + ["martians"] * group
        texts.append((i, " ".join(w)))
        labels.append((i, 1, int(insult and group)))
    table = spark.createDataFrame(labels + [(None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    rows = toxicity.score_documents(frame(spark, texts), table).collect()
    truth = {i: t for i, _, t in labels}
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r["held_out"]]
    # Only the pair is toxic: each word alone is as frequent among the others.
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    assert len(toxicity.score_documents(docs, table).collect()) == len(odd_texts)
    none = toxicity.score_documents(docs, table.where("false")).collect()
    assert {r["predicted"] for r in none} == {0}
    kept = toxicity.drop_toxic(frame(spark, texts), table)
    assert kept.columns == docs.columns and abs(kept.count() - sum(t == 0 for t in truth.values())) < 60


def test_pairs_are_learned_that_weights_alone_miss(spark):
    """The label is insult XOR group, so neither word alone says anything: without factors the machine can't tell."""
    rng = random.Random(4)
    texts, truth = [], {}
    for i in range(1600):
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        w = words(rng, 30).split()
        w[5:5] = ["Blockhead"] * insult + ["martians"] * group
        texts.append((i, " ".join(w)))
        truth[i] = int(insult != group)
    docs, labels = frame(spark, texts), spark.createDataFrame(list(truth.items()), "doc_id long, toxic int")
    share = {}
    for factors in (0, toxicity.FACTORS):
        m = toxicity.learn(docs, labels, factors=factors)
        rows = toxicity.score(docs.where(toxicity.held_out()).select("doc_id", "text"), m).select("row.doc_id", "score").collect()
        share[factors] = sum((r["score"] >= 0.5) == truth[r["doc_id"]] for r in rows) / len(rows)
    assert share[toxicity.FACTORS] > 0.95 and share[0] < 0.65


def test_pair_sums_are_those_of_all_pairs():
    rng = np.random.default_rng(2)
    m = toxicity.Machine(np.zeros(0), 0.3, rng.normal(size=6), rng.normal(size=(6, 3)))
    rows = [[0, 2, 5], [1], [], [0, 1, 2, 3, 4, 5]]
    want = [0.3 + sum(m.weight[i] for i in r) + sum(m.vectors[a] @ m.vectors[b] for k, a in enumerate(r) for b in r[:k]) for r in rows]
    got = m.logits(np.repeat(range(4), [len(r) for r in rows]), np.array([i for r in rows for i in r]), 4)
    assert got == pytest.approx(want)


def test_training_is_the_same_in_any_order_and_bounded(spark):
    rng = random.Random(6)
    texts = [(i // 2, words(rng, 20) + (" blockhead" if i % 4 == 0 else "")) for i in range(400)]
    labels = spark.createDataFrame([(i, i % 2 ^ 1) for i in range(200)], "doc_id long, toxic int")
    a, b = (toxicity.learn(frame(spark, x), labels) for x in (texts, texts[::-1]))
    assert (a.weight == b.weight).all() and (a.vectors == b.vectors).all()
    assert (toxicity.learn(frame(spark, texts), labels, max_bytes=3000).feature >= 0).sum() < (a.feature >= 0).sum()


def test_quality_statistics(spark, odd_texts, docs):
    more = odd_texts + [(80, "a\nb b\na\n \n \nA\n# $*"), (81, "x y z x y z x y z w v u t s r")]
    word = re.compile(r"[^\x20\x09-\x0D]+")
    want = Counter()
    for d, t in more:
        t = t or ""
        w, seen, n_dup = word.findall(t), set(), 0
        for line in t.split("\n"):
            n_dup += bool(line in seen and word.search(line))
            seen.add(line)
        grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        covered = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        want[(d, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), n_dup, len(covered), len(w) < 10 or 100 * len(covered) > 20 * len(w))] += 1
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    rows = quality.judge(frame(spark, more), labels).collect()
    assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in rows) == want
    assert all(r["kept"] == (not r["base_failed"]) for r in rows)  # one label makes no cutoff safe
    assert quality.judge(docs.where("false"), labels).count() == 0


def test_repeated_ids_choose_the_same_steps(spark):
    rng = random.Random(9)
    texts = [(i // 2, " ".join(("##" if rng.random() < (0.5 if i % 20 == 0 else 0.0) else "") + x for x in words(rng, 30).split())) for i in range(1200)]
    labels = spark.createDataFrame([(i, int(i % 10 != 0), 0) for i in range(600)], "doc_id long, quality int, toxic int")
    a, b = (Counter(map(str, quality.judge(frame(spark, x), labels).collect())) for x in (texts, texts[::-1]))
    assert a == b and any("symbols_per_word" in x for x in a)


def test_cutoffs_are_safe(spark):
    rng = random.Random(8)
    texts = [(i, " ".join(("##" if rng.random() < (0.3 if i % 10 == 0 else 0.001) else "") + x for x in words(rng, 40).split())) for i in range(6000)]
    labels = spark.createDataFrame([(i, int(i % 10 != 0), 0) for i, _ in texts], "doc_id long, quality int, toxic int")
    rows = quality.judge(frame(spark, texts), labels).collect()
    good = [r for r in rows if r["doc_id"] % 10]
    bad = [r for r in rows if r["doc_id"] % 10 == 0]
    assert sum(not r["kept"] for r in good) <= quality.MAX_LOSS * len(good)
    assert sum(not r["kept"] for r in bad) >= 0.8 * len(bad)


def test_the_error_holds_over_many_draws():
    """The true loss of the chosen step is over max_loss in at most the promised share of draws, and a step is found in most."""
    rng = np.random.default_rng(5)
    loss = np.array([0.0, 0.0, 0.002, 0.005, 0.01, 0.019, 0.021, 0.03, 0.05, 0.1, 0.3, 1.0])
    too_far, found = 0, 0
    for _ in range(200):
        n = int(rng.integers(250, 2500))
        first = np.searchsorted(loss, rng.random(n), side="left")  # the step from which each good document is rejected
        step = quality.strictest(n, [int((first <= i).sum()) for i in range(len(loss))], 0.05, 0.02)
        found += step >= 2
        too_far += step >= 0 and loss[step] > 0.02
    assert too_far <= 10 + 2 * 10**0.5 and found >= 150
    assert quality.strictest(180, [0] * 12, 0.025, 0.02) == -1 and quality.strictest(250, [0, 0, 9], 0.0125, 0.02) == 1


def test_large_binomials():
    assert quality.tail(10**9, 10**7, 0.02) == 0.0 and quality.tail(10**8, 2 * 10**6, 0.02) == pytest.approx(0.5, abs=1e-3)
    assert quality.tail(10**8, 10**8 - 1, 0.02) == 1.0


@pytest.mark.skipif(not Path("/root/testdata/sf0.1").exists(), reason="no tables here")
def test_every_language_of_the_tables_gets_a_step(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.judge(docs, labels).where("not base_failed").join(labels, "doc_id").groupBy("lang", "quality").agg(F.count("*").alias("n"), F.count_if("kept").alias("kept")).collect()
    by = {(r["lang"], r["quality"]): r["kept"] / r["n"] for r in rows}
    assert all(by[x, 0] < 0.2 for x in ("en", "de", "es", "fr")) and all(by[x, 1] > 0.98 for x in ("en", "de", "es", "fr"))


@given(st.integers(1, 60), st.integers(0, 60), st.floats(0.001, 0.5))
@settings(max_examples=100, deadline=None)
def test_binomial_tail(n, k, p):
    want = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(min(k, n) + 1))
    assert quality.tail(n, k, p) == pytest.approx(want, rel=1e-9, abs=1e-12)


def test_sharding(spark, odd_texts, docs):
    rng = random.Random(6)
    rows = sharding.assign(frame(spark, odd_texts + [(i, "t") for i in range(1000, 9000)])).collect()
    for r in rows:
        assert r["grown_shard"] in (r["shard"], 40) and r["law"] == "key"
    by = Counter(r["shard"] for r in rows)
    assert set(by) == set(range(40)) and max(by.values()) < 1.5 * len(rows) / 40
    assert all(sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(n)) for s, n in by.items())
    text = {d: t for d, t in odd_texts}
    for r in rows:
        if r["doc_id"] in text and r["doc_id"] not in (None, 51):
            t = (text[r["doc_id"]] or "").encode()
            assert (r["size"], r["text_crc32"]) == (len(t) + 16, zlib.crc32(t))
    assert sharding.assign(docs.where("false")).count() == 0 and rng
    moved = sum(r["grown_shard"] == 40 for r in rows) / len(rows)
    assert 0.015 < moved < 0.035


def test_a_descent_in_plain_python(spark):
    """The same draws, taken one level at a time in Python from Spark's hashes of names and keys."""
    tree = sharding.topology(13, base=11, racks=2, per_rack=3)
    names, stack = [], [tree]
    while stack:
        node = stack.pop()
        names += [c.name for c in node.children]
        stack += node.children
    keys = list(range(300)) + [None]
    pairs = spark.createDataFrame([(n, k) for n in names for k in keys], "name string, key long")
    hashes = {(r["name"], r["key"]): r["h"] for r in pairs.select("name", "key", F.xxhash64("name", "key").alias("h")).collect()}

    def descend(key):
        node = tree
        while node.shard is None:
            node = min(node.children, key=lambda c: -math.log((((hashes[c.name, key] % 2**64) >> 11) + 0.5) / 2**53) / c.weight)
        return node.shard

    rows = spark.createDataFrame([(k,) for k in keys], "key long").select("key", sharding.descend(F.col("key"), tree).alias("shard")).collect()
    assert {r["key"]: r["shard"] for r in rows} == {k: descend(k) for k in keys} and len({r["shard"] for r in rows}) == 13


def test_reweighting_moves_rows_of_changed_subtrees_only(spark):
    def tree(w):
        return sharding.parent("root", [sharding.parent(f"r{i}", [sharding.parent(f"r{i}k{j}", [sharding.leaf(4 * i + 2 * j + s, w if (i, j, s) == (1, 0, 1) else 1.0) for s in range(2)]) for j in range(2)]) for i in range(3)])

    keys = spark.range(20_000)
    rows = keys.select(sharding.descend(F.col("id"), tree(1.0)).alias("a"), sharding.descend(F.col("id"), tree(3.0)).alias("b"))
    moves = Counter((r["a"], r["b"]) for r in rows.collect() if r["a"] != r["b"])
    assert moves and all(b // 4 == 1 for _, b in moves)  # only into the region that grew
    assert all(b == 5 for a, b in moves if a in (4, 5))
    assert all(b in (4, 5) for a, b in moves if a // 4 == 1)  # inside it only into the rack that grew


PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def plain_spans(text):
    out = []
    for number, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "email" or (kind == "ip" and all(int(x) <= 255 for x in m[0].split("."))) or (kind == "card" and 12 <= len(d) <= 19 and luhn(d)) or (kind == "phone" and 9 <= len(d) <= 15):
                out.append((m.start(), number, m.end(), kind))
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))


def test_personal_data(spark, odd_texts, docs):
    rng = random.Random(12)
    pool = ["a@b.c", "@", ".", "x_y%z@q-r.st.uv", "1.2.3.4", "255.255.255.256", "001.02.3.4", "4111 1111 1111 1111", "4111-1111-1111-1111", "0" * 12, "+1 (017) 555-7713", "+", "12345678901234567890", "é", " ", "\n", "-", "7", "c_d@e.f", "9..9"]
    texts = [(5000 + i, "".join(rng.choice(pool) + rng.choice(["", " ", ".", "x"]) for _ in range(rng.randint(1, 25)))) for i in range(400)]
    texts += [(6000, "9" * 30_000), (6001, "a" * 30_000 + "@b.c"), (6002, "1." * 5000), (6003, "1 " * 5000), (6004, "+1" + "(" * 20_000)]
    rows = pii.report(frame(spark, odd_texts + texts)).collect()
    want = Counter((d, plain_spans(t or "")) for d, t in odd_texts + texts)
    got = Counter()
    for r in rows:
        base = ",".join(x for x in r["spans"].split(",") if not x.startswith("secret"))
        assert hashlib.sha256(base.encode()).hexdigest() == r["base_sha256"]
        assert [r[f"n_{k}"] for k in PLAIN] == [sum(x.startswith(k + ":") for x in base.split(",")) for k in PLAIN]
        got[r["doc_id"], base] += 1
    assert got == want
    assert pii.report(docs.where("false")).count() == 0


def test_contexts_find_unseen_identifiers(spark):
    rng = random.Random(13)
    hexes = ["".join(rng.choice("0123456789abcdef") for _ in range(40)) for _ in range(12)]
    texts = [(i, f'{words(rng, 9)} api token = "{h}" {words(rng, 5)}') for i, h in enumerate(hexes)]
    texts += [(50, f'{words(rng, 9)} api token = "ZX81-9911-QQ" {words(rng, 4)}'), (51, f"{words(rng, 9)} version number = 12345678 {words(rng, 4)}")]
    rows = {r["doc_id"]: r["spans"] for r in pii.report(frame(spark, texts)).collect()}
    text = dict(texts)
    at = text[50].index("ZX81")
    assert rows[50] == f"secret:{at}:{at + 12}" and rows[51] == ""
    assert all(rows[i].startswith("secret:") for i in range(12))


def test_contexts_are_whole_words_and_may_hold_identifiers(spark):
    rng = random.Random(15)
    long = " ".join(c * 70 for c in "pq")
    seeds = ["".join(rng.choice("0123456789abcdef") for _ in range(40)) for _ in range(10)]
    texts = [(i, f"see {long}\n{h}") for i, h in enumerate(seeds[:5])] + [(10 + i, f"key 4711 of1\t{h} ok") for i, h in enumerate(seeds[5:])]
    texts += [(50, f"see {long}  ABC-99-XYZ"), (51, "a key 4711 of1 QRS-77-TUV"), (52, "of1 KLM-55-NOP"), (53, f"see q{long} ABC-99-XYZ")]
    rows = {r["doc_id"]: (r["spans"], r["n_secret"]) for r in pii.report(frame(spark, texts)).collect()}
    assert rows[50] == (f"secret:{len(texts[10][1]) - 10}:{len(texts[10][1])}", 1) and rows[51] == ("secret:15:25", 1)
    assert rows[52] == rows[53] == ("", 0)


def test_a_long_text_of_identifiers(spark):
    text = "mail joe7@x.org id A12B of 10.0.0.1 or +1 555 123 4567, " * 36_000
    r = pii.report(spark.createDataFrame([(1, text), (1, text), (None, text[:100])], "doc_id long, text string")).collect()
    assert [x["n_email"] for x in sorted(r, key=lambda x: x["n_email"])] == [2, 36_000, 36_000]
    assert {x["spans"] for x in r if x["n_email"] > 2} == {plain_spans(text)}


def test_licenses(spark, odd_texts, docs):
    rng = random.Random(14)
    texts, want = [], set()
    for i, (name, own) in enumerate(licenses.TEMPLATES.items()):
        for j, t in enumerate(own):
            d = 100 + 10 * i + j
            texts.append((d, (words(rng, 40) + "\n" if j % 2 else "") + t.upper() + "!! " + (words(rng, 30) if i % 2 else "")))
            want.add((d, name))
    long = licenses.TEMPLATES["BSD"][0].split()
    texts.append((500, words(rng, 20) + " " + " ".join(long[:18]) + " " + words(rng, 9)))  # 14 of 16 shingles
    texts.append((501, words(rng, 20) + " " + " ".join(long[:11]) + " " + words(rng, 9)))  # 7 of them
    want.add((500, "BSD"))
    rows = licenses.scan(frame(spark, odd_texts + texts)).collect()
    found = {(r["doc_id"], r["license"]) for r in rows}
    assert want <= found and {d for d, _ in found} == {d for d, _ in want}
    for r in rows:
        if r["doc_id"] < 500 and (r["doc_id"], r["license"]) in want:
            assert r["containment"] == 1.0 and r["first_word"] in (0, 40)
    assert licenses.scan(docs.where("false")).count() == 0
    with pytest.raises(ValueError, match="fewer than"):
        licenses.scan(docs, {"x": ["two words"]})


def test_licenses_against_brute_force(monkeypatch):
    """Every window of every text against every template, in texts made of words of templates: edits, cuts, repeats."""
    rng = random.Random(16)
    index = licenses.Index(licenses.TEMPLATES, licenses.CONTAINMENT, licenses.ROWS, licenses.TARGET)
    own = [t.split() for ts in licenses.TEMPLATES.values() for t in ts]
    texts = []
    for _ in range(150):
        w = words(rng, rng.randint(0, 6)).split()
        for _ in range(rng.randint(1, 3)):
            t = list(rng.choice(own))
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                t[rng.randrange(len(t))] = "other"
            w += t[rng.choice([0, 0, 0, 2]) :] + words(rng, rng.randint(0, 4)).split()
        texts.append(" ".join(w))
    w = licenses.lowered_words(decontam.pa.array(texts))
    want = set()
    for d in range(len(texts)):
        h = w.hash[w.first[d] : w.first[d + 1]]
        g = licenses.ws.grams(h, 5).tolist()
        for t, (_, n, shingles) in enumerate(index.templates):
            for a in range(len(h)):
                held = sum(s in g[a : a + n - 4] for s in shingles.tolist()) / len(shingles)
                if held >= licenses.CONTAINMENT:
                    want.add((d, t, a))
    found = {x[:3] for x in licenses.find(w, index)}
    assert found <= want and len(found) >= 0.998 * len(want) and len(want) > 100
    monkeypatch.setattr(licenses, "WINDOWS", 7)
    assert {x[:3] for x in licenses.find(w, index)} == found


def test_a_long_text_of_licenses(spark):
    text = (licenses.TEMPLATES["MPL-2.0"][0] + "\n") * 15_000
    rows = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert [(r["license"], r["n_places"], r["first_word"]) for r in rows] == [("MPL-2.0", 15_000, 0)]
