"""Line dedup, substring dedup, near-dedup and packing against brute force on odd texts."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from readloom.llm import linededup, neardup, packing, substring
from tests.llm.conftest import frame, words

LEAST = -(2**63)
CACHE = packing.WordCache(packing.tokenizer_path())


def key(d):
    return LEAST if d is None else d


@pytest.fixture(scope="module")
def docs(spark, odd_texts):
    return frame(spark, odd_texts).cache()


def line_key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\v\f\r"))


def test_line_dedup(spark, odd_texts, docs):
    more = odd_texts + [(60 + i, "Same Line, long enough to count as one %s\nown %d" % ("x" * 20, i)) for i in range(12)]
    holders = defaultdict(set)
    for d, t in more:
        for line in (t or "").split("\n"):
            if len(k := line_key(line)) >= 40:
                holders[k].add(key(d))
    top = {k: max(v) for k, v in holders.items() if len(v) >= 5}
    want = sorted((key(d), "\n".join(x for x in (t or "").split("\n") if top.get(line_key(x), key(d)) == key(d))) for d, t in more)
    done = linededup.dedup_lines(frame(spark, more))
    assert done.columns == docs.columns
    assert sorted((key(r["doc_id"]), r["text"]) for r in done.collect()) == want
    split = docs.sparkSession.createDataFrame([(9 if i < 40 else 8 - i % 3, f"{'k' * 45}\n{i}") for i in range(60)], "doc_id long, text string").repartition(7)
    assert linededup.keep_bitmaps(split).agg(F.sum("n_dropped")).first()[0] == 0  # four documents, one of them in 40 rows
    maps = linededup.keep_bitmaps(frame(spark, more))
    assert maps.agg(F.sum("n_dropped")).first()[0] == sum(len((t or "").split("\n")) for _, t in more) - sum(t.count("\n") + 1 for _, t in want if t) - sum(1 for _, t in want if not t)
    assert linededup.dedup_lines(docs.where("false")).count() == 0


@pytest.mark.parametrize("most", [2, 10_000])
def test_runs_across_ranges(monkeypatch, most):
    """The stream decides alike however the sorted keys are cut into ranges and however few rows it holds."""
    monkeypatch.setattr(linededup, "MOST_HELD", most)
    import pyarrow as pa

    rng = random.Random(1)
    rows = {(h, 0, d) for h in range(6) for d in rng.sample(range(40), rng.choice([1, 4, 5, 6, 30]))}
    counts, tops = Counter(r[0] for r in rows), {}
    rows = sorted([r for r in rows for _ in range(rng.choice([1, 1, 3]))], key=lambda x: (x[0], -x[2]))
    for h, _, d in rows:
        tops[h] = max(d, tops.get(h, 0))
    want = sorted((h, d) for h, _, d in rows if counts[h] >= 5 and d != tops[h])
    names = ["h1", "h2", "doc", "row", "at"]
    for _ in range(30):
        cuts = [0, *sorted(rng.sample(range(len(rows)), 3)), len(rows)]
        found, waiting, sums = [], [], defaultdict(list)
        for a, b in zip(cuts, cuts[1:]):
            batches = [pa.RecordBatch.from_pylist([dict(zip(names, (*r, 0, [0]))) for r in rows[i : i + 3]]) for i in range(a, b, 3) if rows[i:b]]
            batches = [x.slice(0, min(3, b - a - 3 * i)) for i, x in enumerate(batches)]
            for out in linededup._repeats(iter(batches), 5):
                for r in out.to_pylist():
                    if r["kind"] == 0:
                        found.append((r["h1"], r["doc"]))
                    elif r["kind"] == 1:
                        waiting.append((r["h1"], r["doc"]))
                    else:
                        sums[r["h1"]].append((r["docs"] - (bool(sums[r["h1"]]) and sums[r["h1"]][-1][2] == r["largest"]), r["largest"], r["smallest"]))
        ends = {h: max(t for _, t, _ in v) for h, v in sums.items() if sum(n for n, _, _ in v) >= 5}
        assert sorted(found + [(h, d) for h, d in waiting if h in ends and d < ends[h]]) == want


def test_substring_dedup(spark, odd_texts, docs):
    split = [(key(d), (t or "").encode().split()) for d, t in odd_texts]
    first = {}
    for d, w in split:
        for i in range(len(w) - 49):
            k = tuple(w[i : i + 50])
            first[k] = min(d, first.get(k, d))
    want = []
    for d, w in split:
        gone = set()
        for i in range(len(w) - 49):
            if first[tuple(w[i : i + 50])] < d:
                gone.update(range(i, i + 50))
        want.append((d, b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    done = substring.dedup_substrings(docs)
    assert done.columns == docs.columns
    assert sorted((key(r["doc_id"]), r["text"]) for r in done.collect()) == sorted(want)
    assert substring.dedup_substrings(docs.where("false")).count() == 0


def test_passages_of_more_words_than_an_automaton_has(spark, odd_texts, docs):
    want = {r["other"]["doc_id"]: r["removed"] for r in substring.mark_repeats(docs).collect() if r["other"]["doc_id"] not in (41, 51)}
    for most in (50, 57, 300):
        got = substring.mark_repeats(docs, most=most).collect()
        assert {r["other"]["doc_id"]: r["removed"] for r in got if r["other"]["doc_id"] not in (41, 51)} == want
    assert substring._batches_of(np.array([120, 50, 70]), 50, 100) == [[(0, 0, 100)], [(0, 51, 120)], [(1, 0, 50)], [(2, 0, 70)]]
    with pytest.raises(ValueError, match="words"):
        substring.mark_repeats(docs, most=10)


def test_all_documents_through_one_automaton_of_all_passages(spark, odd_texts, docs):
    """Routing passages to the documents that have them removes what streaming all documents through all of them would."""
    texts = [(key(d), (t or "").encode()) for d, t in odd_texts]
    found = substring.passages(docs.select(F.coalesce("doc_id", F.lit(LEAST)).alias("doc"), "text")).collect()
    w = substring.ws.words(*substring.text_bytes(substring.pa.array([t for _, t in texts], substring.pa.binary())))
    split = {d: t.split() for d, t in texts if d not in (LEAST, 41, 51)} | {LEAST: texts[0][1].split()}
    cut = [(r["rep"], b" ".join(split[r["rep"]][r["rs"] : r["rs"] + r["n"] + 49])) for r in found if r["rep"] in split]
    p = substring.ws.words(*substring.text_bytes(substring.pa.array([x for _, x in cut], substring.pa.binary())))
    covered = substring._covered(w, p, [r for r, _ in cut], [d for d, _ in texts], list(range(len(texts))), 50, substring.MOST_WORDS)
    routed = {r["other"]["doc_id"]: sum(x["end"] - x["first"] for x in r["removed"]) for r in substring.mark_repeats(docs).collect()}
    for i, (d, _) in enumerate(odd_texts):
        if d not in (None, 41, 51):
            assert covered[w.first[i] : w.first[i + 1]].sum() == routed[d]


def test_a_text_of_three_million_distinct_words(spark):
    text = " ".join(map(str, range(3_000_000)))
    rows = spark.createDataFrame([(1, text), (2, text[: len(text) // 2]), (3, "x " + text[-900:] + " y")], "doc_id long, text string")
    got = {r["other"]["doc_id"]: (r["text"], r["n_words"]) for r in substring.kept_texts(rows).collect()}
    half = text[: len(text) // 2].split(" ")
    # A number that is cut in the middle is another word.
    assert got[1] == (text, 3_000_000) and got[2] == ("" if int(half[-1]) == len(half) - 1 else half[-1], len(half))
    tail = text[-900:].split(" ")
    assert got[3][0] == ("x " + ("" if tail[0] == str(3_000_000 - len(tail)) else tail[0] + " ") + "y")


def shingles(t):
    w = (t or "").encode().split()
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def test_near_dedup(spark, odd_texts, docs):
    ids = [d for d, _ in odd_texts if d is not None]
    root = {d: d for d in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    pairs = [(d, shingles(t)) for d, t in odd_texts if d is not None]
    for i, (a, x) in enumerate(pairs):
        for b, y in pairs[:i]:
            inter, union = sum((x & y).values()), sum((x | y).values())
            if union and inter >= 0.8 * union:
                ra, rb = find(a), find(b)
                root[max(ra, rb)] = min(ra, rb)
    got = neardup.near_duplicates(docs).collect()
    assert sorted((key(r["doc_id"]), key(r["class_id"])) for r in got) == sorted((key(d), key(find(d) if d is not None else None)) for d, _ in odd_texts)
    left = neardup.keep_one(docs)
    assert left.columns == docs.columns
    # Both texts of 51 stay, and one of the two equal rows of 41.
    assert Counter(r["doc_id"] for r in left.collect()) == Counter({d: 1 for d in ids if find(d) == d} | {51: 2, None: 2})
    assert neardup.near_duplicates(docs.where("false")).count() == 0


def test_near_dedup_links_texts_that_no_leader_is_similar_to(spark):
    rng = random.Random(21)

    def text(template, *tails):
        return " ".join([template, *tails])

    # 200 of 250 texts at a mutual 0.77; 50 pairs at 0.815 or 0.863 among them.
    family, texts, want = words(rng, 158), {}, {}
    for i in range(250):
        texts[i] = text(family, words(rng, 23))
    for i in range(50):
        shared = words(rng, 5 if i % 2 else 10)
        for j in (100 + i, 200 + i):
            texts[j] = text(family, shared, words(rng, 18 if i % 2 else 13))
            want[j] = 100 + i
    # 90 texts at 0.96, and three of which each is similar to a single one of them that the leader is similar to, too.
    close = words(rng, 158)
    for i in range(90):
        own = words(rng, 23 if i >= 87 else 3)
        texts[1000 + i], want[1000 + i] = text(close, own), 1000
        if i >= 87:
            texts[2000 + i], want[2000 + i] = text(close, " ".join(own.split()[:10]), words(rng, 26)), 1000
    a, b, c = (shingles(texts[i]) for i in (1000, 1087, 2087))
    similar = lambda x, y: sum((x & y).values()) / sum((x | y).values())
    assert similar(a, c) < 0.8 <= min(similar(a, b), similar(b, c))
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(frame(spark, texts.items())).collect()}
    assert got == {i: want.get(i, i) for i in texts}


def test_keep_one_goes_by_texts(spark):
    rng = random.Random(31)
    a, b = words(rng, 60), words(rng, 60)
    texts = [(1, a), (1, b), (1, b), (2, b + " x"), (3, a), (None, a), (4, ""), (4, None), (4, "")]
    for order in (texts, texts[::-1]):
        left = neardup.keep_one(frame(spark, order)).collect()
        assert Counter((r["doc_id"], r["text"]) for r in left) == Counter({(1, a): 1, (1, b): 1, (None, a): 1, (4, ""): 2, (4, None): 1})
    rows = [(1, a, "z"), (1, a, "y"), (1, a, "y")]
    left = [neardup.keep_one(spark.createDataFrame(rows[i:] + rows[:i], "doc_id long, text string, key_doc string")).collect() for i in range(2)]
    assert left[0] == left[1] and len(left[0]) == 1


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(3)
    for weights in (rng.integers(0, 4, (2, 200)), rng.exponential(0.5, (2, 200)), rng.pareto(1.0, (2, 200)) * 10):
        doc, shingle = (x.ravel() for x in np.meshgrid(range(2), neardup.ws.mix(np.arange(200, dtype=np.uint64)), indexing="ij"))
        weight = weights.ravel().astype(float)
        some = weight > 0
        s = neardup.signatures(doc[some], shingle[some], weight[some], 3, 4096)
        assert abs((s[0] == s[1]).mean() - weights.min(0).sum() / weights.max(0).sum()) < 0.04
        assert not s[2].any()


def test_few_similar_pairs_agree_on_too_few_coordinates():
    m = neardup.fewest_agreements(64, 0.8)
    chance = [math.comb(64, i) * 0.8**i * 0.2 ** (64 - i) for i in range(65)]
    assert sum(chance[:m]) <= 1e-6 < sum(chance[: m + 1]) and neardup.fewest_agreements(4, 0.8) == 0


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(60)] + [(100 + rng.randrange(40), 100 + rng.randrange(40)) for _ in range(30)]
    root = {}
    for a, b in edges:
        root.setdefault(a, a), root.setdefault(b, b)
        ra, rb = root[a], root[b]
        for k, v in root.items():
            if v in (ra, rb):
                root[k] = min(ra, rb)
    got = {r["node"]: r["root"] for r in neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: v for k, v in root.items() if any(a != b and k in (a, b) for a, b in edges)}


SPACES = [" ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "\u2003", "\u3000", "\u200b", "\r\n"]


@given(st.lists(st.sampled_from([*SPACES, "a", "bc", "Zoé", "'s", "1", "23", "-", ".", "<|endoftext|>", "日本", "\u01c5", "ß", "x" * 70]), max_size=14))
@settings(max_examples=400, deadline=None)
def test_ids_are_those_of_the_library(parts):
    text = "".join(parts)
    assert np.frombuffer(CACHE.encode(text), "<u4").tolist() == CACHE.tokenizer.encode(text, add_special_tokens=False).ids


def best_fit(lengths, capacity):
    free = []
    for n in sorted(lengths, reverse=True):
        room = [x for x in free if x >= n]
        if room:
            free.remove(min(room))
            free.append(min(room) - n)
        else:
            free.append(capacity - n)
    return len(free)


def test_plan_is_best_fit_decreasing():
    rng = random.Random(4)
    for _ in range(80):
        capacity = rng.choice([7, 10, 16, 33, 64])
        h = {n: rng.randint(0, 12) for n in range(1, capacity + 1)}
        plan, fill, count = packing.plan(h, capacity), defaultdict(list), Counter()
        for p in plan:
            for i in range(p.n):
                fill[p.bin + i // p.per_bin].append((p.offset + i % p.per_bin * p.length, p.length))
            count[p.length] += p.n
        assert count == Counter({n: c for n, c in h.items() if c})
        assert len(fill) == best_fit([n for n, c in h.items() for _ in range(c)], capacity)
        for parts in fill.values():
            at = 0
            for offset, n in sorted(parts):
                assert offset == at
                at += n
            assert at <= capacity


def test_packing(spark, odd_texts, docs):
    import zlib

    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    more = [(d, t) for d, t in odd_texts if d is not None and d != 51] + [(70, "<|endoftext|> x  y\n\n z <|endoftext|>"), (74, "a <|endoftext|> b"), (75, "a  <|endoftext|><|endoftext|>\n b"), (76, "<|endoftext"), (71, " lead"), (72, "tail "), (73, "a b c\x1cd  e")]
    more = list({d: t for d, t in more}.items())
    rows = packing.pack_documents(frame(spark, more)).collect()
    by = defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
    for d, t in more:
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        at = 0
        for i, r in enumerate(sorted(by[d], key=lambda r: r["piece"])):
            assert (r["piece"], r["start"], r["ids_crc32"]) == (i, at, zlib.crc32(ids[at : at + r["length"]].tobytes()))
            at += r["length"]
        assert at == len(ids)
    whole = defaultdict(list)
    for r in rows:
        whole[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in whole.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 1024
    assert len(whole) == best_fit([r["length"] for r in rows], 1024)
    pieces = packing.token_pieces(frame(spark, more[:6]))
    seqs = packing.sequences(packing.pack(pieces)).collect()
    assert sum(len(r["ids_le"]) for r in seqs) == 4 * pieces.agg(F.sum("length")).first()[0]
    assert packing.pack_documents(docs.where("false")).count() == 0
    lengths = {r["doc_id"]: r["length"] for r in rows}
    assert [lengths[d] for d in (70, 74, 76)] == [9, 5, 6]  # a special token's literal is one id
    # Each row counts for itself, repeated ids included.
    assert packing.pack_documents(docs).agg(F.sum((F.col("start") == 0).cast("int"))).first()[0] == len(odd_texts)


def test_long_texts(spark):
    """A text of 1.5 MB in one line, a near copy of it, and one of as many lines as words, through each operator on texts."""
    from readloom.llm import decontam, quality, sharding, toxicity

    rng = random.Random(51)
    vocabulary = [words(rng, 1) for _ in range(5000)]
    long = [rng.choice(vocabulary) for _ in range(280_000)]
    near = list(long)
    near[1000] = "changed"
    item = words(rng, 25)
    texts = [(1, " ".join(long)), (2, " ".join(near)), (3, "\n".join(long) + "\n" + item), (4, words(rng, 50))]
    docs = frame(spark, texts)
    assert all(len(t) > 1_200_000 for _, t in texts[:3])
    got = {tuple(r)[:2] for r in decontam.leaks(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()}
    assert got == {(3, 7)}
    labels = spark.createDataFrame([(i, 1, i % 2) for i, _ in texts], "doc_id long, quality int, toxic int")
    assert toxicity.score_documents(docs, labels).count() == 4
    cache = packing.WordCache(packing.tokenizer_path())
    pieces = packing.pack_documents(docs).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r["doc_id"]: r["n"] for r in pieces} == {i: len(cache.encode(t)) // 4 + 1 for i, t in texts}
    assert {r["doc_id"]: r["n_words"] for r in quality.judge(docs, labels).collect()} == {i: len(t.split()) for i, t in texts}
    assert {r["doc_id"]: r["n_lines"] for r in linededup.keep_bitmaps(docs).collect()} == {i: t.count("\n") + 1 for i, t in texts}
    classes = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(docs).collect()}
    assert classes == {1: 1, 2: 1, 3: 1, 4: 4}
    assert sharding.assign(docs).agg(F.sum("size")).first()[0] == sum(len(t) + 16 for _, t in texts)
