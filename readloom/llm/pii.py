"""Personal data: fixed patterns for four kinds, and bootstrapped contextual extraction of further identifiers.

All of it is DataFrame functions. Positions come from splitting a text by a pattern: the pieces between the matches, with the
matches, add up to offsets in code points, summed chunk by chunk so that the work is about linear in the matches. A pattern begins a match only where a match of the plain pattern can begin, and its
repetitions give nothing back, so long runs of letters or digits cost linear time and no deep recursion.

Bootstrapping: every word with a digit or an '@' is an instance, and the two words before it, whatever they are, are a lexical
pattern; the first two words of a text have none. Seeds are the
instances inside spans of the four kinds and long hexadecimal strings. On the graph of patterns and instances a pattern's score
is the mean score of its occurrences and an instance's score is the best of its patterns (a seed's stays 1), in `ROUNDS` rounds.
Patterns of a high score and enough distinct seeds mark all their other instances of `MIN_SECRET` = 8 characters or more as
`secret`; shorter ones never are.

Defined cases: a null or empty text has no spans; rows are searched each for itself, and equal rows have equal spans; null and
repeated doc_ids are carried along; an empty table gives an empty table; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from readloom.llm.common import staged

_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
#: Each kind's pattern, in the order of kinds; \\G is the end of the match before.
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A match of a kind has this in it; most texts lack it, and it is quick to look for.
HINTS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
KINDS = (*PATTERNS, "secret")
INSTANCE = r"(?<!\S)(?=\S*[0-9@])\S++"
#: The two words before an instance, looked ahead to from the first of them, so that contexts may overlap.
CONTEXT = r"(?<!\S)(?=(\S++\s++\S++)\s++(?=\S*[0-9@])\S)"
SEED = r"^(?=.*[0-9])(?=.*[A-Fa-f])[0-9A-Fa-f]{32,}$"
_EDGE = r"[^\p{L}\p{N}]"
#: A pattern marks from this score on, with this many distinct seeds.
ROUNDS, SCORE, SEEDS, MIN_SECRET = 3, 0.8, 3, 8
#: Offsets are summed over so many matches at a time.
CHUNK = 256


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value made once for a row however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def sums_before(lengths: Column) -> Column:
    """For each number of an array the sum of those before it: sums of chunks, then sums inside each chunk."""
    none = F.array().cast("array<int>")

    def running(numbers: Column, start: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            return F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))

        return F.aggregate(numbers, F.struct(start.alias("at"), none.alias("out")), step, lambda acc: acc["out"])

    def of(a: Column) -> Column:
        # By index, as slice() goes through the whole array each time.
        def chunk(i: Column) -> Column:
            return F.transform(F.sequence(i * CHUNK, F.least((i + 1) * CHUNK, F.size(a)) - 1), lambda j: F.get(a, j))

        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / CHUNK).cast("int")), chunk)

        def with_totals(parts: Column) -> Column:
            totals = F.transform(parts, lambda part: F.aggregate(part, F.lit(0), lambda x, y: x + y))
            return F.flatten(F.zip_with(parts, running(totals, F.lit(0)), running))

        return _let(chunks, with_totals)

    return _let(lengths, lambda a: F.when(F.size(a) == 0, none).otherwise(of(a)))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the digits, every second doubled from the right, add up to a multiple of ten."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substr(digits, n - i, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 0, d).otherwise(twice - F.when(twice > 9, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def _small_part(part: Column) -> Column:
    bare = F.regexp_replace(part, "^0+", "")
    return F.when(F.length(bare) <= 3, F.coalesce(bare.try_cast("int"), F.lit(0)) <= 255).otherwise(False)


def accepted(kind: str, match: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(match, r"\."), _small_part)
    if kind == "card":
        d = _digits(match)
        return F.when(F.length(d).between(12, 19), _luhn(d)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(match)).between(9, 15)
    return F.lit(True)


def located(matches: Column, gaps: Column) -> Column:
    """start, end (code points, end exclusive) and text of each match. gaps: the pieces before the matches, and one after."""
    sizes = F.zip_with(matches, F.slice(gaps, 1, F.size(matches)), lambda m, g: F.struct(m.alias("m"), F.length(g).alias("g"), F.length(m).alias("n")))

    def spans(a: Column) -> Column:
        before = sums_before(F.transform(a, lambda x: x["g"] + x["n"]))
        return F.zip_with(a, before, lambda x, s: F.struct((s + x["g"]).alias("start"), (s + x["g"] + x["n"]).alias("end"), x["m"].alias("text")))

    return _let(sizes, spans)


def _found(df: DataFrame, name: str, pattern: str, hint: str | None) -> DataFrame:
    """df with the column `name`: the located matches of the pattern in `text`."""
    all_matches = F.regexp_extract_all("text", F.lit(pattern), 0)
    none = F.array().cast("array<string>")
    df = df.withColumn(f"_m_{name}", F.when(F.col("text").rlike(hint), all_matches).otherwise(none) if hint else all_matches)
    df = df.withColumn(f"_g_{name}", F.when(F.size(f"_m_{name}") > 0, F.split("text", pattern, -1)).otherwise(none))
    return df.withColumn(name, located(F.col(f"_m_{name}"), F.col(f"_g_{name}"))).drop(f"_m_{name}", f"_g_{name}")


def base_spans(df: DataFrame) -> DataFrame:
    """df, which has `text`, with the column base: kind (its number), start and end of each span, by start and kind."""

    def spans(number: int, kind: str) -> Column:
        good = F.filter(kind, lambda x: accepted(kind, x["text"]))
        return F.transform(good, lambda x: F.struct(x["start"].alias("start"), F.lit(number).alias("kind"), x["end"].alias("end")))

    for kind, pattern in PATTERNS.items():
        df = _found(df, kind, pattern, HINTS[kind])
    parts = [spans(number, kind) for number, kind in enumerate(PATTERNS)]
    return df.withColumn("base", F.array_sort(F.concat(*parts))).drop(*PATTERNS)


def mentions(df: DataFrame) -> DataFrame:
    """df, which has `text`, with the column words: pattern and instance (hashes), start, end and hex of each instance in context."""
    df = _found(df, "words", INSTANCE, "[0-9@]")
    contexts = F.when(F.col("text").rlike("[0-9@]"), F.regexp_extract_all("text", F.lit(CONTEXT), 1)).otherwise(F.array().cast("array<string>"))
    # Only the first two words of a text lack a context, so what is missing is missing in front.
    padded = _let(contexts, lambda c: F.concat(F.array_repeat(F.lit(""), F.size("words") - F.size(c)), c))

    def mention(x: Column, context: Column) -> Column:
        left = F.regexp_replace(x["text"], f"^{_EDGE}+", "")
        core = F.regexp_replace(left, f"(?<!{_EDGE}){_EDGE}++$", "")
        start = x["end"] - F.length(left)
        pattern = F.when(context != "", F.xxhash64(F.lower(F.regexp_replace(context, r"\s+", " "))))
        return F.struct(pattern.alias("pattern"), F.xxhash64(core).alias("instance"), start.alias("start"), (start + F.length(core)).alias("end"), core.rlike(SEED).alias("hex"))

    found = F.filter(F.zip_with("words", padded, mention), lambda x: x["pattern"].isNotNull() & (x["end"] > x["start"]))
    return df.withColumn("words", found)


def placed(found: DataFrame) -> DataFrame:
    """row, pattern, instance, start, end, inside (a span of `base` overlaps it) and seed of each mention in found (row, base, words).

    Spans at their starts and words at their ends are read in order, with the furthest end of a span so far.
    """
    words = found.select("row", (F.size("base") > 0).alias("near"), F.explode("words").alias("x")).select("row", "near", "x.*")
    spans = found.where(F.size("words") > 0).select("row", F.explode("base").alias("b")).select("row", F.col("b.start").alias("at"), F.lit(1).alias("order"), F.col("b.end").alias("reach"))
    events = words.where("near").withColumns({"at": F.col("end"), "order": F.lit(0)}).unionByName(spans, allowMissingColumns=True)
    so_far = W.Window.partitionBy("row").orderBy("at", "order").rowsBetween(W.Window.unboundedPreceding, 0)
    near = events.withColumn("furthest", F.max("reach").over(so_far)).where("reach is null").withColumn("inside", F.coalesce(F.col("furthest") > F.col("start"), F.lit(False)))
    columns = ["row", "pattern", "instance", "start", "end", "hex", "inside"]
    every = near.select(*columns).union(words.where("not near").withColumn("inside", F.lit(False)).select(*columns))
    return every.withColumn("seed", F.col("inside") | F.col("hex"))


def good_patterns(edges: DataFrame) -> DataFrame:
    """The patterns, of edges (pattern, instance, seed, n), whose instances are almost all known or found with known ones."""
    scored = edges.withColumn("score", F.col("seed").cast("double"))
    seeds = edges.where("seed").groupBy("pattern").agg(F.count_distinct("instance").alias("seeds"))
    patterns = None
    for i in range(ROUNDS):
        patterns = scored.groupBy("pattern").agg((F.sum(F.col("score") * F.col("n")) / F.sum("n")).alias("trust"))
        if i + 1 < ROUNDS:
            best = edges.join(patterns, "pattern").groupBy("instance").agg(F.max(F.when(F.col("seed"), 1.0).otherwise(F.col("trust"))).alias("score"))
            scored = edges.join(best, "instance")
    return patterns.join(seeds, "pattern").where((F.col("trust") >= SCORE) & (F.col("seeds") >= SEEDS)).select("pattern")


def written(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def find(docs: DataFrame) -> DataFrame:
    """doc_id, base and added (arrays of start, kind number, end) for each row of docs."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id"), F.monotonically_increasing_id().alias("row"), text.alias("text"))
    # Staged at once, so each row keeps its number.
    found = staged(mentions(base_spans(rows)).select("doc_id", "row", "base", "words"), "spans")
    flat = staged(placed(found), "mentions")
    edges = staged(flat.groupBy("pattern", "instance").agg(F.bool_or("seed").alias("seed"), F.count("*").alias("n")), "graph")
    good = staged(good_patterns(edges), "patterns")
    new = flat.where(~F.col("inside")).where(F.col("end") - F.col("start") >= MIN_SECRET).join(good, "pattern")
    added = new.groupBy("row").agg(F.collect_list(F.struct("start", F.lit(len(PATTERNS)).alias("kind"), "end")).alias("added"))
    out = found.select("doc_id", "row", "base").join(added, "row", "left")
    return out.select("doc_id", "base", F.coalesce("added", F.array().cast("array<struct<start:int,kind:int,end:int>>")).alias("added"))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, the number of base spans of each kind, base_sha256, spans (all spans) and n_secret (those added) for each row of docs."""
    found = find(docs)

    def count(number: int) -> Column:
        return F.size(F.filter("base", lambda x: x["kind"] == number)).cast("long")

    counts = [count(i).alias(f"n_{kind}") for i, kind in enumerate(PATTERNS)]
    return found.select("doc_id", *counts, F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.array_sort(F.concat("base", "added"))).alias("spans"), F.size("added").cast("long").alias("n_secret"))
