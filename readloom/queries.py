"""Every operator as a query over the driver's tables, with the same query in DuckDB's SQL where SQL has it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom import functions as X
from readloom.codec.block import Shape
from readloom.operators import bytescan as B
from readloom.operators import runs as R
from readloom.operators import streams as S
from readloom.operators import tagstats as T
from readloom.options import FieldMask, Settings
from readloom.plans import derived as D
from readloom.plans.huffman import code_lengths

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: The derived relations of plans.derived in DuckDB's SQL.
READS = """reads AS (SELECT doc_id AS read_id, doc_id // 100 AS block_id, 'D' || doc_id AS name, concat_ws(' ', source, lang) AS comment,
    array_to_string(list_transform(string_split(text, ''), lambda c: substr('ACGTACGTACGTACGTN', (unicode(c) % 17 + 1)::INT, 1)), '') AS sequence,
    array_to_string(list_transform(string_split(text, ''), lambda c: chr((33 + unicode(c) % 41)::INT)), '') AS quality
    FROM documents WHERE length(text) > 0)"""
BASES = """bases AS (SELECT read_id, block_id, pos, substr('ACGTACGTACGTACGTN', (unicode(c) % 17 + 1)::INT, 1) AS base, (unicode(c) % 41)::INT AS q
    FROM (SELECT doc_id AS read_id, doc_id // 100 AS block_id, unnest(string_split(text, '')) AS c,
    (generate_subscripts(string_split(text, ''), 1) - 1)::INT AS pos FROM documents WHERE length(text) > 0))"""
TAGS = """tags AS (SELECT o_orderkey AS read_id, o_orderkey // 1000 AS block_id,
    '@O' || o_orderstatus || '.' || o_orderkey || ':' || o_custkey || ' P' || substr(o_orderpriority, 1, 1) AS tag FROM orders)"""
TOKENS = (
    TAGS
    + r""", tokens AS (SELECT read_id, block_id, unnest(regexp_split_to_array(tag, '[ ._,=:/\-#]')) AS token,
    generate_subscripts(regexp_split_to_array(tag, '[ ._,=:/\-#]'), 1)::INT AS field_no,
    unnest(list_concat(regexp_extract_all(tag, '[ ._,=:/\-#]'), [''])) AS sep FROM tags)"""
)
FIELDS = (
    TOKENS
    + """, fields AS (SELECT block_id, field_no, min(length(token))::INT AS min_length, max(length(token))::INT AS max_length,
    min(token) = max(token) AS is_constant, min(length(token)) = max(length(token)) AS constant_length,
    bool_and(regexp_full_match(token, '0|[1-9][0-9]*')) AS is_numeric FROM tokens GROUP BY block_id, field_no)"""
)
NUMBERS = (
    FIELDS
    + """, numbers AS (SELECT read_id, t.block_id, t.field_no, token::BIGINT AS value FROM tokens t
    JOIN fields f ON t.block_id = f.block_id AND t.field_no = f.field_no WHERE is_numeric AND NOT is_constant)
    , deltas AS (SELECT * FROM (SELECT read_id, block_id, field_no, value - lag(value) OVER (PARTITION BY block_id, field_no ORDER BY read_id) AS delta
    FROM numbers) WHERE delta IS NOT NULL)"""
)


def island_sql(name: str, rows: str, value: str, by: str, order: str, longest: int | None) -> str:
    part = f"((row_number() OVER (PARTITION BY {by}, run ORDER BY {order}) - 1) // {longest})" if longest else "0"
    return f"""{name}_b AS (SELECT *, CASE WHEN {value} IS DISTINCT FROM lag({value}) OVER (PARTITION BY {by} ORDER BY {order}) THEN 1 ELSE 0 END AS brk FROM {rows}),
    {name}_i AS (SELECT *, sum(brk) OVER (PARTITION BY {by} ORDER BY {order}) - 1 AS run FROM {name}_b),
    {name}_p AS (SELECT *, {part} AS part FROM {name}_i),
    {name} AS (SELECT {by}, run::BIGINT AS run, part::BIGINT AS part, min({value}) AS {value}, count(*)::BIGINT AS length FROM {name}_p GROUP BY {by}, run, part)"""


QUALITY_RUNS = BASES + ", " + island_sql("qruns", "bases", "q", "block_id", "read_id, pos", 255)
VALUE_RUNS = island_sql("vruns", "numbers", "value", "block_id, field_no", "read_id", 256)
DELTA_RUNS = island_sql("druns", "deltas", "delta", "block_id, field_no", "read_id", 256)
BIN = "CASE WHEN {q} < 2 THEN 0 WHEN {q} < 10 THEN 6 WHEN {q} < 20 THEN 15 WHEN {q} < 25 THEN 22 WHEN {q} < 30 THEN 27 WHEN {q} < 35 THEN 33 WHEN {q} < 40 THEN 37 ELSE 40 END"
SYMBOL = "(instr('AGCTNRWSKMDVHBYXU.-', base) - 1)"
STATS = (
    READS
    + """, stats AS (SELECT block_id, count(*)::BIGINT AS records, min(length(quality))::INT AS min_length, max(length(quality))::INT AS max_length,
    sum(length(quality))::BIGINT AS raw_length, sum(greatest(length(rtrim(quality, '#')) - 1, 0))::BIGINT AS truncated_length,
    sum(len(list_filter(list_zip(string_split(quality, ''), list_prepend('', string_split(quality, ''))[:-2]), lambda x: x[1] <> x[2])) - (right(quality, 1) = '#')::INT)::BIGINT AS rle_length,
    min(length(quality)) <> max(length(quality)) AS variable_length, min(substr(sequence, 1, 1)) = max(substr(sequence, 1, 1)) AS constant_first
    FROM reads GROUP BY block_id)"""
)


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.tokens(D.tags(spark, sf_dir))


@query(f"WITH {READS} SELECT block_id, count(*)::BIGINT AS records FROM reads GROUP BY block_id")
def record_count(spark, sf_dir):
    return D.reads(spark, sf_dir).groupBy("block_id").agg(F.count("*").alias("records"))


@query("SELECT count(*)::BIGINT AS records, count(*) FILTER (WHERE tag LIKE '@O%' AND doc_id % 7 <> 0 AND doc_id % 11 <> 0)::BIGINT AS valid FROM (SELECT doc_id, '@O' || doc_id AS tag FROM documents WHERE length(text) > 0)")
def valid_records(spark, sf_dir):
    """Reads of which every 7th has an empty plus line and every 11th lacks its last quality."""
    r = D.reads(spark, sf_dir)
    tag = F.concat(F.lit("@O"), F.col("read_id").cast("string"))
    plus = F.when(F.col("read_id") % 7 == 0, "").otherwise("+")
    quality = F.when(F.col("read_id") % 11 == 0, F.expr("left(quality, length(quality) - 1)")).otherwise(F.col("quality"))
    ok = X.valid_record(tag, F.col("sequence"), plus, quality)
    return r.agg(F.count("*").alias("records"), F.count_if(ok).alias("valid"))


@query(f"""WITH {BASES}, r AS (SELECT block_id, min(q + 33)::INT AS low, max(q + 33)::INT AS high FROM bases GROUP BY block_id)
    SELECT block_id, low, high, CASE WHEN high <= 74 AND low >= 33 THEN 33 WHEN high <= 105 AND low >= 64 THEN 64
    WHEN high <= 105 AND low >= 59 THEN 59 WHEN high <= 105 AND low >= 33 THEN 33 END AS quality_offset FROM r""")  # fmt: skip
def phred_offset(spark, sf_dir):
    return S.phred_offset(D.reads(spark, sf_dir))


@query(f"WITH {BASES} SELECT block_id, base, count(*)::BIGINT AS n FROM bases WHERE NOT ({SYMBOL} > 3 AND q < 7) GROUP BY block_id, base")
def dna_histogram(spark, sf_dir):
    return S.dna_histogram(D.reads(spark, sf_dir))


@query(f"WITH {BASES} SELECT block_id, q, count(*)::BIGINT AS n FROM bases GROUP BY block_id, q")
def quality_histogram(spark, sf_dir):
    return S.quality_histogram(D.reads(spark, sf_dir))


@query(f"""WITH {BASES}, h AS (SELECT block_id, base, count(*)::BIGINT AS n FROM bases WHERE NOT ({SYMBOL} > 3 AND q < 7) GROUP BY block_id, base)
    SELECT block_id, base, n, (dense_rank() OVER (PARTITION BY block_id ORDER BY {SYMBOL}) - 1)::INT AS symbol_rank,
    count(*) OVER (PARTITION BY block_id)::BIGINT AS n_symbols FROM h""")  # fmt: skip
def symbol_rank(spark, sf_dir):
    return S.symbol_ranks(S.dna_histogram(D.reads(spark, sf_dir)), "base", S.base_order())


@query(f"WITH {BASES} SELECT pos, q, count(*)::BIGINT AS n FROM bases GROUP BY pos, q")
def quality_by_position(spark, sf_dir):
    return S.quality_by_position(D.reads(spark, sf_dir))


@query(f"""WITH {READS}, cut AS (SELECT left(quality, greatest(1, length(rtrim(quality, '#')))::INT) AS s FROM reads)
    SELECT pos, (unicode(c) - 33)::INT AS q, count(*)::BIGINT AS n FROM (SELECT unnest(string_split(s, '')) AS c,
    (generate_subscripts(string_split(s, ''), 1) - 1)::INT AS pos FROM cut) GROUP BY ALL""")  # fmt: skip
def quality_by_position_truncated(spark, sf_dir):
    return S.quality_by_position_truncated(D.reads(spark, sf_dir), D.OFFSET)


@query(f"WITH {STATS} SELECT * FROM stats")
def length_stats(spark, sf_dir):
    return S.length_stats(D.reads(spark, sf_dir))


@query(f"""WITH {BASES} SELECT read_id, string_agg(CASE WHEN base IN ('A', 'C', 'G', 'T') THEN base ELSE 'N' END, '' ORDER BY pos) AS sequence,
    string_agg(CASE WHEN base NOT IN ('A', 'C', 'G', 'T') THEN '!' ELSE chr((33 + greatest(6, {BIN.format(q="q")}))::INT) END, '' ORDER BY pos) AS quality
    FROM bases GROUP BY read_id""")  # fmt: skip
def lossy_quality(spark, sf_dir):
    s, q = F.col("sequence"), F.col("quality")
    return D.reads(spark, sf_dir).select("read_id", X.lossy_sequence(s).alias("sequence"), X.lossy_quality(s, q, D.OFFSET).alias("quality"))


@query(f"SELECT q, ({BIN.format(q='q')})::INT AS binned FROM (SELECT unnest(range(0, 94))::BIGINT AS q)")
def quality_bins(spark, sf_dir):
    return spark.range(94).select(F.col("id").alias("q"), X.bin_quality(F.col("id")).alias("binned"))


@query(f"""WITH {BASES}, t AS (SELECT block_id, CASE WHEN {SYMBOL} > 3 AND q < 7 THEN 128 + 8 * ({SYMBOL} - 4) + q ELSE q END AS symbol,
    {SYMBOL} > 3 AND q < 7 AS moved FROM bases) SELECT block_id, symbol::INT AS symbol, moved, count(*)::BIGINT AS n FROM t GROUP BY ALL""")  # fmt: skip
def ambiguity_transfer(spark, sf_dir):
    return B.transfer_counts(D.reads(spark, sf_dir), D.OFFSET)


@query(f"WITH {BASES} SELECT block_id, base, q, count(*)::BIGINT AS n FROM bases GROUP BY ALL")
def ambiguity_roundtrip(spark, sf_dir):
    """Bases and qualities after the transfer and back are those before."""
    index = X.symbol_index(F.col("base"))
    symbol = X.to_transferred(index, F.col("q"))
    one = D.bases(spark, sf_dir).select("block_id", symbol.alias("s"), F.when(symbol < 128, index).alias("kept"))
    back = one.select("block_id", "kept", X.from_transferred(F.col("s")).alias("x"))
    whole = back.select("block_id", F.coalesce("x.index", "kept").alias("i"), F.col("x.q").alias("q"))
    return whole.select("block_id", X.unindex_bases(F.array("i")).alias("base"), "q").groupBy("block_id", "base", "q").agg(F.count("*").alias("n"))


@query(f"WITH {TAGS} SELECT read_id, split_part(substr(tag, 2), ' ', 1) AS name, substr(tag, instr(tag, ' ') + 1) AS comment FROM tags")
def tag_split(spark, sf_dir):
    return D.tags(spark, sf_dir).select("read_id", X.split_name(F.col("tag")).alias("name"), X.split_comment(F.col("tag")).alias("comment"))


@query("SELECT doc_id AS read_id, '@' || source || CASE WHEN doc_id % 3 = 0 THEN '' ELSE ' ' || lang END AS tag FROM documents")
def tag_join(spark, sf_dir):
    comment = F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("lang"))
    return D.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("read_id"), X.join_tag(F.col("source"), comment).alias("tag"))


@query("SELECT o_orderkey AS read_id, '@O' || o_orderstatus || '.' || o_custkey || ' P' || substr(o_orderpriority, 1, 1) AS tag FROM orders")
def tag_mask(spark, sf_dir):
    """Without the second field, the order's key."""
    return D.tags(spark, sf_dir).select("read_id", X.mask_tag(F.col("tag"), FieldMask.of(1, 3, 4)).alias("tag"))


@query(f"WITH {TAGS} SELECT read_id, CASE WHEN read_id % 2 = 0 THEN '+' || substr(tag, 2) ELSE '+' END AS plus FROM tags")
def plus_lines(spark, sf_dir):
    return D.tags(spark, sf_dir).select("read_id", X.plus_line(F.col("tag"), F.col("read_id") % 2 == 0).alias("plus"))


@query(f"WITH {TOKENS} SELECT read_id, block_id, field_no, token, sep FROM tokens")
def tag_tokens(spark, sf_dir):
    return tokens(spark, sf_dir)


@query(f"""WITH {TAGS} SELECT block_id, CASE WHEN min(array_to_string(regexp_extract_all(tag, '[ ._,=:/\\-#]'), '')) = max(array_to_string(regexp_extract_all(tag, '[ ._,=:/\\-#]'), ''))
    THEN 'fields' ELSE 'raw' END AS tag_format FROM tags GROUP BY block_id""")  # fmt: skip
def tag_format(spark, sf_dir):
    return T.tag_format(D.tags(spark, sf_dir))


@query(f"WITH {TAGS} SELECT block_id, min(length(tag))::INT AS min_length, max(length(tag))::INT AS max_length FROM tags GROUP BY block_id")
def title_stats(spark, sf_dir):
    return T.title_stats(D.tags(spark, sf_dir))


@query(f"WITH {FIELDS} SELECT * FROM fields")
def tag_field_stats(spark, sf_dir):
    return T.field_stats(tokens(spark, sf_dir))


LETTERS = TOKENS + """, letters AS (SELECT block_id, field_no, unnest(string_split(token, '')) AS ch,
    least(generate_subscripts(string_split(token, ''), 1) - 1, 128)::INT AS pos FROM tokens WHERE length(token) > 0)"""  # fmt: skip


@query(f"WITH {LETTERS} SELECT block_id, field_no, pos, ch, count(*)::BIGINT AS n FROM letters GROUP BY ALL")
def tag_char_histogram(spark, sf_dir):
    return T.char_histogram(tokens(spark, sf_dir))


@query(f"WITH {LETTERS} SELECT block_id, field_no, pos, min(ch) = max(ch) AS invariant FROM letters GROUP BY block_id, field_no, pos")
def tag_hamming_mask(spark, sf_dir):
    return T.hamming_mask(tokens(spark, sf_dir))


RANGE = "SELECT block_id, field_no, min({v}) AS min_{v}, max({v}) AS max_{v}, CASE WHEN count(DISTINCT {v}) <= 512 THEN count(DISTINCT {v}) END AS n_{v}s FROM {t} GROUP BY block_id, field_no"


@query(f"WITH {NUMBERS} {RANGE.format(v='value', t='numbers')}")
def tag_numeric_range(spark, sf_dir):
    return T.numeric_range(T.numbers(tokens(spark, sf_dir)))


@query(f"WITH {NUMBERS} {RANGE.format(v='delta', t='deltas')}")
def tag_delta_stats(spark, sf_dir):
    return T.delta_stats(T.numbers(tokens(spark, sf_dir)))


COUNTS = "SELECT * FROM (SELECT block_id, field_no, {v}, count(*)::BIGINT AS n FROM {t} GROUP BY ALL) QUALIFY count(*) OVER (PARTITION BY block_id, field_no) <= 512"


@query(f"WITH {NUMBERS}, ends AS (SELECT block_id, field_no, value % 100 AS value FROM numbers) {COUNTS.format(v='value', t='ends')}")
def tag_value_counts(spark, sf_dir):
    """Of the last two digits, as the numbers themselves have too many values."""
    return T.value_counts(T.numbers(tokens(spark, sf_dir)).withColumn("value", F.col("value") % 100))


@query(f"WITH {NUMBERS} {COUNTS.format(v='delta', t='deltas')}")
def tag_delta_counts(spark, sf_dir):
    return T.delta_counts(T.numbers(tokens(spark, sf_dir)))


@query(f"WITH {TAGS} SELECT block_id, ch, count(*)::BIGINT AS n FROM (SELECT block_id, unnest(string_split(tag, '')) AS ch FROM tags) GROUP BY ALL")
def title_char_histogram(spark, sf_dir):
    return T.title_char_histogram(D.tags(spark, sf_dir))


@query(f"WITH {NUMBERS}, {VALUE_RUNS} SELECT * FROM vruns")
def tag_value_runs(spark, sf_dir):
    return T.value_runs(T.numbers(tokens(spark, sf_dir)))


@query(f"WITH {NUMBERS}, {DELTA_RUNS} SELECT * FROM druns")
def tag_delta_runs(spark, sf_dir):
    return T.delta_runs(T.numbers(tokens(spark, sf_dir)))


@query(f"""WITH {NUMBERS}, {VALUE_RUNS}, {DELTA_RUNS},
    a AS (SELECT block_id, field_no, count(*) AS records, max(value) - min(value) AS vr, count(DISTINCT value) AS nv FROM numbers GROUP BY block_id, field_no),
    b AS (SELECT block_id, field_no, max(delta) - min(delta) AS dr, count(DISTINCT delta) AS nd FROM deltas GROUP BY block_id, field_no),
    c AS (SELECT block_id, field_no, count(*) AS rv FROM vruns GROUP BY block_id, field_no),
    d AS (SELECT block_id, field_no, count(*) AS rd FROM druns GROUP BY block_id, field_no),
    e AS (SELECT block_id, field_no, vr, dr, nv, nd, coalesce(vr >= dr, false) AS by_delta, (records::FLOAT / rv::FLOAT) > 1.25::FLOAT AS pv, coalesce((records::FLOAT / rd::FLOAT) > 1.25::FLOAT, false) AS pd
        FROM a LEFT JOIN b USING (block_id, field_no) JOIN c USING (block_id, field_no) LEFT JOIN d USING (block_id, field_no)),
    f AS (SELECT *, CASE WHEN by_delta AND dr = 0 THEN 'delta_constant' WHEN by_delta AND pd THEN 'delta_runs' WHEN pv THEN 'value_runs' WHEN by_delta THEN 'delta' ELSE 'value' END AS scheme FROM e)
    SELECT block_id, field_no, scheme, scheme IN ('delta', 'value') AND (CASE WHEN by_delta THEN dr ELSE vr END) + 1 <= 512 AND (CASE WHEN by_delta THEN nd ELSE nv END) <= 512 AS huffman FROM f""")  # fmt: skip
def tag_numeric_scheme(spark, sf_dir):
    return T.numeric_scheme(T.numbers(tokens(spark, sf_dir)))


@query(f"WITH {QUALITY_RUNS} SELECT block_id, q, (length - 1)::BIGINT AS stored, count(*)::BIGINT AS n, sum(run * 7 + part)::BIGINT AS places FROM qruns GROUP BY ALL")
def quality_runs(spark, sf_dir):
    r = R.quality_runs(D.reads(spark, sf_dir))
    return r.groupBy("block_id", "q", (F.col("length") - 1).alias("stored")).agg(F.count("*").alias("n"), F.sum(F.col("run") * 7 + F.col("part")).alias("places"))


@query(f"""WITH {QUALITY_RUNS}, p AS (SELECT block_id, q, coalesce(lag(q) OVER (PARTITION BY block_id ORDER BY run, part), min(q) OVER (PARTITION BY block_id)) AS previous FROM qruns)
    SELECT block_id, previous, q, count(*)::BIGINT AS n FROM p GROUP BY ALL""")  # fmt: skip
def run_transitions(spark, sf_dir):
    return R.run_transitions(R.quality_runs(D.reads(spark, sf_dir)))


@query(f"WITH {QUALITY_RUNS} SELECT block_id, q, (length - 1)::BIGINT AS stored, count(*)::BIGINT AS n FROM qruns GROUP BY ALL")
def run_length_by_symbol(spark, sf_dir):
    return R.run_lengths(R.quality_runs(D.reads(spark, sf_dir)))


@query(f"WITH {BASES} SELECT block_id, q, count(*)::BIGINT AS n, sum(place)::BIGINT AS places FROM (SELECT block_id, q, row_number() OVER (PARTITION BY block_id ORDER BY read_id, pos) - 1 AS place FROM bases) GROUP BY ALL")
def run_expand(spark, sf_dir):
    """Runs, expanded again: each quality's count and places."""
    back = R.expand_runs(R.quality_runs(D.reads(spark, sf_dir)), "q", ["block_id"])
    return back.groupBy("block_id", "q").agg(F.count("*").alias("n"), F.sum("at").alias("places"))


@query("WITH " + island_sql("er", "events", "event_type", "user_id", "event_id", None) + " SELECT user_id, run, part, event_type, length FROM er")
def event_runs(spark, sf_dir):
    # One user may have a large share of the events, so a user's events are cut by their ids.
    chunk = F.floor(F.col("event_id") / 65536)
    return R.runs_by_chunk(D.table(spark, sf_dir, "events"), "event_type", ["user_id"], ["event_id"], chunk).select("user_id", "run", "part", "event_type", "length")


#: Colours one by one: the state before position i is the last base up to there that isn't N.
COLORS = BASES + """, st AS (SELECT read_id, pos, base, last_value(CASE WHEN base <> 'N' THEN instr('ACGT', base) - 1 END IGNORE NULLS)
    OVER (PARTITION BY read_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM bases),
    col AS (SELECT read_id, string_agg(CASE WHEN pos = 0 THEN base WHEN base = 'N' THEN '.' ELSE xor(coalesce(before, 0)::INT, (instr('ACGT', base) - 1)::INT)::VARCHAR END, '' ORDER BY pos) AS colors FROM st GROUP BY read_id)"""  # fmt: skip


@query(f"WITH {COLORS} SELECT read_id, colors FROM col")
def colorspace_encode(spark, sf_dir):
    return D.reads(spark, sf_dir).select("read_id", X.bases_to_colors(F.col("sequence")).alias("colors"))


@query(f"WITH {READS} SELECT read_id, sequence FROM reads")
def colorspace_decode(spark, sf_dir):
    colored = D.reads(spark, sf_dir).select("read_id", X.bases_to_colors(F.col("sequence")).alias("colors"))
    return colored.select("read_id", X.colors_to_bases(F.col("colors")).alias("sequence"))


@query(f"WITH {COLORS} SELECT read_id, regexp_matches(substr(colors, 2, 1), '^[0-3.]$') AS is_color, substr(colors, 2) AS stripped FROM col")
def colorspace_primer(spark, sf_dir):
    """Whether a read is in colour space, and its colours without the primer base."""
    r = D.reads(spark, sf_dir).select("read_id", X.bases_to_colors(F.col("sequence")).alias("c"))
    return r.select("read_id", X.is_color_space(F.col("c")).alias("is_color"), F.substring("c", 2, 2147483647).alias("stripped"))


@query(f"""WITH {READS}, g AS (SELECT unnest(list_transform(range(1, length(sequence) - 2), lambda i: substr(sequence, i, 4))) AS g FROM reads)
    SELECT substr(g, 1, 3) AS context, substr(g, 4, 1) AS next, count(*)::BIGINT AS n FROM g GROUP BY ALL""")  # fmt: skip
def kmer_context_counts(spark, sf_dir):
    return S.kmer_context_counts(D.reads(spark, sf_dir), 3)


@query(f"""WITH {READS}, g AS (SELECT unnest(list_transform(range(1, length(quality)), lambda i: [substr(quality, i, 2), (i * 8 // length(quality))::VARCHAR])) AS g FROM reads)
    SELECT substr(g[1], 1, 1) AS context, g[2]::INT AS bucket, substr(g[1], 2, 1) AS symbol, count(*)::BIGINT AS n FROM g GROUP BY ALL""")  # fmt: skip
def quality_context_counts(spark, sf_dir):
    return S.quality_context_counts(D.reads(spark, sf_dir), 1, 8)


LAST = "coalesce(lag({x}, {i}) OVER (PARTITION BY block_id ORDER BY read_id, pos), 0)"
BACK = ", ".join(LAST.format(x="q", i=i) + f" AS p{i}" for i in range(1, 5))


@query(f"""WITH {BASES}, c AS (SELECT concat_ws(',', {", ".join(LAST.format(x="unicode(base)", i=i) for i in range(1, 4))}) AS context, unicode(base)::INT AS symbol FROM bases)
    SELECT context, symbol, count(*)::BIGINT AS n FROM c GROUP BY ALL""")  # fmt: skip
def base_model_counts(spark, sf_dir):
    return S.base_model_counts(D.reads(spark, sf_dir), 3)


@query(f"""WITH {BASES}, c AS (SELECT q, pos, count(*) OVER (PARTITION BY read_id) AS size, {BACK} FROM bases)
    SELECT concat_ws(',', p1, (p2 + p3) // 2, (p3 + p4) // 2) AS context, (pos * 8 // size)::INT AS bucket, q AS symbol, count(*)::BIGINT AS n FROM c GROUP BY ALL""")  # fmt: skip
def quality_model_counts(spark, sf_dir):
    return S.quality_model_counts(D.reads(spark, sf_dir), D.OFFSET, 3, 8)


@query(f"""WITH {READS} SELECT block_id, sum(length('@' || name || ' ' || comment))::BIGINT AS tag, sum(length(sequence))::BIGINT AS dna, sum(length(quality))::BIGINT AS quality
    FROM reads GROUP BY ROLLUP (block_id)""")  # fmt: skip
def stream_sizes(spark, sf_dir):
    return S.stream_sizes(D.reads(spark, sf_dir))


#: The CRC-32 of a block's tags: a byte table from eight steps for each byte, then a table step for each byte of the text.
CRC = "list_reduce([i] || range(8), lambda x, _: xor(x // 2, (x % 2) * 3988292384))"


@query(f"""WITH {TAGS}, t AS (SELECT list_transform(range(256), lambda i: {CRC}) AS t),
    texts AS (SELECT block_id, string_agg(tag, '' ORDER BY read_id) AS s FROM tags GROUP BY block_id)
    SELECT block_id, xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(s, ''), lambda c: unicode(c)::BIGINT),
    lambda x, b: xor(x // 256, t[xor(x % 256, b) + 1])), 4294967295) AS crc32_tag FROM texts, t""")  # fmt: skip
def stream_crc32(spark, sf_dir):
    return S.stream_crc32(D.tags(spark, sf_dir), ["tag"])


@query(f"""WITH {BASES}, r AS (SELECT count(*)::BIGINT AS records FROM documents WHERE length(text) > 0), l AS (SELECT min(q + 33) AS low, max(q + 33) AS high FROM bases)
    SELECT records, CASE WHEN high <= 74 AND low >= 33 THEN 33 WHEN high <= 105 AND low >= 64 THEN 64 WHEN high <= 105 AND low >= 59 THEN 59
    WHEN high <= 105 AND low >= 33 THEN 33 END AS quality_offset, true AS plus_repetition, false AS color_space, true AS consistent FROM r, l""")  # fmt: skip
def dataset_type(spark, sf_dir):
    """Of reads whose plus lines repeat their tags."""
    return S.dataset_type(D.reads(spark, sf_dir).withColumn("plus", F.concat(F.lit("+"), "name")))


@query(f"""WITH {BASES}, h AS (SELECT DISTINCT block_id, base FROM bases WHERE NOT ({SYMBOL} > 3 AND q < 7))
    SELECT block_id, count(*)::BIGINT AS n_symbols, CASE WHEN count(*) <= 4 THEN 'two_bits' ELSE 'huffman' END AS dna_scheme FROM h GROUP BY block_id""")  # fmt: skip
def dna_scheme(spark, sf_dir):
    return S.dna_scheme(S.dna_histogram(D.reads(spark, sf_dir)))


@query(f"""WITH {STATS} SELECT block_id, CASE WHEN rle_length > 0 AND truncated_length::FLOAT / rle_length::FLOAT > 1.25::FLOAT THEN 'rle'
    WHEN truncated_length > 0 AND raw_length::FLOAT / truncated_length::FLOAT > 1.10::FLOAT THEN 'truncated' ELSE 'plain' END AS quality_scheme FROM stats""")  # fmt: skip
def quality_scheme(spark, sf_dir):
    return S.quality_scheme(S.length_stats(D.reads(spark, sf_dir)))


@query(f"""WITH {STATS}, n AS (SELECT block_id, count(DISTINCT unicode(c)) AS n FROM (SELECT block_id, unnest(string_split(quality, '')) AS c FROM reads) GROUP BY block_id)
    SELECT block_id, CASE WHEN n <= 16 THEN 16 WHEN n <= 32 THEN 32 WHEN n <= 64 THEN 64 ELSE 128 END AS model_symbols,
    min_length = max_length AND raw_length::FLOAT / rle_length::FLOAT > 1.175::FLOAT AS rle_bonus FROM stats JOIN n USING (block_id)""")  # fmt: skip
def quality_order_model(spark, sf_dir):
    return S.quality_order_model(S.length_stats(D.reads(spark, sf_dir)), S.quality_histogram(D.reads(spark, sf_dir)), 2)


#: Each step merges the two rarest of a block's list; a symbol's code is as long as there are merges with it.
HUFFMAN = """h AS (SELECT block_id, list_sort(list({'n': n, 's': q::BIGINT, 'all': [q::BIGINT]})) AS heap FROM (SELECT block_id, q, count(*)::BIGINT AS n FROM bases GROUP BY ALL) GROUP BY block_id),
    m AS (SELECT block_id, 1000::BIGINT AS fresh, heap, []::BIGINT[] AS merged FROM h
    UNION ALL SELECT block_id, fresh + 1, list_sort(list_append(heap[3:], {'n': heap[1].n + heap[2].n, 's': fresh, 'all': heap[1].all || heap[2].all})), heap[1].all || heap[2].all FROM m WHERE len(heap) > 1)"""


@query(f"WITH RECURSIVE {BASES}, {HUFFMAN} SELECT block_id, q, count(*)::INT AS code_length FROM (SELECT block_id, unnest(merged) AS q FROM m) GROUP BY ALL")
def huffman_code_lengths(spark, sf_dir):
    return code_lengths(S.quality_histogram(D.reads(spark, sf_dir)), "block_id", "q", "n")


@query("""SELECT token, regexp_full_match(token, '0|[1-9][0-9]*') AS is_num, CASE WHEN regexp_full_match(token, '0|[1-9][0-9]*') THEN token::BIGINT END AS num, token::BIGINT::VARCHAR AS text,
    CASE WHEN token::BIGINT = 0 THEN 0 ELSE length(bin(token::BIGINT)) END::INT AS bits, (length(token::BIGINT::VARCHAR) - 1)::INT AS log10, token LIKE '%7' AS ends_7
    FROM (SELECT DISTINCT CASE WHEN o_orderkey % 5 = 0 THEN '0' ELSE '' END || (o_custkey + 1) AS token FROM orders)""")  # fmt: skip
def scalar_functions(spark, sf_dir):
    key = F.concat(F.when(F.col("o_orderkey") % 5 == 0, "0").otherwise(""), (F.col("o_custkey") + 1).cast("string"))
    t = D.table(spark, sf_dir, "orders").select(key.alias("token")).distinct()
    token, n = F.col("token"), F.col("token").cast("bigint")
    return t.select("token", X.is_number(token).alias("is_num"), X.to_number(token).alias("num"), X.to_text(n).alias("text"), X.bit_length(n).alias("bits"), X.int_log(n, 10).alias("log10"), X.ends_with(token, "7").alias("ends_7"))


SAME_READS = f"WITH {READS} SELECT row_number() OVER (ORDER BY read_id) - 1 AS read_id, name, comment, sequence, quality FROM reads"


@query(SAME_READS)
def fastq_roundtrip(spark, sf_dir):
    """Reads written as FASTQ text and read again are the same reads in the same order."""
    from readloom.sources import read_fastq, with_read_ids, write_fastq

    path = f"{scratch(spark)}/fastq-{uuid.uuid4().hex}"
    write_fastq(D.reads(spark, sf_dir), path)
    return with_read_ids(read_fastq(spark, path.removeprefix("file://"), "FAILFAST", 1 << 18)).select("read_id", "name", "comment", "sequence", "quality")


@query(SAME_READS.replace("row_number() OVER (ORDER BY read_id) - 1 AS read_id", "read_id"))
def archive_roundtrip(spark, sf_dir):
    """Reads written to an archive with checksums and read again are the same reads."""
    from readloom.sources import read_archive, verify_archive, write_archive

    path = f"{scratch(spark)}/archive-{uuid.uuid4().hex}"
    write_archive(D.reads(spark, sf_dir), path, settings=Settings(crc32=True), reads_per_block=100)
    verify_archive(spark, path)
    return read_archive(spark, path).select("read_id", "name", "comment", "sequence", "quality")


def through_blocks(spark: SparkSession, reads: DataFrame, shape, folder: bool = False) -> DataFrame:
    """Reads written to a binary block archive, or a folder of them, and read again."""
    from readloom.sources.blockfile import read_blocks, write_block_folder, write_blocks
    from readloom.sources.fastq import with_read_ids

    path = f"{scratch(spark)}/blocks-{uuid.uuid4().hex}"
    (write_block_folder if folder else write_blocks)(reads, path, shape, 1 << 18)
    return with_read_ids(read_blocks(spark, path)).select("read_id", "name", "comment", "sequence", "quality")


@query(SAME_READS)
def blockfile_roundtrip(spark, sf_dir):
    return through_blocks(spark, D.reads(spark, sf_dir), Shape(D.OFFSET, crc32=True))


@query(f"""WITH {TAGS} SELECT row_number() OVER (ORDER BY read_id) - 1 AS read_id, split_part(substr(tag, 2), ' ', 1) AS name, substr(tag, instr(tag, ' ') + 1) AS comment,
    'ACGT' AS sequence, 'IIII' AS quality FROM tags""")  # fmt: skip
def blockfile_tokens_roundtrip(spark, sf_dir):
    """Tags that are stored by fields."""
    reads = D.tags(spark, sf_dir).select("read_id", X.split_name(F.col("tag")).alias("name"), X.split_comment(F.col("tag")).alias("comment"), F.lit("ACGT").alias("sequence"), F.lit("IIII").alias("quality"))
    return through_blocks(spark, reads, Shape(D.OFFSET, crc32=True), folder=True)


@query(SAME_READS)
def blockfile_orders_roundtrip(spark, sf_dir):
    """Range-coded bases and qualities at the highest levels without loss."""
    return through_blocks(spark, D.reads(spark, sf_dir), Shape(D.OFFSET, crc32=True, dna_order=9, quality_order=2), folder=True)


LOSSY = f"""string_agg(CASE WHEN base IN ('A', 'C', 'G', 'T') THEN base ELSE 'N' END, '' ORDER BY pos) AS sequence,
    string_agg(CASE WHEN base NOT IN ('A', 'C', 'G', 'T') THEN '!' ELSE chr((33 + greatest(6, {BIN.format(q="q")}))::INT) END, '' ORDER BY pos) AS quality"""


@query(f"""WITH {BASES}, l AS (SELECT read_id, {LOSSY} FROM bases GROUP BY read_id), {READS} SELECT row_number() OVER (ORDER BY l.read_id) - 1 AS read_id, name, comment, l.sequence, l.quality
    FROM l JOIN reads ON l.read_id = reads.read_id""")  # fmt: skip
def blockfile_lossy_roundtrip(spark, sf_dir):
    return through_blocks(spark, D.reads(spark, sf_dir), Shape(D.OFFSET, lossy=True, quality_order=3), folder=True)


@query(f"""WITH {COLORS}, primed AS (SELECT read_id, 'T' || string_agg(CASE WHEN base = 'N' THEN '.' ELSE xor(coalesce(before, 3)::INT, (instr('ACGT', base) - 1)::INT)::VARCHAR END, '' ORDER BY pos) AS c
    FROM st GROUP BY read_id), {READS} SELECT row_number() OVER (ORDER BY reads.read_id) - 1 AS read_id, name, comment, c AS sequence, 'I' || quality AS quality
    FROM primed JOIN reads ON primed.read_id = reads.read_id""")  # fmt: skip
def blockfile_colorspace_roundtrip(spark, sf_dir):
    """Colours after a primer base that all reads share."""
    reads = D.reads(spark, sf_dir)
    reads = reads.withColumn("sequence", X.bases_to_colors(F.concat(F.lit("T"), "sequence"))).withColumn("quality", F.concat(F.lit("I"), "quality"))
    return through_blocks(spark, reads, Shape(D.OFFSET, color_space=True), folder=True)


def scratch(spark: SparkSession) -> str:
    """A folder that the driver and the executors share: spark.checkpoint.dir, or in local mode one of this process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    import atexit
    import shutil
    import tempfile

    own = tempfile.mkdtemp(prefix="readloom-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    return f"file://{own}"
