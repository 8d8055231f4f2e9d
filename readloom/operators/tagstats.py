"""Profiles of tag fields by block and field number, and the encoding that each field would get."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from readloom.functions.scalars import is_number, to_number
from readloom.functions.tags import tag_fields, tag_separators
from readloom.operators.runs import deltas, runs

#: How many distinct values are still counted, positions with counts of their own, and when runs pay.
MOST_VALUES, MOST_POSITIONS, RUN_RATIO = 512, 128, 1.25


def tokens(tags: DataFrame) -> DataFrame:
    """read_id, block_id, field_no (from 1), token, sep: the separator after the field, empty for the last."""
    fields = F.arrays_zip(tag_fields(F.col("tag")).alias("token"), tag_separators(F.col("tag")).alias("sep"))
    one = tags.select("read_id", "block_id", F.posexplode(fields).alias("i", "x"))
    return one.select("read_id", "block_id", (F.col("i") + 1).alias("field_no"), F.col("x.token").alias("token"), F.coalesce("x.sep", F.lit("")).alias("sep"))


def tag_format(tags: DataFrame) -> DataFrame:
    """block_id, tag_format: fields if all tags of the block have the same separators, else raw."""
    signature = F.array_join(tag_separators(F.col("tag")), "")
    return tags.groupBy("block_id").agg((F.min(signature) == F.max(signature)).alias("same")).select("block_id", F.when(F.col("same"), "fields").otherwise("raw").alias("tag_format"))


def title_stats(tags: DataFrame) -> DataFrame:
    return tags.groupBy("block_id").agg(F.min(F.length("tag")).alias("min_length"), F.max(F.length("tag")).alias("max_length"))


def title_char_histogram(tags: DataFrame) -> DataFrame:
    """block_id, ch, n: how often each character is in the tags of a block."""
    one = tags.select("block_id", F.explode(F.filter(F.split("tag", ""), lambda c: c != "")).alias("ch"))
    return one.groupBy("block_id", "ch").agg(F.count("*").alias("n"))


def field_stats(tokens: DataFrame) -> DataFrame:
    """Per block and field: shortest and longest token, whether it is constant, of constant length, numeric."""
    n = F.length("token")
    return tokens.groupBy("block_id", "field_no").agg(
        F.min(n).alias("min_length"), F.max(n).alias("max_length"), (F.min("token") == F.max("token")).alias("is_constant"),
        (F.min(n) == F.max(n)).alias("constant_length"), F.bool_and(is_number(F.col("token"))).alias("is_numeric"),
    )


def _letters(tokens: DataFrame) -> DataFrame:
    one = tokens.select("block_id", "field_no", F.posexplode(F.filter(F.split("token", ""), lambda c: c != "")).alias("pos", "ch"))
    return one.withColumn("pos", F.least("pos", F.lit(MOST_POSITIONS)))


def char_histogram(tokens: DataFrame) -> DataFrame:
    """block_id, field_no, pos, ch, n; all positions from 128 on share one."""
    return _letters(tokens).groupBy("block_id", "field_no", "pos", "ch").agg(F.count("*").alias("n"))


def hamming_mask(tokens: DataFrame) -> DataFrame:
    """block_id, field_no, pos, invariant: whether every token has the same character there."""
    return _letters(tokens).groupBy("block_id", "field_no", "pos").agg((F.min("ch") == F.max("ch")).alias("invariant"))


def numbers(tokens: DataFrame) -> DataFrame:
    """read_id, block_id, field_no, value: of the fields that are numeric in their whole block and not constant."""
    numeric = field_stats(tokens).where("is_numeric and not is_constant").select("block_id", "field_no")
    return tokens.join(numeric, ["block_id", "field_no"]).select("read_id", "block_id", "field_no", to_number(F.col("token")).alias("value"))


def numeric_range(numbers: DataFrame) -> DataFrame:
    """Least and largest value and the number of distinct ones, which is null over 512."""
    d = F.count_distinct("value")
    return numbers.groupBy("block_id", "field_no").agg(F.min("value").alias("min_value"), F.max("value").alias("max_value"), F.when(d <= MOST_VALUES, d).alias("n_values"))


def few_counts(rows: DataFrame, value: str) -> DataFrame:
    """block_id, field_no, value, n: how often each value is there, of fields with at most 512 distinct ones."""
    keys = ["block_id", "field_no"]
    counts = rows.groupBy(*keys, value).agg(F.count("*").alias("n"))
    few = counts.groupBy(*keys).agg(F.count("*").alias("distinct")).where(F.col("distinct") <= MOST_VALUES).select(*keys)
    return counts.join(few, keys)


def value_counts(numbers: DataFrame) -> DataFrame:
    return few_counts(numbers, "value")


def delta_counts(numbers: DataFrame) -> DataFrame:
    return few_counts(deltas(numbers, "value", ["block_id", "field_no"], "read_id").where("delta is not null"), "delta")


def delta_stats(numbers: DataFrame) -> DataFrame:
    d = deltas(numbers, "value", ["block_id", "field_no"], "read_id").where("delta is not null")
    n = F.count_distinct("delta")
    return d.groupBy("block_id", "field_no").agg(F.min("delta").alias("min_delta"), F.max("delta").alias("max_delta"), F.when(n <= MOST_VALUES, n).alias("n_deltas"))


def value_runs(numbers: DataFrame) -> DataFrame:
    """Runs of equal values over consecutive reads, in parts of 256 rows."""
    return runs(numbers, "value", ["block_id", "field_no"], ["read_id"], 256)


def delta_runs(numbers: DataFrame) -> DataFrame:
    d = deltas(numbers, "value", ["block_id", "field_no"], "read_id").where("delta is not null")
    return runs(d, "delta", ["block_id", "field_no"], ["read_id"], 256)


def numeric_scheme(numbers: DataFrame) -> DataFrame:
    """block_id, field_no, scheme: how a numeric field would be stored."""
    keys = ["block_id", "field_no"]
    size = numbers.groupBy(*keys).agg(F.count("*").alias("records"))
    v = value_runs(numbers).groupBy(*keys).agg(F.count("*").alias("value_runs"))
    d = delta_runs(numbers).groupBy(*keys).agg(F.count("*").alias("delta_runs"))
    one = size.join(numeric_range(numbers), keys).join(delta_stats(numbers), keys, "left").join(v, keys).join(d, keys, "left")
    value_range, delta_range = F.col("max_value") - F.col("min_value"), F.col("max_delta") - F.col("min_delta")
    pays = lambda n: F.coalesce((F.col("records").cast("float") / F.col(n).cast("float")).cast("float") > F.lit(RUN_RATIO).cast("float"), F.lit(False))
    by_delta = F.coalesce(value_range >= delta_range, F.lit(False))
    scheme = (
        F.when(by_delta & (F.col("min_delta") == F.col("max_delta")), "delta_constant")
        .when(by_delta & pays("delta_runs"), "delta_runs")
        .when(pays("value_runs"), "value_runs")
        .when(by_delta, "delta")
        .otherwise("value")
    )
    spread = F.when(by_delta, delta_range).otherwise(value_range)
    kept = F.when(by_delta, F.col("n_deltas")).otherwise(F.col("n_values")).isNotNull()
    plain = scheme.isin("delta", "value")
    return one.select(*keys, scheme.alias("scheme"), (plain & (spread + 1 <= MOST_VALUES) & kept).alias("huffman"))
