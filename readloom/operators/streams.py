"""Profiles of sequence and quality streams. Inputs are reads or bases frames; groups are blocks unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from readloom.functions.bases import ALPHABET, chars
from readloom.functions.qualities import quality_changes
from readloom.operators import bytescan as B

#: The ratios above which an encoding of qualities pays, and sizes of quality models.
RLE_RATIO, TRUNCATED_RATIO, ORDER_RLE_RATIO = 1.25, 1.10, 1.175
QUALITY_MODELS = (16, 32, 64, 128)


def infer_offset(low: Column, high: Column) -> Column:
    """The Phred offset of qualities between these bytes; null if none fits."""
    return (
        F.when((high <= 74) & (low >= 33), 33)
        .when((high <= 105) & (low >= 64), 64)
        .when((high <= 105) & (low >= 59), 59)
        .when((high <= 105) & (low >= 33), 33)
    )


def phred_offset(reads: DataFrame) -> DataFrame:
    return B.byte_range(reads).withColumn("quality_offset", infer_offset(F.col("low"), F.col("high")))


def dataset_type(raw: DataFrame) -> DataFrame:
    """One row: what holds for all raw reads (sequence, plus, quality). consistent is false where reads disagree.

    The offset is null if none fits, and 33 where there are no qualities; an empty set is consistent.
    """
    one = B.profile(raw).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("records", "color", "digit", "repeated")], F.min("low").alias("low"), F.max("high").alias("high"))
    n, any_color, any_plus = F.col("records"), F.col("color") > 0, F.col("repeated") > 0
    same = ((F.col("color") == n) | ~any_color) & ((F.col("repeated") == n) | ~any_plus) & (F.col("digit") == 0)
    offset = F.when(F.col("low").isNull(), 33).otherwise(infer_offset(F.col("low"), F.col("high")))
    return one.select(n, offset.alias("quality_offset"), any_plus.alias("plus_repetition"), any_color.alias("color_space"), same.alias("consistent"))


def dna_histogram(reads: DataFrame, offset: int = 33) -> DataFrame:
    """block_id, base, n: of the bases that stay in the sequence once ambiguity codes have moved into the qualities."""
    return B.kept_base_counts(reads, offset)


def quality_histogram(reads: DataFrame, offset: int = 33) -> DataFrame:
    return B.quality_counts(reads, offset)


def symbol_ranks(histogram: DataFrame, symbol: str, order: Column | None = None) -> DataFrame:
    """The dense rank, from 0, of each symbol present in its block, and how many there are."""
    by = W.Window.partitionBy("block_id")
    rank = F.row_number().over(by.orderBy(order if order is not None else F.col(symbol))) - 1
    return histogram.select("block_id", symbol, "n", rank.alias("symbol_rank"), F.count("*").over(by).alias("n_symbols"))


def base_order() -> Column:
    return F.instr(F.lit(ALPHABET), F.col("base"))


def quality_by_position(reads: DataFrame, offset: int = 33) -> DataFrame:
    return B.position_counts(reads, offset)


def quality_by_position_truncated(reads: DataFrame, offset: int = 33) -> DataFrame:
    """Only the symbols before the low ones at each read's end."""
    return B.position_counts(reads, offset, truncated=True)


def length_stats(reads: DataFrame) -> DataFrame:
    """Per block: records, shortest and longest quality, their sum, the sum of truncated lengths and of symbol changes.

    A truncated length counts here up to the last symbol that isn't low, from 0; a read that ends in the low symbol takes one
    change back, as its last run is implied, once the block has any.
    """
    n = F.length("quality")
    th = F.greatest(F.length(F.rtrim("quality", F.lit("#"))) - 1, F.lit(0))
    changes = quality_changes(F.col("quality")) - F.col("quality").endswith("#").cast("int")
    one = reads.select("block_id", n.alias("n"), th.alias("th"), changes.alias("c"), F.substring("sequence", 1, 1).alias("first"))
    return one.groupBy("block_id").agg(
        F.count("*").alias("records"), F.min("n").alias("min_length"), F.max("n").alias("max_length"), F.sum("n").alias("raw_length"),
        F.sum("th").alias("truncated_length"), F.sum("c").alias("rle_length"), (F.min("n") != F.max("n")).alias("variable_length"),
        (F.min("first") == F.max("first")).alias("constant_first"),
    )


def dna_scheme(histogram: DataFrame, order: int = 0) -> DataFrame:
    """block_id, n_symbols, dna_scheme: how a block's bases would be stored."""
    n = F.col("n_symbols")
    small, large = ("two_bits", "huffman") if order == 0 else ("order_4", "order_8")
    return histogram.groupBy("block_id").agg(F.count("*").alias("n_symbols")).withColumn("dna_scheme", F.when(n == 0, "none").when(n <= 4, small).otherwise(large))


def quality_scheme(stats: DataFrame) -> DataFrame:
    """block_id, quality_scheme at order 0, from length_stats(). Ratios are compared as 32-bit floats."""
    ratio = lambda a, b: F.col(a).cast("float") / F.when(F.col(b) > 0, F.col(b)).cast("float")
    rle = F.coalesce(ratio("truncated_length", "rle_length").cast("float") > F.lit(RLE_RATIO).cast("float"), F.lit(False))
    cut = F.coalesce(ratio("raw_length", "truncated_length").cast("float") > F.lit(TRUNCATED_RATIO).cast("float"), F.lit(False))
    return stats.select("block_id", F.when(rle, "rle").when(cut, "truncated").otherwise("plain").alias("quality_scheme"))


def quality_order_model(stats: DataFrame, symbols: DataFrame, order: int) -> DataFrame:
    """block_id, model_symbols, rle_bonus at order 1 or more without loss, from length_stats() and quality_histogram()."""
    n = symbols.groupBy("block_id").agg(F.count("*").alias("n_symbols"))
    size = F.lit(QUALITY_MODELS[-1])
    for m in QUALITY_MODELS[-2::-1]:
        size = F.when(F.col("n_symbols") <= m, m).otherwise(size)
    ratio = F.col("raw_length").cast("float") / F.col("rle_length").cast("float")
    bonus = F.lit(order == 2) & (F.col("min_length") == F.col("max_length")) & F.coalesce(ratio.cast("float") > F.lit(ORDER_RLE_RATIO).cast("float"), F.lit(False))
    return stats.join(n, "block_id").select("block_id", size.alias("model_symbols"), bonus.alias("rle_bonus"))


def kmer_context_counts(reads: DataFrame, k: int = 3) -> DataFrame:
    """context, next, n: how often each symbol follows each k symbols within a read."""
    return B.context_counts(reads, "sequence", k).select(F.substring("gram", 1, k).alias("context"), F.substring("gram", k + 1, 1).alias("next"), "n")


def quality_context_counts(reads: DataFrame, k: int = 1, buckets: int = 8) -> DataFrame:
    """context, bucket, symbol, n: how often a quality follows k others, by the part of the read it stands in."""
    return B.context_counts(reads, "quality", k, buckets).select(F.substring("gram", 1, k).alias("context"), "bucket", F.substring("gram", k + 1, 1).alias("symbol"), "n")


def base_model_counts(reads: DataFrame, k: int = 3) -> DataFrame:
    """context, symbol, n: as base coders see it, contexts go on from read to read within a block. Symbols are bytes of the bases."""
    return B.model_counts(reads, "sequence", 0, k, 1, False).drop("bucket")


def quality_model_counts(reads: DataFrame, offset: int = 33, k: int = 3, buckets: int = 8) -> DataFrame:
    """context, bucket, symbol, n: as quality coders see it, with means from the middle of the context on."""
    return B.model_counts(reads, "quality", offset, k, buckets, True)


def stream_sizes(reads: DataFrame) -> DataFrame:
    """Bytes of the three streams by block and, with a null block, in all."""
    tag = F.length(F.concat(F.lit("@"), "name")) + F.when(F.length("comment") > 0, F.length("comment") + 1).otherwise(0)
    one = reads.select("block_id", tag.alias("t"), F.length("sequence").alias("s"), F.length("quality").alias("q"))
    return one.rollup("block_id").agg(F.sum("t").alias("tag"), F.sum("s").alias("dna"), F.sum("q").alias("quality"))


def stream_crc32(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Per block the CRC-32 of each column's texts put together in the order of read_id."""
    dealt = rows.select("block_id", "read_id", *columns).repartition("block_id").sortWithinPartitions("block_id", "read_id")
    found = B.put_together(B.stretches(dealt.withColumn("place", F.lit("")), columns, "place"), columns)
    return found.select("block_id", *[f"crc32_{c}" for c in columns])
