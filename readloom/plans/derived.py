"""Reads, bases, tags and runs derived from general tables, so every operator has an input that SQL can rebuild."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.functions.bases import chars

#: Fixed values of the derivation: a character's code point picks a base and a quality.
BASES, QUALITIES, OFFSET, READS_PER_BLOCK, TAGS_PER_BLOCK = "ACGTACGTACGTACGTN", 41, 33, 100, 1000
#: Texts of characters below this are spelled by one translation.
SETTLED = 0x250


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that aren't empty. A table of fewer files than cores is dealt out, as a file may be a single row group."""
    docs = table(spark, sf_dir, "documents").where(F.length("text") > 0)
    return docs.repartition("doc_id") if len(docs.inputFiles()) < spark.sparkContext.defaultParallelism else docs


def block_of(read_id: Column, size: int) -> Column:
    return F.floor(read_id / size).cast("bigint")


def spelled(text: Column, letters: str) -> Column:
    """text with each character as the letter that its code point picks."""
    settled = "".join(map(chr, range(1, SETTLED)))
    slow = F.array_join(F.transform(chars(text), lambda c: F.get(F.array(*[F.lit(x) for x in letters]), F.ascii(c) % len(letters))), "")
    quick = F.translate(text, settled, "".join(letters[ord(c) % len(letters)] for c in settled))
    return F.when(text.rlike(f"[\\x{{{SETTLED:x}}}-\\x{{10FFFF}}\\x00]"), slow).otherwise(quick)


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """read_id, block_id, name, comment, sequence, quality: one read for each document that isn't empty."""
    docs = documents(spark, sf_dir)
    return docs.select(
        F.col("doc_id").alias("read_id"),
        block_of(F.col("doc_id"), READS_PER_BLOCK).alias("block_id"),
        F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("name"),
        F.concat_ws(" ", "source", "lang").alias("comment"),
        spelled(F.col("text"), BASES).alias("sequence"),
        spelled(F.col("text"), "".join(chr(OFFSET + q) for q in range(QUALITIES))).alias("quality"),
    )


def bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """read_id, block_id, pos, base, q: one row for each character of each document, straight from the text."""
    docs = documents(spark, sf_dir)
    one = docs.select(F.col("doc_id").alias("read_id"), block_of(F.col("doc_id"), READS_PER_BLOCK).alias("block_id"), F.posexplode(chars(F.col("text"))).alias("pos", "c"))
    code = F.ascii("c")
    letters = F.array(*[F.lit(b) for b in BASES])
    return one.select("read_id", "block_id", "pos", F.get(letters, code % len(BASES)).alias("base"), (code % QUALITIES).alias("q"))


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """read_id, block_id, tag: from orders, in the order of their keys."""
    orders = table(spark, sf_dir, "orders")
    tag = F.concat(F.lit("@O"), "o_orderstatus", F.lit("."), F.col("o_orderkey").cast("string"), F.lit(":"), F.col("o_custkey").cast("string"), F.lit(" P"), F.substring("o_orderpriority", 1, 1))
    return orders.select(F.col("o_orderkey").alias("read_id"), block_of(F.col("o_orderkey"), TAGS_PER_BLOCK).alias("block_id"), tag.alias("tag"))
