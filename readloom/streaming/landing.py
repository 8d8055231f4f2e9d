"""A folder in which whole FASTQ files land, read as a stream of reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from readloom.functions.tags import split_comment, split_name, valid_record
from readloom.operators.bytescan import position_counts

#: Spark's text source gives a file's lines without their order, so a file is read as one value and split into records.
#: A file that lands has at most 2 GB; larger ones are for the `fastq` source, which splits them.
RECORD = r"(?m)^(@[^\n]+\n[^\n]*\n\+[^\n]*\n[^\n]*)(?:\n|\z)"


def landed_reads(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """file, local_id, name, comment, sequence, quality of each valid record of each file that lands. Gzip goes by its suffix."""
    files = spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", files_per_trigger).load(folder)
    text = F.regexp_replace("value", "\r\n?", "\n")
    one = files.select(F.col("_metadata.file_name").alias("file"), F.posexplode(F.regexp_extract_all(text, F.lit(RECORD), 1)).alias("local_id", "record"))
    part = F.split("record", "\n", 4)
    rows = one.select("file", "local_id", *[F.get(part, i).alias(c) for i, c in enumerate(("tag", "sequence", "plus", "quality"))])
    good = rows.where(valid_record(F.col("tag"), F.col("sequence"), F.col("plus"), F.col("quality")))
    return good.select("file", "local_id", split_name(F.col("tag")).alias("name"), split_comment(F.col("tag")).alias("comment"), "sequence", "quality")


def quality_profile(reads: DataFrame, offset: int = 33) -> DataFrame:
    """A running histogram of qualities by position, for output mode complete or update."""
    return position_counts(reads, offset)


def to_archive_stream(reads: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends the reads to Parquet with zstd, exactly once, and stops when all that is there has been read."""
    return reads.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).option("compression", "zstd").trigger(availableNow=True).start()
