"""A read archive: Parquet with zstd, in blocks of consecutive reads, with a row about each block and one about the whole.

What holds for a whole file, the offset of its qualities, repeated tags in plus lines and colour space, is found on ingest unless
it is given; reads that disagree about it are an error.

Folder layout: `reads` (the rows, sorted by read_id), `blocks` (records, stream sizes and CRC-32 by block), `dataset` (one row of
settings). Columns are stored apart, so a query of one stream reads that stream alone, and read_id ranges prune row groups.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.errors import FormatError
from readloom.functions.qualities import lossy_quality, lossy_sequence
from readloom.functions.tags import join_tag, mask_tag, split_comment, split_name
from readloom.operators import bytescan as B
from readloom.operators.streams import dataset_type
from readloom.options import DatasetType, Settings
from readloom.sources.fastq import in_order, read_fastq, with_read_ids, write_fastq

READS_PER_BLOCK = 10_000
COLUMNS = ("read_id", "block_id", "name", "comment", "sequence", "quality")


def prepare(reads: DataFrame, dataset: DatasetType, settings: Settings) -> DataFrame:
    """The reads as they are stored: masked tags, binned qualities."""
    out = reads
    if settings.mask.fields:
        tag = mask_tag(join_tag(F.col("name"), F.col("comment")), settings.mask)
        out = out.withColumn("_tag", tag).withColumn("name", split_name(F.col("_tag"))).withColumn("comment", split_comment(F.col("_tag"))).drop("_tag")
    if settings.lossy:
        q = lossy_quality(F.col("sequence"), F.col("quality"), dataset.quality_offset)
        out = out.withColumn("quality", q).withColumn("sequence", lossy_sequence(F.col("sequence")))
    return out


CHECKED = ("tag", "sequence", "quality")


def _blocks(spark: SparkSession, path: str) -> DataFrame:
    """Of each block as it is stored: first_read, records, bytes_ and crc32_ of each stream, in one pass without a shuffle of reads.

    A file has its reads in order, so a stretch of one part of a file that belongs to a block is in order, too.
    """
    rows = spark.read.parquet(f"{path}/reads")
    place = F.concat_ws(":", F.input_file_name(), F.input_file_block_start().cast("string"))
    rows = rows.select("block_id", "read_id", place.alias("place"), join_tag(F.col("name"), F.col("comment")).alias("tag"), "sequence", "quality")
    return B.put_together(B.stretches(rows, list(CHECKED), "place"), list(CHECKED))


def inferred(raw: DataFrame) -> DatasetType:
    """What holds for all raw reads (sequence, plus, quality)."""
    found = dataset_type(raw).first()
    if not found["consistent"]:
        raise FormatError("reads disagree about colour space or about repeated tags in plus lines")
    if found["quality_offset"] is None:
        raise FormatError("no offset fits the qualities")
    return DatasetType(found["quality_offset"], found["plus_repetition"], found["color_space"])


def write_archive(reads: DataFrame, path: str, dataset: DatasetType = DatasetType(), settings: Settings = Settings(), mode: str = "errorifexists", reads_per_block: int = READS_PER_BLOCK) -> None:
    """reads: read_id, name, comment, sequence, quality. Reads with fewer or more qualities than bases are an error.

    A dataset with quality_offset 0 has the offset of the qualities inferred.
    """
    if not dataset.quality_offset:
        dataset = replace(dataset, quality_offset=inferred(reads.select("sequence", F.lit("+").alias("plus"), "quality")).quality_offset)
    rows = prepare(reads, dataset, settings).withColumn("block_id", F.floor(F.col("read_id") / reads_per_block).cast("bigint"))
    checked = F.when(F.length("sequence") != F.length("quality"), F.raise_error(F.concat(F.lit("not as many qualities as bases in read "), F.col("read_id").cast("string")))).otherwise(F.col("quality"))
    in_order(rows.withColumn("quality", checked).select(*COLUMNS)).write.mode(mode).option("compression", "zstd").parquet(f"{path}/reads")
    spark = reads.sparkSession
    sums = [f"crc32_{c}" for c in settings.checked_streams] if settings.crc32 else []
    _blocks(spark, path).select("block_id", "records", "first_read", *[F.col(f"bytes_{c}").alias(f"{c}_bytes") for c in CHECKED], *sums).write.mode(mode).parquet(f"{path}/blocks")
    row = (dataset.quality_offset, dataset.plus_repetition, dataset.color_space, settings.lossy, settings.crc32, settings.mask.bits())
    spark.createDataFrame([row], "quality_offset int, plus_repetition boolean, color_space boolean, lossy boolean, crc32 boolean, tag_mask long").coalesce(1).write.mode(mode).parquet(f"{path}/dataset")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """The rows, with read_id for their order."""
    return spark.read.parquet(f"{path}/reads").select(*COLUMNS)


def archive_info(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(dataset, blocks)."""
    return spark.read.parquet(f"{path}/dataset"), spark.read.parquet(f"{path}/blocks")


def damaged_blocks(spark: SparkSession, path: str) -> DataFrame:
    """The blocks whose stored checksums don't hold. Without checksums there are none to hold."""
    _, blocks = archive_info(spark, path)
    streams = [c.removeprefix("crc32_") for c in blocks.columns if c.startswith("crc32_")]
    if not streams:
        return blocks.select("block_id").where("false")
    now = _blocks(spark, path)
    now = now.select("block_id", *[F.col(f"crc32_{s}").alias(f"now_{s}") for s in streams])
    same = F.lit(True)
    for s in streams:
        same = same & F.col(f"crc32_{s}").eqNullSafe(F.col(f"now_{s}"))
    return blocks.join(now, "block_id", "full").where(~same).select("block_id")


def verify_archive(spark: SparkSession, path: str) -> None:
    bad = [r["block_id"] for r in damaged_blocks(spark, path).orderBy("block_id").limit(10).collect()]
    if bad:
        raise FormatError(f"{path}: checksums don't hold in blocks {bad}")


def fastq_to_archive(spark: SparkSession, source: str, target: str, settings: Settings = Settings(), dataset: DatasetType | None = None, mode: str = "errorifexists") -> None:
    """dataset: None finds out from all reads what holds for them."""
    raw = read_fastq(spark, source, "FAILFAST")
    write_archive(with_read_ids(raw), target, dataset or inferred(raw), settings, mode)


def archive_to_fastq(spark: SparkSession, source: str, target: str, mode: str = "errorifexists") -> None:
    repeated = archive_info(spark, source)[0].first()["plus_repetition"]
    write_fastq(read_archive(spark, source), target, mode, bool(repeated))
