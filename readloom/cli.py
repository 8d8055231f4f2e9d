"""`python -m readloom.cli fastq2archive|archive2fastq [-t N] IN [OUT]`: one input to one output, refusing one that exists."""

from __future__ import annotations

import argparse
import os
import shutil
import sys
import tempfile

from pyspark.sql import SparkSession

from readloom.options import Settings
from readloom.sources.archive import archive_info, fastq_to_archive, read_archive
from readloom.sources.fastq import fastq_text


def session(threads: int) -> SparkSession:
    return SparkSession.builder.master(f"local[{threads or '*'}]").config("spark.ui.enabled", "false").getOrCreate()


def to_archive(spark: SparkSession, source: str, target: str) -> None:
    """source '-': standard input, plain or gzip, copied to a local file first."""
    if os.path.exists(target):
        raise FileExistsError(target)
    if source != "-":
        if not os.path.exists(source):
            raise FileNotFoundError(source)
        fastq_to_archive(spark, source, target)
        return
    with tempfile.NamedTemporaryFile(suffix=".fastq") as held:
        shutil.copyfileobj(sys.stdin.buffer, held)
        held.flush()
        fastq_to_archive(spark, held.name, target)


def to_fastq(spark: SparkSession, source: str, target: str | None) -> None:
    """One FASTQ file, or standard output. Rows are fetched a partition at a time."""
    if target and os.path.exists(target):
        raise FileExistsError(target)
    repeated = bool(archive_info(spark, source)[0].first()["plus_repetition"])
    out = open(target, "w", encoding="latin-1", newline="\n") if target else sys.stdout
    try:
        for row in fastq_text(read_archive(spark, source), repeated).toLocalIterator(prefetchPartitions=True):
            out.write(row["value"] + "\n")
    finally:
        if target:
            out.close()


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="readloom", description=__doc__)
    parser.add_argument("command", choices=("fastq2archive", "archive2fastq"))
    parser.add_argument("-t", "--threads", type=int, default=0, help="worker threads; 0: all cores")
    parser.add_argument("source")
    parser.add_argument("target", nargs="?")
    given = parser.parse_args(args)
    if given.threads:
        Settings(threads=given.threads)
    if given.command == "fastq2archive" and not given.target:
        parser.error("an output is needed")
    spark = session(given.threads)
    try:
        to_archive(spark, given.source, given.target) if given.command == "fastq2archive" else to_fastq(spark, given.source, given.target)
    except (FileExistsError, FileNotFoundError) as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
