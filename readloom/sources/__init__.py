"""FASTQ text and read archives as DataFrames."""

from readloom.sources.archive import archive_to_fastq, fastq_to_archive, read_archive, verify_archive, write_archive
from readloom.sources.fastq import FastqSource, read_fastq, with_read_ids, write_fastq

__all__ = ["FastqSource", "archive_to_fastq", "fastq_to_archive", "read_archive", "read_fastq", "verify_archive", "with_read_ids", "write_archive", "write_fastq"]
