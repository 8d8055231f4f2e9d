"""Reads that keep arriving: FASTQ files landing in a folder, as a stream."""

from readloom.streaming.landing import landed_reads, quality_profile, to_archive_stream

__all__ = ["landed_reads", "quality_profile", "to_archive_stream"]
