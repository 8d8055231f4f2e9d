"""Errors that callers can tell apart."""


class ReadloomError(Exception):
    """Any error of this library."""


class FormatError(ReadloomError):
    """Bytes that are no valid FASTQ text or read archive."""


class OptionError(ReadloomError, ValueError):
    """An option outside its bounds."""
