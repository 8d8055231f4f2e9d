"""A read's tag: '@name comment', made of fields between separators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from readloom.options import FieldMask

#: The characters between the fields of a tag.
SEPARATORS = " ._,=:/-#"
_CLASS = r"[ ._,=:/\-#]"
_OTHER = r"[^ ._,=:/\-#]"


def _without_at(tag: Column) -> Column:
    return F.when(tag.startswith("@"), F.substring(tag, 2, 2147483647)).otherwise(tag)


def split_name(tag: Column) -> Column:
    """What stands before the first space, without one leading '@'."""
    return F.substring_index(_without_at(tag), " ", 1)


def split_comment(tag: Column) -> Column:
    """What follows the first space; empty if there is none."""
    body = _without_at(tag)
    at = F.instr(body, " ")
    return F.when(at > 0, F.substr(body, at + 1)).otherwise(F.lit(""))


def join_tag(name: Column, comment: Column) -> Column:
    return F.when(F.length(comment) > 0, F.concat(F.lit("@"), name, F.lit(" "), comment)).otherwise(F.concat(F.lit("@"), name))


def tag_fields(tag: Column) -> Column:
    """The fields, in order; two separators in a row have an empty field between them."""
    return F.split(tag, _CLASS, -1)


def tag_separators(tag: Column) -> Column:
    """The separators, in order: one fewer than the fields."""
    return F.regexp_extract_all(tag, F.lit(f"({_CLASS})"), 1)


def mask_tag(tag: Column, mask: FieldMask) -> Column:
    """The kept fields, each with the separator after it; the '@' always stays. An empty mask keeps all."""
    if not mask.fields:
        return tag
    # A field and its separator as one piece; the last field has none.
    pieces = F.regexp_extract_all(tag, F.lit(f"({_OTHER}*{_CLASS}|{_OTHER}+$)"), 1)
    numbers = F.array(*[F.lit(i) for i in sorted(mask.fields)])
    kept = F.array_join(F.filter(pieces, lambda _, i: F.array_contains(numbers, i + 1)), "")
    return F.when(tag.startswith("@") & ~kept.startswith("@"), F.concat(F.lit("@"), kept)).otherwise(kept)


def plus_line(tag: Column, repeat: bool | Column) -> Column:
    """'+', or with repetition '+' and the tag without its '@'."""
    whole = F.concat(F.lit("+"), _without_at(tag))
    return F.when(repeat, whole).otherwise(F.lit("+")) if isinstance(repeat, Column) else whole if repeat else F.lit("+")


def valid_record(tag: Column, sequence: Column, plus: Column, quality: Column) -> Column:
    """A tag that begins with '@', a plus line that isn't empty, and as many qualities as bases. Null counts as not valid."""
    ok = tag.startswith("@") & (F.length(plus) > 0) & (F.length(sequence) == F.length(quality))
    return F.coalesce(ok, F.lit(False))
