"""Column expressions over reads: tags, bases, qualities, and small scalar helpers. All run inside the JVM."""

from readloom.functions.bases import (
    ALPHABET,
    bases_to_colors,
    colors_to_bases,
    from_transferred,
    index_bases,
    is_color_space,
    kmers_with_next,
    symbol_index,
    to_transferred,
    unindex_bases,
)
from readloom.functions.qualities import (
    bin_quality,
    lossy_quality,
    lossy_sequence,
    phred,
    quality_changes,
    truncated_length,
)
from readloom.functions.scalars import bit_length, ends_with, int_log, is_number, to_number, to_text
from readloom.functions.tags import (
    join_tag,
    mask_tag,
    plus_line,
    split_comment,
    split_name,
    tag_fields,
    tag_separators,
    valid_record,
)

__all__ = [
    "ALPHABET", "bases_to_colors", "bin_quality", "bit_length", "colors_to_bases", "ends_with", "from_transferred", "index_bases",
    "int_log", "is_color_space", "is_number", "join_tag", "kmers_with_next", "lossy_quality", "lossy_sequence", "mask_tag", "phred",
    "plus_line", "quality_changes", "split_comment", "split_name", "symbol_index", "tag_fields", "tag_separators", "to_number",
    "to_text", "to_transferred", "truncated_length", "unindex_bases", "valid_record",
]
