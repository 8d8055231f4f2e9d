"""Settings of readers, writers and jobs, checked where they are made."""

from __future__ import annotations

from dataclasses import dataclass, field

from readloom.errors import OptionError

#: The bounds of each setting.
BUFFER_MB = (1, 1024)
DNA_LEVELS = (0, 3)
QUALITY_LEVELS = (0, 2)
PHRED_OFFSETS = (33, 59, 64)
#: Field numbers are bits of a signed number of 64 bits, of which the lowest stands for none.
LAST_FIELD = 62


def within(name: str, value: int, low: int, high: int) -> int:
    if not low <= int(value) <= high:
        raise OptionError(f"{name} must be {low} to {high}, not {value}")
    return int(value)


@dataclass(frozen=True)
class FieldMask:
    """The 1-based fields of a read's tag that are kept; empty: all."""

    fields: frozenset[int] = field(default_factory=frozenset)

    def add(self, number: int) -> FieldMask:
        return FieldMask(self.fields | {within("field", number, 1, LAST_FIELD)})

    @classmethod
    def of(cls, *numbers: int) -> FieldMask:
        mask = cls()
        for number in numbers:
            mask = mask.add(number)
        return mask

    @classmethod
    def from_bits(cls, bits: int) -> FieldMask:
        return cls(frozenset(i for i in range(1, LAST_FIELD + 1) if bits >> i & 1))

    def bits(self) -> int:
        return sum(1 << i for i in self.fields)


@dataclass(frozen=True)
class DatasetType:
    """What holds for all reads of a file. quality_offset 0: to be inferred."""

    quality_offset: int = 33
    plus_repetition: bool = False
    color_space: bool = False

    def __post_init__(self):
        if self.quality_offset not in (0, *PHRED_OFFSETS):
            raise OptionError(f"the quality offset must be one of {PHRED_OFFSETS}, or 0, not {self.quality_offset}")


@dataclass(frozen=True)
class Settings:
    """How reads are stored."""

    dna_level: int = 0
    quality_level: int = 0
    lossy: bool = False
    crc32: bool = False
    buffer_mb: int = 8
    threads: int = 1
    mask: FieldMask = FieldMask()

    def __post_init__(self):
        within("dna_level", self.dna_level, *DNA_LEVELS)
        within("quality_level", self.quality_level, *QUALITY_LEVELS)
        within("buffer_mb", self.buffer_mb, *BUFFER_MB)
        within("threads", self.threads, 1, 1 << 16)

    @property
    def dna_order(self) -> int:
        return 3 * self.dna_level

    @property
    def quality_order(self) -> int:
        return (3 if self.lossy else 1) * self.quality_level

    @property
    def checked_streams(self) -> tuple[str, ...]:
        """The streams whose checksum survives: a tag that is filtered or a quality that is binned doesn't come back."""
        return tuple(s for s, kept in (("tag", not self.mask.fields), ("sequence", True), ("quality", not self.lossy)) if kept)
