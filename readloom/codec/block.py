"""One block of reads: meta, tag, quality and DNA streams.

Tags are stored by fields if all have the same separators, else as raw Huffman codes. At order 0 qualities are stored by
position, truncated or in runs, whichever the block's statistics choose, and bases in two bits or Huffman codes; above it both
are range-coded by contexts. Lossy blocks hold bins of qualities, colour-space blocks their bases, with a first base and quality
that all reads share stored once. Checksums are of the texts as they were; they are verified when a block is read.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

from readloom.codec import models, tagfields
from readloom.codec.bits import BitReader, BitWriter
from readloom.codec.trees import Tree, load_presence, store_presence
from readloom.errors import FormatError
from readloom.functions.bases import ALPHABET, TRANSFER_BASE, TRANSFER_BELOW, TRANSFER_STEP, TWO_BITS
from readloom.functions.qualities import BIN_VALUES, LARGEST_PHRED, bin_of
from readloom.operators.streams import RLE_RATIO, TRUNCATED_RATIO

#: Flags of a block, sizes of symbol sets, scheme numbers, the longest run, the low symbol, the index of N.
CONSTANT_PRIMER, VARIABLE_LENGTH, MIXED_TAGS = 1, 2, 4
TAG_SYMBOLS, QUALITY_SYMBOLS, DNA_SYMBOLS = 128, 256, 20
PLAIN, TRUNCATED, RUNS = 0, 1, 2
TWO_BIT_BASES, HUFFMAN, NO_DNA = 0, 1, 255
LONGEST_RUN, LOW, UNKNOWN = 255, 2, 4

INDEX = {c: i for i, c in enumerate(ALPHABET)}
Record = tuple[bytes, str, str]  # tag with its '@', sequence, quality


@dataclass
class Shape:
    """What holds for the whole file."""

    offset: int = 33
    lossy: bool = False
    crc32: bool = False
    dna_order: int = 0
    quality_order: int = 0
    mask: int = 0
    color_space: bool = False
    plus_repetition: bool = False


def colors(bases: str) -> str:
    """The first base and the colour of each step from a known base to the next; '.' for a base that isn't known."""
    out, now = [bases[:1]], max(TWO_BITS.find(bases[:1]), 0)
    for b in bases[1:]:
        at = TWO_BITS.find(b)
        out.append("." if at < 0 else str(now ^ at))
        now = now if at < 0 else at
    return "".join(out)


def bases_of(text: str) -> str:
    """The inverse of colors()."""
    out, now = [text[:1]], max(TWO_BITS.find(text[:1]), 0)
    for c in text[1:]:
        if c not in "0123.":
            raise FormatError(f"no colour {c!r}")
        now = now if c == "." else now ^ int(c)
        out.append("N" if c == "." else TWO_BITS[now])
    return "".join(out)


def _split(sequence: str, quality: str, shape: Shape) -> tuple[list[int], list[int]]:
    """(quality symbols, base indexes). Without loss, ambiguity codes of low quality stand in the qualities alone. With loss the
    symbols are bins, and a base that isn't A, C, G or T is bin 0 alone, which no other base has."""
    symbols, bases = [], []
    for b, c in zip(sequence, quality):
        i, q = INDEX.get(b), ord(c) - shape.offset
        if i is None or not 0 <= q < TRANSFER_BASE:
            raise FormatError(f"no base {b!r} or no quality {c!r} at offset {shape.offset}")
        if shape.lossy:
            bin_number = max(bin_of(min(q, LARGEST_PHRED)), 1) if i < UNKNOWN else 0
            symbols.append(bin_number)
            if bin_number:
                bases.append(i)
        elif i >= UNKNOWN and q < TRANSFER_BELOW:
            symbols.append(TRANSFER_BASE + TRANSFER_STEP * (i - UNKNOWN) + q)
        else:
            symbols.append(q)
            bases.append(i)
    return symbols, bases


def _alone(symbol: int, shape: Shape) -> bool:
    """Whether a quality symbol stands for its base, too."""
    return symbol == 0 if shape.lossy else symbol >= TRANSFER_BASE


def _joined(symbols: list[int], bases: list[int], shape: Shape) -> tuple[str, str]:
    rest = iter(bases)
    sequence, quality = [], []
    for s in symbols:
        if shape.lossy:
            index, q = (UNKNOWN if s == 0 else next(rest)), BIN_VALUES[s]
        elif s >= TRANSFER_BASE:
            index, q = (s - TRANSFER_BASE) // TRANSFER_STEP + UNKNOWN, s % TRANSFER_STEP
        else:
            index, q = next(rest), s
        sequence.append(ALPHABET[index])
        quality.append(chr(shape.offset + q))
    return "".join(sequence), "".join(quality)


def _runs(symbols: list[list[int]]) -> list[tuple[int, int]]:
    """(symbol, length - 1) over all reads put together."""
    out: list[list[int]] = []
    for s in (s for row in symbols for s in row):
        if out and out[-1][0] == s and out[-1][1] + 1 < LONGEST_RUN:
            out[-1][1] += 1
        else:
            out.append([s, 0])
    return [(s, n) for s, n in out]


def _cut(row: list[int]) -> int:
    """The length without low symbols at the end; 1 at least."""
    n = len(row)
    while n > 1 and row[n - 1] == LOW:
        n -= 1
    return n


def _changes(symbols: list[list[int]]) -> int:
    return sum(1 + sum(a != b for a, b in zip(row, row[1:])) - (row[-1] == LOW) for row in symbols if row)


def _quality_scheme(symbols: list[list[int]], shape: Shape) -> int:
    raw = sum(map(len, symbols))
    th = sum(max(0, _cut(row) - 1) for row in symbols)
    changes = _changes(symbols)
    if changes > 0 and th / changes > RLE_RATIO:
        return RUNS
    # Readers differ in what they put back for a cut bin, so bins are never cut.
    return TRUNCATED if th > 0 and raw / th > TRUNCATED_RATIO and not shape.lossy else PLAIN


def _checksums(records: list[Record], shape: Shape) -> list[int]:
    """Of the streams that come back as they were."""
    kept = ([0] if not shape.mask else []) + [1] + ([2] if not shape.lossy else [])
    out = []
    for k in kept:
        crc = 0
        for r in records:
            crc = zlib.crc32(r[k] if k == 0 else r[k].encode("latin-1"), crc)
        out.append(crc)
    return out


def encode_streams(records: list[Record], shape: Shape, scheme: int | None = None) -> tuple[bytes, dict[str, int]]:
    """(the block, the bytes of its streams meta, tag, quality and dna)."""
    if not records or any(len(s) != len(q) or not q for _, s, q in records):
        raise FormatError("a block needs reads, each with as many qualities as bases and at least one")
    out, ends = BitWriter(), [0]

    def stream_ends() -> None:
        out.align()
        ends.append(len(out.done))

    rows = [(bases_of(s) if shape.color_space else s, q) for _, s, q in records]
    first = {(s[0], q[0]) for s, q in rows} if shape.color_space and min(len(q) for _, q in rows) > 1 else set()
    primer = first.pop() if len(first) == 1 else None
    primer = primer if primer and primer[0] in TWO_BITS else None
    parts = [_split(s[bool(primer) :], q[bool(primer) :], shape) for s, q in rows]
    symbols, bases = [p[0] for p in parts], [p[1] for p in parts]
    lengths = [len(row) for row in symbols]
    low, high = min(lengths), max(lengths)
    tokens = tagfields.split([t for t, _, _ in records])
    out.number(len(records))
    out.number(high)
    out.number(CONSTANT_PRIMER * (primer is not None) | VARIABLE_LENGTH * (low != high) | MIXED_TAGS * (tokens is None))
    repeated = sum(len(t) - 1 for t, _, _ in records) if shape.plus_repetition else 0
    out.number(sum(len(t) + len(s) + len(q) + 5 for t, s, q in records) + repeated - 1)
    if low != high:
        out.number(low)
    if primer:
        (head,), _ = _split(*primer, shape)
        out.number(INDEX[primer[0]], 1)
        out.number(head, 1)
    if shape.crc32:
        for crc in _checksums(records, shape):
            out.number(crc)
    stream_ends()
    if tokens is None:
        _store_tags(out, [t for t, _, _ in records], lengths, low, high)
    else:
        _store_fields(out, tokens, lengths, low, high)
    stream_ends()
    _store_qualities(out, symbols, low, high, shape, scheme)
    stream_ends()
    _store_bases(out, bases, shape.dna_order)
    stream_ends()
    return out.bytes(), dict(zip(("meta", "tag", "quality", "dna"), (b - a for a, b in zip(ends, ends[1:]))))


def encode_block(records: list[Record], shape: Shape, scheme: int | None = None) -> bytes:
    return encode_streams(records, shape, scheme)[0]


def _store_qualities(out: BitWriter, symbols: list[list[int]], low: int, high: int, shape: Shape, scheme: int | None) -> None:
    if shape.quality_order and shape.lossy:
        models.store_bins(out, symbols, shape.quality_order)
        return
    if shape.quality_order:
        present = sorted({s for row in symbols for s in row})
        scheme = models.quality_scheme(present, shape.quality_order, [len(row) for row in symbols], _changes(symbols)) if scheme is None else scheme
        out.number(scheme, 1)
        models.store_qualities(out, symbols, scheme, shape.quality_order)
        return
    scheme = _quality_scheme(symbols, shape) if scheme is None else scheme
    out.number(scheme, 1)
    (_store_runs if scheme == RUNS else _store_positions)(out, symbols, low, high, *([scheme] if scheme != RUNS else []))


def _load_qualities(source: BitReader, lengths: list[int], shape: Shape) -> list[list[int]]:
    if shape.quality_order and shape.lossy:
        return models.load_bins(source, lengths, shape.quality_order)
    scheme = source.number(1)
    if shape.quality_order:
        return models.load_qualities(source, lengths, scheme, shape.quality_order)
    if scheme not in (PLAIN, TRUNCATED, RUNS):
        raise FormatError(f"no quality scheme {scheme}")
    return _load_runs(source, lengths) if scheme == RUNS else _load_positions(source, lengths, scheme)


def _store_fields(out: BitWriter, tokens: list[list[bytes]], lengths: list[int], low: int, high: int) -> None:
    fields = [tagfields.Field(list(column)) for column in zip(*(t[0::2] for t in tokens))]
    out.number(len(fields), 1)
    separators = [s[0] for s in tokens[0][1::2]] + [tagfields.NO_SEPARATOR]
    for f, separator in zip(fields, separators):
        f.store(out, separator)
    wide = (high - low).bit_length()
    for i, (t, n) in enumerate(zip(tokens, lengths)):
        for f, token in zip(fields, t[0::2]):
            f.store_token(out, token, i)
        out.bits(n - low, wide)
    out.align()


def _load_fields(source: BitReader, n: int, low: int, high: int) -> tuple[list[bytes], list[int]]:
    fields = [tagfields.StoredField(source) for _ in range(source.number(1))]
    if not fields:
        raise FormatError("tags without fields")
    wide = (high - low).bit_length()
    tags, lengths = [], []
    for i in range(n):
        parts = [f.token(source, i) + bytes([f.separator]) for f in fields]
        tags.append(b"".join(parts)[:-1])
        lengths.append(low + source.bits(wide))
    source.align()
    return tags, lengths


def _store_tags(out: BitWriter, tags: list[bytes], lengths: list[int], low: int, high: int) -> None:
    if any(c >= TAG_SYMBOLS for t in tags for c in t):
        raise FormatError("a tag has a byte beyond ASCII")
    short, long = min(map(len, tags)), max(map(len, tags))
    out.number(short)
    out.number(long)
    counts = [0] * TAG_SYMBOLS
    for t in tags:
        for c in t:
            counts[c] += 1
    present = [c for c, n in enumerate(counts) if n]
    store_presence(out, present, TAG_SYMBOLS)
    out.align()
    tree, number = Tree.of([counts[c] for c in present]), {c: i for i, c in enumerate(present)}
    tree.store(out)
    width, wide = (long - short).bit_length(), (high - low).bit_length()
    for t, n in zip(tags, lengths):
        out.bits(len(t) - short, width)
        for c in t:
            out.code(tree.codes[number[c]])
        out.bits(n - low, wide)
    out.align()


def _load_tags(source: BitReader, n: int, low: int, high: int) -> tuple[list[bytes], list[int]]:
    short, long = source.number(), source.number()
    present = load_presence(source, TAG_SYMBOLS)
    tree = Tree.load(source)
    width, wide = (long - short).bit_length(), (high - low).bit_length()
    tags, lengths = [], []
    for _ in range(n):
        size = short + source.bits(width)
        tags.append(bytes(present[source.symbol(tree.symbols, tree.shortest)] for _ in range(size)))
        lengths.append(low + source.bits(wide))
    source.align()
    return tags, lengths


def _store_positions(out: BitWriter, symbols: list[list[int]], low: int, high: int, scheme: int) -> None:
    present = sorted({s for row in symbols for s in row})
    number = {s: i for i, s in enumerate(present)}
    kept = [row[: _cut(row)] if scheme == TRUNCATED else row for row in symbols]
    counts = [[0] * len(present) for _ in range(high)]
    for row in kept:
        for j, s in enumerate(row):
            counts[j][number[s]] += 1
    trees = [Tree.of(c) for c in counts]
    out.number(high)
    store_presence(out, present, QUALITY_SYMBOLS)
    for tree in trees:
        tree.store(out)
    if scheme == TRUNCATED:
        out.bits(low != high, 1)
    for row, part in zip(symbols, kept):
        if scheme == TRUNCATED:
            out.bits(len(row) != len(part), 1)
            if len(row) != len(part):
                out.bits(len(part), (len(row) if low != high else high).bit_length())
        for j, s in enumerate(part):
            out.code(trees[j].codes[number[s]])
    out.align()


def _load_positions(source: BitReader, lengths: list[int], scheme: int) -> list[list[int]]:
    high = source.number()
    present = load_presence(source, QUALITY_SYMBOLS)
    trees = [Tree.load(source) for _ in range(high)]
    variable = scheme == TRUNCATED and source.bits(1)
    out = []
    for n in lengths:
        kept = source.bits((n if variable else high).bit_length()) if scheme == TRUNCATED and source.bits(1) else n
        out.append([present[source.symbol(trees[j].symbols, trees[j].shortest)] for j in range(kept)] + [LOW] * (n - kept))
    source.align()
    return out


def _store_runs(out: BitWriter, symbols: list[list[int]], low: int, high: int) -> None:
    runs = _runs(symbols)
    values, sizes = sorted({s for s, _ in runs}), sorted({n for _, n in runs})
    value, size = {s: i for i, s in enumerate(values)}, {n: i for i, n in enumerate(sizes)}
    out.number(len(runs))
    store_presence(out, values, QUALITY_SYMBOLS)
    store_presence(out, sizes, QUALITY_SYMBOLS)
    out.align()
    if len(values) == 1:  # all runs are of the first one's length but the last
        if len(sizes) > 1:
            out.number(size[runs[0][1]], 1)
        return
    after = [[0] * len(values) for _ in values]
    length = [[0] * len(sizes) for _ in values]
    before = 0
    for s, n in runs:
        after[before][value[s]] += 1
        length[value[s]][size[n]] += 1
        before = value[s]
    next_trees, size_trees = [Tree.of(c) for c in after], [Tree.of(c) for c in length]
    for a, b in zip(next_trees, size_trees):
        a.store(out)
        b.store(out)
    before = 0
    for s, n in runs:
        out.code(next_trees[before].codes[value[s]])
        before = value[s]
        out.code(size_trees[before].codes[size[n]])
    out.align()


def _load_runs(source: BitReader, lengths: list[int]) -> list[list[int]]:
    n_runs = source.number()
    values, sizes = load_presence(source, QUALITY_SYMBOLS), load_presence(source, QUALITY_SYMBOLS)
    source.align()
    flat: list[int] = []
    if len(values) == 1:
        first = sizes[source.number(1)] if len(sizes) > 1 else sizes[0]
        last = next((n for n in sizes if n != first), first)
        for i in range(n_runs):
            flat += [values[0]] * ((last if i == n_runs - 1 else first) + 1)
    else:
        trees = [(Tree.load(source), Tree.load(source)) for _ in values]
        before = 0
        for _ in range(n_runs):
            before = source.symbol(trees[before][0].symbols, trees[before][0].shortest)
            n = sizes[source.symbol(trees[before][1].symbols, trees[before][1].shortest)]
            flat += [values[before]] * (n + 1)
    source.align()
    out, at = [], 0
    for n in lengths:
        out.append(flat[at : at + n])
        at += n
    return out


def _store_bases(out: BitWriter, bases: list[list[int]], order: int) -> None:
    if order and any(bases):
        scheme = models.base_scheme(sorted({i for row in bases for i in row}))
        out.number(scheme, 1)
        models.store_bases(out, bases, scheme, order)
        return
    counts = [0] * DNA_SYMBOLS
    for row in bases:
        for i in row:
            counts[i] += 1
    present = [i for i, n in enumerate(counts) if n]
    if not present:
        out.number(NO_DNA, 1)
    elif max(present) < 4:
        out.number(TWO_BIT_BASES, 1)
        for row in bases:
            for i in row:
                out.bits(i, 2)
    else:
        out.number(HUFFMAN, 1)
        store_presence(out, present, DNA_SYMBOLS)
        tree, number = Tree.of([counts[i] for i in present]), {i: k for k, i in enumerate(present)}
        tree.store(out)
        for row in bases:
            for i in row:
                out.code(tree.codes[number[i]])
    out.align()


def _load_bases(source: BitReader, lengths: list[int], order: int) -> list[list[int]]:
    scheme = source.number(1)
    if scheme == NO_DNA:
        return [[] for _ in lengths]
    if order:
        return models.load_bases(source, lengths, scheme, order)
    if scheme == TWO_BIT_BASES:
        out = [[source.bits(2) for _ in range(n)] for n in lengths]
    elif scheme == HUFFMAN:
        present = load_presence(source, DNA_SYMBOLS)
        tree = Tree.load(source)
        out = [[present[source.symbol(tree.symbols, tree.shortest)] for _ in range(n)] for n in lengths]
    else:
        raise FormatError(f"no DNA scheme {scheme}")
    source.align()
    return out


def decode_block(data: bytes, shape: Shape) -> list[Record]:
    source = BitReader(data)
    n, high, flags, _ = (source.number() for _ in range(4))
    low = source.number() if flags & VARIABLE_LENGTH else high
    primer = None
    if shape.color_space and flags & CONSTANT_PRIMER:
        index, head = source.number(1), source.number(1)
        primer = _joined([head], [index], shape)
    sums = [source.number() for _ in range(1 + (not shape.mask) + (not shape.lossy))] if shape.crc32 else []
    tags, lengths = (_load_tags if flags & MIXED_TAGS else _load_fields)(source, n, low, high)
    symbols = _load_qualities(source, lengths, shape)
    bases = _load_bases(source, [sum(not _alone(s, shape) for s in row) for row in symbols], shape.dna_order)
    rows = [_joined(s, b, shape) for s, b in zip(symbols, bases)]
    if primer:
        rows = [(primer[0] + s, primer[1] + q) for s, q in rows]
    if shape.color_space:
        rows = [(colors(s), q) for s, q in rows]
    records = [(t, s, q) for t, (s, q) in zip(tags, rows)]
    # The bases of a lossy block come back with N for every ambiguity code, so only what is kept as it was can be verified.
    if sums and not shape.lossy and sums != _checksums(records, shape):
        raise FormatError("a block whose checksums don't hold")
    return records
