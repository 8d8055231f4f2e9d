"""Huffman codes and their stored form."""

from __future__ import annotations

import heapq

from readloom.codec.bits import BitReader, BitWriter
from readloom.errors import FormatError


class Tree:
    """codes: the bits of each symbol 0..n - 1 that has a code. A tree has two symbols at least, needed or not."""

    def __init__(self, n: int, root, root_id: int):
        self.n, self.root, self.root_id = n, root, root_id
        self.codes: dict[int, str] = {}
        stack = [(root, "")]
        while stack:
            node, code = stack.pop()
            if isinstance(node, tuple):
                stack += [(node[0], code + "0"), (node[1], code + "1")]
            else:
                self.codes[node] = code
        self.symbols = {c: s for s, c in self.codes.items()}
        self.shortest = min(map(len, self.symbols), default=0)

    @classmethod
    def of(cls, counts: list[int]) -> Tree:
        """Of equal counts the smaller symbol, or the earlier merge, is taken first; unused symbols get no code."""
        counts = list(counts) + [0] * (2 - len(counts))
        used = [s for s, c in enumerate(counts) if c]
        for s in range(len(counts)):  # two codes in any case
            if len(used) < 2 and s not in used:
                used.append(s)
        heap = [(max(counts[s], 1), s, s) for s in used]
        heapq.heapify(heap)
        fresh = len(counts)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            heapq.heappush(heap, (a[0] + b[0], fresh, (a[2], b[2])))
            fresh += 1
        return cls(len(counts), heap[0][2], fresh - 1)

    def store(self, out: BitWriter) -> None:
        """Aligned: size of all this, root number, symbols, shortest code; then the tree from the root, 0 for a fork and 1 for
        a leaf with its symbol."""
        body = BitWriter()
        body.number(self.root_id)
        body.number(self.n)
        body.number(self.shortest, 1)
        width = (self.n - 1).bit_length()

        stack = [self.root]
        while stack:
            node = stack.pop()
            if isinstance(node, tuple):
                body.bits(0, 1)
                stack += [node[1], node[0]]
            else:
                body.bits(1, 1)
                body.bits(node, width)
        data = body.bytes()
        out.number(len(data) + 4)
        out.done += data

    @classmethod
    def load(cls, source: BitReader) -> Tree:
        source.align()
        begin = source.at
        size, root_id, n, _ = source.number(), source.number(), source.number(), source.number(1)
        if not 2 <= n <= 1024 or size < 14:
            raise FormatError("a tree of an impossible size")
        width = (n - 1).bit_length()

        def node(depth: int):
            if depth > n:
                raise FormatError("a tree deeper than its symbols allow")
            if source.bits(1):
                return source.bits(width)
            left = node(depth + 1)
            return (left, node(depth + 1))

        root = node(0)
        source.align()
        if source.at != begin + size:
            raise FormatError("a tree of another size than it says")
        return cls(n, root, root_id)


def store_presence(out: BitWriter, present: list[int], size: int) -> None:
    """A bit for each of `size` symbols. The caller aligns."""
    has = set(present)
    out.code("".join("1" if s in has else "0" for s in range(size)))


def load_presence(source: BitReader, size: int) -> list[int]:
    return [s for s in range(size) if source.bits(1)]
