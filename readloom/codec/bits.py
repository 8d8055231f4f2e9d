"""Bits, most significant first, between byte-aligned words and bytes."""

from __future__ import annotations

from readloom.errors import FormatError


class BitWriter:
    """Bits are held as text until the next byte boundary is asked for."""

    def __init__(self):
        self.done, self.held = bytearray(), []

    def bits(self, value: int, n: int) -> None:
        if n:
            self.held.append(format(value & ((1 << n) - 1), f"0{n}b"))

    def code(self, code: str) -> None:
        self.held.append(code)

    def align(self) -> None:
        """The last byte is filled up with zeros at its low end."""
        if self.held:
            text = "".join(self.held)
            text += "0" * (-len(text) % 8)
            self.done += int(text, 2).to_bytes(len(text) // 8, "big")
            self.held = []

    def number(self, value: int, size: int = 4) -> None:
        self.align()
        self.done += value.to_bytes(size, "big")

    def raw(self, data: bytes) -> None:
        self.align()
        self.done += data

    def bytes(self) -> bytes:
        self.align()
        return bytes(self.done)


class BitReader:
    def __init__(self, data: bytes):
        self.data, self.at, self.text, self.pos = data, 0, "", 0

    def _more(self, n: int) -> None:
        while len(self.text) - self.pos < n:
            chunk = self.data[self.at : self.at + 4096]
            if not chunk:
                raise FormatError("a block ends in the middle of a stream")
            self.text = self.text[self.pos :] + format(int.from_bytes(chunk, "big"), f"0{8 * len(chunk)}b")
            self.pos, self.at = 0, self.at + len(chunk)

    def bits(self, n: int) -> int:
        if not n:
            return 0
        self._more(n)
        out = int(self.text[self.pos : self.pos + n], 2)
        self.pos += n
        return out

    def symbol(self, codes: dict[str, int], shortest: int) -> int:
        n = shortest
        while True:
            self._more(n)
            found = codes.get(self.text[self.pos : self.pos + n])
            if found is not None:
                self.pos += n
                return found
            n += 1
            if n > 64:
                raise FormatError("no code of the tree fits")

    def align(self) -> None:
        """Go on at the next byte that no bit has been taken from."""
        self.at -= (len(self.text) - self.pos) // 8
        self.text, self.pos = "", 0

    def number(self, size: int = 4) -> int:
        self.align()
        if self.at + size > len(self.data):
            raise FormatError("a block ends in the middle of a number")
        out = int.from_bytes(self.data[self.at : self.at + size], "big")
        self.at += size
        return out

    def raw(self, size: int) -> bytes:
        self.align()
        if self.at + size > len(self.data):
            raise FormatError("a block ends in the middle of a text")
        self.at += size
        return self.data[self.at - size : self.at]

    def rest(self) -> tuple[bytes, int]:
        """The whole block and where the next byte is in it, for a reader of bytes."""
        self.align()
        return self.data, self.at

    def skip_to(self, at: int) -> None:
        self.at, self.text, self.pos = at, "", 0
