"""Bit strings, Huffman tables and JPEG segment scanning shared by the codecs."""

from __future__ import annotations


class Damaged(ValueError):
    """The bytes cannot be decoded."""


class BitReader:
    """Bits of a byte string, most significant first; behind the end all bits are 1."""

    def __init__(self, data: bytes):
        self.bits = bin(int.from_bytes(b"\1" + data, "big"))[3:] if data else ""
        self.at = 0

    def take(self, n: int) -> int:
        if not n:
            return 0
        part = self.bits[self.at : self.at + n]
        self.at += n
        if self.at > len(self.bits) + 64:
            raise Damaged("the data end early")
        return int(part.ljust(n, "1"), 2)

    def symbol(self, codes: dict[str, int]) -> int:
        short = getattr(codes, "short", None)
        if short is not None:
            found = short.get(self.bits[self.at : self.at + 8])
            if found is not None:
                self.at += found[0]
                return found[1]
        for n in range(1, 17):
            found = codes.get(self.bits[self.at : self.at + n])
            if found is not None:
                self.at += n
                return found
            if self.at + n > len(self.bits):
                break
        raise Damaged("no such code")


class Codes(dict):
    """Code as a bit string -> symbol; ``short`` has (length, symbol) for every eight bits that begin with a code of at most eight."""

    def __init__(self, codes: dict[str, int]):
        super().__init__(codes)
        self.short = {code + f"{tail:0{8 - len(code)}b}" * (len(code) < 8): (len(code), symbol) for code, symbol in codes.items() if len(code) <= 8 for tail in range(1 << (8 - len(code)))}


def huffman(counts: bytes, symbols: bytes) -> Codes:
    """The codes of a table as JPEG writes it: those of each length in rising order."""
    out, code, at = {}, 0, 0
    for length, count in enumerate(counts, 1):
        for _ in range(count):
            out[f"{code:0{length}b}"] = symbols[at]
            code, at = code + 1, at + 1
        code <<= 1
    return Codes(out)


def extend(value: int, size: int) -> int:
    """A magnitude of ``size`` bits whose top bit is 0 is negative, in one's complement."""
    return value if not size or value >> (size - 1) else value - (1 << size) + 1


def magnitude(value: int) -> tuple[int, int]:
    """(size, bits) of a value; the inverse of :func:`extend`."""
    size = abs(value).bit_length()
    return size, value if value >= 0 else value + (1 << size) - 1


def zigzag_order() -> list[int]:
    """Natural index 8 * row + column of each zigzag place: diagonals, walked up and down in turn."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda rc: (sum(rc), rc[0] if sum(rc) % 2 else rc[1]))
    return [8 * r + c for r, c in cells]


ZIGZAG = zigzag_order()
