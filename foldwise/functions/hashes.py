"""Rolling and block hashes: Rabin, gear, Adler-32, DC and parity hashes."""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
from pyspark.sql import functions as F

# The irreducible polynomial of the Rabin fingerprint and Adler's modulus.
RABIN_POLYNOMIAL = 0x3DA3358B4DC173
ADLER = 65521


def _degree(p: int) -> int:
    return p.bit_length() - 1


def _mod(x: int, p: int) -> int:
    while _degree(x) >= _degree(p):
        x ^= p << (_degree(x) - _degree(p))
    return x


class Rabin:
    """Rabin fingerprint of the last ``window`` bytes, seeded by one byte 1."""

    def __init__(self, window: int, polynomial: int = RABIN_POLYNOMIAL):
        self.window, self.polynomial, degree = window, polynomial, _degree(polynomial)
        self._tables: list[np.ndarray] | None = None
        self.shift, self.mask = degree - 8, (1 << degree) - 1
        self.reduce = [_mod(b << degree, polynomial) ^ (b << degree) for b in range(256)]

    def reset(self) -> None:
        # what leaves the window counts as its first byte
        self.ring, self.place, self.digest, self.out = bytearray(self.window), 0, 0, self._place_tables()[0].tolist()
        self.slide(1)

    def slide(self, byte: int) -> int:
        self.digest ^= self.out[self.ring[self.place]]
        self.ring[self.place] = byte
        self.place = (self.place + 1) % self.window
        top = self.digest >> self.shift
        self.digest = ((self.digest << 8) | byte) ^ self.reduce[top]
        return self.digest

    def windows(self, data: bytes, step: int = 1) -> np.ndarray:
        """The digest of each full window, ``step`` bytes apart (128 for blocks).

        A digest is a residue, so it is the exclusive or of what each byte gives at
        its place: one table look-up for each place of the window, for all windows at once.
        """
        octets = np.frombuffer(data, np.uint8)
        count = (len(octets) - self.window) // step + 1
        if count <= 0:
            return np.zeros(0, np.uint64)
        out = np.zeros(count, np.uint64)
        for place, table in enumerate(self._place_tables()):
            out ^= table[octets[place : place + (count - 1) * step + 1 : step]]
        # the seed, a byte 1 slid in at the reset, has left every full window
        return out

    def grids(self, blocks: np.ndarray, side: int) -> np.ndarray:
        """Digests of all squares of ``side`` blocks, column by column, of blocks as (rows, columns, bytes); window = side * side blocks."""
        rows, columns, size = blocks.shape
        if rows < side or columns < side:
            return np.zeros(0, np.uint64)
        out = np.zeros((rows - side + 1, columns - side + 1), np.uint64)
        tables = iter(self._place_tables())
        for x in range(side):
            for y in range(side):
                own = blocks[y : y + out.shape[0], x : x + out.shape[1]]
                for k in range(size):
                    out ^= next(tables)[own[:, :, k]]
        return out.ravel()

    def shares(self, octets: dict[int, np.ndarray], first: int) -> np.ndarray | np.uint64:
        """What bytes add to a digest (by exclusive or), for many strings at once: by a byte's number its values, the byte 0 being at place ``first`` of the window.

        A byte 0 and a byte outside the window add nothing.
        """
        out, tables = None, self._place_tables()
        for k, own in octets.items():
            if 0 <= first + k < self.window:
                out = tables[first + k][own] if out is None else out ^ tables[first + k][own]
        return np.uint64(0) if out is None else out

    def _place_tables(self) -> list[np.ndarray]:
        if self._tables is None:
            self._tables = [np.array([_mod(b, self.polynomial) for b in range(256)], np.uint64)]
            for _ in range(self.window - 1):
                # one byte further from the window's end: times x**8
                last = self._tables[-1]
                self._tables.append(((last << np.uint64(8)) & np.uint64(self.mask)) ^ np.array(self.reduce, np.uint64)[(last >> np.uint64(self.shift)).astype(np.int64)] & np.uint64(self.mask))
        return self._tables[::-1]


@lru_cache(16)
def rabin(window: int) -> Rabin:
    """A fingerprint whose tables are made once a process; only its window functions may be shared."""
    return Rabin(window)


def gear_table() -> np.ndarray:
    """256 random words from a counter."""
    with np.errstate(over="ignore"):
        z = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


GEAR = gear_table()


def gear(data: bytes) -> np.ndarray:
    """h = 2 h + T[byte] modulo 2**64 after each byte: the last 64 bytes count."""
    h = GEAR[np.frombuffer(data, np.uint8)] if len(data) else np.zeros(0, np.uint64)
    width = 1
    with np.errstate(over="ignore"):
        while width < 64 and width < len(h):
            h = h + np.concatenate([np.zeros(width, np.uint64), h[:-width] << np.uint64(width)])
            width *= 2
    return h


def gear_blocks(blocks: np.ndarray) -> np.ndarray:
    """Of blocks of 128 bytes, (n, 128): the gear hashes of their halves, added."""
    with np.errstate(over="ignore"):
        return (GEAR[blocks.reshape(-1, 2, 64)] << np.arange(63, -1, -1, dtype=np.uint64)).sum(axis=(1, 2), dtype=np.uint64)


def adler32(data: bytes) -> int:
    return zlib.adler32(data)


def adler32_combine(one: int, two: int, length: int) -> int:
    """The checksum of two strings put together, from theirs and the second's length."""
    a = ((one & 0xFFFF) + (two & 0xFFFF) - 1) % ADLER
    b = ((one >> 16) + (two >> 16) + length * ((one & 0xFFFF) - 1)) % ADLER
    return b << 16 | a


def adler32_roll(checksum: int, coming: int, going: int, window: int) -> int:
    """The checksum of a window moved by one byte."""
    a = ((checksum & 0xFFFF) + coming - going) % ADLER
    b = ((checksum >> 16) + a - window * going - 1) % ADLER
    return b << 16 | a


def adler32_column(octets):
    """Adler-32 of an array of bytes: both sums in closed form, in one pass."""
    n = F.size(octets).cast("long")
    zero = F.struct(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))
    both = F.aggregate(octets, zero, lambda s, x: F.struct((s["a"] + x).alias("a"), (s["b"] + s["a"] + x).alias("b")))
    return F.shiftleft((both["b"] + n) % ADLER, 16) + (both["a"] + 1) % ADLER


def adler32_combine_column(one, two, length):
    """:func:`adler32_combine` over columns."""
    low = lambda x: x.bitwiseAND(0xFFFF)
    a = F.pmod(low(one) + low(two) - 1, F.lit(ADLER))
    b = F.pmod(F.shiftright(one, 16) + F.shiftright(two, 16) + length * (low(one) - 1), F.lit(ADLER))
    return F.shiftleft(b, 16) + a


def octets(text):
    """A string's UTF-8 bytes as an array of numbers."""
    pairs = F.regexp_extract_all(F.hex(F.encode(text, "UTF-8")), F.lit(".."), F.lit(0))
    return F.transform(pairs, lambda x: F.conv(x, 16, 10).cast("long"))


def dc_hash_column(block):
    """Of a block of 64 coefficients: the first one, the upper byte of the ninth, the lower byte of the tenth."""
    return F.shiftleft(F.get(block, 0).cast("long"), 24).bitwiseOR(F.get(block, 8).cast("long").bitwiseAND(0xFF00)).bitwiseOR(F.get(block, 9).cast("long").bitwiseAND(0xFF))


def parity_hash_column(block):
    """The low bits of a block's coefficients as a string of 0 and 1."""
    return F.array_join(F.transform(block, lambda v: v.bitwiseAND(1).cast("string")), "")
