"""Scalar codecs of residual blocks and instruction columns."""

from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import functions as F

from foldwise.functions import tans, vcdiff
from foldwise.functions.bits import ZIGZAG, BitReader, Damaged, extend, magnitude

# ---- columns: blocks as arrays of 64 numbers ----


def zigzag_column(block):
    return F.transform(F.array(*[F.lit(i) for i in ZIGZAG]), lambda i: F.get(block, i))


def dezigzag_column(block):
    back = [ZIGZAG.index(i) for i in range(64)]
    return F.transform(F.array(*[F.lit(i) for i in back]), lambda i: F.get(block, i))


def bit_length_column(value):
    """Bits of a value's magnitude, 0 for 0."""
    return F.when(value == 0, 0).otherwise(F.length(F.bin(F.abs(value).cast("long"))))


# ---- bytes ----


def entropy_code(data: bytes) -> tuple[bytes, bool]:
    """(bytes, coded): coded only if that is smaller."""
    packed = tans.encode(data)
    return (data, False) if packed is None else (packed, True)


def entropy_decode(data: bytes, coded: bool) -> bytes:
    return tans.decode(data) if coded else data


def run_lengths(blocks: np.ndarray) -> list[tuple[int, int]]:
    """(run, value) pairs of natural-order blocks: zigzag, first coefficients as differences, zeros as runs.

    Sixteen zeros are (15, 0); zeros up to a block's end are (0, 0), which a block
    without them lacks.
    """
    rows = blocks.astype(np.int64)[:, ZIGZAG]
    rows[1:, 0] = np.diff(rows[:, 0])
    out: list[tuple[int, int]] = []
    for row in rows:
        at = -1
        for i in np.flatnonzero(row).tolist():
            gap = i - at - 1
            out += [(15, 0)] * (gap // 16)
            out.append((gap % 16, int(row[i])))
            at = i
        if at < 63:
            out.append((0, 0))
    return out


def from_run_lengths(pairs: list[tuple[int, int]], count: int) -> np.ndarray:
    rows, block, at = np.zeros((count, 64), np.int64), 0, 0
    for run, value in pairs:
        if value:
            at += run
            rows[block, at] = value
            at += 1
        elif run == 15:
            at += 16
        else:
            at = 64
        if at >= 64:
            block, at = block + 1, 0
    if block != count:
        raise Damaged("the residual does not fill its blocks")
    rows[:, 0] = np.cumsum(rows[:, 0])
    out = np.empty_like(rows)
    out[:, ZIGZAG] = rows
    return out


def pack_values(pairs: list[tuple[int, int]]) -> tuple[bytes, bytes]:
    """(symbols, bits): a symbol is run << 4 | size, at most 15 bits a value; the bits are packed."""
    symbols, bits = bytearray(), []
    for run, value in pairs:
        size, code = magnitude(value)
        if size > 15:
            raise ValueError("a coefficient needs over 15 bits")
        symbols.append(run << 4 | size)
        if size:
            bits.append(f"{code:0{size}b}")
    text = "".join(bits)
    return bytes(symbols), int(text.ljust(-(-len(text) // 8) * 8, "0") or "0", 2).to_bytes(-(-len(text) // 8), "big")


def unpack_values(symbols: bytes, bits: bytes) -> list[tuple[int, int]]:
    reader, out = BitReader(bits), []
    for symbol in symbols:
        run, size = divmod(symbol, 16)
        out.append((run, extend(reader.take(size), size)))
    return out


def pack_residual(blocks: np.ndarray) -> bytes:
    """A residual container: sizes, coded flag, symbols and bits; no blocks, no bytes."""
    if not len(blocks):
        return b""
    symbols, bits = pack_values(run_lengths(blocks))
    coded, flag = entropy_code(symbols)
    return struct.pack("<IIBI", len(blocks), len(coded), flag, len(bits)) + coded + bits


def unpack_residual(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros((0, 64), np.int64)
    count, n, flag, m = struct.unpack_from("<IIBI", data)
    at = struct.calcsize("<IIBI")
    return from_run_lengths(unpack_values(entropy_decode(data[at : at + n], bool(flag)), data[at + n : at + n + m]), count)


def pack_column(values: list[int]) -> tuple[bytes, bool]:
    return entropy_code(np.asarray(values, "<u2").tobytes())


def unpack_column(data: bytes, coded: bool) -> list[int]:
    return np.frombuffer(entropy_decode(data, coded), "<u2").tolist()


def delta_bytes(base: bytes, target: bytes) -> bytes:
    """``target`` as a byte delta against the whole base, entropy-coded if that is smaller: a flag and the payload."""
    return packed_delta(vcdiff.encode(base, target))


def packed_delta(delta: bytes) -> bytes:
    payload, coded = entropy_code(delta)
    return bytes([coded]) + payload


def plain_delta(data: bytes) -> bytes:
    return entropy_decode(data[1:], bool(data[0]))


def undelta_bytes(base: bytes, data: bytes) -> bytes:
    return vcdiff.decode(base, plain_delta(data))


def composed_delta(one: bytes, two: bytes) -> bytes:
    """From one's base to two's target."""
    return packed_delta(vcdiff.compose(plain_delta(one), plain_delta(two)))
