"""A table-driven asymmetric numeral coder of bytes: counts scaled to a power of two, one state, bits read backwards."""

from __future__ import annotations

import numpy as np

from foldwise.functions.bits import Damaged

# Bounds of the table's logarithm, and for small scaled counts the remainder (in 2**20ths) from which they are rounded up.
LEAST_LOG, MOST_LOG, USUAL_LOG = 5, 12, 11
ROUND_UP = (0, 473195, 504333, 520860, 550000, 700000, 750000, 830000)


def table_log(total: int, symbols: int, wanted: int = USUAL_LOG) -> int:
    """The logarithm of a table for ``total`` bytes of ``symbols`` kinds: no finer than the input, no coarser than the kinds need."""
    finest = max(LEAST_LOG, (total - 1).bit_length() - 3)
    coarsest = min(total.bit_length(), (symbols - 1).bit_length() + 1)
    return min(MOST_LOG, max(LEAST_LOG, coarsest, min(wanted, finest)))


def scaled(counts: np.ndarray, log: int) -> np.ndarray:
    """Counts scaled to a sum of 2**log: -1 for what is rarer than one part (it takes one), the rest rounded, the most frequent takes what is over."""
    counts, total = np.asarray(counts, np.int64), int(np.sum(counts))
    out, step, shift = np.zeros(len(counts), np.int64), (1 << 62) // total, 62 - log
    for i in np.flatnonzero(counts).tolist():
        n = int(counts[i])
        share = n * step >> shift
        if n <= total >> log:
            out[i] = -1
        else:
            over = n * step - (share << shift)
            out[i] = share + (share < 8 and over > ROUND_UP[min(share, 7)] << (shift - 20))
    left, top = (1 << log) - int(np.abs(out).sum()), int(out.argmax())
    if -left < out[top] >> 1:
        out[top] += left
        return out
    # much rounding up of rare symbols: what is owed comes off the others, largest first, in proportion
    while left < 0:
        for i in np.argsort(-out, kind="stable").tolist():
            take = min(-left, max(1, int(out[i]) // 8))
            if left < 0 and out[i] > take:
                out[i] -= take
                left += take
    return out


def _spread(norm: np.ndarray, log: int) -> np.ndarray:
    """The symbol of each state: rare ones from the top down, the others in strides that visit every state once."""
    size = 1 << log
    out, rare = np.empty(size, np.int64), np.flatnonzero(norm == -1)
    out[size - len(rare) :] = rare[::-1]
    usual = np.repeat(np.arange(len(norm)), np.maximum(norm, 0))
    stride = (size >> 1) + (size >> 3) + 3
    walk = np.arange(size, dtype=np.int64) * stride & (size - 1)
    out[walk[walk < size - len(rare)]] = usual
    return out


def _header(norm: np.ndarray, log: int) -> bytes:
    """The logarithm, then each symbol's scaled count plus one as a number of 1 or 2 bytes; runs of absent symbols as 0 and their length."""
    out, i = bytearray([log]), 0
    last = int(np.flatnonzero(norm)[-1])
    while i <= last:
        if norm[i] == 0:
            run = 1
            while run < 255 and norm[i + run] == 0:
                run += 1
            out += bytes([1, run])
            i += run
            continue
        value = int(norm[i]) + 1
        out += bytes([value]) if value < 128 and value != 1 else bytes([128 | value >> 8, value & 255])
        i += 1
    return len(out).to_bytes(2, "little") + bytes(out)


def _read_header(data: bytes) -> tuple[np.ndarray, int, int]:
    end = 2 + int.from_bytes(data[:2], "little")
    log, at, norm, i = data[2], 3, np.zeros(256, np.int64), 0
    while at < end:
        if data[at] == 1:
            i += data[at + 1]
            at += 2
            continue
        wide = data[at] >= 128
        norm[i] = ((data[at] & 127) << 8 | data[at + 1] if wide else data[at]) - 1
        at, i = at + 1 + wide, i + 1
    if np.abs(norm).sum() != 1 << log:
        raise Damaged("the table's counts do not fill it")
    return norm, log, end


def encode(data: bytes, wanted: int = USUAL_LOG) -> bytes | None:
    """Header, length, last state, bits; None if that is not smaller than ``data`` or there is but one kind of byte."""
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    kinds = int((counts > 0).sum())
    if kinds < 2:
        return None
    log = table_log(len(data), kinds, wanted)
    norm = scaled(counts, log)
    size, symbols = 1 << log, _spread(norm, log)
    # the states of a symbol in rising order: its k-th is reached from the number (its count + k), scaled down
    order = np.argsort(symbols, kind="stable") + size
    share = np.abs(norm)
    begin = (np.cumsum(share) - share).tolist()
    order, share = order.tolist(), share.tolist()
    state, bits = size, []
    for x in reversed(data):
        n, drop = share[x], 0
        while state >> drop >= 2 * n:
            drop += 1
        bits.append((state & ((1 << drop) - 1), drop))
        state = order[begin[x] + (state >> drop) - n]
    text = "".join(f"{v:0{n}b}" for v, n in reversed(bits) if n)
    packed = int(text.ljust(-(-len(text) // 8) * 8, "0") or "0", 2).to_bytes(-(-len(text) // 8), "big")
    out = _header(norm, log) + len(data).to_bytes(4, "little") + state.to_bytes(2, "little") + packed
    return out if len(out) < len(data) else None


def decode(data: bytes) -> bytes:
    norm, log, at = _read_header(data)
    size, symbols = 1 << log, _spread(norm, log)
    # the k-th state of a symbol stands for (its count + k) and takes as many bits as bring that back to the table's range
    share = np.abs(norm)
    order = np.argsort(symbols, kind="stable")
    number = np.empty(size, np.int64)
    number[order] = np.arange(size) - np.repeat(np.cumsum(share) - share, share) + np.repeat(share, share)
    lengths = (log + 1 - np.frexp(number.astype(float))[1]).tolist()
    number, symbols = number.tolist(), symbols.tolist()
    length, state = int.from_bytes(data[at : at + 4], "little"), int.from_bytes(data[at + 4 : at + 6], "little") - size
    body = data[at + 6 :]
    text, place, out = bin(int.from_bytes(b"\1" + body, "big"))[3:], 0, bytearray()
    if not 0 <= state < size:
        raise Damaged("no such state")
    for _ in range(length):
        out.append(symbols[state])
        n = lengths[state]
        if place + n > len(text):
            raise Damaged("the bits end early")
        state = (number[state] << n | int(text[place : place + n] or "0", 2)) - size
        place += n
    return bytes(out)
