"""Byte deltas in the format of RFC 3284: matching over the whole source, encoding, decoding, and composing two deltas.

A delta is a list of operations, ``("add", bytes)``, ``("run", byte, size)`` and
``("copy", address, size)``; addresses count from the source's first byte on into
the target, which follows it.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right
from itertools import product

import numpy as np

from foldwise.functions.bits import Damaged

#: Bytes of a source block that is looked up at every place of the target; they are entered every BLOCK bytes.
BLOCK = 16
#: Least bytes of a copy within the target, of a run of one byte, and most source places tried for one block.
LEAST_COPY, LEAST_RUN, TRIES = 4, 8, 8

# Fixed values of RFC 3284: magic bytes, sizes of the address caches, window flags.
MAGIC, NEAR, SAME, FROM_SOURCE, CHECKED = b"\xd6\xc3\xc4\x00", 4, 3, 1, 4


def _code_table() -> list[tuple]:
    """The default instruction table: for each code one or two of (kind, size, mode); size 0 is written out."""
    out = [(("run", 0, 0),)] + [(("add", n, 0),) for n in range(18)]
    out += [(("copy", n, m),) for m in range(9) for n in (0, *range(4, 19))]
    out += [(("add", a, 0), ("copy", n, m)) for m, a, n in product(range(6), range(1, 5), range(4, 7))]
    out += [(("add", a, 0), ("copy", 4, m)) for m, a in product(range(6, 9), range(1, 5))]
    return out + [(("copy", 4, m), ("add", 1, 0)) for m in range(9)]


TABLE = _code_table()
_CODES = {entry: code for code, entry in enumerate(TABLE)}


class _Addresses:
    """The near and same caches, alike on both sides."""

    def __init__(self):
        self.near, self.at, self.same = [0] * NEAR, 0, [0] * (SAME * 256)

    def keep(self, address: int) -> None:
        self.near[self.at] = address
        self.at = (self.at + 1) % NEAR
        self.same[address % (SAME * 256)] = address

    def write(self, address: int, here: int) -> tuple[int, bytes]:
        """(mode, bytes) of the shortest way to name an address."""
        slot = address % (SAME * 256)
        options = [(_number(address), 0), (_number(here - address), 1)]
        options += [(_number(address - x), 2 + i) for i, x in enumerate(self.near) if address >= x]
        if self.same[slot] == address:
            options.append((bytes([slot % 256]), 2 + NEAR + slot // 256))
        data, mode = min(options, key=lambda o: (len(o[0]), o[1]))
        self.keep(address)
        return mode, data

    def read(self, mode: int, here: int, source: _Reader) -> int:
        if mode >= 2 + NEAR:
            address = self.same[(mode - 2 - NEAR) * 256 + source.byte()]
        else:
            value = source.number()
            address = value if mode == 0 else here - value if mode == 1 else self.near[mode - 2] + value
        if not 0 <= address < here:
            raise Damaged("a copy from behind its own place")
        self.keep(address)
        return address


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def byte(self) -> int:
        self.at += 1
        if self.at > len(self.data):
            raise Damaged("the delta ends early")
        return self.data[self.at - 1]

    def number(self) -> int:
        out = 0
        while True:
            b = self.byte()
            out = out << 7 | b & 127
            if b < 128:
                return out

    def take(self, n: int) -> bytes:
        self.at += n
        if self.at > len(self.data):
            raise Damaged("the delta ends early")
        return self.data[self.at - n : self.at]


def _number(value: int) -> bytes:
    """Seven bits a byte, the highest first."""
    if value < 128:
        return bytes((value,))
    out = [value & 127]
    while value := value >> 7:
        out.append(value & 127 | 128)
    return bytes(reversed(out))


# ---- matching ----


def _rolling(data: np.ndarray, n: int, step: int = 1) -> np.ndarray:
    """A hash of the ``n`` bytes from each place on, or from every ``step``-th."""
    if len(data) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros((len(data) - n) // step + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out *= np.uint64(0x9E3779B97F4A7C15)
            out += data[k : k + (len(out) - 1) * step + 1 : step]
    return out


def _common(a: bytes, i: int, b: bytes, j: int) -> int:
    """How many bytes agree from a[i] and b[j] on."""
    most, n = min(len(a) - i, len(b) - j), 0
    while n < most:
        step = min(max(64, n), most - n)
        if a[i + n : i + n + step] == b[j + n : j + n + step]:
            n += step
            continue
        if step > 1024:
            one, two = np.frombuffer(a, np.uint8, step, i + n), np.frombuffer(b, np.uint8, step, j + n)
            return n + int((one != two).argmax())
        differ = int.from_bytes(a[i + n : i + n + step], "little") ^ int.from_bytes(b[j + n : j + n + step], "little")
        return n + ((differ & -differ).bit_length() - 1 >> 3)
    return n


def _common_before(a: bytes, i: int, b: bytes, j: int, most: int) -> int:
    n = 0
    while n < most and i > n and a[i - n - 1] == b[j - n - 1]:
        n += 1
    return n


def operations(source: bytes, target: bytes) -> list[tuple]:
    """The target as adds, runs and copies: at each place the longest of the source matches, an earlier place of the target, or a run."""
    own = np.frombuffer(target, np.uint8)
    # places of the target whose block begins somewhere in the source
    blocks = _rolling(np.frombuffer(source, np.uint8), BLOCK, BLOCK)
    order = np.argsort(blocks, kind="stable")
    blocks = blocks[order]
    seen = _rolling(own, BLOCK)
    first, last = np.searchsorted(blocks, seen, "left"), np.searchsorted(blocks, seen, "right")
    # the place before at which the same four bytes stand
    small = _rolling(own, LEAST_COPY)
    before = np.full(len(small), -1, np.int64)
    by = np.argsort(small, kind="stable")
    equal = small[by[1:]] == small[by[:-1]]
    before[by[1:][equal]] = by[:-1][equal]
    # lengths of runs of one byte
    breaks = memoryview(np.flatnonzero(np.concatenate([own[1:] != own[:-1], [True]])) if len(own) else np.zeros(0, np.int64))
    worth = before >= 0
    worth[: len(first)] |= last > first
    flags = worth.tobytes()
    # numbers of a view are those of Python
    before, first, last, order = (memoryview(np.ascontiguousarray(x, np.int64)) for x in (before, first, last, order))
    out: list[tuple] = []
    at = pending = 0

    def flush(end: int) -> None:
        if end > pending:
            out.append(("add", target[pending:end]))

    i = flags.find(1)
    while i >= 0:
        best, address, back = 0, 0, 0
        if i < len(first):
            for k in order[first[i] : min(last[i], first[i] + TRIES)]:
                ahead = _common(source, k * BLOCK, target, i)
                behind = _common_before(source, k * BLOCK, target, i, i - pending)
                if ahead >= BLOCK and ahead + behind > best:
                    best, address, back = ahead + behind, k * BLOCK - behind, behind
        if before[i] >= 0 and best < BLOCK * 4:
            # overlapping copies repeat what they write
            run = breaks[bisect_left(breaks, i)] - i + 1
            if run >= LEAST_RUN and run > best:
                flush(i)
                out.append(("run", target[i], run))
                at = pending = i + run
                i = flags.find(1, at)
                continue
            ahead = _common(target, before[i], target, i)
            if ahead > best and ahead >= LEAST_COPY + (i - before[i] >= 128) + (i - before[i] >= 1 << 14):
                best, address, back = ahead, len(source) + before[i], 0
        if best:
            flush(i - back)
            out.append(("copy", address, best))
            at = pending = i - back + best
        i = flags.find(1, max(at, i + 1))
    flush(len(target))
    return out


# ---- format ----


def pack(ops: list[tuple], source_size: int, checksum: int | None) -> bytes:
    """One window for the whole target."""
    data, codes, names = bytearray(), bytearray(), bytearray()
    caches, here, held = _Addresses(), source_size, None

    def single(kind: str, size: int, mode: int) -> None:
        entry = ((kind, size, mode),)
        if entry in _CODES:
            codes.append(_CODES[entry])
        else:
            codes.append(_CODES[((kind, 0, mode),)])
            codes.extend(_number(size))

    for op in ops:
        if op[0] == "add":
            data += op[1]
            own = ("add", len(op[1]), 0)
        elif op[0] == "run":
            data.append(op[1])
            own = ("run", op[2], 0)
        else:
            mode, name = caches.write(op[1], here)
            names += name
            own = ("copy", op[2], mode)
        here += own[1]
        if held and (held, own) in _CODES:
            codes.append(_CODES[held, own])
            held = None
            continue
        if held:
            single(*held)
        held = own
    if held:
        single(*held)
    flags = (FROM_SOURCE if source_size else 0) | (CHECKED if checksum is not None else 0)
    segment = _number(source_size) + _number(0) if source_size else b""
    check = checksum.to_bytes(4, "big") if checksum is not None else b""
    body = _number(here - source_size) + b"\0" + b"".join(_number(len(x)) for x in (data, codes, names)) + check + bytes(data) + bytes(codes) + bytes(names)
    return MAGIC + b"\0" + bytes([flags]) + segment + _number(len(body)) + body


def unpack(delta: bytes) -> tuple[list[tuple], int, int, int | None]:
    """(operations, source size, target size, checksum or None) of a delta of one window."""
    reader = _Reader(delta)
    if reader.take(5) != MAGIC + b"\0":
        raise Damaged("not a delta")
    flags, source_size = reader.byte(), 0
    if flags & FROM_SOURCE:
        source_size = reader.number()
        if reader.number():
            raise Damaged("the window's source does not begin at its first byte")
    reader.number()
    target_size = reader.number()
    if reader.byte():
        raise Damaged("secondary coding")
    sizes = [reader.number() for _ in range(3)]
    checksum = int.from_bytes(reader.take(4), "big") if flags & CHECKED else None
    data, codes, names = (_Reader(reader.take(n)) for n in sizes)
    caches, here, ops = _Addresses(), source_size, []
    while codes.at < len(codes.data):
        for kind, size, mode in TABLE[codes.byte()]:
            if kind == "add" and size == 0 or kind == "run" or kind == "copy" and size == 0:
                size = codes.number()
            if kind == "add":
                ops.append(("add", data.take(size)))
            elif kind == "run":
                ops.append(("run", data.byte(), size))
            else:
                ops.append(("copy", caches.read(mode, here, names), size))
            here += size
    if here - source_size != target_size:
        raise Damaged("the operations do not make the target's size")
    return ops, source_size, target_size, checksum


def encode(source: bytes, target: bytes) -> bytes:
    return pack(operations(source, target), len(source), zlib.adler32(target))


def decode(source: bytes, delta: bytes) -> bytes:
    ops, source_size, _, checksum = unpack(delta)
    if source_size != len(source):
        raise Damaged("another source")
    out = bytearray()
    for op in ops:
        if op[0] == "add":
            out += op[1]
        elif op[0] == "run":
            out += bytes([op[1]]) * op[2]
        else:
            _, address, size = op
            if address < source_size:
                head = source[address : address + size]
                out += head
                size, address = size - len(head), source_size
            begin = address - source_size
            while size > 0:
                piece = out[begin : begin + size]
                out += piece
                size, begin = size - len(piece), begin + len(piece)
    if checksum is not None and zlib.adler32(bytes(out)) != checksum:
        raise Damaged("the target's checksum differs")
    return bytes(out)


# ---- composing ----


def _pieces(ops: list[tuple], source_size: int) -> tuple[list[int], list[tuple]]:
    """(begins, operations) of the target without copies from itself: every piece is an add, a run or a copy from the source."""
    begins, flat, size = [], [], 0

    def put(op: tuple) -> None:
        nonlocal size
        begins.append(size)
        flat.append(op)
        size += _size(op)

    for op in ops:
        if op[0] != "copy" or op[1] + op[2] <= source_size:
            put(op)
            continue
        _, address, left = op
        if address < source_size:
            put(("copy", address, source_size - address))
            left, address = left - (source_size - address), source_size
        begin = address - source_size
        while left > 0:
            for part in _cut(begins, flat, begin, min(left, size - begin)):
                put(part)
                left, begin = left - _size(part), begin + _size(part)
    return begins, flat


def _size(op: tuple) -> int:
    return len(op[1]) if op[0] == "add" else op[2]


def _cut(begins: list[int], flat: list[tuple], begin: int, size: int) -> list[tuple]:
    """The pieces that make ``size`` bytes from ``begin`` on."""
    out, i = [], bisect_right(begins, begin) - 1
    while size > 0:
        skip = begin - begins[i]
        op, n = flat[i], min(size, _size(flat[i]) - skip)
        out.append(("add", op[1][skip : skip + n]) if op[0] == "add" else ("run", op[1], n) if op[0] == "run" else ("copy", op[1] + skip, n))
        begin, size, i = begin + n, size - n, i + 1
    return out


def compose(one: bytes, two: bytes) -> bytes:
    """The delta from one's source to two's target, given that one's target is two's source; no text is made."""
    first, source_size, middle, _ = unpack(one)
    second, expected, _, checksum = unpack(two)
    if middle != expected:
        raise Damaged("the second delta has another source")
    begins, flat = _pieces(first, source_size)
    out: list[tuple] = []

    def put(op: tuple) -> None:
        if out and op[0] == out[-1][0] == "add":
            out[-1] = ("add", out[-1][1] + op[1])
        elif out and op[0] == out[-1][0] == "copy" and out[-1][1] + out[-1][2] == op[1] != source_size:
            out[-1] = ("copy", out[-1][1], out[-1][2] + op[2])
        else:
            out.append(op)

    for op in second:
        if op[0] != "copy":
            put(op)
            continue
        _, address, size = op
        if address < middle:
            head = min(size, middle - address)
            for part in _cut(begins, flat, address, head):
                put(part)
            address, size = middle, size - head
        if size:
            put(("copy", address - middle + source_size, size))
    return pack(out, source_size, checksum)
