"""Baseline JPEG at the level of coefficients: lossless decode and re-encode with the file's own tables."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

from foldwise.functions.bits import ZIGZAG, Damaged, extend, huffman

#: Most blocks that a table remembers before it starts anew, bits by which it knows them, and bytes that are looked at together.
REMEMBERED, KEY, AHEAD = 1 << 17, 80, 24
#: Files that are at least read side by side, symbols between two looks at which have ended, and bytes of files read side by side.
LANES, STEPS, GROUP = 32, 96, 12 << 20
#: What reading a file that is no baseline image raises.
UNREADABLE = (Damaged, IndexError, KeyError, ValueError, struct.error)


@dataclass
class Coefficients:
    """``header`` up to the scan's data, planes of (rows, columns, 64) int16 in natural order, two tail bytes."""

    header: bytes
    planes: list[np.ndarray]
    tail: bytes


class Table:
    """A Huffman table; ``first`` remembers (bits taken, difference) by the 20 bits that a first coefficient begins with."""

    def __init__(self, codes: dict[str, int]):
        self.codes = {(len(code), int(code, 2)): symbol for code, symbol in codes.items()}
        self.short = {int(bits, 2): found for bits, found in codes.short.items()}
        self.first: dict[int, tuple] = {}
        #: (bits taken, places to skip, value or 0) by the 16 bits that another coefficient begins with.
        self.others: dict[int, tuple] = {}
        self.code, self.length = np.zeros(256, np.int64), np.zeros(256, np.int64)
        for (length, code), symbol in self.codes.items():
            self.code[symbol], self.length[symbol] = code, length
        #: (bits, code) of symbol 0: no difference, or the end of a block.
        self.zero = int(self.length[0]), int(self.code[0])

    def symbol(self, window: int) -> tuple[int, int]:
        """(bits, symbol) of the code that 16 bits begin with."""
        found = self.short.get(window >> 8)
        if found is not None:
            return found
        for n in range(1, 17):
            found = self.codes.get((n, window >> (16 - n)))
            if found is not None:
                return n, found
        raise Damaged("no such code")

    def difference(self, window: int) -> tuple[int, int]:
        """(bits, value) of the first coefficient that 48 bits begin with."""
        n, size = self.symbol(window >> 32)
        if n + size > 48:
            raise Damaged("no such code")
        found = n + size, extend((window >> (48 - n - size)) & ((1 << size) - 1), size)
        if found[0] <= 20:
            if len(self.first) >= REMEMBERED:
                self.first.clear()
            self.first[window >> 28] = found
        return found

    def other(self, window: int) -> tuple[int, int, int]:
        """(bits, places to skip, value) of the symbol that 32 bits begin with; without a value 16 places, or all of them at the block's end."""
        n, symbol = self.symbol(window >> 16)
        run, size = symbol >> 4, symbol & 15
        found = n + size, run if size else 16 if run == 15 else 64, extend(window >> (32 - n - size) & ((1 << size) - 1), size)
        if n + size <= 16:
            self.others[window >> 16] = found
        return found


@lru_cache(64)
def _table(counts: bytes, symbols: bytes) -> Table:
    return Table(huffman(counts, symbols))


@lru_cache(4096)
def _layout(header: bytes) -> dict:
    at, found = 2, {"dc": {}, "ac": {}, "restart": 0}
    while at + 4 <= len(header):
        kind, size = header[at + 1], struct.unpack(">H", header[at + 2 : at + 4])[0]
        body = header[at + 4 : at + 2 + size]
        at += 2 + size
        if kind in (0xC0, 0xC1):
            _, height, width, n = struct.unpack(">BHHB", body[:6])
            found |= {"height": height, "width": width, "parts": [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15) for i in range(n)]}
        elif 0xC0 < kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            raise Damaged("not a baseline image")
        elif kind == 0xC4:
            while body:
                n = sum(body[1:17])
                found["ac" if body[0] >> 4 else "dc"][body[0] & 15] = _table(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif kind == 0xDD:
            found["restart"] = struct.unpack(">H", body[:2])[0]
        elif kind == 0xDA:
            found["tables"] = {body[1 + 2 * i]: divmod(body[2 + 2 * i], 16) for i in range(body[0])}
    if "parts" not in found or "tables" not in found:
        raise Damaged("no frame or scan")
    if len(found["tables"]) != len(found["parts"]):
        raise Damaged("more than one scan")
    return found


def scan_start(data: bytes) -> int:
    """Where the entropy-coded data begin: behind the start-of-scan segment."""
    at = 2
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise Damaged("no marker")
        size = struct.unpack(">H", data[at + 2 : at + 4])[0]
        if data[at + 1] == 0xDA:
            return at + 2 + size
        at += 2 + size
    raise Damaged("no scan")


def _units(found: dict) -> tuple[int, int]:
    h, v = max(p[1] for p in found["parts"]), max(p[2] for p in found["parts"])
    return -(-found["height"] // (8 * v)), -(-found["width"] // (8 * h))


@lru_cache(64)
def _order(parts: tuple, down: int, across: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place among the blocks of all planes, component) of each block in the scan's order, and the scan's place of each block of all planes."""
    of, kinds, first = [], [], 0
    for c, (_, h, v) in enumerate(parts):
        places = np.arange(first, first + down * v * across * h).reshape(down, v, across, h)
        of.append(places.transpose(0, 2, 1, 3).reshape(down * across, v * h))
        kinds += [c] * (v * h)
        first += down * v * across * h
    of = np.concatenate(of, axis=1).ravel()
    back = np.empty_like(of)
    back[of] = np.arange(len(of))
    return of, np.tile(np.array(kinds), down * across), back


_ZIGZAG = np.array(ZIGZAG)
_BACK = np.argsort(_ZIGZAG)
_SIZES = np.frexp(np.arange(1 << 17))[1].astype(np.int64)


@dataclass
class _Scan:
    """A file's header, its layout, the tail bytes and the pieces of its data between restart markers."""

    header: bytes
    found: dict
    tail: bytes
    pieces: list[bytes]

    @property
    def tables(self) -> list[tuple[Table, Table]]:
        """Of each block in a unit the tables of first and other coefficients."""
        own = [(self.found["dc"][self.found["tables"][i][0]], self.found["ac"][self.found["tables"][i][1]]) for i, _, _ in self.found["parts"]]
        return [pair for pair, (_, h, v) in zip(own, self.found["parts"], strict=True) for _ in range(h * v)]

    def image(self, blocks: np.ndarray, differences: np.ndarray, planes: int = 3) -> Coefficients:
        """The image (or its first planes) of (n, 64) coefficients in the scan's order, the first ones as differences beside them."""
        down, across = _units(self.found)
        places, kinds, back = _order(tuple(self.found["parts"]), down, across)
        each, unit = self.found["restart"] or down * across, len(places) // max(1, down * across)
        values = differences.astype(np.int64)
        for first in range(0, down * across, each):
            own = slice(first * unit, (first + each) * unit)
            for c in range(3):
                spots = np.flatnonzero(kinds[own] == c) + own.start
                values[spots] = np.cumsum(values[spots])
        if values.max(initial=0) > 32767 or values.min(initial=0) < -32768:
            raise Damaged("a coefficient beyond 16 bits")
        blocks[:, 0] = values
        out, first = [], 0
        for _, h, v in self.found["parts"][:planes]:
            size = down * v * across * h
            out.append(blocks[back[first : first + size]].reshape(down * v, across * h, 64))
            first += size
        return Coefficients(self.header, out, self.tail)


def _scan(data: bytes, least: int) -> _Scan:
    if data[:2] != b"\xff\xd8" or data[-2:] != b"\xff\xd9":
        raise Damaged("no start or end of image")
    start = scan_start(data)
    found = _layout(data[:start])
    if len(found["parts"]) != 3 or min(found["height"], found["width"]) < least:
        raise Damaged("one component, or too small")
    tail = data[-4:-2] if data[-4] == 0xFF and data[-3] else b""
    body = data[start : len(data) - 2 - len(tail)]
    return _Scan(data[:start], found, tail, [p.replace(b"\xff\x00", b"\xff") for p in re.split(rb"\xff[\xd0-\xd7]", body)])


def decode(data: bytes, least: int = 64) -> Coefficients:
    """Coefficients of a three-component baseline image of at least ``least`` pixels a side; Damaged otherwise."""
    scan = _scan(data, least)
    down, across = _units(scan.found)
    tables, each = scan.tables, scan.found["restart"] or down * across
    n = down * across * len(tables)
    blocks, differences = np.zeros((n, 64), np.int16), np.zeros(n, np.int64)
    for piece, first in zip(scan.pieces, range(0, down * across, each), strict=True):
        begin = first * len(tables)
        _fill(blocks[begin:], differences[begin:], *_piece(piece, min(n - begin, each * len(tables)), tables))
    return scan.image(blocks, differences)


def _fill(blocks: np.ndarray, differences: np.ndarray, found: list[int], at: list[int], parts: list[bytes]) -> None:
    """Puts what :func:`_piece` found into blocks."""
    differences[: len(found)] = found
    pairs = np.frombuffer(b"".join(parts), "<i2").reshape(-1, 2)
    of = np.repeat(np.array(at, np.int64), np.fromiter(map(len, parts), np.int64, len(parts)) >> 2)
    blocks.reshape(-1)[(of << 6) + _ZIGZAG[pairs[:, 0]]] = pairs[:, 1]


# ---- many files ----


def decoded(contents: Iterable[bytes], least: int = 64, planes: int = 3) -> Iterator[tuple[int, Coefficients | None]]:
    """(number, :func:`decode` of the file, or of its first planes, or None if that cannot be) of all files, in any order.

    Files with the same codes are read side by side, a symbol of each at a time. What
    that does not read (restart intervals, damage) and the rest of files that few
    others are as long as goes through :func:`decode`'s own way.
    """
    waiting: dict[tuple, dict[int, list]] = {}
    size = lambda files: sum(len(data) for _, data, *_ in files)
    held: dict[tuple, int] = {}
    for i, data in enumerate(contents):
        data = bytes(data)
        try:
            scan = _scan(data, least)
            down, across = _units(scan.found)
            unit, n = tuple(scan.tables), down * across * len(scan.tables)
        except UNREADABLE:
            yield i, None
            continue
        if scan.found["restart"] or len(scan.pieces) != 1 or len(data) > GROUP:
            yield i, _decoded(data, least, planes)
            continue
        # files whose lengths differ by a factor of four at most end together
        key = n.bit_length() // 2
        waiting.setdefault(unit, {}).setdefault(key, []).append((i, data, scan, n))
        held[unit, key] = held.get((unit, key), 0) + len(data)
        if held[unit, key] > GROUP:
            held[unit, key] = 0
            yield from _together(waiting[unit].pop(key), unit, least, planes)
    for unit, classes in waiting.items():
        left: list[tuple] = []
        for key in sorted(classes, reverse=True):
            left += classes.pop(key)
            if size(left) > GROUP // 2:
                yield from _together(left, unit, least, planes)
                left = []
        yield from _together(left, unit, least, planes)


def _decoded(data: bytes, least: int, planes: int) -> Coefficients | None:
    try:
        image = decode(data, least)
        image.planes = image.planes[:planes]
        return image
    except UNREADABLE:
        return None


#: An entry of :func:`_steps` where there is no such code.
_NONE = 64 << 9


@lru_cache(4)
def _steps(unit: tuple[tuple[Table, Table], ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(what, value, table): by table + the 16 bits that a symbol begins with what it does (bits it takes, 32 * bits of its value, 512 * places to go on) and its value if these bits hold it; the table by 64 * block of the unit + place."""
    kinds = list(dict.fromkeys((t, first) for pair in unit for t, first in zip(pair, (True, False), strict=True)))
    what, values, windows = np.full((len(kinds), 1 << 16), _NONE, np.int64), np.zeros((len(kinds), 1 << 16), np.int16), np.arange(1 << 16)
    for own, value, (table, first) in zip(what, values, kinds, strict=True):
        for (n, code), symbol in table.codes.items():
            run, size = (0, symbol) if first else divmod(symbol, 16)
            if size <= 15:
                spots = slice(code << (16 - n), (code + 1) << (16 - n))
                own[spots] = n + size | size << 5 | (run + 1 if size or first else 16 if run == 15 else 64) << 9
                if size and n + size <= 16:
                    value[spots] = _extended(windows[spots] >> (16 - n - size), size)
    tables = np.array([[kinds.index((dc, True))] + [kinds.index((ac, False))] * 63 for dc, ac in unit])
    return what.ravel(), values.ravel(), tables.ravel() << 16


def _extended(bits: np.ndarray, size) -> np.ndarray:
    """:func:`extend` of the lowest ``size`` bits, at least one."""
    low = bits & (1 << size) - 1
    return np.where(low >> (size - 1), low, low - (1 << size) + 1)


def _together(files: list[tuple], unit: tuple[tuple[Table, Table], ...], least: int, planes: int) -> Iterator[tuple[int, Coefficients | None]]:
    """:func:`decoded` of (number, data, scan, blocks) that have the same tables and no restarts."""
    if len(files) < LANES:
        for i, data, *_ in files:
            yield i, _decoded(data, least, planes)
        return
    files.sort(key=lambda f: -f[3])
    pieces, ends = [scan.pieces[0] for _, _, scan, _ in files], np.array([f[3] for f in files]) << 6
    sizes = np.array([len(p) for p in pieces]) << 3
    begins = np.cumsum(sizes) - sizes
    octets = np.frombuffer(b"".join(pieces) + b"\xff" * 8 * STEPS, np.uint8)
    ahead = octets[:-2].astype(np.int32)
    for own in (octets[1:-1], octets[2:]):
        ahead <<= 8
        ahead |= own
    what, values, tables = _steps(unit)
    alike = (tables.reshape(-1, 64) == tables[:64]).all()
    lanes, p, pos = np.arange(len(files)), begins.copy(), np.zeros(len(files), np.int64)
    bad, found = np.zeros(len(files), bool), []
    # (block, bit) at which a file goes on that is not read to its end here
    rest: dict[int, tuple[int, int]] = {}
    while len(lanes):
        # bits, places and symbols of all steps
        at, where, name = (np.empty((n, len(lanes)), np.int64) for n in (STEPS + 1, STEPS + 1, STEPS))
        a, e, window = np.empty(len(lanes), np.int64), np.empty(len(lanes), np.int64), np.empty(len(lanes), np.int32)
        at[0], where[0] = p, pos
        for p, after, pos, behind, w in zip(at, at[1:], where, where[1:], name):
            if alike:
                np.bitwise_and(pos, 63, out=a)
            else:
                np.remainder(pos, len(tables), out=a)
            tables.take(a, out=e, mode="clip")
            np.right_shift(p, 3, out=a)
            ahead.take(a, out=window, mode="clip")
            np.bitwise_and(p, 7, out=a)
            np.subtract(8, a, out=a)
            np.right_shift(window, a, out=w)
            np.bitwise_and(w, 0xFFFF, out=w)
            np.add(w, e, out=w)
            what.take(w, out=e, mode="clip")
            np.bitwise_and(e, 31, out=a)
            np.add(p, a, out=after)
            np.right_shift(e, 9, out=e)
            np.add(pos, e, out=behind)
            # no symbol goes beyond its block's end
            np.bitwise_or(pos, 63, out=a)
            np.add(a, 1, out=a)
            np.minimum(behind, a, out=behind)
        p, pos, at, where = at[-1], where[-1], at[:-1], where[:-1]
        entry, value, within = what[name], values[name], where < ends[lanes]
        taken, place = entry & 31, where + (entry >> 9) - 1
        long = np.flatnonzero((taken > 16) & within)
        if len(long):
            bits, n = at.ravel()[long], taken.ravel()[long]
            own = (ahead[bits >> 3].astype(np.int64) << 24 | ahead[(bits >> 3) + 3]) >> (48 - (bits & 7) - n)
            size = entry.ravel()[long] >> 5 & 15
            value.ravel()[long] = np.where(size > 0, _extended(own, np.maximum(size, 1)), 0)
        written = within & (value != 0)
        over = begins[lanes] + sizes[lanes]
        wrong = (within & (entry == _NONE) | written & (place >> 6 != where >> 6)).any(axis=0) | (np.where(within, at + taken, 0).max(axis=0) > over)
        bad[lanes[wrong]] = True
        written[:, wrong] = False
        going = (pos < ends[lanes]) & ~wrong
        last = np.count_nonzero(going) < LANES
        if last:
            for k in np.flatnonzero(going).tolist():
                starts = np.flatnonzero(where[:, k] & 63 == 0)
                if len(starts):
                    rest[int(lanes[k])] = int(where[starts[-1], k]) >> 6, int(at[starts[-1], k] - begins[lanes[k]])
                    written[starts[-1] :, k] = False
                else:
                    bad[lanes[k]] = True
        # file by file
        set_ = written.T.ravel()
        spots = place.T.ravel()[set_]
        found.append((lanes, np.concatenate([[0], np.cumsum(np.count_nonzero(written, axis=0))]), ((spots & ~63) + _ZIGZAG[spots & 63]).astype(np.int32), value.T.ravel()[set_]))
        if last:
            break
        lanes, p, pos = lanes[going], p[going], pos[going]
    begin = 0
    while begin < len(files):
        # some files' blocks at a time
        first = np.cumsum(ends[begin:] >> 6)
        end = begin + max(1, int(np.searchsorted(first, 1 << 18)))
        first = np.concatenate([[0], first[: end - begin]])
        flat = np.zeros(int(first[-1]) << 6, np.int16)
        for lanes, counts, spots, value in found:
            low, high = np.searchsorted(lanes, (begin, end))
            if low < high:
                own = slice(counts[low], counts[high])
                flat[spots[own] + np.repeat(first[lanes[low:high] - begin] << 6, np.diff(counts[low : high + 1]))] = value[own]
        for k in range(begin, end):
            i, data, scan, n = files[k]
            if bad[k]:
                yield i, _decoded(data, least, planes)
                continue
            blocks = flat[int(first[k - begin]) << 6 : int(first[k - begin + 1]) << 6].reshape(-1, 64)
            differences = blocks[:, 0].astype(np.int64)
            try:
                if k in rest:
                    block, bit = rest[k]
                    more, where, parts = _piece(pieces[k], n, unit, bit, block)
                    _fill(blocks, differences, differences[:block].tolist() + more[block:], where, parts)
                yield i, scan.image(blocks, differences, planes)
            except UNREADABLE:
                yield i, None
        begin = end


@lru_cache(4)
def _remembered(unit: tuple[tuple[Table, Table], ...]) -> list[dict[int, tuple]]:
    """For each place in a unit of these tables what its blocks were, by the KEY bits behind the first coefficient.

    An entry has how many bits the block takes, these bits, a mask for them, the (place, value)
    pairs, and how many blocks it is with the zeros behind it that end the unit.
    """
    return [{} for _ in unit]


_MASKS = [(1 << 8 * AHEAD - i) - 1 for i in range(8)]


def _piece(piece: bytes, n: int, unit: list[tuple[Table, Table]], p: int = 0, i: int = 0) -> tuple[list[int], list[int], list[bytes]]:
    """(differences of n first coefficients, blocks with others, these as (place, value) pairs of 16 bits), from block ``i`` at bit ``p`` on; ``unit`` has the tables of a unit's blocks."""
    data, end = piece + b"\xff" * 300, 8 * len(piece)
    ready, width = [(dc, dc.first.get, ac, rest, rest.get) for (dc, ac), rest in zip(unit, _remembered(tuple(unit)), strict=True)], len(unit)
    differences, at, parts = [0] * n, [], []
    mask = (1 << KEY) - 1
    while i < n:
        dc, first, ac, rest, known = ready[i % width]
        left = 8 * AHEAD - (p & 7)
        window = int.from_bytes(data[p >> 3 : (p >> 3) + AHEAD], "big") & _MASKS[p & 7]
        taken, value = first(window >> (left - 20)) or dc.difference(window >> (left - 48))
        if value:
            differences[i] = value
        left -= taken
        p += taken
        name = (window >> (left - KEY)) & mask
        found = known(name)
        if found and (window >> (left - found[0])) & found[2] == found[1]:
            at.append(i)
            parts.append(found[3])
            i += found[4]
            p += found[0]
        else:
            begin = p
            p, pairs = _block(data, p, ac)
            if pairs:
                at.append(i)
                parts.append(pairs)
                # zeros up to the end of the unit are remembered with the block
                stop, blocks = p, 1
                for other, its in unit[i % width + 1 :]:
                    (a, no), (b, ends) = other.zero, its.zero
                    if not a or not b or int.from_bytes(data[stop >> 3 : (stop >> 3) + 8], "big") >> (64 - (stop & 7) - a - b) & (1 << a + b) - 1 != no << b | ends:
                        break
                    stop, blocks = stop + a + b, blocks + 1
                size = stop - begin
                if size <= 8 * AHEAD - 64:
                    if len(rest) >= REMEMBERED:
                        rest.clear()
                    rest[name] = size, (window >> (left - size)) & ((1 << size) - 1), (1 << size) - 1, pairs, blocks
            i += 1
        if p > end:
            raise Damaged("the data end early")
    return differences, at, parts


def _block(data: bytes, p: int, ac: Table) -> tuple[int, bytes]:
    """Where a block that goes on at bit ``p`` ends, and its (place, value) pairs of 16 bits but for the first."""
    k, pairs, left, window, known = 1, [], 0, 0, ac.others
    while k < 64:
        if left < 32:
            left = 8 * AHEAD - (p & 7)
            window = int.from_bytes(data[p >> 3 : (p >> 3) + AHEAD], "big") & _MASKS[p & 7]
        found = known.get(window >> (left - 16) & 0xFFFF)
        if found is None:
            found = ac.other(window >> (left - 32) & 0xFFFFFFFF)
        taken, run, value = found
        if value:
            k += run
            if k > 63:
                raise Damaged("more than 64 coefficients")
            pairs += (k, value)
            k += 1
        else:
            k += run
        p += taken
        left -= taken
    return p, struct.pack(f"<{len(pairs)}h", *pairs)


def encode(image: Coefficients) -> bytes:
    """The file again: the header as it was, coefficients by its own tables and restart interval, and the tail."""
    found = _layout(image.header)
    down, across = _units(found)
    places, kinds, back = _order(tuple(found["parts"]), down, across)
    tables = codes(image.header)
    flat = np.concatenate([p.ravel() for p in image.planes])
    # all that is not zero, by its block in the scan and its place in the block, with its value in the lowest 16 bits
    spots = np.flatnonzero(flat != 0)
    others = np.sort((back[spots >> 6] << 6 | _BACK[spots & 63]) << 16 | (flat[spots].astype(np.int64) & 0xFFFF))
    others = others[others >> 16 & 63 > 0]
    firsts = flat[places << 6].astype(np.int64)
    each, out, unit = found["restart"] or down * across, [image.header], len(places) // max(1, down * across)
    for number, first in enumerate(range(0, down * across, each)):
        begin, end = first * unit, min((first + each) * unit, len(places))
        if number:
            out.append(bytes([0xFF, 0xD0 + (number - 1) % 8]))
        own = others if each >= down * across else others[slice(*np.searchsorted(others, (begin << 22, end << 22)))] - (begin << 22)
        out.append(_bits(*_symbols(firsts[begin:end], own, kinds[begin:end], *tables)).replace(b"\xff", b"\xff\x00"))
    return b"".join([*out, image.tail, b"\xff\xd9"])


@lru_cache(64)
def _codes(tables: tuple[tuple[Table, Table], ...]) -> tuple[np.ndarray, np.ndarray]:
    """(codes, bits) by 512 * component + 256 for those of other coefficients + symbol."""
    return tuple(np.concatenate([getattr(t, name) for pair in tables for t in pair]) for name in ("code", "length"))


def codes(header: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(codes, bits) of a file's symbols, by 512 * component + 256 for those of other coefficients + symbol."""
    found = _layout(header)
    return _codes(tuple((found["dc"][found["tables"][i][0]], found["ac"][found["tables"][i][1]]) for i, _, _ in found["parts"]))


def coded(symbols: np.ndarray, values: np.ndarray, code: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code and value, bits) of values behind symbols without their sizes."""
    size = _SIZES[np.abs(values)]
    return code[symbols + size] << size | values + ((values >> 63) & ((1 << size) - 1)), length[symbols + size] + size


def _symbols(firsts: np.ndarray, others: np.ndarray, kinds: np.ndarray, code: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code and value, bits) of every symbol of blocks, one behind the other."""
    differences, n = firsts.copy(), len(firsts)
    for c in range(int(kinds.max(initial=0)) + 1):
        own = np.flatnonzero(kinds == c)
        differences[own[1:]] -= firsts[own[:-1]]
    of, values = others >> 16, ((others & 0xFFFF) ^ 0x8000) - 0x8000
    blocks, places = of >> 6, of & 63
    gap = np.diff(of, prepend=0)
    fresh = np.diff(blocks, prepend=-1) > 0
    gap[fresh] = places[fresh]
    gap -= 1
    full = gap >> 4
    # a block has its first coefficient's symbol, sixteen zeros as often as they come and one symbol for each other, and an end unless its last place is set
    many = full.any()
    within = np.bincount(blocks, full + 1 if many else None, n).astype(np.int64)
    open_ = np.ones(n, bool)
    open_[blocks[places == 63]] = False
    ended = np.cumsum(open_)
    heads = np.arange(n) + ended - open_ + np.cumsum(within) - within
    spots = blocks + (ended - open_)[blocks] + (np.cumsum(full + 1) if many else np.arange(1, len(blocks) + 1))
    out, bits = np.empty((2, n + int(ended[-1] if n else 0) + int(within.sum())), np.int64)
    base = kinds * 512

    def put(at, symbols, size=0, own=0) -> None:
        n = length[symbols]
        if not n.all():
            raise KeyError("a symbol without a code")
        bits[at], out[at] = n + size, code[symbols] << size | own

    size = _SIZES[np.abs(differences)]
    put(heads, base + size, size, differences + ((differences >> 63) & ((1 << size) - 1)))
    size = _SIZES[np.abs(values)]
    if size.max(initial=0) > 15:
        raise KeyError("a symbol without a code")
    needed = base[blocks] + 256
    put(spots, needed + ((gap & 15) << 4) + size, size, values + ((values >> 63) & ((1 << size) - 1)))
    for j in (1, 2, 3) if many else ():
        more = full >= j
        put(spots[more] - j, needed[more] + 0xF0)
    put((heads + 1 + within)[open_], (base + 256)[open_])
    return out, bits


def _bits(codes: np.ndarray, lengths: np.ndarray) -> bytes:
    """The codes (32 bits at most) one behind the other, the last byte filled up with 1."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    begins = ends - lengths
    if fill := -total % 8:
        codes, lengths, begins = np.append(codes, (1 << fill) - 1), np.append(lengths, fill), np.append(begins, total)
    size = (total + fill) // 32 + 2
    shifted = codes.astype(np.uint64) << (64 - (begins & 31) - lengths).astype(np.uint64)
    word = begins >> 5
    # the parts of a word share no bit and it has 32, so sums of doubles are exact
    words = np.bincount(word, shifted >> np.uint64(32), size) + np.bincount(word + 1, shifted & np.uint64(0xFFFFFFFF), size)
    return words.astype(">u4").tobytes()[: (total + fill) // 8]
