"""Progressive JPEG media columns: a decoder into full-resolution RGB tensors, and a lossless store of bytes as coefficients."""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwise.functions.bits import ZIGZAG, BitReader, Damaged, extend, huffman
from foldwise.llm.base import slices

BLOCK = 64
#: Natural index (8 * row + column) of each zigzag place.
_NATURAL = np.array(ZIGZAG)


def _transform() -> np.ndarray:
    """Coefficients in zigzag order to samples, scaled by 2**26; whole numbers, so float64 products are exact in any order."""
    k = np.arange(8)
    basis = np.cos((2 * k[None, :] + 1) * k[:, None] * np.pi / 16) / 2
    basis[0] /= np.sqrt(2)
    basis = np.round(basis * 8192)
    return np.kron(basis, basis)[_NATURAL]


_INVERSE = _transform()
#: Blocks of a minimum coded unit of the store: four of luma, one of each chroma.
_UNIT = 6


# ---- scans ----


def _dc_scan(bits: BitReader, plane_of, order, codes, high: int, low: int) -> None:
    """DC of interleaved or single components: differences first, then one bit a block."""
    before: dict[int, int] = {}
    for c, at in order:
        if high:
            if bits.take(1):
                plane_of[c][at, 0] |= 1 << low
        else:
            size = bits.symbol(codes[c])
            before[c] = before.get(c, 0) + extend(bits.take(size), size)
            plane_of[c][at, 0] = before[c] << low


def _ac_first(bits: BitReader, plane: np.ndarray, blocks, codes, begin: int, end: int, low: int) -> None:
    run = 0
    for at in blocks:
        if run:
            run -= 1
            continue
        k = begin
        while k <= end:
            skip, size = divmod(bits.symbol(codes), 16)
            if size:
                k += skip
                if k > end:
                    raise Damaged("a run leaves its band")
                plane[at, k] = extend(bits.take(size), size) * (1 << low)
                k += 1
            elif skip == 15:
                k += 16
            else:
                run = (1 << skip) + bits.take(skip) - 1
                break


def _ac_refine(bits: BitReader, plane: np.ndarray, blocks, codes, begin: int, end: int, low: int) -> None:
    run, bit = 0, 1 << low

    def correct(at: int, k: int) -> None:
        if bits.take(1):
            plane[at, k] += bit if plane[at, k] > 0 else -bit

    for at in blocks:
        k = begin
        while not run and k <= end:
            skip, size = divmod(bits.symbol(codes), 16)
            if not size and skip < 15:
                run = (1 << skip) + bits.take(skip)
                break
            fresh = (bit if bits.take(1) else -bit) if size else 0
            while k <= end:
                if plane[at, k]:
                    correct(at, k)
                elif skip:
                    skip -= 1
                else:
                    plane[at, k] = fresh
                    k += 1
                    break
                k += 1
        if run:
            for j in range(k, end + 1):
                if plane[at, j]:
                    correct(at, j)
            run -= 1


def _packed_dc(data: bytes, count: int, codes: dict, refine: bool) -> np.ndarray | None:
    """The bits of a DC scan that has one bit a block: a refinement, or a first scan whose differences are all 0 by the code 0."""
    bits = np.unpackbits(np.frombuffer(data, np.uint8), count=min(count, 8 * len(data)))
    if len(bits) < count or not refine and (codes.get("0") != 0 or bits.any()):
        return None
    return bits


def _packed_first(data: bytes, blocks: int, width: int, codes: dict, low: int) -> np.ndarray | None:
    """Values of a first AC scan if each coefficient is the code 0 and seven bits, one byte each."""
    if codes.get("0") != 7 or len(data) < blocks * width:
        return None
    values = np.frombuffer(data, np.uint8, blocks * width).astype(np.int32)
    if (values > 127).any():
        return None
    return (np.where(values >= 64, values, values - 127) << low).reshape(blocks, width)


def _packed_refine(data: bytes, plane: np.ndarray, codes: dict, begin: int, end: int, low: int) -> bool:
    """A refinement in which every coefficient of the band is already there: end-of-band runs and one bit each."""
    band = plane[:, begin : end + 1]
    if not band.all():
        return False
    bits, at, block = np.unpackbits(np.frombuffer(data, np.uint8)), 0, 0
    added = np.zeros(band.shape, np.int32)
    while block < len(band):
        head = "".join(map(str, bits[at : at + 32].tolist()))
        found = None
        for n in range(1, 17):
            if (found := codes.get(head[:n])) is not None:
                break
        if found is None or found & 15 or found >> 4 == 15:
            return False
        size = found >> 4
        run = (1 << size) + int(head[n : n + size] or "0", 2)
        at += n + size
        take = run * band.shape[1]
        if block + run > len(band) or at + take > len(bits):
            return False
        added[block : block + run] = bits[at : at + take].reshape(run, -1)
        at, block = at + take, block + run
    plane[:, begin : end + 1] = band + np.where(band > 0, added, -added) * (1 << low)
    return True


class Frame:
    """Coefficient planes of an image: (blocks, 64) in zigzag order for each component."""

    def __init__(self, height: int, width: int, parts: list[tuple[int, int, int, int]]):
        self.height, self.width, self.parts = height, width, parts
        self.most_h, self.most_v = max(p[1] for p in parts), max(p[2] for p in parts)
        self.units_x, self.units_y = -(-width // (8 * self.most_h)), -(-height // (8 * self.most_v))
        self.planes, self.strides, self.own = [], [], []
        self._rasters: dict[int, np.ndarray] = {}
        self._orders: dict[tuple[int, ...], list] = {}
        for _, h, v, _ in parts:
            self.strides.append(self.units_x * h)
            self.own.append((-(-(-(-height * v // self.most_v)) // 8), -(-(-(-width * h // self.most_h)) // 8)))
            self.planes.append(np.zeros((self.units_x * h * self.units_y * v, BLOCK), np.int32))

    def raster(self, c: int) -> np.ndarray:
        if c not in self._rasters:
            rows, columns = self.own[c]
            self._rasters[c] = (np.arange(rows)[:, None] * self.strides[c] + np.arange(columns)).ravel()
        return self._rasters[c]

    def interleaved(self, which: list[int]) -> list[tuple[int, np.ndarray]]:
        """For each block of a unit its component and, unit by unit, its place in the plane."""
        if (key := tuple(which)) in self._orders:
            return self._orders[key]
        y, x = np.divmod(np.arange(self.units_x * self.units_y), self.units_x)
        self._orders[key] = [(c, (y * self.parts[c][2] + j) * self.strides[c] + x * self.parts[c][1] + i) for c in which for j in range(self.parts[c][2]) for i in range(self.parts[c][1])]
        return self._orders[key]


_MARKER = re.compile(rb"\xff[^\x00\xff\xd0-\xd7]")


def coefficients(data: bytes) -> tuple[Frame, dict[int, np.ndarray], bytes]:
    """(frame, quantisation tables, comment): all scans accumulated into coefficient planes."""
    if data[:2] != b"\xff\xd8":
        raise Damaged("no start of image")
    at, frame, quant, tables, comment, restart = 2, None, {}, {}, b"", 0
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise Damaged("no marker")
        kind = data[at + 1]
        if kind == 0xD9:
            break
        size = struct.unpack(">H", data[at + 2 : at + 4])[0]
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if kind == 0xDB:
            while body:
                wide = body[0] >> 4
                quant[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8).astype(np.int32)
                body = body[65 + 64 * wide :]
        elif kind == 0xC2:
            _, height, width, n = struct.unpack(">BHHB", body[:6])
            frame = Frame(height, width, [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)])
        elif 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            raise Damaged("not a progressive image")
        elif kind == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0] >> 4, body[0] & 15] = huffman(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif kind == 0xDD:
            restart = struct.unpack(">H", body[:2])[0]
        elif kind == 0xFE:
            comment = body
        elif kind == 0xDA:
            if frame is None:
                raise Damaged("a scan before the frame")
            end = found.start() if (found := _MARKER.search(data, at)) else len(data)
            _scan(frame, tables, body, data[at:end], restart)
            at = end
    if frame is None:
        raise Damaged("no frame")
    return frame, quant, comment


def _scan(frame: Frame, tables: dict, body: bytes, data: bytes, restart: int) -> None:
    ids = [p[0] for p in frame.parts]
    which = [ids.index(body[1 + 2 * i]) for i in range(body[0])]
    selected = {c: body[2 + 2 * i] for i, c in enumerate(which)}
    begin, end, steps = body[1 + 2 * body[0] : 4 + 2 * body[0]]
    high, low = steps >> 4, steps & 15
    pieces = [p.replace(b"\xff\x00", b"\xff") for p in re.split(rb"\xff[\xd0-\xd7]", data)] if restart else [data.replace(b"\xff\x00", b"\xff")]
    if begin == 0:
        codes = {c: tables.get((0, t >> 4), {}) for c, t in selected.items()}
        parts = frame.interleaved(which) if len(which) > 1 else [(which[0], frame.raster(which[0]))]
        units = len(parts[0][1])
        if not restart:
            single = {} if high else next(iter(codes.values()))
            same = high or all(x == single for x in codes.values())
            bits = _packed_dc(pieces[0], units * len(parts), single, bool(high)) if same else None
            if bits is not None:
                if bits.any():
                    for i, (c, at) in enumerate(parts):
                        frame.planes[c][at, 0] |= bits[i :: len(parts)].astype(np.int32) << low
                return
        for piece, first in zip(pieces, range(0, units, restart or units), strict=False):
            order = ((c, int(at[u])) for u in range(first, min(units, first + (restart or units))) for c, at in parts)
            _dc_scan(BitReader(piece), frame.planes, order, codes, high, low)
        return
    c = which[0]
    codes, blocks, plane = tables.get((1, selected[c] & 15), {}), frame.raster(c), frame.planes[c]
    if not restart and len(blocks) == len(plane):
        if high and _packed_refine(pieces[0], plane, codes, begin, end, low):
            return
        if not high and (values := _packed_first(pieces[0], len(plane), end - begin + 1, codes, low)) is not None:
            plane[:, begin : end + 1] = values
            return
    for piece, first in zip(pieces, range(0, len(blocks), restart or len(blocks)), strict=False):
        (_ac_refine if high else _ac_first)(BitReader(piece), plane, blocks[first : first + (restart or len(blocks))].tolist(), codes, begin, end, low)


# ---- pixels ----


def rgb(frame: Frame, quant: dict[int, np.ndarray]) -> np.ndarray:
    """(height, width, 3) uint8: inverse transform, chroma repeated to full resolution, YCbCr to RGB in whole numbers."""
    full = []
    for c, (_, h, v, q) in enumerate(frame.parts):
        samples = np.floor(((frame.planes[c] * quant[q]).astype(np.float64) @ _INVERSE) / (1 << 26) + 128.5)
        samples = np.clip(samples, 0, 255).astype(np.uint8)
        rows, columns = len(frame.planes[c]) // frame.strides[c], frame.strides[c]
        plane = samples.reshape(rows, columns, 8, 8).swapaxes(1, 2).reshape(rows * 8, columns * 8)
        up_v, up_h = frame.most_v // v, frame.most_h // h
        if up_v > 1:
            plane = np.repeat(plane, up_v, axis=0)
        if up_h > 1:
            plane = np.repeat(plane, up_h, axis=1)
        full.append(plane[: frame.height, : frame.width])
    if len(full) == 1:
        return np.repeat(full[0][:, :, None], 3, axis=2)
    y, cb, cr = full[0].astype(np.int32), full[1].astype(np.int32) - 128, full[2].astype(np.int32) - 128
    out = np.empty((*y.shape, 3), np.uint8)
    y <<= 16
    y += 1 << 15
    # 1.402, 0.344136, 0.714136 and 1.772 times 2**16
    for i, plane in enumerate((y + 91881 * cr, y - 22554 * cb - 46802 * cr, y + 116130 * cb)):
        out[:, :, i] = np.clip(plane >> 16, 0, 255)
    return out


# ---- the store ----


def _segment(kind: int, body: bytes) -> bytes:
    return bytes([0xFF, kind]) + struct.pack(">H", len(body) + 2) + body


def _table(kind: int, number: int, counts: list[int], symbols: list[int]) -> bytes:
    return _segment(0xC4, bytes([kind << 4 | number, *counts, *[0] * (16 - len(counts)), *symbols]))


#: DC: category 0 is the code 0. AC 0: (run 0, size 7) is the code 0. AC 1: the end-of-band runs have four bits each.
_TABLES = _table(0, 0, [1], [0]) + _table(1, 0, [1], [7]) + _table(1, 1, [0, 0, 0, 15], [n << 4 for n in range(15)])
_QUANT = _segment(0xDB, bytes([0, *[1] * 64]))
_LONGEST_RUN = 32767


def _scan_head(parts: list[int], table: int, begin: int, end: int, high: int, low: int) -> bytes:
    return _segment(0xDA, bytes([len(parts), *[x for p in parts for x in (p, table)], begin, end, high << 4 | low]))


def _entropy(bits: np.ndarray) -> bytes:
    pad = -len(bits) % 8
    return np.packbits(np.concatenate([bits, np.ones(pad, np.uint8)]) if pad else bits).tobytes().replace(b"\xff", b"\xff\x00")


def store(payload: bytes) -> bytes:
    """A progressive JPEG whose coefficients are the payload's bytes (a multiple of 64), one block for each 64.

    The DC coefficient is the block's first byte, sent as eight refinement scans.
    The others have magnitude 128 + (byte & 127) and the byte's top bit as sign, so
    each is significant from the first scan on (seven bits of it) and the last scan
    adds one bit each. Scans are spectral bands and bit planes as in any progressive
    image, and any progressive decoder reads them.
    """
    n = len(payload) // BLOCK
    units = -(-n // _UNIT)
    across = int(np.ceil(np.sqrt(units)))
    down = -(-units // across)
    units = across * down
    blocks = np.zeros((units * _UNIT, BLOCK), np.uint8)
    blocks.reshape(-1)[: len(payload)] = np.frombuffer(payload, np.uint8)
    luma, blue, red = blocks[: 4 * units], blocks[4 * units : 5 * units], blocks[5 * units :]
    out = [b"\xff\xd8", _segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0"), _segment(0xFE, struct.pack(">Q", len(payload))), _QUANT]
    out.append(_segment(0xC2, struct.pack(">BHHB", 8, down * 16, across * 16, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])))
    out.append(_TABLES)
    grid = luma[:, 0].reshape(down, 2, across, 2).transpose(0, 2, 1, 3).reshape(-1, 4)
    dc = np.concatenate([grid, blue[:, :1], red[:, :1]], axis=1).ravel()
    out += [_scan_head([1, 2, 3], 0, 0, 0, 0, 8), _entropy(np.zeros(len(dc), np.uint8))]
    # first AC scans: the top seven of eight magnitude bits, complemented where negative
    top, negative = 64 | (blocks & 127) >> 1, blocks >= 128
    coded = np.where(negative, 127 - top, top).astype(np.uint8)
    for part, begin, end, own in ((1, 1, 5, slice(0, 4 * units)), (1, 6, 63, slice(0, 4 * units)), (2, 1, 63, slice(4 * units, 5 * units)), (3, 1, 63, slice(5 * units, None))):
        out += [_scan_head([part], 0, begin, end, 0, 1), coded[own, begin : end + 1].tobytes()]
    for bit in range(7, -1, -1):
        out += [_scan_head([1, 2, 3], 0, 0, 0, bit + 1, bit), _entropy(dc >> bit & 1)]
    for part, own in ((1, luma), (2, blue), (3, red)):
        pieces = []
        for first in range(0, len(own), _LONGEST_RUN):
            rows = own[first : first + _LONGEST_RUN, 1:]
            size = len(rows).bit_length() - 1
            head = f"{size:04b}" + (f"{len(rows) - (1 << size):0{size}b}" if size else "")
            pieces += [np.array([int(b) for b in head], np.uint8), (rows & 1).ravel()]
        out += [_scan_head([part], 1, 1, 63, 1, 0), _entropy(np.concatenate(pieces))]
    return b"".join([*out, b"\xff\xd9"])


def restore(frame: Frame, comment: bytes) -> bytes:
    """The payload that :func:`store` put into the coefficients."""
    planes = np.concatenate(frame.planes)
    out = (np.abs(planes) - 128 | (planes < 0) * 128).astype(np.uint8)
    out[:, 0] = planes[:, 0]
    return out.tobytes()[: struct.unpack(">Q", comment)[0]]


def padded(data: bytes) -> bytes:
    return data + bytes(-len(data) % BLOCK or (0 if data else BLOCK))


# ---- columns ----


def to_media(docs: DataFrame) -> DataFrame:
    """``docs`` (text, ...) with n_bytes and media instead of text.

    Null and empty texts are stored as 64 zero bytes; a very long text is one image;
    equal texts have equal media, rows appear as often as they came; an empty table
    gives an empty result; columns named n_bytes or media are replaced.
    """
    keep = [c for c in docs.columns if c not in ("text", "n_bytes", "media")]
    rows = docs.select(*keep, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in slices(batches):
            text = data.tobytes()
            media = [store(padded(text[b:e])) for b, e in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.diff(offsets), pa.int64()), pa.array(media, pa.binary())], names=[*keep, "n_bytes", "media"])

    return rows.mapInArrow(run, docs.select(*keep, F.lit(0).cast("long").alias("n_bytes"), F.lit(b"").alias("media")).schema)


def decoded(media: DataFrame, tensors: bool = True) -> DataFrame:
    """``media`` (media binary, ...) with height, width, payload digests and the RGB tensor's digest, and the tensor itself.

    Adds height, width, payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256, feature (size, mean colour in thousandths and CRC of the tensor), error
    and, with ``tensors``, rgb (height * width * 3 bytes). Undecodable or null media
    have an error and nulls. Images without a stored payload have null payload columns.
    Equal media have equal results, rows appear as often as they came; an image of
    any size is one row; an empty table gives an empty result; columns with the
    added names are replaced.
    """
    added = "height int, width int, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string"
    names = [x.split(" ")[0] for x in added.split(", ")] + ["rgb"] * tensors
    keep = [c for c in media.columns if c not in (*names, "media")]
    rows = media.select(*keep, "media")

    def one(data: bytes | None) -> list:
        if data is None:
            return [None] * 8 + ["null"] + [None] * tensors
        try:
            frame, quant, comment = coefficients(data)
            pixels = rgb(frame, quant)
            payload = restore(frame, comment) if len(comment) == 8 else None
        except (Damaged, IndexError, KeyError, ValueError, struct.error) as error:
            return [None] * 5 + [len(data), hashlib.sha256(data).hexdigest(), None, str(error)[:200]] + [None] * tensors
        raw = pixels.tobytes()
        mean = [int(x) * 1000 // max(1, pixels.shape[0] * pixels.shape[1]) for x in pixels.reshape(-1, 3).sum(axis=0, dtype=np.int64)]
        feature = f"{frame.width}x{frame.height}:{mean[0]},{mean[1]},{mean[2]}:{zlib.crc32(raw):08x}"
        own = [len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:])] if payload is not None else [None] * 3
        return [frame.height, frame.width, *own, len(data), hashlib.sha256(data).hexdigest(), feature, None] + [raw] * tensors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()] + [pa.binary()] * tensors
        step = 64 if tensors else 1024
        for batch in batches:
            for first in range(0, batch.num_rows, step):
                part = batch.slice(first, step)
                made = [one(x.as_py()) for x in part.column(len(keep))]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *[pa.array([m[i] for m in made], k) for i, k in enumerate(kinds)]], names=[*keep, *names])

    empty = media.sparkSession.createDataFrame([], added + ", rgb binary" * tensors)
    return rows.mapInArrow(run, type(rows.schema)(media.select(*keep).schema.fields + empty.schema.fields))
