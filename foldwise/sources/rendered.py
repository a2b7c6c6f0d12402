"""Baseline JPEG files from texts: an image collection wherever there is a table of documents."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from foldwise.functions import jpeg
from foldwise.functions.bits import ZIGZAG

#: Blocks in a row, least rows (64 pixels a side), and coefficients set in a block.
COLUMNS, LEAST_ROWS, COEFFICIENTS = 16, 8, 9
#: Characters of texts that are rendered together.
AT_ONCE = 1 << 19


def blocks(words: list[str]) -> np.ndarray:
    """Each word's first coefficients in zigzag order, from the bytes of its MD5: the first from -128 to 127, the others from -4 to 3."""
    digests = np.frombuffer(b"".join([hashlib.md5(word.encode()).digest()[:COEFFICIENTS] for word in words]), np.uint8).reshape(-1, COEFFICIENTS).astype(np.int16)
    return np.concatenate([digests[:, :1] - 128, digests[:, 1:] // 32 - 4], axis=1)


@lru_cache(256)
def header(rows: int) -> bytes:
    """Tables, frame and scan of a three-component image: all codes have 4 bits (first coefficients) or 8 (others)."""

    def segment(kind: int, body: bytes) -> bytes:
        return bytes([0xFF, kind]) + struct.pack(">H", len(body) + 2) + body

    symbols = [0, 0xF0, *(run << 4 | size for run in range(16) for size in range(1, 11))]
    tables = segment(0xC4, bytes([0, 0, 0, 0, 12, *[0] * 12, *range(12)])) + segment(0xC4, bytes([0x10, *[0] * 7, len(symbols), *[0] * 8, *symbols]))
    frame = struct.pack(">BHHB", 8, rows * 8, COLUMNS * 8, 3) + b"".join(bytes([i, 0x11, 0]) for i in (1, 2, 3))
    scan = bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0])
    return b"\xff\xd8" + segment(0xDB, bytes([0, *[1] * 64])) + segment(0xC0, frame) + tables + segment(0xDA, scan)


def image(text: str) -> bytes:
    """Each word is a block of the first plane, row by row; the other planes are zero."""
    return made([text])[0]


def made(texts: list[str]) -> list[bytes]:
    """:func:`image` of many texts: a word that comes often is coded once, but for its first coefficient's difference."""
    split = [t.replace("\n", " ").split(" ") for t in texts]
    kinds = dict.fromkeys(chain.from_iterable(split))
    # the blocks behind the last word are of kind 0, all zero
    coefficients = np.concatenate([np.zeros((1, COEFFICIENTS), np.int64), blocks(list(kinds)).astype(np.int64)])
    kinds = dict(zip(kinds, range(1, len(kinds) + 1), strict=True))
    counts = np.array([len(w) for w in split])
    rows = np.maximum(LEAST_ROWS, -(-counts // COLUMNS))
    ends = np.cumsum(rows * COLUMNS)
    begins = ends - rows * COLUMNS
    own = np.zeros(int(ends[-1]), np.int64)
    own[np.arange(int(counts.sum())) + np.repeat(begins - np.cumsum(counts) + counts, counts)] = np.fromiter(map(kinds.__getitem__, chain.from_iterable(split)), np.int64)
    code, length = jpeg.codes(header(LEAST_ROWS))
    parts, sizes = _others(coefficients, code, length)
    firsts = coefficients[own, 0]
    differences = np.diff(firsts, prepend=0)
    differences[begins] = firsts[begins]
    first, n = jpeg.coded(np.zeros(len(own), np.int64), differences, code, length)
    # a text begins with a word of 32 bits
    bits = np.cumsum(n + sizes[own])
    before = bits - n - sizes[own]
    totals = bits[ends - 1] - before[begins]
    starts = np.cumsum(totals + 63 >> 5) - (totals + 63 >> 5)
    at = before + np.repeat((starts << 5) - before[begins], rows * COLUMNS)
    out = np.zeros(int(starts[-1] + (totals[-1] + 63 >> 5)) + 8, np.uint64)

    def put(values: np.ndarray, at: np.ndarray) -> None:
        # of 32 bits, from a bit on; two blocks of a file, and so two of their parts, never begin in the same word
        shifted = values.astype(np.uint64) << (32 - (at & 31)).astype(np.uint64)
        out[at >> 5] |= shifted >> np.uint64(32)
        out[(at >> 5) + 1] |= shifted & np.uint64(0xFFFFFFFF)

    put(first << (32 - n), at)
    for i in range(parts.shape[1]):
        put(parts[own, i], at + n + 32 * i)
    fill = -totals % 8
    put(((1 << fill) - 1) << (32 - fill), (starts << 5) + totals)
    data = out.astype(">u4").tobytes()
    return [header(r) + data[4 * s : 4 * s + (t + 7 >> 3)].replace(b"\xff", b"\xff\x00") + b"\xff\xd9" for r, s, t in zip(rows.tolist(), starts.tolist(), totals.tolist(), strict=True)]


def _others(coefficients: np.ndarray, code: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words of 32 bits, bits) of what follows the first coefficient of each kind of block: the others, its end, and the zero blocks of the other planes."""
    kinds = np.arange(len(coefficients))
    out, at, run = np.zeros((len(kinds), 6), np.uint64), np.zeros(len(kinds), np.int64), np.zeros(len(kinds), np.int64)

    def put(own: np.ndarray, values: np.ndarray, n: np.ndarray) -> None:
        shifted = values.astype(np.uint64) << (64 - (at[own] & 31) - n).astype(np.uint64)
        out[own, at[own] >> 5] |= shifted >> np.uint64(32)
        out[own, (at[own] >> 5) + 1] |= shifted & np.uint64(0xFFFFFFFF)
        at[own] += n

    for column in coefficients.T[1:]:
        own = np.flatnonzero(column)
        put(own, *jpeg.coded(256 + (run[own] << 4), column[own], code, length))
        run += 1
        run[own] = 0
    for symbol in (256, 512, 768, 1024, 1280):
        put(kinds, np.full(len(kinds), code[symbol]), np.full(len(kinds), length[symbol]))
    return out[:, : int(at.max() + 31 >> 5)], at


def files(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """path, dir, length, content of documents (doc_id, source, text), some texts at a time: a file for each, empty for a null text."""
    for batch in batches:
        sizes = batch["text"].str.len().fillna(0).to_numpy()
        for _, own in batch.groupby((np.cumsum(sizes) // AT_ONCE).astype(np.int64)):
            there = own["text"].notna().to_numpy()
            contents = np.full(len(own), b"", object)
            if there.any():
                contents[there] = made(own["text"][there].to_list())
            folders = own["source"].fillna("none")
            paths = [f"{d}/{i}.jpg" for d, i in zip(folders, own["doc_id"], strict=True)]
            yield pd.DataFrame({"path": paths, "dir": folders.to_numpy(), "length": [len(x) for x in contents], "content": contents})


def images(docs: DataFrame) -> DataFrame:
    """path, dir, length, content of documents (doc_id, source, text): a file for each, empty for a null text."""

    return docs.select("doc_id", "source", "text").mapInPandas(files, "path string, dir string, length long, content binary")
