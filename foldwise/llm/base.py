"""What the training-data operators share: table access, frozen tables, and byte kernels.

The kernels work on Arrow's own text buffers (one ``uint8`` array for a slice of
rows plus row offsets), so no Python string is made for a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwise.plans.freeze import frozen

SLICE_BYTES = 2 << 20

WORD = r"[^\x20\x09-\x0D]+"
#: Java asks a class of single characters one bit set, but walks over the ranges of a class: a tenth of the time.
ALNUM_WORD = "[^" + "".join(f"\\x{c:02X}" for c in range(128) if not chr(c).isalnum()) + "]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``frozen``, after which the shuffles that led to it are deleted: nothing reads them again."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key)
    conf.set(key, "true")
    try:
        return frozen(df, name)
    finally:
        conf.set(key, before)


def lower_ascii(column):
    return F.translate(column, UPPER, LOWER)


def splitmix(seed: int, n: int) -> np.ndarray:
    """n pseudo-random uint64 values from a counter."""
    with np.errstate(over="ignore"):
        z = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)
        return mixed(z)


def mixed(z: np.ndarray) -> np.ndarray:
    """A bijection of uint64 that spreads every input bit."""
    with np.errstate(over="ignore"):
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def _folding() -> np.ndarray:
    fold = np.arange(256, dtype=np.uint8)
    fold[65:91] += 32
    return fold


FOLD = _folding()
_codes = np.arange(256)
#: Bytes of words that white space ends, and of words of letters, digits and all beyond ASCII.
SPACED = ~np.isin(_codes, [0x20, 9, 10, 11, 12, 13])
ALNUM = ((_codes >= 0x30) & (_codes <= 0x39)) | ((FOLD >= 0x61) & (FOLD <= 0x7A)) | (_codes >= 0x80)

_BYTE_VALUES = splitmix(0x5EED, 256)
_P = 0x9E6C63D0876A3F6B | 1
_P_INVERSE = pow(_P, -1, 1 << 64)
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of an odd multiplier and of its inverse, modulo 2**64, for n places."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]) if _powers else SLICE_BYTES // 2)
        made = []
        for base in (_P, _P_INVERSE):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            with np.errstate(over="ignore"):
                made.append(np.cumprod(steps, dtype=np.uint64))
        _powers[:] = made
    return _powers


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string array; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Sub-batches of about ``limit`` bytes of text (always whole rows), with their bytes and offsets."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offsets = text_buffers(batch.column(batch.schema.get_field_index(text)))
        first = 0
        while first < batch.num_rows:
            last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
            last = min(max(last, first + 1), batch.num_rows)
            yield batch.slice(first, last - first), data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
            first = last


def word_spans(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in all rows, and per row the number of the first word (one more at the end)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = kind[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | edge[1:n]
    ends = inside
    following = ~inside[1:] | edge[1:n]
    ends = inside.copy()
    ends[:-1] &= following
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, with A-Z as a-z."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    values = _BYTE_VALUES[FOLD].copy()
    values[~kind] = 0
    powers, inverses = _power_tables(len(data))
    with np.errstate(over="ignore"):
        sums = np.add.reduceat(values[data] * powers[: len(data)], starts)
        return mixed(sums * inverses[starts])


def hash_word(word: str, kind: np.ndarray = SPACED) -> int:
    data = np.frombuffer(word.encode(), dtype=np.uint8)
    return int(word_hashes(data, np.zeros(1, np.int64), kind)[0])


def rolling(hashes: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each run of k values; the caller leaves out runs that cross rows."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.zeros(n, np.uint64)
        for i, factor in enumerate(splitmix(0xA11CE, k) | np.uint64(1)):
            out += hashes[i : i + n] * factor
        return mixed(out)
