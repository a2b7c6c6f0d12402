"""Sliding-window max-hash sketches: in SQL over words, and exact 64-bit ones over coefficients."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwise.config import DedupConfig
from foldwise.functions.hashes import GEAR, gear, gear_blocks, rabin
from foldwise.sources.records import hash28, let, lines, words

SLOTS, PRIME = 10, 2147483647
WINDOW = 4


def slot(k: int) -> tuple[int, int]:
    """Multiplier and addend of a slot, below 2**31, from a rule."""
    return (1103515245 * (2 * k + 1) + 12345) % PRIME, (69069 * (k + 1) + 1) % PRIME


def slot_value(x, place, k: int):
    """(a x + b) mod p on top, the window's number below turned round: the greatest such number is the slot's value at its first window."""
    a, b = slot(k)
    return F.shiftleft((x * a + b) % PRIME, 32) + (0xFFFFFFFF - place)


def position(y, x):
    """Line and word as one number of 64 bits."""
    return F.shiftleft(y.cast("long"), 32) + x


def _packed(h):
    return h.bitwiseAND(127)


def windows_1d(text):
    """Windows of four words of a line: 7 hash bits of each, and the position of the first word."""

    def of_line(line, y):
        def of_hashes(hs):
            at = F.when(F.size(hs) >= WINDOW, F.sequence(F.lit(0), F.size(hs) - WINDOW)).otherwise(F.expr("cast(array() as array<int>)"))
            x = lambda i: sum((_packed(F.get(hs, i + j)) * (1 << (7 * (WINDOW - 1 - j))) for j in range(1, WINDOW)), _packed(F.get(hs, i)) * (1 << 21))
            return F.transform(at, lambda i: F.struct(x(i).alias("x"), position(y, i).alias("pos")))

        return let(F.transform(words(line), hash28), of_hashes)

    return F.flatten(F.transform(lines(text), of_line))


def windows_2d(text):
    """Windows of 2 x 2 words over two lines, column by column."""

    def of_rows(rows):
        def pair(y):
            def of_two(two):
                width = F.least(F.size(F.get(two, 0)), F.size(F.get(two, 1)))
                at = F.when(width >= 2, F.sequence(F.lit(0), width - 2)).otherwise(F.expr("cast(array() as array<int>)"))
                h = lambda r, i: _packed(F.get(F.get(two, r), i))
                return F.transform(at, lambda i: F.struct((h(0, i) * (1 << 21) + h(1, i) * (1 << 14) + h(0, i + 1) * (1 << 7) + h(1, i + 1)).alias("x"), position(y, i).alias("pos")))

            return let(F.array(F.get(rows, y), F.get(rows, y + 1)), of_two)

        at = F.when(F.size(rows) >= 2, F.sequence(F.lit(0), F.size(rows) - 2)).otherwise(F.expr("cast(array() as array<int>)"))
        return F.flatten(F.transform(at, pair))

    return let(F.transform(lines(text), lambda line: F.transform(words(line), hash28)), of_rows)


def sketches(docs: DataFrame, windows=windows_1d) -> DataFrame:
    """(id, slots): (sf, pos) of each slot of each document that has a window, and batch if ``docs`` has it.

    The maxima are plain aggregates over generated windows, all in one generated
    loop; a document's windows meet in the task that reads it, so what is shuffled
    is one row of SLOTS pairs a document.
    """
    key = ["id", "batch"] if "batch" in docs.columns else ["id"]
    rows = docs.withColumn("id", F.col("doc_id")).select(*key, F.posexplode(windows(F.col("text"))).alias("place", "w")).select(*key, "place", F.col("w.x").alias("x"), F.col("w.pos").alias("pos"))
    values = [slot_value(F.col("x"), F.col("place"), k) for k in range(SLOTS)]
    best = rows.groupBy(*key).agg(*[F.max(v).alias(f"v{k}") for k, v in enumerate(values)], *[F.max_by("pos", v).alias(f"p{k}") for k, v in enumerate(values)])
    return best.select(*key, F.array(*[F.struct(F.shiftright(f"v{k}", 32).alias("sf"), F.col(f"p{k}").alias("pos")) for k in range(SLOTS)]).alias("slots"))


def exploded(sketched: DataFrame) -> DataFrame:
    """(id, k, sf, pos): one row a slot."""
    key = [c for c in sketched.columns if c != "slots"]
    return sketched.select(*key, F.posexplode("slots").alias("k", "v")).select(*key, "k", "v.sf", "v.pos")


def super_features(slots: DataFrame, per: int = 2) -> DataFrame:
    """(id, k, sf): sums of ``per`` consecutive slots."""
    return slots.groupBy("id", F.floor(F.col("k") / per).cast("int").alias("k")).agg(F.sum("sf").alias("sf"))


# ---- exact sketches of coefficient planes ----


def multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd 64-bit multipliers and addends of n features, from a counter."""
    with np.errstate(over="ignore"):
        z = np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95) + np.uint64(1)
        z = (z ^ (z >> np.uint64(32))) * np.uint64(0xDABA0B6EB09322E3)
        z = z ^ (z >> np.uint64(32))
    return z[:n] | np.uint64(1), z[n:]


def bitmap(plane: np.ndarray, block_size: int, uniform: bool = False) -> np.ndarray:
    """Per block the low bits of its lowest (8 / block_size)**2 coefficients, or of coefficients spread over all 64."""
    step = 8 // block_size
    if uniform:
        every = max(1, block_size * block_size)
        own = plane[:, :, ::every]
    else:
        own = plane.reshape(*plane.shape[:2], 8, 8)[:, :, :step, :step].reshape(*plane.shape[:2], step * step)
    out = np.zeros(plane.shape[:2], np.uint64)
    for i in range(own.shape[2]):
        out = (out << np.uint64(1)) | (own[:, :, i] & 1).astype(np.uint64)
    return out


def exact_sketch(planes: list[np.ndarray], raw: bytes, config: DedupConfig) -> dict:
    """sf, pos and dc of each super-feature: sums of maxima of (k x + b) mod 2**64 over all windows."""
    n = config.features
    a, b = multipliers(n)
    luma = planes[0]
    pos = dc = None
    if config.feature_method == "2df":
        bits, size, width = bitmap(luma, config.block_size, config.uniform_sample), config.block_size, np.uint64(64 // config.block_size**2)
        rows, columns = bits.shape
        parts = []
        if config.dimension == 2 and rows >= size and columns >= size:
            x = np.zeros((rows - size + 1, columns - size + 1), np.uint64)
            for j in range(size):
                for i in range(size):
                    x = (x << width) | bits[i : i + x.shape[0], j : j + x.shape[1]]
            y, right = np.meshgrid(np.arange(x.shape[0]), np.arange(x.shape[1]) + size, indexing="ij")
            parts, pos = [x.ravel()], (y.ravel().astype(np.int64) << 32) | right.ravel()
            flat = np.append(luma[:, :, 0].ravel(), 0)
            dc = flat[np.minimum(y.ravel() * columns + right.ravel(), len(flat) - 1)]
        elif config.dimension == 1:
            for row in bits:
                if len(row) >= size * size:
                    x = np.zeros(len(row) - size * size + 1, np.uint64)
                    for j in range(size * size):
                        x = (x << width) | row[j : j + len(x)]
                    parts.append(x)
        x = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    elif config.feature_method == "gear" and config.dimension != 1:
        x = gear_blocks(np.ascontiguousarray(luma.astype("<i2")).view(np.uint8).reshape(-1, 128))
    else:
        blocks = np.ascontiguousarray(luma.astype("<i2")).view(np.uint8).reshape(*luma.shape[:2], 128)
        data = raw if config.data_type == "raw" else blocks.tobytes()
        if config.feature_method == "gear":
            x = gear(data)[63:]
        elif config.dimension == 1:
            x = rabin(config.block_size).windows(data)
        elif config.dimension == 2:
            x = rabin(config.block_size**2 * 128).grids(blocks, config.block_size)
        else:
            x = rabin(config.block_size * 128).windows(blocks.tobytes(), 128)
    if not len(x):
        return {"sf": [0] * config.sf_num, "pos": [0] * config.sf_num, "dc": [0] * config.sf_num, "windows": 0}
    best = np.zeros(n, np.int64)
    top = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for m in range(n):
            values = x * a[m] + b[m]
            best[m] = int(values.argmax())
            top[m] = values[best[m]]
        fold = lambda v: v.reshape(config.sf_num, -1).sum(axis=1)
        sf = fold(top).view(np.int64)
        zero = np.zeros(config.sf_num, np.int64)
        return {"sf": sf.tolist(), "pos": (fold(pos[best]) if pos is not None else zero).tolist(), "dc": (fold(dc[best].astype(np.int64)) if dc is not None else zero).tolist(), "windows": len(x)}


# ---- of many images at once ----

#: Coefficients of a block behind which there are zeros, in images that are sketched together, and bytes of these.
_HEAD = 32


def first_super_features(images: list[tuple[list[np.ndarray], bytes]], configs: list[DedupConfig]) -> list[list[int]]:
    """The first super-feature of each (planes, file) by each config, as :func:`exact_sketch` has it.

    Each kind of block is hashed once for all images, as long as windows of bytes
    meet only zeros in the second half of the block before; other images and configs
    go through :func:`exact_sketch`.
    """
    plain = [not planes[0][:, :, _HEAD:].any() for planes, _ in images]
    out: list[list[int]] = [[0] * len(configs) for _ in images]
    own = [i for i, p in enumerate(plain) if p]
    if own:
        shapes = [images[i][0][0].shape[:2] for i in own]
        kinds, of = _kinds(np.concatenate([images[i][0][0][:, :, :_HEAD].reshape(-1, _HEAD) for i in own]))
        octets = np.ascontiguousarray(kinds, "<i2").view(np.uint8)
        present = {k: octets[:, k].copy() for k in np.flatnonzero(octets.any(axis=0)).tolist()}
        ids = [k.reshape(shape) for k, shape in zip(np.split(of, np.cumsum([h * w for h, w in shapes])[:-1]), shapes, strict=True)]
    for j, config in enumerate(configs):
        way = _together(kinds, present, config) if own and not config.uniform_sample else None
        for i, k in zip(own, ids, strict=True) if way else ():
            out[i][j] = way(k)
        for i in range(len(images)):
            if not way or not plain[i]:
                out[i][j] = exact_sketch(*images[i], config)["sf"][0]
    return out


def _kinds(heads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(different rows, which of them each row is) of rows of 32 numbers of 16 bits."""
    words = np.ascontiguousarray(heads).view(np.uint64)
    with np.errstate(over="ignore"):
        keys = ((words ^ (words >> np.uint64(29))) * multipliers(words.shape[1])[0]).sum(axis=1, dtype=np.uint64)
    of, different = pd.factorize(keys ^ (keys >> np.uint64(32)))
    first = np.empty(len(different), np.int64)
    first[of[::-1]] = np.arange(len(of))[::-1]
    if (words[first][of] == words).all():
        return heads[first], of
    # two kinds with one key
    different, of = np.unique(words, axis=0, return_inverse=True)
    return different.view(np.int16), of.ravel()


def _together(kinds: np.ndarray, present: dict[int, np.ndarray], config: DedupConfig):
    """The first super-feature of an image from the numbers of its blocks' kinds, or None if that takes more than the blocks' first halves; ``present`` has the bytes of all kinds at places where not all are 0."""
    method, dimension, size = config.feature_method, config.dimension, config.block_size
    a, b = (x[: config.sf_component_num] for x in multipliers(config.features))
    signed = lambda tops: int(np.array(tops, np.uint64).sum(dtype=np.uint64).view(np.int64))

    def greatest(x: np.ndarray) -> int:
        with np.errstate(over="ignore"):
            return signed([(x * k + c).max() for k, c in zip(a, b, strict=True)]) if x.size else 0

    if method == "2df":
        bits, width = bitmap(np.pad(kinds, ((0, 0), (0, 64 - _HEAD)))[None], size)[0], np.uint64(64 // size**2)

        def feature(ids: np.ndarray) -> int:
            rows, columns = ids.shape
            across, steps = (columns - size + 1, [(i, j) for j in range(size) for i in range(size)]) if dimension == 2 else (columns - size * size + 1, [(0, j) for j in range(size * size)])
            down = rows - size + 1 if dimension == 2 else rows
            if down < 1 or across < 1:
                return 0
            own, x = bits[ids], np.zeros((down, across), np.uint64)
            for i, j in steps:
                x = (x << width) | own[i : i + down, j : j + across]
            return greatest(x)

        return feature
    if config.data_type == "raw" and dimension == 1:
        return None
    if method == "rabin" and dimension != 1:
        squares = dimension == 2
        window = rabin((size**2 if squares else size) * 128)
        shares = [window.shares(present, 128 * i) + np.zeros(len(kinds), np.uint64) for i in range(window.window // 128)]

        def feature(ids: np.ndarray) -> int:
            ids = ids if squares else ids.reshape(1, -1)
            steps = [(y, x) for x in range(size) for y in range(size)] if squares else [(0, x) for x in range(size)]
            down, across = ids.shape[0] - (size - 1 if squares else 0), ids.shape[1] - size + 1
            if down < 1 or across < 1:
                return 0
            out = np.zeros((down, across), np.uint64)
            for own, (y, x) in zip(shares, steps, strict=True):
                out ^= own[ids[y : y + down, x : x + across]]
            return greatest(out)

        return feature
    # the windows that begin in a block's zeros and end in the next one, then those within a block
    window = 64 if method == "gear" else size
    if window > 64:
        return None
    tops = np.zeros((2, len(a), len(kinds)), np.uint64)
    halves = method == "gear" and dimension == 3
    with np.errstate(over="ignore"):
        # what the windows are of which all bytes are 0
        none = GEAR[0] * np.uint64((1 << 64) - 1) if method == "gear" else np.uint64(0)
        state, digest = np.full(len(kinds), none), rabin(window) if method == "rabin" else None
        for end in range(64 if halves else 128):
            some = max(present, default=-1) > end - window and min(present, default=128) <= end
            if not some:
                state = none
            elif digest:
                state = digest.shares(present, window - 1 - end)
            else:
                state = (state << np.uint64(1)) + (GEAR[present[end]] if end in present else GEAR[0])
            for top, k, c in zip(tops[int(end >= window - 1)], a, b, strict=True) if not halves else ():
                if some or end in (0, 127):
                    np.maximum(top, state * k + c, out=top)
        if halves:
            both = state + none + np.zeros(len(kinds), np.uint64)
            return lambda ids: greatest(both[ids])

    def feature(ids: np.ndarray) -> int:
        ids = ids.ravel()
        return signed([max(inside[ids].max(), over[ids[1:]].max(initial=0)) for over, inside in zip(*tops, strict=True)]) if len(ids) else 0

    return feature
