"""Substring deduplication by content-defined chunks of a gear rolling hash."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from foldwise.llm.base import SPACED, frozen, mixed, slices, splitmix, word_spans, written
from foldwise.plans.freeze import dropped

#: Bytes that decide on a boundary, its odds (one in 2**5), least and most bytes of a chunk, and bytes between cuts where nothing marks one.
WINDOW, MASK_BITS, LEAST, MOST, APART = 16, 5, 12, 256, 64
#: A repeated stretch counts as a passage from so many whole words or so many bytes on.
RUN_WORDS, RUN_BYTES = 42, 512
#: How far a repeated stretch is followed beyond its whole chunks: the lengths of text on either side that are compared, by 16 bits each.
STEPS = np.array([8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 128, 160])
#: Most bits of the broadcast filter of repeated digests.
FILTER_BITS = 1 << 24

_GEAR = (splitmix(0x6EA2, 256) >> np.uint64(32)).astype(np.uint32)
_VALUES = splitmix(0x5EED2, 256)
_BASE = 0xA24BAED4963EE407 | 1


def gear(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Gear hash of the last WINDOW bytes at each place, h = 2 h + T[byte], by doubling the window.

    Before a row's first byte nothing counts, so rows do not touch each other.
    """
    rows = np.repeat(np.arange(1, len(offsets)), np.diff(offsets))
    places = np.arange(len(data)) + WINDOW * rows
    spread = np.zeros(len(data) + WINDOW * len(offsets), np.uint32)
    spread[places] = _GEAR[data]
    width = 1
    while width < WINDOW:
        before = np.zeros_like(spread)
        before[width:] = spread[:-width] << np.uint32(width)
        spread += before
        width *= 2
    return spread[places]


def _unmarked(hashes: np.ndarray, begin: int, end: int) -> list[int]:
    """Cuts within a stretch that has no marks: where its least hash stands, again in what stays too long, APART bytes apart.

    The least hash depends on the text alone, so a stretch of repetitions is cut at
    the same places of its period wherever it begins.
    """
    out, left = [], [(begin, end, 8)]
    while left:
        b, e, rounds = left.pop()
        inner = hashes[b + LEAST - 1 : e - LEAST]
        cuts, last = [], b
        if rounds:
            for at in (np.flatnonzero(inner == inner.min()) + b + LEAST).tolist():
                if at - last >= APART or last == b:
                    cuts.append(at)
                    last = at
        else:
            cuts = list(range(b + MOST, e, MOST))
        out += cuts
        left += [(x, y, rounds - 1) for x, y in zip([b, *cuts], [*cuts, e], strict=True) if y - x > MOST and rounds]
    return out


def cut_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of all chunks of all rows; every byte is in one chunk.

    A chunk ends where the hash's top bits are zero, unless that is under LEAST
    bytes behind the end before it; longer stretches are cut by their least hash.
    """
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    hashes = gear(data, offsets)
    marks = np.flatnonzero(hashes >> np.uint32(32 - MASK_BITS) == 0) + 1
    bounds = np.unique(np.concatenate([offsets, marks]))
    fixed, kept = np.isin(bounds, offsets), np.ones(len(bounds), dtype=bool)
    for i in (np.flatnonzero(np.diff(bounds) < LEAST) + 1).tolist():
        before = i - 1
        while not kept[before]:
            before -= 1
        kept[i] = bool(fixed[i]) or bounds[i] - bounds[before] >= LEAST
    bounds = bounds[kept]
    long = np.flatnonzero(np.diff(bounds) > MOST)
    if len(long):
        more = [x for i in long.tolist() for x in _unmarked(hashes, int(bounds[i]), int(bounds[i + 1]))]
        bounds = np.unique(np.concatenate([bounds, np.array(more, np.int64)]))
    return bounds[:-1], bounds[1:]


def _chunked(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, text, n_bytes, the digests of its chunks and their ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in slices(batches):
            starts, ends = cut_points(data, offsets)
            text, digest = data.tobytes(), xxhash.xxh3_64_intdigest
            digests = np.array([digest(text[b:e]) for b, e in zip(starts.tolist(), ends.tolist(), strict=True)], np.uint64).view(np.int64)
            first = np.searchsorted(starts, offsets)
            within = (ends - np.repeat(offsets[:-1], np.diff(first))).astype(np.int32)
            lists = pa.array(first, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.diff(offsets)), pa.ListArray.from_arrays(lists, pa.array(digests)), pa.ListArray.from_arrays(lists, pa.array(within))],
                names=["doc_id", "text", "n_bytes", "digests", "ends"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, f"doc_id {kind}, text string, n_bytes long, digests array<long>, ends array<int>")


def _filter_of(digests: DataFrame) -> np.ndarray:
    """A bit for each digest modulo FILTER_BITS: what it passes holds all of them, and hardly more while they are few."""
    spot = F.pmod(F.col("digest"), F.lit(FILTER_BITS))
    words = digests.groupBy(F.floor(spot / 64).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (spot % 64).cast("int"))).alias("bits"))
    table = np.zeros(FILTER_BITS // 64, np.uint64)
    for batch in words.toArrow().to_batches():
        table[batch.column(0).to_numpy(zero_copy_only=False)] = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    return table


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        both = [np.full(n, base, np.uint64) for base in (_BASE, pow(_BASE, -1, 1 << 64))]
        for x in both:
            x[:1] = 1
        return np.cumprod(both[0], dtype=np.uint64), np.cumprod(both[1], dtype=np.uint64)


def _ladders(data: np.ndarray, offsets: np.ndarray, edges: np.ndarray, rows: np.ndarray, side: int) -> np.ndarray:
    """16-bit hashes of the text before (side -1) or behind (1) each edge, for all STEPS, within its row."""
    _, inverses = _power_cache(len(data) + 1)
    sums = _sums_cache(data)
    reach = np.minimum(STEPS[None, :], (edges - offsets[rows] if side < 0 else offsets[rows + 1] - edges)[:, None])
    a = edges[:, None] - (reach if side < 0 else 0)
    b = edges[:, None] + (0 if side < 0 else reach)
    with np.errstate(over="ignore"):
        hashes = mixed((sums[b] - sums[a]) * inverses[a] + reach.astype(np.uint64))
    return (hashes >> np.uint64(48)).astype(np.uint16)


_cache: dict = {}


def _power_cache(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "powers" not in _cache or len(_cache["powers"][0]) < n:
        _cache["powers"] = _powers(max(n, (2 << 20) + 1))
    return _cache["powers"]


def _sums_cache(data: np.ndarray) -> np.ndarray:
    """Running sums of the bytes' values times powers, so that a stretch's hash is a difference."""
    with np.errstate(over="ignore"):
        return np.concatenate([[np.uint64(0)], np.cumsum(_VALUES[data] * _power_cache(len(data) + 1)[0][: len(data)], dtype=np.uint64)])


def _places(chunked: DataFrame, repeated: DataFrame, kind: str) -> DataFrame:
    """A row for each chunk that may be repeated: its digest, document, row, place, whole words, and ladders on both sides."""
    schema = f"digest long, own {kind}, row long, begin int, `end` int, size int, words int, before binary, behind binary"
    known = chunked.sparkSession.sparkContext.broadcast(_filter_of(repeated))
    names = "digest own row begin end size words before behind".split()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in slices(batches):
            lists, ends = batch.column(2), batch.column(3)
            digests = lists.flatten().to_numpy()
            counts = lists.value_lengths().to_numpy()
            own = np.repeat(np.arange(batch.num_rows), counts)
            stops = ends.flatten().to_numpy().astype(np.int64)
            first = np.concatenate([[0], np.cumsum(counts)])[:-1]
            starts = np.concatenate([[0], stops[:-1]]) if len(stops) else stops
            starts[first[counts > 0]] = 0
            at = digests.astype(np.int64) % FILTER_BITS
            may = (known.value[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
            own, starts, stops, digests = own[may], starts[may], stops[may], digests[may]
            if not len(own):
                continue
            # opens[i]: words that begin before byte i; one that a stretch cuts short at its end counts there
            opens = np.zeros(len(data) + 1, np.int64)
            begins, _, _ = word_spans(data, offsets, SPACED)
            opens[begins + 1] = 1
            opens = np.cumsum(opens)
            begin, end = offsets[own] + starts, offsets[own] + stops
            ladders = [_ladders(data, offsets, edge, own, side) for edge, side in ((begin, -1), (end, 1))]
            packed = [pa.FixedSizeBinaryArray.from_buffers(pa.binary(x.shape[1] * x.itemsize), len(x), [None, pa.py_buffer(x)]).cast(pa.binary()) for x in ladders]
            numbers = [x.astype(np.int32) for x in (starts, stops, np.diff(offsets)[own], opens[end] - opens[begin])]
            rows = batch.column(0).to_numpy()[own]
            yield pa.RecordBatch.from_arrays([pa.array(digests), batch.column(1).take(pa.array(own)), pa.array(rows), *map(pa.array, numbers), *packed], names=names)

    return chunked.select("row", "doc_id", "digests", "ends", "text").mapInArrow(run, schema)


def _reach(own: pd.Series, one: pd.Series, two: pd.Series) -> pd.Series:
    """How many bytes a place's text agrees with that of either other place, as far as the steps tell."""
    n, k = len(own), len(STEPS)
    mine = np.frombuffer(b"".join(own), np.uint16).reshape(n, k)
    best = np.zeros(n, np.int64)
    for other in (one, two):
        here = other.notna().to_numpy()
        if here.any():
            same = mine[here] == np.frombuffer(b"".join(other[here]), np.uint16).reshape(-1, k)
            best[here] = np.maximum(best[here], np.cumprod(same, axis=1).sum(axis=1))
    return pd.Series(np.concatenate([[0], STEPS])[best].astype(np.int32))


def _joined(begin, end, words, left, right, size: int, run_words: int, run_bytes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Touching chunks joined and followed on both sides, the short stretches left out: (begins, ends, for each chunk whether it is in one).

    What a stretch is followed by counts as many words as its own bytes have on average.
    """
    opens = np.concatenate([[True], begin[1:] != end[:-1]])
    closes = np.concatenate([opens[1:], [True]])
    at = np.cumsum(opens) - 1
    b, e = np.maximum(begin[opens] - left[opens], 0), np.minimum(end[closes] + right[closes], size)
    count = np.bincount(at, words) * (e - b) / (end[closes] - begin[opens])
    long = (count >= run_words) | (e - b >= run_bytes)
    inside = long[at]
    b, e = b[long], e[long]
    # followed stretches may run into each other
    keep = np.concatenate([[True], b[1:] > np.maximum.accumulate(e)[:-1]]) if len(b) else np.zeros(0, bool)
    return b[keep], np.maximum.reduceat(e, np.flatnonzero(keep)) if len(b) else e, inside


def _passages(rows: DataFrame, kind: str, run_words: int, run_bytes: int) -> DataFrame:
    """(row, n_repeated, repeat_bytes, first_ids, spans) from each row's repeated chunks."""
    span = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("n_repeated", "repeat_bytes", "first_ids", "spans")}
            lists = batch.column(1)
            values, first = lists.flatten(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
            begin, end, size, words, left, right = (values.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(6))
            later, owner = values.field(6).to_numpy(zero_copy_only=False).astype(bool), values.field(7)
            for i in range(batch.num_rows):
                at = np.arange(first[i], first[i + 1])
                at = at[np.argsort(begin[at], kind="stable")]

                def stretches(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
                    if not len(at):
                        return at, at, np.zeros(0, bool)
                    return _joined(*(x[at] for x in (begin, end, words, left, right)), int(size[at[0]]), run_words, run_bytes)

                rb, re, _ = stretches(at)
                late = at[later[at]]
                lb, le, inside = stretches(late)
                out["n_repeated"].append(len(at))
                out["repeat_bytes"].append(int((re - rb).sum()))
                out["first_ids"].append(owner.take(pa.array(late[inside], pa.int64())).unique().drop_null().sort() if inside.any() else pa.array([], owner.type))
                out["spans"].append([{"begin": x, "end": y} for x, y in zip(lb.tolist(), le.tolist(), strict=True)])
            ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in out["first_ids"]])]), pa.int32()), pa.concat_arrays([pa.array([], owner.type), *out["first_ids"]]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out["n_repeated"], pa.int64()), pa.array(out["repeat_bytes"], pa.int64()), ids, pa.array(out["spans"], span)], names=["row", *out])

    return rows.mapInArrow(run, f"row long, n_repeated long, repeat_bytes long, first_ids array<{kind}>, spans array<struct<begin:long,end:long>>")


def repeats(docs: DataFrame, run_words: int = RUN_WORDS, run_bytes: int = RUN_BYTES) -> DataFrame:
    """Per document: doc_id, n_bytes, n_chunks, n_repeated, repeat_bytes, dup_bytes, kept_bytes, first_ids, spans.

    A text's UTF-8 bytes are cut where a gear hash of the last 16 bytes has five
    zero bits (chunks of 12 to 256 bytes, 40 on average), so an insertion moves only
    the chunks it touches. A chunk is repeated if its digest occurs again anywhere;
    the document with the least doc_id that holds it keeps it (its first place
    there), every other place is a later one.

    Touching repeated chunks make a stretch. At both ends it is followed into the
    neighbouring chunks, in steps of 8 bytes at first, as long as the text agrees
    with that at the chunk's first or last place anywhere. It is a passage if it
    then has ``run_words`` words or ``run_bytes`` bytes: one of over 50 words is
    found if one whole chunk lies in it. repeat_bytes counts all passages,
    dup_bytes those of later places; ``spans`` are the latter's byte ranges and
    ``first_ids`` the documents that keep their chunks.

    Digests are counted by partial sums. Only chunks that a filter of the repeated
    ones passes (2 MB at most; with very many digests it passes all) leave their
    document, and a join that splits hot digests decides. Lists are per document.
    Null and empty texts have no chunks; a very long text is one row; ids are of any
    type that has an order; rows of one doc_id count as one document, and null ids
    as one that comes last, so what such rows share goes from none of them; an empty
    table gives an empty result; other columns are ignored, whatever their names.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    chunked = frozen(_chunked(docs).withColumn("row", F.monotonically_increasing_id()), "chunks")
    repeated = written(chunked.select(F.explode("digests").alias("digest")).groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest"), "chunk-digests")
    sized = frozen(chunked.select("row", "doc_id", "n_bytes", F.size("digests").cast("long").alias("n_chunks")), "chunk-sizes")
    places = frozen(_places(chunked, repeated, kind), "chunk-places")
    dropped(chunked, repeated)
    place = F.struct(F.col("own").isNull().alias("nameless"), "own", "row", "begin", "before", "behind")
    ends = places.groupBy("digest").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count("*").alias("n")).where("n > 1").drop("n")
    again = places.join(written(ends, "chunk-ends"), "digest")
    is_ = lambda end: (F.col("row") == F.col(f"{end}.row")) & (F.col("begin") == F.col(f"{end}.begin"))
    reach = pandas_udf(_reach, "int")
    seen = lambda side: reach(side, *[F.when(~is_(e), F.col(f"{e}.{side}")) for e in ("first", "last")])
    later = ~F.col("own").eqNullSafe(F.col("first.own")) | ((F.col("row") == F.col("first.row")) & (F.col("begin") != F.col("first.begin")))
    again = again.select("row", "begin", "end", "size", "words", seen("before").alias("left"), seen("behind").alias("right"), later.alias("later"), F.col("first.own").alias("owner"))
    chunk = F.struct("begin", "end", "size", "words", "left", "right", "later", "owner")
    found = _passages(again.groupBy("row").agg(F.collect_list(chunk).alias("chunks")), kind, run_words, run_bytes)
    out = sized.join(found, "row", "left")
    zero = F.lit(0).cast("long")
    out = out.withColumns({"spans": F.coalesce("spans", F.expr("cast(array() as array<struct<begin:bigint,end:bigint>>)"))})
    gone = F.aggregate("spans", zero, lambda s, x: s + x["end"] - x["begin"])
    return out.select(
        "doc_id", "n_bytes", "n_chunks", F.coalesce("n_repeated", zero).alias("n_repeated"), F.coalesce("repeat_bytes", zero).alias("repeat_bytes"),
        gone.alias("dup_bytes"), (F.col("n_bytes") - gone).alias("kept_bytes"), F.coalesce("first_ids", F.expr(f"cast(array() as array<{kind}>)")).alias("first_ids"), "spans",
    )


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with the later places of repeated passages cut out of the text, other columns unchanged.

    Rows with one doc_id and different texts are left as they are, null and empty
    texts too; an empty table gives an empty result.
    """
    found = repeats(docs, **options).where("dup_bytes > 0").groupBy("doc_id").agg(F.collect_set("spans").alias("all")).where(F.size("all") == 1)
    found = frozen(found.select(F.col("doc_id").alias("__id"), F.element_at("all", 1).alias("__spans")), "chunk-spans")
    rows = docs.join(found, docs["doc_id"].eqNullSafe(found["__id"]), "left").drop("__id")

    @pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for text, own in zip(texts, spans, strict=True):
            if text is None or own is None:
                out.append(text)
                continue
            data, at, kept = text.encode(), 0, []
            for x in own:
                kept.append(data[at : x["begin"]])
                at = x["end"]
            # a chunk may end within a character, whose cut bytes go
            out.append(b"".join([*kept, data[at:]]).decode(errors="ignore"))
        return pd.Series(out)

    return rows.withColumn("text", cut("text", "__spans")).drop("__spans")
