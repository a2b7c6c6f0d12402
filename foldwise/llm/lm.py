"""Language-model scores from a log-frequency Bloom filter of quantised n-gram counts."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwise.llm.base import SPACED, frozen, mixed, slices, splitmix, text_buffers, word_hashes, word_spans, written

#: Most bytes of a filter that is broadcast (a larger one stays in its hash ranges), bits an insertion, probes of one insertion.
#: What is broadcast is held once a worker and probed at random, so it should fit into a core's caches.
FILTER_BYTES, BITS, PROBES = 8 << 20, 10, 4
#: Most token types in the broadcast table of exact counts; rarer types are joined.
FREQUENT_TYPES = 1 << 19
#: Tokens that a task counts before it hands on what it has, bytes of text whose n-grams are asked for together, and n-grams that are answered together.
FLUSH_TOKENS, ASK_BYTES, ANSWERED = 1 << 20, 4 << 20, 1 << 20
#: Bytes of whole texts whose words are hashed together: a hash in the making takes many times its word's bytes.
HASHED_BYTES = 1 << 20
#: Weight of the bigram estimate against the unigram one where the history is known.
BIGRAM_WEIGHT = 0.3

_END, _START = np.uint64(0xE0D), np.uint64(0x57A7)
_PAIR = splitmix(0xB16, 2) | np.uint64(1)
_PROBE = splitmix(0xF117E4, 64)
_KIND = np.uint64(0x8000000000000001)
#: The least count of each kind that enters the filter: all do.
LEAST = {0: 1, 1: 1}
NAMES = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(token hashes of all rows, first token of each row and one more); every row ends with the end token."""
    hashes, first, row = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)], 0
    while row < len(offsets) - 1:
        after = max(row + 1, int(np.searchsorted(offsets, offsets[row] + HASHED_BYTES, side="right")) - 1)
        part = data[offsets[row] : offsets[after]]
        starts, _, words = word_spans(part, offsets[row : after + 1] - offsets[row], SPACED)
        hashes.append(np.insert(word_hashes(part, starts, SPACED), words[1:], _END))
        first.append(first[-1][-1] + words[1:] + np.arange(1, len(words)))
        row = after
    return np.concatenate(hashes), np.concatenate(first)


def pairs(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(history, bigram) hashes of each token; a row's first token has the start as its history."""
    before = np.concatenate([[_START], hashes[:-1]])
    before[first[:-1]] = _START
    with np.errstate(over="ignore"):
        return before, mixed(before * _PAIR[0] + hashes * _PAIR[1])


def level(counts: np.ndarray) -> np.ndarray:
    """Quantised count: 1 + floor(log2(count))."""
    return np.frexp(counts.astype(np.float64))[1]


def unlevel(levels: np.ndarray) -> np.ndarray:
    """The count a level stands for: the middle of its range, 0 for level 0."""
    return np.where(levels > 1, 1.5 * 2.0 ** (levels - 1) - 0.5, levels)


def _cut(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket begins in sorted hashes; a bucket is a range of the top bits."""
    shift = np.uint64(64 - int(math.log2(buckets)))
    return np.searchsorted(hashes >> shift if buckets > 1 else np.zeros(len(hashes), np.uint64), np.arange(buckets + 1, dtype=np.uint64))


def _counted(docs: DataFrame, buckets: int) -> DataFrame:
    """(kind, bucket, hashes, counts): sorted runs of unigrams (0) and bigrams (1), summed within each task's flushes."""
    names = ["kind", "bucket", "hashes", "counts"]

    def packed(kind: int, values: list[np.ndarray]) -> pa.RecordBatch:
        hashes, counts = np.unique(np.concatenate(values), return_counts=True)
        at = _cut(hashes, buckets)
        full = [b for b in range(buckets) if at[b + 1] > at[b]]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([kind] * len(full), pa.int32()),
                pa.array(full, pa.int32()),
                pa.array([_packed(hashes[at[b] : at[b + 1]]) for b in full], pa.binary()),
                pa.array([_narrow(counts[at[b] : at[b + 1]]) for b in full], pa.binary()),
            ],
            names=names,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[], []]
        for _, data, offsets in slices(batches):
            hashes, first = tokens(data, offsets)
            held[0].append(hashes)
            held[1].append(pairs(hashes, first)[1])
            if sum(map(len, held[0])) >= FLUSH_TOKENS:
                yield from (packed(k, v) for k, v in enumerate(held))
                held = [[], []]
        if held[0]:
            yield from (packed(k, v) for k, v in enumerate(held))

    return docs.select("text").mapInArrow(run, "kind int, bucket int, hashes binary, counts binary")


def _arrays(table, kind: int) -> tuple[np.ndarray, np.ndarray]:
    own = [i for i, k in enumerate(table.column("kind").to_pylist()) if k == kind]
    hashes, counts = table.column("hashes"), table.column("counts")
    if not own:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate([_unpacked(hashes[i].as_py()) for i in own]), np.concatenate([_wide(counts[i].as_py()) for i in own])


def _summed(chunks: DataFrame) -> DataFrame:
    """One row a kind and bucket with the exact counts of all its n-grams."""

    def run(key, table):
        kind = key[1].as_py()
        hashes, counts = _arrays(table, kind)
        order = np.argsort(hashes, kind="stable")
        hashes, counts = hashes[order], counts[order]
        first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
        counts = np.add.reduceat(counts, first)
        return pa.table({"kind": pa.array([kind], pa.int32()), "bucket": pa.array([key[0].as_py()], pa.int32()), "hashes": pa.array([_packed(hashes[first])], pa.binary()), "counts": pa.array([_narrow(counts)], pa.binary())})

    return chunks.groupBy("bucket", "kind").applyInArrow(run, "kind int, bucket int, hashes binary, counts binary")


def _histogram(summed: DataFrame) -> list:
    """(kind, count, types, tokens), counts over 4096 by their power of two: at most a few thousand rows each kind."""

    def run(batches):
        for batch in batches:
            for kind, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts = _wide(data)
                rounded = np.where(counts < 4096, counts, 2 ** (level(counts) - 1).astype(np.int64))
                values, at = np.unique(rounded, return_inverse=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([kind] * len(values), pa.int32()), pa.array(values, pa.int64()), pa.array(np.bincount(at), pa.int64()), pa.array(np.bincount(at, counts).astype(np.int64), pa.int64())],
                    names=["kind", "count", "types", "tokens"],
                )

    rows = summed.select("kind", "counts").mapInArrow(run, "kind int, count long, types long, tokens long")
    return rows.groupBy("kind", "count").agg(F.sum("types").alias("types"), F.sum("tokens").alias("tokens")).collect()


def _least_count(rows, room: int, cost) -> int:
    """The least count such that all types with at least that count fit into ``room``."""
    used, least = 0, 1 << 62
    for count, types in sorted(rows, reverse=True):
        used += types * cost(count)
        if used > room:
            break
        least = count
    return least


def _filled(table, least: dict[int, int], segment_bits: int) -> np.ndarray:
    """One segment's bytes, with every level of the n-grams in ``table``."""
    bits = np.zeros(segment_bits, dtype=bool)
    for kind in (0, 1):
        hashes, counts = _arrays(table, kind)
        hashes, levels = hashes[counts >= least[kind]], level(counts[counts >= least[kind]])
        for depth in range(1, int(levels.max(initial=0)) + 1):
            own = hashes[levels >= depth] ^ (_KIND * np.uint64(kind))
            for probe in range(PROBES):
                bits[_spot(own, depth, probe, segment_bits)] = True
    return np.packbits(bits, bitorder="little")


def _segments(summed: DataFrame, least: dict[int, int], segment_bits: int, buckets: int) -> np.ndarray:
    """The filter's bytes: each bucket fills its own segment, so no two tasks write to one place."""

    def run(key, table):
        bits = _filled(table, least, segment_bits)
        return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([bits.tobytes()], pa.binary())})

    rows = summed.groupBy("bucket").applyInArrow(run, "bucket int, bits binary").collect()
    out = np.zeros((buckets, segment_bits // 8), np.uint8)
    for row in rows:
        out[row["bucket"]] = np.frombuffer(row["bits"], np.uint8)
    return out.ravel()


def _spot(hashes: np.ndarray, depth: int, probe: int, segment_bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        z = (hashes ^ _PROBE[depth % 32]) * (_PROBE[32 + probe] | np.uint64(1))
    return ((z ^ (z >> np.uint64(29))) >> np.uint64(8)) % np.uint64(segment_bits)


def probed(bits: np.ndarray, hashes: np.ndarray, kind: int, segment_bits: int, buckets: int) -> np.ndarray:
    """The level of each n-gram: the filter is asked for level 1, 2, ... until one is not there."""
    shift = np.uint64(64 - int(math.log2(buckets)))
    base = (hashes >> shift if buckets > 1 else np.zeros(len(hashes), np.uint64)) * np.uint64(segment_bits)
    own, left, levels = hashes ^ (_KIND * np.uint64(kind)), np.arange(len(hashes)), np.zeros(len(hashes), np.int64)
    for depth in range(1, 63):
        for probe in range(PROBES):
            at = base[left] + _spot(own[left], depth, probe, segment_bits)
            left = left[(bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1]
        if not len(left):
            break
        levels[left] = depth
    return levels


def held_out(doc_id: str = "doc_id", folds: int = 7, fold: int = 2):
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % folds == fold


def _model(types: np.ndarray, at: np.ndarray, first: np.ndarray, type_levels: np.ndarray, gram_levels: np.ndarray, total: float, weight: float) -> np.ndarray:
    """Each row's score from the levels of its slice's token types and of every token's bigram."""
    unigram, bigram = unlevel(type_levels), unlevel(gram_levels)
    # as many rows start as end, so the start's count is the end's
    history = np.concatenate([[0.0], unigram[at][:-1]])
    history[first[:-1]] = unigram[np.searchsorted(types, _END)]
    share = np.where(history > 0, weight, 0.0)
    chance = share * np.minimum(1.0, bigram / np.maximum(history, 1.0)) + (1 - share) * (unigram[at] + 1) / 10**total
    return np.add.reduceat(np.log10(chance), first[:-1])


def score(docs: DataFrame, filter_bytes: int = FILTER_BYTES, frequent_types: int = FREQUENT_TYPES, weight: float = BIGRAM_WEIGHT) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are words (A-Z as a-z) and one end token a document; those with
    crc32(doc_id) mod 7 = 2 are held out, the rest is learnt from. Unigrams and
    bigrams are counted exactly: tasks sum what they read into sorted runs by hash
    range, and each range is summed on its own.

    base_score uses exact counts c: the sum of log10((c + 1) / (N + V + 1)). The
    most frequent types (at most ``frequent_types``) are broadcast; the other
    occurrences are sent to their hash range, summed there, and joined back.

    score is the bigram model's: counts are quantised to 1 + floor(log2 c) and
    every level up to that of every n-gram is put into one Bloom filter, which is
    probed level by level. P = w * c(h, t) / c(h) + (1 - w) * (c(t) + 1) / (N + V + 1),
    with w = 0 for unknown histories. The filter grows with the n-grams. Up to
    ``filter_bytes`` it is broadcast; a larger one stays in its hash ranges, and the
    texts' distinct n-grams are sent there and answered. Both give the same scores.

    Null and empty texts have one token, the end. A null doc_id counts as ''.
    Without training documents N = V = 0, and every score comes from the unigram
    estimate; an empty table gives an empty result. Texts of any length are
    one row; rows appear as often as they came; words are told apart by 64-bit
    hashes; other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), held_out().alias("held_out"))
    # several ranges a partition, so that tasks of some ranges each are alike
    buckets = 2 << max(3, math.ceil(math.log2(max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.rdd.getNumPartitions()))))
    summed = written(_summed(_counted(rows.where("not held_out"), buckets)), "lm-counts")
    histogram = _histogram(summed)
    by_kind = [[(r["count"], r["types"]) for r in histogram if r["kind"] == k] for k in (0, 1)]
    n_train = sum(r["tokens"] for r in histogram if r["kind"] == 0)
    n_types = sum(t for _, t in by_kind[0])
    used = sum(t * int(c).bit_length() for kind in by_kind for c, t in kind)
    segment_bits = max(64, -(-used * BITS // buckets // 64) * 64)
    total = math.log10(n_train + n_types + 1)
    if segment_bits * buckets > filter_bytes * 8:
        return _ranged(rows, summed, segment_bits, buckets, total, weight).withColumn("train_tokens", F.lit(n_train).cast("long")).select(*NAMES)
    bits = _segments(summed, LEAST, segment_bits, buckets)
    frequent = _least_count(by_kind[0], frequent_types, lambda _: 1)
    hashes, counts = _table(summed.where("kind = 0"), frequent)
    known = spark.sparkContext.broadcast((bits, hashes, counts))

    scored = rows.withColumn("row", F.monotonically_increasing_id())
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, held_out boolean, row long, n_tokens long, n_known long, base double, score double, bucket int, hashes binary, rows binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, hashes, counts = known.value
        names = [x.split(" ")[0] for x in schema.split(", ")]
        rare: list[tuple[np.ndarray, np.ndarray]] = []
        blank = lambda n, kinds: [pa.nulls(n, k) for k in kinds]
        head = None

        def sent() -> pa.RecordBatch:
            own, of = (np.concatenate(x) for x in zip(*rare, strict=True))
            order = np.argsort(own, kind="stable")
            own, of = own[order], of[order]
            at = _cut(own, buckets)
            full = [b for b in range(buckets) if at[b + 1] > at[b]]
            packed = [pa.array([x[at[b] : at[b + 1]].tobytes() for b in full], pa.binary()) for x in (own, of)]
            return pa.RecordBatch.from_arrays([*blank(len(full), head), pa.array(full, pa.int32()), *packed], names=names)

        for batch, data, offsets in slices(batches):
            head = [batch.schema.field(0).type, pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
            own, first = tokens(data, offsets)
            of = np.repeat(batch.column(3).to_numpy(), np.diff(first))
            types, at = np.unique(own, return_inverse=True)
            spot = np.minimum(np.searchsorted(hashes, types), max(len(hashes) - 1, 0))
            here = hashes[spot] == types if len(hashes) else np.zeros(len(types), bool)
            exact = np.where(here, counts[spot], 0) if len(hashes) else np.zeros(len(types))
            base = np.add.reduceat(np.where(here, np.log10(exact + 1.0), 0.0)[at] - total, first[:-1])
            n_known = np.add.reduceat(here[at].astype(np.int64), first[:-1])
            if not here.all():
                loose = ~here[at]
                rare.append((own[loose], of[loose]))
            grams = pairs(own, first)[1]
            distinct, back = np.unique(grams, return_inverse=True)
            model = _model(types, at, first, probed(bits, types, 0, segment_bits, buckets), probed(bits, distinct, 1, segment_bits, buckets)[back], total, weight)
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), batch.column(3), pa.array(np.diff(first), pa.int64()), pa.array(n_known, pa.int64()), pa.array(base), pa.array(model), *blank(n, [pa.int32(), pa.binary(), pa.binary()])],
                names=names,
            )
            if sum(len(x) for x, _ in rare) >= FLUSH_TOKENS:
                yield sent()
                rare = []
        if rare:
            yield sent()

    made = frozen(scored.mapInArrow(run, schema), "lm-scores")
    extra = _rare_sums(made.where("bucket is not null").select("bucket", "hashes", "rows"), summed.where("kind = 0").select("bucket", "hashes", "counts"))
    extra = extra.groupBy("row").agg(F.sum("base").alias("more"), F.sum("known").alias("also"))
    out = made.where("bucket is null").join(extra, "row", "left")
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("also", F.lit(0))).alias("n_known"), F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), "score",
    )


def _packed(hashes: np.ndarray) -> bytes:
    """Sorted hashes as differences, byte place by byte place, so that a shuffle compresses them."""
    return np.diff(hashes, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


def _narrow(counts: np.ndarray) -> bytes:
    """Counts in the fewest bytes that hold the greatest, behind one byte that says how many."""
    size = 1 if (most := int(counts.max(initial=0))) < 1 << 8 else 2 if most < 1 << 16 else 4 if most < 1 << 32 else 8
    return bytes([size]) + counts.astype(f"<u{size}").tobytes()


def _wide(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64)


def _ranged(rows: DataFrame, summed: DataFrame, segment_bits: int, buckets: int, total: float, weight: float) -> DataFrame:
    """The scores by a filter that stays in its hash ranges.

    The texts are frozen in slices of bounded size. Each slice sends its distinct
    n-grams to their ranges, where the segment is filled and asked; a byte for each
    n-gram (and a unigram's exact count) comes back in the order of the hashes.
    """
    kind = rows.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, _ in slices(batches, limit=ASK_BYTES):
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), c) for c in batch.columns], names=["ids", "texts", "held"])

    sliced = rows.mapInArrow(cut, f"ids array<{kind}>, texts array<string>, held array<boolean>")
    sliced = frozen(sliced.select(F.monotonically_increasing_id().alias("slice"), "*"), "lm-slices")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["slice", "kind", "bucket", "hashes"]
        for batch in batches:
            for i, number in enumerate(batch.column(0).to_pylist()):
                own, first = tokens(*text_buffers(batch.column(1)[i].values))
                for k, hashes in enumerate((np.unique(own), np.unique(pairs(own, first)[1]))):
                    at = _cut(hashes, buckets)
                    full = [b for b in range(buckets) if at[b + 1] > at[b]]
                    sent = [_packed(hashes[at[b] : at[b + 1]]) for b in full]
                    yield pa.RecordBatch.from_arrays([pa.array([number] * len(full), pa.int64()), pa.array([k] * len(full), pa.int32()), pa.array(full, pa.int32()), pa.array(sent, pa.binary())], names=names)

    def answer(left, right):
        bits = _filled(right, LEAST, segment_bits)
        hashes, counts = _arrays(right, 0)
        kinds, asked = left.column("kind").to_numpy(), [_unpacked(data.as_py()) for data in left.column("hashes")]
        levels, numbers = [b""] * len(asked), [_narrow(np.zeros(0, np.int64))] * len(asked)
        for k in (0, 1):
            rows = np.flatnonzero(kinds == k)
            # a range has a row of each slice, so these grow more in number than in size: they are answered many at a time
            runs = np.cumsum([len(asked[i]) for i in rows]) // ANSWERED
            for run in np.unique(runs):
                some = rows[runs == run]
                own = np.concatenate([asked[i] for i in some])
                found = probed(bits, own, k, segment_bits, 1).astype(np.uint8)
                exact = np.zeros(len(own) if k == 0 else 0, np.int64)
                if len(exact) and len(hashes):
                    spot = np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)
                    exact = np.where(hashes[spot] == own, counts[spot], 0)
                end = 0
                for i in some:
                    begin, end = end, end + len(asked[i])
                    levels[i] = found[begin:end].tobytes()
                    if k == 0:
                        numbers[i] = _narrow(exact[begin:end])
        return pa.table({"slice": left.column("slice"), "kind": left.column("kind"), "bucket": left.column("bucket"), "levels": pa.array(levels, pa.binary()), "counts": pa.array(numbers, pa.binary())})

    def scores(left, right):
        if not left.num_rows:
            return pa.table({"doc_id": pa.array([], left.schema.field("ids").type.value_type), **{c: pa.array([], t) for c, t in (("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()))}})
        own, first = tokens(*text_buffers(left.column("texts").chunk(0)[0].values))
        types, at = np.unique(own, return_inverse=True)
        _, back = np.unique(pairs(own, first)[1], return_inverse=True)
        order = sorted(zip(right.column("kind").to_pylist(), right.column("bucket").to_pylist(), range(right.num_rows), strict=True))
        joined = lambda name, k, of: np.concatenate([np.zeros(0, np.int64), *[of(right.column(name)[i].as_py()) for kind, _, i in order if kind == k]])
        levels = lambda data: np.frombuffer(data, np.uint8).astype(np.int64)
        exact = joined("counts", 0, _wide)
        base = np.add.reduceat(np.log10(exact + 1.0)[at] - total, first[:-1])
        n_known = np.add.reduceat((exact > 0).astype(np.int64)[at], first[:-1])
        model = _model(types, at, first, joined("levels", 0, levels), joined("levels", 1, levels)[back], total, weight)
        ids, held = (left.column(c).chunk(0)[0].values for c in ("ids", "held"))
        return pa.table({"doc_id": ids, "held_out": held, "n_tokens": pa.array(np.diff(first), pa.int64()), "n_known": pa.array(n_known, pa.int64()), "base_score": base, "score": model})

    asked = sliced.select("slice", "texts").mapInArrow(ask, "slice long, kind int, bucket int, hashes binary")
    answered = asked.groupBy("bucket").cogroup(summed.groupBy("bucket")).applyInArrow(answer, "slice long, kind int, bucket int, levels binary, counts binary")
    answered = written(answered, "lm-levels")
    return sliced.groupBy("slice").cogroup(answered.groupBy("slice")).applyInArrow(scores, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double")


def _table(summed: DataFrame, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes and counts of the types with at least ``least`` occurrences: bounded by the choice of ``least``."""

    def run(batches):
        for batch in batches:
            for h, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                hashes, counts = _unpacked(h), _wide(c)
                own = counts >= least
                yield pa.RecordBatch.from_arrays([pa.array([hashes[own].tobytes()], pa.binary()), pa.array([counts[own].tobytes()], pa.binary())], names=["hashes", "counts"])

    rows = summed.select("hashes", "counts").mapInArrow(run, "hashes binary, counts binary").collect()
    hashes = np.frombuffer(b"".join(r["hashes"] for r in rows), np.uint64)
    counts = np.frombuffer(b"".join(r["counts"] for r in rows), np.int64)
    order = np.argsort(hashes)
    return hashes[order], counts[order]


def _rare_sums(occurrences: DataFrame, counts: DataFrame) -> DataFrame:
    """(row, base, known): each row's sum of log10(c + 1) over the sent occurrences of one hash range."""

    def run(left, right):
        if not left.num_rows or not right.num_rows:
            return pa.table({"row": pa.array([], pa.int64()), "base": pa.array([], pa.float64()), "known": pa.array([], pa.int64())})
        join = lambda table, name, kind: np.concatenate([np.frombuffer(x, kind) for x in table.column(name).to_pylist()])
        own, of = join(left, "hashes", np.uint64), join(left, "rows", np.int64)
        hashes, numbers = (np.concatenate([of_(x) for x in right.column(c).to_pylist()]) for c, of_ in (("hashes", _unpacked), ("counts", _wide)))
        at = np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)
        here = hashes[at] == own
        rows, back = np.unique(of[here], return_inverse=True)
        base = np.bincount(back, np.log10(numbers[at[here]] + 1.0), minlength=len(rows))
        return pa.table({"row": pa.array(rows, pa.int64()), "base": pa.array(base, pa.float64()), "known": pa.array(np.bincount(back, minlength=len(rows)), pa.int64())})

    return occurrences.groupBy("bucket").cogroup(counts.groupBy("bucket")).applyInArrow(run, "row long, base double, known long")
