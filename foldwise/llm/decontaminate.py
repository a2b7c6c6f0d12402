"""Benchmark decontamination: one Aho-Corasick automaton over all benchmark windows."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwise.llm.base import ALNUM, frozen, slices, text_buffers, word_hashes, word_spans

#: Most UTF-8 bytes of benchmark text in one automaton (some 150 MB a worker); a larger benchmark is scanned in several passes.
AUTOMATON_BYTES = 1 << 20

_automata: dict[str, tuple] = {}


def _windows(words: np.ndarray, n: int) -> list[tuple[int, ...]]:
    own = words.tolist()
    return [tuple(own[i : i + n]) for i in range(len(own) - n + 1)] if len(own) > n else [tuple(own)] if own else []


def build(items: list[tuple[str, str | None]], n: int = 13) -> tuple:
    """(automaton, vocabulary hashes sorted, items of each pattern, pattern lengths).

    Keys are sequences of word numbers, so a match's end is a word's place in the
    document, whatever stands between its words.
    """
    data, offsets = text_buffers(pa.array([t for _, t in items], pa.string()))
    starts, _, first = word_spans(data, offsets, ALNUM)
    hashes = word_hashes(data, starts, ALNUM)
    vocabulary, numbers = np.unique(hashes, return_inverse=True)
    patterns: dict[tuple[int, ...], set[str]] = {}
    for k, (item, _) in enumerate(items):
        for window in _windows(numbers[first[k] : first[k + 1]] + 1, n):
            patterns.setdefault(window, set()).add(item)
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    owners = []
    for window, of in patterns.items():
        automaton.add_word(window, len(owners))
        owners.append(sorted(of))
    automaton.make_automaton()
    return automaton, vocabulary, owners, np.array([len(w) for w in patterns], dtype=np.int64)


def scan(numbers: np.ndarray, automaton, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which words of one document are hit, and the patterns found."""
    found = list(automaton.iter(tuple(numbers.tolist())))
    hit = np.zeros(len(numbers) + 1, dtype=np.int64)
    if not found:
        return hit[:-1].astype(bool), np.zeros(0, np.int64)
    ends, which = np.array(found, dtype=np.int64).T
    np.add.at(hit, ends - lengths[which] + 1, 1)
    np.add.at(hit, ends + 1, -1)
    return np.cumsum(hit[:-1]) > 0, np.unique(which)


def _groups(benchmark: DataFrame, limit: int) -> Iterator[list[tuple[str, str | None]]]:
    """The benchmark's rows in groups of at most ``limit`` bytes (an item is never split), one group on the driver at a time."""
    held, size = [], 0
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text").where("text is not null")
    for row in rows.distinct().orderBy("item", "text").toLocalIterator():
        n = len(row["text"].encode())
        if size + n > limit and held:
            yield held
            held, size = [], 0
        held.append((row["item"], row["text"]))
        size += n
    yield held


def _scan_slice(data: np.ndarray, offsets: np.ndarray, built: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[set[str]]]:
    """(word starts, word ends, first word of each row, hit words, items of each row) of some rows, read once by one automaton."""
    automaton, vocabulary, owners, lengths = built
    starts, ends, first = word_spans(data, offsets, ALNUM)
    hits = np.zeros(len(starts), dtype=bool)
    items: list[set[str]] = [set() for _ in range(len(offsets) - 1)]
    if len(lengths) and len(starts):
        hashes = word_hashes(data, starts, ALNUM)
        at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
        numbers = np.where(vocabulary[at] == hashes, at + 1, 0)
        # stretches of known words within rows
        inside = numbers > 0
        cut = np.zeros(len(numbers) + 1, dtype=bool)
        cut[first] = True
        begins = np.flatnonzero(inside & (cut[:-1] | ~np.concatenate([[False], inside[:-1]])))
        stops = np.flatnonzero(inside & (cut[1:] | ~np.concatenate([inside[1:], [False]]))) + 1
        for b, e in zip(*(x[stops - begins >= lengths.min()].tolist() for x in (begins, stops)), strict=True):
            hit, which = scan(numbers[b:e], automaton, lengths)
            if len(which):
                hits[b:e] |= hit
                row = int(np.searchsorted(first, b, side="right")) - 1
                for w in which.tolist():
                    items[row].update(owners[w])
    return starts, ends, first, hits, items


def _ranges(hits: np.ndarray, begin: int, end: int) -> list[tuple[int, int]]:
    """Stretches of hit words within [begin, end), as (first word, word behind the last)."""
    own = np.flatnonzero(hits[begin:end]) + begin
    if not len(own):
        return []
    breaks = np.flatnonzero(np.diff(own) > 1)
    return list(zip(own[np.concatenate([[0], breaks + 1])].tolist(), (own[np.concatenate([breaks, [len(own) - 1]])] + 1).tolist(), strict=True))


def _automaton(key: str, shared, n: int) -> tuple:
    """The worker's automaton of one group; that of another group goes."""
    if key not in _automata:
        _automata.clear()
        _automata[key] = build(shared.value, n)
    return _automata[key]


ADDED = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>, spans array<struct<begin:long,end:long>>"
NAMES = [x.split(" ")[0] for x in ADDED.split(", ")]


def _result(n_words: np.ndarray, n_hit: np.ndarray, found: list[list[str]], spans: list[list[dict]], share: int) -> list[pa.Array]:
    return [
        pa.array(n_words, pa.int64()),
        pa.array(n_hit, pa.int64()),
        pa.array([len(x) for x in found], pa.int64()),
        pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in found], pa.string()),
        pa.array((n_hit > 0) & (share * n_hit >= n_words), pa.bool_()),
        pa.array(found, pa.list_(pa.string())),
        pa.array(spans, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))),
    ]


def _spans(ranges: list[tuple[int, int]], starts: np.ndarray, ends: np.ndarray, offset: int) -> list[dict]:
    return [{"begin": int(starts[b] - offset), "end": int(ends[e - 1] - offset)} for b, e in ranges]


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 13, share: int = 20, automaton_bytes: int = AUTOMATON_BYTES) -> DataFrame:
    """``docs`` (doc_id, text, ...) with n_words, n_hit, n_items, items_sha256, contaminated, items and spans.

    A-Z count as a-z; words are runs of letters, digits and all beyond ASCII. A
    window is ``n`` consecutive words of a benchmark item, or the whole item if it
    has fewer. A document's word is hit if it lies in an occurrence of a window;
    a document is contaminated if at least one word in ``share`` is hit. ``items``
    lists the items found, ``spans`` the hit stretches as byte offsets [begin, end)
    into the original UTF-8 text.

    Documents are scanned once, as word numbers; words beyond the benchmark's
    vocabulary are 0, and stretches of fewer known words than the shortest window
    has are not scanned. The broadcast automaton is bounded by ``automaton_bytes``
    of benchmark text: a larger benchmark is scanned in passes, one group of items
    each, that write what they hit; the document's words hit by any group count.
    The driver holds one group at a time.

    Null and empty text has no words and is clean; very long texts are scanned
    whole; repeated rows have equal results; null items hold nothing; a null
    item_id is written as an empty string, rows with one item_id are one item; an
    empty benchmark leaves all clean; an empty table gives an empty result; input
    columns with added names are replaced.
    """
    keep = [c for c in docs.columns if c not in NAMES]
    rows = docs.select(*keep)
    fields = rows.schema.fields + rows.sparkSession.createDataFrame([], ADDED).schema.fields
    groups = _groups(benchmark, automaton_bytes)
    group, more = next(groups), next(groups, None)
    if more is not None:
        return _in_passes(rows, [group, more], groups, n, share, type(rows.schema)(fields))
    key, shared = uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast(group)

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in slices(batches):
            starts, ends, first, hits, items = _scan_slice(data, offsets, _automaton(key, shared, n))
            sums = np.concatenate([[0], np.cumsum(hits)])
            n_hit = sums[first[1:]] - sums[first[:-1]]
            spans = [[]] * batch.num_rows
            for row in np.flatnonzero(n_hit).tolist():
                spans[row] = _spans(_ranges(hits, first[row], first[row + 1]), starts, ends, offsets[row])
            yield pa.RecordBatch.from_arrays([*batch.columns, *_result(np.diff(first), n_hit, [sorted(x) for x in items], spans, share)], names=[*keep, *NAMES])

    return rows.mapInArrow(scanned, type(rows.schema)(fields))


def _in_passes(docs: DataFrame, first_groups: list, groups: Iterator, n: int, share: int, schema) -> DataFrame:
    """One pass for each group writes (row, items, hit word ranges) of the documents it hits; then they are joined to the documents."""
    names = docs.columns
    rows = frozen(docs.select(F.struct(*names).alias("__doc"), F.col("text").alias("text")).withColumn("__row", F.monotonically_increasing_id()), "scanned-docs")
    context, hit = docs.sparkSession.sparkContext, "__row long, items array<string>, ranges array<struct<b:long,e:long>>"
    ranges_of = pa.list_(pa.struct([("b", pa.int64()), ("e", pa.int64())]))
    every = None
    for group in chain(first_groups, groups):
        key, shared = uuid.uuid4().hex, context.broadcast(group)

        def scanned(batches: Iterator[pa.RecordBatch], key=key, shared=shared) -> Iterator[pa.RecordBatch]:
            for batch, data, offsets in slices(batches):
                _, _, first, hits, items = _scan_slice(data, offsets, _automaton(key, shared, n))
                found = [i for i, x in enumerate(items) if x]
                ranges = [[{"b": b - int(first[i]), "e": e - int(first[i])} for b, e in _ranges(hits, first[i], first[i + 1])] for i in found]
                yield pa.RecordBatch.from_arrays([batch.column(1).take(pa.array(found, pa.int64())), pa.array([sorted(items[i]) for i in found], pa.list_(pa.string())), pa.array(ranges, ranges_of)], names=["__row", "items", "ranges"])

        made = frozen(rows.select("text", "__row").mapInArrow(scanned, hit), "hits")
        shared.unpersist()
        every = made if every is None else every.unionByName(made)
    # a document's hits are bounded by its words and the items
    per_doc = every.groupBy("__row").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.flatten(F.collect_list("ranges")).alias("ranges"))

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in slices(batches):
            starts, ends, first = word_spans(data, offsets, ALNUM)
            hits = np.zeros(len(starts), dtype=bool)
            for i, own in enumerate(batch.column(3).to_pylist()):
                for x in own or ():
                    hits[first[i] + x["b"] : first[i] + x["e"]] = True
            sums = np.concatenate([[0], np.cumsum(hits)])
            spans = [_spans(_ranges(hits, first[i], first[i + 1]), starts, ends, offsets[i]) for i in range(batch.num_rows)]
            found = [x or [] for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.column(0).flatten(), *_result(np.diff(first), sums[first[1:]] - sums[first[:-1]], found, spans, share)], names=[*names, *NAMES])

    return rows.join(per_doc, "__row", "left").select("__doc", "text", "items", "ranges").mapInArrow(finished, schema)


def decontaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the contaminated ones, their own columns unchanged; null and empty texts stay, repeated rows stay or go together."""
    columns = docs.columns
    rest = F.struct(F.lit(0).alias("__none"), *[c for c in columns if c != "text"]).alias("__row")
    tested = contamination(docs.select(rest, "text"), benchmark, **options)
    return tested.where("not contaminated").select(*[F.col(c) if c == "text" else F.col(f"__row.`{c}`").alias(c) for c in columns])
