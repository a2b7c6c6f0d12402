"""MinHash near-duplicates: banded candidates, sequential Bayesian verification, exact links, components."""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from foldwise.llm.base import SPACED, frozen, rolling, slices, splitmix, word_hashes, word_spans

HASHES, BANDS, ROWS, BATCH = 128, 25, 5, 32
#: A group of candidates with more members is verified in tiles, its members' sets at hand.
SMALL_GROUP = 48
#: Members and bytes of sets of one side of a tile.
TILE, TILE_BYTES = 512, 16 << 20
#: Members of a large group that all its members are compared with first.
PIVOTS = 16

#: Bits of the filter that picks the texts to fetch.
FILTER_BITS = 1 << 24

_MULTIPLIERS = (splitmix(101, HASHES) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_ADDENDS = (splitmix(202, HASHES) >> np.uint64(32)).astype(np.uint32)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = 5) -> list[np.ndarray]:
    """Per row the sorted distinct 64-bit hashes of its k-word shingles; the whole sequence if it is shorter."""
    starts, _, first = word_spans(data, offsets, SPACED)
    words = word_hashes(data, starts, SPACED)
    grams = rolling(words, k)
    out = []
    for b, e in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if e - b >= k:
            own = np.sort(grams[b : e - k + 1])
            out.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
        elif e > b:
            out.append(rolling(words[b:e], e - b) ^ np.uint64(e - b))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(own: np.ndarray) -> np.ndarray:
    """The least value of each of HASHES permutations over a set of hashes."""
    folded = (own ^ (own >> np.uint64(32))).astype(np.uint32)
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    with np.errstate(over="ignore"):
        for i in range(0, len(folded), 2048):
            part = folded[i : i + 2048]
            np.minimum(out, (part[None, :] * _MULTIPLIERS[:, None] + _ADDENDS[:, None]).min(axis=1), out=out)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key a band, band number included."""
    rows = sig[: BANDS * ROWS].reshape(BANDS, ROWS).astype(np.uint64)
    with np.errstate(over="ignore"):
        keys = (rows * (splitmix(303, ROWS) | np.uint64(1))).sum(axis=1, dtype=np.uint64) + splitmix(404, BANDS)
        keys ^= keys >> np.uint64(31)
        keys *= np.uint64(0x94D049BB133111EB)
    return (keys ^ (keys >> np.uint64(32))).astype(np.int64)


def least_matches(threshold: float, miss: float) -> dict[int, int]:
    """After each batch the fewest equal signature values with which a pair stays.

    With a uniform prior the posterior of the similarity after m of n equal
    values is Beta(m + 1, n - m + 1), so P(similarity >= t) = P(Bin(n + 1, t) <= m).
    """
    out = {}
    for n in range(BATCH, HASHES + 1, BATCH):
        total, m = 0.0, -1
        while total < miss:
            m += 1
            total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out[n] = m
    return out


def _may_link(a: np.ndarray, b: np.ndarray, least: dict[int, int]) -> np.ndarray:
    """Which of the paired signatures (rows of uint8) no batch rules out."""
    left, matches, begin = np.arange(len(a)), np.zeros(len(a), np.int64), 0
    for n, need in least.items():
        matches = matches + (a[left, begin:n] == b[left, begin:n]).sum(axis=1)
        stays = matches >= need
        left, matches, begin = left[stays], matches[stays], n
    out = np.zeros(len(a), dtype=bool)
    out[left] = True
    return out


def _linked(common: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, percent: int) -> np.ndarray:
    return 100 * common >= percent * (n_a + n_b - common)


def _prepared(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, text hash, set size, set digest (null if empty), signature and band keys of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in slices(batches):
            sets = shingle_sets(data, offsets, k)
            sigs = [signature(s) for s in sets]
            full = [len(s) > 0 for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(2),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) if f else None for s, f in zip(sets, full, strict=True)], pa.binary()),
                    pa.array([s.astype(np.uint8).tobytes() if f else None for s, f in zip(sigs, full, strict=True)], pa.binary()),
                    pa.array([band_keys(s) if f else None for s, f in zip(sigs, full, strict=True)], pa.list_(pa.int64())),
                ],
                names=["doc_id", "text_hash", "n_shingles", "digest", "sig", "bands"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", text_hash("text").alias("text_hash"))
    return rows.mapInArrow(run, f"doc_id {kind}, text_hash long, n_shingles long, digest binary, sig binary, bands array<long>")


def text_hash(column: str):
    return F.xxhash64(F.col(column))


def _signature_filter(least: dict[int, int]):
    @pandas_udf("boolean")
    def keep(a: pd.Series, b: pd.Series) -> pd.Series:
        one, two = (np.frombuffer(b"".join(x), np.uint8).reshape(len(x), HASHES) for x in (a, b))
        return pd.Series(_may_link(one, two, least))

    return keep


def _exact_filter(percent: int):
    @pandas_udf("boolean")
    def keep(a: pd.Series, b: pd.Series) -> pd.Series:
        out = np.zeros(len(a), dtype=bool)
        for i, (x, y) in enumerate(zip(a, b, strict=True)):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            common = len(np.intersect1d(x, y, assume_unique=True))
            out[i] = 100 * common >= percent * (len(x) + len(y) - common)
        return pd.Series(out)

    return keep


class _Sets:
    """Signatures and sets of some members, compared many at a time."""

    def __init__(self, group, least: dict[int, int], percent: int):
        self.nodes = group.column("node").to_numpy()
        self.sigs = np.frombuffer(b"".join(group.column("sig").to_pylist()), np.uint8).reshape(-1, HASHES)
        self.sets = [np.frombuffer(x, np.uint64) for x in group.column("set").to_pylist()]
        self.sizes = np.array([len(s) for s in self.sets])
        self.least, self.percent = least, percent

    def likely(self, i: int, others: np.ndarray) -> np.ndarray:
        """Those of ``others`` that the signatures do not rule out, most agreeing first."""
        others = others[_may_link(self.sigs[np.full(len(others), i)], self.sigs[others], self.least)]
        agree = (self.sigs[others] == self.sigs[i]).sum(axis=1)
        return others[np.argsort(-agree, kind="stable")]

    def linked(self, i: int, others: np.ndarray) -> np.ndarray:
        """Those of ``others`` (not none) whose full sets are similar enough to i's."""
        flat = np.concatenate([self.sets[j] for j in others])
        at = np.minimum(np.searchsorted(self.sets[i], flat), len(self.sets[i]) - 1)
        common = np.add.reduceat((self.sets[i][at] == flat).astype(np.int64), np.concatenate([[0], np.cumsum(self.sizes[others])[:-1]]))
        return others[_linked(common, self.sizes[i], self.sizes[others], self.percent)]


def pivot_links(own: _Sets, pivots: np.ndarray) -> tuple[list[tuple[int, int]], list[int]]:
    """(links, loose nodes) after comparing a group's part with the group's pivots.

    The pivots that reach the least one over links among themselves are the group's
    core: the same in every part, as each part holds all pivots. A member linked
    to one of the core needs no more; a pivot out of the core or a member linked to
    none of it is loose.
    """
    links, at = [], np.flatnonzero(pivots)
    at = at[np.argsort(own.nodes[at])]
    core, open_, rest = [int(at[0])], at[1:], np.flatnonzero(~pivots)
    for i in core:
        for waiting in ("pivots", "members"):
            likely = own.likely(i, open_ if waiting == "pivots" else rest)
            near = own.linked(i, likely) if len(likely) else likely
            links += [(int(own.nodes[i]), int(own.nodes[j])) for j in near.tolist()]
            if waiting == "pivots":
                core += near.tolist()  # the loop goes on over them
                open_ = np.setdiff1d(open_, near)
            else:
                rest = np.setdiff1d(rest, near)
    return links, [int(own.nodes[j]) for j in (*open_.tolist(), *rest.tolist())]


def tile_links(own: _Sets, settled: np.ndarray, cross: np.ndarray | None) -> list[tuple[int, int]]:
    """Links that connect what is linked among a tile's members: a spanning forest, not all pairs.

    Settled members are one component already, so a loose one is compared with them
    only until it joins them. ``cross`` marks the second side of a tile of two sides,
    in which only pairs across them are compared; it is None in a tile of one side.
    """
    links, parent = [], np.arange(len(own.nodes))
    if settled.any():
        parent[settled] = int(np.flatnonzero(settled)[0])
    for i in np.flatnonzero(~settled).tolist():
        rest = np.flatnonzero((parent != parent[i]) & (settled | (np.arange(len(parent)) > i)))
        if cross is not None:
            rest = rest[cross[rest] != cross[i]]
        rest = own.likely(i, rest)
        for at in range(0, len(rest), 32):
            part = rest[at : at + 32]
            part = part[parent[part] != parent[i]]
            for j in own.linked(i, part).tolist() if len(part) else []:
                if parent[i] != parent[j]:
                    links.append((int(own.nodes[i]), int(own.nodes[j])))
                    parent[parent == parent[j]] = parent[i]
    return links


def _part(parts: str):
    return F.pmod(F.xxhash64("node", F.lit(1)), F.col(parts)).cast("int")


def _upto(parts: str):
    return F.sequence(F.lit(0), F.col(parts) - 1)


def _large_group_links(members: DataFrame, least: dict[int, int], percent: int) -> DataFrame:
    """Links (a, b) within large groups; ``members`` has leader, node, n, sig and set.

    First every member meets the at most PIVOTS pivots of its group, in parts of
    about TILE members or TILE_BYTES of sets: work and rows grow with the members, and all that reach the
    group's core are done. Only the loose ones are then compared, with each other
    and with the settled ones, in tiles of as much a side.
    """
    # many members or few with very large sets: a side is bounded by both
    heavy = members.groupBy("leader").agg(F.sum(F.length("set")).alias("bytes"))
    members = members.join(frozen(heavy, "near-bytes"), "leader")
    parts = F.greatest(F.lit(1), F.ceil(F.col("n") / TILE), F.ceil(F.col("bytes") / TILE_BYTES)).cast("int")
    pivots = members.groupBy("leader", F.pmod(F.xxhash64("node"), F.lit(PIVOTS)).alias("k")).agg(F.min("node").alias("node")).select("leader", "node", F.lit(True).alias("pivot"))
    rows = members.join(pivots, ["leader", "node"], "left").withColumns({"parts": parts, "pivot": F.coalesce("pivot", F.lit(False))})
    rows = rows.withColumn("part", F.explode(F.when(F.col("pivot"), _upto("parts")).otherwise(F.array(_part("parts")))))

    def meet(group):
        links, loose = pivot_links(_Sets(group, least, percent), group.column("pivot").to_numpy(zero_copy_only=False))
        key = group.column("leader")[0].as_py()
        a, b = [x for x, _ in links] + loose, [y for _, y in links] + [None] * len(loose)
        return pa.table({"leader": pa.array([key] * len(a), pa.int64()), "a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    met = frozen(rows.select("leader", "part", "node", "pivot", "sig", "set").groupBy("leader", "part").applyInArrow(meet, "leader long, a long, b long"), "near-met")
    loose = frozen(met.where("b is null").select("leader", F.col("a").alias("node")).distinct(), "near-loose")
    weights = members.select("leader", "node", F.length("set").alias("size")).join(loose, ["leader", "node"])
    counts = frozen(weights.groupBy("leader").agg(F.count("*").alias("n_loose"), F.sum("size").alias("loose_bytes")), "near-loose-groups")
    rows = members.join(counts, "leader").join(loose.withColumn("loose", F.lit(True)), ["leader", "node"], "left").withColumn("loose", F.coalesce("loose", F.lit(False)))
    sides = lambda n, size: F.greatest(F.lit(1), F.ceil(n / TILE), F.ceil(size / TILE_BYTES)).cast("int")
    rows = rows.withColumns({"across": sides(F.col("n_loose"), F.col("loose_bytes")), "down": sides(F.col("n") - F.col("n_loose"), F.col("bytes") - F.col("loose_bytes"))})
    rows = rows.withColumn("own", F.when(F.col("loose"), _part("across")).otherwise(_part("down")))
    # a tile is (loose part, loose part, true) or (loose part, settled part, false)
    tile = lambda i, j, among: F.struct(i.alias("i"), j.alias("j"), F.lit(among).alias("among"))
    of_loose = F.concat(
        F.transform(_upto("across"), lambda j: tile(F.least(j, F.col("own")), F.greatest(j, F.col("own")), True)), F.transform(_upto("down"), lambda j: tile(F.col("own"), j, False))
    )
    rows = rows.withColumn("tile", F.explode(F.when(F.col("loose"), of_loose).otherwise(F.transform(_upto("across"), lambda i: tile(i, F.col("own"), False)))))

    def compare(key, group):
        _, i, j, among = (k.as_py() for k in key)
        loose = group.column("loose").to_numpy(zero_copy_only=False)
        cross = ~loose if not among else group.column("own").to_numpy() == j if i != j else None
        links = tile_links(_Sets(group, least, percent), ~loose, cross)
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    rows = rows.select("leader", "tile.i", "tile.j", "tile.among", "node", "own", "loose", "sig", "set")
    tiles = rows.groupBy("leader", "i", "j", "among").applyInArrow(compare, "a long, b long")
    return met.where("b is not null").select("a", "b").unionByName(tiles)


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) of every node in ``links`` (a, b): root is the least node reachable.

    Alternating large-star and small-star steps, each frozen; no step gathers a
    node's neighbours, only their least. Edges never grow in number, and the
    steps needed grow with the logarithm of a component's size.
    """
    edges = frozen(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), name)
    seen = None
    while True:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = frozen(large, name)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
        edges = frozen(small.select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).where("u <> v").distinct(), name)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.count(F.when(F.col("v") > F.col("u"), 1))).first()
        if state == seen:
            break
        seen = state
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_duplicates(docs: DataFrame, percent: int = 80, k: int = 5, miss: float = 1e-5) -> DataFrame:
    """Per document: doc_id, text_hash, n_shingles, component_id, kept.

    A document's set is its distinct ``k``-word shingles (A-Z as a-z). Documents
    with equal sets form a class; only classes are compared. Classes that share a
    band of their MinHash signatures are candidates: 25 bands of 5 values miss a
    pair at 0.8 with a probability of 5e-5, at 0.85 with 4e-7. A candidate pair's signatures are
    compared in batches of 32; it is dropped once the posterior probability that
    it is similar enough falls under ``miss``. Survivors are confirmed on full sets:
    100 * intersection >= percent * union.

    The classes of a bucket are grouped under its least class. Groups of up to
    SMALL_GROUP members give their pairs as rows. In larger ones every member is
    compared with a few pivots first, and only those that do not reach the pivots'
    core are compared further, in tiles that return a spanning forest of their
    links: no group's pairs are all emitted and none is capped. Components come from star contractions over
    frozen links; no link, component or fingerprint passes through the driver.

    component_id is the least doc_id of the component; kept is doc_id <=>
    component_id. Null and empty texts have no set: each is its own component.
    A null doc_id counts as the greatest; rows equal in doc_id and text share one
    result; a very long text is one row, and tiles are bounded by the bytes of their
    sets; an empty table gives an empty result; other columns are ignored.
    """
    least = least_matches(percent / 100, miss)
    every = frozen(_prepared(docs, k), "near-docs")
    spark = docs.sparkSession
    classes = every.where("digest is not null").groupBy("digest").agg(
        F.min("doc_id").alias("first_id"), F.min(F.struct("doc_id", "text_hash")).alias("of"), F.first("sig").alias("sig"), F.first("bands").alias("bands")
    )
    classes = frozen(classes.withColumn("node", F.monotonically_increasing_id()), "near-classes")
    banded = classes.select("node", F.explode("bands").alias("band"))
    buckets = frozen(banded.groupBy("band").agg(F.min("node").alias("leader"), F.count("*").alias("c")).where("c > 1").select("band", "leader"), "near-buckets")
    members = frozen(banded.join(buckets, "band").select("leader", "node").distinct(), "near-members")
    counts = frozen(members.groupBy("leader").agg(F.count("*").alias("n")), "near-groups")
    members = members.join(counts, "leader")
    small = members.where(F.col("n") <= SMALL_GROUP).select("leader", "node")
    pairs = small.select("leader", F.col("node").alias("a")).join(small.select("leader", F.col("node").alias("b")), "leader").where("a < b").select("a", "b").distinct()
    sigs = classes.select("node", "sig")
    likely = pairs.join(sigs.select(F.col("node").alias("a"), F.col("sig").alias("sig_a")), "a").join(sigs.select(F.col("node").alias("b"), F.col("sig").alias("sig_b")), "b")
    likely = frozen(likely.where(_signature_filter(least)("sig_a", "sig_b")).select("a", "b"), "near-likely")
    large = frozen(members.where(F.col("n") > SMALL_GROUP), "near-large")
    wanted = likely.select(F.explode(F.array("a", "b")).alias("node")).unionByName(large.select("node")).distinct()
    wanted = classes.join(wanted, "node", "left_semi").select("node", F.col("of.doc_id").alias("doc_id"), F.col("of.text_hash").alias("text_hash"))
    sets = frozen(_sets(docs, frozen(wanted, "near-wanted"), k), "near-sets")
    exact = likely.join(sets.select(F.col("node").alias("a"), F.col("set").alias("set_a")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("set_b")), "b")
    links = exact.where(_exact_filter(percent)("set_a", "set_b")).select("a", "b")
    inner = _large_group_links(frozen(large.join(sigs, "node").join(sets, "node"), "near-large-sets"), least, percent)
    roots = frozen(components(links.unionByName(inner)), "near-roots")
    # per component its least doc_id, then per class
    placed = classes.select("node", "digest", "first_id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    ids = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    labels = frozen(placed.join(frozen(ids, "near-ids"), "root").select("digest", "component_id"), "near-labels")
    out = every.select("doc_id", "text_hash", "n_shingles", "digest").join(labels, "digest", "left")
    own = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "text_hash", "n_shingles", own.alias("component_id"), F.col("doc_id").eqNullSafe(own).alias("kept"))


def _sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(node, set) of the wanted classes, from one document of each."""
    rows = docs.select(F.col("doc_id").alias("__id"), "text", text_hash("text").alias("__hash"))
    rows = rows.where(_may_be_among(wanted, "text_hash")("__hash"))
    # shuffled at every size: what is wanted grows with the documents
    rows = rows.hint("merge").join(wanted, rows["__id"].eqNullSafe(wanted["doc_id"]) & (rows["__hash"] == wanted["text_hash"])).select("node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in shingle_sets(data, offsets, k)], pa.binary())], names=["node", "set"])

    return rows.mapInArrow(run, "node long, set binary").groupBy("node").agg(F.first("set").alias("set"))


def _may_be_among(rows: DataFrame, column: str):
    """A filter that passes all values of ``rows``' column and few others, so that few texts are shuffled.

    One bit for each value of FILTER_BITS, so it never takes over 2 MB on the driver
    or a worker; with very many values it passes everything, and the join decides.
    """
    spot = F.pmod(F.col(column), F.lit(FILTER_BITS))
    words = rows.groupBy(F.floor(spot / 64).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (spot % 64).cast("int"))).alias("bits"))
    table = np.zeros(FILTER_BITS // 64, np.uint64)
    for batch in words.toArrow().to_batches():
        table[batch.column(0).to_numpy(zero_copy_only=False)] = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    known = rows.sparkSession.sparkContext.broadcast(table)

    @pandas_udf("boolean")
    def keep(values: pd.Series) -> pd.Series:
        at = values.to_numpy(dtype=np.int64) % FILTER_BITS
        return pd.Series((known.value[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1)

    return keep


def without_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one row of each near-duplicate component, its own columns unchanged."""
    kept = near_duplicates(docs, **options).where("kept").select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct()
    rows = docs.withColumn("__own", text_hash("text"))
    rows = rows.join(kept, rows["doc_id"].eqNullSafe(kept["__id"]) & (rows["__own"] == kept["__hash"]), "left_semi")
    return rows.dropDuplicates(["doc_id", "__own"]).drop("__own")
