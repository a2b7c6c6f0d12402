"""Compressing a collection of similar JPEG files into an archive of deltas, and restoring it."""

from __future__ import annotations

import struct
import time
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foldwise.config import DedupConfig
from foldwise.functions import codecs, jpeg
from foldwise.functions.bits import Damaged
from foldwise.operators import delta, detect, stats
from foldwise.operators.sketch import exact_sketch
from foldwise.plans.freeze import frozen
from foldwise.sources import records

# ---- one record ----


def pack_record(base: str, name: str, sizes: list[int], tail: bytes, header: bytes, flag: int, columns: list[bytes], residual: bytes) -> bytes:
    """Names, 13 sizes, the tail marker, header delta, flags and columns, the residual; little-endian, no padding."""
    numbers = [*sizes, len(header), *map(len, columns), len(residual)]
    return b"".join([base.encode(), b"\0", name.encode(), b"\0", struct.pack("<13I", *numbers), tail.ljust(2, b"\0"), header, bytes([flag]), *columns, residual])


def unpack_record(data: bytes, at: int = 0) -> tuple[dict, int]:
    """(fields, end) of the record that begins at ``at``."""
    end = data.index(b"\0", at)
    base = data[at:end].decode()
    at, end = end + 1, data.index(b"\0", end + 1)
    name, at = data[at:end].decode(), end + 1
    numbers = struct.unpack_from("<13I", data, at)
    at += 52
    tail, at = data[at : at + 2], at + 2
    header, at = data[at : at + numbers[7]], at + numbers[7]
    flag, at = data[at], at + 1
    parts = []
    for size in numbers[8:13]:
        parts.append(data[at : at + size])
        at += size
    return {"base": base, "name": name, "sizes": list(numbers[:7]), "tail": tail if tail[0] else b"", "header": header, "flag": flag, "columns": parts[:4], "residual": parts[4]}, at


def encode_pair(base: bytes, target: bytes, base_name: str, name: str, fixed: bool, config: DedupConfig) -> dict:
    """The record of ``target`` against ``base``; matched and blocks count blocks of all planes."""
    one, two = jpeg.decode(base), jpeg.decode(target)
    copies, inserts, counts, residual = [], [], [], []
    for mine, theirs in zip(one.planes, two.planes, strict=True):
        c, i, r = delta.instructions(delta.coefficient_grid(mine), delta.coefficient_grid(theirs), fixed, config.collapse_runs)
        copies += c
        inserts += i
        residual += r
        counts += [(len(c), len(i), len(r))]
    blocks = np.frombuffer(b"".join(residual), "<i2").reshape(-1, 64) if residual else np.zeros((0, 64), np.int16)
    coded = [codecs.pack_column(v) for v in ([c[0] for c in copies], [c[1] for c in copies], [c[2] for c in copies], inserts)]
    flag = sum(8 >> i for i, (_, is_coded) in enumerate(coded) if is_coded)
    header = codecs.delta_bytes(one.header, two.header)
    shape = [two.planes[0].shape[1], two.planes[0].shape[0], two.planes[1].shape[1], two.planes[1].shape[0]]
    total = sum(p.shape[0] * p.shape[1] for p in two.planes)
    packed = codecs.pack_residual(blocks)
    record = pack_record(base_name, name, [*shape, *[n for _, n, _ in counts]], two.tail, header, flag, [c for c, _ in coded], packed)
    sizes = [len(record) - len(header) - sum(len(c) for c, _ in coded) - len(packed), len(header), *[len(c) for c, _ in coded], len(packed)]
    return {"record": record, "matched": total - len(residual), "blocks": total, "parts": sizes}


def encode_bytes(base: bytes, target: bytes, config: DedupConfig) -> bytes:
    """The byte delta of the files, or of their coefficients if ``data_type`` is decoded, which keeps the target's header too."""
    if config.data_type == "raw":
        return b"R" + codecs.delta_bytes(base, target)
    one, two = jpeg.decode(base), jpeg.decode(target)
    header = codecs.delta_bytes(one.header, two.header)
    shape = struct.pack("<6H", *[n for p in two.planes for n in p.shape[:2]])
    return b"D" + struct.pack("<I", len(header)) + header + shape + two.tail.ljust(2, b"\0") + codecs.delta_bytes(_planes(one), _planes(two))


def _planes(image: jpeg.Coefficients) -> bytes:
    return b"".join(p.astype("<i2").tobytes() for p in image.planes)


def decode_bytes(base: bytes, record: bytes) -> bytes:
    if record[:1] == b"R":
        return codecs.undelta_bytes(base, record[1:])
    one, n = jpeg.decode(base), struct.unpack_from("<I", record, 1)[0]
    header, at = codecs.undelta_bytes(one.header, record[5 : 5 + n]), 5 + n
    shapes, tail = struct.unpack_from("<6H", record, at), record[at + 12 : at + 14]
    data, planes, first = codecs.undelta_bytes(_planes(one), record[at + 14 :]), [], 0
    for rows, columns in zip(shapes[::2], shapes[1::2], strict=True):
        size = rows * columns * 128
        planes.append(np.frombuffer(data, "<i2", size // 2, first).reshape(rows, columns, 64).astype(np.int16))
        first += size
    return jpeg.encode(jpeg.Coefficients(header, planes, tail if tail[0] else b""))


def composed_bytes(one: bytes, two: bytes) -> bytes:
    """The byte record from one's base to two's target, of two records made alike."""
    if one[:1] != two[:1]:
        raise Damaged("records of two kinds")
    if one[:1] == b"R":
        return b"R" + codecs.composed_delta(one[1:], two[1:])
    n, m = struct.unpack_from("<I", one, 1)[0], struct.unpack_from("<I", two, 1)[0]
    header = codecs.composed_delta(one[5 : 5 + n], two[5 : 5 + m])
    return b"D" + struct.pack("<I", len(header)) + header + two[5 + m : 19 + m] + codecs.composed_delta(one[19 + n :], two[19 + m :])


def decode_pair(base: bytes, record: dict) -> bytes:
    """The target's file from its base's file and its record."""
    one = jpeg.decode(base)
    columns = [codecs.unpack_column(c, bool(record["flag"] & (8 >> i))) for i, c in enumerate(record["columns"])]
    copies, inserts = list(zip(*columns[:3], strict=True)), columns[3]
    residual = [b.astype("<i2").tobytes() for b in codecs.unpack_residual(record["residual"])]
    w, h, cw, ch, *counts = record["sizes"]
    planes, c_at, i_at, r_at = [], 0, 0, 0
    for mine, (columns_, rows), n in zip(one.planes, ((w, h), (cw, ch), (cw, ch)), counts, strict=True):
        own = inserts[i_at : i_at + n]
        taken = sum(own)
        grid = delta.replay(delta.coefficient_grid(mine), [columns_] * rows, copies[c_at:], own, residual[r_at : r_at + taken])
        flat = [b for row in grid for b in row]
        planes.append(np.frombuffer(b"".join(flat), "<i2").reshape(rows, columns_, 64).astype(np.int16))
        c_at += _used(own, copies[c_at:], columns_)
        i_at, r_at = i_at + n, r_at + taken
    return jpeg.encode(jpeg.Coefficients(codecs.undelta_bytes(one.header, record["header"]), planes, record["tail"]))


def _used(inserts: list[int], copies: list[tuple], width: int) -> int:
    """How many copies belong to a plane: one behind each insert count that leaves its row open."""
    used = filled = 0
    for count in inserts:
        filled += count
        if filled < width:
            filled += copies[used][2]
            used += 1
        if filled == width:
            filled = 0
    return used


# ---- tables ----


def scan(spark: SparkSession, path: str, config: DedupConfig) -> DataFrame:
    """path, dir, length, content, batch, seq: the files in batches, in a fixed order."""
    return batched(records.files(spark, path), config)


def batched(files: DataFrame, config: DedupConfig) -> DataFrame:
    """``files`` (path, dir, length, content) with batch and seq; only names and lengths are ordered, contents are joined."""
    return files.join(numbered(files, config), "path")


def numbered(files: DataFrame, config: DedupConfig) -> DataFrame:
    """path, batch, seq of ``files`` (path, dir, length)."""
    keys = files.select("path", "dir", "length")
    if config.road_num > 1:
        # a road's files are of the same number modulo the roads: files in turn, or whole directories
        keys = keys.withColumn("road", F.pmod(F.xxhash64("path" if config.chaos else "dir"), F.lit(config.road_num)))
        roads = [_filled(keys.where(F.col("road") == r), config).withColumn("batch", F.col("batch") * config.road_num + r) for r in range(config.road_num)]
        keys = reduce(DataFrame.unionByName, roads)
    else:
        keys = _filled(keys, config)
    # a batch is bounded by its bytes, so one task can number it
    order = Window.partitionBy("batch").orderBy("path")
    return frozen(keys.select("path", "batch", F.row_number().over(order).cast("long").alias("seq")), "batches")


def _filled(keys: DataFrame, config: DedupConfig) -> DataFrame:
    """``keys`` (path, dir, length) with batch: by directories that reach the patch size, or by files."""
    if config.chunking == "f":
        return records.fixed_batches(keys, config.patch_size, ["dir", "path"], "length")
    dirs = records.variable_batches(keys.select("dir", F.col("length").alias("size")), config.patch_size, "dir").select(F.col("dir").alias("own"), "batch")
    return keys.join(dirs, keys["dir"].eqNullSafe(dirs["own"])).drop("own")


_SKETCH = "path string, batch long, seq long, length long, ok boolean, decoded long, luma long, sf array<long>, pos array<long>, dc array<long>"


def sketched(files: DataFrame, config: DedupConfig) -> DataFrame:
    """path, batch, seq, length, ok, decoded, luma, sf, pos, dc; what cannot be decoded has ok = false."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, all_ = [], list(batch.itertuples(index=False))
            for i, image in jpeg.decoded(batch["content"]):
                row = all_[i]
                try:
                    if image is None:
                        raise Damaged("no baseline image")
                    found = (config.sketch or exact_sketch)(image.planes, bytes(row.content), config)
                    ok, size = found["windows"] > 0, sum(p.size * 2 for p in image.planes)
                    rows.append((row.path, row.batch, row.seq, row.length, True, size, image.planes[0].size * 2, *[found[c] if ok else [] for c in ("sf", "pos", "dc")]))
                except jpeg.UNREADABLE:
                    rows.append((row.path, row.batch, row.seq, row.length, False, 0, 0, [], [], []))
            yield pd.DataFrame(rows, columns=[x.split(" ")[0] for x in _SKETCH.split(", ")])

    return files.select("path", "batch", "seq", "length", "content").mapInPandas(run, _SKETCH)


def choose_bases(sketches: DataFrame, config: DedupConfig) -> DataFrame:
    """batch, t, b, score, first_k, fix_flag: sequence numbers within a batch."""
    zipped = F.posexplode(F.arrays_zip("sf", "pos", "dc")).alias("k", "v")
    # batches are kept apart by a number that orders by batch first
    slots = sketches.where("ok").select("batch", F.col("seq").alias("id"), zipped).select("batch", "id", "k", "v.sf", "v.pos", "v.dc")
    slots = slots.withColumn("id", F.struct("batch", "id"))
    pairs = detect.candidates(slots, config.feature_check, ("batch",))
    best = pairs.where(F.col("score") >= config.min_score).groupBy("t").agg(
        F.min(F.struct((-F.col("score")).alias("score"), "first_k", F.col("b.id").alias("b"), "same_pos")).alias("m")
    )
    return best.select("t.batch", F.col("t.id").alias("t"), "m.b", (-F.col("m.score")).alias("score"), "m.first_k", (1 - F.col("m.same_pos")).alias("fix_flag"))


def compress(files: DataFrame, config: DedupConfig, seconds: dict[str, float] | None = None, numbers: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(archive, originals) of files with path, batch, seq, length and content, or batch and seq in ``numbers`` beside them.

    archive: batch, path, base, method, record, matched, blocks, parts, length,
    decoded, luma; originals: batch, path, content, reason (undecodable, unmatched,
    low delta), decoded, luma, based (a record may have it as its base). Sketches
    travel without contents. These are joined once, with what is to become of each
    file, and then only those of pairs. ``seconds`` gets the time of each stage.
    """
    seconds = {} if seconds is None else seconds
    def made() -> DataFrame:
        if numbers is None:
            return frozen(sketched(files, config), "sketches")
        alone = sketched(files.withColumns({"batch": F.lit(0).cast("long"), "seq": F.lit(0).cast("long")}), config)
        return frozen(frozen(alone.drop("batch", "seq"), "unnumbered").join(numbers, "path"), "sketches")

    sketches = _timed(seconds, "sketch", made)
    best = _timed(seconds, "detect", lambda: frozen(choose_bases(sketches, config), "bases"))
    names = sketches.select("batch", "seq", "path", "decoded", "luma")
    pairs = best.join(names.withColumnsRenamed({"seq": "t", "path": "target"}), ["batch", "t"]).join(names.select("batch", F.col("seq").alias("b"), F.col("path").alias("base")), ["batch", "b"])
    pairs = frozen(pairs, "pairs")
    targets, bases = (pairs.select(F.col(c).alias("path"), F.lit(True).alias(f"is_{c}")).distinct() for c in ("target", "base"))
    roles = sketches.select("path", "batch", "ok", "decoded", "luma").join(targets, "path", "left").join(bases, "path", "left").na.fill(False, ["is_target", "is_base"])
    held = _timed(seconds, "detect", lambda: frozen(files.select("path", "content").join(roles, "path"), "files"))
    own = held.where("is_target").select(F.col("path").alias("target"), F.col("content").alias("own"))
    their = held.where("is_base").select(F.col("path").alias("base"), F.col("content").alias("their"))
    joined = pairs.join(own, "target").join(their, "base")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for row in batch.itertuples(index=False):
                own, their = bytes(row.own), bytes(row.their)
                if config.delta == "bytes":
                    record = encode_bytes(their, own, config)
                    made = {"record": record, "matched": 0, "blocks": 0, "parts": [len(row.base) + len(row.target) + 6, 0, 0, 0, 0, 0, len(record)]}
                else:
                    made = encode_pair(their, own, row.base, row.target, not row.fix_flag and not config.force_indexed, config)
                low = config.delta == "blocks" and made["matched"] < config.least_matched * made["blocks"]
                rows.append((row.batch, row.target, row.base, config.delta, made["record"], made["matched"], made["blocks"], made["parts"], len(own), row.decoded, row.luma, low))
            yield pd.DataFrame(rows, columns=["batch", "path", "base", "method", "record", "matched", "blocks", "parts", "length", "decoded", "luma", "low"])

    coded = joined.select("batch", "target", "base", "fix_flag", "own", "their", "decoded", "luma").mapInPandas(
        run, "batch long, path string, base string, method string, record binary, matched long, blocks long, parts array<long>, length long, decoded long, luma long, low boolean"
    )
    coded = _timed(seconds, "delta", lambda: frozen(coded, "coded"))
    archive = coded.where("not low").drop("low")
    left = held.where("not is_target").withColumn("low", F.lit(False)).unionByName(held.where("is_target").join(coded.where("low").select("path", "low"), "path"))
    reason = F.when(~F.col("ok"), "undecodable").when(F.col("low"), "low delta").otherwise("unmatched")
    return archive, left.select("batch", "path", "content", reason.alias("reason"), "decoded", "luma", F.col("is_base").alias("based"))


def _timed(seconds: dict[str, float], stage: str, work):
    began = time.time()
    out = work()
    seconds[stage] = seconds.get(stage, 0.0) + time.time() - began
    return out


def composed(archive: DataFrame) -> DataFrame:
    """Byte records (path, base, method, record) against bases that are originals: chains are composed.

    Each round joins every record with its base's record and doubles the reach, so
    a chain of length n takes log2(n) rounds, and restoring then takes one.
    """

    @F.pandas_udf("binary")
    def joined(one: pd.Series, two: pd.Series) -> pd.Series:
        return pd.Series([b if a is None else composed_bytes(bytes(a), bytes(b)) for a, b in zip(one, two, strict=True)])

    rows = frozen(archive.where("method = 'bytes'").select("path", "base", "method", "record"), "records")
    while True:
        below = rows.select(F.col("path").alias("base"), F.col("base").alias("further"), F.col("record").alias("first"))
        both = rows.join(below, "base", "left")
        if both.where("further is not null").isEmpty():
            return rows
        rows = frozen(both.select("path", F.coalesce("further", "base").alias("base"), "method", joined("first", "record").alias("record")), "records")


def restore(archive: DataFrame, originals: DataFrame) -> DataFrame:
    """(path, content) of every file: originals, then record by record what has its base.

    One join a round restores all files whose bases are there, so a chain of length
    n takes n rounds; each round is frozen. Chains of byte records can be cut short
    by :func:`composed` first. Of originals that say so (``based``), only those that
    may be bases are joined.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [
                decode_bytes(bytes(r.content), bytes(r.record)) if r.method == "bytes" else decode_pair(bytes(r.content), unpack_record(bytes(r.record))[0])
                for r in batch.itertuples(index=False)
            ]
            yield pd.DataFrame({"path": batch["path"], "content": made})

    done = originals.select("path", "content")
    fresh = originals.where("based").select("path", "content") if "based" in originals.columns else done
    pending = frozen(archive.select("path", "base", "method", "record"), "pending")
    while not pending.isEmpty():
        ready = pending.join(fresh.withColumnRenamed("path", "base"), "base")
        fresh = frozen(ready.select("path", "method", "record", "content").mapInPandas(run, "path string, content binary"), "restored")
        if fresh.isEmpty():
            raise Damaged("records whose bases are nowhere")
        pending = frozen(pending.join(fresh.select("path"), "path", "left_anti"), "pending")
        done = done.unionByName(fresh)
    return done


PARTS = ("meta", "header", "x", "y", "len", "inl", "residual")


def metrics(files: DataFrame, archive: DataFrame, originals: DataFrame) -> DataFrame:
    """One row a batch, and one for all with a null batch.

    Sizes: files, raw, undecodable, unmatched, omitted (low delta), packed (the
    archive, and its seven parts), final, decoded, detected (first planes only),
    delta_raw, delta_decoded, records. Ratios as the report names them.
    """
    size = F.length("content")
    of = lambda reason: F.sum(F.when(F.col("reason") == reason, size).otherwise(0))
    raw = files.groupBy("batch").agg(F.count("*").alias("files"), F.sum("length").alias("raw"))
    kept = originals.groupBy("batch").agg(
        of("undecodable").alias("undecodable"), of("unmatched").alias("unmatched"), of("low delta").alias("omitted"), F.sum("decoded").alias("kept_decoded"), F.sum("luma").alias("kept_luma")
    )
    packed = archive.groupBy("batch").agg(
        F.count("*").alias("records"), F.sum("length").alias("coded_raw"), F.sum("decoded").alias("coded_decoded"), F.sum("luma").alias("coded_luma"),
        *[F.sum(F.get("parts", i)).alias(name) for i, name in enumerate(PARTS)],
    )
    rows = raw.join(kept, "batch", "left").join(packed, "batch", "left").na.fill(0)
    total = rows.rollup("batch").agg(*[F.sum(c).alias(c) for c in rows.columns if c != "batch"])
    total = total.withColumn("packed", sum((F.col(c) for c in PARTS[1:]), F.col(PARTS[0])))
    total = total.withColumns(
        {
            "final": F.col("packed") + F.col("unmatched") + F.col("omitted"), "decoded": F.col("kept_decoded") + F.col("coded_decoded"), "detected": F.col("kept_luma") + F.col("coded_luma"),
            "delta_raw": F.col("coded_raw") + F.col("omitted"), "delta_decoded": F.col("coded_decoded"), "usable": F.col("raw") - F.col("undecodable"),
        }
    )
    over = lambda a, b: F.when(F.col(b) != 0, F.col(a) / F.col(b))
    total = total.withColumns(
        {
            "ratio": over("usable", "final"), "similar": F.col("usable") - F.col("unmatched"), "success_rate": F.when(F.col("usable") != 0, 1 - F.col("unmatched") / F.col("usable")),
            "jpeg_ratio": over("decoded", "usable"), "detected_ratio": over("decoded", "detected"), "delta_ratio": over("decoded", "delta_decoded"), "omitted_ratio": over("omitted", "delta_raw"),
            "similar_ratio": F.when(F.col("final") != F.col("unmatched"), (F.col("usable") - F.col("unmatched")) / (F.col("final") - F.col("unmatched"))),
        }
    )
    return total.drop("kept_decoded", "kept_luma", "coded_decoded", "coded_luma", "coded_raw")


def similarity(archive: DataFrame) -> DataFrame:
    """(bin, targets): shares of copied blocks in twentieths."""
    return stats.similarity_histogram(archive.where("blocks > 0").select("matched", F.col("blocks").alias("cells")))


def report(totals: dict, batches: int, seconds: dict[str, float]) -> str:
    """The text report of a compression: totals (the null-batch row of :func:`metrics`), batches, and the stages' seconds."""
    spent, mb = sum(seconds.values()), 1 << 20
    rate = lambda size, time_: f"{size / mb / time_:.3f} MB/s" if time_ else "-"
    number = lambda x: "-" if x is None else f"{x:.6f}"
    lines = [f"{name:<20}: {number(totals[key])}" for name, key in (("compression ratio", "ratio"), ("similar ratio", "similar_ratio"), ("success rate", "success_rate"), ("jpeg ratio", "jpeg_ratio"), ("detected size ratio", "detected_ratio"), ("delta size ratio", "delta_ratio"), ("omitted delta ratio", "omitted_ratio"))]
    lines += [f"{name:<20}: {totals[key]} bytes" for name, key in (("available size", "usable"), ("compressed size", "final"), ("unavailable size", "undecodable"), ("similar size", "similar"))]
    lines += [f"{'bandwidth':<20}: {rate(totals['usable'], spent)}", f"{'time':<20}: {spent:.3f} s", f"{'batches':<20}: {batches}, {totals['usable'] / max(batches, 1):.0f} bytes each on average"]
    whole = max(1, totals["packed"])
    lines += [f"{'archive: ' + part:<20}: {totals[part] / whole:.2%}, {totals[part]} bytes" for part in (*PARTS, "packed")]
    sizes = {"scan": "usable", "sketch": "detected", "detect": "detected", "delta": "delta_decoded", "write": "packed"}
    lines += [f"{'stage ' + stage:<20}: {time_ / 60:.4f} minutes, {rate(totals[sizes.get(stage, 'usable')], time_)}" for stage, time_ in seconds.items()]
    return "\n".join(lines) + "\n"


# ---- files ----


def _put(folder: str, name: str, data: bytes) -> None:
    """One file, written under a name of its own and then moved, so a task that is run twice never leaves a mixture."""
    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
    to = f"{root.rstrip('/')}/{name}"
    parent, last = to.rsplit("/", 1)
    system.create_dir(parent, recursive=True)
    draft = f"{parent}/.{last}.{uuid.uuid4().hex}"
    with system.open_output_stream(draft) as stream:
        stream.write(data)
    system.move(draft, to)


def write_archives(archive: DataFrame, folder: str) -> None:
    """A file a batch in a folder that all executors reach, its records one behind the other.

    ``<batch>.idp`` holds block records, ``<batch>.vcd`` byte records: base, name, size, delta.
    """

    def write(rows) -> None:
        def done(key, parts) -> None:
            if parts:
                _put(folder, f"{key[0]}.{'vcd' if key[1] == 'bytes' else 'idp'}", b"".join(parts))

        held, parts = None, []
        for row in rows:
            if (key := (row["batch"], row["method"])) != held:
                done(held, parts)
                held, parts = key, []
            record = bytes(row["record"])
            if row["method"] == "bytes":
                record = row["base"].encode() + b"\0" + row["path"].encode() + b"\0" + struct.pack("<I", len(record)) + record
            parts.append(record)
        done(held, parts)

    rows = archive.select("batch", "method", "path", "base", "record")
    rows.repartition("batch").sortWithinPartitions("batch", "method", "path").rdd.foreachPartition(write)


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """path, base, method, record of all records in the archive files of a folder."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, data in zip(batch["name"], batch["content"], strict=True):
                data, at, rows = bytes(data), 0, []
                while at < len(data):
                    if name.endswith(".vcd"):
                        base, path, rest = data[at:].split(b"\0", 2)
                        at += len(base) + len(path) + 6
                        end = at + struct.unpack_from("<I", rest)[0]
                        rows.append((path.decode(), base.decode(), "bytes", data[at:end]))
                    else:
                        fields, end = unpack_record(data, at)
                        rows.append((fields["name"], fields["base"], "blocks", data[at:end]))
                    at = end
                yield pd.DataFrame(rows, columns=["path", "base", "method", "record"])

    return records.files(spark, folder, "*.{idp,vcd}").select("name", "content").mapInPandas(run, "path string, base string, method string, record binary")


def write_files(restored: DataFrame, folder: str) -> None:
    """Each file (path, content) under ``folder``, by its whole relative path."""

    def write(rows) -> None:
        for row in rows:
            _put(folder, row["path"], bytes(row["content"]))

    restored.select("path", "content").rdd.foreachPartition(write)


def mismatches(restored: DataFrame, reference: DataFrame) -> DataFrame:
    """Paths whose restored content differs from the reference's, or is missing.

    A reference without directories (path, content) is compared by file names: each
    of its files must be among the restored ones of that name.
    """
    own = restored.select("path", F.md5("content").alias("is"))
    wanted = reference.select("path", F.md5("content").alias("was"))
    flat = not wanted.select(F.coalesce(F.bool_or(F.col("path").contains("/")), F.lit(True))).first()[0]
    if flat:
        own = own.select(F.regexp_extract("path", "([^/]*)$", 1).alias("path"), "is")
    own = own.distinct().withColumn("here", F.lit(True))
    return wanted.join(own, (wanted["path"] == own["path"]) & (wanted["was"] == own["is"]), "left_anti").select("path")
