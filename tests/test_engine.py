import os

import duckdb
import numpy as np
import pytest

from pyspark.sql import functions as F

from foldwise import queries
from foldwise.config import DedupConfig
from foldwise.functions import jpeg
from foldwise.functions.bits import Damaged
from foldwise.operators import detect, sketch
from foldwise.plans import archive
from foldwise.sources import records
from foldwise.streaming import detect as stream

DATA = "/root/testdata/sf0.001"


def rows_of(values):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in values), key=repr)


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in "documents embeddings conversations events".split():
        path = f"{DATA}/{name}.parquet"
        connection.execute(f"create view {name} as select * from read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return connection


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_against_sql(spark, duck, name):
    found = queries.queries()[name](spark, DATA)
    columns = sorted(found.columns)
    wanted = duck.execute(queries.oracle_sql()[name])
    names = [d[0] for d in wanted.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert rows_of(found.select(*columns).collect()) == rows_of([r[i] for i in order] for r in wanted.fetchall())


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_query_runs(spark, name):
    rows = queries.queries()[name](spark, DATA).collect()
    assert rows
    if "restored" in rows[0].asDict():
        assert all(r["restored"] for r in rows)


def test_bases_against_brute_force(spark):
    slots = queries._slots(spark, DATA)
    held: dict = {}
    for r in slots.collect():
        held.setdefault(r["id"], {})[r["k"]] = (r["sf"], r["pos"])
    wanted = {}
    for t, own in held.items():
        options = []
        for b, other in held.items():
            same = [k for k in own if k in other and own[k][0] == other[k][0]] if b < t else []
            if same:
                options.append((-len(same), min(same), b, int(not any(own[k][1] == other[k][1] for k in same))))
        if options:
            score, _, b, fix = min(options)
            wanted[t] = (b, -score, fix)
    found = {r["t"]: (r["b"], r["score"], r["fix_flag"]) for r in detect.best_base(detect.candidates(slots)).collect()}
    assert found == wanted
    assert all(b < t for t, (b, _, _) in found.items())


def test_nulls_and_empty_tables(spark):
    rows = spark.createDataFrame([(1, None, None), (2, "", "a"), (3, "one two three four five", "a"), (4, "one two three four five", None)], "doc_id long, text string, source string")
    best = detect.best_base(detect.candidates(sketch.exploded(sketch.sketches(rows)))).collect()
    assert [(r["t"], r["b"]) for r in best] == [(4, 3)]
    assert sketch.exploded(sketch.sketches(rows.where("false"))).count() == 0
    assert records.variable_batches(rows.where("false").withColumn("size", rows["doc_id"]), 10).count() == 0


# ---- images ----


def write_jpeg(spark, pixels, path):
    """A baseline JPEG by the JVM's own writer."""
    jvm = spark._jvm
    h, w, _ = pixels.shape
    image = jvm.java.awt.image.BufferedImage(w, h, 1)
    packed = (pixels[:, :, 0].astype(int) << 16) | (pixels[:, :, 1].astype(int) << 8) | pixels[:, :, 2]
    array = spark.sparkContext._gateway.new_array(jvm.int, w * h)
    for i, v in enumerate(packed.ravel().tolist()):
        array[i] = v
    image.setRGB(0, 0, w, h, array, 0, w)
    jvm.javax.imageio.ImageIO.write(image, "jpg", jvm.java.io.File(str(path)))


@pytest.fixture(scope="module")
def photos(spark, tmp_path_factory):
    """Two directories of photos: originals, copies with a pasted patch, a copy, a damaged file and a tiny one."""
    root, rng = tmp_path_factory.mktemp("photos"), np.random.default_rng(3)
    for d in ("a", "b"):
        (root / d).mkdir()
        photo = np.clip(np.cumsum(np.cumsum(rng.normal(0, 3, (80, 96, 3)), 0), 1) / 8 + 128, 0, 255).astype(np.uint8)
        write_jpeg(spark, photo, root / d / "0.jpg")
        for i in (1, 2):
            photo = photo.copy()
            photo[16 * i : 16 * i + 16, 32:64] = rng.integers(0, 255, (16, 32, 3))
            write_jpeg(spark, photo, root / d / f"{i}.jpg")
        write_jpeg(spark, photo[:40, :40], root / d / "tiny.jpg")
    (root / "a" / "3.jpg").write_bytes((root / "a" / "0.jpg").read_bytes())
    (root / "b" / "bad.jpg").write_bytes((root / "b" / "0.jpg").read_bytes()[:500])
    return root


def test_coefficients_round_trip(photos):
    for path in photos.glob("*/[0-9].jpg"):
        data = path.read_bytes()
        assert jpeg.encode(jpeg.decode(data)) == data
        marked = data[:-2] + b"\xff\xd0\xff\xd9"
        assert jpeg.encode(jpeg.decode(marked)) == marked
    for path in ("a/tiny.jpg", "b/bad.jpg"):
        with pytest.raises(Damaged):
            jpeg.decode((photos / path).read_bytes())


@pytest.mark.parametrize("config", [DedupConfig(), DedupConfig(dimension=1, chunking="f", delta="bytes"), DedupConfig(delta="bytes", data_type="raw"), DedupConfig(feature_method="rabin"), DedupConfig(feature_method="rabin", dimension=3, sketch=None), DedupConfig(feature_method="rabin", dimension=1, block_size=64), DedupConfig(force_indexed=True, collapse_runs=True)])
def test_archive_round_trip(spark, photos, config, tmp_path):
    files = archive.scan(spark, str(photos), config)
    packed, originals = archive.compress(files, config)
    packed, originals = packed.cache(), originals.cache()
    assert packed.count() >= 4
    assert {r["path"].rsplit("/", 1)[1]: r["reason"] for r in originals.collect() if r["reason"] == "undecodable"} == {"tiny.jpg": "undecodable", "bad.jpg": "undecodable"}
    assert archive.mismatches(archive.restore(packed, originals), files).count() == 0
    row = archive.metrics(files, packed, originals).where("batch is null").first()
    assert row["files"] == files.count() and row["raw"] == row["usable"] + row["undecodable"] and row["ratio"] > 1
    assert row["packed"] == sum(row[c] for c in archive.PARTS) and row["detected"] < row["decoded"] and row["delta_decoded"] <= row["decoded"]
    assert "compression ratio" in archive.report(row.asDict(), 1, {"scan": 1.0})
    archive.write_archives(packed, str(tmp_path / "idp"))
    again = archive.read_archives(spark, str(tmp_path / "idp"))
    assert archive.mismatches(archive.restore(again, originals), files).count() == 0
    if config.delta == "bytes":
        short = archive.composed(again)
        assert short.join(packed.select(packed["path"].alias("base")), "base").count() == 0
        assert archive.mismatches(archive.restore(short, originals), files).count() == 0


@pytest.mark.parametrize("least", [0.0, 0.97])
def test_numbers_beside_files_and_bases_alone(spark, photos, least):
    config = DedupConfig(least_matched=least)
    scanned = archive.scan(spark, str(photos), config)
    files = scanned.drop("batch", "seq")
    packed, originals = archive.compress(files, config, numbers=archive.numbered(files, config))
    also, others = archive.compress(scanned, config)
    rows = lambda t, *c: sorted(map(tuple, t.select(*c).collect()))
    assert rows(packed, "batch", "path", "base", "record") == rows(also, "batch", "path", "base", "record")
    assert rows(originals, "batch", "path", "reason", "based") == rows(others, "batch", "path", "reason", "based")
    assert packed.count() + originals.count() == files.count()
    assert ("low delta" in {r["reason"] for r in originals.collect()}) == (least > 0)
    # only originals that say so are read for their records
    assert 0 < originals.where("based").count() < originals.count()
    assert archive.mismatches(archive.restore(packed, originals), files).count() == 0
    with pytest.raises(Damaged):
        archive.restore(packed, originals.withColumn("based", F.lit(False)))


def test_roads_fill_batches_of_their_own(spark):
    rows = spark.createDataFrame([(f"{d}/{i}", f"{d}", 10, b"") for d in range(6) for i in range(4)], "path string, dir string, length long, content binary")
    for chaos in (False, True):
        found = archive.batched(rows, DedupConfig(road_num=3, chaos=chaos, chunking="f", patch_size=20)).collect()
        assert len(found) == 24 and len({r["path"] for r in found}) == 24
        roads: dict = {}
        for r in found:
            roads.setdefault(r["batch"] % 3, []).append(r)
        assert all(len({r["dir"] for r in rs}) * 4 == len(rs) for rs in roads.values()) or chaos
        sizes = [sum(x["batch"] == b for x in found) for b in {r["batch"] for r in found}]
        assert max(sizes) == 2 and sum(sizes) == 24


def test_command_line_round_trip(spark, photos, tmp_path):
    from foldwise import __main__ as cli

    for options in ({"road_num": "2"}, {"delta": "bytes", "chunking": "f"}):
        packed, out = tmp_path / f"packed{len(options)}", tmp_path / f"out{len(options)}"
        report = cli.compress(spark, str(photos), str(packed), DedupConfig.from_options(options))
        assert "similarity" in report and (packed / "report.txt").read_text() == report
        assert list(packed.glob("*.idp" if len(options) == 1 else "*.vcd"))
        assert "differs" not in cli.restore(spark, str(packed), str(out), str(photos))
        assert {p.relative_to(out): p.read_bytes() for p in out.rglob("*.jpg")} == {p.relative_to(photos): p.read_bytes() for p in photos.rglob("*.jpg")}
        flat = tmp_path / f"flat{len(options)}"
        flat.mkdir()
        (flat / "0.jpg").write_bytes((photos / "a" / "0.jpg").read_bytes())
        (flat / "new.jpg").write_bytes(b"x")
        assert [r["path"] for r in archive.mismatches(records.files(spark, str(out)), records.files(spark, str(flat))).collect()] == ["new.jpg"]


def test_batches_and_neighbours_over_many_parts(spark):
    from foldwise.sources import ordered

    rng = np.random.default_rng(5)
    sizes = [None if i == 3 else int(x) for i, x in enumerate(rng.integers(0, 50, 300))]
    rows = spark.createDataFrame([(i % 7, i, s) for i, s in enumerate(sizes)], "dir long, id long, size long")
    for patch in (1, 60, 200, 10_000):
        for part_rows in (7, 64, 1000):
            held, batch, wanted = 0, 0, {}
            for i, s in enumerate(sizes):
                wanted[i] = batch
                held += s or 0
                if held >= patch:
                    batch, held = batch + 1, 0
            assert {r["id"]: r["batch"] for r in ordered.filled_batches(rows, ["id"], "size", patch, part_rows).collect()} == wanted
    found = {r["id"]: (r["before"], r["has_before"]) for r in ordered.with_neighbour(rows, ["dir", "id"], "id", "before", True, 16).collect()}
    order = sorted(range(300), key=lambda i: (i % 7, i))
    assert found == {i: (b, b is not None) for i, b in zip(order, [None, *order], strict=False)}
    sums = {r["id"]: r["sum"] for r in ordered.running_sum(rows.na.fill(0), ["id"], "size", "sum", 16).collect()}
    assert sums == dict(enumerate(np.cumsum([s or 0 for s in sizes]).tolist()))
    assert ordered.filled_batches(rows.where("false"), ["id"], "size", 5).count() == 0
    ends = records.with_end_of_dir(rows, "dir", "id").where("end_of_dir").collect()
    assert sorted(r["id"] for r in ends) == list(range(293, 300))


def test_pairs_do_not_cross_batches(spark):
    rows = spark.createDataFrame([(i, "one two three four five", "a", i // 2) for i in range(6)], "doc_id long, text string, source string, batch long")
    best = detect.best_base(detect.candidates(sketch.exploded(sketch.sketches(rows)), within=("batch",))).collect()
    assert sorted((r["t"], r["b"]) for r in best) == [(1, 0), (3, 2), (5, 4)]


def test_positions_beyond_16_bits(spark):
    text = "x\n" * 70_000 + "one two three four"
    slots = sketch.exploded(sketch.sketches(spark.createDataFrame([(1, text)], "doc_id long, text string"))).collect()
    assert {r["pos"] for r in slots} == {70_000 << 32}


def test_tumbling_counts(spark, tmp_path):
    from pyspark.sql import functions as F

    events = spark.read.parquet(f"{DATA}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    events.coalesce(1).write.parquet(str(tmp_path / "events"))
    counts = stream.tumbling_counts(stream.watch(spark, str(tmp_path / "events"), "ts timestamp, event_type string, value double"))
    query = counts.writeStream.format("memory").queryName("tumbling").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    wanted = {(r["hour"], r["event_type"], r["n"]) for r in queries.stream_batches(spark, DATA).collect()}
    assert {(int(r["start"].timestamp()) // 3600, r["event_type"], r["n"]) for r in spark.table("tumbling").collect()} == wanted


def test_stream_chooses_the_same_bases(spark, tmp_path):
    slots = queries._slots(spark, DATA)
    wanted = {(r["t"], r["b"], r["score"], r["fix_flag"]) for r in detect.best_base(detect.candidates(slots)).collect()}
    rows = slots.groupBy("id").agg({"k": "count"}).select("id")
    from pyspark.sql import functions as F

    lists = slots.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("k", "sf", "pos"))).alias("v"))
    lists = lists.select(F.lit(0).cast("long").alias("batch"), F.col("id").alias("seq"), F.col("v.sf").alias("sf"), F.col("v.pos").alias("pos"), F.lit(False).alias("end"))
    assert lists.count() == rows.count()
    halves = slots.agg(F.percentile_approx("id", 0.5)).first()[0]
    for i, part in enumerate((lists.where(F.col("seq") <= halves), lists.where(F.col("seq") > halves))):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = stream.watch(spark, str(tmp_path / "in"), "batch long, seq long, sf array<long>, pos array<long>, end boolean", 1)
    query = stream.detect(source).writeStream.format("memory").queryName("bases").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    found = {(r["t"], r["b"], r["score"], r["fix_flag"]) for r in spark.table("bases").collect()}
    assert found == wanted
