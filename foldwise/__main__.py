"""``python -m foldwise -c|-d --input=DIR --output=DIR [--reference_path=DIR] [--name=value ...]``.

``-c`` writes ``<batch>.idp`` (or ``.vcd`` for byte deltas), what it leaves as it was under ``<batch>/``, and ``report.txt``;
``-d`` restores such a folder.
"""

from __future__ import annotations

import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

import foldwise
from foldwise.config import DedupConfig
from foldwise.plans import archive
from foldwise.plans.freeze import frozen
from foldwise.sources import records

#: Thread, queue and buffer options of other implementations: Spark schedules by itself.
_SCHEDULING = {"read_thrd_num", "decode_thrd_num", "middle_thrd_num", "rejpeg_thrd_num", "write_thrd_num", "buffer_size", *(f"{x}_list" for x in "name read decd dect indx deup rejg jpeg encd".split())}


def compress(spark: SparkSession, source: str, target: str, config: DedupConfig) -> str:
    """Writes the archive of ``source`` to ``target``; returns the report."""
    seconds: dict[str, float] = {}
    files = archive._timed(seconds, "scan", lambda: archive.scan(spark, source, config))
    packed, originals = archive.compress(files, config, seconds)
    originals = frozen(originals, "originals")
    archive._timed(seconds, "write", lambda: archive.write_archives(packed, target))
    archive._timed(seconds, "write", lambda: archive.write_files(originals.select(F.concat_ws("/", F.col("batch").cast("string"), "path").alias("path"), "content"), target))
    rows = archive.metrics(files, packed, originals)
    totals = rows.where("batch is null").first().asDict()
    text = archive.report(totals, files.select("batch").distinct().count(), seconds)
    bins = {r["bin"]: r["targets"] for r in archive.similarity(packed).collect()}
    text += f"{'similarity':<20}: {' '.join(str(bins.get(i, 0)) for i in range(20))}\n"
    archive._put(target, "report.txt", text.encode())
    return text


def restore(spark: SparkSession, source: str, target: str, reference: str | None = None) -> str:
    """Restores an archive folder to ``target``; returns the report, with what differs from ``reference``."""
    began = time.time()
    packed = archive.read_archives(spark, source)
    kept = records.files(spark, source).where(F.col("path").contains("/") & ~F.col("name").rlike(r"\.(idp|vcd)$"))
    originals = kept.select(F.regexp_extract("path", "^[^/]*/(.*)$", 1).alias("path"), "content")
    restored = frozen(archive.restore(packed, originals), "files")
    archive.write_files(restored, target)
    size, count = restored.agg(F.coalesce(F.sum(F.length("content")), F.lit(0)), F.count("*")).first()
    spent = time.time() - began
    text = f"bandwidth: {size / (1 << 20) / spent:.3f} MB/s\navailable size: {size} bytes\nfrequency: {count / spent:.3f} a second\ncounter: {count}\ntime: {spent:.3f} s\n"
    if reference:
        for row in archive.mismatches(restored, records.files(spark, reference)).toLocalIterator():
            text += f"differs: {row['path']}\n"
    return text


def main(arguments: list[str]) -> int:
    modes = [a for a in arguments if a in ("-c", "-d")]
    options = dict(a[2:].split("=", 1) for a in arguments if a.startswith("--") and "=" in a)
    if len(modes) != 1 or "input" not in options or "output" not in options:
        print(__doc__)
        return 2
    paths = {k: options.pop(k, None) for k in ("input", "output", "reference_path")}
    ignored = [options.pop(k) for k in list(options) if k in _SCHEDULING]
    if ignored:
        print(f"{len(ignored)} scheduling options have no effect")
    config = DedupConfig.from_options(options)
    spark = SparkSession.builder.appName("foldwise").getOrCreate()
    foldwise.ship(spark)
    if modes == ["-c"]:
        print(compress(spark, paths["input"], paths["output"], config))
    else:
        print(restore(spark, paths["input"], paths["output"], paths["reference_path"]))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
