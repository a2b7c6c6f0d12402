"""Cutting lineage through the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local session (tests) may go without that setting; it then gets a
    folder of its own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="foldwise-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def frozen(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written to the shared folder and read again.

    Cuts the lineage, so that what follows neither recomputes nor loses rows with
    an executor. The folder goes when the session's JVM ends, or with :func:`dropped`.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/foldwise-{uuid.uuid4().hex}-{name}"
    df.write.option("compression", "zstd").parquet(path)
    folder, system = _hadoop(spark, path)
    system.deleteOnExit(folder)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Deletes the folders of frozen tables that nothing reads any more."""
    for table in tables:
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            if folder.rsplit("/", 1)[-1].startswith("foldwise-"):
                path, system = _hadoop(table.sparkSession, folder)
                system.delete(path, True)


def _hadoop(spark: SparkSession, path: str):
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
