"""Records as grids of blocks: text tables, vectors, conversations, and image files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwise.sources import ordered


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path (relative to the folder ``path``), dir, name, length, content of every file below; unreadable files are skipped."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    root = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(folder).toString()
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).option("ignoreCorruptFiles", "true").load(path)
    own = F.expr(f"substring(path, {len(root.rstrip('/')) + 2})")
    return rows.select(own.alias("path"), F.regexp_extract(own, r"^(.*)/[^/]*$", 1).alias("dir"), F.regexp_extract(own, r"([^/]*)$", 1).alias("name"), "length", "content")


def hash28(word):
    """28 bits of a digest that any SQL engine has."""
    return F.conv(F.substring(F.md5(word), 1, 7), 16, 10).cast("long")


def let(value, body):
    """``body(value)`` with the value computed once, within one expression."""
    return F.get(F.transform(F.array(value), body), 0)


def lines(text):
    return F.split(text, "\n", -1)


def words(line):
    return F.split(line, " ", -1)


def cells(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, y, x, block, h): one row a word."""
    rows = docs.select(F.col(id_col).alias("id"), F.posexplode(lines(F.col("text"))).alias("y", "line"))
    return rows.select("id", "y", F.posexplode(words(F.col("line"))).alias("x", "block")).withColumn("h", hash28("block"))


def blocks(vectors: DataFrame) -> DataFrame:
    """(vec_id, c): vectors of 64 numbers as blocks of 8 x 8 coefficients."""
    return vectors.select("vec_id", F.transform("embedding", lambda v: F.round(v.cast("double") * 127).cast("int")).alias("c"))


def turns(conversations: DataFrame) -> DataFrame:
    """(id, plane, y, x, block): a conversation's roles are planes, its turns rows, their words blocks."""
    return conversations.select(F.col("conv_id").alias("id"), F.col("role").alias("plane"), F.col("turn").alias("y"), F.posexplode(words(F.col("text"))).alias("x", "block"))


def with_end_of_dir(docs: DataFrame, dir_col: str = "source", order: str = "doc_id") -> DataFrame:
    """Adds end_of_dir: nothing of the same directory follows."""
    found = ordered.with_neighbour(docs, [dir_col, order], dir_col, "following", before=False)
    return found.withColumn("end_of_dir", ~(F.col("has_following") & F.col("following").eqNullSafe(F.col(dir_col)))).drop("following", "has_following")


def fixed_batches(docs: DataFrame, patch_size: int, order: list[str], size: str = "size") -> DataFrame:
    """Adds batch: files in ``order`` fill a batch until it has ``patch_size`` bytes, whatever their directory; then the count starts again."""
    return ordered.filled_batches(docs, order, size, patch_size)


def variable_batches(docs: DataFrame, patch_size: int, dir_col: str = "source", size: str = "size") -> DataFrame:
    """(dir, bytes, batch): a batch closes at the end of the directory with which it has ``patch_size`` bytes."""
    dirs = docs.groupBy(F.col(dir_col).alias("dir")).agg(F.sum(size).alias("bytes"))
    return ordered.filled_batches(dirs, ["dir"], "bytes", patch_size)


def valid(text):
    """A whole record: not too short, and closed by its end mark."""
    return (F.length(text) >= 64) & F.endswith(text, F.lit("."))
