"""What depends on a total order of all rows: ends of directories, batches that fill up, neighbours.

Rows are dealt to parts by ranges of their order, so no key's rows meet in one
task: what crosses a part's edge is a few numbers a part.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldwise.plans.freeze import frozen

#: Rows of a part; they are keys and sizes, not contents.
PART_ROWS = 1 << 20


def parted(rows: DataFrame, order: list[str], part_rows: int = PART_ROWS) -> DataFrame:
    """``rows`` with part (rising along ``order``, nulls first) and place (from 0 within the part)."""
    kept = frozen(rows, "ordered")
    parts = max(1, math.ceil(kept.count() / part_rows))
    dealt = kept.repartitionByRange(parts, *[F.col(c).asc_nulls_first() for c in order]).withColumn("part", F.spark_partition_id())
    dealt = frozen(dealt, "parts")
    return dealt.withColumn("place", F.row_number().over(Window.partitionBy("part").orderBy(*[F.col(c).asc_nulls_first() for c in order])) - 1)


def with_neighbour(rows: DataFrame, order: list[str], column: str, name: str, before: bool, part_rows: int = PART_ROWS) -> DataFrame:
    """Adds ``name``: ``column`` of the row before (or behind) in the order of all rows, and has_``name``."""
    own = parted(rows, order, part_rows)
    end = (F.min_by if not before else F.max_by)(F.struct(F.col(column).alias("value")), "place")
    # one row a part: the edges of the other parts come from here
    edges = own.groupBy("part").agg(end.alias("edge"))
    along = Window.orderBy("part")
    edges = frozen(edges.select("part", (F.lag if before else F.lead)("edge").over(along).alias("edge")), "edges")
    inside = Window.partitionBy("part").orderBy("place")
    near = (F.lag if before else F.lead)(F.struct(F.col(column).alias("value"))).over(inside)
    out = own.withColumn("__near", near).join(F.broadcast(edges), "part").withColumn("__near", F.coalesce("__near", "edge"))
    return out.select(*rows.columns, F.col("__near.value").alias(name), F.col("__near").isNotNull().alias(f"has_{name}"))


def running_sum(rows: DataFrame, order: list[str], column: str, name: str, part_rows: int = PART_ROWS) -> DataFrame:
    """Adds ``name``: the sum of ``column`` over all rows up to this one."""
    own = parted(rows, order, part_rows)
    sums = own.groupBy("part").agg(F.sum(column).alias("sum"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = frozen(sums.select("part", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("__before")), "sums")
    inside = Window.partitionBy("part").orderBy("place")
    return own.join(F.broadcast(sums), "part").select(*rows.columns, (F.col("__before") + F.sum(column).over(inside)).alias(name))


def _chains(sizes: np.ndarray, patch: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(running sums, batches closed behind each row if one closes there, what then is left over at the end)."""
    sums = np.cumsum(sizes)
    following = np.searchsorted(sums, sums + patch).tolist()
    closed, rest, n = [0] * len(sums), [0] * len(sums), len(sums)
    for r in range(n - 1, -1, -1):
        s = following[r]
        closed[r], rest[r] = (0, int(sums[-1] - sums[r])) if s == n else (1 + closed[s], rest[s])
    return sums, np.array(closed, np.int64), np.array(rest, np.int64)


def filled_batches(rows: DataFrame, order: list[str], size: str, patch: int, part_rows: int = PART_ROWS) -> DataFrame:
    """Adds batch (from 0): in ``order`` a batch closes behind the row with which it has ``patch`` bytes, and the count starts again from 0.

    A part's result depends on the bytes that its first batch brings along, but only
    through the row at which that batch closes: each part tells for every such row
    how many batches close behind it and what is left over. The driver walks over
    the parts with these numbers, of one batch's rows for each part, then every part
    is numbered on its own. Null sizes count as 0.
    """
    if patch < 1:
        raise ValueError("patch must be positive")
    own = parted(rows.withColumn("__size", F.coalesce(F.col(size), F.lit(0)).cast("long")), order, part_rows)

    def sizes_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        at = np.argsort(table.column("place").to_numpy(), kind="stable")
        return at, table.column("__size").to_numpy()[at]

    def summary(key, table):
        sums, closed, rest = _chains(sizes_of(table)[1], patch)
        upto = int(np.searchsorted(sums, patch)) + 1
        packed = [pa.array([x[:upto].astype(np.int64).tobytes()], pa.binary()) for x in (sums, closed, rest)]
        return pa.table([pa.array([key[0].as_py()], pa.int32()), *packed, pa.array([int(sums[-1])], pa.int64())], names=["part", "sums", "closed", "rest", "total"])

    told = own.select("part", "place", "__size").groupBy("part").applyInArrow(summary, "part int, sums binary, closed binary, rest binary, total long")
    enter, batch, carried = {}, 0, 0
    for row in told.orderBy("part").toLocalIterator():
        enter[row["part"]] = (batch, carried)
        sums, closed, rest = (np.frombuffer(row[c], np.int64) for c in ("sums", "closed", "rest"))
        r = int(np.searchsorted(sums, patch - carried))
        if r < len(sums):
            batch, carried = batch + 1 + int(closed[r]), int(rest[r])
        else:
            carried += row["total"]

    def number(key, table):
        first, brought = enter[key[0].as_py()]
        at, sizes = sizes_of(table)
        sums, ends, limit = np.cumsum(sizes), [], patch - brought
        while (r := int(np.searchsorted(sums, limit))) < len(sums):
            ends.append(r)
            limit = int(sums[r]) + patch
        batches = np.empty(len(sums), np.int64)
        batches[at] = first + np.searchsorted(np.array(ends, np.int64), np.arange(len(sums)))
        return table.drop_columns(["part", "place", "__size"]).append_column("batch", pa.array(batches))

    schema = rows.withColumn("batch", F.lit(0).cast("long")).schema
    return own.groupBy("part").applyInArrow(number, schema)
