"""A uniform shuffle into shards of exact sizes by a hypergeometric communication matrix."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from foldwise.llm.base import frozen

#: Rows of one cell, the piece of a shard that one task permutes.
CELL_ROWS = 50_000


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """How many of ``draws`` from good + bad are good; numpy's draw below 1e9, ratio of uniforms above."""
    total = good + bad
    if total < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, draws)) if total else 0
    low, high = max(0, draws - bad), min(good, draws)
    if low == high:
        return low

    def weight(x: int) -> float:
        return -(math.lgamma(x + 1) + math.lgamma(good - x + 1) + math.lgamma(draws - x + 1) + math.lgamma(bad - draws + x + 1))

    share = good / total
    mean, spread = draws * share, math.sqrt(draws * share * (1 - share) * (total - draws) / (total - 1) + 0.5)
    mode = min(max(int((draws + 1) * (good + 1) / (total + 2)), low), high)
    top, width = weight(mode), 1.715527769921414 * spread + 0.898916162058899
    while True:
        u, v = rng.random(), rng.random()
        x = math.floor(mean + 0.5 + width * (v - 0.5) / u) if u > 0 else low - 1
        if low <= x <= high and 2 * math.log(u) <= weight(x) - top:
            return x


def _split(rng: np.random.Generator, cells: np.ndarray, draws: int) -> np.ndarray:
    """Multivariate hypergeometric: what each cell gets of ``draws`` rows."""
    if int(cells.sum()) < 1_000_000_000:
        # the same draws, cell by cell, in one call
        return rng.multivariate_hypergeometric(cells, int(draws), method="marginals")
    out, left, total = np.zeros_like(cells), int(draws), int(cells.sum())
    for i, size in enumerate(cells.tolist()):
        if not left:
            break
        out[i] = _hypergeometric(rng, size, total - size, left)
        left -= int(out[i])
        total -= size
    return out


def matrix_row(begins: np.ndarray, cells: np.ndarray, part: int, seed: int) -> np.ndarray:
    """Row ``part`` of the communication matrix, by halving the partitions.

    Each half draws its share of the cells with a generator seeded by the half's
    bounds, so any task computes its own row from the partitions' sizes alone
    and all rows together have the exact joint distribution.
    """
    low, high, own = 0, len(begins) - 1, cells
    while high - low > 1:
        mid = (low + high) // 2
        first = _split(np.random.default_rng([seed, low, high]), own, int(begins[mid] - begins[low]))
        own, low, high = (first, low, mid) if part < mid else (own - first, mid, high)
    return own


def cell_sizes(rows: int, shards: int, per_shard: int) -> np.ndarray:
    """Sizes of all cells, shard by shard: shards differ by one row at most, and so do a shard's cells."""
    sizes = [rows // shards + (s < rows % shards) for s in range(shards)]
    return np.array([n // per_shard + (c < n % per_shard) for n in sizes for c in range(per_shard)], dtype=np.int64)


def shard(rows: DataFrame, shards: int = 8, seed: int = 11, cell_rows: int = CELL_ROWS) -> DataFrame:
    """``rows`` with shard (from 0) and slot (gapless from 0 in each shard): a uniform random order.

    The rows are frozen with their partition and place in it. The partitions' sizes
    and the cells' exact sizes (cells are pieces of shards) give the communication
    matrix; each partition permutes its rows locally and deals them by its row of
    the matrix; one exchange brings a cell's rows together, where they are permuted
    again, which fixes their slots. Shards differ by one row at most.

    The driver holds one number per input partition and one per cell, never rows.
    Copies and equal rows are rows like any other, nulls, empty and very long texts too; an
    empty table gives an empty result; columns named shard or slot are replaced.
    The same table, partitioned the same way, gives the same result.
    """
    columns = [c for c in rows.columns if c not in ("shard", "slot")]
    spark = rows.sparkSession
    named = rows.select(F.struct(*columns).alias("__row"), F.monotonically_increasing_id().alias("__at"))
    named = frozen(named, "shard-rows")
    part = F.shiftright("__at", 33)
    counts = sorted((r["part"], r["n"]) for r in named.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    total = sum(n for _, n in counts)
    per_shard = max(1, math.ceil(total / shards / cell_rows), math.ceil(int(spark.conf.get("spark.sql.shuffle.partitions")) / shards))
    cells = cell_sizes(total, shards, per_shard)
    parts = np.array([p for p, _ in counts], dtype=np.int64)
    begins = np.concatenate([[0], np.cumsum([n for _, n in counts], dtype=np.int64)]).astype(np.int64)
    # eight bytes a partition and a cell: 16 MB for a million of each
    known = spark.sparkContext.broadcast((parts, begins, cells))

    @pandas_udf("int")
    def cell_of(batches: pd.Series) -> pd.Series:
        parts, begins, cells = known.value
        at = batches.to_numpy(dtype=np.int64)
        out, own = np.zeros(len(at), np.int32), at >> 33
        for p in np.unique(own):
            i = int(np.searchsorted(parts, p))
            if _dealt.get("key") != (seed, i, len(cells), int(begins[-1])):
                dealt = np.repeat(np.arange(len(cells), dtype=np.int32), matrix_row(begins, cells, i, seed))
                np.random.default_rng([seed, i]).shuffle(dealt)
                _dealt.update(key=(seed, i, len(cells), int(begins[-1])), dealt=dealt)
            mask = own == p
            out[mask] = _dealt["dealt"][at[mask] & ((1 << 33) - 1)]
        return pd.Series(out)

    dealt = named.withColumn("__cell", cell_of("__at"))
    order = Window.partitionBy("__cell").orderBy(F.xxhash64(F.lit(seed), "__at"), "__at")
    place = F.row_number().over(order) - 1
    # where a cell begins in its shard follows from the sizes: the shard's first cells have one row more
    which, cell = F.floor(F.col("__cell") / per_shard), F.col("__cell") % per_shard
    size = F.lit(total // shards) + (which < total % shards).cast("long")
    begin = cell * F.floor(size / per_shard) + F.least(cell.cast("long"), size % per_shard)
    return dealt.select("__row", which.cast("int").alias("shard"), (begin + place).cast("long").alias("slot")).select(*[F.col(f"__row.`{c}`").alias(c) for c in columns], "shard", "slot")


_dealt: dict = {}
