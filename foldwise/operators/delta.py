"""Delta coding of a record against its base: positional, indexed, and bytes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldwise.sources.records import let, lines, words

# ---- over cells (id, y, x, block) ----


def block_index(cells: DataFrame) -> DataFrame:
    """Cells that an index holds: of equal neighbours in a row only the first."""
    before = F.lag("h").over(Window.partitionBy("id", "y").orderBy("x"))
    return cells.where("h is not null").withColumn("before", before).where("before is null or before <> h").drop("before")


def matched_cells(pairs: DataFrame) -> DataFrame:
    """(t, cells, matched): how many of the target's blocks its base holds anywhere, from pairs (t, target, base) of texts.

    Blocks are counted by kind before they are looked up, so a frequent word is one row.
    """
    split = lambda c: F.explode(F.split(c, "[\n ]", -1)).alias("block")
    target = pairs.select("t", split("target")).groupBy("t", "block").agg(F.count("*").alias("n"))
    base = pairs.select("t", split("base")).distinct().withColumn("here", F.lit(1))
    return target.join(base, ["t", "block"], "left").groupBy("t").agg(F.sum("n").alias("cells"), F.sum(F.when(F.col("here") == 1, F.col("n")).otherwise(0)).alias("matched"))


def marked(pairs: DataFrame, *keep: str) -> DataFrame:
    """(t, y, x, copy, bytes) of each target's blocks, from pairs (t, target, base) of texts; columns of ``keep`` stay.

    Both texts are in one row, so blocks are compared where they stand: no block is
    joined, only the texts of pairs were.
    """

    def of_row(line, base):
        same = lambda own: F.transform(words(line), lambda w, i: F.struct(F.coalesce(w == F.get(own, i), F.lit(False)).alias("copy"), F.octet_length(w).alias("bytes")))
        return let(words(base), same)

    grid_ = let(lines(F.col("base")), lambda base: F.transform(lines(F.col("target")), lambda line, y: of_row(line, F.get(base, y))))
    rows = pairs.select("t", *keep, F.posexplode(grid_).alias("y", "row"))
    return rows.select("t", *keep, "y", F.posexplode("row").alias("x", "m")).select("t", *keep, "y", "x", "m.copy", "m.bytes")


def opened(cells: DataFrame) -> DataFrame:
    """``cells`` with opens: a run begins where the row does or the kind changes."""
    before = F.lag("copy").over(Window.partitionBy("t", "y").orderBy("x"))
    return cells.withColumn("opens", F.coalesce((before != F.col("copy")).cast("long"), F.lit(1).cast("long")))


def fixed_point(pairs: DataFrame) -> DataFrame:
    """(t, y, op, x, len): maximal runs of blocks that are, or are not, those of the base at the same place."""
    runs = opened(marked(pairs)).withColumn("run", F.sum("opens").over(Window.partitionBy("t", "y").orderBy("x")))
    kind = F.when(F.first("copy"), "COPY").otherwise("INSERT")
    return runs.groupBy("t", "y", "run").agg(kind.alias("op"), F.min("x").alias("x"), F.count("*").alias("len")).drop("run")


# ---- over grids in memory: lists of rows of comparable blocks ----


#: Lengths of block sequences that an index knows; the longest that occurs names the places to try.
DEPTHS = (8, 4, 2, 1)


def index_of(base: list[list], collapse_runs: bool = False) -> dict:
    """(Sequence of one to eight blocks) -> its places (y, x), row by row."""
    found: dict = {}
    for y, row in enumerate(base):
        for x, block in enumerate(row):
            if not (collapse_runs and x and row[x - 1] == block):
                for depth in DEPTHS:
                    if x + depth <= len(row):
                        found.setdefault(tuple(row[x : x + depth]), []).append((y, x))
    return found


def instructions(base: list[list], target: list[list], fixed: bool = False, collapse_runs: bool = False) -> tuple[list, list, list]:
    """(copies, inserts, residual) of a plane.

    Row by row: at each place the longest run of blocks equal to a run of the base
    (the first of equals; with ``fixed`` only the run at the same place) is a copy
    (x, y, length), otherwise the block is residual. ``inserts`` holds the number of
    residual blocks before each copy, and at a row's end if there are any.
    """
    index = None if fixed else index_of(base, collapse_runs)
    copies, inserts, residual = [], [], []
    for y, row in enumerate(target):
        at = waiting = 0
        while at < len(row):
            # the longest run is at one of the places of the longest sequence that occurs at all
            places = [(y, at)] if fixed else next((p for d in DEPTHS if at + d <= len(row) and (p := index.get(tuple(row[at : at + d])))), ())
            best, where = 0, (0, 0)
            for by, bx in places:
                line = base[by] if by < len(base) else []
                run, most = 0, min(len(line) - bx, len(row) - at)
                if run < most and best and (most <= best or line[bx + best] != row[at + best]):
                    continue
                while run < most and line[bx + run] == row[at + run]:
                    run += 1
                if run > best:
                    best, where = run, (bx, by)
                if best == len(row) - at:
                    break
            if best:
                copies.append((*where, best))
                inserts.append(waiting)
                waiting, at = 0, at + best
            else:
                residual.append(row[at])
                waiting, at = waiting + 1, at + 1
        if waiting:
            inserts.append(waiting)
    return copies, inserts, residual


def replay(base: list[list], widths: list[int], copies: list, inserts: list, residual: list) -> list[list]:
    """The target's rows of the given widths."""
    out, row, copy, taken = [], [], iter(copies), 0
    pending = iter(widths)
    width = next(pending, None)
    while width == 0:
        out.append([])
        width = next(pending, None)
    for count in inserts:
        row += residual[taken : taken + count]
        taken += count
        if width is not None and len(row) < width:
            x, y, length = next(copy)
            row += base[y][x : x + length]
        while width is not None and len(row) == width:
            out.append(row)
            row, width = [], next(pending, None)
    return out


def grid(text: str) -> list[list[str]]:
    return [line.split(" ") for line in text.split("\n")]


def coefficient_grid(plane: np.ndarray) -> list[list[bytes]]:
    """Rows of blocks as bytes."""
    data = np.ascontiguousarray(plane.astype("<i2"))
    return [[block.tobytes() for block in row] for row in data]


def greedy(pairs: DataFrame, fixed: str = "fix_flag") -> DataFrame:
    """(t, copies, inserted, copied, restored, restored_md5) of (t, target, base, fix_flag): each pair is coded, and replayed from its instructions."""

    def run(batches):
        import hashlib

        import pandas as pd

        for batch in batches:
            rows = []
            for t, target, base, flag in zip(batch["t"], batch["target"], batch["base"], batch[fixed], strict=True):
                one, two = grid(base), grid(target)
                copies, inserts, residual = instructions(one, two, fixed=not flag)
                again = replay(one, [len(r) for r in two], copies, inserts, residual)
                text = "\n".join(" ".join(row) for row in again)
                rows.append((t, len(copies), len(residual), sum(c[2] for c in copies), text == target, hashlib.md5(text.encode()).hexdigest()))
            yield pd.DataFrame(rows, columns=["t", "copies", "inserted", "copied", "restored", "restored_md5"])

    return pairs.select("t", "target", "base", fixed).mapInPandas(run, "t long, copies long, inserted long, copied long, restored boolean, restored_md5 string")
