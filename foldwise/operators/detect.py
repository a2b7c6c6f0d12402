"""Choosing for each record an earlier, similar record as its base."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(target, base): every later record of an equal content, with the first."""
    first = docs.groupBy(F.md5(text_col).alias("m")).agg(F.min(id_col).alias("base"), F.count("*").alias("n")).where("n > 1")
    rows = docs.select(F.col(id_col).alias("target"), F.md5(text_col).alias("m")).join(first, "m")
    return rows.where("target > base").select("target", "base")


def candidates(slots: DataFrame, dc: bool = False, within: tuple[str, ...] = ()) -> DataFrame:
    """(t, b, score, first_k, same_pos) of all pairs that share a slot's value, b before t; ``within``: columns that must be equal too.

    Records with equal sketches would pair with each other in every slot: only the
    first of each such class takes part as a base, which is the base that the order
    (score, slot, seq) prefers anyway, so the pairs grow with the distinct sketches.
    """
    match = F.col("same_dc") if dc else F.lit(True)
    slots = slots.withColumn("dc", F.lit(0)) if "dc" not in slots.columns else slots
    whole = slots.groupBy("id", *within).agg(F.hash(F.array_sort(F.collect_list(F.struct("k", "sf", "dc")))).alias("a"), F.xxhash64(F.array_sort(F.collect_list(F.struct("k", "sf", "dc")))).alias("c"))
    firsts = whole.groupBy("a", "c", *within).agg(F.min("id").alias("id")).select("id")
    bases = slots.join(firsts, "id", "left_semi").select(*within, "k", "sf", F.col("id").alias("b"), F.col("pos").alias("b_pos"), F.col("dc").alias("b_dc"))
    pairs = slots.select(*within, "k", "sf", F.col("id").alias("t"), "pos", "dc").join(bases, [*within, "k", "sf"]).where("b < t").withColumn("same_dc", F.col("dc") == F.col("b_dc"))
    return pairs.groupBy("t", "b").agg(
        F.sum(match.cast("int")).alias("score"), F.min("k").alias("first_k"), F.max((match & (F.col("pos") == F.col("b_pos"))).cast("int")).alias("same_pos")
    )


def best_base(pairs: DataFrame, min_score: int = 1) -> DataFrame:
    """(t, b, score, first_k, fix_flag): greatest score, then least slot, then earliest base.

    One aggregate over a packed key, so a target's candidates are never sorted.
    """
    kept = pairs.where(F.col("score") >= min_score)
    best = kept.groupBy("t").agg(F.max(F.struct(F.col("score").alias("score"), (-F.col("first_k")).alias("k"), (-F.col("b")).alias("b"), F.col("same_pos").alias("same"))).alias("m"))
    return best.select("t", (-F.col("m.b")).alias("b"), "m.score", (-F.col("m.k")).alias("first_k"), (1 - F.col("m.same")).alias("fix_flag"))


def unmatched(docs: DataFrame, best: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return docs.join(best.select(F.col("t").alias(id_col)), id_col, "left_anti")


def matched(docs: DataFrame, best: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return docs.join(best.select(F.col("t").alias(id_col)), id_col, "left_semi")


def chain_depth(best: DataFrame, freeze) -> DataFrame:
    """(t, root, depth) of every target: how many bases must be restored first.

    Pointer jumping: each round doubles the reach, so a chain of length n takes
    log2(n) joins; ``freeze`` cuts the lineage between rounds.
    """
    reach = best.select("t", F.col("b").alias("root"), F.lit(1).alias("depth"))
    while True:
        reach = freeze(reach)
        ahead = reach.select(F.col("t").alias("root"), F.col("root").alias("further"), F.col("depth").alias("more"))
        joined = reach.join(ahead, "root", "left")
        if joined.where("further is not null").isEmpty():
            return reach
        reach = joined.select("t", F.coalesce("further", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"))


def with_rank(pairs: DataFrame) -> DataFrame:
    """All candidates of a target in order of preference."""
    order = Window.partitionBy("t").orderBy(F.desc("score"), "first_k", "b")
    return pairs.withColumn("rank", F.row_number().over(order))
