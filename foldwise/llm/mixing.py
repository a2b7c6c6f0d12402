"""Mixing sources to target weights by Pareto order sampling [native: DataFrame functions only]."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldwise.llm.base import WORD, frozen

#: Most rows of the per-source plan that are broadcast; a larger plan is joined by a shuffle.
BROADCAST_SOURCES = 50_000


def word_count(text):
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def _random(seed: int, doc_id, size):
    """Uniform in (0, 1) from 52 bits of a digest, the same in every run."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("")), size.cast("string")))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def targets(sizes: DataFrame, weights=(5, 2, 1), max_copies: int = 3) -> DataFrame:
    """(source, source_size) with each source's target added.

    Sources in code point order, null last, take the weights in turn and share the
    sum of all sizes; a target stops at ``max_copies`` times its source's size and
    the excess goes to the others by weight. In order of size over weight the
    stopped sources come first, so one running sum finds them.
    """
    # one row a source: the number of sources, not of documents, bounds these windows
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.array(*[F.lit(float(w)) for w in weights])
    rows = sizes.withColumn("weight", F.element_at(turn, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    by_ratio = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    rows = rows.withColumns(
        {
            "total": F.sum("source_size").over(everything).cast("double"),
            "stopped": F.coalesce(F.sum("source_size").over(before), F.lit(0)) * float(max_copies),
            "sharing": F.sum("weight").over(onward),
        }
    )
    share = (F.col("total") - F.col("stopped")) * F.col("weight") / F.col("sharing")
    cap = F.col("source_size") * float(max_copies)
    first_free = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("open", F.max((share < cap).cast("int")).over(first_free) == 1)
    level = F.max(F.when(F.col("open"), F.struct(-(F.col("source_size") / F.col("weight")), F.col("total") - F.col("stopped"), F.col("sharing")))).over(everything)
    rows = rows.withColumn("level", level)
    return rows.select("source", "source_size", F.when(F.col("open"), F.col("level")["col2"] * F.col("weight") / F.col("level")["sharing"]).otherwise(cap).alias("target"))


def plan(docs: DataFrame, weights=(5, 2, 1), max_copies: int = 3, seed: int = 7, buckets: int = 1 << 11) -> DataFrame:
    """Per source: target, copies per unit of weight, and where its sample ends.

    ``docs`` has doc_id, source and size. See :func:`mix` for the method.
    """
    kinds = docs.groupBy("source", _class(F.col("size")).alias("class")).agg(F.sum("size").alias("words"))
    kinds = frozen(kinds, "mix-kinds")
    goal = targets(kinds.groupBy("source").agg(F.sum("words").alias("source_size")), weights, max_copies)
    down = Window.partitionBy("source").orderBy(F.col("class").desc())
    up = Window.partitionBy("source").orderBy(F.col("class").asc())
    most = float(max_copies)
    rate = _beside(kinds, goal)
    rate = rate.withColumn("heavier", F.coalesce(F.sum("words").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rate = rate.withColumn("mass", F.sum(F.col("words") * _weight("class")).over(up.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    rate = rate.withColumn("rate", F.when(F.col("mass") > 0, (F.col("target") - most * F.col("heavier")) / F.col("mass")).otherwise(0.0))
    fits = F.col("rate") * _weight("class") <= most * (1 + 1e-12)
    rate = rate.groupBy("source").agg(
        F.first("source_size").alias("source_size"),
        F.first("target").alias("target"),
        F.coalesce(F.max_by("rate", F.when(fits, F.col("class"))), F.min_by("rate", "class")).alias("rate"),
    )
    rate = frozen(rate, "mix-rates")
    pool = _expected(_with_plan(docs, rate), max_copies, seed)
    spread = pool.groupBy("source", F.floor(F.col("rank") / (1 + F.col("rank")) * buckets).alias("bucket")).agg(
        F.sum(F.col("size") * F.col("whole")).alias("certain"), F.sum(F.when(F.col("part") > 0, F.col("size")).otherwise(0)).alias("drawn")
    )
    spread = frozen(spread, "mix-buckets")
    running = Window.partitionBy("source").orderBy("bucket")
    certain = spread.groupBy("source").agg(F.sum("certain").alias("certain"), F.sum("drawn").alias("placed"))
    certain = _beside(rate, certain).select("source", "placed", (F.col("target") - F.col("certain")).alias("open"))
    cum = spread.where("bucket is not null").withColumn("sum", F.sum("drawn").over(running))
    crossing = _beside(cum, certain).where(F.col("sum") > F.col("open"))
    crossing = crossing.groupBy("source").agg(F.min("bucket").alias("edge"), F.min_by(F.col("sum") - F.col("drawn"), "bucket").alias("filled"))
    edges = frozen(_beside(certain, crossing), "mix-edges")
    # only the bucket in which the sample ends is sorted
    place = F.floor(F.col("rank") / (1 + F.col("rank")) * buckets)
    last = _with_plan(pool.where("part > 0"), edges).where(place == F.col("edge"))
    ordered = Window.partitionBy("source").orderBy("rank", F.col("doc_id").asc_nulls_first(), "size")
    last = last.withColumn("sum", F.col("filled") + F.sum("size").over(ordered)).where(F.col("sum") <= F.col("open"))
    last = last.groupBy("source").agg(F.max(F.struct("rank", "doc_id", "size")).alias("end"), F.max("sum").alias("reached"))
    ends = _beside(edges, last).select("source", "edge", "end", (F.col("open") - F.coalesce("reached", "filled", "placed", F.lit(0))).alias("lacking"))
    ends = frozen(ends, "mix-ends")
    # one document more where that comes nearer to the target
    rest = _with_plan(pool.where("part > 0"), ends).where(~_drawn(buckets) & (F.abs(F.col("size") - F.col("lacking")) < F.col("lacking")))
    close = rest.groupBy("source").agg(F.min(F.struct(F.abs(F.col("size") - F.col("lacking")).alias("miss"), "rank", "doc_id", "size")).alias("extra"))
    return frozen(_beside(rate, _beside(ends, close)).select("source", "source_size", "target", "rate", "edge", "end", "extra"), "mix-plan")


def _beside(rows: DataFrame, other: DataFrame) -> DataFrame:
    """Columns of ``other``'s row of the same source, null counting as a source."""
    other = other.withColumnRenamed("source", "__other")
    return rows.join(other, rows["source"].eqNullSafe(other["__other"]), "left").drop("__other")


def _class(size):
    return F.length(F.bin(size + 1)) - 1


def _weight(kind: str):
    return (F.col(kind) + 8).cast("double")


def _with_plan(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """``docs`` with its source's row of the plan; broadcast only if few sources."""
    plan = plan.withColumnRenamed("source", "__plan_source")
    side = F.broadcast(plan) if plan.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES else plan
    return docs.join(side, docs["source"].eqNullSafe(side["__plan_source"]), "left").drop("__plan_source")


def _expected(rows: DataFrame, max_copies: int, seed: int) -> DataFrame:
    """Certain whole copies, the part that is drawn, and the Pareto rank."""
    copies = F.least(F.lit(float(max_copies)), F.col("rate") * _weight("__class"))
    rows = rows.withColumn("__class", _class(F.col("size")))
    rows = rows.withColumn("__copies", F.greatest(F.lit(0.0), copies)).withColumn("whole", F.floor(F.col("__copies") + 1e-9))
    rows = rows.withColumn("part", F.when(F.col("__copies") - F.col("whole") > 1e-9, F.col("__copies") - F.col("whole")).otherwise(0.0))
    u = _random(seed, F.col("doc_id"), F.col("size"))
    odds = F.when(F.col("part") > 0, (u / (1 - u)) / (F.col("part") / (1 - F.col("part"))))
    return rows.withColumn("rank", odds).drop("__class", "__copies")


def _drawn(buckets: int):
    """Before the sample's end: in an earlier bucket, or not behind the last row of the last one."""
    place = F.floor(F.col("rank") / (1 + F.col("rank")) * buckets)
    key = F.struct("rank", "doc_id", "size")
    return (F.col("part") > 0) & F.coalesce(F.col("edge").isNull() | (place < F.col("edge")) | ((place == F.col("edge")) & (key <= F.col("end"))), F.lit(False))


def mix(docs: DataFrame, weights=(5, 2, 1), max_copies: int = 3, seed: int = 7, buckets: int = 1 << 11) -> DataFrame:
    """``docs`` (doc_id, text, source, ...) with size, source_size, target, copies and taken.

    A document's expected number of copies is its source's rate times a weight
    that grows by an eighth of the base with each doubling of its size, at most
    ``max_copies``; the rate makes the expected words meet the target. The whole
    part is certain. The fractional part p is the inclusion probability of Pareto
    order sampling: with u uniform from a digest, documents are ranked by
    (u/(1-u)) / (p/(1-p)) and taken in that order while the source's words stay
    within its target; then the one document that comes nearest to what is
    lacking is added. The size that the sample fixes is thus the source's words.

    Ranks are summed in ``buckets`` buckets before any sort, and only the bucket
    in which the sample ends is sorted, so a source that holds most documents is
    spread over all tasks. Only per-source rows are joined to the documents.

    Null text and text without words have size 0 and are taken at their expected
    copies with 0 words; null is a source of its own; rows equal in doc_id, size
    and source are decided alike; an empty table gives an empty result; input
    columns with the names of added ones are replaced.
    """
    keep = [c for c in docs.columns if c not in ("size", "source_size", "target", "copies", "taken")]
    base = docs.select(*keep, word_count(F.col("text")).alias("size"))
    small = frozen(base.select("doc_id", "source", "size"), "mix-sizes")
    made = plan(small, weights, max_copies, seed, buckets)
    # the plan's and the ranking's columns must not clash with the input's
    packed = base.select("doc_id", "source", "size", F.struct(*keep).alias("__row"))
    rows = _expected(_with_plan(packed, made), max_copies, seed)
    extra = (F.col("part") > 0) & F.coalesce((F.col("rank") == F.col("extra.rank")) & F.col("doc_id").eqNullSafe(F.col("extra.doc_id")) & (F.col("size") == F.col("extra.size")), F.lit(False))
    copies = F.col("whole") + (_drawn(buckets) | extra).cast("long")
    out = [F.col(f"__row.`{c}`").alias(c) for c in keep]
    return rows.select(*out, "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: ``docs``' own columns, each row as often as the mix takes it."""
    columns = docs.columns
    again = F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("__again")
    return mix(docs, **options).select(*columns, again).select(*columns)
