"""Sizes, ratios and histograms of a run."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldwise.functions import tans


def ratio(a, b, digits: int = 6):
    return F.round(F.when(b != 0, a.cast("double") / b).otherwise(F.lit(0.0)), digits)


def compression_metrics(records: DataFrame) -> DataFrame:
    """One row from per-record sizes: raw, valid, found (it has a base), delta (its record's bytes), decoded, detected, residual."""
    rows = records.withColumns({"matched": F.col("found") & (F.col("delta") <= F.col("raw")), "omitted": F.col("found") & (F.col("delta") > F.col("raw"))})
    rows = rows.withColumn("final", F.when(F.col("matched"), F.col("delta")).otherwise(F.col("raw")))
    s = lambda c, when=None: F.coalesce(F.sum(F.when(when, F.col(c)) if when is not None else F.col(c)), F.lit(0)).cast("long")
    valid, found = F.col("valid"), F.col("found")
    sums = rows.agg(
        s("raw").alias("raw_bytes"), s("raw", ~valid).alias("undecodable_bytes"), s("final", valid).alias("final_bytes"), s("raw", valid & ~found).alias("unmatched_bytes"),
        s("raw", found).alias("delta_raw_bytes"), s("decoded", valid).alias("decoded_bytes"), s("detected", valid).alias("detected_bytes"), s("decoded", found).alias("delta_decoded_bytes"),
        s("raw", F.col("omitted")).alias("omitted_bytes"), s("residual", F.col("matched")).alias("residual_bytes"),
    )
    usable = F.col("raw_bytes") - F.col("undecodable_bytes")
    return sums.withColumns(
        {
            "compression_ratio": ratio(usable, F.col("final_bytes")),
            "similar_ratio": ratio(usable - F.col("unmatched_bytes"), F.col("final_bytes") - F.col("unmatched_bytes")),
            "success_rate": F.round(1 - ratio(F.col("unmatched_bytes"), usable), 6),
            "expansion": ratio(F.col("decoded_bytes"), usable),
            "detected_ratio": ratio(F.col("decoded_bytes"), F.col("detected_bytes")),
            "delta_ratio": ratio(F.col("decoded_bytes"), F.col("delta_decoded_bytes")),
            "omitted_ratio": ratio(F.col("omitted_bytes"), F.col("delta_raw_bytes")),
        }
    )


def breakdown(sizes: DataFrame, parts: tuple[str, ...] = ("meta", "header", "x", "y", "len", "inl", "residual")) -> DataFrame:
    """(part, bytes, share) of all records' columns ``parts``, and their total."""
    total = sizes.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in parts])
    total = total.withColumn("total", sum((F.col(c) for c in parts[1:]), F.col(parts[0])))
    stacked = ", ".join(f"'{c}', {c}" for c in (*parts, "total"))
    rows = total.select("total", F.expr(f"stack({len(parts) + 1}, {stacked}) as (part, bytes)"))
    return rows.select("part", "bytes", ratio(F.col("bytes"), F.col("total")).alias("share"))


def similarity_histogram(matched: DataFrame) -> DataFrame:
    """(bin, targets) of matched / cells in twentieths; 1 counts in the last bin."""
    return matched.select(F.least(F.lit(19), F.floor(F.col("matched") * 20 / F.col("cells"))).cast("int").alias("bin")).groupBy("bin").agg(F.count("*").alias("targets"))


def collision_rate(slots: DataFrame) -> DataFrame:
    """Share of slots whose value an earlier record has in the same slot."""
    first = slots.groupBy("k", "sf").agg(F.count("*").alias("n"))
    return first.agg(F.sum(F.col("n") - 1).alias("hits"), F.sum("n").alias("slots")).select("hits", "slots", ratio(F.col("hits"), F.col("slots")).alias("rate"))


def byte_histogram(docs: DataFrame) -> DataFrame:
    pairs = F.regexp_extract_all(F.hex(F.encode("text", "UTF-8")), F.lit(".."), F.lit(0))
    return docs.select(F.explode(pairs).alias("byte")).groupBy("byte").agg(F.count("*").alias("n"))


def normalised(histogram: DataFrame, table_log: int = tans.USUAL_LOG) -> DataFrame:
    """(byte, freq): counts scaled to a sum of 2**table_log as the entropy coder's table holds them, -1 for what is rarer than one part.

    The same rule as :func:`foldwise.functions.tans.scaled`, but for its last resort
    when rounding up rare symbols takes more than half of the most frequent one.
    """
    whole, shift = Window.partitionBy(), 62 - table_log
    total = F.sum("n").over(whole)
    part = F.expr("n * ((4611686018427387904L) div total)")
    rows = histogram.withColumn("total", total).withColumn("part", part).withColumn("share", F.shiftright("part", shift))
    bar = F.shiftleft(F.element_at(F.array(*[F.lit(x).cast("long") for x in tans.ROUND_UP]), F.least(F.col("share"), F.lit(7)).cast("int") + 1), shift - 20)
    up = (F.col("share") < 8) & (F.col("part") - F.shiftleft("share", shift) > bar)
    rows = rows.withColumn("freq", F.when(F.col("n") <= F.shiftright("total", table_log), F.lit(-1).cast("long")).otherwise(F.col("share") + up.cast("long")))
    # at most 256 rows
    top = F.row_number().over(Window.orderBy(F.desc("freq"), "byte")) == 1
    left = F.lit(1 << table_log) - F.sum(F.abs("freq")).over(whole)
    return rows.select("byte", (F.col("freq") + F.when(top, left).otherwise(0)).cast("long").alias("freq"))


def lru(trace: DataFrame, capacity: int, shards: int = 8) -> DataFrame:
    """(shard, requests, hits, evictions) of a least-recently-used buffer of ``capacity`` bytes a shard.

    ``trace``: shard, seq, key, size, pins (requests during which a key may not go).
    """

    def run(key, rows):
        import pandas as pd

        held: dict = {}
        pinned: dict = {}
        used = hits = evictions = 0
        for seq, own, size, pins in rows.sort_values("seq")[["seq", "key", "size", "pins"]].itertuples(index=False):
            if own in held:
                hits += 1
                held[own] = held.pop(own)
            else:
                tries = len(held)
                while used + size > capacity and tries:
                    first = next(iter(held))
                    kept = held.pop(first)
                    if pinned.get(first, -1) >= seq:
                        held[first] = kept
                    else:
                        used -= kept
                        evictions += 1
                    tries -= 1
                held[own] = size
                used += size
            pinned[own] = seq + pins
        return pd.DataFrame([(key[0], len(rows), hits, evictions)], columns=["shard", "requests", "hits", "evictions"])

    return trace.groupBy("shard").applyInPandas(run, "shard long, requests long, hits long, evictions long")
