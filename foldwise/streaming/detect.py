"""Base detection over a stream of sketches: state per batch, cleared when the batch ends."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUTPUT = "batch long, t long, b long, score long, first_k int, fix_flag int"
#: The state store that keeps maps entry by entry.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def choose(tables: dict, sf: list[int], pos: list[int]) -> tuple | None:
    """(b, score, first_k, fix_flag) of the best base among what ``tables`` hold, as in the batch form."""
    found: dict[int, list[int]] = {}
    for k, value in enumerate(sf):
        for other, place in tables.get((k, value), ()):
            score = found.setdefault(other, [0, k, 0])
            score[0] += 1
            score[2] |= place == pos[k]
    if not found:
        return None
    base, (score, first, same) = min(found.items(), key=lambda x: (-x[1][0], x[1][1], x[0]))
    return base, score, first, 1 - int(same)


class _Detector(StatefulProcessor):
    """A batch's feature tables, one state entry for each slot's value, and the sketches that are in them.

    A micro-batch reads and writes only the entries of its own values. Of records with
    equal sketches only the first is entered, so the state grows with the distinct
    sketches, and no value's list with the copies of one record.
    """

    def __init__(self, minutes: int):
        self.minutes = minutes

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.tables = handle.getMapState("tables", "k int, sf long", "seqs array<long>, places array<long>")
        self.sketches = handle.getMapState("sketches", "sf array<long>", "seq long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values("seq")
        held: dict = {}
        for sf in frame["sf"]:
            for slot in enumerate(map(int, sf)):
                if slot not in held:
                    seqs, places = self.tables.getValue(slot) if self.tables.containsKey(slot) else ((), ())
                    held[slot] = list(zip(seqs, places, strict=True))
        out, changed, known = [], set(), {}
        for row in frame.itertuples(index=False):
            sf, pos = list(map(int, row.sf)), list(map(int, row.pos))
            if best := choose(held, sf, pos):
                out.append((key[0], int(row.seq), *best))
            whole = tuple(sf)
            if whole not in known:
                known[whole] = self.sketches.containsKey((sf,))
            if not known[whole]:
                known[whole] = True
                self.sketches.updateValue((sf,), (int(row.seq),))
                for slot in enumerate(sf):
                    held[slot].append((int(row.seq), pos[slot[0]]))
                    changed.add(slot)
        if bool(frame["end"].any()):
            self._clear()
        else:
            for slot in changed:
                self.tables.updateValue(slot, ([s for s, _ in held[slot]], [p for _, p in held[slot]]))
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.minutes * 60_000)
        yield pd.DataFrame(out, columns=["batch", "t", "b", "score", "first_k", "fix_flag"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._clear()
        return iter(())

    def _clear(self) -> None:
        self.tables.clear()
        self.sketches.clear()

    def close(self) -> None:
        pass


def detect(sketches: DataFrame, minutes: int = 60) -> DataFrame:
    """(batch, t, b, score, first_k, fix_flag) of a stream of (batch, seq, sf, pos, end).

    Each batch's feature tables are the state of its key; records of a micro-batch
    are taken in order of seq. A record with end = true closes its batch and drops
    the state, as does a batch that gets nothing for ``minutes``.
    """
    sketches.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    return sketches.groupBy("batch").transformWithStateInPandas(_Detector(minutes), OUTPUT, "append", "processingTime")


def tumbling_counts(events: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Events a window and type, with a watermark: the streaming form of ``stream_batches``."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("w.start", "event_type", "n", "total")


def watch(spark: SparkSession, folder: str, schema: str, files_a_trigger: int = 100) -> DataFrame:
    """A stream of the Parquet files that arrive in a folder, so many a trigger: back-pressure by the source."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger).parquet(folder)
