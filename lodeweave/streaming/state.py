"""Structured Streaming forms: ingestion, windows, running counters and keyed admission state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from ..operators.ranking import outcome_counts

EVENT = "ts string, type string, data string"


def read_log(spark: SparkSession, path: str, lateness: str = "1 day") -> DataFrame:
    """A stream of (at, type, data) from JSON lines; later events than ``lateness`` may be left out."""
    raw = spark.readStream.schema(EVENT).option("pathGlobFilter", "*.jsonl").json(path)
    good = raw.where(F.col("ts").isNotNull() & F.col("type").isNotNull() & F.col("data").isNotNull())
    return good.select(F.expr("try_to_timestamp(ts)").alias("at"), "type", "data").where("at is not null").withWatermark("at", lateness)


def rolling_counts(events: DataFrame, width: str = "1 day", slide: str = "1 hour") -> DataFrame:
    w = F.window("at", width, slide)
    return events.groupBy(w, "type").agg(F.count("*").alias("events")).select(F.col("window.start").alias("start"), "type", "events")


def idle_sessions(events: DataFrame, gap: str = "30 seconds") -> DataFrame:
    return events.groupBy(F.session_window("at", gap), "type").agg(F.count("*").alias("events")).select(F.col("session_window.start").alias("start"), "type", "events")


def running_outcomes(outcomes: DataFrame, flush: Callable[[DataFrame], None], checkpoint: str, every: str = "5 seconds"):
    """Counters of a stream of (strategy_id, kind, ts), with the last win, handed to flush with each trigger."""
    counts = outcome_counts(outcomes)
    return counts.writeStream.outputMode("update").foreachBatch(lambda df, _: flush(df)).option("checkpointLocation", checkpoint).trigger(processingTime=every)


GRANT = StructType([StructField("key", LongType()), StructField("request_id", LongType()), StructField("granted", BooleanType())])


class Admission(StatefulProcessor):
    """Grants at most ``per`` requests of a key in a sliding window; the live grants are the state."""

    def __init__(self, per: int, window_us: int):
        self.per, self.window_us = per, window_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.grants = handle.getListState("grants", StructType([StructField("at_us", LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:
        live = [r[0] for r in self.grants.get()] if self.grants.exists() else []
        frame = pd.concat(list(rows)).sort_values(["at_us", "request_id"])
        out = []
        for at, request in zip(frame["at_us"], frame["request_id"]):
            live = [g for g in live if g > at - self.window_us]
            ok = len(live) < self.per
            if ok:
                live.append(int(at))
            out.append((key[0], int(request), ok))
        if live:
            self.grants.put([(g,) for g in live])
        else:
            self.grants.clear()
        yield pd.DataFrame(out, columns=["key", "request_id", "granted"])

    def close(self) -> None:
        return None


def admit(requests: DataFrame, per: int, window_us: int) -> DataFrame:
    """A stream of requests(key, at_us, request_id) to grants.  Needs the RocksDB state store."""
    return requests.groupBy("key").transformWithStateInPandas(statefulProcessor=Admission(per, window_us), outputStructType=GRANT, outputMode="Append", timeMode="None")
