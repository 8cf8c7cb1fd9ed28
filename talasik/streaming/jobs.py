"""The state-like rules as Structured Streaming jobs; each has a batch twin among the operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from talasik.operators.matching import unseen


def without_replays(stream: DataFrame, key: list[str], ts: str, seconds: int = 60, late: str = "10 minutes") -> DataFrame:
    """Rows that are no replay of one let through, as `replays` marks them; state goes once the watermark has passed.

    A key's state is the times of the rows let through that later ones may still be held against, so it stays small
    however often the key comes. Rows are judged in the order they come, those of a batch by time. Rows later than
    `late` are dropped, rows without a time pass.
    """
    gap = seconds * 1_000_000
    stamped = stream.withColumn(ts, F.col(ts).cast("timestamp"))
    columns = stamped.columns
    timed = stamped.withWatermark(ts, late).withColumn("_t", F.unix_micros(ts))

    def run(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values("_t", kind="stable")
        kept = list(state.get[0]) if state.exists else []
        fresh = []
        for t in rows["_t"].tolist():
            if t != t or t is None:
                fresh.append(True)
                continue
            fresh.append(not any(0 <= t - x <= gap for x in kept))
            if fresh[-1]:
                kept.append(int(t))
        mark = state.getCurrentWatermarkMs()
        kept = sorted(x for x in kept if (x + gap) // 1000 >= mark)
        if kept:
            state.update((kept,))
            state.setTimeoutTimestamp(max(mark, (kept[-1] + gap) // 1000) + 1)
        elif state.exists:
            state.remove()
        yield rows[fresh][columns]

    return timed.groupBy(*key).applyInPandasWithState(run, stamped.schema, "kept array<bigint>", "append", GroupStateTimeout.EventTimeTimeout)


def trend(stream: DataFrame, ts: str, unit: str = "month") -> DataFrame:
    """period and n, for complete output mode: months have no fixed length, so they are no windows."""
    return stream.groupBy(F.date_trunc(unit, ts).alias("period")).agg(F.count("*").alias("n"))


def windowed(stream: DataFrame, ts: str, by: list[str], size: str = "1 hour", slide: str | None = None, late: str = "2 hours") -> DataFrame:
    """Counts by event-time window; rows later than `late` are dropped by the watermark."""
    stamped = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return stamped.groupBy(F.window(ts, size, slide) if slide else F.window(ts, size), *by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *by, "n")


def import_new(stream: DataFrame, key: str, table_path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Appends rows whose key neither the table nor the batch before has; the first of a batch stays."""

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = batch.groupBy(key).agg(F.min(F.struct(*[c for c in batch.columns if c != key])).alias("r")).select(key, "r.*").select(*batch.columns)
        try:
            fresh = unseen(fresh, spark.read.parquet(table_path), key)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER" not in str(e):
                raise
        fresh.write.mode("append").parquet(table_path)

    writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def append_audit(stream: DataFrame, table_path: str, checkpoint: str) -> StreamingQuery:
    """Append-only audit table, all rows available now."""
    return stream.writeStream.outputMode("append").format("parquet").option("path", table_path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
