"""Streams: sensor directories as they grow, and the first passes of detectors as windowed partial sums.

The first pass of every two-pass detector is made of counts, sums, minima and maxima, so partial sums by window add up
to the batch result exactly; late records within the watermark are counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tamarack import schemas

KEYS = ["src_ip", "dst_ip", "dst_port"]


def stream_table(spark: SparkSession, path: str, schema, per_trigger: int = 100) -> DataFrame:
    """A growing Parquet directory as a stream of conformed rows with event_time."""
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)
    return with_event_time(raw)


def stream_alerts(spark: SparkSession, path: str) -> DataFrame:
    """A growing directory of EVE files as a stream of alerts; line numbers aren't known in a stream."""
    from tamarack.sources.lines import epoch_of
    from tamarack.sources.suricata import _SHAPE

    rows = spark.readStream.text(path).select(F.from_json("value", _SHAPE).alias("j")).where("j.event_type = 'alert'")
    out = rows.select(epoch_of(F.col("j.timestamp")).alias("ts"), "j.src_ip", F.col("j.dest_ip").alias("dst_ip"), F.col("j.dest_port").alias("dst_port"), "j.proto", "j.alert.signature", "j.alert.signature_id", "j.alert.category", "j.alert.severity")
    return with_event_time(schemas.conform(out.where("ts is not null and signature is not null"), schemas.ALERTS))


def with_event_time(df: DataFrame) -> DataFrame:
    return df.withColumn("event_time", F.timestamp_micros((F.col("ts") * 1e6).cast("long")))


def pair_partials(rows: DataFrame, window: str = "1 hour", slide: str | None = None, lateness: str = "10 minutes") -> DataFrame:
    """Records, first and last time and bytes of each pair by window, tumbling or sliding."""
    span = F.window("event_time", window, slide) if slide else F.window("event_time", window)
    return rows.withWatermark("event_time", lateness).groupBy(span, *KEYS).agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.sum("orig_bytes").alias("bytes"))


def merged(partials: DataFrame) -> DataFrame:
    """Partial sums of tumbling windows as the batch summary."""
    return partials.groupBy(*KEYS).agg(F.sum("n").alias("n"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"))


def bursts(rows: DataFrame, gap: str = "5 seconds", lateness: str = "10 minutes") -> DataFrame:
    """Sessions of a pair's records: a burst ends after a gap."""
    return rows.withWatermark("event_time", lateness).groupBy(F.session_window("event_time", gap), *KEYS).agg(F.count("*").alias("records"), F.min("ts").alias("ts"), F.sum("orig_bytes").alias("orig_bytes"))


def rolling_intervals(rows: DataFrame, keep: int = 256, lateness: str = "10 minutes") -> DataFrame:
    """Running interval statistics of each pair over its last contacts: bounded state by key, dropped after a day of silence."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        known = list(state.get[0]) if state.exists else []
        seen = state.get[1] if state.exists else 0
        for b in batches:
            known += b["ts"].tolist()
            seen += len(b)
        known = sorted(known)[-keep:]
        state.update((known, seen))
        state.setTimeoutTimestamp(max(int(known[-1] * 1000), state.getCurrentWatermarkMs()) + 86_400_000)
        gaps = pd.Series(known).diff().dropna()
        gaps = gaps[gaps > 0]
        median = float(gaps.median()) if len(gaps) else float("nan")
        mad = float((gaps - median).abs().median()) if len(gaps) else float("nan")
        yield pd.DataFrame({"src_ip": [key[0]], "dst_ip": [key[1]], "dst_port": [key[2]], "n": [seen], "period": [median], "jitter": [mad]})

    return (
        rows.withWatermark("event_time", lateness)
        .groupBy(*KEYS)
        .applyInPandasWithState(step, "src_ip string, dst_ip string, dst_port int, n long, period double, jitter double", "times array<double>, n long", "update", GroupStateTimeout.EventTimeTimeout)
    )


def run_to_memory(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Everything that is there now, through the streaming engine, into a table in memory (tests and small results)."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
