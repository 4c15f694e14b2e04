"""EVE alert logs: a JSON object a line; a corrupt line costs one record."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack import schemas
from tamarack.sources.lines import epoch_of, numbered_lines

_SHAPE = "timestamp STRING, event_type STRING, src_ip STRING, dest_ip STRING, dest_port STRING, proto STRING, alert STRUCT<signature: STRING, signature_id: STRING, category: STRING, severity: STRING>"
GLOB = "{eve*.json,*.eve.json,alerts*.json}"


def load_alerts(spark: SparkSession, path: str) -> DataFrame:
    """Alerts of all files that match one of the usual names, listed once."""
    lines = numbered_lines(spark, path, GLOB)
    rows = lines.select(F.from_json("value", _SHAPE).alias("j"), "source_file", "source_line").where("j.event_type = 'alert'")
    out = rows.select(
        epoch_of(F.col("j.timestamp")).alias("ts"), "j.src_ip", F.col("j.dest_ip").alias("dst_ip"), F.col("j.dest_port").alias("dst_port"), "j.proto", "j.alert.signature", "j.alert.signature_id", "j.alert.category", "j.alert.severity", "source_file", "source_line",
    ).where("ts is not null and signature is not null")
    return schemas.conform(out, schemas.ALERTS)
