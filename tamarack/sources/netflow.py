"""Labelled NetFlow captures: twelve tab-separated columns after a header line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack import schemas
from tamarack.sources.lines import epoch_of, numbered_lines

#: First of the ports that clients use on current systems.
EPHEMERAL = 32768
_ENDPOINT = "^(.*):([0-9]+)$"


def normal_label(label: Column) -> Column:
    plain = F.lower(label)
    return F.when(F.contains(plain, F.lit("botnet")), "botnet").when(F.contains(plain, F.lit("normal")), "normal").otherwise("background")


def is_reply() -> Column:
    """The answering half of a conversation that another record describes: to an ephemeral port from a lower one."""
    return F.coalesce((F.col("dst_port") >= EPHEMERAL) & (F.col("src_port") < F.col("dst_port")), F.lit(False))


def load_netflow(spark: SparkSession, path: str, glob: str = "*", orient: bool = True) -> DataFrame:
    """Connections with a label; an endpoint without a port keeps its whole text as the address."""
    lines = numbered_lines(spark, path, glob).where("source_line > 1")
    part = lambda i: F.trim(F.get(F.split("value", "\t"), F.lit(i)))
    address = lambda x: F.coalesce(F.nullif(F.regexp_extract(x, _ENDPOINT, 1), F.lit("")), x)
    port = lambda x: F.regexp_extract(x, _ENDPOINT, 2).try_cast("int")
    rows = lines.select(
        epoch_of(part(0)).alias("ts"), part(1).alias("duration"), F.lower(part(2)).alias("proto"), F.nullif(address(part(3)), F.lit("")).alias("src_ip"), port(part(3)).alias("src_port"),
        address(part(5)).alias("dst_ip"), port(part(5)).alias("dst_port"), part(6).alias("conn_state"), part(8).alias("orig_pkts"), part(9).alias("orig_bytes"), normal_label(part(11)).alias("label"), "source_file", "source_line",
    ).where("ts is not null and src_ip is not null")
    if orient:
        rows = rows.where(~is_reply())
    label = F.col("label")
    conformed = schemas.conform(rows, schemas.CONNECTIONS)
    return rows.select(*[rows[f.name].try_cast(f.dataType).alias(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in conformed.schema.fields], label)
