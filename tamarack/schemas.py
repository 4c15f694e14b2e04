"""The five normalised telemetry schemas and permissive conforming to them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

_TYPES = {"DOUBLE": DoubleType(), "STRING": StringType(), "INT": IntegerType(), "BIGINT": LongType(), "BOOLEAN": BooleanType()}


def struct(ddl: str) -> StructType:
    """A flat schema from DDL, without a session."""
    return StructType([StructField(name, _TYPES[kind]) for name, kind in (x.split() for x in ddl.split(","))])


CONNECTIONS = struct(
    "ts DOUBLE, uid STRING, src_ip STRING, src_port INT, dst_ip STRING, dst_port INT, proto STRING, service STRING, duration DOUBLE, "
    "orig_bytes BIGINT, resp_bytes BIGINT, orig_pkts BIGINT, resp_pkts BIGINT, conn_state STRING, source_file STRING, source_line BIGINT"
)
DNS = struct("ts DOUBLE, uid STRING, src_ip STRING, dst_ip STRING, query STRING, qtype STRING, rcode STRING, answers STRING, source_file STRING, source_line BIGINT")
SSL = struct(
    "ts DOUBLE, uid STRING, src_ip STRING, src_port INT, dst_ip STRING, dst_port INT, version STRING, cipher STRING, server_name STRING, ja3 STRING, ja3s STRING, "
    "established BOOLEAN, source_file STRING, source_line BIGINT"
)
PROCESSES = struct(
    "ts DOUBLE, host STRING, user STRING, image STRING, command_line STRING, current_directory STRING, integrity_level STRING, process_guid STRING, process_id BIGINT, "
    "parent_image STRING, parent_command_line STRING, parent_guid STRING, parent_process_id BIGINT, sha256 STRING, source_file STRING, source_line BIGINT"
)
ALERTS = struct(
    "ts DOUBLE, src_ip STRING, dst_ip STRING, dst_port INT, proto STRING, signature STRING, signature_id BIGINT, category STRING, severity INT, source_file STRING, source_line BIGINT"
)

BY_NAME = {"connections": CONNECTIONS, "dns": DNS, "ssl": SSL, "processes": PROCESSES, "alerts": ALERTS}


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """Exactly the schema's columns in its order: extra ones go, missing ones are typed nulls, what can't be cast is null."""
    have = set(df.columns)
    return df.select(*[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields])


def empty(spark: SparkSession, schema: StructType) -> DataFrame:
    return spark.createDataFrame([], schema)
