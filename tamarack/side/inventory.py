"""Asset inventory: hand-written .inv files, and names of addresses at the time of a capture."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tamarack.functions.exprs import day_of
from tamarack.side.indicators import small
from tamarack.side.text import canonical_ip, is_hostname, read_date, read_lines

SCHEMA = (
    "address STRING, hostname STRING, register STRUCT<name: STRING, path: STRING, updated: DATE, reference: STRING, tlp: STRING, metadata: MAP<STRING, STRING>>, "
    "stated DATE, note STRING, attributes MAP<STRING, STRING>, source_file STRING, source_line BIGINT, source_text STRING"
)
STALE_DAYS, EXPIRED_DAYS = 90, 730
_REGISTER_KEYS = {"name", "updated", "date", "reference", "source", "tlp"}


def read_inv_text(text: str, path: str) -> tuple[list[tuple], list[tuple[str, int, str]]]:
    """Rows of SCHEMA and rejected lines of one file."""
    header, rows, rejects = read_lines(text, 2)
    updated = read_date(header.get("updated") or header.get("date"))
    register = (header.get("name") or Path(path).stem, path, updated, header.get("reference") or header.get("source"), header.get("tlp"), {k: v for k, v in header.items() if k not in _REGISTER_KEYS})
    out, bad = [], [(path, n, line) for n, line in rejects]
    for number, (address, hostname), attributes, line in rows:
        ip = canonical_ip(address)
        if ip is None or not is_hostname(hostname):
            bad.append((path, number, line))
            continue
        stated = read_date(attributes.get("stated") or attributes.get("first_seen")) or updated
        rest = {k: v for k, v in attributes.items() if k not in {"stated", "first_seen", "note"}}
        out.append((ip, hostname.strip().rstrip("."), register, stated, attributes.get("note"), rest, path, number, line))
    return out, bad


def load_inventory(spark: SparkSession, directory: str) -> tuple[DataFrame, list[tuple[str, int, str]]]:
    rows, bad = [], []
    for path in sorted(Path(directory).rglob("*.inv")):
        try:
            found, rejected = read_inv_text(path.read_text(encoding="utf-8", errors="replace"), str(path))
        except OSError:
            continue
        rows += found
        bad += rejected
    return spark.createDataFrame(rows, SCHEMA), bad


def resolved(inventory: DataFrame) -> DataFrame:
    """One mapping an address: dated before undated, newer before older, then by file and line."""
    by = Window.partitionBy("address").orderBy(F.desc_nulls_last("stated"), "source_file", "source_line")
    return inventory.withColumn("__n", F.row_number().over(by)).where("__n = 1").drop("__n")


def ladder(mappings: DataFrame, start: str = "capture_start") -> DataFrame:
    """mappings with age_days and staleness against the day of a capture (a column); expired ones aren't applied."""
    age = F.datediff(F.col(start), F.col("stated"))
    state = (
        F.when(F.col("stated").isNull(), "undated")
        .when(F.col(start).isNull(), "unknown_window")
        .when(age < 0, "stated_after_capture")
        .when(age > EXPIRED_DAYS, "expired")
        .when(age > STALE_DAYS, "stale")
        .otherwise("current")
    )
    return mappings.withColumn("age_days", age).withColumn("staleness", state).withColumn("applied", F.col("staleness") != "expired")


def capture_window(*frames: DataFrame) -> DataFrame:
    """One row: first and last time over all frames, and the day of the first."""
    parts = [f.agg(F.min("ts").alias("a"), F.max("ts").alias("b")) for f in frames]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return both.agg(F.min("a").alias("first_ts"), F.max("b").alias("last_ts")).withColumn("capture_start", day_of(F.col("first_ts")))


def with_actor(rows: DataFrame, inventory: DataFrame, window: DataFrame, address: str, prefix: str = "actor") -> DataFrame:
    """rows with the actor's type and value: the host that the inventory names for the address, else the address."""
    current = ladder(resolved(inventory).join(F.broadcast(window.select("capture_start")))).where("applied")
    names = small(current.select(F.col("address").alias("__address"), F.col("hostname").alias("__host")))
    joined = rows.join(names, F.col(address) == F.col("__address"), "left")
    kind = F.when(F.col("__host").isNotNull(), "host").otherwise("ip")
    return joined.withColumn(f"{prefix}_type", kind).withColumn(f"{prefix}_value", F.coalesce("__host", address)).drop("__address", "__host")


def coverage(inventory: DataFrame, sources: list[DataFrame], address: str = "src_ip") -> DataFrame:
    """One row: distinct source addresses of all frames, how many the inventory names, and how many it doesn't."""
    seen = sources[0].select(address)
    for s in sources[1:]:
        seen = seen.union(s.select(address))
    seen = seen.where(F.col(address).isNotNull()).distinct()
    named = seen.join(small(inventory.select(F.col("address").alias(address)).distinct()).withColumn("named", F.lit(1)), address, "left")
    return named.agg(F.count("*").alias("addresses"), F.count("named").alias("named"), (F.count("*") - F.count("named")).alias("unnamed"))
