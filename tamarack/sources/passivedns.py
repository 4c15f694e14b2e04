"""passivedns logs: nine fields between double bars, times as offsets or epochs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack import schemas
from tamarack.sources.lines import numbered_lines


def load_passivedns(spark: SparkSession, path: str, glob: str = "*passivedns*", capture_start: float = 0.0) -> DataFrame:
    """Lookups; banners, short lines and unreadable times fall out.  Response codes aren't recorded, so they are null."""
    lines = numbered_lines(spark, path, glob).where(~F.col("value").startswith("[*]") & (F.trim("value") != ""))
    parts = F.split(F.trim("value"), "[|][|]")
    part = lambda i: F.get(parts, F.lit(i))
    rows = lines.where(F.size(parts) >= 9).select(
        (part(0).try_cast("double") + capture_start).alias("ts"), part(1).alias("src_ip"), part(2).alias("dst_ip"), F.rtrim(part(4), F.lit(".")).alias("query"), part(5).alias("qtype"), part(6).alias("answers"), "source_file", "source_line"
    )
    return schemas.conform(rows.where("ts is not null"), schemas.DNS)
