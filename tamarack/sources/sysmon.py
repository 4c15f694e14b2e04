"""Windows process creations from Sysmon's JSON lines, as different collectors spell them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack import schemas
from tamarack.sources.lines import epoch_of, key, numbered_lines

_HINT = "Microsoft-Windows-Sysmon"
_PROVIDERS = ("microsoft-windows-sysmon", "microsoft-windows-sysmon/operational")
# Names of Sysmon's fields in lower case.
_FIELDS = {
    "host": ("hostname", "computer"), "user": ("user",), "image": ("image",), "command_line": ("commandline",), "current_directory": ("currentdirectory",), "integrity_level": ("integritylevel",),
    "process_guid": ("processguid",), "process_id": ("processid",), "parent_image": ("parentimage",), "parent_command_line": ("parentcommandline",), "parent_guid": ("parentprocessguid",), "parent_process_id": ("parentprocessid",),
}


def sha256_of(hashes: Column) -> Column:
    """The SHA256 among ALGORITHM=digest pairs."""
    return F.nullif(F.trim(F.regexp_extract(hashes, r"(?i)(?:^|,)\s*SHA256\s*=\s*([^,]*)", 1)), F.lit(""))


def load_processes(spark: SparkSession, path: str, glob: str = "*.json*") -> DataFrame:
    """Process creations; the sensor's own clock counts before the collector's."""
    lines = numbered_lines(spark, path, glob).where(F.contains("value", F.lit(_HINT)) & ~F.ltrim("value").startswith("#"))
    rows = lines.select(F.map_entries(F.from_json("value", "map<string,string>")).alias("e"), "source_file", "source_line").where("e is not null")
    exact = lambda *names: F.get(F.filter("e", lambda x: x["key"].isin(*names) & x["value"].isNotNull()), F.lit(0))["value"]
    provider = F.exists("e", lambda x: x["key"].isin("SourceName", "Channel", "provider", "Provider") & F.lower(F.trim(x["value"])).isin(*_PROVIDERS))
    rows = rows.where((F.trim(exact("EventID")) == "1") & provider)
    clock = F.coalesce(epoch_of(exact("UtcTime", "utctime")), epoch_of(exact("@timestamp", "timestamp")))
    e = F.col("e")
    out = rows.select(clock.alias("ts"), *[F.coalesce(*[key(e, n) for n in names]).alias(k) for k, names in _FIELDS.items()], sha256_of(key(e, "hashes")).alias("sha256"), "source_file", "source_line")
    return schemas.conform(out, schemas.PROCESSES)
