"""A capture directory as a context: all sources, with passive DNS where there is no DNS log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tamarack.plans.context import Context
from tamarack.side.indicators import load_indicators
from tamarack.side.inventory import load_inventory
from tamarack.sources import passivedns, suricata, sysmon, zeek


def load_capture(spark: SparkSession, directory: str, words: DataFrame | None = None, capture_start: float = 0.0) -> tuple[Context, list[tuple[str, int, str]]]:
    """The context of a directory and the lines of its side files that were rejected."""
    dns = zeek.load_dns(spark, directory)
    if dns.isEmpty():
        dns = passivedns.load_passivedns(spark, directory, capture_start=capture_start)
    indicators, bad = load_indicators(spark, directory)
    inventory, worse = load_inventory(spark, directory)
    frames = {"connections": zeek.load_connections(spark, directory), "dns": dns, "ssl": zeek.load_ssl(spark, directory), "alerts": suricata.load_alerts(spark, directory), "processes": sysmon.load_processes(spark, directory)}
    if words is not None:
        frames["words"] = words
    return Context.of(spark, indicators=indicators, inventory=inventory, **frames), bad + worse
