"""One source reaching many destinations on one port."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack.functions.exprs import saturating, weighted_mean
from tamarack.operators.common import top

WEIGHTS = {"breadth": 0.55, "non_revisiting": 0.45}


@dataclass(frozen=True)
class Config:
    min_destinations: int = 50
    strong_breadth: float = 250.0
    max_revisits: float = 12.0
    ignored_ports: tuple[int, ...] = (53, 123)
    threshold: float = 0.55
    high: float = 0.85
    max_findings: int = 200
    artifact_samples: int = 5


def summary(conns: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Destinations and flows by source and port.  Distinct destinations are counted in two levels, so a sweep by one source spreads over many tasks."""
    rows = conns.dropna(subset=["ts", "src_ip", "dst_ip", "dst_port"]).where(~F.col("dst_port").isin(*cfg.ignored_ports))
    pairs = rows.groupBy("src_ip", "dst_port", "dst_ip").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return pairs.groupBy("src_ip", "dst_port").agg(F.count("*").alias("destinations"), F.sum("n").alias("flows"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"))


def score(conns: DataFrame, cfg: Config = Config()) -> DataFrame:
    rows = summary(conns, cfg).where(F.col("destinations") >= cfg.min_destinations)
    revisits = F.greatest(F.lit(0.0), F.col("flows") / F.col("destinations") - 1)
    rows = rows.withColumn("breadth", saturating(F.col("destinations"), cfg.strong_breadth)).withColumn("non_revisiting", 1 - F.least(F.lit(1.0), revisits / cfg.max_revisits))
    return rows.withColumn("score", weighted_mean({k: (F.col(k), w) for k, w in WEIGHTS.items()}))


def detect(conns: DataFrame, cfg: Config = Config()) -> DataFrame:
    return top(score(conns, cfg).where(F.col("score") >= cfg.threshold), cfg.max_findings, F.desc("score"), "src_ip", "dst_port")
