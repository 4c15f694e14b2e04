"""Periodic contact from one source to one destination.

Two passes: scalar sums of every (source, destination, port), a gate on them, then the arrival times of the candidates
alone.  The candidates' statistics are relational kernels; no series is gathered.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack.functions.exprs import rarity, saturating, weighted_mean
from tamarack.operators import kernels as K
from tamarack.operators.common import key_of, not_among, null_safe_semi, top, with_locators
from tamarack.runtime import materialize

KEYS = ["src_ip", "dst_ip", "dst_port"]
WEIGHTS = {"interval_regularity": 0.26, "schedule_floor": 0.12, "payload_uniformity": 0.20, "periodicity": 0.18, "persistence": 0.12, "destination_rarity": 0.12}


@dataclass(frozen=True)
class Config:
    min_connections: int = 24
    min_span_seconds: float = 3600.0
    min_period_seconds: float = 1.0
    max_period_seconds: float = 86400.0
    max_interval_dispersion: float = 0.6
    max_floor_dispersion: float = 0.6
    max_size_dispersion: float = 0.5
    strong_samples: float = 15.0
    ignored_ports: tuple[int, ...] = (123,)
    ignored_services: tuple[str, ...] = ("ntp", "dhcp")
    threshold: float = 0.72
    critical: float = 0.90
    max_findings: int = 200
    artifact_samples: int = 5


def summary(conns: DataFrame) -> DataFrame:
    """Records, first and last time of each pair and port."""
    return conns.dropna(subset=["ts", "src_ip", "dst_ip"]).groupBy(*KEYS).agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def prevalence(summed: DataFrame) -> DataFrame:
    """Distinct sources of each destination, over all pairs, before any gate."""
    return summed.groupBy("dst_ip").agg(F.count_distinct("src_ip").alias("contacting_hosts"))


def candidates(summed: DataFrame, cfg: Config = Config()) -> DataFrame:
    return summed.where((F.col("n") >= cfg.min_connections) & (F.col("last_ts") - F.col("first_ts") >= cfg.min_span_seconds) & not_among("dst_port", cfg.ignored_ports))


def candidate_events(conns: DataFrame, gated: DataFrame, cfg: Config = Config()) -> DataFrame:
    """The candidates' records with their pair's key; ports may be null, so the semi-join is null-safe."""
    rows = with_locators(conns.dropna(subset=["ts", "src_ip", "dst_ip"]))
    if "service" in rows.columns:
        rows = rows.where(F.col("service").isNull() | ~F.lower("service").isin(*cfg.ignored_services))
    if "orig_bytes" not in rows.columns:
        rows = rows.withColumn("orig_bytes", F.lit(None).cast("bigint"))
    return null_safe_semi(rows, gated, KEYS).withColumn("pair", key_of(*KEYS))


def score(conns: DataFrame, cfg: Config = Config()) -> DataFrame:
    """All measurements and the score of every candidate that can be scored."""
    summed = materialize(summary(conns), "beacon-pairs")
    rows = candidate_events(conns, candidates(summed, cfg), cfg).select("pair", *KEYS, "ts", "orig_bytes", "source_file", "source_line")
    order = ["source_file", "source_line"]
    rows = materialize(rows, "beacon-records")
    kept = rows.groupBy("pair", *KEYS).agg(F.count("*").alias("raw_records"), (F.max("ts") - F.min("ts")).alias("span"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_raw"))
    kept = materialize(kept.where((F.col("raw_records") >= cfg.min_connections) & (F.col("span") >= cfg.min_span_seconds)), "beacon-candidates")
    long = kept.where(F.col("raw_records") > K.LONG_KEY).limit(1).count() > 0
    rows = rows.join(kept.select("pair"), "pair", "left_semi")
    # candidates are a small share of all records, and each kernel reads them several times
    spaced = materialize(K.gaps(rows, "pair", "ts", order, long), "beacon-gaps")
    thresholds = materialize(K.gap_threshold(spaced, "pair"), "beacon-thresholds")
    bursts = K.coalesce_bursts(spaced, thresholds, "pair", "ts", "orig_bytes", order, long)
    bursts = materialize(K.gaps(bursts, "pair", "ts", ["records"], long), "beacon-bursts")
    enough = bursts.groupBy("pair").agg(F.count("*").alias("samples"), F.max("ts").alias("last_ts")).where(F.col("samples") >= cfg.min_connections)
    intervals = bursts.where("gap > 0").select("pair", "gap").join(enough.select("pair"), "pair", "left_semi")
    timing = K.dispersion(intervals, "pair", "gap", long).where((F.col("n") >= 3) & F.col("med").between(cfg.min_period_seconds, cfg.max_period_seconds))
    timing = materialize(timing, "beacon-timing")
    sizes = K.dispersion(bursts.select("pair", F.col("orig_bytes").cast("double").alias("size")), "pair", "size", long).where("n >= 3")
    sizes = sizes.select("pair", F.col("cod").alias("size_dispersion"), F.col("med").alias("median_bytes"))
    rhythm = K.periodicity(bursts.select("pair", "ts"), timing.select("pair", F.col("med").alias("period"), F.col("mad").alias("jitter")), "pair", "ts")
    joined = kept.join(enough, "pair").join(timing, "pair").join(sizes, "pair", "left").join(rhythm, "pair", "left").join(thresholds, "pair", "left").join(prevalence(summed), "dst_ip", "left")
    hosts = F.coalesce("contacting_hosts", F.lit(1))
    expected = F.col("span") / F.col("med")
    coverage = F.least(F.col("n").cast("double"), expected) / F.greatest(F.col("n").cast("double"), expected)
    floor = K.schedule_floor(F.col("n"), F.col("q25"), F.col("med"))
    parts = {
        "interval_regularity": 1 - F.least(F.lit(1.0), F.col("cod") / cfg.max_interval_dispersion),
        "schedule_floor": 1 - F.least(F.lit(1.0), floor / cfg.max_floor_dispersion),
        "payload_uniformity": F.when(F.col("size_dispersion").isNotNull(), 1 - F.least(F.lit(1.0), F.col("size_dispersion") / cfg.max_size_dispersion)),
        "periodicity": F.col("autocorrelation"),
        "persistence": coverage * saturating(F.col("samples"), cfg.strong_samples),
        "destination_rarity": rarity(hosts),
    }
    measured = joined.select(
        *KEYS, F.col("med").alias("period"), F.col("cod").alias("interval_dispersion"), floor.alias("floor_dispersion"), "median_bytes", "size_dispersion", "autocorrelation",
        hosts.alias("contacting_hosts"), "samples", "raw_records", F.col("threshold").alias("burst_threshold"), "span", coverage.alias("coverage"), "first_ts", "last_ts",
        *[c.alias(k) for k, c in parts.items()],
    )
    return measured.withColumn("score", weighted_mean({k: (F.col(k), w) for k, w in WEIGHTS.items()}))


def detect(conns: DataFrame, cfg: Config = Config()) -> DataFrame:
    return top(score(conns, cfg).where(F.col("score") >= cfg.threshold), cfg.max_findings, F.desc("score"), "src_ip", "dst_ip", "dst_port")
