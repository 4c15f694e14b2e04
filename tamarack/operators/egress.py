"""Unusual volume sent out, in three bands of one score; a claim is made only of what was measured."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tamarack.functions.exprs import clip01, rarity, saturating, weighted_mean
from tamarack.operators import kernels as K
from tamarack.operators.common import top
from tamarack.runtime import materialize

WEIGHTS = {"egress_ratio": 0.30, "volume_deviation": 0.28, "destination_rarity": 0.24, "novelty": 0.18}
#: Claims from weak to strong.
BANDS = {"contacts_rare_destination": 0, "transfers_anomalous_volume": 1, "exfiltrates_to": 2}
REQUIRED = {"ts", "src_ip", "dst_ip", "orig_bytes"}


@dataclass(frozen=True)
class Config:
    min_bytes: float = 1_000_000
    min_ratio_coverage: float = 0.5
    ratio_floor: float = 0.5
    ratio_ceiling: float = 0.9
    min_baseline_destinations: int = 5
    strong_deviation: float = 3.5
    min_baseline_span: float = 3600.0
    exfil_threshold: float = 0.70
    critical: float = 0.85
    volume_threshold: float = 0.45
    min_volume_deviation: float = 0.50
    rare_min_bytes: float = 100_000
    rare_min_flows: int = 5
    rare_max_hosts: int = 2
    rare_threshold: float = 0.30
    max_findings: int = 200
    max_rare: int = 25
    artifact_samples: int = 5


def pairs(conns: DataFrame) -> DataFrame:
    """Volume of each (source, destination) that has measured flows, and sums over the flows with both counts."""
    rows = conns.dropna(subset=["ts", "src_ip", "dst_ip"])
    if "resp_bytes" not in rows.columns:
        rows = rows.withColumn("resp_bytes", F.lit(None).cast("bigint"))
    both = F.col("orig_bytes").isNotNull() & F.col("resp_bytes").isNotNull()
    out = rows.groupBy("src_ip", "dst_ip").agg(
        F.count("*").alias("flows"), F.sum("orig_bytes").alias("bytes"), F.count("orig_bytes").alias("measured"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
        F.sum(F.when(both, F.col("orig_bytes"))).alias("paired_out"), F.sum(F.when(both, F.col("resp_bytes"))).alias("paired_in"), F.count(F.when(both, 1)).alias("paired"),
    )
    return out.where("measured > 0")


def baselines(measured: DataFrame, long: bool = False) -> DataFrame:
    """By source: destinations, median and spread of their volumes, and the window it was seen in; long: a source has very many destinations."""
    values = measured.select("src_ip", F.col("bytes").cast("double").alias("b"), "first_ts", "last_ts")
    spread = K.dispersion(values, "src_ip", "b", long, {"host_first": F.min("first_ts"), "host_last": F.max("last_ts")})
    return spread.select("src_ip", F.col("n").alias("base_n"), F.col("med").alias("base_med"), F.col("mad").alias("base_mad"), "host_first", "host_last")


def score(conns: DataFrame, cfg: Config = Config()) -> DataFrame:
    """All measurements and the score of pairs that pass the volume gate; a baseline includes the judged pair."""
    if not REQUIRED <= set(conns.columns):
        raise ValueError(f"egress needs {sorted(REQUIRED)}")
    measured = materialize(pairs(conns), "egress-pairs")
    # one row a source and destination, so rows are distinct sources
    hosts = measured.groupBy("dst_ip").agg(F.count("*").alias("contacting_hosts"))
    large = F.col("bytes") >= cfg.min_bytes
    rare = (F.col("bytes") >= cfg.rare_min_bytes) & (F.col("flows") >= cfg.rare_min_flows) & (F.col("contacting_hosts") <= cfg.rare_max_hosts)
    gated = measured.join(hosts, "dst_ip").where(large | rare)
    base = baselines(measured.join(gated.select("src_ip").distinct(), "src_ip", "left_semi"), K.has_long_key(measured, "src_ip"))
    rows = gated.join(base, "src_ip")
    total = F.col("paired_out") + F.col("paired_in")
    ratio = F.when((F.col("paired") > 0) & (F.col("paired") / F.col("flows") >= cfg.min_ratio_coverage) & (total != 0), F.col("paired_out") / total)
    z = F.when(F.col("base_n") >= cfg.min_baseline_destinations, K.robust_deviation(F.col("bytes").cast("double"), F.col("base_med"), F.col("base_mad"), F.col("base_n")))
    span = F.col("host_last") - F.col("host_first")
    novelty = F.when(span >= cfg.min_baseline_span, (F.col("first_ts") - F.col("host_first")) / span)
    # least() and greatest() skip nulls, so what wasn't measured is set apart before clipping
    rows = rows.withColumn("ratio", ratio).withColumn("z", z).withColumn("novelty_fraction", novelty)
    parts = {
        "egress_ratio": F.when(F.col("ratio").isNotNull(), clip01((F.col("ratio") - cfg.ratio_floor) / (cfg.ratio_ceiling - cfg.ratio_floor))),
        "volume_deviation": F.when(F.col("z").isNotNull(), saturating(F.greatest(F.col("z"), F.lit(0.0)), cfg.strong_deviation)),
        "destination_rarity": rarity(F.col("contacting_hosts")),
        "novelty": F.when(F.col("novelty_fraction").isNotNull(), clip01(F.col("novelty_fraction"))),
    }
    rows = rows.withColumns(parts)
    return rows.withColumn("score", weighted_mean({k: (F.col(k), w) for k, w in WEIGHTS.items()}))


def banded(scored: DataFrame, cfg: Config = Config()) -> DataFrame:
    """The claim each pair supports, only the strongest kind of each source."""
    large = F.col("bytes") >= cfg.min_bytes
    predicate = (
        F.when(large & F.col("egress_ratio").isNotNull() & (F.col("score") >= cfg.exfil_threshold), "exfiltrates_to")
        .when(large & (F.col("score") >= cfg.volume_threshold) & (F.coalesce("volume_deviation", F.lit(0.0)) >= cfg.min_volume_deviation), "transfers_anomalous_volume")
        .when((F.col("bytes") >= cfg.rare_min_bytes) & (F.col("flows") >= cfg.rare_min_flows) & (F.col("contacting_hosts") <= cfg.rare_max_hosts) & (F.col("score") >= cfg.rare_threshold), "contacts_rare_destination")
    )
    rows = scored.withColumn("predicate", predicate).where("predicate is not null")
    band = F.create_map(*[F.lit(x) for k, v in BANDS.items() for x in (k, v)])
    rows = rows.withColumn("band", F.element_at(band, F.col("predicate")))
    return rows.withColumn("best", F.max("band").over(Window.partitionBy("src_ip"))).where("band = best").drop("best")


def detect(conns: DataFrame, cfg: Config = Config()) -> DataFrame:
    rows = banded(score(conns, cfg), cfg)
    order = (F.desc("score"), "src_ip", "dst_ip")
    return top(rows.where("band > 0"), cfg.max_findings, *order).unionByName(top(rows.where("band = 0"), cfg.max_rare, *order))
