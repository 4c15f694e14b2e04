"""Data carried in DNS names: many distinct, long, random-looking names under one zone."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack.functions.exprs import clip01, entropy_bits, registered_domain, saturating, subdomain, weighted_mean
from tamarack.operators.common import top

WEIGHTS = {"label_entropy": 0.40, "subdomain_cardinality": 0.25, "query_length": 0.25, "qtype_skew": 0.10}
#: Query types that carry more than an address.
HIGH_CAPACITY = ("TXT", "NULL", "CNAME", "MX", "SRV", "10", "16")


@dataclass(frozen=True)
class Config:
    min_queries: int = 50
    min_subdomains: int = 30
    min_length: int = 8
    entropy_floor: float = 3.2
    entropy_ceiling: float = 4.6
    strong_cardinality: float = 200.0
    strong_length: float = 40.0
    threshold: float = 0.62
    critical: float = 0.85
    max_findings: int = 200
    artifact_samples: int = 5


def zones(dns: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Sums by (source, zone), in two levels: distinct subdomains first, each one's entropy worked out once."""
    rows = dns.dropna(subset=["ts", "src_ip", "query"]).withColumn("zone", registered_domain(F.col("query"))).withColumn("sub", subdomain(F.col("query"), F.col("zone")))
    high = F.upper("qtype").isin(*HIGH_CAPACITY) if "qtype" in dns.columns else F.lit(False)
    names = rows.groupBy("src_ip", "zone", "sub").agg(F.count("*").alias("n"), F.count(F.when(high, 1)).alias("high"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    long = F.length("sub") >= cfg.min_length
    return names.groupBy("src_ip", "zone").agg(
        F.sum("n").alias("queries"), F.count(F.when(F.col("sub") != "", 1)).alias("subdomains"),
        F.avg(F.when(long, entropy_bits(F.col("sub")))).alias("mean_entropy"), F.avg(F.when(long, F.length("sub"))).alias("mean_length"),
        (F.sum("high") / F.sum("n")).alias("high_fraction"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"),
    )


def score(dns: DataFrame, cfg: Config = Config()) -> DataFrame:
    rows = zones(dns, cfg).where((F.col("queries") >= cfg.min_queries) & (F.col("subdomains") >= cfg.min_subdomains) & F.col("mean_length").isNotNull())
    rows = rows.withColumns(
        {
            "label_entropy": clip01((F.col("mean_entropy") - cfg.entropy_floor) / (cfg.entropy_ceiling - cfg.entropy_floor)),
            "subdomain_cardinality": saturating(F.col("subdomains"), cfg.strong_cardinality),
            "query_length": saturating(F.col("mean_length"), cfg.strong_length),
            "qtype_skew": F.when(F.col("high_fraction") > 0, F.least(F.lit(1.0), 2 * F.col("high_fraction"))),
        }
    )
    return rows.withColumn("score", weighted_mean({k: (F.col(k), w) for k, w in WEIGHTS.items()}))


def detect(dns: DataFrame, cfg: Config = Config()) -> DataFrame:
    return top(score(dns, cfg).where(F.col("score") >= cfg.threshold), cfg.max_findings, F.desc("score"), "src_ip", "zone")
