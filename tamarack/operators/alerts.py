"""Triage of signature alerts: rarity across the estate, stated severity and category; volume never counts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack.functions.exprs import category_weight, count_values, rarity, severity_score, weighted_mean
from tamarack.operators.common import RECORD_ORDER, top, with_locators

WEIGHTS = {"signature_rarity": 0.45, "stated_severity": 0.30, "category_weight": 0.25}


@dataclass(frozen=True)
class Config:
    min_alerts: int = 3
    environmental_hosts: int = 50
    environmental_rarity: float = 0.05
    threshold: float = 0.45
    medium: float = 0.75
    max_findings: int = 200
    artifact_samples: int = 3


def clusters(alerts: DataFrame) -> DataFrame:
    """By source and signature; id and category are those of the first record."""
    rows = with_locators(alerts.dropna(subset=["ts", "src_ip", "signature"]))
    order = F.struct(*RECORD_ORDER)
    return rows.groupBy("src_ip", "signature").agg(
        F.count("*").alias("alerts"), F.min_by("signature_id", order).alias("signature_id"), F.min_by("category", order).alias("category"), F.min("severity").alias("severity"),
        count_values(F.col("dst_ip")).alias("targets"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
    )


def prevalence(alerts: DataFrame) -> DataFrame:
    return alerts.dropna(subset=["src_ip", "signature_id"]).groupBy("signature_id").agg(F.count_distinct("src_ip").alias("hosts"))


def score(alerts: DataFrame, cfg: Config = Config()) -> DataFrame:
    rows = clusters(alerts).where(F.col("alerts") >= cfg.min_alerts).join(prevalence(alerts), "signature_id", "left").withColumn("hosts", F.coalesce("hosts", F.lit(1)))
    plain = rarity(F.col("hosts"))
    rows = rows.withColumns(
        {
            "signature_rarity": F.when(F.col("hosts") >= cfg.environmental_hosts, F.least(plain, F.lit(cfg.environmental_rarity))).otherwise(plain),
            "stated_severity": severity_score(F.col("severity")),
            "category_weight": category_weight(F.col("category")),
        }
    )
    return rows.withColumn("score", weighted_mean({k: (F.col(k), w) for k, w in WEIGHTS.items()}))


def detect(alerts: DataFrame, cfg: Config = Config()) -> DataFrame:
    return top(score(alerts, cfg).where(F.col("score") >= cfg.threshold), cfg.max_findings, F.desc("score"), F.desc("alerts"), "src_ip", "signature")
