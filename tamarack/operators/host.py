"""Processes that few hosts run, and parents that rarely start such a child."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tamarack.functions.exprs import image_name, path_anomaly, rarity, saturating, surprisal, weighted_mean
from tamarack.operators.common import RECORD_ORDER, top, top_per, with_locators
from tamarack.runtime import materialize

PROCESS_WEIGHTS = {"image_prevalence": 0.50, "path_anomaly": 0.34, "execution_prevalence": 0.16}
LINEAGE_WEIGHTS = {"parent_breadth": 0.38, "child_breadth": 0.38, "child_surprisal": 0.24}


@dataclass(frozen=True)
class Config:
    min_hosts: int = 5
    min_executions: int = 200
    max_singleton_share: float = 0.50
    threshold: float = 0.60
    lineage_threshold: float = 0.62
    strong_executions: float = 8.0
    surprisal_cap: float = 6.0
    min_frequency_samples: int = 20
    max_depth: int = 4
    max_findings: int = 60
    max_per_host: int = 5
    artifact_samples: int = 3


def named(processes: DataFrame) -> DataFrame:
    rows = with_locators(processes.dropna(subset=["ts", "host", "image"]))
    return rows.withColumn("image_name", image_name(F.col("image"))).withColumn("parent_name", image_name(F.col("parent_image"))).where("image_name is not null")


def edges(rows: DataFrame) -> DataFrame:
    """Executions by host, parent and child; the path is that of the first record."""
    return rows.groupBy("host", "parent_name", "image_name").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.min_by("image", F.struct(*RECORD_ORDER)).alias("image"))


def summary(processes: DataFrame) -> DataFrame:
    """edges() of all named processes, written once: it is small, and every measure here reads it again."""
    return materialize(edges(named(processes)), "host-edges")


def _spread(summed: DataFrame) -> DataFrame:
    """(name, hosts): the hosts on which an image occurs, in either role."""
    names = F.explode(F.array_distinct(F.array_compact(F.array("image_name", "parent_name"))))
    return summed.select("host", names.alias("name")).distinct().groupBy("name").agg(F.count("*").alias("hosts"))


def estate(summed: DataFrame) -> DataFrame:
    """One row: hosts, executions, distinct images and those on one host only, in either role."""
    spread = _spread(summed)
    images = spread.agg(F.count("*").alias("images"), F.count(F.when(F.col("hosts") == 1, 1)).alias("singletons"))
    base = summed.agg(F.count_distinct("host").alias("hosts"), F.coalesce(F.sum("n"), F.lit(0)).alias("executions"), (F.max("last_ts") - F.min("first_ts")).alias("span"))
    return base.join(images).withColumn("singleton_share", F.when(F.col("images") > 0, F.col("singletons") / F.col("images")).otherwise(F.lit(1.0)))


def gated(summed: DataFrame, cfg: Config = Config()) -> DataFrame:
    """The one row of an estate that can support a claim of rarity, or none."""
    return estate(summed).where((F.col("hosts") >= cfg.min_hosts) & (F.col("executions") >= cfg.min_executions) & (F.col("singleton_share") <= cfg.max_singleton_share))


def _breadths(summed: DataFrame) -> tuple[DataFrame, DataFrame]:
    images = summed.groupBy("image_name").agg(F.count_distinct("host").alias("image_hosts"), F.sum("n").alias("image_executions"))
    pairs = summed.where("parent_name is not null").groupBy("parent_name", "image_name").agg(F.count_distinct("host").alias("pair_hosts"), F.sum("n").alias("pair_executions"))
    return images, pairs


def process_score(processes: DataFrame, cfg: Config = Config(), summed: DataFrame | None = None) -> DataFrame:
    """Every (host, image), scored, where the estate passes the gate; summed: summary(processes), if it is there already."""
    summed = summary(processes) if summed is None else summed
    images, _ = _breadths(summed)
    rows = summed.groupBy("host", "image_name").agg(F.sum("n").alias("observed"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"), F.min_by("image", F.struct("first_ts", "image")).alias("image"))
    rows = rows.join(images, "image_name").join(F.broadcast(gated(summed, cfg).select(F.col("hosts").alias("estate_hosts"), F.col("executions").alias("estate_executions"))))
    rows = rows.withColumns(
        {
            "image_prevalence": rarity(F.col("image_hosts")),
            "path_anomaly": path_anomaly(F.col("image")),
            "execution_prevalence": 1 - saturating(F.col("image_executions"), cfg.strong_executions),
        }
    )
    return rows.withColumn("score", weighted_mean({k: (F.col(k), w) for k, w in PROCESS_WEIGHTS.items()}))


def lineage_score(processes: DataFrame, cfg: Config = Config(), summed: DataFrame | None = None) -> DataFrame:
    """Every (host, parent, child) with a breadth to measure, scored."""
    summed = summary(processes) if summed is None else summed
    images, pairs = _breadths(summed)
    spread = _spread(summed).withColumnRenamed("hosts", "role_hosts")
    spawned = pairs.withColumn("spawned", F.sum("pair_executions").over(Window.partitionBy("parent_name")))
    rows = summed.where("parent_name is not null").join(spawned, ["parent_name", "image_name"])
    rows = rows.join(spread.select(F.col("name").alias("parent_name"), F.col("role_hosts").alias("parent_hosts")), "parent_name").join(images.select("image_name", F.col("image_hosts").alias("child_hosts")), "image_name")
    rows = rows.join(F.broadcast(gated(summed, cfg).select(F.col("hosts").alias("estate_hosts"))))
    share = F.when(F.col("spawned") >= cfg.min_frequency_samples, F.col("pair_executions") / F.col("spawned"))
    breadth = lambda hosts: F.when(F.col(hosts) >= 2, F.greatest(F.lit(0.0), 1 - F.col("pair_hosts") / F.col(hosts)))
    rows = rows.withColumn("child_given_parent", share).withColumns({"parent_breadth": breadth("parent_hosts"), "child_breadth": breadth("child_hosts")})
    rows = rows.where(F.col("parent_breadth").isNotNull() | F.col("child_breadth").isNotNull())
    rows = rows.withColumn("child_surprisal", F.when(F.col("child_given_parent").isNotNull(), surprisal(F.col("child_given_parent"), cfg.surprisal_cap)))
    return rows.withColumn("score", weighted_mean({k: (F.col(k), w) for k, w in LINEAGE_WEIGHTS.items()}))


def subsumed(lineage: DataFrame, rare: DataFrame) -> DataFrame:
    """Lineage rows whose (host, image) isn't reported as a rare process already."""
    return lineage.join(rare.select("host", "image_name").distinct(), ["host", "image_name"], "left_anti")


def detect(processes: DataFrame, cfg: Config = Config()) -> tuple[DataFrame, DataFrame]:
    """(rare processes, anomalous lineage), each capped by host and overall."""
    summed = summary(processes)
    rare = process_score(processes, cfg, summed).where(F.col("score") >= cfg.threshold)
    lineage = subsumed(lineage_score(processes, cfg, summed).where(F.col("score") >= cfg.lineage_threshold), rare)
    order_r, order_l = (F.desc("score"), "host", "image_name"), (F.desc("score"), "host", "parent_name", "image_name")
    capped_r = top(top_per(rare, ["host"], cfg.max_per_host, *order_r), cfg.max_findings, *order_r)
    return capped_r, top(top_per(lineage, ["host"], cfg.max_per_host, *order_l), cfg.max_findings, *order_l)


def ancestry(processes: DataFrame, start: DataFrame, depth: int = 4) -> DataFrame:
    """(process_guid, chain, truncated): image names from the oldest known ancestor down to the parent, at most depth levels.

    Each level is one equi-join on process_guid; a guid already on the path ends the walk.  Of several records of a guid
    the first by RECORD_ORDER counts.  The records are written once as one row a guid, dealt by guid.
    """
    rows = with_locators(processes if "ts" in processes.columns else processes.withColumn("ts", F.lit(None).cast("double"))).where("process_guid is not null")
    order = F.struct(*RECORD_ORDER, F.coalesce("parent_guid", F.lit("")), F.coalesce("image", F.lit("")))
    first = rows.groupBy("process_guid").agg(F.min_by(F.struct("image", "parent_guid", "parent_image"), order).alias("r"))
    known = first.select(F.col("process_guid").alias("k"), image_name(F.col("r.image")).alias("k_name"), F.col("r.parent_guid").alias("k_parent"), image_name(F.col("r.parent_image")).alias("k_parent_name"))
    known = materialize(known, "ancestry")
    rows = start.select("process_guid").distinct().join(known, F.col("process_guid") == F.col("k"))
    rows = rows.select("process_guid", F.col("k_parent").alias("at"), F.col("k_parent_name").alias("name"), F.array("process_guid").alias("path"), F.array().cast("array<string>").alias("chain"))
    for _ in range(depth):
        fresh = F.col("at").isNotNull() & ~F.array_contains("path", F.coalesce("at", F.lit("")))
        rows = rows.join(known, F.when(fresh, F.col("at")) == F.col("k"), "left")
        name = F.when(fresh, F.coalesce("k_name", "name"))
        rows = rows.select(
            "process_guid", F.when(fresh, F.col("k_parent")).alias("at"), F.when(fresh, F.col("k_parent_name")).alias("name"),
            F.when(fresh, F.array_append("path", F.col("at"))).otherwise(F.col("path")).alias("path"),
            F.when(name.isNotNull(), F.concat(F.array(name), F.col("chain"))).otherwise(F.col("chain")).alias("chain"),
        )
    return rows.select("process_guid", "chain", (F.col("at").isNotNull() | F.col("name").isNotNull()).alias("truncated"))
