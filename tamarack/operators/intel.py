"""Matches of observed addresses and names with indicators, and infrastructure that matched and unmatched names share."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarack.functions.exprs import day_of
from tamarack.operators.common import top, top_per
from tamarack.side.indicators import best_of, ipv4_number, match_names, match_networks, small


@dataclass(frozen=True)
class Config:
    unprovenanced: float = 0.25
    undated_cap: float = 0.35
    half_life_days: float = 180.0
    max_age_days: int = 730
    min_confidence: float = 0.10
    medium: float = 0.50
    max_findings: int = 200
    max_per_indicator: int = 10
    max_links: int = 50
    min_names: int = 2
    max_names: int = 5
    netblock_confidence: float = 0.50


def observations(connections: DataFrame | None = None, alerts: DataFrame | None = None, dns: DataFrame | None = None) -> DataFrame:
    """(value, is_name, events, peers, first_ts, last_ts, roles): each source folded by value, then the sources together; peers is the largest of theirs."""
    parts = []

    def fold(df: DataFrame, value: Column, peer: str, role: str, is_name: bool = False) -> None:
        rows = df.withColumn("value", value).where(F.col("value").isNotNull() & (F.col("value") != "") & F.col("ts").isNotNull())
        missing = F.max(F.when(F.col(peer).isNull(), 1).otherwise(0))
        parts.append(
            rows.groupBy("value").agg(F.count("*").alias("events"), (F.count_distinct(peer) + missing).alias("peers"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")).withColumns({"role": F.lit(role), "is_name": F.lit(is_name)})
        )

    for df in (connections, alerts):
        if df is not None:
            fold(df, F.col("dst_ip"), "src_ip", "destination")
            fold(df, F.col("src_ip"), "dst_ip", "source")
    if dns is not None:
        fold(dns.withColumn("answer", F.explode(F.split("answers", ";"))), F.trim("answer"), "src_ip", "answer")
        fold(dns, F.lower(F.btrim("query", F.lit("."))), "src_ip", "query", True)
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return both.groupBy("value", "is_name").agg(F.sum("events").alias("events"), F.max("peers").alias("peers"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"), F.array_sort(F.collect_set("role")).alias("roles"))


def decayed(base: Column, age_days: Column, cfg: Config = Config()) -> Column:
    """Confidence halved every half-life; of unknown age: at most the cap."""
    return F.when(age_days.isNull(), F.least(base, F.lit(cfg.undated_cap))).otherwise(base * F.pow(F.lit(0.5), age_days / cfg.half_life_days))


def matched(observed: DataFrame, indicators: DataFrame) -> DataFrame:
    """Observations with the one indicator each matches: exactly, in the narrowest netblock, or by the most specific parent."""
    known = best_of(indicators)
    plain = observed.where("not is_name")
    exact = plain.join(small(known.where("kind = 'ip'").withColumnRenamed("value", "indicator")), F.col("value") == F.col("indicator")).withColumn("match", F.lit("exact"))
    rest = plain.join(exact.select("value"), "value", "left_anti")
    nets = known.where("kind = 'cidr'")
    inside = match_networks(rest.withColumnRenamed("value", "address"), nets).select(F.col("address").alias("value"), F.col("network").alias("indicator"))
    block = rest.join(inside, "value").join(small(nets.withColumnRenamed("value", "indicator")), "indicator").withColumn("match", F.lit("netblock"))
    names = observed.where("is_name")
    domains = known.where("kind = 'domain'")
    found = match_names(names.withColumnRenamed("value", "name"), domains).select(F.col("name").alias("value"), F.col("domain").alias("indicator"), "depth")
    named = names.join(found, "value").join(small(domains.withColumnRenamed("value", "indicator")), "indicator").withColumn("match", F.when(F.col("depth") == 0, "exact").otherwise("parent_domain")).drop("depth")
    return exact.unionByName(block).unionByName(named)


def score(observed: DataFrame, indicators: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Matches with age at the first observation and decayed confidence; too old or too weak ones fall out."""
    rows = matched(observed, indicators)
    declared = F.coalesce("confidence", "feed.declared_confidence")
    day = day_of(F.col("first_ts"))
    age = F.when(F.col("added").isNotNull(), F.greatest(F.lit(0), F.datediff(day, F.col("added"))))
    rows = rows.withColumn("base", F.coalesce(declared, F.lit(cfg.unprovenanced))).withColumn("provenanced", declared.isNotNull()).withColumn("age_days", age)
    rows = rows.withColumn("score", decayed(F.col("base"), F.col("age_days"), cfg))
    return rows.where((F.col("age_days").isNull() | (F.col("age_days") <= cfg.max_age_days)) & (F.col("score") >= cfg.min_confidence))


def detect(observed: DataFrame, indicators: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Findings on values; a parent domain gives one on the zone, a netblock a few on its busiest addresses."""
    rows = score(observed, indicators, cfg)
    zones = rows.where("match = 'parent_domain'").groupBy("indicator", "kind", "match").agg(
        F.max("score").alias("score"), F.sum("events").alias("events"), F.max("peers").alias("peers"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"),
        F.slice(F.array_sort(F.collect_set("value")), 1, 5).alias("values"), F.count("*").alias("value_count"),
    ).withColumn("value", F.col("indicator"))
    single = rows.where("match <> 'parent_domain'").select("indicator", "kind", "match", "score", "events", "peers", "first_ts", "last_ts", F.array("value").alias("values"), F.lit(1).cast("bigint").alias("value_count"), "value")
    few = top_per(single, ["indicator"], cfg.max_per_indicator, F.desc("events"), "value").unionByName(zones)
    return top(few, cfg.max_findings, F.desc("score"), "value")


def shared_answers(dns: DataFrame, cfg: Config = Config()) -> DataFrame:
    """(address, name): answers that a few names share; those of one name or of many (shared hosting) say nothing."""
    rows = dns.dropna(subset=["query", "answers"]).select(F.lower(F.btrim("query", F.lit("."))).alias("name"), F.explode(F.split("answers", ";")).alias("address"))
    rows = rows.withColumn("address", F.trim("address")).where(ipv4_number(F.col("address")).isNotNull() & (F.col("name") != "")).distinct()
    few = rows.groupBy("address").agg(F.count("*").alias("breadth")).where(F.col("breadth").between(cfg.min_names, cfg.max_names))
    return rows.join(few, "address")


def links(dns: DataFrame, scored: DataFrame, cfg: Config = Config()) -> DataFrame:
    """(u, v, link, via, anchor_indicator, score), one row an undirected edge.

    A flagged address anchors edges to the names it answers for that aren't flagged by the same indicator; without one,
    one flagged name an indicator anchors the others.  Two flagged addresses of different indicators in one /24 are
    linked too.  Where an edge arises more than once, the lowest address counts.
    """
    flagged = scored.select(F.col("value"), "indicator", "is_name")
    on = shared_answers(dns, cfg)
    marked = on.join(flagged.where("is_name").select(F.col("value").alias("name"), F.col("indicator").alias("name_indicator")), "name", "left")
    marked = marked.join(flagged.where("not is_name").select(F.col("value").alias("address"), F.col("indicator").alias("address_indicator")), "address", "left")
    confidence = F.least(F.lit(0.95), F.lit(2.0) / F.col("breadth"))
    by_address = marked.where("address_indicator is not null").where(~F.coalesce(F.col("name_indicator") == F.col("address_indicator"), F.lit(False)))
    one = by_address.select(F.col("address").alias("u"), F.col("name").alias("v"), F.lit("shared_resolution").alias("link"), F.col("address").alias("via"), F.col("address_indicator").alias("anchor_indicator"), confidence.alias("score"))
    plain = marked.where("address_indicator is null")
    anchors = plain.where("name_indicator is not null").groupBy("address", F.col("name_indicator").alias("anchor_indicator")).agg(F.min("name").alias("anchor"))
    paired = plain.join(anchors, "address").where(~F.coalesce(F.col("name_indicator") == F.col("anchor_indicator"), F.lit(False)) & (F.col("name") != F.col("anchor")))
    two = paired.select(F.col("anchor").alias("u"), F.col("name").alias("v"), F.lit("shared_resolution").alias("link"), F.col("address").alias("via"), "anchor_indicator", confidence.alias("score"))
    blocks = flagged.where("not is_name").withColumn("block", F.shiftright(ipv4_number(F.col("value")), 8)).where("block is not null")
    left, right = blocks.select("block", F.col("value").alias("u"), F.col("indicator").alias("anchor_indicator")), blocks.select("block", F.col("value").alias("v"), F.col("indicator").alias("other"))
    net = left.join(right, "block").where((F.col("u") < F.col("v")) & (F.col("anchor_indicator") != F.col("other")))
    three = net.select("u", "v", F.lit("shared_netblock").alias("link"), F.concat(F.substring_index("u", ".", 3), F.lit(".0/24")).alias("via"), "anchor_indicator", F.lit(cfg.netblock_confidence).alias("score"))
    every = one.unionByName(two).unionByName(three).withColumn("lo", F.least("u", "v")).withColumn("hi", F.greatest("u", "v"))
    chosen = top_per(every, ["lo", "hi"], 1, "via", "anchor_indicator", "u")
    return top(chosen.drop("lo", "hi"), cfg.max_links, F.desc("score"), "u", "v")
