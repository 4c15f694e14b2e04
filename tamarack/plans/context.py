"""What detectors may see, and all of them applied to it."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack import schemas
from tamarack.functions.exprs import day_of
from tamarack.operators import alerts, beaconing, dnstunnel, egress, fanout, host, intel, tlsdga
from tamarack.operators.common import evenly_spaced, first_records, key_of, null_safe_semi, with_locators
from tamarack.plans.findings import artifacts, basis, entity, evidence, findings, severity
from tamarack.side import indicators as ioc
from tamarack.side import inventory as inv
from tamarack.runtime import materialize

DETECTORS = ("beaconing", "fanout", "egress", "dnstunnel", "alerts", "tlsdga", "host", "intel")


@dataclass(frozen=True)
class Configs:
    beaconing: beaconing.Config = field(default_factory=beaconing.Config)
    fanout: fanout.Config = field(default_factory=fanout.Config)
    egress: egress.Config = field(default_factory=egress.Config)
    dnstunnel: dnstunnel.Config = field(default_factory=dnstunnel.Config)
    alerts: alerts.Config = field(default_factory=alerts.Config)
    tlsdga: tlsdga.Config = field(default_factory=tlsdga.Config)
    host: host.Config = field(default_factory=host.Config)
    intel: intel.Config = field(default_factory=intel.Config)


@dataclass(frozen=True)
class Context:
    """Five telemetry frames, two side tables and the words that natural names are made of; frames may be empty."""

    connections: DataFrame
    dns: DataFrame
    ssl: DataFrame
    processes: DataFrame
    alerts: DataFrame
    indicators: DataFrame
    inventory: DataFrame
    words: DataFrame
    configs: Configs = field(default_factory=Configs)
    known_window: DataFrame | None = None

    @classmethod
    def of(cls, spark: SparkSession, **frames: DataFrame) -> Context:
        """A context of the frames given, conformed, and empty ones for the rest."""
        made = {n: schemas.conform(frames[n], s) if n in frames else schemas.empty(spark, s) for n, s in schemas.BY_NAME.items()}
        made["indicators"] = frames.get("indicators", spark.createDataFrame([], ioc.SCHEMA))
        made["inventory"] = frames.get("inventory", spark.createDataFrame([], inv.SCHEMA))
        made["words"] = frames.get("words", spark.createDataFrame([], "word string"))
        return cls(**made)

    def window(self) -> DataFrame:
        """One row: when the capture begins and ends."""
        if self.known_window is not None:
            return self.known_window
        return inv.capture_window(self.connections, self.dns, self.ssl, self.processes, self.alerts)

    def with_configs(self, **configs) -> Context:
        return replace(self, configs=replace(self.configs, **configs))


def _span() -> Column:
    return F.round(F.col("last_ts") - F.col("first_ts"), 1)


def _subject(ctx: Context, rows: DataFrame) -> DataFrame:
    return inv.with_actor(rows, ctx.inventory, ctx.window(), "src_ip")


def _actor() -> Column:
    return entity(F.col("actor_type"), F.col("actor_value"))


def _cited(rows: DataFrame, records: DataFrame, keys: list[str], k: int) -> DataFrame:
    """rows with __cited: artifacts of the first k records of their key, gathered for reported keys only."""
    chosen = null_safe_semi(with_locators(records), rows, keys).withColumn("__k", key_of(*keys))
    sampled = first_records(chosen, ["__k"], k)
    return rows.withColumn("__k", key_of(*keys)).join(sampled, "__k", "left").withColumn("__cited", artifacts(F.coalesce("artifacts", F.array().cast("array<struct<n:int,source:string,locator:string,observed_at:timestamp,excerpt:string>>")))).drop("__k", "artifacts")


def beacon_findings(ctx: Context) -> DataFrame:
    cfg = ctx.configs.beaconing
    rows = materialize(beaconing.detect(ctx.connections, cfg), "detected")
    records = null_safe_semi(ctx.connections.dropna(subset=["ts", "src_ip", "dst_ip"]), rows, beaconing.KEYS).withColumn("__p", key_of(*beaconing.KEYS))
    rows = _cited(_subject(ctx, rows), evenly_spaced(records, "__p", cfg.artifact_samples), beaconing.KEYS, cfg.artifact_samples)
    timing = evidence(
        "interval_regularity", F.concat(F.col("samples").cast("string"), F.lit(" contacts, one every "), F.format_number("period", 1), F.lit(" s")),
        {
            "period_seconds": F.round("period", 3), "interval_dispersion": F.round("interval_dispersion", 4), "floor_dispersion": F.round("floor_dispersion", 4), "autocorrelation": F.round("autocorrelation", 4),
            "coverage": F.round("coverage", 4), "sample_count": F.col("samples"), "span_seconds": F.round("span", 1), "contacting_hosts": F.col("contacting_hosts"), "raw_record_count": F.col("raw_records"), "burst_threshold_seconds": F.round("burst_threshold", 3),
        },
        F.col("__cited"),
    )
    size = evidence("payload_uniformity", F.concat(F.lit("median of "), F.format_number("median_bytes", 1), F.lit(" bytes a contact")), {"median_bytes": F.round("median_bytes", 1), "size_dispersion": F.round("size_dispersion", 4)}, F.col("__cited"))
    found = F.when(F.col("size_dispersion").isNotNull(), F.array(timing, size)).otherwise(F.array(timing))
    return findings(rows, predicate="beacons_to", subject=_actor(), object=entity(F.lit("ip"), F.col("dst_ip")), evidence=found, confidence=F.col("score"), severity=severity([(cfg.critical, "critical")], "high"), basis=basis(list(beaconing.WEIGHTS), F.concat(F.col("samples").cast("string"), F.lit(" samples"))), analyzer="beaconing")


def fanout_findings(ctx: Context) -> DataFrame:
    cfg = ctx.configs.fanout
    rows = _cited(_subject(ctx, materialize(fanout.detect(ctx.connections, cfg), "detected")), ctx.connections, ["src_ip", "dst_port"], cfg.artifact_samples)
    port = F.col("dst_port").cast("string")
    found = evidence(
        "destination_fanout", F.concat(F.col("destinations").cast("string"), F.lit(" destinations on port "), port),
        {"destinations": F.col("destinations"), "flows": F.col("flows"), "flows_per_destination": F.round(F.col("flows") / F.col("destinations"), 2), "port": F.col("dst_port"), "span_seconds": _span()}, F.col("__cited"),
    )
    return findings(rows, predicate="scans", subject=_actor(), object=entity(F.lit("port"), port), evidence=F.array(found), confidence=F.col("score"), severity=severity([(cfg.high, "high")], "medium"), basis=basis(list(fanout.WEIGHTS), F.concat(F.col("flows").cast("string"), F.lit(" flows"))), analyzer="fanout")


def egress_findings(ctx: Context) -> DataFrame:
    cfg = ctx.configs.egress
    rows = materialize(egress.detect(ctx.connections, cfg), "detected")
    measured = ctx.connections.where("orig_bytes is not null")
    largest = measured.join(rows.select("src_ip", "dst_ip"), ["src_ip", "dst_ip"], "left_semi")
    sampled = first_records(largest, ["src_ip", "dst_ip"], cfg.artifact_samples, order=[F.desc_nulls_last("orig_bytes"), "ts", "source_file", "source_line"])
    rows = _subject(ctx, rows).join(sampled, ["src_ip", "dst_ip"], "left").withColumn("__cited", artifacts(F.coalesce("artifacts", F.array().cast("array<struct<n:int,source:string,locator:string,observed_at:timestamp,excerpt:string>>"))))
    volume = evidence(
        "egress_volume", F.concat(F.col("bytes").cast("string"), F.lit(" bytes out in "), F.col("flows").cast("string"), F.lit(" flows")),
        {"orig_bytes": F.col("bytes"), "resp_bytes": F.col("paired_in"), "egress_ratio": F.round("ratio", 4), "egress_ratio_flow_coverage": F.round(F.col("paired") / F.col("flows"), 4), "flows": F.col("flows"), "span_seconds": _span()}, F.col("__cited"),
    )
    profile = evidence("destination_profile", F.concat(F.lit("destination of "), F.col("contacting_hosts").cast("string"), F.lit(" hosts")), {"contacting_hosts": F.col("contacting_hosts"), "novelty_fraction": F.round("novelty_fraction", 4), "baseline_destinations": F.col("base_n")}, F.col("__cited"))
    deviation = evidence("volume_deviation", F.concat(F.lit("modified z-score "), F.format_number("z", 3)), {"modified_z_score": F.round("z", 3), "baseline_median_bytes": F.col("base_med"), "baseline_destinations": F.col("base_n")}, F.col("__cited"))
    found = F.when(F.col("volume_deviation").isNotNull(), F.array(volume, profile, deviation)).otherwise(F.array(volume, profile))
    level = F.when(F.col("predicate") == "exfiltrates_to", severity([(cfg.critical, "critical")], "high")).when(F.col("predicate") == "transfers_anomalous_volume", "medium").otherwise("low")
    return findings(rows, predicate=F.col("predicate"), subject=_actor(), object=entity(F.lit("ip"), F.col("dst_ip")), evidence=found, confidence=F.col("score"), severity=level, basis=basis(list(egress.WEIGHTS), F.concat(F.col("flows").cast("string"), F.lit(" flows"))), analyzer="egress")


def tunnel_findings(ctx: Context) -> DataFrame:
    cfg = ctx.configs.dnstunnel
    rows = materialize(dnstunnel.detect(ctx.dns, cfg), "detected")
    records = ctx.dns.dropna(subset=["ts", "src_ip", "query"]).withColumn("zone", dnstunnel.registered_domain(F.col("query")))
    rows = _cited(_subject(ctx, rows), records, ["src_ip", "zone"], cfg.artifact_samples)
    found = evidence(
        "dns_label_encoding", F.concat(F.col("subdomains").cast("string"), F.lit(" names under "), F.col("zone")),
        {
            "zone": F.col("zone"), "queries": F.col("queries"), "distinct_subdomains": F.col("subdomains"), "mean_entropy_bits": F.round("mean_entropy", 3), "mean_subdomain_length": F.round("mean_length", 1),
            "high_capacity_qtype_fraction": F.round("high_fraction", 3), "span_seconds": _span(),
        },
        F.col("__cited"),
    )
    return findings(rows, predicate="tunnels_dns_over", subject=_actor(), object=entity(F.lit("domain"), F.col("zone")), evidence=F.array(found), confidence=F.col("score"), severity=severity([(cfg.critical, "critical")], "high"), basis=basis(list(dnstunnel.WEIGHTS), F.concat(F.col("queries").cast("string"), F.lit(" queries"))), analyzer="dnstunnel")


def alert_findings(ctx: Context) -> DataFrame:
    cfg = ctx.configs.alerts
    rows = _cited(_subject(ctx, materialize(alerts.detect(ctx.alerts, cfg), "detected")), ctx.alerts, ["src_ip", "signature"], cfg.artifact_samples)
    found = evidence(
        "signature_cluster", F.concat(F.col("alerts").cast("string"), F.lit(" alerts of "), F.col("signature")),
        {
            "signature": F.col("signature"), "signature_id": F.col("signature_id"), "category": F.col("category"), "stated_severity": F.col("severity"), "alerts": F.col("alerts"), "distinct_targets": F.col("targets"),
            "hosts_with_signature": F.col("hosts"), "span_seconds": _span(),
        },
        F.col("__cited"),
    )
    return findings(rows, predicate="triggered_signature", subject=_actor(), object=entity(F.lit("signature"), F.col("signature")), evidence=F.array(found), confidence=F.col("score"), severity=severity([(cfg.medium, "medium")], "low"), basis=basis(list(alerts.WEIGHTS), F.concat(F.col("alerts").cast("string"), F.lit(" alerts"))), analyzer="alerts")


def tlsdga_findings(ctx: Context) -> DataFrame:
    cfg = ctx.configs.tlsdga
    model = tlsdga.bigram_model(ctx.words)
    rows = materialize(tlsdga.dga_detect(ctx.dns, model, cfg), "detected")
    rows = _cited(_subject(ctx, rows), tlsdga.labelled(ctx.dns), ["src_ip", "suffix", "label"], cfg.artifact_samples)
    name = F.concat_ws(".", "label", "suffix")
    shape = evidence(
        "domain_name_structure", F.concat(name, F.lit(" is unlike natural names")),
        {"registered_domain": name, "label": F.col("label"), "label_length": F.length("label"), "bigram_improbability": F.round("bigram_improbability", 4), "longest_consonant_run": F.col("consonant_run"), "digit_ratio": F.round("digit_ratio", 4), "queries": F.col("queries")}, F.col("__cited"),
    )
    family = evidence(
        "resolution_family", F.concat(F.col("family_labels").cast("string"), F.lit(" names under "), F.col("suffix")),
        {
            "suffix": F.col("suffix"), "family_labels": F.col("family_labels"), "family_queries": F.col("family_queries"), "nxdomain_rate": F.round("nx_rate", 4), "rcode_coverage": F.round("rcode_coverage", 4), "resolved": F.col("resolved"), "span_seconds": _span(),
        },
        F.col("__cited"),
    )
    dga = findings(rows, predicate="resolves_algorithmic_domain", subject=_actor(), object=entity(F.lit("domain"), name), evidence=F.array(shape, family), confidence=F.col("score"), severity=severity([(cfg.dga_high, "high")], "medium"), basis=basis(list(tlsdga.DGA_WEIGHTS), F.concat(F.col("queries").cast("string"), F.lit(" queries"))), analyzer="tlsdga")
    tls = _cited(_subject(ctx, materialize(tlsdga.tls_detect(ctx.ssl, cfg), "detected")), ctx.ssl.where("ja3 is not null"), ["src_ip", "ja3"], cfg.artifact_samples)
    extra = ctx.ssl.join(tls.select("src_ip", "ja3"), ["src_ip", "ja3"], "left_semi").groupBy("src_ip", "ja3").agg(F.min("ja3s").alias("ja3s"), F.slice(F.array_sort(F.collect_set("server_name")), 1, 5).alias("server_names"))
    tls = tls.join(extra, ["src_ip", "ja3"], "left")
    client = evidence(
        "tls_client_fingerprint", F.concat(F.col("sessions").cast("string"), F.lit(" sessions with a fingerprint of "), F.col("presenting_hosts").cast("string"), F.lit(" hosts")),
        {"ja3": F.col("ja3"), "ja3s": F.col("ja3s"), "sessions": F.col("sessions"), "servers": F.col("servers"), "presenting_hosts": F.col("presenting_hosts"), "estate_hosts": F.col("estate_hosts"), "server_names": F.col("server_names"), "span_seconds": _span()}, F.col("__cited"),
    )
    rare = findings(tls, predicate="presents_rare_tls_fingerprint", subject=_actor(), object=entity(F.lit("tls_fingerprint"), F.col("ja3")), evidence=F.array(client), confidence=F.col("score"), severity=F.lit("medium"), basis=basis(list(tlsdga.TLS_WEIGHTS), F.concat(F.col("sessions").cast("string"), F.lit(" sessions"))), analyzer="tlsdga")
    return dga.unionByName(rare)


def host_findings(ctx: Context) -> DataFrame:
    cfg = ctx.configs.host
    rare, lineage = [materialize(x, "detected") for x in host.detect(ctx.processes, cfg)]
    records = host.named(ctx.processes)
    detail = lambda rows, keys: null_safe_semi(records, rows, keys).groupBy(*keys).agg(
        F.slice(F.array_sort(F.collect_set("command_line")), 1, 3).alias("command_lines"), F.min("sha256").alias("sha256"), F.min("user").alias("user"), F.min("integrity_level").alias("integrity_level"),
        F.min("parent_command_line").alias("parent_command_line"), F.min("parent_image").alias("parent_image"), F.min_by("process_guid", F.struct("ts", "source_file", "source_line")).alias("process_guid"),
    )
    keys = ["host", "image_name"]
    rows = _cited(rare, records, keys, cfg.artifact_samples).join(detail(rare, keys), keys, "left")
    parts = lambda names: F.struct(*[F.round(n, 4).alias(n) for n in sorted(names)])
    found = evidence(
        "image_prevalence", F.concat(F.col("image_name"), F.lit(" on "), F.col("image_hosts").cast("string"), F.lit(" hosts")),
        {
            "image": F.col("image"), "image_name": F.col("image_name"), "hosts_running": F.col("image_hosts"), "estate_hosts": F.col("estate_hosts"), "estate_executions": F.col("image_executions"), "executions_here": F.col("observed"),
            "components": parts(host.PROCESS_WEIGHTS), "command_lines": F.col("command_lines"), "sha256": F.col("sha256"), "user": F.col("user"), "integrity_level": F.col("integrity_level"),
        },
        F.col("__cited"),
    )
    subject, target = entity(F.lit("host"), F.col("host")), entity(F.lit("process"), F.col("image_name"))
    first = findings(rows, predicate="executes_rare_process", subject=subject, object=target, evidence=F.array(found), confidence=F.col("score"), severity=F.lit("medium"), basis=basis(list(host.PROCESS_WEIGHTS), F.concat(F.col("observed").cast("string"), F.lit(" executions"))), analyzer="host")
    keys = ["host", "parent_name", "image_name"]
    rows = _cited(lineage, records, keys, cfg.artifact_samples).join(detail(lineage, keys), keys, "left")
    rows = materialize(rows, "lineage")
    walked = host.ancestry(ctx.processes, rows.select("process_guid").where("process_guid is not null"), cfg.max_depth)
    rows = rows.join(walked, "process_guid", "left")
    edge = evidence(
        "process_lineage", F.concat(F.col("parent_name"), F.lit(" started "), F.col("image_name")),
        {
            "parent_image": F.col("parent_image"), "child_image": F.col("image_name"), "child_path": F.col("image"), "chain": F.coalesce("chain", F.array("parent_name")), "chain_truncated": F.coalesce("truncated", F.lit(True)),
            "pair_hosts": F.col("pair_hosts"), "parent_hosts": F.col("parent_hosts"), "child_hosts": F.col("child_hosts"), "estate_hosts": F.col("estate_hosts"), "pair_executions": F.col("pair_executions"), "executions_here": F.col("n"),
            "p_child_given_parent": F.round("child_given_parent", 5), "components": parts(host.LINEAGE_WEIGHTS), "command_lines": F.col("command_lines"), "parent_command_line": F.col("parent_command_line"), "sha256": F.col("sha256"), "user": F.col("user"),
        },
        F.col("__cited"),
    )
    second = findings(rows, predicate="exhibits_anomalous_lineage", subject=subject, object=target, evidence=F.array(edge), confidence=F.col("score"), severity=F.lit("high"), basis=basis(list(host.LINEAGE_WEIGHTS), F.concat(F.col("n").cast("string"), F.lit(" executions"))), analyzer="host")
    return first.unionByName(second)


def intel_findings(ctx: Context) -> DataFrame:
    cfg = ctx.configs.intel
    observed = materialize(intel.observations(ctx.connections, ctx.alerts, ctx.dns), "observed")
    rows = materialize(intel.detect(observed, ctx.indicators, cfg), "detected")
    known = ioc.best_of(ctx.indicators).select(F.col("value").alias("indicator"), "feed", "added", "confidence", "note", "source_file", "source_line", F.col("kind").alias("k"))
    rows = rows.join(ioc.small(known), (rows["indicator"] == known["indicator"]) & (rows["kind"] == known["k"])).drop(known["indicator"], "k")
    declared = F.coalesce("confidence", "feed.declared_confidence")
    day = day_of(F.col("first_ts"))
    age = F.when(F.col("added").isNotNull(), F.greatest(F.lit(0), F.datediff(day, F.col("added"))))
    listed = F.struct(F.lit(1).alias("n"), F.col("source_file").alias("source"), F.concat(F.lit("line:"), F.col("source_line").cast("string")).alias("locator"), F.lit(None).cast("timestamp").alias("observed_at"), F.col("indicator").alias("excerpt"))
    rows = rows.withColumn("__cited", artifacts(F.array(listed)))
    found = evidence(
        "intel_match", F.concat(F.col("value"), F.lit(" is in "), F.col("feed.name")),
        {
            "indicator": F.col("indicator"), "indicator_kind": F.col("kind"), "match": F.col("match"), "feed": F.col("feed.name"), "feed_path": F.col("feed.path"), "feed_reference": F.col("feed.reference"), "feed_tlp": F.col("feed.tlp"),
            "declared_confidence": declared, "provenanced": declared.isNotNull(), "indicator_added": F.col("added").cast("string"), "age_days": age, "age_decay": F.round(F.when(age.isNotNull(), F.pow(F.lit(0.5), age / cfg.half_life_days)), 4), "note": F.col("note"),
            "observed_values": F.col("values"), "observed_value_count": F.col("value_count"), "records": F.col("events"), "distinct_peers": F.col("peers"), "span_seconds": _span(), "indicator_source": F.concat_ws(":", "source_file", F.col("source_line").cast("string")),
        },
        F.col("__cited"),
    )
    kind = F.when(F.col("kind") == "domain", "domain").otherwise("ip")
    first = findings(rows, predicate="matches_threat_intel", subject=entity(kind, F.col("value")), object=None, evidence=F.array(found), confidence=F.col("score"), severity=severity([(cfg.medium, "medium")], "low"), basis=F.concat(F.lit("declared confidence halved every "), F.lit(f"{cfg.half_life_days:.0f} days")), analyzer="intel")
    scored = materialize(intel.score(observed, ctx.indicators, cfg), "matches")
    edges = intel.links(ctx.dns, scored, cfg).withColumn("first_ts", F.lit(None).cast("double")).withColumn("last_ts", F.lit(None).cast("double"))
    edges = edges.withColumn("__cited", artifacts(F.array().cast("array<struct<n:int,source:string,locator:string,observed_at:timestamp,excerpt:string>>")))
    shared = evidence("shared_infrastructure", F.concat(F.col("u"), F.lit(" and "), F.col("v"), F.lit(" share "), F.col("via")), {"link": F.col("link"), "via": F.col("via"), "anchor_indicator": F.col("anchor_indicator"), "anchor_confidence": F.round("score", 4)}, F.col("__cited"))
    side = lambda c: entity(F.when(ioc.ipv4_number(F.col(c)).isNotNull(), "ip").otherwise("domain"), F.col(c))
    second = findings(edges, predicate="shares_infrastructure_with", subject=side("u"), object=side("v"), evidence=F.array(shared), confidence=F.col("score"), severity=F.lit("info"), basis=F.col("link"), analyzer="intel")
    return first.unionByName(second)


RUNNERS = {
    "beaconing": beacon_findings,
    "fanout": fanout_findings,
    "egress": egress_findings,
    "dnstunnel": tunnel_findings,
    "alerts": alert_findings,
    "tlsdga": tlsdga_findings,
    "host": host_findings,
    "intel": intel_findings,
}


def all_findings(ctx: Context, detectors: tuple[str, ...] = DETECTORS) -> DataFrame:
    """The findings of all detectors, each run on its own and its few findings written, so that plans stay small."""
    ctx = replace(ctx, known_window=materialize(ctx.window(), "window"))
    return reduce(DataFrame.unionByName, [materialize(RUNNERS[name](ctx), f"findings-{name}") for name in detectors])
