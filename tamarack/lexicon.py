"""The grammar of claims: entity types, severities, predicates and what each may join."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENTITY_TYPES = ("host", "ip", "domain", "port", "user", "process", "file_hash", "url", "signature", "tls_fingerprint")
SEVERITIES = ("info", "low", "medium", "high", "critical")


class Rule(NamedTuple):
    predicate: str
    subjects: tuple[str, ...]
    objects: tuple[str, ...] | None  # None: unary
    severity: str
    techniques: tuple[str, ...]


_ENDPOINT = ("host", "ip")
# The vocabulary.
GRAMMAR = (
    Rule("beacons_to", _ENDPOINT, ("ip", "domain"), "high", ("T1071", "T1573", "T1008")),
    Rule("tunnels_dns_over", _ENDPOINT, ("domain",), "high", ("T1071.004", "T1048.003")),
    Rule("exfiltrates_to", _ENDPOINT, ("ip", "domain"), "critical", ("T1041", "T1030")),
    Rule("scans", _ENDPOINT, ("host", "ip", "port"), "medium", ("T1046", "T1595")),
    Rule("contacts_rare_destination", _ENDPOINT, ("ip", "domain"), "low", ("T1071",)),
    Rule("transfers_anomalous_volume", _ENDPOINT, ("ip", "domain"), "medium", ("T1030",)),
    Rule("presents_rare_tls_fingerprint", _ENDPOINT, ("tls_fingerprint",), "medium", ("T1071.001",)),
    Rule("resolves_algorithmic_domain", _ENDPOINT, ("domain",), "medium", ("T1568.002",)),
    Rule("attacks_web_endpoint", ("ip",), ("url",), "high", ("T1190", "T1059")),
    Rule("enumerates_web_paths", ("ip",), ("host", "url"), "low", ("T1595.003",)),
    Rule("executes_rare_process", ("host",), ("process",), "medium", ("T1059",)),
    Rule("exhibits_anomalous_lineage", ("host",), ("process",), "high", ("T1059", "T1055")),
    Rule("authentication_anomaly", ("user",), ("host",), "medium", ("T1078", "T1110")),
    Rule("establishes_persistence", ("host",), ("process", "file_hash"), "high", ("T1547", "T1053")),
    Rule("triggered_signature", _ENDPOINT, ("signature",), "info", ()),
    Rule("matches_threat_intel", ("ip", "domain", "file_hash", "url"), None, "medium", ()),
    Rule("shares_infrastructure_with", ("ip", "domain"), ("ip", "domain"), "info", ()),
    Rule("precedes", ENTITY_TYPES, ENTITY_TYPES, "info", ()),
)
BY_PREDICATE = {r.predicate: r for r in GRAMMAR}
UNARY = tuple(r.predicate for r in GRAMMAR if r.objects is None)


def grammar_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(r.predicate, list(r.subjects), None if r.objects is None else list(r.objects), r.severity, list(r.techniques)) for r in GRAMMAR], "predicate string, subjects array<string>, objects array<string>, severity string, techniques array<string>")


def violations(findings: DataFrame) -> DataFrame:
    """Findings that the grammar has no way to say, with the reason; the table of 18 rules is broadcast."""
    rules = grammar_table(findings.sparkSession).select(F.col("predicate").alias("__p"), "subjects", "objects")
    rows = findings.join(F.broadcast(rules), F.col("predicate") == F.col("__p"), "left")
    reason = (
        F.when(F.col("__p").isNull(), "unknown predicate")
        .when(~F.array_contains("subjects", F.col("subject.type")), "wrong subject")
        .when(F.col("objects").isNull() & F.col("object").isNotNull(), "unary predicate with an object")
        .when(F.col("objects").isNotNull() & F.col("object").isNull(), "object missing")
        .when(F.col("objects").isNotNull() & ~F.array_contains("objects", F.col("object.type")), "wrong object")
        .when(F.size("evidence") < 1, "no evidence")
        .when(~F.col("confidence").between(0, 1), "confidence out of range")
    )
    return rows.withColumn("violation", reason).where("violation is not null").drop("__p", "subjects", "objects")
