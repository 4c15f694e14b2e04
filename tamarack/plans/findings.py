"""Findings: scored rows as typed, content-addressed claims with evidence that points to records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarack.functions.exprs import content_id, entity_id
from tamarack.lexicon import BY_PREDICATE

VERSION = "0.1.0"
ARTIFACTS = "array<struct<id:string,source:string,locator:string,observed_at:timestamp,excerpt:string>>"


def entity(kind: Column, value: Column) -> Column:
    return F.struct(entity_id(kind, value).alias("id"), kind.alias("type"), value.alias("value"))


def artifacts(sampled: Column) -> Column:
    """Sampled records as artifacts with ids; an aggregate without records is cited as one."""
    made = F.transform(
        sampled,
        lambda a: F.struct(
            content_id("art", {"source": a["source"], "locator": a["locator"]}).alias("id"), a["source"].alias("source"), a["locator"].alias("locator"), a["observed_at"].alias("observed_at"), a["excerpt"].alias("excerpt")
        ),
    )
    whole = F.struct(
        content_id("art", {"source": F.lit("<aggregate>"), "locator": F.lit("-")}).alias("id"), F.lit("<aggregate>").alias("source"), F.lit("-").alias("locator"), F.lit(None).cast("timestamp").alias("observed_at"), F.lit("").alias("excerpt")
    )
    return F.when(F.size(sampled) > 0, made.cast(ARTIFACTS)).otherwise(F.array(whole).cast(ARTIFACTS))


def evidence(kind: str, summary: Column, payload: dict[str, Column], cited: Column) -> Column:
    """One piece of evidence; the payload is canonical JSON with explicit nulls."""
    text = F.to_json(F.struct(*[payload[k].alias(k) for k in sorted(payload)]), {"ignoreNullFields": "false"})
    ids = F.array_join(F.array_sort(F.transform(cited, lambda a: a["id"])), ",")
    return F.struct(
        content_id("ev", {"kind": F.lit(kind), "payload": text, "artifacts": ids}).alias("id"), F.lit(kind).alias("kind"), summary.alias("summary"), text.alias("payload"), cited.alias("artifacts")
    )


def basis(components: list[str], tail: Column) -> Column:
    """How a score came about: the components that were measured, by name, then the rest."""
    parts = F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}="), F.format_number(F.col(c), 2))) for c in sorted(components)]))
    return F.concat(F.lit("weighted geometric mean of ["), F.array_join(parts, ", "), F.lit("]; "), tail)


def findings(rows: DataFrame, *, predicate: str | Column, subject: Column, object: Column | None, evidence: Column, confidence: Column, severity: Column, basis: Column, analyzer: str) -> DataFrame:
    """The finding of each row, with first_ts and last_ts as its times."""
    verb = F.lit(predicate) if isinstance(predicate, str) else predicate
    techniques = F.coalesce(*[F.when(verb == p, F.array(*[F.lit(t) for t in r.techniques])) for p, r in BY_PREDICATE.items() if r.techniques], F.array().cast("array<string>"))
    kind = "struct<id:string,type:string,value:string>"
    shaped = rows.select(
        verb.alias("predicate"), subject.cast(kind).alias("subject"), (F.lit(None) if object is None else object).cast(kind).alias("object"), evidence.alias("evidence"), F.round(confidence, 4).alias("confidence"),
        basis.alias("basis"), severity.alias("severity"), F.lit(f"{analyzer}@{VERSION}").alias("analyzer"),
        F.timestamp_micros((F.col("first_ts") * 1e6).cast("long")).alias("first_seen"), F.timestamp_micros((F.col("last_ts") * 1e6).cast("long")).alias("last_seen"), techniques.alias("attack_techniques"),
    )
    shaped = shaped.withColumn("__ev", F.array_join(F.array_sort(F.transform("evidence", lambda e: e["id"])), ","))
    ident = content_id("fnd", {"predicate": F.col("predicate"), "subject": F.col("subject.id"), "object": F.col("object.id"), "evidence": F.col("__ev")})
    return shaped.withColumn("id", ident).select("id", "predicate", "subject", "object", "evidence", "confidence", "basis", "severity", "analyzer", "first_seen", "last_seen", "attack_techniques")


def severity(levels: list[tuple[float, str]], otherwise: str) -> Column:
    """The first level whose floor the score reaches."""
    out = None
    for floor, name in levels:
        out = F.when(F.col("score") >= floor, name) if out is None else out.when(F.col("score") >= floor, name)
    return out.otherwise(otherwise) if out is not None else F.lit(otherwise)
