"""Incidents: findings by subject, joined by shared indicators, put in order and ranked."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamarack.functions.exprs import content_id
from tamarack.lexicon import SEVERITIES, UNARY
from tamarack.operators.common import numbered
from tamarack.plans.findings import evidence, findings
from tamarack.runtime import materialize


@dataclass(frozen=True)
class Config:
    """Three rungs: corroborating claims multiply, supporting ones only add to the noisy-OR, derived ones count for nothing."""

    bonus: float = 0.5
    max_multiplier: float = 2.5
    non_corroborating: tuple[str, ...] = ("shares_infrastructure_with", "precedes", "contacts_rare_destination", "transfers_anomalous_volume", "presents_rare_tls_fingerprint", "matches_threat_intel")
    non_evidential: tuple[str, ...] = ("precedes",)
    attach_unary: bool = True
    order_behaviours: bool = True
    same_clock_seconds: float = 1.0
    cross_clock_seconds: float = 300.0

    def __post_init__(self) -> None:
        stray = set(self.non_evidential) - set(self.non_corroborating)
        if stray:
            raise ValueError(f"{sorted(stray)} would multiply a priority without adding to its confidence")


def severity_rank(severity: Column) -> Column:
    return F.coalesce(*[F.when(severity == s, F.lit(i)) for i, s in enumerate(SEVERITIES)], F.lit(0))


def noisy_or(confidences: Column) -> Column:
    """1 - product of (1 - c): an aggregate."""
    return 1 - F.product(1 - F.least(F.lit(1.0), F.greatest(F.lit(0.0), confidences)))


def _parts(found: DataFrame, cfg: Config) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Findings in their own groups; unary ones; links (named, group, owner) from the latter's subjects to the groups that they join.

    The unary findings of a subject all join the same groups, so measures of them can be worked out before the join.
    """
    own = found.withColumn("group", F.col("subject.id")).withColumn("owner", F.col("subject"))
    unary = own.where(F.col("predicate").isin(*UNARY) if cfg.attach_unary else F.lit(False))
    named = own.where("object is not null").select(F.col("object.id").alias("named"), "group", "owner").distinct()
    named = named.join(unary.select(F.col("group").alias("named")).distinct(), "named", "left_semi").where(F.col("group") != F.col("named"))
    moved = named.select(F.col("named").alias("group"), F.lit(True).alias("moved")).distinct()
    anchored = own.join(moved, "group", "left").where(F.col("moved").isNull() | ~F.col("predicate").isin(*UNARY)).select("group").distinct()
    kept = own.join(anchored, "group", "left_semi").select(*found.columns, "group", "owner")
    return kept, unary, named.join(anchored, "group", "left_semi").select("named", "group", "owner")


def grouped(found: DataFrame, cfg: Config = Config()) -> DataFrame:
    """found with group (the subject's id) and owner (its subject): unary findings also join every group that names their subject as an object.

    A group whose findings all joined others is gone; one that keeps a finding of its own keeps its unary ones too.
    """
    kept, unary, links = _parts(found, cfg)
    return kept.unionByName(_joined(unary, links))


def _joined(rows: DataFrame, links: DataFrame) -> DataFrame:
    """rows of subjects (as group) as rows of the groups that they join."""
    columns = [c for c in rows.columns if c not in ("group", "owner")]
    return rows.select(*columns, F.col("group").alias("named")).join(links, "named").select(*columns, "group", "owner")


def _earliest(rows: DataFrame, cfg: Config) -> DataFrame:
    """Each behaviour of a group by its earliest finding."""
    rows = rows.where(F.col("first_seen").isNotNull() & ~F.col("predicate").isin(*cfg.non_evidential))
    by = Window.partitionBy("group", "predicate").orderBy("first_seen", F.desc("confidence"), "id")
    return rows.withColumn("__n", F.row_number().over(by)).where("__n = 1").drop("__n")


def earliest(found: DataFrame, cfg: Config = Config()) -> DataFrame:
    """The rows of grouped() that ordered_edges() may choose, without the others."""
    kept, unary, links = _parts(found, cfg)
    return _earliest(kept, cfg).unionByName(_joined(_earliest(unary, cfg), links))


def ordered_edges(members: DataFrame, cfg: Config = Config()) -> DataFrame:
    """precedes-findings between adjacent behaviours of a group, each behaviour standing for its earliest finding."""
    first = _earliest(members, cfg)
    sources = F.array_distinct(F.flatten(F.transform("evidence", lambda e: F.transform(e["artifacts"], lambda a: a["source"]))))
    first = first.select("group", "owner", "id", "predicate", "confidence", "first_seen", F.coalesce("object", "subject").alias("pivot"), sources.alias("sources"), F.col("evidence")[0]["artifacts"][0].alias("artifact"))
    nxt = F.lead(F.struct("id", "predicate", "confidence", "first_seen", "pivot", "sources", "artifact")).over(Window.partitionBy("group").orderBy("first_seen", "predicate"))
    pairs = first.withColumn("later", nxt).where("later is not null and pivot.id <> later.pivot.id")
    together = F.array_sort(F.array_union("sources", "later.sources"))
    gap = (F.unix_micros("later.first_seen") - F.unix_micros("first_seen")) / 1e6
    pairs = pairs.withColumn("together", together).withColumn("separation", gap).withColumn("shared_clock", F.size("together") == 1)
    pairs = pairs.withColumn("floor", F.when(F.col("shared_clock"), cfg.same_clock_seconds).otherwise(cfg.cross_clock_seconds)).where("separation >= floor")
    pairs = pairs.withColumn("first_ts", F.unix_micros("first_seen") / 1e6).withColumn("last_ts", F.unix_micros("later.first_seen") / 1e6)
    cited = F.when(F.col("artifact.id") == F.col("later.artifact.id"), F.array("artifact")).otherwise(F.array(F.col("artifact"), F.col("later.artifact")))
    proof = evidence(
        "temporal_order", F.concat(F.col("predicate"), F.lit(" first observed "), F.format_number("separation", 1), F.lit(" s before "), F.col("later.predicate")),
        {
            "earlier_finding": F.col("id"), "earlier_predicate": F.col("predicate"), "earlier_first_seen": F.col("first_seen").cast("string"), "later_finding": F.col("later.id"), "later_predicate": F.col("later.predicate"),
            "later_first_seen": F.col("later.first_seen").cast("string"), "separation_seconds": F.round("separation", 1), "min_separation_seconds": F.col("floor"), "shared_clock": F.col("shared_clock"), "sources": F.col("together"),
        },
        cited,
    )
    confidence = F.least("confidence", "later.confidence")
    out = findings(pairs, predicate="precedes", subject=F.col("pivot"), object=F.col("later.pivot"), evidence=F.array(proof), confidence=confidence, severity=F.lit("info"), basis=F.concat(F.lit("bounded by the weaker of the two; separation "), F.format_number("separation", 1), F.lit(" s")), analyzer="correlate")
    named = lambda side: F.get_json_object(F.col("evidence")[0]["payload"], f"$.{side}_finding")
    keys = pairs.select(F.col("id").alias("__earlier"), F.col("later.id").alias("__later"), "group", "owner")
    return out.dropDuplicates(["id"]).withColumn("__earlier", named("earlier")).withColumn("__later", named("later")).join(keys, ["__earlier", "__later"]).drop("__earlier", "__later")


def _measured(rows: DataFrame) -> DataFrame:
    """What incidents need of the findings of each group and predicate."""
    rank = severity_rank(F.col("severity"))
    return rows.groupBy("group", "predicate").agg(
        F.min("owner").alias("owner"), F.max("confidence").alias("c"), F.count("*").alias("n"), F.max(rank).alias("rank"), F.max(F.struct(rank.alias("r"), F.col("confidence").alias("c"), F.col("id").alias("i"))).alias("lead")
    )


def _listed(rows: DataFrame) -> DataFrame:
    """The ids of each group's findings, dealt by their first characters."""
    return rows.groupBy("group", F.substring("id", 1, 6).alias("head")).agg(F.min("owner").alias("owner"), F.collect_list("id").alias("ids"))


def incidents(found: DataFrame, cfg: Config = Config(), nested: bool = True) -> DataFrame:
    """One row a group with its priority and its findings in order; only their number where nested is false.

    A finding joins any number of groups.  Scores and ids come from sums made before that, so only nested lists hold a
    finding once for each of its groups.
    """
    found = materialize(found, "found")
    kept, unary, links = _parts(found, cfg)
    links = materialize(links, "links")
    measures, ids = [_measured(kept), _joined(_measured(unary), links)], [_listed(kept), _joined(_listed(unary), links)]
    if cfg.order_behaviours:
        edges = materialize(ordered_edges(earliest(found, cfg), cfg), "edges")
        measures, ids = [*measures, _measured(edges)], [*ids, _listed(edges)]
    derived = F.col("predicate").isin(*cfg.non_evidential)
    strongest = reduce(DataFrame.unionByName, measures).groupBy("group", "predicate").agg(F.min("owner").alias("owner"), F.max("c").alias("c"), F.sum("n").alias("n"), F.max("rank").alias("rank"), F.max("lead").alias("lead"))
    strongest = materialize(strongest, "measures")
    totals = strongest.groupBy("group").agg(
        F.min("owner").alias("subject"), F.sum("n").alias("n_findings"), F.max("rank").alias("severity_rank"), F.max_by("predicate", F.when(~derived, F.col("lead"))).alias("top")
    )
    parts = reduce(DataFrame.unionByName, ids).groupBy("group", "head").agg(F.array_join(F.array_sort(F.flatten(F.collect_list("ids"))), ",").alias("text"))
    texts = parts.groupBy("group").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("head", "text"))), lambda x: x["text"]), ",").alias("__ids"))
    strongest = strongest.where(~derived)
    counted = F.when(~F.col("predicate").isin(*cfg.non_corroborating), F.col("predicate"))
    scores = strongest.groupBy("group").agg(
        noisy_or(F.col("c")).alias("combined_confidence"), F.array_sort(F.collect_set(counted)).alias("corroborating_predicates"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("predicate", "c"))), lambda x: F.concat(x["predicate"], F.lit("="), F.format_number(x["c"], 2))), ", ").alias("__parts"),
    )
    k = F.size("corroborating_predicates")
    multiplier = F.least(1 + cfg.bonus * F.greatest(k - 1, F.lit(0)), F.lit(cfg.max_multiplier))
    scores = scores.withColumn("priority", F.col("combined_confidence") * multiplier)
    tail = F.when(k > 1, F.concat(F.lit("; "), k.cast("string"), F.lit(" independent behaviours corroborate (x"), F.format_number(multiplier, 1), F.lit(")"))).otherwise(F.lit("; single behaviour, no corroboration"))
    scores = scores.withColumn("rationale", F.concat(F.lit("noisy-OR of ["), F.col("__parts"), F.lit("] = "), F.format_number("combined_confidence", 3), tail)).drop("__parts")
    title = F.concat(F.initcap(F.replace("top", F.lit("_"), F.lit(" "))), F.lit(" — "), F.col("subject.value"))
    out = totals.join(scores, "group").join(texts, "group").withColumn("title", title).withColumn("id", content_id("inc", {"findings": F.col("__ids")}))
    if nested:
        members = grouped(found, cfg)
        members = members.unionByName(edges) if cfg.order_behaviours else members
        when = F.when(derived, F.unix_micros("first_seen")).otherwise(F.lit(0))
        held = F.struct(derived.alias("d"), when.alias("t"), (-F.col("confidence")).alias("c"), F.col("id").alias("i"), F.struct(*found.columns).alias("f"))
        gathered = members.groupBy("group").agg(F.transform(F.array_sort(F.collect_list(held)), lambda h: h["f"]).alias("findings"))
        out = out.join(gathered, "group")
    level = F.element_at(F.array(*[F.lit(s) for s in SEVERITIES]), F.col("severity_rank") + 1)
    return out.select("id", "title", "subject", *["findings"] * nested, "n_findings", level.alias("severity"), "severity_rank", F.round("priority", 4).alias("score"), "priority", "combined_confidence", "corroborating_predicates", "rationale")


def queue(found: DataFrame, cfg: Config = Config(), nested: bool = True) -> DataFrame:
    """Incidents with their place in the queue: by priority, severity, id."""
    placed = numbered(incidents(found, cfg, nested), "place", F.desc("priority"), F.desc("severity_rank"), F.col("id"))
    return placed.withColumn("place", F.col("place").cast("int"))


def severity_counts(ranked: DataFrame) -> DataFrame:
    return ranked.groupBy("severity").agg(F.count("*").alias("incidents"))


def corroborated(ranked: DataFrame) -> DataFrame:
    return ranked.where(F.size("corroborating_predicates") > 1)
