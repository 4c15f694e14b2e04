"""Generated domain names, and TLS clients that few hosts present."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tamarack.functions.exprs import clip01, consonant_run, count_values, digit_ratio, label_and_suffix, rarity, registered_domain, saturating, weighted_mean
from tamarack.operators.common import top, top_per
from tamarack.runtime import materialize

DGA_WEIGHTS = {"bigram_improbability": 0.56, "nxdomain_rate": 0.34, "structure": 0.10}
TLS_WEIGHTS = {"fingerprint_rarity": 0.65, "estate_support": 0.35}
#: Letters, digits and hyphen; pairs of others aren't counted.
ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789-"


@dataclass(frozen=True)
class Config:
    min_family_labels: int = 12
    min_family_queries: int = 30
    min_label_length: int = 6
    min_rcode_coverage: float = 0.5
    nx_floor: float = 0.10
    nx_ceiling: float = 0.70
    run_floor: int = 4
    run_ceiling: int = 9
    digit_floor: float = 0.15
    digit_ceiling: float = 0.50
    dga_threshold: float = 0.65
    dga_high: float = 0.85
    max_per_family: int = 3
    max_dga: int = 100
    min_estate_hosts: int = 10
    strong_estate: float = 50.0
    min_sessions: int = 3
    max_presenting: int = 2
    tls_threshold: float = 0.70
    max_tls: int = 20
    artifact_samples: int = 5


def _pairs(df: DataFrame, text: str) -> DataFrame:
    """df with one row for each two neighbouring characters of the text."""
    n = F.length(text)
    places = F.when(n >= 2, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>"))
    return df.withColumn("bigram", F.explode(F.transform(places, lambda i: F.substring(F.col(text), i, F.lit(2)))))


def bigram_model(words: DataFrame, word: str = "word") -> DataFrame:
    """(bigram, surprise, usual, improbable): add-half smoothed surprise in bits of all pairs of the alphabet.

    usual is the expected surprise of the words' own pairs, improbable that of a pair never seen.
    """
    spark = words.sparkSession
    counts = _pairs(words.where(F.col(word).rlike(f"^[{ALPHABET}]+$")).select(word), word).groupBy("bigram").agg(F.count("*").alias("c"))
    every = spark.createDataFrame([(a + b,) for a in ALPHABET for b in ALPHABET], "bigram string")
    whole = Window.partitionBy(F.lit(1))
    size = len(ALPHABET) ** 2
    rows = every.join(counts, "bigram", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    total = F.sum("c").over(whole) + 0.5 * size
    rows = rows.withColumn("p", (F.col("c") + 0.5) / total).withColumn("surprise", -F.log2("p")).withColumn("improbable", -F.log2(F.lit(0.5) / total))
    seen = F.sum("c").over(whole)
    usual = F.sum(F.col("c") * F.col("surprise")).over(whole) / seen
    return rows.select("bigram", "surprise", F.when(seen > 0, usual).alias("usual"), "improbable")


def improbability(labels: DataFrame, model: DataFrame, label: str = "label") -> DataFrame:
    """(label, mean_surprise, improbability) of distinct labels; labels of under two characters have no row.

    The model has 1,369 rows, a size fixed by the alphabet, so it is broadcast.
    """
    pairs = _pairs(labels.select(label).distinct(), label)
    found = pairs.join(F.broadcast(model), "bigram", "left")
    edge = F.coalesce("surprise", F.lit(None))
    rows = found.groupBy(label).agg(F.avg(edge).alias("mean_surprise"), F.max("usual").alias("usual"), F.max("improbable").alias("improbable"))
    return rows.where("mean_surprise is not null").select(label, "mean_surprise", clip01((F.col("mean_surprise") - F.col("usual")) / (F.col("improbable") - F.col("usual"))).alias("improbability"))


def labelled(dns: DataFrame) -> DataFrame:
    """DNS rows with the label and suffix of their registered domain."""
    label, suffix = label_and_suffix(F.col("registered"))
    rows = dns.dropna(subset=["ts", "src_ip", "query"]).withColumn("registered", registered_domain(F.col("query")))
    if "rcode" not in rows.columns:
        rows = rows.withColumn("rcode", F.lit(None).cast("string"))
    return rows.withColumn("label", label).withColumn("suffix", suffix).where("label is not null")


def label_counts(rows: DataFrame) -> DataFrame:
    """Queries and response codes by (source, suffix, label)."""
    nx = F.upper("rcode").isin("NXDOMAIN", "3")
    return rows.groupBy("src_ip", "suffix", "label").agg(
        F.count("*").alias("queries"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.coalesce(F.bool_or(~nx), F.lit(False)).alias("answered"), F.count("rcode").alias("coded"), F.count(F.when(nx, 1)).alias("nx"),
    )


def families(counts: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Queries, labels and response codes by (source, suffix), for those large enough; from label_counts(), so distinct labels are plain rows."""
    out = counts.groupBy("src_ip", "suffix").agg(F.sum("queries").alias("family_queries"), F.count("*").alias("family_labels"), F.sum("coded").alias("known"), F.sum("nx").alias("nx"))
    out = out.where((F.col("family_labels") >= cfg.min_family_labels) & (F.col("family_queries") >= cfg.min_family_queries))
    coverage = F.col("known") / F.col("family_queries")
    return out.withColumn("rcode_coverage", coverage).withColumn("nx_rate", F.when((F.col("known") > 0) & (coverage >= cfg.min_rcode_coverage), F.col("nx") / F.col("known")))


def dga_score(dns: DataFrame, model: DataFrame, cfg: Config = Config()) -> DataFrame:
    counts = materialize(label_counts(labelled(dns)), "dga-labels")
    family = families(counts, cfg)
    labels = counts.where(F.length("label") >= cfg.min_label_length).drop("nx")
    labels = materialize(labels.join(family.select("src_ip", "suffix"), ["src_ip", "suffix"], "left_semi"), "dga-members")
    scored = labels.join(improbability(labels, model), "label").join(family, ["src_ip", "suffix"])
    run = clip01((consonant_run(F.col("label")) - cfg.run_floor) / float(cfg.run_ceiling - cfg.run_floor))
    digits = clip01((digit_ratio(F.col("label")) - cfg.digit_floor) / (cfg.digit_ceiling - cfg.digit_floor))
    scored = scored.withColumns(
        {
            "bigram_improbability": F.col("improbability"),
            "nxdomain_rate": F.when(F.col("nx_rate").isNotNull(), clip01((F.col("nx_rate") - cfg.nx_floor) / (cfg.nx_ceiling - cfg.nx_floor))),
            "structure": 1 - (1 - run) * (1 - digits),
            "resolved": F.when(F.col("coded") > 0, F.col("answered")),
            "consonant_run": consonant_run(F.col("label")),
            "digit_ratio": digit_ratio(F.col("label")),
        }
    )
    return scored.withColumn("score", weighted_mean({k: (F.col(k), w) for k, w in DGA_WEIGHTS.items()}))


def dga_detect(dns: DataFrame, model: DataFrame, cfg: Config = Config()) -> DataFrame:
    """A few exemplars a family, those that resolved first, then by score."""
    rows = dga_score(dns, model, cfg).where(F.col("score") >= cfg.dga_threshold)
    first = F.desc(F.coalesce("resolved", F.lit(False)))
    few = top_per(rows, ["src_ip", "suffix"], cfg.max_per_family, first, F.desc("score"), "label")
    return top(few, cfg.max_dga, F.desc("score"), "suffix", "label", "src_ip")


def tls_score(ssl: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Fingerprints by source; the estate is all sources with one."""
    rows = ssl.dropna(subset=["ts", "src_ip", "ja3"]).where(F.trim("ja3") != "")
    pairs = rows.groupBy("src_ip", "ja3").agg(F.count("*").alias("sessions"), count_values(F.col("dst_ip")).alias("servers"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    presenting = pairs.groupBy("ja3").agg(F.count("*").alias("presenting_hosts"))
    estate = pairs.agg(F.count_distinct("src_ip").alias("estate_hosts"))
    rare = pairs.join(presenting, "ja3").where((F.col("presenting_hosts") <= cfg.max_presenting) & (F.col("sessions") >= cfg.min_sessions))
    # one row, so this is a scalar beside each row
    rows = rare.join(F.broadcast(estate)).where(F.col("estate_hosts") >= cfg.min_estate_hosts)
    rows = rows.withColumn("fingerprint_rarity", rarity(F.col("presenting_hosts"))).withColumn("estate_support", saturating(F.col("estate_hosts"), cfg.strong_estate))
    return rows.withColumn("score", weighted_mean({k: (F.col(k), w) for k, w in TLS_WEIGHTS.items()}))


def tls_detect(ssl: DataFrame, cfg: Config = Config()) -> DataFrame:
    return top(tls_score(ssl, cfg).where(F.col("score") >= cfg.tls_threshold), cfg.max_tls, F.desc("score"), "src_ip", "ja3")
