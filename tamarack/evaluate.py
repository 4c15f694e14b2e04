"""Detectors against planted truth and labelled captures."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack import synth
from tamarack.operators import alerts, beaconing, dnstunnel, egress, fanout, host, tlsdga
from tamarack.plans import correlate
from tamarack.plans.context import Context, all_findings


@dataclass(frozen=True)
class Score:
    tp: int
    fp: int
    fn: int

    @property
    def precision(self) -> float:
        return self.tp / (self.tp + self.fp) if self.tp + self.fp else 1.0

    @property
    def recall(self) -> float:
        return self.tp / (self.tp + self.fn) if self.tp + self.fn else 1.0

    @property
    def f1(self) -> float:
        return 2 * self.precision * self.recall / (self.precision + self.recall) if self.precision + self.recall else 0.0


def compare(found: DataFrame, truth: DataFrame, keys: list[str]) -> Score:
    """Distinct keys found and true, counted by one full outer join."""
    a = found.select(*keys).distinct().withColumn("__f", F.lit(1))
    b = truth.select(*keys).distinct().withColumn("__t", F.lit(1))
    row = a.join(b, keys, "full_outer").agg(F.count(F.when(F.col("__f").isNotNull() & F.col("__t").isNotNull(), 1)), F.count(F.when(F.col("__t").isNull(), 1)), F.count(F.when(F.col("__f").isNull(), 1))).first()
    return Score(*row)


def run_corpus(spark: SparkSession, name: str, seed: int = 1337) -> Score:
    """One detector on its own corpus."""
    make, schema = synth.CORPORA[name]
    rows, truth = make(seed)
    df = synth.frame(spark, rows, schema)
    if name == "beaconing":
        found = beaconing.detect(df).select("src_ip", "dst_ip").where("dst_ip <> '10.0.0.2'")
        keys = ["src_ip", "dst_ip"]
    elif name == "fanout":
        found, keys = fanout.detect(df).select("src_ip", F.col("dst_port").cast("string").alias("dst_port")), ["src_ip", "dst_port"]
    elif name == "egress":
        found, keys = egress.detect(df).where("predicate = 'exfiltrates_to'"), ["src_ip", "dst_ip"]
    elif name == "dnstunnel":
        found, keys = dnstunnel.detect(df), ["src_ip", "zone"]
    elif name == "dga":
        model = tlsdga.bigram_model(spark.createDataFrame([(w,) for w in synth.words()], "word string"))
        found, keys = tlsdga.dga_detect(df, model), ["src_ip", "suffix"]
    elif name == "tls":
        found, keys = tlsdga.tls_detect(df), ["src_ip", "ja3"]
    elif name == "alerts":
        found, keys = alerts.detect(df), ["src_ip", "signature"]
    else:
        rare, lineage = host.detect(df)
        keys = ["host", "predicate", "image_name"]
        found = rare.withColumn("predicate", F.lit("executes_rare_process")).select(*keys).unionByName(lineage.withColumn("predicate", F.lit("exhibits_anomalous_lineage")).select(*keys))
    return compare(found, spark.createDataFrame(sorted(truth), ", ".join(f"{k} string" for k in keys)), keys)


def evaluate_labelled(spark: SparkSession, flows: DataFrame) -> dict:
    """A labelled capture: the network detectors see no label; the labelled hosts' places in the queue, and pair scores."""
    infected = flows.where("label = 'botnet'").select("src_ip", "dst_ip").distinct()
    unlabelled = flows.drop("label")
    found = all_findings(Context.of(spark, connections=unlabelled), ("beaconing", "fanout", "egress"))
    ranked = correlate.queue(found)
    pairs = found.where("predicate = 'beacons_to'").select(F.col("subject.value").alias("src_ip"), F.col("object.value").alias("dst_ip"))
    places = ranked.join(infected.select(F.col("src_ip").alias("v")).distinct(), F.col("subject.value") == F.col("v")).select("subject.value", "place").collect()
    return {"incidents": ranked.count(), "places": {r[0]: r[1] for r in places}, "beacon_pairs": compare(pairs, infected, ["src_ip", "dst_ip"])}
