"""A training-corpus pipeline: quality classifier, near-duplicates, secrets, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's documents.  All but the last keep the columns of documents: doc_id, text, lang, source, n_chars.  Null texts
and empty tables pass through every stage; each stage works on all rows of the one before.  Rows may repeat, ids may be
null or have several texts (the near-duplicates stage says what becomes of them); columns beyond these five go.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.llm import bpe, mixing, near_dup, quality_model, secret_scan
from tamarack.llm.common import materialize, prepare, remove_rows, told_apart
from tamarack.llm.queries import tokenizer

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches the threshold; the others go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality_model.train(docs, labels)
    return quality_model.score(docs.select(*COLUMNS), model).where("__score >= 0.5").drop("__score")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates on five-word shingles: that of the smallest id.

    Rows that share a doc_id but not a text are judged and kept each by its own text; all but one of these texts count as
    of larger ids than any other's.
    """
    nodes = told_apart(docs.select(*COLUMNS))
    gone = near_dup.near_duplicates(nodes, id_col="__node").where(~F.col("kept")).select(F.col("doc_id").alias("__node"))
    return remove_rows(nodes, gone, id_col="__node").select(*COLUMNS)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by a mark and n_chars counted again."""
    scanned = secret_scan.scan(docs, keep=("lang", "source"))
    text = secret_scan.redacted()
    return scanned.select("doc_id", text.alias("text"), "lang", "source").withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time the mix takes a document, dealt into shards and shuffled in each."""
    rows = mixing.mix(docs.select(*COLUMNS))
    return rows.repartition("__shard", F.pmod("__place", F.lit(64))).sortWithinPartitions("__shard", "__place").select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids) of every row."""
    return bpe.encode(docs, tokenizer("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality),
    ("MinHash near-dedup", near_duplicates),
    ("secret scans", secrets),
    ("mixing sources to target weights", mixture),
    ("BPE encoding and decoding", tokens),
]

#: Shingle sets, trained scores and random draws are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the table documents."""
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
    return STAGES[-1][1](spark, docs, sf_dir)
