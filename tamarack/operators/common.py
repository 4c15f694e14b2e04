"""Joins and samples that the detectors share."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamarack.runtime import materialize

#: Order of records wherever one must be chosen: never left to the engine.
RECORD_ORDER = ["ts", "source_file", "source_line"]


def key_of(*columns: str) -> Column:
    """One string for several columns, in which null is a value of its own."""
    return F.concat_ws("\x01", *[F.coalesce(F.col(c).cast("string"), F.lit("\x02")) for c in columns])


def null_safe_semi(left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of left whose columns equal those of some row of right, null being equal to null."""
    other = right.select(*[F.col(c).alias(f"__{c}") for c in columns])
    return left.join(other, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in columns]), "left_semi")


def not_among(column: str, values: tuple) -> Column:
    """Null or not one of the values."""
    return F.col(column).isNull() | ~F.col(column).isin(*values) if values else F.lit(True)


def with_locators(df: DataFrame) -> DataFrame:
    """df with source_file and source_line, null where the source has none."""
    for name, kind in (("source_file", "string"), ("source_line", "bigint")):
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast(kind))
    return df


def first_records(rows: DataFrame, keys: list[str], k: int, excerpt: Column | None = None, order: list | None = None) -> DataFrame:
    """(keys, artifacts): the first k records of each key by RECORD_ORDER, at most k gathered a key."""
    rows = with_locators(rows)
    by = Window.partitionBy(*keys).orderBy(*(order or RECORD_ORDER))
    artifact = F.struct(
        F.col("__n").alias("n"),
        F.coalesce("source_file", F.lit("<aggregate>")).alias("source"),
        F.coalesce(F.concat(F.lit("line:"), F.col("source_line").cast("string")), F.lit("-")).alias("locator"),
        F.timestamp_micros((F.col("ts") * 1e6).cast("long")).alias("observed_at"),
        excerpt_text(excerpt if excerpt is not None else F.lit("")).alias("excerpt"),
    )
    chosen = rows.withColumn("__n", F.row_number().over(by)).where(F.col("__n") <= k)
    return chosen.groupBy(*keys).agg(F.sort_array(F.collect_list(artifact)).alias("artifacts"))


def evenly_spaced(rows: DataFrame, key: str, k: int) -> DataFrame:
    """The rows of each key at k evenly spaced places of RECORD_ORDER, first and last included (ties of places half to even)."""
    rows = with_locators(rows)
    numbered = rows.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*RECORD_ORDER)) - 1).withColumn("__size", F.count("*").over(Window.partitionBy(key)))
    step = (F.col("__size") - 1) / F.lit(float(max(k - 1, 1)))
    places = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.bround(i * step, 0).cast("int"))
    return numbered.where((F.col("__size") <= k) | F.array_contains(places, F.col("__n"))).drop("__n", "__size")


def numbered(df: DataFrame, name: str, *order: Column | str) -> DataFrame:
    """df with each row's place in a total order, from 1.

    Rows are dealt into ranges of that order and numbered within each; a range's first place follows from the sizes of
    those before it, one row a range, so no task sorts all rows.
    """
    ranged = materialize(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "numbered")
    sizes = ranged.groupBy("__range").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = ranged.join(F.broadcast(sizes.select("__range", before.alias("__before"))), "__range")
    within = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return placed.withColumn(name, within + F.col("__before")).drop("__range", "__before")


def excerpt_text(text: Column, limit: int = 512) -> Column:
    """At most limit characters, the last one an ellipsis where some were cut."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit - 1), F.lit("…"))).otherwise(text)


def top(df: DataFrame, n: int, *order) -> DataFrame:
    """The first n rows of a total order, as a bounded top-k."""
    return df.orderBy(*order).limit(n)


def top_per(df: DataFrame, keys: list[str], n: int, *order) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__n") <= n).drop("__n")
