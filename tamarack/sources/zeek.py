"""Zeek logs, tab-separated or JSON, plain or gzipped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack import schemas
from tamarack.side.indicators import small
from tamarack.sources.lines import numbered_lines

_UNSET = "-"


def records(lines: DataFrame) -> DataFrame:
    """(m, is_json, source_file, source_line): each record as a map from column names to text, whatever its file's format.

    A file is JSON if its first line that isn't blank opens an object; else its columns are named by its #fields line.
    """
    blank = F.trim("value") == ""
    files = lines.where(~blank).groupBy("source_file").agg(
        F.min_by(F.ltrim("value"), "source_line").startswith("{").alias("is_json"),
        F.min_by(F.when(F.col("value").startswith("#fields\t"), F.col("value")), F.when(F.col("value").startswith("#fields\t"), F.col("source_line"))).alias("head"),
    )
    files = files.withColumn("names", F.slice(F.split("head", "\t"), 2, 10_000)).select(F.col("source_file").alias("__f"), "is_json", "names")
    rows = lines.where(~blank).join(small(files), F.col("source_file") == F.col("__f"))
    parts = F.transform(F.split("value", "\t"), lambda x: F.nullif(x, F.lit(_UNSET)))
    k = F.least(F.size(parts), F.size("names"))
    tsv = F.when(F.col("names").isNotNull() & ~F.col("value").startswith("#"), F.map_from_arrays(F.slice(F.col("names"), F.lit(1), k), F.slice(parts, F.lit(1), k)))
    return rows.select(F.when(F.col("is_json"), F.from_json("value", "map<string,string>")).otherwise(tsv).alias("m"), "is_json", "source_file", "source_line").where("m is not null and size(m) > 0")


def _kind(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Records of files whose name up to the first dot is the kind, .log among its endings."""
    lines = numbered_lines(spark, path, f"{kind}*.log*")
    name = F.substring_index(F.substring_index("source_file", "/", -1), ".", 1)
    return records(lines.where(name == kind))


def _of(name: str) -> Column:
    return F.col("m")[name]


def _columns(rows: DataFrame, names: dict[str, Column], schema) -> DataFrame:
    return schemas.conform(rows.select(*[c.alias(k) for k, c in names.items()], "source_file", "source_line"), schema)


_ENDS = {"src_ip": "id.orig_h", "src_port": "id.orig_p", "dst_ip": "id.resp_h", "dst_port": "id.resp_p"}


def _plain(schema, renamed: dict[str, str]) -> dict[str, Column]:
    return {f.name: _of(renamed.get(f.name, f.name)) for f in schema.fields if f.name not in ("source_file", "source_line")}


def load_connections(spark: SparkSession, path: str) -> DataFrame:
    return _columns(_kind(spark, path, "conn"), _plain(schemas.CONNECTIONS, _ENDS), schemas.CONNECTIONS)


def load_dns(spark: SparkSession, path: str) -> DataFrame:
    """The textual query type and response code count where a file has their columns; lists of answers are joined by semicolons."""
    rows, names = _kind(spark, path, "dns"), _plain(schemas.DNS, _ENDS)
    held = [F.bool_or(F.map_contains_key("m", f"{plain}_name")).alias(f"has_{plain}") for plain in ("qtype", "rcode")]
    files = rows.groupBy(F.col("source_file").alias("__f")).agg(*held)
    rows = rows.join(small(files), F.col("source_file") == F.col("__f"))
    for plain in ("qtype", "rcode"):
        names[plain] = F.when(F.col(f"has_{plain}"), _of(f"{plain}_name")).otherwise(_of(plain))
    listed = F.from_json(_of("answers"), "array<string>")
    names["answers"] = F.when(F.col("is_json") & F.ltrim(_of("answers")).startswith("["), F.array_join(listed, ";")).otherwise(_of("answers"))
    return _columns(rows, names, schemas.DNS)


def load_ssl(spark: SparkSession, path: str) -> DataFrame:
    names = _plain(schemas.SSL, _ENDS)
    stated = F.upper(_of("established"))
    names["established"] = F.when(stated.isin("T", "TRUE"), True).when(stated.isin("F", "FALSE"), False)
    return _columns(_kind(spark, path, "ssl"), names, schemas.SSL)
