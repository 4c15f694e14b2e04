"""Writers: telemetry as Parquet tables and as the text formats that the readers take."""

from __future__ import annotations

from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarack.runtime import shared_dir


def write_tables(frames: dict[str, DataFrame], directory: str) -> None:
    """Each frame as a Parquet table; Spark reads them back with the columns and filters a query needs."""
    for name, df in frames.items():
        df.write.mode("overwrite").parquet(f"{directory}/{name}.parquet")


_ENDS = {"src_ip": "id.orig_h", "src_port": "id.orig_p", "dst_ip": "id.resp_h", "dst_port": "id.resp_p"}


def _text(name: str, kind: str) -> Column:
    c = F.col(name)
    if kind == "boolean":
        return F.when(c, "T").when(~c, "F")
    return F.format_string("%.6f", c) if kind == "double" else c.cast("string")


def zeek_lines(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """(value): a Zeek TSV line of each row, in the order of df."""
    kinds = dict(df.dtypes)
    return df.select(F.concat_ws("\t", *[F.coalesce(_text(c, kinds[c]), F.lit("-")) for c in columns]).alias("value"))


def write_lines(lines: DataFrame, path: str, head: Iterable[str] = ()) -> None:
    """The column value as the lines of one file of any size, below head and in the order of a sorted frame.

    Executors write the lines as parts; the driver strings the parts' bytes together, a buffer at a time.
    """
    spark = lines.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(shared_dir(spark, "lines"))
    lines.select("value").write.text(folder.toString())
    found = [x.getPath() for x in folder.getFileSystem(conf).listStatus(folder)]
    parts = sorted((int(x.getName().split("-")[1]), x.getName(), x) for x in found if x.getName().startswith("part-"))
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(conf).create(target)
    try:
        out.write(bytearray("".join(x + "\n" for x in head).encode()))
        for _, _, part in parts:
            source = part.getFileSystem(conf).open(part)
            try:
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, 1 << 20, False)
            finally:
                source.close()
    finally:
        out.close()


def write_zeek(df: DataFrame, path: str, kind: str) -> None:
    """One Zeek TSV log of a small frame (fixtures and synthetic corpora), as one file."""
    names = [(c, t) for c, t in df.dtypes if c not in ("source_file", "source_line")]
    rows = [r[0] for r in df.orderBy("ts").select(F.concat_ws("\t", *[F.coalesce(_text(c, t), F.lit("-")) for c, t in names])).collect()]
    head = ["#separator \\x09", f"#path\t{kind}", "#fields\t" + "\t".join(_ENDS.get(c, c) for c, _ in names)]
    Path(path).write_text("\n".join(head + rows) + "\n", encoding="utf-8")


def write_eve(df: DataFrame, path: str) -> None:
    alert = F.struct("signature", "signature_id", "category", "severity")
    when = F.date_format(F.timestamp_micros((F.col("ts") * 1e6).cast("long")), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")
    rows = df.orderBy("ts").select(F.to_json(F.struct(when.alias("timestamp"), F.lit("alert").alias("event_type"), "src_ip", F.col("dst_ip").alias("dest_ip"), F.col("dst_port").alias("dest_port"), "proto", alert.alias("alert")))).collect()
    Path(path).write_text("\n".join(r[0] for r in rows) + "\n", encoding="utf-8")


def write_sysmon(df: DataFrame, path: str) -> None:
    when = F.date_format(F.timestamp_micros((F.col("ts") * 1e6).cast("long")), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")
    pairs = {"Hostname": "host", "User": "user", "Image": "image", "CommandLine": "command_line", "ProcessGuid": "process_guid", "ProcessId": "process_id", "ParentImage": "parent_image", "ParentProcessGuid": "parent_guid", "IntegrityLevel": "integrity_level"}
    body = F.struct(F.lit(1).alias("EventID"), F.lit("Microsoft-Windows-Sysmon").alias("SourceName"), when.alias("UtcTime"), *[F.col(v).alias(k) for k, v in pairs.items()], F.concat(F.lit("SHA256="), "sha256").alias("Hashes"))
    rows = df.orderBy("ts").select(F.to_json(body)).collect()
    Path(path).write_text("\n".join(r[0] for r in rows) + "\n", encoding="utf-8")


def write_netflow(df: DataFrame, path: str) -> None:
    when = F.date_format(F.timestamp_micros((F.col("ts") * 1e6).cast("long")), "yyyy-MM-dd HH:mm:ss.SSS")
    end = lambda a, p: F.concat_ws(":", a, F.col(p).cast("string"))
    parts = [when, F.coalesce(F.col("duration").cast("string"), F.lit("0")), F.coalesce("proto", F.lit("TCP")), end("src_ip", "src_port"), F.lit("->"), end("dst_ip", "dst_port"), F.coalesce("conn_state", F.lit("-")), F.lit("0"), F.coalesce(F.col("orig_pkts").cast("string"), F.lit("")), F.coalesce(F.col("orig_bytes").cast("string"), F.lit("")), F.lit("1"), F.coalesce("label", F.lit("background"))]
    rows = df.orderBy("ts").select(F.concat_ws("\t", *parts)).collect()
    Path(path).write_text("Date flow start\tDurat\tProt\tSrc\n" + "\n".join(r[0] for r in rows) + "\n", encoding="utf-8")
