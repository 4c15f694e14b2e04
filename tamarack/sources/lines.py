"""Log lines with their true line numbers, from files of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Blocks of files that are broadcast at most.
BROADCAST_BLOCKS = 100_000


def numbered_lines(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(value, source_file, source_line) of all lines of the files below a path whose name matches glob.

    Large files are read in blocks by many tasks.  Within a block lines are numbered as they are read; the lines of the
    blocks before it (one count a block) are added.  Compressed files are one block; those that can't be read are empty.
    Local files may have colons in their names, as rotated logs do: they are opened without checksum files, whose names
    Hadoop can't form then.
    """
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).option("ignoreCorruptFiles", "true")
    reader = reader.option("fs.file.impl", "org.apache.hadoop.fs.RawLocalFileSystem").option("fs.file.impl.disable.cache", "true")
    try:
        raw = reader.text(path)
        raw.schema  # noqa: B018  resolves the path now
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER" in str(e):
            return spark.createDataFrame([], "value string, source_file string, source_line bigint")
        raise
    rows = raw.select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"))
    blocks = rows.groupBy("f", "b").agg(F.min("i").alias("i0"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("f").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.select(F.col("f").alias("f2"), F.col("b").alias("b2"), plain_path(F.col("f")).alias("source_file"), "i0", before.alias("before"))
    # a block of less than a MB is a file's last; texts aren't shuffled for the few rows of blocks
    if len(raw.inputFiles()) + (int(raw._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) >> 20) <= BROADCAST_BLOCKS:
        blocks = F.broadcast(blocks)
    joined = rows.join(blocks, (F.col("f") == F.col("f2")) & (F.col("b") == F.col("b2")))
    return joined.select("value", "source_file", (F.col("i") - F.col("i0") + F.col("before") + 1).alias("source_line"))


def plain_path(path: Column) -> Column:
    return F.regexp_replace(F.url_decode(path), "^file:/+", "/")


def epoch_of(text: Column) -> Column:
    """Seconds since 1970, cut to milliseconds, of a date and time; without a zone it is UTC; null if it can't be read."""
    plain = F.regexp_replace(F.trim(text), r"([+-]\d\d)(\d\d)$", "$1:$2")
    zoned = F.when(plain.rlike(r"\d(Z|[+-]\d\d:\d\d)$"), plain).otherwise(F.concat(plain, F.lit("Z")))
    return F.when(plain.rlike(r"^\d{4}-\d\d-\d\d[ T]\d\d:\d\d"), F.unix_millis(zoned.try_cast("timestamp")) / F.lit(1000.0))


def key(entries: Column, *names: str) -> Column:
    """The first value in a map's entries whose key is one of the names in lower case, and that isn't null."""
    found = F.filter(entries, lambda e: F.lower(e["key"]).isin(*names) & e["value"].isNotNull())
    return F.get(found, F.lit(0))["value"]
