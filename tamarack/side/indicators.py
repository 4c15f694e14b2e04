"""Threat indicators: hand-written .ioc files, and joins of addresses and names against them.

Indicator files are written by operators, so they are read on the driver; the table's size is checked before it is
broadcast, and beyond the limit the same equi-joins shuffle.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tamarack.side.text import Kind, classify, read_confidence, read_date, read_lines

SCHEMA = (
    "value STRING, kind STRING, feed STRUCT<name: STRING, path: STRING, declared_confidence: DOUBLE, updated: DATE, reference: STRING, tlp: STRING, metadata: MAP<STRING, STRING>>, "
    "added DATE, confidence DOUBLE, note STRING, attributes MAP<STRING, STRING>, source_file STRING, source_line BIGINT"
)
#: Indicators up to which their table is broadcast.
BROADCAST_ROWS = 200_000
_FEED_KEYS = {"name", "confidence", "updated", "date", "reference", "source", "tlp"}


def read_ioc_text(text: str, path: str) -> tuple[list[tuple], list[tuple[str, int, str]]]:
    """Rows of SCHEMA and rejected lines of one file."""
    header, rows, rejects = read_lines(text, 1)
    updated = read_date(header.get("updated") or header.get("date"))
    feed = (
        header.get("name") or Path(path).stem, path, read_confidence(header.get("confidence")), updated,
        header.get("reference") or header.get("source"), header.get("tlp"), {k: v for k, v in header.items() if k not in _FEED_KEYS},
    )
    out, bad = [], [(path, n, line) for n, line in rejects]
    for number, (value,), attributes, line in rows:
        known = classify(value)
        if known is None:
            bad.append((path, number, line))
            continue
        kind, plain = known
        added = read_date(attributes.get("added") or attributes.get("first_seen")) or updated
        rest = {k: v for k, v in attributes.items() if k not in {"added", "first_seen", "confidence", "note"}}
        out.append((plain, kind.value, feed, added, read_confidence(attributes.get("confidence")), attributes.get("note"), rest, path, number))
    return out, bad


def load_indicators(spark: SparkSession, directory: str) -> tuple[DataFrame, list[tuple[str, int, str]]]:
    """All .ioc files below a directory: the indicators, and the lines that were rejected."""
    rows, bad = [], []
    for path in sorted(Path(directory).rglob("*.ioc")):
        try:
            found, rejected = read_ioc_text(path.read_text(encoding="utf-8", errors="replace"), str(path))
        except OSError:
            continue
        rows += found
        bad += rejected
    return spark.createDataFrame(rows, SCHEMA), bad


def best_of(indicators: DataFrame) -> DataFrame:
    """One row a value: the surest, then the newest, then by file and line."""
    sure = F.coalesce("confidence", "feed.declared_confidence", F.lit(-1.0))
    by = Window.partitionBy("kind", "value").orderBy(F.desc(sure), F.desc_nulls_last("added"), "source_file", "source_line")
    return indicators.withColumn("__n", F.row_number().over(by)).where("__n = 1").drop("__n")


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast if it has at most limit rows; else left for a shuffled join."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def ipv4_number(address: Column) -> Column:
    """A dotted address as a number; null if it isn't one."""
    parts = F.split(address, "[.]")
    number = F.aggregate(parts, F.lit(0).cast("bigint"), lambda acc, x: acc * 256 + x.try_cast("bigint"))
    return F.when(address.rlike(r"^(25[0-5]|2[0-4]\d|1?\d?\d)(\.(25[0-5]|2[0-4]\d|1?\d?\d)){3}$"), number)


def address_hex(address: Column) -> Column:
    """An address of either version as hexadecimal digits, 8 or 32 of them, whatever its spelling; null if it isn't one."""
    text = F.lower(F.trim(address))
    number = ipv4_number(text)
    # the last 32 bits of an IPv6 address may be dotted
    tail = ipv4_number(F.regexp_extract(text, r":([0-9.]+)$", 1))
    half = lambda shift: F.lower(F.hex(F.shiftright(tail, shift).bitwiseAND(0xFFFF)))
    plain = F.when(tail.isNotNull(), F.concat(F.regexp_replace(text, r"[0-9.]+$", ""), half(16), F.lit(":"), half(0))).otherwise(text)
    group = r"[0-9a-f]{1,4}"
    sides = F.split(plain, "::")
    part = lambda i: F.when(F.get(sides, F.lit(i)) != "", F.split(F.get(sides, F.lit(i)), ":")).otherwise(F.array().cast("array<string>"))
    padded = lambda i: F.array_join(F.transform(part(i), lambda g: F.lpad(g, 4, "0")), "")
    n = F.size(part(0)) + F.size(part(1))
    whole = plain.rlike(f"^{group}(:{group}){{7}}$")
    short = plain.rlike(f"^({group}(:{group})*)?::({group}(:{group})*)?$") & (n <= 7)
    six = F.when(whole, padded(0)).when(short, F.concat(padded(0), F.repeat(F.lit("0000"), 8 - n), padded(1)))
    return F.when(number.isNotNull(), F.lpad(F.lower(F.hex(number)), 8, "0")).otherwise(six)


def _prefix(digits: Column, bits: Column) -> Column:
    """The first bits of hexadecimal digits: whole digits, then what is left as a number."""
    left = bits % 4
    digit = F.conv(F.substring(digits, F.floor(bits / 4).cast("int") + 1, F.lit(1)), 16, 10).cast("int")
    rest = F.when(left > 0, F.floor(digit / F.pow(F.lit(2), 4 - left)).cast("int").cast("string")).otherwise("")
    return F.concat(F.substring(digits, F.lit(1), F.floor(bits / 4).cast("int")), F.lit("+"), rest)


def match_networks(addresses: DataFrame, networks: DataFrame, address: str = "address") -> DataFrame:
    """(address, network): each distinct address, of either version, in the narrowest network of its version that holds it.

    Each address is cut once for every prefix length in use in its version (33 or 129 at most) and equi-joined on
    (version, length, prefix).
    """
    nets = networks.select("value").where(F.contains("value", F.lit("/"))).distinct()
    nets = nets.withColumn("bits", F.substring_index("value", "/", -1).try_cast("int")).withColumn("base", address_hex(F.substring_index("value", "/", 1))).where("base is not null and bits is not null")
    nets = nets.select("value", "bits", F.length("base").alias("digits"), _prefix(F.col("base"), F.col("bits")).alias("prefix")).where("bits between 0 and 4 * digits")
    lengths = nets.groupBy("digits").agg(F.collect_set("bits").alias("lengths"))  # two rows at most
    rows = addresses.select(address).distinct().withColumn("__h", address_hex(F.col(address))).where("__h is not null").withColumn("digits", F.length("__h")).join(F.broadcast(lengths), "digits")
    rows = rows.select(address, "__h", "digits", F.explode("lengths").alias("bits")).withColumn("prefix", _prefix(F.col("__h"), F.col("bits")))
    found = rows.join(small(nets), ["digits", "bits", "prefix"])
    return found.groupBy(address).agg(F.max_by("value", F.struct("bits", "value")).alias("network"))


def parents_of(name: Column) -> Column:
    """A name and its parents of two labels or more, the most specific first, each with its depth."""
    labels = F.filter(F.split(F.lower(F.btrim(name, F.lit("."))), "[.]"), lambda x: x != "")

    def walk(parts: Column) -> Column:
        n = F.size(parts)
        places = F.when(n >= 2, F.sequence(F.lit(0), n - 2)).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(parts, i + 1, n), ".").alias("name")))

    return F.get(F.transform(F.array(labels), walk), F.lit(0))


def match_names(names: DataFrame, domains: DataFrame, name: str = "name") -> DataFrame:
    """(name, domain, depth): each distinct name with its most specific listed parent, or itself."""
    rows = names.select(name).distinct().withColumn("p", F.explode(parents_of(F.col(name)))).select(name, "p.depth", F.col("p.name").alias("domain"))
    listed = domains.select(F.col("value").alias("domain")).distinct()
    found = rows.join(small(listed), "domain")
    return found.groupBy(name).agg(F.min_by("domain", "depth").alias("domain"), F.min("depth").alias("depth"))
