"""The driver's tables as telemetry: projections that Spark and DuckDB both make, so that results can be compared."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tamarack.functions.exprs import epoch


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem: suppliers reach parts on line numbers as ports."""
    return read(spark, sf_dir, "lineitem").select(
        epoch("l_shipdate").alias("ts"), F.col("l_suppkey").cast("string").alias("src_ip"), F.col("l_partkey").cast("string").alias("dst_ip"), F.col("l_linenumber").alias("dst_port"),
        F.floor(F.col("l_extendedprice") * 10).cast("bigint").alias("orig_bytes"), F.when(F.col("l_returnflag") != "N", F.floor(F.col("l_quantity") * 1000).cast("bigint")).alias("resp_bytes"),
        F.lit("lineitem").alias("source_file"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("source_line"),
    )


FLOWS = """SELECT epoch(l_shipdate) AS ts, l_suppkey::VARCHAR AS src_ip, l_partkey::VARCHAR AS dst_ip, l_linenumber AS dst_port, floor(l_extendedprice * 10)::BIGINT AS orig_bytes,
  CASE WHEN l_returnflag <> 'N' THEN floor(l_quantity * 1000)::BIGINT END AS resp_bytes, 'lineitem' AS source_file, l_orderkey * 10 + l_linenumber AS source_line FROM lineitem"""


def contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events: twenty sources reach event types; a port for some types only."""
    return read(spark, sf_dir, "events").select(
        epoch("ts").alias("ts"), (F.col("user_id") % 20).cast("string").alias("src_ip"), F.col("event_type").alias("dst_ip"), F.when(F.col("event_type") != "click", F.lit(443)).alias("dst_port"),
        F.when(F.col("event_id") % 3 != 0, F.floor(F.col("value") * 100).cast("bigint")).alias("orig_bytes"), F.lit("events").alias("source_file"), F.col("event_id").alias("source_line"),
    )


CONTACTS = """SELECT epoch(ts) AS ts, (user_id % 20)::VARCHAR AS src_ip, event_type AS dst_ip, CASE WHEN event_type <> 'click' THEN 443 END AS dst_port,
  CASE WHEN event_id % 3 <> 0 THEN floor(value * 100)::BIGINT END AS orig_bytes, 'events' AS source_file, event_id AS source_line FROM events"""


def beacons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events put to a schedule: sources of an even number contact in bursts of two, every tenth contact is missing, and some jitter."""
    rows = read(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 40).alias("src"))
    number = F.row_number().over(Window.partitionBy("src").orderBy("event_id"))
    rows = rows.withColumn("n", number * 61 + F.col("src") * 7 + (F.col("event_id") % (F.col("src") % 5 + 2)) * (F.col("src") % 7) * 2).where("event_id % 10 <> 3")
    rows = rows.withColumn("burst", F.explode(F.when(F.col("src") % 2 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return rows.select(
        (1.7e9 + F.col("n") + F.col("burst") * 0.25).cast("double").alias("ts"), F.col("src").cast("string").alias("src_ip"), F.lit("c2").alias("dst_ip"), F.when(F.col("src") % 3 != 0, F.lit(8443)).alias("dst_port"),
        F.when(F.col("src") % 4 != 1, F.lit(500) + F.col("event_id") % 9).cast("bigint").alias("orig_bytes"), F.lit("events").alias("source_file"), (F.col("event_id") * 2 + F.col("burst")).alias("source_line"),
    )


BEACONS = """SELECT 1.7e9::DOUBLE + n + burst * 0.25::DOUBLE AS ts, src::VARCHAR AS src_ip, 'c2' AS dst_ip,
  CASE WHEN src % 3 <> 0 THEN 8443 END AS dst_port, CASE WHEN src % 4 <> 1 THEN (500 + event_id % 9)::BIGINT END AS orig_bytes, 'events' AS source_file, event_id * 2 + burst AS source_line
  FROM (SELECT event_id, src, n, unnest(CASE WHEN src % 2 = 0 THEN [0, 1] ELSE [0] END) AS burst FROM (SELECT event_id, user_id % 40 AS src,
    row_number() OVER (PARTITION BY user_id % 40 ORDER BY event_id) * 61 + user_id % 40 * 7 + (event_id % (user_id % 40 % 5 + 2)) * (user_id % 40 % 7) * 2 AS n FROM events) WHERE event_id % 10 <> 3)"""


def lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages: sources look up encoded names under the hosts of urls."""
    host = F.regexp_extract("url", "https?://([^/]+)", 1)
    return read(spark, sf_dir, "pages").select(
        (F.lit(1.7e9) + F.col("page_id")).cast("double").alias("ts"), (F.col("page_id") % 3).cast("string").alias("src_ip"), F.concat(F.substring(F.md5("url"), 1, 24), F.lit("."), host, F.lit(".")).alias("query"),
        F.when(F.col("page_id") % 4 == 0, "txt").otherwise("A").alias("qtype"), F.when(F.col("page_id") % 5 != 0, F.when(F.col("page_id") % 2 == 0, "NXDOMAIN").otherwise("NOERROR")).alias("rcode"),
        F.lit("pages").alias("source_file"), F.col("page_id").alias("source_line"),
    )


LOOKUPS = """SELECT 1.7e9::DOUBLE + page_id AS ts, (page_id % 3)::VARCHAR AS src_ip, substr(md5(url), 1, 24) || '.' || regexp_extract(url, 'https?://([^/]+)', 1) || '.' AS query,
  CASE WHEN page_id % 4 = 0 THEN 'txt' ELSE 'A' END AS qtype, CASE WHEN page_id % 5 <> 0 THEN CASE WHEN page_id % 2 = 0 THEN 'NXDOMAIN' ELSE 'NOERROR' END END AS rcode,
  'pages' AS source_file, page_id AS source_line FROM pages"""


def generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part: sources look up names, some made of words and some of digests, under a few suffixes."""
    word = F.replace("p_name", F.lit(" "), F.lit("-"))
    label = F.when(F.col("p_partkey") % 3 == 0, F.concat(word, F.col("p_partkey").cast("string"))).otherwise(F.substring(F.translate(F.md5(F.col("p_partkey").cast("string")), "012345", "qxzjkv"), 1, 12))
    suffix = F.element_at(F.array(*[F.lit(x) for x in ("com", "net", "co.uk")]), (F.col("p_partkey") % 3 + 1).cast("int"))
    return read(spark, sf_dir, "part").select(
        (F.lit(1.7e9) + F.col("p_partkey")).cast("double").alias("ts"), (F.col("p_partkey") % 5).cast("string").alias("src_ip"), F.concat(F.lit("www."), label, F.lit("."), suffix).alias("query"),
        F.when(F.col("p_partkey") % 5 != 4, F.when(F.col("p_size") > 20, "NXDOMAIN").otherwise("NOERROR")).alias("rcode"), F.lit("part").alias("source_file"), F.col("p_partkey").alias("source_line"),
    )


GENERATED = """SELECT 1.7e9::DOUBLE + p_partkey AS ts, (p_partkey % 5)::VARCHAR AS src_ip,
  'www.' || CASE WHEN p_partkey % 3 = 0 THEN replace(p_name, ' ', '-') || p_partkey::VARCHAR ELSE substr(translate(md5(p_partkey::VARCHAR), '012345', 'qxzjkv'), 1, 12) END || '.' || ['com', 'net', 'co.uk'][(p_partkey % 3 + 1)::INT] AS query,
  CASE WHEN p_partkey % 5 <> 4 THEN CASE WHEN p_size > 20 THEN 'NXDOMAIN' ELSE 'NOERROR' END END AS rcode, 'part' AS source_file, p_partkey AS source_line FROM part"""


def sensor_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders: customers trip signatures named by priority."""
    category = F.when(F.col("o_orderstatus") == "O", "A Network Trojan was detected").when(F.col("o_orderstatus") == "F", "Not Suspicious Traffic").otherwise(F.lit(None).cast("string"))
    return read(spark, sf_dir, "orders").select(
        epoch("o_orderdate").alias("ts"), (F.col("o_custkey") % 200).cast("string").alias("src_ip"), F.when(F.col("o_orderkey") % 4 != 0, (F.col("o_orderkey") % 3).cast("string")).alias("dst_ip"),
        F.concat("o_orderpriority", F.lit(" "), (F.col("o_custkey") % 97).cast("string")).alias("signature"), F.when(F.col("o_custkey") % 5 != 0, F.col("o_custkey") % 97).alias("signature_id"), category.alias("category"),
        (F.col("o_orderkey") % 4 + 1).cast("int").alias("severity"), F.lit("orders").alias("source_file"), F.col("o_orderkey").alias("source_line"),
    )


ALERTS = """SELECT epoch(o_orderdate) AS ts, (o_custkey % 200)::VARCHAR AS src_ip, CASE WHEN o_orderkey % 4 <> 0 THEN (o_orderkey % 3)::VARCHAR END AS dst_ip,
  o_orderpriority || ' ' || (o_custkey % 97)::VARCHAR AS signature, CASE WHEN o_custkey % 5 <> 0 THEN o_custkey % 97 END AS signature_id,
  CASE o_orderstatus WHEN 'O' THEN 'A Network Trojan was detected' WHEN 'F' THEN 'Not Suspicious Traffic' END AS category, (o_orderkey % 4 + 1)::INT AS severity, 'orders' AS source_file, o_orderkey AS source_line FROM orders"""


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders of customers: sixty sources present fingerprints named by segment and nation."""
    rows = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    name = F.concat_ws("-", F.lower("c_mktsegment"), F.when(F.col("c_nationkey") < 3, F.concat_ws("-", F.col("c_nationkey").cast("string"), (F.col("c_custkey") % 60).cast("string"))).otherwise((F.col("c_nationkey") % 3).cast("string")))
    return rows.select(
        epoch("o_orderdate").alias("ts"), (F.col("c_custkey") % 60).cast("string").alias("src_ip"), F.when(F.col("o_orderkey") % 7 != 0, (F.col("o_orderkey") % 5).cast("string")).alias("dst_ip"),
        F.when(F.col("o_orderkey") % 11 != 0, name).alias("ja3"), F.lit("orders").alias("source_file"), F.col("o_orderkey").alias("source_line"),
    )


SESSIONS = """SELECT epoch(o_orderdate) AS ts, (c_custkey % 60)::VARCHAR AS src_ip, CASE WHEN o_orderkey % 7 <> 0 THEN (o_orderkey % 5)::VARCHAR END AS dst_ip,
  CASE WHEN o_orderkey % 11 <> 0 THEN lower(c_mktsegment) || '-' || CASE WHEN c_nationkey < 3 THEN c_nationkey::VARCHAR || '-' || (c_custkey % 60)::VARCHAR ELSE (c_nationkey % 3)::VARCHAR END END AS ja3,
  'orders' AS source_file, o_orderkey AS source_line FROM orders JOIN customer ON o_custkey = c_custkey"""


def executions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem of parts: suppliers' hosts run images named by part, started by brands."""
    rows = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    folder = F.when(F.col("p_size") < 8, "C:\\Users\\x\\AppData\\").when(F.col("p_size") < 30, "C:\\Windows\\System32\\").otherwise("C:/Program Files/")
    return rows.select(
        epoch("l_shipdate").alias("ts"), F.concat(F.lit("h"), (F.col("l_suppkey") % 40).cast("string")).alias("host"), F.concat(folder, F.lit("P"), (F.col("p_partkey") % 300).cast("string"), F.lit(".exe")).alias("image"),
        F.when(F.col("l_linenumber") != 7, F.concat(F.lit("C:\\opt\\"), F.replace("p_brand", F.lit("#"), F.lit("")), F.lit(".exe"))).alias("parent_image"), F.lit("lineitem").alias("source_file"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("source_line"),
    )


EXECUTIONS = r"""SELECT epoch(l_shipdate) AS ts, 'h' || (l_suppkey % 40)::VARCHAR AS host,
  CASE WHEN p_size < 8 THEN 'C:\Users\x\AppData\' WHEN p_size < 30 THEN 'C:\Windows\System32\' ELSE 'C:/Program Files/' END || 'P' || (p_partkey % 300)::VARCHAR || '.exe' AS image,
  CASE WHEN l_linenumber <> 7 THEN 'C:\opt\' || replace(p_brand, '#', '') || '.exe' END AS parent_image, 'lineitem' AS source_file, l_orderkey * 10 + l_linenumber AS source_line FROM lineitem JOIN part ON l_partkey = p_partkey"""


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer: rows in the shape of findings, for correlation: (finding, predicate, subject, object, confidence, first_ts)."""
    verbs = ("beacons_to", "scans", "exfiltrates_to", "matches_threat_intel", "contacts_rare_destination", "triggered_signature")
    verb = F.element_at(F.array(*[F.lit(v) for v in verbs]), (F.col("c_custkey") % 6 + 1).cast("int"))
    unary = F.col("c_custkey") % 6 == 3
    return read(spark, sf_dir, "customer").select(
        F.concat(F.lit("f"), F.lpad(F.col("c_custkey").cast("string"), 9, "0")).alias("finding"), verb.alias("predicate"),
        F.when(unary, F.concat(F.lit("d"), (F.col("c_custkey") % 211).cast("string"))).otherwise(F.concat(F.lit("s"), (F.floor(F.col("c_custkey") / 7) % 101).cast("string"))).alias("subject"),
        F.when(~unary, F.concat(F.lit("d"), (F.col("c_custkey") % 199).cast("string"))).alias("object"), F.round((F.col("c_custkey") * 37 % 100) / 100, 4).alias("confidence"), (F.col("c_custkey") * 977 % 86400).cast("double").alias("first_ts"),
    )


CLAIMS = """SELECT 'f' || lpad(c_custkey::VARCHAR, 9, '0') AS finding, ['beacons_to', 'scans', 'exfiltrates_to', 'matches_threat_intel', 'contacts_rare_destination', 'triggered_signature'][(c_custkey % 6 + 1)::INT] AS predicate,
  CASE WHEN c_custkey % 6 = 3 THEN 'd' || (c_custkey % 211)::VARCHAR ELSE 's' || ((c_custkey // 7) % 101)::VARCHAR END AS subject,
  CASE WHEN c_custkey % 6 <> 3 THEN 'd' || (c_custkey % 199)::VARCHAR END AS object, round((c_custkey * 37 % 100) / 100, 4) AS confidence, (c_custkey * 977 % 86400)::DOUBLE AS first_ts FROM customer"""


def as_findings(rows: DataFrame) -> DataFrame:
    """claims() as findings with evidence."""
    from tamarack.plans.findings import artifacts, entity, evidence, findings

    none = F.array().cast("array<struct<n:int,source:string,locator:string,observed_at:timestamp,excerpt:string>>")
    shaped = rows.withColumn("last_ts", F.col("first_ts")).withColumn("__c", artifacts(none))
    proof = evidence("stated", F.col("finding"), {"finding": F.col("finding")}, F.col("__c"))
    target = F.when(F.col("object").isNotNull(), entity(F.lit("ip"), F.col("object")))
    kind = F.when(F.col("object").isNull(), "ip").otherwise("host")
    return findings(shaped, predicate=F.col("predicate"), subject=entity(kind, F.col("subject")), object=target, evidence=F.array(proof), confidence=F.col("confidence"), severity=F.lit("medium"), basis=F.lit("stated"), analyzer="adapter")
