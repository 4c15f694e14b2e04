"""More queries beside their DuckDB forms: detectors with their caps, samples, readers over files written from the driver's tables, side tables, streams."""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import replace
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack import adapters as A
from tamarack import catalog as C
from tamarack import evaluate, schemas
from tamarack.catalog import ORACLES, QUERIES, query, r, rounded, wgm
from tamarack.functions import exprs as X
from tamarack.operators import alerts, beaconing, common, dnstunnel, egress, fanout, host, intel, tlsdga
from tamarack.plans import correlate
from tamarack.runtime import shared_dir
from tamarack.side import indicators as ioc
from tamarack.side import inventory as inv
from tamarack.sources import netflow, passivedns, sinks, suricata, sysmon, zeek
from tamarack.streaming import windows

__all__ = ["ORACLES", "QUERIES"]


# --- detectors with their thresholds and caps


def detected(name: str, weights: dict[str, float], threshold: float, limit: int, order: str, columns: str) -> str:
    """The oracle of a scored query with its score unrounded, cut at the threshold and capped."""
    raw = ORACLES[name].replace(r(wgm(weights), "score"), f"{wgm(weights)} AS score")
    return f"SELECT {columns}, {r('score', 'score')} FROM (SELECT * FROM ({raw}) WHERE score >= {threshold} ORDER BY score DESC, {order} LIMIT {limit})"


_FANOUT = fanout.Config(max_findings=40)


@query(detected("fanout_scored", fanout.WEIGHTS, 0.55, 40, "src_ip, dst_port", "src_ip, dst_port, destinations"))
def fanout_detected(spark, sf_dir):
    return rounded(fanout.detect(A.flows(spark, sf_dir), _FANOUT).select("src_ip", "dst_port", "destinations", "score"))


@query(detected("beacon_scored", beaconing.WEIGHTS, 0.72, 5, "src_ip, dst_ip, dst_port", "src_ip, dst_ip, dst_port, samples"))
def beacon_detected(spark, sf_dir):
    return rounded(beaconing.detect(A.beacons(spark, sf_dir), beaconing.Config(max_findings=5)).select("src_ip", "dst_ip", "dst_port", "samples", "score"))


@query(detected("dns_tunnel_scored", dnstunnel.WEIGHTS, 0.2, 20, "src_ip, zone", "src_ip, zone, queries"))
def dns_tunnel_detected(spark, sf_dir):
    return rounded(dnstunnel.detect(A.lookups(spark, sf_dir), replace(C._TUNNEL, threshold=0.2, max_findings=20)).select("src_ip", "zone", "queries", "score"))


@query(detected("alert_scored", alerts.WEIGHTS, 0.5, 30, "alerts DESC, src_ip, signature", "src_ip, signature, alerts"))
def alert_detected(spark, sf_dir):
    return rounded(alerts.detect(A.sensor_alerts(spark, sf_dir), alerts.Config(threshold=0.5, max_findings=30)).select("src_ip", "signature", "alerts", "score"))


@query(detected("tls_rare", tlsdga.TLS_WEIGHTS, 0.70, 20, "src_ip, ja3", "src_ip, ja3, sessions"))
def tls_detected(spark, sf_dir):
    return rounded(tlsdga.tls_detect(A.sessions(spark, sf_dir)).select("src_ip", "ja3", "sessions", "score"))


_DGA = ORACLES["dga_scored"].replace(r(wgm(tlsdga.DGA_WEIGHTS), "score"), f"{wgm(tlsdga.DGA_WEIGHTS)} AS score")


@query(
    f"""SELECT src_ip, suffix, label, resolved, {r('score', 'score')} FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src_ip, suffix ORDER BY coalesce(resolved, false) DESC, score DESC, label) AS n FROM ({_DGA}) WHERE score >= 0.3)
 WHERE n <= 3 ORDER BY score DESC, suffix, label, src_ip LIMIT 25)"""
)
def dga_detected(spark, sf_dir):
    found = tlsdga.dga_detect(A.generated(spark, sf_dir), C._model(spark, sf_dir), tlsdga.Config(dga_threshold=0.3, max_dga=25))
    return rounded(found.select("src_ip", "suffix", "label", "resolved", "score"))


_CAPPED = replace(C._EGRESS, max_findings=12, max_rare=6)


@query(
    f"""{C._EGRESS_CTES}, bd2 AS (SELECT src_ip, dst_ip, score, CASE WHEN bytes >= 600000 AND egress_ratio IS NOT NULL AND score >= 0.70 THEN 'exfiltrates_to' WHEN bytes >= 600000 AND score >= 0.45 AND coalesce(volume_deviation, 0) >= 0.5 THEN 'transfers_anomalous_volume'
   WHEN bytes >= 100000 AND flows >= 1 AND hosts <= 35 AND score >= 0.30 THEN 'contacts_rare_destination' END AS predicate FROM sc),
 rk AS (SELECT *, CASE predicate WHEN 'exfiltrates_to' THEN 2 WHEN 'transfers_anomalous_volume' THEN 1 ELSE 0 END AS band FROM bd2 WHERE predicate IS NOT NULL),
 st AS (SELECT *, row_number() OVER (PARTITION BY band > 0 ORDER BY score DESC, src_ip, dst_ip) AS n FROM (SELECT * FROM rk QUALIFY band = max(band) OVER (PARTITION BY src_ip)))
 SELECT src_ip, dst_ip, predicate, {r('score', 'score')} FROM st WHERE n <= CASE WHEN band > 0 THEN 12 ELSE 6 END"""
)
def egress_detected(spark, sf_dir):
    return rounded(egress.detect(A.flows(spark, sf_dir), _CAPPED).select("src_ip", "dst_ip", "predicate", "score"))


_REPORTED = replace(C._HOST, threshold=0.15, lineage_threshold=0.3, max_per_host=2, max_findings=30)


@query(
    f"""WITH {C._EDGES}, {C._PRESENCE}, {C._RARE}, {C._LINEAGE}, rr AS (SELECT host, image_name, score FROM rp WHERE score >= 0.15), lr AS (SELECT host, parent_name, image_name, score FROM ls WHERE score >= 0.3 AND NOT EXISTS (SELECT 1 FROM rr WHERE rr.host = ls.host AND rr.image_name = ls.image_name)),
 r2 AS (SELECT 'rare' AS claim, host, NULL::VARCHAR AS parent_name, image_name, score FROM rr QUALIFY row_number() OVER (PARTITION BY host ORDER BY score DESC, host, image_name) <= 2), l2 AS (SELECT 'lineage' AS claim, * FROM lr QUALIFY row_number() OVER (PARTITION BY host ORDER BY score DESC, host, parent_name, image_name) <= 2),
 cp AS (SELECT *, row_number() OVER (PARTITION BY claim ORDER BY score DESC, host, parent_name, image_name) AS n FROM (SELECT * FROM r2 UNION ALL SELECT * FROM l2))
 SELECT claim, host, parent_name, image_name, {r('score', 'score')} FROM cp WHERE n <= 30"""
)
def host_detected(spark, sf_dir):
    found = host.detect(A.executions(spark, sf_dir), _REPORTED)
    columns = ["claim", "host", "parent_name", "image_name", "score"]
    shaped = [df.withColumn("claim", F.lit(c)).withColumn("parent_name", F.col("parent_name") if c == "lineage" else F.lit(None).cast("string")).select(*columns) for df, c in zip(found, ("rare", "lineage"), strict=True)]
    return rounded(shaped[0].unionByName(shaped[1]))


# --- samples and places


@query(f"SELECT src_ip, source_line FROM (SELECT src_ip, source_line, row_number() OVER (PARTITION BY src_ip ORDER BY ts, source_file, source_line) - 1 AS n, count(*) OVER (PARTITION BY src_ip) AS c FROM ({A.CONTACTS})) WHERE n IN (round_even(0 * (c - 1) / 4.0, 0), round_even((c - 1) / 4.0, 0), round_even(2 * (c - 1) / 4.0, 0), round_even(3 * (c - 1) / 4.0, 0), c - 1)")
def evenly_spaced(spark, sf_dir):
    return common.evenly_spaced(A.contacts(spark, sf_dir), "src_ip", 5).select("src_ip", "source_line")


@query(f"WITH {C._GROUPED}, st AS (SELECT grp, predicate, max(confidence) AS c FROM mb GROUP BY 1, 2), sc AS (SELECT grp, round((1 - exp(sum(ln(1 - c)))) * least(1 + 0.5 * greatest(count(*) FILTER (predicate NOT IN ({C._NONCORR})) - 1, 0), 2.5), 9) AS p FROM st GROUP BY 1) SELECT grp AS subject, rank() OVER (ORDER BY p DESC) AS place FROM sc QUALIFY count(*) OVER (PARTITION BY p) = 1")
def queue_places(spark, sf_dir):
    """Places of the incidents whose priority no other has; ties are broken by severity and content id."""
    ranked = correlate.queue(C._found(spark, sf_dir), nested=False).select(F.col("subject.value").alias("subject"), F.round("priority", 9).alias("p"), F.col("place").cast("bigint").alias("place"))
    alone = ranked.groupBy("p").agg(F.count("*").alias("n")).where("n = 1")
    return ranked.join(alone, "p", "left_semi").select("subject", "place")


# --- readers, over files written from the driver's tables


def _put(spark: SparkSession, path: str, lines: list[str]) -> None:
    """Write a text file where the executors can read it."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    if ":" in target.getName() or not path.startswith(("/", "file:")):
        raise ValueError(f"{path} has to be written by hand")
    out = target.getFileSystem(conf).create(target)
    out.write(bytearray("".join(x + "\n" for x in lines).encode()))
    out.close()


def _utc(between: str) -> Column:
    """The second of ts as a UTC date and time, whatever the session's time zone."""
    part = lambda unit, n: F.lpad(F.pmod(F.floor(F.floor("ts") / unit), F.lit(n)).cast("string"), 2, "0")
    return F.concat(X.day_of(F.col("ts")).cast("string"), F.lit(between), F.concat_ws(":", part(3600, 24), part(60, 60), part(1, 60)))


def _head(names: Iterable[str]) -> list[str]:
    """The first lines of a Zeek log with these columns."""
    return ["#separator \\x09", "#path\tx", "#fields\t" + "\t".join(names)]


_CONN = {"ts": "ts", "id.orig_h": "src_ip", "id.resp_h": "dst_ip", "id.resp_p": "dst_port", "orig_bytes": "orig_bytes"}


@query(f"SELECT {r('ts', 'ts', 6)}, src_ip, dst_ip, dst_port, orig_bytes, n + CASE k WHEN 2 THEN 0 ELSE 3 END AS source_line FROM (SELECT *, source_line % 3 AS k, row_number() OVER (PARTITION BY source_line % 3 ORDER BY source_line) AS n FROM ({A.CONTACTS}))")
def zeek_conn(spark, sf_dir):
    """A plain log, one in a folder below and one in JSON lines."""
    rows = A.contacts(spark, sf_dir).sort("source_line")
    out = shared_dir(spark, "zeek")
    part = [rows.where(F.col("source_line") % 3 == k) for k in range(3)]
    sinks.write_lines(sinks.zeek_lines(part[0], _CONN.values()), f"{out}/conn.log", _head(_CONN))
    sinks.write_lines(sinks.zeek_lines(part[1], _CONN.values()), f"{out}/rotated/conn.14h.log", _head(_CONN))
    sinks.write_lines(part[2].select(F.to_json(F.struct(*[F.col(c).alias(k) for k, c in _CONN.items()])).alias("value")), f"{out}/conn.json.log")
    return rounded(zeek.load_connections(spark, out).select("ts", "src_ip", "dst_ip", "dst_port", "orig_bytes", "source_line"), 6)


@query(f"SELECT {r('ts', 'ts', 6)}, src_ip, query, qtype, rcode, answers, row_number() OVER (ORDER BY source_line) AS source_line FROM (SELECT *, CASE WHEN source_line % 2 = 0 THEN '10.0.0.' || source_line % 5 || ';10.0.1.1' END AS answers FROM ({A.LOOKUPS}))")
def zeek_dns(spark, sf_dir):
    rows = A.lookups(spark, sf_dir).orderBy("source_line").collect()
    out = shared_dir(spark, "zeek")
    made = [{"ts": x.ts, "id.orig_h": x.src_ip, "query": x.query, "qtype": 1, "qtype_name": x.qtype, "rcode_name": x.rcode, "answers": [f"10.0.0.{x.source_line % 5}", "10.0.1.1"] if x.source_line % 2 == 0 else None} for x in rows]
    _put(spark, f"{out}/dns.log", [json.dumps(x) for x in made])
    return rounded(zeek.load_dns(spark, out).select("ts", "src_ip", "query", "qtype", "rcode", "answers", "source_line"), 6)


@query(f"SELECT {r('ts', 'ts', 6)}, src_ip, dst_ip, ja3, CASE source_line % 3 WHEN 0 THEN true WHEN 1 THEN false END AS established FROM ({A.SESSIONS})")
def zeek_ssl(spark, sf_dir):
    k = F.col("source_line") % 3
    rows = A.sessions(spark, sf_dir).sort("source_line").withColumn("established", F.when(k == 0, True).when(k == 1, False))
    out = shared_dir(spark, "zeek")
    names = {"ts": "ts", "id.orig_h": "src_ip", "id.resp_h": "dst_ip", "ja3": "ja3", "established": "established"}
    sinks.write_lines(sinks.zeek_lines(rows, names.values()), f"{out}/ssl.log", _head(names))
    return rounded(zeek.load_ssl(spark, out).select("ts", "src_ip", "dst_ip", "ja3", "established"), 6)


_REPLY = "port_out >= 32768 AND port_in < port_out"
_FLOWN = f"SELECT *, floor(ts)::BIGINT AS second, CASE WHEN source_line % 4 = 0 THEN 443 ELSE 40000 + source_line % 100 END AS port_in, CASE WHEN source_line % 4 = 0 THEN 50000 + source_line % 100 ELSE dst_port END AS port_out FROM ({A.CONTACTS})"


@query(f"SELECT second::DOUBLE AS ts, src_ip, port_in::INT AS src_port, dst_ip, port_out::INT AS dst_port, orig_bytes, CASE source_line % 3 WHEN 0 THEN 'botnet' WHEN 1 THEN 'normal' ELSE 'background' END AS label FROM ({_FLOWN}) WHERE NOT coalesce({_REPLY}, false)")
def netflow_rows(spark, sf_dir):
    """Labels are normalised and answering halves of conversations left out."""
    labels = F.array(*[F.lit(x) for x in ("flow=From-Botnet-V42-TCP", "From-Normal-V42", "Background-UDP")])
    k, text = F.col("source_line"), lambda c: c.cast("string")
    served = k % 4 == 0
    near = F.concat("src_ip", F.lit(":"), text(F.when(served, F.lit(443)).otherwise(40_000 + k % 100)))
    far = F.concat_ws(":", "dst_ip", text(F.when(served, 50_000 + k % 100).otherwise(F.col("dst_port"))))
    said = [F.concat(_utc(" "), F.lit(".000")), F.lit("0.5"), F.lit("TCP"), near, F.lit("->"), far, F.lit("S_"), F.lit("0"), F.lit("1"), F.coalesce(text(F.col("orig_bytes")), F.lit("")), F.lit("1"), F.element_at(labels, (k % 3 + 1).cast("int"))]
    out = shared_dir(spark, "netflow")
    sinks.write_lines(A.contacts(spark, sf_dir).sort("source_line").select(F.concat_ws("\t", *said).alias("value")), f"{out}/capture", ["Date flow start\tDurat\tProt\tSrc"])
    return netflow.load_netflow(spark, out).select("ts", "src_ip", "src_port", "dst_ip", "dst_port", "orig_bytes", "label")


@query(f"SELECT floor(ts)::BIGINT::DOUBLE AS ts, src_ip, dst_ip, signature, signature_id, category, severity, n + (n - 1) // 10 AS source_line FROM (SELECT *, row_number() OVER (ORDER BY source_line) AS n FROM ({A.ALERTS}))")
def eve_alerts(spark, sf_dir):
    """Every eleventh line is cut short and costs no other."""
    rows = common.numbered(A.sensor_alerts(spark, sf_dir), "n", "source_line")
    alert = F.struct("signature", "signature_id", "category", "severity").alias("alert")
    body = F.to_json(F.struct(F.concat(_utc("T"), F.lit("+0000")).alias("timestamp"), F.lit("alert").alias("event_type"), "src_ip", F.col("dst_ip").alias("dest_ip"), alert))
    cut = F.lit('{"timestamp": "2024-01-01T00:00:00Z", "event_type": "alert", "alert": {"sig\n')
    lines = rows.sort("n").select(F.when((F.col("n") > 1) & (F.col("n") % 10 == 1), F.concat(cut, body)).otherwise(body).alias("value"))
    out = shared_dir(spark, "eve")
    sinks.write_lines(lines, f"{out}/eve.json")
    return suricata.load_alerts(spark, out).select("ts", "src_ip", "dst_ip", "signature", "signature_id", "category", "severity", "source_line")


@query(f"SELECT {r('ts + 100', 'ts', 6)}, src_ip, rtrim(query, '.') AS query, qtype, '10.0.0.1' AS answers, source_line + 1 AS source_line FROM (SELECT * EXCLUDE source_line, row_number() OVER (ORDER BY source_line) AS source_line FROM ({A.LOOKUPS}))")
def passive_dns(spark, sf_dir):
    rows = A.lookups(spark, sf_dir).orderBy("source_line").collect()
    out = shared_dir(spark, "passivedns")
    _put(spark, f"{out}/x.passivedns", ["[*] banner", *[f"{x.ts!r}||{x.src_ip}||8.8.8.8||IN||{x.query}||{x.qtype}||10.0.0.1||60||1" for x in rows]])
    return rounded(passivedns.load_passivedns(spark, out, capture_start=100.0).select("ts", "src_ip", "query", "qtype", "answers", "source_line"), 6)


@query(r"SELECT (1700000000 + c_custkey)::DOUBLE AS ts, 'h' || c_nationkey AS host, 'C:\Windows\P' || c_custkey % 50 || '.exe' AS image, 'g' || c_custkey AS process_guid, CASE WHEN c_custkey % 3 <> 0 THEN lpad(c_custkey::VARCHAR, 64, 'a') END AS sha256 FROM customer WHERE c_custkey % 4 <> 3")
def sysmon_rows(spark, sf_dir):
    """Events of other kinds fall out; the digest is taken from a list of several."""
    lines = []
    for x in A.read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").orderBy("c_custkey").collect():
        when = datetime.fromtimestamp(1_700_000_000 + x.c_custkey, timezone.utc).strftime("%Y-%m-%d %H:%M:%S.000")
        body = {"EventID": 3 if x.c_custkey % 4 == 3 else 1, "SourceName": "Microsoft-Windows-Sysmon", "UtcTime": when, "Hostname": f"h{x.c_nationkey}", "Image": f"C:\\Windows\\P{x.c_custkey % 50}.exe", "ProcessGuid": f"g{x.c_custkey}"}
        lines.append(json.dumps(body | ({"Hashes": f"MD5=0,SHA256={str(x.c_custkey).rjust(64, 'a')},IMPHASH=1"} if x.c_custkey % 3 else {})))
    out = shared_dir(spark, "sysmon")
    _put(spark, f"{out}/sysmon.json", lines)
    return sysmon.load_processes(spark, out).select("ts", "host", "image", "process_guid", "sha256")


# --- side tables

_V6 = "'2001:db8:' || format('{:x}', c_nationkey) || ':' || format('{:x}', c_custkey % 65536) || CASE WHEN c_custkey % 2 = 0 THEN '::' ELSE ':0:0:0:' END || format('{:x}', c_custkey % 7)"
_V6_NETS = ("2001:db8::/32", "2001:db8:3::/48", "2001:db8:4::/47", "2001:db8:7:8000::/49", "2001:db8:9::1/128", "10.0.0.0/8")


@query(
    f"""SELECT address, CASE WHEN a = 9 AND b = 0 AND c = 1 THEN '2001:db8:9::1/128' WHEN a = 7 AND b >= 32768 THEN '2001:db8:7:8000::/49' WHEN a = 3 THEN '2001:db8:3::/48' WHEN a IN (4, 5) THEN '2001:db8:4::/47' ELSE '2001:db8::/32' END AS network
 FROM (SELECT DISTINCT {_V6} AS address, c_nationkey AS a, c_custkey % 65536 AS b, c_custkey % 7 AS c FROM customer)"""
)
def cidr_match_v6(spark, sf_dir):
    k = F.col("c_custkey")
    hexed = lambda c: F.lower(F.hex(c))
    address = F.concat(F.lit("2001:db8:"), hexed(F.col("c_nationkey")), F.lit(":"), hexed(k % 65536), F.when(k % 2 == 0, "::").otherwise(":0:0:0:"), hexed(k % 7))
    rows = A.read(spark, sf_dir, "customer").select(address.alias("address"))
    return ioc.match_networks(rows, spark.createDataFrame([(x,) for x in _V6_NETS], "value string"))


@query("SELECT address, hostname, stated FROM (SELECT *, row_number() OVER (PARTITION BY address ORDER BY stated DESC NULLS LAST, source_file, source_line) AS n FROM (SELECT (c_custkey % 97)::VARCHAR AS address, 'h' || c_custkey AS hostname, CASE WHEN c_custkey % 5 <> 0 THEN DATE '2022-01-01' + (c_custkey * 31 % 40)::INT END AS stated, 'f' || c_nationkey AS source_file, c_custkey AS source_line FROM customer)) WHERE n = 1")
def inventory_resolved(spark, sf_dir):
    k = F.col("c_custkey")
    stated = F.when(k % 5 != 0, F.date_add(F.lit("2022-01-01").cast("date"), (k * 31 % 40).cast("int")))
    rows = A.read(spark, sf_dir, "customer").select((k % 97).cast("string").alias("address"), F.concat(F.lit("h"), k.cast("string")).alias("hostname"), stated.alias("stated"), F.concat(F.lit("f"), F.col("c_nationkey").cast("string")).alias("source_file"), k.alias("source_line"))
    return inv.resolved(rows).select("address", "hostname", "stated")


@query("SELECT kind, value, source_line FROM (SELECT *, row_number() OVER (PARTITION BY kind, value ORDER BY coalesce(confidence, declared, -1) DESC, added DESC NULLS LAST, source_file, source_line) AS n FROM (SELECT CASE WHEN c_custkey % 2 = 0 THEN 'ip' ELSE 'domain' END AS kind, 'v' || c_custkey % 53 AS value, CASE WHEN c_custkey % 3 <> 0 THEN (c_custkey % 4)::DOUBLE / 4 END AS confidence, CASE WHEN c_custkey % 7 <> 0 THEN 0.5::DOUBLE END AS declared, CASE WHEN c_custkey % 11 <> 0 THEN DATE '2023-01-01' + (c_custkey * 13 % 30)::INT END AS added, 'f' || c_nationkey AS source_file, c_custkey AS source_line FROM customer)) WHERE n = 1")
def indicators_resolved(spark, sf_dir):
    k = F.col("c_custkey")
    rows = A.read(spark, sf_dir, "customer").select(
        F.when(k % 2 == 0, "ip").otherwise("domain").alias("kind"), F.concat(F.lit("v"), (k % 53).cast("string")).alias("value"), F.when(k % 3 != 0, (k % 4).cast("double") / 4).alias("confidence"),
        F.struct(F.when(k % 7 != 0, F.lit(0.5)).alias("declared_confidence")).alias("feed"), F.when(k % 11 != 0, F.date_add(F.lit("2023-01-01").cast("date"), (k * 13 % 30).cast("int"))).alias("added"),
        F.concat(F.lit("f"), F.col("c_nationkey").cast("string")).alias("source_file"), k.alias("source_line"),
    )
    return ioc.best_of(rows).select("kind", "value", "source_line")


@query(f"SELECT {r('min(ts)', 'first_ts', 6)}, {r('max(ts)', 'last_ts', 6)}, strftime(DATE '1970-01-01' + floor(min(ts) / 86400)::INT, '%Y-%m-%d') AS capture_start FROM (SELECT ts FROM ({A.CONTACTS}) UNION ALL SELECT ts FROM ({A.ALERTS}) UNION ALL SELECT ts FROM ({A.LOOKUPS}))")
def capture_window(spark, sf_dir):
    window = inv.capture_window(A.contacts(spark, sf_dir), A.sensor_alerts(spark, sf_dir), A.lookups(spark, sf_dir))
    return rounded(window.withColumn("capture_start", F.col("capture_start").cast("string")), 6)


# --- indicators over all sources

_ANSWERED = f"SELECT *, '203.0.' || source_line % 3 || '.' || source_line % 41 || CASE WHEN source_line % 4 = 0 THEN '; 198.51.100.' || source_line % 9 ELSE '' END AS answers FROM ({A.LOOKUPS})"


def _answered(spark, sf_dir) -> DataFrame:
    n = F.col("source_line")
    more = F.when(n % 4 == 0, F.concat(F.lit("; 198.51.100."), (n % 9).cast("string"))).otherwise("")
    return A.lookups(spark, sf_dir).withColumn("answers", F.concat(F.lit("203.0."), (n % 3).cast("string"), F.lit("."), (n % 41).cast("string"), more))


def _fold(source: str, value: str, peer: str, role: str, is_name: str = "false") -> str:
    return f"SELECT {value} AS value, {is_name} AS is_name, count(*) AS events, count(DISTINCT {peer}) + max(({peer} IS NULL)::INT) AS peers, min(ts) AS first_ts, max(ts) AS last_ts, '{role}' AS role FROM ({source}) WHERE {value} IS NOT NULL AND {value} <> '' AND ts IS NOT NULL GROUP BY 1"


_OBSERVED = " UNION ALL ".join(
    [
        *[_fold(s, "dst_ip", "src_ip", "destination") for s in (A.CONTACTS, A.ALERTS)],
        *[_fold(s, "src_ip", "dst_ip", "source") for s in (A.CONTACTS, A.ALERTS)],
        _fold(f"SELECT *, unnest(string_split(answers, ';')) AS answer FROM ({_ANSWERED})", "trim(answer)", "src_ip", "answer"),
        _fold(_ANSWERED, C._Q, "src_ip", "query", "true"),
    ]
)


@query(f"SELECT value, is_name, sum(events)::BIGINT AS events, max(peers)::BIGINT AS peers, {r('min(first_ts)', 'first_ts', 6)}, {r('max(last_ts)', 'last_ts', 6)}, array_to_string(list_sort(list_distinct(list(role))), ',') AS roles FROM ({_OBSERVED}) GROUP BY 1, 2")
def intel_observations(spark, sf_dir):
    seen = intel.observations(A.contacts(spark, sf_dir), A.sensor_alerts(spark, sf_dir), _answered(spark, sf_dir))
    return rounded(seen.withColumn("roles", F.array_join("roles", ",")).withColumn("peers", F.col("peers").cast("bigint")), 6)


@query(
    f"""WITH nm AS (SELECT DISTINCT {C._Q} AS name, trim(unnest(string_split(answers, ';'))) AS address FROM ({_ANSWERED}) WHERE {C._Q} <> ''), br AS (SELECT address, count(*) AS breadth FROM nm GROUP BY 1 HAVING count(*) BETWEEN 2 AND 5)
 SELECT address, name, breadth FROM nm JOIN br USING (address)"""
)
def shared_answers(spark, sf_dir):
    return intel.shared_answers(_answered(spark, sf_dir)).select("address", "name", "breadth")


_FLAGGED = f"fa AS (SELECT DISTINCT address, 'feed' || split_part(address, '.', 4)::INT % 2 AS ai FROM nm WHERE split_part(address, '.', 4)::INT % 5 = 0), fn AS (SELECT DISTINCT name, 'zone' || left(name, 1) AS ni FROM nm WHERE name < '4')"


@query(
    f"""WITH nm AS (SELECT DISTINCT {C._Q} AS name, trim(unnest(string_split(answers, ';'))) AS address FROM ({_ANSWERED}) WHERE {C._Q} <> ''), br AS (SELECT address, count(*) AS breadth FROM nm GROUP BY 1 HAVING count(*) BETWEEN 2 AND 5), {_FLAGGED},
 mk AS (SELECT address, name, least(0.95::DOUBLE, 2.0 / breadth) AS score, ni, ai FROM nm JOIN br USING (address) LEFT JOIN fn USING (name) LEFT JOIN fa USING (address)),
 an AS (SELECT address, ni AS anchor_indicator, min(name) AS anchor FROM mk WHERE ai IS NULL AND ni IS NOT NULL GROUP BY 1, 2),
 bl AS (SELECT address, ai, regexp_extract(address, '^(.*)[.]', 1) AS block FROM fa),
 al AS (SELECT address AS u, name AS v, 'shared_resolution' AS link, address AS via, ai AS anchor_indicator, score FROM mk WHERE ai IS NOT NULL AND ni IS DISTINCT FROM ai
  UNION ALL SELECT anchor, name, 'shared_resolution', address, anchor_indicator, score FROM mk JOIN an USING (address) WHERE ai IS NULL AND ni IS DISTINCT FROM anchor_indicator AND name <> anchor
  UNION ALL SELECT x.address, y.address, 'shared_netblock', x.block || '.0/24', x.ai, 0.5::DOUBLE FROM bl x JOIN bl y ON x.block = y.block AND x.address < y.address AND x.ai <> y.ai),
 ch AS (SELECT * FROM al QUALIFY row_number() OVER (PARTITION BY least(u, v), greatest(u, v) ORDER BY via, anchor_indicator, u) = 1)
 SELECT u, v, link, via, anchor_indicator, {r('score', 'score')} FROM (SELECT * FROM ch ORDER BY score DESC, u, v LIMIT 50)"""
)
def intel_links(spark, sf_dir):
    """Shared answers and netblocks between flagged and other infrastructure, at most fifty."""
    dns = _answered(spark, sf_dir)
    names = dns.select(F.lower(F.btrim("query", F.lit("."))).alias("name"), F.explode(F.split("answers", ";")).alias("a")).select("name", F.trim("a").alias("address"))
    last = F.substring_index("address", ".", -1).try_cast("int")
    addresses = names.where(last % 5 == 0).select(F.col("address").alias("value"), F.concat(F.lit("feed"), (last % 2).cast("string")).alias("indicator"), F.lit(False).alias("is_name"))
    zones = names.where("name < '4'").select(F.col("name").alias("value"), F.concat(F.lit("zone"), F.substring("name", 1, 1)).alias("indicator"), F.lit(True).alias("is_name"))
    return rounded(intel.links(dns, addresses.union(zones).distinct()).select("u", "v", "link", "via", "anchor_indicator", "score"))


# --- labels


@query("WITH f AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'), t AS (SELECT DISTINCT c_custkey AS k FROM customer WHERE c_custkey % 3 <> 0) SELECT count(*) FILTER (f.k IS NOT NULL AND t.k IS NOT NULL) AS tp, count(*) FILTER (t.k IS NULL) AS fp, count(*) FILTER (f.k IS NULL) AS fn FROM f FULL JOIN t USING (k)")
def label_score(spark, sf_dir):
    found = A.read(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k"))
    truth = A.read(spark, sf_dir, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("k"))
    s = evaluate.compare(found, truth, ["k"])
    return spark.createDataFrame([(s.tp, s.fp, s.fn)], "tp bigint, fp bigint, fn bigint")


@query("SELECT c_custkey, c_comment_ AS text, CASE WHEN c_custkey % 3 = 0 THEN c_comment_ ELSE left(c_comment_, 5) || '…' END AS excerpt FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN left(c_name, 6) ELSE c_name END AS c_comment_ FROM customer)")
def excerpts(spark, sf_dir):
    text = F.when(F.col("c_custkey") % 3 == 0, F.substring("c_name", 1, 6)).otherwise(F.col("c_name"))
    return A.read(spark, sf_dir, "customer").select("c_custkey", text.alias("text"), common.excerpt_text(text, 6).alias("excerpt"))


# --- streams


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contacts as a stream over a folder of several files."""
    out = shared_dir(spark, "stream")
    schemas.conform(A.contacts(spark, sf_dir), schemas.CONNECTIONS).repartition(3).write.parquet(out)
    spark.conf.set("spark.sql.streaming.forceDeleteTempCheckpointLocation", "true")
    return windows.stream_table(spark, out, schemas.CONNECTIONS, per_trigger=2)


@query(f"SELECT src_ip, dst_ip, dst_port, (floor(ts / 3600) * 3600)::BIGINT AS hour, count(*) AS n, sum(orig_bytes)::BIGINT AS bytes FROM ({A.CONTACTS}) GROUP BY ALL")
def stream_windows(spark, sf_dir):
    table = windows.run_to_memory(windows.pair_partials(_stream(spark, sf_dir)), "stream_windows")
    return table.select("src_ip", "dst_ip", "dst_port", F.unix_seconds("window.start").alias("hour"), "n", "bytes")


@query(f"SELECT src_ip, dst_ip, dst_port, n, {r('first_ts', 'first_ts', 6)}, {r('last_ts', 'last_ts', 6)} FROM ({C._SUMMARY})")
def stream_merged(spark, sf_dir):
    """Partial sums by window add up to the batch's first pass."""
    return rounded(windows.merged(windows.run_to_memory(windows.pair_partials(_stream(spark, sf_dir)), "stream_merged")).select("src_ip", "dst_ip", "dst_port", "n", "first_ts", "last_ts"), 6)


@query(f"SELECT src_ip, dst_ip, dst_port, count(*) AS records, {r('min(ts)', 'ts', 6)}, sum(orig_bytes)::BIGINT AS orig_bytes FROM (SELECT *, sum(new) OVER (PARTITION BY src_ip, dst_ip, dst_port ORDER BY ts, source_line ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY src_ip, dst_ip, dst_port ORDER BY ts, source_line) <= 600 THEN 0 ELSE 1 END AS new FROM ({A.CONTACTS}))) GROUP BY src_ip, dst_ip, dst_port, s")
def session_bursts(spark, sf_dir):
    rows = windows.with_event_time(A.contacts(spark, sf_dir))
    return rounded(windows.bursts(rows, "600 seconds").select("src_ip", "dst_ip", "dst_port", "records", "ts", "orig_bytes"), 6)


@query(f"SELECT category, {C._WEIGHT} AS weight FROM (SELECT DISTINCT p_type AS category FROM (SELECT unnest([{', '.join(repr(k) for k, _ in X.CATEGORY_WEIGHTS)}, 'nothing of these']) || ' ' || p_size % 2 AS p_type FROM part))")
def category_weights(spark, sf_dir):
    kinds = F.explode(F.array(*[F.lit(k) for k, _ in X.CATEGORY_WEIGHTS], F.lit("nothing of these")))
    rows = A.read(spark, sf_dir, "part").select(kinds.alias("k"), (F.col("p_size") % 2).cast("string").alias("s")).distinct()
    return rows.select(F.concat_ws(" ", "k", "s").alias("category")).withColumn("weight", X.category_weight(F.col("category")))
