"""The engine's queries over the driver's tables, each beside its DuckDB form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tamarack import adapters as A
from tamarack import lexicon, schemas
from tamarack.functions import exprs as X
from tamarack.operators import alerts, beaconing, common, dnstunnel, egress, fanout, host, intel, tlsdga
from tamarack.operators import kernels as K
from tamarack.plans import correlate
from tamarack.runtime import materialize
from tamarack.side import indicators as ioc
from tamarack.side import inventory as inv

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    """Register a function as a query under its name, with its oracle."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """All doubles rounded, and minus zero made zero."""
    return df.select(*[(F.round(F.col(c), digits) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def r(expr: str, name: str, digits: int = 4) -> str:
    return f"round({expr}, {digits}) + 0.0 AS {name}"


def wgm(parts: dict[str, float]) -> str:
    top = " + ".join(f"(CASE WHEN {c} IS NOT NULL THEN {w}::DOUBLE * ln(greatest({c}, 0.01::DOUBLE)) ELSE 0 END)" for c, w in parts.items())
    low = " + ".join(f"(CASE WHEN {c} IS NOT NULL THEN {w}::DOUBLE ELSE 0 END)" for c, w in parts.items())
    return f"(CASE WHEN {low} > 0 THEN least(1.0::DOUBLE, greatest(0.0::DOUBLE, exp(({top}) / ({low})))) ELSE 0 END)"


def sat(x: str, target: float) -> str:
    return f"(1 - exp(-greatest(({x})::DOUBLE, 0) / {target}::DOUBLE))"


def clip(x: str) -> str:
    return f"least(1.0::DOUBLE, greatest(0.0::DOUBLE, ({x})::DOUBLE))"


def rare(x: str) -> str:
    return f"(1 / sqrt(greatest({x}, 1)::DOUBLE))"


# --- schemas and scalar functions


@query("SELECT event_id::DOUBLE AS ts, NULL::VARCHAR AS uid, event_type AS src_ip, TRY_CAST(event_type AS INT) AS src_port, TRY_CAST(user_id AS INT) AS dst_port FROM events")
def conform_events(spark, sf_dir):
    schema = schemas.struct("ts DOUBLE, uid STRING, src_ip STRING, src_port INT, dst_port INT")
    raw = A.read(spark, sf_dir, "events").select(F.col("event_id").alias("ts"), F.col("event_type").alias("src_ip"), F.col("event_type").alias("src_port"), F.col("user_id").alias("dst_port"), F.col("props").alias("extra"))
    return schemas.conform(raw, schema)


_LABELS = "list_filter(string_split(lower(trim({q}, '.')), '.'), lambda x: x <> '')"
_SUFFIXES = ", ".join(f"'{x}'" for x in X.MULTIPART_SUFFIXES)


def zone_sql(q: str) -> str:
    """registered_domain in DuckDB, over a column or simple expression."""
    labels = _LABELS.format(q=q)
    tail = lambda k: f"array_to_string(list_slice({labels}, greatest(len({labels}) - {k - 1}, 1), len({labels})), '.')"
    return f"(CASE WHEN len({labels}) > 2 AND {tail(2)} IN ({_SUFFIXES}) THEN {tail(3)} ELSE {tail(2)} END)"


@query(f"SELECT page_id, host, {zone_sql('host')} AS zone, replace(CASE WHEN ends_with(lower(trim(host, '.')), {zone_sql('host')}) THEN left(lower(trim(host, '.')), len(lower(trim(host, '.'))) - len({zone_sql('host')})) ELSE lower(trim(host, '.')) END, '.', '') AS sub FROM (SELECT page_id, regexp_extract(url, 'https?://([^/]+)', 1) || CASE page_id % 3 WHEN 0 THEN '.co.uk.' WHEN 1 THEN '..' ELSE '' END AS host FROM pages)")
def registered_domain(spark, sf_dir):
    tail = F.when(F.col("page_id") % 3 == 0, ".co.uk.").when(F.col("page_id") % 3 == 1, "..").otherwise("")
    rows = A.read(spark, sf_dir, "pages").select("page_id", F.concat(F.regexp_extract("url", "https?://([^/]+)", 1), tail).alias("host")).withColumn("zone", X.registered_domain(F.col("host")))
    return rows.withColumn("sub", X.subdomain(F.col("host"), F.col("zone")))


@query("WITH c AS (SELECT page_id, ch, count(*)::DOUBLE AS c FROM (SELECT page_id, unnest(string_split(url, '')) AS ch FROM pages) GROUP BY ALL), n AS (SELECT page_id, sum(c) AS n FROM c GROUP BY 1) SELECT page_id, " + r("-sum(c / n * log2(c / n))", "bits") + " FROM c JOIN n USING (page_id) GROUP BY page_id")
def shannon_entropy(spark, sf_dir):
    return rounded(A.read(spark, sf_dir, "pages").select("page_id", X.entropy_bits(F.col("url")).alias("bits")))


@query(r"SELECT DISTINCT image, nullif(lower(trim(regexp_extract(rtrim(replace(image, '/', '\'), '\'), '([^\\]+)$', 1))), '') AS name, CASE WHEN contains(lower(replace(image, '/', '\')), '\users\') OR contains(lower(replace(image, '/', '\')), '\appdata\') THEN 1.0::DOUBLE WHEN contains(lower(replace(image, '/', '\')), '\windows\system32\') THEN 0.15::DOUBLE ELSE 0.55::DOUBLE END AS anomaly FROM (" + A.EXECUTIONS + ")")
def image_paths(spark, sf_dir):
    return A.executions(spark, sf_dir).select("image").distinct().select("image", X.image_name(F.col("image")).alias("name"), X.path_anomaly(F.col("image")).alias("anomaly"))


@query("SELECT p_partkey, label, coalesce(list_max(list_transform(regexp_extract_all(label, '[b-df-hj-np-tv-z]+'), lambda x: len(x))), 0)::INT AS run, " + r("len(regexp_replace(label, '[^0-9]', '', 'g'))::DOUBLE / len(label)", "digits") + " FROM (SELECT p_partkey, lower(replace(p_brand || p_name, ' ', '')) AS label FROM part)")
def label_structure(spark, sf_dir):
    rows = A.read(spark, sf_dir, "part").select("p_partkey", F.lower(F.replace(F.concat("p_brand", "p_name"), F.lit(" "), F.lit(""))).alias("label"))
    return rounded(rows.select("p_partkey", "label", X.consonant_run(F.col("label")).alias("run"), X.digit_ratio(F.col("label")).cast("double").alias("digits")))


@query("SELECT c_custkey, 'art_' || left(sha256('{\"locator\":' || to_json(c_name)::VARCHAR || ',\"n\":null,\"source\":' || to_json(c_mktsegment)::VARCHAR || '}'), 16) AS id FROM customer")
def content_ids(spark, sf_dir):
    return A.read(spark, sf_dir, "customer").select("c_custkey", X.content_id("art", {"source": F.col("c_mktsegment"), "locator": F.col("c_name"), "n": F.lit(None).cast("string")}).alias("id"))


# --- beaconing

_SUMMARY = f"SELECT src_ip, dst_ip, dst_port, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM ({A.CONTACTS}) GROUP BY ALL"


@query(f"SELECT src_ip, dst_ip, dst_port, n, {r('first_ts', 'first_ts')}, {r('last_ts', 'last_ts')} FROM ({_SUMMARY})")
def pair_summary(spark, sf_dir):
    return rounded(beaconing.summary(A.contacts(spark, sf_dir)))


@query(f"SELECT dst_ip, count(DISTINCT src_ip) AS contacting_hosts FROM ({_SUMMARY}) GROUP BY 1")
def dst_prevalence(spark, sf_dir):
    return beaconing.prevalence(beaconing.summary(A.contacts(spark, sf_dir)))


_CANDIDATES = f"SELECT * FROM ({_SUMMARY}) WHERE n >= 24 AND last_ts - first_ts >= 3600 AND (dst_port IS NULL OR dst_port <> 123)"


@query(f"SELECT src_ip, dst_ip, dst_port, n FROM ({_CANDIDATES})")
def beacon_candidates(spark, sf_dir):
    return beaconing.candidates(beaconing.summary(A.contacts(spark, sf_dir))).select("src_ip", "dst_ip", "dst_port", "n")


@query(f"WITH c AS ({_CANDIDATES}) SELECT t.src_ip, t.dst_ip, t.dst_port, count(*) AS records, count(orig_bytes) AS measured FROM ({A.CONTACTS}) t WHERE EXISTS (SELECT 1 FROM c WHERE c.src_ip = t.src_ip AND c.dst_ip = t.dst_ip AND c.dst_port IS NOT DISTINCT FROM t.dst_port) GROUP BY ALL")
def nullsafe_semi(spark, sf_dir):
    rows = A.contacts(spark, sf_dir)
    kept = beaconing.candidate_events(rows, beaconing.candidates(beaconing.summary(rows)))
    return kept.groupBy("src_ip", "dst_ip", "dst_port").agg(F.count("*").alias("records"), F.count("orig_bytes").alias("measured"))


_GAPS = f"SELECT src_ip AS k, ts - lag(ts) OVER (PARTITION BY src_ip ORDER BY ts, source_line) AS gap, ts, orig_bytes, source_line FROM ({A.CONTACTS})"


def _spaced(spark, sf_dir):
    return K.gaps(A.contacts(spark, sf_dir).withColumn("k", F.col("src_ip")), "k", "ts", ["source_line"])


_DISPERSION = f"""WITH g AS ({_GAPS}), p AS (SELECT k, gap FROM g WHERE gap > 0), m AS (SELECT k, count(*) AS n, quantile_cont(gap, 0.5) AS med, quantile_cont(gap, 0.25) AS q25 FROM p GROUP BY k),
 d AS (SELECT k, quantile_cont(abs(gap - med), 0.5) AS mad FROM p JOIN m USING (k) GROUP BY k)"""


@query(_DISPERSION + f" SELECT k, n, {r('med', 'med')}, {r('mad', 'mad')}, {r('CASE WHEN abs(med) < 1e-12 THEN 1.0 ELSE mad / abs(med) END', 'cod')} FROM m JOIN d USING (k)")
def interval_dispersion(spark, sf_dir):
    return rounded(K.dispersion(_spaced(spark, sf_dir).where("gap > 0"), "k", "gap").select("k", "n", "med", "mad", "cod"))


@query(_DISPERSION + f" SELECT k, {r('CASE WHEN n < 4 THEN 0.0 WHEN med < 1e-12 THEN 1.0 ELSE greatest(0.0, (med - q25) / med) END', 'floor_dispersion')} FROM m")
def schedule_floor(spark, sf_dir):
    rows = K.dispersion(_spaced(spark, sf_dir).where("gap > 0"), "k", "gap")
    return rounded(rows.select("k", K.schedule_floor(F.col("n"), F.col("q25"), F.col("med")).alias("floor_dispersion")))


def otsu_sql(gaps: str) -> str:
    """CTEs from gaps (k, gap) to th (k, threshold)."""
    return f"""lg AS (SELECT k, log10(gap) AS lg FROM {gaps} WHERE gap > 0), rg AS (SELECT k, min(lg) AS lo, max(lg) AS hi, count(*) AS n FROM lg GROUP BY k HAVING count(*) >= 8 AND max(lg) - min(lg) >= 1),
 bn AS (SELECT k, lo, hi, n, least(63, floor((lg - lo) / (hi - lo) * 64))::INT AS bin, count(*) AS c FROM lg JOIN rg USING (k) GROUP BY ALL),
 ms AS (SELECT k, bin, lo + (bin + 0.5) * (hi - lo) / 64 AS centre, sum(c / n) OVER w AS below, sum(c / n * (lo + (bin + 0.5) * (hi - lo) / 64)) OVER w AS moment, sum(c / n * (lo + (bin + 0.5) * (hi - lo) / 64)) OVER (PARTITION BY k) AS total
   FROM bn WINDOW w AS (PARTITION BY k ORDER BY bin ROWS UNBOUNDED PRECEDING)),
 sp AS (SELECT k, arg_min(centre, (-round(pow(total * below - moment, 2) / greatest(below * (1 - below), 1e-12), 9), bin)) AS split FROM ms WHERE bin < 63 AND below > 0 AND below < 1 - 1e-12 GROUP BY k),
 sd AS (SELECT k, split, count(*) FILTER (lg <= split) AS nl, count(*) FILTER (lg > split) AS nh, avg(lg) FILTER (lg <= split) AS l, avg(lg) FILTER (lg > split) AS h FROM lg JOIN sp USING (k) GROUP BY ALL),
 th AS (SELECT k, pow(10.0, split) AS threshold FROM sd WHERE h - l >= 1 AND least(nl, nh)::DOUBLE / (nl + nh) >= 0.10)"""


_KEY = "src_ip || '|' || coalesce(dst_port::VARCHAR, '-')"
_BEACON_GAPS = f"gp AS (SELECT {_KEY} AS k, src_ip, dst_ip, dst_port, ts, orig_bytes, source_line, ts - lag(ts) OVER (PARTITION BY {_KEY} ORDER BY ts, source_file, source_line) AS gap FROM ({A.BEACONS}))"


def _beacon_spaced(spark, sf_dir):
    rows = A.beacons(spark, sf_dir).withColumn("k", F.concat_ws("|", "src_ip", F.coalesce(F.col("dst_port").cast("string"), F.lit("-"))))
    return materialize(K.gaps(rows, "k", "ts", ["source_file", "source_line"]), "gaps")


@query(f"WITH {_BEACON_GAPS}, {otsu_sql('gp')} SELECT k, {r('threshold', 'threshold')} FROM th")
def otsu_gap(spark, sf_dir):
    return rounded(K.gap_threshold(_beacon_spaced(spark, sf_dir), "k"))


_BURSTS = "br AS (SELECT k, min(ts) AS ts, sum(orig_bytes)::BIGINT AS orig_bytes, count(*) AS records FROM (SELECT *, sum(CASE WHEN gap IS NULL OR threshold IS NULL OR gap > threshold THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY ts, source_line ROWS UNBOUNDED PRECEDING) AS b FROM gp LEFT JOIN th USING (k)) GROUP BY k, b)"


@query(f"WITH {_BEACON_GAPS}, {otsu_sql('gp')}, {_BURSTS} SELECT k, {r('ts', 'ts')}, orig_bytes, records FROM br")
def burst_coalesce(spark, sf_dir):
    spaced = _beacon_spaced(spark, sf_dir)
    return rounded(K.coalesce_bursts(spaced, K.gap_threshold(spaced, "k"), "k", "ts", "orig_bytes", ["source_file", "source_line"]))


_TIMING = """iv AS (SELECT k, gap FROM (SELECT k, ts - lag(ts) OVER (PARTITION BY k ORDER BY ts, records) AS gap FROM br) WHERE gap > 0),
 im AS (SELECT k, count(*) AS n, quantile_cont(gap, 0.5) AS med, quantile_cont(gap, 0.25) AS q25 FROM iv GROUP BY k),
 tm AS (SELECT k, n, med, q25, quantile_cont(abs(gap - med), 0.5) AS mad FROM iv JOIN im USING (k) GROUP BY ALL)"""
_PERIODICITY = """us AS (SELECT k, med AS period, mad AS jitter, t0, span, c AS n, least(greatest(2.5 * mad, med / 4), med / 2) AS w0 FROM tm JOIN (SELECT k, min(ts) AS t0, max(ts) - min(ts) AS span, count(*) AS c FROM br GROUP BY k) USING (k) WHERE c >= 8 AND med > 0 AND span > 0 AND 2.5 * mad <= med / 2),
 uw AS (SELECT *, CASE WHEN floor(span / w0) + 1 > 200000 THEN span / 200000 ELSE w0 END AS width, CASE WHEN floor(span / w0) + 1 > 200000 THEN 200000 ELSE floor(span / w0) + 1 END AS bins FROM us),
 oc AS (SELECT k, least(bins - 1, floor((ts - t0) / width))::BIGINT AS bin, count(*)::DOUBLE AS c FROM br JOIN uw USING (k) WHERE width <= period / 2 GROUP BY ALL),
 bs AS (SELECT k, bins, n / bins AS mean, sum(c * c) - bins * (n / bins) * (n / bins) AS energy, greatest(1, round_even(period / width * 0.8, 0)::INT) AS first, least(round_even(period / width * 1.2, 0)::BIGINT, bins - 1)::INT AS last FROM oc JOIN uw USING (k) GROUP BY k, bins, n, period, width HAVING sum(c * c) - bins * (n / bins) * (n / bins) >= 1e-12),
 lg2 AS (SELECT k, bins, mean, energy, unnest(range(first, last + 1)) AS lag FROM bs WHERE last >= first),
 ed AS (SELECT k, lag, bins, mean, energy, sum(CASE WHEN bin < bins - lag THEN c ELSE 0 END) AS head, sum(CASE WHEN bin >= lag THEN c ELSE 0 END) AS tail FROM oc JOIN lg2 USING (k) GROUP BY ALL),
 pr AS (SELECT a.k, l.lag, sum(a.c * b.c) AS product FROM oc a JOIN lg2 l ON a.k = l.k JOIN oc b ON b.k = a.k AND b.bin = a.bin + l.lag GROUP BY ALL),
 ac AS (SELECT k, least(1.0, greatest(0.0, max((coalesce(product, 0) - mean * head - mean * tail + (bins - lag) * mean * mean) / energy))) AS autocorrelation FROM ed LEFT JOIN pr USING (k, lag) GROUP BY k)"""
_BEACON_CTES = f"WITH {_BEACON_GAPS}, {otsu_sql('gp')}, {_BURSTS}, {_TIMING}, {_PERIODICITY}"


@query(f"{_BEACON_CTES} SELECT k, {r('autocorrelation', 'autocorrelation')} FROM ac")
def autocorr(spark, sf_dir):
    spaced = _beacon_spaced(spark, sf_dir)
    bursts = materialize(K.coalesce_bursts(spaced, K.gap_threshold(spaced, "k"), "k", "ts", "orig_bytes", ["source_file", "source_line"]), "bursts")
    timing = K.dispersion(K.gaps(bursts, "k", "ts", ["records"]).where("gap > 0"), "k", "gap")
    return rounded(K.periodicity(bursts, timing.select("k", F.col("med").alias("period"), F.col("mad").alias("jitter")), "k", "ts"))


_SIZES = "sz AS (SELECT k, med AS median_bytes, CASE WHEN abs(med) < 1e-12 THEN 1.0 ELSE quantile_cont(abs(orig_bytes - med), 0.5) / abs(med) END AS size_dispersion FROM br JOIN (SELECT k, quantile_cont(orig_bytes::DOUBLE, 0.5) AS med FROM br WHERE orig_bytes IS NOT NULL GROUP BY k HAVING count(*) >= 3) USING (k) WHERE orig_bytes IS NOT NULL GROUP BY k, med)"


@query(
    f"""{_BEACON_CTES}, {_SIZES}, kp AS (SELECT k, src_ip, dst_ip, dst_port, count(*) AS raw_records, max(ts) - min(ts) AS span FROM gp GROUP BY ALL HAVING count(*) >= 24 AND max(ts) - min(ts) >= 3600),
 en AS (SELECT k, count(*) AS samples FROM br GROUP BY k HAVING count(*) >= 24), pv AS (SELECT dst_ip, count(DISTINCT src_ip) AS hosts FROM gp GROUP BY 1),
 pt AS (SELECT src_ip, dst_ip, dst_port, med AS period, samples, raw_records, threshold AS burst_threshold, autocorrelation, size_dispersion, median_bytes,
   1 - least(1.0, CASE WHEN abs(med) < 1e-12 THEN 1.0 ELSE mad / abs(med) END / 0.6) AS interval_regularity, 1 - least(1.0, CASE WHEN n < 4 THEN 0.0 WHEN med < 1e-12 THEN 1.0 ELSE greatest(0.0, (med - q25) / med) END / 0.6) AS schedule_floor,
   CASE WHEN size_dispersion IS NOT NULL THEN 1 - least(1.0, size_dispersion / 0.5) END AS payload_uniformity, autocorrelation AS periodicity,
   least(n::DOUBLE, span / med) / greatest(n::DOUBLE, span / med) * {sat('samples', 15.0)} AS persistence, {rare('hosts')} AS destination_rarity
   FROM kp JOIN en USING (k) JOIN tm USING (k) LEFT JOIN sz USING (k) LEFT JOIN ac USING (k) LEFT JOIN th USING (k) JOIN pv USING (dst_ip) WHERE n >= 3 AND med BETWEEN 1 AND 86400)
 SELECT src_ip, dst_ip, dst_port, {r('period', 'period')}, samples, raw_records, {r('burst_threshold', 'burst_threshold')}, {r('autocorrelation', 'autocorrelation')}, {r('payload_uniformity', 'payload_uniformity')}, {r(wgm(beaconing.WEIGHTS), 'score')} FROM pt"""
)
def beacon_scored(spark, sf_dir):
    rows = beaconing.score(A.beacons(spark, sf_dir))
    return rounded(rows.select("src_ip", "dst_ip", "dst_port", "period", "samples", "raw_records", "burst_threshold", "autocorrelation", "payload_uniformity", "score"))


# --- fan-out, egress


@query(
    f"""SELECT src_ip, dst_port, destinations, flows, {r('breadth', 'breadth')}, {r('non_revisiting', 'non_revisiting')}, {r(wgm(fanout.WEIGHTS), 'score')} FROM (
 SELECT src_ip, dst_port, count(DISTINCT dst_ip) AS destinations, count(*) AS flows, {sat('count(DISTINCT dst_ip)', 250.0)} AS breadth, 1 - least(1.0::DOUBLE, greatest(0.0::DOUBLE, count(*)::DOUBLE / count(DISTINCT dst_ip) - 1) / 12.0::DOUBLE) AS non_revisiting
 FROM ({A.FLOWS}) WHERE dst_port NOT IN (53, 123) GROUP BY 1, 2 HAVING count(DISTINCT dst_ip) >= 50)"""
)
def fanout_scored(spark, sf_dir):
    return rounded(fanout.score(A.flows(spark, sf_dir)).select("src_ip", "dst_port", "destinations", "flows", "breadth", "non_revisiting", "score"))


_EGRESS = egress.Config(min_bytes=600_000, rare_min_bytes=100_000, rare_min_flows=1, rare_max_hosts=35)
_PAIRS = f"pm AS (SELECT src_ip, dst_ip, count(*) AS flows, sum(orig_bytes)::BIGINT AS bytes, count(orig_bytes) AS measured, min(ts) AS first_ts, max(ts) AS last_ts, sum(orig_bytes) FILTER (resp_bytes IS NOT NULL)::BIGINT AS po, sum(resp_bytes) FILTER (orig_bytes IS NOT NULL)::BIGINT AS pi, count(*) FILTER (orig_bytes IS NOT NULL AND resp_bytes IS NOT NULL) AS paired FROM ({A.FLOWS}) GROUP BY 1, 2 HAVING count(orig_bytes) > 0)"
_BASE = "bm AS (SELECT src_ip, count(*) AS bn, quantile_cont(bytes::DOUBLE, 0.5) AS med, min(first_ts) AS hf, max(last_ts) AS hl FROM pm GROUP BY 1), bd AS (SELECT src_ip, quantile_cont(abs(bytes - med), 0.5) AS mad FROM pm JOIN bm USING (src_ip) GROUP BY 1)"
_EGRESS_CTES = f"""WITH {_PAIRS}, {_BASE}, ph AS (SELECT dst_ip, count(DISTINCT src_ip) AS hosts FROM pm GROUP BY 1),
 ms AS (SELECT *, CASE WHEN paired > 0 AND paired / flows >= 0.5 AND po + pi <> 0 THEN po / (po + pi) END AS ratio, CASE WHEN bn >= 5 AND mad >= 1e-12 THEN (bytes - med) / (1.4826 * mad) END AS z, CASE WHEN hl - hf >= 3600 THEN (first_ts - hf) / (hl - hf) END AS nov
   FROM pm JOIN ph USING (dst_ip) JOIN bm USING (src_ip) JOIN bd USING (src_ip) WHERE bytes >= 600000 OR (bytes >= 100000 AND flows >= 1 AND hosts <= 35)),
 sc AS (SELECT *, {wgm(egress.WEIGHTS)} AS score FROM (SELECT *, CASE WHEN ratio IS NOT NULL THEN {clip('(ratio - 0.5) / 0.4')} END AS egress_ratio, CASE WHEN z IS NOT NULL THEN {sat('greatest(z, 0)', 3.5)} END AS volume_deviation, {rare('hosts')} AS destination_rarity, CASE WHEN nov IS NOT NULL THEN {clip('nov')} END AS novelty FROM ms))"""


@query(f"WITH {_PAIRS}, {_BASE} SELECT src_ip, dst_ip, {r('CASE WHEN bn >= 3 AND mad >= 1e-12 THEN (bytes - med) / (1.4826 * mad) END', 'z')} FROM pm JOIN bm USING (src_ip) JOIN bd USING (src_ip)")
def robust_z(spark, sf_dir):
    measured = egress.pairs(A.flows(spark, sf_dir))
    rows = measured.join(egress.baselines(measured), "src_ip")
    return rounded(rows.select("src_ip", "dst_ip", K.robust_deviation(F.col("bytes").cast("double"), F.col("base_med"), F.col("base_mad"), F.col("base_n")).alias("z")))


@query(f"{_EGRESS_CTES} SELECT src_ip, dst_ip, bytes, flows, hosts AS contacting_hosts, {r('egress_ratio', 'egress_ratio')}, {r('volume_deviation', 'volume_deviation')}, {r('novelty', 'novelty')}, {r('score', 'score')} FROM sc")
def egress_scored(spark, sf_dir):
    return rounded(egress.score(A.flows(spark, sf_dir), _EGRESS).select("src_ip", "dst_ip", "bytes", "flows", "contacting_hosts", "egress_ratio", "volume_deviation", "novelty", "score"))


@query(
    f"""{_EGRESS_CTES}, bd2 AS (SELECT src_ip, dst_ip, score, CASE WHEN bytes >= 600000 AND egress_ratio IS NOT NULL AND score >= 0.70 THEN 'exfiltrates_to' WHEN bytes >= 600000 AND score >= 0.45 AND coalesce(volume_deviation, 0) >= 0.5 THEN 'transfers_anomalous_volume'
   WHEN bytes >= 100000 AND flows >= 1 AND hosts <= 35 AND score >= 0.30 THEN 'contacts_rare_destination' END AS predicate FROM sc),
 rk AS (SELECT *, CASE predicate WHEN 'exfiltrates_to' THEN 2 WHEN 'transfers_anomalous_volume' THEN 1 ELSE 0 END AS band FROM bd2 WHERE predicate IS NOT NULL)
 SELECT src_ip, dst_ip, predicate, {r('score', 'score')} FROM rk QUALIFY band = max(band) OVER (PARTITION BY src_ip)"""
)
def egress_banded(spark, sf_dir):
    return rounded(egress.banded(egress.score(A.flows(spark, sf_dir), _EGRESS), _EGRESS).select("src_ip", "dst_ip", "predicate", "score"))


@query(f"SELECT src_ip, dst_port, orig_bytes, source_line, n FROM (SELECT *, row_number() OVER (PARTITION BY src_ip, dst_port ORDER BY orig_bytes DESC NULLS LAST, ts, source_file, source_line) AS n FROM ({A.FLOWS})) WHERE n <= 5")
def topk_artifacts(spark, sf_dir):
    kept = common.first_records(A.flows(spark, sf_dir), ["src_ip", "dst_port"], 5, F.col("orig_bytes").cast("string"), [F.desc_nulls_last("orig_bytes"), *common.RECORD_ORDER])
    rows = kept.select("src_ip", "dst_port", F.explode("artifacts").alias("a"))
    line = F.substring_index("a.locator", ":", -1).cast("bigint")
    return rows.select("src_ip", "dst_port", F.col("a.excerpt").cast("bigint").alias("orig_bytes"), line.alias("source_line"), F.col("a.n").cast("bigint").alias("n"))


# --- DNS


_TUNNEL = dnstunnel.Config(min_queries=10, min_subdomains=5)
_Q = "lower(trim(query, '.'))"


@query(
    f"""WITH z AS (SELECT *, {zone_sql('query')} AS zone FROM ({A.LOOKUPS})), s AS (SELECT src_ip, zone, replace(CASE WHEN ends_with({_Q}, zone) THEN left({_Q}, len({_Q}) - len(zone)) ELSE {_Q} END, '.', '') AS sub, count(*) AS n, count(*) FILTER (upper(qtype) IN ('TXT', 'NULL', 'CNAME', 'MX', 'SRV', '10', '16')) AS high FROM z GROUP BY ALL),
 ch AS (SELECT src_ip, zone, sub, c, count(*)::DOUBLE AS k FROM (SELECT src_ip, zone, sub, unnest(string_split(sub, '')) AS c FROM s WHERE len(sub) >= 8) GROUP BY ALL), en AS (SELECT src_ip, zone, sub, -sum(k / len(sub) * log2(k / len(sub))) AS h FROM ch GROUP BY ALL),
 zs AS (SELECT src_ip, zone, sum(n)::BIGINT AS queries, count(*) FILTER (sub <> '') AS subdomains, avg(h) AS mean_entropy, avg(len(sub)) FILTER (len(sub) >= 8) AS mean_length, sum(high) / sum(n) AS hf FROM s LEFT JOIN en USING (src_ip, zone, sub) GROUP BY 1, 2),
 pt AS (SELECT *, {clip('(mean_entropy - 3.2) / (4.6::DOUBLE - 3.2::DOUBLE)')} AS label_entropy, {sat('subdomains', 200.0)} AS subdomain_cardinality, {sat('mean_length', 40.0)} AS query_length, CASE WHEN hf > 0 THEN least(1.0::DOUBLE, 2 * hf) END AS qtype_skew FROM zs WHERE queries >= 10 AND subdomains >= 5 AND mean_length IS NOT NULL)
 SELECT src_ip, zone, queries, subdomains, {r('mean_entropy', 'mean_entropy')}, {r('mean_length', 'mean_length')}, {r('qtype_skew', 'qtype_skew')}, {r(wgm(dnstunnel.WEIGHTS), 'score')} FROM pt"""
)
def dns_tunnel_scored(spark, sf_dir):
    return rounded(dnstunnel.score(A.lookups(spark, sf_dir), _TUNNEL).select("src_ip", "zone", "queries", "subdomains", "mean_entropy", "mean_length", "qtype_skew", "score"))


_WORDS = "SELECT unnest(string_split(p_name, ' ')) AS word FROM part"
_ALPHABET = ", ".join(f"'{c}'" for c in tlsdga.ALPHABET)
_MODEL = f"""al AS (SELECT unnest([{_ALPHABET}]) AS a), ev AS (SELECT x.a || y.a AS bigram FROM al x, al y), ct AS (SELECT bigram, count(*) AS c FROM (SELECT substr(word, i, 2) AS bigram FROM (SELECT word, unnest(range(1, len(word))) AS i FROM ({_WORDS}) WHERE regexp_full_match(word, '[a-z0-9-]+'))) GROUP BY 1),
 cc AS (SELECT bigram, coalesce(c, 0) AS c FROM ev LEFT JOIN ct USING (bigram)), mo AS (SELECT bigram, -log2((c + 0.5) / (sum(c) OVER () + 684.5)) AS surprise, c, sum(c) OVER () AS seen FROM cc), md AS (SELECT bigram, surprise, sum(c * surprise) OVER () / seen AS usual, -log2(0.5 / (seen + 684.5)) AS improbable FROM mo)"""


def _model(spark, sf_dir):
    return tlsdga.bigram_model(A.read(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("word")))


@query(f"WITH {_MODEL} SELECT bigram, {r('surprise', 'surprise')}, {r('usual', 'usual')}, {r('improbable', 'improbable')} FROM md")
def bigram_model(spark, sf_dir):
    return rounded(_model(spark, sf_dir))


_IMPROBABLE = "lb AS (SELECT DISTINCT label FROM {src}), im AS (SELECT label, avg(surprise) AS mean_surprise, max(usual) AS na, max(improbable) AS ib FROM (SELECT label, substr(label, i, 2) AS bigram FROM (SELECT label, unnest(range(1, len(label))) AS i FROM lb)) LEFT JOIN md USING (bigram) GROUP BY 1 HAVING avg(surprise) IS NOT NULL), ip AS (SELECT label, mean_surprise, least(1.0, greatest(0.0, (mean_surprise - na) / (ib - na))) AS improbability FROM im)"


@query(f"WITH {_MODEL}, src AS (SELECT lower(replace(p_name, ' ', '')) || p_partkey % 7 AS label FROM part), {_IMPROBABLE.format(src='src')} SELECT label, {r('mean_surprise', 'mean_surprise')}, {r('improbability', 'improbability')} FROM ip")
def label_improbability(spark, sf_dir):
    labels = A.read(spark, sf_dir, "part").select(F.concat(F.lower(F.replace("p_name", F.lit(" "), F.lit(""))), (F.col("p_partkey") % 7).cast("string")).alias("label"))
    return rounded(tlsdga.improbability(labels, _model(spark, sf_dir)))


_LABELLED = f"rw AS (SELECT *, {zone_sql('query')} AS registered FROM ({A.GENERATED})), lr AS (SELECT *, split_part(registered, '.', 1) AS label, substr(registered, len(split_part(registered, '.', 1)) + 2) AS suffix FROM rw WHERE contains(registered, '.'))"
_FAMILY = "fm AS (SELECT src_ip, suffix, count(*) AS family_queries, count(DISTINCT label) AS family_labels, count(rcode) AS known, count(*) FILTER (upper(rcode) IN ('NXDOMAIN', '3')) AS nx, count(rcode) / count(*) AS coverage, CASE WHEN count(rcode) > 0 AND count(rcode) / count(*) >= 0.5 THEN count(*) FILTER (upper(rcode) IN ('NXDOMAIN', '3')) / count(rcode) END AS nx_rate FROM lr GROUP BY 1, 2 HAVING count(DISTINCT label) >= 12 AND count(*) >= 30)"


@query(f"WITH {_LABELLED}, {_FAMILY} SELECT src_ip, suffix, family_queries, family_labels, {r('coverage', 'rcode_coverage')}, {r('nx_rate', 'nx_rate')} FROM fm")
def dga_family(spark, sf_dir):
    return rounded(tlsdga.families(tlsdga.label_counts(tlsdga.labelled(A.generated(spark, sf_dir)))).select("src_ip", "suffix", "family_queries", "family_labels", "rcode_coverage", "nx_rate"))


@query(
    f"""WITH {_MODEL}, {_LABELLED}, {_FAMILY}, ll AS (SELECT src_ip, suffix, label, count(*) AS queries, count(rcode) AS coded, coalesce(bool_or(upper(rcode) NOT IN ('NXDOMAIN', '3')), false) AS answered FROM lr SEMI JOIN fm USING (src_ip, suffix) WHERE len(label) >= 6 GROUP BY ALL), {_IMPROBABLE.format(src='ll')},
 st AS (SELECT *, coalesce(list_max(list_transform(regexp_extract_all(label, '[b-df-hj-np-tv-z]+'), lambda x: len(x))), 0) AS run, len(regexp_replace(label, '[^0-9]', '', 'g'))::DOUBLE / len(label) AS dig FROM ll JOIN ip USING (label) JOIN fm USING (src_ip, suffix)),
 pt AS (SELECT *, improbability AS bigram_improbability, CASE WHEN nx_rate IS NOT NULL THEN {clip('(nx_rate - 0.1) / (0.7::DOUBLE - 0.1::DOUBLE)')} END AS nxdomain_rate, 1 - (1 - {clip('(run - 4) / 5.0')}) * (1 - {clip('(dig - 0.15) / (0.5::DOUBLE - 0.15::DOUBLE)')}) AS structure FROM st)
 SELECT src_ip, suffix, label, queries, CASE WHEN coded > 0 THEN answered END AS resolved, {r('bigram_improbability', 'bigram_improbability')}, {r('nxdomain_rate', 'nxdomain_rate')}, {r('structure', 'structure')}, {r(wgm(tlsdga.DGA_WEIGHTS), 'score')} FROM pt"""
)
def dga_scored(spark, sf_dir):
    rows = tlsdga.dga_score(A.generated(spark, sf_dir), _model(spark, sf_dir))
    return rounded(rows.select("src_ip", "suffix", "label", "queries", "resolved", "bigram_improbability", "nxdomain_rate", "structure", "score"))


@query(
    f"""WITH pr AS (SELECT src_ip, ja3, count(*) AS sessions, count(DISTINCT dst_ip) + max((dst_ip IS NULL)::INT) AS servers FROM ({A.SESSIONS}) WHERE ja3 IS NOT NULL AND trim(ja3) <> '' GROUP BY 1, 2), ps AS (SELECT ja3, count(*) AS presenting_hosts FROM pr GROUP BY 1),
 pt AS (SELECT src_ip, ja3, sessions, servers, presenting_hosts, (SELECT count(DISTINCT src_ip) FROM pr) AS estate_hosts, {rare('presenting_hosts')} AS fingerprint_rarity, {sat('(SELECT count(DISTINCT src_ip) FROM pr)', 50.0)} AS estate_support FROM pr JOIN ps USING (ja3) WHERE presenting_hosts <= 2 AND sessions >= 3)
 SELECT src_ip, ja3, sessions, servers, presenting_hosts, estate_hosts, {r(wgm(tlsdga.TLS_WEIGHTS), 'score')} FROM pt WHERE estate_hosts >= 10"""
)
def tls_rare(spark, sf_dir):
    return rounded(tlsdga.tls_score(A.sessions(spark, sf_dir)).select("src_ip", "ja3", "sessions", "servers", "presenting_hosts", "estate_hosts", "score"))


# --- alerts

_CLUSTERS = f"cl AS (SELECT src_ip, signature, count(*) AS alerts, arg_min(signature_id, (ts, source_line)) AS signature_id0, min(severity) AS severity, count(DISTINCT dst_ip) + max((dst_ip IS NULL)::INT) AS targets, first(category ORDER BY ts, source_line) AS category, first(signature_id ORDER BY ts, source_line) AS signature_id FROM ({A.ALERTS}) GROUP BY 1, 2)"
_WEIGHT = "CASE " + " ".join(f"WHEN contains(lower(category), '{k}') THEN {v}::DOUBLE" for k, v in X.CATEGORY_WEIGHTS) + f" ELSE {X.UNMATCHED_CATEGORY}::DOUBLE END"


@query(f"WITH {_CLUSTERS} SELECT src_ip, signature, alerts, signature_id, category, severity, targets FROM cl")
def alert_clusters(spark, sf_dir):
    return alerts.clusters(A.sensor_alerts(spark, sf_dir)).select("src_ip", "signature", "alerts", "signature_id", "category", "severity", "targets")


@query(
    f"""WITH {_CLUSTERS}, pv AS (SELECT signature_id, count(DISTINCT src_ip) AS hosts FROM ({A.ALERTS}) WHERE signature_id IS NOT NULL GROUP BY 1), pt AS (SELECT src_ip, signature, alerts, coalesce(hosts, 1) AS hosts, CASE WHEN coalesce(hosts, 1) >= 50 THEN least({rare('coalesce(hosts, 1)')}, 0.05::DOUBLE) ELSE {rare('coalesce(hosts, 1)')} END AS signature_rarity,
 CASE severity WHEN 1 THEN 1.0::DOUBLE WHEN 2 THEN 0.6::DOUBLE WHEN 3 THEN 0.3::DOUBLE ELSE 0.4::DOUBLE END AS stated_severity, {_WEIGHT} AS category_weight FROM cl LEFT JOIN pv USING (signature_id) WHERE alerts >= 3)
 SELECT src_ip, signature, alerts, hosts, {r('category_weight', 'category_weight')}, {r(wgm(alerts.WEIGHTS), 'score')} FROM pt"""
)
def alert_scored(spark, sf_dir):
    return rounded(alerts.score(A.sensor_alerts(spark, sf_dir)).select("src_ip", "signature", "alerts", "hosts", "category_weight", "score"))


# --- processes

_NAME = lambda c: rf"nullif(lower(trim(regexp_extract(rtrim(replace({c}, '/', '\'), '\'), '([^\\]+)$', 1))), '')"
_EDGES = f"nm AS (SELECT *, {_NAME('image')} AS image_name, {_NAME('parent_image')} AS parent_name FROM ({A.EXECUTIONS})), ed AS (SELECT host, parent_name, image_name, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts, first(image ORDER BY ts, source_file, source_line) AS image FROM nm GROUP BY 1, 2, 3)"
_PRESENCE = "pz AS (SELECT DISTINCT host, image_name AS name FROM ed UNION SELECT DISTINCT host, parent_name FROM ed WHERE parent_name IS NOT NULL), sp AS (SELECT name, count(*) AS hosts FROM pz GROUP BY 1)"
_HOST = host.Config(max_singleton_share=1.0, min_executions=100)


@query(f"WITH {_EDGES}, {_PRESENCE} SELECT (SELECT count(DISTINCT host) FROM ed) AS hosts, (SELECT sum(n)::BIGINT FROM ed) AS executions, count(*) AS images, count(*) FILTER (hosts = 1) AS singletons FROM sp")
def estate_baseline(spark, sf_dir):
    return host.estate(host.edges(host.named(A.executions(spark, sf_dir)))).select("hosts", "executions", "images", "singletons")


_PATH = r"CASE WHEN contains(lower(replace(image, '/', '\')), '\users\') OR contains(lower(replace(image, '/', '\')), '\appdata\') THEN 1.0::DOUBLE WHEN contains(lower(replace(image, '/', '\')), '\windows\system32\') THEN 0.15::DOUBLE ELSE 0.55::DOUBLE END"
_RARE = f"""im AS (SELECT image_name, count(DISTINCT host) AS image_hosts, sum(n)::BIGINT AS image_executions FROM ed GROUP BY 1), hp AS (SELECT host, image_name, sum(n)::BIGINT AS observed, first(image ORDER BY first_ts, image) AS image FROM ed GROUP BY 1, 2),
 rp AS (SELECT *, {wgm(host.PROCESS_WEIGHTS)} AS score FROM (SELECT *, {rare('image_hosts')} AS image_prevalence, {_PATH} AS path_anomaly, 1 - {sat('image_executions', 8.0)} AS execution_prevalence FROM hp JOIN im USING (image_name)))"""


@query(f"WITH {_EDGES}, {_RARE} SELECT host, image_name, observed, image_hosts, image_executions, {r('score', 'score')} FROM rp")
def rare_process(spark, sf_dir):
    return rounded(host.process_score(A.executions(spark, sf_dir), _HOST).select("host", "image_name", "observed", "image_hosts", "image_executions", "score"))


_LINEAGE = f"""pa AS (SELECT parent_name, image_name, count(DISTINCT host) AS pair_hosts, sum(n)::BIGINT AS pair_executions FROM ed WHERE parent_name IS NOT NULL GROUP BY 1, 2), pq AS (SELECT *, sum(pair_executions) OVER (PARTITION BY parent_name) AS spawned FROM pa),
 lj AS (SELECT ed.host, parent_name, image_name, n, pair_hosts, ps.hosts AS parent_hosts, im.image_hosts AS child_hosts, CASE WHEN spawned >= 20 THEN pair_executions / spawned END AS p FROM ed JOIN pq USING (parent_name, image_name) JOIN sp ps ON ps.name = parent_name JOIN im USING (image_name)),
 lp AS (SELECT *, CASE WHEN parent_hosts >= 2 THEN greatest(0.0::DOUBLE, 1 - pair_hosts / parent_hosts) END AS parent_breadth, CASE WHEN child_hosts >= 2 THEN greatest(0.0::DOUBLE, 1 - pair_hosts / child_hosts) END AS child_breadth, CASE WHEN p IS NOT NULL THEN CASE WHEN p <= 0 THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, -log2(least(p, 1)) / 6) END END AS child_surprisal FROM lj),
 ls AS (SELECT *, {wgm(host.LINEAGE_WEIGHTS)} AS score FROM lp WHERE parent_breadth IS NOT NULL OR child_breadth IS NOT NULL)"""


@query(f"WITH {_EDGES}, {_PRESENCE}, {_RARE}, {_LINEAGE} SELECT host, parent_name, image_name, n, pair_hosts, parent_hosts, child_hosts, {r('parent_breadth', 'parent_breadth')}, {r('child_surprisal', 'child_surprisal')}, {r('score', 'score')} FROM ls")
def lineage_breadth(spark, sf_dir):
    return rounded(host.lineage_score(A.executions(spark, sf_dir), _HOST).select("host", "parent_name", "image_name", "n", "pair_hosts", "parent_hosts", "child_hosts", "parent_breadth", "child_surprisal", "score"))


@query(f"WITH {_EDGES}, {_PRESENCE}, {_RARE}, {_LINEAGE} SELECT host, parent_name, image_name, {r('score', 'score')} FROM ls WHERE score >= 0.3 AND NOT EXISTS (SELECT 1 FROM rp WHERE rp.host = ls.host AND rp.image_name = ls.image_name AND rp.score >= 0.15)")
def subsumed(spark, sf_dir):
    rows = A.executions(spark, sf_dir)
    summed = host.summary(rows)
    lineage = host.lineage_score(rows, _HOST, summed).where("score >= 0.3")
    return rounded(host.subsumed(lineage, host.process_score(rows, _HOST, summed).where("score >= 0.15")).select("host", "parent_name", "image_name", "score"))


@query(
    r"""WITH RECURSIVE p AS (SELECT 'g' || o_orderkey AS guid, 'n' || o_orderkey % 50 AS name, CASE WHEN o_orderkey > 0 AND o_orderkey % 13 <> 0 THEN 'g' || o_orderkey // 3 END AS parent, CASE WHEN o_orderkey > 0 AND o_orderkey % 13 <> 0 THEN 'n' || (o_orderkey // 3) % 50 END AS pname FROM orders),
 w AS (SELECT guid, parent AS up, pname AS name, 0 AS d, []::VARCHAR[] AS chain FROM p UNION ALL SELECT w.guid, p.parent, p.pname, d + 1, list_prepend(coalesce(p.name, w.name), w.chain) FROM w LEFT JOIN p ON p.guid = w.up WHERE d < 4 AND w.up IS NOT NULL)
 SELECT guid AS process_guid, array_to_string(chain, '>') AS chain, up IS NOT NULL AS truncated FROM w QUALIFY d = max(d) OVER (PARTITION BY guid)"""
)
def ancestry_chain(spark, sf_dir):
    key = F.col("o_orderkey")
    has = (key > 0) & (key % 13 != 0)
    parent = F.floor(key / 3).cast("bigint")
    image = lambda k: F.concat(F.lit("C:\\x\\N"), (k % 50).cast("string"))
    rows = A.read(spark, sf_dir, "orders").select(F.concat(F.lit("g"), key.cast("string")).alias("process_guid"), image(key).alias("image"), F.when(has, F.concat(F.lit("g"), parent.cast("string"))).alias("parent_guid"), F.when(has, image(parent)).alias("parent_image"))
    return host.ancestry(rows, rows).select("process_guid", F.array_join("chain", ">").alias("chain"), "truncated")


# --- indicators and inventory

_ADDRESS = "SELECT DISTINCT '10.' || c_nationkey || '.' || c_custkey % 256 || '.' || (c_custkey // 7) % 256 AS address FROM customer"
_NETS = ("10.0.0.0/8", "10.3.0.0/16", "10.3.128.0/17", "10.4.5.0/24", "10.7.9.1/32", "0.0.0.0/0")


def _addresses(spark, sf_dir):
    k = F.col("c_custkey")
    return A.read(spark, sf_dir, "customer").select(F.concat_ws(".", F.lit("10"), F.col("c_nationkey").cast("string"), (k % 256).cast("string"), (F.floor(k / 7) % 256).cast("string")).alias("address")).distinct()


_NUMBER = lambda a: f"(split_part({a}, '.', 1)::BIGINT * 16777216 + split_part({a}, '.', 2)::BIGINT * 65536 + split_part({a}, '.', 3)::BIGINT * 256 + split_part({a}, '.', 4)::BIGINT)"
_NETWORKS = f"nt AS (SELECT v AS value, split_part(v, '/', 2)::INT AS bits, {_NUMBER(chr(40) + 'split_part(v, ' + chr(39) + '/' + chr(39) + ', 1)' + chr(41))} AS base FROM (SELECT unnest([{', '.join(repr(x) for x in _NETS)}]) AS v))"


@query(f"WITH ad AS ({_ADDRESS}), {_NETWORKS} SELECT address, arg_max(value, bits) AS network FROM ad JOIN nt ON {_NUMBER('address')} >> (32 - bits) = base >> (32 - bits) GROUP BY 1")
def cidr_match(spark, sf_dir):
    return ioc.match_networks(_addresses(spark, sf_dir), spark.createDataFrame([(x,) for x in _NETS], "value string"))


_DOMAINS = ("example.com", "example.net", "blog.tionsh.example.net", "shop.example.org")


@query(f"WITH nm AS (SELECT DISTINCT lower(regexp_extract(url, 'https?://([^/]+)', 1)) AS name FROM pages), dm AS (SELECT unnest([{', '.join(repr(x) for x in _DOMAINS)}]) AS domain), j AS (SELECT name, domain FROM nm JOIN dm ON name = domain OR ends_with(name, '.' || domain)) SELECT name, arg_max(domain, len(domain)) AS domain, len(string_split(name, '.')) - len(string_split(arg_max(domain, len(domain)), '.')) AS depth FROM j GROUP BY 1")
def suffix_match(spark, sf_dir):
    names = A.read(spark, sf_dir, "pages").select(F.lower(F.regexp_extract("url", "https?://([^/]+)", 1)).alias("name"))
    return ioc.match_names(names, spark.createDataFrame([(x,) for x in _DOMAINS], "value string")).withColumn("depth", F.col("depth").cast("bigint"))


_IOC_TEXT = "# name: lab\n# confidence: 80%\n# updated: 2023-06-01\nexample.com added=2023-10-01\nblog.tionsh.example.net confidence=0.9 added=2023-11-01 note=first seen here\nexample.org\n"


@query(
    f"""WITH nm AS (SELECT {_Q} AS value, count(*) AS events, min(ts) AS first_ts FROM ({A.LOOKUPS}) GROUP BY 1), dm AS (SELECT * FROM (VALUES ('example.com', DATE '2023-10-01', 0.8::DOUBLE), ('blog.tionsh.example.net', DATE '2023-11-01', 0.9::DOUBLE), ('example.org', DATE '2023-06-01', 0.8::DOUBLE)) t(domain, added, base)),
 j AS (SELECT *, row_number() OVER (PARTITION BY value ORDER BY len(domain) DESC) AS n FROM nm JOIN dm ON value = domain OR ends_with(value, '.' || domain)), s AS (SELECT *, greatest(0, date_diff('day', added, DATE '1970-01-01' + floor(first_ts / 86400)::INT)) AS age FROM j WHERE n = 1)
 SELECT value, domain AS indicator, CASE WHEN value = domain THEN 'exact' ELSE 'parent_domain' END AS match, events, age::INT AS age_days, {r('base * pow(0.5, age / 180)', 'score')} FROM s WHERE age <= 730 AND base * pow(0.5, age / 180) >= 0.10"""
)
def intel_scored(spark, sf_dir):
    rows, _ = ioc.read_ioc_text(_IOC_TEXT, "lab.ioc")
    dns = A.lookups(spark, sf_dir).withColumn("answers", F.lit(None).cast("string"))
    scored = intel.score(intel.observations(dns=dns), spark.createDataFrame(rows, ioc.SCHEMA))
    return rounded(scored.select("value", "indicator", "match", "events", "age_days", "score"))


_STATED = "CASE WHEN c_custkey % 5 <> 0 THEN DATE '2022-01-01' + (c_custkey % 900)::INT END"


@query(f"SELECT address, age_days::INT AS age_days, CASE WHEN stated IS NULL THEN 'undated' WHEN age_days < 0 THEN 'stated_after_capture' WHEN age_days > 730 THEN 'expired' WHEN age_days > 90 THEN 'stale' ELSE 'current' END AS staleness FROM (SELECT c_custkey::VARCHAR AS address, {_STATED} AS stated, date_diff('day', {_STATED}, DATE '2024-01-01') AS age_days FROM customer)")
def inventory_ladder(spark, sf_dir):
    k = F.col("c_custkey")
    stated = F.when(k % 5 != 0, F.date_add(F.lit("2022-01-01").cast("date"), (k % 900).cast("int")))
    rows = A.read(spark, sf_dir, "customer").select(k.cast("string").alias("address"), stated.alias("stated"), F.lit("2024-01-01").cast("date").alias("capture_start"))
    return inv.ladder(rows).select("address", "age_days", "staleness")


@query(f"WITH s AS (SELECT DISTINCT src_ip FROM (SELECT src_ip FROM ({A.CONTACTS}) UNION ALL SELECT src_ip FROM ({A.ALERTS})) WHERE src_ip IS NOT NULL), c AS (SELECT DISTINCT c_custkey::VARCHAR AS src_ip, 1 AS named FROM customer WHERE c_custkey % 2 = 0) SELECT count(*) AS addresses, count(named) AS named, count(*) - count(named) AS unnamed FROM s LEFT JOIN c USING (src_ip)")
def coverage(spark, sf_dir):
    known = A.read(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").cast("string").alias("address"))
    return inv.coverage(known, [A.contacts(spark, sf_dir), A.sensor_alerts(spark, sf_dir)])


# --- correlation

_NONCORR = ", ".join(f"'{x}'" for x in correlate.Config().non_corroborating)
_GROUPED = f"""cm AS ({A.CLAIMS}), nd AS (SELECT DISTINCT object AS named, subject AS target FROM cm WHERE object IS NOT NULL), un AS (SELECT * FROM cm WHERE predicate = 'matches_threat_intel'),
 ad AS (SELECT un.*, target FROM un JOIN nd ON un.subject = named AND target <> un.subject), anc AS (SELECT DISTINCT subject AS grp FROM cm WHERE finding NOT IN (SELECT finding FROM ad)),
 mb AS (SELECT finding, predicate, subject, object, confidence, first_ts, subject AS grp FROM cm WHERE subject IN (SELECT grp FROM anc) UNION ALL SELECT finding, predicate, subject, object, confidence, first_ts, target FROM ad WHERE target IN (SELECT grp FROM anc))"""


def _found(spark, sf_dir):
    return A.as_findings(A.claims(spark, sf_dir))


@query(f"SELECT subject, {r('1 - exp(sum(ln(1 - c)))', 'combined', 6)} FROM (SELECT subject, predicate, max(confidence) AS c FROM ({A.CLAIMS}) GROUP BY 1, 2) GROUP BY 1")
def noisy_or(spark, sf_dir):
    rows = A.claims(spark, sf_dir).groupBy("subject", "predicate").agg(F.max("confidence").alias("c"))
    return rounded(rows.groupBy("subject").agg(correlate.noisy_or(F.col("c")).alias("combined")), 6)


@query(f"WITH {_GROUPED} SELECT grp AS subject, finding FROM mb")
def attach_unary(spark, sf_dir):
    rows = correlate.grouped(_found(spark, sf_dir))
    return rows.select(F.col("owner.value").alias("subject"), F.col("evidence")[0]["summary"].alias("finding"))


@query(
    f"""WITH {_GROUPED}, fs AS (SELECT *, row_number() OVER (PARTITION BY grp, predicate ORDER BY first_ts, confidence DESC) AS n FROM mb), nx AS (SELECT grp, finding, predicate, confidence, first_ts, coalesce(object, subject) AS piv, lead(finding) OVER w AS l_finding, lead(predicate) OVER w AS l_predicate, lead(confidence) OVER w AS l_confidence, lead(first_ts) OVER w AS l_ts, lead(coalesce(object, subject)) OVER w AS l_piv
   FROM fs WHERE n = 1 WINDOW w AS (PARTITION BY grp ORDER BY first_ts, predicate))
 SELECT grp AS subject, predicate AS earlier, l_predicate AS later, {r('l_ts - first_ts', 'separation', 1)}, {r('least(confidence, l_confidence)', 'confidence')} FROM nx WHERE l_finding IS NOT NULL AND piv <> l_piv AND l_ts - first_ts >= 1"""
)
def precedes_edges(spark, sf_dir):
    rows = correlate.ordered_edges(correlate.earliest(_found(spark, sf_dir)))
    said = lambda k: F.get_json_object(F.col("evidence")[0]["payload"], f"$.{k}")
    return rounded(rows.select(F.col("owner.value").alias("subject"), said("earlier_predicate").alias("earlier"), said("later_predicate").alias("later"), said("separation_seconds").cast("double").alias("separation"), "confidence"))


@query(
    f"""WITH {_GROUPED}, st AS (SELECT grp, predicate, max(confidence) AS c FROM mb GROUP BY 1, 2), sc AS (SELECT grp, 1 - exp(sum(ln(1 - c))) AS combined, count(*) FILTER (predicate NOT IN ({_NONCORR})) AS k FROM st GROUP BY 1)
 SELECT grp AS subject, {r('combined', 'combined_confidence')}, k AS behaviours, {r('combined * least(1 + 0.5 * greatest(k - 1, 0), 2.5)', 'score')}, (SELECT count(*) FROM mb WHERE mb.grp = sc.grp) AS findings FROM sc"""
)
def incident_queue(spark, sf_dir):
    rows = correlate.queue(_found(spark, sf_dir), correlate.Config(order_behaviours=False), nested=False)
    return rounded(rows.select(F.col("subject.value").alias("subject"), "combined_confidence", F.size("corroborating_predicates").cast("bigint").alias("behaviours"), "score", F.col("n_findings").alias("findings")))


@query(f"WITH cm AS ({A.CLAIMS}) SELECT finding, 'wrong object' AS violation FROM cm WHERE predicate = 'triggered_signature'")
def grammar_violations(spark, sf_dir):
    return lexicon.violations(_found(spark, sf_dir)).select(F.col("evidence")[0]["summary"].alias("finding"), "violation")
