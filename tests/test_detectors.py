"""Planted truth, omitted components, order of rows, and findings end to end."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tamarack import evaluate, hunt, language, lexicon, schemas, synth
from tamarack.operators import beaconing, egress, fanout, host
from tamarack.operators import kernels as K
from tamarack.plans import correlate
from tamarack.plans.context import Context, all_findings


@pytest.mark.parametrize("name", sorted(synth.CORPORA))
def test_planted_truth(spark, name):
    s = evaluate.run_corpus(spark, name)
    assert s.recall >= 0.8, s
    assert s.precision >= 0.75, s


def test_unmeasured_isnt_zero(spark):
    rows, _ = synth.egress_corpus()
    full = synth.frame(spark, rows, schemas.CONNECTIONS)
    blind = full.withColumn("resp_bytes", F.lit(None).cast("bigint"))
    missing = full.drop("resp_bytes")
    a, b = (egress.score(d).select("src_ip", "dst_ip", "egress_ratio", F.round("score", 9).alias("score")).orderBy("src_ip", "dst_ip").collect() for d in (blind, missing))
    assert a == b and all(r.egress_ratio is None for r in a)
    assert egress.banded(egress.score(blind)).where("predicate = 'exfiltrates_to'").count() == 0


def test_no_bytes_no_payload_component(spark):
    rows, _ = synth.beacon_corpus()
    df = synth.frame(spark, rows, schemas.CONNECTIONS).withColumn("orig_bytes", F.lit(None).cast("bigint"))
    scored = beaconing.score(df).collect()
    assert scored and all(r.payload_uniformity is None and r.size_dispersion is None for r in scored)


def test_row_order_and_partitions_dont_matter(spark):
    rows, _ = synth.sweep_corpus()
    df = synth.frame(spark, rows, schemas.CONNECTIONS)
    plain = fanout.detect(df).collect()
    assert fanout.detect(df.repartition(7).orderBy(F.rand(3))).collect() == plain


def test_small_estate_says_nothing(spark):
    rows, _ = synth.host_corpus()
    rare, lineage = host.detect(synth.frame(spark, rows, schemas.PROCESSES).where("host < 'ws04'"))
    assert rare.count() == 0 and lineage.count() == 0


def test_empty_frames(spark):
    assert all_findings(Context.of(spark)).count() == 0


@pytest.fixture(scope="module")
def demo(spark):
    from tamarack.runtime import materialize

    ctx = Context.of(spark, **synth.demo(spark))
    return ctx, materialize(all_findings(ctx), "demo")


def test_demo_queue(spark, demo):
    _, found = demo
    assert lexicon.violations(found).count() == 0
    ids = [r.id for r in found.select("id").collect()]
    assert len(ids) == len(set(ids))
    rows = correlate.queue(found).orderBy("place").collect()
    assert rows[0].subject.value == "10.0.0.10" and len(rows[0].corroborating_predicates) >= 3
    assert any(f.predicate == "precedes" for f in rows[0].findings)
    incident = rows[0].asDict(recursive=True)
    brief = language.build_brief(incident)
    assert language.estimate_tokens(brief.text) <= 760 and brief.citable


def test_hunt_queries(spark, demo):
    ctx, found = demo
    incident = correlate.queue(found).orderBy("place").first().asDict(recursive=True)
    queries = hunt.queries_for_incident(incident)
    assert {q.dialect for q in queries} == set(hunt.Dialect)
    for name in schemas.BY_NAME:
        getattr(ctx, name).createOrReplaceTempView(name)
    for q in queries:
        if q.dialect is hunt.Dialect.SPARK:
            spark.sql(q.query).collect()


def _finding(predicate, subject, target=None, **more):
    entity = lambda x: x and {"id": f"{x[0]}:{x[1]}", "type": x[0], "value": x[1]}
    return {"id": "fnd_1", "predicate": predicate, "subject": entity(subject), "object": entity(target), "confidence": 0.9, "severity": "info"} | more


def test_hunt_escapes():
    nasty = "a\"b'c\\d*\x07\n"
    assert {str(d): hunt.escape(nasty, d) for d in hunt.Dialect} == {
        "sigma": "a\\\"b'c\\\\d*", "kql": "a\\\"b'c\\\\d*", "spl": "a\\\"b'c\\\\d\\*", "zeek": "a\\\"b'\\''c\\\\d*", "spark": "a\"b\\'c\\\\d*",
    }


def test_hunt_pages():
    tunnel = {str(q.dialect): q.query for q in hunt.queries_for(_finding("tunnels_dns_over", ("ip", "10.0.0.1"), ("domain", "evil.example"), attack_techniques=["T1071.004"]))}
    assert '    query|endswith: ".evil.example"\n  known:\n    src_ip: "10.0.0.1"\n  condition: selection and not known\nlevel: informational' in tunnel["sigma"] and "  - attack.t1071.004\n" in tunnel["sigma"]
    assert '| where QueryName endswith ".evil.example"\n| where SourceIP != "10.0.0.1"' in tunnel["kql"] and 'index=dns query="*.evil.example" src_ip!="10.0.0.1"' in tunnel["spl"]
    assert "WHERE endswith(lower(query), '.evil.example') AND src_ip <> '10.0.0.1'" in tunnel["spark"]
    scan = {str(q.dialect): q.query for q in hunt.queries_for(_finding("scans", ("host", "ws1"), ("port", "445")))}
    assert "dst_port: 445\n" in scan["sigma"] and "DestinationPort == 445\n" in scan["kql"] and "NetworkEvents" in scan["kql"] and '$2 == 445 && $1 != "ws1"' in scan["zeek"]
    feed = hunt.queries_for(_finding("matches_threat_intel", ("ip", "203.0.113.5")))
    assert len(feed) == 5 and all("!=" not in q.query and "<>" not in q.query for q in feed)
    assert [q.dialect for q in hunt.queries_for(_finding("executes_rare_process", ("host", "ws1"), ("image", "a.exe")))] == ["sigma", "kql", "spl", "spark"]
    assert hunt.queries_for(_finding("precedes", ("ip", "10.0.0.1"), ("ip", "10.0.0.2"))) == [] == hunt.queries_for(_finding("matches_threat_intel", ("file_hash", "ab")))
    first, second = _finding("beacons_to", ("ip", "a"), ("ip", "b")), _finding("exfiltrates_to", ("ip", "a"), ("ip", "b"), id="fnd_0", confidence=0.5)
    assert {q.finding_id for q in hunt.queries_for_incident({"findings": [second, first]})} == {"fnd_1"} and hunt.pivot_entities({"findings": [second, first]}) == [first["object"]]


def test_zeek_search_runs_in_awk(tmp_path):
    """The awk program of the Zeek dialect, with quotes of both kinds in the values, over a file in zeek-cut's form."""
    import subprocess

    (query,) = hunt.queries_for(_finding("tunnels_dns_over", ("ip", "10.0.0.1"), ("domain", "it's\"x.example")), (hunt.Dialect.ZEEK,))
    awk = query.query.split("| ")[2].removesuffix(" \\\n  ")
    rows = "10.0.0.1\ta.it's\"x.example\n10.0.0.2\tb.it's\"x.example\n10.0.0.3\tit's\"x.example\n"
    assert subprocess.run(awk, shell=True, input=rows, capture_output=True, text=True, check=True).stdout == "10.0.0.2\n"


def test_verifier(spark):
    finding = {
        "id": "fnd_1", "predicate": "beacons_to", "subject": {"id": "e1", "type": "ip", "value": "10.0.0.1"}, "object": {"id": "e2", "type": "ip", "value": "203.0.113.5"}, "confidence": 0.9, "severity": "high",
        "evidence": [{"summary": "s", "payload": json.dumps({"port": 443}), "artifacts": [{"excerpt": ""}]}],
    }
    answer = {"narrative": "10.0.0.1 talks to evil.example.com", "claims": [{"text": "10.0.0.1 beacons to 203.0.113.5 on port 443", "cites": ["fnd_1"]}, {"text": "it is bad", "cites": []}, {"text": "x", "cites": ["fnd_9"]}, {"text": "10.0.0.9 too", "cites": ["fnd_1"]}]}
    report = language.verify(answer, [finding], frozenset({"fnd_1"}))
    assert report.narrative_struck and [c[2] for c in report.claims] == [None, "no citation", "unresolved citation: fnd_9", "fabricated entity: 10.0.0.9"]
    claims = spark.createDataFrame([(i, c["text"], c["cites"]) for i, c in enumerate(answer["claims"])], "claim int, text string, cites array<string>")
    known = spark.createDataFrame([("fnd_1", n) for n in ("10.0.0.1", "203.0.113.5", "443")], "finding string, name string")
    rows = language.struck_claims(claims, known).orderBy("claim").collect()
    assert [r.reason for r in rows] == [None, "no citation", "unresolved citation", "fabricated entity: 10.0.0.9"]


def test_energy_meters(tmp_path):
    import time

    from tamarack import receipt

    counter = tmp_path / "energy_uj"
    assert receipt.counter_meter(counter) is None and receipt.rail_meter(tmp_path) is None
    counter.write_text("1000000\n")
    end = receipt.counter_meter(counter)
    counter.write_text("3500000\n")
    assert end() == 2.5
    end = receipt.counter_meter(counter)
    counter.write_text("5\n")
    assert end() is None
    for i, watts in enumerate((2, 3)):
        (tmp_path / f"hwmon{i}").mkdir()
        (tmp_path / f"hwmon{i}" / "power1_input").write_text(f"{watts * 1_000_000}\n")
    began, end = time.monotonic(), receipt.rail_meter(tmp_path, every=0.01)
    time.sleep(0.1)
    joules = end()
    assert 0.45 <= joules <= 5 * (time.monotonic() - began) + 0.01


# --- kernels against NumPy


def _series(rng):
    kind = rng.integers(0, 3)
    n = int(rng.integers(4, 80))
    if kind == 0:
        return np.sort(rng.uniform(0, 5000, n))
    base = np.cumsum(np.full(n, 60.0) * (1 + rng.uniform(-0.2, 0.2, n) * kind))
    return np.sort(np.concatenate([base, base + 0.3])) if kind == 2 else base


def _autocorrelation(t, period, jitter):
    if len(t) < 8 or t[-1] <= t[0] or 2.5 * jitter > period / 2:
        return None
    w = min(max(2.5 * jitter, period / 4), period / 2)
    n = int((t[-1] - t[0]) / w) + 1
    c = np.bincount(np.minimum(((t - t[0]) / w).astype(int), n - 1), minlength=n).astype(float)
    s = c - c.mean()
    e = s @ s
    lo, hi = max(1, round(period / w * 0.8)), min(round(period / w * 1.2), n - 1)
    if e < 1e-12 or hi < lo:
        return None
    return min(1.0, max(0.0, max(s[:-k] @ s[k:] / e for k in range(lo, hi + 1))))


def test_long_keys_are_dealt_in_ranges(spark):
    """The ways for keys of any length give what the plain ways give."""
    rng = np.random.default_rng(8)
    made = [(f"k{i % 3}", float(t), int(b) if b % 4 else None, n) for i in range(6) for n, (t, b) in enumerate(zip(np.sort(rng.choice([0.5, 1.0, 30.0, 900.0], 300)).cumsum(), rng.integers(0, 50, 300), strict=True))]
    events = spark.createDataFrame(made, "k string, ts double, v long, n int").repartition(5)
    shown = lambda df: sorted(map(repr, df.collect()))
    spaced = [K.gaps(events, "k", "ts", ["n"], long).select("k", "ts", "v", "n", "gap") for long in (False, True)]
    assert shown(spaced[0].drop("v")) == shown(spaced[1].drop("v"))
    limits = spark.createDataFrame([("k0", 20.0), ("k1", 0.1)], "k string, threshold double")
    bursts = [K.coalesce_bursts(spaced[0], limits, "k", "ts", "v", ["n"], long).select("k", "ts", "v", "records") for long in (False, True)]
    assert shown(bursts[0].drop("v")) == shown(bursts[1].drop("v")) and bursts[0].agg(F.sum("v")).first() == bursts[1].agg(F.sum("v")).first()
    values = spaced[0].where("gap is not null").select("k", "gap")
    plain, ranged = ({r.k: r for r in K.dispersion(values, "k", "gap", long).collect()} for long in (False, True))
    assert plain.keys() == ranged.keys() and all(math.isclose(plain[k][c], ranged[k][c], abs_tol=1e-9) for k in plain for c in ("n", "med", "mad", "cod", "q25"))
    shares = [0.0, 0.1, 0.333, 0.5, 0.99, 1.0]
    plain, ranged = ({r.k: r.q for r in K.quantiles(values, "k", "gap", shares, long).collect()} for long in (False, True))
    assert all(np.allclose(plain[k], ranged[k]) for k in plain)


def test_kernels_match_numpy(spark):
    rng = np.random.default_rng(5)
    series = {f"k{i}": _series(rng) for i in range(40)}
    events = spark.createDataFrame([(k, float(t), i) for k, ts in series.items() for i, t in enumerate(ts)], "k string, ts double, i int")
    spaced = K.gaps(events, "k", "ts", ["i"]).where("gap > 0").select("k", "gap")
    stats = {r.k: r for r in K.dispersion(spaced, "k", "gap").collect()}
    params = []
    for k, ts in series.items():
        g = np.diff(ts)
        g = g[g > 0]
        med = float(np.median(g))
        mad = float(np.median(np.abs(g - med)))
        assert math.isclose(stats[k].med, med, rel_tol=1e-9) and math.isclose(stats[k].mad, mad, rel_tol=1e-9, abs_tol=1e-9)
        params.append((k, med, mad))
    found = {r.k: r.autocorrelation for r in K.periodicity(events, spark.createDataFrame(params, "k string, period double, jitter double"), "k", "ts").collect()}
    for k, med, mad in params:
        expected = _autocorrelation(series[k], med, mad)
        assert (expected is None) == (k not in found), k
        if expected is not None:
            assert math.isclose(found[k], expected, abs_tol=1e-6), k
