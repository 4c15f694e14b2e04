"""Queries of tables that the driver can't hold: rows are written and read by executors."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tamarack import adapters, catalog, catalog_reports
from tamarack.plans import correlate
from tamarack.sources import sinks
from tamarack.sources.lines import numbered_lines

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["eve_alerts", "netflow_rows", "zeek_conn", "zeek_ssl"])
def test_fixtures_are_not_collected(spark, monkeypatch, name):
    def refuse(self, *a, **b):
        raise AssertionError("rows were sent to the driver")

    assert catalog_reports.QUERIES is catalog.QUERIES
    for method in ("collect", "toPandas", "toLocalIterator"):
        monkeypatch.setattr(type(spark.range(0)), method, refuse)
    catalog.QUERIES[name](spark, DATA)


def test_lines_of_many_parts_keep_their_order(spark, tmp_path):
    lines = spark.range(1000, numPartitions=7).sort(F.desc("id")).select(F.col("id").cast("string").alias("value"))
    sinks.write_lines(lines, str(tmp_path / "x.log"), ["head"])
    assert (tmp_path / "x.log").read_text().split("\n") == ["head", *map(str, range(999, -1, -1)), ""]
    read = numbered_lines(spark, str(tmp_path), "x.log").collect()
    assert sorted((r.source_line, r.value) for r in read)[1:] == [(n + 2, str(999 - n)) for n in range(1000)]


def test_incidents_without_lists(spark):
    found = catalog._found(spark, DATA)
    for cfg in (correlate.Config(), correlate.Config(attach_unary=False, order_behaviours=False)):
        whole, bare = correlate.queue(found, cfg), correlate.queue(found, cfg, nested=False)
        assert "findings" not in bare.columns
        shown = lambda df: sorted(df.select(*bare.columns).collect(), key=lambda r: r.place)
        assert shown(whole) == shown(bare) and whole.where("n_findings <> size(findings)").count() == 0


def test_behaviours_that_tie_are_chosen_by_id(spark, tmp_path):
    """Eight findings of each group, predicate, time and confidence: the SQL leaves them open, the rule here is (first_seen, confidence, id)."""
    keys = spark.range(12_000).select((F.col("id") % 1500 + F.floor(F.col("id") / 1500) * (86_400 * 707)).alias("c_custkey"))
    keys.repartition(5, "c_custkey").sortWithinPartitions(F.desc("c_custkey")).write.parquet(str(tmp_path / "customer.parquet"))
    catalog._found(spark, str(tmp_path)).select(F.col("evidence")[0]["summary"].alias("finding"), "id").write.parquet(str(tmp_path / "ids"))
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet/*.parquet'")
    duck.sql(f"CREATE TABLE ids AS SELECT * FROM '{tmp_path}/ids/*.parquet'")

    def with_ties_by(order):
        text = catalog.ORACLES["precedes_edges"]
        for part, new in (("ORDER BY first_ts, confidence DESC", f"ORDER BY first_ts, confidence DESC, {order}"), ("AS n FROM mb)", "AS n FROM mb JOIN ids USING (finding))")):
            assert text.count(part) == 1
            text = text.replace(part, new)
        return sorted(duck.sql(f"SELECT subject, earlier, later, separation, confidence FROM ({text})").fetchall())

    got = catalog.QUERIES["precedes_edges"](spark, str(tmp_path)).select("subject", "earlier", "later", "separation", "confidence").collect()
    assert sorted(map(tuple, got)) == with_ties_by("id") != with_ties_by("id DESC")


def _digest(prefix, **fields):
    """content_id() as SQL."""
    body = " || ',' || ".join(f"""'"{k}":' || coalesce(to_json({fields[k]})::VARCHAR, 'null')""" for k in sorted(fields))
    return f"'{prefix}_' || left(sha256('{{' || {body} || '}}'), 16)"


def test_sql_with_ids_of_its_own_breaks_ties_alike(spark, tmp_path):
    """The ids that break ties are made in DuckDB too, so nothing of Spark's is in what its rows are held against."""
    keys = spark.range(12_000).select((F.col("id") % 1500 + F.floor(F.col("id") / 1500) * (86_400 * 707)).alias("c_custkey"))
    keys.repartition(5, "c_custkey").write.parquet(str(tmp_path / "customer.parquet"))
    cited = _digest("art", source="'<aggregate>'", locator="'-'")
    proof = _digest("ev", kind="'stated'", payload="""'{"finding":' || to_json(finding)::VARCHAR || '}'""", artifacts=cited)
    entity = lambda kind, value: _digest("ent", type=kind, value=value)
    subject, target = entity("CASE WHEN object IS NULL THEN 'ip' ELSE 'host' END", "subject"), entity("'ip'", "object")
    own = _digest("fnd", predicate="predicate", subject=subject, object=f"CASE WHEN object IS NOT NULL THEN {target} END", evidence=proof)
    text = catalog.ORACLES["precedes_edges"]
    for part, new in (("ORDER BY first_ts, confidence DESC", "ORDER BY first_ts, confidence DESC, id"), ("AS n FROM mb)", f"AS n FROM mb JOIN (SELECT finding, {own} AS id FROM cm) USING (finding))")):
        assert text.count(part) == 1
        text = text.replace(part, new)
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet/*.parquet'")
    ids = catalog._found(spark, str(tmp_path)).select(F.col("evidence")[0]["summary"], "id").collect()
    assert sorted(map(tuple, ids)) == sorted(duck.sql(f"SELECT finding, {own} FROM ({adapters.CLAIMS})").fetchall())
    got = catalog.QUERIES["precedes_edges"](spark, str(tmp_path)).select("subject", "earlier", "later", "separation", "confidence").collect()
    for threads in (1, 4):
        duck.sql(f"SET threads = {threads}")
        assert sorted(map(tuple, got)) == sorted(duck.sql(f"SELECT subject, earlier, later, separation, confidence FROM ({text})").fetchall())
