"""Streams give what batches give."""

from pyspark.sql import functions as F

from tamarack import schemas, synth
from tamarack.operators import beaconing
from tamarack.streaming import windows as S


def test_partials_add_up(spark, tmp_path):
    rows, _ = synth.sweep_corpus()
    df = synth.frame(spark, rows, schemas.CONNECTIONS)
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.forceDeleteTempCheckpointLocation", "true")
    stream = S.stream_table(spark, str(tmp_path / "in"), schemas.CONNECTIONS)
    table = S.run_to_memory(S.pair_partials(stream), "partials")
    got = {tuple(r) for r in S.merged(table).select(*S.KEYS, "n", "first_ts", "last_ts").collect()}
    assert got == {tuple(r) for r in beaconing.summary(df).select(*S.KEYS, "n", "first_ts", "last_ts").collect()}
    sessions = S.run_to_memory(S.bursts(S.stream_table(spark, str(tmp_path / "in"), schemas.CONNECTIONS)), "sessions")
    assert sessions.agg(F.sum("records")).first()[0] == df.count()


def test_bounded_state(spark, tmp_path):
    rows = [{"ts": synth.START + 60.0 * i, "src_ip": "a", "dst_ip": "b", "dst_port": 1} for i in range(50)]
    synth.frame(spark, rows, schemas.CONNECTIONS).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = S.rolling_intervals(S.stream_table(spark, str(tmp_path / "in"), schemas.CONNECTIONS), keep=16)
    (r,) = S.run_to_memory(stream, "rolling", "update").collect()
    assert (r.n, r.period, r.jitter) == (50, 60.0, 0.0)
