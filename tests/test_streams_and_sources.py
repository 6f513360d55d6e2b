"""Streams in two batches against batch results; readers and writers."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from recollect.config import CacheConfig
from recollect.operators import sequential as SQ
from recollect.operators import workload as W
from recollect.sources import reports, snapshots
from recollect.streaming import queries as Q


def in_two_batches(spark, df, make, tmp_path, cut):
    """Run ``make`` over a file stream fed with two files one after the other."""
    src, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    result = None
    for part in (df.filter(F.col("seq") < cut), df.filter(F.col("seq") >= cut)):
        part.coalesce(1).write.mode("append").parquet(src)
        result = Q.run_available(make(Q.read_stream(spark, src, df.schema)), out, mark)
    return result


def arrivals(spark):
    rows = [("a" if i % 3 else "b", i, 0.3 * i, i % 4 != 0) for i in range(80)]
    df = spark.createDataFrame(rows, "tenant_id string, seq bigint, offset_s double, ok boolean")
    return df.withColumn("ts", F.timestamp_micros((F.col("offset_s") * 1e6).cast("bigint"))).drop("offset_s")


def test_token_bucket_stream(spark, tmp_path):
    df = arrivals(spark)
    got = in_two_batches(spark, df, lambda s: Q.stream_token_bucket(s, 1.0, 2), tmp_path, 33)
    want = SQ.token_bucket(df, 1.0, 2)
    key = [F.col("seq"), F.col("allowed"), F.round("tokens", 6)]
    assert sorted(got.select(*key).collect()) == sorted(want.select(*key).collect())


def test_breaker_stream(spark, tmp_path):
    df = arrivals(spark).withColumnRenamed("tenant_id", "dependency").withColumn("ok", F.col("seq") % 10 > 5)
    cfg = CacheConfig(breaker_failures=2, breaker_reset_s=2.0)
    got = in_two_batches(spark, df, lambda s: Q.stream_breaker(s, cfg), tmp_path, 41)
    want = SQ.breaker_states(df, cfg)
    cols = ["seq", "state", "rejected", "state_after"]
    assert sorted(got.select(*cols).collect()) == sorted(want.select(*cols).collect())


def test_bandit_stream(spark, tmp_path):
    rows = [("s", i, None, 0.9 if i < 60 else 0.1) for i in range(120)]
    df = spark.createDataFrame(rows, "shard_id string, seq bigint, arm int, reward double")
    cfg = CacheConfig(drift_delta=0.1)
    got = in_two_batches(spark, df, lambda s: Q.stream_bandit(s, cfg), tmp_path, 50)
    want = SQ.bandit_updates(df, cfg)
    cols = ["seq", "used_arm", F.round("alpha", 6), "reset", "resets"]
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(map(tuple, want.select(*cols).collect()))


def test_session_fusion_stream(spark, tmp_path):
    rows = [("s" if i % 2 else "t", i, i, 700.0 * i if i < 6 else 700.0 * i + 4000, [float(i % 3), 1.0]) for i in range(12)]
    df = spark.createDataFrame(rows, "session_id string, query_id bigint, seq bigint, offset_s double, embedding array<float>")
    df = df.withColumn("ts", F.timestamp_seconds("offset_s")).drop("offset_s")
    got = in_two_batches(spark, df, Q.stream_session_fusion, tmp_path, 5)
    want = SQ.session_fusion(df)
    cols = ["query_id", "turn", F.round(F.col("fused")[0], 9)]
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(map(tuple, want.select(*cols).collect()))


def test_dedup_stream_drops_repeats_across_batches(spark, tmp_path):
    rows = [(i, "t", "Same text" if i % 2 else f"text {i}") for i in range(10)]
    df = spark.createDataFrame(rows, "seq bigint, tenant_id string, query_text string").withColumn("query_id", F.col("seq")).withColumn("ts", F.timestamp_seconds(F.col("seq") + 1000))
    got = in_two_batches(spark, df, lambda s: Q.stream_exact_dedup(s, 3600), tmp_path, 5)
    assert got.count() == 6


@pytest.mark.parametrize("first", [1, 7, 30])
def test_dedup_by_event_time_does_not_depend_on_batches(spark, tmp_path, first):
    rows = [(i, "t", "Same text" if i % 3 else "other text") for i in range(31)]
    df = spark.createDataFrame(rows, "seq bigint, tenant_id string, query_text string").withColumn("query_id", F.col("seq"))
    df = df.withColumn("ts", F.timestamp_seconds(F.col("seq") * 100 + 10_000))
    got = in_two_batches(spark, df, lambda s: Q.stream_exact_dedup(s, 1000), tmp_path, first)
    # Each text is kept again once the kept request is 1,000 seconds old.
    assert sorted(r.query_id for r in got.collect()) == [0, 1, 11, 12, 22, 24]


def test_ttl_stream_emits_expired_only(spark, tmp_path):
    rows = [(0, "a", 1, 10), (1, "b", 5, 5000), (2, "c", 100, None), (3, "d", 200, 250), (4, "e", 1000, 9000)]
    df = spark.createDataFrame(rows, "seq bigint, entry_id string, at bigint, until bigint")
    df = df.withColumn("ts", F.timestamp_seconds("at")).withColumn("expires_at", F.timestamp_seconds("until")).drop("at", "until")
    got = in_two_batches(spark, df, Q.stream_ttl, tmp_path, 3)
    assert {r.entry_id for r in got.collect()} == {"a", "d"}


def test_ttl_stream_keeps_state_by_parts_and_the_latest_expiry(spark, tmp_path, monkeypatch):
    from recollect.streaming import parts

    monkeypatch.setattr(parts, "PARTS", 2)
    rows = [(i, f"e{i}", 100 + i, 150 + i) for i in range(20)] + [(20, "e3", 130, 900), (21, None, 131, 140), (22, "late", 500, 600), (23, "last", 2000, 9000)]
    rows += [(i, f"open{i}", 2000, 9000 + i) for i in range(24, 40)]
    df = spark.createDataFrame(rows, "seq bigint, entry_id string, at bigint, until bigint")
    df = df.withColumn("ts", F.timestamp_seconds("at")).withColumn("expires_at", F.timestamp_seconds("until")).drop("at", "until")
    got = in_two_batches(spark, df, Q.stream_ttl, tmp_path, 20)
    ends = {r.entry_id: r.at for r in got.select("entry_id", F.unix_seconds("expired_at").alias("at")).collect()}
    assert got.count() == 22 and ends == {f"e{i}": 150 + i for i in range(20) if i != 3} | {"e3": 900, None: 140, "late": 600}
    left = spark.read.format("statestore").load(str(tmp_path / "mark"))
    assert left.count() <= 3


def test_snapshot_versions(spark, tmp_path):
    root = str(tmp_path / "t")
    assert snapshots.versions(spark, root) == [] and snapshots.read_version(spark, root) is None
    for v in (1, 2):
        snapshots.write_version(spark.range(v), root, v)
    (tmp_path / "t" / "version=3").mkdir()  # a writer that was lost: no marker
    assert snapshots.versions(spark, root) == [1, 2]
    assert snapshots.read_version(spark, root).count() == 2 and snapshots.read_version(spark, root, 1).count() == 1
    snapshots.write_version(spark.range(5), root, 2)
    assert snapshots.read_version(spark, root).count() == 5 and snapshots.read_version(spark, root, 9) is None


def report(run_id, ts, **more):
    strategy = {"name": "exact", "total_queries": 4, "total_hits": 1, "hit_rate": 0.25}
    return {"run_id": run_id, "timestamp": ts, "num_questions": 4, "cache_capacity": 10, "strategies": [strategy], **more}


def test_reports_default_dataset_broken_file_and_order(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(report("a", 1.0), indent=2))
    (tmp_path / "b.json").write_text(json.dumps(report("b", 2.0, dataset="squad"), indent=2))
    (tmp_path / "c.json").write_text('{"run_id": "c", "strate')
    runs = reports.scan_run_reports(spark, str(tmp_path)).cache()
    rows = reports.report_summaries(runs).collect()
    assert [(r.run_id, r.dataset, r.num_strategies) for r in rows] == [("b", "squad", 1), ("a", "nq", 1)]
    assert reports.get_report(runs, "a").count() == 1 and reports.strategy_rows(runs).filter("hit_rate = 0.25").count() == 2
    reports.write_run_report(runs, str(tmp_path / "out"))
    back = reports.scan_run_reports(spark, str(tmp_path / "out"))
    assert sorted(r.run_id for r in back.collect()) == ["a", "b"]


def test_workload_readers(spark, tmp_path):
    df = spark.createDataFrame([("Q?", [{"text": "x"}])], "question string, answers array<struct<text:string>>")
    for fmt in ("json", "parquet", "orc"):
        df.write.format(fmt).save(str(tmp_path / fmt))
        rows = W.load_qa_workload(spark, str(tmp_path / fmt), fmt, "question STRING, answers ARRAY<STRUCT<text: STRING>>" if fmt == "json" else None)
        assert [(r.question, r.answer) for r in rows.collect()] == [("Q?", "x")]
