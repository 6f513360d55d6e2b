"""Rules on streams: the same rows however they arrive, and no state that says nothing any more."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from recollect.config import CacheConfig
from recollect.operators import sequential as SQ
from recollect.streaming import ordered as SO
from recollect.streaming import queries as Q


def files_of(df, path, files, shuffled, seed=1):
    """Rows dealt to files in order of time, or shuffled among neighbouring files."""
    rows = df.orderBy("seq").collect()
    order = sorted(range(len(rows)), key=lambda i: i + random.Random(seed * 1000 + i).uniform(0, 12)) if shuffled else range(len(rows))
    spark = df.sparkSession
    for k, part in enumerate(np.array_split(np.array(list(order)), files)):
        spark.createDataFrame([rows[i] for i in part.tolist()], df.schema).coalesce(1).write.mode("append").parquet(path)


def streamed(df, key, rule, tmp_path, name, files=10, per_trigger=1, shuffled=False, late="1 hour"):
    spark = df.sparkSession
    src, out, mark = (str(tmp_path / f"{name}-{n}") for n in ("in", "out", "mark"))
    files_of(df, src, files, shuffled)
    stream = Q.read_stream(spark, src, df.schema, files_per_batch=per_trigger)
    return SO.run_ordered(stream, key, rule, out, mark, late), mark


def calls(spark, n=120):
    rows = [("a" if i % 3 else "b", i, i % 10 > 5) for i in range(n)]
    df = spark.createDataFrame(rows, "dependency string, seq bigint, ok boolean")
    return df.withColumn("ts", F.timestamp_micros((F.col("seq") * 300_000 + 10**12).cast("bigint")))


@pytest.mark.parametrize(("files", "per_trigger", "shuffled"), [(1, 1, False), (10, 10, True), (10, 1, True)])
def test_breaker_does_not_depend_on_arrival(spark, tmp_path, files, per_trigger, shuffled):
    df = calls(spark)
    cfg = CacheConfig(breaker_failures=2, breaker_reset_s=2.0)
    got, _ = streamed(df, "dependency", SO.breaker_rule(cfg), tmp_path, "x", files, per_trigger, shuffled)
    cols = ["dependency", "seq", "ok", "state", "rejected", "state_after"]
    assert sorted(got.select(*cols).collect()) == sorted(SQ.breaker_states(df, cfg).select(*cols).collect())


def test_bucket_does_not_depend_on_arrival(spark, tmp_path):
    df = calls(spark).withColumnRenamed("dependency", "tenant_id").drop("ok")
    want = sorted(SQ.token_bucket(df, 1.0, 2).select("seq", "allowed", F.round("tokens", 9)).collect())
    for name, per_trigger in (("one", 1), ("ten", 10)):
        got, _ = streamed(df, "tenant_id", SO.bucket_rule(1.0, 2), tmp_path, name, 10, per_trigger, True)
        assert sorted(got.select("seq", "allowed", F.round("tokens", 9)).collect()) == want


def test_fusion_does_not_depend_on_arrival(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [("s" if i % 2 else "t", i, i, 700 * i + 10**6 + (5000 if i > 30 else 0), [float(x) for x in rng.standard_normal(4)]) for i in range(60)]
    df = spark.createDataFrame(rows, "session_id string, query_id bigint, seq bigint, s bigint, embedding array<float>")
    df = df.withColumn("ts", F.timestamp_seconds("s")).drop("s")
    got, _ = streamed(df, "session_id", SO.fusion_rule(), tmp_path, "x", 6, 2, True, "4 hours")
    cols = ["query_id", "turn", F.round(F.col("fused")[0], 9)]
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(map(tuple, SQ.session_fusion(df).select(*cols).collect()))


def test_late_requests_of_one_key_cover_each_other(spark, tmp_path):
    r = random.Random(2)
    rows = [(i, "t", r.choice(["one", "two", "three"])) for i in range(90)]
    df = spark.createDataFrame(rows, "seq bigint, tenant_id string, query_text string").withColumn("query_id", F.col("seq"))
    df = SO.keyed_requests(df.withColumn("ts", F.timestamp_seconds(F.col("seq") * 100 + 10**6)))
    want = set()
    last = {}
    for i, _, text in rows:
        if text not in last or (i - last[text]) * 100 >= 1000:
            last[text] = i
            want.add(i)
    for name, per_trigger in (("one", 1), ("ten", 10)):
        got, _ = streamed(df, "exact_key", SO.dedup_rule(1000), tmp_path, name, 10, per_trigger, True)
        assert {x.query_id for x in got.collect()} == want and got.count() == len(want)


def test_state_goes_after_its_time(spark, tmp_path):
    rows = [(i, f"text {i}", i * 100) for i in range(40)] + [(100, "much later", 10**6)]
    df = spark.createDataFrame(rows, "seq bigint, exact_key string, s bigint").withColumn("query_id", F.col("seq"))
    df = df.withColumn("ts", F.timestamp_seconds(F.col("s") + 10**6)).drop("s")
    got, mark = streamed(df, "exact_key", SO.dedup_rule(1000), tmp_path, "x", 8, 1)
    assert got.count() == 41
    left = spark.read.format("statestore").option("path", mark).option("stateVarName", "state").load()
    assert left.count() == 0
    pending = spark.read.format("statestore").option("path", mark).option("stateVarName", "pending").load()
    assert pending.count() == 1  # the last request still waits for the watermark


def test_calls_and_state_grow_with_parts_not_with_keys(spark, tmp_path, monkeypatch):
    from recollect.streaming import parts

    monkeypatch.setattr(parts, "PARTS", 3)
    rows = [(i, None if i % 7 == 0 else f"k{i % 29}", i % 5 > 2) for i in range(200)]
    df = spark.createDataFrame(rows, "seq bigint, dependency string, ok boolean").withColumn("ts", F.timestamp_seconds(F.col("seq") * 60 + 10**6))
    cfg = CacheConfig(breaker_failures=2, breaker_reset_s=600.0)
    got, mark = streamed(df, "dependency", SO.breaker_rule(cfg), tmp_path, "x", 5, 1, True)
    cols = ["seq", "ok", "state", "rejected", "state_after"]
    want = SQ.breaker_states(df.fillna("none", ["dependency"]), cfg)
    assert sorted(got.select(*cols).collect()) == sorted(want.select(*cols).collect())
    assert {r.seq for r in got.filter("dependency IS NULL").collect()} == set(range(0, 200, 7))
    left = spark.read.format("statestore").option("path", mark).option("stateVarName", "state").load()
    assert left.count() <= 4  # three parts and that of null


def test_a_covered_request_of_no_key_waits_without_output(spark, tmp_path):
    df = spark.createDataFrame([(i, None, i) for i in range(3)], "seq bigint, exact_key string, query_id bigint").withColumn("ts", F.timestamp_seconds(F.col("seq") * 5000 + 10**6))
    got, _ = streamed(df, "exact_key", SO.dedup_rule(20_000), tmp_path, "x", 1, 1)
    assert [r.query_id for r in got.collect()] == [0]


def test_rows_later_than_allowed_are_dropped(spark, tmp_path):
    df = calls(spark, 60)
    src, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    for part in (df.filter("seq >= 20"), df.filter("seq >= 20").limit(0), df.filter("seq < 20")):
        part.coalesce(1).write.mode("append").parquet(src)
        stream = Q.read_stream(spark, src, df.schema)
        got = SO.run_ordered(stream, "dependency", SO.breaker_rule(), out, mark, "1 second")
    assert {r.seq for r in got.collect()} == set(range(20, 60))


def test_open_windows_and_sessions_come_from_the_state(spark, tmp_path):
    rows = [(i, i % 3, 10**6 + 900 * i + (20_000 if i > 30 else 0), i % 2 == 0, i % 2 + 1, None if i % 7 == 0 else float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "seq bigint, session_id bigint, s bigint, hit boolean, tier int, latency_ms double")
    df = df.withColumn("ts", F.timestamp_seconds("s"))
    src = str(tmp_path / "in")
    files_of(df, src, 5, False)
    stream = lambda: Q.read_stream(spark, src, df.schema, files_per_batch=2)
    windows, sessions = str(tmp_path / "w"), str(tmp_path / "s")
    got = Q.run_available(Q.stream_metrics(stream()), windows, windows + "-mark")
    still = Q.open_windows(spark, windows + "-mark")
    want = Q.stream_metrics(df)
    assert got.count() and still.count() and sorted(map(tuple, got.unionByName(still).collect())) == sorted(map(tuple, want.collect()))
    got = Q.run_available(Q.stream_sessions(stream()), sessions, sessions + "-mark")
    still = Q.open_sessions(spark, sessions + "-mark")
    assert still.count() and sorted(map(tuple, got.unionByName(still).collect())) == sorted(map(tuple, Q.stream_sessions(df).collect()))


def test_window_equals_a_list(spark):
    from recollect.operators import machines as MC

    r = random.Random(6)
    for most, delta in ((25, 2.0), (40, 30.0), (5000, 0.5)):
        window, plain = MC.Window([], most), []
        for i in range(400):
            value = float(r.random() < (0.9 if i // 60 % 2 else 0.2))
            plain = [*plain, value][-most:]
            cut = MC.Window(plain, most).split(delta)
            plain = plain[cut:]
            assert window.add(value, delta) == cut and window.kept() == plain
        assert MC.Window(window.kept(), most).split(delta) == window.split(delta)
