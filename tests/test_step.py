"""The batch step against one-by-one processing, replay, and the stream around it."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from recollect.config import CacheConfig
from recollect.functions import text as T
from recollect.operators import bandit as B
from recollect.operators import step as ST
from recollect.sources import snapshots
from recollect.streaming.cache import stream_cache

X, Y, Z = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]
NEAR_X = [0.95, 0.3122, 0.0]


def now():
    return F.lit("2024-01-01 00:00:00").cast("timestamp")


CFG = CacheConfig(capacity=2, window_fraction=1.0, ttl_s=0, default_threshold=0.9, min_threshold=0.6)


def queries(spark, rows):
    df = spark.createDataFrame(rows, "query_id bigint, tenant_id string, query_text string, embedding array<float>")
    return df.select(
        "query_id", F.col("query_id").alias("seq"), "tenant_id", F.lit(None).cast("string").alias("session_id"),
        F.timestamp_seconds(F.lit(1_704_067_200) + F.col("query_id")).alias("ts"), "query_text", "embedding",
    )


def responses(spark, texts):
    df = spark.createDataFrame([(t, f"answer to {t}", 1000.0 * (i + 1)) for i, t in enumerate(texts)], "t string, r string, ms double")
    return df.select(
        T.exact_key(F.col("t"), F.lit("t")).alias("exact_key"), F.col("r").alias("response_text"), F.lit(3).cast("bigint").alias("output_tokens"),
        (F.col("ms") / 1e6).alias("cost_usd"), F.col("ms").alias("latency_ms"),
    )


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("cache"))
    answers = responses(spark, ["alpha", "beta", "gamma"])
    first = queries(spark, [
        (1, "t", "Alpha?", X), (2, "t", "alpha", X), (3, "t", "beta", Y), (4, "t", "unknown", Z), (5, "t", "ALPHA!", X),
    ])
    second = queries(spark, [(6, "t", "like alpha", NEAR_X), (7, "t", "beta", Y), *[(i, "t", "gamma", Z) for i in (8, 9, 10, 11)]])
    a = ST.cache_step(spark, root, 0, first, answers, now(), 3, None, CFG)
    b = ST.cache_step(spark, root, 1, second, answers, now(), 3, None, CFG)
    return root, answers, second, {r.query_id: r for r in a.collect()}, {r.query_id: r for r in b.collect()}


def test_repeats_inside_a_batch_hit_the_first(steps):
    _, _, _, a, _ = steps
    assert (a[1].hit, a[1].tier, a[1].latency_ms) == (False, 0, 1000.0)
    assert (a[2].hit, a[2].tier, a[2].entry_id) == (True, 1, a[1].entry_id) and a[5].entry_id == a[1].entry_id
    assert a[4].error and not a[4].hit and a[4].entry_id is None


def test_second_batch_hits_and_evicts(spark, steps):
    root, _, _, a, b = steps
    assert (b[6].hit, b[6].tier, b[6].entry_id) == (True, 2, a[1].entry_id) and b[6].threshold_used == 0.9
    assert (b[7].hit, b[7].tier) == (True, 1)
    # Alpha was seen 4 times by then; gamma is let in when it has been asked as often.
    assert all(b[i].admission_rejected and not b[i].hit for i in (8, 9, 10)) and not b[11].hit and b[11].eviction_triggered
    kept = {r.entry_id: r for r in ST.read_entries(spark, root).collect()}
    assert len(kept) == 2 and b[11].entry_id in kept and kept[b[11].entry_id].frequency == 1
    # alpha (4 uses x 1000 / 15 bytes) is worth less than beta (2 uses x 2000 / 14 bytes).
    assert a[3].entry_id in kept and kept[a[3].entry_id].frequency == 2
    state = snapshots.read_version(spark, f"{root}/state").head()
    assert state.evicted == 1 and state.inflation > 0
    assert kept[b[11].entry_id].priority > state.inflation


def test_replayed_batch_writes_the_same(spark, steps):
    root, answers, second, _, b = steps
    before = sorted(map(str, ST.read_entries(spark, root).drop("embedding").collect()))
    again = {r.query_id: r for r in ST.cache_step(spark, root, 1, second, answers, now(), 3, None, CFG).collect()}
    assert again == b
    assert sorted(map(str, ST.read_entries(spark, root).drop("embedding").collect())) == before
    assert snapshots.versions(spark, f"{root}/entries") == [1, 2]


def test_stream_equals_batches(spark, steps, tmp_path):
    _, answers, second, a, b = steps
    src, root = str(tmp_path / "in"), str(tmp_path / "cache")
    first = queries(spark, [
        (1, "t", "Alpha?", X), (2, "t", "alpha", X), (3, "t", "beta", Y), (4, "t", "unknown", Z), (5, "t", "ALPHA!", X),
    ])
    for part in (first, second):  # the same folder and checkpoint, one more file per run
        part.coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(first.schema).parquet(src)
        stream_cache(stream, answers, root, str(tmp_path / "progress"), 3, None, CFG, now=now()).awaitTermination()
    got = {r.query_id: (r.hit, r.tier, r.entry_id) for r in ST.read_log(spark, root).collect()}
    assert got == {q: (r.hit, r.tier, r.entry_id) for q, r in {**a, **b}.items()}


def test_feedback_step(spark):
    old = spark.createDataFrame([("a", 0, 0.9, True), ("a", 1, 0.9, True), ("b", 2, 0.7, True)],
                                "entry_id string, seq bigint, similarity double, was_correct boolean")
    new = spark.createDataFrame([("a", 3, 0.92, True, "s"), ("zz", 4, 0.9, True, "s"), ("a", 5, 0.95, False, "s")],
                                "entry_id string, seq bigint, similarity double, was_correct boolean, shard_id string")
    entries = spark.createDataFrame([("a",), ("b",)], "entry_id string")
    rewards = spark.createDataFrame([("s", 2, 0, 1.0)], "shard_id string, arm int, seq bigint, reward double")
    log, tau, post = ST.feedback_step(old, new, entries, B.bandit_posterior(rewards))
    assert log.count() == 5
    assert {r.entry_id: r.threshold for r in tau.collect()} == {"a": 0.60}
    arm = post.filter("arm = 2").head()
    assert (arm.alpha, arm.beta, arm.updates) == (3.0, 2.0, 3)


def test_rare_newcomer_is_refused(spark, steps, tmp_path):
    _, answers, _, _, _ = steps
    root = str(tmp_path)
    cfg = CacheConfig(capacity=1, window_fraction=1.0, ttl_s=0, default_threshold=0.9)
    ST.cache_step(spark, root, 0, queries(spark, [(1, "t", "alpha", X), (2, "t", "alpha", X)]), answers, now(), 3, None, cfg)
    log = ST.cache_step(spark, root, 1, queries(spark, [(3, "t", "gamma", Z)]), answers, now(), 3, None, cfg).head()
    assert log.admission_rejected and not log.hit and log.entry_id is None
    assert [r.query_text for r in ST.read_entries(spark, root).collect()] == ["alpha"]


def plain_step(batch_id, batch, cache, counts, inflation, costs, size, capacity):
    """One batch by hand; texts with vectors of their own, so only exact hits occur."""
    held = sorted(cache.values(), key=lambda e: (e["batch"], e["seq"]))[-size:]
    held, holders, out = [(e["id"], e["text"]) for e in held], {}, {}
    stored = {e["text"]: e for e in cache.values()}
    new = {}
    for q, text in batch:
        if text in stored or text in holders:
            e = stored.get(text) or new[holders[text]]
            out[q] = ("hit", e["id"])
            e["used"] = e.get("used", 0) + 1
            counts[text] = counts.get(text, 0) + 1
            continue
        if text not in costs:
            out[q] = ("error", None)
            continue
        counts[text] = counts.get(text, 0) + 1
        if len(held) >= size and counts[text] < counts.get(held[0][1], 0):
            out[q] = ("refused", None)
            continue
        if len(held) >= size:
            held.pop(0)
        e = {"id": f"e{q}", "text": text, "batch": batch_id, "seq": q % 1000, "frequency": 1}
        held.append((e["id"], text))
        holders[text], new[e["id"]], out[q] = e["id"], e, ("stored", e["id"])
    worth = lambda e, level: e["frequency"] * (costs[e["text"]] * 1e6) / len(f"answer to {e['text']}") + level
    for e in cache.values():
        if e.pop("used", 0):
            e["frequency"] = e["frequency"] + sum(o == ("hit", e["id"]) for o in out.values())
            e["priority"] = worth(e, inflation)
    over = max(0, len(cache) + len(new) - capacity)
    for pool in (cache, new):
        for e in pool.values():
            if pool is new:
                e["frequency"] = 1 + sum(o == ("hit", e["id"]) for o in out.values())
                e["priority"] = worth(e, inflation)
                e.pop("used", None)
        gone = sorted(pool.values(), key=lambda e: (e["priority"], e["id"]))[:over]
        over -= len(gone)
        for e in gone:
            inflation = max(inflation, e["priority"]) if e is not gone[-1] else e["priority"]
            del pool[e["id"]]
    return {**cache, **new}, inflation, out


def test_batches_equal_a_plain_loop(spark, tmp_path):
    """Overlapping seq, and a batch with more new texts than the capacity."""
    import random

    r = random.Random(5)
    texts = ["text " + "abcdefghijklmnop"[i] for i in range(16)]
    vectors = {t: [1.0 if i == k else 0.0 for k in range(16)] for i, t in enumerate(texts)}
    answers = responses(spark, texts[:14])
    costs = {t: 1000.0 * (i + 1) / 1e6 for i, t in enumerate(texts[:14])}
    cfg = CacheConfig(capacity=4, window_fraction=0.5, ttl_s=0, default_threshold=0.9, min_threshold=0.6, lsh_tables=1, lsh_bits=24)
    cache, counts, inflation, root = {}, {}, 0.0, str(tmp_path)
    for b in range(3):
        asked = [(1000 * b + i, texts[min(r.randint(0, 15), r.randint(0, 15))]) for i in range(25)]
        if b == 1:
            asked = [(1000 * b + i, t) for i, t in enumerate(texts * 2)]
        cache, inflation, want = plain_step(b, asked, cache, counts, inflation, costs, 2, 4)
        rows = queries(spark, [(q, "t", t, vectors[t]) for q, t in asked]).withColumn("seq", F.col("query_id") % 1000)
        log = ST.cache_step(spark, root, b, rows, answers, now(), 16, None, cfg).collect()
        kind = lambda x: "hit" if x.hit else "error" if x.error else "refused" if x.admission_rejected else "stored"
        assert {x.query_id: (kind(x), x.entry_id) for x in log} == want
        assert sorted(x.entry_id for x in ST.read_entries(spark, root).collect()) == sorted(cache)


def test_texts_wait_until_it_is_known_what_is_stored(spark, tmp_path, monkeypatch):
    seen, keep = [], ST.checkpointed

    def checkpointed(df):
        seen.append(df)
        return keep(df)

    monkeypatch.setattr(ST, "checkpointed", checkpointed)
    asked = queries(spark, [(1, "t", "Alpha?", X), (2, "t", "alpha", X), (3, "t", "beta", Y), (4, "t", "unknown", Z)])
    ST.cache_step(spark, str(tmp_path), 0, asked, responses(spark, ["alpha", "beta"]), now(), 3, None, CFG)
    assert seen and not any(name in df.schema.simpleString() for df in seen for name in ("query_text", "response_text"))
    stored = {r.entry_id: (r.query_text, r.response_text, r.storage_bytes) for r in ST.read_entries(spark, str(tmp_path)).collect()}
    assert stored == {"e1": ("Alpha?", "answer to alpha", 15), "e3": ("beta", "answer to beta", 14)}
