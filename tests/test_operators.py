"""Operators on small fixtures with results worked out by hand or by a plain loop."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from recollect.config import CacheConfig
from recollect.operators import bandit as B
from recollect.operators import calibration as C
from recollect.operators import drift as D
from recollect.operators import lookup as L
from recollect.operators import maintenance as MA
from recollect.operators import metrics as M
from recollect.operators import replication as RP
from recollect.operators import retention as R
from recollect.operators import sequential as SQ
from recollect.operators import sessions as SE
from recollect.operators import workload as W


def feedback(spark, rows):
    return spark.createDataFrame(
        [(e, i, float(s), ok) for i, (e, s, ok) in enumerate(rows)], "entry_id string, seq bigint, similarity double, was_correct boolean"
    )


def taus(spark, rows, **kw):
    return {r.entry_id: r.threshold for r in C.conformal_thresholds(feedback(spark, rows), **kw).collect()}


def test_thresholds_by_number_of_scores(spark):
    rows = [("two", 0.9, True)] * 2 + [("three", 0.92, True)] * 3
    rows += [("n38", 0.7 + i / 1000, True) for i in range(38)] + [("n39", 0.7 + i / 1000, True) for i in range(39)]
    rows += [("wrong", 0.92, True)] * 5 + [("wrong", 0.82, False)] + [("high", 0.999, True)] * 4
    got = taus(spark, rows)
    assert got["two"] == 0.70 and got["three"] == pytest.approx(0.92) and got["high"] == 0.99
    assert got["n38"] == pytest.approx(0.70) and C.quantile_position(38) == 37
    assert got["n39"] == pytest.approx(0.701 if C.quantile_position(39) == 37 else 0.70)
    assert got["wrong"] == 0.60
    assert taus(spark, rows, mode="strict")["wrong"] == pytest.approx(0.82, abs=1e-5)


def test_only_the_newest_scores_count(spark):
    rows = [("e", 0.65, True)] * 5 + [("e", 0.95, True)] * 20
    assert taus(spark, rows, cfg=CacheConfig(max_scores=20))["e"] == pytest.approx(0.95)
    trace = C.threshold_trace(feedback(spark, rows), CacheConfig(max_scores=20)).collect()
    by_seq = {r.seq: r.threshold for r in trace}
    assert by_seq[1] == 0.70 and by_seq[4] == pytest.approx(0.65) and by_seq[24] == pytest.approx(0.95)


def test_stats_of_no_feedback(spark):
    row = C.calibration_stats(feedback(spark, [("e", 1, True)]).filter("false")).head()
    assert row.total_entries == 0 and row.total_updates == 0


def test_global_threshold_before_any_hit(spark):
    hits = spark.createDataFrame([], "seq bigint, similarity double")
    assert C.learned_global_threshold(hits).head()[0] == 0.82


def test_posterior_skips_half_and_respects_reset(spark):
    rows = [("s", 0, 0, 1.0), ("s", 0, 1, 0.5), ("s", 0, 2, 0.25), ("s", 1, 3, 0.0), ("t", 2, 4, 1.0)]
    df = spark.createDataFrame(rows, "shard_id string, arm int, seq bigint, reward double")
    got = {(r.shard_id, r.arm): (r.alpha, r.beta) for r in B.bandit_posterior(df).collect()}
    assert got["s", 0] == (2.25, 1.75) and got["s", 1] == (1.0, 2.0) and got["s", 9] == (1.0, 1.0) and len(got) == 20
    resets = spark.createDataFrame([("s", 1)], "shard_id string, reset_seq bigint")
    got = {(r.shard_id, r.arm): (r.alpha, r.beta) for r in B.bandit_posterior(df, resets).collect()}
    assert got["s", 0] == (2.25, 2.75) and got["s", 5] == (2.0, 2.0) and got["t", 2] == (2.0, 1.0)
    best = {r.shard_id: r.best_arm for r in B.best_arm(B.bandit_posterior(df)).collect()}
    assert best == {"s": 0, "t": 2}


def test_merge_of_equal_shards_changes_nothing(spark):
    rows = [(s, a, 0, 1.0) for s in "ab" for a in range(3)]
    post = B.bandit_posterior(spark.createDataFrame(rows, "shard_id string, arm int, seq bigint, reward double"))
    merged = {r.arm: (r.alpha, r.beta) for r in B.fedavg_merge(post).collect()}
    own = {r.arm: (r.alpha, r.beta) for r in post.filter("shard_id = 'a'").collect()}
    assert merged == own


def series(spark, values):
    return spark.createDataFrame([("k", i, float(v)) for i, v in enumerate(values)], "key string, seq bigint, reward double")


def test_drift_scan_and_windows(spark):
    shift = [0.9] * 80 + [0.1] * 80
    row = D.drift_scan(series(spark, shift), ["key"], 0.1).head()
    assert row.n == 160 and row.first_split is not None and row.max_margin > 0
    assert D.drift_scan(series(spark, [0.5] * 100), ["key"], 0.1).head().first_split is None
    assert D.drift_scan(series(spark, shift[:19]), ["key"]).count() == 0
    out = SQ.drift_windows(series(spark, shift), ["key"], CacheConfig(drift_delta=0.1, drift_window=200)).collect()
    naive, window = [], []
    for v in shift:
        window.append(v)
        cut, n = 0, len(window)
        if n >= 20:
            for left in range(10, n - 9):
                m = 1 / left + 1 / (n - left)
                if abs(np.mean(window[:left]) - np.mean(window[left:])) >= math.sqrt(0.5 * m * math.log(4 * n / 0.1)):
                    cut = left
                    break
        window = window[cut:]
        naive.append((cut > 0, cut, len(window)))
    assert [(r.changed, r.cut, r.window_size) for r in sorted(out, key=lambda r: r.seq)] == naive
    assert any(c for c, _, _ in naive)


def test_bandit_updates_pick_the_best_arm_and_reset(spark):
    rows = [("s", i, None, 0.9 if i < 80 else 0.1) for i in range(160)] + [("s", 160, 3, 0.5)]
    df = spark.createDataFrame(rows, "shard_id string, seq bigint, arm int, reward double")
    out = sorted(SQ.bandit_updates(df, CacheConfig(drift_delta=0.1)).collect(), key=lambda r: r.seq)
    assert out[0].used_arm == 0 and out[0].alpha == pytest.approx(1.9)
    assert out[-1].resets >= 1 and out[-1].used_arm == 3
    reset = SQ.resets_of(SQ.bandit_updates(df, CacheConfig(drift_delta=0.1))).head()
    assert reset.reset_seq == max(r.seq for r in out if r.reset)


def test_thompson_is_repeatable_and_prefers_good_arms(spark):
    rows = [("s", a, 0.65, 500.0 if a == 4 else 1.0, 1.0 if a == 4 else 500.0, 0) for a in range(10)]
    post = spark.createDataFrame(rows, "shard_id string, arm int, threshold double, alpha double, beta double, updates int")
    a, b = SQ.thompson_sample(post, 1).head(), SQ.thompson_sample(post, 1).head()
    assert a == b and a.arm == 4


def at(df, col="offset_s"):
    return df.withColumn("ts", F.timestamp_micros((F.col(col) * 1_000_000).cast("bigint")))


def test_token_bucket_pieces_equal_one_chain(spark):
    rng = random.Random(3)
    t, rows = 0.0, []
    for i in range(300):
        t += rng.choice([0.01, 0.05, 0.2, 3.0])
        rows.append(("a" if i % 5 else "b", i, round(t, 3)))
    df = at(spark.createDataFrame(rows, "tenant_id string, seq bigint, offset_s double"))
    got = {r.seq: (r.allowed, round(r.tokens, 6)) for r in SQ.token_bucket(df, 2.0, 3).collect()}
    state = {}
    for tenant, seq, tm in rows:
        tokens, last = state.get(tenant, (3.0, tm))
        tokens = min(3.0, tokens + (tm - last) * 2.0)
        ok = tokens >= 1
        tokens -= ok
        state[tenant] = (tokens, tm)
        assert got[seq][0] == ok and got[seq][1] == pytest.approx(tokens, abs=1e-5)
    assert any(not a for a, _ in got.values())


def test_breaker_pieces_equal_one_chain(spark):
    rng = random.Random(4)
    t, rows = 0.0, []
    for i in range(300):
        t += rng.choice([1.0, 2.0, 40.0])
        rows.append(("d", i, t, rng.random() < 0.35))
    df = at(spark.createDataFrame(rows, "dependency string, seq bigint, offset_s double, ok boolean"))
    got = {r.seq: (r.state, r.rejected, r.state_after) for r in SQ.breaker_states(df, CacheConfig(breaker_failures=3)).collect()}
    phase, count, failed = "closed", 0, 0.0
    for _, seq, tm, ok in rows:
        if phase == "open" and tm - failed >= 30:
            phase = "half_open"
        seen = phase
        if seen != "open":
            if ok:
                phase, count = "closed", 0
            else:
                count, failed = count + 1, tm
                phase = "open" if count >= 3 else phase
        assert got[seq] == (seen, seen == "open", phase)
    assert {g[0] for g in got.values()} == {"closed", "open", "half_open"}


def turns(spark, rows):
    return at(spark.createDataFrame(rows, "session_id string, query_id bigint, seq bigint, offset_s double, embedding array<float>"))


def test_session_fusion_blends_and_resets(spark):
    x, y = [1.0, 0.0], [0.0, 1.0]
    rows = [("s", 0, 0, 0.0, x), ("s", 1, 1, 10.0, y), ("s", 2, 2, 1810.0, x), ("s", 3, 3, 3611.0, y)]
    got = {r.query_id: r for r in SQ.session_fusion(turns(spark, rows)).collect()}
    fused = np.array([0.15, 0.85]) / np.linalg.norm([0.15, 0.85])
    assert got[0].fused == x and got[1].fused == pytest.approx(fused.tolist())
    ctx = np.array([0.5, 0.5]) / np.linalg.norm([0.5, 0.5])
    assert got[1].context == pytest.approx(ctx.tolist())
    assert got[2].turn == 3  # idle exactly 1800 s: still the same session
    assert got[3].turn == 1 and got[3].fused == y  # idle 1801 s: starts afresh


def test_session_context_carries_over(spark):
    rows = [("s", i, i, 10.0 * i, [math.cos(i), math.sin(i)]) for i in range(4)]
    whole = {r.query_id: r.fused for r in SQ.session_fusion(turns(spark, rows)).collect()}
    first = SQ.session_fusion(turns(spark, rows[:2]))
    carried = SQ.last_contexts(first).withColumn("seq", F.lit(-1).cast("bigint"))
    rest = {r.query_id: r.fused for r in SQ.session_fusion(turns(spark, rows[2:]), contexts=carried).collect()}
    assert rest[2] == pytest.approx(whole[2], abs=1e-6) and rest[3] == pytest.approx(whole[3], abs=1e-6)


def test_chat_history_counts_system_rows(spark):
    rows = [(i, "s", r, f"m{i}") for i, r in enumerate(["user", "assistant", "system", "user", "system", "assistant"])]
    df = spark.createDataFrame(rows, "id bigint, session_id string, role string, text string").withColumn(
        "created_at", F.lit("2024-01-01").cast("timestamp")
    )
    h = SE.chat_history(df, max_turns=2).head().history
    assert [(x.role, x.content) for x in h] == [("user", "m3"), ("assistant", "m5")]


def test_message_title_and_bad_meta(spark):
    row = spark.range(1).select(
        SE.title_of(F.lit("x" * 51)).alias("long"), SE.title_of(F.lit("x" * 50)).alias("short"),
        SE.parse_meta(F.lit("{broken")).alias("bad"),
    ).head()
    assert row.long == "x" * 50 + "…" and row.short == "x" * 50 and (row.bad is None or row.bad.tier is None)


def lru_distances(keys):
    out, order = [], []
    for k in keys:
        out.append(len(order) - 1 - order.index(k) if k in order else None)
        if k in order:
            order.remove(k)
        order.append(k)
    return out


def test_reuse_distance_equals_a_real_stack(spark):
    rng = random.Random(7)
    keys = [rng.choice("aaab") if rng.random() < 0.5 else rng.choice("bcdefgh") for _ in range(150)]
    df = spark.createDataFrame([("t", i, k) for i, k in enumerate(keys)], "tenant_id string, seq bigint, key string")
    got = [r.distance for r in sorted(M.reuse_distance(df, ["tenant_id"], "key").collect(), key=lambda r: r.seq)]
    assert got == lru_distances(keys)
    narrow = M.reuse_distance(df, ["tenant_id"], "key", width=16)  # many windows, whose sums carry over
    assert [r.distance for r in sorted(narrow.collect(), key=lambda r: r.seq)] == got


def entries(spark, n, tenant="t"):
    rows = [(tenant, f"e{i:02d}", i, (i * 7) % 5 + 1, 0.001 * (i % 3), 1.0, 100, i) for i in range(n)]
    df = spark.createDataFrame(rows, "tenant_id string, entry_id string, seq bigint, frequency bigint, llm_cost_usd double, "
                                     "embed_cost_ms double, storage_bytes bigint, used bigint")
    return R.with_priority(df.withColumn("last_access", F.timestamp_seconds("used")))


def quota(spark, n):
    return spark.createDataFrame([("t", n)], "tenant_id string, n bigint")


def test_evicting_n_equals_evicting_one_n_times(spark):
    e = entries(spark, 12)
    at_once = {r.entry_id for r in R.evict_lowest(e, quota(spark, 3))[0].collect()}
    kept, one_by_one = e, set()
    for _ in range(3):
        gone, kept, _ = R.evict_lowest(kept, quota(spark, 1))
        one_by_one |= {r.entry_id for r in gone.collect()}
    assert at_once == one_by_one
    _, left, level = R.evict_lowest(e, quota(spark, 3))
    assert left.count() == 9 and level.head().inflation == max(r.priority for r in e.collect() if r.entry_id in at_once)


def gate_rows(spark, rows):
    return spark.createDataFrame(rows, "tenant_id string, entry_id string, seq bigint, bucket string")


def test_admission_follows_the_one_by_one_rule(spark):
    # Window rows come first whatever their seq.
    window = gate_rows(spark, [("t", "w0", 8, "rare"), ("t", "w1", 9, "often")])
    new = gate_rows(spark, [("t", "c0", 0, "often"), ("t", "c1", 1, "rare"), ("t", "c2", 2, "often")])
    freq = spark.createDataFrame([("rare", 1), ("often", 5)], "bucket string, frequency bigint")
    got = {r.entry_id: (r.new_frequency, r.victim_id, r.victim_frequency, r.admitted) for r in R.admission_gate(new, window, freq, 2).collect()}
    # After c1 is refused the same victim stays in front; counts are those at the time of asking.
    assert got == {"c0": (6, "w0", 1, True), "c1": (2, "w1", 6, False), "c2": (7, "w1", 7, True)}
    free = R.admission_gate(new, window, freq, 10).collect()
    assert all(r.admitted and r.victim_id is None for r in free)


def test_admission_of_repeated_keys_and_accesses(spark):
    window = gate_rows(spark, [("t", "w0", 0, "a")])
    freq = spark.createDataFrame([("a", 2)], "bucket string, frequency bigint")
    asks = gate_rows(spark, [("t", f"c{i}", i, "b") for i in range(1, 6)]).withColumn("key", F.lit("same"))
    hits = spark.createDataFrame([("t", 2, "a")], "tenant_id string, seq bigint, bucket string")
    got = {r.entry_id: (r.new_frequency, r.victim_frequency, r.admitted, r.holder_id) for r in R.admission_gate(asks, window, freq, 1, accesses=hits).collect()}
    assert got == {"c1": (1, 2, False, None), "c2": (2, 3, False, None), "c3": (3, 3, True, None), "c4": (4, None, False, "c3"), "c5": (5, None, False, "c3")}


@pytest.mark.parametrize("shards", [1, 3])
def test_admission_equals_a_plain_loop(spark, shards):
    import random
    from collections import defaultdict, deque

    r = random.Random(shards)
    rows = [("t", f"c{i}", i, f"b{min(r.randint(0, 12), r.randint(0, 12))}") for i in range(400)]
    held = [("t", f"w{i}", i, f"b{r.randint(0, 12)}") for i in range(30)]
    base = {f"b{i}": r.randint(0, 9) for i in range(10)}
    size, shard = 9, lambda b: int(__import__("hashlib").md5(b.encode()).hexdigest()[:4], 16) % shards
    lines, want = defaultdict(deque), {}
    counts = defaultdict(int, base)
    for _, i, _, b in held:
        lines[shard(b)].append((i, b))
    for line in lines.values():
        while len(line) > size // shards:
            line.popleft()
    for _, i, _, b in rows:
        counts[b] += 1
        line = lines[shard(b)]
        victim = line[0] if len(line) >= size // shards else None
        want[i] = (victim and victim[0], victim is None or counts[b] >= counts[victim[1]])
        if want[i][1]:
            if victim:
                line.popleft()
            line.append((i, b))
    freq = spark.createDataFrame(list(base.items()), "bucket string, frequency bigint")
    got = R.admission_gate(gate_rows(spark, rows), gate_rows(spark, held), freq, size, shards=shards)
    assert {x.entry_id: (x.victim_id, x.admitted) for x in got.collect()} == want


def test_segments(spark):
    e = entries(spark, 12).withColumn("used_since", F.col("seq") % 2 == 0)
    cfg = CacheConfig(capacity=6, window_fraction=0.34)  # window 2, main 4, protected 3
    got = {r.entry_id: r.segment for r in R.segment_entries(e, cfg).collect()}
    assert got["e11"] == got["e10"] == "window"
    assert {k for k, v in got.items() if v == "protected"} == {"e08", "e06", "e04"}
    assert got["e02"] == got["e09"] == "probation"


def test_upsert_takes_the_last_copy(spark):
    old = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "entry_id int, v string, version int")
    new = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "entry_id int, v string, version int")
    got = {r.entry_id: r.v for r in MA.upsert(old, new, ["entry_id"], ["version"]).collect()}
    assert got == {1: "a", 2: "d", 3: "e"}


def test_compaction_waits_for_enough_removals(spark):
    e = spark.createDataFrame([(i,) for i in range(5)], "entry_id int")
    gone = spark.createDataFrame([(1,), (2,)], "entry_id int")
    assert MA.snapshot_compact(e, gone).count() == 3
    assert MA.compaction_due(gone, 2) and not MA.compaction_due(gone, 3)


def test_expiry_boundary_in_lookup_and_load(spark):
    e = spark.sql("SELECT 1 AS entry_id, timestamp'2024-01-01' AS expires_at UNION ALL SELECT 2, NULL")
    now = F.lit("2024-01-01").cast("timestamp")
    assert L.live(e, now).count() == 2 and MA.load_live_entries(e, now).count() == 1


def oplog(spark, rows):
    df = spark.createDataFrame([(i + 1, op, e, p.encode()) for i, (op, e, p) in enumerate(rows)], "lsn bigint, op int, entry_id string, payload binary")
    return df.withColumn("crc", RP.record_crc(F.col("lsn"), F.col("op"), F.col("payload")))


def test_oplog_checksum_and_replay(spark):
    import struct
    import zlib

    log = oplog(spark, [(1, "a", "v1"), (1, "b", "v2"), (2, "b", ""), (1, "a", "v3"), (4, "a", "0.8"), (3, "c", ""), (1, "d", "v4")])
    first = log.filter("lsn = 1").head()
    assert first.crc == zlib.crc32(struct.pack("!IQB", 3, 1, 1) + b"v1")
    got = {r.entry_id: (bytes(r.payload), r.threshold and bytes(r.threshold)) for r in RP.replay_oplog(log).collect()}
    assert got == {"a": (b"v3", b"0.8"), "d": (b"v4", None)}
    broken = log.withColumn("crc", F.when(F.col("lsn") == 4, F.col("crc") + 1).otherwise(F.col("crc")))
    assert {r.entry_id: bytes(r.payload) for r in RP.replay_oplog(broken).collect()}["a"] == b"v1"
    status = RP.oplog_status(broken).head()
    assert (status.current_lsn, status.intact, status.broken) == (7, 6, 1)
    assert [r.lsn for r in RP.checkpoint_oplog(log, 5).orderBy("lsn").collect()] == [6, 7]


def clock(spark, rows):
    return spark.createDataFrame(rows, "entry_id int, clock map<string,bigint>")


def test_clocks(spark):
    a = clock(spark, [(1, {"n1": 3, "n2": 1}), (2, {"n1": 1}), (3, {"n1": 2}), (4, {"n1": 1})])
    b = clock(spark, [(1, {"n1": 1, "n2": 5}), (2, {"n1": 1, "n2": 1}), (3, {"n1": 2}), (4, {})])
    got = {r.entry_id: (r.relation, r.is_concurrent) for r in RP.clock_order(a, b).collect()}
    assert got == {1: ("concurrent", True), 2: ("before", False), 3: ("equal", True), 4: ("after", False)}
    both = a.unionByName(b)
    merged = {r.entry_id: r.clock for r in RP.merge_clocks(both).collect()}
    assert merged[1] == {"n1": 3, "n2": 5}
    again = {r.entry_id: r.clock for r in RP.merge_clocks(RP.merge_clocks(both).unionByName(both)).collect()}
    assert again == merged


def test_ring_against_a_plain_walk(spark):
    nodes = ["node-1", "node-2", "node-3", "node-4"]
    ring = sorted((int.from_bytes(hashlib.sha256(f"{n}#vn{i}".encode()).digest()[:8], "big"), n) for n in nodes for i in range(5))

    def walk(key):
        pos = int.from_bytes(hashlib.sha256(key.encode()).digest()[:8], "big")
        start = next((i for i, (p, _) in enumerate(ring) if p > pos), 0)
        return list(dict.fromkeys(ring[(start + j) % len(ring)][1] for j in range(len(ring))))[:3]

    keys = [f"key-{i}" for i in range(400)]
    df = spark.createDataFrame([(k,) for k in keys], "key string")
    got = {r.key: (r.node, list(r.replicas)) for r in RP.ring_assign(df, "key", nodes, vnodes=5).collect()}
    assert got == {k: (walk(k)[0], walk(k)) for k in keys}
    moved = RP.ring_rebalance(df, "key", nodes[:3], nodes).filter("moved").agg(F.sum("keys"), F.min("to_node")).head()
    assert moved[0] < 250 and moved[1] == "node-4"
    assert RP.ring_assign(df, "key", []).count() == 0


def test_feedback_of_unknown_entry_is_refused(spark):
    fb = feedback(spark, [("known", 0.9, True), ("other", 0.9, True)])
    e = spark.createDataFrame([("known",)], "entry_id string")
    assert {r.entry_id: r.status for r in L.feedback_join(fb, e).collect()} == {"known": "ok", "other": "error"}


def test_two_tenants_with_the_same_text(spark):
    rows = [("q1", 1, "t1", "Hello!", [1.0, 0.0]), ("q2", 2, "t2", "hello", [1.0, 0.0]), ("q3", 3, "t1", "other", [0.7, 0.714])]
    q = spark.createDataFrame(rows, "query_id string, seq bigint, tenant_id string, query_text string, embedding array<float>")
    e = spark.createDataFrame([("e1", 1, "t1", "hello", [1.0, 0.0]), ("e2", 2, "t1", "HELLO", [0.0, 1.0])],
                              "entry_id string, seq bigint, tenant_id string, query_text string, embedding array<float>")
    got = {r.query_id: (r.tier, r.entry_id) for r in L.two_tier_lookup(q, e).collect()}
    assert got == {"q1": (1, "e2"), "q2": (0, None), "q3": (2, "e2")}
    wide = {r.query_id: r.tier for r in L.two_tier_lookup(q, e, cfg=CacheConfig(tenant_scoped=False)).collect()}
    assert wide["q2"] == 2


def test_similarity_exactly_at_the_threshold_hits(spark):
    q = spark.createDataFrame([("q", 1, "t", "a", [0.6, 0.8])], "query_id string, seq bigint, tenant_id string, query_text string, embedding array<float>")
    e = spark.createDataFrame([("e", 1, "t", "b", [1.0, 0.0])], "entry_id string, seq bigint, tenant_id string, query_text string, embedding array<float>")
    tau = float(np.round(np.float32(0.6).astype(float), 9))
    ts = spark.createDataFrame([("e", tau)], "entry_id string, threshold double")
    assert L.semantic_lookup(q, e, ts).count() == 1
    above = spark.createDataFrame([("e", tau + 1e-6)], "entry_id string, threshold double")
    assert L.semantic_lookup(q, e, above).count() == 0


@pytest.mark.parametrize("ddl, value", [
    ("STRUCT<text: ARRAY<STRING>, answer_start: ARRAY<INT>>", {"text": ["x", "y"], "answer_start": [0, 1]}),
    ("ARRAY<STRUCT<text: STRING>>", [{"text": "x"}, {"text": "y"}]), ("ARRAY<STRING>", ["x", "y"]), ("STRING", "x"),
])
def test_first_answer_of_each_shape(spark, ddl, value):
    df = spark.createDataFrame([("  Q? ", value), ("", value)], f"question string, answers {ddl}")
    rows = W.load_qa(df).collect()
    assert [(r.question, r.answer, r.id) for r in rows] == [("Q?", "x", hashlib.md5(b"Q?").hexdigest()[:12])]


def test_workload_shares_answers(spark):
    q = spark.createDataFrame([(f"i{n}", f"What is {n}?", f"a{n}") for n in range(40)], "id string, question string, answer string")
    work = W.build_workload(q, share=0.5).cache()
    copies = work.filter("is_paraphrase").count()
    assert 0 < copies < 40 and work.count() == 40 + copies
    answers = W.unique_answers(work)
    assert answers.count() == 40
    assert W.with_answers(work, answers).filter("shared_answer <> answer OR shared_answer IS NULL").count() == 0


def test_scorecard_without_hits(spark):
    df = spark.createDataFrame([("s", False, 0, False, 10.0)], "strategy string, hit boolean, tier int, correct boolean, latency_ms double")
    row = M.strategy_scorecard(df).head()
    assert row.precision == 0 and row.f1_score == 0 and row.avg_hit_latency_ms == 0 and row.llm_calls == 1


def test_metrics_of_one_kind_only(spark):
    log = spark.createDataFrame([("t", 1, True, 1, 5.0, False, False)], "tenant_id string, seq bigint, hit boolean, tier int, latency_ms double, "
                                "admission_rejected boolean, eviction_triggered boolean")
    judged = spark.createDataFrame([], "tenant_id string, was_correct boolean")
    row = M.aggregate_metrics(log, judged).head()
    assert row.hit_rate == 1.0 and row.avg_miss_latency_ms == 0.0 and row.precision == 0.0


def test_sketch_never_underestimates(spark):
    rows = [(i, f"k{i % 7}") for i in range(100)]
    df = spark.createDataFrame(rows, "seq bigint, key string")
    est = {r.key: r.estimate for r in M.sketch_frequency(df, "key", M.sketch_counters(df, "key")).collect()}
    assert all(est[f"k{j}"] >= sum(1 for i in range(100) if i % 7 == j) for j in range(7))
    aged = M.sketch_frequency(df, "key", M.sketch_counters(df, "key", 50))
    assert {r.key: r.estimate for r in aged.collect()}["k0"] == pytest.approx(8 * 0.5 + 7)


@pytest.mark.parametrize("bad", [{"default_threshold": 1.5}, {"capacity": 0}, {"min_threshold": 0.9, "max_threshold": 0.8}, {"ttl_s": -1}])
def test_config_bounds(bad):
    with pytest.raises(ValueError):
        CacheConfig(**bad)


def test_candidates_follow_rows_and_floor():
    small, large = L.candidates_for(1_000, 0.7, 64), L.candidates_for(1_000_000_000, 0.7, 64)
    assert small.bits == 1 and large.bits == math.ceil(math.log2(1_000_000_000 / 16_384))
    for c in (small, large):
        same = (1 - math.acos(0.7) / math.pi) ** c.bits
        assert 1 - (1 - same) ** c.tables >= 0.9
    assert L.candidates_for(1_000_000_000, 0.95, 64).tables < large.tables
