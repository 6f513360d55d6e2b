"""Rules as maps of blocks against the plain loop over all rows."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from recollect.config import CacheConfig
from recollect.operators import rules as RL
from recollect.operators import sequential as SQ
from recollect.plans import blockscan as BS

SECOND = 1_000_000


def frame(times, ok=None):
    out = pd.DataFrame({"at": np.array(times, dtype=np.int64)})
    if ok is not None:
        out["ok"] = ok
    return out


def split_run(rule, rows, cuts):
    """The rows block by block: states through composed maps, columns from the states."""
    bounds = [0, *sorted({c % (len(rows) + 1) for c in cuts}), len(rows)]
    blocks = [rows.iloc[a:b].reset_index(drop=True) for a, b in zip(bounds, bounds[1:]) if a < b]
    maps = [rule.mapped(b) for b in blocks]
    out: dict[str, list] = {}
    state = rule.start
    for i, block in enumerate(blocks):
        if i:
            whole = maps[0]
            for m in maps[1:i]:
                whole = rule.composed(whole, m)
            by_whole = rule.applied(whole, rule.start)
            state = rule.applied(maps[i - 1], state)
            assert by_whole == state  # composed in one go or applied one after the other
        for name, values in rule.rows(state, block).items():
            out.setdefault(name, []).extend(values)
    return out


times = st.lists(st.integers(0, 4 * SECOND), min_size=1, max_size=60).map(lambda gaps: np.cumsum(gaps).tolist())


@settings(max_examples=150, deadline=None)
@given(times, st.sampled_from([(1.0, 1), (1.0, 3), (0.4, 5), (3.0, 2), (1 / 7, 4)]), st.lists(st.integers(0, 100), max_size=5))
def test_bucket_blocks_equal_one_run(times, shape, cuts):
    rule = RL.token_bucket(*shape)
    rows = frame(times)
    assert split_run(rule, rows, cuts) == rule.rows(rule.start, rows)


@settings(max_examples=150, deadline=None)
@given(times, st.data(), st.sampled_from([(1, 2.0), (2, 3.0), (3, 1.0), (5, 10.0)]), st.lists(st.integers(0, 100), max_size=5))
def test_breaker_blocks_equal_one_run(times, data, shape, cuts):
    rows = frame(times, data.draw(st.lists(st.booleans(), min_size=len(times), max_size=len(times))))
    rule = RL.breaker(*shape)
    assert split_run(rule, rows, cuts) == rule.rows(rule.start, rows)


def test_bucket_equals_the_textbook_rule():
    rate, burst = 2.0, 3
    r = random.Random(1)
    at = np.cumsum([r.choice([0, 125_000, 250_000, 500_000, 2 * SECOND]) for _ in range(400)]).tolist()
    tokens, last, want = float(burst), None, []
    for t in at:
        if last is not None:
            tokens = min(burst, tokens + (t - last) / SECOND * rate)
        last = t
        want.append(tokens >= 1)
        tokens -= tokens >= 1
    got = RL.token_bucket(rate, burst).rows(RL.token_bucket(rate, burst).start, frame(at))
    assert got["allowed"] == want and got["tokens"][-1] == pytest.approx(tokens)


def test_bucket_maps_stay_small():
    r = random.Random(2)
    for burst in (1, 3, 8):
        rule = RL.token_bucket(1.0, burst)
        at = np.cumsum([r.randrange(0, 2 * SECOND) for _ in range(3000)]).tolist()
        assert len(rule.mapped(frame(at))) - 2 <= 4 * 2 * (burst + 1)


def test_times_that_go_back_count_as_no_time():
    rule = RL.token_bucket(1.0, 2)
    rows = frame([5 * SECOND, 3 * SECOND, 3 * SECOND, 6 * SECOND])
    assert rule.rows(rule.start, rows)["allowed"] == [True, True, False, True]
    assert split_run(rule, rows, [1, 2, 3]) == rule.rows(rule.start, rows)


def steady(spark, n, step_s, **columns):
    rows = [(i, "k", i * step_s, *[f(i) for f in columns.values()]) for i in range(n)]
    names = ", ".join(f"{c} boolean" for c in columns)
    df = spark.createDataFrame(rows, "seq bigint, tenant_id string, s double" + (", " + names if names else ""))
    return df.selectExpr("seq", "tenant_id", "timestamp_micros(cast(s * 1000000 as bigint)) AS ts", *columns)


def test_one_tenant_without_a_pause_spreads(spark):
    df = steady(spark, 3000, 0.7)
    whole = {r.seq: tuple(r) for r in SQ.token_bucket(df, 1.0, 3).collect()}
    spread = {r.seq: tuple(r) for r in SQ.token_bucket(df, 1.0, 3, width=100, fan=3).collect()}
    assert spread == whole and len(whole) == 3000 and not all(r[2] for r in whole.values())


def test_one_dependency_that_never_recovers_spreads(spark):
    df = steady(spark, 2000, 1.0, ok=lambda i: i % 97 == 0).withColumnRenamed("tenant_id", "dependency")
    cfg = CacheConfig(breaker_failures=3, breaker_reset_s=7.0)
    whole = {r.seq: tuple(r) for r in SQ.breaker_states(df, cfg).collect()}
    spread = {r.seq: tuple(r) for r in SQ.breaker_states(df, cfg, width=64, fan=4).collect()}
    assert spread == whole and {r[3] for r in whole.values()} == {"closed", "open", "half_open"}


def test_null_and_several_keys_and_no_rows(spark):
    rows = [(i, [None, "a", "b"][i % 3], i) for i in range(90)]
    df = spark.createDataFrame(rows, "seq bigint, tenant_id string, s bigint").selectExpr("seq", "tenant_id", "timestamp_seconds(s) AS ts")
    got = SQ.token_bucket(df, 0.2, 2, width=10, fan=2)
    for key in (None, "a", "b"):
        rule = RL.token_bucket(0.2, 2)
        at = [i * SECOND for i in range(90) if [None, "a", "b"][i % 3] == key]
        want = rule.rows(rule.start, frame(at))["allowed"]
        assert [r.allowed for r in sorted((r for r in got.collect() if r.tenant_id == key), key=lambda r: r.seq)] == want
    assert SQ.token_bucket(df.limit(0), 1.0, 1).count() == 0


def test_a_session_without_a_pause_is_cut_with_a_lead_in(spark):
    rng = np.random.default_rng(3)
    rows = [(f"s{i % 2}", i, i, i, [float(x) for x in rng.standard_normal(8)]) for i in range(1500)]
    df = spark.createDataFrame(rows, "session_id string, query_id bigint, seq bigint, s bigint, embedding array<double>")
    df = df.selectExpr("session_id", "query_id", "seq", "timestamp_seconds(s) AS ts", "embedding")
    whole = {r.query_id: r for r in SQ.session_fusion(df).collect()}
    cut = {r.query_id: r for r in SQ.session_fusion(df, chunk=120, lead=110).collect()}
    assert len(cut) == 1500
    for i, r in whole.items():
        assert cut[i].turn == r.turn == i // 2 + 1
        assert np.allclose(cut[i].fused, r.fused, atol=1e-9) and np.allclose(cut[i].context, r.context, atol=1e-9)
    with pytest.raises(ValueError):
        SQ.session_fusion(df, chunk=10, lead=11)


def test_carried_contexts_in_cut_sessions(spark):
    rng = np.random.default_rng(4)
    rows = [("s", i, i, i, [float(x) for x in rng.standard_normal(8)]) for i in range(900)]
    df = spark.createDataFrame(rows, "session_id string, query_id bigint, seq bigint, s bigint, embedding array<double>")
    df = df.selectExpr("session_id", "query_id", "seq", "timestamp_seconds(s) AS ts", "embedding")
    whole = {r.query_id: r for r in SQ.session_fusion(df).collect()}
    carried = SQ.last_contexts(SQ.session_fusion(df.filter("seq < 300")))
    rest = {r.query_id: r for r in SQ.session_fusion(df.filter("seq >= 300"), contexts=carried, chunk=150, lead=120).collect()}
    assert len(rest) == 600
    for i, r in rest.items():
        assert r.turn == whole[i].turn and np.allclose(r.fused, whole[i].fused, atol=1e-9)


def test_small_blocks_are_cut_from_a_batch_at_once():
    """Before, each block was a frame of its own: blocks of a dozen rows cost far more than their rows."""
    rng = np.random.default_rng(4)
    rows = pd.DataFrame({"key": pd.array([None, *np.repeat(["a", "b"], 500)], dtype="object"), "_block": [0, *np.sort(rng.integers(0, 90, 500)), *np.sort(rng.integers(0, 90, 500))]})
    rows["at"] = np.arange(len(rows))
    for size in (1, 7, 100, 5000):
        batches = [rows.iloc[i : i + size] for i in range(0, len(rows), size)]
        got = list(BS._blocks(iter(batches), ["key", "_block"]))
        assert len(got) <= len(batches) + 1
        blocks = [frame["at"].tolist()[lo:hi] for frame, bounds in got for lo, hi in zip(bounds, bounds[1:])]
        want = [g["at"].tolist() for _, g in rows.groupby(["key", "_block"], dropna=False)]
        assert sorted(blocks) == sorted(want) and sum(blocks, []) == rows["at"].tolist()
