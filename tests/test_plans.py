"""Shared plan helpers against plain windows, numpy and brute force, with tiny blocks."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from recollect.plans import running as RU
from recollect.plans import similarity as SI
from recollect.plans.quantiles import cuts_below, exact_quantiles
from recollect.plans.ranks import first_rows, ranked
from recollect.plans.spread import spread_join


@pytest.fixture(scope="module")
def log(spark):
    """200 rows, two thirds of them under one key."""
    return spark.range(200).select(
        F.when(F.col("id") % 3 < 2, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 5).cast("string"))).alias("key"),
        F.col("id").alias("seq"), ((F.col("id") * 37) % 11).cast("double").alias("v"),
    )


@pytest.mark.parametrize("keys", [["key"], []])
@pytest.mark.parametrize("inclusive", [True, False])
def test_running_equals_plain_window(log, keys, inclusive):
    out = RU.running(
        log, keys, ["seq"], RU.by_width("seq", 7), s=RU.total(F.col("v"), inclusive), m=RU.highest(F.col("v"), inclusive),
    )
    w = Window.partitionBy(*keys).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    want = log.select("seq", F.coalesce(F.sum("v").over(w), F.lit(0.0)).alias("s"), F.max("v").over(w).alias("m"))
    assert sorted(out.select("seq", "s", "m").collect()) == sorted(want.collect(), key=lambda r: r[0])


def test_trailing_frames_cross_chunks(log, monkeypatch):
    monkeypatch.setattr(RU, "CHUNK_ROWS", 10)
    placed = RU.numbered(log, ["key"], ["seq"], RU.by_width("seq", 7), "rn")
    out = RU.trailing_frames(placed, ["key"], "rn", 6, s=F.sum("v"), n=F.count("v"))
    w = Window.partitionBy("key").orderBy("seq").rowsBetween(-5, 0)
    want = log.select("seq", F.sum("v").over(w).alias("s"), F.count("v").over(w).alias("n"))
    assert sorted(out.select("seq", "s", "n").collect()) == sorted(want.collect())
    assert out.count() == log.count()


def test_ranked_with_ties_and_hot_key(log):
    out = ranked(log, ["key"], [F.asc("v"), F.desc("seq")])
    w = Window.partitionBy("key").orderBy(F.asc("v"), F.desc("seq"))
    want = log.select("seq", F.row_number().over(w).cast("bigint").alias("rank"))
    assert sorted(out.select("seq", "rank").collect()) == sorted(want.collect())


@pytest.mark.parametrize("quota", [0, 3, 1000])
def test_first_rows(log, quota):
    out = first_rows(log, ["key"], [F.col("v"), F.col("seq")], quota, "seq").filter("taken")
    w = Window.partitionBy("key").orderBy("v", "seq")
    want = log.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= quota)
    assert sorted(r.seq for r in out.collect()) == sorted(r.seq for r in want.collect())


@pytest.mark.parametrize("how", ["left", "inner"])
@pytest.mark.parametrize("limit", [3, 1_000_000])
def test_spread_join_keeps_every_row(spark, log, how, limit):
    right = spark.createDataFrame([("hot", 1), ("k2", 2)], "key string, w int")
    out = spread_join(log, right, ["key"], how, "seq", limit)
    want = log.join(right, "key", how)
    assert sorted(out.select("seq", "w").collect(), key=str) == sorted(want.select("seq", "w").collect(), key=str)


@pytest.mark.parametrize("limit", [3, 1_000_000])
def test_spread_anti_join(spark, log, limit):
    gone = spark.createDataFrame([("hot",), ("k2",)], "key string")
    out = spread_join(log, gone, ["key"], "left_anti", "seq", limit)
    assert sorted(r.seq for r in out.collect()) == sorted(r.seq for r in log.join(gone, "key", "left_anti").collect())


def test_quantiles_interpolate(log):
    out = exact_quantiles(log, ["key"], "v", {"p50": 0.5, "p95": 0.95}, F.floor(F.col("v") / 2).cast("bigint"))
    got = {r.key: (r.p50, r.p95) for r in out.collect()}
    rows = log.toPandas()
    for key, part in rows.groupby("key"):
        assert got[key] == pytest.approx((np.percentile(part.v, 50), np.percentile(part.v, 95)))


def test_quantiles_of_nothing(log):
    empty = log.filter("false")
    assert exact_quantiles(empty, ["key"], "v", {"p50": 0.5}, F.floor("v")).count() == 0


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(60, 8))
    base[30:40] = base[0:10]  # exact copies, so that ties occur
    unit = (base / np.linalg.norm(base, axis=1, keepdims=True)).astype(np.float32)
    rows = [(i, i, "a" if i % 3 else "b", v.tolist()) for i, v in enumerate(unit)]
    rows.append((99, 99, "a", None))
    return unit, spark.createDataFrame(rows, "query_id bigint, seq bigint, tenant_id string, embedding array<float>")


def brute(unit, k, allowed):
    sims = np.round(unit.astype(float) @ unit.astype(float).T, 9)
    out = set()
    for q in range(len(unit)):
        order = sorted((e for e in range(len(unit)) if allowed(q, e, sims[q, e])), key=lambda e: (-sims[q, e], e))
        out |= {(q, e, r + 1) for r, e in enumerate(order[:k])}
    return out


@pytest.mark.parametrize("blocks", [(8192, 65536), (7, 5)])
@pytest.mark.parametrize("k", [1, 4])
@pytest.mark.parametrize("case", ["plain", "floor", "causal", "tenant"])
def test_best_matches_equals_brute_force(vectors, blocks, k, case):
    unit, q = vectors
    e = q.withColumnRenamed("query_id", "entry_id")
    tenant = ["a" if i % 3 else "b" for i in range(len(unit))]
    options, allowed = {
        "plain": ({"skip_same": True}, lambda a, b, s: a != b),
        "floor": ({"floor": 0.4}, lambda a, b, s: s >= 0.4),
        "causal": ({"earlier_only": True}, lambda a, b, s: b < a),
        "tenant": ({"group": ["tenant_id"]}, lambda a, b, s: tenant[a] == tenant[b]),
    }[case]
    out = SI.best_matches(q, e, k, entry_block=blocks[0], query_block=blocks[1], **options)
    got = {(r.query_id, r.entry_id, r["rank"]) for r in out.collect()}
    assert got == brute(unit, k, allowed)


def test_entry_limit_is_obeyed_or_reported(vectors):
    unit, q = vectors
    e = q.withColumnRenamed("query_id", "entry_id")
    limit = F.when(F.col("entry_id") % 2 == 0, 0.2).otherwise(0.9)
    obeyed = SI.best_matches(q, e, 3, entry_limit=limit).collect()
    assert all(r.similarity >= (0.2 if r.entry_id % 2 == 0 else 0.9) for r in obeyed)
    told = SI.best_matches(q, e, 3, entry_limit=limit, obey_limit=False).collect()
    assert {(r.query_id, r.entry_id) for r in told} == {(a, b) for a, b, _ in brute(unit, 3, lambda *x: True)}
    assert all(r.threshold == (0.2 if r.entry_id % 2 == 0 else 0.9) for r in told)


def test_result_does_not_depend_on_partitions(vectors, spark):
    _, q = vectors
    e = q.withColumnRenamed("query_id", "entry_id")
    one = SI.best_matches(q.coalesce(1), e, 3).collect()
    many = SI.best_matches(q.repartition(7), e.repartition(5), 3).collect()
    assert sorted(one) == sorted(many)


def test_cuts_below_counts_like_a_loop(spark):
    """Each value is compared with about twice the root of the cuts, not with all of them."""
    rng = np.random.default_rng(31)
    values = [None, float("inf"), -float("inf"), *np.round(rng.uniform(-3, 3, 300), 1).tolist()]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for n in (1, 2, 3, 16, 17, 59):
        cuts = sorted(set(np.round(rng.uniform(-3, 3, 10 * n), 1).tolist()))[:n]
        got = [r.n for r in df.select(cuts_below(F.col("v"), cuts).alias("n")).collect()]
        assert got == [0 if v is None else sum(c < v for c in cuts) for v in values]
