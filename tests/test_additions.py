"""Draws, sketches, merged feedback, chat rows, weighted encodings and workloads against plain Python."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from recollect.config import CacheConfig
from recollect.functions import draws as D
from recollect.functions import vectors as V
from recollect.functions.scoring import nonconformity
from recollect.operators import machines as MC
from recollect.operators import metrics as M
from recollect.operators import sequential as SQ
from recollect.operators import sessions as SE
from recollect.operators import step as ST
from recollect.operators import workload as W


def test_draws_have_the_moments_of_their_distribution(spark):
    df = spark.range(4000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("k"))
    for a, b in ((1.0, 1.0), (2.0, 5.0), (40.0, 3.0), (0.5, 0.7)):
        x = np.array([r.x for r in df.select(D.beta(F.lit(a), F.lit(b), F.col("k")).alias("x")).collect()])
        assert ((x >= 0) & (x <= 1)).all() and len(set(x)) > 3900
        deviation = math.sqrt(a * b / ((a + b) ** 2 * (a + b + 1)))
        assert x.mean() == pytest.approx(a / (a + b), abs=5 * deviation / math.sqrt(len(x)))
        assert x.std() == pytest.approx(deviation, rel=0.06)
    u = np.array([r.u for r in df.select(D.uniform(F.col("k"), "t").alias("u")).collect()])
    assert abs(u.mean() - 0.5) < 0.02 and 0 < u.min() and u.max() < 1


def test_samples_do_not_depend_on_partitions_and_follow_the_posterior(spark):
    rows = [(f"s{i}", arm, 0.7 + arm / 100, 5.0 + 30 * (arm == 2), 5.0) for i in range(60) for arm in range(4)]
    df = spark.createDataFrame(rows, "shard_id string, arm int, threshold double, alpha double, beta double")
    one, many = (sorted(map(tuple, SQ.thompson_sample(d, 7).collect())) for d in (df.coalesce(1), df.repartition(9)))
    assert one == many and sum(r[1] == 2 for r in one) > 50
    assert one != sorted(map(tuple, SQ.thompson_sample(df, 8).collect()))


def test_sketches_merge_within_their_error(spark):
    r = random.Random(1)
    rows = [(i % 7, f"t{i % 2}", r.lognormvariate(3, 1) if i % 50 else None, f"k{r.randrange(900)}") for i in range(20_000)]
    df = spark.createDataFrame(rows, "hour int, tenant string, latency_ms double, key string").repartition(6)
    kept = M.log_sketches(df, ["hour", "tenant"], key="key")
    got = {x.tenant: x for x in M.merged_quantiles(kept, ["tenant"], {"p50": 0.5, "p99": 0.99}).collect()}
    for tenant in ("t0", "t1"):
        values = sorted(v for _, t, v, _ in rows if t == tenant and v is not None)
        assert got[tenant].n == len(values)
        for name, p in (("p50", 0.5), ("p99", 0.99)):
            assert abs(np.searchsorted(values, got[tenant][name]) / len(values) - p) <= M.SKETCH_ERROR + 1 / len(values)
    total = M.merged_distinct(kept, []).first()
    exact = len({k for *_, k in rows})
    assert total["rows"] == 20_000 and abs(total.distinct_keys - exact) <= M.DISTINCT_ERROR * exact
    assert M.merged_quantiles(kept.limit(0), ["tenant"], {"p50": 0.5}).count() == 0


def test_merged_feedback_equals_one_pass(spark):
    r = random.Random(3)
    cfg = CacheConfig(max_scores=5, drift_delta=2.0, arms=3)
    rows = [(f"e{r.randrange(6)}", i, round(r.random(), 3), r.random() < (0.9 if i < 150 else 0.1), f"s{i % 2}") for i in range(300)]
    new = spark.createDataFrame(rows, "entry_id string, seq bigint, similarity double, was_correct boolean, shard_id string")
    entries = spark.createDataFrame([(f"e{i}",) for i in range(5)], "entry_id string")  # e5 is unknown
    scores = arms = None
    accepted, last = 0, {}
    for low, high in ((0, 90), (90, 91), (91, 300)):
        ok, recent, tau, moved = ST.feedback_merge(scores, arms, new.filter(F.col("seq").between(low, high - 1)), entries, cfg)
        accepted += ok.count()
        last |= {x.entry_id: x for x in tau.collect()}
        scores = spark.createDataFrame(ST.replaced(scores, recent, "entry_id").collect(), recent.schema)
        arms = spark.createDataFrame(ST.replaced(arms, moved, "shard_id").collect(), moved.schema)
    good = [x for x in rows if x[0] != "e5"]
    assert accepted == len(good)
    by = defaultdict(list)
    for e, seq, s, ok, _ in good:
        by[e].append((seq, 1 - s if ok else min(1.0, max(1 - s + 0.1, 0.5))))
    for x in scores.collect():
        assert [(y.seq, pytest.approx(y.score)) for y in x.recent] == by[x.entry_id][-5:]
        assert last[x.entry_id].n_scores == len(x.recent)
    for x in arms.collect():
        part = [y for y in good if y[4] == x.shard_id]
        import pandas as pd

        frame = pd.DataFrame({"arm": [np.nan] * len(part), "reward": [1.0 if y[3] else 0.0 for y in part]})
        state, _ = MC.bandit(3, 2.0, cfg.drift_window)(None, frame, np.zeros(len(part), bool))
        assert list(x.alpha) == pytest.approx(state[0]) and list(x.beta) == pytest.approx(state[1]) and x.resets == state[3] and list(x.window) == state[2]


def test_implicit_rewards_move_the_arms(spark):
    rows = [("s", 1, True, 1, 1.0), ("s", 2, True, 2, 0.9), ("s", 3, True, 2, 0.6), ("s", 4, False, 0, 0.9), ("t", 5, False, 0, 0.0)]
    log = spark.createDataFrame(rows, "shard_id string, seq bigint, hit boolean, tier int, similarity double")
    got = ST.implicit_step(None, log, CacheConfig(arms=2)).collect()
    assert len(got) == 1 and sum(got[0].alpha) == 2 + 2 and sum(got[0].beta) == 2 + 1


def test_answers_become_chat_rows(spark):
    log = spark.createDataFrame(
        [(1, 1, "s", 0, "what?", True, 2, 0.8, 3.0), (2, 2, "s", 60, "and now?", False, 0, 0.0, 900.0), (3, 3, "t", 70, None, False, 0, 0.0, 1.0)],
        "query_id int, seq bigint, session_id string, s bigint, query_text string, hit boolean, tier int, similarity double, latency_ms double",
    ).withColumn("ts", F.timestamp_seconds("s"))
    rows = SE.answer_messages(log, spark.createDataFrame([(1, "this"), (2, "that")], "query_id int, text string"))
    got = {r.id: r for r in rows.collect()}
    assert sorted(got) == [2, 3, 4, 5, 6] and got[2].meta is None and got[3].text == "this"
    assert rows.filter("id = 3").select(SE.parse_meta(F.col("meta")).alias("m")).first().m.tier == 2
    _, meta = SE.append_messages(rows.limit(0).drop("meta"), SE.session_metadata(rows.limit(0)), rows.drop("meta"))
    assert {r.session_id: r.title for r in meta.collect()}["s"] == "what?"


def test_idf_weights(spark):
    texts = ["one two two", "one three", "ONE  three", "four"]
    df = spark.createDataFrame([(i, t, [i]) for i, t in enumerate(texts)], "id int, text string, more array<int>")
    plain = {r.id: r.embedding for r in V.embed_distinct(df, "text", dim=64).collect()}
    weighted = {r.id: r.embedding for r in V.embed_distinct(df, "text", dim=64, idf=True).collect()}
    slot = {w: r[0] for w in "one two three four".split() for r in spark.range(1).select(V.word_slot(F.lit(w), 64)).collect()}
    assert len(set(slot.values())) == 4 and weighted[1] == weighted[2]
    weight = lambda n: 1 + math.log(4 / (n + 1))  # noqa: E731  (three distinct texts)
    raw = np.array([1 * weight(2), 2 * weight(1)])
    assert [weighted[0][slot["one"]], weighted[0][slot["two"]]] == pytest.approx(list(raw / np.linalg.norm(raw)))
    assert plain[0][slot["two"]] == pytest.approx(2 / math.sqrt(5))
    made = V.embed_distinct(df, "text", dim=64, idf=True)
    assert "md5" not in made._jdf.queryExecution().optimizedPlan().toString()  # words were hashed once, for the weights
    assert V.embed_distinct(df.limit(0), "text", dim=64, idf=True).count() == 0


def test_workload_in_one_call(spark, tmp_path):
    rows = [(i, f"What is number {i % 12}?", [f"answer {i}"]) for i in range(30)] + [(99, " ", ["x"]), (100, "no answer?", [])]
    spark.createDataFrame(rows, "n bigint, question string, answers array<string>").write.json(str(tmp_path / "q"))
    schema = "n BIGINT, question STRING, answers ARRAY<STRING>"
    got = W.qa_workload(spark, str(tmp_path / "q"), "json", F.col("n"), 8, 1.0, 42, schema).collect()
    kinds = Counter(r.is_paraphrase for r in got)
    originals = {r.id: r for r in got if not r.is_paraphrase}
    assert kinds == {False: 8, True: 8} and len({r.question for r in originals.values()}) == 8
    assert all(int(r.answer.split()[1]) < 12 for r in originals.values())  # the first row of each question
    assert all(r.original_id in originals and r.answer == originals[r.original_id].answer for r in got if r.is_paraphrase)


def test_scores_of_judgements(spark):
    rows = spark.createDataFrame([(0.9, True), (0.9, False), (0.1, False)], "s double, ok boolean")
    assert [r[0] for r in rows.select(nonconformity(F.col("s"), F.col("ok"))).collect()] == pytest.approx([0.1, 0.5, 1.0])
