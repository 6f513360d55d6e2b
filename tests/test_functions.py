"""Column expressions on hand-made edge rows."""

from __future__ import annotations

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from recollect.functions import scoring as S
from recollect.functions import text as T
from recollect.functions import vectors as V

TEXTS = [
    "What's up?", "  hello   world  ", "Étude — naïve CAFÉ!", "a b c\td\n e", "snake_case ok", "", "???",
    "é combining", "数字 ١٢٣ x²", "line sep\u0085next", "ÄÖÜ ß",
]


def one(spark, col):
    return spark.range(1).select(col.alias("x")).head().x


def test_normalize_agrees_with_unicode_regex(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    got = [r.x for r in df.select(T.normalize_text(F.col("t")).alias("x")).collect()]
    want = [re.sub(r"\s+", " ", re.sub(r"[^\w\s]", "", t.lower())).strip() for t in TEXTS]
    assert got == want
    light = [r.x for r in df.select(T.normalize_light(F.col("t")).alias("x")).collect()]
    assert light == [re.sub(r"\s+", " ", t.lower().strip()) for t in TEXTS]


def test_key_carries_tenant(spark):
    a = one(spark, T.exact_key(F.lit("Hi, there!"), F.lit("t1")))
    b = one(spark, T.exact_key(F.lit("hi THERE"), F.lit("t1")))
    c = one(spark, T.exact_key(F.lit("hi there"), F.lit("t2")))
    assert a == b != c and a.startswith("{t1}:exact:")


@pytest.mark.parametrize("expected, answer, ok", [
    ("Paris", "It is Paris.", True), ("", "anything", True), ("the of", "nothing here", True),
    ("oxygen", "oxygenated water", True), ("red blue green", "red apples", False), ("red blue", "red apples", True),
    ("abc def ghi", "xyz", False),
])
def test_answer_match(spark, expected, answer, ok):
    assert one(spark, T.answer_match(F.lit(expected), F.lit(answer))) is ok


@pytest.mark.parametrize("expected, answer, ok", [("", "x", True), ("a b c", "a", True), ("a b c d", "a", False)])
def test_word_overlap(spark, expected, answer, ok):
    assert one(spark, T.word_overlap_match(F.lit(expected), F.lit(answer))) is ok


@pytest.mark.parametrize("question, text", [
    ("What is love?", "Define love?"), ("WHAT IS love", "Define love?"), ("Tell me stories.", "What is stories."),
    ("Could you help??", "help?"), ("I'd like to know more!", "more!"), ("Where is Rome?", "What is the location of Rome?"),
])
def test_paraphrase_rewrites(spark, question, text):
    assert one(spark, T.paraphrase(F.lit(question), F.lit(0))) == text


def test_paraphrase_lead_in(spark):
    assert one(spark, T.paraphrase(F.lit("Name a fish?"), F.lit(8))) == "Quick question: name a fish?"


def test_costs_and_bytes(spark):
    assert one(spark, S.token_cost(F.lit(2000), F.lit("openai"))) == pytest.approx(0.03)
    assert one(spark, S.token_cost(F.lit(1000), F.lit("unheard of"))) == pytest.approx(0.01)
    assert one(spark, S.storage_bytes(F.lit(0), F.lit("né"))) == 3
    assert one(spark, S.storage_bytes(F.lit(None).cast("bigint"), F.lit("ab"))) == 2
    assert one(spark, S.priority(F.lit(10), F.lit(0.01), F.lit(0.0), F.lit(1000), F.lit(0.0))) == pytest.approx(100.0)
    assert one(spark, S.priority(F.lit(1), F.lit(0.0), F.lit(5.0), F.lit(0), F.lit(2.0))) == pytest.approx(7.0)


def test_reward_and_exact_half(spark):
    def reward(s):
        return one(spark, S.implicit_reward(F.lit(2), F.lit(s)))

    assert reward(0.85) == 1.0 and reward(0.64) == 0.0 and one(spark, S.implicit_reward(F.lit(1), F.lit(1.0))) == 1.0
    assert reward(0.75) == (0.75 - 0.65) / 0.20 != 0.5


def test_nonconformity(spark):
    def score(s, ok):
        return one(spark, S.nonconformity(F.lit(s), F.lit(ok)))

    assert score(0.92, True) == pytest.approx(0.08)
    assert score(0.82, False) == 0.5 and score(0.1, False) == 1.0 and score(0.45, False) == pytest.approx(0.65)


def test_expiry_is_strict(spark):
    row = spark.sql("SELECT timestamp'2024-01-01 00:00:00' AS t").select(
        S.is_expired(F.col("t"), F.col("t")).alias("equal"), S.stamp_expiry(F.col("t"), F.lit(0)).alias("never"),
        S.is_expired(F.col("t"), F.lit(None).cast("timestamp")).alias("unset"),
        S.stamp_expiry(F.col("t"), F.lit(90)).cast("string").alias("later"),
    ).head()
    assert row.equal is False and row.never is None and row.unset is False and row.later == "2024-01-01 00:01:30"


def test_request_errors(spark):
    def error(q, s=None, t=None):
        return one(spark, S.request_error(F.lit(q).cast("string"), F.lit(s).cast("double"), F.lit(t).cast("string")))

    assert error("") == "query_empty" and error(None) == "query_empty" and error("x" * 10_001) == "query_too_long"
    assert error("x", 1.5) == "similarity_out_of_range" and error("x", 0.5, "") == "title_length" and error("x", 1.0, "t") is None


def test_vectors_zero_null_and_signature(spark):
    rows = [(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, None)]
    df = spark.createDataFrame(rows, "id int, v array<float>")
    unit = {r.id: r.u for r in V.l2_normalized(df, "v", "u").collect()}
    assert unit[1] == pytest.approx([0.6, 0.8]) and unit[2] == [0.0, 0.0] and unit[3] is None
    sig = {r.id: r.s for r in df.select("id", V.lsh_signature(F.col("v"), 2).alias("s")).collect()}
    planes = np.random.RandomState(42).randn(4, 8, 2).astype(np.float32)
    want = [int("".join("1" if x > 0 else "0" for x in planes[t] @ np.array([3.0, 4.0])), 2) for t in range(4)]
    assert sig[1] == want and sig[2] == [0, 0, 0, 0] and sig[3] is None
    combined = {r.id: r.c for r in df.select("id", V.lsh_combined(V.lsh_signature(F.col("v"), 2)).alias("c")).collect()}
    assert combined[1] == want[0] ^ want[1] ^ want[2] ^ want[3]


def test_distance_to_similarity(spark):
    assert one(spark, 1 - V.squared_distance(F.array(F.lit(1.0)), F.array(F.lit(1.0 + 0.2**0.5))) / 2) == pytest.approx(0.9)


def test_embed_distinct_encodes_once(spark):
    df = spark.createDataFrame([(1, "Hello, World"), (2, "hello world"), (3, "other")], "id int, text string")
    out = {r.id: r.embedding for r in V.embed_distinct(df, "text", dim=16).collect()}
    assert out[1] == out[2] != out[3] and np.linalg.norm(out[3]) == pytest.approx(1.0)
    calls = spark.sparkContext.accumulator(0)

    @F.arrow_udf("array<double>")
    def encoder(texts):
        import pyarrow as pa

        calls.add(len(texts))
        return pa.array([[float(len(t))] for t in texts.to_pylist()], pa.list_(pa.float64()))

    assert V.embed_distinct(df, "text", encoder(F.col("text"))).count() == 3
    V.embed_distinct(df, "text", encoder(F.col("text"))).collect()
    assert calls.value <= 4
