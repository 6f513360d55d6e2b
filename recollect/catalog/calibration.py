"""Threshold, posterior and drift queries over the feedback log."""

from __future__ import annotations

from pyspark.sql import functions as F

from recollect.catalog import inputs as I
from recollect.catalog import query
from recollect.config import CacheConfig
from recollect.operators import bandit as B
from recollect.operators import calibration as C
from recollect.operators import drift as D

WINDOW = 50
CFG = CacheConfig(max_scores=WINDOW)

SCORE = """CASE WHEN was_correct THEN 1.0::DOUBLE - similarity
  ELSE least(1.0::DOUBLE, greatest(1.0::DOUBLE - similarity + 0.1::DOUBLE, 0.5::DOUBLE)) END"""


def sql_tau(s: str) -> str:
    return f"""CASE WHEN len({s}) < 3 THEN 0.7::DOUBLE ELSE least(greatest(1.0::DOUBLE -
      list_sort({s})[CAST(greatest(least(ceil((1.0::DOUBLE - 0.05::DOUBLE) * (len({s}) + 1)) - 1, len({s}) - 1), 0) AS BIGINT) + 1],
      0.6::DOUBLE), 0.99::DOUBLE) END"""


SQL_WINDOW = f"""{I.SQL_FEEDBACK},
win AS (SELECT * FROM (SELECT entry_id, seq, {SCORE} AS score, similarity, was_correct,
          row_number() OVER (PARTITION BY entry_id ORDER BY seq DESC) AS age FROM feedback) WHERE age <= {WINDOW})"""


@query(
    "conformal_threshold",
    f"""WITH {SQL_WINDOW}, s AS (SELECT entry_id, list(score) AS sc FROM win GROUP BY entry_id)
        SELECT entry_id, CAST(len(sc) AS BIGINT) AS n_scores, round({sql_tau('sc')}, 6) AS threshold FROM s""",
)
def conformal_threshold(spark, sf):
    t = C.conformal_thresholds(I.feedback(spark, sf), CFG)
    return t.withColumn("threshold", F.round("threshold", 6))


@query(
    "conformal_threshold_strict",
    f"""WITH {SQL_WINDOW}, s AS (SELECT entry_id, list(score) AS sc, max(similarity) FILTER (NOT was_correct) AS worst FROM win GROUP BY entry_id)
        SELECT entry_id, CAST(len(sc) AS BIGINT) AS n_scores,
          round(least(greatest({sql_tau('sc')}, coalesce(worst + 1e-6::DOUBLE, 0.0::DOUBLE)), 0.99::DOUBLE), 6) AS threshold FROM s""",
)
def conformal_threshold_strict(spark, sf):
    t = C.conformal_thresholds(I.feedback(spark, sf), CFG, mode="strict")
    return t.withColumn("threshold", F.round("threshold", 6))


@query(
    "calibration_stats",
    f"""WITH {I.SQL_FEEDBACK}, e AS (SELECT entry_id, count(*) AS n, count(*) FILTER (was_correct) AS g FROM feedback GROUP BY 1)
        SELECT count(*) AS total_entries, count(*) FILTER (n >= 3) AS calibrated_entries, CAST(sum(n) AS BIGINT) AS total_updates,
          CAST(sum(g) AS BIGINT) AS correct_updates, CAST(sum(n - g) AS BIGINT) AS incorrect_updates FROM e""",
)
def calibration_stats(spark, sf):
    return C.calibration_stats(I.feedback(spark, sf))


@query(
    "vcache_threshold",
    f"""WITH {I.SQL_FEEDBACK}, s AS (SELECT entry_id, list_sort(list(CASE WHEN was_correct THEN similarity ELSE similarity + 0.1::DOUBLE END)) AS s
          FROM (SELECT *, row_number() OVER (PARTITION BY entry_id ORDER BY seq DESC) AS age FROM feedback) WHERE age <= 50 GROUP BY entry_id)
        SELECT entry_id, round(CASE WHEN len(s) < 3 THEN 0.8::DOUBLE ELSE greatest(0.6::DOUBLE, least(0.99::DOUBLE,
          s[CAST(greatest(0, floor((1.0::DOUBLE - 0.05::DOUBLE) * len(s)) - 1) AS BIGINT) + 1])) END, 6) AS threshold FROM s""",
)
def vcache_threshold(spark, sf):
    return C.vcache_thresholds(I.feedback(spark, sf)).withColumn("threshold", F.round("threshold", 6))


@query("calibration_window", f"WITH {SQL_WINDOW} SELECT entry_id, seq, round(score, 6) AS score, age FROM win")
def calibration_window(spark, sf):
    w = C.calibration_window(I.feedback(spark, sf), CFG)
    return w.withColumn("score", F.round("score", 6)).withColumn("age", F.col("age").cast("bigint"))


@query(
    "threshold_trace",
    f"""WITH {I.SQL_FEEDBACK}, s AS (SELECT entry_id, seq, list({SCORE}) OVER (PARTITION BY entry_id ORDER BY seq
          ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW) AS sc FROM feedback)
        SELECT entry_id, seq, round({sql_tau('sc')}, 6) AS threshold FROM s""",
)
def threshold_trace(spark, sf):
    return C.threshold_trace(I.feedback(spark, sf), CFG).withColumn("threshold", F.round("threshold", 6))


@query(
    "adaptive_global_threshold",
    f"""WITH {I.SQL_LOG} SELECT seq, round(greatest(0.65::DOUBLE, avg(similarity) OVER w - stddev_pop(similarity) OVER w), 6) AS threshold
        FROM query_log WHERE hit WINDOW w AS (ORDER BY seq ROWS BETWEEN 199 PRECEDING AND CURRENT ROW)""",
)
def adaptive_global_threshold(spark, sf):
    t = C.adaptive_global_threshold(I.query_log(spark, sf).filter("hit"))
    return t.withColumn("threshold", F.round("threshold", 6))


# A very slow answer stands for a detected change of its shard.
SLOW_MS = 300

SQL_POSTERIOR = f"""{I.SQL_REWARDS},
resets AS (SELECT 'shard-' || CAST(tenant_id % 4 AS VARCHAR) AS shard_id, max(seq) AS reset_seq FROM query_log
           WHERE latency_ms > {SLOW_MS} GROUP BY 1),
grid AS (SELECT shard_id, arm, round(0.65::DOUBLE + arm * (0.95::DOUBLE - 0.65::DOUBLE) / 9, 6) AS threshold
         FROM (SELECT DISTINCT shard_id FROM rewards), (SELECT unnest(range(10)) AS arm)),
kept AS (SELECT r.*, reset_seq FROM rewards r LEFT JOIN resets USING (shard_id)
         WHERE reward IS NOT NULL AND reward <> 0.5 AND (reset_seq IS NULL OR seq > reset_seq)),
posterior AS (SELECT g.shard_id, CAST(g.arm AS INTEGER) AS arm, g.threshold,
    CASE WHEN s.reset_seq IS NULL THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END + coalesce(sum(reward), 0.0::DOUBLE) AS alpha,
    CASE WHEN s.reset_seq IS NULL THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END + coalesce(sum(1.0::DOUBLE - reward), 0.0::DOUBLE) AS beta,
    count(reward) AS updates
  FROM grid g LEFT JOIN resets s ON g.shard_id = s.shard_id LEFT JOIN kept k ON g.shard_id = k.shard_id AND g.arm = k.arm
  GROUP BY g.shard_id, g.arm, g.threshold, s.reset_seq)"""


def posterior(spark, sf):
    shard = F.concat(F.lit("shard-"), (F.col("tenant_id") % 4).cast("string"))
    slow = I.query_log(spark, sf).filter(F.col("latency_ms") > SLOW_MS)
    resets = slow.groupBy(shard.alias("shard_id")).agg(F.max("seq").alias("reset_seq"))
    return B.bandit_posterior(I.rewards(spark, sf), resets)


@query(
    "bandit_posterior",
    f"WITH {SQL_POSTERIOR} SELECT shard_id, arm, threshold, round(alpha, 6) AS alpha, round(beta, 6) AS beta, updates FROM posterior",
)
def bandit_posterior(spark, sf):
    return posterior(spark, sf).select(
        "shard_id", "arm", F.round("threshold", 6).alias("threshold"), F.round("alpha", 6).alias("alpha"),
        F.round("beta", 6).alias("beta"), "updates",
    )


@query(
    "best_arm",
    f"""WITH {SQL_POSTERIOR} SELECT shard_id, arm AS best_arm, threshold AS best_threshold, round(alpha / (alpha + beta), 6) AS expected,
          updates_all AS total_updates
        FROM (SELECT *, CAST(sum(updates) OVER (PARTITION BY shard_id) AS BIGINT) AS updates_all FROM posterior)
        QUALIFY row_number() OVER (PARTITION BY shard_id ORDER BY alpha / (alpha + beta) DESC, arm) = 1""",
)
def best_arm(spark, sf):
    b = B.best_arm(posterior(spark, sf))
    return b.select(
        "shard_id", "best_arm", F.round("best_threshold", 6).alias("best_threshold"), F.round("expected", 6).alias("expected"),
        "total_updates",
    )


@query(
    "fedavg_merge",
    f"""WITH {SQL_POSTERIOR} SELECT arm, threshold, round(avg(alpha), 6) AS alpha, round(avg(beta), 6) AS beta, count(*) AS shards
        FROM posterior GROUP BY arm, threshold""",
)
def fedavg_merge(spark, sf):
    m = B.fedavg_merge(posterior(spark, sf))
    return m.select("arm", F.round("threshold", 6).alias("threshold"), F.round("alpha", 6).alias("alpha"), F.round("beta", 6).alias("beta"), "shards")


@query(
    "spread_merged",
    f"""WITH {SQL_POSTERIOR}, merged AS (SELECT arm, avg(alpha) AS alpha, avg(beta) AS beta FROM posterior GROUP BY arm)
        SELECT p.shard_id, p.arm, round(p.threshold, 6) AS threshold, p.updates, round(m.alpha, 6) AS alpha, round(m.beta, 6) AS beta
        FROM posterior p JOIN merged m ON m.arm = p.arm""",
)
def spread_merged(spark, sf):
    """Every shard goes on with the merged posterior."""
    s = B.spread_merged(posterior(spark, sf))
    return s.select("shard_id", "arm", F.round("threshold", 6).alias("threshold"), "updates", F.round("alpha", 6).alias("alpha"), F.round("beta", 6).alias("beta"))


def _sql_drift(delta: float) -> str:
    return f"""WITH {I.SQL_LOG},
      s AS (SELECT tenant_id, seq, CASE WHEN event_type = 'error' THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS reward FROM query_log),
      p AS (SELECT *, row_number() OVER w AS l, sum(reward) OVER w AS ls, count(*) OVER (PARTITION BY tenant_id) AS n,
              sum(reward) OVER (PARTITION BY tenant_id) AS total FROM s WINDOW w AS (PARTITION BY tenant_id ORDER BY seq)),
      m AS (SELECT *, abs(ls / l - (total - ls) / (n - l)) - sqrt(0.5::DOUBLE * (1.0::DOUBLE / l + 1.0::DOUBLE / (n - l)) * ln(4.0::DOUBLE * n / {delta}::DOUBLE)) AS margin
            FROM p WHERE n >= 20 AND l >= 10 AND n - l >= 10)
    SELECT tenant_id, max(n) AS n, min(l) FILTER (margin >= 0) AS first_split, round(max(margin), 6) AS max_margin FROM m GROUP BY tenant_id"""


def _drift(spark, sf, delta):
    series = I.query_log(spark, sf).select("tenant_id", "seq", F.when(F.col("event_type") == "error", 0.0).otherwise(1.0).alias("reward"))
    return D.drift_scan(series, ["tenant_id"], delta).withColumn("max_margin", F.round("max_margin", 6))


@query("drift_scan", _sql_drift(0.002))
def drift_scan(spark, sf):
    return _drift(spark, sf, 0.002)


@query("drift_scan_sensitive", _sql_drift(200.0))
def drift_scan_sensitive(spark, sf):
    """The same test with a bound loose enough that splits are found in this log."""
    return _drift(spark, sf, 200.0)
