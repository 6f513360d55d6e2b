"""Running, rolling and sequence queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from recollect.catalog import inputs as I
from recollect.catalog import query
from recollect.catalog.metrics import SQL_BUCKETS, bucketed
from recollect.operators import metrics as M
from recollect.operators import sessions as SE


@query(
    "running_hit_rate",
    f"""WITH {I.SQL_LOG} SELECT query_id, seq,
          CAST(count(*) FILTER (hit) OVER w AS DOUBLE) / count(*) OVER w AS hit_rate
        FROM query_log WINDOW w AS (ORDER BY seq)""",
)
def running_hit_rate(spark, sf):
    return M.running_hit_rate(I.query_log(spark, sf))


@query(
    "running_hit_rate_by_tenant",
    f"""WITH {I.SQL_LOG} SELECT tenant_id, query_id, seq,
          CAST(count(*) FILTER (hit) OVER w AS DOUBLE) / count(*) OVER w AS hit_rate
        FROM query_log WINDOW w AS (PARTITION BY tenant_id ORDER BY seq)""",
)
def running_hit_rate_by_tenant(spark, sf):
    return M.running_hit_rate(I.query_log(spark, sf), ["tenant_id"])


@query(
    "rolling_latency",
    f"""WITH {I.SQL_LOG} SELECT query_id, hit,
          round(avg(latency_ms) OVER (ORDER BY seq ROWS BETWEEN 999 PRECEDING AND CURRENT ROW) + 1e-12::DOUBLE, 9) AS avg_all,
          round(avg(latency_ms) OVER (PARTITION BY hit ORDER BY seq ROWS BETWEEN 999 PRECEDING AND CURRENT ROW) + 1e-12::DOUBLE, 9) AS avg_same
        FROM query_log""",
)
def rolling_latency(spark, sf):
    # Means over a power-of-two count end in an exact half; the nudge settles which way it rounds.
    r = M.rolling_latency(I.query_log(spark, sf))
    return r.select("query_id", "hit", *[F.round(F.col(c) + 1e-12, 9).alias(c) for c in ("avg_all", "avg_same")])


@query(
    "chat_history",
    f"""WITH {I.SQL_MESSAGES} SELECT session_id, -CAST(age AS INTEGER) AS at, role, text AS content FROM (
          SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY created_at DESC, id DESC) AS age FROM messages)
        WHERE age <= 4 AND role IN ('user', 'assistant')""",
)
def chat_history(spark, sf):
    h = SE.chat_history(I.messages(spark, sf), max_turns=2)
    return h.select("session_id", F.explode("history").alias("h")).select("session_id", "h.*")


def requests(spark, sf):
    return I.query_log(spark, sf).select("tenant_id", "query_id", "seq", "ts")


@query(
    "sessionize",
    f"""WITH {I.SQL_LOG},
          f AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) > 7200000000 THEN 1 ELSE 0 END AS fresh
                FROM query_log WINDOW w AS (PARTITION BY tenant_id ORDER BY seq)),
          s AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY tenant_id ORDER BY seq) AS BIGINT) AS segment FROM f)
        SELECT tenant_id, query_id, segment, row_number() OVER (PARTITION BY tenant_id, segment ORDER BY seq) AS turn FROM s""",
)
def sessionize(spark, sf):
    return SE.sessionize(requests(spark, sf), ["tenant_id"], timeout_s=7200).select("tenant_id", "query_id", "segment", "turn")


@query(
    "access_profile",
    f"""WITH {I.SQL_LOG} SELECT tenant_id, query_id, row_number() OVER w AS frequency, lag(ts) OVER w AS last_access,
          round((epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1e6::DOUBLE, 6) AS gap_s
        FROM query_log WINDOW w AS (PARTITION BY tenant_id ORDER BY seq)""",
)
def access_profile(spark, sf):
    return M.access_profile(I.query_log(spark, sf), ["tenant_id"])


@query(
    "frequency_as_of",
    f"WITH {SQL_BUCKETS} SELECT vec_id AS query_id, vec_id AS seq, bucket, row_number() OVER (PARTITION BY bucket ORDER BY vec_id) AS frequency FROM buckets",
)
def frequency_as_of(spark, sf):
    return M.frequency_as_of(bucketed(spark, sf), "bucket")


@query(
    "failure_streaks",
    f"""WITH {I.SQL_LOG},
          n AS (SELECT tenant_id % 5 AS dependency, seq, event_type <> 'error' AS ok,
                  row_number() OVER (PARTITION BY tenant_id % 5 ORDER BY seq) AS rn FROM query_log),
          l AS (SELECT *, coalesce(max(CASE WHEN ok THEN rn END) OVER (PARTITION BY dependency ORDER BY seq), 0) AS last_ok FROM n)
        SELECT dependency, seq, rn - last_ok AS streak, rn - last_ok >= 3 AS open FROM l""",
)
def failure_streaks(spark, sf):
    calls = I.query_log(spark, sf).select(
        (F.col("tenant_id") % 5).alias("dependency"), "seq", (F.col("event_type") != "error").alias("ok")
    )
    return M.failure_streaks(calls, ["dependency"], threshold=3)


SQL_REUSE = f"""{I.SQL_LOG},
u AS (SELECT event_type, tenant_id AS item, seq, lag(seq) OVER (PARTITION BY event_type, tenant_id ORDER BY seq) AS prev FROM query_log),
d AS (SELECT u.event_type, u.seq, u.item, CASE WHEN u.prev IS NOT NULL THEN count(DISTINCT b.item) END AS distance
      FROM u LEFT JOIN u b ON u.event_type = b.event_type AND b.seq > u.prev AND b.seq < u.seq
      GROUP BY u.event_type, u.seq, u.item, u.prev)"""


def _distances(spark, sf):
    return M.reuse_distance(I.query_log(spark, sf), ["event_type"], "tenant_id")


@query("reuse_distance", f"WITH {SQL_REUSE} SELECT event_type, seq, item AS tenant_id, distance FROM d")
def reuse_distance(spark, sf):
    return _distances(spark, sf)


@query(
    "miss_ratio_curve",
    f"""WITH {SQL_REUSE}, t AS (SELECT event_type, count(*) AS uses FROM d GROUP BY 1)
        SELECT event_type, uses, capacity, round(1 - hits / uses::DOUBLE, 6) AS miss_ratio FROM (
          SELECT t.event_type, t.uses, c.capacity, count(d.seq) AS hits
          FROM t CROSS JOIN (SELECT unnest([10, 50, 100]) AS capacity) c
          LEFT JOIN d ON d.event_type = t.event_type AND d.distance < c.capacity GROUP BY t.event_type, t.uses, c.capacity)""",
)
def miss_ratio_curve(spark, sf):
    return M.miss_ratio_curve(_distances(spark, sf), ["event_type"], [10, 50, 100])
