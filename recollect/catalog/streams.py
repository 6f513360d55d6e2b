"""Sequential and streaming queries, the batch step and the strategy comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from recollect.catalog import inputs as I
from recollect.catalog import query
from recollect.catalog.calibration import SCORE, SQL_POSTERIOR, posterior, sql_tau
from recollect.catalog.vectors import DIM
from recollect.config import CacheConfig
from recollect.functions.draws import beta, sql_beta
from recollect.operators import sequential as SQ
from recollect.operators import step as ST
from recollect.operators import strategies as SG
from recollect.plans.materialize import stored
from recollect.streaming import cache as SC
from recollect.streaming import ordered as SO
from recollect.streaming import queries as Q

RATE, BURST = 1 / 43_200, 3
BREAK = CacheConfig(breaker_failures=2, breaker_reset_s=36_000.0)
SENSITIVE = CacheConfig(drift_delta=50.0)
#: Rows per block, and maps composed at once: small enough that the keys of these tables have several levels of blocks.
SPREAD = {"width": 12, "fan": 2}


def talking(spark, sf):
    """Documents with a vector as turns of their source's session, one minute per id."""
    q = I.queries(spark, sf).filter(F.col("embedding").isNotNull())
    ts = F.lit(I.EPOCH).cast("timestamp") + F.make_dt_interval(secs=F.col("seq") * 60)
    return q.select("session_id", "query_id", "seq", ts.alias("ts"), "embedding")


SQL_FUSION = f"""RECURSIVE {I.SQL_QUERIES},
t AS (SELECT session_id, query_id, seq, seq * 60 AS tm, embedding::DOUBLE[] AS q FROM queries WHERE embedding IS NOT NULL),
f AS (SELECT *, CASE WHEN lag(tm) OVER w IS NULL OR tm - lag(tm) OVER w > 1800 THEN 1 ELSE 0 END AS fresh
      FROM t WINDOW w AS (PARTITION BY session_id ORDER BY seq)),
s AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY session_id ORDER BY seq) AS BIGINT) AS segment FROM f),
n AS (SELECT *, row_number() OVER (PARTITION BY session_id, segment ORDER BY seq) AS turn FROM s),
r AS (
  SELECT session_id, segment, turn, query_id, q AS fused, q AS ctx FROM n WHERE turn = 1
  UNION ALL
  SELECT session_id, segment, turn, query_id,
    list_transform(fu, lambda x: x / sqrt(list_dot_product(fu, fu))), list_transform(cu, lambda x: x / sqrt(list_dot_product(cu, cu)))
  FROM (SELECT n.session_id, n.segment, n.turn, n.query_id,
          list_transform(list_zip(n.q, r.ctx), lambda p: 0.85::DOUBLE * p[1] + 0.15::DOUBLE * p[2]) AS fu,
          list_transform(list_zip(n.q, r.ctx), lambda p: 0.5::DOUBLE * p[1] + 0.5::DOUBLE * p[2]) AS cu
        FROM r JOIN n ON n.session_id = r.session_id AND n.segment = r.segment AND n.turn = r.turn + 1)
)"""

_FUSED = """SELECT query_id, CAST(turn AS INTEGER) AS turn, round(list_sum(fused), 6) AS fused_sum, round(fused[1], 6) AS first,
          round(fused[64], 6) AS last FROM r"""


def _shape(fused):
    total = F.aggregate("fused", F.lit(0.0), lambda s, x: s + x)
    return fused.select(
        "query_id", F.col("turn").cast("int").alias("turn"), F.round(total, 6).alias("fused_sum"),
        F.round(F.col("fused")[0], 6).alias("first"), F.round(F.col("fused")[63], 6).alias("last"),
    )


@query("session_fusion", f"WITH {SQL_FUSION} {_FUSED}")
def session_fusion(spark, sf):
    return _shape(SQ.session_fusion(talking(spark, sf), chunk=256, lead=128))


SQL_BUCKET = f"""RECURSIVE {I.SQL_LOG},
n AS (SELECT tenant_id, seq, epoch_us(ts) / 1e6::DOUBLE AS tm, row_number() OVER (PARTITION BY tenant_id ORDER BY seq) AS i FROM query_log),
b AS (
  SELECT tenant_id, i, seq, tm, true AS allowed, {BURST}::DOUBLE - 1 AS tokens FROM n WHERE i = 1
  UNION ALL
  SELECT tenant_id, i, seq, tm, have >= 1.0, have - CASE WHEN have >= 1.0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END
  FROM (SELECT n.tenant_id, n.i, n.seq, n.tm, least({BURST}::DOUBLE, b.tokens + (n.tm - b.tm) * (1.0::DOUBLE / 43200.0::DOUBLE)) AS have
        FROM b JOIN n ON n.tenant_id = b.tenant_id AND n.i = b.i + 1)
)
SELECT tenant_id, seq, allowed, round(tokens, 4) AS tokens FROM b"""


@query("token_bucket", f"WITH {SQL_BUCKET}")
def token_bucket(spark, sf):
    out = SQ.token_bucket(I.query_log(spark, sf), RATE, BURST)
    return out.select("tenant_id", "seq", "allowed", F.round("tokens", 4).alias("tokens"))


@query("token_bucket_blocks", f"WITH {SQL_BUCKET}")
def token_bucket_blocks(spark, sf):
    """The same with every tenant cut into small blocks, whose maps are composed."""
    out = SQ.token_bucket(I.query_log(spark, sf), RATE, BURST, **SPREAD)
    return out.select("tenant_id", "seq", "allowed", F.round("tokens", 4).alias("tokens"))


SQL_BREAKER = f"""RECURSIVE {I.SQL_LOG},
n AS (SELECT tenant_id AS dependency, seq, epoch_us(ts) / 1e6::DOUBLE AS tm, event_type <> 'error' AS ok,
        row_number() OVER (PARTITION BY tenant_id ORDER BY seq) AS i FROM query_log),
b AS (
  SELECT dependency, i, seq, ok, tm, 'closed' AS seen, 'closed' AS phase, CASE WHEN ok THEN 0 ELSE 1 END AS fails,
         CASE WHEN ok THEN 0.0::DOUBLE ELSE tm END AS failed_at FROM n WHERE i = 1
  UNION ALL
  SELECT dependency, i, seq, ok, tm, now_phase,
    CASE WHEN now_phase = 'open' THEN 'open' WHEN ok THEN 'closed' WHEN fails + 1 >= 2 THEN 'open' ELSE now_phase END,
    CASE WHEN now_phase = 'open' THEN fails WHEN ok THEN 0 ELSE fails + 1 END,
    CASE WHEN now_phase <> 'open' AND NOT ok THEN tm ELSE failed_at END
  FROM (SELECT n.dependency, n.i, n.seq, n.ok, n.tm, b.fails, b.failed_at,
          CASE WHEN b.phase = 'open' AND n.tm - b.failed_at >= 36000 THEN 'half_open' ELSE b.phase END AS now_phase
        FROM b JOIN n ON n.dependency = b.dependency AND n.i = b.i + 1)
)"""


def calls(spark, sf):
    return I.query_log(spark, sf).select(
        F.col("tenant_id").alias("dependency"), "seq", "ts", (F.col("event_type") != "error").alias("ok")
    )


@query(
    "breaker_states",
    f"WITH {SQL_BREAKER} SELECT dependency, seq, ok, seen AS state, seen = 'open' AS rejected, phase AS state_after FROM b",
)
def breaker_states(spark, sf):
    return SQ.breaker_states(calls(spark, sf), BREAK)


@query(
    "breaker_states_blocks",
    f"WITH {SQL_BREAKER} SELECT dependency, seq, ok, seen AS state, seen = 'open' AS rejected, phase AS state_after FROM b",
)
def breaker_states_blocks(spark, sf):
    """The same with every dependency cut into small blocks, whose maps are composed."""
    return SQ.breaker_states(calls(spark, sf), BREAK, **SPREAD)


@query(
    "breaker_stats",
    f"""WITH {SQL_BREAKER} SELECT dependency, count(*) AS total_calls, count(*) FILTER (seen <> 'open' AND NOT ok) AS total_failures,
          count(*) FILTER (seen <> 'open' AND ok) AS total_successes, count(*) FILTER (seen = 'open') AS rejected_calls,
          max_by(phase, seq) AS state FROM b GROUP BY dependency""",
)
def breaker_stats(spark, sf):
    return SQ.breaker_stats(SQ.breaker_states(calls(spark, sf), BREAK))


def sql_cut(window: str, delta: float) -> str:
    """First split of a list whose sides differ by more than the bound, 0 if there is none."""
    gap = f"abs(list_sum({window}[1:l]) / l - list_sum({window}[l + 1:]) / (len({window}) - l))"
    bound = f"sqrt(0.5::DOUBLE * (1.0::DOUBLE / l + 1.0::DOUBLE / (len({window}) - l)) * ln(4.0::DOUBLE * len({window}) / {delta}::DOUBLE))"
    splits = f"list_filter(range(10, len({window}) - 9), lambda l: {gap} >= {bound})"
    return f"coalesce(CASE WHEN len({window}) >= 20 THEN ({splits})[1] END, 0)"


def sql_added(window: str, value: str) -> str:
    """A window with one more value, the oldest dropped where it is full."""
    return f"list_append(CASE WHEN len({window}) >= {SENSITIVE.drift_window} THEN {window}[2:] ELSE {window} END, {value})"


def sql_drift(series: str) -> str:
    """The drift test value by value over a CTE (shard_id, seq, reward)."""
    return f"""
n AS (SELECT shard_id, seq, reward, row_number() OVER (PARTITION BY shard_id ORDER BY seq) AS i FROM {series}),
d AS (
  SELECT shard_id, i, seq, [reward] AS w, CAST(0 AS BIGINT) AS cut FROM n WHERE i = 1
  UNION ALL
  SELECT shard_id, i, seq, w[cut + 1:], cut FROM (SELECT *, {sql_cut('w', SENSITIVE.drift_delta)} AS cut FROM (
    SELECT n.shard_id, n.i, n.seq, {sql_added('d.w', 'n.reward')} AS w FROM d JOIN n ON n.shard_id = d.shard_id AND n.i = d.i + 1)))
SELECT shard_id, seq, cut > 0 AS changed, CAST(cut AS BIGINT) AS cut, CAST(len(w) AS BIGINT) AS window_size FROM d"""


def sql_bandit(rewards: str) -> str:
    """Posteriors with resets, reward by reward, over a CTE (shard_id, seq, arm, reward)."""
    count = lambda col, gain: f"CASE WHEN telling THEN list_transform({col}, lambda x, j: CASE WHEN j = arm + 1 THEN x + {gain} ELSE x END) ELSE {col} END"
    fresh = lambda col: f"CASE WHEN cut > 0 THEN list_transform({col}, lambda x: 2.0::DOUBLE) ELSE {col} END"
    ones = "list_transform(range(10), lambda x: 1.0::DOUBLE)"
    return f"""
n AS (SELECT *, reward IS NOT NULL AND reward <> 0.5 AS telling, row_number() OVER (PARTITION BY shard_id ORDER BY seq) AS i FROM {rewards}),
p AS (
  SELECT DISTINCT shard_id, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS BIGINT) AS arm, {ones} AS a, {ones} AS b, CAST([] AS DOUBLE[]) AS w,
    CAST(0 AS BIGINT) AS resets, false AS reset FROM n
  UNION ALL
  SELECT shard_id, i, seq, arm, {fresh('a')}, {fresh('b')}, CASE WHEN cut > 0 THEN w[cut + 1:] ELSE w END, resets + CASE WHEN cut > 0 THEN 1 ELSE 0 END, cut > 0
  FROM (SELECT *, CASE WHEN telling THEN {sql_cut('w', SENSITIVE.drift_delta)} ELSE 0 END AS cut FROM (
    SELECT shard_id, i, seq, arm, telling, resets, {count('a', 'reward')} AS a, {count('b', '1 - reward')} AS b,
      CASE WHEN telling THEN {sql_added('w', 'reward')} ELSE w END AS w
    FROM (SELECT n.shard_id, n.i, n.seq, CAST(n.arm AS BIGINT) AS arm, n.reward, n.telling, p.a, p.b, p.w, p.resets
          FROM p JOIN n ON n.shard_id = p.shard_id AND n.i = p.i + 1))))
SELECT shard_id, seq, arm AS used_arm, round(a[arm + 1], 6) AS alpha, round(b[arm + 1], 6) AS beta, reset, resets FROM p WHERE i > 0"""


SQL_USER_REWARDS = I.SQL_REWARDS.replace("CAST(tenant_id % 4 AS VARCHAR)", "CAST(tenant_id AS VARCHAR)")


def _drift_columns(out):
    return out.select("shard_id", "seq", "changed", F.col("cut").cast("bigint").alias("cut"), F.col("window_size").cast("bigint").alias("window_size"))


def _bandit_columns(out):
    return out.select(
        "shard_id", "seq", F.col("used_arm").cast("bigint").alias("used_arm"), F.round("alpha", 6).alias("alpha"),
        F.round("beta", 6).alias("beta"), "reset", F.col("resets").cast("bigint").alias("resets"),
    )


@query("drift_windows", f"WITH RECURSIVE {SQL_USER_REWARDS}, told AS (SELECT * FROM rewards WHERE reward IS NOT NULL), {sql_drift('told')}")
def drift_windows(spark, sf):
    series = I.rewards(spark, sf, None).filter(F.col("reward").isNotNull())
    return _drift_columns(SQ.drift_windows(series, ["shard_id"], SENSITIVE))


@query("bandit_updates", f"WITH RECURSIVE {SQL_USER_REWARDS}, {sql_bandit('rewards')}")
def bandit_updates(spark, sf):
    return _bandit_columns(SQ.bandit_updates(I.rewards(spark, sf, None), SENSITIVE))


THOMPSON_KEY = "'42:' || shard_id || ':' || CAST(arm AS VARCHAR)"


@query(
    "thompson_sample",
    f"""WITH {SQL_POSTERIOR},
        rounded AS (SELECT shard_id, arm, threshold, round(alpha, 6) AS a, round(beta, 6) AS b FROM posterior),
        drawn AS (SELECT shard_id, arm, threshold, {sql_beta('a', 'b', THOMPSON_KEY)} AS draw FROM rounded)
        SELECT shard_id, arm, round(threshold, 6) AS threshold, round(draw, 6) AS draw FROM drawn
        QUALIFY row_number() OVER (PARTITION BY shard_id ORDER BY draw DESC, arm) = 1""",
)
def thompson_sample(spark, sf):
    rounded = posterior(spark, sf).withColumn("alpha", F.round("alpha", 6)).withColumn("beta", F.round("beta", 6))
    best = SQ.thompson_sample(rounded, 42)
    return best.select("shard_id", "arm", F.round("threshold", 6).alias("threshold"), F.round("draw", 6).alias("draw"))


@query(
    "thompson_spread",
    f"""WITH {SQL_POSTERIOR},
        rounded AS (SELECT shard_id, arm, round(alpha, 6) AS a, round(beta, 6) AS b FROM posterior WHERE arm < 3),
        keyed AS (SELECT *, CAST(i AS VARCHAR) || ':' || shard_id || ':' || CAST(arm AS VARCHAR) AS key FROM rounded, (SELECT unnest(range(500)) AS i)),
        drawn AS (SELECT shard_id, arm, a, b, {sql_beta('a', 'b', 'key')} AS x FROM keyed)
        SELECT shard_id, arm, round(a / (a + b), 6) AS mean, round(avg(x), 6) AS drawn_mean,
          round(sqrt(a * b / ((a + b) ** 2 * (a + b + 1))), 6) AS deviation, round(stddev_pop(x), 6) AS drawn_deviation
        FROM drawn GROUP BY shard_id, arm, a, b""",
)
def thompson_spread(spark, sf):
    """500 draws of some arms: their mean and deviation beside those of the posterior."""
    p = posterior(spark, sf).filter("arm < 3").select("shard_id", "arm", F.round("alpha", 6).alias("a"), F.round("beta", 6).alias("b"))
    many = p.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(499))))
    x = many.withColumn("x", beta(F.col("a"), F.col("b"), F.concat_ws(":", F.col("i").cast("string"), "shard_id", F.col("arm").cast("string"))))
    a, b = F.col("a"), F.col("b")
    return x.groupBy("shard_id", "arm", "a", "b").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s")).select(
        "shard_id", "arm", F.round(a / (a + b), 6).alias("mean"), F.round("m", 6).alias("drawn_mean"),
        F.round(F.sqrt(a * b / (F.pow(a + b, F.lit(2)) * (a + b + 1))), 6).alias("deviation"), F.round("s", 6).alias("drawn_deviation"),
    )


def log_stream(spark, sf):
    """The event table as a file stream, with the roles of the query log."""
    schema = I.table(spark, sf, "events").schema
    e = Q.read_stream(spark, f"{sf}/events*.parquet", schema)
    hit = F.col("event_type").isin("click", "view", "purchase")
    return e.select(
        F.col("event_id").alias("seq"), F.col("user_id").alias("tenant_id"), F.col("ts").cast("timestamp").alias("ts"),
        hit.alias("hit"), F.when(F.col("event_type") == "click", 1).otherwise(2).alias("tier"),
        F.col("value").alias("latency_ms"), "event_type", F.from_json("props", "k INT").getField("k").alias("k"),
    )


def run(spark, stream, name, **kw):
    return Q.run_available(stream, I.scratch(spark, name), I.scratch(spark, name + "-progress"), **kw)


@query(
    "stream_metrics",
    f"""WITH {I.SQL_LOG} SELECT date_trunc('hour', ts) AS start, count(*) AS queries, count(*) FILTER (hit) AS hits,
          count(*) FILTER (hit AND tier = 1) AS tier1_hits, round(avg(latency_ms), 9) AS avg_latency_ms
        FROM query_log GROUP BY 1""",
)
def stream_metrics(spark, sf):
    """Closed windows as the stream emits them, open ones from its state."""
    progress = I.scratch(spark, "metrics-progress")
    out = Q.run_available(Q.stream_metrics(log_stream(spark, sf)), I.scratch(spark, "metrics"), progress)
    out = out.unionByName(Q.open_windows(spark, progress))
    return out.select(
        F.col("start").cast("timestamp_ntz").alias("start"), "queries", "hits", "tier1_hits",
        F.round("avg_latency_ms", 9).alias("avg_latency_ms"),
    )


@query(
    "stream_sessions",
    f"""WITH {I.SQL_LOG},
          f AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 2 HOUR THEN 1 ELSE 0 END AS fresh
                FROM query_log WINDOW w AS (PARTITION BY tenant_id ORDER BY seq)),
          s AS (SELECT *, sum(fresh) OVER (PARTITION BY tenant_id ORDER BY seq) AS segment FROM f)
        SELECT tenant_id AS session_id, min(ts) AS start, max(ts) + INTERVAL 2 HOUR AS "end", count(*) AS turn_count FROM s GROUP BY tenant_id, segment""",
)
def stream_sessions(spark, sf):
    """Finished sessions as the stream emits them, those that may go on from its state."""
    requests = log_stream(spark, sf).withColumnRenamed("tenant_id", "session_id")
    progress = I.scratch(spark, "sessions-progress")
    out = Q.run_available(Q.stream_sessions(requests, "2 hours"), I.scratch(spark, "sessions"), progress)
    out = out.unionByName(Q.open_sessions(spark, progress))
    ntz = lambda c: F.col(c).cast("timestamp_ntz").alias(c)
    return out.select("session_id", ntz("start"), ntz("end"), "turn_count")


@query(
    "stream_exact_dedup",
    f"""WITH RECURSIVE r AS (SELECT doc_id AS query_id, {I.sql_key('text', 'lang')} AS exact_key, doc_id * 60 AS sec FROM documents),
        kept AS (SELECT exact_key, min(sec) AS sec FROM r GROUP BY exact_key
          UNION ALL SELECT k.exact_key, min(r.sec) FROM kept k JOIN r ON r.exact_key = k.exact_key AND r.sec >= k.sec + 21600 GROUP BY k.exact_key)
        SELECT r.query_id, r.exact_key FROM r JOIN kept USING (exact_key, sec)""",
)
def stream_exact_dedup(spark, sf):
    """Six hours to live; documents ask a minute apart."""
    schema = I.table(spark, sf, "documents").schema
    docs = Q.read_stream(spark, f"{sf}/documents*.parquet", schema, files_per_batch=8)
    requests = docs.select(
        F.col("doc_id").alias("query_id"), F.col("doc_id").alias("seq"), F.col("lang").alias("tenant_id"), F.col("text").alias("query_text"),
        (F.lit(I.EPOCH).cast("timestamp") + F.make_dt_interval(secs=F.col("doc_id") * 60)).alias("ts"),
    )
    out = run_ordered(spark, SO.keyed_requests(requests), "exact_key", SO.dedup_rule(21_600), "dedup", "1 hour")
    return out.select("query_id", "exact_key")


def run_ordered(spark, stream, key, rule, name, late="10 minutes"):
    return SO.run_ordered(stream, key, rule, I.scratch(spark, name), I.scratch(spark, name + "-progress"), late)


@query("stream_token_bucket", f"WITH {SQL_BUCKET}")
def stream_token_bucket(spark, sf):
    out = run_ordered(spark, log_stream(spark, sf), "tenant_id", SO.bucket_rule(RATE, BURST), "bucket")
    return out.select("tenant_id", "seq", "allowed", F.round("tokens", 4).alias("tokens"))


@query(
    "stream_breaker",
    f"WITH {SQL_BREAKER} SELECT dependency, seq, ok, seen AS state, seen = 'open' AS rejected, phase AS state_after FROM b",
)
def stream_breaker(spark, sf):
    c = log_stream(spark, sf).select(
        F.col("tenant_id").alias("dependency"), "seq", "ts", (F.col("event_type") != "error").alias("ok")
    )
    return run_ordered(spark, c, "dependency", SO.breaker_rule(BREAK), "breaker")


def _reward_stream(spark, sf):
    s = log_stream(spark, sf)
    return s.select(
        F.concat(F.lit("shard-"), F.col("tenant_id").cast("string")).alias("shard_id"), "seq",
        (F.col("k") % 10).alias("arm"), F.when(F.col("event_type") == "error", 0.0).otherwise(1.0).alias("reward"),
    )


SQL_STREAM_REWARDS = I.SQL_LOG + """,
streamed AS (SELECT 'shard-' || CAST(tenant_id AS VARCHAR) AS shard_id, seq, k % 10 AS arm,
  CASE WHEN event_type = 'error' THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS reward FROM query_log)"""


@query("drift_stream", f"WITH RECURSIVE {SQL_STREAM_REWARDS}, {sql_drift('streamed')}")
def drift_stream(spark, sf):
    return _drift_columns(run(spark, Q.stream_drift(_reward_stream(spark, sf), "shard_id", SENSITIVE), "drift"))


@query("bandit_stream", f"WITH RECURSIVE {SQL_STREAM_REWARDS}, {sql_bandit('streamed')}")
def bandit_stream(spark, sf):
    return _bandit_columns(run(spark, Q.stream_bandit(_reward_stream(spark, sf), SENSITIVE), "bandit"))


@query("stream_session_fusion", f"WITH {SQL_FUSION} {_FUSED}")
def stream_session_fusion(spark, sf):
    """The turns written as files and read back as a stream, some files at a time."""
    path = I.scratch(spark, "turns")
    rows = talking(spark, sf)
    rows.repartition(4).write.parquet(path)
    return _shape(run_ordered(spark, Q.read_stream(spark, path, rows.schema, files_per_batch=4), "session_id", SO.fusion_rule(), "fusion"))


@query(
    "stream_ttl",
    f"WITH {I.SQL_ENTRIES} SELECT entry_id, expires_at AS expired_at FROM entries WHERE expires_at < (SELECT max(created_at) FROM entries)",
)
def stream_ttl(spark, sf):
    path = I.scratch(spark, "entries")
    rows = I.entries(spark, sf).select(
        "entry_id", F.col("created_at").cast("timestamp").alias("ts"), F.col("expires_at").cast("timestamp").alias("expires_at")
    )
    rows.write.mode("overwrite").parquet(path)
    out = run(spark, Q.stream_ttl(Q.read_stream(spark, path, rows.schema)), "ttl")
    return out.select("entry_id", F.col("expired_at").cast("timestamp_ntz").alias("expired_at"))


STEP = CacheConfig(
    capacity=300, window_fraction=0.2, default_threshold=0.35, min_threshold=0.33, max_threshold=0.6, ttl_s=0
)


def step_inputs(spark, sf):
    """All documents as queries; every text has an answer."""
    q = I.queries(spark, sf)
    ts = F.lit(I.EPOCH).cast("timestamp") + F.make_dt_interval(secs=F.col("seq") * 60)
    batch = q.select("query_id", "seq", "tenant_id", "session_id", ts.alias("ts"), "query_text", "embedding")
    from recollect.functions import text as T

    docs = I.table(spark, sf, "documents")
    responses = docs.select(
        T.exact_key(F.col("text"), F.col("lang")).alias("exact_key"), F.col("text").alias("response_text"),
        T.word_count(F.col("text")).cast("bigint").alias("output_tokens"), (F.col("n_chars") / 10.0).alias("latency_ms"),
    )
    # written once: every step reads all answers
    responses = stored(responses.withColumn("cost_usd", F.col("output_tokens") / 1000 * F.lit(0.015)), "responses")
    return batch, responses


@query("cache_step")
def cache_step(spark, sf):
    """All documents asked in one batch of an empty cache, then all once more."""
    batch, responses = step_inputs(spark, sf)
    root = I.scratch(spark, "cache")
    now = F.lit(I.EPOCH).cast("timestamp")
    first = ST.cache_step(spark, root, 0, batch, responses, now, DIM, None, STEP)
    again = ST.cache_step(spark, root, 1, batch, responses, now, DIM, None, STEP)
    return first.withColumn("batch", F.lit(0)).unionByName(again.withColumn("batch", F.lit(1)))


@query("stream_cache")
def stream_cache(spark, sf):
    batch, responses = step_inputs(spark, sf)
    path, root = I.scratch(spark, "queries"), I.scratch(spark, "streamed")
    batch.write.mode("overwrite").parquet(path)
    stream = Q.read_stream(spark, path, batch.schema)
    SC.stream_cache(
        stream, responses, root, I.scratch(spark, "cache-progress"), DIM, None, STEP, now=F.lit(I.EPOCH).cast("timestamp")
    ).awaitTermination()
    return ST.read_log(spark, root)


FEEDBACK_SHARDS = 64

SQL_FEEDBACK_ARMS = sql_bandit("told").replace(", n.arm", "").replace("CAST(n.arm AS BIGINT) AS arm", "list_position(list_transform(list_zip(p.a, p.b), lambda x: x[1] / (x[1] + x[2])), list_max(list_transform(list_zip(p.a, p.b), lambda x: x[1] / (x[1] + x[2])))) - 1 AS arm").replace(str(SENSITIVE.drift_delta), str(CacheConfig().drift_delta))
SQL_LAST_ARMS = SQL_FEEDBACK_ARMS[: SQL_FEEDBACK_ARMS.rindex("SELECT shard_id, seq")]


@query(
    "feedback_step",
    f"""WITH RECURSIVE {I.SQL_FEEDBACK},
        ok AS (SELECT * FROM feedback WHERE entry_id IN (SELECT doc_id FROM labels JOIN documents USING (doc_id))),
        told AS (SELECT 'shard-' || CAST(entry_id % {FEEDBACK_SHARDS} AS VARCHAR) AS shard_id, seq, CASE WHEN was_correct THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS reward FROM ok),
        w AS (SELECT entry_id, {SCORE} AS score, row_number() OVER (PARTITION BY entry_id ORDER BY seq DESC) AS age FROM ok),
        s AS (SELECT entry_id, list(score) AS sc FROM w WHERE age <= 200 GROUP BY entry_id),
        {SQL_LAST_ARMS},
        ends AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY shard_id ORDER BY i DESC) = 1)
        SELECT 'log' AS part, entry_id || ':' || seq AS key, round(similarity, 6) AS a, CASE WHEN was_correct THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS b FROM ok
        UNION ALL SELECT 'threshold', CAST(entry_id AS VARCHAR), CAST(len(sc) AS DOUBLE), round({sql_tau('sc')}, 6) FROM s
        UNION ALL SELECT 'posterior', shard_id || ':' || arm, round(a[arm + 1], 6), round(b[arm + 1], 6) FROM (SELECT shard_id, a, b, unnest(range(10)) AS arm FROM ends)
        UNION ALL SELECT 'resets', shard_id, CAST(resets AS DOUBLE), CAST(len(w) AS DOUBLE) FROM ends""",
)
def feedback_step(spark, sf):
    """Every event as a judgement of the entry numbered like its user, in two steps: log, thresholds, posteriors, resets."""
    new = I.feedback(spark, sf).withColumn("shard_id", F.concat(F.lit("shard-"), (F.col("entry_id") % FEEDBACK_SHARDS).cast("string")))
    entries = I.entries(spark, sf)
    half = new.agg(F.percentile_approx("seq", 0.5)).first()[0]
    scores = arms = thresholds = log = None
    for part in (F.col("seq") <= half, F.col("seq") > half):
        accepted, recent, tau, moved = ST.feedback_merge(scores, arms, new.filter(part), entries)
        scores = stored(ST.replaced(scores, stored(recent, "recent"), "entry_id"), "scores")
        arms = stored(ST.replaced(arms, stored(moved, "moved"), "shard_id"), "arms")
        thresholds = stored(ST.replaced(thresholds, tau, "entry_id"), "thresholds")
        log = accepted if log is None else log.unionByName(accepted)

    def rows(df, part, key, a, b):
        return df.select(F.lit(part).alias("part"), key.alias("key"), F.round(a.cast("double"), 6).alias("a"), F.round(b.cast("double"), 6).alias("b"))

    told = rows(log, "log", F.concat_ws(":", F.col("entry_id").cast("string"), F.col("seq").cast("string")), F.col("similarity"), F.col("was_correct").cast("int"))
    told = told.unionByName(rows(thresholds, "threshold", F.col("entry_id").cast("string"), F.col("n_scores"), F.col("threshold")))
    each = arms.select("shard_id", F.posexplode(F.arrays_zip("alpha", "beta")).alias("arm", "ab"))
    told = told.unionByName(rows(each, "posterior", F.concat_ws(":", "shard_id", F.col("arm").cast("string")), F.col("ab.alpha"), F.col("ab.beta")))
    return told.unionByName(rows(arms, "resets", F.col("shard_id"), F.col("resets"), F.size("window")))


@query(
    "implicit_step",
    f"""WITH RECURSIVE {I.SQL_LOG},
        told AS (SELECT 'shard-' || CAST(tenant_id % {FEEDBACK_SHARDS} AS VARCHAR) AS shard_id, seq, {I.SQL_REWARD} AS reward FROM query_log WHERE hit),
        {SQL_LAST_ARMS},
        ends AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY shard_id ORDER BY i DESC) = 1)
        SELECT shard_id, arm, round(a[arm + 1], 6) AS alpha, round(b[arm + 1], 6) AS beta, resets
        FROM (SELECT shard_id, a, b, resets, unnest(range(10)) AS arm FROM ends)""",
)
def implicit_step(spark, sf):
    """Similarities of all logged hits folded into the arms of their shard, in two steps."""
    log = I.query_log(spark, sf).withColumn("shard_id", F.concat(F.lit("shard-"), (F.col("tenant_id") % FEEDBACK_SHARDS).cast("string")))
    half = log.agg(F.percentile_approx("seq", 0.5)).first()[0]
    arms = None
    for part in (F.col("seq") <= half, F.col("seq") > half):
        arms = stored(ST.replaced(arms, stored(ST.implicit_step(arms, log.filter(part)), "moved"), "shard_id"), "arms")
    each = arms.select("shard_id", "resets", F.posexplode(F.arrays_zip("alpha", "beta")).alias("arm", "ab"))
    return each.select(
        "shard_id", F.col("arm").cast("bigint").alias("arm"), F.round("ab.alpha", 6).alias("alpha"), F.round("ab.beta", 6).alias("beta"), "resets"
    )


@query("compare_strategies")
def compare_strategies(spark, sf):
    """Seven configurations; thresholds lie where the vectors of these tables are similar."""
    q = I.queries(spark, sf)
    work = q.join(I.table(spark, sf, "documents").select(F.col("doc_id").alias("query_id"), "n_chars"), "query_id").select(
        "query_id", "seq", "tenant_id", "query_text", "embedding",
        F.coalesce(F.concat(F.lit("label-"), F.col("label").cast("string")), F.concat(F.lit("text-"), F.md5("query_text"))).alias("answer"), (F.col("n_chars") / 10.0).alias("latency_ms"),
    )
    cfg = CacheConfig(default_threshold=0.35, min_threshold=0.30, max_threshold=0.45, tenant_scoped=False)
    plans = SG.standard_strategies(DIM, 16, low=0.33, high=0.38, default=0.35, cfg=cfg)
    return SG.compare_strategies(
        work, DIM, capacity=200, target=16, strategies=plans, default=0.30, initial=0.50, floor=0.30, limits=(0.28, 0.45), cfg=cfg
    )
