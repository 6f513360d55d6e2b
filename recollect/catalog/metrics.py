"""Aggregation queries over the query log, calls and results."""

from __future__ import annotations

from pyspark.sql import functions as F

from recollect.catalog import inputs as I
from recollect.catalog import query
from recollect.catalog.lookup import SQL_COMPARED, comparison_inputs
from recollect.catalog.vectors import BITS, DIM, SEED, TABLES, sql_signature
from recollect.functions import vectors as V
from recollect.operators import lookup as L
from recollect.functions import text as T
from recollect.operators import metrics as M
from recollect.plans.materialize import stored
from recollect.operators import sessions as SE


def _sql_metrics(by: str) -> str:
    sel = f"{by}, " if by else ""
    grp = f"GROUP BY {by}" if by else ""
    part = f"PARTITION BY {by}" if by else ""
    return f"""WITH {I.SQL_FEEDBACK},
      recent AS (SELECT *, row_number() OVER ({part} ORDER BY seq DESC) AS ra FROM query_log),
      recent_hit AS (SELECT *, row_number() OVER ({part} ORDER BY seq DESC) AS ra FROM query_log WHERE hit),
      recent_miss AS (SELECT *, row_number() OVER ({part} ORDER BY seq DESC) AS ra FROM query_log WHERE NOT hit),
      c AS (SELECT {sel} 1 AS one, count(*) AS total_queries, count(*) FILTER (hit) AS total_hits,
              count(*) FILTER (hit AND tier = 1) AS tier1_hits, count(*) FILTER (hit AND tier = 2) AS tier2_hits,
              count(*) FILTER (NOT hit) AS total_misses, count(*) FILTER (eviction_triggered) AS total_evictions,
              count(*) FILTER (NOT hit AND NOT admission_rejected) AS total_admissions,
              count(*) FILTER (admission_rejected) AS admission_rejections,
              count(*) FILTER (event_type <> 'error') AS correct_hits, count(*) FILTER (event_type = 'error') AS incorrect_hits
            FROM query_log {grp}),
      a AS (SELECT {sel} 1 AS one, avg(latency_ms) AS v FROM recent WHERE ra <= 1000 {grp}),
      h AS (SELECT {sel} 1 AS one, avg(latency_ms) AS v FROM recent_hit WHERE ra <= 1000 {grp}),
      m AS (SELECT {sel} 1 AS one, avg(latency_ms) AS v FROM recent_miss WHERE ra <= 1000 {grp})
    SELECT c.* EXCLUDE (one), round(total_hits / greatest(total_queries, 1)::DOUBLE, 4) AS hit_rate,
      round(tier1_hits / greatest(total_hits, 1)::DOUBLE, 4) AS tier1_rate,
      round(tier2_hits / greatest(total_hits, 1)::DOUBLE, 4) AS tier2_rate,
      round(incorrect_hits / greatest(total_queries, 1)::DOUBLE, 4) AS false_hit_rate,
      round(correct_hits / greatest(correct_hits + incorrect_hits, 1)::DOUBLE, 4) AS precision,
      round(coalesce(a.v, 0.0::DOUBLE), 9) AS avg_latency_ms, round(coalesce(h.v, 0.0::DOUBLE), 9) AS avg_hit_latency_ms,
      round(coalesce(m.v, 0.0::DOUBLE), 9) AS avg_miss_latency_ms
    FROM c LEFT JOIN a USING ({sel} one) LEFT JOIN h USING ({sel} one) LEFT JOIN m USING ({sel} one)"""


def _judged(spark, sf):
    return I.query_log(spark, sf).select("tenant_id", (F.col("event_type") != "error").alias("was_correct"))


@query("aggregate_metrics", _sql_metrics(""))
def aggregate_metrics(spark, sf):
    return M.aggregate_metrics(I.query_log(spark, sf), _judged(spark, sf))


@query("aggregate_metrics_by_tenant", _sql_metrics("tenant_id"))
def aggregate_metrics_by_tenant(spark, sf):
    return M.aggregate_metrics(I.query_log(spark, sf), _judged(spark, sf), ["tenant_id"])


@query(
    "metrics_rollup",
    f"""WITH {I.SQL_LOG}, days AS (SELECT *, CAST(ts AS DATE) AS day FROM query_log)
        SELECT day, tenant_id, count(*) AS queries, count(*) FILTER (hit) AS hits,
          round(count(*) FILTER (hit) / greatest(count(*), 1)::DOUBLE, 4) AS hit_rate, round(avg(latency_ms), 9) AS avg_latency_ms
        FROM days GROUP BY ROLLUP (day, tenant_id)""",
)
def metrics_rollup(spark, sf):
    return M.metrics_rollup(I.query_log(spark, sf).withColumn("day", F.to_date("ts")), ["day", "tenant_id"])


@query(
    "latency_percentiles",
    f"""WITH {I.SQL_LOG} SELECT round(quantile_cont(latency_ms, 0.5), 4) AS p50, round(quantile_cont(latency_ms, 0.9), 4) AS p90,
        round(quantile_cont(latency_ms, 0.95), 4) AS p95, round(quantile_cont(latency_ms, 0.99), 4) AS p99 FROM query_log""",
)
def latency_percentiles(spark, sf):
    p = M.latency_percentiles(I.query_log(spark, sf), block_rows=1_500)
    return p.select(*[F.round(c, 4).alias(c) for c in p.columns])


@query(
    "latency_percentiles_by_tenant",
    f"""WITH {I.SQL_LOG} SELECT tenant_id, round(quantile_cont(latency_ms, 0.5), 4) AS p50, round(quantile_cont(latency_ms, 0.9), 4) AS p90,
        round(quantile_cont(latency_ms, 0.95), 4) AS p95, round(quantile_cont(latency_ms, 0.99), 4) AS p99 FROM query_log GROUP BY tenant_id""",
)
def latency_percentiles_by_tenant(spark, sf):
    p = M.latency_percentiles(I.query_log(spark, sf), ["tenant_id"], 1_500)
    return p.select("tenant_id", *[F.round(c, 4).alias(c) for c in ("p50", "p90", "p95", "p99")])


POINTS = {"p50": 0.50, "p90": 0.90, "p95": 0.95, "p99": 0.99}


@query(
    "latency_percentiles_sketch",
    f"""WITH {I.SQL_LOG}, t AS (SELECT event_type, count(latency_ms) AS n FROM query_log GROUP BY event_type)
        SELECT event_type, point, n, true AS within FROM t, (SELECT unnest(['p50', 'p90', 'p95', 'p99']) AS point)""",
)
def latency_percentiles_sketch(spark, sf):
    """Percentiles from sketches stored by hour and event type, and whether each lies within the stated error of its exact rank."""
    log = I.query_log(spark, sf)
    hours = stored(M.log_sketches(log.withColumn("hour", F.date_trunc("hour", "ts")), ["hour", "event_type"]), "sketches")
    found = M.merged_quantiles(hours, ["event_type"], POINTS)
    found = found.select("event_type", "n", F.explode(F.map_from_arrays(F.array(*map(F.lit, POINTS)), F.array(*POINTS))).alias("point", "value"))
    ranks = log.join(found, "event_type").groupBy("event_type", "point", "n", "value").agg(
        (F.count_if(F.col("latency_ms") < F.col("value")) / F.col("n")).alias("low"),
        (F.count_if(F.col("latency_ms") <= F.col("value")) / F.col("n")).alias("high"),
    )
    wanted = F.create_map(*[F.lit(x) for p in POINTS.items() for x in p])[F.col("point")]
    within = (F.col("low") - M.SKETCH_ERROR <= wanted) & (wanted <= F.col("high") + M.SKETCH_ERROR)
    return ranks.select("event_type", "point", "n", within.alias("within"))


@query(
    "encode_stats_sketch",
    f"""SELECT lang, count(*) AS requests, count(DISTINCT sha256({I.sql_normalize('text')})) AS encode_calls, true AS within
        FROM documents GROUP BY lang""",
)
def encode_stats_sketch(spark, sf):
    """Distinct texts per language from sketches stored by source and language, beside the exact number."""
    docs = I.table(spark, sf, "documents").withColumn("key", T.memo_key(F.col("text"))).select("lang", "source", "key", F.lit(1.0).alias("latency_ms"))
    docs = stored(docs, "keys")
    found = M.merged_distinct(stored(M.log_sketches(docs, ["lang", "source"], key="key"), "sketches"), ["lang"])
    exact = docs.groupBy("lang").agg(F.count_distinct("key").alias("encode_calls"))
    both = found.join(exact, found["lang"].eqNullSafe(exact["lang"])).drop(exact["lang"])
    near = F.abs(F.col("distinct_keys") - F.col("encode_calls")) <= F.greatest(M.DISTINCT_ERROR * F.col("encode_calls"), F.lit(1))
    return both.select("lang", F.col("rows").alias("requests"), "encode_calls", near.alias("within"))


@query(
    "similarity_histogram",
    f"""WITH {I.SQL_LOG}, b AS (SELECT least(CAST(floor(similarity * 20) AS BIGINT), 19) AS bin, count(*) AS n
          FROM query_log WHERE hit AND similarity > 0 GROUP BY 1)
        SELECT s.bin, s.bin / 20.0::DOUBLE AS lower, coalesce(n, 0) AS hits FROM (SELECT unnest(range(20)) AS bin) s LEFT JOIN b USING (bin)""",
)
def similarity_histogram(spark, sf):
    return M.similarity_histogram(I.query_log(spark, sf))


@query(
    "threshold_distribution",
    f"WITH {I.SQL_LOG} SELECT round(threshold_used, 4) AS threshold, count(*) AS uses FROM query_log WHERE threshold_used > 0 GROUP BY 1",
)
def threshold_distribution(spark, sf):
    return M.threshold_distribution(I.query_log(spark, sf))


@query(
    "llm_usage_rollup",
    """SELECT backend, model, count(*) AS calls, CAST(sum(k) AS BIGINT) AS input_tokens, CAST(sum(k * 2) AS BIGINT) AS output_tokens,
         round(sum(k * 2 / 1000.0::DOUBLE * 0.015::DOUBLE), 6) AS cost_usd, round(avg(value), 9) AS avg_latency_ms,
         CAST(sum(retry) AS BIGINT) AS retries
       FROM (SELECT event_type AS backend, 'model-' || CAST(user_id % 3 AS VARCHAR) AS model, value,
               CAST(json_extract(props, '$.k') AS INTEGER) AS k, CASE WHEN value > 100 THEN 1 ELSE 0 END AS retry FROM events)
       GROUP BY ROLLUP (backend, model)""",
)
def llm_usage_rollup(spark, sf):
    log = I.query_log(spark, sf)
    calls = log.select(
        F.col("event_type").alias("backend"),
        F.concat(F.lit("model-"), (F.col("tenant_id") % 3).cast("string")).alias("model"),
        F.col("k").alias("input_tokens"),
        (F.col("k") * 2).alias("output_tokens"),
        (F.col("k") * 2 / 1000.0 * 0.015).alias("cost_usd"),
        "latency_ms",
        F.when(F.col("latency_ms") > 100, 1).otherwise(0).alias("retries"),
    )
    return M.llm_usage_rollup(calls)


@query(
    "encode_stats",
    f"""WITH k AS (SELECT sha256({I.sql_normalize('text')}) AS k, count(*) AS n, min_by(n_chars / 1000.0::DOUBLE, doc_id) AS ms
          FROM documents GROUP BY 1)
        SELECT count(*) AS encode_calls, CAST(sum(n - 1) AS BIGINT) AS memo_hits, round(avg(ms), 9) AS avg_encode_ms FROM k""",
)
def encode_stats(spark, sf):
    docs = I.table(spark, sf, "documents")
    return M.encode_stats(
        docs.select(F.col("text").alias("query_text"), F.col("doc_id").alias("seq"), (F.col("n_chars") / 1000.0).alias("encode_ms"))
    )


@query(
    "store_stats",
    f"""WITH {I.SQL_ENTRIES} SELECT tenant_id, count(*) AS entries, count(DISTINCT {I.sql_normalize('query_text')}) AS exact_keys,
          count(embedding) AS vectors, round(count(*) / 10000::DOUBLE, 6) AS used_share FROM entries GROUP BY tenant_id""",
)
def store_stats(spark, sf):
    return M.store_stats(I.entries(spark, sf), 10_000)


def results(spark, sf):
    """The log as strategy results: strategy and run from k, correct = fast answer."""
    return I.query_log(spark, sf).select(
        F.concat(F.lit("s"), (F.col("k") % 7).cast("string")).alias("strategy"),
        F.concat(F.lit("d"), (F.col("tenant_id") % 2).cast("string")).alias("dataset"),
        ((F.col("tenant_id") % 3 + 1) * 100).alias("cache_capacity"),
        "hit", "tier", (F.col("latency_ms") < 50).alias("correct"), "latency_ms",
    )


SQL_RESULTS = I.SQL_LOG + """,
results AS (SELECT 's' || CAST(k % 7 AS VARCHAR) AS strategy, 'd' || CAST(tenant_id % 2 AS VARCHAR) AS dataset,
              (tenant_id % 3 + 1) * 100 AS cache_capacity, hit, tier, latency_ms < 50 AS correct, latency_ms FROM query_log)"""


def _sql_scorecard(by: str) -> str:
    return f"""WITH {SQL_RESULTS},
      c AS (SELECT {by}, count(*) AS total_queries, count(*) FILTER (hit) AS total_hits, count(*) FILTER (NOT hit) AS total_misses,
              count(*) FILTER (hit AND tier = 1) AS tier1_hits, count(*) FILTER (hit AND tier = 2) AS tier2_hits,
              count(*) FILTER (hit AND correct) AS correct_hits, count(*) FILTER (hit AND NOT correct) AS incorrect_hits,
              avg(latency_ms) FILTER (hit) AS h, avg(latency_ms) FILTER (NOT hit) AS m, avg(latency_ms) AS o
            FROM results GROUP BY {by}),
      r AS (SELECT *, correct_hits / greatest(total_hits, 1)::DOUBLE AS p, correct_hits / greatest(total_queries, 1)::DOUBLE AS r FROM c)
    SELECT * EXCLUDE (h, m, o, p, r), total_misses AS llm_calls, round(total_hits / greatest(total_queries, 1)::DOUBLE, 4) AS hit_rate,
      round(p, 4) AS precision, round(r, 4) AS recall, round(2.0::DOUBLE * p * r / greatest(p + r, 1e-9::DOUBLE), 4) AS f1_score,
      round(coalesce(h, 0.0::DOUBLE), 2) AS avg_hit_latency_ms, round(coalesce(m, 0.0::DOUBLE), 2) AS avg_miss_latency_ms,
      round(coalesce(o, 0.0::DOUBLE), 2) AS avg_overall_latency_ms FROM r"""


@query("strategy_scorecard", _sql_scorecard("strategy"))
def strategy_scorecard(spark, sf):
    return M.strategy_scorecard(results(spark, sf))


@query(
    "run_comparison",
    f"""WITH {SQL_RESULTS}, runs AS (SELECT strategy, dataset, cache_capacity, round(count(*) FILTER (hit) / count(*)::DOUBLE, 4) AS hit_rate
          FROM results GROUP BY ALL)
        SELECT strategy, round(avg(hit_rate) FILTER (dataset = 'd0'), 4) AS d0, round(avg(hit_rate) FILTER (dataset = 'd1'), 4) AS d1
        FROM runs GROUP BY strategy""",
)
def run_comparison(spark, sf):
    runs = M.strategy_scorecard(results(spark, sf), ["strategy", "dataset", "cache_capacity"])
    return M.run_comparison(runs, "hit_rate", ["d0", "d1"])


@query(
    "run_cube",
    f"""WITH {SQL_RESULTS} SELECT dataset, cache_capacity, strategy, count(*) AS queries,
          round(count(*) FILTER (hit) / greatest(count(*), 1)::DOUBLE, 4) AS hit_rate
        FROM results GROUP BY CUBE (dataset, cache_capacity, strategy)""",
)
def run_cube(spark, sf):
    return M.run_cube(results(spark, sf))


@query(
    "savings_summary",
    f"""WITH {SQL_COMPARED} SELECT count(*) AS queries, round(sum(saved_ms), 4) AS saved_ms, CAST(sum(saved_tokens) AS BIGINT) AS saved_tokens,
          round(sum(CASE WHEN direct_ms > 0 THEN speedup ELSE 0.0::DOUBLE END) / greatest(count(*), 1), 4) AS avg_speedup,
          count(*) FILTER (hit) AS calls_saved,
          round(count(*) FILTER (hit) * (500.0::DOUBLE * 0.005::DOUBLE + 200.0::DOUBLE * 0.015::DOUBLE) / 1000.0::DOUBLE, 6) AS money_avoided
        FROM compared""",
)
def savings_summary(spark, sf):
    return M.savings_summary(L.paired_comparison(*comparison_inputs(spark, sf)), 500.0, 200.0, 0.005, 0.015)


SQL_ACTIVITY = I.SQL_LOG + """,
activity AS (SELECT tenant_id AS session_id, count(*) AS turn_count, min(ts) AS first_active, max(ts) AS last_active,
   epoch_us(TIMESTAMP '2024-01-30 12:00:00') - epoch_us(max(ts)) > 1800 * 1000000 AS is_expired FROM query_log GROUP BY 1)"""


def _activity(spark, sf):
    log = I.query_log(spark, sf).select(F.col("tenant_id").alias("session_id"), "ts")
    return SE.session_activity(log, F.lit("2024-01-30 12:00:00").cast("timestamp_ntz"))


@query("session_activity", f"WITH {SQL_ACTIVITY} SELECT * FROM activity")
def session_activity(spark, sf):
    return _activity(spark, sf)


@query("session_stats", f"WITH {SQL_ACTIVITY} SELECT * FROM activity ORDER BY first_active, session_id LIMIT 20")
def session_stats(spark, sf):
    return SE.session_stats(_activity(spark, sf))


SQL_BUCKETS = f"""{sql_signature('embeddings', 'vec_id', 'embedding')},
buckets AS (SELECT vec_id, CAST(sig[1] AS VARCHAR) AS bucket FROM signatures)"""


def bucketed(spark, sf, tables_used=1):
    sig = V.lsh_signature(F.col("embedding"), DIM, TABLES, BITS, SEED)
    return I.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("query_id"), F.col("vec_id").alias("seq"), V.signature_key(sig, tables_used).alias("bucket")
    )


@query("bucket_frequency", f"WITH {SQL_BUCKETS} SELECT bucket, count(*) AS frequency FROM buckets GROUP BY bucket")
def bucket_frequency(spark, sf):
    return M.bucket_frequency(bucketed(spark, sf), "bucket")


def _sql_word(at: int) -> str:
    return "CAST('0x' || " + " || ".join(f"substr(d, {at + 2 * b}, 2)" for b in (3, 2, 1, 0)) + " AS BIGINT)"


SQL_SKETCH = f"""{I.SQL_LOG},
keyed AS (SELECT seq, CAST(tenant_id AS VARCHAR) || '/' || CAST(k AS VARCHAR) AS key FROM query_log),
slots AS (SELECT key, seq, r AS row, ({_sql_word(1)} + r * {_sql_word(9)}) % {M.SKETCH_WIDTH} AS slot
          FROM (SELECT *, md5(key) AS d, unnest(range({M.SKETCH_DEPTH})) AS r FROM keyed)),
counters AS (SELECT row, slot, CAST(count(*) AS DOUBLE) AS weight FROM slots GROUP BY row, slot),
aged AS (SELECT row, slot, sum(pow(0.5::DOUBLE, (SELECT max(seq) // 4000 FROM keyed) - seq // 4000)) AS weight FROM slots GROUP BY row, slot)"""


def _sketch_keys(spark, sf):
    log = I.query_log(spark, sf)
    return log.select("seq", F.concat_ws("/", F.col("tenant_id").cast("string"), F.col("k").cast("string")).alias("key"))


@query(
    "sketch_frequency",
    f"WITH {SQL_SKETCH} SELECT key, min(weight) AS estimate FROM (SELECT DISTINCT key, row, slot FROM slots) JOIN counters USING (row, slot) GROUP BY key",
)
def sketch_frequency(spark, sf):
    keys = _sketch_keys(spark, sf)
    return M.sketch_frequency(keys, "key", M.sketch_counters(keys, "key"))


@query(
    "sketch_frequency_aged",
    f"WITH {SQL_SKETCH} SELECT key, round(min(weight), 6) AS estimate FROM (SELECT DISTINCT key, row, slot FROM slots) JOIN aged USING (row, slot) GROUP BY key",
)
def sketch_frequency_aged(spark, sf):
    keys = _sketch_keys(spark, sf)
    est = M.sketch_frequency(keys, "key", M.sketch_counters(keys, "key", 4000))
    return est.withColumn("estimate", F.round("estimate", 6))
