"""Priority, eviction, admission and segment queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from recollect.catalog import inputs as I
from recollect.catalog import query
from recollect.config import CacheConfig
from recollect.operators import retention as R

def sql_priority(level: str = "0.0") -> str:
    return f"""{I.SQL_ENTRIES},
ranked AS (SELECT *, frequency * (llm_cost_usd * 1e6::DOUBLE + embed_cost_ms) / greatest(storage_bytes, 1) + {level}::DOUBLE AS priority,
             created_at + to_seconds(CAST(frequency * 100 AS BIGINT)) AS last_access FROM entries)"""


def entries(spark, sf, level=0.0, extra=0.0):
    used = I.entries(spark, sf).withColumn(
        "last_access", F.col("created_at") + F.make_dt_interval(secs=F.col("frequency") * 100)
    )
    return R.with_priority(used, level, extra)


@query(
    "gdsf_priority",
    f"""WITH {sql_priority('2.5')},
        flat AS (SELECT entry_id, frequency * (llm_cost_usd * 1e6::DOUBLE + embed_cost_ms + 50.0::DOUBLE) / greatest(storage_bytes, 1)
                   + 2.5::DOUBLE AS p FROM entries)
        SELECT entry_id, round(priority, 6) AS priority, round(p, 6) AS priority_flat_cost FROM ranked JOIN flat USING (entry_id)""",
)
def gdsf_priority(spark, sf):
    e = entries(spark, sf, 2.5)
    both = R.with_priority(e.withColumnRenamed("priority", "own"), 2.5, extra_ms=50.0)
    return both.select("entry_id", F.round("own", 6).alias("priority"), F.round("priority", 6).alias("priority_flat_cost"))


def _quota(e):
    """A third of each tenant's entries has to go."""
    return e.groupBy("tenant_id").agg(F.ceil(F.count(F.lit(1)) / 3).alias("n"))


def _sql_evict(order: str) -> str:
    return f"""{sql_priority('0.0')},
victims AS (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY {order}, entry_id) AS rn,
              ceil(count(*) OVER (PARTITION BY tenant_id) / 3.0) AS n FROM ranked)"""


@query(
    "evict_lowest",
    f"WITH {_sql_evict('priority')} SELECT tenant_id, entry_id, round(priority, 6) AS priority FROM victims WHERE rn <= n",
)
def evict_lowest(spark, sf):
    e = entries(spark, sf)
    evicted, _, _ = R.evict_lowest(e, _quota(e))
    return evicted.select("tenant_id", "entry_id", F.round("priority", 6).alias("priority"))


@query(
    "evict_lowest_inflation",
    f"WITH {_sql_evict('priority')} SELECT tenant_id, round(max(priority), 6) AS inflation FROM victims WHERE rn <= n GROUP BY tenant_id",
)
def evict_lowest_inflation(spark, sf):
    e = entries(spark, sf)
    _, _, level = R.evict_lowest(e, _quota(e))
    return level.withColumn("inflation", F.round("inflation", 6))


@query("evict_lru", f"WITH {_sql_evict('last_access')} SELECT tenant_id, entry_id, last_access FROM victims WHERE rn <= n")
def evict_lru(spark, sf):
    e = entries(spark, sf)
    evicted, _ = R.evict_lru(e, _quota(e))
    return evicted.select("tenant_id", "entry_id", "last_access")


@query(
    "eviction_stats",
    f"""WITH {sql_priority('1.5')} SELECT count(*) AS tracked_entries, round(min(priority), 4) AS min_priority,
          round(max(priority), 4) AS max_priority, round(avg(priority), 4) AS avg_priority, 1.5::DOUBLE AS inflation_factor FROM ranked""",
)
def eviction_stats(spark, sf):
    return R.eviction_stats(entries(spark, sf, 1.5), 1.5)


@query(
    "priority_histogram",
    f"WITH {sql_priority('0.0')} SELECT CAST(floor(priority / 0.5::DOUBLE) AS BIGINT) AS bin, count(*) AS entries FROM ranked GROUP BY 1",
)
def priority_histogram(spark, sf):
    return R.priority_histogram(entries(spark, sf), 0.5)


WINDOW, SHARDS = 20, 4


def gate_inputs(spark, sf):
    """Documents ask for admission; the window holds the labelled ones, which were seen before.

    The bucket is the answer's language and source.
    """
    docs = I.table(spark, sf, "documents")
    bucket = F.concat_ws("/", "lang", "source")
    candidates = docs.select(
        F.col("lang").alias("tenant_id"), F.col("doc_id").alias("entry_id"), F.col("doc_id").alias("seq"),
        bucket.alias("bucket"),
    )
    labels = I.table(spark, sf, "labels").join(docs, "doc_id")
    window = labels.select(
        F.col("lang").alias("tenant_id"), (-F.col("doc_id") - 1).alias("entry_id"), F.col("doc_id").alias("seq"),
        bucket.alias("bucket"),
    )
    return candidates, window, window.groupBy("bucket").agg(F.count(F.lit(1)).alias("frequency"))


def sql_gate(shards: int) -> str:
    """The chain row by row: each step takes the next row of every shard and carries its window."""
    return f"""
line AS (
  SELECT lang AS tenant_id, -doc_id - 1 AS entry_id, doc_id AS seq, lang || '/' || source AS bucket, false AS is_new
  FROM documents JOIN labels USING (doc_id)
  UNION ALL SELECT lang, doc_id, doc_id, lang || '/' || source, true FROM documents),
dealt AS (SELECT *, CAST('0x' || substr(md5(bucket), 1, 4) AS INTEGER) % {shards} AS shard FROM line),
base AS (SELECT bucket, count(*) AS n FROM dealt WHERE NOT is_new GROUP BY bucket),
asked AS (SELECT bucket, list(seq ORDER BY seq) AS seqs FROM dealt WHERE is_new GROUP BY bucket),
hist AS (SELECT bucket, coalesce(n, 0) AS n, coalesce(seqs, []) AS seqs FROM base FULL JOIN asked USING (bucket)),
placed AS (SELECT *, row_number() OVER (PARTITION BY tenant_id, shard ORDER BY is_new, seq) AS spot FROM dealt),
chain AS (
  SELECT DISTINCT tenant_id, shard, CAST(0 AS BIGINT) AS spot, CAST([] AS STRUCT(id BIGINT, bucket VARCHAR)[]) AS held, CAST(NULL AS BIGINT) AS entry_id,
    CAST(NULL AS BIGINT) AS seq, false AS is_new, CAST(NULL AS BIGINT) AS new_frequency, CAST(NULL AS BIGINT) AS victim_id,
    CAST(NULL AS BIGINT) AS victim_frequency, true AS admitted FROM placed
  UNION ALL
  SELECT tenant_id, shard, spot, CASE WHEN NOT admitted THEN held
      ELSE list_append(CASE WHEN len(held) >= {max(1, WINDOW // shards)} THEN held[2:] ELSE held END, own) END,
    own.id, seq, is_new, new_frequency, CASE WHEN is_new THEN victim_id END, CASE WHEN is_new THEN victim_frequency END, admitted
  FROM (SELECT *, NOT is_new OR victim_id IS NULL OR new_frequency >= victim_frequency AS admitted FROM (
    SELECT p.tenant_id, p.shard, p.spot, c.held, {{'id': p.entry_id, 'bucket': p.bucket}} AS own, p.seq, p.is_new,
      h.n + len(list_filter(h.seqs, lambda x: x <= p.seq)) AS new_frequency,
      CASE WHEN len(c.held) >= {max(1, WINDOW // shards)} THEN c.held[1].id END AS victim_id,
      CASE WHEN len(c.held) >= {max(1, WINDOW // shards)} THEN v.n + len(list_filter(v.seqs, lambda x: x <= p.seq)) END AS victim_frequency
    FROM chain c JOIN placed p ON p.tenant_id = c.tenant_id AND p.shard = c.shard AND p.spot = c.spot + 1
    JOIN hist h ON h.bucket = p.bucket LEFT JOIN hist v ON v.bucket = c.held[1].bucket))),
gate AS (SELECT tenant_id, entry_id, seq, new_frequency, victim_id, victim_frequency, admitted FROM chain WHERE is_new)"""


@query("admission_gate", f"WITH RECURSIVE {sql_gate(SHARDS)} SELECT * FROM gate")
def admission_gate(spark, sf):
    return R.admission_gate(*gate_inputs(spark, sf), WINDOW, shards=SHARDS).drop("bucket", "holder_id")


@query("admission_gate_sequential", f"WITH RECURSIVE {sql_gate(1)} SELECT * FROM gate")
def admission_gate_sequential(spark, sf):
    """One shard: the plain rule."""
    return R.admission_gate(*gate_inputs(spark, sf), WINDOW).drop("bucket", "holder_id")


@query(
    "admission_stats",
    f"""WITH RECURSIVE {sql_gate(SHARDS)} SELECT tenant_id, count(*) AS total_checks, count(*) FILTER (admitted) AS total_admitted,
          count(*) FILTER (NOT admitted) AS total_rejected, round(count(*) FILTER (admitted) / greatest(count(*), 1)::DOUBLE, 4) AS admission_rate
        FROM gate GROUP BY tenant_id""",
)
def admission_stats(spark, sf):
    return R.admission_stats(R.admission_gate(*gate_inputs(spark, sf), WINDOW, shards=SHARDS))


SEG = CacheConfig(capacity=100, window_fraction=0.1)

SQL_SEGMENTS = f"""{sql_priority('0.0')},
p AS (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY seq DESC, entry_id) AS place FROM ranked),
e AS (SELECT *, place > 10 AND frequency > 1 AS eligible FROM p),
q AS (SELECT *, row_number() OVER (PARTITION BY tenant_id, eligible ORDER BY last_access DESC, entry_id) AS recent FROM e),
segments AS (SELECT tenant_id, entry_id, CASE WHEN place <= 10 THEN 'window' WHEN eligible AND recent <= 72 THEN 'protected'
             ELSE 'probation' END AS segment FROM q)"""


@query("segment_entries", f"WITH {SQL_SEGMENTS} SELECT * FROM segments")
def segment_entries(spark, sf):
    e = entries(spark, sf).withColumn("used_since", F.col("frequency") > 1)
    return R.segment_entries(e, SEG).select("tenant_id", "entry_id", "segment")


@query("segment_sizes", f"WITH {SQL_SEGMENTS} SELECT tenant_id, segment, count(*) AS entries FROM segments GROUP BY ALL")
def segment_sizes(spark, sf):
    e = entries(spark, sf).withColumn("used_since", F.col("frequency") > 1)
    return R.segment_sizes(R.segment_entries(e, SEG))
