"""Reading, storing and cleaning queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from recollect.catalog import inputs as I
from recollect.catalog import query
from recollect.catalog.calibration import CFG, SQL_POSTERIOR, SQL_WINDOW, posterior
from recollect.operators import maintenance as MA
from recollect.operators import sessions as SE
from recollect.sources import snapshots

NOW = "2024-01-01 06:00:00"


def now():
    return F.lit(NOW).cast("timestamp_ntz")


def _stored(spark, sf, df, name):
    """Write one version and read it back."""
    root = I.scratch(spark, name)
    snapshots.write_version(df, root, 1)
    return snapshots.read_version(spark, root)


@query(
    "load_live_entries",
    f"WITH {I.SQL_ENTRIES} SELECT entry_id, tenant_id, expires_at FROM entries WHERE expires_at IS NULL OR expires_at > TIMESTAMP '{NOW}'",
)
def load_live_entries(spark, sf):
    stored = _stored(spark, sf, I.entries(spark, sf), "entries")
    return MA.load_live_entries(stored, now()).select("entry_id", "tenant_id", "expires_at")


@query(
    "upsert_entries",
    f"""WITH {I.SQL_LOG}, stored AS (SELECT doc_id AS entry_id, n_chars AS storage_bytes, -1 AS version FROM documents JOIN labels USING (doc_id)),
          fresh AS (SELECT CAST(k AS BIGINT) AS entry_id, max_by(CAST(round(latency_ms) AS BIGINT), seq) AS storage_bytes, max(seq) AS version FROM query_log GROUP BY k)
        SELECT * FROM stored WHERE entry_id NOT IN (SELECT entry_id FROM fresh) UNION ALL SELECT * FROM fresh""",
)
def upsert_entries(spark, sf):
    docs = I.table(spark, sf, "documents").join(I.table(spark, sf, "labels"), "doc_id")
    stored = docs.select(F.col("doc_id").alias("entry_id"), F.col("n_chars").alias("storage_bytes"), F.lit(-1).cast("bigint").alias("version"))
    new = I.query_log(spark, sf).select(
        F.col("k").cast("bigint").alias("entry_id"), F.round("latency_ms").cast("bigint").alias("storage_bytes"), F.col("seq").alias("version")
    )
    return MA.upsert(stored, new, ["entry_id"], ["version"])


def _scores(spark, sf):
    return I.feedback(spark, sf).select("entry_id", "seq")


def _toxic(spark, sf):
    return I.table(spark, sf, "labels").filter("toxic = 1").select(F.col("doc_id").alias("entry_id"))


@query(
    "delete_entries",
    f"""WITH {I.SQL_FEEDBACK}, gone AS (SELECT doc_id FROM labels WHERE toxic = 1)
        SELECT 'entries' AS part, count(*) AS rows_left, CAST(sum(doc_id) AS BIGINT) AS id_sum FROM labels WHERE doc_id NOT IN (FROM gone)
        UNION ALL SELECT 'scores', count(*), CAST(sum(entry_id) AS BIGINT) FROM feedback WHERE entry_id NOT IN (FROM gone)""",
)
def delete_entries(spark, sf):
    e, s = MA.delete_entries(I.entries(spark, sf).select("entry_id"), _scores(spark, sf), _toxic(spark, sf))
    return _sums(e, "entries").unionByName(_sums(s, "scores"))


def _sums(df, part):
    return df.agg(F.count(F.lit(1)).alias("rows_left"), F.sum("entry_id").alias("id_sum")).select(
        F.lit(part).alias("part"), "rows_left", "id_sum"
    )


@query(
    "calibration_store",
    f"WITH {SQL_WINDOW} SELECT entry_id, CAST(row_number() OVER (PARTITION BY entry_id ORDER BY seq) - 1 AS INTEGER) AS pos, round(score, 6) AS score FROM win",
)
def calibration_store(spark, sf):
    stored = _stored(spark, sf, MA.calibration_store(I.feedback(spark, sf), CFG), "scores")
    return MA.calibration_rows(stored).withColumn("score", F.round("score", 6))


@query(
    "bandit_store",
    f"WITH {SQL_POSTERIOR} SELECT shard_id, arm, round(alpha, 6) AS alpha, round(beta, 6) AS beta FROM posterior",
)
def bandit_store(spark, sf):
    stored = _stored(spark, sf, MA.bandit_store(posterior(spark, sf)), "bandit")
    return MA.bandit_rows(stored).select("shard_id", "arm", F.round("alpha", 6).alias("alpha"), F.round("beta", 6).alias("beta"))


SQL_METADATA = f"""{I.SQL_MESSAGES},
metadata AS (SELECT session_id, substr(t, 1, 50) || CASE WHEN length(t) > 50 THEN '…' ELSE '' END AS title, created_at, updated_at
  FROM (SELECT session_id, min_by(text, id) AS t, min(created_at) AS created_at, max(created_at) AS updated_at FROM messages GROUP BY 1))"""


@query("append_messages", f"WITH {SQL_METADATA} SELECT * FROM metadata")
def append_messages(spark, sf):
    """The first three turns are stored, the later ones arrive; both parts make up the whole table."""
    m = I.messages(spark, sf)
    old, new = m.filter("turn < 3"), m.filter("turn >= 3")
    _, meta = SE.append_messages(old, SE.session_metadata(old), new)
    return meta


@query(
    "recent_sessions",
    f"WITH {SQL_METADATA} SELECT d.*, (SELECT count(*) FROM messages m WHERE m.session_id = d.session_id) AS message_count FROM metadata d",
)
def recent_sessions(spark, sf):
    m = I.messages(spark, sf)
    return SE.recent_sessions(m, SE.session_metadata(m))


@query(
    "session_messages",
    f"WITH {I.SQL_MESSAGES} SELECT id, session_id, role, text, created_at FROM messages WHERE session_id = '7'",
)
def session_messages(spark, sf):
    return SE.session_messages(I.messages(spark, sf), "7").select("id", "session_id", "role", "text", "created_at")


@query(
    "delete_sessions",
    f"""WITH {SQL_METADATA}, gone AS (SELECT DISTINCT session_id FROM messages WHERE role = 'system')
        SELECT 'messages' AS part, count(*) AS rows_left FROM messages WHERE session_id NOT IN (FROM gone)
        UNION ALL SELECT 'metadata', count(*) FROM metadata WHERE session_id NOT IN (FROM gone)""",
)
def delete_sessions(spark, sf):
    m = I.messages(spark, sf)
    kept, meta = SE.delete_sessions(m, SE.session_metadata(m), m.filter("role = 'system'").select("session_id").distinct())
    parts = [("messages", kept), ("metadata", meta)]
    a, b = (d.agg(F.count(F.lit(1)).alias("rows_left")).select(F.lit(n).alias("part"), "rows_left") for n, d in parts)
    return a.unionByName(b)


@query(
    "rename_sessions",
    f"""WITH {SQL_METADATA} SELECT session_id, coalesce(substr(b.text, 1, 40), title) AS title, updated_at
        FROM metadata LEFT JOIN benchmark b ON session_id = CAST(item_id AS VARCHAR)""",
)
def rename_sessions(spark, sf):
    titles = I.table(spark, sf, "benchmark").select(
        F.col("item_id").cast("string").alias("session_id"), F.substring("text", 1, 40).alias("title")
    )
    renamed = SE.rename_sessions(SE.session_metadata(I.messages(spark, sf)), titles)
    return renamed.select("session_id", "title", "updated_at")


@query("snapshot_compact", "SELECT doc_id AS entry_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def snapshot_compact(spark, sf):
    compact = MA.snapshot_compact(I.entries(spark, sf).select("entry_id", "tenant_id"), _toxic(spark, sf))
    return _stored(spark, sf, compact, "compact").select("entry_id")


@query("snapshot_compact_few", "SELECT doc_id AS entry_id FROM labels WHERE doc_id <> (SELECT min(doc_id) FROM labels)")
def snapshot_compact_few(spark, sf):
    """A single tombstone: too few to rewrite files, yet never seen."""
    e = I.entries(spark, sf).select("entry_id", "tenant_id")
    return MA.snapshot_compact(e, e.agg(F.min("entry_id").alias("entry_id"))).select("entry_id")


@query(
    "purge_expired",
    f"""WITH {I.SQL_ENTRIES}, {I.SQL_FEEDBACK}, gone AS (SELECT entry_id FROM entries WHERE TIMESTAMP '{NOW}' > expires_at)
        SELECT 'entries' AS part, count(*) AS rows_left, CAST(sum(entry_id) AS BIGINT) AS id_sum, (SELECT count(*) FROM gone) AS removed
          FROM entries WHERE entry_id NOT IN (FROM gone)
        UNION ALL SELECT 'scores', count(*), CAST(sum(entry_id) AS BIGINT), (SELECT count(*) FROM gone) FROM feedback WHERE entry_id NOT IN (FROM gone)""",
)
def purge_expired(spark, sf):
    kept, (scores,), counted = MA.purge_expired(I.entries(spark, sf), now(), _scores(spark, sf))
    both = _sums(kept, "entries").unionByName(_sums(scores, "scores"))
    return both.withColumn("removed", counted.scalar())


@query(
    "clear_entries",
    f"""WITH {I.SQL_ENTRIES} SELECT count(*) FILTER (tenant_id <> 'en') AS rows_left, count(*) FILTER (tenant_id = 'en') AS cleared FROM entries""",
)
def clear_entries(spark, sf):
    kept, counted = MA.clear_entries(I.entries(spark, sf), "en")
    return kept.agg(F.count(F.lit(1)).alias("rows_left")).withColumn("cleared", counted.scalar())
