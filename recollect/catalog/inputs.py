"""How the given tables play the roles the operators expect.

Real columns are used where they exist; what has to be derived is derived here, from whole
tables, so that the operators stay generic.  ``SQL_*`` are the same mappings as SQL text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.functions import text as T


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# Spark's own class syntax and SQL's are the same here, but for the doubled backslash.
SQL_SPACE = T.SPACE
SQL_NOT_WORD = T.NOT_WORD_OR_SPACE


def sql_normalize(col: str) -> str:
    inner = f"regexp_replace(lower({col}), '{SQL_NOT_WORD}', '', 'g')"
    return f"trim(regexp_replace({inner}, '{SQL_SPACE}', ' ', 'g'))"


def sql_light(col: str) -> str:
    return f"trim(regexp_replace(lower({col}), '{SQL_SPACE}', ' ', 'g'))"


def sql_key(text: str, tenant: str) -> str:
    return f"'{{' || {tenant} || '}}:exact:' || sha256({sql_normalize(text)})"


def sql_words(col: str) -> str:
    return f"list_filter(string_split({sql_light(col)}, ' '), lambda w: w <> '')"


def sql_hash(seed: int, col: str) -> str:
    return f"CAST('0x' || substr(md5('{seed}:' || CAST({col} AS VARCHAR)), 1, 8) AS BIGINT)"


def queries(spark: SparkSession, sf: str) -> DataFrame:
    """Every document asked as a question: arrival order = id, tenant = language."""
    docs = table(spark, sf, "documents")
    vecs = table(spark, sf, "embeddings")
    return docs.join(vecs, docs.doc_id == vecs.vec_id, "left").select(
        F.col("doc_id").alias("query_id"),
        F.col("doc_id").alias("seq"),
        F.col("lang").alias("tenant_id"),
        F.col("source").alias("session_id"),
        F.col("text").alias("query_text"),
        "embedding",
        "label",
    )


SQL_QUERIES = """
queries AS (
  SELECT d.doc_id AS query_id, d.doc_id AS seq, d.lang AS tenant_id, d.source AS session_id,
         d.text AS query_text, v.embedding, v.label
  FROM documents d LEFT JOIN embeddings v ON d.doc_id = v.vec_id
)"""

EPOCH = "2024-01-01 00:00:00"
TTL_S = 86_400
NOW = "2024-01-01 06:00:00"


def entries(spark: SparkSession, sf: str) -> DataFrame:
    """Cached answers: the labelled documents; one minute of age per id, kept for a day
    (good quality) or an hour (bad quality), never expiring when toxic = 1."""
    docs = table(spark, sf, "documents")
    labels = table(spark, sf, "labels")
    vecs = table(spark, sf, "embeddings")
    ttl = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 1, TTL_S).otherwise(3600)
    created = F.lit(EPOCH).cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("doc_id") * 60)
    return (
        docs.join(labels, "doc_id")
        .join(vecs, F.col("doc_id") == vecs.vec_id, "left")
        .select(
            F.col("doc_id").alias("entry_id"),
            F.col("doc_id").alias("seq"),
            F.col("lang").alias("tenant_id"),
            F.col("source").alias("session_id"),
            F.col("text").alias("query_text"),
            "embedding",
            "label",
            (F.col("n_chars") / 6000.0 * F.lit(0.015)).alias("llm_cost_usd"),
            F.lit(5.0).alias("embed_cost_ms"),
            F.octet_length("text").cast("bigint").alias("storage_bytes"),
            (F.lit(1) + F.col("quality") * 2 + F.col("toxic")).cast("bigint").alias("frequency"),
            created.alias("created_at"),
            F.when(ttl > 0, created + F.make_dt_interval(secs=ttl)).alias("expires_at"),
        )
    )


SQL_ENTRIES = f"""
entries AS (
  SELECT doc_id AS entry_id, doc_id AS seq, lang AS tenant_id, source AS session_id, text AS query_text,
         v.embedding, v.label,
         n_chars / 6000.0::DOUBLE * 0.015::DOUBLE AS llm_cost_usd, 5.0::DOUBLE AS embed_cost_ms,
         CAST(strlen(text) AS BIGINT) AS storage_bytes,
         CAST(1 + quality * 2 + toxic AS BIGINT) AS frequency,
         TIMESTAMP '{EPOCH}' + to_seconds(doc_id * 60) AS created_at,
         CASE WHEN toxic = 1 THEN NULL
              WHEN quality = 1 THEN TIMESTAMP '{EPOCH}' + to_seconds(doc_id * 60 + {TTL_S})
              ELSE TIMESTAMP '{EPOCH}' + to_seconds(doc_id * 60 + 3600) END AS expires_at
  FROM documents JOIN labels USING (doc_id) LEFT JOIN embeddings v ON doc_id = v.vec_id
)"""


def query_log(spark: SparkSession, sf: str) -> DataFrame:
    """Every event as one answered query: tenant = user, latency = value."""
    e = table(spark, sf, "events")
    k = F.from_json("props", "k INT").getField("k")
    tier = F.when(F.col("event_type") == "click", 1).otherwise(2)
    hit = F.col("event_type").isin("click", "view", "purchase")
    return e.select(
        F.col("event_id").alias("query_id"),
        F.col("event_id").alias("seq"),
        F.col("user_id").alias("tenant_id"),
        "ts",
        k.alias("k"),
        hit.alias("hit"),
        tier.alias("tier"),
        F.when(F.col("event_type") == "click", 1.0).when(hit, k / 100.0).otherwise(0.0).alias("similarity"),
        F.when(F.col("event_type") == "click", 1.0).when(hit, 0.6 + (k % 30) / 100.0).otherwise(0.0)
        .alias("threshold_used"),
        F.col("value").alias("latency_ms"),
        (F.col("event_type") == "error").alias("admission_rejected"),
        ((F.col("event_type") == "signup") & (k < 30)).alias("eviction_triggered"),
        F.col("event_type"),
    )


SQL_LOG = """
query_log AS (
  SELECT event_id AS query_id, event_id AS seq, user_id AS tenant_id, ts, k,
         event_type IN ('click', 'view', 'purchase') AS hit,
         CASE WHEN event_type = 'click' THEN 1 ELSE 2 END AS tier,
         CASE WHEN event_type = 'click' THEN 1.0::DOUBLE
              WHEN event_type IN ('view', 'purchase') THEN k / 100.0::DOUBLE ELSE 0.0::DOUBLE END AS similarity,
         CASE WHEN event_type = 'click' THEN 1.0::DOUBLE
              WHEN event_type IN ('view', 'purchase') THEN 0.6::DOUBLE + (k % 30) / 100.0::DOUBLE
              ELSE 0.0::DOUBLE END AS threshold_used,
         value AS latency_ms,
         event_type = 'error' AS admission_rejected,
         event_type = 'signup' AND k < 30 AS eviction_triggered,
         event_type
  FROM (SELECT *, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events)
)"""


def feedback(spark: SparkSession, sf: str) -> DataFrame:
    """Every event as one judged hit of the entry numbered like its user."""
    return query_log(spark, sf).select(
        F.col("tenant_id").alias("entry_id"),
        "seq",
        "ts",
        (F.col("k") / 100.0).alias("similarity"),
        (F.col("event_type") != "error").alias("was_correct"),
    )


SQL_FEEDBACK = SQL_LOG + """,
feedback AS (
  SELECT tenant_id AS entry_id, seq, ts, k / 100.0::DOUBLE AS similarity, event_type <> 'error' AS was_correct
  FROM query_log
)"""


def rewards(spark: SparkSession, sf: str, shards: int | None = 4) -> DataFrame:
    """Implicit rewards of all logged queries; shard = part of the users (or each user), arm = part of k."""
    from recollect.functions.scoring import implicit_reward

    return query_log(spark, sf).select(
        F.concat(F.lit("shard-"), (F.col("tenant_id") % shards if shards else F.col("tenant_id")).cast("string")).alias("shard_id"),
        (F.col("k") % 10).alias("arm"),
        "seq",
        F.when(F.col("hit"), implicit_reward(F.col("tier"), F.col("similarity"))).otherwise(0.0).alias("reward"),
    )


SQL_REWARD = """CASE WHEN NOT hit THEN 0.0::DOUBLE WHEN tier = 1 THEN 1.0::DOUBLE
            WHEN similarity > 0 THEN CASE WHEN similarity >= 0.85::DOUBLE THEN 1.0::DOUBLE
                 WHEN similarity < 0.65::DOUBLE THEN 0.0::DOUBLE
                 ELSE (similarity - 0.65::DOUBLE) / 0.20::DOUBLE END END"""

SQL_REWARDS = SQL_LOG + f""",
rewards AS (
  SELECT 'shard-' || CAST(tenant_id % 4 AS VARCHAR) AS shard_id, k % 10 AS arm, seq, {SQL_REWARD} AS reward
  FROM query_log
)"""


def messages(spark: SparkSession, sf: str) -> DataFrame:
    """Chat rows; created_at counts seconds from the turn number."""
    c = table(spark, sf, "conversations")
    return c.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"),
        F.col("conv_id").cast("string").alias("session_id"),
        "role",
        "text",
        "turn",
        (F.lit(EPOCH).cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("conv_id") * 60 + F.col("turn")))
        .alias("created_at"),
    )


SQL_MESSAGES = f"""
messages AS (
  SELECT conv_id * 1000 + turn AS id, CAST(conv_id AS VARCHAR) AS session_id, role, text, turn,
         TIMESTAMP '{EPOCH}' + to_seconds(conv_id * 60 + turn) AS created_at
  FROM conversations
)"""


def questions(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark passages and documents as questions and answers."""
    b = table(spark, sf, "benchmark").select(
        F.lit("benchmark").alias("dataset"), F.col("item_id").alias("seq"), F.col("text").alias("question"),
        F.col("text").alias("answer"),
    )
    d = table(spark, sf, "documents").select(
        F.lit("documents").alias("dataset"), F.col("doc_id").alias("seq"), F.col("text").alias("question"),
        F.col("source").alias("answer"),
    )
    both = b.unionByName(d)
    return both.select("dataset", "seq", T.short_id(F.col("question")).alias("id"), "question", "answer")


SQL_QUESTIONS = """
questions AS (
  SELECT dataset, seq, substr(md5(question), 1, 12) AS id, question, answer FROM (
    SELECT 'benchmark' AS dataset, item_id AS seq, text AS question, text AS answer FROM benchmark
    UNION ALL
    SELECT 'documents', doc_id, text, source FROM documents)
)"""



def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder on the storage the session names for checkpoints."""
    from recollect.plans.materialize import new_path

    return new_path(spark, name)
