"""Scalar text, cost and validation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from recollect.catalog import inputs as I
from recollect.catalog import query
from recollect.functions import scoring as S
from recollect.functions import text as T
from recollect.operators import lookup as L


@query("normalize_text", f"SELECT doc_id, {I.sql_normalize('text')} AS normalized FROM documents")
def normalize_text(spark, sf):
    return I.table(spark, sf, "documents").select("doc_id", T.normalize_text(F.col("text")).alias("normalized"))


@query("normalize_light", f"SELECT doc_id, {I.sql_light('text')} AS normalized FROM documents")
def normalize_light(spark, sf):
    return I.table(spark, sf, "documents").select("doc_id", T.normalize_light(F.col("text")).alias("normalized"))


@query(
    "exact_key",
    f"SELECT doc_id, {I.sql_key('text', 'lang')} AS exact_key, sha256({I.sql_normalize('text')}) AS memo_key FROM documents",
)
def exact_key(spark, sf):
    return I.table(spark, sf, "documents").select(
        "doc_id", T.exact_key(F.col("text"), F.col("lang")).alias("exact_key"), T.memo_key(F.col("text")).alias("memo_key")
    )


@query("short_id", "SELECT doc_id, substr(md5(text), 1, 12) AS id FROM documents")
def short_id(spark, sf):
    return I.table(spark, sf, "documents").select("doc_id", T.short_id(F.col("text")).alias("id"))


@query(
    "storage_bytes",
    """SELECT doc_id, CAST(CASE WHEN coalesce(quality, 0) = 0 THEN strlen(text) ELSE quality * n_chars END AS BIGINT)
       AS storage_bytes FROM documents LEFT JOIN labels USING (doc_id)""",
)
def storage_bytes(spark, sf):
    docs = I.table(spark, sf, "documents").join(I.table(spark, sf, "labels"), "doc_id", "left")
    return docs.select(
        "doc_id", S.storage_bytes(F.col("quality") * F.col("n_chars"), F.col("text")).alias("storage_bytes")
    )


@query(
    "token_cost",
    f"""SELECT doc_id, tokens, round(tokens / 1000.0::DOUBLE *
          CASE lang WHEN 'en' THEN 0.0::DOUBLE WHEN 'de' THEN 0.00027::DOUBLE WHEN 'fr' THEN 0.015::DOUBLE
          ELSE 0.01::DOUBLE END, 9) AS cost_usd
        FROM (SELECT doc_id, lang, CAST(coalesce(quality * 100, len({I.sql_words('text')})) AS BIGINT) AS tokens
              FROM documents LEFT JOIN labels USING (doc_id))""",
)
def token_cost(spark, sf):
    docs = I.table(spark, sf, "documents").join(I.table(spark, sf, "labels"), "doc_id", "left")
    backend = F.create_map(F.lit("en"), F.lit("ollama"), F.lit("de"), F.lit("groq"), F.lit("fr"), F.lit("openai"))
    counted = docs.withColumn("tokens", S.output_tokens(F.col("quality") * 100, F.col("text")))
    return counted.select(
        "doc_id", "tokens",
        F.round(S.token_cost(F.col("tokens"), F.coalesce(backend[F.col("lang")], F.lit("other"))), 9).alias("cost_usd"),
    )


@query(
    "stamp_expiry",
    f"""SELECT event_id, CASE WHEN ttl > 0 THEN ts + to_seconds(ttl) END AS expires_at,
          coalesce(TIMESTAMP '2024-01-15 00:00:00' > CASE WHEN ttl > 0 THEN ts + to_seconds(ttl) END, false) AS expired
        FROM (SELECT event_id, ts, k * 3600 AS ttl FROM (
              SELECT *, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events))""",
)
def stamp_expiry(spark, sf):
    e = I.table(spark, sf, "events").withColumn("ttl", F.from_json("props", "k INT").getField("k") * 3600)
    stamped = e.select("event_id", S.stamp_expiry(F.col("ts"), F.col("ttl")).alias("expires_at"))
    now = F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    return stamped.withColumn("expired", S.is_expired(now, F.col("expires_at")))


@query(
    "validate_requests",
    """SELECT request_id, error, tenant_id, bulk_size FROM (
         SELECT doc_id AS request_id,
           CASE WHEN text IS NULL OR length(text) < 1 THEN 'query_empty' WHEN length(text) > 10000 THEN 'query_too_long'
                WHEN (quality + toxic) * 0.6::DOUBLE > 1 THEN 'similarity_out_of_range'
                WHEN length(title) < 1 OR length(title) > 200 THEN 'title_length'
                WHEN bulk_size > 30 THEN 'bulk_too_long' END AS error,
           coalesce(nullif(lang, 'en'), 'default') AS tenant_id, bulk_size
         FROM (SELECT *, substr(text, 1, CAST(n_chars % 300 AS BIGINT)) AS title,
                      count(*) OVER (PARTITION BY lang, source) AS bulk_size
               FROM documents LEFT JOIN labels USING (doc_id)))""",
)
def validate_requests(spark, sf):
    docs = I.table(spark, sf, "documents").join(I.table(spark, sf, "labels"), "doc_id", "left")
    requests = docs.select(
        F.col("doc_id").alias("request_id"),
        F.col("text").alias("query_text"),
        ((F.col("quality") + F.col("toxic")) * F.lit(0.6)).alias("similarity"),
        F.expr("substr(text, 1, cast(n_chars % 300 as int))").alias("title"),
        F.nullif(F.col("lang"), F.lit("en")).alias("tenant_id"),
        F.concat_ws("/", "lang", "source").alias("bulk_id"),
    )
    return L.validate_requests(requests, max_bulk=30).select("request_id", "error", "tenant_id", "bulk_size")


@query(
    "implicit_reward",
    f"WITH {I.SQL_LOG} SELECT query_id, round({I.SQL_REWARD}, 9) AS reward, ({I.SQL_REWARD}) = 0.5 AS skipped FROM query_log WHERE hit",
)
def implicit_reward(spark, sf):
    log = I.query_log(spark, sf).filter("hit")
    reward = S.implicit_reward(F.col("tier"), F.col("similarity"))
    return log.select("query_id", F.round(reward, 9).alias("reward"), (reward == 0.5).alias("skipped"))


@query(
    "nonconformity",
    f"""WITH {I.SQL_FEEDBACK} SELECT seq, round(CASE WHEN was_correct THEN 1.0::DOUBLE - similarity
          ELSE least(1.0::DOUBLE, greatest(1.0::DOUBLE - similarity + 0.1::DOUBLE, 0.5::DOUBLE)) END, 9) AS score FROM feedback""",
)
def nonconformity(spark, sf):
    f = I.feedback(spark, sf)
    return f.select("seq", F.round(S.nonconformity(F.col("similarity"), F.col("was_correct")), 9).alias("score"))


def _turn_pairs(spark, sf):
    c = I.table(spark, sf, "conversations")
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return c.join(nxt, ["conv_id", "turn"])


_STOP = "[" + ", ".join(f"'{w}'" for w in T.STOPWORDS) + "]"
_PAIRS = f"""
pairs AS (
  SELECT a.conv_id, a.turn, a.text AS e, b.text AS c,
         list_distinct({I.sql_words('a.text')}) AS ew0, list_distinct({I.sql_words('b.text')}) AS cw0
  FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1
),
kept AS (
  SELECT *, list_filter(ew0, lambda w: NOT list_contains({_STOP}, w)) AS ew,
         list_filter(cw0, lambda w: NOT list_contains({_STOP}, w)) AS cw FROM pairs
)"""


@query(
    "answer_match",
    f"""WITH {_PAIRS} SELECT conv_id, turn,
          contains(lower(c), regexp_replace(lower(e), '^{T.SPACE}|{T.SPACE}$', '', 'g')) OR len(ew) = 0
          OR len(list_intersect(ew, cw)) / CAST(len(ew) AS DOUBLE) >= 0.35::DOUBLE
          OR len(list_filter(ew, lambda w: length(w) > 3 AND contains(lower(c), w))) > 0 AS correct FROM kept""",
)
def answer_match(spark, sf):
    return _turn_pairs(spark, sf).select(
        "conv_id", "turn", T.answer_match(F.col("text"), F.col("answer")).alias("correct")
    )


@query(
    "word_overlap_match",
    f"""WITH {_PAIRS} SELECT conv_id, turn, len(ew0) = 0
          OR len(list_intersect(ew0, cw0)) / CAST(len(ew0) AS DOUBLE) >= 0.3::DOUBLE AS correct FROM kept""",
)
def word_overlap_match(spark, sf):
    return _turn_pairs(spark, sf).select(
        "conv_id", "turn", T.word_overlap_match(F.col("text"), F.col("answer")).alias("correct")
    )


def sql_paraphrase(question: str, pick: str) -> str:
    quoted = [x.replace("'", "''") for x in T.LEAD_INS]
    leads = "[" + ", ".join(f"'{x}'" for x in quoted) + "]"
    body = f"{leads}[CAST({pick} % {len(quoted)} AS BIGINT) + 1] || lower(substr({question}, 1, 1)) || substr({question}, 2)"
    whens = " ".join(
        "WHEN lower(substr({q}, 1, {n})) = '{o}' THEN '{r}' || substr({q}, {m})".format(
            q=question, n=len(o), m=len(o) + 1, o=o.lower().replace("'", "''"), r=r.replace("'", "''")
        )
        for o, r in T.REWRITES
    )
    text = f"CASE {whens} ELSE {body} END"
    bare = f"regexp_replace(regexp_replace({text}, '\\?+$', ''), '^{T.SPACE}|{T.SPACE}$', '', 'g')"
    return f"CASE WHEN {bare} LIKE '%.' OR {bare} LIKE '%!' THEN {bare} ELSE {bare} || '?' END"


@query("paraphrase", f"SELECT doc_id, {sql_paraphrase('text', I.sql_hash(42, 'doc_id'))} AS paraphrase FROM documents")
def paraphrase(spark, sf):
    return I.table(spark, sf, "documents").select(
        "doc_id", T.paraphrase(F.col("text"), T.seeded_hash(42, F.col("doc_id"))).alias("paraphrase")
    )


@query(
    "message_meta_json",
    f"""WITH {I.SQL_LOG} SELECT query_id, hit, tier, similarity, CAST(NULL AS INTEGER) IS NULL AS bad_is_null
        FROM query_log""",
)
def message_meta_json(spark, sf):
    from recollect.operators.sessions import message_meta, parse_meta

    log = I.query_log(spark, sf)
    meta = log.select("query_id", message_meta(F.col("hit"), F.col("tier"), F.col("similarity"), F.col("latency_ms")).alias("meta"))
    parsed = meta.select("query_id", parse_meta(F.col("meta")).alias("m"), parse_meta(F.substring("meta", 1, 10)).alias("bad"))
    return parsed.select("query_id", "m.hit", "m.tier", "m.similarity", F.col("bad.tier").isNull().alias("bad_is_null"))
