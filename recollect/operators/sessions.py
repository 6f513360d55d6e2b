"""Chat history, message meta data and session segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.config import DEFAULT
from recollect.plans.running import by_width, highest, running, total

META_SCHEMA = "hit BOOLEAN, tier INT, similarity DOUBLE, latency_ms DOUBLE"
TITLE_LENGTH = 50


def message_meta(hit: Column, tier: Column, similarity: Column, latency_ms: Column) -> Column:
    """JSON kept beside a chat message about how it was answered."""
    return F.to_json(
        F.struct(hit.alias("hit"), tier.alias("tier"), similarity.alias("similarity"), latency_ms.alias("latency_ms"))
    )


def parse_meta(meta: Column) -> Column:
    """Struct from the JSON; fields are null where it cannot be read."""
    return F.from_json(meta, META_SCHEMA)


def chat_history(messages: DataFrame, max_turns: int = 10) -> DataFrame:
    """Per session: the last 2 x max_turns messages, then those of user and assistant, oldest first.

    System rows take places before they are dropped.
    """
    w = Window.partitionBy("session_id").orderBy(F.desc("created_at"), F.desc("id"))
    recent = messages.withColumn("_age", F.row_number().over(w)).filter(F.col("_age") <= 2 * max_turns)
    turns = recent.filter(F.col("role").isin("user", "assistant"))
    entry = F.struct((-F.col("_age")).alias("at"), "role", F.col("text").alias("content"))
    return turns.groupBy("session_id").agg(F.array_sort(F.collect_list(entry)).alias("history"))


def session_messages(messages: DataFrame, session_id: str) -> DataFrame:
    return messages.filter(F.col("session_id") == session_id).orderBy("created_at", "id")


def title_of(text: Column) -> Column:
    """First characters of the opening message, marked where it was cut."""
    return F.concat(
        F.substring(text, 1, TITLE_LENGTH), F.when(F.length(text) > TITLE_LENGTH, "…").otherwise("")
    )


def session_metadata(messages: DataFrame) -> DataFrame:
    """Title, creation and last update of every session."""
    first = F.struct("created_at", "id")
    return messages.groupBy("session_id").agg(
        title_of(F.min_by("text", first)).alias("title"),
        F.min("created_at").alias("created_at"),
        F.max("created_at").alias("updated_at"),
    )


def append_messages(messages: DataFrame, metadata: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Messages with the new ones added, and refreshed session metadata (titles stay)."""
    fresh = session_metadata(new)
    old = metadata.select(
        "session_id", F.col("title").alias("_t"), F.col("created_at").alias("_c"), F.col("updated_at").alias("_u")
    )
    merged = fresh.join(old, "session_id", "full").select(
        "session_id",
        F.coalesce("_t", "title").alias("title"),
        F.coalesce("_c", "created_at").alias("created_at"),
        F.coalesce("updated_at", "_u").alias("updated_at"),
    )
    return messages.unionByName(new), merged


def answer_messages(log: DataFrame, answers: DataFrame) -> DataFrame:
    """Chat rows (id, session_id, role, text, created_at, meta) of answered queries, as ``append_messages`` takes them.

    ``log``: query_id, seq, session_id, ts, query_text, hit, tier, similarity, latency_ms.  ``answers``: query_id, text.
    A query becomes the user's message and, where it has an answer, the assistant's with how it came about.
    """
    meta = message_meta(F.col("hit"), F.col("tier"), F.col("similarity"), F.col("latency_ms"))
    asked = F.struct((F.col("seq") * 2).alias("id"), F.lit("user").alias("role"), F.col("query_text").alias("text"), F.lit(None).cast("string").alias("meta"))
    said = F.struct((F.col("seq") * 2 + 1).alias("id"), F.lit("assistant").alias("role"), F.col("_answer").alias("text"), meta.alias("meta"))
    both = log.join(answers.select("query_id", F.col("text").alias("_answer")), "query_id", "left")
    rows = both.select("session_id", F.col("ts").alias("created_at"), F.explode(F.array(asked, said)).alias("m"))
    rows = rows.select("m.id", "session_id", "m.role", "m.text", "created_at", "m.meta")
    return rows.filter("role = 'user' or text is not null")


def recent_sessions(messages: DataFrame, metadata: DataFrame) -> DataFrame:
    """All sessions, last updated first, with their message counts."""
    counts = messages.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"))
    return (
        metadata.join(counts, "session_id", "left")
        .select("session_id", "title", "created_at", "updated_at", F.coalesce("n", F.lit(0)).alias("message_count"))
        .orderBy(F.desc("updated_at"), "session_id")
    )


def delete_sessions(
    messages: DataFrame, metadata: DataFrame, gone: DataFrame
) -> tuple[DataFrame, DataFrame]:
    ids = gone.select("session_id")
    return messages.join(ids, "session_id", "left_anti"), metadata.join(ids, "session_id", "left_anti")


def rename_sessions(metadata: DataFrame, titles: DataFrame) -> DataFrame:
    new = titles.select("session_id", F.col("title").alias("_t"))
    return metadata.join(new, "session_id", "left").withColumn("title", F.coalesce("_t", "title")).drop("_t")


def _micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def sessionize(
    requests: DataFrame, by: list[str], timeout_s: float = DEFAULT.session_timeout_s
) -> DataFrame:
    """Add segment (1, 2, ... per key, a new one after more than ``timeout_s`` idle) and turn."""
    block = by_width("seq")
    timed = requests.withColumn("_us", _micros("ts"))
    seen = running(
        timed, by, ["seq"], block,
        _n=total(F.lit(1).cast("bigint")), _prev=highest(F.col("_us"), inclusive=False),
    )
    fresh = F.col("_prev").isNull() | (F.col("_us") - F.col("_prev") > F.lit(int(timeout_s * 1_000_000)))
    marked = seen.withColumn("_fresh", fresh)
    out = running(
        marked, by, ["seq"], block,
        segment=total(F.col("_fresh").cast("bigint")), _from=highest(F.when(F.col("_fresh"), F.col("_n"))),
    )
    return out.select(*requests.columns, "segment", (F.col("_n") - F.col("_from") + 1).alias("turn"))


def session_activity(requests: DataFrame, now: Column, timeout_s: float = DEFAULT.session_timeout_s) -> DataFrame:
    """Turns, first and last activity of every session, and whether it is idle past the limit."""
    idle = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.max("ts").cast("timestamp"))
    return requests.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("turn_count"),
        F.min("ts").alias("first_active"),
        F.max("ts").alias("last_active"),
        (idle > F.lit(int(timeout_s * 1_000_000))).alias("is_expired"),
    )


def session_stats(activity: DataFrame, top: int = 20) -> DataFrame:
    """The ``top`` oldest sessions, as the dashboard lists them."""
    return activity.orderBy("first_active", "session_id").limit(top)
