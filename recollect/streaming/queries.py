"""The same work on unbounded input, with Structured Streaming.

Event time columns are ``timestamp`` (a watermark takes no other type).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from recollect.config import DEFAULT, CacheConfig
from recollect.functions import text as T
from recollect.operators import machines as MC
from recollect.streaming.parts import part_of, plain_values


def read_stream(spark: SparkSession, path: str, schema, files_per_batch: int | None = None) -> DataFrame:
    """Parquet files as they arrive."""
    reader = spark.readStream.schema(schema)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def stream_metrics(log: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Dashboard counters per event-time window; closed windows only (``open_windows`` has the others)."""
    return (
        log.withWatermark("ts", late)
        .groupBy(F.window("ts", width, slide))
        .agg(
            F.count(F.lit(1)).alias("queries"), F.count_if("hit").alias("hits"), F.avg("latency_ms").alias("avg_latency_ms"),
            F.count_if(F.col("hit") & (F.col("tier") == 1)).alias("tier1_hits"),
        )
        .select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "queries", "hits", "tier1_hits",
                "avg_latency_ms")
    )


def stream_exact_dedup(requests: DataFrame, ttl_s: int = 86_400, late: str = "1 hour") -> DataFrame:
    """(query_id, exact_key, ts) of requests that an answer of their key within the time to live does not cover.

    The earliest request of a key is kept and answers what follows for ``ttl_s`` seconds; the first one after
    that is kept again.  State is the time of the last kept request, and goes once the watermark has passed the
    end of its time.  A request older than the kept one counts as covered if it lies within that time of it.
    """
    keyed = requests.withColumn("exact_key", T.exact_key(F.col("query_text"), F.col("tenant_id")))
    keyed = keyed.withWatermark("ts", late).select("exact_key", "query_id", "ts")
    span = ttl_s * 1_000_000

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        parts = [b[["query_id", "ts"]] for b in batches]
        rows = pd.concat(parts, ignore_index=True).sort_values(["ts", "query_id"], ignore_index=True)
        at = rows["ts"].astype("datetime64[us]").astype("int64").to_numpy()
        last, kept, i = (state.get[0] if state.exists else None), [], 0
        if last is None:
            last, i = at[0], 1
            kept.append(0)
        else:  # late rows that no kept request covers
            i = int(np.searchsorted(at, last - span, "right"))
            kept.extend(range(i))
        while (i := int(np.searchsorted(at, last + span, "left"))) < len(at):
            kept.append(i)
            last = at[i]
        state.update((int(last),))
        state.setTimeoutTimestamp(max((int(last) + span) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        out = rows.iloc[sorted(set(kept))].copy()
        out["exact_key"] = key[0]
        yield out[["query_id", "exact_key", "ts"]]

    kind = dict(keyed.dtypes)["query_id"]
    return keyed.groupBy("exact_key").applyInPandasWithState(
        step, f"query_id {kind}, exact_key string, ts timestamp", "last long", "append", GroupStateTimeout.EventTimeTimeout
    )


def stream_sessions(requests: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Finished sessions with their turns (``open_sessions`` has the others)."""
    return (
        requests.withWatermark("ts", late)
        .groupBy("session_id", F.session_window("ts", gap))
        .agg(F.count(F.lit(1)).alias("turn_count"))
        .select("session_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "turn_count")
    )


def _stateful(df: DataFrame, keys: list[str], machine, keep: list[str], added: str, state_schema: str) -> DataFrame:
    """Run a machine per key over the rows of each micro-batch in order of seq."""
    types = dict(df.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in keep) + ", " + added

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches), ignore_index=True).sort_values("seq", ignore_index=True)
        fresh = np.zeros(len(rows), bool)
        fresh[0] = not state.exists
        current, columns = machine(state.get if state.exists else None, rows, fresh)
        state.update(current)
        out = rows[keep].copy()
        for name, values in columns.items():
            out[name] = values
        yield out

    return df.groupBy(*keys).applyInPandasWithState(step, schema, state_schema, "append", GroupStateTimeout.NoTimeout)


def stream_token_bucket(arrivals: DataFrame, rate: float, burst: int, by: str = "tenant_id") -> DataFrame:
    timed = arrivals.withColumn("at", F.unix_micros("ts") / F.lit(1e6)).select(by, "seq", "at")
    return _stateful(
        timed, [by], MC.token_bucket(rate, burst), [by, "seq"], "allowed boolean, tokens double, retry_after_s double",
        "tokens double, last double",
    )


def stream_breaker(calls: DataFrame, cfg: CacheConfig = DEFAULT, by: str = "dependency") -> DataFrame:
    timed = calls.withColumn("at", F.unix_micros("ts") / F.lit(1e6)).select(by, "seq", "at", "ok")
    return _stateful(
        timed, [by], MC.breaker(cfg.breaker_failures, cfg.breaker_reset_s), [by, "seq", "ok"],
        "state string, rejected boolean, state_after string", "phase string, count long, failed_at double",
    )


def stream_drift(series: DataFrame, by: str, cfg: CacheConfig = DEFAULT) -> DataFrame:
    return _stateful(
        series.select(by, "seq", "reward"), [by], MC.drift(cfg.drift_delta, cfg.drift_window), [by, "seq"],
        "changed boolean, cut long, window_size long", "window array<double>",
    )


def stream_bandit(rewards: DataFrame, cfg: CacheConfig = DEFAULT) -> DataFrame:
    rows = rewards.select("shard_id", "seq", F.col("arm").cast("double").alias("arm"), "reward")
    return _stateful(
        rows, ["shard_id"], MC.bandit(cfg.arms, cfg.drift_delta, cfg.drift_window), ["shard_id", "seq"],
        "used_arm long, alpha double, beta double, reset boolean, resets long",
        "alpha array<double>, beta array<double>, window array<double>, resets long",
    )


def stream_session_fusion(requests: DataFrame, cfg: CacheConfig = DEFAULT) -> DataFrame:
    """Fused vectors; an idle session starts afresh (state: context, turns, last activity)."""
    blend = MC.session_context(cfg.session_alpha, cfg.session_decay)

    def machine(state: tuple | None, rows: pd.DataFrame, fresh: np.ndarray):
        inner, last = (None, None) if state is None else ((state[0], state[1]), state[2])
        at = rows["at"].to_numpy()
        before = np.concatenate([[at[0] if last is None else last], at[:-1]])
        inner, columns = blend(inner, rows, fresh | (at - before > cfg.session_timeout_s))
        return (inner[0], int(inner[1]), float(at[-1])), {"fused": columns["fused"], "turn": columns["turn"]}

    timed = requests.select(
        "session_id", "query_id", "seq", "embedding", F.lit(0).alias("turn"), (F.unix_micros("ts") / F.lit(1e6)).alias("at")
    )
    return _stateful(
        timed, ["session_id"], machine, ["session_id", "query_id", "seq"], "fused array<double>, turn long",
        "context array<double>, turns long, last double",
    )


def stream_ttl(entries: DataFrame, late: str = "0 seconds") -> DataFrame:
    """Emits (entry_id, expired_at) once event time has passed the expiry of an entry.

    State is kept for a part of the entries at once: of each its expiry, and ``due``, from when on it is emitted
    (never by the trigger that brought it, which may still bring a later expiry).
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentWatermarkMs()
        ids, until, due = state.get if state.exists else ([], [], [])
        known = {i: (int(u), int(d)) for i, u, d in zip(ids, until, due, strict=True)}
        if not state.hasTimedOut:
            for b in batches:
                for i, u in zip(plain_values(b["entry_id"]), b["until_ms"].tolist(), strict=True):
                    u = max(int(u), known[i][0]) if i in known else int(u)
                    known[i] = u, max(u, now + 1)
        gone = [i for i, (_, d) in known.items() if d < now]
        if gone:
            out = [known.pop(i)[0] for i in gone]
            yield pd.DataFrame({"entry_id": gone, "expired_at": pd.to_datetime(pd.Series(out), unit="ms")})
        if not known:
            state.remove()
            return
        state.update(([*known], [u for u, _ in known.values()], [d for _, d in known.values()]))
        state.setTimeoutTimestamp(max(min(d for _, d in known.values()), now + 1))

    timed = entries.withWatermark("ts", late).filter(F.col("expires_at").isNotNull()).select(
        part_of("entry_id").alias("_part"), "entry_id", "ts", F.unix_millis("expires_at").alias("until_ms")
    )
    types = dict(timed.dtypes)
    return timed.groupBy("_part").applyInPandasWithState(
        step, f"entry_id {types['entry_id']}, expired_at timestamp", f"ids array<{types['entry_id']}>, until array<long>, due array<long>",
        "append", GroupStateTimeout.EventTimeTimeout,
    )


def open_windows(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The windows of an ended ``stream_metrics`` that the watermark has not closed, from the stream's own state."""
    state = spark.read.format("statestore").load(checkpoint)
    counts = F.col("value").cast("struct<queries: bigint, hits: bigint, tier1_hits: bigint, total: double, n: bigint>")
    return state.select("key.window", counts.alias("c")).select(
        F.col("window.start").alias("start"), F.col("window.end").alias("end"), "c.queries", "c.hits", "c.tier1_hits",
        (F.col("c.total") / F.when(F.col("c.n") > 0, F.col("c.n"))).alias("avg_latency_ms"),
    )


def open_sessions(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The sessions of an ended ``stream_sessions`` that may still go on, from the stream's own state."""
    state = spark.read.format("statestore").load(checkpoint).select("value.*")
    return state.select("session_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), F.col("count").alias("turn_count"))


def run_available(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Process what is there, append it to Parquet and return that table."""
    writer = stream.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", checkpoint)
    writer.trigger(availableNow=True).start(out).awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)
