"""Sequential rules in batch form.

Token bucket and breaker turn blocks of a key into maps that compose (``plans/blockscan.py``); sessions are
cut where they are idle and, where they never are, into chunks with a lead-in.  So one busy key still spreads
over many tasks.  Drift windows and posteriors with resets are one chain per key.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.config import DEFAULT, CacheConfig
from recollect.functions.draws import beta
from recollect.operators import machines as MC
from recollect.operators import rules as RL
from recollect.operators.sessions import sessionize
from recollect.plans.blockscan import block_scan, micros
from recollect.plans.ordered import ordered_scan


def scan(df: DataFrame, keys: list[str], machine, keep: list[str], added: str) -> DataFrame:
    """Run a machine over the rows of each key in order of seq; output ``keep`` plus its columns."""
    types = dict(df.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in keep) + ", " + added

    def advance(state, rows: pd.DataFrame, fresh):
        state, columns = machine(state, rows, fresh)
        out = rows[keep].copy()
        for name, values in columns.items():
            out[name] = values
        return state, out

    return ordered_scan(df, keys, ["seq"], advance, schema)


def token_bucket(arrivals: DataFrame, rate: float, burst: int, by: str = "tenant_id", **spread) -> DataFrame:
    """allowed, tokens and retry_after_s for every arrival of (by, seq, ts), also where one key never pauses."""
    rows = arrivals.select(by, "seq", micros().alias("at"))
    return block_scan(
        rows, [by], RL.token_bucket(rate, burst), [by, "seq"], "allowed boolean, tokens double, retry_after_s double", **spread
    )


def breaker_states(calls: DataFrame, cfg: CacheConfig = DEFAULT, by: str = "dependency", **spread) -> DataFrame:
    """State before and after each call of (by, seq, ts, ok) and whether it was rejected, also where one key never recovers."""
    rows = calls.select(by, "seq", "ok", micros().alias("at"))
    return block_scan(
        rows, [by], RL.breaker(cfg.breaker_failures, cfg.breaker_reset_s), [by, "seq", "ok"],
        "state string, rejected boolean, state_after string", **spread,
    )


def breaker_stats(states: DataFrame, by: str = "dependency") -> DataFrame:
    """Calls, failures, successes and rejections per dependency, and its last state."""
    return states.groupBy(by).agg(
        F.count(F.lit(1)).alias("total_calls"),
        F.count_if(~F.col("rejected") & ~F.col("ok")).alias("total_failures"),
        F.count_if(~F.col("rejected") & F.col("ok")).alias("total_successes"),
        F.count_if("rejected").alias("rejected_calls"),
        F.max_by("state_after", "seq").alias("state"),
    )


#: Turns of a session that one task runs through, and turns before them that it starts with.
CHUNK_TURNS, LEAD_TURNS = 20_000, 256


def session_fusion(
    requests: DataFrame, cfg: CacheConfig = DEFAULT, contexts: DataFrame | None = None, chunk: int = CHUNK_TURNS, lead: int = LEAD_TURNS
) -> DataFrame:
    """Fused vector, context and turn of every request of (session_id, query_id, seq, ts, embedding).

    ``contexts`` (session_id, seq, ts, embedding, turn) carries sessions over from earlier runs;
    their seq must lie below those of the requests.

    A session without a pause is cut into chunks of ``chunk`` turns.  A chunk starts ``lead`` turns early, with the
    first of them for its context: each turn shrinks what the context was before to ``decay`` of the sum's length, so
    by 0.71 where turns are at right angles, and ``lead`` turns leave less than a double can hold.
    """
    if not 0 < lead <= chunk:
        raise ValueError("lead must lie between 1 and chunk")
    columns = ["session_id", "query_id", "seq", "ts", "embedding"]
    rows = requests.select(*columns, F.lit(0).alias("_turns"), F.lit(False).alias("is_context"))
    if contexts is not None:
        rows = contexts.select(
            "session_id", F.lit(None).cast(requests.schema["query_id"].dataType).alias("query_id"), "seq", "ts",
            F.col("embedding").cast(requests.schema["embedding"].dataType), F.col("turn").cast("int").alias("_turns"),
            F.lit(True).alias("is_context"),
        ).unionByName(rows)
    pieces = sessionize(rows, ["session_id"], cfg.session_timeout_s).withColumnRenamed("turn", "_at").withColumnRenamed("_turns", "turn")
    at = F.col("_at") - 1
    copies = F.when(at % chunk >= chunk - lead, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    spread = pieces.withColumn("_lead", F.explode(copies)).withColumn("_chunk", F.floor(at / chunk).cast("bigint") + F.col("_lead"))
    scanned = scan(
        spread, ["session_id", "segment", "_chunk"], MC.session_context(cfg.session_alpha, cfg.session_decay),
        ["session_id", "segment", "query_id", "seq", "ts", "is_context", "_lead", "_at"],
        "fused array<double>, context array<double>, turn int",
    )
    own = scanned.filter(~F.col("is_context") & (F.col("_lead") == 0))
    turn = F.col("_at").cast("int")
    if contexts is not None:  # a carried context stands for the turns before it
        carried = pieces.filter("is_context").groupBy("session_id", "segment").agg(F.max(F.col("turn") - F.col("_at")).cast("int").alias("_before"))
        own = own.join(carried, ["session_id", "segment"], "left")
        turn = turn + F.coalesce("_before", F.lit(0))
    return own.withColumn("turn", turn).select("session_id", "segment", "query_id", "seq", "ts", "fused", "context", "turn")


def last_contexts(fused: DataFrame) -> DataFrame:
    """Context of every session after its last request, in the form ``session_fusion`` takes."""
    row = F.struct("seq", "ts", F.col("context").alias("embedding"), "turn")
    return fused.groupBy("session_id").agg(F.max_by(row, "seq").alias("_r")).select("session_id", "_r.*")


def drift_windows(series: DataFrame, by: list[str], cfg: CacheConfig = DEFAULT) -> DataFrame:
    """Change flag, cut and window length after every value of (by, seq, reward).

    The window depends on all earlier cuts, so a key is one chain; a busy key is split by
    giving it several shards, as the posteriors are.
    """
    return scan(
        series.select(*by, "seq", "reward"), by, MC.drift(cfg.drift_delta, cfg.drift_window), [*by, "seq"],
        "changed boolean, cut int, window_size int",
    )


def bandit_updates(rewards: DataFrame, cfg: CacheConfig = DEFAULT) -> DataFrame:
    """Posterior of the arm in use after every reward of (shard_id, seq, arm, reward), with resets."""
    return scan(
        rewards.select("shard_id", "seq", F.col("arm").cast("double").alias("arm"), "reward"), ["shard_id"],
        MC.bandit(cfg.arms, cfg.drift_delta, cfg.drift_window), ["shard_id", "seq"],
        "used_arm int, alpha double, beta double, reset boolean, resets int",
    )


def resets_of(updates: DataFrame) -> DataFrame:
    """(shard_id, reset_seq): last reset per shard, as ``bandit_posterior`` takes it."""
    return updates.filter("reset").groupBy("shard_id").agg(F.max("seq").alias("reset_seq"))


def thompson_sample(posterior: DataFrame, seed: int) -> DataFrame:
    """One draw per arm from its posterior; the arm with the highest draw per shard, ties to the lowest arm."""
    key = F.concat_ws(":", F.lit(str(seed)), F.col("shard_id").cast("string"), F.col("arm").cast("string"))
    drawn = posterior.withColumn("draw", beta(F.col("alpha"), F.col("beta"), key))
    best = drawn.groupBy("shard_id").agg(F.max(F.struct("draw", (-F.col("arm")).alias("m"), "threshold")).alias("b"))
    return best.select("shard_id", (-F.col("b.m")).alias("arm"), F.col("b.threshold").alias("threshold"), F.col("b.draw").alias("draw"))
