"""One batch of queries against the stored cache: probe, log, admit, evict, write the next version.

State is a folder of versioned tables: ``entries``, ``buckets`` (frequency per semantic bucket),
``contexts`` (running session contexts), ``state`` (one row: inflation and counts), plus one
version of ``query_log`` per batch.  Version b + 1 comes from version <= b and batch b alone, so
replaying a batch writes the same rows again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.config import DEFAULT, CacheConfig
from recollect.functions import scoring as S
from recollect.functions import vectors as V
from recollect.operators import lookup as L
from recollect.operators import retention as R
from recollect.operators import sequential as SQ
from recollect.plans.materialize import checkpointed
from recollect.plans.materialize import stored as kept
from recollect.plans.spread import spread_join
from recollect.sources import snapshots

ENTRY_SCHEMA = (
    "entry_id STRING, tenant_id STRING, exact_key STRING, query_text STRING, response_text STRING, "
    "embedding ARRAY<DOUBLE>, bucket STRING, session_id STRING, llm_cost_usd DOUBLE, embed_cost_ms DOUBLE, "
    "output_tokens BIGINT, storage_bytes BIGINT, frequency BIGINT, seq BIGINT, last_access TIMESTAMP, "
    "created_at TIMESTAMP, expires_at TIMESTAMP, priority DOUBLE, batch BIGINT"
)
#: Rows to be stored whose names may be broadcast.
SMALL = 100_000
ENTRY_COLUMNS = [part.strip().split(" ")[0] for part in ENTRY_SCHEMA.split(", ")]


def _newest_before(spark: SparkSession, root: str, table: str, batch_id: int) -> DataFrame | None:
    known = [v for v in snapshots.versions(spark, f"{root}/{table}") if v <= batch_id]
    return snapshots.read_version(spark, f"{root}/{table}", known[-1]) if known else None


def read_entries(spark: SparkSession, root: str, batch_id: int | None = None) -> DataFrame:
    """Newest entries, or those a given batch starts from."""
    if batch_id is None:
        found = snapshots.read_version(spark, f"{root}/entries")
    else:
        found = _newest_before(spark, root, "entries", batch_id)
    return spark.createDataFrame([], ENTRY_SCHEMA) if found is None else found


def read_log(spark: SparkSession, root: str) -> DataFrame:
    """The log of all batches."""
    known = snapshots.versions(spark, f"{root}/query_log")
    return spark.read.parquet(*[f"{root}/query_log/version={v}" for v in known])


def _bucket(vector: Column, dim: int, cfg: CacheConfig) -> Column:
    return V.signature_key(V.lsh_signature(vector, dim, cfg.lsh_tables, cfg.lsh_bits, cfg.lsh_seed))


def _probe(batch: DataFrame, live: DataFrame, stored: DataFrame, contexts, thresholds, cfg: CacheConfig):
    """Both tiers; only misses of the first one advance their session and reach the vectors."""
    first = live if cfg.exact_checks_ttl else stored
    exact = checkpointed(
        L.exact_lookup(batch, first.select("entry_id", "exact_key", "seq")).withColumnRenamed("entry_id", "exact_id")
    )
    rest = exact.filter(F.col("exact_id").isNull())
    talking = rest.filter(F.col("session_id").isNotNull() & F.col("embedding").isNotNull())
    fused = checkpointed(SQ.session_fusion(talking, cfg, contexts))
    rest = rest.join(fused.select("query_id", "fused"), "query_id", "left").withColumn(
        "embedding", F.coalesce("fused", F.col("embedding").cast("array<double>"))
    ).drop("fused")
    near = L.semantic_lookup(rest, live, thresholds, cfg)
    probed = rest.drop("exact_id").join(near.withColumnRenamed("entry_id", "near_id"), "query_id", "left")
    hits = exact.filter(F.col("exact_id").isNotNull()).select(
        *batch.columns, "exact_id", F.lit(None).cast("string").alias("near_id"),
        F.lit(1.0).alias("similarity"), F.lit(1.0).alias("threshold"),
    )
    misses = probed.select(
        *batch.columns, F.lit(None).cast("string").alias("exact_id"), "near_id", "similarity", "threshold"
    )
    return checkpointed(
        hits.withColumn("embedding", F.col("embedding").cast("array<double>")).unionByName(misses)
    ), fused


def cache_step(
    spark: SparkSession,
    root: str,
    batch_id: int,
    batch: DataFrame,
    responses: DataFrame,
    now: Column,
    dim: int,
    thresholds: DataFrame | None = None,
    cfg: CacheConfig = DEFAULT,
) -> DataFrame:
    """Answer one batch and store the next version; returns the log rows of the batch.

    ``batch``: query_id, seq, tenant_id, session_id, ts, query_text, embedding.
    ``responses``: exact_key, response_text, output_tokens, cost_usd, latency_ms.
    A missed query asks for admission in its turn, with bucket counts as of then; later repeats of its key are
    exact hits on it once it is admitted.  All rows of a missed key count for the bucket of its first row.
    What exceeds the capacity is evicted at the end of the batch: stored rows first, then, if the batch alone
    exceeds it, admitted ones, always those of lowest priority.  Sessions idle at the end of the batch go.
    """
    stored = read_entries(spark, root, batch_id)
    live = L.live(stored, now)
    state = _newest_before(spark, root, "state", batch_id)
    inflation = 0.0 if state is None else float(state.select("inflation").head()[0])
    contexts = _newest_before(spark, root, "contexts", batch_id)
    buckets = _newest_before(spark, root, "buckets", batch_id)
    if contexts is not None:
        # Carried contexts sort before every request of the batch.
        contexts = contexts.withColumn("seq", F.lit(-1).cast("bigint"))

    # Texts stay behind until it is known which rows are stored.
    narrow = L.with_exact_key(batch).withColumn("_text_hash", F.xxhash64("query_text")).drop("query_text")
    probed, fused = _probe(narrow, live, stored, contexts, thresholds, cfg)
    hit_id = F.coalesce("exact_id", "near_id")
    hits = probed.filter(hit_id.isNotNull()).withColumn("entry_id", hit_id)
    missed = probed.filter(hit_id.isNull())

    firsts = missed.groupBy("exact_key").agg(F.min_by("embedding", "seq").alias("_first"))
    answers = responses.groupBy("exact_key").agg(
        F.min_by(F.struct("response_text", "output_tokens", "cost_usd", "latency_ms"), "response_text").alias("a")
    )
    answers = kept(answers.select("exact_key", "a.*", S.storage_bytes(F.lit(0), F.col("a.response_text")).alias("storage_bytes")), "answers")
    known_answers = answers.select("exact_key", F.struct("output_tokens", "cost_usd", "latency_ms", "storage_bytes").alias("a"))
    keys = firsts.join(known_answers, "exact_key").withColumn("bucket", _bucket(F.col("_first"), dim, cfg)).drop("_first")
    asks = checkpointed(
        spread_join(missed, keys, ["exact_key"], "inner", "query_id").withColumn("entry_id", F.concat(F.lit("e"), F.col("query_id").cast("string")))
    )
    touched = checkpointed(hits.groupBy("entry_id").agg(F.count(F.lit(1)).alias("_n"), F.max("ts").alias("_ts")))
    accesses = spread_join(hits.select("entry_id", "seq"), live.select("entry_id", "bucket"), ["entry_id"], "inner", "seq")

    one = F.lit("all").alias("_all")
    size = R.window_size(cfg.capacity, cfg.window_fraction)
    known = buckets if buckets is not None else spark.createDataFrame([], "bucket string, frequency bigint")
    window = R.first_rows(
        live.select("entry_id", "batch", "seq", "bucket", one), ["_all"], [-F.col("batch"), -F.col("seq")], size, "entry_id", "_in"
    ).filter("_in")
    # One order over all batches: older batches first.
    window = window.withColumn("seq", F.struct("batch", "seq")).drop("batch", "_in")
    in_turn = lambda df: df.withColumn("seq", F.struct(F.lit(batch_id).cast("bigint").alias("batch"), "seq"))
    decided = checkpointed(R.admission_gate(
        in_turn(asks.select("entry_id", "seq", "bucket", one, F.col("exact_key").alias("key"))), window, known, size, by="_all",
        shards=cfg.admission_shards, accesses=in_turn(accesses.select("seq", "bucket", one)),
    ).select("entry_id", "admitted", "holder_id"))
    asks = checkpointed(asks.join(decided, "entry_id"))
    counted = asks.select("bucket").unionByName(accesses.select("bucket")).filter(F.col("bucket").isNotNull())
    seen = known.unionByName(counted.groupBy("bucket").agg(F.count(F.lit(1)).alias("frequency")))
    seen = checkpointed(seen.groupBy("bucket").agg(F.sum("frequency").alias("frequency")))
    repeats = asks.filter(F.col("holder_id").isNotNull()).groupBy(F.col("holder_id").alias("entry_id")).agg(
        F.count(F.lit(1)).alias("_more"), F.max("ts").alias("_last")
    )
    admitted = checkpointed(asks.filter("admitted").join(repeats, "entry_id", "left"))
    total_new = admitted.count()

    used = live.join(touched, "entry_id", "left").select(
        *[c for c in ENTRY_COLUMNS if c not in ("frequency", "last_access", "priority")],
        (F.col("frequency") + F.coalesce("_n", F.lit(0))).alias("frequency"),
        F.greatest("last_access", "_ts").alias("last_access"),
        F.col("_n").isNotNull().alias("_used"), F.col("priority").alias("_old"),
    )
    used = R.with_priority(used, inflation).withColumn(
        "priority", F.when(F.col("_used"), F.col("priority")).otherwise(F.col("_old"))
    ).withColumn("_all", F.lit("all"))
    total_old = live.count()
    overflow = max(0, total_old + total_new - cfg.capacity)
    used, level = _evict(used, min(overflow, total_old), inflation)
    fresh = admitted.select(
        "entry_id", "tenant_id", "exact_key", "query_id", "_text_hash", "embedding", "bucket", "session_id", F.col("a.cost_usd").alias("llm_cost_usd"), F.lit(0.0).alias("embed_cost_ms"),
        F.col("a.output_tokens").cast("bigint").alias("output_tokens"),
        F.col("a.storage_bytes").alias("storage_bytes"),
        (F.coalesce("_more", F.lit(0)) + 1).alias("frequency"), "seq", F.coalesce("_last", "ts").alias("last_access"),
        F.col("ts").alias("created_at"), S.stamp_expiry(F.col("ts"), F.lit(cfg.ttl_s)).alias("expires_at"),
        F.lit(batch_id).cast("bigint").alias("batch"),
    )
    fresh, level = _evict(
        R.with_priority(fresh, level).withColumn("_all", F.lit("all")), max(0, overflow - total_old), level
    )
    entries = used.select(*ENTRY_COLUMNS).unionByName(_with_texts(fresh, batch, answers).select(*ENTRY_COLUMNS))

    log = _log_rows(probed, asks, overflow > 0)
    version = batch_id + 1
    snapshots.write_version(log, f"{root}/query_log", version)
    snapshots.write_version(seen, f"{root}/buckets", version)
    moved = SQ.last_contexts(fused)
    if contexts is not None:
        moved = contexts.join(moved, "session_id", "left_anti").unionByName(moved)
    latest = batch.agg(F.max("ts").alias("at")).head().at
    if latest is not None:
        moved = moved.filter(F.col("ts") >= F.lit(latest) - F.make_dt_interval(secs=F.lit(cfg.session_timeout_s)))
    snapshots.write_version(moved, f"{root}/contexts", version)
    snapshots.write_version(entries, f"{root}/entries", version)
    counts = spark.range(1).select(
        F.lit(float(level)).alias("inflation"), F.lit(total_new).cast("bigint").alias("admitted"),
        F.lit(overflow).cast("bigint").alias("evicted"),
    )
    snapshots.write_version(counts, f"{root}/state", version)
    return snapshots.read_version(spark, f"{root}/query_log", version)


def _with_texts(fresh: DataFrame, batch: DataFrame, answers: DataFrame) -> DataFrame:
    """Rows to be stored with the text of their query and the answer to it."""
    fresh = checkpointed(fresh)
    named = fresh.select("query_id", "_text_hash").distinct()
    keys = fresh.select("exact_key").distinct()
    if fresh.limit(SMALL + 1).count() <= SMALL:
        named, keys = F.broadcast(named), F.broadcast(keys)
    asked = batch.select("query_id", "query_text", F.xxhash64("query_text").alias("_text_hash"))
    texts = asked.join(named, ["query_id", "_text_hash"], "left_semi").dropDuplicates(["query_id", "_text_hash"])
    replies = answers.select("exact_key", "response_text").join(keys, "exact_key", "left_semi")
    return fresh.join(texts, ["query_id", "_text_hash"], "left").join(replies, "exact_key", "left")


def _evict(entries: DataFrame, n: int, level: float) -> tuple[DataFrame, float]:
    """Entries without the ``n`` of lowest priority, and the inflation that leaves."""
    if not n:
        return entries, level
    marked = checkpointed(R.first_rows(entries, ["_all"], [F.col("priority"), F.col("entry_id")], n, "entry_id", "_out"))
    highest = marked.filter("_out").agg(F.max("priority")).head()[0]
    return marked.filter(~F.col("_out")), level if highest is None else float(highest)


def _log_rows(probed: DataFrame, asks: DataFrame, evicting: bool) -> DataFrame:
    """One log row per query; repeats of an admitted key count as exact hits on it."""
    outcome = asks.select(
        "query_id", "holder_id", F.col("entry_id").alias("_own"), F.col("admitted").alias("_stored"), F.col("a.latency_ms").alias("_ms")
    )
    keyed = probed.join(outcome, "query_id", "left")
    missing = F.col("exact_id").isNull() & F.col("near_id").isNull()
    stored = F.coalesce("_stored", F.lit(False))
    repeat = F.col("holder_id").isNotNull()
    hit = ~missing | repeat
    exact = F.col("exact_id").isNotNull() | repeat
    return keyed.select(
        "query_id", "seq", "tenant_id", "session_id", "ts", hit.alias("hit"),
        F.when(exact, 1).when(F.col("near_id").isNotNull(), 2).otherwise(0).alias("tier"),
        F.coalesce("exact_id", "near_id", "holder_id", F.when(stored, F.col("_own"))).alias("entry_id"),
        F.when(exact, 1.0).otherwise(F.coalesce("similarity", F.lit(0.0))).alias("similarity"),
        F.when(exact, 1.0).otherwise(F.coalesce("threshold", F.lit(0.0))).alias("threshold_used"),
        F.when(hit, 0.0).otherwise(F.col("_ms")).alias("latency_ms"),
        (missing & F.col("_ms").isNotNull() & ~stored & ~repeat).alias("admission_rejected"),
        (F.lit(evicting) & stored).alias("eviction_triggered"),
        (missing & F.col("_own").isNull()).alias("error"),
    )


def feedback_step(
    feedback: DataFrame, new: DataFrame, entries: DataFrame, posterior: DataFrame, cfg: CacheConfig = DEFAULT
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(feedback log with the accepted rows, new threshold per judged entry, posterior).

    Unknown entries are refused.  Each judgement rewards the arm that is best for its shard
    when the step starts; ``new`` carries entry_id, seq, similarity, was_correct, shard_id.
    """
    from recollect.operators.bandit import best_arm
    from recollect.operators.calibration import conformal_thresholds

    ok = L.feedback_join(new, entries).filter("status = 'ok'").drop("status")
    log = feedback.unionByName(ok.select(*feedback.columns))
    judged = ok.select("entry_id").distinct()
    # Only entries judged in this step are recomputed.
    tau = conformal_thresholds(log.join(judged, "entry_id", "left_semi"), cfg)
    best = best_arm(posterior).select("shard_id", F.col("best_arm").alias("arm"))
    good = F.count_if("was_correct")
    gain = ok.groupBy("shard_id").agg(good.alias("_g"), (F.count(F.lit(1)) - good).alias("_b")).join(best, "shard_id")
    moved = posterior.join(gain, ["shard_id", "arm"], "left").select(
        "shard_id", "arm", "threshold",
        (F.col("alpha") + F.coalesce("_g", F.lit(0))).alias("alpha"),
        (F.col("beta") + F.coalesce("_b", F.lit(0))).alias("beta"),
        (F.col("updates") + F.coalesce(F.col("_g") + F.col("_b"), F.lit(0))).alias("updates"),
    )
    return log, tau, moved


SCORES_SCHEMA = "entry_id {}, recent array<struct<seq: bigint, score: double>>"
ARMS_SCHEMA = "shard_id string, alpha array<double>, beta array<double>, window array<double>, resets bigint"


def merged_scores(kept: DataFrame | None, accepted: DataFrame, cfg: CacheConfig = DEFAULT) -> DataFrame:
    """(entry_id, recent) of the entries judged now: their newest scores, those kept so far and the new ones.

    ``kept`` holds (entry_id, recent) of all entries, at most ``cfg.max_scores`` each; nothing older is needed again.
    """
    from recollect.operators.calibration import calibration_window

    fresh = calibration_window(accepted, cfg).groupBy("entry_id").agg(F.collect_list(F.struct(F.col("seq").cast("bigint").alias("seq"), "score")).alias("_new"))
    if kept is None:
        both = F.col("_new")
    else:
        fresh = fresh.join(kept.select("entry_id", "recent"), "entry_id", "left")
        none = F.array().cast("array<struct<seq: bigint, score: double>>")
        both = F.concat(F.coalesce("recent", none), "_new")
    newest = F.reverse(F.slice(F.reverse(F.array_sort(both)), 1, cfg.max_scores))
    return fresh.select("entry_id", newest.alias("recent"))


def moved_arms(arms: DataFrame | None, rewards: DataFrame, cfg: CacheConfig = DEFAULT) -> DataFrame:
    """(shard_id, alpha, beta, window, resets) of the shards with new ``rewards`` (shard_id, seq, reward), from those stored.

    Every reward goes to the arm that is best at that moment; when the rewards drift, the shard starts over.
    """
    import numpy as np
    import pandas as pd

    from recollect.operators import machines as MC

    machine = MC.bandit(cfg.arms, cfg.drift_delta, cfg.drift_window)
    columns = ("alpha", "beta", "window", "resets")
    rows = rewards.select(F.col("shard_id").cast("string").alias("shard_id"), "seq", F.col("reward").cast("double").alias("reward"))
    if arms is None:
        started = rows.withColumns({f"_{c}": F.lit(None).cast("bigint" if c == "resets" else "array<double>") for c in columns})
    else:
        first = rows.groupBy("shard_id").agg(F.min("seq").alias("seq")).join(arms, "shard_id")
        first = first.select("shard_id", "seq", *[F.col(c).alias(f"_{c}") for c in columns])
        started = rows.join(first, ["shard_id", "seq"], "left")

    def run(batches):
        shard, state = None, None
        for batch in batches:
            for name, part in batch.groupby("shard_id", sort=False, dropna=False):
                if name != shard:
                    if shard is not None:
                        yield pd.DataFrame([(shard, *state)], columns=["shard_id", *columns])
                    kept = part["_alpha"].iloc[0]
                    shard = name
                    state = None if kept is None else tuple(part[f"_{c}"].iloc[0] for c in columns)
                state, _ = machine(state, part.assign(arm=np.nan), np.zeros(len(part), bool))
        if shard is not None:
            yield pd.DataFrame([(shard, *state)], columns=["shard_id", *columns])

    return started.repartition("shard_id").sortWithinPartitions("shard_id", "seq").mapInPandas(run, ARMS_SCHEMA)


def feedback_merge(
    scores: DataFrame | None, arms: DataFrame | None, new: DataFrame, entries: DataFrame, cfg: CacheConfig = DEFAULT
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(accepted judgements, newest scores, thresholds, arms) after the judgements of ``new``; the log is not read again.

    ``new`` carries entry_id, seq, similarity, was_correct, shard_id; unknown entries are refused.  ``scores`` and
    ``arms`` are what the step before stored, None at first; the results hold the entries and shards that changed.
    """
    from recollect.operators.calibration import threshold_of

    ok = L.feedback_join(new, entries).filter("status = 'ok'").drop("status")
    recent = merged_scores(scores, ok, cfg)
    only = F.transform("recent", lambda s: s["score"])
    tau = recent.select("entry_id", F.size("recent").cast("bigint").alias("n_scores"), threshold_of(only, cfg).alias("threshold"))
    rewards = ok.select("shard_id", "seq", F.when(F.col("was_correct"), 1.0).otherwise(0.0).alias("reward"))
    return ok, recent, tau, moved_arms(arms, rewards, cfg)


def implicit_step(arms: DataFrame | None, log: DataFrame, cfg: CacheConfig = DEFAULT) -> DataFrame:
    """Arms after the implicit rewards of the hits in ``log`` (shard_id, seq, hit, tier, similarity); the calibration is not touched.

    A similarity that says nothing (a reward of exactly 0.5) moves no arm.
    """
    rewards = log.filter("hit").select("shard_id", "seq", S.implicit_reward(F.col("tier"), F.col("similarity")).alias("reward"))
    return moved_arms(arms, rewards, cfg)


def replaced(stored: DataFrame | None, changed: DataFrame, key: str) -> DataFrame:
    """A stored state with its changed rows in place of the old ones."""
    if stored is None:
        return changed
    return stored.join(changed.select(key), key, "left_anti").unionByName(changed)
