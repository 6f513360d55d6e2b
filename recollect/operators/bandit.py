"""Beta posteriors over threshold arms, in long form (shard_id, arm, threshold, alpha, beta)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.config import DEFAULT, CacheConfig
from recollect.plans.spread import spread_join

# Prior counts at the start and after a reset.
PRIOR, AFTER_RESET = 1.0, 2.0


def arm_threshold(arm, cfg: CacheConfig = DEFAULT):
    """Evenly spaced thresholds from the lowest to the highest arm."""
    step = (cfg.arm_high - cfg.arm_low) / max(cfg.arms - 1, 1)
    return F.lit(cfg.arm_low) + arm * F.lit(step)


def bandit_posterior(
    rewards: DataFrame, resets: DataFrame | None = None, cfg: CacheConfig = DEFAULT
) -> DataFrame:
    """Posterior of every arm of every shard from the rewards after its last reset.

    ``resets`` holds (shard_id, reset_seq); a reward of exactly 0.5 says nothing and is skipped.
    """
    telling = rewards.filter(F.col("reward").isNotNull() & (F.col("reward") != 0.5))
    shards = rewards.select("shard_id").distinct()
    if resets is None:
        shards = shards.withColumn("reset_seq", F.lit(None).cast("bigint"))
    else:
        shards = shards.join(resets.select("shard_id", "reset_seq"), "shard_id", "left")
        last = resets.select("shard_id", "reset_seq")
        telling = spread_join(telling, last, ["shard_id"], "left", "seq").filter(
            F.col("reset_seq").isNull() | (F.col("seq") > F.col("reset_seq"))
        )
    sums = telling.groupBy("shard_id", "arm").agg(
        F.sum("reward").alias("r"), F.sum(F.lit(1.0) - F.col("reward")).alias("f"), F.count(F.lit(1)).alias("u")
    )
    grid = shards.withColumn("arm", F.explode(F.sequence(F.lit(0), F.lit(cfg.arms - 1))))
    prior = F.when(F.col("reset_seq").isNull(), F.lit(PRIOR)).otherwise(F.lit(AFTER_RESET))
    return grid.join(sums, ["shard_id", "arm"], "left").select(
        "shard_id", "arm", arm_threshold(F.col("arm"), cfg).alias("threshold"),
        (prior + F.coalesce("r", F.lit(0.0))).alias("alpha"),
        (prior + F.coalesce("f", F.lit(0.0))).alias("beta"),
        F.coalesce("u", F.lit(0)).alias("updates"),
    )


def best_arm(posterior: DataFrame) -> DataFrame:
    """Arm with the highest expected reward per shard, ties to the lowest arm."""
    expected = F.col("alpha") / (F.col("alpha") + F.col("beta"))
    top = F.struct(expected.alias("expected"), (-F.col("arm")).alias("m"), "threshold")
    return posterior.groupBy("shard_id").agg(F.max(top).alias("t"), F.sum("updates").alias("total_updates")).select(
        "shard_id", (-F.col("t.m")).alias("best_arm"), F.col("t.threshold").alias("best_threshold"),
        F.col("t.expected").alias("expected"), "total_updates",
    )


def fedavg_merge(posterior: DataFrame) -> DataFrame:
    """Mean of the posteriors of all shards, arm by arm."""
    return posterior.groupBy("arm", "threshold").agg(
        F.avg("alpha").alias("alpha"), F.avg("beta").alias("beta"), F.count(F.lit(1)).alias("shards")
    )


def spread_merged(posterior: DataFrame) -> DataFrame:
    """Every shard with the merged posterior in place of its own."""
    merged = fedavg_merge(posterior).select("arm", "alpha", "beta")
    return posterior.drop("alpha", "beta").join(merged, "arm")  # one row per arm
