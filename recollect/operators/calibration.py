"""Thresholds learned from judged hits.

``feedback`` carries entry_id, seq (unique, in arrival order), similarity, was_correct.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.config import DEFAULT, CacheConfig
from recollect.functions.scoring import nonconformity
from recollect.plans.running import by_width, numbered, trailing_frames


def newest(feedback: DataFrame, rows: int, key: str = "entry_id") -> DataFrame:
    """The last ``rows`` judgements of each entry; a rank filter, so tasks cut before the shuffle."""
    w = Window.partitionBy(key).orderBy(F.desc("seq"))
    return feedback.withColumn("_age", F.row_number().over(w)).filter(F.col("_age") <= rows)


def calibration_window(feedback: DataFrame, cfg: CacheConfig = DEFAULT) -> DataFrame:
    """Newest conformity scores per entry with their age (1 = newest)."""
    score = nonconformity(F.col("similarity"), F.col("was_correct"))
    return newest(feedback, cfg.max_scores).select("entry_id", "seq", score.alias("score"), F.col("_age").alias("age"))


def score_arrays(feedback: DataFrame, cfg: CacheConfig = DEFAULT) -> DataFrame:
    """entry_id -> array of its newest scores, oldest first (the stored form)."""
    rows = calibration_window(feedback, cfg)
    in_order = F.array_sort(F.collect_list(F.struct("seq", "score")))
    return rows.groupBy("entry_id").agg(F.transform(in_order, lambda s: s["score"]).alias("scores"))


def threshold_of(scores: Column, cfg: CacheConfig = DEFAULT) -> Column:
    """Threshold from an array of scores: one minus their upper quantile, clipped."""
    n = F.size(scores)
    upper = F.ceil(F.lit(1.0 - cfg.target_error) * (n + 1)) - 1
    at = F.greatest(F.least(upper, n - 1), F.lit(0)).cast("int") + 1
    tau = F.lit(1.0) - F.try_element_at(F.sort_array(scores), at)
    clipped = F.least(F.greatest(tau, F.lit(cfg.min_threshold)), F.lit(cfg.max_threshold))
    return F.when(n < cfg.min_scores, F.lit(cfg.default_threshold)).otherwise(clipped)


def conformal_thresholds(
    feedback: DataFrame, cfg: CacheConfig = DEFAULT, mode: str = "reference"
) -> DataFrame:
    """(entry_id, n_scores, threshold) of every entry with feedback.

    Wrong hits push the threshold of the plain rule down, not up, so no error bound follows
    from it.  ``mode="strict"`` is an addition: the threshold must also exceed every wrong
    similarity in the window.
    """
    rows = newest(feedback, cfg.max_scores)
    score = nonconformity(F.col("similarity"), F.col("was_correct"))
    wrong = F.max(F.when(~F.col("was_correct"), F.col("similarity")))
    grouped = rows.groupBy("entry_id").agg(F.collect_list(score).alias("scores"), wrong.alias("worst"))
    tau = threshold_of(F.col("scores"), cfg)
    if mode == "strict":
        tau = F.least(
            F.greatest(tau, F.coalesce(F.col("worst") + F.lit(1e-6), F.lit(0.0))), F.lit(cfg.max_threshold)
        )
    elif mode != "reference":
        raise ValueError("mode is 'reference' or 'strict'")
    return grouped.select("entry_id", F.size("scores").cast("bigint").alias("n_scores"), tau.alias("threshold"))


def calibration_stats(feedback: DataFrame, cfg: CacheConfig = DEFAULT) -> DataFrame:
    """Entries, calibrated entries and judgements by outcome."""
    per_entry = feedback.groupBy("entry_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("was_correct").alias("good")
    )
    return per_entry.agg(
        F.count(F.lit(1)).alias("total_entries"),
        F.count_if(F.col("n") >= cfg.min_scores).alias("calibrated_entries"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_updates"),
        F.coalesce(F.sum("good"), F.lit(0)).alias("correct_updates"),
        F.coalesce(F.sum(F.col("n") - F.col("good")), F.lit(0)).alias("incorrect_updates"),
    )


def vcache_thresholds(
    feedback: DataFrame, default: float = 0.80, error: float = 0.05, window: int = 50,
    low: float = 0.60, high: float = 0.99,
) -> DataFrame:
    """Per-entry threshold read directly off adjusted similarities (wrong = similarity + 0.1)."""
    adjusted = F.when(F.col("was_correct"), F.col("similarity")).otherwise(F.col("similarity") + F.lit(0.1))
    grouped = newest(feedback, window).groupBy("entry_id").agg(F.sort_array(F.collect_list(adjusted)).alias("s"))
    n = F.size("s")
    at = F.greatest(F.lit(0), F.floor(F.lit(1.0 - error) * n) - 1).cast("int") + 1
    tau = F.greatest(F.lit(low), F.least(F.lit(high), F.try_element_at("s", at)))
    return grouped.select("entry_id", F.when(n < 3, F.lit(default)).otherwise(tau).alias("threshold"))


def threshold_trace(feedback: DataFrame, cfg: CacheConfig = DEFAULT) -> DataFrame:
    """Threshold of the entry after each judgement."""
    scored = feedback.withColumn("_score", nonconformity(F.col("similarity"), F.col("was_correct")))
    placed = numbered(scored, ["entry_id"], ["seq"], by_width("seq"), "_rn")
    frames = trailing_frames(placed, ["entry_id"], "_rn", cfg.max_scores, _scores=F.collect_list("_score"))
    return frames.select("entry_id", "seq", threshold_of(F.col("_scores"), cfg).alias("threshold"))


def adaptive_global_threshold(
    hits: DataFrame, window: int = 200, floor: float = 0.65
) -> DataFrame:
    """Global threshold after each hit: mean minus one deviation of the last similarities."""
    placed = numbered(hits.select("seq", "similarity"), [], ["seq"], by_width("seq"), "_rn")
    frames = trailing_frames(placed, [], "_rn", window, _m=F.avg("similarity"), _s=F.stddev_pop("similarity"))
    return frames.select("seq", F.greatest(F.lit(floor), F.col("_m") - F.col("_s")).alias("threshold"))


def learned_global_threshold(
    hits: DataFrame, window: int = 200, floor: float = 0.65, initial: float = 0.82
) -> DataFrame:
    """One row: the global threshold after all hits, the initial one if there were none."""
    last = hits.select("seq", "similarity").orderBy(F.desc("seq")).limit(window)
    spread = F.avg("similarity") - F.stddev_pop("similarity")
    known = F.when(F.count(F.lit(1)) > 0, F.greatest(F.lit(floor), spread))
    return last.agg(F.coalesce(known, F.lit(initial)).alias("threshold"))


def quantile_position(n: int, error: float = DEFAULT.target_error) -> int:
    """0-based place of the quantile among ``n`` sorted scores."""
    return max(0, min(math.ceil((1 - error) * (n + 1)) - 1, n - 1))
