"""Reading, merging, expiring and compacting the stored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.config import DEFAULT, CacheConfig
from recollect.operators.calibration import score_arrays
from recollect.plans.spread import spread_join


def load_live_entries(entries: DataFrame, now: Column) -> DataFrame:
    """Entries still valid after ``now``; the filter reaches the Parquet scan."""
    return entries.filter(F.col("expires_at").isNull() | (F.col("expires_at") > now))


def upsert(stored: DataFrame, new: DataFrame, key: list[str], version: list[str]) -> DataFrame:
    """Insert or replace by key; among several new rows of a key the highest version wins.

    New rows are first reduced to one per key, so the big table is only anti-joined.
    """
    others = [c for c in new.columns if c not in key]
    row = F.struct(*others)
    latest = new.groupBy(*key).agg(F.max_by(row, F.struct(*version)).alias("_row"))
    latest = latest.select(*key, "_row.*").select(*stored.columns)
    return stored.join(latest.select(*key), key, "left_anti").unionByName(latest)


def _without(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of other entries.  A log with a seq may be mostly about one entry, so it is spread."""
    if "seq" in rows.columns:
        return spread_join(rows, ids, ["entry_id"], "left_anti", "seq")
    return rows.join(ids, "entry_id", "left_anti")


def delete_entries(entries: DataFrame, scores: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the given entries."""
    ids = gone.select("entry_id")
    return entries.join(ids, "entry_id", "left_anti"), _without(scores, ids)


def purge_expired(
    entries: DataFrame, now: Column, *dependents: DataFrame
) -> tuple[DataFrame, list[DataFrame], DataFrame]:
    """(entries kept, dependents kept, one row with the number removed)."""
    expired = F.col("expires_at").isNotNull() & (now > F.col("expires_at"))
    gone = entries.filter(expired).select("entry_id")
    kept = entries.filter(~expired)
    counted = entries.agg(F.count_if(expired).alias("removed"))
    return kept, [_without(d, gone) for d in dependents], counted


def clear_entries(entries: DataFrame, tenant: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(what stays, one row with the number cleared) for one tenant or all."""
    doomed = F.lit(True) if tenant is None else F.col("tenant_id") == tenant
    return entries.filter(~doomed), entries.agg(F.count_if(doomed).alias("cleared"))


def snapshot_compact(entries: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Entries without tombstoned rows, however few those are."""
    return _without(entries, tombstones)


def compaction_due(tombstones: DataFrame, min_removals: int = 500) -> bool:
    """Whether enough tombstones piled up to rewrite the files; what readers see does not depend on it."""
    return tombstones.limit(min_removals).count() >= min_removals


def calibration_store(feedback: DataFrame, cfg: CacheConfig = DEFAULT) -> DataFrame:
    """(entry_id, scores): the stored form of the calibration window."""
    return score_arrays(feedback, cfg)


def calibration_rows(stored: DataFrame) -> DataFrame:
    """Stored score arrays as rows (entry_id, pos, score), oldest first."""
    return stored.select("entry_id", F.posexplode("scores").alias("pos", "score"))


def bandit_store(posterior: DataFrame) -> DataFrame:
    """(shard_id, alpha, beta): one row per shard with arrays in arm order."""
    arms = F.array_sort(F.collect_list(F.struct("arm", "alpha", "beta")))
    packed = posterior.groupBy("shard_id").agg(arms.alias("a"))
    return packed.select(
        "shard_id",
        F.transform("a", lambda x: x["alpha"]).alias("alpha"),
        F.transform("a", lambda x: x["beta"]).alias("beta"),
    )


def bandit_rows(stored: DataFrame) -> DataFrame:
    """Stored posteriors in long form."""
    pairs = F.posexplode(F.arrays_zip("alpha", "beta")).alias("arm", "p")
    return stored.select("shard_id", pairs).select("shard_id", "arm", "p.alpha", "p.beta")
