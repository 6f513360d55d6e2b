"""Which entries to admit, keep and evict.

Entries carry tenant_id, entry_id, seq, frequency, llm_cost_usd, embed_cost_ms, storage_bytes,
last_access and, for eviction, priority.
"""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.config import DEFAULT, CacheConfig
from recollect.functions import scoring as S
from recollect.plans.ordered import ordered_scan
from recollect.plans.ranks import first_rows
from recollect.plans.spread import spread_join


def with_priority(entries: DataFrame, inflation: Column | float = 0.0, extra_ms: float = 0.0) -> DataFrame:
    """Add priority; ``extra_ms`` is the flat cost one of the compared strategies adds."""
    level = F.lit(float(inflation)) if isinstance(inflation, (int, float)) else inflation
    return entries.withColumn(
        "priority",
        S.priority(
            F.col("frequency"), F.col("llm_cost_usd"), F.col("embed_cost_ms"), F.col("storage_bytes"), level, extra_ms
        ),
    )


def _by_rank(entries: DataFrame, keys: list[str], order: list, quota: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split into (taken, kept): the first n rows per key, n from ``quota``."""
    marked = first_rows(entries, keys, order, quota, "entry_id", "_taken")
    return marked.filter("_taken").drop("_taken"), marked.filter(~F.col("_taken")).drop("_taken")


def evict_lowest(entries: DataFrame, quota: DataFrame, by: str = "tenant_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(evicted, kept, inflation): the n rows of lowest priority per tenant.

    An eviction does not change the priority of the others, so n evictions one by one are the
    lowest n at once; the inflation is the priority of the last one.
    """
    evicted, kept = _by_rank(entries, [by], [F.col("priority"), F.col("entry_id")], quota)
    return evicted, kept, evicted.groupBy(by).agg(F.max("priority").alias("inflation"))


def evict_lru(entries: DataFrame, quota: DataFrame, by: str = "tenant_id") -> tuple[DataFrame, DataFrame]:
    """(evicted, kept): the n least recently used rows per tenant."""
    return _by_rank(entries, [by], [F.col("last_access"), F.col("entry_id")], quota)


def eviction_stats(entries: DataFrame, inflation: float = 0.0) -> DataFrame:
    """Tracked entries and the spread of their priorities."""
    return entries.agg(
        F.count(F.lit(1)).alias("tracked_entries"),
        F.round(F.coalesce(F.min("priority"), F.lit(0.0)), 4).alias("min_priority"),
        F.round(F.coalesce(F.max("priority"), F.lit(0.0)), 4).alias("max_priority"),
        F.round(F.coalesce(F.avg("priority"), F.lit(0.0)), 4).alias("avg_priority"),
    ).withColumn("inflation_factor", F.round(F.lit(inflation), 4))


def priority_histogram(entries: DataFrame, width: float) -> DataFrame:
    return entries.groupBy(F.floor(F.col("priority") / F.lit(width)).cast("bigint").alias("bin")).agg(
        F.count(F.lit(1)).alias("entries")
    )


def window_size(capacity: int, fraction: float) -> int:
    return max(1, int(capacity * fraction))


#: Rows of an admission line: what the window held, a counted access, a request for admission.
HELD, ACCESS, ASKS = 0, 1, 2


def admission_shard(bucket: Column, shards: int) -> Column:
    """Shard of a bucket, the same for all rows of a bucket."""
    return F.coalesce(F.conv(F.substring(F.md5(bucket.cast("string").cast("binary")), 1, 4), 16, 10).cast("int") % shards, F.lit(0))


def admission_gate(
    candidates: DataFrame,
    window: DataFrame,
    frequencies: DataFrame,
    size: int,
    by: str = "tenant_id",
    shards: int = 1,
    accesses: DataFrame | None = None,
) -> DataFrame:
    """Candidates with new_frequency, victim_id, victim_frequency, admitted and holder_id, one by one.

    Every request first counts for its bucket.  While the window has free places it is admitted; after that
    it has to be seen at least as often, as of now, as the bucket of the oldest row of the window, which it
    then replaces.  A refused request leaves the same victim in front.  A request whose ``key`` was admitted
    before is no new one: ``holder_id`` names the row that answers it.

    Rows are dealt to ``shards`` chains per ``by`` by their bucket, each with its share of the window, so
    counts stay inside a chain; one shard is the plain rule.  A chain keeps its window, one count per bucket
    and one entry per admitted key; its rows stream through.

    ``candidates``: by, entry_id, seq, bucket and, optionally, key.  ``window``: by, entry_id, seq, bucket, all
    before the candidates whatever their seq.  ``frequencies``: bucket, frequency (before the candidates).
    ``accesses``: by, seq, bucket of further accesses among the candidates.  A null bucket is never counted.
    """
    kind = dict(candidates.dtypes)["entry_id"]
    key = F.col("key") if "key" in candidates.columns else F.col("entry_id")
    columns = lambda df, of, k: df.select(
        by, "entry_id", "seq", "bucket", F.lit(of).alias("kind"), k.cast("string").alias("key")
    )
    line = columns(window, HELD, F.lit(None)).unionByName(columns(candidates, ASKS, key))
    if accesses is not None:
        line = line.unionByName(columns(accesses.withColumn("entry_id", F.lit(None).cast(kind)), ACCESS, F.lit(None)))
    counted = spread_join(line, frequencies.select("bucket", "frequency"), ["bucket"], "left", "seq").select(
        by, admission_shard(F.col("bucket"), shards).alias("shard"), (F.col("kind") != HELD).alias("later"), "seq", "kind", "key",
        "entry_id", "bucket", F.coalesce("frequency", F.lit(0)).cast("bigint").alias("frequency"),
    )
    share = max(1, size // shards)

    def advance(state, rows, fresh):
        # State: window as a queue of (entry_id, bucket), counts by bucket, holders by key.
        out = []
        for i, (eid, bucket, known, kind, key) in enumerate(
            zip(rows["entry_id"], rows["bucket"], rows["frequency"], rows["kind"], rows["key"], strict=True)
        ):
            if fresh[i]:
                state = deque(), {}, {}
            held, counts, holders = state
            now = 0 if bucket is None else counts.get(bucket, known) + (kind != HELD)
            counts[bucket] = now
            if kind == ASKS:
                holder = holders.get(key)
                full = holder is None and len(held) >= share
                victim = held[0] if full else (None, None)
                worth = counts[victim[1]] if full else None
                admitted = holder is None and (not full or now >= worth)
                out.append((now, victim[0], worth, admitted, holder))
                if admitted:
                    holders[key] = eid
            if kind == HELD or (kind == ASKS and admitted):
                if len(held) >= share:
                    held.popleft()
                held.append((eid, bucket))
        asks = rows.loc[rows["kind"] == ASKS, [by, "entry_id", "seq", "bucket"]].reset_index(drop=True)
        added = pd.DataFrame(out, columns=["new_frequency", "victim_id", "victim_frequency", "admitted", "holder_id"], dtype=object)
        return state, pd.concat([asks, added], axis=1)

    types = dict(counted.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in (by, "entry_id", "seq", "bucket"))
    return ordered_scan(
        counted, [by, "shard"], ["later", "seq", "kind"], advance,
        f"{schema}, new_frequency bigint, victim_id {kind}, victim_frequency bigint, admitted boolean, holder_id {kind}",
    )


def admission_stats(decisions: DataFrame, by: str = "tenant_id") -> DataFrame:
    """Checks, admissions and refusals per tenant."""
    return decisions.groupBy(by).agg(
        F.count(F.lit(1)).alias("total_checks"),
        F.count_if("admitted").alias("total_admitted"),
        F.count_if(~F.col("admitted")).alias("total_rejected"),
        F.round(F.count_if("admitted") / F.greatest(F.count(F.lit(1)), F.lit(1)), 4).alias("admission_rate"),
    )


def segment_entries(entries: DataFrame, cfg: CacheConfig = DEFAULT, by: str = "tenant_id") -> DataFrame:
    """Label each entry window, probation or protected.

    The newest ``window_size`` rows by arrival form the window.  Of the rest, rows used after
    they had left it are protected, up to the protected share by recency; others are on probation.
    Expects ``used_since`` (was it accessed after leaving the window).
    """
    size = window_size(cfg.capacity, cfg.window_fraction)
    main = cfg.capacity - size
    protected = max(1, int(main * cfg.protected_fraction))
    placed = first_rows(entries, [by], [-F.col("seq"), F.col("entry_id")], size, "entry_id", "_window")
    used = placed.withColumn("_eligible", ~F.col("_window") & F.col("used_since"))
    recent = -F.unix_micros(F.col("last_access").cast("timestamp"))
    marked = first_rows(used, [by, "_eligible"], [recent, F.col("entry_id")], protected, "entry_id", "_recent")
    segment = (
        F.when(F.col("_window"), "window")
        .when(F.col("_eligible") & F.col("_recent"), "protected")
        .otherwise("probation")
    )
    return marked.select(*entries.columns, segment.alias("segment"))


def segment_sizes(segmented: DataFrame, by: str = "tenant_id") -> DataFrame:
    return segmented.groupBy(by, "segment").agg(F.count(F.lit(1)).alias("entries"))
