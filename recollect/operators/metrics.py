"""Counts, rates, distributions and running series over the query log.

``log`` carries query_id, seq, ts, hit, tier, similarity, threshold_used, latency_ms,
admission_rejected, eviction_triggered and the grouping columns asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.config import DEFAULT
from recollect.functions import text as T
from recollect.plans.materialize import checkpointed
from recollect.plans.quantiles import BLOCK_ROWS, exact_quantiles, row_blocks
from recollect.plans.running import by_width, highest, numbered, running, total, trailing_frames

HISTORY = 1000
BINS = 20
DIGITS = 9


def ratio(part: Column, whole: Column) -> Column:
    return part / F.greatest(whole, F.lit(1))


def last_rows(df: DataFrame, by: list[str], n: int) -> DataFrame:
    """Newest ``n`` rows per group; both forms cut inside each task first."""
    if not by:
        return df.orderBy(F.desc("seq")).limit(n)
    w = Window.partitionBy(*by).orderBy(F.desc("seq"))
    return df.withColumn("_age", F.row_number().over(w)).filter(F.col("_age") <= n).drop("_age")


def aggregate_metrics(
    log: DataFrame, judged: DataFrame, by: list[str] | None = None, history: int = HISTORY
) -> DataFrame:
    """Lifetime counts and rates; average latencies over the newest rows of each kind.

    ``judged`` holds was_correct and the grouping columns.
    """
    by = by or []
    keys = [*by, "_all"]
    log, judged = log.withColumn("_all", F.lit(0)), judged.withColumn("_all", F.lit(0))
    counts = log.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_queries"),
        F.count_if("hit").alias("total_hits"),
        F.count_if(F.col("hit") & (F.col("tier") == 1)).alias("tier1_hits"),
        F.count_if(F.col("hit") & (F.col("tier") == 2)).alias("tier2_hits"),
        F.count_if(~F.col("hit")).alias("total_misses"),
        F.count_if("eviction_triggered").alias("total_evictions"),
        F.count_if(~F.col("hit") & ~F.col("admission_rejected")).alias("total_admissions"),
        F.count_if("admission_rejected").alias("admission_rejections"),
    )
    out = counts.join(
        judged.groupBy(*keys).agg(
            F.count_if("was_correct").alias("correct_hits"), F.count_if(~F.col("was_correct")).alias("incorrect_hits")
        ),
        keys, "left",
    )
    kinds = {"avg_latency_ms": F.lit(True), "avg_hit_latency_ms": F.col("hit"), "avg_miss_latency_ms": ~F.col("hit")}
    for name, kind in kinds.items():
        newest = last_rows(log.filter(kind).select(*keys, "seq", "latency_ms"), by, history)
        out = out.join(newest.groupBy(*keys).agg(F.avg("latency_ms").alias(name)), keys, "left")
    counted = [c for c in counts.columns if c not in keys]
    good, bad = F.coalesce("correct_hits", F.lit(0)), F.coalesce("incorrect_hits", F.lit(0))
    return out.select(
        *by, *counted, good.alias("correct_hits"), bad.alias("incorrect_hits"),
        F.round(ratio(F.col("total_hits"), F.col("total_queries")), 4).alias("hit_rate"),
        F.round(ratio(F.col("tier1_hits"), F.col("total_hits")), 4).alias("tier1_rate"),
        F.round(ratio(F.col("tier2_hits"), F.col("total_hits")), 4).alias("tier2_rate"),
        F.round(ratio(bad, F.col("total_queries")), 4).alias("false_hit_rate"),
        F.round(ratio(good, good + bad), 4).alias("precision"),
        *[F.round(F.coalesce(n, F.lit(0.0)), DIGITS).alias(n) for n in kinds],
    )


def metrics_rollup(log: DataFrame, levels: list[str]) -> DataFrame:
    """Counts and hit rate for each level of ``levels`` and above."""
    return log.rollup(*levels).agg(
        F.count(F.lit(1)).alias("queries"),
        F.count_if("hit").alias("hits"),
        F.round(ratio(F.count_if("hit"), F.count(F.lit(1))), 4).alias("hit_rate"),
        F.round(F.avg("latency_ms"), DIGITS).alias("avg_latency_ms"),
    )


def latency_percentiles(log: DataFrame, by: list[str] | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """p50, p90, p95 and p99 of the latency, interpolated linearly."""
    points = {"p50": 0.50, "p90": 0.90, "p95": 0.95, "p99": 0.99}
    return exact_quantiles(log, by or [], "latency_ms", points, row_blocks(log, "latency_ms", block_rows))


#: Size of the quantile sketches and the rank error that goes with it, and of the distinct-count sketches.
SKETCH_K, SKETCH_ERROR = 400, 0.0133
DISTINCT_LG_K, DISTINCT_ERROR = 14, 0.025


def log_sketches(log: DataFrame, by: list[str], value: str = "latency_ms", key: str | None = None) -> DataFrame:
    """Stored form of a log: per group its rows, a quantile sketch of ``value`` and one of distinct ``key`` values.

    A sketch has a bounded size however many rows it has seen; sketches of any groups merge (``merged_quantiles``).
    """
    more = [] if key is None else [F.hll_sketch_agg(key, DISTINCT_LG_K).alias("keys")]
    values = F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(SKETCH_K))
    return log.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.count(value).alias("n"), values.alias("sketch"), *more)


def merged_quantiles(sketches: DataFrame, by: list[str], points: dict[str, float]) -> DataFrame:
    """Rows and quantiles per group from stored sketches, each within ``SKETCH_ERROR`` of its rank."""
    merged = sketches.filter("n > 0").groupBy(*by).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("_s"))
    return merged.select(*by, "n", *[F.kll_sketch_get_quantile_double("_s", F.lit(float(p))).alias(c) for c, p in points.items()])


def merged_distinct(sketches: DataFrame, by: list[str]) -> DataFrame:
    """Rows and about how many distinct keys per group, within ``DISTINCT_ERROR`` (three deviations)."""
    merged = sketches.groupBy(*by).agg(F.sum("rows").alias("rows"), F.hll_union_agg("keys").alias("_k"))
    return merged.select(*by, "rows", F.hll_sketch_estimate("_k").alias("distinct_keys"))


def similarity_histogram(log: DataFrame, bins: int = BINS) -> DataFrame:
    """Hits per equal bin on [0, 1]; the last bin is closed, empty bins are listed."""
    hits = log.filter(F.col("hit") & (F.col("similarity") > 0))
    binned = hits.groupBy(F.least(F.floor(F.col("similarity") * bins), F.lit(bins - 1)).alias("bin")).agg(
        F.count(F.lit(1)).alias("n")
    )
    spine = log.sparkSession.range(bins).withColumnRenamed("id", "bin")
    return spine.join(binned, "bin", "left").select(
        "bin", (F.col("bin") / bins).alias("lower"), F.coalesce("n", F.lit(0)).alias("hits")
    )


def threshold_distribution(log: DataFrame) -> DataFrame:
    """How often each (rounded) positive threshold was used."""
    used = log.filter(F.col("threshold_used") > 0)
    return used.groupBy(F.round("threshold_used", 4).alias("threshold")).agg(F.count(F.lit(1)).alias("uses"))


def llm_usage_rollup(calls: DataFrame) -> DataFrame:
    """Calls, tokens, cost, latency and retries per backend and model, with totals."""
    return calls.rollup("backend", "model").agg(
        F.count(F.lit(1)).alias("calls"),
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
        F.round(F.sum("cost_usd"), 6).alias("cost_usd"),
        F.round(F.avg("latency_ms"), DIGITS).alias("avg_latency_ms"),
        F.sum("retries").alias("retries"),
    )


def encode_stats(requests: DataFrame) -> DataFrame:
    """Texts actually encoded, requests served from the memo, mean time of an encoding."""
    once = requests.groupBy(T.memo_key(F.col("query_text")).alias("_k")).agg(
        F.count(F.lit(1)).alias("n"), F.min_by("encode_ms", "seq").alias("ms")
    )
    return once.agg(
        F.count(F.lit(1)).alias("encode_calls"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("memo_hits"),
        F.round(F.coalesce(F.avg("ms"), F.lit(0.0)), DIGITS).alias("avg_encode_ms"),
    )


def store_stats(entries: DataFrame, capacity: int = DEFAULT.capacity) -> DataFrame:
    """Entries, distinct exact keys and vectors per tenant, and the share of capacity used."""
    keyed = entries.withColumn("exact_key", T.exact_key(F.col("query_text"), F.col("tenant_id")))
    per_key = keyed.groupBy("tenant_id", "exact_key").agg(
        F.count(F.lit(1)).alias("n"), F.count("embedding").alias("v")
    )
    return per_key.groupBy("tenant_id").agg(
        F.sum("n").alias("entries"), F.count(F.lit(1)).alias("exact_keys"), F.sum("v").alias("vectors"),
        F.round(F.sum("n") / F.lit(capacity), 6).alias("used_share"),
    )


def strategy_scorecard(results: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Quality and latency per strategy from one row per answered query."""
    hit, good = F.count_if("hit"), F.count_if(F.col("hit") & F.col("correct"))
    counted = results.groupBy(*(by or ["strategy"])).agg(
        F.count(F.lit(1)).alias("total_queries"), hit.alias("total_hits"),
        F.count_if(~F.col("hit")).alias("total_misses"),
        F.count_if(F.col("hit") & (F.col("tier") == 1)).alias("tier1_hits"),
        F.count_if(F.col("hit") & (F.col("tier") == 2)).alias("tier2_hits"),
        good.alias("correct_hits"), (hit - good).alias("incorrect_hits"),
        F.avg(F.when(F.col("hit"), F.col("latency_ms"))).alias("_h"),
        F.avg(F.when(~F.col("hit"), F.col("latency_ms"))).alias("_m"),
        F.avg("latency_ms").alias("_o"),
    )
    precision = ratio(F.col("correct_hits"), F.col("total_hits"))
    recall = ratio(F.col("correct_hits"), F.col("total_queries"))
    f1 = F.lit(2.0) * precision * recall / F.greatest(precision + recall, F.lit(1e-9))
    return counted.select(
        *[c for c in counted.columns if not c.startswith("_")],
        F.col("total_misses").alias("llm_calls"),
        F.round(ratio(F.col("total_hits"), F.col("total_queries")), 4).alias("hit_rate"),
        F.round(precision, 4).alias("precision"), F.round(recall, 4).alias("recall"), F.round(f1, 4).alias("f1_score"),
        F.round(F.coalesce("_h", F.lit(0.0)), 2).alias("avg_hit_latency_ms"),
        F.round(F.coalesce("_m", F.lit(0.0)), 2).alias("avg_miss_latency_ms"),
        F.round(F.coalesce("_o", F.lit(0.0)), 2).alias("avg_overall_latency_ms"),
    )


def run_comparison(runs: DataFrame, metric: str, datasets: list[str]) -> DataFrame:
    """Strategy x dataset table of the mean of one metric."""
    return runs.groupBy("strategy").pivot("dataset", datasets).agg(F.round(F.avg(metric), 4))


def run_cube(results: DataFrame) -> DataFrame:
    """Hit rate for every combination of dataset, capacity and strategy, and all totals."""
    return results.cube("dataset", "cache_capacity", "strategy").agg(
        F.count(F.lit(1)).alias("queries"),
        F.round(ratio(F.count_if("hit"), F.count(F.lit(1))), 4).alias("hit_rate"),
    )


def savings_summary(
    compared: DataFrame, input_tokens: float = 0.0, output_tokens: float = 0.0,
    input_price: float = 0.0, output_price: float = 0.0,
) -> DataFrame:
    """Time, tokens, calls and money saved by the cache over asking directly."""
    per_call = (input_tokens * input_price + output_tokens * output_price) / 1000.0
    valid = F.when(F.col("direct_ms") > 0, F.col("speedup")).otherwise(0.0)
    return compared.agg(
        F.count(F.lit(1)).alias("queries"),
        F.round(F.sum("saved_ms"), 4).alias("saved_ms"),
        F.sum("saved_tokens").alias("saved_tokens"),
        F.round(F.sum(valid) / F.greatest(F.count(F.lit(1)), F.lit(1)), 4).alias("avg_speedup"),
        F.count_if("hit").alias("calls_saved"),
        F.round(F.count_if("hit") * F.lit(per_call), 6).alias("money_avoided"),
    )


def running_hit_rate(log: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Hit rate up to and including every query."""
    by = by or []
    out = running(
        log.select(*by, "query_id", "seq", "hit"), by, ["seq"], by_width("seq"),
        hits=total(F.col("hit").cast("bigint")), queries=total(F.lit(1).cast("bigint")),
    )
    return out.select(*by, "query_id", "seq", (F.col("hits") / F.col("queries")).alias("hit_rate"))


def rolling_latency(log: DataFrame, rows: int = HISTORY) -> DataFrame:
    """Mean latency of the last ``rows`` queries, and of the last ``rows`` with the same outcome."""
    base = log.select("query_id", "seq", "hit", "latency_ms")
    every = trailing_frames(
        numbered(base, [], ["seq"], by_width("seq"), "_n"), [], "_n", rows, avg_all=F.avg("latency_ms")
    ).drop("_n")
    return trailing_frames(
        numbered(every, ["hit"], ["seq"], by_width("seq"), "_n"), ["hit"], "_n", rows, avg_same=F.avg("latency_ms")
    ).select("query_id", "hit", "avg_all", "avg_same")


def access_profile(log: DataFrame, key: list[str]) -> DataFrame:
    """Running frequency, previous access and time since it, per key."""
    out = running(
        log.select(*key, "query_id", "seq", "ts"), key, ["seq"], by_width("seq"),
        frequency=total(F.lit(1).cast("bigint")), previous=highest(F.col("ts"), inclusive=False),
    )
    gap = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("previous").cast("timestamp"))) / 1e6
    return out.select(*key, "query_id", "frequency", F.col("previous").alias("last_access"), F.round(gap, 6).alias("gap_s"))


def failure_streaks(calls: DataFrame, by: list[str], threshold: int = DEFAULT.breaker_failures) -> DataFrame:
    """Consecutive failures up to each call; open where the streak reaches the threshold."""
    placed = numbered(calls.select(*by, "seq", "ok"), by, ["seq"], by_width("seq"), "_n")
    out = running(placed, by, ["seq"], by_width("seq"), _ok=highest(F.when(F.col("ok"), F.col("_n"))))
    streak = F.col("_n") - F.coalesce("_ok", F.lit(0))
    return out.select(*by, "seq", streak.alias("streak"), (streak >= threshold).alias("open"))


def frequency_as_of(requests: DataFrame, bucket: str) -> DataFrame:
    """Times a semantic bucket had been seen when each query arrived, itself included."""
    return running(requests, [bucket], ["seq"], by_width("seq"), frequency=total(F.lit(1).cast("bigint")))


def bucket_frequency(requests: DataFrame, bucket: str) -> DataFrame:
    return requests.groupBy(bucket).agg(F.count(F.lit(1)).alias("frequency"))


# Rows and slots of the frequency sketch.
SKETCH_DEPTH, SKETCH_WIDTH = 4, 4096


def sketch_slots(key: Column) -> Column:
    """One slot per sketch row by double hashing: (h1 + i x h2) mod width."""
    digest = F.md5(key)

    def word(at: int) -> Column:
        little_endian = F.concat(*[F.substring(digest, at + 2 * b, 2) for b in (3, 2, 1, 0)])
        return F.conv(little_endian, 16, 10).cast("bigint")

    return F.transform(
        F.sequence(F.lit(0), F.lit(SKETCH_DEPTH - 1)), lambda i: F.pmod(word(1) + i * word(9), F.lit(SKETCH_WIDTH))
    )


def sketch_counters(requests: DataFrame, key: str, epoch_rows: int | None = None) -> DataFrame:
    """The sketch as rows (row, slot, weight): at most depth x width of them, mergeable by sum.

    With ``epoch_rows`` older epochs count half as much per epoch passed.
    """
    weight = F.count(F.lit(1)).cast("double")
    spread = requests.select("seq", F.posexplode(sketch_slots(F.col(key))).alias("row", "slot"))
    if epoch_rows is None:
        return spread.groupBy("row", "slot").agg(weight.alias("weight"))
    epochs = spread.groupBy("row", "slot", by_width("seq", epoch_rows).alias("epoch")).agg(weight.alias("n"))
    last = requests.agg(F.max(by_width("seq", epoch_rows)).alias("e")).scalar()
    return epochs.groupBy("row", "slot").agg(F.sum(F.col("n") * F.pow(F.lit(0.5), last - F.col("epoch"))).alias("weight"))


def sketch_frequency(keys: DataFrame, key: str, counters: DataFrame) -> DataFrame:
    """Estimated frequency of each key: the least of its counters."""
    slots = keys.select(key).distinct().select(key, F.posexplode(sketch_slots(F.col(key))).alias("row", "slot"))
    return (
        slots.join(F.broadcast(counters), ["row", "slot"], "left")
        .groupBy(key).agg(F.min(F.coalesce("weight", F.lit(0.0))).alias("estimate"))
    )


RADIX = 16
#: Positions per window of the sums for distances: rows one task sorts with their counters, however long the log.
REUSE_WIDTH = 65_536


def reuse_distance(log: DataFrame, by: list[str], item: str, width: int = REUSE_WIDTH) -> DataFrame:
    """Distinct items used between two uses of an item, null at a first use.

    A least-recently-used cache of capacity c hits exactly where the distance is below c.
    Between the previous use p and position i lie i - p - 1 uses; those whose own previous use
    also lies after p are repeats.  Repeats are a dominance count, done digit by digit of the
    position: two positions split at one digit, so for each digit the uses with a smaller digit
    below the same prefix are counted along descending previous use with running sums.
    """
    base = log.select(*by, F.col(item).alias("_item"), "seq")
    placed = numbered(base, by, ["seq"], by_width("seq", width), "_x")
    # Written once (a few narrow columns): it is read three times below.
    linked = checkpointed(
        running(placed, [*by, "_item"], ["seq"], by_width("seq", width), _p=highest(F.col("_x"), inclusive=False))
    )
    again = linked.filter(F.col("_p").isNotNull())
    rows = log.agg(F.count(F.lit(1)).alias("n")).scalar()
    top = F.ceil(F.log(rows + 2) / F.log(F.lit(float(RADIX)))).cast("int") - 1
    scale = F.pow(F.lit(RADIX), F.col("_level")).cast("bigint")
    digits = (
        again.select(*by, "seq", "_x", "_p", F.explode(F.sequence(F.lit(0), F.greatest(top, F.lit(0)))).alias("_level"))
        .withColumn("_digit", F.floor(F.col("_x") / scale) % RADIX)
        .withColumn("_prefix", F.floor(F.col("_x") / (scale * RADIX)))
        .withColumn("_down", -F.col("_p"))
    )
    seen = running(
        digits, [*by, "_level", "_prefix"], ["_down"], by_width("_down", width),
        **{f"_c{d}": total((F.col("_digit") == d).cast("bigint"), inclusive=False) for d in range(RADIX - 1)},
    )
    smaller = sum(
        (F.when(F.col("_digit") > d, F.col(f"_c{d}")).otherwise(0) for d in range(RADIX - 1)), F.lit(0)
    )
    repeats = seen.groupBy("seq").agg(F.sum(smaller).alias("_repeats"))
    out = linked.join(repeats, "seq", "left")
    distance = F.col("_x") - F.col("_p") - 1 - F.col("_repeats")
    return out.select(*by, "seq", F.col("_item").alias(item), distance.alias("distance"))


def miss_ratio_curve(distances: DataFrame, by: list[str], capacities: list[int]) -> DataFrame:
    """Miss ratio of a least-recently-used cache for each capacity asked for."""
    agg = distances.groupBy(*by).agg(
        F.count(F.lit(1)).alias("uses"),
        *[F.count_if(F.col("distance") < c).alias(f"_h{c}") for c in capacities],
    )
    curve = F.explode(F.array(*[
        F.struct(F.lit(c).alias("capacity"), F.round(1 - F.col(f"_h{c}") / F.col("uses"), 6).alias("miss_ratio"))
        for c in capacities
    ]))
    return agg.select(*by, "uses", curve.alias("_c")).select(*by, "uses", "_c.*")
