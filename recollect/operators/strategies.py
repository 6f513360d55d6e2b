"""Compare cache configurations on one workload: train rows are stored, probe rows ask."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.config import DEFAULT, CacheConfig
from recollect.functions import text as T
from recollect.functions import vectors as V
from recollect.operators import calibration as C
from recollect.operators import lookup as L
from recollect.operators import metrics as M
from recollect.operators import retention as R
from recollect.plans.materialize import checkpointed
from recollect.plans.spread import spread_join


@dataclass(frozen=True)
class Strategy:
    """A configuration: which rows stay, and how a probe is matched.

    ``match(probe, entries, shared)`` gives (query_id, tier, entry_id, similarity); ``shared``
    holds what several strategies use.  ``keep`` is 'recent' or 'priority'.
    """

    name: str
    keep: str
    match: Callable[[DataFrame, DataFrame, dict], DataFrame]


def _exact_only(probe, entries, shared):
    none = "query_id {0}, entry_id {1}, similarity double".format(
        dict(probe.dtypes)["query_id"], dict(entries.dtypes)["entry_id"]
    )
    return L.after_exact(probe, entries, probe.sparkSession.createDataFrame([], none))


def _static(tau: float):
    return lambda probe, entries, shared: L.static_threshold_match(probe, entries, tau)


def _adaptive(dim: int, target: int):
    return lambda probe, entries, shared: L.adaptive_threshold_match(probe, entries, shared["global"], dim, target)


def _per_entry(default: float):
    return lambda probe, entries, shared: L.entry_threshold_match(probe, entries, shared["entry"], default)


def _full(cfg: CacheConfig):
    def match(probe, entries, shared):
        return L.two_tier_lookup(probe, entries, shared["conformal"], None, cfg).select(
            "query_id", "tier", "entry_id", "similarity"
        )

    return match


def standard_strategies(
    dim: int, target: int = 128, low: float = 0.75, high: float = 0.85, default: float = 0.80, cfg: CacheConfig = DEFAULT
) -> list[Strategy]:
    return [
        Strategy("exact", "recent", _exact_only),
        Strategy("static_low", "recent", _static(low)),
        Strategy("adaptive_projection", "recent", _adaptive(dim, target)),
        Strategy("per_entry", "recent", _per_entry(default)),
        Strategy("static_high_priority", "priority", _static(high)),
        Strategy("per_entry_priority", "priority", _per_entry(default)),
        Strategy("full", "priority", _full(cfg)),
    ]


def _stored(train: DataFrame, keep: str, capacity: int) -> DataFrame:
    """One entry per key, cut to the capacity by recency or by priority."""
    key = T.normalize_light(F.col("query_text"))
    first = train.withColumn("_k", F.sha2(key, 256)).groupBy("_k").agg(
        F.min_by(F.struct(*train.columns), "seq").alias("_r"), F.count(F.lit(1)).alias("frequency"), F.max("seq").alias("last")
    )
    rows = first.select("_r.*", "frequency", "last").withColumn("entry_id", F.col("query_id")).withColumn("_all", F.lit(0))
    if keep == "recent":
        order = [-F.col("last"), F.col("entry_id")]
    else:
        # Money per millisecond of answer time and the cost of one encoding.
        priced = rows.withColumn("llm_cost_usd", F.col("latency_ms") * 0.00001).withColumn("embed_cost_ms", F.lit(5.0))
        sized = priced.withColumn("storage_bytes", F.octet_length("answer"))
        rows = R.with_priority(sized, extra_ms=50.0)
        order = [-F.col("priority"), F.col("entry_id")]
    kept = R.first_rows(rows, ["_all"], order, capacity, "entry_id", "_in").filter("_in")
    return kept.select(*train.columns, "entry_id")


def _judged(matches: DataFrame, queries: DataFrame, entries: DataFrame, check) -> DataFrame:
    """Matches with was_correct and the seq of the query."""
    q = queries.select("query_id", F.col("answer").alias("_want"), "seq", "latency_ms")
    e = entries.select("entry_id", F.col("answer").alias("_have"))
    with_q = matches.join(q, "query_id")
    both = spread_join(with_q, e, ["entry_id"], "left", "query_id")
    return both.withColumn("was_correct", F.coalesce(check(F.col("_want"), F.col("_have")), F.lit(False)))


def compare_strategies(
    workload: DataFrame,
    dim: int,
    train_share: float = 0.5,
    capacity: int = DEFAULT.capacity,
    seed: int = 42,
    target: int = 128,
    strategies: list[Strategy] | None = None,
    default: float = 0.80,
    initial: float = 0.82,
    floor: float = 0.65,
    limits: tuple[float, float] = (0.60, 0.99),
    cfg: CacheConfig = DEFAULT,
    hit_ms: float = 0.0,
) -> DataFrame:
    """Scorecard per strategy.

    ``workload``: query_id, seq, tenant_id, query_text, embedding, answer, latency_ms.  Rows whose
    seeded hash falls below ``train_share`` are stored, all others probe that snapshot.
    Thresholds are learned from the train rows matched with earlier train rows, so they stand
    still while probing.
    """
    in_train = T.seeded_hash(seed, F.col("query_id")) < F.lit(int(train_share * 2**32))
    marked = checkpointed(workload.withColumn("_train", in_train))
    train, probe = marked.filter("_train").drop("_train"), marked.filter(~F.col("_train")).drop("_train")
    earlier = train.withColumn("entry_id", F.col("query_id"))

    def low(df: DataFrame) -> DataFrame:
        known = df.filter(F.col("embedding").isNotNull())
        return known.withColumn("embedding", V.projected(F.col("embedding"), dim, target).cast("array<float>"))

    train_hits = checkpointed(L.causal_match(train, earlier, default))
    low_hits = L.causal_match(low(train), low(earlier), initial).join(train.select("query_id", "seq"), "query_id")
    overlap = _judged(train_hits, train, earlier, T.word_overlap_match)
    answered = _judged(train_hits, train, earlier, T.answer_match)
    learned = C.learned_global_threshold(low_hits, floor=floor, initial=initial)
    shared = {
        "global": F.lit(learned.head()[0]),  # one number
        "entry": checkpointed(C.vcache_thresholds(overlap, default, low=limits[0], high=limits[1])),
        "conformal": checkpointed(C.conformal_thresholds(answered, cfg)),
    }
    kept = {k: checkpointed(_stored(train, k, capacity)) for k in ("recent", "priority")}
    results = []
    for s in strategies or standard_strategies(dim, target, default=default, cfg=cfg):
        entries = kept[s.keep]
        found = _judged(s.match(probe, entries, shared), probe, entries, T.answer_match)
        hit = F.col("tier") > 0
        results.append(found.select(
            F.lit(s.name).alias("strategy"), "query_id", hit.alias("hit"), "tier", "similarity",
            (hit & F.col("was_correct")).alias("correct"),
            F.when(hit, F.lit(hit_ms)).otherwise(F.col("latency_ms")).alias("latency_ms"),
        ))
    return M.strategy_scorecard(reduce(DataFrame.unionByName, results))
