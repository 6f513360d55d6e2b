"""Run reports: one nested JSON document per benchmark run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STRATEGY = (
    "STRUCT<name: STRING, total_queries: INT, total_hits: INT, total_misses: INT, hit_rate: DOUBLE, "
    "precision: DOUBLE, f1_score: DOUBLE, avg_hit_latency_ms: DOUBLE, avg_miss_latency_ms: DOUBLE, "
    "avg_overall_latency_ms: DOUBLE, llm_calls: INT, correct_hits: INT, incorrect_hits: INT, "
    "tier1_hits: INT, tier2_hits: INT, total_time_s: DOUBLE>"
)
RUN = (
    "run_id STRING, timestamp DOUBLE, dataset STRING, num_questions INT, num_paraphrases INT, "
    f"cache_capacity INT, strategies ARRAY<{STRATEGY}>"
)
STRATEGY_FIELDS = [
    "name", "total_queries", "total_hits", "total_misses", "hit_rate", "precision", "f1_score",
    "avg_hit_latency_ms", "avg_miss_latency_ms", "avg_overall_latency_ms", "llm_calls", "correct_hits",
    "incorrect_hits", "tier1_hits", "tier2_hits", "total_time_s",
]
DEFAULT_DATASET = "nq"


def scan_run_reports(spark: SparkSession, path: str) -> DataFrame:
    """All readable reports, one row each; a broken file is left out."""
    schema = RUN + ", _broken STRING"
    raw = (
        spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_broken").json(path)
    )
    good = raw.filter(F.col("_broken").isNull() & F.col("run_id").isNotNull())
    return good.drop("_broken").withColumn("dataset", F.coalesce("dataset", F.lit(DEFAULT_DATASET)))


def report_summaries(runs: DataFrame) -> DataFrame:
    """The list of runs, newest first."""
    return runs.select(
        "run_id", "timestamp", "dataset", "num_questions", "num_paraphrases", "cache_capacity",
        F.size("strategies").alias("num_strategies"),
    ).orderBy(F.desc("timestamp"), "run_id")


def get_report(runs: DataFrame, run_id: str) -> DataFrame:
    return runs.filter(F.col("run_id") == run_id)


def strategy_rows(runs: DataFrame) -> DataFrame:
    """One row per run and strategy."""
    return runs.select(
        "run_id", "timestamp", "dataset", "cache_capacity", F.explode("strategies").alias("s")
    ).select("run_id", "timestamp", "dataset", "cache_capacity", F.col("s.name").alias("strategy"), *[
        f"s.{f}" for f in STRATEGY_FIELDS if f != "name"
    ])


def nest_strategies(runs: DataFrame, scores: DataFrame) -> DataFrame:
    """Run rows with their scorecards as one array each (a run has a handful of strategies)."""
    fields = [F.col("strategy").alias("name")] + [F.col(f) for f in STRATEGY_FIELDS if f != "name"]
    packed = scores.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("strategies"))
    return runs.join(packed, "run_id", "left")


def write_run_report(reports: DataFrame, path: str) -> None:
    """One JSON document per run, in a directory named by the run."""
    out = reports.withColumn("_dir", F.col("run_id"))
    out.write.mode("append").partitionBy("_dir").json(path)
