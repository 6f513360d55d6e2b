"""Exact ranks over any sort order, ties and hot keys included."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.plans.materialize import checkpointed
from recollect.plans.running import numbered
from recollect.plans.spread import spread_join


def ranked(df: DataFrame, keys: list[str], order: list, name: str = "rank") -> DataFrame:
    """Add the 1-based rank of each row within ``keys`` along ``order`` (a strict order).

    One range-partitioned sort, written once so that row places are fixed; a key wider than
    one sorted partition is numbered partition by partition with a carried offset.
    """
    placed = checkpointed(
        df.orderBy(*keys, *order).withColumn("_place", F.monotonically_increasing_id())
    )
    partition = F.shiftright("_place", 33)
    return numbered(placed, keys, ["_place"], partition, name).drop("_place")


def first_rows(
    df: DataFrame, keys: list[str], order: list[Column], quota: DataFrame | int, row_id: str, name: str = "taken"
) -> DataFrame:
    """Mark the first n rows of each key along ascending ``order`` (a strict order).

    ``quota`` is one n for all keys or a table (keys, n).  Only the sort columns are ranked and
    written; the place of the n-th row then decides for the wide rows by comparison.
    """
    at = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    placed = ranked(df.select(*keys, at.alias("_at")), keys, ["_at"], "_rank")
    if isinstance(quota, int):
        counted = placed.filter(F.col("_rank") <= quota)
    else:
        counted = spread_join(placed, quota.select(*keys, "n"), keys, "inner", "_at").filter(F.col("_rank") <= F.col("n"))
    cut = counted.groupBy(*keys).agg(F.max("_at").alias("_cut"))
    joined = spread_join(df, cut, keys, "left", row_id)
    return joined.withColumn(name, F.coalesce(at <= F.col("_cut"), F.lit(False))).drop("_cut")
