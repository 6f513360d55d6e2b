"""Equi-joins whose left side may hold a third of its rows under one key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_ROWS = 1_000_000


def hot_keys(df: DataFrame, keys: list[str], limit: int, row_id: str) -> DataFrame:
    """Keys with more than about ``limit`` rows and the number of parts to cut them into.

    Sizes are estimated from the rows whose ``row_id`` hashes into a fixed share, so that a
    costly key expression is not evaluated twice over; the estimate decides how work is spread,
    never which rows take part.  At most rows / limit keys can qualify.
    """
    share = max(1, min(64, limit // 512))
    probe = df if share == 1 else df.filter(F.pmod(F.xxhash64(row_id), F.lit(share)) == 0)
    rows = F.col("_rows") * share
    return (
        probe.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .filter(rows > limit)
        .select(*keys, F.ceil(rows / limit).cast("int").alias("_parts"))
    )


def spread_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    how: str,
    row_id: str,
    limit: int = HOT_ROWS,
) -> DataFrame:
    """Join on ``keys``; rows of a hot left key go to several tasks by a hash of ``row_id``.

    Right rows of hot keys are repeated once per part, all others stay single.
    """
    hot = hot_keys(left, keys, limit, row_id)  # adaptive execution broadcasts it where it is small
    parts = F.coalesce(F.col("_parts"), F.lit(1))
    salted_left = left.join(hot, keys, "left").withColumn(
        "_salt", F.pmod(F.xxhash64(row_id), parts).cast("int")
    ).drop("_parts")
    salted_right = right.join(hot, keys, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), parts - 1))
    ).drop("_parts")
    return salted_left.join(salted_right, [*keys, "_salt"], how).drop("_salt")
