"""Exact interpolated quantiles without holding a group in one task."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.plans.running import running, total
from recollect.plans.spread import spread_join


BLOCK_ROWS = 1_000_000
#: Quantiles that are asked for together with the number of rows.
GRID = 512


def row_blocks(df: DataFrame, value: str, rows: int = BLOCK_ROWS) -> Column:
    """Blocks of about ``rows`` rows each along ``value``, cut at approximate quantiles.

    Rows and quantiles come from one pass; only more than ``GRID`` blocks take another.
    """
    grid = [i / GRID for i in range(1, GRID)]
    count, found = df.agg(F.count(F.lit(1)), F.percentile_approx(value, grid)).first()
    blocks = math.ceil(count / rows)
    if blocks <= 1 or not found:
        return F.lit(0).cast("bigint")
    if blocks <= GRID:
        cuts = [found[i * GRID // blocks - 1] for i in range(1, blocks)]
    else:
        shares = [i / blocks for i in range(1, blocks)]
        cuts = df.agg(F.percentile_approx(value, shares, max(10_000, 20 * blocks))).first()[0]
    return cuts_below(F.col(value), sorted(set(cuts)))


def cuts_below(value: Column, cuts: list) -> Column:
    """How many of the sorted ``cuts`` lie below ``value``: first among every w-th, then among the w that follow the last of those."""
    width = math.isqrt(len(cuts) - 1) + 1
    chunks = [cuts[i : i + width] for i in range(0, len(cuts), width)]

    def below(some: Column) -> Column:
        return F.size(F.filter(some, lambda c: c < value))

    chunk = below(F.array(*[F.lit(c[0]) for c in chunks])) - 1
    inside = below(F.get(F.array(*[F.array(*map(F.lit, c)) for c in chunks]), chunk))
    return F.when(chunk >= 0, chunk * width + inside).otherwise(0).cast("bigint")


def exact_quantiles(
    df: DataFrame, keys: list[str], value: str, points: dict[str, float], block: Column
) -> DataFrame:
    """One row per key with a linearly interpolated quantile per named point.

    Equal values are counted before the shuffle; ``block`` is a monotone function of ``value``.
    """
    counts = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, value)
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    cum = running(counts, keys, [value], block, _upto=total(F.col("_n")))
    sizes = counts.groupBy(*keys).agg(F.sum("_n").alias("_size"))
    if keys:
        cum = spread_join(cum, sizes, keys, "inner", value)
    else:
        cum = cum.withColumn("_size", sizes.scalar())
    first, last = F.col("_upto") - F.col("_n"), F.col("_upto") - 1

    def holds(rank: Column) -> Column:
        return (rank >= first) & (rank <= last)

    parts = []
    for name, p in points.items():
        at = (F.col("_size") - 1) * F.lit(float(p))
        low, high = F.floor(at), F.ceil(at)
        parts += [
            F.max(F.when(holds(low), F.col(value))).alias(f"_lo_{name}"),
            F.max(F.when(holds(high), F.col(value))).alias(f"_hi_{name}"),
            F.max(at - low).alias(f"_w_{name}"),
        ]
    picked = cum.groupBy(*keys).agg(*parts)
    return picked.select(
        *keys,
        *[
            (F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_w_{n}")).alias(n)
            for n in points
        ],
    )
