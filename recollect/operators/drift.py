"""Change tests on reward series, as one set-based scan per key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.config import DEFAULT
from recollect.plans.running import by_width, running, total
from recollect.plans.spread import spread_join

# Least rows on each side of a split and in the whole series.
SIDE, WHOLE = 10, 20


def drift_scan(series: DataFrame, keys: list[str], delta: float = DEFAULT.drift_delta) -> DataFrame:
    """Earliest split where the means of both sides differ by more than the bound, per key.

    Also the largest margin (difference minus bound), so that a quiet series shows how close
    it came.  Larger ``delta`` is more sensitive.
    """
    rows = running(
        series.select(*keys, "seq", "reward"), keys, ["seq"], by_width("seq"),
        l=total(F.lit(1).cast("bigint")), left_sum=total(F.col("reward")),
    )
    whole = series.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("reward").alias("total"))
    r = F.col("n") - F.col("l")
    at = spread_join(rows, whole, keys, "inner", "seq").filter(
        (F.col("n") >= WHOLE) & (F.col("l") >= SIDE) & (r >= SIDE)
    )
    gap = F.abs(F.col("left_sum") / F.col("l") - (F.col("total") - F.col("left_sum")) / r)
    bound = F.sqrt(F.lit(0.5) * (F.lit(1.0) / F.col("l") + F.lit(1.0) / r) * F.log(F.lit(4.0) * F.col("n") / F.lit(delta)))
    margin = gap - bound
    return at.groupBy(*keys).agg(
        F.max("n").alias("n"),
        F.min(F.when(margin >= 0, F.col("l"))).alias("first_split"),
        F.max(margin).alias("max_margin"),
    )
