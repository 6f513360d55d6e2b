"""Running aggregates per key that never put a whole key into one task.

A plain ``Window.partitionBy(key)`` sends every row of a key to one task, so a key that holds
a third of the table stalls the job.  Here the order of a key is cut into blocks of bounded
width: each (key, block) is a window of its own, block totals are summed up over the blocks
of a key (one small row per block), and the carry is joined back on (key, block).
A null is a key like any other.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_WIDTH = 1_000_000
CHUNK_ROWS = 50_000

_FOLD = {"sum": F.sum, "max": F.max, "min": F.min}


@dataclass(frozen=True)
class Running:
    """One running aggregate; ``inclusive`` tells whether the current row counts."""

    kind: str
    value: Column
    inclusive: bool = True


def total(value: Column, inclusive: bool = True) -> Running:
    return Running("sum", value, inclusive)


def highest(value: Column, inclusive: bool = True) -> Running:
    return Running("max", value, inclusive)


def by_width(col: str | Column, width: int = BLOCK_WIDTH) -> Column:
    """Block number of an integral, unique order column: at most ``width`` rows per block."""
    col = F.col(col) if isinstance(col, str) else col
    return F.floor(col / F.lit(width)).cast("bigint")


def running(
    df: DataFrame, keys: list[str], order: list[str], block: Column, **aggs: Running
) -> DataFrame:
    """Add one column per aggregate, running along ``order`` within ``keys``.

    ``block`` must not decrease along ``order``; it bounds the rows one task sorts.
    """
    src = df.withColumn("_block", block)
    scope = [*keys, "_block"]
    local = Window.partitionBy(*scope).orderBy(*order)
    carry_over = (
        Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    )
    totals = src.groupBy(*scope).agg(
        *[_FOLD[a.kind](a.value).alias(f"_total_{n}") for n, a in aggs.items()]
    )
    carry = totals.select(
        *scope,
        *[_FOLD[a.kind](f"_total_{n}").over(carry_over).alias(f"_carry_{n}") for n, a in aggs.items()],
    )
    rows = src.select(
        "*",
        *[
            _FOLD[a.kind](a.value)
            .over(local.rowsBetween(Window.unboundedPreceding, 0 if a.inclusive else -1))
            .alias(f"_local_{n}")
            for n, a in aggs.items()
        ],
    )
    carry = carry.select(*[F.col(c).alias(f"_of_{c}") for c in scope], *[f"_carry_{n}" for n in aggs])
    same = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys] + [F.col("_block") == F.col("_of__block")]
    joined = rows.join(carry, same, "left")
    merged = []
    for n, a in aggs.items():
        here, before = F.col(f"_local_{n}"), F.col(f"_carry_{n}")
        if a.kind == "sum":
            both = F.coalesce(before, F.lit(0)) + F.coalesce(here, F.lit(0))
        else:
            both = (F.greatest if a.kind == "max" else F.least)(before, here)
        merged.append(both.alias(n))
    return joined.select(*df.columns, *merged)


def numbered(
    df: DataFrame, keys: list[str], order: list[str], block: Column, name: str = "rn"
) -> DataFrame:
    """Exact 1-based row number within ``keys``."""
    return running(df, keys, order, block, **{name: total(F.lit(1).cast("bigint"))})


def trailing_frames(
    df: DataFrame, keys: list[str], position: str, rows: int, **exprs
) -> DataFrame:
    """Aggregates over the last ``rows`` rows (current one included) within ``keys``.

    ``position`` is an exact row number.  A key is cut into chunks; the last ``rows - 1`` rows
    of a chunk are also sent to the next chunk, so every frame is whole inside one chunk.
    """
    size = max(CHUNK_ROWS, rows)
    at = F.col(position) - 1
    chunk = F.floor(at / size).cast("bigint")
    overlaps = at % size >= size - (rows - 1)
    copies = df.withColumn(
        "_copy", F.explode(F.when(overlaps, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    ).withColumn("_chunk", chunk + F.col("_copy"))
    frame = (
        Window.partitionBy(*keys, "_chunk").orderBy(position).rowsBetween(-(rows - 1), 0)
    )
    return (
        copies.select("*", *[e.over(frame).alias(n) for n, e in exprs.items()])
        .filter(F.col("_copy") == 0)
        .drop("_copy", "_chunk")
    )
