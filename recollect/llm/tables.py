"""Reading tables and rows that keep their own columns apart from the operators' helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def narrow(df: DataFrame, **columns: str | Column) -> DataFrame:
    """Only the named columns, under fixed names: other columns of ``df`` cannot clash with helpers."""
    return df.select(*[(df[c] if isinstance(c, str) else c).alias(n) for n, c in columns.items()])


def if_small(df: DataFrame, rows: int) -> DataFrame:
    """Ask for a broadcast where ``df`` was counted and has at most ``rows`` rows, else leave the join to Spark."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only.  ``lower`` does just that where a string is pure ASCII, and is much faster."""
    upper = "".join(map(chr, range(65, 91)))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, upper, upper.lower())
    )


def carried(df: DataFrame, *outputs: str) -> list[str]:
    """Columns of ``df`` that an operator passes on: those whose names its own outputs do not take."""
    taken = {o.lower() for o in outputs}
    return [c for c in df.columns if c.lower() not in taken]


def in_sample(turn: Column, rows: int, wanted: int) -> Column:
    """Whether a row's hash puts it among a few more than ``wanted`` of ``rows`` rows, so that few rows are sorted for a sample."""
    share = min(1.0, (1.1 * wanted + 100) / max(1, rows))
    return F.pmod(F.shiftright(turn, 20), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)) + 1)
