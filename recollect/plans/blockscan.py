"""Sequential rules over keys of any size: blocks become maps, maps are composed, blocks are entered with their state.

A rule that goes through the rows of a key one by one needs the state its predecessor left.  What a block of rows does
to *every* state it may be entered with is a map; maps of neighbouring blocks compose to one map.  So a key with many
rows is cut into blocks, blocks are mapped in parallel, composed in groups of ``FAN`` level by level until a key is one
group, and the states go back down the same way.  Then every block is run in parallel from the state it is entered
with.  No task sees more than a block of rows or ``FAN`` maps, also where all rows have one key; keys with few rows are
run as they are.

Maps and states are arrays of whole numbers; times are microseconds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.plans.materialize import stored
from recollect.plans.ordered import new_keys, ordered_scan

#: Rows per block, and maps that one task composes.
WIDTH, FAN = 100_000, 256

Numbers = list[int]


@dataclass(frozen=True)
class Rule:
    """A sequential rule: the map of a block, maps in a row, a map applied to a state, and the rows themselves.

    ``mapped(rows)`` takes the columns of one block in order.  ``run(state, rows, entered)`` goes through rows of one
    or more blocks: where ``entered`` has a state, a block begins with it.  It returns the state after the last row and
    the output columns.  The state before the first row of a key is ``start``.
    """

    start: Numbers
    mapped: Callable[[pd.DataFrame], Numbers]
    composed: Callable[[Numbers, Numbers], Numbers]
    applied: Callable[[Numbers, Numbers], Numbers]
    run: Callable[[Numbers, pd.DataFrame, list], tuple[Numbers, dict[str, list]]]

    def rows(self, state: Numbers, rows: pd.DataFrame) -> dict[str, list]:
        """Output columns of rows that follow ``state``."""
        return self.run(state, rows, [None] * len(rows))[1]


def micros(ts: str | Column = "ts") -> Column:
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


def _blocks(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[pd.DataFrame, list[int]]]:
    """Rows of whole blocks from batches sorted by ``keys``, and where each block begins, with the end.

    Boundaries are found for a batch at once: blocks may be small and very many.
    """
    held: list[pd.DataFrame] = []
    for batch in batches:
        if batch.empty:
            continue
        fresh = new_keys(batch[keys])
        fresh[0] = bool(held) and new_keys(pd.concat([held[-1].iloc[-1:], batch.iloc[:1]])[keys])[1]
        starts = np.flatnonzero(fresh)
        if len(starts):
            held.append(batch.iloc[: starts[-1]])
            yield _bounded(held, keys)
            held = [batch.iloc[starts[-1] :]]
        else:
            held.append(batch)
    if held:
        yield _bounded(held, keys)


def _bounded(held: list[pd.DataFrame], keys: list[str]) -> tuple[pd.DataFrame, list[int]]:
    rows = pd.concat(held, ignore_index=True) if len(held) > 1 else held[0].reset_index(drop=True)
    fresh = new_keys(rows[keys])
    fresh[0] = True
    return rows, [*np.flatnonzero(fresh).tolist(), len(rows)]


def _sorted(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return df.repartition(*keys).sortWithinPartitions(*keys, *order)


def entry_states(maps: DataFrame, keys: list[str], rule: Rule, fan: int = FAN) -> DataFrame:
    """(keys, _block, _state): the state each block is entered with, from ``maps`` (keys, _block, _map)."""
    types = ", ".join(f"`{k}` {dict(maps.dtypes)[k]}" for k in keys)
    up = F.floor(F.col("_block") / fan).cast("bigint")

    def together(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, bounds in _blocks(batches, [*keys, "_group"]):
            maps, found = rows["_map"].tolist(), []
            for lo, hi in pairwise(bounds):
                whole = [int(x) for x in maps[lo]]
                for more in maps[lo + 1 : hi]:
                    whole = rule.composed(whole, [int(x) for x in more])
                found.append(whole)
            out = rows.iloc[bounds[:-1]][[*keys, "_group"]].rename(columns={"_group": "_block"})
            out["_map"] = found
            yield out

    levels = [stored(maps, "maps")]
    while levels[-1].groupBy(*keys).agg(F.countDistinct(up).alias("n")).filter("n > 1").limit(1).count():
        grouped = _sorted(levels[-1].withColumn("_group", up), [*keys, "_group"], ["_block"])
        levels.append(stored(grouped.mapInPandas(together, f"{types}, _block bigint, _map array<bigint>"), "maps"))

    def inside(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, bounds in _blocks(batches, [*keys, "_group"]):
            maps, enters, states = rows["_map"].tolist(), rows["_enter"].tolist(), []
            for lo, hi in pairwise(bounds):
                state = rule.start if enters[lo] is None else [int(x) for x in enters[lo]]
                for step in maps[lo:hi]:
                    states.append(state)
                    state = rule.applied([int(x) for x in step], state)
            out = rows[[*keys, "_block"]].copy()
            out["_state"] = states
            yield out

    states = None
    for level in reversed(levels):
        grouped = level.withColumn("_group", up)
        if states is None:
            grouped = grouped.withColumn("_enter", F.lit(None).cast("array<bigint>"))
        else:
            above = states.select(*[F.col(k).alias(f"_of_{k}") for k in keys], F.col("_block").alias("_above"), F.col("_state").alias("_enter"))
            grouped = grouped.join(above, [*_null_safe(keys), F.col("_group") == F.col("_above")], "left").drop("_above", *[f"_of_{k}" for k in keys])
        states = stored(_sorted(grouped, [*keys, "_group"], ["_block"]).mapInPandas(inside, f"{types}, _block bigint, _state array<bigint>"), "states")
    return states


def _null_safe(keys: list[str]) -> list[Column]:
    return [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys]


def with_blocks(df: DataFrame, keys: list[str], width: int) -> DataFrame | None:
    """Add ``_block``: keys with more than ``width`` rows are cut by their range of seq into about that many rows, others are block 0.

    ``_cut`` tells which keys were cut; there are at most rows / width of them.  None where there are no such keys.
    """
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("seq").alias("_low"), F.max("seq").alias("_high")).filter(F.col("_n") > width)
    sizes = stored(sizes.select(*[F.col(k).alias(f"_of_{k}") for k in keys], F.ceil(F.col("_n") / width).alias("_parts"), "_low", "_high"), "large")
    if sizes.isEmpty():
        return None
    joined = df.join(sizes, _null_safe(keys), "left").drop(*[f"_of_{k}" for k in keys])
    share = (F.col("seq") - F.col("_low")) / (F.col("_high") - F.col("_low") + 1)
    block = F.when(F.col("_parts").isNotNull(), F.floor(share * F.col("_parts"))).otherwise(0).cast("bigint")
    return joined.select(*df.columns, block.alias("_block"), F.col("_parts").isNotNull().alias("_cut"))


def _entered(src: DataFrame, keys: list[str], rule: Rule, fan: int) -> DataFrame:
    """Rows with the state their block is entered with; null where their key was not cut."""
    named = ", ".join(f"`{k}` {dict(src.dtypes)[k]}" for k in keys)

    def to_maps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, bounds in _blocks(batches, [*keys, "_block"]):
            out = rows.iloc[bounds[:-1]][[*keys, "_block"]].copy()
            out["_map"] = [rule.mapped(rows.iloc[lo:hi]) for lo, hi in pairwise(bounds)]
            yield out

    placed = _sorted(src.filter("_cut"), [*keys, "_block"], ["seq"])
    states = entry_states(placed.mapInPandas(to_maps, f"{named}, _block bigint, _map array<bigint>"), keys, rule, fan)
    entered = states.select(*[F.col(k).alias(f"_of_{k}") for k in keys], F.col("_block").alias("_at"), "_state")
    joined = src.join(entered, [*_null_safe(keys), F.col("_block") == F.col("_at")], "left")
    return joined.drop("_at", "_cut", *[f"_of_{k}" for k in keys])


def block_scan(df: DataFrame, keys: list[str], rule: Rule, keep: list[str], added: str, width: int = WIDTH, fan: int = FAN) -> DataFrame:
    """Columns ``keep`` and those of the rule (``added``) for each row of ``df`` in order of seq within ``keys``.

    ``seq`` is whole and unique within a key; ``df`` has the columns the rule reads.
    """
    types = dict(df.dtypes)
    src = with_blocks(df, keys, width)
    if src is None:
        entered = df.withColumns({"_block": F.lit(0).cast("bigint"), "_state": F.lit(None).cast("array<bigint>")})
    else:
        entered = _entered(src, keys, rule, fan)

    def advance(state: Numbers | None, rows: pd.DataFrame, fresh: np.ndarray):
        entered, states = [None] * len(rows), rows["_state"].tolist()
        for i in np.flatnonzero(fresh).tolist():
            own = states[i]
            entered[i] = rule.start if own is None else [int(x) for x in own]
        state, columns = rule.run(rule.start if state is None else state, rows, entered)
        return state, rows[keep].assign(**columns)

    schema = ", ".join(f"`{c}` {types[c]}" for c in keep) + ", " + added
    return ordered_scan(entered, [*keys, "_block"], ["seq"], advance, schema)
