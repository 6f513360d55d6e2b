"""Per-key sequential state over sorted rows, streamed batch by batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def new_keys(frame: pd.DataFrame) -> np.ndarray:
    """Whether each row differs from the one before; a null is a key like any other."""
    before = frame.shift()
    return ((frame != before) & ~(frame.isna() & before.isna())).any(axis=1).to_numpy(copy=True)


def ordered_scan(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    advance: Callable[[object, pd.DataFrame, np.ndarray], tuple[object, pd.DataFrame]],
    schema: str,
) -> DataFrame:
    """Feed sorted rows to ``advance(state, rows, fresh)``, which returns (state, output).

    ``fresh`` marks the rows where a new key begins.  Spark shuffles and sorts; a task keeps one
    state and one Arrow batch, never a whole key.  Callers cut keys into independent pieces
    first wherever the semantics allow it.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = None, None
        for batch in batches:
            if batch.empty:
                continue
            frame = batch[keys]
            fresh = new_keys(frame)
            fresh[0] = last is None or new_keys(pd.concat([last, frame.iloc[:1]]))[1]
            last = frame.iloc[-1:]
            state, out = advance(state, batch, fresh)
            yield out

    placed = df.repartition(*keys).sortWithinPartitions(*keys, *order)
    return placed.mapInPandas(run, schema)
