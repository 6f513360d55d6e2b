"""Keys of a stream dealt to parts, whose rows and states are kept together."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A call of Python and of the state store serves a part, not a key; their number is fixed, the keys of a part grow.
PARTS = 1024


def part_of(key: str) -> Column:
    """The part of the keys that a key belongs to; null has one of its own."""
    return F.when(F.col(key).isNull(), -1).otherwise(F.pmod(F.xxhash64(key), F.lit(PARTS))).cast("int")


def _plain(x):
    return x.tolist() if isinstance(x, np.ndarray) else x.item() if isinstance(x, np.generic) else x


def plain_values(column: pd.Series) -> list:
    """Python values, None for null."""
    if column.dtype.kind in "iub":
        return column.tolist()
    return [None if x is None or x is pd.NaT or (isinstance(x, float) and x != x) else x for x in map(_plain, column)]
