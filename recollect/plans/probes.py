"""Multi-probe buckets: hash tables in which a query visits as many buckets as it needs.

Every table cuts space by ``bits`` planes; an entry lies in one bucket per table.  A neighbour of a query falls on the
other side of a plane the more easily the nearer the query is to that plane.  So the query's margins give each bucket
a probability of holding a neighbour at similarity ``floor`` (planes taken as independent, the component across the
query as normal, with the logistic curve for its distribution).  The query visits the buckets of all tables by
decreasing probability until the chance to meet the neighbour in one of them reaches ``reach``.  Tables are not quite
independent either, so ``reach`` is asked for above the recall that is wanted (0.95 for 0.9).

A query visits thousands of buckets where the floor is low.  As it visits them in one order, the last one says which
they are: ``Visits`` tells for a pair whether the entry's bucket in any table comes no later, so that nothing is sent
or held for each bucket.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Planes drawn per table; a table uses the first ``bits`` of them.
MOST_BITS = 24
#: Planes of a table that a probe may cross: those nearest to the query.  The others stay on the query's side.
WEAK_BITS = 10
#: Scale at which the logistic curve is nearest to the normal distribution.
LOGISTIC = 1.702
#: Probabilities and chances are compared after rounding to so many digits.
DIGITS = 9
#: Least chance of a miss in a table, so that its logarithm is finite.
LEAST = 1e-12
STRIP = 64
#: Vectors or pairs looked at together inside a cell.
SLICE = 16_384


@dataclass(frozen=True)
class Probes:
    """Tables, planes per table, and up to which chance a neighbour at ``floor`` is looked for."""

    dim: int
    tables: int
    bits: int
    floor: float
    reach: float = 0.95
    seed: int = 42

    def __post_init__(self) -> None:
        if not 1 <= self.bits <= MOST_BITS or self.tables < 1:
            raise ValueError(f"bits must lie in 1..{MOST_BITS} and tables be at least 1")
        if not 0 < self.reach < 1:
            raise ValueError("reach must lie between 0 and 1")


def probes_for(rows: int, floor: float, dim: int, reach: float = 0.95, block: int = 4096, tables: int = 4) -> Probes:
    """Tables whose buckets hold about ``block`` of ``rows`` entries."""
    bits = max(1, math.ceil(math.log2(max(2.0, rows / block))))
    return Probes(dim, tables, min(bits, MOST_BITS), floor, reach)


def planes(p: Probes) -> np.ndarray:
    """Seeded unit normals, shape (tables, bits, dim).  The first bits of a table do not depend on how many are used."""
    drawn = np.random.RandomState(p.seed).randn(p.tables, MOST_BITS, p.dim)
    return (drawn / np.linalg.norm(drawn, axis=2, keepdims=True))[:, : p.bits]


def buckets_of(vectors: np.ndarray, normals: np.ndarray) -> np.ndarray:
    """Bucket per vector and table, first plane in the lowest bit."""
    weights = 1 << np.arange(normals.shape[1])
    return ((np.einsum("nd,tbd->ntb", vectors, normals) > 0) * weights).sum(axis=2).astype(np.int32)


def crossings(vectors: np.ndarray, normals: np.ndarray, p: Probes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per unit vector and table: its bucket, and per plane the chance that a neighbour lies across, and planes from the weakest on."""
    inner = np.einsum("nd,tbd->ntb", vectors, normals)
    home = ((inner > 0) * (1 << np.arange(p.bits))).sum(axis=2)
    margin = np.minimum(np.abs(inner), 1.0)
    spread = math.sqrt(max(1e-12, 1 - p.floor**2)) * np.sqrt(np.maximum(1e-12, 1 - margin**2) / max(1, p.dim - 1))
    cross = 1 / (1 + np.exp(np.minimum(LOGISTIC * p.floor * margin / spread, 500.0)))
    return home, cross, np.argsort(-cross, axis=2, kind="stable")


def _by_chance(vectors: np.ndarray, normals: np.ndarray, p: Probes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per query, in the order of visits: chance, table and bucket, and whether it is visited."""
    n, bits = len(vectors), p.bits
    home, cross, order = crossings(vectors, normals, p)
    chance = np.ones((n, p.tables, 1))
    bucket = home[:, :, None]
    for i in range(bits):
        one = np.take_along_axis(cross, order[:, :, i : i + 1], axis=2)
        if i < WEAK_BITS:
            flip = np.int64(1) << order[:, :, i : i + 1]
            bucket = np.concatenate([bucket, bucket ^ flip], axis=2)
            chance = np.concatenate([chance * (1 - one), chance * one], axis=2)
        else:
            chance = chance * (1 - one)
    chance = np.round(chance, DIGITS)
    # within a table: what each further bucket adds to the logarithm of the chance to miss
    first = np.lexsort((bucket, -chance))
    chance, bucket = np.take_along_axis(chance, first, 2), np.take_along_axis(bucket, first, 2)
    miss = np.log(np.maximum(1 - np.cumsum(chance, axis=2), LEAST))
    gain = -np.diff(miss, axis=2, prepend=0.0)
    # over all tables, until the chance to miss is small enough
    table = np.broadcast_to(np.arange(p.tables)[None, :, None], bucket.shape)
    flat = [x.reshape(n, -1) for x in (chance, bucket, table, gain)]
    order = np.lexsort((flat[1], flat[2], -flat[0]))
    chance, bucket, table, gain = (np.take_along_axis(x, order, 1) for x in flat)
    before = np.round(np.cumsum(gain, axis=1) - gain, DIGITS)
    return chance, table, bucket, (before < round(-math.log(1 - p.reach), DIGITS)) & (chance > 0)


def visited(vectors: np.ndarray, normals: np.ndarray, p: Probes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, table, bucket) of all buckets the unit ``vectors`` visit."""
    _, table, bucket, take = _by_chance(vectors, normals, p)
    rows, cols = np.nonzero(take)
    return rows, table[rows, cols], bucket[rows, cols]


def last_visits(vectors: np.ndarray, normals: np.ndarray, p: Probes) -> np.ndarray:
    """Chance, table and bucket of the last bucket each unit vector visits; a chance above 1 where it visits none."""
    chance, table, bucket, take = _by_chance(vectors, normals, p)
    many = take.sum(axis=1)
    at = np.maximum(many - 1, 0)[:, None]
    last = [np.take_along_axis(x, at, 1)[:, 0] for x in (chance, table, bucket)]
    return np.stack([np.where(many > 0, last[0], 2.0), last[1], last[2]], axis=1)


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, size, out=vectors.copy(), where=size > 0)


class Visits:
    """Admission of the pairs whose query visits a bucket of the entry."""

    def __init__(self, p: Probes):
        self.p, self.normals = p, planes(p)

    def of_entries(self, vectors: np.ndarray, order: np.ndarray) -> np.ndarray:
        strips = [buckets_of(unit_rows(vectors[at : at + SLICE]), self.normals) for at in range(0, len(vectors), SLICE)]
        return np.concatenate(strips)

    def of_queries(self, vectors: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, ...]:
        home, cross, order = crossings(unit_rows(vectors), self.normals, self.p)
        return home, np.take_along_axis(cross, order, 2), order, asked

    def columns(self, entries: np.ndarray, queries: tuple[np.ndarray, ...]) -> None:
        return None

    def pairs(self, entries: np.ndarray, queries: tuple[np.ndarray, ...], rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
        met = np.zeros(len(rows), dtype=bool)
        for table in range(self.p.tables):
            for at in range(0, len(rows), SLICE):
                left = at + np.flatnonzero(~met[at : at + SLICE])
                met[left] = self._in_table(entries[cols[left], table], queries, rows[left], table)
        return met

    def _in_table(self, own: np.ndarray, queries: tuple[np.ndarray, ...], rows: np.ndarray, table: int) -> np.ndarray:
        home, cross, order, asked = queries
        across = home[rows, table] ^ own
        chance = np.ones(len(rows))
        for i in range(self.p.bits):
            one, other = cross[rows, table, i], (across >> order[rows, table, i]) & 1 > 0
            chance = chance * np.where(other, one if i < WEAK_BITS else 0.0, 1 - one)
        chance = np.round(chance, DIGITS)
        least, last_table, last_bucket = asked[rows].T
        in_time = (table < last_table) | ((table == last_table) & (own <= last_bucket))
        return (chance > 0) & ((chance > least) | ((chance == least) & in_time))


def last_visit(vector: Column, p: Probes) -> Column:
    """array<double>: what ``Visits`` needs to know of a query that has a vector."""
    normals = planes(p)

    @F.arrow_udf("array<double>")
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            known = batch.value_lengths().fill_null(0).to_numpy(zero_copy_only=False) > 0
            found = [np.zeros((0, 3))]
            vectors = _unit(batch.filter(pa.array(known))) if known.any() else np.zeros((0, p.dim))
            for at in range(0, len(vectors), STRIP):
                found.append(last_visits(vectors[at : at + STRIP], normals, p))
            ends = np.concatenate([[0], np.cumsum(3 * known)]).astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found).ravel()), mask=pa.array(~known))

    return find(vector)


def _unit(col: pa.Array) -> np.ndarray:
    v = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), -1)
    size = np.linalg.norm(v, axis=1, keepdims=True)
    return np.divide(v, size, out=v, where=size > 0)


def _places(rows: np.ndarray, tables: np.ndarray, buckets: np.ndarray, known: np.ndarray) -> pa.Array:
    """One list of (table, bucket) per row of ``known``; ``rows`` count its true places and do not decrease."""
    sizes = np.zeros(len(known), dtype=np.int64)
    sizes[known] = np.bincount(rows, minlength=int(known.sum()))
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    values = pa.StructArray.from_arrays([pa.array(tables, pa.int32()), pa.array(buckets, pa.int32())], names=["table", "bucket"])
    return pa.ListArray.from_arrays(pa.array(ends), values)


def places(vector: Column, p: Probes, asking: bool) -> Column:
    """array<struct<table, bucket>>: the buckets a vector lies in, or those that it visits when ``asking``."""
    normals = planes(p)

    @F.arrow_udf("array<struct<table: int, bucket: int>>")
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            known = batch.value_lengths().fill_null(0).to_numpy(zero_copy_only=False) > 0
            rows, tables, buckets = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            vectors = _unit(batch.filter(pa.array(known))) if known.any() else np.zeros((0, p.dim))
            for at in range(0, len(vectors), STRIP):
                strip = vectors[at : at + STRIP]
                if asking:
                    r, t, b = visited(strip, normals, p)
                else:
                    r = np.repeat(np.arange(len(strip)), p.tables)
                    t, b = np.tile(np.arange(p.tables), len(strip)), buckets_of(strip, normals).ravel()
                rows.append(r + at)
                tables.append(t)
                buckets.append(b)
            yield _places(np.concatenate(rows), np.concatenate(tables), np.concatenate(buckets), known)

    return find(vector)


def placed(df: DataFrame, vector: str, p: Probes, asking: bool) -> DataFrame:
    """Rows with a vector, once per bucket, with columns ``_table`` and ``_bucket``."""
    known = df.filter(F.col(vector).isNotNull() & (F.size(vector) > 0)).withColumn("_places", places(F.col(vector), p, asking))
    spread = known.select("*", F.explode("_places").alias("_place")).drop("_places")
    return spread.withColumn("_table", F.col("_place.table")).withColumn("_bucket", F.col("_place.bucket")).drop("_place")
