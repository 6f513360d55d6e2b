"""Blocked top-k similarity join.

Both sides are grouped by equality columns (tenant, hash bucket, or nothing at all).  A group
larger than a block is cut into parts, so any (query part, entry part) cell is bounded; Spark
shuffles cells, sorts each partition by cell with entries first, and the task multiplies one
entry block with the query rows streaming past it.  Only the k best of each query per cell
leave a task, never the pairs.

A vector is sent once per part of the other side, never once per bucket or cluster: which pairs
of a cell count is told by an ``Admission`` inside the task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType, DoubleType

from recollect.plans.spread import hot_keys

ENTRY_BLOCK = 16_384
#: Most rows of a part.  A group with fewer is still cut into up to ``PARTS`` parts of a 16th of that, so that there is
#: a cell for every core; the vectors that are sent grow by the power 1 up to there and by parts from there on.
CELL, SPLIT, PARTS = 65_536, 16, 8
QUERY_STRIP = 256
#: Entries compared with a strip at a time: few at first, until each query has a k-th best to be under.
FIRST, CHUNK = 64, 4096
SIM_DIGITS = 9
#: Products this much below a similarity may still be rounded up to it.
ROUNDED = 1e-8


class Admission(Protocol):
    """Which pairs of a cell count.  Queries carry ``_asked`` (array<double>), both sides ``_order`` to lie next to their like."""

    def of_entries(self, vectors: np.ndarray, order: np.ndarray) -> object: ...

    def of_queries(self, vectors: np.ndarray, asked: np.ndarray) -> object: ...

    def columns(self, entries: object, queries: object) -> np.ndarray | None:
        """Entries worth a comparison with any of the queries; None for all."""

    def pairs(self, entries: object, queries: object, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
        """Whether each (query, entry) counts."""


def _matrix(col: pa.ChunkedArray | pa.Array) -> np.ndarray:
    arr = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    flat = arr.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(arr), -1)


class _Entries:
    """One block of entries: vectors, limits, and each entry's place among the ids."""

    def __init__(self, blocks: list[pa.RecordBatch], admit: Admission | None):
        table = pa.Table.from_batches(blocks).combine_chunks().sort_by("_eid")
        ids = table.column("_eid").combine_chunks()
        order = table.column("_order").to_numpy() if admit is not None else np.zeros(table.num_rows, np.int32)
        self.place = np.argsort(order, kind="stable")  # where entries lie by order, and which id each has
        self.ids = ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids
        self.vec = _matrix(table.column("_vec"))[self.place]
        self.limit = table.column("_limit").to_numpy()[self.place]
        self.seq = table.column("_seq").to_numpy()[self.place]
        self.values = self.ids.to_numpy(zero_copy_only=False)
        codes = self.ids.dictionary_encode().indices.to_numpy(zero_copy_only=False)  # equal ids have one code
        self.code = np.where(np.isnan(codes), len(codes), codes).astype(np.int64) if codes.dtype.kind == "f" else codes.astype(np.int64)
        self.admitted = None if admit is None else admit.of_entries(self.vec, order[self.place])


def _best(
    strip: pa.RecordBatch, entries: _Entries, k: int, floor: float | None, obey_limit: bool, skip_same: bool, earlier_only: bool,
    distinct: bool, admit: Admission | None,
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, place among the ids, similarity, limit) of the k best pairs of each row; ties go to the lower place.

    Entries are compared in chunks.  A product below the k-th best so far is not looked at again, so that rounding,
    the other conditions and the choice of the best only see a few pairs of each row.
    """
    vectors = _matrix(strip.column("_vec"))
    n, lowest = len(vectors), -2.0 if floor is None else floor
    qid, seq = strip.column("_qid").to_numpy(zero_copy_only=False), strip.column("_seq").to_numpy()
    cut, cut_place = np.full(n, lowest), np.full(n, len(entries.place), dtype=np.int64)
    rows, cols, sims = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    asking, some = None, None
    if admit is not None:
        asking = admit.of_queries(vectors, _matrix(strip.column("_asked")))
        some = admit.columns(entries.admitted, asking)
    total = len(entries.place) if some is None else len(some)
    at, width = 0, FIRST
    while at < total:
        part = slice(at, min(total, at + width)) if some is None else some[at : at + width]
        product = vectors @ entries.vec[part].T
        near = product >= (cut - ROUNDED)[:, None]
        if obey_limit:
            near &= product >= (entries.limit[part] - ROUNDED)[None, :]
        r, c = np.nonzero(near)
        s = np.round(product[r, c], SIM_DIGITS)
        c = c + at if some is None else part[c]
        at, width = at + width, min(2 * width, CHUNK)
        keep = (s > cut[r]) | ((s == cut[r]) & (entries.place[c] < cut_place[r]))
        if obey_limit:
            keep &= s >= entries.limit[c]
        if skip_same:
            keep &= qid[r] != entries.values[entries.place[c]]
        if earlier_only:
            keep &= entries.seq[c] < seq[r]
        r, c, s = r[keep], c[keep], s[keep]
        if admit is not None and len(r):
            keep = admit.pairs(entries.admitted, asking, r, c)
            r, c, s = r[keep], c[keep], s[keep]
        if not len(r):
            continue
        rows, cols, sims = np.concatenate([rows, r]), np.concatenate([cols, c]), np.concatenate([sims, s])
        order = np.lexsort((entries.place[cols], -sims, rows))
        rows, cols, sims = rows[order], cols[order], sims[order]
        if distinct:  # of entries that share an id, the best
            _, first = np.unique(rows * (len(entries.place) + 1) + entries.code[entries.place[cols]], return_index=True)
            first.sort()
            rows, cols, sims = rows[first], cols[first], sims[first]
        nth = np.arange(len(rows)) - np.searchsorted(rows, rows)
        last, keep = nth == k - 1, nth < k
        cut[rows[last]], cut_place[rows[last]] = sims[last], entries.place[cols[last]]
        rows, cols, sims = rows[keep], cols[keep], sims[keep]
    return rows, entries.place[cols], sims, entries.limit[cols]


def _cell_kernel(
    k: int, floor: float | None, obey_limit: bool, skip_same: bool, earlier_only: bool, distinct: bool, admit: Admission | None, out: pa.Schema
):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, blocks, entries = None, [], None
        for batch in batches:
            cells = batch.column("_cell").to_numpy(zero_copy_only=False)
            sides = batch.column("_side").to_numpy(zero_copy_only=False)
            if len(cells) == 0:
                continue
            change = np.flatnonzero((cells[1:] != cells[:-1]) | (sides[1:] != sides[:-1])) + 1
            bounds = [0, *change.tolist(), len(cells)]
            for lo, hi in zip(bounds[:-1], bounds[1:]):
                part = batch.slice(lo, hi - lo)
                if cells[lo] != cell:
                    cell, blocks, entries = cells[lo], [], None
                if sides[lo] == 0:
                    blocks.append(part)
                    continue
                if entries is None:
                    if not blocks:
                        continue
                    entries, blocks = _Entries(blocks, admit), []
                for at in range(0, part.num_rows, QUERY_STRIP):
                    strip = part.slice(at, QUERY_STRIP)
                    rows, places, sims, limits = _best(strip, entries, k, floor, obey_limit, skip_same, earlier_only, distinct, admit)
                    if len(rows):
                        found = [strip.column("_qid").take(pa.array(rows)), entries.ids.take(pa.array(places)), pa.array(sims), pa.array(limits)]
                        yield pa.RecordBatch.from_arrays(found, schema=out)

    return run


def best_matches(
    queries: DataFrame,
    entries: DataFrame,
    k: int,
    *,
    query_id: str = "query_id",
    entry_id: str = "entry_id",
    vector: str = "embedding",
    group: list[str] | None = None,
    floor: float | None = None,
    entry_limit: Column | None = None,
    obey_limit: bool = True,
    earlier_only: bool = False,
    skip_same: bool = False,
    query_seq: str = "seq",
    entry_seq: str = "seq",
    once_per_pair: bool = True,
    sizes_from: DataFrame | None = None,
    entry_block: int = CELL,
    query_block: int = CELL,
    admit: Admission | None = None,
) -> DataFrame:
    """(query_id, entry_id, similarity, threshold, rank): the k nearest entries of each query.

    Similarity is the dot product of unit vectors.  ``floor`` drops pairs below a similarity
    all callers would reject; ``entry_limit`` is a per-entry least similarity, applied before
    the k best are taken, or only reported as ``threshold`` with ``obey_limit=False``.
    Set ``once_per_pair=False`` when one pair can meet in several groups; then entries sharing an
    id count once.  ``sizes_from`` is a cheaper table with at least the queries' ids and groups,
    to size the blocks by.  ``admit`` tells which pairs of a cell count.
    """
    group = group or []
    out_types = StructType([
        StructField("query_id", queries.schema[query_id].dataType),
        StructField("entry_id", entries.schema[entry_id].dataType),
        StructField("similarity", DoubleType()),
        StructField("threshold", DoubleType()),
    ])
    constant = [] if group else [F.lit(0).alias("_all")]
    cols = group or ["_all"]
    has_vec = F.col(vector).isNotNull() & (F.size(vector) > 0)
    more_q = [] if admit is None else [F.col("_order").cast("int").alias("_order"), F.col("_asked").cast("array<double>").alias("_asked")]
    more_e = [] if admit is None else [F.col("_order").cast("int").alias("_order"), F.lit(None).cast("array<double>").alias("_asked")]
    q = queries.filter(has_vec).select(
        *[F.col(g) for g in group], *constant,
        F.col(query_id).alias("_id"), F.col(vector).cast("array<float>").alias("_vec"),
        F.lit(-2.0).alias("_limit"),
        (F.col(query_seq).cast("bigint") if earlier_only else F.lit(0).cast("bigint")).alias("_seq"), *more_q,
    )
    e = entries.filter(has_vec).select(
        *[F.col(g) for g in group], *constant,
        F.col(entry_id).alias("_id"), F.col(vector).cast("array<float>").alias("_vec"),
        (entry_limit if entry_limit is not None else F.lit(-2.0)).cast("double").alias("_limit"),
        (F.col(entry_seq).cast("bigint") if earlier_only else F.lit(0).cast("bigint")).alias("_seq"), *more_e,
    )

    def large(side: DataFrame, key: str, block: int, name: str) -> DataFrame:
        rows = side.select(*[F.col(g) for g in group], *constant, F.col(key).alias("_id"))
        small = F.col("_parts")
        parts = F.greatest(F.ceil(small / SPLIT), F.least(small, F.lit(PARTS))).cast("int")
        return hot_keys(rows, cols, max(1, block // SPLIT), "_id").select(*cols, parts.alias(name))

    obeyed = obey_limit and entry_limit is not None
    kernel = _cell_kernel(k, floor, obeyed, skip_same, earlier_only, not once_per_pair, admit, to_arrow_schema(out_types))
    by = ["_cell", "_side"] if admit is None else ["_cell", "_side", "_order"]

    def kept(found: DataFrame) -> DataFrame:
        return _ranked(found if once_per_pair else found.dropDuplicates(["query_id", "entry_id"]), k)

    if earlier_only and not group:
        block = min(entry_block, query_block)
        cuts = order_cuts(queries.select(query_seq), entries.select(entry_seq), block, max(1, block // SPLIT))
        both = _earlier_cells(q, e, cuts, out_types)
        return kept(both.repartition("_cell").sortWithinPartitions(*by).mapInArrow(kernel, out_types))

    big_q = large(queries if sizes_from is None else sizes_from, query_id, query_block, "_qparts")
    big_e = large(entries, entry_id, entry_block, "_eparts")

    def with_parts(side: DataFrame) -> DataFrame:
        """Add the number of query and entry parts of the row's group."""
        if not group:  # one group: its two numbers are scalars
            parts = {n: d.select(n).scalar() for n, d in (("_qparts", big_q), ("_eparts", big_e))}
            return side.withColumns(parts)
        return side.join(big_q, cols, "left").join(big_e, cols, "left")

    qn, en = F.coalesce("_qparts", F.lit(1)), F.coalesce("_eparts", F.lit(1))

    def cells(side: DataFrame, is_query: bool) -> DataFrame:
        own = F.pmod(F.xxhash64("_id"), qn if is_query else en).cast("int")
        other = F.explode(F.sequence(F.lit(0), (en if is_query else qn) - 1))
        placed = with_parts(side).withColumn("_own", own).withColumn("_other", other)
        qp, ep = ("_own", "_other") if is_query else ("_other", "_own")
        # Ids of the two sides may differ in type, so each keeps a column of its own.
        here, there = ("_qid", "_eid") if is_query else ("_eid", "_qid")
        foreign = out_types["entry_id" if is_query else "query_id"].dataType
        return placed.select(
            F.concat_ws("\u0000", F.col(qp), F.col(ep), *[F.col(c).cast("string") for c in cols]).alias("_cell"),
            F.lit(1 if is_query else 0).alias("_side"),
            F.col("_id").alias(here), F.lit(None).cast(foreign).alias(there), "_vec", "_limit", "_seq", *_told(side),
        )

    both = cells(e, False).unionByName(cells(q, True))
    placed = both.repartition("_cell").sortWithinPartitions(*by)
    return kept(placed.mapInArrow(kernel, out_types))


def _told(side: DataFrame) -> list[str]:
    return [c for c in ("_order", "_asked") if c in side.columns]


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query, ties to the lower entry_id."""
    if k == 1:
        return (
            found.groupBy("query_id")
            .agg(F.min(F.struct((-F.col("similarity")).alias("s"), "entry_id", "threshold")).alias("b"))
            .select(
                "query_id", F.col("b.entry_id").alias("entry_id"), (-F.col("b.s")).alias("similarity"),
                F.col("b.threshold").alias("threshold"), F.lit(1).alias("rank"),
            )
        )
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "entry_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def order_cuts(queries: DataFrame, entries: DataFrame, block: int, least: int | None = None) -> list[int]:
    """Places of the order between which there are about ``block`` rows of each side, or ``least`` where that makes few parts."""
    both = queries.toDF("at").unionByName(entries.toDF("at")).filter("at is not null").select(F.col("at").cast("bigint").alias("at"))
    rows = both.count() / 2
    parts = max(math.ceil(rows / block), min(PARTS, math.ceil(rows / (least or block))))
    if parts < 2:
        return []
    places = F.percentile_approx("at", [i / parts for i in range(1, parts)], 100 * parts)
    return sorted(set(both.agg(places).first()[0]))


def _earlier_cells(q: DataFrame, e: DataFrame, cuts: list[int], out_types: StructType) -> DataFrame:
    """Both sides by cell: a query of part i meets the entry parts up to i, and no others are formed."""
    own = F.lit(0)
    if cuts:
        own = F.size(F.filter(F.lit(cuts), lambda c: F.col("_seq") >= c))

    def cells(side: DataFrame, is_query: bool) -> DataFrame:
        others = F.sequence(F.lit(0), F.col("_own")) if is_query else F.sequence(F.col("_own"), F.lit(len(cuts)))
        placed = side.filter("_seq is not null").withColumn("_own", own).withColumn("_other", F.explode(others))
        qp, ep = ("_own", "_other") if is_query else ("_other", "_own")
        here, there = ("_qid", "_eid") if is_query else ("_eid", "_qid")
        foreign = out_types["entry_id" if is_query else "query_id"].dataType
        return placed.select(
            F.concat_ws("\u0000", F.col(qp), F.col(ep)).alias("_cell"), F.lit(1 if is_query else 0).alias("_side"),
            F.col("_id").alias(here), F.lit(None).cast(foreign).alias(there), "_vec", "_limit", "_seq", *_told(side),
        )

    return cells(e, False).unionByName(cells(q, True))
