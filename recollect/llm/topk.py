"""Exact top-k by inner product with no-random-access aggregation over sorted lists.

Candidates are cut into blocks; a block keeps one list per dimension, sorted by value.  A query reads the
lists from the end where its weight makes the largest contributions, step by step.  After each step every
row read so far has a lower bound (its seen contributions and the list minima) and an upper bound (seen
contributions and the last values read); rows not read at all have the sum of the last values.  Reading stops
once rows that are not among the candidates cannot reach the k-th lower bound, and the rows whose upper bound
still reaches it get their final scores.  The best k of a block are exact, so the best k of all blocks are.

Queries and candidate blocks meet cell by cell, both in parts of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.llm.tables import narrow

BLOCK_ROWS = 8192
QUERY_ROWS = 1024
FOUND = "query_id bigint, vec_id bigint, score bigint"


def packed(vectors: DataFrame, scale: int) -> DataFrame:
    """(id, dim, data): components as floor(scale * x) in 64-bit integers, without unfit rows."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, dims, data = [], [], []
            lists = batch.column("vec")
            for i, row in zip(batch.column("id").to_pylist(), lists, strict=True):
                if i is None or not row.is_valid or row.values.null_count:
                    continue
                x = row.values.to_numpy(zero_copy_only=False).astype(np.float64)
                if np.isfinite(x).all():
                    ids.append(i)
                    dims.append(len(x))
                    data.append(np.floor(scale * x).astype("<i8").tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(data, pa.binary())], names=["id", "dim", "data"]
            )

    return vectors.mapInArrow(pack, "id bigint, dim int, data binary")


class SortedLists:
    """The lists of one block: for each dimension its rows by falling and by rising value."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        self.ids, self.rows, self.plain = ids, rows, rows.astype(np.float64)
        rising = np.argsort(rows, axis=0, kind="stable").T
        self.order = np.ascontiguousarray([rising, rising[:, ::-1]])
        self.values = np.take_along_axis(self.plain.T[None], self.order, axis=2)
        self.depth = max(64, len(ids) // 16)

    def top(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best rows, those with the query's own id left out."""
        n, weight = len(self.ids), query.astype(np.float64)
        live = np.flatnonzero(weight)
        wanted = k + int((self.ids == query_id).sum())  # the rows of the query's own id may all be among the best
        rest = self._survivors(weight[live], live, wanted, n) if n > 4 * wanted and len(live) else np.arange(n)
        rest = rest[self.ids[rest] != query_id]
        score = self.rows[rest] @ query
        best = np.lexsort((self.ids[rest], -score))[:k]
        return self.ids[rest][best], score[best]

    def _survivors(self, weight: np.ndarray, live: np.ndarray, k: int, n: int) -> np.ndarray:
        """Rows that may be among the k best.

        The first step reads about as far as the query before had to, later ones twice as far.
        """
        way, depth = (weight > 0).astype(np.int64), min(n, self.depth)
        worst = weight * self.values[way, live, -1]
        slack = 1e-9 * np.abs(weight).dot(np.abs(self.values[:, live][:, :, [0, -1]]).max(axis=(0, 2)))
        while True:
            rows, gains = self.order[way, live, :depth].ravel(), weight[:, None] * self.values[way, live, :depth]
            last = gains[:, -1]
            upper = last.sum() + np.bincount(rows, (gains - last[:, None]).ravel(), n)
            lower = worst.sum() + np.bincount(rows, (gains - worst[:, None]).ravel(), n)
            # the rows that look best are resolved, which raises the k-th score that outsiders have to reach
            likely = np.argpartition(upper, n - 4 * k)[n - 4 * k :]
            floor = max(np.partition(lower, n - k)[n - k], np.sort(self.plain[likely][:, live] @ weight)[-k])
            candidates = np.flatnonzero(upper >= floor - slack)
            unread = last.sum() >= floor - slack
            if depth == n or (not unread and len(candidates) <= n // 2):
                self.depth = depth if len(candidates) > n // 8 else max(64, 3 * depth // 4)
                return candidates  # their final scores cost less than reading on
            depth = min(n, 2 * depth)


def _decode(table: pa.Table, dim: int) -> tuple[np.ndarray, np.ndarray]:
    ids = table.column("id").to_numpy()
    rows = np.frombuffer(b"".join(table.column("data").to_pylist()), dtype="<i8").reshape(len(ids), dim)
    both = np.unique(np.column_stack([ids, rows]), axis=0)  # repeated rows count once
    return both[:, 0], np.ascontiguousarray(both[:, 1:])


def top_k(
    vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding",
    block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """The ``k`` rows with the highest integer inner product for every query: query_id, rank, vec_id, score.

    ``is_query`` is a condition on the column ``id``.  Vectors that are null or hold null or non-finite
    components, and rows without an id, take no part.  Vectors meet only vectors of their own length (all
    scores are 0 at length 0).  Ties go to the smaller id.  Rows with the same id never meet as query and
    candidate, however many there are; each vector of an id asks for itself, and the best of all its vectors are
    the id's.  A row repeated exactly counts once.  An empty table gives none.  Scores must fit a long.
    """
    rows = packed(narrow(vectors, id=id_col, vec=vec_col), scale)
    counts = narrow(vectors, id=id_col).agg(F.count("id"), F.count(F.when(is_query, 1))).first()
    blocks, parts = max(1, -(-counts[0] // block_rows)), max(1, -(-counts[1] // query_rows))
    spread = F.xxhash64("id", "data")
    every_part = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    every_block = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    entries = rows.select("*", F.pmod(spread, F.lit(blocks)).cast("int").alias("block"), every_part.alias("part"), F.lit(False).alias("asks"))
    asked = rows.filter(is_query).select(
        "*", every_block.alias("block"), F.pmod(spread, F.lit(parts)).cast("int").alias("part"), F.lit(True).alias("asks")
    )

    def search(key: tuple, cell: pa.Table) -> pa.Table:
        dim = key[0].as_py()
        asks = cell.column("asks").to_numpy()
        found: list[tuple[np.ndarray, ...]] = []
        if asks.any() and not asks.all():
            lists = SortedLists(*_decode(cell.filter(pa.array(~asks)), dim))
            for query_id, query in zip(*_decode(cell.filter(pa.array(asks)), dim), strict=True):
                ids, scores = lists.top(query_id, query, k)
                found.append((np.full(len(ids), query_id), ids, scores))
        columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 3
        return pa.table(dict(zip(("query_id", "vec_id", "score"), (pa.array(c.astype(np.int64)) for c in columns), strict=True)))

    found = entries.unionByName(asked).groupBy("dim", "block", "part").applyInArrow(search, FOUND)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.distinct().withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def neighbours(vectors: DataFrame) -> DataFrame:
    return top_k(vectors, F.col("id") % 50 == 0)


SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id query_id, c.vec_id, list_inner_product(q.e, c.e)::bigint score from v q join v c on q.vec_id <> c.vec_id
  where q.vec_id % 50 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) rank from s)
select query_id, rank::integer rank, vec_id, score from r where rank <= 5
"""
