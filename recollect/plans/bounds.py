"""Exact similarity joins that leave out blocks no match can lie in.

Entries are dealt to the nearest of a bounded number of centres.  A cluster is known by the angle of its farthest
entry, the longest of its vectors and the lowest similarity any of its entries asks for.  An entry of a cluster is no
nearer to a query than the angle to the centre less that radius, so a query is sent to a cluster only where that
leaves the similarity possible which it needs: the cluster's own limit and, where it has looked into its nearest
cluster first, its k-th best similarity there.  The rows that come out are those of the join over all blocks.

Clusters that lie together are packed into parts of many entries.  A query is sent once to a part with any cluster it
needs, and told apart inside: a task compares it with the clusters that may hold a match.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.plans.materialize import stored
from recollect.plans.similarity import CELL, ENTRY_BLOCK, PARTS, SPLIT, best_matches

#: Cosines closer than this count as equal, towards visiting.
SLACK = 1e-6
#: Entries drawn for each centre.
DRAWN = 8
#: Rows compared with all clusters together.
STRIP = 256


@dataclass(frozen=True)
class Blocks:
    """Entries per cluster, and the most clusters that are made (their centres are broadcast)."""

    entries: int = ENTRY_BLOCK
    most: int = 2048
    seed: int = 42


@dataclass(frozen=True)
class Clusters:
    """Unit centres, and per cluster the cosine of its radius, its longest vector, its lowest limit and its part."""

    centres: np.ndarray
    cosine: np.ndarray
    length: np.ndarray
    limit: np.ndarray
    part: np.ndarray

    def best_possible(self, queries: np.ndarray) -> np.ndarray:
        """The highest similarity an entry of each cluster can have to each query."""
        size = np.linalg.norm(queries, axis=1, keepdims=True)
        unit = np.divide(queries, size, out=queries.copy(), where=size > 0)
        angle = np.arccos(np.clip(unit @ self.centres.T, -1, 1)) - np.arccos(np.clip(self.cosine, -1, 1))
        return np.maximum(0.0, np.cos(np.clip(angle, 0, math.pi))) * self.length * size

    def admitted(self, queries: np.ndarray, need: np.ndarray) -> np.ndarray:
        return self.best_possible(queries) + SLACK >= np.maximum(self.limit[None, :], need[:, None])

    # Admission of the pairs of a cell: of_entries gives the cluster of each entry, of_queries the clusters each needs.

    def of_entries(self, vectors: np.ndarray, order: np.ndarray) -> np.ndarray:
        return order

    def of_queries(self, vectors: np.ndarray, asked: np.ndarray) -> np.ndarray:
        return self.admitted(vectors, asked[:, 0])

    def columns(self, entries: np.ndarray, queries: np.ndarray) -> np.ndarray | None:
        needed = queries.any(axis=0)[entries]
        return None if needed.all() else np.flatnonzero(needed)

    def pairs(self, entries: np.ndarray, queries: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
        return queries[rows, entries[cols]]


def parts_of(centres: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Part of each cluster: clusters from one that is left on to those nearest to it, until a part is full."""
    total = int(sizes.sum())
    many = max(math.ceil(total / CELL), min(PARTS, math.ceil(total / (CELL // SPLIT))), 1)
    part, room = np.full(len(centres), -1, dtype=np.int64), math.ceil(total / many)
    for number in range(many):
        left = np.flatnonzero(part < 0)
        if not len(left):
            break
        order = left[np.argsort(-(centres[left] @ centres[left[0]]), kind="stable")]
        held = np.cumsum(sizes[order]) - sizes[order]
        part[order if number == many - 1 else order[held < room]] = number
    return part


def _matrix(col: pa.Array) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), -1)


def nearest_centre(vector: Column, centres: np.ndarray) -> Column:
    """struct<cluster, cosine, length> of a vector that is not null or empty."""

    @F.arrow_udf("struct<cluster: int, cosine: double, length: double>")
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            vectors = _matrix(batch)
            own, cosine = np.zeros(len(vectors), np.int32), np.zeros(len(vectors))
            size = np.linalg.norm(vectors, axis=1)
            for at in range(0, len(vectors), STRIP):
                rows = slice(at, at + STRIP)
                v, long = vectors[rows], size[rows, None]
                inner = np.divide(v @ centres.T, long, out=np.zeros((len(v), len(centres))), where=long > 0)
                own[rows] = inner.argmax(axis=1)
                cosine[rows] = inner[np.arange(len(v)), own[rows]]
            yield pa.StructArray.from_arrays([pa.array(own), pa.array(cosine), pa.array(size)], names=["cluster", "cosine", "length"])

    return find(vector)


def visited_clusters(vector: Column, need: Column, clusters: Clusters) -> Column:
    """struct<clusters, parts>: how many clusters may hold an entry as similar as needed, and the parts they lie in."""

    @F.arrow_udf("struct<clusters: int, parts: array<int>>")
    def find(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        in_part = np.eye(int(clusters.part.max()) + 1, dtype=np.float32)[clusters.part]
        for vectors, needs in batches:
            v, least = _matrix(vectors), needs.to_numpy(zero_copy_only=False)
            many, ends, found = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)], [np.zeros(0, np.int64)]
            for at in range(0, len(v), STRIP):
                admitted = clusters.admitted(v[at : at + STRIP], least[at : at + STRIP])
                many.append(admitted.sum(axis=1).astype(np.int32))
                rows, parts = np.nonzero(admitted.astype(np.float32) @ in_part > 0)
                ends.append(ends[-1][-1] + np.cumsum(np.bincount(rows, minlength=len(admitted))))
                found.append(parts)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(ends).astype(np.int32)), pa.array(np.concatenate(found), pa.int32()))
            yield pa.StructArray.from_arrays([pa.array(np.concatenate(many)), lists], names=["clusters", "parts"])

    return find(vector, need)


def with_vector(df: DataFrame, vector: str) -> DataFrame:
    return df.filter(F.col(vector).isNotNull() & (F.size(vector) > 0))


def centres_of(entries: DataFrame, entry_id: str, vector: str, blocks: Blocks) -> np.ndarray:
    """Unit vectors about one for each block of entries: of some drawn by a hash of their ids, those farthest apart."""
    wanted = min(blocks.most, math.ceil(entries.count() / blocks.entries))
    if wanted < 2:
        return np.zeros((0, 0))
    turn = F.md5(F.concat_ws(":", F.lit(str(blocks.seed)), F.col(entry_id).cast("string")).cast("binary"))
    drawn = entries.select(turn.alias("turn"), F.col(vector).cast("array<double>").alias("v")).orderBy("turn").limit(DRAWN * wanted)
    found = np.array([r.v for r in drawn.collect()])
    size = np.linalg.norm(found, axis=1, keepdims=True)
    found = (found / np.where(size > 0, size, 1))[size[:, 0] > 0]
    if not len(found):
        return np.zeros((0, 0))
    chosen, near = [0], found @ found[0]
    while len(chosen) < wanted and near.min() < 1 - SLACK:
        chosen.append(int(near.argmin()))
        near = np.maximum(near, found @ found[chosen[-1]])
    return found[chosen]


def clustered(
    entries: DataFrame, entry_id: str, vector: str, limit: Column, blocks: Blocks
) -> tuple[DataFrame, Clusters | None]:
    """Entries with ``_cluster`` and ``_limit``, written once, and what is known of the clusters; None for one block."""
    known = stored(with_vector(entries, vector).withColumn("_limit", limit.cast("double")), "entries")
    centres = centres_of(known, entry_id, vector, blocks)
    if len(centres) < 2:
        return known, None
    placed = known.withColumn("_near", nearest_centre(F.col(vector), centres)).withColumn("_cluster", F.col("_near.cluster"))
    placed = stored(placed, "clusters")
    stats = placed.groupBy("_cluster").agg(
        F.min("_near.cosine").alias("cosine"), F.max("_near.length").alias("length"), F.min("_limit").alias("limit"), F.count(F.lit(1)).alias("n")
    )
    cosine, length, least, sizes = (np.full(len(centres), x) for x in (1.0, 0.0, np.inf, 0.0))
    for r in stats.collect():  # one row per centre
        cosine[r["_cluster"]], length[r["_cluster"]], least[r["_cluster"]], sizes[r["_cluster"]] = r.cosine, r.length, r.limit, r.n
    return placed.drop("_near"), Clusters(centres, cosine, length, least, parts_of(centres, sizes))


def bounded_matches(
    queries: DataFrame,
    entries: DataFrame,
    k: int,
    blocks: Blocks,
    *,
    query_id: str = "query_id",
    entry_id: str = "entry_id",
    vector: str = "embedding",
    group: list[str] | None = None,
    floor: float | None = None,
    entry_limit: Column | None = None,
    obey_limit: bool = True,
    **options,
) -> DataFrame:
    """The rows of ``best_matches``, with only those (query, cluster) cells formed that may hold a match."""
    group, plain = group or [], F.lit(-2.0)
    lowest = plain if floor is None else F.lit(floor)
    own = entry_limit if entry_limit is not None else plain
    asked = F.greatest(lowest, own) if obey_limit else lowest
    placed, clusters = clustered(entries.withColumn("_own", own.cast("double")), entry_id, vector, asked, blocks)
    told = {"floor": floor, "obey_limit": obey_limit, "entry_limit": F.col("_own") if entry_limit is not None else None}
    same = {"query_id": query_id, "entry_id": entry_id, "vector": vector} | told | options
    if clusters is None:
        return best_matches(queries, placed, k, group=group, **same)
    known = with_vector(queries, vector)
    home = stored(known.withColumn("_cluster", nearest_centre(F.col(vector), clusters.centres)["cluster"]), "homes")
    near = best_matches(home, placed, k, group=["_cluster", *group], **same)
    need = near.filter(F.col("rank") == k).select(F.col("query_id").alias(query_id), F.col("similarity").alias("_need"))
    asking = home.join(need, query_id, "left").withColumn("_need", F.coalesce("_need", F.lit(-2.0)))
    visits = visited_clusters(F.col(vector), F.col("_need"), clusters)["parts"]
    asked = {"_asked": F.array("_need"), "_order": F.col("_cluster")}
    sent = stored(asking.withColumns(asked | {"_parts": visits}).drop("_need", "_cluster"), "sent")
    sent = sent.withColumn("_part", F.explode("_parts")).drop("_parts")
    parts = F.lit(clusters.part.tolist())[F.col("_cluster")].cast("int")
    held = placed.withColumns({"_part": parts, "_order": F.col("_cluster")})
    return best_matches(sent, held, k, group=["_part", *group], admit=clusters, **same)


def cells_formed(
    queries: DataFrame, entries: DataFrame, limit: Column, blocks: Blocks, *, entry_id: str = "entry_id", vector: str = "embedding"
) -> DataFrame:
    """One row: queries, clusters, cells that the clusters' own limits leave, and their share of all cells."""
    _, clusters = clustered(entries, entry_id, vector, limit, blocks)
    known = with_vector(queries, vector)
    if clusters is None:
        cells = F.count(F.lit(1))
        many = 1
    else:
        many = len(clusters.centres)
        cells = F.coalesce(F.sum(F.col("_visits").cast("bigint")), F.lit(0))
        known = known.withColumn("_visits", visited_clusters(F.col(vector), F.lit(-2.0), clusters)["clusters"])
    row = known.agg(F.count(F.lit(1)).alias("queries"), F.lit(many).cast("bigint").alias("clusters"), cells.alias("cells"))
    return row.withColumn("share", F.col("cells") / F.greatest(F.col("queries") * F.col("clusters"), F.lit(1)))
