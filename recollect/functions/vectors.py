"""Vector maths: JVM-side for one vector at a time, Arrow blocks for matrix products."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def norm(vec: Column) -> Column:
    return F.sqrt(F.aggregate(vec, F.lit(0.0), lambda s, x: s + x * x))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x
    )


def l2_normalized(df: DataFrame, vector: str, out: str) -> DataFrame:
    """Add the unit vector; a zero vector stays as it is.

    The norm becomes a column of its own so that it is not recomputed per element.
    """
    widened = df.withColumn("_wide", F.col(vector).cast("array<double>"))
    normed = widened.withColumn("_norm", norm(F.col("_wide")))
    unit = F.when(F.col("_norm") > 0, F.transform("_wide", lambda x: x / F.col("_norm"))).otherwise(
        F.col("_wide")
    )
    return normed.withColumn(out, unit).drop("_wide", "_norm")


def gaussian_planes(dim: int, tables: int, bits: int, seed: int) -> np.ndarray:
    """Seeded hyperplanes, shape (tables, bits, dim).  Fixed: they define which bucket a vector is in."""
    return np.random.RandomState(seed).randn(tables, bits, dim).astype(np.float32)


def orthogonal_projection(dim: int, target: int, seed: int = 42) -> np.ndarray:
    """Seeded matrix with orthonormal columns, shape (dim, min(dim, target)).

    Directions are drawn one by one, freed of their share in the earlier ones and turned so that their largest
    entry is positive.
    """
    draw = np.random.default_rng(seed)
    columns = np.zeros((dim, min(dim, target)))
    for i in range(columns.shape[1]):
        v = draw.standard_normal(dim)
        for _ in range(2):  # the second round removes what rounding left
            v -= columns[:, :i] @ (columns[:, :i].T @ v)
        v /= np.linalg.norm(v)
        columns[:, i] = v * np.sign(v[np.abs(v).argmax()])
    return columns.astype(np.float32)


def _rows(arr: pa.Array) -> np.ndarray:
    flat = arr.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(arr), -1)


def _row_lists(batch: pa.Array, made: Callable[[np.ndarray], np.ndarray], item: pa.DataType) -> pa.Array:
    """One output list per vector of the batch; null for a null or empty vector."""
    lengths = batch.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    known = lengths > 0
    if not known.any():
        return pa.nulls(len(batch), pa.list_(item))
    out = made(_rows(batch.filter(pa.array(known))))
    offsets = np.concatenate([[0], np.cumsum(np.where(known, out.shape[1], 0))]).astype(np.int32)
    return pa.ListArray.from_arrays(
        pa.array(offsets), pa.array(out.ravel(), item), mask=pa.array(~known)
    )


def lsh_signature(vector: Column, dim: int, tables: int = 4, bits: int = 8, seed: int = 42) -> Column:
    """array<int> with one sign-bit hash per table, first plane in the highest bit."""
    planes = gaussian_planes(dim, tables, bits, seed).astype(np.float64).reshape(tables * bits, dim)
    weights = (1 << np.arange(bits - 1, -1, -1)).astype(np.int64)

    def hashes(vectors: np.ndarray) -> np.ndarray:
        return ((vectors @ planes.T > 0).reshape(-1, tables, bits) * weights).sum(axis=2).astype(np.int32)

    @F.arrow_udf("array<int>")
    def signature(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield _row_lists(batch, hashes, pa.int32())

    return signature(vector)


def lsh_combined(signature: Column) -> Column:
    """Exclusive or of all table hashes."""
    return F.aggregate(signature, F.lit(0), lambda s, h: s.bitwiseXOR(h))


def signature_key(signature: Column, tables_used: int | None = None) -> Column:
    """Bucket name of a whole signature, or of its first tables for a coarser bucket."""
    used = signature if tables_used is None else F.slice(signature, 1, tables_used)
    return F.array_join(used.cast("array<string>"), "|")


def projected(vector: Column, dim: int, target: int, seed: int = 42) -> Column:
    """Orthogonal random projection to ``target`` dimensions, renormalised."""
    matrix = orthogonal_projection(dim, target, seed).astype(np.float64)

    def low(vectors: np.ndarray) -> np.ndarray:
        out = vectors @ matrix
        size = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, size, out=out.copy(), where=size > 0)

    @F.arrow_udf("array<double>")
    def project(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield _row_lists(batch, low, pa.float64())

    return project(vector)


def embed_distinct(df: DataFrame, text: str, encoder: Column | None = None, dim: int = 256, idf: bool = False) -> DataFrame:
    """Add ``embedding``: each distinct normalised text is encoded once.

    ``encoder`` is a column expression over ``text`` (an Arrow UDF around a model); without one
    a hashed bag of words with unit length is used, with ``idf`` weighted by how few of the distinct
    texts have a word in the same slot (one number per slot is held by the driver).
    """
    from recollect.functions.text import memo_key, words
    from recollect.plans.materialize import stored
    from recollect.plans.spread import spread_join

    keyed = df.withColumn("_memo", memo_key(F.col(text)))
    once = keyed.groupBy("_memo").agg(F.min(text).alias(text))
    if encoder is None:
        slots = F.transform(words(F.col(text)), lambda w: word_slot(w, dim))
        weights = np.ones(dim)
        if idf:  # texts are grouped and their words hashed once, for the weights and the vectors
            once = stored(once.select("_memo", slots.alias("slots")), "slots")
            slots, weights = F.col("slots"), slot_weights(once.select("slots"), dim)
        encoder = _hashed_words(slots, dim, weights)
    vectors = once.select("_memo", encoder.alias("embedding"))
    joined = spread_join(
        keyed.withColumn("_row", F.monotonically_increasing_id()),  # equal rows go to different tasks, too
        vectors, ["_memo"], "left", "_row",
    )
    return joined.select(*df.columns, "embedding")


def slot_weights(texts: DataFrame, dim: int) -> np.ndarray:
    """Weight per slot from ``texts`` (slots): 1 + ln((texts + 1) / (texts with the slot + 1))."""
    total = texts.count()
    seen = texts.select(F.explode(F.array_distinct("slots")).alias("slot")).groupBy("slot").count()
    weights = np.full(dim, 1.0 + np.log(total + 1.0))
    for r in seen.collect():  # one row per slot
        weights[r["slot"]] = 1.0 + np.log((total + 1.0) / (r["count"] + 1.0))
    return weights


def word_slot(word: Column, dim: int) -> Column:
    """Slot of a word in a hashed bag of words, from its md5."""
    return (F.conv(F.substring(F.md5(word.cast("binary")), 1, 8), 16, 10).cast("bigint") % dim).cast("int")


def _hashed_words(slots: Column, dim: int, weights: np.ndarray) -> Column:
    @F.arrow_udf("array<double>")
    def encode(slots: pa.Array) -> pa.Array:
        out = np.zeros((len(slots), dim))
        lengths = slots.value_lengths().to_numpy(zero_copy_only=False)
        rows = np.repeat(np.arange(len(slots)), lengths.astype(np.int64))
        np.add.at(out, (rows, slots.flatten().to_numpy(zero_copy_only=False)), 1.0)
        out *= weights
        size = np.linalg.norm(out, axis=1, keepdims=True)
        out = np.divide(out, size, out=out, where=size > 0)
        return pa.ListArray.from_arrays(
            pa.array(np.arange(0, out.size + 1, dim, dtype=np.int32)), pa.array(out.ravel())
        )

    return encode(slots)
