"""Near copies: documents whose sets of word shingles have a Jaccard similarity of ``floor`` or more.

Documents with equal sets are first made one class.  MinHash values of a class are banded; classes that share a
band meet.  No pair is linked before the similarity of its whole shingle sets has been computed.

Rounds keep large groups from becoming all their pairs.  In the first, a bucket (cut at random where it is
large, differently in every band) proposes pairs with leaders: a class that seems similar enough to a leader
proposes no further pairs there.  Each class follows one of its leaders; those pairs are verified, and what they
link becomes components.  Then every two classes that share a bucket and are still in different components meet, in a
grid of cells where the bucket is large.  Of those whose sizes, bitmaps (which bound how much two sets share) and MinHash
values leave a similarity of ``floor`` possible, the most similar partner of each class is verified in the second round
and, after what that links is joined, all that are left in the third.  So pairs are only passed over when a chain of
verified pairs already joins them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm.components import smallest_reachable
from recollect.llm.tables import if_small, narrow
from recollect.llm.words import binary_column, list_column, plain_pieces, released, tidy
from recollect.plans.materialize import stored
from recollect.plans.spread import spread_join

SEED = 42
#: Of pairs at 0.8, (1 - 0.8 ** 5) ** 24 = 0.00007 share no band.
BANDS, BAND_ROWS = 24, 5
HASHES = BANDS * BAND_ROWS
_DRAWN = np.random.default_rng(SEED).integers(0, 2**64, size=(2, HASHES, 1), dtype=np.uint64)
_FLIP, _TIMES = _DRAWN[0], _DRAWN[1] | np.uint64(1)
#: By how much the estimated similarity of a pair may miss the floor: in the first round, and in the second (5.5 sd).
FIRST_SLACK, SLACK = 0.05, 0.2
#: Bits of a set's bitmap.
BITMAP = 512
#: Classes of one bucket that one task compares with each other or with as many others.
BLOCK_ROWS = 2_000
#: Rows for one task of a bucket join, and pairs of one class that travel together.
TASK_ROWS, PAIR_ROWS = 50_000, 256


def shingles(raw: bytes | None, size: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles; a shorter text is one shingle, no words are none."""
    parts: list[np.ndarray] = []
    tail: list[bytes] = []
    digest = xxhash.xxh64_intdigest
    for piece in plain_pieces(raw):
        words = tail + piece
        joined = b" ".join(words)
        ends = np.cumsum([len(w) + 1 for w in words]) - 1 if words else np.zeros(0, dtype=np.int64)
        starts = np.r_[0, ends[:-1] + 1][: max(0, len(words) - size + 1)].tolist()
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, ends[size - 1 :].tolist())]  # noqa: B905
        parts.append(np.unique(np.array(hashes, dtype=np.uint64)))
        tail = words[-(size - 1) :] if size > 1 else []
    if not sum(map(len, parts)) and tail:
        parts = [np.array([digest(b" ".join(tail), SEED)], dtype=np.uint64)]
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, dtype=np.uint64)


def class_of(found: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(found.tobytes(), SEED)


def minima(found: np.ndarray) -> np.ndarray:
    """The smallest of the shingles in each of ``HASHES`` orders."""
    least = np.full(HASHES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(found), 512):
        least = np.minimum(least, ((found[None, at : at + 512] ^ _FLIP) * _TIMES).min(axis=1))
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    rows = least.reshape(BANDS, BAND_ROWS)
    return np.array([xxhash.xxh64_intdigest(r.tobytes(), i) for i, r in enumerate(rows)], dtype=np.uint64).view(np.int64)


def bitmap(found: np.ndarray) -> bytes:
    """Parities of the shingles by hash: sets differ in at least as many shingles as their bitmaps in bits."""
    parity = np.bincount((found >> np.uint64(13)).astype(np.int64) % BITMAP, minlength=BITMAP) & 1
    return np.packbits(parity.astype(bool)).tobytes()


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, tie, class, keys, sketch, n, bits) of every row: hash of the text, of its shingle set, bands, a byte per order, its size and bitmap."""

    @tidy
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, keys, bytes_of, sizes, bits = [], [], [], [], []
            for text in binary_column(batch.column("text")):
                found = shingles(text, size)
                names.append(class_of(found))
                least = minima(found)
                keys.append(band_keys(least) if len(found) else np.zeros(0, dtype=np.int64))
                bytes_of.append((least >> np.uint64(20)).astype(np.uint8).tobytes())
                sizes.append(len(found))
                bits.append(bitmap(found))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("tie"), pa.array(np.array(names, dtype=np.uint64).view(np.int64)),
                 list_column(keys, pa.int64()), pa.array(bytes_of, pa.binary()), pa.array(sizes, pa.int64()), pa.array(bits, pa.binary())],
                names=["doc_id", "tie", "class", "keys", "sketch", "n", "bits"],
            )

    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", F.xxhash64("text").alias("tie"), "text")
    return rows.mapInArrow(make, f"doc_id {kind}, tie bigint, class bigint, keys array<bigint>, sketch binary, n bigint, bits binary")


def led_pairs(name: np.ndarray, sketch: np.ndarray, floor: float) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(leader, follower, agreeing hashes) of what seems similar; what seems similar enough leads nothing itself."""
    left, out = np.argsort(name), []
    while len(left) > 1:
        lead, left = left[0], left[1:]
        alike = (sketch[left] == sketch[lead]).sum(axis=1)
        near = alike >= HASHES * (floor - FIRST_SLACK)
        out.append((np.full(int(near.sum()), name[lead]), name[left[near]], alike[near]))
        left = left[alike < HASHES * floor]
    return out


def possible(n: np.ndarray, bits: np.ndarray, a: int, b: np.ndarray, floor: float) -> np.ndarray:
    """Which of ``b`` can be similar enough to ``a``: sizes and differing bits bound how much sets share."""
    need = np.ceil(floor * (n[a] + n[b]) / (1 + floor) - 1e-9)
    differ = np.bitwise_count(bits[b] ^ bits[a]).sum(axis=1, dtype=np.int64)
    return (np.minimum(n[a], n[b]) >= need) & (differ <= n[a] + n[b] - 2 * need)


def crossing_pairs(c: dict[str, np.ndarray], sketch: np.ndarray, first, second, floor: float, every: bool = True) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of a place in ``first`` and one in ``second`` that may reach the floor and are of different components.

    Without ``every`` only the most similar one for each place of ``first``.
    """
    name, component = c["class"], c["component"]
    out, others = [], {}
    same_cell = first is second
    for a in first:
        own = component[a]
        if own not in others:
            others[own] = second[component[second] != own]
        b = others[own]
        if same_cell:
            b = b[name[b] > name[a]]
        if len(b):
            b = b[possible(c["n"], c["bits"], a, b, floor)]
        if len(b):
            alike = (sketch[b] == sketch[a]).sum(axis=1)
            near = alike >= HASHES * (floor - SLACK)
            b, alike = b[near], alike[near]
            if not every and len(b):
                best = np.lexsort((name[b], -alike))[:1]
                b, alike = b[best], alike[best]
            out.append((np.full(len(b), name[a]), name[b], alike))
    return out


def _cells(names: list[str], rows: DataFrame, pairs_of) -> DataFrame:
    """Pairs (a, b, alike), a < b, that ``pairs_of`` finds in each group of ``names`` among ``rows``."""

    @released
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        whole = pa.Table.from_batches(held)
        group = np.column_stack([whole.column(n).to_numpy().astype(np.int64) for n in names])
        sketch = np.frombuffer(b"".join(whole.column("sketch").to_pylist()), dtype=np.uint8).reshape(-1, HASHES)
        rest = {n: whole.column(n).to_numpy() for n in whole.column_names if n not in ("sketch", "bits")}
        if "bits" in whole.column_names:
            rest["bits"] = np.frombuffer(b"".join(whole.column("bits").to_pylist()), dtype=np.uint64).reshape(-1, BITMAP // 64)
        _, group = np.unique(group, axis=0, return_inverse=True)
        group = group.ravel()
        order = np.argsort(group, kind="stable")
        for places in np.split(order, np.flatnonzero(np.diff(group[order])) + 1):
            found = pairs_of(places, rest, sketch) if len(places) > 1 else []
            if found:
                a, b, alike = (np.concatenate(x) for x in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(alike.astype(np.int64))], names=["a", "b", "alike"]
                )

    return rows.mapInArrow(compare, "a bigint, b bigint, alike bigint")


def _tasks(df: DataFrame, rows: int) -> int:
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows // TASK_ROWS)


def verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, size: int, floor: float) -> DataFrame:
    """The pairs whose shingle sets have a similarity of ``floor`` or more."""
    wanted = pairs.select(F.col("a").alias("class")).union(pairs.select("b")).distinct()
    ties = stored(classes.join(wanted, "class").select("tie"), "wanted")
    texts = docs.select(F.xxhash64("text").alias("tie"), "text").join(if_small(ties, 1_000_000), "tie")
    texts = texts.groupBy("tie").agg(F.first("text").alias("text"))

    @tidy
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(t, size) for t in binary_column(batch.column("text"))]
            names = np.array([class_of(f) for f in found], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(names), list_column([f.view(np.int64) for f in found], pa.int64())], names=["class", "shingles"]
            )

    held = stored(texts.mapInArrow(sets, "class bigint, shingles array<bigint>"), "shingles")
    one = held.select(F.col("class").alias("a"), F.col("shingles").alias("one"))
    other = held.select(F.col("class").alias("b"), F.col("shingles").alias("other"))
    both = spread_join(spread_join(pairs, one, ["a"], "inner", "b", PAIR_ROWS), other, ["b"], "inner", "a", PAIR_ROWS)

    @tidy
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, other = batch.column("one"), batch.column("other")
            keep = np.zeros(batch.num_rows, dtype=bool)
            for i in range(batch.num_rows):
                x, y = one[i].values.to_numpy().view(np.uint64), other[i].values.to_numpy().view(np.uint64)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep[i] = shared / (len(x) + len(y) - shared) >= floor
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep))

    return stored(both.select("a", "b", "one", "other").mapInArrow(check, "a bigint, b bigint"), "verified")


def links(
    docs: DataFrame, classes: DataFrame, size: int, floor: float, block_rows: int = BLOCK_ROWS, proposed: DataFrame | None = None
) -> DataFrame:
    """Edges (a, b) between classes, all of them verified, whose closure joins every pair found at the floor.

    Pairs ``proposed`` (a, b), a < b, are verified in the first round.
    """
    keyed = classes.select("class", F.explode("keys").alias("bucket"))
    counts = keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    shared = stored(counts.withColumn("cuts", F.ceil(F.col("rows") / block_rows).cast("int")), "shared")
    rows = shared.agg(F.sum("rows")).first()[0] or 0
    placed = keyed.join(if_small(shared.select("bucket", "cuts"), 1_000_000), "bucket")
    members = stored(placed.join(classes.select("class", "sketch"), "class"), "members")

    part = F.pmod(F.xxhash64("class", "bucket"), F.col("cuts")).cast("int")
    dealt = members.select("bucket", part.alias("part"), "class", "sketch").repartition(_tasks(docs, rows), "bucket", "part")
    pairs = _cells(["bucket", "part"], dealt, lambda at, c, s: led_pairs(c["class"][at], s[at], floor))
    # each class follows the leader that seems most similar
    led = pairs.groupBy("b").agg(F.min(F.struct((-F.col("alike")).alias("order"), "a")).alias("best")).select("best.a", "b")
    led = led.select("a", "b") if proposed is None else led.select("a", "b").union(proposed).distinct()
    first = verified(stored(led, "pairs"), docs, classes, size, floor)

    edges = first
    for every in (False, True):
        pairs = _crossing(docs, classes, members, edges, rows, floor, every)
        if not every:  # first only the most similar partner of each class, which joins most of what belongs together
            both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "alike"))
            best = both.groupBy("a").agg(F.min(F.struct((-F.col("alike")).alias("order"), "b")).alias("best")).select("a", "best.b")
            pairs = best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        edges = edges.unionByName(verified(stored(pairs.select("a", "b").distinct(), "pairs"), docs, classes, size, floor))
    return edges


def _crossing(docs: DataFrame, classes: DataFrame, members: DataFrame, edges: DataFrame, rows: int, floor: float, every: bool) -> DataFrame:
    """Pairs (a, b, alike) that share a bucket, may reach the floor and are not joined by ``edges``."""
    joined = smallest_reachable(edges).select(F.col("node").alias("class"), "component")
    now = members.select("bucket", "class", "cuts").join(joined, "class", "left").withColumn("component", F.coalesce("component", "class"))
    now = stored(now, "members")
    mixed = now.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high")
    now = now.join(if_small(stored(mixed.select("bucket"), "mixed"), 1_000_000), "bucket").join(classes.select("class", "sketch", "n", "bits"), "class")
    mine = F.pmod(F.xxhash64("class"), F.col("cuts")).cast("int")
    cells = now.select("*", mine.alias("mine"), F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("other"))
    cells = cells.select("bucket", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"), "mine", "class", "component", "sketch", "n", "bits")
    cells = cells.repartition(_tasks(docs, rows), "bucket", "low", "high")

    def crossing(at, c, s):
        first, second = at[c["mine"][at] == c["low"][at]], at[c["mine"][at] == c["high"][at]]
        inside = c["low"][at[0]] == c["high"][at[0]]
        return crossing_pairs(c, s, first, first if inside else second, floor, every)

    return stored(_cells(["bucket", "low", "high"], cells, crossing), "crossing")


def _class_pairs(proposed: DataFrame, prints: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs of classes (a, b), a < b and neither of them empty, from pairs of ids (doc_id, other)."""
    of_id = prints.filter("n > 0 and doc_id is not null").select("doc_id", "class").join(classes.select("class"), "class", "left_semi").distinct()
    one, other = of_id.toDF("doc_id", "u"), of_id.toDF("other", "v")
    both = spread_join(proposed.filter("doc_id <> other").select("doc_id", "other"), other, ["other"], "inner", "doc_id").join(one, "doc_id")
    return both.filter("u <> v").select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct()


def near_copies(
    docs: DataFrame, floor: float = 0.8, size: int = 5, id_col: str = "doc_id", text_col: str = "text", block_rows: int = BLOCK_ROWS,
    proposed: DataFrame | None = None,
) -> DataFrame:
    """Per row of ``docs``: doc_id and component_id, the smallest id reachable over near copies, its own included.

    Null and texts without words have the same, empty set.  Rows without an id get the component of the rows with
    the same set, null if none of them has an id, and link nothing.  Rows sharing an id are one document, repeated
    rows one class.  Texts of any length count whole; other columns are not passed on.  An empty table gives none.
    """
    rows = narrow(docs, doc_id=id_col, text=text_col)
    prints = stored(sketches(rows, size), "sketches")
    classes = prints.groupBy("class").agg(
        F.min("doc_id").cast("bigint").alias("node"), F.min("tie").alias("tie"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch"),
        F.first("n").alias("n"), F.first("bits").alias("bits"),
    )
    classes = stored(classes.filter("node is not null"), "classes")
    if proposed is not None:
        proposed = _class_pairs(proposed, prints, classes)
    found = links(rows, classes, size, floor, block_rows, proposed)
    nodes = classes.select("class", "node")
    found = found.join(nodes.toDF("a", "u"), "a").join(nodes.toDF("b", "v"), "b").select(F.col("u").alias("a"), F.col("v").alias("b"))
    by_id = prints.filter("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("a"), "class").join(nodes, "class")
    several = by_id.select("a", F.col("node").alias("b")).filter("a <> b")
    shared = by_id.groupBy("a").agg(F.min("node").alias("b"), F.max("node").alias("c")).filter("b < c").select("a")
    component = smallest_reachable(found.unionByName(several.join(shared, "a", "left_semi")).distinct())
    named = nodes.join(component, "node", "left").select("class", F.coalesce("component", "node").alias("component_id"))
    return prints.select("doc_id", "class").join(named, "class", "left").select("doc_id", "component_id")
