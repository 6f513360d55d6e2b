"""SimHash near-dedup with the generalised pigeonhole principle.

Fingerprints that are equal are first made one row (with the smallest document id).  Their 64 bits are put
into ``m`` partitions, correlated bits together.  Two fingerprints within ``radius`` bits differ, in at least
one partition i, by no more than T_i bits, for any integers T_i >= -1 with sum radius - m + 1 (-1: the
partition is not looked at).  Every fingerprint is stored once per partition; as a probe it chooses its own
thresholds by dynamic programming over the partitions, with candidate counts estimated from histograms of
sub-blocks of each partition over all fingerprints.  So a fingerprint in a crowded bucket does not ask there.

Probes and stored rows meet by (partition, value).  A task compares them bit by bit in numpy and returns a
spanning forest of the links it finds, never the pairs.  Buckets over ``BLOCK_ROWS`` are cut into a grid of
blocks, all of which meet.  The forests' edges go through connected components (``components.py``).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm.components import smallest_reachable
from recollect.llm.tables import if_small, narrow
from recollect.llm.words import binary_column, plain_pieces, tidy
from recollect.plans.materialize import stored

#: Fixed by the contract.
SEED = 42
BITS = 64
#: Rows of one bucket that one task compares with another block at once.
BLOCK_ROWS = 20_000
#: Rows (stored and probes) for one task of the bucket join.
TASK_ROWS = 1_000_000
#: Pairs compared at once in a task.
PAIRS = 250_000
#: Cost of sending a probe, in comparisons.
PROBE_COST = 40.0
#: Widest sub-block of a partition that has a histogram of its own.
SUB_BITS = 11


def fingerprint(raw: bytes | None, size: int = 4, distinct: bool = False) -> int:
    """SimHash of a text's word shingles; ``distinct`` counts each shingle once.  No words: 0."""
    totals, n = np.zeros(BITS, dtype=np.int64), 0
    tail: list[bytes] = []
    seen: set[int] = set()
    digest = xxhash.xxh64_intdigest
    for piece in plain_pieces(raw):
        words = tail + piece
        joined = b" ".join(words)
        ends = np.cumsum([len(w) + 1 for w in words]) - 1 if words else np.zeros(0, dtype=np.int64)
        starts = np.r_[0, ends[:-1] + 1][: max(0, len(words) - size + 1)].tolist()
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, ends[size - 1 :].tolist())]  # noqa: B905
        if distinct:
            hashes = [h for h in dict.fromkeys(hashes) if h not in seen]
            seen.update(hashes)
        n += len(hashes)
        totals += _bit_counts(hashes)
        tail = words[-(size - 1) :] if size > 1 else []
    if not n and tail:
        totals, n = _bit_counts([digest(b" ".join(tail), SEED)]), 1
    return int(np.packbits(totals * 2 > n, bitorder="little").view("<u8")[0])


def _bit_counts(hashes: list[int]) -> np.ndarray:
    total = np.zeros(BITS, dtype=np.int64)
    for i in range(0, len(hashes), 65536):
        part = np.array(hashes[i : i + 65536], dtype="<u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return total


def fingerprints(docs: DataFrame, size: int = 4, distinct: bool = False, confirm_size: int | None = None) -> DataFrame:
    """(doc_id, fp, confirm) of every row of ``docs`` (doc_id, text); fingerprints are signed longs.

    ``confirm`` is a second fingerprint over shingles of ``confirm_size`` words, by default the same one.
    """

    @tidy
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = binary_column(batch.column("text"))
            first = np.array([fingerprint(t, size, distinct) for t in texts], dtype=np.uint64).view(np.int64)
            second = first
            if confirm_size is not None:
                second = np.array([fingerprint(t, confirm_size) for t in texts], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(first), pa.array(second)], names=["doc_id", "fp", "confirm"]
            )

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(make, f"doc_id {kind}, fp bigint, confirm bigint")


# ---- partitions and thresholds


@dataclass(frozen=True)
class Layout:
    """Bits of each partition, its sub-blocks as (first bit in the partition, width), and their histograms."""

    partitions: list[list[int]]
    blocks: list[list[tuple[int, int]]]
    shares: list[list[np.ndarray]]  # share of all fingerprints by value, for each sub-block
    total: int
    radius: int

    def values(self, fps: np.ndarray, i: int) -> np.ndarray:
        """The bits of partition i, gathered."""
        out = np.zeros(len(fps), dtype=np.uint64)
        for to, bit in enumerate(self.partitions[i]):
            out |= ((fps >> np.uint64(bit)) & np.uint64(1)) << np.uint64(to)
        return out


def correlated_groups(together: np.ndarray, ones: np.ndarray, total: int, m: int) -> list[list[int]]:
    """Greedy groups of equal size: each starts at a free bit and takes the free bits most correlated with it."""
    p = ones / max(1, total)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    linked = np.abs((together / max(1, total) - np.outer(p, p)) / np.outer(sd, sd))
    np.fill_diagonal(linked, 0)
    free, groups = list(range(BITS)), []
    for i in range(m):
        width = BITS // m + (i < BITS % m)
        group = [max(free, key=lambda b: (linked[b, free].max(), -b))]
        free.remove(group[0])
        while len(group) < width:
            group.append(max(free, key=lambda b: (linked[b, group].mean(), -b)))
            free.remove(group[-1])
        groups.append(sorted(group))
    return groups


def _blocks(width: int) -> list[tuple[int, int]]:
    n = -(-width // SUB_BITS)
    sizes = [width // n + (i < width % n) for i in range(n)]
    return [(sum(sizes[:i]), w) for i, w in enumerate(sizes)]


def _popcount_table(width: int) -> np.ndarray:
    return np.bitwise_count(np.arange(1 << width, dtype=np.uint64)).astype(np.int64)


def within(share: np.ndarray, most: int) -> np.ndarray:
    """For every value of a sub-block, the share of fingerprints at distance 0, 1, ... ``most`` from it."""
    width = len(share).bit_length() - 1
    out, values = np.zeros((most + 1, len(share))), np.arange(len(share))
    for d in range(min(most, width) + 1):
        for bits in combinations(range(width), d):
            out[d] += share[values ^ sum(1 << b for b in bits)]
    return out


def candidate_counts(layout: Layout, fps: np.ndarray, most: int, tables: list[list[np.ndarray]]) -> np.ndarray:
    """Estimated candidates [partition, T + 1, fingerprint] for T from -1 to ``most``: sub-blocks as if independent."""
    out = np.zeros((len(layout.partitions), most + 2, len(fps)))
    for i, blocks in enumerate(layout.blocks):
        value = layout.values(fps, i)
        near = None
        for (start, width), table in zip(blocks, tables[i], strict=True):
            part = table[:, ((value >> np.uint64(start)) & np.uint64((1 << width) - 1)).astype(np.int64)]
            if near is None:
                near = part
            else:
                near = np.stack([sum(near[a] * part[d - a] for a in range(d + 1)) for d in range(most + 1)])
        out[i, 1:] = np.cumsum(near, axis=0) * layout.total
    return out


def allocate(costs: np.ndarray, total: int) -> np.ndarray:
    """Thresholds [partition, fingerprint] of least summed cost with sum ``total``, by dynamic programming.

    ``costs[i, t + 1]`` is the cost of threshold t in partition i.
    """
    m, levels, n = costs.shape
    need = total + m  # with thresholds counted from 0
    best = np.full((need + 1, n), np.inf)
    best[0] = 0
    choice = np.zeros((m, need + 1, n), dtype=np.int8)
    for i in range(m):
        new = np.full_like(best, np.inf)
        for t in range(levels):
            for s in range(need + 1 - t):
                value = best[s] + costs[i, t]
                better = value < new[s + t]
                new[s + t][better] = value[better]
                choice[i, s + t][better] = t
        best = new
    out, at = np.zeros((m, n), dtype=np.int64), np.full(n, need)
    for i in reversed(range(m)):
        t = choice[i, at, np.arange(n)].astype(np.int64)
        out[i] = t - 1
        at = at - t
    return out


def masks(width: int, most: int) -> list[np.ndarray]:
    """Values to flip for distance exactly 0, 1, ... ``most``."""
    return [
        np.array([sum(1 << b for b in bits) for bits in combinations(range(width), d)], dtype=np.uint64)
        for d in range(most + 1)
    ]


def statistics(fps: DataFrame) -> tuple[np.ndarray, int]:
    """How often each two bits are set together (64 x 64, the ones on the diagonal), over all fingerprints."""

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            bits = np.unpackbits(batch.column("fp").to_numpy().view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            bits = bits.astype(np.float32)
            total += bits.T @ bits
            n += len(bits)
        cells = np.r_[total.ravel(), n].astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cells))), pa.array(cells)], names=["cell", "n"])

    rows = fps.select("fp").mapInArrow(gram, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n"))
    cells = np.zeros(BITS * BITS + 1)
    for r in rows.collect():  # 4,097 rows at any size
        cells[r.cell] = r.n
    return cells[:-1].reshape(BITS, BITS), int(cells[-1])


def histograms(fps: DataFrame, partitions: list[list[int]]) -> list[list[np.ndarray]]:
    """Counts of every sub-block's values over all fingerprints: at most 2 ** SUB_BITS values for each."""
    empty = Layout(partitions, [_blocks(len(p)) for p in partitions], [], 0, 0)
    spots = [(i, j) for i, b in enumerate(empty.blocks) for j in range(len(b))]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [np.zeros(1 << empty.blocks[i][j][1], dtype=np.int64) for i, j in spots]
        for batch in batches:
            fps = batch.column("fp").to_numpy().view(np.uint64)
            for total, (i, j) in zip(totals, spots, strict=True):
                start, width = empty.blocks[i][j]
                value = (empty.values(fps, i) >> np.uint64(start)) & np.uint64((1 << width) - 1)
                total += np.bincount(value.astype(np.int64), minlength=len(total))
        for k, total in enumerate(totals):
            hit = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(hit), k, dtype=np.int32)), pa.array(hit), pa.array(total[hit])], names=["spot", "value", "n"]
            )

    rows = fps.select("fp").mapInArrow(count, "spot int, value bigint, n bigint").groupBy("spot", "value").agg(F.sum("n").alias("n"))
    out = [np.zeros(1 << empty.blocks[i][j][1]) for i, j in spots]
    for r in rows.collect():
        out[r.spot][r.value] = r.n
    return [[out[spots.index((i, j))] for j in range(len(b))] for i, b in enumerate(empty.blocks)]


def choose_partitions(total: int, radius: int) -> int:
    """The number of partitions with the least expected cost for evenly spread values."""

    def cost(m: int) -> float:
        widths = [BITS // m + (i < BITS % m) for i in range(m)]
        reach = radius - m + 1
        table = np.full((m, reach + m + 2, 1), np.inf)
        for i, w in enumerate(widths):
            table[i, 0] = 0
            for t in range(min(reach + m, w) + 1):
                near = sum(len(list(combinations(range(w), d))) if d < 3 else w**d / 6 for d in range(t + 1))
                table[i, t + 1] = near * (PROBE_COST + total / 2.0**w)
        chosen = allocate(table, reach)
        return sum(float(table[i, chosen[i, 0] + 1, 0]) for i in range(m))

    return min(range(2, radius + 2), key=cost) if radius > 0 else 1


def plan_layout(fps: DataFrame, radius: int) -> Layout:
    together, total = statistics(fps)
    m = choose_partitions(total, radius)
    partitions = correlated_groups(together, np.diag(together).copy(), total, m)
    counts = histograms(fps, partitions)
    shares = [[c / max(1, total) for c in of] for of in counts]
    return Layout(partitions, [_blocks(len(p)) for p in partitions], shares, total, radius)


# ---- probing


def stored_rows(nodes: DataFrame, layout: Layout) -> DataFrame:
    """Bucket of every node in every partition."""
    shared = nodes.sparkSession.sparkContext.broadcast(layout.partitions)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layout = Layout(shared.value, [], [], 0, 0)
        for batch in batches:
            fps = batch.column("fp").to_numpy().view(np.uint64)
            for i in range(len(layout.partitions)):
                keys = layout.values(fps, i) | np.uint64(i) << np.uint64(56)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64))], names=["bucket"])

    return nodes.select("fp").mapInArrow(emit, "bucket bigint")


def bucket_rows(nodes: DataFrame, layout: Layout) -> DataFrame:
    """(bucket, node, fp, confirm, asks): every node once per partition, and its probes."""
    shared = nodes.sparkSession.sparkContext.broadcast(layout)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layout: Layout = shared.value
        m = len(layout.partitions)
        total = layout.radius - m + 1
        most = min(max(total + m - 1, 0), 3)
        tables = [[within(s, most) for s in of] for of in layout.shares]
        flips = [masks(len(p), most) for p in layout.partitions]
        sent = np.array([[0, *np.cumsum([len(f) for f in of])] for of in flips], dtype=np.float64)
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                fps = batch.column("fp").to_numpy().view(np.uint64)
                node, confirm = batch.column("node").to_numpy(), batch.column("confirm").to_numpy()
                costs = candidate_counts(layout, fps, most, tables) + PROBE_COST * sent[:, :, None]
                thresholds = allocate(costs, total)
                for i in range(m):
                    own, base = layout.values(fps, i), np.uint64(i) << np.uint64(56)
                    yield _rows(base | own, node, fps, confirm, False)
                    for d in range(most + 1):
                        asking = np.flatnonzero(thresholds[i] >= d)
                        if len(asking):
                            keys = (own[asking, None] ^ flips[i][d][None, :]).ravel()
                            who = np.repeat(asking, len(flips[i][d]))
                            yield _rows(base | keys, node[who], fps[who], confirm[who], True)

    return nodes.mapInArrow(emit, "bucket bigint, node bigint, fp bigint, confirm bigint, asks boolean")


def _rows(bucket, node, fps, confirm, asks: bool) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(bucket.view(np.int64)), pa.array(node), pa.array(fps.view(np.int64)), pa.array(confirm),
         pa.array(np.full(len(node), asks))],
        names=["bucket", "node", "fp", "confirm", "asks"],
    )


class Forest:
    """Union-find over places 0 .. n-1, whole arrays of links at a time."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            ra, rb = self.root[a], self.root[b]
            apart = ra != rb
            if not apart.any():
                return
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(self.root, np.maximum(ra, rb), np.minimum(ra, rb))
            while True:
                up = self.root[self.root]
                if (up == self.root).all():
                    break
                self.root = up


def forest_edges(bucket, node, fp, confirm, asks, radius: int, confirm_radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning edges (node, smaller root) of all links between probes and stored rows of the same bucket."""
    nodes, place = np.unique(node, return_inverse=True)  # sorted, so that roots are the smallest nodes
    forest = Forest(len(nodes))
    kept, ask = np.flatnonzero(~asks), np.flatnonzero(asks)
    kept = kept[np.argsort(bucket[kept], kind="stable")]
    keys = bucket[kept]
    first, last = np.searchsorted(keys, bucket[ask], "left"), np.searchsorted(keys, bucket[ask], "right")
    ask, first, last = ask[last > first], first[last > first], last[last > first]
    sizes = last - first
    bounds = np.r_[0, np.cumsum(sizes)]
    at = 0
    while at < len(ask):
        end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + PAIRS, "right")) - 1)
        k = sizes[at:end]
        a = np.repeat(ask[at:end], k)
        b = kept[np.arange(bounds[at], bounds[end]) - np.repeat(bounds[at:end], k) + np.repeat(first[at:end], k)]
        near = np.bitwise_count(fp[a] ^ fp[b]) <= radius
        a, b = a[near], b[near]
        near = (np.bitwise_count(confirm[a] ^ confirm[b]) <= confirm_radius) & (node[a] != node[b])
        forest.link(place[a[near]], place[b[near]])
        at = end
    linked = np.flatnonzero(forest.root != np.arange(len(nodes)))
    return nodes[linked], nodes[forest.root[linked]]


def links(nodes: DataFrame, radius: int, confirm_radius: int = BITS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Edges (a, b) whose closure joins all rows of ``nodes`` (node, fp, confirm) within the radii of each other."""
    layout = plan_layout(nodes, radius)
    rows = bucket_rows(nodes, layout)
    # buckets with more stored rows than a block become a grid of cells
    own = stored_rows(nodes, layout).groupBy("bucket").count().filter(F.col("count") > block_rows)
    crowded = stored(own.select("bucket", F.ceil(F.col("count") / block_rows).cast("int").alias("cuts")), "crowded")
    cut = rows.join(if_small(crowded, 100_000), "bucket", "left").withColumn("cuts", F.coalesce("cuts", F.lit(1)))
    mine = F.pmod(F.xxhash64("node"), F.col("cuts")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("cuts") - 1))
    cells = cut.select("*", mine.alias("mine"), other.alias("other")).select(
        "bucket", "node", "fp", "confirm", "asks",
        F.when(F.col("asks"), F.col("mine")).otherwise(F.col("other")).alias("asking"),
        F.when(F.col("asks"), F.col("other")).otherwise(F.col("mine")).alias("asked"),
    )
    tasks = max(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), layout.total * 64 // TASK_ROWS)
    dealt = cells.repartition(tasks, "bucket", "asking", "asked")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = [
            [np.asarray(c) for c in (b.column("bucket"), b.column("asking"), b.column("asked"), b.column("node"), b.column("fp"), b.column("confirm"), b.column("asks"))]
            for b in batches
            if b.num_rows
        ]
        if columns:
            bucket, asking, asked, node, fp, confirm, asks = (np.concatenate(c) for c in zip(*columns, strict=True))
            del columns
            if asking.any() or asked.any():
                _, bucket = np.unique(np.column_stack([bucket, asking, asked]), axis=0, return_inverse=True)
                bucket = bucket.ravel()
            a, b = forest_edges(bucket, node, fp.view(np.uint64), confirm.view(np.uint64), asks, radius, confirm_radius)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return dealt.mapInArrow(compare, "a bigint, b bigint").distinct()


def near_duplicates(
    docs: DataFrame, size: int = 4, radius: int = 4, distinct: bool = False, confirm_size: int | None = None,
    confirm_radius: int = BITS, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Per row of ``docs``: doc_id, fingerprint (16 hex digits) and component_id.

    Fingerprints link at ``radius`` or fewer differing bits (and, where ``confirm_size`` is given, when their
    second fingerprints differ in at most ``confirm_radius``).  ``component_id`` is the smallest id reachable
    over links, the row's own included.

    Null and empty texts have fingerprint zero, linked like any other.  Rows without an id get a fingerprint
    and the component of the rows with the same fingerprint, null if none of them has an id.  Rows sharing an
    id are one document: what they link to is joined.  An empty table gives none.  Ids are integers.
    """
    prints = stored(fingerprints(narrow(docs, doc_id=id_col, text=text_col), size, distinct, confirm_size), "fingerprints")
    same = ["fp", "confirm"]
    classes = stored(prints.groupBy(*same).agg(F.min("doc_id").cast("bigint").alias("node")).filter("node is not null"), "classes")
    by_id = prints.filter("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("a"), *same).join(classes, same)
    shared = by_id.select("a", F.col("node").alias("b")).groupBy("a").agg(F.min("b").alias("b"), F.max("b").alias("c")).filter("b < c")
    several = by_id.join(shared.select("a"), "a", "left_semi").select("a", F.col("node").alias("b")).filter("a <> b")
    found = links(classes, radius, confirm_radius).unionByName(several).distinct()
    component = smallest_reachable(found)
    named = classes.join(component, "node", "left").select(*same, F.coalesce("component", "node").alias("component_id"))
    return prints.join(named, same, "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
