"""Jaccard join of word n-grams as a T-occurrence search.

Rows with the same set of n-grams are one class.  Two sets x and y reach the similarity only if they share T of
their elements, T growing with both sizes; so each must be found on T of the other's inverted lists.  DivideSkip
splits the lists of a set by length: all but the T - c longest are *short* and merged, and whatever is on fewer than
c of them cannot reach T with the long ones.  Candidates are then probed on the long lists.

In Spark terms:

* How long a list is, is counted over all rows: a task counts the elements of a few million occurrences at a time and
  reports those it saw several times.  The sums order the elements, the rarest first, the same way for every set (an
  element that is not among the reported ones counts as rare).  The order decides the work, never the result.
* A set is posted only on its short lists, rarest first, with its place.  Lists with one posting drop out.
* Merging: postings are shuffled and sorted by list, lists longer than ``BLOCK_ROWS`` being cut into a grid of cells
  that all meet.  A cell gives the pairs that sizes, places and bitmaps (parities of hashed elements, whose difference
  bounds that of the sets) leave possible; a count per pair keeps those found on c short lists.
* Probing: the pairs of one set meet its sorted elements in one task (cut by partner where there are many), the
  partners stream past and are looked up by binary search, given up as soon as T is out of reach.  Asking a long list
  for a candidate and asking the candidate's sorted elements for the list's n-gram are the same question.

A group of many near copies must not become all its pairs.  Before the merge, members of a long list follow a leader:
in each random part of the list, the first set that they may be similar to.  Every set keeps the few leaders or followers
whose bitmaps differ least, those pairs are probed, and what is linked becomes components.  The merge then only takes pairs of different components, and
probes first the one of each set whose bitmap differs least, then what is still not joined.  So a pair is passed over
only when probed links already join it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recollect.llm.components import smallest_reachable
from recollect.llm.copies import shingles
from recollect.llm.tables import if_small, narrow
from recollect.llm.words import binary_column, list_column, released, tidy
from recollect.plans.materialize import stored
from recollect.plans.spread import spread_join

SEED = 42
#: c: on so many of its short lists a candidate must be found.
FOUND_ON = 2
#: Occurrences counted at a time, and how often an element must be among them to be reported.
COUNTED, REPORTED = 4_000_000, 4
#: Elements with a list length of their own (12 bytes each, broadcast); all others count as rare.
ORDERED = 1_000_000
#: Bits of a set's bitmap.
BITMAP = 256
#: Postings of one list that one task compares with each other or with as many others.
BLOCK_ROWS = 2_000
#: Lists with more postings have leaders; of shorter ones there are at most so many pairs for each posting.
LED_ROWS = 8
#: Bits in which sets that are not related differ much less often; only such a leader counts on lists up to ``SHORT_ROWS``.
LIKELY = BITMAP // 4
#: Leaders (or followers) of a set that are probed where so few bits differ, else one, and an odd number that mixes names into an order.
LEADERS, MIX = 6, np.int64(-7046029254386353131)
#: Pairs of lists with no more postings are compared all at once.
SHORT_ROWS = 32
#: Postings for one task of the merge, and pairs of one set that are probed together.
TASK_ROWS, PAIR_ROWS = 200_000, 128
#: Elements probed before the count is looked at; pairs compared at once.
STRIP, PAIRS = 1_024, 500_000
#: Rows of a list of texts that may be broadcast.
SMALL = 1_000_000


def needed(n, m, percent: int):
    """T: the least overlap of sets of ``n`` and ``m`` elements that are similar enough."""
    return -((n + m) * -percent // (100 + percent))


def least_needed(n, percent: int):
    """The least overlap of a set of ``n`` elements with any set it is similar enough to."""
    return -(n * -percent // 100)


def list_lengths(docs: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The elements reported most often, sorted, and about how many rows have them."""

    @tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def report() -> pa.RecordBatch:
            found, seen = np.unique(np.concatenate(held), return_counts=True)
            many = seen >= REPORTED
            return pa.RecordBatch.from_arrays([pa.array(found[many].view(np.int64)), pa.array(seen[many])], names=["element", "seen"])

        for batch in batches:
            for text in binary_column(batch.column("text")):
                found = shingles(text, size)
                held.append(found)
                rows += len(found)
                if rows >= COUNTED:
                    yield report()
                    held, rows = [], 0
        if rows:
            yield report()

    seen = docs.select("text").mapInArrow(count, "element bigint, seen bigint").groupBy("element").agg(F.sum("seen").alias("seen"))
    top = seen.orderBy(F.desc("seen"), "element").limit(ORDERED).toArrow()
    elements = top.column("element").to_numpy().view(np.uint64)
    order = np.argsort(elements)
    return elements[order], np.minimum(top.column("seen").to_numpy(), 2**31 - 1).astype(np.int32)[order]


def bitmap(found: np.ndarray) -> bytes:
    parity = np.bincount((found >> np.uint64(17)).astype(np.int64) % BITMAP, minlength=BITMAP) & 1
    return np.packbits(parity.astype(bool)).tobytes()


def short_lists(found: np.ndarray, known: np.ndarray, lengths: np.ndarray, percent: int) -> np.ndarray:
    """The elements of a set on whose lists it is posted, rarest first."""
    n, least = len(found), least_needed(len(found), percent)
    length = np.zeros(n, dtype=np.int32)
    if len(known):
        at = np.minimum(np.searchsorted(known, found), len(known) - 1)
        length = np.where(known[at] == found, lengths[at], 0)
    return found[np.lexsort((found, length))][: n - least + min(FOUND_ON, least)]


def posted_sets(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """(doc_id, tie, class, n, lists, bits) of every row: text hash, set hash, set size, short lists, bitmap."""
    order = docs.sparkSession.sparkContext.broadcast(list_lengths(docs, size))

    @tidy
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, lengths = order.value
        for batch in batches:
            names, sizes, lists, bits = [], [], [], []
            for text in binary_column(batch.column("text")):
                found = shingles(text, size)
                names.append(xxhash.xxh64_intdigest(found.tobytes(), SEED))
                sizes.append(len(found))
                lists.append((short_lists(found, known, lengths, percent) if len(found) else found).view(np.int64))
                bits.append(bitmap(found))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("tie"), pa.array(np.array(names, dtype=np.uint64).view(np.int64)),
                 pa.array(sizes, pa.int64()), list_column(lists, pa.int64()), pa.array(bits, pa.binary())],
                names=["doc_id", "tie", "class", "n", "lists", "bits"],
            )

    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", F.xxhash64("text").alias("tie"), "text")
    return rows.mapInArrow(make, f"doc_id {kind}, tie bigint, class bigint, n bigint, lists array<bigint>, bits binary")


FOUND = "a bigint, b bigint, least bigint, differ bigint"


class Postings:
    """Columns of the postings a task compares, and which pairs of their places may be similar enough."""

    def __init__(self, whole: pa.Table, percent: int):
        self.percent = percent
        self.name, self.n, self.at = (whole.column(c).to_numpy() for c in ("class", "n", "pos"))
        self.bits = np.frombuffer(b"".join(whole.column("bits").to_pylist()), dtype=np.uint64).reshape(-1, BITMAP // 64)

    def differ(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Bits in which the bitmaps differ: no more than the elements that are in one set only."""
        return np.bitwise_count(self.bits[a] ^ self.bits[b]).sum(axis=1, dtype=np.int64)

    def possible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which pairs of places can share enough, given sizes, places on the lists, and bitmaps."""
        na, nb = self.n[a], self.n[b]
        need = needed(na, nb, self.percent)
        # of the first c shared elements, at most c - 1 come before this one
        rest = np.minimum(na - self.at[a], nb - self.at[b]) + (FOUND_ON - 1)
        out = (np.minimum(na, nb) >= need) & (rest >= need)
        left = np.flatnonzero(out)
        if len(left):
            out[left] = self.differ(a[left], b[left]) <= na[left] + nb[left] - 2 * need[left]
        return out


def group_places(whole: pa.Table, names: list[str]) -> list[np.ndarray]:
    """Places of the rows of each group of ``names``."""
    columns = [whole.column(n).to_numpy() for n in names]
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), dtype=bool)
    for c in columns:
        new[1:] |= c[order][1:] != c[order][:-1]
    return np.split(order, np.flatnonzero(new))


def led_pairs(p: Postings, places: np.ndarray, turn: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(leader, follower) places of one part of a list, in order of ``turn``: who may be similar to a leader leads nobody."""
    left = places[np.argsort(turn[places], kind="stable")]
    while len(left) > 1:
        lead, left = left[0], left[1:]
        near = p.possible(np.full(len(left), lead), left)
        if len(places) <= SHORT_ROWS:
            near[near] = p.differ(np.full(int(near.sum()), lead), left[near]) <= LIKELY
        yield np.full(int(near.sum()), lead), left[near]
        left = left[~near]


def pairs_of_short(p: Postings, groups: list[np.ndarray], component: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All possible pairs of different components within each of many small groups."""
    if not groups:
        return
    places = np.concatenate(groups)
    sizes = np.array([len(g) for g in groups])
    end = np.repeat(np.cumsum(sizes), sizes)
    at = np.arange(len(places))
    for step in range(1, int(sizes.max())):
        at = at[at + step < end[at]]
        for cut in range(0, len(at), PAIRS):
            a, b = places[at[cut : cut + PAIRS]], places[at[cut : cut + PAIRS] + step]
            other = component[a] != component[b]
            a, b = a[other], b[other]
            keep = p.possible(a, b)
            yield a[keep], b[keep]


def pairs_across(p: Postings, first: np.ndarray, second: np.ndarray, component: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Possible pairs of different components of a place in ``first`` and one in ``second``, each pair once."""
    same = first is second
    others: dict[int, np.ndarray] = {}
    for a in first.tolist():
        own = int(component[a])
        if own not in others:
            others[own] = second[component[second] != own]
        b = others[own]
        if same:
            b = b[p.name[b] > p.name[a]]
        if len(b):
            b = b[p.possible(np.full(len(b), a), b)]
            yield np.full(len(b), a), b


def _pairs(p: Postings, found: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Batches (a, b, least, differ) of class pairs, a < b, on how many short lists they meet if they are similar enough, and differing bits."""
    left, right, rows = [], [], 0

    def batch() -> pa.RecordBatch:
        a, b = np.concatenate(left), np.concatenate(right)
        least = np.minimum(FOUND_ON, least_needed(np.minimum(p.n[a], p.n[b]), p.percent))
        differ, a, b = p.differ(a, b), p.name[a], p.name[b]
        return pa.RecordBatch.from_arrays(
            [pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(least), pa.array(differ)], names=["a", "b", "least", "differ"]
        )

    for a, b in found:
        if len(a):
            left.append(a)
            right.append(b)
            rows += len(a)
        if rows > PAIRS:
            yield batch()
            left, right, rows = [], [], 0
    if rows:
        yield batch()


def _held(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    held = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(held) if held else None


def _tasks(df: DataFrame, rows: int) -> int:
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows // TASK_ROWS)


def reaches(one: np.ndarray, other: np.ndarray, need: int) -> bool:
    """Whether two sorted sets share ``need`` elements, by binary probes of the larger."""
    if len(one) > len(other):
        one, other = other, one
    shared, left = 0, len(one)
    for at in range(0, len(one), STRIP):
        if shared + left < need or shared >= need:
            break
        strip = one[at : at + STRIP]
        place = np.minimum(np.searchsorted(other, strip), len(other) - 1)
        shared += int((other[place] == strip).sum())
        left -= len(strip)
    return shared >= need


def probed(pairs: DataFrame, docs: DataFrame, classes: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""
    wanted = pairs.select(F.col("a").alias("class")).union(pairs.select("b")).distinct()
    texts = stored(classes.join(wanted, "class").select(F.col("node").alias("doc_id"), "tie"), "wanted")
    rows = docs.select("doc_id", F.xxhash64("text").alias("tie"), "text").join(if_small(texts, SMALL), ["doc_id", "tie"], "left_semi")

    @tidy
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(t, size) for t in binary_column(batch.column("text"))]
            names = np.array([xxhash.xxh64_intdigest(f.tobytes(), SEED) for f in found], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(names), list_column([f.view(np.int64) for f in found], pa.int64())], names=["class", "elements"]
            )

    held = stored(rows.select("text").mapInArrow(sets, "class bigint, elements array<bigint>"), "sets")
    many = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > PAIR_ROWS)
    many = many.select("a", F.ceil(F.col("rows") / PAIR_ROWS).cast("int").alias("cuts"))
    dealt = pairs.join(many, "a", "left").withColumn("part", F.pmod(F.xxhash64("b"), F.coalesce("cuts", F.lit(1))).cast("int"))
    dealt = stored(dealt.select("a", "b", "part"), "dealt")
    asked = dealt.select("a", "part").distinct().join(held.withColumnRenamed("class", "a"), "a")
    asked = asked.select("a", "part", F.lit(False).alias("probes"), F.col("a").alias("b"), "elements")
    probes = spread_join(dealt, held.withColumnRenamed("class", "b"), ["b"], "inner", "a", PAIR_ROWS)
    probes = probes.select("a", "part", F.lit(True).alias("probes"), "b", "elements")
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), dealt.count() // PAIR_ROWS)
    placed = asked.unionByName(probes).repartition(tasks, "a", "part").sortWithinPartitions("a", "part", "probes")

    @tidy
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = np.zeros(0, dtype=np.uint64)
        for batch in batches:
            keep, elements = np.zeros(batch.num_rows, dtype=bool), batch.column("elements")
            for i, asks in enumerate(batch.column("probes").to_pylist()):
                other = elements[i].values.to_numpy().view(np.uint64)
                if asks:
                    keep[i] = reaches(one, other, needed(len(one), len(other), percent))
                else:
                    one = other.copy()
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep))

    return stored(placed.select("a", "b", "probes", "elements").mapInArrow(check, "a bigint, b bigint").distinct(), "probed")


def links(docs: DataFrame, classes: DataFrame, size: int, percent: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Edges (a, b) between classes, all probed, whose closure joins every two classes that are similar enough."""
    posted = classes.select("class", F.posexplode("lists").alias("pos", "list"))
    counts = posted.groupBy("list").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    shared = stored(counts.withColumn("cuts", F.ceil(F.col("rows") / block_rows).cast("int")), "shared")
    placed = posted.join(shared, "list")
    members = stored(placed.join(classes.select("class", "n", "bits"), "class").select("list", "rows", "cuts", "class", "pos", "n", "bits"), "members")
    rows = members.count()

    # leaders of the longer lists; a set keeps those of its leaders and followers that differ least
    @released
    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (whole := _held(batches)) is not None:
            p = Postings(whole, percent)
            turn = (p.name ^ whole.column("list").to_numpy()) * MIX  # every list has its own leaders
            groups = (g for g in group_places(whole, ["list", "part"]) if len(g) > 1)
            yield from _pairs(p, (pair for g in groups for pair in led_pairs(p, g, turn)))

    part = F.pmod(F.xxhash64("class", "list"), F.col("cuts")).cast("int")
    long = members.filter(F.col("rows") > LED_ROWS).select("list", part.alias("part"), "class", "pos", "n", "bits")
    led = long.repartition(_tasks(docs, rows), "list", "part").mapInArrow(lead, FOUND)
    led = led.select("a", "b", "differ").distinct()
    led = led.unionByName(led.select(F.col("b").alias("a"), F.col("a").alias("b"), "differ"))
    nearest = Window.partitionBy("b").orderBy("differ", "a")
    led = led.withColumn("place", F.row_number().over(nearest))
    led = led.filter(F.col("place") <= F.when(F.col("differ") <= LIKELY, LEADERS).otherwise(1))
    led = stored(led.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "led")
    first = probed(led, docs, classes, size, percent)

    # the merge, over pairs that are not joined yet
    joined = smallest_reachable(first).select(F.col("node").alias("class"), "component")
    now = members.join(if_small(stored(joined, "joined"), SMALL), "class", "left").withColumn("component", F.coalesce("component", "class"))
    now = stored(now, "members")
    mixed = now.groupBy("list").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high")
    now = now.join(stored(mixed.select("list"), "mixed"), "list", "left_semi")
    mine = F.pmod(F.xxhash64("class"), F.col("cuts")).cast("int")
    cells = now.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    cells = cells.select(
        "list", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"), "mine", "class", "component", "pos", "n", "bits"
    )

    @released
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (whole := _held(batches)) is None:
            return
        p = Postings(whole, percent)
        component, mine, low, high = (whole.column(c).to_numpy() for c in ("component", "mine", "low", "high"))

        def found() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            small = []
            for g in group_places(whole, ["list", "low", "high"]):
                inside = low[g[0]] == high[g[0]] if len(g) else True
                if inside and len(g) <= SHORT_ROWS:
                    small.append(g)
                else:
                    one, two = g[mine[g] == low[g]], g[mine[g] == high[g]]
                    yield from pairs_across(p, one, one if inside else two, component)
            yield from pairs_of_short(p, small, component)

        yield from _pairs(p, found())

    met = cells.repartition(_tasks(docs, rows), "list", "low", "high").mapInArrow(merge, FOUND)
    met = met.groupBy("a", "b").agg(F.count(F.lit(1)).alias("lists"), F.first("least").alias("least"), F.first("differ").alias("differ"))
    candidates = stored(met.filter("lists >= least").select("a", "b", "differ"), "candidates")
    # the candidate that differs least for each set, then those that are not joined yet
    both = candidates.unionByName(candidates.select(F.col("b").alias("a"), F.col("a").alias("b"), "differ"))
    best = both.groupBy("a").agg(F.min(F.struct("differ", "b")).alias("best")).select("a", "best.b")
    best = stored(best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "best")
    edges = first.unionByName(probed(best, docs, classes, size, percent))
    joined = if_small(stored(smallest_reachable(edges).select("node", "component"), "joined"), SMALL)
    rest = candidates.select("a", "b")
    for side in ("a", "b"):
        named = joined.select(F.col("node").alias(side), F.col("component").alias(f"of_{side}"))
        rest = rest.join(named, side, "left").withColumn(f"of_{side}", F.coalesce(f"of_{side}", side))
    rest = stored(rest.filter("of_a <> of_b").select("a", "b"), "rest")
    return edges.unionByName(probed(rest, docs, classes, size, percent))


def similar_documents(
    docs: DataFrame, size: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text", block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles and component_id, the smallest id reachable over links, its own included.

    Words are what white space leaves, A-Z lower-cased; a row's set has its distinct runs of ``size`` words, or the
    whole text where it has fewer.  Rows link when 100 * shared >= ``percent`` * united elements.

    Null texts and texts without words have the empty set and link with nothing.  Rows without an id link nothing
    themselves and get the component of the rows with the same set, null if none of them has an id (and where the
    set is empty).  Rows sharing an id are one document: what they link to is joined.  Repeated rows are one class.
    Other columns are not passed on.  An empty table gives none.  Ids are integers.
    """
    rows = narrow(docs, doc_id=id_col, text=text_col)
    prints = stored(posted_sets(rows, size, percent), "posted")
    known = prints.filter("doc_id is not null").withColumn("doc_id", F.col("doc_id").cast("bigint"))
    classes = known.filter("n > 0").groupBy("class").agg(
        F.min(F.struct("doc_id", "tie")).alias("row"), F.first("n").alias("n"), F.first("lists").alias("lists"), F.first("bits").alias("bits")
    )
    classes = stored(classes.select("class", F.col("row.doc_id").alias("node"), F.col("row.tie").alias("tie"), "n", "lists", "bits"), "classes")
    nodes = classes.select("class", "node")
    found = links(rows, classes, size, percent, block_rows)
    found = found.join(nodes.toDF("a", "u"), "a").join(nodes.toDF("b", "v"), "b").select(F.col("u").alias("a"), F.col("v").alias("b"))
    # rows of one id join what each of them stands for; an empty set stands for its id alone
    full = known.filter("n > 0").select(F.col("doc_id").alias("a"), "class").join(nodes, "class").select("a", "node")
    own = full.unionByName(known.filter("n = 0").select(F.col("doc_id").alias("a"), F.col("doc_id").alias("node")))
    several = own.groupBy("a").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low < high").select("a")
    joins = own.join(several, "a", "left_semi").select("a", F.col("node").alias("b")).filter("a <> b")
    component = stored(smallest_reachable(found.unionByName(joins).distinct()), "components")
    named = nodes.join(component, "node", "left").select("class", F.coalesce("component", "node").alias("component_id"))
    with_words = prints.filter("n > 0").select("doc_id", "n", "class").join(named, "class", "left").select("doc_id", "n", "component_id")
    empty = prints.filter("n = 0").select("doc_id", "n").join(component.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    empty = empty.select("doc_id", "n", F.coalesce("component", F.col("doc_id").cast("bigint")).alias("component_id"))
    return with_words.unionByName(empty).select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
    ELSE list_distinct(list_transform(range(1, len(words) - 1), lambda i: array_to_string(words[i:i + 2], ' '))) END AS items FROM w),
e AS (SELECT doc_id, len(items) AS n, unnest(items) AS item FROM s),
df AS (SELECT item, count(*) AS f FROM e GROUP BY item),
ranked AS (SELECT doc_id, n, item, row_number() OVER (PARTITION BY doc_id ORDER BY f, item) AS place FROM e JOIN df USING (item)),
rare AS (SELECT * FROM ranked WHERE place <= n - ceil(n * 90 / 100.0) + 1),
pairs AS (SELECT DISTINCT a.doc_id AS x, b.doc_id AS y, a.n AS n, b.n AS m FROM rare a JOIN rare b ON a.item = b.item AND a.doc_id <> b.doc_id),
shared AS (
  SELECT x, y, any_value(p.n) AS n, any_value(p.m) AS m, count(*) AS common
  FROM pairs p JOIN e a ON a.doc_id = x JOIN e b ON b.doc_id = y AND b.item = a.item GROUP BY x, y),
linked AS (SELECT x, y FROM shared WHERE 100 * common >= 90 * (n + m - common)),
reach AS (
  SELECT doc_id, doc_id AS other FROM s
  UNION
  SELECT r.doc_id, l.y FROM reach r JOIN linked l ON l.x = r.other)
SELECT s.doc_id, CAST(len(items) AS BIGINT) AS n_shingles, CAST(min(other) AS BIGINT) AS component_id
FROM s JOIN reach USING (doc_id) GROUP BY s.doc_id, items
"""
