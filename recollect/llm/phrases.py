"""Benchmark decontamination over a positional inverted index.

The index is partitioned by document: a stored table with, for every document, its terms, how often each
occurs and the places where it does (terms of the benchmark only; no other term can be part of a match).
Corpus-wide term frequencies are summed from the index.  A window of benchmark words is then looked up from
its rarest term: the places of that term, moved back by its offset, are cut with the moved places of the next
rarer term and so on, so that most windows end after one or two lists.  With ``slop`` the lists are cut with
a tolerance, which gives proximity matches.

Nothing is shuffled but term counts.  The benchmark reaches the tasks in slices of bounded size: one slice is
broadcast at a time, and a benchmark of any size is worked through slice by slice.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm.tables import narrow
from recollect.llm.words import binary_column, list_column, tidy, word_pieces
from recollect.plans.materialize import stored

#: Bytes of benchmark text whose windows are broadcast at once.
SLICE_BYTES = 8_000_000

INDEX = "row bigint, id {}, n_words bigint, terms array<int>, counts array<int>, places array<int>"
HITS = "row bigint, id {}, n_words bigint, starts array<int>, ends array<int>, items array<string>"


@dataclass(frozen=True)
class Windows:
    """Windows of one slice: term numbers, and for each distinct window its terms and the items it is of."""

    terms: dict[bytes, int]
    windows: list[tuple[tuple[int, ...], tuple[str, ...]]]


def words_of(raw: bytes | None) -> list[bytes]:
    return [w for piece in word_pieces(raw) for w in piece]


def windows_of(items: list[tuple[str, bytes | None]], size: int) -> Windows:
    terms: dict[bytes, int] = {}
    found: dict[tuple[int, ...], set[str]] = defaultdict(set)
    for item, raw in items:
        ids = [terms.setdefault(w, len(terms)) for w in words_of(raw)]
        for i in range(max(1, len(ids) - size + 1) if ids else 0):
            found[tuple(ids[i : i + size])].add(item)
    return Windows(terms, [(w, tuple(sorted(of))) for w, of in found.items()])


def posting_table(docs: DataFrame, terms: dict[bytes, int], name: str = "postings") -> DataFrame:
    """Store, for every row (row, id, text), the places of ``terms`` in its text."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    @tidy
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value.get
        for batch in batches:
            sizes, numbers, counts, places = [], [], [], []
            for raw in binary_column(batch.column("text")):
                found: dict[int, list[int]] = defaultdict(list)
                n = 0
                for piece in word_pieces(raw):
                    for place, term in enumerate(map(known, piece), n):
                        if term is not None:
                            found[term].append(place)
                    n += len(piece)
                sizes.append(n)
                numbers.append(list(found))
                counts.append([len(p) for p in found.values()])
                places.append([x for p in found.values() for x in p])
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("id"), pa.array(sizes, pa.int64()), *[list_column(v, pa.int32()) for v in (numbers, counts, places)]],
                names=["row", "id", "n_words", "terms", "counts", "places"],
            )

    return stored(docs.mapInArrow(index, INDEX.format(dict(docs.dtypes)["id"])), name)


def term_counts(index: DataFrame) -> dict[int, int]:
    """Occurrences of each indexed term in the whole corpus; at most one row per term of a slice."""
    pairs = index.select(F.explode(F.arrays_zip("terms", "counts")).alias("p"))
    counted = pairs.groupBy(F.col("p.terms").alias("t")).agg(F.sum("p.counts").alias("n"))
    return {r.t: r.n for r in counted.collect()}


def _near(places: list[int], at: int, slop: int) -> bool:
    i = bisect_left(places, at - slop)
    return i < len(places) and places[i] <= at + slop


def occurrences(
    order: list[tuple[int, int]], places: dict[int, list[int]], sets: dict[int, set[int]], size: int, n_words: int, slop: int
) -> list[int]:
    """Starts of a window whose (term, offset) pairs come rarest first.

    With ``slop`` the rarest term may itself have moved, and a window may start before or end after the text.
    """
    term, offset = order[0]
    if slop:
        starts = sorted({p - offset + d for p in places[term] for d in range(-slop, slop + 1)})
    else:
        starts = [s for p in places[term] if 0 <= (s := p - offset) <= n_words - size]
    for term, offset in order[1:]:
        if not starts or term not in places:
            return []
        if slop:
            starts = [s for s in starts if _near(places[term], s + offset, slop)]
        else:
            at = sets.get(term)
            if at is None:
                at = sets[term] = set(places[term])
            starts = [s for s in starts if s + offset in at]
    return starts


def _covered(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint intervals that cover the same places."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    fresh = np.r_[True, starts[1:] > reach[:-1]]
    last = np.r_[np.flatnonzero(fresh)[1:] - 1, len(starts) - 1]
    return starts[fresh], reach[last]


def match_windows(index: DataFrame, windows: Windows, slop: int = 0) -> DataFrame:
    """Places and items hit in every row of the index."""
    counts = term_counts(index)
    anchored: dict[int, list] = defaultdict(list)
    for terms, items in windows.windows:
        if all(t in counts for t in terms):
            order = sorted(((t, i) for i, t in enumerate(terms)), key=lambda x: (counts[x[0]], x))
            anchored[order[0][0]].append((order, items))
    shared = index.sparkSession.sparkContext.broadcast(dict(anchored))

    @tidy
    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rarest = shared.value
        for batch in batches:
            out_starts, out_ends, out_items = [], [], []
            for n, terms, sizes, flat in zip(
                batch.column("n_words").to_pylist(),
                batch.column("terms").to_pylist(),
                batch.column("counts").to_pylist(),
                batch.column("places"),
                strict=True,
            ):
                starts, ends, items, sets = [], [], set(), {}
                anchors = [t for t in terms if t in rarest]
                if anchors:
                    flat = flat.values.to_numpy().tolist()
                    places, at = {}, 0
                    for t, k in zip(terms, sizes, strict=True):
                        places[t] = flat[at : at + k]
                        at += k
                    for anchor in anchors:
                        for order, of in rarest[anchor]:
                            found = occurrences(order, places, sets, len(order), n, slop)
                            if found:
                                items.update(of)
                                inside = [s for s in found if -len(order) < s < n]  # others lie outside the text
                                starts += [max(0, s) for s in inside]
                                ends += [min(n, s + len(order)) for s in inside]
                a, b = _covered(np.array(starts, dtype=np.int64), np.array(ends, dtype=np.int64))
                out_starts.append(a)
                out_ends.append(b)
                out_items.append(sorted(items))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("id"), batch.column("n_words"), list_column(out_starts, pa.int32()),
                 list_column(out_ends, pa.int32()), pa.array(out_items, pa.list_(pa.string()))],
                names=["row", "id", "n_words", "starts", "ends", "items"],
            )

    return index.mapInArrow(match, HITS.format(dict(index.dtypes)["id"]))


def _merged(hits: DataFrame) -> DataFrame:
    """One row per document row from one row per slice."""
    gathered = hits.groupBy("row").agg(
        F.first("id").alias("id"),
        F.first("n_words").alias("n_words"),
        F.flatten(F.collect_list("starts")).alias("starts"),
        F.flatten(F.collect_list("ends")).alias("ends"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )

    @tidy
    def cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [
                _covered(a.values.to_numpy(), b.values.to_numpy())
                for a, b in zip(batch.column("starts"), batch.column("ends"), strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("id"), batch.column("n_words"), list_column([a for a, _ in both], pa.int32()),
                 list_column([b for _, b in both], pa.int32()), batch.column("items")],
                names=["row", "id", "n_words", "starts", "ends", "items"],
            )

    return gathered.mapInArrow(cover, HITS.format(dict(hits.dtypes)["id"]))


def phrase_hits(
    docs: DataFrame, items: DataFrame, window: int = 10, slop: int = 0, slice_bytes: int = SLICE_BYTES
) -> DataFrame:
    """Per row of ``docs`` (row, id, text): words, disjoint hit intervals [start, end) and the ids of items hit.

    ``items`` has (item, text).  A window is ``window`` consecutive words of an item; an item with fewer, but
    not none, is one window.  With ``slop`` every word may stand up to so many places from where the window
    has it; the interval of a hit is the window's place within the text.  Items without id or words match nothing; items that share an id are one item; null and empty
    texts have no words.  ``row`` must be unique; ``id`` is carried along.
    """
    named = items.filter(F.col("item").isNotNull())
    size = named.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slices = -(-size // slice_bytes) or 1
    number = F.pmod(F.xxhash64("item", "text"), F.lit(slices))
    if slices > 1:
        docs = stored(docs, "numbered")  # so that every slice sees the same row numbers
    parts = []
    for i in range(slices):
        rows = named.filter(number == i).select("item", F.encode("text", "UTF-8").alias("t")).collect()
        windows = windows_of([(r.item, None if r.t is None else bytes(r.t)) for r in rows], window)
        parts.append(match_windows(posting_table(docs, windows.terms), windows, slop))
    if slices == 1:
        return parts[0]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return _merged(every)


def decontaminate(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", window: int = 10, slop: int = 0,
) -> DataFrame:
    """Per row of ``docs``: its id, ``n_words``, ``n_hit``, ``n_items``, ``items`` and hit ``starts``/``ends``.

    Every row of ``docs`` gives one row, repeated and null ids included.  Null and empty texts have no words and no
    hits, texts of any length count whole, other columns are not passed on.  An empty table gives none.
    """
    rows = narrow(docs, id=id_col, text=text_col).withColumn("row", F.monotonically_increasing_id())
    named = narrow(items, item=items[item_col].cast("string"), text=item_text_col)
    found = phrase_hits(rows, named, window, slop)
    hit = F.aggregate(
        F.zip_with("starts", "ends", lambda a, b: (b - a).cast("bigint")), F.lit(0).cast("bigint"), lambda x, y: x + y
    )
    return found.select(
        F.col("id").alias(id_col), "n_words", hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        "items", "starts", "ends",
    )


def contamination_digest(docs: DataFrame, items: DataFrame) -> DataFrame:
    return decontaminate(docs, items).select(
        "doc_id", "n_words", "n_hit", "n_items",
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


SQL = r"""
with low as (select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
d as (select doc_id, coalesce(w, []) w from low),
b as (select item_id::varchar item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark),
g as (select item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) i from b where len(w) > 0),
win as (select distinct item, list_slice(w, i, i + 9) g, least(len(w), 10) n from g),
lens as (select distinct n from win),
pos as (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) i from d, lens where len(w) >= n),
hit as (select p.doc_id, p.i, p.n, win.item from (select doc_id, i, n, list_slice(w, i, i + n - 1) g from pos) p join win on p.g = win.g),
covered as (select doc_id, count(distinct j) n_hit from (select doc_id, unnest(range(i, i + n)) j from hit) group by 1),
its as (select doc_id, count(*) n_items, string_agg(item, ',' order by item) s from (select distinct doc_id, item from hit) group by 1)
select d.doc_id, len(w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items,
  sha256(coalesce(s, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from d left join covered using (doc_id) left join its using (doc_id)
"""
