"""Periodic runs of words, found by uniting suffix classes in order of decreasing LCP.

The words of a text become numbers.  Prefix doubling names all substrings of 1, 2, 4, ... words, which sorts the
suffixes, and the same names give the LCP of neighbours in that order.  Kruskal's algorithm then takes the
neighbours by decreasing LCP: a union-find joins the classes of suffixes that share so many words, each class with
its positions in order, the smaller merged into the larger.  Two positions that become adjacent in a class at LCP
l and distance d <= l start a square, so words i and i + d agree for exactly l words: the stretch of d + l words has
period d and cannot go on to the right, and d is its smallest period (a smaller one would have put a position
between them at a higher LCP).  It is a run where it cannot be extended to the left either.

A run of period q and length n has its two first positions adjacent at LCP n - q, so levels below the smallest
n - q that can qualify are never united, and a text in which no stretch of that many words occurs twice has no
runs: that is looked up first, by hashes that can only err towards looking closer.

A task holds one text's words and names (about 4 bytes a word for each doubling up to the longest repeat).
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.llm.tables import narrow
from recollect.llm.words import binary_column, tidy

#: Classes of more positions are merged by sorting instead of one insertion after the other.
INSERTED = 16

Words = list[bytes]
Rewrite = Callable[[Words, object], Words]


def least_lcp(min_length: int, min_exponent: int) -> int:
    """The smallest LCP of the first two positions of a run that is long enough."""
    return min(max(min_length, min_exponent * q) - q for q in range(1, max(2, min_length + 1)))


def repeats(ids: np.ndarray, size: int) -> bool:
    """Whether a stretch of ``size`` words may occur twice; False is certain."""
    if len(ids) <= size:
        return False
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    n = len(ids) - size + 1
    hashes = np.zeros(n, dtype=np.uint64)
    for i in range(size):
        hashes = hashes * np.uint64(0xD6E8FEB86659FD93) + mixed[i : i + n]
    hashes.sort()
    return bool((hashes[1:] == hashes[:-1]).any())


def sorted_suffixes(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in suffix order, and the LCP of each with the next."""
    n = len(ids)
    levels, size = [np.unique(ids, return_inverse=True)[1].astype(np.int32)], 1
    while levels[-1].max() + 1 < n:
        last = levels[-1]
        after = np.zeros(n, dtype=np.int64)  # past the end sorts first
        after[: max(0, n - size)] = last[size:] + 1
        levels.append(np.unique(last * np.int64(n + 1) + after, return_inverse=True)[1].astype(np.int32))
        size *= 2
    order = np.empty(n, dtype=np.int64)
    order[levels[-1]] = np.arange(n)
    a, b = order[:-1].copy(), order[1:].copy()
    lcp = np.zeros(n - 1, dtype=np.int64)
    for k in range(len(levels) - 2, -1, -1):  # the last names are all different
        step = 1 << k
        inside = np.flatnonzero((a + step <= n) & (b + step <= n))
        same = inside[levels[k][a[inside]] == levels[k][b[inside]]]
        lcp[same] += step
        a[same] += step
        b[same] += step
    return order, lcp


def adjacent_pairs(order: np.ndarray, lcp: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """(a, b, l): positions a < b that become adjacent in a class when classes are united at LCP l >= ``least``."""
    edges = np.flatnonzero(lcp >= least)
    edges = edges[np.argsort(-lcp[edges], kind="stable")]
    root: dict[int, int] = {}
    classes: dict[int, list[int]] = {}

    def find(x: int) -> int:
        top = x
        while (up := root.get(top, top)) != top:
            top = up
        while (up := root.get(x, x)) != top and x != top:
            root[x] = top
            x = up
        return top

    for a, b, level in zip(order[edges].tolist(), order[edges + 1].tolist(), lcp[edges].tolist(), strict=True):
        a, b = find(a), find(b)
        large, small = classes.pop(a, None) or [a], classes.pop(b, None) or [b]
        if len(large) < len(small):
            a, b, large, small = b, a, small, large
        at, before, many = 0, -1, len(small) > INSERTED
        for i, x in enumerate(small):
            at = bisect_left(large, x, at)
            # neighbours in the united class that come from the other one
            if at and large[at - 1] > before:
                yield (large[at - 1], x, level)
            if at < len(large) and not (i + 1 < len(small) and small[i + 1] < large[at]):
                yield (x, large[at], level)
            if not many:
                large.insert(at, x)
            before = x
        if many:
            large += small
            large.sort()
        root[b] = a
        classes[a] = large


def runs_of(ids: np.ndarray, min_length: int = 6, min_exponent: int = 4) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of ``ids`` by start, then period."""
    least = least_lcp(min_length, min_exponent)
    if not repeats(ids, least):
        return []
    found = []
    for a, b, level in adjacent_pairs(*sorted_suffixes(ids), least):
        period = b - a
        length = period + level
        if length >= min_length and length >= min_exponent * period and (a == 0 or ids[a - 1] != ids[b - 1]):
            found.append((a, length, period))
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Places of ``n`` words that no run contains after its first period."""
    change = np.zeros(n + 1, dtype=np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.flatnonzero(np.cumsum(change[:n]) == 0)


def periodic_runs(
    docs: DataFrame, min_length: int = 6, min_exponent: int = 4, id_col: str = "doc_id", text_col: str = "text",
    rewrite: Rewrite | None = None,
) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, runs (start, length, period) and the text without the repeats.

    Words are what white space leaves, numbered from 0.  A run is a stretch of words with smallest period q, of at
    least ``min_length`` words and ``min_exponent`` (2 or more) periods, that no neighbouring word extends.
    ``collapsed_text`` joins by one space the words that no run holds after its first period.  ``rewrite`` may
    replace the words of a row, given them and its id, before runs are looked for.

    Null and empty texts have no words and no runs; a row without an id is treated like any other, and rows sharing
    an id or a text one by one.  Other columns are not passed on.  An empty table gives none.
    """
    if min_exponent < 2:
        raise ValueError("a run has two periods at least")
    rows = narrow(docs, doc_id=id_col, text=text_col)
    kind = dict(rows.dtypes)["doc_id"]

    @tidy
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, starts, lengths, periods, ends, kept = [], [], [], [], [0], []
            for name, raw in zip(batch.column("doc_id").to_pylist(), binary_column(batch.column("text")), strict=True):
                words = (raw or b"").split()
                if rewrite is not None:
                    words = rewrite(words, name)
                numbers: dict[bytes, int] = {}
                ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), dtype=np.int64, count=len(words))
                runs = runs_of(ids, min_length, min_exponent)
                sizes.append(len(words))
                for r in runs:
                    starts.append(r[0])
                    lengths.append(r[1])
                    periods.append(r[2])
                ends.append(len(starts))
                kept.append(b" ".join([words[i] for i in collapsed(len(words), runs).tolist()] if runs else words))
            values = pa.StructArray.from_arrays(
                [pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(periods, pa.int64())], names=["start", "length", "period"]
            )
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
            texts = pa.array(kept, pa.large_binary()).cast(pa.large_string())
            if not pa.types.is_large_string(batch.schema.field("text").type):
                texts = texts.cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), lists, texts], names=["doc_id", "n_words", "runs", "collapsed_text"]
            )

    run = "struct<start: bigint, length: bigint, period: bigint>"
    return rows.mapInArrow(scan, f"doc_id {kind}, n_words bigint, runs array<{run}>, collapsed_text string").withColumnRenamed("doc_id", id_col)


def strongest(runs: Column) -> Column:
    """The run with the greatest length / period; of equal ones the first by start, then period.  Null without runs."""
    first = F.element_at(runs, 1)
    return F.when(
        F.size(runs) > 0,
        F.aggregate(runs, first, lambda best, r: F.when(r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best)),
    )


def planted(words: Words, doc_id: object) -> Words:
    """Fixed by the contract: in a tenth of the documents the words from some place on repeat with a period."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    stretch = words[a : a + p]
    return words[:a] + (stretch * ((n - a) // len(stretch) + 1))[: n - a]


def runs_digest(docs: DataFrame) -> DataFrame:
    """The runs of every whole document, planted ones included, as numbers and checksums."""
    found = periodic_runs(docs, rewrite=planted)
    best = strongest(F.col("runs"))
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), F.col("best.start").alias("start"),
        F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.floor(F.col("best.length") * 1000 / F.col("best.period")).cast("bigint").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed_text", 256).alias("collapsed_sha256"),
    )
