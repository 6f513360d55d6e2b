"""The T-occurrence join against all pairs."""

from __future__ import annotations

import random
import re
from itertools import combinations

import numpy as np
import pytest

from recollect.llm import jaccard as J


def set_of(text, size=3):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if len(words) < size:
        return frozenset([" ".join(words)] if words else [])
    return frozenset(" ".join(words[i : i + size]) for i in range(len(words) - size + 1))


def by_hand(rows, size=3, percent=90):
    """Components over all pairs of rows; rows of one id are joined."""
    sets = [set_of(t, size) for _, t in rows]
    ids = [i for i, _ in rows]
    up = {i: i for i in ids if i is not None}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for (i, x), (j, y) in combinations(zip(ids, sets, strict=True), 2):
        if i is not None and j is not None and x and y and 100 * len(x & y) >= percent * len(x | y):
            a, b = find(i), find(j)
            up[max(a, b)] = min(a, b)
    out = []
    for i, s in zip(ids, sets, strict=True):
        named = [find(j) for j, t in zip(ids, sets, strict=True) if j is not None and t == s]
        out.append((i, len(s), find(i) if i is not None else min(named) if s and named else None))
    return sorted(out, key=repr)


def run(df, **options):
    got = J.similar_documents(df, **options)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    return sorted(map(tuple, got.collect()), key=repr)


def family(r, base, copies, first_id, most):
    """Copies of a text with a few words changed, removed or added."""
    rows = []
    for k in range(copies):
        words = list(base)
        for _ in range(r.randint(0, most)):
            at = r.randrange(len(words))
            words[at : at + r.randint(0, 1)] = [f"new{r.randrange(10**6)}"] * r.randint(0, 1)
        rows.append((first_id + k, " ".join(words)))
    return rows


def documents(seed):
    r = random.Random(seed)
    word = lambda: f"w{int(r.paretovariate(0.6)) % 400}"
    rows = []
    for f in range(14):
        rows += family(r, [word() for _ in range(r.choice([4, 9, 10, 11, 30, 120, 300]))], r.randint(1, 12), 100 * f, r.choice([1, 2, 4]))
    passage = " ".join(word() for _ in range(200))
    rows += [(5000 + k, f"{passage} " + " ".join(word() for _ in range(r.randint(1, 60)))) for k in range(60)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_all_pairs(spark, monkeypatch, seed):
    monkeypatch.setattr(J, "SHORT_ROWS", 8)  # so that lists of this size have leaders
    rows = documents(seed)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert run(df, block_rows=16) == by_hand(rows)


@pytest.mark.parametrize(("size", "percent"), [(2, 50), (1, 75), (5, 80)])
def test_other_sizes_and_similarities(spark, size, percent):
    rows = documents(7)[:110]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert run(df, size=size, percent=percent) == by_hand(rows, size, percent)


def test_odd_tables(odd_documents, odd_texts, no_documents):
    assert run(odd_documents) == by_hand(odd_texts)
    assert run(no_documents) == []


def test_a_large_group_of_near_copies_is_not_all_its_pairs(spark):
    r = random.Random(3)
    rows = family(r, [f"w{r.randrange(300)}" for _ in range(150)], 600, 0, 1)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {c for _, _, c in run(df, block_rows=100)} == {0}


def test_needed_is_the_least_overlap():
    for percent in (50, 75, 80, 90, 100):
        for n in range(1, 40):
            reach = [o for o in range(1, n + 1) if 100 * o >= percent * n]
            assert J.least_needed(n, percent) == min(reach)
            for m in range(1, 40):
                ok = [o for o in range(1, 80) if 100 * o >= percent * (n + m - o)]
                assert J.needed(n, m, percent) == min(ok)


def test_probes_stop_at_the_needed_overlap():
    r = np.random.default_rng(1)
    for _ in range(200):
        a, b = (np.unique(r.integers(0, 4000, r.integers(1, 3000)).astype(np.uint64)) for _ in range(2))
        shared = len(np.intersect1d(a, b))
        assert J.reaches(a, b, max(1, shared)) == (shared > 0) and not J.reaches(a, b, shared + 1)


def test_a_group_on_short_lists_is_joined_before_the_merge(spark, monkeypatch):
    r, counts, keep = random.Random(5), {}, J.stored

    def stored(df, name):
        out = keep(df, name)
        counts[name] = out.count()
        return out

    monkeypatch.setattr(J, "stored", stored)
    base, rows = [f"w{i}" for i in range(400)], []
    for k in range(30):
        words = list(base)
        for at in r.sample(range(400), r.randint(2, 5)):
            words[at] = f"new{k}x{at}"
        rows.append((k, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert run(df) == by_hand(rows)
    assert counts["led"] <= 30 * J.LEADERS and counts["candidates"] <= 100  # of 435 pairs
