"""Periodic runs against a comparison of every word with the one a period before it."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from recollect.llm import periods as P


def runs_by_hand(words, min_length=6, min_exponent=4):
    n, found = len(words), {}
    for q in range(1, n // min_exponent + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(min_length, min_exponent * q):
                found.setdefault((i, j + q - i), q)  # a multiple of the smallest period has the same place
            i = j + 1
    return sorted(((s, k, q) for (s, k), q in found.items()), key=lambda r: (r[0], r[2]))


def digest_by_hand(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if doc_id is not None and words:
        h = zlib.crc32(str(doc_id).encode())
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        if h % 10 == 0:
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = runs_by_hand(words)
    gone = {i for s, k, q in runs for i in range(s + q, s + k)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else (None, None, None)
    listed = "".join(f"{s},{k},{q}\n" for s, k, q in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (
        doc_id, len(runs), *best, None if not runs else 1000 * best[1] // best[2],
        hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest(),
    )


def collected(df):
    got = P.runs_digest(df)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    return sorted(map(tuple, got.collect()), key=repr)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=50), st.integers(0, 50), st.integers(1, 9), st.sampled_from([(6, 4), (4, 2), (2, 2), (9, 3)]))
def test_runs_equal_plain_comparison(words, start, period, least):
    words = [w if i < start else words[start + (i - start) % period] for i, w in enumerate(words)]
    assert P.runs_of(np.array(words, dtype=np.int64), *least) == runs_by_hand(words, *least)


def test_large_classes_are_merged_by_sorting(monkeypatch):
    r = random.Random(4)
    words = [r.randrange(40) for _ in range(60)] * 9 + [r.randrange(3) for _ in range(400)]
    expected = runs_by_hand(words, 4, 2)
    for inserted in (0, 16, 10**6):
        monkeypatch.setattr(P, "INSERTED", inserted)
        assert P.runs_of(np.array(words), 4, 2) == expected


def test_digest_of_odd_tables(odd_documents, odd_texts, no_documents):
    assert collected(odd_documents) == sorted((digest_by_hand(i, t) for i, t in odd_texts), key=repr)
    assert collected(no_documents) == []


def test_digest_of_many_documents(spark):
    r = random.Random(5)
    rows = [(i, " ".join(r.choice("abcdefgh") * r.randint(1, 2) for _ in range(r.randint(0, 90)))) for i in range(400)]
    rows += [(1000 + i, "x " * r.randint(1, 40) + "y z " * r.randint(1, 20)) for i in range(40)]
    got = collected(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert got == sorted((digest_by_hand(i, t) for i, t in rows), key=repr)
    assert sum(n > 0 for _, n, *_ in got) > 40


def test_operator_returns_spans_and_text(spark):
    rows = [(1, "go ha ha ha ha ha ha on"), (2, None)]
    got = {r.doc_id: r for r in P.periodic_runs(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert [tuple(x) for x in got[1].runs] == [(1, 6, 1)] and got[1].collapsed_text == "go ha on"
    assert got[2].runs == [] and got[2].collapsed_text == "" and got[2].n_words == 0
    with pytest.raises(ValueError):
        P.periodic_runs(spark.createDataFrame(rows, "doc_id int, text string"), min_exponent=1)


def test_a_long_text_of_one_word(spark):
    row = P.periodic_runs(spark.createDataFrame([(7, "w " * 200_000)], "doc_id bigint, text string")).first()
    assert [tuple(x) for x in row.runs] == [(0, 200_000, 1)] and row.collapsed_text == "w"
