"""The z-fast trie against a plain trie."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from recollect.llm import prefix_trie as T

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def conversations_of(rows):
    """conv_id -> turns in order, of (conv_id, turn, role, text)."""
    by = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            by[c].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [x[2:] for x in sorted(v, key=lambda x: x[:2])] for c, v in by.items()}


def rebuilt_by_hand(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = convs.get(c - c % 5, [])[:h] + own[h:]
    return out


def nodes_by_hand(convs):
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = defaultdict(list)
    for k in members:
        if k:
            kids[k[:-1]].append(k)
    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in kids[k]) or 1
        saved[k] = sum(saved[x] for x in kids[k]) + (len(members[k]) - 1) * (len(k[-1][1].encode()) if k else 0)
    out = []
    for k, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(convs[c]) == len(k))))
        out.append((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(kids[k]), leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def collected(df):
    assert df.columns == COLUMNS
    return sorted(map(tuple, df.collect()), key=repr)


def table_of(spark, rows):
    return spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(3)


def branching(seed, n=120, deep=40):
    r = random.Random(seed)
    rows, made = [], [[]]
    for c in range(n):
        own = list(r.choice(made))
        own = own[: r.randint(0, len(own))] + [(r.choice(["user", "bot"]), r.choice(["a", "bb", "é", "dddd"])) for _ in range(r.choice([0, 1, 2, 5, deep]))]
        made.append(own)
        rows += [(c * 3 - 5, i, *t) for i, t in enumerate(own)]
    return rows


@pytest.mark.parametrize(("seed", "batches"), [(1, 1), (2, 3)])
def test_trie_equals_plain_trie(spark, seed, batches):
    rows = branching(seed)
    got = T.prefix_trie(T.numbered_turns(table_of(spark, rows)), batches=batches)
    assert collected(got) == nodes_by_hand(conversations_of(rows))


def test_blocks_of_turns_and_ids(spark, monkeypatch):
    monkeypatch.setattr(T, "TURN_BLOCK", 3)
    monkeypatch.setattr(T, "ID_BLOCK", 4)
    rows = branching(3, 60, 12) + [(10_000 + i, 0, "user", "same") for i in range(40)]
    got = T.prefix_trie(T.numbered_turns(table_of(spark, rows)))
    assert collected(got) == nodes_by_hand(conversations_of(rows))


def test_digest_of_rebuilt_conversations(spark):
    r = random.Random(9)
    rows = [(c, t, "user" if t % 2 == 0 else None, r.choice(["x", "yy", None])) for c in range(90) if c % 10 for t in range(r.randint(1, 12))]
    got = T.trie_digest(table_of(spark, rows))
    assert collected(got) == nodes_by_hand(rebuilt_by_hand(conversations_of(rows)))


def test_odd_conversations(spark):
    rows = [
        (None, 0, "user", "nobody"), (1, None, None, None), (1, 0, "user", "x" * 100_000), (1, 0, "user", "x" * 100_000), (2, 7, "user", ""),
        (2, 7, "user", ""), (-4, 3, "bot", "ü 日本"), (-4, -3, "user", "first"), (5, None, "user", "only"), (5, 1, "", "first"),
    ]
    df = table_of(spark, rows).withColumns({"depth": F.lit("clash"), "k1": F.lit(1), "seq": F.lit(None).cast("string"), "owner": F.lit(2.0)})
    turns = T.numbered_turns(df)
    assert collected(T.prefix_trie(turns)) == nodes_by_hand(conversations_of(rows))
    assert collected(T.trie_digest(df)) == nodes_by_hand({c: t for c, t in odd_rebuilt(rows).items()})


def odd_rebuilt(rows):
    """As ``rebuilt_by_hand`` with the remainder of a negative id taken towards zero."""
    convs, out = conversations_of(rows), {}
    for c, own in convs.items():
        h, base = zlib.crc32(str(c).encode()) % 9, c - (abs(c) % 5) * (1 if c > 0 else -1)
        out[c] = convs.get(base, [])[:h] + own[h:]
    return out


def test_no_conversations(spark):
    assert T.trie_digest(table_of(spark, [])).count() == 0
    assert T.trie_digest(table_of(spark, [(None, 0, "user", "x")])).count() == 0


def test_two_fattest(spark):
    pairs = [(a, b) for a in range(40) for b in range(a + 1, 41)]
    df = spark.createDataFrame(pairs, "a bigint, b bigint").select("a", "b", T.two_fattest(F.col("a"), F.col("b")).alias("f"))
    for a, b, f in df.collect():
        assert f == max(range(a + 1, b + 1), key=lambda x: x & -x)
