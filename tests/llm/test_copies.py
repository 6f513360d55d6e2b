"""Near copies against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from recollect.llm import copies


def near_texts(n: int, seed: int) -> list[str]:
    """Texts and copies of them: a passage appended or inserted, the tail removed, or words replaced."""
    r = random.Random(seed)
    lexicon = ["".join(r.choice("abcdefghij") for _ in range(r.randint(3, 8))) for _ in range(4000)]
    draw = lambda k: [r.choice(lexicon) for _ in range(k)]
    out = []
    for i in range(n):
        base = draw(r.randint(60, 300))
        share = r.uniform(0.05, 0.3)
        k = int(share * len(base))
        at = r.randrange(len(base))
        changed = [
            base + draw(k), base[:at] + draw(k) + base[at:], base[: len(base) - k],
            [r.choice(lexicon) if r.random() < share / 8 else w for w in base],
        ][i % 4]
        out += [" ".join(base), " ".join(changed)]
    return out


def groups_by_hand(sets: dict[int, set], floor: float) -> dict[int, int]:
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            both = len(sets[a] | sets[b])
            if a < b and (not both or len(sets[a] & sets[b]) / both >= floor):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {i: find(i) for i in sets}


def shingle_set(text: str | None) -> set:
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


@pytest.mark.parametrize("block", [2_000, 3])
def test_near_copies_equal_brute_force(spark, block):
    texts = near_texts(100, 5)
    r = random.Random(8)
    base = texts[0].split()
    for _ in range(40):  # a large group around one text, all pairs of which are near the floor
        own = list(base)
        for at in r.sample(range(len(own)), 2):
            own[at] = f"w{r.random()}"
        texts.append(" ".join(own))
    texts += ["", None, "  \n", "one word", "ONE word", "five words are one shingle", texts[3], texts[3].upper()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {x.doc_id: x.component_id for x in copies.near_copies(df, block_rows=block).collect()}
    assert got == groups_by_hand({i: shingle_set(t) for i, t in enumerate(texts)}, 0.8)


def test_pairs_just_below_the_floor_are_not_linked(spark):
    a = [f"a{i}" for i in range(104)]  # 100 shingles; with k more words the similarity is 100 / (100 + k)
    texts = [" ".join(a), " ".join(a + [f"b{i}" for i in range(26)]), " ".join(a + [f"c{i}" for i in range(25)])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    kept = corpus_pipeline.keep_one_of_each(spark, df, "")
    assert sorted(x.doc_id for x in kept.collect()) == [0, 1]


def test_bands_find_pairs_at_the_floor():
    r = np.random.default_rng(1)
    found = 0
    for _ in range(300):
        x = r.integers(0, 2**64, size=180, dtype=np.uint64)
        keys = [copies.band_keys(copies.minima(s)) for s in (x[:162], x[18:])]  # 144 / 180 in common
        found += bool((keys[0] == keys[1]).any())
    assert found == 300


def test_the_pipeline_groups_by_fingerprints_and_verifies(spark, monkeypatch):
    """Fingerprints propose, the sets decide: proposals below the floor link nothing, copies none proposes are found."""
    base = [f"a{i}" for i in range(200)]
    texts = [" ".join(base), " ".join(base + ["more"]), " ".join(base[:100] + ["x"] * 40 + base[100:]), "other words " * 3, ""]
    df = spark.createDataFrame([*enumerate(texts), (5, None)], "doc_id bigint, text string")
    asked = []

    def wrong(docs):
        asked.append(docs.count())
        return docs.select("doc_id", F.when(F.col("doc_id") == 1, 1).otherwise(0).cast("bigint").alias("component_id"))

    monkeypatch.setattr(corpus_pipeline, "near_duplicates", wrong)
    kept = sorted(x.doc_id for x in corpus_pipeline.keep_one_of_each(spark, df, "").collect())
    want = groups_by_hand({i: shingle_set(t) for i, t in enumerate([*texts, None])}, 0.8)
    assert asked == [6] and kept == [i for i, c in want.items() if i == c]
    assert kept == [0, 3, 4]
