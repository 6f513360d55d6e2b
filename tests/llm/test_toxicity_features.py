"""Which n-grams the toxicity classifier learns from."""

from __future__ import annotations

import random

import numpy as np

from recollect.llm import toxicity


def test_frequent_ngrams_do_not_crowd_out_a_rarer_one(spark):
    r = random.Random(4)
    passage = "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(2000))  # over 5,000 n-grams
    rows = [(i, (passage if i < 100 else "") + (" 0Q9X7" if i >= 50 else ""), 1) for i in range(120)]
    rows += [(1000 + i, "nothing to see", 0) for i in range(120)]
    model = toxicity.train_classifier(spark.createDataFrame(rows, "doc_id bigint, text string, label int"))
    marker = next(h for h in toxicity.ngram_hashes("0q9x7") if len(h) == 3)
    assert len(model.ngrams) > 5000 and np.isin(marker, model.ngrams).all()


def test_fit_does_not_depend_on_the_presences_held_at_once(monkeypatch):
    r = np.random.default_rng(2)
    sizes = r.integers(0, 6, 60)
    column, labels, ratios = r.integers(0, 9, sizes.sum()).astype(np.int32), (r.random(60) < 0.4).astype(float), r.normal(size=9)
    whole = toxicity.fit(column, sizes, labels, ratios)
    monkeypatch.setattr(toxicity, "HELD_PRESENCES", 7)
    cut = toxicity.fit(column, sizes, labels, ratios)
    assert np.allclose(whole[0], cut[0]) and np.isclose(whole[1], cut[1])
