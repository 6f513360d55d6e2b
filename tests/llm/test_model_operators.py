"""Top-k, fingerprints, classifiers, language model, mixing and the pipeline against plain Python."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.conftest import text_of
from recollect.llm import components, language_model, mixing, quality, simhash, topk, toxicity
from recollect.llm.tables import table


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# ---- top-k


def best_by_hand(rows, k, is_query):
    fit = [(i, [math.floor(256 * x) for x in v]) for i, v in rows
           if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    fit = list({(i, tuple(v)) for i, v in fit})
    out = set()
    for q, a in fit:
        if is_query(q):
            found = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in fit if i != q and len(a) == len(b))[:k]
            out |= {(q, r, i, -s) for r, (s, i) in enumerate(found, 1)}
    return out


@pytest.mark.parametrize("block", [8192, 40])
def test_top_k_equals_brute_force(spark, block):
    r = np.random.default_rng(block)
    centres = r.normal(size=(4, 12))
    rows = [(i, [float(x) for x in centres[i % 4] + r.normal(size=12) * 0.3]) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(60)]  # a vector that many rows share
    rows += [(400, None), (450, [1.0, None] + [0.0] * 10), (401, [float("nan")] * 12), (402, [float("inf")] + [0.0] * 11), (None, rows[1][1]),
             (500, [1.0, 2.0]), (501, [2.0, 2.0]), (550, []), (551, []), (600, [0.0] * 12), rows[3], rows[3]]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("id", F.lit("x")).withColumn("block", F.lit(1))
    got = topk.top_k(df, F.col("id") % 50 == 0, block_rows=block, query_rows=5)
    assert {tuple(x) for x in got.collect()} == best_by_hand(rows, 5, lambda i: i % 50 == 0)
    assert topk.neighbours(df.limit(0)).count() == 0


def test_an_id_on_many_vectors_keeps_its_neighbours(spark):
    r = np.random.default_rng(4)
    base = r.normal(size=8)
    rows = [(50, [float(x) for x in base + r.normal(size=8) * 0.01]) for _ in range(20)]
    rows += [(i, [float(x) for x in r.normal(size=8)]) for i in range(101, 140)]
    got = topk.neighbours(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()
    fit = {i: np.floor(256 * np.array(v)).astype(np.int64) for i, v in rows if i != 50}
    asked = [np.floor(256 * np.array(v)).astype(np.int64) for i, v in rows if i == 50]
    pairs = sorted({(-int(q @ v), i) for q in asked for i, v in fit.items()})[:5]
    assert [(x.rank, x.vec_id, x.score) for x in sorted(got, key=lambda x: x.rank)] == [(n, i, -s) for n, (s, i) in enumerate(pairs, 1)]


def test_reading_stops_before_the_lists_end():
    r = np.random.default_rng(1)
    rows = np.floor(256 * r.normal(size=(2000, 4))).astype(np.int64)
    lists = topk.SortedLists(np.arange(2000), rows)
    weight = np.array([3.0, -1.0, 0.5, 2.0])
    survivors = lists._survivors(weight, np.arange(4), 6, 2000)
    best = np.argsort(-(rows @ weight))[:6]
    assert len(survivors) < 1000 and set(best) <= set(survivors)


# ---- fingerprints


def print_by_hand(text, n=4):
    w = re.findall("[^\x20\x09-\x0d]+", low(text))
    parts = [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] if len(w) >= n else [" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(p.encode(), seed=42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups_by_hand(rows, radius=4):
    prints = [print_by_hand(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            same_id = rows[a][0] is not None and rows[a][0] == rows[b][0]
            both = rows[a][0] is not None and rows[b][0] is not None
            if same_id or prints[a] == prints[b] or (both and (prints[a] ^ prints[b]).bit_count() <= radius):
                root[find(a)] = find(b)
    least = defaultdict(list)
    for a in range(len(rows)):
        if rows[a][0] is not None:
            least[find(a)].append(rows[a][0])
    return sorted(((i, f"{prints[a]:016x}", min(least[find(a)], default=None)) for a, (i, _) in enumerate(rows)), key=repr)


def test_near_duplicates_of_odd_documents(odd_documents, odd_texts, no_documents):
    got = simhash.near_duplicates(odd_documents)
    assert sorted(map(tuple, got.collect()), key=repr) == groups_by_hand(odd_texts)
    assert simhash.near_duplicates(no_documents).count() == 0


@pytest.mark.parametrize(("radius", "block"), [(4, 20_000), (4, 5), (7, 20_000), (1, 20_000)])
def test_links_join_what_brute_force_joins(spark, radius, block):
    r = random.Random(radius)
    seeds = [r.getrandbits(64) for _ in range(40)]
    prints = set(seeds)
    for s in seeds[:25]:
        for _ in range(12):
            for b in r.sample(range(64), r.randint(1, radius + 2)):
                s ^= 1 << b
            prints.add(s)
    crowd = r.getrandbits(64)
    prints |= {crowd ^ (1 << a) ^ (1 << b) for a in range(8) for b in range(a)}
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    nodes = spark.createDataFrame([(i, p, p) for i, p in enumerate(signed)], "node bigint, fp bigint, confirm bigint")
    forest = simhash.Forest(len(prints))
    a, b = np.array([(x, y) for x in range(len(prints)) for y in range(x) if (prints[x] ^ prints[y]).bit_count() <= radius]).T
    forest.link(a, b)
    found = components.smallest_reachable(simhash.links(nodes, radius, block_rows=block)).collect()
    got = {x.node: x.component for x in found}
    assert [got.get(i, i) for i in range(len(prints))] == forest.root.tolist()


def test_thresholds_are_complete_and_cheapest():
    costs = np.random.default_rng(3).random((3, 5, 40)).cumsum(axis=1)
    got = simhash.allocate(costs, 2)
    assert (got.sum(axis=0) == 2).all() and got.min() >= -1
    every = [(a, b, 2 - a - b) for a in range(-1, 4) for b in range(-1, 4) if -1 <= 2 - a - b <= 3]
    for i in range(40):
        price = lambda t: sum(costs[k, t[k] + 1, i] for k in range(3))
        assert price(got[:, i]) == pytest.approx(min(map(price, every)))


def test_components_of_chains_stars_and_copies(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 560)] + [(7, 9), (9, 7), (3, 3), (7, 9)]
    got = {r.node: r.component for r in components.smallest_reachable(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: 500 for i in range(500, 560)}, 7: 7, 9: 7}


# ---- toxicity


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    labels = table(spark, sf, "labels").toPandas().set_index("doc_id").toxic
    got = toxicity.toxicity(table(spark, sf, "documents"), table(spark, sf, "labels")).toPandas().set_index("doc_id")
    assert len(got) == 1000 and got.score.between(0, 1).all()
    assert all(h == (zlib.crc32(str(i).encode()) % 4 == 2) for i, h in got.held_out.items())
    held = got[got.held_out].join(labels, how="inner")
    true = int(((held.toxic == 1) & (held.predicted == 1)).sum())
    assert true >= 0.7 * (held.toxic == 1).sum() and true >= 0.7 * held.predicted.sum()


def test_toxicity_of_odd_tables(spark, odd_documents, odd_texts, no_documents):
    labels = spark.createDataFrame([(1, 1), (2, 0), (1, 0), (None, 1), (3, None), (4, 7), (10, 1), (99, 1)], "doc_id bigint, toxic int")
    got = toxicity.toxicity(odd_documents, labels).collect()
    assert len(got) == len(odd_texts) and all(0 <= r.score <= 1 for r in got)
    empty = {r.score for r in got if r.doc_id in (4, 5, 6)}
    assert len(empty) == 1
    none = toxicity.toxicity(odd_documents, labels.limit(0)).collect()
    assert len({r.score for r in none}) == 1
    assert toxicity.toxicity(no_documents, labels).count() == 0


def test_log_count_ratios(spark):
    rows = [(i, "nice words here " + ("badword" if i % 3 == 0 else "good"), int(i % 3 == 0)) for i in range(60)]
    counts = toxicity.class_counts(spark.createDataFrame(rows, "doc_id bigint, text string, label int"))
    want = Counter()
    for _, t, y in rows:
        for h in toxicity.distinct_hashes(t).tolist():
            want[h, y] += 1
    assert {(r.ngram, r.toxic, r.clean) for r in counts.collect()} == {(h, want[h, 1], want[h, 0]) for h, _ in want}


# ---- language model


def scores_by_hand(rows, size, least):
    texts = [(i, re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))) for i, t in rows]
    c1 = Counter(w for _, t in texts for w in t)
    total = sum(c1.values())
    known = {w for w in c1 if sum(n >= c1[w] for n in c1.values()) <= size}
    texts = [(i, [w if w in known else None for w in t]) for i, t in texts]
    c1 = Counter(w for _, t in texts for w in t)
    c2 = Counter(p for _, t in texts for p in zip(t, t[1:], strict=False))
    out = []
    for i, t in texts:
        s = math.log(c1[t[0]] / total) if t else 0.0
        for p in zip(t, t[1:], strict=False):
            s += math.log(c2[p] / c1[p[0]]) if c2[p] >= least else math.log(0.4 * c1[p[1]] / total)
        out.append((i, len(t), round(s, 6)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("frequent", [1 / 100_000, 0.9])
@pytest.mark.parametrize("size", [65_535, 12])
def test_scores_equal_plain_python(odd_documents, odd_texts, size, frequent):
    got = language_model.lm_scores(odd_documents, vocabulary=size, frequent=frequent).collect()
    assert sorted([(r.doc_id, r.n_words, round(r.log_score, 6)) for r in got], key=repr) == scores_by_hand(odd_texts, size, 2)
    assert all((r.mean_log_score is None) == (r.n_words == 0) for r in got)


def test_scores_of_no_documents(no_documents):
    assert language_model.lm_scores(no_documents).count() == 0


# ---- mixing


def test_mixture_keeps_limits_and_budgets(spark, odd_documents, odd_texts, no_documents):
    got = mixing.mixture(odd_documents).toPandas()
    tokens = Counter()
    for r in odd_documents.select("source", mixing.token_count(F.col("text")).alias("n")).collect():
        tokens[r.source] += r.n
    total = sum(tokens.values())
    for source, rows in got.groupby(got.source.fillna("none")):
        source = None if source == "none" else source
        assert rows.n_tokens.sum() <= rows.weight.iloc[0] * total * (1 + 1e-6) + 1
        assert rows.weight.iloc[0] * total <= 1.25 * tokens[source] * (1 + 1e-6)
    assert mixing.mixture(no_documents).count() == 0 and mixing.mixed_documents(no_documents).count() == 0
    whole = mixing.mixed_documents(odd_documents)
    assert whole.columns == odd_documents.columns
    assert Counter(r.doc_id for r in whole.collect()) == Counter(None if math.isnan(i) else int(i) for i in got.doc_id)


def test_exponent_reaches_the_entropy(spark):
    sizes = spark.createDataFrame([("a", 900), ("b", 80), ("c", 15), ("d", 5)], "source_key string, tokens bigint")
    k, z = mixing.find_exponent(sizes, 1000.0, None, 1.0)
    entropy = lambda k: -sum(w * math.log(w) for s in (0.9, 0.08, 0.015, 0.005) for w in [s ** (k / 1e6) / sum(x ** (k / 1e6) for x in (0.9, 0.08, 0.015, 0.005))])
    assert entropy(k) >= 1.0 - 1e-9 > entropy(k + 1) - 1e-9 and z > 0
    assert mixing.find_exponent(sizes, 1000.0, None, 5.0)[0] == 0 and mixing.find_exponent(sizes, 1000.0, None, 0.0)[0] == mixing.UNIT
    k, _ = mixing.find_exponent(sizes, 1000.0, 2.0, None)
    worst = lambda k: max(s ** (k / 1e6) / s for s in (0.9, 0.08, 0.015, 0.005)) / sum(x ** (k / 1e6) for x in (0.9, 0.08, 0.015, 0.005))
    assert worst(k) <= 2.0 + 1e-9 < worst(k - 1) + 2e-5


# ---- quality


def test_quality_follows_the_labels(spark):
    sf = "/root/testdata/sf0.01"
    got = quality.quality(table(spark, sf, "documents"), table(spark, sf, "labels")).toPandas().set_index("doc_id")
    both = got.join(table(spark, sf, "labels").toPandas().set_index("doc_id").quality, how="inner")
    assert len(got) == 1000 and (both.keep == (both.quality == 1)).mean() > 0.97


def test_site_rates_are_shrunk_by_size(spark):
    rows = [("big", "p", 1.0 if i % 10 else 0.0) for i in range(400)] + [("bad", "p", 0.0)] * 200 + [("tiny", "p", 0.0)] * 2 + [("tiny", "q", 1.0)]
    sites, rate, host_k, path_k = quality.site_posteriors(spark.createDataFrame(rows, "host string, path string, e double"))
    assert rate == pytest.approx((sum(r[2] for r in rows) + 1) / (len(rows) + 2))
    assert quality.WEAKEST <= host_k < 50 and quality.WEAKEST <= path_k <= quality.STRONGEST
    got = {(r.host, r.path): (r.n, r.s, r.host_n, r.host_s) for r in sites.collect()}
    assert got["tiny", "p"] == (2, 0.0, 3, 1.0) and got["big", "p"][2] == 400


def features_by_hand(text):
    """The statistics one by one over characters, words and lines."""
    raw = (text or "").encode()
    if not raw.split():
        return [0.0] * 16
    letters = sum(65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in raw)
    spaces, digits = sum(b in b" \t\n\r\v\f" for b in raw), sum(48 <= b <= 57 for b in raw)
    controls = sum((b < 32 or b == 127) and b not in b"\t\n\r\v\f" for b in raw)
    stops, quotes = sum(b in b".,;:?!" for b in raw), sum(b in b"'\"()-" for b in raw)
    marks = len(raw) - letters - spaces - digits - controls
    words = bytes(b + 32 if 65 <= b <= 90 else b for b in raw).split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    rare = [b for b in range(128) if not (chr(b).isalnum() or b < 32 or b == 127 or b in b" .,;:?!'\"()-")]
    n = len(raw)
    return [
        letters / n, sum(65 <= b <= 90 for b in raw) / max(1, letters), digits / n, spaces / n, stops / n, quotes / n, marks / n,
        (marks - stops - quotes) / n, controls / n, len(set(words)) / len(words), len(set(lines)) / max(1, len(lines)),
        min(1, sum(map(len, words)) / len(words) / 20), sum(len(w) > 20 for w in words) / len(words),
        sum(w[-1] in rare or w[-1] == 33 for w in words) / len(words), min(1, len(words) / max(1, len(lines)) / 50),
        min(1, math.log1p(len(words)) / 12),
    ]


def test_features_equal_plain_counts(odd_texts):
    for _, text in odd_texts + [(0, "A! b? $$ c# \x01 12 (x) 'y' zz@\n\n A! b?")]:
        got = quality.features(None if text is None else text.encode())
        assert np.allclose(got, features_by_hand(text), atol=1e-6), text


def test_rates_and_scores_equal_plain_loops(spark):
    r = random.Random(8)
    rows = [(i, text_of(i, r.randint(1, 60)) if i % 9 else "!!! ### 00", f"h{i % 4}" if i % 11 else None, f"p{i % 3}") for i in range(160)]
    labels = [(i, int(i % 9 > 0)) for i in range(0, 160, 3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string")
    got = {x.doc_id: x for x in quality.quality(docs, spark.createDataFrame(labels, "doc_id bigint, quality int")).collect()}
    known, site = dict(labels), {i: (h or "none", (h or "none", p)) for i, _, h, p in rows}
    e = {i: float(known[i]) if i in known else x.own for i, x in got.items()}
    rate = (sum(e.values()) + 1) / (len(e) + 2)

    def sums(of):
        out = {}
        for i in e:
            n, s = out.get(of(i), (0, 0.0))
            out[of(i)] = (n + 1, s + e[i])
        return out

    def strength(groups, prior):
        seen = sum(n * (s / n - prior(k)) ** 2 for k, (n, s) in groups.items() if n >= 2)
        chance = sum(prior(k) * (1 - prior(k)) for k, (n, _) in groups.items() if n >= 2)
        scale = sum((n - 1) * prior(k) * (1 - prior(k)) for k, (n, _) in groups.items() if n >= 2)
        return min(max(1 / max((seen - chance) / scale, 1e-9) - 1, quality.WEAKEST), quality.STRONGEST)

    hosts, paths = sums(lambda i: site[i][0]), sums(lambda i: site[i][1])
    host_k = strength(hosts, lambda k: rate)
    path_k = strength(paths, lambda k: (hosts[k[0]][1] + host_k * rate) / (hosts[k[0]][0] + host_k))
    learned = (sum(q for _, q in labels) + 1) / (len(labels) + 2)
    for i, x in got.items():
        (hn, hs), (pn, ps) = hosts[site[i][0]], paths[site[i][1]]
        host_rate = (hs - e[i] + host_k * rate) / (hn - 1 + host_k)
        path_rate = (ps - e[i] + path_k * host_rate) / (pn - 1 + path_k)
        odds = math.log(x.own / (1 - x.own)) - math.log(learned / (1 - learned)) + math.log(path_rate / (1 - path_rate))
        assert x.host_rate == pytest.approx(host_rate, abs=1e-7) and x.path_rate == pytest.approx(path_rate, abs=1e-7)
        assert x.score == pytest.approx(1 / (1 + math.exp(-odds)), abs=1e-6) and x.keep == (x.score >= 0.25)


def test_quality_of_odd_tables(spark, odd_documents, odd_texts, no_documents):
    labels = spark.createDataFrame([(1, 1), (2, 0), (1, 0), (None, 1), (3, None), (4, 7), (99, 1)], "doc_id bigint, quality int")
    got = quality.quality(odd_documents, labels).collect()
    assert len(got) == len(odd_texts) and all(0 <= r.score <= 1 and 0 < r.path_rate < 1 for r in got)
    assert all(r.keep for r in quality.quality(odd_documents, labels.limit(0)).collect())
    assert quality.quality(no_documents, labels).count() == 0


# ---- pipeline


def test_stages_on_odd_documents(spark, odd_documents, odd_texts, no_documents, sf):
    docs = odd_documents.withColumn("text", F.coalesce("text", F.lit(None).cast("string")))
    kept = corpus_pipeline.keep_one_of_each(spark, docs, sf)
    assert kept.columns == docs.columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert ids[-5] == 1 and ids[1] == ids[2] == ids[3] == 0 and ids[12] == 1 and ids[13] == 1 and ids[16] == 1 and ids[15] == 0 and ids[None] == 2
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and out.count() <= 1.25 * len(odd_texts), name
        assert stage(spark, no_documents, sf).count() == 0, name


def test_pipeline_runs_and_drops_what_it_should(spark, sf):
    docs = table(spark, sf, "documents")
    labels = {r.doc_id: r.quality for r in table(spark, sf, "labels").collect()}
    first = corpus_pipeline.keep_quality(spark, docs, sf)
    kept = {r.doc_id for r in first.select("doc_id").collect()}
    assert sum(q == 0 and i in kept for i, q in labels.items()) <= 0.1 * sum(q == 0 for q in labels.values())
    clean = corpus_pipeline.drop_benchmark_passages(spark, docs, sf)
    hit = {r.doc_id for r in corpus_pipeline.decontaminate(docs, table(spark, sf, "benchmark")).filter("n_hit > 0").collect()}
    assert {r.doc_id for r in clean.select("doc_id").collect()} == {r.doc_id for r in docs.collect()} - hit and hit
    rows = corpus_pipeline.run(spark, sf).collect()
    at = 0
    for r in sorted(rows, key=lambda r: r.start):
        assert r.start == at and r.doc_id in kept
        at += r.n_tokens


@pytest.mark.parametrize("pairs", [1, 7, 50, 250_000])
def test_forest_edges_do_not_depend_on_the_pairs_compared_at_once(monkeypatch, pairs):
    monkeypatch.setattr(simhash, "PAIRS", pairs)
    r = random.Random(3)
    prints, node = np.array([r.getrandbits(6) for _ in range(120)], dtype=np.uint64), np.arange(120) * 3
    bucket, order = (prints >> np.uint64(3)).astype(np.int64), np.random.default_rng(1).permutation(240)
    twice = [np.r_[x, x][order] for x in (bucket, node, prints)]
    asks = np.repeat([False, True], 120)[order]
    got, want = simhash.Forest(400), simhash.Forest(400)
    got.link(*simhash.forest_edges(*twice, twice[2], asks, 1, 64))
    linked = [(node[i], node[j]) for i in range(120) for j in range(i)
              if bucket[i] == bucket[j] and int(prints[i] ^ prints[j]).bit_count() <= 1]
    want.link(*np.array(linked).T)
    assert (got.root == want.root).all()
