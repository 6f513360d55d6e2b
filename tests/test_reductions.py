"""Joins that leave out work: probes against their promised recall, blocks and ordered cells against all pairs."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from recollect.operators import lookup as L
from recollect.plans import bounds as B
from recollect.plans import probes as PR
from recollect.plans import similarity as SI

DIM = 32


def unit(v):
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def grouped(rng, groups=12, each=25, spread=0.15):
    centres = unit(rng.standard_normal((groups, DIM)))
    return unit(np.repeat(centres, each, axis=0) + spread * rng.standard_normal((groups * each, DIM)))


def frame(spark, vectors, first=0):
    rows = [(first + i, first + i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "id bigint, seq bigint, embedding array<float>")


def sides(df):
    return df.withColumnRenamed("id", "query_id"), df.withColumnRenamed("id", "entry_id")


def pairs(df, names=("query_id", "entry_id", "rank")):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


# ---- probes


@pytest.mark.parametrize(("bits", "tables", "floor"), [(3, 2, 0.3), (6, 4, 0.5), (8, 3, 0.7), (12, 4, 0.8)])
def test_probes_reach_the_recall_wanted(bits, tables, floor):
    """Planes and tables are not quite independent, which is why the chance asked for lies above the recall wanted."""
    rng = np.random.default_rng(bits)
    p = PR.Probes(DIM, tables, bits, floor)
    normals = PR.planes(p)
    q = unit(rng.standard_normal((600, DIM)))
    across = rng.standard_normal(q.shape)
    across -= (across * q).sum(axis=1, keepdims=True) * q
    near = floor * q + np.sqrt(1 - floor**2) * unit(across)  # neighbours at exactly the floor
    rows, table, bucket = PR.visited(q, normals, p)
    own = PR.buckets_of(near, normals)
    met = set(rows[own[rows, table] == bucket].tolist())
    assert len(met) / len(q) >= 0.9
    assert len(set(zip(rows.tolist(), table.tolist(), bucket.tolist()))) == len(rows)


def test_probes_visit_less_for_nearer_neighbours():
    rng = np.random.default_rng(5)
    q = unit(rng.standard_normal((200, DIM)))
    visits = [len(PR.visited(q, PR.planes(p), p)[0]) for p in (PR.Probes(DIM, 4, 8, f, 0.9) for f in (0.5, 0.7, 0.9, 0.99))]
    assert visits == sorted(visits, reverse=True) and visits[-1] < 3 * len(q)


def test_own_bucket_is_visited_first_and_planes_do_not_depend_on_their_number():
    rng = np.random.default_rng(6)
    q = unit(rng.standard_normal((50, DIM)))
    p = PR.Probes(DIM, 3, 5, 0.999, 0.5)
    rows, table, bucket = PR.visited(q, PR.planes(p), p)
    own = PR.buckets_of(q, PR.planes(p))
    assert set(rows[own[rows, table] == bucket].tolist()) == set(range(50))
    assert np.array_equal(PR.planes(p), PR.planes(PR.Probes(DIM, 3, 9, 0.5))[:, :5])


def test_probes_follow_rows_and_refuse_nonsense():
    assert PR.probes_for(100, 0.7, 64).bits == 1 and PR.probes_for(10**9, 0.7, 64).bits == 18
    with pytest.raises(ValueError):
        PR.Probes(64, 4, 40, 0.7)
    with pytest.raises(ValueError):
        PR.Probes(64, 4, 4, 0.7, reach=1.0)


def test_join_by_probes_finds_neighbours(spark):
    q, e = sides(frame(spark, grouped(np.random.default_rng(7))))
    near = L.nearest(q, e, 5, PR.Probes(DIM, 4, 5, 0.6, 0.95), floor=0.6, skip_same=True)
    exact = L.nearest(q, e, 5, None, floor=0.6, skip_same=True)
    r = L.recall(near, exact).first()
    assert r.pairs > 500 and r.recall >= 0.9
    assert near.groupBy("query_id", "entry_id").count().filter("count > 1").count() == 0


def test_probes_of_null_empty_and_zero_vectors(spark):
    df = spark.createDataFrame([(1, None), (2, []), (3, [0.0] * DIM), (4, [1.0] + [0.0] * (DIM - 1))], "id int, embedding array<float>")
    p = PR.Probes(DIM, 2, 3, 0.9)
    got = {r.id for r in PR.placed(df, "embedding", p, True).collect()}
    assert got == {3, 4}
    assert PR.placed(df, "embedding", p, False).count() == 4
    assert PR.placed(df.limit(0), "embedding", p, True).count() == 0


# ---- blocks


@pytest.mark.parametrize("options", [
    {"k": 4, "skip_same": True}, {"k": 1, "floor": 0.5}, {"k": 3, "floor": 0.8, "skip_same": True}, {"k": 2, "earlier_only": True}, {"k": 2, "group": ["tenant"]},
])
def test_blocks_leave_the_rows_as_they_are(spark, options):
    rng = np.random.default_rng(8)
    df = frame(spark, np.vstack([grouped(rng), unit(rng.standard_normal((60, DIM)))])).withColumn("tenant", F.col("id") % 2)
    q, e = sides(df)
    options = dict(options)
    k = options.pop("k")
    want = pairs(SI.best_matches(q, e, k, **options))
    assert pairs(B.bounded_matches(q, e, k, B.Blocks(entries=20), **options)) == want and want


def test_blocks_obey_own_limits(spark):
    q, e = sides(frame(spark, grouped(np.random.default_rng(9))))
    limit = F.when(F.col("entry_id") % 3 == 0, 0.95).otherwise(0.4)
    for obey in (True, False):
        same = {"entry_limit": limit, "obey_limit": obey, "skip_same": True}
        assert pairs(B.bounded_matches(q, e, 2, B.Blocks(entries=16), **same)) == pairs(SI.best_matches(q, e, 2, **same))


def test_vectors_that_are_not_unit_vectors(spark):
    rng = np.random.default_rng(10)
    q, e = sides(frame(spark, grouped(rng) * rng.uniform(0.1, 3, (300, 1))))
    assert pairs(B.bounded_matches(q, e, 3, B.Blocks(entries=30), floor=0.9)) == pairs(SI.best_matches(q, e, 3, floor=0.9))


def test_fewer_cells_where_vectors_lie_together(spark):
    rng = np.random.default_rng(11)
    q, e = sides(frame(spark, grouped(rng, spread=0.03)))
    tight = B.cells_formed(q, e, F.lit(0.8), B.Blocks(entries=25)).first()
    q, e = sides(frame(spark, unit(rng.standard_normal((300, DIM)))))
    even = B.cells_formed(q, e, F.lit(0.1), B.Blocks(entries=25)).first()
    assert tight.share < 0.35 and even.share > 0.9 and tight.clusters == even.clusters == 12


def test_blocks_of_odd_tables(spark):
    none = frame(spark, []) if False else spark.createDataFrame([], "id bigint, seq bigint, embedding array<float>")
    some = spark.createDataFrame([(1, 1, None), (2, 2, []), (3, 3, [0.0] * DIM), (4, 4, [0.5] * DIM)], "id bigint, seq bigint, embedding array<float>")
    for a, b in ((none, some), (some, none), (some, some)):
        q, _ = sides(a)
        _, e = sides(b)
        assert pairs(B.bounded_matches(q, e, 2, B.Blocks(entries=1))) == pairs(SI.best_matches(q, e, 2))


# ---- cells of an order


def test_later_cells_are_not_formed(spark):
    df = frame(spark, grouped(np.random.default_rng(12)))
    q, e = sides(df)
    for size in (10, 37, 10_000):
        got = SI.best_matches(q, e, 2, earlier_only=True, entry_block=size, query_block=size)
        assert pairs(got) == pairs(SI.best_matches(q, e, 2, earlier_only=True))
    cuts = SI.order_cuts(q.select("seq"), e.select("seq"), 10)
    placed = SI._earlier_cells(
        q.select(F.col("query_id").alias("_id"), F.col("embedding").alias("_vec"), F.lit(0.0).alias("_limit"), F.col("seq").alias("_seq")),
        e.select(F.col("entry_id").alias("_id"), F.col("embedding").alias("_vec"), F.lit(0.0).alias("_limit"), F.col("seq").alias("_seq")),
        cuts, SI.StructType([SI.StructField("query_id", df.schema["id"].dataType), SI.StructField("entry_id", df.schema["id"].dataType)]),
    )
    parts = len(cuts) + 1
    assert parts == 30 and placed.select("_cell").distinct().count() == parts * (parts + 1) // 2


def test_order_with_gaps_ties_and_nulls(spark):
    rows = [(i, s, [1.0, i / 10.0]) for i, s in enumerate([5, 5, None, 10**12, -3, 7, 7, 8])]
    df = spark.createDataFrame(rows, "id bigint, seq bigint, embedding array<float>")
    q, e = sides(df)
    got = pairs(SI.best_matches(q, e, 10, earlier_only=True, entry_block=1, query_block=1), ("query_id", "entry_id"))
    assert got == sorted((a, b) for a, s, _ in rows for b, t, _ in rows if s is not None and t is not None and t < s)


# ---- what is sent


@pytest.mark.parametrize(("bits", "tables", "floor"), [(1, 1, 0.5), (6, 4, 0.3), (12, 3, 0.2)])
def test_the_last_visit_tells_all_visits(bits, tables, floor):
    rng = np.random.default_rng(bits)
    p = PR.Probes(DIM, tables, bits, floor)
    q, e = unit(rng.standard_normal((40, DIM))), unit(rng.standard_normal((300, DIM)))
    own = PR.buckets_of(e, PR.planes(p))
    rows, table, bucket = PR.visited(q, PR.planes(p), p)
    want = np.zeros((len(q), len(e)), dtype=bool)
    for r, t, b in zip(rows, table, bucket, strict=True):
        want[r] |= own[:, t] == b
    visits = PR.Visits(p)
    asking = visits.of_queries(q, PR.last_visits(q, PR.planes(p), p))
    r, c = (x.ravel() for x in np.indices(want.shape))
    assert np.array_equal(visits.pairs(visits.of_entries(e, np.zeros(len(e))), asking, r, c).reshape(want.shape), want) and not want.all()


def test_probes_and_blocks_send_a_query_once_per_part(spark, monkeypatch):
    """Before, a query was sent once per bucket or cluster it needs: here 30 times and more."""
    rng = np.random.default_rng(21)
    q, e = sides(frame(spark, unit(rng.standard_normal((300, DIM)))))
    sent = spark.sparkContext.accumulator(0)
    kernel = SI._cell_kernel

    def counting(*args):
        run = kernel(*args)

        def counted(batches):
            def told():
                for b in batches:
                    sent.add(b.num_rows)
                    yield b

            return run(told())

        return counted

    monkeypatch.setattr(SI, "_cell_kernel", counting)
    assert L.nearest(q, e, 2, PR.Probes(DIM, 4, 6, 0.3), skip_same=True).count() == 600
    assert sent.value <= 2 * SI.PARTS * 300
    before = sent.value
    assert L.nearest(q, e, 2, B.Blocks(entries=10), skip_same=True).count() == 600
    assert sent.value - before <= 2 * SI.PARTS * 300 + 600


def test_copies_and_chunks_keep_the_lowest_ids(spark):
    """More copies than a chunk holds, and ids that come twice, in both directions of the ids."""
    rng = np.random.default_rng(22)
    v = np.vstack([np.repeat(unit(rng.standard_normal((1, DIM))), 700, axis=0), unit(rng.standard_normal((100, DIM)))])
    q, e = sides(frame(spark, v[::-1]))
    sims = np.round(v[::-1].astype(np.float32).astype(float) @ v[::-1].astype(np.float32).astype(float).T, 9)
    want = sorted((i, j, n) for i in range(800) for n, j in enumerate(sorted((j for j in range(800) if j != i), key=lambda j: (-sims[i, j], j))[:3], 1))
    assert pairs(SI.best_matches(q, e, 3, skip_same=True)) == want
    assert pairs(B.bounded_matches(q, e, 3, B.Blocks(entries=100), skip_same=True)) == want
    p = PR.Probes(DIM, 4, 2, 0.5)
    once = pairs(L.nearest(q, e, 3, p, skip_same=True))
    assert pairs(L.nearest(q, e.union(e), 3, p, skip_same=True)) == once and len(once) == 2400


def test_parts_hold_every_cluster_once():
    rng = np.random.default_rng(23)
    sizes = rng.integers(0, 400, 500)
    part = B.parts_of(unit(rng.standard_normal((500, DIM))), sizes)
    assert part.min() == 0 and part.max() == SI.PARTS - 1
    assert np.bincount(part, weights=sizes).max() <= sizes.sum() / SI.PARTS + sizes.max()
