"""Pairs, folds and commits where one key holds most of the rows."""

import random

import pytest
from cofolio.operators import graph
from pyspark.sql import functions as F


def test_a_pair_of_a_million_users(spark):
    """Folded in segments, one row of which a pair goes on; equal to the fold in a loop."""
    rows = spark.range(1_000_000).select(F.col("id").alias("user_id"), F.lit(1).alias("lo"), F.lit(2).alias("hi"), (F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000).alias("s"), F.expr("id div 65536").alias("seg"))
    w = None
    for (s,) in rows.orderBy("user_id").select("s").collect():
        w = s if w is None else (w + s) / 2
    got = graph.pair_weights(rows, digits=12).collect()
    assert len(got) == 1 and (got[0].n, got[0].first_user) == (1_000_000, 0) and got[0].weight == pytest.approx(w, abs=1e-12)
    assert "Window" not in graph.pair_weights(rows)._jdf.queryExecution().toString()


@pytest.mark.parametrize("size", [1, 3, 100])
def test_segments_fold_as_one(spark, size):
    rng = random.Random(size)
    ratings = [(u, i, float(rng.randint(1, 10))) for u in range(20) for i in rng.sample(range(6), rng.randint(1, 6))]
    df = spark.createDataFrame(ratings, "user_id long, item_id long, normalized_score double")
    want = {}
    for u in range(20):
        mine = sorted((i, s) for v, i, s in ratings if v == u)
        for k, (i, a) in enumerate(mine):
            for j, b in mine[k + 1 :]:
                w, n, first = want.get((i, j), (None, 0, u))
                want[i, j] = ((a + b) / 2 if w is None else (w + (a + b) / 2) / 2, n + 1, first)
    got = {(r.lo, r.hi): (r.weight, r.n, r.first_user) for r in graph.pair_weights(graph.item_pairs(graph.with_segments(df, size)), digits=10).collect()}
    assert got.keys() == want.keys() and all(got[k] == (pytest.approx(want[k][0], abs=1e-9), *want[k][1:]) for k in want)


def test_a_heavy_list_is_paired_in_pieces(spark):
    """One user with a hundred times the ratings: the same pairs, and no key of more than some piece's rows a side."""
    rows = [(0, i, float(i % 7)) for i in range(600)] + [(u, i, float(u % 5)) for u in range(1, 100) for i in range(u % 7)]
    df = spark.createDataFrame(rows, "user_id long, item_id long, normalized_score double")
    plain = lambda p: sorted(map(tuple, p.collect()))
    got = graph.item_pairs(df, piece=50)
    assert plain(got) == plain(graph.item_pairs(df, piece=10_000))
    assert got.count() == 600 * 599 // 2 + sum((u % 7) * (u % 7 - 1) // 2 for u in range(1, 100))
    assert graph.item_pairs(df.limit(0)).count() == 0
