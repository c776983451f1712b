"""Pair weights folded by ranges of users."""

import random

import pytest
from cofolio.operators import graph


def folded(ratings):
    """By a loop over users in order."""
    want = {}
    for u in sorted({u for u, _, _ in ratings}):
        mine = sorted((i, s) for v, i, s in ratings if v == u)
        for k, (i, a) in enumerate(mine):
            for j, b in mine[k + 1 :]:
                w, n, first = want.get((i, j), (None, 0, u))
                want[i, j] = ((a + b) / 2 if w is None else (w + (a + b) / 2) / 2, n + 1, first)
    return want


@pytest.mark.parametrize(("ranges", "rows", "occurrences", "piece"), [(100_000, 100_000, 2_000_000, 1024), (20, 7, 5, 1024), (15, 3, 1, 3)])
def test_folds_are_those_of_a_loop(spark, monkeypatch, ranges, rows, occurrences, piece):
    """In one range and fold, in many, and with lists cut into pieces."""
    for name, value in (("RANGE_RATINGS", ranges), ("FOLD_ROWS", rows), ("FOLD_OCCURRENCES", occurrences)):
        monkeypatch.setattr(graph, name, value)
    rng = random.Random(rows)
    ratings = [(u, i, float(rng.randint(1, 10))) for u in range(30) for i in rng.sample(range(9), rng.randint(1, 9))]
    df = spark.createDataFrame([*ratings, (None, 1, 1.0), (None, 2, 1.0), (3, None, 1.0)], "user_id long, item_id long, normalized_score double")
    want = folded(ratings)
    got = {(r.lo, r.hi): (r.weight, r.n, r.first_user) for r in graph.corated(df, digits=10, piece=piece).collect()}
    assert got.keys() == want.keys() and all(got[k] == (pytest.approx(want[k][0], abs=1e-9), *want[k][1:]) for k in want)
    assert graph.corated(df.limit(0)).count() == 0


def test_text_ids(spark):
    ratings = [("b", "y", 2.0), ("b", "x", 4.0), ("a", "x", 1.0), ("a", "y", 2.0)]
    got = graph.corated(spark.createDataFrame(ratings, "user_id string, item_id string, normalized_score double")).collect()
    assert [tuple(r) for r in got] == [("x", "y", 2.25, 2, "a")]


def test_occurrences_are_folded_before_they_are_shuffled(spark, monkeypatch):
    """A thousand users with the same ten items: a row a pair and fold leaves the tasks, not one an occurrence."""
    monkeypatch.setattr(graph, "RANGE_RATINGS", 1000)
    df = spark.range(10_000).selectExpr("id div 10 as user_id", "id % 10 as item_id", "cast(id % 7 as double) as normalized_score")
    got = graph.corated(df)
    assert got.count() == 45 and got.agg({"n": "sum"}).first()[0] == 45_000
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(lo") == 1 and "collect_list" not in plan
