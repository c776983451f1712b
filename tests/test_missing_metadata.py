"""Counts of unwatched items without metadata."""

from cofolio.operators import recommend as rec


def test_counts_are_those_of_all_scores_and_no_pair_is_made(spark):
    model = spark.createDataFrame([(i, [1.0, i / 2], 0.0) for i in range(9)], "item_id long, q array<double>, bias double")
    watch = [(1, 0), (1, 5), (2, 8), (3, 77), (4, 1), (4, 77), *((5, i) for i in range(9))]
    watch = spark.createDataFrame([(u, i, 1.0, 1) for u, i in watch], "user_id long, item_id long, weight double, pos int")
    features = spark.createDataFrame([(i,) for i in (0, 1, 2, 3, 3, 50)], "item_id long")
    got = rec.model_missing_metadata(watch, model, features)
    want = sorted(map(tuple, rec.missing_metadata(rec.model_scores(watch, model), features).collect()))
    assert sorted(map(tuple, got.collect())) == want == [(1, 4), (2, 4), (4, 5)]
    assert "Cogroup" not in got._jdf.queryExecution().toString()
