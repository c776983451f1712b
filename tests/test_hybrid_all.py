"""The whole blended list, with no shuffled pair."""

import random

from cofolio.operators import recommend as rec
from pyspark.sql import functions as F


def test_the_same_as_the_blend_of_two_whole_lists(spark, monkeypatch):
    monkeypatch.setattr(rec, "FULL_BLOCK_ROWS", 16)
    rng = random.Random(4)
    model = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(3)], rng.uniform(0, 1)) for i in range(40)], "item_id long, q array<double>, bias double")
    watch = [(u, i, rng.uniform(0.2, 3), k) for u in range(30) for k, i in enumerate(rng.sample(range(44), 1 + u % 4))]
    watch = spark.createDataFrame([*watch, (77, 43, 1.0, 0)], "user_id long, item_id long, weight double, pos int")
    graph = [(u, i, rng.uniform(0, 2), rng.uniform(0, 1), rng.randint(1, 3)) for u in [*range(32), 77] for i in rng.sample(range(44), u % 9)]
    graph = spark.createDataFrame(graph, "user_id long, item_id long, score double, strongest double, support long").join(watch.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti")
    plain = lambda df: sorted(map(tuple, df.select("user_id", "item_id", F.round("score", 9), F.round("strongest", 9), "support").where("round(score, 9) > 0").collect()))
    got = rec.hybrid_all(graph, watch, model, 0.4)
    assert plain(got) == plain(rec.hybrid(graph, rec.model_scores(watch, model), 0.4))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Union") < plan.index("FlatMapCoGroupsInArrow")
    assert not any(x in plan[: plan.index("FlatMapCoGroupsInArrow")] for x in ("Join", "Window", "Aggregate"))  # nothing is shuffled after the cells
