"""Candidates of watch-lists of any length, and the lines that explain them."""

import random

from cofolio.functions import scalars as fn
from cofolio.operators import recommend as rec
from pyspark.sql import functions as F

SCHEMA = "user_id long, item_id long, weight double, pos int"


def _tables(spark):
    rng = random.Random(5)
    watch = [(u, i, 1.0, k) for u in range(12) for k, i in enumerate(rng.sample(range(20), 1 + u))] + [(None, 3, 1.0, 1), (None, 4, 1.0, 2), (1, None, 1.0, 9), (2, 3, 2.0, 9)]
    edges = [(a, b, rng.choice([-1.0, -0.5, 0.5, 1.0])) for a in range(20) for b in range(24) if a != b and rng.random() < 0.6] + [(3, None, 0.5)]
    return watch, edges, spark.createDataFrame(watch, SCHEMA), spark.createDataFrame(edges, "src long, dst long, weight double")


def test_all_lists_and_edges_give_the_plain_result(spark, monkeypatch):
    watch, edges, w, a = _tables(spark)
    seen = {(u, i) for u, i, _, _ in watch if u is not None and i is not None}
    want = sorted(((u, d, i, k, e, x, e * x) for u, i, x, k in watch for s, d, e in edges if i is not None and s == i and (u, d) not in seen), key=repr)
    for short, few in ((64, 1000), (4, 1000), (4, 0), (0, 0)):
        monkeypatch.setattr(rec, "SHORT_LIST", short)
        monkeypatch.setattr(rec, "FEW_EDGES", few)
        got = rec.graph_candidates(w, a).select("user_id", "item_id", "watched_id", "pos", "edge_weight", "weight_factor", "weighted")
        assert sorted(map(tuple, got.collect()), key=repr) == want, (short, few)


def test_candidates_are_not_shuffled(spark):
    """Only lists and edges are: what follows from them has no exchange of its own, with every join by a shuffle where Spark may choose."""
    _, _, w, a = _tables(spark)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = rec.graph_contributions(rec.graph_candidates(w, a))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in plan


def test_lines_by_size_then_by_place(spark):
    parts = [("a", 0.5), ("b", -1.0), ("c", 0.5), ("d", 2.0), ("e", -1.0), ("f", 0.0), ("g", -0.0001), ("h", 0.9996)]
    df = spark.createDataFrame([(parts,), (parts[:1],), ([],)], "p array<struct<label: string, weighted: double>>")
    got = [r[0] for r in df.select(fn.explain_line(F.col("p"))).collect()]
    assert got == ["for: d (+2.000) | h (+1.000); against: b (-1.000) | e (-1.000)", "for: a (+0.500); against: nothing", "for: nothing; against: nothing"]
