"""The edges of a graph are worked out once, however often a query meets them."""

from cofolio.operators import graph
from pyspark.sql import functions as F


def test_each_pair_is_worked_out_once(spark):
    met = spark.sparkContext.accumulator(0)

    def weigh(batches):
        for batch in batches:
            met.add(batch.num_rows)
            yield batch

    pairs = spark.range(1, 9).select(F.col("id").alias("lo"), (F.col("id") + 1).alias("hi"), (F.col("id") / 4).alias("weight")).mapInArrow(weigh, "lo long, hi long, weight double")
    got = {(r.src, r.dst): r.w for r in graph.normalised_adjacency(graph.symmetric(pairs)).collect()}
    degree = {}
    for k in range(1, 9):
        for node in (k, k + 1):
            degree[node] = degree.get(node, 0) + k / 4
    assert set(got) == {e for k in range(1, 9) for e in ((k, k + 1), (k + 1, k))}
    assert all(abs(w - min(e) / 4 / (degree[e[0]] * degree[e[1]]) ** 0.5) < 1e-12 for e, w in got.items())
    assert met.value == 8
