"""The inner-product index and exact blended lists against all pairs."""

import random

import pytest
from cofolio.operators import inner_product
from cofolio.operators import recommend as rec
from cofolio.operators.inner_product import best_scores, item_index, pair_scores
from pyspark.sql import functions as F


def dot(a, b):
    return sum(x * y for x, y in zip(a, b, strict=True))


def model_of(spark, items):
    return spark.createDataFrame([(i, q, b) for i, (q, b) in items.items()], "item_id long, q array<double>, bias double")


@pytest.mark.parametrize(("sign", "largest"), [(1, True), (-1, True), (-1, False)])
def test_best_scores_are_those_of_all_pairs(spark, sign, largest):
    """Norms fall like popularity, so blocks are skipped; with ``sign`` -1 all scores are negative."""
    rng = random.Random(8)
    items = {i: ([sign * abs(rng.gauss(0, 1)) * 9 / (1 + i) for _ in range(4)], rng.uniform(-0.1, 0.1)) for i in range(300)}
    items |= {300 + i: items[i] for i in range(3)}  # ties
    users = {u: [abs(rng.gauss(0, 1)) for _ in range(4)] for u in range(40)}
    hidden = {(u, i) for u in users for i in rng.sample(range(303), u % 7)} | {(0, 999), (999, 1)}
    got, compared, total = best_scores(
        spark.createDataFrame(list(users.items()), "user_id long, p array<double>"), item_index(model_of(spark, items), 16), 5,
        spark.createDataFrame(sorted(hidden), "user_id long, item_id long"), 0.5, largest,
    )
    found = {}
    for r in got.collect():
        found.setdefault(r.user_id, {})[r.item_id] = r.score
    for u, p in users.items():
        every = sorted(((dot(p, q) + b + 0.5, i) for i, (q, b) in items.items() if (u, i) not in hidden), reverse=largest)
        edge = every[4][0]
        want = {i: s for s, i in every if (s >= edge - 1e-9 if largest else s <= edge + 1e-9)}
        assert found[u] == pytest.approx(want)
    assert total == 40 * 19 and compared <= total
    if (sign == 1) == largest:  # the best ones have large norms
        assert compared < 0.5 * total


def test_index_of_odd_rows(spark):
    items = spark.createDataFrame([(1, [1.0, 2.0], None), (2, None, 1.0), (3, [], 1.0), (4, [1.0], 1.0), (5, [-1.0, 0.0], 2.0)], "item_id long, q array<double>, bias double")
    users = spark.createDataFrame([(1, [1.0, 1.0]), (2, None), (3, []), (4, [2.0]), (None, [0.0, 1.0])], "user_id long, p array<double>")
    got, _, _ = best_scores(users, item_index(items), 3)
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, 1, 3.0), (1, 5, 1.0), (4, 4, 3.0), (None, 1, 2.0), (None, 5, 2.0)], key=str)
    assert best_scores(users.limit(0), item_index(items), 3)[0].count() == 0 and best_scores(users, item_index(items.limit(0)), 3)[0].count() == 0
    pairs = spark.createDataFrame([(1, 1), (1, 4), (4, 4), (9, 1)], "user_id long, item_id long")
    assert sorted(map(tuple, pair_scores(pairs, users, items).collect())) == [(1, 1, 3.0), (4, 4, 3.0)]


@pytest.mark.parametrize(("weight", "lists"), [(0.4, False), (0.4, True)])
def test_blended_top_is_that_of_all_scores(spark, weight, lists):
    rng = random.Random(9)
    items = {i: ([rng.gauss(0, 1) for _ in range(3)], rng.uniform(0, 0.2)) for i in range(60)}
    items |= {60: items[0], 61: items[1]}
    watch = spark.createDataFrame([(u, i, rng.uniform(0.2, 3), k) for u in range(8) for k, i in enumerate(rng.sample(range(62), 1 + u % 4))], "user_id long, item_id long, weight double, pos int")
    graph = spark.createDataFrame([(u, i, rng.uniform(0, 2), rng.uniform(0, 1), rng.randint(1, 3)) for u in range(9) for i in rng.sample(range(70), u)], "user_id long, item_id long, score double, strongest double, support long")
    graph = graph.join(watch.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti")
    model = model_of(spark, items)
    include = spark.createDataFrame([(u, i) for u in (1, 2) for i in rng.sample(range(62), 20)], "user_id long, item_id long") if lists else None
    exclude = spark.createDataFrame([(u, i) for u in range(4) for i in rng.sample(range(62), 10)], "user_id long, item_id long") if lists else None
    allowed = spark.range(0, 62, 3).select(F.col("id").alias("item_id")) if lists else None
    k = 6
    every = rec.listed_only(rec.hybrid(graph, rec.model_scores(watch, model), weight), include, exclude)
    every = every if allowed is None else every.join(allowed, "item_id", "left_semi")
    rounded = lambda df: df.withColumn("score", F.round("score", 9)).withColumn("strongest", F.round("strongest", 9))
    rows = rec.hybrid_parts(graph, watch, model, weight, k, allowed, include, exclude, block_items=8)[0]
    plain = lambda df: sorted((r.user_id, r["rank"], r.item_id, r.score, r.support) for r in rec.ranked(rounded(df), k).collect())
    assert plain(rows) == plain(every)
    by_user = {r.user_id: r["count"] for r in rows.groupBy("user_id").count().collect()}
    candidates = {r.user_id: r["count"] for r in graph.groupBy("user_id").count().collect()}
    listed = {r.user_id: r["count"] for r in include.groupBy("user_id").count().collect()} if lists else {}
    assert all(n <= k + 1 + candidates.get(u, 0) + listed.get(u, 0) for u, n in by_user.items())  # one pair of twins may tie


def test_lower_bound_of_known_users(spark):
    items = model_of(spark, {1: ([1.0], 0.0), 2: ([2.0], 0.0), 3: ([3.0], 0.0)})
    users = spark.createDataFrame([(1, [1.0], 0.5), (2, [-1.0], 0.0)], "user_id long, p array<double>, bu double")
    seen = spark.createDataFrame([(1, 3)], "user_id long, item_id long")
    got = rec.known_user_recommend(users, items, seen, 5, min_score=-2.0, global_mean=0.0).collect()
    assert sorted((r.user_id, r.item_id, r.score, r["rank"]) for r in got) == [(1, 1, 1.5, 2), (1, 2, 2.5, 1), (2, 1, -1.0, 1), (2, 2, -2.0, 2)]


@pytest.mark.parametrize("most", [256, 2])
def test_equal_vectors_meet_the_items_once(spark, monkeypatch, most):
    """Forty users with four vectors and lists of hidden items of their own; those who hide more than ``most`` go alone."""
    monkeypatch.setattr(inner_product, "MOST_HIDDEN", most)
    monkeypatch.setattr(inner_product, "GROUP_BLOCKS", 2)
    rng = random.Random(12)
    items = {i: ([rng.gauss(0, 1), rng.gauss(0, 1)], rng.uniform(0, 1)) for i in range(90)}
    vectors = [[rng.gauss(0, 1), rng.gauss(0, 1)] for _ in range(4)]
    users = {u: vectors[u % 4] for u in range(40)}
    hidden = {(u, i) for u in users for i in rng.sample(range(90), u % 6)}
    got, _, total = best_scores(
        spark.createDataFrame(list(users.items()), "user_id long, p array<double>"), item_index(model_of(spark, items), 8), 3, spark.createDataFrame(sorted(hidden), "user_id long, item_id long"),
    )
    found = {}
    for r in got.collect():
        found.setdefault(r.user_id, {})[r.item_id] = r.score
    for u, p in users.items():
        every = sorted(((dot(p, q) + b, i) for i, (q, b) in items.items() if (u, i) not in hidden), reverse=True)
        assert found[u] == pytest.approx({i: s for s, i in every[:3]})
    alone = sum(1 for u in users if u % 6 > most)
    assert total == (4 + alone) * 12
