"""Include and exclude lists after a run of actions, against a loop; BPR steps by batch."""

import random

import pytest
from cofolio.operators import graph, training
from cofolio.operators import recommend as rec
from pyspark.sql import functions as F


def test_lists_are_the_loop(spark):
    rng = random.Random(8)
    actions = [(rng.randrange(4), rng.randrange(6), n, rng.choice(["include", "exclude", "remove"])) for n in range(300)]
    watch = {(0, 1), (2, 3), (3, 3)}
    lists, outcomes = {}, []
    for u, i, n, act in actions:
        mine = lists.setdefault(u, {"include": {}, "exclude": {}})
        on = next((m for m in mine if i in mine[m]), None)
        if (u, i) in watch:
            outcomes.append((n, "watched"))
        elif act == "remove":
            outcomes.append((n, "removed" if on else "absent"))
            if on:
                del mine[on][i]
        elif act == on:
            outcomes.append((n, "already"))
        else:
            if on:
                del mine[on][i]
            mine[act][i] = n
            outcomes.append((n, "added"))
    odd = [(None, 1, 400, "include"), (1, None, 401, "include"), (1, 1, 402, None), (1, 1, 403, "else"), (1, 1, None, "include")]
    df = spark.createDataFrame(actions + odd, "user_id long, item_id long, seq long, action string")
    got = rec.list_outcomes(df, spark.createDataFrame([*watch, *watch], "user_id long, item_id long"))
    assert sorted((r.seq, r.outcome) for r in got.collect()) == outcomes
    want = {(u, i, m, n) for u, mine in lists.items() for m, items in mine.items() for i, n in items.items()}
    assert {tuple(r) for r in rec.updated_lists(got).collect()} == want


@pytest.fixture(scope="module")
def bpr(spark):
    rng = random.Random(1)
    edges = [(f"u{u}", f"i{i}", 1.0) for u in range(6) for i in rng.sample(range(8), 3)]
    adj = graph.normalised_adjacency(spark.createDataFrame(edges + [(b, a, w) for a, b, w in edges], "src string, dst string, weight double"))
    triples = spark.createDataFrame([(u, i, f"i{rng.randrange(8)}") for u, i, _ in edges], "u string, i string, j string")
    names = [f"u{u}" for u in range(6)] + [f"i{i}" for i in range(8)]
    nodes = spark.createDataFrame([(n, [rng.uniform(-1, 1) for _ in range(3)]) for n in names], "node string, v array<double>")
    return adj, triples, nodes


def test_batches_take_each_triple_once_and_one_batch_is_the_full_step(spark, bpr, monkeypatch):
    adj, triples, nodes = bpr
    vectors = lambda df: {r.node: r.v for r in df.collect()}
    full, asked, steps = vectors(training.train_bpr(adj, triples, nodes, 1, 2)), [], []
    one = vectors(training.train_bpr(adj, lambda epoch: asked.append(epoch) or triples, nodes, 1, 2, batch=1000))
    assert asked == [1, 2] and all(one[n] == pytest.approx(v) for n, v in full.items())
    real = training.bpr_gradient
    monkeypatch.setattr(training, "bpr_gradient", lambda rows, final: steps.append(sorted(map(tuple, rows.collect()))) or real(rows, final))
    training.train_bpr(adj, triples, nodes, 1, 1, batch=6)
    assert 1 < len(steps) <= 3 and sorted(sum(steps, [])) == sorted(map(tuple, triples.collect()))
