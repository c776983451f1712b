"""Hand-computed cases and sequential restatements."""

import math
import random
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pytest
from cofolio.functions import scalars as fn
from cofolio.operators import frontier, graph, training
from cofolio.operators import ratings as R
from cofolio.operators import recommend as rec
from cofolio.operators.vectors import sum_vectors
from cofolio.sources import readers, writers
from cofolio.sources.scratch import cut
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F


def test_embedded_sample(spark):
    rows = [("1", 1, 9.0), ("1", 1535, 8.0), ("1", 16498, 7.0), ("2", 16498, 9.0), ("2", 30276, 8.0), ("2", 11757, 6.0)]
    norm = R.centred(spark.createDataFrame(rows, "user_id string, item_id long, raw_score double"))
    got = {(r.lo, r.hi): r.weight for r in graph.pair_weights(graph.item_pairs(norm)).collect()}
    assert got == {(1, 1535): 0.5, (1, 16498): 0.0, (1535, 16498): -0.5, (16498, 30276): 0.8333, (11757, 16498): -0.1667, (11757, 30276): -0.6667}


def test_pair_weights_are_the_sequential_fold(spark):
    rng = random.Random(5)
    rows = [(u, i, float(rng.randint(1, 10))) for u in range(30) for i in rng.sample(range(8), 5)]
    got = {(r.lo, r.hi): r.weight for r in graph.pair_weights(graph.item_pairs(R.centred(spark.createDataFrame(rows, "user_id long, item_id long, raw_score double")))).collect()}
    by_user, fold = {}, {}
    for u, i, s in rows:
        by_user.setdefault(u, {})[i] = s
    for u in sorted(by_user):
        mean = sum(by_user[u].values()) / len(by_user[u])
        items = sorted(by_user[u])
        for x, a in enumerate(items):
            for b in items[x + 1 :]:
                s = (by_user[u][a] + by_user[u][b]) / 2 - mean
                fold[a, b] = s if (a, b) not in fold else (fold[a, b] + s) / 2
    assert set(got) == set(fold)
    assert all(abs(got[k] - fold[k]) < 1e-4 for k in fold)


def test_negative_edges_count_only_after_a_positive_one(spark):
    watch = spark.createDataFrame([(1, 10, 1.0, 1), (1, 11, 1.0, 2), (1, 12, 1.0, 3)], "user_id long, item_id long, weight double, pos int")
    adj = spark.createDataFrame([(10, 20, -0.5), (11, 20, 0.7), (12, 20, -0.2)], "src long, dst long, weight double")
    got = rec.graph_contributions(rec.graph_candidates(watch, adj)).first().contributions
    assert [(c.watched_id, c.weighted) for c in got] == [(11, 0.7), (12, -0.2)]


@pytest.mark.parametrize("raw,weight", [(0.1, 0.2), (2.5, 2.5), (5.0, 1.0), (10.0, 2.0), (float("nan"), 1.0)])
def test_score_to_weight(spark, raw, weight):
    assert spark.range(1).select(fn.score_to_weight(F.lit(raw))).first()[0] == pytest.approx(weight)


def test_pseudonym_trims_any_blank(spark):
    a, b = spark.range(1).select(fn.pseudonym(F.lit(" Ann\t"), "s"), fn.pseudonym(F.lit("\n ANN"), "s")).first()
    assert a == b and len(a) == 24


def test_text_import_takes_lines_in_turn(spark):
    old = spark.createDataFrame([(1, 5, 1.0)], "user_id long, item_id long, weight double")
    new = spark.createDataFrame([(1, 5, None, 0), (1, 6, None, 1), (1, 6, 2.0, 2)], "user_id long, item_id long, weight double, pos int")
    got = [r.action for r in R.import_actions(old, new, keep_last=False).orderBy("pos").collect()]
    assert got == ["skipped", "added", "updated"]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 4), st.integers(1, 9)), min_size=1, max_size=30, unique=True))
def test_split_sizes(spark, pairs):
    df = R.holdout(spark.createDataFrame([(u, i, 5.0) for u, i in pairs], "user_id long, item_id long, raw_score double"))
    for r in training.split_sizes(df).collect():
        want = min(max(1, round(r.ratings * 0.15)), r.ratings - 1) if r.ratings >= 5 else 0
        assert r.held_out == want


def test_one_block_sgd_is_the_plain_loop(spark):
    rng = random.Random(4)
    rows = [(u, i, float(rng.randint(1, 10))) for u in range(12) for i in rng.sample(range(9), rng.randint(1, 7))]
    r = spark.createDataFrame(rows, "user_id long, item_id long, raw_score double")
    users, items, mean = training.factorise(r, factors=2, epochs=1, blocks=1)
    start = lambda n, seed: dict(spark.range(n).select("id", training.seeded_vector(F.col("id"), 2, seed)).collect())
    p, q = start(12, 7), start(9, 8)
    bu, bi = dict.fromkeys(p, 0.0), dict.fromkeys(q, 0.0)
    for u, i, s in sorted(rows):
        err = s - (mean + bu[u] + bi[i] + sum(a * b for a, b in zip(p[u], q[i], strict=True)))
        bu[u] += 0.02 * (err - 0.02 * bu[u])
        bi[i] += 0.02 * (err - 0.02 * bi[i])
        pu = [a + 0.02 * (err * b - 0.02 * a) for a, b in zip(p[u], q[i], strict=True)]
        q[i] = [b + 0.02 * (err * a - 0.02 * b) for a, b in zip(p[u], q[i], strict=True)]
        p[u] = pu
    for row in users.collect():
        assert row.bu == pytest.approx(bu[row.user_id]) and row.p == pytest.approx(p[row.user_id])
    for row in items.collect():
        assert row.bi == pytest.approx(bi[row.item_id]) and row.q == pytest.approx(q[row.item_id])


def test_bpr_gradient_matches_differences(spark):
    rng = random.Random(2)
    nodes = ["u0", "u1", "i0", "i1", "i2"]
    emb = {n: [rng.uniform(-1, 1) for _ in range(2)] for n in nodes}
    triples = [("u0", "i0", "i1"), ("u1", "i2", "i0")]

    def loss(e):
        out = 0.0
        for u, i, j in triples:
            x = sum(a * (b - c) for a, b, c in zip(e[u], e[i], e[j], strict=True))
            out += math.log(1 + math.exp(-x))
        return out

    df = spark.createDataFrame(list(emb.items()), "node string, v array<double>")
    got = {r.node: r.v for r in training.bpr_gradient(spark.createDataFrame(triples, "u string, i string, j string"), df).collect()}
    for n in nodes:
        for k in range(2):
            up = {m: list(v) for m, v in emb.items()}
            up[n][k] += 1e-6
            assert got.get(n, [0, 0])[k] == pytest.approx((loss(up) - loss(emb)) / 1e-6, abs=1e-4)


def test_whole_documents_and_lines_are_read(spark, tmp_path):
    import json

    users = [{"userId": f"u{k}", "ratings": [{"animeId": k, "title": "t", "rawScore": 5, "normalizedScore": 0.5}, {"animeId": "x", "rawScore": 1, "normalizedScore": 1}]} for k in range(6)]
    users.append({"userId": " ", "ratings": [{"animeId": 3, "rawScore": 5, "normalizedScore": 1}, {"animeId": 4, "rawScore": 5, "normalizedScore": None}]})
    (tmp_path / "a.json").write_text(json.dumps({"users": users}, indent=2))
    (tmp_path / "b.json").write_text(json.dumps({"users": users}))
    (tmp_path / "c.json").write_text("".join(json.dumps({"users": [u]}) + "\n" for u in users))
    got = readers.open_ratings(spark, str(tmp_path)).collect()
    assert len(got) == 3 * 14 and sum(not r.rejected for r in got) == 3 * 6
    assert {r.title for r in got if r.item_id == 3 and r.user_id == ""} == {"Anime 3"}


def test_written_files_are_read_back(spark, tmp_path):
    norm = R.centred(spark.createDataFrame([(u, i, float(u + i)) for u in range(6) for i in range(3)], "user_id long, item_id long, raw_score double"))
    items = spark.createDataFrame([(i, f"t{i}") for i in range(3)], "item_id long, title string")
    writers.write_legacy_ratings(norm, items, f"{tmp_path}/ratings")
    assert readers.legacy_ratings(spark, f"{tmp_path}/ratings").where("not rejected").count() == 18
    edges = spark.createDataFrame([(f"anime:{k}", f"anime:{k + 1}", "anime-anime", 0.5) for k in range(10)], "source string, target string, edge_type string, weight double")
    writers.write_graph(edges, f"{tmp_path}/graph")
    assert sorted(map(tuple, readers.legacy_graph(spark, f"{tmp_path}/graph").collect())) == sorted(map(tuple, edges.collect()))
    model = spark.createDataFrame([(k, f"v{k}", k / 8, [k / 4, 1.0]) for k in range(10)], "item_id long, title string, bias double, q array<double>")
    for compact in (True, False):
        writers.write_web_model(model, f"{tmp_path}/model{compact}", compact=compact)
        assert sorted(map(tuple, readers.model(spark, f"{tmp_path}/model{compact}").collect())) == sorted(map(tuple, model.collect()))


def test_frontier_is_the_queue(spark):
    """Against a queue: a long chain needs many levels, short lists admit nobody, repeated seeds count once."""
    rng = random.Random(4)
    n = 30
    lists = {u: [(u, 9.0), (u + 1, 8.0), *[(100 + rng.randrange(5), float(rng.randint(1, 7))) for _ in range(3)]] for u in range(n)}
    lists = {u: dict(v) for u, v in lists.items()}
    lists[7] = {7: 9.0, 8: 8.0}  # too short: the chain goes on through item 107 only
    active = [(i, 0, 0, i) for i in range(n)] + [(100 + i, p, q, rng.randrange(n)) for i in range(5) for p in range(2) for q in range(2)] + [(6, 1, 0, 8)]
    seeds, primed, want, done = [(0, 5), (0, 9), (3, 7)], [(1, 0, 2), (2, 0, 0)], [], set()
    queue = [0, 3, 2]
    met = set(queue)
    while queue and len(want) < n:
        u = queue.pop(0)
        done.add(u)
        if len(lists[u]) < 3:
            continue
        want.append(u)
        for i, _ in sorted(lists[u].items(), key=lambda x: (-x[1], x[0]))[:5]:
            for _, _, v in sorted((p, q, v) for j, p, q, v in active if j == i):
                if v not in met:
                    met.add(v)
                    queue.append(v)
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    got = frontier.expand(
        df(seeds, "user_id long, ord long"), df([(u, i, s) for u, v in lists.items() for i, s in v.items()], "user_id long, item_id long, raw_score double"),
        df(active, "item_id long, page int, pos int, user_id long"), target=n, primed=df(primed, "page int, pos int, user_id long"),
    )
    assert [r.user_id for r in got.orderBy("level", "ord").collect()] == want and len(want) > 20


def test_manifest_holds_the_files_digests(spark, tmp_path):
    """Empty, nested and very large files (3 GB, without blocks on disk) are in it, hidden ones aren't."""
    import hashlib

    def of(*chunks):
        digest = hashlib.sha256()
        for c in chunks:
            digest.update(c)
        return digest.hexdigest()

    (tmp_path / "deep er").mkdir()
    (tmp_path / "a.bin").write_bytes(b"abc")
    (tmp_path / "deep er" / "b%20é.bin").write_bytes(b"x" * 3_000_000)
    (tmp_path / "empty").write_bytes(b"")
    (tmp_path / "_SUCCESS").write_bytes(b"")
    (tmp_path / ".a.bin.crc").write_bytes(b"1")
    with open(tmp_path / "large", "wb") as f:
        f.truncate(3 << 30)
    got = sorted(tuple(r) for r in writers.manifest(spark, str(tmp_path)).collect())
    zeros = bytes(1 << 24)
    assert got == sorted([
        ("a.bin", 3, of(b"abc")), ("deep er/b%20é.bin", 3_000_000, of(b"x" * 3_000_000)), ("empty", 0, of()),
        ("large", 3 << 30, of(*[zeros] * (3 << 6))),
    ])


def test_manifest_of_an_empty_folder_and_of_a_file(spark, tmp_path):
    assert writers.manifest(spark, str(tmp_path)).count() == 0
    (tmp_path / "one").write_bytes(b"1")
    assert [(r.name, r.bytes) for r in writers.manifest(spark, str(tmp_path / "one")).collect()] == [("one", 1)]


def test_rmse_and_ranks_of_given_factors(spark):
    rows = [(1, 1, 4.0), (1, 2, 8.0), (2, 1, 6.0)]
    r = spark.createDataFrame(rows, "user_id long, item_id long, raw_score double")
    users = spark.createDataFrame([(1, [1.0, 0.0], 0.5), (2, [0.0, 2.0], 0.0)], "user_id long, p array<double>, bu double")
    items = spark.createDataFrame([(1, [0.5, 1.0], 0.0), (2, [2.0, 0.0], 1.0), (3, [0.0, 0.1], 0.2)], "item_id long, q array<double>, bi double")
    wrong = [4 - (5 + 0.5 + 0.5), 8 - (5 + 0.5 + 1 + 2), 6 - (5 + 2)]
    assert training.rmse(r, users, items, 5.0).first().rmse == pytest.approx(math.sqrt(sum(e * e for e in wrong) / 3))
    split = r.withColumn("is_test", F.col("item_id") == 2).unionByName(spark.createDataFrame([(2, 3, 9.0, True)], "user_id long, item_id long, raw_score double, is_test boolean"))
    got = training.rank_quality(split, users, items, 5.0, 5.0, k=1)  # user 1: items 2, 3 unseen, 2 first (a hit); user 2: 2 (score 6) before 3 (5.4), a miss
    assert tuple(got.first()) == (2, 0.5, 0.5, 0.5, 0.5)


def test_model_scores_are_of_all_unwatched_items(spark, monkeypatch):
    """Against loops, over several blocks; an unknown watched item and a user who watched only such play no part."""
    monkeypatch.setattr(rec, "FULL_BLOCK_ROWS", 4)
    rng = random.Random(6)
    items = {i: ([rng.uniform(-1, 1) for _ in range(3)], rng.uniform(0, 1)) for i in range(11)}
    watched = {u: {i: rng.uniform(0.2, 3) for i in rng.sample(range(11), 1 + u % 4)} for u in range(9)}
    rows = [(u, i, w, i) for u, v in watched.items() for i, w in v.items()] + [(0, 99, 1.0, 0), (50, 99, 1.0, 0)]
    watch = spark.createDataFrame(rows, "user_id long, item_id long, weight double, pos int")
    model = spark.createDataFrame([(i, q, b) for i, (q, b) in items.items()], "item_id long, q array<double>, bias double")
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    want = {}
    for u, v in watched.items():
        p = [sum(w * items[i][0][k] for i, w in v.items()) / sum(v.values()) for k in range(3)]
        for i, (q, b) in items.items():
            if i not in v:
                parts = [dot(q, items[j][0]) * w for j, w in v.items()]
                want[u, i] = (b + 2 + dot(p, q), max(parts), sum(x > 0 for x in parts))
    got = {(r.user_id, r.item_id): (r.score, r.strongest, r.support) for r in rec.model_scores(watch, model, 2.0).collect()}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in want)
    assert rec.model_scores(watch.limit(0), model).count() == 0 and rec.model_scores(watch, model.limit(0)).count() == 0


def test_popular_lists_are_the_first_unseen(spark):
    rng = random.Random(8)
    rows = [(u, i, 5.0) for u in range(12) for i in rng.sample(range(15), rng.randint(1, 12))]
    seen = spark.createDataFrame(rows, "user_id long, item_id long, raw_score double")
    users = seen.select("user_id").union(spark.createDataFrame([(77,)], "user_id long"))
    count = {i: sum(r[1] == i for r in rows) for i in {r[1] for r in rows}}
    order = sorted(count, key=lambda i: (-count[i], i))
    want = {(u, i, k) for u in [*range(12), 77] for k, i in enumerate([i for i in order if (u, i, 5.0) not in rows][:4], 1)}
    assert set(map(tuple, rec.popular_unseen(users, seen, 4).collect())) == want


@pytest.mark.parametrize("copies", [1, 40])
def test_edge_sample_is_the_first_by_hash(spark, copies):
    import hashlib

    rows = [(a, a + b, float(b)) for a in range(30) for b in range(1, 4)] + [(1, 2, 1.0)] * (copies - 1)
    edges = spark.createDataFrame(rows, "src long, dst long, weight double")
    order = sorted(rows, key=lambda r: (hashlib.md5(f"1|{r[0]}|{r[1]}".encode()).hexdigest(), r[0], r[1]))
    for rate in (0.001, 0.3, 0.9):
        assert sorted(map(tuple, graph.edge_sample(edges, rate).collect())) == sorted(order[: max(1, round(len(rows) * rate))])
    assert graph.edge_sample(edges.limit(0), 0.5).count() == 0


def test_capped_pairs_are_the_first_met(spark):
    rows = [(k % 7, k, k + 1) for k in range(50)]
    w = spark.createDataFrame(rows, "first_user long, lo long, hi long")
    assert sorted(map(tuple, graph.capped_pairs(w, 20).collect())) == sorted(rows)[:20]
    assert graph.capped_pairs(w, 0).count() == 50 and graph.capped_pairs(w, 99).count() == 50


@pytest.mark.parametrize("ratings,users,items,blocks", [(10, 5, 5, 2), (10**9, 10**6, 10**5, 50), (10**11, 10**6, 10**4, 448)])
def test_factor_blocks_grow_with_the_input(ratings, users, items, blocks):
    assert training.block_count(ratings, users, items) == blocks


def test_documents_in_parts_are_read_back(spark, tmp_path, monkeypatch):
    """Datasets, graphs and models beyond a document's size: several documents, some in one file, with the same rows; one user fills several."""
    monkeypatch.setattr(writers, "DOCUMENT_CELLS", 9)
    rows = [(u, i, float((u * i) % 9 + 1)) for u in range(8) for i in range(4)] + [(90, i, float(i % 9 + 1)) for i in range(30)]
    ratings = spark.createDataFrame(rows, "user_id long, item_id long, raw_score double")
    norm = R.centred(ratings)
    items = spark.createDataFrame([(i, f"t{i}") for i in range(30)] + [(3, "u3")], "item_id long, title string")
    writers.write_compact_ratings(norm, items, f"{tmp_path}/ratings")
    got = readers.open_ratings(spark, f"{tmp_path}/ratings").collect()
    assert sorted((int(r.user_id), r.item_id, r.raw_score) for r in got) == sorted(rows) and all(r.title == f"t{r.item_id}" for r in got)
    assert spark.read.json(f"{tmp_path}/ratings").count() > 3
    pairs = spark.createDataFrame([(a, a + 1, 0.5) for a in range(20)], "lo long, hi long, weight double")
    mine = ratings.select("user_id", "item_id", F.col("raw_score").alias("weight"))
    writers.write_compact_graph(mine, pairs, ratings, items, f"{tmp_path}/graph")
    edges = {(r.source, r.target, r.weight) for r in readers.compact_graph(spark, f"{tmp_path}/graph").collect()}
    assert edges == {(f"user:{u}", f"anime:{i}", w) for u, i, w in rows} | {(f"anime:{a}", f"anime:{a + 1}", 0.5) for a in range(20)}
    model = spark.createDataFrame([(k, f"v{k}", k / 8, [k / 4, 1.0]) for k in range(30)], "item_id long, title string, bias double, q array<double>")
    writers.write_web_model(model, f"{tmp_path}/model")
    assert sorted(map(tuple, readers.model(spark, f"{tmp_path}/model").collect())) == sorted(map(tuple, model.collect()))
    assert spark.read.json(f"{tmp_path}/model").count() > 3
    writers.write_compact_ratings(norm.limit(0), items, f"{tmp_path}/none")
    assert readers.open_ratings(spark, f"{tmp_path}/none").count() == 0


def test_three_decimals_of_the_exact_value(spark):
    rng = random.Random(11)
    near = [s * (k + 0.5) / 1000 for k in range(0, 4000, 7) for s in (1, -1)]
    values = [1.1025, -1.0005, 2.0005, 0.0625, -0.3125, 0.0005, 0.00049999, 0.9995, 999.9995, 1e15 + 0.3, 123456789.0005, 0.0, -0.0, *near, *(rng.uniform(-5, 5) for _ in range(500)), *(math.nextafter(v, 9) for v in near)]
    df = spark.createDataFrame(list(enumerate(values)), "k long, v double").select("k", fn.format_weight(F.col("v")).alias("text"))
    for r in df.collect():
        v = values[r.k]
        exact = Decimal(v).quantize(Decimal("0.001"), ROUND_HALF_UP)
        want = "0.000" if abs(v) < 0.0005 else f"{'+' if v > 0 else ''}{exact}"
        assert r.text == want, v


def test_batches_without_conflicts_keep_the_order():
    rng = np.random.default_rng(2)
    u, i = rng.integers(0, 9, 400), rng.integers(0, 7, 400)
    batches = training.conflict_free(u, i)
    assert sorted(np.concatenate(batches).tolist()) == list(range(400)) and len(batches) < 200
    done = {}
    for n, batch in enumerate(batches):
        assert len(set(u[batch])) == len(batch) == len(set(i[batch]))
        done |= dict.fromkeys(batch.tolist(), n)
    for k in range(400):
        assert all(done[j] < done[k] for j in range(k) if u[j] == u[k] or i[j] == i[k])
    assert training.conflict_free(u[:0], i[:0]) == []


def test_a_sub_epoch_reads_its_stratum_only(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(training, "cut", lambda df, name, by=None: seen.append((name, by, cut(df, name, by))) or seen[-1][2])
    r = spark.createDataFrame([(u, i, float((u + i) % 9 + 1)) for u in range(40) for i in range(20)], "user_id long, item_id long, raw_score double")
    training.factorise(r, factors=2, epochs=1, blocks=4)
    cells = next(df for name, by, df in seen if name == "mf-cells" and by == ["stratum"])
    files = [set(cells.where(F.col("stratum") == s).select(F.input_file_name()).distinct().toPandas().iloc[:, 0]) for s in range(4)]
    assert sum(map(len, files)) == len(set().union(*files)) and cells.count() == 800
    plan = cells.where("stratum = 2")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(stratum" in plan


def test_vector_sums(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (1, [3.0]), (2, [0.5, 0.5]), (2, None), (3, []), (1, [1.0, 1.0])], "k long, v array<double>")
    assert sorted(map(tuple, sum_vectors(df, "k", "v").collect())) == [(1, [5.0, 3.0]), (2, [0.5, 0.5])]
    plan = sum_vectors(df, "k", "v", 2)._jdf.queryExecution().toString()
    assert "Generate" not in plan
    assert sum_vectors(df.limit(0), "k", "v").count() == 0
