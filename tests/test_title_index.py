"""Catalogue search by its two indexes, against a loop over all pairs."""

import random

import pytest
from cofolio.operators import catalog
from pyspark.sql import functions as F


def _score(token, label):
    if label == token:
        return 180
    if label.startswith(token):
        return 140
    if any(w.startswith(token) for w in label.split()):
        return 110
    if token in label:
        return 80
    at, spots = 0, []
    for i, c in enumerate(label):
        if at < len(token) and c == token[at]:
            at += 1
            spots.append(i)
    if at < len(token):
        return 0
    gap = max(0, spots[-1] - spots[0] + 1 - len(token))
    return max(12, 54 - min(gap, 34) + (6 if spots[0] == 0 else 3 if spots[0] <= 2 else 0))


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdéfz") for _ in range(rng.randint(1, 6))) for _ in range(40)]
    titles = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 4)))) for i in range(150)]
    titles += [(150, None), (151, ""), (152, "A" * 3000 + "q"), (153, titles[0][1]), (154, titles[0][1].upper())]
    queries = [t for _, t in titles[:20]] + [w[:n] for w in words[:15] for n in (1, 2, 4)] + [w[::2] for w in words] + ["aq", "xyz", "", " ", None, "b  f", "qa"]
    return queries + [f"{a} {b[:2]}" for a, b in zip(words, words[1:], strict=False)], titles


@pytest.mark.parametrize("k", [None, 1, 3])
def test_search_is_the_loop(spark, tables, k):
    queries, titles = tables
    want = set()
    for q in set(queries) - {None}:
        tokens = " ".join(q.lower().split()).split(" ")
        if tokens == [""]:
            continue
        found = []
        for i, t in titles:
            if t is not None:
                label = " ".join(t.lower().split())
                scores = [_score(w, label) for w in tokens]
                if all(scores):
                    found.append((-sum(scores), label, i))
        want |= {(q, i, -s, r + 1) for r, (s, _, i) in enumerate(sorted(found)[:k])}
    got = catalog.search(spark.createDataFrame([(q,) for q in queries], "query string"), spark.createDataFrame(titles, "item_id long, title string"), k)
    assert {tuple(r) for r in got.collect()} == want and len(want) > 50
    assert got.count() == len(want)


def test_the_rarest_piece_is_looked_up(spark):
    """A thousand titles share their first letters with the query; the one piece that decides meets one title."""
    titles = spark.createDataFrame([(i, f"the ab{i % 10}") for i in range(1000)] + [(1000, "the zebra")], "item_id long, title string")
    asked = spark.createDataFrame([("the ze", "the ze"), ("nowhere", "nowhere")], "query string, norm string")
    parts = asked.select("query", catalog._longest_parts(F.col("norm")).alias("pieces"))
    assert catalog.met(parts, titles.select("item_id", catalog._parts(F.col("title")).alias("pieces"))).count() == 1
    tokens = asked.select("query", F.split("norm", " ").alias("tokens"))
    pairs = catalog.search_candidates(tokens, titles.select(F.col("title").alias("label")).distinct())
    assert [(r.query, r.label) for r in pairs.collect()] == [("the ze", "the zebra")]


def test_empty_tables(spark):
    none, one = spark.createDataFrame([], "query string"), spark.createDataFrame([("a",)], "query string")
    titles = spark.createDataFrame([], "item_id long, title string")
    assert catalog.search(one, titles).count() == catalog.search(none, titles).count() == catalog.search(one, titles, None).count() == 0
