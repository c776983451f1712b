"""The frontier writes what a level adds and reads what it touches."""

import glob

from cofolio.operators import frontier
from cofolio.sources.appended import KeySet
from cofolio.sources.scratch import cut


def test_key_set_reads_the_folders_it_touches(spark):
    keys = KeySet(spark, "k", "long", parts=8)
    rows = lambda values: cut(spark.createDataFrame([(v,) for v in values], "k long"), "keys-in")
    assert [r.k for r in keys.without(rows([1, None])).orderBy("k").collect()] == [None, 1]
    keys.add(rows([1, 2, 3, None]))
    keys.add(rows(range(10, 14)))
    assert sorted(r.k for r in keys.read().collect()) == [1, 2, 3, 10, 11, 12, 13]
    assert sorted(r.k for r in keys.without(rows([2, 12, 50])).collect()) == [50]
    one = keys._touched(rows([2]))
    assert len(one) == 1 and all("__part=%d/" % one.copy().pop() in f for f in keys.read(one).inputFiles())


def test_a_level_writes_its_new_users(spark, monkeypatch):
    """A chain of users, each of whom leads to the next: rows written are a user a level, with nobody met twice."""
    n, made = 12, []

    class Seen(KeySet):
        def __init__(self, *args):
            super().__init__(*args)
            made.append(self)

    monkeypatch.setattr(frontier, "KeySet", Seen)
    lists = [(u, i, float(s)) for u in range(n) for i, s in ((u, 9), (u + 1, 8), (1000, 1))]
    active = [(i, 0, 0, i) for i in range(n)] + [(i, 0, 1, i - 1) for i in range(1, n)]
    df = spark.createDataFrame
    got = frontier.expand(df([(0, 0)], "user_id long, ord long"), df(lists, "user_id long, item_id long, raw_score double"), df(active, "item_id long, page int, pos int, user_id long"), target=n, top=2)
    assert [(r.user_id, r.level, r.ord) for r in got.orderBy("level").collect()] == [(u, u, 0) for u in range(n)]
    files = glob.glob(made[0].path.removeprefix("file://").removeprefix("file:") + "/*/*.parquet")
    assert sorted(spark.read.parquet(made[0].path).select("user_id").toPandas()["user_id"]) == list(range(n)) and len(files) == n


def test_target_cuts_a_level_in_order_and_no_seeds_give_nobody(spark):
    lists = spark.createDataFrame([(u, i, 5.0) for u in range(40) for i in range(3)], "user_id long, item_id long, raw_score double")
    active = spark.createDataFrame([(0, p, q, 10 * p + q) for p in range(4) for q in range(10)], "item_id long, page int, pos int, user_id long")
    seed = spark.createDataFrame([(39, 0)], "user_id long, ord long")
    got = frontier.expand(seed, lists, active, target=25)
    assert [r.user_id for r in got.orderBy("level", "ord").collect()] == [39, *range(24)]
    assert frontier.expand(seed.limit(0), lists, active, target=25).count() == 0
