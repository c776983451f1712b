"""The versioned store: all tables or none, whatever fails, and only what a batch touches is written."""

import datetime

import pytest
from cofolio.streaming.store import TABLES, Store

SCHEMA = "user_id long, item_id long, title string, score double, ts timestamp, event_id long"


def entries(spark, rows):
    at = lambda k: datetime.datetime(2026, 1, 1) + datetime.timedelta(minutes=k)
    return spark.createDataFrame([(u, i, t, s, at(k), k) for u, i, t, s, k in rows], SCHEMA)


def state(store):
    head = store.head()
    return {t: sorted(map(str, store.table(t, head).collect())) for t in TABLES}, sorted(map(tuple, store.ratings(head).collect()))


def test_a_failed_commit_leaves_no_trace(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store", 4)
    assert store.commit(entries(spark, [(1, 1, "a", 8.0, 1), (1, 2, "b", 6.0, 2), (2, 1, "a", 3.0, 3), (3, 5, "e", 0.0, 4)]), "one") == 1
    before = state(store)
    assert before[1] == [(1, 1, "a", 8.0, 1.0), (1, 2, "b", 6.0, -1.0), (2, 1, "a", 3.0, 0.0)]
    assert len(before[0]["users"]) == 3 and len(before[0]["items"]) == 2
    # late and early entries, a new title, null ids, scores and titles
    more = entries(spark, [(1, 1, "A", 2.0, 9), (1, 2, "old", 1.0, 0), (None, 1, "n", 5.0, 8), (4, None, "n", 5.0, 8), (5, 2, None, 7.0, 7), (6, 1, "x", None, 20)])
    for table in TABLES:
        def fail(name, table=table):
            if name == table:
                raise InterruptedError(name)

        with pytest.raises(InterruptedError):
            store.commit(more, "two", after=fail)
        assert state(store) == before
    assert store.commit(more, "two") == 2
    after = state(store)
    assert after[1] == [(1, 1, "A", 2.0, -2.0), (1, 2, "b", 6.0, 2.0), (2, 1, "A", 3.0, 0.0), (5, 2, "b", 7.0, 0.0)]
    assert len(after[0]["users"]) == 6  # 1 to 6
    assert store.commit(more, "two") == 2 and store.commit(entries(spark, [(9, 9, "z", 9.0, 99)]), "one") == 1 and state(store) == after
    again = Store(spark, f"file://{tmp_path}/store", 4)
    assert state(again) == after
    assert store.commit(entries(spark, []), "none") == 3 and state(store) == after


def test_only_touched_buckets_are_written(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store", 16)
    store.commit(entries(spark, [(u, u % 5, "t", 1.0 + u % 9, u) for u in range(100)]), "all")
    old = store.head().folders
    store.commit(entries(spark, [(7, 50, "new", 10.0, 500)]), "one")
    new = store.head().folders
    assert all(sum(new[t][b] != old[t].get(b) for b in new[t]) == 1 for t in TABLES)
    assert {r.user_id: (r.n, r.total) for r in store.table("sums").collect()}[7] == (2, 8.0 + 10.0) and store.table("sums").count() == 100


def test_two_writers_are_noticed(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store", 2)
    store._publish(1, "a", {t: {} for t in TABLES})
    store._publish(1, "b", {t: {} for t in TABLES})
    with pytest.raises(ValueError, match="two writers"):
        store.head()
