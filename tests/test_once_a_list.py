"""What follows from a watch-list is worked out once for all users who have it."""

from cofolio.operators import recommend as rec


def test_equal_lists_share_their_rows(spark):
    rows = [(1, 5, 2.0, 1), (1, 6, 1.0, 2), (2, 6, 1.0, 1), (2, 5, 2.0, 2), (3, 5, 2.0, 1), (4, 5, 2.0, 1), (4, 6, 0.5, 2)]
    watch = spark.createDataFrame(rows, "user_id long, item_id long, weight double, pos int")
    asked = []

    def work(lists):
        asked.extend(sorted(r.user_id for r in lists.select("user_id").distinct().collect()))
        return lists.selectExpr("user_id", "item_id * 10 as item_id", "weight as score")

    got = sorted(map(tuple, rec.once_a_list(watch, work).collect()))
    assert got == sorted((u, i * 10, w) for u, i, w, _ in rows)
    assert asked == [1, 3, 4]  # user 2 has the list of user 1
