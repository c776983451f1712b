"""First matches: pairs are folded, not sorted, and positions may be shared or missing."""

from cofolio.operators import catalog


def test_pairs_are_not_sorted(spark):
    pairs = spark.createDataFrame([("a", 7, 2), ("a", 3, 4), ("a", 9, 2), ("b", 5, 5)], "query string, item_id long, step int")
    found = catalog._first(pairs)
    assert {tuple(r) for r in found.collect()} == {("a", 7, 2), ("b", 5, 5)}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_shared_and_missing_positions(spark):
    nodes = spark.createDataFrame(
        [("anime:1", "Red Ring", 1), ("anime:2", "Red Bolt", 1), ("anime:3", "Blue Nut", None), ("anime:4", "Red Ring", 0), ("anime:5", "Tin Nut", None), ("anime:6", "A Tin Pin", 9)],
        "id string, label string, pos long",
    )
    asked = spark.createDataFrame([(q,) for q in ("red bolt", "red", "Blue Nut", "nut", "tin", "ANIME:5", "2", "bolt anime", "none")], "query string")
    got = {r["query"]: (r.node, r.step) for r in catalog.resolve_nodes(asked, nodes).collect()}
    assert got == {
        "red bolt": ("anime:2", 3), "red": ("anime:4", 4), "Blue Nut": ("anime:3", 3), "nut": ("anime:3", 5), "tin": ("anime:5", 4), "ANIME:5": ("anime:5", 1), "2": ("anime:2", 2),
        "bolt anime": ("anime:2", 5),
    }
