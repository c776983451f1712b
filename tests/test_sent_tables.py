"""Tables that grow with users aren't sent to all tasks through the driver, however little room their files take."""

from cofolio.operators import recommend as rec


def test_lists_of_equal_users_are_not_broadcast(spark):
    users = spark.range(200).selectExpr("id AS user_id", "array(1.0D, 2.0D) AS p", "0.5D AS bu")
    model = spark.range(30).selectExpr("id AS item_id", "array(cast(id AS double), 1.0D) AS q", "0.0D AS bias")
    seen = users.selectExpr("user_id", "user_id % 30 AS item_id")
    best = rec.known_user_recommend(users, model, seen, 2)
    assert "BroadcastHashJoin" not in best._jdf.queryExecution().executedPlan().toString()
    want = {(u, i) for u in range(200) for i in sorted((i for i in range(30) if i != u % 30), reverse=True)[:2]}
    assert {(r.user_id, r.item_id) for r in best.collect()} == want
