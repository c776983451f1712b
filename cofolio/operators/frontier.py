"""Level-synchronous expansion of a set of users through the items they rate."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cofolio.operators.graph import dense_index
from cofolio.operators.ratings import top_rated
from cofolio.sources.appended import KeySet
from cofolio.sources.scratch import cut, shared_dir


def expand(seeds: DataFrame, lists: DataFrame, activity: DataFrame, target: int, top: int = 5, least: int = 3, primed: DataFrame | None = None) -> DataFrame:
    """``user_id, level, ord``: users admitted in the order in which a queue would meet them.

    ``seeds(user_id, ord)``, repeats counting at their first place, and behind them ``primed(page, pos, user_id)``; ``lists(user_id, item_id, raw_score)`` as landed; ``activity(item_id, page, pos, user_id)`` of who is active on an item. A user
    with fewer than ``least`` ratings is neither admitted nor expanded. Each level is one pass: the top items
    of its users, the users active on them, first meetings by (parent, rank, page, place), without those met before.
    It ends when ``target`` users are admitted or nobody new is met, however many levels that takes.
    A level writes its new users only: they are appended to the set of met users, of which a level reads the hash folders that it may touch, and to the result. The
    last level is cut at ``target`` by positions that ranges of users get side by side. Level counts are all that reaches the driver.
    """
    spark, kind = lists.sparkSession, lists.schema["user_id"].dataType.simpleString()
    sizes = lists.groupBy("user_id").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("user_id")
    lists = cut(lists.join(sizes, "user_id", "left_semi").select("user_id", "item_id", "raw_score"), "frontier-lists")
    sizes = cut(sizes, "frontier-sizes")
    activity = cut(activity.select("item_id", "page", "pos", "user_id"), "frontier-activity")
    first = seeds.select("user_id", F.struct(F.lit(0).alias("a"), F.col("ord").cast("long").alias("b"), F.lit(0).cast("long").alias("c")).alias("at"))
    if primed is not None:
        first = first.unionByName(primed.select("user_id", F.struct(F.lit(1).alias("a"), F.col("page").cast("long").alias("b"), F.col("pos").cast("long").alias("c")).alias("at")))
    front = cut(_placed(first.groupBy("user_id").agg(F.min("at").alias("at")), "at"), "frontier")
    met, path, schema = KeySet(spark, "user_id", kind), f"{shared_dir(spark)}/admitted-{uuid.uuid4().hex}", f"user_id {kind}, ord long"
    have, level = 0, 0
    while not front.isEmpty():
        met.add(front)
        good = front.join(sizes, "user_id", "left_semi")
        n = good.count()
        if have + n > target:
            good = dense_index(good, ["ord"], "place").where(F.col("place") < target - have).drop("place")
        folder = f"{path}/level={level}"
        good.select("user_id", "ord").write.option("compression", "zstd").parquet(folder)
        have, level = have + min(n, target - have), level + 1
        if have >= target:
            break
        good = spark.read.schema(schema).parquet(folder)
        best = top_rated(lists.join(good, "user_id"), top)
        found = best.select("item_id", "ord", "rank").join(activity, "item_id")
        first = cut(found.groupBy("user_id").agg(F.min(F.struct("ord", "rank", "page", "pos", "item_id")).alias("at")), "frontier-met")
        front = cut(_placed(met.without(first), "at"), "frontier")
    if level == 0:
        return spark.createDataFrame([], f"user_id {kind}, level int, ord long")
    return spark.read.schema(f"{schema}, level int").parquet(path).select("user_id", "level", "ord")


def _placed(users: DataFrame, at: str) -> DataFrame:
    return dense_index(users, [at, "user_id"], "ord").select("user_id", F.col("ord").cast("long").alias("ord"))
