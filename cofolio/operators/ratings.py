"""Ingest and normalisation of ratings: ``user_id, item_id, raw_score``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from cofolio.functions.scalars import round4


def rated(entries: DataFrame, score: str = "score") -> DataFrame:
    """Entries that carry a score."""
    return entries.where(F.col(score) > 0)


def insert_absent(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``old`` and those rows of ``new`` whose key it lacks, one each."""
    return old.unionByName(new.dropDuplicates([key]).join(old, key, "left_anti"))


def upsert_last(old: DataFrame, new: DataFrame, keys: list[str], values: list[str], order: str = "seq") -> DataFrame:
    """The last value of each key by ``order``, new rows after all old ones."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    return both.groupBy(*keys).agg(*[F.max_by(v, F.struct("__new", order)).alias(v) for v in values])


def centred(ratings: DataFrame) -> DataFrame:
    """With ``normalized_score``: the score less the user's mean. Always computed, never stored stale."""
    return ratings.withColumn("normalized_score", F.col("raw_score") - F.avg("raw_score").over(Window.partitionBy("user_id")))


def capped(ratings: DataFrame, per_user: int) -> DataFrame:
    """Each user's first ``per_user`` ratings by item id; 0 keeps all."""
    if per_user <= 0:
        return ratings
    first = Window.partitionBy("user_id").orderBy("item_id")
    return ratings.withColumn("__k", F.row_number().over(first)).where(F.col("__k") <= per_user).drop("__k")


def active_users(ratings: DataFrame, least: int) -> DataFrame:
    """Ratings of users with at least ``least`` of them."""
    return ratings.withColumn("__n", F.count("*").over(Window.partitionBy("user_id"))).where(F.col("__n") >= least).drop("__n")


def top_rated(ratings: DataFrame, n: int) -> DataFrame:
    """Each user's ``n`` best items, with their rank."""
    best = Window.partitionBy("user_id").orderBy(F.desc("raw_score"), "item_id")
    return ratings.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n)


def with_titles(ratings: DataFrame, items: DataFrame) -> DataFrame:
    """Ratings of catalogued items with their titles."""
    return ratings.join(items.select("item_id", "title"), "item_id")


def user_item_edges(normalised: DataFrame) -> DataFrame:
    """``id, user_id, item_id, weight``."""
    return normalised.select(F.format_string("ua:%s:%s", F.col("user_id").cast("string"), F.col("item_id").cast("string")).alias("id"), "user_id", "item_id", round4(F.col("normalized_score")).alias("weight"))


def import_actions(old: DataFrame, new: DataFrame, keep_last: bool = True) -> DataFrame:
    """``user_id, item_id, action`` of importing ``new(user_id, item_id, weight, pos)`` into ``old(user_id, item_id, weight)``.

    List imports (``keep_last``) take the last of repeated entries and skip weights that hardly differ; text
    imports look at each line in turn: unknown items are added, a line with a weight updates, one without is skipped.
    """
    key = ["user_id", "item_id"]
    known = old.select(*key, F.col("weight").alias("__old"))
    if keep_last:
        last = new.groupBy(*key).agg(F.max_by("weight", "pos").alias("weight"))
        action = F.when(F.col("__old").isNull(), "added").when(F.abs(F.col("__old") - F.col("weight")) < 1e-4, "skipped").otherwise("updated")
        return last.join(known, key, "left").select(*key, action.alias("action"))
    turn = F.row_number().over(Window.partitionBy(*key).orderBy("pos"))
    action = F.when(F.col("__old").isNull() & (F.col("__turn") == 1), "added").when(F.col("weight").isNull(), "skipped").otherwise("updated")
    return new.withColumn("__turn", turn).join(known, key, "left").select(*key, "pos", action.alias("action"))


def scale_target(ratings: DataFrame, factor: float, least: int) -> DataFrame:
    """``users, target``: how many users to grow to."""
    users = F.count_distinct("user_id")
    return ratings.agg(users.alias("users"), F.greatest(F.lit(least), F.ceil(users * factor)).cast("long").alias("target"))


def positives(ratings: DataFrame, threshold: float, score: str = "raw_score") -> DataFrame:
    """Rows above the threshold, or all rows when there is none."""
    found = ratings.agg(F.max(F.when(F.col(score) > threshold, True)).alias("__any"))
    return ratings.join(F.broadcast(found)).where((F.col(score) > threshold) | F.col("__any").isNull()).drop("__any")


def holdout(ratings: DataFrame, ratio: float = 0.15, least: int = 5, seed: str = "7") -> DataFrame:
    """With ``is_test``: of users with at least ``least`` ratings a share of rows, at least one and never all, by seeded hash."""
    user = Window.partitionBy("user_id")
    n = F.count("*").over(user)
    mixed = F.md5(F.concat_ws("|", F.lit(seed), F.col("user_id").cast("string"), F.col("item_id").cast("string")))
    size = F.when(n >= least, F.least(F.greatest(F.lit(1), F.bround(n * F.lit(ratio)).cast("int")), (n - 1).cast("int"))).otherwise(0)
    ranked = ratings.withColumn("__k", F.row_number().over(user.orderBy(mixed, "item_id"))).withColumn("__size", size)
    return ranked.withColumn("is_test", F.col("__k") <= F.col("__size")).drop("__k", "__size")


def counted(df: DataFrame, **metrics: Column) -> tuple[DataFrame, Observation]:
    """``df`` with observed metrics (and ``rows``), and where they can be read once it has been computed: counted on the way, not by another job."""
    seen = Observation()
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(k) for k, c in metrics.items()]), seen
