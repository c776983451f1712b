"""Ratings, catalogue and model derived from the star-schema tables, and the same as SQL.

The tables hold no ratings; ``FIXTURES.md`` defines these stand-ins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cofolio.functions.scalars import score_to_weight


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw list entries ``user_id, item_id, score, ts, event_id``; score 0 means unrated."""
    item = F.regexp_extract("props", r'"k": *(\d+)', 1).try_cast("bigint")
    score = F.least(F.lit(10.0), F.floor(F.col("value") / 8).cast("double"))
    return table(spark, sf_dir, "events").select("user_id", item.alias("item_id"), score.alias("score"), "ts", "event_id")


def dense_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R2: ``user_id, item_id, raw_score``, the latest rated entry of each pair."""
    rated = event_entries(spark, sf_dir).where("score > 0 and item_id is not null")
    return rated.groupBy("user_id", "item_id").agg(F.max_by("score", F.struct("ts", "event_id")).alias("raw_score"))


def sparse_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R1: customers rate parts by ordered quantity, latest by ship date."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_shipdate", "l_extendedprice")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    score = (F.col("l_quantity") % 11).cast("double")
    rated = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).withColumn("score", score).where("score > 0")
    latest = F.max_by("score", F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice"))
    return rated.groupBy(F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("item_id")).agg(latest.alias("raw_score"))


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``item_id, title``."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("title"))


def content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``item_id, title, genres, studios, year, score``."""
    genres = F.array_distinct(F.array(F.lower("p_type"), F.split_part(F.lower("p_name"), F.lit(" "), F.lit(1))))
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("item_id"), F.col("p_name").alias("title"), genres.alias("genres"), F.array(F.lower("p_brand")).alias("studios"),
        (F.lit(1970) + F.col("p_size")).alias("year"), ((F.col("p_retailprice") % 100) / 10).alias("score"),
    )


def item_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``item_id, q, bias``: item factors."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("item_id"), F.col("embedding").cast("array<double>").alias("q"), (F.col("label") / 10).cast("double").alias("bias")
    )


def watch_lists(ratings: DataFrame, size: int = 5) -> DataFrame:
    """``user_id, item_id, weight, pos``: each user's best ratings with import weights, in order."""
    best = Window.partitionBy("user_id").orderBy(F.desc("raw_score"), "item_id")
    ranked = ratings.withColumn("pos", F.row_number().over(best)).where(F.col("pos") <= size)
    return ranked.select("user_id", "item_id", score_to_weight(F.col("raw_score")).alias("weight"), "pos")


#: The same tables for DuckDB: common table expressions by name, in order of use.
CTE = {
    "entries": r"""entries AS (SELECT user_id, CAST(regexp_extract(props, '"k": *(\d+)', 1) AS BIGINT) AS item_id,
        least(10.0, floor(value / 8)) AS score, ts, event_id FROM events)""",
    "r2": """r2 AS (SELECT user_id, item_id, score AS raw_score FROM (SELECT *, row_number() OVER (PARTITION BY user_id, item_id
        ORDER BY ts DESC, event_id DESC) AS rn FROM entries WHERE score > 0) WHERE rn = 1)""",
    "r1": """r1 AS (SELECT user_id, item_id, raw_score FROM (SELECT o_custkey AS user_id, l_partkey AS item_id, l_quantity % 11 AS raw_score,
        row_number() OVER (PARTITION BY o_custkey, l_partkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_extendedprice DESC) AS rn
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity % 11 > 0) WHERE rn = 1)""",
    "norm": "norm AS (SELECT *, raw_score - avg(raw_score) OVER (PARTITION BY user_id) AS normalized_score FROM r2)",
    "pairs": """occ AS (SELECT a.user_id, a.item_id AS lo, b.item_id AS hi, (a.normalized_score + b.normalized_score) / 2 AS s,
        row_number() OVER (PARTITION BY a.item_id, b.item_id ORDER BY a.user_id) AS k, count(*) OVER (PARTITION BY a.item_id, b.item_id) AS n
        FROM norm a JOIN norm b ON a.user_id = b.user_id AND a.item_id < b.item_id),
        pairs AS (SELECT lo, hi, CAST(round(CAST(sum(s * pow(0.5, CASE WHEN k = 1 THEN n - 1 ELSE n - k + 1 END)) AS DECIMAL(28, 12)), 4) AS DOUBLE) AS weight, max(n) AS n FROM occ GROUP BY lo, hi)""",
    "adj": "adj AS (SELECT lo AS src, hi AS dst, weight FROM pairs UNION ALL SELECT hi, lo, weight FROM pairs)",
    "watch": """watch AS (SELECT user_id, item_id, greatest(0.2, least(3.0, CASE WHEN raw_score <= 3 THEN raw_score ELSE 1 + (raw_score - 5) / 5 END)) AS weight, pos
        FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY raw_score DESC, item_id) AS pos FROM r2) WHERE pos <= 5)""",
    "model": """model AS (SELECT vec_id AS item_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS q, label / 10 AS bias FROM embeddings)""",
    "content": """content AS (SELECT p_partkey AS item_id, p_name AS title, list_distinct([lower(p_type), split_part(lower(p_name), ' ', 1)]) AS genres,
        [lower(p_brand)] AS studios, 1970 + p_size AS year, (p_retailprice % 100) / 10 AS score FROM part)""",
}


def sql(names: str, body: str) -> str:
    """``body`` after the named common table expressions."""
    return "WITH " + ",\n".join(CTE[n] for n in names.split()) + "\n" + body
