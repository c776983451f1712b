"""Operator 9: exact deduplication by skew-safe combining.

Equal texts are combined three times: within each task before the shuffle (Spark's partial
aggregation), within each salt of a digest, and over the salts of a digest. Every stage groups by the digest
and the whole normalised text, so a digest collision can't merge different texts. What goes on
to the last, text-free join is one narrow row for each distinct text and salt that it has, and the join is on the salt too.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Parts that a group of equal texts is dealt to, before its winners meet and again when its rows learn of them.
SALTS = 48


def fold_ascii(text: Column) -> Column:
    """Lower-case A-Z only."""
    slow = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(slow)


def digest(text: Column) -> Column:
    """SHA-256 of a text that is never null; said to be so, as joins would else hash once more to leave nulls out."""
    return F.coalesce(F.sha2(text, 256), F.lit(""))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row for each input row: ``id_col, keep_id, group_size, kept, text_sha256``.

    Of equal texts the row with the largest id stays; a null id is below every other. A null text
    equals the empty one. Rows that repeat both id and text share their verdict (they can't be told apart) and each count in
    ``group_size``. Other columns, whatever their names, are ignored; an empty table gives an empty result. Raises if two
    different texts share SHA-256 and a second 64-bit hash. ``salts`` is 1 to 62: a hot text's rows are dealt to so many tasks.
    """
    if not 1 <= salts <= 62:
        raise ValueError("salts must be 1 to 62")
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("__id"), fold_ascii(F.coalesce(F.col(text_col), F.lit(""))).alias("__norm"))
    rows = rows.withColumn("text_sha256", digest(F.col("__norm"))).withColumn("__salt", F.pmod(F.xxhash64("__id"), F.lit(salts)).cast("int"))
    salted = rows.groupBy("text_sha256", "__norm", "__salt").agg(F.max("__id").alias("keep_id"), F.count("*").alias("group_size"))
    # a bit for each salt that the text has
    own = F.expr("shiftleft(1L, __salt)")
    winners = salted.groupBy("text_sha256", "__norm").agg(
        F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"), F.bit_or(own).alias("__salts")
    )
    collides = F.raise_error(F.lit("two different texts share both hashes"))
    keyed = (
        winners.select("text_sha256", F.xxhash64("__norm").alias("__h"), "keep_id", "group_size", "__salts")
        .groupBy("text_sha256", "__h")
        .agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"), F.max("__salts").alias("__salts"), F.count("*").alias("__texts"))
        .withColumn("keep_id", F.when(F.col("__texts") == 1, F.col("keep_id")).otherwise(collides.cast(kind)))
    )
    there = F.filter(F.sequence(F.lit(0), F.lit(salts - 1)), lambda k: F.col("__salts").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), k)) != 0)
    verdicts = keyed.select("text_sha256", "__h", "keep_id", "group_size", F.explode(there).alias("__salt"))
    members = rows.select("__id", "text_sha256", F.xxhash64("__norm").alias("__h"), "__salt")
    return members.join(verdicts, ["text_sha256", "__h", "__salt"]).select(
        F.col("__id").alias(id_col), "keep_id", F.col("group_size").cast("long").alias("group_size"),
        F.col("__id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256",
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """``docs`` without the rows that lose to an equal text; of rows that repeat id and text, one stays.

    All columns are kept, whatever their names; nulls and ties as in :func:`exact_groups`; an empty table stays empty.
    The whole rows are dealt once, by text and id, and meet the narrow list of losing (text, id) there.
    """
    lost = exact_groups(docs, id_col, text_col, salts).where("not kept")
    key = lambda sha, i: [sha.alias("__sha"), F.coalesce(i.cast("string"), F.lit("")).alias("__i"), i.isNull().alias("__none")]
    lost = lost.select(*key(F.col("text_sha256"), F.col(id_col))).distinct()
    sha = digest(fold_ascii(F.coalesce(F.col(text_col), F.lit(""))))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), *key(sha, F.col(id_col)))
    names = ["__sha", "__i", "__none"]
    return whole.dropDuplicates(names).join(lost, names, "left_anti").select("__row.*")
