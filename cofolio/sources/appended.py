"""A set of keys in the shared folder that grows by appended files."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cofolio.sources.scratch import shared_dir


class KeySet:
    """Keys of one column in ``parts`` hash folders. ``add`` writes the new ones only, ``without`` reads only the folders that may hold a key of its rows; the
    numbers of such folders (at most ``parts``) are all that reaches the driver. Nulls are never members. One writer at a time; the files are left to the folder's owner."""

    def __init__(self, spark: SparkSession, key: str, kind: str, parts: int = 64) -> None:
        self.spark, self.key, self.schema, self.parts = spark, key, f"{key} {kind}", parts
        self.path, self.filled = f"{shared_dir(spark)}/keys-{uuid.uuid4().hex}", set()

    def _part(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.parts)).cast("int")

    def _touched(self, rows: DataFrame) -> set[int]:
        return {r["p"] for r in rows.select(self._part().alias("p")).distinct().collect()}

    def add(self, rows: DataFrame) -> None:
        """Append the keys of ``rows``, a written table of keys that aren't members yet."""
        keys = rows.where(F.col(self.key).isNotNull()).select(self.key, self._part().alias("__part"))
        keys.hint("rebalance", "__part").write.mode("append").option("compression", "zstd").partitionBy("__part").parquet(self.path)
        self.filled |= self._touched(rows.where(F.col(self.key).isNotNull()))

    def read(self, touched: set[int] | None = None) -> DataFrame:
        """The members in the given folders, all where none are given."""
        folders = [f"{self.path}/__part={p}" for p in sorted(self.filled if touched is None else touched & self.filled)]
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def without(self, rows: DataFrame) -> DataFrame:
        """Those of ``rows``, a written table, whose key isn't a member."""
        return rows.join(self.read(self._touched(rows)), self.key, "left_anti")
