"""Users, items, ratings and per-user sums as one versioned store: a batch is seen in all tables or in none.

A table is kept in buckets by the hash of its key. A commit rewrites only the buckets that its rows fall in, into folders of
its own; one row in ``commits``, written last and as one file, names the folder of every bucket and is what readers go by. A commit that fails
before that leaves files which nobody reads, one that is run again after that changes nothing. One writer at a time.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cofolio.operators.ratings import insert_absent, rated

TABLES = {
    "users": ("user_id", "user_id long"),
    "items": ("item_id", "item_id long, title string, seq struct<ts: timestamp, event_id: long>"),
    "ratings": ("user_id", "user_id long, item_id long, raw_score double, seq struct<ts: timestamp, event_id: long>"),
    "sums": ("user_id", "user_id long, n long, total double"),
}
COMMITS = "version long, batch string, folders map<string, map<int, string>>"


class Store:
    """``root`` is a folder that all executors share. The number of ``buckets`` is fixed when the store is made."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 256):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self._publish(0, "", {t: {} for t in TABLES}, mode="ignore")

    def _publish(self, version: int, batch: str, folders: dict[str, dict[int, str]], mode: str = "append") -> None:
        row = self.spark.createDataFrame([(version, batch, folders)], COMMITS).coalesce(1)  # one row, so one file: there or not there
        row.write.mode(mode).parquet(f"{self.root}/commits")

    def commits(self) -> DataFrame:
        return self.spark.read.schema(COMMITS).parquet(f"{self.root}/commits")

    def head(self):
        """The last commit's row."""
        last = self.commits().orderBy(F.desc("version")).limit(2).collect()
        if len(last) == 2 and last[0].version == last[1].version:
            raise ValueError(f"two writers made version {last[0].version}")
        return last[0]

    def _bucket(self, key: str) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def table(self, name: str, commit=None, buckets: list[int] | None = None) -> DataFrame:
        """The rows of a table as of ``commit`` (the last one if not given), of some buckets only if so asked."""
        folders = (commit or self.head()).folders[name]
        paths = [f"{self.root}/{name}/{f}/bucket={b}" for b, f in sorted(folders.items()) if buckets is None or b in buckets]
        schema = TABLES[name][1]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def ratings(self, commit=None) -> DataFrame:
        """``user_id, item_id, title, raw_score, normalized_score`` of one version; the means are the stored sums', so nothing is aggregated."""
        commit = commit or self.head()
        means = self.table("sums", commit).select("user_id", (F.col("total") / F.col("n")).alias("__mean"))
        both = self.table("ratings", commit).join(means, "user_id").join(self.table("items", commit).select("item_id", "title"), "item_id")
        return both.select("user_id", "item_id", "title", "raw_score", (F.col("raw_score") - F.col("__mean")).alias("normalized_score"))

    def _stage(self, name: str, rows: DataFrame, folder: str) -> None:
        kept = rows.withColumn("bucket", self._bucket(TABLES[name][0])).hint("rebalance", "bucket")
        kept.write.partitionBy("bucket").option("compression", "zstd").parquet(f"{self.root}/{name}/{folder}")

    def commit(self, entries: DataFrame, batch: str, after=None) -> int:
        """Take in ``entries(user_id, item_id, title, score, ts, event_id)`` as ``batch``; gives the version that holds them.

        Every user is taken in; items and ratings only of entries with a positive score. Of entries of one user and item the latest by (ts, event_id) stays, whichever
        batch it came with, and so for an item's title (null titles aside); rows of null user are left out. Sums are made anew for the users of the batch, other users' are carried over. A
        batch that was committed before is left alone. ``after(table)`` is called when a table is staged (tests fail there).
        """
        done = self.commits().where(F.col("batch") == batch).select("version").collect()
        if done:
            return done[0].version
        head, folder, folders = self.head(), f"v={uuid.uuid4().hex}", {}
        seq = F.struct("ts", "event_id").alias("seq")
        entries = entries.where("user_id is not null")
        scored = rated(entries).where("item_id is not null")
        new = {
            "users": entries.select("user_id").distinct(),
            "items": scored.where("title is not null").select("item_id", "title", seq),
            "ratings": scored.select("user_id", "item_id", F.col("score").alias("raw_score"), seq),
        }
        touched = {t: [r.b for r in df.select(self._bucket(TABLES[t][0]).alias("b")).distinct().collect()] for t, df in new.items()}  # numbers of buckets
        latest = lambda df, keys, value: df.groupBy(*keys).agg(F.max(F.struct("seq", value)).alias("__l")).select(*keys, f"__l.{value}", "__l.seq")

        def staged(name: str, rows: DataFrame, buckets: list[int]) -> None:
            if buckets:
                self._stage(name, rows, folder)
            folders[name] = head.folders[name] | dict.fromkeys(buckets, folder)
            if after:
                after(name)

        old = {t: self.table(t, head, b) for t, b in touched.items()}
        staged("users", insert_absent(old["users"], new["users"], "user_id"), touched["users"])
        staged("items", latest(old["items"].unionByName(new["items"]), ["item_id"], "title"), touched["items"])
        staged("ratings", latest(old["ratings"].unionByName(new["ratings"]), ["user_id", "item_id"], "raw_score"), touched["ratings"])
        # only the buckets just written are read, and of these only the batch's users
        written = self.table("ratings", type(head)(version=0, batch="", folders=folders), touched["ratings"]) if touched["ratings"] else old["ratings"]
        mine = new["ratings"].select("user_id").distinct()
        fresh = written.join(mine, "user_id", "left_semi").groupBy("user_id").agg(F.count("*").alias("n"), F.sum("raw_score").alias("total"))
        kept = self.table("sums", head, touched["ratings"]).join(mine, "user_id", "left_anti")
        staged("sums", kept.unionByName(fresh), touched["ratings"])
        self._publish(head.version + 1, batch, folders)
        return head.version + 1


def ingest(spark: SparkSession, landing: str, store: Store, checkpoint: str, schema: str, files_per_batch: int = 2, source: str = "stream") -> None:
    """Take in all files that landed since the last call; a batch that the stream repeats after a failure is known by its number."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(landing)
    take = lambda batch, n: store.commit(batch, f"{source}-{n}")
    stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
