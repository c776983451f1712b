"""Sinks: datasets, graphs and models as JSON, factor tables, manifests."""

from __future__ import annotations

import hashlib
import math
import re

from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cofolio.functions.scalars import quantise, round4
from cofolio.operators.graph import dense_index
from cofolio.sources.scratch import cut

#: Cells (ratings, edges, or numbers of factors) of a document; what has more is written as several documents, each whole in itself.
DOCUMENT_CELLS = 1_000_000


def _parts(n: int) -> int:
    return max(1, math.ceil(n / DOCUMENT_CELLS))


def _part(parts: int, *columns: str | Column) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(parts)).cast("int").alias("part")


def _dictionary(used: DataFrame, names: DataFrame) -> DataFrame:
    """``part, idx, local, item_id, title`` of used positions ``part, idx``: positions of a document's own dictionary, in order."""
    local = F.row_number().over(Window.partitionBy("part").orderBy("idx")) - 1
    return used.distinct().withColumn("local", local).join(names, "idx")


def _names(ratings: DataFrame, items: DataFrame) -> DataFrame:
    """``idx, item_id, title``, a title an item."""
    return item_positions(ratings).join(items.groupBy("item_id").agg(F.min("title").alias("title")), "item_id", "left")


def _listed(dictionary: DataFrame) -> DataFrame:
    """``part, anime``: the dictionaries as arrays."""
    entry = F.struct("local", F.array(F.col("item_id").cast("string"), "title").alias("a"))
    return dictionary.groupBy("part").agg(F.sort_array(F.collect_list(entry)).alias("d")).select("part", F.col("d.a").alias("anime"))


def item_positions(ratings: DataFrame) -> DataFrame:
    """``item_id, idx``: dense positions of items in first-seen order (by the smallest user, then the id)."""
    first = ratings.groupBy("item_id").agg(F.min("user_id").alias("first_user"))
    return dense_index(first, ["first_user", "item_id"]).select("item_id", F.col("idx").cast("int").alias("idx"))


def compact_rating_rows(normalised: DataFrame) -> DataFrame:
    """``user_id, cells``: a user's ratings as [position, score, centred score] triples, one row a user."""
    cells = normalised.join(item_positions(normalised), "item_id")
    triple = F.array(F.col("idx").cast("double"), F.col("raw_score"), round4(F.col("normalized_score")))
    return cells.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("idx", triple.alias("t")))).alias("c")).select("user_id", F.col("c.t").alias("cells"))


def write_legacy_ratings(normalised: DataFrame, items: DataFrame, path: str) -> None:
    """JSON lines, a user each."""
    rows = normalised.join(items, "item_id", "left")
    entry = F.struct(F.col("item_id").alias("animeId"), "title", F.col("raw_score").alias("rawScore"), F.col("normalized_score").alias("normalizedScore"))
    users = rows.groupBy(F.col("user_id").cast("string").alias("userId")).agg(F.sort_array(F.collect_list(entry)).alias("ratings"))
    users.select(F.array(F.struct("userId", "ratings")).alias("users")).write.mode("overwrite").json(path)


def write_compact_ratings(normalised: DataFrame, items: DataFrame, path: str) -> None:
    """Dictionary-encoded JSON documents of at most about ``DOCUMENT_CELLS`` ratings with a dictionary each: one for a small dataset,
    none for an empty one. A user is in one document, but for users with more ratings than a document holds."""
    parts = _parts(normalised.count())
    sizes = normalised.groupBy("user_id").agg(F.ceil(F.count("*") / DOCUMENT_CELLS).alias("__n"))
    cells = normalised.join(sizes, "user_id").withColumn("part", _part(parts, "user_id", F.pmod(F.xxhash64("item_id"), "__n")))
    dictionary = _dictionary(cells.join(item_positions(normalised), "item_id").select("part", "idx"), _names(normalised, items))
    triple = F.array(F.col("local").cast("double"), F.col("raw_score"), round4(F.col("normalized_score")))
    rows = cells.join(dictionary.select("part", "item_id", "local"), ["part", "item_id"]).groupBy("part", "user_id").agg(F.sort_array(F.collect_list(F.struct("local", triple.alias("t")))).alias("c"))
    users = rows.groupBy("part").agg(F.sort_array(F.collect_list(F.array(F.col("user_id").cast("string"), F.to_json("c.t")))).alias("users"))
    _listed(dictionary).join(users, "part").select(F.lit("ratings-compact-v1").alias("format"), "part", "anime", "users").write.mode("overwrite").json(path)


def compact_graph_edges(user_edges: DataFrame, pairs: DataFrame, ratings: DataFrame) -> DataFrame:
    """``kind, x, y, weight``: edges by positions; edges of unknown nodes are dropped."""
    items = item_positions(ratings)
    users = dense_index(ratings.select("user_id").distinct(), ["user_id"]).select("user_id", F.col("idx").cast("int").alias("ui"))
    ua = user_edges.join(users, "user_id").join(items, "item_id").select(F.lit("ua").alias("kind"), F.col("ui").alias("x"), F.col("idx").alias("y"), "weight")
    side = lambda c, o: items.select(F.col("item_id").alias(c), F.col("idx").alias(o))
    return ua.unionByName(pairs.join(side("lo", "x"), "lo").join(side("hi", "y"), "hi").select(F.lit("aa").alias("kind"), "x", "y", "weight"))


def write_graph(edges: DataFrame, path: str, codec: str = "none") -> None:
    """Edges as JSON lines of one-edge documents (gzip where asked)."""
    rows = edges.select(F.array(F.struct("source", "target", F.col("edge_type").alias("edgeType"), "weight")).alias("edges"))
    rows.write.mode("overwrite").option("compression", codec).json(path)


def write_compact_graph(user_edges: DataFrame, pairs: DataFrame, ratings: DataFrame, items: DataFrame, path: str) -> None:
    """JSON documents of positions, of at most about ``DOCUMENT_CELLS`` edges, each with the names of its nodes: one for a small graph.
    Nodes without edges are in the document that their position falls into."""
    edges = cut(compact_graph_edges(user_edges, pairs, ratings), "graph-cells")
    parts = _parts(edges.count())
    cells = edges.withColumn("part", _part(parts, "kind", "x", "y"))
    names = _names(ratings, items)
    users = dense_index(ratings.select("user_id").distinct(), ["user_id"]).select("user_id", F.col("idx").cast("int").alias("idx"))
    aa, ua = cells.where("kind = 'aa'"), cells.where("kind = 'ua'")
    use = lambda df, c: df.select("part", F.col(c).alias("idx"))
    used = use(aa, "x").unionByName(use(aa, "y")).unionByName(use(ua, "y")).unionByName(names.select(_part(parts, "idx"), "idx"))
    dictionary = _dictionary(used, names)
    people = _dictionary(use(ua, "x").unionByName(users.select(_part(parts, "idx"), "idx")), users)
    at = lambda d, old, new: d.select("part", F.col("idx").alias(old), F.col("local").alias(new))
    local = aa.join(at(dictionary, "x", "lx"), ["part", "x"]).join(at(dictionary, "y", "ly"), ["part", "y"]).select("part", "kind", "lx", "ly", "weight")
    local = local.unionByName(ua.join(at(people, "x", "lx"), ["part", "x"]).join(at(dictionary, "y", "ly"), ["part", "y"]).select("part", "kind", "lx", "ly", "weight"))
    triple = F.array(F.col("lx").cast("double"), F.col("ly").cast("double"), "weight")
    triples = local.groupBy("part").agg(*[F.sort_array(F.collect_list(F.when(F.col("kind") == k, triple))).alias(k) for k in ("ua", "aa")])
    listed = people.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("local", F.col("user_id").cast("string").alias("u")))).alias("d")).select("part", F.col("d.u").alias("userIds"))
    empty = lambda c, kind: F.coalesce(c, F.array().cast(kind)).alias(c)
    doc = _listed(dictionary).join(listed, "part", "full").join(triples, "part", "full")
    doc.select(
        F.lit("graph-compact-v1").alias("format"), "part", empty("userIds", "array<string>"), empty("anime", "array<array<string>>"),
        empty("ua", "array<array<double>>"), empty("aa", "array<array<double>>"),
    ).write.mode("overwrite").json(path)


def write_model(users: DataFrame, items: DataFrame, path: str) -> None:
    """Factor tables as Parquet."""
    users.write.mode("overwrite").parquet(f"{path}/users")
    items.write.mode("overwrite").parquet(f"{path}/items")


def write_web_model(model: DataFrame, path: str, digits: int = 5, compact: bool = True) -> None:
    """``item_id, title, bias, q`` rounded: as parallel arrays in documents of at most about ``DOCUMENT_CELLS`` numbers (one for a small catalogue), or
    documents of one entry."""
    r = model.select("item_id", "title", quantise(F.col("bias"), digits).alias("bias"), F.transform("q", lambda x: quantise(x, digits)).alias("embedding"))
    if compact:
        cells = r.agg(F.coalesce(F.sum(F.size("embedding")), F.lit(0)).alias("n")).first()["n"]
        doc = r.groupBy(_part(_parts(cells), "item_id")).agg(F.sort_array(F.collect_list(F.struct("item_id", "title", "bias", "embedding"))).alias("a"))
        doc.select(F.lit("model-compact-v1").alias("format"), F.col("a.item_id").alias("animeIds"), F.col("a.title").alias("titles"), F.col("a.bias").alias("biases"), F.col("a.embedding").alias("embeddings")).write.mode("overwrite").json(path)
    else:
        r.select(F.array(F.struct(F.col("item_id").alias("animeId"), "title", "bias", "embedding")).alias("anime")).write.mode("overwrite").json(path)


#: Bytes of a file that a task holds at a time.
DIGEST_BYTES = 4 << 20


def list_files(spark: SparkSession, path: str) -> list[tuple[str, str, int]]:
    """(uri, name below ``path``, bytes) of all files under a folder, or of one file, by Hadoop's file system. Hidden files (``.`` or ``_`` first, and all in such
    folders) are left out, as Spark's readers do. A row a file reaches the driver, as for any scan."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    top, found, out = fs.getFileStatus(root).getPath().toUri().getPath(), fs.listFiles(root, True), []
    while found.hasNext():
        status = found.next()
        uri = status.getPath().toUri()
        name = uri.getPath()[len(top):].lstrip("/") or status.getPath().getName()
        if not any(part[:1] in "._" for part in name.split("/")):
            out.append((re.sub("^file:/+", "file:///", uri.toASCIIString()), name, status.getLen()))
    return sorted(out)


def _digests(batches):
    """Streams each file once, ``DIGEST_BYTES`` at a time."""
    for batch in batches:
        found = []
        for uri, size in zip(batch["uri"], batch["bytes"], strict=True):
            store, inner = pafs.FileSystem.from_uri(uri)
            digest, read = hashlib.sha256(), 0
            with store.open_input_stream(inner, compression=None) as stream:
                while chunk := stream.read(DIGEST_BYTES):
                    digest.update(chunk)
                    read += len(chunk)
            if read != size:
                raise ValueError(f"{uri} has {read} bytes, was listed with {size}")
            found.append(digest.hexdigest())
        yield batch.assign(sha256=found)[["name", "bytes", "sha256"]]


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """``name, bytes, sha256`` of all files of a folder, empty and very large ones too. A task streams its files, largest first dealt out, and memory doesn't grow with their
    size; a digest is of a whole file, so one file is one task's work. A file that changes after it is listed is an error. Schemes that Arrow's file systems read."""
    files = sorted(list_files(spark, path), key=lambda f: -f[2])
    tasks = max(1, min(len(files), 4 * spark.sparkContext.defaultParallelism))
    rows = [(k % tasks, *f) for k, f in enumerate(files)]
    table = spark.createDataFrame(rows, "task int, uri string, name string, bytes long")
    return table.repartition(tasks, "task").drop("task").mapInPandas(_digests, "name string, bytes long, sha256 string")


def merged_cache(cached: DataFrame, parsed: DataFrame, refresh: bool = False) -> DataFrame:
    """Cached features with newly parsed ones; ``refresh`` prefers the new."""
    keep, more = (parsed, cached) if refresh else (cached, parsed)
    return keep.unionByName(more.join(keep.select("item_id"), "item_id", "left_anti"))
