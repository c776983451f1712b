"""Co-rating graph: pair weights, caps, symmetry, summaries and subgraphs."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cofolio.sources.scratch import cut

#: Users, in id order, that are folded together; a task holds so many occurrences of a pair at most.
SEGMENT_USERS = 1 << 16

#: Ratings of a user that are paired as one piece.
PIECE = 1024


def with_segments(ratings: DataFrame, users: int = SEGMENT_USERS) -> DataFrame:
    """``ratings`` with ``seg``: which ``users`` successive users, in id order, the row's user belongs to."""
    every = cut(ratings.select("user_id").distinct(), "segment-users")
    if every.count() <= users:
        return ratings.withColumn("seg", F.lit(0).cast("long"))
    placed = dense_index(every, ["user_id"], "__at").select("user_id", F.expr(f"cast(__at div {users} as long)").alias("seg"))
    return ratings.join(placed, "user_id")


def item_pairs(normalised: DataFrame, piece: int = PIECE) -> DataFrame:
    """``user_id, lo, hi, s[, seg]``: all item pairs of each user with their mean score.

    Quadratic in a user's ratings; cap those first. A list of more than ``piece`` ratings is cut into pieces by the item's hash, and each two of them
    (and each with itself) meet as a key of their own. So no key has more than some ``piece`` rows a side, and short lists are still sent once.
    """
    more = [c for c in ("seg",) if c in normalised.columns]
    heavy = normalised.groupBy("user_id").agg(F.ceil(F.count("*") / piece).cast("int").alias("__pieces")).where("__pieces > 1")
    rows = normalised.select("user_id", "item_id", "normalized_score", *more).join(heavy, "user_id", "left").withColumn("__pieces", F.coalesce("__pieces", F.lit(1)))
    rows = rows.withColumn("__p", F.pmod(F.xxhash64("item_id"), F.col("__pieces")).cast("int"))
    a = rows.select("user_id", F.col("item_id").alias("__ai"), F.col("normalized_score").alias("__a"), F.col("__p").alias("__x"), F.explode(F.sequence("__p", F.col("__pieces") - 1)).alias("__y"), *more)
    b = rows.select("user_id", F.col("item_id").alias("__bi"), F.col("normalized_score").alias("__b"), F.explode(F.sequence(F.lit(0), "__p")).alias("__x"), F.col("__p").alias("__y"))
    met = a.join(b, ["user_id", "__x", "__y"]).where("__x < __y or __ai < __bi")
    return met.select("user_id", F.least("__ai", "__bi").alias("lo"), F.greatest("__ai", "__bi").alias("hi"), ((F.col("__a") + F.col("__b")) / 2).alias("s"), *more)


def pair_weights(pairs: DataFrame, digits: int = 4) -> DataFrame:
    """``lo, hi, weight, n, first_user``: the recursive mean over users in id order, w <- (w + s) / 2, beginning with the first s.

    A run of m users takes w to w / 2^m + c, and such maps compose in order. So the users of each segment (``seg`` of :func:`with_segments`, one
    where there is none) are folded on their own, a hot pair in as many tasks as it has segments, and one narrow row a pair and segment goes on.
    """
    pairs = pairs if "seg" in pairs.columns else pairs.withColumn("seg", F.lit(0).cast("long"))
    parts = pairs.groupBy("lo", "hi", "seg").agg(F.sort_array(F.collect_list(F.struct("user_id", "s"))).alias("__l"))
    fold = F.aggregate("__l", F.lit(0.0), lambda w, x: (w + x["s"]) / 2)
    part = parts.select("lo", "hi", F.struct("seg", F.size("__l").cast("long").alias("m"), fold.alias("c"), F.get("__l", F.lit(0)).alias("first")).alias("__part"))
    whole = part.groupBy("lo", "hi").agg(F.sort_array(F.collect_list("__part")).alias("__p"))
    first = F.get("__p", F.lit(0))["first"]
    weight = F.aggregate("__p", first["s"], lambda w, x: w * F.pow(F.lit(0.5), x["m"]) + x["c"])  # the first s, taken twice, is itself
    n = F.aggregate("__p", F.lit(0).cast("long"), lambda t, x: t + x["m"])
    return whole.select("lo", "hi", (F.round(weight, digits) + F.lit(0.0)).alias("weight"), n.alias("n"), first["user_id"].alias("first_user"))


#: Pair occurrences that a task holds and folds at a time.
FOLD_OCCURRENCES = 2_000_000
#: Rows that a task gathers before it folds them.
FOLD_ROWS = 100_000
#: Ratings that a range of users holds, about.
RANGE_RATINGS = 100_000


def _fold_units(starts: np.ndarray, ends: np.ndarray, cross: np.ndarray, codes: np.ndarray, names: int, norm: np.ndarray, own: np.ndarray) -> tuple:
    """Folds of the pairs of rows ``starts[0]`` to ``ends[-1]``: each unit's rows, in order of item, pair with each other, in ``cross`` units only with those of the other piece."""
    base = starts[0]
    last = np.repeat(ends, ends - starts)
    count = last - 1 - np.arange(base, ends[-1])
    left = np.repeat(np.arange(base, ends[-1]), count)
    right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(count) - count, count)
    fine = codes[left] != codes[right]
    if cross.any():
        fine &= ~np.repeat(cross, ends - starts)[left - base] | (own[left] != own[right])
    if not fine.all():
        left, right = left[fine], right[fine]
    key = codes[left] * names + codes[right]
    order = np.argsort(key, kind="stable")  # so users stay in order
    key, left, right = key[order], left[order], right[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    m = np.diff(np.append(first, len(key)))
    s = (norm[left] + norm[right]) / 2
    after = np.repeat(first + m, m) - np.arange(len(key))  # halvings of an occurrence: 1 for the last
    c = np.add.reduceat(np.ldexp(s, -after), first) if len(key) else np.zeros(0)
    return left[first], codes[left[first]], codes[right[first]], m, c, np.where(m > 1, s[first], np.nan)


def _fold_range(result: pa.Schema):
    """Of a range of users, in order, the parts of :func:`corated`'s folds, some ``FOLD_OCCURRENCES`` occurrences at a time."""

    def fold(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        column = lambda c: rows[c].combine_chunks()
        user, x, y, own = column("user_id"), column("x").to_numpy(), column("y").to_numpy(), column("own").to_numpy()
        names = column("item_id").dictionary_encode()
        codes, norm = names.indices.to_numpy().astype(np.int64), column("normalized_score").to_numpy(zero_copy_only=False).astype(float)
        u = user.dictionary_encode().indices.to_numpy()
        new = (u[1:] != u[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])
        starts = np.concatenate([[0], np.flatnonzero(new) + 1])
        ends, cross = np.append(starts[1:], len(u)), x[starts] != y[starts]
        upto = np.cumsum((ends - starts) * (ends - starts - 1) // 2)
        at = 0
        while at < len(starts):
            to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + FOLD_OCCURRENCES, "right")))
            row, lo, hi, m, c, s = _fold_units(starts[at:to], ends[at:to], cross[at:to], codes, len(names.dictionary), norm, own)
            yield pa.RecordBatch.from_arrays([
                names.dictionary.take(pa.array(lo)).cast(result.field("lo").type), names.dictionary.take(pa.array(hi)).cast(result.field("hi").type), user.take(pa.array(row)).cast(result.field("u").type),
                pa.array(m, pa.int64()), pa.array(c, from_pandas=True), pa.array(s, from_pandas=True),
            ], schema=result)
            at = to

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = None, 0
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            held = rows if held is None else pa.concat_tables([held, rows])
            size += batch.num_rows
            if size < FOLD_ROWS:
                continue
            end = [held[c][-1].as_py() for c in ("user_id", "x", "y")]  # the last unit may go on
            same = pc.and_(pc.and_(pc.equal(held["user_id"], end[0]), pc.equal(held["x"], end[1])), pc.equal(held["y"], end[2]))
            cut_at = held.num_rows - pc.sum(same).as_py()
            if cut_at:
                yield from fold(held.slice(0, cut_at))
                held = held.slice(cut_at)
            size = held.num_rows
        if held is not None and held.num_rows:
            yield from fold(held)

    return run



def corated(normalised: DataFrame, digits: int = 4, piece: int = PIECE) -> DataFrame:
    """``lo, hi, weight, n, first_user``: :func:`pair_weights` of :func:`item_pairs`, without a shuffled row for each occurrence of a pair.

    Ratings are dealt out in ranges of users, and a task pairs its users' lists and folds what it meets of a pair at once, in order. One narrow row a pair and fold goes
    on: a run of m users takes w to w / 2^m + c. As runs follow each other in order of users, each is halved by the users of the later ones. A list of more than ``piece`` ratings is several
    units, two of its pieces each, which may lie in several ranges. Rows of null user or item have no pairs.
    """
    rows = cut(normalised.where("user_id is not null and item_id is not null").select("user_id", "item_id", "normalized_score"), "corated")
    size = F.ceil(F.count("*") / piece).cast("int")
    heavy = rows.groupBy("user_id").agg(size.alias("__pieces")).where("__pieces > 1")
    own = F.pmod(F.xxhash64("item_id"), F.col("__pieces")).cast("int")
    units = rows.join(heavy, "user_id", "left").withColumn("__pieces", F.coalesce("__pieces", F.lit(1))).withColumn("own", own)
    units = units.withColumn("__q", F.explode(F.sequence(F.lit(0), F.col("__pieces") - 1)))
    units = units.select("user_id", F.least("own", "__q").alias("x"), F.greatest("own", "__q").alias("y"), "item_id", "normalized_score", "own")
    ranges = max(1, math.ceil(rows.count() / RANGE_RATINGS))
    dealt = units.repartitionByRange(ranges, "user_id", "x", "y").sortWithinPartitions("user_id", "x", "y", "item_id")
    kinds = dict(rows.dtypes)
    schema = f"lo {kinds['item_id']}, hi {kinds['item_id']}, u {kinds['user_id']}, m long, c double, s double"
    parts = dealt.mapInArrow(_fold_range(rows.sparkSession.createDataFrame([], schema).toArrow().schema), schema)
    later = F.coalesce(F.sum("m").over(Window.partitionBy("lo", "hi").orderBy(F.desc("u")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = parts.withColumn("__w", F.col("c") * F.pow(F.lit(0.5), later))
    # a run of one user has its s in c
    first = F.min(F.struct("u", F.coalesce("s", 2 * F.col("c")).alias("s"))).alias("f")
    whole = placed.groupBy("lo", "hi").agg(F.sum("__w").alias("w"), F.sum("m").alias("n"), first)
    weight = F.round(F.col("w") + F.col("f.s") * F.pow(F.lit(0.5), F.col("n")), 12)  # sums of doubles differ in the last bits by order
    return whole.select("lo", "hi", (F.round(weight, digits) + F.lit(0.0)).alias("weight"), "n", F.col("f.u").alias("first_user"))


def capped_pairs(weights: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` distinct pairs in the order in which users' lists meet them; 0 keeps all. The limit may be millions, so
    pairs are numbered in ranges and don't pass through one task."""
    return dense_index(weights, ["first_user", "lo", "hi"], "__at").where(F.col("__at") < limit).drop("__at") if limit > 0 else weights


def skipped_occurrences(weights: DataFrame, limit: int) -> DataFrame:
    """``kept_pairs, skipped``: pairs kept by the cap and pair occurrences that it skips."""
    if limit <= 0:
        return weights.agg(F.count("*").alias("kept_pairs"), F.lit(0).cast("long").alias("skipped"))
    placed, kept = dense_index(weights.select("first_user", "lo", "hi", "n"), ["first_user", "lo", "hi"], "__at"), F.col("__at") < limit
    return placed.agg(F.count_if(kept).alias("kept_pairs"), F.coalesce(F.sum(F.when(~kept, F.col("n"))), F.lit(0)).alias("skipped"))


def nodes(ratings: DataFrame, items: DataFrame) -> DataFrame:
    """``id, label, node_type`` of users and items."""
    users = ratings.select("user_id").distinct().select(
        F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("id"),
        F.concat(F.lit("User "), F.substring(F.col("user_id").cast("string"), 1, 8)).alias("label"), F.lit("user").alias("node_type"),
    )
    rated = ratings.select("item_id").distinct().join(items, "item_id", "left")
    return users.unionByName(rated.select(
        F.concat(F.lit("anime:"), F.col("item_id").cast("string")).alias("id"),
        F.coalesce("title", F.concat(F.lit("Anime "), F.col("item_id").cast("string"))).alias("label"), F.lit("anime").alias("node_type"),
    ))


def symmetric(pairs: DataFrame) -> DataFrame:
    """``src, dst, weight``: each pair both ways."""
    ways = F.array(F.struct(F.col("lo").alias("src"), F.col("hi").alias("dst")), F.struct(F.col("hi").alias("src"), F.col("lo").alias("dst")))
    return pairs.select(F.explode(ways).alias("way"), "weight").select("way.src", "way.dst", "weight")  # a union would work the pairs out twice


def strong_edges(edges: DataFrame, least: float) -> DataFrame:
    """Item edges without loops and missing weights, of at least this absolute weight."""
    w = F.col("weight")
    return edges.where((F.col("src") != F.col("dst")) & w.isNotNull() & ~F.isnan(w) & (F.abs(w) >= least))


def undirected(edges: DataFrame) -> DataFrame:
    """``a, b, weight``: edges of either direction together, by mean absolute weight."""
    return edges.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.avg(F.abs("weight")).alias("weight"))


def normalised_adjacency(edges: DataFrame) -> DataFrame:
    """``src, dst, w``: weights over the roots of both weighted degrees, repeated entries summed. The edges are met three times, so they are written first."""
    edges = cut(edges.select("src", "dst", "weight"), "adjacency")
    degree = edges.groupBy("src").agg(F.greatest(F.sum("weight"), F.lit(1e-12)).alias("d"))
    both = edges.join(degree.withColumnRenamed("d", "ds"), "src").join(degree.select(F.col("src").alias("dst"), F.col("d").alias("dd")), "dst")
    return both.groupBy("src", "dst").agg(F.sum(F.col("weight") / F.sqrt(F.col("ds") * F.col("dd"))).alias("w"))


def graph_counts(user_edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """``users, items, user_item_edges, item_item_edges``."""
    left = user_edges.agg(F.count_distinct("user_id").alias("users"), F.count_distinct("item_id").alias("items"), F.count("*").alias("user_item_edges"))
    return left.join(F.broadcast(pairs.agg(F.count("*").alias("item_item_edges"))))


def default_threshold(pairs: DataFrame, step: float = 0.05) -> DataFrame:
    """``threshold``: the mean absolute weight, within [0, 4], on a grid of ``step``."""
    mean = F.least(F.lit(4.0), F.greatest(F.lit(0.0), F.avg(F.abs("weight"))))
    return pairs.agg(F.round(F.round(mean / step) * step, 2).alias("threshold"))


def neighbourhood(edges: DataFrame) -> DataFrame:
    """One row a node of ``edges(src, dst, weight)``: neighbours, signs, mean, strongest and weakest."""
    return edges.groupBy(F.col("src").alias("node")).agg(
        F.count_distinct("dst").alias("neighbours"), F.count_if(F.col("weight") > 0).alias("positive"), F.count_if(F.col("weight") < 0).alias("negative"),
        F.round(F.avg("weight"), 6).alias("mean_weight"), F.max("weight").alias("strongest"), F.min("weight").alias("weakest"),
    )


def top_neighbours(edges: DataFrame, n: int = 250) -> DataFrame:
    """Each node's ``n`` heaviest edges with their rank."""
    order = Window.partitionBy("src").orderBy(F.desc("weight"), "dst")
    return edges.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def subgraph(user_edges: DataFrame, pairs: DataFrame, least: float, user_cap: int = 4000, item_cap: int = 12000, users: bool = True, items: bool = True) -> DataFrame:
    """``edge_type, source, target, weight, eligible, capped``: edges to draw; the caps are the feature.

    Each kind is limited by a distributed top-k in id order, counts are taken before the caps.
    """
    ua = user_edges.select(F.lit("user-item").alias("edge_type"), F.col("user_id").alias("source"), F.col("item_id").alias("target"), "weight")
    aa = pairs.where(F.abs("weight") >= least).select(F.lit("item-item").alias("edge_type"), F.col("lo").alias("source"), F.col("hi").alias("target"), "weight")

    def limited(edges: DataFrame, cap: int) -> DataFrame:
        fine = edges.where(F.col("weight").isNotNull() & ~F.isnan("weight"))
        size = fine.agg(F.count("*").alias("eligible")).withColumn("capped", F.col("eligible") > cap)
        return fine.orderBy("source", "target").limit(cap).join(F.broadcast(size))

    parts = [limited(e, c) for e, c, on in ((ua, user_cap, users), (aa, item_cap, items)) if on]
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def edge_sample(edges: DataFrame, rate: float, seed: str = "1") -> DataFrame:
    """Exactly max(1, round(n * rate)) edges without replacement, by seeded hash."""
    if rate >= 1:
        return edges
    mixed = F.md5(F.concat_ws("|", F.lit(seed), F.col("src").cast("string"), F.col("dst").cast("string")))
    edges, names, mixed = cut(edges.withColumn("__h", mixed), "sampled-edges"), edges.columns, F.col("__h")
    n = edges.count()
    # the last hash kept is found by counts of 4 and then 8 hexadecimal digits; only edges that share its 8 digits are sorted
    need, start = max(1, round(n * rate)), ""
    for width in (4, 8) if n else ():
        sizes = edges.where(F.startswith(mixed, F.lit(start))).groupBy(F.substring(mixed, 1, width).alias("start")).agg(F.count("*").alias("n"))
        upto = sizes.withColumn("upto", F.sum("n").over(Window.orderBy("start")))  # 65 536 rows at most
        edge = upto.where(F.col("upto") >= need).orderBy("start").first()
        start, need = edge["start"], need - (edge["upto"] - edge["n"])
    last = edges.where(F.startswith(mixed, F.lit(start))).orderBy(mixed, "src", "dst").limit(need)
    return edges.where(mixed < F.lit(start)).unionByName(last).select(*names)


def dense_index(df: DataFrame, order: list[str], name: str = "idx") -> DataFrame:
    """``df`` with gapless positions in ``order``, without one task seeing all rows: ranges are sorted
    each on its own and shifted by the sizes of those before (one row a range)."""
    parts = cut(df.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()), "index")  # ranges are drawn by sampling, so once
    within = parts.withColumn("__r", F.row_number().over(Window.partitionBy("__p").orderBy(*order)))
    starts = parts.groupBy("__p").agg(F.count("*").alias("__n"))
    starts = starts.withColumn("__from", F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)))
    return within.join(F.broadcast(starts), "__p").withColumn(name, F.coalesce("__from", F.lit(0)) + F.col("__r") - 1).drop("__p", "__r", "__n", "__from")
