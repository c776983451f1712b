"""Recommendations for all watch-lists at once: ``watch(user_id, item_id, weight, pos)``."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cofolio.functions.scalars import auto_blend, clamp_blend, clamp_weight, content_similarity
from cofolio.operators.graph import dense_index
from cofolio.operators.inner_product import BLOCK_ITEMS, best_scores, item_index, pair_scores
from cofolio.operators.vectors import sum_vectors, width_of
from cofolio.sources.scratch import cut

#: Rows of a factor block where all scores are kept; a task multiplies two such blocks.
FULL_BLOCK_ROWS = 1024
#: Items of a watch-list that go with each of them; longer lists are joined.
SHORT_LIST = 64
#: Edges of a graph that are sent to all tasks; more of them are joined by a shuffle.
FEW_EDGES = 250_000
#: Watched items that a task meets with their edges, about.
SEEDS_A_TASK = 10_000
#: Scaled model scores below this are the least one's, up to rounding.
NOTHING = 1e-12


def ranked(scored: DataFrame, k: int) -> DataFrame:
    """Each user's best ``k`` rows by score, support and strongest contribution, then item id; adds ``rank``."""
    order = Window.partitionBy("user_id").orderBy(F.desc("score"), F.desc("support"), F.desc("strongest"), "item_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def graph_candidates(watch: DataFrame, adjacency: DataFrame) -> DataFrame:
    """``user_id, item_id, watched_id, pos, edge_weight, weight_factor, weighted``: edges from watched to other items.

    A list of up to ``SHORT_LIST`` items goes with each of its items, so that what the user has watched is left out where it is met and no candidate is shuffled
    for that; longer lists are told apart by a join. Lists are dealt out by user, and up to ``FEW_EDGES`` edges are sent to all tasks; a user's
    candidates are then in one task.
    """
    edges = cut(adjacency.select(F.col("src").alias("watched_id"), F.col("dst").alias("item_id"), F.col("weight").alias("edge_weight")), "candidate-edges")
    few = edges.count() <= FEW_EDGES
    seeds = watch.select("user_id", F.col("item_id").alias("watched_id"), "pos", clamp_weight(F.col("weight")).alias("weight_factor"))
    seeds = cut(seeds.withColumn("__n", F.count("*").over(Window.partitionBy("user_id"))), "candidate-seeds")
    rows, longest = seeds.agg(F.count("*"), F.max("__n")).first()
    tasks = max(watch.sparkSession.sparkContext.defaultParallelism, math.ceil(rows / SEEDS_A_TASK))

    def met(some: DataFrame) -> DataFrame:
        return some.join(F.broadcast(edges) if few else edges, "watched_id").withColumn("weighted", F.col("edge_weight") * F.col("weight_factor"))

    names = ["user_id", "item_id", "watched_id", "pos", "edge_weight", "weight_factor", "weighted"]
    entry = F.struct("watched_id", "pos", "weight_factor")
    lists = seeds.where(F.col("__n") <= SHORT_LIST).repartition(tasks, "user_id").groupBy("user_id").agg(F.collect_list(entry).alias("__l"))
    short = met(lists.select("user_id", F.col("__l.watched_id").alias("__seen"), F.explode("__l").alias("__w")).select("user_id", "__seen", "__w.*"))
    fresh = F.col("user_id").isNull() | ~F.coalesce(F.array_contains("__seen", F.col("item_id")), F.lit(False))  # nulls equal nothing
    short = short.where(fresh).select(*names)
    if longest is None or longest <= SHORT_LIST:
        return short
    long = seeds.where(F.col("__n") > SHORT_LIST)
    seen = long.select("user_id", F.col("watched_id").alias("item_id"))
    return short.unionByName(met(long.drop("__n")).join(seen, ["user_id", "item_id"], "left_anti").select(*names))


def graph_scores(candidates: DataFrame) -> DataFrame:
    """``user_id, item_id, score, strongest, support`` over positive edges."""
    good = candidates.where("edge_weight > 0")
    return good.groupBy("user_id", "item_id").agg(F.sum("weighted").alias("score"), F.max("weighted").alias("strongest"), F.count("*").alias("support"))


def graph_contributions(candidates: DataFrame) -> DataFrame:
    """``user_id, item_id, contributions``: positive edges, and others from items watched after the first positive one."""
    part = F.struct((-F.col("weighted")).alias("o"), "watched_id", "edge_weight", "weight_factor", "weighted", "pos")
    listed = candidates.groupBy("user_id", "item_id").agg(F.min(F.when(F.col("edge_weight") > 0, F.col("pos"))).alias("__first"), F.sort_array(F.collect_list(part)).alias("__c"))
    kept = listed.withColumn("__c", F.filter("__c", lambda x: (x.edge_weight > 0) | (x.pos > F.col("__first")))).where(F.size("__c") > 0)
    return kept.select("user_id", "item_id", F.transform("__c", lambda x: x.dropFields("o", "pos")).alias("contributions"))


def graph_recommend(watch: DataFrame, adjacency: DataFrame, k: int = 10) -> DataFrame:
    """Top ``k`` with scores; one shuffle by user and item, one by user."""
    return ranked(graph_scores(graph_candidates(watch, adjacency)), k)


def watch_vectors(watch: DataFrame, model: DataFrame) -> DataFrame:
    """``user_id, p``: weighted mean of the factors of known watched items, worked out once for all users of equal lists."""
    entry = F.struct("item_id", clamp_weight(F.col("weight")).alias("w"))
    lists = cut(watch.where("user_id is not null").groupBy("user_id").agg(F.sort_array(F.collect_list(entry)).alias("l")), "watch-lists")
    each = cut(lists.select("l").distinct().withColumn("list", F.monotonically_increasing_id()), "distinct-lists")
    known = each.select("list", F.explode("l").alias("e")).select("list", "e.item_id", "e.w").join(model.select("item_id", "q"), "item_id")
    sums = sum_vectors(known.select("list", F.transform("q", lambda x: x * F.col("w")).alias("p")), "list", "p", width_of(model, "q"))
    mass = known.where(F.size("q") > 0).groupBy("list").agg(F.sum(F.abs("w")).alias("__w"))
    means = sums.join(mass, "list").select("list", F.transform("p", lambda x: x / F.col("__w")).alias("p"))
    return lists.join(each, "l").select("user_id", "list").join(means, "list").select("user_id", "p")


def model_scores(watch: DataFrame, model: DataFrame, global_mean: float = 0.0) -> DataFrame:
    """``user_id, item_id, score, strongest, support`` of every item that the model knows and the user hasn't watched.

    What is merged, scaled or filtered needs all of them; a cut comes last. Users and items meet in blocks by an equi-join of
    block numbers. A user's watched vectors travel with the user, so neither watched items nor contributions need a join of all scores.
    Users whose watched items the model lacks have no rows.
    """
    entry = F.struct("item_id", clamp_weight(F.col("weight")).alias("w"), "q")
    own = watch.join(model.select("item_id", "q"), "item_id").groupBy("user_id").agg(F.sort_array(F.collect_list(entry)).alias("own"))
    n_items, n_users = model.count(), watch.select("user_id").distinct().count()
    item_blocks, user_blocks = max(1, math.ceil(n_items / FULL_BLOCK_ROWS)), max(1, math.ceil(n_users / FULL_BLOCK_ROWS))
    mod = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    users = watch_vectors(watch, model).join(own, "user_id")
    left = users.select("user_id", "p", F.col("own.item_id").alias("ids"), F.col("own.w").alias("w"), F.col("own.q").alias("wq"), mod("user_id", user_blocks).alias("ub"))
    left = left.withColumn("ib", F.explode(F.sequence(F.lit(0), F.lit(item_blocks - 1))))
    right = model.select("item_id", "q", "bias", mod("item_id", item_blocks).alias("ib")).withColumn("ub", F.explode(F.sequence(F.lit(0), F.lit(user_blocks - 1))))

    def multiply(u: pd.DataFrame, items: pd.DataFrame) -> pd.DataFrame:
        items = items[items["q"].map(len) == len(u["p"].iloc[0])]
        if not len(items):
            return pd.DataFrame({"user_id": [], "item_id": [], "score": [], "strongest": [], "support": []})
        ids, q = items["item_id"].to_numpy(), np.stack(items["q"].to_numpy())
        base, out = items["bias"].to_numpy() + global_mean, []
        for at in range(0, len(u), 64):
            part = u.iloc[at : at + 64]
            score = np.stack(part["p"].to_numpy()) @ q.T + base
            fresh, strongest, support = np.ones(score.shape, bool), np.empty(score.shape), np.empty(score.shape, np.int64)
            for k, (mine, w, wq) in enumerate(zip(part["ids"], part["w"], part["wq"], strict=True)):
                each = (np.stack(wq) * np.asarray(w)[:, None]) @ q.T
                strongest[k], support[k] = each.max(axis=0), (each > 0).sum(axis=0)
                fresh[k] = ~np.isin(ids, mine)
            row, col = np.nonzero(fresh)
            out.append(pd.DataFrame({"user_id": part["user_id"].to_numpy()[row], "item_id": ids[col], "score": score[row, col], "strongest": strongest[row, col], "support": support[row, col]}))
        return pd.concat(out)

    kinds = dict(watch.dtypes) | {"item_id": dict(model.dtypes)["item_id"]}
    pairs = left.groupBy("ub", "ib").cogroup(right.groupBy("ub", "ib"))
    schema = f"user_id {kinds['user_id']}, item_id {kinds['item_id']}, score double, strongest double, support long"
    result = watch.sparkSession.createDataFrame([], schema).toArrow().schema

    def cell(u: pa.Table, items: pa.Table) -> pa.Table:
        # an empty side's nested lists aren't turned into pandas: that has crashed workers in Arrow
        if not u.num_rows or not items.num_rows:
            return result.empty_table()
        return pa.Table.from_pandas(multiply(u.to_pandas(), items.to_pandas()), schema=result, preserve_index=False)

    return pairs.applyInArrow(cell, schema)


def with_model_contributions(scored: DataFrame, watch: DataFrame, model: DataFrame) -> DataFrame:
    """``scored`` with ``support``, ``strongest`` and ``contributions`` (of the rows given only, so rank first)."""
    own = watch.join(model.select("item_id", F.col("q").alias("wq")), "item_id").select("user_id", F.col("item_id").alias("watched_id"), clamp_weight(F.col("weight")).alias("w"), "wq")
    dot = F.aggregate(F.zip_with("q", "wq", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    met = scored.join(model.select("item_id", "q"), "item_id").join(own, "user_id").withColumn("sim", dot)
    part = F.struct((-(F.col("sim") * F.col("w"))).alias("o"), "watched_id", F.col("sim").alias("edge_weight"), F.col("w").alias("weight_factor"), (F.col("sim") * F.col("w")).alias("weighted"))
    grouped = met.groupBy("user_id", "item_id", "score").agg(
        F.count_if(F.col("sim") * F.col("w") > 0).alias("support"), F.max(F.col("sim") * F.col("w")).alias("strongest"), F.sort_array(F.collect_list(part)).alias("__c")
    )
    return grouped.withColumn("contributions", F.transform("__c", lambda x: x.dropFields("o"))).drop("__c")


def model_recommend(watch: DataFrame, model: DataFrame, k: int = 10, global_mean: float = 0.0) -> DataFrame:
    """Top ``k`` unwatched items by the model, with contributions; watched items the model lacks play no part."""
    top, _, _ = best_scores(watch_vectors(watch, model), item_index(model), k, watch, global_mean)
    return ranked(with_model_contributions(top, watch, model), k)


def known_user_recommend(factors: DataFrame, model: DataFrame, seen: DataFrame, n: int = 10, min_score: float | None = None, global_mean: float = 0.0) -> DataFrame:
    """Top ``n`` unseen items of users with factors ``user_id, p, bu``; seen items never appear."""
    best, _, _ = best_scores(factors, item_index(model), n, seen, global_mean)
    # lists of users of equal factors are equal too and take little room in files, so Spark would send them to all tasks through the driver
    scored = best.join(factors.select("user_id", "bu").hint("merge"), "user_id").select("user_id", "item_id", (F.col("score") + F.col("bu")).alias("score"))
    scored = scored if min_score is None else scored.where(F.col("score") >= min_score)
    order = Window.partitionBy("user_id").orderBy(F.desc("score"), "item_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def scaled(scored: DataFrame, name: str = "scaled") -> DataFrame:
    """With the score brought to [0, 1] within each user; 1 where all are equal."""
    user = Window.partitionBy("user_id")
    low, high = F.min("score").over(user), F.max("score").over(user)
    return scored.withColumn(name, F.when(high <= low, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(F.col("score") - low, high - low)))))


def _share(rows: DataFrame, share: Column, tag: str) -> DataFrame:
    """Rows with ``scaled`` as one side of a blend; parts that aren't positive are dropped."""
    part = rows.withColumn("__s", F.col("scaled") * share).where("__s > 0")
    return part.select("user_id", "item_id", F.col("__s").alias("s" + tag), (F.col("strongest") * share).alias("t" + tag), F.col("support").alias("n" + tag))


def _blend(graph: DataFrame, model: DataFrame, model_weight: float) -> DataFrame:
    """``user_id, item_id, score, strongest, support`` of both scaled lists: weighted, non-positive parts dropped, summed."""
    blend = clamp_blend(F.lit(float(model_weight)))
    both = _share(graph, 1 - blend, "g").join(_share(model, blend, "m"), ["user_id", "item_id"], "full_outer")
    zero = lambda c, v: F.coalesce(c, F.lit(v))
    return both.select(
        "user_id", "item_id", (zero("sg", 0.0) + zero("sm", 0.0)).alias("score"), F.greatest("tg", "tm").alias("strongest"), (zero("ng", 0) + zero("nm", 0)).alias("support")
    )


def hybrid(graph: DataFrame, model: DataFrame, model_weight: float) -> DataFrame:
    """The blend of two whole lists, each scaled within a user."""
    return _blend(scaled(graph), scaled(model), model_weight)


def hybrid_all(graph: DataFrame, watch: DataFrame, model: DataFrame, model_weight: float) -> DataFrame:
    """:func:`hybrid` of ``graph`` and :func:`model_scores`: as many rows as pairs of a user and an unwatched item, which come out of the tasks blended and are never shuffled.

    Each user's least and largest score are found by the index first. A cell gets its users, the vectors of what they watched (once each), its graph rows and its items.
    """
    share = float(model_weight) if math.isfinite(model_weight) else 0.5
    share, key = max(0.0, min(1.0, share)), ["user_id", "item_id"]
    from_graph = cut(_share(scaled(graph), F.lit(1 - share), "g"), "hybrid-graph")
    users, index, seen = cut(watch_vectors(watch, model), "hybrid-users"), item_index(model), watch.select(*key)
    high, _, _ = best_scores(users, index, 1, seen)
    low, _, _ = best_scores(users, index, 1, seen, largest=False)
    scale = high.groupBy("user_id").agg(F.max("score").alias("high")).join(low.groupBy("user_id").agg(F.min("score").alias("low")), "user_id")
    n_items, n_users = model.count(), users.count()
    item_blocks, user_blocks = max(1, math.ceil(n_items / FULL_BLOCK_ROWS)), max(1, math.ceil(n_users / FULL_BLOCK_ROWS))
    mod = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    known = watch.join(model.where(F.size("q") > 0).select("item_id", "q"), "item_id")
    own = known.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("item_id", clamp_weight(F.col("weight")).alias("w")))).alias("own"))
    people = cut(users.join(own, "user_id").join(scale, "user_id").withColumn("ub", mod("user_id", user_blocks)), "hybrid-people")
    kinds = dict(watch.dtypes) | {"item_id": dict(model.dtypes)["item_id"]}
    null = lambda kind, name: F.lit(None).cast(kind).alias(name)
    every = F.explode(F.sequence(F.lit(0), F.lit(item_blocks - 1))).alias("ib")
    ids, w = F.col("own.item_id").alias("ids"), F.col("own.w").alias("w")
    ids_kind, number = f"array<{kinds['item_id']}>", [null("double", c) for c in ("sg", "tg")]
    left = people.select("ub", every, "user_id", null(kinds["item_id"], "item_id"), F.col("p").alias("v"), ids, w, "low", "high", *number, null("long", "ng"))
    watched = people.select("ub", F.explode("own.item_id").alias("item_id")).distinct().join(model.select("item_id", "q"), "item_id")
    empty = [null(ids_kind, "ids"), null("array<double>", "w"), null("double", "low"), null("double", "high")]
    left = left.unionByName(watched.select("ub", every, null(kinds["user_id"], "user_id"), "item_id", F.col("q").alias("v"), *empty, *number, null("long", "ng")))
    placed = from_graph.join(people.select("user_id", "ub"), "user_id", "left").join(model.where(F.size("q") > 0).select("item_id", mod("item_id", item_blocks).alias("ib")), "item_id", "left")
    placed = cut(placed, "hybrid-placed")
    inside = placed.where("ub is not null and ib is not null")
    left = left.unionByName(inside.select("ub", "ib", "user_id", "item_id", null("array<double>", "v"), *empty, "sg", "tg", F.col("ng").cast("long").alias("ng")))
    right = model.where(F.size("q") > 0).select("item_id", "q", F.coalesce("bias", F.lit(0.0)).alias("bias"), mod("item_id", item_blocks).alias("ib")).withColumn("ub", F.explode(F.sequence(F.lit(0), F.lit(user_blocks - 1))))
    schema = f"user_id {kinds['user_id']}, item_id {kinds['item_id']}, score double, strongest double, support long"
    result = watch.sparkSession.createDataFrame([], schema).toArrow().schema

    def blend(rows: pd.DataFrame, items: pd.DataFrame) -> pd.DataFrame:
        is_user, is_graph = rows["low"].notna(), rows["sg"].notna()
        mine, met, seen = rows[is_user], rows[is_graph], rows[~is_user & ~is_graph]
        width = len(mine["v"].iloc[0])
        fits = (items["q"].map(len) == width).to_numpy()
        alien = met[~met["item_id"].isin(items["item_id"][fits])]
        out = [pd.DataFrame({"user_id": alien["user_id"], "item_id": alien["item_id"], "score": alien["sg"], "strongest": alien["tg"], "support": alien["ng"]})]
        items = items[fits]
        if len(items):
            ids, q = items["item_id"].to_numpy(), np.stack(items["q"].to_numpy())
            seen = seen[seen["v"].map(len) == width]
            place, each = pd.Index(seen["item_id"]), np.stack(seen["v"].to_numpy()) @ q.T
            at, col = pd.Index(mine["user_id"]).get_indexer(met["user_id"]), pd.Index(ids).get_indexer(met["item_id"])
            for start in range(0, len(mine), 64):
                part = mine.iloc[start : start + 64]
                low, high = part["low"].to_numpy()[:, None], part["high"].to_numpy()[:, None]
                score = np.stack(part["v"].to_numpy()) @ q.T + items["bias"].to_numpy()
                with np.errstate(invalid="ignore", divide="ignore"):
                    s = np.where(high <= low, 1.0, np.minimum(1.0, (score - low) / (high - low)))
                s = np.where(s > NOTHING, s, 0.0) * share
                t, n = np.empty(s.shape), np.empty(s.shape, np.int64)
                for k, (known_ids, known_w) in enumerate(zip(part["ids"], part["w"], strict=True)):
                    of = place.get_indexer(known_ids)
                    parts = each[of[of >= 0]] * np.asarray(known_w)[of >= 0][:, None]
                    t[k], n[k] = parts.max(axis=0) * share, (parts > 0).sum(axis=0)
                    s[k, np.isin(ids, known_ids)] = 0.0
                t[s <= 0], n[s <= 0] = np.nan, 0
                here = (at >= start) & (at < start + len(part)) & (col >= 0)
                spot = at[here] - start, col[here]
                s[spot] += met["sg"].to_numpy()[here]
                t[spot] = np.fmax(t[spot], met["tg"].to_numpy()[here])
                n[spot] += met["ng"].to_numpy()[here].astype(np.int64)
                row, c = np.nonzero(s > 0)
                out.append(pd.DataFrame({"user_id": part["user_id"].to_numpy()[row], "item_id": ids[c], "score": s[row, c], "strongest": t[row, c], "support": n[row, c]}))
        return pd.concat(out)

    def cell(rows: pa.Table, items: pa.Table) -> pa.Table:
        if not rows.num_rows or not items.num_rows:
            return result.empty_table()
        return pa.Table.from_pandas(blend(rows.to_pandas(), items.to_pandas()), schema=result, preserve_index=False)

    both = left.groupBy("ub", "ib").cogroup(right.groupBy("ub", "ib")).applyInArrow(cell, schema)
    outside = placed.where("ub is null or ib is null").select(*key, F.col("sg").alias("score"), F.col("tg").alias("strongest"), F.col("ng").alias("support"))
    return both.unionByName(outside)


def model_rows(
    watch: DataFrame, model: DataFrame, k: int, graph: DataFrame | None = None, allowed: DataFrame | None = None, include: DataFrame | None = None, exclude: DataFrame | None = None,
    block_items: int = BLOCK_ITEMS,
) -> DataFrame:
    """The model's list as far as a top ``k`` of a blend needs it, exactly: ``user_id, item_id, score, scaled, strongest, support, contributions``.

    ``scaled`` is by each user's least and largest score over all unwatched items, which the index finds as well. Rows are the user's candidates in ``graph``
    and on the include list, and of all other items that may be shown the best ``k`` with ties. Among those the blend falls with the model's score alone, so nothing else can enter the top ``k``.
    So rows are at most users x (k + candidates), not users x items. ``allowed(item_id)`` limits what is shown, not the scale.
    """
    users, seen = cut(watch_vectors(watch, model), "hybrid-users"), watch.select("user_id", "item_id")
    index = item_index(model, block_items)
    high, _, _ = best_scores(users, index, 1, seen)
    low, _, _ = best_scores(users, index, 1, seen, largest=False)
    scale = high.groupBy("user_id").agg(F.max("score").alias("__high")).join(low.groupBy("user_id").agg(F.min("score").alias("__low")), "user_id")
    asked = [listed_only(df.select("user_id", "item_id"), include, exclude) for df in (graph, include) if df is not None]
    hidden, free = [seen, *asked, *([] if exclude is None else [exclude.select("user_id", "item_id")])], users
    if include is not None:  # such users see listed items only
        free = users.join(include.select("user_id").distinct(), "user_id", "left_anti")
    if allowed is not None:
        index = item_index(model.join(allowed.select("item_id").distinct(), "item_id", "left_semi"), block_items)
    taken = hidden[0]
    for df in hidden[1:]:
        taken = taken.unionByName(df)
    best, _, _ = best_scores(free, index, k, taken)
    if asked:
        pairs = asked[0] if len(asked) == 1 else asked[0].unionByName(asked[1])
        pairs = pairs.distinct().join(seen, ["user_id", "item_id"], "left_anti")
        pairs = pairs if allowed is None else pairs.join(allowed.select("item_id").distinct(), "item_id", "left_semi")
        best = best.unionByName(pair_scores(pairs, users, model))
    rows = cut(with_model_contributions(best, watch, model), "hybrid-rows").join(scale, "user_id")
    value = F.when(F.col("__high") <= F.col("__low"), 1.0).otherwise(F.least(F.lit(1.0), F.try_divide(F.col("score") - F.col("__low"), F.col("__high") - F.col("__low"))))
    return rows.withColumn("scaled", F.when(value > NOTHING, value).otherwise(0.0)).drop("__high", "__low")


def hybrid_parts(
    graph: DataFrame, watch: DataFrame, model: DataFrame, model_weight: float, k: int, allowed: DataFrame | None = None, include: DataFrame | None = None, exclude: DataFrame | None = None,
    block_items: int = BLOCK_ITEMS,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows of :func:`hybrid` over graph scores and every unwatched item's model score that hold each user's top ``k`` of those that may be shown;
    then the scaled rows of the graph and of the model that they come from."""
    graph = cut(graph, "hybrid-graph")
    from_model = model_rows(watch, model, k, graph, allowed, include, exclude, block_items)
    from_graph = listed_only(scaled(graph), include, exclude)
    from_graph = from_graph if allowed is None else from_graph.join(allowed.select("item_id").distinct(), "item_id", "left_semi")
    return _blend(from_graph, from_model, model_weight), from_graph, from_model


def hybrid_contributions(rows: DataFrame, from_graph: DataFrame, from_model: DataFrame, candidates: DataFrame, model_weight: float, n: int = 10) -> DataFrame:
    """``rows`` with ``contributions``: those of the parts that count, each by its share, the best ``n`` where both count."""
    blend, key = clamp_blend(F.lit(float(model_weight))), ["user_id", "item_id"]
    wanted = rows.select(*key)
    own = from_graph.where(F.col("scaled") * (1 - blend) > 0).join(wanted, key, "left_semi").select(*key)
    of_graph = graph_contributions(candidates.join(own, key, "left_semi")).withColumnRenamed("contributions", "__g")
    of_model = from_model.where(F.col("scaled") * blend > 0).select(*key, F.col("contributions").alias("__m"))
    both = rows.join(of_graph, key, "left").join(of_model, key, "left")
    return both.withColumn("contributions", merged_contributions(F.col("__g"), F.col("__m"), 1 - blend, blend, n)).drop("__g", "__m")


def merged_contributions(a: Column, b: Column, share_a: Column, share_b: Column, n: int = 10) -> Column:
    """Two contribution arrays, each scaled, as one: the best ``n`` where both are there, else the one there is."""
    scale = lambda c, f: F.transform(c, lambda x: x.withField("weighted", x.weighted * f))
    best = lambda c: F.slice(F.array_sort(c, lambda x, y: F.when(x.weighted > y.weighted, -1).when(x.weighted < y.weighted, 1).otherwise(0)), 1, n)
    return F.when(a.isNull(), scale(b, share_b)).when(b.isNull(), scale(a, share_a)).otherwise(best(F.concat(scale(a, share_a), scale(b, share_b))))


def once_a_list(watch: DataFrame, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``work`` of ``watch``, whose rows of a ``user_id`` follow from that user's items and weights alone: worked out for one user of each distinct list and handed to all users who have it."""
    entry = F.sort_array(F.collect_list(F.struct("item_id", "weight"))).alias("l")
    lists = cut(watch.where("user_id is not null").groupBy("user_id").agg(entry), "user-lists")
    members = cut(lists.join(lists.groupBy("l").agg(F.min("user_id").alias("__first")), "l").select("user_id", "__first"), "list-members")
    firsts = cut(watch.join(members.where("user_id = __first").select("user_id"), "user_id", "left_semi"), "first-lists")
    done = work(firsts)
    return done.withColumnRenamed("user_id", "__first").join(members, "__first").select(*done.columns)


def content_scores(watch: DataFrame, features: DataFrame, candidates: DataFrame) -> DataFrame:
    """``user_id, item_id, content``: weighted mean similarity of candidates ``user_id, item_id`` to the user's watched items with features."""
    entry = F.struct("genres", "studios", "year", "score")
    mine = F.struct("item_id", clamp_weight(F.col("weight")).alias("w"), "a")
    own = watch.join(features.select("item_id", entry.alias("a")), "item_id").groupBy("user_id").agg(F.sort_array(F.collect_list(mine)).alias("__own"), F.sum(F.abs(clamp_weight(F.col("weight")))).alias("__w"))
    met = candidates.select("user_id", "item_id").join(features.select("item_id", entry.alias("b")), "item_id").join(own, "user_id")
    total = F.aggregate("__own", F.lit(0.0), lambda s, x: s + content_similarity(x["a"], F.col("b")) * x["w"])
    return met.select("user_id", "item_id", (total / F.col("__w")).alias("content"))


def content_blended(scored: DataFrame, content: DataFrame, known: DataFrame, explicit: float | None = None) -> DataFrame:
    """``scored`` with the content score brought to the model score's mean and spread and blended in.

    Means and spreads are over each user's rows with both scores; rows without content keep their score. ``known(user_id, n)``
    counts watched items with features.
    """
    both = scored.join(content, ["user_id", "item_id"], "left").join(known, "user_id", "left")
    user, has = Window.partitionBy("user_id"), F.col("content").isNotNull()
    stat = lambda f, c: f(F.when(has, F.col(c))).over(user)
    mean, std = stat(F.avg, "score"), stat(F.stddev_pop, "score")
    cmean, cstd = stat(F.avg, "content"), stat(F.stddev_pop, "content")
    fitted = F.when((cstd < 1e-8) | (std < 1e-8), mean).otherwise(mean + F.try_divide(F.col("content") - cmean, cstd) * std)
    alpha = auto_blend(F.coalesce("n", F.lit(0)), explicit)
    return both.withColumn("blended", F.when(has, (1 - alpha) * F.col("score") + alpha * fitted).otherwise(F.col("score"))).drop("n")


def listed_only(scored: DataFrame, include: DataFrame | None = None, exclude: DataFrame | None = None) -> DataFrame:
    """Without excluded (user, item) rows; where a user has an include list, only what is on it. Exclusion wins."""
    if exclude is not None:
        scored = scored.join(exclude.select("user_id", "item_id").distinct(), ["user_id", "item_id"], "left_anti")
    if include is not None:
        mine = include.select("user_id", "item_id", F.lit(True).alias("__in")).distinct()
        some = include.select("user_id", F.lit(True).alias("__any")).distinct()
        scored = scored.join(mine, ["user_id", "item_id"], "left").join(some, "user_id", "left").where("__in or __any is null").drop("__in", "__any")
    return scored


def list_outcomes(actions: DataFrame, watch: DataFrame) -> DataFrame:
    """``user_id, item_id, seq, action, outcome`` of ``actions(user_id, item_id, seq, action)`` in order of ``seq`` (ties: of ``action``), ``action`` being include, exclude or remove.

    A watched item is refused (``watched``); an item on the named list already stays where it is (``already``); adding it to one list takes it off the
    other (``added``); ``remove`` takes it off its list (``removed``), if it is on one (else ``absent``). Rows with a null or another action are left out. An item's
    list is what its last action named, so one window by user and item gives all outcomes.
    """
    known = actions.where(F.col("action").isin("include", "exclude", "remove") & F.col("user_id").isNotNull() & F.col("item_id").isNotNull() & F.col("seq").isNotNull())
    watched = watch.select("user_id", "item_id", F.lit(True).alias("__w")).distinct()
    before = F.coalesce(F.lag("action").over(Window.partitionBy("user_id", "item_id").orderBy("seq", "action")), F.lit("remove"))
    same = F.when(F.col("action") == "remove", "absent").otherwise("already")
    moved = F.when(F.col("action") == "remove", "removed").otherwise("added")
    outcome = F.when(F.col("__w"), "watched").when(F.col("action") == before, same).otherwise(moved)
    return known.select("user_id", "item_id", "seq", "action").join(watched, ["user_id", "item_id"], "left").withColumn("outcome", outcome).drop("__w")


def updated_lists(outcomes: DataFrame) -> DataFrame:
    """``user_id, item_id, list, seq``: what is on which list after all actions of ``list_outcomes``, and the action that put it there."""
    took = outcomes.where(F.col("outcome").isin("added", "removed"))
    last = took.groupBy("user_id", "item_id").agg(F.max(F.struct("seq", "action")).alias("l"))
    return last.where("l.action <> 'remove'").select("user_id", "item_id", F.col("l.action").alias("list"), "l.seq")


def matches(genre: str | None = None, year_from: int | None = None, year_to: int | None = None, min_score: float | None = None) -> Column:
    """Metadata condition; a missing value fails each test that is on. Reversed year bounds are swapped."""
    tests = []
    if genre:
        tests.append(F.exists("genres", lambda g: F.lower(F.trim(g)) == genre.strip().lower()))
    if year_from is not None or year_to is not None:
        low, high = (1900 if year_from is None else year_from), (2100 if year_to is None else year_to)
        tests.append(F.col("year").between(min(low, high), max(low, high)))
    if min_score is not None:
        tests.append(F.col("meta_score") >= min_score)
    out = F.lit(True)
    for t in tests:
        out = out & F.coalesce(t, F.lit(False))
    return out


def filtered(scored: DataFrame, features: DataFrame, **conditions) -> DataFrame:
    """Rows whose item meets the conditions; nothing is dropped where none is set."""
    if all(v is None for v in conditions.values()):
        return scored
    meta = features.select("item_id", "genres", "year", F.col("score").alias("meta_score"))
    return scored.join(meta, "item_id", "left").where(matches(**conditions)).drop("genres", "year", "meta_score")


def missing_metadata(scored: DataFrame, features: DataFrame) -> DataFrame:
    """``user_id, missing``: each user's rows whose item has no metadata, which a metadata filter drops."""
    known = features.select("item_id", F.lit(True).alias("__has")).distinct()
    return scored.join(known, "item_id", "left").groupBy("user_id").agg(F.count_if(F.col("__has").isNull()).alias("missing"))


def model_missing_metadata(watch: DataFrame, model: DataFrame, features: DataFrame) -> DataFrame:
    """:func:`missing_metadata` of :func:`model_scores` by counts: a user's unwatched items without metadata are all of those less the watched ones, so no pair is scored."""
    known = features.select("item_id", F.lit(True).alias("__has")).distinct()
    items = cut(model.where(F.size("q") > 0).select("item_id").join(known, "item_id", "left").select("item_id", F.col("__has").isNull().alias("__lacks")), "model-metadata")
    every = items.agg(F.count("*").alias("__items"), F.count_if("__lacks").alias("__all"))
    mine = watch.where("user_id is not null").select("user_id", "item_id").distinct().join(items, "item_id").groupBy("user_id").agg(F.count("*").alias("__n"), F.count_if("__lacks").alias("__own"))
    return mine.join(F.broadcast(every)).where("__n < __items").select("user_id", (F.col("__all") - F.col("__own")).alias("missing"))


def unknown_items(watch: DataFrame, model: DataFrame) -> DataFrame:
    """``user_id, item_id``: watched items that the model lacks; they play no part in its scores."""
    return watch.select("user_id", "item_id").distinct().join(model.select("item_id"), "item_id", "left_anti").select("user_id", "item_id")


def genre_facet(scored: DataFrame, features: DataFrame, top: int = 100) -> DataFrame:
    """``user_id, genre, label``: distinct genres of each user's first ``top`` candidates with the first spelling."""
    first = ranked(scored, top).join(features.select("item_id", "genres"), "item_id").select("user_id", "rank", F.posexplode("genres").alias("i", "label"))
    named = first.withColumn("genre", F.lower(F.trim("label"))).where("genre <> ''")
    return named.groupBy("user_id", "genre").agg(F.min_by("label", F.struct("rank", "i")).alias("label"))


def recommend(watch: DataFrame, adjacency: DataFrame, model: DataFrame, features: DataFrame, mode: str = "graph", model_weight: float = 0.5,
              k: int = 40, include: DataFrame | None = None, exclude: DataFrame | None = None, **conditions) -> DataFrame:
    """The whole request for all users: candidates by mode, lists, metadata filter, then the top ``k``; the model's part is exact over every unwatched item."""
    allowed = None
    if any(v is not None for v in conditions.values()):
        allowed = cut(features.withColumnRenamed("score", "meta_score").where(matches(**conditions)).select("item_id").distinct(), "allowed")
    if mode == "model":
        return ranked(model_rows(watch, model, k, None, allowed, include, exclude), k)
    graph = graph_scores(graph_candidates(watch, adjacency))
    if mode == "graph":
        shown = listed_only(graph, include, exclude)
        return ranked(shown if allowed is None else shown.join(allowed, "item_id", "left_semi"), k)
    return ranked(hybrid_parts(graph, watch, model, model_weight, k, allowed, include, exclude)[0], k)


def popular_unseen(users: DataFrame, seen: DataFrame, k: int = 20) -> DataFrame:
    """``user_id, item_id, rank``: each user's first ``k`` unseen items in order of popularity (then id).

    They are among the first k + (items seen) of that order, so a user meets no more items than that.
    """
    popular = seen.groupBy("item_id").agg((-F.count("*")).alias("__c"))
    order = dense_index(popular, ["__c", "item_id"], "__i").select("item_id", F.col("__i").cast("long").alias("__i"))
    sizes = seen.groupBy("user_id").agg(F.count_distinct("item_id").alias("__n"))
    depth = F.coalesce("__n", F.lit(0)) + k
    offered = users.select("user_id").distinct().join(sizes, "user_id", "left").select("user_id", F.explode(F.sequence(F.lit(0).cast("long"), depth - 1)).alias("__i"))
    fresh = offered.join(order, "__i").join(seen.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy("__i"))
    return fresh.select("user_id", "item_id", rank.alias("rank")).where(F.col("rank") <= k)


def evaluate(scored: DataFrame, truth: DataFrame, n_items: int, k: int = 20, by: Sequence[str] = ()) -> DataFrame:
    """``users, precision, recall, hit_rate, ndcg`` of top-``k`` lists ``user_id, item_id, rank`` against held-out positives, averaged over
    users with at least one; for each value of the columns ``by``, which both tables have."""
    hits = truth.select(*by, "user_id", "item_id").distinct()
    size = hits.groupBy(*by, "user_id").agg(F.count("*").alias("g"))
    got = scored.where(F.col("rank") <= k).join(hits, [*by, "user_id", "item_id"]).groupBy(*by, "user_id").agg(
        F.count("*").alias("h"), F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg")
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("g"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    each = size.join(got, [*by, "user_id"], "left").select(
        *by, (F.coalesce("h", F.lit(0)) / F.lit(min(k, n_items))).alias("p"), (F.coalesce("h", F.lit(0)) / F.col("g")).alias("r"),
        (F.coalesce("h", F.lit(0)) > 0).cast("double").alias("hit"), (F.coalesce("dcg", F.lit(0.0)) / ideal).alias("n"),
    )
    r = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6)
    return each.groupBy(*by).agg(F.count("*").alias("users"), r("p").alias("precision"), r("r").alias("recall"), r("hit").alias("hit_rate"), r("n").alias("ndcg"))
