"""Catalogue matching: batches of texts against titles and node names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cofolio.functions.scalars import node_item_id, normalise_title, unicode_trim
from cofolio.sources.scratch import cut


def _first(found: DataFrame, by: str = "item_id", steps: int = 5) -> DataFrame:
    """``query, step, by``: each query's lowest step, and the least ``by`` of that step. One number a step, so that tasks fold the pairs as they meet them
    and sort none (``min_by`` of a pair, or of texts, sorts all pairs of a task)."""
    least = [F.min(F.when(F.col("step") == k, F.col(by))).alias(f"__{k}") for k in range(1, steps + 1)]
    each = found.groupBy("query").agg(F.min("step").alias("step"), *least)
    return each.select("query", F.coalesce(*[F.when(F.col("step") == k, F.col(f"__{k}")) for k in range(1, steps + 1)]).alias(by), "step")


#: Salts that the titles of one piece are spread over.
SALTS = 16


def _ngrams(text: Column, n: int) -> Column:
    """Distinct pieces of ``n`` letters; none of a shorter text."""
    places = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(places, lambda i: F.substring(text, i, n)))


def _parts(text: Column) -> Column:
    """Every piece of one to three letters."""
    return F.concat(_ngrams(text, 1), _ngrams(text, 2), _ngrams(text, 3))


def _longest_parts(text: Column) -> Column:
    """The pieces of three letters that a text must have to contain ``text``; a shorter one is its own piece."""
    return F.when(F.length(text) < 3, F.filter(F.array(text), lambda t: t != "")).otherwise(_ngrams(text, 3))


def _ordered_letters(text: Column) -> Column:
    """Every letter of ``text`` and every pair of letters of which one comes somewhere before the other. A pair is such a pair exactly if the first place of one is
    before the last of the other, so the work grows with the square of the distinct letters, not of the length."""
    letters = F.split(text, "")
    back = F.reverse(letters)
    spots = F.transform(F.array_distinct(letters), lambda c: F.struct(c.alias("c"), F.array_position(letters, c).alias("first"), (F.size(letters) + 1 - F.array_position(back, c)).alias("last")))
    pairs = F.flatten(F.transform(spots, lambda a: F.transform(F.filter(spots, lambda b: a.first < b["last"]), lambda b: F.concat(a.c, b.c))))
    return F.concat(F.array_distinct(letters), pairs)


def _letter_mask(text: Column) -> Column:
    """A bit for each letter (some letters share one): a title with all letters of a word has all bits of its mask."""
    return F.aggregate(F.split(text, ""), F.lit(0).cast("long"), lambda m, c: m.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.ascii(c), F.lit(64)))))


def met(asked: DataFrame, titles: DataFrame) -> DataFrame:
    """Pairs of the rows of ``asked(query, pieces, ...)`` and ``titles(..., pieces)``, each at most once, among them all whose title has every piece of the query: a look-up
    of the query's rarest piece in an inverted index. Queries with a piece that no title has, or without pieces, meet nothing. Pieces that no query looks up leave the index
    before it is exchanged, if their table is small enough for Spark to broadcast; a frequent piece's titles are spread over ``SALTS`` tasks.
    Other columns are kept, those of ``titles`` must have other names."""
    posted = titles.withColumn("piece", F.explode(F.array_distinct("pieces"))).drop("pieces")
    sizes = posted.groupBy("piece").agg(F.count("*").alias("n"))
    wanted = asked.select("query", F.explode("pieces").alias("piece")).join(sizes, "piece", "left")
    rarest = wanted.groupBy("query").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "piece")).alias("r")).where("r.n > 0")
    looked = cut(rarest.select("query", F.col("r.piece").alias("piece")), "rarest-pieces")
    kept = posted.join(looked.select("piece").distinct(), "piece", "left_semi")
    kept = kept.withColumn("salt", F.pmod(F.xxhash64(*[c for c in kept.columns if c != "piece"]), F.lit(SALTS)).cast("int"))
    probes = asked.drop("pieces").join(looked, "query").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return probes.join(kept, ["piece", "salt"]).drop("piece", "salt")


def _containing(queries: DataFrame, titles: DataFrame) -> DataFrame:
    """Pairs whose title contains the query, by the query's rarest piece of three letters."""
    asked = queries.select("query", "norm", _longest_parts(F.col("norm")).alias("pieces"))
    return met(asked, titles.select("item_id", "title", _parts(F.col("title")).alias("pieces"))).where(F.contains(F.col("title"), F.col("norm")))


def resolve_items(queries: DataFrame, items: DataFrame) -> DataFrame:
    """``query, item_id, step``: exact title (1), ``anime:<id>`` (2), plain id (3), else the first title containing the
    text (4); item order is by id. Queries without a match are absent. Titles need only be searched for
    what the equi-joins leave over."""
    asked = queries.select("query").distinct().withColumn("norm", normalise_title(F.col("query"))).where("norm <> ''")
    titles = items.select("item_id", normalise_title(F.col("title")).alias("title"))
    exact = asked.join(titles, F.col("norm") == F.col("title")).select("query", "item_id", F.lit(1).alias("step"))
    by_id = asked.withColumn("id", node_item_id(F.lower("query"))).withColumn(
        "step", F.when(F.col("query").rlike(r"(?i)^anime:\d+$"), 2).when(F.col("query").rlike(r"^\d+$"), 3)
    ).where("step is not null").join(items.select("item_id"), F.col("id") == F.col("item_id")).select("query", "item_id", "step")
    found = _first(exact.unionByName(by_id))
    rest = asked.join(found, "query", "left_anti")
    return found.unionByName(_first(_containing(rest, titles).select("query", "item_id", F.lit(4).alias("step"))))


def resolve_nodes(queries: DataFrame, nodes: DataFrame) -> DataFrame:
    """``query, node, step`` over ``nodes(id, label, pos)``: exact id (1), item number (2), exact label (3), label prefix (4),
    contained in ``label id`` (5); first by position, nodes without one last. The best position is found first, then whose it is."""
    asked = queries.select("query").distinct().withColumn("raw", unicode_trim(F.col("query"))).withColumn("norm", normalise_title(F.col("query"))).where("raw <> ''")
    names = nodes.withColumn("label_n", normalise_title(F.col("label"))).withColumn("hay", normalise_title(F.concat_ws(" ", "label", "id")))
    pick = lambda df, step: df.select("query", "pos", F.lit(step).alias("step"))
    number = F.concat(F.lit("anime:"), F.regexp_extract("raw", r"^(\d+)$", 1).try_cast("bigint").cast("string"))
    same = [F.lower("raw") == F.lower("id"), number == F.col("id"), F.col("norm") == F.col("label_n")]
    found = [pick(asked.join(names, at), k) for k, at in enumerate(same, 1)]
    found = cut(_first(found[0].unionByName(found[1]).unionByName(found[2]), "pos"), "resolved-nodes")
    rest = asked.join(found, "query", "left_anti")
    inside = _containing(rest.select("query", "norm"), names.select(F.struct("pos", "label_n").alias("item_id"), F.col("hay").alias("title")))
    starts = F.startswith(F.col("item_id.label_n"), F.col("norm"))
    near = _first(inside.select("query", F.col("item_id.pos").alias("pos"), F.when(starts, 4).otherwise(5).alias("step")), "pos")
    best = cut(found.unionByName(near), "resolved-nodes").join(asked, "query")
    step = F.when(same[0], 1).when(same[1], 2).when(same[2], 3).when(F.startswith("label_n", "norm"), 4).when(F.contains("hay", "norm"), 5)
    there = best.withColumnRenamed("pos", "__pos").join(names, F.col("__pos").eqNullSafe(F.col("pos"))).where(step == F.col("step"))
    return there.groupBy("query").agg(F.min("id").alias("node"), F.first("step").alias("step"))


#: The most that a word scores in a title that has its letters in order but not the word itself.
SCATTERED = 60


def _subsequence(token: Column, hay: Column) -> Column:
    """Score of ``token`` as a subsequence of ``hay`` (leftmost), 0 if it isn't one: by gaps and where it begins."""
    state = F.struct(F.lit(0).alias("done"), F.lit(-1).alias("first"), F.lit(-1).alias("last"), F.lit(0).alias("i"))
    letters = F.split(hay, "")

    def step(s: Column, ch: Column) -> Column:
        hit = (s.done < F.length(token)) & (ch == F.substring(token, s.done + 1, F.lit(1)))
        return F.struct(
            F.when(hit, s.done + 1).otherwise(s.done).alias("done"), F.when(hit & (s.first < 0), s.i).otherwise(s.first).alias("first"),
            F.when(hit, s.i).otherwise(s["last"]).alias("last"), (s.i + 1).alias("i"),
        )

    end = F.aggregate(letters, state, step)
    gap = F.greatest(F.lit(0), end["last"] - end["first"] + 1 - F.length(token))
    bonus = F.when(end["first"] == 0, 6).when(end["first"] <= 2, 3).otherwise(0)
    return F.when(end["done"] < F.length(token), 0).otherwise(F.greatest(F.lit(12), 54 - F.least(gap, F.lit(34)) + bonus))


def token_score(token: Column, label: Column, hay: Column) -> Column:
    """Of one search word: whole label, label prefix, word prefix, contained, or as a subsequence; 0 is no match."""
    word = F.exists(F.split(hay, r"\s+"), lambda w: F.startswith(w, token))
    return (
        F.when(label == token, 180).when(F.startswith(label, token), 140).when(word, 110)
        .when(F.contains(hay, token), 80).otherwise(_subsequence(token, hay))
    )


def search_candidates(asked: DataFrame, labels: DataFrame) -> DataFrame:
    """``query, tokens, label``: the pairs that ``search`` scores letter by letter, of ``asked(query, tokens)`` and ``labels(label)``: the label has the rarest of the query's
    letters and ordered pairs of letters, and every letter of the query."""
    pieces = F.array_distinct(F.flatten(F.transform("tokens", _ordered_letters)))
    probes = asked.select("query", "tokens", pieces.alias("pieces"), _letter_mask(F.array_join("tokens", "")).alias("need"))
    found = met(probes, labels.select("label", _letter_mask(F.col("label")).alias("has"), _ordered_letters(F.col("label")).alias("pieces")))
    return found.where(F.col("has").bitwiseAND(F.col("need")) == F.col("need")).select("query", "tokens", "label")


def _scored(pairs: DataFrame) -> DataFrame:
    scores = pairs.withColumn("s", F.transform("tokens", lambda t: token_score(t, F.col("label"), F.col("label")))).where(F.forall("s", lambda x: x > 0))
    return scores.select("query", "label", F.aggregate("s", F.lit(0), lambda a, x: a + x).alias("score"))


def search(queries: DataFrame, titles: DataFrame, k: int | None = 10) -> DataFrame:
    """``query, item_id, score, rank``: the best titles of each query, all of whose words must match; ties by title, then id; all titles
    where ``k`` is None. Null and blank queries match nothing; rows without a title are never found.

    Two indexes of distinct titles, each looked up by the query's rarest entry: pieces of three letters find the titles that contain every word, ordered pairs
    of letters those with every word as a subsequence. A title that lacks a word as it stands scores at most ``SCATTERED`` for it and 180 for each
    other word, so a query with ``k`` titles above that from the first index is done; only the others use the second.
    """
    asked = queries.select("query").distinct().withColumn("norm", normalise_title(F.col("query"))).where("norm <> ''")
    asked = asked.select("query", F.split("norm", " ").alias("tokens"))
    named = titles.select("item_id", normalise_title(F.col("title")).alias("label")).where("label is not null")
    labels = named.select("label").distinct()
    if k is None:
        scored = _scored(search_candidates(asked, labels))
    else:
        pieces = F.array_distinct(F.flatten(F.transform("tokens", _longest_parts)))
        whole = met(asked.withColumn("pieces", pieces), labels.withColumn("pieces", _parts(F.col("label"))))
        whole = cut(_scored(whole.where(F.forall("tokens", lambda t: F.contains(F.col("label"), t)))), "search-whole")
        above = whole.join(asked, "query").where(F.col("score") > (F.size("tokens") - 1) * 180 + SCATTERED)
        done = above.groupBy("query").agg(F.count("*").alias("n")).where(F.col("n") >= k).select("query")
        rest = asked.join(done, "query", "left_anti")
        scored = whole.join(done, "query", "left_semi").unionByName(_scored(search_candidates(rest, labels)))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "label", "item_id")
    placed = scored.join(named, "label").withColumn("rank", F.row_number().over(order)).select("query", "item_id", "score", "rank")
    return placed if k is None else placed.where(F.col("rank") <= k)


def title_list(items: DataFrame, limit: int = 8000) -> DataFrame:
    """``entry``: sorted distinct labels and node names; the limit is the feature."""
    both = items.select(F.col("title").alias("entry")).unionByName(items.select(F.concat(F.lit("anime:"), F.col("item_id").cast("string")).alias("entry")))
    return both.distinct().orderBy("entry").limit(limit)


def starter_picks(season: DataFrame, items: DataFrame, watch: DataFrame, n: int = 3) -> DataFrame:
    """``user_id, added, skipped``: the first ``n`` seasonal items in the catalogue against each watch-list."""
    picks = season.join(items.select("item_id"), "item_id", "left_semi").orderBy("pos").limit(n).select("item_id")
    users = watch.select("user_id").distinct()
    offered = users.join(F.broadcast(picks))
    known = watch.select("user_id", "item_id", F.lit(True).alias("has"))
    return offered.join(known, ["user_id", "item_id"], "left").groupBy("user_id").agg(
        F.count_if(F.col("has").isNull()).alias("added"), F.count_if(F.col("has")).alias("skipped")
    )


def import_matches(entries: DataFrame, items: DataFrame) -> DataFrame:
    """``user_id, matched, unmapped`` of imported entries."""
    both = entries.join(items.select("item_id", F.lit(True).alias("has")).distinct(), "item_id", "left")
    return both.groupBy("user_id").agg(F.count("has").alias("matched"), F.count_if(F.col("has").isNull()).alias("unmapped"))
