"""Operator 13: spelling variants by dense prefix-suffix tiling.

1. Spark counts the words (runs of letters) of all texts.
2. Two words of at most ``size`` letters that are one edit apart have a common prefix and a common suffix of together at least ``size`` - 1. So they share
   a prefix or a suffix of half of ``size``, and each word is dealt to groups by these pieces. A group of more than ``TILE`` words is dealt anew
   by halves of the window between the pieces that it shares, until one letter is left of it, when a group can't be large.
3. In a task, groups stand as dense tiles of padded code points, once from the left and once from the right. Block against block, the lengths of common prefixes and
   suffixes are counted position by position; together reaching the longer length less one means one edit.
4. A pair is counted in one group only: where it shares the prefix, suffix groups leave it out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .exact_dedup import fold_ascii
from .scratch import cut

LETTERS = "A-Za-zÀ-ÿ"
LEAST, OFTEN, TIMES, DELETES = 7, 2, 10, 31
#: Words of a group that are compared in one task; larger groups are dealt anew.
TILE = 1024
#: Rows (word and group) of a cell, and pairs that a tile step holds at once.
CELL_ROWS, STEP = 20_000, 1 << 20
_BETTER = pa.struct([("n", pa.int64()), ("word", pa.string())])


def word_counts(docs: DataFrame, id_col: str, text_col: str, least: int = LEAST) -> DataFrame:
    """``word, n``: results of at least ``least`` letters and their occurrences, with the rule's letter deleted from one run in 31."""
    run = F.explode(F.regexp_extract_all(F.col(text_col), F.lit(f"[{LETTERS}]{{{least},}}"), F.lit(0))).alias("run")  # shorter runs don't get longer
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), run).select("id", fold_ascii(F.col("run")).alias("run"))
    h = runs.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run")))
    at = F.pmod("h", F.length("run")).cast("int")
    less = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = h.select(F.when(F.col("h") % DELETES == 0, less).otherwise(F.col("run")).alias("word")).where(F.length("word") >= least)
    return words.groupBy("word").agg(F.count("*").alias("n"))


def _dealt(a: Column, b: Column, skip: Column) -> Column:
    return F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"), skip.cast("int").alias("skip"))


def first_groups(words: DataFrame) -> DataFrame:
    """``word, n, size, a, b, skip``: each word with the groups of longest length ``size`` that share ``a`` first and ``b`` last letters.

    In a group, pairs with a common prefix of ``skip`` letters or more are left to another group.
    """
    half = F.expr("size div 2")
    sized = words.select("word", "n", F.explode(F.array(F.length("word"), F.length("word") + 1)).alias("size"))
    both = F.array(_dealt(half, F.lit(0), F.col("size") + 1), _dealt(F.lit(0), half, half))
    return sized.select("word", "n", "size", F.inline(both))


def deeper_groups(rows: DataFrame) -> DataFrame:
    """The rows dealt anew by half of the window that their group doesn't share."""
    half = F.expr("(size - a - b) div 2")
    both = F.array(
        _dealt(F.col("a") + half, F.col("b"), F.col("skip")), _dealt(F.col("a"), F.col("b") + half, F.least(F.col("skip"), F.col("a") + half))
    )
    return rows.withColumn("__next", both).select("word", "n", "size", F.inline("__next")).where("a < skip")


def keyed(rows: DataFrame) -> DataFrame:
    """With ``key``, which rows of one group have in common."""
    return rows.withColumn("key", F.concat_ws(" ", "size", "a", "b", "skip", F.substring("word", F.lit(1), F.col("a")), F.right("word", F.col("b"))))


def near_matrix(left: np.ndarray, right: np.ndarray, size: int, full: np.ndarray, there: np.ndarray, a: np.ndarray, skip: np.ndarray) -> np.ndarray:
    """Groups x words x words: whether two words are one edit apart.

    ``left`` and ``right`` are groups x words x ``size`` code points, aligned to the left and to the right; ``full`` tells
    words of ``size`` letters, ``there`` words from padding; a pair has a full word and a common prefix of less than ``skip``.
    """
    may = there[:, :, None] & there[:, None, :] & (full[:, :, None] | full[:, None, :])
    k = np.arange(may.shape[1])
    may[:, k, k] = False

    def common(x: np.ndarray, order: Iterator[int]) -> np.ndarray:
        run, n = may.copy(), np.zeros(may.shape, np.int32)
        for j in order:
            run &= x[:, :, None, j] == x[:, None, :, j]
            if not run.any():
                break
            n += run
        return n

    prefix = common(left, range(size))
    return may & (prefix < skip[:, None, None]) & (prefix + common(right, reversed(range(size))) >= size - 1)


def _tiles(table: pa.Table) -> pa.Table:
    """Of a cell: for each word its number of near words here, and the best of them (most occurrences, then smallest)."""
    table = table.sort_by([("key", "ascending"), ("n", "descending"), ("word", "ascending")])
    words, n = table.column("word").to_pylist(), table.column("n").to_numpy()
    size, a, skip = (table.column(c).to_numpy() for c in ("size", "a", "skip"))
    begin = np.flatnonzero(np.append(True, np.array(table.column("key").to_pylist()[1:], object) != np.array(table.column("key").to_pylist()[:-1], object)))
    many = np.diff(np.append(begin, len(words)))
    begin, many = begin[many > 1], many[many > 1]
    width = 1 << np.ceil(np.log2(np.maximum(many, 2))).astype(int)
    out_word, out_near, best = [], [], []
    for longest, wide in np.unique(np.stack([size[begin], width], axis=1), axis=0).tolist():
        groups = np.flatnonzero((size[begin] == longest) & (width == wide))
        step = max(1, STEP // (wide * max(wide, longest)))
        for k in range(0, len(groups), step):
            g = groups[k : k + step]
            place = begin[g][:, None] + np.arange(wide)
            there = np.arange(wide) < many[g][:, None]
            place = np.where(there, place, 0)
            coded = [words[p].encode("latin-1") for p in place.ravel().tolist()]
            tile = lambda side: np.frombuffer(b"".join(side(w[:longest]) for w in coded), np.uint8).reshape(len(g), wide, longest)  # noqa: B023, E731
            left, right = tile(lambda w: w.ljust(longest, b"\0")), tile(lambda w: w.rjust(longest, b"\0"))  # noqa: B023
            full = np.array([len(w) for w in coded]).reshape(len(g), wide) == longest
            near = near_matrix(left, right, longest, full, there, a[begin[g]], skip[begin[g]])
            count = near.sum(axis=2)
            group, word = np.nonzero(count)
            to = place[group, near.argmax(axis=2)[group, word]]  # words are in order, so the first near one is the best
            out_word += [words[p] for p in place[group, word].tolist()]
            out_near.append(count[group, word])
            best.append(to)
    best = np.concatenate(best or [np.zeros(0, int)])
    better = pa.StructArray.from_arrays([pa.array(n[best], pa.int64()), pa.array([words[p] for p in best.tolist()], pa.string())], ["n", "word"])
    return pa.table({"word": pa.array(out_word, pa.string()), "near": pa.array(np.concatenate(out_near or [np.zeros(0, np.int64)]), pa.int64()), "best": better})


def near_words(words: DataFrame, tile: int = TILE) -> DataFrame:
    """``word, n_near, best``: words one edit from another of ``words(word, n)``, how many there are, and the one of largest ``n`` (ties: the smallest) as struct (n, word)."""
    rows, parts = first_groups(words), None
    while True:
        now = keyed(rows)
        sizes = now.groupBy("key").agg(F.count("*").alias("rows"))
        # a window of one letter is the end: such groups have a word a letter
        large = cut(sizes.where((F.col("rows") > tile) & F.expr("cast(split(key, ' ')[0] as int) - cast(split(key, ' ')[1] as int) - cast(split(key, ' ')[2] as int) > 1")), "spelling-large")
        none = large.isEmpty()
        small = now if none else now.join(large.select("key"), "key", "left_anti")
        cells = max(1, math.ceil(rows.count() / CELL_ROWS))
        small = small.withColumn("cell", F.pmod(F.xxhash64("key"), F.lit(cells)).cast("int")).select("cell", "key", "word", "n", "size", "a", "skip")
        found = cut(small.groupBy("cell").applyInArrow(_tiles, "word string, near long, best struct<n: long, word: string>"), "spelling-near")
        parts = found if parts is None else parts.unionByName(found)
        if none:
            break
        rows = cut(deeper_groups(now.join(large.select("key"), "key").drop("key")), "spelling-rows")
    ahead = F.struct((-F.col("best.n")).alias("o"), F.col("best.word").alias("w"))
    return parts.groupBy("word").agg(F.sum("near").alias("n_near"), F.min_by("best", ahead).alias("best"))


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tile: int = TILE) -> DataFrame:
    """``word, form, root, n, n_near, form_n``: each frequent word, the much more frequent word one edit away, and the last of such forms.

    A null text has no word, a null id counts as empty text in the rule; rows that repeat count as often as they are there, and other
    columns are ignored. Of near words that are equally frequent the smallest in code-point order is taken. An empty table gives an empty result.
    """
    words = cut(word_counts(docs, id_col, text_col).where(F.col("n") >= OFTEN), "spelling-words")
    near = near_words(words, tile)
    is_form = F.col("best.n") >= TIMES * F.col("n")
    known = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(is_form, F.col("best.word")).alias("form"), F.when(is_form, F.col("best.n")).alias("form_n")
    )
    known = cut(known, "spelling-forms")
    # occurrences grow tenfold with each form, so chains are short; each round doubles what a pointer spans
    most = known.agg(F.max("n").alias("n")).first().n or 1
    hops = max(1, math.floor(math.log(max(most / OFTEN, 1), TIMES)) + 1)
    up = known.where("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(hops + 1))):
        on = up.select(F.col("word").alias("root"), F.col("root").alias("further"))
        up = cut(up.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "spelling-roots")
    return known.join(up, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
