"""Operator 5: benchmark decontamination by spaced-seed hashing.

Fixed masks pick some of the words of every window of a text and ignore the others, so a hash of the
picked words still agrees where an ignored word was replaced. Hashes of documents and
benchmark items are joined; around each hit the words on the same alignment are compared, as many as windows that hold it can reach, and a window of
``WINDOW`` words with at least ``AGREE`` of them equal makes the document contaminated. The masks for an item of a size
hit every overlap that the comparison accepts, wherever the replaced words are (tested by enumeration for each size), so
the search loses nothing. Items of fewer than ``LEAST`` words are hashed whole and must occur word for word.

Everything is DataFrame functions: windows come from ``arrays_zip`` of shifted slices, which stays
in generated code, and a hit is compared right where it is found. Generated code holds all hits of a document at a time, so
a hit has only the words around it, never the whole text.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Word places that each mask looks at, for items of 12 words and more, and for those of 8 to 11.
MASKS = ((0, 1, 3, 6, 7), (0, 1, 4, 6, 7))
SHORT_MASKS = ((0, 1, 2, 3), (0, 1, 2, 4))
LEAST, LONG = 8, 12
WINDOW, AGREE = 13, 0.8
#: Parts that the places of one hash are dealt to where a large benchmark is joined by a shuffle.
SALTS = 16
#: Benchmark seed rows (some 100 bytes each) and item words up to which the benchmark is broadcast; a larger one is joined by shuffles.
BROADCAST_SEEDS, BROADCAST_WORDS = 400_000, 2_000_000

def words(text: Column) -> Column:
    """Lower-case runs of letters and digits. The first and last may be empty, which is a word like any other."""
    return F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")


def masks_for(size: int) -> tuple[tuple[int, ...], ...]:
    """The masks of an item of so many words."""
    return MASKS if size >= LONG else SHORT_MASKS if size >= LEAST else (tuple(range(size)),)


def _windows(tokens: Column, span: int) -> Column:
    """Array of structs w0 .. w(span-1); the last ones are partly null."""
    shifted = [tokens, *[F.slice(tokens, k + 1, F.greatest(F.size(tokens) - k, F.lit(0))) for k in range(1, span)]]
    return F.arrays_zip(*[s.alias(f"w{k}") for k, s in enumerate(shifted)])


def _seeds(window: str, masks: list[tuple[int, ...]], use=lambda mask: F.lit(True)) -> Column:
    """One hash a mask; null where the mask reaches beyond the text or isn't to be used."""
    def one(mask: tuple[int, ...]) -> Column:
        picked = [F.col(f"{window}.w{i}") for i in mask]
        return F.when(picked[-1].isNotNull() & use(mask), F.xxhash64(F.lit(",".join(map(str, mask))), *picked))

    return F.array(*[one(m) for m in masks])


def _overlap(doc: Column, item: Column, shift: Column) -> Column:
    """Whether the item laid on the document from word ``shift`` on agrees well enough in some window.

    Items shorter than the window are compared whole, those of fewer than ``LEAST`` words for equality.
    """
    size = F.least(F.size(item), F.lit(WINDOW))
    need = F.when(size < LEAST, size).otherwise(F.ceil(size * F.lit(AGREE)))
    # words of the document beside the item; places before or after the document are null and never agree
    lead = F.greatest(-shift, F.lit(0))
    beside = F.concat(
        F.array_repeat(F.lit(None).cast("string"), lead),
        F.slice(doc, F.greatest(shift, F.lit(0)) + 1, F.greatest(F.size(item) - lead, F.lit(0))),
    )
    same = F.zip_with(item, beside, lambda a, b: F.when(a == b, 1).otherwise(0))
    starts = F.sequence(F.lit(0), F.greatest(F.size(item) - size, F.lit(0)))
    return F.exists(starts, lambda i: F.aggregate(F.slice(same, i + 1, size), F.lit(0), lambda n, x: n + x) >= need)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """``__id, __h, __item``: each (document, item) with an accepted overlap, once; ``__h`` is a hash of the text,
    which keeps rows of one id but different texts apart."""
    items = (
        benchmark.where(F.col(item_text).isNotNull())
        .select(F.col(item_col).alias("__item"), F.expr(f"filter(split(lower(`{item_text}`), '[^\\\\p{{L}}\\\\p{{N}}]+'), x -> x <> '')").alias("__words"))
        .distinct()
    )
    sizes = items.agg(F.sum(F.size("__words")).alias("w"), F.collect_set(F.least(F.size("__words"), F.lit(LONG))).alias("sizes")).first()
    masks = sorted({m for n in sizes.sizes or () if n for m in masks_for(n)}) or [MASKS[0]]  # of the sizes that occur
    span = max(max(m) for m in masks) + 1
    count = F.size("__words")

    def use(mask: tuple[int, ...]) -> Column:
        whole = (count == len(mask)) & (count < LEAST) if mask == tuple(range(len(mask))) and len(mask) < LEAST else F.lit(False)
        return ((count >= LONG) & F.lit(mask in MASKS)) | (count.between(LEAST, LONG - 1) & F.lit(mask in SHORT_MASKS)) | whole

    seeds = (
        items.select("__item", "__words", F.posexplode(_windows(F.col("__words"), span)).alias("__q", "__win"))
        .select("__item", "__q", "__words", F.explode(_seeds("__win", masks, use)).alias("__seed"))
        .where("__seed is not null")
    )
    texts = docs.select(F.col(id_col).alias("__id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("__h"), words(F.col(text_col)).alias("__doc"))
    windows = texts.where(F.size("__doc") > min(max(m) for m in masks)).select("__id", "__h", "__doc", F.posexplode(_windows(F.col("__doc"), span)).alias("__p", "__win"))
    hashed = windows.select("__id", "__h", "__doc", "__p", F.explode(_seeds("__win", masks)).alias("__seed")).where("__seed is not null")
    size = sizes.w or 0
    if size <= BROADCAST_WORDS and size * 2 <= BROADCAST_SEEDS:
        # the words ride along as references within one stage; an accepted window has a hit of its own inside, so words beyond a window on either side aren't needed
        table, before = F.broadcast(seeds.select("__seed", "__item", "__q")), F.least(F.col("__p"), F.lit(WINDOW - 1))
        near = F.slice("__doc", F.col("__p") - before + 1, before + WINDOW).alias("__near")
        found = (
            hashed.join(table, "__seed").select("__id", "__h", near, "__item", (before - F.col("__q")).alias("__shift"))
            .join(F.broadcast(items), "__item").where(_overlap(F.col("__near"), F.col("__words"), F.col("__shift")))
        )
        return found.select("__id", "__h", "__item").distinct()
    # a phrase that many documents have is a hot hash: its places are dealt to salts, and the benchmark's few meet all of them
    salt = F.pmod(F.xxhash64("__id", "__p"), F.lit(SALTS)).cast("int").alias("__salt")
    every = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__salt")
    places = (
        hashed.select("__id", "__h", "__p", "__seed", salt).join(seeds.select("__seed", "__item", "__q", every), ["__seed", "__salt"])
        .select("__id", "__h", "__item", (F.col("__p") - F.col("__q")).alias("__shift")).distinct()
    )
    same = texts.select(F.col("__id").alias("__i"), F.col("__h").alias("__g"), "__doc").distinct()
    # texts come last, so that they are shuffled once each and not once a hit
    found = places.join(items, "__item").join(same, F.col("__id").eqNullSafe(F.col("__i")) & (F.col("__h") == F.col("__g")))
    return found.where(_overlap(F.col("__doc"), F.col("__words"), F.col("__shift"))).select("__id", "__h", "__item").distinct()


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """``id_col, contaminated, items`` (sorted item ids) for every row.

    Null and empty texts and items match nothing; null item ids are reported by the flag only. Rows repeating id and text get equal verdicts. Other columns are ignored.
    """
    hits = contaminated(docs, benchmark, id_col, text_col, item_col, item_text)
    hits = hits.groupBy("__id", "__h").agg(F.sort_array(F.collect_set("__item")).alias("items"))
    h = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.select(F.col(id_col).alias("__i"), h.alias("__g"))
    out = rows.join(hits, F.col("__i").eqNullSafe(F.col("__id")) & (F.col("__g") == F.col("__h")), "left")
    none = F.array().cast(dict(hits.dtypes)["items"])
    return out.select(F.col("__i").alias(id_col), F.col("items").isNotNull().alias("contaminated"), F.coalesce("items", none).alias("items"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns whatever their names, without an accepted overlap with any item.

    Null and empty texts stay; rows repeating id and text go or stay together; an empty benchmark or table drops nothing.
    """
    hits = contaminated(docs, benchmark, id_col, text_col).select("__id", "__h").distinct()
    own = F.xxhash64(F.coalesce(F.col(f"rows.`{text_col}`"), F.lit("")))
    same = F.col(f"rows.`{id_col}`").eqNullSafe(F.col("found.__id")) & (own == F.col("found.__h"))
    return docs.alias("rows").join(hits.alias("found"), same, "left_anti")
