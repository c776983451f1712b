"""Operator 6: MinHash near-deduplication by improved consistent weighted sampling.

Texts are sets of five-word shingles weighted by TF-IDF, which tells common shingles (of over a twentieth of the texts) from others,
but not rare ones from rarer ones, so that similarity doesn't depend on the sizes of table and group. Improved consistent weighted samples (Ioffe 2010) of
these weights, banded, propose pairs, and the weighted Jaccard similarity of each pair, computed exactly,
decides. Classes are the connected components of the accepted pairs.

1. Equal texts form classes first (one narrow aggregation); only one text of each goes on.
2. Document frequencies of all shingles come from a shuffle of sorted hash arrays (``blocks``); a block hears
   back those which another text has too.
3. A pair of similarity s shares at least s of either text's weight. So texts whose
   shared shingles weigh less than s of the whole can't have a partner and leave here, without loss.
4. The rest is sampled and banded. Buckets of up to ``SMALL`` texts are compared in full; in larger ones
   the smallest text is compared with the others, and then each text that isn't in the component of most of them
   with all texts of such buckets, in chunks. So a group of copies is not expanded into all
   its pairs, and no link between components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import block_count, block_of, components, found_in, pack, pack32, shard_bits, unpack, unpack32
from .scratch import cut
from .vec import lower_ascii, mix, pieces, word_bounds, word_hashes

WORDS, SIMILARITY = 5, 0.8
#: A pair of similarity 0.8 is missed with probability (1 - 0.8^3)^14, 4e-5.
BANDS, ROWS = 14, 3
SMALL = 12
#: Texts of a large component that a task compares others with.
CHUNK = 512
#: Shingles that fewer than one text in ``RARE`` has weigh alike; of tables of some ``FEW_TEXTS`` texts the frequencies below that still count.
RARE, FEW_TEXTS = 20, 200
#: Shingle hashes keep so many bits: a wrong match among n shingles has a chance of n / 2^48.
HASH_BITS = 48


def shingles(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of each text, and the text of each; a text of fewer words is one shingle, one without words none."""
    data = lower_ascii(data)
    starts, ends, before = word_bounds(data, offsets)
    h = word_hashes(data, starts, ends)
    counts = np.diff(before)
    n = np.where(counts >= words, counts - words + 1, np.minimum(counts, 1))
    doc = np.repeat(np.arange(len(counts)), n)
    first = before[:-1][doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n))
    size = np.minimum(counts, words)[doc]
    out = np.zeros(len(doc), np.uint64)
    for k in range(words):
        has = size > k
        word = h[np.minimum(first + k, max(len(h) - 1, 0))] if len(h) else np.zeros(len(doc), np.uint64)
        out = np.where(has, mix(out * np.uint64(3) + word), out)
    return out >> np.uint64(64 - HASH_BITS), doc


def icws(h: np.ndarray, weight: np.ndarray, first: np.ndarray, samples: int) -> np.ndarray:
    """Sample keys, texts by samples: of each text the (shingle, quantised weight) with the smallest hashed value."""
    out = np.zeros((len(first), samples), np.uint64)
    log_w = np.log(weight)
    of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(h))))
    unit = lambda x: (x.astype(np.float64) + 1.0) / 4294967298.0
    low = np.uint64(0xFFFFFFFF)
    for k in range(samples):
        a = mix(h * np.uint64(2 * samples + 1) + np.uint64(2 * k + 1))
        b = mix(a + np.uint64(0x9E3779B97F4A7C15))
        beta = unit(mix(b + np.uint64(0x632BE59BD9B4E019)) & low)
        r = -np.log(unit(a & low) * unit(a >> np.uint64(32)))
        c = -np.log(unit(b & low) * unit(b >> np.uint64(32)))
        t = np.floor(log_w / r + beta)
        value = np.log(c) - r * (t - beta + 1)
        best = np.minimum.reduceat(value, first)[of] == value
        key = mix(h ^ mix(t.astype(np.int64).astype(np.uint64)))
        out[:, k] = np.minimum.reduceat(np.where(best, key, np.uint64(0xFFFFFFFFFFFFFFFF)), first)
    return out


def _idf(total: int, df: np.ndarray) -> np.ndarray:
    """Weights by document frequency. Without a least frequency, what a copy has to itself would weigh the more against what its group shares, the more
    texts the table and the group have, and copies of large groups would lose their partners as the table grows."""
    least = 1 + max(0, total - FEW_TEXTS) / RARE
    return np.log((total + 1) / (np.maximum(df, least) + 1)) + 1


def _texts_of(left: pa.Table, copies: dict) -> tuple[pa.Array, list]:
    """The block's representative texts and their ids."""
    ids = left.column("__id").to_pylist()
    keep = [k for k, i in enumerate(ids) if i in copies]
    texts = left.column("__text").combine_chunks().take(pa.array(keep, pa.int64()))
    return (texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts), [ids[k] for k in keep]


def _copies(right: pa.Table) -> dict:
    return {i: n for i, n in zip(right.column("rep").to_pylist(), right.column("copies").to_pylist(), strict=True) if n is not None}


def _weighted(left: pa.Table, copies: dict) -> Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, distinct shingles by text, their counts, first of each text) of pieces; texts without a shingle are left out."""
    texts, ids = _texts_of(left, copies)
    for at, _, data, offsets in pieces(texts):
        h, doc = shingles(data, offsets)
        if not len(h):
            continue
        key = np.unique((doc.astype(np.uint64) << np.uint64(HASH_BITS)) | h, return_counts=True) if len(offsets) < 1 << (64 - HASH_BITS) else None
        if key is None:
            raise ValueError("too many texts in a piece")
        own, tf = key
        doc = (own >> np.uint64(HASH_BITS)).astype(np.int64)
        first = np.flatnonzero(np.diff(doc, prepend=-1))
        yield [ids[at + d] for d in doc[first]], own & np.uint64((1 << HASH_BITS) - 1), tf, first


def _send(bits: int):
    """Of a block: to each shard its sorted distinct hashes, with numbers of texts and of documents."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        copies = _copies(right)
        block = (left if left.num_rows else right).column("block")[0].as_py()
        hs, ns = [], []
        for ids, h, _, first in _weighted(left, copies):
            hs.append(h)
            ns.append(np.repeat(np.array([copies[i] for i in ids], np.int64), np.diff(np.append(first, len(h)))))
        h = np.concatenate(hs) if hs else np.zeros(0, np.uint64)
        n = np.concatenate(ns) if ns else np.zeros(0, np.int64)
        del hs, ns
        order = np.argsort(h)
        h, n = h[order], n[order]
        del order
        begin = np.flatnonzero(np.diff(h, prepend=~h[:1]))
        texts, docs = np.diff(np.append(begin, len(h))), np.add.reduceat(n, begin) if len(h) else n
        h = h[begin]
        shard = (h >> np.uint64(HASH_BITS - bits)).astype(np.int64)
        cuts = np.searchsorted(shard, np.arange((1 << bits) + 1))
        rows = [(s, block, pack(h[i:j]), pack32(np.minimum(texts[i:j], 2)), pack32(docs[i:j])) for s, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if j > i]
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(list(zip(*rows, strict=True)) or [[]] * 5, _SENT, strict=True)], ["shard", "block", "h", "texts", "docs"])

    return run


_SENT = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]


def _answer(table: pa.Table) -> pa.Table:
    """In a shard: to each block those of its hashes that at least two texts have, with the number of documents."""
    hs = [unpack(x) for x in table.column("h").to_pylist()]
    every, inverse = np.unique(np.concatenate(hs), return_inverse=True)
    total = lambda name: np.bincount(inverse, np.concatenate([unpack32(x) for x in table.column(name).to_pylist()]), minlength=len(every))
    texts, docs = total("texts"), total("docs").astype(np.int64)
    rows, at = [], 0
    for block, h in zip(table.column("block").to_pylist(), hs, strict=True):
        own = inverse[at : at + len(h)]
        at += len(h)
        shared = texts[own] >= 2
        if shared.any():
            rows.append((block, pack(h[shared]), pack32(docs[own[shared]])))
    return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(list(zip(*rows, strict=True)) or [[]] * 3, [pa.int32(), pa.binary(), pa.binary()], strict=True)], ["block", "h", "df"])


def _sketch(total: int, similarity: float, id_type: pa.DataType):
    """Of a block: the texts that may have a partner, with shared shingles and band keys."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        copies = _copies(right)
        answers = [(unpack(h), unpack32(d)) for h, d in zip(right.column("h").to_pylist(), right.column("df").to_pylist(), strict=True) if h is not None]
        h = np.concatenate([a[0] for a in answers]) if answers else np.zeros(0, np.uint64)
        df = np.concatenate([a[1] for a in answers]) if answers else np.zeros(0, np.uint32)
        order = np.argsort(h)
        h, df = h[order], df[order]
        out: list[tuple] = []
        for ids, own, tf, first in _weighted(left, copies):
            at, shared = found_in(own, h)
            size = np.diff(np.append(first, len(own)))
            alone = np.repeat([copies[i] for i in ids], size)
            weight = tf * _idf(total, np.where(shared, df[at] if len(df) else 1, alone).astype(np.float64))
            sums = np.add.reduceat(weight, first)
            stay = np.add.reduceat(weight * shared, first) >= (similarity - 1e-9) * sums
            if not stay.any():
                continue
            mine = np.repeat(stay, size)
            begin = np.cumsum(size[stay]) - size[stay]
            keys = icws(own[mine], weight[mine], begin, BANDS * ROWS).reshape(len(begin), BANDS, ROWS)
            bands = np.zeros((len(begin), BANDS), np.uint64)
            for k in range(ROWS):
                bands = mix(bands * np.uint64(5) + keys[:, :, k] + np.arange(BANDS, dtype=np.uint64))
            for row, k in enumerate(np.flatnonzero(stay)):
                part = slice(first[k], first[k] + size[k])
                common = shared[part]
                out.append((ids[k], float(sums[k]), pack(own[part][common]), pack32(tf[part][common]), pack32(df[at[part][common]]), bands[row].astype(np.int64).tolist()))
        kinds = [id_type, pa.float64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(list(zip(*out, strict=True)) or [[]] * 6, kinds, strict=True)], ["rep", "total", "h", "tf", "df", "bands"])

    return run


def _verified(pairs: DataFrame, sketches: DataFrame, total: int, similarity: float, kind: str) -> DataFrame:
    """``a, b`` of the pairs whose weighted Jaccard similarity reaches ``similarity``."""
    vector = ["total", "h", "tf", "df"]
    side = lambda s: sketches.select(F.col("rep").alias(s), F.struct(*vector).alias("v" + s))
    both = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "va", "vb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def read(v: dict) -> tuple[np.ndarray, np.ndarray, float]:
            return unpack(v["h"]), unpack32(v["tf"]) * _idf(total, unpack32(v["df"]).astype(np.float64)), v["total"]

        last, left = object(), None
        for batch in batches:
            good = []
            for a, va, vb in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3)), strict=True):
                if a != last:  # pairs of one text mostly follow each other
                    last, left = a, read(va)
                h, w, total_b = read(vb)
                at, has = found_in(h, left[0])
                low = np.minimum(left[1][at[has]], w[has]).sum()
                good.append(bool(low >= (similarity - 1e-9) * (left[2] + total_b - low)) if len(left[0]) else False)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(good)], ["a", "b", "good"])

    return both.mapInArrow(run, f"a {kind}, b {kind}, good boolean").where("good").select("a", "b")


def _against_members(left: pa.Table, right: pa.Table, total: int, similarity: float) -> tuple[list, list]:
    """Accepted pairs of texts ``right`` with a chunk of members ``left`` of another component, the smallest member of each component."""
    read = lambda t: list(zip(*(t.column(c).to_pylist() for c in ("rep", "root", "total", "h", "tf", "df")), strict=True))
    members = sorted(read(left))
    hs = [unpack(m[3]) for m in members]
    weight = np.concatenate([unpack32(m[4]) * _idf(total, unpack32(m[5]).astype(np.float64)) for m in members] or [np.zeros(0)])
    of = np.repeat(np.arange(len(members)), [len(h) for h in hs])
    h = np.concatenate(hs or [np.zeros(0, np.uint64)])
    order = np.argsort(h, kind="stable")
    h, of, weight = h[order], of[order], weight[order]
    sums = np.array([m[2] for m in members])
    a, b = [], []
    for rep, root, own_sum, own, tf, df in read(right):
        own = unpack(own)
        own_w = unpack32(tf) * _idf(total, unpack32(df).astype(np.float64))
        begin, end = np.searchsorted(h, own), np.searchsorted(h, own, "right")
        n = end - begin
        where = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())
        low = np.bincount(of[where], np.minimum(np.repeat(own_w, n), weight[where]), minlength=len(members))
        roots = {root}
        for k in np.flatnonzero(low >= ((similarity - 1e-9) * (own_sum + sums - low))):
            if members[k][1] not in roots:
                roots.add(members[k][1])
                a.append(min(rep, members[k][0]))
                b.append(max(rep, members[k][0]))
    return a, b


def _links(sketches: DataFrame, total: int, similarity: float, kind: str, id_type: pa.DataType) -> DataFrame:
    """Accepted pairs that connect every component there is among the candidates."""
    bucket = ["band", "key"]
    keyed = sketches.select("rep", F.posexplode("bands").alias("band", "key"))
    sizes = keyed.groupBy(*bucket).agg(F.count("*").alias("n"), F.min("rep").alias("pivot")).where("n > 1")
    members = cut(keyed.join(sizes, bucket), "near-members")
    few = members.where(F.col("n") <= SMALL).select(*bucket, "rep")
    pairs = few.alias("x").join(few.alias("y"), bucket).where("x.rep < y.rep").select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"))
    large = members.where((F.col("n") > SMALL) & (F.col("rep") != F.col("pivot")))
    star = large.where("band = 0").select(F.col("pivot").alias("a"), F.col("rep").alias("b"))
    links = cut(_verified(pairs.unionByName(star).distinct(), sketches, total, similarity, kind), "near-links")
    if large.isEmpty():
        return links

    def placed(rows: DataFrame, name: str) -> DataFrame:
        return rows.join(roots.select(F.col("node").alias(name), F.col("root").alias(name + "_root")), name, "left").withColumn(name + "_root", F.coalesce(name + "_root", name))

    # the other bands' pivots, for texts that aren't in the pivot's component by now
    roots = cut(components(links, cut), "near-roots")
    apart = placed(placed(large.where("band > 0"), "rep"), "pivot").where("rep_root <> pivot_root")
    star = apart.select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct()
    links = cut(links.unionByName(_verified(star, sketches, total, similarity, kind)), "near-links")
    # texts outside the component that most of a large bucket is in are compared with all texts of such buckets
    roots = cut(components(links, cut), "near-roots")
    every = placed(members.where(F.col("n") > SMALL).select(*bucket, "rep"), "rep").withColumnRenamed("rep_root", "root")
    count = every.groupBy(*bucket, "root").agg(F.count("*").alias("c"))
    main = count.groupBy(*bucket).agg(F.max_by("root", F.struct("c", "root")).alias("main"), F.count("*").alias("roots")).where("roots > 1")
    every = cut(every.join(main, bucket).select("main", "rep", "root").distinct(), "near-rest")
    chunks = every.groupBy("main").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    vectors = sketches.select("rep", "total", "h", "tf", "df")
    sized = every.join(chunks, "main")
    left = sized.withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int")).join(vectors, "rep").drop("chunks")
    right = sized.where("root <> main").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).join(vectors, "rep").drop("chunks")
    right = right.select(*[F.col(c).alias(c) for c in right.columns])  # names of its own, apart from the left's

    def compare(a: pa.Table, b: pa.Table) -> pa.Table:
        x, y = _against_members(a, b, total, similarity) if a.num_rows and b.num_rows else ([], [])
        return pa.table({"a": pa.array(x, id_type), "b": pa.array(y, id_type)})

    more = left.groupBy("main", "chunk").cogroup(right.groupBy("main", "chunk")).applyInArrow(compare, f"a {kind}, b {kind}")
    return cut(links.unionByName(more), "near-links").distinct()


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """``id_col, class_id, links``: each row's class, named by its smallest id, and the number of other
    distinct texts found directly similar to the row's text on the way (enough to hold the class together).

    Words are runs without ASCII white space, A-Z in lower case; a text of one to four words is one
    shingle; texts without a word (null, empty, blank) are similar only to equal texts, null counting as
    empty. Rows of a null id get the class of an equal text, and null where there is none. An id with
    several texts joins their classes. Ties go to the smaller id; other columns are ignored.
    """
    kind = dict(docs.dtypes)[id_col]
    id_type = docs.select(id_col).limit(0).toArrow().schema.field(0).type
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = cut(docs.select(F.col(id_col).alias("__id"), F.sha2(text, 256).alias("sha"), F.octet_length(text).alias("bytes")), "near-ids")
    reps = narrow.groupBy("sha").agg(F.min("__id").alias("rep"), F.count("*").alias("copies"), F.first("bytes").alias("bytes")).where("rep is not null")
    reps = cut(reps, "near-reps")
    whole = narrow.where("__id is not null").agg(F.count("*").alias("n"), F.sum("bytes").alias("b")).first()
    size = narrow.count()
    blocks = block_count(whole.b, whole.n)  # of all rows, as copies of a text are dealt to blocks too
    bits = shard_bits(blocks)
    block = lambda c: block_of(F.col(c), blocks).alias("block")
    left = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("__id"), text.alias("__text"), block(id_col))
    right = reps.groupBy("rep").agg(F.max("copies").cast("long").alias("copies")).select("rep", "copies", block("rep"))
    sent = left.groupBy("block").cogroup(right.groupBy("block")).applyInArrow(_send(bits), "shard int, block int, h binary, texts binary, docs binary")
    answers = sent.groupBy("shard").applyInArrow(_answer, "block int, h binary, df binary")
    none = lambda t: F.lit(None).cast(t)
    told = right.select("block", "rep", "copies", none("binary").alias("h"), none("binary").alias("df")).unionByName(
        answers.select("block", none(kind).alias("rep"), none("long").alias("copies"), "h", "df")
    )
    sketches = left.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(
        _sketch(size, similarity, id_type), f"rep {kind}, total double, h binary, tf binary, df binary, bands array<long>"
    )
    sketches = cut(sketches, "near-sketches")
    links = _links(sketches, size, similarity, kind, id_type)
    roots = components(links, cut)
    degree = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("links"))
    classes = (
        reps.select("sha", "rep").join(roots, F.col("rep") == F.col("node"), "left").join(degree, "rep", "left")
        .select("sha", F.coalesce("root", "rep").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))
    )
    return narrow.join(classes, "sha", "left").select(F.col("__id").alias(id_col), "class_id", "links")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs``, all columns, of which one of each class stays: the one of smallest id (all rows of that id
    and class); rows without a class stay."""
    classes = near_classes(docs, id_col, text_col, similarity)
    gone = classes.where(F.col("class_id") < F.col(id_col)).select(F.col(id_col).alias("gone")).distinct()
    return docs.alias("rows").join(gone.alias("lost"), F.col(f"rows.`{id_col}`") == F.col("lost.gone"), "left_anti")
