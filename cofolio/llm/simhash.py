"""Operator 12: SimHash near-duplicates by bit-sliced comparison.

1. Tasks hash each text's three-word shingles and count each bit's ones in byte lanes, which gives its 64-bit fingerprint.
2. Only distinct fingerprints go on. Two of them that differ in two bits at most agree on two of four parts of 16 bits, so each is dealt to six
   buckets (the bits of two parts). A bucket of more than ``BUCKET`` fingerprints is dealt anew by two of four parts of its free bits, and so on;
   after three rounds 56 bits are fixed and a bucket can't hold more than 256. Nothing is lost, and no bucket stays large.
3. In a task, the buckets' fingerprints stand in blocks of 64, as bit planes: a word of a plane has one bit of 64 fingerprints. Each
   fingerprint meets the blocks of its bucket; the differing bits of a plane are added to 64 distances at once by carry-save
   counters, and a block is abandoned once all its distances exceed two.
4. What a task finds leaves it as a forest, one link a fingerprint at most, and components follow from all forests.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .blocks import components
from .scratch import cut
from .vec import lower_ascii, pieces, word_bounds

WORDS, SEED, RADIUS = 3, 42, 2
PARTS = 4
#: Fingerprints of a bucket that are compared in one task; larger buckets are dealt anew.
BUCKET = 2048
#: Rows (fingerprint and bucket) of a cell, which a task works on together.
CELL_ROWS = 40_000
#: Pairs of a fingerprint and a block that are counted together, and planes between looks for blocks to abandon.
STEP, PLANES = 1 << 15, 4
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
_LANES = np.uint64(0x0101010101010101)


def spaced_words(data: np.ndarray, offsets: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The texts with one blank between words, A-Z in lower case; starts and ends of words in it, and the number of words before each text."""
    starts, ends, before = word_bounds(data, offsets)
    keep = np.zeros(len(data) + 1, np.int64)
    keep[starts] += 1
    np.subtract.at(keep, ends, 1)
    keep = np.cumsum(keep)[:-1].astype(bool)
    ink = keep.copy()
    keep[ends[ends < len(data)]] = True  # a blank, or the first byte of the next text
    place = np.cumsum(keep) - 1
    out = np.where(ink, lower_ascii(data), np.uint8(32))[keep]
    return out.tobytes(), place[starts], place[ends - 1] + 1, before


def bit_sums(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """How many of each text's hashes have each bit; ``first`` is the first hash of each text (all have one)."""
    size = np.diff(np.append(first, len(h)))
    runs = -(-size // 255)  # a byte lane counts to 255
    of = np.repeat(np.arange(len(first)), runs)
    begin = np.cumsum(runs) - runs
    at = first[of] + 255 * (np.arange(len(of)) - begin[of])
    counts = np.empty((len(at), 8, 8), np.int64)
    for k in range(8):
        lanes = np.add.reduceat((h >> np.uint64(k)) & _LANES, at)
        counts[:, :, k] = np.ascontiguousarray(lanes).view(np.uint8).reshape(-1, 8)
    return np.add.reduceat(counts.reshape(-1, 64), begin, axis=0)


def fingerprints(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The fingerprint of each text; zero without a word."""
    out = np.zeros(len(offsets) - 1, np.uint64)
    if not len(data):
        return out
    text, starts, ends, before = spaced_words(data, offsets)
    words = np.diff(before)
    n = np.where(words >= WORDS, words - WORDS + 1, np.minimum(words, 1))
    doc = np.repeat(np.arange(len(n)), n)
    if not len(doc):
        return out
    begin = np.cumsum(n) - n
    at = before[:-1][doc] + np.arange(len(doc)) - begin[doc]
    s, e = starts[at], ends[at + np.minimum(words, WORDS)[doc] - 1]
    h = np.empty(len(at), np.uint64)
    for k in range(0, len(at), 1 << 16):
        part = slice(k, k + (1 << 16))
        h[part] = np.fromiter((xxh64_intdigest(text[i:j], SEED) for i, j in zip(s[part].tolist(), e[part].tolist(), strict=True)), np.uint64, len(s[part]))
    has = n > 0
    bits = 2 * bit_sums(h, begin[has]) > n[has][:, None]
    out[has] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [fingerprints(data, offsets) for _, _, data, offsets in pieces(batch.column(1))]
        bits = np.concatenate(found or [np.zeros(0, np.uint64)])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits.view(np.int64))], ["id", "bits"])


def child_masks(mask: int) -> list[int]:
    """Masks (of unsigned bits) that fix two of four equal parts of the free bits of ``mask`` too."""
    free = [b for b in range(64) if not mask >> b & 1]
    size = len(free) // PARTS
    parts = [sum(1 << b for b in free[k * size : (k + 1) * size]) for k in range(PARTS)]
    return [mask | sum(chosen) for chosen in itertools.combinations(parts, PARTS - RADIUS)]


def bit_planes(fp: np.ndarray) -> np.ndarray:
    """64 planes by blocks: bit l of word t of plane b is bit b of fingerprint 64 t + l."""
    padded = np.zeros(-(-len(fp) // 64) * 64, np.uint64)
    padded[: len(fp)] = fp
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")  # fingerprints by bits
    lanes = np.packbits(bits.reshape(-1, 64, 64).transpose(2, 0, 1), axis=2, bitorder="little")
    return np.ascontiguousarray(lanes).view(np.uint64).reshape(64, -1)


def close_pairs(fp: np.ndarray, end: np.ndarray, bits: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places i < j < end[i] of fingerprints that differ in two bits at most, compared on the planes ``bits`` (on others they agree)."""
    planes, place = bit_planes(fp), np.arange(len(fp))
    low = (place + 1) >> 6
    blocks = np.where(end > place + 1, ((end - 1) >> 6) - low + 1, 0)
    total = np.cumsum(blocks)
    at = 0
    while at < len(fp):
        stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + STEP, "right")))
        q = np.repeat(place[at:stop], blocks[at:stop])
        block = low[q] + np.arange(len(q)) - (total[q] - blocks[q] - (total[at - 1] if at else 0))
        at = stop
        # lanes of the block that lie behind the fingerprint and in its bucket
        first, last = np.maximum(q + 1 - 64 * block, 0), np.minimum(end[q] - 64 * block, 64)
        lanes = (_ALL << first.astype(np.uint64)) & (_ALL >> (64 - last).astype(np.uint64))
        over, ones, twos = ~lanes, np.zeros(len(q), np.uint64), np.zeros(len(q), np.uint64)
        for k, b in enumerate(bits):
            own = np.uint64(0) - ((fp[q] >> np.uint64(b)) & np.uint64(1))
            differ = planes[b][block] ^ own
            carry = ones & differ
            ones ^= differ
            over |= twos & carry
            twos ^= carry
            if k % PLANES == PLANES - 1:
                over |= ones & twos
                stay = over != _ALL
                if not stay.all():
                    q, block, over, ones, twos = q[stay], block[stay], over[stay], ones[stay], twos[stay]
                if not len(q):
                    break
        near = ~(over | (ones & twos))
        has = near != 0
        if has.any():
            row, lane = np.nonzero(np.unpackbits(near[has].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            yield q[has][row], 64 * block[has][row] + lane


def union(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``label``, in which each place has the smallest of its component, with the links a-b taken in."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := label[label], label):
            label = up


def _forest(table: pa.Table) -> pa.Table:
    """Of a cell: links that connect what is close in any of its buckets."""
    mask, key, bits = (table.column(c).to_numpy().view(np.uint64) for c in ("mask", "key", "bits"))
    order = np.lexsort((bits, key, mask))
    mask, key, bits = mask[order], key[order], bits[order]
    every, node = np.unique(bits, return_inverse=True)
    label = np.arange(len(every))
    for m in np.unique(mask):
        own = mask == m
        fp, k, of = bits[own], key[own], node[own]
        last = np.append(np.flatnonzero(k[1:] != k[:-1]) + 1, len(k))
        end = last[np.searchsorted(last, np.arange(len(k)), "right")]
        for a, b in close_pairs(fp, end, [b for b in range(64) if not int(m) >> b & 1]):
            label = union(label, of[a], of[b])
    child = np.flatnonzero(label != np.arange(len(label)))
    return pa.table({"a": pa.array(every[label[child]].view(np.int64)), "b": pa.array(every[child].view(np.int64))})


def close_links(distinct: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """``a, b``: links that connect all of the distinct fingerprints ``bits`` that differ in two bits at most, directly or through others."""
    spark, links = distinct.sparkSession, None
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    masks = child_masks(0)
    keyed = distinct.select("bits", F.explode(F.array(*[F.lit(signed(m)) for m in masks])).alias("mask"))
    while True:
        keyed = keyed.withColumn("key", F.col("bits").bitwiseAND(F.col("mask")))
        sizes = keyed.groupBy("mask", "key").agg(F.count("*").alias("n"))
        large = cut(sizes.where(F.col("n") > bucket), "simhash-large") if len(masks) < 216 else None
        none = large is None or large.isEmpty()
        small = keyed if none else keyed.join(large, ["mask", "key"], "left_anti")
        cells = max(1, math.ceil(keyed.count() / CELL_ROWS))
        small = small.withColumn("cell", F.pmod(F.xxhash64("mask", "key"), F.lit(cells)).cast("int"))
        found = cut(small.groupBy("cell").applyInArrow(_forest, "a long, b long"), "simhash-links")
        links = found if links is None else links.unionByName(found)
        if none:
            return links
        # a bucket's rows are dealt anew by its own mask, so that what it fixed stays fixed
        children = {m: child_masks(m) for m in masks}
        deeper = spark.createDataFrame([(signed(m), signed(c)) for m, cs in children.items() for c in cs], "mask long, child long")  # 216 rows at most
        masks = sorted({c for cs in children.values() for c in cs})
        rows = keyed.join(large.select("mask", "key"), ["mask", "key"]).join(F.broadcast(deeper), "mask")
        keyed = cut(rows.select("bits", F.col("child").alias("mask")).distinct(), "simhash-rows")


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket: int = BUCKET) -> DataFrame:
    """``id_col, fingerprint, component_id``: each row's fingerprint in 16 hex digits and the smallest id that links of fingerprints reach.

    Words are runs without ASCII white space, A-Z in lower case; a text of one or two words is one shingle, one without words (null, empty,
    blank) has fingerprint zero, which is linked like any other. Equal fingerprints are one node, so copies and repeated
    rows cost nothing. Null ids are no component's name: a component of such rows only has null. Other columns are ignored; an
    empty table gives an empty result.
    """
    kind = dict(docs.dtypes)[id_col]
    text = F.coalesce(F.col(text_col), F.lit(""))
    marked = docs.select(F.col(id_col).alias("id"), text.alias("text")).mapInArrow(_fingerprints, f"id {kind}, bits long")
    marked = cut(marked, "simhash-bits")
    nodes = cut(marked.groupBy("bits").agg(F.min("id").alias("first")), "simhash-nodes")
    roots = components(close_links(nodes, bucket), cut)
    placed = cut(nodes.join(roots, F.col("bits") == F.col("node"), "left").select("bits", "first", F.coalesce("root", "bits").alias("root")), "simhash-placed")
    named = cut(placed.groupBy("root").agg(F.min("first").alias("component_id")), "simhash-named")
    named = cut(placed.join(named, "root").select("bits", "component_id"), "simhash-classes")
    digits = F.lower(F.lpad(F.hex("bits"), 16, "0"))
    return marked.join(named, "bits").select(F.col("id").alias(id_col), digits.alias("fingerprint"), "component_id")
