"""Operator 7: removal of repeated substrings with suffix arrays built by two-stage sorting.

Suffixes are sorted where equal ones can meet, not in one array over the corpus:

1. Every window of ``length`` bytes has an anchor, its ``ANCHOR``-byte string of smallest hash, so
   equal windows have equal anchors. Blocks of documents send their distinct anchors to shards of hash space and
   learn which occur in other texts; windows of other anchors can't repeat and go no further.
2. Neighbouring windows of one anchor form a segment. Each block sends its distinct segments, with the smallest
   document id, to the anchor's shard. The shard builds the suffix array of its segments by two-stage
   sorting (Itoh and Tanaka 1999): only suffixes smaller than their successors are sorted directly, the
   rest is induced by scans of the buckets in ascending order. Adjacent common prefixes then
   group equal windows, and each group's smallest document id goes back to the blocks.
3. A block removes the bytes of windows that a smaller id has too.

Equal whole texts are combined first. A segment counts once a block however often it occurs there, so a
passage in a third of all documents doesn't burden its shard.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import block_count, block_of, ddl, found_in, from_planes, pack, pack32, planes, shard_bits, table, unpack, unpack32
from .scratch import cut
from .vec import mix, pieces, powers, prefix_hash

LENGTH, ANCHOR = 50, 16
#: Text of a block; a shard's segments and their suffix array take some hundred bytes a byte of it that repeats.
BLOCK_BYTES = 8 << 20
PIECE = 1 << 19
#: Places of a piece that fit beside the anchor's hash while the smallest one is sought.
_PLACE = np.uint64((1 << 30) - 1)


def anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, place of the anchor, anchor hash, prefix hash): of all windows inside one text, in order."""
    n, width = len(data), length - ANCHOR + 1
    h = prefix_hash(data)
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), h
    up, down = powers(n + 1)
    grams = mix((h[ANCHOR:] - h[:-ANCHOR]) * down[: n - ANCHOR + 1])
    low = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
    have = 1
    while have < width:
        step = min(have, width - have)
        low = np.minimum(low[:-step], low[step:])
        have += step
    inside = np.ones(len(low), bool)
    for end in offsets[1:-1]:  # windows that reach over the end of a text
        inside[max(0, end - length + 1) : end] = False
    starts = np.flatnonzero(inside)
    place = (low[starts] & _PLACE).astype(np.int64)
    # anchors have small hashes, so these are scrambled anew before they choose a shard
    return starts, place, mix(grams[place] + np.uint64(0x9E3779B97F4A7C15)), h


def two_stage_order(text: np.ndarray, wanted: np.ndarray, packed: np.ndarray, depth: int) -> np.ndarray:
    """The positions of ``wanted`` in the order of their suffixes, as far as ``depth`` symbols tell.

    ``text`` ends in a 0, which occurs nowhere but at the ends of segments; ``packed`` holds eight symbols
    from each position. Positions after a wanted one are sorted with it until one is smaller than its successor.
    """
    n = len(text)
    change = np.flatnonzero(text[:-1] != text[1:])
    direct = np.ones(n, bool)  # smaller than the successor; ends of segments count as such
    if len(change):
        # a run of one symbol is as its last place; the text's end is a run of its own
        rises = text[change] < text[change + 1]
        direct[: change[-1] + 1] = np.repeat(rises, np.diff(change, prepend=-1))
    direct |= text == 0
    chosen = np.zeros(n, bool)
    chosen[wanted] = True
    grow = wanted[~direct[wanted]]
    while len(grow):
        grow = grow + 1
        grow = grow[~chosen[grow]]
        chosen[grow] = True
        grow = grow[~direct[grow]]
    first = np.flatnonzero(chosen & direct)
    last = len(packed) - 1
    for k in range(-(-depth // 8) * 8 - 8, -1, -8):  # by the last symbols first, stably
        first = first[np.argsort(packed[np.minimum(first + k, last)], kind="stable")]
    bounds = np.searchsorted(text[first], np.arange(257))
    pending: list[list[np.ndarray]] = [[] for _ in range(256)]
    order = []

    def induce(done: np.ndarray) -> None:
        before = done[done > 0] - 1
        before = before[chosen[before] & ~direct[before]]
        if not len(before):
            return
        symbol = text[before]
        by = np.argsort(symbol, kind="stable")
        before, symbol = before[by], symbol[by]
        cuts = np.flatnonzero(np.diff(symbol, prepend=-1))
        for part in np.split(before, cuts[1:]):
            pending[text[part[0]]].append(part)

    for c in range(256):
        while pending[c]:
            part = np.concatenate(pending[c])
            pending[c] = []
            order.append(part)
            induce(part)
        if bounds[c] < bounds[c + 1]:
            part = first[bounds[c] : bounds[c + 1]]
            order.append(part)
            induce(part)
    order = np.concatenate(order) if order else np.zeros(0, np.int64)
    keep = np.zeros(n, bool)
    keep[wanted] = True
    return order[keep[order]]


def smallest_ids(segments: np.ndarray, sizes: np.ndarray, ids: np.ndarray, length: int) -> np.ndarray:
    """For each window of each segment (all bytes behind each other, ``sizes`` bytes long) the smallest id of any segment that has the window."""
    spaced = np.zeros(len(segments) + len(sizes), np.uint8)
    ends = np.cumsum(sizes)
    own = np.repeat(np.arange(len(sizes)), sizes)
    spaced[np.arange(len(segments)) + own] = segments + 1  # UTF-8 has no byte above 0xF4
    windows = sizes - length + 1
    of = np.repeat(np.arange(len(sizes)), windows)
    start = (ends - sizes + np.arange(len(sizes)))[of] + np.arange(len(of)) - np.repeat(np.cumsum(windows) - windows, windows)
    padded = np.concatenate([spaced, np.zeros(8, np.uint8)])
    packed = np.zeros(len(spaced), np.uint64)
    for k in range(8):
        packed = (packed << np.uint64(8)) | padded[k : k + len(spaced)]
    order = two_stage_order(spaced, start, packed, length)
    # adjacent common prefixes of at least ``length``
    same = np.ones(max(len(order) - 1, 0), bool)
    for k in range(0, length, 8):
        part = packed[np.minimum(order + k, len(packed) - 1)] >> np.uint64(8 * max(0, k + 8 - length))
        same &= part[1:] == part[:-1]
    heads = np.flatnonzero(np.concatenate([[True], ~same])) if len(order) else np.zeros(0, np.int64)
    index = np.searchsorted(start, order)
    low = np.minimum.reduceat(ids[of[index]], heads) if len(heads) else np.zeros(0, np.int64)
    out = np.zeros(len(start), np.int64)
    out[index] = np.repeat(low, np.diff(np.append(heads, len(order))))
    return out


def _block_texts(left: pa.Table, right: pa.Table) -> tuple[pa.Array, np.ndarray, list[str]]:
    """Texts, ids and digests of the block's distinct texts, in the order of digests."""
    wanted = {(i, s) for i, s in zip(right.column("rep").to_pylist(), right.column("sha").to_pylist(), strict=True) if s is not None}
    rows: dict = {}
    for k, key in enumerate(zip(left.column("__id").to_pylist(), left.column("sha").to_pylist(), strict=True)):
        if key in wanted:
            rows.setdefault(key, k)
    keys = sorted(rows, key=lambda x: (x[1], x[0]))
    pa.default_memory_pool().release_unused()  # of the group before
    texts = left.column("__text").combine_chunks().take(pa.array([rows[k] for k in keys], pa.int64()))
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    return texts, np.array([k[0] for k in keys], np.int64), [k[1] for k in keys]


_ANCHORS = [("shard", pa.int32()), ("block", pa.int32()), ("h", pa.binary()), ("texts", pa.binary())]
_SEGMENTS = [("shard", pa.int32()), ("block", pa.int32()), ("key", pa.binary()), ("sizes", pa.binary()), ("ids", pa.binary()), ("bytes", pa.binary())]
_FOUND = [("block", pa.int32()), ("key", pa.binary()), ("sizes", pa.binary()), ("low", pa.binary()), ("runs", pa.binary())]
_RESULT = [("sha", pa.string()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]


def _send_anchors(bits: int, length: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        block = (left if left.num_rows else right).column("block")[0].as_py()
        texts, _, _ = _block_texts(left, right)
        found = [np.zeros(0, np.uint64)]
        for _, _, data, offsets in pieces(texts, PIECE):
            starts, place, h, _ = anchors(data, offsets, length)
            new = np.flatnonzero(np.diff(place, prepend=-1))
            doc = np.searchsorted(offsets, starts[new], "right").astype(np.uint64)
            own = np.unique(np.stack([doc, h[new]]), axis=1)[1] if len(new) and len(offsets) > 2 else np.unique(h[new])
            found.append(own)
        h, texts_ = np.unique(np.concatenate(found), return_counts=True)
        cuts = np.searchsorted(h >> np.uint64(64 - bits) if bits else np.zeros(len(h), np.uint64), np.arange((1 << bits) + 1, dtype=np.uint64))
        rows = [(s, block, pack(h[i:j]), pack32(np.minimum(texts_[i:j], 2))) for s, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if j > i]
        return table(rows, _ANCHORS)

    return run


def _shared_anchors(sent: pa.Table) -> pa.Table:
    hs = [unpack(x) for x in sent.column("h").to_pylist()]
    every, inverse = np.unique(np.concatenate(hs), return_inverse=True)
    texts = np.bincount(inverse, np.concatenate([unpack32(x) for x in sent.column("texts").to_pylist()]), minlength=len(every))
    rows, at = [], 0
    for block, h in zip(sent.column("block").to_pylist(), hs, strict=True):
        shared = texts[inverse[at : at + len(h)]] >= 2
        at += len(h)
        if shared.any():
            rows.append((block, pack(h[shared])))
    return table(rows, [("block", pa.int32()), ("h", pa.binary())])


def _segments(texts: pa.Array, ids: np.ndarray, shared: np.ndarray, length: int) -> Iterator[tuple]:
    """Of each piece: (first text, bytes, offsets, segment starts, windows, text of each, key, anchor hash)."""
    for at, _, data, offsets in pieces(texts, PIECE):
        starts, place, h, prefix = anchors(data, offsets, length)
        _, has = found_in(h, shared)
        starts, place, h = starts[has], place[has], h[has]
        head = np.flatnonzero((np.diff(place, prepend=-1) != 0) | (np.diff(starts, prepend=-2) != 1))
        size = np.diff(np.append(head, len(starts)))
        begin = starts[head]
        end = begin + size + length - 1
        key = mix(mix((prefix[end] - prefix[begin]) * powers(len(data) + 1)[1][begin]) + size.astype(np.uint64))
        doc = at + np.searchsorted(offsets, begin, "right") - 1
        # of texts that end where the next begins, the one that has the segment
        yield at, data, offsets, begin, size, doc, key, h[head]


def _send_segments(bits: int, length: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        block = (left if left.num_rows else right).column("block")[0].as_py()
        texts, ids, _ = _block_texts(left, right)
        shared = np.sort(np.concatenate([np.zeros(0, np.uint64), *[unpack(x) for x in right.column("h").to_pylist() if x is not None]]))
        parts = []
        for _, data, _, begin, size, doc, key, h in _segments(texts, ids, shared, length):
            # once a piece, with the smallest id
            order = np.lexsort([ids[doc], key])
            order = order[np.flatnonzero(np.diff(key[order].view(np.int64), prepend=~key[order[:1]].view(np.int64)))] if len(order) else order
            begin, size, doc, key, h = begin[order], size[order], doc[order], key[order], h[order]
            total = size + length - 1
            where = np.repeat(begin - (np.cumsum(total) - total), total) + np.arange(total.sum())
            parts.append((key, h, total, ids[doc], data[where]))
        if not parts:
            return table([], _SEGMENTS)
        key, h, total, low, raw = (np.concatenate(x) for x in zip(*parts, strict=True))
        begin = np.cumsum(total) - total
        order = np.lexsort([low, key])
        order = order[np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]]))] if len(order) else order
        shard = (h[order] >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(order), np.int64)
        order = order[np.argsort(shard, kind="stable")]
        shard = np.sort(shard)
        rows = []
        for s in np.unique(shard):
            own = order[np.searchsorted(shard, s) : np.searchsorted(shard, s, "right")]
            size = total[own]
            where = np.repeat(begin[own] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            rows.append((int(s), block, pack(key[own]), pack32(size), low[own].tobytes(), raw[where].tobytes()))
        return table(rows, _SEGMENTS)

    return run


def _resolve(length: int):
    def run(sent: pa.Table) -> pa.Table:
        keys = [unpack(x) for x in sent.column("key").to_pylist()]
        size = np.concatenate([unpack32(x) for x in sent.column("sizes").to_pylist()]).astype(np.int64)
        ids = np.concatenate([np.frombuffer(x, np.int64) for x in sent.column("ids").to_pylist()])
        raw = np.concatenate([np.frombuffer(x, np.uint8) for x in sent.column("bytes").to_pylist()])
        every, head, inverse = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
        low = np.full(len(every), np.iinfo(np.int64).max)
        np.minimum.at(low, inverse, ids)
        begin = (np.cumsum(size) - size)[head]
        own = size[head]
        where = np.repeat(begin - (np.cumsum(own) - own), own) + np.arange(own.sum())
        best = smallest_ids(raw[where], own, low, length)
        windows = own - length + 1
        place = np.cumsum(windows) - windows
        # runs of windows of one smallest id, which mostly are whole segments
        turn = np.zeros(len(best), bool)
        turn[place] = True
        turn[1:] |= best[1:] != best[:-1]
        head = np.flatnonzero(turn)
        run_low, run_size = best[head], np.diff(np.append(head, len(best)))
        first = np.searchsorted(head, place)
        count = np.diff(np.append(first, len(head)))
        rows, at = [], 0
        for block, key in zip(sent.column("block").to_pylist(), keys, strict=True):
            mine = inverse[at : at + len(key)]
            at += len(key)
            n = count[mine]
            where = np.repeat(first[mine] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            rows.append((block, pack(key), pack32(windows[mine]), planes(run_low[where]), pack32(run_size[where])))
        return table(rows, _FOUND)

    return run


def _remove(length: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        texts, ids, digests = _block_texts(left, right)
        shared = np.sort(np.concatenate([np.zeros(0, np.uint64), *[unpack(x) for x in right.column("h").to_pylist() if x is not None]]))
        answers = zip(*(right.column(c).to_pylist() for c in ("key", "sizes", "low", "runs")), strict=True)
        got = [(unpack(k), unpack32(n).astype(np.int64), np.repeat(from_planes(low).astype(np.int64), unpack32(runs))) for k, n, low, runs in answers if k is not None]
        key = np.concatenate([np.zeros(0, np.uint64), *[g[0] for g in got]])
        n = np.concatenate([np.zeros(0, np.int64), *[g[1] for g in got]])
        low = np.concatenate([np.zeros(0, np.int64), *[g[2] for g in got]])
        order = np.argsort(key)
        place = (np.cumsum(n) - n)[order]
        key = key[order]
        rows = []
        for at, data, offsets, begin, size, doc, own, _ in _segments(texts, ids, shared, length):
            where, has = found_in(own, key)
            if not has.all():
                raise ValueError("a segment has no answer")
            of = np.repeat(np.arange(len(begin)), size)
            step = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)
            hit = low[place[where][of] + step] < ids[doc][of] if len(of) else np.zeros(0, bool)
            start = (begin[of] + step)[hit]
            edge = np.zeros(len(data) + 1, np.int64)
            np.add.at(edge, start, 1)
            np.add.at(edge, start + length, -1)
            gone = np.cumsum(edge[:-1]) > 0
            first = gone.copy()
            first[1:] &= ~gone[:-1]
            inner = offsets[1:-1]
            inner = inner[inner < len(data)]
            first[inner] = gone[inner]
            up_to = np.concatenate([[0], np.cumsum(gone)])
            spans = np.concatenate([[0], np.cumsum(first)])
            for k in range(len(offsets) - 1):
                i, j = offsets[k], offsets[k + 1]
                removed = int(up_to[j] - up_to[i])
                left_over = data[i:j][~gone[i:j]].tobytes() if removed else None
                digest = hashlib.sha256(left_over).hexdigest() if removed else digests[at + k]
                rows.append((digests[at + k], int(j - i), removed, int(spans[j] - spans[i]), digest))
        return table(rows, _RESULT)

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_bytes, n_removed, n_spans, kept_sha256`` for every row.

    Removes each byte covered by a ``length``-byte string that also starts in a row of smaller id; overlaps
    count and strings are judged on the input. A null text counts as empty; rows of equal id take nothing from each other;
    a row of null id neither loses nor takes anything. The id must be a whole number; other columns are
    ignored. ``length`` is at least twice the anchor's.
    """
    if length < 2 * ANCHOR:
        raise ValueError(f"length must be at least {2 * ANCHOR}")
    text = F.coalesce(F.col(text_col), F.lit(""))
    sha = F.sha2(text, 256).alias("sha")
    narrow = cut(docs.select(F.col(id_col).alias("__id"), sha, F.octet_length(text).cast("long").alias("bytes")), "suffix-ids")
    reps = narrow.groupBy("sha").agg(F.min("__id").cast("long").alias("rep"), F.first("bytes").alias("bytes")).where("rep is not null")
    reps = cut(reps, "suffix-reps")
    whole = narrow.where("__id is not null").agg(F.count("*").alias("n"), F.sum("bytes").alias("b")).first()
    blocks = block_count(whole.b, whole.n, BLOCK_BYTES)  # of all rows, as copies of a text are dealt to blocks too
    bits = shard_bits(blocks)
    left = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("__id"), sha, text.alias("__text"))
    left = left.withColumn("block", block_of(F.col("__id"), blocks))
    right = reps.select("rep", "sha", block_of(F.col("rep"), blocks).alias("block"))
    by_block, none = left.groupBy("block"), lambda t: F.lit(None).cast(t)
    sent = by_block.cogroup(right.groupBy("block")).applyInArrow(_send_anchors(bits, length), ddl(_ANCHORS))
    shared = sent.groupBy("shard").applyInArrow(_shared_anchors, "block int, h binary")
    more = right.select("block", "rep", "sha", none("binary").alias("h")).unionByName(
        shared.select("block", none("long").alias("rep"), none("string").alias("sha"), "h")
    )
    more = cut(more, "suffix-anchors")
    segments = by_block.cogroup(more.groupBy("block")).applyInArrow(_send_segments(bits, length), ddl(_SEGMENTS))
    found = segments.groupBy("shard").applyInArrow(_resolve(length), ddl(_FOUND))
    told = more.select("*", *[none("binary").alias(c) for c in ("key", "sizes", "low", "runs")]).unionByName(
        found.select("block", none("long").alias("rep"), none("string").alias("sha"), none("binary").alias("h"), "key", "sizes", "low", "runs")
    )
    done = by_block.cogroup(told.groupBy("block")).applyInArrow(_remove(length), ddl(_RESULT))
    # of equal texts, all but the first row are removed whole where they are long enough to hold a window
    rows = narrow.join(reps.select("sha", "rep"), "sha", "left").join(done.drop("n_bytes"), "sha", "left")
    copy = (F.col("__id") > F.col("rep")) & (F.col("bytes") >= length)
    alone = F.col("__id").isNull() | F.col("n_removed").isNull()
    pick = lambda whole, none_, own: F.when(copy, whole).when(alone | (F.col("__id") > F.col("rep")), none_).otherwise(own)
    return rows.select(
        F.col("__id").alias(id_col), F.col("bytes").alias("n_bytes"),
        pick(F.col("bytes"), F.lit(0).cast("long"), F.col("n_removed")).alias("n_removed"),
        pick(F.lit(1).cast("long"), F.lit(0).cast("long"), F.col("n_spans")).alias("n_spans"),
        pick(F.sha2(F.lit(""), 256), F.col("sha"), F.col("kept_sha256")).alias("kept_sha256"),
    )
