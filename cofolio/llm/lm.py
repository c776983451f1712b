"""Operator 2: language-model scoring with an Elias-Fano n-gram trie.

A bigram model with interpolated absolute discounting over an add-half unigram model:

    p(w | v) = max(c(vw) - D, 0) / c(v) + D * n(v) / c(v) * p1(w),    p1(w) = (c(w) + 0.5) / (N + 0.5 * (V + 1))

n(v) is the number of distinct successors of v; a context that training lacks leaves p1. The counts are gathered
by Spark: blocks of documents send distinct words, then distinct bigrams, to shards. The shard of a
context builds its part of the trie (``elias_fano``) in a memory-mapped file, answers each block's queries with
quantised probabilities, and the blocks add up their documents' tokens. Words have dense ids by rank of
their 64-bit hash; the bigrams of contexts heavier than ``HOT`` shards' fair share of tokens are spread over all shards.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import block_count, block_of, ddl, found_in, from_planes, pack, pack32, planes, shard_bits, table, unpack, unpack32
from .elias_fano import BigramTrie
from .vec import lower_ascii, mix, pieces, word_bounds, word_hashes

DISCOUNT = 0.75
#: Text of a block; a task takes some fifty bytes for each byte of it.
BLOCK_BYTES = 5 << 20
HOT = 8
#: Steps of a quantised probability in a power of ten; code 0 is none.
STEPS = 4000
END = np.uint64(0xE4D)
START, UNKNOWN = np.uint64(1 << 40), np.uint64((1 << 40) + 1)

_WORDS = [("shard", pa.int32()), ("block", pa.int32()), ("h", pa.binary()), ("n", pa.binary())]
_VOCAB = [("block", pa.int32()), ("h", pa.binary()), ("id", pa.binary()), ("c", pa.binary()), ("v", pa.int64()), ("n", pa.int64())]
_GRAMS = [("shard", pa.int32()), ("block", pa.int32())] + [(k, pa.binary()) for k in ("context", "size", "total", "word", "count")]
_CODES = [("shard", pa.int32()), ("block", pa.int32())] + [(k, pa.binary()) for k in ("seen", "mass", "hot", "hot_n")]


def quantise(x: np.ndarray) -> np.ndarray:
    """Positive values up to 1 as 16-bit codes; 0 stays 0."""
    code = 1 + np.rint(-np.log10(np.maximum(x, 1e-300)) * STEPS)
    return np.where(x > 0, np.clip(code, 1, 65535), 0).astype(np.uint16)


def value_of(code: np.ndarray) -> np.ndarray:
    return np.where(code > 0, 10.0 ** (-(code.astype(np.float64) - 1) / STEPS), 0.0)


def is_held_out(id_col: str) -> Column:
    """Rows that the model doesn't learn from; rows of a null id are among them."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5)) == 1, F.lit(True))


class _Block:
    """The tokens of a block's documents: hashes, first-of-text flags, and the text of each."""

    def __init__(self, left: pa.Table):
        texts = left.column("__text").combine_chunks()
        texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
        tokens, sizes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for _, _, data, offsets in pieces(texts):
            data = lower_ascii(data)
            starts, ends, before = word_bounds(data, offsets)
            n = np.diff(before)
            out = np.full(len(starts) + len(n), END, np.uint64)
            out[np.arange(len(starts)) + np.repeat(np.arange(len(n)), n)] = word_hashes(data, starts, ends)
            tokens.append(out)
            sizes.append(n + 1)
        self.tokens, self.sizes = np.concatenate(tokens), np.concatenate(sizes)
        self.train = ~np.asarray(left.column("__held_out").to_pylist(), bool) if left.num_rows else np.zeros(0, bool)
        self.doc = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.learnt = self.train[self.doc]
        self.first = np.diff(self.doc, prepend=-1) > 0
        self.words, self.of = np.unique(self.tokens, return_inverse=True)

    def placed(self, right: pa.Table, bits: int) -> None:
        """Take the vocabulary's answers: counts and ids of words, N and V; then the distinct (context, word) pairs in shard order."""
        rows = [r for r in zip(*(right.column(k).to_pylist() for k in ("h", "id", "c", "v", "n")), strict=True) if r[0] is not None]
        known = np.concatenate([np.zeros(0, np.uint64), *[unpack(r[0]) for r in rows]])
        ids = np.concatenate([np.zeros(0, np.uint64), *[unpack(r[1]) for r in rows]])
        counts = np.concatenate([np.zeros(0, np.uint64), *[from_planes(r[2]) for r in rows]])
        self.v, self.n = sum(r[3] for r in rows), sum(r[4] for r in rows)
        order = np.argsort(known)
        at, has = found_in(self.words, known[order])
        self.count = np.where(has, counts[order][at] if len(known) else 0, 0).astype(np.int64)
        ids = np.where(has, ids[order][at] if len(known) else UNKNOWN, UNKNOWN)
        # local ranks in the order of ids; the start of a text is a context too
        names, rank = np.unique(np.append(ids, [START, UNKNOWN]), return_inverse=True)
        word = rank[self.of]
        context = np.empty_like(word)
        context[1:] = word[:-1]
        context[self.first] = rank[-2]
        total = np.zeros(len(names), np.int64)
        total[rank[:-2]] = self.count
        end = np.flatnonzero(self.words == END)
        total[rank[-2]] = self.count[end[0]] if len(end) else 0  # as many starts as ends
        total[rank[-1]] = 0
        self.context_total = total[context]
        self.asks = self.context_total > 0
        key = context[self.asks].astype(np.uint64) * np.uint64(len(names)) + word[self.asks].astype(np.uint64)
        key, self.inverse = np.unique(key, return_inverse=True)
        self.uses = np.bincount(self.inverse, self.learnt[self.asks], minlength=len(key)).astype(np.int64)
        c, w = (key // np.uint64(len(names))).astype(np.int64), (key % np.uint64(len(names))).astype(np.int64)
        self.hot = total[c] > HOT * self.n / (1 << bits)
        spread = np.where(self.hot, mix(names[c] * np.uint64(3) + mix(names[w])), mix(names[c]))
        self.shard = (spread >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(key), np.int64)
        self.order = np.argsort(self.shard, kind="stable")
        self.contexts, self.successors, self.totals = names[c], names[w], np.where(self.hot, total[c], 0)


def _of(left: pa.Table, right: pa.Table | None = None) -> int:
    return (left if left.num_rows or right is None else right).column("block")[0].as_py()


def _send_words(bits: int):
    def run(left: pa.Table) -> pa.Table:
        b = _Block(left)
        n = np.bincount(b.of, b.learnt, minlength=len(b.words)).astype(np.int64)
        cuts = np.searchsorted(b.words >> np.uint64(64 - bits) if bits else np.zeros(len(b.words), np.uint64), np.arange((1 << bits) + 1, dtype=np.uint64))
        # a row for every shard: the answer brings the shard's totals
        return table([(s, _of(left), pack(b.words[i:j]), pack32(n[i:j])) for s, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))], _WORDS)

    return run


def _count_words(bits: int):
    def run(sent: pa.Table) -> pa.Table:
        shard = sent.column("shard")[0].as_py()
        hs = [unpack(x) for x in sent.column("h").to_pylist()]
        every, inverse = np.unique(np.concatenate(hs), return_inverse=True)
        c = np.bincount(inverse, np.concatenate([unpack32(x) for x in sent.column("n").to_pylist()]), minlength=len(every)).astype(np.int64)
        known = c > 0
        ids = ((np.cumsum(known) - 1).astype(np.uint64) << np.uint64(bits)) | np.uint64(shard)
        rows, at = [], 0
        for block, h in zip(sent.column("block").to_pylist(), hs, strict=True):
            own = inverse[at : at + len(h)]
            at += len(h)
            has = known[own]
            rows.append((block, pack(h[has]), pack(ids[own[has]]), planes(c[own[has]]), int(known.sum()), int(c.sum())))
        return table(rows, _VOCAB)

    return run


def _send_bigrams(bits: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return table([], _GRAMS)
        b = _Block(left)
        b.placed(right, bits)
        cuts = np.searchsorted(b.shard[b.order], np.arange((1 << bits) + 1))
        rows = []
        for s, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            own = b.order[i:j]
            head = np.flatnonzero(np.diff(b.contexts[own].astype(np.int64), prepend=-1))
            size = np.diff(np.append(head, len(own)))
            rows.append((s, _of(left), pack(b.contexts[own][head]), pack32(size), planes(b.totals[own][head]), planes(b.successors[own]), pack32(b.uses[own])))
        return table(rows, _GRAMS)

    return run


def _build_and_query(sent: pa.Table) -> pa.Table:
    read = lambda name, f: [f(x) for x in sent.column(name).to_pylist()]
    context, size, total, word, count = (read(k, f) for k, f in (("context", unpack), ("size", unpack32), ("total", from_planes), ("word", from_planes), ("count", unpack32)))
    of = [np.repeat(c, s) for c, s in zip(context, size, strict=True)]
    all_of, all_word = np.concatenate(of), np.concatenate(word)
    contexts, ci = np.unique(all_of, return_inverse=True)
    words, wi = np.unique(all_word, return_inverse=True)
    key = ci.astype(np.uint64) * np.uint64(max(1, len(words))) + wi.astype(np.uint64)
    key, inverse = np.unique(key, return_inverse=True)
    c = np.bincount(inverse, np.concatenate(count), minlength=len(key))
    key, c = key[c > 0], c[c > 0]
    node, word_id = (key // np.uint64(max(1, len(words)))).astype(np.int64), words[(key % np.uint64(max(1, len(words)))).astype(np.int64)] if len(words) else words
    given = np.zeros(len(contexts))
    np.maximum.at(given, np.searchsorted(contexts, np.concatenate(context)), np.concatenate(total).astype(np.float64))
    hot = given > 0
    distinct = np.bincount(node, minlength=len(contexts))
    sums = np.where(hot, given, np.bincount(node, c, minlength=len(contexts)))
    seen = quantise(np.maximum(c - DISCOUNT, 0) / np.maximum(sums[node], 1))
    mass = quantise(np.where(hot, 0, DISCOUNT * distinct / np.maximum(sums, 1)))
    stored = distinct > 0
    trie = BigramTrie(contexts[stored], distinct[stored], word_id, int(word_id.max()) + 1 if len(word_id) else 1, seen, mass[stored])
    try:
        rows = []
        shard, hot_ids, hot_n = sent.column("shard")[0].as_py(), pack(contexts[hot]), pack32(distinct[hot])
        for block, own, w, s in zip(sent.column("block").to_pylist(), of, word, size, strict=True):
            a, b = trie.lookup(own, w)
            head = (np.cumsum(s.astype(np.int64)) - s)
            rows.append((shard, block, a.tobytes(), b[head].tobytes() if len(head) else b"", hot_ids, hot_n))
    finally:
        trie.close()
    return table(rows, _CODES)


def _add_up(bits: int, id_type: pa.DataType, id_col: str):
    schema = [(id_col, id_type), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return table([], schema)
        b = _Block(left)
        b.placed(right, bits)
        answers = sorted((r for r in zip(*(right.column(k).to_pylist() for k in ("shard", "seen", "mass", "hot", "hot_n")), strict=True) if r[0] is not None), key=lambda r: r[0])
        seen, mass = np.zeros(len(b.order), np.uint16), np.zeros(len(b.order))
        cuts = np.searchsorted(b.shard[b.order], np.arange((1 << bits) + 1))
        hot_id = np.concatenate([np.zeros(0, np.uint64), *[unpack(r[3]) for r in answers]])
        hot_n = np.concatenate([np.zeros(0, np.uint32), *[unpack32(r[4]) for r in answers]])
        hot_id, group = np.unique(hot_id, return_inverse=True)
        hot_n = np.bincount(group, hot_n, minlength=len(hot_id))
        for s, a, m, _, _ in answers:
            own = b.order[cuts[s] : cuts[s + 1]]
            head = np.diff(b.contexts[own].astype(np.int64), prepend=-1) != 0
            seen[own] = np.frombuffer(a, np.uint16)
            mass[own] = value_of(np.frombuffer(m, np.uint16))[np.cumsum(head) - 1] if len(own) else 0
        at, has = found_in(b.contexts, hot_id)
        mass = np.where(b.hot, DISCOUNT * np.where(has, hot_n[at] if len(hot_n) else 0, 0) / np.maximum(b.totals, 1), mass)
        p1 = ((b.count + 0.5) / (b.n + 0.5 * (b.v + 1)))[b.of]
        p = p1.copy()
        p[b.asks] = value_of(seen)[b.inverse] + mass[b.inverse] * p1[b.asks]
        add = lambda x: np.bincount(b.doc, x, minlength=len(b.sizes))
        columns = [left.column("__id").cast(id_type), left.column("__held_out"), b.sizes, add((b.count > 0)[b.of]).astype(np.int64), np.full(len(b.sizes), b.n), add(np.log10(p1)), add(np.log10(p))]
        return pa.Table.from_arrays([c if isinstance(c, pa.ChunkedArray) else pa.array(c, t) for c, (_, t) in zip(columns, schema, strict=True)], [n for n, _ in schema])

    return run


def lm_scores(docs: DataFrame, held_out: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every row, from its whole text.

    The model learns from the rows that ``held_out`` (default: :func:`is_held_out`) leaves. A null text counts as
    empty, which is one token (the end). Repeated rows count and score each; ids may be null or repeat; other columns are
    ignored; without a row to learn from every token has probability 1.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("__id"), (is_held_out(id_col) if held_out is None else held_out).alias("__held_out"), text.alias("__text"))
    whole = rows.agg(F.sum(F.octet_length("__text")).alias("b"), F.count("*").alias("n")).first()
    blocks = block_count(whole.b, whole.n, BLOCK_BYTES)
    bits = shard_bits(blocks)
    id_type = docs.select(id_col).limit(0).toArrow().schema.field(0).type
    left = rows.withColumn("block", block_of(F.struct("__id", F.crc32(F.col("__text").cast("binary"))), blocks))
    words = left.groupBy("block").applyInArrow(_send_words(bits), ddl(_WORDS))
    vocab = words.groupBy("shard").applyInArrow(_count_words(bits), ddl(_VOCAB))
    grams = left.groupBy("block").cogroup(vocab.groupBy("block")).applyInArrow(_send_bigrams(bits), ddl(_GRAMS))
    codes = grams.groupBy("shard").applyInArrow(_build_and_query, ddl(_CODES))
    told = vocab.unionByName(codes, allowMissingColumns=True)
    out = f"`{id_col}` {dict(docs.dtypes)[id_col]}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return left.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(_add_up(bits, id_type, id_col), out)
