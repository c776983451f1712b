"""Operator 3: quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of ``WORDS`` words. Each passage is encoded from byte-class pairs, word
statistics and the shares of its words in ``WORD_DIMS`` hashed classes; a small network learns, from document labels alone, the encoding, a gated attention
weight for each passage and the class of the weighted sum (Ilse et al. 2018). It is fitted on
a bounded sample of labelled rows (``train_docs`` and their ``train_passages`` in all, parameters) with all their passages; every whole text is scored in Spark.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import cut
from .vec import lower_ascii, pieces, word_bounds, word_hashes

WORDS = 64
CLASSES = 7
WORD_DIMS = 64
WIDTH = CLASSES * CLASSES + WORD_DIMS + 5
HIDDEN, GATE = 16, 8
#: Bytes of text encoded together.
PIECE = 1 << 19


def _byte_classes() -> np.ndarray:
    """White space, lower, upper, digit, ordinary punctuation, other signs, bytes beyond ASCII."""
    out = np.full(256, 5, np.int64)
    out[[9, 10, 11, 12, 13, 32]] = 0
    out[97:123], out[65:91], out[48:58], out[128:] = 1, 2, 3, 6
    out[[ord(c) for c in ".,;:'\"()-?"]] = 4
    return out


_CLASS = _byte_classes()


def encode_passages(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A row of ``WIDTH`` numbers for each passage, and the first passage of each text. Texts must not be empty."""
    starts, ends, before = word_bounds(data, offsets)
    counts = np.diff(before)
    doc_of = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(starts)) - before[:-1][doc_of]
    mark = np.zeros(len(data), np.int64)
    mark[starts[(place % WORDS == 0) & (place > 0)]] = 1
    mark[offsets[:-1]] = 1
    of_byte = np.cumsum(mark) - 1
    n = int(of_byte[-1]) + 1
    size = np.bincount(of_byte, minlength=n).astype(np.float64)
    c = _CLASS[data]
    pairs = np.bincount(of_byte[:-1] * CLASSES**2 + c[:-1] * CLASSES + c[1:], minlength=n * CLASSES**2)
    out = np.zeros((n, WIDTH), np.float32)
    out[:, : CLASSES**2] = pairs.reshape(n, -1)[:, : CLASSES**2] / size[:, None]
    if len(starts):
        of_word = of_byte[starts]
        words = np.maximum(np.bincount(of_word, minlength=n), 1)
        h = word_hashes(lower_ascii(data), starts, ends)
        key = np.unique((of_word.astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24)))
        distinct = np.bincount((key >> np.uint64(40)).astype(np.int64), minlength=n)
        again = np.zeros(len(h))
        again[1:] = (h[1:] == h[:-1]) & (of_word[1:] == of_word[:-1])
        classes = np.bincount(of_word * WORD_DIMS + (h >> np.uint64(20)).astype(np.int64) % WORD_DIMS, minlength=n * WORD_DIMS)
        out[:, CLASSES**2 : -5] = classes.reshape(n, -1) / words[:, None]
        out[:, -5] = np.bincount(of_word, ends - starts, minlength=n) / words / 10
        out[:, -4] = distinct / words
        out[:, -3] = np.bincount(of_word, again, minlength=n) / words
        out[:, -2] = words / WORDS
        out[:, -1] = np.bincount(of_word, (ends - starts) > 20, minlength=n) / words
    return out, of_byte[offsets[:-1]]


@dataclass
class Model:
    """Parameters by name; ``params`` is empty where there was nothing to learn from, and ``prior`` is the score then."""

    params: dict[str, np.ndarray]
    prior: float

    def scores(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        if not self.params:
            return np.full(len(first), self.prior)
        return 1 / (1 + np.exp(-np.clip(_forward(self.params, x, first)["logit"], -30, 30)))


def _forward(p: dict[str, np.ndarray], x: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
    x = np.clip((x - p["mean"]) / p["spread"], -8, 8)
    h = np.maximum(x @ p["W"] + p["b"], 0)
    t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
    a = (t * g) @ p["w"]
    of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(x))))
    e = np.exp(a - np.maximum.reduceat(a, first)[of])
    weight = e / np.add.reduceat(e, first)[of]
    z = np.add.reduceat(h * weight[:, None], first)
    return {"x": x, "h": h, "t": t, "g": g, "of": of, "weight": weight, "z": z, "logit": z @ p["c"] + p["d"]}


def _gradients(p: dict[str, np.ndarray], fixed: dict[str, np.ndarray], x: np.ndarray, first: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean log loss over the bags."""
    f = _forward(p | fixed, x, first)
    err = (1 / (1 + np.exp(-np.clip(f["logit"], -30, 30))) - label) / len(label)
    dz = err[:, None] * p["c"]
    dzp = dz[f["of"]]
    dweight = (dzp * f["h"]).sum(1)
    da = f["weight"] * (dweight - np.add.reduceat(dweight * f["weight"], first)[f["of"]])
    dt, dg = da[:, None] * p["w"] * f["g"] * (1 - f["t"] ** 2), da[:, None] * p["w"] * f["t"] * f["g"] * (1 - f["g"])
    dh = (dzp * f["weight"][:, None] + dt @ p["V"].T + dg @ p["U"].T) * (f["h"] > 0)
    return {"c": f["z"].T @ err, "d": err.sum(keepdims=True), "w": (f["t"] * f["g"]).T @ da, "V": f["h"].T @ dt, "U": f["h"].T @ dg, "W": f["x"].T @ dh, "b": dh.sum(0)}


def fit(
    x: np.ndarray, first: np.ndarray, label: np.ndarray, epochs: int = 250, rate: float = 0.02, seed: int = 7,
    decay: float = 0.1, dropout: float = 0.3, validation: float = 0.15, patience: int = 60,
) -> Model:
    """Adam with decoupled weight decay on the log loss over all passages at once.

    So that it doesn't learn its rows by heart, each epoch sees a share ``dropout`` of the inputs as their means, and the parameters of the
    epoch with the least loss on a ``validation`` share of the bags are kept (from 40 bags on, if both shares have both labels); it ends
    ``patience`` epochs after that one.
    """
    prior = (float(label.sum()) + 1) / (len(label) + 1)
    if len(label) == 0 or label.min() == label.max():
        return Model({}, prior)
    rng = np.random.default_rng(seed)
    p = {k: rng.normal(0, 1 / np.sqrt(s[0]), s) for k, s in {"W": (WIDTH, HIDDEN), "V": (HIDDEN, GATE), "U": (HIDDEN, GATE), "w": (GATE,), "c": (HIDDEN,)}.items()}
    p = {k: a.astype(np.float32) for k, a in p.items()} | {"b": np.zeros(HIDDEN, np.float32), "d": np.zeros(1, np.float32)}
    x = x.astype(np.float32, copy=False)
    fixed = {"mean": x.mean(0), "spread": x.std(0) + np.float32(1e-3)}
    size = np.diff(np.append(first, len(x)))
    held = rng.random(len(first)) < validation
    if len(label) < 40 or any(len(np.unique(part)) < 2 for part in (label[held], label[~held])):
        held[:] = False
    of = np.repeat(held, size)
    begin = lambda n: np.cumsum(n) - n
    tests, test_first, test_label = x[of], begin(size[held]), label[held]
    x, first, label = x[~of], begin(size[~held]), label[~held]
    m, v = {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}
    best, best_loss, best_step = p, np.inf, 0
    for step in range(1, epochs + 1):
        hidden = rng.integers(0, 256, x.shape, np.uint8) < round(256 * dropout)
        for k, grad in _gradients(p, fixed, np.where(hidden, fixed["mean"], x), first, label).items():
            m[k] = 0.9 * m[k] + 0.1 * grad
            v[k] = 0.999 * v[k] + 0.001 * grad**2
            move = (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
            p = p | {k: p[k] - rate * (move if k in "bd" else move + decay * p[k])}  # biases don't decay
        if held.any():
            z = _forward(p | fixed, tests, test_first)["logit"]
            loss = float(np.mean(np.logaddexp(0, z) - test_label * z))
            if loss < best_loss:
                best, best_loss, best_step = p, loss, step
            elif step - best_step >= patience:
                break
    p = best if held.any() else p
    return Model({k: a.astype(np.float32) for k, a in (p | fixed).items()}, prior)


def _texts(docs: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    # with a closing line end no text is empty
    return docs.select(F.col(id_col).alias("__id"), F.concat(F.coalesce(F.col(text_col), F.lit("")), F.lit("\n")).alias("__text"), *more)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose labels are never learnt from."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", train_docs: int = 4000, train_passages: int = 80_000) -> Model:
    """Fit on a bounded sample of labelled rows that aren't held out, with all their passages.

    The sample is the ``train_docs`` rows of smallest hash of the id, one row an id (of several texts that of smallest hash), less those
    rows with which, counted in that order, it would have more than ``train_passages`` passages; a row goes with all of its passages or stays with all. Null labels and
    ids are left out; of several labels of an id the largest counts. Without
    rows of both labels the model scores every text alike, by the share of label 1 (1.0 without any label).
    """
    sample = (
        labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
        .groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).cast("int").alias("__label"))
        .orderBy(F.xxhash64("__id"), "__id").limit(train_docs)
    )
    rows = _texts(docs, id_col, text_col).join(F.broadcast(sample), "__id").groupBy("__id")  # at most ``train_docs`` rows of three short columns
    rows = rows.agg(F.min_by("__text", F.xxhash64("__text")).alias("__text"), F.first("__label").alias("__label"), F.xxhash64("__id").alias("__at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, end, data, offsets in pieces(b.column(1), PIECE):
                x, first = encode_passages(data, offsets)
                spans = np.append(first, len(x)).tolist()
                bags = [x[i:j].tobytes() for i, j in zip(spans, spans[1:], strict=False)]
                part = [b.column(k).slice(at, end - at) for k in (0, 2, 3)]
                yield pa.RecordBatch.from_arrays([part[0].cast(pa.string()), *part[1:], pa.array(np.diff(spans), pa.int64()), pa.array(bags, pa.binary())], ["id", "label", "at", "n", "bag"])

    bags = cut(rows.mapInArrow(run, "id string, label int, at long, n long, bag binary"), "quality-bags")
    chosen, total = [], 0
    for r in sorted(bags.select("at", "id", "n").collect()):  # at most ``train_docs`` rows
        if total + r.n <= train_passages:
            chosen, total = [*chosen, r.id], total + r.n
    got = sorted(bags.where(F.col("id").isin(chosen)).select("id", "label", "bag").collect(), key=lambda r: r.id) if chosen else []  # at most ``train_passages`` vectors
    if not got:
        return Model({}, 1.0)
    bags = [np.frombuffer(r["bag"], np.float32).reshape(-1, WIDTH) for r in got]
    first = np.cumsum([0, *map(len, bags[:-1])])
    return fit(np.concatenate(bags), first, np.array([r["label"] for r in got], np.float32))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``id_col, score``: how likely label 1 is, from the whole text alone.

    A null text counts as empty, an empty one is a bag of one empty passage; repeated rows get
    equal scores; ids and other columns play no part.
    """
    rows = _texts(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, end, data, offsets in pieces(b.column(1), PIECE):
                got = model.scores(*encode_passages(data, offsets))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, end - at), pa.array(np.asarray(got, np.float64))], [id_col, "score"])

    return rows.mapInArrow(run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, score double")


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns whatever their names, whose score reaches ``threshold``; nulls as in :func:`score`, equal
    texts go or stay together, an empty table stays empty."""
    @F.arrow_udf("double")
    def good(texts: pa.Array) -> pa.Array:
        found = [model.scores(*encode_passages(data, offsets)) for _, _, data, offsets in pieces(texts, PIECE)]
        return pa.array(np.concatenate(found or [np.zeros(0)]).astype(np.float64))

    return docs.where(good(F.concat(F.coalesce(F.col(text_col), F.lit("")), F.lit("\n"))) >= threshold)
