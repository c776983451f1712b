"""Operator 11: whitening of embeddings through the exact characteristic polynomial.

Entries are whole numbers (64ths), so the scatter matrix of all distinct vectors is a whole-number matrix.

1. Tasks sum the products of their distinct vectors exactly; Spark adds the cells. Only d * d numbers reach the driver.
2. The characteristic polynomial of that matrix is found modulo many primes, a Spark row each: reduction to
   Hessenberg form, then the recurrence of its leading minors. Chinese remaindering gives the exact whole coefficients.
3. A task for each component isolates its root. All roots are real, so the sign changes of the polynomial's coefficients about
   a point count the roots beyond it exactly (Descartes), with their multiplicity; bisection then goes on by the sign of the polynomial.
4. In the same task, inverse iteration in long decimals finds the null space of the matrix less the root, and so the component.
"""

from __future__ import annotations

import decimal
import math
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import cut

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 16
#: Sums travel as limbs of so many bits, so that their addition in Spark can't overflow.
LIMB_BITS, LIMBS = 40, 5
#: Bits of a root beyond the binary point of the trace's leading bit; decimal digits of inverse iteration.
ROOT_BITS, DIGITS = 200, 90
LONG = 1 << 63


def whole_entries(vector: Column) -> Column:
    """floor(64 * c) of each entry as long, or null for a vector that is null or holds null or non-finite entries."""
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == F.lit(float("inf"))))
    return F.when(~bad, F.transform(vector, lambda c: F.floor(F.lit(SCALE) * c.cast("double"))))


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def add_products(total: np.ndarray, y: np.ndarray) -> None:
    """Adds the exact products of all pairs of columns of whole numbers ``y`` to the Python integers in ``total``."""
    most = max(abs(int(y.max(initial=0))), abs(int(y.min(initial=0))), 1)
    rows = (1 << 53) // (most * most)  # so many products sum exactly in doubles
    if rows:
        for at in range(0, len(y), rows):
            part = y[at : at + rows].astype(np.float64)
            total += (part.T @ part).astype(np.int64).astype(object)
    else:
        part = y.astype(object)
        total += part.T @ part


def _products(d: int):
    """In a task: cells of the product sums of vectors with a 1 appended, as limbs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d + 1, d + 1), object)
        for batch in batches:
            y = _matrix(batch.column(0))
            add_products(total, np.hstack([y, np.ones((len(y), 1), np.int64)]))
        i, j = np.triu_indices(d + 1)
        values, mask = total[i, j].tolist(), (1 << LIMB_BITS) - 1
        parts = [[(v >> LIMB_BITS * k) & mask if k < LIMBS - 1 else v >> LIMB_BITS * k for v in values] for k in range(LIMBS)]
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), *(pa.array(p, pa.int64()) for p in parts)], ["i", "j", *(f"l{k}" for k in range(LIMBS))])

    return run


def product_sums(vectors: DataFrame, d: int) -> np.ndarray:
    """Exact sums over ``vectors(y)`` of products of the entries of (y, 1), as Python integers; d * d numbers."""
    limbs = [f"l{k}" for k in range(LIMBS)]
    cells = vectors.select("y").mapInArrow(_products(d), "i int, j int, " + ", ".join(f"{c} long" for c in limbs))
    out = np.zeros((d + 1, d + 1), object)
    for r in cells.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in limbs]).collect():
        out[r.i, r.j] = out[r.j, r.i] = sum(r[c] << LIMB_BITS * k for k, c in enumerate(limbs))
    return out


def is_prime(n: int) -> bool:
    """Miller-Rabin with bases that decide all n below 3 * 10^9."""
    if n < 2 or any(n % p == 0 for p in (2, 3, 5, 7)):
        return n in (2, 3, 5, 7)
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    return all((x := pow(a, odd, n)) in (1, n - 1) or any((x := x * x % n) == n - 1 for _ in range(twos - 1)) for a in (2, 3, 5, 7))


def primes_for(bits: float) -> list[int]:
    """The largest primes below 2^31 whose product exceeds 2^bits."""
    out, have, n = [], 0.0, (1 << 31) - 1
    while have <= bits:
        if is_prime(n):
            out.append(n)
            have += math.log2(n)
        n -= 2
    return out


def hessenberg(matrix: np.ndarray, p: int) -> np.ndarray:
    """The matrix modulo p, brought to upper Hessenberg form by similarity."""
    h, d = matrix % p, len(matrix)
    for k in range(d - 2):
        below = np.flatnonzero(h[k + 1 :, k])
        if not len(below):
            continue
        at = k + 1 + below[0]
        if at != k + 1:
            h[[k + 1, at]] = h[[at, k + 1]]
            h[:, [k + 1, at]] = h[:, [at, k + 1]]
        times = h[k + 2 :, k] * pow(int(h[k + 1, k]), -1, p) % p
        h[k + 2 :] = (h[k + 2 :] - times[:, None] * h[k + 1] % p) % p
        h[:, k + 1] = (h[:, k + 1] + (h[:, k + 2 :] * times % p).sum(axis=1)) % p
    return h


def polynomial_mod(matrix: np.ndarray, p: int) -> np.ndarray:
    """Coefficients modulo p of det(x - matrix), lowest power first. Entries must be less than 2^31 for products to fit."""
    h, d = hessenberg(matrix, p), len(matrix)
    minors = np.zeros((d + 1, d + 1), np.int64)
    minors[0, 0] = 1
    for k in range(d):
        row = np.roll(minors[k], 1)
        row = (row - h[k, k] * minors[k]) % p
        chain = 1
        for i in range(k - 1, -1, -1):
            chain = chain * int(h[i + 1, i]) % p
            if not chain:
                break
            row = (row - int(h[i, k]) * chain % p * minors[i]) % p
        minors[k + 1] = row
    return minors[d]


def characteristic_polynomial(spark, matrix: np.ndarray) -> list[int]:
    """Exact whole coefficients of det(x - matrix), lowest power first, of a symmetric matrix of integers without negative roots.

    A coefficient is at most (1 + trace / d)^d, as no root is negative. Primes are rows of a DataFrame, so their work is spread.
    """
    d = len(matrix)
    trace = int(sum(matrix[k, k] for k in range(d)))
    primes = primes_for(d * math.log2(2 + Fraction(trace, d)) + 2)
    cells = [str(v) for v in matrix.ravel()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = np.array([int(v) for v in cells], object).reshape(d, d)
        for batch in batches:
            found = [polynomial_mod((whole % p).astype(np.int64), p).tolist() for p in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], ["p", "residues"])

    rows = spark.createDataFrame(pd.DataFrame({"p": primes})).repartition(min(len(primes), 4 * spark.sparkContext.defaultParallelism))
    found = {r.p: r.residues for r in rows.mapInArrow(run, "p long, residues array<long>").collect()}
    product = math.prod(primes)
    shares = {p: (q := product // p) * pow(q, -1, p) for p in primes}
    out = []
    for k in range(d + 1):
        c = sum(found[p][k] * shares[p] for p in primes) % product
        out.append(c - product if c > product // 2 else c)
    return out


def roots_beyond(coefficients: list[int], at: int) -> int:
    """How many roots of a polynomial with real roots only are greater than ``at``, with multiplicity: sign changes of p(x + at)."""
    c = list(coefficients)
    for i in range(len(c) - 1):
        for j in range(len(c) - 2, i - 1, -1):
            c[j] += at * c[j + 1]
    signs = [v > 0 for v in c if v]
    return sum(a != b for a, b in zip(signs, signs[1:], strict=False))


def isolate_root(coefficients: list[int], k: int, trace: int) -> tuple[Fraction, int, int]:
    """The k-th largest root (from 1), rounded up, the number of roots in its last interval and its place among them.

    ``coefficients`` have real, non-negative roots that sum to ``trace``. The interval's width is 2^-ROOT_BITS of the trace's leading bit.
    """
    extra = max(0, ROOT_BITS - trace.bit_length())
    d = len(coefficients) - 1
    scaled = [c << extra * (d - i) for i, c in enumerate(coefficients)]
    low, high, above_low, above_high = -1, trace << extra, d, 0  # root in (low, high]
    while high - low > 1:
        mid = (low + high) >> 1
        if above_low - above_high > 1:
            n = roots_beyond(scaled, mid)
            beyond = n >= k
        else:
            value = 0
            for c in reversed(scaled):
                value = value * mid + c
            beyond = bool(value) and (value > 0) != (k % 2 == 1)  # one root: the sign above it is that of k - 1 roots beyond
            n = above_low if beyond else above_high
        if beyond:
            low, above_low = mid, n
        else:
            high, above_high = mid, n
    return Fraction(high, 1 << extra), above_low - above_high, k - above_high - 1


def null_vectors(matrix: np.ndarray, root: Fraction, count: int) -> np.ndarray:
    """``count`` orthonormal vectors that matrix - root takes to nearly nothing: inverse iteration in decimals of ``DIGITS`` digits."""
    with decimal.localcontext() as context:
        context.prec, context.Emin, context.Emax = DIGITS, -10_000_000, 10_000_000
        d = len(matrix)
        # to decimals of full width first, and by the largest entry so that sizes don't matter
        a = np.array([[decimal.Decimal(int(v)) for v in row] for row in matrix], object)
        for k in range(d):
            a[k, k] -= decimal.Decimal(root.numerator) / root.denominator
        size = max((abs(v) for v in a.ravel()), default=decimal.Decimal(0)) or decimal.Decimal(1)
        tiny, order = size * decimal.Decimal(10) ** (8 - DIGITS), list(range(d))
        for k in range(d):
            at = k + int(np.argmax(np.abs(a[k:, k])))
            if at != k:
                a[[k, at]] = a[[at, k]]
                order[k], order[at] = order[at], order[k]
            if abs(a[k, k]) < tiny:
                a[k, k] = tiny
            a[k + 1 :, k] /= a[k, k]
            a[k + 1 :, k + 1 :] -= np.outer(a[k + 1 :, k], a[k, k + 1 :])
        found = np.array([[decimal.Decimal(((7919 * (i + 1) * (j + 3)) % 1009) - 504) for i in range(d)] for j in range(count)], object)
        for _ in range(4):
            for j in range(count):
                v = found[j][order]
                for k in range(1, d):
                    v[k] -= a[k, :k] @ v[:k]
                for k in range(d - 1, -1, -1):
                    v[k] = (v[k] - (a[k, k + 1 :] @ v[k + 1 :] if k < d - 1 else 0)) / a[k, k]
                v /= max(abs(x) for x in v)
                for _ in range(2):
                    for u in found[:j]:
                        v = v - (u @ v) * u
                found[j] = v / (v @ v).sqrt()
        out = found.astype(np.float64)
    return out * np.sign(out[np.arange(count), np.abs(out).argmax(axis=1)])[:, None]


@dataclass
class Whitening:
    """``n`` distinct vectors with sums of entries ``sums`` (of floor(64 * c)); components in rows, their roots of the scatter matrix."""

    n: int
    sums: list[int]
    trace: int
    roots: list[Fraction]
    vectors: np.ndarray

    @property
    def explained(self) -> list[float]:
        return [float(r / self.trace) for r in self.roots]

    def centred(self, y: np.ndarray) -> np.ndarray:
        """n * y - sums, exact: longs, or Python integers where longs don't hold them."""
        most = max(abs(int(y.max(initial=0))), abs(int(y.min(initial=0))))
        if self.n * most + max(map(abs, self.sums), default=0) < LONG:
            return y * np.int64(self.n) - np.array(self.sums, np.int64)
        return y.astype(object) * self.n - np.array(self.sums, object)

    def project(self, centred: np.ndarray) -> np.ndarray:
        """Whitened values, rows by components."""
        return centred.astype(np.float64) @ (self.vectors / np.sqrt(np.array([float(r) for r in self.roots]))[:, None]).T


def deviation(centred: np.ndarray) -> list[int | None]:
    """Exact sums of squares; none where a long doesn't hold the sum."""
    most = max(abs(int(centred.max(initial=0))), abs(int(centred.min(initial=0))))
    if centred.dtype != object and most * most * max(centred.shape[1], 1) < LONG:
        return (centred * centred).sum(axis=1).tolist()
    return [s if (s := sum(int(v) * int(v) for v in row)) < LONG else None for row in centred]


def fit(vectors: DataFrame, d: int, components: int = COMPONENTS) -> Whitening:
    """Whitening of distinct ``vectors(y)`` of ``d`` entries; of components only those with any variance."""
    spark = vectors.sparkSession
    sums = product_sums(vectors, d)
    n, s = int(sums[d, d]), [int(v) for v in sums[d, :d]]
    scatter = n * sums[:d, :d] - np.outer(np.array(s, object), np.array(s, object))
    trace = int(sum(scatter[k, k] for k in range(d)))
    if not trace:
        return Whitening(n, s, 0, [], np.zeros((0, d)))
    polynomial = characteristic_polynomial(spark, scatter)
    rank = d - next(k for k, c in enumerate(polynomial) if c)  # zero roots are the lowest coefficients that vanish
    cells, wanted = [str(v) for v in scatter.ravel()], min(components, rank)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix = np.array([int(v) for v in cells], object).reshape(d, d)
        for batch in batches:
            ks = batch.column(0).to_pylist()
            roots = [isolate_root(polynomial, k, trace) for k in ks]
            found = [null_vectors(matrix, root, many)[place].tolist() for root, many, place in roots]
            yield pa.RecordBatch.from_arrays([pa.array(ks, pa.int64()), pa.array([f"{r[0].numerator}/{r[0].denominator}" for r in roots]), pa.array(found, pa.list_(pa.float64()))], ["k", "root", "vector"])

    rows = spark.range(1, wanted + 1, numPartitions=wanted).mapInArrow(run, "k long, root string, vector array<double>").collect()
    rows = sorted(rows, key=lambda r: r.k)
    return Whitening(n, s, trace, [Fraction(r.root) for r in rows], np.array([r.vector for r in rows], float).reshape(-1, d))


def identity_error(vectors: DataFrame, model: Whitening) -> float:
    """The largest absolute entry of the whitened vectors' covariance minus the identity."""
    k = len(model.roots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for batch in batches:
            w = model.project(model.centred(_matrix(batch.column(0))))
            total += w.T @ w
        i, j = np.indices((k, k)).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total.ravel())], ["i", "j", "s"])

    cells = vectors.select("y").mapInArrow(run, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
    return max((abs(r.s / model.n - (r.i == r.j)) for r in cells), default=0.0)


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``id_col, component, n, deviation, whitened, explained, identity_error`` of each row and component.

    Rows whose vector is null, or holds null or non-finite entries, are dropped; so are rows of another length than most distinct vectors
    have (of equally frequent lengths the longest is kept). Whole entries saturate at the limits of a long; ``deviation`` is
    null where a long doesn't hold it. Each distinct vector counts once in the fit, so copies and repeated rows don't weigh; each row is returned, of null
    id too. Components without variance are left out, so equal vectors, a single one or an empty table give no row. Components of equal variance are an
    orthonormal basis of their space. Other columns are ignored.
    """
    spark = rows.sparkSession
    kinds = dict(rows.dtypes)
    out = f"{id_col} {kinds[id_col]}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    whole = rows.select(F.col(id_col), whole_entries(F.col(vector_col)).alias("y")).where(F.size("y") > 0)
    fitted = cut(whole.select("y").distinct(), "whitening-fit")
    lengths = fitted.groupBy(F.size("y").alias("d")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), F.desc("d")).limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], out)
    d = lengths[0].d
    fitted = fitted.where(F.size("y") == d)
    model = fit(fitted, d, components)
    if not model.roots:
        return spark.createDataFrame([], out)
    error, k, explained = identity_error(fitted, model), len(model.roots), model.explained

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for at in range(0, whole_batch.num_rows, 2048):
                batch = whole_batch.slice(at, 2048)
                m = batch.num_rows
                centred = model.centred(_matrix(batch.column(1)))
                each = pa.array(np.repeat(np.arange(m), k))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.n, np.int64)),
                        pa.array(deviation(centred), pa.int64()).take(each), pa.array(model.project(centred).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error)),
                    ],
                    [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return whole.where(F.size("y") == d).mapInArrow(run, out)
