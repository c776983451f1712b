"""Operators 11 to 13 against brute force, and their odd cases."""

import collections
import itertools
import math
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
import xxhash
from cofolio.llm import queries, simhash, spelling, whitening

from .test_operators import SCHEMA, no_docs, odd_docs

VECTORS = "vec_id long, embedding array<float>, label int, y string, component int, n long"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "y", 2, 3) for i, v in rows], VECTORS)


def brute_whitening(rows):
    """Rows, whole entries of distinct vectors, eigenvalues and eigenvectors by numpy."""
    whole = [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in whole}), object)
    n, sums = len(fit), fit.sum(axis=0)
    centred = (fit * n - sums).astype(float) / n
    values, columns = np.linalg.eigh(centred.T @ centred / n)
    return whole, n, sums, values[::-1], columns[:, ::-1]


def assert_whitened(got, rows, components=16):
    whole, n, sums, values, columns = brute_whitening(rows)
    k = min(components, int((values > 1e-9 * values.sum()).sum()))
    assert len(got) == k * len(whole)
    of = collections.defaultdict(dict)
    for r in got:
        of[r.vec_id][r.component] = r
    for i, x in whole:
        centred = np.array([n * a - int(s) for a, s in zip(x, sums, strict=True)], object)
        for c in range(1, k + 1):
            r = of[i][c]
            assert r.n == n and r.deviation == sum(v * v for v in centred) and r.identity_error < 1e-9
            assert math.isclose(r.explained, values[c - 1] / values.sum(), rel_tol=1e-9)
            want = float(centred.astype(float) / n @ columns[:, c - 1]) / math.sqrt(values[c - 1])
            assert math.isclose(abs(r.whitened), abs(want), rel_tol=1e-6, abs_tol=1e-6)


def test_whitening_of_the_table(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert_whitened(queries.op11_whitening(spark, sf).collect(), rows)


def test_whitening_of_odd_vectors(spark):
    rng = random.Random(3)
    good = [(k, [rng.gauss(0, 3), rng.gauss(5, 1), 1.0, rng.gauss(-2, 9)]) for k in range(40)]
    rows = [*good, *[(100 + k, good[0][1]) for k in range(30)], (200, None), (201, [1.0, None, 2.0, 3.0]), (202, [1.0, float("nan"), 2.0, 3.0]), (203, [float("inf"), 1.0, 2.0, 3.0])]
    odd = [*rows, (300, []), (301, [1.0]), (302, [1.0, 2.0])]
    assert_whitened(whitening.whiten(vectors(spark, odd)).collect(), rows)  # a constant dimension: three components
    assert whitening.whiten(vectors(spark, [])).collect() == []
    assert whitening.whiten(vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, None)])).collect() == []
    got = whitening.whiten(vectors(spark, [(None, [1.0, 2.0]), (2, [3.0, 1.0])])).collect()
    assert [r.component for r in got] == [1, 1] and sorted(r.whitened for r in got) == pytest.approx([-1, 1]) and {r.vec_id for r in got} == {None, 2}


def test_huge_entries_stay_exact(spark):
    rows = [(k, [float(np.float32(v)) for v in x]) for k, x in enumerate([(1e12, 3.0), (-1e12, 5.0), (2e12, -7.0), (5e11, 11.0)])]
    got = whitening.whiten(vectors(spark, rows)).collect()
    whole, n, sums, _, _ = brute_whitening(rows)
    want = {i: sum((n * a - int(s)) ** 2 for a, s in zip(x, sums, strict=True)) for i, x in whole}
    assert {r.vec_id: r.deviation for r in got} == {i: d if d < 1 << 63 else None for i, d in want.items()} and len(got) == 8
    assert got[0].identity_error < 1e-9
    assert {r.deviation for r in whitening.whiten(vectors(spark, [(1, [3e38, 0.0]), (2, [-3e38, 1.0])])).collect()} == {None}


def test_equal_roots(spark):
    """Corners of a cube: every direction has the same variance, so the components are some orthonormal basis."""
    rows = [(k, [float(x) for x in c]) for k, c in enumerate(itertools.product([0, 1], repeat=4))]
    got = whitening.whiten(vectors(spark, rows)).collect()
    assert {r.component for r in got} == {1, 2, 3, 4} and all(abs(r.explained - 0.25) < 1e-15 and r.identity_error < 1e-12 for r in got)


def test_polynomial_roots_and_null_space(spark):
    rng = np.random.default_rng(4)
    a = rng.integers(-9, 10, (6, 4))
    m = (a @ a.T).astype(object)  # rank 4
    p = whitening.characteristic_polynomial(spark, m)
    assert p[6] == 1 and p[0] == p[1] == 0 and p[2] != 0
    for x in range(7):  # det(x - m), by fractions
        f = [[Fraction(int(x * (i == j) - m[i][j])) for j in range(6)] for i in range(6)]
        det = Fraction(1)
        for k in range(6):
            at = next((i for i in range(k, 6) if f[i][k]), None)
            if at is None:
                det = Fraction(0)
                break
            if at != k:
                f[k], f[at], det = f[at], f[k], -det
            det *= f[k][k]
            for i in range(k + 1, 6):
                t = f[i][k] / f[k][k]
                f[i] = [u - t * v for u, v in zip(f[i], f[k], strict=True)]
        assert sum(c * x**k for k, c in enumerate(p)) == det
    assert whitening.roots_beyond([-6, 11, -6, 1], 0) == 3 and whitening.roots_beyond([-6, 11, -6, 1], 2) == 1  # roots 1, 2, 3
    assert whitening.isolate_root([-6, 11, -6, 1], 2, 6)[0] == 2
    twice = [-12, 16, -7, 1]  # roots 2, 2, 3
    assert [whitening.isolate_root(twice, k, 7) for k in (1, 2, 3)] == [(3, 1, 0), (2, 2, 0), (2, 2, 1)]
    v = whitening.null_vectors(np.diag([2, 3, 2]).astype(object), Fraction(2), 2)
    assert np.allclose(v @ v.T, np.eye(2), atol=1e-15) and np.allclose(v[:, 1], 0, atol=1e-15)


# ---- 12


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    parts = [" ".join(words[k : k + 3]) for k in range(max(len(words) - 2, min(len(words), 1)))]
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints):
    """Smallest id reachable, over (id, fingerprint)."""
    up = list(range(len(prints)))

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for a, b in itertools.combinations(range(len(prints)), 2):
        if (prints[a][1] ^ prints[b][1]).bit_count() <= 2:
            up[root(b)] = root(a)
    low = {}
    for k, (i, _) in enumerate(prints):
        low[root(k)] = min((x for x in (i, low.get(root(k))) if x is not None), default=None)
    return [low[root(k)] for k in range(len(prints))]


def test_simhash_of_the_table(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    prints = [(i, brute_fingerprint(t)) for i, t in rows]
    want = sorted((i, f"{f:016x}", c) for (i, f), c in zip(prints, brute_components(prints), strict=True))
    assert sorted(map(tuple, queries.op12_simhash_planes(spark, sf).collect())) == want
    assert len({c for _, _, c in want}) < len(want)


def test_simhash_of_odd_rows(spark):
    rows = odd_docs(spark)
    prints = [(r.doc_id, brute_fingerprint(r.text)) for r in rows.collect()]
    want = sorted(((i, f"{f:016x}", c) for (i, f), c in zip(prints, brute_components(prints), strict=True)), key=str)
    assert sorted(map(tuple, simhash.near_components(rows).collect()), key=str) == want
    assert simhash.near_components(no_docs(spark)).collect() == []
    nulls = spark.createDataFrame([(None, "one two three four")] * 3, "doc_id long, text string")
    assert {r.component_id for r in simhash.near_components(nulls).collect()} == {None}


@pytest.mark.parametrize("bucket", [2048, 4, 2])
def test_links_lose_nothing(spark, bucket):
    """Dense neighbourhoods, far ones, and buckets that are dealt anew."""
    rng = random.Random(bucket)
    seeds = [rng.getrandbits(64) for _ in range(12)] + [0, (1 << 64) - 1]
    prints = {s ^ sum({1 << rng.randrange(64) for _ in range(rng.randrange(5))}) for s in seeds for _ in range(30)}
    prints |= {sum(1 << b for b in bits) for bits in itertools.combinations(range(0, 64, 9), 3)}
    prints = sorted((k - (1 << 64) if k >> 63 else k, k) for k in prints)
    got = simhash.close_links(spark.createDataFrame([(s,) for s, _ in prints], "bits long"), bucket).collect()
    bits = dict(prints)
    assert len(got) < 4 * 216 * len(prints)
    linked = [(r.a, r.b) for r in got]
    up = {s: s for s in bits}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in linked:
        up[root(a)] = root(b)
    want = brute_components([(s, f) for s, f in prints])
    groups, found = collections.defaultdict(set), collections.defaultdict(set)
    for (s, _), c in zip(prints, want, strict=True):
        groups[c].add(s)
        found[root(s)].add(s)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, found.values()))


def test_planes_find_just_the_close_pairs():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fp = np.concatenate([base[k] ^ (np.uint64(1) << rng.integers(0, 64, 25).astype(np.uint64)) for k in range(40)] + [base])
    end = np.where(np.arange(len(fp)) < 700, 700, len(fp))
    got = sorted((int(i), int(j)) for a, b in simhash.close_pairs(fp, end, list(range(64))) for i, j in zip(a, b, strict=True))
    assert got == [(i, j) for i in range(len(fp)) for j in range(i + 1, int(end[i])) if int(fp[i] ^ fp[j]).bit_count() <= 2]


# ---- 13


def brute_spelling(rows):
    n = collections.Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                n[run] += 1
    n = {w: c for w, c in n.items() if c >= 2}
    letters = {c for w in n for c in w}

    def around(w):
        out = {w[:k] + w[k + 1 :] for k in range(len(w))}
        out |= {w[:k] + c + w[k:] for k in range(len(w) + 1) for c in letters} | {w[:k] + c + w[k + 1 :] for k in range(len(w)) for c in letters}
        return (out & n.keys()) - {w}

    near = {w: around(w) for w in n if len(w) < 1000}
    form = {w: f for w, ws in near.items() if ws and n[f := min(ws, key=lambda x: (-n[x], x))] >= 10 * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w) or "", root(w), n[w], len(near.get(w, ())), n[form[w]] if w in form else -1) for w in n)


def plain(df):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, -1 if r.form_n is None else r.form_n) for r in df.collect())


@pytest.mark.parametrize("tile", [1024, 3])
def test_spelling_of_the_table(spark, tile):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = brute_spelling([(r.doc_id, r.text) for r in docs.collect()])
    assert plain(spelling.spelling_variants(docs, tile=tile)) == want
    assert sum(w[1] != "" for w in want) > 100


def test_spelling_of_odd_rows(spark):
    rows = odd_docs(spark)
    assert plain(spelling.spelling_variants(rows)) == brute_spelling([(r.doc_id, r.text) for r in rows.collect()])
    assert spelling.spelling_variants(no_docs(spark)).collect() == []


@pytest.mark.parametrize("tile", [1024, 4, 1])
def test_chains_ties_and_repeats(spark, tile):
    many = collections.Counter({"abcdefg": 500, "abcdefgh": 40, "abcdefghi": 3, "xbcdefg": 3, "aaaaaaa": 4, "aaaaaaaa": 40, "aaaaaaaaa": 4, "bbbbbbbb": 4, "bbbbbbbx": 50, "bbbbbbba": 50, "Éabcdefg": 2, "éabcdefg": 2})
    many.update({"q" * k + c + "r" * (12 - k): 2 for k in range(12) for c in "abcdefgh"})
    rows = [(k, " ".join([w] * n)) for k, (w, n) in enumerate(many.items())]
    docs = spark.createDataFrame([(i, t, None, None, 1, "s", 1, "v", 1, 1) for i, t in rows], SCHEMA)
    assert plain(spelling.spelling_variants(docs, tile=tile)) == brute_spelling(rows)
    roots = {r.word: r.root for r in spelling.spelling_variants(docs, tile=tile).collect()}
    assert roots.get("abcdefghi", "abcdefg") == "abcdefg"
