"""The pipeline's stages against brute force."""

import collections
import re

import corpus_pipeline as P
from cofolio.llm import bpe, decontaminate, quality, queries

from .test_operators import SCHEMA, brute_classes, odd_docs


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    assert len(P.STAGES) == 5
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    good = P.good_quality(spark, docs, sf)
    keep = {r.doc_id for r in quality.score(docs, quality.train(docs, labels)).collect() if r.score >= 0.7}
    assert good.columns == names and {r.doc_id for r in good.collect()} == keep
    exact = P.without_exact_copies(spark, docs, sf)
    best = collections.defaultdict(int)
    for r in docs.collect():
        key = re.sub("[A-Z]", lambda m: m[0].lower(), r.text)
        best[key] = max(best[key], r.doc_id)
    assert exact.columns == names and {r.doc_id for r in exact.collect()} == set(best.values())
    near = P.without_near_copies(spark, docs, sf)
    classes = brute_classes([(r.doc_id, r.text) for r in docs.collect()])
    assert near.columns == names and {r.doc_id for r in near.collect()} == set(classes.values())
    clean = P.without_benchmark(spark, docs, sf)
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    dirty = {r.doc_id for r in decontaminate.decontaminate(docs, bench).collect() if r.contaminated}
    assert clean.columns == names and {r.doc_id for r in clean.collect()} == {r.doc_id for r in docs.collect()} - dirty
    assert P.token_ids(spark, docs, sf).count() == docs.count()


def test_run(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, sf)
    want = {tuple(r) for r in bpe.encode_digests(docs, queries.word_bpe_path()).collect()}
    assert {tuple(r) for r in P.run(spark, sf).collect()} == want


def test_odd_and_empty_tables_pass_all_stages(spark, sf):
    for d in (odd_docs(spark), spark.createDataFrame([], SCHEMA)):
        for _, stage in P.STAGES[1:]:
            d.count()
            out = stage(spark, d, sf)
            out.count()
