"""Copies of a large group stay similar, whatever the sizes of table and group."""

import random

from cofolio.llm import near_dedup


def test_copies_of_a_large_group_keep_their_class(spark):
    rng = random.Random(3)
    word = lambda: rng.choice("abcdefgh") + str(rng.randint(0, 10**6))
    base = [word() for _ in range(100)]
    rows = [(0, " ".join(base))]
    for k in range(60):
        copy = list(base)
        copy[10 + k % 30], copy[60 + k % 30] = word(), word()  # 86 shingles of 106 in common
        rows.append((len(rows), " ".join(copy)))
    rows += [(len(rows) + k, " ".join(word() for _ in range(12))) for k in range(940)]
    got = {r.doc_id: r.class_id for r in near_dedup.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[k] == 0 for k in range(61)) and all(got[k] == k for k in range(61, len(rows)))
