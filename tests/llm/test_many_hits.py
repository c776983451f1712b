"""A long text full of a benchmark passage: its hits don't each hold the whole text."""

import random

from cofolio.llm import decontaminate


def test_a_long_text_of_one_passage(spark):
    rng = random.Random(5)
    word = lambda: rng.choice("abcdefgh") + str(rng.randint(0, 10**6))
    passage = [word() for _ in range(40)]
    rows = [(0, " ".join(passage * 500)), (1, " ".join(word() for _ in range(500)))]
    bench = spark.createDataFrame([(7, " ".join(passage))], "item_id long, text string")
    got = decontaminate.decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()
    assert {r.doc_id: r["items"] for r in got} == {0: [7], 1: []}
