"""Model documents are taken apart entry by entry."""

from cofolio.sources import readers, writers


def test_no_entry_carries_its_whole_document(spark, tmp_path):
    """An exploded row holds its own entry: nothing of the document stands beside it, or 10 000 entries are 10 000 copies of all arrays."""
    model = spark.createDataFrame([(k, f"v{k}", 0.5, [k / 4, 1.0]) for k in range(5)], "item_id long, title string, bias double, q array<double>")
    writers.write_web_model(model, f"{tmp_path}/model")
    got = readers.model(spark, f"{tmp_path}/model")
    assert got.count() == 5
    exploded = [line for line in got._jdf.queryExecution().sparkPlan().toString().splitlines() if "Generate posexplode" in line]
    assert exploded and all("], false, [pos" not in line for line in exploded)
    (tmp_path / "odd").mkdir()
    (tmp_path / "odd" / "a.json").write_text('{"animeIds": [1, 2, 3], "titles": ["a", "b"], "biases": [1, 2, 3], "embeddings": [[1], [2], [3]]}\n{"animeIds": [9], "titles": [], "biases": [1], "embeddings": [[1]]}\n{"animeIds": [8], "biases": [1]}\n')
    assert sorted(r.item_id for r in readers.model(spark, f"{tmp_path}/odd").collect()) == [1, 2]
