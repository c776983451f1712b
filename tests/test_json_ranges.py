"""Documents cut into small ranges, against the parser of the standard library."""

import json

import pytest
from pyspark.sql import functions as F

from cofolio.sources import json_ranges, readers

USERS = [
    {"userId": f'u"{k}\\', "ratings": [{"animeId": k + j, "title": 'a [b], {"c": 1} \\" é' * (k % 3), "rawScore": 5 + j, "normalizedScore": j / 2} for j in range(k % 5)]} for k in range(40)
]


def flat(path):
    """What ``members`` should give, by a whole parse."""
    out, decoder, text, at, document = [], json.JSONDecoder(), path.read_text(), 0, 0
    while text[at:].strip():
        at += len(text[at:]) - len(text[at:].lstrip())
        top, at = decoder.raw_decode(text, at)
        document += 1
        for key, value in top.items():
            out += [(document, key, k, json.dumps(v)) for k, v in enumerate(value)] if isinstance(value, list) else [(document, key, None, json.dumps(value))]
    return sorted(out, key=repr)


@pytest.mark.parametrize("size", [3, 64, 1 << 20])
def test_ranges_are_the_whole_parse(spark, tmp_path, monkeypatch, size):
    monkeypatch.setattr(json_ranges, "WHOLE_BYTES", 0)
    monkeypatch.setattr(json_ranges, "RANGE_BYTES", size)
    odd = {"a": [], "b\\": [[1, [2, "]"]], [], {"x": [3]}], 'c"\\"': "\\\\\"[{", "d": {"e": [1, 2], "f": {"g": ","}}, "h": [1, -2.5e3, None, True, "t"], "k": 7, "": [""], "n": {}}
    few = odd if size < 64 else {**odd, "users": USERS}
    folder = tmp_path / "in put"
    folder.mkdir()
    (folder / "a.json").write_text(json.dumps(few))
    (folder / "b.json").write_text(json.dumps(few, indent=3))
    (folder / "c.json").write_text("".join(json.dumps(d) + "\n" for d in (few, {}, {"a": [1]}, few)))
    (folder / "empty.json").write_text("")
    ranges = json_ranges.Ranges(spark, str(folder))
    got = ranges.members().withColumn("file", F.element_at(F.split("file", "/"), -1)).collect()
    for name in ("a.json", "b.json", "c.json"):
        mine = sorted(((r.document, r.key, r.pos, json.dumps(json.loads(r.value))) for r in got if r.file == name), key=repr)
        assert mine == flat(folder / name)
    assert ranges.broken == [] and {r.key for r in ranges.members(["h"]).collect()} == {"h"}


def test_unclosed_files_are_named(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(json_ranges, "WHOLE_BYTES", 0)
    (tmp_path / "a.json").write_text('{"a": [1, 2')
    (tmp_path / "b.json").write_text('{"a": [1, 2]}')
    ranges = json_ranges.Ranges(spark, str(tmp_path))
    assert [f.rsplit("/", 1)[1] for f in ranges.broken] == ["a.json"]
    assert [(r.key, r.pos, r.value) for r in ranges.members().orderBy("pos").collect()] == [("a", 0, "1"), ("a", 1, "2")]


def _rows(df):
    return sorted((json.dumps(r.asDict(True), sort_keys=True) for r in df.collect()))


def test_readers_give_the_same_from_ranges(spark, tmp_path, monkeypatch):
    legacy = {"users": USERS}
    compact = {"format": "ratings-compact-v1", "anime": [[str(k), f"t{k}"] for k in range(9)], "users": [[f"u{k}", json.dumps([[j, 5.0, 0.5] for j in range(k % 11)])] for k in range(20)]}
    compact["users"] = [[a, json.loads(b)] for a, b in compact["users"]]
    graph = {"format": "g", "userIds": ["x", "y"], "anime": [["1", "a"], ["2", "b"]], "ua": [[0, 1, 0.5], [1, 0, 0.25], [5, 0, 1]], "aa": [[0, 1, 0.75]]}
    edges = {"nodes": [{"id": "n"}], "edges": [{"id": "e", "source": f"s{k}", "target": "t", "edgeType": "q", "weight": k / 4} for k in range(30)]}
    model = {"format": "m", "globalMean": 0.5, "animeIds": list(range(12)), "titles": [f"t{k}" for k in range(11)], "biases": [k / 8 for k in range(12)], "embeddings": [[k / 2, 1.0] for k in range(12)]}
    old = {"globalMean": 0.5, "anime": [{"animeId": k, "title": f"t{k}", "bias": 0.5, "embedding": [1.0, k / 4]} for k in range(7)]}
    content = {str(k): {"title": f"t{k}", "year": 1990 + k, "score": 7.5, "genres": [" Drama ", "drama"], "studios": None} for k in range(25)}
    cases = [(readers.open_ratings, legacy), (readers.open_ratings, compact), (readers.compact_graph, graph), (readers.legacy_graph, edges), (readers.model, model), (readers.model, old), (readers.content_features, content)]
    for k, (read, document) in enumerate(cases):
        (tmp_path / f"{k}.json").write_text(json.dumps(document, indent=k % 2))
        monkeypatch.setattr(json_ranges, "WHOLE_BYTES", 1 << 20)
        whole = _rows(read(spark, f"{tmp_path}/{k}.json"))
        monkeypatch.setattr(json_ranges, "WHOLE_BYTES", 0)
        monkeypatch.setattr(json_ranges, "RANGE_BYTES", 401)
        assert _rows(read(spark, f"{tmp_path}/{k}.json")) == whole and whole, k


def test_unclosed_lines_are_read_as_before(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(json_ranges, "WHOLE_BYTES", 0)
    (tmp_path / "a.json").write_text("".join(json.dumps({"users": [u]}) + "\n" for u in USERS) + '{"users": [\n')
    assert readers.open_ratings(spark, str(tmp_path)).count() == sum(len(u["ratings"]) for u in USERS)


def test_one_document_is_read_in_several_tasks(spark, tmp_path, monkeypatch):
    """A document of some 70 MB with the limits as they are."""
    user = json.dumps({"userId": "u", "ratings": [{"animeId": 1, "title": "t" * 9_000, "rawScore": 5, "normalizedScore": 1}]})
    n = 7_600
    with open(tmp_path / "a.json", "w") as f:
        f.write('{"users": [' + ",\n".join([user] * n) + "]}")
    assert (tmp_path / "a.json").stat().st_size > json_ranges.WHOLE_BYTES
    members = json_ranges.Ranges(spark, str(tmp_path)).members()
    tasks = members.groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in tasks) == n and len(tasks) > 2
    assert readers.legacy_ratings(spark, str(tmp_path)).where("not rejected").count() == n
