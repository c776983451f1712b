"""Readers of rating, graph, model and metadata files, with explicit schemas and tolerant casts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cofolio.functions.scalars import BLANKS, unicode_trim
from cofolio.sources.json_ranges import Ranges, is_large

LIST_ENTRY = "anime_id string, anime_title string, score string"
LEGACY_RATINGS = "users array<struct<userId: string, ratings: array<struct<animeId: string, title: string, rawScore: string, normalizedScore: string>>>>"
COMPACT_RATINGS = "format string, part int, anime array<array<string>>, users array<array<string>>"
LEGACY_GRAPH = "nodes array<struct<id: string, label: string, nodeType: string>>, edges array<struct<id: string, source: string, target: string, edgeType: string, weight: double>>"
COMPACT_GRAPH = "format string, part int, userIds array<string>, anime array<array<string>>, ua array<array<double>>, aa array<array<double>>"
MODEL = "format string, globalMean double, factors int, animeIds array<double>, titles array<string>, biases array<double>, embeddings array<array<double>>, anime array<struct<animeId: double, title: string, bias: double, embedding: array<double>>>"


class _Documents:
    """The JSON documents of a path's files. Files up to ``WHOLE_BYTES``, compressed and unclosed ones are parsed document by document, larger ones in byte ranges."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.ranges = spark, path, Ranges(spark, path)

    def _small(self, files: DataFrame) -> DataFrame:
        if not self.ranges.any:
            return files
        file = F.col("_metadata.file_path")
        return files.where(~is_large(file, F.col("_metadata.file_size")) | file.isin(self.ranges.broken))

    def parsed(self, schema: str) -> DataFrame:
        """All documents of the smaller files with their ``file``: a document a line, or one document over a whole file (most of whose lines
        aren't documents)."""
        parsed = F.from_json("value", schema + ", _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("d")
        lines = self._small(self.spark.read.text(self.path)).where("trim(value) <> ''").select(parsed, F.col("_metadata.file_path").alias("file")).select("d.*", "file")
        bad = F.count_if(F.col("_bad").isNotNull())
        kinds = lines.groupBy("file").agg((bad > F.count("*") - bad).alias("whole"))
        single = kinds.where("whole").select("file")
        whole = self._small(self.spark.read.schema(schema).option("multiLine", True).json(self.path)).select("*", F.col("_metadata.file_path").alias("file"))
        return lines.where("_bad is null").drop("_bad").join(single, "file", "left_anti").unionByName(whole.join(single, "file", "left_semi"))

    def elements(self, schema: str, name: str) -> DataFrame:
        """``file, part, pos, e``: the elements of one array of every document; documents of a file differ by ``part`` (0 where they have none)."""
        part = F.coalesce("part", F.lit(0)) if " part " in f" {schema} ".replace(",", " ") else F.lit(0)
        small = self.parsed(schema).select("file", part.cast("bigint").alias("part"), F.posexplode(name).alias("pos", "e"))
        return small.unionByName(self._cut_out(schema, name)) if self.ranges.any else small

    def _cut_out(self, schema: str, name: str) -> DataFrame:
        """``elements`` of the larger files."""
        kind = StructType.fromDDL(schema)[name].dataType.elementType
        element = F.from_json(F.concat(F.lit('{"e":'), "value", F.lit("}")), StructType().add("e", kind))["e"]
        return self.ranges.members([name]).where("pos is not null").select("file", F.col("document").alias("part"), F.col("pos").cast("int").alias("pos"), element.alias("e"))


def _finite(c):
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def list_pages(spark: SparkSession, path: str) -> DataFrame:
    """Landed list pages (JSON lines): ``item_id, title, score, file``."""
    raw = spark.read.schema(LIST_ENTRY).json(path)
    return raw.select(F.col("anime_id").try_cast("bigint").alias("item_id"), F.col("anime_title").alias("title"), F.col("score").try_cast("double").alias("score"), F.col("_metadata.file_path").alias("file"))


def legacy_ratings(spark: SparkSession, path: str) -> DataFrame:
    """``user_id, item_id, title, raw_score, normalized_score, rejected``; entries with blank users or without a whole item id or a
    centred score that is a number are marked, not lost."""
    return _legacy_ratings(_Documents(spark, path))


def _legacy_ratings(docs: _Documents) -> DataFrame:
    users = docs.elements(LEGACY_RATINGS, "users").withColumnRenamed("e", "u").select(unicode_trim(F.col("u.userId")).alias("user_id"), F.explode("u.ratings").alias("r"))
    item, centred = F.col("r.animeId").try_cast("bigint"), F.col("r.normalizedScore").try_cast("double")
    return users.select(
        "user_id", item.alias("item_id"), F.coalesce("r.title", F.concat(F.lit("Anime "), item.cast("string"))).alias("title"),
        F.col("r.rawScore").try_cast("double").alias("raw_score"), centred.alias("normalized_score"),
        ((F.coalesce("user_id", F.lit("")) == "") | item.isNull() | ~F.coalesce(_finite(centred), F.lit(False))).alias("rejected"),
    )


def compact_ratings(spark: SparkSession, path: str) -> DataFrame:
    """The same columns from the dictionary-encoded form, each document by its own dictionary; indexes keep their written positions, bad dictionary rows are marked."""
    return _compact_ratings(_Documents(spark, path))


def _compact_ratings(docs: _Documents) -> DataFrame:
    items = docs.elements(COMPACT_RATINGS, "anime").select("file", "part", F.col("pos").alias("idx"), F.get("e", F.lit(0)).try_cast("bigint").alias("item_id"), F.get("e", F.lit(1)).alias("title"))
    users = docs.elements(COMPACT_RATINGS, "users").withColumnRenamed("e", "u").select("file", "part", F.get("u", F.lit(0)).alias("user_id"), F.explode(F.from_json(F.get("u", F.lit(1)), "array<array<double>>")).alias("t"))
    cells = users.select("file", "part", "user_id", F.get("t", F.lit(0)).cast("int").alias("idx"), F.get("t", F.lit(1)).alias("raw_score"), F.get("t", F.lit(2)).alias("normalized_score"))
    joined = cells.join(items, ["file", "part", "idx"], "left")
    bad = (F.coalesce("user_id", F.lit("")) == "") | F.col("item_id").isNull() | ~_finite(F.col("raw_score"))
    return joined.select("user_id", "item_id", F.coalesce("title", F.concat(F.lit("Anime "), F.col("item_id").cast("string"))).alias("title"), "raw_score", "normalized_score", bad.alias("rejected"))


def open_ratings(spark: SparkSession, path: str) -> DataFrame:
    """Either form, by the file's ``format`` tag."""
    docs = _Documents(spark, path)
    tags = docs.parsed("format string").select("format")
    if docs.ranges.any:
        tags = tags.unionByName(docs.ranges.members(["format"]).select(F.from_json(F.concat(F.lit('{"e":'), "value", F.lit("}")), "e string")["e"].alias("format")))
    return _compact_ratings(docs) if tags.select(F.max("format")).first()[0] == "ratings-compact-v1" else _legacy_ratings(docs)


def legacy_graph(spark: SparkSession, path: str) -> DataFrame:
    """``source, target, edge_type, weight``."""
    return _Documents(spark, path).elements(LEGACY_GRAPH, "edges").select("e.source", "e.target", F.col("e.edgeType").alias("edge_type"), "e.weight")


def compact_graph(spark: SparkSession, path: str) -> DataFrame:
    """``source, target, edge_type, weight`` with node names rebuilt, each document by its own dictionary; edges of unknown positions are dropped."""
    docs = _Documents(spark, path)
    users = docs.elements(COMPACT_GRAPH, "userIds").select("file", "part", F.col("pos").alias("ui"), F.concat(F.lit("user:"), "e").alias("user"))
    items = docs.elements(COMPACT_GRAPH, "anime").select("file", "part", F.col("pos").alias("ai"), F.concat(F.lit("anime:"), F.get("e", F.lit(0))).alias("item"))
    cell = lambda name: docs.elements(COMPACT_GRAPH, name).select("file", "part", F.get("e", F.lit(0)).cast("int").alias("x"), F.get("e", F.lit(1)).cast("int").alias("y"), F.get("e", F.lit(2)).alias("weight"))
    ua = cell("ua").join(users.withColumnRenamed("ui", "x"), ["file", "part", "x"]).join(items.withColumnRenamed("ai", "y"), ["file", "part", "y"]).select(F.col("user").alias("source"), F.col("item").alias("target"), F.lit("user-anime").alias("edge_type"), "weight")
    left, right = items.select("file", "part", F.col("ai").alias("x"), F.col("item").alias("source")), items.select("file", "part", F.col("ai").alias("y"), F.col("item").alias("target"))
    aa = cell("aa").join(left, ["file", "part", "x"]).join(right, ["file", "part", "y"]).select("source", "target", F.lit("anime-anime").alias("edge_type"), "weight")
    return ua.unionByName(aa)


def model(spark: SparkSession, path: str) -> DataFrame:
    """``item_id, title, bias, q`` of either model form: as many rows as the shortest array, only finite numbers and
    whole embeddings; of repeated ids the last counts."""
    docs = _Documents(spark, path)
    doc = docs.parsed(MODEL)
    n = F.greatest(F.least(F.size("animeIds"), F.size("titles"), F.size("biases"), F.size("embeddings")), F.lit(0))
    # cut before it is exploded: a column of the document beside the entries would copy its whole arrays into each row
    zipped = doc.where("animeIds is not null").select(F.posexplode(F.slice(F.arrays_zip("animeIds", "titles", "biases", "embeddings"), F.lit(1), n)).alias("pos", "z"))
    compact = zipped.select("pos", F.col("z.animeIds").alias("id"), F.col("z.titles").alias("title"), F.col("z.biases").alias("bias"), F.col("z.embeddings").alias("q"))
    legacy = doc.where("animeIds is null").select(F.posexplode("anime").alias("pos", "z")).select("pos", F.col("z.animeId").alias("id"), F.col("z.title").alias("title"), F.col("z.bias").alias("bias"), F.col("z.embedding").alias("q"))
    both = compact.unionByName(legacy)
    if docs.ranges.any:
        place = ["file", "part", "pos"]
        columns = [docs._cut_out(MODEL, c).withColumnRenamed("e", name) for c, name in (("animeIds", "id"), ("titles", "title"), ("biases", "bias"), ("embeddings", "q"))]
        ids = columns[0]
        for c in columns[1:]:
            columns[0] = columns[0].join(c, place)
        entries = docs._cut_out(MODEL, "anime").join(ids.select("file", "part").distinct(), ["file", "part"], "left_anti")
        both = both.unionByName(columns[0].select("pos", "id", "title", "bias", "q"))
        both = both.unionByName(entries.select("pos", F.col("e.animeId").alias("id"), "e.title", "e.bias", F.col("e.embedding").alias("q")))
    fine = both.where(_finite(F.col("id")) & _finite(F.col("bias")) & (F.size("q") > 0) & F.forall("q", _finite))
    return fine.groupBy(F.col("id").cast("long").alias("item_id")).agg(*[F.max_by(c, "pos").alias(c) for c in ("title", "bias", "q")])


def content_features(spark: SparkSession, path: str) -> DataFrame:
    """A JSON map of id to entry: ``item_id, title, year, score, genres, studios`` with names trimmed, lower case, once each."""
    fields = "title: string, year: string, score: string, genres: array<string>, studios: array<string>"
    docs = _Documents(spark, path)
    entry = F.from_json("value", f"map<string, struct<{fields}>>").alias("m")
    lines = docs._small(spark.read.text(path)).where("trim(value) <> ''").select(entry, F.col("_metadata.file_path").alias("file"))
    # a map a line, or one map over a whole file (most of whose lines aren't maps)
    single = lines.groupBy("file").agg((F.count_if(F.col("m").isNull()) > F.count("m")).alias("whole")).where("whole").select("file")
    whole = docs._small(spark.read.text(path, wholetext=True)).select(entry, F.col("_metadata.file_path").alias("file"))
    raw = lines.join(single, "file", "left_anti").unionByName(whole.join(single, "file", "left_semi")).select(F.explode("m").alias("id", "e"))
    if docs.ranges.any:
        raw = raw.unionByName(docs.ranges.members().where("pos is null").select(F.col("key").alias("id"), F.from_json("value", f"struct<{fields}>").alias("e")))
    names = lambda c: F.array_distinct(F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.lower(F.trim(x))), lambda x: x != ""))
    return raw.select(F.col("id").try_cast("bigint").alias("item_id"), "e.title", F.col("e.year").try_cast("int").alias("year"), F.col("e.score").try_cast("double").alias("score"), names(F.col("e.genres")).alias("genres"), names(F.col("e.studios")).alias("studios")).where("item_id is not null")


def metadata_payloads(payloads: DataFrame) -> DataFrame:
    """``item_id, title, year, score, season, genres, studios, synopsis, image_url`` of ``item_id, fallback, payload`` (JSON)."""
    image = "struct<large_image_url: string, image_url: string>"
    schema = f"struct<data: struct<title: string, synopsis: string, year: double, score: double, season: string, genres: array<struct<name: string>>, studios: array<struct<name: string>>, images: struct<webp: {image}, jpg: {image}>>>"
    got = payloads.select("item_id", "fallback", F.from_json("payload", schema)["data"].alias("d")).where("d is not null")
    text = lambda c: F.nullif(F.trim(c), F.lit(""))
    names = lambda c: F.array_distinct(F.filter(F.transform(F.coalesce(c, F.array().cast("array<struct<name:string>>")), lambda x: unicode_trim(x["name"])), lambda x: x.isNotNull() & (x != "")))
    url = F.coalesce(*[F.nullif(F.col(f"d.images.{k}.{f}"), F.lit("")) for k in ("webp", "jpg") for f in ("large_image_url", "image_url")], F.lit(""))
    return got.select(
        "item_id", F.when(text(F.col("d.title")).isNotNull(), F.col("d.title")).otherwise(F.col("fallback")).alias("title"), F.col("d.year").cast("int").alias("year"), F.col("d.score").alias("score"), F.col("d.season").alias("season"),
        names(F.col("d.genres")).alias("genres"), names(F.col("d.studios")).alias("studios"), unicode_trim(F.coalesce("d.synopsis", F.lit(""))).alias("synopsis"), url.alias("image_url"),
    )


def seasonal(payloads: DataFrame) -> DataFrame:
    """``item_id, title, year, score, pos`` of a season's list (``payload`` JSON with ``data``); blank titles and ids below 1 are dropped."""
    entry = F.from_json("payload", "struct<data: array<struct<mal_id: string, title: string, year: string, score: string>>>")
    rows = payloads.select(F.posexplode(entry["data"]).alias("pos", "e"))
    return rows.select(F.col("e.mal_id").try_cast("bigint").alias("item_id"), unicode_trim(F.col("e.title")).alias("title"), F.col("e.year").try_cast("int").alias("year"), F.col("e.score").try_cast("double").alias("score"), "pos").where("item_id > 0 and title <> ''")


def imported_lists(payloads: DataFrame) -> DataFrame:
    """``user_id, item_id, score`` of nested import lists (``payload`` JSON), scores and ids above 0."""
    lists = F.from_json("payload", "struct<lists: array<struct<entries: array<struct<mediaId: string, score: string>>>>>")["lists"]
    rows = payloads.select("user_id", F.explode(lists).alias("l")).select("user_id", F.explode("l.entries").alias("e"))
    return rows.select("user_id", F.col("e.mediaId").try_cast("bigint").alias("item_id"), F.col("e.score").try_cast("double").alias("score")).where("item_id > 0 and score > 0")


def bulk_lines(texts: DataFrame) -> DataFrame:
    """``user_id, pos, token, score`` of pasted texts ``user_id, text``: a title or id, then a score if there is one."""
    lines = texts.select("user_id", F.posexplode(F.split("text", r"\r?\n")).alias("pos", "line"))
    parts = F.filter(F.transform(F.split("line", r"[,\t|]"), unicode_trim), lambda x: x != "")
    return lines.withColumn("p", parts).where(F.size("p") > 0).select("user_id", "pos", F.get("p", F.lit(0)).alias("token"), F.get("p", F.lit(1)).try_cast("double").alias("score"))


def id_weights(texts: DataFrame) -> DataFrame:
    """``user_id, item_id, weight`` of comma lists ``id[:weight]``; the weight is 1 where it is missing or bad."""
    rows = texts.select("user_id", F.explode(F.split("text", ",")).alias("t")).where(F.regexp_replace("t", BLANKS, "") != "")
    item = F.trim(F.split_part("t", F.lit(":"), F.lit(1))).try_cast("bigint")
    return rows.select("user_id", item.alias("item_id"), F.coalesce(F.trim(F.split_part("t", F.lit(":"), F.lit(2))).try_cast("double"), F.lit(1.0)).alias("weight")).where("item_id is not null")


def wrapped_json(texts: DataFrame, marker: str, schema: str) -> DataFrame:
    """``user_id, value``: JSON after a marker in a text; null where the marker is absent."""
    at = F.instr("text", marker)
    return texts.select("user_id", F.when(at > 0, F.from_json(F.col("text").substr(at + len(marker), F.length("text")), schema)).alias("value"))


def saved_states(states: DataFrame, items: DataFrame) -> DataFrame:
    """``name, mode, blend, item_id, weight`` of saved states ``name, seq, state`` (JSON): the last of a name counts, other
    versions than 1 to 3 fall back to nothing watched, unknown items go, weights and blends are clamped."""
    from cofolio.functions.scalars import clamp_blend, clamp_weight, node_item_id

    schema = "struct<version: int, mode: string, modelBlendWeight: double, selected: array<struct<nodeId: string, weight: double>>>"
    last = states.groupBy("name").agg(F.max_by("state", "seq").alias("state")).withColumn("s", F.from_json("state", schema)).where(F.col("s.version").isin(1, 2, 3))
    mode = F.when(F.col("s.mode").isin("graph", "model", "hybrid"), F.col("s.mode")).otherwise("graph")
    rows = last.select("name", mode.alias("mode"), clamp_blend(F.col("s.modelBlendWeight")).alias("blend"), F.explode("s.selected").alias("e"))
    rows = rows.select("name", "mode", "blend", node_item_id(F.col("e.nodeId")).alias("item_id"), clamp_weight(F.col("e.weight")).alias("weight"))
    return rows.join(items.select("item_id"), "item_id", "left_semi").select("name", "mode", "blend", "item_id", "weight")
