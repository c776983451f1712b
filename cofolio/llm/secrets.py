"""Operator 8: secret scans with a random forest that removes false positives.

Candidates are values assigned to credential words, of any length and alphabet, passwords before a host, private key
blocks, and other runs of key-like characters: with a digit, or letters only. A random forest judges each from its length,
character transitions, the part of it that dictionary words cover, its path (the document's source and the
candidate's own separators) and the neighbouring words; it is trained from labelled findings. Where
none are given, these are the corpus's own findings that leave no doubt, by the public forms of issuers and by
their surroundings, and as many as ``RENDERED`` findings written out in the forms that secrets and their look-alikes take.
All of it is DataFrame functions and Spark's own forest.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import cut

CREDENTIAL = r"(?:token|secret(?!ar)|passw(?:or)?d|pwd|api[_-]?key|access[_-]?key|private[_-]?key|credential|auth(?!or(?!i)))"

# The pattern is one for Java and Python: ASCII classes, lookbehinds of fixed width, no group but that of the value.
_C, _L, _REST = "A-Za-z0-9+/_.@-", "A-Za-z+/_-", r"\x00-\x20\"'`"
#: Not after an assignment sign, blanks and a quote: what is assigned is taken whole instead.
_FREE = "".join(f"(?<!{sign}{blanks}{quote})" for sign in ("[=:]", "=>") for blanks in ("", *("[ \\t]" * k for k in (1, 2, 3))) for quote in ("", "[\"']"))
#: Key-like runs with a digit; runs of letters from both halves of the alphabet, long or of mixed case.
_DIGITS = f"(?=[A-Za-z+/_.@-]*[0-9])[{_C}]{{12,}}"
_LETTERS = f"(?<![^\\x00-\\x7f])(?=[{_L}]*[A-Ma-m])(?=[{_L}]*[N-Zn-z])(?:[{_L}]{{20,}}|(?=[{_L}]*[a-z+/_-][A-Z])[{_L}]{{12,}})(?![0-9.@]|[^\\x00-\\x7f])"
_RUN = f"(?:(?=//)|{_FREE})(?:{_DIGITS}|{_LETTERS})(?:={{1,2}}(?![=\"'{_C}]))?"
_KEY_BLOCK = "-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY(?: BLOCK)?-----(?:[^-]++-----END [A-Z0-9 ]{0,60}-----)?"
_AT_HOST = "(?=@[A-Za-z0-9-]+[.:/])"
#: At the start of a run of its characters: what stands before an assigned value, a password at a host, or a free run. The runs
#: are possessive, as what must follow them has none of their characters; the sign after a name is sought first.
_STARTS = "|".join([
    f"(?=[{_C}]++[\"']?[ \\t]{{0,3}}[=:])[{_C}]*?(?i:{CREDENTIAL})[A-Za-z0-9_-]{{0,64}}[\"']?[ \\t]{{0,3}}(?:=>|:=|[=:]{{1,2}})[ \\t]{{0,3}}[\"']?",  # credential word
    f"(?:[A-Za-z][A-Za-z0-9+.-]{{0,30}}+://)?[^{_REST}:/@]{{0,100}}+:(?=[^{_REST}@/]++{_AT_HOST})",  # user:password@host
    f"(?=[{_C}]{{12}})(?={_RUN})",  # the length first, as it rules out most words
])
_BEFORE = "|".join([
    f"(?={_KEY_BLOCK})",
    f"(?<![{_C}])(?:{_STARTS})",
    f"(?:=>|[=:])[ \\t]{{0,3}}[\"']?(?!//)(?={_DIGITS}|{_LETTERS})",  # any other name
])
_VALUE = "|".join([
    _KEY_BLOCK, _RUN, f"(?<=:)[^{_REST}@/]++{_AT_HOST}",
    "(?<=\")[^\"\\r\\n]++(?=\")", "(?<=')[^'\\r\\n]++(?=')", f"[^{_REST}]*[^{_REST},;.)\\]}}>]",
])
CANDIDATE = f"(?:{_BEFORE})({_VALUE})"
_MARK = "\x01"
PLACEHOLDER = r"(?:example|sample|dummy|test|placeholder|xxxx|changeme)"
#: A word is in the dictionary when so many documents, and such a share of all, have it: else a key that leaks often would be a word of a large corpus.
DICTIONARY_DOCS, DICTIONARY_SHARE = 20, 1e-5
#: Words of candidates that are sent to all tasks; more are met by a shuffle.
BROADCAST_WORDS = 200_000
#: Distinct labelled feature vectors that a forest is fitted on at most.
TRAIN_FINDINGS = 4000
#: Findings that are written out for training, of each label.
RENDERED = 1500
FEATURES = [
    "length", "digits", "uppers", "signs", "transitions", "variety", "covered", "at_sign", "dots", "slashes", "brackets", "path_hash",
    "assigned", "quoted", "credential", "digest_word", "placeholder", "after_quote", "before_host",
]
# Public forms of issued keys, as prefix, further characters and their number.
_DIGIT, _UPPER, _LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_HEX, _ALNUM = _DIGIT + "abcdef", _UPPER + _LOWER + _DIGIT
ISSUED = [
    ("AKIA", _UPPER + _DIGIT, 16), ("ghp_", _ALNUM, 36), ("glpat-", _ALNUM, 20), ("sk_live_", _ALNUM, 24), ("xoxb-", _ALNUM, 48), ("AIza", _ALNUM + "_-", 35),
]
_ISSUED = "|".join(f"{prefix}[{letters}]{{{n}}}" for prefix, letters, n in ISSUED)
#: Words beside digests, ids and versions.
DIGEST_WORD = r"(?:commit|sha-?\d*|md5|checksum|digest|etag|[ug]uid|hash|revision|version|build|\bid)\b"


def _may_have(text: Column) -> Column:
    """False only for texts in which ``CANDIDATE`` finds nothing: cheap tests, each true where one of its alternatives can match."""
    sign = text.contains("=") | text.contains(":")
    long = text.rlike(f"[{_C}]{{12}}")  # rules out most texts before the closer look
    run = long & text.rlike(f"(?=[{_C}]{{12}})(?:[A-Za-z+/_.@-]*+[0-9]|[{_L}]{{20}}|[{_L}]*?[a-z+/_-][A-Z])")
    return text.contains("-----BEGIN ") | (text.contains(":") & text.contains("@")) | (sign & text.rlike("(?i)" + CREDENTIAL)) | run


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """``id_col, place, value, before, after, path``: every candidate of every text, ``place`` counting from 0 in its text;
    ``before`` and ``after`` are up to 80 and 40 characters beside it. Null texts have none; a null or missing path is empty."""
    path = F.coalesce(F.col(path_col).cast("string"), F.lit("")) if path_col in docs.columns else F.lit("")
    text = F.translate(F.col(text_col), _MARK, "\x02")
    rows = docs.where(_may_have(F.col(f"`{text_col}`"))).select(F.col(id_col), text.alias("__t"), path.alias("path"))
    between = F.split(F.regexp_replace("__t", f"({_BEFORE})(?:{_VALUE})", f"$1{_MARK}"), _MARK, -1)
    parts = rows.select(id_col, "path", F.regexp_extract_all("__t", F.lit(CANDIDATE), F.lit(1)).alias("value"), between.alias("__between"))
    beside = lambda v, k: F.struct(
        v.alias("value"), F.substring(F.get("__between", k), -80, 80).alias("before"), F.substring(F.get("__between", k + 1), 1, 40).alias("after")
    )
    # the outer form, as the other one has the patterns run a second time to leave out empty arrays
    found = parts.select(id_col, "path", F.posexplode_outer(F.transform("value", beside)).alias("place", "__x")).where("__x is not null")
    return found.select(id_col, "place", "__x.value", "__x.before", "__x.after", "path")


def _runs(values: DataFrame) -> DataFrame:
    """``value, word``: the runs of 3 to 20 letters of distinct values, in lower case."""
    return values.select("value").distinct().select("value", F.explode(F.regexp_extract_all(F.lower("value"), F.lit("[a-z]{3,20}"), F.lit(0))).alias("word"))


def dictionary(docs: DataFrame, wanted: DataFrame, text_col: str = "text", min_docs: int = DICTIONARY_DOCS, share: float = DICTIONARY_SHARE) -> DataFrame:
    """``word``: of the words ``wanted(word)`` those that at least ``min_docs`` rows, and ``share`` of all rows, have between blanks or stops, in any case.

    Only words that occur in candidates can matter, so all others are left out before anything is counted or shuffled.
    """
    wanted = cut(wanted.select("word").distinct(), "secret-wanted")
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_WORDS else wanted
    least = max(min_docs, round(docs.count() * share))
    words = docs.select(F.explode(F.array_distinct(F.split(F.lower(F.col(text_col)), r"[\s,.;:!?]+"))).alias("word"))
    return words.join(wanted, "word", "left_semi").groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("word")


def with_features(found: DataFrame, words: DataFrame) -> DataFrame:
    """The findings with the columns of ``FEATURES``; ``words(word)`` is the dictionary. A null value gives null features, a null ``before``, ``after`` or ``path`` counts as
    empty, equal findings get equal features, other columns are kept. What words cover is found once a distinct value and written, so a value that most findings have is joined in parts."""
    size = F.length("value")
    share = lambda pattern: F.regexp_count("value", F.lit(pattern)) / size
    covered = cut(_runs(found).join(words, "word").groupBy("value").agg(F.sum(F.length("word")).alias("__letters")), "secret-covered")
    found = found.fillna("", [c for c in ("before", "after", "path") if c in found.columns])
    near = F.regexp_extract("before", r"(\S+\s+)?\S*\s*[\"']?\z", 0)
    flag = lambda c: c.cast("double")
    columns: dict[str, Column] = {
        "length": size.cast("double"), "digits": share("[0-9]"), "uppers": share("[A-Z]"), "signs": share("[^A-Za-z0-9]"),
        "transitions": share("(?<=[0-9])[A-Za-z]|(?<=[A-Za-z])[0-9]|(?<=[a-z])[A-Z]"),
        "variety": F.size(F.array_distinct(F.split("value", ""))) / F.least(size, F.lit(40)),
        "covered": F.coalesce(F.col("__letters"), F.lit(0)) / size,
        "at_sign": flag(F.col("value").contains("@")), "dots": share("[.]"), "slashes": share("/"), "brackets": share(r"[\[\](){}<>$]"),
        "path_hash": F.pmod(F.xxhash64("path"), F.lit(32)).cast("double"),
        "assigned": flag(F.col("before").rlike(r"(?:[=:]|=>)\s*[\"']?\z") & ~F.col("value").startswith("//")), "quoted": flag(F.col("before").rlike(r"[\"']\z")),
        "credential": flag(F.lower(near).rlike(CREDENTIAL)), "digest_word": flag(F.lower(near).rlike(DIGEST_WORD)), "placeholder": flag(F.lower(F.concat_ws(" ", "before", "value", "after")).rlike(PLACEHOLDER)),
        "after_quote": flag(F.col("after").rlike(r"\A[\"']")), "before_host": flag(F.col("after").startswith("@")),
    }
    joined = found.join(covered, "value", "left")
    return joined.select(*found.columns, *[columns[c].cast("double").alias(c) for c in FEATURES])


def distant_label() -> Column:
    """A label where the surroundings or the form leave no doubt, else null: keys in an issuer's form, key blocks and values assigned in quotes to
    a credential word are secrets, if they aren't placeholders or sentences; mail addresses, UUIDs, dotted and all-digit numbers,
    and lower-case words outside assignments (mostly dictionary words, where in several parts) aren't."""
    assigned = F.lower("before").rlike(CREDENTIAL + r"[\w-]*[\"']?\s*(?:[=:]|=>)\s*[\"']\z") & F.col("after").rlike(r"\A[\"']")
    assigned |= F.col("value").rlike(f"^(?:{_ISSUED})$")
    assigned &= ~F.col("value").rlike(r"\s") & ~F.lower("value").rlike(PLACEHOLDER)
    assigned |= F.col("value").startswith("-----BEGIN ")
    plain = F.col("value").rlike(r"@|^[0-9.:-]+$|^[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}$")
    word = F.col("value").rlike("^[A-Z]?[a-z]+$") | (F.col("value").rlike("^[a-z/_-]+$") & (F.col("covered") >= 0.5))
    plain |= word & (F.col("assigned") == 0) & (F.col("quoted") == 0)
    return F.when(assigned & ~plain, F.lit(1)).when(plain & ~assigned, F.lit(0))


def rendered(spark: SparkSession, count: int = RENDERED, seed: int = 0) -> DataFrame:
    """``doc_id, source, text, secret, label``: ``count`` texts for each label, drawn by hashes of row and ``seed``. Each of label 1
    has one ``secret``: a password, hexadecimal or mixed key assigned to a credential word or standing before a host, or an issued key anywhere;
    each of label 0 has digests, ids, versions, times, addresses, paths, names in code, or a placeholder or reference where a secret would be."""
    row = F.col("id")

    def number(name: str, below: int) -> Column:
        return F.pmod(F.xxhash64(row, F.lit(f"{name}{seed}")), F.lit(below)).cast("int")

    def one_of(name: str, options: list) -> Column:
        return F.element_at(F.array(*[o if isinstance(o, Column) else F.lit(o) for o in options]), number(name, len(options)) + 1)

    def drawn(name: str, letters: str, least: int, most: int | None = None) -> Column:
        size = F.lit(least) + number(name + "size", (most or least) - least + 1)
        letter = lambda i: F.substring(F.lit(letters), F.pmod(F.xxhash64(row, i, F.lit(f"{name}{seed}")), F.lit(len(letters))).cast("int") + 1, F.lit(1))
        return F.array_join(F.transform(F.sequence(F.lit(1), size), letter), "")

    def fill(form: str | Column, **parts: Column) -> Column:
        out = F.lit(form) if isinstance(form, str) else form
        for name, value in parts.items():
            out = F.replace(out, F.lit("{" + name + "}"), value)
        return out

    name = one_of("name", ["API_KEY", "api_key", "password", "secret", "token", "db_password", "SECRET_ACCESS_KEY", "auth_token", "passwd", "client_secret"])
    assigned = one_of("form", ["{n}={v}", "{n}: {v}", '{n} = "{v}"', "{n}='{v}'", '"{n}": "{v}"', "{n} => '{v}'", "{n} := {v}"])
    word = drawn("word", _LOWER, 3, 9)
    value = one_of("kind", [
        drawn("hex", _HEX, 20, 64), drawn("key", _ALNUM, 12, 48), F.concat(drawn("b64", _ALNUM + "+/", 30, 60), F.lit("==")),
        drawn("pass", _ALNUM + "!$%#&*^-", 8, 16), F.concat(word, drawn("end", _DIGIT, 1, 4)), drawn("phrase", _LOWER, 12, 30),
    ])
    issued = one_of("issuer", [F.concat(F.lit(prefix), drawn(prefix, letters, n)) for prefix, letters, n in ISSUED])
    uuid = F.concat_ws("-", *[drawn(f"uuid{k}", _HEX, n) for k, n in enumerate((8, 4, 4, 4, 12))])
    digest, free = one_of("digest", [drawn("d32", _HEX, 32), drawn("d40", _HEX, 40), drawn("d64", _HEX, 64)]), drawn("free", _HEX, 12, 40)
    time = fill("20{y}-1{m}-0{d}T1{h}:2{m}:3{d}Z", y=drawn("y", _DIGIT, 2), m=drawn("m", "012", 1), d=drawn("d", _DIGIT[1:], 1), h=drawn("h", _DIGIT, 1))
    code = F.concat(word, *[F.initcap(drawn(f"code{k}", _LOWER, 3, 8)) for k in range(3)])
    path = F.concat_ws("/", *[drawn(f"path{k}", _LOWER, 2, 8) for k in range(3)], F.concat(word, drawn("n", _DIGIT, 1, 3), F.lit(".txt")))
    empty = one_of("empty", ["your_{n}_here", "<{n}>", "${{N}}", "changeme", "example-{n}", "xxxxxxxxxxxx", 'os.environ["{n}"]', "getenv({n})", "None", "********", "config.{n}"])
    harmless = one_of("harmless", [
        F.concat(one_of("dw", ["commit ", "sha256: ", "md5=", "checksum: ", "etag \"", "revision "]), digest), F.concat(one_of("iw", ["id ", "uuid: ", "guid=", ""]), uuid),
        F.concat(F.lit("version 1."), drawn("v", _DIGIT, 2), F.lit(".0-"), drawn("w", _DIGIT, 8)), time, drawn("digits", _DIGIT, 12, 20),
        F.concat(word, F.lit("."), drawn("mail", _LOWER, 2, 6), drawn("n", _DIGIT, 1, 2), F.lit("@mail.example.com")), F.concat(F.lit("https://www."), word, F.lit(".com/"), path),
        F.concat(F.lit("/"), path), code, F.concat(code, F.lit("="), word), F.concat(F.lit("#"), free), F.concat(F.lit("image_"), word, F.lit("-"), drawn("px", _DIGIT, 6, 10)),
        fill(assigned, v=fill(empty, n=name), n=name), fill(assigned, v=fill(empty, n=name), n=name), fill(assigned, v=F.concat(word, F.lit(" "), drawn("w2", _LOWER, 3, 9)), n=name),
    ])
    bare, host = number("where", 4) == 0, number("where", 4) == 1
    secret = F.when(bare, issued).otherwise(value)
    told = F.when(bare, one_of("at", ["{v}", "key {v}", "{v},", "({v})"])).when(host, fill("https://{w}:{v}@{w}.example.org/", w=word)).otherwise(assigned)
    text = F.when(F.col("label") == 1, fill(told, v=F.col("secret"), n=name)).otherwise(harmless)
    rows = cut(spark.range(2 * count).select("id", (row % 2).cast("int").alias("label"), secret.alias("secret")), "secret-drawn")
    rows = rows.withColumn("secret", F.when(F.col("label") == 1, F.col("secret")))
    around = lambda side: one_of(side, ["", "\n", "use ", "with ", "- "])
    return rows.select(row.alias("doc_id"), F.concat(F.lit("rendered"), number("source", 64)).alias("source"), F.concat(around("before"), text, F.lit(" "), around("after")).alias("text"), "secret", "label")


def rendered_candidates(texts: DataFrame) -> DataFrame:
    """The candidates of :func:`rendered` texts with ``label``; of a text with a secret, that alone."""
    texts = cut(texts, "secret-rendered")
    found = candidates(texts).join(F.broadcast(texts.select("doc_id", "secret", "label")), "doc_id")  # twice RENDERED rows
    return cut(found.where("secret is null or secret = value").drop("secret"), "secret-rendered")


def train(
    labelled: DataFrame, label_col: str = "label", limit: int = TRAIN_FINDINGS, trees: int = 40, depth: int = 8, always: DataFrame | None = None
) -> RandomForestClassificationModel | float:
    """A forest fitted on at most ``limit`` distinct rows of ``labelled`` (features and a label 0 or 1, null labels left out);
    where all its labels are equal, that label instead (1.0 without any: nothing is then removed).

    Copies count once: a feature vector weighs 1, shared by its labels as its copies are, so no hot vector pushes others out.
    A label has half of the places, and those that the other leaves free; beyond that, the vectors of smallest hash are taken.
    ``always``, a small table with ``label``, is learnt from whole, beside these.
    """
    rows = labelled.where(F.col(label_col).isNotNull()).withColumn("__one", F.col(label_col).cast("double"))
    vectors = cut(rows.groupBy(*FEATURES).agg(F.avg("__one").alias("__share")), "secret-vectors")
    sides = {1.0: F.col("__share"), 0.0: 1 - F.col("__share")}
    sizes = vectors.agg(*[F.count_if(w > 0).alias(f"n{label:.0f}") for label, w in sides.items()]).first()
    n = {1.0: sizes.n1, 0.0: sizes.n0}
    if always is None and not (n[0.0] and n[1.0]):
        return 0.0 if n[0.0] else 1.0
    places = {label: max(limit // 2, limit - n[1.0 - label]) for label in n}
    picked = [
        vectors.where(w > 0).select(*FEATURES, F.lit(label).alias("label"), w.alias("weight")).orderBy(F.xxhash64(*FEATURES), *FEATURES).limit(places[label])
        for label, w in sides.items()
    ]
    if always is not None:
        picked.append(always.select(*FEATURES, F.col("label").cast("double").alias("label"), F.lit(1.0).alias("weight")))
    rows = cut(reduce(DataFrame.unionByName, picked), "secret-sample")
    ready = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows)
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=5, labelCol="label", featuresCol="features", weightCol="weight").fit(ready)


def score(found: DataFrame, model: RandomForestClassificationModel | float) -> DataFrame:
    """Findings with ``score``, the forest's probability of a secret; equal features score alike, null ones as zero, other columns are kept."""
    if isinstance(model, float):
        return found.withColumn("score", F.lit(model))
    ready = VectorAssembler(inputCols=FEATURES, outputCol="__features").transform(found.fillna(0.0, FEATURES))
    judged = model.setFeaturesCol("__features").setProbabilityCol("__p").setRawPredictionCol("__raw").setPredictionCol("__pred").transform(ready)
    return judged.withColumn("score", vector_to_array("__p")[1]).drop("__features", "__p", "__raw", "__pred")


def scan(docs: DataFrame, labelled: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source", threshold: float = 0.5) -> DataFrame:
    """``id_col, place, value, before, after, score, is_secret`` of every candidate of every whole text.

    ``labelled`` has findings' ``id_col, place, label``; without it :func:`distant_label` labels those it is sure of, beside :func:`rendered` ones.
    Null and empty texts have no candidates; repeated rows have theirs each; ids may be null; other columns are ignored.
    """
    found = cut(candidates(docs, id_col, text_col, path_col), "secret-candidates")
    drawn = None if labelled is not None else rendered_candidates(rendered(docs.sparkSession))
    wanted = _runs(found) if drawn is None else _runs(found.select("value").unionByName(drawn.select("value")))
    words = cut(dictionary(docs, wanted, text_col), "secret-words")
    found = cut(with_features(found, words), "secret-findings")
    if drawn is not None:
        model = train(found.withColumn("label", distant_label()), always=with_features(drawn, words))
    else:
        model = train(found.join(labelled.select(id_col, "place", "label"), [id_col, "place"]))
    return score(found, model).select(id_col, "place", "value", "before", "after", "score", (F.col("score") >= threshold).alias("is_secret"))
