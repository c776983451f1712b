"""Large JSON documents read in byte ranges.

A range can't tell on its own whether it begins inside a string or how deep it is nested. So all ranges are scanned three times,
each in its own task: the first counts quotes and brackets, the second finds the arrays that are open at a range's end, the third
cuts out the elements that begin in the range. Between them, running sums over a file's ranges (a narrow row each) give every range its state.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cofolio.sources.scratch import cut

#: Files above this size are read in ranges of ``RANGE_BYTES``; smaller ones are one task's work anyway.
WHOLE_BYTES = 64 << 20
RANGE_BYTES = 4 << 20
#: Ranges a task scans, where there are enough of them for all cores.
RANGES_A_TASK = 32

_SIGNS = np.zeros(256, bool)
_SIGNS[list(b'"{}[],:')] = True
_STEP = np.zeros(256, np.int64)
_STEP[list(b"{[")], _STEP[list(b"}]")] = 1, -1
_QUOTE, _BACKSLASH, _COMMA, _COLON, _OPEN, _CLOSE, _OBJECT = b'"\\,:[]{'
_PACKED = r"\.(gz|gzip|bz2|zst|zstd|lz4|snappy|deflate|xz)$"


class _File:
    """Reads of a file by place."""

    def __init__(self, uri: str):
        store, inner = pafs.FileSystem.from_uri(uri)
        self.file = store.open_input_file(inner)
        self.size = self.file.size()

    def read(self, start: int, end: int) -> bytes:
        start, end = max(start, 0), min(end, self.size)
        return self.file.read_at(end - start, start) if start < end else b""

    def backslashes(self, start: int) -> int:
        """How many backslashes stand right before a place."""
        width = 64
        while True:
            before = self.read(start - width, start)
            n = len(before) - len(before.rstrip(b"\\"))
            if n < len(before) or width >= start:
                return n
            width *= 16

    def key_before(self, colon: int) -> str:
        """The string that ends before a colon."""
        width = 256
        while True:
            text = self.read(colon - width, colon).rstrip()
            at = len(text) - 2
            while at >= 0:
                at = text.rfind(b'"', 0, at + 1)
                run = len(text[:at]) - len(text[:at].rstrip(b"\\")) if at > 0 else 0
                if at < 0 or run == at and width < colon:
                    break  # its beginning isn't read yet
                if run % 2 == 0:
                    return json.loads(text[at:])
                at -= 1
            if width >= colon:
                raise ValueError(f"no key before byte {colon}")
            width *= 16


def _events(text: bytes, run: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and kinds of quotes (not escaped ones), brackets, commas and colons; ``run`` backslashes stand before the text."""
    signs = np.frombuffer(text, np.uint8)
    at = np.flatnonzero(_SIGNS[signs])
    kind = signs[at]
    quotes = at[kind == _QUOTE]
    if (len(quotes) and quotes[0] == 0 and run % 2) or (signs == _BACKSLASH).any():
        other = np.where(signs != _BACKSLASH, np.arange(len(signs), dtype=np.int64), -1 - run)
        last = np.concatenate([[-1 - run], np.maximum.accumulate(other)])  # of the signs before each place
        fine = (kind != _QUOTE) | ((at - 1 - last[at]) % 2 == 0)
        at, kind = at[fine], kind[fine]
    return at, kind


def _outside(kind: np.ndarray, in_string: bool) -> np.ndarray:
    quote = kind == _QUOTE
    return ((np.cumsum(quote) - quote + in_string) % 2 == 0) & ~quote


def _counts(file: _File, start: int, end: int) -> tuple[int, int, int]:
    """Quotes, and the change of depth if the range begins outside and inside a string."""
    _, kind = _events(file.read(start, end), file.backslashes(start))
    out = _outside(kind, False)
    return int((kind == _QUOTE).sum()), int(_STEP[kind[out]].sum()), int(_STEP[kind[~out]].sum())


class _Structure:
    """The signs outside strings of a part of a file: ``at`` (places in the text), ``kind``, ``depth`` before the sign."""

    def __init__(self, text: bytes, run: int, in_string: bool, depth: int, array: bool):
        at, kind = _events(text, run)
        out = _outside(kind, in_string)
        self.text, self.at, self.kind = text, at[out], kind[out]
        step = _STEP[self.kind]
        self.depth = depth + np.cumsum(step) - step
        self.documents = np.cumsum((step > 0) & (self.depth == 0))
        self.opener = (step > 0) & (self.depth == 1)
        # the last bracket that opened a value of the top object: whether an array is open
        last = np.maximum.accumulate(np.where(self.opener, np.arange(len(step)), -1)) if len(step) else step
        self.in_array = np.where(last >= 0, self.kind[last] == _OPEN, array) if len(step) else step.astype(bool)
        self.begins = self.in_array & (self.opener | (self.kind == _COMMA) & (self.depth == 2))
        self.ends = self.in_array & ((self.kind == _COMMA) | (self.kind == _CLOSE)) & (self.depth == 2)
        self.colons = (self.kind == _COLON) & (self.depth == 1)


def _colon(file: _File, place: int) -> int:
    """The colon that stands before a value, blanks apart."""
    width = 64
    while True:
        before = file.read(place - width, place).rstrip()
        if before or width >= place:
            return max(place - width, 0) + len(before) - 1
        width *= 16


def _summary(file: _File, start: int, end: int, in_string: bool, depth: int) -> tuple:
    """Documents begun; whether a value of a top object was opened, with the key of the last and whether it is an array; commas
    at depth 2 since then, and the bracket itself."""
    s = _Structure(file.read(start, end), file.backslashes(start), in_string, depth, True)
    documents = int(s.documents[-1]) if len(s.at) else 0
    openers = np.flatnonzero(s.opener)
    commas = (s.kind == _COMMA) & (s.depth == 2)
    if not len(openers):
        return documents, False, None, None, int(commas.sum())
    last = int(openers[-1])
    key = file.key_before(_colon(file, start + int(s.at[last])))
    return documents, True, key, bool(s.kind[last] == _OPEN), 1 + int(commas[last:].sum())


def _elements(file: _File, row: dict, names: set[str] | None) -> Iterator[tuple]:
    """``document, key, pos, value`` of what begins in the range: elements of a top object's arrays, and its other values with no ``pos``."""
    start, end, more = row["start"], row["end"], 0
    run = file.backslashes(start)
    while True:  # until the last element of the range has its end
        s = _Structure(file.read(start, end + more), run, row["in_string"], row["depth"], bool(row["array"]))
        inner, ends = np.flatnonzero(s.begins & (s.at < end - start)), np.flatnonzero(s.ends)
        closing = np.flatnonzero(((s.kind == _COMMA) | (_STEP[s.kind] < 0)) & (s.depth == 1))
        outer = np.flatnonzero(s.colons & (s.at < end - start))
        whole = not len(inner) or len(ends) and ends[-1] > inner[-1]
        if whole and len(outer) and not (len(closing) and closing[-1] > outer[-1]):
            whole = s.text[s.at[outer[-1]] + 1 :].lstrip()[:1] == b"["  # its elements stand for it
        if whole or end + more >= file.size:
            break
        more = max(1 << 16, 4 * more)
    key, pos = row["key"], row["pos"]
    until = ends[np.searchsorted(ends, inner, "right")] if whole and len(inner) else []
    for a, b in zip(inner, until, strict=True):
        if s.opener[a]:
            key, pos = file.key_before(_colon(file, start + int(s.at[a]))), 0
        value = s.text[s.at[a] + 1 : s.at[b]].strip()
        if value and (names is None or key in names):
            yield row["documents"] + int(s.documents[a]), key, pos, value
        pos += 1
    for a, k in zip(outer, np.searchsorted(closing, outer, "right"), strict=True):
        value = s.text[s.at[a] + 1 : s.at[closing[k]]].strip() if k < len(closing) else b"["
        if value[:1] != b"[":
            name = file.key_before(start + int(s.at[a]))
            if names is None or name in names:
                yield row["documents"] + int(s.documents[a]), name, None, value


def _map(ranges: DataFrame, tasks: int, scan: Callable[[_File, dict], Iterator[tuple]], keep: list[str], schema: str) -> DataFrame:
    """Rows ``keep`` with what ``scan`` gives for each range."""
    kept = ", ".join(f"{c} {dict(ranges.dtypes)[c]}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uri, file = None, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["file"] != uri:
                    uri, file = row["file"], _File(row["file"])
                held, size = [], 0
                for found in scan(file, row):
                    held.append((*(row[c] for c in keep), *found))
                    size += len(found[-1]) if isinstance(found[-1], bytes) else 8
                    if size > RANGE_BYTES:
                        yield _batch(held)
                        held, size = [], 0
                if held:
                    yield _batch(held)

    types = [f.dataType for f in ranges.sparkSession.createDataFrame([], f"{kept}, {schema}").schema.fields]
    names = [c.split()[0] for c in f"{kept}, {schema}".split(", ")]
    arrow = [{"string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}[t.simpleString()] for t in types]

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), arrow, strict=True)], names)

    return ranges.repartition(tasks, "file", "start").mapInArrow(run, f"{kept}, {schema}")


def is_large(file: Column, size: Column) -> Column:
    """Whether a file is read in ranges; a compressed one can't be entered midway."""
    return (size > WHOLE_BYTES) & ~F.lower(file).rlike(_PACKED)


def large_files(spark: SparkSession, path: str) -> DataFrame:
    """``file, bytes`` of the files that are read in ranges."""
    meta = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes"))
    return meta.where(is_large(F.col("file"), F.col("bytes")))


class Ranges:
    """The large files of a path with the state of each of their ranges. ``sound`` files have all brackets and quotes closed; of ``broken`` ones nothing is given."""

    def __init__(self, spark: SparkSession, path: str):
        files = large_files(spark, path)
        starts = F.sequence(F.lit(0), F.col("bytes") - 1, F.lit(RANGE_BYTES)).cast("array<bigint>")
        ranges = files.select("file", "bytes", F.explode(starts).alias("start")).withColumn("end", F.least(F.col("start") + RANGE_BYTES, "bytes")).drop("bytes")
        n = ranges.count()
        self.any, self.broken = n > 0, []
        if not n:
            return
        self.tasks = tasks = max(min(n, spark.sparkContext.defaultParallelism), math.ceil(n / RANGES_A_TASK))
        counted = _map(ranges, tasks, lambda f, r: iter([_counts(f, r["start"], r["end"])]), ["file", "start", "end"], "quotes bigint, outer bigint, inner bigint")
        by_file = Window.partitionBy("file").orderBy("start")
        before, everything = by_file.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("file")
        state = counted.withColumn("in_string", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1)
        state = state.withColumn("change", F.when(F.col("in_string"), F.col("inner")).otherwise(F.col("outer")))
        state = state.withColumn("depth", F.coalesce(F.sum("change").over(before), F.lit(0)))
        closed = (F.sum("quotes").over(everything) % 2 == 0) & (F.sum("change").over(everything) == 0) & (F.min("depth").over(everything) >= 0)
        state = cut(state.withColumn("sound", closed).select("file", "start", "end", "in_string", "depth", "sound"), "json-depths")
        self.broken = [r["file"] for r in state.where("not sound").select("file").distinct().collect()]
        scanned = _map(state.where("sound"), tasks, lambda f, r: iter([_summary(f, r["start"], r["end"], r["in_string"], r["depth"])]),
                       ["file", "start", "end", "in_string", "depth"], "documents bigint, opened boolean, key string, array boolean, n bigint")
        group = F.sum(F.col("opened").cast("long")).over(by_file)
        at_end = F.sum("n").over(Window.partitionBy("file", "group").orderBy("start"))
        begun = scanned.withColumn("group", group).withColumn("at_end", at_end)
        self.state = cut(begun.select(
            "file", "start", "end", "in_string", "depth", F.coalesce(F.sum("documents").over(before), F.lit(0)).alias("documents"),
            F.last("key", ignorenulls=True).over(before).alias("key"), F.last("array", ignorenulls=True).over(before).alias("array"),
            F.coalesce(F.lag("at_end").over(by_file), F.lit(0)).alias("pos"),
        ), "json-ranges")

    def members(self, names: list[str] | None = None) -> DataFrame:
        """``file, document, key, pos, value``: elements of the arrays of each file's top objects in their places, and other values
        of these objects, whole, without ``pos``; of the keys ``names``, if given. Values are JSON texts."""
        wanted = None if names is None else set(names)
        rows = _map(self.state, self.tasks, lambda f, r: _elements(f, r, wanted), ["file"], "document bigint, key string, pos bigint, value binary")
        return rows.withColumn("value", F.col("value").cast("string"))
