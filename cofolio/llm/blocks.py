"""Blocks of documents and shards of hash space, for operators that must look up every shingle or substring.

A block holds the documents of one remainder of the id's hash, some ``block_bytes`` of text; a shard holds one
stretch of the hash space. Each block sends a shard one row with the sorted distinct hashes it
has there, so a hash that is frequent in the corpus costs one entry a block, not one a document,
and answers travel back the same way. The number of blocks and shards grows with the input, so neither grows in size.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_BYTES = 8 << 20
ROW_BYTES = 400


def block_count(total_bytes: int | None, rows: int | None = 0, block_bytes: int = BLOCK_BYTES) -> int:
    """Blocks for so many bytes of text in so many rows; a row itself takes as much as some ``ROW_BYTES`` of text."""
    return max(1, math.ceil(((total_bytes or 0) + ROW_BYTES * (rows or 0)) / block_bytes))


def shard_bits(blocks: int) -> int:
    """Shards are a power of two, about as many as blocks."""
    return max(0, math.ceil(math.log2(blocks)))


def block_of(id_col: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(id_col), F.lit(blocks)).cast("int")


def pack(sorted_values: np.ndarray) -> bytes:
    """Ascending 64-bit values as differences, byte planes apart (upper planes are zeros, which the shuffle's codec removes)."""
    step = np.diff(sorted_values, prepend=np.uint64(0)).astype(np.uint64)
    return step.view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(packed, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def pack32(values: np.ndarray) -> bytes:
    """Any 32-bit values, byte planes apart."""
    return np.ascontiguousarray(values.astype(np.uint32)).view(np.uint8).reshape(-1, 4).T.tobytes()


def unpack32(packed: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(packed, np.uint8).reshape(4, -1).T).view(np.uint32).ravel()


def found_in(values: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each value is in the ascending table, and whether it is there."""
    if not len(table):
        return np.zeros(len(values), np.int64), np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return at, table[at] == values


def components(edges: DataFrame, cut) -> DataFrame:
    """``node, root``: connected components of ``edges(a, b)`` by alternating large and small stars
    (Kiveris et al. 2014), each round written by ``cut``. The root is a component's smallest node."""
    pairs = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc")
    before = None
    while True:
        both = pairs.select("u", "v").unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        pairs = cut(small.where("u <> v").distinct(), "cc")
        state = tuple(pairs.agg(F.count("*"), F.sum(F.shiftright(F.xxhash64("u", "v"), 20))).first())
        if state == before:
            roots = pairs.groupBy("u").agg(F.min("v").alias("root"))
            return roots.select(F.col("u").alias("node"), "root").unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
        before = state


def planes(values: np.ndarray) -> bytes:
    """Any 64-bit values, byte planes apart."""
    return np.ascontiguousarray(values.astype(np.uint64)).view(np.uint8).reshape(-1, 8).T.tobytes()


def from_planes(packed: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(packed, np.uint8).reshape(8, -1).T).view(np.uint64).ravel()


def table(rows: list[tuple], schema: list[tuple[str, pa.DataType]]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.Table.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, schema, strict=True)], [n for n, _ in schema])


def ddl(schema: list[tuple[str, pa.DataType]]) -> str:
    return ", ".join(f"{n} {str(t).replace('int32', 'int').replace('int64', 'long')}" for n, t in schema)
