"""Operator 1: k-d tree sharding over document metadata.

Every node of the tree is split at the weighted (by bytes) median of its widest metadata
dimension until each leaf holds the target number of bytes. Only a narrow projection (id, size,
dimensions) is ever scanned again; texts are read once. Medians come from two small histograms
per level, computed by Spark for all nodes of the level at once; the driver sees one row a node.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import cut

BINS = 4096
#: Rows that one task numbers at most, about; slots are numbered in parts of this size.
SLOT_PART = 50_000


def _unit(column: str, dtype: str) -> Column:
    """A dimension as a double: numbers as they are, everything else by a hash (equal values stay together)."""
    c = F.col(column)
    if dtype in ("tinyint", "smallint", "int", "bigint", "float", "double") or dtype.startswith("decimal"):
        v = c.cast("double")
        return F.when(F.isnan(v), None).otherwise(v)
    return F.when(c.isNotNull(), F.pmod(F.xxhash64(c), F.lit(1 << 30)).cast("double"))


def _small(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of at most one row a leaf, as literals."""
    kinds = [f.split() for f in schema.split(", ")]
    structs = [F.struct(*[F.lit(v).cast(k).alias(n) for v, (n, k) in zip(r, kinds, strict=True)]) for r in rows]
    return F.broadcast(spark.range(1).select(F.inline(F.array(*structs))))


def _bin(dim: Column, lo: Column, width: Column) -> Column:
    """The histogram bin of a value; nulls go below."""
    return F.coalesce(F.floor((dim - lo) / F.greatest(width, F.lit(1e-12)) * F.lit(BINS - 1)).cast("int"), F.lit(-1))


def kd_shards(
    docs: DataFrame,
    target_bytes: int | None = None,
    shards: int | None = None,
    dims: tuple[str, ...] = ("lang", "source", "n_chars"),
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Assign every row to a leaf of the tree.

    Give ``target_bytes`` (leaves = total / target, at least 1) or the number of leaves. Returns
    ``id_col, size, text_crc32, shard, slot``: size is the UTF-8 length plus 8, slots are gapless
    from 0 within a shard. A null text counts as empty; a null dimension sorts below every value;
    rows with equal dimensions are cut apart by a hash of id and text, so ties and repeated rows (even
    one source with a third of all rows) don't unbalance the leaves; rows repeated whole
    are interchangeable. Columns in ``dims`` that the table lacks and columns beyond those named
    are ignored. An empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    kinds = dict(docs.dtypes)
    dims = tuple(d for d in dims if d in kinds)
    crc = F.crc32(text.cast("binary"))
    tie = F.pmod(F.xxhash64(F.col(id_col), crc, F.lit(1)), F.lit(1 << 24))
    base = cut(
        docs.select(
            F.col(id_col),
            (F.octet_length(text) + F.lit(8)).cast("long").alias("size"),
            crc.alias("text_crc32"),
            F.array(*[_unit(d, kinds[d]) for d in dims], tie.cast("double")).alias("__dims"),
            tie.alias("__tie"),
        ),
        "shard-base",
    )
    spark, keys, last = docs.sparkSession, range(len(dims) + 1), len(dims)
    spread = [f(F.col("__dims")[k]).alias(f"{n}{k}") for k in keys for n, f in (("lo", F.min), ("hi", F.max))]
    total = base.agg(F.sum("size").alias("w"), F.count("*").alias("n"), *spread).first()
    if shards is None:
        shards = max(1, round((total.w or 0) / max(1, target_bytes or 1)))
    width = [(total[f"hi{k}"] or 0) - (total[f"lo{k}"] or 0) for k in keys]
    fine = F.shiftright(F.col("__tie"), 12).cast("int")
    placed = base.withColumn("__node", F.lit(0))
    level = {0: shards} if total.n else {}  # first leaf of each node: its number of leaves
    while level := {n: leaves for n, leaves in level.items() if leaves > 1}:
        plans = []
        for s in placed.groupBy("__node").agg(F.sum("size").alias("w"), *spread).collect():  # one row a node
            if (leaves := level.get(s["__node"])) is None:
                continue
            wide = [((s[f"hi{k}"] or 0) - (s[f"lo{k}"] or 0)) / width[k] if width[k] else 0.0 for k in keys]
            # the tie hash is a dimension only where no other has any width
            k = max(range(last), key=wide.__getitem__, default=last)
            k = k if wide[k] > 0 else last
            lo = float(s[f"lo{k}"] or 0)
            plans.append((s["__node"], k, lo, float(s[f"hi{k}"] or 0) - lo, s.w * (leaves // 2) / leaves))
        splits = _small(spark, plans, "__node int, dim int, lo double, width double, goal double")
        seen = placed.join(splits, "__node").withColumn("__bin", _bin(F.get("__dims", F.col("dim")), F.col("lo"), F.col("width")))
        order = Window.partitionBy("__node").orderBy("__bin")
        met = (
            seen.groupBy("__node", "goal", "__bin").agg(F.sum("size").alias("w"))
            .withColumn("upto", F.sum("w").over(order))
            .where((F.col("upto") >= F.col("goal")) & (F.col("upto") - F.col("w") < F.col("goal")))
            .select("__node", "__bin", (F.col("upto") - F.col("w")).cast("double").alias("before"))
            .collect()  # one row a node
        )
        bins = _small(spark, met, "__node int, __bin int, before double")
        near = (
            seen.join(bins, ["__node", "__bin"]).groupBy("__node", "goal", "before", fine.alias("__fine"))
            .agg(F.sum("size").alias("w"))
            .withColumn("upto", F.sum("w").over(Window.partitionBy("__node").orderBy("__fine")))
            .withColumn("off", F.abs(F.col("upto") + F.col("before") - F.col("goal")))
            .groupBy("__node").agg(F.min_by("__fine", "off").alias("cut"), F.min("off").alias("off"))
            .collect()  # one row a node
        )
        near, met = {r["__node"]: r for r in near}, {r["__node"]: r for r in met}
        rows, below = [], {}
        for n, k, lo, wide, goal in plans:
            # nothing of the bin goes left if that is nearer to the goal
            upto = -1 if abs(met[n]["before"] - goal) < near[n]["off"] else near[n]["cut"]
            half = level[n] // 2
            rows.append((n, k, lo, wide, met[n]["__bin"], upto, n + half))
            below |= {n: half, n + half: level[n] - half}
        cuts = _small(spark, rows, "__node int, dim int, lo double, width double, at int, upto int, right int")
        bin_ = _bin(F.get("__dims", F.col("dim")), F.col("lo"), F.col("width"))
        goes_right = (bin_ > F.col("at")) | ((bin_ == F.col("at")) & (fine > F.col("upto")))
        placed = (
            placed.join(cuts, "__node", "left").withColumn("__node", F.when(goes_right, F.col("right")).otherwise(F.col("__node")))
            .select(*base.columns, "__node")
        )
        level = below
    parts = max(1, math.ceil(total.n / shards / SLOT_PART))
    placed = placed.select(
        id_col, "size", "text_crc32", "__tie", F.col("__node").alias("shard"), F.pmod("__tie", F.lit(parts)).alias("__part")
    )
    start = (
        placed.groupBy("shard", "__part").agg(F.count("*").alias("__n"))
        .withColumn("__from", F.sum("__n").over(Window.partitionBy("shard").orderBy("__part")) - F.col("__n"))
        .drop("__n")
    )
    within = Window.partitionBy("shard", "__part").orderBy("__tie", id_col, "text_crc32")
    return (
        placed.withColumn("__rank", F.row_number().over(within) - 1)
        .join(F.broadcast(start) if parts * shards <= 100_000 else start, ["shard", "__part"])
        .select(id_col, "size", "text_crc32", "shard", (F.col("__from") + F.col("__rank")).cast("long").alias("slot"))
    )
