"""Sharding by a k-d tree over document metadata.

The root holds all documents and all leaves. A node of k leaves is split across
its widest dimension at the weighted quantile that gives the left child
floor(k/2) of the k leaves' bytes, until every node is one leaf. Quantiles are
found exactly and without gathering a node: bytes by dimension value, then by
prefix of a fixed pseudo-random key inside the crossing value, then row by row
inside the crossing prefix.

Equal texts are a group. A group of at most GROUP_SHARE of a shard's bytes has
the metadata of its least source and language and one key, so it is never cut; a
larger one is cut row by row wherever the law of even bytes asks for it, whatever
its ids: rows equal in everything are told apart by their number.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catlas.operators.numbering import numbered

from .common import materialize, shuffle_key, sortable, spread

#: Rows that one task orders at the end of a split, on average.
ROWS_PER_TASK = 20_000
#: Rows of all shards in one prefix of the order key; slots are counted by shard and prefix.
ROWS_PER_PREFIX = 2048
DIMENSIONS = ("source", "lang", "length")
#: Of a shard's bytes, what a group of equal texts may have to stay together.
GROUP_SHARE = 0.01


def _digits(rows: Column, each: int) -> Column:
    """Hexadecimal digits of a key that part so many rows into about `each`."""
    return F.greatest(F.ceil(F.log(16.0, rows / F.lit(each))), F.lit(0)).cast("int")


def _rank(rows: DataFrame, column: str, out: str) -> DataFrame:
    """Each of `column`'s distinct values with its place among them; written, so it is broadcast only if small."""
    values = rows.groupBy(column).agg(F.count(F.lit(1)).alias("n")).select(column)
    return materialize(numbered(values, column, out=out), "shard-ranks")


def describe(docs: DataFrame, leaves: int | None, target_bytes: int | None = None, id_col: str = "doc_id", text_col: str = "text", overhead: int = 8) -> tuple[DataFrame, int]:
    """(one slim row per document: id, size, crc, key and the three dimensions as longs; the number of leaves)."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    slim = docs.select(
        F.col(f"`{id_col}`").alias("id"),
        (F.octet_length(text) + overhead).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("crc"),
        F.xxhash64(text).alias("hash"),
        sortable(F.col("source")).alias("src"),
        sortable(F.col("lang")).alias("lng"),
        F.floor(F.sqrt(F.coalesce(F.char_length(text), F.lit(0)).cast("double"))).cast("long").alias("length"),
    )
    classes = materialize(slim.groupBy(*slim.columns).agg(F.count(F.lit(1)).alias("n")), "shard-classes")
    total = classes.agg(F.sum(F.col("size") * F.col("n")).alias("bytes")).first()["bytes"] or 0
    if leaves is None:
        leaves = max(1, math.ceil(total / (target_bytes or 1 << 30)))
    group = ["size", "crc", "hash"]
    held = classes.groupBy(*group).agg(F.sum("n").alias("rows"), F.min(F.struct("src", "lng")).alias("home")).filter("rows > 1")
    whole = held.filter(F.col("rows") * F.col("size") <= F.lit(total / leaves * GROUP_SHARE)).select(*group, "home", _digits(F.col("rows"), ROWS_PER_PREFIX).alias("parts"))
    joined = classes.join(materialize(whole, "shard-groups"), group, "left")
    rows = spread(joined, "n", "at")
    alone = shuffle_key(F.col("id"), F.col("size"), F.col("crc"), F.col("hash"), F.col("src"), F.col("lng"), F.col("at"))
    key = F.when(F.col("home").isNull(), alone).otherwise(shuffle_key(F.col("size"), F.col("crc"), F.col("hash")))
    # Rows of one key may be very many; where they are, their slots are counted by parts of a key of their own.
    parted = F.when(F.col("home").isNotNull(), F.substring(alone, F.lit(1), F.col("parts"))).otherwise("")
    rows = rows.select("id", "size", "crc", key.alias("key"), parted.alias("sub"), F.coalesce(F.col("home.src"), F.col("src")).alias("src"), F.coalesce(F.col("home.lng"), F.col("lng")).alias("lng"), "length")
    for column, rank in (("src", "source"), ("lng", "lang")):
        rows = rows.join(_rank(classes, column, rank), column).drop(column)
    return materialize(rows, "shard-rows"), leaves


def _first_over(hist: DataFrame, by: str, carry: list[str]) -> DataFrame:
    """The first `by` of each node whose running bytes, with `base`, pass the goal; base then holds the bytes before it."""
    w = Window.partitionBy("lo").orderBy(by)
    upto = hist.withColumn("upto", F.col("base") + F.sum("bytes").over(w)).filter(F.col("upto") > F.col("goal"))
    first = upto.withColumn("n", F.row_number().over(w)).filter("n = 1")
    return first.select("lo", F.col(by), (F.col("upto") - F.col("bytes")).alias("base"), *carry)


def _local(nodes: DataFrame) -> DataFrame | None:
    """`nodes` by way of the driver: one slim row per node, and nodes are at most as many as leaves."""
    rows = nodes.collect()
    return F.broadcast(nodes.sparkSession.createDataFrame(rows, nodes.schema)) if rows else None


def kd_tree(rows: DataFrame, leaves: int) -> tuple[DataFrame, list[DataFrame]]:
    """Rows with `lo`, their leaf from 0 to leaves - 1, and the splits of each level.

    Rows that tie in every dimension are ordered by key, so a tie of any size is
    still cut at its weighted quantile; rows of one key go to one side. Only one
    row per node and step comes to the driver.
    """
    placed = rows.withColumn("lo", F.lit(0).cast("long")).withColumn("k", F.lit(leaves).cast("long"))
    ends = rows.agg(F.count(F.lit(1)).alias("n"), *[f(d).alias(f"{n}_{d}") for d in DIMENSIONS for n, f in (("min", F.min), ("max", F.max))]).first()
    digits = max(1, min(6, math.ceil(math.log(max(2, ends["n"] / ROWS_PER_TASK), 16))))
    prefix = F.substring("key", 1, digits)
    spans = [max(1, (ends[f"max_{d}"] or 0) - (ends[f"min_{d}"] or 0)) for d in DIMENSIONS]
    value = F.element_at(F.array(*[F.col(d) for d in DIMENSIONS]), F.col("axis") + 1)
    splits = []
    for _ in range(math.ceil(math.log2(leaves)) if leaves > 1 else 0):
        live = placed.filter("k > 1")
        axes = F.posexplode(F.array(*[F.col(d) for d in DIMENSIONS])).alias("axis", "value")
        hist = live.select("lo", "k", "size", axes).groupBy("lo", "k", "axis", "value").agg(F.sum("size").alias("bytes"))
        width = (F.max("value") - F.min("value")) / F.element_at(F.array(*[F.lit(float(s)) for s in spans]), F.col("axis") + 1)
        nodes = hist.groupBy("lo", "k", "axis").agg(F.sum("bytes").alias("total"), width.alias("width"))
        nodes = nodes.groupBy("lo").agg(F.max_by(F.struct("axis", "k", "total"), F.struct("width", -F.col("axis"))).alias("w")).select("lo", "w.*")
        goal = F.expr("(total div k) * (k div 2) + ((total % k) * (k div 2)) div k")
        nodes = nodes.select("lo", "axis", F.expr("k div 2").alias("left_k"), goal.alias("goal"))
        at_value = _local(_first_over(hist.join(nodes, ["lo", "axis"]).withColumn("base", F.lit(0).cast("long")), "value", ["axis", "left_k", "goal"]))
        if at_value is None:
            break
        inside = live.join(at_value, "lo").filter(value == F.col("value")).withColumn("prefix", prefix)
        hist = inside.groupBy("lo", "prefix", "value", "base", "axis", "left_k", "goal").agg(F.sum("size").alias("bytes"))
        at_prefix = _local(_first_over(hist, "prefix", ["value", "axis", "left_k", "goal"]))
        edge = live.join(at_prefix, "lo").filter((value == F.col("value")) & (prefix == F.col("prefix")))
        edge = edge.groupBy("lo", "key", "value", "base", "axis", "left_k", "goal").agg(F.sum("size").alias("size"))  # one row for a key of any size
        upto = F.col("base") + F.sum("size").over(Window.partitionBy("lo").orderBy("key"))
        cut = edge.withColumn("upto", upto).filter("upto > goal").groupBy("lo", "axis", "value", "left_k").agg(F.min("key").alias("cut"))
        split = _local(cut)
        splits.append(split)

        goes_left = F.struct(value.alias("value"), F.col("key")) < F.struct(F.col("value"), F.col("cut").alias("key"))
        leaf = F.col("axis").isNull()
        placed = placed.join(split, "lo", "left").select(
            *rows.columns,
            F.when(leaf | goes_left, F.col("lo")).otherwise(F.col("lo") + F.col("left_k")).alias("lo"),
            F.when(leaf, F.col("k")).when(goes_left, F.col("left_k")).otherwise(F.col("k") - F.col("left_k")).alias("k"),
        )
        placed = materialize(placed, "shard-level")  # else each level would plan and broadcast all the splits above it anew
    return placed, splits


def shard(docs: DataFrame, target_bytes: int | None = None, leaves: int | None = None) -> DataFrame:
    """Put every document into a leaf: id, size, crc, shard, slot.

    Give `leaves`, or `target_bytes` for as many leaves as that takes. Size is
    the text's UTF-8 bytes plus 8; null counts as empty. Slots run from 0 without
    a gap in each shard. Missing source or lang sorts last. Repeated rows keep
    their count. Ids need not be unique or there at all. An empty table gives no
    rows. A text of any length is one row of its size. Only id, text, source and lang
    are read, whatever else the table has. Rows of one text, however many and
    short, are numbered by parts, so that none of them is a task's alone.
    """
    rows, leaves = describe(docs, leaves, target_bytes)
    placed, _ = kd_tree(rows, leaves)
    placed = placed.withColumnRenamed("lo", "shard")
    digits = max(1, min(6, math.ceil(math.log(max(2, rows.count() / ROWS_PER_PREFIX), 16))))
    placed = placed.withColumn("part", F.substring("key", 1, digits))
    counts = placed.groupBy("shard", "part", "sub").agg(F.count(F.lit(1)).alias("n"))
    before = materialize(counts.withColumn("before", F.sum("n").over(Window.partitionBy("shard").orderBy("part", "sub")) - F.col("n")).drop("n"), "shard-counts")
    order = Window.partitionBy("shard", "part", "sub").orderBy("key", "id", "crc", "size")
    return placed.join(before, ["shard", "part", "sub"]).select("id", "size", "crc", F.col("shard").cast("int").alias("shard"), (F.col("before") + F.row_number().over(order) - 1).alias("slot"))
