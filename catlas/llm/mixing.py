"""Mixing sources to target weights by weighted fair queueing.

Every copy of every document gets a virtual finish time: the words its source
has sent up to and including it, over the source's target. All copies are put in
one global order by that time, and the order is cut where the budget is spent.
Because a source's copies finish in a fixed order, the cut leaves a prefix of
each source, so one row per source (its last taken copy) carries the whole
decision and documents are never shuffled with their texts.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import key_bin, materialize, shuffle_key, sortable, spread, text_digest, word_count

#: Rows of all sources in one range of the order key; a task sorts one source's part of it.
ROWS_PER_BIN = 1024


@dataclass
class Mixture:
    """documents: __id, __src, __size, __key, __at, one row per input row (__at
    numbers rows equal in id, text and source); sources: __src, source_size,
    target, cut (last taken copy, or null) and split (the cut parts equal rows)."""

    documents: DataFrame
    sources: DataFrame

    def copies(self) -> DataFrame:
        """Each document with source_size, target and the copies taken."""
        cut = F.col("cut")
        in_last = (F.col("__key") < cut["key"]) | ((F.col("__key") == cut["key"]) & (F.col("__at") <= cut["at"]))
        return self.documents.join(self.sources, "__src", "left").withColumn("copies", _copies(in_last))


def _copies(in_last: Column) -> Column:
    """The full turns a source's queue has had, and one more for rows up to the cut."""
    cut = F.col("cut")
    return F.when(cut.isNull(), F.lit(0)).otherwise(cut["copy"] + F.when(in_last, 1).otherwise(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, max_repeats: int) -> DataFrame:
    """Water-filling: sources ordered by cap over weight; those whose cap lies
    under the level of the rest are capped, the rest share what is left."""
    everything = Window.orderBy("__src")  # one row per source, not per document
    by_ratio = Window.orderBy("ratio", "__src")
    cap = F.col("source_size").cast("double") * max_repeats
    ranked = (
        sizes.withColumn("rank", F.row_number().over(everything))
        .withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int")))
        .withColumn("cap", cap)
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("budget", F.sum("source_size").over(Window.partitionBy()).cast("double") * share)
    )
    before = F.sum("cap").over(by_ratio) - F.col("cap")
    left = F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    level = ranked.withColumn("level", (F.col("budget") - before) / left)
    capped = F.col("ratio") <= F.col("level")
    shared = F.max(F.when(~capped, F.col("level"))).over(Window.partitionBy())
    return level.withColumn("target", F.when(capped, F.col("cap")).otherwise(shared * F.col("weight"))).select("__src", "source_size", "target")


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, max_repeats: int = 2, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> Mixture:
    """Plan a mixture of all `docs`.

    Sources in code point order, null last, take `weights` in turn; together they
    get `share` of all words, none more than `max_repeats` times its own. Null
    and empty texts have size 0 and take no words. Rows of one id and different
    texts have places of their own; rows equal in id, text and source follow each
    other, and the cut may part them. An empty table gives empty frames. A
    source without words has target 0. Only DataFrame functions are used.
    """
    slim = docs.select(
        F.col(id_col).alias("__id"), sortable(F.col(source_col)).alias("__src"), word_count(F.col(text_col)).alias("__size"), shuffle_key(F.col(id_col), text_digest(F.col(text_col))).alias("__key")
    )
    # Equal rows are one class whatever their number, so none of what follows meets them in one task.
    classes = materialize(slim.groupBy("__src", "__key", "__id", "__size").agg(F.count(F.lit(1)).alias("__n")), "mix-classes")
    total_rows, total_classes = classes.agg(F.coalesce(F.sum("__n"), F.lit(0)), F.count(F.lit(1))).first()
    bins = max(1, math.ceil(min(total_classes / ROWS_PER_BIN, 4 * math.sqrt(total_classes))))  # few enough to add up per source
    placed = classes.withColumn("__words", F.col("__size") * F.col("__n")).withColumn("__bin", key_bin(F.col("__key"), bins))

    sizes = placed.groupBy("__src", "__bin").agg(F.sum("__words").alias("words"))
    in_source = Window.partitionBy("__src").orderBy("__bin")
    offsets = materialize(
        sizes.withColumn("before", F.sum("words").over(in_source) - F.col("words")).join(
            targets(classes.groupBy("__src").agg(F.sum(F.col("__size") * F.col("__n")).alias("source_size")), weights, share, max_repeats), "__src"
        ),
        "mix-offsets",
    )

    in_bin = Window.partitionBy("__src", "__bin").orderBy("__key", "__id").rowsBetween(Window.unboundedPreceding, -1)
    queued = placed.join(offsets, ["__src", "__bin"]).withColumn("__before", F.col("before") + F.coalesce(F.sum("__words").over(in_bin), F.lit(0)))
    queued = queued.select("__id", "__src", "__size", "__key", "__n", "__before", "source_size", "target")
    documents = materialize(spread(queued, "__n", "__at"), "mix-documents")
    sent = F.col("__before") + F.col("__at") * F.col("__size")
    queue = (
        documents.filter("target > 0 and __size > 0")  # a row without words moves no clock
        .withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(max_repeats - 1))))
        .withColumn("finish", (sent + F.col("copy") * F.col("source_size")) / F.col("target"))
    )
    # The global order: ranges of the finish time, then rows within the range where the budget runs out.
    ranges = max(1, math.isqrt(total_rows * max_repeats))
    queue = materialize(
        queue.withColumn("range", F.floor(F.col("finish") * ranges).cast("long")).select("__src", "__key", "__at", "__n", "__size", "copy", "finish", "range"),
        "mix-queue",
    )
    total = offsets.select("__src", "target").distinct().agg(F.floor(F.sum("target") + F.lit(1e-6)).cast("long").alias("n")).first()["n"] or 0
    in_order = queue.groupBy("range").agg(F.sum("__size").alias("words")).withColumn("upto", F.sum("words").over(Window.orderBy("range")))
    last = in_order.filter(F.col("upto") > total).orderBy("range").limit(1).collect()
    taken = queue
    if last:
        at, room = last[0]["range"], total - (last[0]["upto"] - last[0]["words"])
        edge = queue.filter(F.col("range") == at).withColumn("upto", F.sum("__size").over(Window.orderBy("finish", "__src", "copy", "__key", "__at")))
        columns = ["__src", "copy", "__key", "__at", "__n"]
        taken = queue.filter(F.col("range") < at).select(columns).unionByName(edge.filter(F.col("upto") <= room).select(columns))
    cuts = taken.groupBy("__src").agg(F.max(F.struct("copy", F.col("__key").alias("key"), F.col("__at").alias("at"), F.col("__n").alias("n"))).alias("cut"))
    sources = offsets.select("__src", "source_size", "target").distinct().join(cuts, "__src", "left")
    sources = sources.withColumn("split", F.coalesce(F.col("cut")["at"] < F.col("cut")["n"], F.lit(False)))
    return Mixture(documents.select("__id", "__src", "__size", "__key", "__at"), materialize(sources, "mix-sources"))


def apply(mixture: Mixture, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mixed documents: every row of `docs` as often as it is taken.

    `docs` keeps its columns; it is joined with one row per source only. Where a
    source's cut parts rows equal in id, text and source, the first of them in
    the order of their whole rows' digests are taken once more.
    """
    columns = docs.columns
    row = F.struct(*[F.col(f"`{c}`") for c in columns]).alias("__row")
    key = shuffle_key(F.col(f"`{id_col}`"), text_digest(F.col(f"`{text_col}`"))).alias("__key")
    joined = docs.select(row, key, sortable(F.col(f"`{source_col}`")).alias("__src")).join(mixture.sources, "__src")
    cut = F.col("cut")
    parted = F.col("split") & (F.col("__key") == cut["key"])
    counted = joined.filter(~F.coalesce(parted, F.lit(False))).select("__row", _copies(F.col("__key") <= cut["key"]).alias("__n"))
    if mixture.sources.filter("split").limit(1).count():
        same = joined.filter(parted).withColumn("__digest", F.md5(F.to_json("__row").cast("binary")))
        each = same.groupBy("__src", "__digest").agg(F.first("__row").alias("__row"), F.first("cut").alias("cut"), F.count(F.lit(1)).alias("__rows"))
        upto = F.sum("__rows").over(Window.partitionBy("__src").orderBy("__digest"))
        more = F.greatest(F.lit(0), F.least(F.col("__rows"), cut["at"] - (upto - F.col("__rows"))))
        edge = each.withColumn("__more", more).select("__row", (cut["copy"] * F.col("__rows") + F.col("__more")).cast("long").alias("__n"))
        edge = spread(materialize(edge.filter("__n > 0"), "mix-edge"), "__n", "__at").select("__row", F.lit(1).cast("long").alias("__n"))
        counted = counted.unionByName(edge)
    copies = counted.filter("__n > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__n"))))
    return copies.select(*[F.col(f"__row.`{c}`").alias(c) for c in columns])
