"""What the training-data operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catlas.storage import materialize, shared_dir

__all__ = ["WORD", "key_bin", "materialize", "shared_dir", "shuffle_key", "sortable", "spread", "text_digest", "word_count"]

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def spread(rows: DataFrame, n: str, at: str, chunk: int = 4096) -> DataFrame:
    """Each row as often as its `n` says, numbered from 1 in `at`.

    Counts are cut into chunks that are dealt to all tasks, so one row of any
    count is no one task's.
    """
    chunks = rows.withColumn("__chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"({n} - 1) div {chunk}"))))
    dealt = chunks.repartition(*[F.col(c) for c in chunks.columns])
    last = F.least(F.lit(chunk).cast("long"), F.col(n) - F.col("__chunk") * chunk)
    each = dealt.withColumn("__one", F.explode(F.sequence(F.lit(1).cast("long"), last)))
    return each.withColumn(at, F.col("__chunk") * chunk + F.col("__one")).drop("__chunk", "__one")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sortable(col: Column) -> Column:
    """A never-null text that sorts by code point with null last."""
    return F.when(col.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), col.cast("string")))


def shuffle_key(*cols: Column) -> Column:
    """A fixed pseudo-random hexadecimal order key of the values."""
    return F.md5(F.concat_ws(":", *[F.coalesce(c.cast("string"), F.lit("null")) for c in cols]).cast("binary"))


def text_digest(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def key_bin(key: Column, bins: int) -> Column:
    """The bin of a hexadecimal key among `bins` equal ranges, in key order."""
    head = F.conv(F.substring(key, 1, 8), 16, 10).cast("long")
    return F.floor(head * F.lit(bins) / F.lit(1 << 32)).cast("long")
