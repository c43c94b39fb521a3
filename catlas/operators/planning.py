"""What a build must read again, and what it must describe again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catlas.functions.fingerprints import sample_depth
from catlas.operators.numbering import numbered
from catlas.schemas import DESCRIBABLE, same_signal

#: Reasons to fetch, in the order they are asked.
REASONS = ("new", "modified", "sample")


def fetch_plan(objects: DataFrame, state: DataFrame) -> DataFrame:
    """Tier 1, over the whole manifest: key, action (fetch, reuse, dropped) and reason.

    An object is fetched if the last build didn't have it, if its modify signal
    moved or is absent, or, for a table, if the rows a sample would show changed
    in number. What only the state has is dropped.
    """
    prior = state.select("key", F.col("modified").alias("prior_modified"), F.col("rows").alias("prior_rows"), F.lit(True).alias("known"))
    joined = objects.join(prior, "key", "left")
    reason = (
        F.when(F.col("known").isNull(), F.lit("new"))
        .when(~same_signal(F.col("modified"), F.col("prior_modified")), F.lit("modified"))
        .when((F.col("kind") == "table") & (sample_depth(F.col("prior_rows")) != sample_depth(F.col("rows"))), F.lit("sample"))
    )
    planned = joined.select("key", F.when(reason.isNull(), F.lit("reuse")).otherwise(F.lit("fetch")).alias("action"), reason.alias("reason"))
    gone = state.join(objects, "key", "left_anti").select("key", F.lit("dropped").alias("action"), F.lit(None).cast("string").alias("reason"))
    return planned.unionByName(gone)


def dropped(objects: DataFrame, state: DataFrame) -> DataFrame:
    return state.join(objects, "key", "left_anti").select("key").orderBy("key")


def describe_plan(fetched: DataFrame, state: DataFrame) -> DataFrame:
    """Tier 2: `fetched` (key, kind, fingerprint) with action describe or unchanged, and the prior description.

    Unchanged means the same fingerprint and a description that isn't empty.
    """
    prior = state.select("key", F.col("fingerprint").alias("prior_fingerprint"), F.col("description").alias("prior_description"))
    same = F.coalesce((F.col("fingerprint") == F.col("prior_fingerprint")) & (F.col("prior_description") != ""), F.lit(False))
    return fetched.join(prior, "key", "left").withColumn("action", F.when(same, F.lit("unchanged")).otherwise(F.lit("describe"))).drop("prior_fingerprint")


def describable(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("kind").isin(*DESCRIBABLE))


def narrow(objects: DataFrame, match: str = "", limit: int = 0) -> DataFrame:
    """Objects whose key holds `match` in any case, then the first `limit` in manifest order; 0 takes all."""
    out = objects.filter(F.contains(F.lower("key"), F.lit(match.lower()))) if match else objects
    return out.orderBy("schema", "name").limit(limit) if limit > 0 else out


def reason_counts(selected: DataFrame, plan: DataFrame) -> DataFrame:
    """reason, n: of the selected objects that are to be fetched."""
    return plan.filter("action = 'fetch'").join(selected.select("key"), "key", "left_semi").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def reasons_text(counts: dict[str, int]) -> str:
    """reason n, ... in the planner's order, or none."""
    return ", ".join(f"{r} {counts[r]}" for r in REASONS if counts.get(r)) or "none"


def cache_hits(selected: DataFrame, cache: DataFrame) -> DataFrame:
    """`selected` (key, modified) with `hit`: the cache (key, signal) holds it under the same, present signal."""
    held = cache.select("key", "signal").distinct().withColumn("held", F.lit(True))
    on = (selected["key"] == held["key"]) & same_signal(selected["modified"], held["signal"])
    return selected.join(held, on, "left").select(*[selected[c] for c in selected.columns], F.coalesce("held", F.lit(False)).alias("hit"))


def key_batches(keys: DataFrame, size: int = 40) -> DataFrame:
    """Keys in batches of a fixed size, in key order, numbered range by range."""
    return numbered(keys.select("key"), "key").select("key", F.floor((F.col("place") - 1) / size).cast("long").alias("batch"))
