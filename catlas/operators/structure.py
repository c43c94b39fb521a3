"""Folding flat catalog rows, one per column or parameter, into one structure per object.

Every input row carries `ord`, its place in the catalog's order: collect_list
after a shuffle keeps none. Rows are shuffled by their object once, not as lists,
which would hold as much and be built twice. They are made one value each before
the shuffle, in compiled code: collect_list interprets what it is given.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catlas.schemas import COLUMN, FOREIGN_KEY, INDEX, PARAM


def _gathered(rows: DataFrame, *values: str | Column) -> DataFrame:
    """(key, rows): a list of the values of each key's rows, sorted."""
    return rows.select("key", F.struct(*values).alias("row")).repartition("key").groupBy("key").agg(F.sort_array(F.collect_list("row")).alias("rows"))


def _listed(rows: DataFrame, name: str, *values: str) -> DataFrame:
    """(key, name): the values in the order of `ord`."""
    return _gathered(rows, "ord", F.struct(*values).alias("value")).select("key", F.col("rows")["value"].alias(name))


def fold_columns(rows: DataFrame) -> DataFrame:
    """(key, ord, name, type, length, nullable, identity, computed) to (key, columns)."""
    return _listed(rows, "columns", "name", "type", "length", "nullable", "identity", "computed")


def fold_indexes(rows: DataFrame) -> DataFrame:
    """(key, ord, index, primary, unique, column) to (key, primary_key, indexes).

    Indexes stand in the order of their first rows. The first primary one gives
    the key; further primary ones are kept as indexes.
    """
    sorted_ = _gathered(rows, "index", "ord", "column", "primary", "unique")
    # An index is a run of rows; 1-based places of the runs' first rows, and where the next one begins.
    row, places = lambda at: F.element_at("rows", at), F.sequence(F.lit(1), F.size("rows"))
    first = lambda at: (at == 1) | ~row(at)["index"].eqNullSafe(row(F.greatest(at - 1, F.lit(1)))["index"])
    runs = sorted_.select("key", "rows", F.filter(places, first).alias("starts"))
    runs = runs.withColumn("ends", F.concat(F.slice("starts", F.lit(2), F.size("starts")), F.array(F.size("rows") + 1)))
    value = lambda at, end: F.struct(row(at)["ord"].alias("ord"), row(at)["index"].alias("index"), row(at)["primary"].alias("primary"), row(at)["unique"].alias("unique"), F.slice("rows", at, end - at)["column"].alias("columns"))
    listed = runs.select("key", F.sort_array(F.zip_with("starts", "ends", value)).alias("all"))
    primary = F.filter("all", lambda i: i["primary"])
    lifted = F.when(F.size(primary) > 0, F.element_at(primary, 1)["index"])
    rest = F.filter("all", lambda i: ~i["primary"] | (i["index"] != F.coalesce(lifted, F.lit(""))))
    return listed.select(
        "key",
        F.when(F.size(primary) > 0, F.element_at(primary, 1)["columns"]).otherwise(F.array().cast("array<string>")).alias("primary_key"),
        F.transform(rest, lambda i: F.struct(i["index"].alias("name"), i["unique"].alias("unique"), i["columns"].alias("columns"))).alias("indexes"),
    )


def fold_foreign_keys(rows: DataFrame) -> DataFrame:
    """(key, ord, column, references) to (key, foreign_keys)."""
    return _listed(rows, "foreign_keys", "column", "references")


def fold_parameters(rows: DataFrame) -> DataFrame:
    """(key, ord, name, type, output) to (key, parameters)."""
    return _listed(rows, "parameters", "name", "type", "output")


def structures(objects: DataFrame, columns: DataFrame, indexes: DataFrame, foreign_keys: DataFrame, parameters: DataFrame, definitions: DataFrame, targets: DataFrame) -> DataFrame:
    """`objects` (with key) and their structure; what an object lacks is empty."""
    empty = lambda t: F.array().cast(f"array<{t}>")
    joined = objects
    for part in (fold_columns(columns), fold_indexes(indexes), fold_foreign_keys(foreign_keys), fold_parameters(parameters), definitions.select("key", "definition"), targets.select("key", "target")):
        joined = joined.join(part, "key", "left")
    structure = F.struct(
        F.coalesce("columns", empty(COLUMN)).alias("columns"),
        F.coalesce("primary_key", empty("string")).alias("primary_key"),
        F.coalesce("foreign_keys", empty(FOREIGN_KEY)).alias("foreign_keys"),
        F.coalesce("indexes", empty(INDEX)).alias("indexes"),
        F.coalesce("parameters", empty(PARAM)).alias("parameters"),
        F.coalesce("definition", F.lit("")).alias("definition"),
        F.coalesce("target", F.lit("")).alias("target"),
    )
    return joined.select(*objects.columns, structure.alias("structure"))
