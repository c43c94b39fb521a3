"""Which tables and columns are sampled, in which order, and how samples read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catlas.functions.fingerprints import SAMPLE_ROWS
from catlas.functions.redaction import classify, sampleable
from catlas.functions.text import CELL_CHARS, sample_cell

#: Why a column is withheld, in the order notes give them.
WITHHELD = ("pii", "unsampleable")


def project(tables: DataFrame) -> DataFrame:
    """key, rows, readable, withheld, complete of each table (key, kind, rows, columns) with a readable column.

    Personal data is tested first, by name; then types that can't be shown.
    """
    reason = lambda c: F.when(classify(c["name"]).isNotNull(), F.lit("pii")).when(~sampleable(c["type"]), F.lit("unsampleable"))
    planned = tables.filter("kind = 'table'").select(
        "key",
        "rows",
        F.transform(F.filter("columns", lambda c: reason(c).isNull()), lambda c: c["name"]).alias("readable"),
        F.filter(F.transform("columns", lambda c: F.struct(c["name"].alias("column"), reason(c).alias("reason"))), lambda w: w["reason"].isNotNull()).alias("withheld"),
        (F.col("rows") <= SAMPLE_ROWS).alias("complete"),
    )
    return planned.filter(F.size("readable") > 0)


def order(plans: DataFrame, limit: int = 0) -> DataFrame:
    """Tables that fit whole first, then the smaller, then by key; `limit` above 0 keeps the first ones."""
    by = [F.col("complete").desc(), F.col("rows"), F.col("key")]
    cut = plans.orderBy(*by).limit(limit) if limit > 0 else plans
    place = Window.orderBy(*by)  # one row per table of the catalog
    return cut.withColumn("place", F.row_number().over(place)).withColumn("of", F.count(F.lit(1)).over(Window.partitionBy()))


def withheld_note(withheld: Column) -> Column:
    """A line for each reason with its columns; empty without any."""
    lines = []
    for reason in WITHHELD:
        names = F.transform(_of(withheld, reason), lambda w: w["column"])
        lines.append(F.when(F.size(names) > 0, F.concat(F.lit(f"# not sampled ({reason}): "), F.array_join(names, ", "))))
    return F.concat_ws("\n", *lines)


def _of(withheld: Column, reason: str) -> Column:
    return F.filter(withheld, lambda w: w["reason"] == reason)


def projection(columns: list[str]) -> list[Column]:
    """Each column as text of at most CELL_CHARS characters; null as empty."""
    quoted = ["`" + c.replace("`", "``") + "`" for c in columns]
    return [F.substring(F.coalesce(F.col(q).cast("string"), F.lit("")), 1, CELL_CHARS).alias(c) for q, c in zip(quoted, columns, strict=True)]


def rows(table: DataFrame, columns: list[str], n: int = SAMPLE_ROWS) -> list[list[str]]:
    """The first rows that come, never sorted; without columns or rows to read nothing is asked."""
    if not columns or n < 1:
        return []
    return [list(r) for r in table.select(projection(columns)).limit(n).collect()]


def render(columns: Column, values: Column, withheld: Column) -> Column:
    """Headings, rows and the note on what was withheld, in lines; empty if there is nothing to say."""
    head = F.array_join(columns, "\t")
    body = F.transform(values, lambda row: F.array_join(F.transform(row, sample_cell), "\t"))
    note = withheld_note(withheld)
    lines = F.concat(F.array(head), body, F.when(note != "", F.array(note)).otherwise(F.array().cast("array<string>")))
    return F.when((F.size(columns) == 0) & (F.size(withheld) == 0), F.lit("")).otherwise(F.array_join(lines, "\n"))
