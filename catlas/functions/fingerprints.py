"""Content fingerprints, as expressions over kind, rows, triggers and structure."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import digest, normalise

# Fixed value: rows of a sample, and so the depth at which a table's size stops to matter.
SAMPLE_ROWS = 25


def sample_depth(rows: Column) -> Column:
    return F.greatest(F.least(rows, F.lit(SAMPLE_ROWS)), F.lit(0)).cast("long")


def canonical_table(structure: Column, triggers: Column, rows: Column) -> Column:
    """The text that a table's fingerprint is taken over: a line for each column, key part, reference and index, then triggers and depth."""
    blank = F.lit(" ")
    marked = lambda c, mark: F.when(c, F.lit(f" {mark}")).otherwise(F.lit(""))
    columns = F.transform(
        structure["columns"],
        lambda c: F.concat(F.lit("c "), c["name"], blank, c["type"], c["length"], F.when(c["nullable"], F.lit(" null")).otherwise(F.lit(" notnull")), marked(c["identity"], "id"), marked(c["computed"], "gen")),
    )
    keys = F.transform(structure["primary_key"], lambda k: F.concat(F.lit("pk "), k))
    references = F.transform(structure["foreign_keys"], lambda f: F.concat(F.lit("fk "), f["column"], F.lit(" -> "), f["references"]))
    indexes = F.transform(structure["indexes"], lambda i: F.concat(F.lit("ix "), i["name"], blank, F.array_join(i["columns"], ","), marked(i["unique"], "u")))
    tail = F.array(F.concat(F.lit("tg "), triggers.cast("string")), F.concat(F.lit("rows "), sample_depth(rows).cast("string")))
    return F.array_join(F.concat(columns, keys, references, indexes, tail), "\n")


def fingerprint(kind: Column, structure: Column, triggers: Column, rows: Column) -> Column:
    """By kind: a table's canonical text, a module's normalised body, a synonym's target. Another kind is an error."""
    return (
        F.when(kind == "table", digest(canonical_table(structure, triggers, rows)))
        .when(kind.isin("view", "procedure", "function"), digest(normalise(structure["definition"])))
        .when(kind == "synonym", digest(structure["target"]))
        .otherwise(F.raise_error(F.concat(F.lit("no fingerprint rule for kind "), F.coalesce(kind, F.lit("null")))))
    )
