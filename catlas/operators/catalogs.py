"""The index as text: catalogs, detail files, roster; and reading them back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catlas.functions import text as T

# The files of the index and their headings.
TRAILER = ("modified", "fingerprint", "description")
FACTS = {"table": ("rows", "size", "triggers", "cols"), "view": ("cols",), "procedure": ("params",), "function": ("returns", "params"), "synonym": ("target",)}
FILES = {"table": "tables.tsv", "view": "views.tsv", "procedure": "procedures.tsv", "function": "functions.tsv", "synonym": "synonyms.tsv"}
ROSTER_FILE, GUIDE_FILE = "databases.tsv", "README.md"
ROSTER = ("connection", "database", "engine", "tables", "views", "procedures", "functions", "synonyms", "built")
CUT = "-- definition cut"


def header(kind: str) -> list[str]:
    return ["name", *FACTS[kind], *TRAILER]


def _facts(kind: str) -> list[Column]:
    structure = F.col("structure")
    cols = F.size(structure["columns"]).cast("string")
    return {
        "table": [F.col("rows").cast("string"), T.size(F.col("kb")), F.col("triggers").cast("string"), cols],
        "view": [cols],
        "procedure": [T.parameters(structure["parameters"])],
        "function": [T.returns(structure["parameters"]), T.parameters(structure["parameters"])],
        "synonym": [structure["target"]],
    }[kind]


def catalog_rows(entries: DataFrame) -> DataFrame:
    """key, kind, cells of each entry (key, kind, rows, kb, triggers, modified, structure, fingerprint, description)."""
    cells = None
    for kind in FACTS:
        row = F.array(*[T.cell(F.coalesce(c, F.lit(""))) for c in (F.col("key"), *_facts(kind), F.col("modified"), F.col("fingerprint"), F.col("description"))])
        cells = F.when(F.col("kind") == kind, row) if cells is None else cells.when(F.col("kind") == kind, row)
    return entries.select("key", "kind", cells.alias("cells"))


def parse_rows(lines: DataFrame, kind: str) -> DataFrame:
    """key, cells of a catalog's lines (value): blanks, comments, headings and short rows are skipped; a row one cell short is padded."""
    width = len(header(kind))
    cells = F.split("value", "\t", -1)
    kept = lines.filter(~F.col("value").startswith("#") & (T.trim(F.col("value")) != "")).withColumn("cells", cells)
    kept = kept.filter((F.col("cells")[0] != "name") & (F.col("cells")[0] != "") & (F.size("cells") >= width - 1))
    padded = F.slice(F.concat("cells", F.array(F.lit(""))), 1, width)
    return kept.select(F.col("cells")[0].alias("key"), padded.alias("cells"))


def parse_state(rows: DataFrame, kind: str) -> DataFrame:
    """The state (key, kind, modified, fingerprint, description, rows) that a catalog's rows keep."""
    at = lambda name: F.col("cells")[header(kind).index(name)]
    count = T.number(at("rows")) if "rows" in FACTS[kind] else F.lit(0).cast("long")
    return rows.select("key", F.lit(kind).alias("kind"), *[at(c).alias(c) for c in TRAILER], count.alias("rows"))


def merge(old: DataFrame, new: DataFrame, gone: DataFrame) -> DataFrame:
    """key, kind, cells: new rows replace old ones, dropped keys go, all else stays; the order is the key's bytes."""
    fresh = new.select("key", "kind", F.col("cells").alias("fresh"))
    joined = old.join(fresh, ["key", "kind"], "full").select("key", "kind", F.coalesce("fresh", "cells").alias("cells"))
    return joined.join(gone.select("key"), "key", "left_anti").orderBy("kind", "key")


def column_file(kind: Column, key: Column, fingerprint: Column, rows: Column, kb: Column, triggers: Column, description: Column, structure: Column) -> Column:
    """A table's or view's file: comments, its columns as TSV, then key, indexes and references."""
    tab, none = F.lit("\t"), F.array().cast("array<string>")
    extra = lambda c: F.concat_ws(" ", F.when(c["identity"], F.lit("identity")), F.when(c["computed"], F.lit("computed")))
    row = lambda c: F.concat(T.cell(c["name"]), tab, T.cell(F.concat(c["type"], c["length"])), tab, F.when(c["nullable"], F.lit("null")).otherwise(F.lit("not null")), tab, extra(c))
    head = F.concat(F.lit("# "), key, F.lit(" @"), fingerprint)
    facts = F.concat(F.lit("# rows "), rows.cast("string"), F.lit("  size "), T.size(kb), F.lit("  triggers "), triggers.cast("string"))
    table = F.array_join(F.concat(F.array(F.lit("column\ttype\tnull\textra")), F.transform(structure["columns"], row)), "\n")
    keys = F.when(F.size(structure["primary_key"]) > 0, F.array(F.concat(F.lit("# pk "), F.array_join(structure["primary_key"], ", ")))).otherwise(none)
    index = lambda i: F.concat(F.lit("# index "), i["name"], F.lit(" ("), F.array_join(i["columns"], ", "), F.lit(")"), F.when(i["unique"], F.lit(" unique")).otherwise(F.lit("")))
    reference = lambda f: F.concat(F.lit("# fk "), f["column"], F.lit(" -> "), f["references"])
    lines = F.concat(
        F.array(head),
        F.when(kind == "table", F.array(facts)).otherwise(none),
        F.when(description != "", F.array(F.concat(F.lit("# "), T.cell(description)))).otherwise(none),
        F.array(T.trim_end(table)),
        keys,
        F.transform(structure["indexes"], index),
        F.transform(structure["foreign_keys"], reference),
    )
    return F.concat(F.array_join(lines, "\n"), F.lit("\n"))


def body_file(key: Column, fingerprint: Column, modified: Column, description: Column, definition: Column) -> Column:
    """A module's file: comments, a blank line, the redacted definition, and a mark if it was cut."""
    none = F.array().cast("array<string>")
    text = F.regexp_replace(definition, r"[ \t\n\r]+\z", "")
    lines = F.concat(
        F.array(F.concat(F.lit("-- "), key, F.lit(" @"), fingerprint)),
        F.when(F.coalesce(modified, F.lit("")) != "", F.array(F.concat(F.lit("-- modified "), modified))).otherwise(none),
        F.when(description != "", F.array(F.concat(F.lit("-- "), T.cell(description)))).otherwise(none),
        F.array(F.lit(""), text),
        F.when(F.octet_length(text) >= T.MAX_DEFINITION, F.array(F.lit(CUT))).otherwise(none),
    )
    return F.concat(F.array_join(lines, "\n"), F.lit("\n"))


def roster_rows(counts: DataFrame, connection: str, database: str, engine: str, built: Column) -> DataFrame:
    """One roster row from the merged catalogs' counts (kind, n)."""
    n = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("n"))), F.lit(0)).cast("string")
    row = [F.lit(connection), F.lit(database), F.lit(engine), *[n(k) for k in FILES], T.stamp(built)]
    agg = counts.agg(F.array(*row).alias("cells"))
    return agg.select(F.concat_ws("/", F.lit(connection), F.lit(database)).alias("key"), "cells")


def parse_roster(lines: DataFrame) -> DataFrame:
    """key, cells of a roster's lines (value), padded or cut to today's width."""
    width = len(ROSTER)
    cells = F.split("value", "\t", -1)
    kept = lines.filter(~F.col("value").startswith("#") & (T.trim(F.col("value")) != "")).withColumn("cells", cells)
    kept = kept.filter((F.size("cells") >= 2) & (F.col("cells")[0] != "connection") & (F.col("cells")[0] != "") & (F.try_element_at("cells", F.lit(2)) != ""))
    padded = F.slice(F.concat("cells", F.array_repeat(F.lit(""), width)), 1, width)
    return kept.select(F.concat_ws("/", F.col("cells")[0], F.col("cells")[1]).alias("key"), padded.alias("cells"))


def upsert_roster(old: DataFrame, new: DataFrame) -> DataFrame:
    fresh = new.select("key", F.col("cells").alias("fresh"))
    return old.join(fresh, "key", "full").select("key", F.coalesce("fresh", "cells").alias("cells")).orderBy("key")


def positive_counts(cells: Column) -> Column:
    """kind: count of a roster row's counts that are numbers above 0."""
    names = ROSTER[3:-1]
    every = F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*[cells[ROSTER.index(n)].try_cast("double") for n in names]))
    return F.map_filter(every, lambda _, n: n.isNotNull() & (n > 0))


def line(cells: Column) -> Column:
    return F.array_join(cells, "\t")
