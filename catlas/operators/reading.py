"""Questions to an index: who mentions an object, who writes to it, what is stale."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catlas.functions.text import age_hours, human_age

#: A word: letters, digits and underscores of ASCII, and whatever else isn't ASCII.
WORD = r"[A-Za-z0-9_\x{80}-\x{10FFFF}]+"


def mentions(bodies: DataFrame, key: str) -> DataFrame:
    """Bodies (key, text) that hold the key, as written."""
    return bodies.filter(F.contains("text", F.lit(key))).select("key")


def writers(bodies: DataFrame, key: str) -> DataFrame:
    """Bodies with a line that has a writing word and, within 40 characters and the same statement, the key, in any case."""
    quoted = "".join(c if c.isalnum() or c == "_" else "\\" + c for c in key)
    pattern = rf"(?iu)(insert|update|delete|merge)[^;]{{0,40}}{quoted}"
    lines = bodies.select("key", F.explode(F.split("text", "\n")).alias("line"))
    return lines.filter(F.col("line").rlike(pattern)).select("key").distinct()


def _folded(text: Column) -> Column:
    """Text in which letters that match in any case are the same."""
    return F.regexp_replace(F.lower(F.upper(text)), "\u0307", "")


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))


def candidates(bodies: DataFrame, keys: DataFrame, any_case: bool) -> DataFrame:
    """(key, body, text): lines of bodies (key, text) with a word that the last word of a key of `keys` (key) begins.

    Wherever a key stands, its last word begins a word of that line. So the words
    of all bodies are one vocabulary, keys are joined to its words' beginnings,
    and what is found to the lines that hold these words: every key is looked up
    in one pass, and lines move only for words that some key asks for. A key
    without a word (nothing but ASCII marks) is not looked up.
    """
    fold = _folded if any_case else lambda c: c
    lines = bodies.select(F.col("key").alias("body"), F.posexplode(F.split("text", "\n")).alias("at", "text"))
    words = lines.select("body", "at", F.explode(F.array_distinct(_words(fold(F.col("text"))))).alias("word"))
    asked = keys.select("key").distinct().withColumn("last", F.try_element_at(_words(fold(F.col("key"))), F.lit(-1))).filter("last is not null")
    longest = asked.agg(F.coalesce(F.max(F.char_length("last")), F.lit(0))).first()[0]
    vocabulary = words.select("word").distinct()
    begins = vocabulary.select("word", F.explode(F.sequence(F.lit(1), F.least(F.char_length("word"), F.lit(longest)))).alias("n")).filter("n > 0")
    wanted = begins.select("word", F.substring("word", F.lit(1), F.col("n")).alias("last")).join(asked, "last").select("word", "key")
    found = words.join(wanted, "word").select("body", "at", "key").distinct()
    return lines.join(found, ["body", "at"]).select("key", "body", "text")


def all_mentions(bodies: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, body) for every key of `keys` and every body (key, text) that holds it as written: `mentions` of all keys in one pass."""
    return candidates(bodies, keys, False).filter(F.contains("text", F.col("key"))).select("key", "body").distinct()


def all_writers(bodies: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, body) for every key and every body with a line that writes to it: `writers` of all keys in one pass."""
    pattern = F.concat(F.lit(r"(?iu)(insert|update|delete|merge)[^;]{0,40}"), F.regexp_replace("key", r"([^\p{L}\p{N}_])", r"\\$1"))
    writing = bodies.withColumn("text", F.array_join(F.filter(F.split("text", "\n"), lambda x: x.rlike(r"(?iu)insert|update|delete|merge")), "\n"))
    return candidates(writing, keys, True).filter(F.regexp_like("text", pattern)).select("key", "body").distinct()


def oldest_build(rows: DataFrame) -> DataFrame:
    """The roster row (pos, connection, database, built) with the oldest stamp that can be read; the first of equals."""
    at = F.try_to_timestamp("built")
    picked = rows.withColumn("at", at).filter("at is not null").agg(F.min_by(F.struct("connection", "database", "built", "at"), F.struct("at", "pos")).alias("r"))
    return picked.filter("r is not null").select("r.connection", "r.database", "r.built", "r.at")


def tree_ages(rows: DataFrame, now: Column) -> DataFrame:
    """Each tree's stalest database (tree, connection, database, built) and its age in hours and in words."""
    at = F.try_to_timestamp("built")
    first = Window.partitionBy("tree").orderBy("at", "pos")
    stale = rows.withColumn("at", at).filter("at is not null").withColumn("n", F.row_number().over(first)).filter("n = 1")
    hours = age_hours(F.col("at"), now)
    return stale.select("tree", "connection", "database", "built", hours.alias("hours"), human_age(hours).alias("age"))


def reminder(trees: DataFrame, threshold_hours: float) -> str | None:
    """One line: a remote tree that hasn't been fetched, else the worst tree of the threshold's age or more.

    trees: pos, name, remote, present, hours, connection, database, built, age;
    a few rows, one per registered tree.
    """
    rows = trees.orderBy("pos").collect()
    for r in rows:
        if r["remote"] and not r["present"]:
            return f"the {r['name']} index has not been fetched yet"
    aged = [r for r in rows if r["present"] and r["hours"] is not None]
    worst = max(aged, key=lambda r: r["hours"], default=None)
    if worst is None or worst["hours"] < threshold_hours:
        return None
    what = f"{worst['connection']}/{worst['database']}" if worst["connection"] else worst["name"]
    return f"{what} was last indexed {worst['age']} ago ({worst['built'][:10]})"
