"""Prompts, batches, and what comes back from whoever describes objects."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catlas.app.cache import keep_answer, kept_answer
from catlas.functions.text import PROMPT_BODY_CHARS, RETURNS, trim
from catlas.operators.numbering import numbered
from catlas.storage import materialize

# Bytes and objects of one batch.
BATCH_BYTES, BATCH_OBJECTS = 40_000, 12
#: Rows whose batches are numbered together.
CHUNK = 4096
MAPS, ENTRIES = "at bigint, exits array<bigint>, counts array<bigint>", "at bigint, entry bigint, first bigint"
REPLY = "objects array<struct<name:string,sentence:string>>"
NO_BODY = "(no body: compiled or encrypted)"
CUT = "\n-- cut here"

_NOUN = {"table": "Table", "view": "View", "procedure": "Stored procedure", "function": "Function"}
_TASK = {
    "table": "Say in one sentence what the table holds and what one row of it is. For a lookup of codes, say that. Don't list its columns.",
    "view": "Say in one sentence what the view shows and where that comes from.",
    "procedure": "Say in one sentence what the procedure does and which tables it touches.",
    "function": "Say in one sentence what the function returns.",
}
_STYLE = "Begin with a verb, in the present tense."


def body(definition: Column) -> Column:
    """A definition of at most PROMPT_BODY_CHARS characters, marked where it is cut."""
    text = trim(definition)
    return F.when(text == "", F.lit(NO_BODY)).when(F.char_length(text) > PROMPT_BODY_CHARS, F.concat(F.substring(text, 1, PROMPT_BODY_CHARS), F.lit(CUT))).otherwise(text)


def columns(structure: Column) -> Column:
    line = lambda c: F.concat(F.lit("  "), c["name"], F.lit(" "), c["type"], c["length"], F.when(c["nullable"], F.lit("")).otherwise(F.lit(" not null")))
    listed = F.array_join(F.transform(structure["columns"], line), "\n")
    return F.when(F.size(structure["columns"]) == 0, F.lit("  (none recorded)")).otherwise(listed)


def parameters(structure: Column) -> Column:
    real = F.filter(structure["parameters"], lambda p: p["name"] != RETURNS)
    listed = F.array_join(F.transform(real, lambda p: F.concat_ws(" ", p["name"], p["type"])), ", ")
    return F.when(F.size(real) == 0, F.lit("No parameters.")).otherwise(F.concat(F.lit("Parameters: "), listed))


def prompt(kind: Column, key: Column, database: Column, rows: Column, structure: Column, sample: Column) -> Column:
    """The question about one object; an error for a kind that isn't described."""
    head = lambda k: F.concat(F.lit(f"{_NOUN[k]} "), key, F.lit(" in the "), database, F.lit(" database."))
    task = lambda k: F.lit(f"\n{_TASK[k]}\n{_STYLE}")
    keys = F.when(F.size(structure["primary_key"]) > 0, F.concat(F.lit("\nPrimary key: "), F.array_join(structure["primary_key"], ", ")))
    shown = F.when(sample != "", F.concat(F.lit("\nSample rows:\n"), sample))
    table = F.concat_ws("\n", head("table"), F.concat(rows.cast("string"), F.lit(" rows.\n\nColumns:")), columns(structure), keys, shown, task("table"))
    view = F.concat_ws("\n", head("view"), F.lit("\nColumns:"), columns(structure), F.lit("\nDefinition:"), body(structure["definition"]), task("view"))
    module = lambda k: F.concat_ws("\n", head(k), parameters(structure), F.lit("\nBody:"), body(structure["definition"]), task(k))
    return (
        F.when(kind == "table", table)
        .when(kind == "view", view)
        .when(kind == "procedure", module("procedure"))
        .when(kind == "function", module("function"))
        .otherwise(F.raise_error(F.concat(F.lit("no prompt for kind "), F.coalesce(kind, F.lit("null")))))
    )


def next_starts(costs: list[int], own: int, max_bytes: int, max_objects: int) -> list[int]:
    """For each of the first `own` items, where the batch that begins with it is followed by the next."""
    out = []
    for i in range(own):
        j, spent = i + 1, costs[i]
        while j < len(costs) and j - i < max_objects and spent + costs[j] <= max_bytes:
            spent, j = spent + costs[j], j + 1
        out.append(j)
    return out


def batches(items: DataFrame, max_bytes: int = BATCH_BYTES, max_objects: int = BATCH_OBJECTS, chunk: int = CHUNK) -> DataFrame:
    """(ord, key, cost) with `batch`: filled in order until the next item would pass a bound; an item beyond it stands alone.

    The sum starts anew with each batch, so where one begins depends on all before
    it. But a batch holds `max_objects` at most: whatever the items before a chunk
    of `chunk` are, the first batch that begins in it begins at one of its first
    `max_objects` places. Each chunk tells for each of these where it would be left
    and after how many batches; these maps are composed in order, and with the
    place known every chunk numbers its own rows. A null cost counts as 0.
    """
    slim = items.select("ord", "key", F.coalesce("cost", F.lit(0)).cast("long").alias("cost"))
    placed = numbered(slim, "ord", "key").withColumn("place", F.col("place") - 1)
    at, offset = F.floor(F.col("place") / chunk).alias("at"), (F.col("place") % chunk).alias("offset")
    own = placed.select("ord", "key", "cost", at, offset)
    # Each chunk also sees the costs of the next one's first items.
    halo = own.filter((F.col("offset") < max_objects) & (F.col("at") > 0)).withColumns({"at": F.col("at") - 1, "offset": F.col("offset") + chunk})
    seen = own.unionByName(halo)

    def leave(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("offset")
        n = int((pdf["offset"] < chunk).sum())
        follow = next_starts(pdf["cost"].tolist(), n, max_bytes, max_objects)
        exits, counts = list(range(n + max_objects)), [0] * (n + max_objects)
        for i in reversed(range(n)):
            exits[i], counts[i] = exits[follow[i]], counts[follow[i]] + 1
        return pd.DataFrame({"at": [pdf["at"].iloc[0]], "exits": [[x - n for x in exits[:max_objects]]], "counts": [counts[:max_objects]]})

    maps = materialize(seen.groupBy("at").applyInPandas(leave, MAPS), "batch-maps")
    entered = materialize(entries(maps, chunk), "batch-entries")

    def number(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("offset")
        n = int((pdf["offset"] < chunk).sum())
        follow = next_starts(pdf["cost"].tolist(), n, max_bytes, max_objects)
        start, batch = int(pdf["entry"].iloc[0]), int(pdf["first"].iloc[0])
        numbers = [batch - 1] * min(start, n)  # these belong to the batch that began before the chunk
        while start < n:
            numbers += [batch] * (min(follow[start], n) - start)
            start, batch = follow[start], batch + 1
        return pdf.head(n).assign(batch=numbers)[["ord", "key", "cost", "batch"]]

    schema = f"{slim.schema.simpleString()[7:-1]},batch:bigint".replace(":", " ")
    return seen.join(entered, "at").groupBy("at").applyInPandas(number, schema)


def entries(maps: DataFrame, fan: int) -> DataFrame:
    """(at, entry, first): where each chunk is entered, and the number of the first batch that begins there.

    `maps` has for each chunk and each place of entry the place in the next chunk
    and the batches begun. More than `fan` of them are composed in groups of `fan`
    first, whose maps are taken alike; only the last `fan` come to the driver.
    """
    spark = maps.sparkSession
    if maps.limit(fan + 1).count() <= fan:
        place, first, out = 0, 0, []
        for r in sorted(maps.collect(), key=lambda r: r["at"]):
            out.append((r["at"], place, first))
            place, first = r["exits"][place], first + r["counts"][place]
        return spark.createDataFrame(out, ENTRIES)
    grouped = maps.withColumn("up", F.floor(F.col("at") / fan))

    def compose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at")
        places = list(range(len(pdf["exits"].iloc[0])))
        begun = [0] * len(places)
        for exits, counts in zip(pdf["exits"], pdf["counts"], strict=True):
            begun = [n + counts[p] for n, p in zip(begun, places, strict=True)]
            places = [exits[p] for p in places]
        return pd.DataFrame({"at": [pdf["up"].iloc[0]], "exits": [places], "counts": [begun]})

    def unroll(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at")
        place, first, out = int(pdf["entry"].iloc[0]), int(pdf["first"].iloc[0]), []
        for at, exits, counts in zip(pdf["at"], pdf["exits"], pdf["counts"], strict=True):
            out.append((at, place, first))
            place, first = exits[place], first + counts[place]
        return pd.DataFrame(out, columns=["at", "entry", "first"])

    upper = entries(materialize(grouped.groupBy("up").applyInPandas(compose, MAPS), "batch-maps"), fan)
    return grouped.join(upper.withColumnRenamed("at", "up"), "up").groupBy("up").applyInPandas(unroll, ENTRIES)


def batch_prompts(items: DataFrame) -> DataFrame:
    """batch, n, prompt from items (batch, ord, key, prompt); a batch is bounded by BATCH_OBJECTS."""
    listed = F.array_sort(F.collect_list(F.struct("ord", "key", "prompt")))
    grouped = items.groupBy("batch").agg(listed.alias("items"))
    block = lambda x, i: F.concat(F.lit("=== OBJECT "), (i + 1).cast("string"), F.lit(": "), x["key"], F.lit(" ===\n"), x["prompt"])
    intro = F.concat(F.lit("Describe "), F.size("items").cast("string"), F.lit(" database objects, each marked below.\n\nAnswer with one entry per object, its `name` just as in the mark.\n\n"))
    return grouped.select("batch", F.size("items").alias("n"), F.concat_ws("\n\n", intro, F.array_join(F.transform("items", block), "\n\n")).alias("prompt"))


def ask(prompts: DataFrame, describer: Callable[[str], dict], folder: str, workers: int) -> DataFrame:
    """batch, reply, error, usage of prompts (batch, prompt), asked by `workers` tasks; the frame is written, asked once.

    `describer` goes to the executors. Each answer is kept in `folder`, which all of
    them share, by its prompt's digest before the task goes on, so that a task that
    is tried again, or the next build, pays for no prompt twice; an answer from the
    folder has no usage. A prompt that fails has an error and no reply.
    """

    def tell(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for batch, prompt in zip(part["batch"], part["prompt"], strict=True):
                reply, error, usage = None, None, {}
                try:
                    answer = kept_answer(Path(folder), prompt)
                    if answer is None:
                        answer = describer(prompt)
                        json.loads(answer["reply"])
                        keep_answer(Path(folder), prompt, answer)
                        usage = {k: float(v) for k, v in answer.items() if k != "reply"}
                    reply = answer["reply"]
                except Exception as failed:
                    error = str(failed)
                yield pd.DataFrame({"batch": [batch], "reply": [reply], "error": [error], "usage": [list(usage.items())]}).astype({"reply": object, "error": object})

    asked = prompts.select("batch", "prompt").repartitionByRange(max(1, workers), "batch")
    told = asked.mapInPandas(tell, "batch bigint, reply string, error string, usage array<struct<name:string,n:double>>")
    return materialize(told, "answers")


def answers(replies: DataFrame) -> DataFrame:
    """batch, name, sentence from replies (batch, reply); a reply that isn't of the schema is an error."""
    parsed = F.from_json("reply", REPLY, {"mode": "FAILFAST"})
    each = replies.select("batch", F.posexplode(parsed["objects"]).alias("pos", "o"))
    return each.select("batch", "pos", trim(F.coalesce(F.col("o.name"), F.lit(""))).alias("name"), trim(F.coalesce(F.col("o.sentence"), F.lit(""))).alias("sentence"))


def resolve(given: DataFrame, asked: DataFrame) -> DataFrame:
    """batch, key, sentence: answers (batch, pos, name, sentence) matched to asked (batch, key).

    A name matches its key in any case; failing that the one key of its batch
    that ends in the name after a dot. More than one such key matches none. The
    last of several answers for a key counts.
    """
    told = given.filter("name <> '' and sentence <> ''").withColumn("lowered", F.lower("name"))
    known = asked.select(F.col("batch").alias("b"), "key", F.lower("key").alias("lowered_key"))
    exact = told.join(known, (F.col("batch") == F.col("b")) & (F.col("lowered") == F.col("lowered_key"))).drop("b", "lowered_key")
    rest = told.join(exact.select("batch", "pos"), ["batch", "pos"], "left_anti")
    # Every dotted ending of a key, so that endings are matched by an equi-join.
    parts = F.split("lowered_key", "\\.")
    endings = known.select("b", "key", F.explode(F.transform(F.sequence(F.lit(2), F.greatest(F.size(parts), F.lit(2))), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))).alias("ending"))
    near = rest.join(endings, (F.col("batch") == F.col("b")) & (F.col("lowered") == F.col("ending"))).drop("b", "ending")
    unique = near.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("batch", "pos"))).filter("n = 1").drop("n")
    return exact.unionByName(unique).groupBy("batch", "key").agg(F.max_by("sentence", "pos").alias("sentence"))


def missing(items: DataFrame, sentences: DataFrame) -> DataFrame:
    return items.join(sentences, "key", "left_anti").select("key")


def described(entries: DataFrame, sentences: DataFrame, state: DataFrame) -> DataFrame:
    """Entries with description: the new sentence, or the prior description, or none."""
    prior = state.select("key", F.col("description").alias("prior"))
    joined = entries.join(sentences.select("key", "sentence"), "key", "left").join(prior, "key", "left")
    return joined.withColumn("description", F.coalesce("sentence", "prior", F.lit(""))).drop("sentence", "prior")
