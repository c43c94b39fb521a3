"""Chat formatting by multi-party perspective rotation.

For every participant of a conversation the whole dialogue is rendered with that
speaker as the assistant and the others as named users, with the spans to learn
from. System turns belong to no participant and stay system turns.

A dialogue is one row per speaker, block 0, as long as its turns hold at most
MAX_BYTES; a longer one, which no row should hold, goes on in further blocks of
that size, each opening with the dialogue's first system turns, so that a reader
of any block knows what the dialogue is about. No turn is left out.

Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Bytes of turns in one rendered row.
MAX_BYTES = 16 << 20
#: Rendering of one turn: head, text, end. Marks are broken up inside texts and names.
OPEN, CLOSE, END = "<|", "|>\n", "<|end|>\n"
#: Turns whose positions are added up together.
CHUNK = 512
#: What a head and an end add to a turn's own bytes, about.
MARKS = 32


def _head(role: Column, speaker: Column) -> Column:
    shown = F.replace(F.replace(F.replace(role, F.lit("|>"), F.lit("| >")), F.lit(OPEN), F.lit("< |")), F.lit("\n"), F.lit(" "))
    named = F.concat(F.lit("user name="), shown)
    who = F.when(role == "system", F.lit("system")).when(role == speaker, F.lit("assistant")).otherwise(named)
    return F.concat(F.lit(OPEN), who, F.lit(CLOSE))


def _blocks(turns: DataFrame, max_bytes: int) -> DataFrame:
    """(conv_id, block, turns) of conversations beyond `max_bytes`.

    Turns are put in one global order by ranges, and bytes are added up range by
    range, so that a conversation of any length is spread over many tasks.
    """
    order = ["conv_id", "place", "role", "text", "__salt"]
    # Equal turns follow each other in any order; the salt only lets a range end between them.
    ranged = turns.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(1 << 16))).repartitionByRange(*order)
    ranged = materialize(ranged.withColumn("__range", F.spark_partition_id()), "chat-ranges")
    sums = ranged.groupBy("conv_id", "__range").agg(F.sum("bytes").alias("n"))
    before = sums.select("conv_id", "__range", (F.sum("n").over(Window.partitionBy("conv_id").orderBy("__range")) - F.col("n")).alias("before"))
    before = before.select(F.col("conv_id").alias("c"), F.col("__range").alias("r"), "before")
    placed = ranged.join(before, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("__range") == F.col("r")))
    upto = F.col("before") + F.sum("bytes").over(Window.partitionBy("__range", "conv_id").orderBy(*order[1:]).rowsBetween(Window.unboundedPreceding, 0))
    block = F.floor((upto - F.col("bytes")) / F.lit(max_bytes)).cast("long")
    gathered = placed.withColumn("block", block).groupBy("conv_id", "block").agg(F.array_sort(F.collect_list(F.struct("place", "role", "text"))).alias("turns"))
    gathered = materialize(gathered, "chat-blocks")
    opening = gathered.filter("block = 0").select(F.col("conv_id").alias("c"), F.filter("turns", lambda t: t["role"] == "system").alias("opening"))
    none = F.slice("opening", 1, 0)
    led = gathered.join(opening, F.col("conv_id").eqNullSafe(F.col("c")), "left")
    return led.select("conv_id", "block", F.concat(F.when(F.col("block") > 0, F.col("opening")).otherwise(none), F.col("turns")).alias("turns"))


def _spans(sizes: Column) -> Column:
    """Start and end of the own turns' bodies, from each turn's (own, head, body) lengths.

    An array grows by being copied, so positions are added up chunk by chunk of
    CHUNK turns: where each chunk begins first, then inside each from there.
    """
    none = F.array().cast("array<struct<s:int,e:int>>")

    def step(a: Column, s: Column) -> Column:
        begin, end = a["at"] + s["head"], a["at"] + s["head"] + s["body"]
        span = F.struct(begin.alias("s"), end.alias("e"))
        return F.struct(end.alias("at"), F.when(s["own"], F.concat(a["spans"], F.array(span))).otherwise(a["spans"]).alias("spans"))

    chunks = F.transform(F.sequence(F.lit(1), F.size(sizes), F.lit(CHUNK)), lambda k: F.slice(sizes, k, CHUNK))
    lengths = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), lambda a, s: a + s["head"] + s["body"]))
    begun = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
    starts = F.aggregate(lengths, begun, lambda a, n: F.struct((a["at"] + n).alias("at"), F.concat(a["starts"], F.array(a["at"])).alias("starts")))["starts"]
    return F.flatten(F.zip_with(chunks, starts, lambda c, at: F.aggregate(c, F.struct(at.alias("at"), none.alias("spans")), step)["spans"]))


def rotate(turns: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """One row per conversation and speaker (and block, beyond `max_bytes`): conv_id,
    speaker, block, n_turns, text, mask (sorted start:end of the assistant's texts
    and their end marks, in code points, end exclusive) and n_masked, the mask's length.

    A null role is the speaker "unknown", a null text is empty, a null
    conversation is one of its own. Turns are ordered by number, then role and
    text; turns without a number come last. Repeated rows are rendered as often
    as they come. A conversation of system turns alone has no participant and no
    row; an empty table gives none. Marks inside texts and names are broken up,
    so no turn can be forged.
    """
    role = F.coalesce(F.col("role"), F.lit("unknown"))
    text = F.replace(F.coalesce(F.col("text"), F.lit("")), F.lit(OPEN), F.lit("< |"))
    place = F.struct(F.col("turn").isNull().alias("last"), F.col("turn"))
    clean = turns.select("conv_id", place.alias("place"), role.alias("role"), text.alias("text"))
    clean = clean.withColumn("bytes", (F.octet_length("text") + F.octet_length("role") + MARKS).cast("long"))
    long = clean.groupBy("conv_id").agg(F.sum("bytes").alias("n")).filter(F.col("n") > max_bytes).select(F.col("conv_id").alias("c"))
    long = materialize(long, "chat-long")
    same = F.col("conv_id").eqNullSafe(F.col("c"))
    some = long.limit(1).count() > 0
    short = clean.join(long, same, "left_anti") if some else clean
    whole = short.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("place", "role", "text"))).alias("turns")).select("conv_id", F.lit(0).cast("long").alias("block"), "turns")
    blocks = whole.unionByName(_blocks(clean.join(long, same, "left_semi"), max_bytes)) if some else whole
    speakers = clean.filter("role <> 'system'").select(F.col("conv_id").alias("c"), F.col("role").alias("speaker")).distinct()
    each = blocks.join(speakers, same).drop("c")
    speaker = F.col("speaker")
    rendered = each.select(
        "conv_id",
        "speaker",
        "block",
        F.size("turns").cast("long").alias("n_turns"),
        F.transform("turns", lambda t: F.struct((t["role"] == speaker).alias("own"), F.char_length(_head(t["role"], speaker)).alias("head"), (F.char_length(t["text"]) + len(END)).alias("body"))).alias("sizes"),
        F.array_join(F.transform("turns", lambda t: F.concat(_head(t["role"], speaker), t["text"], F.lit(END))), "").alias("text"),
    )
    masked = rendered.withColumn("spans", _spans(F.col("sizes")))
    mask = F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x["s"], x["e"])), ",")
    masked_length = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + (x["e"] - x["s"]).cast("long"))
    return masked.select("conv_id", "speaker", "block", "n_turns", "text", mask.alias("mask"), masked_length.alias("n_masked"))
