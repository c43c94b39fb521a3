"""Rows that are very long, very many of one kind, or both."""

import base64
import random
import time

import pytest
import tiktoken
from pyspark.sql import functions as F

from catlas.llm import chat, ngram_join, queries, sharding, token_rollup


@pytest.fixture(scope="module")
def coder():
    with open(f"{queries.TOKENIZERS}/byte_bpe_50k.tiktoken", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("t", pat_str=token_rollup.PIECES, mergeable_ranks=ranks, special_tokens={})


def test_runs_apart_move_no_boundary(coder, monkeypatch):
    monkeypatch.setattr(token_rollup, "LONG_RUN", 3)
    rng = random.Random(1)
    for _ in range(2000):
        text = "".join(rng.choice("ab1'!. \n\t 　é\x1c\x85") if rng.random() < 0.6 else " " * rng.randrange(1, 6) for _ in range(rng.randrange(0, 40)))
        parts = list(token_rollup.runs_apart(text))
        assert "".join(p for p, _ in parts) == text
        assert sum(len(coder._encode_single_piece(p) if whole else coder.encode_ordinary(p)) for p, whole in parts) == len(coder.encode_ordinary(text))


HOSTILE = {
    1: "x" + " " * 10_000_000 + "y",
    2: "a" * 3_000_000,
    3: "!" * 3_000_000,
    4: "\n" * 400_000,
    5: "x" + "　" * 1_200_000,
    6: "one two three four five six seven " * 20_000,
    7: None,
    8: "",
}


@pytest.fixture(scope="module")
def hostile(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("hostile")
    rows = [(k, t, "en", "web", len(t or "")) for k, t in HOSTILE.items()] + [(k, f"plain text number {k} of some words", "de" if k % 2 else "en", None, 9) for k in range(100, 140)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, k % 2, 0) for k in (*HOSTILE, *range(100, 140))], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([("i", "two three four five six seven one two three four")], "item_id string, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_token_counts_of_long_runs(spark, hostile, coder):
    want = {}
    for r in spark.read.parquet(f"{hostile}/documents.parquet").collect():
        text = r["text"] or ""
        pieces = [text] if r["doc_id"] not in (1, 4, 5) else []
        runs = {1: ["x", " " * 9_999_999, " y"], 4: [text], 5: ["x", text[1:]]}.get(r["doc_id"], [])
        n = sum(len(coder.encode_ordinary(p)) for p in pieces) + sum(len(coder._encode_single_piece(p)) for p in runs)
        for name, k in (("byte_bpe_50k-1", n), ("words-1", len(text.encode().split()))):
            key = (r["source"], r["lang"], name)
            docs, tokens = want.get(key, (0, 0))
            want[key] = (docs + 1, tokens + k)
    got = {(r["source"], r["lang"], r["tokenizer"]): (r["docs"], r["tokens"]) for r in queries.op3_token_counts(spark, hostile).collect()}
    assert got == want


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n not in ("op3_token_counts", "op7_chat_formatting", "op12_click_windows", "op9_near_matches")])
def test_hostile_texts_pass_every_query(spark, hostile, name):
    rows = queries.QUERIES[name](spark, hostile).collect()
    assert len(rows) == (48 if name != "op3_word_counts" else 3)


def test_rendering_is_linear_in_turns(spark):
    def turns(n):
        return spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 3 == 0, "ann").when(F.col("id") % 3 == 1, "bob").otherwise("system").alias("role"), F.lit("hi").alias("text"))

    def took(n):
        began = time.perf_counter()
        rows = chat.rotate(turns(n), max_bytes=1 << 30).collect()
        return time.perf_counter() - began, rows

    took(100)
    short, rows = took(4_000)
    for r in rows:
        spans = [tuple(map(int, s.split(":"))) for s in r["mask"].split(",")]
        assert len(spans) == 1334 - (r["speaker"] == "bob") and all(r["text"][a:b] == "hi<|end|>\n" for a, b in spans)
        assert sum(b - a for a, b in spans) == r["n_masked"]
    long, rows = took(200_000)
    assert long < 2 * 50 * short and {len(r["mask"].split(",")) for r in rows} == {66_667}


def test_many_short_equal_texts_are_no_tasks_own(spark):
    docs = spark.range(40_064).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 64, F.concat(F.col("id"), F.repeat(F.lit("x"), 1_200_000))).otherwise("").alias("text"), F.lit("s").alias("source"), F.lit("en").alias("lang"))
    rows, leaves = sharding.describe(docs, 2)
    assert rows.groupBy("key", "sub").count().agg(F.max("count")).first()[0] < 2 * sharding.ROWS_PER_PREFIX
    assert rows.filter("size = 8").select("key").distinct().count() == 1
    got = sharding.shard(docs, leaves=2).groupBy("shard").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.min("slot").alias("first"), F.max("slot").alias("last"), F.countDistinct("slot").alias("slots"), F.sum(F.when(F.col("size") == 8, 1)).alias("short")).collect()
    assert sorted(r["short"] or 0 for r in got) == [0, 40_000]  # a group of under 1 % of a shard stays whole
    assert all(r["first"] == 0 and r["last"] == r["n"] - 1 == r["slots"] - 1 for r in got)
    assert max(r["bytes"] for r in got) - min(r["bytes"] for r in got) <= 3_000_000


def test_copies_of_a_row_move_once(spark):
    words = " ".join(f"w{k}" for k in range(60))
    docs = spark.range(20_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(words).alias("text")).unionByName(spark.createDataFrame([(5, words + " more")], "doc_id long, text string"))
    found = ngram_join.near_duplicates(docs)
    assert {tuple(r) for r in found.select("id", "group", "n_links", "n_copies", "first").distinct().collect()} == {(None, None, 1, 20_000, True), (5, None, 1, 1, False)}
    assert found.count() == 20_001
