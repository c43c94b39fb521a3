import random
import re
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from catlas.llm import chat, decontam, ngram_join, queries, token_rollup

FIXED = "sf0.001"


def brute_windows(docs, items, size=10):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(fold))
    out = []
    for ident, text in docs:
        have, hit, names = words(text), set(), set()
        for name, item in items:
            want = words(item)
            n = min(size, len(want))
            for i in range(len(want) - n + 1 if n else 0):
                for j in range(len(have) - n + 1):
                    if have[j : j + n] == want[i : i + n]:
                        hit |= set(range(j, j + n))
                        names.add(str(name))
        out.append((ident, len(have), len(hit), sorted(names)))
    return sorted(out, key=str)


def small_corpus():
    rng = random.Random(9)
    word = lambda: rng.choice(["a", "B", "c", "é", "x1", "Zz"])
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate([12, 3, 1, 10, 15])] + [(7, None), (8, "..."), (9, "a B c")]
    docs = [(i, rng.choice([" ", "-", "\n"]).join(word() for _ in range(rng.randrange(40)))) for i in range(60)]
    docs += [(100 + k, f"start {t} end") for k, t in items if t] + [(None, "a b c"), (200, None), (201, ""), (3, docs[3][1])]
    return docs, items


@pytest.mark.parametrize("bound", [decontam.MAX_ITEM_CHARS, 20])
def test_windows_equal_brute_force(spark, monkeypatch, bound):
    monkeypatch.setattr(decontam, "MAX_ITEM_CHARS", bound)
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 700)
    docs, items = small_corpus()
    frame = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, items string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(((r["id"], r["n_words"], r["n_hit"], list(r["items"])) for r in decontam.decontaminate(frame, bench).collect()), key=str)
    assert got == brute_windows(docs, items)


def test_proximity_allows_moved_words(spark):
    item = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(1, item), (2, item.replace("four five", "five four")), (3, item.replace("four", "other"))], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    hits = lambda slack: {r["id"]: r["n_hit"] > 0 for r in decontam.decontaminate(docs, bench, slack=slack).collect()}
    assert hits(0) == {1: True, 2: False, 3: False}
    assert hits(1) == {1: True, 2: True, 3: False}


@pytest.mark.parametrize("bound", [decontam.MAX_ITEM_CHARS, 20])
def test_repeated_items_are_listed_once(spark, monkeypatch, bound):
    monkeypatch.setattr(decontam, "MAX_ITEM_CHARS", bound)
    docs, items = small_corpus()
    items = [*items, items[1], (1, "a B c"), (1, "start"), items[0]]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(((r["id"], r["n_words"], r["n_hit"], list(r["items"])) for r in decontam.decontaminate(frame, bench).collect()), key=str)
    want = [(i, n, h, sorted(set(names))) for i, n, h, names in brute_windows(docs, items)]
    assert got == sorted(want, key=str)


def brute_near(docs, items, slack, size=10):
    words = lambda t: decontam.words_of(t)
    out = []
    for ident, text in docs:
        have, hit, names = words(text), set(), set()
        for name, item in items:
            want = words(item)
            n = min(size, len(want))
            off = min(slack, n - 1)
            for i in range(len(want) - n + 1 if n else 0):
                for at in range(-off, len(have) - n + off + 1):
                    if all(any(0 <= at + j + d < len(have) and have[at + j + d] == want[i + j] for d in range(-off, off + 1)) for j in range(n)):
                        hit |= set(range(max(at, 0), min(at + n, len(have))))
                        names.add(str(name))
        out.append((ident, len(have), len(hit), sorted(names)))
    return sorted(out, key=str)


@pytest.mark.parametrize("slack", [1, 2])
def test_proximity_equals_brute_force(spark, slack):
    docs, items = small_corpus()
    docs = [*docs, (300, "the cat dog"), (301, "p q"), (302, "r s"), (303, "v u t")]
    items = [*items, (20, "the cat the dog"), (21, "q r s"), (22, "t u v")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)  # one block of all texts
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(((r["id"], r["n_words"], r["n_hit"], list(r["items"])) for r in decontam.decontaminate(frame, bench, slack=slack).collect()), key=str)
    assert got == brute_near(docs, items, slack)


def test_near_query_returns_swapped_words(spark, tmp_path):
    item = "one two three four five six seven eight nine ten"
    rows = [(1, item), (2, item.replace("four five", "five four")), (3, item.replace("four", "other"))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    near = {r["doc_id"]: (r["near"], r["n_near"], r["near_items"]) for r in queries.QUERIES["op9_near_matches"](spark, str(tmp_path)).collect()}
    assert near == {1: (True, 10, "1"), 2: (True, 10, "1"), 3: (False, 0, "")}
    exact = {r["doc_id"]: r["contaminated"] for r in queries.QUERIES["op9_decontamination"](spark, str(tmp_path)).collect()}
    assert exact == {1: True, 2: False, 3: False}


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert [(r["n_words"], r["n_hit"]) for r in decontam.decontaminate(docs, bench).collect()] == [(2, 0)]
    assert decontam.decontaminate(docs.limit(0), bench).count() == 0
    assert ngram_join.near_duplicates(docs.limit(0)).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert token_rollup.follow(docs.selectExpr("doc_id", "text", "'s' source", "'l' lang").limit(0), labels, {"words-1": token_rollup.words}).count() == 0


def grams(text):
    words = (text or "").encode().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_groups(docs, threshold=0.8):
    texts = sorted({t or "" for _, t in docs})
    sets = [grams(t) for t in texts]
    root, links = list(range(len(texts))), [0] * len(texts)

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in combinations(range(len(texts)), 2):
        if sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
            links[a] += 1
            links[b] += 1
            root[max(top(a), top(b))] = min(top(a), top(b))
    least = {}
    for i, t in docs:
        k = top(texts.index(t or ""))
        least[k] = min(least.get(k, i), i)
    return sorted((i, least[top(texts.index(t or ""))], links[texts.index(t or "")], sum((x or "") == (t or "") for _, x in docs)) for i, t in docs)


def near_corpus():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    docs = []
    for g in range(12):
        base = [word() for _ in range(rng.choice([3, 6, 60, 300]))]
        for _ in range(rng.choice([1, 2, 9])):
            copy = list(base)
            if len(copy) > 50 and rng.random() < 0.8:
                copy[rng.randrange(len(copy))] = word()
            docs.append((len(docs), " ".join(copy)))
    return [*docs, (500, None), (501, ""), (502, " "), (503, "one"), (504, docs[0][1]), (505, docs[0][1] + "\n")]


@pytest.mark.parametrize("size, rows", [(ngram_join.BLOCK_BYTES, ngram_join.BLOCK_ROWS), (1500, 3)])
def test_groups_equal_brute_force(spark, monkeypatch, size, rows):
    monkeypatch.setattr(ngram_join, "BLOCK_BYTES", size)
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", rows)
    monkeypatch.setattr(ngram_join, "BUCKET_ROWS", rows)
    docs = near_corpus()
    frame = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, h string")
    got = sorted((r["id"], r["group"], r["n_links"], r["n_copies"]) for r in ngram_join.near_duplicates(frame).collect())
    assert got == brute_groups(docs)


def test_repeated_rows_and_null_ids(spark):
    text = " ".join(map(str, range(80)))
    rows = [(1, text), (1, text), (2, text + " x"), (None, text + " y"), (1, "another text altogether")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = ngram_join.near_duplicates(frame).collect()
    assert len(got) == 5 and sum(r["n_links"] == 2 for r in got) == 4
    assert sorted((str(r["id"]), r["group"]) for r in got if r["first"]) == [("1", 1), ("None", None)]


def test_banding_reaches_its_recall():
    bands, rows = ngram_join.bands_for(0.8, 0.9999)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9999 and bands * rows <= 96


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(0)
    words = [str(x) for x in rng.integers(0, 10**6, 400)]
    a, b = " ".join(words), " ".join([*words[:370], *["z"] * 30])
    cache = ngram_join._Words()
    one, whole = ngram_join.signatures([a, b], 400, 1, cache)
    same = np.mean([x == y for x, y in zip(*one, strict=True)])
    assert abs(np.mean(np.frombuffer(whole[0], np.uint8) == np.frombuffer(whole[1], np.uint8)) - same) < 0.02
    true = len(grams(a) & grams(b)) / len(grams(a) | grams(b))
    assert abs(same - true) < 0.08


@pytest.mark.parametrize("blocks", [1, 3])
def test_ties_are_the_components_of_likeness(blocks):
    rng = np.random.default_rng(2)
    signs = rng.integers(0, 3, (90, 24), dtype=np.uint8)
    for k in range(1, 90):
        if k % 4:
            signs[k] = np.where(rng.random(24) < 0.8, signs[k - 1], signs[k])
    block = np.arange(90) % blocks
    like = ((signs[:, None] == signs[None]).sum(axis=2) >= np.ceil(0.55 * 24)) & ((block[:, None] != block[None]) | (blocks == 1))
    root = list(range(90))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in combinations(range(90), 2):
        if like[a, b]:
            root[max(top(a), top(b))] = min(top(a), top(b))
    edges = ngram_join.tied(signs, block, blocks > 1)
    mine = list(range(90))
    for a, b in edges:
        assert like[a, b]
        x, y = (next(r for r in [mine[k]]) for k in (a, b))
        mine = [min(x, y) if m in (x, y) else m for m in mine]
    assert len(edges) <= 89 and mine == [top(k) for k in range(90)]


def test_buckets_of_unlike_texts_chain_nothing(spark):
    words = [f"w{i}" for i in range(400)]
    docs = [(k, " ".join(words[k * 12 : k * 12 + 60])) for k in range(28)]  # each shares most words with the next, none 0.8 of its 5-grams
    got = ngram_join.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert all(r["n_links"] == 0 and r["group"] == r["id"] for r in got)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, k) for k in range(101, 140)] + [(200, 200)]
    got = {r["node"]: r["root"] for r in ngram_join.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{k: 100 for k in range(100, 140)}}


def test_rollup_follows_changes(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, tokens long"
    frame = lambda rows: spark.createDataFrame([(*r, 1) for r in rows], schema)
    tokenizers = token_rollup.tokenizers_at(queries.TOKENIZERS)
    rollup = token_rollup.Rollup(spark, str(tmp_path / "rollup"))
    one = frame([(1, "a b c", "en", "s"), (2, "d", "en", "s"), (3, None, None, None)])
    assert rollup.commit("1", token_rollup.changes(tokenizers, inserted=one))
    assert not rollup.commit("1", token_rollup.changes(tokenizers, inserted=one))
    two = token_rollup.changes(tokenizers, deleted=frame([(2, "d", "en", "s")]), revised=(frame([(1, "a b c", "en", "s")]), frame([(1, "a b c d e", "fr", "s")])))
    assert rollup.commit("2", two)
    totals = {(r["source"], r["lang"]): (r["docs"], r["tokens"]) for r in rollup.totals().collect() if r["tokenizer"] == "words-1"}
    assert totals == {("s", "fr"): (1, 5), (None, None): (1, 0)}
    rollup.compact()
    assert rollup.batches() == ["1", "2"] and not rollup.commit("2", two)
    (tmp_path / "rollup" / "batches" / "3" / "deltas").mkdir(parents=True)  # a batch that never committed
    (tmp_path / "rollup" / "sums" / "000000001" / "deltas").mkdir(parents=True)  # nor this sum
    assert rollup.commit("3", token_rollup.changes(tokenizers, inserted=frame([(9, "x y", "fr", "s")])))
    rollup.compact()
    rollup.compact()
    totals = {(r["source"], r["lang"]): (r["docs"], r["tokens"]) for r in rollup.totals().collect() if r["tokenizer"] == "words-1"}
    assert totals == {("s", "fr"): (2, 7), (None, None): (1, 0)} and rollup.batches() == ["1", "2", "3"]


def test_rollup_equals_counting_each_text(spark):
    import base64

    import tiktoken

    with open(f"{queries.TOKENIZERS}/byte_bpe_50k.tiktoken", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    coder = tiktoken.Encoding("t", pat_str=token_rollup.PIECES, mergeable_ranks=ranks, special_tokens={})
    want = {}
    for r in spark.read.parquet(f"/root/testdata/{FIXED}/documents.parquet").collect():
        for name, n in (("words-1", len((r["text"] or "").encode().split())), ("byte_bpe_50k-1", len(coder.encode_ordinary(r["text"] or "")))):
            docs, tokens = want.get((r["source"], r["lang"], name), (0, 0))
            want[(r["source"], r["lang"], name)] = (docs + 1, tokens + n)
    got = {(r["source"], r["lang"], r["tokenizer"]): (r["docs"], r["tokens"]) for r in queries.op3_token_counts(spark, f"/root/testdata/{FIXED}").collect()}
    assert got == want


def brute_rotation(rows, max_bytes):
    """(conv, speaker, block): (text, spans), turn by turn."""
    shown = lambda r: r.replace("|>", "| >").replace("<|", "< |").replace("\n", " ")
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted(((t is None, t or 0, "unknown" if role is None else role, (text or "").replace("<|", "< |")) for c, t, role, text in rows if c == conv))
        blocks, at = {}, 0
        for turn in turns:
            blocks.setdefault(at // max_bytes, []).append(turn)
            at += len(turn[3].encode()) + len(turn[2].encode()) + chat.MARKS
        if at <= max_bytes:
            blocks = {0: turns}
        opening = [t for t in blocks[0] if t[2] == "system"]
        for speaker in {t[2] for t in turns} - {"system"}:
            for k, part in blocks.items():
                text, spans = "", []
                for _, _, role, said in (opening if k else []) + part:
                    text += "<|" + ("system" if role == "system" else "assistant" if role == speaker else f"user name={shown(role)}") + "|>\n"
                    if role == speaker:
                        spans.append((len(text), len(text) + len(said) + len(chat.END)))
                    text += said + chat.END
                out[(conv, speaker, k)] = (text, spans)
    return out


@pytest.mark.parametrize("max_bytes", [chat.MAX_BYTES, 150])
def test_rotation_equals_brute_force(spark, max_bytes):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "ann", "Hi <|end|> é"), (1, 2, "bob", None), (1, 70, "ann", "later"), (1, None, None, "lost"), (2, 0, "system", "alone")]
    rows += [(3, k, ["ann", "bob", "c|>\n<|assistant"][k % 3], f"turn {k} é" * (k % 4)) for k in range(60)] + [(3, 0, "system", "rules")]
    rows += [(None, 1, "x", "same")] * 20 + [(None, None, "y", "end")]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, block string")
    got = {(r["conv_id"], r["speaker"], r["block"]): (r["text"], [tuple(map(int, x.split(":"))) for x in r["mask"].split(",") if x]) for r in chat.rotate(frame, max_bytes).collect()}
    assert got == brute_rotation(rows, max_bytes)
    assert (len({k for _, _, k in got}) == 1) == (max_bytes == chat.MAX_BYTES)
    assert chat.rotate(frame.limit(0)).count() == 0


def test_names_forge_no_turn(spark):
    frame = spark.createDataFrame([(1, 1, "a|>\nx<|end|>\n<|assistant", "hi"), (1, 2, "bob", "yes")], "conv_id long, turn long, role string, text string")
    text = {r["speaker"]: r["text"] for r in chat.rotate(frame).collect()}["bob"]
    assert re.findall(r"<\|.*?\|>", text) == ["<|user name=a| > x< |end| > < |assistant|>", "<|end|>", "<|assistant|>", "<|end|>"]


def test_pipeline_stages_keep_one_and_clean(spark):
    import corpus_pipeline as P

    text, leak = " ".join(map(str, range(80))), " ".join(f"leak{i}" for i in range(12))
    rows = [(1, text, "en", "a", 3, "x"), (1, text, "en", "a", 3, "x"), (2, text + " more", "en", "a", 3, "x"), (3, "words " + leak, "fr", None, 3, "x"), (3, "clean words of one id", "fr", None, 3, "x"), (4, None, None, None, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size string")
    bench = spark.createDataFrame([(1, leak)], "item_id long, text string")
    one = P.keep_one_of_each(spark, docs, "").collect()
    assert sorted((r["doc_id"], r["text"] or "") for r in one) == [(1, text), (3, "clean words of one id"), (3, "words " + leak), (4, "")]
    kept = P.without_leaks(docs, bench)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 1, 2, 3, 4]
    mixed = P.mix_sources(spark, docs, "")
    assert mixed.columns == docs.columns
    assert P.put_in_shards(spark, mixed, "").count() == mixed.count()
    assert P.keep_one_of_each(spark, docs.limit(0), "").count() == 0


def test_pipeline_stages_take_any_columns_and_none(spark):
    import corpus_pipeline as P

    names = ["__id", "__h", "a.b", "row", "id", "h", "score", "__score", "__row", "__src", "cut", "__n", "shard", "key", "size", "lo", "k", "n", "crc"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names)
    text = lambda k: " ".join(f"{k}w{i}" for i in range(70))
    rows = [(k, text(k), "en", "ab"[k % 2], 1, *("z" * len(names))) for k in range(8)] + [(1, text(1) + " x", None, None, None, *("z" * len(names)))]
    rows += [(None, None, None, None, None, *[None] * len(names)), (9, text(5), "en", "a", 1, *("y" * len(names))), (5, text(5), "en", "a", 1, *("a" * len(names)))]
    docs = spark.createDataFrame(rows, schema)
    bench = spark.createDataFrame([(1, text(3)[30:200])], "item_id long, text string")
    one = P.keep_one_of_each(spark, docs, "")
    assert one.columns == docs.columns and one.count() == 9
    assert [r["a.b"] for r in one.filter("doc_id = 5").collect()] in (["z"], ["a"])
    kept = P.without_leaks(docs, bench)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 1
    mixed = P.mix_sources(spark, docs, "")
    assert mixed.columns == docs.columns and {r["a.b"] for r in mixed.collect()} >= {"z"}
    assert P.put_in_shards(spark, mixed, "").count() == mixed.count()
    for stage in (P.keep_one_of_each, P.mix_sources, P.put_in_shards):
        assert stage(spark, docs.limit(0), "").count() == 0
    assert P.without_leaks(docs.limit(0), bench).count() == 0


def test_pipeline_equals_brute_force(spark, tmp_path):
    """All five stages against plain loops; only the field's scores come from the model itself."""
    import os
    import zlib
    from collections import Counter

    import corpus_pipeline as P
    from catlas.llm import quality_crf
    from tests.llm.test_mix_shard import brute_copies

    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 8)))
    good = [" ".join(word() for _ in range(rng.randrange(20, 90))).capitalize() + "." for _ in range(90)]
    rows = [(i, t, "en", "abc"[i % 3]) for i, t in enumerate(good)]
    rows += [(100 + i, good[i] if i % 2 else good[i].replace(" ", " x ", 1), "fr", "abc"[i % 2]) for i in range(30)]
    rows += [(200 + i, "### $$$ !!! " * rng.randrange(5, 30), "en", "a") for i in range(20)] + [(300, None, None, None), (301, "", "en", "b"), (7, good[7], "en", "b")]
    leak = " ".join(good[40].split()[3:18])
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.lit(1).cast("long"))
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 200), 0) for i, *_ in rows if i < 300], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = P.run(spark, str(tmp_path)).collect()

    model = quality_crf.train(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet"), held_out_fold=False)
    kept = [r for r, s in zip(rows, model.score([t or "" for _, t, *_ in rows]), strict=True) if s >= P.LEAST_QUALITY]
    assert {i for i, *_ in kept} == {i for i, t, *_ in rows if t and "#" not in t}
    group = {(i, t): g for (i, t), (_, g, _, _) in zip(sorted((i, t) for i, t, *_ in kept), sorted_groups(kept), strict=True)}
    one = {}
    for r in kept:
        if group[(r[0], r[1])] == r[0]:
            one.setdefault((r[0], r[1]), []).append(r)
    assert len(one) < len(kept) and sum(len(x) for x in one.values()) == len(one) + 1  # document 7 came twice
    hit = {i for i, _, n, _ in brute_windows([k for k in one], [(1, leak)]) if n}
    assert hit == {40}
    for choice in one[(7, good[7])]:  # either of its rows may stay
        left = [choice if k == (7, good[7]) else x[0] for k, x in one.items() if k[0] not in hit]
        want = Counter()
        for (i, t, _), n in brute_copies(left).items():
            want[(i, len(t.encode()) + 8, zlib.crc32(t.encode()))] += n
        if Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want:
            break
    else:
        raise AssertionError("no choice of the repeated row gives the pipeline's rows")
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r)
    sizes = [sum(r["size"] for r in part) for part in by.values()]
    assert sorted(by) == list(range(P.SHARDS)) and max(sizes) - min(sizes) <= 5 * max(r["size"] for r in got)
    assert all(sorted(r["slot"] for r in part) == list(range(len(part))) for part in by.values())
    assert len(os.listdir(tmp_path)) == 3


def sorted_groups(rows):
    """brute_groups in the order of (id, text)."""
    texts = sorted((i, t) for i, t, *_ in rows)
    found = {}
    for i, g, n, c in brute_groups(texts):
        found.setdefault(i, []).append((i, g, n, c))
    return [found[i].pop() for i, _ in texts]


def test_pipeline_runs_on_test_tables(spark):
    import corpus_pipeline as P

    data = "/root/testdata/sf0.001"
    quality = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    docs = spark.read.parquet(f"{data}/documents.parquet")
    good = {r["doc_id"] for r in P.keep_good(spark, docs, data).select("doc_id").collect()}
    assert sum(quality[i] for i in quality if i in good) >= 0.98 * sum(quality.values())
    rows = P.run(spark, data).collect()
    assert rows and {r["shard"] for r in rows} <= set(range(P.SHARDS)) and {r["doc_id"] for r in rows} <= good


def test_links_just_over_the_threshold_are_found(spark):
    rng = random.Random(21)
    word = lambda: f"w{rng.randrange(10**6)}"
    rows, want = [], {}
    for i in range(1600):
        text, k = [word() for _ in range(100)], 8 + i % 4  # of 96 runs of five words, 96 - k are shared by both texts
        rows += [(2 * i, " ".join(text)), (2 * i + 1, " ".join(text[:-k] + [word() for _ in range(k)]))]
        want[2 * i] = want[2 * i + 1] = int((96 - k) / (96 + k) >= 0.8)
    got = {r["id"]: r["n_links"] for r in ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(want.values()) == 2 * 1200 and not any(got[i] for i in want if not want[i])
    found = sum(got[i] for i in want if want[i])  # each link is seen from both of its texts
    assert found >= 0.999 * 2 * 1200
