import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from catlas.llm import quality_crf, quality_forest

DATA = "/root/testdata/sf0.01"


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(3)
    counts = np.array([3, 1, 4])
    emit, trans = rng.normal(size=(8, 2)), rng.normal(size=(2, 2))
    good, pairs = quality_crf.marginals(emit, trans, counts)
    at = 0
    for n in counts:
        weight, want, both = 0.0, np.zeros(n), np.zeros((n, 2, 2))
        for code in range(2**n):
            y = [(code >> i) & 1 for i in range(n)]
            w = math.exp(sum(emit[at + i, y[i]] for i in range(n)) + sum(trans[y[i - 1], y[i]] for i in range(1, n)))
            weight += w
            want += w * np.array(y)
            for i in range(1, n):
                both[i, y[i - 1], y[i]] += w
        assert np.allclose(good[at : at + n], want / weight)
        assert np.allclose(pairs[at + 1 : at + n], both[1:] / weight)
        at += n


def test_features_of_edge_texts():
    features, size, counts = quality_crf.line_features(["", "A b\n\nc!", "x" * 100_000])
    assert list(counts) == [1, 3, 1] and list(size) == [0, 3, 0, 2, 100_000]
    assert features.shape == (5, 3 * quality_crf.OWN) and np.isfinite(features).all()


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    score = quality_crf.scorer(quality_crf.train(docs, labels))
    rows = docs.join(labels, "doc_id").filter(quality_crf.held_out(F.col("doc_id"))).select("doc_id", score("text").alias("s"), "quality").collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in rows)
    assert sum((r["s"] >= 0.3) == (r["quality"] == 1) for r in rows) >= 0.95 * len(rows)


def test_lines_of_glued_documents_are_told_apart(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    model = quality_crf.train(docs, labels)
    rows = docs.join(labels, "doc_id").filter(quality_crf.held_out(F.col("doc_id")) & F.col("text").contains("\n")).orderBy("doc_id").select("text", "quality").collect()
    good, bad = ([r["text"] for r in rows if r["quality"] == y] for y in (1, 0))
    right = lines = both = 0
    for g, b in [pair for k in range(len(bad)) for pair in ((good[k], bad[k]), (bad[k], good[k]))]:
        features, _, counts = quality_crf.line_features([f"{g}\n{b}"])
        p = model.lines(features, counts)
        want = np.repeat([g in good, b in good], [g.count("\n") + 1, b.count("\n") + 1])
        right, lines = right + ((p > 0.5) == want).sum(), lines + len(want)
        both += p.min() < 0.5 < p.max()
    assert len(bad) >= 5 and right >= 0.85 * lines and both >= 0.8 * 2 * len(bad)
    assert model.trans[0, 0] + model.trans[1, 1] > model.trans[0, 1] + model.trans[1, 0]  # neighbours still agree rather than not


def test_scores_of_odd_rows(spark):
    schema = "doc_id long, text string, score string, __y int"
    docs = spark.createDataFrame([(1, "Good words here.", "a", 1), (2, None, "a", 1), (3, "", "a", 1), (None, "### ###", "a", 1), (4, " \n ", "a", 1)], schema)
    labels = spark.createDataFrame([(1, 1), (None, 0)], "doc_id long, quality int")
    score = quality_crf.scorer(quality_crf.train(docs, labels, held_out_fold=False))
    got = {r["doc_id"]: r["s"] for r in docs.select("doc_id", score("text").alias("s")).collect()}
    assert got[2] == got[3] == got[4] == 0.0 and all(0 <= v <= 1 for v in got.values())
    empty = docs.limit(0)
    assert empty.select(quality_crf.scorer(quality_crf.train(empty, labels.limit(0)))("text")).count() == 0


def test_cap_keeps_the_shares_of_labels(spark):
    docs = spark.createDataFrame([(i, "The same words in every text.") for i in range(700)], "doc_id long, text string").coalesce(1)
    labels = spark.createDataFrame([(i, int(i % 7 > 0)) for i in range(700)], "doc_id long, quality int").coalesce(1)
    for cap in (50, 1000):
        model = quality_crf.train(docs, labels, max_training=cap, held_out_fold=False)
        assert abs(model.score(["The same words in every text."])[0] - 6 / 7) < 0.02, cap


def test_bytes_of_training_are_bounded(spark):
    docs = spark.createDataFrame([(i, ("Plain words in a line.\n" if i % 3 else "### $$$ !!!\n") * (1 + i % 5) * (4000 if i == 5 else 1)) for i in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(300)], "doc_id long, quality int")
    model = quality_crf.train(docs, labels, held_out_fold=False, max_bytes=6000)
    good, bad = model.score(["Plain words in a line.\n", "### $$$ !!!\n"])
    assert good > 0.9 and bad < 0.2


def brute_statistics(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    seen, duplicates = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            duplicates += line in seen
            seen.add(line)
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), duplicates, len(covered)]


def test_statistics_equal_brute_force():
    rng = random.Random(5)
    texts = [None, "", " ", "a", "a a a a", "a b a b a b", "x y \x1c z q", "l\nl\n l\n\nl", "é é é é", "\r\n\r\n"]
    texts += ["".join(rng.choice(["a ", "b ", "c\n", "#", "ü\t", "\x0b", "dd "]) for _ in range(rng.randrange(200))) for _ in range(300)]
    for t in texts:
        assert quality_forest.statistics(t)[0] == brute_statistics(t)


def test_windows_of_many_words():
    ids = np.arange(3_000_000)
    ids[-3:] = ids[:3]
    assert quality_forest.repeated_words(ids) == 6


def test_forest_finds_far_rows():
    rng = np.random.default_rng(1)
    good, bad = rng.normal(size=(500, 3)), rng.normal(size=(20, 3)) + 8
    every = np.concatenate([good, bad])
    forest = quality_forest.calibrate(quality_forest.grow(good, every.min(axis=0), every.max(axis=0)), good, bad)
    assert (forest.score(bad) > forest.threshold).all()
    assert (forest.score(good) > forest.threshold).mean() <= quality_forest.FALSE_REJECTS


def test_rules_keep_clean_documents(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    judge = quality_forest.judge(quality_forest.train(docs, labels))
    rows = docs.join(labels, "doc_id").select("text", "quality", judge("text").alias("v")).collect()
    for r in rows:
        assert [r["v"][s] for s in quality_forest.STATS] == brute_statistics(r["text"])
    passed = [r for r in rows if not r["v"]["base_failed"]]
    good = [r["v"]["kept"] for r in passed if r["quality"] == 1]
    bad = [r["v"]["kept"] for r in passed if r["quality"] == 0]
    assert sum(good) >= 0.98 * len(good) and sum(bad) <= 0.2 * len(bad)
    assert not any(r["v"]["kept"] for r in rows if r["v"]["base_failed"])


def test_rules_of_repeated_and_odd_rows(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9)))
    texts = ["\n".join(" ".join(word() for _ in range(9)).capitalize() + "." for _ in range(rng.randrange(7, 15))) for _ in range(200)]
    text = texts.__getitem__
    rows = [(i, text(i)) for i in range(200)] + [(500 + i, "#$%& " * 20 + " ".join(f"|<>| {j}!? A" for j in range(40 + i))) for i in range(20)]
    rows += [(3, text(3)), (None, text(3)), (7, None), (None, "")]
    docs = spark.createDataFrame([(i, t, "clash", 1.0) for i, t in rows], "doc_id long, text string, __y string, anomaly double")
    labels = spark.createDataFrame([(i, int(i < 500)) for i, _ in rows if i is not None] + [(3, 1), (None, 0), (4, 7)], "doc_id long, quality int")
    judge = quality_forest.judge(quality_forest.train(docs, labels))
    got = docs.select("doc_id", "text", judge("text").alias("v")).collect()
    assert len(got) == len(rows)
    verdicts = {}
    for r in got:
        verdicts.setdefault(r["text"], set()).add((r["v"]["kept"], r["v"]["anomaly"]))
    assert all(len(v) == 1 for v in verdicts.values())
    bad = [r["v"]["kept"] for r in got if (r["doc_id"] or 0) >= 500 and not r["v"]["base_failed"]]
    assert not any(bad) and sum(r["v"]["kept"] for r in got) >= 190
    assert not any(r["v"]["kept"] for r in got if not r["text"])


def test_rules_without_labels(spark):
    docs = spark.createDataFrame([(1, " ".join(map(str, range(60)))), (2, None), (3, "")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    judge = quality_forest.judge(quality_forest.train(docs, labels))
    got = {r["doc_id"]: r["v"]["kept"] for r in docs.select("doc_id", judge("text").alias("v")).collect()}
    assert got == {1: True, 2: False, 3: False}
    assert docs.limit(0).select(judge("text")).count() == 0
    assert pytest.approx(quality_forest._c(np.array([2]))[0]) == 1.0


def test_every_labelled_row_counts(spark):
    """The distributed forest and threshold are those of all rows at once, and no count of labelled rows bounds them."""
    rng = np.random.default_rng(4)
    good, bad = rng.normal(size=(5001, 4)), rng.normal(size=(300, 4)) + 5
    frame = lambda x: spark.createDataFrame([(r.tolist(),) for r in x], "features array<double>")
    low, high = np.concatenate([good, bad]).min(axis=0), np.concatenate([good, bad]).max(axis=0)
    want = quality_forest.calibrate(quality_forest.grow(good, low, high), good, bad)
    forest = quality_forest.grow_from(frame(good), low, high)
    assert (forest.path == want.path).all() and (forest.feature == want.feature).all() and forest.norm == want.norm
    assert quality_forest.calibrate_from(forest, frame(good), frame(bad), len(good)).threshold == want.threshold
    assert quality_forest.visits(forest, good)[:, 0].tolist() == [5001] * quality_forest.TREES
