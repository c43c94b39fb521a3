import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from catlas.llm import mixing, sharding
from catlas.llm.common import WORD

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, target long, rank string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, None, "x", 7, "y") for i, t, lang, s in rows], SCHEMA)


def corpus():
    rows = [(i, " ".join(["w"] * (1 + i * 7 % 40)), "en" if i % 3 else "fr", f"s{i % 4}" if i % 2 else "hot") for i in range(400)]
    return [*rows, (None, "a b", None, None), (900, None, "en", "s1"), (901, "", "en", None), (5, rows[5][1], rows[5][2], rows[5][3])]


def test_sources_come_near_their_targets(spark):
    frame = docs(spark, corpus())
    mixture = mixing.mix(frame)
    rows = mixture.copies().collect()
    assert len(rows) == len(corpus())
    sources = {r["__src"]: (r["source_size"], r["target"]) for r in rows}
    total = sum(s for s, _ in sources.values())
    assert sum(t for _, t in sources.values()) == pytest.approx(1.5 * total)
    weights = dict(zip(sorted(sources), [3, 1, 2] * 4, strict=False))
    free = {s for s, (size, target) in sources.items() if target < 2 * size - 1e-9}
    levels = {sources[s][1] / weights[s] for s in free}
    assert max(levels) == pytest.approx(min(levels))
    for s, (size, target) in sources.items():
        assert target <= 2 * size + 1e-9
        taken = sum(r["copies"] * r["__size"] for r in rows if r["__src"] == s)
        assert abs(taken - target) <= 81  # the longest repeated row, twice
    assert all(0 <= r["copies"] <= 2 for r in rows)


def test_mixture_applies_whole_rows_and_reruns_agree(spark):
    frame = docs(spark, corpus())
    mixture = mixing.mix(frame)
    mixed = mixing.apply(mixture, frame)
    assert mixed.columns == frame.columns
    planned = sorted((r["__id"] or -1, r["copies"]) for r in mixture.copies().collect())
    again = sorted((r["__id"] or -1, r["copies"]) for r in mixing.mix(frame.repartition(7)).copies().collect())
    assert planned == again
    assert mixed.count() == sum(c for _, c in planned)


def test_mixture_of_nothing(spark):
    empty = docs(spark, [])
    assert mixing.mix(empty).copies().count() == 0
    assert mixing.apply(mixing.mix(empty), empty).count() == 0
    blank = docs(spark, [(1, "", "en", "a"), (2, None, "en", None)])
    assert [r["target"] for r in mixing.mix(blank).copies().collect()] == [0.0, 0.0]


def brute_mix(rows):
    """source: (target, words taken)."""
    target, taken = _brute(rows)
    return {s: (t, sum(n * len(re.findall(WORD, x or "")) for (_, x, y), n in taken.items() if y == s)) for s, t in target.items()}


def brute_copies(rows):
    """(id, text, source): copies taken of rows with words."""
    return _brute(rows)[1]


def _brute(rows, weights=(3, 1, 2), share=1.5, most=2):
    """By one sorted list of all copies of all rows."""
    order = lambda s: (s is None, s or "")
    size = lambda t: len(re.findall(WORD, t or ""))
    sources = sorted({s for *_, s in rows}, key=order)
    own = {s: sum(size(t) for _, t, _, x in rows if x == s) for s in sources}
    weight = {s: weights[i % len(weights)] for i, s in enumerate(sources)}
    target, free, budget = {}, set(sources), share * sum(own.values())
    while free:
        level = (budget - sum(target.values())) / sum(weight[s] for s in free)
        full = {s for s in free if most * own[s] <= level * weight[s]}
        target |= {s: most * own[s] for s in full}
        free -= full
        if not full:
            target |= {s: level * weight[s] for s in free}
            break
    copies = []
    for s in sources:
        key = lambda r: hashlib.md5(f"{'null' if r[0] is None else r[0]}:{hashlib.md5((r[1] or '').encode()).hexdigest()}".encode()).hexdigest()
        sent = 0
        for r in sorted((r for r in rows if r[3] == s), key=key):
            sent += size(r[1])
            copies += [((sent + c * own[s]) / target[s], order(s), c, sent, size(r[1]), r) for c in range(most) if target[s] and size(r[1])]
    taken, room = Counter(), math.floor(sum(target.values()) + 1e-6)
    for *_, n, r in sorted(copies, key=lambda x: x[:4]):
        room -= n
        if room < 0:
            break
        taken[(r[0], r[1], r[3])] += 1
    return target, taken


def hot_rows():
    """Null ids, one id and one whole row, a third of all rows each."""
    rows = [(None, " ".join(["w"] * (1 + i % 9)) + f" {i % 40}", "en", "abc"[i % 3]) for i in range(300)]
    rows += [(7, f"x y z {i}", "en", "ab"[i % 2]) for i in range(300)]
    return rows + [(8, "one two three four five", "fr", "c")] * 300 + [(9, None, None, None), (9, "", None, None)]


@pytest.mark.parametrize("rows", [corpus(), hot_rows()], ids=["corpus", "hot"])
def test_mixture_equals_sorting_all_copies(spark, rows):
    frame = docs(spark, rows)
    mixture = mixing.mix(frame)
    name = lambda s: s[1:] if s[0] == "0" else None
    got = {}
    for r in mixture.copies().collect():
        target, taken = got.get(name(r["__src"]), (r["target"], 0))
        got[name(r["__src"])] = (target, taken + r["copies"] * r["__size"])
    want = brute_mix(rows)
    assert {s: n for s, (_, n) in got.items()} == {s: n for s, (_, n) in want.items()}
    for s, (target, taken) in got.items():
        assert target == pytest.approx(want[s][0]) and abs(taken - target) <= 40
    mixed = {}
    for r in mixing.apply(mixture, frame).collect():
        mixed[r["source"]] = mixed.get(r["source"], 0) + len(re.findall(WORD, r["text"] or ""))
    assert {s: n for s, n in mixed.items() if n} == {s: n for s, (_, n) in got.items() if n}


def test_cut_that_parts_equal_rows_takes_some_of_them(spark):
    frame = docs(spark, [(1, "a b c", "en", "x")] * 100).withColumn("__src", F.monotonically_increasing_id())
    mixture = mixing.mix(frame, share=1.25)
    mixed = [r["__src"] for r in mixing.apply(mixture, frame).collect()]
    assert len(mixed) == 125 and len(set(mixed)) == 100
    assert sorted(mixed) == sorted(r["__src"] for r in mixing.apply(mixture, frame.repartition(5)).collect())


def brute_leaves(rows, leaves):
    """The tree by sorting each node whole."""
    spans = {d: max(1, max(r[d] for r in rows) - min(r[d] for r in rows)) for d in ("source", "lang", "length")}
    out = {}

    def split(part, lo, k):
        if k == 1 or not part:
            for r in part:
                out.setdefault(lo, []).append(r["id"])
            return
        widths = [(max(r[d] for r in part) - min(r[d] for r in part)) / spans[d] for d in spans]
        d = list(spans)[widths.index(max(widths))]
        part = sorted(part, key=lambda r: (r[d], r["key"]))
        total = sum(r["size"] for r in part)
        goal, upto, left = total // k * (k // 2) + total % k * (k // 2) // k, 0, []
        keys = [(r[d], r["key"]) for r in part]
        for i, r in enumerate(part):
            peers = sum(x["size"] for x, q in zip(part, keys, strict=True) if q == keys[i])
            if i == 0 or keys[i] != keys[i - 1]:
                upto += peers
            if upto > goal:
                break
            left.append(r)
        split(left, lo, k // 2)
        split(part[len(left) :], lo + k // 2, k - k // 2)

    split(rows, 0, leaves)
    return {k: sorted(v, key=str) for k, v in out.items()}


@pytest.mark.parametrize("leaves", [1, 2, 7, 24])
def test_tree_equals_sorting_whole_nodes(spark, leaves):
    rows, _ = sharding.describe(docs(spark, corpus()), leaves)
    placed, _ = sharding.kd_tree(rows, leaves)
    got = {}
    for r in placed.collect():
        got.setdefault(r["lo"], []).append(r["id"])
    assert {k: sorted(v, key=str) for k, v in got.items()} == brute_leaves([r.asDict() for r in rows.collect()], leaves)


def test_shards_are_even_and_slots_gapless(spark):
    rows = sharding.shard(docs(spark, corpus()), leaves=6).collect()
    texts = {i: t for i, t, _, _ in corpus()}
    by = {}
    for r in rows:
        text = (texts[r["id"]] or "").encode()
        assert (r["size"], r["crc"]) == (len(text) + 8, zlib.crc32(text))
        by.setdefault(r["shard"], []).append(r)
    assert sorted(by) == list(range(6))
    sizes = [sum(r["size"] for r in part) for part in by.values()]
    assert max(sizes) - min(sizes) <= 6 * 90
    for part in by.values():
        assert sorted(r["slot"] for r in part) == list(range(len(part)))


@pytest.mark.parametrize("kind", ["null ids", "one id", "one row", "one text"])
def test_hot_ids_are_cut_row_by_row(spark, kind):
    hot = {"null ids": lambda i: (None, f"t {i:04}", "en", "s"), "one id": lambda i: (7, f"t {i:04}", "en", "s"), "one row": lambda i: (7, "t 0000", "en", "s"), "one text": lambda i: (5000 + i, "t 0000", "en", f"s{i % 3}")}[kind]
    rows = [hot(i) for i in range(1200)] + [(i, f"u {i:04}", "en", f"s{i % 5}") for i in range(1200)]
    got = sharding.shard(docs(spark, rows), leaves=8).collect()
    assert sorted(str(r["id"]) for r in got) == sorted(str(r[0]) for r in rows)
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r)
    sizes = [sum(r["size"] for r in part) for part in by.values()]
    assert sorted(by) == list(range(8)) and max(sizes) - min(sizes) <= 3 * 14  # one row for each of three cuts
    assert all(sorted(r["slot"] for r in part) == list(range(len(part))) for part in by.values())


def test_small_groups_of_equal_texts_stay_together(spark):
    rows = [(i, f"text {i % 3000:05} " + "w " * (i % 3000 % 50), ["en", "fr"][i % 2], f"s{i % 7}") for i in range(9000)]
    shards = {}
    for r in sharding.shard(docs(spark, rows), leaves=6).collect():
        shards.setdefault((r["size"], r["crc"]), set()).add(r["shard"])
    assert len(shards) == 3000 and all(len(s) == 1 for s in shards.values())


def test_one_value_everywhere_is_still_cut(spark):
    frame = docs(spark, [(i, "same text", "en", "one") for i in range(300)])
    counts = [r["count"] for r in sharding.shard(frame, leaves=10).groupBy("shard").count().collect()]
    assert sorted(counts) == [30] * 10
    assert sharding.shard(docs(spark, []), leaves=4).count() == 0
    assert sharding.shard(frame, target_bytes=17 * 30).select("shard").distinct().count() == 10


def test_word_pattern():
    assert re.findall(WORD, "a b\tc\x0bd\x1ce  f") == ["a b", "c", "d\x1ce", "f"]
