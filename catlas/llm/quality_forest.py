"""Quality rules with an isolation forest on their statistics.

Each whole text gives exact rule statistics. Texts that fail a base rule go;
the others are scored by an isolation forest, whose short path lengths mark
anomalies. The forest grows on labelled rows of good quality; its random splits
fall anywhere in the range that those labelled rows span, good or bad, from which
it grows, so that a statistic which hardly varies among good rows still isolates
what lies far off. (Grown on rows of both labels, within their own range, it
tells few bad rows from good ones: they are too many to be isolated.)

Labelled rows come in two halves by a fixed pseudo-random bit: one grows the
forest, the other, which it has not seen, gives the threshold. All of them count:
the trees' cuts are drawn from the range alone, tasks count every growing row at
every node, and the threshold is an exact rank among all scores of the other
half. Only counts by node and by bin come to the driver, whatever the rows are.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, shuffle_key

TREES, DEPTH = 200, 8
#: Bins of one round that looks for a rank.
BINS = 1024
#: Share of labelled good rows that the threshold may reject.
FALSE_REJECTS = 0.005
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
_CAPITALS = re.compile(r"[A-Z]")

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(ids: np.ndarray) -> int:
    """Words inside three-word windows that the text holds twice or more, the first one's words included."""
    n = len(ids) - 2
    if n < 2:
        return 0
    top = np.int64(ids.max()) + 1
    if top < 2_000_000:
        windows = (ids[:-2] * top + ids[1:-1]) * top + ids[2:]
    else:  # more words than three of which fit a 64-bit number
        pairs = np.unique(ids[:-1] * top + ids[1:], return_inverse=True)[1]
        windows = pairs[:-1] * top + ids[2:]
    order = np.argsort(windows, kind="stable")
    ranked = windows[order]
    same = ranked[1:] == ranked[:-1]
    twice = np.zeros(n, dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(ids), dtype=bool)
    for k in range(3):
        covered[k : k + n] |= twice
    return int(covered.sum())


def statistics(text: str | None) -> tuple[list[int], list[float]]:
    """(the STATS of a whole text, the forest's features); null has no words."""
    text = text or ""
    raw = text.encode("utf-8", "replace").split()  # bytes split at ASCII white space only
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in raw), dtype=np.int64, count=len(raw))
    chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    duplicates = len(lines) - len(set(lines))
    repeats = repeated_words(ids)
    n = max(len(raw), 1)
    capitals = len(_CAPITALS.findall(text))
    marks = text.count("!") + text.count("?")
    features = [
        math.log1p(100 * (symbols + marks) / n),
        math.log1p(100 * capitals / max(chars, 1)),
        (repeats / n + duplicates / max(len(lines), 1)) / 2,
        math.log(max(chars, 1) / n),
    ]
    return [len(raw), chars, symbols, duplicates, repeats], features


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < 50 or 100 * n_repeat_words > 50 * n_words


def _c(n: np.ndarray) -> np.ndarray:
    """Mean path length of an unsuccessful search among n rows."""
    n = np.maximum(n, 1).astype(np.float64)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / n, np.where(n == 2, 1.0, 0.0))


@dataclass
class Forest:
    """Trees as arrays: feature (-1 in a leaf), cut, left child (the right one follows), and a leaf's path length."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    path: np.ndarray
    norm: float
    threshold: float = 1.0

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Anomaly scores from 0 to 1; near 1 for rows that few splits isolate."""
        total = np.zeros(len(rows))
        for feature, cut, left, path in zip(self.feature, self.cut, self.left, self.path, strict=True):
            at = np.zeros(len(rows), dtype=np.int64)
            while True:
                inner = np.flatnonzero(feature[at] >= 0)
                if not len(inner):
                    break
                here = at[inner]
                at[inner] = left[here] + (rows[inner, feature[here]] >= cut[here])
            total += path[at]
        return 2.0 ** (-total / len(self.feature) / self.norm)


def draw(low: np.ndarray, high: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = 1) -> Forest:
    """Whole trees of random cuts, the children of node i at 2i + 1 and 2i + 2; each cuts its node's box, the root's being low to high."""
    random = np.random.default_rng(seed)
    shape = (trees, 2 ** (depth + 1) - 1)
    feature, cut, path = np.full(shape, -1), np.zeros(shape), np.zeros(shape)
    left = np.tile(2 * np.arange(shape[1]) + 1, (trees, 1))
    for t in range(trees):
        todo = [(0, low, high, 0)]
        while todo:
            node, least, most, level = todo.pop()
            wide = np.flatnonzero(most > least)
            if level >= depth or not len(wide):
                continue
            f = random.choice(wide)
            at = random.uniform(least[f], most[f])
            feature[t, node], cut[t, node] = f, at
            upper, lower = most.copy(), least.copy()
            upper[f] = lower[f] = at
            todo += [(2 * node + 1, least, upper, level + 1), (2 * node + 2, lower, most, level + 1)]
    return Forest(feature, cut, left, path, 1.0)


def visits(forest: Forest, rows: np.ndarray) -> np.ndarray:
    """How many of the rows pass each node of each tree."""
    out = np.zeros(forest.feature.shape, dtype=np.int64)
    for t in range(len(out)):
        at, some = np.zeros(len(rows), dtype=np.int64), rows
        while len(at):
            out[t] += np.bincount(at, minlength=out.shape[1])
            inner = forest.feature[t, at] >= 0
            at, some = at[inner], some[inner]
            at = forest.left[t, at] + (some[np.arange(len(at)), forest.feature[t, at]] >= forest.cut[t, at])
    return out


def settle(forest: Forest, counts: np.ndarray) -> Forest:
    """Nodes of fewer than two rows become leaves; a leaf's path is its level and what its rows would still take."""
    forest.feature = np.where(counts < 2, -1, forest.feature)
    level = np.floor(np.log2(np.arange(counts.shape[1]) + 1))
    forest.path = level + _c(counts)
    forest.norm = float(_c(counts[:1, 0])[0]) or 1.0
    return forest


def grow(rows: np.ndarray, low: np.ndarray, high: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = 1) -> Forest:
    """Trees over all rows at hand."""
    forest = draw(low, high, trees, depth, seed)
    return settle(forest, visits(forest, rows))


def calibrate(forest: Forest, good: np.ndarray, bad: np.ndarray, false_rejects: float = FALSE_REJECTS) -> Forest:
    """The lowest threshold that rejects at most `false_rejects` of the good rows;
    higher, midway to the bad rows' scores above it, where that rejects no fewer of them."""
    scores = np.sort(forest.score(good))
    forest.threshold = float(scores[min(len(scores) - 1, int(np.ceil(len(scores) * (1 - false_rejects))) - 1)])
    above = forest.score(bad)[:, None] if len(bad) else np.zeros((0, 1))
    above = above[above > forest.threshold]
    if len(above):
        forest.threshold = (forest.threshold + float(above.min())) / 2
    return forest


def grow_from(rows: DataFrame, low: np.ndarray, high: np.ndarray) -> Forest:
    """As `grow`, over a frame's `features`; each task adds up its rows, the driver gets a count per node."""
    forest = draw(low, high)

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(forest.feature.shape, dtype=np.int64)
        for part in parts:
            if len(part):
                total += visits(forest, np.stack(part["features"].to_numpy()))
        seen = np.flatnonzero(total)
        yield pd.DataFrame({"node": seen, "n": total.ravel()[seen]})

    counts = np.zeros(forest.feature.size, dtype=np.int64)
    for r in rows.select("features").mapInPandas(count, "node long, n long").groupBy("node").agg(F.sum("n").alias("n")).collect():
        counts[r["node"]] = r["n"]
    return settle(forest, counts.reshape(forest.feature.shape))


def ranked(scores: DataFrame, rank: int) -> float:
    """The value at 0-based `rank` in the order of `s`, exactly: counts by bin, then within the bin that holds it, until that is one value."""
    low, high = scores.agg(F.min("s"), F.max("s")).first()
    while low < high:
        inside = scores.filter(F.col("s").between(low, high))
        at = F.least(F.floor((F.col("s") - low) / (high - low) * BINS), F.lit(BINS - 1))
        for r in sorted(inside.groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("s").alias("low"), F.max("s").alias("high")).collect(), key=lambda r: r["bin"]):
            if rank < r["n"]:
                low, high = r["low"], r["high"]
                break
            rank -= r["n"]
    return low


def calibrate_from(forest: Forest, good: DataFrame, bad: DataFrame, n_good: int, false_rejects: float = FALSE_REJECTS) -> Forest:
    """As `calibrate`, over frames with `features`."""

    @F.pandas_udf("double")
    def score(features: pd.Series) -> pd.Series:
        return pd.Series(forest.score(np.stack(features.to_numpy())) if len(features) else [], dtype="float64")

    scores = materialize(good.select(F.lit(1).alias("y"), score("features").alias("s")).unionByName(bad.select(F.lit(0).alias("y"), score("features").alias("s"))), "forest-scores")
    forest.threshold = ranked(scores.filter("y = 1"), min(n_good - 1, math.ceil(n_good * (1 - false_rejects)) - 1))
    above = scores.filter((F.col("y") == 0) & (F.col("s") > forest.threshold)).agg(F.min("s")).first()[0]
    if above is not None:
        forest.threshold = (forest.threshold + above) / 2
    return forest


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Forest | None:
    """A calibrated forest of all labelled rows, or None without good rows that pass the base rules: then they alone decide.

    Of repeated ids the text with the least MD5 counts, of repeated labels the
    least; null ids and labels other than 0 and 1 are not learnt from. Texts are
    described where they lie; only their features are shuffled.
    """
    known = labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__y")).filter("__id is not null and __y in (0, 1)").groupBy("__id").agg(F.min("__y").alias("__y"))
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).filter("__id is not null and __text is not null")
    told = texts.select("__id", F.md5(F.col("__text").cast("binary")).alias("__digest"), _described()("__text").alias("d"))
    one = told.join(known, "__id").groupBy("__id", "__y").agg(F.min_by("d", "__digest").alias("d"))
    half = F.substring(shuffle_key(F.col("__id")), 1, 1).isin(*"02468ace")
    rows = materialize(one.filter("not d.failed").select("__y", half.alias("__grows"), "d.features"), "labelled")
    at = [F.col("features")[i] for i in range(4)]
    seen = {(r["__y"], r["__grows"]): r for r in rows.groupBy("__y", "__grows").agg(F.count(F.lit(1)).alias("n"), F.array(*map(F.min, at)).alias("low"), F.array(*map(F.max, at)).alias("high")).collect()}
    # A label without rows in one half has all its rows in both.
    split = {y: (y, True) in seen and (y, False) in seen for y in (0, 1)}
    part = lambda y, grows: rows.filter((F.col("__y") == y) & ((F.col("__grows") == grows) if split[y] else F.lit(True)))
    held = lambda y, grows: [r for (label, own), r in seen.items() if label == y and (own == grows or not split[y])]
    if not held(1, True):
        return None
    growing = held(1, True) + held(0, True)
    low, high = np.min([r["low"] for r in growing], axis=0), np.max([r["high"] for r in growing], axis=0)
    return calibrate_from(grow_from(part(1, True), low, high), part(1, False), part(0, False), sum(r["n"] for r in held(1, False)))


def _described():
    """A column function: the forest's features of a whole text, and whether it fails the base rules."""

    @F.pandas_udf("features array<double>, failed boolean")
    def described(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            both = [statistics(t) for t in part]
            yield pd.DataFrame({"features": [f for _, f in both], "failed": [base_failed(s[0], s[4]) for s, _ in both]})

    return described


SCHEMA = ", ".join(f"{s} long" for s in STATS) + ", base_failed boolean, anomaly double, kept boolean"


def judge(forest: Forest | None):
    """A column function: the statistics of a whole text, base_failed, anomaly (null without a forest) and kept.

    Null and empty texts have no words and fail the base rules; a text is judged
    by itself alone, so repeated rows and ties have one verdict, and an empty
    table has no rows. Other columns are never read, whatever their names.
    """

    @F.pandas_udf(SCHEMA)
    def verdict(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            both = [statistics(t) for t in part]
            out = pd.DataFrame([s for s, _ in both], columns=STATS, dtype="int64")
            out["base_failed"] = [base_failed(s[0], s[4]) for s, _ in both]
            anomaly = forest.score(np.array([f for _, f in both]).reshape(len(both), -1)) if forest and both else np.full(len(both), np.nan)
            out["anomaly"] = pd.Series(anomaly).astype(object).where(~np.isnan(anomaly), None)
            out["kept"] = ~out["base_failed"] & ~(anomaly > (forest.threshold if forest else 1.0))
            yield out

    return verdict
