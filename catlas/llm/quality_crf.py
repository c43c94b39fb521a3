"""Document quality from a linear-chain conditional random field over lines.

Every line is good (1) or bad (0). A line's features are its own statistics and
those of the lines before and after it; a transition score ties neighbouring
labels. Only documents have labels, so those of training lines are estimated: they
begin as their document's, and an expectation step, in which that label is
evidence for each line, then takes turns with the fit of the field. A document's
score is the length-weighted mean of its lines' forward-backward marginals, put
through a logistic calibration fitted on the training documents.

Training uses at most MAX_TRAINING labelled documents of a label and
MAX_TRAINING_BYTES of their texts, the first by a fixed pseudo-random key; scoring is one pass over every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, shuffle_key

#: The most labelled documents of either label that a model is fitted on.
MAX_TRAINING = 2000
#: Bytes of their texts, half for each label; the first document of a label is taken whatever its size.
MAX_TRAINING_BYTES = 64 << 20
#: Bytes of text whose features are held at one time.
CHUNK_BYTES = 2_000_000

_SETS = (
    frozenset(range(65, 91)),  # capitals
    frozenset(range(97, 123)) | frozenset(range(128, 256)),  # other letters
    frozenset(range(48, 58)),  # digits
    frozenset(b"#*$%&|<>"),  # symbols
    frozenset(b"!?"),
    frozenset(b".,;:"),
)
_TABLES = [np.array([b in s for b in range(256)], dtype=np.uint8) for s in _SETS]
#: Own features of a line: bias, six shares of bytes, share of words equal to the one before, word length, two lengths.
OWN = len(_SETS) + 5


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of own, previous and next line; bytes of each line; lines of each text)."""
    lines = [text.split("\n") for text in texts]
    counts = np.array([len(x) for x in lines], dtype=np.int64)
    raw = [x.encode("utf-8", "replace") for one in lines for x in one]
    size = np.array([len(x) for x in raw], dtype=np.int64)
    every = np.frombuffer(b"\n".join(raw) + b"\n", dtype=np.uint8)
    start = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
    own = np.zeros((len(raw), OWN))
    own[:, 0] = 1
    long = np.maximum(size, 1)
    for k, table in enumerate(_TABLES):
        own[:, k + 1] = np.add.reduceat(table[every], start, dtype=np.int64) / long
    words = [x.split() for x in raw]
    n = np.array([len(x) for x in words], dtype=np.int64)
    k = len(_SETS) + 1
    own[:, k] = np.array([sum(map(eq, x, x[1:])) for x in words]) / np.maximum(n, 1)
    own[:, k + 1] = np.minimum(long / np.maximum(n, 1) / 10, 4)
    own[:, k + 2] = np.log1p(size) / 8
    own[:, k + 3] = (n < 3) * 1.0
    first = np.zeros(len(raw), dtype=bool)
    first[np.concatenate([[0], np.cumsum(counts)[:-1]])] = True
    last = np.roll(first, -1)
    before, after = np.roll(own, 1, axis=0), np.roll(own, -1, axis=0)
    before[first], after[last] = 0, 0
    return np.concatenate([own, before, after], axis=1), size, counts


def chunked_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """line_features of all texts, with the words of CHUNK_BYTES of text in memory at one time."""
    parts, at, held = [], 0, 0
    for i, t in enumerate(texts):
        held += len(t) + 1
        if held >= CHUNK_BYTES or i == len(texts) - 1:
            parts.append(line_features(texts[at : i + 1]))
            at, held = i + 1, 0
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _by_step(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Texts from long to short, each one's first line, and how many have a line at each step."""
    order = np.argsort(-counts, kind="stable")
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])[order]
    ranked = counts[order]
    alive = np.searchsorted(-ranked, -np.arange(ranked[0]), side="left") if len(ranked) else []
    return order, first, [int(a) for a in alive]


def marginals(emit: np.ndarray, trans: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(good) of each line, and P(pair of labels) of each line with the line before it.

    emit: (lines, 2) log scores; all texts step together, from their first lines on.
    """
    _, first, alive = _by_step(counts)
    forward, backward = np.zeros_like(emit), np.zeros_like(emit)
    for t, n in enumerate(alive):
        at = first[:n] + t
        if t == 0:
            forward[at] = emit[at]
        else:
            forward[at] = np.logaddexp(forward[at - 1, :1] + trans[0], forward[at - 1, 1:] + trans[1]) + emit[at]
    for t in range(len(alive) - 2, -1, -1):
        at = first[: alive[t + 1]] + t
        ahead = emit[at + 1] + backward[at + 1]
        backward[at] = np.logaddexp(ahead[:, :1] + trans[:, 0], ahead[:, 1:] + trans[:, 1])
    both = forward + backward
    total = np.logaddexp(both[:, 0], both[:, 1])
    pairs = np.zeros((len(emit), 2, 2))
    inner = np.ones(len(emit), dtype=bool)
    inner[np.concatenate([[0], np.cumsum(counts)[:-1]])] = False
    at = np.flatnonzero(inner)
    pairs[at] = np.exp(forward[at - 1, :, None] + trans + (emit[at] + backward[at])[:, None, :] - total[at, None, None])
    return np.exp(both[:, 1] - total), pairs


def _expected(advantage: np.ndarray, trans: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """marginals, from each line's advantage of the good label."""
    return marginals(np.column_stack([-advantage / 2, advantage / 2]), trans.reshape(2, 2), counts)


@dataclass
class LineField:
    """weights: one per feature, the good label's advantage; trans: 2 x 2; scale, shift: of the calibration."""

    weights: np.ndarray
    trans: np.ndarray
    scale: float = 1.0
    shift: float = 0.0

    def lines(self, features: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """P(good) of each line."""
        return _expected(features @ self.weights, self.trans, counts)[0]

    def raw(self, features: np.ndarray, size: np.ndarray, counts: np.ndarray) -> np.ndarray:
        good = self.lines(features, counts)
        start = np.concatenate([[0], np.cumsum(counts)[:-1]])
        weight = size + 1e-9
        return np.add.reduceat(good * weight, start) / np.add.reduceat(weight, start)

    def score(self, texts: list[str]) -> np.ndarray:
        """Scores of texts; those without a character but white space score 0."""
        logit = self.scale * _logit(self.raw(*line_features(texts))) + self.shift
        blank = np.array([not t.strip() for t in texts])
        return np.where(blank, 0.0, 1 / (1 + np.exp(-logit)))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


#: Rounds of estimating the lines' labels, and gradient steps of each (the first round takes FIRST_STEPS).
ROUNDS, FIRST_STEPS, STEPS = 4, 120, 60
#: Log odds that a document's label gives to each of its lines in an expectation step.
DOCUMENT_ODDS = 2.0
#: Penalties on the squares of feature weights and of transitions. Most documents have lines of one label only; unless
#: transitions are held back they rule out any change of label.
L2, L2_TRANS = 1e-5, 1e-2


def fit(texts: list[str], labels: list[int], stands_for: tuple[float, float] = (1.0, 1.0)) -> LineField:
    """Maximise the conditional likelihood of the lines' estimated labels by Adam, in rounds.

    The first round takes lines by themselves, without transitions, and labels
    them as their documents; each later one fits the whole field to the marginals
    of lines and of pairs under the last field and the documents' labels. Both
    labels weigh alike in training, the calibration restores their shares: there
    each text of label y counts as the `stands_for[y]` it was drawn from. Without
    documents of both labels every text scores the one label's share.
    """
    labels_ = np.asarray(labels)
    if len(set(labels)) < 2:
        share = float(labels_.mean()) if len(labels) else 0.5
        return LineField(np.zeros(3 * OWN), np.zeros((2, 2)), 0.0, float(_logit(np.array([share]))[0]))
    features, size, counts = chunked_features(texts)
    y = np.repeat(labels_, counts)
    # each text weighs alike however many lines it has, and each label alike
    text_weight = np.where(labels_ == 1, 0.5 / (labels_ == 1).sum(), 0.5 / (labels_ == 0).sum())
    weight = np.repeat(text_weight / counts, counts)
    label, pair = y.astype(float), None
    parameters = np.zeros(features.shape[1] + 4)
    penalty = np.append(np.full(features.shape[1], L2), np.full(4, L2_TRANS))
    for turn in range(ROUNDS):
        m, v = np.zeros_like(parameters), np.zeros_like(parameters)
        for step in range(1, (STEPS if turn else FIRST_STEPS) + 1):
            good, pairs = _expected(features @ parameters[:-4], parameters[-4:], counts)
            tied = np.zeros(4) if pair is None else ((pair - pairs) * weight[:, None, None]).sum(0).ravel()
            grad = np.concatenate([features.T @ ((label - good) * weight), tied]) - penalty * parameters
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
            parameters = parameters + 0.2 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        if turn < ROUNDS - 1:
            label, pair = _expected(features @ parameters[:-4] + DOCUMENT_ODDS * (2 * y - 1), parameters[-4:], counts)
    field = LineField(parameters[:-4], parameters[-4:].reshape(2, 2))
    x = _logit(field.raw(features, size, counts))
    scale, shift = 1.0, 0.0
    number = np.where(labels_ == 1, stands_for[1], stands_for[0])
    for _ in range(50):  # Newton steps with a pull towards the uncalibrated score
        p = 1 / (1 + np.exp(-(scale * x + shift)))
        g = np.array([(number * (labels_ - p) * x).sum() - 0.1 * (scale - 1), (number * (labels_ - p)).sum() - 0.1 * shift])
        r = number * p * (1 - p)
        h = np.array([[(r * x * x).sum() + 0.1, (r * x).sum()], [(r * x).sum(), r.sum() + 0.1]])
        d = np.linalg.solve(h, g)
        scale, shift = scale + float(np.clip(d[0], -1, 1)), shift + float(np.clip(d[1], -1, 1))
    return LineField(field.weights, field.trans, max(scale, 0.1), shift)


def train(docs: DataFrame, labels: DataFrame, max_training: int = MAX_TRAINING, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", held_out_fold: bool = True, max_bytes: int = MAX_TRAINING_BYTES) -> LineField:
    """Fit on labelled documents outside the held-out fold (crc32 of the id mod 5 is 0).

    At most `max_training` documents of each label, and half of `max_bytes` of
    their texts, go to one task, the first by the key of their ids; all are
    counted, so that the bounds leave the shares of the labels in the score as
    they are. Rows without a label or an id are not learnt from; of repeated ids
    the least text counts, of repeated labels the least. Empty tables and blank
    texts teach nothing: without documents of both labels every text has one
    score. Other columns of either table are never read, whatever their names.
    """
    known = labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__y")).filter("__id is not null and __y in (0, 1)").groupBy("__id").agg(F.min("__y").alias("__y"))
    if held_out_fold:
        known = known.filter(~held_out(F.col("__id")))
    totals = {r["__y"]: r["n"] for r in known.groupBy("__y").agg(F.count(F.lit(1)).alias("n")).collect()}
    picked = []
    for y in (0, 1):
        some = known.filter(F.col("__y") == y).withColumn("__key", shuffle_key(F.col("__id"))).orderBy("__key", "__id").limit(max_training)
        picked += [(r["__id"], r["__y"]) for r in some.collect()]
    if not picked:
        return fit([], [])
    wanted = docs.sparkSession.createDataFrame(picked, known.schema)
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).join(F.broadcast(wanted), "__id").groupBy("__id", "__y").agg(F.min("__text").alias("__text"))
    texts = materialize(texts, "training-texts")  # at most max_training rows of each label
    place = {i: k for k, (i, _) in enumerate(picked)}
    sizes = sorted(texts.select("__id", "__y", F.octet_length("__text").alias("n")).collect(), key=lambda r: place[r["__id"]])
    taken, cut = {0: [], 1: []}, {y: totals.get(y, 0) > max_training for y in (0, 1)}
    held = {0: 0, 1: 0}
    for r in sizes:
        held[r["__y"]] += r["n"] or 0
        if taken[r["__y"]] and held[r["__y"]] > max_bytes // 2:
            cut[r["__y"]] = True
        else:
            taken[r["__y"]].append(r["__id"])
    # A text of a label that is cut short stands for more of them than itself.
    stands_for = tuple(max(1.0, totals.get(y, 0) / len(taken[y])) if cut[y] and taken[y] else 1.0 for y in (0, 1))
    if any(cut.values()):
        texts = texts.filter(F.col("__id").isin(*taken[0], *taken[1]))

    def fit_in_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [r for batch in batches for r in zip(batch["__id"], batch["__text"], batch["__y"], strict=True) if (r[1] or "").strip()]
        rows.sort(key=lambda r: str(r[0]))
        model = fit([r[1] for r in rows], [int(r[2]) for r in rows], stands_for=stands_for)
        yield pd.DataFrame([{"weights": model.weights.tolist(), "trans": model.trans.ravel().tolist(), "scale": model.scale, "shift": model.shift}])

    # One task holds the bounded sample; only the model comes to the driver.
    model = texts.coalesce(1).mapInPandas(fit_in_task, "weights array<double>, trans array<double>, scale double, shift double").first()
    if model is None:  # labels, but none of a document here
        return fit([], [])
    return LineField(np.array(model["weights"]), np.array(model["trans"]).reshape(2, 2), model["scale"], model["shift"])


def held_out(ident: Column) -> Column:
    return F.crc32(F.coalesce(ident.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def scorer(model: LineField):
    """A column function that scores whole texts, whatever their length; null counts as empty and scores 0. Equal texts score alike."""

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            texts = ["" if t is None else t for t in part]
            out = np.zeros(len(texts))
            at = held = 0
            for i, t in enumerate(texts):
                held += len(t) + 1
                if held >= CHUNK_BYTES or i == len(texts) - 1:
                    out[at : i + 1] = model.score(texts[at : i + 1])
                    at, held = i + 1, 0
            yield pd.Series(out)

    return score
