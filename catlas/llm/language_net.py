"""Language of a text from a convolutional network over its bytes.

Bytes of a window are embedded, filters of several widths slide over them, the
largest value of each filter over the window goes through a softmax. Windows
have a fixed length; a text is cut into windows one after the other, the last
one ending with the text, and scores with the mean of their probabilities
weighted by the bytes that each adds. The network is fitted in numpy on a
bounded sample of labelled rows, in one task; predicting is one Arrow pass over
every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Bytes of a window.
LENGTH = 256
WIDTHS = (2, 3, 4)  # the widest last
#: Filters of each width, and numbers that a byte is embedded in.
FILTERS, DIMS = 16, 8
#: The most labelled documents of a language that the network learns from, and windows of each, spread over its text.
MAX_TRAINING, WINDOWS_EACH = 1000, 4
EPOCHS, BATCH, RATE = 8, 64, 4e-3
#: Windows whose values are held at one time.
BLOCK = 32
#: Prediction for texts without a letter.
UNDETERMINED = "und"


def cut(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows as rows of bytes, the text of each, the bytes it adds). Texts under LENGTH are filled up with blanks."""
    rows, owner, adds = [], [], []
    for k, raw in enumerate(texts):
        flat = np.frombuffer(raw.ljust(LENGTH), np.uint8)
        whole = len(flat) // LENGTH
        rows.append(flat[: whole * LENGTH].reshape(-1, LENGTH))
        left = len(flat) - whole * LENGTH
        if left:
            rows.append(flat[None, -LENGTH:])
        n = whole + (left > 0)
        owner.append(np.full(n, k))
        adds.append(np.full(n, LENGTH, float))
        if left:
            adds[-1][-1] = left
    return np.concatenate(rows), np.concatenate(owner), np.concatenate(adds)


@dataclass
class ByteNet:
    langs: list[str]
    embed: np.ndarray  # 256 x DIMS
    filters: list[np.ndarray]  # of each width: (width * DIMS) x FILTERS
    bias: np.ndarray
    out: np.ndarray  # features x langs
    out_bias: np.ndarray

    @classmethod
    def new(cls, langs: list[str], seed: int = 11) -> ByteNet:
        rng = np.random.default_rng(seed)
        draw = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
        features = FILTERS * len(WIDTHS)
        filters = [draw(w * DIMS, FILTERS, scale=(2 / (w * DIMS)) ** 0.5) for w in WIDTHS]
        return cls(langs, draw(256, DIMS, scale=0.5), filters, np.zeros(features, np.float32), draw(features, len(langs), scale=0.1), np.zeros(len(langs), np.float32))

    def parts(self) -> list[np.ndarray]:
        return [self.embed, *self.filters, self.bias, self.out, self.out_bias]

    def pooled(self, windows: np.ndarray, where: bool = False) -> tuple[np.ndarray, list[np.ndarray]]:
        """Each filter's largest value in each window, and at which byte if `where`.

        All filters slide over all windows in one product: a column per byte holds
        the numbers of that byte and the next ones. Places at which a filter would
        reach into the next window are left out of its maximum.
        """
        n, length = windows.shape
        x = np.take(np.ascontiguousarray(self.embed.T), windows.ravel(), axis=1)
        columns = np.zeros((WIDTHS[-1] * DIMS, n * length), np.float32)
        for j in range(WIDTHS[-1]):
            columns[j * DIMS : (j + 1) * DIMS, : n * length - j] = x[:, j:]
        every = np.zeros((len(WIDTHS) * FILTERS, WIDTHS[-1] * DIMS), np.float32)
        for k, (w, weights) in enumerate(zip(WIDTHS, self.filters, strict=True)):
            every[k * FILTERS : (k + 1) * FILTERS, : w * DIMS] = weights.T
        values = (every @ columns).reshape(len(every), n, length)
        own = [values[k * FILTERS : (k + 1) * FILTERS, :, : length - w + 1] for k, w in enumerate(WIDTHS)]
        return np.concatenate([v.max(2) for v in own]).T, [v.argmax(2).T for v in own] if where else []

    def probabilities(self, features: np.ndarray) -> np.ndarray:
        z = np.maximum(features + self.bias, 0) @ self.out + self.out_bias
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def gradients(self, windows: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        """Of the mean cross entropy, in the order of `parts`; only the bytes that gave a filter's largest value count."""
        features, at = self.pooled(windows, where=True)
        hidden = np.maximum(features + self.bias, 0)
        dz = self.probabilities(features)
        dz[np.arange(len(y)), y] -= 1
        dz /= len(y)
        dh = (dz @ self.out.T) * (hidden > 0)
        d_embed, d_filters = np.zeros_like(self.embed), []
        rows = np.arange(len(y))[:, None]
        for k, (w, weights) in enumerate(zip(WIDTHS, self.filters, strict=True)):
            g = dh[:, k * FILTERS : (k + 1) * FILTERS]
            seen = windows[rows[..., None], at[k][..., None] + np.arange(w)]  # window x filter x width
            patch = self.embed[seen].reshape(len(y), FILTERS, w * DIMS)
            d_filters.append(np.einsum("nf,nfk->kf", g, patch))
            np.add.at(d_embed, seen, (g[:, :, None] * weights.T[None]).reshape(len(y), FILTERS, w, DIMS))
        return [d_embed, *d_filters, dh.sum(0), hidden.T @ dz, dz.sum(0)]

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Probability of each language for each text."""
        total = np.zeros((len(texts), len(self.langs)))
        if not texts:
            return total
        windows, owner, adds = cut(texts)
        for k in range(0, len(windows), BLOCK):
            p = self.probabilities(self.pooled(windows[k : k + BLOCK])[0])
            np.add.at(total, owner[k : k + BLOCK], p * adds[k : k + BLOCK, None])
        return total / total.sum(1, keepdims=True)


def fit(windows: np.ndarray, y: np.ndarray, langs: list[str], epochs: int = EPOCHS, seed: int = 11) -> ByteNet:
    """Adam over shuffled blocks; languages weigh alike whatever their number of windows."""
    net, rng = ByteNet.new(langs, seed), np.random.default_rng(seed)
    first, second, step = [np.zeros_like(p) for p in net.parts()], [np.zeros_like(p) for p in net.parts()], 0
    by_lang = [np.flatnonzero(y == k) for k in range(len(langs))]
    longest = max(len(rows) for rows in by_lang)
    for epoch in range(epochs):
        order = np.concatenate([np.resize(rng.permutation(rows), longest) for rows in by_lang])
        rng.shuffle(order)
        rate = RATE * (1 - epoch / epochs)
        for k in range(0, len(order), BATCH):
            rows, step = order[k : k + BATCH], step + 1
            for p, g, m, v in zip(net.parts(), net.gradients(windows[rows], y[rows]), first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def lowered(text: Column) -> Column:
    return F.lower(text).cast("binary")


def train(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_training: int = MAX_TRAINING, windows_each: int = WINDOWS_EACH) -> ByteNet | None:
    """Fit on rows for which `learn` holds and lang is not null; None if there is no such row with a letter.

    At most `max_training` documents of a language are taken, the first by a fixed
    pseudo-random key of id and text, and at most `windows_each` windows of a
    document, spread evenly over its whole text. Repeated rows count as often as
    they occur. A language is whatever value of lang occurs; their number is
    bounded, their documents are not. Other columns are never read.
    """
    rows = docs.filter(learn).select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"), F.col(lang_col).alias("__lang")).filter(F.col("__lang").isNotNull() & has_letter(F.col("__text")))
    counts = {r["__lang"]: r["n"] for r in rows.groupBy("__lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return None
    langs = sorted(counts)
    # A share of each language by the key first, so that few rows are ranked; twice the bound and 100 leave enough beyond doubt.
    share = F.lit(None).cast("double")
    for lang in langs:
        share = F.when(F.col("__lang") == lang, F.lit(min(1.0, (2 * max_training + 100) / counts[lang]))).otherwise(share)
    key = F.xxhash64("__id", "__text")
    rows = rows.withColumn("__key", key).filter(F.pmod("__key", F.lit(1 << 30)) < share * (1 << 30))
    raw = lowered(F.col("__text"))
    n = F.octet_length(raw)
    room = F.greatest(n - LENGTH, F.lit(0))
    count = F.least(F.greatest(F.ceil(n / LENGTH), F.lit(1)), F.lit(windows_each)).cast("int")
    starts = F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.floor(k * room / F.greatest(count - 1, F.lit(1))).cast("int"))
    picked = rows.select("__lang", "__key", "__id", F.transform(starts, lambda s: F.substring(raw, s + 1, F.lit(LENGTH))).alias("windows"))
    rank = F.row_number().over(Window.partitionBy("__lang").orderBy("__key", "__id"))
    picked = materialize(picked.withColumn("rank", rank).filter(F.col("rank") <= max_training).select("__lang", "rank", "windows"), "training-windows")

    def fit_in_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = sorted((lang, rank, w) for b in batches for lang, rank, ws in zip(b["__lang"], b["rank"], b["windows"], strict=True) for w in ws)
        windows = cut([bytes(w) for *_, w in got])[0]
        net = fit(windows, np.array([langs.index(lang) for lang, *_ in got]), langs)
        yield pd.DataFrame({"part": [p.astype(float).ravel().tolist() for p in net.parts()], "at": range(len(net.parts()))})

    # One task holds the bounded sample; only the network comes to the driver.
    fitted = {r["at"]: r["part"] for r in picked.coalesce(1).mapInPandas(fit_in_task, "part array<double>, at int").collect()}
    like = ByteNet.new(langs).parts()
    parts = [np.array(fitted[k], np.float32).reshape(like[k].shape) for k in range(len(like))]
    return ByteNet(langs, parts[0], parts[1 : 1 + len(WIDTHS)], *parts[1 + len(WIDTHS) :])


def predictor(net: ByteNet | None):
    """A column function: (lang_pred, score) of a whole text.

    A null text, one without a letter, and every text of a table without anything
    to learn from are UNDETERMINED with score 0. A text of any length is read
    whole, LENGTH bytes at a time; equal texts score alike.
    """

    @F.pandas_udf("lang_pred string, score double")
    def predict(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            kept = [(k, bytes(raw)) for k, raw in enumerate(part) if raw is not None]
            out = pd.DataFrame({"lang_pred": [UNDETERMINED] * len(part), "score": [0.0] * len(part)})
            if kept:
                p = net.score([raw for _, raw in kept])
                at = [k for k, _ in kept]
                out.loc[at, "lang_pred"] = [net.langs[k] for k in p.argmax(1)]
                out.loc[at, "score"] = p.max(1)
            yield out

    def of(text: str) -> Column:
        column = F.col(text)
        if net is None:
            return F.struct(F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"))
        return predict(F.when(has_letter(column), lowered(column)))

    return of


def held_out(ident: Column) -> Column:
    """crc32 of the id as text mod 3 is 1; a null id counts as empty text."""
    return F.crc32(F.coalesce(ident.cast("string"), F.lit("")).cast("binary")) % 3 == 1
