"""Benchmark decontamination with a distributed positional inverted index.

The index is split by document: one row holds the posting lists of one block of
training texts (about 4 MB), so building, storing and searching it never shuffles
a posting. It holds every term of the texts, whatever the benchmark, so one
written index answers any number of searches. Test windows start from their
corpus-wide rarest term; each candidate position is then intersected with the
offset-adjusted lists of the other terms, again from the rarest. A slack above 0
gives proximity matches.

Terms are 64-bit hashes of words. Two words of one hash would be taken for each
other: with a vocabulary of a thousand million words and a million test terms
the chance that any two are is about 5 in 100,000.

Test items are taken to the driver in blocks of at most `MAX_ITEM_CHARS`
characters, whatever their number; each block is one search of the same index.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize

#: Words of one test window.
WINDOW = 10
#: Words that a term of a proximity match may stand off its place.
NEAR_SLACK = 1
#: Characters of test items that one search holds on the driver and in each task.
MAX_ITEM_CHARS = 20_000_000
#: Bytes of text in one block of the index.
BLOCK_BYTES = 4_000_000

_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) runs of digits, a-z and everything beyond ASCII, as UTF-8."""
    return (text or "").encode("utf-8", "replace").translate(_FOLD).split()


class _Terms(dict):
    """Signed 64-bit hashes of words, kept for up to a million words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1_000_000:
            self.clear()
        value = xxhash.xxh64_intdigest(word)
        self[word] = value = value - (1 << 64) if value >> 63 else value
        return value


class Queries:
    """The distinct windows of a block of test items; windows hold places in `vocabulary`, the sorted terms."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW) -> None:
        terms = _Terms()
        self.names: list[str] = []
        found: dict[tuple[int, ...], set[int]] = {}
        for name, text in items:
            ids = [terms[w] for w in words_of(text)]
            if not ids:
                continue
            size = min(window, len(ids))
            for i in range(len(ids) - size + 1):
                found.setdefault(tuple(ids[i : i + size]), set()).add(len(self.names))
            self.names.append(name)
        self.vocabulary = np.array(sorted({t for w in found for t in w}), dtype=np.int64)
        self.groups = []
        for size in sorted({len(w) for w in found}):
            some = [(w, sorted(n)) for w, n in found.items() if len(w) == size]
            starts = np.cumsum([0, *(len(n) for _, n in some)])
            words = np.searchsorted(self.vocabulary, np.array([w for w, _ in some], dtype=np.int64)).astype(np.int32)
            self.groups.append((words, starts, np.concatenate([n for _, n in some]).astype(np.int64)))

    def plan(self, frequency: np.ndarray) -> None:
        """Order each window's terms by corpus frequency, and windows by their rarest term."""
        ready = []
        for terms, starts, names in self.groups:
            order = np.argsort(frequency[terms], axis=1, kind="stable")
            anchor = terms[np.arange(len(terms)), order[:, 0]]
            by_anchor = np.argsort(anchor, kind="stable")
            ready.append((terms, order, anchor[by_anchor], by_anchor, starts, names))
        self.ready = ready


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One written row per block: ids, digests and word counts of its texts, and its
    posting lists of all terms (term t's positions are postings[offsets[t]:offsets[t + 1]],
    counted through the block with one free position after each text)."""
    id_type = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("ids", T.ArrayType(id_type)), T.StructField("digests", T.ArrayType(T.BinaryType())), *[T.StructField(n, T.BinaryType()) for n in ("n_words", "terms", "offsets", "postings")]])

    def block(ids: list, digests: list, texts: list[np.ndarray]) -> dict:
        lengths = np.array([len(x) for x in texts], dtype=np.int32)
        flat = np.concatenate(texts)
        at = np.arange(len(flat)) + np.repeat(np.arange(len(texts)), lengths)  # one free position after each text
        terms, which = np.unique(flat, return_inverse=True)
        postings = at[np.argsort(which.astype(np.int32), kind="stable")].astype(np.int32)
        offsets = np.concatenate([[0], np.cumsum(np.bincount(which, minlength=len(terms)))]).astype(np.int32)
        return {"ids": ids, "digests": digests, "n_words": lengths.tobytes(), "terms": terms.astype(np.int64).tobytes(), "offsets": offsets.tobytes(), "postings": postings.tobytes()}

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        get = _Terms().__getitem__
        ids, digests, texts, held = [], [], [], 0
        for batch in batches:
            for ident, digest, text in zip(batch["id"], batch["digest"], batch["text"], strict=True):
                ids.append(None if pd.isna(ident) else ident)
                digests.append(digest)
                found = words_of(text)
                texts.append(np.fromiter(map(get, found), dtype=np.int64, count=len(found)))
                held += len(text or "") + 64
                if held >= BLOCK_BYTES:
                    yield pd.DataFrame([block(ids, digests, texts)])
                    ids, digests, texts, held = [], [], [], 0
        if ids:
            yield pd.DataFrame([block(ids, digests, texts)])

    digest = F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))
    slim = docs.select(F.col(id_col).alias("id"), digest.alias("digest"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return materialize(slim.mapInPandas(build, schema), "decontam-index")


def _places(terms: np.ndarray, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places in the sorted `terms` of those that the vocabulary holds, their places there)."""
    at = np.searchsorted(vocabulary, terms)
    held = np.flatnonzero(at < len(vocabulary))
    held = held[vocabulary[at[held]] == terms[held]]
    return held, at[held]


def frequencies(index: DataFrame, vocabulary: np.ndarray) -> np.ndarray:
    """Postings of each term in the whole corpus; one number per term of the test block comes back."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(len(vocabulary), dtype=np.int64)
        for batch in batches:
            for terms, offsets in zip(batch["terms"], batch["offsets"], strict=True):
                held, at = _places(np.frombuffer(terms, dtype=np.int64), vocabulary)
                total[at] += np.diff(np.frombuffer(offsets, dtype=np.int32))[held]
        some = np.flatnonzero(total)
        yield pd.DataFrame({"term": some, "n": total[some]})

    out = np.zeros(len(vocabulary), dtype=np.int64)
    for row in index.select("terms", "offsets").mapInPandas(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        out[row["term"]] = row["n"]
    return out


def _matches(row, queries: Queries, slack: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text starts, text lengths, matched positions' cover, (text, item) pairs) of one block."""
    lengths = np.frombuffer(row.n_words, dtype=np.int32).astype(np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
    size = int((lengths + 1).sum())
    offsets, postings = (np.frombuffer(x, dtype=np.int32) for x in (row.offsets, row.postings))
    held, terms = _places(np.frombuffer(row.terms, dtype=np.int64), queries.vocabulary)
    first_at, number = offsets[held], np.diff(offsets)[held]
    # Only the lists that this search asks for are laid out.
    wanted = np.repeat(first_at - (np.cumsum(number) - number), number) + np.arange(int(number.sum()))
    line = np.full(size, -1, dtype=np.int32)
    line[postings[wanted]] = np.repeat(terms, number)
    text_of = np.repeat(np.arange(len(lengths)), lengths + 1)
    edges = np.zeros(size + 1, dtype=np.int64)
    pairs = [np.zeros((0, 2), dtype=np.int64)]
    for words, order, anchors, by_anchor, item_starts, item_names in queries.ready:
        span = words.shape[1]
        off = min(slack, span - 1)  # a single word has no place to stand off from
        slot = np.searchsorted(terms, anchors)
        there = slot < len(terms)
        there[there] = terms[slot[there]] == anchors[there]
        some, slot = by_anchor[there], slot[there]
        # Windows in slices, so that candidates stay few at a time however frequent a term is.
        counts = number[slot].astype(np.int64)
        slices = np.split(np.arange(len(some)), np.flatnonzero(np.diff(np.cumsum(counts) // 2_000_000)) + 1) if len(some) else []
        for s in slices:
            w = np.repeat(some[s], counts[s])
            inner = np.arange(len(w)) - np.repeat(np.cumsum(counts[s]) - counts[s], counts[s])
            place = postings[np.repeat(first_at[slot[s]], counts[s]) + inner].astype(np.int64)
            at = place - order[w, 0]
            low = starts[text_of[place]]
            high = low + lengths[text_of[place]]
            if off:  # the rarest term may stand off its place as well
                times = 2 * off + 1
                w, low, high, at = np.tile(w, times), np.tile(low, times), np.tile(high, times), np.concatenate([at + d for d in range(-off, off + 1)])
            else:
                keep = (at >= low) & (at + span <= high)
                w, at, low, high = w[keep], at[keep], low[keep], high[keep]
            for k in range(0 if off else 1, span):
                j = order[w, k]
                want = words[w, j]
                hit = np.zeros(len(w), dtype=bool)
                for d in range(-off, off + 1):  # within the candidate's own text
                    near = at + j + d
                    ok = (near >= low) & (near < high)
                    hit[ok] |= line[near[ok]] == want[ok]
                w, at, low, high = w[hit], at[hit], low[hit], high[hit]
            first, beyond = np.maximum(at, low), np.minimum(at + span, high)
            np.add.at(edges, first, 1)
            np.add.at(edges, beyond, -1)
            n = item_starts[w + 1] - item_starts[w]
            inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            pairs.append(np.unique(np.column_stack([np.repeat(text_of[first], n), item_names[np.repeat(item_starts[w], n) + inner]]), axis=0))
    return starts, lengths, np.cumsum(edges[:-1]) > 0, np.unique(np.concatenate(pairs), axis=0)


def search(index: DataFrame, queries: Queries, slack: int = 0) -> DataFrame:
    """One row per text: id, digest, n_words, hits (disjoint [start, end) word
    ranges inside any match) and items (their names). With slack 0 a match is the
    exact phrase; otherwise each term may stand up to `slack` words off its place,
    also where the window's ends reach over the text's, but less than the window
    has words; hits are then the words at the window's place."""
    id_type = index.schema["ids"].dataType.elementType
    schema = T.StructType([T.StructField("id", id_type), T.StructField("digest", T.BinaryType()), T.StructField("n_words", T.LongType()), T.StructField("hits", T.ArrayType(T.StructType([T.StructField("s", T.LongType()), T.StructField("e", T.LongType())]))), T.StructField("items", T.ArrayType(T.StringType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                starts, lengths, cover, pairs = _matches(row, queries, slack)
                step = np.diff(np.concatenate([[0], cover.astype(np.int8), [0]]))
                first, last = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
                hits: list[list] = [[] for _ in lengths]
                for i, s, e in zip(np.searchsorted(starts, first, side="right") - 1, first, last, strict=True):
                    hits[i].append({"s": int(s - starts[i]), "e": int(e - starts[i])})
                items: list[list] = [[] for _ in lengths]
                for i, k in pairs:
                    items[i].append(queries.names[k])
                yield pd.DataFrame({"id": pd.Series(list(row.ids), dtype=object), "digest": list(row.digests), "n_words": lengths, "hits": hits, "items": items})

    return index.mapInPandas(run, schema)


def item_blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> Iterator[Queries]:
    """All test items, in as many blocks as the driver's bound asks for."""
    slim = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).alias("text"))
    chars = slim.agg(F.sum(F.char_length("text")).alias("n")).first()["n"] or 0
    blocks = chars // MAX_ITEM_CHARS + 1
    for k in range(blocks):
        rows = slim.filter(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == k).collect()
        yield Queries([(r["id"], r["text"]) for r in rows], window)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slack: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, digest, n_words, n_hit, items (sorted as strings).

    Null and empty texts have no words and no hits; items without words match
    nothing; an item shorter than the window is one window, and one of several
    rows is listed once. Repeated rows are each returned. Empty tables give no rows or no hits.
    A text of any length is indexed whole, by one task; columns but the id and the
    text are never read, whatever their names.
    """
    index = build_index(docs, id_col, text_col)
    parts = []
    for queries in item_blocks(benchmark, window=window):
        queries.plan(frequencies(index, queries.vocabulary))
        parts.append(search(index, queries, slack))
    found = parts[0]
    if len(parts) > 1:
        for p in parts[1:]:
            found = found.unionByName(p)
        # Repeated rows share id and digest: each came once from each block of items.
        found = found.groupBy("id", "digest").agg(F.first("n_words").alias("n_words"), F.array_distinct(F.flatten(F.collect_list("hits"))).alias("hits"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"), (F.count(F.lit(1)) / len(parts)).cast("int").alias("n"))
        found = found.withColumn("n", F.explode(F.sequence(F.lit(1), "n"))).drop("n")
    covered = F.expr("aggregate(array_sort(hits), named_struct('n', 0L, 'upto', 0L), (a, h) -> named_struct('n', a.n + greatest(0L, h.e - greatest(h.s, a.upto)), 'upto', greatest(a.upto, h.e)), a -> a.n)")
    return found.select("id", "digest", "n_words", covered.alias("n_hit"), F.array_sort(F.array_distinct("items")).alias("items"))
