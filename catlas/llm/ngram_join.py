"""Near-duplicate documents: an n-gram Jaccard self-join by MinHash banding.

1. Equal texts become one class; each class gets one MinHash signature.
2. Classes are shuffled on their bands' hashes. Inside a bucket whole signatures
   are compared, and those that agree in LIKELY of their hashes or more are tied
   in a tree; a large bucket is cut into blocks, and pairs of blocks are tasks.
   Buckets that hold texts of little in common thus tie nothing.
3. Tied classes are chained into candidate clusters. Each cluster is cut into
   blocks of bounded bytes and rows and every pair of blocks is verified in one
   task on full n-gram sets. A task returns one row per class (its number of
   links and a root), never its pairs.
4. Verified links are chained into groups of near duplicates.

Texts at the threshold of 0.8 agree in 58 of 72 hashes on average, with a
deviation of 3.4; LIKELY asks for 40, which less than one pair in a million
misses. A byte of each hash is kept, so unlike hashes agree once in 256 times. Clusters, links and groups stay in Spark; connected components come from
alternating star operations, each written to the shared folder.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

N = 5
THRESHOLD = 0.8
RECALL = 0.9999
#: Bytes and rows of text of one block; a verifying task holds two and a square of their rows.
BLOCK_BYTES, BLOCK_ROWS = 3_000_000, 1000
#: Share of a signature's hashes in which two texts must agree to be verified.
LIKELY = 0.55
#: Rows that a Python task hands on at one time.
OUT_ROWS = 10_000
#: Signatures in one block of a bucket.
BUCKET_ROWS = 4000
#: Bytes of text whose signatures are computed at one time.
CHUNK_BYTES = 2_000_000
#: Parts into which the rows of one key are dealt before a join with a row per key.
SALTS = 4


def bands_for(threshold: float = THRESHOLD, recall: float = RECALL, max_hashes: int = 96) -> tuple[int, int]:
    """(bands, rows): the most rows, so the fewest false candidates, with which a
    pair at the threshold shares a band with probability `recall` or more."""
    best = None
    for rows in range(1, max_hashes + 1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows)) if threshold < 1 else 1
        if bands * rows <= max_hashes:
            best = (bands, rows)
    if best is None:
        raise ValueError("no banding within max_hashes reaches the recall")
    return best


class _Words(dict):
    """64-bit hashes of words, kept for up to a million words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1_000_000:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ngrams(texts: list[str], cache: _Words, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of the n-grams of all texts in turn, their number per text).

    A text of fewer than n words, but not none, has one n-gram of them all.
    """
    words = [t.encode("utf-8", "replace").split() for t in texts]
    counts = np.array([len(w) for w in words], dtype=np.int64)
    flat = np.fromiter((h for w in words for h in map(cache.__getitem__, w)), dtype=np.uint64, count=int(counts.sum()))
    # n - 1 fillers after each text let a window start at every word; surplus windows are dropped.
    odd = _mixed(np.arange(1, n + 1, dtype=np.uint64)) | np.uint64(1)
    padded = np.zeros(len(flat) + n, dtype=np.uint64)
    padded[: len(flat)] = flat
    text_of = np.repeat(np.arange(len(texts)), counts)
    ends = np.cumsum(counts)
    starts = ends - counts
    inside = np.arange(len(flat))
    value = np.zeros(len(flat), dtype=np.uint64)
    room = ends[text_of] - inside if len(flat) else inside
    for k in range(n):
        value += np.where(room > k, padded[k : k + len(flat)], np.uint64(0)) * odd[k]
    keep = (room >= n) | (inside == starts[text_of]) if len(flat) else np.zeros(0, dtype=bool)
    kept = np.bincount(text_of[keep], minlength=len(texts)) if len(flat) else counts
    return _mixed(value[keep]), kept.astype(np.int64)


def signatures(texts: list[str], bands: int, rows: int, cache: _Words) -> tuple[list[list[int] | None], list[bytes | None]]:
    """(band hashes, the signature in 8 bits a hash) of each text; none for a text without words."""
    grams, counts = ngrams(texts, cache)
    some = np.flatnonzero(counts)
    hashed: list[list[int] | None] = [None] * len(texts)
    whole: list[bytes | None] = [None] * len(texts)
    if not len(some):
        return hashed, whole
    starts = np.concatenate([[0], np.cumsum(counts[some])[:-1]])
    seeds = _mixed(np.arange(1, bands * rows + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    result = np.zeros((bands, len(some)), dtype=np.uint64)
    every = np.zeros((len(some), bands * rows), dtype=np.uint8)
    for b in range(bands):
        joined = np.zeros(len(some), dtype=np.uint64)
        for r in range(rows):
            seed = seeds[b * rows + r]
            least = np.minimum.reduceat((grams ^ seed) * (seed | np.uint64(1)), starts)
            every[:, b * rows + r] = _mixed(least) >> np.uint64(56)
            joined = _mixed(joined * np.uint64(0x9E3779B97F4A7C15) + least)
        result[b] = joined
    for i, column, row in zip(some, result.T.view(np.int64).tolist(), every, strict=True):
        hashed[i], whole[i] = column, row.tobytes()
    return hashed, whole


def _signature_frame(bands: int, rows: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = _Words()
        for batch in batches:
            texts, hashed, whole = batch["text"].tolist(), [], []
            at = held = 0
            for i, t in enumerate(texts):
                held += len(t) + 1
                if held >= CHUNK_BYTES or i == len(texts) - 1:
                    some = signatures(texts[at : i + 1], bands, rows, cache)
                    hashed, whole = hashed + some[0], whole + some[1]
                    at, held = i + 1, 0
            yield pd.DataFrame({"id": batch["id"], "h": batch["h"], "n_bytes": batch["n_bytes"], "bands": hashed, "signature": whole})

    return run


def tied(signs: np.ndarray, blocks: np.ndarray, across: bool, likely: float = LIKELY) -> list[tuple[int, int]]:
    """Edges of a forest over signatures whose trees are the components of agreement in `likely` of the hashes.

    across: only agreement between rows of different blocks ties. Each row is
    compared until it is tied, so rows that all agree cost one pass.
    """
    least = int(np.ceil(likely * signs.shape[1]))
    rest, edges = np.arange(len(signs)), []
    while len(rest):
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            new = []
            for f in front:
                if not len(rest):
                    break
                near = np.concatenate([(signs[part] == signs[f]).sum(axis=1) >= least for part in np.array_split(rest, len(rest) // 20_000 + 1)])
                if across:
                    near &= blocks[rest] != blocks[f]
                edges += [(int(f), int(k)) for k in rest[near]]
                new += rest[near].tolist()
                rest = rest[~near]
            front = new
    return edges


def _groups(batches: Iterator[pd.DataFrame], key: list[str], values: list[str]) -> Iterator[tuple[tuple, list[tuple]]]:
    """(key, its rows' values) of neighbouring rows of one key, across batches; keys of a single row are left out."""
    rows, current = [], None
    for batch in batches:
        for row in zip(*[batch[c] for c in (*key, *values)], strict=True):
            if row[: len(key)] != current:
                if len(rows) > 1:
                    yield current, rows
                rows, current = [], row[: len(key)]
            rows.append(row[len(key) :])
    if len(rows) > 1:
        yield current, rows


def _tie_frame():
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, b = [], []
        for (_, i, j), rows in _groups(batches, ["bucket", "i", "j"], ["h", "block", "signature"]):
            signs = np.frombuffer(b"".join(r[2] for r in rows), dtype=np.uint8).reshape(len(rows), -1)
            for x, y in tied(signs, np.array([r[1] for r in rows]), i != j):
                a.append(rows[x][0])
                b.append(rows[y][0])
            if len(a) >= OUT_ROWS:
                yield pd.DataFrame({"a": a, "b": b})
                a, b = [], []
        yield pd.DataFrame({"a": a, "b": b})

    return run


def _pairs_of_blocks(rows: DataFrame) -> DataFrame:
    """Rows (with block of blocks) once for each pair of blocks (i, j) that theirs is in."""
    each = rows.withColumn("x", F.explode(F.expr("sequence(0, blocks - 1)")))
    return each.withColumn("i", F.least("block", "x")).withColumn("j", F.greatest("block", "x"))


def _salted(left: DataFrame, right: DataFrame, key: str, how: str = "inner", merge: bool = False) -> DataFrame:
    """Join on `key`, whose rows in `left` may be very many for one value, with one row per key in `right`.

    The salt deals a value's rows to SALTS tasks, and since both sides are then
    shuffled for the join alone, Spark can split what is still skewed. `merge`
    asks for a sorted join at every size, whatever fits into a broadcast.
    """
    salted = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = salted.hint("merge") if merge else salted
    return left.withColumn("__salt", F.pmod(F.xxhash64(*left.columns), F.lit(SALTS)).cast("int")).join(salted, [key, "__salt"], how).drop("__salt")


def connected(edges: DataFrame) -> DataFrame:
    """Connected components: (node, root) of every node in `edges` (a, b); the root is the least node.

    Alternates large and small stars until the edges stay the same.
    """
    current = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct(), "edges")
    before = None
    while True:
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = _salted(both.filter("b > a"), least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = materialize(large, "large-star")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        current = materialize(small, "small-star")
        state = current.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if before == state:
            break
        before = state
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def verify(texts: list[str], blocks: np.ndarray, across: bool, threshold: float, cache: _Words) -> tuple[np.ndarray, np.ndarray]:
    """Links between texts by full n-gram sets: (number per text, root index per text).

    across: only pairs of texts from different blocks count, otherwise all do.
    """
    grams, counts = ngrams(texts, cache)
    n = len(texts)
    text_of = np.repeat(np.arange(n), counts)
    order = np.lexsort((text_of, grams))
    grams, text_of = grams[order], text_of[order]
    fresh = np.ones(len(grams), dtype=bool)
    fresh[1:] = (grams[1:] != grams[:-1]) | (text_of[1:] != text_of[:-1])
    grams, text_of = grams[fresh], text_of[fresh]
    sizes = np.bincount(text_of, minlength=n).astype(np.float64)
    new = np.ones(len(grams), dtype=bool)
    new[1:] = grams[1:] != grams[:-1]
    column = np.cumsum(new) - 1
    often = np.bincount(column, minlength=1) > 1
    keep = often[column] if len(column) else np.zeros(0, dtype=bool)
    renumber = np.cumsum(often) - 1
    column, text_of = renumber[column[keep]], text_of[keep]
    shared = np.zeros((n, n), dtype=np.float32)
    width = max(16, 4_000_000 // n)
    total = int(column[-1]) + 1 if len(column) else 0
    for at in range(0, total, width):
        lo, hi = np.searchsorted(column, [at, at + width])
        part = np.zeros((n, min(width, total - at)), dtype=np.float32)
        part[text_of[lo:hi], column[lo:hi] - at] = 1
        shared += part @ part.T
    union = sizes[:, None] + sizes[None, :] - shared
    linked = (shared > 0) & (shared >= threshold * union - 1e-6)
    np.fill_diagonal(linked, False)
    if across:
        linked &= blocks[:, None] != blocks[None, :]
    root = np.arange(n)
    while True:
        nearest = np.where(linked, root[None, :], n).min(axis=1)
        new_root = np.minimum(root, nearest)
        new_root = new_root[new_root]
        if (new_root == root).all():
            return linked.sum(axis=1), root
        root = new_root


def _verify_frame(threshold: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache, out = _Words(), []
        for (_, i, j), rows in _groups(batches, ["cluster", "i", "j"], ["h", "block", "text"]):
            links, root = verify([r[2] for r in rows], np.array([r[1] for r in rows]), i != j, threshold, cache)
            out += [(rows[k][0], int(links[k]), rows[root[k]][0]) for k in np.flatnonzero(links)]
            if len(out) >= OUT_ROWS:
                yield pd.DataFrame(out, columns=["h", "links", "root"])
                out = []
        yield pd.DataFrame(out, columns=["h", "links", "root"])

    return run


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: id, h (its text's digest), group (the least id
    among its near duplicates, its own if it has none), n_links (other texts at
    the threshold or above), n_copies (rows with its very text, itself included)
    and first (true for the rows of one id and text of each group).

    Equal texts are one class whatever their number; null counts as empty, and
    blank texts match only equal ones. Null ids sort before others. Rows with
    one id may have different texts. An empty table gives no rows. A text of any
    length is read whole. Only the id and the text are read, whatever else the table has.
    """
    bands, rows = bands_for(threshold, recall)
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.select(F.col(id_col).alias("id"), F.unhex(F.md5(text.cast("binary"))).alias("h"), text.alias("text"))
    id_type = docs.schema[id_col].dataType.simpleString()
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")
    signed = materialize(
        slim.select("id", "h", "text", n_bytes).mapInPandas(_signature_frame(bands, rows), f"id {id_type}, h binary, n_bytes long, bands array<long>, signature binary"),
        "signatures",
    )
    classes = materialize(signed.groupBy("h").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n_copies"), F.first("n_bytes").alias("n_bytes"), F.first("bands").alias("bands"), F.first("signature").alias("signature")), "classes")

    # Band hashes: buckets of two or more classes, in which like signatures are tied.
    banded = classes.select("h", F.posexplode("bands").alias("band", "value")).select("h", F.xxhash64("band", "value").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("bucket", F.ceil(F.col("n") / F.lit(BUCKET_ROWS)).cast("int").alias("blocks"))
    in_buckets = _salted(banded, materialize(shared, "buckets"), "bucket", merge=True).withColumn("block", F.pmod(F.xxhash64("h"), F.col("blocks")).cast("int"))
    # Signatures move to members of such buckets only.
    in_buckets = in_buckets.join(classes.select("h", "signature").hint("merge"), "h")
    compared = _pairs_of_blocks(in_buckets).select("bucket", "i", "j", "h", "block", "signature")
    compared = compared.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "h")
    edges = compared.mapInPandas(_tie_frame(), "a binary, b binary")
    clusters = materialize(connected(edges), "clusters").withColumnRenamed("root", "cluster").withColumnRenamed("node", "h")

    members = materialize(clusters.join(classes.select("h", "rep", "n_bytes"), "h"), "members")
    sizes = members.groupBy("cluster").agg(F.greatest(F.ceil(F.sum("n_bytes") / F.lit(BLOCK_BYTES)), F.ceil(F.count(F.lit(1)) / F.lit(BLOCK_ROWS))).cast("int").alias("blocks"))
    placed = materialize(_salted(members, sizes, "cluster").withColumn("blocks", F.greatest("blocks", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("h"), F.col("blocks")).cast("int")), "placed")
    same_id = F.col("s.id").eqNullSafe(F.col("p.rep"))
    # One plan at every size: texts move once, and nothing depends on a broadcast that a larger corpus outgrows.
    # Rows of one id and text, however many, are one before they move.
    once = slim.groupBy("h", "id").agg(F.first("text").alias("text"))
    texts = once.alias("s").join(placed.hint("merge").alias("p"), (F.col("s.h") == F.col("p.h")) & same_id).select("p.cluster", "p.blocks", "p.block", "p.h", "s.text")
    tasks = _pairs_of_blocks(texts).select(F.hex("cluster").alias("cluster"), "i", "j", "h", "block", "text")
    tasks = tasks.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "h")
    found = materialize(tasks.mapInPandas(_verify_frame(threshold), "h binary, links long, root binary"), "links")

    links = found.groupBy("h").agg(F.sum("links").alias("n_links"))
    groups = connected(found.select(F.col("h").alias("a"), F.col("root").alias("b")))
    grouped = classes.select("h", "rep", "n_copies").join(groups.withColumnRenamed("node", "h"), "h", "left").join(links, "h", "left").withColumn("root", F.coalesce("root", "h"))
    own = F.struct(F.col("rep").alias("id"), "h")
    least = grouped.filter("n_links is not null").groupBy("root").agg(F.min(own).alias("least"))
    found = _salted(grouped, least, "root", "left").withColumn("least", F.coalesce("least", own))
    info = materialize(found.select("h", "least", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "n_copies"), "classes-found")
    first = F.col("id").eqNullSafe(F.col("least.id")) & (F.col("h") == F.col("least.h"))
    return signed.select("id", "h").join(info, "h").select("id", "h", F.col("least.id").alias("group"), "n_links", "n_copies", first.alias("first"))
