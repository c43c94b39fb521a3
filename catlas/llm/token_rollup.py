"""Token counts as delta-maintained rollups.

A batch of changes (insert, revise, delete) becomes signed rows; each batch is
committed once, as one folder whose commit file is written last. Totals by
source, language and tokenizer version are the sums over committed batches, so
they are brought up to date without a document being counted again. Compaction
adds up the batches so far in a folder of its own, so that totals read one sum and
what came after it; batches stay known by name, and stay committed once.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, shared_dir, word_count

KEYS = ("source", "lang", "tokenizer")
_SUMS = "source string, lang string, tokenizer string, docs long, tokens long"

#: How byte-level vocabularies cut a text before they merge bytes.
PIECES = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


#: White space as PIECES has it, and how much of it in a row is counted apart.
SPACE, LONG_RUN = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000", 1000


def runs_apart(text: str) -> Iterator[tuple[str, bool]]:
    """(part, whether it is one piece): a text cut around long runs of white space, without moving a boundary of PIECES.

    Such a run is one piece but for its last character, which goes with what
    follows it; at the end of the text it is one whole. The pattern's look-ahead
    remembers each character of a run, so a run of any length mustn't come near it.
    """
    at = 0
    for run in re.finditer(f"[{SPACE}]{{{LONG_RUN},}}", text):
        end = run.end() if run.end() == len(text) else run.end() - 1
        if run.start() > at:
            yield text[at : run.start()], False
        yield text[run.start() : end], True
        at = end
    if at < len(text):
        yield text[at:], False


def words(text: Column) -> Column:
    return word_count(text)


def byte_bpe(path: str, name: str) -> Callable[[Column], Column]:
    """A column function that counts a byte-level vocabulary's tokens of whole texts.

    The vocabulary file is read once, on the driver, and goes to the executors
    as a value (a fixed file of under 1 MB). Runs of any length, of white space or
    of anything else, are counted as the vocabulary's own pieces.
    """
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}

    @F.pandas_udf("long")
    def count(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import tiktoken

        coder = tiktoken.Encoding(name, pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})

        def tokens(text: str) -> int:
            return sum(len(coder._encode_single_piece(p) if whole else coder.encode_ordinary(p)) for p, whole in runs_apart(text))

        for part in parts:
            yield pd.Series([tokens(t) if t else 0 for t in part], dtype="int64")

    return count


def tokenizers_at(path: str) -> dict[str, Callable[[Column], Column]]:
    return {"words-1": words, "byte_bpe_50k-1": byte_bpe(f"{path}/byte_bpe_50k.tiktoken", "byte_bpe_50k")}


class Rollup:
    """A rollup under `root`, a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _committed(self, folder: str) -> list[str]:
        home = f"{self.root}/{folder}"
        if not self._fs.exists(self._path(home)):
            return []
        names = sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(home)))
        return [n for n in names if self._fs.exists(self._path(f"{home}/{n}/COMMIT"))]

    def _summed(self) -> tuple[str | None, set[str]]:
        """The newest compaction and the batches that it holds."""
        every = self._committed("sums")
        if not every:
            return None, set()
        home = f"{self.root}/sums/{every[-1]}"
        return f"{home}/deltas", {r["batch"] for r in self.spark.read.schema("batch string").parquet(f"{home}/batches").collect()}

    def batches(self) -> list[str]:
        """The committed batches, compacted or not."""
        return sorted(set(self._committed("batches")) | self._summed()[1])

    def _write(self, home: str, rows: DataFrame) -> None:
        sums = rows.groupBy(*KEYS).agg(F.sum("docs").cast("long").alias("docs"), F.sum("tokens").cast("long").alias("tokens"))
        sums.write.parquet(f"{home}/deltas")

    def commit(self, batch: str, counted: DataFrame) -> bool:
        """Add signed rows (source, lang, tokenizer, docs, tokens) as one batch; False if it is committed already."""
        if batch in self.batches():
            return False
        home = f"{self.root}/batches/{batch}"
        self._fs.delete(self._path(home), True)
        self._write(home, counted)
        self._fs.create(self._path(f"{home}/COMMIT")).close()
        return True

    def _rows(self) -> DataFrame:
        summed, known = self._summed()
        paths = [summed] if summed else []
        paths += [f"{self.root}/batches/{b}/deltas" for b in self._committed("batches") if b not in known]
        return self.spark.read.schema(_SUMS).parquet(*paths) if paths else self.spark.createDataFrame([], _SUMS)

    def compact(self) -> None:
        """Add up all committed batches; what it replaces goes only after the sum is committed."""
        known, before = self.batches(), self._committed("sums")
        home = f"{self.root}/sums/{int(before[-1]) + 1 if before else 0:09}"
        self._fs.delete(self._path(home), True)
        self._write(home, self._rows())
        self.spark.createDataFrame([(b,) for b in known], "batch string").write.parquet(f"{home}/batches")
        self._fs.create(self._path(f"{home}/COMMIT")).close()
        for old in [*(f"sums/{s}" for s in before), *(f"batches/{b}" for b in known)]:
            self._fs.delete(self._path(f"{self.root}/{old}"), True)

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, docs, tokens; keys whose documents are all gone are left out."""
        return self._rows().groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).filter("docs <> 0 or tokens <> 0")


def count(docs: DataFrame, tokenizers: dict[str, Callable[[Column], Column]], sign: int = 1, text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One signed row per document and tokenizer, with the columns `keep`.

    Null counts as empty: a document of 0 tokens. Null keys stay null. A text of any
    length is counted whole, in the task that reads it; an empty table gives no
    rows. Of `docs` only `keep`, source, lang and the text are read, whatever else it has.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    sized = docs.select(*keep, F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), *[f(text).alias(f"__n{i}") for i, f in enumerate(tokenizers.values())])
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("tokenizer"), F.col(f"__n{i}").alias("tokens")) for i, name in enumerate(tokenizers)]))
    rows = sized.select(*keep, "source", "lang", each.alias("__t"))
    return rows.select(*keep, "source", "lang", "__t.tokenizer", F.lit(sign).cast("long").alias("docs"), (F.col("__t.tokens") * sign).alias("tokens"))


def negated(counted: DataFrame) -> DataFrame:
    """Signed rows that take `counted` back."""
    return counted.withColumn("docs", -F.col("docs")).withColumn("tokens", -F.col("tokens"))


def changes(tokenizers: dict[str, Callable[[Column], Column]], inserted: DataFrame | None = None, deleted: DataFrame | None = None, revised: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Signed rows of a batch; `revised` holds the old and the new rows of changed documents."""
    parts = [(inserted, 1), (deleted, -1), *([(revised[0], -1), (revised[1], 1)] if revised else [])]
    rows = [count(df, tokenizers, sign) for df, sign in parts if df is not None]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def follow(docs: DataFrame, labels: DataFrame, tokenizers: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """Totals of a fresh rollup that has followed the documents through five batches.

    All documents come; those that labels mark as bad are withdrawn: revised to
    empty texts, then deleted; they come back; the repeat of a batch changes
    nothing. So the totals are those of all documents, after signed changes and a
    compaction. Each text is counted once: later batches join its written counts.
    Repeated rows and labels, null ids and null keys are counted as they stand;
    empty tables have no totals; columns of other names are never read.
    """
    spark = docs.sparkSession
    rollup = Rollup(spark, f"{shared_dir(spark)}/rollup")
    counted = materialize(count(docs, tokenizers, keep=("doc_id",)), "token-counts")
    bad = labels.filter("quality = 0").select("doc_id").distinct()
    withdrawn = counted.join(bad, "doc_id", "left_semi").drop("doc_id")
    emptied = withdrawn.withColumn("tokens", F.lit(0).cast("long"))
    rollup.commit("1-come", counted.drop("doc_id"))
    rollup.commit("2-emptied", negated(withdrawn).unionByName(emptied))
    rollup.commit("3-deleted", negated(emptied))
    rollup.compact()
    rollup.commit("4-back", withdrawn)
    rollup.commit("1-come", counted.drop("doc_id"))
    return rollup.totals()
