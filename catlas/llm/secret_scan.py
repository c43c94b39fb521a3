"""Secret scanning over an incremental blob ledger.

Every version of every path is addressed by the SHA-256 of its text. The ledger
knows which (blob, rule, rule version) triples have been scanned; a batch scans
only the others, each blob once however many paths hold it, and the report joins
findings back to all paths. A batch is one folder: its commit file is written
last, and a folder without one is not read and is written anew.

Only DataFrame functions are used.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, shared_dir


@dataclass(frozen=True)
class Rule:
    """pattern: of one finding; group: whose length must be `least` or more;
    hint: a text without which the pattern can't match, if there is one."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1
    hint: str | None = None


RULES = (
    Rule("assign", 1, r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 16, "AKIA"),
    Rule("hex", 1, r"[0-9a-f]{32,}"),
    Rule("github", 1, r"gh[pousr]_[A-Za-z0-9]{36,}", hint="gh"),
    # The whole key where its end mark follows (headers of a key hold at most four single dashes), else its opening line.
    Rule("private_key", 2, r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----(?:[^-]*(?:-[^-]+){0,4}-----END [A-Z0-9 ]*PRIVATE KEY-----)?", hint="PRIVATE KEY-----"),
)
BASE = ("assign", "access", "hex")

_FINDINGS = "blob string, kind string, version int, start long, end long"
_SCANNED = "blob string, kind string, version int"


def blob_id(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


class Ledger:
    """A ledger under `root`, a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def batches(self) -> list[str]:
        """The committed batches."""
        if not self._fs.exists(self._path(self.root)):
            return []
        names = sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(self.root)))
        return [n for n in names if self._fs.exists(self._path(f"{self.root}/{n}/COMMIT"))]

    def _read(self, table: str, schema: str) -> DataFrame:
        paths = [f"{self.root}/{b}/{table}" for b in self.batches()]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def scanned(self) -> DataFrame:
        return self._read("scanned", _SCANNED)

    def findings(self) -> DataFrame:
        return self._read("findings", _FINDINGS)

    def due(self, versions: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
        """(blob, text, due): each distinct blob (of blob, text) with the rules it is still to be scanned by.

        Known blobs are told apart by their digests alone. Only texts of blobs
        with a rule due are joined and grouped, and a written list of few such
        blobs goes to the texts, not the texts to it.
        """
        wanted = F.array(*[F.concat_ws("@", F.lit(r.kind), F.lit(r.version)) for r in rules])
        if not self.batches():
            return versions.groupBy("blob").agg(F.first("text").alias("text")).withColumn("due", wanted)
        done = self.scanned().groupBy("blob").agg(F.collect_set(F.concat_ws("@", "kind", "version")).alias("done"))
        rest = F.array_except(wanted, F.coalesce("done", F.array().cast("array<string>")))
        unseen = versions.select("blob").distinct().join(done, "blob", "left").withColumn("due", rest).filter(F.size("due") > 0).select("blob", "due")
        unseen = materialize(unseen, "unseen-blobs")
        return versions.join(unseen, "blob").groupBy("blob").agg(F.first("text").alias("text"), F.first("due").alias("due"))

    def scan(self, versions: DataFrame, batch: str, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> bool:
        """Scan what is due and commit it as `batch`; False if that batch is committed already."""
        if batch in self.batches():
            return False
        home = f"{self.root}/{batch}"
        self._fs.delete(self._path(home), True)
        texts = versions.select(blob_id(F.col(text_col)).alias("blob"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        hits = self.due(texts, rules).select("blob", "due", *[_pieces(r).alias(r.kind) for r in rules])
        hits.write.parquet(f"{home}/hits")
        hits = self.spark.read.schema(hits.schema).parquet(f"{home}/hits")
        reduce(DataFrame.unionByName, [_located(hits, r) for r in rules]).write.parquet(f"{home}/findings")
        pair = F.split(F.col("pair"), "@")
        hits.select("blob", F.explode("due").alias("pair")).select("blob", pair[0].alias("kind"), pair[1].cast("int").alias("version")).write.parquet(f"{home}/scanned")
        self._fs.delete(self._path(f"{home}/hits"), True)
        self._fs.create(self._path(f"{home}/COMMIT")).close()
        return True

    def report(self, versions: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
        """The columns `keep` of every version with blob and found, its sorted (start, rank, kind, end)."""
        order = F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (r.kind, i)])
        current = F.create_map(*[F.lit(x) for r in rules for x in (r.kind, r.version)])
        found = self.findings().filter(current[F.col("kind")] == F.col("version"))
        by_blob = found.groupBy("blob").agg(F.array_sort(F.collect_list(F.struct("start", order[F.col("kind")].alias("rank"), "kind", "end"))).alias("found"))
        by_blob = materialize(by_blob, "findings-by-blob")  # so that a blob of very many paths is a skewed join Spark can split
        paths = versions.select(*keep, blob_id(F.col(text_col)).alias("blob"))
        return paths.join(by_blob, "blob", "left")


def _pieces(rule: Rule) -> Column:
    """Lengths of what lies before each match, of each match and of its group; null without a match or if the rule isn't due."""
    text, pattern = F.col("text"), F.lit(rule.pattern)
    length = lambda x: F.char_length(x)
    pieces = F.arrays_zip(
        F.transform(F.slice(F.split(text, rule.pattern, -1), 1, F.greatest(F.size(F.regexp_extract_all(text, pattern, F.lit(0))), F.lit(1))), length).alias("gap"),
        F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), length).alias("size"),
        F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), length).alias("counted"),
    )
    possible = F.array_contains("due", f"{rule.kind}@{rule.version}")
    if rule.hint:
        possible = possible & text.contains(rule.hint)
    return F.when(possible & text.rlike(rule.pattern), pieces)


def _located(hits: DataFrame, rule: Rule) -> DataFrame:
    """Findings in code points, end exclusive; matches that are too short are dropped."""
    each = hits.filter(F.col(rule.kind).isNotNull()).select("blob", F.posexplode(rule.kind).alias("at", "m"))
    upto = F.sum(F.col("m.gap") + F.col("m.size")).over(Window.partitionBy("blob").orderBy("at"))
    end = each.select("blob", "m", upto.cast("long").alias("end"))
    return end.filter(F.col("m.counted") >= rule.least).select("blob", F.lit(rule.kind).alias("kind"), F.lit(rule.version).alias("version"), (F.col("end") - F.col("m.size")).cast("long").alias("start"), "end")


def scan_all(versions: DataFrame, rules: tuple[Rule, ...] = RULES, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """A fresh ledger's report after two batches of all versions; the second finds every blob known and moves no text.

    Null counts as empty and has no findings; repeated rows are each reported; an empty
    table gives no rows; a very long text is scanned whole, in time linear in
    its length and in a bounded stack.
    """
    ledger = Ledger(versions.sparkSession, f"{shared_dir(versions.sparkSession)}/ledger")
    ledger.scan(versions, "first", rules)
    ledger.scan(versions, "second", rules)
    return ledger.report(versions, rules, keep=keep)


def spans(found: Column, kinds: tuple[str, ...] | None = None) -> Column:
    """kind:start:end of sorted findings, comma-joined; empty for none."""
    some = F.coalesce(found, F.array().cast("array<struct<start:bigint,rank:int,kind:string,end:bigint>>"))
    if kinds:
        some = F.filter(some, lambda x: x["kind"].isin(*kinds))
    return F.array_join(F.transform(some, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def number(found: Column, kind: str) -> Column:
    return F.coalesce(F.size(F.filter(found, lambda x: x["kind"] == kind)), F.lit(0)).cast("long")
