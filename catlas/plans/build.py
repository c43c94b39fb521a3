"""Building an index: read what changed, describe what changed, merge it into the tree."""

from __future__ import annotations

import json
import logging
import os
import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from datetime import datetime, timezone
from pathlib import Path
from threading import Condition
from typing import Protocol
from urllib.parse import quote

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catlas.functions import redaction
from catlas.functions.fingerprints import SAMPLE_ROWS, fingerprint
from catlas.operators import catalogs, describing, fetching, health, planning, sampling, structure
from catlas.operators.numbering import numbered
from catlas.schemas import MODULES, STATE
from catlas.sources import tree
from catlas.sources.guarded import OPEN_CONNECTIONS

log = logging.getLogger("catlas")

GUIDE = """# Reading this index

databases.tsv lists every database indexed here, how many objects of each kind it has, and when it was built.
Under connection/database there is one catalog per kind (tables.tsv, views.tsv, procedures.tsv, functions.tsv,
synonyms.tsv): name, facts, modify signal, fingerprint and one sentence. columns/ has a file per table or view,
bodies/ one per view, procedure or function. Secrets are redacted; personal data is never sampled.

Who mentions an object: search bodies/ for its full name. Who writes to it: look for insert, update, delete or
merge shortly before the name, in the same statement.
"""


class Source(Protocol):
    def manifest(self) -> DataFrame: ...
    def columns(self) -> DataFrame: ...
    def indexes(self) -> DataFrame: ...
    def foreign_keys(self) -> DataFrame: ...
    def parameters(self) -> DataFrame: ...
    def targets(self) -> DataFrame: ...
    def modules(self, keys: DataFrame) -> DataFrame: ...
    def health(self) -> DataFrame: ...
    def sample(self, key: str, columns: list[str], n: int) -> list[list[str]]: ...


@dataclass
class Options:
    connection: str = "local"
    database: str = "main"
    engine: str = "spark"
    out: str = "index"
    match: str = ""
    limit: int = 0
    samples: int = -1
    force: bool = False
    dry_run: bool = False
    workers: int = 4
    store: str = ""
    answers: str = ""
    now: datetime | None = None


@dataclass
class Summary:
    objects: int = 0
    refetch: int = 0
    untouched: int = 0
    read: int = 0
    reused: int = 0
    reasons: dict[str, int] = field(default_factory=dict)
    dropped: list[str] = field(default_factory=list)
    described: int = 0
    unchanged: int = 0
    sampled: int = 0
    missing: list[str] = field(default_factory=list)
    failed: list[str] = field(default_factory=list)
    redactions: dict[str, int] = field(default_factory=dict)
    catalogs: dict[str, int] = field(default_factory=dict)
    column_files: int = 0
    body_files: int = 0
    usage: dict[str, float] = field(default_factory=dict)


#: Seconds between the beginnings of two samples, so that they begin in order.
PACE = 0.02
#: Lines of a catalog that one task joins.
LINES = 10_000


class Incomplete(RuntimeError):
    """Some object has no sentence, or a batch failed."""


def read_lines(spark: SparkSession, path: Path) -> DataFrame:
    """A file's lines; none if it is missing. The driver wrote it, so the driver reads it."""
    lines = path.read_text(encoding="utf-8").split("\n") if path.exists() else []
    return spark.createDataFrame([(x,) for x in lines], "value string")


def read_tree(spark: SparkSession, home: Path) -> tuple[DataFrame, DataFrame]:
    """(old rows: key, kind, cells; state) of a database's catalogs."""
    rows = spark.createDataFrame([], "key string, kind string, cells array<string>")
    state = spark.createDataFrame([], STATE)
    for kind, name in catalogs.FILES.items():
        if (home / name).exists():
            each = catalogs.parse_rows(read_lines(spark, home / name), kind)
            rows = rows.unionByName(each.withColumn("kind", F.lit(kind)))
            state = state.unionByName(catalogs.parse_state(each, kind))
    return rows, state


def writable(out: str) -> None:
    """Raise unless a file can be made in `out`."""
    Path(out).mkdir(parents=True, exist_ok=True)
    probe = Path(out) / f".probe-{os.getpid()}"
    probe.write_text("")
    probe.unlink()


def write_whole(path: Path, text: str) -> None:
    path.parent.mkdir(parents=True, exist_ok=True)
    part = path.with_name(path.name + ".part")
    part.write_text(text, encoding="utf-8")
    part.replace(path)


def store_path(spark: SparkSession, options: Options) -> str:
    """Where a database's structures are kept: a folder that driver and executors share.

    options.store if it is given; else a hidden folder of the tree in a local
    session, and one under spark.checkpoint.dir on a cluster.
    """
    base = options.store
    if not base and spark.sparkContext.master.startswith("local"):
        base = os.path.join(os.path.abspath(options.out), ".structures")
    elif not base:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            raise ValueError("name a store, or set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"{base.rstrip('/')}/structures"
    names = (quote(n, safe="").replace(".", "%2E") if set(n) == {"."} else quote(n, safe="") for n in (options.connection, options.database))
    return "/".join([base, *names])


file_name = tree.segment


def home_of(options: Options) -> Path:
    """A database's folder, below options.out whatever its name and its connection's are."""
    return Path(options.out) / tree.segment(options.connection) / tree.segment(options.database)


def pull(source: Source, missing: DataFrame) -> DataFrame:
    """Objects read from the database: their structure, its definition redacted, and counts of what went.

    Catalog rows of other objects go before anything is folded.
    """
    keys = missing.select("key")
    near = lambda rows: rows.join(keys, "key", "left_semi")
    definitions = source.modules(missing.filter(F.col("kind").isin(*MODULES)))
    folded = structure.structures(missing, near(source.columns()), near(source.indexes()), near(source.foreign_keys()), near(source.parameters()), definitions, near(source.targets()))
    clean = folded.withColumn("redacted", redaction.redact(F.col("structure.definition")))
    return clean.withColumn("structure", F.col("structure").withField("definition", F.col("redacted.text"))).withColumn("counts", F.col("redacted.counts")).drop("redacted")


def fetch(spark: SparkSession, source: Source, selected: DataFrame, plan: DataFrame, store: fetching.Store, summary: Summary) -> DataFrame:
    """Selected objects with structure, counts of redactions and fingerprint.

    Only what the plan fetches, or the store lacks under its present signal, is
    read from the database; nothing is asked of it where there is no such object.
    """
    missing = fetching.origins(selected, plan, store.read()).filter("origin = 'database'").drop("origin").cache()
    summary.read = missing.count()
    summary.reused = summary.objects - summary.read
    log.info("fetch: %d from the database, %d from the store", summary.read, summary.reused)
    if summary.read:
        health.require(source.health(), "the structure")
        store.add(pull(source, missing))
    missing.unpersist()
    print_ = fingerprint(F.col("kind"), F.col("structure"), F.col("triggers"), F.col("rows"))
    return selected.join(store.read().drop("signal"), "key").withColumn("fingerprint", print_)


def take_samples(source: Source, todo: DataFrame, options: Options) -> dict[str, str]:
    """key: rendered sample, of as many tables as asked for, those that fit whole first.

    One small read per table, since their columns differ, OPEN_CONNECTIONS of them at
    a time, begun in that order. A failed read skips its table unless the source
    turned unhealthy: then no further one begins and those under way are cancelled.
    """
    if options.samples == 0:
        return {}
    spark = todo.sparkSession
    plans = sampling.project(todo.select("key", "kind", "rows", F.col("structure.columns").alias("columns")))
    ordered = sampling.order(plans, max(options.samples, 0)).orderBy("place").collect()
    out: list[tuple | None] = [None] * len(ordered)
    left, stopped, tag = iter(range(len(ordered))), [], f"samples-{uuid.uuid4().hex}"
    turn, asking = Condition(), []

    def take(k: int) -> None:
        p = ordered[k]
        shown = f"{p['rows']} rows, whole table" if p["complete"] else f"{SAMPLE_ROWS} of {p['rows']} rows"
        log.info("sample: %d/%d %s (%s)", p["place"], p["of"], p["key"], shown)
        try:
            values = source.sample(p["key"], p["readable"], SAMPLE_ROWS)
        except health.Unhealthy:
            raise
        except Exception as error:
            if stopped:  # cancelled
                return
            asking.append(k)  # none begins before the source has answered
            with turn:
                try:
                    health.require(source.health(), "sampling")
                except BaseException as sick:
                    stopped.append(sick)
                    raise
                finally:
                    asking.remove(k)
                    turn.notify_all()
            log.warning("sample: skipped %s: %s", p["key"], error)
            return
        out[k] = (p["key"], p["readable"], values, [tuple(w) for w in p["withheld"]])

    def work() -> None:
        spark.addTag(tag)
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", "samples")  # side by side where the scheduler is FAIR
        while not stopped:
            with turn:
                turn.wait_for(lambda: not asking)
                k = next(left, None) if not stopped else None
                time.sleep(PACE if k else 0)
            if k is None:
                return
            try:
                take(k)
            except BaseException as error:
                stopped.append(error)
                spark.interruptTag(tag)

    threads = [InheritableThread(target=work, session=spark) for _ in range(min(OPEN_CONNECTIONS, len(ordered)))]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    if stopped:
        raise stopped[0]
    frame = spark.createDataFrame([r for r in out if r], "key string, columns array<string>, rows array<array<string>>, withheld array<struct<column:string,reason:string>>")
    return {r["key"]: r["sample"] for r in frame.select("key", sampling.render(F.col("columns"), F.col("rows"), F.col("withheld")).alias("sample")).collect()}


def describe(spark: SparkSession, items: DataFrame, describer: Callable[[str], dict], workers: int, answers: str = "") -> tuple[DataFrame, list[str], dict[str, float]]:
    """(sentences, failures, usage): each batch is one call, `workers` at a time, merged in batch order.

    `describer` takes a prompt and returns {"reply": JSON text, ...numbers of usage}.
    With `answers`, a folder that driver and executors share, it is called by tasks
    and each answer kept there; the driver sees failures and sums alone. Without
    one it is called on the driver, which then holds the prompts.
    """
    batched = items.join(describing.batches(items).select("key", "batch"), "key")
    asked = batched.select("batch", "key")
    prompts = describing.batch_prompts(batched)
    if answers:
        told = describing.ask(prompts, describer, answers, workers)
        failed = [r["error"] for r in told.filter("reply is null").orderBy("batch").select("error").collect()]
        each = told.select(F.explode("usage").alias("u")).groupBy("u.name").agg(F.sum("u.n").alias("n"))
        usage = {r["name"]: r["n"] for r in each.collect()}
        replies = told.filter("reply is not null").select("batch", "reply")
        return describing.resolve(describing.answers(replies), asked).select("key", "sentence"), failed, usage
    prompts = prompts.orderBy("batch").collect()

    def call(row) -> tuple[int, dict | None, str]:
        try:
            answer = describer(row["prompt"])
            json.loads(answer["reply"])
            return row["batch"], answer, ""
        except Exception as error:
            log.warning("describe: batch %d/%d failed: %s", row["batch"] + 1, len(prompts), error)
            return row["batch"], None, str(error)

    with ThreadPoolExecutor(max(1, workers)) as pool:
        outcomes = list(pool.map(call, prompts))
    replies = spark.createDataFrame([(b, a["reply"]) for b, a, _ in outcomes if a], "batch long, reply string")
    usage: dict[str, float] = {}
    for _, answer, _ in outcomes:
        for name, n in (answer or {}).items():
            if name != "reply":
                usage[name] = usage.get(name, 0) + n
    sentences = describing.resolve(describing.answers(replies), asked).select("key", "sentence")
    return sentences, [e for _, a, e in outcomes if a is None], usage


def build(spark: SparkSession, source: Source, describer: Callable[[str], dict], options: Options) -> Summary:
    """Bring the tree under options.out up to date with the source; a dry run stops after the plan."""
    summary = Summary()
    root = Path(options.out)
    writable(options.out)
    home = home_of(options)
    health.require(source.health(), "the manifest")
    objects = source.manifest().cache()
    old, state = read_tree(spark, home)
    known = state.limit(0) if options.force else state
    plan = planning.fetch_plan(objects, known).cache()
    gone = planning.dropped(objects, state)
    selected = planning.narrow(objects, options.match, options.limit)
    summary.objects = selected.count()
    summary.dropped = [r["key"] for r in gone.collect()]
    summary.reasons = {r["reason"]: r["n"] for r in planning.reason_counts(selected, plan).collect()}
    summary.refetch = sum(summary.reasons.values())
    summary.untouched = summary.objects - summary.refetch
    if options.dry_run:
        return summary

    store = fetching.Store(spark, store_path(spark, options))
    entries = fetch(spark, source, selected, plan, store, summary).cache()
    for r in entries.select(F.explode("counts").alias("c", "n")).groupBy("c").agg(F.sum("n").alias("n")).collect():
        summary.redactions[r["c"]] = r["n"]
    split = planning.describe_plan(entries.select("key", "kind", "fingerprint"), known)
    summary.unchanged = split.filter("action = 'unchanged'").count()
    todo = planning.describable(entries.join(split.filter("action = 'describe'").select("key"), "key", "left_semi")).cache()
    samples = take_samples(source, todo, options)
    summary.sampled = len(samples)

    shown = spark.createDataFrame(list(samples.items()), "key string, sample string")
    question = describing.prompt(F.col("kind"), F.col("key"), F.lit(options.database), F.col("rows"), F.col("structure"), F.coalesce("sample", F.lit("")))
    prompts = todo.join(shown, "key", "left").select(F.col("key").alias("ord"), "key", question.alias("prompt"))
    items = prompts.withColumn("cost", F.octet_length("prompt").cast("long")).cache()
    sentences, summary.failed, summary.usage = describe(spark, items, describer, options.workers, options.answers)
    sentences = sentences.cache()
    summary.described = sentences.count()
    summary.missing = [r["key"] for r in describing.missing(items, sentences).orderBy("key").collect()]

    final = describing.described(entries, sentences, state).cache()
    _write(spark, home, old, final, gone, summary)
    stamp = (options.now or datetime.now(timezone.utc)).astimezone(timezone.utc)
    counts = spark.createDataFrame(list(summary.catalogs.items()), "kind string, n long")
    row = catalogs.roster_rows(counts, options.connection, options.database, options.engine, F.lit(stamp.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp"))
    roster = catalogs.upsert_roster(catalogs.parse_roster(read_lines(spark, root / catalogs.ROSTER_FILE)), row)
    write_whole(root / catalogs.ROSTER_FILE, _tsv(list(catalogs.ROSTER), [r["line"] for r in roster.select(catalogs.line(F.col("cells")).alias("line")).collect()]))
    write_whole(root / catalogs.GUIDE_FILE, GUIDE)
    store.compact(objects)
    for df in (objects, plan, entries, todo, items, sentences, final):
        df.unpersist()
    return summary


def _tsv(header: list[str], lines: list[str]) -> str:
    return "\n".join(["\t".join(header), *lines]) + "\n"


def _write(spark: SparkSession, home: Path, old: DataFrame, entries: DataFrame, gone: DataFrame, summary: Summary) -> None:
    """Catalogs, column files and bodies, written by tasks and put in place together; files of dropped objects go with them."""
    c, whole = F.col, F.lit(0).cast("bigint")
    path = lambda *parts: F.array(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    merged = catalogs.merge(old, catalogs.catalog_rows(entries), gone).select("kind", "key", catalogs.line(c("cells")).alias("line")).cache()
    summary.catalogs = {r["kind"]: r["n"] for r in merged.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}
    name = F.create_map(*[F.lit(x) for kind_name in catalogs.FILES.items() for x in kind_name])
    lines = numbered(merged, "kind", "key").withColumn("part", F.floor(c("place") / LINES) + 2)
    texts = lines.groupBy("kind", "part").agg(F.array_sort(F.collect_list(F.struct("place", "line"))).alias("lines"))
    joined = F.concat(F.array_join(F.transform("lines", lambda x: x["line"]), "\n"), F.lit("\n"))
    files = texts.select(F.array(name[c("kind")]).alias("path"), "part", joined.alias("text"))
    heads = [([n], 1, _tsv(catalogs.header(kind), [])) if kind in summary.catalogs else ([n], 0, None) for kind, n in catalogs.FILES.items()]
    files = files.unionByName(spark.createDataFrame(heads, tree.FILES))
    shown = entries.filter(c("kind").isin("table", "view") & (F.size("structure.columns") > 0))
    text = catalogs.column_file(c("kind"), c("key"), c("fingerprint"), c("rows"), c("kb"), c("triggers"), c("description"), c("structure"))
    files = files.unionByName(shown.select(path("columns", F.concat("key", F.lit(".tsv"))).alias("path"), whole.alias("part"), text.alias("text")))
    bodies = entries.filter(c("kind").isin(*MODULES) & c("structure.definition").rlike(r"\S"))
    text = catalogs.body_file(c("key"), c("fingerprint"), c("modified"), c("description"), c("structure.definition"))
    files = files.unionByName(bodies.select(path("bodies", F.concat("key", F.lit(".sql"))).alias("path"), whole.alias("part"), text.alias("text")))
    for folder, ending in (("columns", ".tsv"), ("bodies", ".sql")):
        files = files.unionByName(gone.select(path(folder, F.concat("key", F.lit(ending))).alias("path"), whole.alias("part"), F.lit(None).cast("string").alias("text")))
    summary.column_files, summary.body_files = shown.count(), bodies.count()
    tree.write(files, home)
    merged.unpersist()


def outcome(summary: Summary, dry_run: bool = False) -> None:
    """Raise if anything that was to be described wasn't."""
    if not dry_run and (summary.failed or summary.missing):
        raise Incomplete(f"{len(summary.failed)} failed batches, {len(summary.missing)} objects without a sentence")
