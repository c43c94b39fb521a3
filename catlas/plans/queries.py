"""One query per operator of the engine over the test tables, with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catlas.functions import fingerprints, redaction
from catlas.functions import text as T
from catlas.operators import catalogs, describing, fetching, health, planning, reading, sampling, structure
from catlas.plans.workload import view
from catlas.sources import postgres, sqlserver
from catlas.sources.tables import Tables

# --- Sources -------------------------------------------------------------------------------

_CELLS = [
    "concat(' ', schema)",
    "name",
    "case kind when 'view' then 'rel:m' when 'procedure' then 'pro:p' when 'function' then 'pro:f' when 'synonym' then 'rel:S' else 'rel:r' end",
    "case when pk % 10 = 0 then 'n/a' when pk % 10 = 1 then '-1' else cast(rows as string) end",
    "cast(kb as string)",
    "cast(triggers as string)",
]


def manifest_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = F.array(*[F.expr(c) for c in _CELLS])
    short = F.when(F.col("pk") % 19 == 0, F.slice(cells, 1, 4)).otherwise(cells)
    return postgres.parse_manifest(view(spark, sf_dir, "objects").select(short.alias("cells")))


def local_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Tables(spark, sf_dir).manifest().select("key", "kind", "rows", "triggers")


def sqlserver_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    text = lambda df: df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])
    frames = {
        sqlserver.SCHEMAS: text(read("nation").selectExpr("n_nationkey as space", "case when n_nationkey = 3 then 'cdc' else n_name end as schema")),
        sqlserver.OBJECTS: text(read("customer").selectExpr("c_custkey as id", "c_nationkey as space", "c_name as name", "case when c_custkey % 3 = 0 then 'U ' when c_custkey % 3 = 1 then 'P' else 'TR' end as code", "'2026-01-02T03:04:05' as modified")),
        sqlserver.PARTITIONS: text(read("orders").selectExpr("o_custkey as id", "o_orderkey % 3 as index_id", "o_orderkey % 1000 as row_count", "o_orderkey % 50 as pages")),
        sqlserver.TRIGGERS: text(read("orders").filter("o_orderstatus = 'F'").selectExpr("o_custkey as id")),
    }
    return sqlserver.SqlServer(frames.__getitem__).manifest()


def overloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    frames = {
        postgres.NAMESPACES: read("nation").selectExpr("cast(n_nationkey as string) as id", "case n_nationkey when 0 then 'pg_catalog' when 1 then 'pg_temp_3' else lower(n_name) end as schema"),
        postgres.ROUTINES: read("supplier").selectExpr("cast(s_suppkey as string) as id", "cast(s_nationkey as string) as space", "concat('f', cast(s_suppkey % 2 as string)) as name", "'f' as code", "'integer' as returned", "'text\x1finteger' as types", "'' as names", "'i\x1fo' as modes"),
    }
    source = postgres.Postgres(frames.__getitem__)
    return source.parameters().select("key", F.col("ord").cast("long").alias("ord"), "name", "type", "output")


def postgres_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    text = lambda df: df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])
    frames = {
        postgres.NAMESPACES: text(read("nation").selectExpr("n_nationkey as id", "case n_nationkey when 0 then 'pg_catalog' else lower(n_name) end as schema")),
        postgres.RELATIONS: text(read("supplier").selectExpr("s_suppkey as id", "s_nationkey as space", "concat('t', s_suppkey) as name", "substring('rvip', s_suppkey % 4 + 1, 1) as code", "'0' as tuples", "'0' as kb")),
        postgres.ATTRIBUTES: text(read("lineitem").selectExpr("l_suppkey as relation", "l_orderkey * 10 + l_linenumber as num", "concat('c', l_linenumber) as name", "if(l_linenumber = 4, 'character varying(20)', 'integer') as rendered", "if(l_returnflag = 'N', 0, 1) as required", "if(l_linenumber = 2, 'd', '') as identity", "if(l_linestatus = 'F', 's', '') as generated")),
        postgres.DEFAULTS: text(read("lineitem").filter("l_linenumber = 3").selectExpr("l_suppkey as relation", "l_orderkey * 10 + l_linenumber as num", "if(l_orderkey % 2 = 0, concat('nextval(', l_suppkey, ')'), '0') as expression").distinct()),
    }
    return postgres.Postgres(frames.__getitem__).columns()


def sqlserver_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    text = lambda df: df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])
    frames = {
        sqlserver.SCHEMAS: text(read("nation").selectExpr("n_nationkey as space", "case when n_nationkey = 3 then 'cdc' else n_name end as schema")),
        sqlserver.OBJECTS: text(read("supplier").selectExpr("s_suppkey as id", "s_nationkey as space", "s_name as name", "'U' as code", "'' as modified")),
        sqlserver.COLUMNS: text(read("lineitem").selectExpr("l_suppkey as id", "l_orderkey * 10 + l_linenumber as num", "concat('c', l_linenumber) as name", "case l_linenumber when 1 then 'varchar' when 2 then 'nvarchar' when 3 then 'decimal' else 'int' end as type", "if(l_returnflag = 'R', -1, 2 * l_linenumber) as size", "12 as precision", "l_linenumber as scale", "if(l_returnflag = 'N', 1, 0) as nullable", "if(l_linenumber = 1, 1, 0) as identity", "if(l_linestatus = 'F', 1, 0) as computed")),
    }
    return sqlserver.SqlServer(frames.__getitem__).columns()


# --- Structure -----------------------------------------------------------------------------


def structure_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    folded = structure.fold_columns(view(spark, sf_dir, "columns"))
    line = F.array_join(F.transform("columns", lambda c: F.concat(c["name"], F.lit(" "), c["type"], c["length"])), ",")
    return folded.select("key", F.size("columns").cast("long").alias("n"), line.alias("names"))


def _index_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "columns").select("key", "ord", F.concat(F.lit("ix"), F.substring("name", 1, 4)).alias("index"), (F.col("name") == "Email").alias("primary"), F.col("computed").alias("unique"), F.concat(F.lit("c"), F.col("ord").cast("string")).alias("column"))


def index_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    folded = structure.fold_indexes(_index_rows(spark, sf_dir))
    line = lambda i: F.concat(i["name"], F.lit("("), F.array_join(i["columns"], ","), F.lit(")"), F.when(i["unique"], F.lit("u")).otherwise(F.lit("")))
    return folded.select("key", F.array_join("primary_key", ",").alias("pk"), F.array_join(F.transform("indexes", line), ";").alias("indexes"))


def split_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [("integer",), ("character varying(50)",), ("numeric(18,2)",), ("timestamp(3) without time zone",), ("integer[]",), ("text",), ("odd(",), ("a()b",)]
    return spark.createDataFrame(rows, "rendered string").select("rendered", T.split_type(F.col("rendered")).alias("s")).select("rendered", "s.type", "s.length")


def widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [("int", "4", "10", "0"), ("varchar", "50", "0", "0"), ("nvarchar", "100", "0", "0"), ("nvarchar", "-1", "0", "0"), ("varbinary", "-1", "0", "0"), ("decimal", "9", "18", "2"), ("numeric", "9", "10", "4"), ("nchar", "7", "0", "0"), ("char", "x", "0", "0")]
    df = spark.createDataFrame(rows, "type string, bytes string, p string, s string")
    return df.select("type", "bytes", T.width(F.col("type"), F.col("bytes"), F.col("p"), F.col("s")).alias("width"))


# --- Planning ------------------------------------------------------------------------------


def fetch_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.fetch_plan(view(spark, sf_dir, "objects"), view(spark, sf_dir, "state"))


def dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.dropped(view(spark, sf_dir, "objects"), view(spark, sf_dir, "state"))


def reason_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    objects = view(spark, sf_dir, "objects")
    return planning.reason_counts(planning.narrow(objects, "OBJ1"), planning.fetch_plan(objects, view(spark, sf_dir, "state")))


def narrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.narrow(view(spark, sf_dir, "objects"), "p3.OBJ1", 40).select("schema", "name", "key")


def _fingerprinted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "objects").select("key", "kind", F.when(F.col("pk") % 5 == 0, F.lit("moved")).otherwise(F.substring(F.sha2("name", 256), 1, 16)).alias("fingerprint"))


def _known(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "state").withColumn("fingerprint", F.substring(F.sha2(F.concat(F.lit("obj"), F.col("pk").cast("string")), 256), 1, 16))


def describe_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.describable(planning.describe_plan(_fingerprinted(spark, sf_dir), _known(spark, sf_dir)))


def cache_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    cache = view(spark, sf_dir, "state").select("key", F.col("modified").alias("signal"))
    return planning.cache_hits(view(spark, sf_dir, "objects").select("key", "modified"), cache)


def fetch_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a build takes each object's structure from, the store lacking some objects and holding others under an old signal."""
    objects, state = view(spark, sf_dir, "objects"), view(spark, sf_dir, "state")
    signal = F.when(F.col("pk") % 5 == 0, F.lit("2025-11-30")).otherwise(F.col("modified")).alias("signal")
    stored = state.filter("pk % 3 <> 1").select("key", signal)
    return fetching.origins(objects, planning.fetch_plan(objects, state), stored).select("key", "kind", "origin")


def key_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.key_batches(view(spark, sf_dir, "objects").select("key"))


def plan_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = planning.fetch_plan(view(spark, sf_dir, "objects"), view(spark, sf_dir, "state"))
    return plan.agg(*[F.count_if(F.col("action") == a).alias(a) for a in ("fetch", "reuse", "dropped")], F.count_if(F.col("reason") == "new").alias("new"))


# --- Fingerprints and redaction --------------------------------------------------------------


def module_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "bodies").select("key", T.digest(T.normalise(F.col("text"))).alias("fingerprint"))


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables of the workload with columns, first index and a description."""
    columns, indexes = view(spark, sf_dir, "columns"), _index_rows(spark, sf_dir)
    none = lambda schema: spark.createDataFrame([], schema)
    objects = view(spark, sf_dir, "objects").filter("kind = 'table'")
    folded = structure.structures(objects, columns, indexes, none("key string, ord long, column string, references string"), none("key string, ord long, name string, type string, output boolean"), none("key string, definition string"), none("key string, target string"))
    print_ = fingerprints.fingerprint(F.col("kind"), F.col("structure"), F.col("triggers"), F.col("rows"))
    return folded.withColumn("fingerprint", print_).withColumn("description", F.when(F.col("pk") % 2 == 0, F.lit("One\trow.")).otherwise(F.lit("")))


def table_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = _entries(spark, sf_dir)
    return entries.select("key", fingerprints.sample_depth(F.col("rows")).alias("depth"), "fingerprint")


def redacted_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = redaction.redact(F.col("text"))
    return view(spark, sf_dir, "bodies").select("key", clean.alias("r")).select("key", F.md5(F.col("r.text").cast("binary")).alias("text_md5"), redaction.summary(F.col("r.counts")).alias("counts"))


def redaction_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = view(spark, sf_dir, "bodies").select(redaction.redact(F.col("text"))["counts"].alias("c"))
    return counts.select(F.explode("c").alias("class", "n")).groupBy("class").agg(F.sum("n").alias("n"))


_NAMES = ["Email", "WorkMail", "MobilePhone", "fax_no", "SSN", "TaxId", "BirthDate", "dob", "dobx", "PasswordHash", "ApiToken", "FirstName", "maiden", "Street", "ZipCode", "CardNo", "iban", "Latitude", "Avatar", "signature", "StatusID", "Amount", "Label", "Capacity"]


def personal_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(n,) for n in _NAMES], "name string").select("name", redaction.classify(F.col("name")).alias("class"))


# --- Sampling ------------------------------------------------------------------------------


def _plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.project(_entries(spark, sf_dir).select("key", "kind", "rows", F.col("structure.columns").alias("columns")))


def sample_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plans(spark, sf_dir).select("key", F.array_join("readable", ",").alias("readable"), sampling.withheld_note(F.col("withheld")).alias("note"), "complete")


def sample_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.order(_plans(spark, sf_dir), 50).select("key", "complete", "rows", F.col("place").cast("long").alias("place"), "of")


def sample_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/nation.parquet")
    columns = ["n_nationkey", "n_name"]
    return spark.createDataFrame(sampling.rows(df, columns), "n_nationkey string, n_name string")


# --- Describing ----------------------------------------------------------------------------


def cost_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = docs.select(F.col("doc_id").alias("ord"), F.col("doc_id").cast("string").alias("key"), F.octet_length("text").cast("long").alias("cost"))
    return describing.batches(items).select("key", "batch")


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "objects").select((F.col("pk") % 50).alias("batch"), "key")


def resolve_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    objects = view(spark, sf_dir, "objects")
    name = F.when(F.col("pk") % 3 == 0, F.upper("key")).when(F.col("pk") % 3 == 1, F.upper("name")).otherwise(F.concat(F.lit("no."), "name"))
    told = F.when(F.col("pk") % 10 == 0, F.lit("")).otherwise(F.concat(F.lit("Holds "), "name"))
    given = objects.select((F.col("pk") % 50).alias("batch"), F.col("pk").cast("int").alias("pos"), name.alias("name"), told.alias("sentence"))
    return describing.resolve(given, _asked(spark, sf_dir))


def missing_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return describing.missing(_asked(spark, sf_dir).select("key"), resolve_answers(spark, sf_dir))


def descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = view(spark, sf_dir, "objects").select("key")
    return describing.described(entries, resolve_answers(spark, sf_dir).select("key", "sentence"), view(spark, sf_dir, "state"))


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    question = describing.prompt(F.col("kind"), F.col("key"), F.lit("test"), F.col("rows"), F.col("structure"), F.lit(""))
    return _entries(spark, sf_dir).select("key", question.alias("prompt"))


# --- The index ------------------------------------------------------------------------------


def catalog_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogs.catalog_rows(_entries(spark, sf_dir)).select("key", "kind", catalogs.line(F.col("cells")).alias("line"))


def _old_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = F.concat_ws("\t", "key", F.col("rows").cast("string"), F.lit("8 KB"), F.lit("0"), F.lit("3"), "modified", "fingerprint")
    text = F.when(F.col("pk") % 13 == 2, F.concat(F.lit("# "), row)).when(F.col("pk") % 13 == 3, F.col("key")).when(F.col("description") == "", row).otherwise(F.concat(row, F.lit("\t"), "description"))
    return view(spark, sf_dir, "state").select(text.alias("value"))


def parse_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogs.parse_state(catalogs.parse_rows(_old_lines(spark, sf_dir), "table"), "table")


def catalog_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = catalogs.parse_rows(_old_lines(spark, sf_dir), "table").withColumn("kind", F.lit("table"))
    new = catalogs.catalog_rows(_entries(spark, sf_dir).filter("pk % 4 < 2"))
    return catalogs.merge(old, new, dropped(spark, sf_dir)).select("key", F.element_at("cells", 2).alias("rows"), F.element_at("cells", 8).alias("description"))


def size_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "objects").select("key", T.size(F.col("kb")).alias("size"))


def column_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    text = catalogs.column_file(c("kind"), c("key"), c("fingerprint"), c("rows"), c("kb"), c("triggers"), c("description"), c("structure"))
    return _entries(spark, sf_dir).filter(F.size("structure.columns") > 0).select("key", text.alias("text"))


def body_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    text = catalogs.body_file(c("key"), F.lit("0123456789abcdef"), F.when(c("doc_id") % 2 == 0, F.lit("2026-01-01")), F.lit("Says\nthings."), c("text"))
    return view(spark, sf_dir, "bodies").select("key", F.md5(text.cast("binary")).alias("file_md5"))


def roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = view(spark, sf_dir, "objects").groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    new = catalogs.roster_rows(counts, "stage", "test", "spark", F.lit("2026-03-05 09:00:00").cast("timestamp"))
    old = catalogs.parse_roster(spark.createDataFrame([("connection\tdatabase",), ("prod\tcore\tpostgres\t5",), ("stage\ttest\tspark\t1\t1\t1\t1\t1\told",), ("# x\ty",), ("lone",)], "value string"))
    return catalogs.upsert_roster(old, new).select("key", catalogs.line(F.col("cells")).alias("line"))


# --- Reading --------------------------------------------------------------------------------


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading.mentions(view(spark, sf_dir, "bodies"), "app3.obj3")


def writers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading.writers(view(spark, sf_dir, "bodies"), "APP3.obj3")


def all_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading.all_mentions(view(spark, sf_dir, "bodies"), view(spark, sf_dir, "objects"))


def all_writers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading.all_writers(view(spark, sf_dir, "bodies"), view(spark, sf_dir, "objects"))


def _stamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    built = F.when(F.col("o_orderkey") % 5 == 0, F.lit("soon")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return orders.select(F.col("o_orderkey").alias("pos"), F.col("o_orderpriority").alias("tree"), F.col("o_orderstatus").alias("connection"), F.concat(F.lit("db"), F.col("o_custkey").cast("string")).alias("database"), built.alias("built"))


def oldest_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading.oldest_build(_stamped(spark, sf_dir)).drop("at")


def tree_ages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading.tree_ages(_stamped(spark, sf_dir), F.lit("2026-03-05 09:30:00").cast("timestamp"))


def health_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(True, 64.0, "memory is available", False, 0), (True, 1.5, "memory is available", False, 0), (True, 64.0, "Memory is LOW", False, 0), (True, 64.0, "fine", True, 9), (False, 0.0, "primary", False, 6), (False, 0.0, "low", False, 5), (None, None, None, None, None)]
    return health.classify(spark.createDataFrame(rows, health.READING)).select("memory_visible", "waiting", "ok", "known", "reason")


def server_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts over readings made of the suppliers' balances, every reason among them."""
    readings = spark.read.parquet(f"{sf_dir}/supplier.parquet").selectExpr(
        "s_suppkey as server", "if(s_suppkey % 7 = 0, null, s_suppkey % 2 = 0) as memory_visible", "floor(s_acctbal / 100) / 4 as available_gb",
        "if(s_nationkey % 5 = 0, 'memory is Low', 'memory is fine') as state", "s_suppkey % 11 = 0 as memory_low", "cast(s_suppkey % 9 as int) as waiting",
    )
    return health.classify(readings).select("server", "ok", "known", "reason")


QUERIES = {
    f.__name__: f
    for f in (
        manifest_parse, local_manifest, sqlserver_manifest, overloads, postgres_columns, sqlserver_columns, structure_fold, index_fold, split_types, widths, fetch_plan, dropped, reason_counts,
        narrow, describe_plan, cache_hits, fetch_stage, key_batches, plan_summary, module_fingerprints, table_fingerprints, redacted_bodies, redaction_totals,
        personal_columns, sample_projection, sample_order, sample_rows, cost_batches, resolve_answers, missing_answers, descriptions, prompts, catalog_rows,
        parse_state, catalog_merge, size_texts, column_files, body_files, roster, mentions, writers, all_mentions, all_writers, oldest_build, tree_ages, health_verdicts, server_health,
    )
}
