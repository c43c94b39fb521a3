"""The catalog scans over frames made of the test tables, and what a build says about objects, each with its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catlas.functions import text as T
from catlas.operators import catalogs, describing, fetching, health, planning, reading, sampling, structure
from catlas.plans import oracles, queries
from catlas.plans.workload import view, with_views
from catlas.sources import postgres, sqlserver, tree
from catlas.storage import materialize, shared_dir


class Frames:
    """What a guarded reader is to a source: a statement's rows as text; conditions are added to them."""

    def __init__(self, spark: SparkSession, sf_dir: str, made: dict[str, tuple[str, str, list[str]]]) -> None:
        """made: statement to (table, condition, expressions)."""
        self.frames = {}
        for statement, (table, where, expressions) in made.items():
            rows = spark.read.parquet(f"{sf_dir}/{table}.parquet").filter(where).selectExpr(*expressions)
            self.frames[statement] = rows.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in rows.columns])

    def __call__(self, statement: str, conditions: Sequence[str] = ()) -> DataFrame:
        rows = self.frames[statement]
        return rows.filter(" or ".join(f"({c})" for c in conditions)) if conditions else rows


# --- PostgreSQL: suppliers are relations, parts are routines, nations are schemas -----------------

_SPACES = {postgres.NAMESPACES: ("nation", "true", ["n_nationkey as id", "case n_nationkey when 0 then 'pg_catalog' when 1 then 'pg_temp_3' else lower(n_name) end as schema"])}
_RELATIONS = ("supplier", "true", ["s_suppkey as id", "s_nationkey as space", "concat('t', s_suppkey) as name", "substring('rvipmI', s_suppkey % 6 + 1, 1) as code", "cast(floor(s_acctbal) as bigint) as tuples", "s_suppkey * 8 as kb"])
_ROUTINES = (
    "part", "true",
    ["p_partkey as id", "p_size % 25 as space", "concat('f', p_partkey % 40) as name", "if(p_partkey % 2 = 0, 'f', 'p') as code", "'integer' as returned", "if(p_partkey % 3 = 0, '', concat('text', chr(31), 'bigint')) as types", "if(p_partkey % 3 = 1, concat('a', chr(31)), '') as names", "if(p_partkey % 3 = 1, concat('i', chr(31), 'o'), '') as modes"],
)
_PG = {**_SPACES, postgres.RELATIONS: _RELATIONS, postgres.ROUTINES: _ROUTINES, postgres.TRIGGERS: ("orders", "o_orderstatus = 'F'", ["o_custkey % 100 as relation"])}
_ATTRIBUTES = ("supplier", "true", ["s_suppkey as relation", "explode(sequence(1, 3)) as num", "concat('c', num) as name", "'integer' as rendered", "'1' as required", "'' as identity", "'' as generated"])


def postgres_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postgres.Postgres(Frames(spark, sf_dir, _PG)).manifest()


def postgres_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = postgres.Postgres(Frames(spark, sf_dir, _PG)).parameters()
    return rows.select("key", F.col("ord").cast("long").alias("ord"), "name", "type", "output")


def postgres_indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _PG | {postgres.ATTRIBUTES: _ATTRIBUTES, postgres.INDEXES: ("supplier", "s_suppkey % 6 = 0", ["s_suppkey + 3 as id", "s_suppkey as relation", "if(s_suppkey % 4 = 0, 1, 0) as primary", "if(s_nationkey % 2 = 0, 'true', 'f') as unique", "'3 1 2' as nums", "s_suppkey % 3 + 1 as parts"])}
    rows = postgres.Postgres(Frames(spark, sf_dir, made)).indexes()
    return rows.select("key", F.col("ord.at").cast("long").alias("at"), "index", "primary", "unique", "column")


def postgres_foreign_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _PG | {postgres.ATTRIBUTES: _ATTRIBUTES, postgres.REFERENCES: ("supplier", "true", ["s_suppkey as relation", "s_suppkey % 9 + 1 as other", "concat('fk', s_suppkey) as name", "'1 3' as nums", "'2 1' as others"])}
    rows = postgres.Postgres(Frames(spark, sf_dir, made)).foreign_keys()
    return rows.select("key", F.col("ord.at").cast("long").alias("at"), "column", "references")


def postgres_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions of the views and routines of the manifest, asked for by id."""
    bodies = {postgres.VIEW_BODIES: ("supplier", "true", ["s_suppkey as id", "concat('view ', s_name) as definition"]), postgres.ROUTINE_BODIES: ("part", "true", ["p_partkey as id", "concat('body ', p_name) as definition"])}
    source = postgres.Postgres(Frames(spark, sf_dir, _PG | bodies))
    return source.modules(source.manifest().filter(F.col("kind").isin("view", "procedure", "function")))


def postgres_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reading per order status, as sessions wait on locks, and its verdict."""
    made = {postgres.HEALTH: ("orders", "o_orderkey % 50 = 0", ["if(o_orderstatus = 'F', 'standby', 'primary') as state", "o_orderkey % 13 as waiting"])}
    return health.classify(postgres.Postgres(Frames(spark, sf_dir, made)).health()).groupBy("state", "memory_visible", "ok", "reason").agg(F.count(F.lit(1)).alias("n"))


# --- SQL Server: the same tables under its catalog's names ----------------------------------------

_MS = {
    sqlserver.SCHEMAS: ("nation", "true", ["n_nationkey as space", "case when n_nationkey = 3 then 'cdc' else n_name end as schema"]),
    sqlserver.OBJECTS: ("supplier", "true", ["s_suppkey as id", "s_nationkey as space", "s_name as name", "case s_suppkey % 4 when 0 then 'U ' when 1 then 'P' when 2 then 'SN' else 'V' end as code", "'' as modified"]),
    sqlserver.COLUMNS: ("supplier", "true", ["s_suppkey as id", "explode(sequence(1, 3)) as num", "concat('c', num) as name", "'int' as type", "4 as size", "10 as precision", "0 as scale", "1 as nullable", "0 as identity", "0 as computed"]),
}


def sqlserver_indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _MS | {
        sqlserver.INDEXES: ("supplier", "s_suppkey % 4 = 0", ["s_suppkey as id", "1 as index_id", "concat('ix', s_suppkey) as index", "if(s_suppkey % 8 = 0, 1, 0) as primary", "'1' as unique"]),
        sqlserver.INDEX_COLUMNS: ("supplier", "true", ["s_suppkey as id", "1 as index_id", "explode(sequence(1, 3)) as num", "4 - num as at"]),
    }
    rows = sqlserver.SqlServer(Frames(spark, sf_dir, made)).indexes()
    return rows.select("key", F.col("ord.at").cast("long").alias("at"), "index", "primary", "unique", "column")


def sqlserver_foreign_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _MS | {sqlserver.REFERENCES: ("supplier", "true", ["s_suppkey as id", "2 as num", "s_suppkey % 9 + 1 as other", "3 as other_num"])}
    return sqlserver.SqlServer(Frames(spark, sf_dir, made)).foreign_keys().select("key", "column", "references")


def sqlserver_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _MS | {sqlserver.PARAMETERS: ("lineitem", "l_linenumber < 4", ["l_suppkey as id", "l_orderkey * 10 + l_linenumber as num", "if(l_linenumber = 1, '', concat('@p', l_linenumber)) as name", "if(l_linenumber = 3, 'nvarchar', 'int') as type", "if(l_quantity > 40, -1, 2 * l_linenumber) as size", "if(l_returnflag = 'R', 1, 0) as output"])}
    return sqlserver.SqlServer(Frames(spark, sf_dir, made)).parameters()


def sqlserver_synonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _MS | {sqlserver.SYNONYMS: ("supplier", "s_suppkey % 4 = 2", ["s_suppkey as id", "concat('dbo.t', s_suppkey % 7) as target"])}
    return sqlserver.SqlServer(Frames(spark, sf_dir, made)).targets()


def sqlserver_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _MS | {sqlserver.BODIES: ("supplier", "true", ["s_suppkey as id", "concat('as ', s_name) as definition"])}
    source = sqlserver.SqlServer(Frames(spark, sf_dir, made))
    keys = spark.read.parquet(f"{sf_dir}/supplier.parquet").join(spark.read.parquet(f"{sf_dir}/nation.parquet"), F.col("s_nationkey") == F.col("n_nationkey")).filter("s_suppkey % 4 in (1, 3)")
    return source.modules(keys.select(F.concat_ws(".", "n_name", "s_name").alias("key")))


def sqlserver_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = {sqlserver.HEALTH: ("customer", "true", ["if(c_custkey % 10 = 0, 'n/a', string(c_custkey % 5)) as available", "if(c_custkey % 7 = 0, 'Physical memory is low', 'steady') as state", "c_custkey % 8 as waiting", "if(c_custkey % 9 = 0, 1, 0) as low"])}
    return health.classify(sqlserver.SqlServer(Frames(spark, sf_dir, made)).health()).groupBy("ok", "reason").agg(F.count(F.lit(1)).alias("n"))


# --- What a build says ------------------------------------------------------------------------------


def module_catalog_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog lines of views, procedures, functions and synonyms: columns, parameters, what is returned, targets.

    Parameters of one number stand as their rows do in the table.
    """
    none = lambda schema: spark.createDataFrame([], schema)
    objects = view(spark, sf_dir, "objects").filter("kind <> 'table'").select("schema", "name", "kind", "rows", "kb", "triggers", "modified", "key", "pk")
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr("concat('app', l_partkey % 7, '.obj', l_partkey) as key", "struct(l_orderkey * 10 + l_linenumber as num, _metadata.file_path as file, _metadata.row_index as row) as ord", "if(l_linenumber = 1, '(returns)', concat('@p', l_linenumber)) as name", "if(l_linenumber = 2, 'text', 'int') as type", "l_returnflag = 'R' as output")
    targets = objects.select("key", F.concat(F.lit("app0.obj"), F.col("pk").cast("string")).alias("target")).filter("pk % 11 = 3")
    bodies = objects.select("key", F.concat(F.lit("as\r\n "), F.col("name"), F.lit("\t \n")).alias("definition"))
    columns = view(spark, sf_dir, "columns")
    folded = structure.structures(objects, columns, none("key string, ord long, index string, primary boolean, unique boolean, column string"), none("key string, ord long, column string, references string"), lines, bodies, targets)
    print_ = F.when(F.col("kind") == "synonym", T.digest(F.col("structure.target"))).otherwise(T.digest(T.normalise(F.col("structure.definition"))))
    entries = folded.withColumn("fingerprint", print_).withColumn("description", F.concat(F.lit(" Does "), F.col("name"), F.lit(".\n")))
    return catalogs.catalog_rows(entries).select("key", "kind", catalogs.line(F.col("cells")).alias("line"))


def batch_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts of twelve documents' whole texts each."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = docs.select(F.floor(F.col("doc_id") / 12).alias("batch"), F.col("doc_id").alias("ord"), F.concat(F.lit("doc."), F.col("doc_id").cast("string")).alias("key"), F.col("text").alias("prompt"))
    return describing.batch_prompts(items).select("batch", F.col("n").cast("long").alias("n"), F.md5(F.col("prompt").cast("binary")).alias("prompt_md5"))


def parsed_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies of a describer, one per order, read strictly."""
    told = F.array(F.struct(F.concat(F.lit(" "), F.col("l_returnflag"), F.lit("\t")).alias("name"), F.when(F.col("l_linenumber") == 2, None).otherwise(F.concat(F.lit("Says \"\n"), F.col("l_partkey"), F.lit(" é."))).alias("sentence")))
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_orderkey").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", told.alias("o")))), lambda x: x["o"])).alias("objects"))
    return describing.answers(lines.select(F.col("l_orderkey").alias("batch"), F.to_json(F.struct("objects")).alias("reply"))).select("batch", F.col("pos").cast("long").alias("pos"), "name", "sentence")


def sample_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each nation's customers as a sample, cells cleaned, with a note on what is withheld."""
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet")
    row = F.array(F.col("c_custkey").cast("string"), F.concat(F.col("c_mktsegment"), F.lit("\t"), F.col("c_name"), F.lit("\n")), F.repeat(F.col("c_mktsegment"), 40))
    grouped = customers.groupBy("c_nationkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", row.alias("row")))), lambda x: x["row"]).alias("rows"))
    names = F.array(F.lit("id"), F.lit("said"), F.lit("long"))
    withheld = F.when(F.col("c_nationkey") % 2 == 0, F.array(F.struct(F.lit("Email").alias("column"), F.lit("pii").alias("reason")), F.struct(F.lit("Photo").alias("column"), F.lit("unsampleable").alias("reason")))).otherwise(F.array().cast("array<struct<column:string,reason:string>>"))
    return grouped.select("c_nationkey", F.md5(sampling.render(names, F.col("rows"), withheld).cast("binary")).alias("text_md5"))


def module_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects with a body that are to be fetched, by kind."""
    objects = view(spark, sf_dir, "objects")
    plan = planning.fetch_plan(objects, view(spark, sf_dir, "state")).filter("action = 'fetch'")
    return objects.join(plan.select("key"), "key", "left_semi").filter(F.col("kind").isin("view", "procedure", "function")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def roster_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts above 0 of roster rows, one per customer."""
    line = F.concat_ws("\t", F.col("c_mktsegment"), F.col("c_name"), F.lit("spark"), F.col("c_nationkey").cast("string"), F.when(F.col("c_custkey") % 3 == 0, "many").otherwise((F.col("c_custkey") % 4).cast("string")), F.lit("-2"))
    rows = catalogs.parse_roster(spark.read.parquet(f"{sf_dir}/customer.parquet").select(line.alias("value")))
    return rows.select("key", F.explode(catalogs.positive_counts(F.col("cells"))).alias("kind", "n"))


def worst_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stalest database of each segment's customers, by the time of their last order."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").join(spark.read.parquet(f"{sf_dir}/customer.parquet"), F.col("o_custkey") == F.col("c_custkey"))
    last = orders.groupBy("c_mktsegment", "o_custkey").agg(F.max("o_orderdate").alias("at"))
    rows = last.select(F.col("o_custkey").alias("pos"), F.col("c_mktsegment").alias("tree"), F.lit("c").alias("connection"), F.col("o_custkey").cast("string").alias("database"), T.iso(F.col("at")).alias("built"))
    return reading.tree_ages(rows, F.lit("2026-03-05 09:30:00").cast("timestamp")).select("tree", "database", "built", "age")


def written_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Column and body files as tasks have written them, read back: path below the tree and digest."""
    shared = shared_dir(spark)
    root, listed = tree.local_path(f"{shared}/tree"), f"{shared}/listed"
    path = lambda folder, ending: F.array(F.lit(folder), F.concat("key", F.lit(ending)))
    c = F.col
    text = catalogs.body_file(c("key"), F.lit("0123456789abcdef"), F.when(c("doc_id") % 2 == 0, F.lit("2026-01-01")), F.lit("Says\nthings."), c("text"))
    bodies = view(spark, sf_dir, "bodies").select(path("bodies", ".sql").alias("path"), F.lit(0).cast("bigint").alias("part"), text.alias("text"))
    columns = queries.column_files(spark, sf_dir).select(path("columns", ".tsv").alias("path"), F.lit(0).cast("bigint").alias("part"), "text")
    tree.write(bodies.unionByName(columns), root, listed)
    return tree.digests(spark, root, listed)


def stored_structures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a store serves after two pulls, of all tables and then of some under a new signal."""
    kept = fetching.Store(spark, f"{shared_dir(spark)}/store")
    counts = F.create_map(F.lit("email"), (F.col("pk") % 5).cast("int"), F.lit("password"), F.lit(1))
    entries = materialize(queries._entries(spark, sf_dir).select("key", "pk", "modified", "structure", counts.alias("counts")), "entries")  # folded once, read by both pulls
    kept.add(entries)
    kept.add(entries.filter("pk % 3 = 0").withColumn("modified", F.lit("2027-01-01")))
    return kept.read().select("key", "signal", F.size("structure.columns").cast("long").alias("n_columns"), F.col("counts")["email"].cast("long").alias("emails"))


QUERIES = {
    f.__name__: f
    for f in (
        postgres_manifest, postgres_parameters, postgres_indexes, postgres_foreign_keys, postgres_modules, postgres_health, sqlserver_indexes, sqlserver_foreign_keys, sqlserver_parameters, sqlserver_synonyms,
        sqlserver_modules, sqlserver_health, module_catalog_rows, batch_prompts, parsed_answers, sample_texts, module_filter, roster_counts, worst_trees, written_tree, stored_structures,
    )
}

_PG_SQL = """
WITH ns AS (SELECT n_nationkey AS space, lower(n_name) AS schema FROM nation WHERE n_nationkey > 1),
rel AS (SELECT s_suppkey AS id, schema, 't' || s_suppkey AS name, 'rvipmI'[s_suppkey % 6 + 1] AS code, floor(s_acctbal)::BIGINT AS tuples, s_suppkey * 8 AS kb, schema || '.t' || s_suppkey AS key FROM supplier JOIN ns ON s_nationkey = space),
rou AS (SELECT schema, 'f' || (p_partkey % 40) AS name, min(p_partkey) AS id, schema || '.f' || (p_partkey % 40) AS key FROM part JOIN ns ON p_size % 25 = space GROUP BY schema, p_partkey % 40)"""
_MS_SQL = """
WITH o AS (SELECT s_suppkey AS id, n_name || '.' || s_name AS key, s_suppkey % 4 AS code FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_nationkey <> 3)"""

ORACLE_SQL = {
    "postgres_manifest": _PG_SQL + """,
fired AS (SELECT o_custkey % 100 AS id, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
SELECT schema, name, CASE WHEN code IN ('r', 'p') THEN 'table' ELSE 'view' END AS kind, CASE WHEN code IN ('r', 'p', 'm') THEN greatest(tuples, 0) ELSE 0 END AS rows, kb::BIGINT AS kb, coalesce(n, 0)::INT AS triggers, '' AS modified, key
FROM rel LEFT JOIN fired USING (id) WHERE code IN ('r', 'p', 'v', 'm')
UNION ALL SELECT schema, name, CASE WHEN id % 2 = 0 THEN 'function' ELSE 'procedure' END, 0, 0, 0, '', key FROM rou""",
    "postgres_parameters": _PG_SQL + """
SELECT key, 0::BIGINT AS ord, '(returns)' AS name, 'integer' AS type, false AS output FROM rou
UNION ALL SELECT key, 1, CASE WHEN id % 3 = 1 THEN 'a' ELSE '$1' END, 'text', false FROM rou WHERE id % 3 <> 0
UNION ALL SELECT key, 2, '$2', 'bigint', id % 3 = 1 FROM rou WHERE id % 3 <> 0""",
    "postgres_indexes": _PG_SQL + """
SELECT t.key, p.at::BIGINT AS at, 't' || i.s_suppkey AS "index", t.id % 4 = 0 AS "primary", s.s_nationkey % 2 = 0 AS "unique", 'c' || [3, 1, 2][p.at + 1] AS "column"
FROM rel t JOIN supplier i ON i.s_suppkey = t.id + 3 JOIN supplier s ON s.s_suppkey = t.id, (SELECT unnest([0, 1, 2]) AS at) AS p WHERE t.id % 6 = 0 AND p.at < t.id % 3 + 1""",
    "postgres_foreign_keys": _PG_SQL + """
SELECT t.key, p.at::BIGINT AS at, 'c' || [1, 3][p.at + 1] AS "column", o.key || '.c' || [2, 1][p.at + 1] AS "references" FROM rel t JOIN rel o ON o.id = t.id % 9 + 1, (SELECT unnest([0, 1]) AS at) AS p""",
    "postgres_modules": _PG_SQL + """
SELECT key, 'view ' || s_name AS definition FROM rel JOIN supplier ON s_suppkey = id WHERE code IN ('v', 'm')
UNION ALL SELECT key, 'body ' || p_name FROM rou JOIN part ON p_partkey = id""",
    "postgres_health": """
SELECT CASE WHEN o_orderstatus = 'F' THEN 'standby' ELSE 'primary' END AS state, false AS memory_visible, o_orderkey % 13 <= 5 AS ok,
       CASE WHEN o_orderkey % 13 > 5 THEN (o_orderkey % 13) || ' queries are queued waiting for a resource' ELSE '' END AS reason, count(*) AS n FROM orders WHERE o_orderkey % 50 = 0 GROUP BY ALL""",
    "sqlserver_indexes": _MS_SQL + """
SELECT key, (4 - num)::BIGINT AS at, 'ix' || id AS "index", id % 8 = 0 AS "primary", true AS "unique", 'c' || num AS "column" FROM o, (SELECT unnest([1, 2, 3]) AS num) AS p WHERE code = 0""",
    "sqlserver_foreign_keys": _MS_SQL + """
SELECT o.key, 'c2' AS "column", r.key || '.c3' AS "references" FROM o JOIN o AS r ON r.id = o.id % 9 + 1""",
    "sqlserver_parameters": _MS_SQL + """
SELECT key, (l_orderkey * 10 + l_linenumber)::BIGINT AS ord, CASE WHEN l_linenumber = 1 THEN '(returns)' ELSE '@p' || l_linenumber END AS name,
       CASE WHEN l_linenumber <> 3 THEN 'int' WHEN l_quantity > 40 THEN 'nvarchar(max)' ELSE 'nvarchar(3)' END AS type, l_returnflag = 'R' AS output FROM lineitem JOIN o ON id = l_suppkey WHERE l_linenumber < 4""",
    "sqlserver_synonyms": _MS_SQL + """
SELECT key, 'dbo.t' || (id % 7) AS target FROM o WHERE code = 2""",
    "sqlserver_modules": _MS_SQL + """
SELECT key, 'as ' || s_name AS definition FROM o JOIN supplier ON s_suppkey = id WHERE code IN (1, 3)""",
    "sqlserver_health": """
WITH r AS (SELECT c_custkey % 5 AS gb, c_custkey % 7 = 0 AS low_state, c_custkey % 9 = 0 AS low, c_custkey % 8 AS waiting FROM customer WHERE c_custkey % 10 <> 0),
w AS (SELECT CASE WHEN gb < 2 THEN 'only ' || gb || ' GB of OS memory free (floor is 2 GB)' WHEN low_state THEN 'the server reports "Physical memory is low"' WHEN low THEN 'the server signalled physical memory low'
                  WHEN waiting > 5 THEN waiting || ' queries are queued waiting for a resource' ELSE '' END AS reason FROM r)
SELECT reason = '' AS ok, reason, count(*) AS n FROM w GROUP BY ALL""",
    "module_catalog_rows": with_views(
        r""", c AS (SELECT key, count(*) AS n FROM columns GROUP BY key),
l AS (SELECT 'app' || (l_partkey % 7) || '.obj' || l_partkey AS key, l_orderkey * 10 + l_linenumber AS ord, l_linenumber, CASE WHEN l_linenumber = 2 THEN 'text' ELSE 'int' END AS type, l_returnflag = 'R' AS output FROM lineitem),
p AS (
  SELECT key, coalesce(string_agg(CASE WHEN l_linenumber <> 1 THEN '@p' || l_linenumber || ' ' || type || CASE WHEN output THEN ' out' ELSE '' END END, ', ' ORDER BY ord), '') AS params, CASE WHEN bool_or(l_linenumber = 1) THEN 'int' ELSE 'table' END AS returned
  FROM l GROUP BY key)
SELECT key, kind, concat_ws(chr(9), key,
  CASE kind WHEN 'view' THEN coalesce(c.n, 0)::VARCHAR WHEN 'procedure' THEN coalesce(params, '') WHEN 'function' THEN coalesce(returned, 'table') || chr(9) || coalesce(params, '') ELSE 'app0.obj' || pk END,
  modified, sha256(CASE WHEN kind = 'synonym' THEN 'app0.obj' || pk ELSE 'as' || chr(10) || ' ' || name END)[1:16], 'Does ' || name || '.') AS line
FROM objects LEFT JOIN c USING (key) LEFT JOIN p USING (key) WHERE kind <> 'table'""",
        "objects",
        "columns",
    ),
    "batch_prompts": """
WITH i AS (SELECT doc_id // 12 AS batch, doc_id, text, row_number() OVER (PARTITION BY doc_id // 12 ORDER BY doc_id) AS k FROM documents)
SELECT batch::BIGINT AS batch, count(*) AS n, md5('Describe ' || count(*) || ' database objects, each marked below.' || chr(10) || chr(10) || 'Answer with one entry per object, its `name` just as in the mark.' || chr(10) || chr(10) || chr(10) || chr(10)
  || string_agg('=== OBJECT ' || k || ': doc.' || doc_id || ' ===' || chr(10) || text, chr(10) || chr(10) ORDER BY k)) AS prompt_md5 FROM i GROUP BY batch""",
    "parsed_answers": """
WITH t AS (SELECT l_orderkey, l_linenumber, l_returnflag AS name, CASE WHEN l_linenumber = 2 THEN '' ELSE 'Says "' || chr(10) || l_partkey || ' é.' END AS sentence FROM lineitem)
SELECT l_orderkey AS batch, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, name, sentence) - 1 AS pos, name, sentence FROM t""",
    "sample_texts": """
SELECT c_nationkey, md5('id' || chr(9) || 'said' || chr(9) || 'long' || chr(10) || string_agg(c_custkey || chr(9) || (c_mktsegment || ' ' || c_name || ' ')[1:200] || chr(9) || repeat(c_mktsegment, 40)[1:200], chr(10) ORDER BY c_custkey)
  || CASE WHEN c_nationkey % 2 = 0 THEN chr(10) || '# not sampled (pii): Email' || chr(10) || '# not sampled (unsampleable): Photo' ELSE '' END) AS text_md5 FROM customer GROUP BY c_nationkey""",
    "module_filter": with_views(
        """ SELECT o.kind, count(*) AS n FROM objects o LEFT JOIN state s USING (key)
WHERE o.kind IN ('view', 'procedure', 'function') AND (s.key IS NULL OR NOT coalesce(o.modified <> '' AND o.modified = s.modified, false)) GROUP BY o.kind""",
        "objects",
        "state",
    ),
    "roster_counts": """
WITH r AS (SELECT c_mktsegment || '/' || c_name AS key, c_nationkey AS t, CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE c_custkey % 4 END AS v FROM customer)
SELECT key, 'tables' AS kind, t::DOUBLE AS n FROM r WHERE t > 0 UNION ALL SELECT key, 'views', v::DOUBLE FROM r WHERE v > 0""",
    "worst_trees": """
WITH l AS (SELECT c_mktsegment AS tree, o_custkey, max(o_orderdate)::TIMESTAMP AS seen FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
f AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY seen, o_custkey) AS n FROM l),
h AS (SELECT *, floor(date_diff('second', seen, TIMESTAMP '2026-03-05 09:30:00') / 3600.0) AS hours FROM f WHERE n = 1)
SELECT tree, o_custkey::VARCHAR AS database, strftime(seen, '%Y-%m-%dT%H:%M:%S') AS built,
       CASE WHEN hours >= 24 THEN floor(hours / 24)::BIGINT || CASE WHEN floor(hours / 24) = 1 THEN ' day' ELSE ' days' END ELSE hours::BIGINT || CASE WHEN hours = 1 THEN ' hour' ELSE ' hours' END END AS age FROM h""",
    "written_tree": f"SELECT 'bodies/' || key || '.sql' AS path, file_md5 FROM ({oracles.ORACLE_SQL['body_files']}) UNION ALL SELECT 'columns/' || key || '.tsv', md5(text) FROM ({oracles.ORACLE_SQL['column_files']})",
    "stored_structures": with_views(
        """, c AS (SELECT key, count(*) AS n FROM columns GROUP BY key)
SELECT key, CASE WHEN pk % 3 = 0 THEN '2027-01-01' ELSE modified END AS signal, coalesce(n, 0)::BIGINT AS n_columns, (pk % 5)::BIGINT AS emails FROM objects LEFT JOIN c USING (key) WHERE kind = 'table'""",
        "objects",
        "columns",
    ),
}
