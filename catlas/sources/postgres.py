"""A PostgreSQL catalog as objects and structures.

Each catalog table is read once through a narrow, filtered projection; joins,
unnesting and the collapse of overloads are Spark's. `read` is any function from
a SELECT to a frame of text cells with the projection's names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catlas.functions import text as T
from catlas.schemas import key
from catlas.sources import guarded

# Catalog codes and the schemas that are never described.
KINDS = {"rel:r": "table", "rel:p": "table", "rel:v": "view", "rel:m": "view", "pro:f": "function", "pro:p": "procedure"}
EXCLUDED = ("pg_catalog", "information_schema", "pg_toast")
TEMPORARY = ("pg_temp_", "pg_toast_temp_")

NAMESPACES = "SELECT oid::bigint AS id, nspname AS schema FROM pg_catalog.pg_namespace"
RELATIONS = """SELECT oid::bigint AS id, relnamespace::bigint AS space, relname AS name, relkind::text AS code, reltuples::bigint AS tuples,
 CASE WHEN relkind IN ('r', 'p', 'm') THEN pg_catalog.pg_total_relation_size(oid) / 1024 ELSE 0 END AS kb
 FROM pg_catalog.pg_class WHERE relkind IN ('r', 'p', 'v', 'm', 'i', 'I')"""
TRIGGERS = "SELECT tgrelid::bigint AS relation FROM pg_catalog.pg_trigger WHERE NOT tgisinternal"
ROUTINES = """SELECT oid::bigint AS id, pronamespace::bigint AS space, proname AS name, prokind::text AS code,
 pg_catalog.format_type(prorettype, NULL) AS returned,
 (SELECT string_agg(pg_catalog.format_type(t, NULL), chr(31) ORDER BY o) FROM unnest(COALESCE(proallargtypes, proargtypes::oid[])) WITH ORDINALITY AS a(t, o)) AS types,
 array_to_string(proargnames, chr(31)) AS names, array_to_string(proargmodes, chr(31)) AS modes
 FROM pg_catalog.pg_proc WHERE prokind IN ('f', 'p')"""
ATTRIBUTES = """SELECT attrelid::bigint AS relation, attnum AS num, attname AS name, pg_catalog.format_type(atttypid, atttypmod) AS rendered,
 attnotnull::int AS required, attidentity AS identity, attgenerated AS generated
 FROM pg_catalog.pg_attribute WHERE attnum > 0 AND NOT attisdropped"""
DEFAULTS = "SELECT adrelid::bigint AS relation, adnum AS num, pg_catalog.pg_get_expr(adbin, adrelid) AS expression FROM pg_catalog.pg_attrdef"
INDEXES = "SELECT indexrelid::bigint AS id, indrelid::bigint AS relation, indisprimary::int AS primary, indisunique::int AS unique, indkey::text AS nums, indnkeyatts AS parts FROM pg_catalog.pg_index"
REFERENCES = """SELECT conrelid::bigint AS relation, confrelid::bigint AS other, conname AS name, array_to_string(conkey, ' ') AS nums, array_to_string(confkey, ' ') AS others
 FROM pg_catalog.pg_constraint WHERE contype = 'f'"""
VIEW_BODIES = "SELECT oid::bigint AS id, left(pg_catalog.pg_get_viewdef(oid), 50000) AS definition FROM pg_catalog.pg_class WHERE relkind IN ('v', 'm')"
ROUTINE_BODIES = "SELECT oid::bigint AS id, left(pg_catalog.pg_get_functiondef(oid), 50000) AS definition FROM pg_catalog.pg_proc WHERE prokind IN ('f', 'p')"
HEALTH = "SELECT CASE WHEN pg_catalog.pg_is_in_recovery() THEN 'standby' ELSE 'primary' END AS state, count(*) FILTER (WHERE wait_event_type = 'Lock') AS waiting FROM pg_catalog.pg_stat_activity"


def in_scope(schema: Column) -> Column:
    out = ~schema.isin(*EXCLUDED)
    for prefix in TEMPORARY:
        out = out & ~schema.startswith(prefix)
    return out


def kind(code: Column) -> Column:
    """The object kind of a tagged catalog code, null for one that isn't described."""
    return F.coalesce(*[F.when(T.trim(code) == c, F.lit(k)) for c, k in KINDS.items()])


def parse_manifest(cells: DataFrame) -> DataFrame:
    """Objects from rows (cells: schema, name, tagged code, rows, kb, triggers); short rows and unknown codes are dropped."""
    c = [T.trim(F.col("cells")[i]) for i in range(6)]
    wide = cells.filter(F.size("cells") >= 6)
    rows = wide.select(c[0].alias("schema"), c[1].alias("name"), kind(c[2]).alias("kind"), F.greatest(T.number(c[3]), F.lit(0)).alias("rows"), T.number(c[4]).alias("kb"), T.number(c[5]).cast("int").alias("triggers"), F.lit("").alias("modified"))
    return rows.filter("kind is not null").withColumn("key", key())


class Postgres:
    def __init__(self, read: Callable[..., DataFrame]) -> None:
        self.read = read

    def _relations(self) -> DataFrame:
        spaces = self.read(NAMESPACES).filter(in_scope(F.col("schema")))
        return self.read(RELATIONS).join(spaces.withColumnRenamed("id", "space"), "space")

    def _routines(self) -> DataFrame:
        """One routine per name: overloads fold into the one of the least id."""
        spaces = self.read(NAMESPACES).filter(in_scope(F.col("schema"))).withColumnRenamed("id", "space")
        each = self.read(ROUTINES).join(spaces, "space").withColumn("at", T.number(F.col("id")))
        rest = [c for c in each.columns if c not in ("schema", "name", "at")]
        return each.groupBy("schema", "name").agg(F.min_by(F.struct(*rest), "at").alias("r")).select("schema", "name", "r.*")

    def manifest(self) -> DataFrame:
        fired = self.read(TRIGGERS).groupBy("relation").agg(F.count(F.lit(1)).alias("triggers"))
        relations = self._relations().join(fired, F.col("id") == F.col("relation"), "left")
        zero = F.lit("0")
        held = F.when(F.col("code").isin("r", "p", "m"), F.col("tuples")).otherwise(zero)
        rows = relations.select(F.array("schema", "name", F.concat(F.lit("rel:"), "code"), held, "kb", F.coalesce(F.col("triggers").cast("string"), zero)).alias("cells"))
        routines = self._routines().select(F.array("schema", "name", F.concat(F.lit("pro:"), "code"), zero, zero, zero).alias("cells"))
        return parse_manifest(rows.unionByName(routines)).orderBy("schema", "name")

    def columns(self) -> DataFrame:
        relations = self._relations().filter(F.col("code").isin("r", "p", "v", "m")).select(F.col("id").alias("relation"), key().alias("key"))
        defaults = self.read(DEFAULTS)
        each = self.read(ATTRIBUTES).join(relations, "relation").join(defaults, ["relation", "num"], "left")
        kind_ = T.split_type(T.trim(F.col("rendered")))
        numbered = (F.col("identity") != "") | F.coalesce(F.col("expression").startswith("nextval("), F.lit(False))
        return each.select("key", T.number(F.col("num")).alias("ord"), "name", kind_["type"].alias("type"), kind_["length"].alias("length"), (F.col("required") == "0").alias("nullable"), numbered.alias("identity"), (F.col("generated") != "").alias("computed"))

    def indexes(self) -> DataFrame:
        relations = self._relations()
        tables = relations.select(F.col("id").alias("relation"), key().alias("key"))
        names = self.read(RELATIONS).select("id", F.col("name").alias("index"))
        parts = self.read(INDEXES).join(tables, "relation").join(names, "id").select("*", F.posexplode(F.split("nums", " ")).alias("at", "num"))
        used = parts.filter(F.col("at") < T.number(F.col("parts")))
        named = used.join(self.read(ATTRIBUTES).select("relation", "num", F.col("name").alias("column")), ["relation", "num"])
        return named.select("key", F.struct("index", "at").alias("ord"), "index", T.flag(F.col("primary")).alias("primary"), T.flag(F.col("unique")).alias("unique"), "column")

    def foreign_keys(self) -> DataFrame:
        tables = self._relations().select("id", key().alias("key"))
        pairs = F.arrays_zip(F.split("nums", " ").alias("num"), F.split("others", " ").alias("other_num"))
        each = self.read(REFERENCES).select("relation", "other", "name", F.posexplode(pairs).alias("at", "p")).select("relation", "other", F.col("name").alias("constraint"), "at", "p.num", "p.other_num")
        names = self.read(ATTRIBUTES).select("relation", "num", "name")
        near = names.select("relation", "num", F.col("name").alias("column"))
        far = names.select(F.col("relation").alias("other"), F.col("num").alias("other_num"), F.col("name").alias("target"))
        joined = each.join(near, ["relation", "num"]).join(far, ["other", "other_num"])
        joined = joined.join(tables.withColumnRenamed("id", "relation"), "relation").join(tables.select(F.col("id").alias("other"), F.col("key").alias("other_key")), "other")
        return joined.select("key", F.struct("at", "constraint").alias("ord"), "column", F.concat_ws(".", "other_key", "target").alias("references"))

    def parameters(self) -> DataFrame:
        routines = self._routines().withColumn("key", key())
        returned = routines.select("key", F.lit(0).alias("ord"), F.lit(T.RETURNS).alias("name"), F.col("returned").alias("type"), F.lit(False).alias("output"))
        listed = lambda c: F.when(F.col(c) == "", F.array().cast("array<string>")).otherwise(F.split(c, "\x1f"))
        each = routines.select("key", F.posexplode(F.arrays_zip(listed("types").alias("type"), listed("names").alias("name"), listed("modes").alias("mode"))).alias("at", "a"))
        place = F.col("at") + 1
        name = F.when(F.coalesce(F.col("a.name"), F.lit("")) == "", F.concat(F.lit("$"), place.cast("string"))).otherwise(F.col("a.name"))
        given = each.filter("a.type is not null").select("key", place.alias("ord"), name.alias("name"), F.col("a.type").alias("type"), F.coalesce(F.col("a.mode").isin("o", "b", "t"), F.lit(False)).alias("output"))
        return returned.unionByName(given)

    def targets(self) -> DataFrame:
        """There are no synonyms here."""
        return self._relations().limit(0).select(key().alias("key"), F.lit("").alias("target"))

    def modules(self, keys: DataFrame) -> DataFrame:
        """Definitions (key, definition), at most 50,000 characters, of the given keys."""
        asked = lambda named: named.select("id", key().alias("key")).join(keys.select("key"), "key", "left_semi")
        views = guarded.definitions(self.read, VIEW_BODIES, asked(self._relations().filter(F.col("code").isin("v", "m"))))
        return views.unionByName(guarded.definitions(self.read, ROUTINE_BODIES, asked(self._routines())))

    def health(self) -> DataFrame:
        row = self.read(HEALTH)
        return row.select(F.lit(False).alias("memory_visible"), F.lit(0.0).alias("available_gb"), "state", F.lit(False).alias("memory_low"), T.number(F.col("waiting")).cast("int").alias("waiting"))

    def sample(self, key: str, columns: list[str], n: int) -> list[list[str]]:
        return guarded.sample(self.read, "postgres", key, columns, n, T.CELL_CHARS)
