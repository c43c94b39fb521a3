"""A SQL Server catalog as objects and structures; see postgres.py for the shape of `read`."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catlas.functions import text as T
from catlas.schemas import key
from catlas.sources import guarded

# Catalog codes and the schemas that are never described.
KINDS = {"U": "table", "V": "view", "P": "procedure", "PC": "procedure", "FN": "function", "IF": "function", "TF": "function", "FT": "function", "SN": "synonym"}
EXCLUDED = ("cdc",)

SCHEMAS = "SELECT schema_id AS space, name AS [schema] FROM sys.schemas"
OBJECTS = "SELECT object_id AS id, schema_id AS space, name, RTRIM(type) AS code, CONVERT(varchar(19), modify_date, 126) AS modified FROM sys.objects WHERE is_ms_shipped = 0 AND type IN ('U', 'V', 'P', 'PC', 'FN', 'IF', 'TF', 'FT', 'SN')"
PARTITIONS = "SELECT object_id AS id, index_id, row_count, used_page_count AS pages FROM sys.dm_db_partition_stats"
TRIGGERS = "SELECT parent_id AS id FROM sys.triggers"
COLUMNS = """SELECT c.object_id AS id, c.column_id AS num, c.name, t.name AS type, c.max_length AS size, c.precision, c.scale, c.is_nullable AS nullable, c.is_identity AS [identity], c.is_computed AS computed
 FROM sys.columns c JOIN sys.types t ON t.user_type_id = c.user_type_id"""
INDEXES = "SELECT object_id AS id, index_id, name AS [index], is_primary_key AS [primary], is_unique AS [unique] FROM sys.indexes WHERE type > 0"
INDEX_COLUMNS = "SELECT object_id AS id, index_id, column_id AS num, key_ordinal AS at FROM sys.index_columns WHERE is_included_column = 0"
REFERENCES = "SELECT parent_object_id AS id, parent_column_id AS num, referenced_object_id AS other, referenced_column_id AS other_num FROM sys.foreign_key_columns"
PARAMETERS = """SELECT p.object_id AS id, p.parameter_id AS num, p.name, t.name AS type, p.max_length AS size, p.is_output AS output
 FROM sys.parameters p JOIN sys.types t ON t.user_type_id = p.user_type_id"""
SYNONYMS = "SELECT object_id AS id, base_object_name AS target FROM sys.synonyms"
BODIES = "SELECT object_id AS id, LEFT(definition, 50000) AS definition FROM sys.sql_modules"
HEALTH = """SELECT available_physical_memory_kb / 1048576 AS available, system_memory_state_desc AS state,
 (SELECT COUNT(*) FROM sys.dm_exec_query_memory_grants WHERE grant_time IS NULL) AS waiting,
 (SELECT CONVERT(int, process_physical_memory_low) FROM sys.dm_os_process_memory) AS low
 FROM sys.dm_os_sys_memory"""


def kind(code: Column) -> Column:
    return F.coalesce(*[F.when(T.trim(code) == c, F.lit(k)) for c, k in KINDS.items()])


def parse_manifest(cells: DataFrame) -> DataFrame:
    """Objects from rows (cells: schema, name, type, modified, rows, kb, triggers); short rows and unknown types are dropped."""
    c = [T.trim(F.col("cells")[i]) for i in range(7)]
    wide = cells.filter(F.size("cells") >= 7)
    rows = wide.select(c[0].alias("schema"), c[1].alias("name"), kind(c[2]).alias("kind"), T.number(c[4]).alias("rows"), T.number(c[5]).alias("kb"), T.number(c[6]).cast("int").alias("triggers"), c[3].alias("modified"))
    return rows.filter("kind is not null").withColumn("key", key())


class SqlServer:
    def __init__(self, read: Callable[..., DataFrame]) -> None:
        self.read = read

    def _objects(self) -> DataFrame:
        spaces = self.read(SCHEMAS).filter(~F.col("schema").isin(*EXCLUDED))
        return self.read(OBJECTS).join(spaces, "space").withColumn("key", key())

    def manifest(self) -> DataFrame:
        """Heap and clustered partitions alone count rows; all of them count pages of 8 KB."""
        own = T.number(F.col("index_id")) < 2
        stored = self.read(PARTITIONS).groupBy("id").agg(F.sum(F.when(own, T.number(F.col("row_count"))).otherwise(0)).alias("rows"), (F.sum(T.number(F.col("pages"))) * 8).alias("kb"))
        fired = self.read(TRIGGERS).groupBy("id").agg(F.count(F.lit(1)).alias("triggers"))
        joined = self._objects().join(stored, "id", "left").join(fired, "id", "left")
        text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("0"))
        return parse_manifest(joined.select(F.array("schema", "name", "code", "modified", text("rows"), text("kb"), text("triggers")).alias("cells"))).orderBy("schema", "name")

    def columns(self) -> DataFrame:
        each = self.read(COLUMNS).join(self._objects().select("id", "key"), "id")
        length = T.width(F.col("type"), F.col("size"), F.col("precision"), F.col("scale"))
        return each.select("key", T.number(F.col("num")).alias("ord"), "name", "type", length.alias("length"), *[T.flag(F.col(c)).alias(c) for c in ("nullable", "identity", "computed")])

    def indexes(self) -> DataFrame:
        names = self.read(COLUMNS).select("id", "num", F.col("name").alias("column"))
        each = self.read(INDEXES).join(self.read(INDEX_COLUMNS), ["id", "index_id"]).join(names, ["id", "num"]).join(self._objects().select("id", "key"), "id")
        return each.select("key", F.struct("index", T.number(F.col("at")).alias("at")).alias("ord"), "index", T.flag(F.col("primary")).alias("primary"), T.flag(F.col("unique")).alias("unique"), "column")

    def foreign_keys(self) -> DataFrame:
        names = self.read(COLUMNS).select("id", "num", "name")
        objects = self._objects().select("id", "key")
        near = names.select("id", "num", F.col("name").alias("column"))
        far = names.select(F.col("id").alias("other"), F.col("num").alias("other_num"), F.col("name").alias("target"))
        joined = self.read(REFERENCES).join(near, ["id", "num"]).join(far, ["other", "other_num"]).join(objects, "id").join(objects.select(F.col("id").alias("other"), F.col("key").alias("other_key")), "other")
        return joined.select("key", F.struct("column", "other_key", "target").alias("ord"), "column", F.concat_ws(".", "other_key", "target").alias("references"))

    def parameters(self) -> DataFrame:
        each = self.read(PARAMETERS).join(self._objects().select("id", "key"), "id")
        name = F.when(F.col("name") == "", F.lit(T.RETURNS)).otherwise(F.col("name"))
        rendered = F.concat(F.col("type"), T.width(F.col("type"), F.col("size"), F.lit("0"), F.lit("0")))
        return each.select("key", T.number(F.col("num")).alias("ord"), name.alias("name"), rendered.alias("type"), T.flag(F.col("output")).alias("output"))

    def targets(self) -> DataFrame:
        return self.read(SYNONYMS).join(self._objects().select("id", "key"), "id").select("key", "target")

    def modules(self, keys: DataFrame) -> DataFrame:
        """Definitions (key, definition), at most 50,000 characters, of the given keys."""
        named = self._objects().select("id", "key").join(keys.select("key"), "key", "left_semi")
        return guarded.definitions(self.read, BODIES, named)

    def health(self) -> DataFrame:
        row = self.read(HEALTH)
        return row.select(F.lit(True).alias("memory_visible"), F.col("available").try_cast("double").alias("available_gb"), "state", T.flag(F.col("low")).alias("memory_low"), T.number(F.col("waiting")).cast("int").alias("waiting")).filter("available_gb is not null")

    def sample(self, key: str, columns: list[str], n: int) -> list[list[str]]:
        return guarded.sample(self.read, "sqlserver", key, columns, n, T.CELL_CHARS)
