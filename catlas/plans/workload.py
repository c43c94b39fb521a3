"""A catalog made of the test tables, in expressions that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: name: (table, expressions, condition).
VIEWS: dict[str, tuple[str, list[str], str]] = {
    "objects": (
        "part",
        [
            "concat('app', cast(p_partkey % 7 as string)) as schema",
            "concat('obj', cast(p_partkey as string)) as name",
            "case when p_partkey % 11 = 0 then 'view' when p_partkey % 11 = 1 then 'procedure' when p_partkey % 11 = 2 then 'function' when p_partkey % 11 = 3 then 'synonym' else 'table' end as kind",
            "cast(p_size * (p_partkey % 13) as bigint) as rows",
            "cast(floor(p_retailprice * p_size * p_size) as bigint) as kb",
            "cast(p_partkey % 3 as int) as triggers",
            "case when p_partkey % 17 = 0 then '' else concat('2026-01-', cast(10 + p_size % 20 as string)) end as modified",
            "concat('app', cast(p_partkey % 7 as string), '.obj', cast(p_partkey as string)) as key",
            "p_partkey as pk",
        ],
        "true",
    ),
    "state": (
        "part",
        [
            "case when p_partkey % 23 = 5 then concat('old.obj', cast(p_partkey as string)) else concat('app', cast(p_partkey % 7 as string), '.obj', cast(p_partkey as string)) end as key",
            "'table' as kind",
            "case when p_partkey % 17 = 0 then '' when p_partkey % 6 = 0 then '2025-12-01' else concat('2026-01-', cast(10 + p_size % 20 as string)) end as modified",
            "substring(sha256_hex, 1, 16) as fingerprint",
            "case when p_partkey % 9 = 0 then '' else concat('Holds ', p_name, '.') end as description",
            "cast(p_size * (p_partkey % 13) + case when p_partkey % 8 = 0 then 3 else 0 end as bigint) as rows",
            "p_partkey as pk",
        ],
        "p_partkey % 4 <> 1",
    ),
    "columns": (
        "lineitem",
        [
            "concat('app', cast(l_partkey % 7 as string), '.obj', cast(l_partkey as string)) as key",
            "(l_orderkey * 10 + l_linenumber) * 1000000 + cast(floor(l_extendedprice) as bigint) % 1000000 as ord",
            "case when l_linenumber = 1 then 'Email' when l_linenumber = 2 then 'photo_blob' when l_linenumber = 3 then 'raw' else concat('col', cast(l_linenumber as string)) end as name",
            "case when l_linenumber = 3 then 'varbinary' when l_linenumber = 4 then 'varchar' else 'int' end as type",
            "case when l_linenumber = 4 then '(20)' else '' end as length",
            "l_returnflag = 'N' as nullable",
            "l_linenumber = 1 as identity",
            "l_linestatus = 'F' as computed",
            "l_partkey as pk",
        ],
        "true",
    ),
    "bodies": (
        "documents",
        [
            "concat('app.body', cast(doc_id as string)) as key",
            "concat(text, case when doc_id % 5 = 0 then concat(chr(13), chr(10), 'SET @DbPassword = ''x y''; exec app3.obj3', chr(9), ' ') else '' end, case when doc_id % 7 = 0 then concat(chr(10), 'Data Source=srv01;Initial Catalog=app; -- UPDATE app3.obj3 set api_key=abc123 Bearer abcdefghijklmnop', '  ') else '' end) as text",
            "doc_id",
        ],
        "true",
    ),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, expressions, where = VIEWS[name]
    spark_hash = "substring(sha2(p_name, 256), 1, 16) as fingerprint"
    used = [spark_hash if "sha256_hex" in e else e for e in expressions]
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").filter(where).selectExpr(*used)


def sql(name: str) -> str:
    table, expressions, where = VIEWS[name]
    used = [e.replace("sha256_hex", "sha256(p_name)") for e in expressions]
    return f"SELECT {', '.join(used)} FROM {table} WHERE {where}"


def with_views(text: str, *names: str) -> str:
    """`text` after the named views, as common table expressions."""
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({sql(n)})" for n in names) + text
