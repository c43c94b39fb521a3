"""The data model as Spark types, and the kinds of objects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMN = "struct<name:string,type:string,length:string,nullable:boolean,identity:boolean,computed:boolean>"
INDEX = "struct<name:string,unique:boolean,columns:array<string>>"
FOREIGN_KEY = "struct<column:string,references:string>"
PARAM = "struct<name:string,type:string,output:boolean>"
STRUCTURE = f"struct<columns:array<{COLUMN}>,primary_key:array<string>,foreign_keys:array<{FOREIGN_KEY}>,indexes:array<{INDEX}>,parameters:array<{PARAM}>,definition:string,target:string>"
OBJECT = "schema string, name string, kind string, rows bigint, kb bigint, triggers int, modified string"
STATE = "key string, kind string, modified string, fingerprint string, description string, rows bigint"

#: kind: (does a build describe it, has it a body).
KINDS = {"table": (True, False), "view": (True, True), "procedure": (True, True), "function": (True, True), "synonym": (False, False)}
DESCRIBABLE = tuple(k for k, (d, _) in KINDS.items() if d)
MODULES = tuple(k for k, (_, m) in KINDS.items() if m)


def key() -> Column:
    return F.concat_ws(".", "schema", "name")


def kinds(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, d, m) for k, (d, m) in KINDS.items()], "kind string, describe boolean, module boolean")


def same_signal(a: Column, b: Column) -> Column:
    """An absent signal, empty or null, equals nothing, not even another absent one."""
    return F.coalesce((a != "") & (a == b), F.lit(False))
