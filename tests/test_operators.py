import pytest
from pyspark.sql import functions as F

from catlas.operators import catalogs, describing, health, planning, reading, sampling, structure
from catlas.schemas import STATE, kinds
from catlas.sources import postgres, sqlserver

D, O = "2026-02-14T09:00:00", "2024-07-25T09:00:00"
OBJECT = "key string, schema string, name string, kind string, rows bigint, modified string"

PLANS = [
    ("table", D, 5000, None, "new"), ("table", D, 5000, (D, 5000), None), ("procedure", D, 0, (O, 0), "modified"), ("procedure", "", 0, ("", 0), "modified"),
    ("table", D, 50000, (D, 0), "sample"), ("table", D, 9, (D, 8), "sample"), ("table", D, 60, (D, 40), None), ("table", D, 617802364, (D, 616802364), None),
    ("table", D, 10, (D, 5000), "sample"), ("table", D, 200, (D, 0), "sample"), ("procedure", D, 900, (D, 0), None), ("view", D, 900, (D, 0), None), ("view", None, 1, (None, 1), "modified"),
]


def objects(spark, rows):
    return spark.createDataFrame([(f"app.o{i}", "app", f"o{i}", *r) for i, r in enumerate(rows)], OBJECT)


def test_fetch_plan(spark):
    now = objects(spark, [(k, n, m) for k, m, n, _, _ in PLANS])
    before = [(f"app.o{i}", k, s[0], "", "", s[1]) for i, (k, _, _, s, _) in enumerate(PLANS) if s]
    state = spark.createDataFrame([*before, ("app.gone2", "table", D, "", "", 1), ("app.gone1", "view", D, "", "", 1)], STATE)
    got = {r["key"]: (r["action"], r["reason"]) for r in planning.fetch_plan(now, state).collect()}
    for i, (*_, reason) in enumerate(PLANS):
        assert got.pop(f"app.o{i}") == (("fetch", reason) if reason else ("reuse", None))
    assert got == {"app.gone1": ("dropped", None), "app.gone2": ("dropped", None)}
    assert [r["key"] for r in planning.dropped(now, state).collect()] == ["app.gone1", "app.gone2"]
    counts = {r["reason"]: r["n"] for r in planning.reason_counts(now, planning.fetch_plan(now, state)).collect()}
    assert counts == {"new": 1, "modified": 3, "sample": 4}
    assert planning.reasons_text(counts) == "new 1, modified 3, sample 4" and planning.reasons_text({}) == "none"


def test_describe_plan(spark):
    fetched = spark.createDataFrame([(k, "table", "aa") for k in "abcd"] + [("s", "synonym", "aa")], "key string, kind string, fingerprint string")
    state = spark.createDataFrame([("a", "table", D, "aa", "Says.", 1), ("b", "table", D, "bb", "Says.", 1), ("c", "table", D, "aa", "", 1)], STATE)
    plan = planning.describe_plan(fetched, state)
    assert {r["key"]: r["action"] for r in plan.collect()} == {"a": "unchanged", "b": "describe", "c": "describe", "d": "describe", "s": "describe"}
    assert planning.describable(plan).filter("key = 's'").count() == 0


def test_narrow(spark):
    rows = spark.createDataFrame([("dbo.Orders", "dbo", "Orders"), ("sales.Invoice", "sales", "Invoice"), ("dbo.OrderStatuses", "dbo", "OrderStatuses")], "key string, schema string, name string")
    keys = lambda *a: sorted(r["key"] for r in planning.narrow(rows, *a).collect())
    assert keys("ORDER") == ["dbo.OrderStatuses", "dbo.Orders"] and keys("", 1) == ["dbo.OrderStatuses"] and len(keys()) == 3 and keys("x.y") == []


def test_cache_needs_the_same_present_signal(spark):
    now = spark.createDataFrame([("a", D), ("b", O), ("c", ""), ("d", None)], "key string, modified string")
    held = spark.createDataFrame([("a", D), ("a", D), ("b", D), ("c", ""), ("d", None)], "key string, signal string")
    assert {r["key"]: r["hit"] for r in planning.cache_hits(now, held).collect()} == {"a": True, "b": False, "c": False, "d": False}


@pytest.mark.parametrize(("n", "sizes"), [(80, [40, 40]), (85, [40, 40, 5]), (7, [7]), (0, [])])
def test_key_batches(spark, n, sizes):
    got = planning.key_batches(spark.createDataFrame([(f"{i:03}",) for i in range(n)], "key string")).groupBy("batch").count().orderBy("batch").collect()
    assert [r["count"] for r in got] == sizes


@pytest.mark.parametrize(("costs", "want"), [([30000] * 3, [0, 1, 2]), ([10] * 15, [0] * 12 + [1] * 3), ([10, 80000, 10], [0, 1, 2]), ([], []), ([40000, 1], [0, 1])])
def test_cost_batches(spark, costs, want):
    items = spark.createDataFrame([(i, str(i), c) for i, c in enumerate(costs)], "ord long, key string, cost long")
    assert [r["batch"] for r in describing.batches(items).orderBy("ord").collect()] == want


def test_index_fold(spark):
    rows = [(1, "pkOrders", True, True, "OrderID"), (2, "pkOrders", True, True, "LineID"), (3, "ixCustomer", False, False, "CustomerID"), (4, "ixCustomer", False, False, "Modified"), (5, "ixCode", False, True, "Code")]
    df = spark.createDataFrame([("app.Orders", *r) for r in reversed(rows)], "key string, ord int, index string, primary boolean, unique boolean, column string")
    row = structure.fold_indexes(df).first()
    assert row["primary_key"] == ["OrderID", "LineID"]
    assert [(i["name"], i["unique"], i["columns"]) for i in row["indexes"]] == [("ixCustomer", False, ["CustomerID", "Modified"]), ("ixCode", True, ["Code"])]


def test_sample_plans_and_order(spark):
    schema = "key string, kind string, rows bigint, columns array<struct<name:string,type:string>>"
    rows = [
        ("dbo.HugeLog", "table", 616802364, [("Id", "int")]), ("dbo.OrderStatuses", "table", 11, [("Id", "int")]), ("dbo.BigAudit", "table", 33490305, [("Id", "int")]), ("dbo.OrderTypes", "table", 15, [("Id", "int")]),
        ("dbo.Customers", "table", 26, [("CustomerID", "int"), ("Email", "nvarchar"), ("Raw", "VARBINARY"), ("PhotoBin", "image")]), ("dbo.People", "table", 1, [("Email", "text"), ("Phone", "text")]), ("dbo.V", "view", 1, [("Id", "int")]),
    ]
    plans = sampling.project(spark.createDataFrame(rows, schema))
    by = {r["key"]: r for r in plans.select("*", sampling.withheld_note(F.col("withheld")).alias("note")).collect()}
    assert set(by) == {"dbo.HugeLog", "dbo.OrderStatuses", "dbo.BigAudit", "dbo.OrderTypes", "dbo.Customers"}
    assert by["dbo.Customers"]["readable"] == ["CustomerID"]
    assert by["dbo.Customers"]["note"] == "# not sampled (pii): Email, PhotoBin\n# not sampled (unsampleable): Raw"
    order = [r["key"] for r in sampling.order(plans).orderBy("place").collect()]
    assert order == ["dbo.OrderStatuses", "dbo.OrderTypes", "dbo.Customers", "dbo.BigAudit", "dbo.HugeLog"]
    assert [(r["key"], r["place"], r["of"]) for r in sampling.order(plans, 2).orderBy("place").collect()] == [("dbo.OrderStatuses", 1, 2), ("dbo.OrderTypes", 2, 2)]


def test_sample_rendering(spark):
    schema = "c array<string>, v array<array<string>>, w array<struct<column:string,reason:string>>"
    rows = [(["a", "b"], [["1", "x\ty"], ["2", ""]], [("Email", "pii")]), ([], [], []), (["a"], [], [])]
    df = spark.createDataFrame(rows, schema)
    got = [r["s"] for r in df.select(sampling.render(F.col("c"), F.col("v"), F.col("w")).alias("s")).collect()]
    assert got == ["a\tb\n1\tx y\n2\t\n# not sampled (pii): Email", "", "a"]
    table = spark.createDataFrame([(1, None, "q")], "`a``b` int, c string, d string")
    assert sampling.rows(table, ["a`b", "c"], 5) == [["1", ""]] and sampling.rows(table, []) == [] and sampling.rows(table, ["c"], 0) == []


def test_answers(spark):
    asked = spark.createDataFrame([(0, "dbo.Orders"), (0, "dbo.OrderStatuses"), (0, "hr.Orders"), (1, "dbo.Alone")], "batch long, key string")
    reply = '{"objects":[{"name":" DBO.ORDERS ","sentence":" One. "},{"name":"OrderStatuses","sentence":"Two."},{"name":"Orders","sentence":"Three."},{"name":"Alone","sentence":"x"},{"name":"dbo.OrderStatuses","sentence":""}]}'
    replies = spark.createDataFrame([(0, reply)], "batch long, reply string")
    got = describing.resolve(describing.answers(replies), asked)
    assert {r["key"]: r["sentence"] for r in got.collect()} == {"dbo.Orders": "One.", "dbo.OrderStatuses": "Two."}
    assert sorted(r["key"] for r in describing.missing(asked, got).collect()) == ["dbo.Alone", "hr.Orders"]
    with pytest.raises(Exception, match="(?i)malformed"):
        describing.answers(spark.createDataFrame([(0, "{no")], "batch long, reply string")).collect()


def test_prompt_bodies(spark):
    df = spark.createDataFrame([("",), (" x ",), ("y" * 16_001,)], "d string")
    got = [r["b"] for r in df.select(describing.body(F.col("d")).alias("b")).collect()]
    assert got == [describing.NO_BODY, "x", "y" * 16_000 + describing.CUT]


def test_merge_keeps_what_a_build_did_not_look_at(spark):
    row = lambda k, fp: (k, "table", [k, "1", "8 KB", "0", "1", "", fp, "d"])
    schema = "key string, kind string, cells array<string>"
    old = spark.createDataFrame([row("dbo.Orders", "aa"), row("dbo.Customers", "bb"), row("dbo.Legacy", "cc")], schema)
    merged = catalogs.merge(old, spark.createDataFrame([row("dbo.Orders", "dd")], schema), spark.createDataFrame([("dbo.Legacy",)], "key string"))
    assert [(r["key"], r["cells"][6]) for r in merged.collect()] == [("dbo.Customers", "bb"), ("dbo.Orders", "dd")]


def test_catalogs_are_read_tolerantly(spark):
    lines = ["name\trows\tsize\ttriggers\tcols\tmodified\tfingerprint\tdescription", "# note", "", "a.b\t5\t8 KB\t0\t1\t2026\tff", "a.c\tx\t8 KB\t0\t1\t\tee\tSays.", "short\t1"]
    rows = catalogs.parse_rows(spark.createDataFrame([(x,) for x in lines], "value string"), "table")
    got = [tuple(r) for r in catalogs.parse_state(rows, "table").orderBy("key").collect()]
    assert got == [("a.b", "table", "2026", "ff", "", 5), ("a.c", "table", "", "ee", "Says.", 0)]


def test_positive_counts(spark):
    cells = ["stage", "core", "x", "380", "0", "n/a", "", "8", "2026"]
    df = spark.createDataFrame([(cells,)], "cells array<string>")
    assert df.select(catalogs.positive_counts(F.col("cells")).alias("c")).first()["c"] == {"tables": 380.0, "synonyms": 8.0}


def test_health(spark):
    bad = spark.createDataFrame([(True, 1.0, "ok", False, 0)], health.READING)
    with pytest.raises(health.Unhealthy, match="only 1 GB"):
        health.require(bad, "sampling")
    with pytest.raises(health.Unhealthy, match="could not be read"):
        health.require(bad.limit(0), "sampling")
    health.require(spark.createDataFrame([(False, 0.0, "primary", False, 5)], health.READING), "sampling")


def test_reading(spark):
    bodies = spark.createDataFrame([("p1", "UPDATE x\n SET a=1 FROM dbo.Orders"), ("p2", "insert into\tdbo.orders values"), ("p3", "delete from a; select * from dbo.Orders"), ("p4", "dboxOrders update dboxOrders")], "key string, text string")
    assert sorted(r["key"] for r in reading.mentions(bodies, "dbo.Orders").collect()) == ["p1", "p3"]
    assert sorted(r["key"] for r in reading.writers(bodies, "dbo.Orders").collect()) == ["p2"]
    rows = spark.createDataFrame([(0, "a", "A", "2026-01-01T00:00:00Z"), (1, "a", "B", "2025-11-02T00:00:00Z"), (2, "b", "C", "soon")], "pos int, connection string, database string, built string")
    assert reading.oldest_build(rows).first()["database"] == "B"
    assert reading.oldest_build(rows.filter("pos = 2")).count() == 0


def test_reminder(spark):
    schema = "pos int, name string, remote boolean, present boolean, hours double, connection string, database string, built string, age string"
    rows = [(0, "one", False, True, 30.0, "a", "A", "2026-01-01T00:00:00Z", "1 day"), (1, "two", False, True, 300.0, "b", "B", "2025-12-01T00:00:00Z", "12 days"), (2, "gone", False, False, 999.0, None, None, None, None)]
    df = spark.createDataFrame(rows, schema)
    assert reading.reminder(df, 100) == "b/B was last indexed 12 days ago (2025-12-01)"
    assert reading.reminder(df, 400) is None
    assert reading.reminder(df.withColumn("remote", F.lit(True)), 1) == "the gone index has not been fetched yet"


def text(spark, rows, names):
    return spark.createDataFrame(rows, ", ".join(f"`{n}` string" for n in names.split()))


def _picked(df, conditions):
    """What a server sends: the rows of any of the conditions, or all without one."""
    return df.filter(" OR ".join(f"({c})" for c in conditions)) if conditions else df


def test_postgres_structures(spark):
    frames = {
        postgres.NAMESPACES: text(spark, [("1", "app"), ("2", "pg_catalog"), ("3", "pg_temp_1")], "id schema"),
        postgres.RELATIONS: text(spark, [("10", "1", "orders", "r", "1100", "16"), ("11", "1", "order_list", "v", "0", "0"), ("12", "1", "orders_pkey", "i", "0", "0"), ("13", "1", "ix", "i", "0", "0"), ("14", "1", "customers", "r", "-1", "8"), ("15", "2", "pg_class", "r", "9", "9"), ("16", "3", "t", "r", "9", "9")], "id space name code tuples kb"),
        postgres.TRIGGERS: text(spark, [("10",), ("10",)], "relation"),
        postgres.ROUTINES: text(spark, [("21", "1", "order_get", "f", "text", "", "", ""), ("20", "1", "order_get", "f", "integer", "integer\x1ftext", "p_id\x1f", "i\x1fo")], "id space name code returned types names modes"),
        postgres.ATTRIBUTES: text(spark, [("10", "1", "id", "integer", "1", "", ""), ("10", "2", "code", "character varying(20)", "0", "", ""), ("10", "3", "customer_id", "integer", "0", "d", "s"), ("14", "1", "id", "integer", "1", "", "")], "relation num name rendered required identity generated"),
        postgres.DEFAULTS: text(spark, [("10", "1", "nextval('s')")], "relation num expression"),
        postgres.INDEXES: text(spark, [("12", "10", "1", "1", "1", "1"), ("13", "10", "0", "0", "2 1 3", "2")], "id relation primary unique nums parts"),
        postgres.REFERENCES: text(spark, [("10", "14", "fk", "3", "1")], "relation other name nums others"),
        postgres.VIEW_BODIES: text(spark, [("11", "SELECT 1")], "id definition"),
        postgres.ROUTINE_BODIES: text(spark, [("20", "BEGIN END"), ("21", "other")], "id definition"),
        postgres.HEALTH: text(spark, [("primary", "3")], "state waiting"),
    }
    source = postgres.Postgres(lambda statement, conditions=(): _picked(frames[statement], conditions))
    manifest = source.manifest()
    assert [(r["key"], r["kind"], r["rows"], r["kb"], r["triggers"]) for r in manifest.collect()] == [("app.customers", "table", 0, 8, 0), ("app.order_get", "function", 0, 0, 0), ("app.order_list", "view", 0, 0, 0), ("app.orders", "table", 1100, 16, 2)]
    modules = source.modules(manifest.filter("kind <> 'table'"))
    folded = {r["key"]: r["structure"] for r in structure.structures(manifest, source.columns(), source.indexes(), source.foreign_keys(), source.parameters(), modules, source.targets()).collect()}
    orders = folded["app.orders"]
    assert [tuple(c) for c in orders["columns"]] == [("id", "integer", "", False, True, False), ("code", "character varying", "(20)", True, False, False), ("customer_id", "integer", "", True, True, True)]
    assert orders["primary_key"] == ["id"] and [tuple(i) for i in orders["indexes"]] == [("ix", False, ["code", "id"])]
    assert [tuple(f) for f in orders["foreign_keys"]] == [("customer_id", "app.customers.id")]
    assert [tuple(p) for p in folded["app.order_get"]["parameters"]] == [("(returns)", "integer", False), ("p_id", "integer", False), ("$2", "text", True)]
    assert folded["app.order_get"]["definition"] == "BEGIN END" and folded["app.order_list"]["definition"] == "SELECT 1"
    health.require(source.health(), "x")


def test_sqlserver_structures(spark):
    frames = {
        sqlserver.SCHEMAS: text(spark, [("1", "app"), ("2", "cdc")], "space schema"),
        sqlserver.OBJECTS: text(spark, [("10", "1", "Orders", "U ", D), ("11", "1", "OrderGet", "P", D), ("12", "1", "Ledger", "SN", D), ("13", "1", "Tr", "TR", D), ("14", "2", "x", "U", D), ("15", "1", "Customers", "U", D)], "id space name code modified"),
        sqlserver.PARTITIONS: text(spark, [("10", "1", "11", "2"), ("10", "2", "11", "1")], "id index_id row_count pages"),
        sqlserver.TRIGGERS: text(spark, [("10",)], "id"),
        sqlserver.COLUMNS: text(spark, [("10", "1", "OrderID", "int", "4", "10", "0", "0", "1", "0"), ("10", "2", "Code", "nvarchar", "20", "0", "0", "1", "0", "0"), ("15", "1", "CustomerID", "int", "4", "10", "0", "0", "0", "0")], "id num name type size precision scale nullable identity computed"),
        sqlserver.INDEXES: text(spark, [("10", "1", "pkOrders", "1", "1"), ("10", "2", "ixCode", "0", "1")], "id index_id index primary unique"),
        sqlserver.INDEX_COLUMNS: text(spark, [("10", "1", "1", "1"), ("10", "2", "2", "1"), ("10", "2", "1", "2")], "id index_id num at"),
        sqlserver.REFERENCES: text(spark, [("10", "2", "15", "1")], "id num other other_num"),
        sqlserver.PARAMETERS: text(spark, [("11", "0", "", "int", "4", "0"), ("11", "1", "@id", "nvarchar", "-1", "1")], "id num name type size output"),
        sqlserver.SYNONYMS: text(spark, [("12", "other.dbo.Ledger")], "id target"),
        sqlserver.BODIES: text(spark, [("11", "SELECT 1")], "id definition"),
        sqlserver.HEALTH: text(spark, [("64", "memory is available", "0", "0")], "available state waiting low"),
    }
    source = sqlserver.SqlServer(lambda statement, conditions=(): _picked(frames[statement], conditions))
    manifest = source.manifest()
    assert [(r["key"], r["kind"], r["rows"], r["kb"], r["triggers"], r["modified"]) for r in manifest.collect()] == [("app.Customers", "table", 0, 0, 0, D), ("app.Ledger", "synonym", 0, 0, 0, D), ("app.OrderGet", "procedure", 0, 0, 0, D), ("app.Orders", "table", 11, 24, 1, D)]
    folded = {r["key"]: r["structure"] for r in structure.structures(manifest, source.columns(), source.indexes(), source.foreign_keys(), source.parameters(), source.modules(manifest), source.targets()).collect()}
    assert [tuple(c)[:3] for c in folded["app.Orders"]["columns"]] == [("OrderID", "int", ""), ("Code", "nvarchar", "(10)")]
    assert folded["app.Orders"]["primary_key"] == ["OrderID"] and [tuple(i) for i in folded["app.Orders"]["indexes"]] == [("ixCode", True, ["Code", "OrderID"])]
    assert [tuple(f) for f in folded["app.Orders"]["foreign_keys"]] == [("Code", "app.Customers.CustomerID")]
    assert [tuple(p) for p in folded["app.OrderGet"]["parameters"]] == [("(returns)", "int", False), ("@id", "nvarchar(max)", True)]
    assert folded["app.Ledger"]["target"] == "other.dbo.Ledger"
    health.require(source.health(), "x")


def test_kinds(spark):
    assert kinds(spark).filter("describe and not module").select("kind").collect()[0]["kind"] == "table"
