import json
import os
import re
from datetime import datetime, timezone
from urllib.parse import unquote

import pytest
from pyspark.sql import functions as F

from catlas.app import cache, cli, config, doctor, output
from catlas.operators import fetching, health
from catlas.plans import build as B
from catlas.schemas import OBJECT
from catlas.sources import guarded
from catlas.sources.tables import Tables
from catlas.streaming.manifests import plan_stream

NOW = datetime(2026, 3, 5, 9, 0, 0, tzinfo=timezone.utc)


class Fake:
    """Two tables, a procedure, a view and a synonym."""

    def __init__(self, spark, signal="2024-01-01", without=()):
        self.spark, self.signal, self.without, self.sampled = spark, signal, without, []

    def _df(self, rows, schema):
        return self.spark.createDataFrame(rows, schema)

    def manifest(self):
        rows = [("dbo", "Orders", "table", 4000, 900, 0), ("dbo", "OrderStatuses", "table", 11, 8, 0), ("dbo", "OrderGet", "procedure", 0, 0, 0), ("dbo", "OpenOrders", "view", 0, 0, 0), ("dbo", "OrderAlias", "synonym", 0, 0, 0)]
        kept = [(*r, self.signal) for r in rows if r[1] not in self.without]
        return self._df(kept, OBJECT).withColumn("key", F.concat_ws(".", "schema", "name"))

    def columns(self):
        rows = [("dbo.Orders", 0, "OrderID", True), ("dbo.Orders", 1, "StatusID", False), ("dbo.OrderStatuses", 0, "StatusID", False), ("dbo.OrderStatuses", 1, "Label", False), ("dbo.OpenOrders", 0, "OrderID", False)]
        return self._df([(k, o, n, "int", "", False, i, False) for k, o, n, i in rows], "key string, ord long, name string, type string, length string, nullable boolean, identity boolean, computed boolean")

    def indexes(self):
        return self._df([("dbo.Orders", 0, "pk", True, True, "OrderID")], "key string, ord long, index string, primary boolean, unique boolean, column string")

    def foreign_keys(self):
        return self._df([], "key string, ord long, column string, references string")

    def parameters(self):
        return self._df([("dbo.OrderGet", 1, "@id", "int", False)], "key string, ord long, name string, type string, output boolean")

    def targets(self):
        return self._df([("dbo.OrderAlias", "dbo.Orders")], "key string, target string")

    def modules(self, keys):
        rows = [("dbo.OrderGet", "SELECT * FROM dbo.Orders WHERE pwd = 'hush'"), ("dbo.OpenOrders", "SELECT OrderID FROM dbo.Orders")]
        return self._df(rows, "key string, definition string").join(keys.select("key"), "key", "left_semi")

    def health(self):
        return self._df([(False, 0.0, "primary", False, 0)], health.READING)

    def sample(self, key, columns, n):
        self.sampled.append(key)
        return [["1", "Pending"], ["2", "Shipped"]] if key == "dbo.OrderStatuses" else []


def teller(calls):
    def tell(prompt):
        calls.append(prompt)
        keys = re.findall(r"=== OBJECT \d+: (\S+) ===", prompt)
        return {"reply": json.dumps({"objects": [{"name": k.upper(), "sentence": f"Describes {k}."} for k in keys]}), "input tokens": 10, "output tokens": 5}

    return tell


def options(tmp_path, **change):
    return B.Options(**{"connection": "stage", "database": "core", "engine": "postgres", "out": str(tmp_path / "tree"), "now": NOW} | change)


def test_build_twice(spark, tmp_path):
    calls, source = [], Fake(spark)
    s = B.build(spark, source, teller(calls), options(tmp_path))
    home = tmp_path / "tree" / "stage" / "core"
    assert (s.objects, s.refetch, s.described, s.column_files, s.body_files) == (5, 5, 4, 3, 2)
    assert s.reasons == {"new": 5} and s.redactions == {"password": 1} and s.usage == {"input tokens": 10, "output tokens": 5}
    assert source.sampled == ["dbo.OrderStatuses", "dbo.Orders"] and len(calls) == 1 and "1\tPending" in calls[0]
    assert sorted(p.name for p in home.iterdir()) == ["bodies", "columns", "procedures.tsv", "synonyms.tsv", "tables.tsv", "views.tsv"]
    assert (home / "tables.tsv").read_text().split("\n")[2].startswith("dbo.Orders\t4000\t900 KB\t0\t2\t2024-01-01\t")
    assert "pwd = <redacted>" in (home / "bodies" / "dbo.OrderGet.sql").read_text()
    assert (tmp_path / "tree" / "databases.tsv").read_text().split("\n")[1] == "stage\tcore\tpostgres\t2\t1\t1\t0\t1\t2026-03-05T09:00:00Z"
    B.outcome(s)
    before = (home / "tables.tsv").read_text()
    again = B.build(spark, Fake(spark), teller(calls), options(tmp_path))
    assert (again.refetch, again.untouched, again.described, again.unchanged) == (0, 5, 0, 4) and len(calls) == 1
    assert (home / "tables.tsv").read_text() == before


def test_only_what_moved_is_read(spark, tmp_path):
    store = tmp_path / "store"
    B.build(spark, Fake(spark), teller([]), options(tmp_path, store=str(store)))
    home = tmp_path / "tree" / "stage" / "core"
    before = {p.name: p.read_text() for p in home.rglob("*.*") if p.is_file()}
    quiet = Fake(spark)
    for part in ("columns", "indexes", "foreign_keys", "parameters", "targets", "modules"):
        setattr(quiet, part, lambda *_, part=part: pytest.fail(f"asked for {part}"))
    s = B.build(spark, quiet, teller([]), options(tmp_path, store=str(store)))
    assert (s.read, s.reused, s.redactions) == (0, 5, {"password": 1})
    assert {p.name: p.read_text() for p in home.rglob("*.*") if p.is_file()} == before
    moved, asked = Fake(spark), []
    manifest, modules = moved.manifest, moved.modules
    moved.manifest = lambda: manifest().withColumn("modified", F.when(F.col("name") == "OrderGet", "2025-01-01").otherwise(F.col("modified")))
    moved.modules = lambda keys: asked.extend(r["key"] for r in keys.collect()) or modules(keys)
    s = B.build(spark, moved, teller([]), options(tmp_path, store=str(store)))
    assert (s.read, s.reused, asked) == (1, 4, ["dbo.OrderGet"])
    kept = fetching.Store(spark, str(store / "stage" / "core"))
    (store / "stage" / "core" / "pull-00000009").mkdir()  # left by a build that broke off
    assert {r["key"]: r["signal"] for r in kept.read().collect()}["dbo.OrderGet"] == "2025-01-01"
    rows = sorted(kept.read().drop("counts").collect())
    assert not kept.compact(moved.manifest()) and kept.compact(moved.manifest().filter("name <> 'OrderAlias'"), at=2)
    assert sorted(kept.read().drop("counts").collect()) == [r for r in rows if r["key"] != "dbo.OrderAlias"]
    assert [p.name for p in (store / "stage" / "core").iterdir()] == ["pull-00000010"]


def test_absent_signals_are_always_read(spark, tmp_path):
    B.build(spark, Fake(spark, ""), teller([]), options(tmp_path))
    s = B.build(spark, Fake(spark, ""), teller([]), options(tmp_path))
    assert (s.read, s.reused) == (5, 0)


def test_odd_keys_stay_in_the_tree():
    assert B.file_name("dbo.Order Lines") == "dbo.Order Lines" and B.file_name("a.../../b%\\") == "a...%2F..%2Fb%25%5C"
    assert all(unquote(B.file_name(k)) == k for k in ("dbo.Order Lines", "a.%2F", "a./\\\n%"))


def test_definitions_over_jdbc(spark, tmp_path):
    """A real driver: only the asked ids are sent for, some to a statement."""

    class Derby:
        def options(self, secret):
            return {"url": f"jdbc:derby:{tmp_path}/db;create=true", "driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}

    url = Derby().options("")["url"]
    spark.createDataFrame([(i, f"body {i}") for i in range(100)], "ID long, DEFINITION string").write.jdbc(url, "bodies", properties={"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"})
    read, sent = guarded.reader(spark, Derby(), ""), []
    named = spark.createDataFrame([(str(i), f"k{i}") for i in range(0, 99, 2)], "id string, key string")

    def noted(statement, conditions=()):
        sent.extend(conditions)
        return read(statement, conditions)

    statement = "SELECT id, definition FROM bodies"
    got = guarded.definitions(noted, statement, named)
    assert {r["key"]: r["definition"] for r in got.collect()} == {f"k{i}": f"body {i}" for i in range(0, 99, 2)}
    assert [c.count(",") + 1 for c in sent] == [40, 10] and "98" in sent[1]
    assert guarded.definitions(noted, statement, named.limit(0)).collect() == [] and len(sent) == 2
    with pytest.raises(guarded.Refused):
        read(statement, ["id IN (1); DROP TABLE bodies"])


def test_dropped_narrowed_and_dry(spark, tmp_path):
    calls = []
    B.build(spark, Fake(spark), teller(calls), options(tmp_path))
    home = tmp_path / "tree" / "stage" / "core"
    dry = B.build(spark, Fake(spark, "2025-01-01", ("OrderGet",)), teller(calls), options(tmp_path, dry_run=True))
    assert (dry.refetch, dry.dropped, len(calls)) == (4, ["dbo.OrderGet"], 1) and (home / "procedures.tsv").exists()
    s = B.build(spark, Fake(spark, "2025-01-01", ("OrderGet",)), teller(calls), options(tmp_path, match="statuses"))
    assert (s.objects, s.unchanged, s.described) == (1, 1, 0)
    assert not (home / "procedures.tsv").exists() and not (home / "bodies" / "dbo.OrderGet.sql").exists()
    lines = (home / "tables.tsv").read_text().split("\n")
    assert "\t2025-01-01\t" in lines[1] and "\t2024-01-01\t" in lines[2] and all(x.endswith(".") for x in lines[1:3])
    forced = B.build(spark, Fake(spark, "2025-01-01"), teller(calls), options(tmp_path, force=True, samples=0))
    assert (forced.described, forced.sampled) == (4, 0)


def test_failures_leave_the_tree_usable(spark, tmp_path):
    def broken(prompt):
        raise RuntimeError("no answer")

    s = B.build(spark, Fake(spark), broken, options(tmp_path))
    assert len(s.failed) == 1 and len(s.missing) == 4
    with pytest.raises(B.Incomplete):
        B.outcome(s)
    s = B.build(spark, Fake(spark), teller([]), options(tmp_path))
    assert (s.refetch, s.described) == (0, 4)


def test_unhealthy_source_is_not_asked(spark, tmp_path):
    source = Fake(spark)
    source.health = lambda: spark.createDataFrame([(True, 1.0, "", False, 0)], health.READING)
    source.manifest = lambda: pytest.fail("asked")
    with pytest.raises(health.Unhealthy):
        B.build(spark, source, teller([]), options(tmp_path))


def test_parquet_folder_as_catalog(spark, tmp_path):
    root = tmp_path / "data"
    spark.createDataFrame([(1, "a"), (2, "b")], "id long, Email string").write.parquet(str(root / "people.parquet"))
    source = Tables(spark, str(root), views={"ids": "SELECT id FROM people"}, signals={"people": "1", "ids": "1"})
    s = B.build(spark, source, teller([]), options(tmp_path, database="main"))
    assert (s.objects, s.described, s.sampled) == (2, 2, 1)
    text = (tmp_path / "tree" / "stage" / "main" / "columns" / "main.people.tsv").read_text()
    assert "id\tbigint\tnull\t\nEmail\tstring\tnull" in text


def test_stream_of_manifests(spark, tmp_path):
    folder, got = tmp_path / "in", []
    Fake(spark).manifest().write.parquet(str(folder / "a"))
    state = spark.createDataFrame([("dbo.Orders", "table", "2024-01-01", "", "", 4000)], "key string, kind string, modified string, fingerprint string, description string, rows bigint")
    q = plan_stream(spark, str(folder / "*"), lambda: state, lambda df, n: got.extend(r["action"] for r in df.collect()), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert sorted(set(got)) == ["dropped", "fetch", "reuse"] or sorted(set(got)) == ["fetch", "reuse"]


def test_guarded_reads():
    guarded.assert_read("WITH a AS (SELECT 1) SELECT 'drop' FROM a /* call */")
    guarded.assert_read("SELECT TOP (5) [Call], [Create Date], [a]]; drop] FROM [dbo].[Update]")
    guarded.assert_read(guarded.sample_sql("sqlserver", "dbo", "Insert Into", ["Delete", "Exec]x"], 5, 20))
    for bad in ("DELETE FROM a", "SELECT 1; DROP TABLE a", "SELECT * INTO b FROM a", "EXEC p", "SELECT [a] FROM b; DELETE FROM [c]", "SELECT [a]] FROM b] FROM c; DROP TABLE d", "SELECT 1 /* ' */; DROP TABLE a --'"):
        with pytest.raises(guarded.Refused):
            guarded.assert_read(bad)
    from catlas.sources import postgres, sqlserver

    for module in (postgres, sqlserver):
        for name, value in vars(module).items():
            if name.isupper() and isinstance(value, str):
                guarded.assert_read(value)
                assert "ORDER BY 1" not in value
    for engine in ("postgres", "sqlserver"):
        sql = guarded.assert_read(guarded.sample_sql(engine, "a", 'b"]', ["c"], 25, 200))
        assert "ORDER" not in sql and ("LIMIT 25" in sql or "TOP (25)" in sql) and ('"b""]"' in sql or '[b"]]]' in sql)
    assert guarded.sample(lambda s: pytest.fail("sent"), "postgres", "a.b", [], 25, 200) == []
    assert guarded.literals(["a'b", "c"]) == "'a''b', 'c'"


def test_urls_and_errors():
    pg = guarded.Connection("postgres", "h", "db", username="u", params={"sslmode": "disable", "readOnly": "false"})
    assert pg.url().startswith("jdbc:postgresql://h:5432/db?") and "readOnly=true" in pg.url()
    assert "verify-full" in guarded.Connection("postgres", "h").url() and "default_transaction_read_only" in pg.options("s")["sessionInitStatement"]
    ms = guarded.Connection("sqlserver", "h", "d b", auth="kerberos", params={"applicationIntent": "ReadWrite"})
    assert "applicationIntent=ReadOnly" in ms.url() and "databaseName={d b}" in ms.url() and "password" not in ms.options("")
    assert "hush" not in guarded.scrub("x hush; password=hush", "hush")
    assert guarded.explain("KDC_ERR_WRONG_REALM").kind == "auth" and guarded.explain("timeout").kind == "unavailable"


def test_config(tmp_path):
    c = config.Config.load(tmp_path / "c.json")
    c.add("connection", "pg", {"engine": "postgres", "host": "h", "auth": "scram"})
    c.add("backend", "b", {"provider": "command", "model": "x"})
    c.add("profile", "p", {"connection": "pg", "backend": "b", "output": "json"})
    c.set("current_profile", "p")
    c.save()
    c = config.Config.load(tmp_path / "c.json")
    assert (tmp_path / "c.json").stat().st_mode & 0o777 == 0o600
    assert c.value("output", None, {}) == "json" and c.value("output", "table", {}) == "table" and c.value("output", None, {"CATLAS_OUTPUT": "table"}) == "table"
    with pytest.raises(config.InUse):
        c.remove("connection", "pg")
    c.remove("connection", "pg", force=True)
    c.remove("profile", "p")
    assert c.settings["current_profile"] == ""
    for kind, name, record in (("connection", "-x", {}), ("connection", "x", {"engine": "oracle"}), ("connection", "x", {"engine": "postgres", "host": "h", "auth": "sql"}), ("backend", "x", {"provider": "y"}), ("connection", "x", {"engine": "postgres", "host": "h", "auth": "scram", "port": 70000})):
        with pytest.raises(config.Invalid):
            c.add(kind, name, record)
    with pytest.raises(config.NotFound):
        c.set("colour", "x")
    with pytest.raises(config.NotFound):
        config.secret("connection", "pg", {})
    assert config.secret("connection", "pg-1", {"CATLAS_CONNECTION_PG_1_SECRET": "s"}) == "s"


def test_answers_are_cached_checked_and_metered(tmp_path):
    calls, spent = [], {}

    def tell(prompt):
        calls.append(prompt)
        if len(calls) == 1:
            raise OSError("once")
        return {"reply": "{}", "tokens": 7}

    ask = cache.cached(cache.retried(cache.metered(tell, spent), wait=0), tmp_path)
    assert ask("q")["tokens"] == 7 and ask("q") == {"reply": "{}", "tokens": 0}
    assert spent == {"tokens": 7} and len(calls) == 2
    (path,) = tmp_path.iterdir()
    path.write_text(path.read_text().replace("{}", "[]"))
    assert ask("q")["tokens"] == 7
    assert cache.segment(".a/b C") == "%2Ea%2Fb%20C" and cache.segment("") == "%00" and cache.file_name("A") != cache.file_name("a")
    cache.write(tmp_path / "f", "k", "s", [1])
    assert cache.read(tmp_path / "f", "k", "s") == [1] and cache.read(tmp_path / "f", "k", "t") is None and cache.read(tmp_path / "f", "k", "") is None


def test_doctor(spark):
    record = {"engine": "postgres", "host": "h", "auth": "scram"}
    good = lambda r, s: Fake(spark)
    rows, error = doctor.run("pg", record, good, {"CATLAS_CONNECTION_PG_SECRET": "s"})
    assert [r[1] for r in rows] == ["ok"] * 5 and error is None

    def bad(r, s):
        raise guarded.ConnectError("no", "auth")

    rows, error = doctor.run("pg", record, bad, {"CATLAS_CONNECTION_PG_SECRET": "s"})
    assert [r[1] for r in rows] == ["ok", "failed", "skipped", "skipped", "skipped"] and output.exit_code(error) == output.AUTH
    rows, error = doctor.run("pg", record, good, {})
    assert rows[0][1] == "failed" and output.exit_code(error) == output.NOT_FOUND


def test_command_line(spark, tmp_path, capsys):
    run = lambda *a: cli.main(["--config", str(tmp_path / "c.json"), "--quiet", *a])
    assert run("connection", "add", "data", "--engine", "spark", "--host", "/root/testdata/sf0.001", "--database", "main") == 0
    assert run("connection", "add", "bad", "--engine", "spark") == output.VALIDATION
    assert run("connection", "show", "none") == output.NOT_FOUND
    assert run("connection", "add", "gone", "--engine", "spark", "--host", str(tmp_path / "none")) != 0 and run("connection", "show", "gone") == output.NOT_FOUND
    assert run("connection", "add", "gone", "--engine", "spark", "--host", str(tmp_path / "none"), "--no-verify") == 0
    echo = tmp_path / "echo.sh"
    echo.write_text("#!/bin/sh\necho '{\"objects\": []}'\n")
    echo.chmod(0o755)
    assert run("backend", "add", "told", "--provider", "command", "--model", str(echo)) == 0
    assert run("backend", "add", "mute", "--provider", "command", "--model", str(tmp_path / "none")) != 0 and run("backend", "show", "mute") == output.NOT_FOUND
    assert run("config", "set", "output", "json") == 0
    capsys.readouterr()
    assert run("index", "data", "--dry-run", "--out", str(tmp_path / "tree")) == 0
    tables = sum(n.endswith(".parquet") for n in os.listdir("/root/testdata/sf0.001"))
    assert json.loads(capsys.readouterr().out)["reasons"] == f"new {tables}"
    assert run("-o", "table", "doctor", "data") == 0
    assert "room for a build" in capsys.readouterr().out
    assert output.table(["a", "b"], [["x", None], [1, True]], "table").split("\n") == ["a  b", "x", "1  true"]
