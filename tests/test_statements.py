"""Guarded statements over a real DB-API driver: what it gets, in which order, and that nothing is written."""

import dataclasses
import json
import sqlite3
import subprocess
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from catlas.app import cli, output
from catlas.sources import guarded, statements

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks get what is defined here by value


class Noted:
    """A cursor or connection of sqlite3 that notes each call and leaves out what SQLite has no words for."""

    def __init__(self, raw, path):
        self.raw, self.path = raw, path

    def _note(self, line):
        with open(self.path, "a") as f:
            f.write(json.dumps(line) + "\n")

    def cursor(self):
        return Noted(self.raw.cursor(), self.path)

    def execute(self, text, parameters=()):
        self._note([text, list(parameters)])
        if not text.startswith("SET "):
            self.raw.execute(text.replace("OPTION (MAXDOP 1, MAX_GRANT_PERCENT = 1)", ""), parameters)
        return self

    def rollback(self):
        self._note("rollback")
        self.raw.rollback()

    def __getattr__(self, name):
        return getattr(self.raw, name)


def embedded(path, log):
    def connect(connection, secret):
        raw = sqlite3.connect(path)
        raw.execute("PRAGMA query_only = ON")  # SQLite's read-only session
        return Noted(raw, log), sqlite3.paramstyle

    class Embedded(statements.Statements):
        pass

    Embedded.connect = staticmethod(connect)
    return Embedded


@pytest.fixture
def place(tmp_path):
    db = sqlite3.connect(tmp_path / "db")
    db.execute("CREATE TABLE bodies (id INTEGER, definition TEXT)")
    db.executemany("INSERT INTO bodies VALUES (?, ?)", [(k, f"body {k}" if k % 7 else None) for k in range(100)])
    db.commit()
    return str(tmp_path / "db"), str(tmp_path / "log")


def noted(log):
    with open(log) as f:
        return [json.loads(x) for x in f]


@pytest.mark.parametrize("engine", ["sqlserver", "postgres"])
def test_a_driver_gets_the_statement_as_it_is(spark, place, engine):
    path, log = place
    read = statements.reader(spark, guarded.Connection(engine, "h"), "hush", embedded(path, log))
    statement = "SELECT id, definition, 100 % 7 AS rest FROM bodies WHERE definition <> '100%?' OR definition IS NULL;"
    rows = read(statement).collect()
    assert len(rows) == 100 and rows[0].asDict() == {"id": "0", "definition": "", "rest": "2"}
    got = noted(log)
    guard = statements.GUARDS[engine]
    sent = statement[:-1] + "\n" + guard.suffix if guard.suffix else statement
    each = [[line, []] for line in guard.session] + [[sent, []], "rollback"]
    assert got == each * 2  # once for the names, once for the rows
    assert sent.endswith("OPTION (MAXDOP 1, MAX_GRANT_PERCENT = 1)") == (engine == "sqlserver")


def test_keys_are_bound_some_to_a_statement(spark, place):
    path, log = place
    read = statements.reader(spark, guarded.Connection("sqlserver", "h"), "", embedded(path, log))
    named = spark.createDataFrame([(str(i), f"k{i}") for i in range(0, 99, 2)], "id string, key string")
    got = guarded.definitions(read, "SELECT id, definition FROM bodies", named)
    assert got.rdd.getNumPartitions() > 0
    assert {r["key"]: r["definition"] for r in got.collect()} == {f"k{i}": f"body {i}" if i % 7 else "" for i in range(0, 99, 2)}
    sent = [x for x in noted(log) if isinstance(x, list) and x[1]]
    assert all("IN (?, ?" in text and text.endswith(statements.GUARDS["sqlserver"].suffix) for text, _ in sent)
    assert sorted({len(p) for _, p in sent}) == [10, 40] and sorted({i for _, p in sent for i in p}) == list(range(0, 99, 2))
    assert read("SELECT id FROM bodies", [f"id = {k}" for k in range(9)]).rdd.getNumPartitions() <= guarded.OPEN_CONNECTIONS


def test_writes_fail_twice_over(spark, place):
    path, log = place
    read = statements.reader(spark, guarded.Connection("postgres", "h"), "hush", embedded(path, log))
    with pytest.raises(guarded.Refused):
        read("DELETE FROM bodies")
    raw, style = embedded(path, log).connect(None, "")
    with pytest.raises(sqlite3.OperationalError), statements.Session(raw, style, "postgres"):
        raw.cursor().execute("DELETE FROM bodies")  # past the check: the session itself refuses
    assert noted(log)[-1] == "rollback"
    assert sqlite3.connect(path).execute("SELECT count(*) FROM bodies").fetchone() == (100,)
    with pytest.raises(guarded.ConnectError):
        read("SELECT gone FROM bodies")
    assert noted(log)[-1] == "rollback"

    def refused(connection, secret):
        raise OSError(f"login failed for user with {secret}")

    source = embedded(path, log)
    source.connect = staticmethod(refused)
    with pytest.raises(guarded.ConnectError) as told:
        statements.reader(spark, guarded.Connection("postgres", "h", username="u"), "hush", source)("SELECT 1 AS x")
    assert "hush" not in str(told.value) and told.value.kind == "auth"


def test_marks_follow_the_driver():
    text = "SELECT '?%', \"a?\", a % 2 FROM t -- ?\n WHERE a = ? AND b = ?"
    assert statements.marked(text, "postgres", "qmark") == text
    assert statements.marked(text, "postgres", "format") == "SELECT '?%%', \"a?\", a %% 2 FROM t -- ?\n WHERE a = %s AND b = %s"
    assert statements.marked(text, "postgres", "numeric").endswith("a = :1 AND b = :2")
    assert [statements.cell(v) for v in (None, True, 1.5, b"\x01", "x")] == ["", "true", "1.5", "01", "x"]
    with pytest.raises(guarded.ConnectError) as told:
        statements.driver_of(dataclasses.replace(guarded.Connection("postgres", "h"), driver="no_such_driver"))
    assert told.value.kind == "validation"


def test_only_single_reads_pass():
    for good in ("SELECT 1;", "WITH a AS (SELECT 'it''s; drop' AS x) SELECT x FROM a", "SELECT a[1] FROM t"):
        guarded.assert_read(good, "postgres")
    bad = [
        "SELECT E'\\'' ; DROP TABLE x; --'", "SELECT $$'$$ ; DELETE FROM t; --'", "SELECT $a$'$a$ ; DELETE FROM t; --'", "SELECT 1; SET x = 1", "SELECT 1;;", "SELECT 1 --\rDROP TABLE x",
        "SELECT 'open", "SELECT \"open", "SELECT * FROM openrowset('x')", "SELECT 1 /* /* */ drop table x */", "KILL 5", "SELECT 1 WAITFOR DELAY '1'", "SELECT U&'\\0027; drop'",
    ]
    for text in bad:
        for engine in guarded.PORTS:
            with pytest.raises(guarded.Refused):
                guarded.assert_read(text, engine)
    with pytest.raises(guarded.Refused):
        guarded.assert_read("SELECT a[1; DROP TABLE t]", "postgres")  # brackets are code there
    from catlas.sources import postgres, sqlserver

    for engine, module in (("postgres", postgres), ("sqlserver", sqlserver)):
        for name, value in vars(module).items():
            if name.isupper() and isinstance(value, str):
                guarded.assert_read(value, engine)


@pytest.mark.parametrize(
    ("message", "kind", "told"),
    [
        ("Server not found in Kerberos database (7)", "auth", "kgetcred MSSQLSvc/db.corp.example:1433@EAST.EXAMPLE"),
        ("KDC_ERR_WRONG_REALM Reserved: realm WEST.EXAMPLE", "auth", "@WEST.EXAMPLE"),
        ("no GSSAPI provider registered", "auth", "set its auth to kerberos"),
        ("unknown authentication message: 16", "validation", "scram or Kerberos for ann"),
        ("x509: certificate signed by unknown authority", "validation", "trust_certificate"),
        ("PKIX path building failed", "validation", "trust store"),
        ('FATAL: database "cor" does not exist (SQLSTATE 3D000)', "auth", "no database core on db.corp.example"),
        ('Cannot open database "core" requested by the login. The login failed.', "auth", "correct the name of the database"),
        ("Login failed for user 'ann'.", "auth", "refused the login of ann"),
        ("FATAL: something (SQLSTATE 28P01)", "auth", "secret"),
        ("credentials cache file '/tmp/krb5cc_1' not found", "auth", "kinit"),
        ("connection timed out {x}", "unavailable", "{x}"),
    ],
)
def test_failures_name_their_remedy(message, kind, told):
    c = guarded.Connection("sqlserver", "db.corp.example", "core", username="ann", params={"realm": "east.example"})
    error = guarded.explain(message, c)
    assert error.kind == kind and told in str(error) and message in str(error)
    assert bool(error.remedy) == (kind != "unavailable")


def test_realms_and_principals():
    c = guarded.Connection("postgres", "db.corp.example", params={"realm": "CORP.EXAMPLE"})
    assert c.principal() == "postgres/db.corp.example" and not c.cross_realm()
    assert dataclasses.replace(c, params={"realm": "example"}).cross_realm() is False  # a parent realm holds its domains
    assert dataclasses.replace(c, params={"realm": "other.example"}).cross_realm() and not dataclasses.replace(c, params={}).cross_realm()
    assert guarded.Connection("sqlserver", "h", port=1500).principal() == "MSSQLSvc/h:1500"


def test_unreachable_servers_are_stored_with_a_warning(tmp_path, monkeypatch, caplog):
    run = lambda *a: cli.main(["--config", str(tmp_path / "c.json"), "--quiet", *a])
    monkeypatch.setenv("CATLAS_CONNECTION_FAR_SECRET", "s")
    monkeypatch.setenv("CATLAS_CONNECTION_NO_SECRET", "s")

    def opened(record, secret):
        raise guarded.explain("connection timed out" if record["host"] == "far" else "login failed", guarded.Connection("postgres", record["host"]))

    monkeypatch.setattr(cli, "open_source", opened)
    assert run("connection", "add", "far", "--engine", "postgres", "--host", "far", "--auth", "scram", "--username", "u") == 0
    assert run("connection", "show", "far") == 0 and "timed out" in caplog.text
    assert run("connection", "add", "no", "--engine", "postgres", "--host", "no", "--auth", "scram", "--username", "u") == output.AUTH
    assert run("connection", "show", "no") == output.NOT_FOUND


def test_completion_offers_what_may_follow(tmp_path, capsys):
    assert cli.main(["--no-input", "--config", str(tmp_path / "c.json"), "completion", "bash"]) == 0
    script = tmp_path / "complete.sh"
    script.write_text(capsys.readouterr().out + '\nCOMP_WORDS=("$@"); COMP_CWORD=$(($# - 1)); _catlas; printf "%s\\n" "${COMPREPLY[@]}"\n')

    def offered(*typed):
        return subprocess.run(["bash", str(script), "catlas", *typed], capture_output=True, text=True, check=True).stdout.split()

    assert offered("conn") == ["connection"] and offered("connection", "re") == ["remove"]
    assert "--host" in offered("connection", "add", "--") and offered("index", "--dr") == ["--dry-run"]
    assert offered("completion", "z") == ["zsh"] and "--no-input" in offered("--")
