"""Guarded statements as a Spark data source: sent to the server as they are, over a Python DB-API driver.

Each statement is a partition. A task opens a session with the engine's guards,
binds the parameters, sends the statement with the engine's cap at its end,
streams its rows and rolls back whatever happened. Nothing wraps the statement,
so that the cap holds for it; a read-only transaction (PostgreSQL) or intent
(SQL Server) keeps the server from taking a write that got past `assert_read`.
"""

from __future__ import annotations

import importlib
import json
import re
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass
from typing import Any

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

from catlas.sources.guarded import DIAL_TIMEOUT, LOGIN_TIMEOUT, OPEN_CONNECTIONS, PORTS, STATEMENT_SECONDS, WORK_MEM, ConnectError, Connection, Refused, assert_read, explain, not_code, scrub

#: Rows taken from a driver at a time.
FETCH = 1000
NAME = "guarded_statements"


@dataclass(frozen=True)
class Guard:
    """Sent before a statement, in its transaction; and what every statement ends in."""

    session: tuple[str, ...]
    suffix: str = ""


# Each engine's caps, as settings of a transaction or at the end of a statement.
GUARDS = {
    "postgres": Guard(("SET TRANSACTION READ ONLY", f"SET LOCAL statement_timeout = '{STATEMENT_SECONDS}s'", f"SET LOCAL work_mem = '{WORK_MEM}'", "SET LOCAL max_parallel_workers_per_gather = 0")),
    "sqlserver": Guard(("SET TRANSACTION ISOLATION LEVEL READ UNCOMMITTED", "SET DEADLOCK_PRIORITY LOW", f"SET LOCK_TIMEOUT {DIAL_TIMEOUT * 1000}"), "OPTION (MAXDOP 1, MAX_GRANT_PERCENT = 1)"),
}
#: Modules that speak to an engine, the first that can be imported counts where none is named.
DRIVERS = {"postgres": ("psycopg", "psycopg2", "pg8000.dbapi"), "sqlserver": ("pyodbc",)}


def capped(statement: str, engine: str) -> str:
    """The statement with the engine's cap at its end; a closing semicolon would cut that off and goes."""
    suffix = GUARDS[engine].suffix
    return re.sub(r";\s*$", "", statement) + "\n" + suffix if suffix else statement


def marked(statement: str, engine: str, style: str) -> str:
    """A statement's `?` marks as its driver writes them; marks inside literals, names and comments stay."""
    out, at, n = [], 0, 0

    def code(text: str) -> str:
        nonlocal n
        if style in ("format", "pyformat"):
            return text.replace("%", "%%").replace("?", "%s")
        for _ in range(text.count("?") if style == "numeric" else 0):
            n += 1
            text = text.replace("?", f":{n}", 1)
        return text

    for m in not_code(engine).finditer(statement):
        out += [code(statement[at : m.start()]), m[0].replace("%", "%%") if style in ("format", "pyformat") else m[0]]
        at = m.end()
    return "".join([*out, code(statement[at:])])


def cell(value: Any) -> str:
    """A value as text, null as empty, booleans as Spark writes them."""
    if value is None:
        return ""
    if isinstance(value, bool):
        return str(value).lower()
    return value.hex() if isinstance(value, bytes | bytearray | memoryview) else str(value)


def driver_of(connection: Connection) -> Any:
    names = (connection.driver,) if connection.driver and connection.driver != "any" else DRIVERS[connection.engine]
    for name in names:
        try:
            return importlib.import_module(name)
        except ImportError:
            continue
    raise ConnectError(f"no driver for {connection.engine} can be imported: {', '.join(names)}", "validation")


def connect(connection: Connection, secret: str) -> tuple[Any, str]:
    """(an open DB-API connection, its parameter style). TLS is on and verified as in Connection.url."""
    module = driver_of(connection)
    host, port = connection.host, connection.port or PORTS[connection.engine]
    if connection.engine == "sqlserver":
        options = {"DRIVER": "{ODBC Driver 18 for SQL Server}", "SERVER": f"{host},{port}", "DATABASE": connection.database, "Encrypt": "yes", "TrustServerCertificate": "yes" if connection.trust_certificate else "no", "APP": "catlas", **connection.params, "ApplicationIntent": "ReadOnly", "MultiSubnetFailover": "Yes"}
        options |= {"Trusted_Connection": "yes"} if connection.auth == "kerberos" else {"UID": connection.username, "PWD": "{" + secret.replace("}", "}}") + "}"}
        return module.connect(";".join(f"{k}={v}" for k, v in options.items() if v), timeout=LOGIN_TIMEOUT), module.paramstyle
    options = {"host": host, "port": port, "user": connection.username, "password": secret}
    if module.__name__.startswith("pg8000"):
        return module.connect(**options, database=connection.database, timeout=DIAL_TIMEOUT, ssl_context=True), module.paramstyle
    options |= {"dbname": connection.database, "connect_timeout": DIAL_TIMEOUT, "application_name": "catlas", "sslmode": "require" if connection.trust_certificate else "verify-full"}
    return module.connect(**{k: v for k, v in (options | connection.params).items() if v not in ("", None)}), module.paramstyle


class Session:
    """One guarded transaction. It ends in a rollback however it ends."""

    def __init__(self, raw: Any, style: str, engine: str) -> None:
        self.raw, self.style, self.engine = raw, style, engine

    def __enter__(self) -> Session:
        try:
            cursor = self.raw.cursor()
            for line in GUARDS[self.engine].session:
                cursor.execute(line)
            cursor.close()
        except BaseException:
            self.__exit__()
            raise
        return self

    def __exit__(self, *_: object) -> None:
        try:
            self.raw.rollback()
        finally:
            self.raw.close()

    def run(self, statement: str, parameters: Sequence[Any] = ()) -> tuple[list[str], Iterator[tuple[str, ...]]]:
        """(names, rows of text cells) of one statement that reads."""
        text = capped(assert_read(statement, self.engine), self.engine)
        cursor = self.raw.cursor()
        # Without parameters a driver takes the text as it is, per cent signs too.
        cursor.execute(marked(text, self.engine, self.style), list(parameters)) if parameters else cursor.execute(text)

        def rows() -> Iterator[tuple[str, ...]]:
            while taken := cursor.fetchmany(FETCH):
                yield from (tuple(map(cell, row)) for row in taken)

        return [d[0] for d in cursor.description], rows()


class Statement(InputPartition):
    def __init__(self, text: str, parameters: list[Any]) -> None:
        super().__init__(text)
        self.text, self.parameters = text, parameters


class Statements(DataSource):
    """Options: connection, secret, statements (JSON: [text, parameters] each) and columns (JSON). Rows are text cells."""

    #: Opens a DB-API connection: (connection, secret) to (connection, parameter style).
    connect = staticmethod(connect)

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> StructType:
        return StructType([StructField(c, StringType()) for c in json.loads(self.options["columns"])])

    def reader(self, schema: StructType) -> DataSourceReader:
        record, secret = Connection(**json.loads(self.options["connection"])), self.options.get("secret", "")
        return StatementReader(type(self).connect, record, secret, json.loads(self.options["statements"]))


class StatementReader(DataSourceReader):
    def __init__(self, connect: Any, connection: Connection, secret: str, statements: list) -> None:
        self.connect, self.connection, self.secret, self.statements = connect, connection, secret, statements

    def partitions(self) -> list[Statement]:
        return [Statement(text, parameters) for text, parameters in self.statements]

    def read(self, partition: Statement) -> Iterator[tuple[str, ...]]:
        try:
            raw, style = self.connect(self.connection, self.secret)
            with Session(raw, style, self.connection.engine) as session:
                yield from session.run(partition.text, partition.parameters)[1]
        except Exception as error:
            raise RuntimeError(scrub(str(error), self.secret)) from None


def columns_of(connect: Any, connection: Connection, secret: str, statement: str, parameters: Sequence[Any]) -> list[str]:
    """A statement's column names: it is sent once, and rolled back before a row is fetched."""
    try:
        raw, style = connect(connection, secret)
        with Session(raw, style, connection.engine) as session:
            return session.run(statement, parameters)[0]
    except Refused:
        raise
    except Exception as error:
        raise explain(scrub(str(error), secret), connection) from None


def reader(spark: SparkSession, connection: Connection, secret: str, source: type[Statements] = Statements):
    """A function from a SELECT to a frame of text cells, as guarded.reader's, over `source`.

    With conditions it sends `SELECT ... WHERE condition` once for each of them,
    with the condition's own parameters, over OPEN_CONNECTIONS connections at a time.
    """
    spark.dataSource.register(source)
    known: dict[str, list[str]] = {}

    def read(statement: str, conditions: Sequence[str] = (), parameters: Sequence[Sequence[Any]] = ()) -> DataFrame:
        each = [[f"SELECT * FROM ({statement}) picked WHERE {c}", list(p)] for c, p in zip(conditions, parameters or [()] * len(conditions), strict=True)] if conditions else [[statement, []]]
        for text, _ in each:
            assert_read(text, connection.engine)
        if statement not in known:  # a statement is asked for its names once, however often it is read
            known[statement] = columns_of(source.connect, connection, secret, *each[0])
        names = known[statement]
        rows = spark.read.format(source.name()).option("connection", json.dumps(asdict(connection))).option("secret", secret)
        try:
            out = rows.option("statements", json.dumps(each)).option("columns", json.dumps(names)).load()
        except PySparkException as error:
            raise explain(scrub(str(error), secret), connection) from None
        return out.coalesce(OPEN_CONNECTIONS)

    read.binds = True
    return read
