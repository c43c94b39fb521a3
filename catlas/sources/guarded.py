"""Read-only JDBC access to a database's catalog: URLs, limits, and what an error means."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Seconds to log in and to dial, and each engine's caps on what a session may use.
LOGIN_TIMEOUT, DIAL_TIMEOUT = 30, 15
STATEMENT_SECONDS, WORK_MEM = 120, "16MB"
MODULES_AT_ONCE, OPEN_CONNECTIONS = 40, 4
PORTS = {"sqlserver": 1433, "postgres": 5432}
# Words that no read holds.
_WRITES = re.compile(
    r"(?i)\b(insert|update|delete|merge|into|create|alter|drop|truncate|grant|revoke|deny|backup|restore|dbcc|exec|execute|shutdown|kill|waitfor"
    r"|openrowset|opendatasource|openquery|xp_cmdshell|sp_configure|vacuum|copy|call)\b"
)
#: What isn't code in a statement: literals, quoted names, comments. In PostgreSQL brackets are code.
_TEXTS = r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|--[^\r\n]*|/\*.*?\*/"
_NOT_CODE = {"sqlserver": re.compile(rf"{_TEXTS}|\[(?:[^\]]|\]\])*\]", re.DOTALL), "postgres": re.compile(_TEXTS, re.DOTALL)}


class Refused(ValueError):
    """A statement that isn't plainly a read."""


class ConnectError(RuntimeError):
    """A failed read, told without its secret."""

    def __init__(self, message: str, kind: str = "unavailable", remedy: str = "") -> None:
        super().__init__(f"{message}; {remedy}" if remedy else message)
        self.kind, self.remedy = kind, remedy


@dataclass(frozen=True)
class Signature:
    """What a driver's message means. `told` and `remedy` may name {host}, {database}, {user}, {principal} and {realm}."""

    pattern: str
    kind: str
    told: str
    remedy: str


#: The first that matches counts.
SIGNATURES = (
    Signature(
        r"cannot generate sspi context|KDC_ERR_WRONG_REALM|wrong realm|KDC_ERR_S_PRINCIPAL_UNKNOWN|server not found in kerberos database",
        "auth",
        "{host} is in another Kerberos realm",
        "fetch its ticket into a file first (kgetcred {principal}@{realm}), and let the driver's ticketCache name that file",
    ),
    Signature(r"no gssapi provider registered", "auth", "the connection was opened without its Kerberos credentials", "set its auth to kerberos"),
    Signature(r"unknown authentication (message|response)", "validation", "{host} asks for a way to log in that the driver doesn't know", "let the server take scram or Kerberos for {user}"),
    Signature(
        r"PKIX path|x509: |unknown authority|certificate is not trusted|certificate has expired|certificate is valid for .* not |unable to verify|ssl certificate|self[- ]signed certificate|certificate",
        "validation",
        "the certificate of {host} can't be verified here",
        "add its authority to the trust store, or set trust_certificate to encrypt without verifying who answers",
    ),
    Signature(r"cannot open database|database \".*\" does not exist|SQLSTATE 3D000", "auth", "there is no database {database} on {host}, or {user} may not open it", "correct the name of the database"),
    Signature(r"login failed|authentication failed|SQLSTATE 28[0-9A-Z]{3}", "auth", "{host} refused the login of {user}", "correct the user name or the secret"),
    Signature(r"no credentials? cache|credentials cache file .* not found", "auth", "there is no Kerberos ticket", "get one (kinit)"),
)


@dataclass(frozen=True)
class Connection:
    engine: str
    host: str
    database: str = ""
    port: int = 0
    auth: str = "password"
    username: str = ""
    trust_certificate: bool = False
    params: dict[str, str] = field(default_factory=dict)
    driver: str = ""  # a Python DB-API module; without one Spark reads over JDBC

    def principal(self) -> str:
        """The service that a Kerberos ticket is for."""
        return f"postgres/{self.host}" if self.engine == "postgres" else f"MSSQLSvc/{self.host}:{self.port or PORTS['sqlserver']}"

    def cross_realm(self) -> bool:
        """Whether the realm in params isn't that of the host's domain."""
        realm, host = self.params.get("realm", "").strip().upper(), self.host.strip().upper()
        domain = host.partition(".")[2] or host
        return bool(realm and host) and domain != realm and not domain.endswith("." + realm)

    def url(self) -> str:
        """TLS is always on, and verified unless the certificate is trusted as it is; read-only intent can't be overridden."""
        host, port = self.host, self.port or PORTS[self.engine]
        if self.engine == "postgres":
            options = {"ApplicationName": "catlas", "sslmode": "require" if self.trust_certificate else "verify-full", "loginTimeout": str(LOGIN_TIMEOUT), "connectTimeout": str(DIAL_TIMEOUT), **self.params, "readOnly": "true"}
            if self.auth == "kerberos":
                options.setdefault("kerberosServerName", "postgres")
            return f"jdbc:postgresql://{host}:{port}/{quote(self.database)}?" + "&".join(f"{k}={quote(v, safe='')}" for k, v in options.items())
        options = {"applicationName": "catlas", "encrypt": "true", "trustServerCertificate": str(self.trust_certificate).lower(), "loginTimeout": str(LOGIN_TIMEOUT), **self.params, "applicationIntent": "ReadOnly", "multiSubnetFailover": "true"}
        if self.database:
            options["databaseName"] = self.database
        if self.auth == "kerberos":
            options |= {"integratedSecurity": "true", "authenticationScheme": "JavaKerberos"}
        return f"jdbc:sqlserver://{host}:{port};" + "".join(f"{k}={{{v.replace('}', '}}')}}};" if re.search(r"[;{} ]", v) else f"{k}={v};" for k, v in options.items())

    def options(self, secret: str) -> dict[str, str]:
        out = {"url": self.url(), "queryTimeout": str(STATEMENT_SECONDS), "numPartitions": "1"}
        if self.engine == "postgres":
            out["sessionInitStatement"] = f"SET default_transaction_read_only = on; SET statement_timeout = '{STATEMENT_SECONDS}s'; SET work_mem = '{WORK_MEM}'; SET max_parallel_workers_per_gather = 0"
        else:  # Spark reads a statement as a subquery, which takes no OPTION; what a session can cap is capped here
            out["sessionInitStatement"] = f"SET TRANSACTION ISOLATION LEVEL READ UNCOMMITTED; SET DEADLOCK_PRIORITY LOW; SET LOCK_TIMEOUT {DIAL_TIMEOUT * 1000}; SET QUERY_GOVERNOR_COST_LIMIT {STATEMENT_SECONDS}"
        if self.auth != "kerberos":
            out |= {"user": self.username, "password": secret}
        return out


def not_code(engine: str) -> re.Pattern[str]:
    return _NOT_CODE[engine]


def code(statement: str, engine: str = "sqlserver") -> str:
    """A statement with its literals, quoted names and comments blanked."""
    return _NOT_CODE[engine].sub(" ", statement)


def assert_read(statement: str, engine: str = "sqlserver") -> str:
    """The statement, if it is one SELECT or WITH and holds no writing word in its code.

    A `;` but at the end, a backslash in a literal and a dollar quote are refused
    as they are: engines differ on where such a literal ends, and no statement here needs one.
    """
    if any("\\" in m[0] for m in _NOT_CODE[engine].finditer(statement) if m[0][0] == "'"):
        raise Refused("a literal with a backslash may not be sent to a database")
    bare = code(statement, engine)
    if not re.match(r"(?i)\s*(select|with)\b", bare) or _WRITES.search(bare) or ";" in bare.rstrip().removesuffix(";") or re.search(r"\$\w*\$", bare) or "'" in bare or '"' in bare:
        raise Refused("only a read may be sent to a database")
    return statement


def quoted(engine: str, name: str) -> str:
    """An identifier with its closing mark doubled."""
    if engine == "sqlserver":
        return "[" + name.replace("]", "]]") + "]"
    return '"' + name.replace('"', '""') + '"' if engine == "postgres" else "`" + name.replace("`", "``") + "`"


def literals(values: list[str]) -> str:
    """A list for IN; Spark's reader binds no parameters, so quotes are doubled and odd characters refused."""
    if any("\x00" in v or "\\" in v for v in values):
        raise Refused("a key with a backslash or a null character can't be quoted")
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def sample_sql(engine: str, schema: str, table: str, columns: list[str], n: int, chars: int) -> str:
    """An explicit projection and a row limit, never an order."""
    name = f"{quoted(engine, schema)}.{quoted(engine, table)}"
    if engine == "sqlserver":
        cells = ", ".join(f"LEFT(CAST({quoted(engine, c)} AS nvarchar({chars})), {chars}) AS {quoted(engine, c)}" for c in columns)
        return f"SELECT TOP ({n}) {cells} FROM {name}"
    cells = ", ".join(f"left(CAST({quoted(engine, c)} AS text), {chars}) AS {quoted(engine, c)}" for c in columns)
    return f"SELECT {cells} FROM {name} LIMIT {n}"


def scrub(message: str, secret: str) -> str:
    """A driver's message without the secret, plain or as it stands in a URL."""
    for s in {secret, quote(secret, safe="")} - {""}:
        message = message.replace(s, "***")
    return re.sub(r"(?i)(password|pwd)=[^;&\s]*", r"\1=***", message)


def explain(message: str, connection: Connection | None = None) -> ConnectError:
    """What a driver's message means and what to do about it; fields come from the connection, the realm from the message first."""
    found = re.search(r"(?i)realm[^A-Za-z]*(?:name )?[\"'(]?([A-Z0-9][A-Z0-9-]*(?:\.[A-Z0-9-]+)+)", message)
    c = connection if isinstance(connection, Connection) else Connection("sqlserver", "the server")
    told = {"host": c.host, "database": c.database or "of that name", "user": c.username or "this user", "principal": c.principal(), "realm": (found[1] if found else c.params.get("realm", "THE.SERVERS.REALM")).upper()}
    for s in SIGNATURES:
        if re.search(f"(?i){s.pattern}", message):
            return ConnectError(f"{s.told.format_map(told)}: {message}", s.kind, s.remedy.format_map(told))
    return ConnectError(message)


def reader(spark: SparkSession, connection: Connection, secret: str) -> Callable[..., DataFrame]:
    """A function from a SELECT to a frame of text cells, null as empty.

    With conditions it sends the SELECT once for each of them, over a few
    connections at a time. A connection with a DB-API driver sends statements as
    they are, see statements.py; without one Spark wraps them for JDBC.
    """
    engine = getattr(connection, "engine", "sqlserver")
    if getattr(connection, "driver", ""):
        from catlas.sources import statements

        return statements.reader(spark, connection, secret)

    def read(statement: str, conditions: Sequence[str] = ()) -> DataFrame:
        try:
            options = connection.options(secret)
            if conditions:
                for c in conditions:
                    assert_read(f"SELECT 1 WHERE {c}", engine)
                url = options.pop("url")
                each = spark.read.jdbc(url, f"({assert_read(statement, engine)}) picked", predicates=list(conditions), properties=options)
                return texts(each).coalesce(OPEN_CONNECTIONS)
            out = spark.read.format("jdbc").options(**options).option("query", assert_read(statement, engine)).load()
            return texts(out)
        except Refused:
            raise
        except Exception as error:
            raise explain(scrub(str(error), secret), connection) from None

    return read


def definitions(read: Callable[..., DataFrame], statement: str, named: DataFrame) -> DataFrame:
    """(key, definition) of the objects `named` (id, key), by a statement that gives id and definition.

    Their ids go to the server, some to a statement, so that it renders no
    other definition; without any no statement is sent. The driver holds an id
    and a key per object that is read again.
    """
    rows = [(str(int(r["id"])), r["key"]) for r in named.select("id", "key").collect()]
    asked = named.sparkSession.createDataFrame(rows, "id string, key string")
    if not rows:
        return asked.select("key", F.lit("").alias("definition"))
    ids = sorted({i for i, _ in rows}, key=int)
    if getattr(read, "binds", False):
        groups = [ids[at : at + MODULES_AT_ONCE] for at in range(0, len(ids), MODULES_AT_ONCE)]
        each = read(statement, [f"id IN ({', '.join('?' * len(g))})" for g in groups], [[int(i) for i in g] for g in groups])
        return each.join(asked, "id").select("key", "definition")
    conditions = [f"id IN ({', '.join(ids[at : at + MODULES_AT_ONCE])})" for at in range(0, len(ids), MODULES_AT_ONCE)]
    return read(statement, conditions).join(asked, "id").select("key", "definition")


def texts(df: DataFrame) -> DataFrame:
    return df.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in df.columns])


def sample(read: Callable[[str], DataFrame], engine: str, key: str, columns: list[str], n: int, chars: int) -> list[list[str]]:
    """Sample rows of one table; without columns or rows to read no statement is sent."""
    if not columns or n < 1:
        return []
    schema, _, table = key.partition(".")
    return [list(r) for r in read(sample_sql(engine, schema, table, columns, n, chars)).collect()]
