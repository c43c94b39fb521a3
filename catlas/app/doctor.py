"""Five checks of a connection in order; after the first failure the rest are skipped."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import Any

from catlas.app import config as C
from catlas.operators import health

CHECKS = ("credential", "connection", "auth", "read-only", "health")


def run(name: str, record: dict[str, Any], open_: Callable[[dict[str, Any], str], Any], secrets: Mapping[str, str] | C.Secrets) -> tuple[list[tuple[str, str, str]], BaseException | None]:
    """((check, ok/failed/skipped, detail) in order, the first error).

    `secrets` is an environment or what also knows a file. `open_` makes a source of a record and a secret; reading its health shows
    that the login and a read are accepted.
    """
    got: dict[str, Any] = {"secret": ""}

    def credential() -> str:
        if record["auth"] in C.SECRETLESS:
            return f"{record['auth']} needs no stored secret"
        known = secrets if isinstance(secrets, C.Secrets) else C.Secrets("", env=secrets)
        got["secret"] = known.get("connection", name)
        key = C.secret_name("connection", name)
        return f"found in {key}" if known.env.get(key) else f"found in {known.path}"

    def connection() -> str:
        got["source"] = open_(record, got["secret"])
        return f"{record['engine']} at {record['host']} via {record['auth']}"

    def auth() -> str:
        got["reading"] = got["source"].health()
        return "the server accepted the login"

    def read_only() -> str:
        got["row"] = health.classify(got["reading"]).first()
        return "a guarded read was accepted"

    def verdict() -> str:
        health.require(got["reading"], "a build")
        row = got["row"]
        return f"room for a build, {row['available_gb']:.1f} GB of OS memory free" if row["memory_visible"] else "room for a build"

    out, error = [], None
    for check, step in zip(CHECKS, (credential, connection, auth, read_only, verdict), strict=True):
        if error:
            out.append((check, "skipped", ""))
            continue
        try:
            out.append((check, "ok", step()))
        except Exception as e:
            error = e
            out.append((check, "failed", str(e)))
    return out, error
