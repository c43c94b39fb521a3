"""Results as an aligned table or as JSON, and exit codes."""

from __future__ import annotations

import json
from collections.abc import Iterable
from typing import Any

from catlas.app.config import InUse, Invalid, NotFound
from catlas.operators.health import Unhealthy
from catlas.sources.guarded import ConnectError, Refused

# What a command's exit code says.
OK, ERROR, CANCELLED, VALIDATION, AUTH, NOT_FOUND, UNAVAILABLE = range(7)


def exit_code(error: BaseException | None) -> int:
    if error is None:
        return OK
    if isinstance(error, ConnectError):
        return {"auth": AUTH, "validation": VALIDATION}.get(error.kind, UNAVAILABLE)
    for kinds, code in (((KeyboardInterrupt, EOFError), CANCELLED), ((Invalid, InUse, Refused), VALIDATION), ((NotFound,), NOT_FOUND), ((Unhealthy, ConnectionError), UNAVAILABLE)):
        if isinstance(error, kinds):
            return code
    return ERROR


def show(record: list[tuple[str, Any]], format_: str) -> str:
    """One record, fields in their order."""
    if format_ == "json":
        return json.dumps(dict(record), ensure_ascii=False)
    if format_ != "table":
        raise Invalid("output", format_, "must be one of table, json")
    width = max((len(n) for n, _ in record), default=0)
    return "\n".join(f"{n:<{width}}  {_text(v)}".rstrip() for n, v in record)


def table(header: list[str], rows: Iterable[list[Any]], format_: str) -> str:
    rows = [list(r) for r in rows]
    if format_ == "json":
        return json.dumps([dict(zip(header, r, strict=True)) for r in rows], ensure_ascii=False)
    cells = [header, *[[_text(v) for v in r] for r in rows]]
    widths = [max(len(r[i]) for r in cells) for i in range(len(header))]
    return "\n".join("  ".join(f"{v:<{w}}" for v, w in zip(r, widths, strict=True)).rstrip() for r in cells)


def _text(value: Any) -> str:
    return "" if value is None else str(value).lower() if isinstance(value, bool) else str(value)
