"""The command line: index, doctor, connection, backend, profile, config, version, completion."""

from __future__ import annotations

import argparse
import json
import logging
import os
import subprocess
import sys
from collections.abc import Callable
from datetime import datetime, timezone
from pathlib import Path
from typing import Any

from catlas.app import cache, config, doctor, output
from catlas.app.terminal import Terminal
from catlas.operators import health, planning
from catlas.plans import build as B
from catlas.sources import guarded, postgres, sqlserver
from catlas.sources.tables import Tables

log = logging.getLogger("catlas")

VERSION = "0.1.0"
#: How doctor's lines are coloured at a terminal.
RESULTS = {"ok": "green", "failed": "red", "skipped": "gray"}
PROBE = 'Answer with the JSON object {"objects": []} and nothing else.'


def session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("catlas").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def open_source(record: dict[str, Any], secret: str) -> B.Source:
    """A source of a connection record; for engine spark the host is a folder of Parquet tables."""
    if record["engine"] == "spark":
        return Tables(session(), record["host"])
    auth = "kerberos" if record["auth"] == "kerberos" else "password"
    made = guarded.Connection(record["engine"], record["host"], record.get("database", ""), int(record.get("port", 0)), auth, record.get("username", ""), bool(record.get("trust_certificate")), record.get("params", {}), record.get("driver", ""))
    read = guarded.reader(session(), made, secret)
    return postgres.Postgres(read) if record["engine"] == "postgres" else sqlserver.SqlServer(read)


def describer(record: dict[str, Any], secret: str = "") -> Callable[[str], dict]:
    """provider command: a program that reads a prompt and writes the JSON reply; http: a URL that takes {"prompt"} and gives {"reply", ...usage}, and a secret as its bearer token."""
    headers = {"Content-Type": "application/json", **({"Authorization": f"Bearer {secret}"} if secret else {})}
    if record["provider"] == "command":
        return lambda prompt: {"reply": subprocess.run(record["model"], shell=False, input=prompt, capture_output=True, text=True, check=True, timeout=300).stdout}

    def post(prompt: str) -> dict:
        from urllib.request import Request, urlopen

        with urlopen(Request(record["base_url"], json.dumps({"prompt": prompt}).encode(), headers), timeout=300) as r:
            return json.loads(r.read())

    return post


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="catlas")
    p.add_argument("--config", default=os.environ.get("CATLAS_CONFIG", str(Path.home() / ".catlas.json")))
    p.add_argument("--profile", default="")
    p.add_argument("--output", "-o", default="")
    p.add_argument("--quiet", action="store_true")
    p.add_argument("--force", action="store_true")
    p.add_argument("--no-input", action="store_true", help="never ask for a secret")
    p.add_argument("--allow-plaintext", action="store_true", help="keep secrets in a file that only its owner may read, beside the configuration")
    sub = p.add_subparsers(dest="command", required=True)
    index = sub.add_parser("index", help="bring an index up to date with a database")
    index.add_argument("connection", nargs="?", default="")
    index.add_argument("--db", default="")
    index.add_argument("--match", default="")
    index.add_argument("--limit", type=int, default=0)
    index.add_argument("--samples", type=int, default=-1)
    index.add_argument("--out", default="index")
    index.add_argument("--backend", default="")
    index.add_argument("--store", default="", help="folder of stored structures that driver and executors share")
    index.add_argument("--answers", default="", help="folder that driver and executors share; the backend is then asked by tasks, each prompt once")
    index.add_argument("--dry-run", action="store_true")
    sub.add_parser("doctor", help="check a connection").add_argument("connection", nargs="?", default="")
    for kind, fields in (("connection", ("engine", "host", "port", "database", "auth", "username", "driver")), ("backend", ("provider", "model", "base-url")), ("profile", ("connection", "backend", "output-format"))):
        acts = sub.add_parser(kind).add_subparsers(dest="act", required=True)
        add = acts.add_parser("add")
        add.add_argument("name")
        for f in fields:
            add.add_argument(f"--{f}", default="")
        if kind != "profile":
            add.add_argument("--no-verify", action="store_true", help="store it without trying it")
            add.add_argument("--password-stdin" if kind == "connection" else "--api-key-stdin", dest="piped", action="store_true", help="read the secret from the input and keep it")
        for act in ("show", "remove", *(("switch",) if kind == "profile" else ())):
            acts.add_parser(act).add_argument("name")
        acts.add_parser("list")
    acts = sub.add_parser("config").add_subparsers(dest="act", required=True)
    acts.add_parser("list")
    acts.add_parser("get").add_argument("key")
    one = acts.add_parser("set")
    one.add_argument("key")
    one.add_argument("value")
    sub.add_parser("version")
    sub.add_parser("completion", help="print a script that completes commands and flags in a shell").add_argument("shell", choices=("bash", "zsh"))
    return p


def words(p: argparse.ArgumentParser, path: tuple[str, ...] = ()) -> dict[tuple[str, ...], list[str]]:
    """What may follow each path of commands: sub-commands, flags and fixed choices."""
    out: dict[tuple[str, ...], list[str]] = {path: []}
    for action in p._actions:
        if isinstance(action, argparse._SubParsersAction):
            for name, child in action.choices.items():
                out |= words(child, (*path, name))
        out[path] += [*action.option_strings, *map(str, action.choices or ())]
    return out


def completion(shell: str) -> str:
    """A shell function that offers the words of the longest path of commands typed so far."""
    cases = "\n".join(f'    "{" ".join(path)}") words="{" ".join(found)}" ;;' for path, found in words(parser()).items())
    start = "autoload -U +X bashcompinit && bashcompinit\n" if shell == "zsh" else ""
    commands = " ".join(sorted({w for path in words(parser()) for w in path}))
    return f"""{start}_catlas() {{
  local words="" path="" w
  for w in "${{COMP_WORDS[@]:1:COMP_CWORD-1}}"; do
    case " {commands} " in *" $w "*) path="${{path:+$path }}$w" ;; esac
  done
  case "$path" in
{cases}
  esac
  COMPREPLY=($(compgen -W "$words" -- "${{COMP_WORDS[COMP_CWORD]}}"))
}}
complete -F _catlas catlas"""


def _record(args: argparse.Namespace, kind: str) -> dict[str, Any]:
    names = {"connection": ("engine", "host", "port", "database", "auth", "username", "driver"), "backend": ("provider", "model", "base_url"), "profile": ("connection", "backend", "output_format")}[kind]
    out = {("output" if n == "output_format" else n): getattr(args, n) for n in names if getattr(args, n)}
    if kind == "connection" and "auth" not in out and out.get("engine") in config.AUTHS:
        out["auth"] = config.AUTHS[out["engine"]][0]
    if "port" in out:
        out["port"] = int(out["port"])
    return out


def stored(args: argparse.Namespace, c: config.Config) -> config.Secrets:
    fallback = "plaintext" if args.allow_plaintext else c.value("secrets.fallback")
    return config.Secrets(Path(args.config).with_name(".catlas-secrets.json"), fallback)


def obtain(args: argparse.Namespace, record: dict[str, Any], known: config.Secrets, terminal: Terminal) -> str:
    """A secret that is new and to be kept: piped in, or typed where one is needed, none is known and it may be kept; else an empty text."""
    needed = args.command == "connection" and record["auth"] not in config.SECRETLESS
    flag = "--password-stdin" if args.command == "connection" else "--api-key-stdin"
    if args.piped:
        value = terminal.piped()
        if not value:
            raise config.Invalid(flag, "", "nothing arrived on the input")
    elif needed and known.kept and terminal.can_ask and not known.find(args.command, args.name):
        value = terminal.secret("password")
        if not value:
            raise config.Invalid("password", "", f"must not be empty; type it, use {flag} or set {config.secret_name(args.command, args.name)}")
    else:
        return ""
    if not known.kept:
        known.keep(args.command, args.name, value)  # says what would allow it
    return value


def verify(kind: str, name: str, record: dict[str, Any], known: config.Secrets) -> None:
    """Raise unless a connection answers a guarded read, or a backend one small question with JSON.

    A server that can't be reached just now is warned of and may be stored; one that
    refuses the login, the database or the certificate has decided.
    """
    if kind == "backend":
        json.loads(describer(record, known.find(kind, name))(PROBE)["reply"])
        return
    _, error = doctor.run(name, record, open_source, known)
    if isinstance(error, guarded.ConnectError) and error.kind == "unavailable":
        log.warning("%s was not reached: %s", name, error)
    elif error and not isinstance(error, health.Unhealthy):  # a busy server is there all the same
        raise error


def entries(args: argparse.Namespace, c: config.Config, format_: str, terminal: Terminal) -> str:
    kind, known = args.command, stored(args, c)
    if args.act == "add":
        record = _record(args, kind)
        c.add(kind, args.name, record)
        new = obtain(args, record, known, terminal) if kind != "profile" else ""
        if kind != "profile" and not args.no_verify:
            # what was just given is tried, and kept only if it isn't refused
            key = config.secret_name(kind, args.name)
            verify(kind, args.name, record, config.Secrets(known.path, env={**known.env, key: new}) if new else known)
        if new:
            known.keep(kind, args.name, new)
        c.save()
    elif args.act == "remove":
        c.remove(kind, args.name, args.force)
        c.save()
        known.forget(kind, args.name)
    elif args.act == "switch":
        c.set("current_profile", args.name)
        c.save()
    elif args.act == "show":
        return output.show([("name", args.name), *c.get(kind, args.name).items()], format_)
    else:
        return output.table(["name", "record"], [[n, json.dumps(c.get(kind, n), sort_keys=True)] for n in c.names(kind)], format_)
    return f"{kind} {args.name}: {args.act}"


def settings(args: argparse.Namespace, c: config.Config, format_: str) -> str:
    if args.act == "set":
        c.set(args.key, args.value)
        c.save()
        return f"{args.key}: {args.value}"
    if args.act == "get":
        if args.key not in config.SETTINGS:
            raise config.NotFound(f"no setting {args.key!r}")
        return c.settings.get(args.key, "")
    return output.table(["setting", "value"], [[k, c.settings.get(k, "")] for k in config.SETTINGS], format_)


def report(s: B.Summary, o: B.Options) -> list[tuple[str, Any]]:
    head = [("connection", o.connection), ("database", o.database), ("out", o.out), ("objects", s.objects)]
    reasons = planning.reasons_text(s.reasons)
    if o.dry_run:
        pending = f"at most {s.refetch}, decided by content fingerprint after the fetch" if s.refetch else "none; nothing is being refetched"
        return [*head, ("dry-run", True), ("refetch", s.refetch), ("untouched", s.untouched), ("dropped", len(s.dropped)), ("reasons", reasons), ("describe", pending)]
    redacted = ", ".join(f"{k} {s.redactions[k]}" for k in sorted(s.redactions)) or "none"
    return [
        *head, ("dropped", len(s.dropped)), ("reasons", reasons), ("read", s.read), ("from the store", s.reused), ("described", s.described), ("unchanged", s.unchanged), ("sampled", s.sampled), ("column files", s.column_files),
        ("body files", s.body_files), ("missing", len(s.missing)), ("failed batches", len(s.failed)), ("redactions", redacted), *sorted(s.usage.items()),
    ]


def index(args: argparse.Namespace, c: config.Config, format_: str) -> tuple[str, BaseException | None]:
    profile = c.entries["profile"].get(c.value("current_profile", args.profile), {})
    name = args.connection or profile.get("connection", "")
    record = c.get("connection", name)
    database = args.db or record.get("database", "") or "main"
    backend = c.get("backend", args.backend or profile.get("backend", "")) if not args.dry_run else None
    known = stored(args, c)
    secret = "" if record["auth"] in config.SECRETLESS else known.get("connection", name)
    told = describer(backend, known.find("backend", args.backend or profile.get("backend", ""))) if backend else None
    o = B.Options(name, database, record["engine"], args.out, args.match, args.limit, args.samples, args.force, args.dry_run, store=args.store, answers=args.answers, now=datetime.now(timezone.utc))
    spent: dict[str, float] = {}
    ask = (lambda prompt: {}) if not told else cache.retried(told) if o.answers else cache.cached(cache.retried(cache.metered(told, spent)), Path(args.config).parent / ".catlas-answers")
    summary = B.build(session(), open_source({**record, "database": database}, secret), ask, o)
    summary.usage = summary.usage if o.answers else spent
    try:
        B.outcome(summary, o.dry_run)
    except B.Incomplete as error:
        return output.show(report(summary, o), format_), error
    return output.show(report(summary, o), format_), None


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    logging.basicConfig(stream=sys.stderr, level=logging.ERROR if args.quiet else logging.INFO, format="%(message)s")
    logging.getLogger("py4j").setLevel(logging.ERROR)
    error: BaseException | None = None
    terminal = Terminal(args.no_input)
    try:
        c = config.Config.load(args.config)
        format_ = c.value("output", args.output)
        if args.command == "version":
            text = VERSION
        elif args.command == "completion":
            text = completion(args.shell)
        elif args.command == "config":
            text = settings(args, c, format_)
        elif args.command == "index":
            text, error = index(args, c, format_)
        elif args.command == "doctor":
            name = args.connection or c.entries["profile"].get(c.value("current_profile", args.profile), {}).get("connection", "")
            rows, error = doctor.run(name, c.get("connection", name), open_source, stored(args, c))
            text = output.table(["check", "result", "detail"], [list(r) for r in rows], format_)
            if format_ == "table":
                text = "\n".join([terminal.paint("bold", (lines := text.split("\n"))[0]), *[terminal.paint(RESULTS[r[1]], line) for r, line in zip(rows, lines[1:], strict=True)]])
        else:
            text = entries(args, c, format_, terminal)
        print(text)
    except (Exception, KeyboardInterrupt) as e:
        error = e
        print(f"error: {e}", file=sys.stderr)
    return output.exit_code(error)


if __name__ == "__main__":
    sys.exit(main())
