"""Connections, backends and profiles in one JSON file, and which value wins."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Mapping
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

# What goes with what.
AUTHS = {"sqlserver": ("sql", "kerberos"), "postgres": ("scram", "kerberos"), "spark": ("none",)}
PROVIDERS = ("command", "http")
FALLBACKS = ("never", "plaintext")
SECRETLESS = ("kerberos", "none")
FORMATS = ("table", "json")
_NAME = re.compile(r"[A-Za-z0-9][A-Za-z0-9._-]*\Z")
KINDS = ("connection", "backend", "profile")


class Invalid(ValueError):
    def __init__(self, field_: str, value: str, reason: str) -> None:
        super().__init__(f"{field_} {value!r}: {reason}")


class InUse(ValueError):
    """An entry that profiles refer to."""


class NotFound(LookupError):
    """A named entry or setting that isn't there."""


@dataclass
class Config:
    """entries: kind to name to record; settings: current_profile, output, secrets.fallback."""

    path: Path | None = None
    entries: dict[str, dict[str, dict[str, Any]]] = field(default_factory=lambda: {k: {} for k in KINDS})
    settings: dict[str, str] = field(default_factory=dict)

    @classmethod
    def load(cls, path: str | Path) -> Config:
        """The file's configuration; an empty one where there is no file."""
        out = cls(Path(path))
        if out.path.exists():
            data = json.loads(out.path.read_text(encoding="utf-8"))
            out.settings = data.get("settings", {})
            for kind in KINDS:
                out.entries[kind] = data.get(kind, {})
            out.validate()
        return out

    def save(self) -> None:
        """Whole or not at all, for the owner's eyes only."""
        self.path.parent.mkdir(parents=True, exist_ok=True)
        part = self.path.with_name(self.path.name + ".part")
        part.touch(mode=0o600)
        part.write_text(json.dumps({"settings": self.settings, **self.entries}, indent=1, sort_keys=True), encoding="utf-8")
        part.replace(self.path)

    def validate(self) -> None:
        for kind in KINDS:
            for name, record in self.entries[kind].items():
                check(kind, name, record)
        if self.settings.get("secrets.fallback", "never") not in FALLBACKS:
            raise Invalid("secrets.fallback", self.settings["secrets.fallback"], f"must be one of {', '.join(FALLBACKS)}")

    def get(self, kind: str, name: str) -> dict[str, Any]:
        if name not in self.entries[kind]:
            raise NotFound(f"no {kind} named {name!r}")
        return self.entries[kind][name]

    def add(self, kind: str, name: str, record: dict[str, Any]) -> None:
        check(kind, name, record)
        if kind == "profile":
            self.get("connection", record["connection"])
            self.get("backend", record["backend"])
        self.entries[kind][name] = record

    def remove(self, kind: str, name: str, force: bool = False) -> None:
        """Remove an entry; one that profiles use only if forced. Profiles may be left dangling then."""
        self.get(kind, name)
        users = sorted(p for p, r in self.entries["profile"].items() if kind != "profile" and r.get(kind) == name)
        if users and not force:
            raise InUse(f"{kind} {name!r} is used by {', '.join(users)}")
        del self.entries[kind][name]
        if kind == "profile" and self.settings.get("current_profile") == name:
            self.settings["current_profile"] = ""

    def names(self, kind: str) -> list[str]:
        return sorted(self.entries[kind])

    def set(self, key: str, value: str) -> None:
        if key not in SETTINGS:
            raise NotFound(f"no setting {key!r}")
        if key == "current_profile" and value:
            self.get("profile", value)
        if key == "secrets.fallback" and value not in FALLBACKS:
            raise Invalid(key, value, f"must be one of {', '.join(FALLBACKS)}")
        if key == "output" and value and value not in FORMATS:
            raise Invalid(key, value, f"must be one of {', '.join(FORMATS)}")
        self.settings[key] = value

    def value(self, key: str, flag: str | None = None, env: Mapping[str, str] = os.environ) -> str:
        """The flag, else the environment, else (for output) the profile, else the file, else the default."""
        name, default = SETTINGS[key]
        if flag:
            return flag
        if env.get(name):
            return env[name]
        if key == "output":
            profile = self.entries["profile"].get(self.value("current_profile", None, env), {})
            if profile.get("output"):
                return profile["output"]
        return self.settings.get(key) or default


#: key: (environment variable, default).
SETTINGS = {"current_profile": ("CATLAS_PROFILE", ""), "output": ("CATLAS_OUTPUT", "table"), "secrets.fallback": ("CATLAS_SECRETS_FALLBACK", "never")}


def check(kind: str, name: str, record: dict[str, Any]) -> None:
    if not _NAME.match(name):
        raise Invalid(f"{kind} name", name, "must start with a letter or digit and hold only letters, digits, dot, dash or underscore")
    if kind == "connection":
        engine = record.get("engine", "")
        if engine not in AUTHS:
            raise Invalid("engine", engine, f"must be one of {', '.join(sorted(AUTHS))}")
        if not record.get("host"):
            raise Invalid("host", "", "must not be empty")
        if not 0 <= int(record.get("port", 0)) <= 65535:
            raise Invalid("port", str(record["port"]), "must be between 0 and 65535")
        if record.get("auth") not in AUTHS[engine]:
            raise Invalid("auth", str(record.get("auth")), f"must be one of {', '.join(AUTHS[engine])}")
    if kind == "backend" and record.get("provider") not in PROVIDERS:
        raise Invalid("provider", str(record.get("provider")), f"must be one of {', '.join(PROVIDERS)}")


def secret_name(kind: str, name: str) -> str:
    return "CATLAS_" + re.sub(r"[^A-Z0-9]", "_", f"{kind}_{name}_SECRET".upper())


class Secrets:
    """Secrets by connection or backend: from the environment, else from a file for its owner's eyes only.

    The file lies beside the configuration and is read and written only where
    the fallback is `plaintext`; without that nothing is kept. It is the only
    store, so a secret that may not be kept has to come from the environment.
    """

    def __init__(self, path: str | Path, fallback: str = "never", env: Mapping[str, str] = os.environ) -> None:
        self.path, self.kept, self.env = Path(path), fallback == "plaintext", env

    def _read(self) -> dict[str, str]:
        return json.loads(self.path.read_text(encoding="utf-8")) if self.kept and self.path.exists() else {}

    def _write(self, found: dict[str, str]) -> None:
        self.path.parent.mkdir(parents=True, exist_ok=True)
        part = self.path.with_name(self.path.name + ".part")
        part.unlink(missing_ok=True)  # touch gives its mode to new files only
        part.touch(mode=0o600)
        part.write_text(json.dumps(found, indent=1, sort_keys=True), encoding="utf-8")
        part.replace(self.path)

    def find(self, kind: str, name: str) -> str:
        """The secret, or an empty text."""
        key = secret_name(kind, name)
        return self.env.get(key) or self._read().get(key, "")

    def get(self, kind: str, name: str) -> str:
        found = self.find(kind, name)
        if not found:
            raise NotFound(f"no secret in {secret_name(kind, name)}" + (f" nor in {self.path}" if self.kept else ""))
        return found

    def keep(self, kind: str, name: str, value: str) -> None:
        if not self.kept:
            raise Invalid("secrets.fallback", "never", f"a secret is kept only with --allow-plaintext; else put it into {secret_name(kind, name)}")
        self._write({**self._read(), secret_name(kind, name): value})

    def forget(self, kind: str, name: str) -> None:
        found = self._read()
        if found.pop(secret_name(kind, name), None) is not None:
            self._write(found)


def secret(kind: str, name: str, env: Mapping[str, str] = os.environ) -> str:
    """A secret from the environment alone."""
    return Secrets(os.devnull, env=env).get(kind, name)
