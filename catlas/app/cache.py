"""Answers of a describer kept by prompt, each file whole, checked and safely named."""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable
from pathlib import Path

_SAFE = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789-_")


def segment(name: str) -> str:
    """A name as one path segment: other bytes, and a leading dot, as %XX."""
    out = "".join(chr(b) if chr(b) in _SAFE or (b == 46 and i) else f"%{b:02X}" for i, b in enumerate(name.encode()))
    return out or "%00"


def file_name(key: str) -> str:
    """The segment with a digest, so that names differing in case only stay apart."""
    return f"{segment(key)}-{hashlib.sha256(key.encode()).hexdigest()[:8]}.json"


def _sum(payload: object) -> str:
    return hashlib.sha256(json.dumps(payload, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def write(path: Path, key: str, signal: str, payload: object) -> None:
    path.parent.mkdir(parents=True, exist_ok=True)
    part = path.with_name(f"{path.name}.{uuid.uuid4().hex}.part")  # a task that is run twice at a time has its own
    part.touch(mode=0o600)
    part.write_text(json.dumps({"key": key, "signal": signal, "sum": _sum(payload), "payload": payload}), encoding="utf-8")
    part.replace(path)


def read(path: Path, key: str, signal: str) -> object | None:
    """The payload; None if it is missing, broken, another key's or under another or no signal."""
    try:
        held = json.loads(path.read_text(encoding="utf-8"))
        if signal and held["key"] == key and held["signal"] == signal and held["sum"] == _sum(held["payload"]):
            return held["payload"]
    except (OSError, ValueError, KeyError, TypeError):
        pass
    return None


def _place(folder: Path, prompt: str) -> tuple[Path, str]:
    key = hashlib.sha256(prompt.encode()).hexdigest()
    return folder / file_name(key), key


def kept_answer(folder: Path, prompt: str) -> dict | None:
    path, key = _place(folder, prompt)
    return read(path, key, key)


def keep_answer(folder: Path, prompt: str, answer: dict) -> None:
    path, key = _place(folder, prompt)
    write(path, key, key, answer)


def cached(describer: Callable[[str], dict], folder: str | Path) -> Callable[[str], dict]:
    """Answers given before cost nothing: their usage counts as 0."""

    def call(prompt: str) -> dict:
        if (held := kept_answer(Path(folder), prompt)) is not None:
            return {n: v if n == "reply" else 0 for n, v in held.items()}
        answer = describer(prompt)
        keep_answer(Path(folder), prompt, answer)
        return answer

    return call


def retried(describer: Callable[[str], dict], attempts: int = 3, wait: float = 1.0) -> Callable[[str], dict]:
    def call(prompt: str) -> dict:
        for k in range(attempts):
            try:
                return describer(prompt)
            except Exception:
                if k == attempts - 1:
                    raise
                time.sleep(wait * 2**k)
        raise AssertionError("unreachable")

    return call


def metered(describer: Callable[[str], dict], spent: dict[str, float]) -> Callable[[str], dict]:
    """Adds the usage of each real call to `spent`; innermost, so that answers from a cache don't count."""

    def call(prompt: str) -> dict:
        answer = describer(prompt)
        for name, n in answer.items():
            if name != "reply":
                spent[name] = spent.get(name, 0) + n
        return answer

    return call
