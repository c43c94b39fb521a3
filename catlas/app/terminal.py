"""What a command may ask of a person, and colour.

Only secrets are asked for: any other missing value is an error that names it.
"""

from __future__ import annotations

import getpass
import os
import sys
from collections.abc import Callable, Mapping
from typing import TextIO

# ANSI attributes.
STYLES = {"bold": "\x1b[1m", "red": "\x1b[31m", "green": "\x1b[32m", "yellow": "\x1b[33m", "gray": "\x1b[90m"}
RESET = "\x1b[0m"


class Terminal:
    """Streams of a command. It asks only where both ends are a terminal and `never_ask` is off, so that a script is never held up."""

    def __init__(self, never_ask: bool = False, stdin: TextIO | None = None, stdout: TextIO | None = None, env: Mapping[str, str] = os.environ, hidden: Callable[[str], str] = getpass.getpass) -> None:
        self.stdin, stdout = stdin or sys.stdin, stdout or sys.stdout
        self.can_ask = self.stdin.isatty() and stdout.isatty() and not never_ask
        self.colour = stdout.isatty() and not env.get("NO_COLOR") and env.get("TERM") != "dumb"
        self._hidden = hidden

    def secret(self, label: str) -> str:
        """A secret typed without echo; EOFError (a cancelled command) where the input ends."""
        return self._hidden(f"{label}: ")

    def piped(self) -> str:
        """All of the input, without its last line end, so that a secret is no argument of a process."""
        return self.stdin.read().rstrip("\r\n")

    def paint(self, style: str, text: str) -> str:
        return f"{STYLES[style]}{text}{RESET}" if self.colour and style in STYLES else text
