"""What the command line asks for, keeps and colours."""

import io
import json
import sys

import pytest

from catlas.app import cli, output, terminal
from catlas.sources import guarded


class Tty(io.StringIO):
    def isatty(self):
        return True


@pytest.fixture
def secretive(tmp_path, monkeypatch):
    """A runner of commands at a terminal where `typed` answers, and the secrets that sources were opened with."""
    seen, asked, typed = [], [], ["hush"]

    def opened(record, secret):
        seen.append(secret)
        raise guarded.explain("connection timed out" if secret == "hush" else "login failed", guarded.Connection("postgres", "h"))

    def hidden(label):
        asked.append(label)
        if not typed:
            raise EOFError
        return typed[0]

    monkeypatch.setattr(cli, "open_source", opened)
    monkeypatch.setattr(cli, "Terminal", lambda never: terminal.Terminal(never, sys.stdin, Tty(), {}, hidden))

    def run(*words, given="", tty=True):
        monkeypatch.setattr(sys, "stdin", (Tty if tty else io.StringIO)(given))
        return cli.main(["--config", str(tmp_path / "c.json"), "--quiet", *words])

    return run, seen, asked, typed, tmp_path / ".catlas-secrets.json"


ADD = ("connection", "add", "far", "--engine", "postgres", "--host", "h", "--auth", "scram", "--username", "u")


def test_secrets_are_kept_only_if_allowed(secretive):
    run, seen, asked, typed, file = secretive
    assert run(*ADD, "--password-stdin", given="hush\n") == output.VALIDATION and not file.exists() and not seen
    assert run(*ADD) == output.NOT_FOUND and not asked  # it couldn't be kept, so it isn't asked for
    assert run("--allow-plaintext", *ADD, "--password-stdin", given="hush\n", tty=False) == 0 and seen == ["hush"]
    assert file.stat().st_mode & 0o777 == 0o600 and json.loads(file.read_text()) == {"CATLAS_CONNECTION_FAR_SECRET": "hush"}
    assert "hush" not in (file.parent / "c.json").read_text()
    assert run("doctor", "far") == output.NOT_FOUND and run("config", "set", "secrets.fallback", "plaintext") == 0
    assert run("doctor", "far") == output.UNAVAILABLE and seen == ["hush", "hush"]
    assert run("connection", "remove", "far") == 0 and json.loads(file.read_text()) == {}


def test_only_secrets_are_asked_for_and_only_of_a_person(secretive, monkeypatch):
    run, seen, asked, typed, file = secretive
    assert run("--allow-plaintext", "connection", "add", "far", "--engine", "postgres") == output.VALIDATION and not asked
    assert run("--allow-plaintext", "--no-input", *ADD) == output.NOT_FOUND and run("--allow-plaintext", *ADD, tty=False) == output.NOT_FOUND and not asked
    typed[0] = "wrong"  # a refused secret isn't kept
    assert run("--allow-plaintext", *ADD) == output.AUTH and asked == ["password: "] and not file.exists()
    typed[0] = ""
    assert run("--allow-plaintext", *ADD) == output.VALIDATION
    typed.clear()
    assert run("--allow-plaintext", *ADD) == output.CANCELLED and not file.exists()
    typed.append("hush")
    assert run("--allow-plaintext", *ADD) == 0 and file.exists() and len(asked) == 4
    monkeypatch.setenv("CATLAS_CONNECTION_FAR_SECRET", "from outside")  # comes before the file
    assert run("--allow-plaintext", "doctor", "far") == output.AUTH and seen[-1] == "from outside" and len(asked) == 4


def test_colour_only_at_a_terminal(secretive, capsys):
    paint = lambda out, env: terminal.Terminal(False, Tty(), out, env).paint("red", "x")
    assert paint(Tty(), {}) == "\x1b[31mx\x1b[0m"
    assert paint(io.StringIO(), {}) == paint(Tty(), {"NO_COLOR": "1"}) == paint(Tty(), {"TERM": "dumb"}) == "x"
    run = secretive[0]
    assert run("--allow-plaintext", *ADD, "--no-verify") == 0
    capsys.readouterr()
    assert run("--allow-plaintext", "doctor", "far") == output.UNAVAILABLE and "\x1b[32mcredential" in capsys.readouterr().out
    assert run("--allow-plaintext", "-o", "json", "doctor", "far") == output.UNAVAILABLE and "\x1b" not in capsys.readouterr().out


def test_a_backends_secret_is_its_bearer_token(monkeypatch):
    sent = []

    def urlopen(request, timeout):
        sent.append(request.get_header("Authorization"))
        return io.BytesIO(b'{"reply": "{}"}')

    monkeypatch.setattr("urllib.request.urlopen", urlopen)
    record = {"provider": "http", "base_url": "http://localhost/x"}
    assert cli.describer(record, "key")("p") == cli.describer(record)("p") == {"reply": "{}"} and sent == ["Bearer key", None]
