import hashlib
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from catlas.llm import pii, queries, secret_scan

BASE_PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_pii(text):
    out = []
    for rank, (kind, pattern) in enumerate(BASE_PII.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub(r"\D", "", m.group())
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and pii.luhn(digits)):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), rank, m.end()))
    return sorted(out)


def test_base_spans_equal_plain_patterns():
    rng = random.Random(11)
    parts = ["a@b.c", "@", ".", "x_y", "1", "23", " ", "-", "+", "(", "é", "4111 1111-1111 1111", "4111111111111111", "1.2.3.4", "999.1.1.1", "+1 (222) 555-0000", "%", "\n", "a.b-c@d-e.f.g"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(14)))
        assert pii.base_spans(text) == brute_pii(text), text


def test_base_spans_of_long_runs_are_linear():
    for text in ("a" * 300_000, "1" * 300_000, "999." * 100_000, "a@" * 100_000, "+1" + "(" * 300_000, "a." * 100_000 + "@"):
        assert pii.base_spans(text) == []
    assert pii.base_spans(None) == pii.base_spans("") == []


def test_context_finds_unseen_identifiers(spark):
    rows = [(i, f"Some words here. Contact mail to: user{i}@host.example.com and go on") for i in range(12)]
    rows += [(100, "Other words. Contact mail to: user77[at]hidden9 and go on"), (101, "plain text with room 12345 in it"), (102, None), (103, ""), (101, "plain text with room 12345 in it")]
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, row string, base int")
    got = [(r["id"], [tuple(x) for x in r["base"]], [tuple(x) for x in r["added"]]) for r in pii.find(docs, support=5, confidence=0.8).collect()]
    assert len(got) == len(rows)
    found = {i: (b, a) for i, b, a in got}
    at = dict(rows)[100].index("user77")
    assert found[100] == ([], [(at, 0, at + len("user77[at]hidden9"))])
    assert all(len(found[i][0]) == 1 and not found[i][1] for i in range(12))
    assert found[101] == found[102] == found[103] == ([], [])
    assert pii.find(docs.limit(0)).count() == 0


def test_found_instances_support_further_patterns(spark):
    """Members known from one phrase alone carry the next phrase, which no base span ever stands in."""
    one = [(k, t) for k, t in enumerate([f"Please send everything to: user{i}@host.example.com and go on" for i in range(100)] + [f"Please send everything to: member{i}[at]inner{i} and go on" for i in range(16)])]
    two = [(200 + i, f"Our reachable colleague is member{i}[at]inner{i} these days") for i in range(16)]
    last = [(300, "Our reachable colleague is hidden77[at]secret8 these days"), (301, "The unreachable colleague of room4711 these nights")]
    docs = spark.createDataFrame(one + two + last, "doc_id long, text string")
    added = lambda rounds: {r["id"]: len(r["added"]) for r in pii.find(docs, rounds=rounds).collect()}
    once, thrice = added(1), added(3)
    assert once[300] == 0 and thrice[300] == 1 and thrice[301] == once[301] == 0
    assert all(once[k] == 1 for k in range(100, 116)) and all(thrice[200 + i] == 1 for i in range(16))


def test_long_words_and_values_stay_apart():
    one, two = "a" * 300 + "1", "a" * 300 + "2"
    assert pii.named(one) != pii.named(two) and pii.named("ABC") == "abc"
    seen = [pii.occurrences(f"{w} x: id4711 {w}", []) for w in (one, two)]
    patterns = [{(o["value"], o["pattern"]) for o in s} for s in seen]
    assert not {p for v, p in patterns[0] if v == "id4711"} & {p for v, p in patterns[1] if v == "id4711"}
    assert {v for v, _ in patterns[0]} & {v for v, _ in patterns[1]} == {"id4711"}


def planted(seed):
    """(rows, spans to find): prose with seeds and with identifiers that no base pattern knows, and clean look-alikes."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijklmno") for _ in range(rng.randrange(3, 8)))
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    phrases = ["mail me at:", "reach them under", "the contact is", "write today to", "call my desk:"]
    rows, want = [], set()
    for i in range(1500):
        lead = " ".join(word() for _ in range(rng.randrange(5, 30)))
        kind = rng.random()
        if kind < 0.45:
            what = f"{word()}.{word()}@{word()}.org" if rng.random() < 0.7 else f"+49 {number(3)} {number(7)}"
        elif kind < 0.5:
            what = rng.choice([f"{word()}[at]{word()}{number(1)}", f"0{number(3)} {number(3)} {number(4)}", f"{word()} (at) {word()} (dot) org"])
        else:
            rows.append((i, f"{lead} in room{number(3)} on day {number(5)} {word()}"))
            continue
        text = f"{lead} {rng.choice(phrases)} "
        if kind >= 0.45:
            want.add((i, len(text), len(text) + len(what)))
        rows.append((i, f"{text}{what} please {word()}"))
    return rows, want


def test_planted_identifiers_are_found(spark):
    rows, want = planted(3)
    got = {(r["id"], x["start"], x["end"]) for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect() for x in r["added"]}
    assert len(got & want) >= 0.9 * len(want) and len(got & want) >= 0.95 * len(got)


HIDDEN = {
    "(user77[at]hidden9)": "user77[at]hidden9",
    "<user77[at]hidden9>": "user77[at]hidden9",
    '"user77[at]hidden9"': "user77[at]hidden9",
    "user77[at]hidden9,": "user77[at]hidden9",
    "+49/30/123456": "+49/30/123456",
    "(212)555/0100": "(212)555/0100",
    "((212)555/0100).": "(212)555/0100",
    "jane.doe[at]example.org": "jane.doe[at]example.org",
    "(jane.doe(at)example(dot)org)": "jane.doe(at)example(dot)org",
    "jane.doe [at] example [dot] org": "jane.doe [at] example [dot] org",
    "jane dot doe at example dot org": "jane dot doe at example dot org",
    '"jane.doe at example.org"': "jane.doe at example.org",
    "0151 555 123": "0151 555 123",
    "(0151 555 / 123456).": "0151 555 / 123456",
    "(212) 555 0100": "(212) 555 0100",
    "\u00a0user77[at]hidden9": "user77[at]hidden9",
}


@pytest.mark.parametrize("written", list(HIDDEN))
def test_marks_and_blanks_hide_no_identifier(written):
    text = f"Contact mail to: {written} and go on"
    seen = pii.occurrences(text, pii.base_spans(text))
    at = text.index(HIDDEN[written])
    span = (at, at + len(HIDDEN[written]))
    after = "contact mail" if written[0] == "\u00a0" else "mail to:"
    first = [(x["start"], x["end"]) for x in seen if x["rank"] < 0 and x["pattern"] == f"{after} _"]
    assert first == [span] or written[0] == "\u00a0" and span in [(x["start"], x["end"]) for x in seen]
    assert span in [(x["start"], x["end"]) for x in seen if x["pattern"].endswith("_ and")]


def test_prose_is_not_like_an_identifier():
    for text in ("we looked at the house. Then at night", "page 12 and 13 of 7", "in 2019. 45 people", "1 2\n3 4"):
        assert pii.occurrences(text, pii.base_spans(text)) == [], text


def test_candidates_of_long_runs_are_linear():
    for text in ("(" * 300_000 + "1", "1" + ")" * 300_000, "1 " * 100_000, "at " * 100_000, "a at b dot " * 20_000, "a.b at " * 30_000, "x" + " " * 300_000 + "at b.c"):
        pii.occurrences(text, [])


def test_hidden_identifiers_become_spans(spark):
    rows = [(i, f"Some words here. Contact mail to: user{i}@host.example.com and go on") for i in range(80)]
    hidden = [x for x in HIDDEN if x[0] != "\u00a0"]
    rows += [(100 + i, f"Other words. Contact mail to: {x} and go on") for i, x in enumerate(hidden)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["id"]: [r0["start"] for r0 in r["added"]] and [(x["start"], x["end"]) for x in r["added"]] for r in pii.find(docs).collect()}
    for i, x in enumerate(hidden):
        text = rows[80 + i][1]
        at = text.index(HIDDEN[x])
        assert found[100 + i] == [(at, at + len(HIDDEN[x]))], x


def test_clean_documents_get_no_added_spans(spark):
    rows = queries.op6_personal_data(spark, "/root/testdata/sf0.01").collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    for r in rows:
        want = brute_pii(docs[r["doc_id"]])
        named = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in want)
        assert r["base_sha256"] == hashlib.sha256(named.encode()).hexdigest()
        assert r["spans"] == named
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(x[1] == i for x in want) for i in range(4)]


ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


def brute_secrets(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in re.finditer(ASSIGN, text, re.I | re.A) if len(m.group(2)) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m.group()) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m.group()) >= 32]
    return sorted(out)


def secret_texts():
    rng = random.Random(2)
    parts = ["token", "SECRET", "=", ": ", "'", "abcdefgh", "abc", "AKIA" + "Z" * 12, "AKIAZ", "0123456789abcdef" * 2, "é", "😀", " ", "\n", "api_key", "passwd", "x"]
    return [None, "", "token=secret: abcdefghij", *["".join(rng.choice(parts) for _ in range(rng.randrange(16))) for _ in range(400)]]


def test_secrets_equal_plain_patterns(spark):
    texts = secret_texts() * 2
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, due string")
    got = {r["doc_id"]: [(x["start"], x["rank"], x["end"]) for x in (r["found"] or [])] for r in secret_scan.scan_all(docs).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert [x for x in got[i] if x[1] < 3] == brute_secrets(t), t


def test_ledger_scans_only_what_is_due(spark, tmp_path):
    ledger = secret_scan.Ledger(spark, str(tmp_path / "ledger"))
    schema = "path string, text string"
    first = spark.createDataFrame([("a", "token=abcdefgh1"), ("b", "token=abcdefgh1"), ("c", "clean")], schema)
    rules = secret_scan.RULES[:2]
    assert ledger.scan(first, "1", rules) and not ledger.scan(first, "1", rules)
    assert ledger.scanned().count() == 2 * 2 and ledger.findings().count() == 1
    second = spark.createDataFrame([("a", "clean"), ("d", "AKIA" + "Q" * 16), ("e", "token=abcdefgh1")], schema)
    assert ledger.scan(second, "2", rules)
    assert ledger.scanned().count() == 3 * 2
    newer = (secret_scan.Rule("assign", 2, r"abcdefgh\d"), rules[1])
    assert ledger.scan(second, "3", newer)
    assert ledger.scanned().filter("version = 2").count() == 3 and ledger.scanned().count() == 9
    report = {(r["path"], x["kind"], x["start"]) for r in ledger.report(second, newer, keep=("path",)).collect() for x in r["found"] or []}
    assert report == {("d", "access", 0), ("e", "assign", 6)}
    (tmp_path / "ledger" / "4" / "findings").mkdir(parents=True)  # a batch that never committed
    assert ledger.batches() == ["1", "2", "3"] and ledger.scan(first, "4", newer)
    assert secret_scan.scan_all(first.withColumnRenamed("path", "doc_id").limit(0)).count() == 0


def test_extra_rules_add_spans(spark):
    text = "x ghp_" + "a1B2" * 9 + " -----BEGIN RSA PRIVATE KEY----- y"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = secret_scan.scan_all(docs).collect()[0]
    assert [(text[x["start"] : x["end"]][:6], x["kind"]) for x in row["found"]] == [("ghp_a1", "github"), ("-----B", "private_key")]


def test_private_key_is_found_whole(spark):
    key = "-----BEGIN EC PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0A\n\nMIIB+/=\n-----END EC PRIVATE KEY-----"
    texts = [f"x {key} y", "-----BEGIN PRIVATE KEY-----\nno end", key + key, "-----BEGIN PUBLIC KEY-----"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: [(x["start"], x["end"]) for x in r["found"] or []] for r in secret_scan.scan_all(docs).collect()}
    assert got == {0: [(2, 2 + len(key))], 1: [(0, 27)], 2: [(0, len(key)), (len(key), 2 * len(key))], 3: []}


#: A piece that each rule might run on for ever from, repeated to a megabyte.
ADVERSARIAL = {
    "assign": ["password", "password ", "token=\"", "secret:" + " " * 50, "a.b="],
    "access": ["AKIA", "AKIAQ-"],
    "hex": ["0123456789abcde", "0123456789abcdef0123456789abcde "],
    "github": ["ghp_", "ghp_a1"],
    "private_key": [" A", "-----BEGIN ", "-----BEGIN A PRIVATE KEY-----", "-----BEGIN A PRIVATE KEY-----\n-", "- PRIVATE KEY-----"],
}


def test_long_adversarial_texts_are_scanned(spark):
    rows = [(kind, (piece * (1_000_000 // len(piece)))) for kind, pieces in ADVERSARIAL.items() for piece in pieces]
    rows += [("private_key", "-----BEGIN" + " A" * 500_000 + " PRIVATE KEY-----"), ("private_key", "-----BEGIN PRIVATE KEY-----" + "a" * 1_000_000), ("assign", "password" + " " * 1_000_000)]
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    began = time.monotonic()
    got = {r["doc_id"]: r["found"] or [] for r in secret_scan.scan_all(docs).collect()}
    assert time.monotonic() - began < 90
    whole = len(rows) - 3
    assert [(x["start"], x["end"], x["kind"]) for x in got[whole]] == [(0, len(rows[whole][1]), "private_key")]
    assert [(x["start"], x["end"]) for x in got[whole + 1] if x["kind"] == "private_key"] == [(0, 27)] and not got[whole + 2]
    assert spark.range(3).count() == 3  # the session is alive


def test_second_batch_moves_unseen_texts_only(spark, tmp_path):
    ledger = secret_scan.Ledger(spark, str(tmp_path / "ledger"))
    first = spark.createDataFrame([(i, f"text {i} token=abcdefgh{i}") for i in range(40)] + [(None, None)], "doc_id long, text string")
    assert ledger.scan(first, "1")
    both = first.unionByName(spark.createDataFrame([(1, "changed AKIA" + "Q" * 16), (2, "changed AKIA" + "Q" * 16), (2, None)], first.schema))
    texts = both.select(secret_scan.blob_id(F.col("text")).alias("blob"), F.coalesce("text", F.lit("")).alias("text"))
    assert [(r["text"], len(r["due"])) for r in ledger.due(texts, secret_scan.RULES).collect()] == [("changed AKIA" + "Q" * 16, len(secret_scan.RULES))]
    assert ledger.scan(both, "2") and ledger.scanned().count() == 42 * len(secret_scan.RULES)
    report = {(r["doc_id"], x["kind"]) for r in ledger.report(both, keep=("doc_id",)).collect() for x in r["found"] or []}
    assert report == {(i, "assign") for i in range(40)} | {(1, "access"), (2, "access")}


@pytest.mark.parametrize("name", ["op8_secret_scan"])
def test_secret_query_digest(spark, name):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in queries.QUERIES[name](spark, "/root/testdata/sf0.001").collect():
        named = ",".join(f"{secret_scan.BASE[k]}:{s}:{e}" for s, k, e in brute_secrets(docs[r["doc_id"]]))
        assert r["base_sha256"] == hashlib.sha256(named.encode()).hexdigest() and r["spans"] == named
