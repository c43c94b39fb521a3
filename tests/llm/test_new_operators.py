"""Fill-in-the-middle, click windows and the language network against plain loops."""

import datetime as dt
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from catlas.llm import click_windows, fill_middle, language_net
from catlas.llm.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


def rounded(v):
    return f"{v:.9g}" if isinstance(v, float) else repr(v)


@pytest.mark.parametrize("name", ["op12_click_windows", "op13_fill_middle"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("clicks", "documents"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    df, want = QUERIES[name](spark, DATA), con.sql(ORACLE_SQL[name])
    columns = sorted(want.columns)
    assert columns == sorted(df.columns)
    places = [want.columns.index(c) for c in columns]
    assert sorted(tuple(rounded(r[c]) for c in columns) for r in df.collect()) == sorted(tuple(rounded(r[i]) for i in places) for r in want.fetchall())


# Fill-in-the-middle


@pytest.mark.parametrize("unit", [fill_middle.LINES, fill_middle.CODE_POINTS])
@pytest.mark.parametrize("every", [1, 3, 64])
def test_checkpoints_equal_plain_cuts(unit, every):
    rng = random.Random(every)
    for _ in range(60):
        text = "".join(rng.choice("aé😀\n\n ") for _ in range(rng.randrange(0, 300)))
        units = re.findall(unit.decode("latin-1") if unit == fill_middle.LINES else "(?s).", text)
        index = fill_middle.Checkpoints(text.encode(), re.compile(unit, re.DOTALL), every)
        assert index.n == len(units) and len(index.units) == 1 + index.n // every
        for n in range(index.n + 1):
            head = "".join(units[:n])
            assert index.after(n) == (len(head.encode()), len(head))


def plain_fim(ident, text, seed=7):
    h = hashlib.sha256(f"{seed}:{'' if ident is None else ident}".encode()).hexdigest()
    h1, h2, _, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(lines)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if not text or any(k in text for k in ("<P>", "<S>", "<M>")):
        return n, "plain", None, None, text
    if h4 % 100 < 50:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fim_of_odd_rows(spark):
    texts = [None, "", "\n", "no end", "a\nb", "é\n😀\n\nz", "has <P> in it\nb", "<S", "x<\n<P\nM>\n>", "line\n" * 50_000, "y" * 1_000_000, " \n" * 7, "a\nb", "tab\t\r\nend\r\n"]
    rows = [(None if k % 5 == 4 else k % 9, t, "clash", 3) for k in range(4) for t in texts for k in (k, k + 20)] * 2
    docs = spark.createDataFrame([(i if t is not None else None, t, c, n) for i, t, c, n in rows], "doc_id long, text string, output string, n int")
    out = fill_middle.transform(docs)
    got = out.withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    want = sorted(([i, *plain_fim(i, t), t or ""] for i, t, _, _ in ((r["doc_id"], r["text"], 0, 0) for r in docs.collect())), key=repr)
    assert sorted(([r["id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["back"]] for r in got), key=repr) == want
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    assert fill_middle.transform(docs.limit(0)).count() == 0


def test_fim_by_code_points_and_shares(spark):
    docs = spark.createDataFrame([(k, f"text é {k}") for k in range(300)], "doc_id long, text string")
    got = fill_middle.transform(docs, percent=40, spm_percent=0, unit=fill_middle.CODE_POINTS).collect()
    assert {r["form"] for r in got} == {"plain", "psm"} and 60 < sum(r["form"] == "psm" for r in got) < 180
    assert all(r["n"] == len(f"text é {r['id']}") for r in got)
    back = fill_middle.transform(docs, unit=fill_middle.CODE_POINTS).select("id", fill_middle.restored(F.col("output"), F.col("form")).alias("t")).collect()
    assert all(r["t"] == f"text é {r['id']}" for r in back)


# Click windows


def plain_windows(rows, batches, hold=48, late=24):
    """rows: (batch, key, hour, digest)."""
    out, windows, top = [], {}, None
    for batch in range(batches):
        mine = [r for r in rows if r[0] == batch and (top is None or r[2] >= top - late)]
        for _, key, hour, digest in sorted(mine, key=lambda r: (repr(r[1]), r[2], r[3])):
            w = windows.get(key)
            if w and hour > w[0] + hold:
                out.append((key, w[0], batch, *w[1:]))
                w = None
            if w is None:
                windows[key] = [hour, 0, 0, 0, digest.hex()]
                continue
            w[1] += 1
            if digest.hex() != w[4]:
                w[2] += 1
                w[3] += zlib.crc32(digest.hex().encode())
        hours = [r[2] for r in rows if r[0] <= batch]
        top = max(hours) if hours else None
        for key, w in list(windows.items()):
            if batch == batches - 1 or top is not None and w[0] + hold < top - late:
                out.append((key, w[0], batch, *w[1:]))
                del windows[key]
    return sorted(out, key=repr)


def as_rows(df, key="click_id"):
    return sorted(((r[key], r["start_hour"], r["closed_batch"], r["n_repeats"], r["n_conflicts"], r["conflict_crc"], r["hash"]) for r in df.collect()), key=repr)


def digest(n):
    return hashlib.sha256(str(n).encode()).digest()


def test_windows_equal_plain_loop_also_when_keys_are_folded(spark):
    rng = random.Random(4)
    rows = []
    for _ in range(6000):
        batch = rng.randrange(0, 5)
        batch += batch == 3  # an empty batch
        key = rng.choice([None, None, -7, 0, 1, *range(2, 60)])
        rows.append((batch, key, 1000 + 40 * batch + rng.randrange(-60, 90), digest(rng.randrange(0, 40 if key else 6))))
    rows += rows[:500]
    df = spark.createDataFrame([(b, k, h, d, 1, "x") for b, k, h, d in rows], "batch int, click_id long, hour long, hash binary, n int, mark string")
    want = plain_windows(rows, 6)
    assert any(r[0] is None for r in want) and max(r[3] for r in want) > 20
    assert as_rows(click_windows.deduplicate(df, 6)) == want
    assert as_rows(click_windows.deduplicate(df, 6, hot_rows=25)) == want
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    assert before is None or "RocksDB" not in before


def test_copies_of_odd_clicks(spark):
    at = dt.datetime(2024, 1, 1, 0, 59, 59, 999999)
    early = dt.datetime(1969, 12, 31, 23, 30)
    rows = [(5, at, at, 1, "a|b", 2.345, None, "x"), (5, at, at, 1, "a|b", 2.345, None, "x"), (None, None, at, None, None, None, "p", "x"), (-1, early, early, 1, "k", -0.5, "", "x"), (7, at, None, 1, "k", 1.0, "", "x")]
    df = spark.createDataFrame(rows, "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, props string, batch string")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        got = sorted(((r["click_id"], r["hour"], r["hash"].hex()) for r in click_windows.copies(df).collect()), key=repr)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    want = []
    for click, ts, arrived, client, kind, value, props, _ in rows[:4]:
        micros = lambda t: (t - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1)
        for j in range(max((click or 0) % 3 if (click or 0) >= 0 else 0, 0) + 1):
            c = zlib.crc32(f"{'' if click is None else click}:{j}".encode())
            said = [client, kind, None if value is None else int(np.floor(100 * value + 0.5)), None if ts is None else micros(ts), props, c % 3]
            want.append((click, micros(arrived) // 3_600_000_000 + 6 * j * (c % 10), hashlib.sha256("|".join("" if v is None else str(v) for v in said).encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    none = click_windows.deduplicate(click_windows.copies(df.limit(0)), 10)
    assert none.count() == 0 and none.columns[0] == "click_id"


# Language


def test_gradients_equal_differences():
    rng = np.random.default_rng(2)
    net = language_net.ByteNet.new(["a", "b", "c"])
    for part in net.parts():
        part += rng.normal(0, 0.05, part.shape).astype(np.float32)
    windows, y = rng.integers(97, 123, (6, language_net.LENGTH)).astype(np.uint8), np.array([0, 1, 2, 0, 1, 1])

    def loss():
        return -np.log(net.probabilities(net.pooled(windows)[0])[np.arange(6), y].astype(float)).mean()

    for part, grad in zip(net.parts(), net.gradients(windows, y), strict=True):
        flat, want = part.reshape(-1), grad.reshape(-1)
        for i in np.argsort(-abs(want))[:5]:
            old, step = flat[i], 1e-2
            flat[i] = old + step
            up = loss()
            flat[i] = old - step
            down = loss()
            flat[i] = old
            assert (up - down) / (2 * step) == pytest.approx(want[i], rel=0.08, abs=2e-3)


def test_pooled_equals_sliding_filters():
    net = language_net.ByteNet.new(["a", "b"])
    windows, *_ = language_net.cut([b"short", b"x" * 700, bytes(range(256)) * 2])
    assert windows.shape == (6, language_net.LENGTH)
    got, at = net.pooled(windows, where=True)
    for r, row in enumerate(windows):
        x = net.embed[row]
        for k, w in enumerate(language_net.WIDTHS):
            values = np.array([x[i : i + w].reshape(-1) @ net.filters[k] for i in range(len(row) - w + 1)])
            span = slice(k * language_net.FILTERS, (k + 1) * language_net.FILTERS)
            assert np.allclose(got[r, span], values.max(0), atol=1e-4)
            assert np.allclose(values[at[k][r], range(language_net.FILTERS)], values.max(0), atol=1e-4)


def test_windows_cover_texts_once():
    _, owner, adds = language_net.cut([b"", b"a" * 256, b"b" * 300, b"c" * 1000])
    assert np.bincount(owner, adds).tolist() == [256, 256, 300, 1000]


def test_held_out_language_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = QUERIES["op11_language"](spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == r["lang"] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_of_odd_rows(spark):
    some = [(k, "the and of with that " * 3 if k % 2 else "der die und nicht ein " * 3, "en" if k % 2 else "de", "z") for k in range(40)]
    odd = [(None, None, "en", "z"), (100, "", "de", "z"), (101, "123 ### \n", "en", "z"), (102, "THE AND OF WITH THAT", None, "z"), (103, "der die und nicht ein " * 40_000, None, "z"), (103, "der die und nicht ein " * 40_000, None, "z"), (None, "the and", "en", "z")]
    docs = spark.createDataFrame(some + odd, "doc_id long, text string, lang string, lang_pred string")
    net = language_net.train(docs, F.lit(True))
    predict = language_net.predictor(net)
    rows = [(r["doc_id"], r["text"], r["v"]["lang_pred"], r["v"]["score"]) for r in docs.select("doc_id", "text", predict("text").alias("v")).collect()]
    assert net.langs == ["de", "en"] and len(rows) == len(some + odd)
    for ident, text, lang, score in rows:
        if text is None or not any(c.isalpha() for c in text):
            assert (lang, score) == ("und", 0.0)
        else:
            assert lang == ("de" if "der" in text else "en") and score > 0.5, ident
    empty = docs.limit(0)
    assert language_net.train(empty, F.lit(True)) is None
    assert {r["v"]["lang_pred"] for r in docs.select(language_net.predictor(None)("text").alias("v")).collect()} == {"und"}
    assert empty.select(predict("text")).count() == 0
