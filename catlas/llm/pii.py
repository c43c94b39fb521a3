"""Personal data: exact base patterns, and bootstrapped contextual extraction.

Base spans (email, ip, card, phone) seed the method. Every seed and every other
identifier-like word stands in lexical patterns: the two words before it, and the
word before with the word after. Identifier-like are words with a digit or an @,
runs of digit groups, and addresses that spell their at or dots. Patterns and
instances form a bipartite graph whose edges are counted over the whole corpus.
Spark scores both sides in rounds: patterns that enough seeds support accept their
other instances, which support further patterns in the next round. What is
identifier-like in patterns of high confidence becomes new spans.

One pass over whole texts writes spans and occurrences; everything after that
works on those slim rows.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize

KINDS = ("email", "ip", "card", "phone")
#: Rounds of scoring; a pattern's least confidence and least number of different accepted instances.
ROUNDS, CONFIDENCE, SUPPORT = 3, 0.8, 5
#: Characters above which a word or value stands in the graph by its digest.
LONG = 40
#: Pulls the confidence of patterns with few instances down.
SMOOTHING = 1.0

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_LOCAL_CHARS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(WORD)
_POSSIBLE = re.compile(r"[0-9@]")
_TOKEN = re.compile(r"\S+")
_FIRST = re.compile(r"[\w@]")
_LINE_END = re.compile(r"[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]")
#: Least characters of an identifier-like word between its outer marks, and least digits of a run of groups.
LEAST = 5
_GROUP = re.compile(r"[0-9()+/.-]+")
#: Words that may stand alone between the groups of a run.
_BETWEEN = frozenset("-/\u2013")
_AT = re.compile(r"(?<![^\W_])at(?![^\W_])", re.IGNORECASE)
_AT_INSIDE = re.compile(r"[\[({<]at[\])}>]|(?<=[^\W_])(?:_at_|-at-)(?=[^\W_])", re.IGNORECASE)
_DOTTED = re.compile(r"\w\.\w|\w[\[({<]dot[\])}>]\w|[^\W_](?:_dot_|-dot-)[^\W_]", re.IGNORECASE)
_AT_WORDS = frozenset(("at", "[at]", "(at)", "{at}", "<at>"))
_DOT_WORDS = frozenset(("dot", "[dot]", "(dot)", "{dot}", "<dot>"))


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches without overlap, found from each @ in time linear in the text."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            done = m.end()
            at = text.find("@", done)
        else:
            done = at + 1
            at = text.find("@", at + 1)
    return out


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, rank of the kind, end) of all base matches, sorted; null counts as empty."""
    text = text or ""
    if not _POSSIBLE.search(text):
        return []
    out = []
    if "@" in text:
        out += [(s, 0, e) for s, e in _emails(text)]
    for m in _IP.finditer(text):
        if all(_small(p) for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = re.sub(r"[\x20-]", "", m.group()) if m.end() - m.start() < 64 else ""
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def _small(part: str) -> bool:
    """At most 255, without reading a very long number."""
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def _core(text: str, start: int, end: int) -> tuple[int, int]:
    """The part of a word between its outer marks; + and a parenthesis that open a number are kept."""
    m = _FIRST.search(text, start, end)
    if not m:
        return start, start
    s = m.start()
    while end > s and not (text[end - 1].isalnum() or text[end - 1] == "_"):
        end -= 1
    if end > s and text[s] in "0123456789":
        plus = parenthesis = False
        while s > start:
            if text[s - 1] == "+" and not plus:
                plus = True
            elif text[s - 1] == "(" and not parenthesis and text.find(")", s, end) >= 0:
                parenthesis = True
            else:
                break
            s -= 1
    return s, end


def _runs(text: str, tokens: list[tuple[int, int]], free: Callable[[int, int], bool]) -> list[tuple[int, int]]:
    """Two or more neighbouring words of one line that are digits with the marks of phone numbers."""
    out: list[tuple[int, int]] = []
    run: list[tuple[int, int]] = []
    last, open_end = -3, False

    def close() -> None:
        if len(run) > 1 and sum(c in "0123456789" for c in text[run[0][0] : run[-1][1]]) >= LEAST:
            out.append((run[0][0], run[-1][1]))
        run.clear()

    for k, (start, end) in enumerate(tokens):
        if not _POSSIBLE.search(text, start, end):
            continue
        s, e = _core(text, start, end)
        if s == e or not _GROUP.fullmatch(text, s, e) or not free(s, e):
            continue
        if s > start and e < end and text[s - 1] == "(" and text[e] == ")":
            s, e = s - 1, e + 1
            s -= s > start and text[s - 1] == "+"
        near = last == k - 1 or (last == k - 2 and text[tokens[k - 1][0] : tokens[k - 1][1]] in _BETWEEN)
        if not (near and open_end and s == start and not _LINE_END.search(text, tokens[last][1], start)):
            close()
        run.append((s, e))
        last, open_end = k, e == end
    close()
    return out


def _addresses(text: str, tokens: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Addresses that spell their at, in one word or several of one line: a bare word `at` needs a dot after it."""
    starts = [s for s, _ in tokens]
    cores: dict[int, tuple[int, int]] = {}

    def core(k: int) -> tuple[int, int]:
        if k not in cores:
            cores[k] = _core(text, *tokens[k])
        return cores[k]

    def is_word(k: int, left: bool, right: bool) -> bool:
        """Token k is no link, and has no mark on a side where the address goes on."""
        if not 0 <= k < len(tokens):
            return False
        (s, e), (cs, ce) = tokens[k], core(k)
        return cs < ce and not link(k, _AT_WORDS) and not link(k, _DOT_WORDS) and (not left or cs == s) and (not right or ce == e)

    def link(k: int, words: frozenset[str]) -> bool:
        return 0 <= k < len(tokens) and tokens[k][1] - tokens[k][0] <= 5 and text[slice(*tokens[k])].lower() in words

    def one_line(k: int, j: int) -> bool:
        return not _LINE_END.search(text, tokens[k][1], tokens[j][0])

    out = []
    done = -1
    for m in _AT.finditer(text):
        k = bisect_right(starts, m.start()) - 1
        if k <= done:
            continue
        if link(k, _AT_WORDS):
            first, final = k - 1, k + 1
            if not (is_word(first, False, True) and is_word(final, True, False) and one_line(first, final)):
                continue
            bare = tokens[k][1] - tokens[k][0] == 2
        elif is_word(k, False, False) and _AT_INSIDE.search(text, *core(k)):
            first = final = k
            bare = False
        else:
            continue
        dotted = bool(_DOTTED.search(text, *core(final)))
        while is_word(first, True, False) and link(first - 1, _DOT_WORDS) and is_word(first - 2, False, True) and one_line(first - 2, first):
            first -= 2
        while is_word(final, False, True) and link(final + 1, _DOT_WORDS) and is_word(final + 2, True, False) and one_line(final, final + 2):
            final, dotted = final + 2, True
        if dotted or not bare:
            out.append((core(first)[0], core(final)[1]))
            done = final
    return out


def named(value: str) -> str:
    """A lower-cased word or value, whole; a long one by its digest, so that no two fall together."""
    value = value.lower()
    return value if len(value) <= LONG else "#" + hashlib.blake2b(value.encode("utf-8", "replace"), digest_size=16).hexdigest()


def occurrences(text: str, spans: list[tuple[int, int, int]]) -> list[dict]:
    """Seeds and what is identifier-like with their patterns; rank is -1 for those that are no seed.

    A word inside a run of groups or a spelled address keeps only the patterns
    that the longer one has not, so that no place counts twice for a pattern.
    Runs and addresses don't cross line ends; [ at ] with inner blanks and an
    identifier under five characters in one word are none.
    """
    words = [(m.start(), m.end()) for m in _WORD.finditer(text)]
    starts = np.array([s for s, _ in words])
    ends = np.array([e for _, e in words])
    taken_from = np.array(sorted(s for s, _, _ in spans))
    taken_to = np.maximum.accumulate(np.array([e for _, e in sorted((s, e) for s, _, e in spans)])) if spans else taken_from

    def free(s: int, e: int) -> bool:
        k = int(np.searchsorted(taken_from, e)) - 1
        return k < 0 or bool(taken_to[k] <= s)

    tokens = [(m.start(), m.end()) for m in _TOKEN.finditer(text)]
    wide = sorted({x for x in (*_runs(text, tokens, free), *_addresses(text, tokens)) if free(*x)})
    found: list[tuple[int, int, int]] = [*spans, *((s, -1, e) for s, e in wide)]
    known = set(wide)
    for start, end in tokens:
        if _POSSIBLE.search(text, start, end):
            s, e = _core(text, start, end)
            if e - s >= LEAST and (s, e) not in known and free(s, e):
                found.append((s, -1, e))
    out = []
    word = lambda k: named(text[words[k][0] : words[k][1]]) if 0 <= k < len(words) else "^"

    def patterns(s: int, e: int) -> tuple[str, str]:
        i, j = int(np.searchsorted(ends, s, side="right")), int(np.searchsorted(starts, e))
        return f"{word(i - 2)} {word(i - 1)} _", f"{word(i - 1)} _ {word(j)}"

    longer_from = [s for s, _ in wide]
    for s, rank, e in found:
        k = bisect_right(longer_from, s) - 1
        inside = rank < 0 and k >= 0 and (s, e) not in known and e <= wide[k][1]
        held = patterns(*wide[k]) if inside else ()
        for pattern in patterns(s, e):
            if pattern not in held:
                out.append({"start": s, "end": e, "rank": rank, "value": named(text[s:e]), "pattern": pattern})
    return out


_FIELDS = "start long, end long, rank int, value string, pattern string"


def extract(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One written row per document: row, id, base (start, rank, end) and seen (its occurrences)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bases, seen = [], []
            for text in batch["text"]:
                spans = base_spans(text)
                bases.append([{"start": s, "rank": r, "end": e} for s, r, e in spans])
                seen.append(occurrences(text, spans) if text and (_POSSIBLE.search(text) or _AT.search(text)) else [])
            yield pd.DataFrame({"id": batch["id"], "base": bases, "seen": seen})

    id_type = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = slim.mapInPandas(run, f"id {id_type}, base array<struct<start:long, rank:int, end:long>>, seen array<struct<{_FIELDS.replace(' ', ':').replace(',:', ', ')}>>")
    return materialize(found.withColumn("row", F.monotonically_increasing_id()), "pii-spans")


def score_patterns(extracted: DataFrame, rounds: int = ROUNDS, confidence: float = CONFIDENCE, support: int = SUPPORT) -> DataFrame:
    """Patterns of high confidence with the kind their instances mostly have: pattern, kind_rank, confidence.

    A seed is accepted for its kind with score 1. In each round a pattern takes
    part if `support` different accepted instances of one kind stand in it; its
    confidence is the sum of the scores of its accepted instances over the number of all its different
    instances, smoothed. Patterns of `confidence` or more score their instances:
    one minus the chance that all those patterns err, for the best kind. An
    instance of that score or more is accepted, and supports patterns in the
    next round, so patterns without `support` seeds of their own are reached.
    """
    each = extracted.select(F.explode("seen").alias("o")).select("o.pattern", "o.value", "o.rank")
    edges = materialize(each.groupBy("pattern", "value").agg(F.max("rank").alias("rank")), "pii-edges")
    accepted = edges.filter("rank >= 0").groupBy("value").agg(F.max("rank").alias("kind_rank")).withColumn("score", F.lit(1.0))
    seeds = accepted = materialize(accepted, "pii-seeds")
    # Patterns of too few different instances can't be supported in any round.
    able = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= support)
    graph = materialize(edges.select("pattern", "value").join(able, "pattern"), "pii-graph")
    patterns = None
    for k in range(rounds):
        held = graph.join(accepted, "value").groupBy("pattern", "n", "kind_rank").agg(F.sum("score").alias("sum"), F.count(F.lit(1)).alias("support"))
        most = held.groupBy("pattern", "n").agg(F.max_by(F.struct("kind_rank", "support"), F.struct("sum", -F.col("kind_rank"))).alias("m"), F.sum("sum").alias("sum"))
        rated = most.filter(F.col("m.support") >= support).select("pattern", F.col("m.kind_rank").alias("kind_rank"), (F.col("sum") / (F.col("n") + SMOOTHING)).alias("confidence"))
        patterns = materialize(rated.filter(F.col("confidence") >= confidence), "pii-patterns")
        if k + 1 < rounds:
            fails = F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-6))))
            found = graph.join(patterns, "pattern").groupBy("value", "kind_rank").agg((1 - F.exp(fails)).alias("score"))
            best = found.groupBy("value").agg(F.max_by(F.struct("kind_rank", "score"), F.struct("score", -F.col("kind_rank"))).alias("b")).select("value", "b.*")
            new = best.filter(F.col("score") >= confidence).join(seeds, "value", "left_anti")
            accepted = materialize(seeds.unionByName(new), "pii-accepted")
    return patterns


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS, confidence: float = CONFIDENCE, support: int = SUPPORT) -> DataFrame:
    """One row per document: id, base and added, sorted (start, rank, end) spans in code points.

    `added` spans are identifier-like words, runs and addresses, without overlap
    with base spans, in a pattern of high confidence; their rank is that of the
    pattern's kind. Those that overlap become one, with the rank of the longest.
    Null and empty texts have no spans; repeated rows are each returned; an
    empty table gives no rows. A text of any length is read whole, by one task;
    columns but the id and the text are never read, whatever their names.
    """
    extracted = extract(docs, id_col, text_col)
    patterns = score_patterns(extracted, rounds, confidence, support)
    new = extracted.select("row", F.explode("seen").alias("o")).filter("o.rank < 0").select("row", "o.pattern", "o.start", "o.end").join(patterns, "pattern")
    once = new.groupBy("row", "start", "end").agg(F.max_by("kind_rank", F.struct("confidence", -F.col("kind_rank"))).alias("rank"))
    in_row = Window.partitionBy("row").orderBy("start", "end")
    before = F.max("end").over(in_row.rowsBetween(Window.unboundedPreceding, -1))
    apart = once.withColumn("apart", F.coalesce(F.col("start") >= before, F.lit(True)).cast("int")).withColumn("part", F.sum("apart").over(in_row))
    longest = F.max_by("rank", F.struct(F.col("end") - F.col("start"), -F.col("start")))
    merged = apart.groupBy("row", "part").agg(F.min("start").alias("start"), longest.alias("rank"), F.max("end").alias("end"))
    added = merged.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "rank", "end"))).alias("added"))
    empty = F.array().cast("array<struct<start:bigint,rank:int,end:bigint>>")
    return extracted.select("row", "id", "base").join(added, "row", "left").select("id", "base", F.coalesce("added", empty).alias("added"))
