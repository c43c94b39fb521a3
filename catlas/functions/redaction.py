"""Secrets in bodies, personal data by column name, and types never sampled."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values. Java's \b and \s differ from the ASCII ones meant here, so both are spelt out;
# (?iu) folds case as widely as the patterns' first home does.
_KEY = r"(?iu)(?<![0-9A-Za-z_])"
_EQUALS = r"([\t\n\f\r ]*=[\t\n\f\r ]*)"
_VALUE = r"""(?:'[^'\n]*'|"[^"\n]*"|[^\t\n\f\r ,;'")]+)"""
REDACTED = "<redacted>"

#: (class, pattern, replacement, what a text must hold to match), applied in this order, each to what
#: the one before has left. Every pattern is found in time linear in the text: words and addresses are
#: only tried from their first character (or from the end of the match before), and never given back.
RULES = (
    ("password", _KEY + r"(\w*(?:password|pwd))" + _EQUALS + _VALUE, "$1$2" + REDACTED, "="),
    ("connection-string", _KEY + r"(data source|initial catalog|integrated security)" + _EQUALS + r"""[^;'"\n]+""", "$1$2" + REDACTED, "="),
    ("api-key", _KEY + r"(api[_-]?key|access[_-]?token|client[_-]?secret|secret[_-]?key)" + _EQUALS + _VALUE, "$1$2" + REDACTED, "="),
    ("bearer-token", _KEY + r"Bearer[\t\n\f\r ]+[A-Za-z0-9._\-]{12,}", "Bearer " + REDACTED, ""),
    ("email", r"(?:(?<![A-Za-z0-9._%+\-])|\G)[A-Za-z0-9._%+\-]++@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}", "<email>", "@"),
)

# Fixed values.
#: (class, pattern over a column's name); the first that matches names the class.
PERSONAL = (
    ("email", "e?mail"),
    ("phone", "phone|mobile|fax"),
    ("government-id", "ssn|socialsecurity|nationalid|taxid|vatid"),
    ("birth", r"birth|dob(?![0-9A-Za-z_])"),
    ("password", "password|secret|token"),
    ("name", "first_?name|last_?name|middle_?name|full_?name|maiden"),
    ("address", "address|street|city|zip|postal|county|province"),
    ("financial", "card|cvv|ccnum|iban|routing|accountnumber"),
    ("location", "latitude|longitude|geoloc"),
    ("biometric", "signature|photo|avatar"),
)

# Fixed values.
UNSAMPLEABLE = ("image", "varbinary", "binary", "bytea", "geography", "geometry", "hierarchyid", "sql_variant", "timestamp", "rowversion")


def _stage(state: Column, pattern: str, replacement: str, hint: str) -> Column:
    """[struct<text, hits>] after one more rule."""

    def counted(s: Column) -> Column:
        possible = F.coalesce(F.contains(s["text"], F.lit(hint)), F.lit(False)) if hint else s["text"].isNotNull()
        n = F.when(possible, F.regexp_count(s["text"], F.lit(pattern))).otherwise(F.lit(0))
        return F.struct(s["text"].alias("text"), s["hits"].alias("hits"), n.alias("n"))

    def replaced(s: Column) -> Column:
        text = F.when(s["n"] > 0, F.regexp_replace(s["text"], pattern, replacement)).otherwise(s["text"])
        return F.struct(text.alias("text"), F.concat(s["hits"], F.array(s["n"])).alias("hits"))

    return F.transform(F.transform(state, counted), replaced)


def redact(body: Column) -> Column:
    """struct<text, counts>: the body without its secrets, and how many of each class went.

    Each stage is the element of an array, so that it is computed once though
    three expressions read it. A null body stays null, without counts.
    """
    state = F.array(F.struct(body.alias("text"), F.array().cast("array<int>").alias("hits")))
    for _, pattern, replacement, hint in RULES:
        state = _stage(state, pattern, replacement, hint)
    classes = F.array(*[F.lit(r[0]) for r in RULES])
    done = F.transform(state, lambda s: F.struct(s["text"].alias("text"), F.map_filter(F.map_from_arrays(classes, s["hits"]), lambda _, n: n > 0).alias("counts")))
    return F.element_at(done, 1)


def classify(name: Column) -> Column:
    """The class of personal data that a column's name tells of, or null."""
    return F.coalesce(*[F.when(name.rlike(f"(?iu){p}"), F.lit(c)) for c, p in PERSONAL])


def sampleable(kind: Column) -> Column:
    return ~F.lower(F.trim(kind)).isin(*UNSAMPLEABLE)


def total(counts: Column) -> Column:
    return F.aggregate(F.map_values(counts), F.lit(0), lambda a, n: a + n)


def summary(counts: Column) -> Column:
    """class n, ... in the order of the classes' names; none without any."""
    listed = F.array_sort(F.map_entries(counts))
    return F.when(F.size(counts) > 0, F.array_join(F.transform(listed, lambda e: F.concat(e["key"], F.lit(" "), e["value"].cast("string"))), ", ")).otherwise(F.lit("none"))


