"""Text expressions: white space, digests, cells, sizes, signatures, types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The Unicode white space set, digest length, caps and units.
SPACE = r"\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
SPACE_IN_LINE = SPACE.replace(r"\n", "")
#: The same set, character by character.
SPACES = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
DIGEST_CHARS = 16
MAX_DEFINITION = 50_000
PROMPT_BODY_CHARS = 16_000
CELL_CHARS = 200
RETURNS = "(returns)"


def trim(c: Column) -> Column:
    """Strip Unicode white space at both ends; trim() would take spaces only, and a pattern would try every character in between."""
    return F.btrim(c, F.lit(SPACES))


def trim_end(c: Column) -> Column:
    return F.rtrim(c, F.lit(SPACES))


def digest(c: Column) -> Column:
    return F.substring(F.sha2(c.cast("binary"), 256), 1, DIGEST_CHARS)


def normalise(body: Column) -> Column:
    """CRLF to LF, no white space at line ends, none around the whole."""
    unix = F.replace(body, F.lit("\r\n"), F.lit("\n"))
    return trim(F.regexp_replace(unix, rf"(?md)[{SPACE_IN_LINE}]+$", ""))


def flag(c: Column) -> Column:
    """The spellings of true that catalogs use; anything else is false."""
    return F.coalesce(F.lower(trim(c)).isin("1", "true", "t", "yes", "y"), F.lit(False))


def number(c: Column) -> Column:
    """A whole number, or 0 for what can't be read as one."""
    return F.coalesce(F.when(c.rlike(r"\A[+-]?[0-9]+\z"), c.try_cast("bigint")), F.lit(0).cast("long"))


def cell(c: Column) -> Column:
    """A value that can't end a cell or a row early. translate() would look up every character."""
    for sign in "\t\n\r":
        c = F.replace(c, F.lit(sign), F.lit(" "))
    return trim(c)


def sample_cell(c: Column) -> Column:
    return F.substring(F.translate(c, "\t\n", "  "), 1, CELL_CHARS)


def size(kb: Column) -> Column:
    """Kilobytes in the unit a person would use, halves rounded away from zero."""
    in_unit = lambda n: F.round(kb / F.lit(float(n)), 0).cast("long").cast("string")
    return F.when(kb >= 1048576, F.concat(in_unit(1048576), F.lit(" GB"))).when(kb >= 1024, F.concat(in_unit(1024), F.lit(" MB"))).otherwise(F.concat(kb.cast("string"), F.lit(" KB")))


def parameters(params: Column) -> Column:
    """name type, with out for outputs, comma-separated; the return row is left out."""
    real = F.filter(params, lambda p: p["name"] != RETURNS)
    return F.array_join(F.transform(real, lambda p: F.concat(p["name"], F.lit(" "), p["type"], F.when(p["output"], F.lit(" out")).otherwise(F.lit("")))), ", ")


def returns(params: Column) -> Column:
    """The return row's type, or table where there is none."""
    row = F.filter(params, lambda p: p["name"] == RETURNS)
    return F.when(F.size(row) > 0, F.element_at(row, 1)["type"]).otherwise(F.lit("table"))


def split_type(rendered: Column) -> Column:
    """(type, length): the first parenthesis and what is left around it."""
    length = F.regexp_extract(rendered, r"\([^)]*\)", 0)
    rest = F.regexp_replace(rendered, r"\A([^(]*)\([^)]*\)", "$1")
    return F.struct(F.when(length == "", rendered).otherwise(trim(rest)).alias("type"), length.alias("length"))


# Types that have a width, in bytes or as precision and scale.
SCALED = ("decimal", "numeric")
SIZED = ("varchar", "nvarchar", "char", "nchar", "varbinary", "binary")


def width(kind: Column, max_length: Column, precision: Column, scale: Column) -> Column:
    """(n), (p,s) or (max); lengths are bytes, which n-types halve."""
    known = max_length.rlike(r"\A[+-]?[0-9]+\z")
    n = number(max_length)
    chars = F.when(kind.startswith("n"), (n / 2).cast("long")).otherwise(n)
    return (
        F.when(kind.isin(*SCALED), F.concat(F.lit("("), precision, F.lit(","), scale, F.lit(")")))
        .when(~kind.isin(*SIZED) | ~known, F.lit(""))
        .when(n == -1, F.lit("(max)"))
        .otherwise(F.concat(F.lit("("), chars.cast("string"), F.lit(")")))
    )


def stamp(ts: Column) -> Column:
    """UTC, to the second, with a Z; the session's time zone must be UTC."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")


def age_hours(built: Column, now: Column) -> Column:
    return (F.unix_millis(now.cast("timestamp")) - F.unix_millis(built.cast("timestamp"))) / F.lit(3_600_000.0)


def human_age(hours: Column) -> Column:
    """Whole days from one day on, otherwise whole hours."""
    days, whole = F.floor(hours / 24), F.floor(hours)
    named = lambda n, unit: F.concat(n.cast("string"), F.when(n == 1, F.lit(f" {unit}")).otherwise(F.lit(f" {unit}s")))
    return F.when(days > 0, named(days, "day")).otherwise(named(whole, "hour"))
