"""Fill-in-the-middle: a text's middle is moved behind its prefix and suffix, cut at the ends of units.

While the units of a text (lines, or code points) are counted, a sparse index
records the byte and code-point offsets of every EVERY-th unit. A cut after any
unit is then one binary search in the index and a rescan of less than EVERY
units. Only offsets leave the Python pass; texts are cut by bytes in Spark.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass, field
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Units of a text's UTF-8 bytes; each covers the text without gaps.
LINES = rb"[^\n]*\n|[^\n]+"
CODE_POINTS = rb"[\x00-\x7F\xC0-\xFF][\x80-\xBF]*"
#: Units from one checkpoint to the next.
EVERY = 64


@dataclass(frozen=True)
class Marks:
    """What leads prefix, suffix and middle. No mark may begin with a character that another holds further on."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def every(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle


def code_points(raw: bytes, start: int, end: int) -> int:
    return len(raw[start:end].decode("utf-8", "replace"))


@dataclass
class Checkpoints:
    """The units of a text, counted once, with the offsets of every `every`-th."""

    raw: bytes
    unit: re.Pattern[bytes]
    every: int = EVERY
    n: int = 0
    units: list[int] = field(default_factory=lambda: [0])
    bytes_at: list[int] = field(default_factory=lambda: [0])
    points_at: list[int] = field(default_factory=lambda: [0])

    def __post_init__(self) -> None:
        for n, m in enumerate(self.unit.finditer(self.raw), 1):
            self.n = n
            if n % self.every == 0:
                self.points_at.append(self.points_at[-1] + code_points(self.raw, self.bytes_at[-1], m.end()))
                self.units.append(n)
                self.bytes_at.append(m.end())

    def after(self, n: int) -> tuple[int, int]:
        """(bytes, code points) of the first `n` units."""
        k = bisect_right(self.units, n) - 1
        start = end = self.bytes_at[k]
        for m in islice(self.unit.finditer(self.raw, start), n - self.units[k]):
            end = m.end()
        return end, self.points_at[k] + code_points(self.raw, start, end)


def cutter(unit: bytes = LINES, every: int = EVERY):
    """A column function of (UTF-8 bytes, two whole numbers): the units and where both cuts fall.

    The cuts come after (number mod (units + 1)) units, the smaller one first.
    """

    @F.pandas_udf("n long, bytes_1 long, points_1 long, bytes_2 long, points_2 long")
    def cut(raw: pd.Series, one: pd.Series, other: pd.Series) -> pd.DataFrame:
        pattern, out = re.compile(unit, re.DOTALL), []
        for text, h1, h2 in zip(raw, one, other, strict=True):
            index = Checkpoints(text, pattern, every)
            first, second = sorted((h1 % (index.n + 1), h2 % (index.n + 1)))
            out.append((index.n, *index.after(first), *index.after(second)))
        return pd.DataFrame(out, columns=["n", "bytes_1", "points_1", "bytes_2", "points_2"])

    return cut


def numbers(ident: Column, seed: int) -> list[Column]:
    """Four fixed pseudo-random numbers under 2^32 of a row's id; a null id counts as empty."""
    hexes = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(ident.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(hexes, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 7, percent: int = 100, spm_percent: int = 50, marks: Marks = Marks(), unit: bytes = LINES, every: int = EVERY) -> DataFrame:
    """One row per document: id, n (its units), form, prefix_chars, middle_chars, output.

    `percent` of the texts are transformed, `spm_percent` of these with the suffix
    first (spm), the others with the prefix first (psm); form and cuts follow from
    the id alone, so rows of one id and text come out alike. A null text counts as
    empty. Empty texts and texts that hold a mark stay plain: their output is the
    text, prefix_chars and middle_chars are null. A text of any length, in one unit
    or very many, is cut by the same rule; an empty table gives no rows. Other
    columns are never read, whatever their names.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    h1, h2, h3, h4 = numbers(F.col("id"), seed)
    raw = F.col("text").cast("binary")
    held = F.lit(False)
    for mark in marks.every():
        held = held | F.contains(F.col("text"), F.lit(mark))
    form = F.when((F.col("text") == "") | held | (h3 % 100 >= percent), "plain").when(h4 % 100 < spm_percent, "spm").otherwise("psm")
    cut = rows.select("id", "text", form.alias("form"), cutter(unit, every)(raw, h1, h2).alias("cut"))

    def piece(start: Column, length: Column) -> Column:
        return F.substring(F.col("text").cast("binary"), start.cast("int") + 1, length.cast("int")).cast("string")

    first, second = F.col("cut.bytes_1"), F.col("cut.bytes_2")
    prefix, middle = piece(F.lit(0), first), piece(first, second - first)
    suffix = piece(second, F.octet_length("text") - second)
    psm = F.concat(F.lit(marks.prefix), prefix, F.lit(marks.suffix), suffix, F.lit(marks.middle), middle)
    spm = F.concat(F.lit(marks.suffix), suffix, F.lit(marks.prefix), prefix, F.lit(marks.middle), middle)
    moved = F.col("form") != "plain"
    return cut.select(
        "id",
        F.col("cut.n").alias("n"),
        "form",
        F.when(moved, F.col("cut.points_1")).alias("prefix_chars"),
        F.when(moved, F.col("cut.points_2") - F.col("cut.points_1")).alias("middle_chars"),
        F.when(~moved, F.col("text")).when(F.col("form") == "psm", psm).otherwise(spm).alias("output"),
    )


def restored(output: Column, form: Column, marks: Marks = Marks()) -> Column:
    """The text that an output was made from: transformed texts hold each mark once."""
    parts = F.split(output, "|".join(rf"\Q{m}\E" for m in marks.every()), -1)
    part = lambda k: F.get(parts, F.lit(k))
    psm = F.concat(part(1), part(3), part(2))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(F.concat(part(2), part(3), part(1)))
