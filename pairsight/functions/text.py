"""Text functions as column expressions. Classes such as white space are Unicode's throughout."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(text: Column | str) -> Column:
    return F.regexp_replace(_col(text), r"(?U)^\s+|\s+$", "")


def squash(text: Column | str) -> Column:
    """Display form: runs of white space become one space, none at the ends."""
    return strip(F.regexp_replace(_col(text), r"(?U)\s+", " "))


def nfkc(text: Column | str) -> Column:
    """Unicode normal form NFKC, for which Spark has no function of its own."""

    @F.pandas_udf("string")
    def form(s: pd.Series) -> pd.Series:
        return s.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))

    return form(_col(text))


def comparable(text: Column | str) -> Column:
    """Comparison form of a text that is in NFKC: comparison signs and dashes as ASCII, no space between sign and number, lower case. Not for display."""
    t = F.replace(F.replace(_col(text), F.lit("≥"), F.lit(">=")), F.lit("≤"), F.lit("<="))
    t = F.translate(t, "–—−µμ", "---uu")
    return F.lower(strip(F.regexp_replace(F.regexp_replace(t, r"(?U)\s+", " "), r"(?<=[<>=]) (?=[\d.])", "")))


def padded_slice(raw: Column | str, start: Column, end: Column) -> Column:
    """The columns from start to end of a line, as if it went on with spaces."""
    raw = _col(raw)
    return F.substring(F.rpad(raw, F.greatest(F.length(raw), end), F.lit(" ")), start + 1, end - start)


def trimmed(raw: Column, start: Column, end: Column) -> Column:
    """struct(start, end, text) of what is not blank between two columns; null where all is."""
    part = F.substring(raw, start + 1, F.greatest(F.least(end, F.length(raw)) - start, F.lit(0)))
    lead = F.length(part) - F.length(F.regexp_replace(part, r"(?U)^\s+", ""))
    text = strip(part)
    return F.when(F.length(text) > 0, F.struct((start + lead).cast("int").alias("start"), (start + lead + F.length(text)).cast("int").alias("end"), text.alias("text")))


def number(x: Column) -> Column:
    """A number as briefly as it can be written, to six decimal places."""
    plain = x.cast("decimal(38,6)").cast("string")
    return F.regexp_replace(plain, r"\.?0+$", "")


def clip(text: Column, width: int) -> Column:
    """At most width characters, the last one an ellipsis where something is cut off."""
    return F.when(F.length(text) <= width, text).otherwise(F.concat(F.substring(text, 1, width - 1), F.lit("…")))


def mask(key: Column) -> Column:
    """Enough of a key to tell it from another, no more."""
    return F.when(F.length(key) <= 8, F.repeat(F.lit("*"), F.length(key))).otherwise(F.concat(F.substring(key, 1, 6), F.lit("..."), F.right(key, F.lit(4))))


def numbered(line: Column, raw: Column) -> Column:
    return F.format_string("%4d| %s", line, raw)


def loose_pattern(quote: Column) -> Column:
    """A pattern for a quotation whose white space may differ."""
    return F.concat(F.lit(r"\Q"), F.array_join(F.split(strip(quote), r"(?U)\s+"), r"\E(?U:\s+)\Q"), F.lit(r"\E"))


def found_at(text: Column | str, pattern: Column) -> Column:
    """How many characters a text has before the first place that a pattern is found in; -1 where it isn't.

    Spark's own function counts a character beyond the first 65,536 twice, so a text with one is cut up to the place instead.
    """
    text = _col(text)
    before = F.call_function("regexp_substr", text, F.concat(F.lit("(?s)^.*?(?:"), pattern, F.lit(")")))
    by_length = F.coalesce(F.length(before) - F.length(F.call_function("regexp_substr", text, pattern)), F.lit(-1))
    return F.when(text.rlike(r"[\x{10000}-\x{10FFFF}]"), by_length).otherwise(F.call_function("regexp_instr", text, pattern) - 1)
