"""Acceptance criteria, reported measurements and other values, read from text by column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import comparable, number, strip

NUMBER = r"[-+]?\d+(?:\.\d+)?"
CRITERION = "struct<kind:string,op:string,value:double,low:double,high:double,unit:string,prefix:string,text:string>"
MEASUREMENTS = "array<struct<label:string,value:double,unit:string,source:string>>"
_RANGE = rf"({NUMBER})(?U:\s*)-(?U:\s*)({NUMBER})(?U:\s*)([a-zA-Z%µ°]*)"
_LIMIT = rf"(>=|<=)(?U:\s*)({NUMBER})(?U:\s*)(.*)$"
_UNIT = r"(?U:\s*)([a-zA-Z%µ]*)"
_REPORTED_RANGE = rf"(?i)\brange\b[^0-9\-+]{{0,12}}({NUMBER})(?U:\s*)[-–](?U:\s*)({NUMBER}){_UNIT}"
_LABELLED = rf"(?i)\b(min|minimum|max|maximum|mean|average)\b[^0-9\-+]{{0,12}}({NUMBER}){_UNIT}"
_AT = rf"(?i)\bat(?U:\s+)({NUMBER}){_UNIT}"
#: Names of standards bodies, which look like instruments when a number follows.
STANDARDS = ("ISO", "USP", "IEC", "EN", "ASTM", "BS")


def criterion(text: Column, form: Column | None = None) -> Column:
    """CRITERION from the text of a cell; null for a blank one. form: the text in NFKC, where that may differ."""
    c = comparable(text if form is None else form)
    read = lambda pattern, group: F.regexp_extract(c, pattern, group).try_cast("double")
    null, none = F.lit(None).cast("double"), F.lit("")
    limit_at = F.regexp_instr(c, F.lit(r">=|<="))

    def made(kind: str, op=none, value=null, low=null, high=null, unit=none, prefix=none, own=none) -> Column:
        return F.struct(F.lit(kind).alias("kind"), op.alias("op"), value.alias("value"), low.alias("low"), high.alias("high"), unit.alias("unit"), prefix.alias("prefix"), own.alias("text"))

    between = made("range", low=read(_RANGE, 1), high=read(_RANGE, 2), unit=F.regexp_extract(c, _RANGE, 3))
    before = F.regexp_replace(F.regexp_extract(c, rf"^(.*?)(?:{_LIMIT})", 1), r"^[ .,:;]+|[ .,:;]+$", "")
    limit = made("threshold", op=F.regexp_extract(c, _LIMIT, 1), value=read(_LIMIT, 2), unit=strip(F.regexp_extract(c, _LIMIT, 3)), prefix=before)
    return F.when(strip(text) == "", None).when(c.rlike(_RANGE) & (limit_at == 0), between).when(c.rlike(_LIMIT), limit).when(text.isNotNull(), made("qualitative", own=strip(text))).cast(CRITERION)


def outside(c: Column, value: Column) -> Column:
    """Whether a value lies outside a criterion. Bounds belong to it."""
    return F.when(c["kind"] == "range", (value < c["low"]) | (value > c["high"])).when(c["op"] == ">=", value < c["value"]).when(c["op"] == "<=", value > c["value"]).otherwise(F.lit(False))


def describe(c: Column) -> Column:
    """A criterion as text: its comparison, its bounds or its words."""
    limit = F.concat_ws(" ", c["op"], number(c["value"]), F.nullif(c["unit"], F.lit("")))
    between = F.concat_ws(" ", number(c["low"]), F.lit("-"), number(c["high"]), F.nullif(c["unit"], F.lit("")))
    return F.when(c["kind"] == "threshold", limit).when(c["kind"] == "range", between).otherwise(c["text"])


def _matches(text: Column, pattern: str | Column, build) -> Column:
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    group = lambda m, g: F.regexp_substr(m, pattern) if g == 0 else F.call_function("regexp_extract", m, pattern, F.lit(g))
    return F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), lambda m: build(m, lambda g: group(m, g)))


def measurements(text: Column, prefix: Column | None = None) -> Column:
    """MEASUREMENTS of a result: both ends of ranges, labelled values, values after "at" with a unit, values after the criterion's own words.

    In this order; of the last two kinds only values that nothing before has given.
    """
    s = F.translate(F.coalesce(text, F.lit("")), "–—", "--")
    row = lambda label, value, unit, source: F.struct(label.alias("label"), value.cast("double").alias("value"), unit.alias("unit"), source.alias("source"))
    ends = F.flatten(_matches(s, _REPORTED_RANGE, lambda m, g: F.array(row(F.lit("min"), g(1), g(3), m), row(F.lit("max"), g(2), g(3), m))))
    name = lambda label: F.when(label.isin("min", "minimum"), "min").when(label.isin("max", "maximum"), "max").otherwise("mean")
    labelled = _matches(s, _LABELLED, lambda m, g: row(name(F.lower(g(1))), g(2), g(3), m))
    seen = F.filter(_matches(s, _AT, lambda m, g: row(F.lit("observation"), g(1), g(2), m)), lambda x: x["unit"] != "")
    found = [ends, labelled, seen]
    if prefix is not None:
        words = F.concat(F.lit(r"(?i)\Q"), F.replace(prefix, F.lit(r"\E"), F.lit("")), F.lit(rf"\E(?U:\s+)({NUMBER}){_UNIT}"))
        found.append(F.when(F.coalesce(prefix, F.lit("")) == "", F.array().cast(MEASUREMENTS)).otherwise(_matches(s, words, lambda m, g: row(F.lit("observation"), g(1), g(2), m))))
    add = lambda acc, x: F.when((x["label"] == "observation") & F.exists(acc, lambda y: y["value"] == x["value"]), acc).otherwise(F.concat(acc, F.array(x)))
    return F.aggregate(F.concat(*found).cast(MEASUREMENTS), F.array().cast(MEASUREMENTS), add)


def worst_case(c: Column, values: Column) -> Column:
    """The measurements that could lie outside a criterion; never a mean, which says nothing about single units."""
    at_risk = lambda v: F.when(c["kind"] == "range", v["label"] != "mean").when(c["op"] == ">=", v["label"].isin("min", "observation")).when(c["op"] == "<=", v["label"].isin("max", "observation")).otherwise(F.lit(False))
    return F.filter(values, at_risk)


def integer(text: Column) -> Column:
    """The number that a text is, digits only; null for any other text."""
    return F.when(text.rlike(r"(?U)^\s*\d+\s*$"), strip(text)).try_cast("int")


def date(text: Column) -> Column:
    """The first day, English month and year of a text; null if there is none or no such day."""
    day = F.regexp_extract(text, r"\b(\d{1,2})(?U:\s+)([A-Za-z]+)(?U:\s+)(\d{4})\b", 0)
    return F.try_to_timestamp(F.regexp_replace(F.nullif(day, F.lit("")), r"(?U)\s+", " "), F.lit("d MMMM yyyy")).cast("date")


def temperatures(text: Column) -> Column:
    pattern = F.lit(rf"({NUMBER})(?U:\s*)°?(?U:\s*)C\b")
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), pattern, F.lit(1)), lambda x: x.cast("double"))


def qualifiers(text: Column) -> Column:
    """Times that a criterion in words sets, such as ``24 h``."""
    pattern = rf"(?i)\b({NUMBER})(?U:\s*)(h|hr|hrs|hours|min|minutes|s|days?)\b"
    return _matches(F.coalesce(text, F.lit("")), pattern, lambda m, g: F.concat(g(1), F.lit(" "), g(2)))


def instruments(text: Column) -> Column:
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\b([A-Z][A-Za-z]{2,}(?U:\s+)\d{3,5})\b"), F.lit(1))
    return F.filter(found, lambda t: ~F.upper(F.regexp_extract(t, "^[A-Za-z]+", 0)).isin(*STANDARDS))


def external_references(text: Column) -> Column:
    # fixed value: what a reference to a standard or to another document looks like
    pattern = r"\b(?:ISO|USP|IEC|EN|ASTM)\s*<?\d[\w\-<>.]*>?|\b[A-Z]{2,}-[A-Z0-9]+-\d+\b"
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))))


def stringency(wanted: Column, stated: Column) -> Column:
    """Whether a restated limit is less or more demanding; empty where they can't be compared."""
    same = (wanted["kind"] == "threshold") & (stated["kind"] == "threshold") & (wanted["op"] == stated["op"])
    return F.when(~F.coalesce(same, F.lit(False)), "").when(outside(wanted, stated["value"]), "less demanding").otherwise("more demanding")
