"""Phone numbers and dates in text, as arrays of structs."""

from __future__ import annotations

from calendar import month_abbr
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions.text import strip

#: From the most explicit spelling to ten digits in a row.
PHONES = (
    "\\((\\d{3})\\)\\s*(\\d{3})[- ]?(\\d{4})",
    "(\\d{3})-(\\d{3})-(\\d{4})",
    "(\\d{3})/(\\d{3})-(\\d{4})",
    "(\\d{3})\\s+(\\d{3})\\s+(\\d{4})",
    "(\\d{3})[\\s\\-/.](\\d{3})[\\s\\-.]?(\\d{4})",
    "(?<!\\d)(\\d{3})(\\d{3})(\\d{4})(?!\\d)",
)
NOT_PHONES = ("\\d{5}-\\d{4}", "\\d{1,2}/\\d{1,2}/\\d{2,4}", "\\d{4}/\\d{2}/\\d{2}")
WHOLE_DATE = "^\\d{1,2}[/\\-]\\d{1,2}[/\\-]\\d{2,4}$"
MONTHS = "|".join(month_abbr[1:])
DATES = (
    ("(\\d{1,2})[/\\-](\\d{1,2})[/\\-](\\d{4})", "MM/DD/YYYY"),
    ("(\\d{1,2})[/\\-](\\d{1,2})[/\\-](\\d{2})(?!\\d)", "MM/DD/YY"),
    (f"(?i)({MONTHS})[a-z]*\\.?\\s+(\\d{{1,2}}),?\\s+(\\d{{4}})", "Month DD, YYYY"),
)


def _length_until(parts: Column, n: Column) -> Column:
    return F.aggregate(F.slice(parts, F.lit(1), n), F.lit(0), lambda a, x: a + F.length(x))


def spans(c: Column, pattern: str) -> Column:
    """array<struct<a,b>>: where the pattern matches; found from the lengths of what lies between matches."""
    found, between = F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), F.split(c, pattern, -1)

    def span(m: Column, i: Column) -> Column:
        start = _length_until(between, i + 1) + _length_until(found, i)
        return F.struct(start.alias("a"), (start + F.length(m)).alias("b"))

    return F.transform(found, span)


PHONE_TYPE = "array<struct<raw:string,area_code:string,prefix:string,line:string,normalized:string>>"


def phones(c: Column) -> Column:
    """The phone numbers of a text, each once, in order of spelling; none that overlaps a date or ZIP+4."""
    wrong = F.concat(*[spans(c, p) for p in NOT_PHONES])
    found = []
    for p in PHONES:
        parts = F.arrays_zip(spans(c, p).alias("at"), *[F.regexp_extract_all(c, F.lit(p), F.lit(g)).alias(n) for g, n in enumerate(("raw", "area_code", "prefix", "line"))])
        kept = F.filter(parts, lambda m: ~F.exists(wrong, lambda s: (m["at"]["a"] < s["b"]) & (m["at"]["b"] > s["a"])))
        found.append(
            F.transform(
                kept,
                lambda m: F.struct(m["raw"].alias("raw"), m["area_code"].alias("area_code"), m["prefix"].alias("prefix"), m["line"].alias("line"), F.concat(F.lit("("), m["area_code"], F.lit(") "), m["prefix"], F.lit("-"), m["line"]).alias("normalized")),
            )
        )
    every = F.concat(*found)
    # One fold keeps the first of each number, without naming the long array twice.
    once = F.aggregate(every, F.array().cast(PHONE_TYPE), lambda acc, x: F.when(F.exists(acc, lambda y: y["normalized"] == x["normalized"]), acc).otherwise(F.concat(acc, F.array(x))))
    # Only text with digits pays for all of this.
    return F.when(c.rlike("\\d{3}") & ~strip(c).rlike(WHOLE_DATE), once).otherwise(F.array().cast(PHONE_TYPE))


def is_date_or_zip(c: Column) -> Column:
    s = strip(c)
    patterns = ("^\\d{5}(-\\d{4})?$", WHOLE_DATE, "^\\d{1,2}[/\\-]\\d{1,2}[/\\-]\\d{2,4}\\s+\\d{1,2}:\\d{2}", "[A-Za-z]+,?\\s+[A-Za-z]{2}\\s+\\d{5}(-\\d{4})?$")
    return reduce(lambda a, p: a | s.rlike(p), patterns[1:], s.rlike(patterns[0]))


def phone_kind(c: Column) -> Column:
    """fax, phone, or empty; fax words win."""
    return F.when(c.rlike("(?i)\\b(FAX|FACSIMILE|TELECOPY)\\b"), "fax").when(c.rlike("(?i)\\b(PHONE|TELEPHONE|TEL|CALL)\\b"), "phone").otherwise("")


def phone_validation(found: Column) -> Column:
    """struct<status, phones>; ten equal digits make a number invalid.  The patterns fix all lengths."""

    def checked(p: Column) -> Column:
        digits = F.concat(p["area_code"], p["prefix"], p["line"])
        issues = F.when(digits.rlike("^(\\d)\\1{5,}$"), F.array(F.lit("repeated_digits")))
        return F.struct(p["raw"].alias("raw"), p["normalized"].alias("normalized"), p["area_code"].alias("area_code"), p["prefix"].alias("prefix"), p["line"].alias("line"), F.length(digits).alias("total_digits"), issues.alias("issues"))

    made = F.transform(found, checked)
    status = F.when(F.size(found) == 0, "none").when(F.exists(made, lambda p: p["issues"].isNotNull()), "invalid").otherwise("valid")
    return F.struct(status.alias("status"), made.alias("phones"))


def mentions_phone(c: Column) -> Column:
    return (c.rlike("(?i)phone|fax|tel|call") | c.rlike("\\(\\d{3}\\)")) & c.rlike("\\d{3}")


def _dates_of(c: Column, pattern: str, name: str) -> Column:
    parts = F.arrays_zip(*[F.regexp_extract_all(c, F.lit(pattern), F.lit(g)).alias(n) for g, n in enumerate(("raw", "first", "second"))])
    numbers = F.lit(name != DATES[2][1])

    def made(m: Column) -> Column:
        month, day = m["first"].try_cast("int"), m["second"].try_cast("int")
        bad_month, bad_day, zero = numbers & ~month.between(1, 12), numbers & ~day.between(1, 31), numbers & (day == 0)
        issues = F.array_compact(F.array(F.when(bad_month, F.lit("invalid_month")), F.when(bad_day, F.lit("invalid_day")), F.when(zero, F.lit("missing_digit"))))
        return F.struct(m["raw"].alias("raw"), F.lit(name).alias("format"), (F.size(issues) == 0).alias("valid"), issues.alias("issues"))

    return F.transform(parts, made)


def dates(c: Column) -> Column:
    """struct<status, dates>: dates in three spellings, with month and day checked where they are numbers."""
    found = [_dates_of(c, pattern, name) for pattern, name in DATES]
    every = F.concat(*found)
    status = F.when(F.size(every) == 0, "none").when(F.exists(every, lambda d: ~d["valid"]), "suspicious").otherwise("valid")
    return F.struct(status.alias("status"), every.alias("dates"))


def mentions_date(c: Column) -> Column:
    return c.rlike("\\d+[/\\-]") | c.rlike(f"(?i)({MONTHS})")
