"""Coercion of spreadsheet cells, given as text, to typed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that stand for no value.
SENTINELS = ("", "-", "--", "n/a", "na", "null", "none", "nil")
# Marks of currency.
CURRENCIES = ("pkr", "rs", "usd", "eur", "gbp", "$", "€", "£")
# Date patterns in the order in which they are tried.
DATE_PATTERNS = ("yyyy-MM-dd", "dd/MM/yyyy", "dd-MM-yyyy", "d MMM yyyy", "MMM d, yyyy", "yyyy/MM/dd")
KINDS = ("text", "decimal", "percent", "date", "boolean")


def is_blank(raw: Column) -> Column:
    return raw.isNull() | F.lower(F.trim(raw)).isin(*SENTINELS)


def _once(value: Column, then) -> Column:
    """``then(value)``, with ``value`` worked out once however often ``then`` uses it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _number(bare: Column) -> Column:
    """The value of a text without marks and spaces; in parentheses it is negative."""
    negative = bare.rlike(r"^\(.*\)$")
    number = _once(F.regexp_replace(bare, r"^\((.*)\)$", "$1"), lambda digits: F.when(digits.rlike(r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"), digits).try_cast("decimal(38,10)"))
    return _once(F.struct(number.alias("n"), negative.alias("minus")), lambda x: F.when(x["minus"], -x["n"]).otherwise(x["n"]))


def decimal(raw: Column) -> Column:
    """Currency marks, thousands separators and spaces go; parentheses mean a negative number; null if it isn't one."""
    marks = r"(?i)\b(?:pkr|rs|usd|eur|gbp)\b\.?|[$€£]"
    bare = F.regexp_replace(F.regexp_replace(F.trim(raw), marks, ""), r"[,\s]", "")
    return F.when(~is_blank(raw), _once(bare, _number))


def percent(raw: Column) -> Column:
    """A text with a percent sign is divided by a hundred; one without is taken as it is."""
    number = decimal(F.regexp_replace(raw, "%", ""))
    divisor = F.when(F.contains(raw, F.lit("%")), F.lit(100)).otherwise(F.lit(1))
    return (number / divisor).cast("decimal(38,10)")


def date(raw: Column) -> Column:
    """The first pattern that fits."""
    return F.coalesce(*[F.try_to_date(F.trim(raw), p) for p in DATE_PATTERNS])


def boolean(raw: Column) -> Column:
    low = F.lower(F.trim(raw))
    return F.when(low.isin("true", "yes", "y", "1"), True).when(low.isin("false", "no", "n", "0"), False)


def coerced(raw: Column, kind: str) -> Column:
    """struct(value as text, ok, raw): blanks are null and fine, what can't be read is null and not fine."""
    value = {"text": raw, "decimal": decimal(raw).cast("string"), "percent": percent(raw).cast("string"), "date": date(raw).cast("string"), "boolean": boolean(raw).cast("string")}[kind]
    value = F.when(~is_blank(raw), value)
    return F.struct(value.alias("value"), (is_blank(raw) | value.isNotNull()).alias("ok"), raw.alias("raw"))


def column_index(letters: Column) -> Column:
    """A to 1, Z to 26, AA to 27."""
    return F.aggregate(F.split(letters, ""), F.lit(0), lambda s, c: s * 26 + F.ascii(c) - 64)


def column_letters(index: int) -> str:
    out = ""
    while index:
        index, rest = divmod(index - 1, 26)
        out = chr(65 + rest) + out
    return out
