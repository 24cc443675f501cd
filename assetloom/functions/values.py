"""Typed-value expressions: coercing parses, dates, ids, number formats, value maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MICROS = 86_400_000_000
DATE_FORMAT = "yyyy-MM-dd"

# Fixed value: the ISO-8601 shapes accepted for a date or date-time text.
_ISO = (
    r"^\d{4}-\d{2}-\d{2}"
    r"([T ]\d{2}:\d{2}(:\d{2}([.]\d{1,9})?)?(Z|[+-]\d{2}:\d{2}(:\d{2})?)?)?$"
)


def to_long(c: Column) -> Column:
    """Whole number or null: a fraction, text or empty value gives null."""
    number = c.cast("string").try_cast("double")
    direct = c.cast("string").try_cast("bigint")
    exact = F.when(
        number.isNotNull() & ~F.isnan(number) & (F.abs(number) < F.lit(9.0e18)) & (number == F.floor(number)),
        number.try_cast("bigint"),
    )
    plain = F.when(c.cast("string").rlike(r"^\s*[+-]?\d+\s*$"), direct)
    return F.coalesce(plain, exact)


def to_number(c: Column) -> Column:
    return c.cast("string").try_cast("double")


def to_time(c: Column) -> Column:
    """Timestamp, or null when the text cannot be read."""
    return F.try_to_timestamp(c.cast("string"))


def to_count(c: Column) -> Column:
    """Number or 0, cut to a whole number."""
    return F.coalesce(to_number(c).try_cast("bigint"), F.lit(0).cast("bigint"))


def date_text(c: Column) -> Column:
    return F.date_format(c, DATE_FORMAT)


def normalise_date(c: Column) -> Column:
    """``yyyy-MM-dd`` text, each value read on its own; unreadable gives null."""
    return date_text(to_time(c))


def iso_to_utc_date(c: Column) -> Column:
    """ISO-8601 text to its UTC date whatever the session's zone; else the date in the first ten characters; else null."""
    text = c.cast("string")
    zoned = F.when(text.rlike(_ISO) & text.rlike(r"(Z|[+-]\d{2}:\d{2}(:\d{2})?)$"), F.try_to_timestamp(text))
    head = F.substring(text, 1, 10)
    day = F.when(head.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), head.try_cast("date"))
    return F.coalesce(date_text(F.to_utc_timestamp(zoned, F.current_timezone())), date_text(day))


def whole_days(later: Column, earlier: Column) -> Column:
    """Days between two times, floored (also below zero)."""
    micros = F.unix_micros(later) - F.unix_micros(earlier)
    width = F.lit(DAY_MICROS).cast("bigint")
    return F.round((micros - F.pmod(micros, width)) / width).cast("bigint")


def id_text(c: Column) -> Column:
    return to_long(c).cast("string")


def before_dot(c: Column) -> Column:
    return F.substring_index(c.cast("string"), ".", 1)


def map_value(c: Column, mapping: dict[str, str]) -> Column:
    """Replace a value by a small fixed mapping; others pass through."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), c), c) if pairs else c


def whole_text(c: Column) -> Column:
    """A float without decimals, halves to even; null gives ``''``."""
    clean = F.when(~F.isnan(c), c)
    rounded = F.bround(clean, 0)
    text = F.when((clean < 0) & (rounded == 0), F.lit("-0")).otherwise(F.format_string("%.0f", rounded))
    return F.when(clean.isNull(), F.lit("")).otherwise(text)
