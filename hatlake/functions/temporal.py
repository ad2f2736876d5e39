"""Timestamps with precision, comparison at the coarser precision, and tolerances."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import trim

#: Precision by length of the text.
PRECISIONS = {4: "year", 6: "month", 8: "day", 12: "minute", 14: "second"}
UNITS = ("year", "month", "day", "hour", "minute", "second")
_FILL = "00000101000000"


def _padded(text: Column) -> Column:
    """The text filled up to 14 digits."""
    return F.concat(text, F.substring(F.lit(_FILL), F.length(text) + 1, F.lit(14)))


def parse_ts(text: Column) -> Column:
    """struct(ts, precision) of a timestamp of 4, 6, 8, 12 or 14 digits; both null if it is none."""
    value = trim(text)
    precision = F.lit(None).cast("int")
    for length, name in PRECISIONS.items():
        precision = F.when(F.length(value) == length, F.lit(UNITS.index(name))).otherwise(precision)
    ts = F.when(value.rlike("^[0-9]+\\z") & precision.isNotNull(), F.call_function("try_to_timestamp", _padded(value), F.lit("yyyyMMddHHmmss")))
    return F.struct(ts.alias("ts"), F.when(ts.isNotNull(), precision).alias("precision"))


def truncate(ts: Column, precision: Column) -> Column:
    out = ts
    for i, unit in enumerate(UNITS[:-1]):
        out = F.when(precision == i, F.date_trunc(unit, ts)).otherwise(out)
    return out


def is_before(left: Column, right: Column) -> Column:
    """Strictly before, both cut to the coarser precision; false if one is no timestamp."""
    a, b = _compared(left, right)
    return F.coalesce(a < b, F.lit(False))


def _compared(left: Column, right: Column) -> tuple[Column, Column]:
    a, b = parse_ts(left), parse_ts(right)
    coarser = F.least(a["precision"], b["precision"])
    return truncate(a["ts"], coarser), truncate(b["ts"], coarser)


def is_after(left: Column, right: Column) -> Column:
    """Strictly after, both cut to the coarser precision; false if one is no timestamp."""
    return is_before(right, left)


def is_equal(left: Column, right: Column) -> Column:
    """The same moment at the coarser precision; false if one is no timestamp."""
    a, b = _compared(left, right)
    return F.coalesce(a == b, F.lit(False))


def is_valid_ts(text: Column) -> Column:
    return F.coalesce(parse_ts(text)["ts"].isNotNull(), F.lit(False))


def is_valid_date(text: Column) -> Column:
    return F.coalesce(parse_date(text).isNotNull(), F.lit(False))


def is_valid_time(text: Column) -> Column:
    return F.coalesce(parse_time(text).isNotNull(), F.lit(False))


def ts_error(text: Column) -> Column:
    """Why a text is no timestamp: empty, invalid_length, invalid_characters or out_of_range; null if it is one."""
    value = trim(text)
    return (
        F.when(F.coalesce(value, F.lit("")) == "", "empty")
        .when(~value.rlike("^[0-9]+\\z"), "invalid_characters")
        .when(~F.length(value).isin(*PRECISIONS), "invalid_length")
        .when(parse_ts(text)["ts"].isNull(), "out_of_range")
    )


def now_hl7() -> Column:
    """The present time in UTC with seconds."""
    return to_hl7(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()))


def today_hl7() -> Column:
    return F.substring(now_hl7(), 1, 8)


def parse_full(text: Column) -> Column:
    """A timestamp of 14 digits, 8 digits or YYYY-MM-DD, else null: what temporal rules accept."""
    read = lambda pattern: F.call_function("try_to_timestamp", text, F.lit(pattern))
    return (
        F.when(text.rlike("^[0-9]{14}\\z"), read("yyyyMMddHHmmss"))
        .when(text.rlike("^[0-9]{8}\\z"), read("yyyyMMdd"))
        .when(text.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}\\z"), read("yyyy-MM-dd"))
    )


def tolerance_seconds(text: str | None) -> int | None:
    """Seconds of ``<whole number><s|m|h|d>``; None if it is something else."""
    found = re.fullmatch(r"\+?(\d+)([smhd])", (text or "").strip())
    return int(found[1]) * {"s": 1, "m": 60, "h": 3600, "d": 86400}[found[2]] if found else None


def to_hl7(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMddHHmmss")


def parse_date(text: Column) -> Column:
    """A date of eight digits, else null."""
    return F.when(trim(text).rlike("^[0-9]{8}\\z"), F.call_function("try_to_timestamp", trim(text), F.lit("yyyyMMdd")).cast("date"))


def parse_time(text: Column) -> Column:
    """Seconds since midnight of HHMM[SS[.S to .SSSS]], else null."""
    value = trim(text)
    part = lambda at: F.substring(value, at, 2).try_cast("int")
    seconds = F.when(F.length(value) >= 6, F.substring(value, 5, 10).try_cast("double")).otherwise(F.lit(0.0))
    return F.when(value.rlike(r"^(?:[01][0-9]|2[0-3])[0-5][0-9](?:[0-5][0-9](?:\.[0-9]{1,4})?)?\z"), part(1) * 3600 + part(3) * 60 + seconds)


def parse_ts_fraction(text: Column) -> Column:
    """struct(ts, precision, micros): as ``parse_ts``, and a fraction of one to four digits after the seconds."""
    value = trim(text)
    fraction = F.regexp_extract(value, r"^[0-9]{14}\.([0-9]{1,4})\z", 1)
    base = parse_ts(F.when(fraction != "", F.substring(value, 1, 14)).otherwise(value))
    micros = F.when((fraction != "") & base["ts"].isNotNull(), F.rpad(fraction, 6, "0").cast("int"))
    return F.struct(base["ts"].alias("ts"), F.when(micros.isNotNull(), F.lit(6)).otherwise(base["precision"]).alias("precision"), micros.alias("micros"))


def is_same_day(left: Column, right: Column) -> Column:
    return F.coalesce(F.to_date(parse_ts(left)["ts"]) == F.to_date(parse_ts(right)["ts"]), F.lit(False))
