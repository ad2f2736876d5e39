"""Scalar validators over text as boolean Columns.

There are two families that differ on purpose: ``valid`` is the one that profiles use, ``valid_strict``
trims its input and knows two more types.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .text import trim

#: A number as the profile rules read it: no surrounding space, no type suffix.
NUMBER = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\z"
NUMBER_OR_NAMED = r"^[+-]?(?:(?i:inf|infinity|nan)|(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)\z"


def number(text: Column) -> Column:
    """The value as double, null if it isn't a number."""
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def _finite(text: Column) -> Column:
    value = number(text)
    return F.coalesce(value.between(-1.7976931348623157e308, 1.7976931348623157e308), F.lit(False))


def is_date(text: Column) -> Column:
    real = F.call_function("try_to_timestamp", text, F.lit("yyyyMMdd")).isNotNull()
    return text.rlike(r"^[0-9]{8}\z") & (F.substring(text, 1, 4) != "0000") & real | text.rlike(r"^0000(?:(?:0[13578]|1[02])(?:0[1-9]|[12][0-9]|3[01])|(?:0[469]|11)(?:0[1-9]|[12][0-9]|30)|02(?:0[1-9]|[12][0-9]))\z")


def is_time(text: Column) -> Column:
    """HHMM, then one digit or two of seconds, then a fraction; 16 characters at most."""
    return text.rlike(r"^(?:[01][0-9]|2[0-3])[0-5][0-9](?:[0-9]|[0-5][0-9](?:[0-9]*|\.[0-9]+))?\z") & (F.length(text) <= 16)


def is_timestamp(text: Column) -> Column:
    return text.rlike(r"^\p{ASCII}{8,}\z") & is_date(F.substring(text, 1, 8)) & ((F.length(text) == 8) | is_time(F.substring(text, 9, 1000)))


def is_numeric(text: Column) -> Column:
    return _finite(text)


def is_sequence_id(text: Column) -> Column:
    return text.rlike(r"^\+?[0-9]+\z") & F.coalesce(text.try_cast("decimal(38,0)").between(1, 4294967295), F.lit(False))


def is_identifier(text: Column) -> Column:
    return text.rlike(r"^[\x20-\x7E]*\z")


def is_person_name(text: Column) -> Column:
    return text.rlike(r"^[\p{IsAlphabetic}\p{IsWhite_Space}\-'.^]*\z")


def _always(text: Column) -> Column:
    return F.lit(True)


PROFILE_TYPES = {
    "ST": _always, "TX": _always, "FT": _always, "ID": is_identifier, "IS": is_identifier, "CX": is_identifier, "HD": is_identifier,
    "DT": is_date, "TM": is_time, "TS": is_timestamp, "NM": is_numeric, "SI": is_sequence_id, "PN": is_person_name,
}


def valid(text: Column, datatype: str) -> Column:
    """Whether a value is of the type by the profiles' rules; an unknown type is always valid."""
    return PROFILE_TYPES.get(datatype, _always)(text)


def is_time_strict(text: Column) -> Column:
    return text.rlike(r"^(?:[01][0-9]|2[0-3])[0-5][0-9](?:[0-5][0-9](?:\.[0-9]{1,4})?)?\z")


def valid_strict(text: Column, datatype: str) -> Column:
    """The second family: trims, has no five-digit times, and knows addresses (AD) and telecommunication numbers (XTN)."""
    value = trim(text)
    other = {"TM": is_time_strict(value), "TS": is_date(F.substring(value, 1, 8)) & ((F.length(value) == 8) | is_time_strict(F.substring(value, 9, 100))), "AD": F.lit(True), "XTN": is_phone_number(value)}
    return other.get(datatype, valid(value, datatype))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def is_phone_number(text: Column) -> Column:
    return F.length(_digits(text)).between(7, 15)


def is_email(text: Column) -> Column:
    return text.rlike(r"(?s)^[^@]+@[^@]*\.[^@]*\z")


def is_ssn(text: Column) -> Column:
    return _digits(text).rlike(r"^(?!000|666|9)[0-9]{3}(?!00)[0-9]{2}(?!0000)[0-9]{4}\z")


def is_birth_date(text: Column, today: Column) -> Column:
    """A date that isn't after ``today`` (yyyyMMdd)."""
    return is_date(text) & (text <= today)


def is_age_range(birth: Column, reference: Column) -> Column:
    return is_date(birth) & is_date(reference) & (birth <= reference)


def is_within_range(text: Column, low: str | Column, high: str | Column) -> Column:
    bound = lambda x: number(x if isinstance(x, Column) else F.lit(x))
    return F.coalesce(number(text).between(bound(low), bound(high)), F.lit(False))


def compare_numbers(left: Column, right: Column, relation: str) -> Column:
    a, b = number(left), number(right)
    tests = {"gt": a > b, "lt": a < b, "ge": a >= b, "le": a <= b, "eq": F.abs(a - b) < 2.220446049250313e-16, "ne": F.abs(a - b) >= 2.220446049250313e-16}
    return F.coalesce(tests.get(relation, F.lit(False)), F.lit(False))


def matches_all(text: Column, patterns: list[str]) -> Column:
    """Whether a text matches all patterns; a pattern that is no regular expression matches nothing."""
    found = F.lit(True)
    for pattern in patterns:
        found &= text.rlike(pattern) if _compiles(pattern) else F.lit(False)
    return found


def _compiles(pattern: str) -> bool:
    session = SparkSession.getActiveSession()
    try:
        if session is None:
            re.compile(pattern)
        else:
            session.sparkContext._jvm.java.util.regex.Pattern.compile(pattern)
    except Exception:  # noqa: BLE001  Java's and Python's errors have no class in common
        return False
    return True


def luhn(text: Column) -> Column:
    """The mod 10 check over the digits of a text; fewer than two digits fail."""
    digits = F.split(F.reverse(_digits(text)), "")
    doubled = F.transform(digits, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.when(d.cast("int") >= 5, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2)))
    return (F.length(_digits(text)) >= 2) & (F.aggregate(F.filter(doubled, lambda x: x.isNotNull()), F.lit(0), lambda a, x: a + x) % 10 == 0)


def checksum(text: Column, algorithm: str) -> Column:
    return luhn(text) if algorithm in ("luhn", "mod10") else F.lit(True)


def matches_format(text: Column, pattern: str, datatype: str) -> Column:
    if (datatype, pattern) == ("DT", "YYYY-MM-DD"):
        return text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z") & is_date(F.replace(text, F.lit("-"), F.lit("")))
    if (datatype, pattern) == ("TM", "HH:MM:SS"):
        return text.rlike(r"^(?:[01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]\z")
    return F.lit(True)


def detail(text: Column, datatype: str, min_bytes: int | None = None, max_bytes: int | None = None, pattern: str | None = None, allowed: list[str] | None = None, algorithm: str | None = None) -> Column:
    """The first thing that is wrong with a value under the second family, null if nothing is. A pattern that doesn't compile is ignored."""
    import re

    out = F.when(~F.coalesce(valid_strict(text, datatype), F.lit(False)), "invalid_type")
    if min_bytes is not None:
        out = out.when(F.octet_length(text) < min_bytes, "too_short")
    if max_bytes is not None:
        out = out.when(F.octet_length(text) > max_bytes, "too_long")
    if pattern is not None:
        try:
            re.compile(pattern)
            out = out.when(~text.rlike(pattern), "pattern_mismatch")
        except re.error:
            pass
    if allowed is not None:
        out = out.when(~text.isin(*allowed) if allowed else F.lit(True), "not_allowed")
    if algorithm is not None:
        out = out.when(~checksum(text, algorithm), "checksum_mismatch")
    return out
