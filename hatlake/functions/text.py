"""Escaping, trimming and hashing of HL7 text as Column functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .delims import DEFAULT, Delims, part, plain

NULL = '""'
#: White space by Unicode, which Spark's trim doesn't know.
SPACE = r"[\p{IsWhite_Space}]"
_NAMES = {"F": "field", "S": "comp", "R": "rep", "E": "esc", "T": "sub"}


def trim(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+\z", "")


def escape(text: Column, delims: Delims = DEFAULT) -> Column:
    """Delimiters as escape sequences, line ends as ``\\.br\\``; null stays null."""
    codes = {getattr(delims, name): f"{delims.esc}{letter}{delims.esc}" for letter, name in _NAMES.items()}
    breaks = f"{delims.esc}.br{delims.esc}"
    one = F.regexp_replace(text, r"\r\n|\r", "\n")
    if not set(str(delims)) & set("FSRET.br"):
        out = F.replace(one, F.lit(delims.esc), F.lit(codes.pop(delims.esc)))
        for character, code in codes.items():
            out = F.replace(out, F.lit(character), F.lit(code))
        return F.replace(out, F.lit("\n"), F.lit(breaks))
    # A delimiter that is a letter of the sequences: each character apart, so that no replacement is replaced.
    table = F.create_map(*[F.lit(x) for pair in (codes | {"\n": breaks}).items() for x in pair])
    return F.array_join(F.transform(F.split(one, ""), lambda c: F.coalesce(table[c], c)), "")


def unescape(text: Column, delims: Column | None = None) -> Column:
    """Text of a canonical line: sequences become characters, unknown and unclosed ones stay.

    Split at the escape character, pieces at odd places are sequences; the last one, if odd, isn't closed.
    ``delims`` are the message's own delimiters, which sequences name and to which text returns.
    """
    return F.when(~F.contains(text, F.lit("\\")), _back(text, delims)).otherwise(F.array_join(once(F.split(text, "\\\\", -1), lambda p: F.transform(p, _reader(p, delims))), ""))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, also where ``use`` names it within a lambda.

    A column that a lambda names is worked out again for each element; a variable of a lambda isn't.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _back(text: Column, delims: Column | None) -> Column:
    return text if delims is None else plain(text, delims)


def _reader(pieces: Column, delims: Column | None) -> Callable[[Column, Column], Column]:
    """What each piece between escape characters stands for."""
    own = (lambda name: part(delims, name)) if delims is not None else (lambda name: F.lit(getattr(DEFAULT, name)))
    back = lambda x: _back(x, delims)

    def read(x: Column, i: Column) -> Column:
        value = F.when(i % 2 == 0, back(x)).when(i == F.size(pieces) - 1, F.concat(own("esc"), back(x)))
        for letter, name in _NAMES.items():
            value = value.when(x == letter, own(name))
        return value.when(x == ".br", F.lit("\n")).otherwise(F.concat(own("esc"), back(x), own("esc")))

    return read


def needs_escaping(text: Column, delims: Delims = DEFAULT) -> Column:
    found = F.contains(text, F.lit("\n")) | F.contains(text, F.lit("\r"))
    for character in str(delims):
        found |= F.contains(text, F.lit(character))
    return found


def needs_unescaping(text: Column, delims: Delims = DEFAULT) -> Column:
    return F.contains(text, F.lit(delims.esc))


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def stable_code(code: Column) -> Column:
    """An issue code in lower snake case."""
    return F.regexp_replace(F.regexp_replace(F.lower(code), "[^a-z0-9]+", "_"), "^_+|_+$", "")
