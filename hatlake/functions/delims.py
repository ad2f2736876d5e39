"""Delimiters, and the canonical form in which every line is split.

Lines of messages with delimiters of their own are translated: their delimiters become the canonical
ones, and canonical delimiter characters that are plain text there become noncharacters, which are turned
back when an atom is read. So one plan with literal split patterns serves all messages.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

CANONICAL = "|^~\\&"
#: Noncharacters that stand for canonical delimiter characters in text of messages with other delimiters.
STAND_INS = "".join(chr(0xFDD0 + i) for i in range(5))


@dataclass(frozen=True)
class Delims:
    field: str = "|"
    comp: str = "^"
    rep: str = "~"
    esc: str = "\\"
    sub: str = "&"

    def __str__(self) -> str:
        return self.field + self.comp + self.rep + self.esc + self.sub

    @property
    def encoding(self) -> str:
        return self.comp + self.rep + self.esc + self.sub


DEFAULT = Delims()


def of_line(line: Column) -> Column:
    """The five delimiters of an MSH line as a string of five characters, in the order of ``CANONICAL``."""
    return F.substring(line, 4, 5)


def canonical(line: Column, delims: Column) -> Column:
    """``line`` with canonical delimiters."""
    translated = F.call_function("translate", line, F.concat(delims, F.lit(CANONICAL)), F.lit(CANONICAL + STAND_INS))
    return F.when(delims == CANONICAL, line).otherwise(translated)


def part(delims: Column, name: str) -> Column:
    return F.substring(delims, ("field", "comp", "rep", "esc", "sub").index(name) + 1, 1)


def plain(text: Column, delims: Column) -> Column:
    """Text of a canonical line as it was."""
    return F.when(delims == CANONICAL, text).otherwise(F.translate(text, STAND_INS, CANONICAL))


def original(line: Column, delims: Column) -> Column:
    """A canonical line with its own delimiters again."""
    return F.when(delims == CANONICAL, line).otherwise(F.call_function("translate", line, F.lit(CANONICAL + STAND_INS), F.concat(delims, F.lit(CANONICAL))))
