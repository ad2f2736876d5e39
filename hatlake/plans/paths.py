"""Paths such as ``PID.5[1].1`` and ``OBX[2]-5.1``, compiled to Columns over a message's canonical lines."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.delims import part
from ..functions.text import NULL, unescape

_SHAPE = re.compile(r"([A-Z][A-Z0-9]*)(?:\[(\d+)\])?[.-](\d+)(?:\[(\d+)\])?(?:\.(\d+))?(?:\.(\d+))?")


class PathError(ValueError):
    pass


@dataclass(frozen=True)
class Path:
    segment: str
    field: int
    rep: int | None = None
    comp: int | None = None
    sub: int | None = None
    segment_rep: int | None = None

    def __str__(self) -> str:
        index = lambda x: f"[{x}]" if x is not None else ""
        dotted = "".join(f".{x}" for x in (self.comp, self.sub) if x is not None)
        return f"{self.segment}{index(self.segment_rep)}.{self.field}{index(self.rep)}{dotted}"


def parse_path(text: str) -> Path:
    """Indices begin at 1; the segment is read in any case."""
    found = _SHAPE.fullmatch(text.strip().upper())
    if not found:
        raise PathError(f"not an HL7 path: {text!r}")
    segment, segment_rep, field, rep, comp, sub = found.groups()
    numbers = [None if x is None else int(x) for x in (segment_rep, field, rep, comp, sub)]
    if 0 in numbers:
        raise PathError(f"indices begin at 1: {text!r}")
    return Path(segment, numbers[1], numbers[2], numbers[3], numbers[4], numbers[0])


def try_path(text: str) -> Path | None:
    try:
        return parse_path(text)
    except PathError:
        return None


class Message:
    """Column access to one message: an array of canonical lines and its delimiters."""

    def __init__(self, lines: Column | str = "lines", delims: Column | str = "delims"):
        self.lines = F.col(lines) if isinstance(lines, str) else lines
        self.delims = F.col(delims) if isinstance(delims, str) else delims

    def segment(self, name: str, rep: int = 1) -> Column:
        return F.get(F.filter(self.lines, lambda line: F.substring(line, 1, 3) == name), F.lit(rep - 1))

    def segment_count(self, name: str) -> Column:
        return F.size(F.filter(self.lines, lambda line: F.substring(line, 1, 3) == name))

    def field(self, path: Path) -> Column:
        """The raw field, null if it is missing. MSH-1 and MSH-2 come from the delimiters."""
        line = self.segment(path.segment, path.segment_rep or 1)
        if path.segment == "MSH" and path.field <= 2:
            return F.when(line.isNotNull(), part(self.delims, "field") if path.field == 1 else F.substring(self.delims, 2, 4))
        at = path.field - 1 if path.segment == "MSH" else path.field
        return F.when(F.length(line) > 4, F.get(F.split(line, "\\|", -1), F.lit(at)))

    def _is_literal(self, path: Path) -> bool:
        return path.segment == "MSH" and path.field <= 2

    def reps(self, path: Path) -> Column:
        """The raw repetitions of the field that the path names, or the one that it names; null if there is no field."""
        field = self.field(path)
        reps = F.array(field) if self._is_literal(path) else F.split(field, "~", -1)
        return reps if path.rep is None else F.slice(reps, path.rep, 1)

    def atom(self, path: Path) -> Column:
        """The raw atom at the path (repetition, component and subcomponent 1 unless given); null if missing."""
        if self._is_literal(path):
            first = all(x in (None, 1) for x in (path.rep, path.comp, path.sub))
            return self.field(path) if first else F.lit(None).cast("string")
        rep = F.get(F.split(self.field(path), "~", -1), F.lit((path.rep or 1) - 1))
        return _atom_of(rep, path.comp or 1, path.sub or 1)

    def text(self, raw: Column) -> Column:
        return unescape(raw, self.delims)

    def get(self, path: Path) -> Column:
        """The text at the path; null if missing or an HL7 null."""
        raw = self.atom(path)
        return F.when(raw != NULL, raw if self._is_literal(path) else self.text(raw))

    def presence(self, path: Path) -> Column:
        raw = self.atom(path)
        return F.when(raw.isNull(), "missing").when(raw == NULL, "null").when(raw == "", "empty").otherwise("value")

    def condition_values(self, path: Path) -> Column:
        """One text for each repetition (component and subcomponent 1 unless given), HL7 nulls and missing ones left out."""
        if self._is_literal(path):
            return _or_empty(F.filter(F.array(self.atom(path)), lambda x: x.isNotNull()))
        raw = F.transform(self.reps(path), lambda rep: _atom_of(rep, path.comp or 1, path.sub or 1))
        return _or_empty(F.transform(F.filter(raw, lambda x: x.isNotNull() & (x != NULL)), self.text))

    def path_values(self, path: Path) -> Column:
        """All texts below the path, empty ones too: every repetition, component and subcomponent that it doesn't fix."""
        if self._is_literal(path):
            return _or_empty(F.filter(F.array(self.field(path)), lambda x: x.isNotNull()))

        def subs(comp: Column) -> Column:
            every = F.split(comp, "&", -1)
            return every if path.sub is None else F.slice(every, path.sub, 1)

        def atoms(rep: Column) -> Column:
            comps = F.split(rep, "\\^", -1)
            return F.flatten(F.transform(comps if path.comp is None else F.slice(comps, path.comp, 1), subs))

        # an HL7 null repetition has one component with one null atom, which is left out anyway
        return _or_empty(F.transform(F.filter(F.flatten(F.transform(self.reps(path), atoms)), lambda x: x != NULL), self.text))

    def has_value(self, path: Path) -> Column:
        if self._is_literal(path) and path.field == 1:
            return self.segment_count("MSH") > 0
        return F.exists(self.path_values(path), lambda x: x != "")

    def joined_components(self, path: Path) -> Column:
        """The texts of the first repetition's components joined by ``^``, empty ones left out, up to the first HL7 null."""
        raw = F.transform(F.split(F.get(F.split(self.field(path), "~", -1), F.lit(0)), "\\^", -1), lambda c: F.get(F.split(c, "&", -1), F.lit(0)))
        upto = F.array_position(raw, F.lit(NULL))
        taken = F.when(upto > 0, F.slice(raw, F.lit(1), (upto - 1).cast("int"))).otherwise(raw)
        return F.array_join(F.transform(F.filter(taken, lambda x: x != ""), self.text), "^")

    def component_counts(self, path: Path) -> Column:
        if self._is_literal(path):
            return _or_empty(F.transform(F.filter(F.array(self.field(path)), lambda x: x.isNotNull()), lambda x: F.lit(1)), "array<int>")
        return _or_empty(F.transform(self.reps(path), lambda rep: F.size(F.split(rep, "\\^", -1))), "array<int>")


def _atom_of(rep: Column, comp: int, sub: int) -> Column:
    return F.get(F.split(F.get(F.split(rep, "\\^", -1), F.lit(comp - 1)), "&", -1), F.lit(sub - 1))


def _or_empty(values: Column, kind: str = "array<string>") -> Column:
    return F.coalesce(values, F.array().cast(kind))
