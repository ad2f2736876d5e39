"""The rule engine: a profile compiled to one projection over parsed messages.

Every rule becomes an expression that gives an issue or null; all rules are one array per message, in the
fixed order of rule families, so validation is a map without a shuffle. Values that rules share are read
once for each path.
"""

from __future__ import annotations

import re
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import datatypes as D
from ..functions import temporal as T
from ..functions.text import stable_code, trim
from ..plans.paths import Message, try_path
from ..plans.profile import Profile, table_of
from .parse import report_type

ISSUE = "struct<code:string,severity:string,path:string,rule_id:string,value:string>"


class Rules:
    """Compiles the rules of a profile. ``today`` (yyyyMMdd) is what birth dates are held against."""

    def __init__(self, profile: Profile, today: str):
        self.profile, self.today, self.message = profile, F.lit(today), Message()
        self.shared: dict[str, Column] = {}

    # values, each read in a column of its own

    def _share(self, kind: str, path: str, make) -> Column:
        parsed = try_path(path)
        if parsed is None:
            return F.array().cast("array<string>") if kind != "n" else F.array().cast("array<int>")
        name = f"_{kind}_{parsed}".replace(".", "_")
        if name not in self.shared:
            self.shared[name] = make(parsed)
        return F.col(f"`{name}`")

    def all_values(self, path: str) -> Column:
        return self._share("all", path, self.message.path_values)

    def first_values(self, path: str) -> Column:
        return self._share("first", path, self.message.condition_values)

    def trimmed(self, path: str) -> Column:
        parsed = try_path(path)
        if parsed is not None and parsed.segment == "MSH" and parsed.field == 1:
            return F.filter(F.transform(F.array(self.message.get(parsed)), trim), lambda x: x.isNotNull() & (x != ""))
        return F.filter(F.transform(self.first_values(path), trim), lambda x: x != "")

    def has_value(self, path: str) -> Column:
        parsed = try_path(path)
        if parsed is None:
            return F.lit(False)
        if parsed.segment == "MSH" and parsed.field == 1:
            return self.message.segment_count("MSH") > 0
        return F.exists(self.all_values(path), lambda x: x != "")

    # issues

    def issue(self, when: Column, code: str, path: str | None, value: Column | None = None, rule: str | None = None) -> Column:
        text = lambda x: F.lit(x).cast("string")
        made = F.struct(text(code).alias("code"), text("error").alias("severity"), text(path).alias("path"), text(rule).alias("rule_id"), (value if value is not None else text(None)).cast("string").alias("value"))
        return F.array(F.when(when, made).cast(ISSUE))

    def first_bad(self, values: Column, bad, code: str, path: str, rule: str | None = None, gate: Column | None = None) -> Column:
        """An issue for the first value that is bad."""
        found = F.filter(values, lambda v: bad(v))
        when = F.size(found) > 0
        return self.issue(when if gate is None else gate & when, code, path, F.get(found, F.lit(0)), rule)

    def first_bad_pair(self, left: str, right: str, bad, code: str, rule: str | None) -> Column:
        """Values are paired by place, as far as both go."""
        a, b = self.first_values(left), self.first_values(right)
        n = F.least(F.size(a), F.size(b))
        pairs = F.arrays_zip(F.slice(a, F.lit(1), n).alias("l"), F.slice(b, F.lit(1), n).alias("r"))
        found = F.filter(pairs, lambda p: bad(p["l"], p["r"]))
        return self.issue(F.size(found) > 0, code, left, F.get(found, F.lit(0))["l"], rule)

    # families, in the order in which issues are listed

    def compile(self) -> list[Column]:
        p, out = self.profile, []
        for s in p.segments:
            out += self.segment(s)
        for c in p.constraints:
            out += self.constraint(c)
        for entry in p.lengths:
            if entry.get("max") is not None:
                out.append(self.first_bad(self.all_values(entry["path"]), lambda v, m=entry["max"]: F.octet_length(v) > m, "VALUE_TOO_LONG", entry["path"]))
        for v in p.valuesets:
            if v.get("codes"):
                out.append(self.first_bad(self.all_values(v["path"]), lambda x, c=tuple(map(str, v["codes"])): ~x.isin(*c), "VALUE_NOT_IN_SET", v["path"]))
        for d in p.datatypes:
            out.append(self.first_bad(self.all_values(d["path"]), lambda x, t=d.get("type", ""): ~D.valid(x, t), "INVALID_DATA_TYPE", d["path"]))
        for d in p.advanced_datatypes:
            out += self.advanced(d)
        tables = {t["id"]: t for t in p.hl7_tables}
        for v in p.valuesets:
            table = tables.get(table_of(v))
            if table:
                active = tuple(c["value"] for c in table["codes"] if c["status"] in ("", "A", "active"))
                out.append(self.first_bad(self.all_values(v["path"]), lambda x, c=active: (x != "") & (~x.isin(*c) if c else F.lit(True)), "VALUE_NOT_IN_HL7_TABLE", v["path"]))
        for rule in p.cross_field_rules:
            out += self.cross_field(rule)
        for rule in p.temporal_rules:
            out.append(self.temporal(rule))
        for rule in p.contextual_rules:
            out += self.contextual(rule)
        for rule in p.custom_rules:
            out += self.custom(rule)
        return out

    def segment(self, spec: dict[str, Any]) -> list[Column]:
        count = self.message.segment_count(spec["id"])
        out = []
        if not spec.get("repetition"):
            one = lambda i: F.struct(F.lit("SEGMENT_REPETITION_NOT_ALLOWED").alias("code"), F.lit("error").alias("severity"),
                F.concat(F.lit(f"{spec['id']}["), i.cast("string"), F.lit("]")).alias("path"), F.lit(None).cast("string").alias("rule_id"), F.lit(None).cast("string").alias("value"))
            out.append(F.when(count > 1, F.transform(F.sequence(F.lit(2), F.greatest(count, F.lit(2))), one)).otherwise(F.array().cast(f"array<{ISSUE}>")))
        if spec.get("required"):
            out.append(self.issue(count == 0, "MISSING_REQUIRED_SEGMENT", spec["id"]))
        return out

    def gate(self, when: dict[str, Any] | None) -> Column:
        if when is None:
            return F.lit(True)
        if when.get("eq") is not None and len(when["eq"]) == 2:
            path, wanted = when["eq"]
            return F.exists(self.first_values(path), lambda x: x == F.lit(str(wanted)))
        return reduce(lambda a, b: a | b, [self.gate(c) for c in when.get("any") or []], F.lit(False))

    def constraint(self, c: dict[str, Any]) -> list[Column]:
        path, gate, out = c["path"], self.gate(c.get("when")), []
        values = self.all_values(path)
        if c.get("required"):
            out.append(self.issue(gate & ~self.has_value(path), "MISSING_REQUIRED_FIELD", path))
        bounds = c.get("components") or {}
        if bounds.get("min") is not None or bounds.get("max") is not None:
            counts = self._share("n", path, self.message.component_counts)
            few = F.filter(counts, lambda n: n < bounds["min"]) if bounds.get("min") is not None else F.array().cast("array<int>")
            many = F.filter(counts, lambda n: n > bounds["max"]) if bounds.get("max") is not None else F.array().cast("array<int>")
            out.append(self.issue(gate & (F.size(few) > 0), "TOO_FEW_COMPONENTS", path, F.get(few, F.lit(0))))
            out.append(self.issue(gate & (F.size(few) == 0) & (F.size(many) > 0), "TOO_MANY_COMPONENTS", path, F.get(many, F.lit(0))))
        if c.get("in") is not None:
            allowed = tuple(map(str, c["in"]))
            out.append(self.first_bad(values, lambda x: ~x.isin(*allowed), "VALUE_NOT_IN_CONSTRAINT", path, gate=gate))
        if c.get("pattern") is not None and _compiles(c["pattern"]):
            out.append(self.first_bad(values, lambda x: ~x.rlike(_java(c["pattern"])), "PATTERN_MISMATCH", path, gate=gate))
        return out

    def advanced(self, d: dict[str, Any]) -> list[Column]:
        path, kind = d["path"], d.get("type", "")
        values = self.all_values(path)
        bad_type = lambda x: ~D.valid(x, kind)
        fine = ~F.exists(values, lambda v: bad_type(v))
        out = [self.first_bad(values, bad_type, "INVALID_DATA_TYPE", path)]
        tests = []
        if d.get("min_length") is not None:
            tests.append((lambda x: F.octet_length(x) < d["min_length"], "VALUE_TOO_SHORT"))
        if d.get("max_length") is not None:
            tests.append((lambda x: F.octet_length(x) > d["max_length"], "VALUE_TOO_LONG"))
        if d.get("pattern") is not None and _compiles(d["pattern"]):
            tests.append((lambda x: ~x.rlike(_java(d["pattern"])), "PATTERN_MISMATCH"))
        if d.get("format") is not None:
            tests.append((lambda x: ~D.matches_format(x, d["format"], kind), "FORMAT_MISMATCH"))
        if d.get("checksum") is not None:
            tests.append((lambda x: ~D.checksum(x, d["checksum"]), "CHECKSUM_MISMATCH"))
        return out + [self.first_bad(values, test, code, path, gate=fine) for test, code in tests]

    def condition(self, c: dict[str, Any]) -> Column:
        left, operator, value, values = self.trimmed(c["field"]), c.get("operator", ""), c.get("value"), [str(v) for v in c.get("values") or []]
        value = None if value is None else str(value)
        none = F.size(left) == 0
        if operator == "eq":
            return none if value is None else F.exists(left, lambda x: x == F.lit(value)) | (none if value == "" else F.lit(False))
        if operator == "ne":
            return ~none if value is None else F.exists(left, lambda x: x != F.lit(value)) | (none if value != "" else F.lit(False))
        if operator == "contains":
            return F.exists(left, lambda x: F.contains(x, F.lit(value or "")))
        if operator == "in":
            return F.exists(left, lambda x: x.isin(*values)) if values else F.lit(False)
        if operator == "matches_regex":
            return F.exists(left, lambda x: x.rlike(_java(value))) if value is not None and _compiles(value) else F.lit(False)
        if operator in ("gt", "lt", "ge", "le"):
            return F.lit(False) if value is None else F.exists(left, lambda x: D.compare_numbers(x, F.lit(value), operator))
        if operator == "exists":
            return ~none
        if operator in ("not_exists", "missing"):
            return none
        if operator == "is_date":
            return F.exists(left, lambda x: T.parse_ts(x)["ts"].isNotNull())
        if operator == "before" and value is not None:
            right = self.trimmed(value) if try_path(value) else F.array().cast("array<string>")
            n = F.least(F.size(left), F.size(right))
            pairs = F.arrays_zip(F.slice(left, F.lit(1), n).alias("l"), F.slice(right, F.lit(1), n).alias("r"))
            one = F.coalesce(F.get(right, F.lit(0)), F.lit(value))
            return F.when(F.size(right) > 1, F.exists(pairs, lambda p: T.is_before(p["l"], p["r"]))).otherwise(F.exists(left, lambda x: T.is_before(x, one)))
        if operator == "within_range" and len(values) == 2:
            whole = lambda x: F.when(x.rlike(r"^[+-]?[0-9]+\z"), x.try_cast("bigint"))
            stamp = lambda x: F.when(F.length(trim(x)) >= 8, T.parse_ts(x)["ts"])
            low, high = F.lit(values[0]), F.lit(values[1])
            return F.exists(left, lambda x: F.coalesce(stamp(x).between(stamp(low), stamp(high)), F.lit(False)) | F.coalesce(whole(x).between(whole(low), whole(high)), F.lit(False)))
        return F.lit(False)

    def cross_field(self, rule: dict[str, Any]) -> list[Column]:
        met = reduce(lambda a, b: a & b, [self.condition(c) for c in rule.get("conditions") or []], F.lit(True))
        if rule.get("validation_mode", "conditional") == "assert":
            return [self.issue(~met, "CROSS_FIELD_ASSERTION_FAILED", None, rule=rule["id"])]
        out, code = [], "CROSS_FIELD_VALIDATION_ERROR"
        for a in rule.get("actions") or []:
            path, values = a["field"], self.all_values(a["field"])
            if a["action"] == "require":
                out.append(self.issue(met & ~self.has_value(path), code, path, rule=rule["id"]))
            elif a["action"] == "prohibit":
                out.append(self.first_bad(values, lambda x: x != "", code, path, rule["id"], met))
            elif a["action"] == "validate":
                if a.get("datatype"):
                    out.append(self.first_bad(values, lambda x, t=a["datatype"]: (x != "") & ~D.valid(x, t), code, path, rule["id"], met))
                codes = self.codes(a.get("valueset"))
                if codes is not None:
                    out.append(self.first_bad(values, lambda x, c=codes: (x != "") & _outside(x, c), code, path, rule["id"], met))
        return out

    def codes(self, name: str | None) -> tuple[str, ...] | None:
        found = next((v for v in self.profile.valuesets if v.get("name") == name), None) if name else None
        return None if found is None else tuple(map(str, found.get("codes") or []))

    def temporal(self, rule: dict[str, Any]) -> Column:
        seconds = T.tolerance_seconds(rule.get("tolerance")) or 0
        equal = F.lit(bool(rule.get("allow_equal")))

        def violates(a: Column, b: Column) -> Column:
            x, y = T.parse_full(a), T.parse_full(b)
            return (x > y + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(seconds))) | (~equal & (x == y))

        a, b = self.first_values(rule["before"]), self.first_values(rule["after"])
        n = F.least(F.size(a), F.size(b))
        pairs = F.arrays_zip(F.slice(a, F.lit(1), n).alias("l"), F.slice(b, F.lit(1), n).alias("r"))
        found = F.get(F.filter(pairs, lambda p: F.coalesce(violates(p["l"], p["r"]), F.lit(True))), F.lit(0))
        readable = T.parse_full(found["l"]).isNotNull() & T.parse_full(found["r"]).isNotNull()
        return F.concat(
            self.issue(found.isNotNull() & ~readable, "INVALID_DATETIME", rule["before"], found["l"], rule["id"]),
            self.issue(found.isNotNull() & readable, "TEMPORAL_RULE_VIOLATION", rule["before"], found["l"], rule["id"]),
        )

    def contextual(self, rule: dict[str, Any]) -> list[Column]:
        gate = F.exists(self.first_values(rule["context_field"]), lambda x: x == F.lit(str(rule["context_value"])))
        path, kind, given = rule["target_field"], rule.get("validation_type"), rule.get("parameters") or {}
        values, code = self.all_values(path), "CONTEXTUAL_VALIDATION_ERROR"
        if kind == "require":
            return [self.issue(gate & ~self.has_value(path), code, path, rule=rule["id"])]
        if kind == "prohibit":
            return [self.first_bad(values, lambda x: x != "", code, path, rule["id"], gate)]
        if kind == "validate_datatype" and "datatype" in given:
            return [self.first_bad(values, lambda x: ~D.valid(x, given["datatype"]), code, path, rule["id"], gate)]
        codes = self.codes(given.get("valueset")) if kind == "validate_valueset" else None
        return [] if codes is None else [self.first_bad(values, lambda x: _outside(x, codes), code, path, rule["id"], gate)]

    # scripts: the first form whose words and shape fit decides

    def custom(self, rule: dict[str, Any]) -> list[Column]:
        script, name, code = rule.get("script") or "", rule["id"], "CUSTOM_RULE_VIOLATION"
        one = lambda path, bad: [self.first_bad(self.first_values(path), bad, code, path, name)]
        two = lambda a, b, bad: [self.first_bad_pair(a, b, bad, code, name)]
        field, quoted = r"field\(([^)]+)\)", r"\('([^']+)'\)"
        strip = lambda text: tuple(x.strip().strip("'") for x in text.split(","))
        forms = (
            (".length() > ", field + r"\.length\(\)\s*>\s*(\d+)", lambda p, n: one(p, lambda x: F.octet_length(x) <= int(n))),
            (" in [", field + r"\s+in\s+\[([^\]]+)\]", lambda p, v: one(p, lambda x: ~x.isin(*strip(v)))),
            (".matches_regex(", field + r"\.matches_regex" + quoted, lambda p, r: one(p, lambda x: ~x.rlike(_java(r))) if _compiles(r) else self.substring_rule(rule, p, r)),
            (".starts_with(", field + r"\.starts_with" + quoted, lambda p, t: one(p, lambda x: ~F.startswith(x, F.lit(t)))),
            (".ends_with(", field + r"\.ends_with" + quoted, lambda p, t: one(p, lambda x: ~F.endswith(x, F.lit(t)))),
            (".is_numeric()", field + r"\.is_numeric\(\)", lambda p: one(p, lambda x: ~x.rlike(r"^[0-9]*\z"))),
            (" == field(", field + r"\s*==\s*" + field, lambda a, b: two(a, b, lambda x, y: x != y)),
            (".is_phone_number()", field + r"\.is_phone_number\(\)", lambda p: one(p, lambda x: ~D.is_phone_number(x))),
            (".is_email()", field + r"\.is_email\(\)", lambda p: one(p, lambda x: ~D.is_email(x))),
            (".is_ssn()", field + r"\.is_ssn\(\)", lambda p: one(p, lambda x: ~D.is_ssn(x))),
            (".is_valid_birth_date()", field + r"\.is_valid_birth_date\(\)", lambda p: one(p, lambda x: ~D.is_birth_date(x, self.today))),
            ("is_valid_age_range(", r"is_valid_age_range\(" + field + r",\s*" + field + r"\)", lambda a, b: two(a, b, lambda x, y: ~D.is_age_range(x, y))),
            (" between ", field + r"\s+between\s+(\S+)\s+and\s+(\S+)", lambda p, a, b: one(p, lambda x: ~D.is_within_range(x, a, b))),
        )
        for words, shape, make in forms:
            found = words in script and re.search(shape, script)
            if found:
                return make(*found.groups())
        return []

    def substring_rule(self, rule: dict[str, Any], path: str, text: str) -> list[Column]:
        """A script whose pattern is no regular expression looks for the pattern as it stands, if the rule is nothing else."""
        if not rule["script"].startswith("field(") or not rule["script"].endswith("')"):
            return []
        return [self.first_bad(self.first_values(path), lambda x: ~F.contains(x, F.lit(text)), "CUSTOM_RULE_VIOLATION", path, rule["id"])]


def _outside(x: Column, codes: tuple[str, ...]) -> Column:
    return ~x.isin(*codes) if codes else F.lit(True)


def _compiles(pattern: str) -> bool:
    try:
        re.compile(_java(pattern).replace(r"\z", r"\Z"))
        return True
    except re.error:
        return False


def _java(pattern: str) -> str:
    """A pattern in which a final ``$`` is the end of the text and not the place before a last line end."""
    return re.sub(r"(?<!\\)\$\Z", r"\\z", pattern)


def validate(messages: DataFrame, profile: Profile, today: str | None = None) -> DataFrame:
    """Parsed messages with ``issues``, an array of code, severity, path, rule_id and value, in rule order.

    ``today`` (yyyyMMdd) makes results repeatable; without it the present day is taken.
    """
    from datetime import datetime, timezone

    rules = Rules(profile, today or datetime.now(timezone.utc).strftime("%Y%m%d"))
    compiled = rules.compile()
    wide = messages.select("*", *[c.alias(name) for name, c in rules.shared.items()])
    issues = F.filter(F.flatten(F.array(*compiled)), lambda x: x.isNotNull()) if compiled else F.array().cast(f"array<{ISSUE}>")
    return wide.select(*messages.columns, issues.alias("issues"))


def issues(validated: DataFrame, key: str = "msg_id") -> DataFrame:
    """One row per issue: key, position, code, stable code, severity, path, rule_id, value, segment_index (from 0), field_index."""
    rows = validated.select(key, "lines", F.posexplode("issues").alias("position", "i"))
    segment = F.regexp_extract("i.path", r"^([A-Z0-9]{3})", 1)
    rep = F.coalesce(F.nullif(F.regexp_extract("i.path", r"^[A-Z0-9]{3}\[(\d+)\]", 1), F.lit("")).cast("int"), F.lit(1))
    numbered = F.transform("lines", lambda line, i: F.struct(F.substring(line, 1, 3).alias("id"), i.alias("i")))
    at = F.get(F.filter(numbered, lambda x: x["id"] == segment), rep - 1)["i"]
    field = F.nullif(F.regexp_extract("i.path", r"^[A-Z0-9]{3}(?:\[\d+\])?[.-](\d+)", 1), F.lit("")).cast("int")
    return rows.select(key, "position", "i.code", stable_code(F.col("i.code")).alias("stable_code"), "i.severity", "i.path", "i.rule_id", "i.value", at.alias("segment_index"), field.alias("field_index"))


def report(validated: DataFrame, key: str = "msg_id", version: int = 1) -> DataFrame:
    """One row per message: valid, message_type, segment_count, issue_count, codes."""
    errors = F.size(F.filter("issues", lambda i: i["severity"] == "error"))
    out = validated.select(key, (errors == 0).alias("valid"), report_type().alias("message_type"), F.size("lines").alias("segment_count"), F.size("issues").alias("issue_count"),
        F.transform("issues", lambda i: stable_code(i["code"])).alias("codes"))
    return out if version == 1 else envelope(out)


def envelope(frame: DataFrame) -> DataFrame:
    """The second version of a report: the first with who made it."""
    from .. import __version__

    return frame.select("*", F.lit("2").alias("schema_version"), F.lit("hatlake").alias("tool_name"), F.lit(__version__).alias("tool_version"))
