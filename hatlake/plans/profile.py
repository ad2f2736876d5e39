"""Conformance profiles: loading, inheritance, merging, explaining and linting, all on the driver."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from typing import Any

from ..functions.temporal import tolerance_seconds
from .paths import try_path

#: Keys of a profile, and what identifies an entry of each list when profiles are merged.
LISTS = {
    "segments": "id", "constraints": "path", "lengths": "path", "valuesets": "path", "datatypes": "path", "advanced_datatypes": "path",
    "cross_field_rules": "id", "temporal_rules": "id", "contextual_rules": "id", "custom_rules": "id", "hl7_tables": "id",
}
SCALARS = ("message_structure", "version", "message_type", "parent")
OTHER = ("table_precedence", "expression_guardrails")
OPERATORS = frozenset("eq ne contains in matches_regex gt lt ge le exists not_exists missing is_date before within_range".split())


class ProfileError(ValueError):
    pass


@dataclass
class Profile:
    message_structure: str = ""
    version: str = ""
    message_type: str | None = None
    parent: str | None = None
    lists: dict[str, list[dict[str, Any]]] = field(default_factory=lambda: {k: [] for k in LISTS})
    table_precedence: list[str] = field(default_factory=list)
    expression_guardrails: dict[str, Any] = field(default_factory=dict)

    def __getattr__(self, name: str) -> list[dict[str, Any]]:
        if name in LISTS:
            return self.__dict__["lists"][name]
        raise AttributeError(name)


def from_dict(raw: Any) -> Profile:
    if not isinstance(raw, dict):
        raise ProfileError("a profile is a mapping")
    for key in ("message_structure", "version"):
        if not isinstance(raw.get(key), str):
            raise ProfileError(f"{key} is missing")
    out = Profile(**{k: raw.get(k) for k in SCALARS}, table_precedence=list(raw.get("table_precedence") or []), expression_guardrails=dict(raw.get("expression_guardrails") or {}))
    for name, key in LISTS.items():
        entries = raw.get(name) or []
        if not isinstance(entries, list) or any(not isinstance(e, dict) or not isinstance(e.get(key), str) for e in entries):
            raise ProfileError(f"{name} is a list of mappings, each with {key}")
        out.lists[name] = [dict(e) for e in entries]
    for table in out.lists["hl7_tables"]:
        table["codes"] = [{"value": str(c.get("value", c.get("code"))), "description": c.get("description", c.get("display", "")), "status": c.get("status") or ""} for c in table.get("codes") or []]
    return out


def loads(text: str) -> Profile:
    """A profile from YAML text; its parent isn't resolved."""
    import yaml

    try:
        return from_dict(yaml.safe_load(text))
    except yaml.YAMLError as error:
        raise ProfileError(f"not YAML: {error}") from error


def merge(parent: Profile, child: Profile) -> Profile:
    """Entries of the child replace the parent's with the same key in place; new ones follow."""
    out = Profile(child.message_structure or parent.message_structure, child.version or parent.version, child.message_type or parent.message_type, None)
    for name, key in LISTS.items():
        entries = {e[key]: e for e in parent.lists[name]}
        entries.update({e[key]: e for e in child.lists[name]})
        out.lists[name] = list(entries.values())
    out.table_precedence = child.table_precedence or parent.table_precedence
    out.expression_guardrails = parent.expression_guardrails | child.expression_guardrails
    return out


def resolve(profile: Profile, load: Callable[[str], Profile], seen: tuple[str, ...] = ()) -> Profile:
    """The profile merged over its ancestors; a cycle is refused."""
    if not profile.parent:
        return profile
    if profile.parent in seen:
        raise ProfileError(f"parents form a cycle: {' > '.join((*seen, profile.parent))}")
    return merge(resolve(load(profile.parent), load, (*seen, profile.parent)), profile)


class ProfileLoader:
    """Profiles by path, ``file://`` or ``http(s)://``, kept in a cache of bounded size; HTTP is revalidated by ETag."""

    def __init__(self, size: int = 64):
        from collections import OrderedDict

        self.size, self._kept = size, OrderedDict()

    def load(self, source: str) -> Profile:
        import urllib.request

        kept = self._kept.get(source)
        if source.startswith(("http://", "https://")):
            request = urllib.request.Request(source, headers={"If-None-Match": kept[1]} if kept and kept[1] else {})
            try:
                with urllib.request.urlopen(request, timeout=30) as reply:
                    text, tag = reply.read().decode(), reply.headers.get("ETag")
            except urllib.error.HTTPError as error:
                if error.code != 304 or not kept:
                    raise
                self._kept.move_to_end(source)
                return kept[0]
        elif kept:
            self._kept.move_to_end(source)
            return kept[0]
        else:
            with open(source.removeprefix("file://"), encoding="utf-8") as f:
                text, tag = f.read(), None
        self._kept[source] = (loads(text), tag)
        self._kept.move_to_end(source)
        while len(self._kept) > self.size:
            self._kept.popitem(last=False)
        return self._kept[source][0]

    def prefetch(self, sources: Iterable[str]) -> None:
        for source in sources:
            self.load(source)

    def is_cached(self, source: str) -> bool:
        return source in self._kept

    def invalidate(self, source: str) -> bool:
        return self._kept.pop(source, None) is not None

    def clear_cache(self) -> None:
        self._kept.clear()

    def cache_size(self) -> int:
        return len(self._kept)


def table_of(valueset: dict[str, Any]) -> str:
    """The HL7 table that a value set refers to: the named table, or else its own name."""
    named = valueset.get("hl7_table")
    return named if named and named.strip() else valueset.get("name", "")


def explain(text: str) -> dict[str, Any]:
    """What a profile asks for, in counts and lists, with its digest and what its lint says is ignored."""
    profile = loads(text)
    return {
        "message_structure": profile.message_structure, "version": profile.version, "message_type": profile.message_type, "parent": profile.parent,
        "profile_sha256": hashlib.sha256(text.encode()).hexdigest(),
        "counts": {name: len(entries) for name, entries in profile.lists.items()},
        "required_segments": [s["id"] for s in profile.segments if s.get("required")],
        "required_fields": [c["path"] for c in profile.constraints if c.get("required")],
        "value_sets": [{"path": v["path"], "name": v.get("name", ""), "codes": len(v.get("codes") or [])} for v in profile.valuesets],
        "ignored": [issue for issue in lint(text) if issue["code"].startswith("unknown_")],
    }


# --- lint ---------------------------------------------------------------------------------------------

KEYS = {
    "segments": {"id", "required", "repetition"},
    "constraints": {"path", "required", "components", "in", "when", "pattern"},
    "expression_guardrails": {"max_depth", "max_length", "allow_custom_scripts"},
}


def _is_regex(pattern: Any) -> bool:
    try:
        re.compile(pattern)
        # no look-around and no references back: the rules' dialect has neither
        return not re.search(r"\(\?[=!<](?!P)|\\[1-9]", pattern)
    except (re.error, TypeError):
        return False


class _Lint:
    def __init__(self) -> None:
        self.issues: list[dict[str, Any]] = []

    def add(self, code: str, severity: str, at: str, message: str) -> None:
        self.issues.append({"code": code, "severity": severity, "location": at, "message": message})

    def error(self, code: str, at: str, message: str) -> None:
        self.add(code, "error", at, message)

    def warning(self, code: str, at: str, message: str) -> None:
        self.add(code, "warning", at, message)

    def path(self, text: Any, at: str) -> None:
        if not isinstance(text, str) or try_path(text) is None:
            self.error("invalid_hl7_path", at, f"{text!r} is no path")

    def repeated(self, entries, key: str, at: str, empty: str, duplicate: str) -> None:
        seen = set()
        for i, entry in enumerate(entries):
            name = entry.get(key) or ""
            if not name.strip():
                self.error(empty, f"{at}[{i}]", f"{key} is empty")
            elif name in seen:
                self.warning(duplicate, f"{at}[{i}]", f"{name} is there more than once")
            seen.add(name)


def _lint_condition(lint: _Lint, condition: dict, at: str) -> None:
    if "eq" in condition and condition["eq"] is not None:
        eq = condition["eq"]
        if not isinstance(eq, list) or len(eq) != 2:
            lint.error("invalid_condition_eq", at, "eq has a path and a value")
        else:
            lint.path(eq[0], at)
    for i, inner in enumerate(condition.get("any") or []):
        _lint_condition(lint, inner, f"{at}.any[{i}]")


def _lint_rule_condition(lint: _Lint, condition: dict, at: str) -> None:
    operator = condition.get("operator", "")
    lint.path(condition.get("field"), at)
    if operator not in OPERATORS:
        lint.error("unknown_rule_condition_operator", at, f"unknown operator {operator}")
    elif operator == "matches_regex":
        if condition.get("value") is None:
            lint.error("missing_rule_condition_regex", at, "matches_regex has no pattern")
        elif not _is_regex(condition["value"]):
            lint.error("invalid_rule_condition_regex", at, "the pattern is no regular expression")
    elif operator == "within_range" and len(condition.get("values") or []) != 2:
        lint.error("invalid_within_range_values", at, "within_range has two values")


def lint(text: str) -> list[dict[str, Any]]:
    """Issues of a profile's YAML: code, severity, location, message."""
    import yaml

    out = _Lint()
    try:
        raw = yaml.safe_load(text)
    except yaml.YAMLError as error:
        out.error("yaml_parse_error", "", str(error).splitlines()[0])
        return out.issues
    try:
        profile = from_dict(raw)
    except ProfileError as error:
        out.error("profile_load_error", "", str(error))
        return out.issues
    for key in raw:
        if key not in LISTS and key not in SCALARS and key not in OTHER:
            out.warning("unknown_top_level_key", key, f"{key} is ignored")
    for name, code in (("segments", "unknown_segment_key"), ("constraints", "unknown_constraint_key")):
        for i, entry in enumerate(profile.lists[name]):
            for key in entry.keys() - KEYS[name]:
                out.warning(code, f"{name}[{i}]", f"{key} is ignored")
    for key in profile.expression_guardrails.keys() - KEYS["expression_guardrails"]:
        out.warning("unknown_expression_guardrail_key", "expression_guardrails", f"{key} is ignored")
    if not profile.message_structure.strip():
        out.error("empty_message_structure", "message_structure", "it is empty")
    if not profile.version.strip():
        out.error("empty_version", "version", "it is empty")
    out.repeated(profile.segments, "id", "segments", "empty_segment_id", "duplicate_segment_id")
    for i, c in enumerate(profile.constraints):
        at = f"constraints[{i}]"
        out.path(c["path"], at)
        bounds = c.get("components") or {}
        if bounds.get("min") is not None and bounds.get("max") is not None and bounds["min"] > bounds["max"]:
            out.error("component_min_exceeds_max", at, "min is over max")
        if c.get("pattern") is not None and not _is_regex(c["pattern"]):
            out.error("invalid_constraint_pattern", at, "the pattern is no regular expression")
        if c.get("when"):
            _lint_condition(out, c["when"], f"{at}.when")
    for i, entry in enumerate(profile.lengths):
        out.path(entry["path"], f"lengths[{i}]")
        if entry.get("policy") not in (None, "reject", "truncate", "warn", "no-truncate", "may-truncate"):
            out.warning("unknown_length_policy", f"lengths[{i}]", f"unknown policy {entry['policy']}")
    tables = {t["id"] for t in profile.hl7_tables}
    out.repeated(profile.valuesets, "name", "valuesets", "empty_valueset_name", "duplicate_valueset_name")
    for i, v in enumerate(profile.valuesets):
        out.path(v["path"], f"valuesets[{i}]")
        if not v.get("codes") and table_of(v) not in tables:
            out.warning("empty_valueset_without_table", f"valuesets[{i}]", "no codes and no table")
    for i, d in enumerate(profile.datatypes):
        out.path(d["path"], f"datatypes[{i}]")
        if not (d.get("type") or "").strip():
            out.error("empty_datatype", f"datatypes[{i}]", "type is empty")
    for i, d in enumerate(profile.advanced_datatypes):
        at = f"advanced_datatypes[{i}]"
        out.path(d["path"], at)
        if not (d.get("type") or "").strip():
            out.error("empty_advanced_datatype", at, "type is empty")
        if d.get("min_length") is not None and d.get("max_length") is not None and d["min_length"] > d["max_length"]:
            out.error("datatype_min_length_exceeds_max", at, "min_length is over max_length")
        if d.get("pattern") is not None and not _is_regex(d["pattern"]):
            out.error("invalid_datatype_pattern", at, "the pattern is no regular expression")
        if d.get("checksum") not in (None, "luhn", "mod10"):
            out.warning("unknown_checksum_algorithm", at, f"unknown checksum {d['checksum']}")
    names = {v.get("name") for v in profile.valuesets}
    for name in ("cross_field_rules", "temporal_rules", "contextual_rules", "custom_rules"):
        out.repeated(profile.lists[name], "id", name, "empty_rule_id", "duplicate_rule_id")
    for i, rule in enumerate(profile.cross_field_rules):
        at = f"cross_field_rules[{i}]"
        if rule.get("validation_mode", "conditional") not in ("conditional", "assert"):
            out.error("unknown_cross_field_validation_mode", at, f"unknown mode {rule['validation_mode']}")
        for j, condition in enumerate(rule.get("conditions") or []):
            _lint_rule_condition(out, condition, f"{at}.conditions[{j}]")
        for j, action in enumerate(rule.get("actions") or []):
            out.path(action.get("field"), f"{at}.actions[{j}]")
            if action.get("action") not in ("require", "prohibit", "validate"):
                out.error("unknown_rule_action", f"{at}.actions[{j}]", f"unknown action {action.get('action')}")
            if action.get("valueset") and action["valueset"] not in names:
                out.error("unknown_action_valueset", f"{at}.actions[{j}]", f"unknown value set {action['valueset']}")
    for i, rule in enumerate(profile.temporal_rules):
        for side in ("before", "after"):
            out.path(rule.get(side), f"temporal_rules[{i}].{side}")
        if rule.get("tolerance") is not None and tolerance_seconds(str(rule["tolerance"])) is None:
            out.error("invalid_temporal_tolerance", f"temporal_rules[{i}]", f"{rule['tolerance']!r} is no tolerance")
    for i, rule in enumerate(profile.contextual_rules):
        at, kind, given = f"contextual_rules[{i}]", rule.get("validation_type"), rule.get("parameters") or {}
        out.path(rule.get("context_field"), at)
        out.path(rule.get("target_field"), at)
        if kind not in ("require", "prohibit", "validate_datatype", "validate_valueset"):
            out.error("unknown_contextual_validation_type", at, f"unknown type {kind}")
        elif kind == "validate_datatype" and "datatype" not in given:
            out.error("missing_contextual_datatype_parameter", at, "datatype is missing")
        elif kind == "validate_valueset" and "valueset" not in given:
            out.error("missing_contextual_valueset_parameter", at, "valueset is missing")
        elif kind == "validate_valueset" and given["valueset"] not in names:
            out.error("unknown_contextual_valueset", at, f"unknown value set {given['valueset']}")
    out.repeated(profile.hl7_tables, "id", "hl7_tables", "empty_table_id", "duplicate_table_id")
    for i, t in enumerate(profile.hl7_tables):
        for key, code in (("name", "empty_table_name"), ("version", "empty_table_version")):
            if not (t.get(key) or "").strip():
                out.warning(code, f"hl7_tables[{i}]", f"{key} is empty")
    for entry in profile.table_precedence:
        if entry not in tables:
            out.error("unknown_table_precedence_entry", "table_precedence", f"unknown table {entry}")
    for i, rule in enumerate(profile.custom_rules):
        if not (rule.get("script") or "").strip():
            out.error("empty_custom_rule_script", f"custom_rules[{i}]", "the script is empty")
    if profile.custom_rules and not profile.expression_guardrails.get("allow_custom_scripts"):
        out.warning("custom_rules_without_script_guardrail", "custom_rules", "scripts aren't allowed by the guardrails")
    return out.issues
