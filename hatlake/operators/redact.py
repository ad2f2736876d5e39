"""Policy-based redaction with receipts, and field traces.

A policy is compiled to one projection over a message's lines. Lines, fields, repetitions, components and
subcomponents are replaced in place, so the order and number of everything else stays.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.delims import original
from ..functions.text import NULL, escape, sha256, unescape
from ..plans.paths import Path, PathError, parse_path
from .parse import fields, is_encoding, occurrence_numbers

#: Fields that are always sensitive, and those that basic redaction replaces.
SENSITIVE = ("PID.3", "PID.5", "PID.7", "PID.11", "PID.13", "PID.14", "PID.19", "NK1.2", "NK1.4", "NK1.5")
BASIC = ("PID.5", "PID.7", "PID.11", "PID.13", "PID.14", "PID.19", "NK1.2", "NK1.4", "NK1.5")


class PolicyError(ValueError):
    pass


@dataclass(frozen=True)
class Rule:
    path: Path
    action: str
    reason: str
    optional: bool = False


def redaction_path(text: str) -> Path:
    try:
        path = parse_path(text)
    except PathError as error:
        raise PolicyError(str(error)) from error
    if path.segment == "MSH" and path.field <= 2:
        raise PolicyError(f"{path} holds delimiters and can't be redacted")
    return path


def load_policy(text: str) -> tuple[list[Rule], str]:
    """The rules of a TOML policy and its digest.

    A policy has a rule, each path once, a reason for each, and keeps no field that is always sensitive.
    """
    import tomllib

    try:
        raw = tomllib.loads(text)
    except tomllib.TOMLDecodeError as error:
        raise PolicyError(f"the policy is no TOML: {error}") from error
    rules, seen = [], set()
    for entry in raw.get("rules") or []:
        path, action = redaction_path(str(entry.get("path", ""))), entry.get("action")
        if action not in ("hash", "drop", "retain"):
            raise PolicyError(f"unknown action {action!r}")
        if path in seen:
            raise PolicyError(f"two rules for {path}")
        if not str(entry.get("reason") or "").strip():
            raise PolicyError(f"no reason for {path}")
        if action == "retain" and path.comp is None and f"{path.segment}.{path.field}" in SENSITIVE:
            raise PolicyError(f"{path} is always sensitive and can't be retained")
        seen.add(path)
        rules.append(Rule(path, action, entry["reason"], bool(entry.get("optional"))))
    if not rules:
        raise PolicyError("the policy has no rules")
    return rules, hashlib.sha256(text.encode()).hexdigest()


def flat_text(raw: Column, delims: Column) -> Column:
    """The text of a raw field, repetition or component: atoms read, separators as they are, HL7 nulls as two quotes.

    Without an escape character the raw form is the text.
    """
    own = lambda i: F.substring(delims, i, 1)
    read = lambda a: F.when(a == NULL, a).otherwise(unescape(a, delims))
    subs = lambda comp: F.array_join(F.transform(F.split(comp, "&", -1), read), "\x00")
    comps = lambda rep: F.array_join(F.transform(F.split(rep, "\\^", -1), subs), "\x01")
    joined = F.array_join(F.transform(F.split(raw, "~", -1), comps), "\x02")
    slow = F.replace(F.replace(F.replace(joined, F.lit("\x00"), own(5)), F.lit("\x01"), own(2)), F.lit("\x02"), own(3))
    return F.when(~F.contains(raw, F.lit("\\")), original(raw, delims)).otherwise(slow)


def _replaced(raw: Column, action: str, delims: Column, basic: str | None) -> Column:
    if basic is not None:
        return escape(F.lit(basic))
    if action == "hash":
        return F.concat(F.lit("hash:sha256:"), sha256(flat_text(raw, delims)))
    return F.lit("") if action == "drop" else raw


def _target(path: Path) -> list[tuple[str, int]]:
    """How to go down from a field to what the path names."""
    steps = []
    if path.rep is not None or path.comp is not None:
        steps.append(("~", path.rep or 1))
    if path.comp is not None:
        steps.append(("^", path.comp))
        if path.sub is not None:
            steps.append(("&", path.sub))
    return steps


def _edit(raw: Column, steps: list[tuple[str, int]], change) -> Column:
    if not steps:
        return change(raw)
    (mark, number), rest = steps[0], steps[1:]
    pieces = F.split(raw, re.escape(mark), -1)
    return F.array_join(F.transform(pieces, lambda x, i: F.when(i == number - 1, _edit(x, rest, change)).otherwise(x)), mark)


def _reaches(raw: Column, steps: list[tuple[str, int]]) -> Column:
    found = raw
    for mark, number in steps:
        found = F.get(F.split(found, re.escape(mark), -1), F.lit(number - 1))
    return found.isNotNull()


def redact(messages: DataFrame, rules: list[Rule], basic: str | None = None) -> DataFrame:
    """``messages`` with redacted ``lines``, ``matched`` (count of each rule, in order) and ``policy_errors``.

    A message whose policy doesn't cover a sensitive field, or lacks a field that a rule must find, keeps
    ``lines`` as null: nothing that should have been redacted gets through. Lines are rewritten in one pass:
    a line is split once, and each of its fields goes through the rules that name it, in order.
    """
    delims = F.col("delims")
    segment_reps = any(rule.path.segment_rep is not None for rule in rules)
    reps = occurrence_numbers(F.transform("lines", lambda line: F.substring(line, 1, 3))) if segment_reps else F.transform("lines", lambda line: F.lit(0))
    out = messages.withColumn("_s", F.zip_with("lines", reps, lambda line, n: F.struct(F.substring(line, 1, 3).alias("id"), n.alias("rep"), line.alias("line"))))

    def changed(rule: Rule, rep: Column, raw: Column) -> Column:
        """A raw field after one rule."""
        if rule.action == "retain" and basic is None:
            return raw
        done = _edit(raw, _target(rule.path), lambda x: _replaced(x, rule.action, delims, basic))
        return done if rule.path.segment_rep is None else F.when(rep == rule.path.segment_rep, done).otherwise(raw)

    by_field: dict[str, dict[int, list[Rule]]] = {}
    matched = []
    for rule in rules:
        at = rule.path.field - 1 if rule.path.segment == "MSH" else rule.path.field
        before = by_field.setdefault(rule.path.segment, {}).setdefault(at, [])
        matched.append(F.size(F.filter("_s", _finds(rule, at, list(before), changed))).cast("long"))
        before.append(rule)

    def edited(s: Column) -> Column:
        line = s["line"]
        for segment, fields_of in by_field.items():
            line = F.when((s["id"] == segment) & (F.length(s["line"]) > 4), _with_fields(s, fields_of, changed)).otherwise(line)
        return line

    out = out.withColumn("matched", F.array(*matched) if matched else F.array().cast("array<bigint>"))
    errors = [F.when(F.get("matched", F.lit(k)) == 0, F.lit(f"rule {r.path} matched no fields")) for k, r in enumerate(rules) if not r.optional and r.action != "retain"]
    uncovered = [] if basic is not None else [F.when(_present(p) & ~_covered(p, rules), F.lit(f"sensitive field {p} isn't covered")) for p in SENSITIVE]
    failures = F.filter(F.array(*uncovered, *errors) if uncovered or errors else F.array().cast("array<string>"), lambda x: x.isNotNull())
    out = out.withColumn("policy_errors", failures if basic is None else F.array().cast("array<string>"))
    red = F.when(F.size("policy_errors") == 0, F.transform("_s", edited)).alias("lines")
    kept = [c for c in messages.columns if c not in ("lines", "matched", "policy_errors")]
    # A generator, so that a filter on the outcome isn't pushed below the whole rewrite and worked out twice.
    done = out.select(*kept, F.explode(F.array(F.struct(red, "matched", "policy_errors"))).alias("_r"))
    order = [*messages.columns, *[c for c in ("matched", "policy_errors") if c not in messages.columns]]
    return done.select(*[F.col(f"_r.{c}") if c in ("lines", "matched", "policy_errors") else F.col(c) for c in order])


def _finds(rule: Rule, at: int, before: list[Rule], changed):
    """Whether a segment has what the rule names, after the rules that were applied to the field before it."""

    def finds(s: Column) -> Column:
        raw = F.when(F.length(s["line"]) > 4, F.get(F.split(s["line"], "\\|", -1), F.lit(at)))
        for other in before:
            raw = changed(other, s["rep"], raw)
        named = s["id"] == rule.path.segment
        if rule.path.segment_rep is not None:
            named &= s["rep"] == rule.path.segment_rep
        return named & F.coalesce(_reaches(raw, _target(rule.path)), F.lit(False))

    return finds


def _with_fields(s: Column, fields_of: dict[int, list[Rule]], changed) -> Column:
    """The line with the rules of its fields applied."""

    def one(raw: Column, i: Column) -> Column:
        value = raw
        for at, rules in fields_of.items():
            done = raw
            for rule in rules:
                done = changed(rule, s["rep"], done)
            value = F.when(i == at, done).otherwise(value)
        return value

    return F.array_join(F.transform(F.split(s["line"], "\\|", -1), one), "|")


def _occurrences(path: str) -> Column:
    """(repetition, raw) of a sensitive field in each of its segments, where its text isn't empty."""
    p = parse_path(path)
    mine = F.filter("lines", lambda line: F.substring(line, 1, 3) == p.segment)
    raw = F.transform(mine, lambda line, i: F.struct((i + 1).alias("rep"), F.when(F.length(line) > 4, F.get(F.split(line, "\\|", -1), F.lit(p.field))).alias("raw")))
    return F.filter(raw, lambda x: F.coalesce(x["raw"], F.lit("")) != "")


def _present(path: str) -> Column:
    return F.size(_occurrences(path)) > 0


def _covered(path: str, rules: list[Rule]) -> Column:
    p = parse_path(path)
    whole = [r.path for r in rules if r.action != "retain" and (r.path.segment, r.path.field) == (p.segment, p.field) and r.path.rep is None and r.path.comp is None]
    if any(r.segment_rep is None for r in whole):
        return F.lit(True)
    reps = [r.segment_rep for r in whole]
    return F.forall(_occurrences(path), lambda x: x["rep"].isin(*reps) if reps else F.lit(False))


def uncovered(messages: DataFrame, rules: list[Rule], key: str = "msg_id") -> DataFrame:
    """key and path of present sensitive fields that no rule covers."""
    paths = F.array(*[F.when(_present(p) & ~_covered(p, rules), F.lit(p)) for p in SENSITIVE])
    return messages.select(key, F.explode(F.filter(paths, lambda x: x.isNotNull())).alias("path"))


def receipt(redacted: DataFrame, rules: list[Rule]) -> DataFrame:
    """One row per rule over all messages: path, action, reason, optional, matched_count, status."""
    rows = redacted.select(F.posexplode("matched").alias("rule", "n")).groupBy("rule").agg(F.sum("n").alias("matched_count"))
    named = F.array(*[F.struct(F.lit(str(r.path)).alias("path"), F.lit(r.action).alias("action"), F.lit(r.reason).alias("reason"), F.lit(r.optional).alias("optional")) for r in rules])
    r = F.get(named, F.col("rule"))
    status = F.when(F.col("matched_count") == 0, "not_found").when(r["action"] == "retain", "retained").otherwise("applied")
    return rows.select(r["path"].alias("path"), r["action"].alias("action"), r["reason"].alias("reason"), r["optional"].alias("optional"), "matched_count", status.alias("status"))


def trace(redacted: DataFrame, rules: list[Rule], key: str = "msg_id") -> DataFrame:
    """One row per field of a redacted message: path, canonical_path, segment_index (from 1), field_index, present, value_shape, redaction_action."""
    rows = fields(redacted.filter("lines IS NOT NULL"), key, with_rep=True)
    text = F.when(is_encoding(), F.col("raw")).otherwise(flat_text(F.col("raw"), F.col("delims")))
    occurrence = F.concat("seg_id", F.lit("["), F.col("seg_rep").cast("string"), F.lit("]."), F.col("field_no").cast("string"))
    canonical = F.concat("seg_id", F.lit("."), F.col("field_no").cast("string"))
    action = F.lit(None).cast("string")
    for rule in reversed(rules):
        name = F.lit(str(rule.path))
        hit = lambda p: (name == p) | F.startswith(name, F.concat(p, F.lit("."))) | F.startswith(name, F.concat(p, F.lit("[")))
        action = F.when(hit(F.col("path")) | hit(F.col("canonical_path")), rule.action).otherwise(action)
    shape = F.when(F.col("text") == "", "empty").when(F.startswith("text", F.lit("hash:sha256:")), "hashed_sha256").otherwise("present")
    out = rows.select(key, occurrence.alias("path"), canonical.alias("canonical_path"), (F.col("seg_idx") + 1).alias("segment_index"), F.col("field_no").alias("field_index"), text.alias("text"))
    return out.select(key, "path", "canonical_path", "segment_index", "field_index", (F.col("text") != "").alias("present"), shape.alias("value_shape"), action.alias("redaction_action"))


def hash_identifier(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.substring(sha256(text), 1, 16))
