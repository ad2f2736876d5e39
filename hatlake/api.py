"""The verbs of the engine, DataFrame in and DataFrame out, and its SQL functions.

    import hatlake.api as hl7
    messages = hl7.parse(spark.read.format("binaryFile").load(path).selectExpr("path AS msg_id", "content AS raw"))
    hl7.validate(messages, hl7.load_profile("adt.yaml")).show()
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import batch, corpus, evidence, generate as _generate, redact as _redact, validate as _validate, write
from .functions.delims import CANONICAL, STAND_INS
from .functions.text import sha256
from .operators.parse import atoms, charsets, fields, parse, parsed, segments
from .plans import profile as _profile
from .plans.paths import Message, parse_path
from .sources import mllp

__all__ = [
    "ack", "atoms", "batch", "bundle", "corpus_diff", "corpus_fingerprint", "corpus_summary", "fields", "generate", "get", "load_profile", "mllp", "normalize", "parse", "parsed", "profile_explain", "profile_folder",
    "profile_lint", "profile_test", "redact", "register", "replay", "safe_analysis", "segments", "to_json", "validate",
]


def _today() -> str:
    return datetime.now(timezone.utc).strftime("%Y%m%d")


def load_profile(source: str, inherit: bool = True) -> _profile.Profile:
    loader = _profile.ProfileLoader()
    found = loader.load(source)
    return _profile.resolve(found, lambda name: loader.load(source.rpartition("/")[0] + f"/{name.lower()}.yaml")) if inherit else found


def get(messages: DataFrame, *paths: str, key: str = "msg_id") -> DataFrame:
    m = Message()
    return messages.select(key, *[m.get(parse_path(p)).alias(p) for p in paths])


def to_json(messages: DataFrame, key: str = "msg_id", pretty: bool = False) -> DataFrame:
    return messages.select(key, write.to_json(charsets(), pretty).alias("json"))


def normalize(messages: DataFrame, key: str = "msg_id", canonical: bool = True) -> DataFrame:
    return messages.select(key, (write.normalised() if canonical else write.wire()).alias("raw"))


def ack(messages: DataFrame, code: str = "AA", error: str | None = None, key: str = "msg_id") -> DataFrame:
    return messages.select(key, write.ack(code, F.current_timestamp(), None if error is None else F.lit(error)).alias("raw"))


def generate(spark: SparkSession, template: dict, seed: int, n: int) -> DataFrame:
    return _generate.generate(spark, template, seed, n)


def profile_lint(text: str) -> list[dict]:
    return _profile.lint(text)


def profile_explain(text: str) -> dict:
    return _profile.explain(text)


def profile_test(fixtures: DataFrame, profile: _profile.Profile, today: str | None = None) -> DataFrame:
    return evidence.fixture_tests(fixtures, profile, today or _today())


def profile_folder(files: DataFrame, profile: _profile.Profile, today: str | None = None) -> DataFrame:
    """msg_id, kind, valid, passed of message files whose ``kind`` is valid or invalid; a message that can't be read is invalid."""
    rows = parse(files)
    checked = _validate.report(_validate.validate(rows.filter("parse_error IS NULL"), profile, today or _today())).select("msg_id", "valid")
    joined = rows.select("msg_id", "kind").join(checked, "msg_id", "left")
    valid = F.coalesce("valid", F.lit(False))
    return joined.select("msg_id", "kind", valid.alias("valid"), (valid == (F.col("kind") == "valid")).alias("passed"))


def validate(messages: DataFrame, profile: _profile.Profile, today: str | None = None, version: int = 1) -> DataFrame:
    return _validate.report(_validate.validate(messages, profile, today), version=version)


def corpus_summary(messages: DataFrame) -> dict[str, DataFrame]:
    return corpus.summary(messages)


def corpus_fingerprint(messages: DataFrame) -> DataFrame:
    return corpus.fingerprint_artifact(messages)


def corpus_diff(before: DataFrame, after: DataFrame) -> dict[str, DataFrame]:
    """Differences of two corpora that ``parse`` gave: totals, message types and segments (with those that are new or removed),
    and fields (presence and cardinality, shapes)."""
    all_totals = corpus.totals_diff(corpus.totals(before), corpus.totals(after))
    before, after = before.filter("parse_error IS NULL"), after.filter("parse_error IS NULL")
    two = lambda f: (f(before), f(after))
    shapes = tuple(f"{s}_count" for s in corpus.SHAPES)
    types, found = corpus.diff(*two(corpus.message_type_counts), "value", ("count",)), corpus.diff(*two(corpus.segment_counts), "value", ("count",))
    return {
        "totals": all_totals, "message_types": types, "segments": found,
        "new_or_removed_message_types": corpus.new_and_removed(types), "new_or_removed_segments": corpus.new_and_removed(found),
        "fields": corpus.diff(*two(corpus.fingerprint), "path", (*corpus.CARDINALITY, *shapes)),
    }


def redact(messages: DataFrame, policy: str) -> tuple[DataFrame, DataFrame]:
    """Redacted messages and the receipt."""
    rules, _ = _redact.load_policy(policy)
    done = _redact.redact(messages, rules)
    return done, _redact.receipt(done, rules)


def safe_analysis(messages: DataFrame, policy: str, raw: str = "raw", key: str = "msg_id") -> DataFrame:
    """Raw messages in, redacted ones out: key, status, raw, input_sha256, output_sha256, policy_sha256, errors.

    ``status`` is redacted, refused (the policy doesn't cover a sensitive field, or misses one) or unreadable. Only
    redacted messages have ``raw``, so nothing that wasn't redacted gets through.
    """
    rules, digest = _redact.load_policy(policy)
    rows = parse(messages.select(key, F.col(raw).alias("raw"), sha256(F.col(raw)).alias("input_sha256")))
    done = _redact.redact(rows, rules)
    bad = F.col("parse_error").isNotNull()
    out = F.when(~bad & F.col("lines").isNotNull(), write.wire())
    status = F.when(bad, "unreadable").when(F.col("lines").isNull(), "refused").otherwise("redacted")
    errors = F.when(bad, F.array("parse_error.code")).otherwise(F.col("policy_errors"))
    return done.select(key, status.alias("status"), out.alias("out"), "input_sha256", F.lit(digest).alias("policy_sha256"), errors.alias("errors")).select(
        key, "status", F.col("out").alias("raw"), "input_sha256", sha256(F.col("out")).alias("output_sha256"), "policy_sha256", "errors")


def bundle(messages: DataFrame, profile: _profile.Profile, policy: str, path: str, today: str | None = None) -> None:
    evidence.bundle(messages, profile, policy, path, today or _today())


def replay(spark: SparkSession, path: str, profile: _profile.Profile, today: str) -> DataFrame:
    return evidence.replay(spark, path, profile, today)


CANONICAL_TEXT = CANONICAL.replace("\\", "\\\\")
_PATH = r"^([A-Za-z0-9]{3})(?:\\[([1-9][0-9]*)\\])?[.-]([1-9][0-9]*)(?:\\[([1-9][0-9]*)\\])?(?:\\.([1-9][0-9]*))?(?:\\.([1-9][0-9]*))?$"


def _path_part(group: int) -> str:
    return f"CAST(coalesce(nullif(regexp_extract(path, '{_PATH}', {group}), ''), '1') AS INT)"


def _plain(text: str) -> str:
    """Text as it was, of a message whose delimiters are ``d``. A lambda's variable can't be given to a function."""
    return f"CASE WHEN d = '{CANONICAL_TEXT}' THEN {text} ELSE translate({text}, '{STAND_INS}', '{CANONICAL_TEXT}') END"


def _function(head: str, body: str) -> str:
    return f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}"


#: Each function is an expression over those before it.
PATH_FUNCTIONS = [
    _function("hl7_raw_lines(raw STRING) RETURNS ARRAY<STRING>", "filter(transform(split(raw, '\\r', -1), x -> regexp_replace(x, '^\\n', '')), x -> x <> '')"),
    _function("hl7_delims(raw STRING) RETURNS STRING", "substring(get(hl7_raw_lines(raw), 0), 4, 5)"),
    _function("hl7_lines(raw STRING) RETURNS ARRAY<STRING>", "transform(hl7_raw_lines(raw), x -> if(hl7_delims(raw) = '|^~\\\\&', x, translate(x, concat(hl7_delims(raw), '|^~\\\\&'), concat('|^~\\\\&', '" + STAND_INS + "'))))"),
    _function("hl7_line(raw STRING, path STRING) RETURNS STRING", f"get(filter(hl7_lines(raw), x -> left(x, 3) = upper(regexp_extract(path, '{_PATH}', 1))), {_path_part(2)} - 1)"),
    _function("hl7_field(raw STRING, path STRING) RETURNS STRING",
        f"CASE WHEN length(hl7_line(raw, path)) > 4 THEN get(split(hl7_line(raw, path), '[|]', -1), {_path_part(3)} - CASE WHEN left(hl7_line(raw, path), 3) = 'MSH' THEN 1 ELSE 0 END) END"),
    _function("hl7_atom(raw STRING, path STRING) RETURNS STRING", "CASE WHEN NOT regexp_like(path, '" + _PATH + "') THEN NULL"
        f" WHEN upper(left(path, 3)) = 'MSH' AND {_path_part(3)} <= 2 THEN CASE WHEN {_path_part(4)} * {_path_part(5)} * {_path_part(6)} = 1 AND hl7_line(raw, path) IS NOT NULL THEN substring(hl7_delims(raw), {_path_part(3)}, {_path_part(3)} * {_path_part(3)}) END"
        f" ELSE get(split(get(split(get(split(hl7_field(raw, path), '~', -1), {_path_part(4)} - 1), '\\\\^', -1), {_path_part(5)} - 1), '&', -1), {_path_part(6)} - 1) END"),
    _function("hl7_read(t STRING, d STRING) RETURNS STRING", "CASE WHEN NOT contains(t, '\\\\') THEN " + _plain("t") + " ELSE get(transform(array(split(t, '\\\\\\\\', -1)), p -> array_join(transform(p, (x, i) -> CASE WHEN i % 2 = 0 THEN " + _plain("x") +
        " WHEN i = size(p) - 1 THEN concat(substring(d, 4, 1), " + _plain("x") + ") WHEN x = 'F' THEN substring(d, 1, 1) WHEN x = 'S' THEN substring(d, 2, 1) WHEN x = 'R' THEN substring(d, 3, 1) WHEN x = 'E' THEN substring(d, 4, 1)"
        " WHEN x = 'T' THEN substring(d, 5, 1) WHEN x = '.br' THEN '\\n' ELSE concat(substring(d, 4, 1), " + _plain("x") + ", substring(d, 4, 1)) END), '')), 0) END"),
    _function("hl7_get(raw STRING, path STRING) RETURNS STRING",
        f"CASE WHEN hl7_atom(raw, path) <> '\"\"' THEN CASE WHEN upper(left(path, 3)) = 'MSH' AND {_path_part(3)} <= 2 THEN hl7_atom(raw, path) ELSE hl7_read(hl7_atom(raw, path), hl7_delims(raw)) END END"),
    _function("hl7_presence(raw STRING, path STRING) RETURNS STRING",
        "CASE WHEN hl7_atom(raw, path) IS NULL THEN 'missing' WHEN hl7_atom(raw, path) = '\"\"' THEN 'null' WHEN hl7_atom(raw, path) = '' THEN 'empty' ELSE 'value' END"),
]


def register(spark: SparkSession) -> None:
    """SQL: ``hl7_get(raw, path)``, ``hl7_presence(raw, path)``, ``hl7_unescape(text)``, ``hl7_segment_ids(raw)`` and
    ``hl7_segments(raw)``, all without Python code at run time.

    The path is a value, so it may come from a column; one that can't be read gives null. A message that
    can't be parsed isn't refused here: use ``parse`` to learn of it.
    """
    lines = "filter(transform(split(raw, '\\r', -1), x -> regexp_replace(x, '^\\n', '')), x -> x <> '')"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION hl7_segment_ids(raw STRING) RETURNS ARRAY<STRING> RETURN transform({lines}, x -> left(x, 3))")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION hl7_segments(raw STRING) RETURNS TABLE(seg_idx INT, line STRING) RETURN SELECT pos, col FROM posexplode({lines})")
    for statement in PATH_FUNCTIONS:
        spark.sql(statement)
    spark.sql(_function("hl7_unescape(t STRING) RETURNS STRING", f"hl7_read(t, '{CANONICAL_TEXT}')"))
