"""Evidence bundles, their replay, quarantine, and profile fixture tests."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import sha256
from ..plans.profile import Profile
from . import redact, validate, write
from .parse import parsed, trace_type

#: The tables of a bundle.
ARTIFACTS = ("messages", "reports", "issues", "trace", "receipt", "environment", "manifest")


def bundle(messages: DataFrame, profile: Profile, policy: str, path: str, today: str, key: str = "msg_id", raw: str = "raw") -> None:
    """Write a bundle of a corpus: redacted messages, reports, traces, receipt and a manifest of digests.

    Only messages that the policy covers are written; others are counted in ``environment`` and left out.
    """
    from .. import __version__

    spark = messages.sparkSession
    rules, policy_digest = redact.load_policy(policy)
    good = parsed(messages, raw)
    done = redact.redact(good, rules)
    safe = done.filter("lines IS NOT NULL")
    checked = validate.validate(safe, profile, today)
    wire = safe.select(key, sha256(F.col(raw)).alias("input_sha256"), write.wire().alias("redacted"), trace_type().alias("message_type"))
    wire.withColumn("redacted_sha256", sha256(F.col("redacted"))).write.parquet(f"{path}/messages")
    validate.report(checked, key).write.parquet(f"{path}/reports")
    validate.issues(checked, key).drop("value").write.parquet(f"{path}/issues")
    redact.trace(done, rules, key).write.parquet(f"{path}/trace")
    redact.receipt(safe, rules).write.parquet(f"{path}/receipt")
    refused = done.agg(F.count_if(F.col("lines").isNull()).alias("refused"))
    refused.select("refused", F.lit(policy_digest).alias("policy_sha256"), F.lit(__version__).alias("tool_version"), F.lit(today).alias("today")).write.parquet(f"{path}/environment")
    digests = [_digest(spark.read.parquet(f"{path}/{name}")).select(F.lit(name).alias("artifact"), "rows", "digest") for name in ARTIFACTS[:-1]]
    manifest = digests[0]
    for one in digests[1:]:
        manifest = manifest.unionByName(one)
    manifest.write.parquet(f"{path}/manifest")


def _digest(frame: DataFrame) -> DataFrame:
    """Rows and a digest of a table that doesn't depend on their order: the sum of the rows' hashes."""
    row = F.conv(F.substring(F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(frame.columns)])), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return frame.agg(F.count("*").alias("rows"), F.coalesce(F.sum(row), F.lit(0)).cast("string").alias("digest"))


def replay(spark: SparkSession, path: str, profile: Profile, today: str, key: str = "msg_id") -> DataFrame:
    """check and ok: the catalog, each table's digest, each message's digest, and reports made again."""
    stored = {row["artifact"]: (row["rows"], row["digest"]) for row in spark.read.parquet(f"{path}/manifest").collect()}
    checks = [("catalog", sorted(stored) == sorted(ARTIFACTS[:-1]))]
    for name in ARTIFACTS[:-1]:
        found = _digest(spark.read.parquet(f"{path}/{name}")).first()
        checks.append((f"digest {name}", stored.get(name) == (found["rows"], found["digest"])))
    messages = spark.read.parquet(f"{path}/messages")
    checks.append(("message digests", messages.filter(sha256(F.col("redacted")) != F.col("redacted_sha256")).isEmpty()))
    again = validate.report(validate.validate(parsed(messages.select(key, F.col("redacted").alias("raw"))), profile, today), key)
    kept = spark.read.parquet(f"{path}/reports").select(*again.columns)
    checks.append(("reports", again.exceptAll(kept).isEmpty() and kept.exceptAll(again).isEmpty()))
    checks.append(("messages", again.count() == messages.count()))
    return spark.createDataFrame(checks, "check string, ok boolean")


def quarantine(checked: DataFrame, path: str, key: str = "msg_id") -> None:
    """Write what failed validation, by its first issue code: redacted message and issue codes, no values."""
    failed = checked.filter((F.size("issues") > 0) & F.col("lines").isNotNull())
    codes = F.transform("issues", lambda i: i["code"])
    failed.select(key, write.wire().alias("message"), codes.alias("codes"), F.get(codes, F.lit(0)).alias("first_code")).write.partitionBy("first_code").parquet(path)


def json_covers(actual: Any, expected: Any) -> bool:
    """Whether ``expected`` is part of ``actual``: keys of objects, and each item of a list in some item."""
    if isinstance(expected, dict):
        return isinstance(actual, dict) and all(k in actual and json_covers(actual[k], v) for k, v in expected.items())
    if isinstance(expected, list):
        return isinstance(actual, list) and all(any(json_covers(a, e) for a in actual) for e in expected)
    return type(actual) is type(expected) and actual == expected


def fixture_tests(fixtures: DataFrame, profile: Profile, today: str) -> DataFrame:
    """msg_id, passed and why of profile fixtures (msg_id, raw, expect_valid, expected_report as JSON or null).

    Fixtures are a handful of files, so their reports are compared on the driver.
    """
    spark = fixtures.sparkSession
    reports = {r["msg_id"]: r.asDict(True) for r in validate.report(validate.validate(parsed(fixtures), profile, today)).collect()}
    out = []
    for row in fixtures.select("msg_id", "expect_valid", "expected_report").collect():
        found = reports.get(row["msg_id"])
        if found is None:
            out.append((row["msg_id"], not row["expect_valid"], "can't be read"))
        elif found["valid"] != row["expect_valid"]:
            out.append((row["msg_id"], False, f"valid is {found['valid']}"))
        elif row["expected_report"] and not json_covers(found, json.loads(row["expected_report"])):
            out.append((row["msg_id"], False, "the report differs"))
        else:
            out.append((row["msg_id"], True, ""))
    return spark.createDataFrame(out, "msg_id string, passed boolean, why string")


def diagnostics(data: Column) -> Column:
    """What is odd about a file's bytes: a byte order mark, LF only line ends, an unfinished frame."""
    text = F.decode(data, "ISO-8859-1")
    return F.filter(
        F.array(
            F.when(F.startswith(text, F.lit("\xef\xbb\xbf")), "byte_order_mark"),
            F.when(F.contains(text, F.lit("\n")) & ~F.contains(text, F.lit("\r")), "line_feed_only"),
            F.when(F.startswith(text, F.lit("\x0b")) & ~F.contains(text, F.lit("\x1c\r")), "unfinished_frame"),
            F.when(~F.is_valid_utf8(data.cast("string")), "not_utf8"),
        ),
        lambda x: x.isNotNull(),
    )
