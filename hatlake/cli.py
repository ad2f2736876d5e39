"""``python -m hatlake.cli COMMAND``: the verbs on folders of message files."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import api
from .operators import corpus, evidence
from .sources import mllp


def _read(spark: SparkSession, path: str) -> DataFrame:
    return api.parse(mllp.read_files(spark, path))


def _show(frame: DataFrame, out: str | None) -> None:
    if out:
        frame.write.mode("overwrite").json(out)
    else:
        for line in frame.toJSON().toLocalIterator():
            print(line)


def main(argv: list[str] | None = None) -> int:
    """Returns 1 if something that was checked failed."""
    p = argparse.ArgumentParser(prog="hatlake")
    p.add_argument("--out")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("parse", "norm", "stats", "doctor", "summarize", "fingerprint", "ack"):
        sub.add_parser(name).add_argument("path")
    for name in ("val", "redact"):
        c = sub.add_parser(name)
        c.add_argument("path")
        c.add_argument("rules")
    for name in ("lint", "explain"):
        sub.add_parser(name).add_argument("profile")
    c = sub.add_parser("diff")
    c.add_argument("before")
    c.add_argument("after")
    c = sub.add_parser("bundle")
    for x in ("path", "profile", "policy", "target"):
        c.add_argument(x)
    c = sub.add_parser("replay")
    for x in ("path", "profile", "today"):
        c.add_argument(x)
    c = sub.add_parser("test")
    c.add_argument("profile")
    c.add_argument("fixtures", help="a folder with valid and invalid")
    c = sub.add_parser("sample")
    c.add_argument("path")
    c.add_argument("count", type=int)
    c.add_argument("--seed", type=int, default=0)
    c = sub.add_parser("gen")
    c.add_argument("template")
    c.add_argument("count", type=int)
    c.add_argument("--seed", type=int, default=0)
    a = p.parse_args(argv)
    if a.command in ("lint", "explain"):
        with open(a.profile, encoding="utf-8") as f:
            text = f.read()
        found = api.profile_lint(text) if a.command == "lint" else api.profile_explain(text)
        print(json.dumps(found, indent=2))
        return int(a.command == "lint" and any(i["severity"] == "error" for i in found))
    spark = SparkSession.builder.appName("hatlake").getOrCreate()
    if a.command == "gen":
        import yaml

        with open(a.template, encoding="utf-8") as f:
            _show(api.generate(spark, yaml.safe_load(f), a.seed, a.count), a.out)
        return 0
    if a.command == "replay":
        checks = api.replay(spark, a.path, api.load_profile(a.profile), a.today)
        _show(checks, a.out)
        return int(not checks.filter("NOT ok").isEmpty())
    if a.command == "test":
        kinds = F.substring_index("msg_id", "/", 1)
        files = mllp.read_files(spark, a.fixtures).withColumn("kind", kinds).filter(kinds.isin("valid", "invalid"))
        failed = api.profile_folder(files, api.load_profile(a.profile))
        _show(failed, a.out)
        return int(not failed.filter("NOT passed").isEmpty())
    if a.command == "doctor":
        _show(mllp.read_files(spark, a.path).select("msg_id", evidence.diagnostics(F.col("bytes")).alias("found")), a.out)
        return 0
    if a.command == "diff":
        for name, frame in api.corpus_diff(*[_read(spark, x) for x in (a.before, a.after)]).items():
            _show(frame.withColumn("of", F.lit(name)), a.out and f"{a.out}/{name}")
        return 0
    if a.command == "bundle":
        with open(a.policy, encoding="utf-8") as f:
            api.bundle(mllp.read_files(spark, a.path), api.load_profile(a.profile), f.read(), a.target)
        return 0
    rows = _read(spark, a.path)
    good = rows.filter("parse_error IS NULL")
    if a.command == "parse":
        _show(api.to_json(good), a.out)
        return int(not rows.filter("parse_error IS NOT NULL").isEmpty())
    if a.command == "norm":
        _show(api.normalize(good), a.out)
    elif a.command == "ack":
        _show(api.ack(good), a.out)
    elif a.command == "sample":
        chosen = good.orderBy(F.xxhash64(F.lit(a.seed), "msg_id"), "msg_id").limit(a.count)
        _show(chosen.select("msg_id", F.col("raw").cast("string").alias("raw")), a.out)
    elif a.command == "stats":
        _show(corpus.samples(good.withColumn("ordinal", F.xxhash64("msg_id"))), a.out)
    elif a.command == "summarize":
        for name, frame in api.corpus_summary(rows).items():
            _show(frame.withColumn("of", F.lit(name)), a.out and f"{a.out}/{name}")
    elif a.command == "fingerprint":
        _show(api.corpus_fingerprint(rows), a.out)
    elif a.command == "val":
        report = api.validate(good, api.load_profile(a.rules))
        _show(report, a.out)
        return int(not report.filter("NOT valid").isEmpty())
    elif a.command == "redact":
        with open(a.rules, encoding="utf-8") as f:
            done, _ = api.redact(good, f.read())
        _show(api.normalize(done.filter("lines IS NOT NULL"), canonical=False), a.out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
