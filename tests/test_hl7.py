"""The HL7 engine on verbatim messages, and its oracles on the smallest tables."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hatlake import api
from hatlake.functions.delims import Delims
from hatlake.functions.text import escape, unescape
from hatlake.operators import batch, corpus, evidence, redact, validate, write
from hatlake.operators.parse import atoms, parse, parsed
from hatlake.plans import profile
from hatlake.plans.paths import Message, PathError, parse_path
from hatlake.sources import derived, mllp
from hatlake.streaming import events

ADT = "MSH|^~\\&|App|Fac|EHR|HOSP|20250128152312||ADT^A01|C1|P|2.5.1\rPID|1||1~2^^^X||Doe&De^John^\"\"||\"\"|X\rOBX|1|TX|a||x\\F\\y\\.br\\z\rOBX|2|NM|b||5\r"


def frame(spark, *raws):
    return spark.createDataFrame([(str(i), i, r) for i, r in enumerate(raws)], "msg_id string, ordinal long, raw string")


def test_parse_codes(spark):
    found = {r["msg_id"]: r["parse_error"] and r["parse_error"]["code"] for r in parse(derived.malformed(spark)).collect()}
    assert found == {name: code for name, _, code in derived.MALFORMED}


def test_paths_and_presence(spark):
    m, rows = Message(), parsed(frame(spark, ADT))
    get = lambda p: m.get(parse_path(p)).alias(p.replace(".", "_"))
    row = rows.select(get("PID.5"), get("PID.5.1.2"), get("PID.5.3"), get("PID.3[2].4"), get("OBX[2].5"), get("OBX.5"), get("MSH.1"), get("MSH.2"), get("ZZZ.1")).first()
    assert list(row) == ["Doe", "De", None, "X", "5", "x|y\nz", "|", "^~\\&", None]
    got = rows.select(*[m.presence(parse_path(p)) for p in ("PID.7", "PID.4", "PID.3", "PID.40", "PID.5.3")]).first()
    assert list(got) == ["null", "empty", "value", "missing", "null"]
    for bad in ("PID", "PID.0", "5.1", "PID.1.2.3.4", ""):
        with pytest.raises(PathError):
            parse_path(bad)
    assert str(parse_path("pid[2]-3[1].4")) == "PID[2].3[1].4"


def test_own_delimiters_give_equal_atoms(spark):
    own = ADT.translate(str.maketrans("|^~\\&", "*%$!?"))
    read = lambda raw: sorted(map(tuple, atoms(parsed(frame(spark, raw))).filter("NOT (seg_id = 'MSH' AND field_no = 2)").drop("msg_id").fillna("").collect()))
    plain, other = read(ADT), read(own)
    assert [r[:-3] for r in plain] == [r[:-3] for r in other] and [r[-1] for r in plain] == [r[-1] for r in other]
    assert write.wire() is not None
    assert parsed(frame(spark, own)).select(write.wire()).first()[0] == own


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="a|^~\\&FSRET.br\né", max_size=12), min_size=1, max_size=20))
def test_escape_then_unescape(spark, texts):
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", unescape(escape(F.col("t"))).alias("back"))
    assert all(r["t"] == r["back"] for r in rows.collect())


def test_escape_with_letter_delimiters(spark):
    assert spark.range(1).select(escape(F.lit("aFb\\"), Delims(field="F"))).first()[0] == "a\\F\\b\\E\\"


def test_unknown_and_unclosed_sequences_stay(spark):
    values = {"a\\X41\\b": "a\\X41\\b", "a\\F": "a\\F", "\\\\": "\\\\", "\\E\\": "\\"}
    rows = spark.createDataFrame([(k,) for k in values], "t string").select("t", unescape(F.col("t")).alias("u")).collect()
    assert {r["t"]: r["u"] for r in rows} == values


def test_profile_merge_cycle_and_lint():
    parent = profile.loads("message_structure: G\nversion: '1'\nsegments: [{id: MSH}, {id: PID}]\nlengths: [{path: PID.5, max: 80}]")
    child = profile.loads("message_structure: C\nversion: '2'\nparent: G\nsegments: [{id: PID, required: true}, {id: OBX}]")
    merged = profile.resolve(child, lambda name: parent)
    assert [s["id"] for s in merged.segments] == ["MSH", "PID", "OBX"] and merged.segments[1]["required"] and merged.lengths[0]["max"] == 80
    with pytest.raises(profile.ProfileError):
        profile.resolve(child, lambda name: profile.loads("message_structure: C\nversion: '2'\nparent: G"))
    assert [i["code"] for i in profile.lint("a: [")] == ["yaml_parse_error"]
    assert {i["code"] for i in profile.lint("message_structure: ''\nversion: ''")} == {"empty_message_structure", "empty_version"}


def test_rule_order_and_first_offender(spark):
    rules = profile.loads("message_structure: T\nversion: '1'\nsegments: [{id: OBX}, {id: PV1, required: true}]\nconstraints: [{path: PID.8, in: [M]}, {path: OBX.2, pattern: '^N'}]\nlengths: [{path: PID.5, max: 2}]")
    found = validate.issues(validate.validate(parsed(frame(spark, ADT)), rules, "20250101")).orderBy("position").select("code", "path", "value").collect()
    assert [tuple(r) for r in found] == [
        ("SEGMENT_REPETITION_NOT_ALLOWED", "OBX[2]", None), ("MISSING_REQUIRED_SEGMENT", "PV1", None), ("VALUE_NOT_IN_CONSTRAINT", "PID.8", "X"), ("PATTERN_MISMATCH", "OBX.2", "TX"), ("VALUE_TOO_LONG", "PID.5", "Doe")]


def test_redaction_fails_closed(spark):
    rules = [redact.Rule(parse_path("PID.3"), "hash", "r")]
    row = redact.redact(parsed(frame(spark, ADT)), rules).first()
    assert row["lines"] is None and any("PID.5" in e for e in row["policy_errors"])
    for bad in ("", '[[rules]]\npath = "MSH.2"\naction = "drop"\nreason = "r"', '[[rules]]\npath = "PID.5"\naction = "retain"\nreason = "r"', '[[rules]]\npath = "PID.5"\naction = "drop"'):
        with pytest.raises(redact.PolicyError):
            redact.load_policy(bad)


def test_frames_cut_anywhere():
    data = b"junk\x0bone\x1c\r\x0btwo\x1c\r\x0bthr"
    for cut in range(len(data)):
        first, rest = mllp.take_frames(data[:cut])
        more, left = mllp.take_frames(rest + data[cut:])
        assert first + more == [b"one", b"two"] and left == b"\x0bthr"


def test_stream_reassembly(spark, tmp_path):
    chunks = [("c", 0, b"\x0bab"), ("c", 1, b"c\x1c\r\x0bd"), ("c", 2, b"\x1c\r")]
    spark.createDataFrame(chunks, "connection string, seq long, bytes binary").write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("connection string, seq long, bytes binary").parquet(str(tmp_path / "in"))
    q = mllp.stream_frames(source).writeStream.format("memory").queryName("frames").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert [bytes(r["payload"]) for r in spark.sql("SELECT * FROM frames ORDER BY frame").collect()] == [b"abc", b"d"]


def test_events(spark):
    rows = events.events(frame(spark, "MSH|^~\\&|A\rPID|1|x\r")).orderBy("seq").select("event", "seg_id", "field_num", "value").collect()
    assert [tuple(r) for r in rows] == [("start_message", None, None, None), ("field", "MSH", 1, ""), ("field", "MSH", 2, "A"), ("segment", "PID", None, None), ("field", "PID", 1, "1"), ("field", "PID", 2, "x"), ("end_message", None, None, None)]


def test_bundle_replay(spark, tmp_path):
    from hatlake.plans.registry import POLICY, PROFILE

    rows = frame(spark, ADT, ADT.replace("|X\r", "|F\r"))
    evidence.bundle(rows, profile.loads(PROFILE), POLICY, str(tmp_path / "b"), "20250101")
    checks = evidence.replay(spark, str(tmp_path / "b"), profile.loads(PROFILE), "20250101").collect()
    assert len(checks) == 10 and all(r["ok"] for r in checks)
    spark.read.parquet(str(tmp_path / "b/reports")).limit(1).write.mode("overwrite").parquet(str(tmp_path / "x"))
    spark.read.parquet(str(tmp_path / "x")).write.mode("overwrite").parquet(str(tmp_path / "b/reports"))
    assert not all(r["ok"] for r in evidence.replay(spark, str(tmp_path / "b"), profile.loads(PROFILE), "20250101").collect())


def test_sql_functions(spark):
    api.register(spark)
    assert spark.sql("SELECT hl7_segment_ids('MSH|^~\\\\&|A\rPID|1\r')").first()[0] == ["MSH", "PID"]
    assert spark.sql("SELECT hl7_unescape('a\\\\F\\\\b')").first()[0] == "a|b"


def test_split_sizes(spark):
    rows = spark.range(103).select(F.col("id").cast("string").alias("path"))
    found = {r["split"]: r["count"] for r in corpus.splits(rows, (0.7, 0.2, 0.1), 3).groupBy("split").count().collect()}
    assert found == {"train": 72, "validation": 21, "test": 10}


def test_json_covers():
    assert evidence.json_covers({"a": [1, {"b": 2}], "c": 3}, {"a": [{"b": 2}]})
    assert not evidence.json_covers({"a": [1]}, {"a": [2]})


def test_lenient_messages_of_nested_batches(spark):
    text = "FHS|^~\\&\rBHS|^~\\&\rMSH|^~\\&|A\rPID|1\rMSH|^~\\&|B\rBTS|2\rBHS|^~\\&\rMSH|^~\\&|C\rBTS|1\rFTS|3\r"
    files = spark.createDataFrame([("f", text)], "file_id string, raw string")
    assert [(r["batch"], r["message"]) for r in batch.messages(files).orderBy("message").collect()] == [(1, 1), (1, 2), (2, 3)]
    assert batch.check(files).first()["error"] is None


@pytest.mark.parametrize("kind", ["unescape", "write", "segments", "normalise"])
def test_time_is_proportional_to_the_message(spark, kind):
    import time

    def took(n):
        if kind == "segments":
            rows = frame(spark, "MSH|^~\\&|A\r" + "OBX|1\rNTE|1\r" * n)
            work = lambda df: atoms(parsed(df)).agg(F.max("seg_rep"))
        else:
            rows = frame(spark, "MSH|^~\\&|A\rOBX|1|TX|" + "a\\F\\b^c" * n)
            column = {"unescape": unescape(F.element_at("lines", -1)), "write": write.wire(), "normalise": write.normalised()}[kind]
            work = lambda df: parsed(df).agg(F.sum(F.length(column)))
        work(rows).collect()
        begun = time.perf_counter()
        work(rows).collect()
        return time.perf_counter() - begun

    small, large = took(1000), took(16000)
    assert large < 16 * small + 2, (small, large)


def test_unknown_and_unclosed_sequences_are_written_as_text(spark):
    for delims in ("|^~\\&", "*%$!?"):
        own = lambda raw, delims=delims: raw.translate(str.maketrans("|^~\\&", delims))
        raw = own("MSH|^~\\&|A\rOBX|1|TX|x\\X41\\y^a\\b&\\F\\\\.br\\~\"\"\r")
        want = own("MSH|^~\\&|A\rOBX|1|TX|x\\E\\X41\\E\\y^a\\E\\b&\\F\\\\.br\\~\"\"\r")
        row = parsed(frame(spark, raw)).select(write.wire().alias("w"), write.message_hash().alias("h")).first()
        assert row["w"] == want and row["h"] == __import__("hashlib").sha256(want.encode()).hexdigest()


def test_rules_on_one_field_apply_in_order(spark):
    rules = [redact.Rule(parse_path(p), a, "r") for p, a in (("PID.3[2].1", "drop"), ("PID.3[1]", "hash"), ("OBX[2].5", "drop"), ("PID.5.1.2", "drop"), ("PID.3[9]", "drop"))]
    rules = [*rules[:4], redact.Rule(rules[4].path, "drop", "r", True)]
    raw = ADT.replace("Doe&De^John^\"\"", "\"\"&\"\"")
    row = redact.redact(parsed(frame(spark, raw)), rules).first()
    digest = __import__("hashlib").sha256(b"1").hexdigest()
    assert row["matched"] == [1, 1, 1, 1, 0]
    assert row["policy_errors"] == ["sensitive field PID.3 isn't covered", "sensitive field PID.5 isn't covered", "sensitive field PID.7 isn't covered"] and row["lines"] is None
    free = redact.redact(parsed(frame(spark, raw.replace("PID|", "ZPI|"))), [redact.Rule(parse_path(str(r.path).replace("PID", "ZPI")), r.action, "r", r.optional) for r in rules]).first()
    assert free["lines"][1] == f"ZPI|1||hash:sha256:{digest}~^^^X||\"\"&||\"\"|X" and free["lines"][3] == "OBX|2|NM|b||"


def test_a_pattern_that_is_none_matches_nothing(spark):
    from hatlake.functions import datatypes

    assert list(spark.range(1).select(datatypes.matches_all(F.lit("a("), ["^a", "("]), datatypes.matches_all(F.lit("ab"), ["^a", "b$"])).first()) == [False, True]


def test_over_long_frames_are_reported():
    take = mllp.take_frames
    assert take(b"junk\x0babc\x1c\r\x0b" + b"x" * 20 + b"\x1c\r\x0bok\x1c\r\x0bpart", limit=10) == ([b"abc", None, b"ok"], b"\x0bpart")
    assert take(b"\x0b" + b"x" * 20, limit=10) == ([None], b"") and take(b"xxx\x1c\r\x0bok\x1c\r", limit=10) == ([b"ok"], b"")


def test_files_are_named_by_their_place(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "x.hl7").write_bytes(b"MSH|^~\\&|A\r")
    (tmp_path / "a" / "b" / "y.hl7").write_bytes(b"\x0bMSH|^~\\&|A\r\x1c\r")
    (tmp_path / "a" / "b" / "z.hl7").write_bytes(b"\x0bMSH|")
    found = {r["msg_id"]: (r["raw"] and bytes(r["raw"]), r["framing_error"]) for r in mllp.read_files(spark, f"{tmp_path}/a").collect()}
    assert found == {"x.hl7": (b"MSH|^~\\&|A\r", None), "b/y.hl7": (b"MSH|^~\\&|A\r", None), "b/z.hl7": (None, "missing end block")}


def test_reader_opens_a_closed_connection_again():
    import socket
    import threading

    server = socket.create_server(("localhost", 0))

    def serve():
        for data in (b"one", b"two"):
            connection, _ = server.accept()
            connection.sendall(data)
            connection.close()

    threading.Thread(target=serve, daemon=True).start()
    reader = mllp.MllpReader({"host": "localhost", "port": str(server.getsockname()[1])})
    got, at = [], reader.initialOffset()
    for _ in range(20):
        rows, at = reader.read(at)
        got += [r[2] for r in rows]
        if len(got) == 2:
            break
    server.close()
    assert got == [b"one", b"two"] and reader.read(at)[1] == at


def test_splits_rank_only_borders(spark):
    rows = spark.range(5000).select(F.concat(F.lit("m"), F.col("id").cast("string")).alias("path"))
    found = corpus.splits(rows, (0.8, 0.1, 0.1), seed=3)
    counts = {r["split"]: r["count"] for r in found.groupBy("split").count().collect()}
    assert counts == {"train": 4000, "validation": 500, "test": 500} and found.count() == 5000
    order = [r["split"] for r in found.orderBy(F.xxhash64(F.lit(3), "path"), "path").collect()]
    assert order == ["train"] * 4000 + ["validation"] * 500 + ["test"] * 500


def test_command_line(tmp_path, capsys, spark):
    import json

    from hatlake import cli

    profile_text = "message_structure: ADT_A01\nversion: '2.5.1'\nconstraints: [{path: PID.3, required: true}]\n"
    (tmp_path / "p.yaml").write_text(profile_text)
    for kind, raw in (("valid", ADT), ("invalid", ADT.replace("1~2^^^X", "")), ("valid", ADT.replace("1~2^^^X", ""))):
        (tmp_path / "fixtures" / kind).mkdir(parents=True, exist_ok=True)
        (tmp_path / "fixtures" / kind / f"{len(raw)}.hl7").write_bytes(raw.encode())

    def lines(*argv):
        code = cli.main(list(argv))
        return code, [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]

    folder = str(tmp_path / "fixtures")
    code, found = lines("test", str(tmp_path / "p.yaml"), folder)
    assert code == 1 and sorted((r["kind"], r["valid"], r["passed"]) for r in found) == [("invalid", False, True), ("valid", False, False), ("valid", True, True)]
    assert lines("parse", folder)[0] == 0 and len(lines("sample", folder, "2")[1]) == 2
    assert {r["valid"] for r in lines("val", folder, str(tmp_path / "p.yaml"))[1]} == {True, False}
    code, found = lines("diff", f"{folder}/valid", f"{folder}/invalid")
    assert code == 0 and {r["of"] for r in found} >= {"totals", "message_types", "segments", "fields"}
    assert cli.main(["lint", str(tmp_path / "p.yaml")]) == 0


def test_safe_analysis(spark):
    import hashlib

    policy = "\n".join(f'[[rules]]\npath = "{p}"\naction = "{a}"\nreason = "r"\noptional = true' for p, a in (("PID.3", "hash"), ("PID.5", "drop"), ("PID.7", "drop")))
    covered = ADT
    uncovered = ADT.replace("||\"\"|X", "||\"\"|X|||secret street")
    rows = {r["msg_id"]: r for r in api.safe_analysis(frame(spark, covered, uncovered, "PID|1"), policy).collect()}
    assert [rows[k]["status"] for k in "012"] == ["redacted", "refused", "unreadable"]
    assert "Doe" not in rows["0"]["raw"] and rows["0"]["raw"].startswith("MSH|^~\\&|App") and rows["1"]["raw"] is None and rows["2"]["raw"] is None
    assert rows["0"]["input_sha256"] == hashlib.sha256(covered.encode()).hexdigest() and rows["0"]["output_sha256"] == hashlib.sha256(rows["0"]["raw"].encode()).hexdigest()
    assert rows["1"]["errors"] == ["sensitive field PID.11 isn't covered"] and rows["2"]["errors"] == ["InvalidSegmentId"] and rows["1"]["output_sha256"] is None
    assert {r["policy_sha256"] for r in rows.values()} == {hashlib.sha256(policy.encode()).hexdigest()}


def test_templates_share_rows_by_weight(spark):
    from hatlake.operators import generate

    one = lambda name: {"name": name, "segments": [f"MSH|^~\\&|{name}"]}
    counts = {r["template"]: r["count"] for r in generate.generate(spark, [(one("a"), 3), (one("b"), 1)], 9, 4000).groupBy("template").count().collect()}
    assert set(counts) == {"a", "b"} and abs(counts["a"] - 3000) < 150
    for source in ("NoSuchKind", "DuplicateDelims"):
        with pytest.raises(generate.TemplateError):
            generate.generate(spark, {"segments": ["MSH|^~\\&|x"], "values": {"MSH.3": [source]}}, 1, 1)


def test_batches_of_bounded_size(spark):
    rows = spark.range(25).select((F.col("id") % 2).alias("who"), F.col("id").alias("ordinal"), F.concat(F.lit("MSH|^~\\&|A"), F.col("id").cast("string")).alias("raw"))
    made = batch.write_batch(rows, "who", size=5)
    found = made.select(F.concat_ws("/", "who", "part").alias("file_id"), "raw")
    checked = {r["file_id"]: (r["messages"], r["error"]) for r in batch.check(found).collect()}
    assert checked == {"0/0": (5, None), "0/1": (5, None), "0/2": (3, None), "1/0": (5, None), "1/1": (5, None), "1/2": (2, None)}
    first = made.filter("who = 0 AND part = 1").first()["raw"]
    assert [x for x in first.split("\r") if x.startswith("MSH")] == [f"MSH|^~\\&|A{i}" for i in (10, 12, 14, 16, 18)]
