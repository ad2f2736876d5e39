"""Further registered queries: rule forms, differences, writing, envelopes, dates and SQL functions, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import datatypes as D
from ..functions import temporal as T
from ..functions.text import needs_unescaping, unescape
from ..operators import corpus, generate, validate, write
from ..operators.parse import fields, parse, parsed
from ..sources import derived, mllp
from . import profile
from .registry import ADT, FEED, TODAY, _adt, _feed, _found, _get, _halves, _issues, _LEN, _SEGMENTS, query


def _by_rule(messages, text: str):
    rules = profile.loads("message_structure: T\nversion: '2.5.1'\n" + text)
    return validate.issues(validate.validate(messages, rules, TODAY)).select("msg_id", "rule_id", "code")


#: Condition: operator and operand, and when it holds, in terms of the oracle's ADT.
_BORN_OK = "born <> '19991332'"
CONDITIONS = (
    ("{field: PID.8, operator: eq, value: F}", "sex = 'F'"), ("{field: PID.3, operator: eq, value: ''}", "ids = 0"), ("{field: PID.8, operator: ne, value: F}", "sex <> 'F'"),
    ("{field: PID.13, operator: contains, value: '55500001'}", "contains(phone, '55500001')"), ("{field: PID.8, operator: in, values: [M, X]}", "sex IN ('M', 'X')"),
    ("{field: PID.13, operator: matches_regex, value: '[05]$'}", "phone[-1] IN ('0', '5')"), ("{field: PID.13, operator: matches_regex, value: '('}", "false"),
    ("{field: PID.13, operator: gt, value: '5550000700'}", "phone::BIGINT > 5550000700"), ("{field: PID.13, operator: lt, value: '5550000700'}", "phone::BIGINT < 5550000700"),
    ("{field: PID.13, operator: ge, value: '5550000700'}", "phone::BIGINT >= 5550000700"), ("{field: PID.13, operator: le, value: '5550000700'}", "phone::BIGINT <= 5550000700"),
    ("{field: PV1.1, operator: exists}", "pv1 > 0"), ("{field: PV1.1, operator: not_exists}", "pv1 = 0"), ("{field: NK1.1, operator: missing}", "k % 3 <> 0"),
    ("{field: PID.7, operator: is_date}", _BORN_OK), ("{field: PID.7, operator: before, value: '1970'}", f"{_BORN_OK} AND born < '1970'"), ("{field: PID.7, operator: before, value: EVN.2}", _BORN_OK),
    ("{field: PID.7, operator: within_range, values: ['19600101', '19700101']}", f"{_BORN_OK} AND born BETWEEN '19600101' AND '19700101' OR born::BIGINT BETWEEN 19600101 AND 19700101"),
    ("{field: PID.7, operator: no_such}", "false"),
)


@query(f"WITH {ADT} " + " UNION ALL ".join(f"SELECT msg_id, 'c{i}' AS rule_id, 'CROSS_FIELD_ASSERTION_FAILED' AS code FROM a WHERE NOT ({holds})" for i, (_, holds) in enumerate(CONDITIONS)))
def condition_operators(spark, d):
    """An assertion for each condition operator: it fails where the condition doesn't hold."""
    rules = ", ".join(f"{{id: c{i}, description: d, validation_mode: assert, conditions: [{c}]}}" for i, (c, _) in enumerate(CONDITIONS))
    return _by_rule(_adt(spark, d), f"cross_field_rules: [{rules}]")


#: Script and when it is violated. Scripts see the first value of each repetition, and empty ones too.
SCRIPTS = (
    ("field(PID.13).length() > 9", "false"), ("field(PID.13).length() > 10", "true"), ("field(PID.8) in ['M', 'F']", "sex = 'X'"), ("field(PID.13).matches_regex('5$')", "phone[-1] <> '5'"),
    ("field(PID.13).matches_regex('(')", "true"), ("field(PID.13).starts_with('5550')", "phone[1:4] <> '5550'"), ("field(PID.13).ends_with('7')", "phone[-1] <> '7'"), ("field(PID.8).is_numeric()", "true"),
    ("field(PID.13).is_numeric()", "false"), ("field(EVN.2) == field(MSH.7)", "false"), ("field(PID.8) == field(PV1.2)", "pv1 > 0"), ("field(PID.13).is_phone_number()", "false"), ("field(PID.13).is_email()", "true"),
    ("field(PID.13).is_ssn()", "true"), ("field(PID.7).is_valid_birth_date()", "born = '19991332'"), ("is_valid_age_range(field(PID.7), field(PV1.1))", "pv1 > 0"),
    ("field(PID.13) between 5550000100 and 5550000200", "phone::BIGINT NOT BETWEEN 5550000100 AND 5550000200"), ("field(PID.13) is odd", "false"),
)


@query(f"WITH {ADT} " + " UNION ALL ".join(f"SELECT msg_id, 's{i}' AS rule_id, 'CUSTOM_RULE_VIOLATION' AS code FROM a WHERE {bad}" for i, (_, bad) in enumerate(SCRIPTS)))
def script_forms(spark, d):
    return _by_rule(_adt(spark, d), "custom_rules: [" + ", ".join(f"{{id: s{i}, description: d, script: \"{s}\"}}" for i, (s, _) in enumerate(SCRIPTS)) + "]")


@query(f"WITH {ADT} " + _found("CROSS_FIELD_VALIDATION_ERROR", "PID.7", "born", "pv1 > 0 AND born = '19991332'") + " UNION ALL " + _found("CROSS_FIELD_VALIDATION_ERROR", "PID.8", "sex", "pv1 > 0 AND sex = 'X'")
 + " UNION ALL " + _found("CONTEXTUAL_VALIDATION_ERROR", "NK1.1", "NULL::VARCHAR", "sex = 'F' AND k % 3 <> 0") + " UNION ALL " + _found("CONTEXTUAL_VALIDATION_ERROR", "PID.7", "born",
     "sex = 'F' AND born = '19991332'"))
def rule_actions(spark, d):
    """The action that validates, and contextual rules that require and that check a type."""
    text = """valuesets: [{path: ZZZ.1, name: SEX, codes: [M, F]}]
cross_field_rules: [{id: r, description: d, conditions: [{field: PV1.1, operator: exists}], actions: [{field: PID.7, action: validate, datatype: DT}, {field: PID.8, action: validate, valueset: SEX}]}]
contextual_rules: [{id: a, description: d, context_field: PID.8, context_value: F, target_field: NK1.1, validation_type: require},
 {id: b, description: d, context_field: PID.8, context_value: F, target_field: PID.7, validation_type: validate_datatype, parameters: {datatype: DT}}]"""
    return _issues(_adt(spark, d), text)


_PARENT = "message_structure: T\nversion: '1'\nsegments: [{id: PV1, required: true}]\nconstraints: [{path: PID.8, in: [M]}, {path: PID.3, required: true}]\nvaluesets: [{path: PV1.2, name: CLS, codes: [O]}]"
_CHILD = "message_structure: T\nversion: '1'\nparent: base\nconstraints: [{path: PID.8, in: [M, F]}]\ndatatypes: [{path: PID.7, type: DT}]"


@query(f"WITH {ADT} " + " UNION ALL ".join([
    _found("MISSING_REQUIRED_SEGMENT", "PV1", "NULL::VARCHAR", "pv1 = 0"), _found("SEGMENT_REPETITION_NOT_ALLOWED", "PV1[2]", "NULL", "pv1 = 2"), _found("VALUE_NOT_IN_CONSTRAINT", "PID.8", "sex", "sex = 'X'"),
    _found("MISSING_REQUIRED_FIELD", "PID.3", "NULL", "ids = 0"), _found("VALUE_NOT_IN_SET", "PV1.2", "'I'", "pv1 > 0 AND k % 4 = 0"), _found("INVALID_DATA_TYPE", "PID.7", "born", "born = '19991332'")]))
def inherited_profile(spark, d):
    """A profile with a parent: its own constraint on a path takes the place of the parent's, all others add up."""
    merged = profile.resolve(profile.loads(_CHILD), lambda name: profile.loads(_PARENT))
    return validate.issues(validate.validate(_adt(spark, d), merged, TODAY)).select("msg_id", "code", "path", "value")


# --- generated values ---------------------------------------------------------------------------------------------------

#: Source of a generated value, and what every value of it matches.
KINDS = (
    ({"type": "Fixed", "value": "a|b"}, r"^a\|b$"), ({"type": "From", "value": ["x", "y"]}, "^[xy]$"), ({"type": "Map", "value": {"k": "v1", "l": "v2"}}, "^v[12]$"), ({"type": "Numeric", "value": {"digits": 5}}, "^[0-9]{5}$"),
    ({"type": "Date", "value": {"start": "20200101", "end": "20201231"}}, "^2020(0[1-9]|1[0-2])([0-2][0-9]|3[01])$"), ({"type": "Gaussian", "value": {"mean": 100, "sd": 1, "precision": 1}}, r"^(9|10)[0-9]\.[0-9]$"),
    ("UuidV4", "^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-8[0-9a-f]{3}-[0-9a-f]{12}$"), ("DtmNowUtc", "^20[0-9]{12}$"), ({"type": "RealisticName", "value": {"gender": "F"}}, r"^[A-Z][a-z]+\^(Ada|Bea|Cora|Dina|Elsa|Fern|Gwen)$"),
    ("RealisticAddress", r"^[0-9]+ [A-Za-z ]+\^\^[A-Za-z]+\^ST\^[0-9]{5}$"), ("RealisticPhone", r"^\([2-9][0-9]{2}\)555-[0-9]{4}$"), ("RealisticSsn", "^[1-6][0-9]{2}-[0-9]{2}-[0-9]{4}$"), ("RealisticMrn", "^[0-9]{8}$"),
    ("RealisticIcd10", r"^[A-Z][0-9]+(\.[0-9]+)?$"), ("RealisticLoinc", "^[0-9]+-[0-9]$"), ("RealisticMedication", "^[A-Z][a-z]+$"), ("RealisticAllergen", "^[A-Z][a-z]+$"), ("RealisticBloodType", r"^(A|B|AB|O)[+-]$"),
    ("RealisticEthnicity", "^[HNU]$"), ("RealisticRace", "^[0-9]{4}-[0-9]$"),
)


@query(f"SELECT unnest(range(1, {len(KINDS) + 1})) AS kind, (SELECT count(*) FROM customer) AS n")
def value_kinds(spark, d):
    """Messages whose value of each kind has the form that it should have."""
    sources = {f"ZVK.{i}": [s] for i, (s, _) in enumerate(KINDS, 1)}
    template = {"name": "kinds", "segments": ["MSH|^~\\&|GEN|LAB|||20240101||ADT^A01|1|P|2.5.1", "ZVK" + "|x" * len(KINDS)], "values": sources}
    made = generate.generate(spark, template, 5, spark.read.parquet(f"{d}/customer.parquet").count()).withColumn("msg_id", F.col("ordinal").cast("string"))
    rows = fields(parsed(made), only=("ZVK",)).select(F.col("field_no").alias("kind"), unescape(F.col("raw"), F.col("delims")).alias("text"))
    fits = F.lit(False)
    for i, (_, pattern) in enumerate(KINDS, 1):
        fits |= (F.col("kind") == i) & F.col("text").rlike(pattern)
    return rows.filter(fits).groupBy("kind").agg(F.count("*").alias("n")).select(F.col("kind").cast("long").alias("kind"), "n")


# --- differences of corpora ----------------------------------------------------------------------------------

_PER_DAY = "count(*) FILTER (ts < TIMESTAMP '2024-01-16')", "count(*) FILTER (ts >= TIMESTAMP '2024-01-16')"


@query(f"""WITH {FEED}, t AS (SELECT {_PER_DAY[0]} AS x, {_PER_DAY[1]} AS y, sum({_LEN}) FILTER (ts < TIMESTAMP '2024-01-16')::BIGINT AS u, sum({_LEN}) FILTER (ts >= TIMESTAMP '2024-01-16')::BIGINT AS v FROM f)
SELECT unnest(['file_count', 'message_count', 'parse_error_count', 'total_bytes']) AS metric, unnest([x, x, 0, u]) AS before, unnest([y, y, 0, v]) AS after, unnest([y - x, y - x, 0, v - u]) AS delta FROM t""")
def corpus_diff_totals(spark, d):
    cut = F.lit("2024-01-16").cast("timestamp")
    feed = parse(derived.feed(spark, d))
    return corpus.totals_diff(corpus.totals(feed.filter(F.col("ts") < cut)), corpus.totals(feed.filter(F.col("ts") >= cut)))


_SHAPED = """p AS (SELECT ts, event_type, value || '.' || unnest(CASE value WHEN 'MSH' THEN [2, 3, 4, 5, 6, 7, 9, 10, 11, 12] WHEN 'EVN' THEN [1, 2] WHEN 'PID' THEN [1, 3]
 WHEN 'OBX' THEN [1, 2, 3, 5] ELSE [1, 2] END)::VARCHAR AS path FROM s),
b AS (SELECT path, count(*) FILTER (ts < TIMESTAMP '2024-01-16') AS x, count(*) FILTER (ts >= TIMESTAMP '2024-01-16') AS y FROM p GROUP BY 1),
n AS (SELECT count(*) FILTER (ts < TIMESTAMP '2024-01-16') AS x, count(*) FILTER (ts >= TIMESTAMP '2024-01-16') AS y FROM f)"""


@query(f"""WITH {FEED}, {_SEGMENTS}, {_SHAPED}, c AS (SELECT path, (b.x = n.x)::BIGINT AS l0, (b.y = n.y)::BIGINT AS l1, (b.x > 0)::BIGINT AS m0, (b.y > 0)::BIGINT AS m1, b.x, b.y FROM b, n)
SELECT path, l0 AS min_per_message_before, l1 AS min_per_message_after, l1 - l0 AS min_per_message_delta, m0 AS max_per_message_before, m1 AS max_per_message_after, m1 - m0 AS max_per_message_delta,
 x AS total_occurrences_before, y AS total_occurrences_after, y - x AS total_occurrences_delta FROM c WHERE l0 <> l1 OR m0 <> m1 OR x <> y""")
def corpus_diff_cardinality(spark, d):
    before, after = _halves(spark, d)
    return corpus.diff(corpus.field_cardinality(before), corpus.field_cardinality(after), "path", ("min_per_message", "max_per_message", "total_occurrences"))


_SHAPE_OF = "CASE WHEN path IN ('MSH.9', 'PID.3') THEN 'coded' WHEN path IN ('MSH.7', 'EVN.2') THEN 'timestamp' WHEN path IN ('PID.1', 'OBX.1', 'ZER.1', 'ZER.2') THEN 'numeric' ELSE 'text' END"


@query(f"""WITH {FEED}, {_SEGMENTS}, {_SHAPED}, c AS (SELECT path, {_SHAPE_OF} AS shape, x, y FROM b)
SELECT path, {", ".join(f"CASE WHEN shape = '{s}' THEN x ELSE 0 END AS {s}_count_before, CASE WHEN shape = '{s}' THEN y ELSE 0 END AS {s}_count_after, CASE WHEN shape = '{s}' THEN y - x ELSE 0 END AS {s}_count_delta" for s in corpus.SHAPES)} FROM c WHERE x <> y""")
def corpus_diff_shapes(spark, d):
    before, after = _halves(spark, d)
    return corpus.diff(corpus.value_shapes(before), corpus.value_shapes(after), "path", tuple(f"{s}_count" for s in corpus.SHAPES))


# --- writing and framing ------------------------------------------------------------------------------------------

_B = "chr(92)"


def _line(field: str, esc: str, x41: str, tail: str) -> str:
    """SQL of a written OBX line with these marks."""
    return f"'OBX{field}1{field}TX{field}' || c_custkey || {x41} || {esc} || '.br' || {esc} || {esc} || 'F' || {esc} || 'end' || {tail}"


@query(f"""WITH w AS (SELECT c_custkey::VARCHAR AS msg_id, CASE WHEN c_custkey % 3 = 0
 THEN 'MSH*%$!?*A' || chr(13) || {_line("*", "'!'", "'!E!X41!E!'", f"'!E!open | ^ ' || {_B}")} || chr(13)
 ELSE 'MSH|^~' || {_B} || '&|A' || chr(13) || {_line("|", _B, f"{_B} || 'E' || {_B} || 'X41' || {_B} || 'E' || {_B}", f"{_B} || 'E' || {_B} || 'open'")} || chr(13) END AS written FROM customer)
SELECT msg_id, written, sha256(written) AS message_hash FROM w""")
def write_escapes(spark, d):
    """Known, unknown and unclosed sequences, under canonical and other delimiters, read and written."""
    k = F.col("c_custkey").cast("string")
    own = F.concat(F.lit("MSH*%$!?*A\rOBX*1*TX*"), k, F.lit("!X41!!.br!!F!end!open | ^ \\\r"))
    plain = F.concat(F.lit("MSH|^~\\&|A\rOBX|1|TX|"), k, F.lit("\\X41\\\\.br\\\\F\\end\\open\r"))
    rows = spark.read.parquet(f"{d}/customer.parquet").select(k.alias("msg_id"), F.when(F.col("c_custkey") % 3 == 0, own).otherwise(plain).alias("raw"))
    return parsed(rows).select("msg_id", write.wire().alias("written"), write.message_hash().alias("message_hash"))


@query(f"WITH {ADT} SELECT msg_id, 'AE' AS code, 'C' || k AS control_id, 'no name & no | id' AS error, CASE WHEN no_name THEN 3 ELSE 2 END AS segments FROM a".replace("'no name & no | id' AS error",
    "CASE WHEN no_name THEN 'no name & no | id' END AS error"))
def ack_with_error(spark, d):
    error = F.when(_get("PID.5").isNull(), "no name & no | id")
    back = parsed(_adt(spark, d).select("msg_id", write.ack("AE", F.lit("2024-01-01 00:00:00").cast("timestamp"), error).alias("raw")))
    return back.select("msg_id", _get("MSA.1").alias("code"), _get("MSA.2").alias("control_id"), _get("ERR.3").alias("error"), F.size("lines").alias("segments"))


_CUT = "CASE c_custkey % 3 WHEN 0 THEN {} WHEN 1 THEN {} ELSE {} END"


@query(f"SELECT c_custkey AS k, {_CUT.format('NULL', repr('missing start block'), repr('missing end block'))} AS error FROM customer")
def unwrap_errors(spark, d):
    whole = mllp.wrap(F.col("c_name"))
    k = F.col("c_custkey")
    data = F.when(k % 3 == 0, whole).when(k % 3 == 1, F.col("c_name").cast("binary")).otherwise(F.call_function("substring", whole, F.lit(1), F.octet_length("c_name")))
    return spark.read.parquet(f"{d}/customer.parquet").select(k.alias("k"), mllp.unwrap_error(data).alias("error"))


@query("SELECT c_nationkey AS k, unnest(['name', 'key']) AS what, count(*) AS n, sum(strlen(c_name))::BIGINT AS name_bytes FROM customer GROUP BY 1")
def framed_buffers(spark, d):
    """Buffers of many frames with junk between them, cut into frames."""
    frames = F.array_join(F.sort_array(F.collect_list(F.concat(F.lit("junk\x0b"), F.col("c_name"), F.lit("\x1c\rmore\x0b"), F.col("c_custkey").cast("string"), F.lit("\x1c\r")))), "")
    buffers = spark.read.parquet(f"{d}/customer.parquet").groupBy(F.col("c_nationkey").alias("k")).agg(frames.cast("binary").alias("bytes"), F.sum(F.octet_length("c_name")).alias("name_bytes"))
    what = F.when(F.col("frame") % 2 == 0, "name").otherwise("key").alias("what")
    return mllp.frames(buffers).groupBy("k", what, "name_bytes").agg(F.count("*").alias("n"))


@query("SELECT contains(coalesce(text, ''), chr(92)) AS needs, count(*) AS n FROM documents GROUP BY 1")
def unescape_needed(spark, d):
    return derived.notes(spark, d).groupBy(needs_unescaping(F.coalesce("text", F.lit(""))).alias("needs")).agg(F.count("*").alias("n"))


# --- scalars --------------------------------------------------------------------------------------------------------

@query("""SELECT event_id, date_trunc('day', ts) > TIMESTAMP '2024-01-16' AS after, date_trunc('day', ts) = TIMESTAMP '2024-01-16' AS equal, true AS valid, CASE event_id % 4
 WHEN 0 THEN 'invalid_length' WHEN 1 THEN 'invalid_characters' WHEN 2 THEN 'out_of_range' ELSE 'empty' END AS error FROM events""")
def ts_relations(spark, d):
    text = F.date_format("ts", "yyyyMMddHHmm")
    bad = F.when(F.col("event_id") % 4 == 0, "20240").when(F.col("event_id") % 4 == 1, "2024-01-01").when(F.col("event_id") % 4 == 2, "20241301").otherwise(" ")
    day = F.lit("20240116")
    ok = T.is_valid_ts(text) & T.is_valid_date(F.substring(text, 1, 8)) & T.is_valid_time(F.substring(text, 9, 4)) & ~T.is_valid_ts(bad) & T.ts_error(text).isNull()
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", T.is_after(text, day).alias("after"), T.is_equal(text, day).alias("equal"), ok.alias("valid"), T.ts_error(bad).alias("error"))


@query("""WITH c AS (SELECT c_custkey AS k, (1940 + c_custkey % 60)::VARCHAR || '0101' AS born FROM customer)
 SELECT k, born <= '19700101' AS age, k::VARCHAR LIKE '1%' AND k::VARCHAR LIKE '%0' AS pattern, false AS broken, k > 100 AS gt, k >= 100 AS ge, k <= 100 AS le, k = 100 AS eq, k <> 100 AS ne FROM c""")
def scalar_relations(spark, d):
    k = F.col("c_custkey").cast("string")
    born = F.concat((1940 + F.col("c_custkey") % 60).cast("string"), F.lit("0101"))
    relations = [D.compare_numbers(k, F.lit("100"), r).alias(r) for r in ("gt", "ge", "le", "eq", "ne")]
    return spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("k"), D.is_age_range(born, F.lit("19700101")).alias("age"), D.matches_all(k, ["^1", "0$"]).alias("pattern"),
        D.matches_all(k, ["^", "("]).alias("broken"), *relations)


@query(f"""WITH {ADT} SELECT msg_id, CASE WHEN no_name THEN NULL ELSE split_part(c_name, '#', 1) END AS family, CASE WHEN ids = 2 THEN 'A' || k END AS second_id, CASE
 WHEN own THEN '*' ELSE '|' END AS separator,
 c_mktsegment || CASE WHEN own THEN ' ? Co*' ELSE ' & Co|' END AS address, CASE WHEN no_name THEN 'null' ELSE 'value' END AS name, CASE WHEN pv1 = 2 THEN 'value'
 ELSE 'missing' END AS second_pv1 FROM a""")
def sql_paths(spark, d):
    """The SQL functions, with paths as values."""
    from .. import api

    api.register(spark)
    derived.adt(spark, d).createOrReplaceTempView("hatlake_adt")
    return spark.sql(
        "SELECT msg_id, hl7_get(raw, 'PID.5.1') AS family, hl7_get(raw, 'PID-3[2].1') AS second_id, hl7_get(raw, 'MSH.1') AS separator, hl7_get(raw, 'PID.11') AS address, "
        "hl7_presence(raw, 'PID.5') AS name, hl7_presence(raw, 'PV1[2].1') AS second_pv1 FROM hatlake_adt")


@query(f"WITH {ADT}, {FEED} SELECT (SELECT count(*) FROM a) AS messages, (SELECT count(DISTINCT 'ADT^' || code) FROM f) AS types")
def corpus_summary(spark, d):
    """The summary of two sources: good messages of one, message types of the other."""
    found = corpus.summary(parse(derived.adt(spark, d)))["totals"].select(F.col("message_count").alias("messages"))
    types = corpus.message_type_counts(_feed(spark, d)).agg(F.count("*").alias("types"))
    return found.crossJoin(types)  # one row each


# --- profiles ----------------------------------------------------------------------------------------------------------

#: Faulty profiles, and the codes that lint gives for each.
FAULTY = (
    ("message_structure: [", "yaml_parse_error"),
    ("[]", "profile_load_error"),
    ("message_structure: ' '\nversion: ''", "empty_message_structure empty_version"),
    ("message_structure: T\nversion: '1'\nextra: 1\nsegments: [{id: ''}, {id: PID}, {id: PID, colour: red}]\nexpression_guardrails: {allow_custom_scripts: true, other: 1}",
     "unknown_top_level_key empty_segment_id duplicate_segment_id unknown_segment_key unknown_expression_guardrail_key"),
    ("message_structure: T\nversion: '1'\nconstraints: [{path: PID, colour: red}, {path: PID.1, components: {min: 3, max: 2}}, {path: PID.2, pattern: '(', when: {eq: [PID.8]}}]\nlengths: [{path: PID.1, max: 1, policy: odd}]",
     "invalid_hl7_path unknown_constraint_key component_min_exceeds_max invalid_constraint_pattern invalid_condition_eq unknown_length_policy"),
    ("message_structure: T\nversion: '1'\nvaluesets: [{path: PID.1, name: ''}, {path: PID.2, name: A, codes: [x]}, {path: PID.3, name: A, codes: [x]}]\ndatatypes: [{path: PID.1, type: ''}]",
     "empty_valueset_name duplicate_valueset_name empty_valueset_without_table empty_datatype"),
    ("message_structure: T\nversion: '1'\nadvanced_datatypes: [{path: PID.1, type: ''}, {path: PID.2, type: NM, min_length: 3, max_length: 2}, {path: PID.3, type: NM, pattern: '('}, {path: PID.4, type: NM, checksum: crc}]",
     "empty_advanced_datatype datatype_min_length_exceeds_max invalid_datatype_pattern unknown_checksum_algorithm"),
    ("message_structure: T\nversion: '1'\ncross_field_rules: [{id: '', validation_mode: odd}, {id: a, conditions: [{field: PID.1, operator: near}, {field: PID.1, operator: matches_regex}, "
     "{field: PID.1, operator: matches_regex, value: '('}, {field: PID.1, operator: within_range, values: [1]}], actions: [{field: PID.1, action: fly}, {field: PID.1, action: validate, valueset: NONE}]}, {id: a}]",
     "empty_rule_id duplicate_rule_id unknown_cross_field_validation_mode unknown_rule_condition_operator missing_rule_condition_regex invalid_rule_condition_regex invalid_within_range_values"
     " unknown_rule_action unknown_action_valueset"),
    ("message_structure: T\nversion: '1'\ntemporal_rules: [{id: t, before: PID.7, after: EVN.2, tolerance: soon}]\ncontextual_rules: [{id: a, context_field: PID.1, context_value: x, target_field: PID.2, validation_type: odd}, "
     "{id: b, context_field: PID.1, context_value: x, target_field: PID.2, validation_type: validate_datatype}, {id: c, context_field: PID.1, context_value: x, target_field: PID.2, validation_type: validate_valueset}, "
     "{id: d, context_field: PID.1, context_value: x, target_field: PID.2, validation_type: validate_valueset, parameters: {valueset: NONE}}]",
     "invalid_temporal_tolerance unknown_contextual_validation_type missing_contextual_datatype_parameter missing_contextual_valueset_parameter unknown_contextual_valueset"),
    ("message_structure: T\nversion: '1'\nhl7_tables: [{id: '', name: a, version: '1', codes: []}, {id: T1, name: '', version: '', codes: []}, {id: T1, name: a, version: '1', codes: []}]\n"
     "table_precedence: [T9]\ncustom_rules: [{id: c, description: d, script: ''}]",
     "empty_table_id duplicate_table_id empty_table_name empty_table_version unknown_table_precedence_entry empty_custom_rule_script custom_rules_without_script_guardrail"),
)


@query("SELECT * FROM (VALUES " + ", ".join(f"({i}, '{code}')" for i, (_, codes) in enumerate(FAULTY) for code in codes.split()) + ") t(profile, code)")
def profile_lint_codes(spark, d):
    """Every code of the linter, each from a profile that has the fault."""
    rows = {(i, issue["code"]) for i, (text, _) in enumerate(FAULTY) for issue in profile.lint(text)}
    return spark.createDataFrame(sorted(rows), "profile int, code string")
