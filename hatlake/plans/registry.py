"""The queries that ``__spark_entry__`` registers, with their oracle SQL.

Oracles work out the expected answer from the tables that the messages were derived from; they never read
HL7. Every query runs over its whole corpus.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import datatypes as D
from ..functions import temporal as T
from ..functions.text import escape, needs_escaping, sha256, unescape
from ..operators import batch, corpus, evidence, generate, lifecycle, redact, validate, write
from ..operators.parse import atoms, charsets, corpus_type, fields, parse, parsed, segments
from ..sources import derived, mllp
from ..streaming import events as stream
from . import profile
from .paths import Message, parse_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
TODAY = "20250101"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def _adt(spark: SparkSession, d: str) -> DataFrame:
    return parsed(derived.adt(spark, d))


def _oru(spark: SparkSession, d: str) -> DataFrame:
    return parsed(derived.oru(spark, d))


def _feed(spark: SparkSession, d: str) -> DataFrame:
    return parsed(derived.feed(spark, d))


def _get(path: str):
    return Message().get(parse_path(path))


# --- what the oracles know of the derived corpora -----------------------------------------------------------

ADT = """a AS (SELECT c_custkey AS k, c_custkey::VARCHAR AS msg_id, c_name, c_nationkey, c_mktsegment, c_custkey % 19 = 0 AS own,
 CASE WHEN c_custkey % 7 = 0 THEN 0 WHEN c_custkey % 5 = 0 THEN 2 ELSE 1 END AS ids,
 CASE WHEN c_custkey % 29 = 0 THEN 0 WHEN c_custkey % 23 = 0 THEN 2 ELSE 1 END AS pv1,
 CASE WHEN c_custkey % 13 = 0 THEN '19991332' ELSE (1940 + c_custkey % 60)::VARCHAR || lpad((1 + c_custkey % 12)::VARCHAR, 2, '0') || lpad((1 + c_custkey % 28)::VARCHAR, 2, '0') END AS born,
 CASE WHEN c_custkey % 11 = 0 THEN 'X' WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS sex,
 '555' || lpad((c_custkey % 10000000)::VARCHAR, 7, '0') AS phone, c_custkey % 17 = 0 AS no_name FROM customer)"""
ORU = """i AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag) AS n, l_partkey, l_quantity::BIGINT AS qty, l_returnflag FROM lineitem),
o AS (SELECT o_orderkey, o_custkey, o_orderdate, o_orderpriority, c_name, c_nationkey, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS items FROM orders
 JOIN customer ON o_custkey = c_custkey WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem))"""
#: The raw ORU messages as strings.
ORU_RAW = ORU + """, x AS (SELECT l_orderkey, string_agg('OBX|' || n || '|NM|' || l_partkey || '^PART' || l_partkey || '||' || qty || '|EA||' || l_returnflag || '|||F', chr(13) ORDER BY n) AS obx FROM i GROUP BY 1),
m AS (SELECT o_orderkey, concat_ws(chr(13), 'MSH|^~\\&|LAB|FAC' || c_nationkey || '|EHR|HOSP|' || strftime(o_orderdate, '%Y%m%d%H%M%S') || '||ORU^R01^ORU_R01|' || o_orderkey || '|P|2.5.1',
 'PID|1||' || o_custkey || '^^^HOSP^MR||' || replace(c_name, '#', '^'), 'OBR|1|' || o_orderkey || '||' || o_orderpriority, obx) AS raw FROM o JOIN x ON o_orderkey = l_orderkey)"""
FEED = "f AS (SELECT event_id, ts, user_id, event_type, props, CASE event_type WHEN 'click' THEN 'A01' WHEN 'view' THEN 'A03' WHEN 'signup' THEN 'A04' WHEN 'purchase' THEN 'A08' ELSE 'A31' END AS code FROM events)"

#: path, messages that have it, occurrences in a message, and shapes (counts for a message), in terms of ``a``.
ADT_FIELDS = [
    *[(f"MSH.{n}", "true", "1", {shape: "1"}) for n, shape in ((2, "text"), (3, "text"), (4, "text"), (5, "text"), (6, "text"), (7, "timestamp"), (9, "coded"), (10, "text"), (11, "text"), (12, "text"))],
    ("EVN.1", "true", "1", {"text": "1"}), ("EVN.2", "true", "1", {"timestamp": "1"}),
    ("PID.1", "true", "1", {"numeric": "1"}), ("PID.3", "ids > 0", "1", {"coded": "ids"}), ("PID.5", "true", "1", {"null": "no_name::INT", "coded": "1 - no_name::INT"}),
    ("PID.7", "true", "1", {"timestamp": "1"}), ("PID.8", "true", "1", {"text": "1"}), ("PID.11", "true", "1", {"text": "1"}), ("PID.13", "true", "1", {"numeric": "1"}),
    *[(f"PV1.{n}", "pv1 > 0", "pv1", {shape: "pv1"}) for n, shape in ((1, "numeric"), (2, "text"), (3, "coded"))],
    *[(f"NK1.{n}", "k % 3 = 0", "1", {shape: "1"}) for n, shape in ((1, "numeric"), (2, "coded"), (3, "text"))],
]
ORU_FIELDS = [
    *[(f"MSH.{n}", "1", shape) for n, shape in ((2, "text"), (3, "text"), (4, "text"), (5, "text"), (6, "text"), (7, "timestamp"), (9, "coded"), (10, "numeric"), (11, "text"), (12, "text"))],
    ("PID.1", "1", "numeric"), ("PID.3", "1", "coded"), ("PID.5", "1", "coded"), ("OBR.1", "1", "numeric"), ("OBR.2", "1", "numeric"), ("OBR.4", "1", "text"),
    *[(f"OBX.{n}", "items", shape) for n, shape in ((1, "numeric"), (2, "text"), (3, "coded"), (5, "numeric"), (6, "text"), (8, "text"), (11, "text"))],
]
CARD = "CASE WHEN count(*) FILTER ({have}) < count(*) THEN 0 ELSE min({n}) FILTER ({have}) END::BIGINT AS min_per_message, max({n}) FILTER ({have})::BIGINT AS max_per_message, sum({n}) FILTER ({have})::BIGINT AS total_occurrences, count(*) FILTER ({have}) AS message_count"


def _union(parts: list[str], cte: str) -> str:
    return f"WITH {cte} " + " UNION ALL ".join(parts)


def _shape_sums(shapes: dict[str, str], have: str) -> str:
    return ", ".join(f"coalesce(sum({shapes.get(s, '0')}) FILTER ({have}), 0)::BIGINT AS {s}_count" for s in corpus.SHAPES)


# --- G: corpora ---------------------------------------------------------------------------------------------

@query(f"WITH {ORU} SELECT v AS value, n AS count FROM (SELECT unnest(['MSH', 'PID', 'OBR']) AS v, count(*) AS n FROM o UNION ALL SELECT 'OBX', sum(items)::BIGINT FROM o)")
def segment_counts(spark, d):
    return corpus.segment_counts(_oru(spark, d))


@query(f"WITH {FEED} SELECT 'ADT^' || code AS value, count(*) AS count FROM f GROUP BY 1")
def message_type_counts(spark, d):
    return corpus.message_type_counts(_feed(spark, d))


@query(_union([f"SELECT '{p}' AS path, count(*) FILTER ({h}) AS message_count, sum({n}) FILTER ({h})::BIGINT AS occurrence_count FROM a" for p, h, n, _ in ADT_FIELDS], ADT))
def field_presence(spark, d):
    return corpus.field_presence(_adt(spark, d))


@query(_union([f"SELECT '{p}' AS path, {CARD.format(have=h, n=n)} FROM a" for p, h, n, _ in ADT_FIELDS], ADT))
def field_cardinality(spark, d):
    return corpus.field_cardinality(_adt(spark, d))


@query(_union([f"SELECT '{p}' AS path, {_shape_sums(s, h)} FROM a" for p, h, _, s in ADT_FIELDS], ADT))
def value_shapes(spark, d):
    return corpus.value_shapes(_adt(spark, d))


@query(_union([f"SELECT '{p}' AS path, {CARD.format(have='true', n=n)}, {_shape_sums({s: n}, 'true')} FROM o" for p, n, s in ORU_FIELDS], ORU))
def corpus_fingerprint(spark, d):
    return corpus.fingerprint(_oru(spark, d))


@query(f"WITH {ORU_RAW} SELECT count(*) AS file_count, count(*) AS message_count, 0::BIGINT AS parse_error_count, sum(strlen(raw))::BIGINT AS total_bytes FROM m")
def corpus_totals(spark, d):
    return corpus.totals(parse(derived.oru(spark, d)))


def _halves(spark, d):
    feed = _feed(spark, d)
    cut = F.lit("2024-01-16").cast("timestamp")
    return feed.filter(F.col("ts") < cut), feed.filter(F.col("ts") >= cut)


_SEGMENTS = "s AS (SELECT ts, event_type, unnest(CASE event_type WHEN 'purchase' THEN ['MSH', 'EVN', 'PID', 'OBX'] WHEN 'error' THEN ['MSH', 'EVN', 'PID', 'ZER'] ELSE ['MSH', 'EVN', 'PID'] END) AS value FROM f)"


@query(f"""WITH {FEED}, {_SEGMENTS}, b AS (SELECT value, count(*) FILTER (ts < TIMESTAMP '2024-01-16') AS before, count(*) FILTER (ts >= TIMESTAMP '2024-01-16') AS after FROM s GROUP BY 1)
SELECT value, before, after, after - before AS delta FROM b WHERE before <> after""")
def corpus_diff_segments(spark, d):
    before, after = _halves(spark, d)
    return corpus.diff(corpus.segment_counts(before), corpus.segment_counts(after), "value", ("count",))


@query(f"""WITH {FEED}, {_SEGMENTS}, p AS (SELECT ts, value || '.' || unnest(CASE value WHEN 'MSH' THEN [2, 3, 4, 5, 6, 7, 9, 10, 11, 12] WHEN 'EVN' THEN [1, 2]
 WHEN 'PID' THEN [1, 3] WHEN 'OBX' THEN [1, 2, 3, 5] ELSE [1, 2] END)::VARCHAR AS path FROM s),
b AS (SELECT path, count(*) FILTER (ts < TIMESTAMP '2024-01-16') AS x, count(*) FILTER (ts >= TIMESTAMP '2024-01-16') AS y FROM p GROUP BY 1)
SELECT path, x AS message_count_before, y AS message_count_after, y - x AS message_count_delta, x AS occurrence_count_before, y AS occurrence_count_after, y - x AS occurrence_count_delta FROM b WHERE x <> y""")
def corpus_diff_fields(spark, d):
    before, after = _halves(spark, d)
    return corpus.diff(corpus.field_presence(before), corpus.field_presence(after), "path", ("message_count", "occurrence_count"))


@query("SELECT * FROM (VALUES ('OBX', 'new'), ('ZER', 'removed')) t(value, kind)")
def corpus_new_removed(spark, d):
    feed = _feed(spark, d)
    before, after = feed.filter("event_type <> 'purchase'"), feed.filter("event_type <> 'error'")
    return corpus.new_and_removed(corpus.diff(corpus.segment_counts(before), corpus.segment_counts(after), "value", ("count",)))


@query(f"WITH {ADT} SELECT 'C' || k AS control_id, k::VARCHAR || '/' || pv1 AS digest FROM a")
def corpus_segments_of(spark, d):
    """The nested form: control id and the number of PV1 segments of each message."""
    m = Message()
    return _adt(spark, d).select(_get("MSH.10").alias("control_id"), F.concat_ws("/", "msg_id", m.segment_count("PV1").cast("string")).alias("digest"))


@query(f"WITH {ORU}, r AS (SELECT 1 AS train, 1 AS x) SELECT s AS split, n AS count FROM (SELECT count(*) AS t, floor(count(*) * 0.8 + 0.5)::BIGINT AS a, floor(count(*) * 0.1 + 0.5)::BIGINT AS b FROM o) q, LATERAL (SELECT unnest(['train', 'validation', 'test']) AS s, unnest([a, least(b, t - a), t - a - least(b, t - a)]) AS n)")
def split_counts(spark, d):
    rows = corpus.splits(corpus.manifest(_oru(spark, d)), (0.8, 0.1, 0.1), seed=7)
    return rows.groupBy("split").agg(F.count("*").alias("count"))


_ESCAPED = "replace(replace(replace(replace(replace(props, chr(92), chr(92) || 'E' || chr(92)), '|', chr(92) || 'F' || chr(92)), '^', chr(92) || 'S' || chr(92)), '~', chr(92) || 'R' || chr(92)), '&', chr(92) || 'T' || chr(92))"
#: Path, value and events of the first five fields of the feed's segments.
_FIRST = [
    ("MSH.3", "'FEED'", "true"), ("MSH.4", "'WEB'", "true"), ("MSH.5", "'EHR'", "true"), ("EVN.1", "code", "true"), ("EVN.2", "strftime(ts, '%Y%m%d%H%M%S')", "true"),
    ("PID.1", "'1'", "true"), ("PID.3", "user_id || '^^^WEB^PI'", "true"),
    ("OBX.1", "'1'", "event_type = 'purchase'"), ("OBX.2", "'ST'", "event_type = 'purchase'"), ("OBX.3", "'PROPS'", "event_type = 'purchase'"), ("OBX.5", _ESCAPED, "event_type = 'purchase'"),
    ("ZER.1", "'1'", "event_type = 'error'"), ("ZER.2", "user_id::VARCHAR", "event_type = 'error'"),
]


@query(f"""WITH {FEED}, v AS ({" UNION ALL ".join(f"SELECT '{path}' AS path, {value} AS value, event_id AS o FROM f WHERE {where}" for path, value, where in _FIRST)}),
s AS (SELECT path, value, min(o) AS o FROM v WHERE value <> '' GROUP BY 1, 2) SELECT path, rank, value
 FROM (SELECT path, value, row_number() OVER (PARTITION BY path ORDER BY o, value) AS rank FROM s) WHERE rank <= 10""")
def stats_topk(spark, d):
    return corpus.samples(_feed(spark, d))


@query(f"WITH {ORU_RAW} SELECT 'message_' || o_orderkey || '.hl7' AS path, 'ORU^R01^ORU_R01' AS message_type, sha256(raw) AS sha256, strlen(raw)::INT AS bytes FROM m")
def corpus_manifest(spark, d):
    return corpus.manifest(_oru(spark, d))


# --- A, B: parsing and paths --------------------------------------------------------------------------------

@query("SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{c}')" for n, _, c in derived.MALFORMED if c) + ") t(msg_id, code)")
def parse_failures(spark, d):
    return corpus.parse_failures(parse(derived.malformed(spark))).select("msg_id", "code")


@query(f"WITH {ADT} SELECT msg_id, CASE WHEN no_name THEN NULL ELSE split_part(c_name, '#', 1) END AS family, CASE WHEN ids = 2 THEN 'A' || k END AS second_id, 'C' || k AS control_id, CASE WHEN own THEN '*' ELSE '|' END AS separator FROM a")
def path_get(spark, d):
    return _adt(spark, d).select("msg_id", _get("PID.5.1").alias("family"), _get("PID-3[2].1").alias("second_id"), _get("MSH-10").alias("control_id"), _get("MSH.1").alias("separator"))


@query(f"""WITH {ADT}, p AS (SELECT CASE WHEN ids = 0 THEN 'empty' ELSE 'value' END AS id, CASE WHEN no_name THEN 'null' ELSE 'value' END AS name, CASE WHEN ids = 2 THEN 'value'
 ELSE 'missing' END AS second, 'empty' AS alias, 'missing' AS zzz FROM a)
SELECT id, name, second, alias, zzz, count(*) AS n FROM p GROUP BY ALL""")
def path_presence(spark, d):
    m = Message()
    named = {"id": "PID.3", "name": "PID.5", "second": "PID.3[2]", "alias": "PID.4", "zzz": "ZZZ.1"}
    return _adt(spark, d).groupBy(*[m.presence(parse_path(p)).alias(n) for n, p in named.items()]).agg(F.count("*").alias("n"))


@query(f"WITH {ORU} SELECT l_orderkey::VARCHAR AS msg_id, 'PART' || l_partkey AS code, qty::VARCHAR AS value FROM i JOIN o ON l_orderkey = o_orderkey WHERE n = 2")
def nth_segment(spark, d):
    return _oru(spark, d).select("msg_id", _get("OBX[2]-3.2").alias("code"), _get("OBX[2]-5").alias("value")).filter("code IS NOT NULL")


@query(f"WITH {ORU} SELECT l_orderkey::VARCHAR AS msg_id, count(*) AS n, sum(qty)::BIGINT AS total, max(n)::BIGINT AS last_rep FROM i JOIN o ON l_orderkey = o_orderkey GROUP BY 1")
def atoms_long(spark, d):
    """The long form, pruned to OBX before it is exploded."""
    rows = atoms(_oru(spark, d), only=("OBX",)).filter("field_no = 5")
    return rows.groupBy("msg_id").agg(F.count("*").alias("n"), F.sum(F.col("text").cast("bigint")).alias("total"), F.max("seg_rep").cast("long").alias("last_rep"))


@query(f"WITH {ADT} SELECT CASE WHEN own THEN '*%$!?' ELSE '|^~\\&' END AS delims, count(*) AS n, sum(pv1)::BIGINT AS pv1, count(*) FILTER (ids = 2) AS second_ids FROM a GROUP BY 1")
def custom_delims_equivalence(spark, d):
    m = Message()
    second = m.get(parse_path("PID.3[2].5")) == "PI"
    return _adt(spark, d).groupBy("delims").agg(F.count("*").alias("n"), F.sum(m.segment_count("PV1").cast("long")).alias("pv1"), F.count_if(F.coalesce(second, F.lit(False))).alias("second_ids"))


@query("SELECT doc_id::VARCHAR AS msg_id, 'UNICODE UTF-8' AS charset FROM documents")
def charset_list(spark, d):
    return parsed(derived.notes(spark, d)).select("msg_id", F.array_join(charsets(), ",").alias("charset"))


@query(f"WITH {ADT} SELECT msg_id, 'ADT^A01' AS type, '2.5.1' AS version, 'FAC' || c_nationkey AS facility, 3 + pv1 + (k % 3 = 0)::INT AS segments FROM a")
def metadata_projection(spark, d):
    return _adt(spark, d).select("msg_id", F.concat_ws("^", _get("MSH.9.1"), _get("MSH.9.2")).alias("type"), F.coalesce(_get("MSH.12"), F.lit("2.5")).alias("version"), _get("MSH.4").alias("facility"),
        F.size("lines").alias("segments"))


# --- C: text ------------------------------------------------------------------------------------------------

_PLAIN = "regexp_replace(coalesce(text, ''), '\\r\\n|\\r', chr(10), 'g')"


@query(f"SELECT doc_id::VARCHAR AS msg_id, sha256({_PLAIN}) AS text_sha256 FROM documents")
def escape_roundtrip(spark, d):
    return parsed(derived.notes(spark, d)).select("msg_id", sha256(_get("OBX.5")).alias("text_sha256"))


@query(f"SELECT doc_id::VARCHAR AS msg_id, length({_PLAIN})::BIGINT AS chars, strlen({_PLAIN})::BIGINT AS bytes FROM documents")
def unescape_lengths(spark, d):
    value = unescape(F.col("raw_field"), F.col("delims"))
    rows = fields(parsed(derived.notes(spark, d)), only=("OBX",)).filter("field_no = 5").withColumnRenamed("raw", "raw_field")
    return rows.select("msg_id", F.length(value).cast("long").alias("chars"), F.octet_length(value).cast("long").alias("bytes"))


@query("SELECT regexp_matches(coalesce(text, ''), '[|^~\\\\&\\r\\n]') AS needs, count(*) AS n FROM documents GROUP BY 1")
def escape_needed(spark, d):
    return derived.notes(spark, d).groupBy(needs_escaping(F.coalesce("text", F.lit(""))).alias("needs")).agg(F.count("*").alias("n"))


@query("SELECT customer.c_custkey AS k, replace(replace(c_name, '#', '|'), '0', '&') AS plain, length(c_name) + 2 * (length(c_name) - length(replace(replace(c_name, '#', ''), '0', ''))) AS escaped_length FROM customer")
def escape_delims(spark, d):
    text = F.replace(F.replace(F.col("c_name"), F.lit("#"), F.lit("|")), F.lit("0"), F.lit("&"))
    rows = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("k"), escape(text).alias("e"))
    return rows.select("k", unescape(F.col("e")).alias("plain"), F.length("e").cast("long").alias("escaped_length"))


# --- D: scalar validators -----------------------------------------------------------------------------------

@query("""WITH n AS (SELECT l_orderkey * 100 + l_linenumber AS n FROM lineitem), u AS (SELECT n, list_reduce(list_transform(range(1, length(n::VARCHAR) + 1), lambda i: CASE
 WHEN i % 2 = 1 THEN reverse(n::VARCHAR)[i]::INT
 WHEN reverse(n::VARCHAR)[i]::INT >= 5 THEN reverse(n::VARCHAR)[i]::INT * 2 - 9 ELSE reverse(n::VARCHAR)[i]::INT * 2 END), lambda a, b: a + b) AS s FROM n)
 SELECT s % 10 = 0 AS valid, count(*) AS n FROM u GROUP BY 1""")
def luhn(spark, d):
    number = (F.col("l_orderkey") * 100 + F.col("l_linenumber")).cast("string")
    return spark.read.parquet(f"{d}/lineitem.parquet").groupBy(D.luhn(number).alias("valid")).agg(F.count("*").alias("n"))


_CONTACT = "c AS (SELECT c_custkey AS k, lpad((c_custkey * 7919 % 1000000000)::VARCHAR, 9, '0') AS s, CASE WHEN c_custkey % 4 = 0 THEN 'a@b.c' WHEN c_custkey % 4 = 1 THEN 'a@b' WHEN c_custkey % 4 = 2 THEN '@b.c' ELSE 'a@b@c.d' END AS e, CASE WHEN c_custkey % 3 = 0 THEN '(555) 0100' ELSE '+1 555 010 0100' END AS p FROM customer)"


@query(f"""WITH {_CONTACT} SELECT k, k % 4 = 0 AS email, true AS phone, s[1:3] <> '000' AND s[1:3] <> '666' AND s[1] <> '9' AND s[4:5] <> '00' AND s[6:9] <> '0000' AS ssn FROM c""")
def email_phone_ssn(spark, d):
    k = F.col("c_custkey")
    email = F.when(k % 4 == 0, "a@b.c").when(k % 4 == 1, "a@b").when(k % 4 == 2, "@b.c").otherwise("a@b@c.d")
    phone = F.when(k % 3 == 0, "(555) 0100").otherwise("+1 555 010 0100")
    ssn = F.lpad((k * 7919 % 1000000000).cast("string"), 9, "0")
    return spark.read.parquet(f"{d}/customer.parquet").select(k.alias("k"), D.is_email(email).alias("email"), D.is_phone_number(phone).alias("phone"), D.is_ssn(ssn).alias("ssn"))


#: value, and whether it is a DT, TM, TS, NM, SI, ID and PN. Plain facts of the standard's formats.
TYPED = (
    ("20240229", 1, 1, 1, 1, 1, 1, 0), ("20230229", 0, 1, 0, 1, 1, 1, 0), ("202402291230", 0, 1, 1, 1, 0, 1, 0), ("1230", 0, 1, 0, 1, 1, 1, 0), ("123045.5", 0, 1, 0, 1, 0, 1, 0), ("2460", 0, 0, 0, 1, 1, 1, 0),
    ("-1.5e3", 0, 0, 0, 1, 0, 1, 0), (" 1", 0, 0, 0, 0, 0, 1, 0), ("1d", 0, 0, 0, 0, 0, 1, 0), ("inf", 0, 0, 0, 0, 0, 1, 1), ("0", 0, 0, 0, 1, 0, 1, 0), ("4294967296", 0, 0, 0, 1, 0, 1, 0),
        ("O''Neil-Ax", 0, 0, 0, 0, 0, 1, 1), ("", 0, 0, 0, 0, 0, 1, 1), ("12305", 0, 1, 0, 1, 1, 1, 0),
)
_KINDS = ("DT", "TM", "TS", "NM", "SI", "ID", "PN")


@query("SELECT v AS value, " + ", ".join(f"{k.lower()}::BOOLEAN AS {k.lower()}" for k in _KINDS) + " FROM (VALUES " + ", ".join("(" + ", ".join([f"'{r[0]}'",
    *map(str, r[1:])]) + ")" for r in TYPED) + ") t(v, " + ", ".join(k.lower() for k in _KINDS) + ")")
def datatype_matrix(spark, d):
    rows = spark.createDataFrame([(r[0].replace("''", "'"),) for r in TYPED], "value string")
    return rows.select("value", *[F.coalesce(D.valid(F.col("value"), k), F.lit(False)).alias(k.lower()) for k in _KINDS])


_PREC = "CASE event_id % 4 WHEN 0 THEN 'month' WHEN 1 THEN 'day' WHEN 2 THEN 'minute' ELSE 'second' END"


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN date_trunc('month', ts) WHEN 1 THEN date_trunc('day', ts) WHEN 2 THEN date_trunc('minute', ts) ELSE date_trunc('second', ts) END
 < CASE event_id % 4 WHEN 0 THEN TIMESTAMP '2024-01-01' WHEN 1 THEN TIMESTAMP '2024-01-16' WHEN 2 THEN TIMESTAMP '2024-01-16 12:30:00'
 ELSE TIMESTAMP '2024-01-16 12:30:15' END AS before FROM events""")
def ts_precision_before(spark, d):
    pattern = F.when(F.col("event_id") % 4 == 0, F.date_format("ts", "yyyyMM")).when(F.col("event_id") % 4 == 1, F.date_format("ts", "yyyyMMdd")).when(F.col("event_id") % 4 == 2,
        F.date_format("ts", "yyyyMMddHHmm")).otherwise(F.date_format("ts", "yyyyMMddHHmmss"))
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", T.is_before(pattern, F.lit("20240116123015")).alias("before"))


# --- E: rules -----------------------------------------------------------------------------------------------

def _issues(messages: DataFrame, text: str) -> DataFrame:
    return validate.issues(validate.validate(messages, profile.loads("message_structure: T\nversion: '2.5.1'\n" + text), TODAY)).select("msg_id", "code", "path", "value")


def _found(code: str, path: str, value: str, where: str) -> str:
    return f"SELECT msg_id, '{code}' AS code, '{path}' AS path, {value} AS value FROM a WHERE {where}"


@query(f"WITH {ADT} " + _found("MISSING_REQUIRED_FIELD", "PID.3", "NULL::VARCHAR", "ids = 0") + " UNION ALL " + _found("MISSING_REQUIRED_FIELD", "PID.5", "NULL", "no_name"))
def required_field(spark, d):
    return _issues(_adt(spark, d), "constraints: [{path: PID.3, required: true}, {path: PID.5, required: true}, {path: MSH.1, required: true}]")


@query(f"WITH {ADT} " + _found("VALUE_NOT_IN_CONSTRAINT", "PID.8", "sex", "sex = 'X'"))
def in_constraint(spark, d):
    return _issues(_adt(spark, d), "constraints: [{path: PID.8, in: [M, F]}]")


@query(f"WITH {ADT} " + _found("PATTERN_MISMATCH", "PID.13", "phone", "phone NOT LIKE '%5'"))
def pattern_constraint(spark, d):
    return _issues(_adt(spark, d), "constraints: [{path: PID.13, pattern: '^[0-9]+5$'}, {path: PID.13, pattern: '('}]")


@query(f"WITH {ADT} " + _found("TOO_FEW_COMPONENTS", "PID.5", "'1'", "no_name") + " UNION ALL " + _found("TOO_MANY_COMPONENTS", "PID.3", "'5'", "ids > 0"))
def component_bounds(spark, d):
    return _issues(_adt(spark, d), "constraints: [{path: PID.5, components: {min: 2}}, {path: PID.3, components: {max: 4}}]")


@query(f"WITH {ADT} " + _found("VALUE_NOT_IN_SET", "PID.8", "sex", "sex = 'X'") + " UNION ALL " + _found("VALUE_NOT_IN_SET", "PV1.2", "'I'", "pv1 > 0 AND k % 4 = 0"))
def valueset_inline(spark, d):
    return _issues(_adt(spark, d), "valuesets: [{path: PID.8, name: SEX, codes: [M, F, U]}, {path: PV1.2, name: CLS, codes: [O]}]")


@query(f"WITH {ADT} " + _found("VALUE_NOT_IN_HL7_TABLE", "PID.8", "sex", "sex IN ('X', 'F')"))
def hl7_table_anti(spark, d):
    return _issues(_adt(spark, d), "valuesets: [{path: PID.8, name: HL70001}]\nhl7_tables: [{id: HL70001, name: Sex, version: '2.5', codes: [{value: M, description: m}, {value: F, description: f, status: D}]}]")


@query(f"WITH {ADT} " + _found("INVALID_DATA_TYPE", "PID.7", "born", "born = '19991332'") + " UNION ALL " 
 + _found("VALUE_TOO_LONG", "PID.3.1", "CASE WHEN length(k::VARCHAR) > 3 THEN k::VARCHAR ELSE 'A' || k END", "ids > 0 AND length(k::VARCHAR) > 3 OR ids = 2 AND length(k::VARCHAR) = 3"))
def length_bytes(spark, d):
    return _issues(_adt(spark, d), "lengths: [{path: PID.3.1, max: 3}]\ndatatypes: [{path: PID.7, type: DT}, {path: PID.1, type: SI}]")


@query(f"WITH {ADT} " + _found("CHECKSUM_MISMATCH", "PID.13", "phone",
    "list_sum(list_transform(range(1, 11), lambda i: CASE WHEN i % 2 = 1 THEN reverse(phone)[i]::INT WHEN reverse(phone)[i]::INT >= 5 THEN reverse(phone)[i]::INT * 2 - 9 ELSE reverse(phone)[i]::INT * 2 END)) % 10 <> 0") + " UNION ALL " + _found("VALUE_TOO_SHORT", "PID.8", "sex", "true"))
def advanced_datatypes(spark, d):
    return _issues(_adt(spark, d), "advanced_datatypes: [{path: PID.13, type: NM, min_length: 10, max_length: 10, checksum: luhn}, {path: PID.8, type: ID, min_length: 2}]")


@query(f"WITH {ADT} " + _found("MISSING_REQUIRED_FIELD", "NK1.2", "NULL::VARCHAR", "sex = 'F' AND k % 3 <> 0"))
def conditional_when(spark, d):
    return _issues(_adt(spark, d), "constraints: [{path: NK1.2, required: true, when: {any: [{eq: [PID.8, F]}, {eq: [PID.8, Q]}]}}]")


@query(f"WITH {ADT} SELECT msg_id, 'CROSS_FIELD_ASSERTION_FAILED' AS code, NULL::VARCHAR AS path, NULL::VARCHAR AS value FROM a WHERE NOT (sex IN ('M', 'F') AND born < '1990' AND born <> '19991332')")
def cross_field_assert(spark, d):
    return _issues(_adt(spark, d), "cross_field_rules: [{id: r, description: d, validation_mode: assert, conditions: [{field: PID.8, operator: in, values: [M, F]}, {field: PID.7, operator: before, value: '1990'}]}]")


@query(f"WITH {ADT} " + _found("CROSS_FIELD_VALIDATION_ERROR", "NK1.1", "NULL::VARCHAR", "born < '1960' AND born <> '19991332' AND k % 3 <> 0") + " UNION ALL " + _found("CROSS_FIELD_VALIDATION_ERROR",
    "PV1.2", "CASE WHEN k % 4 = 0 THEN 'I' ELSE 'O' END", "born < '1960' AND born <> '19991332' AND pv1 > 0"))
def cross_field_require(spark, d):
    return _issues(_adt(spark, d), "cross_field_rules: [{id: r, description: d, conditions: [{field: PID.7, operator: lt, value: '19600000'}], actions: [{field: NK1.1, action: require}, {field: PV1.2, action: prohibit}]}]")


@query(f"WITH {ADT} " + _found("INVALID_DATETIME", "PID.7", "born", "born = '19991332'") + " UNION ALL " + _found("TEMPORAL_RULE_VIOLATION", "EVN.2", "'20240101120000'", "born <> '19991332'")
 + " UNION ALL " + _found("INVALID_DATETIME", "EVN.2", "'20240101120000'", "born = '19991332'"))
def temporal_tolerance(spark, d):
    return _issues(_adt(spark, d), "temporal_rules: [{id: a, description: d, before: PID.7, after: EVN.2, tolerance: 5m}, {id: b, description: d, before: EVN.2, after: PID.7, tolerance: 30d}]")


@query(f"WITH {ADT} " + _found("CONTEXTUAL_VALIDATION_ERROR", "PID.8", "sex", "pv1 > 0 AND k % 4 = 0 AND sex = 'X'") + " UNION ALL " + _found("CONTEXTUAL_VALIDATION_ERROR", "NK1.1", "'1'",
    "pv1 > 0 AND k % 4 = 0 AND k % 3 = 0"))
def contextual_rule(spark, d):
    text = "valuesets: [{path: ZZZ.1, name: SEX, codes: [M, F]}]\ncontextual_rules: [{id: a, description: d, context_field: PV1.2, context_value: I, target_field: PID.8, validation_type: validate_valueset, parameters: {valueset: SEX}}, {id: b, description: d, context_field: PV1.2, context_value: I, target_field: NK1.1, validation_type: prohibit}]"
    return _issues(_adt(spark, d), text)


@query(f"WITH {ADT} " + " UNION ALL ".join([
    _found("CUSTOM_RULE_VIOLATION", "PID.3", "k::VARCHAR", "ids > 0 AND length(k::VARCHAR) <= 2"), _found("CUSTOM_RULE_VIOLATION", "PID.3", "''", "ids = 0"), _found("CUSTOM_RULE_VIOLATION", "PID.8", "sex", "sex <> 'M'"),
    _found("CUSTOM_RULE_VIOLATION", "PID.7", "born", "born = '19991332'"), _found("CUSTOM_RULE_VIOLATION", "PID.13", "phone", "phone::DOUBLE NOT BETWEEN 5550000100 AND 5550000200")]))
def custom_rules(spark, d):
    scripts = ["field(PID.3).length() > 2", "field(PID.8) in ['M']", "field(PID.7).is_valid_birth_date()", "field(PID.13) between 5550000100 and 5550000200", "field(PID.13).is_phone_number()",
        "field(PID.1) == field(PV1.1)"]
    return _issues(_adt(spark, d), "custom_rules: [" + ", ".join(f"{{id: r{i}, description: d, script: \"{s}\"}}" for i, s in enumerate(scripts)) + "]")


@query(f"WITH {ADT} " + _found("MISSING_REQUIRED_SEGMENT", "PV1", "NULL::VARCHAR", "pv1 = 0") + " UNION ALL " + _found("SEGMENT_REPETITION_NOT_ALLOWED", "PV1[2]", "NULL", "pv1 = 2"))
def segment_spec_violations(spark, d):
    return _issues(_adt(spark, d), "segments: [{id: MSH, required: true}, {id: PV1, required: true}, {id: PID}]")


PROFILE = """message_structure: ADT_A01
version: '2.5.1'
segments: [{id: PV1, required: true}]
constraints: [{path: PID.3, required: true}]
valuesets: [{path: PID.8, name: SEX, codes: [M, F]}]
datatypes: [{path: PID.7, type: DT}]
"""
_COUNT = "(ids = 0)::INT + (sex = 'X')::INT + (born = '19991332')::INT + (pv1 <> 1)::INT"


@query(f"""WITH {ADT} SELECT msg_id, {_COUNT} = 0 AS valid, 'ADT^A01' AS message_type, 3 + pv1 + (k % 3 = 0)::INT AS segment_count, {_COUNT} AS issue_count,
 concat_ws(',', CASE pv1 WHEN 0 THEN 'missing_required_segment' WHEN 2 THEN 'segment_repetition_not_allowed' END, CASE WHEN ids = 0 THEN 'missing_required_field' END, CASE
 WHEN sex = 'X' THEN 'value_not_in_set' END,
 CASE WHEN born = '19991332' THEN 'invalid_data_type' END) AS codes FROM a""")
def report_rollup(spark, d):
    found = validate.report(validate.validate(_adt(spark, d), profile.loads(PROFILE), TODAY))
    return found.withColumn("codes", F.array_join("codes", ","))


@query(f"""WITH {ADT} SELECT code, n AS count FROM (SELECT 'missing_required_field' AS code, count(*) FILTER (ids = 0) AS n FROM a UNION ALL
 SELECT 'value_not_in_set', count(*) FILTER (sex = 'X') FROM a UNION ALL SELECT 'invalid_data_type', count(*) FILTER (born = '19991332') FROM a
 UNION ALL SELECT 'missing_required_segment', count(*) FILTER (pv1 = 0) FROM a UNION ALL SELECT 'segment_repetition_not_allowed', count(*) FILTER (pv1 = 2) FROM a) WHERE n > 0""")
def issue_code_counts(spark, d):
    return corpus.issue_code_counts(validate.validate(_adt(spark, d), profile.loads(PROFILE), TODAY))


@query(f"WITH {ADT} SELECT msg_id, 'PID' AS segment, 2 AS segment_index, 8 AS field_index FROM a WHERE sex = 'X'")
def issue_locations(spark, d):
    rows = validate.issues(validate.validate(_adt(spark, d), profile.loads("message_structure: T\nversion: '1'\nconstraints: [{path: PID.8, in: [M, F]}]"), TODAY))
    return rows.select("msg_id", F.substring("path", 1, 3).alias("segment"), "segment_index", "field_index")


@query("SELECT * FROM (VALUES ('custom_rules_without_script_guardrail', 1), ('empty_segment_id', 1), ('invalid_hl7_path', 1), ('unknown_rule_condition_operator', 1), ('unknown_top_level_key', 1)) t(code, n)")
def profile_lint(spark, d):
    text = "message_structure: T\nversion: '1'\nname: x\nsegments: [{id: ''}]\nlengths: [{path: PID, max: 1}]\ncross_field_rules: [{id: r, conditions: [{field: PID.1, operator: near}]}]\ncustom_rules: [{id: c, script: 'field(PID.1).is_ssn()'}]"
    rows = spark.createDataFrame([(i["code"],) for i in profile.lint(text)], "code string")
    return rows.groupBy("code").agg(F.count("*").cast("int").alias("n"))


# --- H: redaction -------------------------------------------------------------------------------------------

POLICY = "\n".join(f'[[rules]]\npath = "{p}"\naction = "{a}"\nreason = "r"\noptional = {o}' for p, a,
    o in (("PID.3", "hash", "true"), ("PID.5", "drop", "true"), ("PID.7", "hash", "true"), ("PID.11", "drop", "true"), ("PID-13", "hash", "true"), ("NK1.2", "drop", "true"), ("PV1.2", "retain", "true")))


@query(f"WITH {ADT} SELECT msg_id, 'hash:sha256:' || sha256(born) AS born, '' AS name, 'hash:sha256:' || sha256(phone) AS phone, sex FROM a")
def redact_hash(spark, d):
    rules, _ = redact.load_policy(POLICY)
    return redact.redact(_adt(spark, d), rules).select("msg_id", _get("PID.7").alias("born"), _get("PID.5").alias("name"), _get("PID.13").alias("phone"), _get("PID.8").alias("sex"))


@query(f"""WITH {ADT}, r AS (SELECT unnest(['PID.3', 'PID.5', 'PID.7', 'PID.11', 'PID.13']) AS path, unnest(['hash', 'drop', 'hash', 'drop', 'hash']) AS action, count(*) AS matched_count FROM a UNION ALL SELECT 'NK1.2', 'drop', count(*) FILTER (k % 3 = 0) FROM a UNION ALL SELECT 'PV1.2', 'retain', sum(pv1)::BIGINT FROM a)
SELECT path, action, matched_count, CASE WHEN action = 'retain' THEN 'retained' ELSE 'applied' END AS status FROM r""")
def redact_receipt(spark, d):
    rules, _ = redact.load_policy(POLICY)
    return redact.receipt(redact.redact(_adt(spark, d), rules), rules).select("path", "action", "matched_count", "status")


@query(f"WITH {ADT} SELECT path, n AS messages FROM (SELECT unnest(['PID.5', 'PID.11', 'PID.13']) AS path, count(*) AS n FROM a UNION ALL SELECT 'NK1.2', count(*) FILTER (k % 3 = 0) FROM a)")
def redact_coverage(spark, d):
    rules = [redact.Rule(parse_path("PID.3"), "hash", "r"), redact.Rule(parse_path("PID.7"), "drop", "r"), redact.Rule(parse_path("PID.5.1"), "drop", "r")]
    return redact.uncovered(_adt(spark, d), rules).groupBy("path").agg(F.count("*").alias("messages"))


#: Every field of a redacted ADT message: path, shape, action, and how many a message has.
_TRACED = [
    *[(f"MSH.{n}", "empty" if n == 8 else "present", None, "1") for n in range(2, 13)], ("EVN.1", "present", None, "1"), ("EVN.2", "present", None, "1"),
    *[(f"PID.{n}", shape, action, "1") for n, shape, action in (
        (1, "present", None), (2, "empty", None), (3, "hashed_sha256", "hash"), (4, "empty", None), (5, "empty", "drop"), (6, "empty", None), (7, "hashed_sha256", "hash"), (8, "present", None),
        (9, "empty", None), (10, "empty", None), (11, "empty", "drop"), (12, "empty", None), (13, "hashed_sha256", "hash"))],
    ("PV1.1", "present", None, "pv1"), ("PV1.2", "present", "retain", "pv1"), ("PV1.3", "present", None, "pv1"),
    ("NK1.1", "present", None, "(k % 3 = 0)::INT"), ("NK1.2", "empty", "drop", "(k % 3 = 0)::INT"), ("NK1.3", "present", None, "(k % 3 = 0)::INT"),
]


def _quoted(text: str | None) -> str:
    return "NULL::VARCHAR" if text is None else f"'{text}'"


@query(_union([f"SELECT '{p}' AS canonical_path, '{s}' AS value_shape, {_quoted(x)} AS redaction_action, sum({n})::BIGINT AS n FROM a" for p, s, x, n in _TRACED], ADT))
def field_trace(spark, d):
    rules, _ = redact.load_policy(POLICY)
    rows = redact.trace(redact.redact(_adt(spark, d), rules), rules)
    return rows.groupBy("canonical_path", "value_shape", "redaction_action").agg(F.count("*").alias("n"))


@query(f"WITH {ADT} SELECT msg_id, '[REDACTED]' AS name, sex FROM a")
def redact_basic(spark, d):
    rules = [redact.Rule(parse_path(p), "drop", "basic", True) for p in redact.BASIC]
    return redact.redact(_adt(spark, d), rules, basic="[REDACTED]").select("msg_id", _get("PID.5").alias("name"), _get("PID.8").alias("sex"))


# --- A34..A38, C8, I1..I4: writing and acknowledging ---------------------------------------------------------

@query(f"WITH {ADT} SELECT msg_id, '|^~\\&' AS delims, CASE WHEN no_name THEN NULL ELSE split_part(c_name, '#', 2) END AS given, CASE WHEN own THEN c_mktsegment || ' ? Co*' ELSE c_mktsegment || ' & Co|' END AS address FROM a")
def normalize_delims(spark, d):
    again = parsed(_adt(spark, d).select("msg_id", write.normalised().alias("raw")))
    return again.select("msg_id", "delims", _get("PID.5.2").alias("given"), _get("PID.11").alias("address"))


@query(f"WITH {ADT} SELECT count(*) AS n, count(*) AS same FROM a")
def write_roundtrip(spark, d):
    rows = _adt(spark, d)
    return rows.agg(F.count("*").alias("n"), F.count_if(F.rtrim(write.wire(), F.lit("\r")) == F.col("raw")).alias("same"))


@query(f"WITH {ADT} SELECT msg_id, CASE WHEN no_name THEN '__NULL__' ELSE split_part(c_name, '#', 1) END AS family, sex, 3 + pv1 + (k % 3 = 0)::INT AS segments FROM a")
def json_fields(spark, d):
    rows = _adt(spark, d).select("msg_id", write.to_json(charsets()).alias("j"))
    return rows.select("msg_id", F.get_json_object("j", "$.segments[2].fields['5'][0][0][0]").alias("family"), F.get_json_object("j", "$.segments[2].fields['8'][0][0][0]").alias("sex"),
        F.json_array_length(F.get_json_object("j", "$.segments")).alias("segments"))


@query(f"WITH {ADT} SELECT msg_id, 'EHR' AS sender, 'FAC' || c_nationkey AS receiver_facility, 'ACK^ADT' AS type, CASE WHEN {_COUNT} = 0 THEN 'AA' ELSE 'AR' END AS code, 'C' || k AS control_id FROM a")
def ack_codes(spark, d):
    checked = validate.validate(_adt(spark, d), profile.loads(PROFILE), TODAY)
    code = F.when(F.size("issues") == 0, "AA").otherwise("AR")
    back = parsed(checked.select("msg_id", write.ack(code, F.lit("2024-01-01 00:00:00").cast("timestamp")).alias("raw")))
    return back.select("msg_id", _get("MSH.3").alias("sender"), _get("MSH.6").alias("receiver_facility"), corpus_type().alias("type"), _get("MSA.1").alias("code"), _get("MSA.2").alias("control_id"))


@query(f"WITH {ADT}, p AS (SELECT {_COUNT} AS n FROM a) SELECT CASE WHEN n = 0 THEN 'accepted' ELSE 'rejected' END AS outcome, CASE WHEN n = 0 THEN 'valid' ELSE 'validation_error' END AS reason, CASE WHEN n = 0 THEN 'CA' ELSE 'CR' END AS ack_code, CASE WHEN n > 0 THEN 'message validation failed with ' || n || ' issue(s)' END AS error_text, count(*) AS n FROM p GROUP BY ALL")
def ack_policy(spark, d):
    checked = validate.validate(_adt(spark, d), profile.loads(PROFILE), TODAY)
    decided = checked.select(write.ack_policy(F.lit(True), F.size("issues"), "enhanced").alias("p")).select("p.*")
    return decided.groupBy("outcome", "reason", "ack_code", "error_text").agg(F.count("*").alias("n"))


# --- A10..A24: framing and batches -----------------------------------------------------------------------------

@query(f"WITH {ADT} SELECT count(*) AS n, count(*) AS same, count(*) AS framed, count(*) AS lengths FROM a")
def mllp_roundtrip(spark, d):
    rows = derived.adt(spark, d).select("raw", mllp.wrap(F.col("raw")).alias("b"))
    return rows.agg(F.count("*").alias("n"), F.count_if(mllp.unwrap(F.col("b")) == F.col("raw").cast("binary")).alias("same"), F.count_if(mllp.is_framed(F.col("b"))).alias("framed"),
        F.count_if(mllp.frame_length(F.col("b")) == F.octet_length("raw") + 3).alias("lengths"))


def _batches(spark, d):
    """A batch for each nation; messages with delimiters of their own are normalised."""
    rows = _adt(spark, d).select("ordinal", write.normalised().alias("raw")).join(spark.read.parquet(f"{d}/customer.parquet"), F.col("ordinal") == F.col("c_custkey"))
    return batch.write_batch(rows, "c_nationkey").withColumnRenamed("c_nationkey", "file_id")


def _file_batches(spark, d):
    batches = _batches(spark, d).select(F.expr("file_id div 5").alias("key"), F.col("file_id").alias("ordinal"), "raw")
    return batch.write_file_batch(batches, "key").withColumnRenamed("key", "file_id")


@query(f"WITH {ADT} SELECT c_nationkey AS file_id, count(*) AS messages, 1::BIGINT AS batches, NULL::VARCHAR AS error FROM a GROUP BY 1")
def batch_counts(spark, d):
    return batch.check(_batches(spark, d)).select("file_id", "messages", "batches", "error")


@query(f"WITH {ADT} SELECT c_nationkey // 5 AS file_id, c_nationkey % 5 + 1 AS batch, count(*) AS n FROM a GROUP BY 1, 2")
def file_batch_counts(spark, d):
    return batch.messages(_file_batches(spark, d)).groupBy("file_id", "batch").agg(F.count("*").alias("n"))


_NO_NAMES = ", ".join(f"NULL::VARCHAR AS {name}" for name in batch.HEADER.values())


@query(f"""WITH {ADT}, e AS (SELECT c_nationkey // 5 AS file_id, c_nationkey % 5 + 1 AS batch, count(*)::INT AS n FROM a GROUP BY 1, 2)
SELECT file_id, batch, unnest(['BHS', 'BTS']) AS id, '|' AS field_separator, unnest(['^~\\&', NULL]) AS encoding_characters, {_NO_NAMES}, unnest([NULL, n]) AS message_count, NULL::VARCHAR AS trailer_comment FROM e
UNION ALL SELECT file_id, NULL, unnest(['FHS', 'FTS']), '|', unnest(['^~\\&', NULL]), {_NO_NAMES}, unnest([NULL, sum(n)::INT]), NULL FROM e GROUP BY 1""")
def batch_envelopes(spark, d):
    return batch.envelopes(_file_batches(spark, d))


#: What is done to a batch file to make it faulty, by its number; its error.
_FAULTS = {0: "CountMismatch", 1: "CountMismatch", 2: "MissingSegment BTS", 3: "InvalidStructure"}


@query(f"WITH {ADT} SELECT c_nationkey // 5 AS file_id, count(*) AS messages, CASE c_nationkey // 5 {' '.join(f'WHEN {n} THEN {_quoted(x)}' for n, x in _FAULTS.items())} END AS error FROM a GROUP BY 1")
def batch_faults(spark, d):
    """A wrong FTS count, a wrong BTS count, a batch without its end, something before the header."""
    spoilt = (
        F.when(F.col("file_id") == 0, F.regexp_replace("raw", r"FTS\|(\d+)", r"FTS|9$1")).when(F.col("file_id") == 1, F.regexp_replace("raw", r"BTS\|(\d+)", r"BTS|9$1"))
        .when(F.col("file_id") == 2, F.regexp_replace("raw", r"BTS\|\d+\r", "")).when(F.col("file_id") == 3, F.concat(F.lit("ZZZ|1\r"), "raw")).otherwise(F.col("raw"))
    )
    return batch.check(_file_batches(spark, d).withColumn("raw", spoilt)).select("file_id", "messages", "error")


@query("SELECT * FROM (VALUES ('count', 'CountMismatch'), ('empty', 'InvalidStructure'), ('good', NULL), ('no_bhs', 'MissingSegment BHS'), ('no_bts', 'MissingSegment BTS'), ('other', 'InvalidStructure'), ('plain', NULL)) t(file_id, error)")
def batch_errors(spark, d):
    m = "MSH|^~\\&|A\rPID|1\r"
    rows = [("good", f"BHS|^~\\&\r{m}BTS|1\r"), ("count", f"BHS|^~\\&\r{m}BTS|2\r"), ("no_bts", f"BHS|^~\\&\r{m}"), ("no_bhs", f"{m}BTS|1\r"), ("plain", m), ("other", "PID|1\r"), ("empty", "")]
    return batch.check(spark.createDataFrame(rows, "file_id string, raw string")).select("file_id", "error")


# --- I, J: guard, lifecycle, generator, streams ------------------------------------------------------------------

_LEN = f"""strlen('MSH|^~\\&|FEED|WEB|EHR|HOSP|20240101000000||ADT^A01|E' || event_id || '|P|2.5.1') + 1 + strlen('EVN|A01|20240101000000') + 1 + strlen('PID|1||' || user_id || '^^^WEB^PI')
 + CASE event_type WHEN 'purchase' THEN 1 + strlen('OBX|1|ST|PROPS||' || coalesce({_ESCAPED}, '')) WHEN 'error' THEN 1 + strlen('ZER|1|' || user_id) ELSE 0 END"""


@query(f"""WITH {FEED}, l AS (SELECT event_id, ({_LEN})::HUGEINT AS v
 FROM f), w AS (SELECT event_id, v, count(*) OVER p AS n, (sum(v) OVER p)::DOUBLE AS s, (sum(v * v) OVER p)::DOUBLE AS q FROM l
 WINDOW p AS (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
z AS (SELECT event_id, CASE WHEN n >= 100 AND (q - s * s / n) / (n - 1) > 0 THEN least(abs(v::DOUBLE - s / n) / sqrt((q - s * s / n) / (n - 1)) / 10, 1.0) ELSE 0.0 END AS score
 FROM w) SELECT event_id, round(score, 6) AS score, score >= 0.2 AS is_anomaly FROM z""")
def guard_running_zscore(spark, d):
    scored = lifecycle.guard(derived.feed(spark, d), F.octet_length("raw"), threshold=0.2, width=1000)
    return scored.select(F.col("ordinal").alias("event_id"), F.round("guard_score", 6).alias("score"), "is_anomaly")


@query(f"WITH {FEED} SELECT 'E' || event_id AS message_id, ts + INTERVAL 30 DAY <= TIMESTAMP '2024-02-15' AND event_type <> 'error' AS due, 'archived' AS next_state, ts + INTERVAL 395 DAY AS next_at FROM f")
def lifecycle_next(spark, d):
    rows = lifecycle.metadata(_feed(spark, d), F.col("ts"), 30)
    step = lifecycle.next_step(True, 365)
    return rows.select("message_id", lifecycle.can_transition(F.lit("2024-02-15").cast("timestamp"), held=F.col("event_type") == "error").alias("due"), step["state"].alias("next_state"), step["at"].alias("next_at"))


TEMPLATE = {
    "name": "adt", "delims": "^~\\&",
    "segments": ["MSH|^~\\&|GEN|LAB|EHR|HOSP|20240101||ADT^A01|1|P|2.5.1", "PID|1||x||x^x||19800101|x"],
    "values": {"MSH.10": [{"type": "Numeric", "value": {"digits": 8}}], "PID.3": [{"type": "RealisticMrn"}], "PID.5": [{"type": "RealisticName"}], "PID.8": [{"type": "From", "value": ["M", "F"]}],
        "PID.7": [{"type": "Date", "value": {"start": "19400101", "end": "19991231"}}]},
}


@query("SELECT count(*) AS n, count(*) AS dates, count(*) AS sexes, count(*) AS again FROM customer")
def generate_messages(spark, d):
    n = spark.read.parquet(f"{d}/customer.parquet").count()
    made = generate.generate(spark, TEMPLATE, 42, n)
    ok = generate.verify_golden_hashes(generate.generate(spark, TEMPLATE, 42, n), generate.golden_hashes(made))
    rows = parsed(made.withColumn("msg_id", F.col("ordinal").cast("string")))
    counts = rows.agg(F.count("*").alias("n"), F.count_if(D.is_date(_get("PID.7"))).alias("dates"), F.count_if(_get("PID.8").isin("M", "F")).alias("sexes"))
    return counts.crossJoin(ok.agg(F.count_if("ok").alias("again")))  # one row each


@query(f"""WITH {FEED} SELECT 'start_message' AS event, count(*) AS n FROM f UNION ALL SELECT 'end_message', count(*) FROM f UNION ALL
 SELECT 'segment', count(*) * 2 + count(*) FILTER (event_type IN ('purchase', 'error')) FROM f
 UNION ALL SELECT 'field', count(*) * (11 + 2 + 3) + 5 * count(*) FILTER (event_type = 'purchase') + 2 * count(*) FILTER (event_type = 'error') FROM f""")
def stream_events(spark, d):
    return stream.events(derived.feed(spark, d)).groupBy("event").agg(F.count("*").alias("n"))


@query(f"WITH {FEED} SELECT date_trunc('day', ts) AS window_start, date_trunc('day', ts) + INTERVAL 1 DAY AS window_end, 'ADT^' || code AS message_type, count(*) AS n FROM f GROUP BY ALL")
def event_time_windows(spark, d):
    return stream.windowed_counts(stream.with_event_time(_feed(spark, d)), "1 day")


@query(f"WITH {FEED} SELECT code AS event, count(*) AS n FROM f GROUP BY 1")
def segment_fields(spark, d):
    rows = segments(_feed(spark, d), only=("EVN",))
    return rows.groupBy(F.get(F.split("line", "\\|", -1), F.lit(1)).alias("event")).agg(F.count("*").alias("n"))


# --- more of B, D, F, H and J ---------------------------------------------------------------------------------------

@query(f"WITH {ADT} SELECT msg_id, 'ADT^A01^ADT_A01' AS type, CASE WHEN no_name THEN '' ELSE replace(c_name, '#', '^') END AS name FROM a")
def joined_components(spark, d):
    m = Message()
    return _adt(spark, d).select("msg_id", m.joined_components(parse_path("MSH.9")).alias("type"), m.joined_components(parse_path("PID.5")).alias("name"))


@query("SELECT c_custkey AS k, CASE WHEN length(c_custkey::VARCHAR) < 2 THEN 'too_short' WHEN length(c_custkey::VARCHAR) > 3 THEN 'too_long' WHEN c_custkey % 10 > 5 THEN 'pattern_mismatch' WHEN c_custkey NOT IN (10, 20, 30, 111) THEN 'not_allowed' END AS fault FROM customer")
def datatype_detail(spark, d):
    text = F.col("c_custkey").cast("string")
    return spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("k"), D.detail(text, "NM", 2, 3, "[0-5]$", ["10", "20", "30", "111"]).alias("fault"))


@query("SELECT event_id, epoch(date_trunc('second', ts)) % 86400 + (event_id % 10) / 10.0 AS seconds, (event_id % 10) * 100000 AS micros, 6 AS precision, ts::DATE = DATE '2024-01-16' AS same_day FROM events")
def timestamp_fractions(spark, d):
    digit = F.concat(F.lit("."), (F.col("event_id") % 10).cast("string"))
    rows = spark.read.parquet(f"{d}/events.parquet").select("event_id", F.concat(F.date_format("ts", "yyyyMMddHHmmss"), digit).alias("t"), F.concat(F.date_format("ts", "HHmmss"), digit).alias("tm"),
        F.date_format("ts", "yyyyMMddHHmm").alias("short"))
    f = T.parse_ts_fraction(F.col("t"))
    return rows.select("event_id", T.parse_time(F.col("tm")).alias("seconds"), f["micros"].alias("micros"), f["precision"].alias("precision"), T.is_same_day(F.col("short"), F.lit("20240116")).alias("same_day"))


@query("SELECT * FROM (VALUES ('bom', 'byte_order_mark'), ('lf', 'line_feed_only'), ('frame', 'unfinished_frame'), ('good', ''), ('latin', 'not_utf8')) t(name, found)")
def doctor(spark, d):
    rows = [("bom", b"\xef\xbb\xbfMSH\r"), ("lf", b"MSH|\nPID|"), ("frame", b"\x0bMSH|\r"), ("good", b"\x0bMSH|\r\x1c\r"), ("latin", b"MSH|\xe9\r")]
    return spark.createDataFrame(rows, "name string, data binary").select("name", F.array_join(evidence.diagnostics(F.col("data")), ",").alias("found"))


@query("SELECT * FROM (VALUES ('constraints', 1), ('datatypes', 1), ('segments', 1), ('valuesets', 1)) t(family, n)")
def profile_explain(spark, d):
    counts = profile.explain(PROFILE)["counts"]
    return spark.createDataFrame([(k, v) for k, v in counts.items() if v], "family string, n int")


@query(f"WITH {ADT} SELECT msg_id, 'sha256:' || substr(sha256('C' || k), 1, 16) AS control FROM a")
def hashed_identifiers(spark, d):
    return _adt(spark, d).select("msg_id", redact.hash_identifier(_get("MSH.10")).alias("control"))


@query(f"""WITH {FEED}, g AS (SELECT user_id, date_trunc('second', ts) AS ts, CASE WHEN date_trunc('second', ts) - lag(date_trunc('second', ts)) OVER w <= INTERVAL 12 HOUR THEN 0
 ELSE 1 END AS fresh FROM f WINDOW w AS (PARTITION BY user_id ORDER BY date_trunc('second', ts), event_id)),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g)
 SELECT user_id::VARCHAR AS pid, min(ts) AS session_start, max(ts) + INTERVAL 12 HOUR AS session_end, count(*) AS n FROM s GROUP BY user_id, n""")
def event_time_sessions(spark, d):
    timed = stream.with_event_time(_feed(spark, d)).withColumn("pid", _get("PID.3.1"))
    return stream.session_counts(timed, "pid", "12 hours")


@query("SELECT * FROM (VALUES ('good', true), ('plain', true), ('nested', true)) t(file_id, same)")
def lenient_batches(spark, d):
    m = "MSH|^~\\&|A\rPID|1"
    rows = [("good", f"BHS|^~\\&\r{m}\rBTS|9\r"), ("plain", m), ("nested", f"FHS|^~\\&\rBHS|^~\\&\r{m}\rBTS|1\rFTS|1\r")]
    found = batch.messages(spark.createDataFrame(rows, "file_id string, raw string"))
    return found.select("file_id", (F.col("raw") == m).alias("same"))


from . import coverage  # noqa: E402, F401  further queries register themselves
