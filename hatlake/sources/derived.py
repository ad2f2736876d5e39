"""Message corpora that are derived from relational tables, so that their contents are known without parsing.

Every corpus has msg_id, source, ordinal and raw. Nothing is random.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import escape

CUSTOM = "*%$!?"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _line(*parts: str | Column) -> Column:
    """Parts joined by the field separator; strings are literal."""
    return F.concat_ws("|", *[F.coalesce(p, F.lit("")) if isinstance(p, Column) else F.lit(p) for p in parts])


def _message(*lines: Column) -> Column:
    return F.array_join(F.filter(F.array(*lines), lambda x: x.isNotNull()), "\r")


def _text(column: str) -> Column:
    return F.col(column).cast("string")


def oru(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An observation message for each order with lineitems: MSH, PID, OBR and an OBX for each lineitem."""
    items = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag"))).alias("items")
    )
    orders = _table(spark, sf_dir, "orders").join(items, F.col("o_orderkey") == F.col("l_orderkey"))
    rows = orders.join(_table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    key = _text("o_orderkey")
    obx = F.transform(
        "items",
        lambda x, i: F.concat_ws(
            "|", F.lit("OBX"), (i + 1).cast("string"), F.lit("NM"), F.concat(x["l_partkey"].cast("string"), F.lit("^PART"), x["l_partkey"].cast("string")), F.lit(""),
            x["l_quantity"].cast("bigint").cast("string"), F.lit("EA"), F.lit(""), x["l_returnflag"], F.lit(""), F.lit(""), F.lit("F"),
        ),
    )
    raw = F.concat_ws(
        "\r",
        _line("MSH", "^~\\&", "LAB", F.concat(F.lit("FAC"), _text("c_nationkey")), "EHR", "HOSP", F.date_format("o_orderdate", "yyyyMMddHHmmss"), "", "ORU^R01^ORU_R01", key, "P", "2.5.1"),
        _line("PID", "1", "", F.concat(_text("c_custkey"), F.lit("^^^HOSP^MR")), "", F.replace(F.col("c_name"), F.lit("#"), F.lit("^"))),
        _line("OBR", "1", key, "", F.col("o_orderpriority")),
        F.array_join(obx, "\r"),
    )
    return rows.select(key.alias("msg_id"), F.lit("oru").alias("source"), F.col("o_orderkey").alias("ordinal"), raw.alias("raw"))


def adt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An admission message for each customer, with faults by the customer's number.

    By 5: a second identifier. By 7: no identifier. By 11: sex X. By 13: an impossible birth date. By 17: a
    null name. By 19: delimiters of its own. By 3: a next of kin. By 23: two PV1. By 29: no PV1.
    """
    k = F.col("c_custkey")
    by = lambda n: k % n == 0
    number = k.cast("string")
    ids = F.when(by(7), "").when(by(5), F.concat(number, F.lit("^^^HOSP^MR~A"), number, F.lit("^^^ALT^PI"))).otherwise(F.concat(number, F.lit("^^^HOSP^MR")))
    born = F.when(by(13), "19991332").otherwise(F.concat((1940 + k % 60).cast("string"), F.lpad((1 + k % 12).cast("string"), 2, "0"), F.lpad((1 + k % 28).cast("string"), 2, "0")))
    sex = F.when(by(11), "X").when(k % 2 == 0, "F").otherwise("M")
    name = F.when(by(17), '""').otherwise(F.replace(F.col("c_name"), F.lit("#"), F.lit("^")))
    phone = F.concat(F.lit("555"), F.lpad((k % 10000000).cast("string"), 7, "0"))
    pv1 = _line("PV1", "1", F.when(k % 4 == 0, "I").otherwise("O"), F.concat(F.lit("W"), _text("c_nationkey"), F.lit("^1")))
    raw = _message(
        _line("MSH", "^~\\&", "ADT", F.concat(F.lit("FAC"), _text("c_nationkey")), "EHR", "HOSP", "20240101120000", "", "ADT^A01^ADT_A01", F.concat(F.lit("C"), number), "P", "2.5.1"),
        _line("EVN", "A01", "20240101120000"),
        _line("PID", "1", "", ids, "", name, "", born, sex, "", "", escape(F.concat(F.col("c_mktsegment"), F.lit(" & Co|"))), "", phone),
        F.when(~by(29), pv1), F.when(by(23) & ~by(29), pv1),
        F.when(by(3), _line("NK1", "1", F.concat(F.lit("Kin^"), number), "SPO")),
    )
    own = F.when(by(19), F.translate(raw, "|^~\\&", CUSTOM)).otherwise(raw)
    return _table(spark, sf_dir, "customer").select(number.alias("msg_id"), F.lit("adt").alias("source"), k.alias("ordinal"), own.alias("raw"))


#: The message event of each event type.
EVENT_OF = {"click": "A01", "view": "A03", "signup": "A04", "purchase": "A08", "error": "A31"}


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A message for each event, with its time in MSH-7; also ``ts``, ``event_type`` and ``user_id``."""
    code = F.create_map(*[F.lit(x) for pair in EVENT_OF.items() for x in pair])[F.col("event_type")]
    raw = F.concat_ws(
        "\r",
        _line("MSH", "^~\\&", "FEED", "WEB", "EHR", "HOSP", F.date_format("ts", "yyyyMMddHHmmss"), "", F.concat(F.lit("ADT^"), code), F.concat(F.lit("E"), _text("event_id")), "P", "2.5.1"),
        _line("EVN", code, F.date_format("ts", "yyyyMMddHHmmss")),
        _line("PID", "1", "", F.concat(_text("user_id"), F.lit("^^^WEB^PI"))),
        F.when(F.col("event_type") == "purchase", _line("OBX", "1", "ST", "PROPS", "", escape(F.col("props")))),
        F.when(F.col("event_type") == "error", _line("ZER", "1", _text("user_id"))),
    )
    return _table(spark, sf_dir, "events").select(_text("event_id").alias("msg_id"), F.lit("feed").alias("source"), F.col("event_id").alias("ordinal"), raw.alias("raw"), "ts", "event_type", "user_id")


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A message for each document, its text escaped in OBX-5."""
    raw = F.concat_ws(
        "\r",
        _line("MSH", "^~\\&", "NOTES", _text("source"), "EHR", "HOSP", "20240101", "", "MDM^T02", F.concat(F.lit("D"), _text("doc_id")), "P", "2.5.1", "", "", "", "", "", "UNICODE UTF-8"),
        _line("OBX", "1", "TX", "NOTE", "", escape(F.coalesce("text", F.lit("")))),
    )
    return _table(spark, sf_dir, "documents").select(_text("doc_id").alias("msg_id"), F.lit("notes").alias("source"), F.col("doc_id").alias("ordinal"), raw.alias("raw"), "text")


#: Messages that can't be read, with the code that each gives.
MALFORMED = (
    ("no_msh", "PID|1||1", "InvalidSegmentId"),
    ("empty", "", "InvalidSegmentId"),
    ("short", "MSH|^~", "BadDelimLength"),
    ("duplicate", "MSH|^^\\&|A", "DuplicateDelims"),
    ("ninth", "MSH|^~\\&@A|B", "MshFieldMalformed"),
    ("bad_encoding", "MSH||Sending|X", "MshFieldMalformed"),
    ("bad_id", "MSH|^~\\&|A\rpid|1", "InvalidSegmentId"),
    ("no_separator", "MSH|^~\\&|A\rINVALID SEGMENT", "InvalidFieldFormat"),
    ("line_feed", "MSH|^~\\&|A\nPID|1", "InvalidFieldFormat"),
    ("truncated", "MSH|^~\\&|A", None),
    ("crlf", "MSH|^~\\&|A\r\nPID|1\r\n", None),
)


def malformed(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(name, "malformed", i, raw) for i, (name, raw, _) in enumerate(MALFORMED)], "msg_id string, source string, ordinal long, raw string")
