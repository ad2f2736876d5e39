"""Raw messages to canonical lines, segments, fields and atoms.

Parsing never fails: a message that can't be read has ``parse_error`` (code and segment) and no lines. All
functions are row-local; segments, fields and atoms are reached by generators, without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.delims import canonical, of_line
from ..functions.text import NULL, once, unescape
from ..plans.paths import Message, parse_path


def lines_of(raw: Column) -> Column:
    """Lines end with CR; one LF at the start of a line is dropped, and so are empty lines."""
    stripped = F.transform(F.split(raw, "\r", -1), lambda x: F.when(F.substring(x, 1, 1) == "\n", F.substring(x, 2, 2147483647)).otherwise(x))
    return F.filter(stripped, lambda x: x != "")


def _line_error(line: Column, field: Column) -> Column:
    return (
        F.when(~line.rlike("^[A-Z0-9]{3}"), "InvalidSegmentId")
        .when((F.length(line) > 3) & (F.substring(line, 4, 1) != field), "InvalidFieldFormat")
        .when(F.contains(line, F.lit("\n")), "InvalidFieldFormat")
    )


def parse(messages: DataFrame, raw: str = "raw") -> DataFrame:
    """``messages`` with ``delims`` (five characters), canonical ``lines`` and ``parse_error`` struct(code, segment_id).

    ``raw`` is a string or binary column. A null message is read as an empty one.
    """
    text = F.coalesce(F.col(raw).cast("string"), F.lit(""))
    step = messages.withColumn("_text", text).withColumn("_lines", lines_of(F.col("_text"))).withColumn("_msh", F.get("_lines", F.lit(0)))
    step = step.withColumn("_delims", of_line(F.col("_msh")))
    msh, delims = F.col("_msh"), F.col("_delims")
    characters = F.split(delims, "")
    header = (
        F.when(~F.is_valid_utf8(F.col("_text")), "InvalidCharset")
        .when(msh.isNull() | ~F.startswith(msh, F.lit("MSH")), "InvalidSegmentId")
        .when((F.octet_length(msh) < 8) | (F.length(msh) < 8), "BadDelimLength")
        .when((F.length(msh) > 8) & (F.substring(msh, 9, 1) != F.substring(msh, 4, 1)), "MshFieldMalformed")
        .when(~delims.rlike("^[\\x00-\\x09\\x0B\\x0C\\x0E-\\x7F]{5}\\z"), "BadDelimLength")
        .when(F.size(F.array_distinct(characters)) < 5, "DuplicateDelims")
    )
    step = step.withColumn("_header_error", header)
    field = F.substring(delims, 1, 1)
    bad = F.get(F.filter(F.transform("_lines", lambda x: F.struct(_line_error(x, field).alias("code"), F.substring(x, 1, 3).alias("segment_id"))), lambda e: e["code"].isNotNull()), F.lit(0))
    error = F.when(F.col("_header_error").isNotNull(), F.struct(F.col("_header_error").alias("code"), F.substring(F.coalesce(msh, F.lit("")), 1, 3).alias("segment_id"))).otherwise(bad)
    step = step.withColumn("parse_error", error)
    ok = F.col("parse_error").isNull()
    step = step.withColumn("lines", F.when(ok, F.transform("_lines", lambda x: canonical(x, delims))))
    # A generator between this and what follows: a filter on the outcome must not be pushed below it, where the
    # whole parse would be worked out again inside the filter, once for each time a step names the one before.
    out = F.struct(F.when(ok, delims).alias("delims"), "lines", "parse_error")
    kept = [c for c in messages.columns if c not in ("delims", "lines", "parse_error")]
    return step.select(*kept, F.explode(F.array(out)).alias("_p")).select(*kept, "_p.delims", "_p.lines", "_p.parse_error")


def parsed(messages: DataFrame, raw: str = "raw") -> DataFrame:
    """The messages that can be read."""
    return parse(messages, raw).filter(F.col("parse_error").isNull())


def occurrence_numbers(ids: Column) -> Column:
    """For each element the how-manieth it is of its kind, from 1: one pass for each distinct element, and one sort."""

    def numbered(own: Column) -> Column:
        def of_kind(kind: Column) -> Column:
            places = F.filter(F.transform(own, lambda x, i: F.when(x == kind, i)), lambda i: i.isNotNull())
            return F.transform(places, lambda i, n: F.struct(i.alias("i"), (n + 1).alias("n")))

        return F.transform(F.sort_array(F.flatten(F.transform(F.array_distinct(own), of_kind))), lambda s: s["n"])

    return once(ids, numbered)


def segments(messages: DataFrame, key: str = "msg_id", only: tuple[str, ...] = (), with_rep: bool = True) -> DataFrame:
    """One row per segment: key, delims, seg_idx (from 0), seg_id, seg_rep (from 1), line.

    ``only`` prunes lines before they are exploded, as no optimizer rule does.
    """
    numbered = F.transform("lines", lambda line, i: F.struct(i.alias("seg_idx"), F.substring(line, 1, 3).alias("seg_id"), line.alias("line")))
    if only:
        numbered = F.filter(numbered, lambda s: s["seg_id"].isin(*only))
    rows = messages.withColumn("_s", numbered)
    if with_rep:
        rows = rows.withColumn("_reps", occurrence_numbers(F.transform("_s", lambda s: s["seg_id"])))
        rows = rows.withColumn("_s", F.zip_with("_s", "_reps", lambda s, n: s.withField("seg_rep", n)))
    out = rows.select(key, "delims", F.explode("_s").alias("s"))
    return out.select(key, "delims", *[f"s.{c}" for c in ("seg_idx", "seg_id", *["seg_rep"] * with_rep, "line")])


def fields(messages: DataFrame, key: str = "msg_id", only: tuple[str, ...] = (), with_rep: bool = False) -> DataFrame:
    """One row per field: key, delims, seg_idx, seg_id, [seg_rep,] field_no (as HL7 counts), raw."""
    rows = segments(messages, key, only, with_rep)
    pieces = F.when(F.length("line") > 4, F.slice(F.split("line", "\\|", -1), F.lit(2), F.size(F.split("line", "\\|", -1))))
    found = rows.select(key, "delims", "seg_idx", "seg_id", *["seg_rep"] * with_rep, F.posexplode(pieces).alias("at", "raw"))
    is_msh = F.col("seg_id") == "MSH"
    number = F.col("at") + F.when(is_msh, 2).otherwise(1)
    return found.select(key, "delims", "seg_idx", "seg_id", *["seg_rep"] * with_rep, number.alias("field_no"), "raw")


def is_encoding(prefix: str = "") -> Column:
    """Whether a field row is MSH-2, whose characters are text and not delimiters."""
    return (F.col(f"{prefix}seg_id") == "MSH") & (F.col(f"{prefix}field_no") == 2)


def field_present() -> Column:
    """Whether a field has a text that isn't empty, or an HL7 null."""
    return is_encoding() | (F.translate("raw", "~^&", "") != "")


def atoms(messages: DataFrame, key: str = "msg_id", only: tuple[str, ...] = (), with_rep: bool = True) -> DataFrame:
    """One row per atom: key, seg_idx, seg_id, [seg_rep,] field_no, rep, comp, sub, n_comps, text, is_null."""
    head = [key, "delims", "seg_idx", "seg_id", *["seg_rep"] * with_rep, "field_no"]
    rows = fields(messages, key, only, with_rep)
    reps = rows.select(*head, F.posexplode(F.when(is_encoding(), F.array("raw")).otherwise(F.split("raw", "~", -1))).alias("rep", "r"))
    split_rep = F.when(is_encoding(), F.array("r")).otherwise(F.split("r", "\\^", -1))
    comps = reps.select(*head, (F.col("rep") + 1).alias("rep"), F.size(split_rep).alias("n_comps"), F.posexplode(split_rep).alias("comp", "c"))
    subs = comps.select(*head, "rep", "n_comps", (F.col("comp") + 1).alias("comp"), F.posexplode(F.when(is_encoding(), F.array("c")).otherwise(F.split("c", "&", -1))).alias("sub", "s"))
    null = F.col("s") == NULL
    text = F.when(is_encoding(), F.substring("delims", 2, 4)).when(~null, unescape(F.col("s"), F.col("delims")))
    return subs.select(*[h for h in head if h != "delims"], "rep", "comp", (F.col("sub") + 1).alias("sub"), "n_comps", text.alias("text"), null.alias("is_null"))


def charsets() -> Column:
    """MSH-18: the first texts of its repetitions that aren't empty."""
    return F.filter(Message().condition_values(parse_path("MSH.18.1.1")), lambda x: x != "")


def corpus_type() -> Column:
    """The message type as corpora count it: all components of MSH-9, or UNKNOWN without the field."""
    message = Message()
    reps = message.reps(parse_path("MSH.9"))
    first = F.transform(F.split(F.get(reps, F.lit(0)), "\\^", -1), lambda c: F.get(F.split(c, "&", -1), F.lit(0)))
    return F.coalesce(F.array_join(F.transform(F.filter(first, lambda x: x != NULL), message.text), "^"), F.lit("UNKNOWN"))


def report_type() -> Column:
    """The message type as reports give it: the code and, if there is one, the event."""
    message = Message()
    code, event = message.get(parse_path("MSH.9.1")), message.get(parse_path("MSH.9.2"))
    return F.when(event.isNotNull(), F.concat_ws("^", code, event)).otherwise(code)


def trace_type() -> Column:
    return F.coalesce(report_type(), F.lit("unknown"))
