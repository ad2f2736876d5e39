"""Messages back to the wire, to JSON, to canonical delimiters, and their acknowledgements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.delims import CANONICAL, canonical, original, part
from ..functions.text import NULL, escape, once, sha256, unescape
from ..plans.paths import Message, parse_path

#: What an HL7 null is in JSON.
JSON_NULL = "__NULL__"
CANONICAL_HEAD = f"MSH{CANONICAL}"


def _rewritten(line: Column, delims: Column, own: bool) -> Column:
    """A canonical line with every atom read and escaped again, under the message's own delimiters or canonical ones.

    Sequences that aren't known, or aren't closed, are text: their escape characters are escaped.
    """

    def atom(raw: Column) -> Column:
        text = unescape(raw, delims)
        # Under the message's own delimiters canonical delimiter characters are text. Under canonical ones they need escapes.
        return F.when(raw == NULL, raw).otherwise(escape(canonical(text, delims) if own else text))

    is_msh = F.startswith(line, F.lit("MSH"))
    head, body = F.when(is_msh, CANONICAL_HEAD).otherwise(""), F.when(is_msh, F.substring(line, 9, 2147483647)).otherwise(line)
    pieces, marks = F.split(body, "[|~^&]", -1), F.regexp_extract_all(body, F.lit("([|~^&])"), F.lit(1))
    rewritten = F.concat(head, F.array_join(F.zip_with(pieces, marks, lambda p, mark: F.concat(atom(p), F.coalesce(mark, F.lit("")))), ""))
    as_is = ~F.contains(body, F.lit("\\")) if own else (delims == CANONICAL) & ~F.contains(body, F.lit("\\"))
    done = F.when(as_is, line).otherwise(rewritten)
    return original(done, delims) if own else done


def wire() -> Column:
    """The message as it is written: its own delimiters, every atom read and escaped again; every segment ends with CR."""
    return F.concat(F.array_join(F.transform("lines", lambda line: _rewritten(line, F.col("delims"), True)), "\r"), F.lit("\r"))


def normalised() -> Column:
    """The message with canonical delimiters, text escaped for them."""
    return F.concat(F.array_join(F.transform("lines", lambda line: _rewritten(line, F.col("delims"), False)), "\r"), F.lit("\r"))


def message_hash() -> Column:
    return sha256(wire())


def tree() -> Column:
    """segments as array<struct<id, fields: map<string, array<array<array<string>>>>>>; HL7 nulls are ``JSON_NULL``."""
    delims = F.col("delims")

    def read(atom: Column) -> Column:
        return F.when(atom == NULL, JSON_NULL).otherwise(unescape(atom, delims))

    def comps(rep: Column) -> Column:
        return F.transform(F.split(rep, "\\^", -1), lambda comp: F.transform(F.split(comp, "&", -1), read))

    def one(line: Column) -> Column:
        is_msh = F.startswith(line, F.lit("MSH"))
        raw = F.when(F.length(line) > 4, once(F.split(line, "\\|", -1), lambda f: F.slice(f, F.lit(2), F.size(f)))).otherwise(F.array().cast("array<string>"))
        number = lambda i: (i + F.when(is_msh, 2).otherwise(1)).cast("string")
        entry = lambda f, i: F.struct(number(i).alias("key"), F.when(is_msh & (i == 0), F.array(F.array(F.array(F.substring(delims, 2, 4))))).otherwise(F.transform(F.split(f, "~", -1), comps)).alias("value"))
        return F.struct(F.substring(line, 1, 3).alias("id"), F.map_from_entries(F.transform(raw, entry)).alias("fields"))

    return F.transform("lines", one)


def to_json(charsets: Column, pretty: bool = False) -> Column:
    names = ("field", "comp", "rep", "esc", "sub")
    meta = F.struct(F.struct(*[part(F.col("delims"), n).alias(n) for n in names]).alias("delims"), charsets.alias("charsets"))
    return F.to_json(F.struct(meta.alias("meta"), tree().alias("segments")), {"pretty": "true"} if pretty else {})


# --- acknowledgements -----------------------------------------------------------------------------------

CODES = ("AA", "AE", "AR", "CA", "CE", "CR")


def ack(code: Column | str, at: Column, error: Column | None = None, unknown: str = "HATLAKE") -> Column:
    """An acknowledgement with swapped parties and canonical delimiters; ``at`` is the time it gives.

    The message type is ACK and the code of the original; parties that it doesn't name are ``unknown``.
    """
    m = Message()
    get = lambda path, default="": F.coalesce(m.get(parse_path(path)), F.lit(default))
    code = F.lit(code) if isinstance(code, str) else code
    put = lambda x: escape(x)
    msh = F.concat_ws(
        "|", F.lit("MSH"), F.lit("^~\\&"), put(get("MSH.5")), put(get("MSH.6")), put(get("MSH.3", unknown)), put(get("MSH.4", unknown)), F.date_format(at, "yyyyMMddHHmmss"), F.lit(""),
        F.concat(F.lit("ACK^"), put(get("MSH.9", "ACK"))), put(get("MSH.10")), put(get("MSH.11", "P")), put(get("MSH.12", "2.5.1")),
    )
    msa = F.concat_ws("|", F.lit("MSA"), code, put(get("MSH.10")))
    lines = F.concat(msh, F.lit("\r"), msa, F.lit("\r"))
    return lines if error is None else F.concat(lines, F.when(error.isNotNull(), F.concat(F.lit("ERR|||"), put(error), F.lit("\r"))).otherwise(""))


def ack_policy(parsed_ok: Column, issue_count: Column, mode: str = "original", error_text: bool = True) -> Column:
    """struct(outcome, reason, ack_code, error_text): accepted if valid, rejected if it can't be read or breaks the profile."""
    accept, reject = ("AA", "AR") if mode == "original" else ("CA", "CR")
    reason = F.when(~parsed_ok, "parse_error").when(issue_count > 0, "validation_error").otherwise("valid")
    text = F.when(~parsed_ok, "message parsing failed").when(issue_count > 0, F.concat(F.lit("message validation failed with "), issue_count.cast("string"), F.lit(" issue(s)")))
    return F.struct(
        F.when(reason == "valid", "accepted").otherwise("rejected").alias("outcome"), reason.alias("reason"),
        F.when(reason == "valid", accept).otherwise(reject).alias("ack_code"), (text if error_text else F.lit(None).cast("string")).alias("error_text"))


def header_only(raw: Column) -> Column:
    """The MSH line of a message that can't be read as a whole, for its acknowledgement."""
    return F.get(F.split(raw, "\r", 2), F.lit(0))


def write_files(messages: DataFrame, path: str, raw: str = "raw") -> None:
    """Text files of messages, one message a record, records separated by an empty segment."""
    messages.select(F.col(raw).alias("value")).write.option("lineSep", "\r\n").text(path)
