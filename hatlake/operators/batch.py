"""Batches and batch files: envelopes to messages, strictly or leniently, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def batch_lines(raw: Column) -> Column:
    """Lines that end with CR, LF or CRLF; empty ones are dropped."""
    return F.filter(F.split(raw, "\r\n|\r|\n", -1), lambda x: x != "")


def _numbered(files: DataFrame, key: str, raw: str) -> DataFrame:
    """One row per line with running numbers of its batch and message within the file.

    The running sums are over one file each; files are dealt over the cluster by ``key``.
    """
    rows = files.select(key, F.posexplode(batch_lines(F.col(raw))).alias("pos", "line")).withColumn("id", F.substring("line", 1, 3))
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    opens = F.sum(F.when(F.col("id") == "BHS", 1).otherwise(0)).over(w)
    closes = F.sum(F.when(F.col("id") == "BTS", 1).otherwise(0)).over(w)
    numbered = rows.withColumn("batch", opens).withColumn("inside", (opens > closes) | (F.col("id") == "BTS")).withColumn("message", F.sum(F.when(F.col("id") == "MSH", 1).otherwise(0)).over(w))
    return numbered


def messages(files: DataFrame, key: str = "file_id", raw: str = "raw") -> DataFrame:
    """One row per message: key, batch (from 1; null outside a batch), message (from 1 in the file), msg_id, raw."""
    body = _numbered(files, key, raw).filter(~F.col("id").isin("FHS", "FTS", "BHS", "BTS") & (F.col("message") > 0))
    joined = body.groupBy(key, "message").agg(
        F.min(F.when(F.col("inside"), F.col("batch"))).alias("batch"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\r").alias("raw"),
    )
    return joined.select(key, "batch", "message", F.concat_ws("/", F.col(key).cast("string"), F.col("message").cast("string")).alias("msg_id"), "raw")


#: Envelope attributes by field number.
HEADER = {3: "sending_application", 4: "sending_facility", 5: "receiving_application", 6: "receiving_facility", 7: "creation_time", 8: "security", 9: "name", 10: "comment"}


def info(line: Column) -> Column:
    """Attributes of an FHS or BHS line, or count and comment of an FTS or BTS line; empty ones are null."""
    mark = F.substring(line, 4, 1)
    pieces = F.split(F.substring(line, 5, 2147483647), F.concat(F.lit("\\Q"), mark, F.lit("\\E")), -1)
    trailer = F.substring(line, 1, 3).isin("FTS", "BTS")
    get = lambda i: F.nullif(F.get(pieces, F.lit(i)), F.lit(""))
    header = [F.when(~trailer, get(n - 2)).alias(name) for n, name in HEADER.items()]
    return F.struct(
        F.nullif(mark, F.lit("")).alias("field_separator"), F.when(~trailer, get(0)).alias("encoding_characters"), *header,
        F.when(trailer, get(0).try_cast("int")).alias("message_count"), F.when(trailer, get(1)).alias("trailer_comment"))


def envelopes(files: DataFrame, key: str = "file_id", raw: str = "raw") -> DataFrame:
    """One row per header or trailer line: key, batch, id and its attributes."""
    rows = _numbered(files, key, raw).filter(F.col("id").isin("FHS", "FTS", "BHS", "BTS"))
    return rows.select(key, F.when(F.col("id").isin("BHS", "BTS"), F.col("batch")).alias("batch"), "id", info(F.col("line")).alias("i")).select(key, "batch", "id", "i.*")


def check(files: DataFrame, key: str = "file_id", raw: str = "raw") -> DataFrame:
    """One row per file: batches, messages and ``error``, the first fault of its envelope or null.

    InvalidStructure: nothing, or something else than FHS, BHS or MSH first. MissingSegment: a batch without
    end or beginning. CountMismatch: a trailer's count isn't that of the messages.
    """
    rows = _numbered(files, key, raw).withColumn("count", info(F.col("line"))["message_count"])
    is_ = lambda *ids: F.col("id").isin(*ids)
    per_batch = rows.filter("inside").groupBy(key, "batch").agg(
        F.count_if(is_("BHS")).alias("bhs"), F.count_if(is_("BTS")).alias("bts"), F.count_if(is_("MSH")).alias("n"), F.max(F.when(is_("BTS"), F.col("count"))).alias("declared")
    )
    fault = F.when(F.col("bts") == 0, "MissingSegment BTS").when(F.col("declared") != F.col("n"), "CountMismatch")
    batches = per_batch.groupBy(key).agg(F.count_if(F.col("bhs") > 0).alias("batches"), F.min_by(fault, F.when(fault.isNotNull(), F.col("batch"))).alias("batch_error"))
    whole = rows.groupBy(key).agg(
        F.min_by("id", "pos").alias("first"), F.count_if(is_("MSH")).alias("messages"), F.max(F.when(is_("FTS"), F.col("count"))).alias("declared"),
        F.count_if(is_("BTS") & (F.col("batch") == 0)).alias("stray"),
    )
    joined = files.select(key).join(whole, key, "left").join(batches, key, "left")
    error = (
        F.when(F.coalesce("first", F.lit("")).isin("FHS", "BHS", "MSH") == F.lit(False), "InvalidStructure")
        .when(F.col("stray") > 0, "MissingSegment BHS")
        .when(F.col("batch_error").isNotNull(), F.col("batch_error"))
        .when((F.col("first") == "FHS") & (F.col("declared") != F.col("messages")), "CountMismatch")
    )
    return joined.select(key, F.coalesce("batches", F.lit(0)).cast("long").alias("batches"), F.coalesce("messages", F.lit(0)).cast("long").alias("messages"), error.alias("error"))


def write_batch(messages_frame: DataFrame, by: str, raw: str = "raw", order: str = "ordinal", size: int | None = None) -> DataFrame:
    """One batch file for each ``by``: BHS, the messages in order, BTS with their number.

    A batch is one row, so it must fit into a task. With ``size`` the messages of a ``by`` are dealt in their order into
    batches of at most so many, told apart by ``part`` (from 0); numbering them is a sort that can spill.
    """
    if size is not None:
        place = F.row_number().over(Window.partitionBy(by).orderBy(order, raw)) - 1
        dealt = messages_frame.withColumn("part", F.floor(place / size).cast("long")).withColumn("_by", F.struct(by, "part"))
        return write_batch(dealt, "_by", raw, order).select(f"_by.{by}", "_by.part", "raw")
    ordered = F.transform(F.sort_array(F.collect_list(F.struct(order, raw))), lambda x: F.rtrim(x[raw], F.lit("\r")))
    return messages_frame.groupBy(by).agg(F.concat(F.lit("BHS|^~\\&\r"), F.array_join(ordered, "\r"), F.lit("\rBTS|"), F.count("*").cast("string"), F.lit("\r")).alias("raw"))


def write_file_batch(batches: DataFrame, key: str, raw: str = "raw", order: str = "ordinal") -> DataFrame:
    """One batch file for each ``key`` of batches that ``write_batch`` gave: FHS, the batches, FTS with the number of messages."""
    ordered = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, raw))), lambda x: x[raw]), "")
    count = F.sum(F.size(F.filter(batch_lines(F.col(raw)), lambda x: F.startswith(x, F.lit("MSH")))))
    return batches.groupBy(key).agg(F.concat(F.lit("FHS|^~\\&\r"), ordered, F.lit("FTS|"), count.cast("string"), F.lit("\r")).alias("raw"))
