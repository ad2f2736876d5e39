"""Corpus summaries, fingerprints and differences.

Everything comes from one field-level frame. Counts are aggregated in two levels, by message and then over
messages, and partial sums run before every shuffle, so a corpus of one message type isn't a hot group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.datatypes import NUMBER_OR_NAMED
from ..functions.text import sha256, unescape
from .parse import corpus_type, field_present, fields, is_encoding, segments

SHAPES = ("coded", "timestamp", "numeric", "null", "text")
CARDINALITY = ("min_per_message", "max_per_message", "total_occurrences", "message_count")


def field_path() -> Column:
    return F.concat("seg_id", F.lit("."), F.col("field_no").cast("string"))


def natural_order(path: str = "path") -> list[Column]:
    """Field paths by segment, then field number, then text."""
    return [F.substring_index(path, ".", 1), F.substring_index(path, ".", -1).try_cast("int").asc_nulls_last(), F.col(path)]


def segment_counts(messages: DataFrame) -> DataFrame:
    return segments(messages, with_rep=False).groupBy(F.col("seg_id").alias("value")).agg(F.count("*").alias("count"))


def message_type_counts(messages: DataFrame) -> DataFrame:
    return messages.groupBy(corpus_type().alias("value")).agg(F.count("*").alias("count"))


def present_fields(messages: DataFrame, key: str = "msg_id") -> DataFrame:
    return fields(messages, key).filter(field_present()).withColumn("path", field_path())


def _per_message(messages: DataFrame, key: str) -> DataFrame:
    return present_fields(messages, key).groupBy("path", key).agg(F.count("*").alias("n"))


def field_presence(messages: DataFrame, key: str = "msg_id") -> DataFrame:
    """path, message_count, occurrence_count of fields that hold something."""
    return _per_message(messages, key).groupBy("path").agg(F.count("*").alias("message_count"), F.sum("n").alias("occurrence_count"))


def field_cardinality(messages: DataFrame, key: str = "msg_id") -> DataFrame:
    """path and occurrences in a message: min (0 if any message lacks the path), max, total, and messages that have it."""
    total = messages.agg(F.count("*").alias("all"))
    counted = _per_message(messages, key).groupBy("path").agg(
        F.min("n").alias("least"), F.max("n").alias("max_per_message"), F.sum("n").alias("total_occurrences"), F.count("*").alias("message_count")
    )
    joined = counted.crossJoin(F.broadcast(total))  # one row
    return joined.select("path", F.when(F.col("message_count") < F.col("all"), 0).otherwise(F.col("least")).cast("long").alias("min_per_message"), *CARDINALITY[1:])


def shape_of(rep: Column, delims: Column) -> Column:
    """The shape of a raw repetition, null for an empty one."""
    first = unescape(F.get(F.split(rep, "&", -1), F.lit(0)), delims)
    return (
        F.when(rep.rlike(r'(?:^|[\^&])""(?:[\^&]|\z)'), "null")
        .when(F.contains(rep, F.lit("^")), "coded")
        .when(first == "", F.lit(None))
        .when(first.rlike(r"^(?:[0-9]{8}|[0-9]{12}|[0-9]{14})\z"), "timestamp")
        .when(first.rlike(NUMBER_OR_NAMED), "numeric")
        .otherwise("text")
    )


def value_shapes(messages: DataFrame, key: str = "msg_id") -> DataFrame:
    """path and counts of repetitions by shape."""
    reps = F.when(is_encoding(), F.array(F.lit("text"))).otherwise(F.transform(F.split("raw", "~", -1), lambda r: shape_of(r, F.col("delims"))))
    rows = present_fields(messages, key).select("path", F.explode(reps).alias("shape"))
    return rows.groupBy("path").agg(*[F.count_if(F.col("shape") == s).alias(f"{s}_count") for s in SHAPES])


def totals(parsed_all: DataFrame, raw: str = "raw") -> DataFrame:
    """One row: file_count, message_count, parse_error_count, total_bytes of frames that ``parse`` gave."""
    bad = F.col("parse_error").isNotNull()
    return parsed_all.agg(F.count("*").alias("file_count"), F.count_if(~bad).alias("message_count"), F.count_if(bad).alias("parse_error_count"), F.coalesce(F.sum(F.octet_length(raw)), F.lit(0)).alias("total_bytes"))


def parse_failures(parsed_all: DataFrame, key: str = "msg_id") -> DataFrame:
    return parsed_all.filter("parse_error IS NOT NULL").select(key, F.col("parse_error.code").alias("code"), F.col("parse_error.segment_id").alias("segment_id"))


def summary(parsed_all: DataFrame, key: str = "msg_id") -> dict[str, DataFrame]:
    good = parsed_all.filter("parse_error IS NULL")
    return {"totals": totals(parsed_all), "message_types": message_type_counts(good), "segments": segment_counts(good), "field_presence": field_presence(good, key), "parse_errors": parse_failures(parsed_all, key)}


def _count_of(shape: str) -> Column:
    return F.size(F.filter("shapes", lambda x: x == shape))


def fingerprint(messages: DataFrame, key: str = "msg_id") -> DataFrame:
    """One row per field path: presence, cardinality and shapes from a single pass over the fields."""
    marks = F.when(is_encoding(), F.array(F.lit("text"))).otherwise(F.transform(F.split("raw", "~", -1), lambda r: shape_of(r, F.col("delims"))))
    rows = present_fields(messages, key).select("path", key, marks.alias("shapes"))
    counted = [F.sum(_count_of(s)).alias(f"{s}_count") for s in SHAPES]
    each = rows.groupBy("path", key).agg(F.count("*").alias("n"), *counted)
    total = messages.agg(F.count("*").alias("all"))
    paths = each.groupBy("path").agg(
        F.min("n").alias("least"), F.max("n").alias("max_per_message"), F.sum("n").alias("total_occurrences"), F.count("*").alias("message_count"),
        *[F.sum(f"{s}_count").alias(f"{s}_count") for s in SHAPES],
    ).crossJoin(F.broadcast(total))  # one row
    least = F.when(F.col("message_count") < F.col("all"), 0).otherwise(F.col("least")).cast("long").alias("min_per_message")
    return paths.select("path", least, *CARDINALITY[1:], *[f"{s}_count" for s in SHAPES])


def fingerprint_artifact(parsed_all: DataFrame, key: str = "msg_id") -> DataFrame:
    """One row with the whole fingerprint as JSON. Lists are bounded by the paths, types and segments there are."""
    good = parsed_all.filter("parse_error IS NULL")
    listed = lambda frame, by, name: frame.agg(F.sort_array(F.collect_list(F.struct(*[F.col(c) for c in [by, *[c for c in frame.columns if c != by]]]))).alias(name))
    frames = [listed(message_type_counts(good), "value", "message_types"), listed(segment_counts(good), "value", "segments"), listed(fingerprint(good, key), "path", "fields")]
    whole = reduce(lambda a, b: a.crossJoin(b), frames, totals(parsed_all))  # one row each
    return whole.select(F.to_json(F.struct("*")).alias("artifact"))


def diff(before: DataFrame, after: DataFrame, by: str, metrics: tuple[str, ...]) -> DataFrame:
    """Keys whose metrics differ: for each metric before, after and delta; a missing key counts 0."""
    a = before.select(F.col(by).alias("key_a"), *[F.col(m).alias(f"{m}_a") for m in metrics])
    b = after.select(F.col(by).alias("key_b"), *[F.col(m).alias(f"{m}_b") for m in metrics])
    joined = a.join(b, F.col("key_a").eqNullSafe(F.col("key_b")), "full")
    columns, changed = [F.coalesce("key_a", "key_b").alias(by)], F.lit(False)
    for m in metrics:
        x, y = F.coalesce(F.col(f"{m}_a"), F.lit(0)).cast("long"), F.coalesce(F.col(f"{m}_b"), F.lit(0)).cast("long")
        one = len(metrics) == 1
        columns += [x.alias("before" if one else f"{m}_before"), y.alias("after" if one else f"{m}_after"), (y - x).alias("delta" if one else f"{m}_delta")]
        changed |= x != y
    return joined.filter(changed).select(*columns)


def totals_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """metric, before, after and delta of the totals of two corpora, also where nothing changed."""
    def long(frame: DataFrame, name: str) -> DataFrame:
        each = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("long").alias(name)) for c in frame.columns])
        return frame.select(F.explode(each).alias("t")).select("t.*")

    joined = long(before, "before").join(long(after, "after"), "metric")
    return joined.select("metric", "before", "after", (F.col("after") - F.col("before")).alias("delta"))


def new_and_removed(count_diff: DataFrame, by: str = "value") -> DataFrame:
    kind = F.when((F.col("before") == 0) & (F.col("after") > 0), "new").when((F.col("before") > 0) & (F.col("after") == 0), "removed")
    return count_diff.select(F.col(by), kind.alias("kind")).filter("kind IS NOT NULL")


def issue_code_counts(validated: DataFrame) -> DataFrame:
    from ..functions.text import stable_code

    return validated.select(F.explode(F.transform("issues", lambda i: stable_code(i["code"]))).alias("code")).groupBy("code").agg(F.count("*").alias("count"))


def samples(messages: DataFrame, first_fields: int = 5, limit: int = 10, key: str = "msg_id", order: str = "ordinal") -> DataFrame:
    """Up to ``limit`` distinct raw values of each of a segment's first fields, in the order in which they are first seen.

    Values are made distinct before they are ranked, so a rank sees each value once.
    """
    rows = fields(messages.withColumn(key, F.struct(order, key)), key).filter((F.col("field_no") <= first_fields) & (F.col("raw") != "") & ~is_encoding())
    seen = rows.groupBy(field_path().alias("path"), F.col("raw").alias("value")).agg(F.min(F.struct(key, "seg_idx")).alias("first"))
    w = Window.partitionBy("path").orderBy("first", "value")
    return seen.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit).select("path", "rank", "value")


def manifest(messages: DataFrame, raw: str = "raw", key: str = "msg_id") -> DataFrame:
    """One row per message: path, message_type, sha256, bytes."""
    return messages.select(F.concat(F.lit("message_"), key, F.lit(".hl7")).alias("path"), corpus_type().alias("message_type"), sha256(F.col(raw)).alias("sha256"), F.octet_length(raw).alias("bytes"))


def ratio_count(total: int, ratio: float) -> int:
    """How many of ``total`` a ratio takes: rounded half up, within bounds."""
    if not ratio > 0:
        return 0
    return max(0, min(total, int(total * ratio + 0.5)))


def splits(manifest_rows: DataFrame, ratios: tuple[float, float, float], seed: int = 0, key: str = "path") -> DataFrame:
    """``manifest_rows`` with ``split`` (train, validation, test) of exact sizes; what rounding leaves is test.

    The order is by hash of seed and key. Ranks come from counts of hash ranges, not from one sorted task:
    only the two ranges that hold a border are ranked row by row.
    """
    total = manifest_rows.count()
    train = ratio_count(total, ratios[0])
    validation = min(ratio_count(total, ratios[1]), total - train)
    hashed = manifest_rows.withColumn("_h", F.xxhash64(F.lit(seed), key)).withColumn("_range", F.shiftright(F.col("_h"), 44))
    ranges = hashed.groupBy("_range").agg(F.count("*").alias("_n"))
    starts = ranges.select("_range", (F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_start"))  # at most 2 ** 20 rows
    at = lambda rank: F.when(rank <= train, "train").when(rank <= train + validation, "validation").otherwise("test")
    ends = starts.join(ranges, "_range").select(F.col("_range").alias("_of"), "_start", at(F.col("_start") + 1).alias("_first"), at(F.col("_start") + F.col("_n")).alias("_last"))
    placed = hashed.join(ends, F.col("_range") == F.col("_of"))
    columns = manifest_rows.columns
    whole = placed.filter("_first = _last").select(*columns, F.col("_first").alias("split"))
    rank = F.col("_start") + F.row_number().over(Window.partitionBy("_range").orderBy("_h", key))
    border = placed.filter("_first <> _last").withColumn("_rank", rank).select(*columns, at(F.col("_rank")).alias("split"))
    return whole.unionByName(border)
