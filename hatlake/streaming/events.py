"""Event views of messages and event-time aggregates, for batch and for Structured Streaming alike."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.temporal import parse_ts
from ..operators.parse import corpus_type
from ..plans.paths import Message, parse_path

#: Messages over this many bytes give an error event only.
MAX_MESSAGE = 1024 * 1024


def events(messages: DataFrame, key: str = "msg_id", raw: str = "raw", max_bytes: int = MAX_MESSAGE) -> DataFrame:
    """key, seq, event, seg_id, field_num, value: start, segment, field and end events in order.

    An MSH line gives no segment event, and its fields are numbered from an empty first one, so MSH-3 is
    number 2. Row-local: works on a stream without state.
    """
    text = F.col(raw).cast("string")
    mark = F.substring(text, 4, 1)
    kind = "struct<event:string,seg_id:string,field_num:int,value:string>"
    make = lambda event, seg=None, num=None, value=None: F.struct(F.lit(event).alias("event"), (seg if seg is not None else F.lit(None)).cast("string").alias("seg_id"),
        (num if num is not None else F.lit(None)).cast("int").alias("field_num"), (value if value is not None else F.lit(None)).cast("string").alias("value"))
    cut = lambda line: F.split(line, F.concat(F.lit("\\Q"), mark, F.lit("\\E")), -1)

    def of_line(line):
        seg = F.substring(line, 1, 3)
        msh = F.transform(cut(F.substring(line, 9, 2147483647)), lambda v, i: make("field", seg, i + 1, v))
        other = F.transform(F.slice(cut(line), F.lit(2), F.greatest(F.size(cut(line)) - 1, F.lit(0))), lambda v, i: make("field", seg, i + 1, v))
        return F.when(seg == "MSH", F.concat(F.array(make("start_message")), msh)).otherwise(F.concat(F.array(make("segment", seg)), other))

    lines = F.filter(F.split(text, "\r", -1), lambda x: x != "")
    all_events = F.concat(F.flatten(F.transform(lines, of_line)), F.array(make("end_message")))
    chosen = F.when(F.octet_length(text) > max_bytes, F.array(make("error", value=F.lit("message too large")))).otherwise(all_events).cast(f"array<{kind}>")
    return messages.select(key, F.posexplode(chosen).alias("seq", "e")).select(key, "seq", "e.*")


def with_event_time(parsed: DataFrame) -> DataFrame:
    """Parsed messages with ``event_time`` from MSH-7 and ``message_type``."""
    return parsed.select("*", parse_ts(Message().get(parse_path("MSH.7")))["ts"].alias("event_time"), corpus_type().alias("message_type"))


def windowed_counts(timed: DataFrame, window: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Messages by window of event time and type; rows later than ``late`` are dropped on a stream."""
    w = F.window("event_time", window, slide) if slide else F.window("event_time", window)
    counted = timed.withWatermark("event_time", late).groupBy(w.alias("w"), "message_type").agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "message_type", "n")


def session_counts(timed: DataFrame, by: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    counted = timed.withWatermark("event_time", late).groupBy(F.session_window("event_time", gap).alias("w"), by).agg(F.count("*").alias("n"))
    return counted.select(by, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def _guard(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    n, mean, m2 = state.get if state.exists else (0, 0.0, 0.0)
    rows = []
    for row in sorted((r for b in batches for r in zip(b["ordinal"], b["length"], strict=True)), key=lambda r: r[0]):
        std = (m2 / (n - 1)) ** 0.5 if n > 1 else 0.0
        score = min(abs(row[1] - mean) / std / 10, 1.0) if n >= 100 and std > 0 else 0.0
        rows.append((key[0], row[0], score))
        n += 1
        delta = row[1] - mean
        mean += delta / n
        m2 += delta * (row[1] - mean)
    state.update((n, mean, m2))
    yield pd.DataFrame(rows, columns=["source", "ordinal", "guard_score"])


def stream_guard(lengths: DataFrame) -> DataFrame:
    """The length guard on a stream of (source, ordinal, length): one running state for each source."""
    return lengths.groupBy("source").applyInPandasWithState(_guard, "source string, ordinal long, guard_score double", "n long, mean double, m2 double", "append", GroupStateTimeout.NoTimeout)
