"""MLLP framing over binary columns, frame streams with state, and a TCP source and sink."""

from __future__ import annotations

import re
import socket
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

START, END = b"\x0b", b"\x1c\r"
#: Frames that grow over this are given up.
MAX_FRAME = 10 * 1024 * 1024


def wrap(payload: Column) -> Column:
    return F.concat(F.lit(START), payload.cast("binary"), F.lit(END))


def _position(data: Column) -> Column:
    """Where the first end mark begins, from 1; 0 if there is none. Bytes are read as Latin-1: one character each."""
    return F.call_function("position", F.lit("\x1c\r"), F.decode(data, "ISO-8859-1"))


def is_framed(data: Column) -> Column:
    return F.coalesce(F.substring(data, 1, 1) == F.lit(START), F.lit(False))


def frame_length(data: Column) -> Column:
    """Bytes of the first whole frame, null if there is none."""
    return F.when(is_framed(data) & (_position(data) > 0), _position(data) + 1)


def unwrap_error(data: Column) -> Column:
    return F.when(~is_framed(data), "missing start block").when(_position(data) == 0, "missing end block")


def unwrap(data: Column) -> Column:
    """The bytes of the first frame, null if there is none."""
    return F.when(unwrap_error(data).isNull(), F.call_function("substring", data, F.lit(2), _position(data) - 2))


def payload_of(data: Column) -> Column:
    """Bytes of a file that may be framed or not."""
    return F.when(is_framed(data), unwrap(data)).otherwise(data)


def frames(buffers: DataFrame, data: str = "bytes") -> DataFrame:
    """One row per whole frame of each buffer, with ``frame`` (from 0) and ``payload``; junk between frames is dropped."""
    pieces = F.split(F.decode(F.col(data), "ISO-8859-1"), "\x1c\r", -1)
    whole = F.slice(pieces, F.lit(1), F.size(pieces) - 1)
    framed = F.filter(F.transform(whole, lambda x: F.when(F.contains(x, F.lit("\x0b")), F.call_function("substring", x, F.call_function("position", F.lit("\x0b"), x) + 1, F.lit(2147483647)))), lambda x: x.isNotNull())
    return buffers.select(*[c for c in buffers.columns if c != data], F.posexplode(framed).alias("frame", "text")).withColumn("payload", F.encode("text", "ISO-8859-1")).drop("text")


def read_files(spark, path: str) -> DataFrame:
    """Every regular file below ``path``: msg_id (relative path), bytes, raw (unframed), framing_error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    root = F.lit("/" + re.sub(r"^[a-z]+:/*", "", path).strip("/") + "/")
    whole = F.regexp_replace("path", r"^[a-z]+:/*", "/")
    # a pattern, or a folder given by its place in the working folder, isn't a beginning: then the whole path stays
    relative = F.when(F.startswith(whole, root), F.call_function("substring", whole, F.length(root) + 1, F.lit(2147483647))).otherwise(whole)
    named = files.select(relative.alias("msg_id"), F.col("content").alias("bytes"))
    error = F.when(is_framed(F.col("bytes")), unwrap_error(F.col("bytes")))
    return named.select("msg_id", "bytes", payload_of(F.col("bytes")).alias("raw"), error.alias("framing_error"))


def take_frames(buffer: bytes, limit: int = MAX_FRAME) -> tuple[list[bytes | None], bytes]:
    """Whole frames of a buffer and what is left. Bytes before a start mark are junk; a frame over the limit is None."""
    found = []
    while True:
        at = buffer.find(START)
        if at < 0:
            return found, b""
        end = buffer.find(END, at + 1)
        if end < 0:
            rest = buffer[at:]
            return (found, rest) if len(rest) <= limit else ([*found, None], b"")
        found.append(buffer[at + 1 : end] if end - at - 1 <= limit else None)
        buffer = buffer[end + 2 :]


def _reassemble(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    buffer, number = state.get if state.exists else (b"", 0)
    rows = []
    for chunk in sorted((row for batch in batches for row in zip(batch["seq"], batch["bytes"], strict=True)), key=lambda x: x[0]):
        done, buffer = take_frames(bytes(buffer) + bytes(chunk[1]))
        rows += done
    state.update((buffer, number + len(rows)))
    errors = ["frame_too_long" if row is None else None for row in rows]
    yield pd.DataFrame({"connection": [key[0]] * len(rows), "frame": range(number, number + len(rows)), "payload": rows, "error": errors})


def stream_frames(chunks: DataFrame) -> DataFrame:
    """Frames of byte chunks (connection, seq, bytes) that arrive in any cut; what is unfinished waits in the state.

    A frame that grows over MAX_FRAME is a row without payload and with the error ``frame_too_long``.
    """
    return chunks.groupBy("connection").applyInPandasWithState(_reassemble, "connection string, frame long, payload binary, error string", "buffer binary, frames long", "append", GroupStateTimeout.NoTimeout)


class MllpSource(DataSource):
    """``spark.readStream.format("mllp").option("host", ...).option("port", ...)``: raw chunks of one connection.

    One socket is read on the driver: a feed of several hosts is a stream for each, united. What was received and
    not yet committed is kept in memory, so a batch can be read again, but not after the driver is lost.
    """

    @classmethod
    def name(cls) -> str:
        return "mllp"

    def schema(self) -> str:
        return "connection string, seq long, bytes binary"

    def simpleStreamReader(self, schema):  # noqa: N802
        return MllpReader(self.options)


class MllpReader(SimpleDataSourceStreamReader):
    """Takes what has arrived in each trigger; chunks are kept so that a failed batch is read again."""

    def __init__(self, options):
        self.address = (options.get("host", "localhost"), int(options["port"]))
        self.limit, self.wait = int(options.get("maxBytesPerTrigger", 1 << 20)), float(options.get("timeout", 0.2))
        self.kept: list[tuple[int, bytes]] = []
        self.socket = None

    def initialOffset(self) -> dict:  # noqa: N802
        return {"seq": 0}

    def _receive(self) -> bytes:
        """What has arrived; nothing if the peer is silent or away. A closed connection is opened again later."""
        try:
            if self.socket is None:
                self.socket = socket.create_connection(self.address, timeout=self.wait)
            data = self.socket.recv(65536)
        except TimeoutError:
            return b""
        except OSError:
            data = b""
        if not data and self.socket is not None:
            self.socket.close()
            self.socket = None
        return data

    def read(self, start: dict):
        seq, taken = start["seq"], 0
        while taken < self.limit:
            data = self._receive()
            if not data:
                break
            self.kept.append((seq, data))
            seq, taken = seq + 1, taken + len(data)
        return iter([(f"{self.address[0]}:{self.address[1]}", s, d) for s, d in self.kept if start["seq"] <= s < seq]), {"seq": seq}

    def readBetweenOffsets(self, start: dict, end: dict):  # noqa: N802
        return iter([(f"{self.address[0]}:{self.address[1]}", s, d) for s, d in self.kept if start["seq"] <= s < end["seq"]])

    def commit(self, end: dict) -> None:
        self.kept = [(s, d) for s, d in self.kept if s >= end["seq"]]


def send(messages: DataFrame, host: str, port: int, payload: str = "raw", timeout: float = 10.0, await_ack: bool = True) -> None:
    """Send each row as a frame, one connection for each partition, and wait for its acknowledgement."""

    def deliver(rows) -> None:
        connection, buffer = None, b""
        for row in rows:
            if connection is None:
                connection = socket.create_connection((host, port), timeout=timeout)
            data = row[payload]
            connection.sendall(START + (data.encode() if isinstance(data, str) else bytes(data)) + END)
            while await_ack:
                done, buffer = take_frames(buffer)
                if done:
                    if done[0] is None:
                        raise ValueError("the acknowledgement is too long")
                    break
                more = connection.recv(65536)
                if not more:
                    raise ConnectionError("closed before the acknowledgement")
                buffer += more
        if connection is not None:
            connection.close()

    messages.select(payload).foreachPartition(deliver)
