"""Byte-level BPE encoding and decoding as DataFrame operators over Arrow batches."""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, text_of
from .tokens import encoder_for

#: Rows encoded at once inside a worker; bounds memory, not results.
ROWS_AT_ONCE = 512


def _encode(batches, path, pattern, with_ids, with_offsets, with_digests):
    encoder = encoder_for(path, pattern)
    for batch in slices(batches, 1, ROWS_AT_ONCE):
        encoded = encoder.encode_batch(batch.column(1).to_pylist())
        columns = {"id": batch.column(0), "n_tokens": pa.array([len(x) // 4 for x in encoded], pa.int64())}
        if with_ids:
            columns["ids"] = pa.array([np.frombuffer(x, "<u4").astype("<i4") for x in encoded], pa.list_(pa.int32()))
        if with_offsets:
            spans = [encoder.offsets(x) for x in encoded]
            columns["char_start"] = pa.array([[s for s, _ in x] for x in spans], pa.list_(pa.int32()))
            columns["char_end"] = pa.array([[e for _, e in x] for x in spans], pa.list_(pa.int32()))
        if with_digests:
            columns["ids_sha256"] = pa.array([hashlib.sha256(x).hexdigest() for x in encoded], pa.string())
            columns["decoded_sha256"] = pa.array([hashlib.sha256(encoder.decode_bytes(x)).hexdigest() for x in encoded], pa.string())
        yield pa.record_batch(columns)


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = True, offsets: bool = False, digests: bool = False) -> DataFrame:
    """Encode every whole text: id, n_tokens, and what is asked for.

    ``ids``: array of token ids. ``offsets``: for each token the characters it touches (char_start,
    char_end). ``digests``: SHA-256 of the ids (little-endian unsigned 32-bit) and of the decoded
    bytes. Null texts count as empty and have no tokens; repeated rows and null ids are kept.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_tokens long"
    schema += ", ids array<int>" * ids + ", char_start array<int>, char_end array<int>" * offsets + ", ids_sha256 string, decoded_sha256 string" * digests
    job = functools.partial(_encode, path=path, pattern=pattern, with_ids=ids, with_offsets=offsets, with_digests=digests)
    return docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).mapInArrow(job, schema).withColumnRenamed("id", id_col)


def _decode(batches, path, pattern):
    encoder = encoder_for(path, pattern)
    for batch in batches:
        raw = [encoder.decode_bytes(np.array(x or [], dtype="<u4").tobytes()) for x in batch.column(1).to_pylist()]
        yield pa.record_batch({"id": batch.column(0), "bytes": pa.array(raw, pa.binary()), "text": pa.array([x.decode("utf-8", "replace") for x in raw], pa.string())})


def decode(tokens: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Decode arrays of ids: id, bytes, text. Null ids decode to nothing; bytes that aren't UTF-8 show as U+FFFD in text."""
    kind = tokens.schema[id_col].dataType.simpleString()
    job = functools.partial(_decode, path=path, pattern=pattern)
    return tokens.select(F.col(id_col).alias("id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(job, f"id {kind}, bytes binary, text string").withColumnRenamed("id", id_col)
