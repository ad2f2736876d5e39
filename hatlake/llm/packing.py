"""Sequence packing: first-fit decreasing on a tournament tree, in randomised groups.

Every document becomes its token ids and one end id. Ids are cut at multiples of the capacity, so a
document gives full pieces and one remainder. Each piece draws a random group; a group holds about
``GROUP_PIECES`` pieces whatever the size of the corpus, and groups are packed independently. Inside
a group, pieces go by falling length to the first open sequence with room, found in O(log n) as the
leftmost leaf of a tournament tree that keeps the largest free capacity of each subtree.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import ROWS_AT_ONCE
from .common import materialise, slices, text_of
from .tokens import MEMO_PIECES, encoder_for

#: Pieces in a group on average. It bounds the memory of a task; more pieces leave less padding.
GROUP_PIECES = 8192


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The bin of each item and its offset there. Items are 1 to ``capacity`` long.

    Ties in length go by position. The leaves of the tree are bins, all of them free at first, so the
    leftmost leaf with room is an open bin or the next new one.
    """
    n = len(lengths)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if not n:
        return bins, offsets
    leaves = 1 << max(n - 1, 0).bit_length()
    free = [capacity] * (2 * leaves)
    for item in np.argsort(-lengths, kind="stable").tolist():
        need, node = int(lengths[item]), 1
        while node < leaves:
            node *= 2
            if free[node] < need:
                node += 1
        bins[item], offsets[item] = node - leaves, capacity - free[node]
        free[node] -= need
        while node > 1:
            node //= 2
            left, right = free[2 * node], free[2 * node + 1]
            top = left if left >= right else right
            if free[node] == top:
                break
            free[node] = top
    return bins, offsets


def _pieces(batches: Iterator[pa.RecordBatch], path: str, pattern: str, capacity: int, end_id: int, with_ids: bool, memo_pieces: int | None = None) -> Iterator[pa.RecordBatch]:
    encoder, end = encoder_for(path, pattern), int(end_id).to_bytes(4, "little")
    encoder.keep(MEMO_PIECES if memo_pieces is None else memo_pieces)
    for batch in slices(batches, 1, ROWS_AT_ONCE):
        rows: list[tuple] = []
        for key, ids in zip(batch.column(0).to_pylist(), encoder.encode_batch(batch.column(1).to_pylist()), strict=True):
            ids += end
            total = len(ids) // 4
            for start in range(0, total, capacity):
                piece = ids[4 * start : 4 * (start + capacity)]
                rows.append((key, start, len(piece) // 4, zlib.crc32(piece), total, piece))
        columns = list(zip(*rows, strict=True)) or [()] * 6
        out = {"id": pa.array(columns[0], batch.schema.field(0).type)}
        out |= {name: pa.array(values, pa.int64()) for name, values in zip(("start", "length", "ids_crc32", "doc_tokens"), columns[1:5], strict=True)}
        if with_ids:
            out["ids"] = pa.array([np.frombuffer(x, "<u4").astype("<i4") for x in columns[5]], pa.list_(pa.int32()))
        yield pa.record_batch(out)
    if memo_pieces is not None:
        encoder.forget()
        pa.default_memory_pool().release_unused()


def _pack_group(group: pd.DataFrame, capacity: int) -> pd.DataFrame:
    # the order of arrival must not matter, or a second try of the task could pack otherwise
    group = group.sort_values(["length", "draw"], ascending=[False, True], kind="stable", ignore_index=True)
    bins, offsets = first_fit_decreasing(group["length"].to_numpy(), capacity)
    return group.assign(sequence_id=group["group"].to_numpy() * (1 << 32) + bins, offset=offsets).drop(columns=["group", "draw"])


def pack(docs: DataFrame, path: str, pattern: str, capacity: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", group_pieces: int = GROUP_PIECES, with_ids: bool = False, seed: int = 11, memo_pieces: int | None = None) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids].

    A null or empty text is its end id alone. Repeated rows and null ids are packed like others, since
    groups are drawn at random and not by id. Other columns of ``docs`` aren't read. An empty table
    gives no rows. Offsets inside a sequence have no gaps. With ``memo_pieces`` a worker's memo has so many
    pieces in a generation and is dropped after each task; it changes memory and time, not results.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids
    job = functools.partial(_pieces, path=path, pattern=pattern, capacity=capacity, end_id=end_id, with_ids=with_ids, memo_pieces=memo_pieces)
    pieces = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).mapInArrow(job, schema)
    pieces = materialise(pieces.withColumn("draw", F.rand(seed)))
    groups = max(1, -(-pieces.count() // group_pieces))
    grouped = pieces.withColumn("group", F.least(F.floor(F.col("draw") * groups), F.lit(groups - 1)).cast("long"))
    packed = grouped.groupBy("group").applyInPandas(functools.partial(_pack_group, capacity=capacity), schema + ", sequence_id long, offset long")
    return packed.withColumnRenamed("id", id_col)


def sequences(pieces: DataFrame, capacity: int = 2048, pad_id: int = 0) -> DataFrame:
    """The packed sequences: sequence_id, ids (padded to ``capacity`` unless the length is a power of two), n_tokens.

    ``pieces`` comes from ``pack(..., with_ids=True)``. A sequence has at most ``capacity`` ids, so no
    group is large.
    """
    whole = pieces.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p")).select("sequence_id", F.flatten(F.col("p.ids")).alias("ids"))
    n = F.size("ids")
    power = (n > 0) & (n.bitwiseAND(n - 1) == 0)
    return whole.select("sequence_id", F.when(power, F.col("ids")).otherwise(F.concat("ids", F.array_repeat(F.lit(pad_id), F.lit(capacity) - n))).alias("ids"), n.cast("long").alias("n_tokens"))
