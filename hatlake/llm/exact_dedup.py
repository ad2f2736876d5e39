"""Exact dedup by content sort.

Texts are normalised (each run of white space becomes one space), range-partitioned by sampled
splitters over (head of the text, hash, id), sorted externally inside each partition, and neighbours are compared in
full. A group of any size spreads over as many partitions as its rows need, because the id is part
of the sort key; the runs that touch a partition's edge (two for each partition at most) are joined
up by SHA-256 in a second, small aggregation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, materialise, text_of

#: Characters of a normalised text in a splitter. The driver gets the sampled splitters, so they must be short.
HEAD_CHARS = 32

RUNS = "id long, sha string, local_keep long, local_size long, first_row boolean, edge boolean, part int"


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of each run of equal neighbours. Holds the current text and the ids of its run only."""
    part = TaskContext.get().partitionId()
    schema = pa.schema([("id", pa.int64()), ("sha", pa.string()), ("local_keep", pa.int64()), ("local_size", pa.int64()), ("first_row", pa.bool_()), ("edge", pa.bool_()), ("part", pa.int32())])
    out: dict[str, list] = {name: [] for name in schema.names}
    current: str | None = None
    ids: list[int | None] = []
    is_first_run = True

    def close(edge: bool) -> None:
        sha = hashlib.sha256(current.encode("utf-8", "surrogatepass")).hexdigest()
        n = len(ids)
        out["id"] += ids
        out["sha"] += [sha] * n
        out["local_keep"] += [ids[0]] * n
        out["local_size"] += [n] * n
        out["first_row"] += [True] + [False] * (n - 1)
        out["edge"] += [edge] * n
        out["part"] += [part] * n

    def flush() -> pa.RecordBatch:
        batch = pa.record_batch([pa.array(out[f.name], f.type) for f in schema], schema=schema)
        for values in out.values():
            values.clear()
        return batch

    for batch in batches:
        if not batch.num_rows:
            continue
        texts, these = batch.column(0), batch.column(1).to_pylist()
        same = [False, *pc.equal(texts.slice(1), texts.slice(0, len(texts) - 1)).to_pylist()]
        same[0] = current is not None and texts[0].as_py() == current
        for i, equal in enumerate(same):
            if not equal:
                if current is not None:
                    close(is_first_run)
                    is_first_run = False
                current, ids = texts[i].as_py(), []
            ids.append(these[i])
        if len(out["id"]) >= 8192:
            yield flush()
    if current is not None:
        close(True)
    if out["id"]:
        yield flush()


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Null texts count as empty. The smallest id of a group stays; null ids sort after all others, so
    a group of null ids only has a null ``keep_id``. Of rows that repeat the smallest id exactly one
    is kept. Other columns of ``docs`` are not read. An empty table gives no rows.
    """
    spark = docs.sparkSession
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    keyed = docs.select(
        F.regexp_replace(text_of(text_col), f"{SPACE_CLASS}+", " ").alias("norm"),
        F.col(id_col).cast("long").alias("id"),
    ).withColumns({"head": F.substring("norm", 1, HEAD_CHARS), "tie": F.xxhash64("norm")})
    # Equal texts have equal heads and ties, so they stay adjacent; the sampled splitters are short whatever the texts are.
    by_head, by_id = [F.col("head").asc(), F.col("tie").asc()], F.col("id").asc_nulls_last()
    dealt = keyed.repartitionByRange(n, *by_head, by_id).sortWithinPartitions(*by_head, F.col("norm").asc(), by_id)
    rows = materialise(dealt.select("norm", "id").mapInArrow(_runs, RUNS))

    # Edge runs: at most two for each partition, so this table is bounded by the number of partitions.
    first = F.struct(F.col("id").isNull().alias("none"), "id", "part")
    edges = (
        rows.filter("edge and first_row")
        .groupBy(F.col("sha").alias("edge_sha"))
        .agg(F.min(first).alias("win"), F.sum("local_size").alias("size"))
    )
    joined = rows.join(F.broadcast(edges), F.col("edge") & (F.col("sha") == F.col("edge_sha")), "left")
    stitched = F.col("edge_sha").isNotNull()
    return joined.select(
        F.col("id").alias(id_col),
        F.when(stitched, F.col("win.id")).otherwise(F.col("local_keep")).alias("keep_id"),
        F.when(stitched, F.col("size")).otherwise(F.col("local_size")).alias("group_size"),
        (F.col("first_row") & (~stitched | (F.col("win.part") == F.col("part")))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
