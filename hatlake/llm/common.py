"""Shared plumbing: checkpoints, reading tables, and text columns free of nulls."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a worker takes at once; bounds memory, not results.
SLICE_BYTES = 8 << 20
#: Bytes of an Arrow batch in the pipeline, whose stages share the executors' memory; a longer row goes alone.
BATCH_BYTES = 4 << 20
#: The white space of every contract here, as a Java and a Python character class.
SPACE_CLASS = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text column as string, null read as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once for each Spark context, so that their Python can import it."""
    context = spark.sparkContext
    if getattr(context, "_hatlake_shipped", False):
        return
    root = Path(__file__).resolve().parents[2]
    archive = Path(tempfile.mkdtemp(prefix="hatlake-")) / "hatlake.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for source in sorted((root / "hatlake").rglob("*.py")):
            out.write(source, source.relative_to(root))
    context.addPyFile(str(archive))
    context._hatlake_shipped = True


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder: the session's own setting if it has one.

    Only where ``spark.checkpoint.dir`` is unset and the master is local (tests) a temporary folder is set;
    on a cluster a machine's own folder would lose data, so there it is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if configured:
        if current is None:
            context.setCheckpointDir(configured)
        return configured
    if current is None:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="hatlake-checkpoint-"))
        current = context.getCheckpointDir()
    return current


def materialise(df: DataFrame) -> DataFrame:
    """Reliably checkpoint ``df``: it is computed once, and lost executors don't change it."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def small_batches(spark: SparkSession, n_bytes: int = BATCH_BYTES) -> Iterator[None]:
    """What is run inside sends Python workers Arrow batches of about ``n_bytes`` at most; then the session's setting is back."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(n_bytes))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder, for tables that are written and read back."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def slices(batches: Iterator[pa.RecordBatch], column: int, rows: int, n_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``rows`` rows, whose texts have at most ``n_bytes`` bytes (or are a single one)."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        at = 0
        while at < batch.num_rows:
            upto = np.cumsum(sizes[at : at + rows], dtype=np.int64)
            n = max(1, int(np.searchsorted(upto, n_bytes, side="right")))
            yield batch.slice(at, n)
            at += n


def partitions_for(spark: SparkSession, n_bytes: int, target_bytes: int) -> int:
    """How many partitions of about ``target_bytes`` hold ``n_bytes``, and at least one for each core."""
    return max(spark.sparkContext.defaultParallelism, -(-int(n_bytes) // target_bytes), 1)
