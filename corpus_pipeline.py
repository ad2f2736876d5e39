"""The corpus pipeline: quality rules, line dedup, near-duplicate removal, packing.

``STAGES`` lists the stages in order. Each takes (spark, docs, sf_dir) and returns a DataFrame; all but
the last return the columns of ``documents``. Between stages the rows are written as Parquet and read
again, so a lost executor never costs more than its own stage.
"""

from __future__ import annotations

import public_tokenizers as vocabularies
from pyspark.sql import DataFrame, SparkSession

from hatlake.llm.common import delete_path, shared_path, ship_package, small_batches, table
from hatlake.llm.line_dedup import drop_boilerplate
from hatlake.llm.near_dedup import near_dedup
from hatlake.llm.packing import pack
from hatlake.llm.quality import quality_filter

#: Pieces in a generation of a packing worker's memo. Spark keeps the workers while the next stages run.
MEMO_PIECES = 100_000

#: Near-duplicate classes and token ids aren't for SQL; tests hold the pipeline against a plain version.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the adaptive fences reject go.

    Null and empty texts have no ten words and go; null languages and sources are cohorts of their own; repeated
    rows are judged alike; a very long text is one row like others. Other columns pass, whatever their names. No rows give none.
    """
    ship_package(spark)
    return quality_filter(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand on many sites go, but for their first document.

    All rows stay: a text may become empty, and a null one stays null. Repeated rows lose the same lines; of equal
    first ids all rows keep theirs. A very long text is cut by slices. Other columns pass; ``n_chars`` follows the text.
    """
    ship_package(spark)
    return drop_boilerplate(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays: that with the least id, null ids last.

    Null and empty texts are one class. Repeated rows leave one. A very long text is hashed whole by one task.
    Other columns pass, whatever their names.
    """
    ship_package(spark)
    with small_batches(spark):
        return near_dedup(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document is tokenised and packed into sequences of 2048.

    A null or empty text is its end id alone; a very long one gives full pieces and a rest. Repeated rows are packed
    each. Other columns aren't read.
    """
    ship_package(spark)
    with small_batches(spark):
        return pack(docs, vocabularies.path("byte_bpe_50k.json"), vocabularies.PATTERN, memo_pieces=MEMO_PIECES)


STAGES = [("quality_rules", quality_stage), ("line_dedup", line_stage), ("near_dedup", near_stage), ("packing", packing_stage)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the result of the last."""
    docs = table(spark, sf_dir, "documents")
    home = shared_path(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{home}/{name}")
        docs = spark.read.parquet(f"{home}/{name}")
    out = STAGES[-1][1](spark, docs, sf_dir)  # packing has checkpointed its pieces
    delete_path(spark, home)
    return out
