"""Token-count rollups that are maintained by signed deltas.

A store is a folder of committed batches. A batch holds the signed rows it caused (a document and a
tokenizer version, -1 or +1 documents, the tokens taken away or added) and the sums of these rows by
source, language and version. Totals are the sums of the batches' sums, so neither a commit nor a
report reads documents again. A batch is written aside and then renamed into place: it is there whole or
not at all, and a batch identifier that is there already is not applied again.

Rows lie in folders by a hash of the document's id. A commit reads the folders that its own ids fall into,
and after every ``COMPACT_EVERY`` batches their rows are folded into one snapshot, so a small batch costs
about its share of the ledger and not the store's history.

One writer at a time: a commit holds the file ``lock`` of the store, which it creates and which another
commit is refused for. A writer that was killed leaves it there; ``unlock`` takes it away. Renaming
a folder is atomic on file systems such as HDFS; on an object store without such a rename use a committer that has one.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise

CHANGES = "op string, id long, source string, lang string, version string, n_tokens long"
GROUP = ["source", "lang", "version"]
ROWS = "id long, source string, lang string, version string, docs long, tokens long, bucket int"
SUMS = "source string, lang string, version string, docs long, tokens long"
#: Folders that rows are dealt into; a store's own number is fixed when it is made.
BUCKETS = 16
#: Rows of a folder that a store is made for.
BUCKET_ROWS = 4_000_000
#: Batches that are folded into one snapshot.
COMPACT_EVERY = 16


class RollupStore:
    """``buckets`` counts when the store is made; later it is read from the store."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        made = [n for n in self._list("buckets") if n.isdigit()]
        if not made:
            self._fs.mkdirs(self._path(f"{self.path}/buckets/{buckets}"))
        self.buckets = int(made[0]) if made else buckets

    def _list(self, folder: str) -> list[str]:
        root = self._path(f"{self.path}/{folder}")
        return sorted(f.getPath().getName() for f in self._fs.listStatus(root)) if self._fs.exists(root) else []

    def batches(self) -> list[str]:
        return self._list("batches")

    def _parts(self) -> list[str]:
        """The newest snapshot, if there is one, and the batches that it doesn't hold."""
        batches, snapshots = self.batches(), self._list("snapshots")
        if not snapshots:
            return [f"{self.path}/batches/{b}" for b in batches]
        newest = max(snapshots, key=lambda name: int(name.split("-")[0]))
        held = {r[0] for r in self.spark.read.schema("batch string").parquet(f"{self.path}/snapshots/{newest}/holds").collect()}  # names only
        return [f"{self.path}/snapshots/{newest}"] + [f"{self.path}/batches/{b}" for b in batches if b not in held]

    def _read(self, part: str, schema: str) -> DataFrame:
        # Each part has a base path of its own, so that its folders are read as the column ``bucket``.
        out = self.spark.createDataFrame([], schema)
        for path in self._parts():
            out = out.unionByName(self.spark.read.schema(schema).parquet(f"{path}/{part}"))
        return out

    def bucket_of(self, id_col: str = "id") -> Column:
        return F.pmod(F.xxhash64(id_col), F.lit(self.buckets)).cast("int")

    def ledger(self, buckets: list[int] | None = None) -> DataFrame:
        """The present count of each document and version: id, source, lang, version, docs, n_tokens; of some buckets or all.

        ``docs`` is 1, but for documents without an id, which are counted together.
        """
        rows = self._read("rows", ROWS)
        if buckets is not None:
            rows = rows.filter(F.col("bucket").isin(buckets))
        return rows.groupBy("id", *GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("n_tokens")).filter("docs > 0")

    def unlock(self) -> None:
        """Take away the lock of a writer that is known to be dead, and what it wrote aside."""
        self._fs.delete(self._path(f"{self.path}/aside"), True)
        self._fs.delete(self._path(f"{self.path}/lock"), False)

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Apply a batch of changes (see ``CHANGES``) once. False if it was applied before.

        ``insert`` and ``revise`` set the count of a document and version: what the ledger has is taken
        away, the new count is added. A null source or language keeps the old one. ``delete`` takes the
        count away; a null version deletes all versions; deleting what isn't there does nothing. Of
        several changes of a batch to one document and version a delete wins, else the largest count.
        Every inserted row with a null id is a document of its own, which can't be named later: a null id in
        other changes is refused, as is an unknown ``op``. Null counts are 0. An empty batch is committed.
        """
        if not re.fullmatch(r"[\w.-]+", batch):
            raise ValueError("a batch identifier has letters, digits, '_', '.' and '-' only")
        if batch in self.batches():
            return False
        lock = self._path(f"{self.path}/lock")
        if not self._fs.createNewFile(lock):
            raise RuntimeError(f"another writer holds {lock}")
        try:
            return self._commit(batch, changes)
        finally:
            self._fs.delete(lock, False)

    def _commit(self, batch: str, changes: DataFrame) -> bool:
        known = F.when(F.col("op").isin("insert", "revise", "delete"), F.col("op")).otherwise(F.raise_error(F.concat(F.lit("unknown op: "), F.coalesce("op", F.lit("null")))))
        op = F.when(F.col("id").isNotNull() | (F.col("op") == "insert"), known).otherwise(F.raise_error(F.lit("a null id can only be inserted")))
        wide = changes.select(op.alias("op"), F.col("id").cast("long").alias("id"), *[F.col(c).cast("string").alias(c) for c in GROUP], F.coalesce(F.col("n_tokens").cast("long"), F.lit(0)).alias("n_tokens"))
        wide = materialise(wide)
        nameless = wide.filter("id IS NULL").select("id", *GROUP, F.lit(1).cast("long").alias("docs"), F.col("n_tokens").alias("tokens"))
        wide = wide.filter("id IS NOT NULL")
        touched = [r[0] for r in wide.select(self.bucket_of().alias("b")).distinct().collect()]  # at most ``buckets`` numbers
        old = self.ledger(touched).filter("id IS NOT NULL").select(F.col("id").alias("old_id"), *[F.col(c).alias(f"old_{c}") for c in GROUP], F.col("n_tokens").alias("old_tokens"))
        same_id = F.col("id") == F.col("old_id")
        # A delete of all versions becomes one for each version that the ledger has.
        every = wide.filter("op = 'delete' AND version IS NULL").join(old, same_id).select("op", "id", F.col("old_source").alias("source"), F.col("old_lang").alias("lang"), F.col("old_version").alias("version"), "n_tokens")
        named = wide.filter("op <> 'delete' OR version IS NOT NULL").unionByName(every)
        rank = F.struct((F.col("op") == "delete").alias("delete"), "n_tokens", F.col("source").alias("source"), F.col("lang").alias("lang"))
        last = named.groupBy("id", "version").agg(F.max(rank).alias("c")).select("id", "version", "c.*")
        joined = materialise(last.join(old, same_id & F.col("version").eqNullSafe(F.col("old_version")), "left"))
        minus = joined.filter("old_tokens IS NOT NULL").select("id", F.col("old_source").alias("source"), F.col("old_lang").alias("lang"), "version", F.lit(-1).cast("long").alias("docs"), (-F.col("old_tokens")).alias("tokens"))
        plus = joined.filter("NOT delete").select("id", F.coalesce("source", "old_source").alias("source"), F.coalesce("lang", "old_lang").alias("lang"), "version", F.lit(1).cast("long").alias("docs"), F.col("n_tokens").alias("tokens"))
        # Documents without an id are told apart by nothing: they are summed before they are dealt into a folder.
        nameless = nameless.groupBy("id", *GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        aside = f"{self.path}/aside/{uuid.uuid4().hex}"
        self._write(minus.unionByName(plus).unionByName(nameless), aside)
        if not self._publish(aside, f"batches/{batch}"):
            return False
        if len(self.batches()) % COMPACT_EVERY == 0:
            self._compact()
        return True

    def _write(self, rows: DataFrame, aside: str) -> None:
        dealt = rows.withColumn("bucket", self.bucket_of())
        dealt.repartition(self.buckets, "bucket").write.partitionBy("bucket").parquet(f"{aside}/rows")
        self.spark.read.schema(ROWS).parquet(f"{aside}/rows").groupBy(*GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).write.parquet(f"{aside}/sums")

    def _publish(self, aside: str, name: str) -> bool:
        target = self._path(f"{self.path}/{name}")
        self._fs.mkdirs(target.getParent())
        if self._fs.exists(target) or not self._fs.rename(self._path(aside), target):
            self._fs.delete(self._path(aside), True)
            return False
        return True

    def _compact(self) -> None:
        """Fold all committed rows into a snapshot; the batches stay, as names that were applied."""
        batches, older = self.batches(), self._list("snapshots")
        aside = f"{self.path}/aside/{uuid.uuid4().hex}"
        self._write(self.ledger().withColumnRenamed("n_tokens", "tokens"), aside)
        self.spark.createDataFrame([(b,) for b in batches], "batch string").coalesce(1).write.parquet(f"{aside}/holds")
        if self._publish(aside, f"snapshots/{len(batches)}-{uuid.uuid4().hex}"):
            for name in older:
                self._fs.delete(self._path(f"{self.path}/snapshots/{name}"), True)

    def totals(self) -> DataFrame:
        """source, lang, tokenizer_version, n_docs, n_tokens; groups without documents are left out."""
        sums = self._read("sums", SUMS)
        totals = sums.groupBy(*GROUP).agg(F.sum("docs").alias("n_docs"), F.sum("tokens").alias("n_tokens"))
        return totals.filter("n_docs <> 0 OR n_tokens <> 0").withColumnRenamed("version", "tokenizer_version")


def token_rollup(docs: DataFrame, path: str, vocabulary: str, pattern: str, version: str, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", put_back: bool = False) -> DataFrame:
    """The totals of a store that went through a life: loaded, revised, thinned out, and replayed.

    ``load`` inserts every document with a provisional count (a quarter of its bytes), ``exact`` revises
    all of them to their counts under the vocabulary, ``copies`` deletes all but one of the documents of
    each text, and replaying ``exact`` changes nothing. With ``put_back`` a last batch inserts the deleted
    documents again, so the totals are those of all rows. Null texts are empty. Each row has a key of its
    own in the store, also rows that repeat an id or have none. A very long text is counted whole by one
    task; columns with other names aren't read. An empty table gives no rows.
    """
    from .bpe import encode

    spark = docs.sparkSession
    store = RollupStore(spark, path, max(BUCKETS, docs.count() // BUCKET_ROWS))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    shown = [F.col(id_col).cast("long").alias("doc"), F.col(source_col).cast("string").alias("source"), F.col(lang_col).cast("string").alias("lang"), text.alias("text")]
    # Rows that are equal have the same key at first; each of them is then numbered and gets one of its own.
    keyed = docs.select(*shown).select(F.xxhash64(F.to_json(F.struct("doc", "source", "lang")), "text").alias("id"), "source", "lang", "text")
    own = F.when(F.col("copy") == 1, F.col("id")).otherwise(F.xxhash64("id", "copy"))

    def each_row(rows: DataFrame, *columns: str) -> DataFrame:
        counted = rows.groupBy("id").agg(F.count("*").alias("n"), *[F.first(c).alias(c) for c in columns])
        return counted.select("id", *columns, F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("copy")).select(own.alias("id"), *columns)

    nothing = F.lit(None).cast("string")
    loaded = materialise(each_row(keyed.select("id", "source", "lang", F.expr("octet_length(text) div 4").alias("n_tokens"), F.sha2("text", 256).alias("sha")), "source", "lang", "n_tokens", "sha"))
    store.commit("0001-load", loaded.select(F.lit("insert").alias("op"), "id", "source", "lang", F.lit(version).alias("version"), "n_tokens"))
    counted = each_row(encode(keyed.select("id", "text"), vocabulary, pattern, id_col="id", ids=False).select("id", "n_tokens"), "n_tokens")
    exact = materialise(counted.select(F.lit("revise").alias("op"), "id", nothing.alias("source"), nothing.alias("lang"), F.lit(version).alias("version"), "n_tokens"))
    store.commit("0002-exact", exact)
    first = loaded.groupBy(F.col("sha").alias("of_sha")).agg(F.min("id").alias("first_id"), F.count("*").alias("n")).filter("n > 1")
    copies = materialise(loaded.join(materialise(first), F.col("sha") == F.col("of_sha")).filter("id <> first_id").select("id", "source", "lang"))
    store.commit("0003-copies", copies.select(F.lit("delete").alias("op"), "id", nothing.alias("source"), nothing.alias("lang"), nothing.alias("version"), F.lit(0).alias("n_tokens")))
    store.commit("0002-exact", exact)
    if put_back:
        again = copies.join(exact.select("id", "version", "n_tokens"), "id")
        store.commit("0004-back", again.select(F.lit("insert").alias("op"), "id", "source", "lang", "version", "n_tokens"))
    return store.totals()
