"""A hashed maximum-entropy language model with a class-factored softmax.

P(word | history) = P(upper class | history) * P(class | upper class, history) * P(word | class). The
first two are softmaxes of 32 outputs or more over hashed features of the history: the word before, the
word before that (a skip feature) and the pair of their classes. The most frequent words are classes of
their own; other words share a class by their last two bytes, and within a class a word has its
smoothed relative frequency, with a share for unknown words.

Counting, training and scoring read every document. Words are counted by 64-bit hash: documents are
dealt into blocks, each block's distinct words go as packed arrays to the bucket of their hash, are
summed there over all blocks, and the sums go back to the blocks that need them. So no task or driver
ever holds the vocabulary. Classes, words with a class of their own and weight rows grow with the
training tokens (``Shape``); tasks descend on their own documents from the
same weights, and their weights are averaged (distributed gradient updates in rounds).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, materialise, partitions_for, slices, text_of
from .hashing import U, mix, words_of

#: The least outputs of the two softmaxes, and the least rows of each of the two weight tables as a power of 2.
UPPER, LOWER = 32, 32
CLASSES = UPPER * LOWER
FEATURE_BITS = 14
#: Rows of weights that travel together.
PIECE_ROWS = 128
#: Bytes of text in a block, and in a training task.
BLOCK_BYTES, TRAIN_BYTES = 24 << 20, 96 << 20
ROUNDS, RATE = 2, 0.15
ROWS_AT_ONCE = 64
#: Tokens of a gradient step at most.
STEP_TOKENS = 1 << 15
#: A hash that stands for the end of a text, and the suffix that it has instead of two bytes.
END_HASH, END_SUFFIX = U(0xE4D0FA7E87F3C219), 1 << 16


class Shape(NamedTuple):
    """The size of a model: outputs of the softmaxes and bits of a weight row's number."""

    upper: int = UPPER
    lower: int = LOWER
    bits: int = FEATURE_BITS

    @classmethod
    def of(cls, tokens: int) -> Shape:
        """Own words grow with the fourth root of the training tokens, weight rows with the square root, without an upper limit."""
        upper, lower = UPPER, LOWER
        while upper * lower // 2 < 4 * tokens**0.25:
            upper, lower = (upper * 2, lower) if upper == lower else (upper, lower * 2)
        return cls(upper, lower, max(FEATURE_BITS, math.ceil(math.log2(max(tokens, 1)) / 2)))

    @property
    def classes(self) -> int:
        return self.upper * self.lower

    @property
    def top_words(self) -> int:
        """Words that are classes of their own: half of all classes."""
        return self.classes // 2

    def suffix_class(self, suffix: np.ndarray) -> np.ndarray:
        """The class of a word that has none of its own; the last class is the end of a text."""
        others = self.classes - self.top_words - 1
        return np.where(suffix == END_SUFFIX, self.classes - 1, self.top_words + (mix(suffix.astype(U)) % U(others)).astype(np.int32)).astype(np.int32)


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def tokens_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, word hash and suffix (the last two bytes) of every token, an end after each text's words."""
    owner, words, last = words_of(texts, _LOWER)
    n = len(texts)
    counts = np.bincount(owner, minlength=n) if len(owner) else np.zeros(n, np.int64)
    at = np.arange(len(words)) + owner  # each text before this one has an end
    ends = np.cumsum(counts + 1) - 1
    total = len(words) + n
    out_owner, out_hash, out_suffix = np.empty(total, np.int64), np.empty(total, U), np.empty(total, np.int32)
    out_owner[at], out_hash[at] = owner, words
    out_suffix[at] = last
    out_owner[ends], out_hash[ends], out_suffix[ends] = np.arange(n), END_HASH, END_SUFFIX
    return out_owner, out_hash, out_suffix


ENTRY = np.dtype([("hash", "<u8"), ("n", "<u4"), ("suffix", "<u4"), ("held", "u1")])
COUNT = np.dtype([("hash", "<u8"), ("n", "<i8")])


def _sum_by_hash(hashed, n, suffix, held):
    order = np.argsort(hashed, kind="stable")
    hashed = hashed[order]
    at = np.flatnonzero(np.concatenate(([True], hashed[1:] != hashed[:-1])))
    return hashed[at], np.add.reduceat(n[order], at), suffix[order][at], np.maximum.reduceat(held[order], at)


def _block_words(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """For each block and bucket of hashes: the block's distinct words with their training counts."""
    found: dict[int, list] = {}
    for part in slices(batches, 1, 1024):
        owner, hashed, suffix = tokens_of(part.column(1).to_pylist())
        blocks, train = part.column(0).to_numpy(), part.column(2).to_numpy(zero_copy_only=False)
        for block in np.unique(blocks):
            mine = (blocks == block)[owner]
            t = train[owner[mine]]
            found.setdefault(int(block), []).append(_sum_by_hash(hashed[mine], t.astype(np.int64), suffix[mine], (~t).astype(np.uint8)))
    for block, parts in found.items():
        hashed, n, suffix, held = _sum_by_hash(*[np.concatenate(x) for x in zip(*parts, strict=True)])
        rows = np.empty(len(hashed), ENTRY)
        rows["hash"], rows["n"], rows["suffix"], rows["held"] = hashed, n, suffix, held
        bucket = (hashed % U(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        rows, bucket = rows[order], bucket[order]
        at = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
        blobs = [x.tobytes() for x in np.split(rows, at[1:])]
        yield pa.record_batch([pa.array(bucket[at], pa.int32()), pa.array([block] * len(at), pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "block", "entries"])


SUMS = "kind int, block int, key long, n long, v long, counts binary"


def _sum_bucket(group: pd.DataFrame, top_words: int) -> pd.DataFrame:
    """The counts of a bucket's words over all blocks: for the blocks (0), by suffix (1), and the largest (2).

    A block isn't told of a word that no training text has, or that one training text of that block
    has once and no held-out text of it: these cases it can tell by itself.
    """
    group = group.sort_values("block", kind="stable")
    parts = [np.frombuffer(x, ENTRY) for x in group["entries"]]
    sizes = [len(x) for x in parts]
    rows = np.concatenate(parts)
    hashed, inverse = np.unique(rows["hash"], return_inverse=True)
    total = np.bincount(inverse, weights=rows["n"], minlength=len(hashed)).astype(np.int64)
    suffix = np.empty(len(hashed), np.int64)
    suffix[inverse] = rows["suffix"]
    mine = total[inverse]
    told = (mine > 0) & ~((mine == 1) & (rows["n"] == 1) & (rows["held"] == 0))
    out = []
    for block, low, size in zip(group["block"], np.cumsum([0, *sizes[:-1]]), sizes, strict=True):
        keep = told[low : low + size]
        back = np.empty(int(keep.sum()), COUNT)
        back["hash"], back["n"] = rows["hash"][low : low + size][keep], mine[low : low + size][keep]
        out.append((0, int(block), 0, 0, 0, back.tobytes()))
    known = total > 0
    n_of, v_of = np.bincount(suffix[known], weights=total[known]), np.bincount(suffix[known])
    out += [(1, 0, int(c), int(n_of[c]), int(v_of[c]), None) for c in np.flatnonzero(v_of)]
    signed = hashed.view(np.int64)
    largest = np.lexsort((signed, -total))[: top_words + 1]  # the end of a text isn't one of them
    out += [(2, 0, int(signed[i]), int(total[i]), int(suffix[i]), None) for i in largest if total[i] and suffix[i] != END_SUFFIX]
    return pd.DataFrame(out, columns=["kind", "block", "key", "n", "v", "counts"])


def _row_max(x: np.ndarray) -> np.ndarray:
    """The largest value of each row, as a column; rows are a power of 2 long, so halves are compared."""
    while x.shape[1] > 1:
        half = x.shape[1] // 2
        x = np.maximum(x[:, :half], x[:, half:])
    return x


class Model:
    """Word classes with their totals, and the weights of the two softmaxes."""

    def __init__(self, top: np.ndarray, class_n: np.ndarray, class_v: np.ndarray, shape: Shape = Shape()):
        self.shape = shape
        order = np.argsort(top)
        self.top, self.top_class = top[order], order.astype(np.int32)  # sorted hashes and their ranks
        self.class_n, self.class_v = class_n, class_v
        rows = 1 << shape.bits
        self.upper, self.lower = np.zeros((rows, shape.upper), np.float32), np.zeros((rows, shape.lower), np.float32)
        share = (class_n + 1.0).reshape(shape.upper, shape.lower)
        self.upper_bias = np.log(share.sum(1) / share.sum()).astype(np.float32)
        self.lower_bias = np.log(share / share.sum(1, keepdims=True)).astype(np.float32)

    def classes(self, hashed: np.ndarray, suffix: np.ndarray) -> np.ndarray:
        suffix = self.shape.suffix_class(suffix)
        if not len(self.top):
            return suffix
        at = np.minimum(np.searchsorted(self.top, hashed), len(self.top) - 1)
        return np.where(self.top[at] == hashed, self.top_class[at], suffix)

    def features(self, owner: np.ndarray, hashed: np.ndarray, cls: np.ndarray) -> list[np.ndarray]:
        """The hash of each history feature of every token."""
        n = len(owner)

        def back(values, steps, start):
            out = np.full(n, start, values.dtype)
            if n > steps:
                out[steps:] = np.where(owner[steps:] == owner[:-steps], values[:-steps], start)
            return out

        one, two = back(hashed, 1, U(1)), back(hashed, 2, U(2))
        start = self.shape.classes  # stands for the time before a text
        c1, c2 = back(cls, 1, start), back(cls, 2, start)
        pair = c1.astype(U) * U(start + 1) + c2.astype(U)
        return [mix(one ^ U(0x11)), mix(two ^ U(0x2222)), mix(pair + U(0x333333))]

    def rows(self, feature: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The weight rows of a feature: for the upper softmax, and with the upper class for the lower."""
        shift = U(64 - self.shape.bits)
        upper = (feature >> shift).astype(np.int32)
        lower = (mix(feature + (cls // self.shape.lower).astype(U)) >> shift).astype(np.int32)
        return upper, lower

    def log_probabilities(self, features, cls):
        """ln P of each token's class, with what a gradient step needs: rows, and the probabilities of both softmaxes."""
        up, low = cls // self.shape.lower, cls % self.shape.lower
        rows = [self.rows(f, cls) for f in features]
        a, b = np.broadcast_to(self.upper_bias, (len(cls), self.shape.upper)).copy(), np.take(self.lower_bias, up, axis=0)
        for i, j in rows:
            a += np.take(self.upper, i, axis=0)
            b += np.take(self.lower, j, axis=0)
        total = np.zeros(len(cls), np.float64)
        each = np.arange(len(cls))
        for x, y in ((a, up), (b, low)):
            x -= _row_max(x)
            target = x[each, y].astype(np.float64)
            np.exp(x, out=x)
            s = np.einsum("ij->i", x)  # not a matrix product, which would start threads of its own
            total += target - np.log(s)
            x /= s[:, None]
        return total, rows, a, b

    def descend(self, features, cls, squares, rate: float) -> None:
        """One AdaGrad step on a batch of tokens."""
        _, rows, a, b = self.log_probabilities(features, cls)
        each = np.arange(len(cls))
        a[each, cls // self.shape.lower] -= 1
        b[each, cls % self.shape.lower] -= 1
        for table, square, gradient, side in zip((self.upper, self.lower), squares, (a, b), (0, 1), strict=True):
            columns = np.ascontiguousarray(gradient.T)
            for pair in rows:
                row = pair[side]
                touched = np.flatnonzero(np.bincount(row, minlength=len(table)))
                place = np.empty(len(table), np.int64)
                place[touched] = np.arange(len(touched))
                place = place[row]
                g = np.array([np.bincount(place, weights=c, minlength=len(touched)) for c in columns], np.float32).T
                s = np.take(square, touched, axis=0)
                s += g * g
                square[touched] = s
                table[touched] -= rate * g / np.sqrt(s)


def _train(batches: Iterator[pa.RecordBatch], shared, rate: float) -> Iterator[pa.RecordBatch]:
    """The change of the weights by the task's own documents, in pieces of rows."""
    import copy

    start, model = shared.value, copy.deepcopy(shared.value)
    squares = (np.full_like(model.upper, 1.0), np.full_like(model.lower, 1.0))
    seen = False
    for batch in slices(batches, 0, ROWS_AT_ONCE):
        owner, hashed, suffix = tokens_of(batch.column(0).to_pylist())
        cls = model.classes(hashed, suffix)
        features = model.features(owner, hashed, cls)
        seen = True
        for low in range(0, len(cls), STEP_TOKENS):
            part = slice(low, low + STEP_TOKENS)
            model.descend([f[part] for f in features], cls[part], squares, rate)
    if seen:
        part = TaskContext.get().partitionId()
        for table, (new, old) in enumerate(((model.upper, start.upper), (model.lower, start.lower))):
            pieces = len(new) // PIECE_ROWS
            for piece in range(pieces):
                low = piece * PIECE_ROWS
                change = new[low : low + PIECE_ROWS] - old[low : low + PIECE_ROWS]
                yield pa.record_batch([pa.array([table * pieces + piece], pa.int32()), pa.array([part], pa.int32()), pa.array([change.astype("<f4").tobytes()], pa.binary())], ["piece", "part", "change"])


def _sum_changes(group: pd.DataFrame) -> pd.DataFrame:
    """The sum of some tasks' changes of a piece, and their number."""
    total = np.zeros(len(group["change"].iloc[0]) // 4, np.float64)
    for change in group.sort_values("part")["change"]:  # a fixed order: sums of floats don't depend on arrival
        total += np.frombuffer(change, "<f4")
    return pd.DataFrame({"piece": [group["piece"].iloc[0]], "part": [group["part"].min()], "n": [len(group)], "total": [total.astype("<f8").tobytes()]})


def _average(group: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(len(group["total"].iloc[0]) // 8, np.float64)
    for part in group.sort_values("part")["total"]:
        total += np.frombuffer(part, "<f8")
    return pd.DataFrame({"piece": [group["piece"].iloc[0]], "change": [(total / group["n"].sum()).astype("<f4").tobytes()]})


def _score(batches: Iterator[pa.RecordBatch], shared, n_train: int, v_train: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by block, a block's counts before its documents."""
    model: Model = shared.value
    within = np.log(model.class_n + model.class_v + 1.0)
    within[: len(model.top)] = np.log(np.maximum(model.class_n[: len(model.top)], 1.0) + 1.0)  # a class of one word has no unknown words
    block, parts, table = None, [], None
    for batch in batches:
        blocks, kinds, sizes = batch.column(0).to_pylist(), batch.column(1).to_pylist(), pc.binary_length(batch.column(4)).to_pylist()
        at = 0
        while at < batch.num_rows:
            if blocks[at] != block:
                block, parts, table = blocks[at], [], None
            if kinds[at] == 0:
                parts.append(np.frombuffer(batch.column(2)[at].as_py(), COUNT))
                at += 1
                continue
            if table is None:
                table = np.concatenate(parts) if parts else np.empty(0, COUNT)
                table = table[np.argsort(table["hash"])]
                hashes, counts = np.ascontiguousarray(table["hash"]), np.ascontiguousarray(table["n"])
                parts = []
            end, size = at, 0
            while end < batch.num_rows and end - at < ROWS_AT_ONCE and blocks[end] == block and kinds[end] == 1 and (end == at or size + sizes[end] <= SLICE_BYTES):
                size += sizes[end]
                end += 1
            part = batch.slice(at, end - at)
            at = end
            train = part.column(5).to_numpy(zero_copy_only=False)
            owner, hashed, suffix = tokens_of(part.column(4).to_pylist())
            c = train[owner].astype(np.int64)  # words that the block isn't told of: one here, none in other texts
            if len(hashes):
                place = np.minimum(np.searchsorted(hashes, hashed), len(hashes) - 1)
                c = np.where(hashes[place] == hashed, counts[place], c)
            n = part.num_rows
            cls = model.classes(hashed, suffix)
            features = model.features(owner, hashed, cls)
            log_class = np.concatenate([model.log_probabilities([f[low : low + (1 << 15)] for f in features], cls[low : low + (1 << 15)])[0] for low in range(0, len(cls), 1 << 15)])
            log_count = np.log(c + 1.0)
            n_tokens = np.bincount(owner, minlength=n)
            sums = lambda x: np.bincount(owner, weights=x, minlength=n)
            base = (sums(log_count) - n_tokens * math.log(n_train + v_train + 1)) / math.log(10)
            score = sums(log_class + log_count - within[cls]) / math.log(10) if n_train else base
            yield pa.record_batch(
                [part.column(3), pa.array(~train), pa.array(n_tokens, pa.int64()), pa.array(sums(c > 0).astype(np.int64)), pa.array(np.full(n, n_train, np.int64)), pa.array(base), pa.array(score)],
                ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held_out_fold: int = 2) -> DataFrame:
    """One row per document: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    A document is held out if crc32 of its id as text leaves ``held_out_fold`` by ``folds``; null ids are
    held out. Null texts are empty: their only token is the end. Repeated rows are counted and scored
    each; those that repeat an id and text share a block, which is read as a stream. A very long text is
    read whole by one task. Without training documents both scores are 0. Other columns aren't read, whatever
    their names; an empty table gives no rows.
    """
    spark = docs.sparkSession
    text = text_of(text_col)
    train = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds != held_out_fold, F.lit(False))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), train.alias("train"))
    size = rows.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    n_blocks = partitions_for(spark, size, BLOCK_BYTES)
    placed = rows.withColumn("block", F.pmod(F.xxhash64(F.col("id").cast("string"), "text"), F.lit(n_blocks)).cast("int"))

    top_words = Shape.of(size).top_words  # there are fewer tokens than bytes, so no fewer words than are needed
    entries = placed.select("block", "text", "train").repartitionById(n_blocks, F.col("block")).mapInArrow(partial(_block_words, buckets=n_blocks), "bucket int, block int, entries binary")
    sums = materialise(entries.groupBy("bucket").applyInPandas(lambda group: _sum_bucket(group, top_words), SUMS))

    # Bounded: at most one row for each pair of bytes, and one for each word with a class of its own.
    by_suffix = sums.filter("kind = 1").groupBy("key").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).toPandas()
    shape = Shape.of(int(by_suffix["n"].sum()))
    top = sums.filter("kind = 2").orderBy(F.desc("n"), "key").select("key", "n", "v").limit(shape.top_words).toPandas()
    class_n, class_v = np.zeros(shape.classes), np.zeros(shape.classes)
    of_suffix = shape.suffix_class(by_suffix["key"].to_numpy(np.int64))
    np.add.at(class_n, of_suffix, by_suffix["n"].to_numpy(np.float64))
    np.add.at(class_v, of_suffix, by_suffix["v"].to_numpy(np.float64))
    n_train, v_train = int(class_n.sum()), int(class_v.sum())
    of_top = shape.suffix_class(top["v"].to_numpy(np.int64))
    np.subtract.at(class_n, of_top, top["n"].to_numpy(np.float64))
    np.subtract.at(class_v, of_top, 1.0)
    class_n[: len(top)], class_v[: len(top)] = top["n"], 1.0
    model = Model(top["key"].to_numpy(np.int64).view(np.uint64), class_n, class_v, shape)

    tasks = partitions_for(spark, size, TRAIN_BYTES)
    for step in range(ROUNDS):
        # Each round learns from a part of its own; together they cover every training document once.
        mine = F.pmod(F.xxhash64("text"), F.lit(ROUNDS)) == step
        changes = rows.filter(F.col("train") & mine).select("text").coalesce(tasks).mapInArrow(partial(_train, shared=spark.sparkContext.broadcast(model), rate=RATE), "piece int, part int, change binary")
        # Tasks are summed in two levels, so that a group grows with the square root of their number.
        some = F.col("part") % max(1, math.isqrt(tasks))
        summed = changes.groupBy("piece", some.alias("some")).applyInPandas(_sum_changes, "piece int, part int, n long, total binary")
        for row in summed.groupBy("piece").applyInPandas(_average, "piece int, change binary").toArrow().to_pylist():
            pieces = len(model.upper) // PIECE_ROWS
            table = model.upper if row["piece"] < pieces else model.lower
            low = row["piece"] % pieces * PIECE_ROWS
            table[low : low + PIECE_ROWS] += np.frombuffer(row["change"], "<f4").reshape(PIECE_ROWS, -1)

    back = sums.filter("kind = 0").select("block", F.lit(0).alias("kind"), "counts", F.lit(None).cast(rows.schema["id"].dataType).alias("id"), F.lit("").alias("text"), F.lit(False).alias("train"))
    documents = placed.select("block", F.lit(1).alias("kind"), F.lit(None).cast("binary").alias("counts"), "id", "text", "train")
    dealt = back.unionByName(documents).repartitionById(n_blocks, F.col("block")).sortWithinPartitions("block", "kind")
    kind = rows.schema["id"].dataType.simpleString()
    job = partial(_score, shared=spark.sparkContext.broadcast(model), n_train=n_train, v_train=v_train)
    return dealt.mapInArrow(job, f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double").withColumnRenamed("id", id_col)
