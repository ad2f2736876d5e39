"""Near-duplicate classes by improved consistent weighted sampling of TF-IDF shingles.

A text is its multiset of five-word shingles, each weighted by its count and inverse document frequency.
Improved consistent weighted sampling (Ioffe 2010) draws samples from a weighted set so that two sets
share a sample with the probability of their weighted Jaccard similarity. Samples are banded; texts that
share a band are compared, and those whose weighted Jaccard similarity is at least 0.8 are linked.

Document frequencies are counted over all documents in a vector of fixed length, so what is broadcast
doesn't grow with the corpus. Shingles that share a bucket add up: relative to the number of documents
that adds the mean number of shingles of a document / 2 ** DF_BITS, a constant.

Texts that are equal are one node. In a band's bucket every node is compared with one leader, not with
all others, and links make components. Where a bucket still holds several components, nodes outside the
main one are compared with its hubs, and what is open then is joined by an exact prefix filter (a pair
that is similar enough must share one of its rarest shingles, with enough left after it, and can't share
more than the lesser of both texts' weights in each part of the hash space), so every similar pair that shares a band ends in one component, and a large group of copies costs a few
comparisons for each node.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, materialise, slices, text_of
from .components import connected_components
from .hashing import U, mix, words_of

SHINGLE_WORDS, SIMILARITY = 5, 0.8
#: Samples of a band and bands: similar pairs of 0.8 share a band with probability 1 - (1 - 0.8 ** 3) ** 9 = 0.998.
ROWS, BANDS = 3, 9
#: log2 of the buckets that count document frequencies.
DF_BITS = 20
#: Parts of the hash space whose weights bound what two texts share, and the units that a weight is rounded up to.
MASS_PARTS, MASS_UNITS = 256, 64
#: Hubs of a component that nodes outside it are compared with.
HUBS = 8
#: Texts hashed at once: their number takes the upper eight bits of a sort key.
ROWS_AT_ONCE = 64
#: Pieces that the vector of document frequencies is summed in.
PIECES = 64


def shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, 56-bit hash and count of each distinct shingle, sorted by number and hash; 256 texts at most.

    A text of one to four words has one shingle of all its words; a text without words has none.
    """
    if len(texts) > 256:
        raise ValueError("256 texts at most")
    owner, words, _ = words_of(texts)
    n = len(words)
    if not n:
        return np.empty(0, np.int64), np.empty(0, U), np.empty(0, np.int64)
    count = np.bincount(owner, minlength=len(texts))
    first = np.cumsum(count) - count
    left = (first + count)[owner] - np.arange(n)  # words from here to the end of the text
    hashed = np.zeros(n, U)
    for j in range(min(SHINGLE_WORDS, n)):
        term = words[j:] * U(2 * j + 3)
        term ^= term >> U(29)
        hashed[: n - j] += np.where(left[: n - j] > j, term * U(0xBF58476D1CE4E5B9), U(0))
    whole = left >= SHINGLE_WORDS
    whole[first[count > 0]] = True
    key = (owner[whole].astype(U) << U(56)) | (mix(hashed[whole]) >> U(8))
    key.sort()
    at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    distinct = key[at]
    return (distinct >> U(56)).astype(np.int64), distinct & U((1 << 56) - 1), np.diff(np.append(at, len(key)))


def df_bucket(hashed: np.ndarray) -> np.ndarray:
    return (hashed >> U(56 - DF_BITS)).astype(np.int64)


def icws(owner: np.ndarray, hashed: np.ndarray, weight: np.ndarray, n: int, samples: int) -> np.ndarray:
    """``samples`` 32-bit fingerprints of each of the ``n`` weighted sets; sets without elements get zeros.

    For each element and sample: r and c from Gamma(2, 1), b uniform; t = floor(ln w / r + b);
    ln a = ln c - r (t - b + 1). The sample is the element of least a, with its t.
    """
    out = np.zeros((n, samples), np.uint32)
    if not len(owner):
        return out
    starts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
    who, each = owner[starts], np.diff(np.append(starts, len(owner)))
    log_weight = np.log(weight).astype(np.float32)
    word, half = np.float32(2.0**-16), np.float32(0.5)

    def uniform(bits, shift):
        return ((bits >> U(shift)).astype(np.uint16).astype(np.float32) + half) * word

    for k in range(samples):
        bits = mix(hashed + U((2 * k + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        r = -np.log(uniform(bits, 0) * uniform(bits, 16))
        c = -np.log(uniform(bits, 32) * uniform(bits, 48))
        b = ((bits * U(0xD1B54A32D192ED03)) >> U(40)).astype(np.float32) * np.float32(2.0**-24)
        t = np.floor(log_weight / r + b)
        log_a = np.log(c) - r * (t - b + 1)
        least = np.minimum.reduceat(log_a, starts)
        at = np.flatnonzero(log_a == np.repeat(least, each))
        # of equal values, the first in order of hash
        picked = at[np.searchsorted(at, starts)]
        out[who, k] = mix(hashed[picked] ^ mix(t[picked].astype(np.int64).astype(U) + U(k))).astype(np.uint32)
    return out


def weighted(owner, hashed, counts, idf: np.ndarray):
    return owner, hashed, counts * idf[df_bucket(hashed)].astype(np.float64)


def similarity(a, b) -> float:
    """Weighted Jaccard similarity of two weighted sets (hashes sorted, weights)."""
    (ha, wa), (hb, wb) = a, b
    _, i, j = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
    common = float(np.minimum(wa[i], wb[j]).sum())
    union = float(wa.sum() + wb.sum()) - common
    return common / union if union > 0 else 1.0


def _count_df(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts, docs = np.zeros(1 << DF_BITS, "<i8"), 0
    for batch in slices(batches, 0, ROWS_AT_ONCE):
        _, hashed, _ = shingles(batch.column(0).to_pylist())
        counts += np.bincount(df_bucket(hashed), minlength=1 << DF_BITS)
        docs += batch.num_rows
    if docs:
        part = TaskContext.get().partitionId()
        blobs = [x.tobytes() for x in np.split(counts, PIECES)] + [np.array([docs], "<i8").tobytes()]
        yield pa.record_batch([pa.array(range(PIECES + 1), pa.int32()), pa.array([part] * (PIECES + 1), pa.int32()), pa.array(blobs, pa.binary())], ["piece", "part", "counts"])


def _sum_counts(group: pd.DataFrame) -> pd.DataFrame:
    total = np.sum([np.frombuffer(x, "<i8") for x in group["counts"]], axis=0)
    return pd.DataFrame({"piece": [group["piece"].iloc[0]], "counts": [total.astype("<i8").tobytes()]})


def inverse_frequencies(normed: DataFrame) -> np.ndarray:
    """ln(1 + N / (N + frequency)) of each bucket, over all N documents. Its size is fixed: 2 ** DF_BITS.

    The smoothing keeps copies alike: where a third of all documents are near copies of one text, their
    common shingles still weigh four fifths of a rare one, and plain ln(N / frequency) would leave a tenth.
    Each task sums its own documents; tasks are summed in two levels, so that no group is large.
    """
    pieces = normed.select("norm").mapInArrow(_count_df, "piece int, part int, counts binary")
    once = pieces.groupBy("piece", (F.col("part") % 64).alias("some")).applyInPandas(_sum_counts, "piece int, counts binary")
    rows = once.groupBy("piece").applyInPandas(_sum_counts, "piece int, counts binary").toArrow().to_pylist()
    counts = {row["piece"]: np.frombuffer(row["counts"], "<i8") for row in rows}
    if not counts:
        return np.ones(1 << DF_BITS, np.float32)
    total, frequency = counts[PIECES][0], np.concatenate([counts[i] for i in range(PIECES)])
    return np.log1p(total / (total + frequency)).astype(np.float32)


def _sign(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    idf, seen = shared.value, set()
    for batch in slices(batches, 2, ROWS_AT_ONCE):
        ids, nodes, texts = batch.column(0), batch.column(1).to_pylist(), batch.column(2)
        fresh = []
        for i, node in enumerate(nodes):
            if node not in seen:  # copies inside a task are signed once
                seen.add(node)
                fresh.append(i)
        signed: list[bytes | None] = [None] * len(nodes)
        if fresh:
            owner, hashed, weight = weighted(*shingles([texts[i].as_py() for i in fresh]), idf)
            samples = icws(owner, hashed, weight, len(fresh), ROWS * BANDS)
            with_words = np.zeros(len(fresh), bool)
            with_words[owner] = True
            for row, i in enumerate(fresh):
                signed[i] = samples[row].tobytes() if with_words[row] else b""
        yield pa.record_batch([ids, batch.column(1), pa.array(signed, pa.binary())], ["id", "node", "sig"])


def _first_of_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each node and task, so that a large group of copies isn't moved."""
    seen = set()
    for batch in batches:
        nodes = batch.column(0).to_pylist()
        keep = [node not in seen and not seen.add(node) for node in nodes]
        yield batch.filter(pa.array(keep))


def _compare(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    idf = shared.value
    for batch in slices(batches, 2, ROWS_AT_ONCE):
        texts = batch.column(2).to_pylist() + batch.column(3).to_pylist()
        distinct = list(dict.fromkeys(texts))  # a leader's text stands beside many others
        owner, hashed, weight = weighted(*shingles(distinct), idf)
        bounds = np.searchsorted(owner, np.arange(len(distinct) + 1))
        sets = {t: (hashed[x:y], weight[x:y]) for t, x, y in zip(distinct, bounds[:-1], bounds[1:], strict=True)}
        n = batch.num_rows
        found = [similarity(sets[x], sets[y]) for x, y in zip(texts[:n], texts[n:], strict=True)]
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(found, pa.float64())], ["a", "b", "similarity"])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = SIMILARITY) -> DataFrame:
    """One row per input row: id, class_id (least id of the class), class_size, kept (one row of each class).

    Texts are lower-cased, with white space normalised. Equal texts are of one class, empty and null texts
    included. Classes are the components of links of at least ``threshold``. Null ids sort after others; of
    rows that repeat the least id exactly one is kept. Other columns aren't read.
    """
    assigned = _classes(docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text")), threshold)
    return assigned.select(F.col("id").alias(id_col), "class_id", "class_size", "kept")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` that are kept: one document of each class, with its columns as they were.

    Rows that repeat a kept id and text are dropped but for one. Null and empty texts are one class; null ids
    sort after others, so they are kept only where a class has no other. A very long text is hashed whole by
    one task. An empty table gives no rows. Clashing column names can't matter: a row travels as one struct.
    """
    node = _node(_norm(text_of(f"`{text_col}`")))
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), node.alias("node"), F.col(f"`{id_col}`").cast("long").alias("id"))
    kept = _classes(docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text_of(f"`{text_col}`").alias("text")), threshold)
    key = F.xxhash64("id", "node").alias("key")  # one key for the join and the grouping after it, so texts are moved once
    kept = materialise(kept.filter("kept").select(key, F.col("id").alias("kept_id"), F.col("node").alias("kept_node")))
    same = F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("node") == F.col("kept_node"))
    joined = row.select(key, "id", "node", "row").alias("r").join(kept.alias("k"), (F.col("r.key") == F.col("k.key")) & same, "left_semi")
    # A node and id that stand once in the class table can stand on repeated rows: the first of equal rows stays.
    return joined.groupBy("key", "id", "node").agg(F.first("row").alias("row")).select("row.*")


def _norm(text):
    return F.lower(F.trim(F.regexp_replace(text, f"{SPACE_CLASS}+", " ")))


def _node(norm):
    return F.unhex(F.md5(norm))


def _classes(keyed: DataFrame, threshold: float) -> DataFrame:
    """id, node, class_id, class_size, kept for each row of ``keyed`` (id, text)."""
    spark = keyed.sparkSession
    normed = keyed.select("id", _norm(F.col("text")).alias("norm")).select("id", _node(F.col("norm")).alias("node"), "norm")
    shared = spark.sparkContext.broadcast(inverse_frequencies(normed))
    rows = materialise(normed.mapInArrow(partial(_sign, shared=shared), "id long, node binary, sig binary"))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id")).alias("first")
    nodes = materialise(rows.groupBy("node").agg(first, F.count("*").alias("n"), F.max("sig").alias("sig")))

    roots = _linked_roots(normed, nodes.filter(F.octet_length("sig") > 0), shared, threshold)
    rooted = nodes.join(roots, F.col("node") == F.col("root_of"), "left").select("node", "first", "n", F.coalesce("root", "node").alias("root"))
    classes = rooted.groupBy("root").agg(F.min(F.struct("first", F.col("node").alias("first_node"))).alias("top"), F.sum("n").alias("class_size"))
    tops = materialise(rooted.select("node", "root").join(classes, "root").select(F.col("node").alias("of_node"), "top", "class_size"))
    joined = rows.select("id", "node").join(tops, F.col("node") == F.col("of_node"))
    candidate = F.col("id").eqNullSafe(F.col("top.first.id")) & (F.col("node") == F.col("top.first_node"))
    # Of rows that repeat the least id of the class, one is kept: they share a node and are few, or copies of one row.
    ranked = joined.select("id", "node", F.col("top.first.id").alias("class_id"), "class_size", candidate.alias("candidate"))
    others = ranked.filter("NOT candidate").select("id", "node", "class_id", "class_size", F.lit(False).alias("kept"))
    heads = ranked.filter("candidate").groupBy("id", "node", "class_id", "class_size").agg(F.count("*").alias("copies"))
    heads = heads.select("id", "node", "class_id", "class_size", F.posexplode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("copy", "zero"))
    return others.unionByName(heads.select("id", "node", "class_id", "class_size", (F.col("copy") == 0).alias("kept")))


def _linked_roots(normed: DataFrame, nodes: DataFrame, shared, threshold: float) -> DataFrame:
    """``root_of`` and ``root`` of every node with a link."""
    sigs = nodes.select("node", "sig")
    width = 4 * ROWS
    bands = F.array(*[F.xxhash64(F.lit(k), F.substring("sig", 1 + width * k, width)) for k in range(BANDS)])
    members = sigs.select("node", F.explode(bands).alias("bucket"))
    # Buckets of two nodes or more, with the node of least hash as leader; a band has its own order of nodes.
    turn = F.struct(F.xxhash64("node", "bucket").alias("turn"), "node")
    groups = members.groupBy("bucket").agg(F.count("*").alias("size"), F.min(turn).alias("leader")).filter("size > 1")
    groups = materialise(groups.select(F.col("bucket").alias("in_bucket"), "size", F.col("leader.node").alias("leader")))
    members = materialise(members.join(groups, F.col("bucket") == F.col("in_bucket")).select("bucket", "node", "size", "leader"))
    texts = _texts(normed, members.select("node").distinct())

    pair = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    led = materialise(members.filter("node <> leader").select(*pair("node", "leader")).distinct())
    compared = materialise(_verify(led, texts, shared))
    edges = compared.filter(F.col("similarity") >= threshold).select("a", "b")
    roots = materialise(connected_components(edges).withColumnRenamed("node", "root_of"))

    several = _several(members, roots)
    if several.isEmpty():
        return roots
    # Nodes outside a bucket's main component are first compared with that component's hubs, the nodes most
    # like those that they were compared with: a text from which many copies were made links to copies that
    # don't link to each other.
    ends = compared.select("a", "similarity").unionByName(compared.select(F.col("b").alias("a"), "similarity"))
    ends = ends.groupBy("a").agg(F.least(F.count("*"), F.lit(4)).alias("times"), F.avg("similarity").alias("mean"))
    best = F.max(F.struct("times", "mean", "a")).alias("best")
    hubs = ends.join(roots, F.col("a") == F.col("root_of")).groupBy("root", F.pmod(F.xxhash64("a"), F.lit(HUBS)).alias("part")).agg(best)
    hubs = materialise(hubs.select(F.col("root").alias("of_main"), F.col("best.a").alias("hub")))
    # A node takes the hubs of one main component, the largest that its buckets name.
    sizes = roots.groupBy(F.col("root").alias("sized")).agg(F.count("*").alias("nodes"))
    named = several.filter("outside").select("node", F.explode("mains").alias("main")).join(sizes, F.col("main") == F.col("sized"))
    outside = named.groupBy("node").agg(F.max(F.struct("nodes", "main")).alias("m")).select("node", F.col("m.main").alias("of_main"))
    tried = materialise(outside.join(hubs, "of_main").select(*pair("node", "hub")).distinct().join(led, ["a", "b"], "left_anti"))
    more = materialise(_verify(tried, texts, shared).filter(F.col("similarity") >= threshold).select("a", "b"))
    if not more.isEmpty():
        edges = materialise(edges.unionByName(more))
        roots = materialise(connected_components(edges).withColumnRenamed("node", "root_of"))
        several = _several(members, roots)
        if several.isEmpty():
            return roots

    # What is still open is joined by the exact prefix filter.
    prefixes = texts.join(several.select(F.col("node").alias("of")), F.col("node") == F.col("of"), "left_semi").select("node", "norm")
    prefixes = prefixes.mapInArrow(partial(_prefixes, shared=shared, threshold=threshold), "of binary, size double, rest double, shingle long, indexed boolean, mass array<smallint>")
    prefixes = materialise(prefixes.join(several, F.col("of") == F.col("node")).select("node", "root", "outside", "size", "rest", "shingle", "indexed", "mass"))
    x, y = prefixes.select(*[F.col(c).alias(f"x_{c}") for c in prefixes.columns]), prefixes.filter("indexed").select(*[F.col(c).alias(f"y_{c}") for c in prefixes.columns])
    near = (F.col("y_size") <= F.col("x_size")) & (F.col("y_size") >= threshold * F.col("x_size") - 1e-9)
    # At the first shingle that two texts share, what is left of either must still be enough.
    enough = F.least("x_rest", "y_rest") >= threshold / (1 + threshold) * (F.col("x_size") + F.col("y_size")) * (1 - 1e-9)
    fresh = (F.col("x_root") != F.col("y_root")) & (F.col("x_outside") | F.col("y_outside"))
    # What two texts share is at most what they share by parts of the hash space.
    shared_mass = F.aggregate(F.zip_with("x_mass", "y_mass", lambda a, b: F.least(a, b)), F.lit(0), lambda total, m: total + m)
    could = F.coalesce(shared_mass >= MASS_UNITS * threshold / (1 + threshold) * (F.col("x_size") + F.col("y_size")) * (1 - 1e-9), F.lit(True))
    again = x.join(y, (F.col("x_shingle") == F.col("y_shingle")) & near & enough & fresh & could).select(*pair("x_node", "y_node")).distinct()
    again = materialise(again.join(led.unionByName(tried), ["a", "b"], "left_anti"))
    more = materialise(_verify(again, texts, shared).filter(F.col("similarity") >= threshold).select("a", "b"))
    if more.isEmpty():
        return roots
    return connected_components(edges.unionByName(more)).withColumnRenamed("node", "root_of")


def _several(members: DataFrame, roots: DataFrame) -> DataFrame:
    """node, root, outside and mains (of its buckets) of the nodes in buckets that hold several components."""
    placed = members.filter("size > 2").join(roots, F.col("node") == F.col("root_of"), "left").select("bucket", "node", F.coalesce("root", "node").alias("root"))
    parts = placed.groupBy("bucket", "root").agg(F.count("*").alias("n"))
    main = parts.groupBy("bucket").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.count("*").alias("parts")).filter("parts > 1")
    main = materialise(main.select(F.col("bucket").alias("of_bucket"), "main"))
    joined = placed.join(main, F.col("bucket") == F.col("of_bucket"))
    return materialise(joined.groupBy("node", "root").agg(F.max(F.col("root") != F.col("main")).alias("outside"), F.collect_set(F.when(F.col("root") != F.col("main"), F.col("main"))).alias("mains")))


def _prefixes(batches: Iterator[pa.RecordBatch], shared, threshold: float) -> Iterator[pa.RecordBatch]:
    """The rarest shingles of each text, for an exact similarity join.

    Shingles go by falling weight, then hash. Two sets with a weighted Jaccard similarity of t or more share at
    least t of the larger one's weight, and 2 t / (1 + t) of the smaller one's. So they share a shingle
    among those of the larger that come before the last t of its weight, and it is among those of the smaller
    (``indexed``) that come before the last 2 t / (1 + t). ``mass``: the text's weight in each part of the
    hash space, rounded up; the lesser masses of two texts sum to an upper bound of what they share.
    """
    idf = shared.value
    for batch in slices(batches, 1, ROWS_AT_ONCE):
        n = batch.num_rows
        owner, hashed, counts = shingles(batch.column(1).to_pylist())
        each = idf[df_bucket(hashed)].astype(np.float64)
        order = np.lexsort((hashed, -each, owner))
        owner, hashed, weight = owner[order], hashed[order], (counts * each)[order]
        total = np.bincount(owner, weights=weight, minlength=n)
        begins = np.searchsorted(owner, np.arange(n))
        upto = np.cumsum(weight)
        before = upto - weight - (upto - weight)[np.minimum(begins, len(owner) - 1)][owner]
        rest = total[owner] - before  # the weight of this shingle and all after it
        slack = 1e-9 * total[owner]
        probing = rest >= threshold * total[owner] - slack
        indexed = rest >= 2 * threshold / (1 + threshold) * total[owner] - slack
        mine = owner[probing]
        part = (hashed & U(MASS_PARTS - 1)).astype(np.int64)
        mass = np.ceil(np.bincount(owner * MASS_PARTS + part, weights=weight, minlength=n * MASS_PARTS) * MASS_UNITS).reshape(n, MASS_PARTS)
        fits = (mass < 1 << 15).all(1)  # a text too long for it goes without
        masses = pa.array([m if ok else None for m, ok in zip(mass.clip(0, (1 << 15) - 1).astype(np.int16), fits, strict=True)], pa.list_(pa.int16()))
        columns = [batch.column(0).take(pa.array(mine)), pa.array(total[mine]), pa.array(rest[probing]), pa.array(hashed[probing].astype(np.int64)), pa.array(indexed[probing]), masses.take(pa.array(mine))]
        yield pa.record_batch(columns, ["of", "size", "rest", "shingle", "indexed", "mass"])


def _texts(normed: DataFrame, nodes: DataFrame) -> DataFrame:
    """One text for each of the nodes, which are those that share a band with another."""
    single = normed.select("node", "norm").mapInArrow(_first_of_each, "node binary, norm string")
    there = single.join(nodes.select(F.col("node").alias("of")), F.col("node") == F.col("of"), "left_semi")
    return materialise(there.groupBy("node").agg(F.first("norm").alias("norm")))


def _verify(pairs: DataFrame, texts: DataFrame, shared) -> DataFrame:
    """a, b and similarity of every pair."""
    with_a = pairs.join(texts.select(F.col("node").alias("a"), F.col("norm").alias("text_a")), "a")
    with_both = with_a.join(texts.select(F.col("node").alias("b"), F.col("norm").alias("text_b")), "b")
    return with_both.select("a", "b", "text_a", "text_b").mapInArrow(partial(_compare, shared=shared), "a binary, b binary, similarity double")
