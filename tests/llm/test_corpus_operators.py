"""WARC, near dedup, rollups, language model and the pipeline against plain versions, with odd inputs."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from hatlake.llm import common, components, lm, near_dedup, packing, rollups, tokens, warc

JSON = P.path("byte_bpe_50k.json")
DOC = "doc_id long, text string, lang string, source string, n_chars long, node string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 4}", len(t or ""), "x") for i, t in rows], DOC)


def words(rng, n):
    return ["".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(2, 7))) for _ in range(n)]


def test_archives(spark, tmp_path):
    pages = [(1, "u1", "x" * 100000), (2, "u2", "x" * 100000), (3, None, None), (None, "u", "é\r\n\r\nWARC/1.1\r\n"), (5, "a\nb", "é\r\n\r\nWARC/1.1\r\n"), (1, "u1", "x" * 100000), (7, "big", "y" * 90000), (7, "big", "y" * 90000), (8, "z", "")]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    found = warc.page_report(frame, str(tmp_path / "w"), records_per_file=2).collect()
    top = {}
    for i, _, h in pages:
        top[h or ""] = max(top.get(h or "", -1), -1 if i is None else i)
    want = Counter()
    for i, _, h in pages:
        body = (h or "").encode()
        first = i == top[h or ""]
        want[(i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if first else "revisit", None if first else top[h or ""])] += 1
    assert Counter(tuple(r)[:5] for r in found) == want and all(r["ok"] for r in found)
    whole = warc.reassemble(warc.read_records(spark, str(tmp_path / "w")))
    assert {bytes(r["payload"]) for r in whole.filter("type = 'response'").collect()} == {(h or "").encode() for _, _, h in pages}
    assert warc.page_report(frame.limit(0), str(tmp_path / "e")).count() == 0


def test_every_record_is_a_member_and_names_its_page(spark, tmp_path):
    """Archives read with the library's gzip alone: members, headers and segments."""
    import gzip
    import io

    frame = spark.createDataFrame([(1, "u1", "x" * 100_000, "clash"), (2, None, "y", "clash"), (3, "u3", "y", "clash")], "page_id long, url string, html string, record string").coalesce(1)
    warc.write_archives(frame, str(tmp_path / "w"))
    seen = []
    for part in (tmp_path / "w").glob("part-*"):
        data = part.read_bytes()
        assert data.count(b"\x1f\x8b\x08\x00\x00\x00\x00\x00") == 2 * sum(1 for _ in warc.parse_records(io.BytesIO(gzip.decompress(data))))
        at = 0
        while at < len(data):  # every member is whole by itself: a record, or the line ends that close one
            whole = zlib.decompressobj(31)
            text = whole.decompress(data[at:])
            at = len(data) - len(whole.unused_data)
            assert text == b"\r\n\r\n" or len(list(warc.parse_records(io.BytesIO(text)))) == 1
        seen += [f for f, _ in warc.parse_records(io.BytesIO(gzip.decompress(data)))]
    kinds = Counter(f["warc-type"] for f in seen)
    assert kinds["response"] == 2 and kinds["revisit"] == 1 and kinds["continuation"] >= 3
    assert {f["warc-target-uri"] for f in seen if f["warc-type"] != "warcinfo"} == {"u1", "urn:x-page:2", "u3"}
    found = {r["page"]: r["uri"] for r in warc.reassemble(warc.read_records(spark, str(tmp_path / "w"))).collect()}
    assert found == {"1": "u1", "2": None, "3": "u3"}


def test_small_payloads_are_all_responses(spark, tmp_path):
    frame = spark.createDataFrame([(i, "u", "tiny") for i in range(3)], "page_id long, url string, html string")
    assert {r["record_type"] for r in warc.page_report(frame, str(tmp_path / "w"), least_bytes=5).collect()} == {"response"}


def test_broken_segments_are_reported(spark, tmp_path):
    frame = spark.createDataFrame([(1, "u", "z" * 200000)], "page_id long, url string, html string")
    warc.write_archives(frame, str(tmp_path / "w"))
    records = warc.read_records(spark, str(tmp_path / "w"))
    assert records.filter("segment IS NOT NULL").count() > 3
    assert [r["ok"] for r in warc.reassemble(records).collect()] == [True]
    assert [r["ok"] for r in warc.reassemble(records.filter("segment IS NULL OR segment <> 2")).collect()] == [False]
    assert [r["ok"] for r in warc.reassemble(records.filter("total IS NULL")).collect()] == [False]


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1100)] + [(5, 5)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    found = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {x: find(x) for x in list(parent)}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_weighted_sampling_estimates_similarity():
    rng = np.random.default_rng(2)
    hashed = np.sort(rng.integers(0, 1 << 56, 400).astype(np.uint64))
    wa, wb = rng.uniform(0.2, 3, 400), rng.uniform(0.2, 3, 400)
    wb[:60], wa[300:] = wa[:60], 0.5
    n = 4000
    one, two = (near_dedup.icws(np.zeros(400, np.int64), hashed, w, 1, n)[0] for w in (wa, wb))
    exact = np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()
    assert abs((one == two).mean() - exact) < 4 * math.sqrt(exact * (1 - exact) / n)


def test_shingles_are_exact():
    rng = random.Random(3)
    texts = ["", "one", "a b c d", "a b c d e", "a b c d e a b c d e a b c d e"] + [" ".join(words(rng, rng.randint(0, 40))) for _ in range(60)]
    owner, _, counts = near_dedup.shingles(texts)
    for i, text in enumerate(texts):
        w = text.split()
        want = Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter()
        assert sorted(counts[owner == i]) == sorted(want.values())


def classes_by_force(texts, threshold=0.8):
    """Classes of all pairs, with document frequencies counted exactly as the operator does."""
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "").strip(" ").lower() for t in texts]
    parts = [near_dedup.shingles([t]) for t in norm]
    frequency = np.zeros(1 << near_dedup.DF_BITS)
    for _, h, _ in parts:
        np.add.at(frequency, near_dedup.df_bucket(h), 1)
    idf = np.log1p(len(norm) / (len(norm) + frequency)).astype(np.float32)
    sets = [(h, c * idf[near_dedup.df_bucket(h)].astype(float)) for _, h, c in parts]
    parent = list(range(len(norm)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(norm)):
        for j in range(i):
            if norm[i] == norm[j] or (len(sets[i][0]) and len(sets[j][0]) and near_dedup.similarity(sets[i], sets[j]) >= threshold):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(norm))]


def family(rng, size, edits):
    base = words(rng, 120)
    out = []
    for _ in range(size):
        w = list(base)
        for _ in range(rng.randint(*edits)):
            w[rng.randrange(len(w))] = "".join(words(rng, 1))
        out.append(" ".join(w))
    return out


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(11)
    texts = [" ".join(words(rng, rng.randint(0, 150))) for _ in range(60)] + family(rng, 60, (0, 4)) + family(rng, 30, (0, 2)) + [None, "", "   ", "few words", "Few  WORDS", "é " * 20000]
    rows = list(enumerate(texts))
    found = {r["doc_id"]: r for r in near_dedup.near_duplicates(docs(spark, rows)).collect()}
    want = classes_by_force(texts)
    assert [found[i]["class_id"] for i in range(len(texts))] == want
    assert sorted(i for i, r in found.items() if r["kept"]) == sorted(set(want))
    assert {i: r["class_size"] for i, r in found.items()} == {i: want.count(c) for i, c in enumerate(want)}


def test_near_dedup_rows(spark):
    rows = [(3, "some words that stand here twice over"), (1, "Some words that  stand here twice over"), (1, "Some words that  stand here twice over"), (None, "another text of several words"), (None, None), (7, "")]
    kept = near_dedup.near_dedup(docs(spark, rows))
    assert kept.columns == docs(spark, rows).columns
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept.collect()) == [(0, "another text of several words"), (1, rows[1][1]), (7, "")]
    assert near_dedup.near_duplicates(docs(spark, rows).limit(0)).count() == 0


def test_rollups(spark, tmp_path):
    store = rollups.RollupStore(spark, str(tmp_path / "store"))
    change = lambda *rows: spark.createDataFrame(list(rows), rollups.CHANGES)
    assert store.totals().count() == 0
    assert store.commit("a", change(("insert", 1, "s", "en", "v1", 10), ("insert", 2, "s", "en", "v1", 5), ("insert", 3, "t", None, "v1", 7), ("insert", 1, "s", "en", "v2", 9), ("insert", None, "s", "en", "v1", None), ("insert", 2, "s", "en", "v1", 4)))
    assert not store.commit("a", change(("insert", 9, "s", "en", "v1", 99)))
    totals = lambda: {(r["source"], r["lang"], r["tokenizer_version"]): (r["n_docs"], r["n_tokens"]) for r in store.totals().collect()}
    assert totals() == {("s", "en", "v1"): (3, 15), ("t", None, "v1"): (1, 7), ("s", "en", "v2"): (1, 9)}
    assert store.commit("b", change(("revise", 1, None, None, "v1", 20), ("revise", 3, "u", "fr", "v1", 8), ("delete", 2, None, None, "v1", None), ("delete", 77, None, None, "v1", None)))
    assert totals() == {("s", "en", "v1"): (2, 20), ("u", "fr", "v1"): (1, 8), ("s", "en", "v2"): (1, 9)}
    assert store.commit("c", change(("delete", 1, None, None, None, None), ("insert", 1, "s", "en", "v1", 3)))
    assert totals() == {("s", "en", "v1"): (1, 0), ("u", "fr", "v1"): (1, 8)}
    assert store.commit("d", change(("insert", 4, "s", "en", "v1", 1)).limit(0)) and store.batches() == ["a", "b", "c", "d"]
    with pytest.raises(Exception, match="unknown op"):
        store.commit("e", change(("upsert", 1, "s", "en", "v1", 1)))
    with pytest.raises(ValueError):
        store.commit("../e", change(("insert", 1, "s", "en", "v1", 1)))


def test_rollups_equal_a_plain_ledger_under_random_changes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(rollups, "COMPACT_EVERY", 3)
    rng, store = random.Random(29), rollups.RollupStore(spark, str(tmp_path / "store"), buckets=4)
    ledger, nameless = {}, Counter()
    for batch in range(7):
        changes = []
        for _ in range(rng.randint(0, 25)):
            op = rng.choice(["insert", "insert", "revise", "delete"])
            i = rng.choice([None, *range(12)]) if op == "insert" else rng.randrange(12)
            version = None if op == "delete" and rng.random() < 0.4 else rng.choice(["v1", "v2"])
            changes.append((op, i, rng.choice(["s", "t", None]), rng.choice(["en", None]), version, rng.choice([None, 1, 2, 3, 50])))
        last = {}
        for op, i, source, lang, version, n in changes:
            if i is None:
                nameless[(source, lang, version)] += 1
                nameless[(source, lang, version, "n")] += n or 0
                continue
            for v in [v for d, v in ledger if d == i] if op == "delete" and version is None else [version]:
                old = ledger.get((i, v), (None, None, 0)) if op == "delete" and version is None else (source, lang)
                rank = (op == "delete", n or 0, old[0] or "", old[1] or "")  # null is the least of strings
                if (i, v) not in last or rank > last[i, v][0]:
                    last[i, v] = rank, (op, old[0], old[1], n or 0)
        for key, (_, (op, source, lang, n)) in last.items():
            old = ledger.pop(key, (None, None, 0))
            if op != "delete":
                ledger[key] = (source or old[0], lang or old[1], n)
        assert store.commit(f"b{batch}", spark.createDataFrame(changes, rollups.CHANGES))
        assert not store.commit(f"b{batch}", spark.createDataFrame(changes, rollups.CHANGES))
        want = defaultdict(lambda: [0, 0])
        for (_, v), (source, lang, n) in ledger.items():
            want[source, lang, v][0] += 1
            want[source, lang, v][1] += n
        for key in [k for k in nameless if len(k) == 3]:
            want[key][0] += nameless[key]
            want[key][1] += nameless[(*key, "n")]
        assert {(r["source"], r["lang"], r["tokenizer_version"]): [r["n_docs"], r["n_tokens"]] for r in store.totals().collect()} == want
        found = {(r["id"], r["version"]): (r["source"], r["lang"], r["n_tokens"]) for r in store.ledger().collect() if r["id"] is not None}
        assert found == ledger
    assert len(store._list("snapshots")) == 1 and len(store._parts()) == 2 and rollups.RollupStore(spark, store.path).buckets == 4


def test_one_writer_at_a_time(spark, tmp_path):
    store = rollups.RollupStore(spark, str(tmp_path / "store"))
    change = spark.createDataFrame([("insert", 1, "s", "en", "v", 2)], rollups.CHANGES)
    (tmp_path / "store" / "lock").touch()
    with pytest.raises(RuntimeError, match="another writer"):
        store.commit("a", change)
    store.unlock()
    assert store.commit("a", change) and not (tmp_path / "store" / "lock").exists()
    with pytest.raises(Exception, match="null id"):
        store.commit("b", spark.createDataFrame([("delete", None, "s", "en", "v", 2)], rollups.CHANGES))
    assert store.batches() == ["a"] and store.commit("b", change.limit(0))


def test_rollup_life(spark, tmp_path):
    rows = [(1, "one text"), (2, "one text"), (3, "other text here"), (4, None), (5, "")]
    found = rollups.token_rollup(docs(spark, rows), str(tmp_path / "s"), JSON, P.PATTERN, "v").collect()
    assert sum(r["n_docs"] for r in found) == 3 and sum(r["n_tokens"] for r in found) == 2 + 3


def test_rollup_totals_hold_every_row(spark, tmp_path):
    rows = [(1, "one text"), (2, "one text"), (2, "one text"), (2, "other text here"), (None, "one text"), (None, "one text"), (None, "here"), (4, None)]
    found = rollups.token_rollup(docs(spark, rows), str(tmp_path / "s"), JSON, P.PATTERN, "v", put_back=True).collect()
    want = defaultdict(lambda: [0, 0])
    for i, text in rows:
        sums = want[f"s{(i or 0) % 4}"]
        sums[0], sums[1] = sums[0] + 1, sums[1] + len((text or "").split())
    assert {r["source"]: [r["n_docs"], r["n_tokens"]] for r in found} == want


def test_language_model(spark):
    rng = random.Random(13)
    tongues = [words(rng, 60) for _ in range(3)]
    rows = [(i, " ".join(rng.choice(tongues[i % 3]) for _ in range(rng.randint(5, 60)))) for i in range(400)] + [(1000, None), (1001, "new words only Here"), (7, "repeated Row"), (7, "repeated Row"), (None, "no id")]
    found = lm.score_documents(docs(spark, rows)).collect()
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    tokens = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", lower(t)), None]
    held = lambda i: i is None or zlib.crc32(str(i).encode()) % 7 == 2
    counts = Counter(w for i, t in rows if not held(i) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    want = Counter()
    for i, t in rows:
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens(t))
        want[(i, held(i), len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), n, round(base, 6))] += 1
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in found) == want
    out = [r for r in found if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 400]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)
    assert lm.score_documents(docs(spark, rows).limit(0)).count() == 0


def test_scores_equal_a_plain_version(spark, monkeypatch):
    """The scores of a trained model, token by token, with the features and both softmaxes written out."""
    rng = random.Random(31)
    rows = [(i, " ".join(rng.choice(["one", "two", "Three", "four,", "five"]) for _ in range(rng.randint(0, 40)))) for i in range(80)] + [(900, None), (901, "é unknown words " * 3), (902, "long " * 30_000)]
    models, broadcast = [], spark.sparkContext.broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: models.append(value) or broadcast(value))
    found = {r["doc_id"]: r["score"] for r in lm.score_documents(docs(spark, rows)).collect()}
    model = [m for m in models if isinstance(m, lm.Model)][-1]
    shape, full = model.shape, (1 << 64) - 1

    def mixed(x):
        for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            x = (x ^ (x >> 33)) * factor & full
        return x ^ (x >> 33)

    def softmax(bias, table, picked, target):
        logits = [float(bias[k]) + sum(float(table[r][k]) for r in picked) for k in range(len(bias))]
        top = max(logits)
        return logits[target] - top - math.log(sum(math.exp(x - top) for x in logits))

    counts = Counter()
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    split = {i: tuple(zip(*[x.tolist() for x in lm.tokens_of([t or ""])[1:]], strict=True)) for i, t in rows}
    for i, tokens in split.items():
        counts.update(h for h, _ in tokens if not held(i))
    top = {int(h): int(c) for h, c in zip(model.top, model.top_class, strict=True)}
    for i, tokens in split.items():
        if len(tokens) > 200:
            continue
        classes = [top.get(h, int(shape.suffix_class(np.array([s]))[0])) for h, s in tokens]
        total = 0.0
        for k, ((h, _), c) in enumerate(zip(tokens, classes, strict=True)):
            one, two = (tokens[k - j][0] if k >= j else j for j in (1, 2))
            c1, c2 = (classes[k - j] if k >= j else shape.classes for j in (1, 2))
            features = [mixed(one ^ 0x11), mixed(two ^ 0x2222), mixed((c1 * (shape.classes + 1) + c2 + 0x333333) & full)]
            up, low = divmod(c, shape.lower)
            shift = 64 - shape.bits
            total += softmax(model.upper_bias, model.upper, [f >> shift for f in features], up)
            total += softmax(model.lower_bias[up], model.lower, [mixed((f + up) & full) >> shift for f in features], low)
            within = max(model.class_n[c], 1) + 1 if c < len(model.top) else model.class_n[c] + model.class_v[c] + 1
            total += math.log((counts[h] + 1) / within)
        assert found[i] == pytest.approx(total / math.log(10), rel=1e-4, abs=1e-4)


def test_slices_are_bounded_by_bytes_and_rows():
    import pyarrow as pa

    texts = ["x" * n for n in (5, 0, 30, 1, 1, 1, 1, 100, 2)] + [None]
    parts = list(common.slices([pa.record_batch([pa.array(texts, pa.string())], ["t"])], 0, 3, 30))
    assert [x for p in parts for x in p.column(0).to_pylist()] == texts
    assert all(p.num_rows <= 3 and (p.num_rows == 1 or sum(map(len, filter(None, p.column(0).to_pylist()))) <= 30) for p in parts)


def test_class_probabilities_sum_to_one():
    rng = np.random.default_rng(17)
    model = lm.Model(np.arange(5, dtype=np.uint64), rng.integers(0, 50, lm.CLASSES).astype(float), np.ones(lm.CLASSES))
    model.upper += rng.normal(size=model.upper.shape).astype(np.float32)
    model.lower += rng.normal(size=model.lower.shape).astype(np.float32)
    features = [np.full(lm.CLASSES, f, np.uint64) for f in (1 << 60, 3 << 58, 5 << 57)]
    total = np.exp(model.log_probabilities(features, np.arange(lm.CLASSES))[0]).sum()
    assert abs(total - 1) < 1e-4


def test_model_grows_with_the_corpus():
    small, large, larger = lm.Shape.of(1000), lm.Shape.of(5 * 10**9), lm.Shape.of(10**13)
    assert small == (32, 32, 14) and small.top_words == 512
    assert large.bits >= 17 and large.top_words >= 2048 and larger.bits > large.bits and larger.top_words > large.top_words
    rng = np.random.default_rng(23)
    shape = lm.Shape(64, 32, 17)
    model = lm.Model(np.arange(9, dtype=np.uint64), np.ones(shape.classes), np.ones(shape.classes), shape)
    hashed = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    cls = model.classes(hashed, rng.integers(0, 1 << 16, 3000))
    features = model.features(np.zeros(3000, np.int64), hashed, cls)
    before = model.log_probabilities(features, cls)[0].sum()
    model.descend(features, cls, (np.ones_like(model.upper), np.ones_like(model.lower)), 0.15)
    assert len(np.flatnonzero(model.upper.any(1))) > 8192  # histories have rows of their own
    assert model.log_probabilities(features, cls)[0].sum() > before
    every = np.arange(shape.classes)
    total = np.exp(model.log_probabilities([np.full(shape.classes, f[7]) for f in features], every)[0]).sum()
    assert abs(total - 1) < 1e-4


EXTRA = "doc_id long, text string, lang string, source string, n_chars long, id long, row string, node string, line string, kept boolean"


def test_pipeline_with_odd_rows(spark, tmp_path):
    """Empty tables, nulls, repeated rows, a very long text, and extra columns whose names clash with internal ones."""
    rng = random.Random(37)
    long = " ".join(words(rng, 60_000))
    line = "A line that stands on all the sites"
    texts = [(i, " ".join(words(rng, 50)) + "\n" + line) for i in range(40)] + [(500, long)] + [(3, None), (None, None), (None, ""), (7, "too short")]
    texts += [(600, "a repeated row " + " ".join(words(rng, 40)))] * 3 + [(None, "a text without id " + " ".join(words(rng, 40)))]
    rows = [(i, t, None if (i or 0) % 5 == 0 else "en", f"s{(i or 0) % 9}", len(t or ""), 1, "r", "n", "l", None) for i, t in texts]
    frame = spark.createDataFrame(rows, EXTRA)
    seen = [frame]
    for _, stage in corpus_pipeline.STAGES:
        seen.append(stage(spark, seen[-1], ""))
        empty = stage(spark, seen[-2].limit(0), "")
        assert empty.count() == 0 and empty.columns == seen[-1].columns
    clean, unlined, single, packed = seen[1:]
    assert all(f.columns == frame.columns for f in seen[1:4])
    ids = lambda rows: sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in rows.collect())
    assert ids(clean) == sorted([*range(40), 500, 600, 600, 600, -1])
    assert ids(single) == sorted([*range(40), 500, 600, -1])
    kept = {r["doc_id"]: r["text"] for r in single.collect()}
    assert kept[500] == long and kept[0].endswith(line) and not kept[1].endswith(line)
    totals = Counter()
    for r in packed.collect():
        totals[r["doc_id"]] += r["length"]
    library = tokens.tokenizer_from_json(JSON)
    assert totals == {i: len(library.encode(t, add_special_tokens=False).ids) + 1 for i, t in kept.items()}


def test_pipeline_packs_empty_texts(spark):
    """A text that has lost all its lines is still a document of the later stages."""
    rows = [(i, "This line is on all of the sites", "en", f"s{i}", 32) for i in range(9)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    unlined = corpus_pipeline.line_stage(spark, frame, "")
    assert {r["text"] for r in unlined.collect() if r["doc_id"]} == {""}
    packed = corpus_pipeline.packing_stage(spark, corpus_pipeline.near_stage(spark, unlined, ""), "").collect()
    assert sorted((r["doc_id"], r["length"] == 1) for r in packed) == [(0, False), (1, True)]


def test_pipeline_workers_give_memory_back(spark):
    """Workers get small Arrow batches and drop their memo of pieces; both change no result."""
    batch = pa.record_batch({"id": [1, 2], "text": ["ein zwei drei", " ".join(f"w{i}" for i in range(500))]})
    encoder = tokens.encoder_for(JSON, P.PATTERN)
    plain, lean = ([x.to_pylist() for x in packing._pieces([batch], JSON, P.PATTERN, 64, 1, True, most)] for most in (None, 100))
    assert plain == lean and not encoder.words and not encoder.pre and not encoder.words.old and not encoder.pre.old
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before, used, pack = spark.conf.get(key), [], corpus_pipeline.pack
    frame = docs(spark, [(i, "a text " * 9) for i in range(3)])
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(corpus_pipeline, "pack", lambda *args, **more: used.append((spark.conf.get(key), more["memo_pieces"])) or pack(*args, **more))
        corpus_pipeline.packing_stage(spark, frame, "")
    assert used == [(str(common.BATCH_BYTES), corpus_pipeline.MEMO_PIECES)] and spark.conf.get(key) == before
    rows = spark.range(0, 3000, 1, 1).select("id", F.repeat(F.lit("x"), 10_000).alias("text"))
    sizes = lambda batches: (pa.record_batch({"n": [b.nbytes]}) for b in batches)
    with common.small_batches(spark):
        most = common.materialise(rows.mapInArrow(sizes, "n long")).agg(F.max("n")).first()[0]
    assert most < 2 * common.BATCH_BYTES


def test_pipeline(spark):
    rng = random.Random(19)
    line = "This line is on all of the sites"
    texts = [" ".join(words(rng, 60)) + "\n" + line for _ in range(60)]
    rows = [(i, t, "en", f"s{i % 9}", len(t)) for i, t in enumerate(texts)]
    rows += [(100 + i, t + " more", "en", "s1", 1) for i, t in enumerate(texts[:5])] + [(200, "short", "en", "s1", 5), (201, None, None, None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    seen = [frame]
    for _, stage in corpus_pipeline.STAGES:
        seen.append(stage(spark, seen[-1], ""))
    clean, unlined, single, packed = seen[1:]
    assert all(f.columns == frame.columns for f in seen[1:4])
    assert {r["doc_id"] for r in clean.collect()} == {*range(60), *range(100, 105)}
    assert unlined.filter(F.contains("text", F.lit(line))).filter(~F.endswith("text", F.lit("more"))).count() == 1
    assert {r["doc_id"] for r in single.collect()} == set(range(60))
    per_doc = defaultdict(int)
    for r in packed.collect():
        per_doc[r["doc_id"]] += r["length"]
        assert r["offset"] + r["length"] <= 2048
    assert set(per_doc) == set(range(60))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "packing"]
