"""Extraction, line dedup, quality rules, exact dedup and encodings against plain versions, with odd inputs."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from hatlake.llm import bpe, exact_dedup, html_extract, line_dedup, packing, quality, tokens

DOC = "doc_id long, text string, lang string, source string, n_chars long, row string, words string"
JSON, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken")


def docs(spark, rows):
    """Rows (id, text[, lang, source]) with extra columns whose names clash with internal ones."""
    full = [(r[0], r[1], *(r[2:] or ("en", "s")), len(r[1] or ""), "x", "y") for r in rows]
    return spark.createDataFrame(full, DOC)


ODD = [(1, "a b  c"), (2, "a b\tc"), (3, None), (4, ""), (5, "a b c"), (5, "a b c"), (None, "a b c"), (None, None), (9, "é " * 30000), (10, "日本 😀"), (11, "<|endoftext|> x")]


def test_main_text():
    cut = html_extract.main_text
    page = "<html><body><nav><a href=/>Home</a></nav><div class='sidebar'>Side text.</div><div class='content'><h1>T &amp; u</h1><p>One,\n two.<p>Three &lt;b&gt;.<br>Four.</div><div id=comments><p>Nice, really nice.</p></div><div class='cookie-notice'>We use cookies.</div><form>Find</form><script>var a='</p>';</script><footer>&copy;</footer></body></html>"
    assert cut(page) == "T & u\n\nOne, two.\n\nThree <b>. Four."
    article = "<body><div class=ad>Buy, now.</div><article><h1>H</h1><p><b>Bold<br><p>Para</p><aside>no</aside></article><p>Outside text, long enough to count as text.</p>"
    assert cut(article) == "H\n\nBold\n\nPara"
    assert [cut(x) for x in (None, "", "<p>", "<script>x", "plain", "<p>a<", "<!-- c --")] == ["", "", "", "", "plain", "a<", ""]


@pytest.mark.parametrize("opening", ["<div class='wrapper no-sidebar'>", "<div class='content has-sidebar'>", "<div class='post comments-open'>", "<div class=menu-open>", "<div id=legal>", "<form action=/>", "<aside>", "<div role=dialog>", "<span class=comments>"])
def test_marks_are_votes(opening):
    tag = re.match(r"<(\w+)", opening).group(1)
    body = "<p>The first paragraph has words, and more words.</p><p>The second one, too, is long enough.</p>"
    want = "The first paragraph has words, and more words.\n\nThe second one, too, is long enough."
    around = "<nav><a href=/>Home</a></nav>{}<div class=ad>Buy, now.</div>"
    for inner in (f"<article>{body}</article>", f"<main>{body}</main>", f"<div>{body}</div>"):
        assert html_extract.main_text(f"<body>{around.format(opening + inner + f'</{tag}>')}</body>") == want
    assert html_extract.main_text(f"<body><div class=text>{body}</div>{opening}<article>Teaser</article></{tag}></body>").startswith(want)


def test_marked_inline_text_stays_if_it_is_the_most():
    assert html_extract.main_text("<p>Short.</p><p><span class=notice>A long notice that is all there is on this page.</span></p>") == "Short.\n\nA long notice that is all there is on this page."


def test_scores_select_blocks():
    long = [f"Paragraph {i} has a number of words, some commas, and two sentences. It goes on like this for a while, as texts do." for i in range(8)]
    body = "<h1>Heading</h1>" + "".join(f"<p>{x}</p>" for x in long) + "<p>Short one.</p>"
    want = "\n\n".join(["Heading", *long, "Short one."])
    # Neither has a mark or a link.
    assert html_extract.main_text(f"<body><div>{body}<div class=x1>Open daily</div><div class=x1>Buy here</div></div></body>") == want


STORY = [f"Paragraph {i} of the story has a number of words, some commas, and two sentences. It goes on for a while, as texts do." for i in range(6)]


def paragraphs(texts):
    return "".join(f"<p>{x}</p>" for x in texts)


def test_names_only_lower_scores():
    for name in ("legal", "social-history"):
        page = f"<body><nav><a href=/>Home</a></nav><div class=content><h1>Title</h1>{paragraphs(STORY)}<p class='{name}'>{STORY[0]} Really.</p><div class='{name}'>{STORY[1]} Indeed.</div></div></body>"
        assert html_extract.main_text(page) == "\n\n".join(["Title", *STORY, f"{STORY[0]} Really.", f"{STORY[1]} Indeed."])


def test_reader_comments_go():
    thread = "".join(f"<li><b>Reader {i}</b><p>I have read this, and I think that it is a fine story. More of it, please!</p></li>" for i in range(12))
    for around in ("div class=story", "article", "main", "div id=x"):
        page = f"<body><{around}><h1>Title</h1>{paragraphs(STORY)}</{around.split()[0]}><h3>Comments</h3><ol class=thread>{thread}</ol></body>"
        assert html_extract.main_text(page) == "\n\n".join(["Title", *STORY])
    page = f"<body><article><h1>Title</h1>{paragraphs(STORY)}<h3>Comments</h3><ol class=thread>{thread}</ol></article></body>"
    assert html_extract.main_text(page) == "\n\n".join(["Title", *STORY])


def test_scores_select_inside_and_outside_articles():
    links = "".join(f"<li><a href=/{i}>Another of our stories, number {i}</a></li>" for i in range(9))
    assert html_extract.main_text(f"<body><article><ul>{links}</ul></article><div class=text>{paragraphs(STORY)}</div></body>") == "\n\n".join(STORY)
    page = f"<body><article>{paragraphs(STORY[:3])}<ul>{links}</ul>{paragraphs(STORY[3:])}<p>Short.</p><div class=ad>Buy, now.</div></article></body>"
    assert html_extract.main_text(page) == "\n\n".join([*STORY, "Short."])


def test_short_articles_and_long_surroundings():
    comments = "".join(f"<div class=comment><b>user{i}</b><p>I think this is quite wrong, and here is why: it is long. I do not agree at all!</p></div>" for i in range(30))
    foot = "<footer><p>Copyright by us. All rights reserved, of course, by all of us here.</p></footer>"
    page = "<body><nav><a href=/>Home</a></nav><div class=ad>Buy this now, it is cheap and good.</div><article><p>{}</p></article>{}</body>"
    assert [html_extract.main_text(page.format(x, foot)) for x in ("x", "Two words")] == ["x", "Two words"]
    section = f"<section id=comments><h2>30 Comments</h2>{comments}</section>"
    for inner in (f"<article><h1>T</h1>{paragraphs(STORY)}{section}</article>", f"<article><h1>T</h1>{paragraphs(STORY)}</article>{section}"):
        assert html_extract.main_text(f"<body>{inner}{foot}</body>") == "\n\n".join(["T", *STORY])
    table = "<ul><li>Milk</li><li>Salt</li></ul><table><tr><th>Year</th><th>Sum</th></tr><tr><td>1999</td><td>12</td></tr></table>"
    page = f"<body><article>{paragraphs(STORY)}{table}<div class=notice>This is old, be aware. It may be wrong.</div></article></body>"
    assert html_extract.main_text(page) == "\n\n".join([*STORY, "Milk", "Salt", "Year", "Sum", "1999", "12"])


def test_marked_inline_text_goes_and_its_paragraph_stays_whole():
    page = f"<body><div>{paragraphs(STORY)}<p>Words before it, <span class=ad>Buy!</span> and <i>words</i> after.</p></div></body>"
    assert html_extract.main_text(page) == "\n\n".join([*STORY, "Words before it, and words after."])


def test_path_scores_equal_a_plain_version():
    """Paths from another parser, and the ratios, smoothing and fusion written out."""
    import html.parser
    import math

    class Plain(html.parser.HTMLParser):
        def __init__(self):
            super().__init__()
            self.open, self.found, self.link = [], [], 0

        def handle_starttag(self, tag, attrs):
            if tag == "a":
                self.link += 1
            else:
                self.open.append(".".join([tag, *re.findall("[a-z]+", dict(attrs).get("class", ""))]))

        def handle_endtag(self, tag):
            if tag == "a":
                self.link -= 1
            else:
                self.open.pop()

        def handle_data(self, data):
            self.found.append((tuple(self.open), data, len(data) if self.link else 0))

    rng = random.Random(12)
    for _ in range(50):
        def node(depth):
            if depth == 0 or rng.random() < 0.3:
                text = " ".join(rng.choice(["word", "two,", "end.", "x!"]) for _ in range(rng.randint(1, 30)))
                return f"<p>{text}</p>" if rng.random() < 0.8 else f"<p><a href=/>{text}</a></p>"
            kind = rng.choice(["div", "section", "div class='a b'", "ul", "blockquote"])
            return f"<{kind}>{''.join(node(depth - 1) for _ in range(rng.randint(1, 4)))}</{kind.split()[0]}>"

        page = f"<html><body>{node(4)}</body></html>"
        plain = Plain()
        plain.feed(page)
        groups = defaultdict(list)
        for path, text, linked in plain.found:
            groups[path].append((len(text), sum(c in ".,!" for c in text), linked))
        mean = lambda path, k: sum(x[k] for x in groups[path]) / len(groups[path])
        ratio = [math.log(1 + mean(path, 0) * (1 + mean(path, 1))) for path, _, _ in plain.found]
        smooth = []
        for i in range(len(ratio)):
            near = [(math.exp(-(j - i) ** 2 / 2), ratio[j]) for j in range(max(0, i - 3), min(len(ratio), i + 4))]
            smooth.append(sum(w * r for w, r in near) / sum(w for w, _ in near))
        want = []
        for i, (path, _, _) in enumerate(plain.found):
            along = [s for s, other in zip(smooth, plain.found, strict=True) if other[0] == path]
            links = mean(path, 2) / mean(path, 0)
            want.append((ratio[i] + sum(along) / len(along)) / 2 * (0.1 + 0.9 * (1 - links)))
        elements, blocks = html_extract.parse(page)
        assert [b.text for b in blocks] == [t for _, t, _ in plain.found]
        scores = html_extract.path_scores([elements[b.element].path for b in blocks], blocks, [1.0] * len(blocks))
        assert scores == pytest.approx(want)


@pytest.mark.parametrize("piece", ["<div>text, a ", "<div>", "<span class=ad>x", "<ul><li>x", "<table><tr><td>x", "<a title='x", "<p><div></section>", "<dl><dt>a<dd>b", "</p></div>"])
def test_time_is_proportional_to_the_page(piece):
    import time

    def took(n):
        begun = time.process_time()
        html_extract.main_text(piece * n)
        return time.process_time() - begun

    took(1000)
    assert took(10_000) < 0.5 and took(20_000) < 1


def test_a_very_long_page(spark):
    long = [f"{x} Part {i}." for i in range(2000) for x in STORY]
    rows = spark.createDataFrame([(1, "u", f"<body><nav><a href=/>Home</a></nav><div>{paragraphs(long)}</div></body>", "clash", "clash")], "page_id long, url string, html string, text string, id string")
    assert [r["text"] for r in html_extract.extract_main_text(rows).collect()] == ["\n\n".join(long)]


def test_main_text_rows(spark):
    rows = spark.createDataFrame([(1, "u", "<p>x"), (1, "u", "<p>x"), (None, None, None)], "page_id long, url string, html string")
    assert sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in html_extract.extract_main_text(rows).collect()) == [(0, "", 0), (1, "x", 1), (1, "x", 1)]
    assert html_extract.extract_main_text(rows.limit(0)).count() == 0


def test_exact_duplicates(spark):
    rows = ODD + [(i, f"same  text {i % 3}") for i in range(100, 400)]
    found = exact_dedup.exact_duplicates(docs(spark, rows), partitions=7).collect()
    groups = defaultdict(list)
    for i, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", text or "")].append(i)
    assert len(found) == len(rows)
    wanted = Counter()
    for text, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        for i in ids:
            wanted[(i, keep, len(ids), hashlib.sha256(text.encode()).hexdigest())] += 1
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in found) == wanted
    kept = [r for r in found if r["kept"]]
    assert len(kept) == len(groups) and all(r["doc_id"] == r["keep_id"] for r in kept)
    assert exact_dedup.exact_duplicates(docs(spark, ODD).limit(0)).count() == 0


def plain_features(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_features(spark):
    rng = random.Random(4)
    texts = [None, "", "a\n a\na\n\n", "x " * 500] + ["".join(rng.choice(["a", "b", "é", " ", "\n", "#", "\x0b", "日"]) for _ in range(rng.randint(0, 80))) for _ in range(200)]
    rows = docs(spark, list(enumerate(texts)))
    found = {r["doc_id"]: r for r in quality.quality_report(rows).collect()}
    for i, text in enumerate(texts):
        r = found[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == plain_features(text), repr(text)
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
    assert quality.quality_report(rows.limit(0)).count() == 0


def test_quality_keeps_clean_and_drops_junk(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8)))
    clean = [(i, " ".join(word() for _ in range(60)), None if i % 9 == 0 else "en", f"s{i % 3}") for i in range(900)]
    junk = [(1000 + i, " ".join(word() + "***" for _ in range(60)), "en", "s1") for i in range(40)]
    rows = docs(spark, clean + junk)
    kept = quality.quality_filter(rows)
    assert kept.columns == rows.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, *_ in clean}


def test_every_fence_rejects_planted_junk(spark):
    rng = random.Random(6)
    word = lambda low=3, high=8: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(low, high)))
    clean = [(i, "\n".join(" ".join(word() for _ in range(12)) for _ in range(8)), "en", "s1") for i in range(400)]
    # A source of its own kind, where one character of ten is a symbol: its own quantiles let it stay.
    tables = [(1000 + i, " ".join(f"{word()} |" if rng.random() < 0.7 else word() for _ in range(60)), "en", "tables") for i in range(300)]
    lines = [" ".join(word() for _ in range(2)) for _ in range(12)]
    repeat = [word() for _ in range(8)]
    junk = {
        "symbol_ratio": " ".join(word() + "%" for _ in range(60)), "word_length": " ".join(word(25, 30) for _ in range(60)),
        "dup_line_ratio": "\n".join(x for x in lines for _ in range(3)), "repeat_ratio": " ".join(repeat + [word() for _ in range(40)] + repeat + [word() for _ in range(40)]),
        "short words": " ".join(rng.choice("abcdefghij") for _ in range(60)),
    }
    rows = docs(spark, clean + tables + [(5000 + i, text, "en", "s1") for i, text in enumerate(junk.values())])
    found = quality.quality_report(rows).collect()
    assert {r["doc_id"] for r in found if r["kept"]} == {i for i, *_ in clean + tables}
    assert not any(r["base_failed"] for r in found if r["doc_id"] >= 5000)


def test_sketch_bins(spark):
    values = [0, 1, 127, 128, 129, 255, 1000, 123456, 10**12]
    found = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v long").select(quality.bin_of(F.col("v"))).collect()]
    assert all(b <= v and (v - b) * 64 <= v and (v >= 128 or b == v) for v, b in zip(values, found, strict=True))


def test_boilerplate_lines(spark):
    line = "Click here to read the rest"
    rows = [(i, f"own line number {i} here\n{line}\nok{i}", "en", f"site{i % 8}") for i in range(40)]
    rows += [(i, f"shared by few sites only\nbody {i} text here", "en", f"site{i % 5}") for i in range(100, 140)]
    rows += [(500, None, "en", None), (501, "", "en", "site1"), (502, line, "en", None), (None, f"{line}\nx", "en", "q"), (0, rows[0][1], "en", "site0")]
    frame = docs(spark, rows)
    out = line_dedup.drop_boilerplate(frame)
    assert out.columns == frame.columns and out.count() == len(rows)
    found = defaultdict(list)
    for r in out.collect():
        found[r["doc_id"]].append((r["text"], r["n_chars"]))
    assert found[0] == [(rows[0][1], len(rows[0][1]))] * 2  # the first document keeps it, and so does its repeated row
    assert found[7] == [("own line number 7 here\nok7", 26)]
    assert found[100][0][0] == rows[40][1] and found[500] == [(None, 0)] and found[502] == [("", 0)] and found[None] == [("x", 1)]
    assert line_dedup.drop_boilerplate(frame.limit(0)).count() == 0


def test_near_limit_lines_are_counted_exactly(spark):
    rows = [(n * 100 + i, f"a line on exactly {n} sites", "en", f"s{i}") for n in range(3, 10) for i in range(n)]
    lost = {r["doc_id"] // 100 for r in line_dedup.drop_boilerplate(docs(spark, rows)).filter("text = ''").collect()}
    assert lost == {6, 7, 8, 9}


def test_short_lines_need_more(spark):
    long = "All of our content is free"
    rows = [(i, f"{long}\n\nShare.\nbody of number {i} is here", "en", f"s{i % 8}") for i in range(24)]  # beside it
    rows += [(100 + i, f"own first line number {i}\nOf course.\nown last line {i}", "en", f"s{i % 20}") for i in range(40)]  # 20 sites
    rows += [(200 + i, f"some first line number {i}\nSee also.\nsome last line {i}", "en", f"s{i % 8}") for i in range(40)]  # 8 sites only
    rows += [(300 + i, f"a first line number {i}\nShare.\na last line {i}", "en", f"s{i % 20}") for i in range(40)]  # alone
    found = {r["doc_id"]: r["text"] for r in line_dedup.drop_boilerplate(docs(spark, rows)).collect()}
    assert found[0] == rows[0][1] and found[23] == "\nbody of number 23 is here"
    assert found[139] == "own first line number 39\nown last line 39" and found[239] == rows[103][1] and found[339] == rows[143][1]


def test_line_dedup_of_a_very_long_text(spark):
    line = "Click here to read the rest"
    rows = [(i, line, "en", f"s{i}") for i in range(8)] + [(50, "\n".join(f"{line}\nown line {i} of many" for i in range(50_000)), "en", "s1")]
    found = {r["doc_id"]: r["text"] for r in line_dedup.drop_boilerplate(docs(spark, rows)).collect()}
    assert found[50] == "\n".join(f"own line {i} of many" for i in range(50_000))


def test_lines_joined_without_a_broadcast(spark, monkeypatch):
    rows = [(i, f"a line of many sites\nown {i}\nOf it.", "en", f"s{i % 13}") for i in range(60)]
    plain = sorted(line_dedup.drop_boilerplate(docs(spark, rows)).collect())
    monkeypatch.setattr(line_dedup, "BROADCAST_LINES", -1)
    assert sorted(line_dedup.drop_boilerplate(docs(spark, rows)).collect()) == plain


def tiktoken_encoding():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=tokens.read_ranks(RANKS), special_tokens={})


def test_encoder_equals_other_library():
    rng, other = random.Random(6), tiktoken_encoding()
    parts = [" ", "  ", "\n", "\t", "a", "word", "'s", "é", "日", "😀", "12", "!", "…", "<|endoftext|>", " ", " ", "\x0b", "\r\n", "It's", "\x00", "."]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    library = tokens.tokenizer_from_json(JSON)
    for path, plain in ((RANKS, other.encode_ordinary), (JSON, lambda text: library.encode(text, add_special_tokens=False).ids)):
        encoder = tokens.encoder_for(path, P.PATTERN)
        for low in range(0, len(texts), 500):
            for text, ids in zip(texts[low : low + 500], encoder.encode_batch(texts[low : low + 500]), strict=True):
                assert list(memoryview(ids).cast("I")) == plain(text)
                assert encoder.decode_bytes(ids).decode() == text


def test_added_tokens_are_the_librarys():
    encoder = tokens.encoder_for(JSON, P.PATTERN)
    for text in ["<|endoftext|> x", "a <|endoftext|><|endoftext|>\n\n  é", "<|endoftext", "plain  text\n", " "]:
        ids = np.frombuffer(encoder.encode_batch([text])[0], "<u4").tolist()
        assert ids == encoder.tokenizer.encode(text, add_special_tokens=False).ids
        assert encoder.decode_bytes(np.array(ids, "<u4").tobytes()).decode() == text


def test_offsets_and_split_characters():
    encoder = tokens.encoder_for(RANKS, P.PATTERN)
    text = "né 😀日"
    ids = encoder.encode_batch([text])[0]
    spans = encoder.offsets(ids)
    assert spans[0][0] == 0 and spans[-1][1] == len(text) and all(b > a for a, b in spans)
    decoder = tokens.StreamDecoder(encoder)
    assert "".join(decoder.feed(ids[i : i + 4]) for i in range(0, len(ids), 4)) + decoder.feed(b"", final=True) == text


def test_encode_and_decode_rows(spark):
    rows = docs(spark, ODD)
    found = bpe.encode(rows, RANKS, P.PATTERN, offsets=True, digests=True)
    other = tiktoken_encoding()
    for r in found.collect():
        assert len(r["ids"]) == r["n_tokens"] == len(r["char_start"])
    want = Counter((i, len(other.encode_ordinary(t or "")), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in ODD)
    assert Counter((r["doc_id"], r["n_tokens"], r["decoded_sha256"]) for r in found.collect()) == want
    digest = lambda t: hashlib.sha256(np.array(other.encode_ordinary(t), "<u4").tobytes()).hexdigest()
    assert Counter((r["doc_id"], r["ids_sha256"]) for r in found.collect()) == Counter((i, digest(t or "")) for i, t in ODD)
    back = bpe.decode(found.select("doc_id", "ids"), RANKS, P.PATTERN)
    assert Counter((r["doc_id"], r["text"]) for r in back.collect()) == Counter((i, t or "") for i, t in ODD)


def test_first_fit_decreasing_is_first_fit():
    import numpy as np

    rng = np.random.default_rng(7)
    for n in (0, 1, 2, 37, 300):
        lengths = rng.integers(1, 65, n)
        bins, offsets = packing.first_fit_decreasing(lengths, 64)
        free, want = [], {}
        for i in np.argsort(-lengths, kind="stable"):
            at = next((b for b, f in enumerate(free) if f >= lengths[i]), None)
            if at is None:
                at = len(free)
                free.append(64)
            want[i] = (at, 64 - free[at])
            free[at] -= lengths[i]
        assert {i: (bins[i], offsets[i]) for i in range(n)} == want


def test_pack(spark):
    rng = random.Random(8)
    rows = ODD + [(90, "one very long text of many sequences " * 4000), (91, "<|endoftext|> in a text"), (91, "<|endoftext|> in a text")]
    rows += [(i, " ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(rng.randint(0, 3000)))) for i in range(100, 160)]
    pieces = packing.pack(docs(spark, rows), JSON, P.PATTERN, group_pieces=40, with_ids=True).collect()
    encoder = tokens.encoder_for(JSON, P.PATTERN)
    total = sum(len(x) // 4 + 1 for x in encoder.encode_batch([t or "" for _, t in rows]))
    assert sum(p["length"] for p in pieces) == total
    # against the library itself: where each piece begins, its ids and their checksum
    library, want = tokens.tokenizer_from_json(JSON), Counter()
    for i, t in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        for start in range(0, len(ids), 2048):
            piece = ids[start : start + 2048]
            want[(i, start, len(piece), zlib.crc32(np.array(piece, "<u4").tobytes()), len(ids), tuple(piece))] += 1
    assert Counter((p["doc_id"], p["start"], p["length"], p["ids_crc32"], p["doc_tokens"], tuple(p["ids"])) for p in pieces) == want
    by = defaultdict(list)
    for p in pieces:
        by[p["sequence_id"]].append(p)
    for parts in by.values():
        at = 0
        for p in sorted(parts, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 2048
    assert sum(2048 for _ in by) < 1.2 * total + 2048 * 4
    frame = spark.createDataFrame([tuple(p) for p in pieces], "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids array<int>, sequence_id long, offset long")
    made = packing.sequences(frame).collect()
    assert len(made) == len(by) and all(len(r["ids"]) == 2048 or len(r["ids"]) & (len(r["ids"]) - 1) == 0 for r in made)
    assert packing.pack(docs(spark, ODD).limit(0), JSON, P.PATTERN).count() == 0


@pytest.mark.parametrize("body", [b"", b"x", b"0\r\n\r\n" * 9, bytes(range(256)) * 100])
def test_chunk_framing(body):
    from hatlake.llm import warc

    assert warc.unframe_chunks(warc.frame_chunks(body, 100)) == body
    framed = warc.frame_chunks(body, 100)
    with pytest.raises(ValueError):
        warc.unframe_chunks(framed[:-5] if not body else framed[: len(framed) // 2])
