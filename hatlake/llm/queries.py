"""The queries of this subpackage, by name, and their oracle SQL."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession

from .common import ship_package, table


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extract import extract_main_text

    return extract_main_text(table(spark, sf_dir, "pages"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import drop_boilerplate

    return drop_boilerplate(table(spark, sf_dir, "documents")).select("doc_id", "text", "lang", "source", "n_chars")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_report

    return quality_report(table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import delete_path, shared_path
    from .warc import page_report

    path = shared_path(spark, "warc")
    report = page_report(table(spark, sf_dir, "pages"), path)
    delete_path(spark, path)  # all that was read from the archives is checkpointed
    return report


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as vocabularies

    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), vocabularies.path("byte_bpe_50k.json"), vocabularies.PATTERN)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_duplicates

    return exact_duplicates(table(spark, sf_dir, "documents"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as vocabularies

    from .bpe import encode

    return encode(table(spark, sf_dir, "documents"), vocabularies.path("byte_bpe_50k.tiktoken"), vocabularies.PATTERN, ids=False, digests=True)


def op9_token_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as vocabularies

    from .common import delete_path, materialise, shared_path
    from .rollups import token_rollup

    path = shared_path(spark, "rollups")
    totals = materialise(token_rollup(table(spark, sf_dir, "documents"), path, vocabularies.path("byte_bpe_50k.json"), vocabularies.PATTERN, "byte_bpe_50k", put_back=True))
    delete_path(spark, path)
    return totals


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm import score_documents

    return score_documents(table(spark, sf_dir, "documents"))


def _shipped(query):
    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return query(spark, sf_dir)

    return run


def queries():
    return {name: _shipped(f) for name, f in globals().items() if name.startswith("op")}


# Base 32 of a SHA-1: five hexadecimal digits are four characters.
OP4_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, octet_length(body)::BIGINT AS payload_bytes, sha1(body) AS hex FROM p),
b AS (SELECT *, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(hex, 1 + 5 * (i // 4)::INT, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31), 1)), '') AS payload_digest FROM d),
m AS (SELECT hex, max(page_id) AS top FROM d GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE
 WHEN page_id <> top THEN top END AS refers_to, true AS ok FROM b JOIN m USING (hex)
"""

NORMALISED = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')"

OP6_SQL = f"""
WITH n AS (SELECT doc_id, sha256({NORMALISED}) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM n JOIN g USING (text_sha256)
"""


OP2_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, * FROM documents),
l AS (SELECT k, doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) AS raw, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM d),
n AS (SELECT k, doc_id, coalesce('s' || source, 'none') AS site, raw, i, trim(regexp_replace(raw, '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS line FROM l),
e AS (SELECT k, doc_id, site, i, line, len(string_split(line, ' ')) AS words, lag(line) OVER o AS above, lead(line) OVER o AS below
  FROM n WHERE line <> '' WINDOW o AS (PARTITION BY k ORDER BY i)),
b AS (SELECT line, min(doc_id) AS first_id FROM e WHERE words > 1 GROUP BY line HAVING count(DISTINCT site) >= CASE WHEN max(words) >= 4 THEN 6 ELSE 12 END),
s AS (SELECT k, doc_id, site, i, line FROM e WHERE words < 4 AND (above IN (SELECT line FROM b) OR below IN (SELECT line FROM b))),
c AS (SELECT line, min(doc_id) AS first_id FROM s GROUP BY line HAVING count(DISTINCT site) >= 6),
x AS (SELECT k, i FROM e JOIN b USING (line) WHERE doc_id IS DISTINCT FROM first_id UNION SELECT k, i FROM s JOIN c USING (line) WHERE doc_id IS DISTINCT FROM first_id),
t AS (SELECT k, string_agg(raw, chr(10) ORDER BY i) AS text, count(*) AS n FROM n ANTI JOIN x USING (k, i) GROUP BY k)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(t.text, '') END AS text, d.lang, d.source,
  CASE WHEN coalesce(t.n, 0) = len(string_split(coalesce(d.text, ''), chr(10))) THEN d.n_chars ELSE length(coalesce(t.text, '')) END AS n_chars FROM d LEFT JOIN t ON d.k = t.k
"""

OP3_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
c AS (SELECT k, doc_id, lang, source, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
w AS (SELECT k, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM c),
g AS (SELECT k, i, w || chr(1) || lead(w, 1) OVER o || chr(1) || lead(w, 2) OVER o || chr(1) || lead(w, 3) OVER o || chr(1) || lead(w, 4) OVER o AS g
  FROM w WINDOW o AS (PARTITION BY k ORDER BY i)),
r AS (SELECT k, i FROM g WHERE g IS NOT NULL QUALIFY count(*) OVER (PARTITION BY k, g) > 1),
s AS (SELECT k, sum(least(5, coalesce(gap, 5))) AS n FROM (SELECT k, lead(i) OVER (PARTITION BY k ORDER BY i) - i AS gap FROM r) GROUP BY k),
b AS (SELECT c.k, doc_id, lang, source, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
  length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, len(lines) AS n_lines,
  coalesce(s.n, 0)::BIGINT AS n_repeat_words FROM c LEFT JOIN s ON c.k = s.k),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, 1000 * n_symbols // greatest(word_chars, 1) AS symbol_ratio,
  100 * word_chars // greatest(n_words, 1) AS word_length, 1000 * n_dup_lines // greatest(n_lines, 1) AS dup_line_ratio,
  1000 * n_repeat_words // greatest(n_words, 1) AS repeat_ratio FROM b),
m AS (UNPIVOT (SELECT k, lang, source, symbol_ratio, word_length, dup_line_ratio, repeat_ratio FROM f WHERE NOT base_failed)
  ON symbol_ratio, word_length, dup_line_ratio, repeat_ratio INTO NAME ratio VALUE v),
x AS (SELECT lang, source, ratio, (v >> greatest(length(bin(v)) - 7, 0)) << greatest(length(bin(v)) - 7, 0) AS v FROM m),
lv AS (SELECT 0 AS level, lang, source, ratio, v FROM x UNION ALL SELECT 1, lang, NULL, ratio, v FROM x UNION ALL SELECT 2, NULL, NULL, ratio, v FROM x),
h AS (SELECT level, lang, source, ratio, v, count(*) AS n FROM lv GROUP BY ALL),
u AS (SELECT *, sum(n) OVER (PARTITION BY level, lang, source, ratio ORDER BY v) AS upto, sum(n) OVER (PARTITION BY level, lang, source, ratio) AS total FROM h),
q AS (SELECT level, lang, source, ratio, max(total) AS total, min(v) FILTER (4 * upto >= total) AS q1, min(v) FILTER (2 * upto >= total) AS q2,
  min(v) FILTER (4 * upto >= 3 * total) AS q3, min(v) FILTER (100 * upto >= 99 * total) AS q99 FROM u GROUP BY ALL),
fe AS (SELECT level, lang, source, ratio,
  CASE ratio WHEN 'symbol_ratio' THEN q3 + 3 * greatest(q3 - q1, 5) WHEN 'word_length' THEN q3 + 10 * greatest(q3 - q1, 5)
    WHEN 'dup_line_ratio' THEN q99 + greatest(q99 - q2, 100) ELSE q99 + greatest(q99 - q2, 40) END AS high,
  CASE WHEN ratio = 'word_length' THEN q1 - 10 * greatest(q3 - q1, 5) END AS low FROM q WHERE level = 2 OR total >= 200),
bad AS (SELECT DISTINCT f.k FROM f JOIN (SELECT k, ratio AS r, v AS val FROM m) u ON f.k = u.k
  LEFT JOIN fe a ON a.level = 0 AND a.lang IS NOT DISTINCT FROM f.lang AND a.source IS NOT DISTINCT FROM f.source AND a.ratio = u.r
  LEFT JOIN fe l ON l.level = 1 AND l.lang IS NOT DISTINCT FROM f.lang AND l.ratio = u.r
  LEFT JOIN fe z ON z.level = 2 AND z.ratio = u.r
  WHERE u.val > coalesce(a.high, l.high, z.high) OR u.val < coalesce(a.low, l.low, z.low))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, symbol_ratio, word_length, dup_line_ratio, repeat_ratio,
  NOT base_failed AND NOT EXISTS (SELECT 1 FROM bad WHERE bad.k = f.k) AS kept FROM f
"""


def oracle_sql():
    return {"op2_line_dedup": OP2_SQL, "op4_warc": OP4_SQL, "op3_quality_rules": OP3_SQL, "op6_exact_dedup": OP6_SQL}
