"""Cross-site line dedup, in DataFrame functions only.

A line that stands on many distinct sites is boilerplate. Each line's 64-bit hash gets a HyperLogLog
sketch of the sites it stands on; sketches are built in every task and merged by aggregation. Lines
whose estimate is surely below the limit are done with; those near the limit get an exact distinct
count, so the decision is exact. A boilerplate line stays in the document with the smallest id only.

Short lines repeat by chance, so more is asked of them: lines of two or three words must stand on
more sites, or, like lines of one word, beside a boilerplate line on as many sites as others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, text_of

#: A line on as many distinct sites is boilerplate.
LEAST_SITES = 6
#: Lines of fewer words are short, and a short line of two words or more needs this many times the sites.
LONG_WORDS, SHORT_TIMES = 4, 2
#: log2 of the sketch's registers. Its standard error is about 1.04 / sqrt(2 ** k).
LG_K = 10
#: An estimate this share away from the limit (over four standard errors) is near it.
NEAR = 0.14
#: Boilerplate lines that are broadcast, 16 bytes each; more are joined by a shuffle in which each line is dealt SALT ways.
BROADCAST_LINES, SALT = 200_000, 16

SPACES = r"[\x20\x09-\x0D]+"


def normal_line(line: Column) -> Column:
    return F.trim(F.regexp_replace(line, SPACES, " "))


def lines_of(text: Column) -> Column:
    """Number, hash and number of words of each \\n-split line that has a word."""
    plain = F.transform(F.split(text, "\n"), normal_line)
    # A normal line of n words has n - 1 spaces.
    n_words = lambda x: F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1
    found = F.transform(plain, lambda x, i: F.when(x != "", F.struct(i.alias("at"), F.xxhash64(x).alias("line"), n_words(x).alias("words"))))
    return F.filter(found, lambda x: x.isNotNull())


def boilerplate_lines(lines: DataFrame) -> DataFrame:
    """``line`` and ``first_id`` of the lines on at least ``need`` distinct sites.

    ``lines`` has line, need (the same wherever a line stands), site and id. Null sites are one site of their own.
    """
    site = F.coalesce(F.concat(F.lit("s"), F.col("site")), F.lit("none"))
    sketched = lines.groupBy("line").agg(F.hll_sketch_agg(site, F.lit(LG_K)).alias("sketch"), F.min("id").alias("first_id"), F.max("need").alias("need"))
    estimate = F.hll_sketch_estimate("sketch")
    known = materialise(sketched.select("line", "first_id", "need", estimate.alias("sites")).filter(F.col("sites") >= F.col("need") * (1 - NEAR)))
    sure = known.filter(F.col("sites") > F.col("need") * (1 + NEAR))
    near = known.filter(F.col("sites") <= F.col("need") * (1 + NEAR)).select(F.col("line").alias("near_line"), F.col("need").alias("near_need"), "first_id")
    # Only lines near the limit are counted exactly: distinct (line, site) pairs, then a count of them.
    found = _with_lines(lines.select("line", "id", site.alias("site")), near, "near_line")
    # The rows of a frequent line are dealt out by document before they are counted, so none gathers in one task.
    pairs = found.repartition("id").groupBy("line", "site").agg(F.min("first_id").alias("first_id"), F.first("near_need").alias("need"))
    exact = pairs.groupBy("line").agg(F.count("*").alias("sites"), F.min("first_id").alias("first_id"), F.first("need").alias("need")).filter("sites >= need")
    return materialise(sure.select("line", "first_id").unionByName(exact.select("line", "first_id")))


def _with_lines(rows: DataFrame, few: DataFrame, key: str) -> DataFrame:
    """``rows`` joined by their ``line`` with ``few`` (unique ``key``), broadcast if it is counted to be small, else salted."""
    if few.count() <= BROADCAST_LINES:
        return rows.join(F.broadcast(few), F.col("line") == F.col(key))
    dealt = few.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt_of"))
    return rows.join(dealt, (F.col("line") == F.col(key)) & (F.pmod(F.xxhash64("id"), F.lit(SALT)) == F.col("salt_of"))).drop("salt_of")


def drop_boilerplate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", length_col: str = "n_chars", least_sites: int = LEAST_SITES) -> DataFrame:
    """``docs`` with boilerplate lines taken out of the text; all rows and columns stay, in any order.

    A line is a \\n-split piece that has a word, with its white space normalised. It is boilerplate if it
    stands on ``least_sites`` distinct sites or more; a line of two or three words needs ``SHORT_TIMES`` as
    many. A line of one to three words is also boilerplate where it stands beside (not counting empty
    lines) such a line, if it does so on ``least_sites`` sites. A boilerplate line stays only in the
    document with the smallest id (null ids count as largest), there also where it is repeated; rows that
    repeat this document keep it too. Null texts stay null, empty ones empty; a text that is left alone is
    unchanged, and a very long one is cut in time proportional to its length. An empty table gives no rows.
    ``length_col``, if there is such a column, gets the new length of a text that has lost lines.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    big = F.lit(9223372036854775807)
    keyed = docs.select(row.alias("row"), text_of(f"`{text_col}`").alias("text"), F.coalesce(F.col(f"`{id_col}`").cast("long"), big).alias("id"), F.col(f"`{site_col}`").cast("string").alias("site"))
    key = F.xxhash64("id", "site", "text")
    # Every line is hashed once; all that follows reads these narrow rows.
    hashed = materialise(keyed.select(key.alias("key"), "id", "site", lines_of(F.col("text")).alias("lines")))
    beside = F.transform("lines", lambda x, i: F.struct(x["at"].alias("at"), x["line"].alias("line"), x["words"].alias("words"), F.array(F.get("lines", i - 1), F.get("lines", i + 1)).alias("beside")))
    need = F.when(F.col("words") >= LONG_WORDS, F.lit(least_sites)).when(F.col("words") > 1, F.lit(SHORT_TIMES * least_sites))
    each = hashed.select("id", "site", F.explode("lines").alias("l"))
    bad = boilerplate_lines(each.select("id", "site", "l.line", "l.words").select("id", "site", "line", need.alias("need")).filter("need IS NOT NULL"))

    placed = hashed.select("key", "id", "site", F.explode(beside).alias("l")).select("key", "id", "site", "l.*")
    hits = materialise(_with_lines(placed, bad.withColumnRenamed("line", "bad_line"), "bad_line").select("key", "id", "site", "at", "first_id", "beside"))
    near = hits.select("key", "id", "site", F.explode("beside").alias("l")).filter("l IS NOT NULL").select("key", "id", "site", "l.*").filter(F.col("words") < LONG_WORDS)
    short = boilerplate_lines(near.select("id", "site", "line", F.lit(least_sites).alias("need")))
    more = _with_lines(near, short.withColumnRenamed("line", "bad_line"), "bad_line").select("key", "id", "at", "first_id")
    lost = hits.select("key", "id", "at", "first_id").unionByName(more).filter("id <> first_id")
    lost = lost.groupBy(F.col("key").alias("lost_key")).agg(F.sort_array(F.collect_set("at")).alias("lost"))

    joined = keyed.select("row", "text", key.alias("key")).join(lost, F.col("key") == F.col("lost_key"), "left")
    joined = joined.select("row", "lost", F.when(F.col("lost").isNotNull(), F.split("text", "\n")).alias("raw"))
    # What stays are the stretches between lost lines: each is a slice, so the work is as long as the text.
    begins = F.concat(F.array(F.lit(0)), F.transform("lost", lambda at: at + 1))
    ends = F.concat("lost", F.array(F.size("raw")))
    joined = joined.select("row", "lost", "raw", F.zip_with(begins, ends, lambda a, b: F.struct(a.alias("a"), b.alias("b"))).alias("spans"))
    stays = F.flatten(F.transform("spans", lambda s: F.slice(F.col("raw"), s["a"] + 1, s["b"] - s["a"])))
    cleaned = F.when(F.col("lost").isNotNull(), F.array_join(stays, "\n")).otherwise(F.col(f"row.`{text_col}`"))
    joined = joined.select("row", "lost", cleaned.alias("cleaned"))
    changed = {text_col: F.col("cleaned"), length_col: F.when(F.col("lost").isNotNull(), F.length("cleaned").cast("long")).otherwise(F.col(f"row.`{length_col}`"))}
    return joined.select(*[(changed.get(c, F.col(f"row.`{c}`"))).alias(c) for c in docs.columns])
