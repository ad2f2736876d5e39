"""Quality rules with adaptive thresholds, in DataFrame functions only.

Base rules look at a document alone. The adaptive rules compare four ratios of a document with its
cohort (language and source): a ratio must lie inside fences set from the cohort's own quantiles.
The quantiles come from mergeable quantile sketches: log-linear histograms whose bins hold whole
numbers, so they merge by adding counts, give the same answer in any order of merging, and have at
most ``64 * 57`` bins of a relative width under 1/64. Cohorts with few rows use the merged sketch of
their language, or else that of all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, text_of

#: Quantiles of a sketch, as fractions.
QUANTILES = {"q1": (1, 4), "q2": (1, 2), "q3": (3, 4), "q99": (99, 100)}
#: ratio: (inner and outer quantile, reach, least distance, has a lower fence). The fence lies ``reach`` times the distance
#: of the two quantiles beyond the outer one. Most texts have no repeated lines or windows, so there the
#: quartiles are equal and the 99th percentile tells what is usual. The least distance counts only in cohorts
#: whose quantiles are equal or nearly so.
FENCES = {
    "symbol_ratio": ("q1", "q3", 3, 5, False),
    "word_length": ("q1", "q3", 10, 5, True),
    "dup_line_ratio": ("q2", "q99", 1, 100, False),
    "repeat_ratio": ("q2", "q99", 1, 40, False),
}
#: Rows that a cohort's own sketch needs.
MIN_ROWS = 200
#: Cohorts whose fences are broadcast; each is a row of a few numbers.
BROADCAST_COHORTS = 20_000
#: Bins below this are single numbers; above, a number keeps as many leading bits.
EXACT_BITS = 7

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"


def with_features(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The row as struct ``row`` with the base counts and the four ratios (whole numbers) beside it.

    Only row-local functions: no shuffle. Windows of five words are compared by their 64-bit hashes
    inside one document; positions are sorted only where some window repeats.
    """
    # Each step is a projection of its own, as lambdas must refer to columns and not recompute them.
    step = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), text_of(f"`{text_col}`").alias("text"))
    step = step.select("row", "text", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("words"), F.split("text", "\n").alias("raw_lines"))
    step = step.select(
        "row", "text", "words", F.size("words").cast("long").alias("n_words"),
        F.filter("raw_lines", lambda line: line.rlike(WORD)).alias("lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("h"),
    )
    step = step.select(
        "row", "n_words", F.aggregate("words", F.lit(0).cast("long"), lambda n, w: n + F.length(w)).alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("h") >= 5, F.transform(F.slice("h", 1, F.size("h") - 4), lambda x, i: F.xxhash64(x, F.get("h", i + 1), F.get("h", i + 2), F.get("h", i + 3), F.get("h", i + 4))))
        .otherwise(F.array().cast("array<bigint>")).alias("windows"),
    )
    counts = [c for c in step.columns if c != "windows"]
    none = F.array().cast("array<struct<h:bigint,p:int>>")
    step = step.select(*counts, F.when(F.size(F.array_distinct("windows")) < F.size("windows"), F.array_sort(F.transform("windows", lambda h, p: F.struct(h.alias("h"), p.alias("p"))))).otherwise(none).alias("sorted"))
    beside = lambda s, i: (F.get("sorted", i - 1)["h"] == s["h"]) | (F.get("sorted", i + 1)["h"] == s["h"])
    step = step.select(*counts, F.array_sort(F.transform(F.filter("sorted", beside), lambda s: s["p"])).alias("starts"))
    # A repeated window adds five words, or fewer if the next one begins inside it.
    covered = F.zip_with("starts", F.slice("starts", 2, F.greatest(F.size("starts"), F.lit(1))), lambda a, b: F.least(F.lit(5), F.coalesce(b - a, F.lit(5))))
    step = step.select(*counts, F.aggregate(F.when(F.size("starts") > 0, covered).otherwise(F.array().cast("array<int>")), F.lit(0).cast("long"), lambda n, x: n + x).alias("n_repeat_words"))
    part = lambda scale, a, b: F.expr(f"({scale} * {a}) div greatest({b}, 1)")
    step = step.select(
        "*",
        ((F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))).alias("base_failed"),
        part(1000, "n_symbols", "word_chars").alias("symbol_ratio"), part(100, "word_chars", "n_words").alias("word_length"),
        part(1000, "n_dup_lines", "n_lines").alias("dup_line_ratio"), part(1000, "n_repeat_words", "n_words").alias("repeat_ratio"),
    )
    # A generator between the steps and what comes after: a filter on a count must not be pushed below it,
    # where the count would be worked out again inside the filter, lambda by lambda.
    return step.select("row", F.explode(F.array(F.struct(*[c for c in step.columns if c != "row"]))).alias("f")).select("row", "f.*")


def bin_of(value: Column) -> Column:
    """The lower end of the sketch bin that holds a whole number of 0 or more."""
    drop = F.greatest(F.length(F.bin(value)) - EXACT_BITS, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, drop), drop)


def fit_fences(features: DataFrame, lang: Column, source: Column) -> DataFrame:
    """lang, source and the fences ``{ratio}_low`` and ``{ratio}_high`` of each cohort, from rows that pass the base rules.

    One shuffle of sketch bins, pre-aggregated in each task, so a hot source costs no more than others.
    """
    ratios = F.explode(F.map_from_arrays(F.array(*[F.lit(r) for r in FENCES]), F.array(*[bin_of(F.col(r)) for r in FENCES])))
    cohorts = (
        features.select(lang.alias("lang"), source.alias("source"), "base_failed", *[F.col(r) for r in FENCES])
        .select("lang", "source", "base_failed", ratios.alias("ratio", "bin"))
        .groupBy("lang", "source", "ratio", "bin").agg(F.count_if(~F.col("base_failed")).alias("n"))
    )
    cohorts = materialise(cohorts)
    # The sketch of a language is the sum of its cohorts' sketches, and that of all rows the sum of those.
    levels = cohorts.select("*", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("level")).select(
        "level", F.when(F.col("level") < 2, F.col("lang")).alias("lang"), F.when(F.col("level") < 1, F.col("source")).alias("source"), "ratio", "bin", "n")
    merged = levels.groupBy("level", "lang", "source", "ratio", "bin").agg(F.sum("n").alias("n"))
    key = Window.partitionBy("level", "lang", "source", "ratio")
    ranked = merged.select("*", F.sum("n").over(key.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)).alias("upto"), F.sum("n").over(key).alias("total"))
    at = lambda part, of: F.min(F.when(of * F.col("upto") >= part * F.col("total"), F.col("bin")))
    quantiles = ranked.filter("total > 0").groupBy("level", "lang", "source", "ratio").agg(*[at(*q).alias(name) for name, q in QUANTILES.items()], F.first("total").alias("total"))

    def fence(ratio: str, low: bool) -> Column:
        inner, outer, reach, least, _ = FENCES[ratio]
        beyond = reach * F.greatest(F.col(outer) - F.col(inner), F.lit(least))
        value = F.col(inner) - beyond if low else F.col(outer) + beyond
        return F.max(F.when(F.col("ratio") == ratio, value)).alias(f"{ratio}_{'low' if low else 'high'}")

    lower = [r for r, (*_, low) in FENCES.items() if low]
    wide = quantiles.groupBy("level", "lang", "source").agg(F.max("total").alias("rows"), *[fence(r, False) for r in FENCES], *[fence(r, True) for r in lower])
    fences = F.struct(*[c for c in wide.columns if c not in ("level", "lang", "source", "rows")]).alias("f")
    enough = F.col("rows") >= MIN_ROWS
    all_rows = wide.filter("level = 2").select(fences.alias("f2"))
    by_lang = wide.filter((F.col("level") == 1) & enough).select(F.col("lang").alias("lang1"), fences.alias("f1"))
    own = wide.filter((F.col("level") == 0) & enough).select(F.col("lang").alias("lang0"), F.col("source").alias("source0"), fences.alias("f0"))
    keys = cohorts.select("lang", "source").distinct()
    picked = (
        keys.join(own, F.col("lang").eqNullSafe(F.col("lang0")) & F.col("source").eqNullSafe(F.col("source0")), "left")
        .join(by_lang, F.col("lang").eqNullSafe(F.col("lang1")), "left")
        .join(F.broadcast(all_rows), F.lit(True), "left")  # one row
    )
    return picked.select("lang", "source", F.coalesce("f0", "f1", "f2").alias("f")).select("lang", "source", "f.*")


def judged(features: DataFrame, fences: DataFrame, lang: Column, source: Column) -> DataFrame:
    """``features`` with ``kept``: base rules passed and every ratio inside its cohort's fences.

    ``fences`` is counted first: up to ``BROADCAST_COHORTS`` cohorts are broadcast, so the rows stay where
    they are; more are joined by a shuffle.
    """
    limits = fences.select(F.col("lang").alias("cohort_lang"), F.col("source").alias("cohort_source"), F.struct(*[c for c in fences.columns if c not in ("lang", "source")]).alias("f"))
    if fences.count() <= BROADCAST_COHORTS:
        limits = F.broadcast(limits)
    inside = F.lit(True)
    for ratio, (*_, low) in FENCES.items():
        inside &= F.coalesce(F.col(ratio) <= F.col(f"f.{ratio}_high"), F.lit(True))
        if low:
            inside &= F.coalesce(F.col(ratio) >= F.col(f"f.{ratio}_low"), F.lit(True))
    joined = features.join(limits, lang.eqNullSafe(F.col("cohort_lang")) & source.eqNullSafe(F.col("cohort_source")), "left")
    return joined.withColumn("kept", ~F.col("base_failed") & inside)


def quality_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row per document: id, the base counts, ``base_failed``, the ratios and ``kept``.

    Null texts count as empty (and fail, having fewer than ten words). Null languages and sources are
    cohorts of their own. Repeated rows are judged alike. An empty table gives no rows. If no row passes
    the base rules there are no fences and none is needed.
    """
    narrow = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), text_of(text_col).alias("text"))
    features = with_features(narrow)
    features = materialise(features.select(F.col("row.id").alias("id"), F.col("row.lang").alias("lang"), F.col("row.source").alias("source"), *[c for c in features.columns if c != "row"]))
    lang, source = F.col("lang"), F.col("source")
    fences = materialise(fit_fences(features, lang, source))
    out = judged(features, fences, lang, source)
    return out.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", *FENCES, "kept")


def quality_filter(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns as they were.

    Features are worked out once and written with their rows to the checkpoint folder, from which both the
    fences and the verdict are read, so texts aren't shuffled. Null texts count as empty and fail. Null
    languages and sources are cohorts of their own; repeated rows are judged alike; a very long text is one
    row like others. An empty table gives no rows. Clashing column names can't matter: a row travels as
    one struct.
    """
    features = with_features(docs, text_col)
    features = materialise(features.select("row", F.col(f"row.`{lang_col}`").alias("lang"), F.col(f"row.`{source_col}`").alias("source"), "base_failed", *FENCES))
    lang, source = F.col("lang"), F.col("source")
    fences = materialise(fit_fences(features, lang, source))
    return judged(features, fences, lang, source).filter("kept").select("row.*")
