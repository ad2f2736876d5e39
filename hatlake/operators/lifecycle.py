"""Archive metadata and its states, and the running length guard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import sha256
from ..plans.paths import Message, parse_path


def days(n: int) -> Column:
    return F.make_dt_interval(F.lit(n))


def metadata(messages: DataFrame, received: Column, active_days: int, raw: str = "raw") -> DataFrame:
    """message_id, state, received_at, next_action_at and message_hash of parsed messages."""
    control = F.coalesce(Message().get(parse_path("MSH.10")), F.lit("UNKNOWN"))
    return messages.select("*", control.alias("message_id"), F.lit("active").alias("state"), received.alias("received_at"), (received + days(active_days)).alias("next_action_at"), sha256(F.col(raw)).alias("message_hash"))


def can_transition(now: Column, next_action: str = "next_action_at", held: Column | None = None) -> Column:
    due = now >= F.col(next_action)
    return due if held is None else due & ~F.coalesce(held, F.lit(False))


def next_step(archive: bool, archive_days: int, state: str = "state", next_action: str = "next_action_at") -> Column:
    """struct(state, at): active goes to archived (if the policy archives) or purged, others to purged."""
    to_archive = (F.col(state) == "active") & F.lit(archive)
    return F.struct(F.when(to_archive, "archived").otherwise("purged").alias("state"), F.when(to_archive, F.col(next_action) + days(archive_days)).otherwise(F.col(next_action)).alias("at"))


def guard(messages: DataFrame, value: Column, order: str = "ordinal", warmup: int = 100, threshold: float = 0.5, width: int = 65536, by: tuple[str, ...] = ()) -> DataFrame:
    """``messages`` with ``guard_score`` and ``is_anomaly``: how far a length lies from those of earlier messages.

    The score is |z| / 10, cut to 0..1, once ``warmup`` messages went before. ``order`` is a whole number. Sums
    run in two levels: ranges of ``width`` numbers are summed and prefixed, and only inside a range rows are
    ordered, so that one long feed spreads over the cluster. Sums are of whole numbers, so they are exact.
    """
    wide = messages.withColumn("_v", value.cast("decimal(38,0)")).withColumn("_range", F.floor(F.col(order) / width))
    keys = [*by, "_range"]
    ranges = wide.groupBy(*keys).agg(F.count("*").alias("_n"), F.sum("_v").alias("_s"), F.sum(F.col("_v") * F.col("_v")).alias("_q"))
    before = Window.partitionBy(*by, F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0).cast("decimal(38,0)"))
    prefix = ranges.select(*keys, *[zero(F.sum(c).over(before)).alias(f"{c}0") for c in ("_n", "_s", "_q")])
    inside = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = wide.join(prefix, keys)
    n = (zero(F.count("*").over(inside)) + F.col("_n0")).cast("double")
    s = (zero(F.sum("_v").over(inside)) + F.col("_s0")).cast("double")
    q = (zero(F.sum(F.col("_v") * F.col("_v")).over(inside)) + F.col("_q0")).cast("double")
    rows = rows.withColumns({"_count": n, "_sum": s, "_squares": q})
    variance = (F.col("_squares") - F.col("_sum") * F.col("_sum") / F.col("_count")) / (F.col("_count") - 1)
    z = F.abs(F.col("_v").cast("double") - F.col("_sum") / F.col("_count")) / F.sqrt(variance)
    score = F.when((F.col("_count") >= F.greatest(F.lit(warmup), F.lit(2))) & (variance > 0), F.least(z / 10, F.lit(1.0))).otherwise(0.0)
    out = rows.withColumn("guard_score", score)
    return out.withColumn("is_anomaly", F.col("guard_score") >= threshold if threshold > 0 else F.col("guard_score") > 0).drop("_v", "_range", *[f"{c}0" for c in ("_n", "_s", "_q")], "_count", "_sum", "_squares")
