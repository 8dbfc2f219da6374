"""Dates, numbers and labels as Column expressions. Times are whole seconds since 1970, days are UTC texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DAY = 86_400


def day_key(seconds: Column) -> Column:
    """UTC day of a time, also before 1970."""
    return F.date_format(F.date_add(F.to_date(F.lit("1970-01-01")), F.floor(seconds / F.lit(DAY)).cast("int")), "yyyy-MM-dd")


def parse_day(c: Column) -> Column:
    """The date of a strict ``YYYY-MM-DD`` text; null for other shapes and impossible dates."""
    return F.when(c.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_timestamp(c, F.lit("yyyy-MM-dd")).cast("date"))


def day_bounds(c: Column) -> Column:
    """Struct (start, stop) in seconds of a day; the stop is the next day's start."""
    start = F.datediff(parse_day(c), F.to_date(F.lit("1970-01-01"))).cast("long") * DAY
    return F.struct(start.alias("start"), (start + DAY).alias("stop"))


def recent_days(spark: SparkSession, n: int, last: str) -> DataFrame:
    """The last ``n`` days up to ``last``, newest first: (day, pos)."""
    days = F.sequence(F.to_date(F.lit(last)), F.date_sub(F.to_date(F.lit(last)), n - 1), F.expr("interval -1 day"))
    return spark.range(1).select(F.posexplode(days).alias("pos", "d")).select(F.date_format("d", "yyyy-MM-dd").alias("day"), "pos")


def days_between(spark: SparkSession, first: str, last: str) -> DataFrame:
    """Days from ``first`` to ``last``, both included, oldest first; an error when there is none."""
    if last < first:
        raise ValueError(f"{first} comes after {last}")
    days = F.sequence(F.to_date(F.lit(first)), F.to_date(F.lit(last)))
    return spark.range(1).select(F.explode(days).alias("d")).select(F.date_format("d", "yyyy-MM-dd").alias("day"))


def sigmoid(z: Column) -> Column:
    """Split at zero, so that neither side overflows."""
    return F.when(z >= 0, 1 / (1 + F.exp(-z))).otherwise(F.exp(z) / (1 + F.exp(z)))


def raw_offset(score: Column, confidence: Column) -> Column:
    """How far the plain probability behind a shrunk score lies from one half."""
    return (score - F.lit(0.5)) / (F.lit(0.3) + F.lit(0.7) * confidence)


def display_pct(p: Column) -> Column:
    return F.least(F.greatest(F.floor(p * 100 + F.lit(0.5)).cast("int"), F.lit(1)), F.lit(99))


def age_label(created_at: Column, as_of: int) -> Column:
    """Minutes below an hour (one at least), hours below two days, else days."""
    age = F.lit(as_of) - created_at
    minutes = F.greatest(F.lit(1), F.floor(age / 60 + 0.5))
    return (
        F.when(age < 3600, F.concat(minutes.cast("string"), F.lit("m")))
        .when(age < 48 * 3600, F.concat(F.floor(age / 3600 + 0.5).cast("string"), F.lit("h")))
        .otherwise(F.concat(F.floor(age / DAY + 0.5).cast("string"), F.lit("d")))
    )


def normalize_epoch(ts: Column) -> Column:
    """Times over 1e12 are milliseconds of an older writer."""
    return F.when(ts > 1_000_000_000_000, F.floor(ts / 1000)).otherwise(ts).cast("long")


def reveal_strength(score: Column) -> Column:
    return F.greatest(score, F.lit(1.0) - score)


def reveal_band(score: Column) -> Column:
    """A value on a boundary belongs to the higher band."""
    s = F.round(reveal_strength(score), 9)
    return F.when(s >= 0.9, "very sure").when(s >= 0.75, "fairly sure").when(s >= 0.6, "leaning").otherwise("coin flip")


def conflict_flag(vote: Column, oof: Column) -> Column:
    """Whether a clear held-out verdict contradicts an up or down vote; unsure or missing verdicts contradict none."""
    verdict = F.when(oof > 0.65, 1).when(oof < 0.35, -1).otherwise(0)
    return F.coalesce((verdict != 0) & vote.isin(1, -1) & (verdict != vote), F.lit(False))


def evidence_label(confidence: Column) -> Column:
    return F.when(confidence >= 0.5, "known").when(confidence > 0, "guess").otherwise("unseen")


def parse_feed_link(url: Column) -> Column:
    """Struct of the filters a saved feed link stands for. Parameters: m mode, d window or day, s score range, p points,
    c comments, v voted too, q search. A score range means all time and no comment floor unless d or c say otherwise;
    a day replaces the window and drops the comment floor; unreadable or inverted values fall back."""

    def arg(name: str) -> Column:
        return F.try_parse_url(url, F.lit("QUERY"), F.lit(name))

    def number(name: str) -> Column:
        return F.when(arg(name).rlike("^[0-9]{1,9}$"), arg(name).cast("int"))

    mode = F.when(arg("m").isin("foryou", "hybrid", "top", "new"), arg("m")).otherwise("foryou")
    day = F.when(parse_day(arg("d")).isNotNull(), arg("d"))
    lo = F.when(arg("s").rlike("^[0-9]{1,3}-[0-9]{1,3}$"), F.substring_index(arg("s"), "-", 1).cast("int"))
    hi = F.when(arg("s").rlike("^[0-9]{1,3}-[0-9]{1,3}$"), F.substring_index(arg("s"), "-", -1).cast("int"))
    ranged = F.coalesce((lo <= hi) & (hi <= 100), F.lit(False))
    days = F.when(day.isNotNull(), F.lit(0)).otherwise(F.coalesce(number("d"), F.when(ranged, F.lit(0)).otherwise(F.lit(7))))
    comments = F.coalesce(number("c"), F.when(ranged | day.isNotNull(), F.lit(0)).otherwise(F.lit(10)))
    return F.struct(
        mode.alias("mode"),
        day.alias("day"),
        days.alias("days"),
        F.when(ranged, lo / F.lit(100.0)).otherwise(0.0).alias("min_score"),
        F.when(ranged, hi / F.lit(100.0)).otherwise(1.0).alias("max_score"),
        F.coalesce(number("p"), F.lit(0)).alias("min_points"),
        comments.alias("min_comments"),
        F.coalesce(arg("v") == "1", F.lit(False)).alias("include_voted"),
        F.coalesce(arg("q"), F.lit("")).alias("query"),
    )
