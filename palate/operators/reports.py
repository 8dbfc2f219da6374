"""Coverage, distribution and model reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palate.functions.text import describe_feature
from palate.operators.decks import voted_out


def items_per_day(items: DataFrame, window_days: int = 60) -> DataFrame:
    """(day, stories): zero-filled from the first day inside the window to the last stored day."""
    per = items.groupBy("day").agg(F.count("*").alias("stories"))
    last = F.max("day")
    ends = per.agg(last.alias("z")).select("z", F.date_sub(F.to_date("z"), window_days - 1).alias("lo"))
    inside = per.crossJoin(ends).where(F.to_date("day") >= F.col("lo"))
    span = inside.agg(F.min("day").alias("a"), F.max("day").alias("z")).where("a is not null")
    days = span.select(F.explode(F.sequence(F.to_date("a"), F.to_date("z"))).alias("d")).select(
        F.date_format("d", "yyyy-MM-dd").alias("day")
    )
    return days.join(per, "day", "left").select("day", F.coalesce("stories", F.lit(0)).alias("stories"))


def older_items(items: DataFrame, window_days: int = 60) -> DataFrame:
    """What lies before the window: (days, stories, before)."""
    per = items.groupBy("day").agg(F.count("*").alias("stories"))
    ends = per.agg(F.max("day").alias("z")).select(F.date_sub(F.to_date("z"), window_days - 1).alias("lo"))
    old = per.crossJoin(ends).where(F.to_date("day") < F.col("lo"))
    return old.agg(
        F.count("*").alias("days"), F.coalesce(F.sum("stories"), F.lit(0)).alias("stories"), F.max("lo").cast("string").alias("before")
    )


def coverage_dips(days: DataFrame) -> DataFrame:
    """``days`` (day, stories) with the upper median, the 95th-percentile cap and whether a day is low or missing."""
    sorted_ = days.agg(F.array_sort(F.collect_list("stories")).alias("s"))  # one number a day of a bounded window
    n = F.size("s")
    stats = sorted_.select(
        F.get("s", F.floor(n / 2).cast("int")).alias("median"),
        F.greatest(F.get("s", F.least(n - 1, F.ceil(n * F.lit(0.95)).cast("int"))), F.lit(1)).alias("cap"),
        F.array_max("s").alias("most"),
    )
    out = days.crossJoin(stats)
    low = F.col("stories") < F.greatest(F.lit(1.0), F.col("median") / 2)
    return out.withColumns({"low": low, "missing": F.col("stories") == 0})


def score_distribution(scores: DataFrame, votes: DataFrame, runs: DataFrame, bins: int = 20) -> DataFrame:
    """Per user with a model: how many never-voted items fall into each of ``bins`` equal score bins, empty ones too."""
    now = scores.join(runs.select("user_id", F.col("rev").alias("model_rev")), ["user_id", "model_rev"], "left_semi")
    now = voted_out(now, votes)
    binned = now.groupBy("user_id", F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)).cast("int").alias("bin")).agg(
        F.count("*").alias("n")
    )
    return every_bin(binned, runs, bins)


def every_bin(binned: DataFrame, runs: DataFrame, bins: int = 20) -> DataFrame:
    """``score_distribution`` of counts (user_id, bin, n) that are made already: empty bins too."""
    every = runs.select("user_id", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return every.join(binned, ["user_id", "bin"], "left").select("user_id", "bin", F.coalesce("n", F.lit(0)).alias("n"))


def distribution_bands(distribution: DataFrame, bins: int = 20) -> DataFrame:
    """Shares of items a user would like (0.70 up), is unsure of (0.40 to 0.60) and would not (below 0.40)."""
    lo = F.round(F.col("bin") / F.lit(float(bins)), 6)
    total = F.nullif(F.sum("n"), F.lit(0))
    share = lambda when: F.sum(F.when(when, F.col("n")).otherwise(0)) / total
    return distribution.groupBy("user_id").agg(
        share(lo >= 0.7).alias("likely"), share((lo >= 0.4) & (lo < 0.6)).alias("unsure"), share(lo < 0.4).alias("unlikely")
    )


def model_verdict(current: DataFrame) -> DataFrame:
    """What a user's latest metrics amount to."""
    gain = F.col("accuracy") - F.coalesce("baseline", F.lit(0.5))
    verdict = F.when(F.col("auc") > 0.8, "ranks well").when(F.col("auc") > 0.65, "real signal").otherwise("guessing")
    return current.select("user_id", gain.alias("gain"), verdict.alias("verdict"))


def stats(
    items: DataFrame, votes: DataFrame, runs: DataFrame, weights: DataFrame | None = None, insights: DataFrame | None = None,
    distribution: DataFrame | None = None,
) -> DataFrame:
    """One row a user: corpus size, days and last sync, vote counts, latest revision with its vote count and the metrics
    that ``runs`` has; number of features, strongest labels each way, and the score distribution, where those tables are
    given. What belongs to a model is null for users without one."""
    corpus = items.agg(
        F.count("*").alias("items"), F.countDistinct("day").alias("days"), F.max("fetched_at").alias("last_sync")
    )
    v = F.col("value")
    counts = votes.groupBy("user_id").agg(
        F.count_if(v > 0).alias("up"), F.count_if(v < 0).alias("down"), F.count_if(v == 0).alias("skip")
    )
    metrics = [c for c in ("accuracy", "auc", "log_loss", "noise") if c in runs.columns]
    latest = runs.select("user_id", "rev", "n_votes", *metrics)
    if weights is not None:
        latest = latest.join(weights.groupBy("user_id").agg(F.count("*").alias("n_features")), "user_id", "left")
    if insights is not None:
        for side in ("like", "dislike"):
            rows = insights.where(F.col("side") == side).groupBy("user_id")
            top = F.array_sort(F.collect_list(F.struct("rank", "feature")))  # as many as insights was asked for
            names = F.array_join(F.transform(top, lambda x: describe_feature(x["feature"])["label"]), "|")
            latest = latest.join(rows.agg(names.alias(f"{side}s")), "user_id", "left")
    if distribution is not None:
        bins = F.array_sort(F.collect_list(F.struct("bin", "n")))
        line = F.array_join(F.transform(bins, lambda x: x["n"].cast("string")), ",")
        latest = latest.join(distribution.groupBy("user_id").agg(line.alias("distribution")), "user_id", "left")
    return counts.join(latest, "user_id", "left").crossJoin(corpus)

