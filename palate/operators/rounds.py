"""Rounds of cards and paired tests between model revisions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID_AFTER = 86_400


def deal_round(deck: DataFrame, runs: DataFrame, seqs: DataFrame, as_of: int) -> tuple[DataFrame, DataFrame]:
    """(rounds, cards) from a deck: the next number per user, the revision it came from (0 without one), its size."""
    size = deck.groupBy("user_id").agg(F.count("*").alias("size"))
    rounds = size.join(seqs.select("user_id", "round_seq"), "user_id", "left").join(runs.select("user_id", "rev"), "user_id", "left")
    rounds = rounds.select(
        "user_id", (F.coalesce("round_seq", F.lit(0)) + 1).alias("seq"), F.coalesce("rev", F.lit(0)).alias("rev"), "size",
        F.lit(as_of).cast("long").alias("dealt_at"),
    )
    return rounds, deck.join(rounds.select("user_id", "seq"), "user_id").select("user_id", "seq", "pos", "story_id", "reason")


def current_round(rounds: DataFrame, as_of: int) -> DataFrame:
    """Rounds still in force: not empty, dealt within a day."""
    return rounds.where((F.col("size") > 0) & (F.col("dealt_at") > as_of - VOID_AFTER))


def round_status(cards: DataFrame, votes: DataFrame, items: DataFrame) -> DataFrame:
    """Progress by joining cards with votes: judged, skipped, remaining cards in deal order; items that are gone count
    as spent."""
    rows = cards.join(votes.select("user_id", "story_id", "value"), ["user_id", "story_id"], "left").join(
        items.select("story_id", F.lit(True).alias("there")), "story_id", "left"
    )
    open_ = F.col("value").isNull() & F.col("there").isNotNull()
    left = F.array_sort(F.collect_list(F.when(open_, F.struct("pos", "story_id"))))
    return rows.groupBy("user_id", "seq").agg(
        F.count("*").alias("size"),
        F.count_if(F.col("value") != 0).alias("judged"),
        F.count_if(F.col("value") == 0).alias("skipped"),
        F.count_if(open_).alias("remaining"),
        (F.count_if(open_) == 0).alias("finished"),
        F.array_join(F.transform(left, lambda x: x["story_id"].cast("string")), ",").alias("cards"),
    )


def paired_flips(votes: DataFrame, oof: DataFrame, pairs: DataFrame) -> DataFrame:
    """McNemar's comparison of two revisions (pairs: user_id, from_rev, to_rev) on the votes both were held out from.
    No row where the revisions are one or share no vote."""
    o = oof.select("user_id", "story_id", "score", "model_rev")
    a = o.select("user_id", "story_id", F.col("score").alias("sa"), F.col("model_rev").alias("from_rev"))
    b = o.select("user_id", "story_id", F.col("score").alias("sb"), F.col("model_rev").alias("to_rev"))
    rows = pairs.where("from_rev <> to_rev").join(a, ["user_id", "from_rev"]).join(b, ["user_id", "to_rev", "story_id"])
    rows = rows.join(votes.where("value <> 0").select("user_id", "story_id", "value"), ["user_id", "story_id"])
    up = F.col("value") > 0
    before, after = (F.col("sa") >= 0.5) == up, (F.col("sb") >= 0.5) == up
    sums = rows.groupBy("user_id", "from_rev", "to_rev").agg(
        F.count("*").alias("shared"), F.count_if(~before & after).alias("gained"), F.count_if(before & ~after).alias("lost")
    )
    net, moved = F.col("gained") - F.col("lost"), F.col("gained") + F.col("lost")
    return sums.withColumns(
        {
            "moved": moved,
            "net": net,
            "delta": net / F.col("shared"),
            "significant": (moved > 0) & (F.abs(net) > F.lit(1.96) * F.sqrt(moved)),
        }
    )


def accuracy_move(runs: DataFrame, pairs: DataFrame, flips: DataFrame) -> DataFrame:
    """Accuracy before and after, the noise band, and whether the move is more than noise: by flips where there are any,
    else by the band. No row without an accuracy after."""
    r = runs.select("user_id", "rev", "accuracy", "baseline", "noise")
    a = r.select("user_id", F.col("rev").alias("from_rev"), F.col("accuracy").alias("before"), F.col("noise").alias("noise_a"))
    b = r.select("user_id", F.col("rev").alias("to_rev"), F.col("accuracy").alias("after"), "baseline", F.col("noise").alias("noise_b"))
    keys = ["user_id", "from_rev", "to_rev"]
    rows = pairs.join(b, ["user_id", "to_rev"]).join(a, ["user_id", "from_rev"], "left").join(
        flips.select(*keys, "shared", "significant"), keys, "left"
    )
    rows = rows.where(F.col("after").isNotNull() & (F.col("after") != 0))
    band = F.greatest(F.coalesce("noise_a", F.lit(0.0)), F.coalesce("noise_b", F.lit(0.0))) * F.sqrt(F.lit(2.0))
    by_band = F.coalesce(F.abs(F.col("after") - F.col("before")) > band, F.lit(False))
    sure = F.when(F.col("shared").isNotNull(), F.col("significant")).otherwise(by_band)
    direction = F.when(~sure, "flat").when(F.col("after") > F.col("before"), "up").otherwise("down")
    return rows.select(
        *keys, "before", "after", "baseline", band.alias("band"), sure.alias("significant"), direction.alias("direction"),
        (F.col("shared").isNull() & F.col("before").isNotNull()).alias("show_band"),
    )


def round_summary(
    cards: DataFrame, votes: DataFrame, predictions: DataFrame, signals: DataFrame, rounds: DataFrame | None = None,
    runs: DataFrame | None = None, movers: DataFrame | None = None, moves: DataFrame | None = None,
) -> DataFrame:
    """A round's outcome: judged, skipped, how often the frozen prediction was right, the same over explore cards (the
    unbiased sample), and signals gained; null rates where nothing was judged.

    With ``rounds`` (user_id, seq, rev) and ``runs`` (user_id, rev) also whether the model has been trained since the
    deal; with ``movers`` the labels whose weights moved most; with ``moves`` the accuracy's move."""
    p = predictions.select("user_id", "story_id", F.col("score").alias("frozen"))
    rows = cards.join(votes.select("user_id", "story_id", "value"), ["user_id", "story_id"], "left").join(
        p, ["user_id", "story_id"], "left"
    ).join(signals.select("user_id", "story_id", F.col("total").alias("fresh")), ["user_id", "story_id"], "left")
    asked = (F.col("value") != 0) & F.col("frozen").isNotNull()
    right = asked & ((F.col("frozen") >= 0.5) == (F.col("value") > 0))
    explore = F.col("reason") == "explore"
    out = rows.groupBy("user_id", "seq").agg(
        F.count_if(F.col("value") != 0).alias("judged"),
        F.count_if(F.col("value") == 0).alias("skipped"),
        F.count_if(right).alias("right"),
        F.count_if(asked).alias("asked"),
        F.count_if(right & explore).alias("explore_right"),
        F.count_if(asked & explore).alias("explore_asked"),
        F.coalesce(F.sum(F.when(F.col("value") != 0, F.col("fresh"))), F.lit(0)).alias("signals"),
    )
    out = out.withColumns(
        {
            "share": F.col("right") / F.nullif("asked", F.lit(0)),
            "explore_share": F.col("explore_right") / F.nullif("explore_asked", F.lit(0)),
        }
    )
    if rounds is not None and runs is not None:
        dealt = rounds.select("user_id", "seq", F.col("rev").alias("dealt_rev"))
        now = runs.groupBy("user_id").agg(F.max("rev").alias("now_rev"))
        out = out.join(dealt, ["user_id", "seq"], "left").join(now, "user_id", "left")
        out = out.withColumn("trained", F.coalesce(F.col("now_rev") > F.col("dealt_rev"), F.lit(False))).drop("now_rev", "dealt_rev")
    if movers is not None:
        rows = F.array_sort(F.collect_list(F.struct((F.col("side") != "like").alias("low"), "rank", "label")))
        names = F.array_join(F.transform(rows, lambda x: F.concat(F.when(x["low"], "-").otherwise("+"), x["label"])), "|")
        out = out.join(movers.groupBy("user_id").agg(names.alias("movers")), "user_id", "left")
    if moves is not None:
        out = out.join(moves.select("user_id", "before", "after", "direction"), "user_id", "left")
    return out
