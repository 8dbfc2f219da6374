"""Vote logs: folding, counts, labelled examples, predictions frozen before a vote."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palate.functions.text import describe_feature
from palate.operators.features import with_entries
from palate.sources.storage import dealt

MIN_VOTES = 6
NEED_EACH = 3


def fold_votes(events: DataFrame) -> DataFrame:
    """Vote events (user_id, story_id, value, ts, event_id) to one vote per user and item: last value, first and
    latest time. A null value is a tombstone: it deletes the vote, and a later vote starts anew. Events are dealt by user
    and item into partitions that follow their number."""
    at = F.struct("ts", "event_id")
    gone = Window.partitionBy("user_id", "story_id")
    live = dealt(events, "user_id", "story_id").withColumn("gone", F.max(F.when(F.col("value").isNull(), at)).over(gone))
    live = live.where(F.col("value").isNotNull() & (F.col("gone").isNull() | (at > F.col("gone"))))
    return live.groupBy("user_id", "story_id").agg(
        F.max_by("value", at).alias("value"), F.min("ts").alias("created_at"), F.max("ts").alias("updated_at")
    )


def vote_counts(votes: DataFrame) -> DataFrame:
    v = F.col("value")
    return votes.groupBy("user_id").agg(
        F.count_if(v > 0).alias("up"), F.count_if(v < 0).alias("down"), F.count_if(v == 0).alias("skip"), F.count("*").alias("total")
    )


def labelled_examples(votes: DataFrame, items: DataFrame) -> DataFrame:
    """Judged items per user in training order: (user_id, story_id, label, ord from 0)."""
    some = votes.where("value <> 0").join(items.select("story_id"), "story_id")
    order = Window.partitionBy("user_id").orderBy("created_at", F.desc("story_id"))
    return some.select(
        "user_id", "story_id", (F.col("value") > 0).cast("int").alias("label"), (F.row_number().over(order) - 1).alias("ord")
    )


def training_gate(votes: DataFrame) -> DataFrame:
    up, down = F.count_if(F.col("value") > 0), F.count_if(F.col("value") < 0)
    return votes.groupBy("user_id").agg(up.alias("up"), down.alias("down")).select(
        "user_id",
        ((F.col("up") + F.col("down") >= MIN_VOTES) & (F.col("up") >= 1) & (F.col("down") >= 1)).alias("trainable"),
        F.greatest(NEED_EACH - F.col("up"), F.lit(0)).alias("need_up"),
        F.greatest(NEED_EACH - F.col("down"), F.lit(0)).alias("need_down"),
    )


def frozen_prediction(votes: DataFrame, history: DataFrame) -> DataFrame:
    """Each vote with the score in force before it: the latest of ``history`` (user_id, story_id, score, confidence,
    model_rev, scored_at) up to the vote's updated_at; nulls where nothing had been scored. Votes and scores of a user
    and item stand in one order of time, and each vote takes the last score before it: no vote meets a whole history."""
    score = F.struct("score", "confidence", "model_rev")
    cast = votes.select("user_id", "story_id", "value", F.col("updated_at").alias("at"), F.lit(True).alias("vote"), F.lit(None).cast("struct<score:double,confidence:double,model_rev:long>").alias("p"))
    made = history.select(
        "user_id", "story_id", F.lit(None).cast(votes.schema["value"].dataType).alias("value"), F.col("scored_at").alias("at"), F.lit(False).alias("vote"),
        score.cast("struct<score:double,confidence:double,model_rev:long>").alias("p"),
    )
    order = Window.partitionBy("user_id", "story_id").orderBy("at", "vote", F.col("p.model_rev")).rowsBetween(Window.unboundedPreceding, 0)
    both = cast.unionByName(made).withColumn("p", F.last("p", ignorenulls=True).over(order)).where("vote")
    model_rev = F.col("p.model_rev").cast(history.schema["model_rev"].dataType).alias("model_rev")
    return both.select("user_id", "story_id", "value", F.col("at").alias("updated_at"), "p.score", "p.confidence", model_rev)


def judge_agreement(predictions: DataFrame) -> DataFrame:
    """Whether the frozen score agreed with the vote; null for skips and unscored items."""
    agreed = (F.col("score") >= 0.5) == (F.col("value") > 0)
    return predictions.withColumn("agreed", F.when((F.col("value") != 0) & F.col("score").isNotNull(), agreed))


def _kind_rank(feature: Column) -> Column:
    kind = F.substring_index(feature, ":", 1)
    return F.when(kind == "w", 0).when(kind == "dom", 1).when(kind == "by", 2).when(kind == "tld", 3).otherwise(4)


def new_signals(judged: DataFrame, features: DataFrame, weights: DataFrame, limit: int = 3) -> DataFrame:
    """For judged items (user_id, story_id): how many features the user's model has never seen, and the first labels."""
    content = features.where((F.col("feature") != "__bias__") & ~F.col("feature").startswith("t:"))

    def fresh(items: pa.Table, known: pa.Table) -> pa.Table:
        lists = items["entries"].combine_chunks()
        entries = lists.flatten()
        name = entries.field("feature") if len(lists) else pa.array([], pa.string())
        keep = pc.invert(pc.is_in(name, value_set=known["feature"].combine_chunks()))
        at = np.repeat(np.arange(len(items)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        left = np.bincount(at[keep.to_numpy(zero_copy_only=False)], minlength=len(items))
        ends = pa.array(np.concatenate(([0], np.cumsum(left))), pa.int32())
        out = items.select(["user_id", "story_id"]).append_column("entries", pa.ListArray.from_arrays(ends, entries.filter(keep)))
        return out.filter(pa.array(left > 0))

    rows = with_entries(judged.select("user_id", "story_id").distinct(), content, "pos")
    both = rows.groupBy("user_id").cogroup(weights.select("user_id", "feature").groupBy("user_id"))
    some = both.applyInArrow(fresh, "user_id long, story_id long, entries array<struct<feature:string,pos:long>>")
    rank = F.transform("entries", lambda x: F.struct(_kind_rank(x["feature"]).alias("r"), x["pos"].alias("pos"), describe_feature(x["feature"])["label"].alias("label")))
    labels = F.transform(F.array_sort(rank), lambda x: x["label"])
    return some.select(
        "user_id", "story_id", F.size("entries").cast("long").alias("total"), F.array_join(F.slice(F.array_distinct(labels), 1, limit), "|").alias("labels")
    )


def retrain_candidates(votes: DataFrame, runs: DataFrame) -> DataFrame:
    """Users whose latest vote is newer than their latest training."""
    last_vote = votes.groupBy("user_id").agg(F.max("updated_at").alias("last_vote_at"))
    last_train = runs.groupBy("user_id").agg(F.max("trained_at").alias("last_train_at"))
    both = last_vote.join(last_train, "user_id", "left")
    return both.where(F.col("last_train_at").isNull() | (F.col("last_vote_at") > F.col("last_train_at")))
