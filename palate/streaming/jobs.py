"""Incremental forms of the batch jobs. Each takes a streaming DataFrame and gives a started query or a stream.

Tables that batches change are logs of runs (``sources.merge_table``): a batch writes its own rows, and a batch that runs
again after its run counted changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from palate.operators.features import featurize
from palate.operators.rounds import VOID_AFTER
from palate.operators.score import pack_users, score_grid
from palate.operators.votes import fold_votes, frozen_prediction
from palate.sources.ingest import ITEM_COLUMNS, items_table, write_scores
from palate.sources.merge_table import MergeTable

def _start(stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_items(items: DataFrame, path: str, checkpoint: str, then: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Late and repeated items merge into the table under ``path`` and never lower it. ``then(batch, id)`` runs after."""

    def step(batch: DataFrame, number: int) -> None:
        items_table(batch.sparkSession, path).write(batch.select(*ITEM_COLUMNS), checkpoint, number)
        if then:
            then(batch, number)

    return _start(items, step, checkpoint)


def latest_items(spark: SparkSession, path: str) -> DataFrame | None:
    return items_table(spark, path).read()


def _fold_log(rows: DataFrame) -> DataFrame:
    """Of each user and item the latest tombstone and the events after it, each event once."""
    at = F.struct("ts", "event_id")
    rows = rows.drop("__run").dropDuplicates(["user_id", "story_id", "event_id"])
    gone = F.max(F.when(F.col("value").isNull(), at)).over(Window.partitionBy("user_id", "story_id"))
    rows = rows.withColumn("gone", gone)
    return rows.where(F.col("gone").isNull() | (at >= F.col("gone"))).drop("gone")


def votes_log(spark: SparkSession, path: str) -> MergeTable:
    return MergeTable(spark, path, ["user_id", "story_id"], _fold_log)


def stream_votes(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Vote events, tombstones included, kept per user and item as what a fold needs: the latest tombstone and the events
    after it. ``latest_votes`` folds them."""
    return _start(events, lambda batch, number: votes_log(batch.sparkSession, path).write(batch, checkpoint, number) and None, checkpoint)


def latest_votes(spark: SparkSession, path: str) -> DataFrame | None:
    log = votes_log(spark, path).read()
    return None if log is None else fold_votes(log)


def stream_predictions(events: DataFrame, history: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Each arriving vote with the score in force when it was cast, the latest of ``history`` with scored_at <= ts:
    appended once, a folder for each batch. Tombstones have no prediction."""

    def step(batch: DataFrame, number: int) -> None:
        cast = batch.where("value is not null").withColumnRenamed("ts", "updated_at")
        own = history.join(cast.select("user_id", "story_id").distinct(), ["user_id", "story_id"], "left_semi")
        frozen_prediction(cast, own).write.mode("overwrite").parquet(f"{path}/number={number}")

    return _start(events, step, checkpoint)


def stream_score_arrivals(items: DataFrame, path: str, scores_path: str, checkpoint: str, weights: DataFrame, runs: DataFrame) -> StreamingQuery:
    """Nothing is ingested without being scored: each batch is merged, then its items, as merged, are scored for every
    user with a model and upserted; earlier scores of other items stay. Weights are packed once, under each user's newest
    run. A batch's scores are a grid of users and items, which the table writes and reads without folding it."""
    last = runs.groupBy("user_id").agg(F.max_by(F.struct(*(c for c in runs.columns if c != "user_id")), "rev").alias("r")).select("user_id", "r.*")
    users = pack_users(weights, last)

    def then(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        arrived = items_table(spark, path).read(only=batch.select("story_id"))
        if arrived is not None:
            scores, *grid = score_grid(featurize(arrived), users)
            write_scores(scores, scores_path, checkpoint, number, tuple(grid))

    return stream_items(items, path, checkpoint, then)


def items_per_day_stream(items: DataFrame, late: str = "2 days") -> DataFrame:
    """Tumbling day counts of a stream of items."""
    timed = items.withColumn("at", F.timestamp_seconds("created_at")).withWatermark("at", late)
    return timed.groupBy(F.window("at", "1 day").alias("w")).agg(F.count("*").alias("stories")).select(
        F.date_format("w.start", "yyyy-MM-dd").alias("day"), "stories"
    )


def stale_round_expiry(deals: DataFrame, late: str = "0 seconds", void_after: int = VOID_AFTER) -> DataFrame:
    """Rounds of a stream of deals (user_id, seq, dealt_at) that became void: (user_id, seq, expired_at). A deal is void
    ``void_after`` seconds after it, unless the user has been dealt another by then: it is the last of a session with that
    gap, which event time closes without any further row of its user. Deals may come in any order within ``late``. The
    state is kept in RocksDB, which the session is set to."""
    deals.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    timed = deals.withColumn("at", F.timestamp_seconds("dealt_at")).withWatermark("at", late)
    # a deal at the very end of the time comes too late to save the one before it
    gap = f"{void_after - 1} seconds 999999 microseconds"
    last = timed.groupBy("user_id", F.session_window("at", gap)).agg(F.max(F.struct("dealt_at", "seq")).alias("d"))
    return last.select("user_id", F.col("d.seq").alias("seq"), (F.col("d.dealt_at") + void_after).cast("long").alias("expired_at"))
