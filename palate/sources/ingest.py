"""Feeds of items in JSON, merged idempotently; vote imports; gap audits. Sinks write Parquet or JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palate.functions.scalars import day_key
from palate.functions.text import domain_of
from palate.sources.merge_table import MergeTable, newest
from palate.sources.storage import dealt

HIT = (
    "objectID string, title string, story_title string, url string, story_url string, author string, points long,"
    " num_comments long, created_at_i long"
)
ITEM = (
    "id long, type string, by string, time long, title string, url string, score long, descendants long, dead boolean,"
    " deleted boolean"
)
ITEM_COLUMNS = ("story_id", "title", "url", "domain", "author", "points", "num_comments", "created_at", "day", "fetched_at")


def _shape(df: DataFrame, fetched_at: int) -> DataFrame:
    return df.withColumns(
        {"domain": domain_of(F.col("url")), "day": day_key(F.col("created_at")), "fetched_at": F.lit(fetched_at).cast("long")}
    ).select(*ITEM_COLUMNS)


def normalize_hits(raw: DataFrame, fetched_at: int, column: str = "json") -> DataFrame:
    """Search-API hits as items; hits without a usable id, title or time go."""
    h = raw.select(F.from_json(column, HIT).alias("h")).select("h.*")
    first = lambda a, b: F.coalesce(F.nullif(F.trim(a), F.lit("")), F.trim(b))
    out = h.select(
        F.col("objectID").try_cast("long").alias("story_id"),
        F.coalesce(first(F.col("title"), F.col("story_title")), F.lit("")).alias("title"),
        F.coalesce("url", "story_url").alias("url"),
        "author",
        F.coalesce("points", F.lit(0)).alias("points"),
        F.coalesce("num_comments", F.lit(0)).alias("num_comments"),
        F.col("created_at_i").alias("created_at"),
    )
    return _shape(out.where("story_id is not null and story_id <> 0 and title <> '' and created_at is not null"), fetched_at)


def normalize_items(raw: DataFrame, fetched_at: int, column: str = "json") -> DataFrame:
    """Item-API records as items: live stories with id, title and time."""
    i = raw.select(F.from_json(column, ITEM).alias("i")).select("i.*")
    live = (F.col("type") == "story") & ~F.coalesce("dead", F.lit(False)) & ~F.coalesce("deleted", F.lit(False))
    out = i.where(live).select(
        F.col("id").alias("story_id"),
        F.trim(F.coalesce("title", F.lit(""))).alias("title"),
        "url",
        F.col("by").alias("author"),
        F.coalesce("score", F.lit(0)).alias("points"),
        F.coalesce("descendants", F.lit(0)).alias("num_comments"),
        F.col("time").alias("created_at"),
    )
    return _shape(out.where("story_id is not null and story_id <> 0 and title <> '' and created_at is not null"), fetched_at)


def scan_day_range(source: DataFrame, first: str, last: str, per_day: int = 1000, min_points: int = 3) -> DataFrame:
    """The highest-rated items of each day in the range; a floor of 0 is no floor. Day and points reach the scan."""
    some = source.where((F.col("day") >= first) & (F.col("day") <= last))
    some = some.where(F.col("points") >= min_points) if min_points > 0 else some
    order = Window.partitionBy("day").orderBy(F.desc("points"), "story_id")
    return some.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per_day)


def front_page_union(day_items: DataFrame, front: DataFrame | None, days: list[str], today: str, force: bool | None = None) -> DataFrame:
    """The front page joins only a range that holds today, unless ``force`` says otherwise; one that could not be read
    (None) does not."""
    use = (today in days) if force is None else force
    return day_items.unionByName(front) if use and front is not None else day_items


def front_page_failure(failures: DataFrame, front: DataFrame | None, days: list[str], today: str, force: bool | None = None) -> DataFrame:
    """``failures`` (day, message), with a row for a front page that was wanted and could not be read: its failure counts
    like a day's and stops nothing."""
    if front is not None or not ((today in days) if force is None else force):
        return failures
    row = failures.sparkSession.range(1).select(F.lit("front page").alias("day"), F.lit("not read").alias("message"))
    return failures.unionByName(row)


def lookup_missing(votes: DataFrame, items: DataFrame, raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Votes for unknown items: (items found in the source, votes that even the source does not know)."""
    unknown = votes.join(items.select("story_id"), "story_id", "left_anti")
    found = raw.join(unknown.select("story_id").distinct(), "story_id", "left_semi")
    return found, unknown.join(found.select("story_id"), "story_id", "left_anti")


def merge_items(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Upsert by id: newest title, url, domain and fetch time win, counts never fall, author and times stay as first
    seen. Doing it again changes nothing. Order is by fetched_at, current rows first."""
    return fold_items(
        current.select(*ITEM_COLUMNS).withColumn("__run", F.lit(0)).unionByName(incoming.select(*ITEM_COLUMNS).withColumn("__run", F.lit(1)))
    )


def sync_report(requested: DataFrame, current: DataFrame, incoming: DataFrame, failures: DataFrame) -> DataFrame:
    """Per requested day: fetched, inserted, failed. A failed day is stepped over, not fatal."""
    fetched = incoming.groupBy("day").agg(F.countDistinct("story_id").alias("fetched"))
    fresh = incoming.join(current.select("story_id"), "story_id", "left_anti")
    inserted = fresh.groupBy("day").agg(F.countDistinct("story_id").alias("inserted"))
    bad = failures.groupBy("day").agg(F.count("*").alias("failures"))
    out = requested.join(fetched, "day", "left").join(inserted, "day", "left").join(bad, "day", "left")
    return out.select(
        "day",
        F.coalesce("fetched", F.lit(0)).alias("fetched"),
        F.coalesce("inserted", F.lit(0)).alias("inserted"),
        F.col("failures").isNotNull().alias("failed"),
    )


def sync_totals(report: DataFrame, failures: DataFrame, front_page: bool, scored: DataFrame) -> DataFrame:
    """One row over a sync: days asked for, fetched_days, fetched, inserted, the failures that no day of the report names
    among them, the range, whether the front page was wanted, and how many pairs ``scored`` has."""
    every = report.agg(
        F.count("*").alias("days"),
        F.count_if(~F.col("failed")).alias("fetched_days"),
        F.coalesce(F.sum("fetched"), F.lit(0)).alias("fetched"),
        F.coalesce(F.sum("inserted"), F.lit(0)).alias("inserted"),
        F.min("day").alias("from_day"),
        F.max("day").alias("to_day"),
    )
    # a row a day
    listed = failures.agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws(": ", "day", "message"))), "; ").alias("failures"))
    return every.crossJoin(listed).crossJoin(scored.agg(F.count("*").alias("scored"))).withColumn("front_page", F.lit(front_page))


def audit_gap(corpus: DataFrame, dump: DataFrame, first: str, last: str, min_points: int = 3, unread: DataFrame | None = None) -> DataFrame:
    """A complete dump against the corpus, per day: scanned, stories over the floor, recovered (new), updated (known), and
    failed, the ids of ``unread`` (day, story_id) that the dump could not give."""
    if unread is not None:
        here = (F.col("day") >= first) & (F.col("day") <= last)
        bad = unread.where(here).groupBy("day").agg(F.countDistinct("story_id").alias("failed"))
        found = audit_gap(corpus, dump.join(unread.select("story_id"), "story_id", "left_anti"), first, last, min_points)
        both = found.drop("failed").join(bad, "day", "full")
        counts = ("scanned", "stories", "recovered", "updated", "failed")
        return both.select("day", *(F.coalesce(c, F.lit(0)).alias(c) for c in counts))
    some = dump.where((F.col("day") >= first) & (F.col("day") <= last))
    rows = some.join(corpus.select("story_id", F.lit(True).alias("known")), "story_id", "left")
    over = F.col("points") >= min_points
    return rows.groupBy("day").agg(
        F.count("*").alias("scanned"),
        F.count_if(over).alias("stories"),
        F.count_if(over & F.col("known").isNull()).alias("recovered"),
        F.count_if(over & F.col("known").isNotNull()).alias("updated"),
        F.lit(0).cast("long").alias("failed"),
    )


def repair_gap(corpus: DataFrame, dump: DataFrame, first: str, last: str, min_points: int = 3) -> DataFrame:
    some = dump.where((F.col("day") >= first) & (F.col("day") <= last) & (F.col("points") >= min_points))
    return merge_items(corpus, some)


def id_range_per_day(dump: DataFrame, pad: int = 200) -> DataFrame:
    """Padded id range of each day, clamped to the known ids, consecutive days not scanning an id twice."""
    per = dump.groupBy("day").agg(F.min("story_id").alias("a"), F.max("story_id").alias("z"))
    top = dump.agg(F.max("story_id").alias("top"))
    order = Window.orderBy("day")  # one row a day
    rows = per.crossJoin(top).select(
        "day", F.greatest(F.col("a") - pad, F.lit(1)).alias("lo"), F.least(F.col("z") + pad, "top").alias("hi")
    )
    seen = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("lo", F.greatest("lo", F.coalesce(seen + 1, F.lit(1))))


def export_votes(votes: DataFrame, items: DataFrame) -> DataFrame:
    rows = votes.join(items.select("story_id", "title", "url", "domain"), "story_id")
    return rows.select("user_id", "story_id", "value", "created_at", "title", "url", "domain").orderBy("user_id", "created_at", "story_id")


def valid_import() -> Column:
    return F.coalesce(F.col("value").isin(1, -1, 0) & (F.col("story_id") > 0) & (F.col("created_at") > 0), F.lit(False))


def import_votes(votes: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(votes, rejects): the supplied time wins on conflict, updated_at becomes created_at; importing again converges.
    ``batch`` has ``seq``, the line it stood on; the last valid line of an item wins. Votes and lines are dealt together,
    into partitions that follow their number, and grouped once."""
    keys, rest = ("user_id", "story_id"), ("value", "created_at", "updated_at")
    old = votes.select(*keys, *rest, F.struct(F.lit(0).alias("new"), F.lit(None).cast(batch.schema["seq"].dataType).alias("seq")).alias("at"))
    new = batch.where(valid_import()).select(
        *keys, "value", "created_at", F.col("created_at").alias("updated_at"), F.struct(F.lit(1).alias("new"), "seq").alias("at")
    )
    rows = dealt(old.unionByName(new), *keys).groupBy(*keys).agg(F.max_by(F.struct(*rest), "at").alias("v"))
    return rows.select(*keys, "v.*"), batch.where(~valid_import())


def write_items(items: DataFrame, path: str) -> None:
    """Parquet by day; a day written again replaces itself only."""
    items.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def scores_table(spark: SparkSession, path: str) -> MergeTable:
    keys = ["user_id", "story_id"]
    return MergeTable(spark, path, keys, newest(keys, "model_rev"))


def write_scores(scores: DataFrame, path: str, source: str = "", number: int | None = None, grid: tuple[DataFrame, DataFrame] | None = None) -> bool:
    """Upsert by user and item: what is written last holds, all other rows stay. A write with the ``number`` of one that its
    ``source`` has made already changes nothing. ``grid`` has the users and the items where ``scores`` are all their
    pairs, each once: nothing is folded then."""
    return scores_table(scores.sparkSession, path).write(scores, source, number, grid)


def read_scores(spark: SparkSession, path: str) -> DataFrame | None:
    return scores_table(spark, path).read()


def fold_items(rows: DataFrame) -> DataFrame:
    """Rows of one item in several runs (``__run``) as one: the rule of ``merge_items`` over any number of writes."""
    at = F.struct("__run", "fetched_at", "title", "url")
    new = F.max_by(F.struct("title", "url", "domain", "fetched_at"), at)
    old = F.min_by(F.struct("author", "created_at", "day"), at)
    out = rows.groupBy("story_id").agg(new.alias("n"), old.alias("o"), F.max("points").alias("points"), F.max("num_comments").alias("num_comments"))
    return out.select("story_id", "n.title", "n.url", "n.domain", "o.author", "points", "num_comments", "o.created_at", "o.day", "n.fetched_at")


def items_table(spark: SparkSession, path: str) -> MergeTable:
    return MergeTable(spark, path, ["story_id"], fold_items)
