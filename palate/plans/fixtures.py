"""The engine's tables derived from the driver's: items, vote events, votes, a fixture model, histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palate.functions.scalars import day_key
from palate.functions.text import domain_of
from palate.operators.decks import CONFIDENT, NEAR
from palate.operators.features import beside, featurize
from palate.operators.reports import every_bin, score_distribution
from palate.operators.score import binned_scores, deck_scores, rescore_all
from palate.operators.votes import fold_votes, labelled_examples, training_gate
from palate.sources.storage import scratch

AS_OF = 1706659200


def kept(make):
    """A derived table: read where ``Tables.store`` has written it for this folder, else made; those of ``ONCE``, which a
    query meets in several places, are written at their first use and read after that."""
    name = make.__name__

    def table(self: Tables) -> DataFrame:
        if (at := self.stored.get(self.dir)) and self.making != name:
            return self.spark.read.parquet(f"{at}/{name}")
        if name not in self.ONCE or self.making == name:
            return make(self)
        if name not in self.once:
            self.once[name] = scratch(self.spark, name)
            make(self).write.parquet(self.once[name])
        return self.spark.read.parquet(self.once[name])

    return table


class Tables:
    """Tables of one scale folder, each made on first use. A title is the first line of a document."""

    stored: dict[str, str] = {}
    making: str | None = None
    KEPT = ("items", "votes", "features", "examples", "model", "runs", "scores")
    ONCE = ("features", "examples")

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        self.once: dict[str, str] = {}

    def store(self, path: str) -> None:
        """Write the derived tables that most operators start from, as an engine keeps them, and read them from there."""
        self.stored[self.dir] = path
        for name in self.KEPT:
            self.making = name
            getattr(self, name)().write.parquet(f"{path}/{name}")
        self.making = None

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def sizes(self) -> tuple[int, int, int]:
        return tuple(self.raw(n).count() for n in ("documents", "pages", "events"))

    @kept
    def items(self) -> DataFrame:
        nd, np_, ne = self.sizes()
        docs = self.raw("documents").select(
            "doc_id",
            (F.col("doc_id") + 1).alias("story_id"),
            F.trim(F.substring_index("text", "\n", 1)).alias("title"),
            F.col("source").alias("author"),
            F.when(F.col("doc_id") % 7 != 0, F.col("doc_id") % np_).alias("page_id"),
        )
        events = self.raw("events").select("event_id", "ts", "value", F.get_json_object("props", "$.k").cast("long").alias("k"))
        sums = events.groupBy((F.col("event_id") % nd).alias("doc_id")).agg(
            F.floor(F.sum(F.col("value").cast("decimal(18,6)")) / 12).cast("long").alias("points"),
            F.floor(F.sum("k") / 24).cast("long").alias("num_comments"),
        )
        step = ne // nd
        times = events.where(F.col("event_id") % step == 0).select(
            F.floor(F.col("event_id") / step).alias("doc_id"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("created_at")
        )
        out = docs.join(sums, "doc_id", "left").join(times, "doc_id").join(self.raw("pages").select("page_id", "url"), "page_id", "left")
        return out.select(
            "story_id",
            "title",
            "url",
            domain_of(F.col("url")).alias("domain"),
            "author",
            F.coalesce("points", F.lit(0)).alias("points"),
            F.coalesce("num_comments", F.lit(0)).alias("num_comments"),
            "created_at",
            day_key(F.col("created_at")).alias("day"),
            F.lit(AS_OF).cast("long").alias("fetched_at"),
        )

    def vote_events(self, tombstones: bool = False) -> DataFrame:
        nd = self.raw("documents").count()
        e = self.raw("events").select(
            "event_id", "user_id", "event_type", F.unix_seconds(F.col("ts").cast("timestamp")).alias("ts"),
            (F.col("event_id") * 7 % nd).alias("doc_id"),
        ).join(self.raw("documents").select("doc_id", "lang"), "doc_id")
        favourite = F.element_at(F.array(*map(F.lit, ("en", "fr", "de", "es"))), (F.col("user_id") % 4 + 1).cast("int"))
        sign = F.when(F.col("lang") == favourite, 1).otherwise(-1) * F.when(F.col("event_type") == "error", -1).otherwise(1)
        value = F.when(F.col("event_type") == "signup", 0).otherwise(sign)
        if tombstones:
            value = F.when(F.col("event_id") % 97 != 0, value)
        return e.select("user_id", (F.col("doc_id") + 1).alias("story_id"), value.alias("value"), "ts", "event_id")

    @kept
    def votes(self) -> DataFrame:
        return fold_votes(self.vote_events())

    @kept
    def features(self) -> DataFrame:
        return featurize(self.items())

    @kept
    def examples(self) -> DataFrame:
        return labelled_examples(self.votes(), self.items())

    @kept
    def model(self) -> DataFrame:
        return self._weights(0).drop("was", "before")

    def weights(self, drop: int = 0) -> DataFrame:
        """A fixture model, not a trained one: log odds of up and down votes on a feature. ``drop`` leaves out that many
        of each user's first examples, which gives a second revision."""
        return self._weights(drop, drop).drop("was", "before") if drop else self.model()

    def revisions(self, drop: int) -> DataFrame:
        """``weights()`` beside ``weights(drop)`` from one pass over the examples: ``was`` is a feature's weight there, null
        without one; ``before`` tells whether the user has any there."""
        return self._weights(0, drop)

    def _weights(self, drop: int, other: int = 0) -> DataFrame:
        rows = beside(self.examples().where(F.col("ord") >= drop), self.features())

        def odds(some: Column) -> Column:
            up, down = F.count_if(some & (F.col("label") == 1)), F.count_if(some & (F.col("label") == 0))
            return F.round(F.log((up + 1) / (down + 1)), 6)

        late = F.col("ord") >= other
        w = rows.groupBy("user_id", "feature").agg(
            odds(F.lit(True)).alias("weight"), F.count("*").alias("support"), F.when(F.count_if(late) > 0, odds(late)).alias("was")
        )
        user = Window.partitionBy("user_id")
        w = w.withColumn("idx", F.row_number().over(user.orderBy("feature")) - 1)
        return w.withColumn("before", F.count("was").over(user) > 0)

    @kept
    def runs(self) -> DataFrame:
        """Current models of all users past the training gate."""
        n = self.examples().groupBy("user_id").agg(
            F.count("*").alias("n_votes"), F.count_if(F.col("label") == 1).alias("n_pos"), F.count_if(F.col("label") == 0).alias("n_neg")
        )
        gate = training_gate(self.votes()).where("trainable").select("user_id")
        return n.join(gate, "user_id").withColumns({"rev": F.lit(2), "trained_at": F.lit(AS_OF - 86_400 * 3).cast("long")})

    @kept
    def scores(self) -> DataFrame:
        return rescore_all(self.features(), self.weights(), self.runs())

    def unjudged_scores(self, items: DataFrame, runs: DataFrame) -> DataFrame:
        """``scores()`` of ``items`` for the users of ``runs``, without what they have judged; nothing else is scored."""
        if self.stored.get(self.dir):
            some = self.scores().join(items.select("story_id"), "story_id", "left_semi").join(runs.select("user_id"), "user_id", "left_semi")
            return some.join(self.votes().select("user_id", "story_id"), ["user_id", "story_id"], "left_anti")
        some = self.features().join(items.select("story_id"), "story_id", "left_semi")
        return rescore_all(some, self.weights(), runs, self.votes().select("user_id", "story_id"))

    def deck_scores(self, items: DataFrame, limit: int, cursor: int) -> DataFrame:
        """``unjudged_scores`` of ``items``, as far as decks of ``limit`` cards reach: each order twice as deep as they look."""
        if self.stored.get(self.dir):
            return self.unjudged_scores(items, self.runs())
        some = self.features().join(items.select("story_id"), "story_id", "left_semi")
        votes = self.votes().select("user_id", "story_id")
        return deck_scores(some, self.weights(), self.runs(), votes, 4 * limit, cursor, CONFIDENT, NEAR)

    def distribution(self, bins: int = 20) -> DataFrame:
        """Each user's never-judged items by score bin. Where scores are not stored they are counted in the tasks that make
        them."""
        if self.stored.get(self.dir):
            return score_distribution(self.scores(), self.votes(), self.runs(), bins)
        parts = binned_scores(self.features(), self.weights(), self.runs(), self.votes().select("user_id", "story_id"), bins)
        return every_bin(parts.groupBy("user_id", "bin").agg(F.sum("n").alias("n")), self.runs(), bins)

    def history(self) -> DataFrame:
        """Score history without a model: two revisions scored at fixed times, values from the ids."""
        v = self.votes().select("user_id", "story_id").distinct()
        h = F.pmod(F.col("user_id") * 37 + F.col("story_id") * 101, F.lit(1000)) / 1000.0
        a = v.select("*", h.alias("score"), F.lit(0.5).alias("confidence"), F.lit(1).alias("model_rev"), F.lit(AS_OF - 20 * 86_400).cast("long").alias("scored_at"))
        h2 = F.pmod(F.col("user_id") * 53 + F.col("story_id") * 211, F.lit(1000)) / 1000.0
        b = v.where("story_id % 3 <> 0").select("*", h2.alias("score"), F.lit(0.75).alias("confidence"), F.lit(2).alias("model_rev"), F.lit(AS_OF - 10 * 86_400).cast("long").alias("scored_at"))
        return a.unionByName(b)

    def oof(self) -> DataFrame:
        """Held-out scores of two revisions, from the same history."""
        return self.history().select("user_id", "story_id", "score", "model_rev")

    def run_log(self) -> DataFrame:
        """Six revisions of every user with metrics from the ids; consecutive ones can repeat a vote count."""
        users = self.votes().select("user_id").distinct()
        rows = users.select("user_id", F.explode(F.sequence(F.lit(1), F.lit(6))).alias("rev"))
        u, r = F.col("user_id"), F.col("rev")
        return rows.select(
            "user_id",
            "rev",
            (F.lit(AS_OF) - (6 - r) * 86_400 * 4).cast("long").alias("trained_at"),
            (F.lit(40) + F.floor((r + u % 2) / 2) * 5).cast("long").alias("n_votes"),
            F.when((u + r) % 5 != 0, F.lit(0.5) + F.pmod(u * 7 + r * 13, F.lit(40)) / 100.0).alias("accuracy"),
            (F.lit(0.5) + F.pmod(u, F.lit(10)) / 100.0).alias("baseline"),
            (F.lit(0.5) + F.pmod(u * 11 + r * 17, F.lit(50)) / 100.0).alias("auc"),
            (F.lit(0.02) + F.pmod(u + r, F.lit(5)) / 100.0).alias("noise"),
        )

    def hits(self) -> DataFrame:
        """Items as search-API JSON, every 50th broken."""
        i = self.items()
        bad = F.col("story_id") % 50 == 0
        s = F.struct(
            F.when(F.col("story_id") % 100 == 50, F.lit("x")).otherwise(F.col("story_id").cast("string")).alias("objectID"),
            F.when(bad, F.lit(" ")).otherwise(F.concat(F.lit(" "), "title")).alias("title"),
            F.when(F.col("story_id") % 150 == 0, F.lit("told elsewhere")).alias("story_title"),
            F.col("url").alias("url"),
            F.col("author").alias("author"),
            F.when(F.col("story_id") % 11 != 0, F.col("points")).alias("points"),
            F.col("num_comments").alias("num_comments"),
            F.when(F.col("story_id") % 49 != 0, F.col("created_at")).alias("created_at_i"),
        )
        return i.select(F.to_json(s).alias("json"))

    def item_json(self) -> DataFrame:
        i = self.items()
        k = F.col("story_id") % 50
        s = F.struct(
            F.col("story_id").alias("id"),
            F.when(k == 1, "comment").otherwise("story").alias("type"),
            F.col("author").alias("by"),
            F.when(k != 2, F.col("created_at")).alias("time"),
            F.when(k != 3, F.col("title")).alias("title"),
            F.col("url").alias("url"),
            F.col("points").alias("score"),
            F.when(k != 4, F.col("num_comments")).alias("descendants"),
            F.when(k == 5, F.lit(True)).alias("dead"),
            F.when(k == 6, F.lit(True)).alias("deleted"),
        )
        return i.select(F.to_json(s).alias("json"))
