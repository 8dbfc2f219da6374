"""Decks to judge: unjudged items in four strata, interleaved, for all users at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palate.functions.scalars import DAY, raw_offset
from palate.operators.ranking import numbered, permuted
from palate.sources.storage import scratch

SHARES = (("boundary", 0.4), ("novel", 0.2), ("recent", 0.2), ("explore", 0.2))
CONFIDENT, NEAR, RECENT_DAYS = 0.4, 0.15, 3


def unjudged(pairs: DataFrame, votes: DataFrame) -> DataFrame:
    """Pairs (user_id, story_id) without a vote of any value."""
    return pairs.join(votes.select("user_id", "story_id"), ["user_id", "story_id"], "left_anti")


def unjudged_counts(users: DataFrame, items: DataFrame, votes: DataFrame) -> DataFrame:
    """(user_id, n): how many of ``items`` each of ``users`` has not judged, where there are any. All items less those
    judged, so no pair is made."""
    stories = items.select("story_id").distinct()
    judged = votes.select("user_id", "story_id").distinct().join(stories, "story_id").groupBy("user_id").agg(F.count("*").alias("judged"))
    every = users.select("user_id").distinct().crossJoin(stories.agg(F.count("*").alias("every")))  # a number beside each user
    n = F.col("every") - F.coalesce("judged", F.lit(0))
    return every.join(judged, "user_id", "left").select("user_id", n.alias("n")).where("n > 0")


def heads(users: DataFrame, ranking: DataFrame, votes: DataFrame, depth: int) -> DataFrame:
    """(user_id, rank, and the columns of ``ranking``): the first ``depth`` unjudged rows of one ranking (rank from 0,
    story_id) that all share, and some more. A user looks as deep as ``depth`` and the own votes on ranked items reach."""
    cast = votes.select("user_id", "story_id").join(ranking.select("story_id"), "story_id").groupBy("user_id").agg(F.count("*").alias("cast"))
    reach = users.select("user_id").join(cast, "user_id", "left").withColumn("reach", F.coalesce("cast", F.lit(0)) + depth - 1)
    pairs = reach.select("user_id", F.explode(F.sequence(F.lit(0).cast("long"), "reach")).alias("rank")).join(ranking, "rank")
    return unjudged(pairs, votes)


def cold_queue(users: DataFrame, items: DataFrame, votes: DataFrame, limit: int = 12, min_points: int = 10) -> DataFrame:
    """For users without a model: the most discussed unjudged items, from one ranking of all."""
    some = items.where(F.col("points") >= min_points).select("story_id", "num_comments")
    ranking = numbered(some, "rank", F.desc("num_comments"), F.desc("story_id"))
    order = Window.partitionBy("user_id").orderBy("rank")
    out = heads(users, ranking, votes, limit).withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= limit)
    return out.drop("rank").withColumn("reason", F.lit("popular"))


def allocate(limit: int, shares: tuple[tuple[str, float], ...] = SHARES) -> dict[str, int]:
    """Largest-remainder split of ``limit``; ties go to the earlier stratum."""
    exact = [(name, round(limit * share, 9)) for name, share in shares]
    out = {name: int(x) for name, x in exact}
    left = limit - sum(out.values())
    for _, name in sorted(((int(x) - x, i), name) for i, (name, x) in enumerate(exact))[:left]:
        out[name] += 1
    return out


def allocate_each(limits: DataFrame, shares: tuple[tuple[str, float], ...] = SHARES) -> DataFrame:
    """``allocate`` for every number of ``cards`` of a table: (cards, reason, quota)."""
    rows = limits.select("cards").distinct().select("cards", F.inline(F.array(*(
        F.struct(F.lit(i).alias("number"), F.lit(name).alias("reason"), F.lit(share).alias("share")) for i, (name, share) in enumerate(shares)
    ))))
    exact = F.round(F.col("cards") * F.col("share"), 9)
    rows = rows.withColumns({"whole": F.floor(exact), "rest": F.round(exact - F.floor(exact), 9)})
    every = Window.partitionBy("cards")
    left = F.col("cards") - F.sum("whole").over(every)
    turn = F.row_number().over(every.orderBy(F.desc("rest"), "number"))
    return rows.select("cards", "reason", (F.col("whole") + (turn <= left).cast("long")).alias("quota"))


def sampling_key(rev: Column, cursor: Column) -> Column:
    """A portable draw: the same user, revision and cursor give the same order, others another one."""
    m = 4294967296
    s = (F.col("user_id") * 374761393 + rev * 668265263 + cursor * 2246822519) % m
    x = (F.col("story_id") * 2654435761 + s) % m
    return ((x * ((x % 65536) * 2 + 1)) % m).cast("long")


def candidates(items: DataFrame, scores: DataFrame, votes: DataFrame | None, runs: DataFrame, cursor: int, min_points: int) -> DataFrame:
    """Scored, unjudged items over the points floor of every user with a model, with score columns and the draw's key.
    Without ``votes`` the scores hold no judged item."""
    some = items.where(F.col("points") >= min_points).select("story_id")
    pairs = scores.select("user_id", "story_id", "score", "confidence").join(some, "story_id").join(runs.select("user_id", "rev"), "user_id")
    return (pairs if votes is None else voted_out(pairs, votes)).withColumns(
        {
            "offset": F.round(raw_offset(F.col("score"), F.col("confidence")), 9),
            "key": sampling_key(F.col("rev"), F.lit(cursor).cast("long")),
        }
    )


def _take(df: DataFrame, reason: str, quota: int, *order: Column) -> DataFrame:
    at = F.row_number().over(Window.partitionBy("user_id").orderBy(*order, "story_id"))
    return df.withColumn("at", at).where(F.col("at") <= quota).select("user_id", "story_id", F.lit(reason).alias("reason"), "at")


def stratum_boundary(c: DataFrame, quota: int) -> DataFrame:
    """Sure of itself, yet near one half."""
    near = (F.col("confidence") >= CONFIDENT) & (F.abs("offset") <= NEAR)
    return _take(c.where(near), "boundary", quota, F.col("key"))


def stratum_novel(c: DataFrame, quota: int) -> DataFrame:
    return _take(c.where((F.col("confidence") >= 0) & (F.col("confidence") < CONFIDENT)), "novel", quota, F.col("key"))


def recent_heads(users: DataFrame, items: DataFrame, votes: DataFrame, depth: int, as_of: int, min_points: int) -> DataFrame:
    """(user_id, story_id, rank): the most discussed unjudged items of the last days, from one ranking of all."""
    some = items.where((F.col("points") >= min_points) & (F.col("created_at") >= as_of - RECENT_DAYS * DAY)).select("story_id", "num_comments")
    return heads(users, numbered(some, "rank", F.desc("num_comments"), F.desc("story_id")), votes, depth).select("user_id", "story_id", "rank")


def stratum_recent(users: DataFrame, items: DataFrame, votes: DataFrame, quota: int, cursor: int, as_of: int, min_points: int, picked: DataFrame) -> DataFrame:
    """The most discussed of the last days, scored or not, a page further for each cursor; three quotas are looked at."""
    start = (cursor % 8) * quota
    order = Window.partitionBy("user_id").orderBy("rank")
    some = recent_heads(users, items, votes, start + 3 * quota, as_of, min_points).withColumn("page", F.row_number().over(order))
    some = some.where((F.col("page") > start) & (F.col("page") <= start + 3 * quota))
    return _take(some.join(picked, ["user_id", "story_id"], "left_anti"), "recent", quota, F.col("page"))


def explore_heads(users: DataFrame, items: DataFrame, votes: DataFrame, want: int, cursor: int, min_points: int) -> DataFrame:
    """(user_id, story_id, place): the first ``want`` unjudged items over the points floor of each user's own random order
    of all of them, and some more. ``users`` has (user_id, rev). The order is a permutation of the items' numbers, so its
    head is computed place by place; who has judged too much of it looks four times as far the next time."""
    spark = users.sparkSession
    path = scratch(spark, "numbers")
    numbered(items.where(F.col("points") >= min_points).select("story_id"), "number", F.col("story_id")).write.parquet(path)
    numbers = spark.read.parquet(path)
    bits = max((numbers.count() - 1).bit_length(), 1)
    keys = (F.col("user_id"), F.col("rev").cast("long"), F.lit(cursor).cast("long"))
    todo, found, low, high = users.select("user_id", "rev"), [], 0, min(4 * want, 1 << bits)
    while True:
        places = F.sequence(F.lit(low).cast("long"), F.lit(high - 1).cast("long"))
        draws = todo.select("user_id", "rev", F.explode(places).alias("place"))
        draws = draws.withColumn("number", permuted(keys, F.col("place"), bits)).join(numbers, "number")
        path = scratch(spark, "draws")
        unjudged(draws.select("user_id", "story_id", "place"), votes).write.parquet(path)
        found.append(spark.read.schema("user_id long, story_id long, place long").parquet(path))
        every = reduce(DataFrame.unionByName, found)
        if high == 1 << bits:
            return every
        enough = every.groupBy("user_id").agg(F.count("*").alias("n")).where(F.col("n") >= want)
        todo = users.select("user_id", "rev").join(enough, "user_id", "left_anti")
        if todo.isEmpty():
            return every
        low, high = high, min(4 * high, 1 << bits)


def stratum_explore(users: DataFrame, items: DataFrame, votes: DataFrame, quota: int, cursor: int, min_points: int) -> DataFrame:
    """Any unjudged item, scored or not, all alike."""
    return _take(explore_heads(users, items, votes, quota, cursor, min_points), "explore", quota, F.col("place"))


def fill_from_boundary(c: DataFrame, deck: DataFrame, limit: int) -> DataFrame:
    """Top up short decks with what is nearest one half, the upper side first."""
    have = deck.groupBy("user_id").agg(F.count("*").alias("have"))
    rest = c.where("offset is not null").join(deck.select("user_id", "story_id"), ["user_id", "story_id"], "left_anti")
    order = Window.partitionBy("user_id").orderBy(F.abs("offset"), (F.col("offset") < 0).cast("int"), "story_id")
    rest = rest.withColumn("at", F.row_number().over(order)).join(have, "user_id", "left")
    rest = rest.where(F.col("at") <= limit - F.coalesce("have", F.lit(0)))
    return rest.select("user_id", "story_id", F.lit("boundary").alias("reason"), "at", F.coalesce("have", F.lit(0)).alias("have"))


def interleave(picked: DataFrame) -> DataFrame:
    """Round robin over strata: ``pos`` from 1."""
    number = F.when(F.lit(False), -1)
    for i, (name, _) in enumerate(SHARES):
        number = number.when(F.col("reason") == name, i)
    order = Window.partitionBy("user_id").orderBy("at", number)
    return picked.withColumn("pos", F.row_number().over(order))


def voted_out(pairs: DataFrame, votes: DataFrame, most: int = 2_000_000) -> DataFrame:
    """``unjudged``, with the votes sent to every task where they are counted to be at most ``most``; else both sides
    are shuffled."""
    some = votes.select("user_id", "story_id")
    return pairs.join(F.broadcast(some) if some.count() <= most else some, ["user_id", "story_id"], "left_anti")


def training_queue(items: DataFrame, scores: DataFrame, votes: DataFrame, runs: DataFrame, limit: int = 12, cursor: int = 0, min_points: int = 10, as_of: int = 0, unjudged_scores: bool = False) -> DataFrame:
    """A deck of up to ``limit`` cards for every user with a model: (user_id, story_id, reason, pos). Each stratum leaves
    out what an earlier one took; the same revision and cursor deal the same deck.

    One pass over the scores finds the few rows at the head of each scored stratum's order, before anything is shuffled;
    recent items come from one ranking that all users share, explored ones from each user's permutation. No users and
    items are crossed. Strata then exclude each other among those rows, all on one shuffle by user. With
    ``unjudged_scores`` the scores hold no judged item, and are not held against the votes."""
    quota = allocate(limit)
    some = items.where(F.col("points") >= min_points).select("story_id")
    model = runs.select("user_id", "rev")
    key = sampling_key(F.col("rev"), F.lit(cursor).cast("long"))
    offset = F.round(raw_offset(F.col("score"), F.col("confidence")), 9)
    zero = F.lit(0).cast("double")
    scored = scores.select("user_id", "story_id", "score", "confidence").join(some, "story_id").join(model, "user_id")
    near = (F.col("confidence") >= CONFIDENT) & (F.abs("offset") <= NEAR)
    stratum = F.when(near, "boundary").when((F.col("confidence") >= 0) & (F.col("confidence") < CONFIDENT), "novel")
    tag = lambda name, first, second: F.struct(name.alias("tag"), first.cast("double").alias("first"), second.cast("double").alias("second"))
    scored = scored.withColumns({"offset": offset, "key": key})
    scored = scored.select("user_id", "story_id", F.inline(F.array(
        tag(stratum, F.col("key"), zero),
        tag(F.lit("fill"), F.abs("offset"), (F.col("offset") < 0).cast("int")),
    )))
    start = (cursor % 8) * quota["recent"]
    recent = recent_heads(model, items, votes, start + 3 * quota["recent"], as_of, min_points)
    recent = recent.select("user_id", "story_id", F.lit("recent").alias("tag"), F.col("rank").cast("double").alias("first"), zero.alias("second"))
    explore = explore_heads(model, items, votes, limit, cursor, min_points)
    explore = explore.select("user_id", "story_id", F.lit("explore").alias("tag"), F.col("place").cast("double").alias("first"), zero.alias("second"))
    scored = scored.where("tag is not null and first is not null")
    rows = (scored if unjudged_scores else voted_out(scored, votes)).unionByName(recent).unionByName(explore)
    deep = {
        "boundary": quota["boundary"], "novel": quota["novel"], "recent": start + 3 * quota["recent"], "explore": limit, "fill": 2 * limit,
    }
    head = Window.partitionBy("user_id", "tag").orderBy("first", "second", "story_id")
    rows = rows.withColumn("at", F.row_number().over(head)).where(F.col("at") <= max(deep.values()))
    wanted = F.lit(False)
    for name, n in deep.items():
        wanted = wanted | (F.col("tag") == name) & (F.col("at") <= n) & (F.col("at") > (start if name == "recent" else 0))
    rows = rows.where(wanted).withColumn("taken", F.col("tag").isin("boundary", "novel"))
    story = Window.partitionBy("user_id", "story_id")
    for name, n in (("recent", quota["recent"]), ("explore", quota["explore"]), ("fill", None)):
        rows = rows.withColumn("gone", F.max("taken").over(story))
        left = (F.col("tag") == name) & ~F.col("gone")
        place = F.row_number().over(Window.partitionBy("user_id", "tag").orderBy(F.col("gone"), "at"))
        have = F.count_if("taken").over(Window.partitionBy("user_id"))
        rows = rows.withColumns({"place": place, "have": have})
        take = left & (F.col("place") <= (F.lit(limit) - F.col("have") if n is None else n))
        rows = rows.withColumns({"taken": F.col("taken") | take, "at": F.when(F.col("tag") == name, F.col("place")).otherwise(F.col("at"))})
    deck = rows.where("taken").select("user_id", "story_id", F.col("tag").alias("reason"), "at", "have")
    dealt = interleave(deck.where("reason <> 'fill'")).select("user_id", "story_id", "reason", "pos")
    fill = deck.where("reason = 'fill'").select("user_id", "story_id", F.lit("boundary").alias("reason"), (F.col("have") + F.col("at")).cast("int").alias("pos"))
    return dealt.unionByName(fill)


def explored(items: DataFrame, days: int, as_of: int) -> DataFrame:
    """Items that ``explore_queue`` looks at."""
    some = items.where((F.col("points") >= 50) | (F.col("num_comments") >= 25))
    return some.where(F.col("created_at") >= as_of - days * DAY) if days > 0 else some


def explore_queue(items: DataFrame, scores: DataFrame, votes: DataFrame, users: DataFrame, runs: DataFrame, limit: int = 25, days: int = 7, bar: float = 0.35, as_of: int = 0, unjudged_scores: bool = False) -> DataFrame:
    """What the crowd rates and the user has not judged: (user_id, story_id, tier, pos). With a model, items under
    ``bar`` and unscored ones go; 0 days is the whole corpus. Users with a model are read from their scores, the others
    share one ranking. With ``unjudged_scores`` the scores hold no judged item, and only heads are shuffled."""
    some = explored(items, days, as_of).select("story_id", "points", "num_comments")
    cold = users.select("user_id").distinct().join(runs.select("user_id"), "user_id", "left_anti")
    ranking = numbered(some, "rank", F.desc("num_comments"), F.desc("points"), F.desc("story_id"))
    cold = heads(cold, ranking, votes, limit).select("user_id", "story_id", "points", "num_comments", F.lit(None).cast("double").alias("score"), F.lit(None).cast("boolean").alias("model"))
    known = users.select("user_id").distinct().join(runs.select("user_id"), "user_id", "left_semi")
    warm = scores.where(F.col("score") >= bar).select("user_id", "story_id", "score").join(some, "story_id").join(known, "user_id", "left_semi")
    warm = (warm if unjudged_scores else unjudged(warm, votes)).select("user_id", "story_id", "points", "num_comments", "score", F.lit(True).alias("model"))
    pairs = cold.unionByName(warm)
    probably = F.col("model").isNotNull() & (F.col("score") >= 0.6)
    pairs = pairs.withColumn("tier", F.when(probably, "probably").otherwise("possibly"))
    order = Window.partitionBy("user_id").orderBy(
        F.desc("tier"),
        F.when(F.col("tier") == "probably", F.col("score")).desc_nulls_last(),
        F.desc("num_comments"),
        F.desc("points"),
        F.desc("story_id"),
    )
    return pairs.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= limit).select("user_id", "story_id", "tier", "pos")


def deck_mix(deck: DataFrame) -> DataFrame:
    return deck.groupBy("user_id", "reason").agg(F.count("*").alias("cards"))
