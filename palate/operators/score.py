"""Scoring: items x users, shrunk by evidence.

A join of features with weights makes a row for each feature that an item and a user share, and features that stand in
nearly every item are its hot keys. Where the whole grid of items and users is wanted, some items and some users are a
tile, a row with their features as numbers, and each pair of tiles is a product of matrices. Tiles are stored once and
crossed partition by partition; ``score_pairs`` joins by name for given pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palate.functions.scalars import sigmoid
from palate.functions.text import describe_feature
from palate.sources.storage import scratch, written

FULL_VOTES, FULL_CLASS = 40.0, 8.0


def is_content(feature: Column) -> Column:
    return (feature != "__bias__") & ~feature.startswith("t:")


def evidence(z: Column, known: Column, mass: Column, n: Column, pos: Column, neg: Column) -> Column:
    """Struct (z, raw, coverage, confidence, score). Sums are rounded before they are used and results after, so that
    rankings and limits agree whatever the order of summation."""
    z, known, mass = F.round(z, 9), F.round(known, 6), F.round(mass, 6)
    coverage = F.when(mass > 0, known / mass).otherwise(0.0)
    volume = F.least(n / F.lit(FULL_VOTES), F.lit(1.0))
    balance = F.least(F.least(pos, neg) / F.lit(FULL_CLASS), F.lit(1.0))
    sure = volume * balance * (F.lit(0.3) + F.lit(0.7) * coverage)
    confidence = F.least(F.greatest(sure, F.lit(0.0)), F.lit(1.0))
    raw = sigmoid(z)
    score = F.lit(0.5) + (raw - F.lit(0.5)) * (F.lit(0.3) + F.lit(0.7) * confidence)
    parts = (("z", z), ("raw", raw), ("coverage", coverage), ("confidence", confidence), ("score", score))
    return F.struct(*(F.round(c, 9).alias(n) for n, c in parts))


def score_pairs(pairs: DataFrame, features: DataFrame, weights: DataFrame, counts: DataFrame, keys: list[str]) -> DataFrame:
    """``pairs`` (keys, story_id, ...) with z, raw, coverage, confidence and score under the model that ``keys`` names in
    ``weights``; ``counts`` (keys, n_votes, n_pos, n_neg) says how much each has seen. Pairs without a model go."""
    mass = features.where(is_content(F.col("feature"))).groupBy("story_id").agg(F.sum("value").alias("mass"))
    joined = pairs.select(*keys, "story_id").distinct().join(features, "story_id").join(
        weights.select(*keys, "feature", "weight"), [*keys, "feature"]
    )
    sums = joined.groupBy(*keys, "story_id").agg(
        F.sum(F.col("value") * F.col("weight")).alias("z"),
        F.sum(F.when(is_content(F.col("feature")), F.col("value")).otherwise(0.0)).alias("known"),
    )
    model = counts.select(*keys, "n_votes", "n_pos", "n_neg")
    out = pairs.join(model, keys).join(sums, [*keys, "story_id"], "left").join(mass, "story_id", "left")
    s = evidence(
        F.coalesce("z", F.lit(0.0)), F.coalesce("known", F.lit(0.0)), F.coalesce("mass", F.lit(0.0)),
        F.col("n_votes"), F.col("n_pos"), F.col("n_neg"),
    )
    return out.withColumn("s", s).select(*pairs.columns, "s.z", "s.raw", "s.coverage", "s.confidence", "s.score")


def sums_by_user(pairs: DataFrame, features: DataFrame, weights: DataFrame) -> DataFrame:
    """``pairs`` (user_id, story_id, label) with z, the sum of value * weight, where a user has weights: an item is one row
    with all its features, and a user's items meet the user's weights in one task."""
    from palate.operators.model import packed

    def run(items: pa.Table, own: pa.Table) -> pa.Table:
        lists = items["entries"].combine_chunks()
        feature, value = lists.flatten().flatten() if len(lists) else (pa.array([], pa.string()), pa.array([], pa.float64()))
        row = np.repeat(np.arange(len(items)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        at = pc.fill_null(pc.index_in(feature, value_set=own["feature"].combine_chunks()), -1).to_numpy(zero_copy_only=False)
        weight = np.append(own["weight"].to_numpy(), 0.0)[at]
        z = np.bincount(row, weights=value.to_numpy() * weight, minlength=len(items))
        out = items.select(["user_id", "story_id", "label"]).append_column("z", pa.array(z))
        return out if len(own) else out.slice(0, 0)

    rows = pairs.select("user_id", "story_id", F.col("label").cast("int").alias("label")).join(packed(features), "story_id")
    both = rows.groupBy("user_id").cogroup(weights.select("user_id", "feature", "weight").groupBy("user_id"))
    return both.applyInArrow(run, "user_id long, story_id long, label int, z double")


#: Stories and users of a tile, what is multiplied at once; blocks of the grid are tiles doubled until they are few, or
#: a side of a block has that many entries.
STORIES, USERS, BLOCKS, ENTRIES = 4096, 256, 64, 16_000_000
#: Ids of one bitmap: what Spark's bitmap functions put into one bucket.
BITS = 32768
#: Features of a tile that are multiplied at once.
WIDE = 1024

_SCORE = "user_id long, story_id long, score double, confidence double, model_rev int"
_BEST = _SCORE + ", scoped long"
_BIN = "user_id long, bin int, n long"

#: A stored tile: ids, numbers a row, the names' two numbers and times, each entry's owner and value, who has judged what, and
#: who lacks what of a bucket.
_FIELDS = {
    "id": "long", "numbers": "long", "code": "long", "other": "int", "times": "int", "owner": "short", "value": "double", "voted": "long", "votes": "int",
    "buckets": "long", "gaps": "int", "lack": "binary",
}
#: Entries of a stored tile, and of the stories of one partition.
TILE = 1_000_000
#: Examples of the users whose weights are made and stored at once.
EXAMPLES = 1_500_000


def _rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """``x`` rounded half away from zero, as SQL does."""
    return np.copysign(np.floor(np.abs(x) * 10.0**digits + 0.5), x) / 10.0**digits + 0.0


def _evidence(z: np.ndarray, known: np.ndarray, mass: np.ndarray, n: np.ndarray, pos: np.ndarray, neg: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``evidence``'s score and confidence of stories (rows) for users (columns)."""
    z, known, mass = _rounded(z, 9), _rounded(known, 6), _rounded(mass, 6)[:, None]
    coverage = np.divide(known, mass, out=np.zeros_like(known), where=mass > 0)
    sure = np.minimum(n / FULL_VOTES, 1.0) * np.minimum(np.minimum(pos, neg) / FULL_CLASS, 1.0) * (0.3 + 0.7 * coverage)
    confidence = np.clip(sure, 0.0, 1.0)
    raw = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
    return _rounded(0.5 + (raw - 0.5) * (0.3 + 0.7 * confidence), 9), _rounded(confidence, 9)


class _Tile:
    """Some stories or users: ids, and their entries (owner, value) sorted by code, those of one code together."""

    #: A second number of each name, and whether two names have one code, where the tile knows.
    other, twins = None, False

    def __init__(self, ids: np.ndarray, lengths: np.ndarray, code: np.ndarray, value: np.ndarray):
        order = np.argsort(code, kind="stable")
        code = code[order]
        first = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1]))) if len(code) else np.zeros(0, dtype=np.int64)
        owner = np.repeat(np.arange(len(ids)), lengths)[order]
        self._set(ids, code[first], np.diff(np.append(first, len(code))), owner, value[order])

    def _set(self, ids: np.ndarray, names: np.ndarray, times: np.ndarray, owner: np.ndarray, value: np.ndarray) -> None:
        self.id, self.names, self.times, self.owner, self.value = ids, names, times, owner, value
        self.first = np.cumsum(times) - times
        self.content = value * np.repeat(names & 1, times)
        self.mass = np.bincount(owner, weights=self.content, minlength=len(ids))

    @classmethod
    def of(cls, row: dict[str, np.ndarray]) -> _Tile:
        """A tile as ``_tiling`` has stored it, with the rows' numbers and what each has judged."""
        tile = cls.__new__(cls)
        tile._set(row["id"], row["code"], row["times"].astype(np.int64), row["owner"].astype(np.int64), row["value"])
        tile.other, tile.twins = row["other"], bool((row["code"][1:] == row["code"][:-1]).any())
        tile.numbers = row["numbers"].reshape(len(tile.id), -1)
        tile.voted, tile.voter = row["voted"], np.repeat(np.arange(len(tile.id)), row["votes"])
        tile.buckets, tile.lacker, tile.lack = row["buckets"], np.repeat(np.arange(len(tile.id)), row["gaps"]), row["lack"]
        return tile

    def judged(self, users: _Tile) -> tuple[np.ndarray, np.ndarray]:
        """Places of the stories that ``users`` have judged, and of who has."""
        order = np.argsort(self.id, kind="stable")
        at = order[np.minimum(np.searchsorted(self.id, users.voted, sorter=order), len(order) - 1)]
        hit = self.id[at] == users.voted
        return at[hit], users.voter[hit]


def _spans(first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers from each ``first`` on, ``lengths`` of them, one after another."""
    return np.arange(int(lengths.sum())) + np.repeat(first - np.cumsum(lengths) + lengths, lengths)


def _common(stories: _Tile, users: _Tile) -> tuple[np.ndarray, np.ndarray]:
    """The names that both sides have: their places on either. Where tiles know a second number, both numbers must agree."""
    if stories.twins or users.twins:
        places = {x: i for i, x in enumerate(zip(users.names.tolist(), users.other.tolist(), strict=True))}
        at = np.array([places.get(x, -1) for x in zip(stories.names.tolist(), stories.other.tolist(), strict=True)])
        left = np.flatnonzero(at >= 0)
        return left, at[left]
    at = np.minimum(np.searchsorted(users.names, stories.names), len(users.names) - 1)
    same = users.names[at] == stories.names
    if stories.other is not None:
        same &= users.other[at] == stories.other
    left = np.flatnonzero(same)
    return left, at[left]


def _sums(stories: _Tile, users: _Tile) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of two tiles: sums of value * weight and of known content values (stories by users), and of all content values. What
    many stories share with many users is multiplied as matrices, the rest match by match."""
    many, wide = len(stories.id), len(users.id)
    z, known = np.zeros((many, wide)), np.zeros((many, wide))
    if not len(stories.names) or not len(users.names):
        return z, known, stories.mass
    left, right = _common(stories, users)
    n_stories, n_users = stories.times[left], users.times[right]
    common = n_stories * n_users > many * wide // 64
    heavy = np.flatnonzero(common)
    for low in range(0, len(heavy), WIDE):
        some = heavy[low : low + WIDE]
        of, with_ = _spans(stories.first[left[some]], n_stories[some]), _spans(users.first[right[some]], n_users[some])
        column, row = np.repeat(np.arange(len(some)), n_stories[some]), np.repeat(np.arange(len(some)), n_users[some])
        x, w, seen = np.zeros((many, len(some))), np.zeros((len(some), wide)), np.zeros((len(some), wide))
        np.add.at(x, (stories.owner[of], column), stories.value[of])
        w[row, users.owner[with_]], seen[row, users.owner[with_]] = users.value[with_], 1.0
        z += x @ w
        known += (x * (stories.names[left[some]] & 1)) @ seen
    # a match at a time: each entry of a story with every user that knows its code, in bounded pieces
    rest = np.flatnonzero(~common)
    entry, back = _spans(stories.first[left[rest]], n_stories[rest]), np.repeat(rest, n_stories[rest])
    total = np.cumsum(n_users[back])
    for part in np.split(np.arange(len(entry)), np.searchsorted(total, np.arange(4_000_000, int(total[-1]) if len(total) else 0, 4_000_000))):
        times = n_users[back[part]]
        own, with_ = np.repeat(entry[part], times), _spans(users.first[right[back[part]]], times)
        cell = stories.owner[own] * wide + users.owner[with_]
        z += np.bincount(cell, weights=stories.value[own] * users.value[with_], minlength=many * wide).reshape(many, wide)
        known += np.bincount(cell, weights=stories.content[own], minlength=many * wide).reshape(many, wide)
    return z, known, stories.mass


def _met(batches: Iterator[pa.RecordBatch], lacking: bool = False) -> Iterator[tuple[_Tile, _Tile, np.ndarray, np.ndarray]]:
    """Stories, users, scores and confidences of each pair of tiles; the users of consecutive pairs are one object where
    they are the same. With ``lacking`` only pairs where some user lacks something of the stories' buckets."""
    users = None
    for batch in batches:
        for i in range(len(batch)):
            row = lambda side: {c: batch.column(f"{side}_{c}")[i].values.to_numpy(zero_copy_only=False) for c in _FIELDS}  # noqa: B023, E731
            if users is None or not np.array_equal(users.id, batch.column("u_id")[i].values.to_numpy(zero_copy_only=False)):
                users = _Tile.of(row("u"))
            stories = _Tile.of(row("s"))
            if lacking and not np.isin(users.buckets, _buckets(stories.id)).any():
                continue
            yield stories, users, *_evidence(*_sums(stories, users), *(users.numbers[:, k].astype(float) for k in (1, 2, 3)))


def _made(columns: tuple, schema: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[c.split()[0] for c in schema.split(", ")])


def _all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pairs of tiles what the users have not judged."""
    for stories, users, score, confidence in _met(batches):
        rev, story = users.numbers[:, 0].astype(np.int32), stories.id
        want = np.ones(score.shape, dtype=bool)
        want[stories.judged(users)] = False
        columns = (np.repeat(users.id, len(story)), np.tile(story, len(users.id)), score.T.ravel(), confidence.T.ravel(), np.repeat(rev, len(story)))
        yield _made(columns if want.all() else tuple(c[want.T.ravel()] for c in columns), _SCORE)


def _buckets(ids: np.ndarray) -> np.ndarray:
    """Numbers of the ids' bitmaps, as Spark's bitmap functions number them."""
    return np.where(ids > 0, 1 + (ids - 1) // BITS, -(-ids // BITS))


def _missing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pairs of tiles what the users lack."""
    for stories, users, score, confidence in _met(batches, True):
        want, buckets = np.zeros(score.shape, dtype=bool), _buckets(stories.id)
        bits = np.where(stories.id > 0, (stories.id - 1) % BITS, -stories.id % BITS)
        for b in np.unique(buckets).tolist():
            here = np.flatnonzero(buckets == b)
            for k in np.flatnonzero(users.buckets == b).tolist():
                lack = np.frombuffer(users.lack[k], dtype=np.uint8)
                want[here, users.lacker[k]] = lack[bits[here] >> 3] >> (bits[here] & 7) & 1
        story, user = np.nonzero(want)
        columns = (users.id[user], stories.id[story], score[story, user], confidence[story, user], users.numbers[user, 0].astype(np.int32))
        yield _made(columns, _SCORE)


def _bins(bins: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of pairs of tiles how many stories that a user has not judged have a score in each bin; empty bins are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, None

        def out() -> pa.RecordBatch:
            user, bin_ = np.nonzero(held)
            return _made((now.id[user], bin_.astype(np.int32), held[user, bin_]), _BIN)

        for stories, users, score, _ in _met(batches):
            if users is not now:
                if now is not None:
                    yield out()
                now, held = users, np.zeros((len(users.id), bins), dtype=np.int64)
            cell = np.minimum(np.floor(score * bins), bins - 1).astype(np.int64) + np.arange(score.shape[1]) * bins
            want = np.ones(score.shape, dtype=bool)
            want[stories.judged(users)] = False
            held += np.bincount(cell[want], minlength=held.size).reshape(held.shape)
        if now is not None:
            yield out()

    return run


def _best(k: int, low: float = 0.0, high: float = 2.0, hybrid: bool = False) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of a task's stories with a score from ``low`` to below ``high`` the first ``k`` of every user by score, comments and
    id, or by ``hybrid``'s mix of score and comments and id; ``scoped`` sums to the number of such stories that the user
    has not judged."""

    def head(rows: list[np.ndarray]) -> list[np.ndarray]:
        order = np.lexsort((-rows[1], 0 * rows[4] if hybrid else -rows[4], -rows[5], rows[0]))
        user = rows[0][order]
        first = np.flatnonzero(np.diff(user, prepend=-1))
        place = np.arange(len(user)) - np.repeat(first, np.diff(np.append(first, len(user))))
        return [c[order[place < k]] for c in rows]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, scoped, now = None, None, None

        def out() -> pa.RecordBatch:
            user = held[0]
            alone = np.where(np.diff(user, prepend=-1) != 0, scoped[user], 0)
            return _made((now.id[user], held[1], held[2], held[3], now.numbers[user, 0].astype(np.int32), alone), _BEST)

        for stories, users, score, confidence in _met(batches):
            if users is not now:
                if held is not None:
                    yield out()
                held, scoped, now = None, np.zeros(score.shape[1], dtype=np.int64), users
            comments, key = stories.numbers[:, 0], score
            if hybrid:
                some, most = np.log1p(comments), np.log1p(users.numbers[:, 4])
                key = _rounded(0.7 * score + 0.3 * some[:, None] / most[None, :], 9)
            seen = np.where((score >= low) & (score < high), key, -1.0)
            seen[stories.judged(users)] = -1.0
            scoped = scoped + (seen >= 0).sum(axis=0)
            last = np.partition(seen, max(len(seen) - k, 0), axis=0)[max(len(seen) - k, 0)]
            story, user = np.nonzero((seen >= last) & (seen >= 0))
            new = [user, stories.id[story], score[story, user], confidence[story, user], comments[story], key[story, user]]
            held = head(new if held is None else [np.concatenate(x) for x in zip(held, new, strict=True)])
        if held is not None:
            yield out()

    return run


def _decks(k: int, cursor: int, sure: float, near: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of a task's unjudged stories what can stand at the head of a deck's orders: by the draw's key the first ``k`` of
    those surer than ``sure`` and within ``near`` of one half and of those less sure, and the ``k`` nearest one half."""
    far = np.inf

    def heads(rows: list[np.ndarray]) -> list[np.ndarray]:
        """Rows (user, ..., and the three orders) at the head of one order of their user, with all that equal its last."""
        want = np.zeros(len(rows[0]), dtype=bool)
        for order in rows[-3:]:
            by = np.lexsort((order, rows[0]))
            user, sorted_ = rows[0][by], order[by]
            first = np.flatnonzero(np.diff(user, prepend=-1))
            many = np.diff(np.append(first, len(user)))
            last = np.repeat(sorted_[first + np.minimum(many, k) - 1], many)
            want[by] |= (sorted_ <= last + 2e-9) & (sorted_ < far)
        return [c[want] for c in rows]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, None

        def out() -> pa.RecordBatch:
            user = held[0]
            return _made((now.id[user], held[1], held[2], held[3], now.numbers[user, 0].astype(np.int32)), _SCORE)

        for stories, users, score, confidence in _met(batches):
            if users is not now:
                if now is not None:
                    yield out()
                now, held = users, None
            owner, rev, story = users.id, users.numbers[:, 0], stories.id
            # ``decks.sampling_key``
            seed = (owner * 374761393 + rev * 668265263 + cursor * 2246822519) % 4294967296
            x = (story[:, None] * 2654435761 + seed[None, :]) % 4294967296
            key = (x * ((x % 65536) * 2 + 1) % 4294967296).astype(float)
            left = np.ones(score.shape, dtype=bool)
            left[stories.judged(users)] = False
            off = np.abs((score - 0.5) / (0.3 + 0.7 * confidence))
            # a little more than ``near``, and the last of a head with all that equal it: the decks judge rounded numbers
            boundary = np.where(left & (confidence >= sure) & (off <= near + 2e-9), key, far)
            novel = np.where(left & (confidence < sure), key, far)
            fill = np.where(left, off, far)
            want = np.zeros(score.shape, dtype=bool)
            for order in (boundary, novel, fill):
                last = np.partition(order, min(k, len(order)) - 1, axis=0)[min(k, len(order)) - 1]
                want |= (order <= last + 2e-9) & (order < far)
            at, user = np.nonzero(want)
            new = [user, story[at], *(c[at, user] for c in (score, confidence, boundary, novel, fill))]
            held = new if held is None else heads([np.concatenate(c) for c in zip(held, new, strict=True)])
        if now is not None:
            yield out()

    return run


def _code(name: Column, seed: int = 0) -> Column:
    """A number for a feature's name, odd for content."""
    return F.xxhash64(name, F.lit(seed)).bitwiseAND(-2).bitwiseOR(is_content(name).cast("long"))


def _seed(names: DataFrame) -> int:
    """The first seed under which each name (``feature``) has a number of its own: names that fall on one number are looked
    for by another hash of 64 bits."""
    for seed in range(64):
        other = F.xxhash64(F.lit("other"), "feature")
        clash = names.groupBy(_code(F.col("feature"), seed).alias("code")).agg(F.min(other).alias("a"), F.max(other).alias("z")).where("a <> z")
        if clash.isEmpty():
            return seed
    raise ValueError("no seed gives every feature a number of its own")


def _names(rows: DataFrame) -> DataFrame:
    return rows.select(F.explode("names").alias("feature"))


def _row(kind: int, id_: str, **columns: Column) -> list[Column]:
    types = {"codes": "array<long>", "values": "array<double>", "numbers": "array<long>", "voted": "array<long>", "lack": "binary"}
    rest = [columns.get(name, F.lit(None)).cast(kind_).alias(name) for name, kind_ in types.items()]
    return [F.lit(kind).alias("kind"), F.col(id_).cast("long").alias("id"), *rest]


def _lists(value: str) -> Column:
    return F.collect_list(F.struct("feature", F.col(value).cast("double").alias("value"))).alias("entries")


def _flat() -> list[Column]:
    """Plain lists travel in half the room of one list of pairs. The numbers are those of the first seed."""
    codes = F.transform("entries.feature", lambda name: _code(name)).alias("codes")
    return [F.col("entries.feature").alias("names"), F.col("entries.value").alias("values"), codes]


def _user_rows(weights: DataFrame, runs: DataFrame, votes: DataFrame | None = None) -> DataFrame:
    """(user_id, numbers, entries, voted) of users with a model, a row each. ``votes`` go with their users."""
    numbers = [c for c in ("rev", "n_votes", "n_pos", "n_neg", "top") if c in runs.columns]
    users = runs.select("user_id", F.array(*(F.col(c).cast("long") for c in numbers)).alias("numbers"))
    # weights that are dealt by user already are packed where they are
    users = users.join(weights.groupBy("user_id").agg(_lists("weight")), "user_id", "left")
    users = users.withColumn("entries", F.coalesce("entries", F.array().cast("array<struct<feature:string,value:double>>")))
    if votes is None:
        return users.withColumn("voted", F.lit(None).cast("array<long>"))
    return users.join(votes.groupBy("user_id").agg(F.collect_set(F.col("story_id").cast("long")).alias("voted")), "user_id", "left")


def _packed(features: DataFrame, weights: DataFrame, runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stories and users, written once, a row each: features' numbers and values in lists, so that what blocks repeat is
    small."""
    users = written([_user_rows(weights, runs).select("user_id", *_flat(), "numbers")], "users")
    stories = features.groupBy("story_id").agg(_lists("value")).select("story_id", *_flat(), F.array(F.lit(0)).alias("numbers"))
    stories = written([stories], "packed")
    if seed := _seed(_names(stories).unionByName(_names(users))):
        stories, users = (df.withColumn("codes", F.transform("names", lambda name: _code(name, seed))) for df in (stories, users))
    columns = {c: F.col(c) for c in ("codes", "values", "numbers")}
    return stories.select(*_row(0, "story_id", **columns)), users.select(*_row(1, "user_id", **columns))


def _cut(stories: DataFrame, users: DataFrame) -> tuple[int, int]:
    """Stories and users of a block: tiles, doubled on the side that saves more until blocks are few, or a side of a block
    would have more than ENTRIES."""
    rows, sizes, spans = {}, [STORIES, USERS], [[], []]
    for side, df in enumerate((stories, users)):
        rows[side] = df.agg(F.coalesce(F.sum(F.size("codes")), F.lit(0))).first()[0] + 1
        spans[side] = {r[0] for r in df.select(F.floor((F.col("id") - 1) / sizes[side])).distinct().collect()}
    while len(spans[0]) * len(spans[1]) > BLOCKS:
        able = [k for k in (0, 1) if len(spans[k]) > 1 and 2 * rows[k] / len(spans[k]) <= ENTRIES]
        if not able:
            break
        # doubling a side halves what the other side's rows repeat
        side = max(able, key=lambda k: rows[1 - k] * len(spans[k]))
        sizes[side] *= 2
        spans[side] = {x // 2 for x in spans[side]}
    return sizes[0], sizes[1]


def _tiling(side: str, most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (id, codes, others, values, numbers, voted, buckets, lacks) to tiles of at most ``most`` rows and about TILE
    entries."""

    def tile(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts)
        lists = {c: table[c].combine_chunks() for c in ("codes", "others", "values", "numbers", "voted", "buckets", "lacks")}
        lengths, votes, gaps = (pc.list_value_length(lists[c]).to_numpy(zero_copy_only=False) for c in ("codes", "voted", "buckets"))
        lack = lists.pop("lacks").flatten()
        code, other, value, numbers, voted, buckets = (x.flatten().to_numpy() for x in lists.values())
        order = np.argsort(code, kind="stable")
        if ((code[order][1:] == code[order][:-1]) & (other[order][1:] != other[order][:-1])).any():
            order = np.lexsort((other, code))
        code, other = code[order], other[order]
        first = np.flatnonzero(np.concatenate(([True], (code[1:] != code[:-1]) | (other[1:] != other[:-1])))) if len(code) else np.zeros(0, dtype=np.int64)
        owner = np.repeat(np.arange(len(lengths)), lengths)[order].astype(np.int16)
        times = np.diff(np.append(first, len(code))).astype(np.int32)
        columns = (table["id"].to_numpy(), numbers, code[first], other[first], times, owner, value[order], voted, votes.astype(np.int32), buckets, gaps.astype(np.int32), lack)
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), pa.array(c)) for c in columns], names=[f"{side}_{c}" for c in _FIELDS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, size = [], 0, 0
        for batch in batches:
            low = 0
            for i, n in enumerate(pc.list_value_length(batch.column("codes")).to_pylist()):
                if rows and (rows == most or size + n > TILE):
                    yield tile([*held, batch.slice(low, i - low)])
                    held, rows, size, low = [], 0, 0, i
                rows, size = rows + 1, size + n
            held.append(batch.slice(low))
        if rows:
            yield tile(held)

    return run


def _tiled(rows: DataFrame, side: str, most: int, slices: int = 1) -> DataFrame:
    """``rows`` (id, entries, numbers, voted, lacking) as tiles, a row each, written once, in ``slices`` by id one after another:
    what shuffles to make a slice is gone before the next."""
    names = F.col("entries.feature")
    codes = F.transform(names, lambda name: _code(name)).alias("codes")
    others = F.transform(names, lambda name: F.hash(F.lit("other"), name)).alias("others")
    voted = F.coalesce("voted", F.array().cast("array<long>")).alias("voted")
    buckets, lacks = (F.coalesce(f"lacking.{c}", F.array().cast(f"array<{kind}>")).alias(name) for c, kind, name in (("bucket", "long", "buckets"), ("lack", "binary", "lacks")))
    flat = rows.select(F.col("id").cast("long").alias("id"), codes, others, F.col("entries.value").alias("values"), "numbers", voted, buckets, lacks)
    own = F.pmod(F.xxhash64("id"), F.lit(slices))
    some = [flat.where(own == i) if slices > 1 else flat for i in range(slices)]
    schema = ", ".join(f"{side}_{c} array<{kind}>" for c, kind in _FIELDS.items())
    return written([x.mapInArrow(_tiling(side, most), schema) for x in some], f"tiles-{side}")


def _no_gaps() -> Column:
    return F.lit(None).cast("array<struct<bucket: long, lack: binary>>").alias("lacking")


def _story_tiles(features: DataFrame, scope: DataFrame | None = None) -> DataFrame:
    """``scope`` (story_id, num_comments) picks stories."""
    parts = max(1, -(-features.count() // TILE))
    stories = features.groupBy("story_id").agg(_lists("value"))
    stories = stories.withColumn("c", F.lit(0)) if scope is None else stories.join(scope.select("story_id", F.col("num_comments").alias("c")), "story_id")
    none = (F.lit(None).cast("array<long>").alias("voted"), _no_gaps())
    # few partitions, so that most tiles are full
    return _tiled(stories.coalesce(parts).select(F.col("story_id").alias("id"), "entries", F.array(F.col("c").cast("long")).alias("numbers"), *none), "s", STORIES)


def pack_users(weights: DataFrame, runs: DataFrame, votes: DataFrame | None = None, gaps: DataFrame | None = None) -> DataFrame:
    """Users with a model in tiles, written once. ``votes`` and ``gaps`` (user_id, bucket, lack) go with their users."""
    slices = -(-(runs.agg(F.sum("n_votes")).first()[0] or 1) // EXAMPLES)
    rows = _user_rows(weights, runs, votes)
    if gaps is not None:
        rows = rows.join(gaps.groupBy("user_id").agg(F.collect_list(F.struct("bucket", "lack")).alias("lacking")), "user_id", "left")
    return _tiled(rows.select(F.col("user_id").alias("id"), "entries", "numbers", "voted", _no_gaps() if gaps is None else "lacking"), "u", USERS, slices)


def _over_pairs(stories: DataFrame, users: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Each tile of users beside each of stories, partition by partition of the stored tiles: nothing is shuffled or
    written, whatever the grid's size, and a task has the stories of one partition in memory."""
    return users.crossJoin(stories.hint("shuffle_replicate_nl")).mapInArrow(run, schema)


def rescore_all(features: DataFrame, weights: DataFrame, runs: DataFrame, votes: DataFrame | None = None) -> DataFrame:
    """Every item for every user with a model: (user_id, story_id, score, confidence, model_rev). The grid is the result,
    and neither it nor what makes it is shuffled. ``votes`` (user_id, story_id) go with their users, and what they name is
    left out."""
    return _over_pairs(_story_tiles(features), pack_users(weights, runs, votes), _all, _SCORE)


def binned_scores(features: DataFrame, weights: DataFrame, runs: DataFrame, votes: DataFrame, bins: int) -> DataFrame:
    """(user_id, bin, n): how many unjudged items of each user have a score in each of ``bins`` equal bins, in parts that sum
    to it. Scores are counted in the task that makes them."""
    return _over_pairs(_story_tiles(features), pack_users(weights, runs, votes), _bins(bins), _BIN)


def score_grid(features: DataFrame, users: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``rescore_all`` for users that ``pack_users`` has packed, and the users and the items of the grid."""
    stories = _story_tiles(features)
    return _over_pairs(stories, users, _all, _SCORE), users.select(F.explode("u_id").alias("id")), stories.select(F.explode("s_id").alias("id"))


def best_scored(scope: DataFrame, features: DataFrame, weights: DataFrame, runs: DataFrame, votes: DataFrame, k: int, low: float = 0.0, high: float = 2.0, hybrid: bool = False) -> DataFrame:
    """The head of every user's ranking straight from features and weights: of ``scope`` (story_id, num_comments) what the
    user has not judged in ``votes`` (user_id, story_id), ``k`` rows a user and task, as (user_id,
    story_id, score, confidence, model_rev, scoped). The grid of scores is made tile by tile, cut to its heads in the
    same task, and never written, sorted or shuffled. ``scoped`` sums to the size of the user's whole ranking. Scores are
    from ``low`` to below ``high``; ``hybrid`` mixes comments into the order, and ``runs`` has ``top`` then."""
    return _over_pairs(_story_tiles(features, scope), pack_users(weights, runs, votes), _best(k, low, high, hybrid), _BEST)


def deck_scores(features: DataFrame, weights: DataFrame, runs: DataFrame, votes: DataFrame, k: int, cursor: int, sure: float, near: float) -> DataFrame:
    """What decks of up to ``k`` cards a stratum can take: (user_id, story_id, score, confidence, model_rev) of the unjudged
    items at the head of each scored stratum's order, and some more. The grid is cut in the tasks that score it."""
    return _over_pairs(_story_tiles(features), pack_users(weights, runs, votes), _decks(k, cursor, sure, near), _SCORE)


_GAPS = "user_id long, bucket long, lack binary"


def _holes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(user, bucket, items' bitmap, bitmap of what is scored or null) to the bitmap of the items that are not."""
    for batch in batches:
        out: list[list] = [[], [], []]
        for user, bucket, want, have in zip(*batch.columns, strict=True):
            wanted = np.frombuffer(want.as_buffer(), dtype=np.uint8)
            lack = wanted if not have.is_valid else wanted & ~np.frombuffer(have.as_buffer(), dtype=np.uint8)
            if lack.any():
                for column, v in zip(out, (user.as_py(), bucket.as_py(), lack.tobytes()), strict=True):
                    column.append(v)
        kinds = (pa.int64(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["user_id", "bucket", "lack"])


def coverage_gaps(items: DataFrame, scores: DataFrame, runs: DataFrame) -> DataFrame:
    """What is not scored under the current revisions: (user_id, bucket, lack), a row for each user and bucket of BITS
    story ids that lacks something, with the bitmap of what it lacks. Scores are folded to a bitmap a user and bucket
    before anything is shuffled, and items to one a bucket; pairs are never made."""
    bucket, place = F.bitmap_bucket_number("story_id"), F.bitmap_construct_agg(F.bitmap_bit_position("story_id"))
    fresh = runs.select("user_id", F.col("rev").cast("long").alias("model_rev"))
    current = scores.select("user_id", "story_id", F.col("model_rev").cast("long").alias("model_rev")).join(fresh, ["user_id", "model_rev"], "left_semi")
    have = current.groupBy("user_id", bucket.alias("bucket")).agg(place.alias("have"))
    want = items.groupBy(bucket.alias("bucket")).agg(place.alias("want"))
    every = runs.select("user_id").crossJoin(want.select("bucket"))  # users by buckets of BITS items
    both = every.join(have, ["user_id", "bucket"], "left").join(want, "bucket").select("user_id", "bucket", "want", "have")
    return both.mapInArrow(_holes, _GAPS)


def score_missing(items: DataFrame, features: DataFrame, scores: DataFrame, weights: DataFrame, runs: DataFrame) -> DataFrame:
    """Scores for user-item pairs that have none under the user's current revision; users without a model are skipped.
    Bitmaps tell what is missing, and go with their users: where a pair of tiles lacks nothing, nothing is scored, and only
    what it lacks leaves its task."""
    spark = items.sparkSession
    path = scratch(spark, "gaps")
    coverage_gaps(items, scores, runs).write.parquet(path)
    gaps = spark.read.schema(_GAPS).parquet(path)
    if gaps.isEmpty():
        return scores.select("user_id", "story_id", "score", "confidence", F.col("model_rev").cast("int").alias("model_rev")).limit(0)
    known = features.join(items.select("story_id"), "story_id", "left_semi")
    lacking = runs.join(gaps.select("user_id").distinct(), "user_id", "left_semi")
    return _over_pairs(_story_tiles(known), pack_users(weights, lacking, gaps=gaps), _missing, _SCORE)


def contributions(pairs: DataFrame, features: DataFrame, weights: DataFrame, k: int = 10) -> DataFrame:
    """What moved a score: per pair the ``k`` largest non-zero effects: (user_id, story_id, rank, feature, kind, label,
    effect, support)."""
    from palate.operators.features import with_entries

    def run(items: pa.Table, own: pa.Table) -> pa.Table:
        lists = items["entries"].combine_chunks()
        feature, value, pos = lists.flatten().flatten() if len(lists) else (pa.array([], pa.string()), pa.array([], pa.float64()), pa.array([], pa.int64()))
        row = np.repeat(np.arange(len(items)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        at = pc.fill_null(pc.index_in(feature, value_set=own["feature"].combine_chunks()), -1).to_numpy(zero_copy_only=False)
        weight, support = np.append(own["weight"].to_numpy(), 0.0)[at], np.append(own["support"].to_numpy(), 0)[at]
        value, pos = value.to_numpy(), pos.to_numpy()
        size = np.abs(_rounded(value * weight, 9))
        order = np.lexsort((pos, -size, row))
        order = order[size[order] > 0]
        first = np.flatnonzero(np.diff(row[order], prepend=-1))
        rank = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order)))) + 1
        order, rank = order[rank <= k], rank[rank <= k]
        ids = items.select(["user_id", "story_id"]).take(pa.array(row[order]))
        names = ("rank", "feature", "value", "weight", "support")
        more = (pa.array(rank, pa.int32()), feature.take(pa.array(order)), *(pa.array(c[order]) for c in (value, weight, support)))
        return pa.table([*ids.columns, *more], names=["user_id", "story_id", *names])

    some = features.where("feature <> '__bias__'").select("story_id", "feature", F.col("value").cast("double").alias("value"), F.col("pos").cast("long").alias("pos"))
    rows = with_entries(pairs.select("user_id", "story_id"), some, "value", "pos")
    own = weights.select("user_id", "feature", F.col("weight").cast("double").alias("weight"), F.col("support").cast("long").alias("support"))
    both = rows.groupBy("user_id").cogroup(own.groupBy("user_id"))
    out = both.applyInArrow(run, "user_id long, story_id long, rank int, feature string, value double, weight double, support long")
    d = describe_feature(F.col("feature"))
    effect = F.round(F.col("value") * F.col("weight"), 9).alias("effect")
    return out.select("user_id", "story_id", "rank", "feature", d["kind"].alias("kind"), d["label"].alias("label"), effect, "support")
