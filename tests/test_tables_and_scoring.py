"""Merge tables, coverage bitmaps, pooled training and AUC, seeked orders, as-of scores, exact folding."""

import math
import os
import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from palate.functions import text
from palate.operators import decks, model, pooled, ranking, score, votes
from palate.operators.features import SECTION, featurize
from palate.sources import ingest
from palate.sources.merge_table import MergeTable, newest

SCORES = "user_id long, story_id long, score double, confidence double, model_rev int"


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def scores(spark, made):
    return spark.createDataFrame([(u, s, x, 0.5, rev) for u, s, x, rev in made], SCORES)


def test_writing_scores_keeps_all_others(spark, tmp_path):
    """One row of a user leaves the user's other rows and the users beside it as they are; a write that comes again, even
    after a newer one, changes nothing; rows of one write that repeat a pair count once."""
    at = str(tmp_path / "scores")
    assert ingest.read_scores(spark, at) is None
    assert ingest.write_scores(scores(spark, [(1, 1, 0.1, 1), (1, 2, 0.2, 1), (65, 1, 0.3, 1)]), at, "job", 0)
    one = scores(spark, [(1, 2, 0.9, 2), (1, 2, 0.8, 1)])
    assert ingest.write_scores(one, at, "job", 1)
    want = [(1, 1, 0.1, 1), (1, 2, 0.9, 2), (65, 1, 0.3, 1)]
    keep = ("user_id", "story_id", "score", "model_rev")
    assert rows(ingest.read_scores(spark, at), *keep) == want
    assert ingest.write_scores(scores(spark, [(1, 2, 0.7, 1)]), at, "other", 0)
    assert not ingest.write_scores(one, at, "job", 1) and not ingest.write_scores(one, at, "job", 0)
    assert rows(ingest.read_scores(spark, at), *keep) == [(1, 1, 0.1, 1), (1, 2, 0.7, 1), (65, 1, 0.3, 1)]


def test_merge_table_against_a_dictionary(spark, tmp_path):
    """Random overlapping writes; what a write adds to disk follows the write, and runs stay few."""
    r, held, table = random.Random(3), {}, MergeTable(spark, str(tmp_path / "t"), ["user_id", "story_id"], newest(["user_id", "story_id"], "model_rev"))
    base = [(u, s, round(r.random(), 3), 1) for u in range(40) for s in range(400)]
    table.write(scores(spark, base))
    held |= {(u, s): (x, v) for u, s, x, v in base}
    whole = table.runs()[0].size
    for number in range(12):
        made = {(r.randrange(40), r.randrange(400)): (round(r.random(), 3), 2 + number) for _ in range(5)}
        table.write(scores(spark, [(*k, *v) for k, v in made.items()]), "s", number)
        held |= made
        assert len(table.runs()) <= 5 and table.runs()[0].size == whole
    assert sum(x.size for x in table.runs()[1:]) < whole / 4
    assert {(x.user_id, x.story_id): (x.score, x.model_rev) for x in table.read().collect()} == held
    some = spark.createDataFrame([k for k in list(held)[:3]], "user_id long, story_id long")
    assert len(table.read(only=some).collect()) == 3
    # a run without its marker does not count
    runs = table.runs()
    os.remove(os.path.join(runs[-1].path.removeprefix("file:"), "_committed"))
    assert len(table.runs()) >= len(runs) - 1 and all(x.last != runs[-1].last or x.first != runs[-1].first for x in table.runs())


def model_of(spark):
    titles = ["rust memory", "go memory", "apple phone", "", "rust phone 2024?"]
    items = spark.createDataFrame([(i, t, None, None, "a") for i, t in zip((1, 2, 40_000, 70_001, 5), titles, strict=True)], "story_id long, title string, url string, domain string, author string")
    w = spark.createDataFrame([(u, f, x) for u in (1, 2, 700) for f, x in (("__bias__", 0.1 * u % 1), ("w:rust", 1.0), ("w:phone", -0.5))], "user_id long, feature string, weight double")
    runs = spark.createDataFrame([(u, 3, 40, 20, 20) for u in (1, 2, 700)], "user_id long, rev int, n_votes long, n_pos long, n_neg long")
    return items, featurize(items), w, runs


def test_missing_scores_by_bitmaps(spark):
    """Nothing, everything, stale revisions, holes in several buckets, scores of items that are gone."""
    items, f, w, runs = model_of(spark)
    full = score.rescore_all(f, w, runs).collect()
    every = {(r.user_id, r.story_id): r.score for r in full}
    lack = lambda have: {(r.user_id, r.story_id): r.score for r in score.score_missing(items, f, have, w, runs).collect()}
    have = scores(spark, [(u, s, 0.5, 3) for u, s in every])
    assert lack(have.limit(0)) == every and lack(have) == {}
    holes = {(1, 5), (2, 40_000), (2, 70_001), (700, 1), (700, 2), (700, 5)}
    assert lack(have.where("not ((user_id = 1 and story_id = 5) or (user_id = 2 and story_id > 5) or (user_id = 700 and story_id < 6))")) == {k: every[k] for k in holes}
    stale = have.withColumn("model_rev", F.when(F.col("user_id") == 2, 2).otherwise(F.col("model_rev")))
    assert lack(stale) == {k: v for k, v in every.items() if k[0] == 2}
    gone = have.where("story_id <> 5").unionByName(scores(spark, [(u, 77, 0.5, 3) for u in (1, 2, 700)]))
    assert lack(gone) == {k: v for k, v in every.items() if k[1] == 5}
    gaps = score.coverage_gaps(items, have, runs)
    assert gaps.count() == 0


def test_gaps_are_bitmaps(spark):
    """A bucket that lacks most of its ids is 4,096 bytes, not a list of them; ids under 1 count down."""
    items = spark.range(-40_000, 40_000).select(F.col("id").alias("story_id"))
    runs = spark.createDataFrame([(1, 3, 40, 20, 20)], "user_id long, rev int, n_votes long, n_pos long, n_neg long")
    have = scores(spark, [(1, s, 0.5, 3) for s in range(-40_000, 40_000, 1000)])
    got = score.coverage_gaps(items, have, runs).collect()
    assert [len(r.lack) for r in got] == [4096] * 4
    assert sum(bin(b).count("1") for r in got for b in r.lack) == 80_000 - 80
    f = spark.createDataFrame([(s, "__bias__", 1.0) for s in (-32_768, -1, 0, 1, 32_769)], "story_id long, feature string, value double")
    w = spark.createDataFrame([(1, "__bias__", 0.5)], "user_id long, feature string, weight double")
    out = score.score_missing(f.select("story_id"), f, scores(spark, [(1, 1, 0.5, 3), (1, -1, 0.5, 3)]), w, runs)
    assert [r.story_id for r in out.orderBy("story_id").collect()] == [-32_768, 0, 32_769]


def test_blocks_hold_a_row_an_item(spark, monkeypatch):
    """What blocks repeat is a row for each item and user, whatever features they have; sums of features that all share
    and of rare ones are those of plain Python, over several tiles of blocks that have been doubled."""
    monkeypatch.setattr(score, "STORIES", 8)
    monkeypatch.setattr(score, "USERS", 4)
    monkeypatch.setattr(score, "BLOCKS", 2)
    r = random.Random(5)
    names = ["__bias__", "t:len1", *(f"w:{i}" for i in range(200))]
    f = [(s, n, r.choice((0.3, 0.7, 1.0))) for s in range(1, 41) for n in [*names[:6], *r.sample(names[6:], 5)]]
    w = [(u, n, round(r.uniform(-1, 1), 6)) for u in range(1, 18) for n in [*names[:5], *r.sample(names[5:], 30)]]
    features = spark.createDataFrame(f, "story_id long, feature string, value double")
    weights = spark.createDataFrame(w, "user_id long, feature string, weight double")
    runs = spark.createDataFrame([(u, 2, 40, 20, 20) for u in range(1, 19)], "user_id long, rev int, n_votes long, n_pos long, n_neg long")
    stories, users = score._packed(features, weights, runs)
    assert (stories.count(), users.count()) == (40, 18)
    tall, wide = score._cut(stories, users)
    assert tall > 8 or wide > 4
    got = {(x.user_id, x.story_id): (x.score, x.confidence) for x in score.rescore_all(features, weights, runs).collect()}
    known = {(u, n): x for u, n, x in w}
    assert len(got) == 40 * 18
    for (u, s), (x, sure) in got.items():
        own = [(n, v) for at, n, v in f if at == s]
        z = sum(v * known.get((u, n), 0.0) for n, v in own)
        mass = sum(v for n, v in own if n[0] == "w")
        seen = sum(v for n, v in own if n[0] == "w" and (u, n) in known)
        confidence = 0.3 + 0.7 * (seen / mass)
        assert abs(sure - confidence) < 2e-9 and abs(x - (0.5 + (1 / (1 + math.exp(-z)) - 0.5) * (0.3 + 0.7 * confidence))) < 2e-9


def test_unjudged_items_are_counted(spark):
    """Votes that repeat, on items that are gone, and of users that are not asked for; who has judged all has no row."""
    users = spark.createDataFrame([(1,), (2,), (3,)], "user_id long")
    items = spark.createDataFrame([(1,), (2,)], "story_id long")
    v = spark.createDataFrame([(1, 1), (1, 1), (1, 9), (3, 1), (3, 2), (4, 1)], "user_id long, story_id long")
    assert rows(decks.unjudged_counts(users, items, v), "user_id", "n") == [(1, 1), (2, 2)]


def plain_objective(examples, w, l2):
    n, pos = len(examples), sum(y for y, _ in examples)
    total = 0.0
    for y, fs in examples:
        top = (n / (2 * pos) if y else n / (2 * (n - pos))) if 0 < pos < n else 1.0
        z = sum(w.get(f, 0.0) * v for f, v in fs.items())
        total += top * math.log1p(math.exp(-z if y else z)) + l2 / 2 * sum(w.get(f, 0.0) ** 2 for f in fs)
    return total


def plain_best(examples, l2):
    """Newton steps on the whole problem."""
    names = sorted({f for _, fs in examples for f in fs})
    x = np.array([[fs.get(f, 0.0) for f in names] for _, fs in examples])
    y = np.array([label for label, _ in examples])
    n, pos = len(y), y.sum()
    top = np.where(y == 1, n / (2 * pos), n / (2 * (n - pos)))
    d, w = l2 * (x != 0).sum(axis=0), np.zeros(len(names))
    for _ in range(100):
        p = 1 / (1 + np.exp(-x @ w))
        h = x.T @ (x * (top * p * (1 - p))[:, None]) + np.diag(d)
        w -= 0.5 * np.linalg.solve(h, x.T @ (top * (p - y)) + d * w)
    return dict(zip(names, w.tolist(), strict=True))


@pytest.mark.parametrize("entries", [10_000, 130])
def test_pooled_fit_against_a_plain_optimiser(spark, entries):
    """One block and several: the objective is within 1e-4 of the best, and the bias is a weight like any other."""
    r = random.Random(8)
    ex, fs = [], []
    for i in range(80):
        y = int(r.random() < 0.3)
        ex.append((i, y))
        fs += [(i, f, v) for f, v in {"__bias__": 1.0, **{f"w:{r.randrange(12) + 4 * y}": 0.7 for _ in range(4)}, "t:len": 0.3}.items()]
    e, f = spark.createDataFrame(ex, "story_id long, label int"), spark.createDataFrame(fs, "story_id long, feature string, value double")
    got = {x.feature: (x.weight, x.support) for x in pooled.fit(e, f, 2e-3, 1, 60, entries=entries).collect()}
    of = {i: {} for i, _ in ex}
    for i, name, v in fs:
        of[i][name] = v
    plain, l2 = [(y, of[i]) for i, y in ex], 2e-3 * 200 / 80
    best = plain_objective(plain, plain_best(plain, l2), l2)
    assert plain_objective(plain, {k: v for k, (v, _) in got.items()}, l2) <= best * (1 + 1e-4)
    assert got["__bias__"][1] == 80 and got["__bias__"][0] < 0
    assert set(got) == {name for _, name, _ in fs}
    assert model.fit_pooled(e.limit(0), f).count() == 0


def test_pooled_auc(spark):
    r = random.Random(1)
    made = [(int(r.random() < 0.4), round(r.random(), 1)) for _ in range(500)] + [(1, None)]
    df = spark.createDataFrame(made, "label int, score double").repartition(7)
    one = model.auc(df.where("score is not null").withColumn("g", F.lit(1)), ["g"]).first().auc
    assert [round(x.auc, 9) for x in model.auc(df, []).collect()] == [round(one, 9)]
    assert [x.auc for x in model.auc(df.where("label = 1"), []).collect()] == [None]
    assert [x.auc for x in model.auc(df.limit(0), []).collect()] == [None]


def test_numbers_and_permutations(spark):
    r = random.Random(2)
    values = r.sample(range(10_000), 700)
    df = spark.createDataFrame([(v,) for v in values], "x long").repartition(6)
    assert rows(ranking.numbered(df, "n", F.desc("x")), "n", "x") == list(enumerate(sorted(values, reverse=True)))
    for bits in (1, 5, 10):
        keys = (F.lit(9_000_000_000), F.lit(3), F.lit(4))
        drawn = [x.p for x in spark.range(1 << bits).select(ranking.permuted(keys, F.col("id"), bits).alias("p")).collect()]
        assert sorted(drawn) == list(range(1 << bits))
    other = [x.p for x in spark.range(1 << 10).select(ranking.permuted((F.lit(9_000_000_000), F.lit(3), F.lit(5)), F.col("id"), 10).alias("p")).collect()]
    assert sum(a == b for a, b in zip(drawn, other, strict=True)) < 20


def test_explore_goes_on_until_there_are_enough(spark):
    """A user who has judged nearly all items still gets what is left; nobody gets anything twice; no users and items are
    crossed in a plan."""
    items = spark.createDataFrame([(i, 20, i % 9, 100) for i in range(1, 301)], "story_id long, points long, num_comments long, created_at long")
    users = spark.createDataFrame([(1, 1), (2, 1), (3, 1)], "user_id long, rev int")
    cast = [(1, i, 1) for i in range(1, 296)] + [(2, 5, 0)] + [(3, i, 1) for i in range(1, 301)]
    v = spark.createDataFrame(cast, "user_id long, story_id long, value int")
    got = decks.stratum_explore(users, items, v, 12, 0, 10)
    assert rows(got.where("user_id = 1"), "story_id") == [(i,) for i in range(296, 301)]
    two = [x.story_id for x in got.where("user_id = 2").collect()]
    assert len(set(two)) == len(two) == 12 and 5 not in two and got.where("user_id = 3").count() == 0
    cold = decks.cold_queue(users, items, v, 4, 10)
    best = sorted(((i % 9, i) for i in range(1, 301) if i != 5), reverse=True)[:4]
    assert rows(cold.where("user_id = 2"), "pos", "story_id") == [(k + 1, i) for k, (_, i) in enumerate(best)]


def test_last_score_before_a_vote(spark):
    v = spark.createDataFrame([(1, 1, 1, 10), (1, 1, -1, 20), (1, 2, 1, 5), (2, 1, 0, 20)], "user_id long, story_id long, value int, updated_at long")
    h = spark.createDataFrame([(1, 1, 0.1, 0.5, 1, 10), (1, 1, 0.2, 0.5, 2, 10), (1, 1, None, 0.5, 3, 15), (1, 2, 0.4, 0.5, 1, 6)], "user_id long, story_id long, score double, confidence double, model_rev int, scored_at long")
    got = rows(votes.frozen_prediction(v, h), "user_id", "story_id", "updated_at", "value", "score", "model_rev")
    assert got == [(1, 1, 10, 1, 0.2, 2), (1, 1, 20, -1, None, 3), (1, 2, 5, 1, None, None), (2, 1, 20, 0, None, None)]


def test_folding_over_the_basic_plane(spark):
    codes = [c for c in range(1, 0x10000) if not 0xD800 <= c < 0xE000] + list(range(0x1D400, 0x1D800)) + [0x1F100, 0x2F800]
    df = spark.createDataFrame([(c, "x" + chr(c) + "y") for c in codes], "c int, t string")
    keep = set("abcdefghijklmnopqrstuvwxyz0123456789+#.&/- \t\n\x0b\f\r")
    for r in df.select("c", "t", text.fold_text(F.col("t")).alias("f"), F.lower("t").alias("l")).collect():
        plain = (x for x in unicodedata.normalize("NFKD", r.l) if not 0x300 <= ord(x) <= 0x36F and x not in "’‘'`")
        assert r.f == "".join(x if x in keep else " " for x in plain), hex(r.c)


def test_places_of_a_long_title(spark):
    words = " ".join(f"q{i}" for i in range(12_000))
    items = spark.createDataFrame([(1, words, None, None, None)], "story_id long, title string, url string, domain string, author string")
    f = featurize(items)
    assert f.count() == f.select("pos").distinct().count() and f.where(f"feature = 'w:q11999' and pos = {SECTION + 1_199_900}").count() == 1


def test_models_alone_equal_models_together():
    """Eight models step together, each alone in its own loop: the same weights."""
    r = np.random.default_rng(4)
    sizes, label, slot, value, of = [9, 30, 31, 12, 25, 18, 40, 22], [], [], [], []
    for m, n in enumerate(sizes):
        for k in range(n):
            label.append(float(k % 3 == 0))
            slot.append(np.unique(np.append(r.choice(50, 5, replace=False), 50)) + 51 * m)
            value.append(r.choice([0.5, 1.0, 0.7], 6))
            of.append(m)
    ends, label, of = np.cumsum([len(s) for s in slot]), np.array(label), np.array(of)
    flat, values = np.concatenate(slot), np.concatenate(value)
    together = model._train(of, label, ends, flat, values, model.FitOptions())
    for m in range(len(sizes)):
        own = np.flatnonzero(of == m)
        s, v = np.concatenate([slot[i] for i in own]), np.concatenate([value[i] for i in own])
        names, short = np.unique(s, return_inverse=True)
        alone = model._train_one(label[own], np.arange(1, len(own) + 1) * 6, short, v, model.FitOptions())
        assert np.abs(together[names] - alone).max() < 2e-6


def test_deals_out_of_order_expire_rightly(spark, tmp_path):
    """Deals that come late within the delay, over a restart: as if they had come in order."""
    from palate.streaming import jobs

    at, deals = str(tmp_path), "user_id long, seq long, dealt_at long"
    parts = ([(1, 2, 50_000), (2, 1, 1_000)], [(1, 1, 1_000), (2, 3, 200_000)], [(2, 2, 60_000), (3, 1, 260_000)], [(4, 1, 900_000)])
    for some in (parts[:2], parts[2:]):
        for part in some:
            spark.createDataFrame(part, deals).coalesce(1).write.mode("append").parquet(f"{at}/in")
        stream = spark.readStream.schema(deals).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
        out = jobs.stale_round_expiry(stream, "3 days").writeStream.outputMode("append").option("checkpointLocation", f"{at}/cp").format("parquet")
        out.trigger(availableNow=True).start(f"{at}/out").awaitTermination()
    got = rows(spark.read.parquet(f"{at}/out"), "user_id", "seq", "expired_at")
    assert got == [(1, 2, 136_400), (2, 2, 146_400), (2, 3, 286_400), (3, 1, 346_400)]


def test_held_out_scores_without_weights(spark):
    """Models applied in the task that trains them score as their weights do in a join, and an example is one row for all
    folds, but for users of many examples."""
    r = random.Random(11)
    items = [(s, " ".join(r.sample(["rust", "go", "apple", "phone", "kernel", "linux", "film", "song"], 4)), None, None, "a") for s in range(1, 41)]
    f = featurize(spark.createDataFrame(items, "story_id long, title string, url string, domain string, author string"))
    made = [(u, s, int(r.random() < 0.5), i) for u in (1, 2) for i, s in enumerate(r.sample(range(1, 41), 20))]
    folded = model.cv_folds(spark.createDataFrame([*made, (3, 1, 1, 0)], "user_id long, story_id long, label int, ord long"))
    o = model.FitOptions(epochs=5)
    one, two = model.cross_validate(folded, f, o)[1], model.cross_validate(folded, f, o, weights=model.fit_grouped(folded, f, o))[1]
    keep = ("user_id", "fold", "story_id", "label", "score", "confidence")
    assert rows(one, *keep) == rows(two, *keep) and one.count() == 40
    assert model.packed(f).count() == 40
    z = score.sums_by_user(folded.select("user_id", "story_id", "label"), f, spark.createDataFrame([(1, "by:a", 0.5), (1, "w:none", 9.0)], "user_id long, feature string, weight double"))
    assert {(x.user_id, round(x.z, 9)) for x in z.collect()} == {(1, 0.3)} and z.count() == 20


def test_arriving_parts_are_many_files(spark):
    """No task writes or reads a whole part of a stream, and every row of every part arrives."""
    from palate.plans.fixtures import Tables
    from palate.plans.queries import _arrive

    stream, path = _arrive(Tables(spark, ""), spark.range(1000), "id < 700", "id >= 700")
    assert stream.isStreaming and sorted(r.id for r in spark.read.parquet(f"{path}/in").collect()) == list(range(1000))
    assert len(spark.read.parquet(f"{path}/in").inputFiles()) == 2 * spark.sparkContext.defaultParallelism


def test_features_of_judged_items_travel_as_one_row(spark):
    """What is kept by user and feature is shuffled by user alone, an item's features in one row; users without weights
    have no contributions and know nothing, items without content features no signals."""
    features = spark.createDataFrame(
        [(1, "__bias__", 1.0, 0), (1, "w:a", 1.0, 1), (1, "w:b", 0.5, 2), (1, "t:x", 0.3, 3), (2, "__bias__", 1.0, 0), (2, "w:b", 1.0, 1)],
        "story_id long, feature string, value double, pos long",
    )
    examples = spark.createDataFrame([(1, 1, 1, 0), (1, 2, 0, 1), (2, 2, 1, 0)], "user_id long, story_id long, label int, ord int")
    seen = model.vocabulary(examples, features)
    assert rows(seen, "user_id", "feature", "support", "idx") == [
        (1, "__bias__", 2, 0), (1, "t:x", 1, 3), (1, "w:a", 1, 1), (1, "w:b", 2, 2), (2, "__bias__", 1, 0), (2, "w:b", 1, 1),
    ]
    weights = spark.createDataFrame([(1, "w:b", -0.5, 2, 0), (1, "w:a", 0.25, 1, 1), (3, "w:a", 1.0, 1, 0)], "user_id long, feature string, weight double, support long, idx int")
    moved = score.contributions(examples, features, weights)
    # equal effects stand in the order of places
    assert rows(moved, "user_id", "story_id", "rank", "feature", "effect", "support") == [
        (1, 1, 1, "w:a", 0.25, 1), (1, 1, 2, "w:b", -0.25, 2), (1, 2, 1, "w:b", -0.5, 2),
    ]
    fresh = votes.new_signals(examples, features, weights.where("feature = 'w:b'"))
    assert rows(fresh, "user_id", "story_id", "total", "labels") == [(1, 1, 1, "a"), (2, 2, 1, "b")]
    for made in (seen, moved, fresh):
        assert "feature#" not in "".join(x for x in made._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in x)


def test_decks_and_feeds_come_from_heads_of_blocks(spark):
    """The heads of blocks hold every row that a deck or a feed takes of the whole grid, and few others."""
    from palate.operators import feed

    n, users = 400, 3
    items = spark.range(1, n + 1).selectExpr(
        "id story_id", "concat('t', id) title", "cast(null as string) url", "cast(null as string) domain", "'a' author",
        "id % 90 points", "id * 7 % 50 num_comments", "id * 11 created_at", "'2024-01-01' day", "0L fetched_at",
    )
    features = items.selectExpr("story_id", "inline(array(struct('__bias__' feature, 1.0D value, 0L pos), struct(concat('w:', story_id % 37) feature, 1.0D value, 1L pos)))")
    weights = spark.range(users * 37).selectExpr("id % 3 + 1 user_id", "concat('w:', id div 3) feature", "(id * 13 % 29 - 14) / 10.0D weight", "2L support")
    weights = weights.where("feature not like '%5'")
    runs = spark.range(1, users + 1).selectExpr("id user_id", "2 rev", "40L n_votes", "20L n_pos", "20L n_neg", "0L trained_at")
    votes_ = spark.range(60).selectExpr("id % 3 + 1 user_id", "id * 5 + 1 story_id", "cast(id % 3 - 1 as int) value", "0L created_at", "0L updated_at")
    grid = score.rescore_all(features, weights, runs).localCheckpoint()
    cut = score.deck_scores(features, weights, runs, votes_, 24, 1, decks.CONFIDENT, decks.NEAR).localCheckpoint()
    assert cut.count() < grid.count() // 3
    card = ("user_id", "story_id", "reason", "pos")
    want = decks.training_queue(items, grid, votes_, runs, 6, 1, 0)
    assert rows(decks.training_queue(items, cut, votes_, runs, 6, 1, 0, unjudged_scores=True), *card) == rows(want, *card)
    place = ("user_id", "pos", "story_id", "total", "score")
    for o in (feed.FeedOptions(mode="hybrid", limit=9), feed.FeedOptions(mode="new", limit=9, offset=3), feed.FeedOptions(min_score=0.4, max_score=0.6, limit=9)):
        assert rows(feed.feed_from_models(items, features, weights, runs, votes_, o, 0), *place) == rows(feed.feed(items, grid, votes_, o, 0), *place)


def test_grids_are_never_folded(spark, tmp_path, monkeypatch):
    """Writes of all pairs of some users and items hold over what is older, merged or not, without a fold; plain writes before
    and after them stay what they were."""
    from palate.sources import merge_table

    monkeypatch.setattr(merge_table, "FAN", 3)
    keys, r, calls = ["user_id", "story_id"], random.Random(11), []
    fold = newest(keys, "model_rev")
    table = MergeTable(spark, str(tmp_path / "t"), keys, lambda rows: calls.append(1) or fold(rows))
    held, crowds = {}, ([1, 2, 3], [2, 4], [1, 2, 3])
    side = lambda ids, key: spark.createDataFrame([(i,) for i in ids], f"{key} long")
    for number in range(9):
        users, items = crowds[number % 3], r.sample(range(8), 3)
        new = [(u, i, number / 10, number) for u in users for i in items]
        assert table.write(scores(spark, new), "job", number, (side(users, "user_id"), side(items, "story_id")))
        assert not table.write(scores(spark, new), "job", number, (side(users, "user_id"), side(items, "story_id")))
        held |= {x[:2]: x[2] for x in new}
        if number in (4, 8):
            assert {(x.user_id, x.story_id): x.score for x in table.read().collect()} == held and table.read().count() == len(held)
    assert not calls and len(table.runs()) < 9
    plain = [(1, 1, 0.95, 1), (9, 9, 0.9, 1)]
    table.write(scores(spark, plain), "other", 0)
    held |= {x[:2]: x[2] for x in plain}
    assert calls and {(x.user_id, x.story_id): x.score for x in table.read().collect()} == held
    table.write(scores(spark, [(1, 1, 0.5, 1)]), "job", 9, (side([1], "user_id"), side([1], "story_id")))
    held[1, 1] = 0.5
    assert {(x.user_id, x.story_id): x.score for x in table.read().collect()} == held and table.read().count() == len(held)


def test_votes_are_dealt_by_number(spark, monkeypatch):
    """Partitions of folded and of imported votes follow their number; importing again converges."""
    from palate.sources import storage

    monkeypatch.setattr(storage, "ROWS", 10)
    events = spark.createDataFrame([(i % 7, i % 40 + 1, i % 3 - 1, 100 + i, i) for i in range(300)], "user_id long, story_id long, value int, ts long, event_id long")
    folded = votes.fold_votes(events)
    assert folded.rdd.getNumPartitions() >= 30 and folded.count() == 280
    lines = [(1, 2, 1, 50, 1), (1, 2, -1, 40, 2), (1, 2, 9, 60, 3), (99, 5, 0, 7, 4)]
    batch = spark.createDataFrame(lines, "user_id long, story_id long, value int, created_at long, seq long")
    got, bad = ingest.import_votes(folded, batch)
    again = ingest.import_votes(got, batch)[0]
    columns = ("user_id", "story_id", "value", "created_at", "updated_at")
    assert got.rdd.getNumPartitions() >= 28 and got.columns == list(columns)
    want = {r[:2]: r for r in rows(folded, *columns)} | {(1, 2): (1, 2, -1, 40, 40), (99, 5): (99, 5, 0, 7, 7)}
    assert rows(got, *columns) == sorted(want.values()) == rows(again, *columns)
    assert rows(bad, "seq") == [(3,)]


def test_blocks_are_few_and_bounded(spark, monkeypatch):
    """What blocks repeat is bounded by their number; a side of a block with many entries is not doubled. A name has the same
    number on both sides, wherever it stands in its list."""
    codes = F.array(F.lit(1).cast("long")).alias("codes")
    stories = spark.range(13).select((F.col("id") * score.STORIES + 1).alias("id"), codes)
    users = spark.range(36).select((F.col("id") * score.USERS + 1).alias("id"), codes)
    tall, wide = score._cut(stories, users)
    assert -(-13 * score.STORIES // tall) * -(-36 * score.USERS // wide) <= 64
    monkeypatch.setattr(score, "ENTRIES", 1)
    assert score._cut(stories, users) == (score.STORIES, score.USERS)
    f = spark.createDataFrame([(1, "w:a", 1.0), (1, "w:b", 1.0), (1, "w:c", 1.0)], "story_id long, feature string, value double")
    w = spark.createDataFrame([(1, "w:c", 0.5)], "user_id long, feature string, weight double")
    runs = spark.createDataFrame([(1, 2, 40, 20, 20)], "user_id long, rev int, n_votes long, n_pos long, n_neg long")
    left, right = (df.first().codes for df in score._packed(f, w, runs))
    assert len(set(left)) == 3 and set(right) < set(left)


def test_featurize_deals_by_size(spark, monkeypatch):
    """Partitions follow the letters of the titles; an item that stands twice still sums to one."""
    from palate.operators import features

    monkeypatch.setattr(features, "LETTERS", 20)
    items = [(i % 30, f"rust parser number {i % 30}", None, "x.org", "ann") for i in range(31)]
    out = featurize(spark.createDataFrame(items, "story_id long, title string, url string, domain string, author string"))
    assert out.rdd.getNumPartitions() >= 25
    got = {(r.story_id, r.feature): r.value for r in out.collect()}
    assert got[(0, "w:rust")] == 2.0 and got[(1, "w:rust")] == 1.0


def test_folding_makes_its_text_once(spark):
    """However dear the text is, it stands once in the plan; runs of ASCII beside other characters fold as they do alone."""
    df = spark.createDataFrame([("It's A–B “Café”\nx_y 𝒵1 foods",), (None,)], "t string")
    out = df.select(text.fold_text(F.regexp_replace("t", "foods", "FOODS")).alias("f"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(t#") == 1
    assert [r.f for r in out.collect()] == ["its a b  cafe \nx y  1 foods", None]
    words = ["sing", "going", "users", "glasses", "cats", "rated", "a.b-c", "plain"]
    some = spark.createDataFrame([(w,) for w in words], "w string").select(text.stem(F.col("w")).alias("s"))
    assert [r.s for r in some.collect()] == ["sing", "going", "user", "glass", "cats", "rated", "a.b-c", "plain"]


def test_rounds_expire_without_a_call_per_user(spark, tmp_path):
    """Sessions of the engine close the rounds: no Python stands in the plan. A deal exactly at the end of another's time does
    not save it, one a second earlier does."""
    from palate.streaming import jobs

    at, void = str(tmp_path), 100
    deals = [(1, 1, 1000), (1, 2, 1100), (2, 1, 1000), (2, 2, 1099), (3, 1, 1000), (3, 2, 1000), (4, 1, 9000)]
    for n, some in enumerate((deals, [(4, 2, 9500)])):
        spark.createDataFrame(some, "user_id long, seq long, dealt_at long").coalesce(1).write.parquet(f"{at}/in/{n}")
    stream = spark.readStream.schema("user_id long, seq long, dealt_at long").option("maxFilesPerTrigger", 1).parquet(f"{at}/in/*")
    out = jobs.stale_round_expiry(stream, void_after=void)
    assert "InPandas" not in out._jdf.queryExecution().logical().toString()
    out.writeStream.outputMode("append").option("checkpointLocation", f"{at}/cp").format("parquet").trigger(availableNow=True).start(f"{at}/out").awaitTermination()
    want = [(1, 1, 1100), (1, 2, 1200), (2, 2, 1199), (3, 2, 1100), (4, 1, 9100)]
    assert rows(spark.read.parquet(f"{at}/out"), "user_id", "seq", "expired_at") == want


def _made_grid(spark, n=60, users=7):
    """Items, features, weights, runs and votes of a small grid."""
    items = spark.range(1, n + 1).selectExpr(
        "id story_id", "concat('t', id) title", "cast(null as string) url", "cast(null as string) domain", "'a' author",
        "id % 9 points", "id * 7 % 50 num_comments", "id * 11 created_at", "'2024-01-01' day", "0L fetched_at",
    )
    features = items.selectExpr("story_id", "inline(array(struct('__bias__' feature, 1.0D value, 0L pos), struct(concat('w:', story_id % 11) feature, 1.0D value, 1L pos)))")
    weights = spark.range(users * 11).selectExpr(f"id % {users} + 1 user_id", f"concat('w:', id div {users}) feature", "(id * 13 % 29 - 14) / 10.0D weight", "2L support")
    runs = spark.range(1, users + 1).selectExpr("id user_id", "2 rev", "40L n_votes", "20L n_pos", "20L n_neg", "0L trained_at")
    votes_ = spark.range(40).selectExpr(f"id % {users} + 1 user_id", "id * 3 % 60 + 1 story_id", "cast(id % 3 - 1 as int) value", "0L created_at", "0L updated_at")
    return items, features, weights, runs, votes_


def test_the_grid_is_made_without_a_shuffle(spark, monkeypatch):
    """Stored tiles are crossed partition by partition: what is after them has no exchange, and what they give is the same in
    tiles and slices of any size, with judged pairs left out, counted in bins or cut to the heads."""
    from palate.operators import reports

    items, features, weights, runs, votes_ = _made_grid(spark)
    grid = score.rescore_all(features, weights, runs)
    plan = grid._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan
    want = {(x.user_id, x.story_id): x.score for x in grid.collect()}
    assert len(want) == 60 * 7
    for name, size in (("STORIES", 8), ("USERS", 2), ("EXAMPLES", 100), ("TILE", 30)):
        monkeypatch.setattr(score, name, size)
    judged = {(x.user_id, x.story_id) for x in votes_.collect()}
    got = {(x.user_id, x.story_id): x.score for x in score.rescore_all(features, weights, runs, votes_).collect()}
    assert got == {k: x for k, x in want.items() if k not in judged}
    tiles = score.pack_users(weights, runs)
    assert tiles.count() > 3 and sorted(tiles.selectExpr("explode(u_id) id").toPandas()["id"]) == list(range(1, 8))
    parts = score.binned_scores(features, weights, runs, votes_, 20).groupBy("user_id", "bin").agg(F.sum("n").alias("n"))
    assert rows(reports.every_bin(parts, runs), "user_id", "bin", "n") == rows(reports.score_distribution(grid, votes_, runs), "user_id", "bin", "n")
    cut = score.deck_scores(features, weights, runs, votes_, 12, 1, decks.CONFIDENT, decks.NEAR).localCheckpoint()
    card = ("user_id", "story_id", "reason", "pos")
    assert rows(decks.training_queue(items, cut, votes_, runs, 3, 1, 0, unjudged_scores=True), *card) == rows(decks.training_queue(items, grid, votes_, runs, 3, 1, 0), *card)


def test_feeds_with_judged_items_come_from_models(spark):
    """Orders that need no score rank once for all users, judged items or not, and only the page is scored."""
    from palate.operators import feed

    items, features, weights, runs, votes_ = _made_grid(spark)
    grid = score.rescore_all(features, weights, runs).localCheckpoint()
    place = ("user_id", "pos", "story_id", "total", "score")
    for o in (feed.FeedOptions(mode="top", limit=9, include_voted=True), feed.FeedOptions(limit=9, offset=2, include_voted=True, min_score=0.4)):
        assert rows(feed.feed_from_models(items, features, weights, runs, votes_, o, 0), *place) == rows(feed.feed(items, grid, votes_, o, 0), *place)


def test_names_of_one_number_are_told_apart(spark, monkeypatch):
    """Two names with one code are two names: a second number tells, within a tile and across."""
    items, features, weights, runs, _ = _made_grid(spark)
    key = lambda df: {(x.user_id, x.story_id): (x.score, x.confidence) for x in df.collect()}
    want = key(score.rescore_all(features, weights, runs))
    monkeypatch.setattr(score, "_code", lambda name, seed=0: F.when(name.startswith("w:"), F.lit(3) + 2 * (F.length(name) % 2)).otherwise(2).cast("long"))
    assert key(score.rescore_all(features, weights, runs)) == want


def test_missing_scores_are_made_without_a_shuffle(spark, monkeypatch):
    """Gaps go with their users' tiles: what is after the tiles has no exchange, and gives what lacks and nothing else."""
    items, features, weights, runs, _ = _made_grid(spark)
    for name, size in (("STORIES", 8), ("USERS", 2)):
        monkeypatch.setattr(score, name, size)
    grid = score.rescore_all(features, weights, runs).localCheckpoint()
    out = score.score_missing(items, features, grid.where("story_id % 4 <> 0 or user_id = 3"), weights, runs)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan
    assert rows(out, "user_id", "story_id", "score") == rows(grid.where("story_id % 4 = 0 and user_id <> 3"), "user_id", "story_id", "score")
