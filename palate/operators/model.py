"""One small class-balanced logistic model per user: vocabulary, training, cross-validation, revisions."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palate.functions.scalars import sigmoid
from palate.functions.text import describe_feature
from palate.operators import pooled
from palate.operators.features import beside
from palate.operators.ranking import ranged


@dataclass(frozen=True)
class FitOptions:
    epochs: int = 60
    lr: float = 0.35
    l2: float = 2e-4
    min_count: int = 1
    seed: int = 20260824


def vocabulary(examples: DataFrame, features: DataFrame, min_count: int = 1) -> DataFrame:
    """(user_id, feature, support, idx): features of a user's examples, numbered in the order first seen."""
    rows = beside(examples.select("user_id", "story_id", "ord"), features, "pos")
    seen = rows.groupBy("user_id", "feature").agg(F.count("*").alias("support"), F.min(F.struct("ord", "pos")).alias("at"))
    seen = seen.where((F.col("support") >= min_count) | (F.col("feature") == "__bias__"))
    idx = F.row_number().over(Window.partitionBy("user_id").orderBy("at", "feature")) - 1
    return seen.select("user_id", "feature", "support", idx.alias("idx"))


def class_weights(examples: DataFrame, l2: float = 2e-4) -> DataFrame:
    """Balancing weights of both classes, 1 for an absent one, and the penalty, raised under 200 examples."""
    by = examples.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("label") == 1).alias("n_pos"))
    n, pos = F.col("n"), F.col("n_pos")
    return by.select(
        "user_id",
        "n",
        "n_pos",
        (n - pos).alias("n_neg"),
        F.when(pos > 0, n / (2.0 * pos)).otherwise(1.0).alias("w_pos"),
        F.when(n > pos, n / (2.0 * (n - pos))).otherwise(1.0).alias("w_neg"),
        (F.lit(l2) * F.greatest(F.lit(200.0) / n, F.lit(1.0))).alias("l2_effective"),
    )


def cv_folds(examples: DataFrame, k: int = 5) -> DataFrame:
    """``examples`` with ``fold``, dealt in turn within each class; null where a user cannot be cross-validated: fewer
    than two folds, or a class that some fold would leave empty."""
    per = Window.partitionBy("user_id", "label").orderBy("ord")
    n = Window.partitionBy("user_id")
    pos, neg = F.count_if(F.col("label") == 1).over(n), F.count_if(F.col("label") == 0).over(n)
    folds = F.least(F.lit(k), pos, neg)
    return examples.withColumn("k", folds).withColumn("rn", F.row_number().over(per) - 1).withColumn(
        "fold", F.when(F.col("k") >= 2, F.pmod("rn", F.nullif("k", F.lit(0))))
    ).drop("rn")


def _draws(seed: int, count: int) -> np.ndarray:
    """The first numbers in [0, 1) of the 32-bit counter generator called mulberry32."""
    # fixed values: the increment, the odd masks and the shifts of that generator
    a = np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0x6D2B79F5) + np.uint64(seed)
    a = a.astype(np.uint32)
    t = (a ^ a >> np.uint32(15)) * (a | np.uint32(1))
    t ^= t + (t ^ t >> np.uint32(7)) * (t | np.uint32(61))
    return (t ^ t >> np.uint32(14)) / 4294967296.0


def _orders(n: int, options: FitOptions) -> np.ndarray:
    """The order in which each epoch visits n examples: one shuffle after another of the same list."""
    draws = iter(_draws(options.seed, options.epochs * max(n - 1, 0)).tolist())
    order, out = list(range(n)), np.zeros((options.epochs, n), dtype=np.int64)
    for epoch in range(options.epochs):
        for i in range(n - 1, 0, -1):
            j = int(next(draws) * (i + 1))
            order[i], order[j] = order[j], order[i]
        out[epoch] = order
    return out


#: So few models of one size are trained one by one: a step of many costs about as much as FEW steps of one.
FEW = 6


def _train_one(label: np.ndarray, ends: np.ndarray, slot: np.ndarray, value: np.ndarray, options: FitOptions) -> np.ndarray:
    """Weights of one model, by the rule of ``_train``. A slot's weight and its sum of squares stand side by side, so that
    each example fetches and stores its own once."""
    n, pos = len(label), float(label.sum())
    weight = np.where(label == 1, n / (2 * pos), n / (2 * (n - pos))).tolist()
    labels, l2, lr, exp = label.tolist(), options.l2 * max(200 / n, 1.0), options.lr, math.exp
    begins = np.concatenate(([0], ends[:-1])).tolist()
    own_slots = [slot[a:z] for a, z in zip(begins, ends.tolist(), strict=True)]
    own_values = [value[a:z] for a, z in zip(begins, ends.tolist(), strict=True)]
    both = np.zeros((int(slot.max()) + 1, 2))
    both[:, 1] = 1e-8
    sqrt, dot = np.sqrt, np.dot
    for order in _orders(n, options).tolist():
        for k in order:
            i, x = own_slots[k], own_values[k]
            held = both[i]
            w = held[:, 0]
            z = float(dot(w, x))
            error = weight[k] * (1 / (1 + exp(-max(min(z, 700.0), -700.0))) - labels[k])
            grad = x * error
            grad += w * l2
            held[:, 1] += grad * grad
            grad *= lr
            grad /= sqrt(held[:, 1])
            w -= grad
            both[i] = held
    return np.round(both[:, 0], 6)


def _train(model: np.ndarray, label: np.ndarray, ends: np.ndarray, slot: np.ndarray, value: np.ndarray, options: FitOptions) -> np.ndarray:
    """Weights of many models at once. Examples are sorted by ``model`` (numbered from 0); example i has the features
    ``slot`` and ``value`` before ``ends[i]``, and no two models share a slot.

    Each model follows the per-example rule: AdaGrad on the class-balanced logistic loss, one example after another in
    its seeded order, the penalty on the example's own features only. Models are independent, so step s takes the s-th
    example of every model that has one.
    """
    n = np.bincount(model)
    if len(n) <= FEW:
        w = np.zeros(slot.max() + 1)
        for last, size in zip(np.cumsum(n).tolist(), n.tolist(), strict=True):
            first = last - size
            low, high = int(ends[first - 1]) if first else 0, int(ends[last - 1])
            names, own = np.unique(slot[low:high], return_inverse=True)
            w[names] = _train_one(label[first:last], ends[first:last] - low, own, value[low:high], options)
        return w
    pos = np.bincount(model, weights=label)
    weight = np.where(label == 1, (n / (2 * pos))[model], (n / (2 * (n - pos)))[model])
    l2 = options.l2 * np.maximum(200 / n, 1.0)
    by_size = np.argsort(-n, kind="stable")
    orders = {size: _orders(int(size), options) for size in np.unique(n)}
    first = (np.cumsum(n) - n)[by_size]
    steps = np.full((options.epochs, n.max(), len(n)), -1, dtype=np.int64)
    for at, m in enumerate(by_size):
        steps[:, : n[m], at] = orders[n[m]] + first[at]
    begins = np.concatenate(([0], ends[:-1]))
    w, squares = np.zeros(slot.max() + 1), np.full(slot.max() + 1, 1e-8)
    active = [int((n > s).sum()) for s in range(n.max())]
    for epoch in steps:
        for rows, many in zip(epoch, active, strict=True):
            rows = rows[:many]
            lengths = ends[rows] - begins[rows]
            at = np.cumsum(lengths) - lengths
            entries = np.arange(int(lengths.sum())) + np.repeat(begins[rows] - at, lengths)
            i, x = slot[entries], value[entries]
            own = w[i]
            z = np.add.reduceat(own * x, at)
            error = weight[rows] * (1 / (1 + np.exp(-np.clip(z, -700, 700))) - label[rows])
            grad = np.repeat(error, lengths) * x + np.repeat(l2[model[rows]], lengths) * own
            squares[i] += grad * grad
            w[i] = own - options.lr / np.sqrt(squares[i]) * grad
    return np.round(w, 6)


FIT = "user_id long, fold int, idx long, feature string, weight double, support long"
#: Examples trained together in one group; a model with more has a group of its own.
TOGETHER = 16_384
#: From this power of two of examples on, models are dealt out to a group each.
ALONE = 9


def packed(features: DataFrame) -> DataFrame:
    """(story_id, entries): an item's features with their values, in order of place, in one row."""
    row = F.array_sort(F.collect_list(F.struct("pos", "feature", F.col("value").cast("double").alias("value"))))
    return features.groupBy("story_id").agg(F.transform(row, lambda x: F.struct(x["feature"].alias("feature"), x["value"].alias("value"))).alias("entries"))


def _spans(first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers from each ``first`` on, ``lengths`` of them, one after another."""
    return np.arange(int(lengths.sum())) + np.repeat(first - np.cumsum(lengths) + lengths, lengths)


def _group(table: pa.Table, options: FitOptions, held: bool) -> pa.Table:
    """The models of a group's users, each on those examples that its fold leaves; with ``held`` the held-out examples'
    sums under them instead of the weights."""
    order = np.lexsort((table["story_id"].to_numpy(), table["ord"].to_numpy(), table["user_id"].to_numpy()))
    table = table.combine_chunks().take(pa.array(order))
    user, story, label = (table[c].to_numpy() for c in ("user_id", "story_id", "label"))
    fold = pc.fill_null(table["fold"], -2).to_numpy()
    lists, models = table["entries"].combine_chunks(), table["models"].combine_chunks()
    lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    feature, value = lists.flatten().flatten()
    feature, value, starts = feature.dictionary_encode(), value.to_numpy(), np.cumsum(lengths) - lengths
    name, names = feature.indices.to_numpy(), np.array(feature.dictionary.to_pylist(), dtype=object)
    example = np.repeat(np.arange(len(user)), pc.list_value_length(models).to_numpy(zero_copy_only=False))
    of = models.flatten().to_numpy()
    # every model of the group, by user and fold
    keys, code = np.unique(np.stack([user[example], of]), axis=1, return_inverse=True)
    code = code.reshape(-1)
    learns = (of < 0) | (fold[example] >= 0) & (fold[example] != of)
    n = np.bincount(code[learns], minlength=keys.shape[1])
    pos = np.bincount(code[learns], weights=label[example[learns]], minlength=keys.shape[1]).astype(np.int64)
    able = (pos > 0) & (pos < n)
    chosen = np.flatnonzero(learns & able[code])
    chosen = chosen[np.argsort(code[chosen], kind="stable")]
    many = lengths[example[chosen]]
    row, entries = np.repeat(np.arange(len(chosen)), many), _spans(starts[example[chosen]], many)
    own = code[chosen][row] * len(names) + name[entries]
    if options.min_count > 1:
        _, back, times = np.unique(own, return_inverse=True, return_counts=True)
        keep = (times[back] >= options.min_count) | (names[name[entries]] == "__bias__")
        row, entries, own = row[keep], entries[keep], own[keep]
    slot, slots = pd.factorize(own)
    has = np.bincount(row, minlength=len(chosen))
    chosen, ends = chosen[has > 0], np.cumsum(has[has > 0])
    w = np.zeros(0)
    if len(chosen):
        numbered = np.unique(code[chosen], return_inverse=True)[1]
        w = _train(numbered, label[example[chosen]].astype(float), ends, slot, value[entries], options)
    if not held:
        at = slots // max(len(names), 1)
        columns = (keys[0][at], keys[1][at].astype(np.int32), np.arange(len(slots)) - np.searchsorted(at, at), pa.array(names[slots % max(len(names), 1)], pa.string()), w, np.bincount(slot, minlength=len(slots)))
        return pa.table([pa.array(c) for c in columns], names=[c.split()[0] for c in FIT.split(", ")])
    out = np.flatnonzero((of >= 0) & (fold[example] == of) & (n[code] > 0))
    many = lengths[example[out]]
    row, entries = np.repeat(np.arange(len(out)), many), _spans(starts[example[out]], many)
    at = pd.Index(slots).get_indexer(code[out][row] * len(names) + name[entries])
    content = value[entries] * np.array([x != "__bias__" and not x.startswith("t:") for x in names], dtype=bool)[name[entries]]
    weight = np.where(at >= 0, np.append(w, 0.0)[at], 0.0)
    z, known, mass = (np.bincount(row, weights=x, minlength=len(out)) for x in (value[entries] * weight, content * (at >= 0), content))
    m = code[out]
    columns = (user[example[out]], of[out].astype(np.int32), story[example[out]], label[example[out]].astype(np.int32), z, known, mass, n[m], pos[m], n[m] - pos[m])
    return pa.table([pa.array(c) for c in columns], names=[c.split()[0] for c in HELD.split(", ")])


HELD = "user_id long, fold int, story_id long, label int, z double, known double, mass double, n_votes long, n_pos long, n_neg long"


def _grouped(examples: DataFrame, features: DataFrame, options: FitOptions, folds: bool, held: bool) -> DataFrame:
    base = examples.select("user_id", "story_id", "ord", "label", F.col("fold").cast("int") if folds else F.lit(None).cast("int").alias("fold"))
    sizes = base.groupBy("user_id").agg(F.count("*").alias("n"), F.max("fold").alias("most"))
    models = F.array() if held else F.array(F.lit(-1))
    if folds:
        models = F.concat(models.cast("array<int>"), F.when(F.col("most").isNotNull(), F.sequence(F.lit(0), "most")).otherwise(F.array().cast("array<int>")))
    sizes = sizes.withColumns({"models": models, "size": F.floor(F.log2("n"))}).where(F.size("models") > 0)
    # a user's models share one copy of the examples, but for those of many examples
    sets = F.when(F.col("size") < ALONE, F.array("models")).otherwise(F.transform("models", lambda m: F.array(m)))
    sizes = sizes.select("user_id", "n", "size", F.explode(sets).alias("models"))
    # a row for each power of two
    total = F.sum(F.col("n") * F.size("models"))
    classes = sizes.groupBy("size").agg(F.greatest(F.ceil(total / TOGETHER), F.when(F.col("size") >= ALONE, F.count("*")).otherwise(1)).alias("groups"))
    sizes = sizes.join(F.broadcast(classes), "size").select(
        "user_id", "models", "size", F.pmod(F.xxhash64("user_id", F.col("models")[0]), "groups").alias("part")
    )
    rows = base.join(packed(features), "story_id").join(sizes, "user_id")
    return rows.groupBy("size", "part").applyInArrow(lambda table: _group(table, options, held), HELD if held else FIT)


def fit_grouped(examples: DataFrame, features: DataFrame, options: FitOptions = FitOptions(), folds: bool = True) -> DataFrame:
    """Weights of every user with both labels: (user_id, fold, idx, feature, weight, support). Fold -1 is trained on all of a
    user's examples; with ``folds``, examples need a ``fold`` column and each fold gets a model trained without it.

    An example travels as one row with all its features, once for all folds of its user. A group holds users of about
    equal size, about TOGETHER examples of their models, in sparse arrays: what it needs grows with the features its
    examples have. The rule visits a model's examples one after another, so one user's votes stand in one task, about a
    kilobyte each. Users whose labels are all alike, and folds that leave one class, have no rows. The same examples give
    the same weights.
    """
    return _grouped(examples, features, options, folds, False)


def held_out_scores(folded: DataFrame, features: DataFrame, options: FitOptions = FitOptions()) -> DataFrame:
    """(user_id, fold, story_id, label, score, confidence): every example with a fold under the model of its user that was
    trained without that fold. Models are trained and applied in one task, and their weights never leave it."""
    from palate.operators.score import evidence

    s = evidence(*(F.col(c) for c in ("z", "known", "mass", "n_votes", "n_pos", "n_neg")))
    return _grouped(folded, features, options, True, True).withColumn("s", s).select("user_id", "fold", "story_id", "label", "s.score", "s.confidence")


def learns(sums: DataFrame) -> DataFrame:
    """(user_id, learns): whether the balanced squared error of ``sums`` (user_id, label, z) is below that of no model. The
    rule ends with whatever its last example did, and one of a pair of long titles that are alike can be left on the wrong
    side with a sum of any size: the logarithm of that alone can outweigh all others, its square is 1 at most."""
    p = sigmoid(F.col("z"))
    error = F.avg(F.when(F.col("label") == 1, (1 - p) * (1 - p))) + F.avg(F.when(F.col("label") == 0, p * p))
    return sums.groupBy("user_id").agg((error < 0.5).alias("learns"))


def fit_pooled(examples: DataFrame, features: DataFrame, options: FitOptions = FitOptions()) -> DataFrame:
    """One model over a cohort of any size: (feature, weight, support), the bias among them, under the objective of the
    per-user models. ``pooled`` has the method."""
    return pooled.fit(examples, features, options.l2, options.min_count, options.epochs)


def auc(df: DataFrame, by: list[str], label: str = "label", score: str = "score") -> DataFrame:
    """Rank-sum AUC per group, average ranks on ties, null without both classes; over all rows at once where ``by`` is
    empty, and one row then."""
    if not by:
        return pooled_auc(df, label, score)
    order = Window.partitionBy(*by).orderBy(score)
    ties = Window.partitionBy(*by, score)
    rank = F.rank().over(order) + (F.count("*").over(ties) - 1) / 2.0
    ranked = df.withColumn("__rank", rank)
    pos, neg = F.count_if(F.col(label) == 1), F.count_if(F.col(label) == 0)
    total = F.sum(F.when(F.col(label) == 1, F.col("__rank")))
    out = ranked.groupBy(*by).agg(pos.alias("p"), neg.alias("n"), total.alias("s"))
    p, n = F.col("p"), F.col("n")
    return out.select(*by, F.when((p > 0) & (n > 0), (F.col("s") - p * (p + 1) / 2.0) / (p * n)).alias("auc"))


def pooled_auc(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """AUC over all rows, one row. Equal scores are counted to one row first, so a tie never lies on a border; the rows
    are dealt into ranges of the score, and each range needs but the number of negatives before it."""
    y = F.col(label)
    tally = df.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("score")).agg(F.count_if(y == 1).alias("p"), F.count_if(y == 0).alias("n"))
    rows = ranged(tally, F.col("score"))
    # a row a range
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("__part").agg(F.sum("n").alias("n"))
    starts = sizes.select("__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    upto = F.sum("n").over(Window.partitionBy("__part").orderBy("score"))
    below = rows.withColumn("upto", upto).join(F.broadcast(starts), "__part")
    won = F.col("p") * (F.col("start") + F.col("upto") - F.col("n") / 2.0)
    out = below.agg(F.sum("p").alias("p"), F.sum("n").alias("n"), F.sum(won).alias("w"))
    return out.select(F.when((F.col("p") > 0) & (F.col("n") > 0), F.col("w") / (F.col("p").cast("double") * F.col("n"))).alias("auc"))


def cv_metrics(held_out: DataFrame) -> DataFrame:
    """Per user, from held-out rows (user_id, fold, label, score): n, accuracy, baseline, log_loss, auc, noise. Noise is
    the larger of the folds' spread and the adjusted standard error of the accuracy."""
    right = ((F.col("score") >= 0.5).cast("int") == F.col("label")).cast("double")
    p = F.least(F.greatest("score", F.lit(1e-9)), F.lit(1 - 1e-9))
    rows = held_out.withColumns({"right": right, "loss": -F.when(F.col("label") == 1, F.log(p)).otherwise(F.log(1 - p))})
    folds = rows.groupBy("user_id", "fold").agg(F.avg("right").alias("fa"))
    spread = folds.groupBy("user_id").agg(F.count("*").alias("folds"), F.coalesce(F.stddev_samp("fa"), F.lit(0.0)).alias("sd"))
    sums = rows.groupBy("user_id").agg(
        F.count("*").alias("n"),
        F.sum("right").alias("correct"),
        F.avg("label").alias("share"),
        F.avg("loss").alias("log_loss"),
    )
    q = (F.col("correct") + 2) / (F.col("n") + 4)
    out = sums.join(spread, "user_id").join(auc(held_out, ["user_id"]), "user_id")
    return out.select(
        "user_id",
        "folds",
        "n",
        (F.col("correct") / F.col("n")).alias("accuracy"),
        F.greatest(F.col("share"), 1 - F.col("share")).alias("baseline"),
        "auc",
        "log_loss",
        F.greatest(F.col("sd"), F.sqrt(q * (1 - q) / (F.col("n") + 4))).alias("noise"),
    )


def cross_validate(examples: DataFrame, features: DataFrame, options: FitOptions = FitOptions(), k: int = 5, weights: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(metrics, held-out rows). ``weights`` may bring models that fit_grouped made on the same folds."""
    from palate.operators.score import score_pairs

    folded = examples if "fold" in examples.columns else cv_folds(examples, k)
    if weights is None:
        held_out = held_out_scores(folded, features, options)
        return cv_metrics(held_out), held_out
    train = folded.where("fold is not null").alias("t").join(
        folded.where("fold is not null").select("user_id", F.col("fold").alias("f")).distinct().alias("d"), "user_id"
    )
    counts = train.where("fold <> f").groupBy("user_id", "f").agg(
        F.count("*").alias("n_votes"), F.count_if(F.col("label") == 1).alias("n_pos"), F.count_if(F.col("label") == 0).alias("n_neg")
    ).withColumnRenamed("f", "fold")
    pairs = folded.where("fold is not null").select("user_id", "fold", "story_id", "label")
    scored = score_pairs(pairs, features, weights.where("fold >= 0"), counts, ["user_id", "fold"])
    held_out = scored.select("user_id", "fold", "story_id", "label", "score", "confidence")
    return cv_metrics(held_out), held_out


def append_oof(oof: DataFrame, new: DataFrame) -> DataFrame:
    """Held-out scores keep every revision."""
    return oof.unionByName(new)


def oof_pair(oof: DataFrame) -> DataFrame:
    """The current and the previous revision's held-out scores: column ``age`` is 1 or 2."""
    age = F.dense_rank().over(Window.partitionBy("user_id").orderBy(F.desc("model_rev")))
    return oof.withColumn("age", age).where("age <= 2")


def next_runs(runs: DataFrame, metrics: DataFrame, trained_at: int) -> DataFrame:
    """``metrics`` (user_id and metric columns) as new rows of ``runs``: revisions stay dense per user."""
    last = runs.groupBy("user_id").agg(F.max("rev").alias("r"))
    return metrics.join(last, "user_id", "left").withColumns(
        {"rev": F.coalesce("r", F.lit(0)) + 1, "trained_at": F.lit(trained_at).cast("long")}
    ).drop("r")


def current_model(runs: DataFrame) -> DataFrame:
    """Newest run per user."""
    newest = runs.groupBy("user_id").agg(F.max_by(F.struct(*[c for c in runs.columns if c != "user_id"]), "rev").alias("r"))
    return newest.select("user_id", "r.*")


def insights(weights: DataFrame, limit: int = 12, min_support: int = 2) -> DataFrame:
    """Strongest features each way: the limit comes before the sign. (user_id, side, rank, feature, weight, support)"""
    some = weights.where(
        (F.col("support") >= min_support) & (F.abs("weight") > 1e-4) & (F.col("feature") != "__bias__")
    )
    top = Window.partitionBy("user_id").orderBy(F.desc("weight"), "idx")
    low = Window.partitionBy("user_id").orderBy("weight", "idx")
    keep = ("user_id", "side", "rank", "feature", "weight", "support")
    # a weight has one sign, so it is on one side at most
    ranked = some.withColumns({"top": F.row_number().over(top), "low": F.row_number().over(low)})
    like = F.col("weight") > 0
    ranked = ranked.withColumns({"rank": F.when(like, F.col("top")).otherwise(F.col("low")), "side": F.when(like, "like").otherwise("dislike")})
    return ranked.where(F.col("rank") <= limit).select(*keep)


def weight_movers(before: DataFrame, after: DataFrame, limit: int = 3) -> DataFrame:
    """Features whose weight moved most between two revisions, in the direction it now points."""
    was = before.select("user_id", "feature", F.col("weight").alias("was"))
    users = before.select("user_id").distinct()
    return movers(after.join(users, "user_id", "left_semi").join(was, ["user_id", "feature"], "left"), limit)


def movers(both: DataFrame, limit: int = 3) -> DataFrame:
    """``weight_movers`` of users with two revisions, whose earlier weights stand beside the others as ``was``, null for
    none."""
    delta = F.round(F.col("weight") - F.coalesce("was", F.lit(0.0)), 6)
    some = both.withColumn("delta", delta).where(
        (F.col("support") >= 2) & (F.col("feature") != "__bias__") & ~F.col("feature").startswith("t:") & (F.abs("delta") >= 1e-3)
    )
    side = F.when((F.col("delta") > 0) & (F.col("weight") > 0), "like").when((F.col("delta") < 0) & (F.col("weight") < 0), "dislike")
    some = some.withColumn("side", side).where("side is not null")
    order = Window.partitionBy("user_id", "side").orderBy(F.desc(F.abs("delta")), "idx")
    return some.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select(
        "user_id", "side", "rank", "feature", describe_feature(F.col("feature"))["label"].alias("label"), "delta"
    )


def reset_models(derived: DataFrame, users: DataFrame) -> DataFrame:
    """A derived table (runs, weights, held-out scores, rounds) without those users' rows."""
    return derived.join(users.select("user_id").distinct(), "user_id", "left_anti")


def prune_models(runs: DataFrame, upto: int) -> DataFrame:
    """Without revisions up to ``upto``, but never without a user's newest."""
    newest = F.max("rev").over(Window.partitionBy("user_id"))
    return runs.withColumn("__n", newest).where((F.col("rev") > upto) | (F.col("rev") == F.col("__n"))).drop("__n")


def model_history(runs: DataFrame, limit: int = 60) -> DataFrame:
    """Learning curve: of consecutive runs over the same number of votes the last, thinned to about ``limit`` points with
    the last one kept; with the user's points and runs in total."""
    order = Window.partitionBy("user_id").orderBy("rev")
    some = runs.where("accuracy is not null").withColumn("next", F.lead("n_votes").over(order))
    ends = some.where(F.col("next").isNull() | (F.col("next") != F.col("n_votes"))).drop("next")
    whole = Window.partitionBy("user_id")
    ends = ends.withColumns({"rn": F.row_number().over(order) - 1, "points": F.count("*").over(whole)})
    step = F.greatest(F.ceil(F.col("points") / F.lit(limit)), F.lit(1))
    return ends.where((F.col("rn") % step == 0) | (F.col("rn") == F.col("points") - 1)).drop("rn")


def payload_compat(snapshots: DataFrame) -> DataFrame:
    """Old model snapshots (user_id, rev, payload JSON) as runs; fields that a writer did not know get defaults."""
    schema = (
        "version int, nExamples long, nPos long, nNeg long, names array<string>,"
        "options struct<epochs: int, lr: double, l2: double, minCount: int>,"
        "metrics struct<accuracy: double, baseline: double, auc: double, logLoss: double, noise: double>"
    )
    p = F.from_json("payload", schema)
    return snapshots.withColumn("p", p).select(
        "user_id",
        "rev",
        F.coalesce("p.nExamples", F.lit(0)).alias("n_votes"),
        F.coalesce("p.nPos", F.lit(0)).alias("n_pos"),
        F.coalesce("p.nNeg", F.lit(0)).alias("n_neg"),
        F.coalesce(F.size("p.names"), F.lit(0)).cast("long").alias("n_features"),
        F.coalesce("p.options.epochs", F.lit(60)).alias("epochs"),
        F.coalesce("p.options.minCount", F.lit(1)).alias("min_count"),
        F.col("p.metrics.accuracy").alias("accuracy"),
        F.coalesce("p.metrics.noise", F.lit(0.0)).alias("noise"),
    )
