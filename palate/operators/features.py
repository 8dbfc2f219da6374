"""Titles, sites and authors as named, weighted features, one pass over each item."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palate.functions import text

#: Openings that mark a narrative title.
NARRATIVE = ("how", "why", "what", "when", "the case for", "i ")
STYLE = 0.6
#: Sections keep insertion order: a feature's place is section * SECTION + word * 100 + part. A word has under 30 letters,
#: so under 100 parts, and no text has so many words that it reaches the next section.
SECTION = 10**15


def _feature(name: Column, weight: float, place: Column) -> Column:
    return F.struct(name.alias("feature"), F.lit(weight).alias("value"), place.cast("long").alias("pos"))


def _flag(when: Column, name: str, place: int) -> Column:
    one = F.array(_feature(F.lit(name), STYLE, F.lit(3 * SECTION + place)))
    return F.when(when, one).otherwise(F.slice(one, 1, 0))


def word_features(kept: Column) -> Column:
    return F.transform(kept, lambda w, i: _feature(F.concat(F.lit("w:"), w), 1.0, i * 100 + SECTION))


def compound_parts(kept: Column) -> Column:
    """Parts of words with ``-`` or ``.``: longer than one letter, not the word itself, no stop word."""

    def parts(w: Column, i: Column) -> Column:
        # one plain character is split at without a pattern, and a word without any has no parts
        cut = F.when(F.contains(w, F.lit(".")), F.split(w, "[-.]")).when(F.contains(w, F.lit("-")), F.split(w, "-"))
        good = F.filter(F.coalesce(cut, F.array().cast("array<string>")), lambda p: (F.length(p) > 1) & (p != w) & ~p.isin(*text.STOP))
        return F.transform(
            good, lambda p, j: _feature(F.concat(F.lit("w:"), text.stem(p)), 0.5, i * 100 + j + SECTION + 1)
        )

    return F.flatten(F.transform(kept, parts))


def bigrams(kept: Column) -> Column:
    pairs = F.arrays_zip(F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0))).alias("a"), F.slice(kept, 2, F.size(kept)).alias("b"))
    return F.transform(
        pairs, lambda p, i: _feature(F.concat(F.lit("b:"), p["a"], F.lit("_"), p["b"]), 0.7, i + 2 * SECTION)
    )


def style_flags(title: Column) -> Column:
    lower = F.lower(title)
    flags = (
        (F.rtrim(title).endswith("?"), "t:question"),
        (lower.startswith("show hn"), "t:showhn"),
        (lower.startswith("ask hn"), "t:askhn"),
        (lower.startswith("tell hn"), "t:tellhn"),
        (text.has_year(title), "t:has_year"),
        (title.rlike("[0-9]"), "t:has_number"),
        (lower.rlike("^(?:" + "|".join(NARRATIVE) + ")"), "t:narrative"),
    )
    return F.concat(*(_flag(when, name, k) for k, (when, name) in enumerate(flags)))


def len_bucket(raw: Column) -> Column:
    bucket = F.least(F.floor(F.size(raw) / 3), F.lit(6)).cast("string")
    return F.array(_feature(F.concat(F.lit("t:len"), bucket), 0.3, F.lit(4 * SECTION)))


def domain_features(domain: Column) -> Column:
    labels = F.split(domain, "\\.")
    n = F.size(labels)
    site = F.array_join(F.slice(labels, F.greatest(n - F.when(n > 3, 2).otherwise(1), F.lit(1)), F.when(n > 3, 3).otherwise(2)), ".")
    whole = F.array(_feature(F.concat(F.lit("dom:"), domain), 1.0, F.lit(5 * SECTION)))
    wider = F.array(_feature(F.concat(F.lit("dom:"), site), 0.5, F.lit(5 * SECTION + 1)))
    top = F.array(_feature(F.concat(F.lit("tld:"), F.element_at(labels, -1)), 0.3, F.lit(5 * SECTION + 2)))
    own = F.array(_feature(F.lit("t:selfpost"), 1.0, F.lit(5 * SECTION)))
    some = F.concat(whole, F.when((n > 2) & (site != domain), wider).otherwise(F.slice(wider, 1, 0)), top)
    return F.when(domain.isNull(), own).otherwise(some)


def author_feature(author: Column) -> Column:
    one = F.array(_feature(F.concat(F.lit("by:"), F.lower(author)), 0.6, F.lit(6 * SECTION)))
    return F.when(author.isNotNull(), one).otherwise(F.slice(one, 1, 0))


#: Letters of the titles of one partition; a feature stands for some seven of them.
LETTERS = 4_000_000


def featurize(items: DataFrame) -> DataFrame:
    """``items`` (story_id, title, url, domain, author) as rows (story_id, feature, value, pos): a feature met more
    than once in an item sums and keeps its first place. The domain is derived from the url where it is null."""
    tokens = items.select(
        "story_id",
        F.coalesce("title", F.lit("")).alias("title"),
        F.coalesce("domain", text.domain_of(F.col("url"))).alias("domain"),
        "author",
        text.tokenize(F.col("title")).alias("raw"),
    )
    kept = tokens.withColumn("kept", F.transform(text.drop_stopwords(F.col("raw")), text.stem))
    bias = F.array(_feature(F.lit("__bias__"), 1.0, F.lit(0)))
    k = F.col("kept")
    every = F.concat(
        bias, word_features(k), compound_parts(k), bigrams(k), style_flags(F.col("title")), len_bucket(F.col("raw")),
        domain_features(F.col("domain")), author_feature(F.col("author")),
    )
    # dealt by item into as many partitions as the titles' length asks for, so that one task's groups stay as many
    size = items.agg(F.sum(F.length("title"))).first()[0] or 0
    parts = max(items.sparkSession.sparkContext.defaultParallelism, math.ceil(size / LETTERS))
    rows = kept.select("story_id", F.inline(every)).repartition(parts, "story_id")
    return rows.groupBy("story_id", "feature").agg(F.round(F.sum("value"), 6).alias("value"), F.min("pos").alias("pos"))


#: Judged items of one partition, with some sixty features each.
JUDGED = 20_000


def with_entries(pairs: DataFrame, features: DataFrame, *columns: str) -> DataFrame:
    """``pairs`` (user_id, story_id, ...) with ``entries``, their items' features with ``columns`` in one list: a pair
    travels as one row."""
    entries = features.groupBy("story_id").agg(F.collect_list(F.struct("feature", *columns)).alias("entries"))
    return pairs.join(entries, "story_id").select(*pairs.columns, "entries")


def beside(pairs: DataFrame, features: DataFrame, *columns: str) -> DataFrame:
    """``pairs`` (user_id, story_id, ...) with their items' features, a row each, dealt by user into as many partitions as
    their number asks for: what is grouped or ranked by user and feature then is not shuffled again."""
    parts = max(pairs.sparkSession.sparkContext.defaultParallelism, math.ceil(pairs.count() / JUDGED))
    return with_entries(pairs, features, *columns).repartition(parts, "user_id").select(*pairs.columns, F.inline("entries"))
