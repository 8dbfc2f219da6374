"""Quality rules: document statistics and learned decision lists, both in built-in Spark functions.

Statistics are Column expressions over the whole text. A decision list is learned from labelled statistics by
sequential covering: each rule grows a conjunction of thresholds that best separates rejects from the rest among the
rows no earlier rule covers, is pruned on held-out rows, and is kept only while it is precise enough. The list is
emitted as one ordered ``F.when`` expression, so applying it costs a projection.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from dataclasses import dataclass
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palate.llm.common import let

SPACE = "[\\x20\\x09-\\x0D]"
SPACE_CHARS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 3
#: Fixed floor rules that come before the learned list.
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

FEATURES = ("symbols_per_word", "word_length", "dup_line_share", "repeat_share", "upper_share", "mark_share", "log_words")


def words_of(text: Column) -> Column:
    """Runs of characters other than U+0020 and U+0009 to U+000D; an empty array for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"{SPACE}+"), "")


def count_chars(text: Column, chars: str) -> Column:
    """How many characters of ``text`` are among ``chars``."""
    return F.char_length(text) - F.char_length(F.translate(text, chars, ""))


def repeated_words(words: Column) -> Column:
    """How many words stand in a WINDOW-word window that occurs twice or more in the array, first places included.

    Windows become (64-bit hash, place) pairs; sorting puts equal ones side by side, which finds the repeated places
    in n log n. Places then cover WINDOW words each, less where the next one begins earlier.
    """

    def places(s: Column) -> Column:
        def of(x: Column, i: Column) -> Column:
            before = F.get(s, i - 1)["h"] == x["h"]
            after = F.get(s, i + 1)["h"] == x["h"]
            return F.when(F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False)), x["i"])

        return F.array_sort(F.array_compact(F.transform(s, of)))

    def covered(p: Column) -> Column:
        steps = F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    def windows(w: Column) -> Column:
        spots = F.sequence(F.lit(0), F.size(w) - WINDOW)
        hashed = F.transform(
            spots, lambda i: F.struct(F.xxhash64(*(F.get(w, i + k) for k in range(WINDOW))).alias("h"), i.alias("i"))
        )
        return F.when(F.size(w) >= WINDOW, hashed).otherwise(F.slice(hashed, 1, 0))

    def whole(w: Column) -> Column:
        return F.when(
            F.size(w) >= WINDOW,
            let(F.array_sort(windows(w)), lambda s: let(places(s), covered)),
        ).otherwise(F.lit(0))

    return let(words, whole)


def statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with one struct column ``__stats`` of the base counts and the learner's features.

    Null texts have no words. Ratios over no words are 0. A clashing ``__stats`` column is replaced.
    """
    text = F.coalesce(docs[text_col], F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.char_length(F.translate(x, SPACE_CHARS, "")) > 0)

    def share(a: Column, b: Column) -> Column:
        return F.coalesce(a.cast("double") / F.nullif(b, F.lit(0)), F.lit(0.0))

    def of(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.char_length(F.translate(text, SPACE_CHARS, "")).cast("long").alias("word_chars"),
            count_chars(text, SYMBOLS).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("d"))).alias("l"),
            repeated_words(w).cast("long").alias("n_repeat_words"),
            count_chars(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("n_upper"),
            count_chars(text, "!?").alias("n_marks"),
        )

    def add(s: Column) -> Column:
        n = s["n_words"]
        return F.struct(
            n.alias("n_words"),
            s["word_chars"].alias("word_chars"),
            s["n_symbols"].alias("n_symbols"),
            s["l"]["d"].cast("long").alias("n_dup_lines"),
            s["n_repeat_words"].alias("n_repeat_words"),
            share(s["n_symbols"], n).alias("symbols_per_word"),
            share(s["word_chars"], n).alias("word_length"),
            share(s["l"]["d"], s["l"]["n"]).alias("dup_line_share"),
            share(s["n_repeat_words"], n).alias("repeat_share"),
            share(s["n_upper"], s["word_chars"]).alias("upper_share"),
            share(s["n_marks"], n).alias("mark_share"),
            F.log1p(n.cast("double")).alias("log_words"),
        )

    return docs.withColumn("__stats", let(let(words_of(text), of), add))


def base_failed(s: Column) -> Column:
    """The fixed floor: fewer than 50 words, or over half of the words in repeated windows."""
    return (s["n_words"] < MIN_WORDS) | (100 * s["n_repeat_words"] > MAX_REPEAT_PERCENT * s["n_words"])


@dataclass(frozen=True)
class Test:
    feature: str
    above: bool
    threshold: float

    def column(self, s: Column) -> Column:
        return s[self.feature] > self.threshold if self.above else s[self.feature] <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


@dataclass(frozen=True)
class Rule:
    tests: tuple[Test, ...]
    covered: int
    precision: float

    def column(self, s: Column) -> Column:
        out = F.lit(True)
        for t in self.tests:
            out = out & t.column(s)
        return out

    def __str__(self) -> str:
        return " and ".join(map(str, self.tests))


@dataclass(frozen=True)
class Settings:
    """``most_rows`` bounds the labelled rows the learner sees, whatever the corpus; the ones with the smallest
    hashes of their ids are taken."""

    most_rows: int = 20_000
    cuts: int = 24
    most_tests: int = 3
    most_rules: int = 12
    least_rows: int = 8
    least_precision: float = 0.9
    held_out: int = 3


def learn(labelled: DataFrame, settings: Settings = Settings()) -> list[Rule]:
    """Decision list from ``labelled`` (id, one double a feature in FEATURES, reject boolean).

    Sequential covering over at most ``settings.most_rows`` rows. Rows with a null label or statistic are left out;
    without rejects or without labels at all the list is empty, which keeps everything. Sets of rows are bit masks,
    so counting a conjunction is an AND and a popcount. Ties go to the earlier feature, then to the cut farther
    from the rows to keep.
    """
    # Rows with nulls are left out here, not by a filter: Catalyst would move one over the statistics below the join
    # with the labels, and so work them out for every document.
    rows = labelled.select("id", *FEATURES, "reject").orderBy(F.xxhash64("id"), "id").limit(settings.most_rows).collect()
    rows = sorted((r for r in rows if None not in r), key=lambda r: tuple(r)[1:])
    n = len(rows)
    bad = sum(1 << i for i, r in enumerate(rows) if r["reject"])
    prune_on = sum(1 << i for i in range(n) if i % settings.held_out == 0)
    grow_on = ((1 << n) - 1) & ~prune_on
    masks: dict[Test, int] = {}
    for f in FEATURES:
        order = sorted(range(n), key=lambda i: r[f] if (r := rows[i]) else 0)
        values = [rows[i][f] for i in order]
        # quantiles of all rows and of the rejects, since few rows may carry the signal
        own = [v for i, v in zip(order, values, strict=True) if rows[i]["reject"]]
        at = {v[q * len(v) // settings.cuts] for v in (values, own) if v for q in range(settings.cuts)}
        distinct = sorted(set(values))
        # a cut lies halfway to the next value, so it leaves a margin on both sides
        nexts = [(v, distinct[k]) for v in sorted(at) if (k := bisect_right(distinct, v)) < len(distinct)]
        # and right below the lowest reject of a quantile
        nexts += [(distinct[k - 1], v) for v in sorted(at) if (k := bisect_left(distinct, v)) > 0]
        for cut in sorted({(v + w) / 2 for v, w in nexts}):
            below = sum(1 << i for i in order[: bisect_right(values, cut)])
            masks[Test(f, False, cut)] = below
            masks[Test(f, True, cut)] = ((1 << n) - 1) & ~below
    left, rules = (1 << n) - 1, []
    while len(rules) < settings.most_rules:
        tests = _grow(masks, left & grow_on, bad, settings)
        tests = _prune(tests, masks, left & prune_on, bad)
        cover = left
        for t in tests:
            cover &= masks[t]
        size, hits = cover.bit_count(), (cover & bad).bit_count()
        if not tests or size < settings.least_rows or (hits + 1) / (size + 2) < settings.least_precision:
            break
        rules.append(Rule(tuple(tests), size, hits / size))
        left &= ~cover
    return rules


def _grow(masks: dict[Test, int], rows: int, bad: int, settings: Settings) -> list[Test]:
    """Add the test of the highest information gain (as FOIL measures it) until no reject-free row is covered."""
    tests: list[Test] = []
    while len(tests) < settings.most_tests:
        p, n = (rows & bad).bit_count(), (rows & ~bad).bit_count()
        if not p or not n:
            break
        best, gain = None, 0.0
        for t, mask in masks.items():
            p1, n1 = (rows & mask & bad).bit_count(), (rows & mask & ~bad).bit_count()
            g = p1 * (log2(p1 / (p1 + n1)) - log2(p / (p + n))) if p1 else 0.0
            # of equal cuts upwards the highest, farthest from the rows to keep; downwards the lowest
            further = best and t.above and best.above and t.feature == best.feature and gain > 0
            if g > gain + 1e-12 or further and g > gain - 1e-12:
                best, gain = t, g
        if best is None:
            break
        tests.append(best)
        rows &= masks[best]
    return tests


def _prune(tests: list[Test], masks: dict[Test, int], rows: int, bad: int) -> list[Test]:
    """Drop final tests while the held-out value (hits - misses) / (hits + misses) does not fall."""

    def value(some: list[Test]) -> float:
        cover = rows
        for t in some:
            cover &= masks[t]
        p, n = (cover & bad).bit_count(), (cover & ~bad).bit_count()
        return (p - n) / (p + n) if p + n else -1.0

    while len(tests) > 1 and value(tests[:-1]) >= value(tests):
        tests = tests[:-1]
    return tests


def decide(rules: list[Rule], s: Column) -> Column:
    """Ordered conditional: the number of the first rule that covers a row, from 1; 0 where none does."""
    out = None
    for i, r in enumerate(rules, 1):
        out = F.when(r.column(s), F.lit(i)) if out is None else out.when(r.column(s), F.lit(i))
    return F.lit(0) if out is None else out.otherwise(F.lit(0))


def training_rows(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Statistics of labelled documents. Labels repeated for an id count once if they agree, else not at all."""
    one = (
        labels.where("doc_id is not null and quality is not null")
        .groupBy("doc_id")
        .agg(F.min("quality").alias("q"), F.max("quality").alias("q2"))
        .where("q = q2")
        .select(F.col("doc_id").alias("__id"), (F.col("q") == 0).alias("__reject"))
        .orderBy(F.xxhash64("__id"), "__id")
        .limit(settings.most_rows)
    )
    # at most most_rows ids, so the broadcast is bounded
    some = docs.select(F.col("doc_id"), F.col("text")).join(F.broadcast(one), F.col("doc_id") == F.col("__id"))
    some = statistics(some)
    # documents that fail the floor teach nothing: their label is null
    label = F.when(~base_failed(F.col("__stats")), F.col("__reject")).alias("reject")
    return some.select(F.col("__id").alias("id"), *(F.col("__stats")[f].alias(f) for f in FEATURES), label)


def judge(docs: DataFrame, rules: list[Rule], text_col: str = "text") -> DataFrame:
    """``docs`` with ``__stats``, ``__base_failed``, ``__rule`` (0: none) and ``__kept``.

    Null and empty texts fail the floor. An empty table gives an empty table; repeated rows are judged alike.
    """
    out = statistics(docs, text_col)
    s = F.col("__stats")
    out = out.withColumns({"__base_failed": base_failed(s), "__rule": decide(rules, s)})
    return out.withColumn("__kept", ~F.col("__base_failed") & (F.col("__rule") == 0))
