"""Benchmark decontamination by pigeonhole edit matching.

A test item of length m gets an error budget of m // 14 characters. Cut into budget + 1 pieces, at least one piece
must stand unchanged in any passage within the budget. One Aho-Corasick automaton over all pieces of a block of items
scans each text once; where a piece hits, Myers' bit-parallel distance verifies the whole item against the window
around it. Texts and items are compared as lower-cased (A-Z) words of ASCII letters, digits and non-ASCII characters
with single blanks between them. An item too short for an edit must stand word for word, from one word's begin to
another's end.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palate.llm.common import alnum_words, materialise

#: One edit is allowed for so many characters of an item.
CHARS_PER_EDIT = 14
#: Characters of items in a block: what one automaton, sent to every task, is built from.
BLOCK_CHARS = 2_000_000


def normalise(text: str | None) -> str:
    return b" ".join(alnum_words(text)).decode("utf-8", "surrogatepass")


def cut(item: str) -> list[tuple[int, str]]:
    """(offset, piece) of budget + 1 pieces of about equal length."""
    n = len(item) // CHARS_PER_EDIT + 1
    edges = [i * len(item) // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(edges, edges[1:], strict=False)]


class Pattern:
    """An item prepared for Myers' algorithm: one bit mask of places for each of its characters."""

    def __init__(self, item: str):
        self.item, self.m = item, len(item)
        self.budget = self.m // CHARS_PER_EDIT
        self.at: dict[str, int] = {}
        for i, c in enumerate(item):
            self.at[c] = self.at.get(c, 0) | 1 << i

    def search(self, text: str, start: int, stop: int) -> tuple[int, int] | None:
        """(distance, end) of the best approximate place in text[start:stop], the first of equals; None if over
        the budget. Column score by Hyyro's formulation: the item may begin anywhere."""
        full, top = (1 << self.m) - 1, 1 << (self.m - 1)
        plus, minus, score, best = full, 0, self.m, None
        get = self.at.get
        for j in range(start, stop):
            eq = get(text[j], 0)
            d0 = ((((eq & plus) + plus) ^ plus) | eq | minus) & full
            hp = minus | (full & ~(d0 | plus))
            hn = plus & d0
            if hp & top:
                score += 1
            elif hn & top:
                score -= 1
            hp = (hp << 1) & full
            hn = (hn << 1) & full
            plus = hn | (full & ~(d0 | hp))
            minus = hp & d0
            if score <= self.budget and (best is None or score < best[0]):
                best = (score, j + 1)
        return best


class Matcher:
    """All items of a block: finds every place of ``text`` within an item's budget."""

    def __init__(self, items: list[tuple[int, str]]):
        import ahocorasick

        self.patterns: list[tuple[int, Pattern]] = []
        self.automaton = ahocorasick.Automaton()
        uses: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            for offset, piece in cut(text):
                uses.setdefault(piece, []).append((len(self.patterns), offset))
            self.patterns.append((item_id, Pattern(text)))
        for piece, where in uses.items():
            self.automaton.add_word(piece, (len(piece), where))
        if uses:
            self.automaton.make_automaton()
        self.empty = not uses

    def find(self, text: str) -> list[tuple[int, int, int]]:
        """(item_id, distance, end) of every place, in order of item and place."""
        if self.empty:
            return []
        begins: dict[int, list[int]] = {}
        for end, (length, where) in self.automaton.iter(text):
            for number, offset in where:
                begins.setdefault(number, []).append(end + 1 - length - offset)
        found = []
        for number, at in sorted(begins.items()):
            item_id, p = self.patterns[number]
            at.sort()
            i, done = 0, -1
            while i < len(at):
                # hits that edits have shifted against each other are one place; an exact copy shifts none
                j = i
                while j + 1 < len(at) and at[j + 1] - at[j] <= p.budget:
                    j += 1
                lo, hi = at[i], at[j]
                i = j + 1
                if not p.budget:
                    bounded = (lo == 0 or text[lo - 1] == " ") and text[lo + p.m : lo + p.m + 1] in ("", " ")
                    best = (0, lo + p.m) if bounded else None
                elif lo == hi and lo >= 0 and text.startswith(p.item, lo):
                    best = (0, lo + p.m)
                else:
                    best = p.search(text, max(0, lo - p.budget), min(len(text), hi + p.m + p.budget))
                if best and best[1] > done:
                    done = best[1]
                    found.append((item_id, *best))
        return found


def matches(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """Places of benchmark items: rows (doc_id, item_id, distance, n_places, last_end): a document and an item found in it, with the smallest
    edit distance, the number of places, and where the last one ends in the normalised text.

    Items reach the tasks in blocks of about ``block_chars`` characters (or one item), a scan of ``docs`` for
    each block, so what is sent has a bound whatever the benchmark's size; of several blocks, each is scanned and its
    rows are written before the next is read. Items without a word match nothing; a null item id is reported as null. Null or empty texts and empty tables give no
    rows. Repeated documents report once each; repeated items of one id are matched as separate texts and merged.
    """
    items = benchmark.select(
        benchmark[item_col].cast("long").alias("item_id"), benchmark[item_text_col].alias("text")
    ).where("text is not null").distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-2 * total // block_chars)) if total > block_chars else 1
    base = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).where("text is not null")
    out = None
    for b in range(blocks):
        some = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        rows = [(r["item_id"], normalise(r["text"])) for r in some.collect()]
        found = _scan(base, [x for x in rows if x[1]])
        if blocks > 1:
            found = materialise(found, "found")
        out = found if out is None else out.unionByName(found)
    return out


def _scan(base: DataFrame, items: list[tuple[int, str]]) -> DataFrame:
    sent = base.sparkSession.sparkContext.broadcast(items)
    ddl = "doc_id long, item_id long, distance int, n_places int, last_end long"
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(sent.value)
        for batch in batches:
            cols: list[list] = [[] for _ in kinds]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                best: dict = {}
                for item, distance, end in matcher.find(normalise(text.as_py())):
                    d, n, e = best.get(item, (distance, 0, end))
                    best[item] = (min(d, distance), n + 1, max(e, end))
                for item, (d, n, e) in best.items():
                    for c, v in zip(cols, (doc, item, d, n, e), strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, kinds, strict=True)],
                names=["doc_id", "item_id", "distance", "n_places", "last_end"],
            )

    return base.mapInArrow(run, ddl)


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` (with doc_id and text) without documents in which an item was found. Rows that repeat an id go together;
    a row with a null id goes by its own text."""
    hit = matches(docs.where("doc_id is not null"), benchmark).select(F.col("doc_id").alias("__hit")).distinct()
    out = docs.join(hit, docs["doc_id"] == F.col("__hit"), "left_anti")
    nameless = docs.where("doc_id is null and text is not null").select(F.xxhash64("text").alias("doc_id"), "text").distinct()
    if nameless.isEmpty():
        return out
    bad = matches(nameless, benchmark).select("doc_id").join(nameless, "doc_id").select(F.col("text").alias("__bad")).distinct()
    return out.join(bad, docs["doc_id"].isNull() & (docs["text"] == F.col("__bad")), "left_anti")
