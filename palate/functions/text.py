"""Title text as Column expressions: folding, tokens, stems, sites, search, and readable feature names."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words without taste, label texts.
STOP = (
    "a", "an", "the", "of", "to", "in", "on", "for", "and", "or", "is", "are", "was", "be", "by",
    "it", "its", "as", "at", "from", "that", "this", "with", "you", "your", "i",
)
STYLE_LABELS = {
    "question": "titles that ask a question",
    "showhn": "Show HN posts",
    "askhn": "Ask HN posts",
    "tellhn": "Tell HN posts",
    "has_year": "titles containing a year",
    "has_number": "titles containing a number",
    "narrative": "first-person / explainer titles",
    "selfpost": "text posts (no link)",
    "len0": "very short titles",
    "len1": "short titles",
    "len2": "medium titles",
    "len3": "longer titles",
    "len4": "long titles",
    "len5": "very long titles",
    "len6": "extremely long titles",
}
STEM = "^(.{4,}?)(?:ing|ers|er|ed|es|s)$"
YEAR = "(?<![A-Za-z0-9_])(19|20)[0-9]{2}(?![A-Za-z0-9_])"
DELETED = "’‘'`"
EDGES = ".-&/"
#: What is not kept, one by one: single characters are looked up in a table, ranges are tried one after another.
OTHER = "[^abcdefghijklmnopqrstuvwxyz0123456789+#.&/ \\t\\n\\x0B\\f\\r-]"


@lru_cache(1)
def fold_pairs() -> tuple[str, str]:
    """Characters of the basic plane whose compatibility decomposition, without marks, is one ASCII character."""
    source, target = [], []
    for code in range(128, 0x10000):
        c = chr(code)
        plain = "".join(x for x in unicodedata.normalize("NFKD", c.lower()) if not 0x300 <= ord(x) <= 0x36F)
        if len(plain) == 1 and plain < "\x80" and plain.isalnum() and c == c.lower():
            source.append(c)
            target.append(plain)
    return "".join(source), "".join(target)


@lru_cache(1)
def fold_table() -> str:
    """What each character under 0x20000 becomes, in order, between separators: its compatibility decomposition without
    marks and apostrophes, what is not kept a space."""
    keep, out = set("abcdefghijklmnopqrstuvwxyz0123456789+#.&/- \t\n\x0b\f\r"), []
    for code in range(0x20000):
        c = chr(code) if not 0xD800 <= code < 0xE000 else " "
        plain = (x for x in unicodedata.normalize("NFKD", c) if not 0x300 <= ord(x) <= 0x36F and x not in DELETED)
        out.append("".join(x if x in keep else " " for x in plain))
    return "\x01".join(out)


def fold_text(c: Column, exact_unicode: bool = True) -> Column:
    """Lower case, decomposed, marks off, apostrophes deleted, everything but ``a-z 0-9 + # . - & /`` a space. Characters
    outside ASCII are looked up by their number; texts without any take the short way. Not ``exact_unicode`` maps those
    alone that decompose to one ASCII character."""
    if not exact_unicode:
        source, target = fold_pairs()
        short = F.translate(F.regexp_replace(F.lower(c), "[\\u0300-\\u036F]", ""), source, target)
        return F.regexp_replace(F.translate(short, DELETED, ""), OTHER, " ")
    table = F.split(F.lit(fold_table()), "\x01")
    one = lambda x: F.when(F.ascii(x) < 128, x).otherwise(F.coalesce(F.get(table, F.ascii(x)), F.lit(" ")))

    def plain(lower: Column) -> Column:
        # runs of ASCII stay together; what was looked up takes the last step with them
        pieces = F.regexp_extract_all(lower, F.lit("[\\x00-\\x7F]+|[^\\x00-\\x7F]"), F.lit(0))
        return F.when(lower.rlike("[^\\x00-\\x7F]"), F.array_join(F.transform(pieces, one), "")).otherwise(lower)

    # in a list of one, so that the text is made once however often it is named
    whole = F.transform(F.array(F.lower(c)), plain)[0]
    return F.regexp_replace(F.translate(whole, DELETED, ""), OTHER, " ")


def tokenize(c: Column, exact_unicode: bool = True) -> Column:
    """Tokens of a title in order; an empty array for null."""
    parts = F.split(F.coalesce(fold_text(c, exact_unicode), F.lit("")), "\\s+")
    trimmed = F.transform(parts, lambda w: F.btrim(w, F.lit(EDGES)))
    return F.filter(trimmed, lambda w: (w != "") & (F.length(w) < 30))


def stem(c: Column) -> Column:
    """Cut the first of -ing -ers -er -ed -es -s that leaves four letters or more."""
    ends = F.endswith(c, F.lit("s")) | F.endswith(c, F.lit("ing")) | F.endswith(c, F.lit("er")) | F.endswith(c, F.lit("ed"))
    return F.when(ends, F.regexp_replace(c, STEM, "$1")).otherwise(c)


def drop_stopwords(tokens: Column) -> Column:
    return F.filter(tokens, lambda w: ~w.isin(*STOP))


def has_year(c: Column) -> Column:
    return F.coalesce(c.rlike(YEAR), F.lit(False))


def domain_of(url: Column) -> Column:
    """Lower-cased host without a leading ``www.``; null when there is none."""
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    return F.nullif(F.regexp_replace(host, "^www\\.", ""), F.lit(""))


def search_literal(c: Column, text: str) -> Column:
    """Case-insensitive literal substring; pattern characters mean themselves."""
    return F.contains(F.lower(c), F.lit(text.lower()))


def describe_feature(name: Column) -> Column:
    """Struct (kind, label) of a feature name."""
    at = F.instr(name, ":")
    kind = F.when(at > 0, F.substring_index(name, ":", 1)).otherwise(name)
    body = F.when(at > 0, name.substr(at + 1, F.length(name))).otherwise("")
    style = F.create_map(*(F.lit(x) for pair in STYLE_LABELS.items() for x in pair))
    kinds = (
        F.when(kind == "__bias__", "baseline").when(kind == "w", "word").when(kind == "b", "phrase")
        .when(kind.isin("dom", "tld"), "site").when(kind == "by", "author").when(kind == "t", "style").otherwise(kind)
    )
    label = (
        F.when(kind == "__bias__", "baseline")
        .when(kind.isin("w", "dom"), body)
        .when(kind == "b", F.translate(body, "_", " "))
        .when(kind == "tld", F.concat(F.lit("."), body))
        .when(kind == "by", F.concat(F.lit("@"), body))
        .when(kind == "t", F.coalesce(F.try_element_at(style, body), body))
        .when(body == "", name)
        .otherwise(body)
    )
    return F.struct(kinds.alias("kind"), label.alias("label"))
