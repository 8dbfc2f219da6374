"""Fill-in-the-middle by counted quantifiers.

A text is a run of units: words of ASCII letters, and every other character alone. A count of its units and two keyed
draws say where the middle begins (unit a) and ends (unit b). A pattern made for the row, with the possessive groups
unit{a} and unit{b-a}, then takes prefix, middle and suffix apart in one match, whose replacement is the output itself.
Possessive groups never give a unit back, so a match takes one pass and no stack, whatever the counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palate.llm.common import let

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Percent of texts that stay plain, and of the others that begin with their suffix.
PLAIN, SUFFIX_FIRST = 10, 20
_UNIT = "(?:[A-Za-z]++|[^A-Za-z])"


def draws(key: Column) -> list[Column]:
    """Four numbers of 32 bits from the SHA-256 of ``key``."""
    digest = F.sha2(key, 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", epoch: int = 1) -> DataFrame:
    """One row a row of ``docs``: (doc_id, text, n, form, output, prefix_chars, middle_chars).

    ``n`` counts units. ``form`` is plain (the output is the text), psm (``<P>`` prefix ``<S>`` suffix ``<M>`` middle) or spm
    (``<S>`` suffix ``<P>`` prefix ``<M>`` middle); the lengths are in characters and null if plain. The draws depend on
    ``epoch`` and the id alone, so a row that is computed again gives the same output and each epoch another one.

    Null texts are empty ones, and empty texts stay plain, as do those that hold a marker. Null ids draw as an empty id,
    rows that repeat an id draw alike, other columns are not read, and an empty table gives an empty table. Texts of
    any length are read whole; the count holds a text's units in memory meanwhile.
    """
    h = draws(F.concat(F.lit(f"{epoch}:"), F.coalesce(docs[id_col].cast("string"), F.lit(""))))
    rows = docs.select(
        docs[id_col].alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"), *(x.alias(f"h{i}") for i, x in enumerate(h, 1))
    )
    text = F.col("text")
    rows = rows.withColumn("n", F.regexp_count("text", F.lit("[A-Za-z]+|[^A-Za-z]")).cast("long"))
    cuts = [F.col(x) % (F.col("n") + 1) for x in ("h1", "h2")]
    marked = text.contains(PREFIX) | text.contains(SUFFIX) | text.contains(MIDDLE)
    plain = (text == "") | marked | (F.col("h3") % 100 >= 100 - PLAIN)
    form = F.when(plain, "plain").when(F.col("h4") % 100 < SUFFIX_FIRST, "spm").otherwise("psm")
    rows = rows.select("doc_id", "text", "n", F.least(*cuts).alias("a"), F.greatest(*cuts).alias("b"), form.alias("form"))
    groups = [F.concat(F.lit(f"({_UNIT}{{"), c.cast("string"), F.lit("}+)")) for c in (F.col("a"), F.col("b") - F.col("a"))]
    pattern = F.concat(F.lit("(?s)\\A"), *groups, F.lit("(.*)\\z"))
    psm, spm = f"{PREFIX}$1{SUFFIX}$3{MIDDLE}$2", f"{SUFFIX}$3{PREFIX}$1{MIDDLE}$2"
    filled = F.regexp_replace(text, pattern, F.when(F.col("form") == "psm", psm).otherwise(spm))
    rows = rows.withColumn("output", F.when(F.col("form") == "plain", text).otherwise(filled))
    # no marker stands in the text, nor can one arise where text and marker meet
    middle = F.char_length("output") - F.locate(MIDDLE, "output") - len(MIDDLE) + 1
    end = F.when(F.col("form") == "psm", F.locate(SUFFIX, "output")).otherwise(F.locate(MIDDLE, "output"))
    begin = F.when(F.col("form") == "psm", 1).otherwise(F.locate(PREFIX, "output")) + len(PREFIX)
    filled_in = F.col("form") != "plain"
    return rows.select(
        "doc_id", "text", "n", "form", "output",
        F.when(filled_in, (end - begin).cast("long")).alias("prefix_chars"), F.when(filled_in, middle.cast("long")).alias("middle_chars"),
    )


def restore(output: Column, form: Column) -> Column:
    """The text behind an output: its three parts put back in order."""

    def ordered(parts: Column) -> Column:
        first, second, third = (F.element_at(parts, i) for i in (2, 3, 4))
        return F.when(form == "psm", F.concat(first, third, second)).otherwise(F.concat(second, third, first))

    return F.when(form == "plain", output).otherwise(let(F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}"), ordered))
