"""URL filters: pattern rules found through their rarest literal token, in built-in Spark functions only.

A rule is a pattern over ``host`` followed by ``path`` and query, in the usual notation of filter lists: ``||`` anchors
at a label of the host, ``|`` at either end, ``*`` stands for anything and ``^`` for a separator or the end. Literal
tokens are the runs of letters and digits that a URL with a match must contain whole. Each rule is indexed by the
token that the fewest URLs contain; a URL's tokens fetch candidate rules, and only those run their regular expressions.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKEN = "[^0-9a-z]+"
#: A broadcast of the rule index is asked for up to this many rules; beyond, the join shuffles.
BROADCAST_RULES = 50_000


@dataclass(frozen=True)
class Rule:
    """``name`` is reported; the largest ``rank`` of a URL's matching rules wins, then the smaller name."""

    name: str
    pattern: str
    verdict: str
    rank: int


def prefix_rule(name: str, verdict: str) -> Rule:
    """A host with its subdomains and a path prefix, like ``example.net/en/``; the longest such rule wins."""
    return Rule(name, "||" + name, verdict, 1_000_000 + len(name))


#: The base rules.
BASE_RULES = (
    prefix_rule("net/", "block"),
    prefix_rule("example.net/en/", "allow"),
    prefix_rule("example.com/de/", "block"),
    prefix_rule("org/fr/", "allow"),
)

#: Rules of the method's own, for URLs that no base rule fits.
OWN_RULES = tuple(
    Rule(p, p, v, len(p))
    for p, v in (
        ("||spam-farm.", "block"),
        ("||casino", "block"),
        ("||ads.", "block"),
        ("||adserver.", "block"),
        ("||doubleclick.net^", "block"),
        ("/wp-login.php", "block"),
        ("/wp-admin/", "block"),
        ("/cgi-bin/", "block"),
        ("/xmlrpc.php", "block"),
        ("^phpsessid=", "block"),
        ("^sessionid=", "block"),
        ("/login^", "block"),
        ("/signup^", "block"),
        ("/cart^", "block"),
        ("/checkout^", "block"),
        ("/search?q=", "block"),
        (".jpg|", "block"),
        (".jpeg|", "block"),
        (".png|", "block"),
        (".gif|", "block"),
        (".css|", "block"),
        (".js|", "block"),
        (".zip|", "block"),
        (".exe|", "block"),
        (".mp4|", "block"),
        ("||wikipedia.org/wiki/", "allow"),
        ("/robots.txt|", "allow"),
    )
)


def to_regex(pattern: str) -> str:
    """Java regular expression of a pattern, to be searched in host + path + query."""
    out, body = "(?s)", pattern
    if body.startswith("||"):
        out, body = out + "^(?:[^/?#]*\\.)?", body[2:]
    elif body.startswith("|"):
        out, body = out + "^", body[1:]
    end = body.endswith("|")
    for c in body[:-1] if end else body:
        out += ".*" if c == "*" else "(?:[^0-9A-Za-z_.%-]|$)" if c == "^" else c if c.isalnum() else "\\" + c
    return out + "\\z" * end


def tokens_of(pattern: str) -> list[str]:
    """Runs of letters and digits that stand whole in any URL with a match: neither end of a run is open."""
    head = re.match(r"\|{0,2}", pattern)[0]
    body = pattern[len(head) :]
    shut = body.endswith("|")
    body = body[:-1] if shut else body
    out = []
    for m in re.finditer("[0-9A-Za-z]+", body):
        left = m.start() > 0 and body[m.start() - 1] != "*" or m.start() == 0 and head != ""
        right = m.end() < len(body) and body[m.end()] != "*" or m.end() == len(body) and shut
        if left and right:
            out.append(m[0].lower())
    return sorted(set(out))


def split_url(url: Column) -> Column:
    """Struct (host, path, rest): host lower-cased (A-Z), path up to ``?``, ``#`` or the end, rest the query.
    Null or without ``://``: all empty."""
    whole = F.coalesce(url, F.lit(""))
    after = F.when(whole.contains("://"), F.regexp_extract(whole, "(?s)^.*?://(.*)\\z", 1)).otherwise("")
    host = F.translate(
        F.regexp_extract(after, "(?s)^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    )
    path = F.regexp_extract(after, "(?s)^[^/?#]*([^?#]*)", 1)
    rest = F.regexp_extract(after, "(?s)^[^/?#]*[^?#]*(\\?[^#]*)?", 1)
    return F.struct(host.alias("host"), path.alias("path"), rest.alias("rest"))


def url_tokens(text: Column) -> Column:
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_distinct(F.split(lower, TOKEN))


def rule_table(spark: SparkSession, rules: tuple[Rule, ...]) -> DataFrame:
    rows = [(r.name, r.verdict, r.rank, to_regex(r.pattern), tokens_of(r.pattern)) for r in rules]
    kinds = [("rule", T.StringType()), ("rule_verdict", T.StringType()), ("rank", T.IntegerType()), ("regex", T.StringType())]
    schema = T.StructType([*(T.StructField(n, t) for n, t in kinds), T.StructField("tokens", T.ArrayType(T.StringType()))])
    return spark.createDataFrame(rows, schema)


def index(rules: DataFrame, urls: DataFrame) -> DataFrame:
    """``rules`` with the ``token`` they are found by: of their literal tokens the one in the fewest of ``urls``
    (column ``tokens``), ties by the token. A rule without a literal token gets the empty one, which every URL has."""
    wanted = rules.select(F.explode("tokens").alias("token")).distinct()
    seen = urls.select(F.explode("tokens").alias("token"))
    seen = seen.join(_small(wanted, rules), "token").groupBy("token").agg(F.count("*").alias("n"))
    spread = rules.select("rule", "regex", F.explode("tokens").alias("token")).join(seen, "token", "left")
    best = spread.groupBy("rule", "regex").agg(F.min(F.struct(F.coalesce("n", F.lit(0)), "token")).alias("b"))
    return rules.drop("tokens").join(best.select("rule", "regex", F.col("b.token").alias("token")), ["rule", "regex"], "left").na.fill(
        "", ["token"]
    )


def _small(df: DataFrame, rules: DataFrame) -> DataFrame:
    return F.broadcast(df) if rules.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES else df


def judge(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with ``__url`` (host, path, rest), ``__rule`` and ``__verdict``: the winning rule's name and
    verdict, or null and ``default``.

    A verdict follows from the URL alone, so each distinct URL is judged once and matches join back by URL: a URL
    that a third of all pages share costs one judgement, and its pages split over tasks. Null URLs and URLs without
    ``://`` are empty and match nothing but patterns that match the empty text. Repeated rows come back as often as
    they stand. An empty table gives an empty table.
    """
    out = pages.withColumn("__url", split_url(pages[url_col]))
    text = F.concat("__url.host", "__url.path", "__url.rest")
    out = out.withColumn("__text", text)
    urls = out.select("__text").distinct().withColumn("tokens", F.array_distinct(F.concat(url_tokens(F.col("__text")), F.array(F.lit("")))))
    found = index(rules, urls)
    hits = (
        urls.select("__text", F.explode("tokens").alias("token"))
        .join(_small(found, rules), "token")
        .where(F.expr("__text RLIKE regex"))
        .groupBy("__text")
        .agg(F.min(F.struct((-F.col("rank")).alias("r"), "rule", "rule_verdict")).alias("w"))
        .select(F.col("__text").alias("__t"), F.col("w.rule").alias("__rule"), F.col("w.rule_verdict").alias("__verdict"))
    )
    judged = out.join(hits, F.col("__text") == F.col("__t"), "left")
    return judged.withColumn("__verdict", F.coalesce("__verdict", F.lit(default))).drop("__text", "__t")
