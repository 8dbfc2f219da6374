"""SQL forms of the derived tables, for the engine's oracles."""

from __future__ import annotations

import re
import unicodedata

from palate.functions.text import DELETED, STOP, fold_pairs
from palate.plans.fixtures import AS_OF


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


STOPS = "(" + ", ".join(map(q, STOP)) + ")"

COUNTS = """
cnt AS (SELECT (SELECT count(*) FROM documents) AS nd, (SELECT count(*) FROM pages) AS np, (SELECT count(*) FROM events) AS ne),
ev AS (SELECT event_id, user_id, event_type, CAST(floor(epoch(ts)) AS BIGINT) AS ts, value,
       CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"""


def domain_sql(url: str) -> str:
    host = f"regexp_extract({url}, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)"
    return f"nullif(regexp_replace(lower({host}), '^www\\.', ''), '')"


def day_sql(seconds: str) -> str:
    return f"strftime(DATE '1970-01-01' + CAST(floor({seconds} / 86400.0) AS INTEGER), '%Y-%m-%d')"


ITEMS = f"""{COUNTS},
sums AS (SELECT event_id % (SELECT nd FROM cnt) AS doc_id, CAST(floor(sum(CAST(value AS DECIMAL(18,6))) / 12) AS BIGINT) AS points,
         CAST(floor(sum(k) / 24) AS BIGINT) AS num_comments FROM ev GROUP BY 1),
items AS (SELECT d.doc_id + 1 AS story_id, trim(string_split(d.text, chr(10))[1]) AS title, p.url,
          {domain_sql("p.url")} AS domain, d.source AS author, coalesce(s.points, 0) AS points,
          coalesce(s.num_comments, 0) AS num_comments, e.ts AS created_at, {day_sql("e.ts")} AS day
          FROM documents d CROSS JOIN cnt JOIN ev e ON e.event_id = d.doc_id * (cnt.ne // cnt.nd)
          LEFT JOIN sums s ON s.doc_id = d.doc_id
          LEFT JOIN pages p ON p.page_id = d.doc_id % cnt.np AND d.doc_id % 7 <> 0)"""


def events_sql(tombstones: bool = False) -> str:
    value = """CASE WHEN e.event_type = 'signup' THEN 0 ELSE
        CASE WHEN d.lang = ['en', 'fr', 'de', 'es'][e.user_id % 4 + 1] THEN 1 ELSE -1 END
        * CASE WHEN e.event_type = 'error' THEN -1 ELSE 1 END END"""
    if tombstones:
        value = f"CASE WHEN e.event_id % 97 <> 0 THEN {value} END"
    return f"""
vev AS (SELECT e.user_id, d.doc_id + 1 AS story_id, {value} AS value, e.ts, e.event_id
        FROM ev e CROSS JOIN cnt JOIN documents d ON d.doc_id = e.event_id * 7 % cnt.nd),
gone AS (SELECT user_id, story_id, max((ts, event_id)) AS g FROM vev WHERE value IS NULL GROUP BY 1, 2),
votes AS (SELECT v.user_id, v.story_id, arg_max(value, (ts, event_id)) AS value, min(ts) AS created_at, max(ts) AS updated_at
          FROM vev v LEFT JOIN gone g ON g.user_id = v.user_id AND g.story_id = v.story_id
          WHERE value IS NOT NULL AND (g.g IS NULL OR (ts, event_id) > g.g) GROUP BY 1, 2)"""


VOTES = f"{COUNTS},{events_sql()}"
BOTH = f"{ITEMS},{events_sql()}"


def fold_sql(c: str) -> str:
    source, target = fold_pairs()
    out = f"regexp_replace(lower({c}), '[\\x{{0300}}-\\x{{036F}}]', '', 'g')"
    out = f"translate(translate({out}, {q(source)}, {q(target)}), {q(DELETED)}, '')"
    return f"regexp_replace({out}, '[^a-z0-9+#.&/\\s-]', ' ', 'g')"


#: Characters that decompose to several, to none, or to what is kept: ligatures, fractions, units, marks, squared words.
EXOTIC = "ﬁ ﬄ ½ ⅞ ㎏ ㏂ № ℡ Ǆ ŉ é é ｆｕｌｌ … ‥ ª ² ﷲ 한국 ㊀ ⒈ ⑽ ´ ¨ ‘q’ ｀ Å ß ﬆ ĳ 🄀 𝐀𝟗"


def exact_fold_sql(c: str) -> str:
    """Folding from the character database alone: a value for each character that does not become one space."""
    values = {}
    for code in [*range(128, 0xAC00), *range(0xD7A4, 0xD800), *range(0xE000, 0x20000)]:
        plain = "".join(x for x in unicodedata.normalize("NFKD", chr(code)) if not 0x300 <= ord(x) <= 0x36F and x not in DELETED)
        out = re.sub(r"[^a-z0-9+#.&/\s-]", " ", plain, flags=re.A)
        if out != " ":
            values[code] = out
    table = "MAP {" + ", ".join(f"{k}: {q(v)}" for k, v in values.items()) + "}"
    hangul = "CASE WHEN (ord(x) - 44032) % 28 = 0 THEN '  ' ELSE '   ' END"  # two or three letters a syllable
    plain = "CASE WHEN regexp_matches(x, '[a-z0-9+#.&/\\s-]') THEN x WHEN ord(x) IN (39, 96) THEN '' ELSE ' ' END"
    one = f"CASE WHEN ord(x) < 128 THEN {plain} WHEN ord(x) BETWEEN 44032 AND 55203 THEN {hangul} ELSE coalesce({table}[ord(x)], ' ') END"
    return f"array_to_string(list_transform(regexp_extract_all(lower({c}), '(?s).'), lambda x: {one}), '')"


def tokens_sql(c: str) -> str:
    parts = f"regexp_split_to_array({fold_sql(c)}, '\\s+')"
    return f"list_filter(list_transform({parts}, lambda w: trim(w, '.-&/')), lambda w: w <> '' AND length(w) < 30)"


def stem_sql(w: str) -> str:
    return f"regexp_replace({w}, '^(.{{4,}}?)(?:ing|ers|er|ed|es|s)$', '\\1')"


TOKENS = f"""
tok AS (SELECT story_id, title, domain, author, {tokens_sql("title")} AS raw FROM items),
kept AS (SELECT *, list_transform(list_filter(raw, lambda w: w NOT IN {STOPS}), lambda w: {stem_sql("w")}) AS kept FROM tok),
word AS (SELECT story_id, unnest(kept) AS w, unnest(range(0, len(kept))) AS i FROM kept),
part AS (SELECT story_id, w, i, unnest(p) AS p, unnest(range(0, len(p))) AS j FROM (
         SELECT *, list_filter(regexp_split_to_array(w, '[-.]'), lambda x: length(x) > 1 AND x <> w AND x NOT IN {STOPS}) AS p FROM word))"""

FEATURES = f"""{TOKENS},
style AS (SELECT story_id, unnest([
    CASE WHEN rtrim(title) LIKE '%?' THEN 't:question' END, CASE WHEN starts_with(lower(title), 'show hn') THEN 't:showhn' END,
    CASE WHEN starts_with(lower(title), 'ask hn') THEN 't:askhn' END, CASE WHEN starts_with(lower(title), 'tell hn') THEN 't:tellhn' END,
    CASE WHEN regexp_matches(title, '\\b(19|20)[0-9]{{2}}\\b') THEN 't:has_year' END,
    CASE WHEN regexp_matches(title, '[0-9]') THEN 't:has_number' END,
    CASE WHEN regexp_matches(lower(title), '^(how|why|what|when|the case for|i )') THEN 't:narrative' END]) AS f,
    unnest(range(0, 7)) AS i FROM kept),
dom AS (SELECT story_id, domain, string_split(domain, '.') AS l FROM kept WHERE domain IS NOT NULL),
site AS (SELECT *, array_to_string(l[len(l) - CASE WHEN len(l) > 3 THEN 2 ELSE 1 END:], '.') AS s FROM dom),
fall AS (
    SELECT story_id, '__bias__' AS feature, 1.0::DOUBLE AS value, 0 AS pos FROM kept
    UNION ALL SELECT story_id, 'w:' || w, 1.0, 1000000000000000 + i * 100 FROM word
    UNION ALL SELECT story_id, 'w:' || {stem_sql("p")}, 0.5, 1000000000000001 + i * 100 + j FROM part
    UNION ALL SELECT a.story_id, 'b:' || a.w || '_' || b.w, 0.7, 2000000000000000 + a.i FROM word a JOIN word b ON b.story_id = a.story_id AND b.i = a.i + 1
    UNION ALL SELECT story_id, f, 0.6, 3000000000000000 + i FROM style WHERE f IS NOT NULL
    UNION ALL SELECT story_id, 't:len' || CAST(least(len(raw) // 3, 6) AS VARCHAR), 0.3, 4000000000000000 FROM kept
    UNION ALL SELECT story_id, 'dom:' || domain, 1.0, 5000000000000000 FROM dom
    UNION ALL SELECT story_id, 'dom:' || s, 0.5, 5000000000000001 FROM site WHERE len(l) > 2 AND s <> domain
    UNION ALL SELECT story_id, 'tld:' || l[len(l)], 0.3, 5000000000000002 FROM dom
    UNION ALL SELECT story_id, 't:selfpost', 1.0, 5000000000000000 FROM kept WHERE domain IS NULL
    UNION ALL SELECT story_id, 'by:' || lower(author), 0.6, 6000000000000000 FROM kept WHERE author IS NOT NULL),
features AS (SELECT story_id, feature, round(sum(value), 6) AS value, min(pos) AS pos FROM fall GROUP BY 1, 2)"""

EXAMPLES = """
examples AS (SELECT user_id, v.story_id, CASE WHEN value > 0 THEN 1 ELSE 0 END AS label,
             row_number() OVER (PARTITION BY user_id ORDER BY v.created_at, v.story_id DESC) - 1 AS ord
             FROM votes v JOIN items i ON i.story_id = v.story_id WHERE value <> 0),
gate AS (SELECT user_id, count(*) FILTER (value > 0) AS up, count(*) FILTER (value < 0) AS down FROM votes GROUP BY 1)"""


def weights_sql(name: str = "weights", drop: int = 0) -> str:
    return f"""
{name} AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY feature) - 1 AS idx FROM (
    SELECT user_id, feature, round(ln((count(*) FILTER (label = 1) + 1.0) / (count(*) FILTER (label = 0) + 1.0)), 6) AS weight,
    count(*) AS support FROM examples JOIN features USING (story_id) WHERE ord >= {drop} GROUP BY 1, 2))"""


RUNS = f"""
runs AS (SELECT e.user_id, count(*) AS n_votes, count(*) FILTER (label = 1) AS n_pos, count(*) FILTER (label = 0) AS n_neg,
         2 AS rev, {AS_OF - 86_400 * 3} AS trained_at
         FROM examples e JOIN gate g ON g.user_id = e.user_id AND up + down >= 6 AND up >= 1 AND down >= 1 GROUP BY 1)"""

CONTENT = "feature <> '__bias__' AND NOT starts_with(feature, 't:')"

SCORES = f"""
mass AS (SELECT story_id, round(coalesce(sum(value) FILTER ({CONTENT}), 0), 6) AS mass FROM features GROUP BY 1),
zs AS (SELECT w.user_id, f.story_id, round(sum(f.value * w.weight), 9) AS z, round(coalesce(sum(f.value) FILTER ({CONTENT.replace("feature", "f.feature")}), 0), 6) AS known
       FROM features f JOIN weights w ON w.feature = f.feature GROUP BY 1, 2),
parts AS (SELECT r.user_id, m.story_id, r.rev, coalesce(z, 0) AS z, CASE WHEN mass > 0 THEN coalesce(known, 0) / mass ELSE 0 END AS coverage,
          least(n_votes / 40.0::DOUBLE, 1) * least(least(n_pos, n_neg) / 8.0::DOUBLE, 1) AS sure
          FROM runs r CROSS JOIN mass m LEFT JOIN zs ON zs.user_id = r.user_id AND zs.story_id = m.story_id),
shrunk AS (SELECT *, 1 / (1 + exp(-z)) AS raw, least(greatest(sure * (0.3::DOUBLE + 0.7::DOUBLE * coverage), 0), 1) AS conf FROM parts),
scores AS (SELECT user_id, story_id, round(0.5::DOUBLE + (raw - 0.5::DOUBLE) * (0.3::DOUBLE + 0.7::DOUBLE * conf), 9) AS score,
           round(conf, 9) AS confidence, rev AS model_rev FROM shrunk)"""

MODEL = f"{BOTH},{FEATURES},{EXAMPLES},{weights_sql()},{RUNS}"
SCORED = f"{MODEL},{SCORES}"

HISTORY = f"""
pairs AS (SELECT DISTINCT user_id, story_id FROM votes),
history AS (SELECT user_id, story_id, ((user_id * 37 + story_id * 101) % 1000) / 1000.0::DOUBLE AS score, 0.5::DOUBLE AS confidence,
            1 AS model_rev, {AS_OF - 20 * 86_400} AS scored_at FROM pairs
            UNION ALL SELECT user_id, story_id, ((user_id * 53 + story_id * 211) % 1000) / 1000.0::DOUBLE, 0.75, 2, {AS_OF - 10 * 86_400}
            FROM pairs WHERE story_id % 3 <> 0)"""

RUN_LOG = f"""
run_log AS (SELECT user_id, rev, {AS_OF} - (6 - rev) * 86400 * 4 AS trained_at, 40 + ((rev + user_id % 2) // 2) * 5 AS n_votes,
            CASE WHEN (user_id + rev) % 5 <> 0 THEN 0.5::DOUBLE + ((user_id * 7 + rev * 13) % 40) / 100.0::DOUBLE END AS accuracy,
            0.5::DOUBLE + (user_id % 10) / 100.0::DOUBLE AS baseline, 0.5::DOUBLE + ((user_id * 11 + rev * 17) % 50) / 100.0::DOUBLE AS auc,
            0.02::DOUBLE + ((user_id + rev) % 5) / 100.0::DOUBLE AS noise
            FROM (SELECT DISTINCT user_id FROM votes) CROSS JOIN (SELECT unnest(range(1, 7)) AS rev))"""


def label_sql(f: str = "feature") -> str:
    from palate.functions.text import STYLE_LABELS

    body = f"substring({f}, instr({f}, ':') + 1)"
    styles = " ".join(f"WHEN {body} = {q(k)} THEN {q(v)}" for k, v in STYLE_LABELS.items())
    return f"""CASE WHEN {f} = '__bias__' THEN 'baseline' WHEN {f} LIKE 'w:%' OR {f} LIKE 'dom:%' THEN {body}
        WHEN {f} LIKE 'b:%' THEN replace({body}, '_', ' ') WHEN {f} LIKE 'tld:%' THEN '.' || {body}
        WHEN {f} LIKE 'by:%' THEN '@' || {body} ELSE CASE {styles} ELSE {body} END END"""


def kind_sql(f: str = "feature") -> str:
    return f"""CASE WHEN {f} = '__bias__' THEN 'baseline' WHEN {f} LIKE 'w:%' THEN 'word' WHEN {f} LIKE 'b:%' THEN 'phrase'
        WHEN {f} LIKE 'dom:%' OR {f} LIKE 'tld:%' THEN 'site' WHEN {f} LIKE 'by:%' THEN 'author' ELSE 'style' END"""
