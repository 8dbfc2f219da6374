"""The opN_ queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palate.llm import count_tree, decontaminate, fim, licenses, near_dup, packing, pii, prefix_trie, quality, sstable, substring_dedup, url_filter, warc
from palate.llm.common import shared_path

BYTE_TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License labels of all documents."""
    return licenses.scan(table(spark, sf_dir, "documents")).drop("spans")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base statistics, the fixed floor and the verdict of the list learned from the labels."""
    docs = table(spark, sf_dir, "documents")
    rules = quality.learn(quality.training_rows(docs, table(spark, sf_dir, "labels")))
    s = F.col("__stats")
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return quality.judge(docs.select("doc_id", "text"), rules).select(
        "doc_id", *(s[c].alias(c) for c in counts), F.col("__base_failed").alias("base_failed"), F.col("__kept").alias("kept")
    )


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item found in it within the edit budget."""
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_minhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents."""
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op5_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a response record, its derivatives written to WARC files in the shared folder and read back."""
    path = shared_path(spark, "warc")
    warc.write(warc.derive(warc.responses_from_pages(table(spark, sf_dir, "pages"))), path)
    return warc.read(spark, path).select(
        "record_id",
        "kind",
        "target_uri",
        "date",
        "refers_to",
        F.col("headers")["WARC-Block-Digest"].alias("block_digest"),
        F.col("headers")["WARC-Source-Payload-Digest"].alias("source_payload_digest"),
        F.octet_length("block").cast("long").alias("n_bytes"),
        F.when(F.col("kind") == "conversion", F.decode("block", "UTF-8")).alias("text"),
    )


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    docs = table(spark, sf_dir, "documents")
    return packing.pack_documents(docs, WORD_TOKENIZER).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's verdict: the longest base rule's, else the method's own rules'."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    rules = url_filter.rule_table(spark, url_filter.BASE_RULES + url_filter.OWN_RULES)
    base = F.col("__rule").isin([r.name for r in url_filter.BASE_RULES])
    return url_filter.judge(pages, rules).select(
        "page_id",
        F.col("__url.host").alias("host"),
        F.col("__url.path").alias("path"),
        F.when(base, F.col("__rule")).alias("rule"),
        F.col("__verdict").alias("verdict"),
    )


def op8_token_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents, written to shards and read back."""
    return sstable.round_trip(table(spark, sf_dir, "documents"), BYTE_TOKENIZER)


def op9_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with valid personal values replaced."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymise(docs)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that repeat, over all documents."""
    return substring_dedup.repeated_passages(table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the trie of all rebuilt conversations."""
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's output and of the text that comes back from it."""
    out = fim.transform(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2(fim.restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


def op13_count_tree_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents under a similarity of 0.8."""
    return count_tree.similar_sets(table(spark, sf_dir, "documents"))


def queries() -> dict:
    own = (
        op1_license_scan,
        op2_quality_rules,
        op3_benchmark_decontamination,
        op4_minhash_near_dup,
        op5_warc_derivatives,
        op6_best_fit_packing,
        op7_url_filter,
        op8_token_sstable,
        op9_pii_pseudonyms,
        op10_substring_dedup,
        op11_prefix_trie,
        op12_fill_in_middle,
        op13_count_tree_join,
    )
    return {f.__name__: f for f in own}


def op7_sql() -> str:
    """The same verdicts without tokens or an index: every rule's regular expression on every page."""

    def text(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    def regex(r: url_filter.Rule) -> str:
        return text(url_filter.to_regex(r.pattern))

    ordered = sorted(url_filter.BASE_RULES + url_filter.OWN_RULES, key=lambda r: (-r.rank, r.name))
    verdict = " ".join(f"WHEN regexp_matches(t, {regex(r)}) THEN {text(r.verdict)}" for r in ordered)
    base = sorted(url_filter.BASE_RULES, key=lambda r: (-r.rank, r.name))
    rule = " ".join(f"WHEN regexp_matches(t, {regex(r)}) THEN {text(r.name)}" for r in base)
    a, z = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'", "'abcdefghijklmnopqrstuvwxyz'"
    return f"""
        WITH a AS (SELECT page_id, CASE WHEN contains(url, '://') THEN regexp_extract(url, '(?s)^.*?://(.*)$', 1)
                   ELSE '' END AS r FROM pages),
        b AS (SELECT page_id, translate(regexp_extract(r, '^[^/?#]*', 0), {a}, {z}) AS host,
              regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path,
              regexp_extract(r, '^[^/?#]*[^?#]*(\\?[^#]*)?', 1) AS rest FROM a),
        c AS (SELECT *, host || path || rest AS t FROM b)
        SELECT page_id, host, path, CASE {rule} END AS rule, CASE {verdict} ELSE 'allow' END AS verdict FROM c"""


def op11_sql() -> str:
    """Prefixes as lists of turn numbers; a node's sums over all its prefixes' prefixes."""
    bits = "list_transform(range(0, 8 * length(s)), lambda j: (ascii(substr(s, (j // 8 + 1)::INT, 1)) >> (j % 8)::INT) & 1)"
    crc = f"list_reduce(list_concat([4294967295], {bits}), lambda c, b: xor(c >> 1, CASE WHEN xor(c, b) & 1 = 1 THEN 3988292384 ELSE 0 END))"
    return f"""
        WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x, turn FROM conversations WHERE conv_id IS NOT NULL),
        o AS (SELECT c, x, dense_rank() OVER (ORDER BY r, x) AS id, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, r, x) AS i FROM t),
        n AS (SELECT c, max(i) AS n, c::VARCHAR AS s FROM o GROUP BY c),
        v AS (SELECT c, c - c % 20 AS base, n, xor({crc}, 4294967295) % 4 AS h FROM n),
        w AS (SELECT v.*, least(h, coalesce(b.n, 0)) AS kept FROM v LEFT JOIN (SELECT c AS bc, n FROM n) b ON b.bc = v.base),
        p AS (SELECT w.c, o.i AS d, o.id, o.x FROM w JOIN o ON o.c = w.base AND o.i <= w.h
              UNION ALL SELECT w.c, o.i - w.h + w.kept, o.id, o.x FROM w JOIN o ON o.c = w.c AND o.i > w.h),
        m AS (SELECT c, d, x, list(id) OVER (PARTITION BY c ORDER BY d) AS k FROM p UNION ALL SELECT c, 0, '', [] FROM w),
        l AS (SELECT c, max(d) AS last FROM m GROUP BY c),
        g AS (SELECT k, d, min(c) AS conv_id, count(*) AS n_convs, min(len(regexp_extract_all(x, '[^\x20\x09-\x0D]+'))) AS words,
              coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE d = last), '') AS ends FROM m JOIN l USING (c) GROUP BY k, d),
        e AS (SELECT list_slice(k, 1, d - 1) AS k, count(*) AS n_children FROM g WHERE d > 0 GROUP BY ALL),
        f AS (SELECT g.*, coalesce(n_children, 0) AS n_children FROM g LEFT JOIN e USING (k)),
        u AS (SELECT list_slice(k, 1, j) AS k, sum((n_children = 0)::INT) AS n_leaves, sum((n_convs - 1) * words) AS saved
              FROM (SELECT *, unnest(range(0, d + 1)) AS j FROM f) GROUP BY ALL)
        SELECT f.conv_id, f.d AS depth, q.conv_id AS parent_conv_id, f.n_convs, f.n_children, u.n_leaves::BIGINT AS n_leaves,
            u.saved::BIGINT AS saved_tokens, sha256(f.ends) AS ends_sha256
        FROM f JOIN u USING (k) LEFT JOIN g q ON f.d > 0 AND q.k = list_slice(f.k, 1, f.d - 1)"""


def op12_sql() -> str:
    """Tokens as a list, its parts joined."""
    hexes = ", ".join(f"('0x' || substr(z, {8 * i + 1}, 8))::BIGINT AS h{i + 1}" for i in range(4))
    marked = " OR ".join(f"contains(t, '{m}')" for m in ("<P>", "<S>", "<M>"))
    part = lambda a, b: f"coalesce(array_to_string(list_slice(k, {a} + 1, {b}), ''), '')"
    return f"""
        WITH a AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS z FROM documents),
        b AS (SELECT *, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS k, {hexes} FROM a),
        c AS (SELECT *, len(k) AS n, least(h1 % (len(k) + 1), h2 % (len(k) + 1)) AS x, greatest(h1 % (len(k) + 1), h2 % (len(k) + 1)) AS y,
              CASE WHEN t = '' OR {marked} OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM b),
        d AS (SELECT *, {part("0", "x")} AS p, {part("x", "y")} AS m, {part("y", "n")} AS s FROM c)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
            CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
            sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
            sha256(t) AS restored_sha256 FROM d"""


def op13_sql() -> str:
    """All shared shingles counted, no cells and no bounds."""
    return r"""
        WITH RECURSIVE a AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
            'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, md5(array_to_string(list_slice(w, i, i + 4), ' ')) AS s
              FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, least(len(w), 1) + 1))) AS i FROM a)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        b AS (SELECT x.doc_id AS p, y.doc_id AS q, count(*) AS c FROM s x JOIN s y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
        l AS (SELECT p, q FROM b JOIN n x ON x.doc_id = p JOIN n y ON y.doc_id = q WHERE 100 * c >= 80 * (x.n + y.n - c)),
        e AS (SELECT p, q FROM l UNION ALL SELECT q, p FROM l),
        r AS (SELECT doc_id AS i, doc_id AS j FROM documents UNION SELECT r.i, e.q FROM r JOIN e ON r.j = e.p)
        SELECT doc_id, coalesce(n, 0) AS n_shingles, m AS component_id
        FROM documents LEFT JOIN n USING (doc_id) JOIN (SELECT i, min(j) AS m FROM r GROUP BY i) ON i = doc_id"""


def oracle_sql() -> dict[str, str]:
    return {"op7_url_filter": op7_sql(), "op11_prefix_trie": op11_sql(), "op12_fill_in_middle": op12_sql(), "op13_count_tree_join": op13_sql()}
