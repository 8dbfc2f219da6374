"""Prefix trie, fill-in-the-middle and the count-tree join against brute force, SQL and edge cases."""

import collections
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from palate.llm import common, count_tree, fim, prefix_trie, queries

WORDS = [f"w{i}" for i in range(400)]


def brute_trie(rows):
    own = collections.defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append(((t is not None, t or 0), r or "", x or ""))
    own = {c: [(r, x) for _, r, x in sorted(v)] for c, v in own.items()}
    rebuilt = {}
    for c, v in own.items():
        h, base = zlib.crc32(str(c).encode()) % 4, c - (abs(c) % 20) * (1 if c >= 0 else -1)
        rebuilt[c] = tuple(own.get(base, [])[:h] + v[h:])
    members = collections.defaultdict(list)
    for c, v in rebuilt.items():
        for d in range(len(v) + 1):
            members[v[:d]].append(c)
    children = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, m in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += children[p] == 0
            saved[p[:d]] += (len(m) - 1) * words
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(rebuilt[c]) == len(p))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def in_duckdb(name, table, rows_of):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{rows_of}'")
    return con.execute(queries.oracle_sql()[name]).fetchall()


def talks(seed):
    """Conversations under, at and over 0, shared heads, ties, nulls, repeated rows, a clashing column, long ones."""
    r, rows = random.Random(seed), []
    for c in range(-45, 120):
        if r.random() < 0.1:
            continue
        for t in range(r.randint(1, 7)):
            rows.append((c, None if r.random() < 0.1 else t // (2 if c % 7 == 0 else 1), r.choice(["user", "assistant", None]), r.choice(["a b", "c", None, "", "d e f"]), 1))
    for c in range(1000, 1012):
        rows += [(c, t, "u", str(t % 5), 1) for t in range(90 - c % 7 * 5)]
    return rows + [(None, 1, "u", "x", 1), (7, 0, "u", "x", 1), (7, 0, "u", "x", 1)]


def test_trie_against_brute_force(spark):
    rows = talks(1)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, depth int")
    got = sorted((tuple(r) for r in prefix_trie.trie(df.repartition(5)).collect()), key=str)
    assert got == brute_trie([r[:4] for r in rows])
    assert prefix_trie.trie(df.limit(0)).count() == 0


def test_trie_equals_sql(spark):
    sf = "/root/testdata/sf0.01"
    got = sorted((tuple(r) for r in queries.op11_prefix_trie(spark, sf).collect()), key=str)
    assert got == sorted(in_duckdb("op11_prefix_trie", "conversations", f"{sf}/conversations.parquet"), key=str)


def test_trie_draws_again_where_fingerprints_collide(spark, monkeypatch):
    """Maps that are the same for all turns of the first draw: verification finds it, the next draw is right."""
    drawn = []
    true = prefix_trie._turns

    def weak(*args):
        drawn.append(args[-1])
        out = true(*args)
        return out.withColumns({"m": F.lit(3).cast("long"), "b": F.lit(5).cast("long")}) if len(drawn) == 1 else out

    monkeypatch.setattr(prefix_trie, "_turns", weak)
    rows = [(c, t, "u", f"{c % 3} {t}") for c in (1, 2, 3, 41) for t in range(4)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = sorted((tuple(r) for r in prefix_trie.trie(df).collect()), key=str)
    assert got == brute_trie(rows) and len(drawn) == 2


def test_maps_compose_and_invert():
    r = random.Random(5)
    x, y, z = ((r.randrange(1, prefix_trie.PRIME), r.randrange(prefix_trie.PRIME)) for _ in range(3))
    c = prefix_trie.compose
    assert c(c(x, y), z) == c(x, c(y, z)) and c(x, y) != c(y, x) and c(prefix_trie.inverse(x), x) == (1, 0)


def brute_fim(doc_id, text):
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text, flags=re.S)
    n, digest = len(units), hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", text, None, None
    spm = h[3] % 100 < 20
    return n, "spm" if spm else "psm", f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}", len(p), len(m)


def test_fill_in_middle_against_brute_force(spark):
    odd = [(i, t, 1, "x") for i, t in enumerate(["", None, "<P>", "a<", "<S", "x<M>y", "é😀 ab\r\n", "Ab1 " * 50_000, "😀" * 60_000, "$1 \\2 {3}", "a", "\x00b"])]
    odd += [(None, "no id at all", 1, "x"), (5, "again", 1, "x"), (5, "again", 1, "x")] + [(100 + i, f"some words {i} <", 1, "x") for i in range(300)]
    df = spark.createDataFrame(odd, "doc_id long, text string, n int, h1 string")
    out = fim.transform(df).withColumn("back", fim.restore(F.col("output"), F.col("form"))).collect()
    assert len(out) == len(odd) and {r.form for r in out} == {"plain", "psm", "spm"}
    for r in out:
        assert (r.n, r.form, r.output, r.prefix_chars, r.middle_chars) == brute_fim(r.doc_id, r.text) and r.back == r.text
    assert fim.transform(df.limit(0)).count() == 0
    assert fim.transform(df, epoch=2).select("output").collect() != [(r.output,) for r in out]


def test_fill_in_middle_equals_sql(spark):
    sf = "/root/testdata/sf0.01"
    got = sorted(tuple(r) for r in queries.op12_fill_in_middle(spark, sf).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256").collect())
    assert got == sorted(in_duckdb("op12_fill_in_middle", "documents", f"{sf}/documents.parquet"))


def brute_join(rows, percent=80):
    sets = {}
    for i, t in rows:
        w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, min(len(w), 1)))}
    holders = collections.defaultdict(list)
    for i in sorted(sets):
        for s in sets[i]:
            holders[s].append(i)
    both = collections.Counter((a, b) for v in holders.values() for x, b in enumerate(v) for a in v[:x])
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for (a, b), n in both.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(a), find(b)
            top[max(x, y)] = min(x, y)
    return sorted((i, len(sets[i]), find(i)) for i in sets)


def test_count_tree_join_against_brute_force(spark, monkeypatch):
    """Near copies, a line that all share, and filled-in forms around the threshold; blocks so small that trees are used."""
    monkeypatch.setattr(count_tree, "BLOCK", 100)
    r = random.Random(3)
    pick = lambda n: [r.choice(WORDS) for _ in range(n)]
    texts, line, form = [], pick(40), pick(200)
    for base in (pick(150) for _ in range(6)):
        for _ in range(30):
            p = r.random() * 0.06
            texts.append(" ".join(line + [r.choice(WORDS) if r.random() < p else w for w in base]))
    texts += [" ".join(line + pick(r.randint(20, 60))) for _ in range(150)]
    for _ in range(250):
        w, s, n = list(form), r.randint(0, 170), r.randint(10, 26)
        w[s : s + n] = pick(n)
        texts.append(" ".join(w))
    rows = list(enumerate(texts)) + [(5000, None), (5001, ""), (5002, "One two"), (5003, "one TWO"), (5004, "one"), (5005, " \t ")]
    df = spark.createDataFrame([(*x, "k", 1) for x in rows], "doc_id long, text string, key string, n int")
    got = sorted(tuple(x) for x in count_tree.similar_sets(df).collect())
    assert got == brute_join(rows)


def test_count_tree_join_edges(spark):
    one, two = " ".join(WORDS[:60]), " ".join(WORDS[100:160])
    df = spark.createDataFrame([(1, two), (1, one), (2, one), (None, one), (None, None), (3, two + " " + WORDS[0])], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in count_tree.similar_sets(df).collect()), key=str)
    assert got == sorted([(1, 56, 1), (2, 56, 1), (None, 56, None), (None, 0, None), (3, 57, 3)], key=str)
    assert count_tree.similar_sets(df.limit(0)).count() == 0


def test_count_tree_join_equals_sql(spark):
    sf = "/root/testdata/sf0.01"
    got = sorted(tuple(r) for r in queries.op13_count_tree_join(spark, sf).collect())
    assert got == sorted(in_duckdb("op13_count_tree_join", "documents", f"{sf}/documents.parquet"))


@pytest.mark.parametrize("n", [1, 15, 17, 300, 700])
def test_tree_finds_what_the_bound_allows(n):
    r = np.random.default_rng(n)
    base = [np.unique(r.integers(0, 1 << 63, 300, dtype=np.uint64)) for _ in range(6)]
    sets = [common.mix(b[r.random(len(b)) < r.uniform(0.7, 1)]) for b in (base[i % 6] for i in range(n))]
    sizes, points = np.array([len(s) for s in sets]), np.stack([count_tree.group_counts(s) for s in sets])
    q, p = count_tree.Tree(sizes, points).search(sizes, points, 80)
    most = count_tree.bound(points[:, None, :], points[None])
    may = (most >= count_tree.needed(sizes[:, None], sizes[None], 80)) & (sizes[None] >= sizes[:, None]) & (80 * sizes[None] <= 100 * sizes[:, None])
    assert sorted(zip(q.tolist(), p.tolist(), strict=True)) == sorted(zip(*(x.tolist() for x in np.nonzero(may)), strict=True))
    for i in range(0, n, 7):
        assert (most[i] >= [len(np.intersect1d(sets[i], s)) for s in sets]).all()


@pytest.mark.parametrize("broken", [0, 100, 400])
def test_passage_behind_many_broken_copies(spark, broken):
    """Two documents share an edited passage that any number of earlier ones hold broken up, each in another way."""
    from palate.llm import substring_dedup

    r = random.Random(9)
    pick = lambda n: [r.choice(WORDS) for _ in range(n)]
    passage, rows = pick(150), []
    for _ in range(broken):
        words = list(passage)
        for k in range(r.randrange(12), 150, 12):
            words[k] = r.choice(WORDS)
        rows.append(pick(20) + words + pick(20))
    for edits in (0, 5):
        words = list(passage)
        for k in range(edits):
            words[15 + 28 * k] = "edited"
        rows.append(pick(30) + words + pick(30))
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id long, text string")
    got = {(x.doc_id, x.source_id) for x in substring_dedup.repeated_passages(df).collect()}
    assert (broken + 1, broken) in got


def test_fine_points_bound_the_overlap():
    """Of sets of different sizes, and so of different numbers of groups, never less than what they share, and less than
    what they need where they share little."""
    r = np.random.default_rng(6)
    pool = common.mix(r.integers(0, 1 << 63, 9000, dtype=np.uint64))
    for n, m in ((1500, 1800), (4000, 5000), (2040, 2060), (8000, 7000)):
        x, y = (np.unique(r.choice(pool, k, replace=False)) for k in (n, m))
        both = len(np.intersect1d(x, y))
        assert both <= count_tree.fine_bound(count_tree.fine_counts(x), count_tree.fine_counts(y)) <= min(n, m)
        apart = common.mix(np.arange(m, dtype=np.uint64) + np.uint64(1 << 40))
        assert count_tree.fine_bound(count_tree.fine_counts(x), count_tree.fine_counts(apart)) < count_tree.needed(np.array(n), np.array(m), 80)
    assert count_tree.fine_bound(b"", count_tree.fine_counts(pool)) is None
