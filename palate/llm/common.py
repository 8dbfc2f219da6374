"""What the training-data operators share: word splitting, stable hashes, shared storage, graph components."""

from __future__ import annotations

import sys
import tempfile
import types
import uuid
from collections.abc import Callable
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# White space of the word patterns: U+0020 and U+0009 to U+000D. Everything else belongs to a word.
SPACES = b" \t\n\x0b\x0c\r"
# A-Z become a-z, white space becomes a space; other bytes, all of UTF-8's among them, stay.
LOWER_SPLIT = bytes(32 if b in SPACES else b + 32 if 65 <= b <= 90 else b for b in range(256))
# As above, and ASCII outside 0-9 a-z becomes a space too.
ALNUM_SPLIT = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

SHINGLE = 5
MASK = (1 << 64) - 1


def spaced_words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words between white space; an empty list for null."""
    return text.encode("utf-8", "surrogatepass").translate(LOWER_SPLIT).split() if text else []


def alnum_words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) runs of ASCII digits, letters and all non-ASCII characters; an empty list for null."""
    return text.encode("utf-8", "surrogatepass").translate(ALNUM_SPLIT).split() if text else []


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (two multiply-xorshift rounds), so that sums of word hashes spread over all bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_A, _B = np.uint64(0x9FB21C651E98DF25), np.uint64(0xD6E8FEB86659FD93)
#: Bytes hashed at once; about a hundred times as much memory is in use meanwhile.
BLOCK = 1 << 20


def _hash_block(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of every word in ``data``, words between blanks. A word's hash is the sum of a mixed value of each
    (byte, place in the word), so that whole blocks are hashed by array operations."""
    raw = np.frombuffer(data, dtype=np.uint8)
    inside = raw != 32
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, lengths = edges[::2], edges[1::2] - edges[::2]
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), starts
    first = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    x = (raw[inside] + place * 257 + 1).astype(np.uint64) * _A
    x ^= x >> np.uint64(32)
    x *= _B
    x ^= x >> np.uint64(29)
    return mix(np.add.reduceat(x, first)), starts


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the lower-cased (A-Z) words between white space of all ``texts``, one text after another, and for
    each text where its words end among them. Null texts have no words. A text is cut only between words."""
    raw = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    data = b" ".join(raw).translate(LOWER_SPLIT)
    hashes, starts, at = [], [], 0
    while at < len(data):
        end = data.find(b" ", at + BLOCK)
        end = len(data) if end < 0 else end
        h, s = _hash_block(data[at:end])
        hashes.append(h)
        starts.append(s + at)
        at = end
    if not hashes:
        return np.zeros(0, dtype=np.uint64), np.zeros(len(texts), dtype=np.int64)
    ends = np.cumsum([len(x) + 1 for x in raw])
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), ends)


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, ascending."""
    words, ends = word_hashes(texts)
    if len(words) < SHINGLE:
        return [np.unique(shingle_hashes(x)) for x in np.split(words, ends[:-1])]
    s, out, begin = shingle_hashes(words), [], 0
    for end in ends.tolist():
        own = s[begin : end - SHINGLE + 1] if end - begin >= SHINGLE else shingle_hashes(words[begin:end])
        out.append(np.unique(own))
        begin = end
    return out


def text_parts(texts, most: int = 1 << 21):
    """(from, texts) of consecutive pieces of a column, each of about ``most`` characters or one text."""
    part, size, begin = [], 0, 0
    for i, text in enumerate(texts):
        part.append(text.as_py())
        size += len(part[-1] or "")
        if size >= most:
            yield begin, part
            part, size, begin = [], 0, i + 1
    if part:
        yield begin, part


_POWERS = [np.uint64(pow(0x9E3779B97F4A7C15, i, 1 << 64)) for i in range(1, SHINGLE + 1)]


def shingle_hashes(words: np.ndarray) -> np.ndarray:
    """Hash of every five-word shingle in order; with one to four words, the whole sequence is the one shingle."""
    n = len(words)
    if n == 0:
        return words
    width = min(n, SHINGLE)
    out = np.full(n - width + 1, np.uint64(width), dtype=np.uint64)
    for i in range(width):
        out += words[i : n - width + 1 + i] * _POWERS[i]
    return mix(out)


def in_process(key: tuple, make: Callable):
    """What ``make`` builds, once a Python process: workers live on between tasks, functions sent to them do not."""
    held = sys.modules.setdefault("_palate_held", types.ModuleType("_palate_held")).__dict__
    if key not in held:
        held[key] = make()
    return held[key]


# --- storage that all executors share -------------------------------------------------------------


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Where the session names none, a local-mode session (tests, notebooks) gets a temporary one; any other
    master is refused, since its executors would not see the driver's folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    own = getattr(spark.sparkContext, "_palate_shared", None)
    if own is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = "file://" + tempfile.mkdtemp(prefix="palate-")
        spark.sparkContext._palate_shared = own
    return own


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_freed(spark: SparkSession):
    """What is written meanwhile frees its shuffle files when it ends; else they lie until the driver happens to collect
    its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


@contextmanager
def rows_at_once(spark: SparkSession, most: int):
    """What is planned meanwhile sends Python at most so many rows at a time: a batch of whole texts is in memory on both
    sides, whatever their length."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(most))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read again: cuts lineage, survives lost executors, runs the plan once."""
    path = shared_path(df.sparkSession, name)
    with shuffles_freed(df.sparkSession):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._palate_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete what materialise() or bucketed() wrote, once nothing reads it any more."""
    if table := getattr(df, "_palate_table", None):
        df.sparkSession.sql(f"DROP TABLE IF EXISTS {table}")
    path = getattr(df, "_palate_path", None)
    if path:
        jvm = df.sparkSession._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def bucketed(df: DataFrame, by: str, name: str) -> DataFrame:
    """Written once to the shared folder, dealt by ``by``: later joins on that column do not shuffle it again. As many
    buckets as the session has shuffle partitions."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = shared_path(spark, name)
    table = f"{name}_{uuid.uuid4().hex}"
    with shuffles_freed(spark):
        df.repartition(n, by).write.bucketBy(n, by).sortBy(by).format("parquet").option("path", path).saveAsTable(table)
    out = spark.table(table)
    out._palate_path, out._palate_table = path, table
    return out


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once a row and hand it to ``body`` as a lambda variable.

    Inside a lambda, Spark evaluates an outer expression again for every element; a lambda variable is a value.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def one_text_each(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, text) without null ids, one row an id: the smallest of its texts, null only if all are. Texts are shuffled
    only for ids that repeat."""
    base = docs.select(docs[id_col].cast("long").alias("doc"), docs[text_col].alias("text"))
    base = base.where("doc is not null")
    twice = base.groupBy("doc").count().where("count > 1").select("doc")
    if twice.isEmpty():
        return base
    again = base.join(twice, "doc", "left_semi").groupBy("doc").agg(F.min("text").alias("text"))
    return materialise(base.join(twice, "doc", "left_anti").unionByName(again), "texts")


# --- connected components -------------------------------------------------------------------------


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of ``edges`` (a, b longs): rows (id, comp), comp the smallest id reachable.

    Alternating large-star and small-star steps (each a minimum per node, then one join). A hub's edges are only
    ever aggregated with map-side combine or joined, so no node's neighbourhood is gathered in one task. Every
    round is written to the shared folder. Ids without an edge have no row. Empty edges give an empty table.
    """
    now = materialise(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), name
    )
    state = None
    while True:
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(seen) == state or seen[0] == 0:
            break
        state = tuple(seen)
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        # every node but a smallest one keeps an edge to a smaller node
        large = materialise(large.distinct(), name)
        discard(now)
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("x"), "m").where("x <> m").select(
            F.greatest("x", "m").alias("a"), F.least("x", "m").alias("b")
        )
        now = materialise(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), name)
        discard(large)
    roots = now.select(F.col("b").alias("id"), F.col("b").alias("comp")).distinct()
    return now.select(F.col("a").alias("id"), F.col("b").alias("comp")).unionByName(roots)


def join_components(comp: DataFrame, edges: DataFrame, name: str = "joined") -> DataFrame:
    """``comp`` (id, comp) with further ``edges`` (a, b): the components so far are the nodes of what is left to join, and
    ends that had no component are components of their own."""
    ends = edges.select(F.col("a").alias("id")).unionByName(edges.select(F.col("b").alias("id"))).distinct()
    alone = ends.join(comp, "id", "left_anti").select("id", F.col("id").alias("comp"))
    comp = materialise(comp.unionByName(alone), name)
    up = edges.join(comp.select(F.col("id").alias("a"), F.col("comp").alias("x")), "a")
    up = up.join(comp.select(F.col("id").alias("b"), F.col("comp").alias("y")), "b")
    top = components(up.select(F.col("x").alias("a"), F.col("y").alias("b")), name)
    top = top.select(F.col("id").alias("comp"), F.col("comp").alias("top"))
    return comp.join(top, "comp", "left").select("id", F.coalesce("top", "comp").alias("comp"))
