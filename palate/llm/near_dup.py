"""MinHash near-duplicates with b-bit signatures.

One pass over the texts gives each document its shingle count, a 128-bit fingerprint of its shingle set, band keys
from groups of full minima, and a packed signature that keeps only the low four bits of each minimum. Documents with
equal sets form a class; only class representatives go on. Within a bucket of a band, each representative is paired
with the bucket's smallest one, never with all others. Pairs pass the collision-corrected similarity that counting
equal four-bit fields gives, and are then confirmed on full shingle sets. A second round tests, in every bucket, the
members that the first round left in another component against all members of other components, so that every pair
of documents that shares a bucket is either in one component or tested: no bucket has a cap.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palate.llm.common import components, discard, materialise, mix, one_text_each, shingle_sets, text_parts

BANDS, ROWS = 32, 4
#: Minima behind the packed signature; the first BANDS * ROWS of them make the bands.
MINIMA = 640
BITS = 4
PER_LONG = 64 // BITS
LONGS = MINIMA // PER_LONG
#: Pairs of one document that are confirmed together.
PARTS = 256
#: How far under the threshold an estimate may lie: over four standard errors (0.018 at similarity 0.75).
SLACK = 0.075

_RNG = np.random.default_rng(20240131)
_XOR = _RNG.integers(0, 1 << 32, MINIMA, dtype=np.uint32)
_ODD = _RNG.integers(0, 1 << 31, MINIMA, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_BAND_SEED = _RNG.integers(1, 1 << 63, BANDS, dtype=np.uint64)

SKETCH = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_shingles", pa.int64()),
        ("fp", pa.binary(16)),
        ("bands", pa.list_(pa.int64())),
        ("sig", pa.list_(pa.int64())),
    ]
)
SKETCH_DDL = "doc_id long, n_shingles long, fp binary, bands array<long>, sig array<long>"


def minima(shingles: np.ndarray) -> np.ndarray:
    """The smallest value of the set under each of MINIMA permutations of 32 bits, in blocks of bounded memory."""
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(MINIMA, np.uint32(0xFFFFFFFF))
    for i in range(0, len(low), 1024):
        part = low[i : i + 1024]
        np.minimum(out, ((part[None, :] ^ _XOR[:, None]) * _ODD[:, None]).min(axis=1), out=out)
    return out


def band_keys(m: np.ndarray) -> np.ndarray:
    wide = m[: BANDS * ROWS].astype(np.uint64).reshape(BANDS, ROWS)
    key = _BAND_SEED.copy()
    for r in range(ROWS):
        key = mix(key ^ wide[:, r]) + np.uint64(r)
    return key


def pack(m: np.ndarray) -> np.ndarray:
    """The low BITS bits of each minimum, PER_LONG fields to a long."""
    fields = (m & np.uint32((1 << BITS) - 1)).astype(np.uint64).reshape(LONGS, PER_LONG)
    shifts = np.arange(PER_LONG, dtype=np.uint64) * np.uint64(BITS)
    return np.bitwise_or.reduce(fields << shifts, axis=1)


def sketch_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, counts, fps, bands, sigs = batch.column(0).to_pylist(), [], [], [], []
        for _, texts in text_parts(batch.column(1)):
            for s in shingle_sets(texts):
                counts.append(len(s))
                twice = mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5))
                fps.append(s.sum(dtype=np.uint64).tobytes() + twice.sum(dtype=np.uint64).tobytes())
                m = minima(s) if len(s) else None
                bands.append(None if m is None else band_keys(m).view(np.int64))
                sigs.append(None if m is None else pack(m).view(np.int64))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64()),
                pa.array(counts, pa.int64()),
                pa.array(fps, pa.binary(16)).cast(pa.binary()),
                pa.array(bands, pa.list_(pa.int64())),
                pa.array(sigs, pa.list_(pa.int64())),
            ],
            names=SKETCH.names,
        )


def estimate(a: Column, b: Column) -> Column:
    """Similarity from the share of equal low-bit fields, corrected for fields that are equal by chance."""
    ones = sum(1 << (i * BITS) for i in range(PER_LONG))
    differ = None
    for i in range(LONGS):
        x = a[i].bitwiseXOR(b[i])
        for step in (BITS >> k for k in range(1, BITS.bit_length())):
            x = x.bitwiseOR(F.shiftrightunsigned(x, step))
        x = x.bitwiseAND(F.lit(ones))
        differ = F.bit_count(x) if differ is None else differ + F.bit_count(x)
    by_chance = 1.0 / (1 << BITS)
    return (1 - differ / F.lit(float(MINIMA)) - by_chance) / (1 - by_chance)


def confirm(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose full sets have 100 * intersection >= percent * union.

    ``texts`` (doc, text) has one row an id; those that no pair names are left behind first. The text of b joins first;
    a is the side that can be a hub, and a hub of more than PARTS pairs stands in several parts of about that many, its
    text beside each. Sets are computed from the texts, and a's only when a changes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, center = None, None
        for batch in batches:
            keep: list[bool] = []
            hubs = batch.column(0).to_pylist()
            for begin, others in text_parts(batch.column(3)):
                for i, other in enumerate(shingle_sets(others), begin):
                    if center is None or hubs[i] != last:
                        last, center = hubs[i], shingle_sets([batch.column(2)[i].as_py()])[0]
                    both = len(np.intersect1d(center, other, assume_unique=True))
                    union = len(center) + len(other) - both
                    keep.append(union > 0 and 100 * both >= percent * union)
            pairs = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"])
            yield pairs.filter(pa.array(keep, pa.bool_()))

    pairs = materialise(pairs, "pairs")
    named = pairs.select(F.col("a").alias("doc")).unionByName(pairs.select(F.col("b").alias("doc"))).distinct()
    texts = materialise(texts.join(named, "doc", "left_semi"), "texts")
    hubs = pairs.groupBy("a").agg(F.ceil(F.count("*") / PARTS).alias("parts")).where("parts > 1")
    salted = pairs.join(hubs, "a", "left").select(
        "a", "b", F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1))).alias("part")
    )
    sides = texts.join(hubs.withColumnRenamed("a", "doc"), "doc", "left").select(
        F.col("doc").alias("a"),
        F.col("text").alias("a_text"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)) - 1)).alias("part"),
    )
    one = salted.join(texts.select(F.col("doc").alias("b"), F.col("text").alias("b_text")), "b")
    two = one.join(sides, ["a", "part"])
    return two.select("a", "b", "a_text", "b_text").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """Classes of near-duplicates: rows (doc_id, n_shingles, component_id, kept), one a document.

    Words are runs of characters other than white space, A-Z lower-cased; a document's set is its distinct
    five-word shingles, or with one to four words the whole sequence as one shingle. Documents are linked where
    100 * intersection >= ``percent`` * union; ``component_id`` is the smallest id reachable over links, and
    ``kept`` says whether that is the document itself.

    Empty or null texts have no shingles and are linked with nothing. Rows that repeat an id count as one document
    with the smallest of their texts. Rows with a null id come back once each with a null component and
    ``kept`` true, linked with nothing. Other columns are not read, whatever their names. An empty table gives an
    empty table. Texts of any length are read whole.
    """
    base = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    nameless = base.where("doc_id is null")
    texts = one_text_each(docs, id_col, text_col)
    whole = materialise(texts.mapInArrow(sketch_batches, SKETCH_DDL), "sketches")
    # the sketch columns follow from the fingerprint alone, so a class's row needs no arrays in its aggregation
    named = materialise(whole.select("doc_id", "n_shingles", "fp"), "named")
    classes = named.where("n_shingles > 0").groupBy("fp").agg(F.min("doc_id").alias("rep"))
    full = whole.where("n_shingles > 0").drop("fp")
    reps = classes.join(full, classes.rep == full.doc_id).select("rep", classes.fp, "n_shingles", "bands", "sig")
    reps = materialise(reps, "classes")
    discard(whole)
    comp = _components(reps, texts, percent)
    out = named.join(reps.select("fp", "rep"), "fp", "left").join(
        comp.select(F.col("id").alias("rep"), "comp"), "rep", "left"
    )
    out = out.select(
        "doc_id", "n_shingles", F.coalesce("comp", "rep", "doc_id").alias("component_id")
    ).withColumn("kept", F.col("doc_id") == F.col("component_id"))
    lone = nameless.mapInArrow(sketch_batches, SKETCH_DDL).select(
        "doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("kept")
    )
    return out.unionByName(lone)


def _components(reps: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Components (id, comp) of class representatives under confirmed links; those without a link have no row."""
    floor = percent / 100 - SLACK
    members = reps.select("rep", F.explode("bands").alias("key"))
    buckets = members.groupBy("key").agg(F.min("rep").alias("center"), F.max("rep").alias("top")).where("center < top")
    shared = materialise(members.join(buckets.select("key", "center"), "key"), "buckets")
    sigs = reps.select("rep", "sig", F.col("n_shingles").alias("n"))

    def near(a: tuple[str, str], b: tuple[str, str]) -> Column:
        """Sizes that allow the similarity, and an estimate that comes near it."""
        (sig_a, n_a), (sig_b, n_b) = a, b
        sizes = 100 * F.least(n_a, n_b) >= percent * F.greatest(n_a, n_b)
        return sizes & (estimate(F.col(sig_a), F.col(sig_b)) >= floor)

    def similar(pairs: DataFrame) -> DataFrame:
        a = sigs.select(F.col("rep").alias("a"), F.col("sig").alias("sa"), F.col("n").alias("na"))
        b = sigs.select(F.col("rep").alias("b"), F.col("sig").alias("sb"), F.col("n").alias("nb"))
        return pairs.join(b, "b").join(a, "a").where(near(("sa", "na"), ("sb", "nb"))).select("a", "b")

    stars = shared.where("rep <> center").select(F.col("center").alias("a"), F.col("rep").alias("b")).distinct()
    first = materialise(confirm(similar(stars), texts, percent), "links")
    comp = materialise(components(first, "stars"), "labels")
    of = shared.join(comp.select(F.col("id").alias("rep"), "comp"), "rep", "left").select(
        "key", "rep", "center", F.coalesce("comp", "rep").alias("comp")
    )
    of = materialise(
        of.join(comp.select(F.col("id").alias("center"), F.col("comp").alias("home")), "center", "left").select(
            "key", "rep", "comp", F.coalesce("home", "center").alias("home")
        ),
        "placed",
    )
    # Only buckets whose members ended up in several components have anything left to test.
    rest = of.where("comp <> home").select("key", F.col("rep").alias("x"), F.col("comp").alias("x_comp"))
    full = reps.select("rep", "sig", F.col("n_shingles").alias("n"), "bands")
    rest = rest.join(full.select(*(F.col(c).alias(d) for c, d in zip(full.columns, ("x", "sx", "nx", "bx")))), "x")
    # sets that are alike have sizes of the same class or of neighbouring ones
    size = F.floor(F.log("n") / np.log(100 / percent))
    sizes = F.floor(F.log("nx") / np.log(100 / percent))
    rest = rest.withColumn("size", F.explode(F.array(sizes - 1, sizes, sizes + 1)))
    open_ = of.join(rest.select("key").distinct(), "key", "left_semi").join(full, "rep").withColumn("size", size)
    # two members can meet in many buckets; they are paired in the one with the smallest key
    once = F.array_min(F.array_intersect("bx", "bands")) == F.col("key")
    more = (
        rest.join(open_, ["key", "size"])
        .where((F.col("comp") != F.col("x_comp")) & near(("sx", "nx"), ("sig", "n")) & once)
        .select(F.least("x", "rep").alias("a"), F.greatest("x", "rep").alias("b"))
        .distinct()
        .join(stars, ["a", "b"], "left_anti")
    )
    second = materialise(confirm(more, texts, percent), "links")
    if second.isEmpty():
        return comp
    # the components so far are the nodes of what is left to join
    ends = second.select(F.col("a").alias("id")).unionByName(second.select(F.col("b").alias("id"))).distinct()
    comp = materialise(
        comp.unionByName(ends.join(comp, "id", "left_anti").select("id", F.col("id").alias("comp"))), "labels"
    )
    edges = second.join(comp.select(F.col("id").alias("a"), F.col("comp").alias("x")), "a")
    edges = edges.join(comp.select(F.col("id").alias("b"), F.col("comp").alias("y")), "b")
    joined = components(edges.select(F.col("x").alias("a"), F.col("y").alias("b")), "near")
    return comp.join(joined.select(F.col("id").alias("comp"), F.col("comp").alias("top")), "comp", "left").select(
        "id", F.coalesce("top", "comp").alias("comp")
    )
