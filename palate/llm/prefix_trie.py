"""A prefix trie over conversations that are rebuilt from others, by composable fingerprints.

A turn's hash is an invertible map z -> m * z + b over a prime field; a sequence's fingerprint is the composition of its
turns' maps. Maps compose and invert, so a rebuilt conversation (a head of its base, then the rest of its own turns) has
the prefix fingerprints

    base[:k]                                   within the head of h turns
    base[:h] * inverse(own[:h]) * own[:k]      behind it

and no rebuilt text is ever made: only fingerprints and references to stored turns move. Equal fingerprints of equal
depth form a node. A node's members are then proven equal through their references: their last turns are compared as
stored, word for word, and their parents must be one node. Should a fingerprint ever join two texts, the maps are drawn
again.

Running compositions and sums are scans over range-partitioned rows: each partition scans its own rows, and what it
carries into the next one is composed afterwards, so a conversation or a chain of any length is spread over tasks.

Sums over subtrees go along chains. A node's owner is the member with the smallest random rank, so the nodes of one owner
form a chain down to its own end, and on a way from the root the owner changes about log(members) times. Totals of
chains move to their parent chains, round by round, and one scan along all chains adds them up.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palate.llm.common import discard, materialise

PRIME = (1 << 61) - 1
#: Text words: runs of characters other than white space.
WORD = r"[^\x20\x09-\x0D]+"
NODE = ("depth", "m", "b")


class Collision(Exception):
    """Two different sequences of turns had one fingerprint."""


def compose(x: tuple[int, int], y: tuple[int, int]) -> tuple[int, int]:
    """x, then y."""
    return x[0] * y[0] % PRIME, (x[1] * y[0] + y[1]) % PRIME


def inverse(x: tuple[int, int]) -> tuple[int, int]:
    m = pow(x[0], -1, PRIME)
    return m, -x[1] * m % PRIME


def _turns(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, seed: int) -> DataFrame:
    """(conv, turn, role, text, m, b, words) of every row with a conversation."""
    base = turns.select(
        turns[conv_col].cast("long").alias("conv"), turns[turn_col].cast("long").alias("turn"),
        F.coalesce(turns[role_col], F.lit("")).alias("role"), F.coalesce(turns[text_col], F.lit("")).alias("text"),
    ).where("conv is not null")
    m, b = (F.pmod(F.xxhash64(F.lit(seed + i), "role", F.lit(seed), "text"), F.lit(PRIME - 1)) + 1 - i for i in (0, 1))
    return base.select("*", m.alias("m"), b.alias("b"), F.regexp_count("text", F.lit(WORD)).cast("long").alias("words"))


def spread(df: DataFrame, *order: str | Column) -> DataFrame:
    """``df`` in range partitions and sorted within them, with ``part``, the partition's number."""
    out = df.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *order)
    return out.sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())


def _fold(parts: list, compose_) -> list[tuple]:
    """What each partition takes over: (part, key, state) where its first key began in partitions before it. ``parts``
    has (part, first key, last key, state of the last key in this partition), one row a partition, in order."""
    out, key, state = [], None, None
    for part, first, last, own in parts:
        if key is not None and first == key:
            out.append((part, key, state))
            own = compose_(state, own) if last == first else own
        key, state = last, own
    return out


def _carries(rows: DataFrame, key: str, state: str, compose_, names: str) -> DataFrame | None:
    """(part, key, what partitions before have come to): a row a partition at most, so it may be broadcast. None if no key
    goes on from one partition into the next. ``rows`` have ``seq``, their place in their partition."""
    ends = rows.groupBy("part").agg(F.min(key), F.max(key), F.max_by(F.struct(*state.split()), "seq")).orderBy("part").collect()
    carried = _fold([(p, x, y, tuple(z)) for p, x, y, z in ends], compose_)
    if not carried:
        return None
    return rows.sparkSession.createDataFrame([(p, k, *s) for p, k, s in carried], f"part int, {key} long, {names}")


SCANNED = "conv long, turn long, words long, part int, seq long, number long, m long, b long, qm long, qb long, pm long, pb long"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one partition, sorted by conversation: each with its number in its conversation and the composition before
    it (q) and up to it (p), all counted from the partition's first row of the conversation."""
    conv, seq, number, at = None, 0, 0, (1, 0)
    for batch in batches:
        new: list[tuple] = []
        for c, m, b in zip(*(batch.column(x).to_pylist() for x in ("conv", "m", "b")), strict=True):
            if c != conv:
                conv, number, at = c, 0, (1, 0)
            before, at = at, compose(at, (m, b))
            number, seq = number + 1, seq + 1
            new.append((seq, number, *before, *at))
        seqs, numbers, *products = (pa.array(x, pa.int64()) for x in zip(*new, strict=True)) if new else (pa.array([], pa.int64()),) * 6
        columns = [batch.column(x) for x in ("conv", "turn", "words", "part")] + [seqs, numbers, batch.column("m"), batch.column("b"), *products]
        yield pa.RecordBatch.from_arrays(columns, names=_names(SCANNED))


def _names(ddl: str) -> list[str]:
    return [x.split()[0] for x in ddl.split(", ")]


def _rows(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}
    types = [kinds[x.split()[1]] for x in ddl.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=_names(ddl))


PLACED = "conv long, turn long, words long, number long, m long, b long, qm long, qb long"


def _lift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Scanned rows with what their conversation came to in earlier partitions (cn, cm, cb)."""
    for batch in batches:
        out = []
        for conv, turn, words, number, m, b, qm, qb, cn, cm, cb in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            out.append((conv, turn, words, number + cn, m, b, *compose((cm, cb), (qm, qb))))
        yield _rows(out, PLACED)


def _places(rows: DataFrame) -> DataFrame:
    """(conv, turn, words, number, m, b, qm, qb): every turn's place in its conversation and the composition before it."""
    narrow = materialise(rows.select("conv", "turn", "m", "b", "words"), "turns")
    # turns of a conversation that bear one number and differ stand in the order of role and text; equal ones may stand either way
    tied = narrow.groupBy("conv", "turn").agg(F.count("*").alias("n"), F.min("m").alias("x"), F.max("m").alias("y"))
    tied = materialise(tied.where("n > 1 and x <> y").select("conv", "turn"), "tied")
    order: tuple = ("conv", F.col("turn").asc_nulls_first())
    if not tied.isEmpty():
        mark = tied.select(F.col("conv").alias("c"), F.col("turn").alias("t"), F.lit(True).alias("tied"))
        keyed = rows.join(mark, (F.col("conv") == F.col("c")) & F.col("turn").eqNullSafe(F.col("t")), "left")
        tie = F.when(F.col("tied"), F.struct("role", "text"))
        narrow = materialise(keyed.select("conv", "turn", "m", "b", "words", tie.alias("tie")), "turns")
        order = (*order, "tie")
    scanned = materialise(spread(narrow, *order).select("conv", "turn", "words", "part", "m", "b").mapInArrow(_scan, SCANNED), "scanned")
    discard(narrow)
    join = lambda x, y: (x[0] + y[0], *compose(x[1:], y[1:]))
    carried = _carries(scanned, "conv", "number pm pb", join, "cn long, cm long, cb long")
    if carried is None:
        return scanned.select(*_names(PLACED))
    # a row a partition at most
    both = scanned.join(F.broadcast(carried), ["part", "conv"], "left")
    lifted = both.where("cn is not null").select(*_names(PLACED), "cn", "cm", "cb").mapInArrow(_lift, PLACED)
    return both.where("cn is null").select(*_names(PLACED)).unionByName(lifted)


PREFIX = "conv long, depth long, m long, b long, qm long, qb long, rconv long, rturn long, words long, lm long, lb long, last boolean"
_HEAD = "array<struct<depth: long, m: long, b: long, qm: long, qb: long, rconv: long, rturn: long, words: long, lm: long, lb: long>>"
_HEAD_KIND = pa.list_(pa.struct([(x.split(":")[0].strip(), pa.int64()) for x in _HEAD[13:-2].split(", ")]))


def _rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv, base, h, n, own first turns, the base's first turns) to (conv, h, kept, total, am, ab, head): how many turns of
    the base are kept, the whole length, the map that leads from own prefixes to rebuilt ones, and the head's prefixes."""
    for batch in batches:
        columns: list[list] = [[] for _ in range(7)]
        for conv, base, h, n, own, theirs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            kept = (theirs or [])[:h]
            at, head = (1, 0), []
            for depth, t in enumerate(kept, 1):
                before, at = at, compose(at, (t["m"], t["b"]))
                head.append({"depth": depth, "m": at[0], "b": at[1], "qm": before[0], "qb": before[1], "rconv": base, "rturn": t["turn"], "words": t["words"], "lm": t["m"], "lb": t["b"]})
            skipped = (1, 0)
            for t in own[:h]:
                skipped = compose(skipped, (t["m"], t["b"]))
            to = compose(at, inverse(skipped))
            for column, v in zip(columns, (conv, h, len(kept), len(kept) + max(n - h, 0), *to, head), strict=True):
                column.append(v)
        kinds = [pa.int64()] * 6 + [_HEAD_KIND]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["conv", "h", "kept", "total", "am", "ab", "head"])


def _behind(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Own turns behind the head, each as a prefix of the rebuilt conversation."""
    for batch in batches:
        out = []
        for conv, turn, words, number, m, b, qm, qb, h, kept, total, am, ab in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            before, depth = compose((am, ab), (qm, qb)), kept + number - h
            out.append((conv, depth, *compose(before, (m, b)), *before, conv, turn, words, m, b, depth == total))
        yield _rows(out, PREFIX)


def _prefixes(placed: DataFrame, span: int, head_turns: Column) -> DataFrame:
    """Every prefix of every rebuilt conversation: its fingerprint, its parent's, and a reference to its last turn. A
    conversation's head is that of the one whose id is the multiple of ``span`` below."""
    first = F.when(F.col("number") <= 3, F.struct("number", "turn", "words", "m", "b"))
    convs = placed.groupBy("conv").agg(F.max("number").alias("n"), F.array_sort(F.collect_list(first)).alias("own"))
    convs = materialise(convs.withColumns({"base": F.col("conv") - F.col("conv") % span, "h": head_turns}), "conversations")
    theirs = convs.select(F.col("conv").alias("base"), F.col("own").alias("theirs"))
    rebuilt = convs.join(theirs, "base", "left").select("conv", "base", "h", "n", "own", "theirs")
    ddl = f"conv long, h long, kept long, total long, am long, ab long, head {_HEAD}"
    rebuilt = materialise(rebuilt.mapInArrow(_rebuild, ddl), "rebuilt")
    none = F.lit(None).cast("long")
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    root = rebuilt.select(
        "conv", zero.alias("depth"), one.alias("m"), zero.alias("b"), none.alias("qm"), none.alias("qb"), none.alias("rconv"), none.alias("rturn"),
        zero.alias("words"), none.alias("lm"), none.alias("lb"), (F.col("total") == 0).alias("last"),
    )
    head = rebuilt.select("conv", "total", F.explode("head").alias("x")).select("conv", "x.*", (F.col("x.depth") == F.col("total")).alias("last"))
    own = placed.join(rebuilt.drop("head"), "conv").where(F.col("number") > F.col("h"))
    own = own.select(*_names(PLACED), "h", "kept", "total", "am", "ab").mapInArrow(_behind, PREFIX)
    out = materialise(root.unionByName(head).unionByName(own), "prefixes")
    discard(convs)
    discard(rebuilt)
    return out


def _nodes(prefixes: DataFrame, turns: DataFrame) -> DataFrame:
    """Prefixes of one depth and fingerprint as a node, proven to be one sequence."""
    ref, parent, turn = F.struct("rconv", "rturn"), F.struct("qm", "qb"), F.struct("lm", "lb")
    nodes = prefixes.groupBy(*NODE).agg(
        F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), F.first("words").alias("words"), F.count_if("last").alias("n_ends"),
        F.min(F.struct(F.xxhash64("conv", F.lit(7)).alias("rank"), "conv")).alias("owner"),
        F.min(parent).alias("q"), F.min(turn).alias("l"), (F.min(ref) != F.max(ref)).alias("several"),
        ((F.min(parent) != F.max(parent)) | (F.min(turn) != F.max(turn))).alias("torn"),
    )
    nodes = nodes.select(*NODE, "conv_id", "n_convs", "words", "n_ends", F.col("owner.conv").alias("owner"), "q.qm", "q.qb", "l.lm", "l.lb", "several", "torn")
    nodes = materialise(nodes, "nodes")
    # parents are one node, so what is left to prove is that the turns referred to are equal as stored
    asked = materialise(nodes.where("several").select(F.col("lm").alias("m"), F.col("lb").alias("b")).distinct(), "asked")
    stored = turns.select("m", "b", F.struct("role", "text").alias("t")).join(asked, ["m", "b"], "left_semi")
    unequal = stored.groupBy("m", "b").agg((F.min("t") != F.max("t")).alias("x")).where("x")
    if not nodes.where("torn").isEmpty() or not unequal.isEmpty():
        raise Collision
    return nodes.drop("several", "torn", "lm", "lb")


ENDS = "depth long, m long, b long, first long, ids string"
#: Ids of one node that are joined to one string; the digest takes them chunk by chunk.
CHUNK = 512


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (depth, m, b, conv) to comma-joined ids of one node, at most CHUNK in a row."""
    node, ids = None, []
    for batch in batches:
        out = []
        for *key, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key != node or len(ids) == CHUNK:
                if ids:
                    out.append((*node, ids[0], ",".join(map(str, ids))))
                node, ids = key, []
            ids.append(conv)
        yield _rows(out, ENDS)
    if ids:
        yield _rows([(*node, ids[0], ",".join(map(str, ids)))], ENDS)


DIGESTS = "depth long, m long, b long, ends_sha256 string"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks, sorted by node and first id, to one digest a node; a chunk at a time is in memory."""
    node, state = None, None
    for batch in batches:
        out = []
        for *key, _, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key == node:
                state.update(b",")
            else:
                if node:
                    out.append((*node, state.hexdigest()))
                node, state = key, hashlib.sha256()
            state.update(ids.encode())
        yield _rows(out, DIGESTS)
    if node:
        yield _rows([(*node, state.hexdigest())], DIGESTS)


def _end_digests(prefixes: DataFrame) -> DataFrame:
    ends = materialise(prefixes.where("last").select(*NODE, "conv"), "ends")
    chunks = materialise(spread(ends, *NODE, "conv").select(*NODE, "conv").mapInArrow(_chunks, ENDS), "chunks")
    discard(ends)
    # a row for each CHUNK ids, so the largest node is that many times shorter than its members
    return chunks.repartition(*NODE).sortWithinPartitions(*NODE, "first").mapInArrow(_digests, DIGESTS)


SUMMED = "part int, seq long, owner long, depth long, m long, b long, n_leaves long, saved long"


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one partition sorted by (owner, depth descending): sums of both values from the chain's end on."""
    owner, seq, leaves, saved = None, 0, 0, 0
    for batch in batches:
        new: list[tuple] = []
        for o, x, y in zip(*(batch.column(c).to_pylist() for c in ("owner", "leaves", "saved")), strict=True):
            if o != owner:
                owner, leaves, saved = o, 0, 0
            leaves, saved, seq = leaves + x, saved + y, seq + 1
            new.append((seq, leaves, saved))
        seqs, *sums = (pa.array(x, pa.int64()) for x in zip(*new, strict=True)) if new else (pa.array([], pa.int64()),) * 3
        yield pa.RecordBatch.from_arrays([batch.column("part"), seqs, *(batch.column(c) for c in ("owner", *NODE)), *sums], names=_names(SUMMED))


def _subtree_sums(nodes: DataFrame) -> DataFrame:
    """(depth, m, b, n_leaves, saved_tokens) of nodes with ``owner``, ``p_owner`` (the parent's), ``leaves`` and ``saved``."""
    chains = nodes.groupBy("owner").agg(
        F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"), F.min("depth").alias("top"), F.min_by("p_owner", "depth").alias("up")
    )
    chains = materialise(chains, "chains")
    links = chains.where("up is not null").select("owner", "up", (F.col("top") - 1).alias("at"))
    found, given = [], chains.select("owner", "leaves", "saved")
    while True:
        # each chain's total goes to its parent chain, then on to that one's parent: about log(members) rounds
        step = given.join(links, "owner").groupBy("up", "at").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        step = materialise(step, "given")
        if step.isEmpty():
            break
        found.append(step)
        given = step.groupBy(F.col("up").alias("owner")).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    rows = nodes.select("owner", *NODE, "leaves", "saved")
    if found:
        every = found[0]
        for df in found[1:]:
            every = every.unionByName(df)
        every = every.groupBy(F.col("up").alias("owner"), F.col("at").alias("depth")).agg(F.sum("leaves").alias("x"), F.sum("saved").alias("y"))
        rows = rows.join(every, ["owner", "depth"], "left").select(
            "owner", *NODE, (F.col("leaves") + F.coalesce("x", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("y", F.lit(0))).alias("saved")
        )
    rows = materialise(rows, "chained")
    order = ("owner", F.desc("depth"))
    summed = materialise(spread(rows, *order).select("part", "owner", *NODE, "leaves", "saved").mapInArrow(_sums, SUMMED), "summed")
    for df in (chains, rows, *found):
        discard(df)
    carried = _carries(summed, "owner", "n_leaves saved", lambda x, y: (x[0] + y[0], x[1] + y[1]), "x long, y long")
    if carried is None:
        return summed.select(*NODE, "n_leaves", F.col("saved").alias("saved_tokens"))
    # a row a partition at most
    both = summed.join(F.broadcast(carried), ["part", "owner"], "left")
    return both.select(
        *NODE, (F.col("n_leaves") + F.coalesce("x", F.lit(0))).alias("n_leaves"), (F.col("saved") + F.coalesce("y", F.lit(0))).alias("saved_tokens")
    )


def trie(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", span: int = 20,
    head_turns: Column | None = None,
) -> DataFrame:
    """Nodes of the trie of rebuilt conversations: (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256).

    Conversation c is rebuilt as the first h turns of conversation c - c % ``span``, then c's own turns after its first h;
    ``head_turns`` gives h (0 to 3) from the column ``conv``, by default from a checksum of the id. A node is a distinct
    sequence of first turns (role, text); ``conv_id`` is its smallest member, and with the depth its name.
    ``n_leaves`` counts childless nodes of its subtree, ``saved_tokens`` sums (members - 1) times the words of the last
    turn over it, ``ends_sha256`` is the digest of the ids of members that end in it, ascending, joined by commas.

    Turns stand in the order of their number, null first; those of one number in the order of role and text. Null roles
    and texts are empty ones; rows with a null conversation are left out; equal rows are turns of their own; other
    columns are not read. No conversations give no nodes, not even a root. Conversations of any length are spread over
    tasks; a node's members are counted with map-side sums.
    """
    if head_turns is None:
        head_turns = F.crc32(F.col("conv").cast("string")) % 4
    for seed in range(8):
        try:
            return _trie(_turns(turns, conv_col, turn_col, role_col, text_col, 1000 * seed), span, head_turns)
        except Collision:
            continue
    raise Collision


def _trie(turns: DataFrame, span: int, head_turns: Column) -> DataFrame:
    prefixes = _prefixes(_places(turns), span, head_turns)
    nodes = _nodes(prefixes, turns)
    up = nodes.select((F.col("depth") + 1).alias("depth"), F.col("m").alias("qm"), F.col("b").alias("qb"), F.col("conv_id").alias("parent_conv_id"), F.col("owner").alias("p_owner"))
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("qm").alias("m"), F.col("qb").alias("b")).agg(F.count("*").alias("n_children"))
    linked = nodes.join(up, ["depth", "qm", "qb"], "left").join(children, list(NODE), "left")
    linked = linked.withColumn("n_children", F.coalesce("n_children", F.lit(0))).withColumns(
        {"leaves": (F.col("n_children") == 0).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("words")}
    )
    linked = materialise(linked, "linked")
    discard(nodes)
    sums = _subtree_sums(linked)
    out = linked.join(sums, list(NODE)).join(_end_digests(prefixes), list(NODE), "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )
