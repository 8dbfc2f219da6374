"""Sum-of-squares packing of token sequences.

A document longer than a sequence is cut into full pieces and a rest; full pieces fill a sequence each. Every other
piece is placed, longest first, where the sum over residual gaps of the squared number of open bins with that gap
becomes smallest. Pieces are dealt by a hash into chunks of bounded size; each chunk is packed on its own, so a task
holds one chunk, and what chunking costs is at most the last few open bins of each.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palate.llm import bpe
from palate.llm.common import materialise

CAPACITY = 2048
CHUNK = 20_000


def pieces(
    docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text",
    keep_ids: bool = True,
) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32[, ids]): each text's ids with the end id, cut at ``capacity``.

    A null or empty text is the end id alone. Repeated rows give their pieces again; a null id stays null. ``ids`` is
    the piece's ids as little-endian unsigned 32-bit bytes. An empty table gives an empty table.
    """
    ddl = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bpe.word_encoder(tokenizer)
        for batch in batches:
            cols: list[list] = [[] for _ in range(5 + keep_ids)]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encoder.encode(text.as_py()) + bpe.END
                for p, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    row = (doc, p, at // 4, len(part) // 4, zlib.crc32(part), part)
                    for c, v in zip(cols, row, strict=False):
                        c.append(v)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(cols)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=False)], names=names)

    return docs.select(docs[id_col].cast("long"), docs[text_col]).mapInArrow(run, ddl)


def place(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length (1 to capacity), placed longest first by the sum-of-squares rule.

    ``open_bins[g]`` counts open bins with gap g. Using a bin of gap g for a piece of length s changes the sum of
    squares by 2 * (open_bins[g - s] - open_bins[g] + 1), without the first term if the bin gets full. A new bin is
    opened only where no open one has room: with lengths known beforehand, that needs fewer bins than weighing a new
    bin by its square too. Ties go to the tightest bin.
    """
    order = np.argsort(-lengths, kind="stable")
    open_bins = np.zeros(capacity + 1, dtype=np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
    made = 0
    for i in order:
        s = int(lengths[i])
        before = open_bins[s:]
        fits = np.flatnonzero(before)
        if len(fits):
            change = 2 * (open_bins[fits] - before[fits]) + 2
            if fits[0] == 0:
                change[0] = 1 - 2 * before[0]  # a full bin is no longer open
            k = int(fits[change.argmin()])
            b = stacks[k + s].pop()
            open_bins[k + s] -= 1
        else:
            k = capacity - s
            b, made = made, made + 1
        bins[i], offsets[i] = b, capacity - k - s
        if k:
            stacks[k].append(b)
            open_bins[k] += 1
    return bins, offsets


def pack(parts: DataFrame, capacity: int = CAPACITY, chunk: int = CHUNK) -> DataFrame:
    """``parts`` (with doc_id, piece, ids_crc32, length in 1 to ``capacity``) with sequence_id and offset.

    ``parts`` is read twice (counted, then packed), so hand in a written table. Chunks number one for every ``chunk``
    pieces; a piece's chunk follows from a hash of its id, number and content, so hot documents spread. Repeated
    rows are packed once each. Columns named sequence_id or offset are replaced.
    """
    parts = parts.drop("sequence_id", "offset")
    full = parts.where(F.col("length") == capacity)
    rest = parts.where(F.col("length") < capacity)
    n = max(1, -(-rest.count() // chunk))
    names = parts.columns

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        k = int(pdf["__chunk"].iloc[0])
        pdf = pdf.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True])
        bins, offsets = place(pdf["length"].to_numpy(), capacity)
        # even numbers: packed bins; odd numbers: full pieces
        return pdf[names].assign(sequence_id=2 * (bins * n + k), offset=offsets)

    key = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "length"), F.lit(n)).cast("int")
    packed = (
        rest.withColumn("__chunk", key)
        .groupBy("__chunk")
        .applyInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema) + ", sequence_id long, offset long")
    )
    alone = full.withColumns({"sequence_id": 2 * F.monotonically_increasing_id() + 1, "offset": F.lit(0).cast("long")})
    return packed.unionByName(alone)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """Tokenize, cut and pack ``docs``; with ``keep_ids`` each row carries its token ids as well."""
    return pack(materialise(pieces(docs, tokenizer, capacity, keep_ids=keep_ids), "pieces"), capacity)
