"""Token ids in sorted-string-table shards.

A shard holds documents in key order. Keys (8 bytes that sort as the ids do) are prefix-compressed within blocks of
about BLOCK bytes; a sparse index has each block's last key and place; a Bloom filter answers most misses; a footer
of fixed size finds both. ``lookup`` reads the footer, the filter and the index, then one block.

Layout: blocks | index | filter | footer. An entry is varint(shared key bytes), varint(other key bytes),
varint(value bytes), key bytes, value. A block is deflated and ends with its crc32. A value is a width byte (2 or 4)
and ids of so many bytes, little-endian; vocabularies under 65,536 ids need two.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palate.llm import bpe
from palate.llm.common import shared_path

BLOCK = 256 * 1024
BITS_PER_KEY = 10
PROBES = 7
MAGIC = b"PLTSST01"
FOOTER = "<QQQQQQ8s"
FOOTER_SIZE = struct.calcsize(FOOTER)
#: Characters of text a shard gets, about; a shard is written and read as a stream of blocks.
SHARD_CHARS = 16_000_000


def encode_key(doc_id: int | None) -> bytes:
    """Null sorts first; others as signed 64-bit numbers."""
    return b"\0" if doc_id is None else b"\1" + ((doc_id + (1 << 63)) & ((1 << 64) - 1)).to_bytes(8, "big")


def decode_key(key: bytes) -> int | None:
    return None if key == b"\0" else int.from_bytes(key[1:], "big") - (1 << 63)


def encode_ids(ids: bytes) -> bytes:
    """A value from little-endian unsigned 32-bit ids, two bytes each where they all fit."""
    wide = np.frombuffer(ids, dtype="<u4")
    return b"\2" + wide.astype("<u2").tobytes() if not len(wide) or wide.max() < 65536 else b"\4" + ids


def decode_ids(value: bytes) -> bytes:
    return np.frombuffer(value, dtype="<u2", offset=1).astype("<u4").tobytes() if value[0] == 2 else value[1:]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


class Bloom:
    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @staticmethod
    def _places(keys: list[bytes], size: int) -> np.ndarray:
        h = np.array([xxhash.xxh3_64_intdigest(k) for k in keys], dtype=np.uint64)
        low, high = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
        probes = low[:, None] + np.arange(PROBES, dtype=np.uint64)[None, :] * high[:, None]
        return (probes % np.uint64(size)).astype(np.int64)

    @classmethod
    def of(cls, keys: list[bytes]) -> Bloom:
        size = max(64, -(-len(keys) * BITS_PER_KEY // 8) * 8)
        flags = np.zeros(size, dtype=np.uint8)
        if keys:
            flags[cls._places(keys, size).ravel()] = 1
        return cls(np.packbits(flags))

    def __contains__(self, key: bytes) -> bool:
        at = self._places([key], len(self.bits) * 8)[0]
        return bool(((self.bits[at >> 3] >> (7 - (at & 7))) & 1).all())


class Writer:
    """Streams entries in key order to ``out``; keeps the index and the keys' hashes, not the values."""

    def __init__(self, out):
        self.out, self.at = out, 0
        self.block, self.last = bytearray(), b""
        self.index: list[tuple[bytes, int, int]] = []
        self.keys: list[bytes] = []
        self.tokens = self.entries = 0

    def add(self, key: bytes, value: bytes) -> None:
        if self.entries and key < self.keys[-1]:
            raise ValueError("keys must ascend")
        shared = 0
        if self.block:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.last = key
        self.keys.append(key)
        self.entries += 1
        self.tokens += (len(value) - 1) // value[0]
        if len(self.block) >= BLOCK:
            self._flush()

    def _put(self, data: bytes) -> tuple[int, int]:
        at = self.at
        self.out.write(data)
        self.at += len(data)
        return at, len(data)

    def _flush(self) -> None:
        if self.block:
            data = zlib.compress(bytes(self.block), 1)
            self.index.append((self.last, *self._put(data + zlib.crc32(data).to_bytes(4, "little"))))
            self.block, self.last = bytearray(), b""

    def close(self) -> None:
        self._flush()
        index = b"".join(_varint(len(k)) + k + _varint(at) + _varint(size) for k, at, size in self.index)
        where, size = self._put(index)
        bloom, bloom_size = self._put(Bloom.of(self.keys).bits.tobytes())
        self._put(struct.pack(FOOTER, where, size, bloom, bloom_size, self.entries, self.tokens, MAGIC))


class Reader:
    """One shard, through a seekable file object."""

    def __init__(self, file, size: int):
        self.file = file
        where, length, bloom, bloom_size, self.entries, self.tokens, magic = struct.unpack(
            FOOTER, self._get(size - FOOTER_SIZE, FOOTER_SIZE)
        )
        if magic != MAGIC:
            raise ValueError("not a token shard")
        self.bloom = Bloom(np.frombuffer(self._get(bloom, bloom_size), dtype=np.uint8))
        self.index: list[tuple[bytes, int, int]] = []
        data, at = self._get(where, length), 0
        while at < len(data):
            n, at = _read_varint(data, at)
            key = data[at : at + n]
            place, at = _read_varint(data, at + n)
            n, at = _read_varint(data, at)
            self.index.append((key, place, n))

    def _get(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        return self.file.read(size)

    def block(self, number: int) -> Iterator[tuple[bytes, bytes]]:
        _, place, size = self.index[number]
        data = self._get(place, size)
        if zlib.crc32(data[:-4]) != int.from_bytes(data[-4:], "little"):
            raise ValueError(f"block {number} is damaged")
        data = zlib.decompress(data[:-4])
        at, key, end = 0, b"", len(data)
        while at < end:
            shared, at = _read_varint(data, at)
            other, at = _read_varint(data, at)
            size, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + other]
            at += other
            yield key, data[at : at + size]
            at += size

    def __iter__(self) -> Iterator[tuple[bytes, bytes]]:
        for i in range(len(self.index)):
            yield from self.block(i)

    def lookup(self, doc_id: int | None) -> list[bytes]:
        """Values under an id, in order: filter, binary search in the index, then the blocks that hold the key."""
        key, found = encode_key(doc_id), []
        if key not in self.bloom:
            return found
        at = bisect_left(self.index, key, key=lambda x: x[0])
        while at < len(self.index):
            for k, v in self.block(at):
                if k > key:
                    return found
                if k == key:
                    found.append(v)
            at += 1
        return found


def open_fs(uri: str) -> tuple[arrow_fs.FileSystem, str]:
    return arrow_fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def write_shards(
    docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
    shard_chars: int = SHARD_CHARS,
) -> DataFrame:
    """Write ``docs`` as shards under ``path`` (a URI all executors reach) and return their manifest, a table in
    ``path``/manifest: (shard, file, bytes, docs, tokens, first, last).

    Documents are dealt by ranges of their id and sorted, so shard order is id order; each range streams into one
    file under a temporary name that is renamed when whole, so a task that runs again replaces its own file. Texts
    are encoded whole and get the end id; null texts are the end id alone. Null ids sort first; rows that repeat an
    id are all kept, ordered by text. An empty table gives an empty manifest.
    """
    base = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    chars = base.agg(F.sum(F.char_length("text"))).first()[0] or 0
    n = max(1, -(-chars // shard_chars))
    ddl = "shard int, file string, bytes long, docs long, tokens long, first long, last long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        fs, where = open_fs(path)
        fs.create_dir(where, recursive=True)
        shard = task.partitionId()
        name = f"shard-{shard:06d}.sst"
        temporary = f"{where}/.{name}.{task.taskAttemptId()}"
        encoder = bpe.byte_encoder(tokenizer)
        writer, first, last = None, None, None
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if writer is None:
                    out = fs.open_output_stream(temporary)
                    writer, first = Writer(out), doc
                writer.add(encode_key(doc), encode_ids(encoder.encode(text.as_py()) + bpe.END))
                last = doc
        if writer is None:
            return
        writer.close()
        out.close()
        fs.move(temporary, f"{where}/{name}")
        row = [shard, name, writer.at, writer.entries, writer.tokens, first, last]
        kinds = [pa.int32(), pa.string(), *[pa.int64()] * 5]
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names=ddl_names)

    ddl_names = [x.split()[0] for x in ddl.split(", ")]
    ranged = base.repartitionByRange(n, F.col("id").asc_nulls_first()).sortWithinPartitions(
        F.col("id").asc_nulls_first(), F.col("text").asc_nulls_first()
    )
    ranged.mapInArrow(run, ddl).write.parquet(f"{path}/manifest")
    return docs.sparkSession.read.parquet(f"{path}/manifest")


def read_shards(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """Documents of the shards that the manifest under ``path`` names, read block by block: (doc_id, start,
    n_tokens, ids_crc32[, ids]). ``start`` counts the ids of all documents before, over all shards."""
    manifest = spark.read.parquet(f"{path}/manifest").select("shard", "file", "bytes", "tokens")
    # One small row a shard; running totals without one task over all: each shard joins the shards before it by groups.
    width = 256
    group = F.floor(F.col("shard") / width)
    m = manifest.withColumn("g", group)
    groups = m.groupBy("g").agg(F.sum("tokens").alias("t"))
    from pyspark.sql import Window

    before = F.coalesce(F.sum("t").over(Window.orderBy("g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = groups.select("g", before.alias("g_before"))
    inner = F.coalesce(
        F.sum("tokens").over(Window.partitionBy("g").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    placed = m.withColumn("inner", inner).join(groups, "g").select(
        "shard", "file", "bytes", (F.col("inner") + F.col("g_before")).alias("before")
    )
    ddl = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * ids
    kinds = [pa.int64()] * 4 + [pa.binary()] * ids
    names = ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(kinds)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, where = open_fs(path)
        for batch in batches:
            for row in batch.to_pylist():
                start = row["before"]
                with fs.open_input_file(f"{where}/{row['file']}") as file:
                    reader = Reader(file, row["bytes"])
                    for number in range(len(reader.index)):
                        cols: list[list] = [[] for _ in kinds]
                        for key, value in reader.block(number):
                            value = decode_ids(value)
                            got = (decode_key(key), start, len(value) // 4, zlib.crc32(value), value)
                            for c, v in zip(cols, got, strict=False):
                                c.append(v)
                            start += len(value) // 4
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names
                        )

    shards = placed.repartition(max(1, min(placed.count(), 4096)), "shard")
    return shards.mapInArrow(run, ddl)


def find(spark: SparkSession, path: str, doc_ids: Iterable[int]) -> dict[int, list[np.ndarray]]:
    """Token ids under each of a few ``doc_ids``: only shards whose key range holds one are opened."""
    fs, where = open_fs(path)
    out: dict[int, list[np.ndarray]] = {}
    manifest = spark.read.parquet(f"{path}/manifest")
    for doc in doc_ids:
        hit = manifest.where((F.col("first") <= doc) & (F.col("last") >= doc)).orderBy("shard").toLocalIterator()
        found = out.setdefault(doc, [])
        for row in hit:
            with fs.open_input_file(f"{where}/{row['file']}") as file:
                found += [np.frombuffer(decode_ids(v), dtype="<u4") for v in Reader(file, row["bytes"]).lookup(doc)]
    return out


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write ``docs`` to shards in the shared folder and read them back: (doc_id, start, n_tokens, ids_crc32)."""
    path = shared_path(docs.sparkSession, "shards")
    write_shards(docs, path, tokenizer)
    return read_shards(docs.sparkSession, path, ids=False)
