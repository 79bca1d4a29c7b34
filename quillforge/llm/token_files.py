"""Token-id output: blocks of concatenated ids with Elias-Fano coded document boundaries.

Documents in ascending doc_id order are dealt into shards by ranges of doc_id; a shard is a sequence of blocks of about
BLOCK_IDS ids, and a block is one binary value:

    4 bytes   "QFT2"
    <q q q q  documents, ids, ids before this block in its shard, bytes of one id (2 or 4)
    <q Q ?    first doc_id, the last one less the first, and whether doc_ids are known (else all are null)
    the documents' ends, then their doc_ids less the first (if known), both Elias-Fano coded (see EliasFano)
    the ids, little-endian

Doc_ids and ends ascend, so neither takes a table of 64-bit numbers, and a document's doc_id, start and end are read by
select, without decoding the others. Blocks are written by Spark's own writer, so a task that is lost or run twice leaves no trace, and any file system will do.
The only global quantity, how many ids lie before each shard, is summed over one row a shard.
"""

from __future__ import annotations

import bisect
import itertools
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillforge.llm.common import in_ranges, sent_if_small, shared_folder, shuffle_partitions, stage_table, table, tuned
from quillforge.llm.tokens import encoder

BLOCK_IDS = 1 << 20
TOKENIZER, END_ID = "byte_bpe_50k.json", 2
_MAGIC, _HEAD = b"QFT2", struct.Struct("<qqqqqQ?")


class EliasFano:
    """A non-decreasing sequence of n integers up to `universe` in about n (2 + log2(universe / n)) bits.

    Each value's low bits stand in a packed array. Its high part is kept in unary: bit (high + i) is set for value i.
    A directory, stored with them, holds the place of every STEP-th set bit, so that select(i) reads only a few bytes."""

    STEP = 256

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, directory: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.directory = n, low_bits, low, high, directory

    @staticmethod
    def width(n: int, universe: int) -> int:
        return max(0, (max(universe, 1) // max(n, 1)).bit_length() - 1)

    @classmethod
    def encode(cls, values: np.ndarray, universe: int) -> EliasFano:
        values = np.asarray(values, "<u8")
        n, bits = len(values), cls.width(len(values), universe)
        low = np.unpackbits(values.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")[:, :bits]
        high = np.zeros(n + (universe >> bits) + 1, np.uint8)
        places = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        high[places] = 1
        return cls(n, bits, np.packbits(low.reshape(-1), bitorder="little").tobytes(), np.packbits(high, bitorder="little").tobytes(), places[:: cls.STEP].astype("<u4"))

    def pack(self) -> bytes:
        return b"".join([self.low, self.high, self.directory.tobytes()])

    @classmethod
    def unpack(cls, block: bytes, at: int, n: int, universe: int) -> tuple[EliasFano, int]:
        """The sequence that stands at `at`, and where it ends; nothing is decoded."""
        bits = cls.width(n, universe)
        low = at + (n * bits + 7) // 8
        high = low + (n + (universe >> bits) + 1 + 7) // 8
        steps = -(-n // cls.STEP)
        return cls(n, bits, block[at:low], block[low:high], np.frombuffer(block, "<u4", steps, high)), high + 4 * steps

    def select(self, i: int) -> int:
        """Value i, without decoding the others."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self.directory[i // self.STEP]), i % self.STEP
        # eight bytes at a time from the place of the STEP-th set bit before it
        found = int.from_bytes(self.high[at // 8 : at // 8 + 8], "little") >> (at % 8) << (at % 8)
        at -= at % 8
        while (ones := found.bit_count()) <= left:
            left, at = left - ones, at + 64
            found = int.from_bytes(self.high[at // 8 : at // 8 + 8], "little")
        for _ in range(left):
            found &= found - 1
        place = at + (found & -found).bit_length() - 1
        start = i * self.low_bits
        raw = int.from_bytes(self.low[start // 8 : (start + self.low_bits + 7) // 8], "little") >> (start % 8)
        return ((place - i) << self.low_bits) | (raw & ((1 << self.low_bits) - 1))


def pack(doc_ids: list[int | None], texts: list[bytes], kind: np.dtype, before: int) -> bytes:
    """One block of whole documents in ascending order of doc_id, given each one's ids as bytes."""
    lengths = np.array([len(t) // kind.itemsize for t in texts], np.int64)
    total = int(lengths.sum())
    parts = [EliasFano.encode(np.cumsum(lengths), total).pack()]
    first, reach, known = 0, 0, doc_ids[0] is not None
    if known:
        first, reach = doc_ids[0], doc_ids[-1] - doc_ids[0]
        parts.append(EliasFano.encode(np.array([d - first for d in doc_ids], np.uint64), reach).pack())
    return b"".join([_MAGIC, _HEAD.pack(len(texts), total, before, kind.itemsize, first, reach, known), *parts, *texts])


class Block:
    """A block of documents, read by selection: nothing is decoded until it is asked for."""

    def __init__(self, raw: bytes):
        if raw[:4] != _MAGIC:
            raise ValueError("not a block of token ids")
        self.n, total, self.before, width, self.first, reach, known = _HEAD.unpack_from(raw, 4)
        self.ends, at = EliasFano.unpack(raw, 4 + _HEAD.size, self.n, total)
        self.doc_ids = None
        if known:
            self.doc_ids, at = EliasFano.unpack(raw, at, self.n, reach)
        self.ids = np.frombuffer(raw, f"<u{width}", total, at)

    def doc_id(self, i: int) -> int | None:
        return None if self.doc_ids is None else self.first + self.doc_ids.select(i)

    def bounds(self, i: int) -> tuple[int, int]:
        return self.ends.select(i - 1) if i else 0, self.ends.select(i)

    def find(self, doc_id: int) -> range:
        """The documents with this doc_id, by binary search over select."""
        if self.doc_ids is None:
            return range(0)
        left = bisect.bisect_left(range(self.n), doc_id, key=self.doc_id)
        return range(left, bisect.bisect_right(range(self.n), doc_id, key=self.doc_id))


def _blocks(tokenizer: str, end_id: int):
    """Rows in order of (shard, doc_id) to blocks; a shard's rows all lie in one partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        end = np.array([end_id], encode.kind).tobytes()
        shard, number, before, held = None, 0, 0, 0
        ids: list[int | None] = []
        texts: list[bytes] = []

        def close() -> pa.RecordBatch:
            nonlocal number, before, held
            row = ([shard], [number], [held], [pack(ids, texts, encode.kind, before)])
            number, before, held = number + 1, before + held, 0
            ids.clear()
            texts.clear()
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.int64(), pa.int32(), pa.int64(), pa.binary()), strict=True)], names=["shard", "block", "n_ids", "payload"])

        for batch in batches:
            for s, doc, text in zip(batch.column("shard").to_pylist(), batch.column("doc_id").to_pylist(), encode.encode(batch.column("text").to_pylist()), strict=True):
                if s != shard or held >= BLOCK_IDS:
                    if texts:
                        yield close()
                    if s != shard:
                        shard, number, before = s, 0, 0
                ids.append(doc)
                texts.append(text + end)
                held += len(texts[-1]) // encode.kind.itemsize
        if texts:
            yield close()

    return run


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID) -> None:
    """Encode every row of docs and write blocks to path, in ascending doc_id order.

    Defined cases: a null text is empty (only the end id); rows with one doc_id go in order of their texts; null doc_ids
    come last; an empty table writes no blocks. Other columns are ignored."""
    tuned(docs.sparkSession, 256)
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs, order = in_ranges(docs, 8 * shuffle_partitions(docs.sparkSession))
    ordered = docs.withColumnRenamed("_range", "shard").repartition("shard").sortWithinPartitions("shard", *order)
    ordered.mapInArrow(_blocks(tokenizer, end_id), "shard long, block int, n_ids long, payload binary").write.option("compression", "zstd").parquet(path)


def read_token_files(spark, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens (with the end id), ids (array<int>) of each document."""
    return _read(spark, path, lambda ids: pa.array(ids, pa.list_(pa.int32())), "ids array<int>")


def _read(spark, path: str, make, column: str) -> DataFrame:
    blocks = spark.read.schema("shard long, block int, n_ids long, payload binary").parquet(path)
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n_ids"))
    base = shards.select("shard", (F.sum("n_ids").over(Window.orderBy("shard")) - F.col("n_ids")).alias("base"))
    placed = blocks.select("shard", "payload").join(sent_if_small(stage_table(base, "shards")), "shard").select("base", "payload")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, payload in zip(batch.column("base").to_pylist(), batch.column("payload"), strict=True):
                block = Block(payload.as_py())
                doc_ids = [block.doc_id(i) for i in range(block.n)]
                bounds = [0, *[block.ends.select(i) for i in range(block.n)]]
                starts = np.array(bounds[:-1]) + (base + block.before)
                made = make([block.ids[a:b] for a, b in itertools.pairwise(bounds)])
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(starts), pa.array(np.diff(bounds)), made], names=["doc_id", "start", "n_tokens", column.split()[0]])

    tuned(spark, 256)
    return placed.mapInArrow(run, f"doc_id long, start long, n_tokens long, {column}")


def summarise(spark, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit integers), read from the files."""
    return _read(spark, path, lambda ids: pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()), "ids_crc32 long")


def ids_of(spark, path: str, doc_id: int) -> list[list[int]]:
    """The ids of the documents with one doc_id, in order: a lookup that decodes nothing else in the blocks."""
    blocks = spark.read.schema("shard long, block int, n_ids long, payload binary").parquet(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, number, payload in zip(batch.column("shard").to_pylist(), batch.column("block").to_pylist(), batch.column("payload"), strict=True):
                block = Block(payload.as_py())
                for i in block.find(doc_id):
                    a, b = block.bounds(i)
                    yield pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([number], pa.int32()), pa.array([i]), pa.array([block.ids[a:b].tolist()], pa.list_(pa.int32()))], names=["shard", "block", "at", "ids"])

    found = blocks.select("shard", "block", "payload").mapInArrow(run, "shard long, block int, at long, ids array<int>")
    return [r["ids"] for r in found.orderBy("shard", "block", "at").collect()]


def encode_documents(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write docs to new token files in the shared folder and return what they hold."""
    spark = docs.sparkSession
    path = f"{shared_folder(spark)}/token-files-{uuid.uuid4().hex}"
    write_token_files(docs, path, tokenizer or public_tokenizers.path(TOKENIZER))
    return summarise(spark, path)


def op10_token_files(spark, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"))
