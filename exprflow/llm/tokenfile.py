"""Token ids as files of fixed-width packed integers, with block offsets for random access.

A data set is a folder of shards in doc_id order. A shard is

    magic ``TOKBITS1``, then the ids, ``bits`` each, little end first, in blocks of ``BLOCK_IDS`` ids,
    each block starting at a whole byte; then the footer: as int64 the byte offset of each block, the
    end of each document in ids, and each doc_id; last seven int64: bits, ids per block, ids, blocks,
    documents, how many of them (the first ones) have a doc_id, position of the footer.

Any block can be read and unpacked alone: its bytes are one ``numpy.unpackbits`` of known shape. A shard's
name is unique to the attempt that wrote it; the manifest, written by Spark, names the shards that
count, so retried and speculative tasks leave nothing that is read.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cores, scratch_path
from .arrowtext import slices
from .tokens import ENCODE_BYTES, encoder

MAGIC, BLOCK_IDS, END_ID, VOCABULARY = b"TOKBITS1", 1 << 16, 2, 49_408
#: Bytes of text in a shard, about; a small table has a shard for each task slot.
SHARD_BYTES = 256 << 20
TAIL = 7 * 8
MANIFEST = "shard long, file string, n_docs long, n_tokens long, bits int"


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    """The ids in ``bits`` bits each, little end first, up to a whole byte."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    each = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits]
    return np.packbits(each.ravel(), bitorder="little").tobytes()


def unpack_bits(data: bytes, bits: int, n: int) -> np.ndarray:
    """The first ``n`` ids of what pack_bits made, as uint32."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype(np.uint32)
    each = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")[: n * bits].reshape(n, bits)
    wide = np.zeros((n, 32), np.uint8)
    wide[:, :bits] = each
    return np.packbits(wide, axis=1, bitorder="little").view("<u4").ravel()


class ShardWriter:
    """Writes one shard; documents are added in order."""

    def __init__(self, stream, bits: int):
        self.out, self.bits, self.at = stream, bits, len(MAGIC)
        self.blocks: list[int] = []
        self.ends: list[np.ndarray] = []
        self.ids: list[np.ndarray] = []
        self.rest, self.total, self.named = np.zeros(0, np.uint32), 0, 0
        self.out.write(MAGIC)

    def _put(self, ids: np.ndarray) -> None:
        data = pack_bits(ids, self.bits)
        self.blocks.append(self.at)
        self.out.write(data)
        self.at += len(data)

    def add(self, doc_ids: pa.Array, lengths: np.ndarray, flat: np.ndarray) -> None:
        """Documents in order, those with a null doc_id after all others."""
        self.ends.append(self.total + np.cumsum(lengths))
        self.ids.append(doc_ids.fill_null(0).to_numpy(zero_copy_only=False))
        self.named += len(doc_ids) - doc_ids.null_count
        self.total += len(flat)
        flat = np.concatenate((self.rest, flat))
        whole = len(flat) // BLOCK_IDS * BLOCK_IDS
        for i in range(0, whole, BLOCK_IDS):
            self._put(flat[i : i + BLOCK_IDS])
        self.rest = flat[whole:]

    def close(self) -> None:
        if len(self.rest):
            self._put(self.rest)
        n_docs = sum(map(len, self.ids))
        for x in (self.blocks, *self.ends, *self.ids, (self.bits, BLOCK_IDS, self.total, len(self.blocks), n_docs, self.named, self.at)):
            self.out.write(np.asarray(x, "<i8").tobytes())


class ShardReader:
    """Random access to a shard."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        tail = np.frombuffer(file.read_at(TAIL, size - TAIL), "<i8")
        self.bits, self.block_ids, self.total, n_blocks, n_docs, self.named, self.footer = map(int, tail)
        index = np.frombuffer(file.read_at(size - TAIL - self.footer, self.footer), "<i8")
        self.blocks = np.append(index[:n_blocks], self.footer)
        self.ends = index[n_blocks : n_blocks + n_docs]
        self.doc_ids = pa.array(index[n_blocks + n_docs :], mask=np.arange(n_docs) >= self.named)

    def block(self, k: int) -> np.ndarray:
        n = min(self.block_ids, self.total - k * self.block_ids)
        return unpack_bits(self.file.read_at(int(self.blocks[k + 1] - self.blocks[k]), int(self.blocks[k])), self.bits, n)

    def ids(self, start: int, end: int) -> np.ndarray:
        """Ids ``start`` to ``end`` of the shard, by the blocks that hold them."""
        if end <= start:
            return np.zeros(0, np.uint32)
        a, b = start // self.block_ids, (end - 1) // self.block_ids
        got = np.concatenate([self.block(k) for k in range(a, b + 1)])
        return got[start - a * self.block_ids : end - a * self.block_ids]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.ends[i - 1]) if i else 0, int(self.ends[i]))


def _writer(folder: str, bits: int, end_id: int, path: str | None) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, writer = TaskContext.get().partitionId(), None
        fs, root = pa.fs.FileSystem.from_uri(folder)
        name = f"shard-{shard:06d}-{uuid.uuid4().hex}.tok"
        for part in slices(batches, "text", ENCODE_BYTES):
            if writer is None:
                fs.create_dir(root, recursive=True)
                stream = fs.open_output_stream(f"{root}/{name}")
                writer = ShardWriter(stream, bits)
            offsets, ids = encoder(path).encode(part.column("text"))
            n = np.diff(offsets) + 1
            flat = np.full(int(n.sum()), end_id, np.uint32)
            inside = np.ones(len(flat), bool)
            inside[np.cumsum(n) - 1] = False
            flat[inside] = ids
            if len(flat) and int(flat.max()) >> bits:
                raise ValueError(f"an id needs more than {bits} bits")
            writer.add(part.column("doc_id"), n, flat)
        if writer:
            writer.close()
            stream.close()
            row = [[shard], [name], [sum(map(len, writer.ids))], [writer.total], [bits]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(row, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int32()), strict=True)],
                names=["shard", "file", "n_docs", "n_tokens", "bits"],
            )

    return run


def write_tokens(
    docs: DataFrame, folder: str, vocabulary: int = VOCABULARY, end_id: int = END_ID, tokenizer: str | None = None, shards: int | None = None
) -> DataFrame:
    """Write the ids of ``docs`` (doc_id, text) below ``folder``, a URI that executors reach; return the manifest.

    Documents are range-partitioned and sorted by doc_id; each range is a shard. A null text is its
    end id alone. Rows without doc_id follow all others; rows that share a doc_id, or have none, follow each other by a hash of
    the text and the text, so that many of them spread over shards. Other columns are ignored. An empty table writes an empty manifest.
    """
    bits = max(1, int(vocabulary - 1).bit_length())
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    size = 0 if shards else rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = shards or max(cores(docs.sparkSession), math.ceil(size / SHARD_BYTES))
    order = [F.asc_nulls_last("doc_id"), F.xxhash64("text")]
    ordered = rows.repartitionByRange(n, *order).sortWithinPartitions(*order, "text")
    written = ordered.mapInArrow(_writer(folder, bits, end_id, tokenizer), MANIFEST)
    written.write.parquet(f"{folder}/manifest")
    return docs.sparkSession.read.parquet(f"{folder}/manifest")


def _reader(folder: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fs, root = pa.fs.FileSystem.from_uri(folder)
                with fs.open_input_file(f"{root}/{row['file']}") as file:
                    reader = ShardReader(file)
                    at, step = 0, 4 << 20
                    while at < len(reader.ends):  # runs of documents of at most ``step`` ids, or one document
                        base = int(reader.ends[at - 1]) if at else 0
                        end = max(at + 1, int(np.searchsorted(reader.ends, base + step, "right")))
                        ends = reader.ends[at:end] - base
                        raw = memoryview(reader.ids(base, int(reader.ends[end - 1])).astype("<u4").tobytes())
                        starts = np.concatenate(([0], ends[:-1]))
                        crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                        n = len(ends)
                        yield pa.RecordBatch.from_arrays(
                            [reader.doc_ids[at:end], pa.array(row["shard"] + np.zeros(n, np.int64)), pa.array(base + starts), pa.array(ends - starts), pa.array(crc, pa.int64())],
                            names=["doc_id", "shard", "local_start", "n_tokens", "ids_crc32"],
                        )
                        at = end

    return run


def read_digests(spark: SparkSession, folder: str) -> DataFrame:
    """Read the files of ``folder`` back: doc_id, start (ids of all documents before), n_tokens, ids_crc32."""
    manifest = spark.read.parquet(f"{folder}/manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = manifest.select("shard", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"))
    shards = max(1, manifest.count())  # a stated number of partitions, as a manifest is too small to be split by size
    read = manifest.repartition(shards, "shard").mapInArrow(
        _reader(folder), "doc_id long, shard long, local_start long, n_tokens long, ids_crc32 long"
    )
    return read.join(F.broadcast(bases), "shard").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def token_digests(docs: DataFrame, **options) -> DataFrame:
    """Write the ids of ``docs`` into new files in the shared folder and return what the files hold."""
    spark = docs.sparkSession
    folder = scratch_path(spark, "tokens")
    write_tokens(docs, folder, **options)
    return read_digests(spark, folder)
