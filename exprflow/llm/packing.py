"""Harmonic packing of token sequences, independently across workers.

The capacity has reciprocal classes: class k takes pieces longer than capacity / (k + 1), of which any k fit into a
sequence. A document is cut into whole sequences and a tail. A tail that k times fills a sequence but for ``max_waste`` of it
stays whole in class k; of any other, a piece of just capacity / (k + 1) is cut off for class k + 1, and the rest, which is
shorter than that by a factor of k, is treated alike. So most tails need no cut or one. A piece's place is its number in its class:
sequence number // k, slot number % k. Workers number their own pieces; the only data that meets is one row of counts for each
worker and class. What the last, open sequence of each class holds (k - 1 pieces at most, some 10,000 over all classes
of 2048, whatever the input) is packed first-fit in order of length.

``min_cut`` cuts into powers of two instead, which leaves no padding but makes many more pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .arrowtext import slices
from .tokens import ENCODE_BYTES, encoder

CAPACITY, END_ID = 2048, 1
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, class long, worker long, number long"


def cut_reciprocal(lengths: np.ndarray, capacity: int, waste: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, length) of each piece, in order of document and start; a class's sequence lacks ``waste`` tokens at most, plus rounding."""
    whole = lengths // capacity
    d = np.repeat(np.arange(len(lengths)), whole)
    docs, starts, sizes = [d], [(np.arange(len(d)) - np.repeat(np.cumsum(whole) - whole, whole)) * capacity], [np.full(len(d), capacity)]
    at, rest = whole * capacity, lengths % capacity
    live = np.flatnonzero(rest)
    while len(live):
        r = rest[live]
        k = capacity // r
        size = np.where(capacity - k * r <= waste, r, np.minimum(r, np.maximum(1, capacity // (k + 1))))
        docs.append(live)
        starts.append(at[live])
        sizes.append(size)
        at[live] += size
        rest[live] -= size
        live = live[r > size]
    d, s, n = (np.concatenate(x).astype(np.int64) for x in (docs, starts, sizes))
    order = np.lexsort((s, d))
    return d[order], s[order], n[order]


def cut(lengths: np.ndarray, capacity: int, min_cut: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, length) of each piece, in order of document and start; tails become powers of two."""
    docs, starts, sizes = [], [], []
    whole = lengths // capacity
    d = np.repeat(np.arange(len(lengths)), whole)
    first = np.cumsum(whole) - whole
    docs.append(d)
    starts.append((np.arange(len(d)) - np.repeat(first, whole)) * capacity)
    sizes.append(np.full(len(d), capacity))
    at, rest, size = whole * capacity, lengths % capacity, capacity // 2
    while size >= min_cut and size:
        has = np.flatnonzero(rest >= size)
        docs.append(has)
        starts.append(at[has])
        sizes.append(np.full(len(has), size))
        at[has] += size
        rest[has] -= size
        size //= 2
    has = np.flatnonzero(rest)
    docs.append(has)
    starts.append(at[has])
    sizes.append(rest[has])
    d, s, n = (np.concatenate(x).astype(np.int64) for x in (docs, starts, sizes))
    order = np.lexsort((s, d))
    return d[order], s[order], n[order]


def _pieces(capacity: int, min_cut: int | None, waste: int, end_id: int, path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        worker, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for part in slices(batches, "text", ENCODE_BYTES):
            offsets, ids = encoder(path).encode(part.column("text"))
            n = np.diff(offsets) + 1
            ends = np.cumsum(n)
            flat = np.full(ends[-1], end_id, np.uint32)
            inside = np.ones(len(flat), bool)
            inside[ends - 1] = False
            flat[inside] = ids
            d, start, size = cut_reciprocal(n, capacity, waste) if min_cut is None else cut(n, capacity, min_cut)
            raw = memoryview(flat.tobytes())
            at = (ends[d] - n[d] + start) * 4
            crc = [zlib.crc32(raw[a:b]) for a, b in zip(at.tolist(), (at + 4 * size).tolist(), strict=True)]
            kind = capacity // size
            order = np.argsort(kind, kind="stable")
            k = kind[order]
            first = np.concatenate(([True], k[1:] != k[:-1]))
            number = np.empty(len(k), np.int64)
            number[order] = np.arange(len(k)) - np.flatnonzero(first)[np.cumsum(first) - 1] + seen[k]
            seen += np.bincount(kind, minlength=capacity + 1)
            doc_id = part.column("doc_id").take(pa.array(d))
            rest = [start, size, np.array(crc), n[d], kind, np.full(len(d), worker), number]
            yield pa.RecordBatch.from_arrays([doc_id, *(pa.array(x, pa.int64()) for x in rest)], names=[c.split()[0] for c in PIECES.split(", ")])

    return run


def first_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each piece, longest first, each into the first sequence with room."""
    used: list[int] = []
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    first_open, last = 0, 0
    for i in np.argsort(-lengths, kind="stable"):
        n = int(lengths[i])
        if n != last:
            first_open, last = 0, n  # pieces of one length never fit before where the last one went
        while first_open < len(used) and used[first_open] + n > capacity:
            first_open += 1
        if first_open == len(used):
            used.append(0)
        sequence[i], offset[i] = first_open, used[first_open]
        used[first_open] += n
    return sequence, offset


def _close(capacity: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in ("class", "place")])
        sequence, offset = first_fit(table["length"].to_numpy(), capacity)
        kept = table.select([c.split()[0] for c in PIECES.split(", ")[:5]])
        return kept.append_column("sequence_id", pa.array(-1 - sequence)).append_column("offset", pa.array(offset))

    return run


def pack(
    docs: DataFrame, capacity: int = CAPACITY, max_waste: float = 1 / 32, min_cut: int | None = None, end_id: int = END_ID, tokenizer: str | None = None
) -> DataFrame:
    """Return per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is a document of the end id alone. Rows with equal or null doc_id are documents of
    their own, packed each. Other columns are ignored. An empty table gives no pieces. A sequence of a class lacks at most
    ``max_waste`` of the capacity, or as many tokens as it has pieces. With ``min_cut``, tails are cut into powers of two down to it;
    with ``min_cut`` 1 and a capacity that is a power of two no sequence is padded, as each is full or ends at a power of two.
    """
    names = [c.split()[0] for c in PIECES.split(", ")[:5]]
    made = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_pieces(capacity, min_cut, int(max_waste * capacity), end_id, tokenizer), PIECES)
    pieces = materialize(made, "pack-pieces")
    counts = pieces.groupBy("class", "worker").agg(F.count("*").alias("n"))
    before = Window.partitionBy("class").orderBy("worker").rowsBetween(Window.unboundedPreceding, -1)
    places = counts.select(
        "class", "worker", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"), F.sum("n").over(Window.partitionBy("class")).alias("total")
    )
    k, g = F.col("class"), F.col("place")
    bin_, slot = F.floor(g / k), g % k
    whole = bin_ < F.floor(F.col("total") / k)
    placed = pieces.join(places, ["class", "worker"]).withColumn("place", F.col("base") + F.col("number"))
    if min_cut == 1:
        # in the open sequence of a class, slots are grouped by the binary digits of how many there are
        left = F.when(whole, k).otherwise(F.col("total") % k)
        group, base = F.lit(0), F.lit(0).cast("long")
        for power in (1 << i for i in range(capacity.bit_length())):
            higher = left.bitwiseAND(F.lit(-2 * power))
            here = (left.bitwiseAND(F.lit(power)) > 0) & (slot >= higher) & (slot < higher + power)
            group, base = F.when(here, power).otherwise(group), F.when(here, higher).otherwise(base)
        sequence = (bin_ * (capacity + 1) + k) * (2 * capacity) + F.when(whole, F.lit(0)).otherwise(group)
        inside = F.when(whole, slot).otherwise(slot - base)
        return placed.select(*names, sequence.cast("long").alias("sequence_id"), (inside * F.col("length")).cast("long").alias("offset"))
    full = placed.where(whole).select(*names, "place", (bin_ * (capacity + 1) + k).cast("long").alias("sequence_id"))
    earlier = Window.partitionBy("sequence_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    full = full.select(*names, "sequence_id", F.coalesce(F.sum("length").over(earlier), F.lit(0)).cast("long").alias("offset"))
    # fewer than k pieces of each class k: a number that doesn't depend on the input
    rest = placed.where(~whole).select(*names, "class", "place").groupBy().applyInArrow(_close(capacity), ", ".join(PIECES.split(", ")[:5]) + ", sequence_id long, offset long")
    return full.unionByName(rest)
