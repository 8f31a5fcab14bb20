"""Stupid-backoff scores of documents by an n-gram model of all other documents.

Documents are dealt into chunks of bounded size. A chunk counts its n-grams, as 64-bit hashes, and sends them as rows of some
dozens, by range of the hash. Dealt by range, these are exploded into (chunk, n-gram, count); the sum over all rows of an n-gram
is its place in the count table, which a window joins to each of the rows it was counted from, so that the count table and the exploded n-grams
share one exchange and one sort. What other chunks have too returns to each chunk, and a chunk sums its documents' scores. An n-gram comes from a chunk once at most, so the commonest word has no more rows than
there are chunks, spread like any other. A document's own counts are taken off, else no n-gram of it were unseen. Two n-grams share a hash
with a probability of 2**-64 a pair: of 1e13 different ones, a few million would.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cores
from .arrowtext import Words, split_words, windows

#: Bytes of text in a chunk, and of text whose n-grams a partition of the count table holds; partitions of either kind, at most.
CHUNK_BYTES, COUNT_BYTES, MAX_PARTITIONS = 10 << 20, 16 << 20, 50_000
#: Bytes of text in a chunk for each range that it sends: some 80 n-grams.
RANGE_BYTES = 640
ALPHA = 0.4
_BIGRAM = np.uint64(0xA24BAED4963EE407)
#: Stands for any word at all, as an n-gram of no words.
_ANY = np.uint64(0x8B5AD4CE9D3A2F17)


def _grams(words: Words, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(number of the first word, hash) of the n-grams of each length up to ``order``; a word is an n-gram of 1."""
    out = [(np.arange(len(words.codes)), words.hashes())]
    with np.errstate(over="ignore"):
        for k in range(2, order + 1):
            _, at, h = windows(words, k)
            out.append((at, h ^ (_BIGRAM * np.array([k - 1], np.uint64))))
    return out


def _counted(words: Words, by_length: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The sorted n-grams of some texts, with _ANY, and their counts."""
    grams, n = np.unique(np.concatenate([np.full(1, _ANY), *(h for _, h in by_length)]), return_counts=True)
    n[np.searchsorted(grams, _ANY)] += len(words.codes) - 1
    return grams, n


def _starts(grams: np.ndarray, ranges: int) -> np.ndarray:
    """Where each range of the hash begins among sorted n-grams, and their number."""
    return np.searchsorted(grams >> np.uint64(64 - int(math.log2(ranges))), np.arange(ranges + 1, dtype=np.uint64))


def _send(ranges: int, order: int):
    def run(table: pa.Table) -> pa.Table:
        words = split_words(table["text"].combine_chunks(), lower=True)
        grams, n = _counted(words, _grams(words, order))
        ends = _starts(grams, ranges)
        some = np.flatnonzero(np.diff(ends))
        cuts = pa.array(np.append(ends[some], len(grams)), pa.int32())
        return pa.table(
            {
                "chunk": pa.array(np.full(len(some), table["chunk"][0].as_py()), pa.int64()),
                "range": pa.array(some, pa.int32()),
                "grams": pa.ListArray.from_arrays(cuts, pa.array(grams.view(np.int64))),
                "counts": pa.ListArray.from_arrays(cuts, pa.array(n, pa.int32())),
            }
        )

    return run


SENT = "chunk long, range int, grams array<long>, counts array<int>"


def _planes(x: np.ndarray) -> bytes:
    """Byte by byte over all numbers, so sorted numbers compress."""
    return np.ascontiguousarray(x.astype("<i8").view(np.uint8).reshape(len(x), 8).T).tobytes()


def _numbers(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<i8").ravel()


#: Rows that are packed at once on their way back.
PACK_ROWS = 1 << 20
FOUND = "chunk long, places binary, totals binary"


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (chunk, range, pos, total) as rows of a chunk with many places (range, pos) and totals."""

    def packed(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held)
        chunk, total = t["chunk"].to_numpy(), t["total"].to_numpy()
        place = t["range"].to_numpy().astype(np.int64) << 32 | t["pos"].to_numpy()
        order = np.lexsort((place, chunk))
        chunk, place, total = chunk[order], place[order], total[order]
        first = np.flatnonzero(np.concatenate(([True], chunk[1:] != chunk[:-1])))
        spans = list(zip(first.tolist(), [*first[1:].tolist(), len(chunk)], strict=True))
        for i in range(0, len(spans), 4096):
            some = spans[i : i + 4096]
            blobs = [pa.array([_planes(x[a:b]) for a, b in some], pa.binary()) for x in (place, total)]
            yield pa.RecordBatch.from_arrays([pa.array(chunk[[a for a, _ in some]]), *blobs], names=["chunk", "places", "totals"])

    held: list[pa.RecordBatch] = []
    rows = 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            rows += b.num_rows
        if rows >= PACK_ROWS:
            yield from packed(held)
            held, rows = [], 0
    if held:
        yield from packed(held)


def _own(owner: np.ndarray, gram: np.ndarray) -> np.ndarray:
    """How often the owner has each gram."""
    _, back, n = np.unique(owner << 32 | gram, return_inverse=True, return_counts=True)
    return n[back]


def _score(docs: pa.Table, found: pa.Table, order: int, ranges: int) -> pa.Table:
    words = split_words(docs["text"].combine_chunks(), lower=True)
    by_length = _grams(words, order)
    grams, total = _counted(words, by_length)
    total = total.astype(np.int64)  # right where no other chunk has the n-gram
    first = _starts(grams, ranges)
    for places, totals in zip(found["places"].to_pylist(), found["totals"].to_pylist(), strict=True):
        at = _numbers(places)
        total[first[at >> 32] + (at & 0xFFFFFFFF)] = _numbers(totals)
    n_all = int(total[np.searchsorted(grams, _ANY)])
    owner = words.owner
    rest = np.maximum(n_all - words.counts, 1)[owner].astype(float)
    for k, (at, h) in enumerate(by_length, 1):
        i = np.searchsorted(grams, h)
        c = total[i] - _own(owner[at], i)
        if k == 1:
            c1 = c
            logp = np.log10(np.maximum(c, 1) / rest) + np.where(c > 0, 0.0, math.log10(ALPHA))
            backed = np.zeros(len(c), bool)
        else:  # of the last word after the k - 1 before it, whose own count is context[at]
            last = at + k - 1
            logp[last] = np.where(c > 0, np.log10(np.maximum(c, 1) / np.maximum(context[at], 1)), logp[last] + math.log10(ALPHA))
            backed[last] = c == 0
        context = np.zeros(len(owner), np.int64)
        context[at] = c

    def per(x):
        s = np.concatenate(([0], np.cumsum(x)))
        return s[words.offsets[1:]] - s[words.offsets[:-1]]

    sums = np.array([logp[a:b].sum() for a, b in zip(words.offsets[:-1], words.offsets[1:], strict=True)])
    n = words.counts
    return pa.table(
        {
            "doc_id": docs["doc_id"],
            "n_words": pa.array(n, pa.int64()),
            "n_backoff": pa.array(per(backed), pa.int64()),
            "n_unseen": pa.array(per(c1 == 0), pa.int64()),
            "score": pa.array(sums / np.maximum(n, 1), pa.float64(), mask=n == 0),
        }
    )


def stupid_backoff(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES, order: int = 2) -> DataFrame:
    """Return per row of ``docs`` (doc_id, text): doc_id, n_words, n_backoff, n_unseen, score.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case. Counts are those of all other rows. A word after the ``order`` - 1
    words before it (or those there are) scores c(all of them) / c(those before) if all of them occur elsewhere, else 0.4 times
    what it scores after one word less. Alone it scores c(word) / words, or 0.4 / words if it occurs nowhere else.
    ``n_backoff`` counts the words whose longest n-gram occurs nowhere else. ``score`` is the mean log10 over the words, null
    without words. A repeated row is another row, so copies vouch for each other; rows alike in doc_id and text share a chunk.
    Other columns are ignored; an empty table gives an empty result.
    """
    if order < 2:
        raise ValueError("order must be 2 or more")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = max(1, math.ceil(size / chunk_bytes))
    partitions = min(max(math.ceil(size * (order / 2) / COUNT_BYTES), cores(docs.sparkSession)), MAX_PARTITIONS)
    ranges = 1 << math.ceil(math.log2(max(2, chunk_bytes / RANGE_BYTES, 8 * partitions)))
    dealt = docs.select("doc_id", "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).alias("chunk"))
    dealt = dealt.repartition(min(max(chunks, cores(docs.sparkSession)), MAX_PARTITIONS), "chunk")  # about a chunk a task, at any size
    sent = dealt.groupBy("chunk").applyInArrow(_send(ranges, order), SENT).repartition(partitions, "range")
    rows = sent.select("chunk", "range", F.posexplode(F.arrays_zip("grams", "counts")).alias("pos", "x")).select("chunk", "range", "pos", "x.grams", "x.counts")
    same = Window.partitionBy("range", "grams")  # the range is known from the hash, and keeps the rows where they are
    found = rows.select("chunk", "range", "pos", "counts", F.sum("counts").over(same).alias("total")).where("total > counts")
    found = found.select("chunk", "range", "pos", "total").mapInArrow(_pack, FOUND)

    def score(docs: pa.Table, found: pa.Table) -> pa.Table:
        return _score(docs, found, order, ranges)

    return dealt.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(
        score, "doc_id long, n_words long, n_backoff long, n_unseen long, score double"
    )


#: DuckDB SQL of stupid_backoff over ``documents``, with score rounded to six places.
ORACLE_SQL = r"""
WITH w AS (
  SELECT doc_id, i, words[i] AS w, CASE WHEN i > 1 THEN words[i - 1] END AS v
  FROM (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
       unnest(range(1, len(words) + 1)) AS t(i)
), d AS (SELECT doc_id, count(*) AS n FROM w GROUP BY 1),
u AS (SELECT w, count(*) AS c FROM w GROUP BY 1), ud AS (SELECT doc_id, w, count(*) AS c FROM w GROUP BY 1, 2),
b AS (SELECT v, w, count(*) AS c FROM w WHERE i > 1 GROUP BY 1, 2), bd AS (SELECT doc_id, v, w, count(*) AS c FROM w WHERE i > 1 GROUP BY 1, 2, 3),
x AS (
  SELECT w.doc_id, w.i, u.c - ud.c AS c1, uv.c - udv.c AS c0, b.c - bd.c AS c2, greatest((SELECT count(*) FROM w) - d.n, 1) AS rest
  FROM w JOIN d USING (doc_id) JOIN u ON u.w = w.w JOIN ud ON ud.doc_id = w.doc_id AND ud.w = w.w
  LEFT JOIN u AS uv ON uv.w = w.v LEFT JOIN ud AS udv ON udv.doc_id = w.doc_id AND udv.w = w.v
  LEFT JOIN b ON b.v = w.v AND b.w = w.w LEFT JOIN bd ON bd.doc_id = w.doc_id AND bd.v = w.v AND bd.w = w.w
), s AS (
  SELECT doc_id, i > 1 AND c2 = 0 AS backed, c1 = 0 AS unseen,
    CASE WHEN c2 > 0 THEN log10(c2 / greatest(c0, 1))
         ELSE log10(greatest(c1, 1) / rest) + CASE WHEN c1 > 0 THEN 0 ELSE log10(0.4) END + CASE WHEN i > 1 THEN log10(0.4) ELSE 0 END END AS logp
  FROM x
)
SELECT documents.doc_id, coalesce(any_value(d.n), 0)::BIGINT AS n_words, (count(*) FILTER (backed))::BIGINT AS n_backoff,
  (count(*) FILTER (unseen))::BIGINT AS n_unseen, round(avg(logp), 6) AS score
FROM documents LEFT JOIN d USING (doc_id) LEFT JOIN s USING (doc_id) GROUP BY documents.doc_id
"""
