"""Whole texts as Arrow arrays: bounded slices, words and word shingles, computed column-wise."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes of text that are worked on at once; a longer text is a slice of its own.
SLICE_BYTES = 2 << 20


def slices(batches: Iterable[pa.RecordBatch], column: str, max_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches into runs of rows with at most ``max_bytes`` of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).cumsum()
        at, base = 0, 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(size, base + max_bytes, "right")))
            yield batch.slice(at, end - at)
            at, base = end, int(size[end - 1])
        pa.default_memory_pool().release_unused()  # workers live on between stages


@dataclass
class Words:
    """Words of some texts: text i holds ``codes[offsets[i]:offsets[i + 1]]``, which index ``vocab``."""

    offsets: np.ndarray
    codes: np.ndarray
    vocab: pa.Array

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    @property
    def owner(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        each = (xxhash.xxh3_64_intdigest(w) for w in self.vocab.to_pylist())
        return np.fromiter(each, np.uint64, len(self.vocab))[self.codes]


def split_words(texts: pa.Array, lower: bool = False) -> Words:
    """Words ``[^\\x20\\x09-\\x0D]+``; a null text has none. ``lower`` folds A-Z only."""
    texts = pc.fill_null(texts, "")
    pieces = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    coded = pieces.flatten().dictionary_encode()
    codes = coded.indices.to_numpy()
    owner_counts = pc.list_value_length(pieces).to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = np.concatenate(([0], np.cumsum(owner_counts)))
    blank = pc.index(coded.dictionary, "").as_py() if len(coded.dictionary) else -1
    if blank >= 0:
        real = codes != blank
        kept = np.concatenate(([0], np.cumsum(real)))
        codes, offsets = codes[real], kept[offsets]
    return Words(offsets, codes, coded.dictionary)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser; spreads every input bit over the output."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def utf8_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an array without nulls."""
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, ends, data = texts.buffers()
    offsets = np.frombuffer(ends, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def windows(words: Words, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, number of the first word, hash) of each window of ``k`` words, in order; texts with
    fewer words have none."""
    h, n = words.hashes(), len(words.codes)
    if n < k:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    acc = np.zeros(n - k + 1, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            acc = mix64(acc * np.uint64(0x9E3779B97F4A7C15) + h[i : n - k + 1 + i])
    owner = words.owner
    inside = np.flatnonzero(owner[: n - k + 1] == owner[k - 1 :])
    return owner[inside], inside, acc[inside]


def shingle_sets(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, hashes): the sorted set of ``k``-word shingles of each text.

    A text with one to ``k - 1`` words has its whole sequence as its one shingle, a text without
    words none.
    """
    owner, _, h = windows(words, k)
    short = np.flatnonzero((words.counts > 0) & (words.counts < k))
    if len(short):
        per_word = words.hashes()
        extra = []
        with np.errstate(over="ignore"):
            for i in short:
                acc = np.uint64(0)
                for w in per_word[words.offsets[i] : words.offsets[i + 1]]:
                    acc = mix64(np.asarray(acc * np.uint64(0x9E3779B97F4A7C15) + w))
                extra.append(acc ^ np.uint64(words.counts[i]))
        owner, h = np.concatenate((owner, short)), np.concatenate((h, np.array(extra, np.uint64)))
    order = np.lexsort((h, owner))
    owner, h = owner[order], h[order]
    if len(h):
        new = np.concatenate(([True], (owner[1:] != owner[:-1]) | (h[1:] != h[:-1])))
        owner, h = owner[new], h[new]
    return np.searchsorted(owner, np.arange(len(words.offsets))), h
