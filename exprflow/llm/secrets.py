"""Secrets in whole texts: three written forms, and random strings by their low count of characters a token.

Text in a vocabulary's languages takes few tokens; a key drawn at random takes one for every character or two. Runs of key characters are
encoded with a tiktoken vocabulary, and those with few characters a token are reported, unless they are known digests (hash values,
checksums of packages) or identifiers (UUIDs, numbers, names made of words).
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import slices

#: Kinds of spans, in the order in which they are listed at one start.
KINDS = ("assign", "access", "hex", "random")
BASE = KINDS[:3]
# The written forms; a match of "assign" needs a value of 12 characters, "access" and "hex" 18 and 16 in all.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ASSIGN_VALUE = 12
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")  # runs are taken whole, so too short ones can't hide another
HEX = re.compile(r"[0-9a-f]{16,}")
#: A text without one of these holds no span; searched by Arrow, column-wise.
HINTS = r"""AKIA[A-Z0-9]{14}|[0-9a-f]{16}|[A-Za-z0-9+/_-]{16}|(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=])"""

RUN = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: Least characters of a piece that is judged by itself, and of a piece of letters in one case.
PIECE, LETTERS = 16, 24
#: Most characters a token of a random string; of letters in one case, which words come close to; and of a run cut by signs.
RATIO, LETTERS_RATIO, JOINED_RATIO = 1.9, 1.5, 1.6
#: Characters that are encoded at once; the counts of a longer run's blocks are added.
BLOCK = 512
# Hexadecimal digits of the usual digests (128, 160, 224, 256, 384 and 512 bits).
DIGEST_DIGITS = (32, 40, 56, 64, 96, 128)
INTEGRITY = re.compile(r"(?:md5|sha1|sha224|sha256|sha384|sha512)[-_][A-Za-z0-9+/]{22,88}={0,2}", re.IGNORECASE)
UUID = re.compile(r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", re.IGNORECASE)


@lru_cache(maxsize=2)
def vocabulary(path: str | None = None):
    """This worker's tiktoken encoding; ``path`` names a file of ranks, None the public byte-level one."""
    import public_tokenizers
    import tiktoken

    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("secrets", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def chars_per_token(s: str, path: str | None = None) -> float:
    """Characters of ``s`` for each of its tokens, counted in blocks."""
    enc = vocabulary(path)
    return len(s) / sum(len(enc.encode_ordinary(s[i : i + BLOCK])) for i in range(0, len(s), BLOCK)) if s else 0.0


def is_known(s: str) -> bool:
    """Digests and identifiers by their form: hash values, checksums of packages, UUIDs, numbers with separators."""
    bare = s.rstrip("=")
    digest = len(bare) in DIGEST_DIGITS and re.fullmatch("[0-9a-f]+|[0-9A-F]+", bare)
    return bool(digest or UUID.fullmatch(bare) or INTEGRITY.fullmatch(s) or not re.search("[A-Za-z]", bare) or re.fullmatch(r"(?:\d+[T_/+-]+)+\d+Z?", bare))


def is_random(run: str, path: str | None = None) -> bool:
    """Whether a run of key characters is a random string: one of its pieces between signs has few characters a token,
    or all of it has though signs cut it, with capitals, small letters and digits."""
    if is_known(run):
        return False
    pieces = re.split(r"[+/_=-]+", run)
    for p in pieces:
        one_case = re.fullmatch("[a-z]+|[A-Z]+|[A-Z][a-z]+", p)
        if is_known(p) or len(p) < (LETTERS if one_case else PIECE):
            continue
        if chars_per_token(p, path) <= (LETTERS_RATIO if one_case else RATIO):
            return True
    return bool(
        all(re.search(c, run) for c in ("[a-z]", "[A-Z]", "[0-9]"))
        and not all(re.fullmatch(r"[A-Z]?[a-z]*|[A-Z]+|\d+", p) for p in pieces)
        and len(run) >= LETTERS
        and chars_per_token(run, path) <= JOINED_RATIO
    )


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of the written forms, in order."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_VALUE]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def secret_spans(text: str, path: str | None = None) -> list[tuple[int, int, int]]:
    """base_spans and the random strings that no single one of them holds whole."""
    base = base_spans(text)
    out, k, reach = list(base), 0, -1
    for m in RUN.finditer(text):
        while k < len(base) and base[k][0] <= m.start():
            reach = max(reach, base[k][2])
            k += 1
        if m.end() > reach and is_random(m.group(), path):
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def _scan(path: str | None):
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            texts = pc.fill_null(part.column("text"), "")
            hit = pc.match_substring_regex(texts, HINTS).to_pylist()
            spans = [secret_spans(t.as_py(), path) if h else [] for t, h in zip(texts, hit, strict=True)]
            found = [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in s] for s in spans]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found, kind)], names=["doc_id", "spans"])

    return run


def find_secrets(docs: DataFrame, vocabulary_path: str | None = None) -> DataFrame:
    """(doc_id, spans) of every row: kind, start and end of each secret in code points, by start and then kind.

    A null or empty text has none. Repeated rows and doc_ids keep a row each; other columns are ignored. Each text is
    scanned whole, in one pass over the table without a shuffle.
    """
    found = docs.select("doc_id", F.col("text").cast("string"))
    id_type = dict(found.dtypes)["doc_id"]
    return found.mapInArrow(_scan(vocabulary_path), f"doc_id {id_type}, spans array<struct<kind:string,start:long,`end`:long>>")


def span_digests(found: DataFrame) -> DataFrame:
    """Counts and joined spans of the rows of find_secrets, as columns."""
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in BASE], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
