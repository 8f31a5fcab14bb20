"""Token ids of whole texts by a public tokenizer, in Arrow batches, with a bounded cache of words.

A tokenizer whose file says that nothing joins characters across white space may be fed with the pieces of a
text between ASCII white space: pieces repeat, and are encoded once while the cache holds them. ``splits_at_space``
reads that from the definition of normaliser, pre-tokenizer and added tokens; any other tokenizer is fed with
whole texts. Special tokens in a text are found as the library finds them by default; they hold no
white space, so each lies in one piece.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Name of the tokenizer file that queries use, below the folder of public tokenizers.
WORD_BPE = "word_bpe_49k.json"
#: Pieces that a worker's cache holds before it starts anew.
CACHE_PIECES = 300_000
#: Bytes of text that are encoded at once.
ENCODE_BYTES = 6 << 20
#: Pieces of ASCII and Latin-1 letters alone. Nothing in them composes, and the lower case of each character is one character, so they
#: can be put in lower case first and cut where a run of letters ends or begins (but not after an apostrophe, which starts "'s").
SIMPLE = r"^[\x00-\x7F\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{FF}]*$"


def tokenizer_path(name: str = WORD_BPE) -> str:
    """Path of a public tokenizer's file on the machine that asks."""
    import public_tokenizers

    return public_tokenizers.path(name)


def splits_at_space(definition: dict) -> bool:
    """Whether a tokenizer's definition keeps the two sides of white space apart, whatever they are.

    So it is if the normaliser only composes characters, makes white space a blank and folds case character by character,
    if the pre-tokenizer keeps runs of letters, single numbers and runs of signs and drops white space, and if
    no added token holds white space or takes it in.
    """
    normal, pre, model = definition["normalizer"] or {}, definition["pre_tokenizer"] or {}, definition["model"]
    steps = normal.get("normalizers", [])
    composes = [s["type"] for s in steps] == ["NFC", "Replace", "Lowercase"] and steps[1]["pattern"] == {"Regex": r"\s+"} and steps[1]["content"] == " "
    parts = pre.get("pretokenizers", [])
    drops = (
        [p["type"] for p in parts] == ["Split", "ByteLevel"]
        and parts[0]["pattern"].get("Regex", "").endswith(r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
        and r"\s" not in parts[0]["pattern"]["Regex"].removesuffix(r"[^\s\p{L}\p{N}]+")
        and (parts[0]["behavior"], parts[0]["invert"]) == ("Removed", True)
        and not parts[1]["add_prefix_space"]
        and not parts[1]["use_regex"]
    )
    added = all(not re.search(r"\s", t["content"]) and not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) for t in definition["added_tokens"])
    return bool(composes and drops and added and model["type"] == "BPE" and not model.get("dropout"))


def definition_of(tokenizer) -> dict:
    """What splits_at_space reads of a tokenizer, without its vocabulary."""
    state = lambda x: json.loads(x.__getstate__()) if x else None
    added = [{k: getattr(t, k) for k in ("content", "lstrip", "rstrip", "single_word", "normalized")} for t in tokenizer.get_added_tokens_decoder().values()]
    model = {"type": type(tokenizer.model).__name__} | {k: getattr(tokenizer.model, k, None) for k in ("dropout", "continuing_subword_prefix")}
    return {"normalizer": state(tokenizer.normalizer), "pre_tokenizer": state(tokenizer.pre_tokenizer), "added_tokens": added, "model": model}


class PieceEncoder:
    """Encodes arrays of texts; ``path`` names a tokenizers file, None the default one."""

    def __init__(self, path: str | None = None):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path or tokenizer_path())
        definition = definition_of(self.tokenizer)
        #: whether this tokenizer may be fed with pieces; else whole texts are encoded
        self.by_piece = splits_at_space(definition)
        self.plain = self.by_piece and definition["model"].get("continuing_subword_prefix") in (None, "")
        self.added = tuple(t["content"] for t in definition["added_tokens"])
        self.cache: dict[str, bytes] = {}

    def _ids(self, piece: str) -> bytes:
        # a lower-case ASCII word passes normaliser and pre-tokenizer as it is
        if self.plain and piece.isascii() and piece.isalpha() and piece.islower():
            ids = [t.id for t in self.tokenizer.model.tokenize(piece)]
        else:
            ids = self.tokenizer.encode(piece, add_special_tokens=False).ids
        return np.array(ids, np.uint32).tobytes()

    def _encoded(self, pieces: pa.Array) -> list[bytes]:
        """Ids of each piece, by the cache."""
        cache, out = self.cache, []
        for w in pieces.to_pylist():
            got = cache.get(w)
            if got is None:
                if len(cache) >= CACHE_PIECES:
                    cache.clear()
                got = self._ids(w) if w else b""
                if len(w) < 64:
                    cache[w] = got
            out.append(got)
        return out

    def _pieces(self, pieces: pa.Array) -> list[bytes]:
        """Ids of distinct texts without ASCII white space."""
        simple = pc.match_substring_regex(pieces, SIMPLE)
        for t in self.added:
            simple = pc.and_not(simple, pc.match_substring(pieces, t))
        low = pc.utf8_lower(pieces.filter(simple))
        low = pc.replace_substring_regex(pc.replace_substring_regex(low, r"(\p{L})(\P{L})", r"\1 \2"), r"([^\p{L}'])(\p{L})", r"\1 \2")
        parts = pc.split_pattern(low, " ")
        coded = parts.flatten().dictionary_encode()
        each, codes = self._encoded(coded.dictionary), coded.indices.to_pylist()
        ends = np.cumsum(pc.list_value_length(parts).to_numpy(zero_copy_only=False)).tolist()
        cut = iter([b"".join([each[c] for c in codes[a:b]]) for a, b in zip([0, *ends], ends, strict=False)])
        whole = iter(self._encoded(pieces.filter(pc.invert(simple))))
        return [next(cut if s else whole) for s in simple.to_pylist()]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of the texts; a null text has no ids."""
        texts = pc.fill_null(texts, "")
        if not self.by_piece:
            ids = [e.ids for e in self.tokenizer.encode_batch(texts.to_pylist(), add_special_tokens=False)]
            flat = np.fromiter((i for x in ids for i in x), np.uint32)
            return np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int64), flat
        parts = pc.ascii_split_whitespace(texts)
        coded = parts.flatten().dictionary_encode()
        codes = coded.indices.to_numpy()
        bounds = np.concatenate(([0], np.cumsum(pc.list_value_length(parts).to_numpy(zero_copy_only=False)))).astype(np.int64)
        each = self._pieces(coded.dictionary)
        flat = np.frombuffer(b"".join(each), np.uint32)
        length = np.fromiter(map(len, each), np.int64, len(each)) // 4
        first = np.cumsum(length) - length
        n = length[codes]
        ends = np.concatenate(([0], np.cumsum(n)))
        at = np.repeat(first[codes] - ends[:-1], n) + np.arange(ends[-1])
        return ends[bounds], flat[at]


@lru_cache(maxsize=2)
def encoder(path: str | None = None) -> PieceEncoder:
    """This worker's encoder."""
    return PieceEncoder(path)
