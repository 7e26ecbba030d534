"""Encoding of texts for vocabularies whose tokens never cross white space, by distinct pre-token.

A pre-token here is a run of bytes between ASCII white space. `word_bpe_49k.json` replaces white space by one blank and
then drops it, so the ids of a text are those of its pre-tokens on end. Each distinct pre-token is encoded once while a Python
worker's memo keeps it. Texts of Latin letters are cut and lower-cased first as the vocabulary would do it, so that fewer
pre-tokens are distinct. The memo is bounded in entries, and pre-tokens longer than LONG bytes are not kept, so it is bounded
in bytes as well.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tessera.llm.common import Recent, packed

#: Entries of either generation of a memo: about 150 bytes each.
MEMO_ENTRIES = 500_000
#: A symbol that the vocabulary holds as one piece; it marks the ends of pre-tokens that are encoded together.
MARK = "\x01"
#: Pre-tokens longer than this are encoded by themselves and not kept.
LONG = 256
#: How `word_bpe_49k.json` splits a text, after NFC, white space as blanks and lower case.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
#: Texts of ASCII and Latin letters, which NFC leaves as they are and in which, in lower case, PATTERN's segments are those of APART and what
#: lies between them and white space.
SIMPLE = re.compile("[\t-\r -~À-ÖØ-öø-ÿ]*")
APART = "'s|'t|'re|'ve|'m|'ll|'d|[0-9]|[^\t-\r a-z0-9ß-öø-ÿ]+"


def _splits_like_segments(tokenizer: dict) -> bool:
    """Whether a tokenizer takes the segments of a SIMPLE text, each by itself; its added tokens all hold `<|`."""
    split = {"type": "Split", "pattern": {"Regex": PATTERN}, "behavior": "Removed", "invert": True}
    steps = (tokenizer["pre_tokenizer"] or {}).get("pretokenizers") or [None]
    alike = (tokenizer["normalizer"] or {}).get("normalizers") == NORMALIZERS and steps[0] == split
    return alike and [s["type"] for s in steps[1:]] == ["ByteLevel"] and not steps[1]["add_prefix_space"] and not steps[1]["use_regex"] and all("<|" in t["content"] for t in tokenizer["added_tokens"])


class Ids:
    """Results kept as ids: little-endian unsigned 32-bit integers."""

    total = b"".join

    @staticmethod
    def of(ids: np.ndarray, starts: list[int], ends: list[int]) -> list[bytes]:
        raw = ids.astype("<u4").tobytes()
        return [raw[4 * a : 4 * b] for a, b in zip(starts, ends, strict=True)]


class Counts:
    """Results kept as numbers of ids."""

    total = sum

    @staticmethod
    def of(ids: np.ndarray, starts: list[int], ends: list[int]) -> list[int]:
        return [b - a for a, b in zip(starts, ends, strict=True)]


class PretokenEncoder:
    """ids of pre-tokens, or their numbers, as `kind` says."""

    def __init__(self, path: str, kind: type = Ids):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.kind = Tokenizer.from_file(path), kind
        self.memo = Recent(MEMO_ENTRIES)
        mark = self._library(MARK)
        self.mark = mark[0] if len(mark) == 1 else None
        self.apart = _splits_like_segments(json.loads(self.tokenizer.to_str()))

    def _library(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int64)

    def _alone(self, text: str):
        ids = self._library(text)
        return self.kind.of(ids, [0], [len(ids)])[0]

    def _together(self, pieces: list[str]) -> list:
        ids = self._library(f" {MARK} ".join(pieces))
        marks = np.flatnonzero(ids == self.mark)
        if len(marks) != len(pieces) - 1:
            return list(map(self._alone, pieces))
        return self.kind.of(ids, [0, *(marks + 1).tolist()], [*marks.tolist(), len(ids)])

    def _encoded(self, pieces: list[bytes]) -> dict:
        """Results of pieces, by the library; those that can be told apart afterwards are encoded together."""
        odd = [p for p in pieces if len(p) > LONG or b"\x01" in p or self.mark is None]
        found = {p: self._alone(p.decode()) for p in odd}
        rest = [p for p in pieces if p not in found] if odd else pieces
        for k in range(0, len(rest), 2000):
            some = rest[k : k + 2000]
            found.update(zip(some, self._together([p.decode() for p in some]), strict=True))
        return found

    def known(self, pretokens: set[bytes]) -> dict:
        """A table that holds the results of `pretokens`, until the next call."""
        found = self._encoded(self.memo.missing(pretokens))
        long = {p: found.pop(p) for p in [p for p in found if len(p) > LONG]}
        self.memo.new.update(found)
        return {**self.memo.new, **long} if long else self.memo.new

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The results of each text."""
        split = [t.split() for t in texts]
        get = self.known(set().union(*split)).__getitem__
        return [self.kind.total(map(get, pieces)) for pieces in split]

    def encode_column(self, column: pa.Array) -> list[bytes]:
        """The ids of each text of an Arrow string column; null is empty. Occurrences are looked up and put on end by Arrow."""
        texts = ["" if x is None else x for x in column.to_pylist()]
        if self.apart:
            simple = ["<|" not in x and SIMPLE.fullmatch(x) is not None for x in texts]
            lower = pa.array([x.lower() if s else x for x, s in zip(texts, simple, strict=True)], pa.large_string())
            cut = pc.if_else(pa.array(simple, pa.bool_()), pc.replace_substring_regex(lower, APART, r" \0 "), lower)
        else:
            cut = pa.array(texts, pa.large_string())
        split = pc.ascii_split_whitespace(cut)
        pieces = split.flatten().dictionary_encode()
        distinct = pieces.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist()
        known = self.known({p for p in distinct if p})
        # White space at an end of a text leaves an empty piece there.
        results = pa.array([known[p] if p else b"" for p in distinct], pa.large_binary())
        found = results.take(pieces.indices)
        raw, ends = packed(found)
        places = split.offsets.to_numpy()
        cuts = ends[places - places[0]].tolist()
        return [raw[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]


_ENCODERS: dict[tuple[str, type], PretokenEncoder] = {}


def encoder(path: str, kind: type = Ids) -> PretokenEncoder:
    """One encoder for a Python worker, vocabulary file and kind of results."""
    if (path, kind) not in _ENCODERS:
        _ENCODERS[path, kind] = PretokenEncoder(path, kind)
    return _ENCODERS[path, kind]


def byte_texts(column) -> list[bytes]:
    """Values of an Arrow string column as bytes; null is empty."""
    return [b"" if x is None else x for x in column.cast(pa.large_binary()).to_pylist()]
