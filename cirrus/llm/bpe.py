"""Byte-level BPE over Arrow batches: pre-tokens are found in numpy, each distinct
pre-token is merged once by tiktoken, and the ids are put together by gathers.

The vectorised split follows the pattern marked below for characters that Python's
Unicode tables know; a text with any other character goes whole to the library.
"""

from __future__ import annotations

import base64
import json
import re
import unicodedata
from functools import cached_property
from itertools import chain

import numpy as np

from . import words

#: The pattern, White_Space characters and the suffixes it names.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
SUFFIXES = ["s", "t", "re", "ve", "m", "ll", "d"]

LETTER, NUMBER, BLANK, OTHER, EDGE, UNKNOWN = range(6)
_EDGE_CHAR = "\U0010ffff"
#: Longest pre-token that the numpy path hashes; longer ones go to the library by themselves.
_LONG = 256

_classes: np.ndarray | None = None


def classes() -> np.ndarray:
    """Class of every code point, built once in each process."""
    global _classes
    if _classes is None:
        kind = {"L": LETTER, "N": NUMBER}
        out = np.full(0x110000, OTHER, np.uint8)
        for c in range(0x110000):
            cat = unicodedata.category(chr(c))
            if cat == "Cn":
                out[c] = UNKNOWN
            elif cat[0] in kind:
                out[c] = kind[cat[0]]
        out[WHITE] = BLANK
        out[0x10FFFF] = EDGE
        _classes = out
    return _classes


def token_starts(chars: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """True where a pre-token starts; texts are parted by one character of class EDGE."""
    n = len(chars)
    before, after = np.empty_like(kind), np.empty_like(kind)
    before[0], after[-1] = EDGE, EDGE
    before[1:], after[:-1] = kind[:-1], kind[1:]
    char_before = np.empty_like(chars)
    char_before[0] = 0
    char_before[1:] = chars[:-1]
    blank = kind == BLANK
    start = (kind != before) & (blank | (char_before != 0x20))  # one space belongs to what follows
    start |= kind == EDGE
    start |= blank & (before == BLANK) & (after != BLANK) & (after != EDGE)
    quote = ((chars == 0x27) & (before != OTHER) & (char_before != 0x20)).nonzero()[0]
    for suffix in SUFFIXES:
        ok = quote[quote + len(suffix) < n]
        for k, c in enumerate(suffix, 1):
            ok = ok[chars[ok + k] == ord(c)]
        if len(ok):
            for k in range(1, len(suffix) + 1):
                start[ok + k] = False
            end = ok + len(suffix) + 1
            start[end[end < n]] = True
    return start


def ranks_of(path: str) -> dict[bytes, int]:
    """Merge ranks from a .tiktoken file, or from the vocabulary of a byte-level .json
    whose ids follow the order of its merges (checked)."""
    if not path.endswith(".json"):
        with open(path, "rb") as f:
            return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    with open(path, encoding="utf-8") as f:
        said = json.load(f)
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letter = {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))}
    special = {t["content"] for t in said.get("added_tokens", [])}
    out = {bytes(letter[c] for c in t): i for t, i in said["model"]["vocab"].items() if t not in special}
    last = -1
    for merge in said["model"]["merges"]:
        a, b = merge.split(" ") if isinstance(merge, str) else merge
        rank = out[bytes(letter[c] for c in a + b)]
        if rank <= last:
            raise ValueError(f"{path}: ids do not follow the merges")
        last = rank
    return out


def added_of(path: str) -> dict[str, int]:
    """Ids of the added tokens of a .json vocabulary by their content; a .tiktoken file has none."""
    if not path.endswith(".json"):
        return {}
    with open(path, encoding="utf-8") as f:
        tokens = json.load(f).get("added_tokens", [])
    if any(t.get(k) for t in tokens for k in ("single_word", "lstrip", "rstrip")) or len({bool(t.get("normalized")) for t in tokens}) > 1:
        raise ValueError(f"{path}: an added token has rules of its own")
    return {t["content"]: t["id"] for t in tokens}


def gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """flat[start : start + length] of every pair, put together."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(starts - (ends - lengths), lengths) + np.arange(total)]


class Codec:
    """Encoder and decoder of one rank file; `of(path)` keeps one in each process. With `added`,
    the added tokens of the file that stand in a text are one id each, as in the tokenizers
    library, and what is between them is encoded by itself."""

    _made: dict[tuple[str, bool], "Codec"] = {}
    #: Distinct pre-tokens kept between batches (about 50 bytes each); it starts anew beyond that.
    KEPT = 500_000

    def __init__(self, path: str, added: bool = False):
        self.path = path
        self.added = added_of(path) if added else {}
        longest_first = sorted(self.added, key=len, reverse=True)
        self.finder = re.compile(f"({'|'.join(map(re.escape, longest_first))})") if self.added else None
        ranks = ranks_of(path)
        size = max(*ranks.values(), *self.added.values()) + 1
        parts = [b""] * size
        for token, i in ranks.items():
            parts[i] = token
        for token, i in self.added.items():
            parts[i] = token.encode()
        self.bytes_len = np.array([len(p) for p in parts], np.int64)
        self.bytes_at = np.cumsum(self.bytes_len) - self.bytes_len
        self.bytes_flat = np.frombuffer(b"".join(parts), np.uint8)
        self._forget()

    def _forget(self) -> None:
        self.key = self.check = np.zeros(1, np.uint64)  # sorted hashes of the kept pre-tokens; 0 stands for the empty one
        self.kept_at = self.kept_len = np.zeros(1, np.int64)
        self.kept_ids = np.zeros(0, np.int32)

    @cached_property
    def library(self):
        """The merges; decoding does without."""
        import tiktoken

        return tiktoken.Encoding("given", pat_str=PATTERN, mergeable_ranks=ranks_of(self.path), special_tokens={})

    @classmethod
    def of(cls, path: str, added: bool = False) -> "Codec":
        if (path, added) not in cls._made:
            cls._made[path, added] = cls(path, added)
        return cls._made[path, added]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another (int32) and the offsets of each text in them."""
        if self.finder is None or not any(map(self.finder.search, texts)):
            return self._ordinary(texts)
        parts = [self.finder.split(t) for t in texts]  # every second part is an added token
        token = np.array([self.added[p] if i % 2 else -1 for own in parts for i, p in enumerate(own)], np.int64)
        ids, at = self._ordinary(["" if i % 2 else p for own in parts for i, p in enumerate(own)])
        whole = token >= 0
        offsets = np.concatenate([[0], np.cumsum(np.diff(at) + whole)])
        return np.insert(ids, at[:-1][whole], token[whole]), offsets[np.cumsum([0, *map(len, parts)])]

    def _ordinary(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """`encode` of texts in which nothing is an added token."""
        joined = _EDGE_CHAR.join(texts)
        chars = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        if not len(chars):
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        kind = classes()[chars]
        odd = (kind == UNKNOWN).any() or int((kind == EDGE).sum()) != len(texts) - 1
        if odd:
            return self._by_library(texts)
        at = token_starts(chars, kind).nonzero()[0]
        ends = np.append(at[1:], len(chars))
        edge = kind[at] == EDGE
        text_of = np.cumsum(edge)
        at, ends, text_of = at[~edge], ends[~edge], text_of[~edge]
        if len(at) and int((ends - at).max()) > _LONG:
            return self._by_library(texts)
        key, first, inverse = np.unique(words.spans(words.prefix(chars), at, ends), return_index=True, return_inverse=True)
        check = words.spans(words.prefix(_scrambled(chars)), at, ends)
        if (check != check[first][inverse]).any():
            return self._by_library(texts)  # two pre-tokens share a hash
        place = self._places(key, check[first], "\0".join(texts), at[first], ends[first])
        if place is None:
            return self._by_library(texts)
        counts = self.kept_len[place][inverse]
        out = gather(self.kept_ids, self.kept_at[place][inverse], counts)
        offsets = np.zeros(len(texts) + 1, np.int64)
        np.cumsum(np.bincount(text_of, counts, len(texts)).astype(np.int64), out=offsets[1:])
        return out, offsets

    def _places(self, key, check, joined, starts, ends) -> np.ndarray | None:
        """Where the ids of each distinct pre-token are kept; new ones are merged and
        added. Two independent 64-bit hashes name a pre-token; None if they disagree."""
        if len(self.key) > self.KEPT:
            self._forget()
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        new = (self.key[at] != key).nonzero()[0]
        if len(new):
            single = self.library._core_bpe.encode_single_piece
            ids = [single(joined[a:b].encode()) for a, b in zip(starts[new].tolist(), ends[new].tolist())]
            size = np.fromiter(map(len, ids), np.int64, len(ids))
            kept_at = np.append(self.kept_at, len(self.kept_ids) + np.cumsum(size) - size)
            order = np.argsort(keys := np.append(self.key, key[new]), kind="stable")
            self.key, self.kept_at = keys[order], kept_at[order]
            self.check = np.append(self.check, check[new])[order]
            self.kept_len = np.append(self.kept_len, size)[order]
            self.kept_ids = np.append(self.kept_ids, np.fromiter(chain.from_iterable(ids), np.int32, int(size.sum())))
            at = np.searchsorted(self.key, key)
        return at if (self.check[at] == check).all() else None

    def _by_library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(texts) > 1:  # find the odd ones
            parts = [self._ordinary([t]) for t in texts]
            offsets = np.zeros(len(texts) + 1, np.int64)
            np.cumsum([len(p[0]) for p in parts], out=offsets[1:])
            return np.concatenate([p[0] for p in parts]), offsets
        ids = np.array(self.library.encode_ordinary(texts[0]), np.int32)
        return ids, np.array([0, len(ids)], np.int64)

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes that the ids stand for, one after another, and their offsets."""
        size = self.bytes_len[ids]
        ends = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(size, out=ends[1:])
        return gather(self.bytes_flat, self.bytes_at[ids], size), ends[offsets]



def _scrambled(chars: np.ndarray) -> np.ndarray:
    """Other values of the characters, for a second hash that does not depend on the first."""
    return words.mix(chars.astype(np.uint64) + np.uint64(0x51ED270B))
