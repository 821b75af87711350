"""Ids of whole texts by a library's vocabulary, coded unit by unit.

The ids of a text are those of its units, one after another, if no token spans
two of them.  A unit is a word or a run of marks, with the white space before it.  Units are found for many
texts at a time as array operations and numbered by Arrow's dictionary encoding; a worker
keeps the ids of those it has met, calls the library for new ones only, and lays the
ids of whole texts together by their numbers.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa

from .bpe import read_ranks

CACHE_WORDS = 500_000
#: Longer units (in bytes) are coded each time, so that the kept ones stay small.
LONGEST_KEPT = 64
#: Bytes of texts taken together, and new words coded by one call.
TOGETHER, CALL = 2_000_000, 1024
#: Stands between words in a call: a mark that is one token by itself and joins nothing beyond white space.
MARK = "|"
#: Begins each text in a buffer; no byte of UTF-8.
_START = b"\xff"
#: ASCII letters and digits (1) and marks but the apostrophe (2): between the two, a piece of either vocabulary ends.
_SORT = np.zeros(256, np.uint8)
_SORT[[b for b in range(128) if chr(b).isalnum()]] = 1
_SORT[[b for b in range(33, 127) if not chr(b).isalnum() and b != 39]] = 2


def _changes(raw: np.ndarray) -> np.ndarray:
    """Whether a byte is a mark after a letter or digit, or the other way round."""
    sort = _SORT[raw]
    return np.append(False, sort[1:] * sort[:-1] == 2)


class _Units:
    """Ids of units met so far, and of whole texts by their units."""

    id_type = "<u4"

    def __init__(self):
        self.number: dict[bytes, int] = {}
        self.start, self.length, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, self.id_type)

    def bounds(self, raw: np.ndarray) -> np.ndarray:
        """Where units begin in a buffer of texts, each after a ``_START``."""
        raise NotImplementedError

    def learn(self, units: list[bytes]) -> list[bytes]:
        """The ids of units."""
        raise NotImplementedError

    def encode(self, texts: list[bytes | str]) -> Iterator[bytes]:
        """Ids of each text, as little-endian integers."""
        for part in _together([t.encode() if isinstance(t, str) else t for t in texts]):
            yield from self._encode(part)

    def count(self, texts: list[bytes]) -> int:
        """The number of all ids, without laying them out."""
        total = 0
        for part in _together(texts):
            _, at = self._numbered(part)
            total += int(self.length[at].sum())
            self._settle()
        return total

    def _numbered(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Where the texts' units begin in their buffer, and their numbers."""
        raw = np.frombuffer(b"".join([_START + t for t in texts]), np.uint8)
        begin = self.bounds(raw)
        offsets = np.append(begin, len(raw)).astype(np.int32 if len(raw) < 1 << 31 else np.int64)
        kind = pa.binary() if offsets.dtype == np.int32 else pa.large_binary()
        coded = pa.Array.from_buffers(kind, len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(raw)]).dictionary_encode()
        units = coded.dictionary.to_pylist()
        if len(self.number) > CACHE_WORDS:
            self._forget()
        known = len(self.number)
        numbers = np.array([-1 if n is None else n for n in map(self.number.get, units)], np.int64)
        unknown = np.flatnonzero(numbers < 0)
        if len(unknown):
            # Long units come last, as they are dropped after this part.
            unknown = unknown[np.argsort([len(units[k]) > LONGEST_KEPT for k in unknown.tolist()], kind="stable")]
            new = [units[k] for k in unknown.tolist()]
            found = self.learn(new)
            numbers[unknown] = np.arange(known, known + len(new))
            size = np.array([len(x) for x in found], np.int64) // self.ids.itemsize
            self.start = np.append(self.start, len(self.ids) + np.cumsum(size) - size)
            self.length = np.append(self.length, size)
            self.ids = np.append(self.ids, np.frombuffer(b"".join(found), self.id_type))
            self.number.update(zip((u for u in new if len(u) <= LONGEST_KEPT), range(known, known + len(new))))
        return begin, numbers[coded.indices.to_numpy(zero_copy_only=False)]

    def _settle(self) -> None:
        """Drop long units after a part."""
        if (keep := len(self.number)) < len(self.start):
            self.ids, self.start, self.length = self.ids[: self.start[keep]], self.start[:keep], self.length[:keep]

    def _encode(self, texts: list[bytes]) -> Iterator[bytes]:
        begin, at = self._numbered(texts)
        ids = _laid(self.ids, self.start[at], self.length[at])
        until = np.append(0, np.cumsum(self.length[at]))
        first = np.searchsorted(begin, np.cumsum([0, *[len(t) + 1 for t in texts]]))
        self._settle()
        for a, b in zip(until[first[:-1]].tolist(), until[first[1:]].tolist(), strict=True):
            yield ids[a:b].tobytes()

    def _forget(self) -> None:
        """Keep the half of the units that was met last."""
        cut = len(self.number) // 2
        at = self.start[cut]
        self.ids, self.start, self.length = self.ids[at:].copy(), self.start[cut:] - at, self.length[cut:].copy()
        self.number = {u: n - cut for u, n in self.number.items() if n >= cut}


def _laid(ids: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The runs of ``ids`` at ``start`` laid one after another."""
    end = np.cumsum(length)
    return ids[np.repeat(start - (end - length), length) + np.arange(end[-1] if len(end) else 0)]


class WordTokenizer(_Units):
    """A ``tokenizers`` vocabulary that drops white space and never joins characters across it, nor letters
    and marks; strings of added tokens in a text are those tokens, as the library has it by default
    (texts that hold any are coded as a whole)."""

    def __init__(self, vocabulary: str):
        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(vocabulary)
        self.added = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        mark = self.library.encode(MARK, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None

    def bounds(self, raw: np.ndarray) -> np.ndarray:
        return np.flatnonzero((raw == 32) | (raw == 10) | (raw == 255) | _changes(raw))

    def _encode(self, texts: list[bytes]) -> Iterator[bytes]:
        whole = [any(a in t for a in self.added) for t in texts]
        by_units = super()._encode([t for t, w in zip(texts, whole, strict=True) if not w])
        for t, w in zip(texts, whole, strict=True):
            yield np.array(self.library.encode(t.decode(), add_special_tokens=False).ids, "<u4").tobytes() if w else next(by_units)

    def _ids(self, words: list[str]) -> list[bytes]:
        if self.mark is None or any(MARK in w for w in words):
            return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(words, add_special_tokens=False)]
        ids = np.array(self.library.encode_batch_fast([f" {MARK} ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        cut = (4 * np.flatnonzero(ids == self.mark)).tolist()
        raw = ids.tobytes()
        return [raw[start:end] for start, end in zip([0, *(c + 4 for c in cut)], [*cut, len(raw)], strict=True)]

    def learn(self, units: list[bytes]) -> list[bytes]:
        words = [u.lstrip(b" \n\xff").decode() for u in units]
        out: dict[str, bytes] = {"": b""}
        plain, marked = [w for w in words if w and MARK not in w], [w for w in words if MARK in w]
        for some in (list(dict.fromkeys(plain)), list(dict.fromkeys(marked))):
            for k in range(0, len(some), CALL):
                part = some[k : k + CALL]
                out.update(zip(part, self._ids(part), strict=True))
        return [out[w] for w in words]


#: Fixed value: the pattern whose pieces units follow.  A run of white space is a piece but for its last
#: character, and that goes to the word behind it if it is a space, else is a piece; other patterns are coded in whole texts.
SPLIT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_ASCII_SPACE = np.zeros(256, bool)
_ASCII_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: White space of more than one byte: texts that hold any are coded as a whole.
_WIDE_SPACE = re.compile(b"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")


class ByteTokenizer(_Units):
    """A rank file read by ``tiktoken``; a unit is a word or a run of marks with the white space character before it, or a run of white space."""

    id_type = "<u2"

    def __init__(self, ranks: bytes, pattern: str):
        super().__init__()
        import tiktoken

        merged = read_ranks(ranks)
        self.library = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=merged, special_tokens={})
        self.split = pattern == SPLIT_PATTERN
        self.line = self.library.encode_ordinary("\n")
        self.bytes_of = np.zeros(max(merged.values()) + 1, np.int64)
        self.bytes_of[list(merged.values())] = [len(t) for t in merged]

    def _whole(self, text: bytes | str) -> bytes:
        return np.array(self.library.encode_ordinary(text.decode() if isinstance(text, bytes) else text), "<u2").tobytes()

    def bounds(self, raw: np.ndarray) -> np.ndarray:
        space = np.append(_ASCII_SPACE[raw], False)
        begins = space[:-1].copy()
        begins[1:] &= ~space[:-2]  # a run of white space
        after = np.append(raw[1:], 255)
        return np.flatnonzero(begins | (space[:-1] & ~space[1:] & (after != 255)) | (raw == 255) | _changes(raw))

    def _encode(self, texts: list[bytes]) -> Iterator[bytes]:
        if self.split and not any(map(_WIDE_SPACE.search, texts)):
            yield from super()._encode(texts)
            return
        unit = [self.split and not _WIDE_SPACE.search(t) for t in texts]
        by_units = super()._encode([t for t, u in zip(texts, unit, strict=True) if u])
        for t, u in zip(texts, unit, strict=True):
            yield next(by_units) if u else self._whole(t)

    def count(self, texts: list[bytes]) -> int:
        unit = [self.split and not _WIDE_SPACE.search(t) for t in texts]
        whole = sum(len(self.library.encode_ordinary(t.decode())) for t, u in zip(texts, unit, strict=True) if not u)
        return whole + super().count([t for t, u in zip(texts, unit, strict=True) if u])

    def learn(self, units: list[bytes]) -> list[bytes]:
        heads, words = [], []
        for u in units:  # what is coded before the word, and the word with its space
            if u == _START or _ASCII_SPACE[u[-1]]:  # the beginning, or a run of white space
                heads.append(b"" if u == _START else u)
                words.append("")
            elif u[0] != 32 and (_ASCII_SPACE[u[0]] or u[:1] == _START):
                heads.append(b"" if u[:1] == _START else u[:1])
                words.append(u[1:].decode())
            else:
                heads.append(b"")
                words.append(u.decode())
        out: dict[str, bytes] = {"": b""}
        some = list(dict.fromkeys(w for w in words if w))
        for k in range(0, len(some), CALL):
            part = some[k : k + CALL]
            out.update(zip(part, self._together(part), strict=True))
        head = {h: self._whole(h) for h in set(heads)}
        return [head[h] + out[w] for h, w in zip(heads, words, strict=True)]

    def _together(self, words: list[str]) -> list[bytes]:
        """Code words without inner white space in one call: a line break between two is a token by
        itself.  Each cut must lie where its word ends in bytes, or all are coded singly."""
        ids = np.array(self.library.encode_ordinary("\n".join(words)), "<u2")
        cut = np.flatnonzero(ids == self.line[0])
        ends = np.cumsum(self.bytes_of[ids])[cut]
        want = np.cumsum([len(w.encode()) + 1 for w in words[:-1]], dtype=np.int64)
        if len(self.line) != 1 or not np.array_equal(ends, want):
            return [self._whole(w) for w in words]
        raw, cut = ids.tobytes(), (2 * cut).tolist()
        return [raw[start:end] for start, end in zip([0, *(c + 2 for c in cut)], [*cut, len(raw)], strict=True)]


def _together(texts: list[bytes]) -> Iterator[list[bytes]]:
    """The texts in parts of at most ``TOGETHER`` bytes (or one longer text)."""
    part, size = [], 0
    for t in texts:
        if part and size + len(t) > TOGETHER:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t)
    if part:
        yield part


_byte_tokenizers: dict[bytes, ByteTokenizer] = {}


def byte_tokenizer(ranks: bytes, pattern: str) -> ByteTokenizer:
    key = sha256(ranks + pattern.encode()).digest()
    if key not in _byte_tokenizers:
        _byte_tokenizers[key] = ByteTokenizer(ranks, pattern)
    return _byte_tokenizers[key]


_tokenizers: dict[bytes, WordTokenizer] = {}


def tokenizer(vocabulary: str) -> WordTokenizer:
    """One tokenizer per worker process, so that known words serve later tasks too."""
    key = sha256(vocabulary.encode()).digest()
    if key not in _tokenizers:
        _tokenizers[key] = WordTokenizer(vocabulary)
    return _tokenizers[key]


def read_vocabulary(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()
