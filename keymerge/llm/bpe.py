"""Byte-level BPE encoding by dynamic programming over prefixes, and decoding.

The BPE encoding of a byte string has one property that makes it a table: the
encoding of a prefix ends in exactly one token, and what stands before that
token is the encoding of the shorter prefix.  So it is enough to store, for
each prefix, the start of its last token: of the tokens that end there, the
one that may stand after the shorter prefix's last token.  Two tokens may
stand side by side if merging their joint bytes gives back just the two.

The table allows exact appends (go on where it ends) and re-encoding near an
edit (keep the part before; stop as soon as the states agree with the old).
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from hashlib import sha256
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import pick, prepare

#: Entries that a worker keeps: pieces of text with their ids, and pairs of tokens.
CACHE_PIECES, CACHE_PAIRS, CACHE_PREFIXES = 300_000, 300_000, 500_000
#: Bytes up to which a word's prefixes are kept for other words that begin alike.
SHORT_WORD = 40


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Parse a rank file: a base64 token and its rank in each line."""
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in data.splitlines() if x.strip())}


class PrefixTable:
    """The last token of each prefix of ``data``; ``start[i]`` is where prefix ``i``'s last token begins."""

    def __init__(self, coder: BytePairCoder, data: bytes = b""):
        self.coder, self.data, self.start, self.token = coder, b"", [0], [-1]
        self.append(data)

    def append(self, more: bytes) -> None:
        """Extend the bytes; nothing before is computed again."""
        self.data += more
        self._fill(len(self.start))

    def edit(self, at: int, end: int, new: bytes) -> int:
        """Replace bytes ``at:end``; returns how many states were computed.

        States up to ``at`` stay.  A state depends on the states and bytes of the
        last ``longest`` positions only: once so many positions in a row after the
        new bytes agree with the old table, the rest of it holds too.
        """
        old_start, old_token, old = self.start, self.token, self.data
        shift = len(new) - (end - at)
        self.data = old[:at] + new + old[end:]
        self.start, self.token = old_start[: at + 1], old_token[: at + 1]
        agreed, done = 0, 0
        after = at + len(new)
        for i in range(at + 1, len(self.data) + 1):
            self._state(i)
            done += 1
            same = i - shift > end and self.token[i] == old_token[i - shift] and self.start[i] >= after
            agreed = agreed + 1 if same else 0
            if agreed >= self.coder.longest:
                self.start += [s + shift for s in old_start[i - shift + 1 :]]
                self.token += old_token[i - shift + 1 :]
                break
        return done

    def ids(self) -> list[int]:
        out, i = [], len(self.data)
        while i:
            out.append(self.token[i])
            i = self.start[i]
        return out[::-1]

    def _fill(self, first: int) -> None:
        for i in range(first, len(self.data) + 1):
            self._state(i)

    def _state(self, i: int) -> None:
        c, data, token = self.coder, self.data, self.token
        ranks, pairs = c.ranks, c.pairs
        for j in range(max(0, i - c.reach.get(data[max(0, i - 2) : i], 1)), i):
            t = ranks.get(data[j:i])
            if t is None:
                continue
            if j:
                ok = pairs.get((token[j], t))
                if ok is None:
                    ok = c.may_follow(token[j], t)
            else:
                ok = c.whole(t)
            if ok:
                self.start.append(j)
                token.append(t)
                return
        raise ValueError("the vocabulary lacks a byte")


class BytePairCoder:
    """Encodes and decodes by a rank table; equal to merging the lowest ranks first."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.bytes_of = {r: b for b, r in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        #: The longest token ending in these two bytes.
        self.reach: dict[bytes, int] = {}
        for b in ranks:
            self.reach[b[-2:]] = max(self.reach.get(b[-2:], 1), len(b))
        self.pairs: dict[tuple[int, int], bool] = {}
        self._edges: dict[int, tuple[list, list] | None] = {}
        self._pieces: dict[str, bytes] = {}
        self._prefixes: dict[bytes, tuple[int, bytes]] = {}
        self._packed = {t: pack("<I", t) for t in self.bytes_of}

    def _halves(self, data: bytes) -> list[bytes]:
        """Merge lowest ranks first until two parts are left (or nothing merges)."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 2:
            ranked = [self.ranks.get(x + y, 1 << 60) for x, y in zip(parts, parts[1:], strict=False)]
            low = min(ranked)
            if low == 1 << 60:
                break
            k = ranked.index(low)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def _spines(self, t: int) -> tuple[list, list] | None:
        """The parts that stand at the token's left and right edge while it is merged, each
        with the rank of the merge that ends it; None for a token that merging never makes."""
        if t not in self._edges:
            data, none = self.bytes_of[t], 1 << 60
            left, right = [(data, none)], [(data, none)]
            out: tuple[list, list] | None = (left, right)
            if len(data) > 1:
                h = self._halves(data)
                a = self._spines(self.ranks[h[0]]) if len(h) == 2 and h[0] in self.ranks else None
                b = self._spines(self.ranks[h[1]]) if len(h) == 2 and h[1] in self.ranks else None
                if a is None or b is None:
                    out = None
                else:
                    left += [(x, t if r == none else r) for x, r in a[0]]
                    right += [(x, t if r == none else r) for x, r in b[1]]
            self._edges[t] = out
        return self._edges[t]

    def whole(self, t: int) -> bool:
        """Whether merging the token's bytes gives the token."""
        return self._spines(t) is not None

    def may_follow(self, a: int, b: int) -> bool:
        """Whether merging the tokens' joint bytes gives back the two.

        Merges happen in the order of their ranks.  One across the border would happen if
        some part at ``a``'s right edge and some part at ``b``'s left edge make a token whose
        rank comes before the merges that end these parts (of equal ranks the left one is first).
        """
        if len(self.pairs) > CACHE_PAIRS:
            self.pairs.clear()
        x, y = self._spines(a), self._spines(b)
        ok = x is not None and y is not None
        if ok:
            for p, ends in x[1]:
                for q, stops in y[0]:
                    r = self.ranks.get(p + q)
                    if r is not None and r < ends and r <= stops:
                        ok = False
                        break
                if not ok:
                    break
        self.pairs[a, b] = ok
        return ok

    def encode_word(self, word: bytes) -> bytes:
        """Packed ids of one match of the pattern; a word that is a token is that token.

        The prefix table of short words is shared: words that begin alike start from
        the longest prefix known, each prefix having its last token and its ids.
        """
        t = self.ranks.get(word)
        if t is not None:
            return self._packed[t]
        n = len(word)
        if n > SHORT_WORD:
            ids = PrefixTable(self, word).ids()
            return pack(f"<{len(ids)}I", *ids)
        known, ranks, pairs, packed = self._prefixes, self.ranks, self.pairs, self._packed
        if len(known) > CACHE_PREFIXES:
            known.clear()
        i = n
        while i and word[:i] not in known:
            i -= 1
        while i < n:
            i += 1
            for j in range(max(0, i - self.reach.get(word[max(0, i - 2) : i], 1)), i):
                t = ranks.get(word[j:i])
                if t is None:
                    continue
                if not j:
                    if self.whole(t):
                        known[word[:i]] = t, packed[t]
                        break
                    continue
                last, ids = known.get(word[:j]) or self._prefix(word[:j])
                ok = pairs.get((last, t))
                if ok if ok is not None else self.may_follow(last, t):
                    known[word[:i]] = t, ids + packed[t]
                    break
            else:
                raise ValueError("the vocabulary lacks a byte")
        return known[word][1]

    def _prefix(self, prefix: bytes) -> tuple[int, bytes]:
        ids = PrefixTable(self, prefix).ids()
        self._prefixes[prefix] = out = ids[-1], pack(f"<{len(ids)}I", *ids)
        return out

    def _encode_piece(self, piece: str) -> bytes:
        """A piece of text; letters with one mark behind them need no pattern."""
        bare = piece[1:] if piece[0] == " " else piece
        if bare.isalpha():
            return self.encode_word(piece.encode())
        if bare[-1:] in (",", ".") and bare[:-1].isalpha():
            return self.encode_word(piece[:-1].encode()) + self._packed[self.ranks[bare[-1].encode()]]
        return b"".join([self.encode_word(w.encode()) for w in self.pattern.findall(piece)])

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers.

        No match of the pattern holds a space after another character, so a text is
        cut before each single space and the pieces are coded once each.  Texts where a
        space touches other white space are matched in one go.
        """
        known = self._pieces
        if len(known) > CACHE_PIECES:
            known.clear()
        first, *rest = text.split(" ")
        out = [self._encode_piece(first)] if first else []
        if spaces_touch(text):
            return self._encode_piece(text)
        try:
            out += map(known.__getitem__, rest)
        except KeyError:
            out = out[: bool(first)]
            for p in rest:
                ids = known.get(p)
                if ids is None:
                    ids = self._encode_piece(" " + p)
                    if len(p) < 64:
                        known[p] = ids
                out.append(ids)
        return b"".join(out)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


_touching = regex.compile(r" [\s\x1c-\x1f\x85]|[\s\x1c-\x1f\x85] ").search
#: White space other than the space and the line break, by any definition.
_RARE = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def spaces_touch(text: str) -> bool:
    """Whether a space stands beside white space or at an end of the text."""
    if "  " in text or " \n" in text or "\n " in text or text[:1] == " " or text[-1:] == " ":
        return True
    return any(c in text for c in _RARE) and _touching(text) is not None


_coders: dict[bytes, BytePairCoder] = {}


def _coder(data: bytes, pattern: str) -> BytePairCoder:
    """One coder per worker process, so that what it has learned serves later tasks too."""
    key = sha256(data + pattern.encode()).digest()
    if key not in _coders:
        _coders[key] = BytePairCoder(read_ranks(data), pattern)
    return _coders[key]


def _read(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, ids binary)``: the ids of each whole text, little-endian unsigned 32-bit.

    The rank file (a vocabulary, of fixed size) is read by the driver and broadcast.
    Null and empty texts have no ids; repeated rows each give a row; an empty table
    gives none; texts of any length are coded whole; other columns are ignored.
    """
    spark = docs.sparkSession
    prepare(spark)
    vocabulary = spark.sparkContext.broadcast(_read(ranks_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(vocabulary.value, pattern)
        for b in batches:
            ids = [coder.encode(t) if t else b"" for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return pick(docs, doc_id=id_col, text=text_col).mapInArrow(run, "doc_id long, ids binary")


def decode(coded: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``(doc_id, ids, decoded binary)``; null ids decode to no bytes."""
    spark = coded.sparkSession
    prepare(spark)
    vocabulary = spark.sparkContext.broadcast(_read(ranks_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(vocabulary.value, "")
        for b in batches:
            out = [coder.decode(np.frombuffer(x, "<u4").tolist()) if x else b"" for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary())], ["doc_id", "ids", "decoded"])

    return pick(coded, doc_id=id_col, ids=ids_col).mapInArrow(run, "doc_id long, ids binary, decoded binary")
