"""Personal data in texts by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, plus signs before
a digit, digits beside digits or dots, URL schemes, and words that announce an
identifier.  Around each anchor a local parser expands to the boundaries of
the thing and checks it.  Text without anchors costs only the pass.

Kinds: ``email``, ``ip``, ``card`` and ``phone`` (the base), ``address``
(a URL naming a user, or a ``mailto:`` / ``tel:`` link) and ``account``
(an IBAN with its check digits, or a number after a cue such as "account no").
Spans of one kind never overlap; offsets are code points, the end is exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pick, prepare

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "address", "account")

# Schemes, and words that announce an account number.
SCHEMES = ("http://", "https://", "ftp://", "ssh://", "sftp://", "mailto:", "tel:")
CUES = ("account", "acct", "iban", "passport", "routing", "social security", "ssn")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGITS = frozenset("0123456789")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_FOUR = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_USER_URL = re.compile(r"[^\s/@?#]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*(?::[0-9]{1,5})?")
_MAILTO = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_TEL = re.compile(r"\+?[0-9][0-9().-]{5,20}[0-9]")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_NUMBER = re.compile(r"(?:[ \t]*(?:no|nr|num|number|id)\b\.?)?[ \t]*[:#=]?[ \t]*(?=([0-9](?:[ -]?[0-9]){5,16})(?![0-9A-Za-z]))", re.I)
_AFTER_CUE = re.compile(r"(?:[ \t]*(?:no|nr|number)\b\.?)?[ \t]*[:#=]?[ \t]*", re.I)


def _automaton() -> ahocorasick.Automaton:
    """Anchors by the order of their last character.  The texts it reads are in lower case:
    only cues and schemes have letters."""
    a = ahocorasick.Automaton()
    digits = "0123456789"
    a.add_word("@", ("email", 0))
    for d in digits:
        a.add_word(f"+{d}", ("phone", 1))
        for e in digits:
            a.add_word(f"{d}.{e}", ("ip", 2))
            a.add_word(f"{d}{e}", ("card", 1))
            a.add_word(f"{d} {e}", ("card", 2))
            a.add_word(f"{d}-{e}", ("card", 2))
    for s in SCHEMES:
        a.add_word(s, ("address", 0))
    for c in CUES:
        a.add_word(c, ("account", len(c) - 1))
    a.make_automaton()
    return a


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k & 1:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def iban_ok(code: str) -> bool:
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def _lower(text: str) -> str:
    """Lower case without changing any offset."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


class Finder:
    """Finds the spans of one text after another."""

    def __init__(self) -> None:
        self.automaton = _automaton()

    def spans(self, text: str) -> list[tuple[str, int, int]]:
        done = dict.fromkeys(KINDS, 0)  # up to where each kind has been read
        out: list[tuple[str, int, int]] = []
        for end, (kind, back) in self.automaton.iter(_lower(text)):
            at = end - back
            if at >= done[kind]:
                getattr(self, kind)(text, at, end + 1, done, out)
        rank = {k: i for i, k in enumerate(KINDS)}
        return sorted(out, key=lambda s: (rank[s[0]], s[1]))

    def email(self, text: str, at: int, _: int, done: dict, out: list) -> None:
        start = at
        while start > done["email"] and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            done["email"] = m.end()
            out.append(("email", start, m.end()))

    def ip(self, text: str, at: int, _: int, done: dict, out: list) -> None:
        start = at
        while start > done["ip"] and text[start - 1] in _DIGITS:
            start -= 1
        m = _FOUR.match(text, start)
        if not m:
            done["ip"] = _DOTTED.match(text, start).end()
            return
        done["ip"] = m.end()
        if all(map(_octet, m[0].split("."))):
            out.append(("ip", *m.span()))

    def card(self, text: str, at: int, _: int, done: dict, out: list) -> None:
        m = _CARD.match(text, at)
        done["card"] = m.end()
        number = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(number) <= 19 and luhn(number):
            out.append(("card", *m.span()))

    def phone(self, text: str, at: int, _: int, done: dict, out: list) -> None:
        m = _PHONE.match(text, at)
        if m:
            done["phone"] = m.end()
            if 9 <= sum(c in _DIGITS for c in m[0]) <= 15:
                out.append(("phone", *m.span()))

    def address(self, text: str, _: int, after: int, done: dict, out: list) -> None:
        scheme = next(s for s in SCHEMES if text[max(0, after - len(s)) : after].lower() == s)
        start = after - len(scheme)
        if start < done["address"] or start and text[start - 1].isalnum():
            return
        m = {"mailto:": _MAILTO, "tel:": _TEL}.get(scheme, _USER_URL).match(text, after)
        if m:
            done["address"] = m.end()
            out.append(("address", start, m.end()))

    def account(self, text: str, at: int, after: int, done: dict, out: list) -> None:
        if at and text[at - 1].isalnum():
            return
        start = _AFTER_CUE.match(text, after).end()
        if m := _IBAN.match(text, start):
            if iban_ok(m[0].replace(" ", "")):
                done["account"] = m.end()
                out.append(("account", *m.span()))
        elif m := _NUMBER.match(text, after):
            done["account"] = m.end(1)
            out.append(("account", *m.span(1)))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, spans array<struct<kind, start, end>>)``, ordered by kind (as in ``KINDS``) and start.

    Null and empty texts have no spans; repeated rows each give a row; an empty table
    gives none; texts of any length are read whole; other columns are ignored.
    """
    prepare(docs.sparkSession)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder()
        for b in batches:
            found = [[{"kind": k, "start": s, "end": e} for k, s, e in finder.spans(t)] if t else [] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, kind)], ["doc_id", "spans"])

    return pick(docs, doc_id=id_col, text=text_col).mapInArrow(run, "doc_id long, spans array<struct<kind string, start long, end long>>")


def spelled(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(found: DataFrame) -> DataFrame:
    """Counts by kind, the hash of the base spans and all spans as one string."""
    def count(k: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")

    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select("doc_id", *map(count, BASE_KINDS), F.sha2(spelled(base), 256).alias("base_sha256"),
                        spelled(F.col("spans")).alias("spans"), *map(count, KINDS[len(BASE_KINDS):]))
