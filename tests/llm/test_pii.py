import random
import re
from hashlib import sha256

from hypothesis import given, settings
from hypothesis import strategies as st

from keymerge.llm import pii
from keymerge.llm.catalog import QUERIES
from tests.llm.conftest import SF


def brute(text):
    """The base by plain pattern search."""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[ -]", "", m[0])
        if 13 <= len(d) <= 19 and pii.luhn(d):
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def base(spans):
    return [s for s in spans if s[0] in pii.BASE_KINDS]


@settings(max_examples=300, deadline=None)
@given(st.one_of(*[st.text(alphabet=a, max_size=40) for a in ("a@.1-", "0123.25", "12 -4", "+12 ().-3", "a1@.+- 25\u0130\u00df")]))
def test_base_equals_pattern_search(text):
    assert base(pii.Finder().spans(text)) == brute(text)


def test_valid_numbers():
    rng, finder = random.Random(1), pii.Finder()
    for _ in range(300):
        d = "".join(rng.choice("0123456789") for _ in range(rng.randint(12, 18)))
        d += next(c for c in "0123456789" if pii.luhn(d + c))
        text = f"x {d} y"
        assert base(finder.spans(text)) == brute(text)


def test_added_spans():
    text = "https://u:p@h.example.com/x IBAN: DE89 3704 0044 0532 0130 00, account no 12345678, an accountant 1234567"
    added = [(k, text[s:e]) for k, s, e in pii.Finder().spans(text) if k not in pii.BASE_KINDS]
    assert added == [("address", "https://u:p@h.example.com"), ("account", "DE89 3704 0044 0532 0130 00"), ("account", "12345678")]


def test_query_over_the_whole_table(spark, documents):
    got = {r.doc_id: r for r in QUERIES["op1_pii"](spark, SF).collect()}
    rows = documents.collect()
    assert len(got) == len(rows)
    for r in rows:
        want = brute(r.text)
        assert got[r.doc_id].base_sha256 == sha256(",".join(f"{k}:{s}:{e}" for k, s, e in want).encode()).hexdigest()
        assert got[r.doc_id].n_email == sum(k == "email" for k, *_ in want)


def test_odd_tables(odd, empty):
    rows = pii.digest(pii.find_pii(odd)).collect()
    assert len(rows) == odd.count()
    assert [(r.n_email, r.n_ip, r.n_card, r.n_phone) for r in rows if r.doc_id == 10] == [(1, 1, 1, 1)]
    assert all(r.spans == "" for r in rows if r.doc_id in (2, 3, 4))
    assert pii.find_pii(empty).count() == 0
