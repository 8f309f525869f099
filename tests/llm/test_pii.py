import hashlib
import re
import timeit

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cohortspan.llm import pii
from tests.llm.conftest import ODD

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def digits(text):
    return re.sub("[^0-9]", "", text)


def luhn(number):
    odd = [int(d) for d in number[-1::-2]]
    even = [sum(divmod(2 * int(d), 10)) for d in number[-2::-2]]
    return (sum(odd) + sum(even)) % 10 == 0


def brute(text):
    text = text or ""
    return {
        "email": [m.span() for m in EMAIL.finditer(text)],
        "ip": [m.span() for m in IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))],
        "card": [m.span() for m in CARD.finditer(text) if 16 <= len(digits(m.group())) <= 19 and luhn(digits(m.group()))],
        "phone": [m.span() for m in PHONE.finditer(text) if 8 <= len(digits(m.group())) <= 15],
    }


def check(text):
    got = pii.spans(text)
    assert {k: [s[1:] for s in got[k]] for k in pii.BASE} == brute(text)


@pytest.mark.parametrize("alphabet", ["1.", "12.9 -", "a@.b", "a1@.-+%_", "+1 ().-9", "0 -4+.@a)", "é1.@a+٣"])
def test_base_spans_are_those_of_the_patterns(alphabet):
    @given(st.text(alphabet=alphabet, max_size=50))
    @settings(max_examples=300, deadline=None)
    def run(text):
        check(text)

    run()


def test_long_numbers_and_cards():
    check("4539 1488 0343 6467, 4539148803436467x 4539-1488-0343-6467 " + "9" * 5000 + ".1.2.3 1.2.3.4.5.6.7.8.9 255.256.1.1 001.02.3.4")
    assert pii.luhn("4539148803436467") and not pii.luhn("4539148803436468")


def test_added_kinds():
    text = "see https://bob:pw1@host.example/x, IBAN: GB82 WEST 1234 5698 7654 32, ssn 123-45-6789, SSN 000-45-6789, account no. 12345678!"
    found = pii.spans(text)
    assert [text[s:e] for _, s, e in found["login"]] == ["https://bob:pw1@host.example"]
    assert [text[s:e] for _, s, e in found["iban"]] == ["GB82 WEST 1234 5698 7654 32"]
    assert [text[s:e] for _, s, e in found["ssn"]] == ["123-45-6789"]
    assert [text[s:e] for _, s, e in found["account"]] == ["12345678"]
    assert "12345678!" not in pii.masked(text, found) and "[ssn]" in pii.masked(text, found)
    assert not any(pii.spans("on account of the ssn, iban or +1 x")[k] for k in pii.BASE + pii.ADDED)


def test_documents(docs, corpus):
    got = {r["doc_id"]: r for r in pii.find_pii(docs).collect()}
    for doc_id, text, *_ in corpus:
        want, r = brute(text), got[doc_id]
        assert [r[f"n_{k}"] for k in pii.BASE] == [len(want[k]) for k in pii.BASE]
        base = ",".join(f"{k}:{s}:{e}" for k in pii.BASE for s, e in want[k])
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert r["spans"].startswith(base)
    assert sum(r["n_email"] + r["n_card"] for r in got.values()) > 0


def test_odd_rows(odd, empty):
    got = pii.find_pii(odd).collect()
    assert len(got) == len(ODD) and pii.find_pii(empty).count() == 0
    assert {r["base_sha256"] for r in got if r["doc_id"] in (5, 6)} == {hashlib.sha256(b"").hexdigest()}
    masked = pii.mask_pii(odd)
    assert masked.columns == odd.columns
    assert [r["text"] for r in masked.collect() if r["doc_id"] == 5] == [None]


@pytest.mark.parametrize("kind, text, value", [
    ("account", "Account Number: 12345678", "12345678"),
    ("account", "account number is 12345678.", "12345678"),
    ("account", "ACCT NO.12345678", "12345678"),
    ("account", "account no12345678", "12345678"),
    ("account", "Account" + " " * 300 + "No" + " " * 300 + "is: 12345678", "12345678"),
    ("iban", "IBAN DE89370400440532013000 BIC COBADEFFXXX", "DE89370400440532013000"),
    ("iban", "Iban No. is GB82 WEST 1234 5698 7654 32 AND MORE 12", "GB82 WEST 1234 5698 7654 32"),
    ("iban", "IBAN NO9386011117947", "NO9386011117947"),
    ("iban", "IBAN: NO 93 8601", None),
    ("iban", "IBAN DE89370400440532013001", None),
    ("iban", "IBAN DE89370400440532013000X", None),
    ("iban", "IBAN DE8937040044053201300", None),
    ("ssn", "Social Security Number Is 123-45-6789", "123-45-6789"),
    ("login", "https://user:" + "x" * 140 + "@host.example/path", "https://user:" + "x" * 140 + "@host.example"),
    ("login", "a-scheme-of-more-than-sixteen://" + "u" * 100 + ":p@h", "a-scheme-of-more-than-sixteen://" + "u" * 100 + ":p@h"),
    ("login", "https://host.example/a:b@c", None),
])
def test_added_kinds_have_no_caps(kind, text, value):
    assert [text[s:e] for _, s, e in pii.spans(text)[kind]] == ([] if value is None else [value])


@pytest.mark.parametrize("part", ["IBAN AA11 ", "account no ", "://a:", "a@", "https://u:p@h ", "12.3.4.5 ", "+1 234 5678 ", "account 123456, "])
def test_long_texts_full_of_anchors_take_linear_time(part):
    def seconds(n):
        text = part * n
        return min(timeit.repeat(lambda: pii.spans(text), number=1, repeat=3))

    assert seconds(16_000) < 40 * max(seconds(1_000), 1e-3)
