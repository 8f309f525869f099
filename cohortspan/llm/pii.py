"""Personal data by anchor expansion.

One Aho-Corasick automaton finds anchors: at-signs, plus signs, digits, dots before
digits, scheme marks and cue words. A parser for each kind expands its anchor to the
boundaries of an email, address, card, phone, login or account and validates it.
Parsers run from left to right and do not look into what a kind has consumed.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspan.llm.common import quoted

#: Fixed kinds of the contract, then those that the cues add.
BASE = ("email", "ip", "card", "phone")
ADDED = ("login", "iban", "ssn", "account")
CUES = {"iban": "iban", "ssn": "ssn", "social security": "ssn", "account": "account", "acct": "account"}

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DIGITS = frozenset("0123456789")
_SCHEME = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+.-")
_domain = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+").match
_numbers = re.compile(r"[0-9]+(?:\.[0-9]+)+").match
_card = re.compile(r"[0-9](?:[ -]?[0-9])+").match
_phone = re.compile(r"\+[0-9][ ().0-9-]+[0-9]").match
_login = re.compile(r"[^\s/?#@:]++:[^\s/?#@]++@[A-Za-z0-9.-]+").match


def _gap(inside: str) -> str:
    """Blanks, words such as "number is" and marks between a cue and its value; ``inside`` may not follow a word."""
    return rf"(?:[ \t]*+(?:(?i:number|num|no|nr|is)(?![{inside}])\.?|[:=#]))*+[ \t]*+"


_after = {
    # "NO" before digits is a country, not a word
    "iban": re.compile(_gap("A-Za-z0-9") + r"([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})").match,
    "ssn": re.compile(_gap("A-Za-z") + r"([0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9-])").match,
    "account": re.compile(_gap("A-Za-z") + r"([0-9]{6,17})(?![0-9A-Za-z])").match,
}
#: Length of an account number by country (ISO 13616).
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BI": 27, "BR": 29, "BY": 28, "CH": 21, "CR": 22,
    "CY": 28, "CZ": 24, "DE": 22, "DJ": 27, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FK": 18, "FO": 18, "FR": 27, "GB": 22,
    "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30,
    "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MN": 20, "MR": 27,
    "MT": 31, "MU": 30, "NI": 28, "NL": 18, "NO": 15, "OM": 23, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "RU": 33,
    "SA": 24, "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "SO": 23, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29,
    "VA": 22, "VG": 24, "XK": 20, "YE": 30,
}

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def iban_valid(value: str) -> bool:
    value = value.replace(" ", "")
    if len(value) != IBAN_LENGTHS.get(value[:2], len(value)):
        return False
    return 15 <= len(value) <= 34 and int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1


def iban_end(text: str, start: int, end: int) -> int:
    """Where the account number that starts at ``start`` ends: at its country's length, for other countries at ``end``."""
    left = IBAN_LENGTHS.get(text[start:start + 2])
    if left is None:
        return end
    for k in range(start, end):
        left -= text[k] != " "
        if left == 0:
            return k + 1
    return end


def ssn_valid(value: str) -> bool:
    area, group, serial = value.split("-")
    return area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    """Anchors and their (kind, length), built once per worker."""
    found = ahocorasick.Automaton()
    marks = {"@": "email", "+": "phone", "://": "login"} | {d: "card" for d in _DIGITS} | {f".{d}": "ip" for d in _DIGITS}
    marks |= {form: kind for word, kind in CUES.items() for form in (word, word.capitalize(), word.title(), word.upper())}
    for mark, kind in marks.items():
        found.add_word(mark, (kind, len(mark)))
    found.make_automaton()
    return found


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) < 256


def _email(text: str, at: int, floor: int) -> tuple[int, int, int] | None:
    start = at
    while start > floor and text[start - 1] in _LOCAL:
        start -= 1
    domain = _domain(text, at + 1) if start < at else None
    return (start, domain.end(), domain.end()) if domain else None


def spans(text: str | None) -> dict[str, list[Span]]:
    """Spans (kind, start, end) of every kind, in order of start; code points, end exclusive."""
    out: dict[str, list[Span]] = {kind: [] for kind in BASE + ADDED}
    if not text:
        return out
    ends = dict.fromkeys(out, 0)
    for last, (kind, size) in automaton().iter(text):
        at = last + 1 - size
        if kind == "card":
            if at >= ends[kind]:
                chain = _card(text, at)
                ends[kind] = chain.end() if chain else at + 1
                digits = chain and chain.group().replace(" ", "").replace("-", "")
                if chain and 16 <= len(digits) <= 19 and luhn(digits):
                    out[kind].append((kind, at, chain.end()))
        elif kind == "email":
            if (found := _email(text, at, ends[kind])) is not None:
                out[kind].append((kind, *found[:2]))
                ends[kind] = found[2]
        elif kind == "ip":
            if at > ends[kind] and text[at - 1] in _DIGITS:
                start = at
                while start > ends[kind] and text[start - 1] in _DIGITS:
                    start -= 1
                chain = _numbers(text, start)
                ends[kind] = chain.end()
                parts = chain.group().split(".")
                for k in range(0, len(parts) - 3, 4):
                    four = parts[k:k + 4]
                    end = start + len(".".join(four))
                    if all(map(_octet, four)):
                        out[kind].append((kind, start, end))
                    start = end + 1
        elif kind == "phone":
            found = _phone(text, at)
            if found and 8 <= sum(c in _DIGITS for c in found.group()) <= 15:
                out[kind].append((kind, at, found.end()))
        elif kind == "login":
            start = at
            while start > ends[kind] and text[start - 1] in _SCHEME:
                start -= 1
            found = _login(text, at + size) if start < at else None
            if found:
                out[kind].append((kind, start, found.end()))
                ends[kind] = found.end()
        else:
            found = _after[kind](text, at + size)
            if found and found.start(1) >= ends[kind]:
                start, end = found.span(1)
                if kind == "iban":
                    end = iban_end(text, start, end)
                value = text[start:end]
                if kind == "account" or (ssn_valid(value) if kind == "ssn" else iban_valid(value) and not text[end:end + 1].isalnum()):
                    out[kind].append((kind, start, end))
                    ends[kind] = end
    return out


def joined(found: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in found)


def masked(text: str, found: dict[str, list[Span]]) -> str:
    """The text with every span as its kind in brackets; overlapping spans go as one."""
    out, end = [], 0
    for kind, start, stop in sorted((s for f in found.values() for s in f), key=lambda s: (s[1], -s[2])):
        if start >= end:
            out += [text[end:start], f"[{kind}]"]
        end = max(end, stop)
    return "".join(out) + text[end:]


def find_pii(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256 and all spans of every row.

    Null and empty texts have no spans, and the hash of the empty string. Repeated rows
    give equal results; other columns are ignored.
    """
    fields = ", ".join(f"n_{k} long" for k in BASE) + ", base_sha256 string, spans string"

    @F.pandas_udf(fields)
    def of(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for value in texts:
            found = spans(value)
            base = joined([s for k in BASE for s in found[k]])
            rows.append((*(len(found[k]) for k in BASE), hashlib.sha256(base.encode()).hexdigest(), joined([s for f in found.values() for s in f])))
        return pd.DataFrame(rows, columns=[*(f"n_{k}" for k in BASE), "base_sha256", "spans"])

    return docs.select(quoted(doc_id).alias("doc_id"), of(quoted(text)).alias("found")).select("doc_id", "found.*")


def mask_pii(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows with personal data in ``text`` replaced by its kind; a null text stays null."""

    @F.pandas_udf("string")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([None if value is None else masked(value, spans(value)) for value in texts], dtype=object)

    return docs.withColumn(text, of(quoted(text)))
