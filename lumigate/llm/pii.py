"""Personal data by anchor expansion: one Aho-Corasick pass finds at-signs, schemes and identifier cues; local
deterministic parsers expand each anchor to both sides and check the boundaries and digits.

Base kinds, leftmost and non-overlapping per kind, failing matches dropped without a retry: `email` expands from
an at-sign, `ip` from the dots between digits, `phone` from a plus sign before a digit, `card` from a chain of
12 or more digits (the chain is its own anchor) of at most 19 that passes Luhn's test.

The method adds: `login` (a scheme whose authority holds user:password@), `iban` (after its cue, checked modulo
97) and `account` (an account cue with 6 to 17 digits). Added spans never replace base ones.

A null or empty text has no spans; texts are scanned whole; rows, repeated ones too, are all kept.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lumigate.llm.base import table
from lumigate.llm.secrets import digest
from lumigate.llm.spans import Span, find_spans, lowered, ordered

BASE = ("email", "ip", "card", "phone")
ADDED = ("login", "iban", "account")
KINDS = BASE + ADDED

# The contract's character classes and patterns, and public formats.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DIGITS = frozenset("0123456789")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP_REST = re.compile(r"(?:\.[0-9]+){3}")
CHAIN = re.compile(r"[0-9](?:[\x20-]?[0-9]){11,}")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOGIN = re.compile(r"://[^\s/?#:@]+:[^\s/?#@]+@[^\s/?#@]+")
IBAN = re.compile(r"iban[\x20:#=]{0,4}([A-Za-z]{2}[0-9]{2}(?:\x20?[A-Za-z0-9]{1,4}){3,8})", re.A | re.I)
ACCOUNT = re.compile(r"(?:account|acct)(?:\x20?(?:number|no\.?|#))?[\x20:#=]{0,4}([0-9]{6,17})(?![0-9])", re.A | re.I)
ANCHORS = {"@": "email", "+": "phone", "://": "login", "iban": "iban", "account": "account", "acct": "account"} | {f".{d}": "ip" for d in "0123456789"}


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


#: Of a letter or digit in an account number: its value, and the power of ten that it shifts what precedes by.
VALUES = {c: (int(c, 36), 10 if c.isdigit() else 100) for c in "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"}


def iban_end(text: str, start: int, end: int) -> int | None:
    """Where the longest account number of 15 to 34 characters that begins at start, ends before a letter or digit doesn't follow, and passes its checksum.

    The checksum is that of the number with its first four characters, six digits, moved to its end: one running remainder gives it for every end.
    """
    rest = head = n = 0
    found = None
    for at in range(start, end):
        if text[at] == " ":
            continue
        value, shift = VALUES[text[at]]
        n += 1
        if n <= 4:
            head = head * shift + value
        else:
            rest = (rest * shift + value) % 97
        if 15 <= n <= 34 and (rest * 1_000_000 + head) % 97 == 1 and not text[at + 1 : at + 2].isalnum():
            found = at + 1
    return found


def _back(text: str, at: int, floor: int, chars: frozenset) -> int:
    while at > floor and text[at - 1] in chars:
        at -= 1
    return at


def _digits(text: str) -> str:
    return "".join(c for c in text if c in DIGITS)


def pii_finder() -> Callable[[str], list[Span]]:
    import ahocorasick

    anchors = ahocorasick.Automaton()
    for word, kind in ANCHORS.items():
        anchors.add_word(word, (kind, len(word) - 1))
    anchors.make_automaton()

    def scan(text: str) -> list[Span]:
        found: list[Span] = []
        for m in CHAIN.finditer(text):
            d = _digits(m[0])
            if len(d) <= 19 and luhn(d):
                found.append(("card", *m.span()))
        ends = dict.fromkeys(KINDS, 0)
        for start, kind in sorted((end - back, kind) for end, (kind, back) in anchors.iter(lowered(text))):
            floor = ends[kind]
            if start < floor:
                continue
            if kind == "email":
                left = _back(text, start, floor, LOCAL)
                if left < start and (m := DOMAIN.match(text, start + 1)):
                    found.append((kind, left, m.end()))
                    ends[kind] = m.end()
            elif kind == "ip":
                left = _back(text, start, floor, DIGITS)
                if left < start and (m := IP_REST.match(text, start)):
                    if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in text[left : m.end()].split(".")):
                        found.append((kind, left, m.end()))
                    ends[kind] = m.end()
            elif kind == "phone":
                if m := PHONE.match(text, start):
                    if 9 <= len(_digits(m[0])) <= 15:
                        found.append((kind, *m.span()))
                    ends[kind] = m.end()
            elif kind == "login":
                if m := LOGIN.match(text, start):
                    found.append((kind, _back(text, start, floor, LOCAL), m.end()))
                    ends[kind] = m.end()
            elif m := (IBAN if kind == "iban" else ACCOUNT).match(text, start):
                # what follows an account number may look like more of it, so shorter ends are tried too
                if stop := m.end() if kind == "account" else iban_end(text, *m.span(1)):
                    found.append((kind, m.start(1), stop))
                    ends[kind] = stop
        return ordered(found, KINDS)

    return scan


def find_personal_data(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with `found`, the spans of personal data in order of start and then kind."""
    return find_spans(docs, pii_finder, text)


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(find_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "found"), BASE)
