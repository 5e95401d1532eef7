"""Secret scan: one Aho-Corasick pass finds keywords, anchored patterns run only at their hits, and formats
that embed a checksum are checked against it.

Base kinds, leftmost and non-overlapping per kind; a match that fails its length test is dropped and still
consumes its text: `assign` (a keyword given a value of 6 or more characters), `access` (AKIA and 16 or more),
`hex` (runs of 24 or more). Hexadecimal runs have no keyword: they are their own anchor and found by their run.

The method adds: `github` and `npm` tokens whose last six characters are the base-62 CRC-32 of the thirty
before them, `jwt` whose header and payload decode to JSON objects, and `pem` private-key blocks with both
armour lines. Added spans never replace base ones.

A null or empty text has no spans; texts are scanned whole; rows, repeated ones too, are all kept.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumigate.llm.base import table
from lumigate.llm.spans import Span, find_spans, lowered, ordered

BASE = ("assign", "access", "hex")
ADDED = ("github", "npm", "jwt", "pem")
KINDS = BASE + ADDED

# The contract's patterns and the public formats of tokens that carry a checksum.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
GITHUB = re.compile(r"gh[pousr]_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
NPM = re.compile(r"npm_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
JWT = re.compile(r"(eyJ[A-Za-z0-9_-]++)\.(eyJ[A-Za-z0-9_-]++)\.[A-Za-z0-9_-]+")
JWT_RUN = re.compile(r"[A-Za-z0-9_-]+")
PEM = re.compile(r"-----BEGIN ([A-Z ]*)PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END \1PRIVATE KEY-----")
KEYWORDS = {
    "assign": ("password", "passwd", "secret", "token", "apikey", "api_key"),
    "access": ("akia",),
    "github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
    "npm": ("npm_",),
    "jwt": ("eyj",),
    "pem": ("-----begin ",),
}
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def crc_base62(body: str) -> str:
    n, out = zlib.crc32(body.encode()), ""
    while n:
        n, r = divmod(n, 62)
        out = BASE62[r] + out
    return out.rjust(6, "0")


def _checksum(m: re.Match) -> bool:
    return crc_base62(m[1]) == m[2]


def _jwt(m: re.Match) -> bool:
    try:
        return all(isinstance(json.loads(base64.urlsafe_b64decode(p + "=" * (-len(p) % 4))), dict) for p in (m[1], m[2]))
    except (ValueError, RecursionError):  # neither text nor JSON, or nested deeper than any token
        return False


#: kind -> anchored pattern, what a match must pass.
ANCHORED: dict[str, tuple[re.Pattern, Callable[[re.Match], bool]]] = {
    "assign": (ASSIGN, lambda m: len(m[2]) >= 6),
    "access": (ACCESS, lambda m: m.end() - m.start() >= 20),
    "github": (GITHUB, _checksum),
    "npm": (NPM, _checksum),
    "jwt": (JWT, _jwt),
    "pem": (PEM, lambda m: True),
}


def secret_finder() -> Callable[[str], list[Span]]:
    import ahocorasick

    words = ahocorasick.Automaton()
    for kind, keys in KEYWORDS.items():
        for k in keys:
            words.add_word(k, (kind, len(k) - 1))
    words.make_automaton()

    def scan(text: str) -> list[Span]:
        found = [("hex", *m.span()) for m in HEX.finditer(text)]
        hits = sorted((end - back, kind) for end, (kind, back) in words.iter(lowered(text)))
        ends = dict.fromkeys(ANCHORED, 0)
        for start, kind in hits:
            pattern, passes = ANCHORED[kind]
            # a hit inside the last match of its kind can't start one
            if start < ends[kind]:
                continue
            if m := pattern.match(text, start):
                ends[kind] = m.end()
                if passes(m):
                    found.append((kind, start, m.end()))
            elif kind == "jwt" and (run := JWT_RUN.match(text, start)):
                # the run isn't a header, so no later start in it is one: each run is read twice at most
                ends[kind] = run.end()
        return ordered(found, KINDS)

    return scan


def find_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with `found`, the spans of secrets in order of start and then kind."""
    return find_spans(docs, secret_finder, text)


def digest(found: DataFrame, base: tuple[str, ...], key: str = "doc_id") -> DataFrame:
    """key, the number of spans of each base kind, base_sha256 and spans."""

    def text_of(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    of_base = F.filter("found", lambda s: s["kind"].isin(*base))

    def count_of(kind):
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count_of(k) for k in base]
    return found.select(key, *counts, F.sha2(text_of(of_base), 256).alias("base_sha256"), text_of(F.col("found")).alias("spans"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "found"), BASE)
