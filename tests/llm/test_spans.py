"""The span finders against the plain patterns over whole texts."""

import random
import re

import pytest

from lumigate.llm import pii, secrets
from lumigate.llm.spans import joined, ordered


def plain_secrets(text):
    out = [("assign", *m.span()) for m in re.finditer(r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text) if len(m[2]) >= 6]
    out += [("access", *m.span()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [("hex", *m.span()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return ordered(out, secrets.KINDS)


def plain_pii(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and pii.luhn(d):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return ordered(out, pii.KINDS)


PIECES = {
    "secrets": ["password", "PassWd", "secret", "toKen", "token", "api_key", "APIKEY", "api", "=", ":", " ", '"', "'", "abcdef", "0123456789abcdef", "deadbeef", "AKIA", "ABCDEFGH1234", "é", "İ", "ſ", "K", "\n", "/+_", "ghp_", "x" * 30],
    "pii": ["a", "b.c", "@", "@", "x-y", ".", "com", "1", "12", "255", "256", "4111 1111 1111 1111", "4111-1111", "+", "+1", "(", ")", " ", "-", "9", "é", "://", "user:pw@", "iban ", "account 12345678", "\n", "0", "00", "127.0.0.1", "１"],
}


@pytest.mark.parametrize(("name", "finder", "plain", "base"), [("secrets", secrets.secret_finder, plain_secrets, secrets.BASE), ("pii", pii.pii_finder, plain_pii, pii.BASE)])
def test_base_spans_are_those_of_the_plain_patterns(name, finder, plain, base):
    scan, rnd = finder(), random.Random(7)
    for _ in range(30_000):
        text = "".join(rnd.choice(PIECES[name]) for _ in range(rnd.randint(0, 14)))
        assert [s for s in scan(text) if s[0] in base] == plain(text), text


def test_checksums_decide_on_tokens():
    body = "a1B2" * 7 + "xy"
    good, bad = f"ghp_{body}{secrets.crc_base62(body)}", f"ghp_{body}000000"
    assert ("github", 2, 42) in secrets.secret_finder()(f"x {good} y")
    assert not [s for s in secrets.secret_finder()(bad) if s[0] == "github"]
    assert ("npm", 0, 40) in secrets.secret_finder()(f"npm_{body}{secrets.crc_base62(body)}")
    assert [s[0] for s in secrets.secret_finder()("eyJhIjoxfQ.eyJiIjoyfQ.sig eyJxx.eyJyy.zz")] == ["jwt"]


def test_account_boundaries():
    scan = pii.pii_finder()
    assert ("iban", 5, 27) in scan("iban GB82WEST12345698765432")
    assert not [s for s in scan("iban GB82WEST12345698765431") if s[0] == "iban"]
    assert ("account", 9, 17) in scan("Account: 12345678")
    assert ("login", 0, 27) in scan("ftp://user:pass@example.org/x")


@pytest.mark.parametrize(("find", "base"), [(secrets.find_secrets, secrets.BASE), (pii.find_personal_data, pii.BASE)])
def test_nulls_empty_long_and_repeated_rows(spark, find, base):
    long = "word " * 60_000 + "token = abcdef123 a@b.org"
    rows = [(1, None, "x"), (None, "", "y"), (2, long, None), (2, long, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, found string")
    out = secrets.digest(find(docs), base).collect()
    assert len(out) == 4
    assert sorted(r.spans == "" for r in out) == [False, False, True, True]
    assert {r.base_sha256 for r in out if r.spans == ""} == {"e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"}
    assert find(docs.limit(0)).count() == 0


def test_joined():
    assert joined([("hex", 1, 30)]) == "hex:1:30"


@pytest.mark.parametrize("text", ["eyJ" * 1_000_000, "eyJa." * 600_000, "eyJa.eyJb" * 300_000, "-----BEGIN PRIVATE KEY-----\n" * 100_000, "token" * 600_000, "AKIA" * 700_000, "password:" * 300_000, "gho_" * 700_000])
def test_secrets_of_long_texts_take_time_in_proportion(text):
    import time

    began = time.process_time()
    secrets.secret_finder()(text)
    assert time.process_time() - began < 20


@pytest.mark.parametrize("text", ["a@" * 1_000_000, "1.1" * 1_000_000, "+1 " * 1_000_000, "iban GB82 " * 300_000, "://a:" * 500_000, "1" * 3_000_000, "account " * 300_000])
def test_personal_data_of_long_texts_takes_time_in_proportion(text):
    import time

    began = time.process_time()
    pii.pii_finder()(text)
    assert time.process_time() - began < 20


def test_an_account_number_ends_before_the_words_that_follow():
    scan = pii.pii_finder()
    for after in ("", " thank you", ", thanks", " 2024 was good", ". "):
        assert ("iban", 5, 27) in scan("iban GB82WEST12345698765432" + after), after
        assert ("iban", 5, 32) in scan("IBAN GB82 WEST 1234 5698 7654 32" + after), after
    assert not [s for s in scan("iban GB83WEST12345698765432 thank you") if s[0] == "iban"]


def test_the_end_of_an_account_number_is_that_of_trying_every_end():
    import random

    rnd = random.Random(6)

    def ok(value):
        v = value.replace(" ", "").upper()
        return 15 <= len(v) <= 34 and int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1

    for _ in range(3000):
        text = "GB82WEST12345698765432" * rnd.randint(0, 1) + "".join(rnd.choice("AB1 2z") for _ in range(rnd.randint(0, 40))) + "é"
        text = ("GB82" + text) if not text.startswith("GB82") else text
        ends = [e for e in range(len(text) - 1, 14, -1) if text[e - 1] != " " and not text[e : e + 1].isalnum() and ok(text[:e])]
        assert pii.iban_end(text, 0, len(text) - 1) == (ends[0] if ends else None)


def test_a_deeply_nested_token_is_none():
    import base64

    def part(levels):
        return base64.urlsafe_b64encode(b'{"a":' * levels + b"1" + b"}" * levels).decode().rstrip("=")

    scan = secrets.secret_finder()
    assert [s for s in scan(f"x {part(2)}.{part(1)}.sig y") if s[0] == "jwt"]
    assert not [s for s in scan(f"x {part(100_000)}.{part(1)}.sig y") if s[0] == "jwt"]
