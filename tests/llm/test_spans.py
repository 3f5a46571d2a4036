import base64
import hashlib
import json
import random
import re

import pytest

from tests.llm.corpus import LONG, documents, plain
from tidemark.llm import pii, queries, secrets

PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
SECRETS = {
    "assign": r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]+",
}


def passes(kind, match):
    digits = re.sub("[^0-9]", "", match[0])
    return {
        "email": lambda: True,
        "ip": lambda: all(int(p) <= 255 for p in match[0].split(".")),
        "card": lambda: 14 <= len(digits) <= 19 and pii.luhn(digits),
        "phone": lambda: 10 <= len(digits) <= 15,
        "assign": lambda: len(match[2]) >= 6,
        "access": lambda: len(match[0]) >= 20,
        "hex": lambda: len(match[0]) >= 24,
    }[kind]()


def plainly(text, patterns):
    return [(k, *m.span()) for k, p in patterns.items() for m in re.finditer(p, text, re.ASCII) if passes(k, m)]


@pytest.mark.parametrize("letters", ["ab.@- 1", "0123.25 -", "+0123456789 ().-", "12 @.a+-", "4111 1-", "0.1"])
def test_base_pii_equals_the_patterns(letters):
    rng = random.Random(letters)
    for _ in range(4000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 50)))
        text += rng.choice(("", " 4111 1111-1111 1111 ", " +1 (555) 123-4567", "é a.b@c.de.f"))
        found = [s for s in pii.find(text) if s[0] in pii.BASE]
        assert sorted(found) == sorted(plainly(text, PII)), text


def test_base_secrets_equal_the_patterns():
    rng = random.Random(3)
    parts = ["token", "SECRET", "api_key", "apikey", "=", ":", " ", '"', "'", "a", "AKIA", "0123456789ABCDEF", "f00d", "abcdef0123456789", ".", "ſecret"]
    for _ in range(20000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        found = [s for s in secrets.find(text) if s[0] in secrets.BASE]
        assert sorted(found) == sorted(plainly(text, SECRETS)), text


def test_added_personal_data():
    text = "See https://shop.example.com/a?b=1. IBAN: DE89 3704 0044 0532 0130 00, account no. 12345678; 12 Old Mill Road here"
    found = {k: text[a:b] for k, a, b in pii.find(text)}
    assert found["url"] == "https://shop.example.com/a?b=1"
    assert found["iban"] == "DE89 3704 0044 0532 0130 00"
    assert found["account"] == "12345678"
    assert found["street"] == "12 Old Mill Road"
    wrong = "IBAN DE89 3704 0044 0532 0130 01, http://nohost, Old Road, account 12"
    assert not [s for s in pii.find(wrong) if s[0] not in pii.BASE]


def test_secrets_are_decoded_before_they_are_reported():
    part = lambda x: base64.urlsafe_b64encode(x).decode().rstrip("=")
    token = f"{part(json.dumps({'alg': 'HS256', 'typ': 'JWT'}).encode())}.{part(b'{}' * 6)}.{part(b's' * 32)}"
    der = bytes([0x30, 0x26, 0x02, 0x01, 0x00, 0x04, 0x21]) + bytes(range(33))
    ssh = b"".join(len(x).to_bytes(4, "big") + x for x in (b"ssh-ed25519", bytes(range(32))))
    body = base64.b64encode(der).decode()
    text = f"a {token} b {body} c {der.hex()} d {base64.b64encode(ssh).decode()}\n-----BEGIN PRIVATE KEY-----\n{body}\n-----END PRIVATE KEY-----"
    found = [k for k, _, _ in secrets.find(text)]
    assert {k: found.count(k) for k in ("token", "der", "ssh", "pem")} == {"token": 1, "der": 3, "ssh": 1, "pem": 1}
    broken = f"{part(b'no json here at all')}.abc.def {base64.b64encode(der[:-1]).decode()} {(der + b'x').hex()}"
    assert not [k for k, _, _ in secrets.find(broken) if k not in secrets.BASE]


@pytest.mark.parametrize("module, name", [(pii, "personal_data"), (secrets, "secrets")])
def test_awkward_rows(spark, module, name):
    found = getattr(module, name)(documents(spark)).collect()
    assert len(found) == 12
    assert [r.spans for r in found if r.doc_id in (2, 3, 4)] == [[], [], []]
    empty = getattr(module, name)(documents(spark, []))
    assert empty.count() == 0
    if module is pii:
        cards = next(r.spans for r in found if r.doc_id == 6)
        assert len(cards) == 4000
        assert all(LONG[s.start : s.end] == s.value for s in cards)
        assert [s.value for r in found if r.doc_id is None for s in r.spans] == ["who@example.org"]


def test_digest_columns(spark, tmp_path):
    plain(spark, [(1, "mail a@b.cd or 1.2.3.4 at http://x.org"), (2, None)]).write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in queries.op1_personal_data(spark, str(tmp_path)).collect()}
    base = "email:5:11,ip:15:22"
    assert (rows[1].n_email, rows[1].n_ip, rows[1].n_card, rows[1].n_phone) == (1, 1, 0, 0)
    assert rows[1].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
    assert rows[1].spans == f"{base},url:26:38"
    assert (rows[2].base_sha256, rows[2].spans) == (hashlib.sha256(b"").hexdigest(), "")
