import base64
import textwrap

import pytest

from tidemark.llm import secrets

BODY = textwrap.fill(base64.b64encode(bytes(range(256)) * 2).decode(), 64)
HEADERS = "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0123456789ABCDEF0123456789ABCDEF\n"


def key(body, label="RSA PRIVATE KEY"):
    return f"-----BEGIN {label}-----\n{body}\n-----END {label}-----"


def pems(text):
    return [text[a:b] for kind, a, b in secrets.find(text) if kind == "pem"]


@pytest.mark.parametrize("change", [str, lambda t: t.replace("\n", "\r\n"), lambda t: textwrap.indent(t, "    ").strip()])
@pytest.mark.parametrize("between", ["\n", "", "Comment: two\n  lines\n\n"])
def test_traditional_encrypted_keys(change, between):
    own = change(key(HEADERS + between + BODY))
    assert pems(f"see {own} and") == [own]


def test_keys_which_do_not_decode_or_do_not_end():
    good = key(HEADERS + "\n" + BODY)
    assert pems(f"-----BEGIN RSA PRIVATE KEY-----\n{HEADERS}\n{BODY}\n{good}\n{good}") == [good, good]
    assert not pems(key(HEADERS + "\n" + BODY + "!"))
    assert not pems(key(HEADERS))
    assert not pems(key(HEADERS + "\n" + BODY + "\n-----END EC PRIVATE KEY-----\n" + BODY))
    # not encrypted, and no key inside
    assert not pems(key("Comment: none\n\n" + BODY))
    assert not pems(key(BODY))
    assert pems(key(BODY, "ENCRYPTED PRIVATE KEY")) == [key(BODY, "ENCRYPTED PRIVATE KEY")]
