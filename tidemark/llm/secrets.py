"""Secrets by pattern, and by decoding what looks like encoded keys.

Base kinds ``assign, access, hex`` follow their patterns.  Candidates for the structural kinds
are the runs of base64 or hex characters; a run is reported only after it was decoded and its
content parsed:

* ``token``: three base64url parts, the first a JSON header which names an algorithm;
* ``der``: base64 or hex of an ASN.1 sequence whose nested lengths add up to its end;
* ``ssh``: base64 of length-prefixed fields, the first a key type, which add up to its end;
* ``pem``: a key between BEGIN and END lines whose body, without header lines, decodes to one of
  the two before, or, where its body is encrypted, to whole base64.

Null text: empty.  Positions are code points, the end is exclusive.  Repeated rows and rows
without key give a row each.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.common import keyed_text
from tidemark.llm.spans import SPAN, SPAN_DDL, in_order

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "token", "der", "ssh", "pem")

#: The base patterns.  A run holds every match of ``access`` and ``hex``.
_ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_RUN = re.compile(r"[A-Za-z0-9+/_.=-]{20,}")
_PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY|PUBLIC KEY|CERTIFICATE)-----((?:(?!-----BEGIN ).)*?)-----END \1-----", re.DOTALL)
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{32,}={0,2}")
_ANY_HEX = re.compile(r"(?:[0-9A-Fa-f]{2}){24,}")
#: Begins where a stretch of its characters begins, so that a long stretch is tried once.
_TOKEN = re.compile(r"(?<![A-Za-z0-9_-])([A-Za-z0-9_-]{10,})\.([A-Za-z0-9_-]{2,})\.([A-Za-z0-9_-]*)")


def unbase64(text: str) -> bytes | None:
    """The decoded bytes of standard or URL-safe base64, with or without padding."""
    body = text.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _length(data: bytes, at: int) -> tuple[int, int] | None:
    """Length and start of a DER value whose length begins at ``at``."""
    if at >= len(data):
        return None
    first = data[at]
    if first < 0x80:
        return first, at + 1
    size = first & 0x7F
    if not 1 <= size <= 4 or at + 1 + size > len(data):
        return None
    return int.from_bytes(data[at + 1 : at + 1 + size], "big"), at + 1 + size


def is_der(data: bytes | None) -> bool:
    """A sequence of at least two elements which fill it exactly, and it the data."""
    if not data or data[0] != 0x30 or (head := _length(data, 1)) is None:
        return False
    size, at = head
    if size < 16 or at + size != len(data):
        return False
    elements = 0
    while at < len(data):
        inner = _length(data, at + 1)
        if inner is None or inner[0] + inner[1] > len(data):
            return False
        at, elements = inner[0] + inner[1], elements + 1
    return elements >= 2


def is_ssh(data: bytes | None) -> bool:
    """Length-prefixed fields which fill the data; the first names a key type."""
    if not data or len(data) < 32:
        return False
    at, fields = 0, 0
    while at < len(data):
        size = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + size > len(data) or (not fields and not data[4 : 4 + size].startswith((b"ssh-", b"ecdsa-", b"sk-"))):
            return False
        at, fields = at + 4 + size, fields + 1
    return fields >= 2


def is_token_header(text: str) -> bool:
    try:
        header = json.loads((unbase64(text) or b"").decode())
    except (ValueError, UnicodeDecodeError, RecursionError):
        return False
    return isinstance(header, dict) and isinstance(header.get("alg"), str)


def _pem_body(text: str) -> tuple[dict[str, str], str]:
    """Header lines, by name, and the base64 after them.  No line of base64 has a colon."""
    lines = [line.strip() for line in text.strip().splitlines()]
    headers = dict(line.split(":", 1) for line in lines if ":" in line)
    if headers and "" in lines:  # a blank line ends the headers, continued ones too
        lines = lines[lines.index("") :]
    return headers, "".join("".join(line.split()) for line in lines if ":" not in line)


def is_pem(label: str, text: str) -> bool:
    headers, body = _pem_body(text)
    data = None if "-" in body else unbase64(body)
    encrypted = "ENCRYPTED" in label or "ENCRYPTED" in headers.get("Proc-Type", "")
    return bool(data) and (encrypted or is_der(data) or data.startswith(b"openssh-key-v1\0"))


def find(text: str) -> list[tuple[str, int, int]]:
    """All spans of a text as (kind, start, end)."""
    found = [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    for run in _RUN.finditer(text):
        low, high = run.span()
        found += [("access", *m.span()) for m in _ACCESS.finditer(text, low, high) if m.end() - m.start() >= 20]
        found += [("hex", *m.span()) for m in _HEX.finditer(text, low, high)]
        found += [("token", *m.span()) for m in _TOKEN.finditer(text, low, high) if is_token_header(m[1])]
        for m in _BASE64.finditer(text, low, high):
            data = unbase64(m[0])
            found += [(kind, *m.span()) for kind, test in (("der", is_der), ("ssh", is_ssh)) if test(data)]
        for m in _ANY_HEX.finditer(text, low, high):
            if is_der(bytes.fromhex(m[0])):
                found.append(("der", *m.span()))
    if "-----BEGIN " in text:
        found += [("pem", *m.span()) for m in _PEM.finditer(text) if is_pem(m[1], m[2])]
    return found


def secrets(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and all ``spans`` (kind, start, end, value) of each row of ``docs``."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [in_order(find(t), KINDS, t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(spans, pa.list_(SPAN))], names=["doc_id", "spans"]
            )

    return keyed_text(docs, key, text).mapInArrow(scan, f"doc_id bigint, spans {SPAN_DDL}")
