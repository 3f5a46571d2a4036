"""Personal data by anchor expansion.

One Aho-Corasick pass over the text finds anchors: at-signs, plus signs, digits, schemes and
the cue words of accounts and streets.  Around each anchor a small deterministic parser
extends to both sides and validates.  Within a kind spans are leftmost and do not overlap: a
parser never reaches back over the end of the match before it, and a match which fails its
validation is passed over whole.

Kinds in order: ``email, ip, card, phone`` (base), then ``url, iban, account, street``.
Null text: empty.  Positions are code points, the end is exclusive.  Repeated rows and rows
without key give a row each.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.common import keyed_text
from tidemark.llm.spans import SPAN, SPAN_DDL, in_order

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "iban", "account", "street")

DIGITS = frozenset("0123456789")
LETTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
LOCAL = LETTERS | DIGITS | frozenset("._%+-")
LABEL = LETTERS | DIGITS | frozenset("-")
PHONE = DIGITS | frozenset(" ().-")
SCHEME = LETTERS | DIGITS | frozenset("+.-")
HOST = LABEL | frozenset(".:@_%~")
URL_STOP = frozenset(' \t\n\r\x0b\x0c"<>`{}|\\^')

#: Cue words in front of account numbers, and behind street names.
ACCOUNT_CUES = ("account", "acct", "konto", "kontonummer", "compte", "cuenta")
STREET_CUES = ("Street", "Avenue", "Road", "Boulevard", "Lane", "Drive")

_AUTOMATON: list = []


def _automaton():
    if not _AUTOMATON:
        made = ahocorasick.Automaton()
        made.add_word("@", ("@", "@"))
        made.add_word("+", ("+", "+"))
        made.add_word("://", ("url", "://"))
        for digit in sorted(DIGITS):
            made.add_word(digit, ("0", digit))
        for word in ACCOUNT_CUES:
            for form in {word, word.capitalize(), word.upper()}:
                made.add_word(form, ("account", form))
        for form in ("IBAN", "iban", "Iban"):
            made.add_word(form, ("iban", form))
        for word in STREET_CUES:
            made.add_word(" " + word, ("street", " " + word))
        made.make_automaton()
        _AUTOMATON.append(made)
    return _AUTOMATON[0]


def _run(text: str, at: int, allowed: frozenset) -> int:
    """End of the run of ``allowed`` characters which starts at ``at``."""
    n = len(text)
    while at < n and text[at] in allowed:
        at += 1
    return at


def _back(text: str, at: int, allowed: frozenset, floor: int) -> int:
    """Start of the run of ``allowed`` characters which ends before ``at``, not below ``floor``."""
    while at > floor and text[at - 1] in allowed:
        at -= 1
    return at


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        value = int(d) * (1 + k % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def _email(text: str, at: int, floor: int):
    """(start, end, valid) of the match around the at-sign, or None if there is none."""
    start, end = _back(text, at, LOCAL, floor), _run(text, at + 1, LABEL)
    if start == at or end == at + 1:
        return None
    last = end
    while last < len(text) and text[last] == "." and (more := _run(text, last + 1, LABEL)) > last + 1:
        last = more
    return (start, last, True) if last > end else None


def _address(text: str, at: int):
    """Four numbers joined by dots; ``at``: first digit of a run."""
    end = _run(text, at, DIGITS)
    parts = [text[at:end]]
    while len(parts) < 4:
        if end >= len(text) or text[end] != "." or (more := _run(text, end + 1, DIGITS)) == end + 1:
            return None
        parts.append(text[end + 1 : more])
        end = more
    return at, end, all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in parts)


def _card(text: str, at: int):
    end, n = at + 1, len(text)
    while end < n:
        if text[end] in DIGITS:
            end += 1
        elif text[end] in " -" and end + 1 < n and text[end + 1] in DIGITS:
            end += 2
        else:
            break
    if end == at + 1:
        return None
    digits = text[at:end].replace(" ", "").replace("-", "")
    return at, end, 14 <= len(digits) <= 19 and luhn(digits)


def _phone(text: str, at: int):
    if at + 1 >= len(text) or text[at + 1] not in DIGITS:
        return None
    end = _run(text, at + 2, PHONE)
    while end > at + 2 and text[end - 1] not in DIGITS:
        end -= 1
    if end < at + 4:  # at least one character between the first digit and the last
        return None
    return at, end, 10 <= sum(c in DIGITS for c in text[at:end]) <= 15


def _url(text: str, at: int, floor: int):
    start = _back(text, at, SCHEME, floor)
    while start < at and text[start] not in LETTERS:
        start += 1
    # the host first, so that an anchor without one costs no look at the rest
    stop = _run(text, at + 3, HOST)
    host = text[at + 3 : stop].rpartition("@")[2].partition(":")[0].rstrip(".")
    labels = host.split(".")
    if start == at or len(labels) < 2 or not all(x and set(x) <= LABEL for x in labels):
        return None
    end = stop
    while end < len(text) and text[end] not in URL_STOP:
        end += 1
    while text[end - 1] in ".,;:!?'\")]*#&$%":
        end -= 1
    return start, end, True


def _iban(text: str, at: int):
    while at < len(text) and text[at] in " :":
        at += 1
    end, plain = at, ""
    while end < len(text) and len(plain) < 34 and (text[end] in LETTERS or text[end] in DIGITS or text[end] == " "):
        if text[end] == " ":
            if end + 1 >= len(text) or not (text[end + 1] in DIGITS or text[end + 1].isupper()):
                break
        else:
            plain += text[end]
        end += 1
    if len(plain) < 15 or not (plain[:2].isalpha() and plain[:2].isupper() and plain[2:4].isdigit()):
        return None
    turned = plain[4:] + plain[:4]
    valid = turned.upper() == turned and int("".join(str(int(c, 36)) for c in turned)) % 97 == 1
    return (at, end, True) if valid else None


def _account(text: str, at: int):
    """Digits behind a cue, with at most a short label between."""
    for label in (" number", " no.", " no", " nr.", " nr"):
        if text[at : at + len(label)].lower() == label:
            at += len(label)
            break
    while at < len(text) and text[at] in " :#=":
        at += 1
    end = _run(text, at, DIGITS | {"-"})
    while end > at and text[end - 1] == "-":
        end -= 1
    fenced = end >= len(text) or text[end] not in LETTERS
    return (at, end, True) if fenced and 6 <= sum(c in DIGITS for c in text[at:end]) <= 17 else None


def _street(text: str, at: int, end: int, floor: int):
    """A number, then one to four capitalised words, before the cue."""
    if end < len(text) and text[end] in LETTERS:
        return None
    for _ in range(4):
        start = _back(text, at, LETTERS, floor)
        if start == at or not text[start].isupper() or start <= floor or text[start - 1] != " ":
            return None
        number = _back(text, start - 1, DIGITS, floor)
        if 1 <= start - 1 - number <= 5:
            return number, end, True
        at = start - 1
    return None


def find(text: str) -> list[tuple[str, int, int]]:
    """All spans of a text as (kind, start, end)."""
    found: list[tuple[str, int, int]] = []
    after = dict.fromkeys(KINDS, 0)

    def settle(kind: str, match) -> None:
        if match is not None:
            after[kind] = match[1]
            if match[2]:
                found.append((kind, match[0], match[1]))

    for last, (anchor, word) in _automaton().iter(text):
        at = last - len(word) + 1
        if anchor == "0":
            if at >= after["ip"] and (at == after["ip"] or text[at - 1] not in DIGITS):
                settle("ip", _address(text, at))
            if at >= after["card"]:
                settle("card", _card(text, at))
        elif anchor == "@":
            settle("email", _email(text, at, after["email"]))
        elif anchor == "+":
            if at >= after["phone"]:
                settle("phone", _phone(text, at))
        elif anchor == "url":
            if at >= after["url"]:
                settle("url", _url(text, at, after["url"]))
        elif anchor == "street":
            if at >= after["street"]:
                settle("street", _street(text, at, last + 1, after["street"]))
        elif last + 1 >= after[anchor]:
            settle(anchor, (_iban if anchor == "iban" else _account)(text, last + 1))
    return found


def personal_data(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and all ``spans`` (kind, start, end, value) of each row of ``docs``."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [in_order(find(t), KINDS, t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(spans, pa.list_(SPAN))], names=["doc_id", "spans"]
            )

    return keyed_text(docs, key, text).mapInArrow(scan, f"doc_id bigint, spans {SPAN_DDL}")
