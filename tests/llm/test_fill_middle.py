"""Boundary sets against plain offsets; fill-in-the-middle against slicing."""

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.corpus import documents
from tidemark.llm.boundaries import SPAN, Array, Bitmap, BoundarySet, Runs, container
from tidemark.llm.fill_middle import digests, draws, fill_in_middle, restore, transform


def offsets(text):
    at, all_ = 0, []
    for c in text:
        all_.append(at)
        at += len(c.encode())
    return [*all_, at]


@pytest.mark.parametrize("text", ["", "a", "é", "plain text " * 20_000, "日本語" * 40_000, "aé" * 60_000, "\U0001f600" * 50_000, "x" * SPAN, "x" * (SPAN - 1) + "é" + "y" * 9])
def test_select_equals_offsets(text):
    units, plain = BoundarySet.of_code_points(text.encode()), offsets(text)
    assert len(units) == len(text)
    step = max(1, len(plain) // 3_000)
    for i in {*range(0, len(plain), step), len(text), max(0, len(text) - 1)}:
        assert units.select(i) == plain[i]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=400))
def test_select_of_any_text(text):
    units = BoundarySet.of_code_points(text.encode())
    assert [units.select(i) for i in range(len(text) + 1)] == offsets(text)


def test_each_kind_of_container_is_used():
    rng = np.random.default_rng(3)
    dense = np.ones(SPAN, bool)
    sparse = np.zeros(SPAN, bool)
    sparse[rng.choice(SPAN, 500, replace=False)] = True
    mixed = rng.random(SPAN) < 0.5
    for marks, kind in ((dense, Runs), (sparse, Array), (mixed, Bitmap)):
        made = container(marks)
        assert isinstance(made, kind)
        places = np.flatnonzero(marks)
        assert [made.select(i) for i in range(0, len(places), 37)] == places[::37].tolist()


def sliced(key, text):
    h = hashlib.sha256(f"1:{key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"
    return n, "psm", a, b - a, f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"


@settings(max_examples=300, deadline=None)
@given(st.integers(-(2**63), 2**63 - 1), st.lists(st.sampled_from(["<", "<P", "S>", "M>", "<M>", "é", "x", "\U0001f600", "\n"]), max_size=12))
def test_transform_equals_slicing_and_restores(key, parts):
    text = "".join(parts)
    made = transform(key, text)
    assert made == sliced(key, text)
    assert restore(made[4], made[1]) == text


def test_all_forms_occur():
    forms = [transform(k, "some text")[1] for k in range(1000)]
    assert {f: forms.count(f) > 50 for f in set(forms)} == {"plain": True, "psm": True, "spm": True}
    assert draws(None) == [int(hashlib.sha256(b"1:null").hexdigest()[8 * i : 8 * i + 8], 16) for i in range(4)]


def test_awkward_rows(spark):
    docs = documents(spark)
    made = fill_in_middle(docs)
    for r in made.collect():
        assert restore(r.output, r.form) is not None
    got = sorted((str(r.doc_id), r.n, r.form, r.restored_sha256) for r in digests(made).collect())
    want = []
    for r in docs.collect():
        text, key = r.text or "", "null" if r.doc_id is None else r.doc_id
        want.append((str(r.doc_id), len(text), sliced(key, text)[1], hashlib.sha256(text.encode()).hexdigest()))
    assert got == sorted(want)
    assert digests(fill_in_middle(documents(spark, []))).count() == 0
