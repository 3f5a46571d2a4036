import hashlib
import re
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tests.llm.corpus import documents
from tidemark.llm import mixing


def n_words(text):
    return len([w for w in re.split(r"[ \t-\r]+", text or "") if w])


def chosen(rows, budget, weight, max_epochs, seed=1):
    """(key, epoch) of each selected row, by ordering whole leaves; equal rows stand together."""
    leaves = defaultdict(Counter)
    for key, text, path in rows:
        leaves[path][(key, hashlib.md5((text or "").encode()).hexdigest(), n_words(text))] += 1
    totals = {p: sum(x[2] * c for x, c in own.items()) for p, own in leaves.items()}
    totals = {p: n for p, n in totals.items() if n}
    found = Counter()
    for path, given in mixing.budgets(totals, sum(totals.values()) if budget is None else budget, weight, max_epochs).items():
        whole, rest, own = int(given // totals[path]), int(given % totals[path]), leaves[path]
        for (key, _, _), copies in own.items():
            for epoch in range(whole):
                found[(key, epoch)] += copies
        used = 0
        place = lambda x: hashlib.md5(f"{seed}:{whole}:{'' if x[0] is None else x[0]}:{x[1]}".encode()).hexdigest()  # noqa: B023, E731
        for item in sorted(own, key=place) if rest else ():
            if used + item[2] * own[item] > rest:
                break
            used += item[2] * own[item]
            found[(item[0], whole)] += own[item]
    return found


def test_shortage_goes_to_siblings_before_ancestors():
    tokens = {("a", "x"): 10, ("a", "y"): 1000, ("b", "z"): 1000}
    given = mixing.budgets(tokens, 400, lambda p: Fraction(1), 1)
    assert given == {("a", "x"): 10, ("a", "y"): 190, ("b", "z"): 200}
    short = mixing.budgets({("a", "x"): 10, ("a", "y"): 20, ("b", "z"): 1000}, 400, lambda p: Fraction(1), 1)
    assert short == {("a", "x"): 10, ("a", "y"): 20, ("b", "z"): 370}
    assert sum(mixing.budgets(tokens, 10**9, lambda p: Fraction(1), 2).values()) == 2 * 2010
    assert mixing.budgets({}, 5, lambda p: Fraction(1), 1) == {}


def test_weights_of_zero_take_what_is_left():
    given = mixing.share_out(Fraction(90), {"a": (Fraction(0), Fraction(50)), "b": (Fraction(1), Fraction(30)), "c": (Fraction(0), Fraction(50))})
    assert given == {"a": 30, "b": 30, "c": 30}


@pytest.mark.parametrize("budget, digits", [(None, 2), (20_000, 2), (300_000, 1), (10**9, 2), (0, 2)])
def test_selection_equals_ordering_whole_leaves(spark, folder, monkeypatch, budget, digits):
    monkeypatch.setattr(mixing, "DIGITS", digits)
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumn("source", F.when(F.col("doc_id") % 3 == 0, "hot").otherwise(F.col("source")))
    weight = lambda p: Fraction({"en": 3, "hot": 5}.get(p[-1], 1))
    path = [F.substring("source", 1, 4), F.col("lang"), F.col("source")]
    selected = mixing.selection(docs, path, weight, budget, 3)
    found = Counter((r.doc_id, r.epoch) for r in mixing.mix(selected).collect())
    rows = [(r.doc_id, r.text, ((r.source or "")[:4], r.lang or "", r.source or "")) for r in docs.collect()]
    assert found == chosen(rows, budget, weight, 3)
    kept = Counter(r.doc_id for r in mixing.mixed_documents(docs, selected, path).collect())
    assert kept == Counter(k for k, _ in found.elements())


def test_awkward_rows(spark):
    docs = documents(spark)
    path = [F.col("lang"), F.col("source")]
    weight = lambda p: Fraction(1)
    selected = mixing.selection(docs, path, weight, max_epochs=2)
    found = Counter((r.doc_id, r.epoch) for r in mixing.mix(selected, ("lang", "source")).collect())
    rows = [(r.doc_id, r.text, (r.lang or "", r.source or "")) for r in docs.collect()]
    assert found == chosen(rows, None, weight, 2)
    kept = mixing.mixed_documents(docs, selected, path)
    assert kept.columns == docs.columns and kept.count() == sum(found.values())
    assert mixing.mix(mixing.selection(documents(spark, []), path, weight)).count() == 0


def test_too_many_leaves_are_refused(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MAX_LEAVES", 2)
    with pytest.raises(ValueError, match="leaves"):
        mixing.selection(documents(spark), [F.col("lang"), F.col("source")], lambda p: Fraction(1))
