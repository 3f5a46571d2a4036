"""The filter audit against a plain loop over all orders, and its sketch."""

import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.corpus import LONG, documents
from tidemark.llm import filter_audit, repeat_sketch

FIELDS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
WORDS = " ".join(f"w{i}" for i in range(200))
ROWS = [
    (1, WORDS, "en", "a"),
    (2, WORDS, "en", "b"),
    (2, WORDS, "en", "b"),
    (3, WORDS + " $", "en", "a"),
    (4, WORDS + " $", "en", "a"),
    (5, "x " * 300, "en", ""),
    (6, "SHOUT " * 300, "en", None),
    (None, WORDS, "en", "a"),
    (None, WORDS, "en", "a"),
    (8, LONG, "en", "b"),
    (-9, LONG, "en", "b"),
    (10, "É \u0085 \u001c", "en", "a"),
]


def plain(rows, labels):
    """Every order run by itself, document by document."""
    first = {}
    for key, text, _, _ in rows:
        if key is not None:
            first[text or ""] = min(first.get(text or "", key), key)
    good = {k for k, q, _ in labels if q == 1}
    toxic = {k for k, _, t in labels if t == 1}
    made = {}
    for part in {p or "" for *_, p in rows}:
        docs = []
        for key, text, _, p in rows:
            if (p or "") == part:
                t = text or ""
                w = re.findall(r"[^\x20\x09-\x0D]+", t)
                fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w),
                         "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t)),
                         "E": key is not None and key > first[t]}
                docs.append((key, {f for f in fails if fails[f]}))
        shapley = Counter()
        for order in permutations("ABCDE"):
            left = docs
            for step, f in enumerate(order, 1):
                out = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                shapley[f] += len(out)
                made[part, "".join(order), step] = [
                    len(left), len(out), sum(f in d[1] for d in docs) - len(out), sum(d[1] == {f} for d in docs),
                    sum(d[0] in good for d in out), sum(d[0] in toxic for d in out), f,
                ]
        for (p, _, _), values in made.items():
            if p == part:
                values[-1] = shapley.get(values[-1], 0) if isinstance(values[-1], str) else values[-1]
    return {k: tuple(v) for k, v in made.items()}


LABELS = [(1, 1, 0), (2, 1, 1), (4, 0, 1), (4, 1, None), (8, None, None), (None, 1, 1), (77, 1, 1)]


def labels(spark, rows=LABELS):
    table = spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")
    return table.withColumns({c: F.lit("x") for c in ("n", "h1", "first_id", "open", "mask", "part")})


@pytest.mark.parametrize("segments", [repeat_sketch.MAX_SEGMENTS, 1])
def test_audit_equals_every_order_run_by_itself(spark, segments):
    docs = documents(spark, ROWS)
    found = filter_audit.all_orders(filter_audit.mask_counts(docs, labels(spark), segments=segments), "ABCDE")
    got = {(r.part, r.filter_order, r.step): tuple(r[f] for f in FIELDS) for r in found.collect()}
    assert got == plain(ROWS, LABELS)


def test_audit_of_awkward_rows_and_empty_tables(spark):
    docs = documents(spark)
    rows = [(r.doc_id, r.text, None, r.source) for r in docs.collect()]
    got = {(r.part, r.filter_order, r.step): tuple(r[f] for f in FIELDS) for r in filter_audit.audit(docs, labels(spark, [])).collect()}
    assert got == plain(rows, [])
    assert filter_audit.audit(documents(spark, []), labels(spark)).count() == 0


def test_sketch_clears_no_repeat_and_most_others(spark):
    once, twice = range(20_000), range(20_000, 20_400)
    rows = spark.createDataFrame([(i,) for i in [*once, *twice, *twice]], "id long").repartition(7)
    hashes = rows.select(F.xxhash64("id").alias("h"), "id")
    test = repeat_sketch.possible_repeat(hashes.select("h"), 20_800)
    open_ids = Counter(r.id for r in hashes.filter(test(F.col("h"))).collect())
    assert all(open_ids[i] == 2 for i in twice)
    assert sum(i in open_ids for i in once) < 200


def test_sketch_parts_add_up_over_segments():
    slots = np.array([1, 5, 65_535, 65_536, 200_000], np.uint64)
    part = repeat_sketch._parts(slots, np.array([1, 300, 2, 1, 1])).to_pylist()
    assert [p["segment"] for p in part] == [0, 1, 3]
    assert list(part[0]["counts"]) == [1, 255, 2] and np.frombuffer(part[2]["slots"], "<u2").tolist() == [200_000 - 3 * 65_536]
    assert repeat_sketch.segments_for(0) == 1 and repeat_sketch.segments_for(1 << 40) == repeat_sketch.MAX_SEGMENTS
