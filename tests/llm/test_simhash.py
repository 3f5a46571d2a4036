import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm.corpus import documents, plain
from tidemark.llm import simhash
from tidemark.llm.components import components
from tidemark.llm.gray_index import GrayIndex, gray_rank, spanning_links


def plain_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    parts = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


class Groups(dict):
    """Union-find of anything."""

    def root(self, x):
        self.setdefault(x, x)
        while self[x] != x:
            x = self[x]
        return x

    def join(self, a, b):
        a, b = self.root(a), self.root(b)
        self[max(a, b)] = min(a, b)


def groups_of(members, pairs):
    joined = Groups()
    for a, b in pairs:
        joined.join(a, b)
    found = {}
    for m in members:
        found.setdefault(joined.root(m), set()).add(m)
    return {frozenset(g) for g in found.values()}


def near_pairs(fingerprints):
    apart = np.bitwise_count(fingerprints[:, None] ^ fingerprints[None, :])
    return [(int(fingerprints[i]), int(fingerprints[j])) for i, j in zip(*np.nonzero(apart <= 2), strict=True) if i < j]


def family(rng, n, centres, flips):
    base = rng.integers(0, 2**63, centres, dtype=np.uint64) * np.uint64(2)
    made = base[rng.integers(0, centres, n)]
    for _ in range(flips):
        made = made ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64))
    return np.unique(made)


def test_fingerprints_equal_the_plain_rule(spark, folder):
    texts = [r.text for r in spark.read.parquet(f"{folder}/documents.parquet").limit(80).collect()]
    for text in [*texts, "", " ", "a", "a b", "A B c\x0bd\x1ce É É", "x " * 100]:
        assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_gray_order_has_one_change_a_step():
    ranks = np.arange(1000, dtype=np.uint64)
    codes = ranks ^ (ranks >> np.uint64(1))
    assert (gray_rank(codes) == ranks).all()


@pytest.mark.parametrize("n, centres, flips", [(1, 1, 0), (8, 2, 1), (700, 20, 2), (2000, 3, 3)])
def test_index_finds_every_pair(n, centres, flips):
    own = family(np.random.default_rng(n), n, centres, flips)
    ordered = own[np.argsort(gray_rank(own))]
    found = {(a, b) for q, o in GrayIndex(ordered).within(ordered, 2) for a, b in zip(q.tolist(), o.tolist(), strict=True)}
    apart = np.bitwise_count(ordered[:, None] ^ ordered[None, :])
    assert found == set(zip(*(x.tolist() for x in np.nonzero(apart <= 2)), strict=True))
    u, v = spanning_links(own, 2)
    assert len(u) < len(own)
    members = own.tolist()
    assert groups_of(members, zip(u.tolist(), v.tolist(), strict=True)) == groups_of(members, near_pairs(own))


@pytest.mark.parametrize("bucket", [4096, 30, 4])
def test_full_buckets_lose_no_link(spark, bucket):
    rng = np.random.default_rng(2)
    own = np.unique(np.concatenate([family(rng, 600, 2, 3), family(rng, 300, 80, 2)]))
    df = spark.createDataFrame([(int(x),) for x in own.view(np.int64)], "fp bigint")
    found = [(r.u % 2**64, r.v % 2**64) for r in simhash.links(df, bucket).collect()]
    assert groups_of(own.tolist(), found) == groups_of(own.tolist(), near_pairs(own))


def test_components_of_chains_and_stars(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)]
    pairs += [(i, i + 1) for i in range(1000, 1120)] + [(5000, i) for i in range(4000, 4100)]
    joined = Groups()
    for a, b in pairs:
        joined.join(a, b)
    found = {r.node: r.root for r in components(spark.createDataFrame(pairs, "u bigint, v bigint")).collect()}
    assert found == {x: joined.root(x) for x in list(joined) if joined.root(x) != x}


def test_near_duplicates_equal_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    prints = {r.doc_id: simhash.fingerprint(r.text or "") for r in docs.collect()}
    own = np.array(sorted(set(prints.values())), np.uint64)
    by_print = {f: k for k, g in enumerate(groups_of(own.tolist(), near_pairs(own))) for f in g}
    least = {}
    for key in sorted(prints):
        least.setdefault(by_print[prints[key]], key)
    found = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert found == {k: (f"{f:016x}", least[by_print[f]]) for k, f in prints.items()}


def test_awkward_rows(spark):
    docs = documents(spark)
    found = simhash.near_duplicates(docs).collect()
    assert len(found) == 12
    group = {r.doc_id: r.component_id for r in found if r.doc_id is not None}
    assert (group[2], group[3], group[4], group[1], group[9], group[7]) == (2, 2, 2, 1, 1, 7)
    assert sorted(r.component_id or 0 for r in found if r.doc_id is None) == [0, 2]
    kept = simhash.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 5, 6, 7, 10]
    assert simhash.near_duplicates(documents(spark, [])).count() == 0
    assert simhash.deduplicated(documents(spark, [])).count() == 0


def test_many_copies_of_one_text(spark):
    docs = plain(spark, [(k, "the same words again and again") for k in range(500, 800)] + [(1, "other words here")])
    found = simhash.near_duplicates(docs).groupBy("component_id").agg(F.count("*").alias("n")).collect()
    assert {r.component_id: r.n for r in found} == {500: 300, 1: 1}
