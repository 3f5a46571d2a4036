import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tests.llm.corpus import documents
from tidemark.llm import lang_id


def grams(text):
    """N-grams of a text counted one by one."""
    points = lang_id._letters()[np.frombuffer(text.encode("utf-32-le"), "<u4")]
    found = Counter()
    for word in re.split("\0+", "".join(map(chr, points))):
        fenced = f"\0{word}\0"
        found.update(word)
        if word:
            found.update(fenced[i : i + 2] for i in range(len(fenced) - 1))
            found.update(fenced[i : i + 3] for i in range(len(fenced) - 2))
    return found


def code(gram):
    number = 0
    for c in gram:
        number = number << 21 | ord(c)
    return number + (1 << 63 if len(gram) == 2 else 0)


def predicted(text, profiles, size):
    """Out-of-place distance in the plainest way; ``profiles``: codes in order."""
    own = sorted((-n, code(g)) for g, n in grams(text).items())[:size]
    if not own or not profiles:
        return "und", 0.0
    distances = []
    for name in sorted(profiles):
        rank = {np.int64(c).view(np.uint64).item(): k for k, c in enumerate(profiles[name])}
        distances.append((sum(min(abs(rank[c] - k), size) if c in rank else size for k, (_, c) in enumerate(own)), name))
    best = min(distances)
    return best[1], 1 - best[0] / (len(own) * size)


def test_profiles_and_predictions_equal_plain_counting(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    held_out = lang_id.held_out_fold(F.col("doc_id"))
    profiles = lang_id.learn_profiles(docs.filter(~held_out))
    rows = docs.collect()
    sums = {}
    for r in rows:
        if r.lang and r.text and not lang_id.in_fold(r.doc_id):
            sums.setdefault(r.lang, Counter()).update(grams(r.text))
    for name, counts in sums.items():
        signed = sorted((-n, np.uint64(code(g)).view(np.int64).item()) for g, n in counts.items())
        assert profiles[name] == [c for _, c in signed[: lang_id.PROFILE]]
    found = {r.doc_id: r for r in lang_id.identify(docs, profiles).collect()}
    size = max(map(len, profiles.values()))
    for r in rows[:60]:
        name, score = predicted(r.text, profiles, size)
        assert found[r.doc_id].lang_pred == name and abs(found[r.doc_id].score - score) < 1e-9
    unseen = [r for r in rows if lang_id.in_fold(r.doc_id)]
    right = sum(found[r.doc_id].lang_pred == r.lang for r in unseen)
    assert right >= 0.95 * len(unseen)


def test_fold_is_the_checksum_of_the_key(spark):
    rows = spark.range(200).select("id", lang_id.held_out_fold(F.col("id")).alias("out")).collect()
    assert [r.out for r in rows] == [lang_id.in_fold(r.id) for r in rows]


def test_awkward_rows(spark):
    docs = documents(spark)
    profiles = lang_id.learn_profiles(docs)
    assert sorted(profiles) == ["de", "en"]
    named = lang_id.identify(docs, profiles)
    assert named.columns == [c for c in docs.columns if c not in ("lang_pred", "score")] + ["lang_pred", "score"]
    found = named.collect()
    assert len(found) == 12
    by = {r.doc_id: r for r in found if r.doc_id is not None}
    assert all((by[k].lang_pred, by[k].score) == ("und", 0.0) for k in (2, 3, 4, 5))
    assert (by[1].lang_pred, by[7].lang_pred) == ("en", "de")
    assert all(0 <= r.score <= 1 for r in found)
    assert lang_id.learn_profiles(documents(spark, [])) == {}
    assert {r.lang_pred for r in lang_id.identify(docs, {}).collect()} == {"und"}


def test_a_chunk_boundary_changes_nothing(monkeypatch):
    texts = ["The old mill", "Straße über Öl", "", "中文 字 and more", "The old mill"] * 5
    ranker = lang_id.Ranker({"a": [ord("e"), ord("t")], "b": [ord("ß"), ord("ü")]})
    whole = ranker.predict(texts)
    monkeypatch.setattr(lang_id, "CHUNK", 20)
    assert ranker.predict(texts) == whole
