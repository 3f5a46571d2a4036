"""Suffix rules against plain loops, and on forms they have not seen."""

import random
from collections import Counter, defaultdict

import pytest

from tidemark.operators import lemma_rules as R


def plain_rules(forms, longest):
    counts = defaultdict(Counter)
    for word, lemma in forms:
        shared = 0
        while shared < min(len(word), len(lemma)) and word[shared] == lemma[shared]:
            shared += 1
        cut, add = len(word) - shared, lemma[shared:]
        for k in range(cut, min(longest, len(word)) + 1):
            counts[word[len(word) - k:]][cut, add] += 1
    best = {s: min((-n, cut, add) for (cut, add), n in c.items()) for s, c in counts.items()}
    return {
        s: (cut, add, -n)
        for s, (n, cut, add) in best.items()
        if not (s and s[1:] in best and best[s[1:]][1:] == (cut, add))
    }


def plain_lemma(word, rules, longest):
    for k in range(min(longest, len(word)), -1, -1):
        if (end := word[len(word) - k:]) in rules:
            cut, add, _ = rules[end]
            return (word[: len(word) - cut] + add) or word
    return word


def inflected(seed, n):
    """Made verbs and nouns with regular endings, some of them irregular."""
    rng, made = random.Random(seed), {}
    while len(made) < n:
        stem = "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(2, 3))) + rng.choice("lmnrtk")
        end, lemma = rng.choice(
            [("s", stem), ("ed", stem), ("ing", stem), ("ies", stem + "y"), ("ied", stem + "y"), ("", stem), ("ness", stem)]
        )
        made[stem + end] = lemma if rng.random() > 0.01 else "x" + stem
    return sorted(made.items())


@pytest.mark.parametrize("longest", [1, 3, 5])
def test_rules_equal_plain_loops(spark, longest):
    forms = inflected(1, 600) + [("went", "go"), ("a", "an"), ("is", "be"), ("naïve", "naif"), ("𝒳s", "𝒳")]
    table = spark.createDataFrame(forms, "word string, lemma string")
    rules = R.learn_rules(table, longest)
    own = {r.suffix: (r.cut, r.add, r.support) for r in rules.collect()}
    assert own == plain_rules(forms, longest)
    guessed = dict(R.by_rules(table.select("word"), rules, longest).collect())
    assert guessed == {w: plain_lemma(w, own, longest) for w, _ in forms}
    exceptions = R.learn_exceptions(table, rules, longest)
    assert dict(R.lemmas_of(table.select("word"), rules, exceptions, longest).collect()) == dict(forms)


def test_unseen_forms(spark):
    every = inflected(2, 6000)
    random.Random(3).shuffle(every)
    seen, unseen = every[:5000], every[5000:]
    rules = R.learn_rules(spark.createDataFrame(seen, "word string, lemma string"))
    words = spark.createDataFrame([(w,) for w, _ in unseen], "word string")
    guessed = dict(R.by_rules(words, rules).collect())
    right = sum(guessed[w] == lemma for w, lemma in unseen) / len(unseen)
    itself = sum(w == lemma for w, lemma in unseen) / len(unseen)
    assert right > 0.95 > itself


def test_forms_and_texts(spark):
    pairs = [("Cats", "cat"), ("cats", "cat"), ("cats", "cats"), ("dogs", "dog"), ("dogs", "doga"), (None, "x"), ("x", None), ("", "y")]
    forms = R.forms_of(spark.createDataFrame(pairs, "word string, lemma string"))
    assert dict(forms.collect()) == {"cats": "cat", "dogs": "dog"}
    rules = R.learn_rules(forms)
    texts = spark.createDataFrame(
        [(1, "Cats and birds, birds"), (2, None), (3, ""), (4, "s " + "hens " * 50_000)], "id long, text string"
    )
    found = {(r.id, r.lemma): r.times for r in R.lemma_counts(texts, rules, R.learn_exceptions(forms, rules), "id").collect()}
    assert found == {(1, "cat"): 1, (1, "and"): 1, (1, "bird"): 2, (4, "hen"): 50_000}


def test_no_forms(spark):
    empty = spark.createDataFrame([], "word string, lemma string")
    rules = R.learn_rules(R.forms_of(empty))
    words = spark.createDataFrame([("cats",), ("a",)], "word string")
    assert rules.count() == 0
    assert dict(R.lemmas_of(words, rules, R.learn_exceptions(empty, rules)).collect()) == {"cats": "cats", "a": "a"}


def test_vocabulary_as_forms(spark):
    words = spark.createDataFrame([(w,) for w in "hand hands handle handles handled by bys and".split()], "word string")
    assert dict(R.forms_in(words).collect()) == {
        "hand": "hand", "hands": "hand", "handle": "hand", "handles": "handle", "handled": "handle",
        "by": "by", "bys": "bys", "and": "and",
    }


def test_words_of_a_text_are_not_shuffled_to_be_counted(spark):
    rows = [(1, "cats cat cats"), (1, "cat"), (None, "dogs"), (2, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    forms = spark.createDataFrame([("cats", "cat"), ("dogs", "dog"), ("cat", "cat")], "word string, lemma string")
    rules = R.learn_rules(forms)
    made = R.lemma_counts(df, rules, R.learn_exceptions(forms, rules), "doc_id")
    exchanges = [x for x in made._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in x]
    assert exchanges and not any("word" in x or "lemma" in x for x in exchanges)
    got = {(r["doc_id"], r["lemma"]): r["times"] for r in made.collect()}
    assert got == {(1, "cat"): 4, (None, "dog"): 1}
