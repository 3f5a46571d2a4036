"""Lemmas by suffix rules which are learned from a table of forms and their lemmas.

A rule says: a word which ends in ``suffix`` loses its last ``cut`` characters and takes ``add``.
The longest suffix decides.  Learning is two aggregations and a join by the suffix that is one
character shorter; forms whose lemma the rules miss are kept as exceptions.  All of it is
joins and groupings on words and suffixes, so a table of any size may be learned from, and a
word meets at most ``longest + 1`` suffixes.

Null and empty words and lemmas are no forms.  A word with several lemmas takes the most
frequent one, of equals the smallest.  An empty table gives no rules: every word is its own lemma.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import tokens
from tidemark.operators.ngrams import dealt_texts
from tidemark.plans.staging import sized, stage

#: Length of the longest suffix looked at.
LONGEST = 5


def forms_of(pairs: DataFrame) -> DataFrame:
    """``word, lemma`` (lower case), one row a word, from rows of ``word, lemma``."""
    low = pairs.select(F.lower("word").alias("word"), F.lower("lemma").alias("lemma"))
    counted = low.where("word <> '' and lemma <> ''").groupBy("word", "lemma").agg(F.count(F.lit(1)).alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("n"), "lemma"))["lemma"]
    return counted.groupBy("word").agg(best.alias("lemma"))


def _change(word: Column, lemma: Column) -> tuple[Column, Column]:
    """How many last characters go, and what comes in their place."""
    shared = F.size(
        F.filter(
            F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.length(word), F.length(lemma)))),
            lambda k: F.substring(word, F.lit(1), k) == F.substring(lemma, F.lit(1), k),
        )
    )
    return F.length(word) - shared, F.substring(lemma, shared + 1, F.length(lemma))


def _suffixes(word: Column, shortest: Column, longest: int) -> Column:
    """The endings of a word from ``shortest`` to ``longest`` characters; empty if there are none."""
    most = F.least(F.lit(longest), F.length(word))
    lengths = F.when(shortest <= most, F.sequence(shortest, most)).otherwise(F.array().cast("array<int>"))
    return F.transform(lengths, lambda k: F.substring(word, F.length(word) - k + 1, k))


def learn_rules(forms: DataFrame, longest: int = LONGEST) -> DataFrame:
    """``suffix, cut, add, support`` from ``word, lemma`` (one row a word, see ``forms_of``).

    A suffix's rule is the change most of its words take (then the shorter cut, then the smaller
    text added) among the changes inside the suffix.  Rules which say what the next shorter
    suffix says as well are left out; they would change no result.
    """
    cut, add = _change(F.col("word"), F.col("lemma"))
    changed = forms.select("word", cut.alias("cut"), add.alias("add"))
    counted = (
        changed.select(F.explode(_suffixes(F.col("word"), F.col("cut"), longest)).alias("suffix"), "cut", "add")
        .groupBy("suffix", "cut", "add")
        .agg(F.count(F.lit(1)).alias("support"))
    )
    best = F.min(F.struct((-F.col("support")).alias("less"), "cut", "add")).alias("best")
    ruled = stage(
        counted.groupBy("suffix").agg(best).select("suffix", "best.cut", "best.add", (-F.col("best.less")).alias("support")),
        "suffix-rules",
    )
    shorter = ruled.select(F.col("suffix").alias("_shorter"), F.col("cut").alias("_cut"), F.col("add").alias("_add"))
    parent = F.when(F.length("suffix") > 0, F.substring(F.col("suffix"), F.lit(2), F.length("suffix")))
    paired = ruled.withColumn("_shorter", parent).join(sized(shorter), "_shorter", "left")
    same = (F.col("_cut") == F.col("cut")) & (F.col("_add") == F.col("add"))
    return paired.where(~F.coalesce(same, F.lit(False))).select("suffix", "cut", "add", "support")


def by_rules(words: DataFrame, rules: DataFrame, longest: int = LONGEST) -> DataFrame:
    """``word, lemma`` of distinct words by the longest suffix with a rule; else the word itself."""
    ends = words.select("word", F.explode(_suffixes(F.col("word"), F.lit(0), longest)).alias("suffix"))
    found = ends.join(sized(rules.select("suffix", "cut", "add")), "suffix", "left")
    matched = F.when(F.col("cut").isNotNull(), F.struct(F.length("suffix").alias("long"), "cut", "add"))
    chosen = found.groupBy("word").agg(F.max(matched).alias("_rule"))
    kept = F.substring(F.col("word"), F.lit(1), F.length("word") - F.col("_rule.cut"))
    made = F.concat(kept, F.col("_rule.add"))
    # a rule which would leave nothing is not applied
    return chosen.select("word", F.coalesce(F.when(made != "", made), F.col("word")).alias("lemma"))


def learn_exceptions(forms: DataFrame, rules: DataFrame, longest: int = LONGEST) -> DataFrame:
    """``word, lemma`` of the forms whose lemma the rules miss."""
    guessed = by_rules(forms.select("word"), rules, longest).withColumnRenamed("lemma", "_guess")
    return forms.join(guessed, "word").where(F.col("lemma") != F.col("_guess")).select("word", "lemma")


def lemmas_of(words: DataFrame, rules: DataFrame, exceptions: DataFrame, longest: int = LONGEST) -> DataFrame:
    """``word, lemma`` of distinct words: an exception's own lemma, else that of the rules."""
    ruled = by_rules(words, rules, longest).withColumnRenamed("lemma", "_ruled")
    listed = sized(exceptions.withColumnRenamed("lemma", "_listed"))
    return ruled.join(listed, "word", "left").select("word", F.coalesce("_listed", "_ruled").alias("lemma"))


def lemma_counts(
    df: DataFrame, rules: DataFrame, exceptions: DataFrame, id_column: str, text: str = "text", longest: int = LONGEST
) -> DataFrame:
    """``id, lemma, times``: the words of each text under their lemmas.

    Words are counted where their text lies, and only distinct words meet the rules; their lemmas are
    sent to the counts if they are few.
    """
    distinct = df.select(F.explode(tokens(text)).alias("word")).distinct()
    found = stage(lemmas_of(stage(distinct, "words"), rules, exceptions, longest), "lemmas")
    counted = (
        dealt_texts(df, [id_column], text)
        .select(id_column, F.explode(tokens(text)).alias("word"))
        .groupBy(id_column, "word")
        .agg(F.count(F.lit(1)).alias("times"))
    )
    return counted.join(sized(found), "word").groupBy(id_column, "lemma").agg(F.sum("times").alias("times"))


def forms_in(words: DataFrame, least: int = 4, most: int = 3) -> DataFrame:
    """A table of forms made from a vocabulary: ``word, lemma`` of its distinct ``word``.

    The lemma is the longest proper beginning of the word, of ``least`` characters or more and
    up to ``most`` shorter than the word, which is a word itself; else the word.
    """
    lengths = F.length("word")
    starts = F.when(
        lengths > least, F.sequence(F.greatest(F.lit(least), lengths - most), lengths - 1)
    ).otherwise(F.array().cast("array<int>"))
    heads = words.select("word", F.explode(F.transform(starts, lambda k: F.substring(F.col("word"), F.lit(1), k))).alias("head"))
    known = heads.join(words.select(F.col("word").alias("head")), "head")
    longest = known.groupBy("word").agg(F.max_by("head", F.length("head")).alias("_head"))
    return words.join(longest, "word", "left").select("word", F.coalesce("_head", "word").alias("lemma"))


__all__ = ["by_rules", "forms_in", "forms_of", "learn_exceptions", "learn_rules", "lemma_counts", "lemmas_of"]
